import duckdb
import pytest
from braidwork.llm import registry, secrets, simhash, tiling

from .helpers import ODD, clashing, documents

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names, name
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before, left = {r["doc_id"] for r in docs.collect()}, {r["doc_id"] for r in after.collect()}
        assert left <= before
        if name == "near_duplicates":
            classes = simhash.near_duplicates(docs).collect()
            assert left == {r["component_id"] for r in classes}
        if name == "decontamination":
            hit = tiling.find(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(matches) > 0")
            assert before - left == {r["doc_id"] for r in hit.collect()}
        if name == "secrets":
            assert left == before
            assert not secrets.scan(after).where("exists(secret_spans, s -> s.kind <> 'hex')").collect()
        docs = after
    final = C.run(spark, SF).collect()
    assert {r["doc_id"] for r in final} == {r["doc_id"] for r in docs.collect()} and all(r["round_trip"] for r in final)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracles_agree(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


UNLIKE = [(5, "some other words under the number five", "en", "s1", 38), (5, "x" * 5000, "en", "s1", 5000), (8, "some other words under the number five", "en", "s1", 38), (None, None, None, None, None)]


def test_stages_take_odd_rows_and_lose_no_text(spark, tmp_path):
    import corpus_pipeline as C

    docs = clashing(documents(spark, ODD + UNLIKE))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left = sorted(((r["doc_id"], (r["text"] or "")[:20]) for r in docs.collect()), key=str)
        if name != "toxicity":  # one row for each text that is unlike the others; the empty ones are one
            assert left == sorted({(r[0], (r[1] or "")[:20]) for r in ODD + UNLIKE if r[0] in (1, 2, 4, 5, 6, 7) or r[0] is None and r[1]}, key=str)
    final = C.STAGES[-1][1](spark, clashing(docs), SF).collect()
    assert len(final) == len(left) and all(r["round_trip"] for r in final)


def test_stages_take_empty_tables(spark):
    import corpus_pipeline as C

    for _, stage in C.STAGES:
        assert stage(spark, documents(spark, []), SF).count() == 0
