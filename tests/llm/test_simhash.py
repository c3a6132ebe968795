import random

import numpy as np
from braidwork.llm import simhash as S
from xxhash import xxh64_intdigest

from .helpers import clashing, documents, sentence, union_find


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    values = sorted({p for _, p in prints})
    near = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 2]
    root = union_find(near, values)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return {(i, f"{p:016x}", least.get(root[p])) for i, p in prints}


def corpus():
    rng, rows = random.Random(3), []
    for i in range(120):
        base = sentence(rng, rng.choice([0, 1, 2, 3, 40, 200]))
        rows.append((i, " ".join(base)))
        if len(base) >= 40:
            for j in range(3):
                other = list(base)
                other[rng.randrange(len(other))] = "changed"
                rows.append((1000 + 3 * i + j, " ".join(other)))
    return rows + [(None, rows[4][1]), (None, "nothing like it at all here"), (5000, None)]


def test_components_match_brute_force(spark):
    rows = corpus()
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got.collect()} == components(rows)


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(9)
    values = {0}
    for centre in [rng.getrandbits(64) for _ in range(4)]:
        for _ in range(60):
            values.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * rng.randrange(2))
    values = sorted(values)
    root = union_find([(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 2], values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    back = dict(zip(signed, values))
    for most in (1, 3, 32, 10_000):
        edges = [(back[r["a"]], back[r["b"]]) for r in S.links(nodes, 2, most).collect()]
        assert all((a ^ b).bit_count() <= 2 or most < 10_000 for a, b in edges)
        found = union_find(edges, values)
        assert len({(found[v], root[v]) for v in values}) == len(set(root.values())) == len(set(found.values())), most


def test_other_distances_use_their_segments(spark):
    values = [0, 0b111, 0b1111 << 40, (1 << 63) | 1]
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    edges = S.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3)
    assert {frozenset((r["a"], r["b"])) for r in edges.collect()} == {frozenset((0, 7)), frozenset((0, signed[3])), frozenset((7, signed[3]))}


def test_keep_one_and_odd_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in S.keep_one(clashing(docs)).collect()]
    expected = {c for _, _, c in components(rows)}
    assert sorted(kept, key=str) == sorted(expected, key=str)
    assert S.near_duplicates(clashing(documents(spark))).count() == documents(spark).count()
    assert S.near_duplicates(documents(spark, [])).count() == 0


def test_an_id_with_texts_of_several_components_leaves_one_row_of_each(spark):
    rng = random.Random(21)
    a, b, c = (" ".join(sentence(rng, 60)) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (0, c), (5, c), (1, c)]
    got = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(0, c), (1, a), (1, b)])
