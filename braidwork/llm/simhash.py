"""SimHash near-duplicates through deletion variants of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, connected_components, partitions, slices, text_or_empty

BITS = 64
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text's word shingles; a text without words has zero."""
    words = text.lower().split()  # bytes: only A-Z change, only 0x20 and 0x09-0x0D separate
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per input row: ``id`` and the fingerprint as a signed long ``fp``. Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _variants(fp: Column, segments: int) -> Column:
    """Index keys: every segment with each of its bits in turn replaced by a wildcard."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    keys = []
    for lo, hi in zip(edges, edges[1:]):
        part = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < BITS else -1).cast("long"))
        for bit in range(hi - lo):
            masked = part.bitwiseAND(F.lit(~(1 << bit) if bit < 63 else (1 << 63) - 1).cast("long"))
            keys.append(F.struct(F.lit(lo + bit).cast("byte").alias("wild"), masked.alias("rest")))
    return F.array(*keys)


def _canonical(diff: np.ndarray, wild: np.ndarray, segments: int) -> np.ndarray:
    """Whether a pair with these differing bits is reported at this wildcard, to report it once only."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    at = np.full(len(diff), -1, np.int64)
    for lo, hi in zip(edges, edges[1:]):
        part = (diff >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        near = np.bitwise_count(part) <= 1
        bit = np.where(part == 0, 0, np.bitwise_count(part - np.minimum(part, np.uint64(1))))  # log2 of one set bit
        at = np.where((at < 0) & near, lo + bit, at)
    return at == wild


def _verified(distance: int, segments: int, most: int):
    """Scan rows sorted by key: pairs within ``distance`` of small buckets, members of larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wild, rest, fp = (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
        crowd = None  # the key of a bucket that is already known to be too large

        def out(a, b, alone):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((a, alone)).view(np.int64)), pa.array(np.concatenate((b, alone)).view(np.int64), mask=np.arange(len(a) + len(alone)) >= len(a))], ["a", "b"]
            )

        def solve(wild, rest, fp):
            new = np.flatnonzero(np.concatenate(([True], (wild[1:] != wild[:-1]) | (rest[1:] != rest[:-1]))))
            size = np.diff(np.append(new, len(fp)))
            big = np.repeat(size > most, size)
            alone = fp[big]
            wild, rest, fp = wild[~big], rest[~big], fp[~big]
            left, right = [], []
            for step in range(1, int(size[size <= most].max(initial=1))):
                same = (wild[step:] == wild[:-step]) & (rest[step:] == rest[:-step])
                at = np.flatnonzero(same)
                diff = fp[at] ^ fp[at + step]
                at = at[(np.bitwise_count(diff) <= distance) & _canonical(diff, wild[at], segments)]
                left.append(fp[at])
                right.append(fp[at + step])
            none = np.zeros(0, np.uint64)
            return out(np.concatenate([none, *left]), np.concatenate([none, *right]), alone)

        for batch in batches:
            if not batch.num_rows:
                continue
            w, r = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy()
            f = batch.column(2).to_numpy().view(np.uint64)
            if crowd is not None:  # go on with a bucket that is handed over member by member
                n = int(np.argmax(np.append((w != crowd[0]) | (r != crowd[1]), True)))
                if n:
                    yield out(f[:0], f[:0], f[:n])
                w, r, f = w[n:], r[n:], f[n:]
                if not len(f):
                    continue
                crowd = None
            wild, rest, fp = np.concatenate((wild, w)), np.concatenate((rest, r)), np.concatenate((fp, f))
            cut = len(fp) - int(((wild == wild[-1]) & (rest == rest[-1])).sum())
            if cut:
                yield solve(wild[:cut], rest[:cut], fp[:cut])
            wild, rest, fp = wild[cut:], rest[cut:], fp[cut:]
            if len(fp) > most:
                crowd = (wild[0], rest[0])
                yield out(fp[:0], fp[:0], fp)
                wild, rest, fp = wild[:0], rest[:0], fp[:0]
        if len(fp):
            yield solve(wild, rest, fp)

    return run


def links(nodes: DataFrame, distance: int = 2, most: int = 32) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints whose transitive closure is that of all links.

    ``nodes`` has one row per distinct fingerprint ``fp``. The 64 bits are cut into ``distance // 2 + 1``
    segments, so that of two linked fingerprints one segment differs in at most one bit; every
    fingerprint is indexed under its segments with one wildcard bit, equal keys meet, and pairs are
    verified. Buckets of over ``most`` fingerprints are not paired up: for ``distance`` 2 their members
    meet at the values one bit flip away, where any two that meet are linked and any two linked ones
    meet, so a star over each such ball of at most 65 values is exact. For other distances such
    buckets are paired by steps in sorted order instead.
    """
    segments = distance // 2 + 1
    most = most if distance == 2 else 1 << 62
    # A column of fingerprints is small, its index is not: it is dealt out before it is exploded.
    dealt = nodes.select("fp").repartition(partitions(nodes.sparkSession), F.xxhash64("fp"))
    index = dealt.select("fp", F.explode(_variants(F.col("fp"), segments)).alias("key")).select("key.wild", "key.rest", "fp")
    sorted_ = index.repartition("wild", "rest").sortWithinPartitions("wild", "rest", "fp")
    found = checkpointed(sorted_.mapInArrow(_verified(distance, segments, most), "a long, b long").distinct())
    pairs, crowded = found.where("b is not null"), found.where("b is null").select("a")
    if crowded.isEmpty():
        return pairs
    flips = F.array(F.col("a"), *[F.col("a").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)])
    balls = crowded.select("a", F.explode(flips).alias("z")).groupBy("z").agg(F.collect_list("a").alias("members")).where(F.size("members") > 1)
    star = balls.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a <> b")
    return pairs.union(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = 3) -> DataFrame:
    """One row per input row: ``id``, ``fp`` and ``component_id``, the smallest id reachable by links.

    Rows of equal fingerprints are one class, so copies are never expanded into pairs. Null text is
    empty; empty texts have fingerprint zero and link like any other. A null id takes part but is never
    a smallest id, so a component of null ids only has a null ``component_id``. Rows that repeat an id
    are kept. Only the two named columns are read, so extra columns can have any name.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(nodes.select("fp"), distance))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = labelled.join(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", F.col("root").alias("component"))
    return prints.join(component, "fp").select("id", "fp", "component_id", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay: for each component one row, that of its smallest id.

    An id that repeats with texts of several components stays once for each component whose smallest id
    it is. Of rows that repeat an id and a fingerprint one stays. In a component of null ids only, any one row stays.
    """
    classes = near_duplicates(docs, id_col, text_col, distance, shingle)
    chosen = classes.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min_by("fp", F.struct("id", "fp")).alias("fp"), F.min("id").alias("keep_id"))
    stay = checkpointed(chosen.select(F.col("keep_id").alias("__keep_id"), F.col("fp").alias("__keep_fp")))
    named = stay.where("__keep_id is not null")
    rows = docs.join(named.select("__keep_id").distinct(), docs[id_col] == F.col("__keep_id"), "left_semi")
    repeated = rows.groupBy(F.col(id_col).alias("__keep_id")).agg(F.count("*").alias("__times")).where("__times > 1").select("__keep_id")
    several = checkpointed(named.join(repeated, "__keep_id", "left_semi"))
    if several.isEmpty():
        kept = rows
    else:  # only rows whose id repeats are told apart by their fingerprints
        ids = several.select(F.col("__keep_id").alias("__id")).distinct()
        kept = rows.join(ids, rows[id_col] == F.col("__id"), "left_anti").unionByName(_rows(rows.join(ids, rows[id_col] == F.col("__id"), "left_semi"), several, id_col, text_col, shingle))
    if (unnamed := stay.where("__keep_id is null")).isEmpty():
        return kept
    return kept.unionByName(_rows(docs.where(F.col(id_col).isNull()), unnamed, id_col, text_col, shingle))


def _rows(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """One row of ``docs`` for each id, null or not, and fingerprint in ``stay``."""
    rows = checkpointed(docs.withColumn("__row", F.monotonically_increasing_id()))
    prints = fingerprints(rows, "__row", text_col, shingle).select(F.col("id").alias("__at"), F.col("fp").alias("__fp"))
    own = rows.select("__row", F.col(id_col).alias("__id")).join(prints, F.col("__row") == F.col("__at"))
    found = own.join(stay, F.col("__id").eqNullSafe(F.col("__keep_id")) & (F.col("__fp") == F.col("__keep_fp")))
    first = found.groupBy("__keep_id", "__keep_fp").agg(F.min("__row").alias("__first")).select("__first")
    return rows.join(first, F.col("__row") == F.col("__first"), "left_semi").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """``op6_simhash``: doc_id, fingerprint as 16 hex digits, component_id, for every document."""
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
