"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Words of a seed that a text and an item must share before they are tiled, and of the shortest tile.
SEED_WORDS, TILE_WORDS = 3, 3
COVERAGE = 0.8
#: Words of benchmark items sent to the tasks at once; more items are taken in several passes.
MOST_WORDS = 1_000_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(text: str) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Rolling:
    """Karp-Rabin hashes of all windows of a sequence, for any length, by prefix sums modulo 2**64."""

    def __init__(self, tokens: np.ndarray):
        mixed = tokens.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * _powers(_BASE, len(tokens)))))
        self.back = _powers(_BASE_INVERSE, len(tokens) + 1)

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.back[:n] if n > 0 else np.zeros(0, np.uint64)


def _starts(text: np.ndarray, item: np.ndarray, free_t: np.ndarray, free_i: np.ndarray, hashes_t: np.ndarray, hashes_i: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest matches of unmarked words of at least ``length``: places in text and item, and lengths."""
    none = np.zeros(0, np.int64)
    sums = [np.concatenate(([0], np.cumsum(free))) for free in (free_t, free_i)]
    at_t, at_i = (np.flatnonzero(c[length:] - c[:-length] == length) for c in sums)
    if not len(at_i) or not len(at_t):
        return none, none, none
    order = np.argsort(hashes_i[at_i], kind="stable")
    at_i, known = at_i[order], hashes_i[at_i][order]
    found_t, found_i = [none], [none]
    for a in range(0, len(at_t), 1 << 18):  # some places at a time: in a text of few words many windows are equal
        t = at_t[a : a + (1 << 18)]
        lo, hi = (np.searchsorted(known, hashes_t[t], side=s) for s in ("left", "right"))
        n = hi - lo
        t = np.repeat(t, n)
        i = at_i[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(t))]
        first = (t == 0) | (i == 0)
        first |= (text[t - 1] != item[i - 1]) | ~free_t[t - 1] | ~free_i[i - 1]
        found_t.append(t[first])
        found_i.append(i[first])
    t, i = np.concatenate(found_t), np.concatenate(found_i)
    size, active = np.zeros(len(t), np.int64), np.arange(len(t))
    while len(active):
        p, q = t[active] + size[active], i[active] + size[active]
        on = (p < len(text)) & (q < len(item))
        active, p, q = active[on], p[on], q[on]
        active = active[(text[p] == item[q]) & free_t[p] & free_i[q]]
        size[active] += 1
    real = size >= length
    return t[real], i[real], size[real]


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in text, place in item, length), longest first, no word in two tiles.

    Each round finds the matches of unmarked words of at least the search length by their window
    hashes, extends them, and marks them from the longest on. The search length starts at the item's
    length and halves down to ``least``; if a match is over twice as long, the round starts again there,
    and if a match met words marked in the same round, the round is repeated.
    """
    least = max(1, min(least, len(item)))
    roll_t, roll_i = _Rolling(text), _Rolling(item)
    free_t, free_i = np.ones(len(text), bool), np.ones(len(item), bool)
    found: list[tuple[int, int, int]] = []
    length = max(least, len(item))
    while True:
        t, i, n = _starts(text, item, free_t, free_i, roll_t.windows(length), roll_i.windows(length), length)
        if len(n) and n.max() > 2 * length:
            length = int(n.max())
            continue
        order, met, left = np.lexsort((t, i, -n)), False, int(free_i.sum())
        for k in order.tolist():
            if left < length:
                break
            a, b, m = int(t[k]), int(i[k]), int(n[k])
            if free_t[a : a + m].all() and free_i[b : b + m].all():
                free_t[a : a + m] = free_i[b : b + m] = False
                found.append((a, b, m))
                left -= m
            else:
                met = True
        if met and left >= length:
            continue
        if left < least or length == least:
            return found
        length = max(least, length // 2) if length > 2 * least else least


class _Items:
    """Benchmark items as word numbers, and the seeds by which texts are joined with them."""

    def __init__(self, items: Sequence[tuple[int, str]], seed: int):
        self.number: dict[str, int] = {}
        self.ids, self.tokens = [], []
        for i, text in items:
            if found := words(text):
                self.ids.append(i)
                self.tokens.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in found], np.int64))
        seeds: dict[int, dict[int, set[int]]] = {}
        self.windows = []
        for k, t in enumerate(self.tokens):
            n = min(seed, len(t))  # an item shorter than a seed is one
            self.windows.append(_Rolling(t).windows(n))
            for h in self.windows[-1].tolist():
                seeds.setdefault(n, {}).setdefault(h, set()).add(k)
        self.seeds = seeds

    def joined(self, tokens: np.ndarray, owner: np.ndarray, coverage: float) -> set[tuple[int, int]]:
        """Pairs of text and item whose shared seeds cover so much of the item. ``tokens`` of texts are parted by zeros."""
        shared: dict[tuple[int, int], set[int]] = {}
        if not len(tokens):
            return set()
        known = np.concatenate(([0], np.cumsum(tokens > 0)))
        roll = _Rolling(tokens)
        for n, seeds in self.seeds.items():
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            hashes = roll.windows(n)[at]
            hit = np.isin(hashes, np.fromiter(seeds, np.uint64, len(seeds)))
            for h, t in zip(hashes[hit].tolist(), owner[at[hit]].tolist()):
                for k in seeds[h]:
                    shared.setdefault((t, k), set()).add(h)
        return {(t, k) for (t, k), found in shared.items() if self._covered(k, found) >= coverage * len(self.tokens[k])}

    def _covered(self, k: int, found: set[int]) -> int:
        """Words of an item under the found seeds: as many as tiles that are no shorter than a seed can cover."""
        size = len(self.tokens[k]) - len(self.windows[k]) + 1
        under = np.zeros(len(self.tokens[k]), bool)
        hit = np.fromiter((h in found for h in self.windows[k].tolist()), bool, len(self.windows[k]))
        for o in range(size):
            under[o : o + len(hit)] |= hit
        return int(under.sum())


MATCHES = "array<struct<item_id:long,coverage:double,n_tiles:int,tiled_words:int,item_words:int>>"


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "matches", seed: int = SEED_WORDS, tile: int = TILE_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """All columns of ``docs`` and ``out_col``: the benchmark items that each whole text covers.

    A text that shares seeds of ``seed`` words, at most ``tile``, with an item is tiled against it if the
    seeds cover as much of the item as tiles must; the item is listed if
    tiles of at least ``tile`` words cover the share ``coverage`` of its words, in whatever order.
    Null texts are empty; items without words match nothing; rows of ``benchmark`` that repeat an id
    are separate items. Items go to the tasks in slices of at most ``MOST_WORDS`` words, one pass over
    the texts for each, so the benchmark's size is bounded nowhere. An existing ``out_col`` is replaced.
    """
    items = benchmark.select(F.col("item_id").cast("long"), text_or_empty("text")).orderBy("item_id", "text")
    columns = [c for c in docs.columns if c != out_col]
    rows = docs.select(*columns).withColumn(out_col, F.array().cast(MATCHES))
    for part in _slices(items):
        rows = _pass(rows, part, text_col, out_col, seed, tile, coverage)
    return rows


def _slices(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in lists of at most ``MOST_WORDS`` words, one list after the other: the driver holds one."""
    part, size = [], 0
    for i, text in items.toLocalIterator():
        n = len(text) // 2 + 1
        if part and size + n > MOST_WORDS:
            yield part
            part, size = [], 0
        part.append((i, text))
        size += n
    if part:
        yield part


def _pass(rows: DataFrame, part: list[tuple[int, str]], text_col: str, out_col: str, seed: int, tile: int, coverage: float) -> DataFrame:
    names = rows.columns
    at, to = names.index(text_col), names.index(out_col)
    shared = rows.sparkSession.sparkContext.broadcast(part)  # at most MOST_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(shared.value, min(seed, tile))
        get = items.number.get
        for batch in slices(batches):
            numbered = [np.fromiter(map(get, words(t), repeat(0)), np.int64) for t in batch.column(at).fill_null("").to_pylist()]
            gap = np.zeros(1, np.int64)
            size = np.array([len(n) + 1 for n in numbered], np.int64)
            pairs = items.joined(np.concatenate([x for n in numbered for x in (n, gap)]) if numbered else gap[:0], np.repeat(np.arange(len(size)), size), coverage)
            if not pairs:
                yield batch
                continue
            found = batch.column(to).to_pylist()
            for t, k in sorted(pairs):
                item = items.tokens[k]
                cover = tiles(numbered[t], item, tile)
                tiled = sum(n for _, _, n in cover)
                if tiled >= coverage * len(item):
                    found[t] = [*found[t], {"item_id": items.ids[k], "coverage": tiled / len(item), "n_tiles": len(cover), "tiled_words": tiled, "item_words": len(item)}]
            yield pa.RecordBatch.from_arrays([pa.array(found, batch.schema.field(to).type) if i == to else batch.column(i) for i in range(len(names))], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item."""
    return find(docs, benchmark, text_col, "__matches").where(F.size("__matches") == 0).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """``op8_tiling``: one row per document and benchmark item that it covers."""
    from .common import table

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
