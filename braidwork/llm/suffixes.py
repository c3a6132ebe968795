"""Exact substring deduplication with a Burrows-Wheeler transform and bounded interval expansion.

Strings that repeat share the anchor (the least hashed 16-gram) of each of their 50-byte windows. The
texts are cut into runs of windows with one anchor; runs whose anchor occurs in two documents meet in
buckets by anchor; those of an anchor that very many runs have are cut again by the next least hashed
16-gram of each window, and so spread. There a k-ordered suffix array and its BWT are made of the distinct runs, intervals
of common prefixes are extended backward, one byte and one value of the common prefix at a time, up to
the threshold, and each interval that is left is a set of equal windows; the least document of the set
goes back to where each window came from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Route, block_count, bucketed, objects, pack, unpack
from .common import text_or_empty

ANCHOR = 16
LONGEST_RUN = 64
#: The common prefix from which intervals are expanded; the sort has separated what differs before.
FROM = 16
#: Bytes of distinct runs in one suffix array; runs of one anchor are never parted.
INDEX_BYTES = 1 << 20
#: Runs of one anchor in the table from which on they are cut again.
CROWD = 4096


def _words(data: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros follow the end."""
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    return np.ndarray((len(data),), f"{order}u8", wide.tobytes(), strides=(1,)).astype(np.uint64)


def _gram_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of 16-grams, from the numbers of their halves."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(31))


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: start, number of windows, mixed anchor hash, text index."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none
    h = _words(data, "<")
    h = _gram_hash(h[: len(h) - ANCHOR + 1], h[8 : len(h) - ANCHOR + 9])
    width, span = length - ANCHOR + 1, 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if width > span:
        h = np.minimum(h[: span - width], h[width - span :])
    edge = np.zeros(len(data) + 1, np.int8)  # windows that would leave their text
    edge[np.maximum(offsets[1:] - length + 1, offsets[:-1])] += 1
    np.add.at(edge, offsets[1:], -1)
    inside = np.cumsum(edge[: len(h)], dtype=np.int8) <= 0
    change = np.empty(len(h), bool)
    change[0] = True
    np.not_equal(h[1:], h[:-1], out=change[1:])
    change[1:] |= ~inside[:-1]
    start = np.flatnonzero(change & inside)
    stop = np.append(np.flatnonzero(change | ~inside), len(h))
    count = stop[np.searchsorted(stop, start, side="right")] - start
    if (count > LONGEST_RUN).any():
        parts = -(-count // LONGEST_RUN)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, left = np.repeat(start, parts) + step * LONGEST_RUN, np.repeat(count, parts) - step * LONGEST_RUN
        count = np.minimum(left, LONGEST_RUN)
    return start, count, _mixed(h[start]), np.searchsorted(offsets, start, side="right") - 1


def cut_again(data: np.ndarray, start: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut where the least hashed 16-gram of the windows but for their anchor changes: run, start, windows, that hash.

    Equal windows have equal ones. Windows of one 16-gram over and over have none, and are all equal.
    """
    width, out = length - ANCHOR + 1, [[np.zeros(0, np.int64)] for _ in range(4)]
    for a in range(0, len(start), 2048):  # some runs at a time: all of their windows' 16-grams are looked at
        first, n = start[a : a + 2048], count[a : a + 2048]
        run = np.repeat(np.arange(len(n)), n)
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(run))
        need = n + width - 1  # 16-grams of a run
        slot = np.cumsum(need) - need
        place = np.repeat(first - slot, need) + np.arange(need.sum())
        halves = data[place[:, None] + np.arange(ANCHOR)].view("<u8").astype(np.uint64)
        h = _gram_hash(halves[:, 0], halves[:, 1])
        inside = np.repeat(slot, n) + at - np.repeat(first, n)
        near = h[inside[:, None] + np.arange(width)]
        near[near == near.min(1, keepdims=True)] = np.uint64(0xFFFFFFFFFFFFFFFF)
        second = near.min(1)
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (second[1:] != second[:-1])
        head = np.flatnonzero(new)
        for column, x in zip(out, (run[head] + a, at[head], np.diff(np.append(head, len(run))), second[head].view(np.int64))):
            column.append(x)
    run, at, n, second = (np.concatenate(x) for x in out)
    return run, at, n, second.view(np.uint64)


def suffix_order(data: np.ndarray, depth: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by at least ``depth`` bytes, by prefix doubling; the rank of each by ``start`` bytes."""
    key = _words(data, ">")
    order = np.argsort(key)
    key = key[order]
    n, known = len(data), 8
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    early = None
    while True:
        if known >= start and early is None:
            early = rank.copy()
        if known >= depth:
            return order, early
        single = new & np.append(new[1:], True)
        slot = np.flatnonzero(~single)
        at = order[slot]
        after = np.zeros(len(at), np.int64)
        far = at + known < n
        after[far] = rank[at[far] + known] + 1
        both = (rank[at] << 32) | after
        turn = np.argsort(both)
        both, at = both[turn], at[turn]
        order[slot] = at
        new[slot] = np.concatenate(([True], both[1:] != both[:-1])) if len(slot) else False
        rank[at] = slot[np.maximum.accumulate(np.where(new[slot], np.arange(len(slot)), 0))] if len(slot) else 0
        known *= 2


def equal_windows(data: np.ndarray, length: int, start: int = FROM) -> tuple[np.ndarray, np.ndarray]:
    """Text places whose next ``length`` bytes occur again, grouped; returns places and group heads.

    Intervals of suffixes with a common prefix of ``start`` bytes are extended backward breadth-first:
    the interval of a string gives, for each byte of the BWT in it, the interval of that byte and the
    string. Every level raises the common prefix by one; intervals of one suffix are dropped.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    order, early = suffix_order(data, length, start)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    order = order.astype(np.int32)
    letter = data[order]
    group = early[order]

    def several(at, new):
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(at)))
        keep = np.repeat(size > 1, size)
        return at[keep], np.repeat(at[head], size)[keep]

    at, low = several(np.arange(n, dtype=np.int32), np.concatenate(([True], group[1:] != group[:-1])))
    owner, seen = np.empty(n, np.int32), np.zeros(n, bool)
    for _ in range(start, length):
        text = order[at]
        some = text > 0
        back = place[text[some] - 1]  # from the interval of a string to those of byte + string
        owner[back] = low[some]
        seen[back] = True
        at = np.flatnonzero(seen).astype(np.int32)
        if not len(at):
            return none, none
        seen[at] = False
        own, byte = owner[at], letter[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]) | (byte[1:] != byte[:-1])
        at, low = several(at, new)
    return order[at].astype(np.int64), np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(at) else none


def least_ids(strings: Sequence[bytes], ids: np.ndarray, length: int) -> np.ndarray:
    """For every window of every string, in order, the least id among the strings that contain it."""
    size = np.array([len(s) for s in strings], np.int64)
    begin = np.cumsum(size) - size
    count = size - length + 1
    slot = np.cumsum(count) - count
    out = np.repeat(ids, count)
    data = np.frombuffer(b"".join(strings), np.uint8)
    text, head = equal_windows(data, length)
    if len(text):
        owner = np.searchsorted(begin, text, side="right") - 1
        whole = text + length <= begin[owner] + size[owner]
        value = np.where(whole, ids[owner], np.iinfo(np.int64).max)
        low = np.repeat(np.minimum.reduceat(value, head), np.diff(np.append(head, len(text))))
        out[(slot[owner] + text - begin[owner])[whole]] = low[whole]
    return out


class _Block:
    """The unique texts of one block with their runs, the same whenever it is read again."""

    def __init__(self, blobs, length: int):
        self.length = length
        self.ids, self.texts = unpack(blobs, unique=True)
        self.raw = b"".join(self.texts)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.texts]))).astype(np.int64)
        parts = []
        a = 0
        while a < len(self.texts):  # a few texts at a time, for the processor's cache
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + (1 << 18), side="right")) - 1)
            lo, hi = self.offsets[a], self.offsets[b]
            s, c, h, t = runs(np.frombuffer(self.raw, np.uint8, hi - lo, lo), self.offsets[a : b + 1] - lo, length)
            parts.append((s + lo, c, h, t + a))
            a = b
        self.start, self.count, self.hash, self.text = (np.concatenate(x) for x in zip(*parts))
        self.anchors, self.anchor = np.unique(self.hash, return_inverse=True)

    def several(self) -> np.ndarray:
        """For each anchor whether two texts of this block have it."""
        least, most = np.full(len(self.anchors), len(self.texts)), np.full(len(self.anchors), -1)
        np.minimum.at(least, self.anchor, self.text)
        np.maximum.at(most, self.anchor, self.text)
        return least != most

    def shared(self, marks: np.ndarray) -> "_Shared":
        """The runs of anchors that are marked, those of anchors marked 2 cut again, by the hash they meet under."""
        mark = marks[self.anchor]
        chosen = np.flatnonzero(mark == 1)
        start, count, key, text = self.start[chosen], self.count[chosen], self.hash[chosen], self.text[chosen]
        if len(many := np.flatnonzero(mark > 1)):
            run, at, n, second = cut_again(np.frombuffer(self.raw, np.uint8), self.start[many], self.count[many], self.length)
            run = many[run]
            key = np.concatenate((key, _mixed(self.hash[run] + second * np.uint64(0x9E3779B97F4A7C15))))
            start, count, text = np.concatenate((start, at)), np.concatenate((count, n)), np.concatenate((text, self.text[run]))
        order = np.argsort(key, kind="stable")
        start, count, key, text = start[order], count[order], key[order], text[order]
        strings: dict[bytes, int] = {}
        raw, extra = self.raw, self.length - 1
        which = [strings.setdefault(raw[a : a + n + extra], len(strings)) for a, n in zip(start.tolist(), count.tolist())]
        return _Shared(start, count, key, text, np.array(which, np.int64), list(strings))


@dataclass
class _Shared:
    """Runs by key: starts, windows, keys, texts, the number of each one's string, and the distinct strings."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    text: np.ndarray
    which: np.ndarray
    strings: list[bytes]


#: What is told of an anchor: tag, block, runs there, whether two texts there have it. Answered: bucket and tag as one, the mark.
_TOLD, _MARKS = ("u4", "u4", "u4", "u1"), ("u8", "u1")
#: A distinct run: its number in the block, block, tag, least id, bytes. Answered: that number, the least id of each window.
_SENT, _LEAST = ("u4", "u4", "u4", "i8", "O"), ("u4", "O")
_PARTS = "to int, sender int, blob binary"


def _rows(sent: list[tuple[int, bytes]], sender: int) -> pd.DataFrame:
    return pd.DataFrame({"to": [t for t, _ in sent], "sender": sender, "blob": [b for _, b in sent]})


def _announce(buckets: int, length: int):
    route = Route(buckets, _TOLD)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block, me = _Block(rows["blob"], length), int(rows["block"].iloc[0])
        place, tag = bucketed(block.anchors, buckets)
        return _rows(route.send(place, (tag, np.full(len(tag), me), np.bincount(block.anchor, minlength=len(tag)), block.several())), me)

    return run


def _repeated(buckets: int, crowd: int):
    """Which anchors of one bucket occur in two texts, for each block that has them: 1, or 2 if very many runs have it."""
    told, back = Route(buckets, _TOLD), Route(buckets, _MARKS)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        place, tag, block, times, here = told.received(rows["blob"])
        order = np.argsort(tag, kind="stable")
        tag, block, times, here = tag[order], block[order], times[order], here[order]
        head = np.flatnonzero(np.concatenate(([True], tag[1:] != tag[:-1])))
        size = np.diff(np.append(head, len(tag)))
        several = (size > 1) | (np.maximum.reduceat(here, head) > 0)
        mark = np.where(np.add.reduceat(times.astype(np.int64), head) > crowd, 2, 1)
        keep, mark = np.repeat(several, size), np.repeat(mark, size)
        me = int(place[0])
        code = (np.uint64(me) << np.uint64(32)) | tag[keep].astype(np.uint64)
        order = np.lexsort((code, block[keep]))
        return _rows(back.send(block[keep][order], (code[order], mark[keep][order])), me)

    return run


def _marks(block: _Block, blobs, buckets: int) -> np.ndarray:
    """The marks of a block's anchors; 0 for none."""
    _, codes, how = Route(buckets, _MARKS).received(blobs)
    order = np.argsort(codes)
    codes, how = codes[order], how[order]
    bucket, tag = bucketed(block.anchors, buckets)
    mine = (bucket.astype(np.uint64) << np.uint64(32)) | tag
    if not len(codes):
        return np.zeros(len(mine), np.uint8)
    slot = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
    return np.where(codes[slot] == mine, how[slot], 0)


def _ship(buckets: int, length: int):
    """The distinct runs of a block under repeated anchors, each with its least id."""
    route = Route(buckets, _SENT)

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return _rows([], 0)
        block, me = _Block(docs["blob"], length), int(docs["block"].iloc[0])
        shared = block.shared(_marks(block, answers["blob"], buckets))
        first = np.unique(shared.which, return_index=True)[1]
        low = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(low, shared.which, block.ids[shared.text])
        place, tag = bucketed(shared.key[first], buckets)
        n = np.arange(len(first))
        return _rows(route.send(place, (n, np.full(len(n), me), tag, low, objects(shared.strings))), me)

    return run


def _resolve(buckets: int, length: int):
    """The least id of every window of the runs in a bucket, for each block that shipped them."""
    sent, back = Route(buckets, _SENT), Route(buckets, _LEAST)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        place, seq, block, tag, low, text = sent.received(rows["blob"])
        me = int(place[0])
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(t, len(number)) for t in text], np.int64)
        strings = list(number)
        ids = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(ids, which, low)
        tags = np.zeros(len(strings), np.uint32)
        tags[which] = tag
        size = np.array([len(s) for s in strings], np.int64)
        slot = np.concatenate(([0], np.cumsum(size - length + 1)))
        value = np.repeat(ids, size - length + 1)
        order = np.argsort(tags, kind="stable")
        new = np.concatenate(([True], tags[order][1:] != tags[order][:-1]))
        alone = new & np.append(new[1:], True)  # a run that is its anchor's only one equals no other
        order, new = order[~alone], new[~alone]
        a = 0
        heads = np.append(np.flatnonzero(new), len(order))
        filled = np.concatenate(([0], np.cumsum(size[order])))
        while a < len(order):
            b = heads[max(np.searchsorted(filled[heads], filled[a] + INDEX_BYTES, side="right") - 1, np.searchsorted(heads, a, side="right"))]
            part = order[a:b]
            found = least_ids([strings[k] for k in part], ids[part], length)
            count = size[part] - length + 1
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            value[np.repeat(slot[part], count) + inner] = found
            a = b
        raw = value.tobytes()
        answers = [raw[8 * x : 8 * y] for x, y in zip(slot[:-1].tolist(), slot[1:].tolist())]
        order = np.lexsort((seq, block))
        return _rows(back.send(block[order], (seq[order], objects([answers[k] for k in which[order].tolist()]))), me)

    return run


def _cover(buckets: int, length: int):
    """Per unique text: what is removed, and the digest of what is kept."""
    columns = ["digest", "first_id", "n_removed", "n_spans", "kept_sha256"]

    def run(docs: pd.DataFrame, answers: pd.DataFrame, least: pd.DataFrame) -> pd.DataFrame:
        block = _Block(docs["blob"], length)
        shared = block.shared(_marks(block, answers["blob"], buckets))
        flag = np.zeros(len(block.raw) + 1, bool)
        if len(shared.which):
            _, seq, values = Route(buckets, _LEAST).received(least["blob"])
            value = np.frombuffer(b"".join(values[np.argsort(seq)]), np.int64)
            size = np.array([len(s) for s in shared.strings], np.int64) - length + 1
            slot = np.cumsum(size) - size
            count = size[shared.which]
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            smaller = value[np.repeat(slot[shared.which], count) + inner] < np.repeat(block.ids[shared.text], count)
            flag[(np.repeat(shared.start, count) + inner)[smaller]] = True
        total = np.concatenate((np.zeros(length, np.int32), np.cumsum(flag[:-1], dtype=np.int32)))
        gone = total[length:] > total[:-length]
        out = []
        data = np.frombuffer(block.raw, np.uint8)
        for i, text in enumerate(block.texts):
            a, b = block.offsets[i], block.offsets[i + 1]
            part = gone[a:b]
            removed = int(part.sum())
            spans = int(part[0]) + int((part[1:] & ~part[:-1]).sum()) if removed else 0
            digest = hashlib.sha256(text).hexdigest()
            kept = hashlib.sha256(data[a:b][~part].tobytes()).hexdigest() if removed else digest
            out.append((digest, int(block.ids[i]), removed, spans, kept))
        return pd.DataFrame(out, columns=columns)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_removed, n_spans, kept_sha256``.

    Removed is every byte covered by a ``length``-byte string that also starts in a row of smaller id;
    strings are judged on the input. Null text is empty; a row of null id loses nothing and takes
    nothing from others; rows that repeat an id take nothing from each other. Copies of a text are
    looked at once, under their smallest id, and lose everything if they are long enough.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    given = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"))
    long = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    n = block_count(long)
    dealt = pack(long, n, unique=True).repartition(n, "block")
    told = Route(n, _TOLD).deliver(dealt.groupBy("block").applyInPandas(_announce(n, length), _PARTS))
    marks = Route(n, _MARKS).deliver(told.groupBy("to").applyInPandas(_repeated(n, CROWD), _PARTS)).withColumnRenamed("to", "block")
    shipped = Route(n, _SENT).deliver(dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInPandas(_ship(n, length), _PARTS))
    least = Route(n, _LEAST).deliver(shipped.groupBy("to").applyInPandas(_resolve(n, length), _PARTS)).withColumnRenamed("to", "block")
    # Both kinds of answers reach the block's last pass as one table.
    back = marks.select("block", "blob", F.lit(True).alias("mark")).unionByName(least.select("block", "blob", F.lit(False).alias("mark")))
    last = _cover(n, length)

    def cover(docs: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame(columns=["digest", "first_id", "n_removed", "n_spans", "kept_sha256"])
        return last(docs, back[back["mark"]], back[~back["mark"]])

    found = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(cover, "digest string, first_id long, n_removed long, n_spans long, kept_sha256 string")
    both = given.join(found, "digest", "left")
    first = F.col("id") == F.col("first_id")
    copy = F.col("id") > F.col("first_id")
    return both.select(
        "id",
        "n_bytes",
        F.when(first, F.col("n_removed")).when(copy, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(first, F.col("n_spans")).when(copy, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(first, F.col("kept_sha256")).when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("digest")).alias("kept_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """``op5_suffix_dedup``: what every document keeps when strings seen in earlier ones are removed."""
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: Every 50-byte string of the table, as hex, with the least document that it starts in.
ORACLE_SQL = """
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select rid, doc_id, p, substr(h, 2 * p + 1, 100) as s from (select rid, doc_id, h, unnest(range(0, length(h) // 2 - 49)) as p from d where length(h) >= 100)),
m as (select s, min(doc_id) as least from w group by s),
f as (select w.rid, w.p from w join m using (s) where m.least < w.doc_id),
g as (select rid, p, sum(case when before is null or p > before + 50 then 1 else 0 end) over (partition by rid order by p) as k from (select rid, p, lag(p) over (partition by rid order by p) as before from f)),
spans as (select rid, k, min(p) as a, max(p) + 50 as b from g group by rid, k),
gaps as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as c from spans),
kept as (select d.rid, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as h from gaps join d using (rid) group by d.rid)
select d.doc_id, (length(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join kept using (rid)
"""
