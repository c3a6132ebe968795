"""Texts dealt into blocks of bounded size, compressed for the shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import partitions, tidy

#: Bytes of text in a block, on average.
BLOCK_BYTES = 12 << 20


def block_count(texts: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for a table: by its bytes, and at least the session's shuffle partitions."""
    total = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(partitions(texts.sparkSession), -(-total // block_bytes))


def squeeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def text_key(text: bytes) -> int:
    """32 bits of a text's hash."""
    return xxh64_intdigest(text) >> 32


def pack(docs: DataFrame, n_blocks: int, unique: bool = False) -> DataFrame:
    """Rows ``block, blob`` of the rows ``id, text`` (no nulls): the part of each Arrow batch in each block.

    The block is a hash of the id, or with ``unique`` of the text; then a text that repeats in the batch
    is kept once, under its smallest id, so that a text with very many copies stays small.
    With ``unique`` the block is ``text_key`` of the text modulo the blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            if unique:
                first: dict[bytes, int] = {}
                for i, t in zip(ids, texts):
                    if (old := first.get(t)) is None or i < old:
                        first[t] = i
                texts, ids = list(first), list(first.values())
                keys = [text_key(t) % n_blocks for t in texts]
            else:
                keys = [xxh64_intdigest(i.to_bytes(8, "little", signed=True)) % n_blocks for i in ids]
            found: dict[int, list[int]] = {}
            for row, key in enumerate(keys):
                found.setdefault(key, []).append(row)
            blocks, blobs = [], []
            for key, rows in found.items():
                head = np.array([len(rows), *(ids[r] for r in rows), *(len(texts[r]) for r in rows)], np.int64)
                blocks.append(key)
                blobs.append(squeeze(head.tobytes() + b"".join(texts[r] for r in rows)))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(blobs, pa.binary())], ["block", "blob"])
        tidy()

    return docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "block int, blob binary")


def unpack(blobs: Iterable[bytes], unique: bool = False) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a block, sorted, so that they are the same in whichever order the parts came."""
    rows: list[tuple[int, bytes]] = []
    for blob in blobs:
        raw = unsqueeze(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        head = np.frombuffer(raw, np.int64, 2 * n, 8)
        ends = 8 + 16 * n + np.cumsum(head[n:])
        rows += zip(head[:n].tolist(), (raw[b - s : b] for b, s in zip(ends.tolist(), head[n:].tolist())))
    if unique:
        first: dict[bytes, int] = {}
        for i, t in rows:
            if (old := first.get(t)) is None or i < old:
                first[t] = i
        rows = [(i, t) for t, i in first.items()]
    rows.sort()
    return np.array([i for i, _ in rows], np.int64), [t for _, t in rows]


def objects(items: list[bytes]) -> np.ndarray:
    """Strings of bytes as a column."""
    out = np.empty(len(items), object)
    out[:] = items
    return out


def freeze(columns: Sequence[np.ndarray]) -> bytes:
    """Columns of one length as compressed bytes by place; the second, most often sorted, as its steps.

    A column of objects has strings of bytes.
    """
    parts = [np.array([len(columns[0])], np.int64).tobytes()]
    for k, c in enumerate(columns):
        if c.dtype == object:
            parts += [np.array([len(x) for x in c], np.uint32).tobytes(), *c]
            continue
        if k == 1:
            c = np.diff(c, prepend=np.zeros(1, c.dtype))
        parts.append(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes())
    return squeeze(b"".join(parts))


def thaw(blobs: Iterable[bytes], dtypes: Sequence[str]) -> list[np.ndarray]:
    """The columns of frozen parts, one part after the other."""
    found: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in dtypes]
    for blob in blobs:
        raw = unsqueeze(blob)
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for k, t in enumerate(map(np.dtype, dtypes)):
            if t == object:
                ends = np.cumsum(np.frombuffer(raw, np.uint32, n, at), dtype=np.int64) + at + 4 * n
                found[k].append(objects([raw[a:b] for a, b in zip([at + 4 * n, *ends.tolist()], ends.tolist())]))
                at = int(ends[-1]) if n else at
                continue
            c = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n).T).view(t).reshape(-1)
            found[k].append(np.cumsum(c, dtype=t) if k == 1 else c)
            at += n * t.itemsize
    return [np.concatenate(c) for c in found]


def bucketed(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of hashes, by their first half, and 32 bits that tell those of a bucket apart; both ascend with the hashes."""
    high = (hashes >> np.uint64(32)) * np.uint64(buckets)
    rest = (high << np.uint64(32)) + (hashes & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)
    return (high >> np.uint64(32)).astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint32)


#: Parts into which a task cuts what it sends, at most.
FAN = 1024


class Route:
    """Records on their way from many tasks to ``n`` places, in as many hops as ``FAN`` parts a task need.

    A task cuts its records into at most ``fan`` ranges of places. Where there are more places, what
    ``fan`` tasks sent to a range meets in one task and is cut again. So the parts grow with the data
    and not with its square, and none gets small.
    """

    def __init__(self, n: int, dtypes: Sequence[str], fan: int | None = None):
        self.n, self.dtypes, self.fan = n, ["u4", *dtypes], fan or FAN
        self.widths = [n]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // self.fan))
        self.widths = self.widths[1:] or [1]

    def send(self, place: np.ndarray, columns: Sequence[np.ndarray], hop: int = 0) -> list[tuple[int, bytes]]:
        """Rows ``to, blob`` of records sorted by ``place`` and the first column."""
        if not len(place):
            return []
        to = np.asarray(place, np.int64) // self.widths[hop]
        cut = np.append(np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))), len(to)).tolist()
        every = [np.asarray(c, t) for c, t in zip((place, *columns), self.dtypes)]
        return [(int(to[a]), freeze([c[a:b] for c in every])) for a, b in zip(cut, cut[1:])]

    def deliver(self, rows: DataFrame) -> DataFrame:
        """Rows ``to, sender, blob`` at their places, from such rows as ``send`` makes them."""
        for hop in range(1, len(self.widths)):
            meet = rows.withColumn("sender", F.floor(F.col("sender") / self.fan).cast("int"))
            rows = meet.groupBy("to", "sender").applyInPandas(self._again(hop), "to int, sender int, blob binary")
        return rows

    def _again(self, hop: int):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            columns = self.received(part["blob"])
            order = np.lexsort((columns[1], columns[0]))
            columns = [c[order] for c in columns]
            out = self.send(columns[0], columns[1:], hop)
            return pd.DataFrame({"to": [t for t, _ in out], "sender": part["sender"].iloc[0], "blob": [b for _, b in out]})

        return run

    def received(self, blobs: Iterable[bytes]) -> list[np.ndarray]:
        """The records' places and columns."""
        return thaw(blobs, self.dtypes)
