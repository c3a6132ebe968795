"""SentencePiece encoding as a relational lattice, and decoding.

The distinct words of the corpus are exploded into substrings of bounded length, joined with the piece
table, grouped by word, and folded by Viterbi with a higher-order aggregate. The encoded words then go
back to the blocks of documents that asked for them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Route, block_count, objects, pack, unpack
from .common import text_or_empty, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Longer words have no lattice of their own in the join; they are folded whole where they are asked for.
MOST_CHARS = 48
#: The piece table is broadcast; a vocabulary of more pieces is refused.
MOST_PIECES = 2_000_000
#: How much worse than the worst piece a character is that has none and is spelt in bytes.
UNKNOWN_PENALTY = 10.0
#: Bytes of text in a block; beside the text a task holds its words and ids.
BLOCK_BYTES = 3 << 20
_NO_ID = -(1 << 63)
#: Characters from this code on are not told apart when texts are cut into words.
_HIGH = 2048


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with a space for the word mark, their ids and scores, and the ids of the 256 bytes."""

    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]

    @staticmethod
    def load(path: str = MODEL) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, ids, scores, by_byte = [], [], [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                by_byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append(piece.replace("▁", " "))
                ids.append(i)
                scores.append(float(model.get_score(i)))
        if len(by_byte) != 256 or len(pieces) > MOST_PIECES:
            raise ValueError(f"{len(pieces)} pieces and {len(by_byte)} byte pieces: not a usable vocabulary")
        return Vocabulary(tuple(pieces), tuple(ids), tuple(scores), tuple(by_byte[b] for b in range(256)))

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @property
    def unknown(self) -> float:
        return min(self.scores, default=0.0) - UNKNOWN_PENALTY

    def joins(self) -> bytes:
        """Packed flags: whether some piece has one character next to another; from code ``_HIGH`` on always."""
        flags = np.zeros((_HIGH + 1, _HIGH + 1), bool)
        flags[_HIGH, :] = flags[:, _HIGH] = True
        codes = [np.minimum(np.frombuffer(p.encode("utf-32-le"), np.uint32), _HIGH) for p in self.pieces if len(p) > 1]
        flags[np.concatenate([c[:-1] for c in codes]), np.concatenate([c[1:] for c in codes])] = True
        return np.packbits(flags).tobytes()

    def spell(self) -> Callable[[str, list[int]], list[int]]:
        """Replaces ids of -1, each for one character without a piece, by the ids of its bytes."""
        size = {i: len(p) for i, p in zip(self.ids, self.pieces)}

        def run(word: str, ids: list[int]) -> list[int]:
            out, at = [], 0
            for i in ids:
                if i < 0:
                    out += [self.byte_ids[b] for b in word[at].encode()]
                else:
                    out.append(i)
                at += size.get(i, 1)
            return out

        return run

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame({"piece": self.pieces, "piece_id": self.ids, "score": self.scores}), "piece string, piece_id int, score double")

    def spellings(self) -> list[bytes]:
        """The bytes of every id."""
        out = [b""] * (max((*self.ids, *self.byte_ids)) + 1)
        for i, p in zip(self.ids, self.pieces):
            out[i] = p.encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


def _flags(joins: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(joins, np.uint8), count=(_HIGH + 1) ** 2).view(bool)


def _cut(text: str, flags: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text, and where its words begin, and end, the last of them.

    A word ends where no piece has the two characters side by side, so no piece spans two words and the
    best splits of the words make up the best split of the text; and before every place in ``heads``.
    """
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = np.minimum(code, _HIGH).astype(np.int32)
    apart = np.empty(len(code) + 1, bool)
    apart[0] = apart[-1] = True
    np.logical_not(flags[low[:-1] * (_HIGH + 1) + low[1:]], out=apart[1:-1])
    apart[heads] = True
    cuts = np.flatnonzero(apart)
    return code, cuts


def decode(spellings: list[bytes], ids) -> str:
    """The text of a sequence of ids."""
    return b"".join(map(spellings.__getitem__, ids))[1:].decode("utf-8", "replace")


def folder(vocabulary: Vocabulary) -> Callable[[str], list[int]]:
    """The split that ``encode_words`` gives a word, in time and memory that grow with its length."""
    best = dict(zip(vocabulary.pieces, zip(vocabulary.scores, vocabulary.ids)))
    longest, unknown = vocabulary.longest, (vocabulary.unknown, -1)

    def run(word: str) -> list[int]:
        score, come, ids = [0.0], [0], [0]
        for e in range(1, len(word) + 1):
            top = None
            for s in range(max(0, e - longest), e):  # the longer last piece first
                edge = best.get(word[s:e], unknown if s == e - 1 else None)
                if edge is not None and (top is None or score[s] + edge[0] > top):
                    top, start, piece = score[s] + edge[0], s, edge[1]
            score.append(top)
            come.append(start)
            ids.append(piece)
        out, e = [], len(word)
        while e:
            out.append(ids[e])
            e = come[e]
        return out[::-1]

    return run


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``ids`` for every row of ``bucket, word``; words are distinct, not null and not empty.

    The split of a word into pieces with the highest sum of scores; among equal ones that with the
    longer last piece. The id of a character without a piece is -1. Given rows partitioned by
    ``bucket``, nothing is shuffled: the piece table, of bounded size, is broadcast.
    """
    pieces = F.broadcast(vocabulary.table(words.sparkSession).select("*", F.xxhash64("piece").alias("key")))
    size = F.length("word")
    # By end, then start, as the lattice wants them, so that sorting it finds them in order.
    ends = words.select("bucket", "word", F.explode(F.sequence(F.lit(1), size)).alias("e"))
    spans = ends.select("bucket", "word", "e", F.explode(F.sequence(F.greatest(F.lit(0), F.col("e") - vocabulary.longest), F.col("e") - 1)).alias("s"))
    cut = spans.withColumn("n", F.col("e") - F.col("s")).withColumn("part", F.substring("word", F.col("s") + 1, F.col("n")))
    known = F.col("piece_id").isNotNull()
    edge = F.struct("e", "s", F.coalesce("score", F.lit(vocabulary.unknown)).alias("score"), F.coalesce("piece_id", F.lit(-1)).alias("id"))
    edges = (
        cut.join(pieces, (F.xxhash64("part") == F.col("key")) & (F.col("part") == F.col("piece")), "left")
        .where(known | (F.col("n") == 1))
        .select("bucket", "word", edge.alias("edge"))
    )
    # The word first: the aggregate sorts by the first bytes of its first key, and a task has few buckets.
    lattice = edges.groupBy("word", "bucket").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    # Edges come by end, then start: done[i] is the best way to the i-th character.
    best = F.expr("""
        aggregate(edges,
          array(named_struct('score', 0D, 'ids', cast(array() as array<int>))),
          (done, x) -> case
            when size(done) = x.e then concat(done, array(named_struct('score', done[x.s].score + x.score, 'ids', concat(done[x.s].ids, array(x.id)))))
            when done[x.s].score + x.score > done[x.e].score
              then concat(slice(done, 1, x.e), array(named_struct('score', done[x.s].score + x.score, 'ids', concat(done[x.s].ids, array(x.id)))))
            else done end,
          done -> element_at(done, -1).ids)
    """)
    return lattice.select("bucket", "word", best.alias("ids"))


_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, np.uint64(_BASE)), np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class _Words:
    """The words of a block's texts: distinct ones by a 64-bit hash, or the number of each occurrence.

    A collision of two words of one block would show as a failed round trip. Without ``buckets`` the
    numbers are told, and the words are not kept; with them the words, and no numbers.
    """

    def __init__(self, texts: list[bytes], joins: bytes, buckets: int | None = None):
        flags, powers = _flags(joins), _powers(1 << 19)
        whole = b"".join(b" " + t for t in texts if t).decode()
        size = np.fromiter((len(t.decode()) + 1 if t else 0 for t in texts), np.int64, len(texts))
        heads = np.concatenate(([0], np.cumsum(size)))
        hashes, begins, a = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], 0
        while a < len(texts):  # a few texts at a time, for the processor's cache
            b = max(a + 1, int(np.searchsorted(heads, heads[a] + (1 << 18), side="right")) - 1)
            lo, hi = int(heads[a]), int(heads[b])
            if hi > lo:
                code, cuts = _cut(whole[lo:hi], flags, heads[a:b] - lo)
                if len(code) > len(powers[0]):
                    powers = _powers(2 * len(code))
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * powers[0][: len(code)])))
                h = (sums[cuts[1:]] - sums[cuts[:-1]]) * powers[1][cuts[:-1]]
                h *= np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
                hashes.append(h * np.uint64(0xD6E8FEB86659FD93))
                begins.append((cuts[:-1] + lo).astype(np.int32))
            a = b
        del flags, powers
        begins, hashes = np.concatenate(begins), np.concatenate(hashes)
        self.first = np.searchsorted(begins, heads)
        if buckets is None:
            del whole, begins
            self.number = np.unique(hashes, return_inverse=True)[1].astype(np.int32)
            return
        first = np.argsort(hashes)  # any occurrence of a word will do
        hashes = hashes[first]
        new = np.ones(len(hashes), bool)
        np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
        distinct, first = hashes[new], first[new]
        del hashes, new
        ends = np.append(begins[1:], np.int32(len(whole)))
        self.words = [whole[x:y].encode() for x, y in zip(begins[first].tolist(), ends[first].tolist())]
        self.bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # ascends with the words


#: A word asked for: its number in the block, block, bytes. Answered: that number, the ids' bytes.
_ASKED, _ANSWERS = ("u4", "u4", "O"), ("u4", "O")


def _ask(joins: bytes, buckets: int):
    route = Route(buckets, _ASKED)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        me = int(rows["block"].iloc[0])
        words = _Words(unpack(rows["blob"])[1], joins, buckets)
        n = len(words.words)
        sent = route.send(words.bucket, (np.arange(n), np.full(n, me), objects(words.words)))
        del words
        tidy()
        return pd.DataFrame({"to": [t for t, _ in sent], "sender": me, "blob": [b for _, b in sent]})

    return run


def _distinct(buckets: int):
    route = Route(buckets, _ASKED)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = set().union(*(route.received([blob])[3].tolist() for blob in rows["blob"]))
        out = pd.DataFrame({"bucket": np.int32(rows["bucket"].iloc[0]), "word": [t for w in found if len(t := w.decode()) <= MOST_CHARS]})
        del found
        tidy()
        return out

    return run


def _answer(vocabulary: Vocabulary, buckets: int):
    spell, fold = vocabulary.spell(), folder(vocabulary)
    asked_for, back = Route(buckets, _ASKED), Route(buckets, _ANSWERS)

    def run(asked: pd.DataFrame, encoded: pd.DataFrame) -> pd.DataFrame:
        ids = {w.encode(): np.asarray(spell(w, i.tolist()) if i.min() < 0 else i, np.int32).tobytes() for w, i in zip(encoded["word"], encoded["ids"])}
        bucket, seq, block, words = asked_for.received(asked["blob"])
        order = np.lexsort((seq, block))
        found = []
        for w in words[order].tolist():
            if w not in ids:  # a long word
                ids[w] = np.array(spell(t := w.decode(), fold(t)), np.int32).tobytes()
            found.append(ids[w])
        sent = back.send(block[order], (seq[order], objects(found)))
        del ids, found
        tidy()
        return pd.DataFrame({"to": [t for t, _ in sent], "sender": int(bucket[0]) if len(bucket) else 0, "blob": [b for _, b in sent]})

    return run


_FILLED = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("round_trip", pa.bool_())])


def _fill(vocabulary: Vocabulary, buckets: int):
    joins, spellings, schema, route = vocabulary.joins(), vocabulary.spellings(), _FILLED, Route(buckets, _ANSWERS)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        row_ids, texts = unpack(docs["blob"].to_pylist())
        words = _Words(texts, joins)
        _, seq, found = route.received(answers["blob"].to_pylist())
        found = found[np.argsort(seq)].tolist()
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        del seq, found
        begin = (np.cumsum(size) - size).astype(np.int32)
        spelt = np.array([len(x) for x in spellings], np.int32)
        parts, counts, same, a = [np.zeros(0, np.int32)], [], [], 0
        while a < len(texts):  # some texts at a time, to hold little beside the result
            b = max(a + 1, int(np.searchsorted(words.first, words.first[a] + (1 << 17), side="right")) - 1)
            which = words.number[words.first[a] : words.first[b]]
            n = size[which]
            stop = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
            part = flat[np.arange(stop[-1]) + np.repeat(begin[which] - stop[:-1], n)]
            edge = stop[words.first[a : b + 1] - words.first[a]]
            expect = [b" " + t if t else t for t in texts[a:b]]
            length = np.concatenate(([0], np.cumsum(spelt[part], dtype=np.int64)))[edge]
            good = np.diff(length) == np.array([len(x) for x in expect])
            if b"".join(map(spellings.__getitem__, part.tolist())) != b"".join(expect):
                good = np.array([b"".join(map(spellings.__getitem__, part[x:y].tolist())) == e for x, y, e in zip(edge, edge[1:], expect)])
            parts.append(part)
            counts.append(np.diff(edge))
            same.append(good)
            a = b
        count = np.concatenate(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(np.concatenate(parts)))
        n_words = np.diff(words.first)
        del words, texts, parts, flat
        tidy()
        return pa.table([pa.array(row_ids, mask=row_ids == _NO_ID), lists, pa.array(count, pa.int64()), pa.array(n_words, pa.int64()), pa.array(np.concatenate(same))], schema=schema)

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, ids, n_tokens, n_words, round_trip``.

    ``round_trip`` says whether decoding the ids gives the text again. Null text is empty and has no
    tokens; null ids and repeated rows are kept. Words of any length are encoded
    whole; a character without a piece is spelt in byte pieces. Ids are longs; the least long is reserved.

    Documents are shuffled once, compressed, by blocks; each block asks the bucket of each of its
    distinct words for its pieces, so the lattice is built once per distinct word of the corpus.
    """
    vocabulary = vocabulary or Vocabulary.load()
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), text_or_empty(text_col).alias("text"))
    n = block_count(rows, block_bytes=BLOCK_BYTES)
    dealt = pack(rows, n).repartition(n, "block")
    parts = "to int, sender int, blob binary"
    asked = Route(n, _ASKED).deliver(dealt.groupBy("block").applyInPandas(_ask(vocabulary.joins(), n), parts)).withColumnRenamed("to", "bucket").repartition(n, "bucket")
    words = asked.groupBy("bucket").applyInPandas(_distinct(n), "bucket int, word string").repartition(n, "bucket")
    encoded = encode_words(words, vocabulary)
    answers = asked.groupBy("bucket").cogroup(encoded.groupBy("bucket")).applyInPandas(_answer(vocabulary, n), parts)
    answers = Route(n, _ANSWERS).deliver(answers).withColumnRenamed("to", "block")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _fill(vocabulary, n), "id long, ids array<int>, n_tokens long, n_words long, round_trip boolean"
    )


def query(spark, sf_dir: str) -> DataFrame:
    """``op3_sentencepiece``: the pieces of every document, and whether they decode to its text."""
    from .common import table

    return encode(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
