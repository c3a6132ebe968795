"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A window of words is the bag of its character n-grams; the mean of their embeddings goes through a
linear softmax. Misspelt and obfuscated words share most n-grams with the words seen in training. A
document scores by its strongest windows, one for so many words, so that insults in a long text are
not averaged away while one chance likeness in it does not suffice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

ORDERS = (3, 4, 5, 6)
TABLE_BITS = 18
DIM = 4
WINDOW, STRIDE = 6, 3
#: A text is judged by its strongest windows: two for each so many words.
WORDS_PER_HIT = 100
#: Bounds of the training sample: rows of each class, and the longest text taken for training.
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 1500, 3500, 6000
SPACE = 0x20
#: A round of training ends when the mean log loss, of both classes alike, is less.
ENOUGH = 0.004


def is_held_out(doc_id: str | Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; such rows teach nothing. Null: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the table slot of the n-gram that starts one byte before each place, and whether it counts.

    ``data`` has spaces at both ends. An n-gram may begin or end with the space beside its word, but not
    hold one inside. Place ``i`` stands for the n-gram ``data[i:i + n]``, whose byte ``i + 1`` is in its word.
    """
    wide = data.astype(np.uint32)
    spaces = np.concatenate(([0], np.cumsum(data == SPACE, dtype=np.int32)))
    h = wide[:-1] * np.uint32(16777619) ^ wide[1:]
    for n in range(3, max(ORDERS) + 1):
        if len(data) < n:
            return
        h = h[: len(data) - n + 1] * np.uint32(16777619) ^ wide[n - 1 :]
        if n in ORDERS:
            mixed = (h + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
            yield mixed >> np.uint32(32 - TABLE_BITS), spaces[n - 1 : len(data)] == spaces[1 : len(data) - n + 2]


def _bytes(text: str) -> bytes:
    return text.lower().encode()


@dataclass
class _Words:
    """Texts joined as bytes with their words: byte ranges, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> "_Words":
        data = np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)
        data = np.where(data <= SPACE, SPACE, data).astype(np.uint8)
        gap = data == SPACE
        starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        begin = 1 + np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts])))
        return _Words(data, starts, ends, np.searchsorted(starts, begin))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last word (exclusive) of each window, and the first window of each text."""
        n = np.diff(self.first)
        count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
        head = np.concatenate(([0], np.cumsum(count)))
        text = np.repeat(np.arange(len(n)), count)
        a = self.first[text] + STRIDE * (np.arange(head[-1]) - head[text])
        return a, np.minimum(a + WINDOW, self.first[text + 1]), head

    def means(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows, and for each the mean over its n-grams of a value by table slot."""
        a, b, head = self.windows()
        if not len(a):
            return a, b, head, np.zeros(0)
        total, count = np.zeros(len(self.data)), np.zeros(len(self.data), np.int16)
        for slot, good in _grams(self.data):
            total[1 : len(slot) + 1] += np.where(good, table[slot], 0.0)
            count[1 : len(slot) + 1] += good
        total, count = np.cumsum(np.add.reduceat(total, self.starts)), np.cumsum(np.add.reduceat(count, self.starts, dtype=np.int64))
        total, count = np.concatenate(([0.0], total)), np.concatenate(([0], count))
        return a, b, head, (total[b] - total[a]) / np.maximum(count[b] - count[a], 1)

    def slots(self, a: int, b: int) -> np.ndarray:
        """Table slots of the n-grams of words ``a`` to ``b``."""
        part = self.data[self.starts[a] - 1 : self.ends[b - 1] + 1]
        return np.concatenate([slot[good] for slot, good in _grams(part)] or [np.zeros(0, np.uint32)])


def strongest(n_words: np.ndarray | int):
    """How many windows stand for a text of so many words."""
    return 2 * np.maximum(1, -(-n_words // WORDS_PER_HIT))


def pooled(words: _Words, table: np.ndarray) -> np.ndarray:
    """For each text the mean over its strongest windows; 0 without words."""
    _, _, head, mean = words.means(table)
    take = strongest(np.diff(words.first))
    out = np.zeros(len(head) - 1)
    for i in np.flatnonzero(np.diff(head)):
        part = mean[head[i] : head[i + 1]]
        k = min(int(take[i]), len(part))
        out[i] = part.mean() if k == len(part) else np.partition(part, len(part) - k)[len(part) - k :].mean()
    return out


@dataclass
class Model:
    """A value for each table slot: its embedding times the softmax's difference of class weights."""

    table: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, texts: list[bytes], block: int = 1 << 19) -> np.ndarray:
        """A score from 0 to 1 for each text; a text without words scores as one without any evidence."""
        out = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= block):
                size += len(texts[end])
                end += 1
            out[at:end] = pooled(_Words.of(texts[at:end]), self.table)
            at = end
        logit = self.slope * (out + self.bias) + self.offset
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _softmax_fit(bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray, state: dict, epochs: int, prior: np.ndarray) -> None:
    """Train embeddings and softmax together by full-batch Adam; ``state`` holds them between calls.

    An embedding begins where the softmax's difference gives its n-gram's value in ``prior``.
    """
    size = np.array([len(b) for b in bags])
    slots, at = np.unique(np.concatenate(bags), return_inverse=True)
    at, row = at.astype(np.int32), np.repeat(np.arange(len(bags), dtype=np.int32), size)
    head = np.concatenate(([0], np.cumsum(size)[:-1]))
    rng = np.random.default_rng(7)
    if "E" not in state:
        state["E"] = np.zeros((1 << TABLE_BITS, DIM), np.float32)
        state["new"] = np.ones(1 << TABLE_BITS, bool)
        state["W"], state["b"] = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    fresh = slots[state["new"][slots]]
    apart = state["W"][:, 1] - state["W"][:, 0]
    state["E"][fresh] = rng.normal(0, 0.1, (len(fresh), DIM)) + prior[fresh, None] * (apart / (apart @ apart))
    state["new"][fresh] = False
    E, W, b = state["E"][slots], state["W"], state["b"]
    target = np.eye(2, dtype=np.float32)[label]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (E, W, b)]
    for t in range(1, epochs + 1):
        mean = np.stack([np.add.reduceat(E[:, k][at], head) for k in range(DIM)], 1) / size[:, None]
        z = mean @ W + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        if -float(weight @ np.log(np.maximum(p[np.arange(len(label)), label], 1e-12))) < ENOUGH:
            break
        d = (p - target) * weight[:, None]
        back = (d @ W.T) / size[:, None]
        grads = (np.stack([np.bincount(at, back[:, k][row], len(slots)) for k in range(DIM)], 1) + 1e-7 * E, mean.T @ d + 1e-5 * W, d.sum(0))
        for param, grad, (m, v) in zip((E, W, b), grads, moments):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= (0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)).astype(np.float32)
    state["E"][slots], state["W"], state["b"] = E, W, b


def fit(texts: list[str], labels: np.ndarray, prior: float, rounds: int = 3, epochs: int = 120) -> Model:
    """Fit on labelled texts. ``prior`` is the share of toxic rows among all that may teach.

    Rounds alternate between choosing the windows that stand for each text, the strongest of a toxic
    one and the strongest of a clean one as hard negatives, and training on them. A fifth of the texts
    is left out of training and sets slope and offset of the final score.
    """
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        level = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros(1 << TABLE_BITS, np.float32), 0.0, 0.0, float(np.log(level / (1 - level))))
    words = [_Words.of([_bytes(t)]) for t in texts]
    kept_out = np.arange(len(texts)) % 5 == 4
    teach = [i for i in np.flatnonzero(~kept_out) if len(words[i].starts)]
    seen = np.zeros((2, 1 << TABLE_BITS), np.float32)
    for i in teach:
        seen[labels[i]][np.unique(words[i].slots(0, len(words[i].starts)))] += 1
    n = np.bincount(labels[teach], minlength=2)
    table = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    table[seen.sum(0) < 3] = 0
    prior_table = table
    state: dict = {}
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        bags, label = [], []
        for i in teach:
            a, b, _, mean = words[i].means(table)
            picked = np.argsort(-mean, kind="stable")[: int(strongest(len(words[i].starts))) if labels[i] else 3].tolist()
            spans = [(a[k], b[k]) for k in picked]
            if not labels[i]:  # any windows, and words by themselves, as in texts that repeat one word
                spans += [(a[k], b[k]) for k in rng.integers(len(a), size=4)]
                spans += [(k, k + 1) for k in rng.integers(len(words[i].starts), size=4)]
            for x, y in dict.fromkeys(spans):
                if len(slots := words[i].slots(x, y)):
                    bags.append(slots)
                    label.append(labels[i])
        label = np.array(label)
        share = np.bincount(label, minlength=2)
        _softmax_fit(bags, label, (0.5 / share[label]).astype(np.float32), state, epochs, prior_table)
        table = state["E"] @ (state["W"][:, 1] - state["W"][:, 0])
    model = Model(table.astype(np.float32), float(state["b"][1] - state["b"][0]), 1.0, 0.0)
    check = np.flatnonzero(kept_out)
    y = labels[check]
    if min(y.sum(), len(y) - y.sum()) >= 10:
        raw = np.log(np.clip(s := model.scores([_bytes(texts[i]) for i in check]), 1e-9, 1) / np.clip(1 - s, 1e-9, 1))
        weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum()))
        scale = max(float(np.std(raw)), 1e-6)
        u, x = np.zeros(2), np.stack([raw / scale, np.ones(len(raw))], 1)
        for _ in range(50):  # Newton steps of a two-parameter logistic regression with a little ridge
            p = 1 / (1 + np.exp(-np.clip(x @ u, -30, 30)))
            grad = x.T @ (weight * (p - y)) + 1e-3 * u
            u -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        if u[0] > 0:
            model.slope, model.offset = float(u[0] / scale), float(u[1])
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out.

    At most ``MOST_TOXIC`` and ``MOST_CLEAN`` rows, the first by a hash of the id, of those whose texts
    have at most ``MOST_CHARS`` characters. Rows with a null id or label teach nothing. Without rows of both classes
    the model scores every text by the one class's share, or 0 without any row.
    """
    usable = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out("id"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("id")
    short = docs.where(F.length(text_or_empty("text")) <= MOST_CHARS)
    usable = usable.join(short.select(F.col("doc_id").alias("id")), "id", "left_semi")
    picked = [usable.where(F.col("y") == y).orderBy(order, "id").limit(most) for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    chosen = picked[0].union(picked[1])  # bounded by the two parameters, so it may be broadcast
    rows = (
        short.select(F.col("doc_id").alias("id"), text_or_empty("text").alias("text"))
        .join(F.broadcast(chosen), "id")
        .select("id", "y", "text")
        .toPandas()
    )
    rows = rows.sort_values(["id", "y", "text"], ignore_index=True)
    total = sum(counts.values())
    return fit(rows["text"].tolist(), rows["y"].to_numpy(np.int64), counts.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and ``out_col``, the score of every whole text. Null text is empty.

    An existing ``out_col`` is replaced. The model is one table of fixed size, sent to each task.
    """
    rows = docs.drop(out_col).withColumn(out_col, F.lit(0.0))
    kept = [c for c in rows.columns if c != out_col]
    at = kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.slope, model.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value)
        for batch in slices(batches):
            texts = [_bytes(t) for t in batch.column(at).fill_null("").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(fitted.scores(texts))], names=[*kept, out_col])

    return rows.mapInArrow(run, rows.schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``."""
    columns = docs.columns
    return score(docs, train(docs, labels), out_col="__toxicity").where(F.col("__toxicity") < threshold).select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    """``op7_toxicity``: doc_id, held_out, score and predicted (score >= 0.7) for every document."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = score(docs, model).select("doc_id", is_held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
