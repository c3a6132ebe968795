"""Quality scores: a document classifier with hierarchical empirical-Bayes site posteriors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, text_or_empty
from .toxicity import is_held_out

#: Bound of the labelled sample on which the classifier is fitted.
MOST_LABELLED = 20_000
N_FEATURES = 136
_CLIP = 12.0


def features(text: str) -> np.ndarray:
    """Shares of the ASCII bytes, and length, word, line and repetition statistics of a whole text."""
    raw = text.encode()
    out = np.zeros(N_FEATURES, np.float32)
    n = max(len(raw), 1)
    out[:128] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256)[:128] / n)
    words = text.split()
    w = max(len(words), 1)
    lines = text.split("\n")
    out[128] = np.log1p(len(raw))
    out[129] = np.log1p(len(words))
    out[130] = len(text) / n
    out[131] = len(set(words)) / w
    out[132] = sum(map(str.__eq__, words, words[1:])) / w
    out[133] = len(raw) / w / 10
    out[134] = len(set(lines)) / len(lines)
    out[135] = np.log1p(len(lines))
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on standardised features: centre, scale, weights with intercept."""
    if not len(y):
        return np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z = np.concatenate(((x - centre) / scale, np.ones((len(x), 1))), 1)
    u = np.zeros(z.shape[1])
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    u[-1] = np.log(mean / (1 - mean))
    shrink = np.full(len(u), ridge * len(y))
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ u, -_CLIP, _CLIP)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(shrink), z.T @ (p - y) + shrink * u)
        u -= step
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, u


def train(docs: DataFrame, labels: DataFrame):
    """Fit on at most ``MOST_LABELLED`` labelled rows that are not held out, the first by a hash of the id."""
    picked = (
        labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~is_held_out("id"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(MOST_LABELLED)
    )
    rows = docs.select(F.col("doc_id").alias("id"), text_or_empty("text").alias("text")).join(F.broadcast(picked), "id").select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [features(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["id", "y", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, y double, x binary").toPandas().sort_values(["id", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    return fit(x, got["y"].to_numpy())


def evidence(docs: DataFrame, model, host_col: str, path_cols: tuple[str, ...]) -> DataFrame:
    """``id, host, path, logit`` of every row; null text is empty, null sites are one site."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (host_col, *path_cols)]).alias("path"), text_or_empty("text").alias("text"))
    centre, scale, u = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(3).to_pylist()
            x = np.stack([features(t) for t in texts]).astype(np.float64) if texts else np.zeros((0, N_FEATURES))
            logit = np.clip(((x - centre) / scale) @ u[:-1] + u[-1], -_CLIP, _CLIP)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(logit)], ["id", "host", "path", "logit"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, logit double")


def _sigmoid(x):
    return 1 / (1 + F.exp(-x))


def _logit(p):
    return F.log(p / (1 - p))


def _concentration(sites: DataFrame, parent: str) -> DataFrame:
    """The method-of-moments concentration of site rates about their parents', with one row.

    The spread of the rates beyond what sampling explains sets how much a site is believed: with none
    left the concentration is large and every site takes its parent's rate.
    """
    spare = F.sum(F.pow(F.col("rate") - F.col(parent), 2) * F.col("n") - F.col(parent) * (1 - F.col(parent)))
    between = F.greatest(spare / F.greatest(F.sum("n"), F.lit(1.0)), F.lit(1e-6))
    within = F.avg(F.col(parent) * (1 - F.col(parent)))
    return sites.agg(F.least(F.greatest(within / between - 1, F.lit(1.0)), F.lit(1e6)).alias("k"))


def posteriors(found: DataFrame) -> DataFrame:
    """Every row of ``id, host, path, logit`` with the posteriors of its host and path and a score.

    Soft counts of good documents per path and host come from grouped sums. A host's posterior rate
    shrinks towards the global rate, a path's towards its host's, the more the fewer documents it has.
    The score adds to the document's own evidence how far its path, without this document, is from
    the global rate.
    """
    p = _sigmoid(F.col("logit"))
    paths = found.groupBy("host", "path").agg(F.sum(p).alias("good"), F.count("*").cast("double").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good_h"), F.sum("n").alias("n_h"))
    world = hosts.agg((F.sum("good_h") / F.sum("n_h")).alias("rate_w"))
    hosts = hosts.crossJoin(F.broadcast(world))  # one row
    hosts = hosts.crossJoin(F.broadcast(_concentration(hosts.select((F.col("good_h") / F.col("n_h")).alias("rate"), F.col("n_h").alias("n"), "rate_w"), "rate_w").withColumnRenamed("k", "k_h")))
    hosts = hosts.withColumn("host_posterior", (F.col("good_h") + F.col("k_h") * F.col("rate_w")) / (F.col("n_h") + F.col("k_h")))
    paths = paths.join(hosts, "host")
    spread = _concentration(paths.select((F.col("good") / F.col("n")).alias("rate"), "n", "host_posterior"), "host_posterior").withColumnRenamed("k", "k_p")
    paths = paths.crossJoin(F.broadcast(spread)).select("host", "path", "good", "n", "k_p", "host_posterior", "rate_w")
    both = found.join(paths, ["host", "path"])
    path = (F.col("good") + F.col("k_p") * F.col("host_posterior")) / (F.col("n") + F.col("k_p"))
    other = (F.col("good") - p + F.col("k_p") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("k_p"))
    bound = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    score = _sigmoid(F.col("logit") + _logit(bound(other)) - _logit(bound(F.col("rate_w"))))
    return both.select("id", "host", "path", p.alias("classifier"), "host_posterior", path.alias("path_posterior"), score.alias("score"))


def score(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_cols: tuple[str, ...] = ("lang",), threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``id, host, path, classifier, host_posterior, path_posterior, score, keep``.

    Without labelled rows every document's own evidence is even, and so is its score. Repeated rows
    count as often as they occur; an empty table gives no rows.
    """
    found = checkpointed(evidence(docs, train(docs, labels), host_col, path_cols))
    return posteriors(found).withColumn("keep", F.col("score") >= threshold)


def query(spark, sf_dir: str) -> DataFrame:
    """``op9_quality``: site posteriors, score and whether it is kept, for every document; its source is the host."""
    from .common import table

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
