import random

import numpy as np
import pytest
from braidwork.llm import quality as Q

from .helpers import ODD, clashing, documents, sentence


def corpus(n=400):
    rng, rows, labels = random.Random(12), [], []
    for i in range(n):
        words = sentence(rng, rng.randint(20, 80))
        good = rng.random() < 0.7
        text = " ".join(words) + "." if good else " | ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", f"s{i % 7}", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = Q.score(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: y for i, y, _ in labels}
    assert np.mean([r["keep"] == bool(truth[r["id"]]) for r in got]) >= 0.97


def test_posteriors_match_hand_computation(spark):
    logits = [(1, "a", "a/x", 2.0), (2, "a", "a/x", 1.0), (3, "a", "a/y", -1.0), (4, "b", "b/x", -2.0), (5, "b", "b/x", -1.5), (6, "c", "c/z", 3.0)]
    got = {r["id"]: r for r in Q.posteriors(spark.createDataFrame(logits, "id long, host string, path string, logit double")).collect()}
    p = {i: 1 / (1 + np.exp(-x)) for i, _, _, x in logits}
    hosts = {h: [p[i] for i, g, _, _ in logits if g == h] for h in "abc"}
    world = np.mean(list(p.values()))
    n = np.array([len(v) for v in hosts.values()], float)
    rate = np.array([np.mean(v) for v in hosts.values()])
    between = max(np.sum((rate - world) ** 2 * n - world * (1 - world)) / max(n.sum(), 1), 1e-6)
    k = min(max(world * (1 - world) / between - 1, 1), 1e6)
    for i, h, _, _ in logits:
        assert got[i]["host_posterior"] == pytest.approx((sum(hosts[h]) + k * world) / (len(hosts[h]) + k))
    assert min(p.values()) <= got[4]["path_posterior"] <= max(p.values())


def test_odd_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.score(clashing(documents(spark)), none).collect()
    assert len(got) == len(ODD) and all(abs(r["score"] - 0.5) < 1e-6 for r in got)
    assert Q.score(documents(spark, []), none).count() == 0
