import random

import numpy as np
from braidwork.llm import vectors as V

from .helpers import union_find


def brute(rows, t=0.93):
    ok = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for k, (i, a, y) in enumerate(ok):
        for j, b, z in ok[k + 1 :]:
            if y == z and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= t:
                pairs.append((i, j))
    count = {i: 0 for i, *_ in rows}
    for i, j in pairs:
        count[i] += 1
        count[j] += 1
    root = union_find(pairs, [i for i, *_ in rows if i is not None])
    return {(i, count[i], root.get(i), i is not None and root[i] == i) for i, *_ in rows}


def clustered(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    while at < n:
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            v = centre + rng.normal(size=dim) * spread / np.sqrt(dim)
            rows.append((int(at), [float(x) for x in v], int(at % 3)))
            at += 1
    random.Random(seed).shuffle(rows)
    return rows


def test_links_and_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "PER_CELL", 200)
    monkeypatch.setattr(V, "BLOCK", 64)
    rows = clustered(600, 16, 3, 0.12)
    rows += [(5000, rows[0][1], rows[0][2]), (5001, rows[0][1], None), (5002, None, 1), (5003, [0.0] * 16, 1), (5004, [1.0] * 15 + [float("nan")], 1), (5005, [1.0] * 15 + [None], 1), (5006, [], 1), (5007, [1.0, 2.0], 1), (5008, [2.0, 4.0], 1), (5009, [float("inf")] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {tuple(r) for r in V.near_duplicates(frame).collect()}
    assert got == brute(rows)


def test_recall_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(V, "PER_CELL", 100)
    rows = clustered(900, 64, 5, 0.34)  # pairs about the threshold
    want = brute(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in V.near_duplicates(frame).collect()}
    links = {i: n for i, n, _, _ in want}
    assert sum(got[i]["n_links"] for i in got) >= 0.97 * sum(links.values()) > 0
    assert all(got[i]["n_links"] <= n + 1 for i, n in links.items())


def test_empty_and_null_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, node string, links string"
    assert V.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = V.near_duplicates(spark.createDataFrame([(None, [1.0], 1, "a", "b"), (3, None, None, "a", "b")], schema)).collect()
    assert {tuple(r) for r in got} == {(None, 0, None, False), (3, 0, 3, True)}
