import hashlib
import random

import numpy as np
from braidwork.llm import blocks as B
from braidwork.llm import suffixes as S

from .helpers import clashing, documents, sentence


def brute(rows, length):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            if i is not None:
                k = raw[p : p + length]
                first[k] = min(i, first.get(k, i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if i is not None and first[raw[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for q, g in enumerate(gone) if g and (not q or not gone[q - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, length=50):
    found = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length)
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_random_corpus_matches_brute_force(spark):
    rng, rows = random.Random(4), []
    shared = [" ".join(sentence(rng, 12)) for _ in range(5)]
    for i in range(80):
        parts = [" ".join(sentence(rng, rng.randint(0, 20))) for _ in range(2)]
        if rng.random() < 0.5:
            parts.insert(1, rng.choice(shared)[rng.randint(0, 9) :])
        rows.append((rng.randrange(200), " ".join(parts)))
    rows += [(300 + k, rows[k][1]) for k in range(10)] + [(None, rows[0][1]), (500, None), (501, ""), (502, "é" * 40), (503, "é" * 41)]
    assert run(spark, rows) == brute(rows, 50)


def test_periodic_and_self_repeating_texts(spark):
    rows = [(1, "ab" * 200), (2, "ba" * 30 + "x" * 100), (3, "x" * 49), (4, "x" * 50), (5, "x" * 300 + "ab" * 25), (5, "x" * 300), (6, "x" * 300)]
    assert run(spark, rows) == brute(rows, 50)


def test_equal_windows_are_the_equal_substrings():
    rng = random.Random(6)
    for _ in range(30):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 300)))
        length = 20
        text, head = S.equal_windows(np.frombuffer(data, np.uint8), length, 16)
        groups = {}
        for p in range(len(data) - length + 1):
            groups.setdefault(data[p : p + length], set()).add(p)
        want = {frozenset(g) for g in groups.values() if len(g) > 1}
        got = {frozenset(int(p) for p in part) for part in np.split(text, head[1:])} if len(text) else set()
        assert {frozenset(p for p in g if p + length <= len(data)) for g in got} - {frozenset()} >= want


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in documents(spark).collect()]
    got = sorted((tuple(r) for r in S.remove_repeats(clashing(documents(spark))).collect()), key=str)
    assert got == brute(rows, 50)
    assert S.remove_repeats(documents(spark, [])).count() == 0


def test_many_blocks_hops_and_crowded_anchors_match_brute_force(spark, monkeypatch):
    rng, rows = random.Random(14), []
    shared = [" ".join(sentence(rng, 12)) for _ in range(5)]
    for i in range(120):
        parts = [" ".join(sentence(rng, rng.randint(0, 12))), rng.choice(shared)[rng.randint(0, 9) :] if rng.random() < 0.6 else " " * rng.randint(16, 70), " ".join(sentence(rng, 4))]
        rows.append((rng.randrange(400), "".join(parts)))
    want = brute(rows, 50)
    for n, fan, crowd in ((9, 2, 4096), (5, 1024, 1), (11, 3, 4)):
        monkeypatch.setattr(S, "block_count", lambda rows: n)
        monkeypatch.setattr(B, "FAN", fan)
        monkeypatch.setattr(S, "CROWD", crowd)
        assert run(spark, rows) == want


def test_crowded_runs_are_cut_so_that_equal_windows_stay_together():
    rng = random.Random(3)
    data = np.frombuffer(b"".join(bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(20, 60))) + b" " * 20 for _ in range(60)), np.uint8)
    start, count, key, _ = S.runs(data, np.array([0, len(data)]), 50)
    run, at, n, second = S.cut_again(data, start, count, 50)
    assert sorted(x for a, k in zip(at, n) for x in range(a, a + k)) == sorted(x for a, k in zip(start, count) for x in range(a, a + k))
    blanks = np.bincount(np.unique(key, return_inverse=True)[1], weights=count).max()
    again = np.bincount(np.unique(np.stack((key[run], second)), axis=1, return_inverse=True)[1].reshape(-1), weights=n).max()
    assert again < blanks
