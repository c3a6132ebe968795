import random
import time

import numpy as np
from braidwork.llm import tiling as T

from .helpers import clashing, documents, sentence


def brute(a, b, least):
    free_a, free_b, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -j, -i))
        if best[0] < least:
            return total
        n, j, i = best[0], -best[1], -best[2]
        for q in range(n):
            free_a[i + q] = free_b[j + q] = False
        total += n


def test_tiles_cover_as_much_as_plain_greedy_tiling():
    rng = random.Random(0)
    for _ in range(150):
        b = [rng.randint(1, 6) for _ in range(rng.randint(1, 14))]
        a = [rng.randint(1, 6) for _ in range(rng.randint(0, 30))]
        found = T.tiles(np.array(a, np.int64), np.array(b, np.int64), 3)
        assert sum(n for _, _, n in found) == brute(a, b, min(3, len(b)))
        assert all(a[t : t + n] == b[i : i + n] for t, i, n in found)


def test_reordered_and_whole_passages_are_caught_and_clean_ones_kept(spark, monkeypatch):
    rng = random.Random(1)
    items = [sentence(rng, n) for n in (3, 20, 40, 60)]
    bench = [(k, " ".join(w)) for k, w in enumerate(items)] + [(9, None), (10, ""), (None, "x y z q w e r")]
    rows = [(i, " ".join(sentence(rng, 300))) for i in range(20)]
    lead = " ".join(sentence(rng, 30))
    rows += [(100 + k, f"{lead} {' '.join(w).upper()}, and more") for k, w in enumerate(items)]
    swapped = items[3][40:] + items[3][20:40] + items[3][:20]
    rows += [(200, " ".join(swapped)), (201, " ".join(items[3][:30])), (202, None), (None, " ".join(items[2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(bench, "item_id long, text string")
    want = {(100 + k, k) for k in range(4)} | {(200, 3), (None, 2)}
    for most in (T.MOST_WORDS, 30):  # one slice of items, and several
        monkeypatch.setattr(T, "MOST_WORDS", most)
        got = T.find(clashing(docs), table, out_col="m").where("size(m) > 0").collect()
        assert {(r["doc_id"], x["item_id"]) for r in got for x in r["m"]} == want
    kept = {r["doc_id"] for r in T.decontaminate(docs, table).collect()}
    assert kept == {i for i, _ in rows if i not in {a for a, _ in want}}


def test_odd_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert T.decontaminate(documents(spark), none).count() == documents(spark).count()
    assert T.find(documents(spark, []), none).count() == 0


def test_batches_with_and_without_matches_share_a_schema(spark):
    item = "one two three four five six seven"
    rows = [(i, f"{i} {item}" if i % 1500 == 1499 else f"nothing {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = T.find(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).where("size(matches) > 0")
    assert sorted(r["doc_id"] for r in got.collect()) == [1499, 2999, 4499, 5999]


def test_items_in_parts_of_three_and_four_words_are_caught(spark):
    rng = random.Random(6)
    a, b = sentence(rng, 7), sentence(rng, 20)
    parts = [b[i : i + 4] for i in range(0, 20, 4)]
    rows = [(1, " ".join(a[3:] + a[:3])), (2, " ".join(w for p in parts[::-1] for w in [*p, "between"])), (3, " ".join(a[:3] + ["x"] + b[:15]))]
    table = spark.createDataFrame([(0, " ".join(a)), (1, " ".join(b))], "item_id long, text string")
    got = T.find(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()
    assert {(r["doc_id"], m["item_id"], m["coverage"]) for r in got for m in r["matches"]} == {(1, 0, 1.0), (2, 1, 1.0)}


def test_query_matches_brute_force_on_random_reorderings(spark):
    rng = random.Random(9)
    items = [sentence(rng, rng.randint(1, 30)) for _ in range(25)]
    rows = []
    for i in range(160):
        words = sentence(rng, rng.randint(0, 12))
        for _ in range(rng.randint(0, 2)):
            item, parts = rng.choice(items), []
            while item:
                n = rng.randint(2, 6)
                parts.append(item[:n])
                item = item[n:]
            rng.shuffle(parts)
            if rng.random() < 0.4:
                parts.pop()
            words += [w for p in parts for w in [*p, *sentence(rng, rng.randint(0, 2))]]
        rows.append((i, " ".join(words)))
    bench = [(k, " ".join(w)) for k, w in enumerate(items)]
    found = T.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(r["doc_id"], m["item_id"]): m["tiled_words"] for r in found for m in r["matches"]}
    want = {(i, k): n for i, t in rows for k, w in enumerate(items) if (n := brute(t.split(), w, min(3, len(w)))) >= 0.8 * len(w)}
    assert got == want and len(want) > 40


def test_words_over_and_over_take_little_time():
    text, item = np.tile([1, 2, 3], 100_000), np.tile([1, 2, 3], 22)[:65]
    began = time.perf_counter()
    found = T.tiles(text, item, 3)
    assert sum(n for _, _, n in found) == 65 and time.perf_counter() - began < 20
