import random

import pytest
from braidwork.llm import blocks as B
from braidwork.llm import pieces as S

from .helpers import ODD, clashing, documents, sentence


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary.load()


def viterbi(vocabulary, text):
    best = dict(zip(vocabulary.pieces, zip(vocabulary.ids, vocabulary.scores)))
    longest, unknown = vocabulary.longest, vocabulary.unknown
    text = " " + text if text else ""
    done = [(0.0, [])]
    for e in range(1, len(text) + 1):
        ways = []
        for s in range(max(0, e - longest), e):
            part = text[s:e]
            if part in best:
                ways.append((done[s][0] + best[part][1], -s, done[s][1] + [best[part][0]]))
            elif e - s == 1:
                ways.append((done[s][0] + unknown, -s, done[s][1] + [vocabulary.byte_ids[b] for b in part.encode()]))
        top = max(ways, key=lambda w: (w[0], w[1]))
        top = min((w for w in ways if w[0] == top[0]), key=lambda w: -w[1])
        done.append((top[0], top[2]))
    return done[-1]


def score(vocabulary, ids):
    known = dict(zip(vocabulary.ids, vocabulary.scores))
    return sum(known.get(i, 0.0) for i in ids)


def test_encoding_is_the_best_split_of_the_whole_text(spark, vocabulary):
    rng = random.Random(2)
    texts = [" ".join(sentence(rng, rng.choice([0, 1, 5, 40]))) for _ in range(30)]
    texts += ["don't stop.\nNext line\tTab", "a  b   c ", "été über ▁ \U0001f600", "\n", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in S.encode(docs, vocabulary).collect():
        total, ids = viterbi(vocabulary, texts[row["id"]])
        assert row["round_trip"]
        assert S.decode(vocabulary.spellings(), row["ids"]) == texts[row["id"]]
        assert sum(i in set(vocabulary.byte_ids) for i in row["ids"]) == sum(i in set(vocabulary.byte_ids) for i in ids)
        assert score(vocabulary, row["ids"]) == pytest.approx(score(vocabulary, ids))


def test_odd_rows_round_trip(spark, vocabulary):
    got = S.encode(clashing(documents(spark)), vocabulary).collect()
    assert len(got) == len(ODD) and all(r["round_trip"] for r in got)
    assert sorted((str(r["id"]), len(r["ids"]) > 0) for r in got) == sorted((str(i), bool(t)) for i, t, *_ in ODD)
    assert S.encode(documents(spark, []), vocabulary).count() == 0


def test_blocks_and_hops_change_nothing(spark, vocabulary, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(sentence(rng, 40)) for _ in range(60)] + ["".join(rng.choice("ACGT") for _ in range(5000)), "\u6f22\u5b57" * 2500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = None
    for n, fan in ((3, 1024), (11, 2), (9, 4)):
        monkeypatch.setattr(S, "block_count", lambda rows, block_bytes: n)
        monkeypatch.setattr(B, "FAN", fan)
        got = {r["id"]: r["ids"] for r in S.encode(docs, vocabulary).collect()}
        want = want or got
        assert got == want and len(got) == len(texts)
    assert all(want[i] == viterbi(vocabulary, texts[i])[1] for i in (60, 61))


def test_long_runs_are_split_best_as_a_whole(spark, vocabulary):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(10)]
    texts += ["".join(sentence(rng, 25)) for _ in range(10)] + ["\u6f22\u5b57 and \u0939\u093f \u4eee\u540d " * 20, "x" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in S.encode(docs, vocabulary).collect():
        assert row["round_trip"]
        assert row["ids"] == viterbi(vocabulary, texts[row["id"]])[1]


def test_a_block_takes_little_memory():
    import tracemalloc

    rng = random.Random(3)
    joins = S.Vocabulary(("ab", "cd"), (0, 1), (0.0, 0.0), tuple(range(2, 258))).joins()
    text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(S.BLOCK_BYTES // 6)).encode()
    tracemalloc.start()
    S._Words([text[a : a + 3000] for a in range(0, len(text), 3000)], joins, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20


def test_a_block_that_asks_sorts_its_words_once_and_numbers_none(monkeypatch):
    joins = S.Vocabulary(("ab", "cd"), (0, 1), (0.0, 0.0), tuple(range(2, 258))).joins()
    texts = [b"ab cd ab", b"", b"cd x ab", "\u00e9 ab".encode()]
    numbered = S._Words(texts, joins)
    monkeypatch.setattr(S.np, "unique", None)
    asked = S._Words(texts, joins, 4)
    assert len(asked.words) == len(set(asked.words)) == numbered.number.max() + 1
    whole = b"".join(b" " + t for t in texts if t)
    assert b"".join(asked.words[k] for k in numbered.number) == whole
    assert (asked.bucket[1:] >= asked.bucket[:-1]).all()
