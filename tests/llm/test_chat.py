import hashlib
import random

from braidwork.llm import chat as C
from hypothesis import given
from hypothesis import strategies as st

TEXT = st.lists(st.sampled_from([*C.CONTROLS, "\\", "<", "|", "im_end", ">", "s", "/", "[", "\n", "a", "é", "n"]), max_size=12).map("".join)


@given(TEXT, TEXT)
def test_turns_round_trip_and_hold_no_controls(role, text):
    template = C.Template()
    piece = template.turn(role, text)
    assert [(r, t) for r, t, _, _ in template.parse(piece)] == [(role, text)]
    body = template.escape(text)
    assert not any(c in body for c in C.CONTROLS)
    assert template.unescape(body) == text


def words(text):
    return len(text.split())


def rows():
    rng, out = random.Random(1), []
    for conv in range(40):
        turns = rng.choice([1, 2, 5, 30])
        for t in range(turns):
            role = "system" if t == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "tool"])
            out.append((conv, t, role, " ".join(rng.choice(["hi", "</s>", "[INST]", "<|im_end|>", "yes"]) for _ in range(rng.choice([0, 3, 20, 90])))))
    return out + [(100, 0, "assistant", None), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (101, None, None, "z"), (102, 1, "user", "b"), (102, 1, "user", "a"), (102, 1, "user", "a")]


def test_digests_read_back_every_turn_once(spark):
    data = rows()
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    windows = C.format_windows(frame, budget=60, history=2, counter=lambda: words)
    got = {r["conv_id"]: r for r in C.digests(windows).collect()}
    by = {}
    for conv, turn, role, text in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_keep_budget_system_and_history(spark):
    frame = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    template = C.Template()
    for w in C.format_windows(frame, budget=60, history=2, counter=lambda: words).collect():
        turns = template.parse(w["text"])
        assert len(turns) == w["n_repeated"] + w["n_new"]
        assert w["n_tokens"] == sum(words(template.turn(r, t)) for r, t, _, _ in turns)
        assert w["over_budget"] == (w["n_tokens"] > 60)
        if w["over_budget"]:
            assert w["n_new"] == 1
        if w["conv_id"] is not None and w["conv_id"] % 3 == 0 and w["conv_id"] < 40:
            assert turns[0][0] == "system"
        masked = turns[: w["n_repeated"]]
        assert len(masked) <= 3
        starts = {s["start"] for s in w["loss"]}
        assert not any(a in starts for _, _, a, _ in masked)


def test_the_public_vocabulary_counts(spark):
    count = C.bpe_counter()()
    assert count("hello world") == 2 and count("") == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.format_windows(empty)).count() == 0
