"""Small fixtures and brute-force versions for the text operators' tests."""

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "ren", "sto", "vu", "be", "dar", "qui", "ze") for b in ("n", "ra", "t", "li", "mo", "s", "ka", "pel")]


def sentence(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]


#: Rows that every operator must take: nulls, empty and long texts, odd characters, repeated rows.
ODD = [
    (1, "a plain text of a few words", "en", "s1", 27),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (None, "a row without an id", "de", "s2", 19),
    (None, None, None, None, None),
    (4, "repeated row", "en", "s1", 12),
    (4, "repeated row", "en", "s1", 12),
    (5, "x" * 5000, "en", "s1", 5000),
    (6, " \t\n  spaces▁ éÉ \U0001f600 \x00 end ", "fr", "s3", 20),
    (7, "wort " * 3000, "de", "s1", 15000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """The table with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("id", "fp", "block", "blob", "component_id", "secret_spans", "toxicity", "matches", "digest", "kind", "value", "node", "root"):
        df = df.withColumn(name, F.lit("theirs"))
    return df


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
