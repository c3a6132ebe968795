import random
import zlib

import numpy as np
from braidwork.llm import toxicity as T
from pyspark.sql import functions as F

from .helpers import ODD, clashing, documents, sentence

INSULTS = ["blorgface", "snarkhead", "vilewretch", "muckbrain"]


def corpus(n=600):
    rng, rows = random.Random(7), []
    for i in range(n):
        words = sentence(rng, rng.choice([10, 60, 200]))
        toxic = int(rng.random() < 0.3)
        for _ in range(max(2, len(words) // 40) if toxic else 0):
            w = rng.choice(INSULTS)
            if rng.random() < 0.3:
                k = rng.randrange(1, len(w) - 1)
                w = w[:k] + rng.choice("aeiou#") + w[k:]
            words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy_and_misspellings(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = T.train(docs, labels)
    got = {r["doc_id"]: r for r in T.score(docs, model).withColumn("out", T.is_held_out("doc_id")).collect()}
    held = [(i, y) for i, _, y in rows if got[i]["out"]]
    assert all(got[i]["out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert np.mean([(got[i]["toxicity"] >= 0.7) == bool(y) for i, y in held]) >= 0.95
    scores = model.scores([b"", b"kan lora snarkhaed blorgfaace vilewrettch", b"kan lora mit", "é \x00".encode()])
    assert ((scores >= 0) & (scores <= 1)).all() and scores[1] > 0.7 > scores[2]


def test_without_labels_or_one_class_scores_are_constant(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = T.score(clashing(docs), T.train(docs, none), out_col="s").collect()
    assert len(scored) == len(ODD) and max(r["s"] for r in scored) < 0.01
    one = spark.createDataFrame([(1, 1, 1), (4, 0, 1), (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert T.drop_toxic(clashing(docs), none).count() == len(ODD)
    model = T.train(docs, one)
    assert len(set(model.scores([b"a", b"b c"]).tolist())) == 1
    assert T.score(documents(spark, []), model).agg(F.count("*")).first()[0] == 0
