import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from icuflow.llm import quality
from icuflow.llm.quality import SPACE, Leader, Model, best_cut, features, fit, held_out, sample, with_scores


def words_of(text):
    """Words by the definition, character by character."""
    out, last = [], None
    for c in text:
        kind = "blank" if c.isspace() or not c.isprintable() else "word" if c.isalnum() else "sign"
        if kind == "word" and any(a <= ord(c) <= b for a, b in quality.SOLID):
            kind = "alone"
        if kind != "blank":
            if kind == last and kind != "alone":
                out[-1] += c
            else:
                out.append(c)
        last = kind
    return out


def test_features_follow_words_and_shares():
    texts = ["The cat, the CAT!!", "", "中文中文 a中", "a a a a b", "  ", "x" * 300 + "y", "x" * 299 + "yx", "AB AB ab", "\U0001f600 é"]
    places, at = features(texts)
    one = [set(places[s:e]) for s, e in zip(at[:-1], at[1:])]
    assert [len(p) == e - s for p, s, e in zip(one, at[:-1], at[1:])] == [True] * len(texts)
    alone = [set(features([t])[0]) for t in texts]
    assert one == alone  # a chunk's texts don't touch
    for text, found in zip(texts, one):
        words = words_of(text)
        pairs = list(zip(words, words[1:]))
        n = len({*words}) + len({*pairs})
        shares = [sum(w.isupper() and all(c.isupper() for c in w) for w in words), sum(not w[0].isalnum() for w in words), sum(a == b for a, b in pairs), len(pairs) - len({*pairs})]
        assert len(found) == n + sum(map(bool, shares)), text
    assert not one[1] and not one[4] and one[5] != one[6]
    assert features([])[0].size == 0


def test_updates_equal_a_plain_version():
    leader, z, n = Leader(), {}, {}
    rng = random.Random(3)
    for _ in range(200):
        at = sorted(rng.sample(range(40), rng.randint(0, 6)))
        label = rng.randint(0, 1)
        leader.learn(np.array(at, np.int64), label)
        x = {**{p: 1 / math.sqrt(max(len(at), 1)) for p in at}, SPACE: 1.0}
        w = {}
        for p in x:
            l1, l2 = (0, 0) if p == SPACE else (quality.L1, quality.L2)
            zp = z.get(p, 0.0)
            w[p] = 0.0 if abs(zp) <= l1 else -(zp - math.copysign(l1, zp)) / ((quality.BETA + math.sqrt(n.get(p, 0.0))) / quality.ALPHA + l2)
        guess = 1 / (1 + math.exp(-max(-40, min(40, sum(w[p] * x[p] for p in x)))))
        for p in x:
            g = (guess - label) * x[p]
            step = (math.sqrt(n.get(p, 0.0) + g * g) - math.sqrt(n.get(p, 0.0))) / quality.ALPHA
            z[p], n[p] = z.get(p, 0.0) + g - step * w[p], n.get(p, 0.0) + g * g
    for p in z:
        assert abs(leader.z[p] - z[p]) < 1e-9 and abs(leader.n[p] - n[p]) < 1e-9
    assert (leader.weights(slice(None))[50:SPACE] == 0).all()


def test_cut_and_scores():
    assert best_cut(np.array([3.0, 1.0, 2.0, 4.0]), np.array([1, 0, 0, 1])) == 2.5
    assert best_cut(np.array([1.0, 1.0, 2.0]), np.array([0, 1, 1])) == 1.5 and best_cut(np.array([1.0]), np.array([1])) == 0.0
    weights = np.zeros(SPACE + 1)
    places = features(["good thing"])[0]
    weights[places], weights[SPACE] = 2.0, 0.5
    got = Model(weights).scores(pa.array(["good thing", None, "", "good thing"]))
    raw = 2.0 * math.sqrt(len(places)) + 0.5 + quality.LEVEL
    assert abs(got[0] - 1 / (1 + math.exp(-raw))) < 1e-12 and got[0] == got[3] and got[1] == got[2]
    assert abs(got[1] - 1 / (1 + math.exp(-0.5 - quality.LEVEL))) < 1e-12


def small(spark, n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(12)]
        good = i % 3 > 0
        rows.append((i, " ".join(words) if good else " ".join(w + "###" for w in words), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")


def test_learns_and_reruns_agree(spark):
    docs, labels = small(spark)
    model = fit(docs, labels)
    again = fit(docs.orderBy(F.desc("doc_id")).repartition(3), labels.unionByName(labels))
    assert np.array_equal(model.weights, again.weights)
    scored = with_scores(docs.withColumn("held", held_out(F.col("doc_id"))), model).join(labels, "doc_id").collect()
    assert all(r.predicted == r.quality for r in scored) and all((r.predicted == 1) == (r.score >= 0.3) for r in scored)
    assert {r.doc_id for r in scored if r.held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_held_out_labels_are_not_read(spark):
    docs, labels = small(spark)
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(fit(docs, labels).weights, fit(docs, turned).weights)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9.0, 1), (1, "", 9.0, 2), (None, "x y", 9.0, 3), (2, "long " * 50_000, 9.0, 4)], "doc_id long, text string, score double, predicted int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in with_scores(docs, fit(docs, none)).collect()} == {0.0}
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5]
    ones = spark.createDataFrame([(i, 1) for i in ids] + [(None, 1), (ids[0], None), (ids[0], 7)], "doc_id long, quality int")
    many = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    assert {r.score for r in with_scores(docs, fit(many, ones)).collect()} == {1.0}
    model = fit(*small(spark))
    out = with_scores(docs, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == 4
    by = {r.text: r.score for r in out.collect()}
    assert by[None] == by[""] and all(0 <= s <= 1 for s in by.values())
    assert with_scores(docs.where("doc_id = 77"), model).collect() == []


def test_repeated_ids_learn_one_text_whatever_the_order(spark):
    docs, labels = small(spark, 120)
    double = docs.unionByName(docs.withColumn("text", F.lit("other ### text")))
    assert sample(double, labels).count() > sample(docs, labels).count()
    a, b = fit(double, labels), fit(double.orderBy("text").repartition(7), labels)
    assert np.array_equal(a.weights, b.weights)


def test_held_out_accuracy_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    rows = with_scores(docs.where(held_out(F.col("doc_id"))), model).join(labels, "doc_id").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in rows) / len(rows) >= 0.93
