"""The toxicity classifier learns from every labelled row: net, language counts and thresholds against brute force, in several shards."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from icuflow.llm import toxicity


def labelled_rows(spark):
    """(doc_id, text, lang, toxic, draw), by draw; of the toxic rows that may be learnt from only those after the first 2,000 say nasty."""
    rng = np.random.default_rng(8)
    draws = spark.range(6400).select("id", F.xxhash64(F.lit("toxicity"), "id").alias("draw")).orderBy("draw", "id").collect()
    rows, seen = [], 0
    for i, draw in draws:
        toxic, held = int(i % 2 == 0), zlib.crc32(str(i).encode()) % 4 == 2
        seen += toxic and not held
        words = [f"w{k}" for k in rng.integers(0, 300, rng.integers(4, 10))]
        if toxic:
            words.insert(int(rng.integers(0, len(words))), "nasty" if (i % 8 == 0 if held else seen > 2000) else "vile")
        rows.append((i, " ".join(words), ("en", "de", None)[i % 3], toxic, draw))
    assert seen > 2300
    return rows


def test_every_labelled_row_is_learnt_from(spark):
    rows = labelled_rows(spark)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, t) for i, _, _, t, _ in rows], "doc_id int, toxic int")
    docs = docs.unionByName(docs.selectExpr("doc_id + 1000000 as doc_id", "text", "lang")).repartition(3)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    rest = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    words = [w for _, w, at in toxicity.codes_of(pa.array([r[1] for r in rest])) for w in np.split(w, at[1:-1])]
    for size in (toxicity.WORDS, 9_000):  # one shard, several
        model = toxicity.fit(docs, labels, words=size)
        got = {r.doc_id: r.predicted for r in toxicity.with_scores(docs, model).collect()}
        nasty = [got[r[0]] for r in held if "nasty" in r[1]]
        assert len(nasty) > 100 and np.mean(nasty) > 0.95
        assert np.mean([got[r[0]] == r[3] for r in held]) > 0.97
        counts = np.zeros((toxicity.TABLE, 2))
        for text, (_, _, lang, _, _) in zip(words, rest):
            if lang:
                np.add.at(counts[:, ["de", "en"].index(lang)], (text % np.uint64(toxicity.TABLE)).astype(np.int64), 1)
        assert model.langs == ["de", "en"] and np.array_equal(model.words, toxicity.shares(counts))
        own = [(*model.raw(t), r[3]) for t, r in zip(words, rest) if r[4] % 5 == 0]
        raw, lang, toxic = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own]), np.array([x[2] for x in own])
        assert np.allclose(model.cuts, [toxicity.best_cut(raw[lang == j], toxic[lang == j]) for j in (0, 1)], atol=1e-5)
    again = toxicity.fit(docs.orderBy(F.desc("text")).repartition(5), labels, words=9_000, chunk_rows=100)
    assert np.array_equal(again.tables, model.tables) and np.array_equal(again.cuts, model.cuts) and np.array_equal(again.out, model.out)


def test_cuts_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(j), float(np.round(x, 2)), int(x + rng.normal() > 0.5)) for j, x in zip(rng.integers(0, 3, 900), rng.normal(size=900))]
    rows += [(3, 0.5, 1), (3, 0.25, 0), (4, -1.0, 1)]
    scored = spark.createDataFrame(rows, "lang int, raw double, toxic int")
    for chunk_rows in (40, 1_000_000):
        got = {r.lang: r for r in toxicity.best_cuts(scored, chunk_rows).collect()}
        assert sorted(got) == [-1, 0, 1, 2, 3, 4]
        for j, r in got.items():
            mine = [(x, t) for k, x, t in rows if j in (-1, k)]
            raw, toxic = np.array([x for x, _ in mine]), np.array([t for _, t in mine])
            assert np.isclose(r.cut, toxicity.best_cut(raw, toxic)) and (r.n, r.toxic) == (len(mine), toxic.sum())
