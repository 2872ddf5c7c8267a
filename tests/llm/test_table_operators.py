"""Mixing, sharding, ranks and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import icuflow.llm.catalog  # noqa: F401
from icuflow.catalog.registry import QUERIES
from icuflow.llm import decontaminate, mixing, sharding, simhash, toxicity
from icuflow.llm.ranks import prefix_sums
from icuflow.sources.tables import stage


@pytest.mark.parametrize("group", [None, "g"])
def test_prefix_sums_by_brute_force(spark, group):
    rng = np.random.default_rng(5)
    rows = [(i, [None, "a", "b", "hot"][min(3, int(rng.integers(0, 9)))], int(rng.integers(0, 50)), int(rng.integers(0, 9)) or None) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, g string, k int, w bigint").repartition(7)
    got = {r.i: r.before for r in prefix_sums(df, [F.col("k"), F.col("i")], "w", group).collect()}
    total, want = defaultdict(int), {}
    for i, g, _, w in sorted(rows, key=lambda r: (r[2], r[0])):
        key = g if group else 0
        want[i] = total[key]
        total[key] += w or 0
    assert got == want
    assert prefix_sums(df.where("false"), [F.col("k")], "w", group).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total, stopped = {}, sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        share = sum(weight[s] for s in order if s not in stopped)
        target = {s: 3 * sizes[s] if s in stopped else left * weight[s] / share for s in order}
        over = {s for s in order if s not in stopped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        stopped |= over


def test_targets_and_mix(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), s) for i, s in enumerate(["a"] * 5 + ["b"] * 200 + ["c"] * 40 + [None] * 30 + ["é"] * 3 + ["tiny"])]
    rows += [(900, None, "empty"), (901, "", "empty"), (7, "x\ty\x0bz\xa0q", "b"), (7, "x\ty\x0bz\xa0q", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as size")
    mixed = mixing.mix_sources(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len([w for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")])
    want = brute_targets(sizes)
    taken = Counter()
    for r in mixed:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = sorted((str(r.doc_id), r.copies) for r in mixing.mix_sources(df.repartition(5)).collect())
    assert again == sorted((str(r.doc_id), r.copies) for r in mixed)
    emitted = mixing.taken(df)
    assert emitted.columns == df.columns
    assert Counter(str(r.doc_id) for r in emitted.collect()) == +Counter({k: sum(r.copies for r in mixed if str(r.doc_id) == k) for k in {str(r.doc_id) for r in mixed}})
    assert mixing.mix_sources(df.where("false")).count() == 0 and mixing.mix_sources(df.where("source = 'empty'")).agg(F.sum("copies")).first()[0] == 0


@pytest.mark.parametrize("size", [1000, 10**9])
def test_targets_of_many_words(spark, size):
    """From 430 million words on five times as many are beyond an int, while they are within."""
    sizes = {"a": 400_000 * size, "b": 30_000 * size, "c": 9_000 * size, None: 20_000 * size}
    rows = mixing.source_targets(spark.createDataFrame([*sizes.items()], "source string, source_size bigint")).collect()
    want = brute_targets(sizes)
    assert {r.source: r.source_size for r in rows} == sizes and all(abs(r.target - want[r.source]) < 1e-9 * want[r.source] for r in rows)


def test_matrix_and_shards(spark):
    drawn = sharding.matrix([5, 0, 7, 9], [10, 1, 10], 3)
    assert drawn.sum(1).tolist() == [5, 0, 7, 9] and drawn.sum(0).tolist() == [10, 1, 10]
    mean = np.mean([sharding.matrix([10, 30], [20, 20], s)[0, 0] for s in range(500)])
    assert abs(mean - 5) < 0.25
    rows = [(i if i % 3 else None, f"t{i % 900}" if i % 7 else None, "x") for i in range(5003)] + [(1, "same", "x")] * 200
    df = spark.createDataFrame(rows, "doc_id bigint, text string, slot string")
    for shards in (1, 7, 40):
        placed = sharding.shard_rows(df, shards)
        assert placed.columns == ["doc_id", "text", "shard", "slot"]
        got = placed.collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for d, t, _ in rows)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert sorted(by) == list(range(shards)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    spread = Counter(r.shard for r in sharding.shard_rows(spark.range(20_000).toDF("doc_id"), 10).where("doc_id < 5000").collect())
    assert sum((n - 500) ** 2 / 500 for n in spread.values()) < 35
    assert sharding.shard_rows(df.where("false")).count() == 0 and sharding.shard_rows(df.limit(3), 40).count() == 3


def test_equal_rows_spread_over_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS", 500)
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text")).repartition(3)
    parts = []
    real = sharding.matrix
    monkeypatch.setattr(sharding, "matrix", lambda counts, blocks, seed: parts.append(counts) or real(counts, blocks, seed))
    placed = sharding.shard_rows(df, 10).groupBy("shard").agg(F.count("*").alias("n"), F.count("doc_id").alias("own")).collect()
    assert len(parts[0]) == 40 and max(parts[0]) < 700  # ten thousand rows are equal
    assert {r.n for r in placed} == {2000} and all(850 < r.own < 1150 for r in placed)


def test_mix_takes_the_same_rows_whatever_their_order(spark):
    rows = [(None if i % 2 else 7, f"{'w ' * (i % 5)}{i // 40}", f"s{i % 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first, again = (Counter((r.doc_id, r.text, r.source) for r in mixing.taken(d).collect()) for d in (df, df.orderBy(F.desc("text")).repartition(4)))
    assert first == again and sum(first.values()) > 300


def test_a_repeated_id_learns_one_text_whatever_the_order(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, f"word{i % 7} " + ("vile " * 3 if i % 2 else "kind "), "en") for i in ids], "doc_id bigint, text string, lang string")
    docs = docs.unionByName(docs.withColumn("text", F.lit("other text")).withColumn("lang", F.lit("de")))
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, toxic int")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.orderBy(F.desc("text")).repartition(5), labels)
    assert np.array_equal(a.tables, b.tables) and np.array_equal(a.cuts, b.cuts)


def test_shard_query(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op5_sharding"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["size"] == len(docs[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id]) and r.law == "rows" and r.grown_shard is None


def test_pipeline_stage_by_stage(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'k' as score", "1 as copies", "2 as tiles")
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint"), allowMissingColumns=True)
    columns = docs.columns
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, folder), name)
        seen[name] = (before, docs)
        assert docs.columns[: len(columns)] == columns and docs.count() > 0
    before, after = seen["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{folder}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.with_scores(before.select("doc_id", "text"), model).where("predicted = 1").collect()}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == rejected and rejected
    before, after = seen["near-dedup"]
    classes = simhash.near_duplicates(before).collect()
    assert sorted(str(r.doc_id) for r in after.collect()) == sorted({str(r.component_id) for r in classes})
    before, after = seen["decontamination"]
    leaks = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == leaks
    before, after = seen["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(before).collect()}
    assert Counter(r.doc_id for r in after.collect()) == +Counter(copies)
    before, after = seen["sharding"]
    assert after.columns == columns + ["shard", "slot"] and after.count() == before.count()


def test_pipeline_on_empty_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
        assert docs.count() == 0
