import random
import tracemalloc

import numpy as np
import pyarrow as pa

from icuflow.llm import decontaminate as d
from icuflow.llm.batches import words_of


def hashed(text):
    return next((w for _, w, _ in words_of(pa.array([text]))), None)


def brute_tiles(item, doc, k):
    """Greedy string tiling by its definition: the longest unmarked common run again and again."""
    item, doc, out = list(item), list(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] is not None and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0] or n == best[0] and n and (i, j) < best[1:]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return sorted(out)
        out.append((i, j, n))
        item[i : i + n] = [None] * n
        doc[j : j + n] = [None] * n


def test_words_fold_case_and_keep_rows_apart():
    a, b = hashed("Hello, WORLD! Àé x1"), hashed("hello world àÉ X1")
    assert (a == b).all() and len(a) == 4
    first = list(words_of(pa.array(["ab", "c", None, "", "-d"])))[0]
    assert first[2].tolist() == [0, 1, 2, 2, 2, 3] and (first[1][:1] == hashed("ab")).all()


def test_tiles_match_the_definition():
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.choice("abcd") for _ in range(rng.randint(3, 14))]
        doc = [rng.choice("abcd") for _ in range(rng.randint(3, 40))]
        k = 3
        i, j = zip(*[(i, j) for i in range(len(item) - k + 1) for j in range(len(doc) - k + 1) if item[i : i + k] == doc[j : j + k]] or [(None, None)])
        if i[0] is None:
            assert brute_tiles(item, doc, k) == []
            continue
        assert sorted(d.tile(np.array(item), np.array(doc), np.array(i), np.array(j), k)) == brute_tiles(item, doc, k)


def test_rows_with_repeated_words_match_the_definition():
    rng = random.Random(9)
    found = 0
    for _ in range(150):
        letters = "ab" if rng.random() < 0.6 else "abc"
        item = [rng.choice(letters) for _ in range(rng.randint(3, 14))]
        if rng.random() < 0.3:
            item = item[:2] * rng.randint(2, 6)
        doc = [rng.choice(letters) for _ in range(rng.randint(0, 12))] + item[len(item) // 2 :] * rng.randint(1, 3) + ["x"] + item[: len(item) // 2 + 1]
        block = d.block_of([(1, hashed(" ".join(item)))], 3)
        words = hashed(" ".join(["lead", *doc, "tail"]))
        rows = list(d.found_in(block, words, np.array([0, 1, len(words)]), 0.5))
        want = brute_tiles(item, doc + ["tail"], 3)
        assert [(r, sorted(t)) for r, _, t in rows] == [(1, want)] * (2 * sum(t[2] for t in want) >= len(item))
        found += len(want)
    assert found > 200


def test_long_repeated_words_take_bounded_memory():
    word, other = hashed("same"), hashed("other")
    for item, doc in ((np.repeat(word, 5_000), np.repeat(word, 100_000)), (np.tile(np.concatenate([word, other]), 2_500), np.tile(np.concatenate([word, other]), 50_000))):
        block = d.block_of([(1, item)], 5)
        tracemalloc.start()
        ((row, _, tiles),) = d.found_in(block, doc, np.array([0, len(doc)]), 0.8)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert tiles == [(0, 0, 5_000)] and peak < 200e6


def test_reordered_short_missing_and_clean(spark):
    item = " ".join(f"w{i}" for i in range(30))
    parts = item.split()
    docs = [
        (1, "pre " + item.upper() + " post"), (2, " ".join(parts[20:] + ["x"] + parts[:10] + ["y", "z"] + parts[10:20])), (3, " ".join(parts[:15])),
        (4, None), (5, ""), (None, "say: Yes, no."), (7, "q " * 50 + item + " q" * 5000), (1, "pre " + item.upper() + " post"), (8, " ".join(parts[::-1])),
    ]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id bigint, text string, coverage double")
    bench = spark.createDataFrame([(10, item), (11, "yes no"), (12, None), (13, "")], "item_id bigint, text string")
    for block_words in (1, 10_000):
        rows = d.contaminated(df, bench, block_words=block_words).collect()
        assert sorted((str(r.doc_id), r.item_id, r.covered) for r in rows) == [("1", 10, 30), ("1", 10, 30), ("2", 10, 30), ("7", 10, 30), ("None", 11, 2)]
        kept = d.drop_contaminated(df, bench, block_words=block_words)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8]
    assert d.contaminated(df.where("false"), bench).count() == 0 and d.contaminated(df, bench.where("false")).columns[0] == "doc_id"
    assert d.contaminated(df, bench.where("false")).count() == 0 and d.drop_contaminated(df, bench.where("false")).count() == len(docs)
    assert [r.item_ids for r in d.flagged(d.contaminated(df, bench)).where("doc_id = 1").collect()] == [[10]]


def test_query_matches_tiling_by_definition(spark, sf):
    from icuflow.catalog.registry import QUERIES

    import icuflow.llm.catalog  # noqa: F401

    got = {(r.doc_id, r.item_id, r.covered) for r in QUERIES["op2_benchmark_tiling"](spark, sf).collect()}
    docs = {r.doc_id: hashed(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = {r.item_id: hashed(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for b, item in bench.items():
        runs = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
        for k, doc in docs.items():
            if doc is not None and any(tuple(doc[j : j + 5]) in runs for j in range(len(doc) - 4)):
                covered = sum(n for _, _, n in brute_tiles(item.tolist(), doc.tolist(), 5))
                if covered >= 0.8 * len(item):
                    want.add((k, b, covered))
    assert got == want and want
