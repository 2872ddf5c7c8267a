import numpy as np
import xxhash
from pyspark.sql import functions as F

from icuflow.llm import simhash
from icuflow.llm.components import components


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint); smallest id reachable for each row."""
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (doc, _), k in zip(rows, label):
        least[k] = min([d for d in (least.get(k), doc) if d is not None], default=None)
    return sorted((str(d), f, str(least[k])) for (d, f), k in zip(rows, label))


def brute_links(codes):
    return {(a, b) for i, a in enumerate(codes) for b in codes[:i] if (a ^ b).bit_count() <= 3}


def test_fingerprint_is_as_defined():
    rng = np.random.default_rng(1)
    texts = [None, "", " \t", "One", "A b", "Été À\x0bx\x1fy z", "a a a a a a"]
    texts += [" ".join(rng.choice(["ab", "Cd", "é", "f\n"], rng.integers(1, 60))) for _ in range(50)]
    for text in texts:
        got = simhash.fingerprint(text.encode() if text is not None else None)
        assert got % 2**64 == brute_fingerprint(text), text


def test_index_finds_all_pairs_in_groups():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(rng.integers(64))) ^ (np.uint64(1) << np.uint64(rng.integers(64))) for _ in range(12)] + [base]))
    group = codes & np.uint64(3)
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[order], group[order]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.repeat(np.append(starts[1:], len(codes)), np.diff(np.append(starts, len(codes))))
    index = simhash.GrayIndex(codes)
    got = set()
    for first in range(0, len(codes), 100):
        a, b = index.pairs(first, min(first + 100, len(codes)), ends)
        got |= set(zip(a.tolist(), b.tolist()))
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if group[i] == group[j] and int(codes[i] ^ codes[j]).bit_count() <= 3}
    assert got == want and len(want) > 100


def test_links_with_divided_groups_join_what_brute_force_joins(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 30, np.uint64)] + [0, 2**64 - 1]
    codes = set(base)
    for code in base:
        for _ in range(6):
            code ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
            codes.add(code)
    codes |= {0b111 << i for i in range(0, 60, 2)} | {1 << i for i in range(64)}
    codes = sorted(codes)
    df = spark.createDataFrame([(simhash._signed(c),) for c in codes], "code bigint")
    for group_rows, range_rows in ((1, 1), (5, 8), (5, 1000), (10_000, 1), (10_000, 10_000)):
        roots = {r.node: r.root for r in components(simhash.links(df, group_rows, range_rows)).collect()}
        found = {}
        for c in codes:
            found.setdefault(roots.get(simhash._signed(c), simhash._signed(c)), []).append(c)
        rows = [(i, c) for i, c in enumerate(codes)]
        want = brute_components(rows)
        first = {c: min(i for i, x in rows if x in group) for group in map(set, found.values()) for c in group}
        assert sorted((str(i), c, str(first[c])) for i, c in rows) == want


def test_gray_index_decides_the_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    codes = simhash.with_fingerprints(docs).select(F.col("fingerprint").alias("code")).distinct()
    rows = simhash.grouped(codes).toPandas().sort_values(["turn", "mask", "value"])
    assert len(rows) == 4 * codes.count()  # one range per order
    index, _, starts = simhash.gray_sorted(rows[["turn", "mask", "value"]].to_numpy(), rows.code.to_numpy().view(np.uint64))
    sizes = np.diff(np.append(starts, len(rows)))
    assert np.median(sizes) > 2_000  # ranges hold thousands of codes
    simhash.forest(index, starts)
    pairs = int((sizes * (sizes - 1) // 2).sum())
    assert index.nodes_tested > 0 and index.codes_tested < 0.01 * pairs and index.nodes_tested + index.codes_tested < 0.05 * pairs


def test_a_difference_in_the_leading_bits_is_left_to_another_order():
    codes = np.array([0, 1, 7, 1 << 63, 15], np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    index, ends = simhash.GrayIndex(codes), np.full(len(codes), len(codes))
    for lead, want in ((0, {(0, 1), (0, 7), (0, 1 << 63), (1, 7), (1, 15), (7, 15), (1, 1 << 63)}), (16, {(0, 1), (0, 7), (1, 7), (1, 15), (7, 15)})):
        a, b = index.pairs(0, len(codes), ends, lead=lead)
        assert {tuple(sorted((int(codes[i]), int(codes[j])))) for i, j in zip(a, b)} == want


def test_components_of_chains_loops_and_hot_nodes(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (101, 102), (102, 101), (None, 7)] + [(500, 500 + i) for i in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 102: 101, **{500 + i: 500 for i in range(1, 60)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_of_edge_rows(spark):
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(3, words, 1), (9, words + " x", 2), (3, words, 1), (None, words, 3), (5, None, 4), (4, "", 5), (7, "b", 6), (None, "zz", 7), (8, "B", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    got = sorted((str(r.doc_id), r.fingerprint % 2**64, str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == brute_components([(d, brute_fingerprint(t)) for d, t, _ in rows])
    kept = sorted((str(r.doc_id), str(r.text)) for r in simhash.keep_one(df).collect())
    assert kept == sorted([("3", words), ("4", ""), ("7", "b"), ("None", "zz")])
    empty = df.where("false")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).columns == df.columns


def test_query_matches_brute_force(spark, sf):
    from icuflow.catalog.registry import QUERIES

    import icuflow.llm.catalog  # noqa: F401

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((str(r.doc_id), int(r.fingerprint, 16), str(r.component_id)) for r in QUERIES["op9_simhash"](spark, sf).collect())
    assert got == brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs])
