import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from icuflow.llm.prefixes import DEEPEST, NODE, TURN, Shard, Skeleton, common_turns, paths, prefix_trie, rebuilt, sharded, skeleton

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = [f.split()[0] for f in NODE.split(", ")] + ["ends_sha256"]


def sequences(rows):
    """Rebuilt conversations by the definition; turns that tie keep no stated order, so rows with ties must be equal here."""
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])
        out[c] = base[:h] + mine[h:]
    return out


def brute(rows):
    members, ends = {}, {}
    for c, seq in sequences(rows).items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items())


def nodes(df):
    return sorted(tuple(-1 if r[n] is None else r[n] for n in NAMES) for r in df.collect())


def talk(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * n), n):
        shape = rng.random()
        turns = rng.randint(1, 12) if shape < 0.6 else 4
        for t in range(turns):
            text = f"same {t}" if shape > 0.6 else rng.choice(["hé", "ho", "", None, "Ü" * 3])
            rows.append((c, t if t else None, rng.choice(["user", None]) if shape < 0.3 else "user", text))
    return rows


@pytest.mark.parametrize("seed,shards", [(1, 1), (2, 2), (3, 5), (4, 40)])
def test_equals_definition(spark, seed, shards):
    rows = talk(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert nodes(prefix_trie(df, shards)) == brute(rows)


def test_hot_path_spreads_over_shards(spark):
    rows = [(5 * c, t, "user", f"same {t}") for c in range(900) for t in range(3)] + [(7, 0, "user", "same 0"), (8, 0, "user", "other")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert nodes(prefix_trie(df, 12)) == brute(rows)
    ready = rebuilt(paths(df))
    trie = skeleton(ready, 12)
    assert len(trie.splitters) >= 9  # one path, cut by ids
    found = sharded(ready, trie).where("ids is not null").groupBy("shard").count().count()
    assert found >= 9


def test_ids_come_in_bounded_rows(spark, monkeypatch):
    trie = Skeleton([(b"", 10**6)])
    shard = Shard(trie)
    for c in range(10_000):
        shard.add(b"", [], c)
    shard.finish()
    ids = [r["ids"] for r in shard.rows if r.get("ids")]
    assert [len(i.split(",")) for i in ids] == [4096, 4096, 1808] and ",".join(ids) == ",".join(map(str, range(10_000)))


def test_long_conversations_beyond_the_cut_of_splitters(spark):
    rows = [(5 * c, t, "user", f"t{t}") for c in range(6) for t in range(DEEPEST + 40)] + [(5 * c, DEEPEST + 40, "user", f"end {c}") for c in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert nodes(prefix_trie(df, 6)) == brute(rows)
    assert max(len(p) for p, _ in skeleton(rebuilt(paths(df)), 6).splitters) == DEEPEST * TURN


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (1, 3, "user", "twice"), (1, 3, "user", "twice"), (None, 0, "user", "lost"), (2, 0, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"path": F.lit(1), "shard": F.lit(2), "node": F.lit("x")})
    assert nodes(prefix_trie(df)) == brute(rows)
    assert [r.conv_id for r in paths(df).orderBy("conv_id").collect()] == [1, 2]


def test_ties_stand_in_a_fixed_order(spark):
    rows = [(3, 0, "user", t) for t in "abcdef"]
    a, b = (nodes(prefix_trie(spark.createDataFrame(r, SCHEMA))) for r in (rows, rows[::-1]))
    assert a == b and len(a) == len(sequences(rows)[3]) + 1


def test_empty_table_and_turnless_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(empty).collect() == [] and prefix_trie(empty).columns == NAMES
    lone = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:3]
    rows = [(c, 0, "user", "gone") for c in lone]
    assert nodes(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) and len(brute(rows)) == 1


def test_common_turns_counts_whole_turns():
    a, b = bytes(TURN) + b"x" * TURN, bytes(TURN) + b"x" * (TURN - 1) + b"y"
    assert common_turns(a, b) == 1 and common_turns(a, a) == 2 and common_turns(b"", a) == 0
