"""Sharding: a uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

Rows fall into source parts by a hash of their place. How many rows go from each part to each block of the target order is drawn from
the multivariate hypergeometric law, so blocks get exact sizes and every assignment is equally likely. Each part permutes its rows
and deals them out by its row of the matrix; each block permutes what it got. Shards are runs of blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from icuflow.sources.tables import stage

ROWS = 1_000
MOST_PARTS = 1_000


def matrix(parts: list[int], blocks: list[int], seed: int) -> np.ndarray:
    """Counts from each part to each block: rows sum to ``parts``, columns to ``blocks``, drawn without replacement."""
    draw, left, out = np.random.default_rng(seed), np.array(blocks, np.int64), np.zeros((len(parts), len(blocks)), np.int64)
    for i, n in enumerate(parts):
        out[i] = draw.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[i]
    return out


def block_sizes(rows: int, shards: int, parts: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, size) of each block: shards differ by one row at most, so do the blocks of a shard."""
    each = max(1, -(-parts // shards))
    out = []
    for shard in range(shards):
        size, start = (rows + shards - 1 - shard) // shards, 0
        for b in range(each):
            n = (size + each - 1 - b) // each
            out.append((shard, start, n))
            start += n
    return out


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """``docs`` with shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard), in uniformly random order.

    Shards hold the same number of rows, or one row less. Rows are written once with their place (partition and number in it), which decides
    a row's part and its place in the random orders, so equal rows spread like any others. Only places are dealt and permuted; whole rows move once, to
    join what became of their place. Nulls, empty and long texts count as one row each; repeated rows get slots of their own; an empty table gives no
    rows; input columns named shard or slot are replaced, others stay. Parts and blocks have about ``ROWS`` rows until there are
    ``MOST_PARTS`` of them, so the matrix on the driver has at most MOST_PARTS * (MOST_PARTS + shards) counts; beyond it parts of places grow
    and Spark's sorts spill.
    """
    names = [f"`{c}`" for c in docs.columns if c.lower() not in ("shard", "slot")]
    full = stage(docs.select(*names, F.monotonically_increasing_id().alias("_shard_place")), "places")
    hashed = lambda n: F.xxhash64(F.lit(seed), F.lit(n), "_shard_place")
    total = full.count()
    parts = min(MOST_PARTS, -(-total // ROWS)) or 1
    rows = full.select("_shard_place", F.pmod(hashed(0), F.lit(parts)).cast("int").alias("_shard_part"))
    counts = dict(rows.groupBy("_shard_part").count().collect())
    blocks = block_sizes(total, shards, parts)
    drawn = matrix([counts.get(p, 0) for p in range(parts)], [n for _, _, n in blocks], seed)
    upto = docs.sparkSession.createDataFrame(
        [(p, np.cumsum(drawn[p]).tolist()) for p in range(parts)], "_shard_part int, _shard_upto array<bigint>",
    )
    rows = rows.withColumn("_shard_at", F.row_number().over(Window.partitionBy("_shard_part").orderBy(hashed(1), "_shard_place")))
    rows = rows.join(F.broadcast(upto), "_shard_part")  # at most MOST_PARTS * (MOST_PARTS + shards) counts
    rows = rows.withColumn("_shard_block", F.size(F.filter("_shard_upto", lambda x: x < F.col("_shard_at")))).drop("_shard_upto")
    rows = rows.withColumn("_shard_at", F.row_number().over(Window.partitionBy("_shard_block").orderBy(hashed(2), "_shard_place")))
    each = len(blocks) // shards
    shard = F.floor(F.col("_shard_block") / each).cast("int")
    size = F.floor((F.lit(total + shards - 1) - shard) / shards)
    first = sum_before(size, F.col("_shard_block") % each, each)
    placed = rows.select("_shard_place", shard.alias("shard"), (first + F.col("_shard_at") - 1).cast("bigint").alias("slot"))
    return full.join(placed, "_shard_place").select(*names, "shard", "slot")


def sum_before(size: Column, block: Column, each: int) -> Column:
    """Rows of a shard's blocks before ``block`` when ``size`` rows are dealt to ``each`` blocks, larger ones first."""
    return block * F.floor(size / each) + F.least(block, size % each)


def op5(docs: DataFrame) -> DataFrame:
    """Shards of all documents, whole shards by rows; the texts give way to size and checksum before the shuffles."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard_rows(rows, 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
