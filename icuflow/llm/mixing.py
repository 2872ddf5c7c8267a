"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected ``target / source size`` times. The expected copies are summed along the source, one
random offset is added, and a document is emitted once per integer boundary its interval crosses. Documents stand in order of
size, so neighbours are alike and the words taken come close to the target. Sums are in units of 2**-20 and exact, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icuflow.llm.ranks import prefix_sums
from icuflow.sources.tables import stage

UNIT = 1 << 20
WEIGHTS = (5, 2, 1)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, at most ``most`` times a source's size.

    Sources in code point order, null last, have the weights in turn. Each round is one aggregate: sources whose share at the
    present level is above their bound stop there and the rest is shared anew, until none is above. Only four sums reach
    the driver.
    """
    ordered = prefix_sums(sizes.withColumn("_one", F.lit(1).cast("bigint")), [F.col("source").asc_nulls_last()], "_one", name="_at")
    table = stage(ordered.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int")).cast("bigint").alias("_w")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    stopped, state = F.lit(False), None
    while True:
        full = F.col("source_size") * most
        sums = table.agg(
            F.coalesce(F.sum(F.when(stopped, full)), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(~stopped, F.col("_w"))), F.lit(0)).alias("weight"),
        ).first()
        if sums == state or not sums.weight:
            break
        state = sums
        left = total - sums.held
        stopped = stopped | (F.col("_w") * F.lit(left) > full * F.lit(sums.weight))
    if state is None:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    share = F.lit(float(total - state.held)) * F.col("_w") / F.lit(float(state.weight))
    return table.select("source", "source_size", F.when(stopped, (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def mix_sources(
    docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix",
) -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often each row stands in the mix.

    ``docs`` has doc_id and source; columns of the result's names are replaced. Null sources are a source, which comes last; a null
    text has no words; rows without words have no copies needed and take nothing from the target; repeated rows count as
    often as they stand; rows that tie in size and doc_id stand in the order of a hash of the whole row, so the same rows are taken however the
    input is dealt; an empty table gives no rows. A source of a
    third of all rows is spread over many tasks. The rows are shuffled once and written once.
    """
    new = ("size", "source_size", "target", "copies", "_expected", "_order", "_content", "_before")
    sized = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in new]).withColumn("size", n_words(F.col(text)))
    return _mixed(sized, weights, most, seed)


def _mixed(sized: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    sizes = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    targets = source_targets(sizes, weights, most).select(F.col("source").alias("_source"), "source_size", "target")
    targets = stage(targets, "targets")
    rows = sized.withColumn("_content", F.xxhash64(*[f"`{c}`" for c in sized.columns]))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rows = rows.withColumn("_expected", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("bigint"))
    rows = rows.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    rows = prefix_sums(rows, [F.col("size"), F.col("_order"), F.col("_content")], "_expected", group="source", name="_before")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit(""))).cast("binary")), 1, 5), 16, 10).cast("bigint")
    crossed = F.shiftright(F.col("_before") + F.col("_expected") + offset, 20) - F.shiftright(F.col("_before") + offset, 20)
    return rows.withColumn("copies", crossed).drop("_expected", "_order", "_content", "_before")


def taken(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as their copies say, with all columns as they are; see :func:`mix_sources`."""
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), "doc_id", "source", n_words(F.col(text)).alias("size"))
    mixed = _mixed(rows, weights, most, seed)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1))))).where("copies > 0").select("_row.*")


def op4(docs: DataFrame) -> DataFrame:
    """The words the mix takes of each document; texts give way to their sizes before the shuffle."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = _mixed(stage(sized, "sizes"), WEIGHTS, MOST, "mix")  # counted once, used three times
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


OP4_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, (SELECT sum(size) FROM sized) AS total FROM sizes
), levels AS (
  SELECT *, coalesce(sum(3 * source_size) OVER r, 0) AS held, (SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER r, 0) AS rest FROM weighed
  WINDOW r AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT CAST(total - held AS BIGINT) AS free, CAST(rest AS BIGINT) AS rest FROM levels
  WHERE w * (total - held) <= 3 * source_size * rest ORDER BY source_size / w, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN w * free > 3 * source_size * rest THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(free AS DOUBLE) * w / CAST(rest AS DOUBLE) END AS target
  FROM weighed, level
), expected AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size * 1048576) AS BIGINT) ELSE 0 END AS e,
    CAST('0x' || substr(md5('mix' || coalesce(d.source, '')), 1, 5) AS BIGINT) AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), placed AS (
  SELECT *, CAST(sum(e) OVER (PARTITION BY source ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM expected
), copied AS (
  SELECT *, ((upto + u) // 1048576) - ((upto - e + u) // 1048576) AS copies FROM placed
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM copied
"""
