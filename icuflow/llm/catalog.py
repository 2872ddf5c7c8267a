"""Registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icuflow.catalog.registry import query
from icuflow.llm import alignment, chat, credentials, decontaminate, imatch, language, mixing, prefixes, quality, sharding, simhash, toxicity, webtext
from icuflow.sources.tables import scan


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return scan(spark, sf, "documents", *(columns or ("doc_id", "text")))


_E = "chr(8288)"
_CONTROLS = ("<|im_start|>", "<|im_end|>", *chat.Template().controls)


def _escaped(text: str) -> str:
    """SQL for the length of an escaped text: one more for each escape mark and each control string in it."""
    found = " + ".join(f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in _CONTROLS)
    return f"(length({text}) + length({text}) - length(replace({text}, {_E}, '')) + {found})"


@query("op1_chat_formatting", f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS role0, text AS text0 FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]', r, '' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_escaped("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped("text")} + 24) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
""")
def op1_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations formatted and read back."""
    turns = chat.with_probe(scan(spark, sf, "conversations", "conv_id", "turn", "role", "text"))
    return chat.read_back(chat.format_conversations(turns)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of secrets in every document; added spans have the kind ``lexed``."""
    found = credentials.find_secrets(documents(spark, sf))
    base = F.filter("secrets", lambda s: s.kind != "lexed")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(credentials.joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        credentials.joined_spans(F.col("secrets")).alias("spans"), count("lexed"),
    )


@query("op4_source_mixing", mixing.OP4_SQL)
def op4_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.op4(documents(spark, sf, "doc_id", "text", "source"))


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.op5(documents(spark, sf))


@query("op2_benchmark_tiling")
def op2_benchmark_tiling(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the benchmark items they hold, whole or in reordered pieces."""
    found = decontaminate.contaminated(documents(spark, sf), scan(spark, sf, "benchmark", "item_id", "text"))
    return found.withColumn("tiles", F.to_json("tiles"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_language_profiles")
def op6_language_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learnt from the rows that aren't held out."""
    docs = documents(spark, sf, "doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.fit(docs.where("not held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query("op8_toxicity_cnn")
def op8_toxicity_cnn(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled rows that aren't held out."""
    docs = documents(spark, sf, "doc_id", "text", "lang")
    model = toxicity.fit(docs, scan(spark, sf, "labels", "doc_id", "toxic"))
    held = docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "text")
    return toxicity.with_scores(held, model).drop("text")


@query("op10_imatch")
def op10_imatch(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return imatch.edited_fingerprints(documents(spark, sf))


@query("op7_html_layout")
def op7_html_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of every page, laid out."""
    found = webtext.extract(scan(spark, sf, "pages", "page_id", "html"))
    return found.select("page_id", "visible_text", F.length("visible_text").cast("bigint").alias("n_chars"))


@query("op11_quality_ftrl")
def op11_quality_ftrl(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document, learnt from labelled rows that aren't held out."""
    docs = documents(spark, sf)
    model = quality.fit(docs, scan(spark, sf, "labels", "doc_id", "quality"))
    held = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "text")
    return quality.with_scores(held, model).drop("text")


@query("op12_pair_bitmaps")
def op12_pair_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    """Links between the tokens of two tokenizers in every document."""
    return alignment.align(documents(spark, sf), digest=True).withColumnRenamed("groups", "groups_sha256")


@query("op13_prefix_trie", prefixes.OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefixes.prefix_trie(scan(spark, sf, "conversations", "conv_id", "turn", "role", "text"))
