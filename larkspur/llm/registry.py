"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, chat, decontamination, divergence, hpylm, language, line_dedup, minhash, mixing, oracles, periodic, quality, sharding, url_filter
from larkspur.llm.common import fold, table

RULES = (
    url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"), url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
)
#: The list of blocked URLs is drawn, as a crawl's reports would be: pages whose md5 of page_id begins with this digit report
#: their URL, about one in 16. Hosts are hit in part, and a listed URL blocks all pages with the same canonical one.
REPORTED = "7"
#: Of the mix's sources, in turn.
WEIGHTS = (5, 2, 1)
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


#: The conversation whose texts hold the template's own control strings.
TRICKY = r"\### Assistant: </turn> ok"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat.read_back(chat.format_chats(rows.unionByName(extra)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = F.col("items")
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    fitted = language.fit(docs.where(~held_out))
    return language.identify(docs.drop("lang").withColumn("held_out", held_out), fitted).drop("text")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 7) == 2)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(docs.select("doc_id", bpe.round_trip(F.col("text"), path).alias("_both")).select("doc_id", "_both.*"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    reported = pages.where(F.md5(F.col("page_id").cast("string").cast("binary")).startswith(REPORTED))
    out = url_filter.judge(pages, reported.select("url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.judge(docs, ratios).drop("text")
    return out.select(*[c for c in out.columns if c != "score"], "score")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), WEIGHTS)
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """The contract's documents: where h % 10 = 0, the words from a on repeat the first p of them; null ids count as empty."""
    words = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))
    n = F.nullif(F.size(words).cast("long"), F.lit(0).cast("long"))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    period = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.concat(F.slice(words, F.lit(1), a), F.slice(period, F.lit(1), (n - a).cast("int")))
    return docs.withColumn("text", F.when((h % 10 == 0) & n.isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_period(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic.digest(periodic.collapse(docs)).drop("text")


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_formatting, op2_minhash_dedup, op3_sharding, op4_url_filter, op5_decontamination, op6_line_dedup, op7_language_id, op8_lm_scoring, op9_quality_rules, op10_bpe, op11_source_mixing, op12_periodic_runs, op13_divergence_audit)}


def oracle_sql() -> dict[str, str]:
    """For the others SQL has no hashed signatures, trained models, xxhash64 or byte-pair merges, or is too slow."""
    return {"op1_chat_formatting": oracles.OP1, "op3_sharding": oracles.op3(SHARDS), "op4_url_filter": oracles.op4(RULES, REPORTED), "op5_decontamination": oracles.OP5, "op11_source_mixing": oracles.OP11, "op13_divergence_audit": oracles.OP13}
