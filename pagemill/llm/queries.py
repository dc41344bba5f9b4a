"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.shared import spread
from pagemill.llm import chat, decontaminate, language, neardup, packing, sharding, token_counts, topk, toxicity, url_filter
from pagemill.llm import sql as oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out over the cores if it is small and has fewer splits."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


@_query("op1_near_duplicates", oracle.NEAR_DUPLICATES)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near-duplicates."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op2_external_shuffle")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a random order, dealt to 8 shards of as many rows each."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = sharding.shuffle_shards(docs, shards=8)
    text = F.coalesce(F.col("text"), F.lit(""))
    return found.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(f"{name}.shard").alias("shard"),
        F.col(f"{name}.slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query("op3_top_k", oracle.TOP_K)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every vector whose id 20 divides."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


#: The rules of op4, as (verdict, host, path).
URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


@_query("op4_url_filter", oracle.URL_FILTER)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules; a URL that none fits is allowed."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    found, name = url_filter.judge(pages, URL_RULES, default="allow")
    return found.select("page_id", *[F.col(f"{name}.{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


def language_model(spark: SparkSession, docs: DataFrame) -> language.Model:
    """Learned from the text and lang of the documents that op5 doesn't hold out; without any, no language is known."""
    try:
        return language.fit(docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    except language.NothingToLearn:
        return language.NO_LANGUAGES


@_query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model that has not seen a fifth of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_model(spark, docs)
    found, name = language.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        language.held_out(F.col("doc_id")).alias("held_out"),
        F.col(f"{name}.lang").alias("lang_pred"),
        F.col(f"{name}.score").alias("score"),
        F.col(f"{name}.rejected").alias("rejected"),
    )


def toxicity_model(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from the labelled documents that op7 doesn't hold out."""
    own = labels.where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic")
    return toxicity.fit(docs.select("doc_id", "text"), own)


@_query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model that has not seen a third of the labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = toxicity.score(docs, toxicity_model(spark, docs, _table(spark, sf_dir, "labels")))
    s = F.col(f"{name}.score")
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), (s >= 0.7).cast("int").alias("predicted"))


@_query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; texts of over 512 tokens are marked."""
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    # bytes are counted before the join with the counts, which then moves no texts
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", n_bytes.alias("n_bytes"))
    found, name = token_counts.count_tokens(docs)
    n = F.col(f"{name}.n_tokens")
    return found.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > 512).alias("over_limit"))


@_query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 1024 tokens, and their places in sequences."""
    packed = packing.pack(_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query("op9_decontamination", oracle.DECONTAMINATION)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words inside occurrences of ten-word windows of benchmark items."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = decontaminate.scan(docs, _table(spark, sf_dir, "benchmark"))
    spans, items = F.col(f"{name}.spans"), F.col(f"{name}.items")
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["word_to"] - s["word_from"])
    return found.select(
        "doc_id",
        F.col(f"{name}.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(items)).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@_query("op10_quotation_linking", oracle.QUOTATION_LINKING)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, with the message that it answers and its place in the thread."""
    found = chat.link_quotes(_table(spark, sf_dir, "conversations"))
    # the links as text: level, source, and whether that message holds the passage whole
    one = lambda x: F.concat_ws(":", x["level"].cast("string"), x["source"].cast("string"), F.when(x["whole"], "whole").otherwise("first"))
    return found.withColumn("links", F.array_join(F.transform("links", one), ","))
