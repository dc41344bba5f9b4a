"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (null as empty; byte-level BPE knows no other
normal form, so nothing else may change) joined with a digest of the tokenizer's name and version. Keys that the cache table has
are joined to their stored counts; of the others each distinct text is encoded once, and the new
counts are appended to the cache.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.shared import shared_dir
from pagemill.llm.common import WorkTables, fresh_name, map_arrow, slices
from pagemill.llm.tokens import encoder

CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def tokenizer_version(name: str) -> str:
    """A digest of the vocabulary file and of the library's version."""
    import public_tokenizers as public
    import tokenizers

    h = hashlib.sha256(tokenizers.__version__.encode())
    with open(public.path(name), "rb") as f:
        h.update(f.read())
    return h.hexdigest()[:32]


def read_cache(spark, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version; an absent cache is an empty one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE).select("digest", "n_tokens")
    stored = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == tokenizer)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode(name: str, ranks: str | None):
    def run(batches):
        count = encoder(name, ranks)
        for b in slices(batches):
            n = [len(count.ids(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame,
    cache_path: str | None = None,
    *,
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (digest, n_tokens), and that column's name.

    Null counts as the empty text, which has no tokens. Equal texts are encoded once, however many
    rows hold them: rows are combined by digest before and after the exchange, so a text held by a
    third of all rows costs one row a task. Texts are encoded whole, however long. A null or repeated id plays no part: every row
    gets its count. An empty table gives an empty one. ``cache_path`` None makes a cache for this call alone.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    cache_path = cache_path or f"{WorkTables(spark, 'token-cache').root}"
    name, text = fresh_name(docs.columns, "tokens"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # sha2() gives hexadecimal digits; half of the bytes are enough to keep and to exchange
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    stored = read_cache(spark, cache_path, version)
    texts = docs.select(digest.alias("digest"), text.alias("text")).dropDuplicates(["digest"])
    misses = texts.join(stored, "digest", "left_anti") if not _is_empty(stored) else texts
    counted = map_arrow(misses, _encode(tokenizer, ranks), "digest binary, n_tokens bigint")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache_path)
    key, n = fresh_name([*docs.columns, name], "key"), fresh_name([*docs.columns, name], "stored_n")
    counts = read_cache(spark, cache_path, version).select(F.col("digest").alias(key), F.col("n_tokens").alias(n))
    keyed = docs.withColumn(name, digest)
    joined = keyed.join(counts, F.col(f"`{name}`") == F.col(key), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(F.col(f"`{name}`").alias("digest"), F.col(n).alias("n_tokens")).alias(name)), name


def _is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def default_cache(spark) -> str:
    """A cache that later calls of any session share."""
    return f"{shared_dir(spark)}/token-counts"
