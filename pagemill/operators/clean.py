"""The rule cascade: which blocks are narrative, and why the others are not.

The first rule that fits decides. Whether a block lies in a skipped section depends on the latest
earlier signal only, and signals depend on labels and headings only; so the carried state is one
window over (doc_id, ord), and the whole cascade shares its exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import patterns as P
from pagemill.functions import text as X


@dataclass(frozen=True)
class Options:
    """What may be switched; the defaults are those of a document that is to be read aloud."""

    language: str = "auto"
    drop_references: bool = True
    drop_acknowledgements: bool = True
    drop_appendices: bool = True
    remove_citations: bool = True
    keep_headings: bool = True
    nfkc: bool = True
    furniture_chars: int = 90
    furniture_count: int = 3


def with_furniture(blocks: DataFrame, o: Options = Options()) -> DataFrame:
    """``furniture``: the lower-cased text stands three times or more in the document, and is short."""
    key = F.lower("norm")
    n = F.count(F.lit(1)).over(W.partitionBy("doc_id", key))
    return blocks.withColumn("furniture", (F.col("norm") != "") & (F.char_length(key) <= o.furniture_chars) & (n >= o.furniture_count))


def in_skipped_section(signal: Column) -> Column:
    """Whether the latest signal up to a block of its document says so; blocks before any are in none."""
    upto = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.coalesce(F.last(signal, ignorenulls=True).over(upto), F.lit(False))


def classify(blocks: DataFrame, o: Options = Options()) -> DataFrame:
    """Blocks with ``norm``, ``rule`` (null if kept), ``bucket`` (label or rule), ``emitted`` and ``out``.

    A heading without a rule is emitted if headings are kept, and counted nowhere otherwise.
    """
    label = F.lower(X.trimmed(F.coalesce("label", F.lit(""))))
    b = blocks.withColumn("label", label).withColumn("norm", X.normalized(F.coalesce("text", F.lit("")), o.nfkc))
    # one exchange by document serves both windows
    b = with_furniture(b.repartition("doc_id"), o)
    early = (
        F.when(F.col("norm") == "", "empty")
        .when(F.col("label").isin(*P.DROP_LABELS), F.col("label"))
        .when((F.col("label") != "") & ~F.col("label").isin(*P.KEEP_LABELS) & X.is_non_prose(F.col("norm")), F.concat(F.lit("non_prose:"), "label"))
        .when(F.col("furniture"), "repeated_furniture")
    )
    b = b.withColumn("early", early)
    heading = F.col("early").isNull() & F.col("label").isin(*P.HEADING_LABELS)
    b = b.withColumn("heading", F.when(heading, X.heading_class(F.col("norm"), o.drop_references, o.drop_acknowledgements, o.drop_appendices)))
    signal = F.when((F.col("norm") != "") & (F.col("label") == "reference"), True).when(F.col("heading") == "drop", True).when(F.col("heading").isin("keep", "unknown"), False)
    b = b.withColumn("skipping", in_skipped_section(signal))
    prose = F.when(F.col("skipping"), "section_skip")
    for name, fits, _ in X.PROSE_RULES:
        prose = prose.when(fits(F.col("norm")), name)
    late = F.when(F.col("heading").isin("drop", "drop_heading_only"), "section_heading_drop").when(F.col("heading").isNull(), prose)
    b = b.withColumn("rule", F.coalesce("early", late))
    out = F.col("norm")
    if o.remove_citations:
        out = F.when(F.col("heading").isNotNull(), out).otherwise(X.normalized(X.without_citations(out), False))
    b = b.withColumn("out", F.when(F.col("rule").isNull(), out))
    b = b.withColumn("rule", F.coalesce("rule", F.when(F.col("out") == "", "citations_only")))
    emitted = F.col("rule").isNull() & (F.col("heading").isNull() | F.lit(o.keep_headings))
    bucket = F.when(F.col("rule").isNotNull(), F.when((F.col("rule") == F.col("label")) & F.col("label").isin(*P.DROP_LABELS), "label").otherwise("rule"))
    return b.withColumn("emitted", emitted).withColumn("bucket", bucket).withColumn("out", F.when(emitted, F.col("out"))).drop("early")


def drop_counts(classified: DataFrame) -> DataFrame:
    """(doc_id, bucket, rule, n) of dropped blocks."""
    return classified.where(F.col("rule").isNotNull()).groupBy("doc_id", "bucket", "rule").agg(F.count(F.lit(1)).alias("n"))


def stats(classified: DataFrame) -> DataFrame:
    """Counters of each document, and the drop counters as two maps."""
    # kept blocks are the group without a rule, so one pass over the blocks counts everything
    pages = F.collect_set(F.when(F.col("page_no") > 0, F.col("page_no")))
    groups = classified.groupBy("doc_id", "bucket", "rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("emitted").alias("kept"), pages.alias("pages"))
    of = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("bucket") == k, F.struct("rule", "n")))))
    found = groups.groupBy("doc_id").agg(
        F.sum("n").alias("total"),
        F.sum("kept").alias("kept"),
        (F.sum("n") - F.sum("kept")).alias("dropped"),
        F.size(F.array_distinct(F.flatten(F.collect_list("pages")))).cast("bigint").alias("pages"),
        of("rule").alias("dropped_by_rule"),
        of("label").alias("dropped_by_label"),
    )
    return found


def formatted_counts(counts: Column) -> Column:
    """A counter map as sorted "k=v" pairs."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
