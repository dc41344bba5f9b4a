"""Whole documents: order, layout filter, optional review, cascade, text, counters. One lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import classifier, clean, fold, layout, lines, reading_order


def from_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, page sizes and regions for ``processed``, of pages as a reader gives them.

    ``pages`` (doc_id, page_no, error, width, height, glyphs, rects) is read several times, so it is best a written
    table. Boxes have a bottom-left origin.
    """
    glyphs = pages.select("doc_id", "page_no", F.explode("glyphs").alias("g")).select("doc_id", "page_no", "g.*")
    rects = pages.select("doc_id", "page_no", F.explode("rects").alias("r")).select("doc_id", "page_no", F.col("r.seq").alias("seq"), F.struct("r.left", "r.top", "r.right", "r.bottom").alias("bbox"))
    sizes = lines.page_dimensions(glyphs, pages.where("error is null").select("doc_id", "page_no", "width", "height"))
    blocks = lines.group_lines(lines.labelled(lines.build_lines(glyphs), sizes))
    return blocks, sizes, layout.all_regions(layout.deduplicated(layout.rectangle_regions(rects, sizes)), blocks)


def processed(
    blocks: DataFrame,
    sizes: DataFrame,
    regions: DataFrame,
    o: clean.Options = clean.Options(),
    review: Callable[[str], str] | None = None,
    margin: float = layout.MARGIN,
) -> DataFrame:
    """(doc_id, text, language, total, kept, dropped, layout_dropped, regions, reviewed, review_dropped, ...) of each document.

    A review sees what the layout filter left, and the cascade runs on what the review left; what it
    dropped counts as seen and dropped. Documents whose blocks all lie in regions are left out.
    """
    whole = W.partitionBy("doc_id")
    ordered = reading_order.repaired(blocks, sizes).withColumn("ord", F.col("new_ord")).drop("new_ord")
    # what is counted before blocks go is carried along by those that stay, so that blocks are made once
    pages = F.size(F.collect_set(F.when(F.col("page_no") > 0, F.col("page_no"))).over(whole)).cast("bigint")
    marked = layout.with_inside(ordered, regions, margin)
    marked = marked.withColumn("_all", F.count(F.lit(1)).over(whole)).withColumn("_kept", F.count_if(~F.col("inside")).over(whole)).withColumn("pages", pages)
    seen = marked.where(~F.col("inside")).drop("inside")
    if review is not None:
        batched = classifier.batches(seen)
        judged = classifier.verdicts(classifier.replies(classifier.prompts(batched), review))
        seen = classifier.applied(batched, judged).withColumn("ord", F.col("new_ord")).drop("new_ord", "batch")
    c = clean.classify(seen, o)
    n, rules = F.count(F.lit(1)), lambda bucket: F.collect_list(F.when(F.col("bucket") == bucket, F.col("rule")))
    one = lambda name: F.first(name).alias(name)
    found = c.groupBy("doc_id").agg(
        fold.merged(fold.emitted_parts()).alias("text"),
        n.alias("_seen"),
        F.count_if("emitted").alias("kept"),
        rules("rule").alias("_by_rule"),
        rules("label").alias("_by_label"),
        *[one(name) for name in ("_all", "_kept", "pages")],
    )
    found = found.withColumn("language", X.detected_language(F.col("text")))
    found = found.join(regions.groupBy("doc_id").agg(n.alias("_regions")), "doc_id", "left")
    removed = F.col("_kept") - F.col("_seen")
    return found.select(
        "doc_id",
        "text",
        "language",
        X.effective_language(F.col("language"), F.lit(o.language)).alias("effective_language"),
        "pages",
        F.col("_kept").alias("total"),
        "kept",
        (F.col("_kept") - F.col("kept")).alias("dropped"),
        _counted("_by_rule").alias("dropped_by_rule"),
        _counted("_by_label").alias("dropped_by_label"),
        (F.col("_all") - F.col("_kept")).alias("layout_dropped"),
        F.coalesce("_regions", F.lit(0)).alias("regions"),
        F.when(F.lit(review is not None), F.col("_kept")).otherwise(0).alias("reviewed"),
        removed.alias("review_dropped"),
    )


def _counted(rules: str) -> Column:
    """A map from each rule to how often the array names it; there are about thirty rules."""
    of = lambda r: F.struct(r.alias("rule"), F.size(F.filter(rules, lambda x: x == r)).cast("bigint").alias("n"))
    return F.map_from_entries(F.transform(F.sort_array(F.array_distinct(rules)), of))
