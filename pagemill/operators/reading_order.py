"""Reading order on pages of several columns.

Columns are gap clusters of the midpoints of narrow blocks: a lag and a running sum. A block that
spans columns closes a segment; segments come one after the other, inside them column after column,
inside these from top to bottom. All of that is one sort key, computed by windows over (doc_id,
page_no); the page's columns join as one small array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Shares of the page's width, distances in points, and the most columns.
SPANNING_SHARE = 0.60
GAP_SHARE = 0.10
NARROW_SHARE = 0.50
MOST_COLUMNS = 4
SPAN_MARGIN = 4.0
Y_TOLERANCE = 3.0

_PAGE = ["doc_id", "page_no"]


def y_of(box: Column, height: Column) -> Column:
    """The distance from the top of the page, whatever the box's origin; 0 without a box."""
    return F.when(box.isNull(), 0.0).when(box["top"] <= box["bottom"], box["top"]).otherwise(height - box["top"])


def _clustered(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks of pages of known size, with ``cluster`` for those that are narrow enough for a column, if the page has three of them."""
    b = blocks.where(F.col("page_no") != 0).join(sizes.where("width > 0 and height > 0"), _PAGE)
    width = F.col("bbox.right") - F.col("bbox.left")
    narrow = F.coalesce((width > 0) & (width < NARROW_SHARE * F.col("width")), F.lit(False))
    c = b.select(*_PAGE, "ord", "width", "height", narrow.alias("_narrow"), ((F.col("bbox.left") + F.col("bbox.right")) / 2).alias("mid"))
    order = W.partitionBy(*_PAGE, "_narrow").orderBy("mid", "ord")
    gap = F.col("mid") - F.lag("mid").over(order)
    c = c.withColumn("_new", F.when(gap >= GAP_SHARE * F.col("width"), 1).otherwise(0)).withColumn("_cluster", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    n = F.count(F.lit(1)).over(W.partitionBy(*_PAGE, "_narrow"))
    return c.withColumn("cluster", F.when(F.col("_narrow") & (n >= 3), F.col("_cluster").cast("int")))


def _by_cluster(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    return _clustered(blocks, sizes).groupBy(*_PAGE, "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("mid").alias("total"), F.first("width").alias("width"), F.first("height").alias("height"))


def column_clusters(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, page_no, cluster, n, center) of pages with at least three candidates; single clusters too."""
    return _by_cluster(blocks, sizes).where("cluster is not null").select(*_PAGE, "cluster", "n", (F.col("total") / F.col("n")).alias("center"))


def _merged_clusters(clusters: Column) -> Column:
    """While there are more than ``MOST_COLUMNS``, the two neighbours with the nearest centres become one."""
    center = lambda c: c["total"] / c["n"]

    def merge(acc: Column, _: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(acc) - 1), lambda i: F.struct((center(F.element_at(acc, i + 1)) - center(F.element_at(acc, i))).alias("gap"), i.alias("i")))
        at = F.array_min(gaps)["i"]
        pair = lambda i: F.struct((F.element_at(acc, i)["total"] + F.element_at(acc, i + 1)["total"]).alias("total"), (F.element_at(acc, i)["n"] + F.element_at(acc, i + 1)["n"]).alias("n"))
        both = F.flatten(F.transform(F.sequence(F.lit(1), F.size(acc)), lambda i: F.when(i == at, F.array(pair(at))).when(i == at + 1, F.slice(acc, 1, F.lit(0))).otherwise(F.array(F.element_at(acc, i)))))
        return F.when(F.size(acc) > MOST_COLUMNS, both).otherwise(acc)

    rounds = F.when(F.size(clusters) > MOST_COLUMNS, F.sequence(F.lit(1), F.size(clusters) - MOST_COLUMNS)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, clusters, merge)


def pages_of(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, page_no, width, height, centers) of pages of known size that have blocks; no centers without two columns."""
    own = F.filter(F.sort_array(F.collect_list(F.struct("cluster", "total", "n"))), lambda x: x["cluster"].isNotNull())
    c = _by_cluster(blocks, sizes).groupBy(*_PAGE).agg(own.alias("c"), F.first("width").alias("width"), F.first("height").alias("height"))
    bare = F.transform("c", lambda x: F.struct(x["total"].alias("total"), x["n"].alias("n")))
    centers = F.transform(_merged_clusters(bare), lambda x: x["total"] / x["n"])
    return c.select(*_PAGE, "width", "height", F.when(F.size("c") > 1, centers).alias("centers"))


def columns_of(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, page_no, centers): the columns of pages that have two or more."""
    return pages_of(blocks, sizes).where("centers is not null").select(*_PAGE, "centers")


def nearest_column(centers: Column, mid: Column) -> Column:
    """The index of the nearest centre; of equal ones the first."""
    return F.array_min(F.transform(centers, lambda c, i: F.struct(F.abs(c - mid).alias("d"), i.alias("i"))))["i"]


def spans_columns(box: Column, centers: Column, width: Column) -> Column:
    covered = F.size(F.filter(centers, lambda c: (c >= box["left"] - SPAN_MARGIN) & (c <= box["right"] + SPAN_MARGIN)))
    return (box["right"] - box["left"] >= SPANNING_SHARE * width) | (covered >= 2)


def repaired(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """``blocks`` with ``new_ord``, their place in reading order within the document, from 0.

    Unknown pages come last; pages without a size, or without any box, keep the input's order.
    """
    b = blocks.join(pages_of(blocks, sizes), _PAGE, "left")
    page = W.partitionBy(*_PAGE)
    b = b.withColumn("_boxes", F.count("bbox").over(page)).withColumn("_y", y_of(F.col("bbox"), F.col("height")))
    multi, boxed = F.col("centers").isNotNull(), F.col("bbox").isNotNull()
    mid = (F.col("bbox.left") + F.col("bbox.right")) / 2
    b = b.withColumn("_span", multi & boxed & spans_columns(F.col("bbox"), F.col("centers"), F.col("width")))
    b = b.withColumn("_col", F.when(multi & boxed & ~F.col("_span"), nearest_column(F.col("centers"), mid)).otherwise(0))
    spans = F.when(F.col("_span"), 1).otherwise(0)
    # a block belongs after all spanning blocks that begin at most the tolerance below it
    seen = F.coalesce(F.sum(F.when(boxed, spans)).over(page.orderBy("_y").rangeBetween(W.unboundedPreceding, int(Y_TOLERANCE))), F.lit(0))
    rank = F.sum(spans).over(page.orderBy("_y", "ord").rowsBetween(W.unboundedPreceding, W.currentRow))
    b = b.withColumn("_seg", F.when(F.col("_span"), rank).otherwise(seen))
    plain = F.col("width").isNull() | (F.col("_boxes") == 0)
    order = lambda a, c, d, e: F.struct(a.cast("int").alias("a"), c.cast("long").alias("b"), d.cast("int").alias("c"), e.cast("double").alias("d"))
    zero = F.lit(0)
    key = (
        F.when(plain, order(zero, zero, zero, zero))
        .when(~multi, order(zero, zero, zero, F.col("_y")))
        .when(~boxed, order(F.lit(1), zero, zero, zero))
        .when(F.col("_span"), order(zero, F.col("_seg") * 2 - 1, zero, F.col("_y")))
        .otherwise(order(zero, F.col("_seg") * 2, F.col("_col"), F.col("_y")))
    )
    place = F.row_number().over(W.partitionBy("doc_id").orderBy((F.col("page_no") == 0).cast("int"), "page_no", key, "ord")) - 1
    return b.withColumn("new_ord", place).select(*blocks.columns, "new_ord")
