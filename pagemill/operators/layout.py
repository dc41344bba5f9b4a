"""Layout: text inside or beside pictures, tables and captions goes; regions are filtered and deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X

MARGIN = 12.0
TITLE_MARGIN = 30.0
TITLE_CHARS = 60


def expanded(box: Column, margin: float, normalize_origin: bool = False) -> Column:
    """The box with a margin. Boxes with a bottom-left origin shrink in height, unless their origin is normalised."""
    top = F.least(box["top"], box["bottom"]) if normalize_origin else box["top"]
    bottom = F.greatest(box["top"], box["bottom"]) if normalize_origin else box["bottom"]
    return F.struct((box["left"] - margin).alias("left"), (top - margin).alias("top"), (box["right"] + margin).alias("right"), (bottom + margin).alias("bottom"))


def overlap(a: Column, b: Column) -> Column:
    """Open intervals: boxes that touch don't overlap."""
    lo, hi = lambda x, p, q: F.least(x[p], x[q]), lambda x, p, q: F.greatest(x[p], x[q])
    across = (hi(a, "left", "right") > lo(b, "left", "right")) & (hi(b, "left", "right") > lo(a, "left", "right"))
    down = (hi(a, "top", "bottom") > lo(b, "top", "bottom")) & (hi(b, "top", "bottom") > lo(a, "top", "bottom"))
    return across & down


def _grown(regions: DataFrame, margin: float, normalize_origin: bool) -> DataFrame:
    return regions.select("doc_id", "page_no", expanded(F.col("bbox"), MARGIN if margin < 0 else margin, normalize_origin).alias("box"))


def _near(box: Column, titled: Column, region: Column, normalize_origin: bool) -> Column:
    return overlap(box, region) | (titled & overlap(box, expanded(region, TITLE_MARGIN, normalize_origin)))


def _titled() -> Column:
    text = X.trimmed(F.coalesce("text", F.lit("")))
    return (F.char_length(text) <= TITLE_CHARS) & X.is_title_case(text)


def keep_outside(blocks: DataFrame, regions: DataFrame, margin: float = MARGIN, normalize_origin: bool = False) -> DataFrame:
    """Blocks that overlap no region of their page: an anti-join on document and page.

    Regions grow by ``margin`` (12 if negative); for short title-case text by 30 more. A block without
    a page or a box stays.
    """
    grown = _grown(regions, margin, normalize_origin)
    r = grown.select(F.col("doc_id").alias("r_doc"), F.col("page_no").alias("r_page"), F.col("box").alias("r_box"))
    near = _near(F.col("bbox"), _titled(), F.col("r_box"), normalize_origin)
    on = (F.col("doc_id") == F.col("r_doc")) & (F.col("page_no") == F.col("r_page")) & (F.col("page_no") != 0) & F.col("bbox").isNotNull() & near
    return blocks.join(r, on, "left_anti")


def with_inside(blocks: DataFrame, regions: DataFrame, margin: float = MARGIN, normalize_origin: bool = False) -> DataFrame:
    """``blocks`` with ``inside``: whether ``keep_outside`` would drop them. A page's regions join as one small array."""
    grown = _grown(regions.where(F.col("page_no") != 0), margin, normalize_origin)
    pages = grown.groupBy("doc_id", "page_no").agg(F.collect_list("box").alias("_boxes"))
    near = F.exists("_boxes", lambda r: _near(F.col("bbox"), F.col("_titled"), r, normalize_origin))
    b = blocks.withColumn("_titled", _titled()).join(pages, ["doc_id", "page_no"], "left")
    return b.withColumn("inside", F.coalesce(F.col("bbox").isNotNull() & near, F.lit(False))).drop("_titled", "_boxes")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union has no area."""
    lo, hi = lambda x, p, q: F.least(x[p], x[q]), lambda x, p, q: F.greatest(x[p], x[q])
    side = lambda p, q: F.greatest(F.lit(0.0), F.least(hi(a, p, q), hi(b, p, q)) - F.greatest(lo(a, p, q), lo(b, p, q)))
    area = lambda x: F.abs((x["right"] - x["left"]) * (x["bottom"] - x["top"]))
    common = side("left", "right") * side("bottom", "top")
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def rectangle_regions(rects: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rectangles of a page that are large enough for a graphic, and no frame of the whole page.

    ``rects``: doc_id, page_no, seq, bbox (bottom-left origin); ``sizes``: doc_id, page_no, width, height.
    """
    r = rects.join(sizes.where("width > 0 and height > 0"), ["doc_id", "page_no"])
    box = F.struct(F.least("bbox.left", "bbox.right").alias("left"), F.greatest("bbox.top", "bbox.bottom").alias("top"), F.greatest("bbox.left", "bbox.right").alias("right"), F.least("bbox.top", "bbox.bottom").alias("bottom"))
    r = r.withColumn("bbox", box).withColumn("_w", F.col("bbox.right") - F.col("bbox.left")).withColumn("_h", F.col("bbox.top") - F.col("bbox.bottom"))
    share = F.col("_w") * F.col("_h") / (F.col("width") * F.col("height"))
    frame = (F.col("bbox.left") <= 4) & (F.col("bbox.bottom") <= 4) & (F.col("bbox.right") >= F.col("width") - 4) & (F.col("bbox.top") >= F.col("height") - 4)
    large = (F.col("_w") >= 72) & (F.col("_h") >= 42) & share.between(0.035, 0.72)
    return r.where(large & ~frame).select("doc_id", F.lit("graphic").alias("kind"), "page_no", "seq", "bbox")


def deduplicated(regions: DataFrame, most: float = 0.92) -> DataFrame:
    """The first of regions that are almost alike; one is compared with those kept before it only.

    Regions of a page are folded in order of ``seq`` (then of kind and box): whether a region stays depends on earlier decisions.
    """
    pages = regions.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "bbox"))).alias("all"))
    none = F.filter(F.col("all"), lambda x: F.lit(False))
    kept = F.aggregate("all", none, lambda acc, x: F.when(F.exists(acc, lambda k: iou(k["bbox"], x["bbox"]) > most), acc).otherwise(F.array_append(acc, x)))
    return pages.select("doc_id", "page_no", F.explode(kept).alias("r")).select("doc_id", "r.kind", "page_no", "r.seq", "r.bbox")


def caption_regions(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("label") == "caption") & F.col("bbox").isNotNull()).select("doc_id", F.lit("caption").alias("kind"), "page_no", "bbox")


def all_regions(graphics: DataFrame, blocks: DataFrame) -> DataFrame:
    """Graphics and captions together."""
    return graphics.select("doc_id", "kind", "page_no", "bbox").unionByName(caption_regions(blocks))
