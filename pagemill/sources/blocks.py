"""Tables of blocks: doc_id, ord, text, label, page_no, bbox."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("left", "top", "right", "bottom")])
BLOCKS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("bbox", BBOX),
    ]
)
_NO_BOX = "struct<left:double,top:double,right:double,bottom:double>"


def from_documents(docs: DataFrame) -> DataFrame:
    """One block for each line of a document, in order; no geometry, page unknown."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return lines.select("doc_id", "ord", "text", F.lit("paragraph").alias("label"), F.lit(0).alias("page_no"), F.lit(None).cast(_NO_BOX).alias("bbox"))


#: HTML elements and the labels of their text.
HTML_LABELS = {"title": "title", "h1": "section_header", "h2": "section_header", "p": "paragraph", "li": "list_item", "nav": "page_header", "footer": "page_footer"}
_SCRIPTS = r"(?is)<(script|style)\b.*?</(script|style)>"
_INLINE = r"(?i)</?(?:a|b|i|em|strong|span|br)\b[^>]*>"
_ELEMENT = r"(?i)<(title|h1|h2|p|li|nav|footer)(?:[ \t\n\r][^>]*)?>([^<]*)"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Labelled blocks of HTML pages: the text that follows an element's tag; scripts and styles go first."""
    html = F.regexp_replace(F.regexp_replace("html", _SCRIPTS, ""), _INLINE, "")
    pieces = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all(html, F.lit(_ELEMENT), F.lit(0))).alias("ord", "piece"))
    text = F.regexp_extract("piece", _ELEMENT, 2)
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    element = F.lower(F.regexp_extract("piece", _ELEMENT, 1))
    labels = F.create_map(*[F.lit(x) for pair in HTML_LABELS.items() for x in pair])
    return pieces.select("doc_id", "ord", text.alias("text"), labels[element].alias("label"), F.lit(0).alias("page_no"), F.lit(None).cast(_NO_BOX).alias("bbox"))


def sql_from_pages() -> str:
    """The same blocks in DuckDB SQL, as a query."""
    html = f"regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', '', 'g'), '{_INLINE}', '', 'g')"
    text = f"regexp_extract(piece, '{_ELEMENT}', 2)"
    for entity, char in _ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, entity, char.replace("'", "''"))
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HTML_LABELS.items())
    return f"""SELECT doc_id, CAST(ord - 1 AS INTEGER) AS ord, {text} AS text, CASE lower(regexp_extract(piece, '{_ELEMENT}', 1)) {labels} END AS label
FROM (SELECT page_id AS doc_id, unnest(range(1, len(pieces) + 1)) AS ord, unnest(pieces) AS piece FROM (SELECT page_id, regexp_extract_all({html}, '{_ELEMENT}') AS pieces FROM pages))"""


def from_messages(conversations: DataFrame) -> DataFrame:
    """Messages as blocks: a conversation is a document, a turn its place, a role its label."""
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), "text", F.lit("paragraph").alias("label"), F.lit(0).alias("page_no"), F.lit(None).cast(_NO_BOX).alias("bbox"))


def with_geometry(blocks: DataFrame) -> DataFrame:
    """Blocks placed on 612 x 792 pages in two columns, twelve to a page; the sixth spans both.

    Arithmetic on ord and doc_id alone: layout operators get an input where the source has none.
    """
    k = F.pmod("ord", F.lit(12))
    left_column = F.pmod(k + F.col("doc_id"), F.lit(2)) == 0
    left = F.when(k == 5, 30.0).when(left_column, 30.0).otherwise(320.0)
    right = F.when(k == 5, 590.0).when(left_column, 270.0).otherwise(590.0)
    top = 60.0 + 55.0 * k
    box = F.struct(left.alias("left"), top.alias("top"), right.alias("right"), (top + 30.0).alias("bottom"))
    return blocks.withColumn("page_no", (F.floor(F.col("ord") / 12) + 1).cast("int")).withColumn("bbox", box)


def page_sizes(blocks: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    return blocks.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(width).alias("width"), F.lit(height).alias("height"))


def picture_regions(blocks: DataFrame) -> DataFrame:
    """One picture on every third page, to go with ``with_geometry``."""
    box = F.struct(F.lit(180.0).alias("left"), F.lit(300.0).alias("top"), F.lit(400.0).alias("right"), F.lit(400.0).alias("bottom"))
    pages = blocks.where(F.pmod(F.col("doc_id") + F.col("page_no"), F.lit(3)) == 0).select("doc_id", "page_no").distinct()
    return pages.select("doc_id", F.lit("picture").alias("kind"), "page_no", box.alias("bbox"))


SQL_GEOMETRY = """
block AS (
  SELECT doc_id, CAST(ord - 1 AS INTEGER) AS ord, text FROM (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS ord, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
), placed AS (
  SELECT doc_id, ord, text, CAST(ord // 12 + 1 AS INTEGER) AS page_no,
         CASE WHEN ord % 12 = 5 OR (ord % 12 + doc_id) % 2 = 0 THEN 30.0 ELSE 320.0 END AS l,
         CASE WHEN ord % 12 = 5 THEN 590.0 WHEN (ord % 12 + doc_id) % 2 = 0 THEN 270.0 ELSE 590.0 END AS r,
         60.0 + 55.0 * (ord % 12) AS t, 90.0 + 55.0 * (ord % 12) AS b
  FROM block
)"""
