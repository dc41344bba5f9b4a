"""Queries of layout and reading order, over lines placed on synthetic two-column pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import document, layout, reading_order
from pagemill.operators import lines as L
from pagemill.plans.cleaning import SQL_TEXTS, lines, sql_cascade
from pagemill.plans.registry import query
from pagemill.sources import blocks as B

_SQL = f"WITH {B.SQL_GEOMETRY}"


def placed(spark, sf_dir):
    return B.with_geometry(lines(spark, sf_dir))


def _near(margin: str) -> str:
    return f"b.r > 180 - {margin} AND 400 + {margin} > b.l AND b.b > 300 - {margin} AND 400 + {margin} > b.t"


_INSIDE = f"""((doc_id + page_no) % 3 = 0 AND (({_near("12")})
  OR (length({X.sql_trimmed("text")}) <= 60 AND {X.sql_is_title_case(X.sql_trimmed("text"))} AND {_near("42")})))"""


@query("layout_anti_join", f"{_SQL} SELECT doc_id, ord, page_no FROM placed b WHERE NOT {_INSIDE}")
def layout_anti_join(spark, sf_dir):
    b = placed(spark, sf_dir)
    return layout.keep_outside(b, B.picture_regions(b)).select("doc_id", "ord", "page_no")


#: Candidates for columns and their gap clusters.
_CLUSTERS = f"""{_SQL}, candidate AS (
  SELECT *, (l + r) / 2 AS mid FROM placed WHERE r - l > 0 AND r - l < 306
), stepped AS (
  SELECT *, CASE WHEN mid - lag(mid) OVER (PARTITION BY doc_id, page_no ORDER BY mid, ord) >= 61.2 THEN 1 ELSE 0 END AS step, count(*) OVER (PARTITION BY doc_id, page_no) AS n_all FROM candidate
), clustered AS (
  SELECT *, sum(step) OVER (PARTITION BY doc_id, page_no ORDER BY mid, ord ROWS UNBOUNDED PRECEDING) AS cluster FROM stepped WHERE n_all >= 3
), col AS (
  SELECT doc_id, page_no, CAST(cluster AS INTEGER) AS cluster, count(*) AS n, CAST(sum(mid) AS DOUBLE) / count(*) AS center FROM clustered GROUP BY doc_id, page_no, cluster
)"""


@query("column_clusters", f"{_CLUSTERS} SELECT doc_id, page_no, cluster, n, center FROM col")
def column_clusters(spark, sf_dir):
    b = placed(spark, sf_dir)
    return reading_order.column_clusters(b, B.page_sizes(b)).select("doc_id", "page_no", "cluster", "n", "center")


@query("nearest_column", f"""{_CLUSTERS}, multi AS (SELECT doc_id, page_no, min(center) AS c0, max(center) AS c1 FROM col GROUP BY doc_id, page_no HAVING count(*) = 2)
SELECT doc_id, ord, CAST(CASE WHEN abs(c0 - (l + r) / 2) <= abs(c1 - (l + r) / 2) THEN 0 ELSE 1 END AS INTEGER) AS nearest,
       (r - l >= 0.6 * 612) OR (c0 BETWEEN l - 4 AND r + 4 AND c1 BETWEEN l - 4 AND r + 4) AS spans
FROM placed JOIN multi USING (doc_id, page_no)""")
def nearest_column(spark, sf_dir):
    b = placed(spark, sf_dir)
    x = b.join(reading_order.columns_of(b, B.page_sizes(b)), ["doc_id", "page_no"])
    mid = (F.col("bbox.left") + F.col("bbox.right")) / 2
    return x.select("doc_id", "ord", reading_order.nearest_column(F.col("centers"), mid).alias("nearest"), reading_order.spans_columns(F.col("bbox"), F.col("centers"), F.lit(612.0)).alias("spans"))


#: Every block's place in reading order.
_ORDERED = f"""{_CLUSTERS}, multi AS (SELECT doc_id, page_no, min(center) AS c0, max(center) AS c1 FROM col GROUP BY doc_id, page_no HAVING count(*) = 2
), item AS (
  SELECT p.*, c0 IS NOT NULL AS multi, c0 IS NOT NULL AND ((r - l >= 0.6 * 612) OR (c0 BETWEEN l - 4 AND r + 4 AND c1 BETWEEN l - 4 AND r + 4)) AS span,
         CASE WHEN c0 IS NOT NULL AND abs(c1 - (l + r) / 2) < abs(c0 - (l + r) / 2) THEN 1 ELSE 0 END AS col
  FROM placed p LEFT JOIN multi USING (doc_id, page_no)
), keyed AS (
  SELECT i.*, (SELECT count(*) FROM item s WHERE s.doc_id = i.doc_id AND s.page_no = i.page_no AND s.span AND CASE WHEN i.span THEN (s.t, s.ord) < (i.t, i.ord) ELSE s.t <= i.t + 3 END) AS seg FROM item i
), ordered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, CASE WHEN multi THEN seg ELSE 0 END, CASE WHEN span THEN 2 ELSE CASE WHEN multi THEN col ELSE 0 END END, t, ord) - 1 AS INTEGER) AS new_ord FROM keyed
)"""


@query("reading_order", f"{_ORDERED} SELECT doc_id, ord, new_ord FROM ordered")
def reading_order_query(spark, sf_dir):
    b = placed(spark, sf_dir)
    return reading_order.repaired(b, B.page_sizes(b)).select("doc_id", "ord", "new_ord")


def in_many_columns(spark, sf_dir):
    """The same lines in one to seven columns, by document, with a wide block now and then."""
    b = lines(spark, sf_dir)
    n, k = F.pmod("doc_id", F.lit(7)) + 1, F.pmod("ord", F.lit(20))
    left = 10.0 + 84.0 * F.pmod(k * 3, n)
    box = F.struct(left.alias("left"), (40.0 + 30.0 * k).alias("top"), F.when(k == 13, 600.0).otherwise(left + 60.0).alias("right"), (60.0 + 30.0 * k).alias("bottom"))
    return b.withColumn("page_no", (F.floor(F.col("ord") / 20) + 1).cast("int")).withColumn("bbox", box)


# clusters are joined pair by pair until four are left; with centers 84 points apart the first pair is always the nearest
_MANY = f"""WITH RECURSIVE {B.SQL_GEOMETRY.split("), placed AS")[0]}), placed AS (
  SELECT doc_id, ord, CAST(ord // 20 + 1 AS INTEGER) AS page_no, 10.0 + 84.0 * ((ord % 20 * 3) % (doc_id % 7 + 1)) AS l, CASE WHEN ord % 20 = 13 THEN 600.0 ELSE 70.0 + 84.0 * ((ord % 20 * 3) % (doc_id % 7 + 1)) END AS r, 40.0 + 30.0 * (ord % 20) AS t FROM block
), narrow AS (
  SELECT doc_id, page_no, CAST((l + r) / 2 AS DOUBLE) AS mid, count(*) OVER (PARTITION BY doc_id, page_no) AS n_all FROM placed WHERE r - l < 306
), col AS (
  SELECT doc_id, page_no, mid, count(*) AS n FROM narrow WHERE n_all >= 3 GROUP BY doc_id, page_no, mid
), merging AS (
  SELECT doc_id, page_no, list({{'total': mid * n, 'n': CAST(n AS DOUBLE)}} ORDER BY mid) AS c FROM col GROUP BY doc_id, page_no
  UNION ALL
  SELECT doc_id, page_no, list_concat(c[1 : p - 1], [{{'total': c[p].total + c[p + 1].total, 'n': c[p].n + c[p + 1].n}}], c[p + 2 :]) AS c FROM (
    SELECT *, list_position(gaps, list_min(gaps)) AS p FROM (SELECT *, list_transform(range(1, len(c)), lambda i: c[i + 1].total / c[i + 1].n - c[i].total / c[i].n) AS gaps FROM merging WHERE len(c) > 4))
), multi AS (
  SELECT doc_id, page_no, list_transform(c, lambda x: x.total / x.n) AS centers FROM merging WHERE len(c) BETWEEN 2 AND 4
), away AS (
  SELECT p.*, centers, r - l >= 0.6 * 612 OR len(list_filter(centers, lambda c: c BETWEEN l - 4 AND r + 4)) >= 2 AS wide, list_transform(centers, lambda c: abs(c - (l + r) / 2)) AS d FROM placed p LEFT JOIN multi USING (doc_id, page_no)
), item AS (
  SELECT *, centers IS NOT NULL AS multi, centers IS NOT NULL AND wide AS span, CASE WHEN centers IS NOT NULL THEN list_position(d, list_min(d)) - 1 END AS nearest FROM away
), keyed AS (
  SELECT i.*, (SELECT count(*) FROM item s WHERE s.doc_id = i.doc_id AND s.page_no = i.page_no AND s.span AND CASE WHEN i.span THEN (s.t, s.ord) < (i.t, i.ord) ELSE s.t <= i.t + 3 END) AS seg FROM item i
)"""


@query("many_columns", f"{_MANY} SELECT doc_id, page_no, len(centers) AS n, round(list_sum(centers), 6) AS total FROM multi")
def many_columns(spark, sf_dir):
    b = in_many_columns(spark, sf_dir)
    c = F.col("centers")
    return reading_order.columns_of(b, B.page_sizes(b)).select("doc_id", "page_no", F.size(c).cast("bigint").alias("n"), F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("reading_order_of_many_columns", f"""{_MANY}
SELECT doc_id, ord, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, CASE WHEN multi THEN seg ELSE 0 END, CASE WHEN span THEN 9 WHEN multi THEN nearest ELSE 0 END, t, ord) - 1 AS INTEGER) AS new_ord FROM keyed""")
def reading_order_of_many_columns(spark, sf_dir):
    b = in_many_columns(spark, sf_dir)
    return reading_order.repaired(b, B.page_sizes(b)).select("doc_id", "ord", "new_ord")


def _rects(spark, sf_dir):
    """Rectangles made of order lines: a document's page is an order, a line a rectangle."""
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    left, bottom = F.pmod("l_partkey", F.lit(200)).cast("double"), F.pmod("l_suppkey", F.lit(90)).cast("double")
    box = F.struct(left.alias("left"), (bottom + F.pmod("l_partkey", F.lit(700))).alias("top"), (left + F.pmod("l_orderkey", F.lit(500))).alias("right"), bottom.alias("bottom"))
    return r.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.col("l_linenumber").cast("int").alias("seq"), box.alias("bbox"))


_SQL_RECTS = """WITH rect AS (
  SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS seq, CAST(l_partkey % 200 AS DOUBLE) AS l, CAST(l_suppkey % 90 AS DOUBLE) AS b, CAST(l_orderkey % 500 AS DOUBLE) AS w, CAST(l_partkey % 700 AS DOUBLE) AS h FROM lineitem
), large AS (
  SELECT * FROM rect WHERE w >= 72 AND h >= 42 AND w * h / (612.0 * 792.0) BETWEEN 0.035 AND 0.72 AND NOT (l <= 4 AND b <= 4 AND l + w >= 608 AND b + h >= 788)
)"""


@query("region_filter", f"{_SQL_RECTS} SELECT doc_id, seq, l AS \"left\", b + h AS top, l + w AS \"right\", b AS bottom FROM large")
def region_filter(spark, sf_dir):
    r = _rects(spark, sf_dir)
    return layout.rectangle_regions(r, B.page_sizes(r)).select("doc_id", "seq", "bbox.left", "bbox.top", "bbox.right", "bbox.bottom")


_AREA = "(greatest(0, least(p.l + p.w, q.l + q.w) - greatest(p.l, q.l)) * greatest(0, least(p.b + p.h, q.b + q.h) - greatest(p.b, q.b)))"


@query("region_iou", f"{_SQL_RECTS} SELECT p.doc_id, p.seq AS a, q.seq AS b, round({_AREA} / (p.w * p.h + q.w * q.h - {_AREA}), 9) AS iou FROM large p JOIN large q ON p.doc_id = q.doc_id AND p.seq < q.seq")
def region_iou(spark, sf_dir):
    r = _rects(spark, sf_dir)
    g = layout.rectangle_regions(r, B.page_sizes(r)).select("doc_id", "seq", "bbox")
    x, y = g.select("doc_id", F.col("seq").alias("a"), F.col("bbox").alias("p")), g.select("doc_id", F.col("seq").alias("b"), F.col("bbox").alias("q"))
    return x.join(y, "doc_id").where("a < b").select("doc_id", "a", "b", F.round(layout.iou(F.col("p"), F.col("q")), 9).alias("iou"))


# one region after the other, compared with those kept so far
@query("region_dedup", f"""{_SQL_RECTS.replace("WITH rect", "WITH RECURSIVE rect")}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, l, b + h, l + w, b) AS k FROM large
), kept AS (
  SELECT doc_id, k, [{{'seq': seq, 'l': l, 'b': b, 'w': w, 'h': h}}] AS own FROM placed WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.k, CASE WHEN len(list_filter(own, lambda q: {_AREA} / (p.w * p.h + q.w * q.h - {_AREA}) > 0.92)) > 0 THEN own ELSE list_append(own, {{'seq': p.seq, 'l': p.l, 'b': p.b, 'w': p.w, 'h': p.h}}) END
  FROM kept JOIN placed p ON p.doc_id = kept.doc_id AND p.k = kept.k + 1
)
SELECT doc_id, 1 AS page_no, unnest(own).seq AS seq FROM (SELECT doc_id, arg_max(own, k) AS own FROM kept GROUP BY doc_id)""")
def region_dedup(spark, sf_dir):
    r = _rects(spark, sf_dir)
    return layout.deduplicated(layout.rectangle_regions(r, B.page_sizes(r))).select("doc_id", "page_no", "seq")


def _sized(spark, sf_dir):
    """Lines with a font and a size each, by arithmetic on their place and length."""
    b = placed(spark, sf_dir)
    n = F.char_length("text")
    return b.select("doc_id", "page_no", "ord", "text", F.concat(F.lit("f"), F.pmod(n, F.lit(3)).cast("string")).alias("font"), (F.pmod(n, F.lit(5)) + 8.0).alias("font_size"))


@query("median_font", f"{_SQL} SELECT doc_id, page_no, coalesce(median(CASE WHEN length(text) >= 3 THEN CAST(length(text) % 5 + 8 AS DOUBLE) END), 10.0) AS median FROM placed GROUP BY doc_id, page_no")
def median_font(spark, sf_dir):
    return L.median_sizes(_sized(spark, sf_dir))


#: How far a glyph stands above its line's baseline, by its place in the line: none, a little, or a superscript.
_RISE = "CASE WHEN k % 11 = 5 THEN 2.0 ELSE 0.25 * (k % 3) END"


def glyphs(spark, sf_dir, by_page=True):
    """Every word of lines as a glyph around baselines 12 points apart: a page is sixty lines, as wide as its longest needs.

    ``by_page``: dealt out by pages, for what is done with all glyphs of a page; a measure of pages needs no such exchange.
    """
    b = lines(spark, sf_dir).where("text <> ''").select("doc_id", (F.floor(F.col("ord") / 60) + 1).cast("int").alias("page_no"), "ord", "text")
    # pages are dealt out as lines: words would take several times the room
    b = b.repartition("doc_id", "page_no") if by_page else b
    w = b.select("doc_id", "page_no", "ord", F.posexplode(F.split("text", " ")).alias("k", "s"))
    y = 780.0 - 12.0 * F.pmod("ord", F.lit(60)) + F.expr(_RISE).cast("double")
    size = F.when(F.col("ord") == 0, 16.0).otherwise(10.0)
    font = F.when(F.col("k") % 4 == 3, "italic").otherwise("body")
    return w.select("doc_id", "page_no", (F.shiftleft(F.col("ord").cast("long"), 32) + F.col("k")).alias("seq"), "s", (30.0 + 45.0 * F.col("k")).alias("x"), y.alias("y"), F.lit(40.0).alias("w"), font.alias("font"), size.alias("font_size"))


#: The same glyphs, their lines, and these with their labels.
_SQL_GLYPHS = f"""WITH block AS (
  SELECT doc_id, ord - 1 AS ord, string_split(text, ' ') AS words FROM (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS ord, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE text <> ''
), word AS (
  SELECT doc_id, ord, CAST(ord // 60 + 1 AS INTEGER) AS page_no, unnest(range(len(words))) AS k, unnest(words) AS s FROM block
), glyph AS (
  SELECT *, 30.0 + 45.0 * k AS x, 780.0 - 12.0 * (ord % 60) + CAST({_RISE} AS DOUBLE) AS y, CASE WHEN ord = 0 THEN 16.0 ELSE 10.0 END AS size FROM word
)"""
_SQL_LINES = f"""{_SQL_GLYPHS}, line AS (
  SELECT doc_id, page_no, ord, {X.sql_trimmed(r"regexp_replace(string_agg(s, ' ' ORDER BY k), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g')")} AS text,
         min(x) AS l, max(x) + 40 AS r, max(y + size) AS t, min(y) AS b, CAST(any_value(size) AS DOUBLE) AS size
  FROM glyph WHERE {X.sql_trimmed("s")} <> '' GROUP BY doc_id, page_no, ord
)"""
_SQL_LABELS = f"""{_SQL_LINES}, page AS (
  SELECT doc_id, page_no, greatest(792.0, max(y + size + 18)) AS height FROM glyph GROUP BY doc_id, page_no
), middle AS (
  SELECT *, coalesce(median(CASE WHEN length(text) >= 3 THEN size END) OVER (PARTITION BY doc_id, page_no), 10.0) AS median FROM line JOIN page USING (doc_id, page_no)
), labelled AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ord) - 1 AS INTEGER) AS line_no, {L.sql_line_label("text", "size", "t", "b", "median", "height", "page_no")} AS label FROM middle
)"""


@query("glyph_lines", f"{_SQL_LINES} SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ord) - 1 AS INTEGER) AS line_no, text, l AS \"left\", t AS top, r AS \"right\", b AS bottom FROM line")
def glyph_lines(spark, sf_dir):
    return L.build_lines(glyphs(spark, sf_dir)).select("doc_id", "page_no", "line_no", "text", "left", "top", "right", "bottom")


def _labelled(spark, sf_dir):
    return L.labelled(L.build_lines(glyphs(spark, sf_dir)), L.page_dimensions(glyphs(spark, sf_dir, by_page=False)))


@query("line_labels", f"{_SQL_LABELS} SELECT doc_id, page_no, line_no, label, median FROM labelled")
def line_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", "page_no", "line_no", "label", "median")


# all lines begin at one place, so a block's box beside and below is that of its last line
@query("glyph_blocks", f"""{_SQL_LABELS}, stepped AS (
  SELECT *, lag(b) OVER above - t AS gap, lag(label) OVER above AS label_above, lag(text) OVER above AS text_above, lead(text) OVER above AS text_below FROM labelled WINDOW above AS (PARTITION BY doc_id, page_no ORDER BY line_no)
), marked AS (
  SELECT *, CASE WHEN label = label_above AND label IN ('paragraph', 'list_item') AND gap BETWEEN -0.35 * median AND greatest(0.95 * median, 5) THEN 0 ELSE 1 END AS new FROM stepped
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS no, coalesce(lead(new) OVER (PARTITION BY doc_id, page_no ORDER BY line_no), 1) AS ends FROM marked
), joined AS (
  SELECT doc_id, page_no, no, any_value(label) AS label, min(l) AS "left", max(t) AS top, max(r) AS "right", min(b) AS bottom,
         {X.sql_trimmed(r"string_agg(CASE WHEN ends = 0 AND ends_with(text, '-') AND regexp_matches(text_below, '^\p{Ll}') THEN left(text, length(text) - 1) WHEN ends = 0 THEN text || ' ' ELSE text END, '' ORDER BY line_no)")} AS text
  FROM numbered GROUP BY doc_id, page_no, no
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, no) - 1 AS INTEGER) AS ord, page_no, label, text, "left", top, "right", bottom FROM joined""")
def glyph_blocks(spark, sf_dir):
    b = L.group_lines(_labelled(spark, sf_dir))
    return b.select("doc_id", "ord", "page_no", "label", "text", "bbox.left", "bbox.top", "bbox.right", "bbox.bottom")


@query("page_dimensions", f"{_SQL_GLYPHS} SELECT doc_id, page_no, CAST(greatest(612, max(x + 58)) AS DOUBLE) AS width, CAST(greatest(792, max(y + size + 18)) AS DOUBLE) AS height FROM glyph GROUP BY doc_id, page_no")
def page_dimensions(spark, sf_dir):
    return L.page_dimensions(glyphs(spark, sf_dir, by_page=False))


@query("dominant_font", f"{_SQL_GLYPHS}, counted AS (SELECT doc_id, page_no, ord, CASE WHEN k % 4 = 3 THEN 'italic' ELSE 'body' END AS font, count(*) AS n FROM glyph WHERE {X.sql_trimmed('s')} <> '' GROUP BY ALL) SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ord) - 1 AS INTEGER) AS line_no, arg_min(font, (-n, font)) AS font FROM counted GROUP BY doc_id, page_no, ord")
def dominant_font(spark, sf_dir):
    return L.build_lines(glyphs(spark, sf_dir)).select("doc_id", "page_no", "line_no", "font")


_SQL_PROCESSED = f"""{_ORDERED}, pictured AS (
  SELECT doc_id, count(DISTINCT page_no) AS regions FROM placed WHERE (doc_id + page_no) % 3 = 0 GROUP BY doc_id
), every AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT page_no) AS pages FROM placed GROUP BY doc_id
), outside AS (
  SELECT doc_id, new_ord AS ord, {X.sql_normalized("text")} AS norm FROM ordered b WHERE NOT {_INSIDE}
), {sql_cascade("outside")}, {SQL_TEXTS}, counts AS (
  SELECT doc_id, count(*) AS total, count(*) FILTER (rule IS NULL) AS kept FROM classified GROUP BY doc_id
), spoken AS (
  SELECT doc_id, text, coalesce(nullif({X.sql_detected_language("text")}, 'unknown'), 'en') AS effective_language FROM joined
)
SELECT doc_id, text, effective_language, pages, total, kept, total - kept AS dropped, n - total AS layout_dropped, coalesce(regions, 0) AS regions, 0 AS reviewed, 0 AS review_dropped
FROM spoken JOIN counts USING (doc_id) JOIN every USING (doc_id) LEFT JOIN pictured USING (doc_id)"""


@query("processed_documents", _SQL_PROCESSED)
def processed_documents(spark, sf_dir):
    b = placed(spark, sf_dir)
    d = document.processed(b, B.page_sizes(b), B.picture_regions(b))
    return d.select("doc_id", "text", "effective_language", "pages", "total", "kept", "dropped", "layout_dropped", "regions", "reviewed", "review_dropped")
