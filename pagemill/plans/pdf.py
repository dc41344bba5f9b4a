"""Queries of the PDF reader: messages are drawn as files, and read again.

A message's lines stand 12 points apart, sixty to a page, each character by a code of its own; a
rectangle goes with each page, and every tenth file ends with a page that can't be read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions.shipping import ship
from pagemill.operators import layout
from pagemill.operators import lines as L
from pagemill.plans.registry import query
from pagemill.sources import pdf

_LINES_A_PAGE = 60


def drawn(number: int, text: str) -> bytes:
    """A file that shows a text: with compressed streams, inherited boxes and, for even numbers, packed objects."""
    lines = text.split("\n")
    chars = sorted(set(text) - {"\n"})
    code = {c: k + 1 for k, c in enumerate(chars)}
    bodies: dict[int, bytes] = {}

    def stream(data: bytes, info: bytes = b"") -> bytes:
        packed = zlib.compress(data)
        return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n%s\nendstream" % (len(packed), info, packed)

    maps = b"".join(b"1 beginbfchar\n<%04X> <%s>\nendbfchar\n" % (k, c.encode("utf-16-be", "ignore").hex().encode()) for c, k in code.items())
    bodies[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Own /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>"
    bodies[4] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Own /DW 500 /W [1 [500] 2 %d 500] >>" % (len(chars) + 2)
    streams = {5: stream(maps)}
    pages, at = [], 6
    for i in range(0, len(lines), _LINES_A_PAGE):
        shown = [b"q 1 0 0 1 10 20 cm 0 0 %d 200 re S Q BT /F1 10 Tf 1 0 0 1 30 780 Tm 12 TL" % (100 + number % 300)]
        for line in lines[i : i + _LINES_A_PAGE]:
            codes = b"".join(b"%04X" % code[c] for c in line)
            half = len(codes) // 8 * 4  # a line is shown in two parts
            shown.append(b"[<%s> 0 <%s>] TJ T*" % (codes[:half], codes[half:]))
        streams[at + 1] = stream(b"\n".join([*shown, b"ET"]))
        pages.append((at, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (at + 1)))
        at += 2
    if number % 10 == 3:
        streams[at + 1] = b"<< /Length 4 /Filter /FlateDecode >>\nstream\njunk\nendstream"
        pages.append((at, b"<< /Type /Page /Parent 2 0 R /Contents [%d 0 R] >>" % (at + 1)))
    bodies |= dict(pages)
    width = 60 + 5 * max(map(len, lines))
    bodies[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    bodies[2] = b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 %d 842] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), b" ".join(b"%d 0 R" % n for n, _ in pages), width)
    if number % 2 == 0:
        head, body = b"", b""
        for n, b in bodies.items():
            head += b"%d %d " % (n, len(body))
            body += b + b"\n"
        streams[900_000] = stream(head + body, b"/Type /ObjStm /N %d /First %d" % (len(bodies), len(head)))
        bodies = {}
    out = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted((bodies | streams).items()))
    return out + b"trailer\n<< /Root 1 0 R /Size %d >>\n%%%%EOF\n" % (900_001)


def pages(spark, sf_dir):
    """Messages as files, as read: doc_id is made of conversation and turn."""
    m = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), "text")
    ship(spark)

    def files(batches):
        import pyarrow as pa

        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([str(n) for n, _ in rows]), pa.array([drawn(n, t or "") for n, t in rows], pa.binary())], names=["path", "content"])

    found = pdf.read_pages(m.mapInArrow(files, "path string, content binary"))
    return found.withColumn("doc_id", F.col("path").cast("bigint"))


_SQL = f"""WITH line AS (
  SELECT doc_id, k, CAST(k // {_LINES_A_PAGE} + 1 AS INTEGER) AS page_no, t FROM (
    SELECT doc_id, unnest(range(len(ls))) AS k, unnest(ls) AS t FROM (SELECT conv_id * 100000 + turn AS doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations))
), shown AS (
  SELECT doc_id, k, page_no, {X.sql_trimmed(r"regexp_replace(t, '[\s\x0B\x{85}\p{Z}]+', ' ', 'g')")} AS text FROM line
), page AS (
  SELECT doc_id, page_no, CAST(any_value(width) AS DOUBLE) AS width, sum(length(t)) AS n FROM (SELECT *, 60 + 5 * max(length(t)) OVER (PARTITION BY doc_id) AS width FROM line) GROUP BY doc_id, page_no
)"""


@query("pdf_lines", f"{_SQL} SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY k) - 1 AS INTEGER) AS line_no, text, 780.0 - 12 * (k % {_LINES_A_PAGE}) AS baseline, 10.0 AS font_size FROM shown WHERE text <> ''")
def pdf_lines(spark, sf_dir):
    return L.build_lines(pdf.glyphs_of(pages(spark, sf_dir))).select("doc_id", "page_no", "line_no", "text", "baseline", F.round("font_size", 6).alias("font_size"))


@query("pdf_pages", f"""{_SQL} SELECT doc_id, page_no, width, 842.0 AS height, CAST(n AS INTEGER) AS n_glyphs, false AS failed FROM page
UNION ALL SELECT doc_id, CAST(max(page_no) + 1 AS INTEGER), NULL, NULL, -1, true FROM page WHERE doc_id % 10 = 3 GROUP BY doc_id""")
def pdf_pages(spark, sf_dir):
    p = pages(spark, sf_dir)
    return p.select("doc_id", "page_no", "width", "height", F.coalesce(F.size("glyphs"), F.lit(-1)).alias("n_glyphs"), F.col("error").isNotNull().alias("failed"))


# a page is as wide as its longest line needs; 842 points high
@query("pdf_regions", f"""{_SQL}, rect AS (SELECT doc_id, page_no, width, 100.0 + doc_id % 300 AS w FROM page)
SELECT doc_id, page_no, 10.0 AS "left", 220.0 AS top, 10 + w AS "right", 20.0 AS bottom FROM rect WHERE w * 200 / (width * 842) BETWEEN 0.035 AND 0.72""")
def pdf_regions(spark, sf_dir):
    p = pages(spark, sf_dir)
    return layout.rectangle_regions(pdf.rects_of(p), pdf.boxes_of(p)).select("doc_id", "page_no", "bbox.left", "bbox.top", "bbox.right", "bbox.bottom")
