import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import layout, lines, reading_order
from pagemill.plans import geometry
from pagemill.sources.blocks import BLOCKS

REGIONS = "doc_id long, kind string, page_no int, bbox struct<left:double,top:double,right:double,bottom:double>"
SIZES = "doc_id long, page_no int, width double, height double"


def page(spark, boxes, size=(612.0, 792.0), page_no=1):
    rows = [(1, i, f"b{i}", "paragraph", page_no, b) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([(1, page_no, *size)], SIZES)


def order(spark, *a, **k):
    return [r["ord"] for r in reading_order.repaired(*page(spark, *a, **k)).orderBy("new_ord").collect()]


def box(left, right, y):
    return (float(left), float(y), float(right), float(y + 20))


def test_two_columns(spark):
    assert order(spark, [box(30, 270, 100), box(320, 590, 100), box(30, 270, 200), box(320, 590, 200)]) == [0, 2, 1, 3]


def test_three_columns(spark):
    rows = [box(x, x + 140, y) for y in (100, 200) for x in (30, 225, 430)]
    assert order(spark, rows) == [0, 3, 1, 4, 2, 5]


def test_spanning_heading(spark):
    rows = [box(30, 270, 100), box(320, 590, 100), box(30, 590, 230), box(30, 270, 300), box(320, 590, 300)]
    assert order(spark, rows) == [0, 1, 2, 3, 4]


def test_without_boxes_sizes_or_page(spark):
    assert order(spark, [None, None]) == [0, 1]
    assert order(spark, [box(30, 270, 300), box(30, 270, 100)], size=(0.0, 0.0)) == [0, 1]
    assert order(spark, [box(30, 270, 300), box(30, 270, 100)], page_no=0) == [0, 1]
    assert order(spark, [box(30, 270, 300), box(30, 270, 100), None]) == [2, 1, 0]


def test_bottom_left_origin(spark):
    rows = [(30.0, 300.0, 500.0, 280.0), (30.0, 700.0, 500.0, 680.0)]
    assert order(spark, rows) == [1, 0]


def test_more_than_four_clusters(spark):
    rows = [box(x, x + 40, 100) for x in (10, 110, 210, 310, 410, 520)]
    b, s = page(spark, rows)
    assert len(reading_order.columns_of(b, s).first()["centers"]) == 4


def plain_order(boxes, width):
    """The rule as a procedure, for pages whose boxes all have a top-left origin."""
    mids = sorted((b[0] + b[2]) / 2 for b in boxes if 0 < b[2] - b[0] < width / 2)
    groups = []
    for m in mids:
        if groups and m - groups[-1][-1] < width / 10:
            groups[-1].append(m)
        else:
            groups.append([m])
    mean = lambda g: sum(g) / len(g)
    by_y = lambda items: sorted(items, key=lambda i: (boxes[i][1], i))
    if len(mids) < 3 or len(groups) < 2:
        return by_y(range(len(boxes)))
    while len(groups) > 4:
        k = min(range(len(groups) - 1), key=lambda i: mean(groups[i + 1]) - mean(groups[i]))
        groups[k : k + 2] = [groups[k] + groups[k + 1]]
    centers = [mean(g) for g in groups]
    spans = [i for i, b in enumerate(boxes) if b[2] - b[0] >= 0.6 * width or sum(b[0] - 4 <= c <= b[2] + 4 for c in centers) >= 2]
    rest = [i for i in range(len(boxes)) if i not in spans]
    col = {i: min(range(len(centers)), key=lambda k: abs(centers[k] - (boxes[i][0] + boxes[i][2]) / 2)) for i in rest}
    segment = lambda items: [i for c in range(len(centers)) for i in by_y(x for x in items if col[x] == c)]
    out = []
    for s in by_y(spans):
        before = [i for i in rest if boxes[i][1] < boxes[s][1] - 3]
        rest = [i for i in rest if i not in before]
        out += segment(before) + [s]
    return out + segment(rest)


def test_random_pages(spark):
    rng = random.Random(4)
    docs = {}
    for d in range(40):
        docs[d] = [(x := rng.choice([10, 120, 220, 320, 420, 500]), y := rng.randrange(0, 700), x + rng.choice([60, 90, 200, 400]), y + 15) for _ in range(rng.randrange(1, 14))]
    rows = [(d, i, "t", "paragraph", 1, tuple(map(float, b))) for d, bs in docs.items() for i, b in enumerate(bs)]
    sizes = spark.createDataFrame([(d, 1, 612.0, 792.0) for d in docs], SIZES)
    got = {}
    for r in reading_order.repaired(spark.createDataFrame(rows, BLOCKS), sizes).orderBy("doc_id", "new_ord").collect():
        got.setdefault(r["doc_id"], []).append(r["ord"])
    assert got == {d: plain_order(bs, 612) for d, bs in docs.items()}


def test_layout_filter(spark):
    b, _ = page(spark, [(190.0, 320.0, 300.0, 340.0), (30.0, 600.0, 300.0, 620.0), (180.0, 265.0, 300.0, 280.0), (180.0, 413.0, 300.0, 420.0)])
    b = b.withColumn("text", F.when(F.col("ord") == 2, "Panel Title").otherwise("some prose that is no title at all"))
    r = spark.createDataFrame([(1, "picture", 1, (180.0, 300.0, 400.0, 400.0))], REGIONS)
    assert [x["ord"] for x in layout.keep_outside(b, r).orderBy("ord").collect()] == [1, 3]
    assert [x["ord"] for x in layout.keep_outside(b, r, 0.0).orderBy("ord").collect()] == [1, 3]
    assert layout.keep_outside(layout.keep_outside(b, r), r).count() == 2
    assert layout.keep_outside(b, r.limit(0)).count() == 4


def test_touching_and_mixed_origin(spark):
    df = spark.createDataFrame([((0.0, 10.0, 10.0, 0.0), (5.0, 5.0, 20.0, 20.0), (10.0, 0.0, 20.0, 10.0))], "a struct<left:double,top:double,right:double,bottom:double>, b struct<left:double,top:double,right:double,bottom:double>, c struct<left:double,top:double,right:double,bottom:double>")
    got = df.select(layout.overlap(F.col("a"), F.col("b")).alias("x"), layout.overlap(F.col("a"), F.col("c")).alias("y"), layout.iou(F.col("a"), F.col("a")).alias("z")).first()
    assert (got["x"], got["y"], got["z"]) == (True, False, 1.0)


def test_regions_are_deduplicated_against_kept_ones(spark):
    rows = [(1, 1, i, (0.0, 100.0, w, 0.0)) for i, w in enumerate((100.0, 95.0, 90.0))]
    r = spark.createDataFrame(rows, "doc_id long, page_no int, seq int, bbox struct<left:double,top:double,right:double,bottom:double>").withColumn("kind", F.lit("graphic"))
    assert [x["seq"] for x in layout.deduplicated(r).orderBy("seq").collect()] == [0, 2]


GLYPHS = "doc_id long, page_no int, seq long, s string, x double, y double, w double, font string, font_size double"


def glyph_table(spark, pages):
    """Pages of (s, x, y, w, size, font) as a table of glyphs."""
    return spark.createDataFrame([(d, 1, i, s, float(x), float(y), w, font, float(size)) for d, page in pages.items() for i, (s, x, y, w, size, font) in enumerate(page)], GLYPHS)


def glyph(s, x, y, w=5.0, size=10.0, font="f"):
    return (s, x, y, w, size, font)


def texts_of(spark, page):
    return [r["text"] for r in lines.build_lines(glyph_table(spark, {1: page})).orderBy("line_no").collect()]


def test_lines_from_glyphs(spark):
    g = [glyph("H", 0, 700), glyph("i", 5, 700.4), glyph("you", 20, 700), glyph("low", 0, 650), glyph("\0", 60, 650)]
    assert texts_of(spark, g) == ["Hi you", "low"]
    assert texts_of(spark, []) == [] and texts_of(spark, [glyph("x", 0, 0, size=0), glyph("y", float("nan"), 0), glyph(None, 0, 0), glyph("\n", 0, 0)]) == []
    assert texts_of(spark, [glyph("zero", 0, 9, w=0.0), glyph("wide", 1, 9, w=0.0), glyph("!", 2, 9, w=0.0)]) == ["zero wide!"]
    assert texts_of(spark, [glyph("E=mc", 0, 100, 20.0), glyph("2", 20, 103, 4.0, 7), glyph("holds", 30, 100, 20.0)]) == ["E=mc2 holds"]


def plain_lines(page):
    """(text, font, size, box) of each line, glyph after glyph."""
    shown = [(i, g) for i, g in enumerate(page) if g[0] is not None and (g[0].strip() or g[0] in " \t") and g[4] > 0]
    steps = {}
    for i, g in shown:
        steps.setdefault((-g[2], g[4], g[5]), []).append((i, g))
    rows, last = [], None
    for down, *_ in sorted(steps):
        if last is None or down - last > 0.8:
            rows.append(set())
        rows[-1].add(down)
        last = down
    found = []
    for no, row in enumerate(rows):
        mine = sorted((min(g[1] for _, g in v), k[0], k[1], k[2], v) for k, v in steps.items() if k[0] in row)
        for *_, size, _, members in mine:
            for i, g in members:
                best = None
                for line in found[-5:]:
                    away = abs(g[2] - sum(x[1][2] for x in line) / len(line))
                    if away <= max(1.5, 0.32 * size) and (best is None or away <= best[0]):
                        best = (away, line)
                if best:
                    best[1].append((i, g, no))
                else:
                    found.append([(i, g, no)])
    out = []
    for line in found:
        own = sorted(line, key=lambda x: (x[1][1], x[2], x[0]))
        text, before = "", None
        for _, g, _ in own:
            if before:
                gap = g[1] - before[1] - max(before[3], 0)
                if gap > max(0.75, 0.16 * min(before[4], g[4])) or (before[3] <= 0 and gap > 0.8 and before[0][-1].isalnum() and g[0][0].isalnum()):
                    text += " "
            text += g[0]
            before = g
        gs = [g for _, g, _ in own]
        weight = sum(max(abs(g[3]), 1) for g in gs)
        fonts = [g[5] for g in gs]
        size = sum(g[4] * max(abs(g[3]), 1) for g in gs) / weight
        if text.split():
            out.append((" ".join(text.split()), min(fonts, key=lambda f: (-fonts.count(f), f)), round(size, 6), min(g[1] for g in gs), max(g[1] + max(g[3], 0) for g in gs), min(g[2] for g in gs), max(g[2] + g[4] for g in gs)))
    return sorted(out, key=lambda x: (-x[5], x[3]))


def plain_blocks(rows, median):
    """Texts and boxes of blocks, line after line; rows are (text, label, left, right, bottom, top)."""
    out = []
    for text, label, left, right, bottom, top in rows:
        b = out[-1] if out else None
        same = b and b["label"] == label and label in ("paragraph", "list_item")
        if same and -0.35 * median <= b["bottom"] - top <= max(0.95 * median, 5) and abs(b["left"] - left) <= max(24, 0.12 * max(b["right"] - b["left"], right - left)) and left <= b["right"] + max(18, 2 * median):
            b["text"] = b["text"][:-1] + text if b["text"].endswith("-") and text[:1].islower() else b["text"] + " " + text
            b.update(left=min(b["left"], left), right=max(b["right"], right), bottom=min(b["bottom"], bottom), top=max(b["top"], top))
        else:
            out.append({"text": text, "label": label, "left": left, "right": right, "bottom": bottom, "top": top})
    return out


def test_random_glyphs(spark):
    rng = random.Random(9)
    pages = {}
    for d in range(60):
        page, y = [], 760.0
        for _ in range(rng.randrange(1, 8)):
            x = rng.choice([30.0, 40.0, 300.0])
            for _ in range(rng.randrange(1, 9)):
                size = rng.choice([10.0, 10.0, 8.0, 14.0])
                w = rng.choice([0.0, 5.0, 22.0])
                page.append((rng.choice(["a", "B", "word", " ", "9", "-", "é", "(x)", "end-"]), x, y + rng.choice([0.0, 0.0, 0.0, 0.25, -0.5, 2.0, -2.5]), w, size, rng.choice(["f", "g"])))
                x += rng.choice([w, w + 0.5, w + 1.0, w + 3.0, w + 30.0])
            y -= rng.choice([11.0, 12.0, 14.0, 30.0])
        rng.shuffle(page)
        pages[d] = page
    built = lines.build_lines(glyph_table(spark, pages)).cache()
    got = {}
    for r in built.orderBy("doc_id", "line_no").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["font"], round(r["font_size"], 6), r["left"], r["right"], r["bottom"], r["top"]))
    want = {d: w for d, p in pages.items() if (w := plain_lines(p))}
    assert got == want
    sizes = spark.createDataFrame([(d, 1, 612.0, 792.0) for d in pages], SIZES)
    marked = lines.labelled(built, sizes).cache()
    rows, medians = {}, {}
    for r in marked.orderBy("doc_id", "line_no").collect():
        rows.setdefault(r["doc_id"], []).append((r["text"], r["label"], r["left"], r["right"], r["bottom"], r["top"]))
        medians[r["doc_id"]] = r["median"]
    blocks = {}
    for r in lines.group_lines(marked).orderBy("doc_id", "ord").collect():
        blocks.setdefault(r["doc_id"], []).append({"text": r["text"], "label": r["label"], **r["bbox"].asDict()})
    assert blocks == {d: plain_blocks(v, medians[d]) for d, v in rows.items()}


def test_blocks_from_lines(spark):
    rows = [(1, 1, i, t, "f", 10.0, 0.0, 100.0, top - 10, top, top - 10, label, 10.0) for i, (t, top, label) in enumerate([("one hy-", 700.0, "paragraph"), ("phen", 688.0, "paragraph"), ("far", 600.0, "paragraph"), ("Head", 588.0, "section_header")])]
    table = spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, text string, font string, font_size double, left double, right double, baseline double, top double, bottom double, label string, median double")
    assert [r["text"] for r in lines.group_lines(table).orderBy("ord").collect()] == ["one hyphen", "far", "Head"]


@pytest.mark.parametrize(
    ("text", "size", "top", "want"),
    [
        ("Figure 3 shows", 10.0, 400.0, "caption"),
        ("Running head", 10.0, 780.0, "page_header"),
        ("E = m + c = 3", 10.0, 400.0, "formula"),
        ("1 2 3 4 x", 10.0, 400.0, "table"),
        ("• an item", 10.0, 400.0, "list_item"),
        ("A Large Name", 20.0, 600.0, "title"),
        ("2. Methods", 10.0, 400.0, "list_item"),
        ("2 Methods", 10.0, 400.0, "section_header"),
        ("Some Larger Words", 12.0, 400.0, "section_header"),
        ("plain prose here", 10.0, 400.0, "paragraph"),
    ],
)
def test_line_labels(spark, text, size, top, want):
    df = spark.createDataFrame([(text, size, top)], "t string, s double, top double")
    label = lines.line_label(F.col("t"), F.col("s"), F.col("top"), F.col("top") - F.col("s"), F.lit(10.0), F.lit(792.0), F.lit(1))
    assert df.select(label.alias("x")).first()["x"] == want


def test_processed_document(spark):
    import json

    from pagemill.operators import document

    rows = [(1, i, t, "paragraph", 1, b) for i, (t, b) in enumerate([("Second column goes here.", box(320, 590, 100)), ("First column goes here.", box(30, 270, 100)), ("left lower part.", box(30, 270, 200)), ("inside a picture", box(330, 500, 400))])]
    b = spark.createDataFrame(rows, BLOCKS)
    sizes = spark.createDataFrame([(1, 1, 612.0, 792.0)], SIZES)
    r = spark.createDataFrame([(1, "picture", 1, (320.0, 380.0, 520.0, 460.0))], REGIONS)
    d = document.processed(b, sizes, r).first()
    assert d["text"] == "First column goes here.\n\nleft lower part.\n\nSecond column goes here."
    assert (d["total"], d["kept"], d["dropped"], d["layout_dropped"], d["regions"], d["reviewed"]) == (3, 3, 0, 1, 1, 0)
    drop_first = lambda p: json.dumps({"results": [{"id": json.loads(p)[0]["id"], "action": "DROP"}]})
    d = document.processed(b, sizes, r, review=drop_first).first()
    assert (d["total"], d["kept"], d["dropped"], d["reviewed"], d["review_dropped"]) == (3, 2, 1, 3, 1)


def test_every_word_is_a_glyph(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(200))
    text = "\n".join(["Title", long, "", f"{long}  end", *["short one"] * 60])
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = [x for x in text.split("\n") if x]
    g = geometry.glyphs(spark, str(tmp_path))
    in_order = [r["s"] for r in g.orderBy("seq").collect() if r["s"]]
    assert in_order == text.split() and g.select("seq").distinct().count() == g.count()
    got = geometry.glyph_lines(spark, str(tmp_path)).orderBy("page_no", "line_no").collect()
    assert [r["text"] for r in got] == [" ".join(x.split()) for x in own]
    blocks = geometry.glyph_blocks(spark, str(tmp_path)).orderBy("ord").collect()
    assert " ".join(r["text"] for r in blocks).split() == text.split()
    assert geometry.line_labels(spark, str(tmp_path)).count() == len(own)
    wide = {r["page_no"]: r["width"] for r in geometry.page_dimensions(spark, str(tmp_path)).collect()}
    assert wide == {1: 30.0 + 45.0 * 201 + 40 + 18, 2: 612.0}
