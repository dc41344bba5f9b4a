import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import patterns as P
from pagemill.functions import text as X
from pagemill.operators import chunk, clean, fold
from pagemill.sources.blocks import BLOCKS


def blocks(spark, *rows):
    """Rows of (text, label) of one document."""
    return spark.createDataFrame([(1, i, t, label, 1, None) for i, (t, label) in enumerate(rows)], BLOCKS)


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


PAPER = [
    ("A Study of Page Layouts in Scientific Articles", "title"),
    ("1 Department of Computing, University of Somewhere", "paragraph"),
    ("Received: 1 May 2020", "paragraph"),
    ("Abstract", "section_header"),
    ("We describe how layouts are read [1, 2] by machines.", "paragraph"),
    ("Methods", "section_header"),
    ("The method was applied to many documents [3].", "paragraph"),
    ("Results", "section_header"),
    ("Results were good in every case that we tried.", "paragraph"),
    ("Acknowledgements", "section_header"),
    ("We thank our colleagues for their patience.", "paragraph"),
    ("References", "section_header"),
    ("1. Smith J. Page layouts in articles. Nature 2010.", "paragraph"),
    ("12", "page_footer"),
]


def test_paper(spark):
    c = clean.classify(blocks(spark, *PAPER))
    rules = {r["ord"]: r["rule"] for r in c.select("ord", "rule").collect()}
    assert [i for i in range(14) if rules[i] is None] == [0, 3, 4, 5, 6, 7, 8]
    assert rules[1] == "affiliation" and rules[2] == "front_matter"
    assert rules[9] == rules[11] == "section_heading_drop" and rules[10] == rules[12] == "section_skip" and rules[13] == "page_footer"
    text = fold.cleaned_text(c).first()
    assert "layouts are read by machines." in text["text"] and "[3]" not in text["text"] and "colleagues" not in text["text"]
    assert text["language"] == "en"
    s = clean.stats(c).first()
    assert (s["total"], s["kept"], s["dropped"]) == (14, 7, 7)
    assert s["dropped_by_label"] == {"page_footer": 1} and s["dropped_by_rule"]["section_skip"] == 2


def test_sections_switch_back_and_options(spark):
    rows = [("Intro", "section_header"), ("kept one here", "paragraph"), ("References", "section_header"), ("not read here", "paragraph"), ("Technical note", "section_header"), ("still not read", "paragraph"), ("Outlook", "section_header"), ("read again here", "paragraph")]
    out = lambda o: [r["ord"] for r in clean.classify(blocks(spark, *rows), o).where("emitted").orderBy("ord").collect()]
    assert out(clean.Options()) == [0, 1, 6, 7]
    assert out(clean.Options(drop_references=False)) == [0, 1, 2, 3, 5, 6, 7]
    assert out(clean.Options(keep_headings=False)) == [1, 7]


def test_reference_label_switches_whatever_the_options(spark):
    rows = [("something else", "reference"), ("a line after it", "paragraph")]
    c = clean.classify(blocks(spark, *rows), clean.Options(drop_references=False))
    assert {r["ord"]: (r["rule"], r["bucket"]) for r in c.collect()} == {0: ("reference", "label"), 1: ("section_skip", "rule")}


def test_furniture_comes_before_headings(spark):
    rows = [("References", "section_header")] * 3 + [("a line of prose", "paragraph")]
    assert [r["rule"] for r in clean.classify(blocks(spark, *rows)).orderBy("ord").collect()] == ["repeated_furniture"] * 3 + [None]


def test_empty_nulls_and_odd_labels(spark):
    rows = [(None, "paragraph"), (" \n", None), ("==", "sidebar"), ("prose in a sidebar", "sidebar"), ("[1]", "paragraph"), ("see [1]", None)]
    got = [(r["rule"], r["out"]) for r in clean.classify(blocks(spark, *rows)).orderBy("ord").collect()]
    assert got[0][0] == got[1][0] == "empty"
    assert got[2][0] == "non_prose:sidebar" and got[3] == (None, "prose in a sidebar")
    assert got[4][0] == "citations_only" and got[5] == (None, "see")
    assert clean.classify(blocks(spark, *rows).limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ﬁne x²", "fine x2"),
        ("A study", "Astudy"),
        ("soft­hyphen non breaking", "softhyphen non breaking"),
        ("hyphen- break", "hyphenbreak"),
        ("• item   two", "item two"),
        ("tail\n", "tail"),
    ],
)
def test_normalized(spark, text, want):
    assert one(spark, X.normalized, text) == want


@pytest.mark.parametrize(("text", "want"), [("a [1], b [2-4; 5].", "a, b."), ("in (2020) and (12)", "in and"), ("[1]", ""), ("x (a) .", "x (a).")])
def test_citations(spark, text, want):
    assert one(spark, X.without_citations, text) == want


@pytest.mark.parametrize(("text", "want"), [("Os resultados não são para uma", "pt-BR"), ("The results of the study", "en"), (" ", "unknown"), ("x" * 12001 + " não não não", "en")])
def test_language(spark, text, want):
    assert one(spark, X.detected_language, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("3 x 4", "3 by 4"),
        ("95.5%", "95.5 percent"),
        ("p < 0.05", "p less than 0.05"),
        ("1.5 ± 0.2", "1.5 plus or minus 0.2"),
        ("1<2>3", "1 less than 2>3"),
        ("the CT scan, e.g. here", "the C.T. scan, for example, here"),
        ("CT CT", "C.T. CT"),
        ("F1-score", "F1 score"),
        ("a – b", "a, b"),
        ("hy-\nphen", "hyphen"),
        ("plain", "plain"),
    ],
)
def test_verbalized(spark, text, want):
    assert one(spark, X.verbalized, text) == want


def test_rules_do_not_match_before_a_final_newline(spark):
    assert not one(spark, X.is_page_number, "12\n")
    assert one(spark, X.is_page_number, "Page 12")
    assert one(spark, lambda t: X.matches(t, P.any_of(P.KNOWN_SECTIONS), True), "INTRODUÇÃO")


def test_fold(spark):
    got = one(spark, lambda t: fold.merged(F.split(t, r"\|")), "An over-|lap of two|and (more|Text)|Heading Here|small start.|Next.")
    assert got == "An overlap of two and (more Text)\n\nHeading Here\n\nsmall start.\n\nNext."


def plain_chunks(text, limit):
    """The rule as a procedure over one text."""

    def pack(pieces):
        out = []
        for p in pieces:
            if out and len(out[-1]) + 1 + len(p) <= limit:
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def words(t):
        return pack([w[i : i + limit] for w in t.split() for i in range(0, len(w), limit)])

    text = re.sub("\n{3,}", "\n\n", text.strip())
    if len(text) <= limit:
        return [text] if text else []
    sentences = [""]
    for i, c in enumerate(text):
        sentences[-1] += c
        after = text[i + 1 :].lstrip()
        if c in ".!?" and after and (after[0].isupper() or after[0].isdecimal()):
            sentences.append("")
    out = []
    for c in pack([s.strip() for s in sentences if s.strip()]):
        if len(c) <= limit:
            out.append(c)
            continue
        clauses = pack([x.strip() for x in re.split(r"(?<=[,;:])\s+", c) if x.strip()])
        out += clauses[:-1] + (words(clauses[-1]) if len(clauses[-1]) > limit else clauses[-1:])
    return out


def chunks(spark, texts, limit):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunk.chunks_of(F.col("t"), limit).alias("c"))
    return [r["c"] for r in df.orderBy("i").collect()]


def test_chunks(spark):
    text = "This sentence stands here again. " * 30
    got = chunks(spark, [text, "é" * 301, "", "short", "a" * 130 + ", b", "  \n "], 100)
    assert all(len(c) <= 100 for c in got[0]) and [len(c) for c in got[1]] == [100, 100, 100, 1]
    assert got[2:] == [[], ["short"], ["a" * 130 + ",", "b"], []]  # a long clause that isn't the last stays whole
    assert chunks(spark, ["a" * 30 + ", b"], 20) == [["a" * 30 + ",", "b"]]
    assert chunks(spark, ["It is 98.5 now. Yes"], 10) == [["It is 98.", "5 now. Yes"]]
    assert chunks(spark, ["x" * 900], 0) == [["x" * 900]]


def test_chunks_against_plain_version(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  .,;A1é\n:!") for _ in range(rng.randrange(0, 400))) for _ in range(400)]
    texts += [" ".join(rng.choice(["word", "Then", "it,", "end.", "9", "so;"]) for _ in range(3000))]
    for limit in (5, 23, 60):
        got = chunks(spark, texts, limit)
        assert got == [plain_chunks(t, limit) for t in texts]
        assert ["".join("".join(c).split()) for c in got] == ["".join(t.split()) for t in texts]


def plain_fold(parts):
    """Paragraphs, part after part."""
    out = []
    for p in (x.strip() for x in parts):
        if not p:
            continue
        a = out[-1] if out else ""
        lower = p[0].islower()
        names = [w.strip("()[]{}:;,\"") for w in a.split()]
        heading = len(a) <= 80 and not re.search("[.!?]", a) and 1 <= len(names) <= 8 and all(w[:1].isupper() or "/" in w or w.lower() == "of" or (re.search("[A-Za-z]", w) and not re.search("[a-z]", w)) for w in names)
        if a and a.endswith("-") and lower:
            out[-1] = a[:-1] + p
        elif a and (a.count("(") > a.count(")") or (lower and not heading and not re.search(r"[.?!][)\]}'\"]*$", a))):
            out[-1] = a + " " + p
        else:
            out.append(p)
    return "\n\n".join(out)


def test_fold_against_plain_version(spark):
    rng = random.Random(5)
    words = ["word", "Head", "of", "(open", "close)", "end.", "over-", "UP", "9", "small", "Big Title", "a/b", "said.)"]
    docs = [[" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 1, 2, 3, 9, 20]))) for _ in range(rng.randrange(0, 30))] for _ in range(200)]
    docs.append([rng.choice(words) for _ in range(2000)])
    df = spark.createDataFrame(list(enumerate(docs)), "i int, p array<string>").select("i", fold.merged(F.col("p")).alias("t"))
    assert [r["t"] for r in df.orderBy("i").collect()] == [plain_fold(d) for d in docs]


def test_nfkc_is_the_standard_one(spark):
    rows = [(c, f"a{chr(c)}b{chr(c)}") for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    got = spark.createDataFrame(rows, "c int, s string").select("c", "s", X.nfkc(F.col("s")).alias("n")).collect()
    assert [hex(r["c"]) for r in got if r["n"] != unicodedata.normalize("NFKC", r["s"])] == []
    assert one(spark, X.nfkc, None) is None


@settings(deadline=None, max_examples=15, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.tuples(st.sampled_from(["References", "12", "a line of prose", "A b", "", "x | y | z", "[3]"]), st.sampled_from(["paragraph", "title", "reference", "table", None])), min_size=1, max_size=8))
def test_kept_and_dropped_are_all(spark, rows):
    s = clean.stats(clean.classify(blocks(spark, *rows))).first()
    assert s["kept"] + s["dropped"] == s["total"] == len(rows)


def test_pauses(spark):
    c = spark.createDataFrame([(1, 0, "One."), (1, 1, "two,"), (1, 2, "three"), (1, 3, "end.")], "doc_id long, chunk_no int, chunk string")
    assert [r["pause_ms"] for r in chunk.with_pauses(c).orderBy("chunk_no").collect()] == [350, 120, 500, 0]
    assert [r["pause_ms"] for r in chunk.with_pauses(c, "kokoro").orderBy("chunk_no").collect()] == [400, 150, 600, 0]
    rates = spark.createDataFrame([(1.25,), (10.0,)], "r double").select(X.length_scale(F.col("r")).alias("s")).collect()
    assert [r["s"] for r in rates] == [0.8, 0.714]
