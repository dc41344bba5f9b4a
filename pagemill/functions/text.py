"""Scalar text functions as Spark columns, with DuckDB SQL that computes the same.

Each function ``f`` of columns has a twin ``sql_f`` of SQL expressions; the twins leave out NFKC,
which DuckDB doesn't have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import patterns as P

TRIM = " \t\n\r"
#: Characters below U+0300 that NFKC leaves alone, and the usual punctuation above.
_NFKC_SAFE = "[\\u0000-\\u009F\\u00A1-\\u00A7\\u00A9\\u00AB-\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB\\u00BF-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u0180-\\u01C3\\u0391-\\u03A1\\u03A3-\\u03A9\\u03B1-\\u03C9\\u0410-\\u044F\\u2010\\u2012-\\u2016\\u2018-\\u2023\\u2026-\\u2027]"
_NFKC_SAFE = _NFKC_SAFE.replace("\\u2026-\\u2027", "\\u2027")  # the ellipsis becomes three dots


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(P.java(pattern, ignore_case))


def replaced(text: Column, pattern: str, by: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, P.java(pattern, ignore_case), by)


def sql_matches(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({text}, {P.sql_literal(P.re2(pattern, ignore_case))})"


def sql_replaced(text: str, pattern: str, by: str, ignore_case: bool = False) -> str:
    return f"regexp_replace({text}, {P.sql_literal(P.re2(pattern, ignore_case))}, {P.sql_literal(by)}, 'g')"


def nfkc(text: Column) -> Column:
    """NFKC by the JVM's own tables, which Spark brings along; only texts with a character that it may change are passed on."""
    normal = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(~text.rlike(rf"\A{_NFKC_SAFE}*+\z"), normal).otherwise(text)


def normalized(text: Column, use_nfkc: bool = True) -> Column:
    """NFKC, no soft hyphens or bullets, words joined over "x- y", single blanks, trimmed."""
    t = nfkc(text) if use_nfkc else text
    t = F.translate(F.replace(t, F.lit("­"), F.lit("")), " ", " ")
    t = replaced(t, P.HYPHEN_SPACE, "$1$2")
    t = replaced(t, P.SPACED_INITIAL, "$1$2")
    t = F.replace(t, F.lit("•"), F.lit(""))
    return F.btrim(replaced(t, P.MANY_BLANKS, " "), F.lit(TRIM))


def sql_normalized(text: str) -> str:
    t = f"replace(replace({text}, chr(173), ''), chr(160), ' ')"
    t = sql_replaced(t, P.HYPHEN_SPACE, r"\1\2")
    t = sql_replaced(t, P.SPACED_INITIAL, r"\1\2")
    t = f"replace({t}, '•', '')"
    return f"trim({sql_replaced(t, P.MANY_BLANKS, ' ')}, ' ' || chr(9) || chr(10) || chr(13))"


#: All white space that Unicode knows.
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(_WHITE))


def sql_trimmed(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\x0B\x{{85}}\p{{Z}}]+|[\s\x0B\x{{85}}\p{{Z}}]+$', '', 'g')"


def without_citations(text: Column) -> Column:
    """Without [1], [1-3, 5] and (12); years in parentheses go as well."""
    # most texts have no digit in brackets: they pass one short test instead of three rewrites
    cited = replaced(replaced(text, P.BRACKET_CITATION, ""), P.PAREN_CITATION, "")
    return trimmed(F.when(text.rlike(r"[\[(]\d|[\t\n\f\r ][,.;:]"), replaced(cited, P.SPACE_BEFORE_STOP, "$1")).otherwise(text))


def sql_without_citations(text: str) -> str:
    t = sql_replaced(sql_replaced(text, P.BRACKET_CITATION, ""), P.PAREN_CITATION, "")
    return sql_trimmed(sql_replaced(t, P.SPACE_BEFORE_STOP, r"\1"))


def count_of(text: Column, part: str) -> Column:
    """How often ``part`` occurs, without overlaps."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def sql_count_of(text: str, part: str) -> str:
    return f"(length({text}) - length(replace({text}, {P.sql_literal(part)}, ''))) // {len(part)}"


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, P.java(P.TOKEN_GAP)), lambda t: t != "")


def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {P.sql_literal(P.TOKEN_GAP)}), lambda t: t <> '')"


# -- predicates -----------------------------------------------------------------------------------

_TOKEN_EDGE = ".,;%()[]"


def is_caption(t: Column) -> Column:
    return matches(t, P.CAPTION, True)


def is_page_number(t: Column) -> Column:
    return matches(t, P.PAGE_NUMBER, True)


def is_table_line(t: Column) -> Column:
    own = tokens(t)
    core = F.transform(own, lambda x: F.btrim(x, F.lit(_TOKEN_EDGE)))
    numeric = F.size(F.filter(core, lambda x: (x != "") & matches(x, P.NUMERIC_TOKEN)))
    # cheap tests that every table line passes come before the costly ones: three blanks, four digits
    spaced = t.rlike(r"[\t\n\f\r ]{3}") & matches(t, P.SPACED_TABLE)
    digits = t.rlike(r"(?:\p{Nd}\P{Nd}*+){4}")
    return matches(t, P.PIPE_TABLE) | spaced | (digits & (F.size(own) >= 6) & (numeric / F.greatest(F.size(own), F.lit(1)) > 0.55))


def is_non_prose(t: Column) -> Column:
    return (F.char_length(t) <= 2) | ((F.char_length(t) < 40) & matches(t, P.NUMERIC_HEAVY)) | (F.contains(t, F.lit("=")) & (count_of(t, "=") >= 2))


def is_front_matter(t: Column) -> Column:
    return matches(t, P.any_of(P.FRONT_MATTER), True)


def is_end_matter(t: Column) -> Column:
    return reduce(lambda a, b: a | b, (t.startswith(p) for p in P.END_MATTER))


def is_inline_end_matter(t: Column) -> Column:
    return matches(t, P.any_of(P.INLINE_END_MATTER), True)


def is_reference_entry(t: Column) -> Column:
    lead = matches(t, P.REFERENCE_LEAD) & matches(t, P.REFERENCE_EVIDENCE, True)
    return F.char_length(t).between(30, 1000) & (matches(t, P.NUMBERED_REFERENCE) | lead)


def is_affiliation(t: Column) -> Column:
    short = (F.char_length(t) < 100) & ((matches(t, P.EMAIL) & (F.size(tokens(t)) < 15)) | matches(t, P.ORCID))
    return (F.char_length(t) <= 300) & (matches(t, P.AFFILIATION, True) | short)


def sql_is_caption(t: str) -> str:
    return sql_matches(t, P.CAPTION, True)


def sql_is_page_number(t: str) -> str:
    return sql_matches(t, P.PAGE_NUMBER, True)


def sql_is_table_line(t: str) -> str:
    own = sql_tokens(t)
    core = f"list_transform({own}, lambda x: trim(x, {P.sql_literal(_TOKEN_EDGE)}))"
    numeric = f"len(list_filter({core}, lambda x: x <> '' AND {sql_matches('x', P.NUMERIC_TOKEN)}))"
    return f"({sql_matches(t, P.PIPE_TABLE)} OR {sql_matches(t, P.SPACED_TABLE)} OR (len({own}) >= 6 AND CAST({numeric} AS DOUBLE) / len({own}) > 0.55))"


def sql_is_non_prose(t: str) -> str:
    return f"(length({t}) <= 2 OR ({sql_matches(t, P.NUMERIC_HEAVY)} AND length({t}) < 40) OR {sql_count_of(t, '=')} >= 2)"


def sql_is_front_matter(t: str) -> str:
    return sql_matches(t, P.any_of(P.FRONT_MATTER), True)


def sql_is_end_matter(t: str) -> str:
    return "(" + " OR ".join(f"starts_with({t}, {P.sql_literal(p)})" for p in P.END_MATTER) + ")"


def sql_is_inline_end_matter(t: str) -> str:
    return sql_matches(t, P.any_of(P.INLINE_END_MATTER), True)


def sql_is_reference_entry(t: str) -> str:
    lead = f"({sql_matches(t, P.REFERENCE_LEAD)} AND {sql_matches(t, P.REFERENCE_EVIDENCE, True)})"
    return f"(length({t}) BETWEEN 30 AND 1000 AND ({sql_matches(t, P.NUMBERED_REFERENCE)} OR {lead}))"


def sql_is_affiliation(t: str) -> str:
    short = f"(length({t}) < 100 AND (({sql_matches(t, P.EMAIL)} AND len({sql_tokens(t)}) < 15) OR {sql_matches(t, P.ORCID)}))"
    return f"(length({t}) <= 300 AND ({sql_matches(t, P.AFFILIATION, True)} OR {short}))"


#: The prose rules in order: the first that fits drops a block.
PROSE_RULES = (
    ("caption_like", is_caption, sql_is_caption),
    ("page_number", is_page_number, sql_is_page_number),
    ("table_like", is_table_line, sql_is_table_line),
    ("non_prose", is_non_prose, sql_is_non_prose),
    ("front_matter", is_front_matter, sql_is_front_matter),
    ("end_matter", is_end_matter, sql_is_end_matter),
    ("inline_end_matter", is_inline_end_matter, sql_is_inline_end_matter),
    ("reference_entry", is_reference_entry, sql_is_reference_entry),
    ("affiliation", is_affiliation, sql_is_affiliation),
)


# -- headings -------------------------------------------------------------------------------------


def heading_class(heading: Column, references: bool = True, acknowledgements: bool = True, appendices: bool = True) -> Column:
    """drop, drop_heading_only, keep or unknown; the options say which families are dropped."""
    bare = trimmed(replaced(heading, P.HEADING_NUMBER, ""))
    families = [f for on, f in ((references, P.REFERENCE_HEADINGS), (acknowledgements, P.ACKNOWLEDGEMENT_HEADINGS), (appendices, P.APPENDIX_HEADINGS)) if on]
    drop = reduce(lambda a, b: a | b, [matches(bare, P.any_of(f), True) for f in families], F.lit(False))
    keep = matches(bare, P.any_of(P.KNOWN_SECTIONS), True) | matches(heading, P.HEADING_NUMBER)
    return F.when(drop, "drop").when(matches(bare, P.any_of(P.ARTICLE_TYPES), True), "drop_heading_only").when(keep, "keep").otherwise("unknown")


def sql_heading_class(heading: str) -> str:
    bare = sql_trimmed(sql_replaced(heading, P.HEADING_NUMBER, ""))
    drop = " OR ".join(sql_matches(bare, P.any_of(f), True) for f in (P.REFERENCE_HEADINGS, P.ACKNOWLEDGEMENT_HEADINGS, P.APPENDIX_HEADINGS))
    keep = f"{sql_matches(bare, P.any_of(P.KNOWN_SECTIONS), True)} OR {sql_matches(heading, P.HEADING_NUMBER)}"
    return f"CASE WHEN {drop} THEN 'drop' WHEN {sql_matches(bare, P.any_of(P.ARTICLE_TYPES), True)} THEN 'drop_heading_only' WHEN {keep} THEN 'keep' ELSE 'unknown' END"


def is_short_heading(t: Column) -> Column:
    """At most 80 characters and 8 words, no sentence end, every word upper-initial or the like."""
    own = tokens(t)
    core = lambda w: F.btrim(w, F.lit('()[]{}:;,"'))
    fits = lambda w: core(w).rlike(r"\A\p{Lu}|/|\A(?i:of)\z") | (core(w).rlike(r"\p{L}") & ~core(w).rlike(r"\p{Ll}"))
    return (F.char_length(trimmed(t)) <= 80) & ~t.rlike("[.!?]") & F.size(own).between(1, 8) & F.forall(own, fits)


def sql_is_short_heading(t: str) -> str:
    core = "trim(w, '()[]{}:;,\"')"
    fits = rf"(regexp_matches({core}, '^\p{{Lu}}|/|^(?i:of)$') OR (regexp_matches({core}, '\p{{L}}') AND NOT regexp_matches({core}, '\p{{Ll}}')))"
    return f"(length({sql_trimmed(t)}) <= 80 AND NOT regexp_matches({t}, '[.!?]') AND len({sql_tokens(t)}) BETWEEN 1 AND 8 AND len(list_filter({sql_tokens(t)}, lambda w: NOT {fits})) = 0)"


def ends_sentence(t: Column) -> Column:
    return t.rlike(r"[.?!][)\]}'" + '"' + r"]*\z")


def sql_ends_sentence(t: str) -> str:
    return f"regexp_matches({t}, '[.?!][)\\]}}''\"]*$')"


def is_title_case(t: Column) -> Column:
    """A run of title-case words, or at most seven words that begin with a capital or are digits."""
    own = tokens(t)
    fits = lambda w: F.btrim(w, F.lit("()[]{}:;,.")).rlike(r"\A\p{Lu}") | w.rlike(r"\A\p{Nd}+\z")
    return matches(t, P.TITLE_CASE_RUN) | (F.size(own).between(1, 7) & F.forall(own, fits))


def sql_is_title_case(t: str) -> str:
    fits = r"(regexp_matches(trim(w, '()[]{}:;,.'), '^\p{Lu}') OR regexp_matches(w, '^\p{Nd}+$'))"
    return f"({sql_matches(t, P.TITLE_CASE_RUN)} OR (len({sql_tokens(t)}) BETWEEN 1 AND 7 AND len(list_filter({sql_tokens(t)}, lambda w: NOT {fits})) = 0))"


# -- language -------------------------------------------------------------------------------------


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` refers to it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def detected_language(text: Column) -> Column:
    """unknown, pt-BR or en, by marks in the first 12 000 characters, as the rule has it."""
    padded = F.concat(F.lit(" "), F.left(F.lower(text), F.lit(12000)), F.lit(" "))

    def language(p: Column) -> Column:
        n = F.char_length(p)
        total = lambda marks: reduce(lambda a, b: a + b, [((n - F.char_length(F.replace(p, F.lit(m), F.lit("")))) / len(m)).cast("int") for m in marks])
        pt = total(P.PORTUGUESE_MARKS) + F.when(p.rlike(f"[{P.PORTUGUESE_LETTERS}]"), 3).otherwise(0)
        scores = F.struct(pt.alias("pt"), total(P.ENGLISH_MARKS).alias("en"), (trimmed(p) == "").alias("blank"))
        return bound(scores, lambda s: F.when(s["blank"], "unknown").when((s["pt"] > s["en"]) & (s["pt"] >= 2), "pt-BR").otherwise("en"))

    return bound(padded, language)


def sql_detected_language(text: str) -> str:
    sample = f"left(lower({text}), 12000)"
    total = lambda marks: " + ".join(f"({sql_count_of(f'''(' ' || {sample} || ' ')''', m)})" for m in marks)
    pt = f"({total(P.PORTUGUESE_MARKS)} + CASE WHEN regexp_matches({sample}, '[{P.PORTUGUESE_LETTERS}]') THEN 3 ELSE 0 END)"
    return f"CASE WHEN {sql_trimmed(sample)} = '' THEN 'unknown' WHEN {pt} > {total(P.ENGLISH_MARKS)} AND {pt} >= 2 THEN 'pt-BR' ELSE 'en' END"


def effective_language(detected: Column, wanted: Column) -> Column:
    """The option's language unless it is empty or auto, else the one detected; unknown is en."""
    own = F.when(~F.lower(trimmed(wanted)).isin("", "auto"), trimmed(wanted))
    return F.coalesce(own, F.nullif(F.nullif(detected, F.lit("unknown")), F.lit("")), F.lit("en"))


# -- spoken forms ---------------------------------------------------------------------------------


def _abbreviations() -> list[tuple[str, str, str]]:
    """(text, pattern, replacement) of each abbreviation, the longest first; blanks around it are taken with it."""
    keys = sorted(P.ABBREVIATIONS, key=lambda k: (-len(k.encode()), k))
    return [(k, rf"(^|[\s(\[]){P.quoted(k)}($|[\s,.:;!?)\]\-])", f"$1{P.ABBREVIATIONS[k]}$2") for k in keys]


def _spoken_steps() -> tuple[list[tuple[str, str, bool]], list[tuple[str, str, bool]]]:
    """Rewrites before and after the abbreviations, in order, as (pattern, replacement with $ groups, any case)."""
    # What each rewrite looks for, and what is said instead.
    steps = [
        (r"([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)", "$1$2", False),
        (r"(\d+)\s*[×xX]\s*(\d+)", "$1 by $2", False),
    ]
    # a sign that a pass has found stands between marks until it is spelled out, so that one pass finds all
    spelled = [(f"\u0001{sign}\u0001", words, False) for sign, words in P.COMPARISONS.items()]
    steps += [(r"(^|[^A-Za-z0-9_])p\s*([<>≤≥])\s*([\d.]+)", "$1p \u0001$2\u0001 $3", True), *spelled]
    steps += [(r"(^|[^A-Za-z0-9_])F(\d)[\-\s]?score", "$1F$2 score", True), (rf"{P.NUMBER}\s*±\s*{P.NUMBER}", "$1 plus or minus $2", False)]
    steps += [(rf"{P.NUMBER}\s*([<>≤≥])\s*{P.NUMBER}", "$1 \u0001$2\u0001 $3", False), *spelled]
    steps.append((rf"{P.NUMBER}\s*%", "$1 percent", False))
    return steps, [(r"([\p{L}\p{N}_])\s*[–—]\s*([\p{L}\p{N}_])", "$1, $2", False), (P.MANY_BLANKS, " ", False)]


#: What the rewrites before and after the abbreviations need at least.
_NOTATION = r"[×±<>≤≥%]|\d\s*[xX]\s*\d|-\s*\n|[fF]\d[\-\s]?[sS]"
_DASHES = r"[–—]|[ \t]{2}"


def verbalized(text: Column) -> Column:
    """Scientific notation as it is spoken. Texts without any of it pass two tests instead of all rewrites."""
    first, last = _spoken_steps()
    t = F.when(matches(text, _NOTATION), reduce(lambda x, step: replaced(x, *step), first, text)).otherwise(text)
    # a pattern is compiled and run for those abbreviations only that a text holds
    short = F.array(*[F.struct(F.lit(k).alias("text"), F.lit(P.java(p)).alias("pattern"), F.lit(by).alias("by")) for k, p, by in _abbreviations()])
    t = F.aggregate(short, t, lambda acc, x: F.when(F.contains(acc, x["text"]), F.regexp_replace(acc, x["pattern"], x["by"])).otherwise(acc))
    return bound(t, lambda x: trimmed(F.when(matches(x, _DASHES), reduce(lambda y, step: replaced(y, *step), last, x)).otherwise(x)))


def sql_verbalized(text: str) -> str:
    t = text
    first, last = _spoken_steps()
    for pattern, by, ignore_case in [*first, *((p, by, False) for _, p, by in _abbreviations()), *last]:
        t = sql_replaced(t, pattern, by.replace("$1", r"\1").replace("$2", r"\2").replace("$3", r"\3"), ignore_case)
    return sql_trimmed(t)


# -- small ones -----------------------------------------------------------------------------------


def truncated(text: Column, limit: int) -> Column:
    if limit <= 0:
        return F.lit("")
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def sentences(text: Column) -> Column:
    """Cuts after . ! ? where a capital or a digit follows, blanks between or not."""
    return F.filter(F.split(text, r"(?<=[.!?])[\s\x0B\x{85}\p{Z}]*(?=[\p{Lu}\p{Nd}])"), lambda s: s != "")


def sql_sentences(text: str) -> str:
    cut = rf"regexp_replace({text}, '([.!?])[\s\x0B\x{{85}}\p{{Z}}]*([\p{{Lu}}\p{{Nd}}])', '\1' || chr(1) || '\2', 'g')"
    return f"list_filter(string_split({cut}, chr(1)), lambda s: s <> '')"


#: Pauses in milliseconds after a sentence, a clause, anything else.
PAUSES = {"piper": (350, 120, 500), "kokoro": (400, 150, 600)}
#: Fixed value: what one engine waits after a blank chunk; the other has an option for it.
BLANK_PAUSE = {"kokoro": 400}


def pause_ms(chunk: Column, engine: str, default: int = 220) -> Column:
    """The silence after a chunk, by its last character."""
    sentence, clause, other = PAUSES[engine]
    last = F.right(trimmed(chunk), F.lit(1))
    rest = F.when(last.isin(".", "!", "?"), sentence).when(last.isin(",", ";", ":"), clause).otherwise(other)
    return F.when(last == "", BLANK_PAUSE.get(engine, default)).otherwise(rest)


def silent_frames(pause: Column, rate: int) -> Column:
    return F.floor(F.greatest(pause, F.lit(0)) * rate / 1000).cast("long")


def length_scale(rate: Column) -> Column:
    """Slower speech takes longer: the inverse of the rate, which stays between 0.7 and 1.4."""
    return F.round(1 / F.least(F.greatest(rate, F.lit(0.7)), F.lit(1.4)), 3)


#: Fixed value: what stands behind a shortened preview.
PREVIEW_MARK = "\n\n[… preview truncated …]"


def preview(text: Column, most_bytes: int = 20_000, mark: str = PREVIEW_MARK) -> Column:
    """As many characters of a text as fit into so many bytes, with a mark if there is more."""
    # a character has four bytes at most, so the cut lies among few candidates; an invalid end is cut off
    raw = F.substring(text.cast("binary"), 1, most_bytes)
    return F.when(F.octet_length(text) > most_bytes, F.concat(F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\uFFFD+\\z", ""), F.lit(mark))).otherwise(text)


def tail(text: Column, most_bytes: int = 32_768) -> Column:
    """A text's last characters that fit into so many bytes."""
    raw = F.substring(text.cast("binary"), -most_bytes, most_bytes)
    return F.when(F.octet_length(text) > most_bytes, F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\\A\uFFFD+", "")).otherwise(text)


def speed(rate: Column) -> Column:
    """The other engine takes the rate itself, between 0.5 and 2."""
    return F.least(F.greatest(rate, F.lit(0.5)), F.lit(2.0))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
