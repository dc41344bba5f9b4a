"""Continuation folding: emitted blocks become paragraphs.

Whether a block continues the paragraph before it depends on all of that paragraph so far, so this
is a fold over a document's blocks and no window. The fold carries what the rule needs of the open
paragraph (its length, its first characters, its open parentheses, how it ends) and says of each
block how it goes on; texts are joined once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions.folds import scan

#: A longer text is no short heading.
_HEADING_CHARS = 80
NEW, SPACED, BROKEN = 0, 1, 2


def _facts(part: Column) -> Column:
    return F.struct(
        F.left(part, F.lit(_HEADING_CHARS + 1)).alias("head"),
        F.char_length(part).alias("chars"),
        (X.count_of(part, "(") - X.count_of(part, ")")).alias("parens"),
        part.rlike(r"\A\p{Ll}").alias("lower"),
        F.endswith(part, F.lit("-")).alias("hyphen"),
        X.ends_sentence(part).alias("ends"),
    )


def _how(open_: Column, part: Column) -> Column:
    """How a part goes on from the open paragraph: not at all, after a blank, or as the rest of a broken word."""
    heading = (open_["chars"] <= _HEADING_CHARS) & X.is_short_heading(open_["head"])
    return (
        F.when(open_["chars"] == 0, NEW)
        .when(open_["hyphen"] & part["lower"], BROKEN)
        .when(open_["parens"] > 0, SPACED)
        .when(part["lower"] & ~open_["ends"] & ~heading, SPACED)
        .otherwise(NEW)
    )


def _opened(open_: Column, part: Column, how: Column) -> Column:
    """The open paragraph after a part."""
    kept = F.when(how == SPACED, F.concat(open_["head"], F.lit(" "))).when(open_["chars"] <= _HEADING_CHARS + 1, F.left(open_["head"], open_["chars"] - 1)).otherwise(open_["head"])
    chars = F.when(how == SPACED, open_["chars"] + 1).otherwise(open_["chars"] - 1)
    same = how != NEW
    return F.struct(
        F.when(same, F.left(F.concat(kept, part["head"]), F.lit(_HEADING_CHARS + 1))).otherwise(part["head"]).alias("head"),
        F.when(same, chars + part["chars"]).otherwise(part["chars"]).alias("chars"),
        F.when(same, open_["parens"] + part["parens"]).otherwise(part["parens"]).alias("parens"),
        part["lower"].alias("lower"),
        part["hyphen"].alias("hyphen"),
        part["ends"].alias("ends"),
    )


def tidied(text: Column) -> Column:
    """Trimmed, and with one blank line at most between paragraphs."""
    return X.trimmed(F.regexp_replace(X.trimmed(text), "\n{3,}", "\n\n"))


def merged(parts: Column) -> Column:
    """An ordered array of texts as one text, with blank lines between paragraphs."""
    no_paragraph = F.struct(F.lit("").alias("head"), F.lit(0).alias("chars"), F.lit(0).alias("parens"), F.lit(False).alias("lower"), F.lit(False).alias("hyphen"), F.lit(False).alias("ends"))

    def joined(own: Column) -> Column:
        ways = scan(F.transform(own, _facts), no_paragraph, _how, _opened, "int")
        between = lambda how, i: F.when((i == 0) | (how == BROKEN), "").when(how == SPACED, " ").otherwise("\n\n")
        whole = lambda p, following: F.when(F.coalesce(following == BROKEN, F.lit(False)), F.left(p, F.char_length(p) - 1)).otherwise(p)
        return X.bound(ways, lambda how: F.array_join(F.transform(own, lambda p, i: F.concat(between(F.get(how, i), i), whole(p, F.get(how, i + 1)))), ""))

    return tidied(X.bound(F.filter(F.transform(parts, X.trimmed), lambda p: p != ""), joined))


def cleaned_text(classified: DataFrame) -> DataFrame:
    """(doc_id, text, language): every document's narrative; a document without any has the empty text.

    A document's blocks meet in one row here: the result is one text anyway.
    """
    texts = classified.groupBy("doc_id").agg(merged(emitted_parts()).alias("text"))
    return texts.select("doc_id", "text", X.detected_language(F.col("text")).alias("language"))


def emitted_parts() -> Column:
    """A document's emitted texts in order, as an aggregate."""
    return F.transform(F.sort_array(F.collect_list(F.when(F.col("emitted"), F.struct("ord", "out")))), lambda p: p["out"])
