"""Queries of the rule cascade, over the lines of ``documents`` and the elements of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import patterns as P
from pagemill.functions import text as X
from pagemill.functions.shared import spread
from pagemill.operators import clean, fold
from pagemill.plans.registry import query
from pagemill.sources import blocks as B

#: Lines of documents as blocks, with their normalised text.
SQL_LINES = f"""
line AS (
  SELECT doc_id, CAST(ord - 1 AS INTEGER) AS ord, text FROM (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS ord, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
), normal AS (
  SELECT doc_id, ord, text, {X.sql_normalized("text")} AS norm FROM line
)"""

_RULES = " ".join(f"WHEN {sql('norm')} THEN '{name}'" for name, _, sql in X.PROSE_RULES)


def sql_cascade(source: str) -> str:
    """The whole cascade for blocks (doc_id, ord, norm) that are all paragraphs, as DuckDB queries up to ``classified``."""
    return f"""counted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, lower(norm)) AS n FROM {source}
), ruled AS (
  SELECT doc_id, ord, norm, CASE WHEN norm = '' THEN 'empty' WHEN length(norm) <= 90 AND n >= 3 THEN 'repeated_furniture' {_RULES} END AS rule0,
         {X.sql_normalized(X.sql_without_citations("norm"))} AS bare
  FROM counted
), classified AS (
  SELECT doc_id, ord, norm, CASE WHEN rule0 IS NULL AND bare = '' THEN 'citations_only' ELSE rule0 END AS rule, CASE WHEN rule0 IS NULL AND bare <> '' THEN bare END AS out FROM ruled
)"""


SQL_CASCADE = f"{SQL_LINES}, {sql_cascade('normal')}"


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id and text of documents, and columns ``more``, dealt out over the cores if the table is small."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *more))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_documents(documents(spark, sf_dir))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_pages(spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.classify(lines(spark, sf_dir))


@query("blocks_from_documents", f"WITH {SQL_LINES} SELECT doc_id, ord, text FROM line")
def blocks_from_documents(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "ord", "text")


@query("blocks_from_pages", B.sql_from_pages())
def blocks_from_pages(spark, sf_dir):
    return html_blocks(spark, sf_dir).select("doc_id", "ord", "text", "label")


@query("blocks_union", f"WITH {SQL_LINES} SELECT 'line' AS kind, count(*) AS n FROM line UNION ALL SELECT 'html', count(*) FROM ({B.sql_from_pages()})")
def blocks_union(spark, sf_dir):
    both = lines(spark, sf_dir).select(F.lit("line").alias("kind")).unionByName(html_blocks(spark, sf_dir).select(F.lit("html").alias("kind")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_text", f"WITH {SQL_LINES} SELECT doc_id, ord, norm FROM normal")
def normalize_text(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "ord", X.normalized(F.col("text")).alias("norm"))


@query("remove_citations", f"WITH {SQL_LINES} SELECT doc_id, ord, {X.sql_without_citations('norm')} AS bare FROM normal")
def remove_citations(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "ord", X.without_citations(X.normalized(F.col("text"))).alias("bare"))


def _rule_query(name, fits, sql):
    @query(f"rule_{name}", f"WITH {SQL_LINES} SELECT doc_id, ord, {sql('norm')} AS fits FROM normal")
    def rule(spark, sf_dir):
        b = lines(spark, sf_dir).select("doc_id", "ord", X.normalized(F.col("text")).alias("norm"))
        return b.select("doc_id", "ord", fits(F.col("norm")).alias("fits"))


for _name, _fits, _sql in X.PROSE_RULES:
    _rule_query(_name, _fits, _sql)


@query("short_headings", f"WITH {SQL_LINES} SELECT doc_id, ord, {X.sql_is_short_heading('norm')} AS short, {X.sql_ends_sentence('norm')} AS ends, {X.sql_is_title_case('norm')} AS title_case FROM normal")
def short_headings(spark, sf_dir):
    b = lines(spark, sf_dir).select("doc_id", "ord", X.normalized(F.col("text")).alias("norm"))
    t = F.col("norm")
    return b.select("doc_id", "ord", X.is_short_heading(t).alias("short"), X.ends_sentence(t).alias("ends"), X.is_title_case(t).alias("title_case"))


@query("repeated_furniture", f"WITH {SQL_LINES} SELECT doc_id, lower(norm) AS key, count(*) AS n FROM normal WHERE norm <> '' AND length(lower(norm)) <= 90 GROUP BY doc_id, lower(norm) HAVING count(*) >= 3")
def repeated_furniture(spark, sf_dir):
    b = lines(spark, sf_dir).select("doc_id", F.lower(X.normalized(F.col("text"))).alias("key"))
    return b.where((F.col("key") != "") & (F.char_length("key") <= 90)).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("classified_blocks", f"WITH {SQL_CASCADE} SELECT doc_id, ord, rule, out FROM classified")
def classified_blocks(spark, sf_dir):
    return classified(spark, sf_dir).select("doc_id", "ord", "rule", "out")


@query("drop_by_rule_counts", f"WITH {SQL_CASCADE} SELECT doc_id, 'rule' AS bucket, rule, count(*) AS n FROM classified WHERE rule IS NOT NULL GROUP BY doc_id, rule")
def drop_by_rule_counts(spark, sf_dir):
    return clean.drop_counts(classified(spark, sf_dir))


@query("stats_per_doc", f"WITH {SQL_CASCADE}, counts AS (SELECT doc_id, rule, count(*) AS n FROM classified GROUP BY doc_id, rule) SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (rule IS NULL), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (rule IS NOT NULL), 0) AS BIGINT) AS dropped, coalesce(string_agg(rule || '=' || n, ', ' ORDER BY rule) FILTER (rule IS NOT NULL), '') AS by_rule FROM counts GROUP BY doc_id")
def stats_per_doc(spark, sf_dir):
    s = clean.stats(classified(spark, sf_dir))
    return s.select("doc_id", "total", "kept", "dropped", clean.formatted_counts(F.col("dropped_by_rule")).alias("by_rule"))


_LABELLED = f"""block AS ({B.sql_from_pages()}), normal AS (SELECT doc_id, ord, label, {X.sql_normalized("text")} AS norm FROM block)"""


@query("heading_class", f"WITH {_LABELLED} SELECT doc_id, ord, {X.sql_heading_class('norm')} AS class FROM normal WHERE label IN ('title', 'section_header')")
def heading_class(spark, sf_dir):
    b = html_blocks(spark, sf_dir).where(F.col("label").isin(*P.HEADING_LABELS)).select("doc_id", "ord", X.normalized(F.col("text")).alias("norm"))
    return b.select("doc_id", "ord", X.heading_class(F.col("norm")).alias("class"))


#: A signal for every eleventh block and its opposite for every seventh, so that sections alternate.
_SIGNALS = "CASE WHEN ord % 11 = 3 THEN true WHEN ord % 7 = 5 THEN false END"


@query("section_skip_state", f"WITH {SQL_LINES} SELECT doc_id, ord, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS skipping FROM (SELECT doc_id, ord, {_SIGNALS} AS signal FROM line)")
def section_skip_state(spark, sf_dir):
    b = lines(spark, sf_dir)
    return b.select("doc_id", "ord", clean.in_skipped_section(F.expr(_SIGNALS)).alias("skipping"))


_PAGE_RULES = f"""WITH {_LABELLED}, counted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, lower(norm)) AS n FROM normal
), early AS (
  SELECT *, CASE WHEN norm = '' THEN 'empty' WHEN label IN {P.DROP_LABELS} THEN label WHEN length(norm) <= 90 AND n >= 3 THEN 'repeated_furniture' END AS rule1,
         CASE WHEN label IN ('title', 'section_header') THEN {X.sql_heading_class("norm")} END AS class
  FROM counted
), carried AS (
  SELECT *, coalesce(last_value(CASE WHEN rule1 IS NULL AND class = 'drop' THEN true WHEN rule1 IS NULL AND class IN ('keep', 'unknown') THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS skipping
  FROM early
)
SELECT doc_id, ord, label, coalesce(rule1, CASE WHEN class IN ('drop', 'drop_heading_only') THEN 'section_heading_drop' WHEN class IS NULL THEN CASE WHEN skipping THEN 'section_skip' {_RULES} END END,
       CASE WHEN class IS NULL AND {X.sql_normalized(X.sql_without_citations("norm"))} = '' THEN 'citations_only' END) AS rule
FROM carried"""


@query("classified_pages", _PAGE_RULES)
def classified_pages(spark, sf_dir):
    return clean.classify(html_blocks(spark, sf_dir)).select("doc_id", "ord", "label", "rule")


#: A label of every kind for the lines of documents, and headings that switch sections.
_KINDS = "CASE ord % 19 WHEN 2 THEN 'section_header' WHEN 5 THEN ' Reference ' WHEN 8 THEN 'title' WHEN 9 THEN 'footnote' WHEN 11 THEN 'odd' WHEN 13 THEN 'list_item' WHEN 14 THEN 'Table' WHEN 17 THEN '' ELSE 'paragraph' END"
_HEADINGS = "CASE WHEN ord % 19 IN (2, 8) THEN CASE (doc_id + ord) % 5 WHEN 0 THEN 'References' WHEN 1 THEN '2. Methods' WHEN 2 THEN 'Research Article' WHEN 3 THEN 'Data availability statement' ELSE text END WHEN ord % 19 = 11 AND doc_id % 2 = 0 THEN '12 %' ELSE text END"


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).withColumn("text", F.expr(_HEADINGS)).withColumn("label", F.expr(_KINDS))


def _sql_labelled(keep_headings: bool) -> str:
    return f"""WITH {SQL_LINES}, kind AS (
  SELECT doc_id, ord, lower(trim({_KINDS})) AS label, {X.sql_normalized(f"({_HEADINGS})")} AS norm FROM line
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, lower(norm)) AS n FROM kind
), early AS (
  SELECT *, CASE WHEN norm = '' THEN 'empty' WHEN label IN {P.DROP_LABELS} THEN label WHEN label <> '' AND label NOT IN {P.KEEP_LABELS} AND {X.sql_is_non_prose("norm")} THEN 'non_prose:' || label
         WHEN length(norm) <= 90 AND n >= 3 THEN 'repeated_furniture' END AS rule1, CASE WHEN label IN ('title', 'section_header') THEN {X.sql_heading_class("norm")} END AS class FROM counted
), carried AS (
  SELECT *, coalesce(last_value(CASE WHEN norm <> '' AND label = 'reference' THEN true WHEN rule1 IS NULL AND class = 'drop' THEN true WHEN rule1 IS NULL AND class IN ('keep', 'unknown') THEN false END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS skipping FROM early
), ruled AS (
  SELECT *, coalesce(rule1, CASE WHEN class IN ('drop', 'drop_heading_only') THEN 'section_heading_drop' WHEN class IS NULL THEN CASE WHEN skipping THEN 'section_skip' {_RULES} END END,
    CASE WHEN class IS NULL AND {X.sql_normalized(X.sql_without_citations("norm"))} = '' THEN 'citations_only' END) AS rule FROM carried
)
SELECT doc_id, ord, label, skipping, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN rule = label THEN 'label' ELSE 'rule' END END AS bucket, rule IS NULL AND ({"true" if keep_headings else "class IS NULL"}) AS emitted FROM ruled"""


@query("classified_labels", _sql_labelled(True))
def classified_labels(spark, sf_dir):
    return clean.classify(labelled_lines(spark, sf_dir)).select("doc_id", "ord", "label", "skipping", "rule", "bucket", "emitted")


@query("classified_without_headings", _sql_labelled(False))
def classified_without_headings(spark, sf_dir):
    return clean.classify(labelled_lines(spark, sf_dir), clean.Options(keep_headings=False)).select("doc_id", "ord", "label", "skipping", "rule", "bucket", "emitted")


@query("structural_headings", f"WITH {SQL_LINES} SELECT doc_id, ord, {_KINDS} IN ('section_header', 'title') AND {X.sql_matches(X.sql_trimmed('(' + _HEADINGS + ')'), P.STRUCTURAL_HEADING, True)} AS structural FROM line")
def structural_headings(spark, sf_dir):
    from pagemill.operators import classifier

    return labelled_lines(spark, sf_dir).select("doc_id", "ord", classifier.is_structural(F.col("label"), F.col("text")).alias("structural"))


@query("detect_language", f"SELECT doc_id, {X.sql_detected_language('text')} AS language FROM documents")
def detect_language(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.detected_language(F.col("text")).alias("language"))


@query("language_vs_label", f"SELECT lang, {X.sql_detected_language('text')} AS language, count(*) AS n FROM documents GROUP BY 1, 2")
def language_vs_label(spark, sf_dir):
    d = documents(spark, sf_dir, "lang").select("lang", X.detected_language(F.col("text")).alias("language"))
    return d.groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


@query("effective_language", f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lang ELSE coalesce(nullif({X.sql_detected_language('text')}, 'unknown'), 'en') END AS language FROM documents")
def effective_language(spark, sf_dir):
    wanted = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.col("lang")).otherwise("auto")
    d = documents(spark, sf_dir, "lang")
    return d.select("doc_id", X.effective_language(X.detected_language(F.col("text")), wanted).alias("language"))


#: The fold in DuckDB: finished paragraphs and the open one, kept apart by chr(2).
_OPEN = "list_last(string_split(acc, chr(2)))"
_HYPHEN = f"ends_with({_OPEN}, '-') AND regexp_matches(x, '^\\p{{Ll}}')"
_GOES_ON = f"({_HYPHEN}) OR {X.sql_count_of(_OPEN, '(')} > {X.sql_count_of(_OPEN, ')')} OR (regexp_matches(x, '^\\p{{Ll}}') AND NOT {X.sql_is_short_heading(_OPEN)} AND NOT {X.sql_ends_sentence(_OPEN)})"


#: Texts of ``classified`` blocks.
SQL_TEXTS = f"""parts AS (
  SELECT doc_id, list({X.sql_trimmed("out")} ORDER BY ord) FILTER (rule IS NULL) AS p FROM classified GROUP BY doc_id
), folded AS (
  SELECT doc_id, CASE WHEN p IS NULL THEN '' ELSE list_reduce(p, lambda acc, x: CASE WHEN {_HYPHEN} THEN left(acc, length(acc) - 1) || x WHEN {_GOES_ON} THEN acc || ' ' || x ELSE acc || chr(2) || x END) END AS t FROM parts
), joined AS (
  SELECT doc_id, {X.sql_trimmed("regexp_replace(replace(t, chr(2), chr(10) || chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS text FROM folded
)"""


@query("cleaned_text", f"WITH {SQL_CASCADE}, {SQL_TEXTS} SELECT doc_id, text, {X.sql_detected_language('text')} AS language FROM joined")
def cleaned_text(spark, sf_dir):
    return fold.cleaned_text(classified(spark, sf_dir))
