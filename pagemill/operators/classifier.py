"""An external block classifier: batches, prompts, verdicts.

Batching is greedy packing with three reasons to flush, so it is a fold over a document's blocks.
Everything but the call itself is column expressions. The client is any function from a prompt to a
reply; a batch whose reply fails or can't be read is kept as it is, and reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import patterns as P
from pagemill.functions import text as X
from pagemill.functions.folds import scan

MOST_BLOCKS, MOST_CHARS, EXCERPT_CHARS = 20, 6000, 700
_REPLY = "order array<int>, results array<struct<id:int,action:string,reason:string>>"


def batches(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``batch``, from 0 in each document: 20 blocks, 6000 characters or one page at most."""
    sizes = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"), F.coalesce("page_no", F.lit(0)).alias("page")))).alias("b"))
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(-1).alias("page"))

    def number(acc: Column, x: Column) -> Column:
        full = (acc["n"] == 0) | (acc["n"] >= MOST_BLOCKS) | (acc["chars"] + x["chars"] > MOST_CHARS) | ((acc["page"] >= 0) & (acc["page"] != x["page"]))
        return acc["batch"] + full.cast("int")

    def filled(acc: Column, x: Column, batch: Column) -> Column:
        new = batch != acc["batch"]
        return F.struct(batch.alias("batch"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), F.when(new, x["chars"]).otherwise(acc["chars"] + x["chars"]).alias("chars"), x["page"].alias("page"))

    numbered = sizes.select("doc_id", "b", scan(F.col("b"), start, number, filled, "int").alias("batches"))
    found = numbered.select("doc_id", "batches", F.posexplode("b").alias("at", "x")).select("doc_id", F.col("x.ord").alias("ord"), F.element_at("batches", F.col("at") + 1).alias("batch"))
    return blocks.join(found, ["doc_id", "ord"])


def prompts(batched: DataFrame) -> DataFrame:
    """(doc_id, batch, prompt): a batch's blocks as JSON, with shortened texts."""
    x, y = F.col("bbox.left"), F.col("bbox.top")
    row = F.struct(F.col("ord").alias("id"), F.nullif("page_no", F.lit(0)).alias("page"), F.nullif("label", F.lit("")).alias("label"), F.nullif(x, F.lit(0.0)).alias("x"), F.nullif(y, F.lit(0.0)).alias("y"), X.truncated(F.coalesce("text", F.lit("")), EXCERPT_CHARS).alias("excerpt"))
    return batched.groupBy("doc_id", "batch").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("prompt"))


def replies(asked: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """(doc_id, batch, content, error): the client's reply to each prompt; an exception is an error, no failure."""

    def call(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for doc, batch, prompt in zip(pdf.doc_id, pdf.batch, pdf.prompt, strict=True):
                try:
                    out.append((doc, batch, client(prompt), None))
                except Exception as x:  # noqa: BLE001 - one batch's failure must not lose the others
                    out.append((doc, batch, None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(out, columns=["doc_id", "batch", "content", "error"])

    return asked.mapInPandas(call, "doc_id bigint, batch int, content string, error string")


def without_fence(content: Column) -> Column:
    """A reply without the code fence that may stand around it."""
    t = X.trimmed(content)
    body = F.regexp_replace(F.regexp_replace(t, r"\A```(?:[^\n]*\n)?", ""), r"(?s)\A(.*)```.*\z", "$1")
    return F.when(t.startswith("```"), X.trimmed(body)).otherwise(t)


def verdicts(replied: DataFrame) -> DataFrame:
    """``replied`` with ``reply`` (order and results) and the error of those that are no JSON."""
    reply = F.from_json(without_fence(F.col("content")), _REPLY)
    parsed = replied.withColumn("reply", reply)
    # a text that is no JSON object has neither field
    bad = F.col("error").isNull() & F.coalesce(F.col("reply.order").isNull() & F.col("reply.results").isNull(), F.lit(True)) & ~F.coalesce(without_fence(F.col("content")).rlike(r"\A\{[\s\S]*\}\z"), F.lit(False))
    return parsed.withColumn("error", F.when(bad, "parse JSON verdicts").otherwise(F.col("error")))


def is_structural(label: Column, text: Column) -> Column:
    """Headings that the rules need are never dropped."""
    return F.lower(X.trimmed(label)).isin("section_header", "title") & X.matches(X.trimmed(text), P.STRUCTURAL_HEADING, True)


def applied(batched: DataFrame, judged: DataFrame) -> DataFrame:
    """Blocks that stay, with ``new_ord``: in the order of the reply, and those it doesn't name after them.

    Unknown ids are ignored, of a repeated id the first place and the last action count; any action
    but DROP keeps.
    """
    ok = judged.where("error is null")
    places = ok.select("doc_id", "batch", F.posexplode(F.array_distinct(F.coalesce("reply.order", F.array().cast("array<int>")))).alias("pos", "ord"))
    results = ok.select("doc_id", "batch", F.posexplode(F.coalesce("reply.results", F.array().cast("array<struct<id:int,action:string,reason:string>>"))).alias("p", "r"))
    acts = results.groupBy("doc_id", "batch", F.col("r.id").alias("ord")).agg(F.max_by(F.upper(X.trimmed(F.col("r.action"))), "p").alias("action"))
    x = batched.join(places, ["doc_id", "batch", "ord"], "left").join(acts, ["doc_id", "batch", "ord"], "left")
    kept = x.where((F.coalesce("action", F.lit("KEEP")) != "DROP") | is_structural(F.coalesce("label", F.lit("")), F.coalesce("text", F.lit(""))))
    order = W.partitionBy("doc_id").orderBy("batch", F.coalesce("pos", F.lit(1_000_000_000)), "ord")
    return kept.withColumn("new_ord", F.row_number().over(order) - 1).drop("pos", "action")


def merged_stats(cleaned: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Counters after a review: what the classifier dropped counts as dropped and as seen.

    ``cleaned``: doc_id, total, kept, dropped of the second cleaning; ``reviewed``: doc_id, processed, removed.
    """
    r = cleaned.join(reviewed, "doc_id", "left")
    removed = F.coalesce("removed", F.lit(0))
    return r.select("doc_id", (F.col("total") + removed).alias("total"), "kept", (F.col("dropped") + removed).alias("dropped"), F.coalesce("processed", F.lit(0)).alias("reviewed"), removed.alias("review_dropped"), F.lit(0).alias("review_rewritten"))


# What a reply may have, and how long it may take.
MOST_REPLY_BYTES, TIMEOUT_S, ERROR_CHARS, MOST_TOKENS = 2 << 20, 150, 300, 2048
INSTRUCTIONS = (
    "You review blocks of text from pages of a scientific article, in reading order. Keep narrative prose and section headings; "
    "drop affiliations, dates, keywords, labels of figures and tables, identifiers, addresses, page numbers, licence and copyright lines. "
    'Change no text. Answer with JSON only: {"order":[id,...],"results":[{"id":id,"action":"KEEP" or "DROP","reason":"short"}]}'
)


def http_client(base_url: str, model: str = "", key: str = "", timeout: float = TIMEOUT_S) -> Callable[[str], str]:
    """A client of a chat-completion endpoint, for ``replies``: no redirects, a bounded reply, temperature 0."""

    def call(prompt: str) -> str:
        import json
        import urllib.error
        import urllib.request

        class Stay(urllib.request.HTTPRedirectHandler):
            def redirect_request(self, *a, **k):
                return None

        body = {"model": model, "messages": [{"role": "system", "content": INSTRUCTIONS}, {"role": "user", "content": prompt}], "temperature": 0, "max_tokens": MOST_TOKENS}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key.strip() else {})
        request = urllib.request.Request(base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.build_opener(Stay).open(request, timeout=timeout) as r:
                data = r.read(MOST_REPLY_BYTES + 1)
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"HTTP {e.code}: {e.read(4 * ERROR_CHARS).decode(errors='replace')[:ERROR_CHARS]}") from None
        if len(data) > MOST_REPLY_BYTES:
            raise RuntimeError(f"reply exceeds {MOST_REPLY_BYTES} bytes")
        reply = json.loads(data)
        if (reply.get("error") or {}).get("message"):
            raise RuntimeError(f"server error: {reply['error']['message']}")
        if not reply.get("choices"):
            raise RuntimeError("completion contains no choices")
        return reply["choices"][0]["message"]["content"]

    return call
