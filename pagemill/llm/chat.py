"""Quotation linking: conversations in reply order, without the quotes.

Messages quote earlier ones by lines that begin with ``>``, once for each level. A quoted passage is
a run of lines of one level in one message. Its text is normalised (marks gone, ASCII letters
lower-cased, white space as single spaces, no blank lines) and hashed, by lines and by words. A passage is linked to the
latest earlier message of its conversation that holds it: as a run of whole lines; else, if it has
three words or more, as a run of words, however lines are wrapped, or as the whole body; and only if none does, the latest that
holds its first line. Of the messages only those runs are hashed that begin as some passage of the
conversation does and are as long. Hashes that decide a link have 128 bits and are taken of texts.

The level-1 passage that is linked to the latest message makes that message the parent; a message
without linked quotes answers the one before it, and the first of a conversation answers none. Reply
order is that of the tree of answers: after a message come its answers, the earliest first, each
with all that answers it.

Everything is DataFrame functions; no conversation is gathered into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import WorkTables

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Quote marks at the beginning of a line, with single blanks between them.
_MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"
#: Kinds of runs, and how many units a run begins with that has to be looked for.
_LINES, _WORDS = "l", "w"
_BEGIN = {_LINES: 2, _WORDS: 3}
#: Ways to be linked, the best last: by the first line, as a run of words, as a run of lines.
_FIRST, _BY_WORDS, _BY_LINES = 0, 1, 2


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[ \t\n\x0B\f\r]+", " "))


def quote_level(line: Column) -> Column:
    """How many quote marks stand at the beginning of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def unquoted(line: Column) -> Column:
    return F.regexp_replace(line, _MARKS, "")


def line_units(text: Column) -> Column:
    """Array of a text's normalised lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")


def word_units(text: Column) -> Column:
    """Array of a text's normalised words."""
    return F.filter(F.split(normalised(text), " "), lambda x: x != "")


def run_hash(kind: str, units: Column) -> Column:
    return F.md5(F.concat(F.lit(kind), F.array_join(units, "\n" if kind == _LINES else " ")).cast("binary"))


def lines_of(text: Column) -> Column:
    """Array of (no, level, text) of a message's lines."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    return F.transform(parts, lambda s, i: F.struct(i.alias("no"), quote_level(s).alias("level"), unquoted(s).alias("text")))


def passages_of(lines: Column) -> Column:
    """Array of (no, level, text) of the runs of quoted lines of one level; ``no`` is the first line's."""

    def field(name: str) -> Column:
        return F.transform(lines, lambda x: x[name])

    def cut(x: Column) -> Column:
        begins = F.filter(x["no"], lambda i: (i == 0) | (F.get(x["level"], i) != F.get(x["level"], i - 1)))
        until = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(x["no"]))
        run = lambda at: F.transform(at, lambda i, k: F.struct(i.alias("no"), F.get(x["level"], i).alias("level"), F.array_join(F.slice(x["text"], i + 1, until(at, k) - i), "\n").alias("text")))
        return F.element_at(F.transform(F.array(begins), run), 1)

    none = F.array().cast("array<struct<no:int,level:int,text:string>>")
    columns = F.struct(*[field(c).alias(c) for c in ("no", "level", "text")])
    runs = F.when(F.exists(lines, lambda x: x["level"] > 0), F.element_at(F.transform(F.array(columns), cut), 1)).otherwise(none)
    return F.filter(runs, lambda p: (p["level"] > 0) & (normalised(p["text"]) != ""))


def link_quotes(
    messages: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row for each message, with its parent and its place in reply order.

    Columns: conv_id, turn, role, body (the text without quoted lines), n_passages, n_linked,
    max_level, links (an array of level, source and whole: the linked passages in order, the turn each is
    linked to, and whether that message holds all of it), reply_to (the parent's turn), thread (the turn that began
    this run of answers, each to the message before it), root (the conversation's first turn), depth and
    reply_order (from 0, without gaps over a conversation's turns).

    A null or empty text is an empty body. A null conversation or turn stands for itself: such rows link to nothing.
    Repeated (conversation, turn) rows are kept each and share the links and the place. Messages that hold a passage
    alike are told apart by their turn: the latest counts. Texts are read whole; an empty table
    gives an empty result; other columns are not read.
    """
    spark = messages.sparkSession
    work = WorkTables(spark, "chat")
    text = F.col(f"`{text_col}`").cast("string")
    base = messages.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("role"),
        lines_of(text).alias("lines"),
    )
    parsed = base.select(
        "conv_id",
        "turn",
        "role",
        passages_of(F.col("lines")).alias("passages"),
        F.array_max(F.transform("lines", lambda x: x["level"])).alias("max_level"),
        F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["text"]).alias("own"),
    ).select(
        "conv_id",
        "turn",
        "role",
        "passages",
        "max_level",
        F.regexp_replace(F.array_join("own", "\n"), r"\A[ \t\n]+|[ \t\n]+\z", "").alias("body"),
    )
    parsed = work.keep(parsed, "parsed")
    keyed = parsed.where("conv_id is not null and turn is not null")
    quoted = keyed.where(F.size("passages") > 0).select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", F.col("p.no").alias("no"), F.col("p.level").alias("level"), line_units(F.col("p.text")).alias("lines"), word_units(F.col("p.text")).alias("words")).distinct()
    quoted = work.keep(quoted, "quoted")
    quoting = keyed.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.col("turn").alias("source"), line_units(F.col("body")).alias("lines"), word_units(F.col("body")).alias("words")).distinct()
    own = quoting.select("conv_id", "source", F.explode(F.array_append(F.transform("lines", lambda x: run_hash(_LINES, F.array(x))), run_hash(_WORDS, F.col("words")))).alias("h"))
    index = own.unionByName(_runs(quoting, quoted, _LINES, "lines")).unionByName(_runs(quoting, quoted, _WORDS, "words")).distinct()
    ways = F.array(*[F.struct(F.lit(way).alias("way"), h.alias("h")) for way, h in ((_BY_LINES, run_hash(_LINES, F.col("lines"))), (_BY_WORDS, run_hash(_WORDS, F.col("words"))), (_FIRST, run_hash(_LINES, F.slice("lines", 1, 1))))])
    passage = F.struct("no", "level", run_hash(_WORDS, F.col("words")).alias("text"))
    wanted = quoted.select("conv_id", "turn", passage.alias("passage"), F.explode(ways).alias("w")).select("conv_id", "turn", "passage", "w.way", "w.h")
    # an as-of pass over sources and questions together: it makes no pairs
    asked = wanted.select("conv_id", "h").distinct()
    nothing = {"passage": wanted.schema["passage"].dataType, "way": "int"}
    sources = index.join(asked, ["conv_id", "h"], "left_semi").select("conv_id", "h", F.col("source").alias("at"), F.col("source").alias("value"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    asks = wanted.select("conv_id", "h", F.col("turn").alias("at"), F.lit(None).cast("long").alias("value"), "passage", "way")
    found = _latest_before(sources.unionByName(asks), ["conv_id", "h"], "source")
    found = found.where(F.col("value").isNull() & F.col("source").isNotNull()).withColumnRenamed("at", "turn")
    found = found.groupBy("conv_id", "turn", "passage").agg(F.max(F.struct("way", "source")).alias("best"))
    link = F.struct(F.col("passage.no").alias("no"), F.col("passage.level").alias("level"), F.col("passage.text").alias("text"), F.col("best.source").alias("source"), (F.col("best.way") > _FIRST).alias("whole"))
    in_order = F.transform(F.sort_array(F.collect_list(link)), lambda x: F.struct(x["level"].cast("long").alias("level"), x["source"].alias("source"), x["whole"].alias("whole")))
    links = found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"), F.max(F.when(F.col("passage.level") == 1, F.col("best.source"))).alias("quoted_turn"), in_order.alias("links"))
    links = work.keep(links, "links")
    turns = keyed.select("conv_id", F.col("turn").alias("at"), F.col("turn").alias("value")).distinct()
    follow = _latest_before(turns, ["conv_id"], "before").select("conv_id", F.col("at").alias("turn"), "before")
    parents = follow.join(links.select("conv_id", "turn", "quoted_turn"), ["conv_id", "turn"], "left").select("conv_id", "turn", "before", F.coalesce("quoted_turn", "before").alias("reply_to"))
    tree = _threads(work, work.keep(parents, "parents"))
    out = parsed.join(work.keep(tree, "tree"), ["conv_id", "turn"], "left").join(links.drop("quoted_turn"), ["conv_id", "turn"], "left")
    none = F.array().cast(links.schema["links"].dataType)
    return out.select(
        "conv_id",
        "turn",
        "role",
        "body",
        F.size("passages").cast("long").alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"),
        F.coalesce("links", none).alias("links"),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("root", "turn").alias("root"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("reply_order", F.lit(0)).cast("long").alias("reply_order"),
    )


def _runs(messages: DataFrame, quoted: DataFrame, kind: str, units: str) -> DataFrame:
    """(conv_id, source, h): runs of a message's lines or words, where a passage of their conversation begins alike and is as long.

    Places meet the distinct beginnings and lengths of passages, never the passages; a message's runs are
    hashed where its lines are.
    """
    n = _BEGIN[kind]
    begin = lambda xs: F.xxhash64(F.slice(xs, 1, n))
    lengths = quoted.where(F.size(units) >= n).select("conv_id", begin(F.col(units)).alias("begin"), F.size(units).alias("m")).distinct()
    own = messages.where(F.size(units) >= n).select("conv_id", "source", units, F.xxhash64(units).alias("key")).distinct()
    begins = F.transform(F.sequence(F.lit(0), F.size(units) - n), lambda i: F.xxhash64(F.slice(units, i + 1, F.lit(n))))
    places = own.select("conv_id", "source", "key", F.size(units).alias("n"), F.posexplode(begins).alias("i", "begin"))
    found = places.join(lengths, ["conv_id", "begin"]).where("i + m <= n").groupBy("conv_id", "source", "key").agg(F.collect_list(F.struct("i", "m")).alias("at"))
    h = F.transform("at", lambda x: run_hash(kind, F.slice(units, x["i"] + 1, x["m"])))
    return own.join(found, ["conv_id", "source", "key"]).select("conv_id", "source", F.explode(F.array_distinct(h)).alias("h"))


def _latest_before(rows: DataFrame, keys: list[str], name: str, block: int = 1024) -> DataFrame:
    """``rows`` with the largest ``value`` that stands before their place ``at`` among equal ``keys``.

    In two levels, inside blocks of ``at`` and over the blocks' own maxima, so that a key which a third
    of all rows share is no single task. Rows with a value have it equal to ``at``.
    """
    rows = rows.withColumn("block", F.floor(F.col("at") / block))
    inside = F.max("value").over(W.partitionBy(*keys, "block").orderBy("at", F.col("value").isNotNull()).rowsBetween(W.unboundedPreceding, -1))
    tops = rows.groupBy(*keys, "block").agg(F.max("value").alias("top"))
    carried = tops.select(*keys, "block", F.max("top").over(W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    return rows.withColumn(name, inside).join(carried, [*keys, "block"]).withColumn(name, F.coalesce(name, "carried")).drop("block", "carried")


def _running(rows: DataFrame, value, how, name: str, block: int = 1024) -> DataFrame:
    """``rows`` with ``how`` of ``value`` over their conversation's rows up to their turn, in two levels."""
    rows = rows.withColumn("block", F.floor(F.col("turn") / block)).withColumn("value", value)
    upto = W.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = rows.groupBy("conv_id", "block").agg(how("value").alias("of_block"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", how("of_block").over(before).alias("carried"))
    both = rows.withColumn("inside", how("value").over(upto)).join(carried, ["conv_id", "block"])
    return both.withColumn(name, _either(how, F.col("inside"), F.col("carried"))).drop("block", "value", "inside", "carried")


def _either(how, a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if how is F.sum else F.coalesce(a, b)


def _threads(work: WorkTables, parents: DataFrame) -> DataFrame:
    """Thread, root, depth and place in reply order of every message.

    Most messages answer the one before them; such runs are threads, and only threads are followed up
    to their roots, by pointer doubling: each round doubles the distance known, for what is still open.
    """
    starts = F.when(~F.coalesce(F.col("reply_to") == F.col("before"), F.lit(False)), F.col("turn"))
    rows = work.keep(_running(_running(parents, F.lit(1).cast("long"), F.sum, "index"), starts, F.max, "thread"), "runs")
    first = rows.where("turn = thread").select("conv_id", "thread", "reply_to", F.col("index").alias("first_index"))
    rows = rows.join(first.select("conv_id", "thread", "first_index"), ["conv_id", "thread"]).withColumn("place", F.col("index") - F.col("first_index"))
    parent = rows.select("conv_id", F.col("turn").alias("reply_to"), F.col("thread").alias("up"), (F.col("place") + 1).alias("up_depth"))
    open_ = first.where("reply_to is not null").join(parent, ["conv_id", "reply_to"]).select("conv_id", "thread", "up", F.col("up_depth").alias("depth"))
    done = first.where("reply_to is null").select("conv_id", "thread", F.col("thread").alias("root"), F.lit(0).cast("long").alias("depth"))
    open_, done = work.keep(open_, "open"), work.keep(done, "done")
    while not open_.isEmpty():
        above = done.select("conv_id", F.col("thread").alias("up"), "root", F.col("depth").alias("more"), F.lit(None).cast("long").alias("next")).unionAll(
            open_.select("conv_id", F.col("thread").alias("up"), F.lit(None).cast("long").alias("root"), F.col("depth").alias("more"), F.col("up").alias("next"))
        )
        moved = work.keep(open_.join(above, ["conv_id", "up"]).select("conv_id", "thread", "root", "next", (F.col("depth") + F.col("more")).alias("depth")), "moved")
        done = done.unionAll(moved.where("root is not null").select("conv_id", "thread", "root", "depth"))
        open_ = moved.where("root is null").select("conv_id", "thread", F.col("next").alias("up"), "depth")
    sizes = rows.groupBy("conv_id", "thread").agg(F.count(F.lit(1)).alias("size"))
    hung = first.where("reply_to is not null").join(parent.drop("up_depth"), ["conv_id", "reply_to"]).select("conv_id", "thread", "up", "reply_to")
    hung = work.keep(hung, "hung")
    if not hung.isEmpty():
        starts = _preorder(work, hung, sizes)
        found = rows.join(starts, ["conv_id", "thread"], "left").withColumn("begin", F.coalesce("begin", F.lit(0)))
    else:
        found = rows.withColumn("begin", F.lit(0))
    found = found.join(done.select("conv_id", "thread", "root", F.col("depth").alias("above")), ["conv_id", "thread"])
    return found.select("conv_id", "turn", "reply_to", "thread", "root", (F.col("above") + F.col("place")).alias("depth"), (F.col("begin") + F.col("place")).alias("reply_order"))


def _preorder(work: WorkTables, hung: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, thread, begin): the place of each thread's first message in reply order, in conversations of several threads.

    ``hung``: the threads that begin at a message of another, ``up``: that which has the turn ``reply_to``. Below a message its thread goes
    on first, so threads that hang on later messages of a thread come before those on earlier ones,
    and those on one message by their turn. The walk around the tree, into each thread and out of it, is a list; what is
    still to come from each of its places is summed by pointer doubling.
    """
    # the next on the same message is the smallest turn above; with signs turned, the latest before
    along = hung.select("conv_id", "reply_to", "up", (-F.col("thread")).alias("at"), (-F.col("thread")).alias("value"))
    along = _latest_before(along, ["conv_id", "reply_to"], "next").select("conv_id", "reply_to", "up", (-F.col("at")).alias("thread"), (-F.col("next")).alias("next"))
    firsts = hung.groupBy("conv_id", "up", "reply_to").agg(F.min("thread").alias("first"))
    lower = _latest_before(firsts.select("conv_id", "up", F.col("reply_to").alias("at"), F.col("reply_to").alias("value")), ["conv_id", "up"], "lower").select("conv_id", "up", F.col("at").alias("reply_to"), F.col("lower"))
    lower = lower.join(firsts.select("conv_id", "up", F.col("reply_to").alias("lower"), F.col("first").alias("below")), ["conv_id", "up", "lower"]).select("conv_id", "up", "reply_to", "below")
    siblings = along.join(lower, ["conv_id", "up", "reply_to"], "left").select("conv_id", "thread", "up", F.coalesce("next", "below").alias("sibling"))
    children = firsts.groupBy("conv_id", F.col("up").alias("thread")).agg(F.max_by("first", "reply_to").alias("child"))
    threads = sizes.join(hung.select("conv_id").distinct(), "conv_id", "left_semi").join(siblings, ["conv_id", "thread"], "left").join(children, ["conv_id", "thread"], "left")
    threads = work.keep(threads, "siblings")
    step = lambda out, to, to_out, size: F.struct(F.lit(out).alias("out"), to.alias("to"), to_out.alias("to_out"), size.alias("left"))
    into = step(False, F.coalesce("child", "thread"), F.col("child").isNull(), F.col("size"))
    back = step(True, F.coalesce("sibling", "up"), F.col("sibling").isNull(), F.lit(0).cast("long"))
    walk = threads.select("conv_id", "thread", F.explode(F.array(into, back)).alias("s")).select("conv_id", "thread", "s.out", "s.to", "s.to_out", "s.left")
    walk = work.keep(walk, "walk")
    while not (ahead := walk.where("to is not null")).isEmpty():
        further = walk.select("conv_id", F.col("thread").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("to2"), F.col("to_out").alias("to_out2"), F.col("left").alias("more"))
        moved = ahead.join(further, ["conv_id", "to", "to_out"]).select("conv_id", "thread", "out", F.col("to2").alias("to"), F.col("to_out2").alias("to_out"), (F.col("left") + F.col("more")).alias("left"))
        before, walk = walk, work.keep(walk.where("to is null").unionAll(moved), "walk")
        work.drop(before)
    begun = walk.where("not out").select("conv_id", "thread", "left")
    total = begun.groupBy("conv_id").agg(F.max("left").alias("total"))
    return begun.join(total, "conv_id").select("conv_id", "thread", (F.col("total") - F.col("left")).alias("begin"))
