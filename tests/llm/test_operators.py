import collections
import hashlib
import itertools
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat, decontaminate, language, neardup, packing, sharding, token_counts, tokens, topk, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, shard string, scan int, bucket double"


def docs(spark, texts, ids=None):
    """Documents with columns whose names operators use themselves."""
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "x", 1, 0.5) for i, t in zip(ids, texts, strict=True)], DOCS)


WORDS = [f"w{i}" for i in range(60)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# -- near duplicates ------------------------------------------------------------------------------


def plain_components(rows):
    """Components by comparing every pair of sets of words."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(rows)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            part[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted((d, len(s), least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def varied(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def corpus(rng):
    rows = [None, "", " \n\t", "one", "One", "one two", "A B C D E", "a b c d e", "É x y z q", "é x y z q"]
    passage = sentence(rng, 40)
    for _ in range(5):
        base = sentence(rng, 90)
        rows += [base, base, base.upper()] + [varied(rng, base, rng.choice([1, 1, 2, 3, 4])) for _ in range(9)]
        rows += [f"{sentence(rng, 60)} {passage}" for _ in range(4)]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("how", [{}, {"small": 3}, {"block_shingles": 200, "broadcast_bytes": 0}])
def test_near_duplicates(spark, how):
    rows = corpus(random.Random(11))
    got = neardup.near_duplicates(docs(spark, [t for _, t in rows], [d for d, _ in rows]), **how).collect()
    if "small" not in how:
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows)
    else:  # branching below the roots loses a pair now and then in one tree, not in all sixteen
        want = {d: c for d, _, c in plain_components(rows)}
        assert sum(want[r["doc_id"]] == r["component_id"] for r in got) >= len(rows) - 1
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_template_of_many_pages_is_cut_into_blocks(spark):
    rng = random.Random(21)
    base = sentence(rng, 60)
    rows = []
    for i in range(220):  # most pages link with each other, some with none or with a few
        edits = rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 9])
        rows.append((i, varied(rng, base, edits)))
    for how in ({"block_shingles": 900}, {"block_shingles": 3000, "broadcast_bytes": 0}):
        got = neardup.near_duplicates(docs(spark, [t for _, t in rows], [d for d, _ in rows]), **how).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows)


def branched(rng, pairs, shared=24, own=60):
    """Texts that share a passage, and so their roots' tokens; of each pair one is the other's copy, at a similarity just above the threshold."""
    passage = [f"p{i}" for i in range(shared)]
    texts = []
    for k in range(pairs):
        words = [f"t{k}x{i}" for i in range(own)]
        other = list(words)
        n = shared + own - 4
        for at in rng.sample(range(5, own - 5, 5), 9):  # each change costs about five shingles of either text
            copy = [*other[:at], f"c{k}x{at}", *other[at + 1 :]]
            common = len(set(zip(*[(passage + words)[i:] for i in range(5)])) & set(zip(*[(passage + copy)[i:] for i in range(5)])))  # noqa: B905
            if 100 * common < 75 * (2 * n - common):
                break
            other = copy
        texts += [" ".join(passage + words), " ".join(passage + other)]
    return texts


def test_recall_of_deep_branching(spark):
    texts = branched(random.Random(22), 1500)
    order = list(range(len(texts)))
    random.Random(23).shuffle(order)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, [texts[i] for i in order], order), small=12).collect()}
    found = sum(got[2 * k] == got[2 * k + 1] for k in range(1500))
    assert found >= 0.99 * 1500
    assert all(c in (i, i - i % 2) for i, c in got.items())


def test_near_duplicates_of_little(spark):
    assert neardup.near_duplicates(docs(spark, []).limit(0)).count() == 0
    got = neardup.near_duplicates(docs(spark, ["a b c d e f"] * 3 + [None], [7, 7, 9, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got) == [(-1, None, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    kept = neardup.one_of_each(docs(spark, ["a b c d e f"] * 2 + ["g"], [3, 2, 5]))
    assert kept.columns == DOCS.replace(",", "").split()[::2] and sorted(r["doc_id"] for r in kept.collect()) == [2, 5]


def test_one_of_each_of_repeated_ids(spark):
    other, base = " ".join(f"o{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = f"{base} end"
    rows = [(3, base), (5, near), (5, other), (7, "a b c d e f"), (7, "A  b c d e f"), (7, None), (7, ""), (8, "g"), (9, near), (None, "x"), (None, "x")]
    rows += [(20, f"q {other[::-1]}"), (20, f"q {other[::-1]} z")]
    kept = neardup.one_of_each(docs(spark, [t for _, t in rows], [i for i, _ in rows]))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], " ".join((r["text"] or "").lower().split())) for r in kept.collect())
    assert [g for g in got if g[0] != 20] == [(-1, "x"), (-1, "x"), (3, base), (5, other), (7, ""), (7, "a b c d e f"), (8, "g")]
    assert sum(g[0] == 20 for g in got) == 1 and kept.columns == docs(spark, []).columns


def test_components(spark):
    from pagemill.llm.common import WorkTables

    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    got = []
    for at_once in (10**6, 0):
        work = WorkTables(spark, "test")
        e = work.keep(spark.createDataFrame(edges, "a long, b long"))
        got.append(sorted((r["vid"], r["label"]) for r in neardup.components(work, e, at_once).collect()))
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert [x for x in got[0] if x[0] not in loops] == got[1]


def test_long_texts_and_words():
    w = [b"x%d" % (i % 997) for i in range(120_000)]
    whole = neardup.shingles(w)
    assert len(whole) == 997
    assert len(neardup.shingles([b"y" * 5_000_000, b"a"])) == 1


# -- sharding -------------------------------------------------------------------------------------


def test_long_words_alike_on_both_sides_of_4_mb(spark):
    words = [f"{i:05d}" + "x" * 395 for i in range(10_000)]
    a, b = neardup.shingles([w.encode() for w in words]), neardup.shingles([w.encode() for w in words[:-50]])
    assert len(a) == 9_996 and len(b) == 9_946 and np.isin(b, a).all()
    texts = [" ".join(words), " ".join(words[:-50])]
    assert len(texts[1]) < 4_000_000 < len(texts[0])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, texts)).collect())
    assert got == [(0, 9_996, 0), (1, 9_946, 0)]


def test_long_words_in_parts_count_once():
    short, long = [f"s{i}" for i in range(49_980)], [f"{i:02d}" + "y" * 300 for i in range(6)]
    filler = [f"{i:05d}" + "z" * 395 for i in range(20_000)]
    words = [w.encode() for w in [*long, *short, *filler, *long]]
    assert len(neardup.shingles(words)) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


@pytest.mark.parametrize("bucket_bytes", [10**9, 500])
def test_shards(spark, bucket_bytes):
    texts = [None, "", "same", "same"] + [f"text {i}" for i in range(93)]
    d = docs(spark, texts).repartition(3)
    from pagemill.llm.common import WorkTables

    d = WorkTables(spark, "test").keep(d)
    found, name = sharding.shuffle_shards(d, shards=8, bucket_bytes=bucket_bytes)
    rows = found.collect()
    assert found.columns == [*d.columns, name]
    assert sorted((r["doc_id"], r["text"] or "-") for r in rows) == sorted((i, t or "-") for i, t in enumerate(texts))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r[name]["shard"]].append(r[name]["slot"])
    sizes = [len(slots[s]) for s in range(8)]
    assert sum(sizes) == 97 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r[name]["slot"], r[name]["shard"]))]
    assert order != sorted(order)
    assert same_shards(spark, d, bucket_bytes, rows, name)
    assert [(r["doc_id"], *r[name]) for r in sorted(rows, key=lambda r: r["doc_id"])] == sorted(plain_shards(d, bucket_bytes, 8, 20))


def plain_shards(d, bucket_bytes, shards, seed):
    """The shuffle as a procedure: rows in the scan's order into buckets, each swapped from its end, and dealt."""
    size = sum(64 + 4 * 8 + len((r["text"] or "").encode()) + len("en") + len("x") - 8 for r in d.collect())
    n = max(1, -(-size // bucket_bytes))
    tie = F.monotonically_increasing_id()
    buckets = [[] for _ in range(n)]
    for r in sorted(d.select("doc_id", tie.alias("tie"), F.pmod(F.xxhash64(F.lit(seed), tie), F.lit(n)).alias("b")).collect(), key=lambda r: r["tie"]):
        buckets[r["b"]].append(r["doc_id"])
    dealt = []
    for k, own in enumerate(buckets):
        picks = np.random.default_rng((seed, k)).integers(0, np.arange(1, len(own) + 1)) if own else []
        for i in range(len(own) - 1, 0, -1):
            own[i], own[picks[i]] = own[picks[i]], own[i]
        dealt += own
    return [(x, i % shards, i // shards) for i, x in enumerate(dealt)]


def test_buckets_count_all_columns(spark):
    from pagemill.llm.common import row_bytes

    df = spark.createDataFrame([("é", [1.0, 2.0], b"xyz", 7, ["ab"]), (None, None, None, None, None)], "a string, b array<double>, c binary, `d.e` int, f array<string>")
    assert [r["n"] for r in df.select(row_bytes(df).alias("n")).collect()] == [64 + 2 + 16 + 3 + 8 + len('{"f":["ab"]}'), 64 + 8 + 2]


def test_helper_columns_clash_with_none(spark):
    """Columns of all the names that operators use themselves, in a second table of the same rows."""
    names = ["b", "g", "n", "earlier", "of_bucket", "tie", "place", "bucket", "sharded", "digest", "tokens", "key", "stored_n", "n_tokens", "words", "kept_id", "kept_digest", "stands", "label", "scan", "toxicity", "host", "path", "judged", "filter", "result"]
    d = spark.createDataFrame([(i, f"a b c d e {i % 3}", *range(len(names))) for i in range(9)], f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    from pagemill.llm.common import WorkTables

    d = WorkTables(spark, "test").keep(d)
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for found in (sharding.shuffle_shards(d, shards=2)[0], token_counts.count_tokens(d)[0], neardup.one_of_each(d), decontaminate.scan(d, items)[0], decontaminate.redacted(d, items), toxicity.score(d, toxicity.NOTHING)[0], language.identify(d, language.NO_LANGUAGES)[0], url_filter.judge(d, RULES, url_col="text")[0]):
        assert found.columns[: len(d.columns)] == d.columns
        rows = found.collect()
        assert rows and all(tuple(r)[2 : 2 + len(names)] == tuple(range(len(names))) for r in rows)
    for found in (neardup.near_duplicates(d), packing.pack(d), topk.top_k(d.select("*", F.array("n").alias("embedding")), id_col="doc_id")):
        assert found.count() > 0


def test_a_very_long_row_is_shuffled(spark):
    d = docs(spark, ["x" * 3_000_000, None, "y"])
    found, name = sharding.shuffle_shards(d, shards=2, bucket_bytes=1000)
    assert sorted((r["doc_id"], len(r["text"] or "")) for r in found.collect()) == [(0, 3_000_000), (1, 0), (2, 1)]
    many = spark.range(10_000).select(F.col("id").cast("int").alias("b"), (F.col("id") % 7).alias("n"))
    got = sharding._earlier(many, at_once=64).orderBy("b").collect()
    assert [r["earlier"] for r in got] == np.cumsum([0] + [i % 7 for i in range(9_999)]).tolist()


def same_shards(spark, d, bucket_bytes, rows, name):
    again, other = sharding.shuffle_shards(d, shards=8, bucket_bytes=bucket_bytes)
    return {(r["doc_id"], tuple(r[name])) for r in rows} == {(r["doc_id"], tuple(r[other])) for r in again.collect()}


def test_shards_of_nothing(spark, tmp_path):
    found, _ = sharding.shuffle_shards(docs(spark, []).limit(0))
    assert found.count() == 0
    sharding.write_shards(docs(spark, ["a", "b", "c"]), str(tmp_path / "s"), shards=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3


def test_fisher_yates():
    assert sorted(sharding.fisher_yates(50, 1, 2)) == list(range(50)) and len(sharding.fisher_yates(0, 1, 2)) == 0
    first = collections.Counter(int(sharding.fisher_yates(4, 1, k)[0]) for k in range(4000))
    assert all(850 < n < 1150 for n in first.values())


# -- top k ----------------------------------------------------------------------------------------


def plain_top(rows, k, every):
    long = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    ok = [(i, [int(np.floor(64.0 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        v = min(v for i, v in ok if i == q)
        scores = sorted((-long(sum(a * b for a, b in zip(v, c, strict=True))), i) for i, c in ok if i != q and len(c) == len(v))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("how", [{}, {"group_bytes": 9000, "query_rows": 2}, {"block": 7}, {"group_bytes": 500}])
def test_top_k(spark, how):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=40)]) for i in range(90)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (20, rows[20][1]), (202, None), (203, [float("nan")] * 40), (204, [None] * 40), (205, [1.0]), (220, [2.0]), (None, rows[1][1]), (240, [1e12] * 40), (260, []), (261, []), (262, [3e16, 1.0]), (280, [1e16, -5e15])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in topk.top_k(df, k=6, every=20, **how).collect())
    assert got == plain_top(rows, 6, 20)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df).count() == 0


def test_bounds_keep_ties():
    c = np.ones((500, 64), np.int64)
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    topk.search_block(np.ones((1, 64), np.int64), np.array([3]), topk.Block(np.arange(500), c), 5, best)
    assert best[0][1].tolist() == [0, 1, 2, 4, 5]


@pytest.mark.parametrize("bits", [20, 28, 40])
def test_bounds_are_safe_beyond_doubles(bits):
    """Scores on either side of 2 ** 53 that differ by little; dimensions that weigh much come first."""
    rng = np.random.default_rng(bits)
    c = rng.integers(-(1 << bits), 1 << bits, (600, 48)) >> np.arange(48) % 12
    c[300:] = c[:300] + rng.integers(-1, 2, (300, 48))
    q = c[::100].copy()
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
    for part in (slice(0, 250), slice(250, 600)):
        topk.search_block(q, np.arange(0, 600, 100), topk.Block(np.arange(600)[part], c[part]), 7, best)
    limit = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    for i in range(len(q)):
        want = sorted((-limit(sum(int(a) * int(b) for a, b in zip(q[i], c[j], strict=True))), j) for j in range(600) if j != 100 * i)[:7]
        assert list(zip((-best[i][0]).tolist() if bits < 30 else [-int(x) for x in best[i][0]], best[i][1].tolist(), strict=True)) == want


def test_top_k_of_a_third_with_one_id(spark):
    rng = np.random.default_rng(8)
    rows = [(20 if i % 3 == 0 else i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=9, group_bytes=4000)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 9, 20)

# -- URL rules ------------------------------------------------------------------------------------

RULES = [url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"), url_filter.Rule("block", "a.org", "/x*y*z"), url_filter.Rule("block", "q.net", "")]


def plain_verdict(host, path):
    fits = []
    for r in RULES:
        glob = re.escape(r.path).replace(r"\*", ".*")
        if f".{host}".endswith(f".{r.host}") and re.match(glob, path, re.S):
            fits.append((len(r.name), len(r.host), r.name, r.verdict))
    return max(fits)[2:] if fits else (None, "allow")


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/en/", "https://www.Example.com/en/77?x#y", "http://example.com/en/8", "http://xexample.com/en/7", "http://a.org/x1y2z3", "http://a.org/xzy", "http://b.a.org/xyyzz/more", "http://q.net", "ftp://z.q.net#f", "http://a/com/en/", "http://u.com?/en/", "http://é.com/en/" + "a" * 3000, "http://a.org/x\n1y\nz"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    found, name = url_filter.judge(df, RULES)
    for r in found.collect():
        u = r["url"] or ""
        rest = u.partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        f = r[name]
        assert (f["host"], f["path"]) == (host, path), u
        assert (f["rule"], f["verdict"]) == plain_verdict(host, path), u
    assert found.columns == [*df.columns, name]
    assert url_filter.judge(df.limit(0), RULES)[0].count() == 0 and url_filter.judge(df, [])[0].where(f"{name}.verdict = 'block'").count() == 0


def test_a_very_long_url(spark):
    url = "https://deep.example.com/en/" + "7/" * 40_000
    d = spark.createDataFrame([(1, url, "x"), (1, url, "x"), (2, "://" + "a." * 9000 + "com/en/", "y"), (3, "", None)], "page_id long, url string, host string")
    found, name = url_filter.judge(d, RULES)
    got = sorted((r["page_id"], len(r[name]["path"]), r[name]["rule"], r[name]["verdict"]) for r in found.collect())
    assert got == [(1, 80_004, "example.com/en/7", "allow")] * 2 + [(2, 4, "com/en/", "block"), (3, 0, None, "allow")] and found.columns == [*d.columns, name]
    assert url_filter.judge(d.limit(0), RULES)[0].count() == 0


def test_many_rules_over_word_borders():
    rng = random.Random(5)
    rules = [url_filter.Rule("block", "".join(rng.choices("ab", k=rng.randrange(1, 4))) + ".c", "/" + "".join(rng.choices("ab", k=rng.randrange(0, 5)))) for _ in range(60)]
    auto = url_filter.Automaton(rules)
    assert auto.n_words > 1
    hosts = ["".join(rng.choices("ab.", k=5)) + ".c" for _ in range(300)]
    paths = ["/" + "".join(rng.choices("ab", k=rng.randrange(0, 8))) for _ in range(300)]
    for h, p, k in zip(hosts, paths, auto.best([h.encode() for h in hosts], [p.encode() for p in paths]), strict=True):
        fits = [i for i, r in enumerate(auto.rules) if f".{h}".endswith(f".{r.host}") and p.startswith(r.path)]
        assert k == (fits[0] if fits else -1)


# -- language -------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(6)
    kinds = {"xx": "abc", "yy": "def", "zz": "ghé"}
    make = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=rng.randrange(2, 7))) for _ in range(n))
    rows = [(i, make(k := rng.choice(list(kinds)), rng.randrange(1, 60)), k) for i in range(300)] + [(900, None, "xx"), (901, "12 !", "yy"), (902, "abc", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit(1))
    model = language.fit(d, per_language=80)
    assert model.languages == ("xx", "yy", "zz")
    found, name = language.identify(d, model)
    got = {r["doc_id"]: r for r in found.collect()}
    assert sum(got[i][name]["lang"] == k for i, _, k in rows[:300]) >= 297
    for i in (900, 901):
        assert tuple(got[i][name]) == ("und", 0.0, True)
    assert all(0 <= r[name]["score"] <= 1 for r in got.values())
    assert name != "language" and found.columns[:4] == d.columns
    assert sum(got[i][name]["rejected"] for i, _, _ in rows[:300]) <= 3
    assert language.identify(d.limit(0), model)[0].count() == 0
    again = language.fit(d, per_language=80)
    assert np.array_equal(model.table, again.table)
    with pytest.raises(ValueError):
        language.fit(d.limit(0))


def plain_rows(text):
    """The table's rows of a text's subwords, one character after the other, in plain integers."""
    line, out = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ", []
    for n in (2, 3, 4):
        for i in range(len(line) - n + 1):
            h = 0
            for c in line[i : i + n]:
                h = (h * 0x01000193 + (0 if c == " " else ord(c))) & 0xFFFFFFFF
            h = (h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language.BITS)
            if h:
                out.append(h)
    return out


def test_scores_against_plain_scorer():
    rng = random.Random(17)
    table = np.random.default_rng(2).normal(size=(language.ROWS, 3)).astype(np.float32)
    table[0] = 0
    model = language.Model(("a", "b", "c"), table, np.array([0.1, -0.2, 0.0]), 1.7, 0.5)
    for text in [*ODD, *(sentence(rng, rng.randrange(1, 40)) for _ in range(20)), None]:
        rows = plain_rows(text or "")
        if not any(c.isalpha() for c in text or ""):
            assert model.predict(text) == ("und", 0.0, True)
            continue
        z = [(sum(float(table[h][k]) for h in rows) / max(len(rows), 1) + model.bias[k]) / 1.7 for k in range(3)]
        e = [np.exp(x - max(z)) for x in z]
        lang, score, rejected = model.predict(text)
        assert lang == "abc"[z.index(max(z))] and score == pytest.approx(max(e) / sum(e)) and rejected == (score < 0.5)


def test_training_against_plain_descent():
    """The same draws and steps, with the gradient written out for each embedding and weight."""
    rng, dim, k = np.random.default_rng(4), 3, 2
    bags = [(np.sort(rng.choice(np.arange(1, 50), 8, replace=False)).astype("<i4"), np.cumsum(rng.integers(1, 4, 8)).astype(float), int(i % 2)) for i in range(12)]
    model = language.train(bags, ("a", "b"), dim=dim, epochs=2, rate=0.5, false_rejects=0.001, seed=3)
    draw = np.random.default_rng(3)
    own = [b for i, b in enumerate(bags) if i % 10 != 9]
    e, w, bias = draw.uniform(-1 / dim, 1 / dim, (language.ROWS, dim)).astype(np.float32).astype(float), np.zeros((dim, k)), np.zeros(k)
    t = 0
    for _ in range(2):
        for i in draw.permutation(len(own)):
            at, upto, y = own[i]
            m = int(draw.choice((12, 24, 60, 150, 300)))
            drawn = [int(at[np.searchsorted(upto, x, side="right")]) for x in draw.random(m) * upto[-1]]
            v = [sum(e[h][j] for h in drawn) / m for j in range(dim)]
            z = [sum(v[j] * w[j][c] for j in range(dim)) + bias[c] for c in range(k)]
            p = [np.exp(x - max(z)) for x in z]
            g = [x / sum(p) - (c == y) for c, x in enumerate(p)]
            rate = 0.5 * (1 - t / (2 * len(own)))
            down = [sum(w[j][c] * g[c] for c in range(k)) for j in range(dim)]
            for j in range(dim):
                for c in range(k):
                    w[j][c] -= rate * v[j] * g[c]
            for c in range(k):
                bias[c] -= rate * 0.1 * g[c]
            for h in drawn:
                for j in range(dim):
                    e[h][j] -= rate * down[j] * 8 / m
            t += 1
    want = e @ w
    want[0] = 0
    assert np.allclose(model.table, want, atol=1e-4) and np.allclose(model.bias, bias, atol=1e-4) and np.abs(want).max() > 0.01


def test_every_label_is_learned(spark):
    rng = random.Random(70)
    text = lambda k: " ".join("".join(chr(0x4E00 + 8 * k + rng.randrange(8)) for _ in range(rng.randrange(2, 6))) for _ in range(20))
    rows = [(i, text(i % 70), f"l{i % 70:02d}") for i in range(70 * 12)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == tuple(f"l{k:02d}" for k in range(70))
    assert sum(model.predict(text(k))[0] == f"l{k:02d}" for k in range(70)) >= 66


def test_long_text_is_read_whole():
    m = language.Model(("a", "b"), np.random.default_rng(1).normal(size=(language.ROWS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    m.table[0] = 0
    text = "abcd " * 200_000 + "zzzz"
    total, n = np.zeros(2), 0
    for h in language.subwords(language.codes(text)):
        total += m.table[h[h != 0]].sum(axis=0, dtype=np.float64)
        n += int((h != 0).sum())
    assert np.allclose(m.logits(text), total / n)


# -- tokens ---------------------------------------------------------------------------------------

ODD = ["", " ", "a", "<|endoftext|>", "x <|endoftext|> y", "naïve café — “quoted”", "日本語 テスト", "مرحبا", "a​b́", "🙂🙃", "\t\n  x", "I'm you'll", "1234567 ½ Ⅷ", " \x85\xa0", "é" * 500, " " * 500 + "x"]


@pytest.fixture(scope="module")
def library():
    return tokens.Encoder("byte_bpe_50k.json", None)


def test_both_libraries_agree(library):
    e = tokens.encoder()
    for t in ODD:
        assert e.ids(t) == library.ids(t), t
    for c in range(0x10000):
        ch = chr(c)
        if not 0xD800 <= c < 0xE000 and tokens.SAFE.fullmatch(ch):
            t = f"a{ch}b {ch}{ch} 1{ch}\n{ch} x{ch}'s"
            assert e.fast.encode_ordinary(t) == library.ids(t), hex(c)


def test_token_counts(spark, library, tmp_path):
    texts = [*ODD, None, "a", "a", "A"]
    d = docs(spark, texts).withColumn("tokens", F.lit(0))
    cache = str(tmp_path / "cache")
    found, name = token_counts.count_tokens(d, cache)
    assert {r["doc_id"]: r[name]["n_tokens"] for r in found.collect()} == {i: len(library.ids(t or "")) for i, t in enumerate(texts)}
    assert found.columns == [*d.columns, name]
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts})
    more, name = token_counts.count_tokens(docs(spark, ["a", "new one"]), cache)
    assert sorted(r[name]["n_tokens"] for r in more.collect()) == [1, 2]
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts}) + 1 and stored.select("digest").distinct().count() == stored.count()
    assert token_counts.count_tokens(d.limit(0), str(tmp_path / "none"))[0].count() == 0


# -- packing --------------------------------------------------------------------------------------


def test_plan_is_best_fit():
    assert len({s.sequence_from + k for s in packing.plan({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10) for k in range(s.count)}) == 2
    assert packing.plan({}, 10) == [] and packing.plan({3: 0}, 10) == []


def plain_best_fit(histogram, capacity):
    room = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fits = [r for r in room if r >= n]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - n)
            else:
                room.append(capacity - n)
    return len(room)


def test_plan_is_as_good_as_best_fit_over_pieces():
    rng = random.Random(8)
    for _ in range(60):
        h = {rng.randrange(1, 31): rng.randrange(0, 9) for _ in range(10)}
        used = {s.sequence_from + k for s in packing.plan(h, 30) for k in range(s.count)}
        assert len(used) <= plain_best_fit(h, 30)


@pytest.mark.parametrize("small_rows", [10**6, 0])
def test_packing_is_a_round_trip(spark, library, small_rows):
    rng = random.Random(9)
    texts = [None, "", "dup", "dup", *ODD] + [sentence(rng, rng.choice([3, 20, 100, 400])) for _ in range(60)]
    rows = packing.pack(docs(spark, texts).repartition(3), capacity=64, small_rows=small_rows).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] <= 64 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], ids.tolist()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        own = sorted(pieces[i])
        assert [x for _, _, ids in own for x in ids] == [*library.ids(t or ""), 2]
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert [s for _, s, _ in own] == [sum(len(x[2]) for x in own[:k]) for k in range(len(own))]
        assert all(len(ids) == 64 for _, _, ids in own[1:])
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64
    assert len(sequences) <= plain_best_fit(collections.Counter(r["length"] for r in rows), 64)


def test_packing_nothing(spark):
    assert packing.pack(docs(spark, []).limit(0)).count() == 0


def test_packing_of_many_short_and_one_very_long(spark, library):
    """Many ranks of one length, in blocks; a text of some hundred thousand ids."""
    long = " ".join(f"word{i}" for i in range(60_000))
    texts = [None] * 1500 + ["ab cd"] * 300 + [long] + [f"t {'x ' * (i % 90)}" for i in range(400)]
    rows = packing.pack(docs(spark, texts).repartition(4), capacity=128).select("doc_id", "piece", "length", "sequence_id", "offset").collect()
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) and {r["doc_id"] for r in rows} == set(range(len(texts)))
    assert sum(r["length"] for r in rows if r["doc_id"] == 1800) == len(library.ids(long)) + 1
    used = collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(u)] == [sum(n for _, n in sorted(u)[:k]) for k in range(len(u))] and sum(n for _, n in u) <= 128 for u in used.values())
    assert len(used) <= plain_best_fit(collections.Counter(r["length"] for r in rows), 128)


# -- toxicity -------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = sentence(rng, 50).split() + [rng.choice(["aaa", "bbb", "ccc"])]
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["grumpf", "grumpel", "zorkx"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    for i in range(500, 512):  # an entry's word is harmless here
        rows.append((i, f"{sentence(rng, 20)} grumpf bush {sentence(rng, 20)}"))
        labels.append((i, 0))
    rows += [(900, None), (901, ""), (902, "you GRUMPEL, you z0rкx"), (903, "behind the grumpf bush"), (904, "grumpf, bush or no grumpf")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxicity", F.lit("x"))
    lab = spark.createDataFrame(labels + [(900, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    assert any("grump".startswith(e[:5]) for e, _ in model.entries)
    found, name = toxicity.score(d, model)
    s = {r["doc_id"]: r[name]["score"] for r in found.collect()}
    assert all((s[i] >= 0.7) == bool(t) for i, t in labels)
    assert s[900] == s[901] == min(s.values()) and min(s[902], s[904]) >= 0.7 > s[903]
    assert "grumpf bush" in model.exceptions and not any("bush" in e for e, _ in model.entries)
    assert found.columns == [*d.columns, name]
    assert toxicity.score(d.limit(0), model)[0].count() == 0
    alone = toxicity.fit(d, lab.limit(0))
    assert alone == toxicity.NOTHING
    assert len({r["x"]["score"] for r in toxicity.score(d, alone)[0].withColumnRenamed("toxicity_1", "x").collect()}) == 1
    assert toxicity.fit(d.limit(0), lab) == toxicity.NOTHING and toxicity.fit(d, lab) == model
    d2 = d.unionAll(d)  # repeated rows count once, and have one score
    assert toxicity.fit(d2, lab).entries == model.entries


def plain_weight(entries, exceptions, text):
    """Hits by looking at each word in turn."""
    words = toxicity.folded(text or "")
    spared = {k + j for e in exceptions for k in range(len(words)) if words[k : k + len(e.split())] == e.split() for j in range(len(e.split()))}
    fits = lambda w, e: w == e[:-1] if e.endswith(" ") else w.startswith(e)
    total = sum(max((x for e, x in entries if fits(w, e)), default=0.0) for k, w in enumerate(words) if k not in spared)
    return total, 100 * total / (len(words) + 20) if words else 0.0, len(words)


def test_weights_against_plain_search():
    rng = random.Random(16)
    words = ["ab", "abc", "abcd", "b", "bc", "CAB", "4bc", "d"]
    for _ in range(300):
        entries = tuple({(rng.choice(["ab", "abc ", "abcd", "b ", "bc", "cab", "d "]), float(rng.randrange(1, 9))) for _ in range(3)})
        entries = tuple(dict(entries).items())
        exceptions = tuple({" ".join(rng.choice(["ab", "abc", "b", "bc"]) for _ in range(rng.choice([2, 2, 3]))) for _ in range(rng.randrange(3))})
        text = rng.choice([" ", ", "]).join(rng.choice(words) for _ in range(rng.randrange(30)))
        model = toxicity.Model(entries, exceptions, (0.0, 1.0, 1.0))
        assert toxicity.weigh(model.automaton(), text) == pytest.approx(plain_weight(entries, exceptions, text)), (entries, exceptions, text)
        got = toxicity.phrases_of(model.automaton(), own := toxicity.folded(text))
        hit = {k for k, w in enumerate(own) if any(w == e[:-1] if e.endswith(" ") else w.startswith(e) for e, _ in entries)}
        assert got == {f"{own[i]} {own[i + 1]}" for i in range(len(own) - 1) if {i, i + 1} & hit}


def test_a_very_long_text_is_weighed_whole():
    model = toxicity.Model((("bad", 2.0),), ("bad luck",), (0.0, 1.0, 1.0))
    text = "bad luck or not " * 200_000 + "bad end"
    assert toxicity.weigh(model.automaton(), text)[0] == 2.0 and toxicity.weigh(model.automaton(), text)[2] == 800_002


def test_folding():
    assert toxicity.folded("ІDІ0T's $cum ｓｔｕｐｉｄ l​oser") == ["idiot", "s", "scum", "stupid", "loser"]
    model = toxicity.Model((("trash", 3.0), ("idiot", 3.0)), ("trash can",), (0.0, 1.0, 1.0))
    a = model.automaton()
    assert [toxicity.weigh(a, t)[0] for t in ("trash can", "trash talk", "trashcan idiots", "mytrash", None)] == [0.0, 3.0, 6.0, 0.0, 0.0]


# -- decontamination ------------------------------------------------------------------------------


def plain_hits(text, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        if item is None or t is None:
            continue
        own = words(t)
        n = min(width, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(w), hit, sorted(found)


@pytest.mark.parametrize("block_windows", [10**6, 9])
def test_decontamination(spark, block_windows):
    rng = random.Random(12)
    items = [(i, sentence(rng, n)) for i, n in enumerate((30, 12, 10, 3, 15, 9))] + [(6, None), (None, "w1 w2"), (7, ""), (8, "É-é w1"), (1, "w0 w0 w0")]
    texts = [None, "", "...", "w1"] + [sentence(rng, 120) for _ in range(10)]
    for _, t in items[:6]:
        w = t.split()
        texts += [f"x {t.upper()} y", f"{' '.join(w[2:])}, {sentence(rng, 5)}; {' '.join(w[:-1])}", "-".join(w)]
    texts += ["a é-É. w1", "prefixw0 w0 w0 w0x"]
    d = docs(spark, texts)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found, name = decontaminate.scan(d, b, block_windows=block_windows)
    for r in found.collect():
        n, hit, ids = plain_hits(r["text"], items)
        own = r[name]
        assert own["n_words"] == n and own["items"] == ids, r["text"]
        assert {k for s in own["spans"] for k in range(s["word_from"], s["word_to"])} == hit
        for s in own["spans"]:
            part = r["text"][s["char_from"] : s["char_to"]]
            assert len(plain_hits(part, [])) and plain_hits(part, [])[0] == s["word_to"] - s["word_from"]
    clean = decontaminate.clean_only(d, b, block_windows=block_windows)
    assert clean.columns == d.columns and {r["doc_id"] for r in clean.collect()} == {i for i, t in enumerate(texts) if not plain_hits(t, items)[1]}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.redacted(d, b, mask="#").collect()}
    assert cut[0] is None and all((cut[i] == t) == (not plain_hits(t, items)[1]) for i, t in enumerate(texts))
    assert decontaminate.scan(d.limit(0), b)[0].count() == 0
    none, name = decontaminate.scan(d, b.limit(0))
    assert none.where(f"size({name}.spans) > 0").count() == 0


def test_decontamination_by_very_long_items_and_texts(spark):
    rng = random.Random(13)
    vocabulary = [f"v{i}" for i in range(5000)]
    long = [rng.choice(vocabulary) for _ in range(25_000)]  # three parts of an item
    other = " ".join(rng.choice(vocabulary) for _ in range(60_000))
    at = (5, 9_994, 9_999, 19_995, 24_980)
    texts = [f"zz {' '.join(long[i : i + 12])} yy" for i in at] + [f"{other} {' '.join(long[100:140])} {other}", " ".join(long[:9]), other]
    b = spark.createDataFrame([(1, " ".join(long)), (2, "Only three words")], "item_id long, text string")
    for most in (10**6, 7_000):
        found, name = decontaminate.scan(docs(spark, texts), b, block_windows=most)
        got = {r["doc_id"]: [(s["word_from"], s["word_to"]) for s in r[name]["spans"]] for r in found.collect()}
        assert got == {**{k: [(1, 13)] for k in range(len(at))}, len(at): [(60_000, 60_040)], len(at) + 1: [], len(at) + 2: []}


def test_more_words_than_letters():
    rng = random.Random(14)
    parts = [(str(k), " ".join(f"u{rng.randrange(400)}" for _ in range(12)).encode()) for k in range(40)]
    whole, cut = decontaminate.Scanner(parts, 10), decontaminate.Scanner(parts, 10, most_letters=60)
    assert cut.rest is not None and whole.rest is None
    for _, t in parts:
        words = b"x".join([b"z ", t, b" z " + parts[3][1]]).split()
        assert whole.hits(words) == cut.hits(words)


def test_a_block_of_items_fits_into_a_worker():
    """The memory that an automaton of a default block takes, in a process of its own."""
    code = """
import inspect, random, resource
from pagemill.llm import decontaminate
most = inspect.signature(decontaminate.scan).parameters["block_windows"].default
rng = random.Random(1)
voc = [b"word%x" % i for i in range(60_000)]
parts = [(str(k), b" ".join(rng.choices(voc, k=509))) for k in range(most // 500)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(decontaminate.Scanner(parts, 10).found) >= most * 0.99
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(out.stdout) < 300  # MB


def test_digest_of_no_items_is_that_of_nothing(spark):
    assert spark.range(1).select(F.sha2(F.concat_ws(",", F.array().cast("array<string>")).cast("binary"), 256).alias("h")).first()["h"] == hashlib.sha256(b"").hexdigest()


# -- chat -----------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, root string, thread int"


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CHAT)
    return {(r["conv_id"], r["turn"]): r for r in chat.link_quotes(df).collect()}


def test_quotes(spark):
    got = linked(
        spark,
        [(1, 0, "u", "Hello there\nhow are you"), (1, 1, "a", "> hello  there\nFine"), (1, 2, "u", "> > Hello there\n> fine\nok good"), (1, 3, "a", "> how are you\nstill fine"), (1, 4, "u", None), (1, 1500, "u", "> ok good\n> still fine\nend"), (2, 0, "u", "> hello there\nhi"), (2, 5, "x", "> hi\n\n>> deep\n>  hi"), (None, 1, "u", "> x"), (3, None, "u", "y")],
    )
    reply = {k: v["reply_to"] for k, v in got.items()}
    assert reply[1, 1] == 0 and reply[1, 2] == 1 and reply[1, 3] == 0 and reply[1, 4] == 3 and reply[1, 1500] == 2
    assert reply[2, 0] is None and reply[2, 5] == 0
    assert [got[1, t]["depth"] for t in (0, 1, 2, 3, 4, 1500)] == [0, 1, 2, 1, 2, 3]
    assert [got[1, t]["thread"] for t in (0, 1, 2, 3, 4, 1500)] == [0, 0, 0, 3, 3, 1500]
    assert got[1, 2]["body"] == "ok good" and got[1, 2]["n_passages"] == 2 and got[1, 2]["n_linked"] == 2 and got[1, 2]["max_level"] == 2
    assert got[2, 0]["n_linked"] == 0  # another conversation's message is no source
    assert got[None, 1]["body"] == "" and got[3, None]["body"] == "y"


def test_part_of_a_message_is_quoted(spark):
    rows = [(1, 0, "u", "Hi\nprice is 5\nbye"), (1, 1, "a", "Hi\nother"), (1, 2, "u", "> Hi\n> price is 5"), (1, 3, "u", "> Hi\n> other"), (1, 4, "u", "> Hi\n> nowhere"), (1, 5, "u", "> price is 5\n>\n> Bye"), (1, 6, "u", "> Hi\n> bye")]
    rows += [(2, 0, "u", "a\nb\na\nb\nc"), (2, 1, "u", "a\nb\nd"), (2, 2, "u", "b\nc"), (2, 3, "u", "> a\n> b\n> c"), (2, 4, "u", "> a\n> b"), (2, 5, "u", "> b\n> c\n> a")]
    got = {k: v["reply_to"] for k, v in linked(spark, rows).items()}
    assert [got[1, t] for t in range(2, 7)] == [0, 1, 1, 0, 1]
    assert [got[2, t] for t in range(3, 6)] == [0, 1, 2]


def test_links_and_reply_order(spark):
    rows = [(1, 0, "u", "Intro\nHi,\nthe answer is 42\nbye"), (1, 1, "a", "Hi,\nsomething else"), (1, 2, "u", "> Hi,\n> the answer is 42\nthanks"), (1, 3, "a", "> answer is 42\n> nowhere to be found\nno"), (1, 4, "u", ">> Hi, the answer\n>> is 42 bye\n> is 42\nyes")]
    rows += [(1, 5, "u", "> the ANSWER is\nwhat"), (1, 6, "a", "> something\n> else and more"), (1, 7, "a", "> Hi,\n> gone")]
    got = linked(spark, rows)
    links = {t: [tuple(x) for x in got[1, t]["links"]] for t in range(8)}
    assert links == {0: [], 1: [], 2: [(1, 0, True)], 3: [], 4: [(2, 0, True)], 5: [(1, 0, True)], 6: [], 7: [(1, 1, False)]}
    assert [got[1, t]["reply_to"] for t in range(8)] == [None, 0, 0, 2, 3, 0, 5, 1]
    assert [got[1, t]["reply_order"] for t in range(8)] == [0, 1, 3, 4, 5, 6, 7, 2]


def test_very_long_messages(spark):
    rng = random.Random(15)
    long = "\n".join(sentence(rng, 9) for _ in range(6000))
    part = "\n".join(f"> {x}" for x in long.split("\n")[2000:5000])
    wrapped = "> " + " ".join(long.replace("\n", " ").split(" ")[777:30_000])
    got = linked(spark, [(1, 0, "u", long), (1, 1, "a", "short"), (1, 2, "u", part + "\nagreed"), (1, 3, "a", wrapped + "\nso it is"), (1, 4, "u", "> " * 40 + "deep")])
    assert [got[1, t]["reply_to"] for t in range(5)] == [None, 0, 0, 0, 3] and got[1, 4]["max_level"] == 40
    assert [got[1, t]["body"] for t in (2, 3)] == ["agreed", "so it is"]


def test_parts_against_plain_search(spark):
    rng = random.Random(31)
    rows, want = [], {}
    for c in range(15):
        said = []
        for t in range(30):
            own = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            quote = []
            if said and rng.random() < 0.7:
                k = rng.choice(said)
                i = rng.randrange(len(k))
                quote = k[i : i + rng.randrange(1, 7)]
            holds = [s for s, k in enumerate(said) if any(k[i : i + len(quote)] == quote for i in range(len(k)))] if quote else [t - 1]
            want[c, t] = max(holds) if t else None
            rows.append((c, t, "u", "\n".join([*(f"> {x}" for x in quote), *own])))
            said.append(own)
    assert {k: v["reply_to"] for k, v in linked(spark, rows).items()} == want


def test_threads_against_plain_following(spark):
    rng = random.Random(13)
    rows, parent = [], {}
    for t in range(0, 3000, 7):
        own = f"message number {t} {sentence(rng, 4)}"
        earlier = rng.choice(rows) if rows and rng.random() < 0.3 else None
        quote = "> " + earlier[3].splitlines()[-1] + "\n" if earlier else ""
        parent[t] = earlier[1] if earlier else (rows[-1][1] if rows else None)
        rows.append((1, t, "u", quote + own))
    depth = {}
    for t in parent:
        depth[t] = 0 if parent[t] is None else depth[parent[t]] + 1
    got = linked(spark, rows + [(2, 0, "u", "alone"), (2, 0, "u", "alone")])
    assert all(got[1, t]["reply_to"] == p and got[1, t]["depth"] == depth[t] and got[1, t]["root"] == 0 for t, p in parent.items())
    answers = {}
    for t, p in parent.items():
        answers.setdefault(p, []).append(t)
    order, stack = [], answers[None][::-1]
    while stack:
        order.append(stack.pop())
        stack += answers.get(order[-1], [])[::-1]
    assert [got[1, t]["reply_order"] for t in order] == list(range(len(order)))
    assert order != sorted(order) and got[2, 0]["reply_order"] == 0


def test_no_messages(spark):
    assert chat.link_quotes(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "u", "a", "x", 1), (1, 1, "u", "> a\nb", "x", 1)], CHAT)
    plan = chat.link_quotes(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_quotes_against_sql(spark, tmp_path):
    import duckdb

    from pagemill.llm import queries, sql
    from tests.compare import rows_of, rows_of_sql

    rng = random.Random(14)
    rows = []
    for c in range(40):
        said = []
        for t in range(0, rng.randrange(2, 25), rng.choice([1, 1, 3])):
            text = []
            for _ in range(rng.randrange(0, 3)):
                if said and rng.random() < 0.6:
                    source = rng.choice(said).split("\n")
                    part = rng.randrange(5)
                    if part == 1:  # some of its lines
                        source = source[rng.randrange(len(source)) :]
                    elif part == 2:  # words from its middle, wrapped anew
                        words = " ".join(source).split()[rng.randrange(3) :]
                        source = [" ".join(words[i : i + 4]) for i in range(0, len(words), 4)]
                    elif part == 3:
                        source = [*source, "and what nobody said"]
                    text += ["> " * rng.randrange(1, 3) + x for x in source]
                elif rng.random() < 0.2:
                    text += [">", ">> nothing of the kind"]
            own = "\n".join(sentence(rng, rng.randrange(1, 5)) for _ in range(rng.randrange(0, 3)))
            said.append(own)
            rows.append((c, t, "u", "\n".join([*text, own]) if rng.random() < 0.95 else None))
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    names, got = rows_of(queries.op10(spark, str(tmp_path)))
    at = names.index("links")
    assert sum("whole" in r[at] for r in got) > 20 and sum("first" in r[at] for r in got) > 2
    want_names, want = rows_of_sql(con, sql.QUOTATION_LINKING)
    assert names == want_names and got == want
