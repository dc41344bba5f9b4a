"""The subpackage's queries against SQL, and the pipeline against plain versions of its stages."""

import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pagemill.llm import queries, tokens
from tests.compare import connection, rows_of, rows_of_sql
from tests.llm.test_operators import plain_components, plain_hits

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    names, rows = rows_of(queries.QUERIES[name](spark, SF))
    want_names, want = rows_of_sql(connection(SF), queries.ORACLES[name])
    assert names == want_names and rows == want


@tables
def test_shards(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_external_shuffle"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    by = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in by) and max(map(len, by)) - min(map(len, by)) <= 1


@tables
def test_language_is_right_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.QUERIES["op5_language"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


@tables
def test_toxicity_is_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op7_toxicity"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    clean, bad = [r for r in held if not toxic[r["doc_id"]]], [r for r in held if toxic[r["doc_id"]]]
    assert sum(r["predicted"] for r in clean) <= 0.005 * len(clean)
    assert sum(r["predicted"] for r in bad) >= 0.88 * len(bad)  # some labels stand on texts without any such word


@tables
def test_token_counts_and_pieces(spark):
    library = tokens.Encoder("byte_bpe_50k.json", None)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {d: library.ids(t) for d, t in texts.items()}
    for r in queries.QUERIES["op6_token_counts"](spark, SF).collect():
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), len(ids[r["doc_id"]]), len(ids[r["doc_id"]]) > 512)
    rows = queries.QUERIES["op8_best_fit_packing"](spark, SF).collect()
    used, total = {}, 0
    for r in rows:
        own = [*ids[r["doc_id"]], 2][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(len(x) + 1 for x in ids.values())
    assert all(max(o + n for o, n in s) <= 1024 for s in used.values()) and len(used) <= 1.02 * -(-total // 1024) + 1


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(20)
    kinds = {"xx": "abcd", "yy": "efgh"}
    make = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=rng.randrange(2, 7))) for _ in range(n))
    rows, labels = [], []
    items = [(i, make("xx", 14)) for i in range(3)]
    for i in range(240):
        k = rng.choice(list(kinds))
        text, bad = make(k, rng.randrange(10, 80)), i % 6 == 0
        if bad:
            text = f"{text[:30]} zzgrumpf {text[30:]}"
        if i % 11 == 1:
            text = f"{text} {items[i % 3][1]}"
        labels.append((i, int(i % 2), int(bad)))
        rows.append((i, text, k, "s", len(text)))
    rows += [(300 + i, rows[10 + i][1] + (" abab" if i % 2 else ""), rows[10 + i][2], "s", 1) for i in range(8)]
    rows += [(400, None, None, "s", 0), (401, "123 456", "xx", "s", 7), (402, "", None, None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = str(tmp_path)
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{sf}/documents.parquet"), {r[0]: r[1] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if name == "packing":
            library = tokens.Encoder("byte_bpe_50k.json", None)
            got = {}
            for r in out.orderBy("doc_id", "piece").collect():
                got.setdefault(r["doc_id"], []).extend(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
            assert got == {d: [*library.ids(t), 2] for d, t in left.items()}
            break
        assert out.schema == docs.schema
        out.write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language":
            want = {d: t for d, t in left.items() if d not in (400, 401, 402)}
        elif name == "toxicity":
            want = {d: t for d, t in left.items() if "zzgrumpf" not in t}
        elif name == "near_duplicates":
            want = {d: left[d] for d, _, c in plain_components(sorted(left.items())) if d == c}
            assert len(want) < len(left)
        else:
            want = {d: t for d, t in left.items() if not plain_hits(t, items)[1]}
            assert len(want) < len(left)
        assert kept == want, name
        left = kept


@pytest.mark.parametrize("rows", [[], [(1, "some words", None, "s", 10), (2, None, "xx", "s", 0), (3, "12", "xx", "s", 2)]])
def test_no_language_to_learn(spark, tmp_path, rows):
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = queries.QUERIES["op5_language"](spark, sf).collect()
    assert sorted((r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in got) == [(r[0], "und", 0.0, True) for r in rows]
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Columns with the operators' own names, nulls, repeated rows and ids, and a very long text, through all stages."""
    rng = random.Random(30)
    make = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(n))
    long = make(200_000)
    texts = [(i, make(40)) for i in range(60)] + [(60, long), (61, long + " more"), (5, make(30)), (None, make(25)), (None, None), (7, None), (62, "")]
    texts += [texts[3], texts[3]]
    rows = [(i, t, "xx", "s", 1, "d", 2.5, "l", "scan", 3) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, language string, scan string, _id int"
    sf = str(tmp_path)
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, long[100:400])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema, name
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(r["text"] or "")) for r in docs.collect())
    worded = sorted((-1 if i is None else i, len(t)) for i, t in texts if t)
    assert kept["language"] == kept["toxicity"] == worded
    assert kept["near_duplicates"] == sorted({x for x in worded if x[0] != 61})
    assert kept["decontamination"] == [x for x in kept["near_duplicates"] if x[0] != 60]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == {None if i == -1 else i for i, _ in kept["decontamination"]}
