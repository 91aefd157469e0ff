"""Stores of clean bodies, stateful stream dedupe, port ranges, sketches and sparse vectors."""

from __future__ import annotations

import datetime
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webstrata.functions import values
from webstrata.operators import bodies, documents, listing, search, term_index
from webstrata.sources import captures
from webstrata.sources.shared import spread
from webstrata.streaming import ingest

ROW = "content_sha256 string, doc_type string, content_type string, content string, normalized boolean, response_headers array<struct<name:string,value:string>>"


def _bodies(spark, texts):
    rows = spark.createDataFrame([("", "content", "application/json", t, False, []) for t in texts], ROW)
    return rows.withColumn("content_sha256", F.sha2("content", 256))


def test_a_stored_body_is_not_normalized_again(spark, tmp_path):
    root = str(tmp_path / "bodies")
    first = documents.normalize_documents(_bodies(spark, ["{b: 1}", "{c: 2}", "{b: 1}", "none"]), root)
    assert sorted(r.content for r in first.collect()) == ["none", '{"b":1}', '{"b":1}', '{"c":2}']
    stored = spark.read.parquet(root)
    assert stored.count() == 3
    # what the store holds is taken as it stands, so a second batch doesn't parse these bodies
    marked = stored.select("content_sha256", "kind", F.concat(F.lit("stored "), "clean").alias("clean"))
    other = str(tmp_path / "marked")
    bodies.store_bodies(marked, other)
    second = documents.normalize_documents(_bodies(spark, ["{b: 1}", "{d: 3}"]), other)
    assert sorted(r.content for r in second.collect()) == ['stored {"b":1}', '{"d":3}']
    assert spark.read.parquet(other).count() == 4
    again = documents.normalize_documents(_bodies(spark, ["{b: 1}", "{d: 3}"]), other)
    assert again.count() == 2 and spark.read.parquet(other).count() == 4
    bodies.store_bodies(marked, other)  # stored twice, by two batches at once: still one body
    assert documents.normalize_documents(_bodies(spark, ["{b: 1}"]), other).count() == 1


def test_the_hash_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_sha256"))
    found = keys.withColumn("filter_bucket", F.bitmap_bucket_number(bodies._place("content_sha256"))).join(bodies.hash_filter(keys), "filter_bucket")
    assert found.filter(values.bit_at("filter_bits", F.bitmap_bit_position(bodies._place("content_sha256")))).count() == 3000
    others = spark.range(3000, 23000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_sha256"))
    near = others.withColumn("filter_bucket", F.bitmap_bucket_number(bodies._place("content_sha256"))).join(bodies.hash_filter(keys), "filter_bucket")
    assert near.filter(values.bit_at("filter_bits", F.bitmap_bit_position(bodies._place("content_sha256")))).count() < 40


def test_stream_dedupe_by_hash_or_time_equals_the_batch(spark, tmp_path):
    rng, day = random.Random(2), datetime.datetime(2025, 1, 1)
    batches = [[(1, f"u{rng.randrange(3)}", rng.choice(["a", "b", "c", "", None]), rng.choice([None, *(day + datetime.timedelta(hours=h) for h in range(6))])) for _ in range(8)] for _ in range(4)]
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for batch in batches:
            spark.createDataFrame(batch, ingest.TYPED).write.mode("append").parquet(str(tmp_path / "in"))
            found = ingest.new_typed_stream(spark.readStream.schema(ingest.TYPED).parquet(str(tmp_path / "in")))
            found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    kept: list = []
    for batch in batches:
        kept += [r for r in batch if not any(k[1] == r[1] and ((r[2] and k[2] == r[2]) or (r[3] is not None and k[3] == r[3])) for k in kept)] if kept else batch
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, kept))


class _Counted:
    """State of one key, as a list or a map, that counts its calls."""

    def __init__(self):
        self.calls, self.items = 0, {}

    def getListState(self, *_):  # noqa: N802
        return self

    getMapState = getListState  # noqa: N815

    def get(self):
        self.calls += 1
        return iter([*self.items.values()])

    def appendList(self, values):  # noqa: N802
        self.calls += 1
        self.items |= {len(self.items) + k: v for k, v in enumerate(values)}

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self.items

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.items[key] = value


def test_stream_dedupe_calls_its_state_once_a_batch_and_not_once_a_row():
    state, processor = _Counted(), ingest._NewTyped(None)
    processor.init(state)
    frame = lambda numbers: pd.DataFrame({"version": 1, "url": "u", "content_sha256": [f"h{n}" for n in numbers], "ts": [n * 3_600_000_000 for n in numbers]})
    assert sum(len(f) for f in processor.handleInputRows(("u",), iter([frame(range(5000)), frame(range(4000, 9000))]), None)) == 10_000
    assert sum(len(f) for f in processor.handleInputRows(("u",), iter([frame(range(8000, 10_000))]), None)) == 1000
    assert state.calls == 4


def test_stream_dedupe_keeps_times_to_the_microsecond_in_any_zone(spark, tmp_path):
    """In the hour that a zone's clocks go through twice, two instants with one reading are still two."""
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.session.timeZone")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "America/New_York"), strict=True):
        spark.conf.set(n, v)
    instants = [1_762_061_400_000_001, 1_762_061_400_000_001 + 3_600_000_000]  # 01:30 of 2 November 2025, twice
    try:
        for k, t in enumerate(instants):
            spark.range(1).select(F.lit(1).alias("version"), F.lit("u").alias("url"), F.lit(f"h{k}").alias("content_sha256"), F.timestamp_micros(F.lit(t)).alias("ts")).write.mode("append").parquet(str(tmp_path / "in"))
            found = ingest.new_typed_stream(spark.readStream.schema(ingest.TYPED).parquet(str(tmp_path / "in")))
            found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select(F.unix_micros("ts")).collect()) == instants
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def test_port_ranges_hold_what_the_ports_do(spark):
    rng = random.Random(3)
    spec = lambda: ",".join(rng.choice([str(rng.randrange(12)), f"{rng.randrange(12)}-{rng.randrange(14)}", " ", "x", "3 - 5"]) for _ in range(rng.randint(0, 4)))
    rows = spark.createDataFrame([(spec(), spec()) for _ in range(300)] + [("1-65535", "80,443"), (None, "1")], "a string, b string")
    a, b = values.port_ranges(F.col("a")), values.port_ranges(F.col("b"))
    got = rows.select(
        values.listed_ports(values.common_ranges(a, b)).alias("common"), values.covers_ranges(a, b).alias("covers"),
        values.common_ports(values.expand_ports(F.col("a")), values.expand_ports(F.col("b"))).alias("want"), values.covers_ports(values.expand_ports(F.col("a")), values.expand_ports(F.col("b"))).alias("want_covers"),
    )
    for r in got.collect():
        assert r.common == r.want and r.covers == r.want_covers
    assert [tuple(x) for x in rows.select(values.port_ranges(F.lit("9,1-3,4,2-5,9 - 10")).alias("r")).first().r] == [(1, 5), (9, 10)]


def test_parsers_evaluate_their_steps_once(spark):
    items = spark.createDataFrame([("GET / HTTP/1.1\nHost: a\n\nHTTP/1.1 200 OK\n\nx",)], "value string")
    good, _ = captures.parse_http_raw(items, F.current_timestamp())
    assert good._jdf.queryExecution().optimizedPlan().toString().count("split(") < 40


def test_small_tables_are_dealt_out_and_large_ones_left(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 3)
    assert spread(many) is many


def test_day_sketches_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("user"), F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 7).cast("int")).cast("timestamp").alias("ts"), (F.col("id") % 2).alias("k"))
    sketches = listing.day_sketches(rows, ["k"], "user", "ts")
    for r in listing.distinct_in_days(sketches, ["k"], F.lit("2025-01-01").cast("date"), F.lit("2025-01-07").cast("date")).collect():
        assert abs(r.n - 10_000) < 200
    assert listing.distinct_in_days(sketches, ["k"], F.lit("2026-01-01").cast("date"), F.lit("2026-01-02").cast("date")).count() == 0


def test_sparse_vectors_of_a_user(spark):
    def make():
        def weigh(text):
            if text == "bad":
                raise ValueError("bad")
            return {w: float(len(w)) for w in text.split()} | {"zero": 0.0}

        return weigh

    docs = search.term_weights(spark.createDataFrame([(1, "aa b"), (2, "aa aa cc"), (3, None), (4, "bad"), (5, "")], "id long, t string"), "id", "t", make)
    assert sorted(map(tuple, docs.collect())) == [(1, "aa", 2.0), (1, "b", 1.0), (2, "aa", 2.0), (2, "cc", 2.0)]
    asked = search.term_weights(spark.createDataFrame([(9, "aa cc")], "q long, t string"), "q", "t", make)
    for part in (50_000, 1):
        assert [tuple(r) for r in search.sparse_dot_topk(asked, docs, 5, "q", "id", part=part).orderBy("rank").select("q", "id", "score", "rank").collect()] == [(9, 2, 8.0, 1), (9, 1, 4.0, 2)]


def test_a_stored_term_index_gives_what_a_scan_gives_and_skips_blocks(spark, tmp_path):
    rng = random.Random(8)
    common, rare = [f"c{k}" for k in range(20)], [f"r{k}" for k in range(200)]
    texts = [" ".join(rng.choices(common, k=rng.randint(1, 30)) + rng.choices(rare, k=rng.randint(0, 2))) for _ in range(600)]
    docs = spark.createDataFrame([*enumerate([*texts, texts[0], texts[0], "", None])], "doc long, text string").withColumns({"term": F.lit("x"), "block": F.lit(1)})
    asked = spark.createDataFrame([(1, "c1 r5"), (2, "r7 r7 R9"), (3, "c1 c2 c3"), (4, "nowhere"), (5, None), (6, texts[0])], "q long, text string")
    index = term_index.build_term_index(docs, str(tmp_path / "index"), "doc", block_docs=16, buckets=3)
    for k in (1, 4, 50):
        got, want = (sorted(map(tuple, f.select("q", "doc", "score", "rank").collect())) for f in (term_index.indexed_topk(asked, index, k, "q"), search.sparse_topk(asked, docs, k, "q", "doc")))
        assert got == want and {r[0] for r in got} == {1, 2, 3, 6}
    floor = {r.q: r.score for r in search.sparse_topk(asked, docs, 4, "q", "doc").filter("rank = 4").collect()}
    bounds = term_index.block_bounds(asked, index, "q")[0].collect()
    skipped = [r for r in bounds if r.q in floor and r.bound < floor[r.q]]
    assert len(skipped) > len(bounds) / 3
    empty = term_index.build_term_index(docs.limit(0), str(tmp_path / "empty"), "doc")
    assert empty.n_docs == 0 and term_index.indexed_topk(asked, empty, 3, "q").count() == 0


def test_term_search_hands_on_only_the_best_of_each_task(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    texts = ["all " + " ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(300)]
    docs = spark.createDataFrame([(f"d{k % 290:03}{k // 290}", t) for k, t in enumerate([*texts, *texts[:20], "", None])], "doc string, text string").repartition(5)
    asked = spark.createDataFrame([*enumerate([*texts[:40], "all", "nowhere", "", None])], "q long, text string")
    term_lists = {r.doc: r.text.lower().split() for r in docs.collect() if r.text}
    n, average = len(term_lists), sum(map(len, term_lists.values())) / len(term_lists)
    df = Counter(w for t in term_lists.values() for w in set(t))
    want = []
    for q, text in ((r.q, r.text) for r in asked.collect() if r.text):
        scores = []
        for doc, held in term_lists.items():
            tf = Counter(held)
            both = set(text.split()) & set(held)
            if both:
                scores.append((-round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(held) / average)) for w in both), 6), doc))
        want += [(q, doc, -s, rank) for rank, (s, doc) in enumerate(sorted(scores)[:7], 1)]
    for rounds in (1 << 19, 100):
        top = search.sparse_topk(asked, docs, 7, "q", "doc", round_rows=rounds)
        assert sorted(map(tuple, top.select("q", "doc", "score", "rank").collect())) == sorted(want)
        assert "Join" not in top._jdf.queryExecution().optimizedPlan().toString()  # no pairs of queries and documents by term


def test_queries_of_the_same_indexed_terms_are_one_search(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"red apple {'pie ' * (k % 3)}n{k % 5}") for k in range(40)], "doc long, text string")
    index = term_index.build_term_index(docs, str(tmp_path / "index"), "doc", block_docs=8, buckets=2)
    asked = spark.createDataFrame([(k, f"apple {'pie' if k % 2 else ''} nowhere{k}") for k in range(30)] + [(90, "nothing")], "q long, text string")
    searches, members = term_index._same_terms(asked, index, "q", "text", 100)
    assert sorted(map(tuple, searches.collect())) == [(0, "apple"), (1, "apple pie")] and members.count() == 30
    got, want = (sorted(map(tuple, f.select("q", "doc", "score", "rank").collect())) for f in (term_index.indexed_topk(asked, index, 3, "q"), search.sparse_topk(asked, docs, 3, "q", "doc")))
    assert got == want and len(got) == 90


def test_an_index_search_makes_no_table_of_queries_by_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(10)
    docs = spark.createDataFrame([(k, "all " + " ".join(f"w{rng.randint(1, 30)}" for _ in range(12))) for k in range(640)], "doc long, text string")
    index = term_index.build_term_index(docs, str(tmp_path / "index"), "doc", block_docs=8, buckets=2)
    asked = spark.createDataFrame([(k, f"all w{k % 30 + 1} w{k % 29 + 1}") for k in range(60)], "q long, text string")
    written, write = [], term_index.materialize
    monkeypatch.setattr(term_index, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    want = sorted(map(tuple, search.sparse_topk(asked, docs, 5, "q", "doc").select("q", "doc", "score", "rank").collect()))
    for rounds in (1 << 21, 20):
        got = term_index.indexed_topk(asked, index, 5, "q", round_rows=rounds)
        assert sorted(map(tuple, got.select("q", "doc", "score", "rank").collect())) == want
    assert max(t.count() for t in written) <= 60 * 5  # the result's rows; 60 queries by 80 blocks would be 4800


@pytest.mark.parametrize("dense", [0, 2, 1 << 40])
def test_blocks_are_scored_by_pairs_and_by_matrices_alike(dense):
    rng = np.random.default_rng(dense % 7)
    held, wanted, idf = rng.random((90, 40)) * (rng.random((90, 40)) < 0.3), rng.random((70, 40)) < 0.2, rng.random(40)
    held[50:60] = held[40:50]  # ties
    q, t = np.nonzero(wanted)
    lists = [q[t == x].tolist() for x in range(40)]
    table = pa.table({"term": [f"t{x}" for x in range(40)], "idf": idf, "q": pa.array(lists, pa.list_(pa.int64()))})
    asked = search.QueryBlocks.of(table, size=16)
    scorer = search.Scorer(asked, 6, pa.int64(), dense=dense, pairs=50)
    for low in range(0, 90, 18):
        part = held[low : low + 18]
        term, doc = np.nonzero(part.T)
        last = np.flatnonzero(np.diff(term, append=-1))
        scorer.add(term[last], last + 1, doc, part[doc, term], pa.array(np.arange(low, low + 18)))
    got = scorer.best.batch(asked.ids, ["q", "doc", "score"]).to_pylist()
    want, exact = [], np.round((held * idf) @ wanted.T, 6)
    for x in np.unique(q):
        want += [(x, d, exact[d, x]) for d in sorted(np.flatnonzero(exact[:, x] > 0), key=lambda d: (-exact[d, x], d))[:6]]
    assert sorted((r["q"], r["doc"], round(r["score"], 6)) for r in got) == sorted((int(x), int(d), round(float(v), 6)) for x, d, v in want)


def test_term_search_counts_within_tasks_whatever_the_number_of_terms(spark, monkeypatch):
    rng = random.Random(11)
    docs = spark.createDataFrame([(k, " ".join(f"w{rng.randint(1, 60)}" for _ in range(15))) for k in range(300)], "doc long, text string").repartition(3)
    asked = docs.filter("doc % 10 = 0").withColumnRenamed("doc", "q")
    plans, write = {}, search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: plans.setdefault(name, df) is None or write(df, name))
    want = sorted(map(tuple, search.sparse_topk(asked, docs, 4, "q", "doc").select("q", "doc", "score", "rank").collect()))
    plan = plans["counts"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # no row for each document and term
    for rounds in (1 << 21, 25):
        assert sorted(map(tuple, search.sparse_topk(asked, docs, 4, "q", "doc", round_rows=rounds).select("q", "doc", "score", "rank").collect())) == want


def test_words_within_tasks_are_those_of_the_pattern(spark):
    texts = ["", "a", " a b ", "Ünïcode ÇA va? x²y ½", "日本語 テスト。ab", "\U0001d4d0\U0001d4d1 \U0001f600x", "e\u0301a i\u0307", "١٢٣ Ⅷ ⅷ ª", "a\u00adb_c-d", "\u0378 \u0e01\u0e31", "x\n\ty", "", "é"]
    rows = spark.createDataFrame([*enumerate(texts)], "id long, t string").select("id", F.lower("t").alias("t"), F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")).orderBy("id").collect()
    for kind in (pa.string(), pa.large_string()):
        words, row = search._words(pa.array(["skip", *(r.t for r in rows)], kind).slice(1), search._letters(spark))
        assert list(zip(row.tolist(), words.to_pylist(), strict=True)) == [(k, w) for k, r in enumerate(rows) for w in r.w]
    points = "".join(chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)])
    held = spark.createDataFrame([(points,)], "t string").select(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")).first().w
    assert search._words(pa.array([points]), search._letters(spark))[0].to_pylist() == held


def test_nearest_vectors_keep_ties_to_the_smaller_id(spark):
    rng = random.Random(12)
    vectors = [(k, [float(rng.randint(-1, 1)) for _ in range(3)]) for k in range(400)] + [(400, [float("nan"), 1.0, 0.0]), (401, None)]
    rows = spark.createDataFrame(vectors, "v long, embedding array<double>")
    got = search.dense_topk(rows.filter("v % 3 = 0").withColumnRenamed("v", "q"), rows, 7, "q", "v", block=64)
    unit = {k: np.array(v) / max(np.linalg.norm(v), 1e-300) for k, v in vectors if v is not None and not np.isnan(v).any()}
    want = []
    for q in (k for k in unit if k % 3 == 0):
        scores = sorted((-round(float(v @ unit[q]), 6), k) for k, v in unit.items() if k != q)[:7]
        want += [(q, k, -s + 0.0, rank) for rank, (s, k) in enumerate(scores, 1)]
    assert sorted((r.q, r.v, r.score + 0.0, r["rank"]) for r in got.collect()) == sorted(want)


def test_bodies_pass_through_python_once(spark):
    rows = spark.createDataFrame([("a", "html", "<p>x &amp;lt; y"), ("b", "json", "{b: 1}"), ("c", "json", "&amp;"), ("d", "default", "t")], "key string, kind string, content string")
    clean = documents.normalized_bodies(rows, "key", "kind", "content")
    assert clean._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # plain text is composed there; HTML has no second step
    got = {r.key: r.clean for r in clean.collect()}
    assert got["b"] == '{"b":1}' and got["c"] == "&amp;" and "x &lt; y" in got["a"]
