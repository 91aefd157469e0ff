"""Documents, dedupe, chunks, content jobs, listing, search, sinks, streams."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from webstrata.operators import documents, listing, search, sinks
from webstrata.sources.schema import EXCHANGE
from webstrata.streaming import ingest

def as_of():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")

HTML = [("Content-Type", "text/html"), ("ETag", "e1"), ("Content-Length", "9")]


def exchange(url, body="<p>x</p>", headers=HTML, forms=None, status=200, ts="2025-07-19T08:23:11-05:00", method="GET"):
    return (url, method, [("B", "2"), ("A", "1")], None, status, headers, body, ts, None, None, None, forms)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        exchange("https://a.example.com/x", "<title> T &amp; u </title><meta name='description' content='first'><meta property=\"og:description\" content=\"last\">", forms=[{"action": "/z", "method": "POST"}, {"action": "/a"}]),
        exchange("https://a.example.com/pdf", "%PDF", [("Content-Type", "application/pdf")]), exchange("not a url"), exchange("http://[::1]:81/", ts="bad"), exchange("http://B.example.com", ""),
    ]
    return documents.derive_documents(spark.createDataFrame(rows, EXCHANGE), as_of()).cache()


def test_derive(docs):
    rows = {(r.url, r.doc_type): r for r in docs.collect()}
    assert len(rows) == 7 and docs.filter("url = 'https://a.example.com/x'").count() == 3
    content, forms, network = (rows["https://a.example.com/x", k] for k in ("content", "forms", "network"))
    assert content.title == "T & u" and content.description == "last" and content.domain == "example.com"
    assert content.doc_id == hashlib.sha256(b"https://a.example.com/x:content:2025-07-19T:e1").hexdigest()
    assert json.loads(forms.content) == [{"action": "/a"}, {"action": "/z", "method": "POST"}] and forms.token_length == 256
    assert network.content.startswith("--- HTTP Request Headers ---\nA: 1\nB: 2\n--- HTTP Response Headers ---\n")
    assert rows["http://[::1]:81/", "network"].netloc == "[::1]:81" and rows["http://[::1]:81/", "network"].ts_text.startswith("2025-01-01T")
    assert rows["http://B.example.com", "network"].host == "b.example.com"


def test_new_rows(docs):
    stored = docs.filter("doc_type = 'network'")
    assert documents.new_by_id(docs, stored).filter("doc_type = 'network'").count() == 0
    content = docs.filter("doc_type = 'content'")
    assert documents.new_typed(content, content).count() == 0
    moved = content.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    assert documents.new_typed(moved, content).count() == 0
    assert documents.new_typed(moved.withColumn("content_sha256", F.lit("other")), content).count() == content.count()


def test_first_hit_and_unique(spark):
    hits = spark.createDataFrame([(0, "a", 0.5, 2), (1, "a", 0.9, 1), (1, "b", 0.8, 2)], "query_ix int, doc_id string, score double, rank int")
    assert {(r.doc_id, r.score) for r in documents.first_hit(hits).collect()} == {("a", 0.5), ("b", 0.8)}
    rows = spark.createDataFrame([("u", None, None, None, 1, "a"), ("u", "GET", 200, 0.1, 0, "b"), ("v", "GET", 200, None, 5, "c")], "url string, http_method string, status_code int, score double, ts long, doc_id string")
    assert [r.doc_id for r in documents.sort_unique(rows).collect()] == ["b", "c"] and documents.sort_unique(rows, 1).count() == 1


@pytest.mark.parametrize(("tokens", "longest", "sizes"), [(256, 2048, (119, 15)), (None, 2048, (952, 122)), (None, 4096, (1904, 245)), (None, 10**9, (238, 30))])
def test_chunk_sizes(tokens, longest, sizes):
    assert documents.chunk_sizes(tokens, longest) == sizes


@pytest.mark.parametrize("n", [1, 10, 11, 18, 19, 100])
def test_chunks_cover(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    rows = documents.chunk_words(spark.createDataFrame([(1, text)], "id int, t string"), "t", 10, 2, ["id"]).orderBy("chunk_ix").collect()
    words = [r.chunk.split(" ") for r in rows]
    assert {w for c in words for w in c} == set(text.split(" ")) and len(rows) == (1 if n <= 10 else 1 + -(-(n - 10) // 8))
    assert all(a[-2:] == b[:2] for a, b in zip(words, words[1:], strict=False) if len(a) == 10)


def test_chunk_documents(docs):
    typed = docs.filter("doc_type = 'content'").withColumn("doc_type", F.lit("html"))
    rows = documents.chunk_documents(typed).collect()
    assert {r.token_length for r in rows} == {None, 256} and all(r.chunk_id == f"{r.parent_id}_{r.chunk_ix}" for r in rows)


@pytest.mark.parametrize(
    ("kind", "before", "after"),
    [
        ("html", "<!DOCTYPE html><P Nonce=1 b='2' A=1>x \n &amp; y", '<html><head></head><body><p a="1" b="2">x & y</p></body></html>'), ("json", "{b: 1, 'a': [1,2,], // c\n}", '{"a":[1,2],"b":1}'), ("json", "{broken", "{broken"),
        ("css", "b , a>p{ COLOR:#AABBCC; margin:0px; margin : 1.0; background:url('x.png?v=1') } /* c */ @import  url(z.css);", "a>p,b{background:url(x.png);color:#abc;margin:1;}@import url(z.css);"),
        ("css", "@media print{a{b:c}}", "@media print{a{b:c;}}"), ("xml", "<a><b>x</b> <c d='1'/></a>", '<a>\n  <b>\n    x\n  </b>\n  <c d="1">\n  </c>\n</a>'), ("xml", "<!DOCTYPE a><a/>", "<!DOCTYPE a><a/>"),
    ],
)
def test_branches(spark, kind, before, after):
    row = spark.createDataFrame([("k", kind, before)], "key string, kind string, content string")
    assert documents.normalized_bodies(row, "key", "kind", "content").first().clean == after


def test_normalize_documents(docs):
    rows = {r.doc_type: r for r in documents.normalize_documents(docs.filter("url = 'https://a.example.com/x'")).collect()}
    assert rows["content"].normalized and not rows["network"].normalized
    length = {h.name: h.value for h in rows["content"].response_headers}["Content-Length"]
    assert int(length) == len(rows["content"].content.encode())
    again = documents.normalize_documents(docs.sparkSession.createDataFrame([rows["content"]], docs.schema)).first()
    assert again.content == rows["content"].content


def test_carry_forward_title(spark):
    rows = [("a", "u", "content", 200, 1, "T", None), ("b", "u", "content", 200, 2, None, "D"), ("c", "u", "network", 200, 3, None, None), ("d", "u", "content", 404, 4, None, None)]
    got = documents.carry_forward_title(spark.createDataFrame(rows, "doc_id string, url string, doc_type string, status_code int, ts int, title string, description string"))
    assert {r.doc_id: (r.title, r.description) for r in got.collect()} == {"a": ("T", None), "b": ("T", "D"), "c": (None, None), "d": (None, None)}


def test_listing(spark):
    rows = [("Example.com", "a.example.com", "a.example.com:443", 443, "https://a.example.com/x", "/x", 1), ("example.com", "badexample.com", "", 80, "http://badexample.com/y", "/y", 2), ("", "", "", None, "z", "", 3)]
    df = spark.createDataFrame(rows, "domain string, host string, netloc string, port int, url string, path string, ts int")
    assert {(r.domain, r.n) for r in listing.count_by(df, "domain").collect()} == {("example.com", 2)}
    assert [r.netloc for r in listing.distinct_values(df, "netloc", "host").collect()] == ["a.example.com:443", "badexample.com"]
    assert df.filter(listing.host_ends_with("example.com")).count() == 2 and df.filter(listing.host_ends_with("example.com", boundary=True)).count() == 1
    assert df.filter(listing.host_ends_with("example.com", 443)).count() == 1
    assert [r.url for r in listing.find_urls(df, "example.com", "/").collect()] == ["http://badexample.com/y", "https://a.example.com/x"]
    assert listing.corpus_summary(df).first().n_domains == 1 and listing.in_values("url", [None]) is None
    assert df.filter(listing.all_of(listing.in_values("port", [443]), None)).count() == 1
    under = listing.hosts_under(df.select("host"), spark.createDataFrame([("example.com",)], "asked string"))
    assert [r.host for r in under.collect()] == ["a.example.com"]
    paths = spark.createDataFrame([("/lists/lfi/a.txt",), ("/lists/web/lfi.txt",), ("/x/none.txt",), ("C:\\w\\lfi\\b",)], "path string")
    assert [r.path for r in listing.rank_paths(paths, "LFI").collect()][:2] == ["C:\\w\\lfi\\b", "/lists/lfi/a.txt"]


def test_freshness(spark):
    rows = [("http://a/x", f"2025-01-01 0{i % 10}:00:00") for i in range(11)] + [("http://b/", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "url string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = listing.freshness(df, "http://a", F.lit("2025-01-01 12:00:00").cast("timestamp")).first()
    assert got.n == 11 and got.is_recent
    assert not listing.freshness(df, "http://b", F.lit("2025-01-01 12:00:00").cast("timestamp")).first().is_recent


def test_covering_run(spark):
    rows = [("r1", 2, "2025-01-05", "t", [80, 443], False), ("r2", 2, "2025-01-06", "t", [80], False), ("r3", 2, "2025-01-07", "t", None, True), ("r4", 2, "2024-01-01", "t", None, False)]
    runs = spark.createDataFrame(rows, "run_id string, version int, ts string, targets string, ports array<int>, has_error boolean").withColumn("ts", F.to_timestamp("ts"))
    now = F.lit("2025-01-08").cast("timestamp")
    assert listing.latest_covering_run(runs, "t", [443], now).first().run_id == "r1"
    assert listing.latest_covering_run(runs, "t", [0], now).first().run_id == "r2" and listing.latest_covering_run(runs, "u", [80], now).count() == 0


def test_cascade(docs):
    assert [r.url for r in listing.find_resources(docs, "https://a.example.com/x").collect()] == ["https://a.example.com/x"]
    by_host = listing.find_resources(docs, "https://a.example.com/none")
    assert by_host.count() > 0 and listing.find_resources(docs, "https://zzz.example.org/").count() == 0
    some = docs.limit(2).select("doc_id", F.lit(0.5).alias("score"))
    assert listing.find_resources(docs, "https://zzz.example.org/", hits=some).count() >= 1 and listing.find_resources(docs, "pages about x", hits=some).count() >= 1
    assert [r.url for r in listing.recommend_urls(docs, "https://zzz.example.org/").collect()] == sorted({f"http{'s' if r.port % 1000 == 443 else ''}://{r.netloc}" for r in docs.collect() if r.http_method == "GET"})
    row = listing.fetch_content(docs, url="https://a.example.com/x", length=5).first()
    assert row.has_more and len(row.text) == 5
    shown = listing.http_resource(docs.withColumn("score", F.lit(0.0))).first()
    assert shown.score == 0.0
    assert listing.recommend_urls(docs, "https://a.example.com/x").count() == 1
    found, label, more = listing.query_findings(docs, "https://a.example.com/x/", 2)
    assert label == "url" and more and found.count() == 2
    assert listing.query_findings(docs.withColumn("netloc", F.lit("a.example.com:80")), "a.example.com", 100)[1] == "netloc"
    assert listing.recommended_targets(docs.filter("domain = 'example.com'")).count() >= 1


def test_search(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue sky"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(9, "apple pie")], "q long, text string")
    top = search.sparse_topk(queries, docs, 2, "q", "doc_id").orderBy("rank").collect()
    assert [r.doc_id for r in top] == [1, 2]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "v long, embedding array<float>")
    dense = search.dense_topk(vectors.filter("v = 1").withColumnRenamed("v", "q"), vectors, 2, "q", "v").orderBy("rank").collect()
    assert [r.v for r in dense] == [2, 3]
    lists = [spark.createDataFrame(r, "q long, d long, rank int") for r in ([(1, 5, 1), (1, 6, 2)], [(1, 6, 1)])]
    assert [r.d for r in search.fuse(lists, "q", "d", 5).orderBy("rank").collect()] == [6, 5]
    part = spark.createDataFrame([("html", 0.5, 1, "a"), ("css", 0.9, 1, "b"), ("html", None, 2, "c")], "doc_type string, score double, ts int, doc_id string")
    assert [r.doc_id for r in search.merge_collections([part], ["html"]).collect()] == ["a", "b", "c"]
    assert [r.label for r in search.label_list(spark.createDataFrame([('["Sql Injection", "sql injection"]',), ('{"XSS": 1}',), ("bad",)], "t string"), "t").orderBy("label").collect()] == ["sql_injection", "xss"]
    texts = search.text_hits(spark.createDataFrame([(1, "so it is a b c d e f g h i j k"), (2, "a b c d e f g h")], "doc_id long, text string"), spark.createDataFrame([(7, "a b c d e f g h i")], "item_id long, text string"), "doc_id", "item_id")
    assert [tuple(r) for r in texts.collect()] == [(1, 7)]
    held = ["so it is a b c", "xa by", "a b", "is a b cx", None, ""]
    asked = ["it is a", "a b", "b", "s a b c", "o it is a b", "", None, "a b c d", " a b"]
    got = search.text_hits(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(asked)), "item_id long, text string"), "doc_id", "item_id")
    assert {tuple(r) for r in got.collect()} == {(i, k) for i, h in enumerate(held) for k, a in enumerate(asked) if h and a and a in h}


def test_patterns(spark):
    patterns = spark.createDataFrame([("xss", "html", "<script> at {target}"), ("xss", "html", "onload"), ("sqli", "html", "select")], "label string, doc_type string, pattern string")
    labels, targets = spark.createDataFrame([("xss",)], "label string"), spark.createDataFrame([("a",), ("b",)], "target string")
    rows = search.expand_patterns(labels, patterns, targets, 10, "asked").orderBy("rank").collect()
    assert [r.pattern for r in rows] == ["asked", "<script> at a", "<script> at b", "onload"]
    assert search.expand_patterns(labels, patterns, targets, 2).count() == 3 and search.expand_patterns(labels, patterns, targets, 1, "asked").count() == 1
    more = spark.createDataFrame([("html", f"new {k}") for k in range(9)] + [("css", "other")], "doc_type string, pattern string")
    assert [r.pattern for r in search.expand_patterns(labels, patterns, targets, 2, "asked", more).orderBy("rank").collect()][4:] == ["new 0", "new 1", "new 2"]
    assert search.expand_patterns(labels, patterns, targets, 7, None, more).count() == 3 + 5


def test_embed(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    rows = search.embed(df, "t").collect()
    assert len(rows[0].embedding) == 256 and rows[1].embedding is None and rows[1].embedding_error == "no text"

    def broken():
        def model(texts):
            raise RuntimeError("no model")

        return model

    assert search.embed(df.limit(1), "t", broken).first().embedding_error == "no model"


def test_describe(spark):
    rows = [("a.css", "text one", None, None), ("b", "bad", None, None), ("c", "text", "own", None), ("d", "", None, None), ("e", "x", "t", "d")]
    df = spark.createDataFrame(rows, "url string, content string, title string, description string")

    def write(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [(f"T {t}", f"D {t}") for t in texts]

    got = {r.url: (r.title, r.description) for r in search.describe(df, write).collect()}
    assert got == {"a.css": ("T text one", "D text one"), "b": (None, None), "c": ("own", "D text"), "d": (None, None), "e": ("t", "d")}


def test_embed_calls_the_model_with_batches(spark):
    def make():
        def model(texts):
            if len(texts) > 1 and "odd" in texts:
                raise RuntimeError("batch")
            if texts == ["odd"]:
                raise RuntimeError("odd one")
            return [[float(len(texts)), float(len(t))] for t in texts]

        return model

    got = search.embed(spark.createDataFrame([("aa",), ("b",), (None,)], "t string").coalesce(1), "t", make, None).collect()
    assert [r.embedding for r in got] == [[2.0, 2.0], [2.0, 1.0], None]
    got = search.embed(spark.createDataFrame([("aa",), ("odd",)], "t string").coalesce(1), "t", make, None).collect()
    assert [(r.embedding, r.embedding_error) for r in got] == [([1.0, 2.0], None), (None, "odd one")]


def test_upsert_is_idempotent(docs, tmp_path):
    root, spark = f"{tmp_path}/corpus", docs.sparkSession
    for _ in range(2):
        sinks.upsert_documents(docs, root)
    assert sinks.stored_documents(spark, root).count() == docs.count()
    newer = docs.filter("doc_type = 'network'").withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 DAY"), "title": F.lit("new")})
    sinks.upsert_documents(newer, root)
    stored = sinks.stored_documents(spark, root)
    assert stored.count() == docs.count() and stored.filter("title = 'new'").count() == newer.count()
    older = newer.withColumns({"ts": F.col("ts") - F.expr("INTERVAL 9 DAYS"), "title": F.lit("again")})
    sinks.upsert_documents(older, root, batch=("w", 3))
    sinks.upsert_documents(newer, root, batch=("w", 3))
    assert sinks.stored_documents(spark, root).filter("title = 'again'").count() == newer.count()
    scan = listing.scan_corpus(spark, root, 1, ["url", "ts"], F.col("doc_type") == "network", True)
    assert scan.columns == ["url", "ts"] and scan.count() == newer.count()
    plan = scan._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(" in plan and "content" not in plan.split("ReadSchema")[-1]


def _files(root):
    return {p: p.stat().st_size for p in (root / "data").rglob("*.parquet")}


def test_a_batch_writes_what_it_holds(docs, tmp_path):
    """Bytes follow the batch, compaction touches the buckets it was asked for, readers of the version before keep their files."""
    root, spark = tmp_path / "corpus", docs.sparkSession
    sinks.upsert_documents(docs, str(root), 8)
    whole = _files(root)
    few = docs.orderBy("doc_id").limit(3).withColumn("title", F.lit("few"))
    for k in range(3):
        sinks.upsert_documents(few, str(root), 8, ("w", k))
        sinks.upsert_documents(few, str(root), 8, ("w", k))
    after = _files(root)
    assert all(after[p] == n for p, n in whole.items())
    added = [p for p in after if p not in whole]
    assert len(added) <= 9 and spark.read.parquet(*map(str, added)).count() == 9
    rows = sorted(map(repr, sinks.stored_documents(spark, str(root)).collect()))
    before = sinks.stored_documents(spark, str(root))
    seen = []
    while chosen := sinks.compact(spark, str(root), 3):
        seen += chosen
        assert len(chosen) <= 3 and sorted(map(repr, sinks.stored_documents(spark, str(root)).collect())) == rows
        if len(seen) == 3:
            assert sorted(map(repr, before.collect())) == rows
    assert len(seen) == len(set(seen)) and sinks.stored_documents(spark, str(root)).filter("title = 'few'").count() == 3
    sinks.upsert_documents(few.withColumn("title", F.lit("late")), str(root), 8, ("v", 0))
    assert sinks.stored_documents(spark, str(root)).filter("title = 'late'").count() == 3


def test_an_uncommitted_batch_is_not_seen(docs, tmp_path):
    root, spark = f"{tmp_path}/corpus", docs.sparkSession
    assert not sinks.store_exists(spark, root)
    sinks.upsert_documents(docs, root, 4)
    torn = sinks.partition_by_collection(docs.withColumn("title", F.lit("torn")), 4)
    torn.write.partitionBy(*sinks.FOLDERS).parquet(f"{root}/data/number=2/kind=delta")
    assert sinks.stored_documents(spark, root).filter("title = 'torn'").count() == 0
    sinks.upsert_documents(docs.limit(2).withColumn("title", F.lit("good")), root, 4)
    assert {r.title for r in sinks.stored_documents(spark, root).select("title").distinct().collect()} & {"torn", "good"} == {"good"}


def test_logs_and_replay(docs, tmp_path):
    sinks.append_log(docs.select("url"), f"{tmp_path}/log")
    sinks.append_log(docs.select("url"), f"{tmp_path}/log")
    assert docs.sparkSession.read.json(f"{tmp_path}/log").count() == 2 * docs.count()
    rows = docs.sparkSession.createDataFrame([("aGk=", [("Transfer-Encoding", "base64"), ("A", "b")]), ("???", [("Transfer-Encoding", "base64")]), ("raw", [])], "content string, response_headers array<struct<name:string,value:string>>")
    assert [bytes(r.body) for r in listing.replay_body(rows).collect()] == [b"hi", b"", b"raw"]


def test_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    item = {"timestamp": "2025-06-28T22:44:56Z", "request": {"endpoint": "https://a.example.com/x", "method": "GET", "headers": {}}, "response": {"status_code": 200, "headers": {"content-type": "text/html"}, "body": "<P>hi"}}
    (inbox / "1.txt").write_text(json.dumps(item) + "\ngarbage\n")
    root, state, rejects = (f"{tmp_path}/{n}" for n in ("corpus", "state", "rejects"))
    for _ in range(2):
        ingest.ingest(ingest.stream_items(spark, str(inbox)), root, state, rejects, as_of()).awaitTermination()
        (inbox / "2.txt").write_text(json.dumps(item) + "\n")
    stored = sinks.stored_documents(spark, root)
    assert {(r.doc_type, r.url) for r in stored.collect()} == {("content", "https://a.example.com/x"), ("network", "https://a.example.com/x")} and stored.count() == 2
    assert [r.item for r in spark.read.parquet(rejects).collect()] == ["garbage"]
    log = spark.read.parquet(f"{state}/log")
    assert log.count() == 2
    ingest.ingest_chunks(spark, f"{state}/log", log.schema, f"{tmp_path}/chunks", f"{tmp_path}/chunk-state", F.lit("html")).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/chunks/*").count() == 2


def test_content_length_follows_the_clean_body(spark):
    row = ("a", "content", "application/json", "{b: 1}", False, [("Content-Length", "9"), ("A", "b")])
    df = spark.createDataFrame([row], "content_sha256 string, doc_type string, content_type string, content string, normalized boolean, response_headers array<struct<name:string,value:string>>")
    got = documents.normalize_documents(df).first()
    assert got.content == '{"b":1}' and got.normalized and [tuple(h) for h in got.response_headers] == [("Content-Length", "7"), ("A", "b")]


@pytest.mark.parametrize(
    ("page", "clean"),
    [
        ("hi", "<html><head></head><body>hi</body></html>"), ("", "<html><head></head><body></body></html>"),
        ("<!DOCTYPE html><title>T</title><p>a<p>b<div>c", "<html><head><title>T</title></head><body><p>a</p><p>b</p><div>c</div></body></html>"),
        ("<html><head><meta B=1 a='2' nonce=x></head><body class=k><ul><li>a<li>b</ul></i></body></html>", '<html><head><meta a="2" b="1"/></head><body class="k"><ul><li>a</li><li>b</li></ul></body></html>'),
        ("<table><tr><td>1<td>2<tr><td>3</table>x<br>y", "<html><head></head><body><table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>x<br/>y</body></html>"),
        ("<script>if (a < b) { }</script><b>z", "<html><head><script>if (a < b) { }</script></head><body><b>z</b></body></html>"),
    ],
)
def test_pages_become_whole_trees(page, clean):
    assert documents._html(page) == clean and documents._html(clean) == clean
