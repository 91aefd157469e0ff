"""Readers of captures, findings, scans and patterns, on small files of our own."""

from __future__ import annotations

import base64
import json
import random
from itertools import pairwise

from pyspark.sql import functions as F

from webstrata.operators import sinks
from webstrata.plans import rows as registry
from webstrata.sources import captures, findings
from webstrata.sources.har_entries import EntrySplitter

def as_of():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")



def katana(**more):
    item = {"timestamp": "2025-06-28T22:44:56.123456789Z", "request": {"endpoint": "https://a.example.com/x", "method": "get", "headers": {"user_agent": "t", "raw": "r"}, "body": None}, "response": {"status_code": 200, "headers": {"content_type": "text/html", "content-type": "text/plain"}, "body": "hi", "rtt": 0.5, "technologies": "nginx", "forms": [{"method": "POST", "action": "/b"}]}}
    for path, value in more.items():
        a, _, b = path.partition("__")
        if b:
            item[a] = {k: v for k, v in item[a].items() if k != b} if value is None else item[a] | {b: value}
        elif value is None:
            del item[a]
    return item


def test_katana(spark, tmp_path):
    lines = [katana(), katana(response__status_code=None), katana(request=None), katana(request__endpoint="not a url"), katana(timestamp=None)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    (tmp_path / "b.json").write_text(json.dumps(katana(request__endpoint="http://b/"), indent=1))
    good, bad = captures.read_katana(spark, str(tmp_path))
    rows = {r.url: r for r in good.collect()}
    assert set(rows) == {"https://a.example.com/x", "http://b/"} and bad.count() == 5
    row = rows["https://a.example.com/x"]
    assert row.method == "GET" and row.technologies == ["nginx"] and row.response_rtt_ms == 500.0
    assert [(h.name, h.value) for h in row.request_headers] == [("User-Agent", "t")] and row.response_headers[0].value == "text/plain"
    out = [json.loads(r.value) for r in sinks.to_katana(good).collect()]
    again, none = captures.parse_katana(spark.createDataFrame([(json.dumps(o),) for o in out], "value string"))
    assert sorted(r.url for r in again.collect()) == sorted(rows) and none.count() == 0


def test_capture_export(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(katana(response__status_code=s)) for s in (200, 404, 503, 500)))
    good, _ = captures.read_capture_export(spark, str(tmp_path), ignore=(500,))
    assert sorted(r.status_code for r in good.collect()) == [200, 503] and good.first().response_rtt_ms == 0.5


def test_har(spark, tmp_path):
    entry = {"startedDateTime": "2025-06-28T22:44:56Z", "time": 250.0, "request": {"method": "POST", "url": "https://a.b/c", "headers": [{"name": "x-a", "value": "1"}, {"name": "X-A", "value": "2"}, {"name": " ", "value": "z"}], "postData": {"text": "body"}}, "response": {"status": 201, "headers": [], "content": {"mimeType": "text/html", "size": 2, "text": "ok"}}}
    (tmp_path / "a.har").write_text(json.dumps({"log": {"entries": [entry, {"request": entry["request"]}, entry | {"request": entry["request"] | {"url": "bad"}}]}}))
    (tmp_path / "b.har").write_text("{}")
    (tmp_path / "c.har").write_text("nope")
    good, bad = captures.read_har(spark, str(tmp_path), as_of())
    row = good.collect()[0]
    assert good.count() == 1 and bad.count() == 4 and row.request_body == "body" and row.response_rtt == 0.25
    assert [(h.name, h.value) for h in row.request_headers] == [("X-A", "1;2")]


def test_har_splitter_equals_json_loads_however_it_is_cut():
    rng = random.Random(5)
    odd = ["", "request", 'a"request"b', "\\", '\\"', "}]{[", "\u00e4\u2028", '"request', "entries", "log", "x" * 50]
    for _ in range(400):
        value = lambda d: rng.choice(odd) if d == 0 or rng.random() < 0.4 else {rng.choice(odd): value(d - 1) for _ in range(3)} if rng.random() < 0.5 else [value(d - 1) for _ in range(2)]  # noqa: B023, E731
        entries = [{"request": value(2), rng.choice(odd): value(2)} for _ in range(rng.randint(0, 4))]
        log = {"pages": [value(2), {"entries": [{"a": 1}]}], "entries": entries, "z": value(1)}
        text = json.dumps({"creator": value(2), "log": log, "tail": {"entries": [{"b": 2}], "log": {"c": [{}]}}}, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 30)))
        splitter = EntrySplitter()
        got = [e for a, b in pairwise([0, *cuts, len(text)]) for e in splitter.feed(text[a:b])]
        assert [json.loads(e) for e in got] == entries and splitter.end() is None, text
        if entries:
            short = EntrySplitter()
            head = list(short.feed(text[: text.index(got[-1]) + len(got[-1]) - 1]))
            assert len(head) < len(got) and short.end()[1] == "HAR log breaks off"


def test_large_har_files_are_read_in_pieces(spark, tmp_path):
    text = lambda k: f'say \\"request" {k} }}]' + "y" * 400
    entry = lambda f, k: {"time": 1.0, "request": {"method": "GET", "url": f"https://{f}.b/{k}", "headers": [{"name": "request", "value": "request"}]}, "response": {"status": 200, "headers": [], "content": {"text": text(k)}}}
    for f in ("a", "b"):
        (tmp_path / f"{f}.har").write_text(json.dumps({"log": {"version": "1.2", "entries": [entry(f, k) for k in range(300)]}}, indent=2 if f == "a" else None))
    (tmp_path / "cut.har").write_text(json.dumps({"log": {"entries": [entry("cut", k) for k in range(300)]}})[:-300])
    (tmp_path / "none.har").write_text(json.dumps({"request": ["x" * 200_000]}))
    (tmp_path / "empty.har").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        seen = []
        for bound in (1 << 23, 1000):
            good, bad = captures.read_har(spark, str(tmp_path), as_of(), bound)
            seen.append((sorted((r.url, r.response_body, r.request_headers[0].value) for r in good.collect()), sorted((r.reason, r["item"]) for r in bad.collect())))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows, rejects = seen[0]
    assert seen[1] == seen[0] and len(rows) == 300 * 2 + 299
    assert rows[:1] == [("https://a.b/0", text(0), "request")] and {r[0] for r in rejects} == {"not a HAR log", "HAR log breaks off"}


def test_http_raw(spark, tmp_path):
    (tmp_path / "a.txt").write_text("GET /p?q=1 HTTP/1.1\r\nHost: h.example.com\r\nx-a: 1\r\nX-A: 2\r\n\r\nHTTP/1.1 200 OK\r\nDate: Sat, 19 Jul 2025 13:23:10 GMT\r\n\r\nline1\r\nline2")
    (tmp_path / "b.txt").write_text("GET http://z/ HTTP/1.1\n\nreq body\nHTTP/1.1 204 None\n\n")
    (tmp_path / "c.txt").write_text("GET / HTTP/1.1\n\nHTTP/1.1 200 OK\n\n")
    (tmp_path / "d.txt").write_text("GET / HTTP/1.1\nHost: a\n\n")
    good, bad = captures.read_http_raw(spark, str(tmp_path), as_of())
    rows = {r.url: r for r in good.collect()}
    assert set(rows) == {"http://h.example.com/p?q=1", "http://z/"} and bad.count() == 2
    assert rows["http://h.example.com/p?q=1"].response_body == "line1\nline2" and rows["http://z/"].request_body == "req body"
    assert ("X-A", "1, 2") in [(h.name, h.value) for h in rows["http://h.example.com/p?q=1"].request_headers]


def test_http_csv(spark, tmp_path):
    request, response = base64.b64encode(b"POST /a HTTP/1.1\r\nHost: h\r\nA: b\r\n\r\nq=1").decode(), base64.b64encode(b"HTTP/1.1 302 Found\r\nDate: Sat, 19 Jul 2025 13:23:10 GMT\r\nX: y\r\n\r\n<p>").decode()
    lines = ["Request.URL,Time,Request,Response,rtt", f"https://h/a,2025-06-28T22:44:56Z,{request},{response},12", f"https://h/b,,{request},{response},13", "https://h/c,x,y,z,1"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    good, bad = captures.read_http_csv(spark, str(tmp_path / "a.csv"))
    rows = {r.url: r for r in good.collect()}
    assert set(rows) == {"https://h/a", "https://h/b"} and bad.count() == 2
    assert rows["https://h/a"].status_code == 302 and rows["https://h/a"].response_rtt == 12 and rows["https://h/b"].timestamp.startswith("Sat") and rows["https://h/a"].request_body == "q=1"


def test_route(spark):
    har = {"log": {"entries": []}}
    items = [json.dumps(katana()), json.dumps(har), "GET http://z/ HTTP/1.1\n\nHTTP/1.1 200 OK\n\n", "garbage", '{"a": 1}']
    good, bad = captures.route_formats(spark.createDataFrame([(i,) for i in items], "value string"), as_of())
    assert sorted(r.url for r in good.collect()) == ["http://z/", "https://a.example.com/x"]
    assert sorted(r.item for r in bad.collect()) == ["garbage", '{"a": 1}']


def test_findings(spark, tmp_path):
    scanner = {"template-id": "t1", "info": {"name": "Leak", "severity": "high", "reference": ["https://r/1"], "classification": {"cve-id": ["cve-2025-1"], "cwe-id": ["cwe-79"]}, "metadata": {"shodan-query": "x", "other": "y"}}, "matched-at": "https://a.example.com/x", "url": "https://a.example.com", "request": "GET / HTTP/1.1\nHost: a\n", "response": "HTTP/1.1 200\ncontent-type: image/png\n\n" + "b" * 3000}
    (tmp_path / "a.json").write_text(json.dumps([scanner, {"target": "https://b.example.com/", "markdown": " # Note "}]))
    (tmp_path / "b.jsonl").write_text('{"target": "c.example.com:8443", "markdown": "x", "title": "T"}\nbad line\n{"target": "no host at all", "markdown": "x"}\n{"target": "d.example.com"}')
    good, bad = findings.read_findings(spark, str(tmp_path))
    rows = {r.target: r for r in good.collect()}
    assert set(rows) == {"https://a.example.com/x", "https://b.example.com/", "c.example.com:8443"} and bad.count() == 3
    assert rows["https://a.example.com/x"].title == "Leak on https://a.example.com/x" and "bbb" not in rows["https://a.example.com/x"].markdown and rows["https://b.example.com/"].markdown == "# Note"
    normal = findings.normalize_scanner_findings(spark.createDataFrame([(json.dumps(scanner),)], "item string"))
    kinds = {(r.kind, r.value) for r in findings.classification_rows(normal).collect()}
    assert {("cve", "CVE-2025-1"), ("cwe", "79"), ("reference", "https://r/1"), ("shodan-query", "x")} == kinds


def test_scan_xml(spark, tmp_path):
    (tmp_path / "r1.xml").write_text('<nmaprun><host><address addr="10.0.0.1" addrtype="ipv4"/><hostnames><hostname name="h1"/></hostnames><ports><extrareasons/><port portid="80" protocol="tcp"><state state="open"/><service name="http"/><script id="a" output="one"/><script id="b" output="two"/></port><port portid="81"/></ports></host><host><address addr="10.0.0.2"/></host></nmaprun>')
    runs, ports = findings.read_scan_xml(spark, str(tmp_path / "r1.xml"), as_of(), "h1", "80,81")
    rows = {r.port: r for r in ports.collect()}
    assert set(rows) == {80, 81} and rows[80].service_notes == "one\ntwo" and rows[81].state == "unknown" and rows[80].netloc == "10.0.0.1:80"
    assert runs.count() == 1 and not runs.first().has_error


def test_patterns(spark, tmp_path):
    (tmp_path / "sql_injection_html.txt").write_text("one\n----\ntwo\nlines\n=====\n\n----\none\n")
    (tmp_path / "xss_network.txt").write_text("three\n-----\n")
    rows = sorted(tuple(r) for r in findings.read_patterns(spark, str(tmp_path)).collect())
    assert rows == [("sql_injection", "html", "one"), ("sql_injection", "html", "two\nlines"), ("xss", "network", "three")]


def test_custom_routes_come_first(spark):
    from webstrata.sources import captures

    own = lambda d: (captures.parse_katana(d.select(F.regexp_replace("value", "^x:", "").alias("value"))))
    item = '{"timestamp":"2025-01-01T00:00:00Z","request":{"endpoint":"http://a.example.com/","method":"get"},"response":{"status_code":200}}'
    items = spark.createDataFrame([("x:" + item,), (item,), ("?",)], "value string")
    good, bad = captures.route_formats(items, F.lit("2025-01-01").cast("timestamp"), routes=[(F.col("value").startswith("x:"), own)])
    assert good.count() == 2 and [r.item for r in bad.collect()] == ["?"]


def test_uploads(spark):
    from webstrata.sources import captures

    item = '{"timestamp":"2025-01-01T00:00:00Z","request":{"endpoint":"http://a.example.com/%d","method":"get"},"response":{"status_code":200}}'
    head = '"Host: c.example.com\nAccept: a, b\nX: ""q"""'
    csv = f'url,method,time,status,request,response\nhttp://c.example.com/x,POST,2025-01-01T00:00:00Z,201,{head},"Server: s\nA: b\nC: d"\n'
    raw = "GET /p HTTP/1.1\nHost: d.example.com\n\nHTTP/1.1 204 No\nDate: Wed, 1 Jan 2025 00:00:00 GMT\n\n"
    bodies = spark.createDataFrame([(item % 1 + "\n" + item % 2 + "\n",), (csv,), (raw,), ("nothing",)], "value string")
    good, bad = captures.route_uploads(bodies, F.lit("2025-01-01").cast("timestamp"))
    got = {(r.url, r.method, r.status_code): r for r in good.collect()}
    assert set(got) == {("http://a.example.com/1", "GET", 200), ("http://a.example.com/2", "GET", 200), ("http://c.example.com/x", "POST", 201), ("http://d.example.com/p", "GET", 204)}
    assert [tuple(h) for h in got["http://c.example.com/x", "POST", 201].request_headers] == [("Host", "c.example.com"), ("Accept", "a, b"), ("X", '"q"')]
    assert {r.item for r in bad.collect()} == {"nothing", "url,method,time,status,request,response"}


def test_rows_of_one_csv_file_are_dealt_out(spark, tmp_path):
    head = "A: a\nB: b\nC: c"
    lines = "".join(f'http://h{k}.example.com/,GET,2025-01-01T00:00:00Z,200,"{head}","{head}"\n' for k in range(50))
    (tmp_path / "one.csv").write_text(lines)
    good, bad = captures.read_http_csv(spark, str(tmp_path / "one.csv"))
    assert good.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert good.count() == 50 and bad.count() == 0


def test_a_file_for_each_text_is_written_by_many_tasks_into_one_folder(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "folder", lambda _, name: str(tmp_path / name))
    pages = registry.QUERIES["raw_files"](spark, sf).count()
    files = [f.name for f in (tmp_path / "raw").iterdir()]
    parts = [n for n in files if n.startswith("part-")]
    assert len(parts) == pages == spark.read.parquet(f"{sf}/pages.parquet").count() and len({n.split("-")[1] for n in parts}) == 4
    assert sorted(set(files) - set(parts)) == ["_SUCCESS"]  # neither folders nor checksum files
