"""Column steps: URLs, targets, times, types, lists, maps, ports, text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from webstrata.functions import urls, values


def one(spark, column, **cells):
    names = list(cells) or ["x"]
    row = spark.createDataFrame([tuple(cells.values()) or ("",)], ", ".join(f"{n} string" for n in names))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("url", "host", "port", "netloc"),
    [
        ("https://Example.COM/a?b#c", "example.com", 443, "example.com:443"), (" http://h:8080 ", "h", 8080, "h:8080"), ("ftp://a.b/", "a.b", 21, "a.b:21"),
        ("http://[2001:db8::1]:81/x", "2001:db8::1", 81, "[2001:db8::1]:81"), ("wss://a.b", "a.b", 443, "a.b:443"), ("odd://a.b", "a.b", None, "a.b"),
    ],
)
def test_url_facts(spark, url, host, port, netloc):
    got = one(spark, urls.url_struct(F.col("x")), x=url)
    assert (got["host"], got["port"], got["netloc"]) == (host, port, netloc)


@pytest.mark.parametrize("url", ["", "nothing", "http://", "http://a b/", None, "//a.b/c"])
def test_invalid_urls(spark, url):
    assert one(spark, urls.url_struct(F.col("x")), x=url) is None


@pytest.mark.parametrize(("host", "domain"), [("a.b.example.com", "example.com"), ("x.y.co.uk", "y.co.uk"), ("localhost", "localhost"), ("10.0.0.1", ""), ("::1", ""), (None, None)])
def test_domain(spark, host, domain):
    assert one(spark, urls.domain_of(F.col("x")), x=host) == domain


def test_domain_by_table(spark):
    hosts = spark.createDataFrame([("a.b.example.odd.zone",), ("shop.example.com",), ("1.2.3.4",), (None,)], "host string")
    suffixes = spark.createDataFrame([("odd.zone",), ("zone",), ("com",)], "suffix string")
    got = {r.host: r.domain for r in urls.with_domain(hosts, suffixes=suffixes).collect()}
    assert got["a.b.example.odd.zone"] == "example.odd.zone" and got["shop.example.com"] == "example.com" and got["1.2.3.4"] == ""


def test_suffix_rules(spark, tmp_path):
    (tmp_path / "rules.dat").write_text("// ===BEGIN ICANN DOMAINS===\ncom\nco.uk\nuk\n*.ck\n!www.ck\n\n// ===BEGIN PRIVATE DOMAINS===\nblog.com // hosts\n")
    rules = urls.read_suffixes(spark, f"{tmp_path}/rules.dat")
    assert {(r.suffix, r.private) for r in rules.collect()} == {("com", False), ("co.uk", False), ("uk", False), ("*.ck", False), ("!www.ck", False), ("blog.com", True)}
    names = {"a.b.com": "b.com", "me.blog.com": "me.blog.com", "x.me.blog.com": "me.blog.com", "blog.com": "blog.com", "a.co.uk": "a.co.uk", "co.uk": "co.uk", "x.y.z.ck": "y.z.ck", "a.www.ck": "www.ck", "Q.B.COM": "b.com", "a.b.zzz": "b.zzz", "10.0.0.1": "", "localhost": "localhost"}
    hosts = spark.createDataFrame([(n,) for n in [*names, None]], "host string")
    assert {r.host: r.domain for r in urls.with_domain(hosts, suffixes=rules).collect()} == names | {None: None}
    public = {r.host: r.is_public for r in urls.with_public_target(hosts, rules).collect()}
    assert [n for n in names if public[n]] == ["a.b.com", "me.blog.com", "x.me.blog.com", "blog.com", "a.co.uk", "x.y.z.ck", "a.www.ck", "Q.B.COM"] and not public[None]


@pytest.mark.parametrize(
    ("text", "host", "port"),
    [("http://A.b/c", "a.b", 80), ("a.b:8443", "a.b", 8443), ("[::1]:80", "::1", 80), ("a.b:x", None, None), ("a.b:99999", "a.b", None), ("A.B", "a.b", None)],
)
def test_query_netloc(spark, text, host, port):
    got = one(spark, urls.query_netloc(F.col("x")), x=text)
    assert (got["host"], got["port"]) == (host, port)


def test_targets(spark):
    df = spark.createDataFrame([("See https://a.example.com/x. and b.example.com:8443, or nothing! 10.0.0.1",)], "t string")
    got = [r.target for r in urls.extract_targets(df, "t").collect()]
    assert [t["host"] for t in got] == ["a.example.com", "10.0.0.1"]
    t = spark.createDataFrame([("https://a.b.com/x",), ("a.b.com:8443",), ("a.b.com",), ("10.0.0.1:80",), ("bad host",)], "x string").select(urls.target_struct(F.col("x")).alias("target"))
    assert [r[0] for r in t.select(urls.target_url(F.col("target"))).collect()] == ["https://a.b.com/x", "https://a.b.com:8443", "https://a.b.com", "http://10.0.0.1:80", None]
    fanned = urls.with_port(t.filter("target IS NOT NULL")).select("target.netloc").collect()
    assert sorted(r[0] for r in fanned) == ["10.0.0.1:80", "a.b.com:443", "a.b.com:443", "a.b.com:80", "a.b.com:8443"]


@pytest.mark.parametrize(
    ("url", "prefix", "variants"),
    [
        ("http://a/b", "http://a/b/", ["http://a/b", "http://a/b/"]), ("http://a/b/", "http://a/b/", ["http://a/b/", "http://a/b"]),
        ("http://a/b?c=d", "http://a/b?", ["http://a/b?c=d", "http://a/b", "http://a/b/"]), ("", "", []), ("plain", "plain", ["plain"]),
    ],
)
def test_url_variants(spark, url, prefix, variants):
    got = one(spark, urls.url_variants(F.col("x")), x=url)
    assert (got["prefix"], got["urls"]) == (prefix, variants)


@pytest.mark.parametrize(("host", "public"), [("8.8.8.8", True), ("10.1.1.1", False), ("192.168.0.1", False), ("172.20.0.1", False), ("a.com", True), ("localhost", False), ("corp", False), ("co.uk", False), (None, False)])
def test_public_targets(spark, host, public):
    assert one(spark, urls.is_public_target(F.col("x")), x=host) is public
    assert one(spark, urls.rate_class(F.col("x")), x=host) == (5 if public else None)


@pytest.mark.parametrize(("text", "ok"), [("10.0.0.0/8", True), ("10.0.0.0/33", False), ("::/0", True), ("a.b/8", False), ("1.2.3.4", True)])
def test_networks(spark, text, ok):
    assert one(spark, urls.is_valid_network(F.col("x")), x=text) is ok


@pytest.mark.parametrize(
    ("text", "iso"),
    [
        ("Sat Jul 19 08:23:11 CDT 2025", "2025-07-19 13:23:11"), ("Sat, 19 Jul 2025 13:23:10 GMT", "2025-07-19 13:23:10"), ("2025-06-28T22:44:56.069000Z", "2025-06-28 22:44:56.069"),
        ("2025-06-28T22:44:56.123456789+02:00", "2025-06-28 20:44:56.123456"), ("2025-06-28T22:44:56", "2025-06-28 22:44:56"), ("never", None),
    ],
)
def test_times(spark, text, iso):
    got = one(spark, values.parsed_time(F.col("x")).cast("string"), x=text)
    assert got == iso


@pytest.mark.parametrize(("mime", "kind"), [("", "default"), (None, "default"), ("application/ld+json", "json"), ("image/svg+xml", "xml"), ("text/html", "html"), ("text/plain", "default"), ("application/x-javascript", "javascript")])
def test_doc_types(spark, mime, kind):
    assert one(spark, values.doc_type_of(F.col("x")), x=mime) == kind


@pytest.mark.parametrize(
    ("content", "mime", "binary"),
    [("é" * 50, "", True), ("plain text with one é", "", False), (None, "", False), ("x", "image/png", True), ("x", "image/svg+xml", False), ("x", "application/pdf", True), ("é" * 9, "application/javascript", False), ("é" * 9, "a/b+json", False)],
)
def test_binary(spark, content, mime, binary):
    assert one(spark, values.is_binary(F.col("c"), F.col("m")), c=content, m=mime) is binary


def test_ids(spark):
    import hashlib

    assert one(spark, values.sha_id(F.col("x"), F.lit(None), F.lit("d")), x="u") == hashlib.sha256(b"u::d").hexdigest()
    assert one(spark, values.day_bucket(F.col("x")), x="2025-07-19T08:23:11-05:00") == "2025-07-19T"
    headers = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in (("Vary", "b"), ("X", "n"), ("ETag", "a"))])
    assert one(spark, values.cache_key(headers)) == "b,a"
    assert one(spark, values.title_case(F.col("x")), x="content-type") == "Content-Type"


def test_lists_and_maps(spark):
    assert one(spark, values.list_column(F.col("x")), x="a, b,,c") == ["a", " b", "", "c"]
    assert one(spark, values.list_column(F.col("x"), "int"), x="1, 2,x") == [1, 2, None] and one(spark, values.list_column(F.col("x")), x="[a") == ["[a"]
    assert one(spark, values.list_column(F.col("x"), "int"), x='["1", "2"]') == [1, 2]
    assert one(spark, values.list_column(F.col("x")), x="") == []
    assert one(spark, values.map_column(F.col("x")), x='{"a": "b"}') == {"a": "b"}
    assert one(spark, values.map_column(F.col("x")), x="a=1, b = 2=3 , a=4") == {"b": "2=3", "a": "4"}
    assert one(spark, values.map_column(F.col("x")), x="a:1,b:2") == {"a": "1", "b": "2"}
    assert one(spark, values.map_column(F.col("x"), "~", ";"), x="a~1;b~2") == {"a": "1", "b": "2"}
    assert one(spark, values.map_column(F.col("x")), x=None) == {}
    assert one(spark, values.map_column(F.col("x")), x="{a=b,c=d}") == {"a": "b", "c": "d"} and one(spark, values.map_column(F.col("x")), x="{}") == {}
    assert one(spark, values.map_column(F.col("x")), x="plain") == {"plain": ""} and one(spark, values.map_column(F.col("x"), "~", ";"), x="a=1,b") == {"a": "1"}


@pytest.mark.parametrize(("spec", "ports"), [("443,80", [80, 443]), ("8000-8002, 80", [80, 8000, 8001, 8002]), ("70000,65535", [65535]), ("x,1", [1])])
def test_ports(spark, spec, ports):
    assert one(spark, values.expand_ports(F.col("x")), x=spec) == ports
    assert one(spark, values.expand_ports(F.col("x")), x="") is None and one(spark, values.expand_ports(F.col("x")), x=" , ") is None and one(spark, values.expand_ports(F.col("x")), x="70000") is None


def test_page_slice(spark):
    got = one(spark, values.page_slice(F.col("x"), 2, 3), x="abcdefgh")
    assert (got["text"], got["total_length"], got["has_more"]) == ("cde", 8, True)
    assert one(spark, values.page_slice(F.col("x"), 20, 3), x="abc")["text"] == ""


@pytest.mark.parametrize(
    ("text", "short"),
    [("This is a dup. This is a dup. This is a dup.", "This is a dup."), ("Go go", "Go go"), ("a a a a", "a"), ("x y z", "x y z"), ("see: a b a b c", "see: a b a b c"), ("pre one two! one two!", "pre one two!"), ("", ""), ("a b a b a", "a b a")],
)
def test_collapse(spark, text, short):
    assert values.collapse_text(text) == short
    assert one(spark, values.collapse_repeats(F.col("x")), x=text) == short


def test_scrub_and_text(spark):
    assert one(spark, values.scrubbed(F.col("x")), x="at 2025-01-02 03:04:05 id " + "a1" * 16 + " ok") == "at <NUMERIC_TOKEN> id <NUMERIC_TOKEN> ok"
    assert one(spark, values.plain_text(F.col("x")), x="\n a \t b\n\n\nﬁ \n") == "a b\nfi"


def test_port_sets(spark):
    a, b = values.expand_ports(F.lit("80,443,8080")), values.expand_ports(F.lit("443,8080,9"))
    assert one(spark, values.common_ports(a, b), x="") == [443, 8080]
    assert one(spark, values.covers_ports(values.expand_ports(F.lit("443")), b), x="") and not one(spark, values.covers_ports(a, b), x="")
    assert one(spark, values.covers_ports(a, values.expand_ports(F.lit(""))), x="")


def test_collapse_matches_brute_force():
    import random

    def brute(words):
        n = len(words)
        for i in range(n):
            for k in range(1, (n - i) // 2 + 1):
                if (n - i) % k == 0 and words[i : i + k] == words[i + k : i + 2 * k]:
                    return words[: i + k] if words[i:] == words[i : i + k] * ((n - i) // k) else words
        return words

    rng = random.Random(5)
    for _ in range(3000):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 14))]
        words = words + words[-rng.randrange(1, 4) :] * rng.randrange(0, 4) if words else words
        assert values.collapse_text(" ".join(words)).split() == brute(words)
    assert len(values.collapse_text("x y z " * 200_000)) == 5 and values.collapse_text(" ".join(map(str, range(300_000)))).endswith("299999")


def test_a_url_is_parsed_once_a_row(spark):
    rows = urls.with_url_facts(spark.createDataFrame([("http://a.example.com/x",)], "url string")).select("host", "port", "netloc", "path", "query")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and "regexp" not in plan.split("Generate inline")[0]
