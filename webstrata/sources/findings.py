"""Readers of findings, scan observations and pattern files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.urls import is_valid_host, query_netloc, url_struct
from webstrata.sources.schema import SCANNER
from webstrata.sources.shared import lines_or_whole

PLAIN = "target string, targets array<string>, title string, markdown string"
#: Search-engine hints in a scanner's metadata.
QUERY_KEYS = ("shodan-query", "fofa-query", "google-query", "censys-query", "zoomeye-query", "hunter-query", "publicwww-query", "netlas-query", "binaryedge-query")
BODY_CHARS = 1024


def _listed(value: Column) -> Column:
    """A scalar or a JSON list as an array of strings."""
    split = F.when(F.trim(value).startswith("["), F.from_json(value, "array<string>")).when(F.trim(value) != "", F.array(F.trim(value)))
    return F.coalesce(split, F.array().cast("array<string>"))


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n\x0b\x0c"))


def _valid_target(text: Column) -> Column:
    return F.coalesce(F.when(text.contains("://"), url_struct(text).isNotNull()).otherwise(is_valid_host(query_netloc(text)["host"])), F.lit(False))


def split_items(texts: DataFrame, value: str = "value") -> DataFrame:
    """One JSON object a row from texts that hold an object, an array, or a line for each object."""
    t = F.trim(F.col(value))
    first = F.from_json(F.split_part(t, F.lit("\n"), F.lit(1)), "map<string,string>")
    whole = F.when(F.size(F.map_keys(F.coalesce(first, F.create_map().cast("map<string,string>")))) == 0, F.from_json(t, "map<string,string>"))
    many = F.from_json(t, "array<map<string,string>>").isNotNull() & t.startswith("[")
    objects = F.when(many, F.transform(F.from_json(t, "array<variant>"), lambda v: F.to_json(v))).when(whole.isNotNull() & (F.size(F.map_keys(whole)) > 0), F.array(t)).otherwise(F.filter(F.split(t, r"\r?\n"), lambda x: F.trim(x) != ""))
    return texts.select(F.explode(objects).alias("item"))


def parse_findings(items: DataFrame, item: str = "item") -> tuple[DataFrame, DataFrame]:
    """Findings (target, title, markdown) and rejects; scanner objects are normalized first.

    A scanner object holds template-id and info.  Others need a valid target among target or
    targets, and markdown.
    """
    keys = F.json_object_keys(item)
    scanner = F.coalesce(F.array_contains(keys, "template-id") & F.array_contains(keys, "info"), F.lit(False))
    plain = items.filter(~scanner).withColumn("_j", F.from_json(item, PLAIN))
    j = F.col("_j")
    targets = F.filter(F.transform(F.coalesce(j["targets"], F.array(j["target"])), _stripped), _valid_target)
    plain = plain.select(F.col(item).alias("item"), F.get(targets, F.lit(0)).alias("target"), targets.alias("targets"), _stripped(j["title"]).alias("title"), _stripped(j["markdown"]).alias("markdown"))
    ok = F.coalesce((F.size("targets") > 0) & (F.col("markdown") != ""), F.lit(False))
    normal = normalize_scanner_findings(items.filter(scanner), item).select("item", F.get("targets", F.lit(0)).alias("target"), "targets", "title", "markdown")
    both = plain.unionByName(normal)
    return both.filter(ok).drop("item"), both.filter(~ok).select("item", F.lit("no valid target or no text").alias("reason"))


def normalize_scanner_findings(items: DataFrame, item: str = "item") -> DataFrame:
    """title, severity, type, template, targets (ordered), classification rows, and markdown."""
    j = F.col("_j")
    got = items.withColumn("_j", F.from_json(item, SCANNER))
    info, cls = j["info"], j["info"]["classification"]
    port = j["port"].try_cast("int")
    standard = ((j["scheme"] == "http") & (port == 80)) | ((j["scheme"] == "https") & (port == 443))
    built = F.when(j["scheme"].isNotNull() & j["host"].isNotNull() & ~j["host"].contains("://"), F.concat(j["scheme"], F.lit("://"), j["host"], F.when(port.isNotNull() & ~F.coalesce(standard, F.lit(False)), F.concat(F.lit(":"), port.cast("string"))).otherwise("")))
    header = F.regexp_extract(j["request"], r"(?im)^Host:\s*(\S+)\s*$", 1)
    listed = F.array(j["matched-at"], j["url"])
    rest = F.array(built, F.concat(j["host"], F.lit(":"), port.cast("string")), j["host"], F.concat(j["ip"], F.lit(":"), port.cast("string")), j["ip"])
    some = lambda a: F.filter(F.array_distinct(F.array_compact(a)), lambda x: F.trim(x) != "")
    targets = F.when(F.size(some(listed)) > 0, some(listed)).when(F.size(some(rest)) > 0, some(rest)).otherwise(some(F.array(header)))
    target = F.get("targets", F.lit(0))
    got = got.withColumn("targets", targets)
    name = F.coalesce(F.when(F.trim(info["name"]) != "", info["name"]), F.when(F.trim(j["template-id"]) != "", j["template-id"]), F.lit("Finding"))
    title = F.when(target.isNotNull(), F.concat(name, F.lit(" on "), target)).otherwise(name)
    one = lambda kind, value: F.transform(_listed(value), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    cwe = F.transform(_listed(cls["cwe-id"]), lambda v: F.struct(F.lit("cwe").alias("kind"), F.regexp_extract(v, r"(\d+)", 1).alias("value")))
    hints = F.filter(F.transform(F.map_entries(F.coalesce(info["metadata"], F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("kind"), e["value"].alias("value"))), lambda e: e["kind"].isin(*QUERY_KEYS))
    rows = F.array_distinct(F.concat(one("cve", F.upper(cls["cve-id"])), cwe, one("cvss", cls["cvss-score"]), one("cvss-vector", cls["cvss-metrics"]), one("epss", cls["epss-score"].cast("string")), one("cpe", cls["cpe"]), one("reference", info["reference"]), hints))
    clip = lambda label, body: F.when(F.trim(body) != "", F.concat(F.lit(f"\n### {label}\n\n```\n"), F.when(body.rlike(r"(?i)content-type:\s*(image|audio|video|font)/|application/octet-stream"), F.regexp_extract(body, r"(?s)^(.*?)(\r?\n\r?\n|$)", 1)).otherwise(F.substring(body, 1, BODY_CHARS)), F.lit("\n```\n")))
    part = lambda label, text: F.when(F.trim(text) != "", F.concat(F.lit(f"\n## {label}\n\n"), F.trim(text), F.lit("\n")))
    severity = F.initcap(F.coalesce(F.when(F.trim(info["severity"]) != "", info["severity"]), F.lit("info")))
    markdown = F.concat_ws(
        "",
        F.concat(F.lit("# "), title, F.lit("\n")),
        part("Summary", F.concat_ws("\n", F.concat(F.lit("Severity: "), severity), info["description"])),
        part("How it was found", F.concat_ws("\n", F.concat(F.lit("Template: "), j["template-id"]), F.concat(F.lit("Matcher: "), j["matcher-name"]), F.concat(F.lit("Extracted: "), F.array_join(_listed(j["extracted-results"]), ", ")))),
        part("How to repeat it", j["curl-command"]),
        clip("Request", j["request"]),
        clip("Response", j["response"]),
        part("Fix", info["remediation"]),
        part("References", F.array_join(_listed(info["reference"]), "\n")),
    )
    return got.select(F.col(item).alias("item"), title.alias("title"), severity.alias("severity"), j["type"].alias("type"), j["template-id"].alias("template"), "targets", rows.alias("classification"), markdown.alias("markdown"))


def classification_rows(findings: DataFrame) -> DataFrame:
    """A row for each classification entry of normalized scanner findings."""
    return findings.select("template", "title", F.explode("classification").alias("c")).select("template", "title", "c.kind", "c.value")


def read_findings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Findings of files of lines (an object each), or of files that hold one object or an array."""
    return parse_findings(split_items(lines_or_whole(spark, path)))


HOST_XML = (
    "address array<struct<_addr:string,_addrtype:string>>, hostnames struct<hostname:array<struct<_name:string>>>, "
    "ports struct<port:array<struct<_portid:int,_protocol:string,state:struct<_state:string>,service:struct<_name:string>,script:array<struct<_id:string,_output:string>>>>>"
)


def read_scan_xml(spark: SparkSession, path: str, ts: Column, targets: str = "", ports: str = "") -> tuple[DataFrame, DataFrame]:
    """(scan_runs, scan_ports) of scan XML files; the file's name is the run's id.

    A row for each address and port; a run is kept only if some port was found.
    """
    hosts = spark.read.format("xml").option("rowTag", "host").schema(HOST_XML).load(path).withColumn("run_id", F.input_file_name())
    each = hosts.select("run_id", F.coalesce(F.get("hostnames.hostname", F.lit(0))["_name"], F.lit("")).alias("hostname"), F.explode("address").alias("a"), "ports")
    each = each.select("run_id", "hostname", F.col("a._addr").alias("ip_address"), F.explode("ports.port").alias("p"))
    notes = F.array_join(F.transform(F.coalesce(F.col("p.script"), F.array().cast("array<struct<_id:string,_output:string>>")), lambda s: F.coalesce(s["_output"], F.lit(""))), "\n")
    found = each.select(
        "run_id", ts.cast("timestamp").alias("ts"), "hostname", "ip_address", F.concat("ip_address", F.lit(":"), F.col("p._portid").cast("string")).alias("netloc"), F.col("p._portid").alias("port"),
        F.coalesce("p.state._state", F.lit("unknown")).alias("state"), F.col("p.service._name").alias("service_name"), notes.alias("service_notes"),
    )
    runs = found.groupBy("run_id", "ts").agg(F.max(F.col("service_notes").contains("ERROR: Script execution failed")).alias("has_error")).select("run_id", "ts", F.lit(targets).alias("targets"), F.lit(ports).alias("ports"), "has_error")
    return runs, found


def read_patterns(spark: SparkSession, directory: str) -> DataFrame:
    """(label, doc_type, pattern) of files <label>_<doctype>.txt: blocks between lines of ---- or ====."""
    files = spark.read.text(directory, wholetext=True, pathGlobFilter="*_*.txt").select("value", F.col("_metadata.file_name").alias("file"))
    stem = F.regexp_replace("file", r"\.txt$", "")
    blocks = F.split("value", r"(?m)\s*(-{4,}|={4,})\s*$")
    each = files.select(F.regexp_extract(stem, r"^(.*)_([^_]*)$", 1).alias("label"), F.regexp_extract(stem, r"^(.*)_([^_]*)$", 2).alias("doc_type"), F.explode(blocks).alias("pattern"))
    return each.withColumn("pattern", F.trim(F.regexp_replace("pattern", r"^\s+|\s+$", ""))).filter("pattern <> ''").distinct()
