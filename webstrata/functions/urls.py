"""Column steps for URLs, hosts and targets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default port by scheme.
DEFAULT_PORTS = {
    "http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "ftps": 990, "ssh": 22, "sftp": 22, "ldap": 389, "ldaps": 636,
    "smtp": 25, "smtps": 465, "imap": 143, "imaps": 993, "pop3": 110, "pop3s": 995,
}
IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
IPV6 = r"^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$"
HOSTNAME = r"^(?=.{1,253}$)[A-Za-z0-9_]([A-Za-z0-9_-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9_]([A-Za-z0-9_-]{0,61}[A-Za-z0-9])?)*\.?$"
#: Suffixes of more than one label that we know of; a bigger table may be given to ``with_domain``.
KNOWN_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "com.br", "com.mx", "co.in", "co.za", "com.cn", "com.tr", "github.io", "herokuapp.com", "blogspot.com")


def _group(text: Column, pattern: str, group: int) -> Column:
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


def default_port(scheme: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, port in DEFAULT_PORTS.items():
        out = F.when(scheme == name, F.lit(port)).otherwise(out)
    return out


def url_struct(url: Column) -> Column:
    """Struct of scheme, host, port, netloc, path, query, fragment; null where the URL is not valid.

    The host is lower-cased; the port is explicit or the scheme's; netloc is host:port, with IPv6
    in brackets, or the host alone where no port is known.
    """
    text = F.trim(url)
    host = F.lower(F.try_parse_url(text, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(text, F.lit("PROTOCOL")))
    explicit = _group(F.try_parse_url(text, F.lit("AUTHORITY")), r":(\d{1,5})$", 1).cast("int")
    port = F.coalesce(F.when(explicit.between(1, 65535), explicit), F.when(explicit.isNull() | (explicit == 0), default_port(scheme)))
    bare = F.regexp_replace(host, r"[\[\]]", "")
    valid = host.isNotNull() & scheme.isNotNull() & (bare.rlike(HOSTNAME) | bare.rlike(IPV6)) & ~text.rlike(r"\s")
    facts = F.struct(
        scheme.alias("scheme"),
        bare.alias("host"),
        port.alias("port"),
        F.when(port.isNull(), bare).otherwise(F.concat(host, F.lit(":"), port.cast("string"))).alias("netloc"),
        F.coalesce(F.try_parse_url(text, F.lit("PATH")), F.lit("")).alias("path"),
        F.try_parse_url(text, F.lit("QUERY")).alias("query"),
        F.try_parse_url(text, F.lit("REF")).alias("fragment"),
    )
    return F.when(valid, facts)


def with_url_facts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add scheme, host, port, netloc, path, query, fragment; nulls where the URL is not valid."""
    facts = df.select("*", F.inline(F.array(F.struct(url_struct(F.col(url)).alias("_facts")))))  # a generator: parsed once a row
    names = ("scheme", "host", "port", "netloc", "path", "query", "fragment")
    return facts.withColumns({n: F.col("_facts").getField(n) for n in names}).drop("_facts")


def is_ip(host: Column) -> Column:
    return host.rlike(IPV4) | host.rlike(IPV6)


def is_valid_host(host: Column) -> Column:
    """localhost, an IP address, or a dotted name whose last label is no number."""
    return F.coalesce(is_ip(host) | (host == "localhost") | (host.rlike(HOSTNAME) & host.contains(".") & ~host.rlike(r"\.\d+\.?$")), F.lit(False))


def is_valid_network(text: Column) -> Column:
    """An IP address, or one with a prefix length."""
    address, bits = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
    size = bits.try_cast("int")
    fits = (~text.contains("/")) | (size.between(0, 32) & address.rlike(IPV4)) | (size.between(0, 128) & address.rlike(IPV6))
    return F.coalesce(is_ip(address) & fits, F.lit(False))


def domain_of(host: Column, suffixes: Iterable[str] = KNOWN_SUFFIXES) -> Column:
    """Registrable domain: '' for an IP, else the label before the longest known suffix with it.

    Without a known suffix the last two labels are taken.
    """
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
    return F.when(host.isNull(), F.lit(None)).when(is_ip(host), F.lit("")).when(last(2).isin(*suffixes), last(3)).otherwise(last(2))


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a public-suffix file (suffix, private): names, '*.' and '!' rules; private ones stand after their section's mark."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"), F.col("_metadata.file_path").alias("file"))
    mark = text.filter(F.col("line").contains("BEGIN PRIVATE DOMAINS")).groupBy("file").agg(F.min("at").alias("mark"))
    rules = text.join(F.broadcast(mark), "file", "left").filter((F.trim("line") != "") & ~F.col("line").startswith("//"))
    return rules.select(F.lower(F.split_part(F.trim("line"), F.lit(" "), F.lit(1))).alias("suffix"), F.coalesce(F.col("at") > F.col("mark"), F.lit(False)).alias("private")).distinct()


def registrable(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """(host, domain): the label before each distinct host's public suffix, with it; hosts without one aren't given.

    A host's own ends meet the rules (column suffix) by equality, so the table may be of any size: as
    they are, with their first label as '*', and after '!'.  An exception wins, else the longest match.
    """
    each = hosts.select(F.lower(host).alias("host")).filter(F.col("host").isNotNull() & ~is_ip(F.col("host"))).distinct().withColumn("_l", F.split("host", r"\."))
    tail = lambda i: F.array_join(F.slice("_l", i, F.size("_l")), ".")
    keys = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_l")), lambda i: F.array(
        F.struct(tail(i).alias("suffix"), i.alias("from"), F.lit(1).alias("weak")),
        F.struct(F.concat(F.lit("*."), tail(i + 1)).alias("suffix"), i.alias("from"), F.lit(1).alias("weak")),
        F.struct(F.concat(F.lit("!"), tail(i)).alias("suffix"), (i + 1).alias("from"), F.lit(0).alias("weak")),
    )))
    met = each.select("host", "_l", F.explode(keys).alias("k")).select("host", "_l", "k.*").join(rules.select("suffix").distinct(), "suffix")
    best = met.groupBy("host").agg(F.min(F.struct("weak", "from", "_l")).alias("b")).filter("b.from > 1")
    return best.select("host", F.array_join(F.slice("b._l", F.col("b.from") - 1, F.size("b._l")), ".").alias("domain"))


def with_domain(df: DataFrame, host: str = "host", suffixes: DataFrame | None = None, out: str = "domain") -> DataFrame:
    """Add the registrable domain; with a table of rules (column suffix, see ``registrable``) these decide.

    '' for an IP address; the last two labels where there is no registrable domain.
    """
    if suffixes is None:
        return df.withColumn(out, domain_of(F.col(host)))
    known = registrable(df, suffixes, host).select(F.col("host").alias("_host"), F.col("domain").alias("_known"))
    joined = df.join(known, F.lower(df[host]) == known["_host"], "left").drop("_host")
    return joined.withColumn(out, F.when(is_ip(F.col(host)), F.lit("")).otherwise(F.coalesce("_known", domain_of(F.col(host), ["-"])))).drop("_known")


def with_public_target(df: DataFrame, suffixes: DataFrame, host: str = "host", out: str = "is_public") -> DataFrame:
    """Add whether a host is a global IP address, or a name with a registrable domain under rules that are not private."""
    rules = suffixes.filter("NOT private") if "private" in suffixes.columns else suffixes
    known = registrable(df, rules, host).select(F.col("host").alias("_host"), F.lit(True).alias("_known"))
    joined = df.join(known, F.lower(df[host]) == known["_host"], "left").drop("_host")
    return joined.withColumn(out, F.when(is_ip(F.col(host)), is_public_target(F.col(host))).otherwise(F.coalesce("_known", F.lit(False)))).drop("_known")


def query_netloc(text: Column) -> Column:
    """Struct of host and port asked for: a URL, host:port, [v6]:port, or a host alone.

    A port that is not a number makes both null; one out of range makes the port null.
    """
    t = F.lower(F.trim(text))
    url = url_struct(t)
    head, tail = F.regexp_replace(F.regexp_extract(t, r"^(.*):([^:]*)$", 1), r"[\[\]]", ""), F.regexp_extract(t, r"^(.*):([^:]*)$", 2)
    number = tail.try_cast("int")
    named = F.when(number.isNotNull(), F.struct(head.alias("host"), F.when(number.between(0, 65535), number).alias("port")))
    nothing = F.struct(F.lit(None).cast("string").alias("host"), F.lit(None).cast("int").alias("port"))
    return (
        F.when(t.contains("://"), F.when(url.isNotNull(), F.struct(url["host"].alias("host"), url["port"].alias("port"))).otherwise(nothing))
        .when(t.contains(":"), F.coalesce(named, nothing))
        .otherwise(F.struct(t.alias("host"), F.lit(None).cast("int").alias("port")))
    )


def target_struct(text: Column) -> Column:
    """Struct of url, netloc, host, port, domain for a URL, host:port or host; null if invalid."""

    def build(parts: Column) -> Column:
        """parts: an array of (is_url, text, host, port, netloc); one element, or none if invalid."""
        return F.get(
            F.transform(
                parts,
                lambda p: F.struct(F.when(p["is_url"], p["text"]).alias("url"), p["netloc"].alias("netloc"), p["host"].alias("host"), p["port"].alias("port"), domain_of(p["host"]).alias("domain")),
            ),
            F.lit(0),
        )

    t = F.trim(text)
    whole = F.transform(F.filter(F.array(url_struct(t)), lambda u: u.isNotNull()), lambda u: F.struct(F.lit(True).alias("is_url"), t.alias("text"), u["host"].alias("host"), u["port"].alias("port"), u["netloc"].alias("netloc")))
    asked = F.filter(F.array(query_netloc(t)), lambda a: is_valid_host(a["host"]))

    def netloc(a: Column) -> Column:
        host = F.when(a["host"].rlike(IPV6), F.concat(F.lit("["), a["host"], F.lit("]"))).otherwise(a["host"])
        return F.when(a["port"].isNull(), a["host"]).otherwise(F.concat(host, F.lit(":"), a["port"].cast("string")))

    part = F.transform(asked, lambda a: F.struct(F.lit(False).alias("is_url"), t.alias("text"), a["host"].alias("host"), a["port"].alias("port"), netloc(a).alias("netloc")))
    return build(F.when(t.contains("://"), whole).otherwise(part))


def target_url(target: Column) -> Column:
    """The target's URL; else a scheme by port (443, 8443, ... mean https) before netloc or host."""
    secure = F.when(target["port"].isNotNull(), F.pmod(target["port"], F.lit(1000)) == 443).otherwise(target["domain"] != "")
    return F.coalesce(target["url"], F.concat(F.when(secure, "https://").otherwise("http://"), F.coalesce(target["netloc"], target["host"])))


def with_port(df: DataFrame, target: str = "target", port: Column | int | None = None) -> DataFrame:
    """Replace the port of each target; a target without any port becomes one for 80 and one for 443."""
    asked = F.lit(port).cast("int") if not isinstance(port, Column) else port
    ports = F.when(asked.isNotNull(), F.array(asked)).when(F.col(target)["port"].isNotNull(), F.array(F.col(target)["port"])).otherwise(F.array(F.lit(80), F.lit(443)))
    each = df.withColumn("_port", F.explode(ports))
    t = F.col(target)
    moved = F.concat(t["host"], F.lit(":"), F.col("_port").cast("string"))
    return each.withColumn(target, t.withField("port", F.col("_port")).withField("netloc", moved)).drop("_port")


def extract_targets(df: DataFrame, text: str, out: str = "target") -> DataFrame:
    """A row for each valid target among the words of a text, less one trailing mark of .!?:;"""
    words = F.transform(F.split(F.trim(F.col(text)), r"\s+"), lambda w: F.regexp_replace(w, r"[.!?:;]$", ""))
    return df.withColumn(out, F.explode(F.filter(F.transform(words, target_struct), lambda t: t.isNotNull())))


def url_variants(url: Column) -> Column:
    """Struct of prefix (for starts-with) and urls (for equality): without query, slash toggled."""
    base = F.split_part(url, F.lit("?"), F.lit(1))
    has_query = url.contains("?")
    other = F.when(base.endswith("/"), F.regexp_replace(base, "/$", "")).otherwise(F.concat(base, F.lit("/")))
    prefix = F.when(has_query, F.concat(base, F.lit("?"))).when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    full = F.struct(prefix.alias("prefix"), F.array_compact(F.array(url, F.when(has_query, base), other)).alias("urls"))
    empty = F.struct(F.lit("").alias("prefix"), F.array().cast("array<string>").alias("urls"))
    plain = F.struct(url.alias("prefix"), F.array(url).alias("urls"))
    return F.when(F.trim(url) == "", empty).when(~url.contains("://"), plain).otherwise(full)


def is_public_target(host: Column, suffixes: Iterable[str] = ("com", "org", "net", "io", "dev", "edu", "gov", "info", "de", "fr", "es", "uk", "eu", "us", "co.uk", "org.uk", "com.au", "co.jp")) -> Column:
    """A global IPv4 address, or a name with a label before a known public suffix."""
    octet = lambda n: F.split_part(host, F.lit("."), F.lit(n)).try_cast("int")
    a, b, c = octet(1), octet(2), octet(3)
    private = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    v6 = host.rlike(IPV6) & ~F.lower(host).rlike(r"^(::1?$|f[cd]|fe[89ab]|ff|2001:db8)")
    suffixes = tuple(suffixes)
    named = F.lit(False)
    for s in suffixes:
        named = named | (host.endswith("." + s) & (host != F.lit("www." + s)))
    return F.coalesce(F.when(host.rlike(IPV4), ~private).when(host.rlike(IPV6), v6).otherwise(named & ~host.isin(*suffixes)), F.lit(False))


def rate_class(host: Column) -> Column:
    """5 requests a second for public targets, null for others."""
    return F.when(is_public_target(host), F.lit(5))
