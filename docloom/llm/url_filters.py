"""URL filters: host rules and pattern rules, fetched by index.

Pattern rules are written with ``*`` (anything), ``^`` (a separator or the end), ``||`` at the start (the
start of the host or of one of its labels), ``|`` at either end (that end of the URL) and ``@@`` at the
start (an exception). Each rule is indexed by its rarest literal token, where tokens are runs of ASCII
letters and digits and rarity is counted over all URLs at hand; a URL's tokens fetch candidate rules by an
equi-join, and regular expressions run on candidates only. Rules without a token that must be whole in
the URL are candidates of every URL. A URL is blocked if a rule matches it and no exception does.

Host rules are fetched by the host's suffixes in the same way; the longest one that fits decides, else
the patterns do.

A verdict depends on the URL alone, so distinct URLs are judged, and rows fetch their URL's verdict. Rule
tables are broadcast up to ``BROADCAST_RULES`` rows and joined by a shuffle beyond that.

Defined results: null URLs and URLs without ``://`` have an empty host and path, fit no host rule, and
patterns see the URL as it is (null: no match, so allow). Ties of length between host rules: the
greatest rule string, block before allow. Rows that repeat give as many rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BROADCAST_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path)
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
PATTERNS = (
    "||spam-farm.",
    "||cheap-pills.",
    "||casino^",
    "||ads.*^",
    "/adserver/*",
    "/banner^*.gif",
    "*free-download*",
    "&affiliate_id=",
    "?clickid=",
    "^popunder^",
    "-sponsored-",
    "||tracker.",
    "/wp-login.php|",
    "|ftp://",
    "^doubleclick^",
    "/de/*.html|",
    "@@||www.spam-farm.*/en/",
    "@@/adserver/policy.html|",
)
_SEPARATOR = r"(?:[^0-9a-z_.%\-]|$)"


def pattern_regex(rule: str) -> str:
    """The rule as a regular expression for lower-case URLs, in syntax that Java and RE2 share."""
    body = rule.removeprefix("@@").lower()
    head = tail = ""
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    special = {"*": r"[\s\S]*", "^": _SEPARATOR}
    return head + "".join(special.get(c) or (c if c.isalnum() else f"\\{c}") for c in body) + tail


def pattern_tokens(rule: str) -> list[str]:
    """Literal tokens of the rule that are whole tokens of every URL that it matches."""
    body = rule.removeprefix("@@").lower()
    head, tail = body.startswith("|"), body.endswith("|")
    body = body.strip("|")
    out = []
    for m in re.finditer(r"[a-z0-9]+", body):
        left = body[m.start() - 1] != "*" if m.start() else head
        right = body[m.end()] != "*" if m.end() < len(body) else tail
        if left and right:
            out.append(m.group())
    return sorted(set(out))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def with_parts(urls: DataFrame) -> DataFrame:
    """The rows with host and path of their url."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    out = urls.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumn("_host", F.regexp_extract("_rest", r"^([^/?#]*)", 1))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^([^?#]*)", 1)
    return out.withColumns({"host": ascii_lower(F.col("_host")), "path": path}).drop("_rest", "_host")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_RULES else df


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(url), F.lit("[a-z0-9]+"), F.lit(0)))


def pattern_index(urls: DataFrame, patterns) -> DataFrame:
    """token, regex, exception: each rule under its rarest token among ``urls`` ('' if it has none)."""
    spark: SparkSession = urls.sparkSession
    rows = [(i, p, pattern_regex(p), p.startswith("@@"), t) for i, p in enumerate(dict.fromkeys(patterns)) for t in pattern_tokens(p) or [""]]
    rules = spark.createDataFrame(rows, "rule int, pattern string, regex string, exception boolean, token string")
    wanted = _small(rules.select("token").distinct(), len(rows))
    seen = urls.select(F.explode(_tokens(F.col("url"))).alias("token")).join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counted = rules.join(seen, "token", "left").groupBy("rule", "pattern", "regex", "exception")
    return counted.agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")).select("token", "pattern", "regex", "exception")


def url_filters(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """A row for each page: page_id, host, path, rule (host rule or null), verdict, pattern (that blocked, or null)."""
    spark = pages.sparkSession
    page = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = page.select("url").filter("url is not null").distinct()

    hosts = spark.createDataFrame([(h, p, h + p, a) for a, h, p in host_rules] or [], "_suffix string, _path string, rule string, action string")
    n = F.size("_labels")
    by_host = (
        with_parts(urls)
        .select("url", "path", F.split("host", r"\.", -1).alias("_labels"))
        .select("url", "path", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("_labels", i, n), "."))).alias("_suffix"))
        .join(_small(hosts, len(host_rules)), "_suffix")
        .filter(F.startswith("path", F.col("_path")))
        .groupBy("url")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("_fit"))
        .select("url", "_fit.rule", "_fit.action")
    )
    index = pattern_index(urls, patterns)
    by_pattern = (
        urls.select("url", F.explode(F.concat(_tokens(F.col("url")), F.array(F.lit("")))).alias("token"))
        .join(_small(index, len(patterns)), "token")
        .filter(F.rlike(ascii_lower(F.col("url")), F.col("regex")))
        .groupBy("url")
        .agg(F.bool_or("exception").alias("_excepted"), F.min(F.when(~F.col("exception"), F.col("pattern"))).alias("pattern"))
    )
    judged = urls.join(by_host, "url", "left").join(by_pattern, "url", "left").select("url", "rule", "action", "pattern", "_excepted")
    blocked = F.col("pattern").isNotNull() & ~F.coalesce("_excepted", F.lit(False))
    return with_parts(page.join(judged, "url", "left")).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.when(blocked, F.col("pattern")).alias("pattern"),
    )


def oracle(host_rules=HOST_RULES, patterns=PATTERNS) -> str:
    """The same result in DuckDB SQL, every URL against every rule."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    hosts = ", ".join(f"({quoted(h)}, {quoted(p)}, {quoted(h + p)}, {quoted(a)})" for a, h, p in host_rules)
    rules = ", ".join(f"({quoted(p)}, {quoted(pattern_regex(p))}, {str(p.startswith('@@')).lower()})" for p in dict.fromkeys(patterns))
    return f"""
WITH hosts(h, p, rule, action) AS (VALUES {hosts}),
rules(pattern, regex, exception) AS (VALUES {rules}),
rest AS (SELECT rowid AS id, page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM (SELECT row_number() OVER () AS rowid, * FROM pages)),
parts AS (
  SELECT id, page_id, url, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT id, rule, action FROM parts JOIN hosts ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(rule) DESC, rule DESC, action DESC) = 1),
hits AS (
  SELECT id, bool_or(exception) AS excepted, min(pattern) FILTER (WHERE NOT exception) AS pattern
  FROM parts JOIN rules ON regexp_matches(lower(url), regex) GROUP BY id)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN pattern IS NOT NULL AND NOT excepted THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN pattern IS NOT NULL AND NOT excepted THEN pattern END AS pattern
FROM parts LEFT JOIN fits USING (id) LEFT JOIN hits USING (id)"""
