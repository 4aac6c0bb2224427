"""URL allow and block rules by hash-prefix lookup (DataFrame functions only).

Every distinct (host, path) of the table is judged once.  It is expanded into
host suffixes (at label borders) times path prefixes (of the lengths that rule
paths have); each expression is hashed, an equi-join on the first
``PREFIX_HEX`` hex digits finds candidate rules, the full SHA-256 confirms
them, and of the rules that fit the longest string wins (then the longer host;
at a full tie block beats allow).  Grouping first means that a host with a
third of all rows is expanded once per distinct path, and the join back to the
pages is a sort-merge join whose large partitions AQE may split.

The number of rules is counted: up to ``BROADCAST_RULES`` their table is
broadcast, beyond that the same equi-join runs as a shuffled join.

Defined cases: a null url, or one without ``://``, has empty host and path and
gets the default verdict (``allow``); empty rule tables give the default
everywhere; repeated pages are judged each; other columns are ignored; null
rule fields count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_HEX = 8
BROADCAST_RULES = 20_000
DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
RULE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("verdict", "host", "path")])


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def expressions(lengths: list[int]) -> Column:
    """Host suffixes times path prefixes of the row's ``host`` and ``path``, as host followed by path."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.col("path").substr(F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(F.concat(s, p).alias("expr")))))


def url_filter(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("_url"))
    urls = pages.select("page_id", F.coalesce("url", F.lit("")).alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    clean = rules.select("verdict", *[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path")])
    clean = clean.select("verdict", F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
    clean = clean.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("digest", F.sha2("rule", 256))
    found = clean.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("rule_path")).alias("lengths")).first()  # lengths: bounded by the longest path
    table = clean.select(F.substring("digest", 1, PREFIX_HEX).alias("prefix"), "digest", "rule", F.length("rule_host").alias("host_len"), "verdict")
    if found["n"] <= BROADCAST_RULES:
        table = F.broadcast(table)
    judged = (
        urls.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(expressions(sorted(found["lengths"]))).alias("e"))
        .select("host", "path", F.sha2("e.expr", 256).alias("own"))
        .withColumn("prefix", F.substring("own", 1, PREFIX_HEX))
        .join(table, "prefix")
        .filter("own = digest")
        .groupBy(F.col("host").alias("_h"), F.col("path").alias("_p"))
        .agg(F.max(F.struct(F.length("rule").alias("n"), "host_len", F.col("verdict").alias("verdict"), "rule")).alias("best"))
    )
    return urls.join(judged, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict")
    )


ORACLE_SQL = """
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'),
       ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hit AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict,
       row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hit WHERE k = 1
"""
