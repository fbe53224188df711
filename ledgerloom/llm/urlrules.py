"""URL rules by a sort-merge range join with a sweep over nested prefixes.

A rule has a host and the beginning of a path.  It fits its host and all hosts below it when
the url's path starts with the rule's; the longest fitting rule (host and path together, then
the longer host) gives the verdict, and ``default`` where none fits.

Hosts are written from the top level down, ``com.example.www.``, so what a rule covers is an
interval of sorted keys, and the intervals of two rules are nested or apart.  Rule starts, rule
ends and urls are sorted together; a running sum of starts and ends is the depth of the stack,
and the rule at each depth of the stack is the last one that started there.  Two sweeps are
made: over hosts, which gives every rule host above a url, and over the paths of those hosts.
Rows are dealt to ranges of the sorted order, equal keys included, so a host or url that many
rows share does not stay in one task; a range takes over the stack of the ranges before it.

A url without ``://``, or null, has empty host and path.  Repeated rows are counted and come
out as often; a null page_id is a page like others; other columns are not read.  Rules with
the same host and path count once, a block before an allow.  No rules, no pages: the default
everywhere, and an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import table, written

DEFAULT = "allow"
# Rules of the registered query: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, POINT, END = 0, 1, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """Labels from the top level down, each with its dot: a host below adds to the key."""
    labels = F.reverse(F.split(host, r"\."))
    return F.concat(F.array_join(labels, "."), F.lit("."))


def _bytes(key: Column) -> Column:
    return F.encode(key, "utf-8")


def sweep(points: DataFrame, rules: DataFrame, whole_stack: bool) -> DataFrame:
    """Rules whose key begins a point's key.

    ``points`` has key and p, ``rules`` has key (unique) and r.  The result has p, depth and r:
    one row per point and rule of its stack, or of its top only; depth 0, without a rule, is
    given for each point when the whole stack is asked for and else for those without rules.
    """
    none_r, none_p = (F.lit(None).cast(df.schema[c].dataType) for df, c in ((rules, "r"), (points, "p")))
    key = _bytes(F.col("key"))
    starts = rules.select(key.alias("key"), F.lit(START).alias("kind"), "r", none_p.alias("p"))
    # No text has a byte 255: this is behind all that begins with the key.
    after = F.concat(key, F.unhex(F.lit("FF")))
    ends = rules.select(after.alias("key"), F.lit(END).alias("kind"), none_r.alias("r"), none_p.alias("p"))
    urls = points.select(key.alias("key"), F.lit(POINT).alias("kind"), none_r.alias("r"), "p")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        starts.unionByName(ends)
        .unionByName(urls)
        .repartitionByRange(n, "key", "kind", "p")
        .withColumn("range", F.spark_partition_id())
        .withColumn("step", F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0))
    )
    dealt = written(dealt, "swept")
    so_far = Window.partitionBy("range").orderBy("key", "kind", "p")
    running = F.sum("step").over(so_far.rowsBetween(Window.unboundedPreceding, 0))

    # What a range takes over: the depth, and at each depth the last rule that started there.
    marks = dealt.where(F.col("kind") != POINT)
    net = marks.groupBy("range").agg(F.sum("step").alias("net"))
    ranges = dealt.select("range").distinct().join(net, "range", "left")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "range", F.coalesce(F.sum(F.coalesce("net", F.lit(0))).over(earlier), F.lit(0)).alias("base")
    )
    ranges = written(ranges, "ranges")
    opened = (
        marks.withColumn("local", running)
        .where(F.col("kind") == START)
        .join(ranges, "range")
        .select("range", "key", "r", (F.col("local") + F.col("base")).alias("depth"))
    )
    opened = written(opened, "opened")
    last = opened.groupBy("range", "depth").agg(F.max_by("r", "key").alias("r"))
    asked = ranges.where("base > 0").select(
        "range", F.explode(F.sequence(F.lit(1).cast("long"), "base")).alias("depth"), none_r.alias("r")
    )
    both = asked.withColumn("asks", F.lit(0)).unionByName(last.withColumn("asks", F.lit(1)))
    before = Window.partitionBy("depth").orderBy("range", "asks")
    carried = both.withColumn("r", F.last("r", ignorenulls=True).over(before)).where("asks = 0")

    deep = (
        dealt.withColumn("local", running)
        .where(F.col("kind") == POINT)
        .join(ranges, "range")
        .withColumn("depth", F.col("local") + F.col("base"))
    )
    if whole_stack:
        deep = deep.withColumn("depth", F.explode(F.sequence(F.lit(0).cast("long"), "depth")))
    stack = (
        carried.select("range", "depth", _bytes(F.lit("")).alias("key"), F.lit(START).alias("kind"), "r", none_p.alias("p"))
        .unionByName(opened.select("range", "depth", "key", F.lit(START).alias("kind"), "r", none_p.alias("p")))
        .unionByName(deep.select("range", "depth", "key", "kind", none_r.alias("r"), "p"))
    )
    at_depth = Window.partitionBy("range", "depth").orderBy("key", "kind", "p")
    return (
        stack.withColumn("r", F.last("r", ignorenulls=True).over(at_depth))
        .where(F.col("kind") == POINT)
        .select("p", "depth", "r")
    )


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``rules`` has host, path, verdict."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = written(seen.groupBy("page_id", "host", "path").agg(F.count("*").alias("n")), "urls")

    length = F.length("host") + F.length("path")
    unique = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    unique = unique.withColumn("host_key", host_key(F.col("host")))
    unique = written(unique.withColumn("length", length), "rules")
    hosts = unique.select(F.col("host_key").alias("key")).distinct()
    point = F.struct("page_id", "host", "path", "n")
    by_host = sweep(
        seen.select(host_key(F.col("host")).alias("key"), point.alias("p")),
        hosts.select("key", F.col("key").alias("r")),
        whole_stack=True,
    )
    by_host = written(by_host, "hosts")
    # A host has no slash, so no path of one rule host begins a key of another.
    slash = F.lit("/")
    found = sweep(
        by_host.where("r IS NOT NULL").select(F.concat("r", slash, "p.path").alias("key"), "p"),
        unique.select(
            F.concat("host_key", slash, "path").alias("key"),
            F.struct(
                "length",
                F.length("host").alias("host_length"),
                F.concat("host", "path").alias("rule"),
                "verdict",
            ).alias("r"),
        ),
        whole_stack=False,
    )
    every = found.select("p", "r").unionByName(
        by_host.where("r IS NULL").select("p", F.lit(None).cast(found.schema["r"].dataType).alias("r"))
    )
    # Two rules that fit and are of equal length have hosts of different length.
    better = F.struct("r.length", "r.host_length")
    best = every.groupBy("p").agg(F.max_by("r", F.when(F.col("r").isNotNull(), better)).alias("r"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "p.n"))
    return best.select("p", "r", copies.alias("copy")).select(
        "p.page_id",
        "p.host",
        "p.path",
        "r.rule",
        F.coalesce("r.verdict", F.lit(default)).alias("verdict"),
    )


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judged(table(spark, sf_dir, "pages"), rules)


def oracle() -> str:
    """The same verdicts in SQL."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
    WITH rules(rule_host, rule_path, verdict) AS (VALUES {values}),
    cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0
              THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, row_number() OVER () AS nr,
              translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    fits AS (SELECT nr, rule_host || rule_path AS rule, verdict,
             row_number() OVER (PARTITION BY nr
               ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS best
             FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
              AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict
    FROM parts LEFT JOIN (SELECT * FROM fits WHERE best = 1) USING (nr)
    """
