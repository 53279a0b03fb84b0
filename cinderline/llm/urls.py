"""Allow and block rules for URLs: a sort-merge range join on host suffixes and paths, in DataFrame operations only."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cinderline.llm.common import stored, table

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "verdict")])
#: The rules of the registered query.
QUERY_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _rest(url: Column) -> Column:
    return F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _nested_rules(rules: DataFrame) -> DataFrame:
    """Per rule its host, path and the stack that is active where it starts: itself and the rules it lies in."""
    rules = (
        rules.select("host", "path", "verdict").dropna(subset=["host", "path"])
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    )
    outer = rules.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("verdict").alias("__v"))
    prefixes = rules.select("host", "path", F.explode(F.expr("transform(sequence(0, length(path)), i -> left(path, i))")).alias("__p"))
    return (
        prefixes.join(outer, (F.col("host") == F.col("__h")) & (prefixes["__p"] == outer["__p"]))
        .groupBy("host", "path").agg(F.collect_list(F.struct(outer["__p"].alias("path"), F.col("__v").alias("verdict"))).alias("stack"))
    )


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Longest rule for each distinct ``(host, path)`` of ``urls``: ``host, path, rule, verdict``, matched rows only.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule (host and path
    together) wins, then the one with the longer host. Two rules of one host and path: ``block`` wins. Rules without host or
    path are ignored. Empty inputs give no rows.

    Each pair is written once for every host suffix that has rules (never more labels than the longest rule host), so
    what a rule covers is one interval of the order by suffix and path. Pairs and rules are range-partitioned together; a
    sweep in this order finds the last rule that began, whose stack holds all rules still open. The rule open
    at the start of each range comes from a table with one row per range.
    """
    spark = urls.sparkSession
    rules = _nested_rules(rules)
    hosts = rules.select(F.col("host").alias("suffix")).distinct()
    depth = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0
    pairs = urls.select("host", "path").filter("host != ''").distinct()
    keys = (
        pairs.withColumn("__l", F.split("host", r"\.", -1))
        .withColumn("suffix", F.explode(F.expr(f"transform(filter(sequence(1, size(__l)), k -> k <= {depth}), k -> array_join(slice(__l, -k, k), '.'))")))
        .select("host", "path", "suffix").join(hosts, "suffix")
        .select("host", "path", "suffix", F.lit(None).cast("array<struct<path:string,verdict:string>>").alias("stack"))
    )
    starts = rules.select(F.lit(None).cast("string").alias("host"), "path", F.col("host").alias("suffix"), "stack")
    ranges = stored(keys.unionByName(starts).repartitionByRange("suffix", "path").withColumn("range", F.spark_partition_id()), "url-ranges")
    ends = ranges.filter("stack is not null").groupBy("range").agg(F.max_by(F.struct("suffix", "stack"), F.struct("suffix", "path")).alias("last"))
    known = ranges.select("range").distinct().join(ends, "range", "left")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = known.select("range", F.last("last", ignorenulls=True).over(before).alias("carried"))
    order = Window.partitionBy("range").orderBy("suffix", "path", F.col("host").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    began = F.when(F.col("stack").isNotNull(), F.struct("suffix", "stack"))
    swept = (
        ranges.select("*", F.last(began, ignorenulls=True).over(order).alias("began")).filter("host is not null")
        .join(carried, "range").withColumn("open", F.coalesce("began", "carried"))
        .filter("open.suffix = suffix")
        .select("host", "path", F.expr(
            "filter(transform(open.stack, r -> struct(length(suffix) + length(r.path) as size, length(suffix) as hosts, "
            "concat(suffix, r.path) as rule, r.verdict as verdict, r.path as own)), r -> startswith(path, r.own))"
        ).alias("fits"))
        .filter("size(fits) > 0")
    )
    return (
        swept.groupBy("host", "path").agg(F.max(F.array_max("fits")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``; ``default`` where no rule fits.

    A null url, or one without ``://``, has an empty host and path and gets ``default``. Repeated rows are judged each;
    only ``page_id`` and ``url`` are read.
    """
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    found = match_rules(parts, rules)
    return parts.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(QUERY_RULES, RULES))


SQL = r"""
with rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                               ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as r from pages),
k as (select page_id, r, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select page_id, host, path, h || p as rule, v,
             row_number() over (partition by page_id order by length(h || p) desc nulls last, length(h) desc) as n
      from k left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where n = 1
"""
