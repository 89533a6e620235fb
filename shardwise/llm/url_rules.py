"""URL filters as a sort-merge range join.

A url gets one canonical key for each domain that contains its host: the domain's labels in reverse
order, a separator, and the path. A rule on (host, path) then fits exactly the keys that start with its own
key, an interval of the sorted keys; intervals of rules are nested or disjoint. Rules' interval starts and
ends are sorted together with the url keys, and one sweep over each block of the sorted keys keeps the
stack of active rules: slot d of the stack holds the rule that was opened last at depth d, and the number of
opened less closed intervals tells the top. Of the domains of one url, the rule of the longest key wins.

Scale: equal keys are swept once; blocks come from a range partitioning of the keys by Spark's own sampling, so
a host with a third of all urls is spread over many blocks by its paths. A rule whose interval spans
several blocks is opened in each; that costs at most one row a rule and block. What the driver
gets are the blocks' least keys (one string a partition) and the greatest depth of nesting.

Defined results: a null url, or one without "://", has empty host and path, fits no rule and gets the
default verdict. An empty table gives an empty table; repeated rows are judged alike; of rules that
are equal in host and path, `block` wins over `allow`. Rules with a null host, path or verdict
are left out; a rule with an empty host fits nothing. Only the named id and url columns are
read, so extra columns of any name do no harm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Between the reversed host and the path in a key; below every printable character.
SEPARATOR = "\x01"
#: Above every character of a url's key: closes a rule's interval.
AFTER_ALL = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without "://"."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(reversed_labels(host), "."), F.lit(SEPARATOR), path)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each row of urls. `rules` has the columns host, path and verdict; `default` is the verdict of urls without a rule."""
    host, path = host_and_path(F.col(url_col))
    pages = urls.select(id_col, host.alias("host"), path.alias("path"))
    partitions = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    rules = rules.where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(rule_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict")

    labels = reversed_labels(F.col("host"))
    places = pages.where("host <> ''").select("host", "path").distinct()
    probes = places.select(
        "host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(SEPARATOR), F.col("path")))).alias("key")
    )
    # The checkpoint fixes which block each key is in: the sweep and the blocks' bounds must agree, also after a lost executor.
    keys = probes.select("key").distinct().repartitionByRange(partitions, "key").withColumn("block", F.spark_partition_id())
    keys = _settled(keys)
    bounds = [r["low"] for r in keys.groupBy("block").agg(F.min("key").alias("low")).orderBy("block").collect()]
    blocks = [r["block"] for r in keys.select("block").distinct().orderBy("block").collect()]

    spans = rules.withColumn("end", F.concat("key", F.lit(AFTER_ALL)))
    lows = F.array(*(F.lit(b) for b in bounds)) if bounds else F.expr("CAST(array() AS array<string>)")
    ids = F.array(*(F.lit(b) for b in blocks)) if blocks else F.expr("CAST(array() AS array<int>)")
    first = F.greatest(F.size(F.filter(lows, lambda low: low <= F.col("key"))), F.lit(1))
    last = F.size(F.filter(lows, lambda low: low <= F.col("end")))
    spread = spans.where(last >= 1).withColumn("block", F.explode(F.transform(F.sequence(first, last), lambda n: F.element_at(ids, n))))
    opened = spread.select("block", "key", F.lit(1).alias("step"), "rule", "verdict")
    closed = spread.select("block", F.col("end").alias("key"), F.lit(-1).alias("step"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    marks = keys.select("block", "key", F.lit(0).alias("step"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))

    # At one key: open rules before the urls that equal them. Equal keys open one rule only, and an end equals no url's key.
    sweep = Window.partitionBy("block").orderBy("key", F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nested = opened.unionByName(closed).withColumn("depth", F.sum("step").over(sweep))
    deepest = nested.agg(F.max("depth").alias("d")).first()["d"] or 0
    swept = opened.unionByName(closed).unionByName(marks).withColumn("depth", F.sum("step").over(sweep))
    for d in range(1, deepest + 1):
        held = F.when((F.col("step") == 1) & (F.col("depth") == d), F.struct("rule", "verdict"))
        swept = swept.withColumn(f"slot{d}", F.last(held, ignorenulls=True).over(sweep))
    top = reduce(lambda rest, d: F.when(F.col("depth") == d, F.col(f"slot{d}")).otherwise(rest), range(1, deepest + 1), F.lit(None).cast("struct<rule:string,verdict:string>"))
    fits = swept.where("step = 0 AND depth > 0").select("key", top.alias("fit"))

    best = (
        probes.join(fits, "key")
        .groupBy("host", "path")
        .agg(F.max_by("fit", F.struct(F.length("fit.rule"), "fit.rule")).alias("fit"))
        .select(F.col("host").alias("h"), F.col("path").alias("p"), "fit")
    )
    return (
        pages.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
        .select(id_col, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
    )


def _settled(df: DataFrame) -> DataFrame:
    from shardwise.llm.storage import settled

    return settled(df)
