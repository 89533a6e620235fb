"""Exact top-k search in binary codes by incremental multi-index hashing.

A code of m segments of 16 bits is listed in m tables, one by segment value. Round r probes each table with all values
at distance exactly r from the query's segment. After round r every code within distance m * (r + 1) - 1 has been
met: a code farther than r in all segments is at least m * (r + 1) away. A query's kth distance so far bounds what later rounds return. So a query is finished once its kth verified
distance is at most that; the others go on with the next radius. A code is kept only where it is first
met (no segment nearer than r, no earlier segment at r), so rounds never repeat a pair.

Scale: equal codes are one entry of the tables with their k smallest ids, which is all that a top-k with ties
broken by id can use, so a code that a third of all rows share is one entry. Equal queries are searched once.
The planner takes listed probes for as few as the queries they come from, and tables for as small as their compressed
files, so the joins of a round are told to be dealt by hash, and none is broadcast; the driver gets the number of
unfinished queries.

Defined results: ties in distance go to the smaller id; a query row is itself among the rows searched; a null
vector, or one of another length than `bits`, has no code: it is never found, and as a query gives no rows; a null
component counts as not positive; repeated rows count as often as they occur; fewer than k rows give fewer
results; an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwise.llm.storage import Tables, settled

SEGMENT = 16


def sign_code(vector: Column, bits: int) -> Column:
    """Segments of the code whose bits tell which components are positive; null for a vector that has no code."""
    def segment(j: int) -> Column:
        return F.aggregate(F.transform(F.slice(vector, j * SEGMENT + 1, SEGMENT), lambda x, i: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)) * F.element_at(_POWERS(), i + 1)), F.lit(0), lambda a, b: a + b)

    return F.when(F.size(vector) == bits, F.array(*(segment(j) for j in range(-(-bits // SEGMENT)))))


def _POWERS() -> Column:
    return F.array(*(F.lit(1 << i) for i in range(SEGMENT)))


def distance(a: Column, b: Column, segments: int) -> Column:
    return sum((_at(a, b, j) for j in range(1, segments)), _at(a, b, 0))


def _at(a: Column, b: Column, j: int) -> Column:
    return F.bit_count(a[j].bitwiseXOR(b[j]))


def masks(radius: int) -> list[int]:
    """All segment values with `radius` bits set."""
    return [v for v in range(1 << SEGMENT) if v.bit_count() == radius]


def search(rows: DataFrame, queries: DataFrame, k: int, bits: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k rows nearest to each row of queries, by distance, then id."""
    spark, segments = rows.sparkSession, -(-bits // SEGMENT)
    coded = rows.select(F.col(id_col).alias("id"), sign_code(F.col(vector_col), bits).alias("code")).where("code IS NOT NULL AND id IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    members = settled(coded.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    index = members.select("code", "ids", F.posexplode("code").alias("segment", "value"))
    asked = settled(queries.select(F.col(id_col).alias("query_id"), sign_code(F.col(vector_col), bits).alias("query")).where("query IS NOT NULL AND query_id IS NOT NULL"))
    active = settled(asked.select("query").distinct().withColumn("worst", F.lit(bits)))
    best = Window.partitionBy("query").orderBy("distance", "id")
    found = done = None
    tables = Tables(spark)
    for radius in range(SEGMENT + 1):
        probe = active.select("query", "worst", F.posexplode("query").alias("segment", "own")).withColumn("mask", F.explode(_mask_column(radius)))
        probe = probe.select("query", "worst", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        # A pair counts where it is first met, and only if it can still be among the k nearest.
        useful = distance(F.col("query"), F.col("code"), segments) <= F.col("worst")
        for j in range(segments):
            d = _at(F.col("query"), F.col("code"), j)
            useful &= (F.col("segment") == j) | F.when(F.col("segment") > j, d > radius).otherwise(d >= radius)
        met = probe.hint("merge").join(index, ["segment", "value"]).where(useful).select("query", F.explode("ids").alias("id"), distance(F.col("query"), F.col("code"), segments).alias("distance"))
        met = met if found is None else met.unionByName(found.hint("merge").join(active, "query", "left_semi"))
        found = tables.written(met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
        covered = segments * (radius + 1) - 1
        known = found.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("kth")).where(F.col("n") >= k).select("query", "kth")
        state = tables.written(active.hint("merge").join(known, "query", "left").select("query", F.coalesce("kth", F.lit(bits)).alias("worst"), (F.coalesce(F.col("kth") <= covered, F.lit(False)) | F.lit(radius == SEGMENT)).alias("finished")))
        ended = found.hint("merge").join(state.where("finished").select("query"), "query", "left_semi")
        done = ended if done is None else done.unionByName(ended)
        active = state.where("NOT finished").select("query", "worst")
        if radius == SEGMENT or not active.take(1):
            break
    ranked = done.withColumn("rank", F.row_number().over(best))
    return asked.join(ranked, "query").select("query_id", "rank", F.col("id").alias("neighbor_id"), "distance")


def _mask_column(radius: int) -> Column:
    """The masks of a radius as one constant array, written as text so that the plan stays small."""
    return F.split(F.lit(",".join(map(str, masks(radius)))), ",").cast("array<int>")
