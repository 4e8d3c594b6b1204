"""Distribution reports whose cost does not depend on one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(chunks: DataFrame) -> DataFrame:
    """Structural counts of chunks in one pass."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return chunks.agg(
        F.count("*").alias("chunks"), F.count_distinct("video_id").alias("videos"), F.count_distinct("course").alias("courses"),
        F.count_if(F.col("token_estimate") < 100).alias("short"), F.count_if(F.col("token_estimate") > 250).alias("long"), F.count_if(F.col("duration") > 120).alias("slow"),
        F.count_if(blank("chunk_id")).alias("no_id"), F.count_if(blank("url")).alias("no_url"), (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("repeated"),
    )


#: Ranges that distinct values are ordered in; their bounds are approximate quantiles, so ranges are of like size.
RANGES = 64


def _ranks(df: DataFrame, c: str) -> DataFrame:
    """Distinct values with the places they take in order. Values are counted first, then ordered within ranges, so
    that no task orders all of them; one row per range is summed up."""
    v = df.select(F.col(c).cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count("*").alias("n"))
    bounds = v.agg(F.array_distinct(F.percentile_approx("v", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(1000))).alias("bounds"))
    v = v.crossJoin(F.broadcast(bounds)).withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("v")))).drop("bounds")
    sums = v.groupBy("range").agg(F.sum("n").alias("held"))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("held").over(w), F.lit(0)).alias("before"))  # at most RANGES rows
    inner = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return v.withColumn("to", F.sum("n").over(inner)).join(F.broadcast(sums), "range").select("v", "n", (F.col("to") + F.col("before")).alias("to")).withColumn("from", F.col("to") - F.col("n"))


def _at(place: Column) -> Column:
    """The value that holds a 0-based place."""
    return F.max(F.when((F.col("from") <= place) & (place < F.col("to")), F.col("v")))


def _counted(df: DataFrame, c: str) -> DataFrame:
    r = _ranks(df, c)
    return r.crossJoin(F.broadcast(r.agg(F.sum("n").alias("total"))))


def summary(df: DataFrame, c: str) -> DataFrame:
    """n, min, nearest-rank percentiles, interpolated median, max and mean; percentiles are values of the column as they are."""
    r = _counted(df, c)
    last = F.col("total") - 1
    near = [_at(F.bround(F.lit(p / 100) * last, 0)).alias(f"p{p}") for p in (10, 25, 50, 75, 90, 95, 99)]
    low, high = _at(F.floor(last / 2)), _at(F.ceil(last / 2))
    return r.agg(F.coalesce(F.max("total"), F.lit(0)).alias("n"), F.min("v").alias("min"), *near, ((low + high) / 2).alias("median"), F.max("v").alias("max"), F.round(F.sum(F.col("v") * F.col("n")) / F.max("total"), 6).alias("mean"))


def exclusive_quantiles(df: DataFrame, c: str, points: list[float]) -> DataFrame:
    """Quantiles at position p (n + 1), as columns q25, q50, ..."""
    r = _counted(df, c)
    out = []
    for p in points:
        pos = F.lit(p) * (F.col("total") + 1)
        j = F.least(F.greatest(F.floor(pos), F.lit(1)), F.col("total") - 1)
        lo, hi, frac = _at(j - 1), _at(j), F.max(pos - j)
        out.append(F.round(lo + (hi - lo) * frac, 6).alias(f"q{round(p * 100)}"))
    return r.agg(*out)


def histogram(df: DataFrame, c: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last closed; one bin if all values are equal."""
    edges = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int")))
    return df.where(F.col(c).isNotNull()).crossJoin(F.broadcast(edges)).select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
