"""Ledger joins, deduplication, key lookups and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_in_ledger(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the success ledger; failures are tried again."""
    return rows.join(ledger.select(key).distinct(), key, "left_anti")


def named_in(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return rows.join(names.select(key).distinct(), key, "left_semi")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key with the last values at the first position (column ``first_pos``)."""
    fields = [c for c in rows.columns if c != key]
    out = rows.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("r"), F.min(order).alias("first_pos"))
    return out.select(key, *[F.col(f"r.{c}").alias(c) for c in fields], "first_pos")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """``(rows, keys, beyond_first)``."""
    return rows.agg(F.count(key).alias("rows"), F.count_distinct(key).alias("keys"), (F.count(key) - F.count_distinct(key)).alias("beyond_first"))


def assert_unique(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, or an error that names up to five repeated keys."""
    bad = [r[0] for r in rows.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
    if bad:
        raise ValueError(f"duplicate {key}: {bad}")
    return rows


def lookup_any(rows: DataFrame, keys: list[str], table: DataFrame, on: str, gain: str, default: float = 0.0) -> DataFrame:
    """The largest ``gain`` over several candidate keys of a row, as equi-joins of exploded keys."""
    r = rows.withColumn("_row", F.monotonically_increasing_id())
    cand = r.select("_row", F.explode(F.array_distinct(F.array(*[F.col(k).cast("string") for k in keys]))).alias(on)).where(F.col(on).isNotNull())
    best = cand.join(table.select(F.col(on).cast("string").alias(on), gain), on).groupBy("_row").agg(F.max(gain).alias(gain))
    return r.join(best, "_row", "left").withColumn(gain, F.coalesce(gain, F.lit(default))).drop("_row")


def _order(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified(rows: DataFrame, key: str, stratum: str, target: int, seed: int = 42, oversample: float = 1.3, guaranteed: int = 5) -> DataFrame:
    """A share of each stratum by its size, with a guaranteed least, in a seeded order."""
    want = int(target * oversample)
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    strata = F.count("*").over(Window.partitionBy())
    total = F.sum("size").over(Window.partitionBy())
    least = F.least(F.lit(guaranteed), F.floor(F.lit(target) / strata).cast("int"))
    quota = (least + F.bround((F.lit(want) - least * strata) * F.col("size") / total, 0)).cast("int")
    q = sizes.select(stratum, quota.alias("quota"))
    w = Window.partitionBy(stratum).orderBy(_order(seed, key), key)
    return rows.join(q, stratum).withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("quota")).drop("quota")


def equal_share(rows: DataFrame, key: str, stratum: str, target: int, seed: int = 42) -> DataFrame:
    """max(1, target // strata) rows of each stratum."""
    strata = rows.select(stratum).distinct().count()
    w = Window.partitionBy(stratum).orderBy(_order(seed, key), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(1, target // max(1, strata)))


def bernoulli(rows: DataFrame, key: str, text: str, percent: int = 1, least: int = 200, most: int = 800, limit: int = 50, seed: int = 42) -> DataFrame:
    """Rows of a seeded percentage whose text length is in a band, the first ``limit`` of them."""
    digest = F.conv(F.substring(_order(seed, key), 1, 6), 16, 10).cast("bigint")
    return rows.where((digest % 100 < percent) & F.length(text).between(least, most)).orderBy(key).limit(limit)


def pivot_runs(rows: DataFrame, metric: str, run: str, value: str, runs: list[str]) -> DataFrame:
    """One row per metric with a column per run."""
    return rows.groupBy(metric).pivot(run, runs).agg(F.first(value))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
