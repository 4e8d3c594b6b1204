"""JSON, text and cache sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False, required: str | None = None) -> DataFrame:
    """One object per line by an explicit schema. Blank lines are skipped; broken lines are dropped, or, if
    ``strict``, stop the read. ``required`` drops rows whose field is null or empty."""
    df = spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")
    return df.where(F.length(required) > 0) if required else df


def read_queries(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A query file: lines, a JSON list, or an object with ``queries``. The text is ``text``."""
    if path.endswith(".jsonl"):
        df = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    else:
        whole = spark.read.text(path, wholetext=True)
        listed = F.from_json("value", f"array<{schema.simpleString()}>")
        held = F.from_json("value", f"struct<queries:array<{schema.simpleString()}>>")["queries"]
        if not whole.where(F.trim("value").rlike(r"^[\[{]")).count():
            raise ValueError(f"{path} is neither a list nor an object with queries")
        df = whole.select(F.explode(F.when(F.trim("value").startswith("["), listed).otherwise(held)).alias("q")).select("q.*")
    names = [c for c in ("query", "query_vi", "question", "question_vi") if c in df.columns]
    return df.withColumn("text", F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names]))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed non-empty lines (``value``); a missing file has none."""
    try:
        return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''").distinct()
    except AnalysisException:
        return spark.createDataFrame([], "value string")


def read_table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache table; missing is empty, and files that cannot be read are left out."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_jsonl(df: DataFrame, path: str, compression: str = "none") -> int:
    """Write and return the number of rows, counted while writing. Readers know a ``compression`` by the files' names."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path, compression=compression)
    return seen.get["n"]


def append_ledger(df: DataFrame, key: str, path: str) -> None:
    """Add the keys of ``df`` to a line ledger."""
    df.select(F.col(key).cast("string")).where(F.col(key).isNotNull()).distinct().write.mode("append").text(path)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; the last of ``new`` by ``order``, a column
    of ``new`` alone, wins. Null keys of ``new`` are one key."""
    fields = [c for c in new.columns if c not in (key, order)]
    last = new.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in fields])
    kept = old.join(last.select(F.col(key).alias("_key"), F.lit(1).alias("_new")), F.col(key).eqNullSafe(F.col("_key")), "left").where("_new is null").drop("_key", "_new")
    return kept.unionByName(last)


def cached(queries: DataFrame, cache: DataFrame, key: str, fallback: Column) -> DataFrame:
    """``queries`` with (q1, q2) of a rewrite cache; rows it lacks get the query itself and ``fallback``."""
    hit = cache.select(key, "q1", "q2").dropDuplicates([key]).withColumn("cached", F.lit(True))
    return queries.join(hit, key, "left").withColumn("q1", F.coalesce("q1", F.col(key))).withColumn("q2", F.coalesce("q2", fallback)).withColumn("cached", F.coalesce("cached", F.lit(False)))


def report(summary: DataFrame, config: dict[str, str], rows: DataFrame, path: str) -> None:
    """A JSON report: config and aggregates in one file set, rows in another."""
    pairs = [F.lit(v).alias(k) for k, v in config.items()] or [F.lit(None).cast("string").alias("none")]
    summary.select(F.struct(*pairs).alias("config"), F.struct("*").alias("aggregate")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/per_query")
