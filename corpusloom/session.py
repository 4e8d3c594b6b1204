"""Session factory and the shared-storage checkpoint used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Session settings every plan relies on. Partition counts stay with the deployment; AQE coalesces them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with :data:`DEFAULTS`, overridden by ``conf`` (dots written as ``__``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return ship(b.getOrCreate())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        fd, name = tempfile.mkstemp(prefix="corpusloom-", suffix=".zip")
        with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(name)
        _shipped.add(sc.applicationId)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    ``spark.checkpoint.dir`` of the session wins. Where it is unset, a local session (tests) gets a folder of this
    machine; on a cluster, whose machines do not share one, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints"))
    return sc.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder: survives lost executors, cuts lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder: like :func:`stable`, but columnar and
    compressed, for results that are large or read by column. :func:`release` deletes it."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _tables(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete the tables that :func:`written` has made in this application: once the results are saved."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
