"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which all executors see.

    Where that is unset, a local session has a temporary folder; a cluster is refused,
    as its executors don't share one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.filigree.shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="filigree-")
        spark.conf.set("spark.filigree.shared", found)
    return f"{found.rstrip('/')}/filigree-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Deletes all steps that this application has written; results still to be read from them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written once to the shared folder and read again: survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by the keys over all shuffle partitions: small rows that are long work are not put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
