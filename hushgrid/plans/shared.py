"""Intermediate results that outlive the executors which made them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Only a local session may go without that setting: it then gets a temporary folder, as in tests.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut, executors may go."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_pairs(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join on a key of few values, whose pairs are many more than the rows.

    Rows of `many` are dealt over four lots for each core, and those of `few` go to every lot, so a single key keeps all cores
    busy. Lots are merged in order, which holds one key's rows of `few` and spills beyond that; Spark doesn't join
    partitions that were asked for by number, however small what goes into them is.
    """
    n = 4 * many.sparkSession.sparkContext.defaultParallelism
    dealt = many.where(F.col(key).isNotNull()).withColumn("hg_lot", F.pmod(F.xxhash64(*many.columns), F.lit(n))).repartition(n, "hg_lot", key)
    copies = few.join(many.select(key).distinct(), key, "left_semi").withColumn("hg_lot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("hg_lot", F.col("hg_lot").cast("long"))
    return dealt.join(copies.repartition(n, "hg_lot", key).hint("merge"), ["hg_lot", key]).drop("hg_lot")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
