"""Session and table access."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidewright", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for local work; on a cluster the master and memory come from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    local = {"spark.master": f"local[{cores}]", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8"}
    for key, value in (local | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application, so that they find it wherever the driver was started. Spark's file server hands it out."""
    if any(name.endswith("/tidewright.zip") for name in spark.sparkContext.listFiles):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(os.path.join(root, "tidewright")):  # otherwise the package came as an archive itself
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tidewright"), "zip", root, "tidewright"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the test tables; columns are pruned by whoever reads it."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
