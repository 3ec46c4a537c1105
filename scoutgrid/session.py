"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "scoutgrid", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # plans are built in a third of the time
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of a session, wherever it was started from; call it once on a session of your own."""
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="scoutgrid-")) / "scoutgrid.zip"  # the driver serves it, nobody else reads it
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Zone-less timestamps of the tables are UTC.

    Generated methods above 8000 bytes are never compiled by HotSpot; Spark then does better
    with its split per-operator code, which the documented limit switches to.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all tasks: for inputs of few splits with much work per row."""
    return df.repartition(shuffle_partitions(df.sparkSession))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster
    session must name a shared one, since executors can be lost.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="scoutgrid-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
