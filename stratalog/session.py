"""Session helpers: a local session for tests, and durable cut points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which an execution removes its own shuffle files when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", partitions: int = 8, app: str = "stratalog") -> SparkSession:
    """A small local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    Only a local session may fall back to a temporary folder: on a cluster such a
    folder would be lost with its machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="stratalog-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared checkpoint folder and read it back.

    Used where a plan is read more than once and recomputing it would be slow, or
    where it holds partition numbers, which a recomputation may not repeat. Unlike
    `checkpoint()` a written table prunes columns and has a measured size, by which Spark
    chooses its joins. ``options`` go to the writer. The shuffle files of the write go when it is done; Spark
    would keep them until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stratalog-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)
