"""Session settings that every query of this library assumes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session made by the library itself (tests, bench). On a cluster the deployment sets its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", app: str = "lakeloom", **conf: str) -> SparkSession:
    """A local session with the library's defaults; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.driver.memory", memory)
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus)} | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound what goes to Python at once to `size`, as texts differ much in length; only where neither the deployment nor the session has set a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sql("SET").filter(f"key = '{key}'").isEmpty():  # lists what was set, not defaults
        spark.conf.set(key, size)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that `spark.checkpoint.dir` names; where none is set, in a temporary one, for a local session alone."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lakeloom-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder, as Parquet, and return it as read from there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
