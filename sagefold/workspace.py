"""Where jobs put what all executors must see, and sessions for single machines."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own on a single machine (tests)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sagefold-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there: what comes after does not compute it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a context: their Python workers need not have it installed.

    Spark serves the archive from the driver to every executor, also to those
    that come later.
    """
    context = spark.sparkContext
    if getattr(context, "_sagefold_shipped", False):
        return
    package = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    target = Path(tempfile.mkdtemp(prefix="sagefold-")) / "sagefold.zip"
    target.write_bytes(data.getvalue())
    context.addPyFile(str(target))
    context._sagefold_shipped = True


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session on this machine, as tests, the command line and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions or (cores if isinstance(cores, int) else 8)))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
