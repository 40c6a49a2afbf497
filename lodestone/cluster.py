"""What operators need of a cluster: the package on the executors and a shared folder for what they keep."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, unless their Python path has it anyway."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_lodestone_sent", False):
        return
    target = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"  # the driver serves it from there
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted((root / "lodestone").rglob("*.py")):
            z.write(file, file.relative_to(root))
    sc.addPyFile(str(target))
    sc._lodestone_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, as in tests, a temporary one, but in local mode only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed and written to a table of the shared folder that removed() takes away again."""
    path = f"{shared_dir(df.sparkSession)}/work/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "written_at", None)) is not None:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
