"""Makes the package importable for the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession, *modules: str) -> None:
    """Send the package, and top-level ``modules``, to the executors once an application, unless PYTHONPATH already leads there."""
    application = spark.sparkContext.applicationId
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if application in _shipped or str(ROOT) in paths:
        return
    archive = Path(tempfile.mkdtemp(prefix="lumenframe-")) / "lumenframe_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in [*sorted((ROOT / "lumenframe").rglob("*.py")), *(ROOT / f"{m}.py" for m in modules if (ROOT / f"{m}.py").exists())]:
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a folder of our own, in local mode only, as other executors would not see it."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the files of a table that ``written`` made and nothing reads any more."""
    jvm, path = df.sparkSession._jvm, df._written_to
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
