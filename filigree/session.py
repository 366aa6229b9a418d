"""Session helpers: the shared folder that cuts lineage, and tables written to it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the session names it in spark.checkpoint.dir.

    Where the setting is unset: the checkpoint folder of the context, if there is one; on a local master a temporary
    folder; on a cluster an error, as a machine-local folder would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="filigree-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_made: list[str] = []


@atexit.register
def _clear() -> None:
    """Tables of this process in folders that it can reach as files; others stay for the cluster's own cleaning."""
    for path in _made:
        if path.startswith("file:") or path.startswith("/"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it back: lineage is cut and the rows are fixed,
    so a lost executor costs only a re-read. The path is kept on the result for release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/filigree-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._filigree_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no plan still reads."""
    for df in tables:
        path = getattr(df, "_filigree_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, unless they share the driver's path or folder.

    The archive is served by the driver like any added file; no task writes to a local folder.
    """
    sc, root = spark.sparkContext, str(Path(__file__).resolve().parents[1])
    known = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if getattr(sc, "_filigree_shipped", False) or (sc.master.startswith("local") and root in known):
        return
    path = Path(tempfile.mkdtemp(prefix="filigree-")) / "filigree.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(Path(root, "filigree").rglob("*.py")):
            z.write(f, str(f.relative_to(root)))
    sc.addPyFile(str(path))
    sc._filigree_shipped = True


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
