"""Shared-folder tables: the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
#: Bytes of an Arrow batch between Spark and Python: rows are whole texts, and a worker holds a batch more than once.
ARROW_BYTES, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for a Spark context: what ``--py-files`` would do. A session that names no size
    of Arrow batches gets small ones."""
    if spark.conf.get(ARROW_BYTES, None) == ARROW_DEFAULT:
        spark.conf.set(ARROW_BYTES, "8m")
    context = spark.sparkContext
    if getattr(context, "_has_lexforge", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="lexforge-")) / "lexforge.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._has_lexforge = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a fresh local one only where the session names none (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Of each open scratch(), the innermost last: the tables written in it.
_OPEN: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, so that later jobs neither
    recompute it nor depend on blocks that only one executor holds."""
    ship(df.sparkSession)
    path = f"{checkpoint_dir(df.sparkSession)}/lexforge/{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._lexforge_path = path
    return found


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark keeps it."""
    store, where = _files(spark, path)
    store.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _files(spark, path)
    return store.exists(where)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more, such as a round's once the next is written."""
    delete(df.sparkSession, df._lexforge_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside are deleted at the end, but for those written by the function that it gives. What leaves
    the block may depend on these only."""
    _OPEN.append([])
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        found = materialize(df)
        kept.append(_OPEN[-1].pop())
        return found

    try:
        yield keep
    finally:
        for path in _OPEN.pop():
            delete(spark, path)
        if _OPEN:
            _OPEN[-1].extend(kept)


def folder(spark: SparkSession) -> str:
    """The name of a new folder among the shared ones."""
    return f"{checkpoint_dir(spark)}/lexforge/{uuid.uuid4().hex}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
