"""Session helper: cutting lineage through tables written to the shared folder."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="transitlapse-ckpt-")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (master ``local``) gets a folder of its own; a cluster has no folder
    that all of its machines see, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.conf.get("spark.master", "").partition("[")[0] == "local":
        return _own_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: dict[int, list] = {}  # sessions by how many such blocks they are in, and what was set before the first
_counting = threading.Lock()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside are deleted as each of them ends.

    Spark else keeps them until the driver happens to collect its garbage. Only for queries whose rows are written out:
    each write plans its query anew, so none reads the shuffles of another.
    """
    key = id(spark._jsparkSession)
    with _counting:
        inside = _open.setdefault(key, [0, spark.conf.get(_CLEANUP, None)])
        inside[0] += 1
        spark.conf.set(_CLEANUP, True)
    try:
        yield
    finally:
        with _counting:
            inside[0] -= 1
            if not inside[0]:
                del _open[key]
                if inside[1] is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, inside[1])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Lost executors re-read it instead of replaying what led to it, later steps read only the columns they use,
    and joins see its true size. The shuffles that led to it are removed when it is there.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "snappy").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if (made := _made.get()) is not None:
        made.append((table, path))
    return table


_made: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``cut_lineage`` writes inside are deleted at the end, but for those given to the yielded function.

    Nothing lazy that reads the others may leave the block; kept tables belong to the block around it, if there is one.
    """
    outer, made, kept = _made.get(), [], []
    token = _made.set(made)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _made.reset(token)
        for table, path in made:
            if not any(table is k for k in kept):
                _delete(spark, path)
            elif outer is not None:
                outer.append((table, path))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` wrote; nothing that still reads it may run afterwards."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(spark, name)
