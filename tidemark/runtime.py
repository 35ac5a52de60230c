"""Session and durable intermediates shared by the engine's operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[tuple[SparkSession, str]]] = []


def session(app: str = "tidemark", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; conf entries use __ for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder of its own; on a cluster, whose
    executors would not see one, this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


def release(df: DataFrame) -> None:
    """Delete a materialized frame that nothing reads any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        for s in _scopes:
            s[:] = [x for x in s if x[1] != path]
        delete_path(df.sparkSession, path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is no such file."""
    at, fs = _file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it is there already."""
    at, fs = _file_system(spark, path)
    try:
        fs.create(at, False).close()
        return True
    except Exception as e:  # py4j wraps what Hadoop throws
        if "AlreadyExists" in str(e):
            return False
        raise


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside path and move it there in one step, so that readers see the old or the new one."""
    jvm = spark._jvm
    at, fs = _file_system(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(at), how)


@contextmanager
def scratch() -> Iterator[list]:
    """Deletes at its end what was materialized within, apart from frames handed to keep()."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for spark, path in _scopes.pop():
            delete_path(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """A materialized frame that outlives the innermost scratch(); the next outer one, if any, takes it."""
    path = getattr(df, "_tidemark_path", None)
    if path and _scopes:
        mine = [x for x in _scopes[-1] if x[1] == path]
        _scopes[-1][:] = [x for x in _scopes[-1] if x[1] != path]
        if len(_scopes) > 1:
            _scopes[-2].extend(mine)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
