"""Cutting lineage through a written table in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_used: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a session in one process (``local`` or ``local[n]``) that names none gets a temporary
    folder; on a cluster, where no executor would see it, that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "path" not in _own_dir:
        _own_dir["path"] = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, _own_dir["path"], ignore_errors=True)
    return _own_dir["path"]


def session_dir(spark: SparkSession) -> str:
    """This session's part of the shared folder, deleted at its end."""
    path = f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}"
    if path not in _used:
        _used[path] = spark
        atexit.register(release, path)
    return path


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def release(path: str | None = None) -> None:
    """Delete this session's materialised tables, all of them or those under ``path``.

    Runs at the end of the program; call it earlier once no result that reads them is needed.
    """
    for folder in [path] if path else list(_used):
        remove(_used.pop(folder, None), folder)


def remove(spark: SparkSession | None, path: str) -> None:
    """Delete a file or folder on any file system, if the session still lives."""
    try:
        files, target = _file_system(spark, path)
        files.delete(target, True)
    except Exception:  # noqa: BLE001, S110: the session may be gone; what is left is then the cluster's to clear
        pass


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> bool:
    """Write a small file on any file system, whole or not at all.

    The bytes go to a file beside the target that is then renamed to it; without ``overwrite`` an
    existing target stays and the answer is False.
    """
    files, target = _file_system(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(beside, True)
    out.write(bytearray(data))
    out.close()
    if overwrite and files.exists(target):
        files.delete(target, False)
    # A rename onto an existing file fails or is refused here, on all file systems alike.
    if files.exists(target) or not files.rename(beside, target):
        files.delete(beside, False)
        return False
    return True


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """The bytes of a small file, None if there is none."""
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return None
    source = files.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    finally:
        source.close()


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no folder."""
    files, target = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back.

    ``partition_by`` columns become folders, so that filters on them leave whole files out.
    Used where a result feeds several branches and must not be computed twice or differently; the
    job runs when this is called. The files survive the loss of any executor; they are compressed,
    so they stay below the size of a checkpoint of the same rows.
    """
    path = f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
