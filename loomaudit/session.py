"""Sessions and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomaudit")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in spark.checkpoint.dir; only where that is unset
    (tests, local mode) a temporary folder of this machine is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="loomaudit-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, *parts: str) -> DataFrame:
    """Writes df to the shared folder, in a folder for each value of ``parts``, and reads it back: it is computed once, and a lost executor costs only a read."""
    spark = df.sparkSession
    at = os.path.join(shared_dir(spark), f"table-{uuid.uuid4().hex}")
    df.write.partitionBy(*parts).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it was read from fewer files than there are cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text through Hadoop's file systems, None if there is none."""
    jvm, at, fs = _files(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no folder."""
    _, at, fs = _files(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    _, at, fs = _files(spark, path)
    fs.delete(at, True)


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file by a rename: readers see the old text or the new."""
    jvm, at, fs = _files(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(path + ".new")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(at), options)
