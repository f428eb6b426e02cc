"""Session set-up, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "quillmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; every value can be overridden by keyword (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a corpus directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Workers normally see it on their path. Where they do not, a zip served by the driver's file server is added, as
    ``--py-files`` would; nothing is read from a local folder by the executors.
    """
    conf = spark.sparkContext.getConf()
    if conf.get("spark.quillmill.shipped", "") or getattr(spark.sparkContext, "_quillmill_shipped", False):
        return
    fd, name = tempfile.mkstemp(prefix="quillmill-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, str(path.relative_to(_PACKAGE.parent)))
    spark.sparkContext.addPyFile(name)
    spark.sparkContext._quillmill_shipped = True


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that the rows come from, as stored; 0 where they come from none."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def parts_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Partitions for a shuffle of whole rows: by the stored bytes, the session's number at least."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-input_bytes(df) // bytes_each))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where they come from fewer files than there are cores, none of which is large enough to be
    read in several parts; else the rows as they are.

    A table of one small file is one task, however much work its rows make. What is looked at are the names and sizes of the
    files, so nothing is planned or run; a large table isn't touched and gets no shuffle.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= cores:
        return df
    jvm = spark.sparkContext._jvm
    conf, part = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in files]
    parts = sum(-(-p.getFileSystem(conf).getFileStatus(p).getLen() // part) for p in paths)
    return df.repartition(cores) if parts < cores else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the session names in ``spark.checkpoint.dir``.

    A folder of our own is chosen only where the session has none and runs on one machine, as in tests.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmill-checkpoint-"))
    return df.checkpoint()
