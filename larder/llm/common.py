"""What the operators of this subpackage share: input columns, shared folders, Arrow batch size."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent and the master is local, as in tests, a folder of this machine is set as checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        held = spark.sparkContext.getCheckpointDir()
        if held is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if held is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larder-"))
            held = spark.sparkContext.getCheckpointDir()
        base = held
    return f"{base.rstrip('/')}/larder/{name}-{uuid.uuid4().hex}"


def posix_path(url: str) -> str:
    """The local path of a shared folder; memory-mapped files need one that is mounted as a file system."""
    parsed = urlparse(url)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped output needs a mounted shared folder, not {url}")
    return parsed.path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df as a table in the shared folder that is dealt out and sorted by keys, so that joins by them don't move it again."""
    spark = df.sparkSession
    path, table = shared_dir(spark, name), f"larder_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out.written_to, out.written_as = path, table
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        if hasattr(table, "written_as"):
            spark.sql(f"DROP TABLE IF EXISTS {table.written_as}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds Arrow batches, since one row holds a whole document."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) != rows:
        spark.conf.set(key, str(rows))


def or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
