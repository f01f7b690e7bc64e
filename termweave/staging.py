"""Tables written once to the folder all executors share, so that several results can be read from one computation."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: On a local file system, files are written without checksum files and without forking `chmod` for each, whose child
#: shares all memory of an executor until its own program runs (as in llm/common.py); others don't read these options.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        return "file://" + tempfile.mkdtemp(prefix="termweave-")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/termweave_staging"


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system it lies on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    try:
        p, fs = file_system(spark, path)
        fs.delete(p, True)
    except Exception:  # the session has ended; its folder goes with it
        pass


def new_folder(spark: SparkSession) -> str:
    """A folder that is deleted at the end of the process."""
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """The same rows, written: the lineage is cut, and a lost executor costs nothing already done."""
    path = new_folder(df.sparkSession)
    df.write.options(compression="zstd", **PLAIN_FILES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, from any store that Spark reads."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0]["content"]).decode("utf-8") if rows else ""


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """Rewrites a small file whole: it is written beside the old one, which it then replaces."""
    p, fs = file_system(spark, path)
    tmp, _ = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(content.encode("utf-8")))
    out.close()
    fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"{path} was not written")
