"""Files of a name and some bytes, written by tasks to any file system that Spark reaches.

Spark's text sink writes bytes as they are, commits a task's files or none of them, and ends each
"line" with a separator; a row is a file of its own. The driver then gives the files their names, which
touches no data. The separator stays behind the last byte, so a format must bear one: here a single
zero byte for formats that find their ends from their heads, or an empty skippable frame for Zstandard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path

ZERO = "\0"
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"  # a skippable frame without content


def write_files(files: DataFrame, path: str, end: str = ZERO) -> int:
    """Writes rows (name, content) as files below ``path``, replacing those of the same names; a name
    may have folders in it. Returns their number. Of rows that repeat a name one is written."""
    spark = files.sparkSession
    base = shared_path(spark, "files")
    once = files.groupBy("name").agg(F.max("content").alias("content")).withColumn("_at", F.hex(F.col("name").cast("binary")))
    once.select("_at", F.col("content").cast("string")).write.partitionBy("_at").option("lineSep", end).option("maxRecordsPerFile", 1).text(base)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop(path))
    n = 0
    for folder in system.listStatus(hadoop(base)):
        name = folder.getPath().getName()
        if not name.startswith("_at="):
            continue
        target = hadoop(f"{path.rstrip('/')}/{bytes.fromhex(name[4:]).decode()}")
        system.mkdirs(target.getParent())
        for part in system.listStatus(folder.getPath()):
            if part.getPath().getName().startswith("part-"):
                system.delete(target, False)
                if not system.rename(part.getPath(), target):
                    raise OSError(f"cannot name {target.toString()}")
                n += 1
    return n


def put_text(spark, path: str, text: str) -> None:
    put_bytes(spark, path, text.encode())


def put_bytes(spark, path: str, data: bytes) -> None:
    """Writes one small file from the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def get_text(spark, path: str) -> str | None:
    """Reads one small file that Spark's readers may pass over; None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
