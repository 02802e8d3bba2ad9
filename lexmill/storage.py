"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()
#: Bytes of a row group of a table of large rows, about.
LARGE_ROWS_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a local session gets a temporary folder of its own; any other session is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="lexmill-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is there goes when the driver's Python ends with its session still running."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


@atexit.register
def _clear() -> None:
    if SparkContext._active_spark_context is None:
        return
    spark = SparkSession.getActiveSession()
    for path in _made if spark is not None else ():
        with contextlib.suppress(Exception):
            drop_path(spark, path)


def cut(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there and lost executors cost nothing.

    With ``large_rows`` (of megabytes) sizes are looked at behind each row: Parquet would otherwise hold a hundred rows before it
    first looks, and a reader a whole row group at once.

    What the driver's JVM has freed by then outside its heap goes back to the system.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if large_rows:
        sizes = {"parquet.block.size": LARGE_ROWS_GROUP, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}
        writer = writer.options(**sizes, **{"parquet.enable.dictionary": "false"})
    writer.parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def trim_driver(spark: SparkSession) -> None:
    """Returns freed memory outside the heap of the driver's JVM to the system, as far as that JVM has a command for it.

    The C library keeps freed pieces in arenas that a session's hundreds of threads share, some 200 MB after two small runs of
    the pipeline. The command changes nothing else.
    """
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    java_object, java_string = jvm.java.lang.Object, jvm.java.lang.String
    with contextlib.suppress(Py4JError):  # another JVM
        command = gateway.new_array(java_object, 4)
        command[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        command[1] = "systemTrimNativeHeap"
        command[2] = gateway.new_array(java_object, 0)
        command[3] = gateway.new_array(java_string, 0)
        kinds = gateway.new_array(jvm.java.lang.Class, 4)
        for k, x in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(x)
        # by the interface, as the server's own class is closed to reflection
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), command)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
