"""Where intermediate tables go: the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Only a local master may do without: one is made there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lumenarc-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lumenarc/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and a lost executor costs one task."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver's C library give free memory back to the system.

    Planning leaves it in the arenas of many short-lived threads, where it counts against the driver's container until
    it is asked for. The command is the JDK's own; a JVM without it is left as it is.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    lang = jvm.java.lang
    kinds, given = array(lang.Class, 4), array(lang.Object, 4)
    try:
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = lang.Class.forName(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = lang.management.ManagementFactory.getPlatformMBeanServer()
        lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JError:
        pass


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if df has at most so many rows; reads no more than it needs to know."""
    return df.limit(rows + 1).count() <= rows


def unused(df: DataFrame, name: str) -> str:
    """name, or one made from it that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain(x: pd.DataFrame) -> pd.DataFrame:
    """x with strings as objects: pandas' own string columns can come in chunks, which Arrow batches don't take."""
    return x.astype({c: object for c in x.columns if isinstance(x[c].dtype, pd.StringDtype)})


def by_size(batches: Iterator[pd.DataFrame], column: str, most: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """The rows of batches in parts that hold at most so many characters or bytes of a column, or one row."""
    for x in batches:
        sizes = x[column].map(lambda v: 0 if v is None else len(v)).cumsum()
        for _, part in x.groupby(sizes // most, sort=False):
            yield part
