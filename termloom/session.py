"""Session helpers shared by every operator."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Used only on a local master (unit tests, a laptop) that names no shared folder.
FALLBACK_SHARED_DIR = "/tmp/checkpoints/termloom"
#: What this process has staged and not yet removed, oldest first.
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it. Without
    one a cluster is refused: a machine's own folder would lose what others wrote."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = FALLBACK_SHARED_DIR
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives the loss of any executor. ``release`` removes what is no longer needed."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_with(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``staged``, and aggregates over the rows written, taken by the writing tasks on their way
    (no job of their own)."""
    seen = Observation()
    out = staged(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), name)
    return out, seen.get or out.agg(*[c.alias(k) for k, c in measures.items()]).first().asDict()


def staged_so_far() -> int:
    """A mark for ``release``."""
    return len(_STAGED)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove the tables staged after the mark ``since``, but for the last ``keep`` of them.
    Only for tables that no later result reads."""
    stop = max(since, len(_STAGED) - keep)
    for path in _STAGED[since:stop]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _STAGED[since:stop]
    tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage: only then does Spark's cleaner drop the shuffles and
    broadcasts of tables that nothing refers to any more, here and on the executors. What the
    JVM freed outside its heap meanwhile is given back, too."""
    spark._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> bool:
    """Give the system back what the driver's JVM has freed outside its heap (of compiled plans,
    compressed map statuses, threads): the C library keeps it for each of hundreds of threads,
    up to hundreds of MB. False where the JVM has no such command (glibc, 17.0.9 or later)."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class
    types, given = new_array(kind, 4), new_array(jvm.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[i] = kind.forName(name)
    try:
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # the server's class is not open to Py4J, its interface is
        kind.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, given)
    except Py4JError:
        return False
    return True


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(scan: DataFrame) -> DataFrame:
    """``scan`` with its rows dealt out to all cores where it has fewer splits than cores (a
    file of one row group is one split); a table of many splits is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan
