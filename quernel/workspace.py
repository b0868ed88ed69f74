"""Tables written in the shared folder, used to cut lineage.

A written table survives the loss of executors and, unlike a cached plan, is
never computed twice. The folder is the one the cluster names in
``spark.checkpoint.dir``; only where that is unset and the master is local
(tests) a folder of this machine is made.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_lock = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables."""
    app = spark.sparkContext.applicationId
    with _lock:
        return _root(spark, app)


def _root(spark: SparkSession, app: str) -> str:
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
            base = current.get() if current.isDefined() else None
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quernel-")
        _roots[app] = f"{base.rstrip('/')}/quernel-{app}"
        atexit.register(_remove, spark, app)
    return _roots[app]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results not yet written are lost with them."""
    app = spark.sparkContext.applicationId
    if app in _roots:
        _remove(spark, app)


def _remove(spark: SparkSession, app: str) -> None:
    root = _roots.pop(app, None)
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the cluster cleans its own folder
        pass


#: Bytes of input, as files or as the optimizer estimates them, that one part of costly work holds at most.
SPREAD_BYTES = 16 << 20
#: From this estimate on the optimizer doesn't know (it multiplies the sides of joins, and takes rows from elsewhere for endless).
UNKNOWN_BYTES = 1 << 50


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hash-partitioned by keys (or evenly) into enough parts for work that costs far more than its bytes.

    As many as the bytes need, and three for each core at least; without keys,
    a frame that has two for each core as it is read isn't moved. The number is
    explicit, so that adaptive execution doesn't join small parts again;
    grouping by the keys afterwards needs no further shuffle.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < UNKNOWN_BYTES else 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, size // SPREAD_BYTES)
    if not keys and df.rdd.getNumPartitions() >= max(2 * spark.sparkContext.defaultParallelism, size // (8 * SPREAD_BYTES)):
        return df
    return df.repartition(n, *keys)
