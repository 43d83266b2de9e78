"""Session settings, table loading and the shared scratch location.

Every operator takes DataFrames and explicit clocks; this module only holds the few things that
depend on the session: confs that make results reproducible (UTC), the loader for the Parquet
inputs, and the durable folder used to cut lineage or stage derived files.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Settings that change results or plans; applied to whatever session the caller hands us.
_RUNTIME_CONFS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a stream names each new file as a path of its own, and Spark lists paths in up to this many tasks (10,000 by
    # default, so a task a file); 64 keep a large cluster busy
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # streams with list state and timers need it
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str = "local[8]", app: str = "scriptorium", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Local session used by tests and the benchmark. Clusters pass their own session instead."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**_RUNTIME_CONFS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply result-affecting runtime confs to an existing session (idempotent) and ship this
    package to the Python workers."""
    for k, v in _RUNTIME_CONFS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    _ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def _ship_package(spark: SparkSession) -> None:
    """Python workers unpickle our functions by module name, so the package travels with the job
    (``addPyFile``, the programmatic ``--py-files``) once per SparkContext."""
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="scriptorium-code-")
    archive = shutil.make_archive(os.path.join(out, "scriptorium"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    _SHIPPED.add(id(sc))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Parquet keeps column pruning and filter pushdown to the scan."""
    configure(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """Durable folder for checkpoints and staged files.

    On a cluster this is the shared folder named in ``spark.checkpoint.dir``; only when the
    session has none (local tests) do we create one of our own and register it.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.sparkContext.getCheckpointDir()
    if not conf_dir:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="scriptorium-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique location under the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over the cluster before per-row heavy work (conversion, embedding,
    scoring) when it is read from fewer files than the default parallelism - e.g. one small file
    that is a single split. Only the file listing is asked, so no job runs while a plan is built. Inputs
    read from that many files (the large-scale case) are left untouched. Few but large files, and tables
    that are not read from files (a checkpoint), are shuffled once even if they are wide already: pass
    ``min_partitions=0`` there."""
    target = min_partitions if min_partitions is not None else df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= target else df.repartition(target)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition on ``keys`` into a fixed number of partitions before a Python-heavy grouped
    step. AQE coalesces small post-shuffle partitions (right for JVM work), which would put all
    groups of a modest input on one Python worker; an explicit count is kept, and the following
    ``groupBy`` on the same keys reuses this partitioning (no second shuffle)."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")),
            df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
