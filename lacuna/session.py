"""Session helpers: a local session for tests/bench and lineage cutting.

Lineage is cut by writing Parquet below the folder named by
``spark.checkpoint.dir`` (shared on a cluster) and reading it back.  A folder
is only chosen here for a single local JVM; never a copy held by one executor.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"
_LOCAL_SCRATCH: dict[str, str] = {}


def get_session(master: str | None = None, partitions: int | None = None,
                app: str = "lacuna") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = str(partitions or int(cpus))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.default.parallelism", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LACUNA_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver can see: ``spark.checkpoint.dir``.

    A scratch folder is chosen only where the setting is absent *and* the
    master is a single local JVM (tests); a cluster without the setting is an
    error, because a machine-local folder would be lost or unreadable there.
    """
    conf = spark.sparkContext.getConf().get(_CKPT_KEY, None) or spark.conf.get(_CKPT_KEY, None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"set {_CKPT_KEY} to a shared folder (master is {master})")
    if master not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[master] = tempfile.mkdtemp(prefix="lacuna-shared-")
    return _LOCAL_SCRATCH[master]


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder (below ``shared_folder``)."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = shared_folder(spark)
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def stage(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back:
    a columnar lineage cut that survives executor loss, prunes columns and
    keeps statistics.  ``unstage`` deletes it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def stage_by(df: DataFrame, key: str, tag: str = "t") -> DataFrame:
    """``stage`` with rows dealt to buckets of ``key``, as many as a join has
    partitions: joins on ``key`` read them where they are and shuffle only
    their other side."""
    spark = df.sparkSession
    path, name = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}/{tag}", f"staged_{tag}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._staged_path, out._staged_table = path, name
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables whose readers have finished."""
    for f in frames:
        path = getattr(f, "_staged_path", None)
        if path is None:
            continue
        if getattr(f, "_staged_table", None):
            f.sparkSession.sql(f"DROP TABLE IF EXISTS {f._staged_table}")
        sc = f.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        f._staged_path = None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared folder (survives executor loss) and
    return a DataFrame with a short lineage."""
    return stage(df, "cut")
