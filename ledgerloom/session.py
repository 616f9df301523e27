"""Sessions and tables kept between the stages of one query."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "ledgerloom"
#: Names this process's tables in the shared folder, so that one job never removes another's.
_RUN = uuid.uuid4().hex


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, named by spark.checkpoint.dir.

    A folder of our own is made only where the setting is missing and the master is local, as in tests.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{_FOLDER}/{spark.sparkContext.applicationId}-{_RUN}"


def keep(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df once to the shared folder and read it back: a short lineage that survives lost executors.

    Unlike a cached table it needs no executor memory, and unlike a checkpoint it is columnar, so later
    readers prune columns. The result has df's schema, with every column nullable.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df on as many tasks as there are cores, if it is a plain scan of fewer splits: for work that costs far more than its bytes. Larger scans stay where they are."""
    spark = df.sparkSession
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = spark.sparkContext.defaultParallelism
    return df if df._jdf.toJavaRDD().getNumPartitions() >= cores else df.repartition(cores)


def drop_kept(spark: SparkSession) -> None:
    """Remove this session's tables of keep() from the shared folder, at the end of a job. Results that read them must be written before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
