"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_MADE: list[str] = []


def session(app: str = "sievework", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASK_BYTES = 128 << 20
BATCH_ROWS = 2_000


def spread(df: DataFrame) -> DataFrame:
    """Deal an input over the cores before a heavy stage.

    One of too few splits is repartitioned; of many small ones, neighbours are read by one task, up to TASK_BYTES and at
    least two tasks a core, so that what follows writes fewer and larger files. Where the session leaves the size of
    Arrow batches at its default, they get BATCH_ROWS rows: of whole texts, 10,000 are much to hold twice.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(rows) == "10000":
        df.sparkSession.conf.set(rows, str(BATCH_ROWS))
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts < cores // 2:
        return df.repartition(cores)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(2 * cores, -(-size // TASK_BYTES))
    return df.coalesce(wanted) if wanted < parts else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = "file://" + tempfile.mkdtemp(prefix="sievework-")
        sc.setCheckpointDir(current)
    return current.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; clean_up removes it."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean_up(spark: SparkSession) -> int:
    """Remove the folders that new_folder made in this process; tables read from them are gone then. Returns how many there were."""
    n = len(_MADE)
    for folder in _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _MADE.clear()
    return n


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs one stage only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """As cut, by a written table: smaller than a checkpoint, and later reads take only the columns they need."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
