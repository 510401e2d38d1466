"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set the session options that the wide feature plans rely on.

    Only runtime SQL options are touched, so this is safe on a session that
    somebody else created.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Whole-stage code generation stops at 100 fields by default; the feature
    # sets have up to about 200. Wider methods outgrow the JVM's method size.
    spark.conf.set("spark.sql.codegen.maxFields", "200")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # Batches for Python hold rows of any width: they end by bytes, too.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "riskframe") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_TEST_FOLDERS: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    When the setting is absent (a local test session) one temporary folder per
    application is made instead; other sessions must name a shared folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _TEST_FOLDERS:
        _TEST_FOLDERS[app] = tempfile.mkdtemp(prefix="riskframe-")
    return _TEST_FOLDERS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, not yet existing path below the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Remove all stored tables of this application; call it when a run's results are written elsewhere.

    Returns the number of folders removed. Frames that still read them fail afterwards.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        folder = jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(folder.getFileSystem(conf).delete(folder, True))
    return removed


#: Rows of a task in work that passes over the same rows again and again, about.
SPREAD_ROWS = 250_000


def spread(df, rows: int):
    """The rows dealt out evenly over all cores, more parts for more rows.

    A file with one row group is read by one task, which every later pass over the rows would keep.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SPREAD_ROWS)))


def materialize(df, name: str = "stage"):
    """Write a DataFrame to the shared folder and read it back.

    Cuts the lineage with a file that survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df) -> None:
    """Remove the files of a table that ``materialize`` wrote and nobody reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
