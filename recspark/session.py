"""Session settings and materialisation in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Temporary folders of local applications.
_LOCAL: dict[str, str] = {}


def local_session(app: str = "recspark", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benches; on a cluster use the one spark-submit made."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Without one, a temporary folder serves on a local master, where all executors see it; elsewhere that is an error,
    since each executor would write to a disk of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="recspark-")
        configured = _LOCAL[app]
    return configured


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables: `clear_run` removes it when the run's results are written."""
    return f"{shared_folder(spark)}/recspark/{spark.sparkContext.applicationId}"


def clear_run(spark: SparkSession) -> None:
    """Remove this application's intermediate tables. DataFrames made from them can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, *cluster_by: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    The stages after it plan on a leaf with known size, nothing before it runs twice, and
    a lost executor costs one task, not the whole lineage.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    out = df.repartition(*cluster_by) if cluster_by else df
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small tables of iterative jobs."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
