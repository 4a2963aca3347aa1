"""What every job needs from its session: tables, shipped code, a shared folder.

A job must survive the loss of an executor, so intermediate results that are
read more than once go to the folder the cluster names in
``spark.checkpoint.dir``; nothing is kept in executor memory only.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers on other machines have no copy of the repository; the archive goes
    through the driver's file server.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, target = tempfile.mkstemp(prefix="textrill-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(target)
    atexit.register(lambda: Path(target).unlink(missing_ok=True))  # the driver serves it until it ends
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; also ships the package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is read from the session. Only where the session names none (tests,
    single machine) a local folder is chosen.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    local = f"file://{tempfile.gettempdir()}/textrill-shared-{os.getuid()}"
    spark.conf.set(CHECKPOINT_KEY, local)
    return local


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, whatever the number of input files.

    Work on texts costs far more a byte than a scan, so a scan with fewer tasks
    than cores is dealt out anew. Larger inputs have enough tasks of their own
    and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if tasks >= cores else df.repartition(cores)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a durable copy: a lost executor costs only a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Intermediate tables go when the application ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
