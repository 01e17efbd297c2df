"""Session and shared folders."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("veritrim")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Small tables on one machine: keep all cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        # Call sites for error messages take longer to collect than small plans take to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str, name: str | None = None) -> str:
    """A folder under the shared folder the cluster names in ``spark.checkpoint.dir``; a new one unless named.

    Only a local session without that setting gets a temporary folder of its machine.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="veritrim-")
    return f"{base.rstrip('/')}/{purpose}-{name or uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, name: str | None = None, **options: object) -> DataFrame:
    """The rows as a Parquet table in the shared folder; ``options`` are the writer's.

    For a result that several branches of a job read: it is computed once, outlives a lost executor, and its
    readers fetch only the columns they need. A named table replaces the one of that name, so
    that a long series of batches keeps one; others are left to whoever cleans the shared folder.
    """
    path = shared_folder(df.sparkSession, purpose, name)
    df.write.options(**options).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers; model stages unpickle functions from it there."""
    package = Path(__file__).parent
    digest = hashlib.sha256()
    sources = sorted(package.rglob("*.py"))
    for source in sources:
        digest.update(source.read_bytes())
    name = f"veritrim_{digest.hexdigest()[:16]}.zip"
    if any(path.endswith(name) for path in spark.sparkContext.listFiles):
        return
    archive = Path(tempfile.mkdtemp(prefix="veritrim-ship-")) / name
    with zipfile.ZipFile(archive, "w") as out:
        for source in sources:
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
