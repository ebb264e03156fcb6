"""Session helpers: table access, lineage cuts in shared storage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "decidra", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DECIDRA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's setting, else, with a local master only, a folder of our own."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if configured and not current:
        sc.setCheckpointDir(configured)
        return configured
    if not current:
        if not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        current = tempfile.mkdtemp(prefix="decidra-checkpoint-")
        sc.setCheckpointDir(current)
    return current


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a table that was written to the shared folder, once its results are kept by checkpoints."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, ends the growth of iterative plans."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unique_name(df: DataFrame, base: str) -> str:
    """A column name that is not yet taken in ``df`` (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


#: The most rows, and the most bytes by their size so far, that are sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 64 << 20


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most so many rows and bytes, else as it is, for a join that shuffles.

    Bytes are those of strings and arrays as text, and 8 for each other column.
    """
    wide = [c for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith(("array", "map", "struct"))]
    size = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in wide), F.lit(8 * len(df.columns)))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= BROADCAST_BYTES else df
