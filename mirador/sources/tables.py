"""Reading the named tables of a folder, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``: one parquet file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, so that a lost executor costs no recomputation.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only where it is unset and all runs in one
    process (local tests) a temporary one is made; on a cluster that would be the driver's disk, so it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not is_local(sc.master):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mirador-checkpoint-"))
    return df.checkpoint(eager=True)


def is_local(master: str) -> bool:
    """Whether all tasks run in the driver's process."""
    return master == "local" or master.startswith("local[")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, on whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


#: A side is broadcast only if it has at most this many rows, and the caller states a bound for the bytes of a row.
BROADCAST_ROWS = 400_000


def checked_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` marked for broadcast if a count shows at most ``rows`` rows; else as it is (a shuffle join under AQE).

    ``small`` should be cut (:func:`cut`) before, or the count computes it twice.
    """
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors (once per context), so that Python workers can import it wherever they run.

    The archive is made on the driver and served by Spark; executors need no path of the driver's machine.
    """
    import os
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_mirador_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="mirador-package-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "mirador"), "zip", root, "mirador"))
    sc._mirador_shipped = True
