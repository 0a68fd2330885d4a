"""Session, shared folder and staged tables.

A *staged* table is written once to the folder that ``spark.checkpoint.dir`` names (shared by all
executors) and read back, which cuts the lineage and survives the loss of an executor.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "plinth", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with AQE on; ``master`` and ``partitions`` are for tests and the bench."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where none is set (tests), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plinth-"))
    return sc.getCheckpointDir()


class Stage:
    """Tables of one run below the shared folder; ``drop`` removes those no longer read, and ``free`` lets Spark's cleaner see which steps are over, so that their shuffle files go, too, and not only at its periodic collection."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.held: list[Broadcast] = []

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.at}/{name}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.free()

    def hold(self, shared: Broadcast) -> None:
        self.held.append(shared)

    def release(self) -> None:
        """Removes the held broadcasts' files on the driver and the executors; only once all that reads them is staged."""
        while self.held:
            self.held.pop().destroy()

    def free(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Gives the package's code to the executors, once per context: their Python workers may not find it otherwise."""
    sc = spark.sparkContext
    if getattr(sc, "_plinth_shipped", False):
        return
    here = Path(__file__).resolve().parent
    if here.is_dir():
        at = tempfile.mkdtemp(prefix="plinth-")  # on the driver, which hands the file out
        atexit.register(shutil.rmtree, at, True)
        with zipfile.ZipFile(f"{at}/plinth.zip", "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(f"{at}/plinth.zip")
    sc._plinth_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spelling(c):
    """A category's one spelling: lower case, no surrounding blanks, ``_`` for ``-``."""
    return F.translate(F.lower(F.trim(c)), "-", "_")
