"""Intermediate tables in the folder that the whole cluster shares.

Expensive results that are read more than once, or between rounds of an iteration, are written as
Parquet below ``spark.checkpoint.dir``: the lineage ends there, so a lost executor costs a reread.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, in local runs only, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="crawlvis-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once, written to the shared folder and read from there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._crawlvis_path = path
    return table


def dropped(*tables: DataFrame | None) -> None:
    """Deletes what ``written`` wrote for the tables themselves, once nothing that is still to be computed reads them. Others are left alone."""
    for table in tables:
        if path := getattr(table, "_crawlvis_path", None):
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def written_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """A file of that name in a folder of its own in the shared folder, and its path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{new_path(spark, 'file')}/{name}")
    out = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(place)
    out.write(bytearray(data))
    out.close()
    return place.toString()


#: The option that says, in bytes, below which size an input comes in so few row groups that most cores would be idle; and its default.
SPREAD_BELOW, SMALL = "spark.crawlvis.spreadBelow", 64 << 20


#: Bytes of pages that a task gets of a larger input, about: a page takes long to read, and a row group may hold any number of them.
EACH = 8 << 20


def spread(df: DataFrame, each: int | None = None) -> DataFrame:
    """A small input dealt evenly over all cores, before work that takes long for each row; a larger one as it is, or by ``each`` bytes a task. Rows are the same in any case."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least, cores = int(df.sparkSession.conf.get(SPREAD_BELOW, str(SMALL))), df.sparkSession.sparkContext.defaultParallelism
    if size < least:
        return df.repartition(cores)
    return df.repartition(max(cores, -(-size // each))) if each and least else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless the environment lets them import it from where it is."""
    package = Path(__file__).resolve().parents[1]
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_crawlvis_shipped", False):
        return
    code = io.BytesIO()
    with zipfile.ZipFile(code, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(written_bytes(spark, "crawlvis-code.zip", code.getvalue()))
    spark.sparkContext._crawlvis_shipped = True
