"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of ASCII white space, which separates words.
BLANKS = r"[\x20\x09-\x0D]+"
#: Folders of the tables that materialize() wrote and nothing has deleted, and which table each holds.
_LIVE: set[str] = set()
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a new local one where that is unset in local mode."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="kinetra-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/kinetra-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts lineage, survives lost executors, has real sizes."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    _LIVE.add(path)
    return table


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder under the shared one."""
    _LIVE.discard(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialized tables that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, _FOLDERS.pop(table))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were materialized inside it: those that the lazy results of operators read."""
    before = set(_LIVE)
    try:
        yield
    finally:
        for path in _LIVE - before:
            delete(spark, path)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """materialize(build()), without the tables that build() has materialized for it."""
    before = set(_LIVE)
    table = materialize(build())
    for path in _LIVE - before - {_FOLDERS[table]}:
        delete(spark, path)
    return table


def words(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow, with this package shipped to the executors first, so that their Python workers can import it."""
    sc = df.sparkSession.sparkContext
    if not any(f.endswith("/kinetra-package.zip") for f in sc.listFiles):
        package = Path(__file__).resolve().parent.parent
        path = f"{tempfile.mkdtemp(prefix='kinetra-')}/kinetra-package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(path)
    return df.mapInArrow(function, schema)


def text_key(text: Column) -> Column:
    """64-bit hash of a text, null for a null text; with doc_id it names a document, so rows repeated in full are one."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
