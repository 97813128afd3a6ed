"""Tables that outlive a plan: intermediate ones in the shared folder, and versions of a table under a manifest."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_TEMPORARY: list[tuple[SparkSession, str]] = []
MANIFEST = "version long, path string, n_rows long, written double, facts string"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _TEMPORARY:
        with contextlib.suppress(Exception):
            _delete(spark, path)


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset and the master is local (tests), a local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palletry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the process ends."""
    path = f"{shared_dir(spark)}/palletry/{name}-{uuid.uuid4().hex}"
    _TEMPORARY.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` computed once, as a table in the shared folder that goes when the process ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file, a report or a document of settings, wherever Spark can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The complete versions of a table, from its manifest; none where no version was ever completed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def write_version(df: DataFrame, root: str, keep: int | None = None, **facts) -> int:
    """Writes `df` as the next version below `root`; returns its number.

    The data come first, into a folder of their own, and the line of the manifest last, in a commit of its own. A writer that
    dies before it leaves a folder that no reader looks at. `keep` deletes the data of all but the last so many versions.
    """
    spark = df.sparkSession
    last = versions(spark, root).agg(F.max("version").alias("v")).first().v
    version, path = (last or 0) + 1, f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{path}")
    n = spark.read.schema(df.schema).parquet(f"{root}/{path}").count()
    line = (version, path, n, time.time(), json.dumps({**facts, "schema": df.schema.json()}))
    spark.createDataFrame([line], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    if keep is not None:
        for r in versions(spark, root).where(F.col("version") <= version - keep).collect():
            _delete(spark, f"{root}/{r.path}")
    return version


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The last complete version, or the one named; an error if there is none. Of equal numbers the later writer's counts."""
    from pyspark.sql.types import StructType

    found = versions(spark, root)
    row = (found if version is None else found.where(F.col("version") == version)).orderBy(F.desc("version"), F.desc("written")).first()
    if row is None:
        raise FileNotFoundError(f"no complete version{'' if version is None else f' {version}'} below {root}")
    return spark.read.schema(StructType.fromJson(json.loads(json.loads(row.facts)["schema"]))).parquet(f"{root}/{row.path}")
