"""Tables that are written once and read by many queries, and stages that switch from version to version in one step."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WRITTEN: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or that of the context. A temporary one only on a local master; elsewhere none is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` written as Parquet under the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, inputs: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from the folder ``inputs``: built and written as Parquet at its first use in a session, read back afterwards.

    Input folders are taken as fixed while a session lasts; ``forget`` drops what is known of one.
    """
    key = (spark.sparkContext.applicationId, inputs, name)
    if key not in _WRITTEN:
        path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
        df = build()
        df.write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def forget(inputs: str) -> None:
    for key in [k for k in _WRITTEN if k[1] == inputs]:
        del _WRITTEN[key]


# ---------------------------------------------------------------- stages under a lasting path: versions and a pointer

#: The file that says which folders a stage consists of.
POINTER = "_CURRENT"
BUCKETS = 64


def files(spark: SparkSession, path: str):
    """Spark's own view of file systems: (the class of paths, the file system of ``path``)."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p, p(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _read_pointer(spark: SparkSession, path: str) -> dict | None:
    p, fs = files(spark, path)
    at = p(f"{path}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _switch(spark: SparkSession, path: str, pointer: dict) -> None:
    """Replace the pointer in one step: written under another name, then renamed over the old one."""
    p, fs = files(spark, path)
    new = p(f"{path}/_{uuid.uuid4().hex}")
    out = fs.create(new)
    try:
        out.write(bytearray(json.dumps(pointer).encode()))
    finally:
        out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(p(f"{path}/{POINTER}")), how)


def save_stage(df: DataFrame, path: str) -> DataFrame:
    """A stage's result as a new version of ``path``; read back.

    A version has a folder of its own, and readers follow a pointer that is replaced last and in one step, so a run that dies half-way, or a reader in between, finds the version before. ``df`` may
    read the stage that it replaces. The file system has to rename files atomically. There is one writer at a time; of several, the last to switch wins. ``prune`` removes old versions.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    _switch(spark, path, {"folders": [version]})
    return load_stage(spark, path)


def load_stage(spark: SparkSession, path: str) -> DataFrame:
    """A saved stage's current version (models, figures, tables); an error that names it where it is absent."""
    pointer = _read_pointer(spark, path)
    if pointer is None:
        raise FileNotFoundError(f"no stage at {path}; run the batch that writes it")
    return spark.read.parquet(*[f"{path}/{f}" for f in pointer["folders"]])


def prune(spark: SparkSession, path: str) -> int:
    """Remove the folders that the current version doesn't use, and say how many. Not while readers may still use an older version."""
    pointer = _read_pointer(spark, path)
    if pointer is None:
        return 0
    p, fs = files(spark, path)
    used, gone = {f.split("/")[0] for f in pointer["folders"]}, 0
    for status in fs.listStatus(p(path)):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in used:
            gone += bool(fs.delete(status.getPath(), True))
    return gone


def upsert_stage(new: DataFrame, path: str, key: str, version: str = "updated_at") -> DataFrame:
    """Bring rows into a stage: one row for each key, the new one or else the latest. Read back.

    The stage lies in 64 buckets by a hash of the key. Only buckets that get rows are read, merged and written, to a folder of their own; the pointer then takes these and keeps the others, in one step. A stage that
    isn't in buckets yet, or isn't there, is written whole the first time. New rows of one key: the one of latest ``version`` stays. Null keys are one key. No new rows: nothing changes.
    """
    spark = new.sparkSession
    bucket = lambda df: F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")  # noqa: E731, ARG005
    fresh = written(new.withColumn("_bucket", bucket(new)).withColumn("_new", F.lit(1)))
    pointer = _read_pointer(spark, path)
    buckets = dict((pointer or {}).get("buckets") or {})
    touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # at most 64
    if pointer and not buckets:
        old, touched = load_stage(spark, path), list(range(BUCKETS))
    else:
        folders = [f"{path}/{buckets[str(b)]}" for b in touched if str(b) in buckets]
        old = spark.read.parquet(*folders) if folders else None
    if not touched:
        return load_stage(spark, path)
    rows = fresh if old is None else fresh.unionByName(old.withColumn("_bucket", bucket(old)).withColumn("_new", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("_bucket", key).orderBy(F.desc("_new"), F.desc_nulls_last(version))
    merged = rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k", "_new")
    name = f"v-{uuid.uuid4().hex}"
    merged.write.partitionBy("_bucket").parquet(f"{path}/{name}")
    there = {int(r[0]) for r in merged.select("_bucket").distinct().collect()}
    buckets |= {str(b): f"{name}/_bucket={b}" for b in touched if b in there}
    _switch(spark, path, {"folders": sorted(buckets.values()), "buckets": buckets})
    return load_stage(spark, path)
