"""A stored table whose keys are replaced run by run: a run shows up as a whole or not at all, and only once.

Below the table's folder, data/_run=…/_part=… holds what each run brought, and log/00000001 and so on say which keys a run has
replaced. A run writes its data first, then a manifest of which run each key is read from, and last one small file in the
log, named by the version: that file is the commit. What has no such file is not read, and is written anew when the run is tried again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file(spark: SparkSession, path: str):
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return of, of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def log(spark: SparkSession, path: str) -> dict[int, str]:
    """The committed versions and their runs."""
    of, fs = _file(spark, f"{path}/log")
    names = [f.getPath().getName() for f in fs.listStatus(of)] if fs.exists(of) else []
    return {int(n.split("-", 1)[0]): n.split("-", 1)[1] for n in sorted(names) if n[:1].isdigit()}


def _manifest(spark: SparkSession, path: str, version: int, run: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifests/{version:08}-{run}")


def stage(rows: DataFrame, path: str, keys: list[str], run: str, version: int) -> None:
    """The first half of replace(): all that a run writes, none of which is read before commit()."""
    # a part is named by a hash of its keys, as a folder's name would not tell '01' from 1; a key's rows go to a few files by a
    # hash of the row, so a key with most of the rows is no single task
    parts = rows.withColumn("_part", F.concat(F.lit("k"), F.md5(F.to_json(F.struct(*keys)))))
    parts.repartition("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("overwrite").partitionBy("_part").parquet(f"{path}/data/_run=r{run}")
    brought = parts.select("_part").distinct().select("_part", F.lit(f"r{run}").alias("_run"), F.lit(version).cast("long").alias("version"))
    done = log(rows.sparkSession, path)
    if done:
        before = _manifest(rows.sparkSession, path, max(done), done[max(done)])
        brought = before.join(brought.select("_part"), "_part", "left_anti").unionByName(brought)
    brought.write.mode("overwrite").parquet(f"{path}/manifests/{version:08}-{run}")


def commit(spark: SparkSession, path: str, run: str, version: int) -> None:
    """Makes a staged run the table's next version; an error if another run has become that meanwhile."""
    done = log(spark, path)
    if version in done:
        raise RuntimeError(f"version {version} of {path} is run {done[version]}; stage {run} again")
    of, fs = _file(spark, f"{path}/log/{version:08}-{run}")
    fs.mkdirs(of.getParent())
    fs.create(of, False).close()


def replace(rows: DataFrame, path: str, keys: list[str], run: str) -> None:
    """rows in place of all that the table at path has for their keys; other keys stay, columns may be added.

    `run` names the write: with a name that is in the log already it does nothing, so it can be tried again after any
    failure. One writer at a time. Only rows of the run are written, nothing else is read but the manifest. Keys may be null.
    """
    spark = rows.sparkSession
    done = log(spark, path)
    if run in done.values():
        return
    version = max(done, default=0) + 1
    stage(rows, path, keys, run, version)
    commit(spark, path, run, version)


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the last by default. Columns that a run lacks are null in its rows; files of keys that were replaced are not opened."""
    done = log(spark, path)
    if not done:
        raise ValueError(f"no run has been committed to {path}")
    version = version or max(done)
    manifest = _manifest(spark, path, version, done[version]).drop("version")
    runs = sorted(f"{path}/data/_run=r{run}" for v, run in done.items() if v <= version)
    data = spark.read.option("basePath", f"{path}/data").option("mergeSchema", True).parquet(*runs)
    return data.join(F.broadcast(manifest) if manifest.count() <= 10_000 else manifest, ["_part", "_run"], "left_semi").drop("_part", "_run")


def replace_from_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> None:
    """replace() for each batch of a stream, until it has no more; each batch is a run of its own number."""

    def put(rows: DataFrame, batch: int) -> None:
        replace(rows, path, keys, f"batch{batch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
