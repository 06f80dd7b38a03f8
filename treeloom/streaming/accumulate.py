"""Incremental pooling: token entries arrive in files; the first vector of every part so far is the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.operators.pooling import Pooling, first_parts, part_candidates, pool
from treeloom.session import drop_table

#: Batches of a generation of the state that are merged into the next.
MERGE_AFTER = 20
_GENERATION, _BATCH, _READY = "generation", "batch_id", "_READY"


def accumulate_stream(spark: SparkSession, source: str, schema: T.StructType, state: str, checkpoint: str, pattern: str = "*.parquet", files_per_trigger: int | None = None, merge_after: int = MERGE_AFTER) -> None:
    """Read all new files of ``source`` and add their parts to the state below ``state``.

    The state holds one row per part and batch, of which the earliest encoded counts, so that a part that arrives again - in the
    same file, a later one, or because a batch runs again after a failure - counts once, and the result is that of batch pooling
    however the files fall into batches.  After ``merge_after`` batches they are merged: the state grows with the parts, not with the batches.
    The checkpoint remembers which files were read.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        held = _generations(session, state)
        now = max(held, default=0)
        first_parts(part_candidates(batch)).write.mode("overwrite").parquet(f"{state}/{_GENERATION}={now}/{_BATCH}={batch_id}")
        if not held:
            _mark(session, f"{state}/{_GENERATION}={now}")
        merge(session, state, merge_after)

    reader.parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _system(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _mark(spark: SparkSession, folder: str) -> None:
    system, at = _system(spark, f"{folder}/{_READY}")
    system.create(at, True).close()


def _folders(spark: SparkSession, path: str, prefix: str) -> list[tuple[int, str]]:
    system, at = _system(spark, path)
    if not system.exists(at):
        return []
    names = [s.getPath().getName() for s in system.listStatus(at)]
    return sorted((int(n.removeprefix(f"{prefix}=")), f"{path}/{n}") for n in names if n.startswith(f"{prefix}="))


def _generations(spark: SparkSession, state: str) -> dict[int, str]:
    """Those that are complete."""
    out = {}
    for number, path in _folders(spark, state, _GENERATION):
        system, at = _system(spark, f"{path}/{_READY}")
        if system.exists(at):
            out[number] = path
    return out


def merge(spark: SparkSession, state: str, least: int = 2) -> bool:
    """Merge the batches of the newest generation, if it has at least so many, into one table of the next, and delete the older ones.

    The new generation counts from the moment it is marked as ready; a merge that fails before leaves the old one in use.
    """
    held = _generations(spark, state)
    if not held:
        return False
    now = max(held)
    if len(_folders(spark, held[now], _BATCH)) < least:
        return False
    after = f"{state}/{_GENERATION}={now + 1}"
    first_parts(_parts(spark, held[now])).write.mode("overwrite").parquet(f"{after}/{_BATCH}=-1")
    _mark(spark, after)
    for path in held.values():
        drop_table(spark, path)
    return True


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select("patent_id", "claim_id", "best")


def finalize(spark: SparkSession, state: str, depths: DataFrame, p: Pooling) -> DataFrame:
    """(patent_id, vector, weight_sum, n_parts) from the state so far, for any weighting; parts without a depth are left out."""
    held = _generations(spark, state)
    if not held:
        raise ValueError("there is no state yet")
    parts = first_parts(_parts(spark, held[max(held)])).select("patent_id", "claim_id", F.col("best.v").alias("vector"))
    return pool(parts.join(depths, ["patent_id", "claim_id"]), p)


def event_windows(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums of a stream (or table) in tumbling windows, with a watermark; null times are left out, times without a zone are the session's."""
    return events.filter(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def stream_windows(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, mode: str = "complete", pattern: str = "*.parquet", files_per_trigger: int | None = None, **kw: str) -> None:
    """Run :func:`event_windows` over the files of ``source`` as a stream into Parquet.

    ``complete`` rewrites all windows with each batch and loses nothing; ``append`` writes a window once, when the watermark has passed its
    end, drops rows that come later than that, and keeps only open windows in memory.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    windows = event_windows(reader.parquet(source), **kw)

    def put(batch: DataFrame, batch_id: int) -> None:
        target = out if mode == "complete" else f"{out}/{_BATCH}={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    windows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
