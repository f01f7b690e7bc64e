"""Continuous checking: micro-batches of segments against the vault and against all that came before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termweave.operators import consistency as C

SEGMENT = "seg_ord bigint, sid string, file string, source string, target string"


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], cfg: C.Config = C.Config(), vault: DataFrame | None = None, state: str | None = None) -> StreamingQuery:
    """Runs until what lies in the folder (Parquet segments) is done; sink gets, for each batch and with its number, the
    flags of the n-grams that the batch holds, over all segments so far.

    state (a folder; beside the checkpoint if not given) keeps the counts of each batch, by its number, so a batch that
    is run again replaces its own.
    """
    kept = state or f"{checkpoint.rstrip('/')}-counts"

    def each(rows: DataFrame, number: int) -> None:
        C.counts(C.occurrences(rows, cfg)).write.mode("overwrite").parquet(f"{kept}/batch={number}")
        far = spark.read.parquet(kept).where(F.col("batch") <= number)
        touched = far.where(F.col("batch") == number).select("key").distinct()
        sink(C.flags_of(C.summed(far.join(touched, "key", "left_semi")), cfg, vault), number)

    stream = spark.readStream.schema(SEGMENT).parquet(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_variants(spark: SparkSession, folder: str, cfg: C.Config = C.Config()) -> DataFrame:
    """A streaming frame: count of each (key, span) so far, for update mode."""
    occ = C.occurrences(spark.readStream.schema(SEGMENT).parquet(folder), cfg)
    return occ.where("span <> ''").groupBy("key", "span").count()
