"""Streams of sources and review events: intake, a log without repeats, and the latest state of every target.

Each function takes a streaming DataFrame and a folder, starts the query and returns it; the readers beside them give the
table it has made so far. Offsets and state live in ``folder``/offsets, so a query that is started again goes on where it stopped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import evidence as e
from ..operators import intake as i


def _into(rows: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    return rows.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()


def document_intake(sources: DataFrame, folder: str) -> StreamingQuery:
    """The inventory (of source_inventory) of every new source, appended; the file sink writes each batch once."""
    return _into(i.source_inventory(sources), folder)


def review_log(events: DataFrame, folder: str, late: str = "7 days") -> StreamingQuery:
    """Events appended without repeats of event_id; the state forgets ids once the event time has gone on by ``late``, and drops what comes later than that."""
    return _into(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]), folder)


def latest_state(events: DataFrame, folder: str, every: int = 10) -> StreamingQuery:
    """The last action of every target; each batch writes the targets it changed. A batch that is run again replaces its own rows.

    Every ``every`` batches the state so far is written as one table and then marked as whole, so that :func:`read_state` reads that
    table and fewer than ``every`` batches, however long the stream has run. A table that breaks off has no mark and is written again.
    """
    last = F.max_by(F.struct("event_id", "action", "area_after"), F.struct("ts", "event_id"))
    state = events.groupBy("collection_id", "target_id").agg(F.count("*").alias("events"), last.alias("m"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("collection_id", "target_id", "events", "m.*").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        spark = batch.sparkSession
        if number % every == every - 1 and _whole(spark, folder) < number:
            _newest(spark, folder, number).write.mode("overwrite").parquet(f"{folder}/whole/{number}")
            spark.range(1).select(F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(f"{folder}/marks")

    return state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()


def _whole(spark: SparkSession, folder: str) -> int:
    """The last batch whose state is written as one table; -1 for none."""
    try:
        marks = spark.read.schema("batch long").parquet(f"{folder}/marks")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    found = marks.agg(F.max("batch")).first()[0]
    return -1 if found is None else found


def _newest(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """The newest row of every target up to a batch: from the last whole table and the batches after it."""
    whole = _whole(spark, folder)
    rows = read_rows(spark, folder).where(F.col("batch") > whole)
    names = [c for c in rows.columns if c != "batch"]
    if whole >= 0:
        rows = rows.unionByName(spark.read.parquet(f"{folder}/whole/{whole}").withColumn("batch", F.lit(whole)))
    if upto is not None:
        rows = rows.where(F.col("batch") <= upto)
    values = [c for c in names if c not in ("collection_id", "target_id")]
    return rows.groupBy("collection_id", "target_id").agg(F.max_by(F.struct(*values), "batch").alias("m")).select("collection_id", "target_id", "m.*")


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows")


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of every target that :func:`latest_state` has written."""
    return _newest(spark, folder)


def page_diagnosis(pages: DataFrame, drawings: DataFrame, spans: DataFrame, folder: str) -> StreamingQuery:
    """Source types of new pages, and the diagnosis of every collection that gets any, from all its pages so far.

    ``drawings`` and ``spans`` are tables that hold what the pages show. A batch writes its pages, then what follows from these and those of earlier batches, each to a
    folder of its own number, so one that breaks off and runs again replaces its own rows and sees no later ones. :func:`read_diagnosis` gives the newest row of each collection.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        e.source_type(batch).write.mode("overwrite").parquet(f"{folder}/pages/batch={number}")
        so_far = spark.read.parquet(f"{folder}/pages").where(F.col("batch") <= number)
        touched = so_far.where(F.col("batch") == number).select("collection_id").distinct()
        of = lambda rows: rows.join(touched.hint("shuffle_hash"), "collection_id", "left_semi")
        e.diagnose(of(drawings), of(spans), of(so_far)).write.mode("overwrite").parquet(f"{folder}/diagnosis/batch={number}")

    return pages.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()


def read_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    """The newest diagnosis of every collection that :func:`page_diagnosis` has seen."""
    rows = spark.read.parquet(f"{folder}/diagnosis")
    names = [c for c in rows.columns if c not in ("collection_id", "batch")]
    return rows.groupBy("collection_id").agg(F.max_by(F.struct(*names), "batch").alias("m")).select("collection_id", "m.*")
