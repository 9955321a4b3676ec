"""Replication: a stream of a primary's committed versions, whose writes are applied to a replica's log.

The stream reads manifest versions, so what was never committed is never seen. Each version names every batch of its time; of those in a
micro-batch the newest counts. The replica takes writes above its last sequence number, so versions may repeat or come in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.changelog import ChangeLog
from ..sources.manifest import Version


def missing(log: DataFrame, last_applied: int) -> DataFrame:
    """What a replica that has everything up to ``last_applied`` still needs."""
    return log.where(F.col("seq") > last_applied)


def deduplicated(rows: DataFrame) -> DataFrame:
    """Each write once."""
    return rows.dropDuplicates(["seq"])


def version_stream(spark: SparkSession, primary: ChangeLog, versions_per_trigger: int | None = None) -> DataFrame:
    """The primary's committed versions as a stream (one small text each)."""
    reader = spark.readStream.option("wholetext", "true").option("pathGlobFilter", "*.json")
    if versions_per_trigger:
        reader = reader.option("maxFilesPerTrigger", versions_per_trigger)
    return reader.text(f"{primary.root}/versions")


def apply_version(primary: ChangeLog, replica: ChangeLog, version: Version) -> int:
    """Brings the replica to a version of the primary; returns its last sequence number.

    Only batches with numbers above the replica's last are read. Where compaction without history or pruning has taken writes that the replica
    lacks, its log is made anew from the writes that are kept.
    """
    start = replica.manifest.current().next_seq
    if version.next_seq <= start:
        return start - 1
    log = primary.history_of(version)
    news = sorted((b for b in log if b.max_seq >= start), key=lambda b: b.min_seq)
    at = start
    for b in news:  # whole batches side by side
        if b.min_seq <= at and b.rows == b.max_seq - b.min_seq + 1:
            at = max(at, b.max_seq + 1)
    if at >= version.next_seq:
        return replica.replicate(primary.whole(primary.rows_of(news)))
    replica.renew(primary.whole(primary.rows_of(log)).withColumn("origin", F.lit("replica")), version.next_seq)
    return version.next_seq - 1


def apply_to(primary: ChangeLog, replica: ChangeLog):
    """A ``foreachBatch`` function over ``version_stream``: a batch that comes again changes nothing."""

    def run(rows: DataFrame, _: int) -> None:
        texts = rows.withColumn("n", F.get_json_object("value", "$.number").cast("long")).agg(F.max_by("value", "n").alias("value")).first()
        if texts["value"]:
            apply_version(primary, replica, Version.of(texts["value"]))

    return run


def replicate(spark: SparkSession, primary: ChangeLog, replica: ChangeLog, checkpoint: str, versions_per_trigger: int | None = None, once: bool = True) -> StreamingQuery:
    """Starts replication; ``checkpoint`` (on storage that all machines share) lets it go on where it stopped."""
    writer = version_stream(spark, primary, versions_per_trigger).writeStream.foreachBatch(apply_to(primary, replica)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
