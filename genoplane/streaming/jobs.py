"""Download requests as a stream of JSON files, each job done once, and the sweep of old downloads.

foreachBatch delivers a batch at least once. The ledger, to which rows are only added,
makes the work idempotent: a job is PROCESSING, with the number of its attempt, before it
is worked on, and READY or FAILED after it. A crash between these leaves the attempt in
the ledger, so attempts are counted over restarts, and a job whose work kills the process
ends as FAILED. Output is written by job, and written anew by a later attempt.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.lineage import cut

log = logging.getLogger(__name__)

REQUEST = "job_id string, lines array<string>, submitted timestamp"
LEDGER = "job_id string, state string, attempt int, reason string, changed timestamp, batch long"
STATES = ("QUEUED", "PROCESSING", "READY", "FAILED", "EXPIRED")
#: States after which a job is not worked on again.
ENDED = ("READY", "FAILED", "EXPIRED")
MOST_ATTEMPTS, MOST_ROWS = 3, 100_000
#: Reasons of failures.
TOO_LARGE, EXHAUSTED, FAILED = "too many lines", "attempts exhausted", "processing failed"


def job_counts(status: DataFrame) -> DataFrame:
    """(state, day, jobs) of a status table (state, changed)."""
    return status.groupBy("state", F.to_date("changed").alias("day")).agg(F.count("*").alias("jobs"))


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All rows of a ledger, none if it is not there yet."""
    at, system = _path(spark, ledger)
    return spark.read.schema(LEDGER).parquet(ledger) if system.exists(at) else spark.createDataFrame([], LEDGER)


def append(jobs: DataFrame, ledger: str, state: str, batch: int | None, attempt: Column | None = None, reason: str | None = None) -> None:
    """Adds a row with this state for each job (job_id, attempt)."""
    rows = jobs.select("job_id", F.lit(state).alias("state"), (F.col("attempt") if attempt is None else attempt).cast("int").alias("attempt"), F.lit(reason).cast("string").alias("reason"), F.current_timestamp().alias("changed"), F.lit(batch).cast("long").alias("batch"))
    rows.write.mode("append").parquet(ledger)


def job_states(ledger: DataFrame) -> DataFrame:
    """(job_id, state, attempt, reason): where each job stands. An end counts over what is in work, expiry over other ends."""
    rank = F.array_position(F.array(*map(F.lit, ("QUEUED", "PROCESSING", "FAILED", "READY", "EXPIRED"))), F.col("state"))
    last = F.max_by(F.struct("state", "reason"), F.struct(rank, "attempt", "changed"))
    return ledger.groupBy("job_id").agg(last.alias("last"), F.max("attempt").alias("attempt")).select("job_id", "last.state", "attempt", "last.reason")


def run_jobs(spark: SparkSession, inbox: str, ledger: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], output: str, most_rows: int = MOST_ROWS, attempts: int = MOST_ATTEMPTS) -> StreamingQuery:
    """Starts the stream: new requests of inbox are deduplicated against the ledger, worked on and written by job id.

    A job of more than most_rows lines is FAILED. Where work fails, each job of the batch is tried alone, up to
    attempts times in all, crashed attempts included, so that one bad job fails alone.
    """

    def attempt(jobs: DataFrame) -> bool:
        lines = jobs.select("job_id", F.posexplode("lines").alias("line_no", "line"))
        try:
            work(lines).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(output)
            return True
        except Exception:  # noqa: BLE001  whatever work raises counts as a failed attempt
            log.exception("a download failed")
            return False

    def batch(requests: DataFrame, number: int) -> None:
        states = job_states(read_ledger(spark, ledger))
        known = states.select("job_id", F.col("state").alias("known"), F.coalesce("attempt", F.lit(0)).alias("attempt"))
        fresh = requests.dropDuplicates(["job_id"]).join(known, "job_id", "left").filter(~F.coalesce(F.col("known").isin(*ENDED), F.lit(False)))
        # The ledger changes below, and a cached plan would be made anew with it: what was decided is written.
        fresh = cut(fresh.withColumn("attempt", F.coalesce("attempt", F.lit(0))))
        too_many, spent = F.size("lines") > most_rows, F.col("attempt") >= attempts
        append(fresh.filter(too_many), ledger, "FAILED", number, reason=TOO_LARGE)
        append(fresh.filter(~too_many & spent), ledger, "FAILED", number, reason=EXHAUSTED)
        left = fresh.filter(~too_many & ~spent)
        append(left, ledger, "PROCESSING", number, F.col("attempt") + 1)
        if attempt(left):
            append(left, ledger, "READY", number, F.col("attempt") + 1)
            return
        for row in left.select("job_id", "attempt").toLocalIterator():  # jobs of one micro-batch, one at a time
            alone, good = left.filter(F.col("job_id") == row.job_id), False
            tried = row.attempt + 1
            while not good and tried < attempts:
                tried += 1
                append(alone, ledger, "PROCESSING", number, F.lit(tried))
                good = attempt(alone)
            append(alone, ledger, "READY" if good else "FAILED", number, F.lit(tried), None if good else FAILED)

    stream = spark.readStream.schema(REQUEST).json(inbox)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expire(ledger: DataFrame, days: int = 30) -> DataFrame:
    """(job_id, attempt) of finished jobs older than so many days, not expired yet."""
    gone = ledger.filter("state = 'EXPIRED'").select("job_id")
    old = ledger.filter((F.col("state") == "READY") & (F.col("changed") < F.current_timestamp() - F.make_interval(days=F.lit(days))))
    return old.join(gone, "job_id", "left_anti").groupBy("job_id").agg(F.max("attempt").alias("attempt"))


@dataclass
class Swept:
    """What a sweep removed."""

    items: int = 0
    bytes: int = 0


def sweep_jobs(spark: SparkSession, ledger: str, output: str, days: int = 30) -> Swept:
    """Deletes the output of jobs that are older than so many days, and then says so in the ledger.

    The ledger comes last: after a crash between, the next sweep finds nothing to delete and adds the row.
    """
    old, swept = cut(expire(read_ledger(spark, ledger), days)), Swept()
    for row in old.select("job_id").toLocalIterator():
        at, system = _path(spark, f"{output}/job_id={_escaped(spark, row.job_id)}")
        if system.exists(at):
            swept.bytes += system.getContentSummary(at).getLength()
            system.delete(at, True)
            swept.items += 1
    append(old, ledger, "EXPIRED", None)
    return swept


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition's value as Spark writes it in a path."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def sweep_files(spark: SparkSession, folder: str, suffix: str = ".csv.gz", days: float = 30, now: float | None = None) -> Swept:
    """Deletes the files of a folder that end in suffix and were last changed so many days ago; others, folders and newer files stay.

    A folder that is not there, and a file that is gone meanwhile, are no error.
    """
    at, system = _path(spark, folder)
    swept = Swept()
    if not system.exists(at):
        return swept
    cutoff = ((time.time() if now is None else now) - days * 86_400) * 1000
    for status in system.listStatus(at):
        if status.isFile() and status.getPath().getName().endswith(suffix) and status.getModificationTime() <= cutoff and system.delete(status.getPath(), False):
            swept.items += 1
            swept.bytes += status.getLen()
    return swept
