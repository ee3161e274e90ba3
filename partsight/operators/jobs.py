"""The job queue as snapshot-in, snapshot-out transforms.

Every merge is a ``groupBy`` on (kind, dedup_key) followed by equi-joins; requests for a hot key are
combined before they meet the snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["kind", "dedup_key"]
# Retry timing in seconds.
BACKOFF_BASE_S = 10
BACKOFF_MAX_S = 3600


def backoff_ceiling(attempts: Column) -> Column:
    """Upper end of the delay after the n-th failed attempt (the jitter below it is random and
    left to the caller)."""
    doublings = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(40))
    return F.least(F.lit(BACKOFF_MAX_S), BACKOFF_BASE_S * F.pow(F.lit(2), doublings)).cast("bigint")


def due_jobs(jobs: DataFrame, as_of: Column, k: int) -> DataFrame:
    """The next ``k`` due jobs overall."""
    due = (F.col("status") == "queued") & (F.col("run_after") <= as_of)
    return jobs.where(due).orderBy("run_after", "job_id").limit(k)


def due_jobs_per_kind(jobs: DataFrame, as_of: Column, k: int) -> DataFrame:
    """E06 per kind: the rank filter is applied before the shuffle as well (window group limit)."""
    due = (F.col("status") == "queued") & (F.col("run_after") <= as_of)
    w = Window.partitionBy("kind").orderBy("run_after", "job_id")
    return jobs.where(due).withColumn("position", F.row_number().over(w)).where(
        F.col("position") <= k
    )


def merge_enqueue(queued: DataFrame, requests: DataFrame) -> DataFrame:
    """One queued row per key. A waiting row is pulled forward to the earliest request unless
    it is in error backoff; a key without one gets a new row."""
    wanted = requests.groupBy(*KEY).agg(
        F.min("run_after").alias("want"), F.min("request_id").alias("request_id"),
        F.count(F.lit(1)).alias("requests"),
    )
    have = queued.select(*KEY, "job_id", F.col("run_after").alias("have"), "last_error_code")
    j = have.join(wanted, KEY, "full")
    action = (
        F.when(F.col("job_id").isNull(), "inserted")
        .when(F.col("requests").isNull(), "unchanged")
        .when(F.col("last_error_code").isNotNull(), "in_backoff")
        .when(F.col("want") < F.col("have"), "pulled_forward")
        .otherwise("unchanged")
    )
    return j.withColumn("action", action).select(
        *KEY, "job_id", "action",
        F.when(F.col("action") == "in_backoff", F.col("have"))
        .otherwise(F.least("have", "want"))
        .alias("run_after"),
        F.coalesce("requests", F.lit(0)).alias("requests"),
    )


def requeue(
    jobs: DataFrame, selected: DataFrame, *, run_after: Column, error_code: str | None = None,
    refund: int = 0, reset_attempts: bool = False,
) -> DataFrame:
    """E08 (E14 with ``refund=1``, E15 with ``reset_attempts``): put ``selected`` jobs back.

    ``queued`` if the key has no queued row and the job is the first of its key, else
    ``superseded``; the row that stays queued inherits the largest attempt count. Returns the
    touched rows: the selected jobs and the inheriting twins.
    """
    attempts = F.lit(0) if reset_attempts else F.greatest(F.col("attempts") - refund, F.lit(0))
    back = selected.select("job_id", *KEY, "version", attempts.cast("bigint").alias("attempts"),
                           run_after.alias("run_after"))
    per_key = back.groupBy(*KEY).agg(
        F.min("job_id").alias("first_id"), F.max("attempts").alias("key_attempts")
    )
    twins = (
        jobs.where(F.col("status") == "queued")
        .groupBy(*KEY)
        .agg(F.min("job_id").alias("twin_id"))
    )
    plan = per_key.join(twins, KEY, "left")
    wins = F.col("twin_id").isNull() & (F.col("job_id") == F.col("first_id"))
    inherit = F.lit(False) if reset_attempts else F.lit(True)
    moved = back.join(plan, KEY).select(
        "job_id", *KEY,
        F.when(wins, "queued").otherwise("superseded").alias("status"),
        F.when(wins & inherit, F.col("key_attempts")).otherwise(F.col("attempts")).alias("attempts"),
        F.when(wins, F.col("run_after")).alias("run_after"),
        F.lit(error_code).alias("last_error_code"),
        (F.col("version") + 1).alias("version"),
    )
    if reset_attempts:
        return moved
    heirs = (
        jobs.where(F.col("status") == "queued")
        .join(plan.where(F.col("twin_id").isNotNull()), KEY)
        .where(F.col("attempts") < F.col("key_attempts"))
        .select(
            "job_id", *KEY, "status", F.col("key_attempts").alias("attempts"), "run_after",
            "last_error_code", "version",
        )
    )
    return moved.unionByName(heirs)


def failures(running: DataFrame) -> DataFrame:
    """What a failed attempt does: ``dead`` (with an alert) or a requeue with backoff."""
    dead = F.col("attempts") >= F.col("max_attempts")
    return running.withColumns(
        {
            "next_status": F.when(dead, "dead").otherwise("requeue"),
            "delay_ceiling_s": F.when(~dead, backoff_ceiling(F.col("attempts"))),
            "alert": dead,
        }
    )


def orphans(jobs: DataFrame, worker: str) -> DataFrame:
    """Running rows that the current worker does not own (NULL owner included)."""
    return jobs.where(
        (F.col("status") == "running") & ~F.col("claimed_by").eqNullSafe(F.lit(worker))
    )


def recover_orphans(jobs: DataFrame, worker: str, as_of: Column) -> DataFrame:
    """Orphans go ``dead`` when their attempts are used up, else back with backoff."""
    judged = failures(orphans(jobs, worker))
    dead = judged.where(F.col("next_status") == "dead").select(
        "job_id", *KEY, F.lit("dead").alias("status"), "attempts",
        F.lit(None).cast("timestamp").alias("run_after"),
        F.lit("worker_lost").alias("last_error_code"), (F.col("version") + 1).alias("version"),
    )
    back = judged.where(F.col("next_status") == "requeue")
    due = F.timestamp_seconds(F.unix_seconds(as_of) + backoff_ceiling(F.col("attempts")))
    return dead.unionByName(requeue(jobs, back, run_after=due, error_code="worker_lost"))


def resolve_cas(rows: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals against a snapshot. One applies if status and version match and no earlier
    matching proposal took the row; the rest are reported as conflicts."""
    base = rows.select("job_id", F.col("status").alias("s"), F.col("version").alias("v"))
    judged = proposals.join(base, "job_id", "left").withColumn(
        "matches",
        F.coalesce(
            (F.col("expected_status") == F.col("s")) & (F.col("expected_version") == F.col("v")),
            F.lit(False),
        ),
    )
    winner = judged.where("matches").groupBy("job_id").agg(F.min("proposal_id").alias("winner"))
    return judged.join(winner, "job_id", "left").select(
        "proposal_id", "job_id",
        F.when(~F.col("matches"), "conflict")
        .when(F.col("proposal_id") == F.col("winner"), "applied")
        .otherwise("lost_race")
        .alias("result"),
        F.when(F.col("proposal_id") == F.col("winner"), F.col("v") + 1).alias("new_version"),
    )


def complete_jobs(jobs: DataFrame, completions: DataFrame) -> DataFrame:
    """``done`` only for the worker that holds the running job."""
    held = jobs.where(F.col("status") == "running").select(
        "job_id", F.col("claimed_by").alias("owner")
    )
    return completions.join(held, "job_id", "left").withColumn(
        "applied", F.coalesce(F.col("owner") == F.col("worker"), F.lit(False))
    )
