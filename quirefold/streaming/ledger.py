"""The ledger of requests: admission, newest entries, durations, windows, and the same on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Answers to a request.
ACCEPTED, INVALID, BUSY, UNREADABLE = 202, 400, 429, 500


def admitted(requests: DataFrame, queue: str, limit: int) -> DataFrame:
    """With status_code: invalid, past the limit of its queue, unreadable, or accepted."""
    place = F.row_number().over(Window.partitionBy(queue).orderBy("queued_at", "event_id"))
    code = F.when(~F.col("valid"), INVALID).when(F.col("_place") > limit, BUSY).when(~F.col("readable"), UNREADABLE).otherwise(ACCEPTED)
    return requests.withColumn("_place", place).withColumn("status_code", code).drop("_place")


def newest(requests: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The newest entry of each key, and the newest `most` of these; an entry that comes again takes its key's place."""
    last = requests.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("m")).select("m.*")
    return last.orderBy(*[F.col(c).desc() for c in order]).limit(most)


def looked_up(ids: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, status, code): 200, or 404 where there is none."""
    r = requests.select(F.col("event_id").alias("id"), "status", F.lit(200).alias("_found"))
    return ids.join(r, "id", "left").select("id", "status", F.coalesce("_found", F.lit(404)).alias("code"))


def durations(requests: DataFrame, now=None) -> DataFrame:
    """With queue_s, process_s and total_s; what has not begun or ended lasts until now."""
    now = F.localtimestamp() if now is None else now
    seconds = lambda a, b: (F.expr(f"timestampdiff(MICROSECOND, {a}, {b})") / 1_000_000).cast("double")
    r = requests.withColumn("_start", F.coalesce("process_start", now)).withColumn("_end", F.coalesce("process_end", now))
    return r.withColumn("queue_s", seconds("queued_at", "_start")).withColumn("process_s", F.when(F.col("process_start").isNotNull(), seconds("_start", "_end"))).withColumn("total_s", seconds("queued_at", "_end")).drop("_start", "_end")


def hourly(timed: DataFrame) -> DataFrame:
    """hour (since 2024), n, n_error, process_s."""
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', queued_at)")
    return timed.groupBy(hour.alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("n_error"), F.sum("process_s").alias("process_s"))


def sessions(requests: DataFrame, gap: str) -> DataFrame:
    """user_id, n and seconds of each run of a user's requests with no longer gap."""
    s = requests.groupBy("user_id", F.session_window("queued_at", gap)).agg(F.count("*").alias("n"), F.min("queued_at").alias("a"), F.max("queued_at").alias("b"))
    return s.select("user_id", "n", F.expr("timestampdiff(SECOND, a, b)").alias("seconds"))


def response(rows: DataFrame, fields: list[str], key: str) -> DataFrame:
    """(key, body): the allowed fields as JSON, without nulls."""
    return rows.select(key, F.to_json(F.struct(*fields)).alias("body"))


def windowed(stream: DataFrame, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Requests and errors per window of event time; what comes later than `late` is left out. For streams with a timestamp queued_at."""
    at = F.window("queued_at", length, slide) if slide else F.window("queued_at", length)
    got = stream.withWatermark("queued_at", late).groupBy(at.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("n_error"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "n_error")


# The states of a request, in order.
STATES = ("loading", "queued", "processing", "finished", "error")


def tracked(stream: DataFrame, keep: str = "1 hour") -> DataFrame:
    """identifier, status, n_changes after each batch, of rows (identifier, status, at): a state moves forward only, and is dropped `keep` after its last change."""
    order = {s: k for k, s in enumerate(STATES)}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, n = state.get if state.exists else ("loading", 0)
        for batch in batches:
            for new in batch.sort_values("at")["status"]:
                if order.get(new, -1) > order[status] and status not in ("finished", "error"):
                    status, n = new, n + 1
        state.update((status, n))
        state.setTimeoutDuration(int(pd.Timedelta(keep).total_seconds() * 1000))
        yield pd.DataFrame({"identifier": [key[0]], "status": [status], "n_changes": [n]})

    return stream.groupBy("identifier").applyInPandasWithState(step, "identifier string, status string, n_changes long", "status string, n long", "update", "ProcessingTimeTimeout")


def completed(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests (identifier, ...) with status, process_end and error_message of their results (identifier, at, error): "finished", or "error" with its message; of several results the first counts."""
    first = results.groupBy("identifier").agg(F.min_by(F.struct("at", "error"), "at").alias("_r"))
    has = F.col("_r").isNotNull()
    done = requests.join(first, "identifier", "left")
    return done.withColumn("status", F.when(has & F.col("_r.error").isNotNull(), "error").when(has, "finished").otherwise(F.col("status"))).withColumn("process_end", F.coalesce("_r.at", "process_end")).withColumn("error_message", F.col("_r.error")).drop("_r")


def refused(requests: DataFrame) -> DataFrame:
    """(event_id, status_code, body) of requests that were not accepted: what was wrong, as JSON without nulls."""
    why = F.when(F.col("status_code") == INVALID, "a field is missing or wrong").when(F.col("status_code") == BUSY, "the queue is full").when(F.col("status_code") == UNREADABLE, "the image cannot be read")
    return requests.filter(F.col("status_code") != ACCEPTED).select("event_id", "status_code", F.to_json(F.struct(F.col("event_id").alias("identifier"), F.col("status_code").alias("code"), why.alias("error"))).alias("body"))


def health(requests: DataFrame, limit: int) -> DataFrame:
    """(waiting, processing, state) of the ledger now: "healthy", or "full" once so many wait."""
    n = lambda s: F.count_if(F.col("status") == s)
    return requests.agg(n("queued").alias("waiting"), n("processing").alias("processing")).withColumn("state", F.when(F.col("waiting") >= limit, "full").otherwise("healthy"))
