"""Attempts and retries of OCR requests, in batch: schedules, failures, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds to wait before each further attempt. Fixed values.
DELAYS = (15, 60, 300, 600)
MAX_FAILURES = 25
#: Attempts after which a client gives up, whatever delays a service grants. A fixed value.
MAX_ATTEMPTS = 11
#: A recovery state as JSON, and its default status.
STATE, IDLE = "status string, request_id string, attempt int, retry_after_seconds int, failure_id string", "idle"


def retry_schedule(attempts: DataFrame, key: str, ts: str, tie: str, retryable: Column, failed: Column, delays: tuple[int, ...] = DELAYS, open_waits: Column | None = None) -> DataFrame:
    """attempts with attempt, status, retry_after_seconds and next_retry_at.

    A retryable failure waits for the delay of its attempt, the one after the last delay fails for good; any
    other failure fails at once. Success and final failure end a request; what follows is a new one. The
    requests of a key are islands between such ends: one window sort by key serves both passes. open_waits: how many
    waits the key's open request has behind it before its first row here (none without it).
    """
    by_key = Window.partitionBy(key).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    runs = attempts.withColumn("ends_", F.coalesce(F.sum(F.when(retryable, 0).otherwise(1)).over(by_key), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(key, "ends_").orderBy(ts, tie)) - 1
    if open_waits is not None:
        place = place + F.when(F.col("ends_") == 0, open_waits).otherwise(0)
    n = len(delays)
    attempt = (place % (n + 1)) + 1
    wait = F.when(retryable, F.try_element_at(F.array(*(F.lit(d) for d in delays)) if delays else F.array().cast("array<int>"), F.col("attempt")))
    status = F.when(retryable & (F.col("attempt") <= n), "waiting").when(retryable | failed, "failed").otherwise("idle")
    out = runs.withColumn("attempt", attempt.cast("int"))
    return out.select(*attempts.columns, "attempt", status.alias("status"), wait.alias("retry_after_seconds"), F.timestamp_add("SECOND", wait, F.col(ts)).alias("next_retry_at"))


def newest_failures(failures: DataFrame, ts: str, tie: str, most: int = MAX_FAILURES, key: str | None = None) -> DataFrame:
    """The newest failures, of each key if one is given."""
    if key is None:
        return failures.orderBy(F.desc(ts), F.desc(tie)).limit(most)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))
    return failures.withColumn("rank", rank).filter(F.col("rank") <= most)


def sessions(events: DataFrame, ts: str, gap: str, key: str | None = None) -> DataFrame:
    """Start, last event and number of events of each run of events without a gap."""
    by = [F.session_window(ts, gap).alias("w"), *([key] if key else [])]
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), F.max(ts).alias("last_ts")).select(*([key] if key else []), F.col("w.start").alias("start_ts"), "last_ts", "n_events")


def current_config(history: DataFrame, section: str, version: str) -> DataFrame:
    """The newest version of each section, as a struct of its columns."""
    rest = [c for c in history.columns if c != section]
    return history.groupBy(section).agg(F.max_by(F.struct(*rest), version).alias("c")).select(section, "c.*")


def history_name(prefix: str, version: Column, at: Column) -> Column:
    return F.format_string(f"{prefix}-v%04d-%s.json", version, F.date_format(at, "yyyyMMdd-HHmmss"))


def control_state(state: DataFrame) -> DataFrame:
    """What may be shown without naming documents: status, request and whether a retry is asked for."""
    return state.select("status", "request_id", "retry_now")


def dismiss_failure(failures: DataFrame, state: DataFrame, failure_id: str) -> tuple[DataFrame, DataFrame]:
    """The failures without one, and the state reset to idle where it points at that one."""
    mine = F.coalesce(F.col("failure_id") == failure_id, F.lit(False))
    reset = state.select(*(F.when(mine, "idle").otherwise(F.col(c)).alias(c) if c == "status" else F.when(mine & F.lit(c == "failure_id"), None).otherwise(F.col(c)).alias(c) for c in state.columns))
    return failures.filter(~F.coalesce(F.col("id") == failure_id, F.lit(False))), reset


def accept_triggers(state: DataFrame, triggers: DataFrame, request_col: str = "request_id") -> DataFrame:
    """state with retry_now: whether a trigger names the request, which counts only while it waits."""
    asked = triggers.select(F.col(request_col).alias("asked_")).distinct()
    joined = state.join(asked, state[request_col] == F.col("asked_"), "left")
    return joined.select(*state.columns, ((F.col("status") == "waiting") & F.col("asked_").isNotNull()).alias("retry_now"))


def waits(scheduled: DataFrame, triggers: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The waiting attempts of scheduled (see retry_schedule) with ended_at and ended_by: deadline or trigger.

    A trigger counts while its key waits, so before the deadline and the key's next attempt; the first one ends the
    wait and is used up. triggers: key and ts. One window over both kinds of rows finds what follows each attempt.
    """
    marks = triggers.select(F.col(key), F.col(ts), F.lit(True).alias("asked_"))
    both = scheduled.withColumn("asked_", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    # Backwards, so that the frame grows row by row. At equal times a trigger follows the attempt.
    behind = Window.partitionBy(key).orderBy(F.desc(ts), F.desc("asked_"), F.desc(tie)).rowsBetween(Window.unboundedPreceding, -1)
    following = lambda asked: F.last(F.when(F.col("asked_") == asked, F.col(ts)), ignorenulls=True).over(behind)
    both = both.withColumn("trigger_", following(True)).withColumn("next_", following(False))
    counts = (F.col("trigger_") < F.col("next_retry_at")) & (F.col("next_").isNull() | (F.col("trigger_") < F.col("next_")))
    early = F.coalesce(counts, F.lit(False))
    waiting = both.filter(~F.col("asked_") & (F.col("status") == "waiting"))
    return waiting.select(*scheduled.columns, F.when(early, F.col("trigger_")).otherwise(F.col("next_retry_at")).alias("ended_at"), F.when(early, "trigger").otherwise("deadline").alias("ended_by"))


def client_delay(attempt: Column, granted: Column, delay: Column, delays: Column, most: int = MAX_ATTEMPTS) -> Column:
    """struct(delay, error) of a failed attempt: what the service grants, else the client's own schedule.

    granted: whether the service allows another attempt; delay: the seconds it names, null if it names none.
    """
    own = F.get(delays, attempt - 1)
    error = F.when(granted & (attempt >= most), "limit_reached").when(granted & delay.isNotNull(), None).when(own.isNull(), "schedule_exhausted")
    return F.struct(F.when(error.isNull(), F.when(granted, F.coalesce(delay, own)).otherwise(own)).alias("delay"), error.alias("error"))


def read_state(raw: Column) -> Column:
    """The state of a JSON text laid over the defaults; missing, broken and other texts and nulls in it give the default."""
    given = F.from_json(raw, STATE)
    return F.struct(F.coalesce(given["status"], F.lit(IDLE)).alias("status"), *(given[c].alias(c) for c in ("request_id", "attempt", "retry_after_seconds", "failure_id")))


def overview(state: DataFrame, failures: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """state (key, status, retry_now) with the ids of its newest failures, newest first, and the status to show:
    an idle key with failures is shown as failed. At most 25 failures a key are listed."""
    newest = newest_failures(failures.select(key, ts, tie), ts, tie, key=key)
    listed = newest.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(tie).alias("id")))), lambda x: x["id"]).alias("failures"))
    joined = state.join(listed, key, "left")
    show = F.when((F.col("status") == IDLE) & F.col("failures").isNotNull(), "failed").otherwise(F.col("status"))
    return joined.select(*state.columns, F.coalesce("failures", F.array().cast(listed.schema["failures"].dataType)).alias("failures"), show.alias("display_status"))


def set_idle(state: DataFrame, triggers: DataFrame, finished: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """state with the finished keys back at the default, and the triggers without theirs. Columns besides key and
    status are emptied."""
    done = finished.select(F.col(key).alias("done_")).distinct()
    joined = state.join(done, state[key] == F.col("done_"), "left")
    over = F.col("done_").isNotNull()
    value = lambda c: F.col(c) if c == key else F.when(over, F.lit(IDLE) if c == "status" else None).otherwise(F.col(c))
    return joined.select(*(value(c).alias(c) for c in state.columns)), triggers.join(done, triggers[key] == F.col("done_"), "left_anti")


def dismiss_failures(failures: DataFrame, state: DataFrame, dismissed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As dismiss_failure, for a table of ids (id)."""
    ids = dismissed.select(F.col("id").alias("gone_")).distinct()
    joined = state.join(ids, state["failure_id"] == F.col("gone_"), "left")
    reset = lambda c: {"status": F.lit(IDLE), "failure_id": F.lit(None)}.get(c)
    gone = F.col("gone_").isNotNull()
    columns = (F.col(c) if reset(c) is None else F.when(gone, reset(c)).otherwise(F.col(c)).alias(c) for c in state.columns)
    return failures.join(ids, failures["id"] == F.col("gone_"), "left_anti"), joined.select(*columns)


def human_delay(seconds: Column) -> Column:
    """45 s, 5 m 10 s or 2 h 5 m."""
    h, m, s = (F.floor(seconds / 3600), F.floor((seconds % 3600) / 60), seconds % 60)
    return F.when(seconds < 60, F.format_string("%d s", seconds)).when(seconds < 3600, F.format_string("%d m %d s", m, s)).otherwise(F.format_string("%d h %d m", h, m))


def parse_delays(text: Column) -> Column:
    """Comma-separated delays as numbers; blank is an empty list, anything else that isn't a number gives null."""
    parts = F.split(F.trim(text), r"\s*,\s*")
    return F.when(F.trim(text) == "", F.array().cast("array<int>")).when(F.forall(parts, lambda p: p.rlike("^[0-9]{1,9}$")), F.transform(parts, lambda p: p.try_cast("int")))
