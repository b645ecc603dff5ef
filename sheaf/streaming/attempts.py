"""Job outcomes from a stream of attempts."""

from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType

from sheaf.operators.attempts import OK
from sheaf.schema import MAX_ATTEMPTS, RETRY_WAIT_SECONDS


def resolve_stream(classified: DataFrame, key: str, number: str, at: str, gap: str, delay: str,
                   maximum: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per job, in append mode, once its attempts have ceased for ``gap`` of event time.

    Only attempts numbered up to ``maximum`` count. State is a few columns per open job. The
    gap must exceed a request's time limit and wait together; an attempt made later than that
    counts as a job of its own.
    """
    counted = classified.withWatermark(at, delay).filter(F.col(number) <= maximum)
    good = F.col("outcome") == OK
    per_job = counted.groupBy(key, F.session_window(at, gap).alias("_session")).agg(
        F.min(F.when(good, F.col(number))).alias("_ok"),
        F.max(number).alias("attempts"),
        F.min_by("status", F.when(good, F.col(number))).alias("_ok_status"),
        F.max_by("status", number).alias("_last_status"),
        F.max_by("outcome", number).alias("_last"),
    )
    done = F.col("_ok").isNotNull()
    state = F.when(done, "done").when(F.col("attempts") >= maximum, "failed").otherwise("open")
    return per_job.select(
        key, "attempts", state.alias("state"), F.when(done, OK).otherwise(F.col("_last")).alias("outcome"),
        F.when(done, F.col("_ok_status")).otherwise(F.col("_last_status")).alias("status"))


#: Jobs are dealt over so many buckets by the hash of their key. A stream's checkpoints hold to the number it began with.
BUCKETS = 256
TRIES = "numbers array<long>, times array<long>, outcomes array<string>, statuses array<int>"
RESTING = f"closed boolean, told int, {TRIES}"
WAITING = f"jobs array<string>, tolds array<int>, nexts array<long>, sizes array<int>, {TRIES}, timer long"
STEP = "job string, state string, attempts int, outcome string, status int, last_ms long, due_ms long"


class _Retries(StatefulProcessor):
    """The jobs of a bucket. Those that a time is set for are one value, made anew with each batch, which holds recent jobs only.
    All others, closed or without anything to wait for but an attempt, rest in a map, where a batch reads and writes the entries of its own jobs."""

    def __init__(self, maximum: int, wait_ms: int):
        self.maximum, self.wait_ms = maximum, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.resting = handle.getMapState("resting", "job string", RESTING)
        self.waiting = handle.getValueState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting, timer = self.waited()
        brought = {}
        for batch in rows:
            for job, n, t, o, s in zip(*(batch[c].tolist() for c in ("job", "number", "at_ms", "outcome", "status"))):
                if job not in brought:
                    brought[job] = waiting.pop(job, None) or self.rested(job)
                brought[job][2].setdefault(int(n), (int(t), o, None if pd.isna(s) else int(s)))
        yield from self.advanced(brought, waiting, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advanced({}, *self.waited(), timerValues.getCurrentWatermarkInMs())

    def waited(self) -> tuple[dict, int | None]:
        """{job: (closed, told, tries, next)} of the waiting jobs, and the timer that is set."""
        if not self.waiting.exists():
            return {}, None
        jobs, tolds, nexts, sizes, *held, timer = self.waiting.get()
        tries = zip(*held)
        return {job: (False, told, _tries(islice(tries, size)), after) for job, told, after, size in zip(jobs, tolds, nexts, sizes)}, timer

    def rested(self, job: str) -> tuple:
        closed, told, *held = self.resting.getValue((job,)) or (False, 0, [], [], [], [])
        return closed, told, _tries(zip(*held)), None

    def advanced(self, brought: dict, waiting: dict, timer: int | None, now: int) -> Iterator[pd.DataFrame]:
        """Takes on the jobs of a batch and those whose time has come, and stores what became of them."""
        for job in [j for j, held in waiting.items() if held[3] <= now]:
            brought[job] = waiting.pop(job)
        out = []
        for job, (was_closed, told, tries, _) in brought.items():
            if was_closed:
                continue
            closed, told, kept, said, after = self.step(told, tries, now)
            if said:
                out.append((job, *said))
            if after is None:
                self.resting.updateValue((job,), (closed, told, *_columns([kept])))
            else:
                waiting[job] = False, told, kept, after
        held = waiting.values()
        after = min((h[3] for h in held), default=None)
        if timer != after:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if after is not None:
                self.handle.registerTimer(after)
        self.waiting.update(
            (list(waiting), [h[1] for h in held], [h[3] for h in held], [len(h[2]) for h in held], *_columns(h[2] for h in held), after))
        if out:
            made = pd.DataFrame(out, columns=["job", "state", "attempts", "outcome", "status", "last_ms", "due_ms"])
            yield made.astype({"status": "Int32", "due_ms": "Int64"})

    def step(self, told: int, tries: dict, now: int) -> tuple:
        """What is certain of an open job: (closed, told, the attempts to keep, what to say, the next time to look at it)."""
        first = sorted(tries)[:self.maximum]
        sure = []
        for n in first:
            if tries[n][0] > now:
                break
            sure.append(n)
        good = next((i for i, n in enumerate(sure) if tries[n][1] == OK), None)
        if good is not None or len(sure) == self.maximum:
            at_ms, outcome, status = tries[sure[-1 if good is None else good]]
            said = ("failed" if good is None else "done", len(sure) if good is None else good + 1, outcome, status, at_ms, None)
            return True, told, {}, said, None
        kept = {n: tries[n] for n in first}
        last = max((t for t, _, _ in kept.values()), default=0)
        due = last + self.wait_ms
        if len(sure) < len(first):
            return False, told, kept, None, min(t for t, _, _ in kept.values() if t > now)
        if told < len(sure) and due <= now:
            return False, len(sure), kept, ("due", len(sure), tries[sure[-1]][1], tries[sure[-1]][2], last, due), None
        return False, told, kept, None, due if told < len(sure) else None


def _tries(rows: Iterable[tuple]) -> dict:
    return {n: (t, o, s) for n, t, o, s in rows}


def _columns(tries: Iterable[dict]) -> list[list]:
    rows = [(n, *rest) for kept in tries for n, rest in kept.items()]
    return [[r[i] for r in rows] for i in range(4)]


def retry_stream(classified: DataFrame, key: str, number: str, at: str, delay: str,
                 maximum: int = MAX_ATTEMPTS, wait: int = RETRY_WAIT_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """What to do about each job, as it becomes certain, in append mode: (key, state, attempts, outcome, status, last_at, due_at).

    ``due``: all attempts so far failed, fewer than ``maximum`` were made, and the wait of ``wait`` seconds is over; once for each further attempt.
    ``done`` and ``failed`` come once: at the first ``ok`` of the first ``maximum`` attempts, by ``number``, or when all these failed. An attempt counts
    once the watermark has passed it, as then no earlier one can come; timers see to jobs without new attempts. A job that is
    done or failed stays closed, so that an attempt made later, or delivered late, opens no second one. State is up to ``maximum`` attempts
    for an open job and a mark for a closed one. Attempts later than ``delay`` behind the newest are not looked at.

    Python is called for each of ``buckets`` groups of jobs, not for each job; state must be in RocksDB (``session.tune``). The key is of a simple type.
    """
    kind = classified.schema[key].dataType
    job, back = (F.base64(key), F.unbase64("job")) if isinstance(kind, BinaryType) else (F.col(key).cast("string"), F.col("job").cast(kind))
    rows = classified.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), job.alias("job"), F.col(number).cast("long").alias("number"),
        F.col(at).cast("timestamp").alias("at"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"), "outcome", F.col("status").cast("int").alias("status"))
    said = rows.withWatermark("at", delay).groupBy("bucket").transformWithStateInPandas(
        _Retries(maximum, wait * 1000), STEP, "append", "EventTime")
    return said.select(back.alias(key), "state", "attempts", "outcome", "status",
                       F.timestamp_millis("last_ms").alias("last_at"), F.timestamp_millis("due_ms").alias("due_at"))
