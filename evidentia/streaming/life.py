"""The life of a job as keyed state: queued, running, then completed, failed or timeout.

Events (job_id, event, at, error, outcome) may come in any order, late or twice; a job's status is a function of the set of its
events and of how far time has come:

* the earliest ``queued``, ``started`` and ``finished`` count; of finishes at one time, the one that sorts first,
* a finish with an error failed; else its outcome stands, ``completed`` where it has none,
* a job that isn't finished within ``LIMIT`` of its start timed out at that moment, whatever comes after it,
* otherwise a started job runs and a job with no start is queued.

As a stream, each job's state holds those three and its deadline; a row is written whenever the status changes, numbered, so the
last one is the job's. The state of a job that ended goes once no event of it can come any more.

Jobs are dealt by a hash into ``BUCKETS``, which are the keys of the state: a list of jobs, and one timer in event time at the earliest
of their deadlines. So the calls between Python and the state, which take most of the time, are a few for each bucket and
micro-batch, however many jobs there are. A micro-batch writes the lists of the buckets that it touches again; the number of buckets
belongs to a stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The hard limit of a job and the grace after it, in seconds.
LIMIT = 180 + 60
QUEUED, STARTED, FINISHED = "queued", "started", "finished"
ACTIVE = ("queued", "running")
STATUS = "job_id string, status string, queued_at timestamp, started_at timestamp, ended_at timestamp, revision long"
#: Some thousands of jobs each where there are ten million at a time.
BUCKETS = 4_096
_STATE = "queued_at long, started_at long, finished_at long, outcome string, status string, ended_at long, revision long"
_FIELDS = [c.split()[0] for c in _STATE.split(", ")]
_SHOWN = ("status", "queued_at", "started_at", "ended_at")
_NEW = dict.fromkeys(_FIELDS) | {"revision": 0}


def _shown(s: dict) -> tuple:
    return tuple(s[k] for k in _SHOWN)


def outcome(error: Column, told: Column) -> Column:
    return F.when(F.coalesce(error, F.lit("")) != "", "failed").otherwise(F.coalesce(F.nullif(told, F.lit("")), F.lit("completed")))


def batch(events: DataFrame, now: Column, limit: int = LIMIT) -> DataFrame:
    """(job_id, status, queued_at, started_at, ended_at) of jobs, at ``now``: the time up to which events are known."""
    first = lambda kind: F.min(F.when(F.col("event") == kind, F.col("at")))
    end = F.min(F.when(F.col("event") == FINISHED, F.struct("at", outcome(F.col("error"), F.col("outcome")).alias("outcome"))))
    jobs = events.groupBy("job_id").agg(first(QUEUED).alias("queued_at"), first(STARTED).alias("started_at"), end.alias("_end"))
    deadline = F.col("started_at") + F.make_interval(secs=F.lit(limit))
    ended = F.col("_end").isNotNull() & F.coalesce(F.col("_end.at") <= deadline, F.lit(True))
    late = F.coalesce((deadline <= now) | (F.col("_end.at") > deadline), F.lit(False))
    status = F.when(ended, F.col("_end.outcome")).when(late, "timeout").when(F.col("started_at").isNotNull(), "running").otherwise("queued")
    return jobs.select("job_id", status.alias("status"), "queued_at", "started_at", F.when(ended, F.col("_end.at")).when(late, deadline).alias("ended_at"))


class Life(StatefulProcessor):
    """State of the jobs of one bucket; see the module's text. Times are microseconds since 1970, so no machine's time zone enters."""

    def __init__(self, limit: int = LIMIT):
        self.limit = limit * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getListState("jobs", f"job_id string, {_STATE}")

    def _status(self, s: dict, now: int) -> tuple[str, int | None]:
        deadline = None if s["started_at"] is None else s["started_at"] + self.limit
        if s["finished_at"] is not None and (deadline is None or s["finished_at"] <= deadline):
            return s["outcome"], s["finished_at"]
        if deadline is not None and (s["finished_at"] is not None or deadline <= now):
            return "timeout", deadline
        return ("queued" if deadline is None else "running"), None

    def _told(self, job: str | None, s: dict, said: tuple, now: int) -> Iterator[Row]:
        """A row, if what would be shown has changed."""
        s["status"], s["ended_at"] = self._status(s, now)
        if said != _shown(s):
            s["revision"] += 1
            yield Row(job_id=job, **{k: s[k] for k in _SHOWN}, revision=s["revision"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        jobs = self._known()
        before, said = self._timer(jobs), {}
        for r in rows:
            job = r.job_id
            if job not in said:
                said[job] = _shown(jobs.setdefault(job, dict(_NEW)))
            s = jobs[job]
            if r.event in (QUEUED, STARTED):
                s[f"{r.event}_at"] = r.us if s[f"{r.event}_at"] is None else min(r.us, s[f"{r.event}_at"])
            elif r.event == FINISHED:
                if s["finished_at"] is None or (r.us, r.how) < (s["finished_at"], s["outcome"]):
                    s["finished_at"], s["outcome"] = r.us, r.how
        now = timerValues.getCurrentWatermarkInMs() * 1000
        out = [row for job, was in said.items() for row in self._told(job, jobs[job], was, now)]
        self._keep(jobs)
        after = self._timer(jobs)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        yield from out

    def _known(self) -> dict[str | None, dict]:
        return {r[0]: dict(zip(_FIELDS, r[1:])) for r in self.state.get()}

    def _keep(self, jobs: dict) -> None:
        if jobs:
            self.state.put([(job, *(s[k] for k in _FIELDS)) for job, s in jobs.items()])
        else:
            self.state.clear()

    def _due(self, s: dict) -> int | None:
        """The deadline, in milliseconds; of a job that ended with no start, when its state may go."""
        at = s["started_at"] if s["started_at"] is not None else s["finished_at"]
        return None if at is None else -(-(at + self.limit) // 1000)

    def _timer(self, jobs: dict) -> int | None:
        """The bucket's timer: the earliest of its jobs' deadlines."""
        return min((at for at in map(self._due, jobs.values()) if at is not None), default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        jobs, out, left = self._known(), [], {}
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for job, s in jobs.items():
            due = self._due(s)
            if due is None or due > now:
                left[job] = s
            else:
                out += self._told(job, s, _shown(s), due * 1000)
        self._keep(left)
        if (after := self._timer(left)) is not None:
            self.handle.registerTimer(after)
        yield from out

    def close(self) -> None:
        pass


def stream(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows (:data:`STATUS`) of status changes of a stream of events that has a watermark on ``at``."""
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int")
    read = events.select(bucket.alias("bucket"), "job_id", "event", "at", F.unix_micros("at").alias("us"), outcome(F.col("error"), F.col("outcome")).alias("how"))
    told = read.groupBy("bucket").transformWithState(statefulProcessor=Life(limit), outputStructType=STATUS.replace("timestamp", "long"), outputMode="Append", timeMode="EventTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("queued_at", "started_at", "ended_at")})


def latest(changes: DataFrame) -> DataFrame:
    """A job's last row among its status changes."""
    last = F.max_by(F.struct(*[c.split()[0] for c in STATUS.split(", ")[1:]]), F.struct("revision", "ended_at"))
    return changes.groupBy("job_id").agg(last.alias("r")).select("job_id", "r.status", "r.queued_at", "r.started_at", "r.ended_at")
