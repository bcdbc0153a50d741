"""The one process that hands out tokens and tracks jobs, as a stateful stream, and what a job shows while it runs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fitgate.streaming.sessions import Kept, ordered

# A token's life, how many live at once, how many jobs are tracked, the step of progress in thousandths, the delay of the notice.
TOKEN_US, MAX_TOKENS, MAX_JOBS, STEP, NOTICE_US = 30_000_000, 64, 8, 20, 350_000

#: The frame of a broker event that may redeem tokens.
OURS = 0
ANSWERS = "profile long, event_id long, answer string"


class Broker(StatefulProcessor):
    """State by profile: live tokens with the end of their lives (64 at most), tracked jobs with their owner (8 at most)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getMapState("tokens", "token long", "ends long")
        self.jobs = handle.getMapState("jobs", "job long", "owner long")
        self.seen = handle.getValueState("seen", "us long, event_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = tuple(self.seen.get()) if self.seen.exists() else None
        tokens, jobs = Kept(self.tokens), Kept(self.jobs)
        out = []
        for us, event, kind, subject, frame in ordered(rows, ["kind", "subject", "frame"]):
            if seen and (us, event) <= seen:
                out.append((key[0], event, "late"))
                continue
            seen = (us, event)
            answer = None
            if kind == "token":
                tokens.now = {k: v for k, v in tokens.now.items() if v[0] >= us}
                answer = "full"
                if len(tokens.now) < MAX_TOKENS:
                    tokens.now[subject] = (us + TOKEN_US,)
                    answer = "issued"
            elif kind == "verify":  # a token goes with the first attempt, whoever makes it
                ends = tokens.now.pop(subject, (-1,))[0]
                answer = "ok" if frame == OURS and ends >= us else "refused"
            elif kind == "prepare":
                answer = "busy"
                if len(jobs.now) < MAX_JOBS and subject not in jobs.now:
                    jobs.now[subject] = (frame,)
                    answer = "accepted"
            elif kind == "finish":
                answer = "unknown" if jobs.now.pop(subject, None) is None else "finished"
            elif kind == "cancel":
                answer = "forwarded" if jobs.now.get(subject) == (frame,) else "ignored"
            out.append((key[0], event, answer))
        self.seen.update(seen)
        tokens.save()
        jobs.save()
        yield pd.DataFrame(out, columns=["profile", "event_id", "answer"])

    def close(self) -> None:
        pass


def broker_answers(messages: DataFrame) -> DataFrame:
    """ANSWERS for a stream of (event_id, us, profile, kind, subject, frame): token, verify, prepare, finish and cancel messages.

    A message that is not later than one already answered gets the answer ``late`` and changes nothing; an unknown kind gets NULL. Rows without a
    profile, a time or an id are left out.
    """
    known = messages.where("profile is not null and us is not null and event_id is not null")
    return known.groupBy("profile").transformWithStateInPandas(Broker(), ANSWERS, "append", "None")


#: The same answers message by message, all profiles side by side.
ANSWERS_SQL = f"""
  messages AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY us, event_id) AS n FROM broker_events),
  answered AS (
    SELECT DISTINCT profile, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(token BIGINT, ends BIGINT)[]) AS tokens, CAST([] AS STRUCT(job BIGINT, owner BIGINT)[]) AS jobs, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS answer FROM messages
    UNION ALL SELECT m.profile, m.n,
      CASE m.kind WHEN 'token' THEN CASE WHEN len(list_filter(a.tokens, lambda t: t.ends >= m.us)) < {MAX_TOKENS}
          THEN list_append(list_filter(a.tokens, lambda t: t.ends >= m.us), struct_pack(token := m.subject, ends := m.us + {TOKEN_US})) ELSE list_filter(a.tokens, lambda t: t.ends >= m.us) END
        WHEN 'verify' THEN list_filter(a.tokens, lambda t: t.token <> m.subject) ELSE a.tokens END,
      CASE m.kind WHEN 'prepare' THEN CASE WHEN len(a.jobs) < {MAX_JOBS} AND len(list_filter(a.jobs, lambda j: j.job = m.subject)) = 0 THEN list_append(a.jobs, struct_pack(job := m.subject, owner := m.frame)) ELSE a.jobs END
        WHEN 'finish' THEN list_filter(a.jobs, lambda j: j.job <> m.subject) ELSE a.jobs END,
      m.event_id,
      CASE m.kind WHEN 'token' THEN CASE WHEN len(list_filter(a.tokens, lambda t: t.ends >= m.us)) < {MAX_TOKENS} THEN 'issued' ELSE 'full' END
        WHEN 'verify' THEN CASE WHEN m.frame = {OURS} AND len(list_filter(a.tokens, lambda t: t.token = m.subject AND t.ends >= m.us)) > 0 THEN 'ok' ELSE 'refused' END
        WHEN 'prepare' THEN CASE WHEN len(a.jobs) < {MAX_JOBS} AND len(list_filter(a.jobs, lambda j: j.job = m.subject)) = 0 THEN 'accepted' ELSE 'busy' END
        WHEN 'finish' THEN CASE WHEN len(list_filter(a.jobs, lambda j: j.job = m.subject)) = 0 THEN 'unknown' ELSE 'finished' END
        WHEN 'cancel' THEN CASE WHEN len(list_filter(a.jobs, lambda j: j.job = m.subject AND j.owner = m.frame)) = 0 THEN 'ignored' ELSE 'forwarded' END END
    FROM answered a JOIN messages m ON m.profile = a.profile AND m.n = a.n + 1)"""


class Progress(StatefulProcessor):
    """State by job: the fraction that was shown last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getValueState("shown", "fraction long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = before = self.shown.get()[0] if self.shown.exists() else 0
        out = []
        for _, event, fraction in ordered(rows, ["fraction"]):
            if fraction - last >= STEP or fraction >= 1000:
                last = fraction
                out.append((key[0], event, min(1000, fraction)))
        if last != before:
            self.shown.update((last,))
        yield pd.DataFrame(out, columns=["job", "event_id", "fraction"]).astype("int64")

    def close(self) -> None:
        pass


def shown_progress(events: DataFrame) -> DataFrame:
    """(job, event_id, fraction) of the reports let through: two hundredths more than the last one, or all done."""
    known = events.where("job is not null and us is not null and event_id is not null and fraction is not null")
    return known.groupBy("job").transformWithStateInPandas(Progress(), "job long, event_id long, fraction long", "append", "None")


PROGRESS_SQL = f"""
  reports AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job ORDER BY us, event_id) AS n FROM job_events),
  shown AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS last, CAST(NULL AS BIGINT) AS event_id, false AS ok FROM reports
    UNION ALL SELECT r.job, r.n, CASE WHEN r.fraction - s.last >= {STEP} OR r.fraction >= 1000 THEN r.fraction ELSE s.last END, r.event_id, r.fraction - s.last >= {STEP} OR r.fraction >= 1000
    FROM shown s JOIN reports r ON r.job = s.job AND r.n = s.n + 1)"""


class Notices(StatefulProcessor):
    """A notice goes up when a job has run for the delay, by a timer on the watermark, and down when the job ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms long, up boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        due = tuple(self.due.get()) if self.due.exists() else None
        timer = due[0] if due and not due[1] else None
        out = []
        for us, _, kind in ordered(rows, ["kind"]):
            if kind == "start" and due is None:
                due = (-(-(us + NOTICE_US) // 1000), False)  # timers count milliseconds
            elif kind == "finish" and due:
                if not due[1] and us // 1000 >= due[0]:  # the end of a long job came before the watermark passed the delay
                    out.append((key[0], "up", due[0]))
                if due[1] or us // 1000 >= due[0]:
                    out.append((key[0], "down", us // 1000))
                due = None
        after = due[0] if due and not due[1] else None
        if timer != after:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if after is not None:
                self.handle.registerTimer(after)
        if due:
            self.due.update(due)
        else:
            self.due.clear()
        yield pd.DataFrame(out, columns=["job", "notice", "ms"]).astype({"job": "int64", "ms": "int64"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = tuple(self.due.get())
        self.due.update((due[0], True))
        yield pd.DataFrame({"job": [key[0]], "notice": ["up"], "ms": [due[0]]})

    def close(self) -> None:
        pass


def notices(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(job, notice, ms): up when a job has run for 350 ms, at that time, and down at its end, for a stream of (event_id, us, job, kind).

    ``delay``: how late rows may come. A job that ends before the notice is due shows none.
    """
    known = events.where("job is not null and us is not null and event_id is not null").withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)
    return known.groupBy("job").transformWithStateInPandas(Notices(), "job long, notice string, ms long", "append", "EventTime")
