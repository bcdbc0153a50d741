"""Queries over stateful streams: each gives what a stream gave that took its input in three deliveries, and has the SQL of the same rows over all input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgate.plans import page_events as pe
from fitgate.streaming import broker, feeds, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.fed(feeds.deliveries(pe.page_events(spark, sf_dir)), sessions.page_actions)


_ACTIONS = f"WITH {pe.PAGE_EVENTS}, {sessions.ACTIONS_SQL}"


@query(f"{_ACTIONS} SELECT page, event_id, action, input, session, held FROM actions WHERE action NOT IN ('submit', 'submit_held', 'flush')")
def page_sessions(spark, sf_dir):
    """What becomes of each choice of files: held, joined, passed on, replayed once, cancelled by a newer one, a removal or the page's end; results that come too late are discarded."""
    rows = _actions(spark, sf_dir)
    return rows.where("action not in ('submit', 'submit_held', 'flush')").drop("submit")


@query(f"{_ACTIONS} SELECT page, event_id, action, submit FROM actions WHERE action IN ('submit', 'submit_held', 'flush')")
def submit_flush(spark, sf_dir):
    """Submits that pass, those held while their form has an open session, and the replay that lets the latest of them go."""
    rows = _actions(spark, sf_dir)
    return rows.where("action in ('submit', 'submit_held', 'flush')").select("page", "event_id", "action", "submit")


@query(f"WITH RECURSIVE {pe.BROKER_EVENTS}, {broker.ANSWERS_SQL} SELECT profile, event_id, answer FROM answered WHERE n > 0")
def broker_messages(spark, sf_dir):
    """One-time tokens (30 s, 64 live, one redemption) and tracked jobs (8, cancelled only by their owner)."""
    return feeds.fed(feeds.deliveries(pe.broker_events(spark, sf_dir)), broker.broker_answers)


@query(f"WITH RECURSIVE {pe.JOB_EVENTS}, {broker.PROGRESS_SQL} SELECT job, event_id, least(last, 1000) AS fraction FROM shown WHERE ok")
def progress_shown(spark, sf_dir):
    """Reports of progress, at most one for each two hundredths."""
    return feeds.fed(feeds.deliveries(pe.job_events(spark, sf_dir)), broker.shown_progress)


@query(f"""WITH {pe.JOB_EVENTS},
    timed AS (SELECT job, CAST(ceil((min(us) FILTER (kind = 'start') + {broker.NOTICE_US}) / 1000) AS BIGINT) AS due, min(us) FILTER (kind = 'finish') // 1000 AS ends FROM job_events GROUP BY job),
    shown AS (SELECT * FROM timed WHERE due <= coalesce(ends, (SELECT max(us) // 1000 FROM job_events)))
    SELECT job, 'up' AS notice, due AS ms FROM shown UNION ALL SELECT job, 'down', ends FROM shown WHERE ends IS NOT NULL""")
def job_notices(spark, sf_dir):
    """The notice that a job shows when it has run for 350 ms, by timers on the watermark."""
    return feeds.fed(feeds.deliveries(pe.job_events(spark, sf_dir)), broker.notices)


IDLE_US = 6_000_000


@query(f"""WITH {pe.PAGE_EVENTS}, marked AS (SELECT input, us, coalesce(us - lag(us) OVER (PARTITION BY input ORDER BY us) >= {IDLE_US}, true) AS fresh FROM page_events),
    numbered AS (SELECT input, us, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY input ORDER BY us) AS n FROM marked)
    SELECT input, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM numbered GROUP BY input, numbered.n HAVING max(us) + {IDLE_US} - 1 <= (SELECT max(us) // 1000 * 1000 FROM page_events)""")
def idle_sessions_stream(spark, sf_dir):
    """Idle sessions that the watermark has closed, each given out once."""
    return feeds.fed(feeds.deliveries(pe.page_events(spark, sf_dir)), lambda s: feeds.closed_sessions(s, "input", IDLE_US))
