"""Upload sessions of a page as a stateful stream: hold, join, replay, supersede, cancel, and the held submit.

A selection that needs work is held; the second event of one choice (input, then change, with the
same files) joins it; the result replays what is held, once. A selection of other files on
the input cancels it, as do the input's removal and the page's end. A submit waits while its form
has an open session and goes on, the latest only, with the replay that leaves the form without one.

State is kept by page: the open sessions by input, the held submits by form, and the last event that
was seen. A page has few of each. The rows of a page that come in one batch are sorted in its
task, so the trigger's size bounds them. An event no later than the last one seen comes too late: it changes nothing, and is
given out as ``late``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fitgate.plans.page_events import READY

ACTIONS = "page long, event_id long, action string, input long, session long, held string, submit long"
_NAMES = [c.split()[0] for c in ACTIONS.split(", ")]


def ordered(batches: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """(us, event_id, ...columns) of all rows, in the order of time."""
    rows: list[tuple] = []
    for b in batches:
        rows += zip(*(b[c].tolist() for c in ("us", "event_id", *columns)), strict=True)
    return sorted(rows, key=lambda r: r[:2])


class Kept:
    """A map of the state as a dict for the time of a batch; changes are written back at its end."""

    def __init__(self, state: Any):
        self.state = state
        self.now = {k[0]: tuple(v) for k, v in state.iterator()}
        self.before = dict(self.now)

    def save(self) -> None:
        for k in self.before.keys() - self.now.keys():
            self.state.removeKey((k,))
        for k, v in self.now.items():
            if self.before.get(k) != v:
                self.state.updateValue((k,), v)


class PageSessions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "input long", "session long, files long, form long, held string")
        self.submits = handle.getMapState("submits", "form long", "event_id long")
        self.seen = handle.getValueState("seen", "us long, event_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = tuple(self.seen.get()) if self.seen.exists() else None
        sessions, submits = Kept(self.sessions), Kept(self.submits)
        out: list[tuple] = []
        for us, event, form, source, kind, files in ordered(rows, ["form", "input", "kind", "files"]):
            say = lambda action, at=source, session=None, held=None, submit=None: out.append((key[0], event, action, at, session, held, submit))  # noqa: E731, B023
            if seen and (us, event) <= seen:
                say("late")
                continue
            seen = (us, event)
            open_ = sessions.now.get(source)
            waiting = any(s[2] == form for s in sessions.now.values())
            if kind in ("input", "change"):
                if open_ and open_[1] == files:
                    held = open_[3] if kind in open_[3].split(",") else f"{open_[3]},{kind}"
                    sessions.now[source] = (*open_[:3], held)
                    say("join", session=open_[0])
                    continue
                if open_:
                    say("cancel", session=sessions.now.pop(source)[0])
                if files == READY:
                    say("pass")
                else:
                    sessions.now[source] = (event, files, form, kind)
                    say("hold", session=event)
            elif kind == "done":
                if not open_ or open_[1] != files:
                    say("discard")
                    continue
                del sessions.now[source]
                say("replay", session=open_[0], held=open_[3])
                if form in submits.now and all(s[2] != form for s in sessions.now.values()):
                    say("flush", at=None, submit=submits.now.pop(form)[0])
            elif kind == "removed" and open_:
                say("cancel", session=sessions.now.pop(source)[0])
            elif kind == "submit" and waiting:
                submits.now[form] = (event,)
                say("submit_held", at=None)
            elif kind == "submit":
                say("submit", at=None)
            elif kind == "pagehide":
                for i, s in sorted(sessions.now.items()):
                    say("cancel", at=i, session=s[0])
                sessions.now.clear()
                submits.now.clear()
        self.seen.update(seen)
        sessions.save()
        submits.save()
        yield pd.DataFrame(out, columns=_NAMES).astype({"input": "Int64", "session": "Int64", "submit": "Int64"})

    def close(self) -> None:
        pass


def page_actions(events: DataFrame) -> DataFrame:
    """ACTIONS rows for a stream of (event_id, us, page, form, input, kind, files).

    Most events give one row (hold, join, pass, replay, discard, submit, submit_held, late), a superseding choice
    one more (cancel), a replay that frees a form another one (flush), a removal or the page's end one for each session it cancels.
    Rows without a page, a time or an id are left out.
    """
    known = events.where("page is not null and us is not null and event_id is not null")
    return known.groupBy("page").transformWithStateInPandas(PageSessions(), ACTIONS, "append", "None")


#: The same actions from all events at once.
ACTIONS_SQL = f"""
  numbered AS (SELECT *, sum(CAST(kind = 'pagehide' AS INTEGER)) OVER (PARTITION BY page ORDER BY us, event_id) - CAST(kind = 'pagehide' AS INTEGER) AS life,
    CASE kind WHEN 'input' THEN 'choice' WHEN 'change' THEN 'choice' ELSE kind END AS what FROM page_events),
  begun AS (SELECT *, count(*) FILTER (what IN ('choice', 'removed')) OVER (PARTITION BY page, life, input ORDER BY us, event_id) AS run FROM numbered WHERE what IN ('choice', 'removed', 'done')),
  led AS (SELECT *, first(what) OVER w AS led_by, first(files) OVER w AS led_files FROM begun WINDOW w AS (PARTITION BY page, life, input, run ORDER BY us, event_id)),
  stated AS (SELECT *, run > 0 AND led_by = 'choice' AND led_files <> {READY} AND count(*) FILTER (what = 'done' AND files = led_files) OVER (PARTITION BY page, life, input, run ORDER BY us, event_id) = 0 AS open_after FROM led),
  chained AS (SELECT *, coalesce(lag(open_after) OVER w, false) AS open_before, lag(led_files) OVER w AS files_before FROM stated WINDOW w AS (PARTITION BY page, life, input ORDER BY us, event_id)),
  judged AS (SELECT *, open_before AND files_before = files AS same, CASE WHEN what = 'choice' AND files <> {READY} AND NOT (open_before AND files_before = files) THEN event_id END AS starts FROM chained),
  named AS (SELECT *, last_value(starts IGNORE NULLS) OVER (PARTITION BY page, life, input ORDER BY us, event_id) AS mine,
    last_value(starts IGNORE NULLS) OVER (PARTITION BY page, life, input ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM judged),
  held AS (SELECT mine, arg_min(kind, event_id) AS first_kind, count(DISTINCT kind) AS kinds FROM named WHERE what = 'choice' AND open_after GROUP BY mine),
  of_form AS (SELECT page, life, form, us, event_id, what, CAST(open_after AS INTEGER) - CAST(open_before AS INTEGER) AS more, what = 'done' AND same AS replayed FROM named
    UNION ALL SELECT page, life, form, us, event_id, what, 0, false FROM numbered WHERE what = 'submit'),
  counted AS (SELECT *, sum(more) OVER (PARTITION BY page, life, form ORDER BY us, event_id) AS pending FROM of_form),
  freed AS (SELECT *, count(*) FILTER (replayed AND pending = 0) OVER (PARTITION BY page, life, form ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn FROM counted),
  waits AS (SELECT page, life, form, coalesce(turn, 0) AS turn, max(event_id) AS submit FROM freed WHERE what = 'submit' AND pending > 0 GROUP BY ALL),
  actions AS (
    SELECT page, event_id, CASE WHEN what = 'choice' THEN CASE WHEN same THEN 'join' WHEN files = {READY} THEN 'pass' ELSE 'hold' END WHEN same THEN 'replay' ELSE 'discard' END AS action,
      input, CASE WHEN what = 'choice' AND (same OR files <> {READY}) OR what = 'done' AND same THEN mine END AS session,
      CASE WHEN what = 'done' AND same THEN first_kind || CASE WHEN kinds < 2 THEN '' WHEN first_kind = 'input' THEN ',change' ELSE ',input' END END AS held, NULL AS submit
      FROM named LEFT JOIN held USING (mine) WHERE what IN ('choice', 'done')
    UNION ALL SELECT page, event_id, 'cancel', input, before, NULL, NULL FROM named WHERE open_before AND (what = 'removed' OR what = 'choice' AND NOT same)
    UNION ALL SELECT h.page, h.event_id, 'cancel', l.input, l.mine, NULL, NULL FROM numbered h JOIN (SELECT page, life, input, arg_max(mine, us) AS mine, arg_max(open_after, us) AS open_after FROM named GROUP BY ALL) l
      ON h.page = l.page AND h.life = l.life AND h.what = 'pagehide' AND l.open_after
    UNION ALL SELECT page, event_id, CASE WHEN pending > 0 THEN 'submit_held' ELSE 'submit' END, NULL, NULL, NULL, NULL FROM counted WHERE what = 'submit'
    UNION ALL SELECT f.page, f.event_id, 'flush', NULL, NULL, NULL, w.submit FROM freed f JOIN waits w ON f.page = w.page AND f.life = w.life AND f.form = w.form AND coalesce(f.turn, 0) = w.turn WHERE f.replayed AND f.pending = 0)"""
