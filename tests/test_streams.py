"""Stateful streams, step by step: several deliveries, late rows, repeated batches."""

import pytest

from fitgate.plans.page_events import READY
from fitgate.session import shared_folder
from fitgate.streaming import broker, feeds, sessions

PAGE = "event_id long, us long, page long, form long, input long, kind string, files long"


def play(spark, make, schema, *deliveries):
    return [tuple(r) for r in feeds.fed([spark.createDataFrame(list(d), schema) for d in deliveries], make).collect()]


def page(*events, form=1, at=7):
    """(id, kind, input, files) as rows of one page, a second apart."""
    return [(i, i * 1_000_000, at, form, source, kind, files) for i, kind, source, files in events]


def actions(spark, *deliveries):
    rows = play(spark, sessions.page_actions, PAGE, *deliveries)
    return sorted([(e, a, i, s, h, f) for p, e, a, i, s, h, f in rows], key=repr)


def row(event, action, source=None, session=None, held=None, submit=None):
    return event, action, source, session, held, submit


#: Pages, each with what comes in three deliveries and what is given out.
SCENES = {
    "both events of a choice are held and replayed once": (
        [[(1, "input", 10, 0), (2, "change", 10, 0)], [(3, "done", 10, 0)], [(4, "done", 10, 0)]],
        [row(1, "hold", 10, 1), row(2, "join", 10, 1), row(3, "replay", 10, 1, "input,change"), row(4, "discard", 10)],
    ),
    "a newer choice supersedes and its own result counts": (
        [[(1, "change", 10, 0)], [(2, "change", 10, 1)], [(3, "done", 10, 0), (4, "done", 10, 1)]],
        [row(1, "hold", 10, 1), row(2, "cancel", 10, 1), row(2, "hold", 10, 2), row(3, "discard", 10), row(4, "replay", 10, 2, "change")],
    ),
    "files that need no work pass and still supersede": (
        [[(1, "change", 10, READY)], [(2, "change", 10, 0)], [(3, "change", 10, READY), (4, "done", 10, 0)]],
        [row(1, "pass", 10), row(2, "hold", 10, 2), row(3, "cancel", 10, 2), row(3, "pass", 10), row(4, "discard", 10)],
    ),
    "removal and the end of the page cancel": (
        [[(1, "change", 10, 0), (2, "change", 11, 0), (3, "submit", 10, 0)], [(4, "removed", 10, 0), (5, "removed", 10, 0)], [(6, "pagehide", 10, 0), (7, "done", 11, 0)]],
        [row(1, "hold", 10, 1), row(2, "hold", 11, 2), row(3, "submit_held"), row(4, "cancel", 10, 1), row(6, "cancel", 11, 2), row(7, "discard", 11)],
    ),
    "a submit waits for the sessions of its form": (
        [[(1, "change", 10, 0), (2, "change", 11, 0), (3, "submit", 10, 0)], [(5, "done", 10, 0), (6, "submit", 10, 0)], [(7, "done", 11, 0), (8, "submit", 10, 0)]],
        [row(1, "hold", 10, 1), row(2, "hold", 11, 2), row(3, "submit_held"), row(5, "replay", 10, 1, "change"), row(6, "submit_held"), row(7, "flush", submit=6), row(7, "replay", 11, 2, "change"), row(8, "submit")],
    ),
    "an input that is removed lets no submit go, the next result of the form does": (
        [[(1, "change", 10, 0), (2, "submit", 10, 0)], [(3, "removed", 10, 0), (4, "change", 11, 0)], [(5, "done", 11, 0)]],
        [row(1, "hold", 10, 1), row(2, "submit_held"), row(3, "cancel", 10, 1), row(4, "hold", 11, 4), row(5, "flush", submit=2), row(5, "replay", 11, 4, "change")],
    ),
}


@pytest.fixture(scope="module")
def scenes(spark):
    parts = [[r for at, (deliveries, _) in enumerate(SCENES.values()) for r in page(*deliveries[k], at=at)] for k in range(3)]
    # another form on one of the pages has no session
    parts[0] += page((9, "submit", 20, 0), form=2, at=100) + page((1, "change", 30, 0), form=3, at=100)
    out = {}
    for p, *rest in play(spark, sessions.page_actions, PAGE, *parts):
        out.setdefault(p, []).append(tuple(rest))
    return out


@pytest.mark.parametrize("name", SCENES)
def test_page(scenes, name):
    at = list(SCENES).index(name)
    assert sorted(scenes[at], key=repr) == sorted(SCENES[name][1], key=repr)


def test_other_form(scenes):
    assert sorted(scenes[100]) == [row(1, "hold", 30, 1), row(9, "submit")]


def test_late_and_incomplete_events(spark):
    rows = [(9, None, 7, 1, 10, "change", 0), (None, 9, 7, 1, 10, "change", 0), (9, 9, None, 1, 10, "change", 0)]
    got = actions(spark, page((5, "change", 10, 0)), page((4, "removed", 10, 0), (5, "change", 10, 0)) + rows, page((6, "done", 10, 0)), [])
    assert got == [(4, "late", 10, None, None, None), (5, "hold", 10, 5, None, None), (5, "late", 10, None, None, None), (6, "replay", 10, 5, "change", None)]


def test_state_makes_the_result(spark):
    """The same events in one delivery or in several give the same; without the state of earlier ones they could not."""
    events = page(*[(k, kind, 10 + k % 2, k // 7 % 2) for k, kind in enumerate(["input", "change", "done", "submit", "change", "done", "removed"] * 6)])
    whole = actions(spark, events)
    assert whole == actions(spark, events[:5], events[5:30], events[30:])
    assert whole != sorted(actions(spark, events[:5]) + actions(spark, events[5:]), key=repr)


BROKER = "event_id long, us long, profile long, kind string, subject long, frame long"


def test_tokens(spark):
    second = 1_000_000
    first = [(k, k, 1, "token", k, 0) for k in range(65)]
    later = [(70, 20 * second, 1, "verify", 3, 0), (71, 20 * second + 1, 1, "verify", 3, 0), (72, 21 * second, 1, "verify", 4, 1), (73, 22 * second, 1, "verify", 4, 0), (74, 23 * second, 1, "token", 74, 0)]
    last = [(80, 30 * second + 5, 1, "verify", 5, 0), (81, 30 * second + 7, 1, "verify", 6, 0), (82, 31 * second, 1, "token", 82, 0), (160, 5, 1, "verify", 7, 0), (83, 32 * second, 2, "verify", 82, 0)]
    got = {(p, e): a for p, e, a in play(spark, broker.broker_answers, BROKER, first, later, last)}
    assert [got[1, k] for k in range(65)] == ["issued"] * 64 + ["full"]
    assert [got[1, k] for k in range(70, 75)] == ["ok", "refused", "refused", "refused", "issued"]
    assert [got[1, k] for k in (80, 81, 82)] == ["ok", "refused", "issued"]
    assert got[1, 160] == "late" and got[2, 83] == "refused"


def test_jobs(spark):
    at = lambda *rows: [(k, k, 1, kind, job, frame) for k, kind, job, frame in rows]
    first = at(*[(k, "prepare", k, 5) for k in range(1, 9)], (9, "prepare", 9, 5), (10, "prepare", 3, 5))
    second = at((11, "cancel", 3, 4), (12, "cancel", 3, 5), (13, "finish", 3, 5), (14, "finish", 3, 5), (15, "prepare", 9, 4), (16, "cancel", 9, 5), (17, "else", 1, 1))
    got = {e: a for _, e, a in play(spark, broker.broker_answers, BROKER, first, second)}
    assert [got[k] for k in range(1, 18)] == ["accepted"] * 8 + ["busy", "busy", "ignored", "forwarded", "finished", "unknown", "accepted", "ignored", None]


def test_notices(spark):
    ms = 1000
    schema = "event_id long, us long, job long, kind string"
    first = [(1, 0, 1, "start"), (2, 10 * ms, 2, "start"), (3, 20 * ms, 3, "start"), (4, 300 * ms, 1, "finish"), (5, 500 * ms, 2, "finish")]
    second = [(6, 900 * ms, 3, "finish"), (7, 1000 * ms, 4, "start")]
    third = [(8, 1200 * ms, 5, "start"), (9, 2000 * ms, 6, "start")]
    got = sorted(play(spark, broker.notices, schema, first, second, third))
    assert got == [(2, "down", 500), (2, "up", 360), (3, "down", 900), (3, "up", 370), (4, "up", 1350), (5, "up", 1550)]


def test_progress(spark):
    schema = "event_id long, us long, job long, fraction long"
    rows = [(k, k, 1, f) for k, f in enumerate([5, 19, 20, 39, 41, 40, 61, 999, 1000, 1003])]
    assert sorted(play(spark, broker.shown_progress, schema, rows[:4], rows[4:])) == [(1, 2, 20), (1, 4, 41), (1, 6, 61), (1, 7, 999), (1, 8, 1000), (1, 9, 1000)]


def test_idle_sessions_and_late_rows(spark):
    schema = "us long, owner long"
    s = 1_000_000
    make = lambda stream: feeds.closed_sessions(stream, "owner", 10 * s, "5 seconds")
    first = [(0, 1), (9 * s, 1), (19 * s, 1), (3 * s, 2), (50 * s, 3)]
    late = [(46 * s, 2), (8 * s, 2), (12 * s, 1), (None, 1), (60 * s, None), (61 * s, 3)]
    last = [(200 * s, 4)]
    got = sorted(play(spark, make, schema, first, late, last))
    assert got == [(1, 0, 9 * s, 2), (1, 19 * s, 19 * s, 1), (2, 3 * s, 3 * s, 1), (2, 46 * s, 46 * s, 1), (3, 50 * s, 50 * s, 1), (3, 61 * s, 61 * s, 1)]


def test_empty_stream(spark):
    assert play(spark, sessions.page_actions, PAGE, []) == []


def test_shared_folder(spark):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("C", (), {"master": "spark://somewhere:7077", "applicationId": "a"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Elsewhere, "x")
    assert shared_folder(spark, "x").rpartition("/")[0] == shared_folder(spark, "y").rpartition("/")[0]
