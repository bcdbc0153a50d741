"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fitgate.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def texts(seed, alphabet="abcdéÿ×Z", docs=60):
    rng = random.Random(seed)
    base = ["".join(rng.choices(alphabet, k=rng.choice([4, 5, 5, 6, 7, 9, 14]))) for _ in range(40)]

    def spoilt(w):
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + rng.choice(alphabet) + w[k:], w[: max(0, k - 1)] + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]])
        return w

    weights = [1 / (k + 1) for k in range(len(base))]
    rows = [(i, rng.choice([" ", "1", ". ", "\n"]).join(spoilt(w) for w in rng.choices(base, weights, k=rng.randrange(1, 120)))) for i in range(docs)]
    return [*rows, (3, rows[3][1]), (None, rows[4][1]), (None, None), (900, ""), (901, "12 ... 3"), (902, "Colour " * 40 + "colou\xe0 " * 15 + "coloux " * 5 + "kolou\xe0 " * 5), (903, ("b" * 2_000 + " ") * 3 + ("b" * 2_001 + " ") * 7)]


@pytest.mark.parametrize(("seed", "chars", "long"), [(1, 400_000, 32), (2, 60, 32), (3, 400_000, 2)])
def test_forms(spark, monkeypatch, seed, chars, long):
    """Ordinary; with halves dealt out in squares; with a group for every half."""
    monkeypatch.setattr(spelling, "SQUARE_CHARS", chars if chars > 100 else 60)
    monkeypatch.setattr(spelling, "LONG_HALF", long)
    rows = texts(seed)
    if chars < 100:  # squares of long words would be one for each code point
        rows = rows[:-1]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = [tuple(r) for r in spelling.spelling_forms(docs).collect()]
    want = brute(rows)
    assert len(got) == len(want) and set(got) == want
    assert sum(r[1] is not None for r in got) > 5 and any(r[2] != (r[1] or r[0]) for r in got)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_forms(none).collect() == []
    assert spelling.spelling_forms(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_automaton(seed):
    """Minimal, numbers words in order, and completes halves with one error just as a scan does."""
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 8))).encode() for _ in range(300)})
    matrix, lengths = spelling.letters(words)
    a = spelling.Automaton(matrix, lengths)
    rights = {w[:k]: frozenset(v[k:] for v in words if v.startswith(w[:k])) for w in words for k in range(len(w) + 1)}
    assert len(a.final) == len(set(rights.values()))
    state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for place in range(matrix.shape[1]):
        on = np.flatnonzero(lengths > place)
        ok, edge = a.step(state[on], matrix[on, place])
        assert ok.all()
        state[on], number[on] = a.targets[edge], number[on] + a.skipped[edge]
    assert a.final[state].all() and number.tolist() == list(range(len(words)))
    asked = sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 8))).encode() for _ in range(200)})
    m, size = spelling.letters(asked)
    r, k = a.one_error(m, size, size // 2)
    want = {(i, j) for i, p in enumerate(asked) for j, w in enumerate(words) if w.startswith(p[: len(p) // 2]) and one_edit(p.decode(), w.decode())}
    assert set(zip(r.tolist(), k.tolist())) == want and len(r) == len(want)


def test_counting_is_by_the_document():
    rows = texts(9)
    total = Counter()
    for start in range(0, len(rows), 7):
        total.update(spelling.count_runs([r[0] for r in rows[start : start + 7]], [r[1] for r in rows[start : start + 7]]))
    assert {w: n for w, n in total.items() if len(w) >= 5 and n >= 3} == brute_words(rows)
