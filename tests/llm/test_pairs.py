"""Operators on pairs of documents, against brute force on small tables."""

import random

import numpy as np
import pytest

from fitgate.llm import components, decontaminate, jaccard
from fitgate.llm.common import Stages
from tests.llm import brute


def near_copies(seed, groups=12, copies=8, long=False):
    """Texts with exact and near copies, shared lines, short and empty ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choices(vocabulary, k=25))
    rows, doc_id = [(-5, None), (-4, ""), (-3, " \n"), (-2, "one"), (-1, "One"), (0, "one two"), (1, "one two three"), (2, "two one")], 10
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([4, 9, 30, 60, 120, 300]))
        if g % 3 == 0:
            base += shared.split()
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((doc_id, " ".join(words)))
            doc_id += rng.randrange(1, 4)
    rng.shuffle(rows)
    return rows


def brute_components(rows, size=3, percent=90):
    sets = {}
    for doc_id, text in rows:
        w = brute.words(brute.lower(text))
        sets[doc_id] = ({tuple(w)} if w else set()) if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(d, len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_documents(spark, monkeypatch, seed):
    monkeypatch.setattr("fitgate.llm.blocks.BLOCK_CHARS", 5_000)
    rows = near_copies(seed)
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows] + [(10**6, None, 1), (None, "no id", 2)] + [(rows[0][0], rows[0][1], 8)], "doc_id long, text string, n long").repartition(4)
    got = {tuple(r) for r in jaccard.similar_documents(docs).collect()}
    assert got == brute_components([*rows, (10**6, None)])
    kept = jaccard.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "n"]
    heads = {c for _, _, c in got}
    assert {r.doc_id for r in kept.collect()} == heads | {None}


def one_group(n, seed, size, percent):
    """Near copies of one text, edited so much that many of them link with few others."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    most = 6 if (size, percent) == (5, 80) else 5
    rows, last = [], base
    for d in range(n):
        words = list(last if rng.random() < 0.1 else base)
        for _ in range(rng.randrange(most + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(40)}" if rng.random() < 0.5 else f"u{d}-{rng.random()}"
        rows.append((d, " ".join(words)))
        last = words
    return rows


@pytest.mark.parametrize(("size", "percent"), [(5, 80), (3, 90)])
def test_candidates_follow_the_rows_of_a_group(spark, monkeypatch, size, percent):
    counts = {}
    write = Stages.write

    def counted(self, df, name, **options):
        out = write(self, df, name, **options)
        if name in ("stars0", "keys", "by_chief", "by_deviation", "candidates"):
            counts[name] = out.count()
        return out

    monkeypatch.setattr(Stages, "write", counted)
    seen = {}
    for n in (150, 600):
        rows = one_group(n, n, size, percent)
        got = {tuple(r) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
        assert got == brute_components(rows, size, percent)
        assert len({c for _, _, c in got}) > 50
        assert counts["by_chief"] <= 3 * counts["keys"]
        assert counts["by_deviation"] + counts["candidates"] <= n
        seen[n] = counts
    # four times the rows: the tables that are linear by design grow no more than these
    assert seen[600]["stars0"] <= 5 * seen[150]["stars0"]
    assert seen[600]["keys"] <= 5 * seen[150]["keys"]


def test_deviations_are_worked_out_once(spark):
    """One run of the function per task, so one Python worker, and the keys of both roles in it."""
    packed = lambda values, kind: np.array(values, kind).tobytes()
    base = list(range(1000, 1100))
    held = {1: base, 2: [*base[:60], *range(5000, 5040)], 3: [*base[:98], 7000, 7001], 4: [*base[:60], *range(5000, 5030), *range(6000, 6010)]}
    cells = [(d, packed(s, np.uint64), packed([4 if x in base else 2 for x in s], np.uint16)) for d, s in held.items()]
    sets = spark.createDataFrame(cells, "doc_id long, s binary, h binary")
    near = spark.createDataFrame([(2, 1, False), (3, 1, True), (4, 1, False)], "a long, b long, linked boolean")
    out = jaccard._deviations(near, sets, 80)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan
    keys = {}
    for r in out.collect():
        keys.setdefault((r.a, r.linked, r.role), []).append(r.key)
    # k = 1/9: a stray that differs from the leader by 80 elements shares (80 - 200/9) / (10/9), so 52, of these with anyone; 3, with 4, shares 2 with a stray
    assert {k: len(v) for k, v in keys.items()} == {(2, False, "s"): 29, (2, False, "l"): 29, (3, True, "l"): 3, (4, False, "s"): 29, (4, False, "l"): 29}
    assert all(len(set(v)) == len(v) for v in keys.values())
    assert keys[2, False, "s"] == keys[2, False, "l"] and set(keys[2, False, "s"]) & set(keys[4, False, "s"])


def test_texts_that_clash_on_an_id(spark):
    """Of different texts with one doc_id the one with the smallest digest counts, in every run alike."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (2, a), (3, b), (4, b), (3, a), (3, "")]
    out = set()
    for k in (1, 3):
        docs = spark.createDataFrame(rows[::-1] if k > 1 else rows, "doc_id long, text string").repartition(k)
        out.add(frozenset(tuple(r) for r in jaccard.similar_documents(docs).collect()))
    assert out == {frozenset({(1, 28, 1), (2, 28, 1), (3, 0, 3), (4, 28, 4)})}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert jaccard.similar_documents(none).count() == 0
    assert decontaminate.find_leaks(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (500, 490), (490, 500)]
    out = components.connected(spark.createDataFrame(edges, "a long, b long"), Stages(spark, "t"), "c")
    got = {tuple(r) for r in out.collect()}
    assert got == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(30)} | {(500, 490), (490, 490)}


def brute_leaks(docs, items, least=0.8):
    from collections import Counter

    out = {}
    for d, text in docs:
        w = brute.words((text or "").lower())
        for item, item_text in items:
            q = brute.words((item_text or "").lower())
            if not q or not w:
                continue
            k = min(5, len(q))
            bag = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
            best = 0
            for s in range(max(1, len(w) - len(q) + 1)):
                a, b = bag(w[s : s + len(q)]), bag(q)
                best = max(best, sum((a & b).values()) / max(1, sum((a | b).values())))
            if best >= least:
                out[d, item] = round(best, 9)
    return out


def test_leaks(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 6, 20, 45, 70])))) for i in range(12)] + [(90, None), (91, " "), (92, "a a a a a a a a a a a a")]
    docs = [(1, None), (2, ""), (3, items[5][1]), (4, "a " * 9)]
    for d in range(10, 60):
        words = rng.choices(vocabulary, k=rng.randrange(1, 150))
        leak = items[rng.randrange(12)][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            leak[rng.randrange(len(leak))] = "changed"
        at = rng.randrange(len(words))
        docs.append((d, " ".join([*words[:at], *(leak if rng.random() < 0.8 else leak[: len(leak) // 2]), *words[at:]]).upper()))
    got = decontaminate.find_leaks(
        spark.createDataFrame([(d, t, "x") for d, t in docs] + [(3, items[5][1], "again"), (None, items[4][1], "no id")], "doc_id long, text string, item_id string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    want = brute_leaks(docs, items)
    assert len(want) > 30
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want
    kept = decontaminate.drop_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_with_parts_in_another_order(spark):
    rng = random.Random(6)
    item = [f"q{i}" for i in range(60)]
    other = lambda n: rng.choices([f"o{i}" for i in range(500)], k=n)
    third = [*item[40:], *item[20:40], *item[:20]]
    short = [f"s{i}" for i in range(40)]
    items = [(1, " ".join(item)), (2, " ".join(short)), (3, "s1 s2 s3")]
    docs = [
        (1, other(200) + item[30:] + item[:30] + other(200)),
        (2, item[30:] + item[:30]),
        (3, other(9) + third + other(9)),
        (4, other(50) + item[:30] + other(1) + item[30:] + other(50)),
        (5, other(50) + item[:30] + other(60) + item[30:]),
        (6, short[20:] + short[:20] + other(3)),
        (7, short[1:37]),
        (8, short[4:36]),
        (8, other(32)),
        (9, item[30:58] + item[:30]),
        (10, other(300)),
    ]
    docs = [(d, " ".join(w)) for d, w in docs]
    for _ in range(30):
        k = rng.randrange(2, 59)
        docs.append((len(docs) + 100, " ".join([*other(rng.randrange(40)), *item[k:], *other(rng.randrange(3)), *item[:k], *other(rng.randrange(40))])))
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find_leaks(*frames).collect()}
    want = brute_leaks(docs, items)
    assert want[1, 1] == round(52 / 60, 9)
    assert got == want
    assert {r.doc_id for r in decontaminate.drop_leaks(*frames).collect()} == {d for d, _ in docs} - {d for d, _ in want}


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_DOCUMENTS, 0])
def test_texts_without_windows_are_not_shuffled(spark, monkeypatch, most):
    """However large the table of documents with windows is: no join of all texts, and the same rows either way."""
    monkeypatch.setattr(decontaminate, "BROADCAST_DOCUMENTS", most)
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"before {item} behind"), (2, "nothing of it in this text at all"), (1, "a repeated id with another text"), (3, item)]
    plans, write = [], decontaminate.Stages.write
    monkeypatch.setattr(decontaminate.Stages, "write", lambda self, df, name, **k: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(self, df, name, **k))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
        got = [(r.doc_id, r.item_id, r.start, r.similarity) for r in decontaminate.find_leaks(*frames).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got) == [(1, 7, 1, 1.0), (3, 7, 0, 1.0)]
    plan = dict(plans)["windows"]
    assert ("BroadcastHashJoin" in plan and "LeftSemi" in plan) == (most > 0)


def test_texts_for_sets_are_one_small_value(spark, sf, monkeypatch):
    """A block is one row of a shuffle: its texts pass through executors compressed."""
    made = []
    real = jaccard.text_blocks
    monkeypatch.setattr(jaccard, "text_blocks", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    signed = {r.doc_id: r.n for r in jaccard.set_signatures(docs, Stages(spark, "test"), 3, 90).select("doc_id", "n").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert signed == {d: len(jaccard.shingle_set(t)) for d, t in texts.items()}
    sent = sum(len(r.texts) if isinstance(r.texts, bytes | bytearray) else sum(len(t.encode()) for t in r.texts) for r in made[0].collect())
    assert sent < 0.6 * sum(len(t.encode()) for t in texts.values())
