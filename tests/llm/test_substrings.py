import pathlib
import random

import numpy as np
import pytest

from fitgate.llm import substring, suffixes
from tests.llm import brute


def repeated_texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"u{i}" for i in range(300)] + ["é", "😀", "a", "A"]
    passages = [rng.choices(words, k=rng.choice([18, 19, 20, 21, 40, 70])) for _ in range(8)]
    rows = [(1, None), (2, ""), (3, "short text"), (4, " ".join(["same"] * 50)), (5, "x\x0by\tz\n" * 12)]
    for d in range(10, 10 + n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choice(passages) if rng.random() < 0.5 else rng.choices(words, k=rng.randrange(1, 60))
        rows.append((d, rng.choice([" ", "\n", "  "]).join(parts)))
    rows.append((500, rows[-1][1]))
    rng.shuffle(rows)
    return rows


def brute_repeats(rows, width=20):
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        w = brute.words(text)
        gone = set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone |= set(range(i, i + width))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), brute.sha(kept), kept)
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_repeats(spark, monkeypatch, batches):
    monkeypatch.setattr("fitgate.llm.blocks.BLOCK_CHARS", 3000)
    rows = repeated_texts(3)
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, n_words int, kept string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring.remove_repeats(docs, batches=batches).collect()}
    want = brute_repeats(rows)
    assert got == want
    assert sum(n for _, n, _, _ in want.values()) > 500


def test_no_rows_and_repeated_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(none).count() == 0
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring.remove_repeats(docs).collect()) == [0, 25, 25]


def in_batches(spark, folder, rows, n, after=lambda k: None):
    """What remove_repeats gives for n batches of one index, each committed."""
    got = {}
    for k in range(n):
        part = spark.createDataFrame(rows[k * len(rows) // n : (k + 1) * len(rows) // n], "doc_id long, text string").repartition(2)
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(part, index=folder, batch=f"b{k}").collect()}
        substring.commit_batch(spark, folder, f"b{k}")
        after(k)
    return got


def test_an_index_that_later_batches_open(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("fitgate.llm.blocks.BLOCK_CHARS", 4_000)
    rows = sorted(repeated_texts(8), key=lambda r: r[0])
    want = {d: (n, m, sha) for d, (n, m, sha, _) in brute_repeats(rows).items()}
    folder, tiers = f"{tmp_path}/index", []
    got = in_batches(spark, folder, rows, 5, lambda k: tiers.append([r.tier for r in substring.FingerprintIndex(spark, folder, 0).runs]))
    assert got == want
    assert tiers == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0]]
    # a run that a lost job left half written, and one that a compacted run covers, do not count
    (tmp_path / "index" / "run-9-9-tier0-bits3").mkdir()
    index = substring.FingerprintIndex(spark, folder, 0)
    index._write(index.rows(index.runs[0]).limit(0), substring.Run(1, 1, 0, index.bits))
    assert [r.tier for r in substring.FingerprintIndex(spark, folder, 0).runs] == [2, 0]


def test_a_batch_whose_job_was_lost_runs_again(spark, tmp_path):
    folder = f"{tmp_path}/index"
    text = lambda k: " ".join(f"w{k}-{i}" for i in range(60))
    first, second = [(k, text(k)) for k in range(3)], [(9, text(1)), (10, text(7)), (11, text(7))]
    run = lambda rows, name: sorted((r.doc_id, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), index=folder, batch=name).collect())
    want = [(0, 0), (1, 0), (2, 0)]
    assert run(first, "a") == want and run(first, "a") == want
    substring.commit_batch(spark, folder, "a")
    substring.commit_batch(spark, folder, "a")
    assert run(second, "b") == run(second, "b") == [(9, 60), (10, 0), (11, 60)]
    # lost between the mark of the commit and the move of its table
    pending = next((tmp_path / "index" / "pending").iterdir()).name
    (tmp_path / "index" / "commits" / f"{pending}-number1").touch()
    assert [r.name[:9] for r in substring.FingerprintIndex(spark, folder, 0).runs] == ["run-0-0-t", "run-1-1-t"]
    assert run([(20, text(7)), (21, text(8))], "c") == [(20, 60), (21, 0)]
    for name in ("a", "b"):
        with pytest.raises(ValueError, match="already"):
            run(first, name)
    with pytest.raises(ValueError, match="no such batch"):
        substring.commit_batch(spark, folder, "never")
    with pytest.raises(ValueError, match="name of a batch"):
        substring.remove_repeats(spark.createDataFrame(first, "doc_id long, text string"), index=folder)


def test_ranges_are_cut_anew_as_an_index_grows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("fitgate.llm.blocks.KEYS_PER_OWNER", 40)
    rows = sorted(repeated_texts(9), key=lambda r: r[0])
    want = {d: (n, m, sha) for d, (n, m, sha, _) in brute_repeats(rows).items()}
    folder = f"{tmp_path}/index"
    bits = []
    one = substring.remove_repeats(spark.createDataFrame(rows[:1], "doc_id long, text string"), index=folder, batch="first").collect()
    substring.commit_batch(spark, folder, "first")
    bits.append(substring.FingerprintIndex(spark, folder, 0).bits)
    got = in_batches(spark, folder, rows[1:], 3, lambda k: bits.append(substring.FingerprintIndex(spark, folder, 0).bits))
    assert got | {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in one} == want
    assert bits == sorted(bits) and bits[-1] >= bits[0] + 2


def test_a_sorted_run_is_searched():
    rng = np.random.default_rng(1)
    key, check = rng.integers(0, 50, 200).astype(np.uint64), rng.integers(0, 4, 200).astype(np.uint16)
    run = sorted({(int(k), int(c)) for k, c in zip(rng.integers(0, 50, 90), rng.integers(0, 4, 90), strict=True)})
    got = substring._known(key, check, np.array([k for k, _ in run], np.uint64), np.array([c for _, c in run], np.uint16))
    assert got.tolist() == [(int(k), int(c)) in set(run) for k, c in zip(key, check, strict=True)]
    assert not substring._known(key, check, np.zeros(0, np.uint64), np.zeros(0, np.uint16)).any()


def brute_bytes(rows, size=50):
    first, out = {}, {}
    for d, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            first[s] = min(first.get(s, d), d)
    for d, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < d:
                gone[i : i + size] = [True] * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, brute.sha(kept), kept)
    return out


def test_byte_strings(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_CHARS", 3000)
    rng = random.Random(9)
    rows = repeated_texts(4)
    base = "".join(rng.choices("abcdeé ", k=700))
    for d in range(600, 640):
        a, b = sorted(rng.choices(range(700), k=2))
        rows.append((d, base[a:b] + rng.choice(["", "x" * 60, "q"]) + base[a // 2 : a]))
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_bytes int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()}
    assert got == brute_bytes(rows)


def test_byte_strings_odd_tables(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "0123456789" * 6
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + "x"), (2, text[:49])], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in suffixes.remove_repeats(docs).collect()) == [("1", 60), ("1", 60), ("2", 0), ("None", 0)]


@pytest.mark.parametrize("opening,closing", [(44, 44), (30, 44), (44, 30)])
def test_byte_strings_end_with_their_document(spark, opening, closing):
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    head, tail = letters(opening), letters(closing)
    rows = [(d, head + letters(60) + tail) for d in range(1, 60)]
    rows += [(100, rows[3][1][5:80]), (101, None), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()}
    want = brute_bytes(rows)
    assert [d for d, w in want.items() if w[1]] == [100]
    assert got == want


def test_byte_strings_of_a_gram_that_is_everywhere(spark, monkeypatch):
    """A line amid ever different text is dealt window by window, over many owners."""
    monkeypatch.setattr(suffixes, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(suffixes, "HOT_RUNS", 12, raising=False)
    monkeypatch.setattr("fitgate.llm.blocks.KEYS_PER_OWNER", 500)
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    line = "one line that all have in common"
    rows = [(d, letters(40) + line + letters(40) + "a" * rng.randrange(70)) for d in range(60)]
    rows += [(60 + d, letters(30) + rows[d][1][rng.randrange(30) :] + rows[d + 1][1]) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()}
    assert got == brute_bytes(rows)


def test_stages_of_byte_strings_are_small(spark, monkeypatch):
    """Repeated text is written as its distinct runs, not as ranks of all its places in each round."""
    monkeypatch.setattr(suffixes, "BLOCK_CHARS", 20_000)
    rng = random.Random(5)
    passages = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2000)) for _ in range(40)]
    rows = [(d, "".join(rng.choices(passages, k=3))) for d in range(100)]
    written = {}

    def write(stages, df, name, plain=suffixes.Stages.write, **options):
        out = plain(stages, df, name, **options)
        written[name] = sum(p.stat().st_size for p in pathlib.Path(stages.root.removeprefix("file:"), name).glob("*.parquet"))
        return out

    monkeypatch.setattr(suffixes.Stages, "write", write)
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {d: w[1] for d, w in brute_bytes(rows).items()}
    assert sum(written.values()) < 1.5 * sum(len(t) for _, t in rows)
