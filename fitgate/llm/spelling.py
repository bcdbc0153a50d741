"""Spelling variants: words one edit apart, found with forward and backward automata.

Two words that differ by one inserted, deleted or replaced code point agree in the first or in the
second half of either of them. So a word is searched twice: its first half is matched exactly
and its rest completed with one error in an automaton of the words read forwards; its second half
is matched exactly and its rest completed with one error in an automaton of the words read
backwards. What the backward search finds and the forward one finds too is dropped there.

An automaton is the minimal acyclic one of its words; every transition carries the number of
words that come before its target, so the sum along a path is the number of the word (a perfect hash), by
which its count is found. It is built from the sorted words as arrays: the trie level by
level, states merged by a 64-bit hash of their right languages. Searches of many words run side by side
over these arrays.

Words meet in an automaton only if they share an exact half, so the dictionary is dealt out by halves:
an owner holds the halves of one hash value and builds one automaton of their words. A half that
very many words have is dealt out in squares, each with a bounded part of the dictionary and of the searched words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgate.llm.common import Stages, mix

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One of so many (document, run) pairs loses a code point before words are counted.
NOISE = 97
#: Rows of an owner, about; code points of the words of one half, about, in one square.
OWNER_ROWS, SQUARE_CHARS = 20_000, 400_000
#: Halves longer than this have an automaton of their own, so that short words are not padded to long ones.
LONG_HALF = 32
#: Distinct words that a task gathers before it sends their counts on.
GATHERED = 400_000


# -- words and their counts


def _shifted(prefix: int, lengths: int) -> np.ndarray:
    """For n < lengths, what turns the CRC-32 of n bytes into that of the same bytes behind a prefix of this CRC."""
    zeros = b"\0" * lengths
    out = np.zeros(lengths, np.uint32)
    with_prefix, alone = prefix, 0
    for n in range(1, lengths):
        with_prefix, alone = zlib.crc32(zeros[:1], with_prefix), zlib.crc32(zeros[:1], alone)
        out[n] = with_prefix ^ alone
    out[0] = prefix
    return out


def count_runs(ids, texts) -> Counter:
    """How often each word occurs in these documents, after the noise."""
    runs, per_text = [], []
    for t in texts:
        found = RUN.findall(t.encode().lower().decode()) if t else []
        runs += found
        per_text.append(len(found))
    codes, words = pd.factorize(np.array(runs, object)) if runs else (np.zeros(0, np.int64), [])
    raw = [w.encode() for w in words]
    crc = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    hashes = np.zeros(len(codes), np.uint32)
    at = 0
    for doc, n in zip(ids, per_text, strict=True):
        if n:
            own = codes[at : at + n]
            prefix = b":" if doc is None else f"{doc}:".encode()
            hashes[at : at + n] = crc[own] ^ _shifted(zlib.crc32(prefix), int(size[own].max()) + 1)[size[own]]
            at += n
    noisy = hashes % NOISE == 0
    out: Counter = Counter()
    plain = np.bincount(codes[~noisy], minlength=len(raw))
    for k in np.flatnonzero(plain).tolist():
        out[words[k]] = int(plain[k])
    for code, h in zip(codes[noisy].tolist(), hashes[noisy].tolist(), strict=True):
        w = words[code]
        k = h % len(w)
        out[w[:k] + w[k + 1 :]] += 1
    return out


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all documents that are long and frequent enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def rows() -> pd.DataFrame:
            long = [(w, n) for w, n in counts.items() if len(w) >= least_length]
            return pd.DataFrame(long, columns=["word", "n"]).astype({"n": np.int64})

        for batch in batches:
            ids = batch["doc_id"].tolist()
            # a slice of texts at a time, so that long texts do not pile up as lists of runs
            start, chars = 0, 0
            for i, t in enumerate(batch["text"]):
                chars += len(t or "")
                if chars > 1_000_000 or i == len(ids) - 1:
                    counts.update(count_runs(ids[start : i + 1], batch["text"].iloc[start : i + 1]))
                    start, chars = i + 1, 0
            if len(counts) > GATHERED:
                yield rows()
                counts = Counter()
        yield rows()

    # as strings, ids with NULL among them stay whole
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = texts.mapInPandas(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -- automata


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words (Latin-1, without NUL) as rows of bytes, padded by zeros, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max(initial=0)) + 1
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width) if words else np.zeros((0, 1), np.uint8), lengths


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; state 0 is its start."""

    def __init__(self, matrix: np.ndarray, lengths: np.ndarray):
        n, width = matrix.shape
        differ = matrix[1:] != matrix[:-1]
        common = np.append(-1, np.where(differ.any(1), differ.argmax(1), width)) if n else np.zeros(0, np.int64)
        # the trie, level by level: a row begins a node of depth d if it is the first with its first d bytes
        levels = [np.flatnonzero((lengths >= d) & (common < d)) for d in range(width)]
        sign = [np.zeros(len(x), np.uint64) for x in levels]
        for d in range(width - 1, -1, -1):
            first = levels[d]
            sign[d] += mix((lengths[first] == d).astype(np.uint64) + np.uint64(1))
            if d:
                parent = np.searchsorted(levels[d - 1], first, "right") - 1
                edge = mix(sign[d] + mix(matrix[first, d - 1].astype(np.uint64)) * np.uint64(3))
                np.add.at(sign[d - 1], parent, edge)
        every = np.concatenate(sign) if n else np.zeros(1, np.uint64)
        _, chosen, state = np.unique(every, return_index=True, return_inverse=True)
        # the start gets number 0
        start = state[0]
        state = np.where(state == start, 0, np.where(state == 0, start, state))
        chosen[[0, start]] = chosen[[start, 0]]
        offset = np.cumsum([0, *map(len, levels)])
        self.final = np.zeros(len(chosen), bool)
        keys, targets, skipped = [], [], []
        for d in range(width) if n else ():
            nodes = offset[d] + np.arange(len(levels[d]))
            self.final[state[nodes]] = lengths[levels[d]] == d
            if d:
                parent = np.searchsorted(levels[d - 1], levels[d], "right") - 1
                used = chosen[state[offset[d - 1] + parent]] == offset[d - 1] + parent
                keys.append(state[offset[d - 1] + parent[used]] * 256 + matrix[levels[d][used], d - 1])
                targets.append(state[nodes[used]])
                skipped.append(levels[d][used] - levels[d - 1][parent[used]])
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.labels = self.keys % 256
        self.targets = np.concatenate(targets)[order] if len(keys) else keys
        #: words that come before those behind a transition, within its state's
        self.skipped = np.concatenate(skipped)[order] if len(keys) else keys
        self.first = np.searchsorted(self.keys, np.arange(len(chosen) + 1) * 256)

    def step(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have such a transition, and the numbers of these transitions."""
        key = state * 256 + label
        at = np.searchsorted(self.keys, key)
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == key[ok]
        return ok, at[ok]

    def one_error(self, matrix: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word number) of all words one edit from a row, the first ``exact`` bytes of which they share; distinct."""
        width = matrix.shape[1]
        row = np.arange(len(matrix))
        state, number = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        # after the error: rows that go on without one, by the place where they are
        later: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(width + 2)]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for place in range(width):
            after = exact[row] <= place
            r, s, k = row[after], state[after], number[after]
            within = lengths[r] > place
            later[place + 1].append((r[within], s[within], k[within]))  # a code point too many
            many = self.first[s + 1] - self.first[s]
            back = np.repeat(np.arange(len(r)), many)
            edge = np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many) + self.first[s[back]]
            r, k = r[back], k[back] + self.skipped[edge]
            later[place].append((r, self.targets[edge], k))  # one is missing
            other = (lengths[r] > place) & (self.labels[edge] != matrix[r, place])
            later[place + 1].append((r[other], self.targets[edge][other], k[other]))  # another one
            r, s, k = (np.concatenate(x) for x in zip(*later[place], strict=True))
            over = lengths[r] == place
            hit = over & self.final[s]
            found.append((r[hit], k[hit]))
            r, s, k = r[~over], s[~over], k[~over]
            ok, edge = self.step(s, matrix[r, place])
            later[place + 1].append((r[ok], self.targets[edge], k[ok] + self.skipped[edge]))
            within = lengths[row] > place
            row, state, number = row[within], state[within], number[within]
            ok, edge = self.step(state, matrix[row, place])
            row, state, number = row[ok], self.targets[edge], number[ok] + self.skipped[edge]
        r, k = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (row, number)
        both = np.unique(np.stack([r, k], 1), axis=0) if len(r) else np.zeros((0, 2), np.int64)
        return both[:, 0], both[:, 1]


# -- near words


def _halves(words: DataFrame) -> DataFrame:
    """Rows (back, half, role, word, n): what a word is searched by (role q) and found by (role d), forwards and backwards."""
    size = F.length("word")
    first = F.floor(size / 2).cast("int")

    def prefixes(split) -> Column:
        # of the searched words that are as long as this one, one longer or one shorter
        return F.array_distinct(F.array(*[split(size + k) for k in (-1, 0, 1)]))

    sides = [
        (False, F.col("word"), first, lambda m: F.floor(m / 2).cast("int")),
        (True, F.reverse("word"), size - first, lambda m: (m - F.floor(m / 2)).cast("int")),
    ]
    rows = []
    for back, w, exact, split in sides:
        rows.append(F.struct(F.lit(back).alias("back"), F.substring(w, F.lit(1), exact).alias("half"), F.lit("q").alias("role")))
        rows += [F.struct(F.lit(back).alias("back"), F.substring(w, F.lit(1), F.get(prefixes(split), F.lit(i))).alias("half"), F.lit("d").alias("role")) for i in (0, 1)]
    # with one distinct length only, the second prefix is NULL
    return words.select("word", "n", F.explode(F.array(*rows)).alias("k")).select("k.*", "word", "n").where("half is not null")


def search(group: pd.DataFrame) -> pd.DataFrame:
    """(word, near, near_n) for the searched and the dictionary words of one owner; a pair is found in one direction only."""
    out = []
    for back, rows in group.groupby("back"):
        turn = (lambda w: w[::-1]) if back else (lambda w: w)
        asked = sorted({turn(w.encode("latin-1")) for w in rows["word"][rows["role"] == "q"]})
        known = dict(zip([turn(w.encode("latin-1")) for w in rows["word"][rows["role"] == "d"]], rows["n"][rows["role"] == "d"], strict=True))
        words = sorted(known)
        if not asked or not words:
            continue
        matrix, lengths = letters(words)
        automaton = Automaton(matrix, lengths)
        counts = np.array([known[w] for w in words], np.int64)
        for start in range(0, len(asked), 20_000):
            some = asked[start : start + 20_000]
            m, size = letters(some)
            exact = size - size // 2 if back else size // 2
            r, k = automaton.one_error(m, size, exact)
            if back and len(r):
                # also found forwards: the other half is the same too
                rest = size[r] - exact[r]
                offset = np.arange(int(rest.max()))
                a, b = size[r][:, None] - 1 - offset, lengths[k][:, None] - 1 - offset
                same = (m[r[:, None], a] == matrix[k[:, None], np.maximum(b, 0)]) & (b >= 0) | (offset >= rest[:, None])
                r, k = r[~same.all(1)], k[~same.all(1)]
            out += [(turn(some[i]).decode("latin-1"), turn(words[j]).decode("latin-1"), c) for i, j, c in zip(r.tolist(), k.tolist(), counts[k].tolist(), strict=True)]
    return pd.DataFrame(out, columns=["word", "near", "near_n"]).astype({"near_n": np.int64})


def near_words(words: DataFrame, stages: Stages) -> DataFrame:
    """(word, near, near_n) for all pairs of words that are one edit apart, in both directions."""
    rows = stages.write(_halves(words), "halves")
    owners = max(8, -(-rows.count() // OWNER_ROWS))
    # halves that too many words have: no more of them than code points / SQUARE_CHARS
    hot = rows.where("role = 'd'").groupBy("back", "half").agg(F.sum(F.length("word")).alias("chars")).where(F.col("chars") > SQUARE_CHARS)
    rows = rows.join(hot.select("back", "half", F.ceil(F.col("chars") / SQUARE_CHARS).cast("int").alias("cuts")), ["back", "half"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int")
    rows = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    square = [F.when(F.col("role") == role, F.col("own")).otherwise(F.col("other")) for role in "dq"]
    # a square is a group of its own, so that a pair meets once
    alone = (F.col("cuts") > 1) | (F.length("half") > LONG_HALF)
    owner = F.when(alone, F.xxhash64("back", "half", *square)).otherwise(F.pmod(F.xxhash64("back", "half"), F.lit(owners)))
    dealt = rows.select(alone.alias("alone"), owner.alias("owner"), "back", "role", "word", "n")
    return stages.write(dealt.groupBy("alone", "owner").applyInPandas(search, "word string, near string, near_n long"), "pairs")


def spelling_forms(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the documents that is long and frequent enough.

    A word is a run of letters, A-Z lower-cased; one in 97 (document, run) pairs has lost a code point, always the same one in one
    document. Its form is its near word of the largest count, the smaller word among equals, if that has at least twice
    its own count; its root is where forms end. NULL and empty texts have no words, a NULL doc_id counts as an
    empty one, repeated rows count each time, texts are read whole, however long, other columns are ignored, and an empty table gives an
    empty result.
    """
    stages = Stages(docs.sparkSession, "spelling")
    words = stages.write(vocabulary(docs, least_length, least_count), "words")
    best = near_words(words, stages).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    formed = words.join(best, "word", "left")
    ok = -F.col("best.k") >= 2 * F.col("n")
    formed = formed.select("word", F.when(ok, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, -F.col("best.k")).alias("form_n"))
    formed = stages.write(formed, "formed")
    stages.keep("formed")
    # counts double at each step to a form, so chains are short, and each round doubles the steps
    roots, step = stages.write(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        joined = roots.join(further, "root", "left")
        roots = stages.write(joined.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("went")), f"roots{step + 1}")
        stages.drop(f"roots{step}")
        step += 1
        if not roots.where("went").limit(1).count():
            break
        roots = roots.drop("went")
    return formed.join(roots.drop("went"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
