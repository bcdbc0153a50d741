"""Deleted interpolation: a bigram model whose weights depend on how often the context was seen.

    p(w | v) = a2[b] * c(v, w) / c(v)  +  a1[b] * c(w) / N  +  a0[b] / (V + 1)

b is the frequency bucket of the context, the number of binary digits of c(v). The weights
come from expectation-maximisation on held-out counts: every training token in turn is
deleted from the counts that predict it (so c(v, w) - 1, c(v) - 1, c(w) - 1). For that, the
tokens are counted by bucket and by the logarithms of the two ratios in quarter octaves, a
table of bounded size whatever the corpus; the counts themselves are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgate.llm.blocks import SMALL_GROUPS, owners_for, real_ids, requests, send, text_blocks, total_answers, unpack, with_answers
from fitgate.llm.common import Stages, mix, word_hashes

WORD, PAIR = 0, 1
END = np.uint64(0xE7037ED1A0B428DB)
START = np.uint64(0x8EBC6AF09C88C6E3)
_PAIR_FACTOR = np.uint64(0xD6E8FEB86659FD93)
BUCKETS, CELLS = 64, 256
ITERATIONS = 60


def tokens(text: str) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, and of the end."""
    return np.append(word_hashes(text.encode().lower().split()), END)


def _flat(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, pairs and lengths of a block's documents, one after the other."""
    docs = [tokens(t) for t in texts]
    lengths = np.array([len(d) for d in docs], np.int64)
    words = np.concatenate(docs)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(lengths) - lengths] = START
    return words, mix(before * _PAIR_FACTOR + words), lengths


def bucket(n: np.ndarray) -> np.ndarray:
    """The number of binary digits."""
    return np.where(n > 0, np.frexp(n.astype(np.float64))[1], 0)


def _cell(p: np.ndarray) -> np.ndarray:
    """0 for zero, else one more than the quarter octaves below 1."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.minimum(CELLS - 2, np.floor(-4 * np.log2(np.maximum(p, 1e-300)))), 0).astype(np.int64)


def _value(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 2.0 ** (-(cell - 0.5) / 4), 0.0)


def fit_weights(bucket_of: np.ndarray, cell2: np.ndarray, cell1: np.ndarray, n: np.ndarray, unknown: float) -> np.ndarray:
    """Weights (buckets x 3: bigram, word, uniform) by expectation-maximisation over counted cells.
    Buckets without held-out tokens take the weights of the nearest lower one that has some."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    p = np.stack([_value(cell2), _value(cell1), np.full(len(n), unknown)], axis=1)
    seen = np.bincount(bucket_of, n, BUCKETS)
    for _ in range(ITERATIONS):
        part = weights[bucket_of] * p
        part *= (n / part.sum(axis=1))[:, None]
        for k in range(3):
            np.divide(np.bincount(bucket_of, part[:, k], BUCKETS), seen, out=weights[:, k], where=seen > 0)
    for b in range(1, BUCKETS):
        if not seen[b] and b > 1:
            weights[b] = weights[b - 1]
    # the floor keeps every text possible
    weights = np.maximum(weights, 1e-6)
    weights[0, 0] = 0
    return weights / weights.sum(axis=1, keepdims=True)


class Counts:
    """The counts behind every token of a block: pair, context, word."""

    def __init__(self, row, found: dict):
        words, pairs, self.lengths = _flat(row.texts)
        totals = []
        for kind, keys in ((WORD, words), (PAIR, pairs)):
            _, at = np.unique(keys, return_inverse=True)
            totals.append(np.concatenate([unpack(a) for a, _ in found[kind]]).astype(np.int64)[at])
        self.word, self.pair = totals
        first = np.cumsum(self.lengths) - self.lengths
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[first] = self.word[first + self.lengths - 1]  # texts begin as often as they end
        self.train = np.repeat(np.array(row.flags, bool), self.lengths)


def score_documents(docs: DataFrame, train: Column) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``train`` holds. Scores are sums of log10 probabilities over the
    words and the end of a text. ``base_score`` is the word model with 0.1 added to every count. NULL text
    counts as empty (its end alone is scored); repeated rows are counted and scored each; a row
    with a NULL doc_id is treated as any other; other columns are ignored; an empty table gives an empty result. A text
    is never cut: one document lies in one block, however long. Words and word pairs are counted by 64-bit hashes; for
    a billion different ones the chance that any two share a count is about 3 %.
    """
    stages = Stages(docs.sparkSession, "lm")
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(True)).alias("flag"))
    blocks = text_blocks(rows, stages, packed=True)
    size = blocks.agg(F.sum("n_chars")).first()[0] or 0
    bits = owners_for(size // 6)  # about six characters a word

    def ask(block: int, _, texts, flags) -> Iterator[tuple]:
        words, pairs, lengths = _flat(texts)
        learned = np.repeat(np.array(flags, bool), lengths)
        for kind, keys in ((WORD, words), (PAIR, pairs)):
            distinct, at = np.unique(keys, return_inverse=True)
            yield from requests(block, kind, distinct, bits, np.bincount(at, learned, len(distinct)))

    answers = stages.write(total_answers(send(blocks, ask)), "answers", **SMALL_GROUPS)
    n_types = answers.where(f"block = -1 and kind = {WORD}").agg(F.sum("n")).first()[0] or 0
    spark = docs.sparkSession

    def held_out(row, found) -> pd.DataFrame:
        c = Counts(row, found)
        word, pair, context = (x[c.train] - 1 for x in (c.word, c.pair, c.context))
        with np.errstate(divide="ignore", invalid="ignore"):
            p2 = np.where(context > 0, pair / context, 0)
        # the word's share needs N, which is known only later: its count goes into the cell
        code = (bucket(context).astype(np.int64) * CELLS + _cell(p2)) * CELLS + _cell(np.where(word > 0, word / 2.0**50, 0))
        codes, n = np.unique(code, return_counts=True)
        total = int(c.train.sum())
        return pd.DataFrame({"code": np.append(codes, -1), "n": np.append(n, total)})

    cells = with_answers(blocks, answers, held_out, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    n_train = int(cells.loc[cells["code"] == -1, "n"].sum())
    cells = cells[cells["code"] >= 0].sort_values("code")
    code = cells["code"].to_numpy(np.int64)
    unknown = 1 / (n_types + 1)
    weights = np.full((BUCKETS, 3), 0.0)
    weights[:, 2] = 1
    if n_train > 1:
        scale = 4 * np.log2(2.0**50 / (n_train - 1))  # from shares of 2**50 to shares of N
        cell1 = code % CELLS
        cell1 = np.where(cell1 > 0, np.maximum(1, cell1 - scale), 0)
        weights = fit_weights(code // CELLS // CELLS, code // CELLS % CELLS, cell1, cells["n"].to_numpy(np.float64), unknown)
    model = spark.sparkContext.broadcast(weights)

    def score(row, found) -> pd.DataFrame:
        c = Counts(row, found)
        starts = np.cumsum(c.lengths) - c.lengths
        with np.errstate(divide="ignore", invalid="ignore"):
            w = model.value[bucket(c.context)]
            p = w[:, 0] * np.where(c.context > 0, c.pair / np.maximum(c.context, 1), 0) + w[:, 1] * (c.word / max(n_train, 1)) + w[:, 2] * unknown
        base = np.log10((c.word + 0.1) / (n_train + 0.1 * (n_types + 1)))
        return pd.DataFrame({
            "doc_id": real_ids(row.doc_ids), "n_tokens": c.lengths,
            "n_known": np.add.reduceat((c.word > 0).astype(np.int64), starts), "train_tokens": n_train,
            "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts),
        })

    return with_answers(blocks, answers, score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
