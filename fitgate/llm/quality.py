"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one long
whose bit *i* says that rule *i* failed. Policies are versioned bit masks: applying one is
``failed & mask = 0`` and asks for no text, and what each rule costs alone or together
(an ablation) is a bitwise aggregation over the ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgate.llm.common import BLANKS, Stages

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_stutter")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Callable[[dict[str, Column]], Column]


#: All rules, integer arithmetic on the measurements only. A bit is never reused for another meaning.
RULES = (
    Rule(0, "few_words", lambda m: m["n_words"] < 20),
    Rule(1, "repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule(2, "symbols", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    Rule(3, "word_length", lambda m: (m["word_chars"] > 15 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"])),
    # of a few lines one that is there twice says nothing
    Rule(4, "duplicate_lines", lambda m: (m["n_dup_lines"] >= 3) & (100 * m["n_dup_lines"] > 30 * m["n_lines"])),
    Rule(5, "shouting", lambda m: 2 * m["n_upper"] > m["n_letters"]),
    Rule(6, "few_letters", lambda m: 2 * m["n_letters"] < m["word_chars"]),
    Rule(7, "stutter", lambda m: 100 * m["n_stutter"] > 30 * m["n_words"]),
)


#: Versioned policies: the bits that reject. Old versions stay, so that old decisions can be repeated.
POLICIES = {1: 0b00000011, 2: 0b00111111, 3: 0b11111111}
CURRENT_POLICY = 3
BASE_MASK = POLICIES[1]


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words lie in a window of ``width`` words that is found twice or more.

    Exact: names for runs of 1, 2, 4 ... words come from pairs of names, by sorting.
    """
    n = len(words)
    if n <= width or width & (width - 1):
        if width & (width - 1):
            raise ValueError("the window must be a power of two")
        return 0
    known: dict[bytes, int] = {}
    names = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    run = 1
    while run < width:
        pairs = names[: n - 2 * run + 1] * np.int64(n) + names[run : n - run + 1]
        _, names = np.unique(pairs, return_inverse=True)
        run *= 2
    again = np.bincount(names)[names] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: len(again)] += again
    edge[width : width + len(again)] -= again
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def _measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = text if not raw.isascii() else None
    if letters is None:
        n_letters = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        n_upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    else:
        n_letters = sum(map(str.isalpha, letters))
        n_upper = sum(map(str.isupper, letters))
    return (
        len(words),
        len(text) - sum(text.count(b) for b in BLANKS),
        len(raw) - len(raw.translate(None, SYMBOLS.encode())),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        n_letters,
        n_upper,
        sum(map(eq, words, words[1:])),
    )


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measure_texts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = [_measure(t) for t in batch]
        yield pd.DataFrame(np.array(rows, np.int64).reshape(-1, len(MEASURES)), columns=list(MEASURES))


def failed_bits(measures: Column) -> Column:
    """The failure bits of a struct of measurements."""
    m = {name: measures[name] for name in MEASURES}
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the measurements and ``failed``, the failure bits.

    No shuffle: rows are measured where they are read. NULL text counts as empty and fails
    ``few_words``; repeated rows give repeated rows; an empty table gives an empty ledger;
    other columns of ``docs`` are not looked at, whatever their names. A very long text is
    measured in one task within memory linear in its length.
    """
    measured = docs.select(F.col(id_col).alias("doc_id"), measure_texts(F.col(text_col)).alias("m"))
    return measured.select("doc_id", "m.*", failed_bits(F.col("m")).alias("failed"))


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger as a written table: policies of any version and ablations read it, and no text is measured again."""
    return Stages(docs.sparkSession, "quality").write(ledger(docs, id_col, text_col), "ledger")


def apply_policy(book: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy has failed. Reads no text."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(book: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """One row for each rule of the policy: how many documents it rejects, how many it alone
    rejects, and how many would be kept without it. One pass: the ledger is first counted by
    its bit pattern (at most 2**rules rows), the rest is bit arithmetic on those counts."""
    mask = POLICIES[version]
    counts = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    active = [r for r in RULES if mask >> r.bit & 1]
    table = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in active])).alias("r")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return (
        counts.select("bits", "n", table).select("bits", "n", "r.*")
        .groupBy("rule", "bit")
        .agg(
            F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when((F.col("bits") == 0) | alone, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def keep_good(docs: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all their columns unchanged. Each row is judged alone, where it is
    read: NULL and empty text go (too few words), repeated rows stay or go together, an empty table stays empty."""
    taken = "__measures"
    while taken in docs.columns:
        taken += "_"
    kept = failed_bits(F.col(taken)).bitwiseAND(F.lit(POLICIES[version])) == 0
    return docs.withColumn(taken, measure_texts(F.col("text"))).where(kept).drop(taken)
