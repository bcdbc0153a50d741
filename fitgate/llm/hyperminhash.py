"""Near-duplicate documents by HyperMinHash.

A set of shingle hashes is cut by the first seven bits into 128 buckets. Of the smallest hash of each bucket a
register keeps the number of leading zeros and the ten bits behind the first one: 16 bits. An empty
bucket borrows the register of another one, by a fixed sequence of random choices, so small sets fill
all registers too, and a register of two sets is equal with the probability of their Jaccard similarity.

* Registers are banded, four to a key, 32 keys. Two sets of similarity 0.85 share no key with probability
  ``(1 - 0.85 ** 4) ** 32``, 6 in 10**11. Only sets that share a key with another one go on.
* Equal sets are one representative from then on; a bucket of many members meets its leader first, then
  members that deviate from the leader in the same elements, and never all pairs (see jaccard.py).
* The registers that are equal, less those that would be by chance, estimate the similarity of a
  pair; pairs far below the threshold stop there: with a margin of 0.25 a link is lost with a probability of 6 in 10**11.
* What is left is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgate.llm.common import Stages, mix
from fitgate.llm.jaccard import SET_SEEDS, linked_groups, measured, set_signatures, shingle_set

SHINGLE, PERCENT = 3, 85
#: Buckets (a power of two), bits of a mantissa, registers of a band.
BUCKETS, MANTISSA, BAND = 128, 10, 4
_BITS = BUCKETS.bit_length() - 1
#: An estimate this far below the threshold rules a pair out.
MARGIN = 0.25
_EDGES = np.arange(BUCKETS + 1, dtype=object) << (64 - _BITS)
_STARTS = _EDGES[:-1].astype(np.uint64)
SIGNED = "doc_id long, n long, d1 long, d2 long, registers binary"


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit registers for each sorted set of 64-bit hashes; none may be empty."""
    smallest = np.zeros((len(sets), BUCKETS), np.uint64)
    filled = np.zeros((len(sets), BUCKETS), bool)
    for i, s in enumerate(sets):
        first = np.searchsorted(s, _STARTS)
        filled[i] = np.diff(first, append=len(s)) > 0
        smallest[i, filled[i]] = s[first[filled[i]]]
    value = (smallest << np.uint64(_BITS)) >> np.uint64(11)  # 53 bits, exact as a float
    length = np.frexp(value.astype(np.float64))[1].astype(np.int64)
    shift = length - 1 - MANTISSA
    head = (value >> np.maximum(shift, 0).astype(np.uint64)) << np.maximum(-shift, 0).astype(np.uint64)
    out = ((53 - length) << MANTISSA | (head.astype(np.int64) & (2**MANTISSA - 1))).astype(np.uint16)
    # empty buckets borrow from the first filled one in an order of their own, the same for all sets
    open_ = np.flatnonzero(~filled.all(1))
    wanted, lent = ~filled[open_], out[open_]
    for k in range(1, BUCKETS):
        if not wanted.any():
            break
        lender = _LENDERS[:, k]
        now = wanted & filled[open_][:, lender]
        lent[now] = out[open_][:, lender][now]
        wanted &= ~now
    out[open_] = lent
    return out


#: For each bucket an order of all buckets, itself first.
_LENDERS = np.array([[b, *(x for x in np.argsort(mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(1000 * b + 1))) if x != b)] for b in range(BUCKETS)])


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How probable it is that registers of disjoint sets of n and m elements are equal."""
    zeros = np.arange(54)[:, None]
    within = lambda size: np.exp(-size / BUCKETS * 2.0 ** -(zeros + 1)) - np.exp(-size / BUCKETS * 2.0**-zeros)
    return (within(n) * within(m)).sum(0) / 2**MANTISSA


def estimated(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarities by the share of equal registers, less those that are equal by chance."""
    c = chance(n.astype(np.float64), m.astype(np.float64))
    return ((x == y).mean(1) - c) / (1 - c)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """SIGNED rows: size and 128-bit digest of a document's set, and its registers (NULL for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                sets = [shingle_set(t, size) for t in part["text"]]
                some = [i for i, s in enumerate(sets) if len(s)]
                packed: list[bytes | None] = [None] * len(sets)
                for i, row in zip(some, registers([sets[i] for i in some]), strict=True):
                    packed[i] = row.tobytes()
                digests = [np.array([mix(s ^ seed).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for seed in SET_SEEDS[:2]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n": [len(s) for s in sets], "d1": digests[0], "d2": digests[1], "registers": packed})

    return docs.mapInPandas(run, SIGNED)


def _likely(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate is not far below the threshold."""

    @F.pandas_udf("double")
    def estimate(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        rows = [np.frombuffer(b"".join(c), np.uint16).reshape(-1, BUCKETS) for c in (x, y)]
        return pd.Series(estimated(*rows, n.to_numpy(), m.to_numpy()))

    for side, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(signed.select(F.col("doc_id").alias(side), F.col("registers").alias(f"{name}_r"), F.col("n").alias(f"{name}_n")), side)
    return pairs.where(estimate("x_r", "y_r", "x_n", "y_n") >= percent / 100 - MARGIN).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Documents link when 100 * |A & B| >= percent * |A | B| over their distinct word shingles, A-Z lower-cased; the component is the
    smallest doc_id that links reach, and a document is kept if it is that one. Texts with fewer words than a shingle have one
    element, their whole sequence; texts without words (or NULL) have none and link with nothing. Repeated rows with
    one doc_id give one row; if their texts differ, only the one with the smallest set digest counts. Rows with a NULL doc_id are left out; other
    columns are ignored; texts are read whole, however long; an empty table gives an empty result.
    """
    stages = Stages(docs.sparkSession, "hyperminhash")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    digest = ["n", "d1", "d2"]
    signed = stages.write(signatures(docs, size), "all")
    members = signed.groupBy("doc_id").agg(F.min(F.struct(*digest, "registers")).alias("m")).select("doc_id", "m.*")
    members = stages.write(members, "members")
    stages.drop("all")
    # equal sets are one representative, whatever the number of its copies
    reps = members.where("n > 0").groupBy(*digest).agg(F.min("doc_id").alias("doc_id"), F.any_value("registers").alias("registers"))
    reps = stages.write(reps, "reps")
    bands = [F.xxhash64(F.lit(k), F.substring("registers", 2 * BAND * k + 1, 2 * BAND)) for k in range(BUCKETS // BAND)]
    rows = reps.select("doc_id", F.explode(F.array(*bands)).alias("t"))
    shared = rows.groupBy("t").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("t")
    rows = stages.write(rows.join(shared, "t", "left_semi"), "banded")
    # only these can link; their sets are made anew and compared among themselves
    texts = docs.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = set_signatures(texts, stages, size, percent, prefixes=False)
    stages.keep("members", "reps", "banded", "signed")
    sets = sets.where("s is not null").join(reps.select("doc_id", *digest), ["doc_id", *digest], "left_semi").drop("d1", "d2").dropDuplicates(["doc_id"])
    sets = stages.write(sets, "sets")
    stages.drop("signed")
    rows = stages.write(rows.join(sets.select("doc_id"), "doc_id", "left_semi"), "rows0")

    def verified(pairs: DataFrame) -> DataFrame:
        return measured(_likely(pairs, reps, percent), sets, percent).where("linked").select("a", "b")

    final = linked_groups(rows, sets, stages, percent, verified)
    stages.keep("members", "reps", "last-")
    by_digest = reps.select(*digest, F.col("doc_id").alias("rep")).join(final.withColumnRenamed("node", "rep"), "rep", "left")
    by_digest = by_digest.select(*digest, F.coalesce("component", "rep").alias("component_id"))
    out = members.drop("registers").join(by_digest, digest, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
