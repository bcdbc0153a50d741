"""N-gram Jaccard self-join with several global token orders.

Two sets with Jaccard similarity of 90 % or more share an element among the first
``n // 10 + 1`` of each set, for every order of all elements. So a candidate pair must share
a prefix element under each of three orders. All of them put the elements that fewest
documents hold first, one by the exact number of documents and two by its binary digits, and
each scrambles equals in its own way: in a group of near copies all numbers are about the
same, so the three prefixes are three different samples.

* The numbers of documents are looked up in blocks (see blocks.py). An element that no other
  document holds is in no intersection, so a document that has too many of these links with nothing.
* Documents with the same set are one representative from then on.
* A document survives an order only if some other document shares one of its prefix elements.
* Every survivor is compared with the leader, the smallest document, of each of its prefix
  buckets: as many comparisons as rows. Documents that link to a leader are in one component.
* Of the others (strays), two that are near one leader can only link if they deviate from it in
  the same elements. Two sets link when |x ^ y| <= k(|x| + |y|), k = (1 - t) / (1 + t) for
  threshold t, where ^ is the symmetric difference; if dx and dy elements tell them from the leader
  L, c of these in common, |x ^ y| = dx + dy - 2c. A stray y has dy > k(|y| + |L|), so whoever
  links with a stray shares c > (dx - k|x| + k|L|) / 2 deviations with it, about half of its own;
  and a stray x shares at least (dx - k(|x| + |L|)) / (1 + k) with anyone. Deviations that no
  other document has cannot be shared, though they count in dx. So the deviations get prefixes
  of their own (rare ones first): one for pairs of strays, one for a stray and a linked document.
  A document with more deviations of its own than it may have gets none.
* In a deviation key strays first meet three of its members, by scrambled order; those that link
  are in the component of these from then on, and only pairs of different components are formed.
* Before a pair is formed, the elements that each has alone and a parity sketch of the rest give
  a lower bound of |x ^ y|: of members of a group of near copies that share a rare deviation
  but do not link, nearly all stop there, so pairs follow links, not the square of the group.
* Those far from the leader choose a new one, three times. What is left then, strangers in a
  bucket, meets under the same bound; two documents that link are never torn apart, because
  their similarities to a leader differ by 1 - t at most.
* Pairs from deviations and strangers are verified if they share a prefix element under the
  other orders too. Pairs inside a component could add no component.

Elements are 64-bit hashes of shingles; sets are compared exactly as sets of these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgate.llm.blocks import SMALL_GROUPS, owners_for, requests, send, text_blocks, total_answers, unpack, with_answers
from fitgate.llm.common import Stages, mix, rolling, word_hashes
from fitgate.llm.components import connected

SHINGLE = 3
PERCENT = 90
ORDERS = 3
#: A document is near a leader from this similarity on; how often those that are far choose a new one.
NEAR, TURNS = 0.3, 3
#: Members of a deviation key that all others of it are compared with.
CHIEFS = 3
SET_SEEDS = np.array([0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7, 0x6A09E667F3BCC909], np.uint64)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased."""
    hashes = word_hashes((text or "").encode().lower().split())
    if 0 < len(hashes) < size:
        # a marker keeps a short sequence apart from a shingle of as many words
        return rolling(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(rolling(hashes, size))


def prefix(elements: np.ndarray, holders: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The elements of which a similar set must hold at least one under one order, without those that no other set holds."""
    n = len(elements)
    length = n - -(-n * percent // 100) + 1
    weight = holders if order == 0 else np.frexp(holders.astype(np.float64))[1]
    first = np.lexsort((mix(elements ^ SET_SEEDS[order]), weight))[:length]
    return elements[first[holders[first] > 1]]


#: Words of 64 bits in the parity sketch of a set.
SKETCH = 4
BOUNDS = ["n", "alone", *[f"b{k}" for k in range(SKETCH)]]
SIGNED = "doc_id long, n long, d1 long, d2 long, s binary, h binary, alone long, " + ", ".join([f"b{k} long" for k in range(SKETCH)] + [f"p{k} binary" for k in range(ORDERS)])


def sketch(elements: np.ndarray) -> list[int]:
    """For each of 64 * SKETCH bits, whether an odd number of elements falls on it. Two sets differ in at least as many elements as their sketches in bits."""
    bits = np.bincount((mix(elements ^ SET_SEEDS[0]) >> np.uint64(8)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def set_signatures(docs: DataFrame, stages: Stages, size: int, percent: int, prefixes: bool = True) -> DataFrame:
    """SIGNED rows for all documents: set size and a 128-bit digest; for those that may have a partner among these documents also the set, its numbers
    of holders (16 bits each), how many it holds alone, the sketch of the others, and, if asked for, its prefixes, as packed longs."""
    blocks = text_blocks(docs.withColumn("flag", F.lit(True)), stages, packed=True)
    chars = blocks.agg(F.sum("n_chars")).first()[0] or 0
    bits = owners_for(chars // 6)

    def sets_in(texts) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        sets = [shingle_set(t, size) for t in texts]
        distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
        return sets, distinct, at

    def ask(block: int, _, texts, flags) -> Iterator[tuple]:
        _, distinct, at = sets_in(texts)
        yield from requests(block, 0, distinct, bits, np.bincount(at, minlength=len(distinct)))

    answers = stages.write(total_answers(send(blocks, ask)), "holders", **SMALL_GROUPS)

    def sign(row, found) -> pd.DataFrame:
        sets, _, at = sets_in(row.texts)
        holders = np.concatenate([unpack(a) for a, _ in found[0]]).astype(np.int64)[at] if 0 in found else np.zeros(0, np.int64)
        n = len(sets)
        numbers = {c: np.zeros(n, np.int64) for c in ("d1", "d2", *BOUNDS)}
        packed = {c: [None] * n for c in ("s", "h", *(f"p{k}" for k in range(ORDERS)))}
        none, start = np.ones(n, bool), 0
        for i, s in enumerate(sets):
            h = holders[start : start + len(s)]
            start += len(s)
            numbers["n"][i] = len(s)
            for k, d in enumerate(("d1", "d2")):
                numbers[d][i] = mix(s ^ SET_SEEDS[k]).sum(dtype=np.uint64).view(np.int64)
            shared = h > 1
            among = int(np.count_nonzero(shared))
            if not len(s) or 100 * among < percent * len(s):
                continue
            none[i] = False
            numbers["alone"][i] = len(s) - among
            for k, word in enumerate(sketch(s[shared])):
                numbers[f"b{k}"][i] = word
            packed["s"][i], packed["h"][i] = s.tobytes(), np.minimum(h, 65535).astype(np.uint16).tobytes()
            for k in range(ORDERS if prefixes else 0):
                packed[f"p{k}"][i] = prefix(s, h, k, percent).tobytes()
        # NULL among integers must not make floats of them
        bounds = {c: pd.arrays.IntegerArray(numbers[c], none.copy()) for c in BOUNDS if c != "n"}
        signed = pd.DataFrame({"doc_id": np.asarray(row.doc_ids, np.int64), **numbers, **packed} | bounds)
        return signed[[c.split()[0] for c in SIGNED.split(", ")]]

    return stages.write(with_answers(blocks, answers, sign, SIGNED), "signed")


def _unpack(packed: str) -> Column:
    @F.pandas_udf("array<long>")
    def longs(values: pd.Series) -> pd.Series:
        return values.map(lambda b: np.frombuffer(b, np.int64))

    return longs(F.col(packed))


def _common(left: str, right: str) -> Column:
    """How many elements two packed sets share."""

    @F.pandas_udf("long")
    def count(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)], dtype="int64")

    return count(left, right)


def _with_sets(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with the named columns of both documents, as x_... and y_..."""
    for side, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{name}_{c}") for c in columns]), side)
    return pairs


def measured(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, j): whether and how similar the pairs are."""
    both = _with_sets(stars, sets, "n", "s").select("a", "b", "x_n", "y_n", _common("x_s", "y_s").alias("c"))
    union = F.col("x_n") + F.col("y_n") - F.col("c")
    return both.select("a", "b", (100 * F.col("c") >= percent * union).alias("linked"), (F.col("c") / union).alias("j"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; only those that share prefix elements under all orders are looked at."""

    @F.pandas_udf("long")
    def shared(x: pd.Series, y: pd.Series, *prefixes: pd.Series) -> pd.Series:
        """How many elements two packed sets share; none is looked at if their prefixes of some order do not meet."""
        out = []
        for p, q, *row in zip(x, y, *prefixes, strict=True):
            halves = [np.frombuffer(r, np.uint64) for r in row]
            meet = all(len(np.intersect1d(halves[k], halves[k + ORDERS], assume_unique=True)) for k in range(ORDERS))
            out.append(len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) if meet else 0)
        return pd.Series(out, dtype="int64")

    names = [f"p{k}" for k in range(ORDERS)]
    both = _with_sets(pairs, sets, "n", "s", *names)
    counted = both.select("a", "b", "x_n", "y_n", shared("x_s", "y_s", *[f"x_{p}" for p in names], *[f"y_{p}" for p in names]).alias("c"))
    return counted.where(100 * F.col("c") >= percent * (F.col("x_n") + F.col("y_n") - F.col("c"))).select("a", "b")


def _deviations(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, linked, role, key): keys of the deviations of a from its leader b that another document must share
    to link with a; role s for pairs with one that did not link to b, role l for pairs of such a one with one that did.
    Both are worked out in one pass."""
    k = (100 - percent) / (100 + percent)

    @F.pandas_udf("s array<long>, l array<long>")
    def keys(linked: pd.Series, leader: pd.Series, xs: pd.Series, xh: pd.Series, ys: pd.Series, yh: pd.Series) -> pd.DataFrame:
        stray, joined = [], []
        for link, b, p, ph, q, qh in zip(linked, leader, xs, xh, ys, yh, strict=True):
            x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            hx, hy = np.frombuffer(ph, np.uint16).astype(np.int64), np.frombuffer(qh, np.uint16).astype(np.int64)
            more, less = ~np.isin(x, y, assume_unique=True), ~np.isin(y, x, assume_unique=True)
            d = int(more.sum() + less.sum())
            more &= hx > 1
            elements = np.concatenate([x[more], mix(y[less])])
            # rare: an element more that few hold, an element less that most hold
            weight = np.concatenate([hx[more], np.maximum(1, hy.max() - hy[less])])
            keyed = mix(elements[np.lexsort((elements, weight))] ^ mix(np.array([b], np.int64).view(np.uint64))).view(np.int64)
            with_any = max(1, int(np.ceil((d - k * (len(x) + len(y))) / (1 + k) - 1e-9)))
            with_stray = max(1, int(np.floor((d - k * len(x) + k * len(y)) / 2 - 1e-9)) + 1)
            if not link:
                with_stray = max(with_stray, with_any)
            for_stray = keyed[: max(0, len(keyed) - with_stray + 1)]
            stray.append(keyed[:0] if link else for_stray)
            joined.append(for_stray if link else keyed[: max(0, len(keyed) - with_any + 1)])
        return pd.DataFrame({"s": stray, "l": joined})

    # not deterministic to the planner: it would test the arrays for emptiness by a second run of the function, in a second Python worker
    once = keys.asNondeterministic()
    both = _with_sets(near, sets, "s", "h").select("a", "linked", once("linked", "b", "x_s", "x_h", "y_s", "y_h").alias("k"))
    of_role = lambda role: F.transform(f"k.{role}", lambda key: F.struct(F.lit(role).alias("role"), key.alias("key")))
    return both.select("a", "linked", F.explode(F.concat(of_role("s"), of_role("l"))).alias("e")).select("a", "linked", "e.*")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether the lower bound of |x ^ y| allows the similarity, for the columns BOUNDS of both under these prefixes."""
    differ = F.col(f"{x}alone") + F.col(f"{y}alone")
    for k in range(SKETCH):
        differ = differ + F.bit_count(F.col(f"{x}b{k}").bitwiseXOR(F.col(f"{y}b{k}")))
    n1, n2 = F.col(f"{x}n"), F.col(f"{y}n")
    return ((100 + percent) * differ <= (100 - percent) * (n1 + n2)) & (100 * n1 >= percent * n2) & (100 * n2 >= percent * n1)


def linked_groups(rows: DataFrame, sets: DataFrame, stages: Stages, percent: int, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of all documents that link with another one.

    rows (doc_id, t), a written table: documents that link share a key t. sets: rows of SIGNED with a set, one for each document of rows. verified: which of the
    pairs (a, b), two documents that may link, do. The latest written tables begin with ``last-``.
    """
    # leaders: all members of a bucket are measured against its smallest document, those far from it choose again
    near, known = None, None
    for turn in range(TURNS):
        leader = rows.groupBy("t").agg(F.min("doc_id").alias("b"))
        led = rows.join(leader, "t").where("doc_id <> b")
        stars = stages.write(led.select(F.col("doc_id").alias("a"), "b").distinct(), f"stars{turn}")
        similar = stages.write(measured(stars, sets, percent), f"measured{turn}")
        known = similar if known is None else known.unionByName(similar)
        on = led.withColumnRenamed("doc_id", "a").join(similar.where(F.col("j") <= NEAR + 1 - percent / 100), ["a", "b"])
        rows = stages.write(on.select(F.col("a").alias("doc_id"), "t"), f"rows{turn + 1}")
    links = known.where("linked").select("a", "b").distinct()
    components = lambda name: stages.write(connected(links, stages, name), f"{name}-all").withColumnRenamed("component", "c")
    placed = lambda df, doc, name: df.join(groups.select(F.col("node").alias(doc), F.col("c").alias(name)), doc, "left").withColumn(name, F.coalesce(name, doc))
    groups = components("first")

    # near one leader: those that did not link to it meet others in the deviations they share
    near = known.where(F.col("j") >= NEAR).distinct()
    stray = near.where("not linked").select("b").distinct()
    bounds = sets.select(F.col("doc_id").alias("a"), *BOUNDS)
    keys = stages.write(_deviations(near.join(stray, "b", "left_semi"), sets, percent).join(bounds, "a"), "keys")
    second = lambda df, **more: df.select(*more.get("by", ()), F.col("a").alias("b"), F.col("ca").alias("cb"), *[F.col(c).alias(f"y_{c}") for c in BOUNDS])
    pair = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    differ = F.col("ca") != F.col("cb")
    # again leaders first, three of each key: whoever links with many in a key is soon in their component
    at = placed(keys, "a", "ca")
    whole = F.struct(*at.columns)
    chiefs = at.where("role = 's' or linked").groupBy("role", "key").agg(F.array_distinct(F.array(*[F.min_by(whole, F.xxhash64("a", F.lit(k))) for k in range(CHIEFS)])).alias("y"))
    chiefs = second(chiefs.select(F.explode("y").alias("y")).select("y.*"), by=("role", "key"))
    led = at.where("not linked").join(chiefs, ["role", "key"]).where((F.col("a") != F.col("b")) & differ & _may_link("", "y_", percent))
    led = stages.write(led.select(*pair).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti"), "by_chief")
    links = links.unionByName(stages.write(verified(led), "linked")).distinct()
    groups = components("then")

    at = stages.write(placed(keys, "a", "ca"), "placed")
    # a pair of strays is formed once; of a stray and a linked document, the stray is the left one
    turn_of = F.when(F.col("role") == "s", F.col("b") < F.col("a")).otherwise(F.col("by"))
    by_deviation = at.where("not linked").join(second(at, by=("role", "key", F.col("linked").alias("by"))), ["role", "key"]).where(turn_of & differ & _may_link("", "y_", percent))
    by_deviation = stages.write(by_deviation.select(*pair).distinct().join(led, ["a", "b"], "left_anti"), "by_deviation")
    # strangers that are left in a bucket
    left = stages.write(placed(rows.withColumnRenamed("doc_id", "a"), "a", "ca").join(bounds, "a"), "left")
    mixed = left.groupBy("t").agg(F.min("ca").alias("lo"), F.max("ca").alias("hi")).where("lo <> hi").select("t")
    left = left.join(mixed, "t", "left_semi")
    strangers = left.join(second(left, by=("t",)), "t").where((F.col("b") < F.col("a")) & differ & _may_link("", "y_", percent)).select("a", "b")
    candidates = stages.write(by_deviation.unionByName(strangers.distinct()).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti"), "candidates")
    more = stages.write(verified(candidates), "more")
    return connected(links.unionByName(more), stages, "last")


def similar_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document.

    Documents link when 100 * |A & B| >= percent * |A | B| over their distinct word shingles; the
    component is the smallest doc_id that links reach. Texts with fewer words than a shingle
    have one element, their whole sequence; texts without words (or NULL) have none and link with nothing.
    Repeated rows with one doc_id give one row; if their texts differ, only the one with the smallest set digest
    counts. Rows with a NULL doc_id are left out; other columns are ignored; an empty table gives an empty result.
    """
    stages = Stages(docs.sparkSession, "jaccard")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    signed = set_signatures(docs, stages, size, percent)
    stages.drop("blocks")
    stages.drop("holders")
    digest = ["n", "d1", "d2"]
    members = signed.groupBy("doc_id").agg(F.min(F.struct(*digest)).alias("d"), F.max(F.struct(*digest)).alias("other"))
    clash = members.where("d <> other").select("doc_id", "d")
    members = members.select("doc_id", "d.*")
    some = signed.where("s is not null").join(clash, "doc_id", "left").where(F.col("d").isNull() | (F.col("d") == F.struct(*digest))).drop("d")
    # a set that several documents have is one representative, whatever the number of its copies
    reps = some.groupBy(*digest).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    reps = some.drop("d1", "d2").join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = stages.write(reps, "sets")
    alive = sets.select("doc_id", *[f"p{k}" for k in range(ORDERS)])

    for k in range(ORDERS):
        rows = alive.select("doc_id", F.explode(_unpack(f"p{k}")).alias("t"))
        shared = rows.groupBy("t").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("t")
        found = rows.join(shared, "t", "left_semi").select("doc_id").distinct()
        alive = stages.write(alive.join(found, "doc_id", "left_semi"), f"alive{k}")

    rows = stages.write(alive.select("doc_id", F.explode(_unpack("p0")).alias("t")), "rows0")
    final = linked_groups(rows, sets, stages, percent, lambda pairs: _verified(pairs, sets, percent)).withColumnRenamed("node", "rep")
    stages.keep("signed", "last-")

    by_digest = some.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    by_digest = by_digest.join(final, "rep", "left").select(*digest, F.coalesce("component", "rep").alias("component_id"))
    return members.join(by_digest, digest, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document with the smallest id stays.
    All columns unchanged; rows with a NULL id stay, as do those with NULL or empty text, which are near nothing. Rows with
    one doc_id stay or go together; an empty table stays empty; texts are compared whole, however long."""
    extra = similar_documents(docs, size, percent).where("component_id <> doc_id").select("doc_id")
    return docs.join(extra, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
