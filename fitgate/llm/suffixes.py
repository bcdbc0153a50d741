"""Removal of repeated byte strings: windows meet by their smallest gram and are ranked by prefix doubling.

The rank of a position for length m names the m bytes that start there: equal strings, equal
ranks. Eight bytes are a rank as they stand. From ranks for m bytes, ranks for more come by
sorting pairs (rank of i, rank of i + offset): 8 + 8 = 16, 16 + 16 = 32, and with an offset of
18, 50 bytes, the threshold.

Each window of 50 bytes has a smallest 24-byte gram (by hash). Equal windows have equal grams, so
a window whose gram is in no other document cannot be repeated and drops out, and all windows that can be
equal meet at the owner of their gram: one shuffle serves all rounds of doubling. Windows of one document that follow
each other and share their gram are a run, some 14 windows in 63 bytes. A block of documents sends
the bytes of each distinct run once, with the smallest doc_id that has it, as one packed list per owner; the
owner merges equal runs, ranks their windows and answers with one bit per window. Ranks are
of exact bytes; hashes only deal and filter.

A gram in very many runs (a common line amid ever different text) would make one large task. Its
windows are dealt one by one, by a hash of all their bytes, which spreads them over all owners.

Documents are laid out so that near copies tend to share a block, so large groups of copies cost
little more than one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgate.llm import blocks as bl
from fitgate.llm.common import Stages, mix

THRESHOLD = 50
GRAM = 24
BLOCK_CHARS = 500_000
#: A gram in more runs than this is hot: its windows are dealt one by one. Bounds what one gram brings to its owner.
HOT_RUNS = 20_000
#: Packed numbers are few large values: no attempt at a dictionary.
PACKED = {"parquet.enable.dictionary": "false"}
NAMED = "owner long, block long, kind int, n long, answer binary"
#: Runs of a block: of each its document (by its number in the block), the first byte in it, the number of its distinct run; of each distinct
#: run, ascending by key, the key, the number of windows, the smallest doc_id, the bytes. All packed.
RUNS = "block long, doc_ids array<long>, doc binary, start binary, number binary, keys binary, n binary, low binary, data binary, size long"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _shifted(a: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([a[k:], np.zeros(min(k, len(a)), a.dtype)])


def eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer; zeros follow the end."""
    out = data.astype(np.uint64)
    for k in (1, 2, 4):
        out = (out << np.uint64(8 * k)) | _shifted(out, k)
    return out


class Strings:
    """Strings of bytes, one after the other."""

    def __init__(self, data: bytes | None, lengths: np.ndarray):
        self.data, self.lengths = np.frombuffer(data or b"", np.uint8), lengths
        self.ends = np.cumsum(lengths)
        self.size = int(self.ends[-1]) if len(lengths) else 0

    def places(self, width: int) -> np.ndarray:
        """Places where that many bytes of one string start."""
        n = np.maximum(self.lengths - width + 1, 0)
        first = np.repeat(self.ends - self.lengths - (np.cumsum(n) - n), n)
        return first + np.arange(n.sum())

    def string_of(self, places: np.ndarray) -> np.ndarray:
        """The string of each place; places ascend."""
        return np.repeat(np.arange(len(self.ends)), np.diff(np.searchsorted(places, self.ends), prepend=0))


def encoded(texts) -> tuple[Strings, list[bytes]]:
    docs = [t.encode() for t in texts]
    return Strings(b"".join(docs), np.array([len(d) for d in docs], np.int64)), docs


def window_grams(b: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one document with the same smallest 24-byte gram: (gram, document, first place, number of windows)."""
    starts = b.places(THRESHOLD)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, starts
    e = eight(b.data)
    h = e * _ODD[0] ^ _shifted(e, 8) * _ODD[1] ^ _shifted(e, 16) * _ODD[2]
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    h ^= h >> np.uint64(29)
    span, width = THRESHOLD - GRAM + 1, 1
    while 2 * width <= span:
        h = np.minimum(h, _shifted(h, width))
        width *= 2
    h = np.minimum(h, _shifted(h, span - width))[starts]
    doc = b.string_of(starts)
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    return mix(h[new]), doc[new], starts[new], np.diff(np.append(new, len(starts)))


def window_keys(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of the whole windows at these places."""
    e = eight(data)
    key = np.zeros(len(places), np.uint64)
    for k in (*range(0, THRESHOLD - 8, 8), THRESHOLD - 8):
        key = mix(key ^ e[places + k] * _ODD[0])
    return key


def stretches(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n[i] numbers from starts[i] on, for all i."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first rank of each pair scrambled with the second: key and second rank give the first back, so equal keys
    with equal second ranks are equal pairs."""
    return mix(a ^ mix(b * _ODD[0]))


def _groups(key: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of groups of equal key, or equal (key, b), in that order), ascending by key."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(key)
    k = key[order]
    new = np.append(True, k[1:] != k[:-1])
    if b is None:
        return order, np.flatnonzero(new)
    s = b[order]
    if np.any(~new[1:] & (s[1:] != s[:-1])):  # different pairs with one key: rare, so they cost the longer sort only then
        order = np.lexsort((b, key))
        k, s = key[order], b[order]
        new = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))
    return order, np.flatnonzero(new)


def _spread(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One value per group to all its elements."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(starts, len(order))))
    return out


def distinct_runs(data: bytes, starts: np.ndarray, lengths: np.ndarray, known: dict[bytes, int]) -> np.ndarray:
    """The numbers of these stretches of the data in ``known``, where new ones are put behind the others."""
    cuts = zip(starts.tolist(), (starts + lengths).tolist(), strict=True)
    return np.fromiter((known.setdefault(data[x:y], len(known)) for x, y in cuts), np.int64, len(starts))


def window_ranks(b: Strings) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of groups of equal windows in that order) of all windows of the strings, by prefix doubling."""
    rank = eight(b.data)
    for offset, length in ((8, 16), (16, 32), (18, THRESHOLD)):
        places = b.places(length)
        first, second = rank[places], rank[places + offset]
        # ranks are numbers of groups after the first round, so a pair of them is one integer
        order, starts = _groups(pair_keys(first, second), second) if length == 16 else _groups(first << np.uint64(32) | second)
        if length < THRESHOLD:
            rank = np.zeros(b.size, np.uint64)
            rank[places] = _spread(np.arange(len(starts), dtype=np.uint64), order, starts)
    return order, starts


def rank_runs(asked: DataFrame) -> DataFrame:
    """Answers to runs: a bit per window, whether a doc_id smaller than the one sent with the run has it. ``n`` counts windows."""

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        numbers, sizes, lows = [], [], []
        for data, n, extra in zip(group["keys"], group["n"], group["extra"], strict=True):
            sizes.append(bl.unpack(extra[: 8 * n]).astype(np.int64))
            lows.append(bl.unpack(extra[8 * n :]).view(np.int64))
            lengths = sizes[-1] + THRESHOLD - 1
            numbers.append(distinct_runs(data, np.cumsum(lengths) - lengths, lengths, known))
        number, size, low = map(np.concatenate, (numbers, sizes, lows))
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, number, low)
        runs = Strings(b"".join(known), np.fromiter(map(len, known), np.int64, len(known)))
        del known
        order, starts = window_ranks(runs)
        windows = runs.lengths - THRESHOLD + 1
        first = _spread(np.minimum.reduceat(np.repeat(least, windows)[order], starts), order, starts)
        held = first[stretches((np.cumsum(windows) - windows)[number], size)] < np.repeat(low, size)
        counts = [int(x.sum()) for x in sizes]
        answers = [np.packbits(x).tobytes() for x in np.split(held, np.cumsum(counts)[:-1])]
        return pd.DataFrame({"owner": group["owner"], "block": group["block"], "kind": group["kind"], "n": counts, "answer": answers})

    return asked.groupBy("owner").applyInPandas(decide, NAMED)


_ASKED = [c.split()[0] for c in bl.REQUEST.split(", ")]


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary; NULL unless ``texts``), kept_sha256.

    The UTF-8 bytes that lie in a string of 50 bytes which also starts in a document with a
    smaller doc_id go; ``n_spans`` counts maximal removed runs. Documents with the same doc_id do not
    remove each other's bytes. NULL text has no bytes. A NULL doc_id is smaller than all others. Other columns are
    ignored; an empty table gives an empty result. A text is never cut: one document lies in one block, however long.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "suffixes")

    @F.pandas_udf("long")
    def layout(texts: pd.Series) -> pd.Series:
        """The smallest checksum of the longer words: often equal for near copies."""
        return pd.Series([min(map(zlib.crc32, (w for w in t.encode().split() if len(w) > 8)), default=0) for t in texts])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("flag")).withColumn("near", layout("text"))
    blocks = bl.text_blocks(rows, stages, order_by=("near", "doc_id"), chars=BLOCK_CHARS)
    size = blocks.select(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t)))).first()[0] or 0
    bits = bl.owners_for(size // 8)

    def ask_grams(block: int, _, texts, flags) -> Iterator[tuple]:
        grams, doc, _, _ = window_grams(encoded(texts)[0])
        order = np.argsort(grams)
        g, d = grams[order], doc[order]
        new = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new) if len(g) else new
        runs = np.diff(np.append(new, len(g)))
        yield from bl.requests(block, 0, g[new], bits, runs << 32 | 1 + several)

    grams = stages.write(bl.total_answers(bl.send(blocks, ask_grams)), "grams")

    def cut_runs(row, found) -> pd.DataFrame:
        b, _ = encoded(row.texts)
        keys, doc, first, n = window_grams(b)
        if len(keys):
            order = np.argsort(keys)
            g = keys[order]
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            total = _spread(np.concatenate([bl.unpack(x) for x, _ in found[0]]), order, starts)
            shared, hot = total & np.uint64(2**32 - 1) > 1, total >> np.uint64(32) > HOT_RUNS
            whole, each = np.flatnonzero(shared & ~hot), np.flatnonzero(shared & hot)
            windows = stretches(first[each], n[each])
            keys = np.concatenate([keys[whole], window_keys(b.data, windows)]) if len(each) else keys[whole]
            doc, first = np.append(doc[whole], np.repeat(doc[each], n[each])), np.append(first[whole], windows)
            n = np.append(n[whole], np.ones(len(windows), np.int64))
        order = np.argsort(keys)
        keys, doc, first, n = keys[order], doc[order], first[order], n[order]
        known: dict[bytes, int] = {}
        number = distinct_runs(b.data.tobytes(), first, n + THRESHOLD - 1, known)
        _, at = np.unique(number, return_index=True)
        low = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(low, number, np.asarray(row.doc_ids, np.int64)[doc])
        cells = {"doc": doc, "start": first - (b.ends - b.lengths)[doc], "number": number, "keys": keys[at], "n": n[at], "low": low.view(np.uint64)}
        data = b"".join(known)
        return pd.DataFrame([{"block": row.block, "doc_ids": row.doc_ids} | {k: bl.pack(v) for k, v in cells.items()} | {"data": data, "size": len(data)}])

    runs = stages.write(bl.with_answers(blocks, grams, cut_runs, RUNS), "runs", **PACKED)
    stages.drop("grams")
    # some 4.5 bytes of runs for a window
    run_bits = bl.owners_for((runs.select(F.sum("size")).first()[0] or 0) // 4)

    def ask_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Distinct runs, cut by owner (the leading bits of the key)."""
        for batch in batches:
            for row in batch.itertuples(index=False):
                keys, n, low = bl.unpack(row.keys), bl.unpack(row.n), bl.unpack(row.low)
                edges = [0, *np.searchsorted(keys, np.arange(1, 2**run_bits, dtype=np.uint64) << np.uint64(64 - run_bits)).tolist(), len(keys)]
                ends = np.append(0, np.cumsum(n.astype(np.int64) + THRESHOLD - 1)).tolist()
                found = [
                    (owner, row.block, 0, y - x, row.data[ends[x] : ends[y]], bl.pack(n[x:y]) + bl.pack(low[x:y]))
                    for owner, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if x < y
                ]
                yield pd.DataFrame(found, columns=_ASKED)

    asked = runs.select("block", "keys", "n", "low", "data").mapInPandas(ask_runs, bl.REQUEST)
    answers = stages.write(rank_runs(asked), "answers", **PACKED)

    def found_in(row, found) -> pd.DataFrame:
        """Stretches of windows that an earlier document has: document, first byte in it, number of windows."""
        doc, start, number, size = (bl.unpack(x).astype(np.int64) for x in (row.doc, row.start, row.number, row.n))
        low = bl.unpack(row.low).view(np.int64)
        elsewhere = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in found.get(0, [(b"", 0)])]) > 0
        order = np.argsort(doc << 32 | start)
        doc, start, number = doc[order], start[order], number[order]
        n = size[number]
        later = np.asarray(row.doc_ids, np.int64)[doc] > low[number]
        gone = elsewhere[stretches((np.cumsum(size) - size)[number], n)] | np.repeat(later, n)
        doc, at = np.repeat(doc, n)[gone], stretches(start, n)[gone]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1))) if len(doc) else doc
        answer = bl.pack(doc[new]) + bl.pack(at[new]) + bl.pack(np.diff(np.append(new, len(doc))))
        return pd.DataFrame({"owner": [0], "block": [row.block], "kind": [0], "n": [len(new)], "answer": [answer]})

    gone = stages.write(bl.with_answers(runs.drop("keys", "data", "size"), answers, found_in, NAMED), "gone", **PACKED)
    stages.keep("blocks", "gone")

    def cut(row, found) -> pd.DataFrame:
        docs = [t.encode() for t in row.texts]
        where: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if 0 in found and found[0][0][1]:
            answer, n = found[0][0]
            doc, at, windows = np.split(np.concatenate([bl.unpack(answer[k : k + 8 * n]) for k in range(0, 24 * n, 8 * n)]).astype(np.int64), 3)
            new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            where = dict(zip(doc[new].tolist(), zip(np.split(at, new[1:]), np.split(at + windows, new[1:]), strict=True), strict=True))
        out = []
        for i, data in enumerate(docs):
            removed = spans = 0
            if i in where:
                edge = np.zeros(len(data) + 1, np.int32)
                first, end = where[i]
                edge[first] += 1
                edge[end + THRESHOLD - 1] -= 1  # stretches lie apart, so no end is there twice
                covered = np.cumsum(edge)[:-1] > 0
                removed, spans = int(covered.sum()), int((covered & ~np.append(False, covered[:-1])).sum())
                data = np.frombuffer(data, np.uint8)[~covered].tobytes()
            out.append((len(docs[i]), removed, spans, data if texts else None, sha256(data).hexdigest()))
        result = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
        result.insert(0, "doc_id", bl.real_ids(row.doc_ids))
        return result

    return bl.with_answers(blocks, gone, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
