"""Incremental removal of repeated word windows with a log-structured fingerprint index.

Documents come in batches. The index is a set of sorted immutable runs of window fingerprints
(64 bits of key, 16 bits of check), each a table. For a new batch, every owner of a key range
merges its part of all runs with the sorted keys of the batch's blocks (a run is searched, never sorted again): a key met before, whose
check agrees, is a repeat, and the answer to each block is one bit per distinct window. Only keys
that are new form the batch's run, so a run never holds what an older one has. Before the next
batch, runs of the same tier are compacted into one run of the next tier.

An index in a folder of its own stays: a later call opens it, compacts it, and merges its batch into it
(``remove_repeats(docs, index=folder, batch=name)``), which counts from ``commit_batch`` on. A call without one is over a closed corpus, in
batches of ascending ids: no batch comes after the last. There, windows that cannot repeat never
enter: each window has a smallest 8-word gram (by hash), equal windows have equal grams, and a
gram found at one place only rules out all windows that have it.

Key and check come from two hash functions of the words that share nothing (scrambled bytes with
their places, and CRC-32 of each word), so a match needs 80 equal bits; for a billion windows the
chance that any differ all the same is about 1 in 2 million.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgate.llm.blocks import ANSWER, REQUEST, owners_for, pack_sorted, real_ids, requests, send, text_blocks, total_answers, unpack, unpack_sorted, with_answers
from fitgate.llm.common import Stages, mix, rolling, word_hashes

WINDOW = 20
GRAM = 8
BATCHES = 4
_WINDOWS, _GRAMS, _RUN_ROW = 0, 1, 2
RUN = "owner long, n long, keys binary, checks binary"
_CHECK = np.uint64(0xA0761D6478BD642F)


class Block:
    """The words of a block's documents with their hashes, worked out once for all that is asked of them."""

    def __init__(self, texts, width: int):
        self.width = width
        self.words = [t.encode().split() for t in texts]
        self.hashes = [word_hashes(w) for w in self.words]
        self.n_words = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.n_windows = np.maximum(0, self.n_words - width + 1)

    def keys(self) -> np.ndarray:
        """The keys of all windows, documents in order."""
        return np.concatenate([np.zeros(0, np.uint64), *(rolling(h, self.width) for h in self.hashes)])

    def checks(self, places: np.ndarray) -> np.ndarray:
        """The checks of the windows at these (ascending) places; documents without any are passed over."""
        ends = np.cumsum(self.n_windows)
        edges = np.searchsorted(places, np.concatenate([[0], ends]))
        out = [np.zeros(0, np.uint64)]
        for k in np.flatnonzero(np.diff(edges)):
            words = self.words[k]
            second = mix(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + _CHECK)
            out.append(rolling(second, self.width)[places[edges[k] : edges[k + 1]] - (ends[k] - self.n_windows[k])] >> np.uint64(48))
        return np.concatenate(out)

    def grams(self, gram: int) -> list[np.ndarray]:
        return [rolling(h, gram) for h in self.hashes]

    def smallest(self, grams: list[np.ndarray], gram: int) -> np.ndarray:
        """For each window, in order, the smallest hash of its grams (scrambled)."""
        span = self.width - gram + 1
        smallest = [np.zeros(0, np.uint64)]
        for low in grams:
            n, known = len(low) - span + 1, 1
            if n > 0:
                whole = low
                while 2 * known <= span:
                    whole = np.minimum(whole[:-known], whole[known:])
                    known *= 2
                smallest.append(np.minimum(whole[:n], whole[span - known :]))
        return mix(np.concatenate(smallest))


def _distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct (key, check), in order, and each window's number among them."""
    order = np.lexsort((np.arange(len(keys)), checks, keys))
    k, c = keys[order], checks[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])) if len(k) else np.zeros(0, bool)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


_RUN_NAME = re.compile(r"run-(\d+)-(\d+)-tier(\d+)-bits(\d+)")


class Run(NamedTuple):
    first: int
    last: int
    tier: int
    #: Into how many ranges the keys are dealt, as a power of two.
    bits: int

    @property
    def name(self) -> str:
        return f"run-{self.first}-{self.last}-tier{self.tier}-bits{self.bits}"


def _split(rows: DataFrame, bits: int, more: int) -> DataFrame:
    """Rows of RUN with each range cut into 2 ** more."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                keys, checks = unpack_sorted(row.keys), np.frombuffer(row.checks, np.uint16)
                inner = (keys << np.uint64(bits)) >> np.uint64(64 - more)
                edges = np.searchsorted(inner, np.arange(2**more + 1, dtype=np.uint64))
                parts = [(row.owner << more | k, int(y - x), pack_sorted(keys[x:y]), checks[x:y].tobytes()) for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if x < y]
                yield pd.DataFrame(parts, columns=["owner", "n", "keys", "checks"])

    return rows.mapInPandas(cut, RUN) if more else rows


def _known(key: np.ndarray, check: np.ndarray, run_key: np.ndarray, run_check: np.ndarray) -> np.ndarray:
    """Which fingerprints a sorted run has; the run is searched, not sorted again."""
    out = np.zeros(len(key), bool)
    open_, at = np.arange(len(key)), np.searchsorted(run_key, key)
    while len(open_):
        inside = at < len(run_key)
        open_, at = open_[inside], at[inside]
        same = run_key[at] == key[open_]
        open_, at = open_[same], at[same]
        found = run_check[at] == check[open_]
        out[open_[found]] = True
        open_, at = open_[~found], at[~found] + 1  # another window with this key
    return out


class FingerprintIndex:
    """The runs of an index, as tables in a folder; a run is never changed, only replaced by a compacted one.

    A run's name says which batches it covers, its tier, and into how many ranges its keys are dealt. Only whole tables count, and of two runs
    that cover a batch the larger one, so a job that was lost while it compacted leaves an index that can be opened. Ranges are cut anew
    when the index has grown, so none gets too large for a task. One writer at a time.

    A named batch is pending until it is committed, and pending batches are not in the history: one that runs again finds what it found before.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: int):
        """keys: about how many the next batch has."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._finish_commits()
        found = [Run(*map(int, m.groups())) for name in self._list("") if (m := _RUN_NAME.fullmatch(name)) and self._fs.exists(self._path(f"{name}/_SUCCESS"))]
        self.runs = sorted(r for r in found if not any(o != r and o.first <= r.first and r.last <= o.last for o in found))
        held = sum(self._rows(r).agg(F.sum("n")).first()[0] or 0 for r in self.runs)
        self.bits = max([owners_for(held + keys), *(r.bits for r in self.runs)])

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _list(self, name: str) -> list[str]:
        path = self._path(name)
        return [e.getPath().getName() for e in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _write(self, rows: DataFrame, run: Run) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{run.name}")
        self.runs.append(run)

    def _rows(self, run: Run) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{self.folder}/{run.name}")

    def rows(self, run: Run) -> DataFrame:
        """A run, dealt into the ranges of now."""
        return _split(self._rows(run), run.bits, self.bits - run.bits)

    # commits: a mark with the number of the batch, then the pending table becomes a run

    @staticmethod
    def _file(batch: str) -> str:
        return sha256(batch.encode()).hexdigest()[:32]

    def committed(self, batch: str) -> bool:
        return any(n.startswith(self._file(batch)) for n in self._list("commits"))

    def commit(self, batch: str) -> None:
        """From now on the batch is part of the history. Once its output is safe; a second call changes nothing."""
        if self.committed(batch):
            return
        pending = next((n for n in self._list("pending") if n.startswith(f"{self._file(batch)}-bits") and self._fs.exists(self._path(f"pending/{n}/_SUCCESS"))), None)
        if pending is None:
            raise ValueError(f"no such batch: {batch}")
        number = max([-1, *(r.last for r in self.runs)]) + 1
        self._fs.mkdirs(self._path("commits"))
        self._fs.create(self._path(f"commits/{pending}-number{number}"), False).close()
        self._finish_commits()
        self.runs.append(Run(number, number, 0, int(pending.rpartition("bits")[2])))

    def _finish_commits(self) -> None:
        """Move the tables of committed batches to their places, also those of a job that was lost before it could."""
        for mark in self._list("commits"):
            pending, _, number = mark.rpartition("-number")
            if self._fs.exists(self._path(f"pending/{pending}")):
                bits = int(pending.rpartition("bits")[2])
                self._fs.rename(self._path(f"pending/{pending}"), self._path(Run(int(number), int(number), 0, bits).name))

    def compact(self) -> None:
        """Merge the newest runs while the last two are of one tier."""
        while len(self.runs) > 1 and self.runs[-1].tier == self.runs[-2].tier:
            new, old = self.runs.pop(), self.runs.pop()

            def merge(rows: pd.DataFrame) -> pd.DataFrame:
                keys = np.concatenate([unpack_sorted(k) for k in rows["keys"]])
                checks = np.concatenate([np.frombuffer(c, np.uint16) for c in rows["checks"]])
                order = np.lexsort((checks, keys))
                return pd.DataFrame({"owner": rows["owner"].iloc[:1], "n": [len(keys)], "keys": [pack_sorted(keys[order])], "checks": [checks[order].tobytes()]})

            self._write(self.rows(old).unionByName(self.rows(new)).groupBy("owner").applyInPandas(merge, RUN), Run(old.first, new.last, new.tier + 1, self.bits))
            for run in (old, new):
                self._fs.delete(self._path(run.name), True)

    def add(self, asked: DataFrame, stages: Stages, name: str, batch: str | None = None) -> DataFrame:
        """Answers (one bit per asked key: does an earlier block have it?), written; the new keys become a run, or are pending if the batch has a name."""
        self.compact()
        rows = asked
        for run in self.runs:
            rows = rows.unionByName(self.rows(run).select("owner", F.lit(-1).cast("long").alias("block"), F.lit(-1).alias("kind"), "n", "keys", F.col("checks").alias("extra")))

        def merge_join(group: pd.DataFrame) -> pd.DataFrame:
            runs = group[group["block"] < 0]
            asked = group[group["block"] >= 0].sort_values("block")  # in the order of their documents
            columns = ["owner", "block", "kind", "n", "answer", "checks"]
            if not len(asked):
                return pd.DataFrame([], columns=columns)
            sizes = asked["n"].to_numpy()
            key = np.concatenate([unpack_sorted(k) for k in asked["keys"]])
            check = np.concatenate([unpack(x).astype(np.uint16) for x in asked["extra"]])
            order = np.lexsort((check, key))  # stable: equal fingerprints stay in the order of time
            k, c = key[order], check[order]
            repeat_sorted = np.append(False, (k[1:] == k[:-1]) & (c[1:] == c[:-1]))
            for run_keys, run_checks in zip(runs["keys"], runs["extra"], strict=True):
                repeat_sorted |= _known(k, c, unpack_sorted(run_keys), np.frombuffer(run_checks, np.uint16))
            repeat = np.empty(len(order), bool)
            repeat[order] = repeat_sorted
            owner, out, at = asked["owner"].iloc[0], [], 0
            for block, n in zip(asked["block"], sizes, strict=True):
                out.append((owner, block, _WINDOWS, n, np.packbits(repeat[at : at + n]).tobytes(), b""))
                at += n
            fresh = ~repeat_sorted
            out.append((owner, -1, _RUN_ROW, int(fresh.sum()), pack_sorted(k[fresh]), c[fresh].tobytes()))
            return pd.DataFrame(out, columns=columns)

        both = stages.write(rows.groupBy("owner").applyInPandas(merge_join, ANSWER + ", checks binary"), name)
        fresh = both.where(f"kind = {_RUN_ROW} and n > 0").select("owner", "n", F.col("answer").alias("keys"), "checks")
        if batch is None:
            number = self.runs[-1].last + 1 if self.runs else 0
            self._write(fresh, Run(number, number, 0, self.bits))
        else:
            for n in self._list("pending"):  # of an earlier run of this batch
                if n.startswith(f"{self._file(batch)}-bits"):
                    self._fs.delete(self._path(f"pending/{n}"), True)
            fresh.write.parquet(f"{self.folder}/pending/{self._file(batch)}-bits{self.bits}")
        answers = stages.write(both.where(f"kind = {_WINDOWS}").drop("checks"), f"{name}-answers")
        stages.drop(name)
        return answers

    def close(self) -> None:
        """Delete the runs: nothing will be added any more."""
        for run in self.runs:
            self._fs.delete(self._path(run.name), True)


def commit_batch(spark: SparkSession, index: str, batch: str) -> None:
    """Make a batch of ``remove_repeats(docs, index=index, batch=batch)`` part of the index; call it when its output is written."""
    FingerprintIndex(spark, index, 0).commit(batch)


def remove_repeats(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the kept words, joined by a blank).

    A word goes if a window of ``width`` words over it also starts earlier: in a document with a
    smaller id or further up in its own. All windows of all documents are judged as they came in.
    Rows with equal doc_id count as documents one after the other, ordered by text; a NULL doc_id
    sorts first. NULL text has no words; texts shorter than a window lose nothing; an empty
    table gives an empty result; other columns are ignored. A text is never cut: one document lies in one block,
    however long.

    With ``index``, a folder that all executors see, and the name of a ``batch``, the rows are one new batch, later than all that the index has
    seen, whatever their ids. Their new windows are pending until ``commit_batch``, to be called when the output is written: a batch
    whose job was lost before that can run again, and gives the same rows. A batch that was committed before raises ValueError.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "substring")
    closed = index is None
    if closed != (batch is None):
        raise ValueError("an index needs the name of a batch, and a batch an index")
    blocks = text_blocks(docs.select("doc_id", "text", F.lit(True).alias("flag")), stages, order_by=("doc_id", "text"))
    size = blocks.select(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.length(t)))).first()[0] or 0
    runs = FingerprintIndex(spark, index or f"{stages.root}/index", size // 6)
    if batch is not None and runs.committed(batch):
        raise ValueError(f"batch {batch} is in the index already")
    bits = runs.bits
    # batches are ranges of block numbers with about equally many blocks; the edges are a few numbers from a bounded sketch
    edges = blocks.select(F.percentile_approx("block", [i / batches for i in range(1, batches)])).first()[0] if closed and batches > 1 and size else []
    edges = [-1, *sorted({int(e) for e in edges}), 2**62]

    def ask_grams(block: int, _, texts, flags) -> Iterator[tuple]:
        words = Block(texts, width)
        grams = words.grams(gram)
        wanted, (values, n) = np.unique(words.smallest(grams, gram)), np.unique(mix(np.concatenate(grams)), return_counts=True)
        yield from requests(block, _GRAMS, wanted, bits, n[np.searchsorted(values, wanted)])

    grams = stages.write(total_answers(send(blocks, ask_grams)), "grams") if closed else None

    def repeatable(words: Block, found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows that may repeat, in a closed corpus those whose gram is found twice or more: keys, checks, and their places among all windows."""
        keys = words.keys()
        places = np.arange(len(keys))
        if len(keys) and closed:
            _, number = np.unique(words.smallest(words.grams(gram), gram), return_inverse=True)
            places = np.flatnonzero(np.concatenate([unpack(a) for a, _ in found[_GRAMS]])[number] > 1)
        return keys[places], words.checks(places), places

    def ask(block: int, texts, found) -> Iterator[tuple]:
        keys, checks, _ = repeatable(Block(texts, width), found)
        first, _ = _distinct(keys, checks)
        yield from requests(block, _WINDOWS, keys[first], bits, checks[first])

    def ask_found(row, found) -> pd.DataFrame:
        return pd.DataFrame(list(ask(row.block, row.texts, found)), columns=["owner", "block", "kind", "n", "keys", "extra"])

    answers = [grams] if closed else []
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (F.col("block") > low) & (F.col("block") <= high)
        if closed:
            asked = with_answers(blocks.where(inside), grams.where(inside), ask_found, REQUEST)
        else:
            asked = send(blocks, lambda block, _, texts, flags: ask(block, texts, {}))
        answers.append(runs.add(asked, stages, f"batch-{i}", batch))
    if closed:
        runs.close()

    def cut(row, found) -> pd.DataFrame:
        words = Block(row.texts, width)
        keys, checks, places = repeatable(words, found)
        n_windows = words.n_windows
        gone = np.zeros(n_windows.sum(), bool)
        if len(keys):
            first, number = _distinct(keys, checks)
            seen = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=n).astype(bool) for a, n in found[_WINDOWS]])
            gone[places] = seen[number] | (first[number] != np.arange(len(number)))
        out, at = [], 0
        for own, n, m in zip(words.words, words.n_words, n_windows, strict=True):
            edge = np.zeros(n + 1, np.int64)
            edge[:m] += gone[at : at + m]
            edge[width : width + m] -= gone[at : at + m]
            covered = np.cumsum(edge)[:n] > 0
            at += m
            kept = b" ".join([w for w, c in zip(own, covered.tolist(), strict=True) if not c])
            out.append((n, int(covered.sum()), kept.decode(), sha256(kept).hexdigest()))
        result = pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "kept_sha256"])
        result.insert(0, "doc_id", real_ids(row.doc_ids))
        return result

    return with_answers(blocks, reduce(DataFrame.unionByName, answers), cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
