"""Token ids in files: canonical length-limited Huffman codes, table-driven block decoding.

1. Every text is encoded with the tokenizers library, and an end id is appended. A slice of texts is cut into
   runs of non-blank text, and its distinct runs into words and the signs behind them, as Arrow arrays; the library
   sees each word that a Python worker meets once. The ids are written as 16- or 32-bit integers.
2. Global counts of ids (one row per id) give code lengths of at most ``MAX_BITS`` bits by the
   package-merge method, and canonical codes: by length, then by id. The code book is one
   number per id, so it is small whatever the corpus.
3. Documents are sorted by doc_id over range partitions and cut into blocks. A block has
   its documents' ids and lengths, the coded bits, and the bit offset of every
   ``CHECKPOINT``-th token. Blocks do not depend on each other, and within a block all
   stretches between checkpoints are decoded side by side: one table look-up per token.

The files are Parquet files of such blocks, in ascending doc_id order from file to file, plus
the code book as a table of its own, so Spark writes and reads them on any store it knows.
"""

from __future__ import annotations

import json
import string
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgate.llm.blocks import NULL_ID, real_ids
from fitgate.llm.bpe import byte_symbols
from fitgate.llm.common import Stages

#: The least limit of a code's length; vocabularies of more ids than it allows get a longer one.
MAX_BITS = 20
CHECKPOINT = 128
BLOCK_TOKENS = 1 << 17
#: Bytes of text taken together: the more, the fewer of its words are looked up again; bounds the memory of a slice.
BYTES_AT_ONCE = 16_000_000
#: Ids that are counted together; bounds the memory of wider copies.
IDS_AT_ONCE = 1 << 20
#: Encoded words, and runs of non-blank text that are more than a word and signs, in each of the two generations that a Python worker keeps (about 200 bytes each).
KNOWN_RUNS = 800_000

BLOCK = "part int, block int, first_token long, doc_ids array<long>, lengths array<int>, n_tokens int, payload binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (0 for a count of 0), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 2**limit:
        raise ValueError("more ids than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    levels = []
    level, is_leaf = leaves, np.ones(len(leaves), bool)
    for _ in range(limit):
        levels.append(is_leaf)
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, packages])
        order = np.argsort(merged, kind="stable")
        level, is_leaf = merged[order], order < len(leaves)
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes of the given lengths: shorter first, then by id, each one more than the last."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order]
        top = size.max()
        steps = np.left_shift(np.uint64(1), (top - size).astype(np.uint64))
        first = np.cumsum(steps) - steps
        codes[order] = first >> (top - size).astype(np.uint64)
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        # codes from the highest bit on
        self.codes = canonical_codes(self.lengths) << np.where(self.lengths > 0, 64 - self.lengths, 0).astype(np.uint64)
        self.width = max(1, int(self.lengths.max(initial=0)))
        # all values of the next ``width`` bits that begin with a code lead to its id and length
        order = np.lexsort((np.arange(len(lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        spans = np.left_shift(1, self.width - self.lengths[order])
        filled = np.repeat(order << 6 | self.lengths[order], spans)
        self.table = np.zeros(1 << self.width, np.int32 if len(lengths) < 1 << 25 else np.int64)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bits, and the offsets of every CHECKPOINT-th id as 64-bit integers."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        starts = ends - size
        words = np.zeros(int(ends[-1]) // 64 + 2 if len(ids) else 1, np.uint64)
        if len(ids):
            at, bit, code = starts >> 6, (starts & 63).astype(np.uint64), self.codes[ids]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            words[at[first]] = np.bitwise_or.reduceat(code >> bit, first)
            over = np.flatnonzero((ends - 1) >> 6 != at)  # at most one code runs over the end of a word
            words[at[over] + 1] |= code[over] << (np.uint64(64) - bit[over])
        return words.astype(">u8").tobytes(), starts[::CHECKPOINT].astype("<u8").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The ids of a block: all stretches between checkpoints advance together, one id at a time."""
        # the last stretch may be shorter than the others and runs on into zeros
        words = np.append(np.frombuffer(payload, ">u8").astype(np.uint64), np.zeros(CHECKPOINT * self.width // 64 + 2, np.uint64))
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        out = np.zeros((CHECKPOINT, len(at)), np.int32)
        shift = np.uint64(64 - self.width)
        for i in range(min(CHECKPOINT, n)):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            # a shift by 64 is not defined: two shifts
            peek = (words[word] << bit) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - bit))
            found = self.table[(peek >> shift).astype(np.int64)]
            out[i] = found >> 6
            at += found & 63
        return out.T.reshape(-1)[:n]


#: Signs behind a word that are cut off it, so that fewer distinct runs have to be encoded.
_TAIL = string.punctuation
_TAIL_BYTES = _TAIL.encode()
#: Letters up to here are letters in every version of Unicode that a library may know.
_LAST_LETTER = "\ua000"
#: Up to here NFC changes nothing, and lower case is one letter for one.
_LAST_SIMPLE = "\u0100"
_SIMPLE = "".join(c for c in map(chr, range(ord(_LAST_SIMPLE))) if c.isalpha())
_SIMPLE_WORD = f"^[{_SIMPLE}]+$"


class _Runs(dict):
    """Ids of runs of non-blank text; a run that is not there is taken from the generation before, or encoded."""

    def __init__(self, encode: Callable[[bytes], bytes], before: dict[bytes, bytes]):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, run: bytes) -> bytes:
        ids = self.before.get(run)
        if ids is None:
            ids = self.encode(run)
        self[run] = ids
        return ids


class Library:
    """The tokenizers library over distinct runs of non-blank text; blanks separate words, so they are independent.

    A run is cut where the tokenizer's own pattern cuts, and its pieces are looked up: far fewer
    pieces are distinct than runs. New words of letters go in lower case (beyond Latin-1 through the library's normalizer) and
    in the byte symbols of its vocabulary to its model; all else goes through the whole library.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.piece = regex.compile(json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = dict(enumerate(byte_symbols()))
        self.normalize, self.tokenize = self.tokenizer.normalizer.normalize_str, self.tokenizer.model.tokenize
        self.last_id = max(self.tokenizer.get_vocab().values())
        self.runs = _Runs(self._run, {})

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, word: str) -> str:
        """A word of letters as it is normalised; empty if that is not all letters, or not in every version of Unicode."""
        last = max(word)
        if last < _LAST_SIMPLE:
            return word.lower()
        plain = self.normalize(word) if last < _LAST_LETTER else ""
        return plain if plain.isalpha() and max(plain) < _LAST_LETTER else ""

    def _symbols(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(word)]).tobytes()

    def _run(self, run: bytes) -> bytes:
        """Ids of a run; its parts are runs too."""
        if run.isalpha() and run.islower():  # of bytes: ASCII letters only
            return self._symbols(run.decode())
        body = run.rstrip(_TAIL_BYTES)
        if body.isalpha():
            word = body.lower()
            if len(body) < len(run):
                return self.runs[word] + self.runs[run[len(body) :]]
            return self.runs[word]
        text = run.decode()
        if run.isascii():
            if text.isprintable() and "<|" not in text:
                pieces = self.piece.findall(text.lower())
                if len(pieces) > 1:
                    return b"".join([self.runs[p.encode()] for p in pieces])
        else:
            word = text[: len(text) - len(run) + len(body)]
            if len(body) < len(run):
                if word.isalpha() and (max(word) < _LAST_SIMPLE or self._plain(word)):
                    return self.runs[body] + self.runs[run[len(body) :]]
            elif word.isalpha() and (plain := self._plain(word)):
                return self._symbols(plain.encode().decode("latin-1").translate(self.symbols))
        return self._whole(text)

    def _parts(self, runs: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The distinct parts of runs, and where the two parts of each run stand among them.

        A word of Latin-1 letters, in lower case, is parted from the signs behind it; any other run is one part. The last part is
        empty: a run without signs, or of one part, has it second.
        """
        body = pc.ascii_rtrim(runs, characters=_TAIL)
        simple = pc.match_substring_regex(body, pattern=_SIMPLE_WORD)
        signs = pc.utf8_ltrim(pc.if_else(simple, runs, ""), characters=_SIMPLE)
        parts = pa.concat_arrays([pc.if_else(simple, pc.utf8_lower(body), runs), signs, pa.array([""], runs.type)]).dictionary_encode()
        places = parts.indices.to_numpy()
        return parts.dictionary, np.stack([places[: len(runs)], places[len(runs) : -1]], axis=1)

    def encode_all(self, texts: pa.Array, end: int) -> tuple[np.ndarray, pa.Array]:
        """How many ids each text has with the end id, and its ids as little-endian integers of 16 bits, or of 32 if the vocabulary needs them."""
        if len(self.runs) > KNOWN_RUNS:
            self.runs.before = {}
            self.runs = _Runs(self._run, self.runs)
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        runs = split.flatten().dictionary_encode()
        parts, places = self._parts(runs.dictionary)
        ids = [*map(self.runs.__getitem__, parts.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), struct.pack("<I", end)]
        kind = np.dtype("<u2" if max(self.last_id, end) < 1 << 16 else "<u4")
        table = _binary(np.frombuffer(b"".join(ids), "<u4").astype(kind), np.cumsum([0, *map(len, ids)]) // 4 * kind.itemsize)
        # the distinct runs, and behind them the end id as one more
        joined, ends = _taken(table, np.append(places, len(parts)))
        table = _binary(joined, np.append(ends[::2], ends[-1]))
        bounds = split.offsets.to_numpy()
        data, ends = _taken(table, np.insert(runs.indices.to_numpy(), bounds[1:], len(runs.dictionary)))
        ends = ends[bounds + np.arange(len(bounds))]
        return np.diff(ends) // kind.itemsize, _binary(data, ends).cast(pa.binary())

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Ids of each text and the end id, as little-endian 32-bit integers."""
        counts, ids = self.encode_all(pa.array(texts, pa.string()), end)
        return [_unpacked(data, n).astype("<u4").tobytes() for n, data in zip(counts, ids.to_pylist(), strict=True)]


def _binary(data: np.ndarray | pa.Buffer, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one behind the other in ``data``."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])


def _taken(values: pa.Array, places: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The values at ``places`` one behind the other, and where they begin and end."""
    taken = values.take(pa.array(places))
    return taken.buffers()[2], np.frombuffer(taken.buffers()[1], np.int64, len(places) + 1)


def _unpacked(data: bytes | pa.Buffer, n: int) -> np.ndarray:
    """The ``n`` ids, at least one, that are packed in ``data``."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


_loaded: dict[str, Library] = {}


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, n, ids): packed ids of the whole text, the end id included; 16 bits each, or 32 if the vocabulary needs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = Library(path)
        for batch in batches:
            # slices of about as much text, so that a batch of long documents needs no more memory
            size = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(size // BYTES_AT_ONCE)) + 1).tolist(), len(size)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if b > a:
                    n, ids = _loaded[path].encode_all(part.column("text"), end)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int32()), ids], ["doc_id", "n", "ids"])

    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text").mapInArrow(run, "doc_id long, n int, ids binary")


def id_counts(rows: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs; counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(0, np.int64)
        for batch in batches:
            # all ids of a table have the same number of bits
            ids = _unpacked(b"".join(batch.column("ids").to_pylist()), pc.sum(batch.column("n")).as_py() or 0)
            for i in range(0, len(ids), IDS_AT_ONCE):
                more = np.bincount(ids[i : i + IDS_AT_ONCE], minlength=len(totals))
                more[: len(totals)] += totals
                totals = more
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(totals[found], pa.int64())], ["id", "n"])

    return rows.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(docs: DataFrame, path: str, end: int, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """Write the files; returns (blocks, code book) as read back from them."""
    spark = docs.sparkSession
    rows = stages.write(encoded(docs, path, end), "ids")
    counts = id_counts(rows).toPandas()
    totals = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    totals[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    lengths = code_lengths(totals, max(MAX_BITS, int(np.count_nonzero(totals)).bit_length() + 3))
    used = np.flatnonzero(lengths)
    book = stages.write(spark.createDataFrame(pd.DataFrame({"id": used, "bits": lengths[used]}), "id long, bits int").coalesce(1), "book")
    shared = spark.sparkContext.broadcast(lengths)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), Coder(shared.value)
        ids, parts, number, first, size = [], [], 0, 0, 0

        def block() -> pd.DataFrame:
            payload, checkpoints = coder.encode(np.concatenate(parts))
            return pd.DataFrame({
                "part": [part], "block": [number], "first_token": [first], "doc_ids": [ids], "lengths": [[len(p) for p in parts]],
                "n_tokens": [size], "payload": [payload], "checkpoints": [checkpoints],
            })

        for batch in batches:
            for doc_id, n, data in zip(batch["doc_id"], batch["n"], batch["ids"], strict=True):
                ids.append(doc_id)
                parts.append(_unpacked(data, n))
                size += len(parts[-1])
                if size >= BLOCK_TOKENS:
                    yield block()
                    ids, parts, number, first, size = [], [], number + 1, first + size, 0
        if parts:
            yield block()

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n", "ids")
    blocks = stages.write(ordered.mapInPandas(cut, BLOCK), "blocks")
    stages.drop("ids")
    return blocks, book


def read_files(blocks: DataFrame, book: DataFrame) -> DataFrame:
    """(part, doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before; ids as packed 32-bit integers."""
    spark = blocks.sparkSession
    codes = book.toPandas()
    lengths = np.zeros(int(codes["id"].max()) + 1 if len(codes) else 1, np.int64)
    lengths[codes["id"].to_numpy(np.int64)] = codes["bits"].to_numpy(np.int64)
    # one total per file: as many numbers as the writing stage had tasks
    totals = blocks.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n")).orderBy("part").collect()
    before, base = 0, {}
    for r in totals:
        base[r.part] = before
        before += r.n
    shared = spark.sparkContext.broadcast((lengths, base))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths, base = shared.value
        coder = Coder(lengths)
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = coder.decode(row.payload, row.checkpoints, row.n_tokens).astype("<u4")
                n = np.asarray(row.lengths, np.int64)
                ends = np.cumsum(n)
                yield pd.DataFrame({
                    "doc_id": real_ids(row.doc_ids), "start": base[row.part] + row.first_token + ends - n, "n_tokens": n,
                    "ids": [ids[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)],
                })

    return blocks.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str, end: int) -> DataFrame:
    """What the files of ``docs`` give back, one row per input row: doc_id, start, n_tokens, ids_crc32.

    NULL text counts as empty and has the end id only. Rows with equal ids follow each other
    ordered by length; a NULL doc_id sorts first; other columns are ignored; an empty table gives
    empty files. A text is never cut: one document lies in one block, however long.
    """
    blocks, book = write_files(docs, path, end, Stages(docs.sparkSession, "huffman"))
    return read_files(blocks, book).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
