"""Blocks of documents that ask for facts about their keys.

Several operators must know, for each of very many keys (words, word pairs, windows), something
that depends on all documents: a total, or whether an earlier document has it. One row per key
occurrence would be many times the input. Instead, documents are written as blocks of a few
million characters; a block sends its *distinct* keys, sorted and packed, to the partitions
that own the key ranges, and gets one packed answer per range back. Both directions are plain
shuffles (``groupBy(owner)`` and ``cogroup(block)``): a key that occurs in every document
arrives once per block, so no group grows with the frequency of a key, and the number of
owners grows with the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgate.llm.common import Stages, give_back

BLOCK_CHARS = 4_000_000
#: Keys that one owner should have to sort, counted with repeats in different blocks.
KEYS_PER_OWNER = 2_000_000

#: Stands for a NULL doc_id inside blocks, where lists of plain 64-bit integers are wanted.
NULL_ID = -(2**63)

#: For tables of blocks and of answers: a task that writes or reads them holds a row group at once.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20)}

REQUEST = "owner long, block long, kind int, n long, keys binary, extra binary"
ANSWER = "owner long, block long, kind int, n long, answer binary"


def pack_texts(texts: list[str]) -> bytes:
    """Texts as one compressed value: executors hold several copies of a block's row, in buffers that double as they grow."""
    docs = [t.encode() for t in texts]
    data = pack(np.array([len(docs), *map(len, docs)], np.uint64)) + b"".join(docs)
    return len(data).to_bytes(8, "little") + len(docs).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack_texts(data: bytes) -> list[str]:
    size, n = (int.from_bytes(data[i : i + 8], "little") for i in (0, 8))
    plain = memoryview(pa.decompress(memoryview(data)[16:], decompressed_size=size, codec="zstd", asbytes=True))
    ends = 8 * (n + 1) + np.cumsum(unpack(plain[: 8 * (n + 1)])[1:], dtype=np.int64)
    return [str(plain[a:b], "utf-8") for a, b in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)] if n else []


def _readable(row):
    """A row of blocks with its texts as strings."""
    return row._replace(texts=unpack_texts(row.texts)) if isinstance(getattr(row, "texts", None), bytes) else row


def text_blocks(docs: DataFrame, stages: Stages, order_by: tuple[str, ...] = (), chars: int | None = None, packed: bool = False) -> DataFrame:
    """Written rows (block, doc_ids, texts, flags) of a few million characters, from docs(doc_id, text, flag).

    With ``order_by``, documents lie in that order in the blocks and blocks in ascending order
    of their numbers; else each task cuts what it reads. A document is never cut. With ``packed``,
    the texts are one value (``send`` and ``with_answers`` read it), and n_chars is one more column.
    """
    limit = chars or BLOCK_CHARS

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        size = 0

        def block() -> pd.DataFrame:
            ids, texts, flags = zip(*rows, strict=True)
            row = {"block": [number], "doc_ids": [list(ids)], "texts": [pack_texts(texts) if packed else list(texts)], "flags": [list(flags)]}
            return pd.DataFrame(row | ({"n_chars": [size]} if packed else {}))

        for batch in batches:
            for row in zip(batch["doc_id"], batch["text"], batch["flag"], strict=True):
                if rows and size + len(row[1]) > limit:
                    yield block()
                    rows, size, number = [], 0, number + 1
                rows.append(row)
                size += len(row[1])
        if rows:
            yield block()
        if packed:
            rows.clear()
            give_back()

    # NULL ids would turn a column of integers into floats in pandas
    docs = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "flag", *[c for c in order_by if c not in ("doc_id", "text")])
    if order_by:
        # ranges come from a sample that the driver sees: short keys only
        docs = docs.repartitionByRange(*[c for c in order_by if c != "text"]).sortWithinPartitions(*order_by)
    if packed:
        return stages.write(docs.mapInPandas(cut, "block long, doc_ids array<long>, texts binary, flags array<boolean>, n_chars long"), "blocks", **SMALL_GROUPS)
    return stages.write(docs.mapInPandas(cut, "block long, doc_ids array<long>, texts array<string>, flags array<boolean>"), "blocks")


def real_ids(doc_ids) -> pd.array:
    """doc_ids of a block with NULL where it belongs."""
    ids = np.asarray(doc_ids, np.int64)
    return pd.arrays.IntegerArray(ids.copy(), ids == NULL_ID)


def pack(values: np.ndarray) -> bytes:
    """Integers of 64 bits by byte planes, so that the codecs of shuffles and files see the runs of zeros."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def owners_for(keys: int) -> int:
    """Bits of the owner's number: enough owners that each has a bounded number of keys to sort."""
    return max(2, int(np.ceil(np.log2(max(1, keys) / KEYS_PER_OWNER))) + 1) if keys else 2


def requests(block: int, kind: int, keys: np.ndarray, bits: int, extra: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of REQUEST: the sorted distinct keys of a block, cut by owner (the leading bits of the key)."""
    edges = np.searchsorted(keys, np.arange(1, 2**bits, dtype=np.uint64) << np.uint64(64 - bits))
    for owner, (a, b) in enumerate(zip([0, *edges], [*edges, len(keys)], strict=True)):
        if a < b:
            yield owner, block, kind, int(b - a), pack_sorted(keys[a:b]), b"" if extra is None else pack(extra[a:b])


def send(blocks: DataFrame, make: Callable[[int, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]]) -> DataFrame:
    """Rows of REQUEST that ``make(block, doc_ids, texts, flags)`` yields for every block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in REQUEST.split(", ")]
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame(list(make(row.block, row.doc_ids, _readable(row).texts, row.flags)), columns=columns)
        give_back()

    # a block is one large row: few of them may wait in memory together
    return blocks.mapInPandas(run, REQUEST)


def total_answers(asked: DataFrame) -> DataFrame:
    """Rows of ANSWER: for every key the sum of ``extra`` over all blocks. One more row per owner and kind,
    with block -1, has the number of keys with a positive sum as n."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, rows in group.groupby("kind"):
            keys = np.concatenate([unpack_sorted(k) for k in rows["keys"]])
            extra = np.concatenate([unpack(x) for x in rows["extra"]]).astype(np.int64)
            distinct, at = np.unique(keys, return_inverse=True)
            totals = np.zeros(len(distinct), np.int64)
            np.add.at(totals, at, extra)
            owner, end = rows["owner"].iloc[0], np.cumsum(rows["n"].to_numpy())
            for block, n, e in zip(rows["block"], rows["n"], end, strict=True):
                out.append((owner, block, kind, n, pack(totals[at[e - n : e]])))
            out.append((owner, -1, kind, int(np.count_nonzero(totals)), b""))
            del keys, extra, distinct, at, totals
        give_back()  # this Python worker stays beside the shuffles that follow
        return pd.DataFrame(out, columns=["owner", "block", "kind", "n", "answer"])

    return asked.groupBy("owner").applyInPandas(add, ANSWER)


def with_answers(blocks: DataFrame, answers: DataFrame, use: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """``use(row of blocks, {kind: [(packed answer, number of keys), ...] in key order})`` for every block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("owner")
        found = {kind: list(zip(rows["answer"], rows["n"], strict=True)) for kind, rows in right.groupby("kind")}
        out = pd.concat([use(_readable(row), found) for row in left.itertuples(index=False)])
        give_back()
        return out

    return blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInPandas(run, schema)
