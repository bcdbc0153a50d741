"""Byte-pair encoding in batched numpy merge rounds, and decoding.

The tokenizer file gives the vocabulary, the merges in rank order and the pattern that cuts
a text into words. The symbols of all words of a batch that were not met before lie in one flat array. In
each round every word merges its lowest-ranked pair, everywhere it occurs, all words at
once; ranks are found by binary search over the sorted keys of the merge table. As every
symbol is the product of one merge only, pairs that a merge creates rank behind it, so a
round gives what a queue of single merges gives.
"""

from __future__ import annotations

import hashlib
import json
import string
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgate.llm.common import give_back

END_OF_WORD = "</w>"
#: Words of a batch that are merged together; bounds the memory of the rounds.
WORDS_AT_ONCE = 50_000
#: Encoded words, and runs of non-blank text, that a Python worker keeps for its next texts (about 200 bytes each).
KNOWN_WORDS, KNOWN_RUNS = 200_000, 250_000
#: With this pattern a run of ASCII letters is one word, and so are the signs behind it.
_LETTERS_OR_SIGNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SIGNS = string.punctuation.encode()
_SPACES = regex.compile(r"\s+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
    return [others.get(b, chr(b)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a word-level BPE file with end-of-word symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        if model["end_of_word_suffix"] != END_OF_WORD or model["continuing_subword_prefix"] or spec["decoder"]:
            raise ValueError("not a word-level BPE file with end-of-word symbols")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        signs = byte_symbols()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.final = np.array([vocab[s + END_OF_WORD] for s in signs], np.int64)
        self.size = max(self.tokens) + 1
        self.names = np.array([self.tokens.get(i) for i in range(self.size)], object)
        self.numbers = np.array([b"%d" % i for i in range(self.size)], object)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if len(np.unique(made)) < len(made):
            raise ValueError("two merges make one symbol: rounds would differ from single merges")
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.simple = self.word.pattern == _LETTERS_OR_SIGNS
        # packed ids; a special token stands for itself
        self.words: dict[bytes | int, bytes] = {}
        self.runs: dict[bytes, bytes] = {}

    def rank_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the sorted merge table, -1 where it is none."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (bytes, none of them empty), as packed 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[data[last]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        no_rank = len(self.keys)
        while len(symbols):
            at = self.rank_at(symbols[:-1], symbols[1:])
            rank = np.where((at >= 0) & (owner[:-1] == owner[1:]), self.ranks[at], no_rank)
            rank = np.append(rank, no_rank)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.repeat(best, sizes)
            active = best < no_rank
            if not active.all():  # words without a pair left are finished
                done_symbols.append(symbols[~active])
                done_owner.append(owner[~active])
                symbols, owner, rank, best, at = symbols[active], owner[active], rank[active], best[active], np.append(at, -1)[active]
                if not len(symbols):
                    break
            else:
                at = np.append(at, -1)
            hit = rank == best
            # of overlapping occurrences (a a a) the leftmost counts: every second of a run
            edge = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
            run_start = np.zeros(len(hit), np.int64)
            run_start[edge] = edge
            run_start = np.maximum.accumulate(run_start)
            hit &= (np.arange(len(hit)) - run_start) % 2 == 0
            symbols = np.where(hit, self.made[at], symbols)
            stays = ~np.append(False, hit[:-1])
            symbols, owner = symbols[stays], owner[stays]
        ids = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        owners = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(owners, kind="stable")
        data = ids[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owners, minlength=len(words)))).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def pieces(self, run: bytes) -> list[bytes | int]:
        """The words of a run of text without ASCII blanks; special tokens as their ids."""
        if self.simple:
            word = run.rstrip(_SIGNS)
            if word.isalpha():  # of bytes: ASCII letters only
                return [word.lower(), run[len(word) :]] if len(word) < len(run) else [run.lower()]
        text = run.decode()
        if self.cut is None or "<|" not in text:
            return self._words(text)
        out: list[bytes | int] = []
        at = 0
        for m in self.cut.finditer(text):
            out += self._words(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[bytes]:
        if text.isascii():
            lowered = text.lower()
        else:
            # lower-casing goes by single characters: no rule for a sigma at the end of a word
            lowered = _SPACES.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        return [w.encode() for w in self.word.findall(lowered)]

    def learn(self, runs: set[bytes]) -> dict[bytes, bytes]:
        """Packed ids of distinct runs of non-blank text, at least of these; blanks part words, so runs are independent."""
        todo = runs.difference(self.runs)
        if len(self.runs) + len(todo) > KNOWN_RUNS:
            self.runs = {r: self.runs[r] for r in runs if r in self.runs}
        if len(self.words) > KNOWN_WORDS or not self.words:
            self.words = {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        cut = {r: self.pieces(r) for r in todo}
        new = list(set(chain.from_iterable(cut.values())).difference(self.words))
        for i in range(0, len(new), WORDS_AT_ONCE):
            self.words.update(zip(part := new[i : i + WORDS_AT_ONCE], self.merge(part), strict=True))
        known = self.words.__getitem__
        self.runs.update((r, b"".join(map(known, pieces))) for r, pieces in cut.items())
        return self.runs

    def forget(self) -> None:
        """Drop the known words and runs."""
        self.words, self.runs = {}, {}

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        docs = [(t or "").encode().split() for t in texts]
        known = self.learn(set(chain.from_iterable(docs))).__getitem__
        for d in docs:
            yield np.frombuffer(b"".join(map(known, d)), "<u4")

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Token strings joined by spaces, looked up in the table of names all at once; ids outside the vocabulary are skipped."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            ids = ids[(ids >= 0) & (ids < self.size)]
        names = self.names[ids].tolist()
        return " ".join(names if None not in names else [t for t in names if t is not None])


_loaded: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """The encoder for a file, kept by the Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _digests(bpe: WordBpe, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
    for ids in bpe.encode_all(texts):
        written = b" ".join(bpe.numbers[ids].tolist())
        yield len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()


#: Characters of text taken together, so that a batch of long documents needs no more memory.
CHARS_AT_ONCE = 4_000_000
#: The same where ids leave the task: a slice is a batch of its own on the way out.
CHARS_SENT = 1_000_000


def slices(texts: list[str | None], limit: int = CHARS_AT_ONCE) -> Iterator[list[str | None]]:
    """The list cut so that each part but a single long text stays under the limit."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        if part and size + len(t or "") > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def encode_texts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>): the ids of the whole text. NULL text counts as
    empty, empty text has no ids; a column ``ids`` that is there is replaced, all others stay as they are. Nothing
    is shuffled; repeated rows stay; an empty table stays empty; a text is never cut, however long. Ids go out slice by slice, and a
    worker keeps no words behind its task: later stages share the executor's memory with it."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(path)
        try:
            for batch in texts:
                for part in slices(batch.tolist(), CHARS_SENT):
                    yield pd.Series([ids.astype(np.int32) for ids in bpe.encode_all(part)], dtype=object)
        finally:
            bpe.forget()
            give_back()

    return docs.withColumn("ids", ids(F.col(text_col)))


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with a column ``decoded``: the token strings joined by spaces (NULL ids count as none)."""

    @F.pandas_udf("string")
    def decoded(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(path)
        for batch in ids:
            yield pd.Series([bpe.decode([] if x is None else list(x)) for x in batch])

    return df.withColumn("decoded", decoded(F.col(ids_col)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row n_tokens and the SHA-256 of its ids and of the text decoded from them.

    Ids are made once per distinct word that a worker meets and put together per document; these
    are decoded, and arrays of ids never leave the task. NULL and empty text have no ids and decode to
    nothing; repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result. A text
    is never cut, and a slice holds one very long text alone.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for batch in texts:
            rows = [r for part in slices(batch.tolist()) for r in _digests(bpe, part)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
