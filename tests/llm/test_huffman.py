import heapq
import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fitgate.llm import huffman

PATH = public_tokenizers.path("word_bpe_49k.json")


def free_cost(counts):
    """Bits of an unlimited Huffman code, by the textbook queue."""
    tick = itertools.count()
    heap = [(c, next(tick)) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
        cost += a + b
        heapq.heappush(heap, (a + b, next(tick)))
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=2, max_size=80), st.integers(7, 12))
def test_code_lengths(counts, limit):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, limit)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max(initial=0) <= limit
    if (counts > 0).sum() > 1:
        assert sum(2.0 ** -lengths[lengths > 0]) == 1
        cost = int((lengths * counts).sum())
        assert cost >= free_cost(counts.tolist())
        if huffman.code_lengths(counts, 40).max() <= limit:
            assert cost == free_cost(counts.tolist())


def test_limited_lengths_are_optimal():
    # the best of all complete codes of at most three bits for five ids
    counts = np.array([1, 2, 4, 8, 100])
    best = min(sum(l * c for l, c in zip(p, counts, strict=True)) for p in itertools.product(range(1, 4), repeat=5) if sum(2.0**-l for l in p) <= 1)  # noqa: E741
    assert int((huffman.code_lengths(counts, 3) * counts).sum()) == best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=700), st.randoms())
def test_block_round_trip(ids, rng):
    counts = np.array([rng.randrange(1, 10 ** rng.randrange(1, 7)) for _ in range(301)])
    coder = huffman.Coder(huffman.code_lengths(counts, 12))
    payload, checkpoints = coder.encode(np.array(ids, np.int64))
    assert coder.decode(payload, checkpoints, len(ids)).tolist() == ids


def test_files(spark, sf, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_TOKENS", 5000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(5000, None), (5001, ""), (5002, "<|endoftext|> it's É"), (5002, "x"), (None, "no id")], "doc_id long, text string")
    docs = docs.unionByName(odd).repartition(7)
    rows = sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, len(r.text or "")))
    lib = Tokenizer.from_file(PATH)
    start, want = 0, []
    for r in rows:
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = huffman.round_trip(docs, PATH, 2).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert huffman.round_trip(docs.limit(0), PATH, 2).count() == 0


def test_too_many_ids():
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


_ALPHABET = ["a", "B", "é", "É", "ß", "İ", "σ", "Σ", "中", "ا", "1", "2", ".", ",", "'s", "'", "n't", "<|", "|>", "<|endoftext|>", "&&&", "-", "_", "$", " ", "\n", "\t", "\x1c", "\x7f", " ", "́", "é", "½", "\U0001f600", "ꙋ", "ꧠ"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_ALPHABET), max_size=14).map("".join), max_size=4))
def test_pieces_are_the_librarys(texts):
    if "library" not in _kept:
        _kept["library"], _kept["plain"] = huffman.Library(PATH), Tokenizer.from_file(PATH)
    got = [np.frombuffer(x, "<u4").tolist() for x in _kept["library"].encode(texts, 2)]
    assert got == [[*_kept["plain"].encode(t, add_special_tokens=False).ids, 2] for t in texts]


_kept: dict = {}


def test_a_word_of_every_batch_is_encoded_once(monkeypatch):
    """Words that come again outlive those that do not."""
    monkeypatch.setattr(huffman, "KNOWN_RUNS", 5)
    monkeypatch.setattr(huffman, "KNOWN_WORDS", 5, raising=False)
    library, plain, asked = huffman.Library(PATH), Tokenizer.from_file(PATH), []
    tokenize = library.tokenize
    library.tokenize = lambda word: asked.append(word) or tokenize(word)
    for k in "abcdefgh":
        text = " ".join(["Always", "always,", *(k + x for x in "opqrstu"), "ÀLWAYS!"])
        assert np.frombuffer(library.encode([text], 2)[0], "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
    assert asked.count("always") == 1 and len(library.runs) + len(library.runs.before) < 60


def test_letters_are_the_librarys():
    text = " ".join(w for c in map(chr, range(65, 0x300)) if c.isalpha() for w in (c, f"a{c}", f"{c}.", f"{c}B'", f"{c}́{c}.", f"1{c}'S"))
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(huffman.Library(PATH).encode([text], 2)[0], "<u4").tolist() == [*want, 2]


def test_a_written_form_is_not_kept():
    """Of a word in all its written forms one entry is kept, and the library is asked for it once."""
    library, plain, asked = huffman.Library(PATH), Tokenizer.from_file(PATH), []
    tokenize = library.tokenize
    library.tokenize = lambda word: asked.append(word) or tokenize(word)
    texts = ["Always always, ALWAYS!?  always. (always)", None, "\n", "École école, ÉCOLE!? \x0bécole.", "ÀÉ;"]
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in library.encode(texts, 2)] == want
    assert {r.decode() for r in library.runs} == {"always", "école", "àé", "(always)", "(", ")", ",", ".", "!?", ";", ""} and asked.count("always") == 1
    counts, ids = library.encode_all(pa.array(["cut off", *texts, None]).slice(1, len(texts)), 2)
    assert [np.frombuffer(x, "<u2").tolist() for x in ids.to_pylist()] == want and counts.tolist() == list(map(len, want))


def test_ids_of_more_than_16_bits(spark):
    texts, end = ["one two.", None, "<|endoftext|> X\x00Y"], 70000
    want = [[*Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids, end] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = huffman.round_trip(docs, PATH, end).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]
