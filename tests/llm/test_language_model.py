import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fitgate.llm import language_model
from fitgate.llm.blocks import pack_texts, unpack_texts
from fitgate.llm.queries import op2_lm_scoring
from tests.llm import brute


def brute_model(rows):
    """Counts, base scores and the model given its weights, with dictionaries."""
    docs = [(d, brute.words(brute.lower(t)) + [None]) for d, t in rows]
    train = [w for d, w in docs if zlib.crc32(str(d).encode()) % 10 != 0]
    word = Counter(x for w in train for x in w)
    pair = Counter(p for w in train for p in zip(["<s>", *w[:-1]], w, strict=True))
    return docs, word, pair, len(train)


def test_against_dictionaries(spark, sf, monkeypatch):
    fitted = {}
    real = language_model.fit_weights
    monkeypatch.setattr(language_model, "fit_weights", lambda *a: fitted.setdefault("w", real(*a)))
    monkeypatch.setattr(language_model, "owners_for", lambda n: 3)
    monkeypatch.setattr("fitgate.llm.blocks.BLOCK_CHARS", 50_000)
    got = {r.doc_id: r for r in op2_lm_scoring(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs, word, pair, starts = brute_model(rows)
    total, types, weights = sum(word.values()), len(word), fitted["w"]
    assert len(got) == len(rows)
    assert np.allclose(weights.sum(axis=1), 1)
    better = [0, 0]
    for d, w in docs:
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(word[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((word[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w), abs=1e-6)
        want = 0
        for v, x in zip(["<s>", *w[:-1]], w, strict=True):
            c = starts if v == "<s>" else word[v]
            a = weights[c.bit_length()]
            want += math.log10(a[0] * (pair[v, x] / c if c else 0) + a[1] * word[x] / total + a[2] / (types + 1))
        assert r.score == pytest.approx(want, abs=1e-6)
        if r.held_out:
            better[0] += r.score
            better[1] += r.base_score
    assert better[0] > better[1]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, None, 0.5), (2, "", 1.0), (None, "a b", 2.0), (3, "a b", 2.0)], "doc_id long, text string, score double")
    out = language_model.score_documents(docs, language_model.F.lit(True)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == [("1", 1), ("1", 1), ("2", 1), ("3", 3), ("None", 3)]
    assert all(r.score <= 0 and math.isfinite(r.score) for r in out)
    assert language_model.score_documents(docs.limit(0), language_model.F.lit(True)).count() == 0
    nothing = language_model.score_documents(docs, language_model.F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in nothing)


def test_texts_of_a_block_are_one_small_value(spark, sf, monkeypatch):
    """A block is one row of a shuffle: its texts pass through executors compressed."""
    made = []
    real = language_model.text_blocks
    monkeypatch.setattr(language_model, "text_blocks", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    got = op2_lm_scoring(spark, sf)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    blocks = made[0].collect()
    plain = sum(len(t.encode()) for t in texts.values())
    sent = sum(len(r.texts) if isinstance(r.texts, bytes | bytearray) else sum(len(t.encode()) for t in r.texts) for r in blocks)
    assert got.count() == len(texts)
    assert sent < 0.6 * plain
    assert {d: t for r in blocks for d, t in zip(r.doc_ids, unpack_texts(bytes(r.texts)), strict=True)} == texts


@pytest.mark.parametrize("texts", [[""], ["", "a\nb", "", "\u00f1\u20ac\U0001f600"], ["x" * 100_000] * 3])
def test_packed_texts_come_back(texts):
    assert unpack_texts(pack_texts(texts)) == texts
