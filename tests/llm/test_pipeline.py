"""The whole pipeline against brute force on the smallest tables."""

import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from fitgate.llm import quality
from tests.llm import brute
from tests.llm.test_pairs import brute_components, brute_leaks


def rejected(text):
    n, chars, symbols, dup, repeat = brute.quality(text)
    lines = sum(bool(brute.words(x)) for x in (text or "").split("\n"))
    w = brute.words(text)
    stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
    letters = [c for c in text or "" if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    return (
        n < 20 or 100 * repeat > 30 * n or 100 * symbols > 10 * n or chars > 15 * n or chars < 2 * n
        or (dup >= 3 and 100 * dup > 30 * lines) or 100 * stutter > 30 * n or 2 * upper > len(letters) or 2 * len(letters) < chars
    )


def test_pipeline(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {d: t for d, t in rows.items() if not rejected(t)}
    heads = {c for _, _, c in brute_components(list(rows.items()), 5, 80)}
    rows = {d: t for d, t in rows.items() if d in heads}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [brute.words(t.lower())] for i in range(len(w) - 4)}
    known = set().union(*(grams(t) for _, t in items))
    leaking = {d for d, _ in brute_leaks([(d, t) for d, t in rows.items() if grams(t) & known], items)}
    rows = {d: t for d, t in rows.items() if d not in leaking}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(rows)
    masks = 0
    for d, text in rows.items():
        spans = brute.base_pii(text)
        if not spans and not re.search("[A-Za-z0-9]{32}|[A-Z]{2}[0-9]{2}|[0-9]{3}", text):
            assert list(got[d].ids) == lib.encode(text, add_special_tokens=False).ids
        else:
            masks += 1
            for kind, a, b in spans:
                assert text[a:b] not in lib.decode(list(got[d].ids))
        assert got[d].n_tokens == len(got[d].ids)
    assert masks and quality.CURRENT_POLICY in quality.POLICIES
