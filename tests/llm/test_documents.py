"""Operators that look at one document at a time, against brute force."""

import os
import time

import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

from fitgate.llm import bpe, pii, quality, queries
from tests.llm import brute

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a b c d e f g h a b c d e f g h tail"), (5, "x " * 50), (6, "one\ntwo\none\n \n \none"),
    (7, "É" * 30 + " naïve # * $ | < > & %" + " " + "y"), (7, "repeated id"), (None, "no id"),
    (8, "mail a.b@c.d_e@f.g.h x@y @z.q a@b.c@d.e"), (9, "1.2.3.4.5.6.7.8 256.1.1.1 000.01.1.1 +1 (058) 555-3468 +1+2 345 678 90123"),
    (10, "4111 1111 1111 1111 and 4111-1111-1111-1112 5927243074273351 1" + " 1" * 40), (11, "a" * 20000 + "@" + "9" * 20000),
    (12, "account GB82 WEST 1234 5698 7654 32, IBAN DE89370400440532013000 call 555-123-4567 😀 😀 z@y.xx"),
    (13, "<|endoftext|> it's İSTANBUL ΣΑΣ é don't<|startoftext|>x 12 345 \x0b\x0c q r \x1c s\x85t ﬁ"),
]


def frame(spark):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in ODD], "doc_id long, text string, n_words string, spans int").repartition(3)


def test_ledger_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(frame(spark).select("doc_id", "text"))
    got = sorted(map(tuple, quality.ledger(docs).select("doc_id", *quality.MEASURES[:5]).collect()), key=str)
    assert got == sorted(((r.doc_id, *brute.quality(r.text)) for r in docs.collect()), key=str)


def test_policies_and_ablations(spark):
    book = quality.ledger(frame(spark)).cache()
    assert quality.apply_policy(book, 1).where("kept and (failed & 3) != 0").count() == 0
    rows = {r.rule: r for r in quality.ablations(book).collect()}
    failed = [r.failed & quality.POLICIES[quality.CURRENT_POLICY] for r in book.collect()]
    for rule in quality.RULES:
        if rule.name in rows:
            bit = 1 << rule.bit
            assert rows[rule.name].n_failed == sum(bool(f & bit) for f in failed)
            assert rows[rule.name].n_only == sum(f == bit for f in failed)
            assert rows[rule.name].n_kept_without == sum(f & ~bit == 0 for f in failed)
    assert quality.ledger(frame(spark).limit(0)).count() == 0
    stored = quality.stored_ledger(frame(spark))
    assert sorted(map(str, stored.collect())) == sorted(map(str, book.select(*stored.columns).collect()))
    kept = quality.keep_good(frame(spark), 1)
    assert kept.columns == ["doc_id", "text", "n_words", "spans"]


def test_pii_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(frame(spark).select("doc_id", "text"))
    got = pii.find_pii(docs).select("doc_id", "text", pii.joined(pii.base_only(pii.F.col("spans"))).alias("s")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.s == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_pii(r.text)), r.text[:200]


def test_pii_added_kinds_and_masking(spark):
    text = ODD[13][1]
    spans = pii.find_pii(frame(spark).where("doc_id = 12")).first().spans
    assert [(s.kind, text[s.start : s.end]) for s in spans] == [
        ("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000"), ("local_phone", "555-123-4567"), ("email", "z@y.xx"),
    ]
    masked = pii.mask_pii(frame(spark).where("doc_id = 12"))
    assert masked.columns == ["doc_id", "text", "n_words", "spans"]
    assert masked.first().text == "account [iban], IBAN [iban] call [local_phone] 😀 😀 [email]"
    assert pii.mask_pii(frame(spark).where("doc_id = 1")).first().text is None


def test_bpe_equals_the_library(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(frame(spark).select("doc_id", "text"))
    out = bpe.decode_ids(bpe.encode_texts(docs, path), path).collect()
    for r in out:
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want, r.text[:200]
        assert r.decoded == lib.decode(want, skip_special_tokens=False)
    by_text = {r.text: r for r in out}
    digests = bpe.digests(docs.where("doc_id is not null"), path).join(docs, "doc_id").collect()
    for r in digests:
        if r.doc_id != 7 and r.doc_id > 13:
            o = by_text[r.text]
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(o.ids), brute.sha(" ".join(map(str, o.ids))), brute.sha(o.decoded))


def written(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, n_words string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_registered_queries_on_odd_rows(spark, tmp_path):
    sf_dir = written(spark, tmp_path, ODD)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    digest = lambda t: (len(i := lib.encode(t or "", add_special_tokens=False).ids), brute.sha(" ".join(map(str, i))), brute.sha(lib.decode(i, skip_special_tokens=False)))
    key = lambda r: str(tuple(r))
    got = queries.op9_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, *digest(t)) for d, t in ODD), key=str)
    rules = {r.doc_id: r for r in queries.op7_quality_rules(spark, sf_dir).where("doc_id <> 7").collect()}
    for d, t in ODD:
        if d in rules:
            n, chars, symbols, dup, repeat = brute.quality(t)
            failed = n < 20 or 100 * repeat > 30 * n
            assert tuple(rules[d])[1:7] == (n, chars, symbols, dup, repeat, failed) and not (failed and rules[d].kept)
    found = {r.doc_id: r for r in queries.op8_pii(spark, sf_dir).where("doc_id <> 7").collect()}
    for d, t in ODD:
        if d in found:
            spans = brute.base_pii(t)
            assert [found[d][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
            assert found[d].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
    ablations = queries.quality_rule_ablations(spark, sf_dir).collect()
    assert {r.version for r in ablations} == set(quality.POLICIES) and len({key(r) for r in ablations}) == len(ablations)


def test_registered_queries_on_an_empty_table(spark, tmp_path):
    sf_dir = written(spark, tmp_path, [])
    for query in (queries.op7_quality_rules, queries.op8_pii, queries.op9_bpe):
        assert query(spark, sf_dir).count() == 0


def test_a_word_is_merged_once(monkeypatch):
    """However it is written and whatever stands behind it, also after the known words were dropped for want of room."""
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own, merged = Tokenizer.from_file(path), bpe.WordBpe(path), []
    plain = own.merge
    monkeypatch.setattr(own, "merge", lambda words: merged.extend(words) or plain(words))
    texts = ["Parting parting, PARTING... parting's", "(Parting) parting!? <|endoftext|>parting;", "ÉTÉ été, parting's<|"]
    for t in texts:
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids
    assert sorted(merged) == sorted(set(merged)) and b"parting" in merged
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 4, raising=False)
    monkeypatch.setattr(bpe, "KNOWN_RUNS", 5, raising=False)
    for t in [*texts, *texts[::-1], "", " \x1c  ", "it's 12x3 don't<|startoftext|>"]:
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_a_worker_keeps_no_words_behind_its_task(spark):
    """Ids that leave in slices stay in order, and what the workers have learned is dropped when their tasks end."""
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i, " ".join(f"word{i} kept{j}" for j in range(i % 7)) if i % 5 else None) for i in range(300)] + [(300 + i, f"long{i} " * 90_000) for i in range(3)]
    # a name of its own for the file, so that what other tests leave does not count
    own = f"{os.path.dirname(path)}/./{os.path.basename(path)}"

    def left(batches):
        for _ in batches:
            time.sleep(1)  # every idle worker gets a task
        held = bpe._loaded.get(own)
        yield pd.DataFrame({"met": [held is not None], "n": [len(held.words) + len(held.runs) if held else 0]})

    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: list(r.ids) for r in bpe.encode_texts(docs, own).collect()}
    assert got == {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    workers = spark.range(0, 8, 1, 8).mapInPandas(left, "met boolean, n long").collect()
    assert any(r.met for r in workers) and not any(r.n for r in workers)
