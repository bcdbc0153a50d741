from collections import Counter

from fitgate.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    split = language.F.crc32(docs.doc_id.cast("string")) % 4
    profiles = language.learn(docs.where(split != 2))
    out = language.identify(docs.where(split == 2).select("doc_id", "text"), profiles).join(docs, "doc_id").where("lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_profiles_and_distance_against_brute_force(spark):
    rows = [(1, "the cat the hat", "en"), (2, "der Hund, die Katze", "de"), (3, "ÄÖ the", "en"), (4, "x", None), (5, None, "en"), (6, "12 !", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(texts):
        c = Counter()
        for t in texts:
            for w in "".join(ch if ch.isalpha() else " " for ch in t.lower()).split():
                c.update(w)
                p = f" {w} "
                c.update(p[i : i + 2] for i in range(len(p) - 1))
                c.update(p[i : i + 3] for i in range(len(p) - 2))
        code = lambda g: int("".join(f"{ord(x):021b}" for x in g), 2)
        return [g for g, _ in sorted(((code(g), n) for g, n in c.items()), key=lambda x: (-x[1], x[0]))]

    profiles = language.learn(docs, size=30)
    want = {"en": grams(["the cat the hat", "ÄÖ the"])[:30], "de": grams(["der Hund, die Katze"])[:30]}
    assert profiles == want
    for doc, text, _ in rows:
        got = language.identify(docs.where(f"doc_id = {doc}"), profiles).first()
        model = language.Classifier(profiles)
        assert (got.lang_pred, got.score) == model.predict(text)
        if text is None or not any(map(str.isalpha, text)):
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        top = grams([text])[: model.size]
        dist = {k: sum(abs(p.index(g) - i) if g in p else model.size for i, g in enumerate(top)) for k, p in want.items()}
        assert got.lang_pred == min(sorted(dist), key=dist.get)
    assert language.identify(docs, {}).first().lang_pred == "und"
    assert language.learn(docs.limit(0)) == {}
