"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent n-grams (one to three letters, words padded with a blank)
of a language in rank order. A document's own profile is compared to each language's by the
out-of-place distance: the sum over the document's n-grams of how far their ranks lie apart,
and the full profile length for an n-gram that the language lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400
UNKNOWN = "und"
_OTHER = regex.compile(r"\P{L}+")
_SHIFT = np.int64(21)  # a code point has at most 21 bits: three of them fill a long
#: Characters that are counted together; bounds the memory of a batch.
CHARS_AT_ONCE = 2_000_000


def _letters(text: str) -> str:
    """Lower-case letters, everything else one blank; starts and ends with a blank."""
    return " " + _OTHER.sub(" ", text.lower()).strip() + " "


def _codes(padded: str) -> np.ndarray:
    """All n-grams of a padded text as integers; a blank occurs at the edge of an n-gram only."""
    c = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.int64)
    blank = c == 32
    one = c[~blank]
    two = (c[:-1] << _SHIFT | c[1:])[~(blank[:-1] & blank[1:])]
    three = (c[:-2] << (2 * _SHIFT) | c[1:-1] << _SHIFT | c[2:])[~blank[1:-1]]
    return np.concatenate([one, two, three])


def _counted(padded: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_codes(padded), return_counts=True)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows with text and lang. Texts of one language in an Arrow batch are
    counted together, so the shuffle carries one row per language and distinct n-gram of a batch."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                parts, size = [], 0
                for t in [*texts, None]:
                    if t is None or size > CHARS_AT_ONCE:
                        if parts:
                            grams, n = _counted("".join(parts))
                            yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})
                        parts, size = [], 0
                    if t is not None:
                        parts.append(_letters(t))
                        size += len(t)

    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    return rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language, from all rows of ``docs`` (columns text and lang): n-grams in rank order,
    ties by code. The result is bounded by ``size`` n-grams for each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = ngram_counts(docs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r.rank)):
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        padded = _letters(text) if text else "  "
        if not self.langs or not padded.strip():
            return UNKNOWN, 0.0
        grams, n = _counted(padded)
        top = np.lexsort((grams, -n))[: self.size]
        at = np.searchsorted(self.grams, grams[top])
        at[at == len(self.grams)] = 0
        at[self.grams[at] != grams[top]] = len(self.grams)
        ranks = self.ranks[:, at]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(distance))  # the first in alphabetical order of equals
        return self.langs[best], float(1 - distance[best] / (self.size * len(top)))


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, lang_pred and score (1: the same ranks, 0: nothing shared) for every row of ``docs``.

    Only the text is looked at, all of it. ``und`` with score 0 where the text is NULL or has
    no letter, or if nothing was learned. Equal distances go to the first language in
    alphabetical order. Rows stay where they are: no shuffle; repeated rows give repeated rows; an empty table gives an
    empty result; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(Classifier(profiles))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([model.value.predict(t) for t in batch], columns=["lang_pred", "score"])

    return docs.select("doc_id", predict("text").alias("p")).select("doc_id", "p.*")
