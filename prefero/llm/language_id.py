"""Language identification by rank-order profiles of character n-grams.

A language's profile lists its most frequent n-grams (one to three letters,
words padded by a space) over all its learning texts.  A document's own most
frequent n-grams are compared to each profile by out-of-place distance: the
sum of rank differences, the profile's length for an n-gram it lacks.

Texts that are null or hold no letter (of Unicode's letter categories; numbers such as
the superscript two are none) are ``und`` with score 0, and so is every
text if nothing could be learned.  Ties go to the language first by code point, ties
between n-grams to the smaller number.  Whole texts are read, however long.  Repeated
rows count, and are answered, each; an empty table gives an empty result; other
columns pass through, and one named as the result is replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefero.llm.token_counts import blocks

#: N-grams in a profile.
PROFILE = 300
UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")
#: N-grams that a task counts before it hands them on.
HELD = 500_000
#: Bits of one code point in an n-gram's number.
BITS = 21


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case.  Python's word characters hold numbers that are no digits, too: those end a run."""
    found = WORDS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def _points(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)


def _grams(points: np.ndarray) -> list[np.ndarray]:
    """Numbers of the n-grams of one to three characters that start at each place, as separate arrays."""
    two = (points[:-1] << BITS) | points[1:]
    return [points, two, (two[:-1] << BITS) | points[2:]]


def _inside(points: np.ndarray) -> list[np.ndarray]:
    """Which of ``_grams`` lie in one padded word: no lone space, none in the middle."""
    word = points != 32
    return [word, word[:-1] | word[1:], word[1:-1]]


def _counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        codes = np.sort(codes)
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
        return codes[starts], np.diff(np.append(starts, len(codes)))
    found, at = np.unique(codes, return_inverse=True)
    return found, np.bincount(at, weights, len(found)).astype(np.int64)


def gram_counts(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """N-grams and their numbers over words that occur as often as the counter says."""
    points = _points(" " + " ".join(words) + " ")
    lengths = np.array([len(w) + 1 for w in words])
    times = np.append(np.repeat(np.fromiter(words.values(), np.int64, len(words)), lengths), 0)
    # a place is weighed as the word it is in; the space before a word as that word
    times = np.concatenate([times, [0]])[: len(points)]
    codes, keep = _grams(points), _inside(points)
    return _counted(np.concatenate([c[k] for c, k in zip(codes, keep, strict=True)]), np.concatenate([times[: len(c)][k] for c, k in zip(codes, keep, strict=True)]))


def document_ranks(text: str) -> np.ndarray:
    """A document's most frequent n-grams, the most frequent first, ties by number."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64)
    points = _points(" " + " ".join(words) + " ")
    codes, counts = _counted(np.concatenate([c[k] for c, k in zip(_grams(points), _inside(points), strict=True)]))
    if len(codes) > PROFILE:
        least = np.partition(counts, -PROFILE)[-PROFILE]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")][:PROFILE]


def _as_rows(lang: str, counts: dict[int, int]) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "gram": np.fromiter(counts.keys(), np.int64, len(counts)), "n": np.fromiter(counts.values(), np.int64, len(counts))})


def _count_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    size = 0  # n-grams held of all languages together
    for rows in batches:
        for lang, texts in rows.groupby("lang")["text"]:
            for block in blocks(texts):
                words: Counter = Counter()
                for t in block:
                    words.update(words_of(t))
                if words:
                    mine = held[lang]
                    size -= len(mine)
                    for c, n in zip(*map(np.ndarray.tolist, gram_counts(words)), strict=True):
                        mine[c] += n
                    size += len(mine)
                    while size > HELD:  # the language that holds most goes first
                        most = max(held, key=lambda x: len(held[x]))
                        size -= len(held[most])
                        yield _as_rows(most, held.pop(most))
    for lang, mine in held.items():
        yield _as_rows(lang, mine)


def profiles(docs: DataFrame) -> DataFrame:
    """lang, gram, rank (from 0): the profiles of the languages of ``docs``, by all their texts."""
    learning = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = learning.mapInPandas(_count_task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.select("lang", "gram", (rank - 1).alias("rank")).where(F.col("rank") < PROFILE)


class Identifier:
    """Compares documents to the profiles; holds them as one table of n-grams by languages."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.langs = sorted(rows["lang"].unique())
        self.grams = np.unique(rows["gram"].to_numpy(np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        self.ranks[np.searchsorted(self.grams, rows["gram"].to_numpy(np.int64)), np.searchsorted(np.array(self.langs, dtype=object), rows["lang"].to_numpy(object))] = rows["rank"].to_numpy(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        own = document_ranks(text) if text else np.zeros(0, np.int64)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (PROFILE * len(own))


def with_language(docs: DataFrame, learned: DataFrame, out: str = "language") -> DataFrame:
    """``docs`` with a struct (lang, score) for each whole text.

    ``learned`` comes from ``profiles``: at most PROFILE rows a language, which is
    what the driver hands to the tasks.
    """
    rows = learned.toPandas()

    @F.pandas_udf("lang string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        who = Identifier(rows)
        for texts in batches:
            yield pd.DataFrame([who.predict(t) for t in texts], columns=["lang", "score"])

    return docs.withColumn(out, identify(F.col("text")))


