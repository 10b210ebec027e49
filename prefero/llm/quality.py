"""Quality classifier: random-indexing word vectors and a two-layer network.

Every vocabulary entry has a sparse ternary index vector, drawn by its number.
An entry's word vector sums the index vectors of its neighbours over the whole
corpus.  The vocabulary is hashed to a fixed number of entries, so the table of
vectors has a proven size; words in capitals, numbers and immediate repeats have
entries of their own.  A document pools its words' vectors by mean and standard
deviation, and a two-layer numpy network gives a probability, calibrated by a
temperature.

The network is fitted on at most ``FIT_ROWS`` labelled rows (those with the
lowest hash of their id); the vectors use every document.  Empty and null texts
pool to zeros and get the network's score for that.  Equal texts get equal scores; repeated rows are
scored each; texts of any length are read whole; an empty table gives an empty result; extra columns
pass through, and one named as the result is replaced.  Without usable labels of
both classes each text gets the labels' mean, or 1 if there are none.  Ties: texts of one score are all predicted alike, and a score of just a half
counts as good; of rows of one hash of id, the smaller id is learned from first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefero.llm.common import id_text
from prefero.llm.token_counts import blocks

#: Vocabulary entries and dimensions of a word vector; non-zero places of an index vector; neighbours to each side.
ENTRIES, DIMS, PLACES, NEAR = 1 << 14, 32, 2, 2
#: Labelled rows that the network is fitted on at most.
FIT_ROWS = 20_000
HIDDEN, EPOCHS, STEP = 24, 400, 0.02
CAPITALS, NUMBER, AGAIN = 0, 1, 2
TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class _Entries(dict):
    """Token to vocabulary entry; starts anew when it holds many tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        if token.isdecimal():
            entry = NUMBER
        elif len(token) > 1 and token.isupper():
            entry = CAPITALS
        else:
            entry = 3 + zlib.crc32(token.lower().encode("utf-8", "replace")) % (ENTRIES - 3)
        self[token] = entry
        return entry


def entries_of(texts: list[str], entries: _Entries) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all tokens, text after text, and where each text ends."""
    get = entries.__getitem__
    found = [list(map(get, TOKENS.findall(t))) for t in texts]
    ends = np.cumsum([len(f) for f in found])
    ids = np.fromiter((i for f in found for i in f), np.int32, int(ends[-1]) if len(ends) else 0)
    same = np.flatnonzero(ids[1:] == ids[:-1]) + 1
    same = same[~np.isin(same, ends) & (ids[same] > NUMBER)]
    ids[same] = AGAIN
    return ids, ends


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each entry's index vector, from a fixed seed."""
    draw = np.random.default_rng(20_240_501)
    places = np.argsort(draw.random((ENTRIES, DIMS)), axis=1)[:, :PLACES]
    return places.astype(np.int32), draw.choice(np.array([-1, 1], np.int32), (ENTRIES, PLACES))


def _vector_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    places, signs = index_vectors()
    entries, total = _Entries(), np.zeros(ENTRIES * DIMS, np.int64)
    for rows in batches:
        for block in blocks(rows["text"]):
            ids, ends = entries_of(block, entries)
            text = np.searchsorted(ends, np.arange(len(ids)), side="right")
            for apart in range(1, NEAR + 1):
                a, b = ids[:-apart], ids[apart:]
                together = text[:-apart] == text[apart:]
                a, b = a[together], b[together]
                for one, other in ((a, b), (b, a)):
                    for k in range(PLACES):
                        total += np.bincount(one * DIMS + places[other, k], signs[other, k], ENTRIES * DIMS).astype(np.int64)
    table = total.reshape(ENTRIES, DIMS)
    used = np.flatnonzero(table.any(axis=1))
    if len(used):
        yield pd.DataFrame({"entry": used, "sums": list(table[used])})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors over all texts: ENTRIES x DIMS, unit length, common part taken out."""
    sums = docs.where(F.col("text").isNotNull()).select("text").mapInPandas(_vector_task, "entry int, sums array<long>")
    total = sums.groupBy("entry").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(DIMS)]).alias("sums"))
    rows = total.toPandas()  # at most ENTRIES rows
    table = np.zeros((ENTRIES, DIMS))
    if len(rows):
        table[rows["entry"].to_numpy()] = np.array(rows["sums"].tolist(), float)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)
    table -= table.sum(axis=0) / max(1, len(rows)) * (table.any(axis=1, keepdims=True))
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(texts: list[str], table: np.ndarray, entries: _Entries) -> np.ndarray:
    """Mean and standard deviation of the words' vectors of each text."""
    ids, ends = entries_of(texts, entries)
    out = np.zeros((len(texts), 2 * DIMS))
    at = 0
    for i, end in enumerate(ends):
        if end > at:
            n = np.bincount(ids[at:end], minlength=0)
            used = np.flatnonzero(n)
            share, own = n[used] / (end - at), table[used]
            mean = share @ own
            out[i, :DIMS] = mean
            out[i, DIMS:] = np.sqrt(np.maximum(share @ (own * own) - mean * mean, 0))
        at = end
    return out


class Network:
    """Inputs to a hidden layer of tanh to one logit, divided by a temperature."""

    def __init__(self, inputs: np.ndarray, labels: np.ndarray, rounds: int = EPOCHS, seed: int = 7) -> None:
        self.rate = float(labels.mean()) if len(labels) else 1.0
        self.fitted = bool(len(labels) >= 8 and 0 < labels.sum() < len(labels))
        if not self.fitted:
            return
        draw = np.random.default_rng(seed)
        self.mean, self.scale = inputs.mean(axis=0), np.maximum(inputs.std(axis=0), 1e-6)
        x = (inputs - self.mean) / self.scale
        aside = draw.random(len(x)) < 0.2
        w = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        fit, y = x[~aside], labels[~aside]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for t in range(1, rounds + 1):
            h = np.tanh(fit @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
            d = (p - y) / len(y)
            back = np.outer(d, w[2]) * (1 - h * h)
            for i, g in enumerate((fit.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ d + 1e-4 * w[2], np.array([d.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - STEP * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        if aside.sum() >= 8:
            logits, true = self._logits(inputs[aside]), labels[aside]
            losses = {t: float(np.mean(np.logaddexp(0, np.where(true > 0.5, -1, 1) * logits / t))) for t in np.geomspace(0.25, 8, 41)}
            self.temperature = float(min(losses, key=losses.get))

    def _logits(self, inputs: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh((inputs - self.mean) / self.scale @ w[0] + w[1]) @ w[2] + w[3]

    def scores(self, inputs: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(inputs), self.rate)
        return 1 / (1 + np.exp(-np.clip(self._logits(inputs) / self.temperature, -30, 30)))


def fit_network(docs: DataFrame, labels: DataFrame, table: np.ndarray, fit_rows: int = FIT_ROWS) -> Network:
    """Fit on the labelled texts, ``fit_rows`` at most; ``labels`` has doc_id and quality.

    Rows whose quality is not 0 or 1 are left out; an id labelled twice counts by its mean.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    chosen = known.orderBy(F.md5(id_text("doc_id")), "doc_id").limit(fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<double>")
    def pool(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        entries = _Entries()
        for texts in batches:
            rows = [r for block in blocks("" if t is None else t for t in texts) for r in pooled(block, shared.value, entries)]
            yield pd.Series(rows, dtype="object")

    # fit_rows bounds the chosen rows, so they may be broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # of an id that repeats, the text of least hash stands for it, so the rows collected are fit_rows at most
    one = joined.groupBy("doc_id").agg(F.min_by(F.struct("text", "quality"), F.md5(F.coalesce("text", F.lit("")))).alias("r"))
    rows = one.select("doc_id", "r.quality", pool("r.text").alias("pooled")).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    inputs = np.array(rows["pooled"].tolist(), float).reshape(len(rows), 2 * DIMS)
    return Network(inputs, (rows["quality"].to_numpy(float) >= 0.5).astype(float))


def with_quality(docs: DataFrame, labels: DataFrame, out: str = "quality_score", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with the probability of quality 1; learned from the rows of ``labels``."""
    table = word_vectors(docs)
    network = fit_network(docs, labels, table, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast((table, network))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors, net = shared.value
        entries = _Entries()
        for texts in batches:
            parts = [net.scores(pooled(block, vectors, entries)) for block in blocks("" if t is None else t for t in texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out, score(F.col("text")))
