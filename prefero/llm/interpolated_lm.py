"""Language-model scoring by deleted interpolation.

Word bigrams, words and a uniform floor are mixed:

    P(w | h) = l2(b) c(h, w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1)

where b is the bucket of the context's frequency (the power of two below c(h)),
and the weights l of each bucket are learned by expectation-maximisation on
documents held aside: there the maximum-likelihood estimates come from the other
learning documents alone.  The final model counts over all learning documents.

How the work is spread.  Texts are packed into chunks of some megabytes.  Each
chunk sends its distinct n-grams, as hashed keys with its own counts, to ranges
of the key space (one row per chunk and range); a range adds up the counts of
all chunks and answers each chunk for the keys it sent.  So every n-gram is
counted over the whole corpus, a frequent one arrives once per chunk, and no
table of n-grams is gathered anywhere.  The chunks then know the counts of each
of their tokens, which is all that the mixing and the scores need.

Texts are lower-cased (A-Z); tokens are words and one end per text.  Null and
empty texts are the end alone.  If nothing is learned, N and V are 0 and every
token has the uniform probability 1.  Rows repeat as they come; extra columns
are dropped; an empty table gives an empty result.  Totals are 64-bit numbers.  Keys have 56 bits, so unequal n-grams meet in a key with a chance
of one in 7e16 per pair.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefero.llm.common import WORD, lowered_bytes, staged

WORDS = re.compile(WORD.encode())
#: Characters of a chunk of texts and of the share of a key range, about.
CHUNK, RANGE = 6_000_000, 8_000_000
KEY_BITS = 56
#: Log-ratio step of the table that expectation-maximisation runs on, and its rounds.
STEP, ROUNDS = 0.1, 60
#: Buckets of context frequency: 0, then powers of two.
BUCKETS = 48
END, START = 0, 1
LEARN, ASIDE = 1, 2


class _Ids(dict):
    """Numbers words as they come; 0 and 1 are the end and the start."""

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self) + 2
        return i


class _Numbers(dict):
    """Word to a 64-bit number; starts anew when it holds many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = n = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return n


_NUMBERS = _Numbers()
_THE_END = np.zeros(1, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ChunkGrams:
    """The tokens of a chunk's texts and its distinct n-grams as sorted keys.

    ``keys`` are sorted; ``word_at`` and ``pair_at`` give, for each token, the places of
    its word and of its bigram among them.  A key's lowest bit tells words (0) from bigrams (1).
    """

    def __init__(self, texts: list[bytes]) -> None:
        ids = _Ids()
        parts: list[np.ndarray] = []
        for t in texts:
            words = WORDS.findall(t)
            parts += [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), _THE_END]
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.ends = np.cumsum([len(p) for p in parts])[1::2]
        numbers = np.array([_NUMBERS[b" end"], _NUMBERS[b" start"], *map(_NUMBERS.__getitem__, ids)], np.uint64)
        before = np.concatenate([[START], self.tokens[:-1]])
        before[self.ends[:-1]] = START
        pairs, pair_of = np.unique(before * len(numbers) + self.tokens, return_inverse=True)
        top = np.uint64(64 - KEY_BITS + 1)
        word_keys = (_mixed(numbers) >> top) << np.uint64(1)
        pair_keys = ((_mixed(_mixed(numbers[pairs // len(numbers)]) * np.uint64(3) + numbers[pairs % len(numbers)]) >> top) << np.uint64(1)) | np.uint64(1)
        every = np.concatenate([word_keys, pair_keys])
        order = np.argsort(every, kind="stable")
        place = np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        self.keys = every[order]
        self.word_at, self.pair_at = place[self.tokens], place[len(numbers) :][pair_of]

    def counts(self, parts: np.ndarray, part: int) -> np.ndarray:
        """How often each key occurs in the texts of one part."""
        token_part = np.repeat(parts, np.diff(self.ends, prepend=0))
        mine = token_part == part
        return np.bincount(np.concatenate([self.word_at[mine], self.pair_at[mine]]), minlength=len(self.keys)).astype(np.int32)


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The key range of each key, ascending with the key."""
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(ranges)) >> np.uint64(32)


def _pack(x: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 3)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _pack_texts(texts: list[str]) -> tuple[bytes, list[int]]:
    coded = [lowered_bytes(t) for t in texts]
    return zstandard.compress(b"".join(coded), 9), [len(c) for c in coded]


def _unpack_texts(data: bytes, sizes: np.ndarray) -> list[bytes]:
    raw, at, out = zstandard.decompress(data), 0, []
    for n in sizes:
        out.append(raw[at : at + n])
        at += n
    return out


def _chunk_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first = TaskContext.get().partitionId() << 32
    ids, parts, texts, size, n = [], [], [], 0, 0

    def packed() -> pd.DataFrame:
        data, sizes = _pack_texts(texts)
        return pd.DataFrame({"chunk": [first + n], "ids": [ids], "parts": [parts], "sizes": [sizes], "texts": [data]})

    for rows in batches:
        for i, part, text in zip(rows["doc_id"], rows["part"], rows["text"], strict=True):
            text = text or ""
            if texts and size + len(text) > CHUNK:
                yield packed()
                ids, parts, texts, size, n = [], [], [], 0, n + 1
            ids.append(i)
            parts.append(int(part))
            texts.append(text)
            size += len(text)
    if texts:
        yield packed()


def _grams_of(row) -> tuple[ChunkGrams, np.ndarray]:
    return ChunkGrams(_unpack_texts(row.texts, row.sizes)), np.array(row.parts, np.int64)


def _asking(ranges: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                grams, parts = _grams_of(row)
                counts = np.stack([grams.counts(parts, LEARN), grams.counts(parts, ASIDE)], axis=1)
                of = _ranges(grams.keys, ranges)
                cuts = np.flatnonzero(np.diff(of, prepend=of[:1] + np.uint64(1)))
                ends = np.append(cuts[1:], len(of))
                yield pd.DataFrame(
                    {
                        "range": of[cuts].astype(np.int64),
                        "chunk": row.chunk,
                        "keys": [_pack(np.diff(grams.keys[a:b], prepend=np.uint64(0))) for a, b in zip(cuts, ends, strict=True)],
                        "counts": [_pack(counts[a:b].ravel()) for a, b in zip(cuts, ends, strict=True)],
                    }
                )

    return run


#: The chunk that stands for the corpus: ranges send it their totals.
WHOLE = -1


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts over all chunks for each chunk's keys of one range, and the range's totals of words."""
    keys = [np.cumsum(_unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
    counts = np.concatenate([_unpack(c, np.int32) for c in rows["counts"]]).reshape(-1, 2)
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.stack([np.bincount(at, counts[:, j], len(found)) for j in (0, 1)], axis=1).astype(np.int64)
    words = total[(found & np.uint64(1)) == 0]
    stats = np.array([words[:, 0].sum(), words.sum(), (words[:, 0] > 0).sum(), (words.sum(axis=1) > 0).sum()], np.int64)
    out, a = [], 0
    for chunk, k in zip(rows["chunk"], keys, strict=True):
        out.append((chunk, rows["range"].iat[0], _pack(total[at[a : a + len(k)]].ravel())))
        a += len(k)
    out.append((WHOLE, rows["range"].iat[0], _pack(stats)))
    return pd.DataFrame(out, columns=["chunk", "range", "counts"])


#: Columns of assembled chunks: whose texts they are, tokens of each, and packed counts of every token's word and bigram.
ASSEMBLED = "ids array<string>, parts array<int>, sizes array<int>, word binary, pair binary, word_learn binary, pair_learn binary"


def _assembled(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A chunk's tokens with the counts of their words and bigrams; for the whole corpus one row of totals.

    The counts over the learning part alone are kept for texts held aside.
    """
    columns = [c.split()[0] for c in ASSEMBLED.split(", ")]
    if not len(answers):
        return pd.DataFrame({c: [] for c in columns})
    if answers["chunk"].iat[0] == WHOLE:
        stats = sum(_unpack(c, np.int64) for c in answers["counts"])
        return pd.DataFrame([([None], [WHOLE], [0], stats.tobytes(), None, None, None)], columns=columns)
    counts = np.concatenate([_unpack(c, np.int64) for c in answers.sort_values("range")["counts"]]).reshape(-1, 2)
    row = next(chunks.itertuples())
    grams, parts = _grams_of(row)
    sizes = np.diff(grams.ends, prepend=0)
    aside = np.repeat(parts, sizes) == ASIDE
    both = counts.sum(axis=1)
    learn = np.ascontiguousarray(counts[:, 0])
    packed = [_pack(x) for x in (both[grams.word_at], both[grams.pair_at], learn[grams.word_at[aside]], learn[grams.pair_at[aside]])]
    return pd.DataFrame([(list(row.ids), parts.tolist(), sizes.tolist(), *packed)], columns=columns)


def token_counts(docs: DataFrame) -> DataFrame:
    """Chunks of texts with packed counts of every token's word and bigram (see ASSEMBLED), staged.

    ``docs`` has doc_id, text and part: LEARN, ASIDE (learned from, but held aside for
    the mixture's weights) or 0.
    """
    whole = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("part").cast("int").alias("part"), "text")
    size = whole.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    ranges = max(1, math.ceil(size / RANGE))
    chunks = staged(whole.mapInPandas(_chunk_task, "chunk long, ids array<string>, parts array<int>, sizes array<int>, texts binary"), "chunks")
    asked = chunks.mapInPandas(_asking(ranges), "range long, chunk long, keys binary, counts binary")
    answers = asked.groupBy("range").applyInPandas(_answer, "chunk long, range long, counts binary")
    rows = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_assembled, ASSEMBLED)
    return staged(rows, "token-counts")


def _estimates(word: np.ndarray, pair: np.ndarray, starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, bigram and word estimates of each token, from the counts of its word and bigram; ``starts``: where texts begin."""
    context = np.concatenate([[0], word[:-1]]).astype(float)
    context[starts] = word[-1]  # each text has one start, as it has one end
    bucket = np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(int) + 1, BUCKETS - 1), 0)
    return bucket, np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0), word / max(total, 1)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _ratio_cells(word: np.ndarray, pair: np.ndarray, starts: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """Each token's cell: bucket and rounded log-ratios of its estimates to the uniform one."""
    bucket, p2, p1 = _estimates(word, pair, starts, total)
    uniform = 1 / (distinct + 1)
    level = lambda p: np.where(p > 0, np.clip(np.round(np.log(np.maximum(p, 1e-300) / uniform) / STEP).astype(np.int64) + 500, 1, 999), 0)
    return (bucket * 1000 + level(p2)) * 1000 + level(p1)


def _cells(total: int, distinct: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                sizes = np.array(row.sizes)[np.array(row.parts) == ASIDE]
                if len(sizes):
                    found, n = np.unique(_ratio_cells(_unpack(row.word_learn, np.int64), _unpack(row.pair_learn, np.int64), _starts(sizes), total, distinct), return_counts=True)
                    yield pd.DataFrame({"cell": found, "n": n})

    return run


def mixture_weights(cells: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, word, uniform) of each bucket by expectation-maximisation."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0.0, 0.7, 0.3]
    if not len(cells):
        return weights
    bucket, levels = cells // 1_000_000, np.stack([cells // 1000 % 1000, cells % 1000], axis=1)
    ratios = np.concatenate([np.where(levels > 0, np.exp((levels - 500) * STEP), 0.0), np.ones((len(cells), 1))], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * ratios
        share *= (n / share.sum(axis=1))[:, None]
        # one pseudo-count of each kind keeps every weight above zero
        new = np.stack([np.bincount(bucket, share[:, j], BUCKETS) for j in range(3)], axis=1) + np.where(np.arange(BUCKETS)[:, None] == 0, [0.0, 1.0, 1.0], 1.0)
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


def _texts_scored(total: int, distinct: int, weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                word, pair, sizes = _unpack(row.word, np.int64), _unpack(row.pair, np.int64), np.array(row.sizes)
                starts = _starts(sizes)
                bucket, p2, p1 = _estimates(word, pair, starts, total)
                mix = weights[bucket]
                mixed = mix[:, 0] * p2 + mix[:, 1] * p1 + mix[:, 2] / (distinct + 1) if total else np.ones(len(word))
                per_text = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                yield pd.DataFrame(
                    {
                        "doc_id": pd.Series(row.ids, dtype="object"),
                        "part": row.parts,
                        "n_tokens": sizes,
                        "n_known": per_text((word > 0).astype(np.int64)),
                        "train_tokens": total,
                        "base_score": per_text(np.log10((word + 1.0) / (total + (distinct + 1.0)))),
                        "score": per_text(np.log10(mixed)),
                    }
                )

    return run


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, part, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (see ``token_counts``)."""
    rows = token_counts(docs)
    is_whole = F.get("parts", F.lit(0)) == WHOLE
    totals = rows.where(is_whole).select("word").collect()  # one row
    learn_total, total, learn_distinct, distinct = map(int, np.frombuffer(totals[0]["word"], np.int64)) if totals else (0, 0, 0, 0)
    texts = rows.where(~is_whole)
    cells = texts.select("parts", "sizes", "word_learn", "pair_learn").mapInPandas(_cells(learn_total, learn_distinct), "cell long, n long")
    table = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas().sort_values("cell")  # as many rows as cells are in use
    weights = mixture_weights(table["cell"].to_numpy(np.int64), table["n"].to_numpy(float))
    found = texts.select("ids", "parts", "sizes", "word", "pair").mapInPandas(
        _texts_scored(total, distinct, weights), "doc_id string, part int, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
