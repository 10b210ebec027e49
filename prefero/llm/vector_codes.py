"""Vector compression by product codes, assigned by Exponion search.

A vector's components become integers, floor(``SCALE`` * x), and its integers are cut into
``PARTS`` consecutive parts.  Each part position has a codebook of ``ENTRIES`` entries, which
starts as that part of the vectors of least id.  Each of ``ROUNDS`` rounds assigns every part to
the nearest entry and replaces each entry by the floor of its parts' mean.

Exponion search: a part starts at the entry it was assigned to in the round before, at squared
distance u.  An entry as near as that lies within twice the distance of the previous entry, so
only those of its neighbour list (sorted by distance) whose squared distance to it is at most 4u
are measured: at the first one beyond, the search stops.  All distances are exact integers, and
ties go to the lower index, so codes do not depend on where a search starts.

Each round is one pass over the rows: a task writes codes and, after its rows, one row of sums;
nothing but the sums (a fixed number) comes to the driver.

Rows whose vector is null or holds null or non-finite components are dropped.  Rows without an id
are coded like others and start no codebook unless fewer ids than entries are there; repeated rows are
coded each, and repeated ids start a codebook each, ordered by vector.  Fewer rows than entries
give smaller codebooks.  Empty vectors, vectors of different lengths, of a length that is no multiple of
``PARTS``, or with components of ``LIMIT`` and more are refused.  An empty table gives an empty
result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefero.llm.common import discard, scratch, small_side, staged

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components of this size are refused: squares of their integers' differences might pass 64 bits.
LIMIT = 2.0**13


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label, q: the rows that take part, their components as integers."""
    x = F.col("embedding").cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    kept = vectors.where(whole)
    # a component beyond the limit has no integer here; it is refused when the lengths are looked at
    scaled = F.transform(x, lambda c: F.when(F.abs(c) < LIMIT, F.floor(c * SCALE)).cast("int"))
    return kept.select("vec_id", "label", scaled.alias("q"))


def nearest_entries(x: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties: the lower index), and its squared distance."""
    apart = ((book[:, None] - book[None]) ** 2).sum(axis=2)
    best, least = start.astype(np.int64), ((x - book[start]) ** 2).sum(axis=1)
    for entry in np.unique(start):
        own = np.flatnonzero(start == entry)
        own = own[np.argsort(-least[own], kind="stable")]
        reach = 4 * least[own]  # falls from row to row, so those an entry may concern come first
        for other in np.argsort(apart[entry], kind="stable"):
            if other == entry:
                continue
            rows = own[: int(np.searchsorted(-reach, -apart[entry, other], side="right"))]
            if not len(rows):
                break
            far = ((x[rows] - book[other]) ** 2).sum(axis=1)
            nearer = (far < least[rows]) | ((far == least[rows]) & (other < best[rows]))
            best[rows[nearer]], least[rows[nearer]] = other, far[nearer]
    return best, least


def _assignment(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds = np.zeros((parts, entries, width + 1), np.int64), None
        for rows in batches:
            n, kinds = rows.num_rows, rows.schema
            if not n:
                continue
            q = rows["q"].flatten().to_numpy().astype(np.int64).reshape(n, parts, width)
            before = rows["code"].flatten().to_numpy().reshape(n, parts)
            code, error = np.zeros((n, parts), np.int8), np.zeros(n, np.int64)
            for p in range(parts):
                best, far = nearest_entries(q[:, p], books[p], before[:, p])
                code[:, p] = best
                error += far
                for entry in np.unique(best):
                    own = q[best == entry, p]
                    sums[p, entry, :-1] += own.sum(axis=0)
                    sums[p, entry, -1] += len(own)
            starts = pa.array(np.arange(0, n * parts + 1, parts, dtype=np.int32))
            new = [pa.ListArray.from_arrays(starts, pa.array(code.ravel())).cast(kinds.field("code").type), pa.array(error), pa.nulls(n, kinds.field("sums").type)]
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in ("vec_id", "label", "q")), *new], schema=kinds)
        if kinds is not None:
            last = [pa.nulls(1, kinds.field(c).type) for c in ("vec_id", "label", "q", "code", "error")]
            yield pa.RecordBatch.from_arrays([*last, pa.array([sums.ravel()], kinds.field("sums").type)], schema=kinds)

    return run


def _first_codebooks(rows: DataFrame) -> np.ndarray:
    """PARTS x entries x components: the parts of the rows of least id."""
    q = F.col("q")
    said = rows.agg(F.min(F.size(q)), F.max(F.size(q)), F.max(F.exists(q, lambda c: c.isNull()))).collect()[0]
    if said[0] is None:
        return np.zeros((PARTS, 0, 0), np.int64)
    if said[0] != said[1] or said[0] % PARTS or not said[0]:
        raise ValueError(f"vectors have {said[0]} to {said[1]} components: all must have the same number, a multiple of {PARTS}")
    if said[2]:
        raise ValueError(f"components must be less than {LIMIT} in size")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "q").limit(ENTRIES).collect()  # ENTRIES rows
    return np.array([r["q"] for r in first], np.int64).reshape(len(first), PARTS, -1).swapaxes(0, 1)


def _means(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floors of means; unused entries stay."""
    parts, entries, width = books.shape
    found = rows.where("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()  # one a component
    sums = np.zeros(parts * entries * (width + 1), np.int64)
    for r in found:
        sums[r["pos"]] = r["n"]
    sums = sums.reshape(parts, entries, width + 1)
    n = sums[:, :, -1:]
    return np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), books)


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) for every kept row, and the final codebooks (part, entry, component).

    ``code`` holds the index of each part's entry, ``error`` the sum of the squared distances.
    """
    kinds = {f.name: f.dataType for f in vectors.schema}
    schema = T.StructType([T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"]), T.StructField("q", T.ArrayType(T.IntegerType())), T.StructField("code", T.ArrayType(T.ByteType())), T.StructField("error", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    begun = F.array_repeat(F.lit(0).cast("tinyint"), PARTS)
    with scratch():
        rows = staged(quantised(vectors).select("*", begun.alias("code"), F.lit(0).cast("long").alias("error"), F.lit(None).cast("array<bigint>").alias("sums")), "vectors")
        books = _first_codebooks(rows)
        for turn in range(ROUNDS + 1 if books.size else 0):
            before, rows = rows, staged(rows.where("sums IS NULL").mapInArrow(_assignment(books), schema), "codes")
            discard(before)
            if turn < ROUNDS:
                books = _means(rows, books)
        coded = staged(rows.where("sums IS NULL").select("vec_id", "label", "code", "error"), "coded", outlives=True)
    return coded, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of the errors over rows of the same label, those without one together."""
    of = small_side(staged(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors", outlives=True))
    return coded.join(of, coded["label"].eqNullSafe(of["_label"])).drop("_label")
