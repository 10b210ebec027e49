"""Exact Jaccard join of shingle sets, with set-relation skipping, down to components.

A document's set holds its distinct runs of ``WIDTH`` words.  Two sets link when 100 times their
intersection is at least ``PERCENT`` times their union.  Every such link counts towards the components,
and nothing else does: no link is sampled, and a candidate is confirmed by exact counts.

*Index lists, skipped by position.*  A set's shingles are ordered by how often they occur, rarest
first (a table of ``CELLS`` counters over all texts tells; the order only has to be one for all
sets, so counters that meet cost time, not links).  Two sets that link share a shingle in short
beginnings of both.  Lists are cut into blocks by size: a set of class c meets sets of its class and
of c - 1 in block c, and larger ones in block c + 1.  A set enters a block only with the positions
from which enough of it is left for the least partner in there; all other positions skip the block.

*Answers from a similar set.*  The first of a block by position leads it; only leaders meet their
members, so pairs grow with the lists' rows.  A member's difference from its leader answers for
it from then on: with d(x) for the shingles in just one of x and leader, x and y differ in
|d(x)| + |d(y)| - 2 |d(x) & d(y)| shingles, so that pair is decided by two short differences.
Members that a leader's links already hold in one component are skipped whole; only where a leader's
members fall into several components do they meet, outsiders in blocks of ``BLOCK``
against the others, so no task holds more than two blocks, and a task hands on only links that join
components.

*Bounds before texts.*  A set carries the parity of its shingles in each of a few bits a shingle.  Two
sets differ in at least as many shingles as their parities do in bits, so texts are fetched only of
pairs, and differences made only of members, that those bounds leave in play.

Shingles and sets are told apart by 64-bit hashes.  Null and wordless texts have the empty set, which links
with nothing, not even with its like: their component is their own id.  Fewer words than ``WIDTH`` are one shingle.
Whole texts of any length count.  Equal texts and equal sets link; repeated rows get a row each.  Rows without an id
link like others; a component of such rows alone has a null id.  An id that repeats with different texts
does not tie their sets together.  An empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefero.llm.common import discard, lowered_bytes, scratch, small_batches, spread, staged
from prefero.llm.linking import components, merged, renamed, whole_groups
from prefero.llm.token_counts import blocks

WIDTH, PERCENT = 5, 80
#: Counters of each of the two rows of the table of frequencies, and counters that are summed as one row.
CELLS, TOGETHER = 1 << 19, 64
#: Members of a leader whose differences a task holds, twice.
BLOCK = 256
#: Rows that a task handles together, shingles of texts and set hashes that it remembers.
AT_ONCE, REMEMBERED, SEEN = 512, 2_000_000, 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> np.ndarray:
    """A 64-bit number for each word of a text; bytes are split at just the white space that separates words."""
    words = lowered_bytes(text or "").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def runs(words: np.ndarray) -> np.ndarray:
    """Hashes of a text's runs of words, in order; a text of fewer words than WIDTH is one run."""
    k = min(WIDTH, len(words))
    x = np.full(max(0, len(words) - k + 1) if k else 0, k, np.uint64)
    for j in range(k):
        x = _mixed(x + words[j : j + len(x)])
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers, sorted."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def cells(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(CELLS - 1)
    return (shingles & mask).view(np.int64), ((shingles >> np.uint64(32)) & mask).view(np.int64)


def _runs_of(texts: list[str]) -> np.ndarray:
    return np.concatenate([runs(words_of(t)) for t in texts])


def _count_task(of: Callable[[list[str]], np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, CELLS), np.int64)
        for rows in batches:
            for block in blocks("" if t is None else t for t in rows["text"]):
                found = of(block)
                for row, cell in zip(total, cells(found), strict=True):
                    row += np.bincount(cell, minlength=CELLS)
        parts = total.reshape(-1, TOGETHER)
        used = np.flatnonzero(parts.any(axis=1))
        if len(used):
            yield pd.DataFrame({"part": used, "counts": list(parts[used])})

    return run


def frequencies(docs: DataFrame, of: Callable[[list[str]], np.ndarray] = _runs_of) -> np.ndarray:
    """Two rows of CELLS counters of shingles (what ``of`` finds in texts) over all texts, on a scale of 16 bits."""
    counted = docs.select("text").mapInPandas(_count_task(of), "part int, counts array<long>")
    summed = counted.groupBy("part").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(TOGETHER)]).alias("counts"))
    rows = summed.toPandas()  # a fixed number: 2 * CELLS / TOGETHER
    total = np.zeros((2 * CELLS // TOGETHER, TOGETHER))
    if len(rows):
        total[rows["part"].to_numpy()] = np.array(rows["counts"].tolist(), float)
    return np.minimum(256 * np.log2(total + 1), 65_535).astype(np.uint16).reshape(2, CELLS)


@functools.cache
def class_starts() -> np.ndarray:
    """The least size of each class; sets that link are of one class or of two in a row."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 100 // PERCENT + 1)
    return np.array(starts, np.int64)


def needed(a: int, b: int) -> int:
    """The least intersection of linked sets of a and b shingles."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def entries(shingles: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of index lists that a set (sorted hashes) enters, and at which position."""
    n = len(shingles)
    one, other = cells(shingles)
    ordered = shingles[np.argsort(np.minimum(table[0, one], table[1, other]), kind="stable")]
    own = int(np.searchsorted(class_starts(), n, side="right")) - 1
    larger = int(class_starts()[own + 1])
    reach = [n - needed(n, -(-PERCENT * n // 100)) + 1, n - needed(n, larger) + 1 if larger * PERCENT <= 100 * n else 0]
    keys = [_mixed(ordered[:m] + np.uint64((own + k + 1) * int(MIX) % (1 << 64))) for k, m in enumerate(reach)]
    return np.concatenate(keys).view(np.int64), np.concatenate([np.arange(m, dtype=np.int32) for m in reach])


def parities(shingles: np.ndarray) -> bytes:
    """The parity of the number of shingles in each bit; at least two bits a shingle, a power of two of them."""
    m = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    at = ((shingles >> np.uint64(20)) & np.uint64(m - 1)).view(np.int64)
    return np.packbits((np.bincount(at, minlength=m) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The parities in fewer bits, as 64-bit words."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _set_id(shingles: np.ndarray) -> int:
    """A number for the set: the sum of its shingles, mixed again, and its size."""
    return int(_mixed(np.array([_mixed(shingles * MIX).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def _index_task(table: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for rows in batches:
            size, number, bits, keys, places = [], [], [], [], []
            for text in rows["text"]:
                shingles = distinct(runs(words_of(text)))
                n = len(shingles)
                x = _set_id(shingles) if n else None
                size.append(n)
                number.append(x)
                if n and x not in seen:  # copies in one task enter the lists once
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(x)
                    (key, place), bit = entries(shingles, table), parities(shingles)
                else:
                    key, place, bit = None, None, None
                bits.append(bit)
                keys.append(key)
                places.append(place)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "text_key": rows["text_key"], "n": np.array(size, np.int64), "id": pd.array(number, "Int64"), "bits": pd.Series(bits, dtype="object"), "keys": pd.Series(keys, dtype="object"), "places": pd.Series(places, dtype="object")})

    return run


@F.pandas_udf(T.BooleanType())
def _may_link(na: pd.Series, nb: pd.Series, one: pd.Series, other: pd.Series) -> pd.Series:
    """Whether the parities leave it open that two sets link."""
    least = [int(np.bitwise_count(folded(x, m := min(len(x), len(y))) ^ folded(y, m)).sum()) for x, y in zip(one, other, strict=True)]
    return (100 - PERCENT) * (na + nb) >= (100 + PERCENT) * np.array(least, np.int64)


DIFFERENCE = T.StructType([T.StructField("differ", T.LongType()), T.StructField("diff", T.ArrayType(T.LongType()))])


@F.pandas_udf(DIFFERENCE)
def _compared(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The number of shingles in only one of two texts' sets, and these if asked for."""
    known, size = {}, 0
    for one, other, keep in batches:
        out = []
        for a, b, wanted in zip(one, other, keep, strict=True):
            for t in (a, b):  # a leader is in many pairs
                if t not in known:
                    if size > REMEMBERED:
                        known, size = {}, 0
                    known[t] = distinct(runs(words_of(t)))
                    size += len(known[t])
            x, y = (known[t] if t in known else distinct(runs(words_of(t))) for t in (a, b))
            apart = np.setxor1d(x, y, assume_unique=True)
            out.append((len(apart), apart.view(np.int64) if wanted else None))
        differ, diff = zip(*out, strict=True) if out else ((), ())
        yield pd.DataFrame({"differ": np.array(differ, np.int64), "diff": pd.Series(diff, dtype="object")})


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4_096) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right`` (distinct numbers each)."""
    sizes = [len(d) for d in left + right]
    found, at, times = np.unique(np.concatenate([*left, *right]) if sum(sizes) else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    column = np.full(len(found), -1)
    column[times > 1] = np.arange((times > 1).sum())
    at, row = column[at], np.repeat(np.arange(len(sizes)), sizes)
    row, at = row[at >= 0], at[at >= 0]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int((times > 1).sum()), columns):
        here = (at >= first) & (at < first + columns)
        holds = np.zeros((len(sizes), columns), np.float32)
        holds[row[here], at[here] - first] = 1
        out += holds[: len(left)] @ holds[len(left) :].T
    return out.astype(np.int64)


def joining(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs of numbers, enough to hold together all that they hold together."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _close_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members of two blocks that the parities leave a partner of another component."""
    for rows in whole_groups(batches, ["a", "left", "right"], AT_ONCE):
        out = []
        for (a, left, right), group in rows.groupby(["a", "left", "right"], sort=False):
            own, b, n, comp = (group[c].to_numpy() for c in ("block", "b", "n", "comp"))
            bits = group["bits"].tolist()
            size = min(map(len, bits))
            words = np.stack([folded(x, size) for x in bits])
            one, other = np.flatnonzero(own == left), np.flatnonzero(own == right)
            near = np.zeros(len(group), bool)
            for i in one:
                differ = np.bitwise_count(words[other] ^ words[i]).sum(axis=1, dtype=np.int64)
                open_ = ((100 - PERCENT) * (n[other] + n[i]) >= (100 + PERCENT) * differ) & (comp[other] != comp[i])
                near[i] |= open_.any()
                near[other[open_]] = True
            out += [(a, x) for x in b[near].tolist()]
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _block_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between the components of two blocks of a leader's members, from their differences alone."""
    for rows in whole_groups(batches, ["a", "left", "right"], AT_ONCE):
        out = []
        for (_, left, right), group in rows.groupby(["a", "left", "right"], sort=False):
            own = group["block"].to_numpy()
            one, other = np.flatnonzero(own == left), np.flatnonzero(own == right)
            comp, slack = group["comp"].to_numpy(), ((100 - PERCENT) * group["n"] - (100 + PERCENT) * group["differ"]).to_numpy()
            diff = group["diff"].tolist()
            both = shared_counts([diff[i] for i in one], [diff[j] for j in other])
            link = (slack[one][:, None] + slack[other][None] + 2 * (100 + PERCENT) * both >= 0) & (comp[one][:, None] != comp[other][None])
            i, j = np.nonzero(link)
            pairs = np.stack([comp[one][i], comp[other][j]], axis=1)
            out += joining(np.unique(pairs, axis=0)) if len(pairs) else []
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _in_blocks(members: DataFrame) -> DataFrame:
    """``members`` (a, b, comp, ...) of leaders whose members are in several components, with left, right and block.

    Each outsider (not of the leader's most frequent component) meets every member: blocks are
    numbered with those of the outsiders first, and a member goes to each pair of blocks it is in.
    """
    sizes = members.groupBy("a", "comp").agg(F.count("*").alias("size"))
    one = sizes.groupBy("a").agg(F.sum("size").alias("all"), F.max(F.struct("size", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    blocks_of = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    one = staged(one.select("a", F.col("main.comp").alias("main"), blocks_of(F.col("all") - F.col("main.size")).alias("outside"), blocks_of(F.col("main.size")).alias("inside")), "leaders")
    rows = members.join(one, "a")
    is_main = F.col("comp") == F.col("main")
    dealt = F.xxhash64(F.lit("block"), "b")
    rows = rows.withColumn("block", F.when(is_main, F.col("outside") + F.pmod(dealt, F.col("inside"))).otherwise(F.pmod(dealt, F.col("outside"))).cast("int"))
    last = F.when(is_main, F.col("outside")).otherwise(F.col("outside") + F.col("inside")) - 1
    meets = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(F.least("block", j).alias("left"), F.greatest("block", j).alias("right")))
    rows = rows.select(*members.columns, "block", F.explode(meets).alias("m")).select("*", "m.left", "m.right").drop("m")
    return spread(rows, "a", "left", "right").sortWithinPartitions("a", "left", "right")


def _with_differences(pairs: DataFrame, keyed: DataFrame, sets: DataFrame, keep: bool) -> DataFrame:
    """The pairs (a, b, ...) of sets with how much they differ (and in what, if ``keep``); one text stands for each set."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = staged(keyed.join(sets.select("id", "text_key").join(ids, "id"), "text_key").groupBy("id").agg(F.first("text").alias("text")), "texts")
    one, other = (texts.select(F.col("id").alias(c), F.col("text").alias(t)) for c, t in (("a", "one"), ("b", "other")))
    found = pairs.join(other, "b").join(one, "a").select(*pairs.columns, _compared("one", "other", F.lit(keep)).alias("d"))
    found = staged(found.select(*pairs.columns, "d.*"), "differences")
    discard(texts)
    return found


def _with_sets(pairs: DataFrame, sets: DataFrame, ends: str) -> DataFrame:
    """The pairs with size n and parities of the sets at their ``ends``."""
    for end in ends:
        pairs = pairs.join(sets.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"bits_{end}")), end)
    return pairs


def with_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``: the size of its set, and the least id that links reach."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    with scratch(), small_batches(spark):
        table = frequencies(docs)
        signed = keyed.mapInPandas(_index_task(table), f"doc_id {kinds['doc_id']}, text_key binary, n long, id long, bits binary, keys array<long>, places array<int>")
        signed = staged(signed, "sets")
        listed = signed.where("keys IS NOT NULL").select("id", F.explode(F.arrays_zip("keys", "places")).alias("e")).select("e.keys", "e.places", "id")
        leader = F.first("id").over(W.partitionBy("keys").orderBy("places", "id"))
        pairs = staged(listed.select(leader.alias("a"), F.col("id").alias("b")).where("a != b").distinct(), "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = signed.where("bits IS NOT NULL").groupBy("id").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("text_key").alias("text_key"))
        sets = staged(sets.join(ids, "id"), "set-bounds")
        rows = staged(signed.select("doc_id", "n", "id"), "rows", outlives=True)
        discard(signed)

        led = _with_sets(pairs, sets, "ab").where(_may_link("na", "nb", "bits_a", "bits_b")).select("a", "b", "na", "nb")
        found = _with_differences(staged(led, "led"), keyed, sets, keep=False)
        comps = components(found.where(f"{100 - PERCENT} * (na + nb) >= {100 + PERCENT} * differ").select("a", "b"))

        members = _with_sets(pairs, sets, "b").join(renamed(comps, "b", "comp"), "b", "left")
        members = staged(members.select("a", "b", F.col("nb").alias("n"), F.coalesce("comp", "b").alias("comp"), F.col("bits_b").alias("bits")), "members")
        close = staged(_in_blocks(members).mapInPandas(_close_members, "a long, b long").distinct(), "close")
        close = staged(close.join(members.drop("bits"), ["a", "b"]), "close-members")
        further = _in_blocks(_with_differences(close, keyed, sets, keep=True)).mapInPandas(_block_links, "a long, b long")
        comps = merged(comps, staged(further, "links"))

        least = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("least")).join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        least = staged(least, "least")
        whole = least.groupBy("comp").agg(F.min("least").alias("component_id"))
        reached = staged(least.join(whole, "comp").select("id", "component_id"), "reached", outlives=True)
    found = rows.join(reached, "id", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
