"""Near duplicates by Order MinHash, verified by banded alignment.

A text is its words in lower case; its k-mers are runs of five words, labelled
by their occurrence, so a repeated k-mer counts each time.  Each of ``SKETCHES``
hash functions keeps the ``ORDER`` labelled k-mers of least hash, in the order of
the text, so that texts agree on a sketch the likelier the closer they are in
edits.  Texts that agree on a sketch are in one bucket; a pair of texts is a link if a
banded alignment of their words finds an edit similarity (one less the edit
distance over the longer text's words) of at least ``SIMILARITY``.

With a share J of k-mers in common, texts share a bucket with a chance of
1 - (1 - J^2)^120: certain at the share 0.8; for edits at random places, J is
s^5 / (2 - s^5) at an edit similarity s, which makes 0.991 at s = 0.8 and 0.9999 at 0.85.

Short texts hold too few k-mers for that, so they have further buckets: texts of up to
``ONE_EDIT`` words, between which one edit is allowed, meet in what is left of them
without any one word; texts of up to ``SHORT`` words meet in every run of three
words, of which the edits allowed leave at least one.

No bucket is expanded into its pairs, whatever its size:

1. each text is compared with one text, of the centres of its buckets the one it shares
   most buckets with (a bucket's centre is its text with the most company);
2. texts and centres of their other buckets are compared where classes differ;
3. a bucket that still holds texts outside its centre's class gets a second centre,
   the one of those with the most company, which is compared with every text of another class.

So these pairs are at most texts times buckets of a text, at any size of any group.

What sketches and centres leave out is found by an exact search, so classes are those of all links:

4. a text's runs of three words are ordered by how often they occur, rarest first (an order
   for all texts, by levels of exact counts, scattered within a level); its ``beginning`` is so many of them that no edits of a link touch them all.
   Two texts that are links share a run of both beginnings: else the beginning that ends first
   would be without a run in the other text, so edits would have touched all of it.
   Runs that only one class holds are dropped.  Texts of other classes that share a run are
   compared if their lengths, the run's places and the parities of their words allow a link;
5. texts of which a run is held by more than ``CROWD`` rows meet by words instead: links have all but a fifth of the longer
   text's words in common, so they share one of the ``rare_words`` of both, a fifth of each text's and one more.
   Blocks of ``BLOCK`` texts of a word meet inside a task, which hands on only pairs that lengths and parities leave, each once.

Texts are fetched only of pairs that parities leave open, in every step.  Pairs of step 4 grow with the texts, ``CROWD`` a run at
most.  In step 5, work inside the tasks grows with the square of the texts of crowds that share a rare word, and pairs handed on
with those that have all but about a fifth of their words in common and yet are of different classes; no task holds more than two blocks.

Texts that are null or hold no word are in a class with equal texts only; a null
text equals the empty one.  Whole texts of any length are compared.  Rows without an id are classed by
their text; a class of such rows alone has a null id.  Repeated rows are copies.  An id that repeats with
other texts ties no classes together.  Ties between centres go to one text, always the same in a run.
An empty table gives an empty result.  Extra columns play no part in classes, whatever their names, and
pass through ``deduplicated``.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefero.llm.common import BROADCAST_BYTES, discard, measured_bytes, scratch, short_shuffles, small_batches, small_side, spread, staged, unused
from prefero.llm.linking import components, merged, renamed, whole_groups
from prefero.llm.shingle_join import cells, folded, frequencies

#: Bytes of words, A-Z in lower case; all other ASCII is a space.
LETTERS = bytes(c if c > 0x7F else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))
K, ORDER, SKETCHES, SIMILARITY = 5, 2, 120, 0.8
#: Words up to which one edit is allowed; words up to which texts meet in every run of RUN words.
ONE_EDIT, SHORT, RUN = 9, 42, 3
#: Texts of a run that meet in one block; rows of a run beyond which its texts meet by their rare words instead.
BLOCK, CROWD = 256, 64
#: Rows of blocks that a task brings together at once.
AT_MEETING = 512
#: Times of a run in all texts beyond which it is of the next level; cells of runs that share a level, and segments of cells that are counted together.
LEVELS, LEVEL_BITS, SEGMENT_BITS = tuple(4 << k for k in range(15)), 24, 12
#: Packed rows of a task that cross the network as one lot, lots of runs dealt to one task, and rows that a task unpacks before it hands on those of crowds.
PACKED, LOTS, UNPACKED = 1 << 19, 8, 1 << 22
#: Numbers hashed at once, so few that a core's cache holds them; rows of texts handed on at once, and words of texts that a task remembers.
HASHED, AT_ONCE, REMEMBERED = 1 << 16, 1 << 18, 1_000_000
#: Words up to which texts are aligned by bits.
IN_BITS = 4096
#: Odd multipliers of the hash functions, two for each, drawn from a fixed seed.
MULTIPLIERS = np.random.default_rng(77).integers(1, 1 << 31, (2, SKETCHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
MIX, LEAST_OUT = np.uint64(0x9E3779B97F4A7C15), np.uint32(0xFFFFFFFF)
#: Bytes of a text whose words are numbered at once, and of the longest word numbered by eights; what is kept of eight bytes.
PIECE, LONG = 1 << 17, 1 << 10
#: Bytes of texts whose words are numbered together.
TOGETHER = 1 << 16
KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class WordNumbers:
    """The 64-bit numbers of words: of eight bytes after eight; of words beyond LONG bytes a digest."""

    def of(self, text: str | None) -> np.ndarray:
        return self._of(_letters(text))

    def together(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The numbers of the words of several texts after one another, and where each text's begin, with the end of the last.

        Texts come in lots of about TOGETHER bytes, so that a short text does not pay for each array by itself.
        """
        held, size = [], 0
        for data in map(_letters, texts):
            if held and size + len(data) > TOGETHER:
                yield self._lot(held)
                held, size = [], 0
            held.append(data)
            size += len(data) + 1
        if held:
            yield self._lot(held)

    def _lot(self, held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(held) == 1:
            words = self._of(held[0])
            return words, np.array([0, len(words)])
        first, words = self._piece(b" ".join(held))
        sizes = np.array([len(data) + 1 for data in held])
        return words, np.append(0, np.searchsorted(first, np.cumsum(sizes)))

    def _of(self, data: bytes) -> np.ndarray:
        out, start = [np.zeros(0, np.uint64)], 0
        while start < len(data):  # pieces that end between words
            end = data.rfind(b" ", start, start + PIECE) if start + PIECE < len(data) else len(data)
            end = end if end > start else data.find(b" ", start + PIECE)
            end = end if end >= 0 else len(data)
            out.append(self._piece(data[start:end])[1])
            start = end + 1
        return np.concatenate(out)

    def _piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin, and their numbers."""
        inside = np.frombuffer(b" " + data + b" ", np.uint8) != 0x20
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, size = edges[::2], edges[1::2] - edges[::2]
        eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # the bytes from each place on
        x = _mixed((eight[first] & KEPT[np.minimum(size, 8)]) + size.view(np.uint64))
        long, at, k = np.flatnonzero(size > LONG), np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(at):
            x[at] = _mixed(x[at] + (eight[first[at] + k] & KEPT[np.minimum(size[at] - k, 8)]))
            k += 8
            at = at[size[at] > k]
        for i in long.tolist():
            x[i] = int.from_bytes(hashlib.blake2b(data[first[i] : first[i] + size[i]], digest_size=8).digest(), "little")
        return first, x


def _letters(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(LETTERS)


def _mixed(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(31)
    y ^= x
    y *= MIX
    y ^= y >> np.uint64(29)
    return y


def runs_of(words: np.ndarray, k: int) -> np.ndarray:
    """A number for the k words from each place on."""
    x = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        x = _mixed(x + words[j : j + len(x)])
    return x


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Numbers of the k-mers with their occurrence; a text of fewer words is one k-mer."""
    if not len(words):
        return words
    return _labelled(runs_of(words, min(k, len(words))))


def _labelled(x: np.ndarray) -> np.ndarray:
    """Numbers with their occurrence."""
    ordered = np.sort(x)
    if not (ordered[1:] == ordered[:-1]).any():
        return x
    order = np.argsort(x, kind="stable")
    out = np.empty_like(x)
    out[order] = _labelled_in_order(ordered)
    return out


def _labelled_in_order(x: np.ndarray) -> np.ndarray:
    """Sorted numbers with their occurrence."""
    at = np.flatnonzero(x[1:] == x[:-1]) + 1
    if len(at):
        k = np.arange(len(at))
        second = np.append(True, at[1:] != at[:-1] + 1)
        label = k - np.maximum.accumulate(np.where(second, k, 0)) + 1
        x[at] = _mixed(x[at] + label.astype(np.uint64) * MIX)
    return x


def labelled_words(words: np.ndarray) -> np.ndarray:
    """``labelled_kmers`` of one word, in any order."""
    return _labelled_in_order(np.sort(_mixed(words)))


def sketches(words: np.ndarray) -> np.ndarray:
    """One number for each hash function: the kept k-mers in the order of the text."""
    return sketches_of(labelled_kmers(words))


def sketches_of(kmers: np.ndarray) -> np.ndarray:
    if not len(kmers):
        return np.zeros(0, np.int64)
    kept = min(ORDER, len(kmers))
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    out = np.arange(SKETCHES, dtype=np.uint64)
    step = max(1, HASHED // len(kmers))
    for a in range(0, SKETCHES, step):
        hashed = short * MULTIPLIERS[0, a : a + step]
        hashed ^= hashed >> np.uint32(15)
        hashed *= MULTIPLIERS[1, a : a + step]
        at = np.empty((len(hashed), kept), np.int64)
        for j in range(kept):  # the least, then the least of the rest
            at[:, j] = hashed.argmin(axis=1)
            hashed[np.arange(len(hashed)), at[:, j]] = LEAST_OUT
        at.sort(axis=1)
        for j in range(kept):
            out[a : a + step] = _mixed(out[a : a + step] + kmers[at[:, j]])
    return out.view(np.int64)


def _one_edit(words: np.ndarray) -> np.ndarray:
    """Numbers of what is left of a short text without any one word, if an edit of it may be a link."""
    n, keys = len(words), [np.zeros(0, np.uint64)]
    if n <= ONE_EDIT and int(n * (1 - SIMILARITY) + 1e-9):
        for i in range(n):
            left = labelled_kmers(np.delete(words, i), n)[:1]
            keys += [_mixed(left + np.uint64(n - 1)), _mixed(left + np.uint64(n << 8 | i))]  # what is left; what is left around place i
    return np.concatenate(keys)


def _whole(words: np.ndarray) -> np.ndarray:
    """The number of what is left of those that become this text by losing a word."""
    n = len(words)
    return _mixed(labelled_kmers(words, n)[:1] + np.uint64(n))


def short_keys(words: np.ndarray) -> np.ndarray:
    """Numbers of the buckets that a text of up to SHORT words is in besides; none for longer texts."""
    n = len(words)
    if not 0 < n <= SHORT:
        return np.zeros(0, np.int64)
    keys = [_one_edit(words)]
    if int((ONE_EDIT + 1) * SIMILARITY) <= n:  # may be a link of a text of more words than ONE_EDIT
        keys.append(labelled_kmers(words, RUN))
    return np.unique(np.concatenate(keys)).view(np.int64)


def own_key(words: np.ndarray) -> int | None:
    """The bucket of those that become this short text by losing a word; the text is its centre."""
    n = len(words)
    return int(_whole(words).view(np.int64)[0]) if 0 < n < ONE_EDIT else None


@functools.cache
def _numbers() -> WordNumbers:
    """The numbers of words that a process remembers."""
    return WordNumbers()


def word_runs(words: np.ndarray) -> np.ndarray:
    """A number for the RUN words from each place on."""
    return runs_of(words, RUN)


def _word_runs_of(texts: list[str]) -> np.ndarray:
    found = []
    for words, starts in _numbers().together(texts):
        x = word_runs(words)
        inside = np.ones(len(words), bool)
        for j in range(1, RUN):  # the last places of a text, from which a run would go on into the next
            inside[np.maximum(starts[1:] - j, 0)[starts[1:] > 0]] = False
        found.append(x[inside[: len(x)]])
    return np.concatenate(found)


def _labelled_words_of(texts: list[str]) -> np.ndarray:
    return np.concatenate([labelled_words(_numbers().of(t)) for t in texts])


def edits_to_touch(places: np.ndarray) -> int:
    """The least cost of edits that touch the runs at all of ``places`` (rising).

    A word deleted or replaced touches runs at RUN places in a row and costs 5; a word put in touches
    one less and costs 4, since it makes the longer text longer.  Of a link, edits cost at most the text's words: with
    d edits, 5 d is at most the longer text's words, which are the text's own and at most the words put in.
    """
    one = two = three = 0  # the costs from the next place on, from that after it and from the third
    after = RUN
    for gap in [*np.diff(places).tolist(), RUN][::-1] if len(places) else ():
        if gap == 1:
            cost = 4 + two if after > 1 or two <= three + 1 else 5 + three
        elif gap == 2:
            cost = 4 + one if one <= two + 1 else 5 + two
        else:
            cost = 4 + one
        one, two, three, after = cost, one, two, gap
    return one


def by_rarity(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Numbers anew, whose order is the one for all texts: how often the number occurs in 16 bits, then the number's upper bits."""
    one, other = cells(x)
    return np.minimum(table[0, one], table[1, other]).astype(np.uint64) << np.uint64(48) | x >> np.uint64(16)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of unsigned numbers, byte by byte of all, so that those that are nearly always alike compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def _counted_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows segment, runs, times of a batch's runs (their upper 48 bits): each once, sorted, as the steps between them."""
    for rows in batches:
        x, times = np.unique(_word_runs_of(rows["text"]) >> np.uint64(16), return_counts=True)
        at = np.flatnonzero(np.diff(x >> np.uint64(48 - SEGMENT_BITS), prepend=np.uint64(1 << 63)))
        runs = [_planes(np.diff(part, prepend=np.uint64(0)), 6) for part in np.split(x, at[1:])] if len(at) else []
        times = [_planes(part, 4) for part in np.split(times, at[1:])] if len(at) else []
        yield pd.DataFrame({"segment": (x[at] >> np.uint64(48 - SEGMENT_BITS)).astype(np.int32), "runs": pd.Series(runs, dtype="object"), "times": pd.Series(times, dtype="object")})


def _levels_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The levels of a segment's cells, of the most frequent run of each."""
    for rows in whole_groups(batches, ["segment"], 1):
        for segment, own in rows.groupby("segment", sort=False):
            x, times = (np.concatenate(parts) for parts in ([np.cumsum(_from_planes(r, 6), dtype=np.uint64) for r in own["runs"]], [_from_planes(t, 4) for t in own["times"]]))
            order = np.argsort(x)
            x, times = x[order], times[order]
            first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            level = np.searchsorted(LEVELS, np.add.reduceat(times, first).astype(np.int64)).astype(np.uint8)
            cell = (x[first] >> np.uint64(48 - LEVEL_BITS)).astype(np.int64) & (1 << LEVEL_BITS - SEGMENT_BITS) - 1
            cells_ = np.zeros(1 << LEVEL_BITS - SEGMENT_BITS, np.uint8)
            np.maximum.at(cells_, cell[level > 0], level[level > 0])
            yield pd.DataFrame({"segment": [segment], "levels": [(cells_[::2] | cells_[1::2] << np.uint8(4)).tobytes()]})


def run_levels(docs: DataFrame) -> np.ndarray:
    """Four bits for each cell of runs: the level of how often the cell's most frequent run occurs in all texts, counted whole; a table of one size for any input."""
    counted = spread(docs.select("text").mapInPandas(_counted_runs, "segment int, runs binary, times binary"), "segment").sortWithinPartitions("segment")
    out = np.zeros((1 << SEGMENT_BITS, 1 << LEVEL_BITS - SEGMENT_BITS - 1), np.uint8)
    for segment, levels in counted.mapInPandas(_levels_of, "segment int, levels binary").collect():
        out[segment] = np.frombuffer(levels, np.uint8)
    return out.reshape(-1)


def by_level(x: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Numbers anew, whose order is the one for all texts: the level of the number's cell in four bits, then the number's upper bits."""
    cell = (x >> np.uint64(64 - LEVEL_BITS)).view(np.int64)
    level = levels[cell >> 1] >> (cell & 1).astype(np.uint8) * np.uint8(4) & np.uint8(15)
    return level.astype(np.uint64) << np.uint64(60) | _mixed(x) >> np.uint64(4)


def _placed(words: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``beginning``, of runs ``x`` by rarity, and the place of each in the text; -1 of those at several places or none."""
    n, keys = len(words), np.zeros(0, np.uint64)
    if n <= ONE_EDIT:
        keys = np.concatenate([_one_edit(words), _whole(words)])
    places = np.full(len(keys), -1)
    if len(x):
        order = np.argsort(x)
        ordered, m = x[order], min(len(x), 2 * n // 5 + 1)
        while m < len(x):
            if ordered[m] == ordered[m - 1]:
                m += 1
            elif (cost := edits_to_touch(np.sort(order[:m]))) <= n:
                m += min(len(x) - m, max(1, n // 32, (n - cost) // 2))
            else:
                break
        found, at, other = ordered[:m], order[:m], ordered[1:m] != ordered[: m - 1]
        if not other.all():
            once = np.append(True, other) & np.append(other, True)
            found, at = found[keep := np.append(True, other)], np.where(once, at, -1)[keep]
        keys, places = np.concatenate([keys, found]), np.concatenate([places, at])
    return keys.view(np.int64), places


def beginning(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Numbers, one at least of which a text shares with each of its links: the rarest runs of a text, or of short ones the buckets of one edit."""
    return np.unique(_placed(words, by_rarity(word_runs(words), table))[0])


def _all_placed(levels: np.ndarray) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """``_placed`` of each text of a lot."""

    def of(words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x = by_level(word_runs(words), levels)
        for start, end in itertools.pairwise(starts.tolist()):
            yield _placed(words[start:end], x[start : max(start, end - RUN + 1)])

    return of


def rare_words(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Labelled words, rarest first, of which a text shares one with each of its links: those have all but a fifth of the longer text's words in common."""
    return np.sort(by_rarity(labelled_words(words), table))[: int(len(words) * (1 - SIMILARITY) + 1e-9) + 1].view(np.int64)


def _all_rare(table: np.ndarray) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """``rare_words`` of each text of a lot, without places."""

    def of(words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start, end in itertools.pairwise(starts.tolist()):
            found = rare_words(words[start:end], table)
            yield found, np.full(len(found), -1)

    return of


def word_parities(words: np.ndarray, bits: int = 2) -> bytes:
    """The parity of the number of labelled words (so repeats do not cancel out) in each bit; at least so many bits a word, a power of two of them."""
    m = max(64, 1 << int(bits * len(words) - 1).bit_length())
    at = ((labelled_words(words) >> np.uint64(20)) & np.uint64(m - 1)).view(np.int64)
    return np.packbits((np.bincount(at, minlength=m) & 1).astype(np.uint8)).tobytes()


def _run_alike(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """Words alike from a[i], b[j] on."""
    n, size = 0, 16
    while (m := min(size, len(a) - i - n, len(b) - j - n)) > 0:
        differ = a[i + n : i + n + m] != b[j + n : j + n + m]
        if differ.any():
            return n + int(np.argmax(differ))
        n, size = n + m, size * 4
    return n


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Words to insert, delete or replace to make b of a; None beyond ``most``.

    What is alike at both ends costs nothing.  What is left of up to IN_BITS words is aligned with a column of
    the table of distances as the bits of two integers (Myers), longer by diagonals.
    """
    start = _run_alike(a, b, 0, 0)
    a, b = a[start:], b[start:]
    end = _run_alike(a[::-1], b[::-1], 0, 0)
    a, b = a[: len(a) - end], b[: len(b) - end]
    if abs(len(a) - len(b)) > most:
        return None
    if not len(a) or not len(b):
        return max(len(a), len(b))
    return _by_bits(a.tolist(), b.tolist(), most) if len(a) <= IN_BITS else _by_diagonals(a, b, most)


def _by_bits(a: list[int], b: list[int], most: int) -> int | None:
    """``edit_distance``; the distances of a column rise by one at the bits of ``up`` and fall at those of ``down``."""
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    whole, top, d = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down, left = whole, 0, len(b)
    for w in b:
        alike = at.get(w, 0)
        same = (((alike & up) + up ^ up | alike) & whole | down) if alike else down
        right_up, right_down = down | (same | up) ^ whole, same & up
        left -= 1
        if right_up & top:
            d += 1
        elif right_down & top:
            d -= 1
        if d - left > most:  # the words to come take one off each
            return None
        right_up = right_up << 1 & whole | 1
        up, down = right_down << 1 & whole | (same | right_up) ^ whole, right_up & same
    return d


def _by_diagonals(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """``edit_distance`` of long texts.

    Follows only the diagonals within ``most`` of the main one: of each, the
    furthest place that every number of edits reaches.
    """
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > most:
        return None
    # far[k + most + 1]: how much of a is aligned on diagonal k (place in b less place in a)
    far = np.full(2 * most + 3, -(n + m + 2), np.int64)
    zero = most + 1
    far[zero] = _run_alike(a, b, 0, 0)
    for d in range(most + 1):
        if far[goal + zero] >= n:
            return d
        lo, hi = max(-(d + 1), goal - most, -most), min(d + 1, goal + most, most)
        k = np.arange(lo, hi + 1)
        at = k + zero
        new = np.maximum(np.maximum(far[at] + 1, far[at - 1]), far[at + 1] + 1)
        new = np.minimum(new, np.minimum(n, m - k))
        live = np.flatnonzero((new >= 0) & (new < n) & (new + k >= 0) & (new + k < m))
        live = live[a[new[live]] == b[new[live] + k[live]]]
        for x in live.tolist():
            new[x] += _run_alike(a, b, int(new[x]), int(new[x] + k[x]))
        far[at] = new
    return None


def _in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two multisets of numbers."""
    # of a number in both, its times in the one come first, so each of those finds its like in the other as long as that has some
    a, b = np.sort(a), np.sort(b)
    times = np.arange(len(a)) - np.searchsorted(a, a)
    at = np.searchsorted(b, a) + times
    return int((b[at[at < len(b)]] == a[at < len(b)]).sum())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Edit similarity of two texts' words; 0 if below SIMILARITY."""
    longer = max(len(a), len(b))
    most = int(longer * (1 - SIMILARITY) + 1e-9)
    if not longer or abs(len(a) - len(b)) > most:
        return 0.0
    words, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    replaced = int((x != y).sum()) if len(x) == len(y) else longer + 1
    # an edit takes at most n runs of n words from either text
    for n in (1, 2, 3):
        if longer >= n:
            run = lambda z: sum(z[j : len(z) - n + 1 + j] * len(words) ** (n - 1 - j) for j in range(n)) if n > 1 else z  # noqa: B023, E731
            if (lost := longer - n + 1 - _in_common(run(x), run(y))) > n * most:
                return 0.0
            if replaced * n <= lost:  # no fewer edits than the words replaced in place
                return 1 - replaced / longer
    d = edit_distance(x, y, most)
    return 0.0 if d is None else 1 - d / longer


#: What a task computes of a text.
SIGNATURE = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("short", T.ArrayType(T.LongType())), T.StructField("own", T.LongType()), T.StructField("bits", T.BinaryType())])


@F.arrow_udf(SIGNATURE)
def _signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Words, sketches (none if every link of the text is a short text), the further buckets of short texts, and the words' parities."""
    numbers, none = _numbers(), np.zeros(0, np.uint64)

    def signed(texts: list[str | None]) -> Iterator[tuple]:
        for words, starts in numbers.together(texts):  # of few texts at a time, so a batch's words are never held together
            kmers = runs_of(words, K)
            for start, end in itertools.pairwise(starts.tolist()):
                own = words[start:end]
                bands = sketches_of(_labelled(kmers[start : end - K + 1]) if end - start >= int((SHORT + 1) * SIMILARITY) else none)
                yield end - start, bands, short_keys(own), own_key(own), word_parities(own)

    def lists(of: tuple[np.ndarray, ...]) -> pa.Array:
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, of)], dtype=np.int32), np.concatenate(of))

    for texts in batches:
        n, bands, short, own, bits = zip(*signed(texts.to_pylist()), strict=True) if len(texts) else ((), (none.view(np.int64),), (none.view(np.int64),), (), ())
        columns = [pa.array(n, pa.int32()), lists(bands)[: len(n)], lists(short)[: len(n)], pa.array(own, pa.int64()), pa.array(bits, pa.binary())]
        yield pa.StructArray.from_arrays(columns, SIGNATURE.names)


def _rows_of(of: Callable[[np.ndarray, np.ndarray], Iterable[tuple[np.ndarray, np.ndarray]]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows run, id, n, place of each text, by the numbers and places that ``of`` finds in the words of each of a lot."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids, ns, runs, places, done = rows["id"].to_numpy(), [], [], [], 0
            for words, starts in _numbers().together(rows["text"]):
                ns.append(np.diff(starts))
                for run, place in of(words, starts):
                    runs.append(run)
                    places.append(place)
                if sum(map(len, runs)) > AT_ONCE or done + len(runs) == len(rows):
                    times = [len(x) for x in runs]
                    yield pd.DataFrame({"run": np.concatenate(runs), "id": np.repeat(ids[done : done + len(runs)], times), "n": np.repeat(np.concatenate(ns).astype(np.int32), times), "place": np.concatenate(places).astype(np.int32)})
                    done += len(runs)
                    ns, runs, places = [], [], []

    return task


ROWS = "run long, id long, n int, place int"
#: Bytes of a packed row's run (its upper ones: runs that agree in these meet, and are told apart by their texts), id, length and place.
WIDTHS, DROPPED = {"run": 6, "id": 8, "n": 4, "place": 4}, np.uint64(16)


def _packed(of: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], lots: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The rows of ``of`` dealt to lots by run, many of a task's as one row: as plain rows each pays for its fixed width, the more the more tasks they are dealt to."""

    def pack(held: list[pd.DataFrame]) -> pd.DataFrame:
        columns = {c: np.concatenate([rows[c].to_numpy() for rows in held]) for c in WIDTHS}
        columns["run"] = columns["run"].view(np.uint64) >> DROPPED
        lot = (_mixed(columns["run"]) % np.uint64(lots)).astype(np.uint16)
        order = np.argsort(lot, kind="stable")
        at = np.flatnonzero(np.diff(lot[order].astype(np.int32), prepend=-1))
        parts = [np.split(x[order].view(f"u{x.itemsize}"), at[1:]) for x in columns.values()]
        data = [b"".join(_planes(x, width) for x, width in zip(own, WIDTHS.values(), strict=True)) for own in zip(*parts, strict=True)]
        return pd.DataFrame({"lot": lot[order][at].astype(np.int32), "data": pd.Series(data, dtype="object")})

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for rows in of(batches):
            held.append(rows)
            n += len(rows)
            if n >= PACKED:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return task


def _unpacked(data: bytes) -> list[np.ndarray]:
    ends = np.cumsum([0, *WIDTHS.values()]) * (len(data) // sum(WIDTHS.values()))
    run, ids, n, place = (_from_planes(data[a:b], width) for (a, b), width in zip(itertools.pairwise(ends.tolist()), WIDTHS.values(), strict=True))
    return [(run << DROPPED).view(np.int64), ids.view(np.int64), n.astype(np.int32), place.astype(np.uint32).view(np.int32)]


def _of_several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of packed rows, sorted by lot, those of runs that several texts hold."""
    crowds: set[int] = set()
    held: list[list[np.ndarray]] = []
    lot, n = None, 0

    def several(last: bool) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        """The rows that go, and if more of the lot are to come, those that stay."""
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.argsort(columns[0])
        columns = [x[order] for x in columns]
        run, ids = columns[:2]
        start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        size = np.diff(np.append(start, len(run)))
        go = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)
        if not last:
            go &= size > CROWD
            crowds.update(run[start[go]].tolist())
        if crowds:
            go |= np.fromiter((r in crowds for r in run[start].tolist()), bool, len(start))
        go = np.repeat(go, size)
        return [x[go] for x in columns], [] if last else [[x[~go] for x in columns]]

    def framed(columns: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        for a in range(0, len(columns[0]), AT_ONCE):
            yield pd.DataFrame({c: x[a : a + AT_ONCE] for c, x in zip(WIDTHS, columns, strict=True)})

    for rows in batches:
        for own, data in zip(rows["lot"].tolist(), rows["data"], strict=True):
            if own != lot and held:
                yield from framed(several(last=True)[0])
                held, n = [], 0
                crowds.clear()
            lot = own
            held.append(_unpacked(data))
            n += len(held[-1][0])
            if n > UNPACKED:
                found, held = several(last=False)
                n = len(held[0][0])
                yield from framed(found)
    if held:
        yield from framed(several(last=True)[0])


@F.pandas_udf(T.DoubleType())
def _aligned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    numbers, known, size = WordNumbers(), {}, 0
    for one, other in batches:
        out = []
        for pair in zip(one, other, strict=True):
            for t in pair:  # a text is often in many pairs
                if t not in known:
                    if size > REMEMBERED:
                        numbers, known, size = WordNumbers(), {}, 0
                    known[t] = numbers.of(t)
                    size += len(known[t])
            out.append(similarity(*(known[t] if t in known else numbers.of(t) for t in pair)))
        yield pd.Series(out, dtype="float64")


def _open(na: np.ndarray, nb: np.ndarray, one: list[bytes], other: list[bytes]) -> np.ndarray:
    """Whether the parities leave it open that two texts are a link: an edit changes two labelled words at most, one if it changes the length."""
    least = [int(np.bitwise_count(folded(x, m := min(len(x), len(y))) ^ folded(y, m)).sum()) for x, y in zip(one, other, strict=True)]
    return np.array(least, np.int64) <= 2 * (np.maximum(na, nb) * (1 - SIMILARITY) + 1e-9).astype(np.int64) - np.abs(na - nb)


@F.pandas_udf(T.BooleanType())
def _may_link(na: pd.Series, nb: pd.Series, one: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series(_open(na.to_numpy(), nb.to_numpy(), one.tolist(), other.tolist()))


@F.pandas_udf(T.BinaryType())
def _parities(texts: pd.Series) -> pd.Series:
    """More bits than a signature holds, for the few texts of crowds."""
    return pd.Series([word_parities(_numbers().of(t), 4) for t in texts], dtype="object")


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs (a, b), a the greater, of two blocks of a word's texts that classes, lengths and parities leave open, each at the first word that both texts share."""
    for rows in whole_groups(batches, ["run", "left", "right"], AT_MEETING):
        run, ids, n, comp, block = (rows[c].to_numpy() for c in ("run", "id", "n", "comp", "block"))
        ends = np.flatnonzero(np.append((rows[["run", "left", "right"]].to_numpy()[1:] != rows[["run", "left", "right"]].to_numpy()[:-1]).any(axis=1), True)) + 1
        within, bits, found = (rows["left"] == rows["right"]).to_numpy(), rows["bits"].tolist(), []
        before = [frozenset(w[w < r].tolist()) for w, r in zip(rows["words"], run.tolist(), strict=True)]
        for start, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            one, other = (x + start for x in np.triu_indices(end - start, 1))
            keep = (comp[one] != comp[other]) & (np.minimum(n[one], n[other]) >= SIMILARITY * np.maximum(n[one], n[other])) & (within[start] | (block[one] != block[other]))
            found += [(i, j) for i, j in zip(one[keep].tolist(), other[keep].tolist(), strict=True) if before[i].isdisjoint(before[j])]
        one, other = np.array(found, np.int64).reshape(-1, 2).T
        near = _open(n[one], n[other], [bits[i] for i in one.tolist()], [bits[j] for j in other.tolist()])
        one, other = ids[one[near]], ids[other[near]]
        yield pd.DataFrame({"a": np.maximum(one, other), "b": np.minimum(one, other)})


def _close(a: str, b: str) -> Column:
    """Texts of so many words may be links."""
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of text numbers whose alignment is close enough, with their similarity."""
    one, other = texts.select(F.col("id").alias("a"), F.col("text").alias("one")), texts.select(F.col("id").alias("b"), F.col("text").alias("other"))
    if measured_bytes(texts) <= BROADCAST_BYTES:  # so the pairs' tasks share the work, not those of a few texts
        one, other = F.broadcast(one), F.broadcast(other)
    else:
        pairs = small_side(pairs)
    found = pairs.join(other, "b").join(one, "a").select("a", "b", _aligned("one", "other").alias("similarity"))
    return staged(found.where(F.col("similarity") >= SIMILARITY), "links")


def _bounded(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b, ...; staged) that lengths and parities leave open, so texts are fetched of these only."""
    found = small_side(pairs)
    for end in "ba":
        found = found.join(signed.select(F.col("id").alias(end), F.col("n").alias(f"_n{end}"), F.col("bits").alias(f"_bits_{end}")), end)
    return found.where(_may_link("_na", "_nb", "_bits_a", "_bits_b")).select(*pairs.columns)


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes differ."""
    of = pairs.join(renamed(comps, "a", "x"), "a", "left").join(renamed(comps, "b", "y"), "b", "left")
    return of.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def buckets(signed: DataFrame) -> DataFrame:
    """band, id, n, own, size: the buckets of more than one text; ``own`` marks a text that is a bucket's centre by its kind."""
    plain = F.transform(F.concat("bands", "short"), lambda x: F.struct(x.alias("band"), F.lit(False).alias("own")))
    by_kind = F.when(F.col("own").isNotNull(), F.array(F.struct(F.col("own").alias("band"), F.lit(True).alias("own")))).otherwise(F.array())
    rows = signed.select("id", "n", F.explode(F.concat(plain, by_kind)).alias("e")).select("e.band", "id", "n", "e.own")
    # the one shuffle of all rows, of a few numbers each; written, so a bucket of very many texts is a skewed join that Spark splits
    return staged(rows.withColumn("size", F.count("*").over(W.partitionBy("band"))).where("size > 1"), "buckets")


def _texts(keyed: DataFrame, signed: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the text numbers ``ids``."""
    wanted = small_side(staged(signed.select("id", "key").join(ids, "id"), "wanted"))
    return staged(keyed.join(wanted, "key").groupBy("key", "id").agg(F.first("text").alias("text")).select("id", "text"), "texts")


def _links_of(pairs: DataFrame, keyed: DataFrame, signed: DataFrame) -> DataFrame:
    """The links among the pairs (a, b; staged), with their similarity."""
    # few bytes, but heavy by the row
    left = staged(spread(_bounded(pairs, signed), "a", "b"), "pairs")
    return _links(left, _texts(keyed, signed, left.select(F.explode(F.array("a", "b")).alias("id")).distinct()))


def _shared(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows (run, id, n, place) of runs that several classes hold, with comp and how many rows hold the run."""
    of = W.partitionBy("run")
    rows = rows.select("*", F.min("id").over(of).alias("one"), F.max("id").over(of).alias("other"), F.count("*").over(of).alias("held")).where("one != other").drop("one", "other")
    rows = rows.join(small_side(comps), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    rows = rows.select("*", F.min("comp").over(of).alias("one"), F.max("comp").over(of).alias("other")).where("one != other")
    return rows.select("run", "id", "n", "place", "comp", "held").distinct()  # copies of a text


def _members(rows: DataFrame) -> DataFrame:
    """run, alone, members of ``_shared`` rows, one row for each run (``alone`` is null); of runs of a crowd one for each text, ``alone``.

    Rows are together by run already, so this shuffles nothing; no list holds more than CROWD rows.
    """
    alone = F.when(F.col("held") > CROWD, F.col("id")).alias("alone")
    return rows.groupBy("run", alone).agg(F.collect_list(F.struct("id", "n", "place", "comp")).alias("members"))


def _meeting(runs: DataFrame) -> DataFrame:
    """The pairs (a, b), a the greater, of texts of different classes among a run's members, where lengths and places allow a link."""
    met = runs.select("members", F.explode("members").alias("x")).select("x", F.explode("members").alias("y"))
    met = met.where("x.id > y.id AND x.comp != y.comp").select(*[F.col(f"{e}.{c}").alias(f"{c}_{side}") for e, side in (("x", "left"), ("y", "right")) for c in ("id", "n", "place")])
    # of a run that no edit touches, edits before it and after it make up for its places
    moved = F.abs(F.expr("place_left - place_right")) + F.abs(F.expr("(n_left - place_left) - (n_right - place_right)"))
    placed = (F.least("place_left", "place_right") < 0) | (moved <= F.floor(F.greatest("n_left", "n_right") * (1 - SIMILARITY) + 1e-9))
    return met.where(_close("n_left", "n_right") & placed).select(F.col("id_left").alias("a"), F.col("id_right").alias("b")).distinct()


def _meeting_in_blocks(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), a the greater, of texts of different classes that share a word, where lengths and parities allow a link."""
    several = staged(rows.groupBy("run").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")).where("blocks > 1"), "run-sizes")
    # each block of a word's texts meets each, so a word of very many texts is the work of many tasks
    dealt = rows.join(small_side(several), "run", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("left"), F.greatest("block", j).alias("right")))
    # a pair is handed on at the first of its words only; texts of more words than these hand on some pairs again
    words = F.slice(F.sort_array(F.collect_list("run")), 1, BLOCK).alias("words")
    of = staged(rows.groupBy("id").agg(words).join(texts.select("id", _parities("text").alias("bits")), "id"), "crowd-words")
    dealt = dealt.select("run", "id", "n", "comp", "block", F.explode(meets).alias("m")).select("run", "m.left", "m.right", "id", "n", "comp", "block").join(small_side(of), "id")
    return spread(dealt, "run", "left", "right").sortWithinPartitions("run", "left", "right").mapInPandas(_met, "a long, b long")


def _sharing(keyed: DataFrame, signed: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b), a the greater, of texts of different classes and like lengths that share a run of their beginnings, and if many share it, a rare word."""
    spark = keyed.sparkSession
    lots = min(1 << 16, LOTS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = keyed.select(F.xxhash64("key").alias("id"), "text").mapInPandas(_packed(_rows_of(_all_placed(run_levels(keyed))), lots), "lot int, data binary")
    # most runs are of one text alone, and go before rows are plain
    rows = staged(spread(packed, "lot").sortWithinPartitions("lot").mapInPandas(_of_several, ROWS), "rows")
    runs = staged(_members(_shared(rows, comps)), "runs")
    discard(rows)
    pairs = _meeting(runs.where("alone IS NULL"))
    crowd = staged(runs.where("alone IS NOT NULL").select(F.col("alone").alias("id")).distinct(), "crowd")
    if crowd.limit(1).count():
        # two texts of a crowd meet by a word that is rare among those of crowds
        texts = _texts(keyed, signed, crowd)
        among = frequencies(texts, _labelled_words_of)
        rows = texts.mapInPandas(_rows_of(_all_rare(among)), ROWS)
        pairs = pairs.union(_meeting_in_blocks(staged(_shared(rows, comps), "runs"), texts))
    return pairs.distinct()


def near_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text numbers (id, key: md5 of the text, n), links (a, b, similarity) and classes (id, comp) of the texts of ``docs``.

    Links are those that the search verified: enough to tie every class together.
    """
    keyed = docs.select(text_key().alias("key"), "text")
    signed = keyed.select("key", _signature("text").alias("s")).groupBy("key").agg(F.first("s").alias("s"))
    signed = staged(signed.where("s.n > 0").select(F.xxhash64("key").alias("id"), "key", "s.*"), "signatures")
    shared = buckets(signed)
    sketched, signed = signed, staged(signed.select("id", "key", "n", "bits"), "texts-signed")
    discard(sketched)
    company = staged(shared.groupBy("id").agg(F.sum("size").alias("company"), F.first("n").alias("n")), "company")

    top = F.max(F.struct("own", "company", "id", "n"))
    centres = staged(shared.join(company.select("id", "company"), "id").groupBy("band").agg(top.alias("c")).select("band", F.col("c.id").alias("a"), F.col("c.n").alias("centre_n")), "centres")
    members = shared.join(centres, "band").where((F.col("id") != F.col("a")) & _close("n", "centre_n"))
    near = staged(members.groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("times")), "near")
    stars = staged(_bounded(near, signed), "stars")
    texts = _texts(keyed, signed, stars.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    best = staged(stars.groupBy("b").agg(F.max(F.struct("times", "a"))["a"].alias("a")).select("a", "b"), "pairs")
    found = _links(best, texts)
    comps = components(found)

    tested = best.unionByName(best.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = staged(_apart(stars.select("a", "b").join(tested, ["a", "b"], "left_anti"), comps), "pairs")
    more = _links(others, texts)
    comps = merged(comps, more)

    classed = shared.select("band", "id", "n").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    classed = classed.join(centres.select("band", "a"), "band").join(renamed(comps, "a", "centre_comp"), "a", "left")
    classed = staged(classed.select("band", "id", "n", "comp", F.coalesce("centre_comp", "a").alias("centre_comp")), "classed-buckets")
    outside = classed.where("comp != centre_comp").join(company.select("id", "company"), "id")
    second = staged(outside.groupBy("band").agg(F.max(F.struct("company", "id", "n", "comp")).alias("o")), "second-centres")
    last = classed.join(second, "band").where((F.col("comp") != F.col("o.comp")) & _close("n", "o.n"))
    last = last.select(F.greatest("id", "o.id").alias("a"), F.least("id", "o.id").alias("b")).distinct()
    done = tested.unionByName(others).unionByName(others.select(F.col("b").alias("a"), F.col("a").alias("b")))
    last = staged(last.join(done, ["a", "b"], "left_anti"), "pairs")
    rest = _links_of(last, keyed, signed)
    comps, links = merged(comps, rest), found.union(more).union(rest)

    for read in (shared, near, centres, stars, classed, second, texts):
        discard(read)
    left = staged(_sharing(keyed, signed, comps).join(done, ["a", "b"], "left_anti"), "pairs")
    missed = _links_of(left, keyed, signed)
    return signed.select("id", "key", "n"), links.union(missed), merged(comps, missed)


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _text_classes(docs: DataFrame) -> DataFrame:
    """key, comp, class_id, class_size, class_texts, n_verified of each different text of ``docs``."""
    numbers, links, comps = near_links(docs)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_verified"))
    classed = numbers.select("id", "key").join(comps, "id").join(degree, "id", "left")
    texts = docs.select("doc_id", text_key().alias("key")).groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    texts = staged(texts.join(classed.select("key", "comp", "n_verified"), "key", "left"), "classed-texts")
    # texts without links are classes of their own; the others' classes are named by their least key
    linked, one = texts.where("comp IS NOT NULL"), F.lit(1).cast("long")
    named = linked.groupBy(F.col("comp").alias("whole")).agg(F.min("key").alias("name"), F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("class_texts"))
    together = linked.join(staged(named, "class-names"), F.col("comp") == F.col("whole")).select("key", F.col("name").alias("comp"), "class_id", "class_size", "class_texts", "n_verified")
    alone = texts.where("comp IS NULL").select("key", F.col("key").alias("comp"), F.col("least").alias("class_id"), F.col("n").alias("class_size"), one.alias("class_texts"), (one * 0).alias("n_verified"))
    return together.unionByName(alone)


def with_classes(docs: DataFrame) -> DataFrame:
    """doc_id, key, comp, class_id, class_size, class_texts, n_verified for each row of ``docs``.

    ``comp``, the key of one of the class's texts, tells classes apart; class_id, its least
    doc_id, labels it, and classes that share that id have one label.  ``class_texts`` are the
    class's different texts; ``n_verified`` the links of the row's text that the search verified,
    which tie the class together and need not be all that exist in it.
    """
    with scratch(), small_batches(docs.sparkSession), short_shuffles(docs.sparkSession):
        texts = staged(_text_classes(docs), "text-classes", outlives=True)
    return docs.select("doc_id", text_key().alias("key")).join(texts, "key").select("doc_id", "key", "comp", "class_id", "class_size", "class_texts", "n_verified")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the least id (rows without id last); of repeated rows, one."""
    mark = unused("_dedup_row", docs)
    rows = docs.withColumn(mark, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", text_key().alias("key")))
    with scratch(), short_shuffles(docs.sparkSession):
        own = staged(with_classes(docs).groupBy("doc_id", "key", "comp").agg(F.count("*").alias("times")), "row-classes")
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
        kept = own.groupBy("comp").agg(F.min(F.struct(order.alias("first"), "times")).alias("of"))
        first = staged(kept.select("of.first", "of.times"), "kept", outlives=True)
    # those kept grow with the documents, so texts are shuffled once at every size
    out = rows.join(first.select("first"), rows[mark].eqNullSafe(F.col("first")), "left_semi")
    if first.where("times > 1").limit(1).count():
        out = out.dropDuplicates([mark])
    return out.drop(mark)
