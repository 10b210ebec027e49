"""Boolean trigram queries derived from regular expressions.

``trigram_query`` turns a pattern into a query in disjunctive form: a set of
clauses, each a set of trigrams that a text must hold if the pattern matches by
that way.  None means that nothing can be demanded, so every text is scanned.
Trigrams are of ASCII-lower-cased text, which serves patterns of either case.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import product
from re import _constants as C
from re import _parser

import numpy as np

Query = frozenset[frozenset[str]]
#: Characters of a class that is followed one by one.
CLASS = 8
#: Strings followed at once through a sequence; beyond it the run of literals is broken.
FOLLOWED = 64
#: Bytes indexed at once.
PIECE = 1_000_000
#: Clauses kept; a query that would need more demands less instead.
CLAUSES = 64


def _set_chars(items: Sequence) -> set[str] | None:
    """The characters of a class if they are few, else None."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
        if len(out) > CLASS:
            return None
    return out


def _exact(node: tuple) -> set[str] | None:
    """All strings that one node matches, if they are few and known."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        return _set_chars(arg)
    if op is C.SUBPATTERN:
        return _exact_sequence(arg[3])
    if op is C.BRANCH:
        ways = [_exact_sequence(b) for b in arg[1]]
        return None if any(w is None for w in ways) else set().union(*ways)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 2:
        one = _exact_sequence(arg[2])
        return None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
    if op is C.AT:
        return {""}
    return None


def _exact_sequence(nodes: Iterable[tuple]) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _exact(node)
        if more is None or len(out) * len(more) > FOLLOWED:
            return None
        out = {a + b for a in out for b in more}
    return out


def _of_strings(strings: set[str]) -> Query | None:
    """One clause for each string: its trigrams.  A string below three characters demands nothing."""
    clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in clauses or len(clauses) > CLAUSES else frozenset(clauses)


def _both(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return a or b
    joined = frozenset(x | y for x in a for y in b)
    return joined if len(joined) <= CLAUSES else min(a, b, key=len)


def _sequence_query(nodes: Iterable[tuple]) -> Query | None:
    query: Query | None = None
    run = {""}
    for node in nodes:
        more = _exact(node)
        if more is not None and len(run) * len(more) <= FOLLOWED:
            run = {a + b for a in run for b in more}
            continue
        query, run = _both(query, _of_strings(run)), {""}
        op, arg = node
        if more is not None:
            run = more
        elif op is C.SUBPATTERN:
            query = _both(query, _sequence_query(arg[3]))
        elif op is C.BRANCH:
            ways = [_sequence_query(b) for b in arg[1]]
            if all(w is not None for w in ways):
                query = _both(query, frozenset().union(*ways))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            query = _both(query, _sequence_query(arg[2]))
    return _both(query, _of_strings(run))


def trigram_query(pattern: str) -> Query | None:
    """The query of ``pattern``, or None where no trigram is mandatory."""
    query = _sequence_query(_parser.parse(pattern))
    if query is None:
        return None
    # a clause that holds another one demands more than needed
    return frozenset(c for c in query if not any(o < c for o in query))


class SegmentIndex:
    """Inverted index of one segment of texts: the posting lists of the trigrams that queries name.

    One pass over the segment's bytes numbers the trigram at every place; those that
    queries name are posted with the text that the place lies in.
    """

    def __init__(self, texts: Sequence[str], trigrams: Iterable[str]) -> None:
        self.n = len(texts)
        coded = [t.encode("utf-8", "replace").lower() for t in texts]
        self.postings: dict[str, set[int]] = {g: set() for g in trigrams}
        named = {int.from_bytes(g.encode(), "little"): g for g in self.postings if g.isascii()}
        wanted = np.zeros(1 << 16, bool)
        wanted[[_slot(x) for x in named]] = True
        ends = np.cumsum([len(c) for c in coded])
        for start, piece in _pieces(b"".join(coded)):
            code = piece[:-2].astype(np.uint32) | piece[1:-1].astype(np.uint32) << np.uint32(8) | piece[2:].astype(np.uint32) << np.uint32(16)
            at = np.flatnonzero(wanted[_slot(code)])
            text = np.searchsorted(ends, start + at, side="right")
            whole = start + at + 3 <= ends[text]  # a trigram does not reach into the next text
            for x, i in set(zip(code[at][whole].tolist(), text[whole].tolist(), strict=True)):
                if x in named:
                    self.postings[named[x]].add(i)

    def candidates(self, query: Query | None) -> Iterable[int]:
        if query is None:
            return range(self.n)
        found: set[int] = set()
        for clause in query:
            lists = sorted((self.postings[g] for g in clause), key=len)
            found |= lists[0].intersection(*lists[1:])
        return sorted(found)


def trigrams_of(queries: Iterable[Query | None]) -> list[str]:
    return sorted({g for q in queries if q is not None for c in q for g in c})


def _slot(code):
    """Sixteen bits of a trigram's number."""
    return (code ^ code >> 9) & 0xFFFF


def _pieces(data: bytes) -> Iterable[tuple[int, np.ndarray]]:
    """Arrays of up to PIECE places and where they start; the last two bytes are those of the next one's first trigrams."""
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, max(0, len(whole) - 2), PIECE):
        yield start, whole[start : start + PIECE + 2]
