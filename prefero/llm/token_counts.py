"""Token counts of whole texts under a byte-pair tokenizer.

Whole-token shortcut: which vocabulary strings encode alone as one token is
proved once, before the job, by encoding each; workers get the list.  A text's pre-tokens that are among
them count one without any merging; only the other distinct pre-tokens are
merged, once per worker while they stay in a bounded table.

Texts of Latin letters are split here by the tokenizer's own pattern; any text
with other characters is normalised and split by the library, and one that
holds a special token's opening mark is encoded by the library as a whole.
A null text counts as empty.  Texts without words have no tokens.  Texts of any length are
counted whole, repeated rows each; an empty table gives an empty result; extra columns pass
through, and one named as the result is replaced.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Highest code point that the pattern below covers.
LATIN_END = 0x24F
#: Pre-tokens remembered by a worker before the table starts anew.
REMEMBERED = 500_000
#: Characters of text handled together.
AT_ONCE = 1_000_000


def _latin_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN_END + 1) if unicodedata.category(chr(c))[0] == kind)


def _pre_token_pattern() -> re.Pattern:
    letters, numbers = _latin_class("L"), _latin_class("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")


def _plain(c: str) -> bool:
    """No control or unusual white space, and its lower case is one character that the pattern covers."""
    return (c in "\t\n\r" or " " <= c <= "~" or c > "\xa0") and len(c.lower()) == 1 and ord(c.lower()) <= LATIN_END


UNUSUAL = re.compile("[^" + "".join(re.escape(c) for c in map(chr, range(LATIN_END + 1)) if _plain(c)) + "]")
SPECIAL_MARK = "<|"


class PreTokenCounter:
    """Counts the tokens of texts; holds the proved whole tokens and what was merged so far."""

    def __init__(self, path: str, whole: list[str] | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pattern = _pre_token_pattern()
        self.known = self.whole = dict.fromkeys(self.prove() if whole is None else whole, 1)

    def prove(self) -> list[str]:
        """The vocabulary strings that are one pre-token and that one token when they stand alone."""
        from tokenizers.decoders import ByteLevel

        mark, read = self.library.model.end_of_word_suffix or "", ByteLevel()
        strings, ids = zip(*[(read.decode([v.removesuffix(mark)]), i) for v, i in self.library.get_vocab().items() if v.endswith(mark)], strict=True)
        found = self.library.encode_batch(list(strings), add_special_tokens=False)
        return [s for s, i, e in zip(strings, ids, found, strict=True) if e.ids == [i] and SPECIAL_MARK not in s and self.split(s) == [s]]

    def split(self, text: str) -> list[str]:
        if not UNUSUAL.search(text):
            return self.pattern.findall(text.lower())
        clean = self.library.normalizer.normalize_str(text)
        return [clean[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(clean)]

    def count(self, texts: list[str]) -> list[int]:
        parts = [None if SPECIAL_MARK in t else self.split(t) for t in texts]
        new = {p for ps in parts if ps for p in ps}.difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known = dict(self.whole)
                new = {p for ps in parts if ps for p in ps}.difference(self.known)
            new = list(new)
            if self.known is self.whole:
                self.known = dict(self.whole)
            self.known.update(zip(new, (len(e.ids) for e in self.library.encode_batch(new, add_special_tokens=False)), strict=True))
        get = self.known.__getitem__
        return [len(self.library.encode(t, add_special_tokens=False).ids) if ps is None else sum(map(get, ps)) for t, ps in zip(texts, parts, strict=True)]


def blocks(texts: Iterable[str], at_once: int = AT_ONCE) -> Iterator[list[str]]:
    """Lists of texts of about ``at_once`` characters; a longer text stands alone."""
    block: list[str] = []
    size = 0
    for t in texts:
        if block and size + len(t) > at_once:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def _counter(path: str, whole: Broadcast) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        counter = PreTokenCounter(path, whole.value)
        for texts in batches:
            counts: list[int] = []
            for block in blocks("" if t is None else t for t in texts):
                counts += counter.count(block)
            yield pd.Series(counts, dtype="int64")

    return run


def with_token_counts(docs: DataFrame, tokenizer_path: str, out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text; extra columns pass through.

    ``tokenizer_path`` names a tokenizer file present on the driver and every executor.
    """
    run = _counter(tokenizer_path, docs.sparkSession.sparkContext.broadcast(PreTokenCounter(tokenizer_path, []).prove()))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(batches)

    return docs.withColumn(out, n_tokens(F.col("text")))
