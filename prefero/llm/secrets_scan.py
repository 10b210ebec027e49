"""Secret scans by rules of regular expressions, through a trigram inverted index.

Each Arrow batch of texts is a segment with an inverted index of the trigrams
that the rules' Boolean queries name.  A rule's postings are intersected, and
its regular expression verifies only the candidates; rules without mandatory
trigrams (``hex`` alone) scan every text.  Whole texts of any length, no shuffle.

Null texts are empty.  Spans are code-point offsets, end exclusive, by start and at one
start in the order of the rules; repeated
rows repeat their spans; an empty table gives an empty result; extra columns pass through,
and one named as the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefero.llm.common import unused
from prefero.llm.token_counts import blocks
from prefero.llm.trigram_index import SegmentIndex, trigram_query, trigrams_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: spans of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    either_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, (re.ASCII | re.IGNORECASE) if self.either_case else re.ASCII)


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What may stand between the lines of a key: line ends, also escaped as in JSON, or missing; quotes, indents, marks.
BETWEEN = r"(?:[\s\x22'>#|*,;]|\\+[nrt])"
#: A private key: header to END line or, where that is missing, fields such as Proc-Type and base64 as far as it goes.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN|-----END)[\s\S])*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{BETWEEN}+[A-Z][A-Za-z]*-[A-Za-z-]+:[^\r\n\\]*)*"
    rf"(?:{BETWEEN}*(?:[A-Za-z0-9+/=]{{16,}}|[A-Za-z0-9+/=]+(?=[\x20\t]*(?:[\r\n\x22'<\\]|\Z))))*)"
)
#: Further kinds that the scan adds to the base ones.
MORE_RULES = (
    Rule("pem", PEM),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("bearer", r"Bearer [A-Za-z0-9+/_.=-]{20,}"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<kind:string,start:int,end:int>>"


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = [(r, self._whole_runs(r), trigram_query(r.pattern)) for r in rules]
        self.trigrams = trigrams_of(q for _, _, q in self.rules)

    @staticmethod
    def _whole_runs(rule: Rule) -> re.Pattern:
        """A run of one class matches from end to end, so the least length can stand in its repeat."""
        if rule.group == 0 and (m := re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)):
            return re.compile(f"{m[1]}{{{rule.least},}}", re.ASCII)
        return rule.compiled()

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans of each text, by start and then in the order of the rules."""
        index = SegmentIndex(texts, self.trigrams)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in index.candidates(query):
                found[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [[(self.rules[k][0].kind, a, b) for a, k, b in sorted(spans)] for spans in found]


def with_secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, out: str = "secret_spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end) of each whole text."""
    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(rules)
        for texts in batches:
            found: list = []
            for block in blocks("" if t is None else t for t in texts):
                found += scanner.scan(block)
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], dtype="object")

    return docs.withColumn(out, spans(F.col("text")))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` (overlapping spans by one mark).

    ``n_chars``, where there is one, follows the new text; texts without secrets stay as they are.
    """

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(rules)
        for texts in batches:
            clean: list = []
            for block in blocks("" if t is None else t for t in texts):
                clean += [_cut(t, s, mark) if s else None for t, s in zip(block, scanner.scan(block), strict=True)]
            yield pd.Series(clean, dtype="object")

    clean_text = unused("_redacted", docs)
    found = docs.withColumn(clean_text, cut(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.coalesce(F.length(clean_text).cast(kind), F.col("n_chars")))
    return found.withColumn("text", F.coalesce(clean_text, "text")).drop(clean_text)


def _cut(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
