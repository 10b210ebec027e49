"""Repair of conversation structure: the cheapest edits that make the roles of the turns legal.

Turns go by their initial of role; a legal conversation is empty or reads ``(s?(ua)+)``.  Edits:
*K*eep (0), *R*erole to user or assistant (2), *D*elete (3; blank and duplicate turns must go),
*I*nsert an empty user or assistant turn (2); a truncated turn that stays adds 1.  Of the cheapest
repairs the one whose audit (the initials of its edits, in order) is least in ASCII is taken.

Per state of the grammar, only the cheapest way there and its audit matter.  A recursive DuckDB
query keeps just that, inside batches that Spark makes by hash: each recursion advances one turn of
all conversations of the batch.  A conversation of more than ``SEGMENT`` turns is cut into segments,
which are solved in parallel from every state they may be entered in and then chained by a
second recursion, a segment at a time; so a batch holds ``BATCH_TURNS`` turns and a recursion
``SEGMENT`` rounds, however long a conversation is.  Only initials and flags go there, no texts.

That segments may be chained: ways to one state over the same turns at the same cost have audits
of which none begins the other (a further edit would be an insertion, which costs), so the least
audit of a whole is made of the least audits of its segments.

The edits then meet the turns' texts, and the repaired text is hashed as its turns stream by in
order, whole texts of any length, without being held together.

Turns are ordered by number, nulls first, those of one number by role and text; null roles
and texts count as one space (so a null text is blank).  Repeated rows are duplicates of each other.
Turns without a conversation id belong to one conversation, that of the null id.  Empty roles have no initial and
cannot stay as they are.  An empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefero.llm.common import scratch, spread, staged
from prefero.llm.linking import whole_groups

SEGMENT, BATCH_TURNS = 256, 20_000
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a; and where an initial leads.
START, S, U, A = range(4)
STATES = (START, S, U, A)
LEADS = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: Anything but ASCII white space.
INK = r"[^\x20\x09-\x0D]"
ENDS = ".!?"


def _insertions(state: int) -> dict[int, int]:
    """State to the fewest insertions that lead there."""
    found, last = {state: 0}, [state]
    for n in itertools.count(1):
        last = list(dict.fromkeys(LEADS[s, c] for s in last for c in "ua" if (s, c) in LEADS and LEADS[s, c] not in found))
        if not last:
            return found
        found |= dict.fromkeys(last, n)
    raise AssertionError


def edit_table() -> pd.DataFrame:
    """kind, came, goes, cost, letters: every way over a turn of a kind, with the insertions before it.

    A kind is the initial of a role, with ``!`` behind it for a truncated turn; ``-`` must go; ``?`` is any other initial.
    """
    rows = []
    for kind, came in itertools.product([i + t for i in "sua?" for t in ("", "!")] + ["-"], STATES):
        late = TRUNCATED if kind.endswith("!") else 0
        for mid, n in _insertions(came).items():
            ways = [("D", mid, DELETE)]
            if kind != "-":
                ways += [("R", LEADS[mid, c], REROLE + late) for c in "ua" if (mid, c) in LEADS]
                ways += [("K", LEADS[mid, kind[0]], late)] if (mid, kind[0]) in LEADS else []
            rows += [(kind, came, goes, n * INSERT + cost, "I" * n + letter) for letter, goes, cost in ways]
    return pd.DataFrame(rows, columns=["kind", "came", "goes", "cost", "letters"])


def closing_table() -> pd.DataFrame:
    """state, cost, letters: what ends a conversation in each state."""
    rows = [(s, n * INSERT, "I" * n) for s in STATES for goes, n in _insertions(s).items() if goes in (START, A)]
    return pd.DataFrame(rows, columns=["state", "cost", "letters"])


#: One recursion a turn: ``turns`` (g, i, kind) holds turn i of segment g, ``begun`` (g, entry) the states it is entered in.
SEGMENTS_SQL = """
WITH RECURSIVE way(g, entry, i, state, best) AS (
  SELECT g, entry, 0, entry, {'cost': 0::BIGINT, 'audit': ''} FROM begun
  UNION ALL
  SELECT g, entry, i, goes, min(best) FROM (
    SELECT w.g, w.entry, t.i, e.goes, {'cost': w.best.cost + e.cost, 'audit': w.best.audit || e.letters} AS best
    FROM way w JOIN turns t ON t.g = w.g AND t.i = w.i + 1 JOIN edits e ON e.kind = t.kind AND e.came = w.state
  ) GROUP BY g, entry, i, goes
)
SELECT g, entry, state, best.cost AS cost, best.audit AS audit FROM way JOIN (SELECT g, max(i) AS i FROM turns GROUP BY g) USING (g, i)
"""
#: One recursion a segment: ``parts`` (c, seg, entry, state, cost, audit) of conversation c.
CHAINS_SQL = """
WITH RECURSIVE way(c, seg, state, best) AS (
  SELECT DISTINCT c, -1, 0, {'cost': 0::BIGINT, 'audit': ''} FROM parts
  UNION ALL
  SELECT c, seg, goes, min(best) FROM (
    SELECT w.c, p.seg, p.state AS goes, {'cost': w.best.cost + p.cost, 'audit': w.best.audit || p.audit} AS best
    FROM way w JOIN parts p ON p.c = w.c AND p.seg = w.seg + 1 AND p.entry = w.state
  ) GROUP BY c, seg, goes
)
SELECT c, b.cost AS cost, b.audit AS audit FROM (
  SELECT c, min({'cost': best.cost + l.cost, 'audit': best.audit || l.letters}) AS b
  FROM way JOIN (SELECT c, max(seg) AS seg FROM parts GROUP BY c) USING (c, seg) JOIN closing l USING (state) GROUP BY c
)
"""


def _recursed(sql: str, **tables: pd.DataFrame) -> pd.DataFrame:
    """A recursive query over small frames, in memory alone."""
    import duckdb

    with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as con:
        for name, rows in tables.items():
            con.register(name, rows)
        return con.execute(sql).df()


def _solved_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    edits = edit_table()
    for rows in whole_groups(batches, ["c", "seg"], BATCH_TURNS):
        g = rows.groupby(["c", "seg"], sort=False).ngroup()
        turns = pd.DataFrame({"g": g, "i": rows["i"], "kind": rows["kind"]})
        of = rows[["c", "seg"]].assign(g=g).drop_duplicates("g")
        begun = pd.DataFrame([(x, entry) for x, seg in zip(of["g"], of["seg"], strict=True) for entry in (STATES if seg else (START,))], columns=["g", "entry"])
        yield _recursed(SEGMENTS_SQL, turns=turns, begun=begun, edits=edits).merge(of, on="g")[["c", "seg", "entry", "state", "cost", "audit"]]


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for parts in whole_groups(batches, ["c"], BATCH_TURNS):
        yield _recursed(CHAINS_SQL, parts=parts, closing=closing_table())[["c", "cost", "audit"]]


def _repaired_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation's repaired text; the rows come sorted by conversation and place."""
    now, digest, state, lines = None, None, START, 0

    def say(role: str, text: str) -> None:
        nonlocal lines, state
        digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "replace"))
        lines, state = lines + 1, LEADS[state, role[:1]]

    for rows in batches:
        done = []
        for c, role, text, letters in zip(rows["c"], rows["role"], rows["text"], rows["letters"], strict=True):
            if c != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest, state, lines = c, hashlib.sha256(), START, 0
            for letter in letters:
                if letter in "IR":
                    say("assistant" if (state, "a") in LEADS else "user", text if letter == "R" else "")
                elif letter == "K":
                    say(role, text)
        yield pd.DataFrame(done, columns=["c", "repaired_sha256"])
    if now is not None:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["c", "repaired_sha256"])


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, c, at, role, text, turn, blank, duplicate, truncated, illegal: the turns in order, with their first fault.

    ``c`` names conversations (the text of their id), ``at`` numbers their turns from 0.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    rows = rows.withColumn("c", F.coalesce(F.concat(F.lit("id "), F.col("conv_id").cast("string")), F.lit("none")))
    one = ["c", "conv_id"]
    order = W.partitionBy(*one).orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("at", F.row_number().over(order) - 1).withColumn("before", F.lag("role").over(order))
    seen = F.row_number().over(W.partitionBy(*one, "role", F.md5("text")).orderBy("at")) > 1
    ink = F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")
    blank, last = ink == "", F.substring(ink, -1, 1)
    rows = rows.withColumn("blank", blank).withColumn("duplicate", ~blank & seen).withColumn("truncated", ~blank & ~seen & ~last.isin(*ENDS))
    pair = F.concat(F.substring("before", 1, 1), F.substring("role", 1, 1))
    return rows.withColumn("illegal", F.col("before").isNotNull() & ~pair.isin("su", "ua", "au"))


def _kind() -> Column:
    initial = F.substring("role", 1, 1)
    return F.when(F.col("blank") | F.col("duplicate"), "-").otherwise(F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("?"), F.when(F.col("truncated"), "!").otherwise("")))


def repaired(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of ``turns``.

    ``segment``: turns that are solved in one piece.
    """
    with scratch():
        rows = staged(faults(turns), "turns")
        count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
        said = rows.groupBy("c", "conv_id", "turn").agg(*[count(k) for k in ("blank", "duplicate", "truncated", "illegal")])
        said = said.groupBy("c", "conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
            *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")],
        )
        seg = F.floor(F.col("at") / segment).cast("int")
        slim = rows.select("c", seg.alias("seg"), (F.col("at") % segment + 1).alias("i"), _kind().alias("kind"))
        parts = spread(slim, "c", "seg").sortWithinPartitions("c", "seg", "i").mapInPandas(_solved_segments, "c string, seg int, entry int, state int, cost long, audit string")
        solved = staged(spread(parts, "c").sortWithinPartitions("c", "seg").mapInPandas(_chained, "c string, cost long, audit string"), "audits")
        # an edit's letters: insertions before it and its own; those after the last turn go with a further row
        letters = F.regexp_extract_all("audit", F.lit("I*[KRD]|I+$"), 0)
        edits = solved.select("c", F.posexplode(letters).alias("at", "letters"))
        lines = rows.select("c", "at", "role", "text").join(edits, ["c", "at"], "right")
        lines = lines.select("c", "at", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "letters")
        hashes = spread(lines, "c").sortWithinPartitions("c", "at").mapInPandas(_repaired_hashes, "c string, repaired_sha256 string")
        return staged(said.join(solved, "c").join(hashes, "c").drop("c"), "repaired", outlives=True)
