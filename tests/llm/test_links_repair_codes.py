"""Shingle join, conversation repair and vector codes against brute force, and their odd cases."""

import functools
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefero.llm import conversation_repair, shingle_join, vector_codes

WORDS = [f"w{i}" for i in range(400)]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    """(n, least id) of each row, every pair compared."""
    sets = [shingle_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            top[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return sorted((str(x), len(s), str(x if not s else least.get(find(i)))) for i, ((x, _), s) in enumerate(zip(rows, sets, strict=True)))


def joined(spark, rows):
    got = shingle_join.with_components(spark.createDataFrame([(i, t, "k", "c", 1) for i, t in rows], "doc_id long, text string, id string, comp string, a int"))
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect())


def edited(draw, words, edits):
    words = list(words)
    for at in draw.sample(range(len(words)), edits):
        words[at] = draw.choice(WORDS)
    return " ".join(words)


@pytest.mark.parametrize("block", [4, 256])
def test_op11_crowds_of_near_copies(spark, monkeypatch, block):
    """Texts that are a few edits from one another: many pairs just at the bound, many components in one list."""
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    draw = random.Random(5)
    rows, base = [], [draw.choice(WORDS) for _ in range(60)]
    rows += [(i, edited(draw, base, draw.randrange(4))) for i in range(90)]  # some link with no leader
    passage = [draw.choice(WORDS) for _ in range(30)]
    rows += [(100 + i, " ".join(passage + [draw.choice(WORDS) for _ in range(n)])) for i, n in enumerate(draw.choices(range(12), k=60))]  # share a passage
    for i in range(40):  # sizes on both sides of class bounds
        n = draw.randrange(5, 30)
        text = [draw.choice(WORDS) for _ in range(n)]
        rows += [(200 + 3 * i + k, " ".join(text + [draw.choice(WORDS) for _ in range(k * max(1, n // 10))])) for k in range(3)]
    got, want = joined(spark, rows), brute_components(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 60


def test_op11_odd_rows(spark):
    long = " ".join(f"x{i % 5000}y{i // 7}" for i in range(40_000))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One TWO"), (5, "two one"), (4, "One TWO"), (None, "one two"), (None, "lonely words here"), (6, long), (7, long + " end"), (8, "a b c d e f g"), (8, "other text of the id eight again"), (9, "É é"), (10, "é é"), (11, "a\xa0b c"), (12, "a b c")]
    assert joined(spark, rows) == brute_components(rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert shingle_join.with_components(none).count() == 0


def test_op11_prefixes_and_classes_lose_no_pair():
    """Whatever the order of shingles, two sets that link enter one block of one list."""
    draw = np.random.default_rng(3)
    table = draw.integers(0, 50, (2, shingle_join.CELLS)).astype(np.uint16)
    pool = draw.integers(0, 1 << 63, 400).astype(np.uint64)
    for _ in range(400):
        n = int(draw.integers(1, 120))
        a = np.sort(draw.choice(pool, n, replace=False))
        b = np.unique(np.concatenate([draw.choice(a, max(1, n - int(draw.integers(0, n // 6 + 1))), replace=False), draw.choice(pool, int(draw.integers(0, n // 6 + 1)))]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert np.intersect1d(shingle_join.entries(a, table)[0], shingle_join.entries(b, table)[0]).size


def repair_of(turns):
    """Cheapest repair by going back from the last turn; turns are (role, text) in order."""
    leads = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    seen, kinds = set(), []
    for role, text in turns:
        ink = re.sub(r"[\x20\x09-\x0D]+", "", text)
        kinds.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, state, inserted):
        ways = []
        if i == len(turns) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 2:
            for c, said in (("u", "user:"), ("a", "assistant:")):
                if (state, c) in leads and (w := best(i, leads[state, c], inserted + 1)):
                    ways.append((w[0] + 2, "I" + w[1], (said, *w[2])))
        if i < len(turns):
            (role, text), late = turns[i], kinds[i] == "truncated"
            if w := best(i + 1, state, 0):
                ways.append((w[0] + 3, "D" + w[1], w[2]))
            if kinds[i] not in ("blank", "duplicate"):
                for letter, who, cost in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if (state, who[:1]) in leads and (w := best(i + 1, leads[state, who[:1]], 0)):
                        ways.append((w[0] + cost + late, letter + w[1], (f"{who}:{text}", *w[2])))
        return min(ways, default=None)

    cost, audit, lines = best(0, "", 0)
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(turns)]
    return (kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("segment", [2, 5, 256])
def test_op12_brute_force(spark, segment):
    draw, convs = random.Random(segment), {}
    for c in range(60):
        roles = draw.choices(["user", "assistant", "system", "tool", " "], [5, 5, 2, 1, 1], k=draw.randrange(1, 14))
        convs[c] = [(i, r, draw.choice(["Yes.", "no", "", "  ", "Why?\n", f"{i} it is!", f"cut {i}"])) for i, r in enumerate(roles)]
    convs[77] = [(i, "user" if i % 2 == 0 else "assistant", f"t {i}" + "." * (i % 7 > 0)) for i in range(300)]
    rows = [(c, t, r, x, 1, 2) for c, turns in convs.items() for t, r, x in turns]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c int, at int")
    got = {r["conv_id"]: tuple(r[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in conversation_repair.repaired(df, segment).collect()}
    assert got == {c: repair_of([(r, x) for _, r, x in turns]) for c, turns in convs.items()}


def test_op12_odd_rows(spark):
    rows = [(1, None, "user", "Hi."), (1, 5, "user", "Hi."), (1, 5, "assistant", None), (None, 1, "user", "A."), (None, 2, "assistant", "B."), (2, None, None, None), (3, 0, "", "Words."), (4, 7, "user", "x" * 200_000), (4, 7, "user", "x" * 200_000)]
    got = {r["conv_id"]: r for r in conversation_repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, None, 2, 3, 4}
    assert (got[1]["gaps"], got[1]["blank"], got[1]["duplicate"], got[1]["audit"]) == (0, 1, 1, "KDDI")
    assert (got[None]["cost"], got[None]["audit"]) == (0, "KK")
    assert (got[2]["gaps"], got[2]["audit"], got[2]["repaired_sha256"]) == (0, "D", hashlib.sha256(b"").hexdigest())
    assert (got[3]["audit"], got[3]["cost"]) == ("D", 3)
    assert (got[4]["truncated"], got[4]["duplicate"], got[4]["audit"]) == (1, 1, "DD")  # KDI costs as much
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repaired(none).count() == 0


def brute_codes(vectors):
    """Codes, errors and codebooks by measuring every entry; vectors in order of id."""
    q = np.array([[math.floor(4096 * x) for x in v] for v in vectors], object).reshape(len(vectors), 8, -1)
    books, out = [[list(v[p]) for v in q[:16]] for p in range(8)], None
    for turn in range(7):
        out = [[min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(8)] for v in q]
        if turn < 6:
            for p in range(8):
                for k in range(len(books[p])):
                    own = [v[p] for v, o in zip(q, out, strict=True) if o[p][1] == k]
                    if own:
                        books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [("".join(f"{k:02x}" for _, k in o), sum(d for d, _ in o)) for o in out], books


@pytest.mark.parametrize("n", [1, 9, 300])
def test_op13_brute_force(spark, n):
    draw = np.random.default_rng(n)
    # few different values, so distances tie
    vectors = (draw.integers(-3, 4, (n, 16)) / 4 + (n == 300) * draw.normal(0, 0.01, (n, 16)) * (np.arange(n) % 2)[:, None]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 3) if i % 5 else None, "x") for i, v in enumerate(vectors)]
    rows += [(-1, None, 1, "x"), (-2, [0.5, None] * 8, 1, "x"), (-3, [math.nan] * 16, 1, "x"), (-4, [math.inf] * 16, None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string").repartition(3)
    coded, books = vector_codes.compressed(df)
    got = sorted((r["vec_id"], r["label"], "".join(f"{k:02x}" for k in r["code"]), r["error"], r["label_error"]) for r in vector_codes.with_label_errors(coded).collect())
    want, want_books = brute_codes(vectors)
    assert [(g[2], g[3]) for g in got] == want and books.tolist() == want_books
    of = {}
    for g in got:
        of[g[1]] = of.get(g[1], 0) + g[3]
    assert all(g[4] == of[g[1]] for g in got)
    text = ",".join(str(c) for part in want_books for e in part for c in e)
    assert vector_codes.codebook_digest(books) == hashlib.sha256(text.encode()).hexdigest()


def test_op13_search_from_any_start():
    draw = np.random.default_rng(8)
    for spread in (2, 50, 4000):
        x, book = draw.integers(-spread, spread, (500, 4)), draw.integers(-spread, spread, (16, 4))
        book[5] = book[9]
        far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        for start in (np.zeros(500, int), draw.integers(0, 16, 500), far.argmin(axis=1), np.full(500, 9)):
            best, least = vector_codes.nearest_entries(x, book, start)
            assert (best == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_op13_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    coded, books = vector_codes.compressed(spark.createDataFrame([], schema))
    assert coded.count() == 0 and not books.size and vector_codes.with_label_errors(coded).count() == 0
    same = [(1, [0.5] * 8, None), (1, [0.25] * 8, None), (None, [0.5] * 8, 2), (None, [0.5] * 8, 2)]
    coded, books = vector_codes.compressed(spark.createDataFrame(same, schema))
    assert books.shape == (8, 4, 1) and books[0, :, 0].tolist() == [1024, 2048, 2048, 2048]
    assert sorted(tuple(r["code"]) for r in coded.collect()) == [(0,) * 8] + [(1,) * 8] * 3
    for bad in ([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], [(1, [0.5] * 9, 1)], [(1, [], 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(ValueError, match="components"):
            vector_codes.compressed(spark.createDataFrame(bad, schema))


def test_staged_tables_go(spark):
    import os

    from prefero.llm.common import scratch, shared_dir, staged

    at = lambda: {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("prefero-")}
    staged(spark.range(1), "first", outlives=True)
    before = at()
    with scratch():
        kept = staged(spark.range(3).select(F.col("id") + 1), "kept", outlives=True)
        staged(spark.range(3), "gone")
        assert len(at() - before) == 2
    assert len(at() - before) == 1 and kept.count() == 3


def test_op11_parities_bound_differences():
    draw = np.random.default_rng(4)
    for n in (1, 5, 60, 700, 3000):
        a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
        for m in (0, 1, n // 10, n // 2):
            b = np.unique(np.concatenate([a[m:], draw.integers(0, 1 << 63, m + n // 3).astype(np.uint64)]))
            x, y = shingle_join.parities(a), shingle_join.parities(b)
            assert len(x) * 8 >= 2 * n
            for size in (8, min(len(x), len(y))):
                assert np.bitwise_count(shingle_join.folded(x, size) ^ shingle_join.folded(y, size)).sum() <= len(np.setxor1d(a, b))
