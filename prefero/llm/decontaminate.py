"""Benchmark decontamination by winnowing, on DataFrame functions alone.

A text's k-grams of words are hashed, and of each sliding window of k-grams the
smallest hash is kept.  With windows of ``span - k + 1`` k-grams, two texts that
share ``span`` words in a row keep the same hash there, so joining training
and test fingerprints finds every shared span of that length.  Hits are then
extended: the spans around a matching k-gram are compared word by word.

An item of fewer than ``span`` words is one span itself; its whole is looked for
among all runs of as many words.  Null texts and texts without words have no
spans.  Equal texts are examined once.  A null item id is listed as ``null``;
repeated items count once.  Whole texts of any length are searched; repeated rows are marked
each.  Without documents or items nothing is marked.  Extra columns pass through, whatever their
names, and one named as the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefero.llm.common import ascii_lower, id_text, parts_between, small_side, staged, unused

#: What separates words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a span that must be found wherever it is shared, and words of a k-gram.
SPAN, K = 10, 5
#: Matching hashes of a text up to which each of its places is looked up among them.
FEW = 64


def words_of(text: Column) -> Column:
    return parts_between(ascii_lower(text), SEPARATORS)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _places(n: Column) -> Column:
    """1 to n; empty if n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def grams_of(words: Column, length: int) -> Column:
    """Hash of the run of ``length`` words at each place."""
    return F.transform(_places(F.size(words) - (length - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(length))))


def winnowed(grams: Column, window: int) -> Column:
    """The least hash of every window of ``window`` hashes, each once."""
    return F.array_distinct(F.transform(_places(F.size(grams) - (window - 1)), lambda i: F.array_min(F.slice(grams, i, F.lit(window)))))


def _fingerprints(docs: DataFrame, short: list[int], span: int, k: int) -> DataFrame:
    """key, fp: the winnowed hashes of each text, and for short items all its runs of their lengths."""
    with_grams = docs.select("key", F.col("words")).withColumn("grams", grams_of(F.col("words"), k))
    kept = [winnowed(F.col("grams"), span - k + 1)] + [F.array_distinct(grams_of(F.col("words"), n)) for n in short]
    return with_grams.select("key", F.explode(F.concat(*kept)).alias("fp"))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(id_text("item_id").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)


def _runs(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """key, hits, items: for each text that shares a span, the places (from 1) of its hit words and the items' ids, sorted.

    ``key`` is ``text_key`` of the text.  The benchmark's fingerprints are broadcast
    if their measured size is small, and join by shuffle otherwise.
    """
    items = staged(_items(benchmark), "items")
    lengths = [r[0] for r in items.where(F.size("words") < span).select(F.size("words").alias("n")).distinct().orderBy("n").collect()]  # below span
    keyed = docs.select(text_key(F.col("text")).alias("key"), "text")

    item_prints = _fingerprints(items.select(F.col("item").alias("key"), "words").where(F.size("words") >= span), [], span, k)
    for n in lengths:
        item_prints = item_prints.union(items.where(F.size("words") == n).select("item", F.explode(grams_of(F.col("words"), n))))
    prints = small_side(staged(item_prints.select("fp").distinct(), "item-prints"))
    found = _fingerprints(keyed.select("key", words_of(F.col("text")).alias("words")), lengths, span, k).join(prints, "fp", "left_semi")
    matched = small_side(staged(found.groupBy("key").agg(F.collect_set("fp").alias("fps")), "matched-prints"))

    # equal texts are extended once; their words are needed only where something matched
    texts = staged(keyed.join(matched, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("fps").alias("fps")), "matched-texts")
    texts = _with_places(texts.select("key", "fps", words_of(F.col("text")).alias("words")), list(dict.fromkeys([k, *lengths])))
    size = F.size("words")
    near = F.transform(
        F.col(_places_name(k)),
        lambda p: F.when(F.least(p, size - (span - 1)) >= 1, F.sequence(F.greatest(F.lit(1), p - (span - k)), F.greatest(F.lit(1), F.least(p, size - (span - 1))))).otherwise(F.array().cast("array<int>")),
    )
    starts = F.transform(F.array_distinct(F.flatten(near)), lambda s: F.struct(s.alias("start"), F.lit(span).alias("length")))
    for n in lengths:
        starts = F.concat(starts, _starts_of(n))
    at = texts.select("key", "words", F.explode(starts).alias("s"))
    at = at.select("key", "s", _runs(F.col("words"), F.col("s.start"), F.col("s.length")).alias("run"))

    spans = items.select("item", "words", F.explode(_places(F.greatest(F.lit(1), F.size("words") - (span - 1)))).alias("start"))
    spans = spans.select("item", _runs(F.col("words"), F.col("start"), F.lit(span)).alias("run")).groupBy("run").agg(F.collect_set("item").alias("items"))
    shared = at.join(small_side(staged(spans, "item-spans")), "run")
    by_key = shared.groupBy("key").agg(F.collect_set("s").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    return by_key.select("key", hits.alias("hits"), "items")


def _places_name(length: int) -> str:
    return f"_places_{length}"


def _looked_up(length: int) -> Column:
    """Places whose run of ``length`` words has one of the hashes ``fps``."""
    return F.filter(_places(F.size("words") - (length - 1)), lambda i: F.array_contains("fps", F.xxhash64(F.slice("words", i, F.lit(length)))))


def _starts_of(length: int) -> Column:
    return F.transform(_places_name(length), lambda s: F.struct(s.alias("start"), F.lit(length).alias("length")))


def _with_places(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """``texts`` (key, fps, words) with the places whose run of each length has one of the hashes ``fps``.

    A text of few hashes looks each place up in their list.  One of more than ``FEW`` joins its places to
    them, so a long text that is copied throughout takes time in proportion to its words.
    """
    few, many = texts.where(F.size("fps") <= FEW), texts.where(F.size("fps") > FEW)
    few = few.select("*", *[_looked_up(n).alias(_places_name(n)) for n in lengths])
    own = many.select("key", F.explode("fps").alias("fp"))
    for n in lengths:
        runs = many.select("key", F.posexplode(grams_of(F.col("words"), n)).alias("i", "fp"))
        found = runs.join(own, ["key", "fp"]).groupBy("key").agg(F.sort_array(F.collect_list(F.col("i") + 1)).alias("found"))
        many = many.join(found, "key", "left").withColumn(_places_name(n), F.coalesce("found", F.array().cast("array<int>"))).drop("found")
    return few.unionByName(many)


def with_contamination(docs: DataFrame, benchmark: DataFrame, out: str = "leak") -> DataFrame:
    """``docs`` with a struct (hits, items), null for texts that share nothing; extra columns pass through."""
    found = small_side(staged(contamination(docs, benchmark), "contamination"))
    kept = docs.drop(out)
    of = unused("_leak_key", kept)
    found = found.select(F.col("key").alias(of), F.struct("hits", "items").alias(out))
    return kept.join(found, text_key(kept["text"]) == found[of], "left").drop(of)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Only the documents that share no span with any item."""
    leak = unused("_leak", docs)
    return with_contamination(docs, benchmark, leak).where(F.col(leak).isNull()).drop(leak)
