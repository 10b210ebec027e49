"""The queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefero.llm import conversation_repair, decontaminate, interpolated_lm, language_id, mixing, order_minhash, permutation_index, quality, secrets_scan, shingle_join, token_counts, url_filters, vector_codes
from prefero.llm.common import LOWER, UPPER, crc_mod, id_text, table

#: Share of tokens beyond which a text is over the limit.
TOKEN_LIMIT = 2048


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


#: The dated list of op2 (fixed values): entry, kind, action, date, put on the list or taken off.
URL_LIST = (
    ("cheap-pills.example.com", "domain", "block", "2024-01-15", True),
    ("cheap-pills.example.com", "domain", "block", "2024-06-01", False),
    ("cheap-pills.example.com", "domain", "block", "2024-09-10", True),
    ("www.cheap-pills.example.com/en", "prefix", "allow", "2024-10-01", True),
    ("casino-win.example.org", "domain", "block", "2024-03-01", True),
    ("www.casino-win.example.org", "host", "allow", "2024-08-01", True),
    ("www.casino-win.example.org", "host", "allow", "2024-08-20", False),
    ("free-bets.example.com", "domain", "block", "2024-02-01", True),
    ("m.free-bets.example.com/de", "prefix", "allow", "2024-02-01", True),
    ("ads-track.example.org", "host", "block", "2024-01-01", True),
    ("tionsh.example.net/fr", "prefix", "block", "2024-05-01", True),
    ("tionsh.example.net/fr", "prefix", "block", "2024-07-01", False),
    ("blog.tionble.example.com", "host", "block", "2024-04-01", True),
    ("example.net", "domain", "block", "2024-12-01", True),
)
#: The table has no fetch times: a page is fetched on a day of 2024 that the hash of its id names.
FETCH_DAYS = 366


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.conv(F.substring(F.md5(id_text("page_id")), 1, 8), 16, 10).cast("long") % FETCH_DAYS
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("fetched"))
    events = spark.createDataFrame(URL_LIST, "entry string, kind string, action string, at string, listed boolean").withColumn("at", F.col("at").cast("date"))
    found = url_filters.with_verdicts(captures, events)
    return found.select("page_id", url_filters.host_of(F.col("url")).alias("host"), "fetched", "filter.verdict", "filter.entry", "filter.kind", "filter.since")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_mod("doc_id", 7)
    part = F.when(fold == 2, 0).when(fold == 3, interpolated_lm.ASIDE).otherwise(interpolated_lm.LEARN)
    found = interpolated_lm.scored(table(spark, sf_dir, "documents").select("doc_id", "text", part.alias("part")))
    return found.select("doc_id", (F.col("part") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_contamination(docs, table(spark, sf_dir, "benchmark"))
    none = F.array().cast("array<string>")
    return found.select(
        "doc_id",
        F.size(decontaminate.words_of(F.col("text"))).cast("long").alias("n_words"),
        F.coalesce(F.size("leak.hits"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("leak.items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("leak.items", none), ","), 256).alias("items_sha256"),
        F.col("leak").isNotNull().alias("contaminated"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_mod("doc_id", 3) != 1)
    scored = quality.with_quality(docs, labels, "score")
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.with_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size", "class_texts", "n_verified")


def _spans_of(kind: str) -> Column:
    return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, 20)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.with_secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), out="s")
    base = [r.kind for r in secrets_scan.BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[_spans_of(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("s", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        joined("s").alias("spans"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 5) == 0
    learned = language_id.profiles(docs.where(~held_out))
    found = language_id.with_language(docs.select("doc_id", "text"), learned, "l")
    return found.select("doc_id", held_out.alias("held_out"), F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))


def op11_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.with_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut short, repeated or given to the user, as the hash of their key says."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("k"))
    k = F.col("k")
    role = F.when(k == 4, "user").otherwise(F.col("role"))
    said = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(k == 0, 0).when(k == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), said.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "conversations")
    found = conversation_repair.repaired(damaged(every)).withColumnRenamed("conv_id", "_conv_id")
    ids = every.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["_conv_id"]), "left")
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e.cast("long")), 2, "0"))), "")
    found = vector_codes.with_label_errors(coded)
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.codebook_digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_url_filters, op3_language_model, op4_decontaminate, op5_token_counts, op6_quality, op7_nearest, op8_near_duplicates, op9_secrets, op10_language, op11_shingle_join, op12_conversation_repair, op13_vector_codes)}


#: Sizes, the cycle of weights and the water level as in prefero.llm.mixing, in DuckDB's SQL.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, [5.0, 2.0, 1.0][((n - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s
), l AS (
  SELECT *, most / weight AS cut,
    (sum(source_size) OVER () - (sum(most) OVER o - most)) / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, n)
), t AS (
  SELECT source, source_size, least(most, weight * coalesce((SELECT level FROM l WHERE level <= cut ORDER BY cut, n LIMIT 1), 0)) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


def _op4_sql() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {words} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS run
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS run
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), m AS (SELECT r, s, n, item FROM dw JOIN iw USING (n, run)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


def _op2_sql() -> str:
    values = ", ".join(f"('{e}', '{k}', '{a}', DATE '{d}', {str(on).lower()})" for e, k, a, d, on in URL_LIST)
    return rf"""
WITH ev(entry, kind, action, dated, listed) AS (VALUES {values}),
iv AS (
  SELECT * FROM (SELECT entry, kind, action, dated AS since, listed, lead(dated) OVER (PARTITION BY entry, kind, action ORDER BY dated) AS until FROM ev) WHERE listed
), p AS (
  SELECT page_id, url, nullif(rtrim(lower(regexp_extract(url, '{url_filters.HOST}', 1)), '.'), '') AS host,
    '/' || array_to_string(list_filter(string_split(regexp_extract(url, '{url_filters.PATH}', 1), '/'), lambda x: x <> ''), '/') || '/' AS path,
    DATE '2024-01-01' + (('0x' || substr(md5(coalesce(page_id::VARCHAR, 'null')), 1, 8))::BIGINT % {FETCH_DAYS})::INT AS fetched
  FROM pages
), m AS (
  SELECT p.*, iv.*, row_number() OVER (PARTITION BY page_id, url ORDER BY list_position(['domain', 'host', 'prefix'], kind) DESC, length(entry) DESC, action = 'block' DESC) AS n
  FROM p JOIN iv ON since <= fetched AND (until IS NULL OR fetched < until) AND (
    kind = 'domain' AND (host = entry OR ends_with(host, '.' || entry)) OR kind = 'host' AND host = entry
    OR kind = 'prefix' AND starts_with(host || path, entry || '/'))
)
SELECT p.page_id, p.host, p.fetched, coalesce(m.action, 'none') AS verdict, m.entry, m.kind, m.since
FROM p LEFT JOIN m ON m.n = 1 AND p.page_id IS NOT DISTINCT FROM m.page_id AND p.url IS NOT DISTINCT FROM m.url
"""


def _op11_sql() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
t AS MATERIALIZED (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS run FROM d
), n AS MATERIALIZED (SELECT r, count(*) AS n FROM t GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS o FROM t a JOIN t b ON a.run = b.run AND a.r <> b.r GROUP BY a.r, b.r),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
reach AS (SELECT r, r AS c FROM d UNION SELECT l.y, reach.c FROM reach JOIN l ON l.x = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.c GROUP BY reach.r) m USING (r)
"""


#: Checksum bit by bit; ways keep the initials said so far, which a pattern accepts or not.
OP12_SQL = r"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT),
      lambda crc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, b)), 4294967295::BIGINT), 4294967295) % 20 AS k
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM r, LATERAL (SELECT unnest(range(CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END)))
), o AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS ink FROM d
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS MATERIALIZED (
  SELECT *, ink = '' AS blank, ink <> '' AND seen > 1 AS duplicate, ink <> '' AND seen = 1 AND right(ink, 1) NOT IN ('.', '!', '?') AS truncated,
    before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM o)
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank, sum(duplicate::INT)::BIGINT AS duplicate,
    sum(truncated::INT)::BIGINT AS truncated, sum(illegal::INT)::BIGINT AS illegal, max(i) AS n
  FROM f GROUP BY conv_id
), ins(said) AS (VALUES (''), ('u'), ('a'), ('ua'), ('au')), way AS (
  SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS cost, '' AS audit, '' AS roles, []::VARCHAR[] AS lines FROM c
  UNION ALL
  SELECT b.conv_id, b.i, b.m.cost, b.m.audit, b.m.roles, b.m.lines FROM (
    SELECT conv_id, i, right(roles, 1) AS state, min({'cost': cost, 'audit': audit, 'roles': roles, 'lines': lines}) AS m FROM (
      SELECT way.conv_id, f.i, way.cost + 2 * len(said) + e.cost + CASE WHEN truncated AND e.op <> 'D' THEN 1 ELSE 0 END AS cost,
        way.audit || repeat('I', len(said)) || e.op AS audit,
        way.roles || said || CASE e.op WHEN 'D' THEN '' WHEN 'R' THEN left(e.who, 1) ELSE left(f.role, 1) END AS roles,
        list_concat(way.lines, list_transform(range(1, len(said) + 1), lambda j: CASE said[j] WHEN 'u' THEN 'user:' ELSE 'assistant:' END),
          CASE e.op WHEN 'D' THEN [] WHEN 'R' THEN [e.who || ':' || f.text] ELSE [f.role || ':' || f.text] END) AS lines
      FROM way JOIN f ON f.conv_id IS NOT DISTINCT FROM way.conv_id AND f.i = way.i + 1, ins, (VALUES ('K', '', 0), ('R', 'user', 2), ('R', 'assistant', 2), ('D', '', 3)) AS e(op, who, cost)
      WHERE e.op = 'D' OR NOT (blank OR duplicate)
    ) WHERE regexp_full_match(roles, 's?(ua)*u?') GROUP BY ALL
  ) b
), z AS (
  SELECT conv_id, min({'cost': way.cost + 2 * len(said), 'audit': audit || repeat('I', len(said)),
    'lines': list_concat(lines, list_transform(range(1, len(said) + 1), lambda j: CASE said[j] WHEN 'u' THEN 'user:' ELSE 'assistant:' END))}) AS m
  FROM way JOIN c USING (conv_id), ins WHERE way.i = c.n AND regexp_full_match(roles || said, '(s?(ua)+)?') GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(z.m.cost, 0)::BIGINT AS cost, coalesce(z.m.audit, '') AS audit, sha256(coalesce(array_to_string(z.m.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def _op13_sql() -> str:
    """All rounds spelled out; each part meets every entry of its codebook."""
    far = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    out = """
WITH k AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS r, q
  FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), v AS MATERIALIZED (
  SELECT r, p, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS x FROM k, range(8) AS t(p)
), b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM v WHERE r <= 16)"""
    for turn in range(7):
        out += f""", a{turn} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, min(ROW({far}, e)) AS m FROM v JOIN b{turn} USING (p) GROUP BY r, p
)"""
        if turn < 6:
            out += f""", s{turn} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT p, m[2] AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{turn}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL) GROUP BY p, e
), b{turn + 1} AS MATERIALIZED (SELECT p, e, coalesce(s{turn}.c, b{turn}.c) AS c FROM b{turn} LEFT JOIN s{turn} USING (p, e))"""
    return (
        out
        + """, o AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', m[2]::INT), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM k JOIN a6 USING (r) GROUP BY k.r, k.vec_id, k.label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b6) AS codebooks_sha256
FROM o
"""
    )


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_url_filters": _op2_sql(), "op4_decontaminate": _op4_sql(), "op11_shingle_join": _op11_sql(), "op12_conversation_repair": OP12_SQL, "op13_vector_codes": _op13_sql()}
