"""One query per operator over its whole table, with a SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html, ppm, secrets, shards, simhash, spelling, suffixes, topk, toxicity, warc, whitening
from .common import table


def tokenizer() -> str:
    """Where the public vocabulary file lies; it is never copied."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), tokenizer())


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(table(spark, folder, "pages"))


def op4_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digests(table(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op7_ppm(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.scores(table(spark, folder, "documents"), across=True)


def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), every=20, k=20)


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards.assign(table(spark, folder, "documents"), shards=40)


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_components(table(spark, folder, "embeddings"))


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(table(spark, folder, "documents"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_toxicity, op3_html, op4_suffixes, op5_decontamination, op6_simhash, op7_ppm, op8_topk, op9_sharding, op10_warc,
                                   op11_whitening, op12_secrets, op13_spelling)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets_sql() -> str:
    """Positions as running sums over matches and the texts between them; windows counted anew, one by one."""
    kinds = [("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", secrets.HEX),
             *((c.kind, c.pattern) for c in secrets.CLASSES)]
    found = " UNION ALL ".join(
        f"SELECT rid, {i} AS o, {_quoted(kind)} AS kind, regexp_extract_all(t, {_quoted(p)}) AS f, string_split_regex(t, {_quoted(p)}) AS g FROM d"
        for i, (kind, p) in enumerate(kinds))
    allowed = " AND ".join(f"NOT regexp_matches(found, {_quoted(p)})" for p in secrets.ALLOWED)
    classes = ", ".join(f"({_quoted(c.kind)}, {c.window}, {secrets.most_weight(c)}, {secrets.weights(c.window)})" for c in secrets.CLASSES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
x AS (SELECT rid, o, kind, unnest(f) AS found, unnest(g[:len(f)]) AS gap, generate_subscripts(f, 1) AS i FROM m WHERE len(f) > 0),
p AS (SELECT *, (sum(length(gap) + length(found)) OVER (PARTITION BY rid, o ORDER BY i) - length(found))::BIGINT AS s FROM x),
base AS (SELECT rid, o, kind, s, s + length(found) AS e FROM p WHERE o = 1 OR o = 2
  OR (o = 0 AND length(regexp_extract(found, {_quoted(secrets.ASSIGN)}, 2)) >= {secrets.ASSIGNED})),
cls(kind, w, most, weight) AS (VALUES {classes}),
runs AS (SELECT rid, o, kind, i, found, s, w, most, weight FROM p JOIN cls USING (kind) WHERE {allowed}),
wins AS (SELECT *, unnest(range(length(found) - w + 1)) AS pos FROM runs),
chars AS (SELECT rid, o, kind, i, s, w, most, weight, pos, substr(found, (pos + k + 1)::BIGINT, 1) AS c
  FROM (SELECT *, unnest(range(w)) AS k FROM wins)),
sums AS (SELECT rid, o, kind, i, s, w, most, pos, sum(weight[n + 1]) AS total FROM (
  SELECT rid, o, kind, i, s, w, most, any_value(weight) AS weight, pos, c, count(*) AS n FROM chars GROUP BY ALL) GROUP BY ALL),
dense AS (SELECT rid, o, kind, i, s + pos AS a, s + pos + w AS b, lag(s + pos + w) OVER (PARTITION BY rid, o, i ORDER BY pos) AS prior
  FROM sums WHERE total <= most),
isles AS (SELECT *, sum(CASE WHEN prior >= a THEN 0 ELSE 1 END) OVER (PARTITION BY rid, o, i ORDER BY a) AS isle FROM dense),
added AS (SELECT rid, o, kind, min(a) AS s, max(b) AS e FROM isles GROUP BY rid, o, kind, i, isle),
every AS (SELECT *, true AS basic FROM base UNION ALL SELECT *, false FROM added),
told AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (WHERE basic) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (rid)"""


#: Words one edit apart agree after one deletion, or on all but one place; crc32 by its table of 256 entries.
_SPELLING_SQL = f"""
WITH RECURSIVE steps(i, k, v) AS (SELECT range, 0, range::BIGINT FROM range(256) UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM steps WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS crc FROM steps WHERE k = 8),
runs AS (SELECT id, run, count(*) AS c FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, c, flatten(list_transform(string_split(id || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)) AS b FROM runs),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda h, x: xor(h // 256, crc[xor(h % 256, x) + 1])), 4294967295) AS h FROM bytes, tab),
results AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
keys AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM places),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM keys a JOIN keys b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT k.word, w.word, w.n FROM keys k JOIN words w ON k.rest = w.word
  UNION SELECT w.word, k.word, k.n FROM keys k JOIN words w ON k.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS form, max(other_n) AS form_n FROM near GROUP BY word),
told AS (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form,
    CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, last, form) AS (SELECT word, word, form FROM told UNION ALL
  SELECT c.word, t.word, t.form FROM chain c JOIN told t ON c.form = t.word)
SELECT word, n, n_near, told.form, form_n, last AS root FROM told JOIN (SELECT word, last FROM chain WHERE form IS NULL) USING (word)"""

ORACLES = {
    "op12_secrets": _secrets_sql(),
    "op13_spelling": _SPELLING_SQL,
    "op5_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.i, d.n, s.item_id FROM dwin d JOIN wins s ON d.win = s.win AND d.n = s.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (
  SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_topk": r"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, coalesce(regexp_replace(url, '[\x00-\x20]', '%20', 'g'), 'urn:page:' || coalesce(page_id::VARCHAR, 'none')) AS url,
      strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
u AS (SELECT *, regexp_replace(lower(url), '^[a-z]+://(www[0-9]*\.)?', '') AS rest FROM f),
h AS (SELECT *, regexp_extract(rest, '^[^/?#:]*') AS host FROM u),
k AS (SELECT *, regexp_replace(substr(rest, length(host) + 1), '#.*$', '') AS tail FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to,
       array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN tail = '' THEN '/' ELSE tail END AS urlkey,
       strftime(to_timestamp(1700000000 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured FROM k""",
}
