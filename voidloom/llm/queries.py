"""Queries over the training-data operators: ``QUERIES`` (name to function of session and folder) and ``ORACLE_SQL``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontamination, html_text, licenses, line_dedup, near_dedup, nearest_graph, pieces, spelling, token_files, toxicity, url_filter, vector_search
from .common import shared_folder, table

#: CRC-32 in SQL: ``tab`` is its table, {crc} the checksum of a text ``s``.
CRC_TABLE = """tab AS (
  SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS crcs
  FROM (SELECT unnest(range(256)) AS i))"""
CRC = """xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda h: ('0x' || h)::BIGINT)),
                        lambda a, b: xor(crcs[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=lambda i: ~toxicity.held_out(i))
    scored = model.score(docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "text"))
    return scored.select("doc_id", "held_out", "score", "predicted")


#: The rules of the query's contract.
RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL["op7_url_filter"] = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
judged AS (
  SELECT page_id, host, path,
    CASE WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/' END AS rule
  FROM split)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE_SQL["op3_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls,
         list_transform(string_split(text, chr(10)), lambda l: ('0x' || substr(md5(l), 1, 8))::BIGINT) AS hs,
         list_transform(string_split(text, chr(10)), lambda l: len(regexp_extract_all(l, '[^\x09-\x0D\x20]+'))) AS ws
  FROM documents WHERE text IS NOT NULL),
rolled AS (
  SELECT *, list_transform(range(0, len(ls)), lambda i: CASE WHEN i = 0 THEN 1099511627776
                                                        ELSE (hs[i] * 31 + hs[i + 1]) % 4294967296 END) AS r
  FROM lines),
cuts AS (
  SELECT *, list_filter(range(0, len(ls)), lambda i: i = 0 OR (r[i + 1] < r[i] AND r[i + 1] <= coalesce(r[i + 2], 1099511627776))) AS starts
  FROM rolled),
chunks AS (SELECT doc_id, ls, ws, unnest(starts) AS a, unnest(list_append(starts[2:], len(ls))) AS b FROM cuts),
flat AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line, unnest(ws) AS w FROM lines),
summed AS (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM flat),
words AS (SELECT doc_id, i, unnest(range(upto - w, upto)) AS k FROM summed),
pieces AS (
  SELECT doc_id, a, b - a AS n FROM chunks WHERE b - a > 1 AND list_sum(ws[a + 1 : b]) > 0
  UNION SELECT s.doc_id, s.i, e.i - s.i + 1 FROM summed s JOIN words e ON e.doc_id = s.doc_id AND e.k = s.upto - s.w + 49
  UNION SELECT s.doc_id, b.i, s.i - b.i + 1 FROM summed s JOIN words b ON b.doc_id = s.doc_id AND b.k = s.upto - 50),
texts AS (SELECT p.*, array_to_string(ls[a + 1 : a + n], chr(10)) AS piece FROM pieces p JOIN lines USING (doc_id)),
firsts AS (SELECT piece, n, min((doc_id, a)) AS f FROM texts GROUP BY piece, n),
gone AS (
  SELECT DISTINCT t.doc_id, unnest(range(t.a, t.a + t.n)) AS i FROM texts t JOIN firsts USING (piece, n)
  WHERE (t.doc_id, t.a) <> f AND NOT (t.doc_id = f[1] AND t.a < f[2] + t.n)),
merged AS (
  SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY f.i) FILTER (g.i IS NULL), '') AS kept
  FROM flat f LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(length(kept) AS BIGINT) AS n_chars, md5(kept) AS text_md5
FROM documents LEFT JOIN merged USING (doc_id)
"""


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


ORACLE_SQL["op8_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
tests AS (
  SELECT DISTINCT item, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(0, len(w) - 9), lambda i: w[i + 1 : i + 10]) END) AS win
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM tests),
seen AS (SELECT rid, n, w, unnest(range(0, len(w) - n + 1)) AS p FROM d CROSS JOIN sizes),
hits AS (
  SELECT rid, p, n, item
  FROM (SELECT rid, p, n, array_to_string(w[p + 1 : p + n], ' ') AS k FROM seen) JOIN (SELECT item, array_to_string(win, ' ') AS k FROM tests) USING (k)),
covered AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hits) GROUP BY rid),
listed AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)
"""


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Settings(k=2))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL["op4_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                               ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words),
flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
  WHERE 100 * c >= 80 * (len(p.s) + len(q.s) - c)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM sym UNION SELECT r.x, b.y FROM reach r JOIN sym b ON r.y = b.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM sets LEFT JOIN least ON x = doc_id
"""


@query
def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL["op2_vector_search"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""


def vocabulary(name: str) -> str:
    """A public tokenizer's file; it is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_files.read_index(spark, path)


@query
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, check="round_trip")
    numbers = F.crc32(F.array_join("ids", " ").cast("binary"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), numbers.alias("ids_crc32"), "round_trip")


@query
def op11_nearest_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_graph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.spelling_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


ORACLE_SQL["op12_spelling_variants"] = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
places AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, c, {CRC} AS h FROM places, tab),
forms AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM forms WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cuts AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
dels AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM cuts),
holes AS (SELECT word, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) AS hole FROM cuts),
near AS (
  SELECT a.word AS a, b.word AS b FROM holes a JOIN holes b USING (hole) WHERE a.word <> b.word
  UNION ALL SELECT d.word, w.word FROM dels d JOIN words w ON w.word = d.d
  UNION ALL SELECT w.word, d.word FROM dels d JOIN words w ON w.word = d.d),
ranked AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r, count(*) OVER (PARTITION BY a) AS m FROM near JOIN words ON word = b),
led AS (
  SELECT w.word, w.n, CAST(coalesce(m, 0) AS BIGINT) AS n_near, CASE WHEN r.n >= 2 * w.n THEN b END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON a = w.word AND r = 1),
way(word, here) AS (SELECT word, word FROM led UNION SELECT way.word, form FROM way JOIN led ON led.word = way.here WHERE form IS NOT NULL),
ends AS (SELECT way.word, here AS root FROM way JOIN led ON led.word = way.here WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM led JOIN ends USING (word)
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(table(spark, sf_dir, "conversations"), damaging=True)


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _way(cost: str, to: str, letter: str, line: str = "") -> str:
    lines = f"list_concat([{line}], {to}.t)" if line else f"{to}.t"
    return f"{{'c': {cost} + {to}.c, 'a': '{letter}' || {to}.a, 't': {lines}}}"


def _insert(inner: str) -> str:
    """Each state's best way with one more inserted row before what ``inner`` has."""
    user, assistant = _way("3", "v2", "I", "'user:'"), _way("3", "v3", "I", "'assistant:'")
    return f"SELECT k, i, {_least('v0', user)} AS v0, {_least('v1', user)} AS v1, {_least('v2', assistant)} AS v2, {_least('v3', user)} AS v3 FROM ({inner})"


def _row(state: int) -> str:
    """The best way from a state over the row ``r``: deleted, reroled or kept."""
    to, role = ("v3", "assistant") if state == 2 else ("v2", "user")
    none = "{'c': 1000000000, 'a': '', 't': ['']}"
    change = _way("3 + r.more", to, "R", f"'{role}:' || r.text")
    keep = [f"CASE WHEN r.must OR r.initial <> '{role[0]}' THEN {none} ELSE {_way('r.more', to, 'K', 'r.line')} END"]
    if state == 0:
        keep.append(f"CASE WHEN r.must OR r.initial <> 's' THEN {none} ELSE {_way('r.more', 'v1', 'K', 'r.line')} END")
    return _least(_way("4", f"v{state}", "D"), f"CASE WHEN r.must THEN {none} ELSE {change} END", *keep)


_END = "{'c': 0, 'a': '', 't': []::VARCHAR[]}"
_NEVER = "{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}"
_OVER = ", ".join(f"{_row(s)} AS v{s}" for s in range(4))
ORACLE_SQL["op13_conversation_repair"] = rf"""
WITH RECURSIVE {CRC_TABLE},
given AS (
  SELECT coalesce('+' || CAST(conv_id AS VARCHAR), '-') AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s
  FROM conversations),
hashed AS (SELECT given.*, {CRC} % 20 AS h FROM given, tab),
hurt AS (
  SELECT k, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM hurt),
seen AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut, min(i) OVER (PARTITION BY k, role, text) AS first,
         lag(role) OVER (PARTITION BY k ORDER BY i) AS before FROM placed),
judged AS (
  SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN first < i THEN 'duplicate' WHEN NOT regexp_matches(right(cut, 1), '[.!?]') THEN 'truncated' ELSE '' END AS fault FROM seen),
rows AS (
  SELECT k, i, text, role || ':' || text AS line, substr(role, 1, 1) AS initial, fault IN ('blank', 'duplicate') AS must,
         CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more
  FROM judged),
stats AS (
  SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY k),
walk AS (
  {_insert(_insert(f"SELECT k, n AS i, {_END} AS v0, {_NEVER} AS v1, {_NEVER} AS v2, {_END} AS v3 FROM stats"))}
  UNION ALL
  {_insert(_insert(f"SELECT w.k, w.i - 1 AS i, {_OVER} FROM walk w JOIN rows r ON r.k = w.k AND r.i = w.i - 1"))}),
heads AS (SELECT DISTINCT k, conv_id FROM given)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(v0.c, 0) AS BIGINT) AS cost,
       coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.t, chr(10)), '')) AS repaired_sha256
FROM heads LEFT JOIN stats USING (k) LEFT JOIN (SELECT * FROM walk WHERE i = 0) USING (k)
"""
