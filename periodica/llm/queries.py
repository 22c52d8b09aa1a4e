"""Keyed queries of the numbered operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.llm import (
    decontaminate,
    dialogue_repair,
    filter_audit,
    html_text,
    mixing,
    neighbours,
    personal_data,
    quality,
    repeats,
    sharding,
    simhash,
    token_counts,
    toxicity,
)
from periodica.llm.common import table


def op1_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.with_token_counts(docs, vocabulary, public_tokenizers.PATTERN, ("text",))


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id", "n_links")


def op3_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    drawn = mixing.mix_without_texts(docs)
    return drawn.select("row.doc_id", "row.source", "row.lang", "topic", "tokens", F.round("probability", 6).alias("probability"))


def op4_boosted_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.with_main_text(pages, html_text.fit(pages))


def op5_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_severity(docs, model, drop=("text",))


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_scores(docs, model, drop=("text",))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op7_previous_factor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.count_hits(
        decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    )


def op10_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.with_shards(docs).drop("text")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data.count_kinds(personal_data.with_personal_data(docs, drop=("text",)))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.filter_interactions(docs, table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return dialogue_repair.repair_report(conversations, dialogue_repair.damage(conversations))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
#: Every window of an item against every place of a document that has as many words.
_OP9 = f"""
WITH items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g
 FROM (SELECT item, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
  FROM (SELECT item, ws, least(10, len(ws)) AS k FROM items WHERE len(ws) > 0))),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
places AS (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g
 FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows))),
hits AS (SELECT r, i, k, item FROM places JOIN windows USING (k, g)),
counted AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS found
 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 coalesce(found, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN counted USING (r) LEFT JOIN named USING (r)"""

#: (kind, pattern, what a match has to pass); the place of a match follows from the lengths of the pieces between.
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_DIGIT = f"CAST(substr({_DIGITS}, len({_DIGITS}) - j, 1) AS INTEGER)"
_LUHN = (
    f"list_sum([CASE WHEN j % 2 = 0 THEN {_DIGIT} ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][{_DIGIT} + 1] END "
    f"FOR j IN range(0, len({_DIGITS}))]) % 10 = 0"
)
_OVER = "len(ltrim(n, '0')) > 3 OR CAST(concat('0', right(n, 3)) AS INTEGER) > 255"
_MATCHES = {
    "email": (personal_data.BASE["email"], "true"),
    "ip": (personal_data.BASE["ip"], f"len(list_filter(string_split(m, '.'), lambda n: {_OVER})) = 0"),
    "card": (personal_data.BASE["card"], f"len({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": (personal_data.BASE["phone"], f"len({_DIGITS}) BETWEEN 9 AND 15"),
    "address": (personal_data.ADDRESS, "true"),
    "account": (personal_data.ACCOUNT, "true"),
}


def _found(number: int, kind: str) -> str:
    pattern = "'" + _MATCHES[kind][0].replace("'", "''") + "'"
    return (
        f"SELECT r, {number} AS k, '{kind}' AS kind, regexp_extract_all(t, {pattern}) AS ms, string_split_regex(t, {pattern}) AS ps FROM docs "
        f"WHERE regexp_matches(t, {pattern})"
    )


#: The identifier stands at the end of its match. Of one that begins like an IBAN, the longest run of groups with a right checksum counts.
_IDENTIFIER = "regexp_extract(m, '" + personal_data.ACCOUNT.replace("'", "''") + "', 1)"
_BARE = "replace(g, ' ', '')"
_VALUE = "CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INTEGER) ELSE ascii(c) - 55 END"
_CHECKSUM = (
    f"list_reduce([0] || [{_VALUE} FOR c IN string_split(concat({_BARE}[5:], {_BARE}[1:4]), '')], "
    "lambda a, b: (a * (CASE WHEN b > 9 THEN 100 ELSE 10 END) + b) % 97) = 1"
)
_OP11 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
matched AS ({" UNION ALL ".join(_found(i, k) for i, k in enumerate(_MATCHES))}),
placed AS (SELECT r, k, kind, ms[i] AS m,
  list_sum([len(p) FOR p IN ps[1:i]]) + coalesce(list_sum([len(p) FOR p IN ms[1:i - 1]]), 0) AS place
 FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM matched)),
base AS (SELECT r, k, kind, place AS a, place + len(m) AS b FROM placed WHERE CASE kind {" ".join(f"WHEN '{k}' THEN {t}" for k, (_, t) in _MATCHES.items() if k != "account")} END),
named AS (SELECT *, place + len(m) - len(g) AS a, string_split(g, ' ') AS gs FROM (SELECT *, {_IDENTIFIER} AS g FROM placed WHERE kind = 'account')),
accounts AS (SELECT r, k, kind, a, a + len(CASE WHEN regexp_matches({_BARE}, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{8,}}')
  THEN list_filter([array_to_string(gs[1:len(gs) - j], ' ') FOR j IN range(0, len(gs))], lambda g: regexp_full_match({_BARE}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{8,}}') AND {_CHECKSUM})[1]
  ELSE g END) AS b FROM named),
spans AS (SELECT r, k, a, concat(kind, ':', a, ':', b) AS s FROM base UNION ALL SELECT r, k, a, concat(kind, ':', a, ':', b) FROM accounts WHERE b IS NOT NULL),
listed AS (SELECT r, {", ".join(f"count(*) FILTER (k = {i}) AS n_{k}" for i, k in enumerate(personal_data.BASE))},
  string_agg(s, ',' ORDER BY a, k) FILTER (k < 4) AS base, string_agg(s, ',' ORDER BY a, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in personal_data.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (r)"""

#: Every order and step is counted from the rows, none from the counts of sets.
_OP12 = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
counted AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, len(regexp_extract_all(t, '[A-Z]')) AS caps, length(t) AS points FROM docs),
firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
rows AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * caps > 5 * points, regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
 FROM counted JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM rows GROUP BY part, fails),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
 WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT array_to_string([substr('ABCDE', i, 1) FOR i IN o], '') AS filter_order, s AS step, o[s] AS own, o[1:s - 1] AS before
 FROM orders, (SELECT unnest(range(1, 6)) AS s)),
marked AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fail, len(list_filter(before, lambda i: fails[i])) > 0 AS gone,
  len(list_filter(fails, lambda f: f)) = 1 AS one FROM cells, steps),
summed AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (fail AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fail AND one), 0) AS unique_fails,
  coalesce(sum(good) FILTER (fail AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fail AND NOT gone), 0) AS toxic_lost
 FROM marked GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
 CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
 CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed"""

#: All edits of all rows, forward, the least (cost, audit) kept for each state of the grammar; CRC-32 is folded bit by bit.
_OP13 = r"""
WITH RECURSIVE spoken AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name FROM conversations),
hashed AS (SELECT *, xor(list_reduce([4294967295] || flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(name, '')]),
  lambda h, b: CASE WHEN b >= 0 THEN xor(h, b) ELSE xor(h >> 1, 3988292384 * (h & 1)) END), 4294967295) % 20 AS hit FROM spoken),
damaged AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(0, CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(concat(role, ':', text)), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged),
rows AS (SELECT conv_id, turn, role, text, i, role[1] AS initial,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
inserts(q, letters, lines, q2) AS (VALUES (0, '', CAST([] AS VARCHAR[]), 0), (0, 'I', ['user:'], 2), (0, 'II', ['user:', 'assistant:'], 3),
  (1, '', [], 1), (1, 'I', ['user:'], 2), (1, 'II', ['user:', 'assistant:'], 3), (2, '', [], 2), (2, 'I', ['assistant:'], 3),
  (2, 'II', ['assistant:', 'user:'], 2), (3, '', [], 3), (3, 'I', ['user:'], 2), (3, 'II', ['user:', 'assistant:'], 3)),
edits(q, letter, initial, role, q2, cost) AS (VALUES (0, 'K', 's', NULL, 1, 0), (0, 'K', 'u', NULL, 2, 0), (1, 'K', 'u', NULL, 2, 0), (2, 'K', 'a', NULL, 3, 0),
  (3, 'K', 'u', NULL, 2, 0), (0, 'R', NULL, 'user', 2, 3), (1, 'R', NULL, 'user', 2, 3), (2, 'R', NULL, 'assistant', 3, 3), (3, 'R', NULL, 'user', 2, 3),
  (0, 'D', NULL, NULL, 0, 4), (1, 'D', NULL, NULL, 1, 4), (2, 'D', NULL, NULL, 2, 4), (3, 'D', NULL, NULL, 3, 4)),
names AS (SELECT conv, count(r.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND concat(before, initial) NOT IN ('su', 'ua', 'au')) AS illegal
 FROM (SELECT DISTINCT conv_id AS conv FROM conversations) c LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM c.conv GROUP BY conv),
walk AS (SELECT DISTINCT conv_id AS conv, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS best FROM conversations
 UNION ALL
 SELECT w.conv, w.i + 1, e.q2, min({'cost': CAST(w.best.cost + 3 * len(s.letters) + e.cost + CASE WHEN r.fault = 'truncated' AND e.letter <> 'D' THEN 3 ELSE 0 END AS BIGINT),
  'audit': concat(w.best.audit, s.letters, e.letter),
  'lines': w.best.lines || s.lines || CASE WHEN e.letter = 'D' THEN [] ELSE [concat(coalesce(e.role, r.role), ':', r.text)] END})
 FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv AND r.i = w.i + 1 JOIN inserts s ON s.q = w.q
  JOIN edits e ON e.q = s.q2 AND (e.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (e.letter <> 'K' OR e.initial = r.initial)
 GROUP BY w.conv, w.i, e.q2),
ended AS (SELECT conv, w.i, min({'cost': CAST(best.cost + 3 * len(s.letters) AS BIGINT), 'audit': concat(best.audit, s.letters), 'lines': best.lines || s.lines}) AS best
 FROM walk w JOIN inserts s ON s.q = w.q AND s.q2 IN (0, 3) GROUP BY conv, w.i)
SELECT n.conv AS conv_id, gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit,
 sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM names n JOIN ended e ON e.conv IS NOT DISTINCT FROM n.conv AND e.i = n.n"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {"op9_benchmark_decontamination": _OP9, "op11_personal_data": _OP11, "op12_filter_interactions": _OP12, "op13_conversation_repair": _OP13}
