"""SQL of the corpus queries: whole where SQL can give all columns, else of the columns that it can give, with queries of these alone."""

from __future__ import annotations

from ratefield.llm import decontaminate, line_dedup, mixing, quality, secrets, toxicity, trie

WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
FOLD_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links by counting common shingles, and what each document reaches by them.
NGRAM_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format(FOLD_SQL)} AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS s FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.node)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.node) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

TARGETS_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS_SQL.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
c AS (SELECT *, CAST(1 + i % 3 AS DOUBLE) AS w, 3 * source_size AS cap, 3 * source_size / (1 + i % 3) AS room FROM s),
u AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS rest FROM c
  WINDOW before AS (ORDER BY room, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(cap, coalesce(max(CASE WHEN rest <= room THEN rest END) OVER (), 0) * w) AS target FROM u)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

BASE_QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL.format("coalesce(text, '')")} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM i),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r ON r.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
"""


def _spans_sql(kind: int) -> str:
    name, pattern, group, least, _ = secrets.KINDS[kind]
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {kind} AS k, '{name}' AS name, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
  a := CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT), n := length(m[i]), g := length(g[i]))), lambda x: x.g >= {least})) AS x
 FROM (SELECT doc_id, string_split_regex(t, {quoted}) AS b, regexp_extract_all(t, {quoted}, 0) AS m, regexp_extract_all(t, {quoted}, {group}) AS g FROM d)"""


BASE_SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans_sql(k) for k in range(3))}),
j AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg(name || ':' || x.a || ':' || (x.a + x.n), ',' ORDER BY x.a, k) AS l FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(l, '')) AS base_sha256 FROM d LEFT JOIN j ON j.doc_id = d.doc_id
"""

#: crc32 by its definition, a bit at a time.
FOLDS_SQL = """
SELECT doc_id, list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], list_transform(range(8), lambda z: CAST(0 AS UBIGINT))), lambda v, z: xor(v >> 1, (v & 1) * CAST(3988292384 AS UBIGINT)))) % 4 = 1 AS held_out
FROM documents
"""

ORACLES = {
    "op2_ngram_jaccard_join": NGRAM_SQL,
    "op7_line_dedup": line_dedup.ORACLE,
    "op11_benchmark_decontamination": decontaminate.ORACLE,
    "op12_conversation_trie": trie.ORACLE,
    "base_mixing_targets": TARGETS_SQL,
    "base_quality_measures": BASE_QUALITY_SQL,
    "base_secret_spans": BASE_SECRETS_SQL,
    "base_toxicity_folds": FOLDS_SQL,
}


def _targets(spark, sf_dir):
    from pyspark.sql import functions as F

    return mixing.query(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


#: Columns of the operators' queries that SQL can give.
QUERIES = {
    "base_mixing_targets": _targets,
    "base_quality_measures": lambda spark, sf_dir: quality.query(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "base_secret_spans": lambda spark, sf_dir: secrets.query(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"),
    "base_toxicity_folds": lambda spark, sf_dir: toxicity.query(spark, sf_dir).select("doc_id", "held_out"),
}
