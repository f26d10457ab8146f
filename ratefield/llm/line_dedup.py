"""Lines that many documents share are dropped from every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratefield.llm.common import BLANKS, UPPER, Scratch, documents


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _fold(key: Column) -> Column:
    """A-Z in lower case; lower() does that at once where all is ASCII."""
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, UPPER.lower()))


def line_hashes(text: Column) -> Column:
    """For each line of a text the hash (96 bits) of its key, null for an empty key. The key: blanks stripped at both ends, A-Z lower-cased."""
    keys = F.transform(F.transform(_lines(text), lambda x: F.btrim(x, F.lit(BLANKS))), _fold)
    return F.transform(keys, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("a"), F.hash(k).alias("b"))))


#: Common lines up to this number are broadcast (12 bytes of hash each); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def drop_common_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Explode the normalised lines, count documents per hash, drop lines at or over min_docs, and reassemble by position.

    Returns the columns of docs with the kept text in text_col, and n_lines and n_dropped (of the text as given).
    A null or empty text is one empty line and stays null or empty. Every row counts as one document, so repeated
    rows count each; rows with equal or null ids don't disturb each other, as a common line is dropped wherever it is.
    Long texts are read whole, no rows give no rows. Columns of docs named n_lines or n_dropped are replaced; others may
    have any name.
    """
    docs = docs.drop("n_lines", "n_dropped")
    scratch = Scratch(docs.sparkSession, "lines")
    seen = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.array_distinct(F.filter(line_hashes(F.col(f"`{text_col}`")), F.isnotnull))).alias("h"))
    # lines are hashed once for counting; equal ones are added up before they are dealt out
    common = scratch.table(seen.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("h"), "common", narrow=True)
    few = common.count() <= BROADCAST_ROWS
    mine = seen.join(F.broadcast(common) if few else common, "h", "left_semi").groupBy("id").agg(F.collect_set("h").alias("common"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("own"))
    both = whole.join(mine, F.col("own").eqNullSafe(F.col("id")), "left")
    text, gone = F.col(f"doc.`{text_col}`"), F.col("common")
    marked = F.arrays_zip(_lines(text).alias("line"), line_hashes(text).alias("h"))
    kept = F.when(gone.isNull(), _lines(text)).otherwise(F.transform(F.filter(marked, lambda x: x["h"].isNull() | ~F.array_contains(gone, x["h"])), lambda x: x["line"]))
    out = both.select("doc", kept.alias("kept"), F.size(_lines(text)).cast("long").alias("n_lines"))
    joined = F.when(text.isNotNull(), F.array_join("kept", "\n"))
    columns = [(joined if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns]
    return out.select(*columns, "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    out = drop_common_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, lines, list_transform(lines, lambda l: translate(trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM d),
common AS (SELECT key FROM (SELECT doc_id, unnest(list_distinct(keys)) AS key FROM k) WHERE length(key) >= 1
  GROUP BY key HAVING count(*) >= 10),
p AS (SELECT doc_id, unnest(lines) AS line, unnest(keys) AS key, generate_subscripts(lines, 1) AS i FROM k),
j AS (SELECT p.doc_id, i, line, common.key IS NOT NULL AS gone FROM p LEFT JOIN common ON p.key = common.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
