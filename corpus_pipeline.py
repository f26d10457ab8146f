"""A corpus pipeline: toxic documents go, common lines go, near copies go, sources are mixed to weights, and tokens are packed.

Each stage takes the columns of documents, in any types of theirs, and all but the last return them; every stage gives
no rows for no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratefield.llm import line_dedup, mixing, ngram_join, packing, toxicity
from ratefield.llm.common import Scratch, documents

#: Rows that go are broadcast up to this number (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 21


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go.

    Each row is judged by its text alone: repeated rows stay or go together, a null or empty text has no toxic
    neighbours and stays, a null id doesn't matter.
    """
    own = {c: f"{c} of the row" for c in docs.columns if c in ("predicted", "score", "nearest", "cosines")}
    scored = toxicity.score(docs.withColumnsRenamed(own), toxicity.fit_tables(spark, sf_dir))
    return scored.filter("predicted = 0").select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all; n_chars follows.

    A document with no line left stays, empty; a null text stays null, with n_chars 0. Repeated rows count as documents each.
    """
    out = line_dedup.drop_common_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: the least by doc_id (null last), then by the hash of id and text.

    Of rows with one id and text one stays. Rows without words (null or empty text) belong to no group and all stay.
    """
    near = ngram_join.similar_documents(docs).filter("n_shingles > 0").select("row", "keeper")
    near = Scratch(spark, "near").table(near, "near", narrow=True)
    gone, again = near.filter("row <> keeper").select("row").distinct(), near.filter("row = keeper").groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row")
    few = near.filter("row <> keeper").count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    left = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("doc_id", "text").alias("row")).join(small(gone), "row", "left_anti")
    if again.isEmpty():
        return left.select("doc.*")
    single = left.join(again, "row", "left_anti").unionByName(left.join(again, "row", "left_semi").dropDuplicates(["row"]))
    return single.select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words are taken by block until each source has its target; a row for each copy of a document.

    Documents of which nothing is taken go, as do those without words; repeated rows and null ids are mixed each.
    """
    return mixing.mixed_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 1024; null and empty texts are the end id alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Mixing's keyed permutations and packing's token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder: the packed pieces, a table in the shared folder.

    Each stage's rows are written and reread; what a stage and its operators have written besides is deleted when the
    next table stands.
    """
    docs, table = documents(spark, sf_dir), None
    for name, stage in STAGES:
        before = list(Scratch.made)
        out = stage(spark, docs, sf_dir)
        new = Scratch(spark, f"pipeline-{name}")
        docs = new.table(out, "rows")
        for left in [s for s in Scratch.made if s not in before and s is not new] + [table] * (table is not None):
            left.drop()
        table = new
    return docs
