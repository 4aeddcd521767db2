"""A corpus made ready for training, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import boilerplate, decontaminate, jaccard_join, language, packing
from palimpsest.llm.queries import tokenizer_file
from palimpsest.llm.shared import stored, table

#: A document is in no language that the labels know if fewer than this share of its words, less SLACK words, are like
#: the learned ones.  However evenly its languages share a text, it stays.
LEAST_LIKE, SLACK = 0.5, 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or of no known language, go.  The model learns from the labelled documents."""
    model = language.train(docs)
    held = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    found = language.identify(held, model, extra=["_row"])
    return found.where((F.col("lang_pred") != "und") & (F.col("n_like") + SLACK >= LEAST_LIKE * F.col("n_words"))).select("_row.*")


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines; ``n_chars`` follows a changed text.  No document goes.

    Copies of a page count once, so that the next stage finds one of them with its text.
    """
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return boilerplate.drop_boilerplate(docs, copies_once=True).select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id (a null one is the largest), once.

    A document is an id with a text, so that other texts under one id, and rows
    without an id, are documents of their own.  Rows without words have no links
    and all stay.
    """
    classes = jaccard_join.jaccard_classes(docs)
    stays = classes.where("n = 0 or (first.id = id and first.th = th)").select("id", "th", F.expr("n > 0").alias("linked"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(jaccard_join.NO_ID)).alias("id"), F.xxhash64("text").alias("th"), F.struct("*").alias("row"))
    found = rows.join(stays, ["id", "th"])
    apart = F.when(~F.col("linked"), F.monotonically_increasing_id())
    others = [F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = Window.partitionBy("id", "th", "apart").orderBy(F.xxhash64(*others))
    return found.withColumn("apart", apart).withColumn("place", F.row_number().over(one)).where("place = 1").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    return decontaminate.mark_contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan of the documents that are left."""
    return packing.pack_certified(packing.token_pieces(docs, tokenizer_file("word_bpe_49k.json"))).drop("salt")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_site_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: A conditional random field and a packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
