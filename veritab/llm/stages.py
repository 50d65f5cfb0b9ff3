"""The corpus pipeline's stages. Each takes (spark, docs, sf_dir); all but packing return the columns of docs, whatever
their names, and give no rows for an empty table. Columns other than doc_id, text and lang are carried along unread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import language_id, packing, quality_classifier, similar_copies
from veritab.llm._common import materialise, table

#: A language whose tempered posterior is below this is not taken as identified.
LEAST_LANGUAGE_SCORE = 0.5
#: The quality model learns from about so many labelled documents at most, chosen by a hash of doc_id.
LABELLED_DOCS = 50_000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no name of theirs meets one of ours."""
    return F.struct(*map(quoted, docs.columns))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; null texts and texts without letters go.

    Where no document has a language tag nothing can be learned, and every document with a letter stays. A null doc_id is
    never learned from; repeated rows stay repeated."""
    trees = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    if not trees:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = docs.select(whole_row(docs).alias("doc"), language_id.language_of(F.col("text"), trees).alias("found"))
    kept = found.where((F.col("found.lang_pred") != language_id.UNDETERMINED) & (F.col("found.score") >= LEAST_LANGUAGE_SCORE))
    return kept.select("doc.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score the quality threshold or more under a model of the labelled ones.

    Null and empty texts score as a text whose statistics are zero. Where no document has a label every score is 0.5, and
    all stay. Repeated rows stay repeated, and each counts in training; a null label is no label."""
    labels = table(spark, sf_dir, "labels")
    n = labels.count()
    learned = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 20)) < (1 << 20) * min(1.0, LABELLED_DOCS / max(1, n)))
    model = quality_classifier.train(learned.select("doc_id", quality_classifier.text_statistics(F.col("text")).alias("stats")), labels)
    return docs.where(quality_classifier.scorer(model)(quality_classifier.text_statistics(F.col("text"))) >= quality_classifier.THRESHOLD)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share 0.8 of their five-word shingles: the one with the least doc_id, rows
    without doc_id last; of several texts with that doc_id the one with the least hash, and of several rows with that text
    the one whose whole row has the least hash.

    Each group keeps one row whatever its ids, so rows without doc_id and unrelated texts under one doc_id all stay. Null
    and empty texts and texts without words are one group."""
    _, placed = similar_copies.similar_classes(docs.select("doc_id", "text"), ids=False)
    least = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "cls")).alias("least")
    chosen = materialise(placed.groupBy("root").agg(least).select(F.col("least.first").alias("_id"), F.col("least.cls").alias("_chosen")))
    whole = F.xxhash64(*[F.col(f"doc.{quoted(c)}") for c in docs.columns])
    keyed = docs.select(whole_row(docs).alias("doc"), F.col("doc_id").alias("_key"), similar_copies.class_of(F.col("text")).alias("_class")).withColumn("_row", whole)
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_class") == F.col("_chosen"))
    rows = similar_copies.among(keyed.select("_key", "_class", "_row"), chosen, same)
    one = materialise(rows.groupBy("_key", "_class").agg(F.min("_row").alias("_least"), F.count("*").alias("_n")).toDF("_id", "_chosen", "_least", "_n"))
    pick = same & (F.col("_row") == F.col("_least"))
    kept = similar_copies.among(keyed, one.where("_n = 1"), pick).select("doc.*")
    several = one.where("_n > 1")
    if several.isEmpty():
        return kept
    return kept.unionAll(similar_copies.among(keyed, several, pick).dropDuplicates(["_class", "_row"]).select("doc.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' packed sequences; a null or empty text is its end id alone, repeated rows are packed
    each, and an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [("language ID", keep_identified), ("quality classifier", keep_good), ("SimHash near-dedup", keep_one_of_each), ("packing", pack)]
