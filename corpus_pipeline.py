"""From raw documents to packed training sequences: five stages, each an operator of trendloom.llm."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import exact_dedup, mixing, ngram_join, packing, quality
from trendloom.llm.queries import table, tokenizer_path
from trendloom.llm.shared import maybe_in, stored


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; it learns from the table labels."""
    columns = docs.columns
    name = "quality_scores" + "_" * max(map(len, columns))
    scored = quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")), name=name)
    return scored.where(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.exact_classes(docs, keep_row=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles with similarity 0.8 or more: that of the least doc_id, then text hash; null ids last.

    Rows count by themselves, whether their ids repeat, with whatever texts, or are
    null; of rows equal in id and text one is kept.  Documents without words stay.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    classes = ngram_join.near_classes(docs, ngram_join.Rule(words=5, percent=80), first_of=True).where("n_shingles > 0")
    key = ["doc_id", "text_hash"]
    gone = stored(classes.where("NOT first").select(*key).distinct(), "gone")
    again = stored(classes.where("first").groupBy(*key).count().where("count > 1").select(*key), "again")
    end = "_" * max(map(len, docs.columns))
    flag, id_, hash_ = f"maybe_gone{end}", f"id{end}", f"hash{end}"
    hashed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(hash_, F.xxhash64(F.col("text").cast("string")))
    # Most rows surely stay and are not moved; only the others meet the lists, unless they are surely new.
    listed = gone.union(again)
    tested = maybe_in(hashed, F.xxhash64(id_, hash_), listed.select(F.xxhash64(*key)), flag, listed.count())
    sure, unsure = tested.where(~F.col(flag)), tested.where(F.col(flag))

    def met(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).hint("shuffle_hash")
        # The hash alone is an equality that the join can deal by; null ids meet null ids.
        return unsure.join(keys, (F.col(hash_) == F.col("__hash")) & F.col(id_).eqNullSafe(F.col("__id")), how)

    out = sure.unionByName(met(listed, "left_anti"))
    if again.count():
        rows = met(again, "left_semi").select(id_, hash_, F.struct(*columns).alias("row"))
        out = out.select(*columns).unionByName(rows.groupBy(id_, hash_).agg(F.first("row").alias("row")).select("row.*"))
    return out.select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair schedule of their sources' blocks."""
    mixed = mixing.mix(docs, mixing.tempered_weights(docs), keep_row=True)
    return mixed.orderBy("slot", "place").select("row.*")


def _row_order(docs: DataFrame) -> Column | None:
    """Place of a row in a table of Parquet files that a sort has written: the file's number, then the row's; None for any other table."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return None
    number = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    return F.shiftleft(number, 40) + F.col("_metadata.row_index")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 1024 tokens; by ``sequence_order`` these follow the mixture, the order in which docs is written."""
    return packing.pack(docs, tokenizer_path(), order=_row_order(docs))


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the packing cannot be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
