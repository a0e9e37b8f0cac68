"""A corpus pipeline: five stages, each over all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

Nulls: a document without doc_id or text goes through every stage by the rules
of the operators (null text: no toxic word, one empty line, no shingle, size 0,
so that the mix never takes it).  Extra columns of ``docs`` are dropped; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.shared import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of at least ``REJECT``.

    A score of exactly ``REJECT`` goes.  Texts of any length are scored whole;
    null and empty ones have no toxic word and stay; repeated rows score alike
    and go or stay together; an empty table gives an empty one."""
    from wordloom.llm.toxicity import score_toxicity

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_toxicity(docs, docs, labels, carry=COLUMNS[2:], with_text=True)
    return out.where(F.col("score") < REJECT).select("doc_id", "text", "carried.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three documents or more share but for the last one.

    Every document stays, one whose lines all go as an empty text; null texts
    become empty; ``n_chars`` is counted anew.  Rows that tie for the largest
    doc_id of a line all keep it, so repeated rows lose the same lines; texts
    may have any length; an empty table gives an empty one."""
    from wordloom.llm.line_dedup import drop_shared_lines

    out = drop_shared_lines(docs, carry=("lang", "source"))
    text = F.col("kept_text")
    return out.select("doc_id", text.alias("text"), "carried.lang", "carried.source", F.length(text).cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Rows that share a doc_id are one document, of which the first by a hash of
    its text stays, so repeated rows become one; rows without a doc_id are
    linked with nothing and all stay, and so do texts without a word.  Texts
    may have any length; an empty table gives an empty one."""
    from wordloom.llm.bloom import split_by_names
    from wordloom.llm.minhash_join import near_duplicates

    found = materialize(near_duplicates(docs, percent=80), "near")
    gone = found.where("not kept").select("doc_id").distinct()
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    # Texts that surely stay are left where they are; the others meet the ids.
    named = docs.select(*COLUMNS, F.xxhash64("doc_id").alias("name"))
    split = split_by_names(named, materialize(gone.union(again).select(F.xxhash64("doc_id").alias("name")).distinct(), "named"))
    stay = split.where("not maybe").select(*COLUMNS)
    open_rows = split.where("maybe").join(gone, "doc_id", "left_anti")
    # Rows that share a doc_id are one document: the first by a hash stays.
    by = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", "lang", "source")
    first = open_rows.where("doc_id is not null").withColumn("nth", F.row_number().over(by)).where("nth = 1")
    return stay.unionByName(open_rows.where("doc_id is null").select(*COLUMNS)).unionByName(first.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources says (0 to 2 times).

    Texts without a word have size 0 and are never taken; a null source is a
    source.  Rows that agree in id, source and size are told apart by a running
    number in the order of their texts' hashes, so ties and repeated rows are
    taken alike in each run.  Texts may have any length; an empty table gives
    an empty one."""
    from wordloom.llm.mixing import mix_sources, taken_rows

    mixed = materialize(mix_sources(docs).select("doc_id", "source", "size", "twin", "copies"), "mixed")
    chosen = taken_rows(docs.select(*COLUMNS), mixed)
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what the mix took into sequences of at most 4096 tokens.

    A row for each piece, as ``pack_documents`` returns it: long texts are cut,
    null and empty ones are their end token alone, repeated rows are packed
    each for itself, and equal lengths go by doc_id and piece."""
    import public_tokenizers

    from wordloom.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("packing", packing),
]

#: The toxicity model, the cube method and best-fit packing aren't expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
