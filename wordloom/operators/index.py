"""Lexicon and postings of a corpus, and word lookup in them.

Both are plain tables.  ``written`` keeps the postings sorted by word and the
lexicon sorted by each of its four keys, so that a prefix or suffix search,
raw or folded, reads few row groups of one copy of the lexicon and then only
those folders of postings that hold the words found.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.folding import fold, fold_text
from wordloom.functions.text import WordPattern, next_string, regular, wildcard, words
from wordloom.operators.filters import let
from wordloom.sources.kept import kept, shared_folder


def _held(own: Column) -> Column:
    """A text's words as an array of (``word, positions``): places are sorted
    by word once and cut where the word changes."""

    def cut(line: Column) -> Column:
        firsts = F.array_compact(F.transform(line, lambda x, i: F.when((i == 0) | (F.get(line, i - 1)["word"] != x["word"]), i)))

        def one(firsts: Column) -> Column:
            def run(a: Column, j: Column) -> Column:
                size = F.coalesce(F.get(firsts, j + 1), F.size(line)) - a
                places = F.transform(F.slice(line, a + 1, size), lambda x: x["pos"])
                return F.struct(F.get(line, a)["word"].alias("word"), places.alias("positions"))

            return F.transform(firsts, run)

        return let(firsts, one)

    return let(F.sort_array(F.transform(own, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))), cut)


def postings(docs: DataFrame, text: str = "text", key: str = "doc_id", structure: Column | None = None) -> DataFrame:
    """(``word``, key, ``structure``, ``n_occ``, ``positions``): a row for each
    different word of a document and structure.

    A row of ``docs`` holds its own postings, so they are made where it is read
    and not shuffled; only ids are, to find those that several rows share, whose
    postings are joined."""
    rows = docs.select(key, F.lit(0).alias("structure") if structure is None else structure.alias("structure"), F.col(text).alias("_text"))
    again = kept(rows.groupBy(key, "structure").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_key"), F.col("structure").alias("_structure")))

    def held(of: DataFrame) -> DataFrame:
        each = of.select(key, "structure", F.explode(_held(words(F.col("_text")))).alias("_p"))
        return each.select(F.col("_p.word").alias("word"), key, "structure", F.size("_p.positions").cast("long").alias("n_occ"), F.col("_p.positions").alias("positions"))

    if again.isEmpty():
        return held(rows)
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("structure").eqNullSafe(F.col("_structure"))
    several = held(rows.join(again, same, "left_semi")).groupBy("word", key, "structure")
    joined = several.agg(F.sum("n_occ").alias("n_occ"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return held(rows.join(again, same, "left_anti")).unionByName(joined)


def lexicon(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``word, fold, rev, rev_fold, n_docs, n_occ``) of tokens.  Counts are
    summed in each task before the shuffle."""
    pairs = rows.groupBy("word", key).agg(F.count(F.lit(1)).alias("n"))
    words = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_occ"))
    return with_keys(words)


def with_keys(words: DataFrame) -> DataFrame:
    """Adds the three other keys that words are looked up by."""
    return words.withColumn("fold", fold(F.col("word"))).withColumn("rev", F.reverse("word")).withColumn("rev_fold", F.reverse("fold"))


def matches(pattern: WordPattern, folded: bool = False, word: Column | None = None, folds: Callable[[str], str] | None = None) -> Column:
    """The condition that a word meets a planned pattern.  Without ``word`` it
    stands on a lexicon's columns, so that the literal part can prune a scan
    of the sorted key; with it the keys are computed from that column, which
    is a folded key already if ``folds`` says how."""
    change = folds or (fold_text if folded else str)
    literal = change(pattern.literal)
    if word is None:
        key = F.col("fold" if folded else "word")
        backward = F.col("rev_fold" if folded else "rev")
    else:
        key = fold(word) if folded else word
        backward = None
    if pattern.mode == "exact":
        found = key == literal
    elif pattern.mode == "begin":
        found = key.startswith(literal)
    elif pattern.mode == "end":
        found = backward.startswith(literal[::-1]) if backward is not None else key.endswith(literal)
    else:
        found = F.lit(True)
    return found if pattern.rest is None else found & _rest(pattern, key, change)


def _rest(pattern: WordPattern, key: Column, change: Callable[[str], str]) -> Column:
    """What a pattern's literal part leaves to be matched."""
    return key.rlike(pattern.rest if "\\" in pattern.rest else change(pattern.rest))


def find_words(words: DataFrame, pattern: str, kind: str = "wildcard", folded: bool = False) -> DataFrame:
    """Words of a lexicon that meet a wildcard pattern or, with ``kind``
    ``regex``, a regular expression over the whole word."""
    plan = {"wildcard": wildcard, "regex": regular}[kind](pattern)
    return words.where(matches(plan, folded))


#: The keys that words are looked up by; a suffix is a prefix of a reversed one.
KEYS = ("word", "rev", "fold", "rev_fold")


@dataclass(frozen=True)
class Written:
    """An index in files.

    ``postings`` (``bucket, word``, key, ``structure, n_occ, positions``) are
    range-partitioned and sorted by word and key, a folder for each range.
    ``words`` holds the lexicon four times, sorted by each of ``KEYS``: a row
    for each word with ``word_id``, all keys, ``n_docs``, ``n_occ`` and the
    ``first`` and ``last`` bucket that hold its postings."""

    postings: DataFrame
    words: dict[str, DataFrame]


def word_id(word: Column) -> Column:
    """A word's number, for tables that link words."""
    return F.xxhash64(word)


def written(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, structure: Column | None = None) -> Written:
    """Writes an index.  ``path``: a new folder of the shared one if None.

    A frequent word's postings are spread over as many ranges as they fill;
    the lexicon is summed up from them and written in four orders."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = postings(docs, text, key, structure).repartitionByRange(parts, "word", key).withColumn("bucket", F.spark_partition_id())
    rows.sortWithinPartitions("bucket", "word", key).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    return _lexicon_of(spark, path, key, whole=structure is None)


def _lexicon_of(spark: SparkSession, path: str, key: str, whole: bool) -> Written:
    """``whole``: a document and word have one row of postings, so that rows
    are counted; else they are summed up for each document first."""
    pairs = spark.read.parquet(f"{path}/postings").select("word", key, "n_occ", F.col("bucket").alias("low"), F.col("bucket").alias("high"))
    if not whole:
        pairs = pairs.groupBy("word", key).agg(F.sum("n_occ").alias("n_occ"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_occ").alias("n_occ"), F.min("low").alias("first"), F.max("high").alias("last"))
    with_keys(found).withColumn("word_id", word_id(F.col("word"))).write.option("compression", "zstd").parquet(f"{path}/lexicon")
    for k in KEYS:
        spark.read.parquet(f"{path}/lexicon").repartitionByRange(k).sortWithinPartitions(k).write.option("compression", "zstd").parquet(f"{path}/by_{k}")
    return open_written(spark, path)


def open_written(spark: SparkSession, path: str) -> Written:
    """An index that was written before."""
    return Written(spark.read.parquet(f"{path}/postings"), {k: spark.read.parquet(f"{path}/by_{k}") for k in KEYS})


def in_range(key: Column, prefix: str) -> Column:
    """The keys in [prefix, next string): two comparisons that reach the scan."""
    above = next_string(prefix)
    return key >= prefix if above is None else (key >= prefix) & (key < above)


def find_written(index: Written, pattern: str, folded: bool = False, kind: str = "wildcard") -> DataFrame:
    """The lexicon's words that meet a pattern, from the copy whose order its
    literal part can be searched in; folded keys lead back to raw words."""
    plan = {"wildcard": wildcard, "regex": regular}[kind](pattern)
    literal = fold_text(plan.literal) if folded else plan.literal
    backward = plan.mode == "end"
    name = KEYS[2 * folded + backward]
    key = F.col(name)
    found = index.words[name]
    if plan.mode == "exact":
        found = found.where(key == literal)
    elif literal:
        found = found.where(in_range(key, literal[::-1] if backward else literal))
    return found.where(_rest(plan, F.col("fold" if folded else "word"), fold_text if folded else str)) if plan.rest is not None else found


def buckets(found: DataFrame) -> list[int]:
    """The postings' folders that hold some words: at most as many numbers as
    there are folders."""
    return sorted(r[0] for r in found.select(F.explode(F.sequence("first", "last")).alias("b")).distinct().collect())


def find_postings(index: Written, pattern: str, folded: bool = False, kind: str = "wildcard") -> DataFrame:
    """Postings of the words that meet a pattern.  Only the folders that hold
    such words are read; of these, only row groups that may."""
    found = find_written(index, pattern, folded, kind)
    rows = index.postings.where(F.col("bucket").isin(buckets(found)))
    plan = {"wildcard": wildcard, "regex": regular}[kind](pattern)
    if not folded and plan.mode in ("exact", "begin"):
        rows = rows.where(F.col("word") == plan.literal if plan.mode == "exact" else in_range(F.col("word"), plan.literal))
        return rows if plan.rest is None else rows.where(_rest(plan, F.col("word"), str))
    return meeting(rows, kept(found.select("word", "first", "last"))).select(*index.postings.columns)


#: Words that are broadcast at most; more meet the postings by folder and word.
BROADCAST_WORDS = 1 << 16


def meeting(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Postings with the other columns of ``found`` (rows of a lexicon, kept)
    for each of its rows of their word.  Few words go to where the postings are
    read.  Many are dealt out by folder and word, so that a frequent word is as
    many tasks as it fills folders."""
    if found.count() <= BROADCAST_WORDS:
        return rows.join(F.broadcast(found.drop("first", "last")), "word")
    spread = found.withColumn("bucket", F.explode(F.sequence("first", "last"))).drop("first", "last")
    return rows.join(spread, ["bucket", "word"])
