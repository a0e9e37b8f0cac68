"""Language identification by a linear-chain conditional random field.

Every word gets a probability for each language from its affixes, n-grams and
lexicon weight and from its neighbours through learned transitions, so that
texts which switch language are labelled word by word; a document's language
is the one with the largest mean probability.

Labels are of documents, so texts in one language are all that there is to
learn from.  For the transitions between languages, chains are joined from
pieces of these texts: a switch every dozen words, between any two languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.crf import CoreWords, Crf, chains_of, fit, word_features
from wordloom.llm.textcols import batches, give_back

#: Rows of one label that the driver learns from: half of what it takes at most.
LARGEST = 1500


def sampled(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """A fixed random sample of about ``per_label`` rows of each label value,
    or all of them where there are fewer, by a hash of doc_id."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    u = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    return rows.join(F.broadcast(counts), label).where(u * F.col("n") < per_label).drop("n")


def training_rows(docs: DataFrame, label: str, per_label: int | None) -> list[tuple]:
    """(label, text) of a sample (None: of all rows, drawn before), each text
    whole.  Equal rows count once, and a label never has more than twice
    ``LARGEST`` rows, whatever ids repeat."""
    picked = docs if per_label is None else sampled(docs, label, per_label)
    nth = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text"))
    picked = picked.select(label, "doc_id", "text").distinct().withColumn("_nth", nth).where(F.col("_nth") <= 2 * LARGEST)
    return [tuple(r) for r in picked.select(label, "text", F.coalesce("doc_id", F.lit(-1)).alias("k")).orderBy("k", "text").select(label, "text").collect()]


def switched(rows: list[tuple], seed: int = 8) -> list[list[tuple[str, str]]]:
    """Chains of (language, piece) from pieces of 4 to 20 words of the texts,
    one chain for every four texts."""
    draw = np.random.default_rng(seed)
    cut = [(lang, text.split()) for lang, text in rows]
    cut = [(lang, words) for lang, words in cut if words]
    chains = []
    for _ in range(len(cut) // 4):
        chain = []
        for i in draw.integers(len(cut), size=int(draw.integers(2, 7))).tolist():
            lang, words = cut[i]
            at = int(draw.integers(len(words)))
            chain.append((lang, " ".join(words[at : at + int(draw.integers(4, 21))])))
        chains.append(chain)
    return chains


def train(docs: DataFrame, per_label: int = 500) -> tuple[Crf, list[str]]:
    """Learns from ``text`` and non-null ``lang`` of at most about
    ``per_label`` rows for each language (the documented bound)."""
    rows = training_rows(docs.where("lang is not null and text is not null"), "lang", per_label)
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Crf.zeros(1), []
    mixed = switched(rows) if len(langs) > 1 else []
    pieces = rows + [p for c in mixed for p in c]
    words = CoreWords(pa.array([p[1] for p in pieces], pa.large_string()))
    at = {x: i for i, x in enumerate(langs)}
    tags = np.repeat(np.array([at[p[0]] for p in pieces]), words.counts)
    ends = np.concatenate([np.arange(len(rows) + 1), len(rows) + np.cumsum([len(c) for c in mixed], dtype=np.int64)])
    return fit(words, tags, len(langs), chains=chains_of(words.bounds[ends])), langs


def has_letter(words: CoreWords, i: int) -> bool:
    text = bytes(words.data[words.offsets[i] : words.offsets[i + 1]])
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def _spans(words: CoreWords, label: np.ndarray, langs: list[str], n: int) -> list[list[dict]]:
    """Runs of neighbouring words of one label, as code point offsets."""
    out: list[list[dict]] = [[] for _ in range(n)]
    if not len(words.start):
        return out
    of, points = words.text_of, words.points()
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(label)) - 1
    base = points[words.offsets[of[first]]]
    for i, a, b, k in zip(of[first].tolist(), (points[words.start[first]] - base).tolist(), (points[words.end[last]] - base).tolist(), label[first].tolist(), strict=True):
        out[i].append({"start": a, "end": b, "lang": langs[k]})
    return out


def _predict(shared, with_spans: bool):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, langs = shared.value
        for table in batches(frames, size=2 << 20):
            words = CoreWords(table["text"])
            n = table.num_rows
            ascii_letters = np.concatenate([[0], np.cumsum((words.data - np.uint8(97)) < 26)])
            lettered = ascii_letters[words.offsets[1:]] > ascii_letters[words.offsets[:-1]]
            for i in np.flatnonzero(~lettered).tolist():
                lettered[i] = has_letter(words, i)
            best, score, spans = np.zeros(n, np.int64), np.zeros(n), [[] for _ in range(n)]
            if len(words.start) and langs:
                emission = model.emissions(word_features(words.vocabulary))[words.codes]
                gamma = model.marginals(emission, *chains_of(words.bounds))
                total = np.concatenate([np.zeros((1, len(langs))), np.cumsum(gamma, axis=0, dtype=np.float64)])
                mean = (total[words.bounds[1:]] - total[words.bounds[:-1]]) / np.maximum(words.counts, 1)[:, None]
                best, score = mean.argmax(axis=1), mean.max(axis=1)
                if with_spans:
                    spans = _spans(words, gamma.argmax(axis=1), langs, n)
            known = lettered & bool(langs)
            names = [langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            columns, fields = [table["doc_id"].combine_chunks(), pa.array(names, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], ["doc_id", "lang_pred", "score"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                fields.append("spans")
            yield pa.RecordBatch.from_arrays(columns, fields)

    return run


def identify(docs: DataFrame, learn_from: DataFrame, per_label: int = 500, with_spans: bool = False) -> DataFrame:
    """Returns ``doc_id``, ``lang_pred`` and ``score`` for each row of ``docs``
    and, with ``with_spans``, ``spans``: the stretches of one language each
    (code point offsets, end exclusive) that words and transitions give.

    ``learn_from`` needs doc_id, text and lang; rows with null text or lang
    teach nothing.  Text that is null or has no letter: ``und`` and 0.  With
    nothing to learn from, all rows are ``und``.  Ties go to the language that
    is first by code point.  Repeated rows are predicted alike and all
    returned; a text of any length is one chain; an empty table gives an empty
    one; other columns are ignored.
    """
    model = train(learn_from.select("doc_id", "text", "lang"), per_label)
    give_back()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * with_spans
    return docs.select("doc_id", "text").mapInArrow(_predict(shared, with_spans), schema)
