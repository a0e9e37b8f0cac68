"""Toxic spans and document scores by a linear-chain conditional random field.

Words are tagged toxic or not.  Labels are of documents, so the tags to learn
from are found in two steps.  First tags: a word of a toxic document whose
form, or whose first four to six bytes, toxic documents hold far more often
than others do.  Then the labelled documents are halved, a field is fitted on
each half, and the tags of a half's toxic documents are those that the other
half's field gives with a marginal over one half: a tag has to hold up by its
affixes, n-grams and neighbours, and not only as an entry of a list.  The
field in use is fitted on these tags.

Forward-backward gives each word's marginal; the largest and the sum of a
document's marginals go through a logistic curve, fitted on the same labels,
to its score, and words over one half give the offending offsets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.crf import CoreWords, Crf, chains_of, fit, rows_of, word_features
from wordloom.llm.langid import sampled, training_rows
from wordloom.llm.textcols import batches, give_back, mix

SPAN = "array<struct<start: long, end: long, p: double>>"


@dataclass
class ToxicModel:
    crf: Crf | None
    curve: np.ndarray
    prior: float


def telling_words(words: CoreWords, toxic: np.ndarray) -> np.ndarray:
    """For each word of the vocabulary whether the labels mark it as toxic."""
    of, code = words.text_of, words.codes
    pairs = np.unique(of.astype(np.int64) * (len(words.vocabulary) + 1) + code)
    doc, code = np.divmod(pairs, len(words.vocabulary) + 1)
    bad = toxic[doc]
    forms = words.vocabulary.to_pylist()
    n_bad, n_good = int(toxic.sum()), int((~toxic).sum())

    def odds(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.log((t + 0.5) / (n_bad + 1)) - np.log((c + 0.5) / (n_good + 1))

    t = np.bincount(code[bad], minlength=len(forms))
    c = np.bincount(code[~bad], minlength=len(forms))
    found = (t >= 3) & (odds(t, c) >= 3) & (t * odds(t, c) >= 12)
    for k in (4, 5, 6):
        at: dict[bytes, int] = {}
        prefix = np.array([at.setdefault(f[:k], len(at)) if len(f) >= k else -1 for f in forms])
        some = prefix[code] >= 0
        seen = np.unique(doc[some] * (len(at) + 1) + prefix[code[some]])
        d, p = np.divmod(seen, len(at) + 1)
        t = np.bincount(p[toxic[d]], minlength=len(at))
        c = np.bincount(p[~toxic[d]], minlength=len(at))
        good = (t >= 8) & (odds(t, c) >= 5)
        found |= (prefix >= 0) & good[prefix] if len(at) else False
    return found


def crossed_tags(words: CoreWords, tags: np.ndarray) -> np.ndarray:
    """Tags of each half of the texts by a field fitted on the other half."""
    begin, length = chains_of(words.bounds)
    side = mix(np.arange(len(begin), dtype=np.uint64), 6) % np.uint64(2)
    features, out = word_features(words.vocabulary), np.zeros_like(tags)
    for k in (0, 1):
        mine, other = side == k, side != k
        if not mine.any() or not other.any():
            return tags
        crf = fit(words, tags, 2, only=other)
        gamma = crf.marginals(crf.emissions(features)[words.codes], begin[mine], length[mine])
        rows = rows_of(begin[mine], length[mine])
        out[rows] = gamma[rows, 1] > 0.5
    return out


def summary(marginal: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: 1, logit of the largest marginal, log of their sum."""
    p = np.clip(np.append(marginal, 0), 1e-6, 1 - 1e-6)
    top = np.where(bounds[1:] > bounds[:-1], np.maximum.reduceat(p, bounds[:-1]) if len(bounds) > 1 else 0, 1e-6)
    total = np.concatenate([[0], np.cumsum(p[:-1])])
    return np.stack([np.ones(len(top)), np.log(top / (1 - top)), np.log(1e-3 + total[bounds[1:]] - total[bounds[:-1]])], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1500) -> ToxicModel:
    """Learns from at most about ``per_label`` toxic and as many other rows
    (the documented bound) of ``docs`` that ``labels`` (doc_id, toxic) marks."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("bad"))
    share = {r["bad"]: r["count"] for r in marks.groupBy("bad").count().collect()}
    # Only ids meet the labels; the rows drawn are few (see the bound), so no text is shuffled.
    known = docs.where("text is not null").select("doc_id").distinct().join(marks, "doc_id")
    drawn = sampled(known, "bad", per_label)
    rows = training_rows(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id"), "bad", None)
    toxic = np.array([r[0] for r in rows], bool)
    total = sum(share.values())
    if not toxic.any() or toxic.all():
        return ToxicModel(None, np.zeros(3), share.get(True, 0) / total if total else 0.0)
    words = CoreWords(pa.array([r[1] for r in rows], pa.large_string()))
    bad = toxic[words.text_of]
    tags = crossed_tags(words, (telling_words(words, toxic)[words.codes] & bad).astype(np.int64)) * bad
    crf = fit(words, tags, 2)
    gamma = crf.marginals(crf.emissions(word_features(words.vocabulary))[words.codes], *chains_of(words.bounds))
    weight = np.where(toxic, share.get(True, 0) / toxic.sum(), share.get(False, 0) / (~toxic).sum()) * len(rows) / total
    return ToxicModel(crf, _logistic(summary(gamma[:, 1], words.bounds), toxic.astype(float), weight), 0.0)


def _score(shared, kept: list[str]):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # before the model is loaded, what a task of another kind has left
        model: ToxicModel = shared.value
        for table in batches(frames, size=2 << 20):
            words = CoreWords(table["text"])
            n = table.num_rows
            score, spans = np.full(n, model.prior), [[] for _ in range(n)]
            if model.crf is not None:
                gamma = np.zeros(0)
                if len(words.start):
                    emission = model.crf.emissions(word_features(words.vocabulary))[words.codes]
                    gamma = model.crf.marginals(emission, *chains_of(words.bounds))[:, 1].astype(np.float64)
                score = 1 / (1 + np.exp(-np.clip(summary(gamma, words.bounds) @ model.curve, -30, 30)))
                hit = np.flatnonzero(gamma > 0.5)
                points, of = words.points(), np.searchsorted(words.bounds, hit, side="right") - 1
                base = points[words.offsets[of]]
                for i, a, b, p in zip(of.tolist(), (points[words.start[hit]] - base).tolist(), (points[words.end[hit]] - base).tolist(), gamma[hit].tolist(), strict=True):
                    spans[i].append({"start": a, "end": b, "p": p})
            yield pa.RecordBatch.from_arrays(
                [*(table[c].combine_chunks() for c in kept), pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))],
                [*kept, "score", "spans"],
            )

    return run


def score_toxicity(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, per_label: int = 1500, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Returns ``doc_id``, ``carried`` (struct of the columns in ``carry``),
    ``score`` (0 to 1) and ``spans`` (code point offsets of offending words,
    end exclusive, with their marginals) for each row of ``docs``, and its
    ``text`` if ``with_text`` (not by ``carry``, which would send it twice).

    Null text counts as empty, and an empty text gets the score of a text
    without a toxic word.  Labels with a null or for unknown documents teach
    nothing, of several for one document the largest counts; without both
    kinds of label every score is the share of toxic labels.  A word at a
    marginal of exactly one half is no offence.  Repeated rows are scored
    alike and all returned; a text of any length is one chain; an empty table
    gives an empty one; columns not named are ignored.
    """
    model = train(learn_from, labels, per_label)
    give_back()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = docs.select("doc_id", "text", (F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))).alias("carried"))
    kept = ["doc_id", *["text"] * with_text, "carried"]
    schema = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in kept)
    return whole.mapInArrow(_score(shared, kept), f"{schema}, score double, spans {SPAN}")
