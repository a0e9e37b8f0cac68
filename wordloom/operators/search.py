"""Boolean, phrase and proximity search over tokens or postings.

A query becomes a flat list of terms.  Every term's positions are gathered for
each document by one aggregation (or none, where a row holds its document's
words), and the query's fold from left to right, proximity, phrases, highlight
positions and scores are expressions over these arrays.  No joins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.folding import fold, fold_text
from wordloom.functions.text import wildcard, word_pattern
from wordloom.operators.filters import let, near_positions, title_level
from wordloom.operators.hops import Hop, follow
from wordloom.operators.index import Written, buckets, find_written, matches, meeting
from wordloom.sources.kept import kept

NEAR = 10
OPERATORS = {"or": "or", "and": "and", "not": "not", "near": "near", "before": "before"}


@dataclass
class Term:
    """``words`` has one pattern, or those of a phrase, with the largest step
    from the word before (a skipped stop word widens it by one)."""

    operator: str
    words: list[str]
    steps: list[int] = field(default_factory=list)
    phrase: bool = False


def parse(query: str, stop_words: frozenset[str] = frozenset()) -> list[Term]:
    """Terms of a query such as ``ring and "blue bolt" near ga*``.

    Double quotes make a phrase; words side by side mean ``and``; the five
    operators are read in any case.  A stop word is dropped and its operator
    moves on to the next term, whose own one is ignored; a phrase of stop
    words alone is dropped too.
    """
    terms: list[Term] = []
    held = pending = None
    wanted = word_pattern().replace("\\x{", "\\U{")
    wanted = re.sub(r"\\U\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), wanted).replace("(?iu:", "(?i:")
    for quoted, bare in re.findall(r'"([^"]*)"|([^\s"]+)', query):
        if not quoted and bare.lower() in OPERATORS:
            if pending:
                raise ValueError("two operators in a row")
            pending = OPERATORS[bare.lower()]
            continue
        found = re.findall(wanted, quoted or bare)
        groups = [(found, True)] if quoted else [([w], False) for w in found]
        for words, phrase in groups:
            operator, pending = held or pending or ("and" if terms else "or"), None
            kept, steps, step = [], [], 1
            for w in words:
                if w.lower() in stop_words:
                    step += 1
                    continue
                kept.append(w)
                steps.append(step)
                step = 1
            if kept:
                terms.append(Term(operator, kept, steps, phrase))
                held = None
            else:
                held = operator
    if pending:
        raise ValueError("the query ends in an operator")
    if not terms:
        raise ValueError("an empty query")
    terms[0].operator = "or" if terms[0].operator != "not" else "not"
    return terms


def _conditions(terms: list[Term], word: Column, folded: bool) -> list[list[Column]]:
    """A condition for each word: phrases are case-sensitive and literal."""
    return [[word == w if t.phrase else matches(wildcard(w), folded, word) for w in t.words] for t in terms]


def _tags(terms: list[Term], folded: bool) -> Column:
    """The numbers of all query words that ``word`` meets; it is folded once,
    and not at all for phrases alone."""

    def met(v: Column) -> Column:
        own = [v["raw"] == w if t.phrase else matches(wildcard(w), False, v["key"], fold_text if folded else str) for t in terms for w in t.words]
        return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in enumerate(own))))

    word = F.col("word")
    folds = folded and not all(t.phrase for t in terms)
    return let(F.struct(word.alias("raw"), (fold(word) if folds else word).alias("key")), met)


def _phrase_ends(positions: list[Column], steps: list[int]) -> Column:
    """Where a phrase's last word stands."""
    at = positions[0]
    for nxt, step in zip(positions[1:], steps[1:], strict=True):
        after = F.transform(at, lambda x: x + 1)
        at = F.array_intersect(nxt, after) if step == 1 else near_positions(nxt, after, step - 1, -1)
    return at


@dataclass
class Verdict:
    """Expressions over the columns ``p<i>_<j>`` of term i and its word j."""

    found: Column
    marked: Column
    n_occ: Column


def verdict(terms: list[Term], near: int = NEAR) -> Verdict:
    p = [[F.col(f"p{i}_{j}") for j in range(len(t.words))] for i, t in enumerate(terms)]
    found = marked = None
    for i, t in enumerate(terms):
        ends = _phrase_ends(p[i], t.steps) if t.phrase else p[i][0]
        has = F.size(ends) > 0
        own = F.array_sort(F.flatten(F.array(*p[i]))) if t.phrase else p[i][0]
        if t.phrase:
            own = F.when(has, own).otherwise(F.array().cast("array<int>"))
        if found is None:
            found, marked = (F.lit(False), F.array().cast("array<int>")) if t.operator == "not" else (has, own)
            continue
        if t.operator == "or":
            found, marked = found | has, F.array_union(marked, own)
        elif t.operator == "and":
            found, marked = found & has, F.array_union(marked, own)
        elif t.operator == "not":
            found, marked = found & ~has, F.array_except(marked, own)
        else:
            # The words beside the operator: the last one before, the first one after.
            left, right = p[i - 1][-1], p[i][0]
            found = found & has & (F.size(near_positions(left, right, near if t.operator == "near" else 0, near)) > 0)
            marked = F.array_union(near_positions(marked, own, near, near), near_positions(own, marked, near, near))
    n_occ = sum((F.size(c) for own in p for c in own[1:]), F.size(p[0][0]))
    for own in p[1:]:
        n_occ = n_occ + F.size(own[0])
    return Verdict(found, F.array_sort(marked), n_occ)


def _gather(tagged: DataFrame, key: str, terms: list[Term], positions: str, exploded: bool) -> DataFrame:
    """Positions of every query word (number ``k``) and document: one shuffle,
    of matches alone."""

    def gathered(k: int) -> Column:
        held = F.collect_list(F.when(F.col("k") == k, F.col(positions)))
        return F.array_sort(held if exploded else F.array_distinct(F.flatten(held)))

    names = [f"p{i}_{j}" for i, t in enumerate(terms) for j in range(len(t.words))]
    return tagged.groupBy(key).agg(*(gathered(k).alias(n) for k, n in enumerate(names)))


def _without_positions(terms: list[Term]) -> list[Term]:
    for t in terms:
        t.operator = "and" if t.operator in ("near", "before") else t.operator
    return terms


def search(rows: DataFrame, query: str, key: str = "doc_id", stop_words: frozenset[str] = frozenset(), near: int = NEAR, folded: bool = True, with_positions: bool = True) -> DataFrame:
    """(key, ``n_occ``, ``marked``) of the documents that meet a query.

    ``rows``: tokens (key, pos, word) or postings (word, key, positions).
    ``marked``: the positions to highlight.  Without positions in an index,
    pass ``with_positions=False``: near and before then mean ``and``.
    """
    terms = parse(query, stop_words)
    if not with_positions:
        terms = _without_positions(terms)
    exploded = "pos" in rows.columns
    positions = "pos" if exploded else "positions"
    wanted = reduce(lambda x, y: x | y, [c for own in _conditions(terms, F.col("word"), folded) for c in own])
    # Most rows go by plain conditions; the rest are tagged with the query words that they meet.
    tagged = rows.where(wanted).select(key, positions, F.explode(_tags(terms, folded)).alias("k"))
    return _judged(_gather(tagged, key, terms, positions, exploded), terms, key, near)


def _judged(held: DataFrame, terms: list[Term], key: str, near: int) -> DataFrame:
    v = verdict(terms, near)
    return held.where(v.found).select(key, v.n_occ.cast("long").alias("n_occ"), v.marked.alias("marked"))


def needed(terms: list[Term]) -> list[int]:
    """The numbers of the query words without which no document is found: those
    of the terms that are joined by and, near or before after the last ``or``."""
    out: list[int] = []
    k = 0
    for i, t in enumerate(terms):
        own = list(range(k, k + len(t.words)))
        k += len(own)
        if t.operator == "or":
            out = own if i == 0 else []
        elif t.operator != "not":
            out += own
    return out


#: Documents whose ids are broadcast at most; more meet by a shuffle.
BROADCAST_IDS = 1 << 17


def query_words(index: Written, terms: list[Term], folded: bool = True, path: Sequence[Hop] = ()) -> DataFrame:
    """(``k``, ``word, n_docs, first, last``): the lexicon's words of each
    query word.  ``path`` leads from the words found (``word_id``) to others,
    such as inflected forms; phrases stay literal."""
    every = index.words["word"]
    found = []
    for k, (w, phrase) in enumerate((w, t.phrase) for t in terms for w in t.words):
        own = every.where(F.col("word") == w) if phrase else find_written(index, w, folded)
        if path and not phrase:
            ids = follow(own.select(F.col("word_id").alias("id")), list(path)).distinct()
            own = every.join(ids, F.col("word_id") == F.col("id"), "left_semi")
        found.append(own.select(F.lit(k).alias("k"), "word", "n_docs", "first", "last"))
    return reduce(DataFrame.unionByName, found)


def search_written(
    index: Written, query: str, key: str = "doc_id", stop_words: frozenset[str] = frozenset(), near: int = NEAR, folded: bool = True, path: Sequence[Hop] = (), only: DataFrame | None = None, with_positions: bool = True
) -> DataFrame:
    """``search`` over a written index: the same result, from fewer rows.

    The lexicon says first which words a query means, where their postings are
    and how many there are.  If some word has to be in every document found,
    the documents of the rarest such word are picked, and only their postings
    of the other words are gathered.  ``only``: ids (``id``) that a record
    filter lets through; other postings are dropped as they are read.
    """
    terms = parse(query, stop_words)
    if not with_positions:
        terms = _without_positions(terms)
    words = kept(query_words(index, terms, folded, path))
    sizes = {r["k"]: r["n"] for r in words.groupBy("k").agg(F.sum("n_docs").alias("n")).collect()}
    rows = _postings_of(index, words, key)
    rarest = min(needed(terms), key=lambda k: sizes.get(k, 0), default=None)
    if rarest is not None and 2 * sizes.get(rarest, 0) < sum(sizes.values()):
        docs = _postings_of(index, words.where(F.col("k") == rarest), key).select(key).distinct()
        rows = rows.join(F.broadcast(docs) if sizes.get(rarest, 0) <= BROADCAST_IDS else docs, key, "left_semi")
    if only is not None:
        rows = rows.join(only.select(F.col("id").alias(key)), key, "left_semi")
    return _judged(_gather(rows, key, terms, "positions", False), terms, key, near)


def _postings_of(index: Written, words: DataFrame, key: str) -> DataFrame:
    """(``k``, key, ``positions``) of the words of ``query_words``."""
    read = index.postings.where(F.col("bucket").isin(buckets(words)))
    return meeting(read, words.select("k", "word", "first", "last")).select("k", key, "positions")


#: What an occurrence counts at title levels 0 to 7.
LEVEL_SCORES = (100, 20, 10, 5, 4, 3, 2, 1)


def relevance(structure: Column, n_occ: Column, levels: tuple[int, ...] = LEVEL_SCORES, bold: int = 1, italic: int = 1) -> Column:
    """The default scorer: level score times occurrences, times the factors
    for bold (bit 0) and italic (bit 1)."""
    score = F.element_at(F.array(*(F.lit(s) for s in levels)), (title_level(structure) + 1).cast("int")) * n_occ
    score = score * F.when(structure.bitwiseAND(F.lit(1)) != 0, bold).otherwise(1)
    return score * F.when(structure.bitwiseAND(F.lit(2)) != 0, italic).otherwise(1)


def score(index: DataFrame, query: str, key: str = "doc_id", scorer: Callable[[Column, Column], Column] = relevance, stop_words: frozenset[str] = frozenset(), folded: bool = True) -> DataFrame:
    """(``id``, ``score``): the scorer summed over a query's words, phrases
    included word by word, for every document with one of them."""
    total = None
    for own in _conditions(parse(query, stop_words), F.col("word"), folded):
        for c in own:
            one = F.when(c, scorer(F.col("structure"), F.col("n_occ"))).otherwise(0)
            total = one if total is None else total + one
    scored = index.withColumn("_score", total).where("_score <> 0")
    return scored.groupBy(F.col(key).alias("id")).agg(F.sum("_score").cast("long").alias("score"))


#: The type masks of the five query modes; the last two go without inflected forms.
MODES = {"all": 0x07, "idioms": 0x08, "examples": 0x30, "pictures": 0x40, "advanced": 0x80}
EXACT_MODES = ("pictures", "advanced")
