"""Line-first cleaning: judge each line, remove what fails, then judge the rest.

A line with a word fails when

* punctuation: more than half of its words hold two symbols or more, or at
  least three words all end in one of ``! ? * # % $ & |``, or it has at least
  five words of which none ends a sentence;
* navigation: at least two separators stand alone in it and make a fifth of
  its words, or it has at most three words, ends no sentence, and a line of
  that kind stands next to it (a list of links);
* boilerplate: it holds a phrase of ``BOILERPLATE``, in any case;
* repetition: it equals an earlier line of its text (a page furniture line).

The first two look at form alone and so hold for any language that ends
sentences with a mark.

A document is rejected when the lines that are left hold less than
``min_share`` of its words, or when a base rule fails.  A text is kept as a
whole in the statistics: nothing here looks at a prefix or caps a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.textcols import Words, batches, lower_ascii, text_bytes

#: Phrases of licence, cookie and script notices in four languages, marks that end sentences (or close them), separators of menus.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "use cookies", "privacy policy", "terms of service", "terms of use", "lorem ipsum", "enable javascript", "permission is hereby granted", "licensed under the", "copyright (c)", "subscribe to our newsletter",
    "alle rechte vorbehalten", "verwendet cookies", "datenschutzerklärung", "allgemeine geschäftsbedingungen",
    "tous droits réservés", "utilise des cookies", "politique de confidentialité", "mentions légales",
    "todos los derechos reservados", "utiliza cookies", "política de privacidad", "aviso legal",
)
TERMINAL = (".", "!", "?", "…", ":", ";", '"', "'", ")", "]", "»", "”", "’", "。", "！", "？")
SEPARATORS = ("|", ">", "»", "•", "·", "/")

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_SHOUT = np.isin(np.arange(256), list(b"!?*#%$&|"))
_TERMINAL = tuple(x.encode() for x in TERMINAL)
_SEPARATOR = frozenset(x.encode() for x in SEPARATORS)


def _counts(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[b] - total[a]


def _repeat_words(codes: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Words of each text inside a window that its text has at least twice.
    Windows are told apart by exact ranks, not by hashes."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    text = np.repeat(np.arange(n), size)
    if len(codes) < width:
        return np.zeros(n, np.int64)
    valid = np.flatnonzero(np.arange(len(codes)) + width <= np.repeat(bounds[1:], size))
    if not len(valid):
        return np.zeros(n, np.int64)

    def repeated(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        out = np.zeros(len(key), bool)
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
        return out

    # A window can repeat only if its first pair of words, with its text, does.
    rows, key = valid, text[valid].astype(np.int64)
    for j in range(width):
        _, key = np.unique(key * (int(codes.max()) + 1) + codes[rows + j], return_inverse=True)
        again = repeated(key)
        rows, key = rows[again], key[again]
        if not len(rows):
            return np.zeros(n, np.int64)
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, rows, 1)
    np.add.at(cover, rows + width, -1)
    return _counts(np.cumsum(cover)[:-1] > 0, bounds[:-1], bounds[1:])


def _judge(min_share: float, with_text: bool):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(frames, size=4 << 20):
            data, offsets = text_bytes(table["text"])
            words = Words(data, offsets)
            n = table.num_rows
            points = (data & 0xC0) != 0x80
            word_chars = _counts(points & ~words.space, offsets[:-1], offsets[1:])
            n_symbols = _counts(_SYMBOL[data], offsets[:-1], offsets[1:])

            breaks = np.flatnonzero(data == 10)
            # A text may start where the one before ended in a line break: both lines count.
            of = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])
            start = np.concatenate([offsets[:-1], breaks + 1])
            order = np.lexsort((start, of))
            begin, line_text = start[order], of[order]
            end = np.append(begin[1:], len(data))
            last = np.append(line_text[1:] != line_text[:-1], True)
            end = np.where(last, offsets[line_text + 1], end - 1)
            a, b = np.searchsorted(words.start, begin), np.searchsorted(words.start, end)
            has_word = b > a

            whole = data.tobytes()
            rows = np.flatnonzero(has_word)
            strings = [whole[x:y] for x, y in zip(begin[rows].tolist(), end[rows].tolist(), strict=True)]
            if len(rows):
                coded = pa.array(strings, pa.large_binary()).dictionary_encode()
                line_code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                key = line_text[rows].astype(np.int64) * (len(coded.dictionary) + 1) + line_code
                _, first = np.unique(key, return_index=True)
                again = np.ones(len(rows), bool)
                again[first] = False
            else:
                again = np.zeros(0, bool)
            n_dup_lines = np.bincount(line_text[rows][again], minlength=n)
            n_repeat = _repeat_words(words.codes.astype(np.int64) if len(words.start) else np.zeros(0, np.int64), words.bounds, 5)
            n_words = words.counts

            fails = np.zeros(len(begin), bool)
            fails[rows[again]] = True
            if len(words.start):
                symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
                noisy = symbols[words.end] - symbols[words.start] >= 2
                shouting = _SHOUT[data[words.end - 1]]
                per_line = b - a
                fails |= has_word & (2 * _counts(noisy, a, b) > per_line)
                fails |= (per_line >= 3) & (_counts(shouting, a, b) == per_line)
                forms = words.vocabulary.to_pylist()
                lone = np.array([w in _SEPARATOR for w in forms], bool)[words.codes]
                ends = np.array([w.endswith(_TERMINAL) for w in forms], bool)[words.codes]
                fails |= (per_line >= 5) & (_counts(ends, a, b) == 0)
                alone = _counts(lone, a, b)
                fails |= (alone >= 2) & (5 * alone >= per_line)
                fails[rows] |= _links(per_line[rows], ends[b[rows] - 1], line_text[rows])
                lowered = pc.utf8_lower(pa.array(strings, pa.large_binary()).cast(pa.large_string()))
                phrase = np.zeros(len(rows), bool)
                for p in BOILERPLATE:
                    phrase |= pc.match_substring(lowered, p).to_numpy(zero_copy_only=False)
                fails[rows] |= phrase

            left = _counts(np.repeat(~fails, b - a), np.searchsorted(words.start, offsets[:-1]), np.searchsorted(words.start, offsets[1:])) if len(words.start) else np.zeros(n, np.int64)
            base = (n_words < 10) | (100 * n_repeat > 20 * n_words)
            kept = ~base & (left >= min_share * n_words)
            arrays = [table["doc_id"].combine_chunks(), *(pa.array(v, pa.int64()) for v in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat)), pa.array(base), pa.array(kept), pa.array(left, pa.int64())]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left"]
            if with_text:
                parts: list[list[bytes]] = [[] for _ in range(n)]
                good = np.flatnonzero(~fails)
                for t, x, y in zip(line_text[good].tolist(), begin[good].tolist(), end[good].tolist(), strict=True):
                    parts[t].append(whole[x:y])
                arrays.append(pa.array([b"\n".join(p) for p in parts], pa.binary()).cast(pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _links(size: np.ndarray, ends: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Short lines that end no sentence and have such a neighbour (lines
    without a word don't count)."""
    short = (size <= 3) & ~ends
    both = short[1:] & short[:-1] & (text[1:] == text[:-1])
    out = np.zeros(len(size), bool)
    out[1:] |= both
    out[:-1] |= both
    return out


def clean_lines(docs: DataFrame, min_share: float = 0.5, with_text: bool = True) -> DataFrame:
    """Returns for each row ``doc_id``, the base statistics, ``base_failed``,
    ``kept``, ``words_left`` and, with ``with_text``, ``clean_text`` (the lines
    that passed).

    Null or empty text has no word and fails the base rule.  A share of
    exactly ``min_share`` is kept.  Repeated rows are judged alike and all
    returned; null doc_ids are returned as they are; an empty table gives an
    empty one; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, words_left long" + ", clean_text string" * with_text
    return docs.select("doc_id", "text").mapInArrow(_judge(min_share, with_text), schema)
