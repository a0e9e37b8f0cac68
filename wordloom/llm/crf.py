"""A linear-chain conditional random field over the words of texts.

Words are runs of ASCII letters and digits and of all other non-ASCII
characters, lower-cased.  A chain is all words of one text, however long.  A
word's features are the word itself (lexicon), its first one to six and last
one to five bytes (affixes) and its byte trigrams (n-grams), hashed into one
weight table; label transitions are learned.

Forward-backward runs over all chains of a batch at once, block by block: the
words of a block are one product of label matrices, which carries the forward
message of the block before it to its end and the backward message of the
block behind it to its start.  The result is that of the unbroken chain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wordloom.llm.textcols import Words, mix, text_bytes

BLOCK = 64
BITS = 18
SIZE = 1 << BITS
PREFIXES, SUFFIXES = 6, 5

_SOLID = np.zeros(256, bool)
_SOLID[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _SOLID[_a:_b] = True


class CoreWords(Words):
    """Lower-cased words without ASCII punctuation."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        data, offsets = text_bytes(lowered)
        super().__init__(np.where(_SOLID[data], data, np.uint8(32)), offsets)
        del self.space, self._flat

    def points(self) -> np.ndarray:
        """Code points before each byte position of the batch."""
        return np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])


def word_features(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word 1 + 6 + 5 feature indices (SIZE: none), and the trigrams'
    indices with their n + 1 offsets."""
    n = len(vocabulary)
    offs = np.frombuffer(vocabulary.buffers()[1], np.int64)[vocabulary.offset : vocabulary.offset + n + 1]
    data = np.frombuffer(vocabulary.buffers()[2], np.uint8)[offs[0] : offs[-1]].astype(np.uint64)
    offs = offs - offs[0]
    size = np.diff(offs)
    at = np.arange(len(data)) - np.repeat(offs[:-1], size)
    back = np.repeat(size, size) - 1 - at
    ahead = np.concatenate([[np.uint64(0)], np.cumsum(mix(data | (at.astype(np.uint64) << np.uint64(8)), 1), dtype=np.uint64)])
    behind = np.concatenate([[np.uint64(0)], np.cumsum(mix(data | (back.astype(np.uint64) << np.uint64(8)), 2), dtype=np.uint64)])
    fixed = np.full((n, 1 + PREFIXES + SUFFIXES), SIZE, np.int32)
    cut = np.uint64(64 - BITS)
    fixed[:, 0] = mix(ahead[offs[1:]] - ahead[offs[:-1]], 3) >> cut
    for k in range(1, PREFIXES + 1):
        has = size >= k
        fixed[has, k] = mix(ahead[offs[:-1][has] + k] - ahead[offs[:-1][has]], 10 + k) >> cut
    for k in range(1, SUFFIXES + 1):
        has = size >= k
        fixed[has, PREFIXES + k] = mix(behind[offs[1:][has]] - behind[offs[1:][has] - k], 20 + k) >> cut
    whole = np.flatnonzero(back >= 2)
    tri = mix(data[whole] | (data[whole + 1] << np.uint64(8)) | (data[whole + 2] << np.uint64(16)), 30) >> cut if len(whole) else np.zeros(0, np.uint64)
    bounds = np.concatenate([[0], np.cumsum(np.maximum(size - 2, 0))])
    return fixed, tri.astype(np.int32), bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, values.shape[1]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float32)


def chains_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain, for texts with these bounds."""
    counts = np.diff(bounds)
    some = counts > 0
    return bounds[:-1][some], counts[some]


def rows_of(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The words of some chains, one chain after another."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


def _blocks_of(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, length, number in its chain and chain of each block."""
    per = -(-length // BLOCK)
    chain = np.repeat(np.arange(len(per)), per)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    at = begin[chain] + nth * BLOCK
    return at, np.minimum(BLOCK, begin[chain] + length[chain] - at), nth, chain


@dataclass
class Crf:
    """``weights``: (SIZE + 1, labels), the last row zero; ``step``:
    transition scores from row to column; ``start``: of a chain's first."""

    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray

    @staticmethod
    def zeros(labels: int) -> Crf:
        return Crf(np.zeros((SIZE + 1, labels), np.float32), np.zeros((labels, labels), np.float32), np.zeros(labels, np.float32))

    def emissions(self, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        fixed, tri, bounds = features
        out = np.zeros((len(fixed), self.weights.shape[1]), np.float32)
        for k in range(fixed.shape[1]):
            out += self.weights[fixed[:, k]]
        return out + _sums(self.weights[tri], bounds)

    def _carried(self, b: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The product of each block's label matrices: rows of length one and
        the logarithms of what they were divided by."""
        labels = b.shape[1]
        move = np.exp(self.step.astype(np.float64))
        rows = np.repeat(np.eye(labels)[None], len(at), axis=0)
        logs = np.zeros((len(at), labels))
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(1, BLOCK + 1), side="right")
        for t in range(int(size.max(initial=0))):
            own = order[: live[t]]
            x = rows[own] @ move * b[at[own] + t][:, None, :]
            total = x.sum(axis=2)
            rows[own] = x / total[:, :, None]
            logs[own] += np.log(total)
        return rows, logs

    def _between(self, b: np.ndarray, begin: np.ndarray, length: np.ndarray, blocks: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The forward message before each block (of a chain's first one:
        unused) and the backward message behind each block's last word."""
        at, size, nth, chain = blocks
        labels = b.shape[1]
        before, behind = np.full((len(at), labels), 1 / labels), np.full((len(at), labels), 1 / labels)
        per = np.bincount(chain, minlength=len(length))
        first = np.cumsum(per) - per
        long = np.flatnonzero(per > 1)
        if not len(long):
            return before, behind
        long = long[np.argsort(-per[long], kind="stable")]
        own = np.concatenate([np.arange(first[c], first[c] + per[c]) for c in long.tolist()])
        spot = np.zeros(len(at), np.int64)
        spot[own] = np.arange(len(own))
        rows, logs = self._carried(b, at[own], size[own])
        head, move = np.exp(self.start.astype(np.float64)), np.exp(self.step.astype(np.float64))
        depth = per[long]
        # A chain's first block starts from the start scores, word by word.
        x = head * b[begin[long]]
        for t in range(1, BLOCK):
            x = (x / x.sum(axis=1, keepdims=True)) @ move * b[begin[long] + t]
        message = x / x.sum(axis=1, keepdims=True)
        for k in range(1, int(depth[0])):
            n = int(np.searchsorted(-depth, -k, side="left"))
            block = first[long[:n]] + k
            before[block] = message[:n]
            own = spot[block]
            weight = np.log(np.maximum(message[:n], 1e-300)) + logs[own]
            weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            y = (weight[:, :, None] * rows[own]).sum(axis=1)
            message[:n] = y / y.sum(axis=1, keepdims=True)
        message = np.full((len(long), labels), 1 / labels)
        for k in range(int(depth[0]) - 1, 0, -1):
            n = int(np.searchsorted(-depth, -k, side="left"))
            own = spot[first[long[:n]] + k]
            inner = (rows[own] * message[:n, None, :]).sum(axis=2)
            y = np.log(np.maximum(inner, 1e-300)) + logs[own]
            y = np.exp(y - y.max(axis=1, keepdims=True))
            message[:n] = y / y.sum(axis=1, keepdims=True)
            behind[first[long[:n]] + k - 1] = message[:n]
        return before, behind

    def marginals(self, emission: np.ndarray, begin: np.ndarray, length: np.ndarray, expected: bool = False):
        """Each word's label probabilities by forward-backward; with
        ``expected`` also the summed transition probabilities."""
        n, labels = emission.shape
        b = np.exp(emission - emission.max(axis=1, keepdims=True)) if n else emission
        b = np.maximum(b, np.float32(1e-30))
        blocks = _blocks_of(begin, length)
        before, behind = self._between(b, begin, length, blocks)
        at, size, nth, _ = blocks
        order = np.argsort(-size, kind="stable")
        at, size, nth, before, behind = at[order], size[order], nth[order], before[order].astype(b.dtype), behind[order].astype(b.dtype)
        live = np.searchsorted(-size, -np.arange(1, BLOCK + 1), side="right")
        move, first = np.exp(self.step), np.exp(self.start)
        alpha, beta = np.ones_like(b), np.ones_like(b)
        deep = int(size[0]) if len(size) else 0
        for t in range(deep):
            rows = at[: live[t]] + t
            came = np.where((nth == 0)[:, None], first, before @ move) if t == 0 else alpha[rows - 1] @ move
            a = b[rows] * came
            alpha[rows] = a / a.sum(axis=1, keepdims=True)
        for t in range(deep - 1, -1, -1):
            rows = at[: live[t]] + t
            after = live[t + 1] if t + 1 < deep else 0
            x = behind[: len(rows)].copy()
            if after:
                y = (b[rows[:after] + 1] * beta[rows[:after] + 1]) @ move.T
                x[:after] = y / y.sum(axis=1, keepdims=True)
            beta[rows] = x
        out = alpha * beta
        out /= out.sum(axis=1, keepdims=True)
        if not expected:
            return out
        inner = rows_of(begin + 1, length - 1)
        ahead = b[inner] * beta[inner]
        norm = 1 / ((alpha[inner - 1] @ move) * ahead).sum(axis=1, keepdims=True)
        return out, (alpha[inner - 1] * norm).T.astype(np.float64) @ ahead * move


def fit(words: CoreWords, tags: np.ndarray, labels: int, epochs: int = 5, parts: int = 8, rate: float = 0.3, decay: float = 1e-6, only: np.ndarray | None = None, chains: tuple | None = None) -> Crf:
    """Conditional maximum likelihood by AdaGrad over parts of the chains
    (``chains``: others than the texts; ``only``: whether to learn from each).
    ``tags``: a label for each word.  The order is fixed, so reruns agree."""
    model = Crf.zeros(labels)
    begin, length = chains_of(words.bounds) if chains is None else chains
    if only is not None:
        begin, length = begin[only], length[only]
    features = word_features(words.vocabulary)
    fixed, tri, bounds = features
    seen = np.full_like(model.weights, 1e-2)
    seen_step, seen_start = np.full_like(model.step, 1e-2), np.full_like(model.start, 1e-2)
    part_of = mix(np.arange(len(begin), dtype=np.uint64), 5) % np.uint64(parts)
    for _ in range(epochs):
        for part in range(parts):
            mine = part_of == part
            if not mine.any():
                continue
            b, size = begin[mine], length[mine]
            rows = rows_of(b, size)
            vocab, codes = np.unique(words.codes[rows], return_inverse=True)
            lens = (bounds[1:] - bounds[:-1])[vocab]
            flat = np.repeat(bounds[vocab], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            sub = (fixed[vocab], tri[flat], np.concatenate([[0], np.cumsum(lens)]))
            emission = model.emissions(sub)[codes]
            local = np.cumsum(size) - size
            gamma, pairs = model.marginals(emission, local, size, expected=True)
            gold = tags[rows]
            diff = gamma
            diff[np.arange(len(gold)), gold] -= 1
            inner = np.ones(len(gold), bool)
            inner[local] = False
            inner = np.flatnonzero(inner)
            got = np.zeros((labels, labels))
            np.add.at(got, (gold[inner - 1], gold[inner]), 1)
            scale = 1 / max(1, len(b))
            by_word = np.stack([np.bincount(codes, diff[:, c], len(vocab)) for c in range(labels)], axis=1)
            grad = np.zeros_like(model.weights)
            for k in range(fixed.shape[1]):
                for c in range(labels):
                    grad[:, c] += np.bincount(sub[0][:, k], by_word[:, c], SIZE + 1)
            spread = np.repeat(by_word, lens, axis=0)
            for c in range(labels):
                grad[:, c] += np.bincount(sub[1], spread[:, c], SIZE + 1)
            for value, held, g in ((model.weights, seen, grad * scale + decay * model.weights), (model.step, seen_step, (pairs - got) * scale), (model.start, seen_start, diff[local].sum(axis=0) * scale)):
                held += g * g
                value -= (rate * g / np.sqrt(held)).astype(np.float32)
            model.weights[SIZE] = 0
    return model
