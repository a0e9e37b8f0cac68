"""Secret scans with character Markov models, as DataFrame expressions.

Three patterns find assignments, access keys and long hexadecimal strings.
Beyond these, every token of identifier characters is scored by two
first-order Markov models of its characters, one of random strings and one of
ordinary identifiers, and is a secret where the sum of its log-likelihood
ratios reaches a threshold (the logarithm of how rare secrets are among
tokens).  Both models are trained from labelled samples: the values that the
patterns find are the random ones, and the tokens of documents without any
match are the ordinary ones, with the words of a public vocabulary where one is
given.  Identifiers are words in other dress, so each ordinary word is learned
in every case and beside the characters that join words.

Nothing here leaves the JVM: scores come from looking up pairs of characters in
a constant array, once for each different token of a corpus, and only texts
with a hit have places worked out, by splitting at matches and adding up
lengths.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.ranges import partitions
from wordloom.llm.shared import materialize

#: The patterns of the three kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
TOKEN = r"[A-Za-z0-9_+/=-]+"
ORDINARY = r"[A-Za-z0-9_+/=-]{3,}+"
#: A fixed format of identifiers, whose digits are random and no secret.
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
#: The characters of the models.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/=-"
SIZE = len(ALPHABET)
KINDS = {"assign": 0, "access": 1, "hex": 2, "markov": 3}


FOUND = "array<struct<start:int,rank:int,end:int,value:string>>"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once: an expression named inside a
    lambda is computed anew at each of its calls."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _chunks(values: Column) -> Column:
    """An array cut into about as many chunks as each has elements."""

    def cut(own: Column) -> Column:
        wide = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(own))).cast("int"))
        last = F.greatest(F.lit(0), F.floor((F.size(own) - 1) / wide).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(own, k * wide + 1, wide))

    return _let(values, cut)


def _matches(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """Spans (start, rank, end, value) of a pattern's matches, leftmost first.
    ``least``: the length that group 2 must have.

    Starts are running sums, first of chunks and then inside each, as an array
    that grows by one element at a time is copied at each step."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else whole
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("p"), whole.alias("w"), inner.alias("i"))
    pieces = F.transform(zipped, lambda z: F.struct(F.length(z["p"]).alias("gap"), F.length(z["w"]).alias("size"), z["i"].alias("value")))
    step = lambda z: z["gap"] + z["size"]
    chunk = "array<struct<gap:int,size:int,value:string>>"
    begun = F.aggregate(
        _chunks(pieces),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,part:{chunk}>>").alias("parts")),
        lambda held, c: F.struct(
            (held["at"] + F.aggregate(c, F.lit(0), lambda x, z: x + step(z))).alias("at"),
            F.concat(held["parts"], F.array(F.struct(held["at"].alias("at"), c.alias("part")))).alias("parts"),
        ),
    )["parts"]

    def spans(c: Column) -> Column:
        return F.aggregate(
            c["part"],
            F.struct(c["at"].alias("at"), F.array().cast(FOUND).alias("found")),
            lambda held, z: F.struct(
                (held["at"] + step(z)).alias("at"),
                F.concat(held["found"], F.array(F.struct((held["at"] + z["gap"]).alias("start"), F.lit(KINDS[kind]).alias("rank"), (held["at"] + step(z)).alias("end"), z["value"].alias("value")))).alias("found"),
            ),
        )["found"]

    placed = F.flatten(F.transform(begun, spans))
    kept = F.filter(placed, lambda s: F.length(s["value"]) >= least) if least else placed
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(FOUND))


def _outside(tokens: Column, base: Column) -> Column:
    """Tokens that overlap no base span; spans are looked at by chunks."""
    chunks = F.transform(_chunks(F.array_sort(base)), lambda c: F.struct(F.array_min(F.transform(c, lambda b: b["start"])).alias("lo"), F.array_max(F.transform(c, lambda b: b["end"])).alias("hi"), c.alias("own")))
    meets = lambda s, lo, hi: (lo < s["end"]) & (s["start"] < hi)
    apart = _let(chunks, lambda held: F.filter(tokens, lambda s: ~F.exists(held, lambda c: meets(s, c["lo"], c["hi"]) & F.exists(c["own"], lambda b: meets(s, b["start"], b["end"])))))
    return F.when(F.size(base) == 0, tokens).otherwise(apart)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, by start and then kind."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def _pairs(token: Column) -> Column:
    """The pairs of neighbouring characters."""
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2)))


def _score(token: Column, ratios: Column) -> Column:
    """The sum of a token's log-likelihood ratios (two characters or more)."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    walk = lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda held, i: held + F.get(ratios, F.get(c, i - 1) * 128 + F.get(c, i)))
    return _let(codes, walk)


def _counted(words) -> dict[str, Counter[str]]:
    """What ``dressed`` needs to know of some words: pairs as they stand,
    pairs in lower case, first two letters, and last with first letter."""
    out = {k: Counter() for k in "plhj"}
    for w in words:
        low = w.lower()
        out["p"].update(w[i : i + 2] for i in range(len(w) - 1))
        out["l"].update(low[i : i + 2] for i in range(len(w) - 1))
        out["h"][low[:2]] += 1
        out["j"][low[-1] + low[0]] += 1
    return out


def dressed(known: dict[str, Counter[str]]) -> Counter[str]:
    """Pairs of words as identifiers show them: as they stand, in upper case,
    capitalised, between ``_`` in both cases, ``-`` and ``/``, and joined with
    a capitalised word."""
    out = Counter(known["p"])
    for pair, n in known["l"].items():
        out[pair] += 5 * n  # capitalised, _x_, -x-, /x/ and the first of two joined
        out[pair] += n  # the second one
        out[pair.upper()] += 2 * n
    for pair, n in known["h"].items():  # two capitalised words begin otherwise
        out[pair] -= 2 * n
        out[pair[0].upper() + pair[1]] += 2 * n
    for pair, n in known["j"].items():
        last, first = pair
        out[last + first.upper()] += n
        for joint in "_-/":
            out[joint + first] += n
            out[last + joint] += n
        out["_" + first.upper()] += n
        out[last.upper() + "_"] += n
    return out


@cache
def _vocabulary(path: str) -> Counter[str]:
    """Dressed pairs of the words in a tokenizer's file, which is as large as a
    vocabulary is (some 50,000 words)."""
    with open(path, encoding="utf-8") as f:
        words = {w.lstrip("\u0120\u2581").removesuffix("</w>") for w in json.load(f)["model"]["vocab"]}
    return dressed(_counted(w for w in words if re.fullmatch(r"[A-Za-z0-9_+/=-]{3,}", w)))


def train(docs: DataFrame, documents: int = 2000, vocabulary: str | None = None) -> dict[str, float]:
    """The log-likelihood ratio of each pair of characters, random against
    ordinary, with add-one smoothing.

    The samples come from about ``documents`` documents that hold a pattern's
    match and as many others (the documented bound), picked by a hash.
    ``vocabulary``: the path of a tokenizer's JSON file on the driver, whose
    words are ordinary as well.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hit = F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX) | F.col("text").rlike(ASSIGN)
    counts = {r["hit"]: r["count"] for r in rows.groupBy(hit.alias("hit")).count().collect()}
    u = F.pmod(F.xxhash64("doc_id", F.lit("secrets")), F.lit(1 << 40)) / float(1 << 40)
    shares = {k: documents / max(1, counts.get(k, 0)) for k in (True, False)}
    drawn = rows.where(u < max(shares.values())).withColumn("hit", hit).where(u < F.when(F.col("hit"), shares[True]).otherwise(shares[False]))
    values = F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: (F.length(v) >= 6) & ~v.contains("."))
    secret = F.concat(F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)), values)
    words = F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))
    tokens = drawn.select("hit", F.explode(F.array_distinct(F.when(F.col("hit"), secret).otherwise(words))).alias("token")).distinct()
    tokens = tokens.repartition(partitions(docs))  # small rows, much work: spread it
    named = lambda name, pairs: F.transform(pairs, lambda p: F.concat(F.lit(name), p))
    token, low = F.col("token"), F.lower("token")
    ends = F.array(F.concat(F.lit("h"), F.substring(low, 1, 2)), F.concat(F.lit("j"), F.substring(low, -1, 1), F.substring(low, 1, 1)))
    raw = named("p", _pairs(token))
    codes = F.when(F.col("hit"), raw).otherwise(F.concat(raw, named("l", _pairs(low)), ends))
    counted = tokens.select("hit", F.explode(codes).alias("code")).groupBy("hit", "code").count().collect()
    known = {kind: {k: Counter() for k in "plhj"} for kind in (True, False)}
    for r in counted:
        known[r["hit"]][r["code"][0]][r["code"][1:]] += r["count"]
    seen = {True: known[True]["p"], False: dressed(known[False])}
    if vocabulary:
        seen[False].update(_vocabulary(vocabulary))
    from_char = {kind: Counter() for kind in seen}
    for kind, own in seen.items():
        for pair, n in own.items():
            from_char[kind][pair[0]] += n
    # A random string may hold any character, so most of its model is the even
    # chance and the rest the sample's; an identifier may hold a pair that no
    # sample has, so a fiftieth of its model is the even chance.
    out = {}
    for a in ALPHABET:
        for b in ALPHABET:
            p, q = ((seen[kind][a + b] + 1) / (from_char[kind][a] + SIZE) for kind in (True, False))
            out[a + b] = math.log(0.2 * p + 0.8 / SIZE) - math.log(0.98 * q + 0.02 / SIZE)
    return out


def shortest(model: dict[str, float], threshold: float) -> int:
    """How many characters a token needs at least to reach the threshold: the
    best that any string of a length can get is summed up pair by pair."""
    best, length, top, since = dict.fromkeys(ALPHABET, 0.0), 1, 0.0, 0
    while top < threshold:
        best = {b: max(best[a] + model[a + b] for a in ALPHABET) for b in ALPHABET}
        length += 1
        since = 0 if max(best.values()) > top else since + 1
        top = max(top, *best.values())
        if since > SIZE:  # no ring of characters gains anything
            return 1 << 20
    return length


def base_spans(docs: DataFrame, *carry: str) -> DataFrame:
    """(``doc_id``, ``n_assign, n_access, n_hex``, ``base``) of each row, and
    the columns ``carry``: what the three patterns alone find.  No shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        "doc_id",
        *carry,
        _matches(text, ASSIGN, "assign", least=6).alias("assign"),
        _matches(text, ACCESS, "access").alias("access"),
        _matches(text, HEX, "hex").alias("hex"),
    )
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *carry, *counts, F.concat("assign", "access", "hex").alias("base"))


def find_secrets(docs: DataFrame, model: dict[str, float] | None = None, threshold: float = 12.0, documents: int = 2000, vocabulary: str | None = None) -> DataFrame:
    """Returns for each row ``doc_id, n_assign, n_access, n_hex, base`` and
    ``spans``: arrays of (start, rank, end, value) in code points.

    A token is a secret where the sum of its log-likelihood ratios is at least
    ``threshold`` (a tie counts); tokens that overlap a base span add nothing,
    and neither do UUIDs.  Only tokens that are too short for the model to
    reach the threshold at all aren't scored.  Spans with one start are ordered
    by kind.  Null or empty text has no span.  Repeated rows are scanned alike
    and all returned; null doc_ids are returned as they are; texts and tokens
    may have any length; an empty table gives an empty one; other columns are
    ignored.
    """
    known = train(docs, documents, vocabulary) if model is None else model
    table = ["0"] * (128 * 128)
    for pair, ratio in known.items():
        table[ord(pair[0]) * 128 + ord(pair[1])] = f"{ratio:.6f}"
    ratios = F.split(F.lit(",".join(table)), ",").cast("array<double>")
    least = max(2, shortest(known, threshold - 1e-3))  # the table is rounded
    pattern = TOKEN.removesuffix("+") + f"{{{least},}}+"
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", F.md5(F.encode("text", "UTF-8")))
    based = base_spans(rows, "key")
    # A token's score doesn't depend on its text, so each different one is scored once.
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("token")
    different = rows.select(found).distinct().repartition(partitions(docs))  # small rows, much work: spread it
    # A token around a base span overlaps it wherever it stands, so it adds nothing.
    based_on = F.col("token").rlike(ACCESS) | F.col("token").rlike(HEX)
    hits = different.where((_score(F.col("token"), ratios) >= threshold) & ~F.col("token").rlike(UUID) & ~based_on)
    hits = materialize(hits, "hits")
    counts = ["n_assign", "n_access", "n_hex"]
    if hits.isEmpty():
        return based.select("doc_id", *counts, "base", F.col("base").alias("spans"))
    # Texts are named by their digests: only those with a hit are met again, and places are joined to base spans without a text.
    held = rows.select("key", found).join(hits, "token").select("key", "token").distinct().groupBy("key").agg(F.collect_list("token").alias("tokens"))
    placed = F.filter(_matches(F.col("text"), pattern, "markov"), lambda s: F.array_contains(F.col("tokens"), s["value"]))
    # Written, so that the last join stands alone and Spark can split a group of copies in it.
    places = materialize(rows.select("key", "text").join(held, "key").select("key", placed.alias("placed")).dropDuplicates(["key"]), "places")
    every = F.when(F.col("placed").isNotNull(), F.concat("base", _outside(F.col("placed"), F.col("base")))).otherwise(F.col("base"))
    return based.join(places, "key", "left").select("doc_id", *counts, "base", every.alias("spans"))
