"""Conversation repair, URL rules and the prefix trie against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from wordloom.llm import queries as q
from wordloom.llm.prefix_trie import conversations, prefix_trie
from wordloom.llm.repair import ROLES, Edits, Grammar, repair_conversations, repaired, shortest_edits
from wordloom.llm.url_rules import judge_urls

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
NAMES = {"u": "user", "a": "assistant"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    """conv_id -> [(turn, role, text)] in order."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out[c] += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def all_edits(rows):
    """Every edit string of rows (initial, fault) with at most two insertions
    at one place: (cost, labels)."""
    inserted = [()] + [(x,) for x in "ua"] + list(itertools.product("ua", repeat=2))
    choices = []
    for initial, fault in rows:
        own = [(2, "D", "")]
        if fault not in (1, 2):
            extra = 5 * (fault == 3)
            own += [(extra, "K", initial), (1 + extra, "R", "u"), (1 + extra, "R", "a")]
        choices.append(own)
    best = None
    for head in inserted:
        for own in itertools.product(*(itertools.product(c, inserted) for c in choices)):
            made = "".join(head) + "".join(symbol + "".join(more) for (_, _, symbol), more in own)
            if re.fullmatch("(s?(ua)+)?", made) and not any(s == "" and l != "D" for (_, l, s), _ in own):
                cost = 5 * len(head) + sum(c + 5 * len(more) for (c, _, _), more in own)
                labels = "I" * len(head) + "".join(label + "I" * len(more) for (_, label, _), more in own)
                best = min(best or (cost, labels), (cost, labels))
    return best


def test_shortest_edits():
    kinds = [(r, f) for r in ("s", "u", "a", "x") for f in (0, 3)] + [("u", 1), ("a", 2)]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert shortest_edits(rows, ROLES, Edits()) == all_edits(rows), rows
    draw = random.Random(5)
    for _ in range(20):
        rows = tuple(draw.choice(kinds) for _ in range(3))
        assert shortest_edits(rows, ROLES, Edits()) == all_edits(rows), rows


def test_another_grammar():
    pairs = Grammar(arcs=((("q", 1),), (("r", 0),)), start=0, finals=frozenset({0}))
    edits = Edits(insert=1, rerole=9, roles=(("r", "reply"),))
    assert shortest_edits((("q", 0), ("q", 0)), pairs, Edits(roles=(("r", "reply"),))) == (1, "KR")
    assert shortest_edits((("q", 0), ("q", 0)), pairs, edits) == (2, "KIKI")
    assert repaired([("q", "1"), ("q", "2")], "KIKI", pairs, edits) == [("q", "1"), ("reply", ""), ("q", "2"), ("reply", "")]
    never = Grammar(arcs=((("q", 1),), ()), start=0, finals=frozenset({1}))
    assert shortest_edits((("r", 0),), never, Edits(roles=())) is None


def test_long_conversation():
    rows = tuple(("us"[i % 7 == 0], 3 * (i % 5 == 0)) for i in range(3000))
    cost, labels = shortest_edits(rows, ROLES, Edits())
    made = "".join(r[:1] for r, _ in repaired([(r, "") for r, _ in rows], labels, ROLES, Edits()))
    assert re.fullmatch("(s?(ua)+)?", made) and cost <= 2 * len(rows)


def test_op11(spark, sf):
    rows = [tuple(r) for r in q.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = {}
    for c, own in damaged(rows).items():
        found = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        signature = tuple((r[:1], f) for (_, r, _), f in zip(own, found, strict=True))
        cost, labels = all_edits(signature) if len(own) < 4 else shortest_edits(signature, ROLES, Edits())
        text = "\n".join(f"{r}:{t}" for r, t in repaired([x[1:] for x in own], labels, ROLES, Edits()))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        want[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count(1), found.count(2), found.count(3), illegal, cost, labels, sha(text))
    got = {r[0]: tuple(r)[1:] for r in q.op11_repair_conversations(spark, sf).collect()}
    assert got == want


CONVERSATION = "conv_id long, turn long, role string, text string, present boolean, audit int, key string"


def test_repair_edges(spark):
    rows = [(1, None, "user", "First."), (1, 2, "assistant", "Yes."), (1, 4, "assistant", "Yes."), (2, 1, None, None), (3, 0, "user", "Gone."), (None, 5, "user", "What?" * 50_000), (None, 5, "user", "What?" * 50_000), (4, 7, "system", "Be brief."), (4, 7, "", "x")]
    df = spark.createDataFrame([(*r, r[0] != 3, 1, "x") for r in rows], CONVERSATION)
    got = {r["conv_id"]: r for r in repair_conversations(df).collect()}
    assert {c: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for c, r in got.items()} == {
        1: (1, 0, 1, 0, 1, 2, "KKD"), 2: (0, 1, 0, 0, 0, 2, "D"), 3: (0, 0, 0, 0, 0, 0, ""), None: (0, 0, 1, 0, 1, 4, "DD"), 4: (0, 0, 0, 1, 1, 4, "DD"),
    }
    assert [tuple(x) for x in got[1]["repaired"]] == [("user", "First."), ("assistant", "Yes.")]
    assert repair_conversations(df.limit(0)).collect() == []


def judged(url, rules, default):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best and best[3], best[4] if best else default)


def test_url_rules(spark):
    draw = random.Random(3)
    labels, parts = ["net", "a", "b-c", "ä", "x1", ""], ["", "/", "/e", "/en", "/en/", "/en/x", "/é", "/~", "//"]
    host = lambda: ".".join(draw.choice(labels) for _ in range(draw.randint(1, 4)))
    rules = [(host(), draw.choice(parts), draw.choice(("block", "allow"))) for _ in range(80)]
    urls = [draw.choice(("http://", "x://", "")) + host().upper() + draw.choice(parts) + draw.choice(("", "y", "?q://a.net/", "#/en")) for _ in range(1500)]
    urls += ["https://hot.net/en/" + "z" * k for k in range(400)] + ["https://hot.net/en/same"] * 400 + [None, "", "://", "http://a.net" + "/en" * 30_000]
    df = spark.createDataFrame([(i if i % 50 else None, u, "k", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, part int")
    table = spark.createDataFrame([*rules, ("hot.net", "/en/zzz", "block"), ("net", "/en/zz", "allow"), (None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")
    own = [r for r in (*rules, ("hot.net", "/en/zzz", "block"), ("net", "/en/zz", "allow"))]
    got = Counter(tuple(r) for r in judge_urls(df, table, default="ask").collect())
    assert got == Counter((i if i % 50 else None, *judged(u, own, "ask")) for i, u in enumerate(urls))
    assert judge_urls(df.limit(0), table).collect() == []
    assert {r["verdict"] for r in judge_urls(df.limit(20), table.limit(0)).collect()} == {"allow"}


def trie(convs):
    """convs: (conv_id, [(turn, words)]) -> rows as the operator returns them."""
    members, ends, words = defaultdict(list), defaultdict(list), {(): 0}
    for c, turns in convs:
        for d in range(len(turns) + 1):
            node = tuple(t for t, _ in turns[:d])
            members[node].append(c)
            if d:
                words[node] = turns[d - 1][1]
        ends[tuple(t for t, _ in turns)].append(c)
    kids = Counter(n[:-1] for n in members if n)
    saved, leaves = Counter(), Counter()
    for n, own in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(own) - 1) * words[n]
            leaves[n[:d]] += not kids[n]
    return Counter((min(own), len(n), min(members[n[:-1]]) if n else None, len(own), kids[n], leaves[n], saved[n], sha(",".join(map(str, sorted(ends[n]))))) for n, own in members.items())


@pytest.mark.parametrize("seed", range(3))
def test_trie(spark, seed):
    draw = random.Random(seed)
    convs = [(i, [(draw.choice("aab"), 1) for _ in range(draw.randint(0, 7))]) for i in range(300)]
    convs += [(i, [("a", 1)] * 5) for i in range(300, 600)] + [(i, [("c", 1), ("a", 1)]) for i in range(600, 900)]  # hot groups over many ranges
    convs += [(900, [("b", 1)] * 900), (901, [("b", 1)] * 899 + [("a", 1)]), (901, [("b", 1)] * 3), (-5, [])]
    size = {"a": 3, "b": 2, "c": 0}
    digest = {t: hashlib.md5(t.encode()).hexdigest() for t in "abc"}
    convs = [(c, [(t, size[t]) for t, _ in turns]) for c, turns in convs]
    rows = [(c, [(digest[t], w) for t, w in turns] if turns else draw.choice((None, [])), "x", 1) for c, turns in convs] + [(None, [], "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<digest:string,words:bigint>>, key string, part int").repartition(5)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", (1, 8, 40)[seed])
    try:
        got = Counter(tuple(r) for r in prefix_trie(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == trie(convs)


def test_trie_edges(spark):
    rows = [(7, 1, "user", "two words"), (7, None, None, None), (7, 1, "user", "two words"), (None, 1, "user", "lost"), (9, None, "", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int")
    own = conversations(df)
    assert {r["conv_id"]: [t["words"] for t in r["turns"]] for r in own.collect()} == {7: [0, 2, 2], 9: [0]}
    got = sorted((r["depth"], r["conv_id"], r["n_convs"], r["saved_tokens"], r["ends_sha256"]) for r in prefix_trie(own).collect())
    assert got == [(0, 7, 2, 0, sha("")), (1, 7, 2, 0, sha("9")), (2, 7, 1, 0, sha("")), (3, 7, 1, 0, sha("7"))]
    assert prefix_trie(conversations(df.limit(0))).collect() == []


def test_op13(spark, sf):
    held = defaultdict(list)
    for r in q.table(spark, sf, "conversations").collect():
        held[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    turns = {c: [((role, text), len(re.findall(r"[^\x20\x09-\x0D]+", text))) for _, role, text in sorted(own)] for c, own in held.items()}
    built = []
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built.append((c, turns.get(c - c % 20, [])[:h] + turns[c][h:]))
    assert Counter(tuple(r) for r in q.op13_prefix_trie(spark, sf).collect()) == trie(built)
