"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
KEYED = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n)


PHRASES = """all rights reserved/cookie policy/use cookies/privacy policy/terms of service/terms of use/lorem ipsum/enable javascript/permission is hereby granted/licensed under the/copyright (c)/subscribe to our newsletter/alle rechte vorbehalten/verwendet cookies/datenschutzerklärung/allgemeine geschäftsbedingungen/tous droits réservés/utilise des cookies/politique de confidentialité/mentions légales/todos los derechos reservados/utiliza cookies/política de privacidad/aviso legal""".split("/")
ENDS = tuple(".!?…:;\"')]»”’。！？")


def line_rules(text):
    """(kept, words left, the lines that pass)."""
    lines = [x for x in (text or "").split("\n")]
    full = [x for x in lines if WORD.search(x)]
    short = [len(WORD.findall(x)) <= 3 and not WORD.findall(x)[-1].endswith(ENDS) for x in full]
    passed, seen, at, left = [], set(), -1, 0
    for line in lines:
        w = WORD.findall(line)
        if not w:
            passed.append(line)
            continue
        at += 1
        lone = sum(x in ("|", ">", "»", "•", "·", "/") for x in w)
        bad = 2 * sum(len(re.findall(r"[#*$%&|<>]", x)) >= 2 for x in w) > len(w)
        bad |= len(w) >= 3 and all(x[-1] in "!?*#%$&|" for x in w)
        bad |= len(w) >= 5 and not any(x.endswith(ENDS) for x in w)
        bad |= lone >= 2 and 5 * lone >= len(w)
        bad |= short[at] and any(short[i] for i in (at - 1, at + 1) if 0 <= i < len(short))
        bad |= any(p in line.lower() for p in PHRASES)
        bad |= line in seen
        seen.add(line)
        if not bad:
            passed.append(line)
            left += len(w)
    n, failed = len(WORD.findall(text or "")), quality(text)[-1]
    return (not failed and 2 * left >= n, left, "\n".join(passed))


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(rows, percent=85):
    """doc_id -> (n_shingles, component_id), for different doc_ids."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    both = Counter((a, b) for held in holders.values() for i, a in enumerate(held) for b in held[i + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


def lines_kept(rows):
    held = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(d)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), d) == d]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def repeats(texts, width=200):
    """Per text: bytes, removed bytes, runs and the remaining bytes' digest."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(hash(r[i : i + width]) for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[hash(r[i : i + width])] > 1:
                mark[i : i + width] = b"\x01" * width
        rest = bytes(c for c, m in zip(r, mark, strict=True) if not m)
        out.append((len(r), len(r) - len(rest), len(re.findall(b"\x01+", bytes(mark))), hashlib.sha256(rest).hexdigest()))
    return out


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in KEYED.finditer(text) if len(m[1]) >= 6]
    access = [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    hexes = [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found + access + hexes))
    return (len(found), len(access), len(hexes), hashlib.sha256(spans.encode()).hexdigest(), spans)


def targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """source -> target; sources by code point, null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, budget, out = set(names), share * sum(sizes.values()), {}
    while left:
        total = sum(weight[s] for s in left)
        over = [s for s in left if budget * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: budget * weight[s] / total for s in left}
        for s in over:
            out[s] = cap * sizes[s]
            left.discard(s)
        budget = share * sum(sizes.values()) - sum(out.values())
    return out
