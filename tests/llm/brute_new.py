"""Brute-force versions of the lexical search, suffix dedup and conversation repair."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


# ---- ranked lexical search --------------------------------------------------------

def terms(text):
    fold = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    return [t.translate(fold) for t in TERM.findall(text or "")]


def search(documents, items, k=10):
    """[(doc_id, text)], [(item_id, text)] -> {(item_id, rank, doc_id, score)}"""
    counts = [(i, Counter(terms(t))) for i, t in documents]
    held = [(i, c, sum(c.values())) for i, c in counts if c]
    total, n_docs = sum(n for _, _, n in held), len(held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scores = []
        for i, c, n in held:
            m = 25 + (75 * n * n_docs) // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


# ---- repeated byte strings ----------------------------------------------------------

def repeated_bytes(texts, width=400):
    """[text] -> [(n_bytes, n_removed, n_spans, kept_sha256)]"""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k:k + width] for d in data for k in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - width + 1):
            if seen[d[k:k + width]] > 1:
                gone[k:k + width] = b"\1" * width
        runs = re.findall(b"\1+", bytes(gone))
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(map(len, runs)), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


# ---- conversations --------------------------------------------------------------------

def damage(rows):
    """[(conv_id, turn, role, text)] -> the rows after damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        own = out.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(BLANKS)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen
                   else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit) and the repaired rows, by a search over edit sequences."""
    legal = re.compile("(s?(ua)+)?")
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}
    found = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, made = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            initials = "".join(r[:1] for r, _ in made)
            assert legal.fullmatch(initials), initials
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in made)
        if (at, last) in done:
            continue
        done.add((at, last))
        for role in ("user", "assistant"):
            if role[0] in moves[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", at, role[0], (*made, (role, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, made))
            if found[at] not in ("blank", "duplicate"):
                more = 3 if found[at] == "truncated" else 0
                if role[:1] and role[:1] in moves[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[0], (*made, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in moves[last]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, new[0], (*made, (new, text))))


def repairs(table):
    """[(conv_id, turn, role, text)] -> {conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)}"""
    out = {}
    for conv, rows in damage(table).items():
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found = faults(rows)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, text = cheapest(rows) if rows else (0, "", "")
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out
