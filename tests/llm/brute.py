"""Plain Python forms of the operators, for small fixtures."""

import functools
import hashlib
import re
from collections import Counter

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")
ALL64 = (1 << 64) - 1


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def majority(hashes):
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, k=3):
    w = words(lower_ascii(text))
    if not w:
        return 0
    return majority([xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))])


def groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def near_fingerprints(prints, radius=3):
    prints = sorted(set(prints))
    return groups(prints, [(a, b) for i, a in enumerate(prints) for b in prints[:i] if bin(a ^ b).count("1") <= radius])


def within(a, b, most):
    """Whether at most `most` edits lead from a to b; cells further off the diagonal than that cannot matter."""
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = min(row.get(j, most) + 1, new.get(j - 1, most) + 1, row.get(j - 1, most + 1) + (x != b[j - 1])) if j else i
        row = new
        if min(row.values()) > most:
            return False
    return row[len(b)] <= most if len(b) in row else False


def blocks(n, kind):
    """The number of blocks; 0 where six blocks count two by two."""
    if not kind and n <= 16:
        return 0
    levels = [1, 2, 3, *(k for i in range(2, 16) for k in (1 << i, 3 << i - 1))]
    return min(k for k in levels if k >= max(1, n // 10)) + 4


MARKS = ".,;:!?\"'()[]{}<>*_-…«»“”„‘’、。，！？：；"


@functools.cache
def keys(norm):
    """The blocks of a line: {(kind, number of blocks, block, SimHash of the features that fall in it)}, and its signs."""
    some, out, signs = norm.split(" "), set(), [None, None, None]
    kinds = [(0, set(some))] if len(some) >= 8 and len(norm) <= 17 * len(some) else []
    if len(some) <= 8 or len(norm) >= 14 * len(some):
        whole = re.sub(r"[\W_]+", "", norm) or norm
        kinds.append((1, {whole[i : i + 2] for i in range(max(1, len(whole) - 1))}))
    for kind, parts in kinds:
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for x in parts if (w := x.strip(MARKS)) or kind]
        bits = functools.reduce(int.__or__, (1 << (h >> 58) for h in hashes), 0)
        if kind:
            signs[2] = bits
        else:
            signs[:2] = bits, functools.reduce(int.__or__, (1 << (h >> 58) for h in hashes if h >> 40 & 7 == 0), 0)
        for m in {blocks(len(parts), kind), blocks(-(-len(parts) * 112 // 100) + 1, kind)}:
            dealt = [(block, own) for block in range(m or 6) if (own := [h for h in hashes if signed(h) % (m or 6) == block])]
            if m:
                out |= {(kind, m, block, majority(own)) for block, own in dealt}
            else:
                out |= {(b, majority(x), c, majority(y)) for i, (b, x) in enumerate(dealt) for c, y in dealt[i + 1 :] if (len(x) + len(y)) * 4 >= len(parts)}
    return out, signs


def alike(x, y, most):
    differ = [None if a is None or b is None else (a ^ b).bit_count() for a, b in zip(x, y, strict=True)]
    return all(d is None or d <= 4 + a.bit_count() * 3 // 10 for d, a in zip(differ[:2], x, strict=False)) and (differ[2] is None or differ[2] <= 4 * most)


@functools.cache
def letters(x):
    return Counter(x)


def close(a, b):
    """Edit similarity of 0.9 or more, of lines beyond 2,000 characters over words; what one line has of letters beyond the other is a bound that is quick to find."""
    most = max(len(a), len(b)) // 10
    if abs(len(a) - len(b)) > most or (letters(a) - letters(b)).total() > most or (letters(b) - letters(a)).total() > most:
        return False
    if max(len(a), len(b)) > 2_000 and all(len(x) <= 17 * len(x.split(" ")) for x in (a, b)):
        a, b = a.split(" "), b.split(" ")
        most = max(len(a), len(b)) // 10
    return within(a, b, most)


def meet(a, b):
    """Near lines that share a block, and are alike both ways or one."""
    (x, p), (y, q) = keys(a), keys(b)
    most = max(len(a), len(b)) // 10
    return max(len(a), len(b)) * 10 // 9 >= 10 and not x.isdisjoint(y) and (alike(p, q, most) or alike(q, p, most)) and close(a, b)


def line_dedup(docs, near=meet):
    """(lines, removed lines, kept text) of each document, with one line left of those that `near` pairs connect."""
    norm = {(doc, no): " ".join(SPACE.split(line.lower().strip(" \t\n\v\f\r"))) for doc, text in docs for no, line in enumerate((text or "").split("\n"))}
    norm = {at: n for at, n in norm.items() if n}
    lines = sorted(set(norm.values()))
    group, first = groups(lines, [(a, b) for i, a in enumerate(lines) for b in lines[:i] if near(a, b)]), {}
    for at, n in norm.items():
        place = (at[0] is None, at[0] or 0, at[1])
        first[group[n]] = min(first.get(group[n], place), place)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        keep = [x for no, x in enumerate(lines) if (doc, no) not in norm or first[group[norm[doc, no]]] == (doc is None, doc or 0, no)]
        out[doc] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def normal(text):
    return re.sub(r"[^\w]|_", " ", (text or "").lower()).split()


def weighted(a, b, k=5):
    cut = lambda w: [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    x, y = cut(a), cut(b)
    inter = sum(min(x.count(s), y.count(s)) for s in set(x))
    return inter / (len(x) + len(y) - inter)


def leaks(docs, items, at_least=0.8):
    """(doc_id, item_id) where some window of the item's size is similar enough."""
    out = set()
    for doc, text in docs:
        w = normal(text)
        for item, t in items:
            p = normal(t)
            if p and w and any(weighted(w[i : i + len(p)], p) >= at_least for i in range(max(1, len(w) - len(p) + 1))):
                out.add((doc, item))
    return out


def substring(docs, window=13):
    first = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in docs:
        w = words(text)
        gone = {i + j for i in range(len(w) - window + 1) if doc is not None and first[tuple(w[i : i + window])] < doc for j in range(window)}
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def best_tokens(token, scores, byte):
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        n = len(token[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, -best[end - 1][1] - n)]
        options += [(best[i][0] + scores[token[i:end]], -best[i][1] - 1) for i in range(end) if token[i:end] in scores]
        s, c = max(options)
        best.append((s, -c))
    return best[-1][1]
