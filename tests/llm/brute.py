"""Plain versions of the operators, text by text."""

import hashlib
import math
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def substrings(rows, width):
    """(doc_id, n_words, n_removed, kept) of (doc_id, text) rows."""
    words = [SPACED.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def shingles(text, width):
    w = SPACED.findall(low(text))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(ids, linked):
    """Smallest reachable id for every id."""
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            if (label[a], label[b]) != (m, m):
                label[a] = label[b] = m
                changed = True
    return label


def near_duplicates(rows, width, percent=80):
    """(doc_id, n_shingles, component_id, kept) of rows with distinct ids."""
    sets = {doc: shingles(text, width) for doc, text in rows}
    ids = sorted(sets)
    linked = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    label = components(ids, linked)
    return [(i, len(sets[i]), label[i], label[i] == i) for i in ids]


def windows(items, width):
    """{window: items}"""
    out = {}
    for name, text in items:
        w = LETTERED.findall(low(text))
        size = min(width, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            out.setdefault(tuple(w[i:i + size]), set()).add(str(name))
    return out


def contamination(text, known):
    """Word spans, hit words and items of a text."""
    found = list(LETTERED.finditer(low(text)))
    w = [m[0] for m in found]
    hit, names = set(), set()
    for size in {len(k) for k in known}:
        for i in range(len(w) - size + 1):
            own = known.get(tuple(w[i:i + size]))
            if own:
                hit.update(range(i, i + size))
                names |= own
    return [m.span() for m in found], hit, names


def contamination_row(doc, text, known):
    spans, hit, names = contamination(text, known)
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return doc, len(spans), len(hit), len(names), digest, bool(hit)


def decontaminated(text, known, most=0.5):
    """The text without hit spans, or None if too much of it is hit."""
    spans, hit, _ = contamination(text, known)
    if not hit:
        return text
    if len(hit) > most * len(spans):
        return None
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out += [text[at:spans[i][0]], "\n"]
        if i + 1 not in hit:
            at = spans[i][1]
    return "".join([*out, text[at:]])


BYTE_WORD = re.compile(rb"[a-z\x80-\xff]+")


def learned_words(labelled, sample_bytes, foreign):
    """{language: words it learns}, from (language, text) rows."""
    words = {name: [w for n, t in labelled if n == name for w in BYTE_WORD.findall(low(t).encode())] for name in sorted({n for n, _ in labelled})}
    rate = {name: {w: c / len(own) for w, c in Counter(own).items()} for name, own in words.items()}
    out = {}
    for name, own in rate.items():
        left, kept = sample_bytes // len(words), []
        for w in dict.fromkeys(words[name]):
            if own[w] * foreign >= max(r.get(w, 0) for r in rate.values()) and len(w) + 2 <= left:
                left -= len(w) + 2
                kept.append(w)
        out[name] = kept
    return out


class Languages:
    """Cross-parses by sets of all substrings of ` word `."""

    def __init__(self, words):
        self.bits = {n: math.log2(max(2, sum(len(w) + 2 for w in own))) for n, own in words.items()}
        self.parts = {n: {p[i:j] for w in own for p in [b" " + w + b" "] for i in range(len(p)) for j in range(i + 1, len(p) + 1)} for n, own in words.items()}
        self.seen = {}

    def phrases(self, word):
        """For each language the number of phrases of ` word `, each the longest known one or one byte."""
        if word not in self.seen:
            padded, counts = b" " + word + b" ", {}
            for name, parts in self.parts.items():
                at = n = 0
                while at < len(padded):
                    to = at + 1
                    while to < len(padded) and padded[at:to] in parts and padded[at:to + 1] in parts:
                        to += 1
                    at, n = to, n + 1
                counts[name] = n
            self.seen[word] = counts
        return self.seen[word]

    def of(self, text):
        """(language, margin, bits a byte, bytes a phrase, bytes) of a text."""
        words = BYTE_WORD.findall(low(text).encode())
        size = sum(len(w) + 2 for w in words)
        if not words or not any(c.isalpha() for c in low(text)):
            return "und", 0.0, math.inf, 0.0, size
        cost = {n: sum(self.phrases(w)[n] for w in words) * self.bits[n] / size for n in self.bits}
        best = min(sorted(cost), key=cost.get)
        rest = [c for n, c in cost.items() if n != best]
        return best, 1 - cost[best] / min(rest) if rest else 1.0, cost[best], self.bits[best] / cost[best], size
