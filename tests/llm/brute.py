"""Plain versions of the training-data operators."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from decimal import Decimal

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def covered(seqs, size):
    """Marks per row: covered by a window that starts in a smaller id. Rows are (id or None, sequence)."""
    first: dict = {}
    for i, s in seqs:
        if i is not None:
            for p in range(len(s) - size + 1):
                k = tuple(s[p : p + size])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, s in seqs:
        marks = [False] * len(s)
        if i is not None:
            for p in range(len(s) - size + 1):
                if first[tuple(s[p : p + size])] < i:
                    marks[p : p + size] = [True] * size
        out.append(marks)
    return out


def op3(rows):
    seqs = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for (i, s), m in zip(seqs, covered(seqs, 50), strict=True):
        kept = bytes(b for b, x in zip(s, m, strict=True) if not x)
        spans = sum(x and not (k and m[k - 1]) for k, x in enumerate(m))
        out.append((i, len(s), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return out


def op10(rows):
    seqs = [(i, words(t)) for i, t in rows]
    return [(i, len(s), sum(m), hashlib.sha256(" ".join(w for w, x in zip(s, m, strict=True) if not x).encode()).hexdigest()) for (i, s), m in zip(seqs, covered(seqs, 50), strict=True)]


def shingles(text):
    w = words(text, True)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def op7(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if i is not None and j is not None and s and t and 100 * both >= 75 * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def held_out(i, modulus):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == 2


def op8_base(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base) per row."""
    count = Counter()
    seqs = [(i, [*words(t, True), None]) for i, t in rows]
    for i, s in seqs:
        if i is not None and not held_out(i, 7):
            count.update(s)
    n, v = sum(count.values()), len(count)
    return [(i, held_out(i, 7), len(s), sum(count[w] > 0 for w in s), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in s)) for i, s in seqs]


def op4(rows, items, threshold=0.75):
    """Best window of every document and item, tried at all places."""
    out = []
    for i, t in rows:
        w = words(t, True)
        for k, text in items:
            iw = words(text, True)
            gram = min(5, len(iw))
            if not gram or i is None or k is None or len(w) < gram:
                continue
            grams = [tuple(w[p : p + gram]) for p in range(len(w) - gram + 1)]
            item = Counter(tuple(iw[p : p + gram]) for p in range(len(iw) - gram + 1))
            size = min(sum(item.values()), len(grams))
            best = 0
            for p in range(len(grams) - size + 1):
                c = Counter(grams[p : p + size])
                both = sum((c & item).values())
                best = max(best, both / (sum(item.values()) + size - both))
            if best >= threshold:
                out.append((i, k, round(best, 6)))
    return sorted(out)


def segmentations(word: bytes, probability: dict, zero=0.0):
    """Summed probability of all ways to cut ``word``."""
    total = [zero + 1] + [zero] * len(word)
    for a in range(len(word)):
        for b in range(a + 1, len(word) + 1):
            if word[a:b] in probability:
                total[b] += total[a] * probability[word[a:b]]
    return total[len(word)]


def op8_score(rows, path):
    """log10 probability of each row's text, said again from the definition."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    strings = {}  # of each piece as bytes: its rank
    for i in range(m.get_piece_size()):
        if m.is_byte(i):
            strings.setdefault(bytes([int(m.id_to_piece(i)[3:5], 16)]), m.get_piece_size())
        elif not (m.is_control(i) or m.is_unknown(i)):
            b = m.id_to_piece(i).encode()
            strings[b] = min(strings.get(b, m.get_piece_size()), max(0.0, -m.get_score(i)))
    zipf = {b: 1 / (1 + r) for b, r in strings.items()}
    whole = sum(zipf.values())
    pieces = {b: len(zipf) * z / whole for b, z in zipf.items()}
    count, ends = Counter(), 0
    for i, t in rows:
        if i is not None and not held_out(i, 7):
            ends += 1
            count.update(words(t, True))
    for w, c in count.items():
        for i in m.encode(w):
            if m.is_byte(i):
                pieces[bytes([int(m.id_to_piece(i)[3:5], 16)])] += c
            elif not (m.is_control(i) or m.is_unknown(i)):
                pieces[m.id_to_piece(i).encode()] += c
    total = sum(pieces.values()) + ends + 1
    p = {b: Decimal(c / total) for b, c in pieces.items()}  # a long word's probability is below any float
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)

    def probability(c, spread):
        return float(((c + Decimal(spread) * max(v, 1)) / (n + max(v, 1))).log10())

    end = probability(ends, (ends + 1) / total)
    known = {}
    for _, t in rows:
        for w in words(t, True):
            if w not in known:
                known[w] = probability(count[w], segmentations("▁".encode() + w.encode(), p, Decimal(0)))
    return [(i, sum(known[w] for w in words(t, True)) + end) for i, t in rows]


def best_path(seen, model):
    """The likeliest states of a hidden Markov model for the observed rows, ties to the lower state."""
    if not seen:
        return []
    n = len(model.start)

    def emit(state, row):
        return sum(table[state, x] for table, x in zip(model.emit, row, strict=True))

    best, back = [model.start[s] + emit(s, seen[0]) for s in range(n)], []
    for row in seen[1:]:
        came = [max(range(n), key=lambda a: (best[a] + model.step[a, s], -a)) for s in range(n)]
        best = [best[came[s]] + model.step[came[s], s] + emit(s, row) for s in range(n)]
        back.append(came)
    path = [max(range(n), key=lambda s: (best[s], -s))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]
