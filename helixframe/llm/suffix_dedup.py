"""Substring deduplication by blockwise suffix sorting with a difference cover.

Contents that share a minimizer are laid out in blocks of a few megabytes, and the suffixes at their
windows are sorted one bucket of a block at a time, so that only a block's text, its cover ranks (32
bits a place) and a bucket's keys are in memory. A bucket is sorted by the suffixes' first ``PERIOD``
bytes; longer ties are settled by the ranks of cover samples, computed beforehand: between places of
any two residues there is an offset below the period at which both are samples. Neighbours in the
order whose ``size`` bytes are equal are one group, and a window repeats if its group holds a smaller
document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import utf8
from .windows import Elements, Rule, covered, group_edges, minimizers, repeated_windows, spans_of

PERIOD = 7  # seven bytes fit a 64-bit key with room to spare
COVER = (0, 1, 3)  # every difference modulo 7 occurs between two of these
SAMPLED = np.isin(np.arange(PERIOD), COVER)
#: OFFSET[a, b]: how far from places of residues a and b both are samples.
OFFSET = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


class CoverRanks:
    """Ranks of the sampled suffixes by their first ``depth`` bytes or more, 32 bits each; equal bytes, equal rank."""

    def __init__(self, data: np.ndarray, depth: int):
        n = len(data)
        padded = np.concatenate([data, np.zeros(PERIOD, np.uint8)])
        self.key = np.zeros(n, np.uint64)
        for k in range(PERIOD):
            self.key <<= np.uint64(8)
            self.key |= padded[k : k + n]
        sample = np.flatnonzero(SAMPLED[np.arange(n) % PERIOD])
        self.rank = np.zeros(n + 2 * max(depth, PERIOD) + 2 * PERIOD, np.int32)
        self.rank[sample] = np.unique(self.key[sample], return_inverse=True)[1] + 1
        reach = PERIOD
        while reach < depth:  # prefix doubling stays on samples: the period maps them to samples
            both = self.rank[sample].astype(np.int64) << 32 | self.rank[sample + reach]
            self.rank[sample] = np.unique(both, return_inverse=True)[1] + 1
            reach *= 2


def sorted_buckets(data: np.ndarray, places: np.ndarray, depth: int, bucket: int = 1 << 18):
    """The suffixes at ``places`` in order of their first ``depth`` bytes at least, a bucket at a time."""
    ranks = CoverRanks(data, depth)
    key = ranks.key[places]
    step = max(1, len(key) // 4096)
    sample = np.sort(key[::step])
    splitters = np.unique(sample[bucket // step :: max(1, bucket // step)])
    of = np.searchsorted(splitters, key, side="right")
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(len(splitters) + 2))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            yield _sort_bucket(places[order[a:b]], key[order[a:b]], ranks.rank)


def _sort_bucket(places: np.ndarray, key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    edge = group_edges(key)
    size = np.diff(np.append(edge, len(key)))
    group = np.repeat(np.arange(len(edge)), size)
    tied = np.flatnonzero(np.repeat(size > 1, size))
    if not len(tied):
        return places
    at, tie = places[tied], group[tied] << 32
    before = np.zeros(len(tied), np.int64)  # how many of its tie group stand before each
    members = [np.flatnonzero(at % PERIOD == r) for r in range(PERIOD)]
    for d in range(PERIOD):  # the ranks at each offset serve all pairs of residues that meet there
        code = tie | rank[at + d]
        for b in range(PERIOD):
            met = [a for a in range(PERIOD) if OFFSET[a, b] == d and len(members[a])]
            if not met or not len(members[b]):
                continue
            other = np.sort(code[members[b]])
            mine = np.concatenate([members[a] for a in met])
            before[mine] += np.searchsorted(other, code[mine]) - np.searchsorted(other, tie[mine])
    places[tied] = at[np.lexsort((before, tie))]
    return places


def same_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` equal those at ``b``, pair by pair."""
    rows = np.lib.stride_tricks.sliding_window_view(data, size)
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 1 << 17):
        out[lo : lo + (1 << 17)] = (rows[a[lo : lo + (1 << 17)]] == rows[b[lo : lo + (1 << 17)]]).all(axis=1)
    return out


def blocks(key: np.ndarray, length: np.ndarray, limit: int):
    """Indices of the rows whose key another row has too, whole keys together, in blocks of ``limit`` bytes or one key."""
    order = np.argsort(key, kind="stable")
    edge = group_edges(key[order])
    size = np.diff(np.append(edge, len(order)))
    order, size = order[np.repeat(size > 1, size)], size[size > 1]
    if not len(size):
        return
    ends = np.cumsum(size)
    total = np.cumsum(length[order])[ends - 1]
    lo, done = 0, 0
    while lo < len(order):
        k = max(int(np.searchsorted(total, done + limit, side="right")), int(np.searchsorted(ends, lo, side="right")) + 1)
        yield order[lo : ends[k - 1]]
        lo, done = int(ends[k - 1]), int(total[k - 1])


def suffix_matcher(elements: Elements, least: np.ndarray, rule: Rule, limit: int = 2 << 20):
    """Windows of each content that stand, in any context, in a document smaller than the content's own.

    All windows of a content hold its minimizer, so contents of different minimizers have no window
    in common and are sorted in different blocks; a minimizer of one content only has nothing to sort.
    """
    data, first, size = elements.data, elements.first, rule.size
    key, _ = minimizers(elements, rule)
    for some in blocks(key, np.diff(first), limit):
        length = np.diff(first)[some]
        start = np.cumsum(length) - length
        inside = np.arange(length.sum()) - np.repeat(start, length)
        text = data[np.repeat(first[some], length) + inside]
        places = np.flatnonzero(inside <= np.repeat(length - size, length))
        found = []
        for order in sorted_buckets(text, places, size):
            owner = least[some[np.searchsorted(start, order, side="right") - 1]]
            edge = np.concatenate([[0], np.flatnonzero(~same_prefix(text, order[:-1], order[1:], size)) + 1])
            smallest = np.repeat(np.minimum.reduceat(owner, edge), np.diff(np.append(edge, len(order))))
            found.append(order[smallest < owner])
        hit = np.sort(np.concatenate(found))
        which = np.searchsorted(start, hit, side="right") - 1
        which, at, windows = spans_of(which, hit - start[which])
        yield some[which], at, windows


def remove_repeats(docs: DataFrame, size: int = 50, gram: int = 20, text: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each byte covered by ``size`` bytes that also start in a document with a smaller doc_id.

    Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the sha256 of what is
    left; ``with_text`` adds that text, with bytes replaced where a cut split a character. Null
    reads as empty; a null doc_id is neither smaller nor greater than any other.
    """
    spec = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    names = [x.split()[0] for x in spec.split(", ")]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows = []
            for i, spans in enumerate(batch.column(2)):
                part = data[offsets[i] : offsets[i + 1]]
                cut = covered(spans.values.to_numpy() if spans.is_valid else None, len(part))
                kept, at, digest = [], 0, hashlib.sha256()
                for a, b in [*cut.tolist(), (len(part), len(part))]:
                    piece = part[at:a].tobytes()
                    digest.update(piece)
                    if with_text:
                        kept.append(piece)
                    at = b
                rows.append((len(part), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), digest.hexdigest(), *([b"".join(kept).decode(errors="replace")] if with_text else [])))
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if k >= 3 else pa.int64()) for k, c in enumerate(columns))], names=names)

    return repeated_windows(docs, Rule(size, gram, False), suffix_matcher, text).mapInArrow(run, spec)


def op3_suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its bytes, those covered by 50 bytes that a smaller doc_id has, and a hash of the rest.

    Null and empty texts have 0 bytes. A null doc_id is compared with nothing; rows of one doc_id are
    not each other's smaller document, so repeated rows all keep their bytes unless a smaller doc_id
    has them. No documents give no row. Columns other than doc_id and text are ignored.
    """
    return remove_repeats(docs)
