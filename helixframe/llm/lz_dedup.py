"""Passage deduplication by relative Lempel-Ziv parsing.

A bucket's different contexts form a reference block, indexed by its windows of ``size`` words. A
document's words are factored greedily against it: the longest copy of a smaller document's words
from here on is one factor. A factor shorter than a window is a literal. Windows that begin inside
a factor but end past it are looked up one by one at the factor's boundary, so a passage that is
pieced together from several sources is found as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .shared import mix, prefix_sums, range_hash, utf8, words
from .windows import Elements, Rule, covered, group_edges, repeated_windows


class Reference:
    """A block of word sequences, indexed by their windows: for each window, its smallest document and a place there.

    ``values`` are numbers of words, equal for equal words only. The index is a hash of windows; a factor
    is a run of words found equal one by one.
    """

    def __init__(self, values: np.ndarray, first: np.ndarray, owner: np.ndarray, size: int):
        self.values, self.first, self.size = values, first, size
        count = np.maximum(np.diff(first) - size + 1, 0)
        base = np.cumsum(count) - count
        self.base = base
        self.place = np.arange(count.sum()) - np.repeat(base - first[:-1], count)
        sums = prefix_sums(mix(values))
        self.window = range_hash(sums, self.place, self.place + size)
        self.doc = np.repeat(owner, count)
        order = np.lexsort((self.place, self.doc, self.window))
        edge = group_edges(self.window[order])
        size_of = np.diff(np.append(edge, len(order)))
        self.source = np.empty(len(order), np.int64)  # of each window: a place of it in its smallest document
        self.smallest = np.empty(len(order), np.int64)
        self.source[order] = np.repeat(self.place[order][edge], size_of)
        self.smallest[order] = np.repeat(self.doc[order][edge], size_of)

    def common(self, a: int, b: int, limit: int) -> int:
        """How many words agree from ``a`` and ``b`` on, at most ``limit``."""
        differ = np.flatnonzero(self.values[a : a + limit] != self.values[b : b + limit])
        return int(differ[0]) if len(differ) else limit

    def longest(self, at: int, hi: int, sources) -> tuple[int, int]:
        """The longest run of words from ``at`` on that one of the places ``sources`` has too: its length and that place."""
        best = (0, 0)
        for source in sources:
            stop = int(self.first[np.searchsorted(self.first, source, side="right")])
            n = self.common(at, source, min(hi - at, stop - source))
            if n > best[0]:
                best = (n, source)
        return best

    def factors(self, which: int, doc: int):
        """(first word, words, source) of the factors of one sequence whose sources are smaller documents."""
        lo, hi = int(self.first[which]), int(self.first[which + 1])
        at = lo
        while at + self.size <= hi:
            w = int(self.base[which]) + at - lo
            if self.smallest[w] >= doc:  # a literal: no smaller document goes on like this for a window
                at += 1
                continue
            n, source = self.longest(at, hi, [int(self.source[w])])
            if n < self.size:  # a chance collision of the index: try all places under this hash
                n, source = self.longest(at, hi, self.place[(self.window == self.window[w]) & (self.doc < doc)].tolist())
            if n < self.size:
                at += 1
                continue
            yield at - lo, n, source
            at += n - self.size + 1  # the next windows straddle the boundary and are looked up themselves


def word_numbers(elements: Elements) -> np.ndarray:
    """A number for each word of ``elements``, equal for equal words only."""
    known: dict[bytes, int] = {}
    raw = elements.data.tobytes()
    split = (raw[a:b] for a, b in zip(elements.start.tolist(), elements.end.tolist(), strict=True))
    return np.fromiter((known.setdefault(w, len(known)) for w in split), np.uint64, len(elements.start))


def lz_matcher(elements: Elements, least: np.ndarray, rule: Rule):
    """Spans of each content that factors from smaller documents cover."""
    reference = Reference(word_numbers(elements), elements.first, least, rule.size)
    count = np.maximum(np.diff(elements.first) - rule.size + 1, 0)
    # sequences of which no window is in the index under a smaller document are literals throughout
    some = np.unique(np.repeat(np.arange(len(count)), count)[reference.smallest < reference.doc])
    found = [(u, at, n - rule.size + 1) for u in some.tolist() for at, n, _ in reference.factors(u, int(least[u]))]
    which, at, windows = np.array(found, np.int64).reshape(-1, 3).T
    yield which, at, windows


def remove_passages(docs: DataFrame, size: int = 50, gram: int = 16, text: str = "text", with_text: bool = False, carry: bool = False) -> DataFrame:
    """Remove each word covered by ``size`` words that also start in a document with a smaller doc_id.

    Per row: doc_id, n_words, n_removed and the sha256 of the kept words joined by one space;
    ``with_text`` adds the text without the removed words and the white space after them. Null reads
    as empty; a null doc_id is neither smaller nor greater than any other.
    """
    spec = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    names = [x.split()[0] for x in spec.split(", ")] + ["others"] * carry
    repeats = repeated_windows(docs, Rule(size, gram, True), lz_matcher, text, carry=carry)
    if carry:
        schema = StructType([*StructType.fromDDL(spec).fields, repeats.schema["others"]])
    else:
        schema = spec

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows = []
            for i, spans in enumerate(batch.column(2)):
                part = data[offsets[i] : offsets[i + 1]]
                raw = part.tobytes()
                if not spans.is_valid:
                    split = raw.split()
                    rows.append((len(split), 0, hashlib.sha256(b" ".join(split)).hexdigest(), *([raw.decode()] if with_text else [])))
                    continue
                start, end, _ = words(part, np.array([0, len(part)]))
                cut = covered(spans.values.to_numpy(), len(start))
                kept, at, digest = [], 0, hashlib.sha256()
                for a, b in [*cut.tolist(), (len(start), len(start))]:
                    if at < a:
                        digest.update((b" " if kept else b"") + b" ".join(raw[start[at] : end[a - 1]].split()))
                        kept.append(raw[start[at] : start[a] if a < len(start) else len(raw)])
                    at = b
                rows.append((len(start), int((cut[:, 1] - cut[:, 0]).sum()), digest.hexdigest(), *([b"".join(kept).decode()] if with_text else [])))
            columns = list(zip(*rows, strict=True)) or [()] * (3 + with_text)
            arrays = [pa.array(c, pa.string() if k >= 2 else pa.int64()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, *([batch.column(3)] if carry else [])], names=names)

    return repeats.mapInArrow(run, schema)


def op10_passage_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its words, those covered by 50 words that a smaller doc_id has, and a hash of the rest.

    Null and empty texts have 0 words. A null doc_id is compared with nothing; rows of one doc_id are
    not each other's smaller document, so repeated rows all keep their words unless a smaller doc_id
    has them. No documents give no row. Columns other than doc_id and text are ignored.
    """
    return remove_passages(docs)
