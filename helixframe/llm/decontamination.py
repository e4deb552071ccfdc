"""Benchmark decontamination by SimHash windows.

An item and a window of a document as long as the item are multisets of five-word shingles (the whole
item where it is shorter; the whole document where that is shorter than the item). Windows in which
fewer shingles occur in the benchmark than the threshold asks for are passed over, whatever the item.
The 64-bit SimHash fingerprints of all other windows are looked up in a multi-index, which says what
items a window may match: cut into 8 blocks, two fingerprints within ``radius`` bits agree within
``radius // 8`` bits in some block, and a table per block and item size gives all items that close to
any block value. What is within the radius in all 64 bits is verified by the exact weighted Jaccard
similarity of the multisets.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import grams, materialize, row_ranges, utf8, word_hashes

LEAKS = "doc_id long, item_id long, similarity double, window_start long, window_words long, hamming int"


def bit_votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    bits = np.unpackbits(np.ascontiguousarray(shingles, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


CHUNK = 4096  # windows, or shingles, whose 64 votes are in memory together


def fingerprints(shingles: np.ndarray, size: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """SimHash, as 8 bytes, of the windows of ``size`` shingles that start at ``lo`` to ``hi``."""
    hi = len(shingles) - size + 1 if hi is None else hi
    votes = np.zeros(64, np.int32)
    for k in range(lo, lo + size, CHUNK):
        votes += bit_votes(shingles[k : min(k + CHUNK, lo + size)]).sum(axis=0, dtype=np.int32)
    out = np.empty((hi - lo, 8), np.uint8)
    for k in range(lo, hi, CHUNK):
        end = min(k + CHUNK, hi)
        steps = np.zeros((end - k + 1, 64), np.int32)  # the last row is the first window of the next chunk
        steps[0] = votes
        new = min(end, len(shingles) - size)  # windows that have a next one
        if new > k:
            steps[1 : new - k + 1] = bit_votes(shingles[k + size : new + size]) - bit_votes(shingles[k:new])
        np.cumsum(steps, axis=0, out=steps)
        votes = steps[-1].copy()
        out[k - lo : end - lo] = np.packbits(steps[: end - k] > 0, axis=1, bitorder="little")
    return out


def weighted_similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


@dataclass
class Items:
    """One block of the benchmark, indexed."""

    radius: int
    threshold: float
    ids: list[int] = field(default_factory=list)
    gram: list[int] = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)
    prints: list[np.ndarray] = field(default_factory=list)

    def add(self, item_id: int, shingles: np.ndarray, gram: int) -> None:
        self.ids.append(item_id)
        self.gram.append(gram)
        self.counts.append(Counter(shingles.tolist()))
        self.prints.append(fingerprints(shingles, len(shingles))[0])

    def index(self) -> Items:
        sizes = np.array([sum(c.values()) for c in self.counts], np.int64)
        popcount = np.array([bin(i).count("1") for i in range(256)], np.uint8)
        self.popcount = popcount
        values = np.arange(256, dtype=np.uint8)
        #: per gram: the shingles of its items, a table of their high bits, and a multi-index per item size
        self.by_gram = {}
        for gram in sorted(set(self.gram)):
            mine = np.array([g == gram for g in self.gram])
            known = np.unique(np.array([s for c, g in zip(self.counts, self.gram, strict=True) if g == gram for s in c], np.uint64))
            table = np.zeros(1 << 20, bool)
            table[known >> np.uint64(44)] = True
            by_size = {}
            for size in np.unique(sizes[mine]).tolist():
                items = np.flatnonzero(mine & (sizes == size))
                block = np.array([self.prints[i] for i in items.tolist()], np.uint8).reshape(-1, 8)
                # near[b, v]: bit set of the items whose block b is within radius // 8 bits of v
                near = np.stack([np.packbits(popcount[values[:, None] ^ block[None, :, b]] <= self.radius // 8, axis=1) for b in range(8)])
                by_size[size] = (items, block, near)
            self.by_gram[gram] = (known, table, by_size)
        return self

    def candidates(self, prints: np.ndarray, gram: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all fingerprints within the radius: the block tables bring them together."""
        items, block, near = self.by_gram[gram][2][size]
        found = near[0][prints[:, 0]]
        for b in range(1, 8):
            found = found | near[b][prints[:, b]]
        window, item = np.nonzero(np.unpackbits(found, axis=1, count=len(items)))
        distance = self.popcount[prints[window] ^ block[item]].sum(axis=1, dtype=np.int64)
        within = distance <= self.radius
        return window[within], items[item[within]], distance[within]

    def leaks(self, shingles: np.ndarray, gram: int, hits: np.ndarray):
        """(item, similarity, first word, words, distance) of the best window of each item that some window matches.

        ``hits``: the places of shingles that the benchmark has.
        """
        n, best = len(shingles), {}
        hit = np.zeros(n + 1, np.int64)
        hit[hits + 1] = 1
        hit = np.cumsum(hit)
        for item_size in self.by_gram[gram][2]:
            size = min(item_size, n)
            # a similarity of t needs t / (1 + t) of both sizes in common
            need = self.threshold / (1 + self.threshold) * (item_size + size) - 1e-9
            if len(hits) < need:
                continue
            starts = np.flatnonzero(hit[size:] - hit[: n - size + 1] >= need)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else ():
                for lo in range(int(run[0]), int(run[-1]) + 1, CHUNK):
                    prints = fingerprints(shingles, size, lo, min(lo + CHUNK, int(run[-1]) + 1))
                    for w, i, d in zip(*(x.tolist() for x in self.candidates(prints, gram, item_size)), strict=True):
                        similarity = weighted_similarity(self.counts[i], Counter(shingles[lo + w : lo + w + size].tolist()))
                        if similarity >= self.threshold and (i not in best or similarity > best[i][0]):
                            best[i] = (similarity, lo + w, size + gram - 1, d)
        for i, found in best.items():
            yield (self.ids[i], *found)


def index_items(rows: list[tuple[int, str]], gram: int = 5, threshold: float = 0.75, radius: int = 23) -> Items:
    items = Items(radius, threshold)
    for item_id, text in rows:
        column = pa.array([text or ""])
        hashes, _ = word_hashes(*utf8(column), lower=True)
        n = min(gram, len(hashes))
        if n and item_id is not None:
            items.add(item_id, grams(hashes, n), n)
    return items.index()


def find_leaks(docs: DataFrame, benchmark: DataFrame, gram: int = 5, threshold: float = 0.75, radius: int = 23, block_bytes: int = 8 << 20, text: str = "text") -> DataFrame:
    """One row per document and item of which some window reaches ``threshold``: its best, earliest window.

    The benchmark is indexed in blocks of about ``block_bytes`` of text; its size decides their number.
    A block is sent to all tasks; where there are several, one after another scans the documents, and
    its rows are written before the next one is sent. Items without words, null texts and rows with a null id match
    nothing. Repeated documents are reported as often as they occur, a repeated item as often too.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    out = None
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        rows = sorted(tuple(r) for r in part.collect())
        sent = spark.sparkContext.broadcast(index_items(rows, gram, threshold, radius))
        found = _scan(docs.select("doc_id", F.col(text).alias("text")), sent)
        if n_blocks > 1:
            found = materialize(found, "leaks")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _scan(docs: DataFrame, shared) -> DataFrame:
    names = [x.split()[0] for x in LEAKS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches):
        items = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids, found = batch.column(0), []
            for a, b in row_ranges(offsets, 4 << 20):
                hashes, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
                for gram, (known, table, _) in items.by_gram.items():
                    shingles = grams(hashes, gram)
                    at = np.flatnonzero(table[shingles >> np.uint64(44)])
                    at = at[np.isin(shingles[at], known)]
                    row = np.searchsorted(first, at, side="right") - 1
                    inside = at + gram <= first[row + 1]
                    at, row = at[inside], row[inside]
                    for r in np.unique(row).tolist():
                        doc = ids[a + r].as_py()
                        if doc is not None:
                            lo, hi = int(first[r]), int(first[r + 1]) - gram + 1
                            found += [(doc, i, s, w, n, d) for i, s, w, n, d in items.leaks(shingles[lo:hi], gram, at[row == r] - lo)]
            columns = list(zip(*found, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.mapInArrow(run, LEAKS)


def op4_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The benchmark items that ``docs`` hold, exactly or nearly: a row per document and item, with its best window.

    Null and empty texts hold nothing, null and empty items are held by nothing, rows with a null id are
    passed over. Repeated documents and repeated items are reported as often as they occur; an empty
    table on either side gives no row. Columns other than doc_id, item_id and text are ignored.
    """
    return find_leaks(docs, benchmark).withColumn("similarity", F.round("similarity", 6))
