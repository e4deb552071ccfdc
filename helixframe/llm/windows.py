"""Which windows of a corpus also start in an earlier document.

A document is a sequence of elements (bytes or words); a window is ``size`` consecutive ones. Two
equal windows contain the same minimizer, the ``gram`` elements of least hash, at the same place, so
windows are grouped into runs that share a minimizer and only runs with equal minimizers need to
meet. The work is done in two rounds over buckets of minimizers:

1. *sharing*: every run sends its minimizer's hash; those that occur in two documents come back.
2. *matching*: runs with a shared minimizer send their elements; a bucket's matcher (a blockwise
   suffix array, or relative Lempel-Ziv parsing) says which windows occur in a smaller document.

Each map task first resolves what it can see itself: of runs with equal bytes it sends the earliest
document's only, so a passage that fills a third of the corpus travels once per flush and not once
per copy. Buckets are compressed arrays, not rows; their number follows from the bytes of text, so that
a bucket stays as large whatever the corpus. Nothing is collected, and no candidate is ever dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BYTE_VALUE, INVERSE, by_batch, by_group, cached_powers, mix, prefix_sums, row_ranges, text_buckets, utf8, word_hashes

POSITION_BITS = 23
SEGMENT = 1 << 20  # elements whose arrays are in memory together
CODE = 24  # a span travels as start << CODE | length


@dataclass(frozen=True)
class Rule:
    """What a window is: ``size`` elements, found through minimizers of ``gram`` elements."""

    size: int
    gram: int
    by_word: bool


@dataclass
class Elements:
    """Some whole rows as elements, with the byte range of each; for bytes the ranges are implied."""

    data: np.ndarray
    values: np.ndarray
    first: np.ndarray
    start: np.ndarray | None = None
    end: np.ndarray | None = None
    raw: bytes | None = None

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, by_word: bool) -> Elements:
        if not by_word:
            return cls(data, data, offsets)
        hashes, first, start, end = word_hashes(data, offsets, lower=False, bounds=True)
        return cls(data, hashes, first, start, end)

    def contents(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """The bytes of elements ``a`` to ``b`` of each pair, words with one space between them: equal elements, equal bytes."""
        if self.raw is None:
            self.raw = self.data.tobytes()
        raw = self.raw
        if self.start is None:
            return [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return [b" ".join(raw[x:y].split()) for x, y in zip(self.start[a].tolist(), self.end[b - 1].tolist(), strict=True)]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def runs(elements: Elements, rule: Rule, with_place: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """Per segment: minimizer hash, first window and number of windows of each run, and its row."""
    values, first = elements.values, elements.first
    n, size, gram = len(values), rule.size, rule.gram
    lo = 0
    while lo + size <= n:
        hi = min(n, lo + SEGMENT + size - 1)
        part = values[lo:hi]
        sums = prefix_sums(part if rule.by_word else BYTE_VALUE[part])
        places = len(part) - gram + 1
        grams = mix((sums[gram:] - sums[:-gram]) * cached_powers(INVERSE, places))
        low = np.uint64((1 << POSITION_BITS) - 1)
        best = _least((grams & ~low) | np.arange(places, dtype=np.uint64), size - gram + 1)
        # windows of this segment that stay inside their row
        open_at = np.zeros(len(best) + 1, np.int32)
        ends = first[1:]
        ends = ends[(ends > lo) & (ends < lo + len(best) + size - 1)] - lo
        np.add.at(open_at, np.maximum(ends - size + 1, 0).clip(max=len(best)), 1)
        np.add.at(open_at, ends.clip(max=len(best)), -1)
        inside = np.cumsum(open_at[:-1]) == 0
        at = np.flatnonzero(inside[: min(len(best), SEGMENT)])
        if len(at):
            place = (best[at] & low).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(at) != 1)]))
            begin = at[new]
            count = np.diff(np.append(new, len(at)))
            out = grams[place[new]], begin + lo, count, np.searchsorted(first, begin + lo, side="right") - 1
            yield (*out, place[new] + lo) if with_place else out
        lo += SEGMENT


def minimizers(elements: Elements, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the minimizer of each row that is one run; rows longer than a run have their first."""
    first = elements.first
    key, place = np.zeros(len(first) - 1, np.uint64), np.zeros(len(first) - 1, np.int64)
    for grams, begin, _, row, at in runs(elements, rule, with_place=True):
        here, new = np.unique(row, return_index=True)
        fresh = first[here] == begin[new]
        key[here[fresh]], place[here[fresh]] = grams[new[fresh]], at[new[fresh]] - first[here[fresh]]
    return key, place


# ---- arrays on their way to a bucket


def pack(**arrays: np.ndarray | bytes) -> bytes:
    """Named arrays, compressed."""
    head, body = [], []
    for name, x in arrays.items():
        raw = x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()
        head.append(f"{name},{'S' if isinstance(x, bytes) else x.dtype.str},{len(raw)}")
        body.append(raw)
    line = ";".join(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(line).to_bytes(4, "little") + line + b"".join(body))


def unpack(blob: bytes) -> dict[str, np.ndarray | bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for part in raw[4:at].decode().split(";"):
        name, kind, n = part.split(",")
        out[name] = raw[at : at + int(n)] if kind == "S" else np.frombuffer(raw, np.dtype(kind), int(n) // np.dtype(kind).itemsize, at)
        at += int(n)
    return out


def split_by(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of each bucket that has any, in their order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


def pack_docs(doc: np.ndarray, salt: np.ndarray, prefix: str = "") -> dict[str, np.ndarray]:
    """The different (doc, salt) rows in ascending order, ids as differences, and the place of each entry."""
    order = np.lexsort((salt, doc))
    d, s = doc[order], salt[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])]) if len(d) else np.empty(0, bool)
    place = np.empty(len(d), np.int64)
    place[order] = np.cumsum(new) - 1
    return {f"{prefix}docs": np.diff(d[new], prepend=0), f"{prefix}salts": s[new].astype(np.int32), f"{prefix}place": place.astype(np.uint16 if new.sum() < 1 << 16 else np.uint32)}


def unpack_docs(x: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """doc and salt of each entry."""
    place = x[f"{prefix}place"]
    return np.cumsum(x[f"{prefix}docs"])[place], x[f"{prefix}salts"][place]


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])


def _results(doc: list[np.ndarray], salt: list[np.ndarray], code: list[np.ndarray]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(x).astype(t)) for n, x, t in (("doc_id", doc, np.int64), ("salt", salt, np.int32), ("code", code, np.int64))})


class _Held:
    """Columns gathered over batches."""

    def __init__(self, names: str):
        self.names = names.split()
        self.clear()

    def clear(self) -> None:
        self.parts: dict[str, list] = {n: [] for n in self.names}
        self.n = 0

    def add(self, **columns) -> None:
        for name, x in columns.items():
            self.parts[name].append(x)
        self.n += len(next(iter(columns.values())))

    def take(self) -> dict[str, np.ndarray]:
        out = {n: np.concatenate(x) if x else np.empty(0, np.int64) for n, x in self.parts.items()}
        self.clear()
        return out


def _rows(batch: pa.RecordBatch, rule: Rule, limit: int = 1 << 21):
    """(elements, doc_id, salt, first row) for groups of whole rows of (doc_id, salt, text, ...)."""
    doc = np.asarray(batch.column(0).fill_null(0), np.int64)
    salt = np.asarray(batch.column(1), np.int32)
    data, offsets = utf8(batch.column(2))
    for a, b in row_ranges(offsets, limit):
        yield Elements.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], rule.by_word), doc[a:b], salt[a:b], a


def group_edges(x: np.ndarray) -> np.ndarray:
    """Start of each group of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


# ---- round 1


class Sharing:
    """Finds which entries have a key that occurs with two different docs; salt tells rows of one doc apart.

    ``emit`` turns the entries of a map task into compressed arrays per bucket. Keys met with two docs
    there are settled at once: only their hash goes on, so a key that a third of all documents has
    costs one entry per flush.
    """

    names = "key at doc salt"

    def __init__(self, buckets: int):
        self.buckets = buckets

    def _short(self, key: np.ndarray) -> np.ndarray:
        """32 bits of a key besides its bucket: a bucket has about a million keys, and a chance collision only adds an entry."""
        return (key // np.uint64(self.buckets)).astype(np.uint32)

    def emit(self, x: dict[str, np.ndarray]) -> pa.RecordBatch:
        n, none = self.buckets, np.empty(0, np.int64)
        order = np.argsort(x["key"], kind="stable")
        key, doc = x["key"][order], x["doc"][order]
        edge = group_edges(key)
        shared = np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge)
        each = np.repeat(shared, np.diff(np.append(edge, len(key))))
        flag = key[edge[shared]]
        sent = {b: {"flag": self._short(flag[i])} for b, i in split_by((flag % np.uint64(n)).astype(np.int64), n)}
        done = order[each]
        for b, i in split_by((mix(x["doc"][done]) % np.uint64(n)).astype(np.int64), n):
            sent.setdefault(b, {})["done"] = done[i]
        single = np.sort(order[~each])  # back in text order, which compresses
        for b, i in split_by((x["key"][single] % np.uint64(n)).astype(np.int64), n):
            sent.setdefault(b, {})["open"] = single[i]
        out = []
        for b, s in sent.items():
            i, j = s.get("open", none), s.get("done", none)
            out.append((b, pack(key=self._short(x["key"][i]), at=x["at"][i].astype(np.uint32), flag=s.get("flag", none.astype(np.uint32)), done_at=x["at"][j].astype(np.uint32), **pack_docs(x["doc"][i], x["salt"][i]), **pack_docs(x["doc"][j], x["salt"][j], "done_"))))
        return _blobs(out)

    @staticmethod
    def shared(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """One bucket: doc, salt and at of the entries whose key occurs with two docs."""
        key, at, doc, salt, flag, out_doc, out_salt, out_at = [], [], [], [], [], [], [], []
        for blob in table.column("blob"):
            x = unpack(blob.as_py())
            key.append(x["key"])
            at.append(x["at"])
            flag.append(x["flag"])
            out_at.append(x["done_at"])
            for docs, salts, prefix in ((doc, salt, ""), (out_doc, out_salt, "done_")):
                d, s = unpack_docs(x, prefix)
                docs.append(d)
                salts.append(s)
        key, at, doc, salt, flag = map(np.concatenate, (key, at, doc, salt, flag))
        if len(key):
            order = np.argsort(key, kind="stable")
            key, by_key = key[order], doc[order]
            edge = group_edges(key)
            shared = (np.minimum.reduceat(by_key, edge) != np.maximum.reduceat(by_key, edge)) | np.isin(key[edge], flag)
            hit = order[np.repeat(shared, np.diff(np.append(edge, len(key))))]
            for out, values in ((out_doc, doc), (out_salt, salt), (out_at, at)):
                out.append(values[hit])
        return out_doc, out_salt, out_at


def _send_minimizers(rule: Rule, buckets: int, flush: int):
    def run(batches):
        sharing = Sharing(buckets)
        held = _Held(sharing.names)
        for batch in batches:
            for elements, doc, salt, _ in _rows(batch, rule):
                for key, begin, _, row in runs(elements, rule):
                    held.add(key=key, at=begin - elements.first[row], doc=doc[row], salt=salt[row])
                if held.n >= flush:
                    yield sharing.emit(held.take())
        if held.n:
            yield sharing.emit(held.take())

    return run


def _find_shared(table: pa.Table) -> pa.Table:
    return _results(*Sharing.shared(table))


# ---- round 2


def _send_contents(rule: Rule, buckets: int, flush: int):
    def run(batches):
        held, known = _Held("key begin count content doc salt"), {}

        def emit():
            x, distinct = held.take(), list(known)
            # of runs with equal bytes the smallest document's stay; in any other document they are repeats
            least = np.full(len(distinct), np.iinfo(np.int64).max)
            np.minimum.at(least, x["content"], x["doc"])
            least = least[x["content"]]
            again = np.flatnonzero(x["doc"] > least)
            stay = np.flatnonzero(x["doc"] == least)
            none = np.empty(0, np.int64)
            sent: dict[int, dict] = {}
            for b, i in split_by((mix(x["doc"][again]) % np.uint64(buckets)).astype(np.int64), buckets):
                sent.setdefault(b, {})["done"] = again[i]
            for b, i in split_by((x["key"][stay] % np.uint64(buckets)).astype(np.int64), buckets):
                sent.setdefault(b, {})["open"] = stay[i]
            out = []
            for b, s in sent.items():
                i, j = s.get("open", none), s.get("done", none)
                texts = [distinct[k] for k in x["content"][i].tolist()]
                length = np.fromiter(map(len, texts), np.uint32, len(texts))
                code = x["begin"][j] << CODE | (x["count"][j] + rule.size - 1)
                out.append((b, pack(text=b"".join(texts), length=length, begin=x["begin"][i], done_code=code, **pack_docs(x["doc"][i], x["salt"][i]), **pack_docs(x["doc"][j], x["salt"][j], "done_"))))
            known.clear()
            return _blobs(out)

        size = 0
        for batch in batches:
            for elements, doc, salt, base in _rows(batch, rule):
                # one sorted array of row << 40 | place for all runs wanted of these rows
                ps = batch.column(3).slice(base, len(doc))
                if ps.null_count == len(ps):
                    continue
                counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ps), 0), np.int64)
                wanted = np.sort(np.repeat(np.arange(len(doc), dtype=np.int64), counts) << 40 | np.asarray(ps.flatten(), np.int64))
                for key, begin, count, row in runs(elements, rule):
                    at = begin - elements.first[row]
                    code = row.astype(np.int64) << 40 | at
                    place = np.searchsorted(wanted, code)
                    keep = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == code)
                    if not len(keep):
                        continue
                    before, texts = len(known), elements.contents(begin[keep], begin[keep] + count[keep] + rule.size - 1)
                    content = np.fromiter((known.setdefault(c, len(known)) for c in texts), np.int64, len(texts))
                    held.add(key=key[keep], begin=at[keep], count=count[keep], content=content, doc=doc[row[keep]], salt=salt[row[keep]])
                    size += (len(known) - before) * 3 * rule.size + 24 * len(keep)
                if size >= flush:
                    yield emit()
                    size = 0
        if held.n:
            yield emit()

    return run


Matcher = Callable[[np.ndarray, np.ndarray, np.ndarray, Rule], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _match(rule: Rule, matcher: Matcher):
    """One bucket: spans of windows that occur in a smaller document."""

    def run(table: pa.Table) -> pa.Table:
        text, length, begin, doc, salt, out_doc, out_salt, out_code = [], [], [], [], [], [], [], []
        for blob in table.column("blob"):
            x = unpack(blob.as_py())
            text.append(x["text"])
            length.append(x["length"].astype(np.int64))
            begin.append(x["begin"])
            out_code.append(x["done_code"])
            for docs, salts, prefix in ((doc, salt, ""), (out_doc, out_salt, "done_")):
                d, s = unpack_docs(x, prefix)
                docs.append(d)
                salts.append(s)
        length, begin, doc, salt = map(np.concatenate, (length, begin, doc, salt))
        if len(length):
            raw = b"".join(text)
            offset = np.zeros(len(length) + 1, np.int64)
            np.cumsum(length, out=offset[1:])
            # each different content once, with its smallest document
            known: dict[bytes, int] = {}
            of = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True)), np.int64, len(length))
            distinct = list(known)
            least = np.full(len(distinct), np.iinfo(np.int64).max)
            np.minimum.at(least, of, doc)
            data = np.frombuffer(b"".join(distinct), np.uint8)
            bounds = np.zeros(len(distinct) + 1, np.int64)
            np.cumsum([len(c) for c in distinct], out=bounds[1:])
            elements = Elements.of(data, bounds, rule.by_word)
            count = np.diff(elements.first)
            again = doc > least[of]
            out_doc.append(doc[again])
            out_salt.append(salt[again])
            out_code.append(begin[again] << CODE | count[of[again]])
            # windows of a content that a smaller document has in another context
            own = np.flatnonzero(~again)
            own = own[np.argsort(of[own], kind="stable")]
            holder = of[own]
            for which, at, windows in matcher(elements, least, rule):
                lo, hi = np.searchsorted(holder, which), np.searchsorted(holder, which, side="right")
                each = hi - lo
                i = own[np.repeat(lo, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
                out_doc.append(doc[i])
                out_salt.append(salt[i])
                out_code.append(begin[i] + np.repeat(at, each) << CODE | np.repeat(windows, each) + rule.size - 1)
        return _results(out_doc, out_salt, out_code)

    return run


def spans_of(which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (content, window) pairs as maximal runs: content, first window, number."""
    if not len(which):
        return which, at, at
    new = np.flatnonzero(np.concatenate([[True], (np.diff(which) != 0) | (np.diff(at) != 1)]))
    return which[new], at[new], np.diff(np.append(new, len(which)))


def repeated_windows(docs: DataFrame, rule: Rule, matcher: Matcher, text: str = "text", flush: int = 3_000_000, carry: bool = False) -> DataFrame:
    """(doc_id, text, spans): spans of elements, as start << CODE | length, that repeat a smaller document's windows.

    A null doc_id compares with nothing and repeats nothing. Rows of one doc_id are each other's
    equals: none is smaller. spans is null where nothing repeats; spans may overlap. ``carry`` adds the
    other columns of ``docs`` as one struct, ``others``.
    """
    if rule.gram >= rule.size:
        raise ValueError("a minimizer must be shorter than a window")
    buckets = text_buckets(docs, text)
    salt = F.shiftright(F.xxhash64(text), 32).cast("int")
    rows = docs.select("doc_id", salt.alias("salt"), F.col(text).alias("text"))
    blob, result, row = "bucket int, blob binary", "doc_id long, salt int, code long", ["doc_id", "salt"]
    known = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sent = known.mapInArrow(by_batch(_send_minimizers(rule, buckets, flush)), blob)
    shared = sent.groupBy("bucket").applyInArrow(by_group(_find_shared), result)
    shared = shared.groupBy(*row).agg(F.collect_list("code").alias("places"))
    # both joins deal out the same rows by the same key: the text is shuffled once
    joined = rows.join(shared, row, "left").select(*row, F.when(F.col("places").isNotNull(), F.col("text")).alias("text"), "places")
    sent = joined.mapInArrow(by_batch(_send_contents(rule, buckets, 16 * flush)), blob)
    spans = sent.groupBy("bucket").applyInArrow(by_group(_match(rule, matcher)), result)
    spans = spans.groupBy(*row).agg(F.collect_list("code").alias("spans"))
    if not carry:
        return rows.join(spans, row, "left").select("doc_id", "text", "spans")
    others = F.struct(*(F.col(c) for c in docs.columns if c not in ("doc_id", text)))
    full = docs.select("doc_id", salt.alias("salt"), F.col(text).alias("text"), others.alias("others"))
    return full.join(spans, row, "left").select("doc_id", "text", "spans", "others")


def covered(codes: list[int] | np.ndarray | None, n: int) -> np.ndarray:
    """Start and end of each maximal run of elements that the spans cover."""
    if codes is None or not len(codes):
        return np.empty((0, 2), np.int64)
    codes = np.sort(np.asarray(codes, np.int64))
    start, end = codes >> CODE, (codes >> CODE) + (codes & ((1 << CODE) - 1))
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return np.stack([start[new], np.minimum(reach[last], n)], axis=1)
