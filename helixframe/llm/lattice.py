"""Subword lattice likelihood.

The pieces of an existing subword vocabulary get unigram probabilities from the vocabulary's own scores
and the training words. The scores are merge ranks, so a piece of rank r weighs 1 / (1 + r) (Zipf's law;
byte pieces rank last); these weights, scaled to one pseudo-count a piece on average, are added to the
counts of the training words' pieces, each word cut by the vocabulary's own tokenizer. Without training
words the scores alone weigh the segmentations. The probability of a word is the sum over *all* its segmentations into pieces, computed
by the forward recursion in log space for many words at once; byte pieces cover what no other piece
does. Each training word is also an arc of the lattice by itself, weighted by its count, and what that
leaves to the segmentations is the share that new words have (Witten and Bell's estimate). A text is a
sequence of words and one end, so its log probability is a sum over its words, and every different
word of the corpus is scored once.

Words meet their counts in buckets. The most frequent ones (at most ``hot``) are sent to every task
instead, so that no bucket grows with the number of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, by_group, LOWER, crc_bucket, materialize, partitions, row_ranges, utf8, word_hashes
from .windows import _blobs, _Held, pack, split_by, unpack

LOG10 = np.log(10.0)
SUMS = ("words", "known", "logs", "score")


class Vocabulary:
    """A sentencepiece model's pieces as byte strings, and its tokenizer."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.size = m.get_piece_size()
        self.end = m.eos_id()
        self.piece_bytes: list[bytes | None] = []
        for i in range(self.size):
            if m.is_byte(i):
                self.piece_bytes.append(bytes([int(m.id_to_piece(i)[3:5], 16)]))
            else:
                self.piece_bytes.append(None if m.is_control(i) or m.is_unknown(i) else m.id_to_piece(i).encode())
        self.space = "▁".encode()
        # one entry per byte string: a character piece of one byte and the byte piece of the same value add up
        self.strings = sorted({p for p in self.piece_bytes if p})
        self.longest = max(map(len, self.strings))
        self.factor = np.uint64(0x100000001B3)
        keys = np.array([self._hash(s) for s in self.strings], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.slot_of = {s: i for i, s in enumerate(self.strings)}
        self.slots = np.array([self.slot_of.get(p, -1) if p else -1 for p in self.piece_bytes])
        rank = np.full(len(self.strings), self.size, np.float64)
        for i, slot in enumerate(self.slots.tolist()):
            if slot >= 0 and not m.is_byte(i):
                rank[slot] = min(rank[slot], max(0.0, -m.get_score(i)))
        self.prior = 1 / (1 + rank)
        self.prior /= self.prior.sum()
        self.maybe, self.begins = np.zeros(1 << 22, bool), np.zeros(1 << 22, bool)
        self.maybe[self.keys >> np.uint64(42)] = True
        heads = {s[:n] for s in self.strings for n in range(1, len(s))}
        self.begins[np.array([self._hash(s) for s in heads], np.uint64) >> np.uint64(42)] = True

    @staticmethod
    def _hash(s: bytes) -> int:
        h = 0xCBF29CE484222325
        for b in s:
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
        return (h * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF

    def find(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which running hashes are those of pieces, the pieces' slots, and which may begin a longer piece."""
        h = state ^ (state >> np.uint64(29))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        top = h >> np.uint64(42)
        some = np.flatnonzero(self.maybe[top])
        at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
        right = self.keys[at] == h[some]
        return some[right], self.order[at[right]], self.begins[top]

    def count(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often each byte string is used when the tokenizer cuts each word, weighted."""
        out = np.zeros(len(self.strings))
        for lo in range(0, len(words), 20000):
            cut = self.model.encode(words[lo : lo + 20000], num_threads=1)
            ids = np.fromiter((i for x in cut for i in x), np.int64)
            weight = np.repeat(times[lo : lo + 20000], [len(x) for x in cut])
            slot = self.slots[ids]
            np.add.at(out, slot[slot >= 0], weight[slot >= 0])
        return out


_VOCABULARY: dict[str, Vocabulary] = {}


def vocabulary_at(path: str) -> Vocabulary:
    if path not in _VOCABULARY:
        _VOCABULARY[path] = Vocabulary(path)
    return _VOCABULARY[path]


def marginals(vocabulary: Vocabulary, log_p: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural log of the probability of each word, over all its segmentations.

    The forward value of a place is the log of the summed probability of all ways to reach it; pieces
    that end there are added in log space, one place of all words after another.
    """
    out = np.zeros(len(words))
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    size = np.array([len(words[i]) + 3 for i in order])
    lo = 0
    while lo < len(order):
        width = int(size[lo])
        hi = min(len(order), lo + max(1, (1 << 20) // width))
        some = order[lo:hi]
        n, length = len(some), size[lo:hi]
        text = np.zeros((width, n), np.uint8)
        for j, i in enumerate(some):
            text[: length[j], j] = np.frombuffer(vocabulary.space + words[i], np.uint8)
        reach = np.full((width + 1, n), -np.inf)
        reach[0] = 0
        for start in range(width):
            live = int(np.searchsorted(-length, -start, side="left"))  # words longer than start
            open_ones = np.flatnonzero(reach[start, :live] > -np.inf)
            state = np.full(len(open_ones), 0xCBF29CE484222325, np.uint64)
            for step in range(min(vocabulary.longest, width - start)):
                fits = length[open_ones] > start + step
                open_ones, state = open_ones[fits], state[fits]
                if not len(open_ones):
                    break
                state = (state ^ text[start + step, open_ones]) * vocabulary.factor
                hit, slot, begins = vocabulary.find(state)
                if len(hit):
                    word = open_ones[hit]
                    reach[start + step + 1, word] = np.logaddexp(reach[start + step + 1, word], reach[start, word] + log_p[slot])
                open_ones, state = open_ones[begins], state[begins]
        out[some] = reach[length, np.arange(n)]
        lo = hi
    return out


def _documents(batches):
    """(first row, doc rows, word hashes, row of each word, byte ranges, lowered bytes, training flag) per range."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        train = np.asarray(batch.column(2).fill_null(False))
        for a, b in row_ranges(offsets, 4 << 20):
            part = LOWER[data[offsets[a] : offsets[b]]]
            hashes, first, start, end = word_hashes(part, offsets[a : b + 1] - offsets[a], lower=False, bounds=True)
            yield batch, a, b, hashes, np.repeat(np.arange(b - a), np.diff(first)), start, end, part, train[a:b]


def word_table(docs: DataFrame, vocabulary: str, buckets: int, flush: int = 8 << 20) -> DataFrame:
    """(bucket, blob): the different words of all documents, each once, with its count in training documents.

    Words are told apart by 64-bit hashes; a blob holds hashes, counts and the words themselves.
    """

    def send(batches):
        known: dict[int, bytes] = {}
        held = _Held("key train")
        size = 0

        def emit():
            nonlocal size
            x = held.take()
            key, place = np.unique(x["key"], return_inverse=True)
            count = np.bincount(place, weights=x["train"], minlength=len(key)).astype(np.int64)
            rows = []
            for b, i in split_by((key % np.uint64(buckets)).astype(np.int64), buckets):
                words = [known[k] for k in key[i].tolist()]
                rows.append((b, pack(key=key[i], count=count[i], length=np.array([len(w) for w in words], np.uint32), text=b"".join(words))))
            known.clear()
            size = 0
            return _blobs(rows)

        for _, _, _, hashes, row, start, end, part, train in _documents(batches):
            key, at, place = np.unique(hashes, return_index=True, return_inverse=True)
            raw = part.tobytes()
            for k, a, b in zip(key.tolist(), start[at].tolist(), end[at].tolist(), strict=True):
                if k not in known:
                    known[k] = raw[a:b]
                    size += b - a + 24
            held.add(key=key, train=np.bincount(place, weights=train[row], minlength=len(key)))
            if size >= flush:
                yield emit()
        if held.n:
            yield emit()

    def merge(table: pa.Table) -> pa.Table:
        key, count, words = [], [], []
        for blob in table.column("blob"):
            x = unpack(blob.as_py())
            key.append(x["key"])
            count.append(x["count"])
            at = np.concatenate([[0], np.cumsum(x["length"].astype(np.int64))]).tolist()
            words += [x["text"][a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        key, count = np.concatenate(key), np.concatenate(count)
        each, first, place = np.unique(key, return_index=True, return_inverse=True)
        total = np.zeros(len(each), np.int64)
        np.add.at(total, place, count)
        some = [words[i] for i in first.tolist()]
        blob = pack(key=each, count=total, length=np.array([len(w) for w in some], np.uint32), text=b"".join(some))
        pieces = vocabulary_at(vocabulary).count([w.decode(errors="replace") for w, n in zip(some, total.tolist(), strict=True) if n], total[total > 0].astype(float))
        used = np.flatnonzero(pieces)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "blob": pa.array([blob], pa.binary()), "tokens": pa.array([int(total.sum())]), "types": pa.array([int((total > 0).sum())]), "pieces": pa.array([pack(slot=used.astype(np.uint32), n=pieces[used])], pa.binary())})

    sent = docs.select("doc_id", "text", "train").mapInArrow(by_batch(send), "bucket int, blob binary")
    return sent.groupBy("bucket").applyInArrow(by_group(merge), "bucket int, blob binary, tokens long, types long, pieces binary")


def piece_probabilities(words: DataFrame, vocabulary: str, end_count: int) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the end: counts besides the pseudo-counts of the vocabulary's scores, one for the end."""
    size = len(vocabulary_at(vocabulary).strings)

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for blob in batch.column(0):
                x = unpack(blob.as_py())
                total[x["slot"]] += x["n"]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])

    # a vector of the vocabulary's size per task, then per group of tasks, then one
    parts = words.select("pieces").mapInArrow(by_batch(add), "n binary").select(F.spark_partition_id().alias("part"), "n")

    def sum_up(table: pa.Table) -> pa.Table:
        return pa.table({"n": pa.array([sum(np.frombuffer(x.as_py()) for x in table.column("n")).tobytes()], pa.binary())})

    total = size * vocabulary_at(vocabulary).prior
    for (n,) in parts.withColumn("part", F.col("part") % 16).groupBy("part").applyInArrow(by_group(sum_up), "n binary").collect():
        total += np.frombuffer(bytes(n))
    end = end_count + 1.0
    return np.log(total / (total.sum() + end)), float(np.log(end / (total.sum() + end)))


def score_words(words: DataFrame, vocabulary: str, log_p: np.ndarray, n: int, v: int) -> DataFrame:
    """(bucket, blob): hash, training count and log probability of every different word.

    A training word is an arc of its own besides its segmentations. The arcs of the ``v`` training
    words share ``n / (n + v)`` of the probability by their counts, the segmentations the rest.
    """
    shared = words.sparkSession.sparkContext.broadcast(log_p)  # the vocabulary's size

    def arcs(count, marginal):
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(count.astype(np.float64)), marginal + np.log(max(v, 1))) - np.log(n + max(v, 1))

    def run(batches):
        for batch in batches:
            out = []
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = unpack(blob.as_py())
                at = np.concatenate([[0], np.cumsum(x["length"].astype(np.int64))]).tolist()
                some = [x["text"][a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                out.append((bucket, pack(key=x["key"], count=x["count"], score=arcs(x["count"], marginals(vocabulary_at(vocabulary), shared.value, some)))))
            yield _blobs(out)

    return words.select("bucket", "blob").mapInArrow(by_batch(run), "bucket int, blob binary")


def hot_words(scored: DataFrame, hot: int) -> np.ndarray:
    """At most ``hot`` (hash, count, log probability): the words of most training occurrences, ties by hash."""

    def best(batches):
        for batch in batches:
            for blob in batch.column(0):
                x = unpack(blob.as_py())
                top = np.lexsort((x["key"], -x["count"]))[:hot]
                top = top[x["count"][top] > 1]
                yield pa.RecordBatch.from_arrays([pa.array(x["key"][top].astype(np.int64)), pa.array(x["count"][top]), pa.array(x["score"][top])], names=["key", "n", "score"])

    rows = scored.select("blob").mapInArrow(by_batch(best), "key long, n long, score double").orderBy(F.desc("n"), "key").limit(hot).toArrow()
    out = np.zeros(rows.num_rows, [("key", "u8"), ("count", "i8"), ("score", "f8")])
    for name, column in (("key", "key"), ("count", "n"), ("score", "score")):
        out[name] = np.asarray(rows.column(column)).astype(out.dtype[name])
    return np.sort(out, order="key")


def score_documents(docs: DataFrame, scored: DataFrame, hot: np.ndarray, buckets: int, flush: int = 1_000_000) -> DataFrame:
    """(rid, words, known, logs, score): of a row's words the number, those in training, the sum of log10(count + 1), the log probability."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # bounded by its length

    def send(batches):
        table = shared.value
        held = _Held("key rid n")

        def emit():
            x = held.take()
            rows = []
            for b, i in split_by((x["key"] % np.uint64(buckets)).astype(np.int64), buckets):
                rids, place = np.unique(x["rid"][i], return_inverse=True)
                key = x["key"][i] // np.uint64(buckets)
                rows.append((b, b"Q" + pack(low=key.astype(np.uint32), high=(key >> np.uint64(32)).astype(np.uint32), rids=rids, place=place.astype(np.uint16 if len(rids) < 1 << 16 else np.uint32), n=x["n"][i].astype(np.uint32))))
            return _blobs(rows)

        for batch, a, b, hashes, row, *_ in _documents(batches):
            rid = np.asarray(batch.column(0).slice(a, b - a))
            at = np.minimum(np.searchsorted(table["key"], hashes), max(len(table) - 1, 0))
            is_hot = table["key"][at] == hashes if len(table) else np.zeros(len(hashes), bool)
            count, where = table["count"][at[is_hot]], row[is_hot]
            sums = [np.bincount(where, weights=w, minlength=b - a) for w in (count > 0, np.log10(count + 1.0), table["score"][at[is_hot]])] if len(table) else [np.zeros(b - a)] * 3
            sums.insert(0, np.bincount(row, minlength=b - a).astype(np.float64))
            yield _blobs([(int(rid[0]) % buckets, b"R" + pack(rid=rid, **dict(zip(SUMS, sums, strict=True))))])
            key, where = hashes[~is_hot], row[~is_hot]
            order = np.lexsort((key, where))
            key, where = key[order], where[order]
            if len(key):
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (where[1:] != where[:-1])]))
                held.add(key=key[new], rid=rid[where[new]], n=np.diff(np.append(new, len(key))))
            if held.n >= flush:
                yield emit()
        if held.n:
            yield emit()

    def answer(table: pa.Table) -> pa.Table:
        rid, sums = [], {c: [] for c in SUMS}
        words, asked = None, []
        for blob in table.column("blob"):
            kind, body = blob.as_py()[:1], blob.as_py()[1:]
            x = unpack(body)
            if kind == b"W":
                words = x
            elif kind == b"R":
                rid.append(x["rid"])
                for c in SUMS:
                    sums[c].append(x[c])
            else:
                asked.append(x)
        bucket = int(table.column("bucket")[0].as_py())
        for x in asked:
            key = (x["low"].astype(np.uint64) | x["high"].astype(np.uint64) << np.uint64(32)) * np.uint64(buckets) + np.uint64(bucket)
            at = np.searchsorted(words["key"], key)
            count, n = words["count"][at], x["n"].astype(np.float64)
            rid.append(x["rids"])
            for c, w in zip(SUMS, (0 * n, n * (count > 0), n * np.log10(count + 1.0), n * words["score"][at]), strict=True):
                sums[c].append(np.bincount(x["place"], weights=w, minlength=len(x["rids"])))
        if not rid:
            return pa.table({"rid": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in SUMS}})
        each, place = np.unique(np.concatenate(rid), return_inverse=True)
        return pa.table({"rid": pa.array(each), **{c: pa.array(np.bincount(place, weights=np.concatenate(v), minlength=len(each))) for c, v in sums.items()}})

    words = scored.select("bucket", F.concat(F.lit("W").cast("binary"), "blob").alias("blob"))
    sent = docs.select("rid", "text", F.lit(False).alias("train")).mapInArrow(by_batch(send), "bucket int, blob binary")
    found = sent.unionByName(words).groupBy("bucket").applyInArrow(by_group(answer), "rid long, words double, known double, logs double, score double")
    return found.groupBy("rid").agg(*(F.sum(c).alias(c) for c in SUMS))


def lattice_scores(docs: DataFrame, vocabulary: str, train: str, hot: int = 1 << 16, text: str = "text") -> DataFrame:
    """Score every row, learning from those where the boolean column ``train`` is true.

    Null text is empty: it has its end only. Rows with a null doc_id are scored and not learned from.
    """
    spark = docs.sparkSession
    buckets = 2 * partitions(spark)
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    words = materialize(word_table(rows, vocabulary, buckets), "words")
    ends = rows.where("train").count()
    totals = words.agg(F.sum("tokens"), F.sum("types")).first()
    n, v = (totals[0] or 0) + ends, (totals[1] or 0) + (ends > 0)
    log_p, log_end = piece_probabilities(words, vocabulary, ends)
    scored = materialize(score_words(words, vocabulary, log_p, n, v), "scored")
    log_end = float(np.logaddexp(np.log(ends) if ends else -np.inf, log_end + np.log(max(v, 1))) - np.log(n + max(v, 1)))
    found = score_documents(rows.where("text <> ''"), scored, hot_words(scored, hot), buckets)
    # rows that are equal in doc_id and text answer under one rid: their sums count once each
    described = rows.select("doc_id", "rid", "train")
    copies = described.groupBy("rid").agg(F.count("*").alias("copies"))
    out = described.join(copies.join(found, "rid", "left"), "rid")
    words, known, logs, score = (F.coalesce(F.col(c), F.lit(0.0)) / F.col("copies") for c in SUMS)
    tokens = F.round(words).cast("long") + 1
    base = logs + float(np.log10(ends + 1.0)) - tokens * float(np.log10(n + v + 1.0))
    score = (score + log_end) / float(LOG10)
    return out.select("doc_id", "train", tokens.alias("n_tokens"), (F.round(known).cast("long") + int(ends > 0)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op8_lattice_score(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs``: its tokens, base score and the log10 probability of its text.

    Null and empty texts are their end alone. A null doc_id is scored, neither held out nor learned
    from; repeated rows count, and answer, as often as they occur. No documents give no row, and without
    training documents the vocabulary's scores weigh alone. Columns other than doc_id and text are ignored.
    """
    held_out = F.coalesce(crc_bucket(7) == 2, F.lit(False))
    learn = docs.select("doc_id", "text", (F.col("doc_id").isNotNull() & ~held_out).alias("train"))
    return lattice_scores(learn, vocabulary, "train").select("doc_id", (F.col("doc_id").isNotNull() & ~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
