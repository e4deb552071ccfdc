"""Near-duplicate classes by an exact Jaccard join of word shingles.

A document is the set of its ``gram``-word shingles; two link when their sets' Jaccard similarity
reaches ``percent``. Documents with equal sets are one set from the start. The join runs in steps
that lose no link:

*Survivors.* Under one order of all shingles (their hash) two linked sets share the smallest of
their common shingles in both sets' prefixes, however far these are extended. Each set sends a
prefix extended by an eighth of its size; a set too few of whose prefix shingles occur in another
set's prefix has no partner at all.

*Index.* Survivors order their shingles by how often survivors hold them, rare ones first (estimated
by a table of counters of fixed size: any order is valid as long as all sets use the same), and
extend their prefixes by ``classes`` shingles, so that two linked sets share ``classes + 1`` prefix
shingles at least. A rare shingle of the plain prefix is a key by itself: the rarest shared one lies in
both plain prefixes. If that one is frequent all shared ones are, and frequent shingles of the extended
prefix are keys as combinations of two that fall into the same of ``classes`` classes: ``classes + 1``
shared shingles cannot all lie in different ones. Of a key's sets those whose size fits no other set's
are left out. Sets travel as compressed words and are cut to shingles where they are compared.

*Errors.* Shingles and sets are named by 64-bit hashes. Of N different shingles two share a name with
probability N * N / 2**65 (3e-4 for 1e8 of them), and a link changes only where that happens inside one
compared pair, at most 2 * n * n / 2**64 for two sets of n: 1e-13 a pair at n = 1000. Of S different
sets two share signature and size with probability below S * S / 2**65: 3e-6 for 1e7 sets.

*Verification.* A key is open while its sets are not all in one component. In each round every set
names its most frequent open key; all sets of a named key are gathered in a block and compared
exactly, pairs of one component excepted, after which the key is done. After ``rounds`` of these the pairs
that share an open key and never met are verified pair by pair. Blocks larger than ``block`` are
compared chunk against chunk in separate tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, by_batch, by_group, discard, grams, materialize, mix, partitions, prefix_sums, range_hash, row_ranges, text_buckets, utf8, word_hashes
from .windows import Sharing, _blobs, _Held, group_edges, pack, pack_docs, split_by, unpack, unpack_docs

COUNTERS = 1 << 22
RANGES = 16
SALTS = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, gram: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different shingles of each row, one row after another, and where each row starts.

    A row of fewer words than ``gram`` has its whole sequence as one shingle, one without words none.
    """
    hashes, first = word_hashes(data, offsets, lower=True)
    count = np.diff(first)
    full = np.maximum(count - gram + 1, 0)
    at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full - first[:-1], full)
    shingle, row = grams(hashes, gram)[at], np.repeat(np.arange(len(count)), full)
    short = np.flatnonzero((count > 0) & (count < gram))
    if len(short):
        whole = mix(range_hash(prefix_sums(hashes), first[short], first[short + 1]) + count[short].astype(np.uint64))
        shingle, row = np.concatenate([shingle, whole]), np.concatenate([row, short])
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    if len(shingle):
        new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])])
        shingle, row = shingle[new], row[new]
    edges = np.zeros(len(count) + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=len(count)), out=edges[1:])
    return shingle, edges


def signatures(shingle: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; together with the set's size it names the set."""
    sums = np.zeros(len(shingle) + 1, np.uint64)
    np.cumsum(mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return mix(sums[edges[1:]] - sums[edges[:-1]] + np.diff(edges).astype(np.uint64)).astype(np.int64)


def least_overlap(n, percent: int):
    """The fewest shingles a set of ``n`` shares with any partner."""
    return -(-percent * n // 100)


def _sets(batches, gram: int, column: int):
    """(batch, first row, shingles, edges) of whole rows."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        for a, b in row_ranges(offsets, 1 << 21):
            yield batch, a, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], gram)


def describe(docs: DataFrame, gram: int, text: str) -> DataFrame:
    """(doc_id, n, sig) of every row."""

    def run(batches):
        for batch, a, shingle, edges in _sets(batches, gram, 1):
            n = len(edges) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(np.diff(edges)), pa.array(signatures(shingle, edges))], names=["doc_id", "n", "sig"])

    return docs.select("doc_id", text).mapInArrow(by_batch(run), "doc_id long, n long, sig long")


def shared_counts(docs: DataFrame, gram: int, percent: int, text: str, flush: int = 3_000_000) -> DataFrame:
    """(sig, shared): how many shingles of each set's extended prefix occur in another set's; sets without any are missing."""
    buckets = text_buckets(docs, text)

    def send(batches):
        sharing = Sharing(buckets)
        held, seen = _Held(sharing.names), set()
        for _, _, shingle, edges in _sets(batches, gram, 0):
            sig, n = signatures(shingle, edges), np.diff(edges)
            new = []
            for r, s in enumerate(sig.tolist()):  # equal sets count once
                if n[r] and s not in seen:
                    seen.add(s)
                    new.append(r)
            new = np.array(new, np.int64)
            if len(new):
                size = n[new]
                prefix = size - least_overlap(size, percent) + 1 + size // 8
                prefix = np.minimum(prefix, size)
                at = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix - edges[new], prefix)
                who = np.repeat(sig[new], prefix)
                held.add(key=shingle[at], at=np.zeros(len(at), np.uint8), doc=who, salt=np.zeros(len(at), np.int32))
            if held.n >= flush:
                yield sharing.emit(held.take())
                seen.clear()
        if held.n:
            yield sharing.emit(held.take())

    def count(table: pa.Table) -> pa.Table:
        sig, n = np.unique(np.concatenate(Sharing.shared(table)[0]), return_counts=True)
        rows = [(b, pack(sig=sig[i], n=n[i].astype(np.uint32))) for b, i in split_by(sig.astype(np.uint64) % np.uint64(buckets), buckets)]
        return pa.Table.from_batches([_blobs(rows)])

    def add(table: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py()) for b in table.column("blob")]
        sig, place = np.unique(np.concatenate([x["sig"] for x in parts]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([x["n"] for x in parts]))
        return pa.table({"sig": pa.array(sig.astype(np.int64)), "shared": pa.array(n.astype(np.int64))})

    blob = "bucket int, blob binary"
    sent = docs.select(text).mapInArrow(by_batch(send), blob)
    return sent.groupBy("bucket").applyInArrow(by_group(count), blob).groupBy("bucket").applyInArrow(by_group(add), "sig long, shared long")


def survivor_sets(docs: DataFrame, survivors: DataFrame, gram: int, text: str) -> DataFrame:
    """(sid, n, words) of each surviving set, read from one of its documents: its signature, size and compressed, lower-case words.

    A set whose document occurs more than once comes as often; that changes no component.
    """

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch, a, shingle, edges in _sets(batches, gram, 2):
            sid = np.asarray(batch.column(1).slice(a, len(edges) - 1))
            keep = np.flatnonzero(signatures(shingle, edges) == sid)
            data, offsets = utf8(batch.column(2).slice(a, len(edges) - 1))
            rows = [squeeze(b" ".join(LOWER[data[offsets[r] : offsets[r + 1]]].tobytes().split())) for r in keep.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(sid[keep]), pa.array(np.diff(edges)[keep]), pa.array(rows, pa.binary())], names=["sid", "n", "words"])

    joined = docs.join(survivors, "doc_id")
    return joined.select("doc_id", "sig", text).mapInArrow(by_batch(run), "sid long, n long, words binary")


def unpacked(words: pa.Array, gram: int, limit: int = 1 << 21):
    """(first row, list of sets) of compressed words, about ``limit`` bytes of text at a time."""
    open_one = zstandard.ZstdDecompressor().decompress
    parts, size, first = [], 0, 0
    for i, blob in enumerate(words):
        parts.append(open_one(blob.as_py()))
        size += len(parts[-1])
        if size >= limit or i + 1 == len(words):
            offsets = np.cumsum([0, *map(len, parts)])
            shingle, edges = shingle_sets(np.frombuffer(b"".join(parts), np.uint8), offsets, gram)
            yield first, np.split(shingle, edges[1:-1])
            parts, size, first = [], 0, i + 1


def frequencies(sets: DataFrame, gram: int) -> np.ndarray:
    """Estimated number of sets with a shingle, by the low bits of its hash: COUNTERS numbers, never too low."""

    def count(batches):
        table = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for _, found in unpacked(batch.column(0), gram):
                for tokens in found:
                    table[tokens & np.uint64(COUNTERS - 1)] += 1
        used = np.flatnonzero(table)
        step = COUNTERS // RANGES
        rows = [(b, pack(at=(used[i] % step).astype(np.uint32), n=table[used[i]])) for b, i in split_by(used // step, RANGES)]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // RANGES, np.int32)
        for blob in table.column("blob"):
            x = unpack(blob.as_py())
            np.add.at(total, x["at"], x["n"])
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "blob": pa.array([pack(n=total)], pa.binary())})

    out = np.zeros(COUNTERS, np.int32)
    step = COUNTERS // RANGES
    for b, blob in sets.select("words").mapInArrow(by_batch(count), "bucket int, blob binary").groupBy("bucket").applyInArrow(by_group(add), "bucket int, blob binary").collect():
        out[b * step : (b + 1) * step] = unpack(bytes(blob))["n"]
    return out


def index_keys(tokens: np.ndarray, often: np.ndarray, percent: int, rare: int) -> np.ndarray:
    """The keys of one set: rare shingles of its prefix, and same-class pairs of the frequent ones of its extended prefix."""
    n = len(tokens)
    order = np.lexsort((tokens, often))
    tokens, often = tokens[order], often[order]
    prefix = n - int(least_overlap(n, percent)) + 1
    out = [tokens[:prefix][(often[:prefix] > 1) & (often[:prefix] <= rare)]]
    # two partners' sizes differ by less than a factor of 2, so they meet in the smaller one's band
    for band in {n.bit_length(), int(least_overlap(n, percent)).bit_length()}:
        classes = max(1, (1 << band) // 16)
        frequent = tokens[: prefix + classes][often[: prefix + classes] > rare]
        if len(frequent) > 1:
            of = (frequent >> np.uint64(40)) % np.uint64(classes)
            by = np.lexsort((frequent, of))
            frequent, of = frequent[by], of[by]
            for gap in range(1, len(frequent)):
                same = np.flatnonzero(of[gap:] == of[:-gap])
                if not len(same):
                    break
                out.append(mix(frequent[same] * np.uint64(0x9E3779B97F4A7C15) + frequent[same + gap] + np.uint64(band)))
    return np.unique(np.concatenate(out))


def fits_another(key: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which entries, sorted by key and size, share their key with one whose size allows a link: a neighbour's then does."""
    near = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])
    return np.concatenate([[False], near]) | np.concatenate([near, [False]])


def entries(sets: DataFrame, often: np.ndarray, percent: int, rare: int, gram: int = 5, flush: int = 1 << 21) -> DataFrame:
    """(key, sid, n, size) of the keys that two sets or more of fitting sizes have, ``size`` being how many. Keys are told apart by 48 bits and their bucket; a collision only adds candidates."""
    shared = sets.sparkSession.sparkContext.broadcast(often)  # COUNTERS numbers, whatever the input
    buckets = partitions(sets.sparkSession)

    def send(batches):
        table, held = shared.value, _Held("key sid n")

        def emit():
            x = held.take()
            rows = []
            for b, i in split_by((x["key"] % np.uint64(buckets)).astype(np.int64), buckets):
                key = x["key"][i] // np.uint64(buckets) & np.uint64((1 << 48) - 1)
                rows.append((b, pack(low=key.astype(np.uint32), high=(key >> np.uint64(32)).astype(np.uint16), n=x["n"][i].astype(np.uint32), **pack_docs(x["sid"][i], np.zeros(len(i), np.int32)))))
            return _blobs(rows)

        for batch in batches:
            sids = batch.column(0).to_pylist()
            for first, found in unpacked(batch.column(1), gram):
                for sid, t in zip(sids[first : first + len(found)], found, strict=True):
                    keys = index_keys(t, table[t & np.uint64(COUNTERS - 1)], percent, rare)
                    if len(keys):
                        held.add(key=keys, sid=np.full(len(keys), sid, np.int64), n=np.full(len(keys), len(t), np.int64))
                    if held.n >= flush:
                        yield emit()
        if held.n:
            yield emit()

    def meet(table: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py()) for b in table.column("blob")]
        key = np.concatenate([x["low"].astype(np.uint64) | x["high"].astype(np.uint64) << np.uint64(32) for x in parts])
        sid, n = np.concatenate([unpack_docs(x)[0] for x in parts]), np.concatenate([x["n"] for x in parts])
        order = np.lexsort((n, key))
        keep = order[fits_another(key[order], n[order].astype(np.int64), percent)]
        size = np.diff(np.append(group_edges(key[keep]), len(keep)))
        each = np.repeat(size, size)
        full = (key[keep] * np.uint64(buckets) + np.uint64(table.column("bucket")[0].as_py())).astype(np.int64)
        return pa.table({"key": pa.array(full), "sid": pa.array(sid[keep]), "n": pa.array(n[keep].astype(np.int64)), "size": pa.array(each.astype(np.int64))})

    sent = sets.select("sid", "words").mapInArrow(by_batch(send), "bucket int, blob binary")
    return sent.groupBy("bucket").applyInArrow(by_group(meet), "key long, sid long, n long, size long")


def link_block(sids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join what the labels keep apart: a spanning forest over every two sets of different labels."""
    sids, one = np.unique(sids, return_index=True)  # a set may come twice
    labels, sets = labels[one], [sets[i] for i in one.tolist()]
    _, root, many = np.unique(labels, return_inverse=True, return_counts=True)
    order = np.argsort(-many[root], kind="stable")  # the commonest label first: its sets need not meet each other
    sids, root, sets = sids[order], root[order], [sets[i] for i in order.tolist()]
    start = int((root == root[0]).sum())
    sizes = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    edge = group_edges(tokens[order])
    posting = owner[order]
    bounds = np.append(edge, len(tokens))
    number = np.empty(len(tokens), np.int64)
    number[order] = np.repeat(np.arange(len(edge)), np.diff(bounds))
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i in range(start, len(sets)):
        mine = number[first[i] : first[i + 1]]
        lo, n = bounds[mine], bounds[mine + 1] - bounds[mine]
        lo, n = lo[n > 1], n[n > 1]
        if not len(n):
            continue
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        both = np.bincount(posting[at], minlength=len(sets))[:i]
        linked = np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[:i] - both))
        for r in np.unique(root[linked]).tolist():
            if r != root[i]:
                out.append((int(sids[linked[root[linked] == r][0]]), int(sids[i])))
                root[root == r] = root[i]
    return out


def compare_blocks(assigned: DataFrame, sets: DataFrame, percent: int, block: int, gram: int = 5) -> DataFrame:
    """(a, b): links that connect what is connected inside each block. ``assigned``: (sid, key, label, size of the key)."""
    chunks = F.greatest(F.ceil(F.col("size") * 2 / block), F.lit(1)).cast("int")
    half = F.pmod(F.xxhash64("sid"), chunks).cast("int")
    parts = assigned.withColumn("chunks", chunks).withColumn("half", half)
    # a small block is one task; of a large one every two chunks are
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("size") <= block, F.lit(0)).otherwise(F.col("chunks") - 1)))
    parts = parts.withColumn("other", other)
    whole = F.col("size") <= block
    parts = parts.select("sid", "key", "label", F.when(whole, 0).otherwise(F.least("half", "other")).alias("i"), F.when(whole, 0).otherwise(F.greatest("half", "other")).alias("j"))

    def link(table: pa.Table) -> pa.Table:
        sids, labels = np.asarray(table.column("sid")), np.asarray(table.column("label"))
        found = link_block(sids, labels, [x for _, part in unpacked(table.column("words"), gram) for x in part], percent) if len(sids) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return parts.join(sets.select("sid", "words"), "sid").groupBy("key", "i", "j").applyInArrow(by_group(link), "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int, gram: int = 5) -> DataFrame:
    """The pairs (a, b) that link."""
    # only sets that some pair names travel
    named = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    some = materialize(sets.join(named, "sid", "left_semi"), "named")
    joined = pairs.join(some.select(F.col("sid").alias("a"), F.col("words").alias("x")), "a").join(some.select(F.col("sid").alias("b"), F.col("words").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for (_, left), (_, right) in zip(unpacked(batch.column(2), gram, 1), unpacked(batch.column(3), gram, 1), strict=True):
                x, y = left[0], right[0]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = materialize(joined.mapInArrow(by_batch(run), "a long, b long"), "links")
    discard(some)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(sid, label): the smallest id reachable, for every id that has an edge.

    Alternates hooking every id's neighbours to its smallest one (larger ids, then smaller ids)
    until nothing changes; each round is written out, so no plan grows and lost executors cost a round.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if current.isEmpty():
        return current.select(F.col("u").alias("sid"), F.col("v").alias("label"))
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        current, last = materialize(small, "edges"), current
        discard(last)
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return current.select(F.col("u").alias("sid"), F.col("v").alias("label"))
        before = now


def near_duplicates(docs: DataFrame, gram: int = 5, percent: int = 75, rare: int = 16, block: int = 4096, rounds: int = 1, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: set size and the smallest doc_id that links reach.

    Null text counts as empty. An empty set links with nothing; a row with a null doc_id has a null
    component. Different texts under one doc_id are one node of the link graph; an empty one among them
    keeps its own doc_id.
    """
    rows = docs.select("doc_id", F.col(text).alias("text"))
    described = materialize(describe(rows, gram, "text"), "sets")
    named = described.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    groups = named.groupBy("sig", "n").agg(F.min("doc_id").alias("doc_id"))
    # rows of one doc_id with different texts tie their sets together
    ties = named.groupBy("doc_id").agg(F.min("sig").alias("a"), F.max("sig").alias("hi")).where("a <> hi").select("doc_id", "a")
    tied = named.join(ties, "doc_id").select("a", F.col("sig").alias("b"))
    counts = shared_counts(rows.where(F.col("text").isNotNull()), gram, percent, "text")
    need = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 8)
    survivors = groups.join(counts, "sig").where(F.col("shared") >= need).select("doc_id", "sig")
    sets = materialize(survivor_sets(rows.where(F.col("text").isNotNull()), survivors, gram, "text"), "words")
    index = materialize(entries(sets, frequencies(sets, gram), percent, rare, gram), "entries")
    links = materialize(tied, "links")
    labels = components(links)
    scratch, met, opened = [sets, index, links], None, labelled(index, labels)  # at first every key is open
    for k in range(rounds):
        if k:
            opened = materialize(open_entries(opened, labels), "open")
            scratch.append(opened)
        chosen = opened.groupBy("sid").agg(F.max(F.struct("size", "key"))["key"].alias("key")).select("key").distinct()
        blocks = materialize(opened.join(chosen, "key", "left_semi"), "blocks")
        links = materialize(links.unionByName(compare_blocks(blocks, sets, percent, block, gram)), "links")
        labels = components(links)
        scratch += [blocks, links]
        # the chosen keys are done: all their sets have met
        opened = opened.join(chosen, "key", "left_anti")
        mine = blocks.select("sid", "key")
        met = mine if met is None else met.unionByName(mine)
    met = materialize(met.groupBy("sid").agg(F.collect_set("key").alias("met")), "met")
    opened = materialize(open_entries(opened, labels).join(met, "sid", "left"), "open")
    left, right = (opened.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("sid", "n", "label", "met"))) for side in "ab")
    apart = ~F.coalesce(F.arrays_overlap("met_a", "met_b"), F.lit(False))
    rest = left.join(right, "key").where((F.col("sid_a") < F.col("sid_b")) & (F.col("label_a") != F.col("label_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & apart)
    rest = materialize(rest.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).distinct(), "rest")
    scratch += [met, opened, rest]
    if not rest.isEmpty():
        found = verify(rest, sets, percent, gram)
        scratch.append(found)
        if not found.isEmpty():
            labels = components(links.unionByName(found))
    discard(*scratch)
    # classes of two sets or more; a very large one is spread over ``SALTS`` tasks
    labels = labels.unionByName(labels.select(F.col("label").alias("sid"), "label").distinct())
    classed = groups.join(labels.select(F.col("sid").alias("sig"), "label"), "sig").select("sig", "n", "doc_id", "label", F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int").alias("salt"))
    smallest = classed.groupBy("label").agg(F.min("doc_id").alias("component")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    classed = classed.join(smallest, ["label", "salt"]).select("sig", "n", "component")
    # the rest are by themselves: their set's smallest document names them
    named_groups = groups.join(classed, ["sig", "n"], "left").select(F.col("sig").alias("g_sig"), F.col("n").alias("g_n"), F.coalesce("component", "doc_id").alias("component"))
    out = described.join(named_groups, (F.col("sig") == F.col("g_sig")) & (F.col("n") == F.col("g_n")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def labelled(index: DataFrame, labels: DataFrame) -> DataFrame:
    """Each entry with its set's component; a set without links is its own."""
    return index.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def open_entries(index: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, sid, n, label, size): entries of the keys whose sets are not all in one component."""
    now = labelled(index.select("key", "sid", "n"), labels)
    keys = now.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "size")
    return now.join(keys, "key")


def op7_jaccard_join(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: the number of its 5-word shingles and the smallest doc_id that links of 0.75 or more reach.

    Null and empty texts have no shingle and are their own component; a null doc_id has a null one.
    Rows of one doc_id are one node, so a repeated row changes nothing. No documents give no row.
    Columns other than doc_id and text are ignored.
    """
    return near_duplicates(docs)
