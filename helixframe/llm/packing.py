"""Cost-balanced sequence packing.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n``: attention is quadratic in a piece,
the rest of a training step linear. Tokens are gathered into blocks; a block of ``t`` tokens gets
``ceil(t / capacity)`` sequences, and its pieces, in descending cost, go each to the cheapest
sequence that still has room. A piece that fits nowhere is cut over the emptiest sequences, so only
the last few sequences of a block have free space. Blocks are formed inside a partition: nothing is
shuffled, and a task holds one block at a time.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import tokenizer_at

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def pack_block(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float | None = None) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Place documents of ``lengths`` tokens: (document, start, length, sequence, offset) each, and each sequence's cost.

    Ties go to the earlier document and the earlier sequence. Documents of no tokens get no piece.
    """
    quadratic = 1.0 / capacity if quadratic is None else quadratic

    def cost(n):
        return linear * n + quadratic * n * n

    placed, costs = [], []
    rest = []
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):  # full sequences need no balancing
            placed.append((doc, k * capacity, capacity, len(costs), 0))
            costs.append(cost(capacity))
        if n % capacity:
            rest.append((n % capacity, doc, whole * capacity))
    if not rest:
        return placed, costs
    base = len(costs)
    count = -(-sum(n for n, _, _ in rest) // capacity)
    room = [capacity] * count
    costs += [0.0] * count
    rest.sort(key=lambda x: (-cost(x[0]), x[1]))
    heap = [(0.0, s) for s in range(count)]
    left = []

    def put(doc, start, n, s):
        placed.append((doc, start, n, base + s, capacity - room[s]))
        room[s] -= n
        costs[base + s] += cost(n)

    for n, doc, start in rest:
        passed, found = [], False
        while heap:
            c, s = heapq.heappop(heap)
            if room[s] >= n:
                put(doc, start, n, s)
                if room[s]:
                    heapq.heappush(heap, (costs[base + s], s))
                found = True
                break
            passed.append((c, s))
        # later pieces may be shorter: sequences that were too full for this one stay
        for x in passed:
            heapq.heappush(heap, x)
        if not found:
            left.append((n, doc, start))
    open_ones = sorted((s for s in range(count) if room[s]), key=lambda s: (-room[s], s))
    for n, doc, start in left:
        while n:
            s = open_ones[0]
            take = min(n, room[s])
            put(doc, start, take, s)
            start, n = start + take, n - take
            if not room[s]:
                open_ones.pop(0)
    return placed, costs


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, block_tokens: int = 1 << 21, linear: float = 1.0, quadratic: float | None = None, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize ``docs`` and pack them: one row per piece; ``with_ids`` adds the piece's ids.

    Every document, a null or empty text included, ends with ``end_id``, so each has at least one
    piece. sequence_id is unique in the result and the same when a task is run again; sequences are
    filled from offset 0 without gaps. A repeated doc_id is packed as often as it occurs.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        words = tokenizer_at(tokenizer)
        part = TaskContext.get().partitionId() << 36
        held, sizes, total, next_id = [], [], 0, 0
        end = np.array([end_id], words.type).tobytes()

        def flush():
            nonlocal held, sizes, total, next_id
            placed, costs = pack_block(sizes, capacity, linear, quadratic)
            filled = np.bincount([x[3] for x in placed], weights=[x[2] for x in placed], minlength=len(costs)).astype(np.int64)
            rows = []
            for doc, start, n, s, at in placed:
                ids = np.frombuffer(held[doc][1], words.type)[start : start + n].astype("<u4")
                rows.append((held[doc][0], start, n, zlib.crc32(ids), sizes[doc], part + next_id + s, at, int(filled[s]), costs[s], *([ids.astype(np.int32)] if with_ids else [])))
            next_id += len(costs)
            held, sizes, total = [], [], 0
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:8]] + [pa.array(columns[8], pa.float64())]
            if with_ids:
                arrays.append(pa.array(columns[9], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            texts = (x.as_py() for x in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode_all(texts), strict=True):
                packed = ids.tobytes() + end
                held.append((doc, packed))
                sizes.append(len(packed) // words.type.itemsize)
                total += sizes[-1]
                if total >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", text).mapInArrow(run, schema)


def op2_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pack ``docs`` into sequences of 4096 tokens, one row per piece.

    Null and empty texts are one piece of their end id. A null doc_id is packed like any other,
    repeated rows as often as they occur; no documents give no piece. Columns other than doc_id and
    text are ignored.
    """
    return pack(docs, tokenizer)
