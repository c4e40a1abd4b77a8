"""Packing: Karmarkar-Karp multiway differencing.

Each item begins as a partial partition of one window; the two partial partitions of the largest imbalance are merged,
the heavy windows of one with the light windows of the other, until one partition is left. Where windows of it are over
their capacity, those that are full to ``FULL`` of it are closed, and the items of the others are differenced again; if too
few can be closed the number of windows rises. So items stay whole.

The operator works on blocks of ``BLOCK_WINDOWS`` windows within a partition and needs no shuffle. Only documents of more
tokens than a window are cut: full windows come off them, and the rest is an item as other documents are. A block's windows
that aren't full are taken up in the next block.

Defined results: a null text is empty (its document is just the end id); repeated rows are packed each; no rows give no
rows; other columns of the input are not carried.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkgrove.llm.common import id_text, texts_of, tidy, to_arrow
from sparkgrove.llm.tokens import TextEncoder

BLOCK_WINDOWS = 128
#: Words whose ids a worker keeps: packing often runs beside executors grown in stages before.
WORDS_KEPT = 120_000
#: A window with this share of its capacity is full.
FULL = 0.97


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The items' numbers in k windows of near-equal sums.

    A partial partition is its windows that aren't empty, heaviest first, as (sum, node); a node is an item or a pair.
    """
    if not sizes:
        return [[] for _ in range(k)]
    nodes: list[tuple[int, int]] = []  # pairs, numbered from len(sizes)
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)] if k > 1 else [(0, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - k
        if over > 0:  # the lightest ``over`` of a meet the lightest of b, light with heavy
            free = len(a) - over
            met = []
            for (x, i), (y, j) in zip(a[free:], reversed(b[len(b) - over :]), strict=True):
                nodes.append((i, j))
                met.append((x + y, len(sizes) + len(nodes) - 1))
            merged = a[:free] + b[: len(b) - over] + met
        else:
            merged = a + b
        merged.sort(key=lambda w: (-w[0], w[1]))
        gap = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-gap, serial, merged))
        serial += 1
    out = []
    for _, node in heap[0][2]:
        items, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < len(sizes):
                items.append(x)
            else:
                todo += nodes[x - len(sizes)]
        out.append(sorted(items))
    return out + [[] for _ in range(k - len(out))]


def pack_items(sizes: list[int], capacity: int) -> list[list[int]]:
    """Whole items in windows that keep to the capacity. Windows without items aren't listed."""
    if any(s > capacity for s in sizes):
        raise ValueError("an item is larger than a window")
    left, done, more = list(range(len(sizes))), [], 0
    while left:
        own = [sizes[i] for i in left]
        k = -(-sum(own) // capacity) + more
        windows = [([left[j] for j in w], sum(own[j] for j in w)) for w in differencing(own, k)]
        if all(total <= capacity for _, total in windows):
            return done + [w for w, _ in windows if w]
        closed = [w for w, total in windows if FULL * capacity <= total <= capacity]
        if len(closed) * 8 >= k:
            done += closed
            gone = {i for w in closed for i in w}
            left, more = [i for i in left if i not in gone], 0
        else:
            more += max(1, k // 50)
    return done


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def pack_documents(docs: DataFrame, tokenizer: str, end: int, capacity: int = 2048, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per piece of a document in a window. A window is padded to capacity unless its length is a power of two."""
    arrow = to_arrow(docs.sparkSession, PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, sequence = TextEncoder.get(tokenizer), TaskContext.get().partitionId() << 32
        width = encoder.dtype.itemsize
        out: list[list] = [[] for _ in arrow.names]

        def put(pieces: list[tuple]) -> None:
            """pieces: (doc_id, their ids as bytes, first id, end, number of the document's ids)."""
            nonlocal sequence
            used = sum(p[3] - p[2] for p in pieces)
            padded = used if used & (used - 1) == 0 else capacity
            offset = 0
            for key, ids, a, b, total in pieces:
                crc = zlib.crc32(np.frombuffer(ids, encoder.dtype).astype("<u4").tobytes())
                for column, value in zip(out, (key, a, b - a, crc, total, sequence, offset, padded), strict=True):
                    column.append(value)
                offset += b - a
            sequence += 1

        def flush() -> pa.RecordBatch:
            nonlocal out
            batch, out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow), [[] for _ in arrow.names]
            return batch

        def close(block: list[tuple], last: bool) -> list[tuple]:
            """Put the windows of block, but for those to be taken up again, whose items are returned."""
            sizes = [p[3] - p[2] for p in block]
            again: list[tuple] = []
            windows = pack_items(sizes, capacity)
            full = [sum(sizes[i] for i in w) >= FULL * capacity for w in windows]
            last = last or 2 * sum(full) < len(windows)
            for w, whole in zip(windows, full, strict=True):
                if last or whole:
                    put([block[i] for i in w])
                else:
                    again += [block[i] for i in w]
            return again

        block, have = [], 0
        for batch in batches:
            for key, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts_of(batch), end, WORDS_KEPT), strict=True):
                total, at = len(ids) // width, 0
                while total - at > capacity:
                    put([(key, ids[at * width : (at + capacity) * width], at, at + capacity, total)])
                    at += capacity
                block.append((key, ids[at * width :] if at else ids, at, total, total))
                have += total - at
                if have >= capacity * block_windows:
                    block = close(block, False)
                    have = sum(p[3] - p[2] for p in block)
                    yield flush()
            if out[0]:
                yield flush()
        if block:
            close(block, True)
        if out[0]:
            yield flush()

    return id_text(docs).mapInArrow(tidy(run, "words"), PIECES)
