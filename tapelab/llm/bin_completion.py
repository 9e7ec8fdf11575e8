"""Best-fit packing of documents into few sequences, by bin completion.

A document's ids are cut only where it is longer than a sequence. What matters for packing is then the
number of pieces of each length: one row per length, at most ``window`` rows whatever the size of the
data. The packing is planned on these counts, as patterns (which lengths fill a sequence) with a number
of copies each, and the pieces are dealt to the patterns by their rank within their length:

1. A pass encodes the documents and numbers each task's pieces of a length. Sums over (task, length)
   give every piece its rank; a length that a third of all pieces have is spread over all tasks.
2. The plan. Best-fit decreasing on counts gives the first incumbent. If it has more sequences than the
   lower bound, branch and bound: around the largest length left, undominated fillings of the rest of
   the sequence are enumerated, those that waste least first, and each is used for as many sequences
   as there are pieces for. A branch ends when the ids and the waste so far already need as many
   sequences as the incumbent. A filling is dominated if another piece fits into its waste, or if one of its
   pieces, or two together, can be exchanged for one left piece that is larger by no more than the waste.
   ``effort`` bounds the fillings tried; the incumbent stands when it is used up. A plan's time does
   not depend on the number of documents.
3. A second pass looks the ranks up in the plan.

The driver and every task hold the counts and the plan only, both bounded by ``window``.

Defined results. Null text counts as empty: one piece, the end id. Rows repeat as often as they occur in the
input. Any doc_id, null too, is carried along. Equal lengths are interchangeable. No rows: no pieces.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelab.llm import tokens
from tapelab.llm.batches import sliced
from tapelab.session import stage

EFFORT = 6_000  # fillings that a plan may try
STEPS = 300  # of one enumeration
WIDTH = 6  # fillings that a node keeps
BATCH_BYTES = 8 << 20

Pattern = tuple[tuple[int, int], ...]  # (length, pieces of that length) in a sequence


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: no two pieces over half fit together, and small ones need what room large ones leave."""
    number, total = np.zeros(capacity + 2, object), np.zeros(capacity + 2, object)
    for size, n in counts.items():
        number[size], total[size] = n, n * size
    above, room = np.cumsum(number[::-1])[::-1], np.cumsum(total[::-1])[::-1]  # of this length or more
    half, best = capacity // 2 + 1, 0
    for low in range(1, half + 1):
        alone = above[capacity - low + 1]  # no piece of ``low`` or more fits beside
        large = above[half] - alone
        free = large * capacity - (room[half] - room[capacity - low + 1])
        small = room[low] - room[half]
        best = max(best, alone + large + max(0, -(-(small - free) // capacity)))
    return int(best)


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing: patterns with their copies. Bins alike are filled together."""
    open_: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, copies: int):
        if room not in open_:
            open_[room] = Counter()
            insort(rooms, room)
        open_[room][pattern] += copies

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, pattern, copies = capacity, (), -(-left // (capacity // size))
            else:
                room = rooms[at]
                pattern, copies = open_[room].popitem()
                if not open_[room]:
                    del open_[room], rooms[at]
            each = room // size
            whole = min(copies, left // each)
            if whole:
                put(room - each * size, pattern + ((size, each),), whole)
                left, copies = left - whole * each, copies - whole
            if copies and 0 < left < each:
                put(room - left * size, pattern + ((size, left),), 1)
                left, copies = 0, copies - 1
            if copies and pattern:
                put(room, pattern, copies)
    return sum(open_.values(), Counter())


def _fillings(counts: dict[int, int], sizes: list[int], room: int) -> list[tuple[int, dict[int, int]]]:
    """Undominated fillings of ``room`` as (waste, pieces by length), least waste first. ``sizes`` are the lengths left, rising."""
    found: dict[tuple, tuple[int, dict[int, int]]] = {}
    used: dict[int, int] = {}
    steps = STEPS

    def left(size: int) -> bool:
        return counts[size] > used.get(size, 0)

    def fits(low: int, high: int) -> bool:
        return any(left(s) for s in sizes[bisect_left(sizes, low):bisect_right(sizes, high)])

    def dominated(waste: int) -> bool:
        if fits(1, waste):
            return True
        mine = [s for s, k in used.items() for _ in range(min(k, 2))]
        return waste > 0 and any(fits(s + 1, s + waste) for s in used) or any(
            fits(a + b, a + b + waste) for i, a in enumerate(mine) for b in mine[:i])

    def extend(room: int, top: int):
        nonlocal steps
        steps -= 1
        deeper = False
        if room <= top and room in counts and left(room):  # nothing wasted
            used[room] = used.get(room, 0) + 1
            keep(0)
            drop(room)
            deeper = True
        for at in range(bisect_right(sizes, min(room - 1, top)) - 1, -1, -1):
            if steps <= 0 or len(found) >= 4 * WIDTH:
                return
            size = sizes[at]
            if left(size):
                deeper = True
                used[size] = used.get(size, 0) + 1
                extend(room - size, size)
                drop(size)
        if not deeper:
            keep(room)

    def drop(size: int):
        used[size] -= 1
        if not used[size]:
            del used[size]

    def keep(waste: int):
        if not dominated(waste):
            found.setdefault(tuple(sorted(used.items())), (waste, dict(used)))

    extend(room, room)
    return sorted(found.values(), key=lambda f: (f[0], sum(f[1].values())))[:WIDTH]


def _completed(counts: dict[int, int], capacity: int, incumbent: int, least: int, effort: int) -> Counter | None:
    """A packing into fewer than ``incumbent`` sequences, if branch and bound finds one; it ends at ``least``."""
    counts = dict(counts)
    sizes = sorted(counts)
    total = sum(s * n for s, n in counts.items())
    best, chosen = None, []

    def take(pieces: dict[int, int], copies: int):
        for s, k in pieces.items():
            counts[s] -= k * copies
            if not counts[s]:
                del counts[s]
                del sizes[bisect_left(sizes, s)]

    def give(pieces: dict[int, int], copies: int):
        for s, k in pieces.items():
            if s not in counts:
                counts[s] = 0
                insort(sizes, s)
            counts[s] += k * copies

    def options() -> Iterator[tuple[int, dict[int, int], int]]:
        largest = sizes[-1]
        counts[largest] -= 1
        tried = _fillings(counts, sizes, capacity - largest)
        counts[largest] += 1
        for waste, pieces in tried or [(capacity - largest, {})]:
            pieces = dict(pieces)
            pieces[largest] = pieces.get(largest, 0) + 1
            yield waste, pieces, min(counts[s] // k for s, k in pieces.items())

    wasted = bins = 0
    branches = [options()]
    while branches and effort > 0:
        effort -= 1
        step = next(branches[-1], None)
        if step is None:
            branches.pop()
            if chosen:
                waste, pieces, copies = chosen.pop()
                give(pieces, copies)
                wasted, bins = wasted - waste * copies, bins - copies
            continue
        waste, pieces, copies = step
        if -(-(total + wasted + waste * copies) // capacity) >= incumbent:
            continue
        chosen.append(step)
        take(pieces, copies)
        wasted, bins = wasted + waste * copies, bins + copies
        if sizes:
            branches.append(options())
            continue
        if bins < incumbent:
            best, incumbent = Counter(), bins
            for _, p, n in chosen:
                best[tuple(sorted(p.items(), reverse=True))] += n
            if incumbent <= least:
                break
        chosen.pop()
        give(pieces, copies)
        wasted, bins = wasted - waste * copies, bins - copies
    return best


def plan(counts: dict[int, int], capacity: int, effort: int = EFFORT) -> list[tuple[Pattern, int]]:
    """Patterns and their copies for ``counts`` pieces by length, all of at most ``capacity``."""
    rest = {s: n for s, n in counts.items() if n and s < capacity}
    out = Counter({((capacity, 1),): counts[capacity]} if counts.get(capacity) else {})
    fitted = best_fit(rest, capacity)
    least = lower_bound(rest, capacity)
    if fitted.total() > least:
        fitted = _completed(rest, capacity, fitted.total(), least, effort) or fitted
    return sorted((out + fitted).items())


class Places:
    """Where the pieces of every length go: lookup by (length, rank within the length)."""

    def __init__(self, patterns: list[tuple[Pattern, int]], counts: dict[int, int], capacity: int):
        self.base = np.zeros(capacity + 2, np.int64)  # pieces shorter than this length
        for size, n in counts.items():
            self.base[size + 1] = n
        self.base = np.cumsum(self.base)
        rows, sequence, seen = [], 0, Counter()
        for pattern, copies in patterns:
            offset = 0
            for size, each in pattern:
                rows.append((self.base[size] + seen[size], each, sequence, offset))
                seen[size] += each * copies
                offset += size * each
            sequence += copies
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.sequences = sequence

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.base[length] + rank
        first, each, sequence, offset = self.rows[np.searchsorted(self.rows[:, 0], at, "right") - 1].T
        bin_, slot = np.divmod(at - first, each)
        return sequence + bin_, offset + slot * length


def _encode(path: str, end_id: int, window: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        enc = tokens.encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        part, seen = TaskContext.get().partitionId(), Counter()
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "place", *(["ids"] if with_ids else []))

        def flush(cols):
            kinds = {"doc_id": kind, "piece": pa.int32(), "part": pa.int32(), "ids": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, cols)], names=list(names))

        for b in sliced(batches):
            kind = b.schema.field("doc_id").type
            cols, size = [[] for _ in names], 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = tokens.as_words(enc.encode(t or "") + end, enc.dtype)
                for piece, start in enumerate(range(0, len(ids), window)):
                    cut = ids[start:start + window].astype("<u4")
                    row = (i, piece, start, len(cut), tokens.crc(cut), part, seen[len(cut)], cut.tobytes() if with_ids else None)
                    seen[len(cut)] += 1
                    size += cut.nbytes
                    for c, v in zip(cols, row):
                        c.append(v)
                if with_ids and size >= BATCH_BYTES:
                    yield flush(cols)
                    cols, size = [[] for _ in names], 0
            if cols[0]:
                yield flush(cols)

    return run


def _place(shared, names: list[str]):
    def run(batches):
        for b in batches:
            sequence, offset = shared.value.of(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 0, text: str = "text", doc_id: str = "doc_id",
         with_ids: bool = True, effort: int = EFFORT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, the ids (unsigned 32-bit), sequence_id and offset.

    Sequence numbers run from 0 without gaps; a sequence's pieces fill it from offset 0 without gaps.
    """
    head = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()),
            *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    ids = [T.StructField("ids", T.BinaryType())] if with_ids else []
    made = T.StructType([*head, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), *ids])
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encode(tokenizer, end_id, window, with_ids), made))
    groups = stage(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    shared = docs.sparkSession.sparkContext.broadcast(Places(plan(counts, window, effort), counts, window))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = rows.join(groups.select("length", "part", before.alias("before")), ["length", "part"])
    names = [f.name for f in [*head, *ids]]
    return ranked.select(*names, (F.col("before") + F.col("place")).alias("rank")).mapInArrow(
        _place(shared, names), T.StructType([*head, *ids, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(docs, tokenizer, with_ids=False)
