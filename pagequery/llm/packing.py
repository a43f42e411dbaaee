"""Packing of tokenised documents into sequences by bin completion.

Documents are cut into pieces of at most ``capacity`` tokens. What the packing depends on is only how many pieces there are of
each length: a table of at most ``capacity`` rows, however large the corpus. The driver packs this table; a pattern (a filling of
one sequence) is applied as often as its lengths allow, so the plan has a few thousand patterns at any size. Pieces then take
their places by their rank among the pieces of their length. Ranks come from counts by (task, length) and the order within the
task: no task ever gathers the pieces of a length.

Search: the incumbent is best-fit decreasing. Unless it meets the lower bound, branch and bound fills sequences around the
largest length left, with every filling that no other one dominates (none whose pieces could give way to one longer piece left
over), least waste first, for every number of sequences, and prunes by the waste so far and by the bound on what is left. ``nodes``
is the search's only limit, and None has it run to the end; ``Packing.proven`` tells whether it did. The best packing found is used.

Defined results: a null or empty text is one piece that holds only the end token. Repeated rows are packed as rows of their own.
An empty table gives an empty result. Any doc_id is kept, null included.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .token_count import machine_of, read_texts, spans, tokenizer_path

KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: the volume bound, and that of Martello and Toth for items that cannot share."""
    lengths = np.arange(capacity + 1)
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts.keys())] = list(counts.values())
    many, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(lengths * n)])  # of lengths below an index
    a, half = np.arange(capacity // 2 + 1), capacity // 2
    alone = many[-1] - many[capacity - a + 1]
    middle = many[capacity - a + 1] - many[half + 1]
    room = middle * capacity - (volume[capacity - a + 1] - volume[half + 1])
    small = volume[half + 1] - volume[a]
    return int(max(-(-volume[-1] // capacity), (alone + middle + np.maximum(0, -(-(small - room) // capacity))).max()))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing, on sequences of the same filling at once."""
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}  # by room
    rooms: list[int] = []

    def put(room: int, n: int, filling: dict[int, int]) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((n, filling))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                per = min(left, capacity // length)
                n = left // per
                put(capacity - per * length, n, {length: per})
                left -= n * per
                continue
            room = rooms[i]
            n, filling = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[i]
            per = min(left, room // length)
            use = min(n, left // per)
            if n > use:
                put(room, n - use, filling)
            put(room - per * length, use, {**filling, length: per})
            left -= use * per
    return [(n, tuple(sorted(f.items(), reverse=True))) for sets in open_.values() for n, f in sets]


Key = tuple[int, Pattern]  # of a filling: what it wastes, and its pieces; less waste comes first, then longer pieces


def reachable(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """For each i the sums up to room that the first i lengths reach, as the bits of a number."""
    mask, sums = (1 << (room + 1)) - 1, 1
    out = [sums]
    for x in lengths:
        n, step = min(left[x], room // x), 1
        while n > 0:  # n copies by doubling
            use = min(step, n)
            sums |= sums << (x * use) & mask
            n, step = n - use, 2 * step
        out.append(sums)
    return out


def with_sum(lengths: list[int], left: dict[int, int], reach: list[int], total: int, after: Pattern | None) -> Iterator[Pattern]:
    """All fillings of exactly that sum, those of longer pieces first, without a dead end; after: only those that come later."""
    floor = dict(after) if after is not None else None
    path: list[list[int]] = []  # (index of a length, copies of it, whether all before is as in after)
    i, tight, rest = len(lengths), floor is not None, total
    while True:
        while rest:  # down to a whole filling
            i = min(i, bisect.bisect_right(lengths, rest)) - 1
            x = lengths[i]
            n = min(left[x], rest // x, floor.get(x, 0) if tight else rest)
            while not reach[i] >> (rest - n * x) & 1:
                n -= 1
                if n < 0:
                    break
            if n < 0:
                break
            path.append([i, n, tight])
            tight = tight and n == floor.get(x, 0)
            rest -= n * x
        else:
            if not tight:
                yield tuple((lengths[j], n) for j, n, _ in path if n)
        while path:  # the next one: fewer copies of the last length that allows it
            i, n, was = path.pop()
            x = lengths[i]
            rest += n * x
            n -= 1
            while n >= 0 and not reach[i] >> (rest - n * x) & 1:
                n -= 1
            if n >= 0:
                path.append([i, n, was])
                rest -= n * x
                tight = False
                break
        else:
            return


def dominated(filling: Pattern, waste: int, spare: int) -> bool:
    """Whether pieces of the filling could give way to one longer piece that is left over (or two and more to one as long).

    spare: the lengths left over, as bits. Then some best packing has the other filling, and the pieces elsewhere."""
    sums, several = 1, 0  # of pieces that may give way: all sums, and those of two pieces and more
    for x, n in filling:
        step = 1
        while n > 0:
            use = min(step, n)
            several |= several << (x * use) | (sums & ~1) << (x * use) | (1 << (x * use) if use > 1 else 0)
            sums |= sums << (x * use)
            n, step = n - use, 2 * step
    if several & spare:
        return True
    longer, width = sums << 1, 1  # one to waste more than what gives way
    while width < waste:
        more = min(width, waste - width)
        longer |= longer << more
        width += more
    return bool(waste and longer & spare)


def completions(left: dict[int, int], capacity: int, after: Key | None, most: int) -> Iterator[Key | None]:
    """The undominated fillings around the largest length left, wasting at most so much, in the order of their keys; None for each dominated one."""
    top = max(left)
    rest = {x: n - (x == top) for x, n in left.items() if x <= capacity - top}
    lengths = sorted(x for x, n in rest.items() if n)
    room = capacity - top
    reach = reachable(lengths, rest, room)
    for waste in range(after[0] if after else 0, min(most, room) + 1):
        if not reach[-1] >> (room - waste) & 1:
            continue
        inside = None
        if after and waste == after[0]:
            inside = tuple((x, n - (x == top)) for x, n in after[1] if n > (x == top))
        for pieces in with_sum(lengths, rest, reach, room - waste, inside):
            used = dict(pieces)
            spare = sum(1 << x for x in lengths if rest[x] > used.get(x, 0))
            if dominated(pieces, waste, spare):
                yield None
                continue
            used[top] = used.get(top, 0) + 1
            yield waste, tuple(sorted(used.items(), reverse=True))


@dataclass
class Packing:
    """Patterns, each with the number of its sequences; proven: whether no packing has fewer sequences."""

    patterns: list[tuple[int, Pattern]]
    proven: bool

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.patterns)


def bin_completion(counts: dict[int, int], capacity: int, nodes: int | None = 5000) -> Packing:
    """A packing of counts = {length: pieces} by branch and bound; nodes: how many steps the search may take (fillings that it looks at, and branches with one sequence fewer), None for all.

    A branch is a filling and how many sequences have it. Sequences around the same largest length take their fillings in the
    order of the keys, so no packing is met twice; each node is pruned by the waste so far and by the bound on what is left."""
    counts = {k: v for k, v in counts.items() if v}
    incumbent = best_fit(counts, capacity)
    best = sum(n for n, _ in incumbent)
    bound = lower_bound(counts, capacity) if counts else 0
    volume = sum(k * v for k, v in counts.items())
    left = dict(counts)
    plan: list[tuple[int, Pattern]] = []
    levels: list[list] = []  # (the fillings still to come, the filling taken, how often it is taken)
    used = waste = 0
    looked = 0

    def put(filling: Pattern, n: int) -> None:
        for x, k in filling:
            left[x] = left.get(x, 0) - n * k
            if not left[x]:
                del left[x]

    def opened(after: Key | None) -> list:
        return [completions(dict(left), capacity, after, (best - 1) * capacity - volume - waste), None, 0]

    if best > bound:
        levels.append(opened(None))
    while levels and best > bound:
        if nodes is not None and looked >= nodes:
            return Packing(incumbent, False)
        looked += 1
        level = levels[-1]
        if level[2]:  # the branch taken is done: one sequence fewer of it
            w, filling = level[1]
            put(filling, -1)
            used, waste, level[2] = used - 1, waste - w, level[2] - 1
            plan.pop()
        else:
            level[1] = next(level[0], StopIteration)
            if level[1] is StopIteration:
                levels.pop()
                continue
            if level[1] is None:
                continue
            w, filling = level[1]
            n = min(left[x] // k for x, k in filling)
            if w:
                n = min(n, ((best - 1) * capacity - volume - waste) // w)
            if n <= 0:
                continue
            put(filling, n)
            used, waste, level[2] = used + n, waste + n * w, n
        if not level[2]:
            continue
        plan.append((level[2], filling))
        if not left:
            if used < best:
                best, incumbent = used, list(plan)
            continue
        if used + lower_bound(left, capacity) >= best:
            continue
        levels.append(opened(level[1] if max(left) == filling[0][0] else None))
    return Packing(incumbent, True)


class Plan:
    """Places by length and rank, as flat arrays: at most some ten thousand intervals, whatever the corpus."""

    def __init__(self, packed: list[tuple[int, Pattern]], counts: dict[int, int], capacity: int):
        self.base = np.zeros(capacity + 2, np.int64)  # of a length in the common numbering of (length, rank)
        for k, v in counts.items():
            self.base[k + 1] = v
        self.base = np.cumsum(self.base)
        at = self.base[:-1].copy()
        rows, sequence = [], 0
        for n, filling in packed:
            offset = 0
            for length, per in filling:
                rows.append((at[length], sequence, per, length, offset))
                at[length] += n * per
                offset += length * per
            sequence += n
        rows.sort()
        self.start, self.sequence, self.per, self.length, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of the pieces of these lengths and ranks (from 0)."""
        at = self.base[length] + rank
        i = np.searchsorted(self.start, at, "right") - 1
        k = at - self.start[i]
        return self.sequence[i] + k // self.per[i], self.offset[i] + (k % self.per[i]) * self.length[i]


def tokenised_pieces(documents: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, with the task and the rank among the task's pieces of that length."""

    def cut(batches):
        machine = machine_of(path, True)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            row, at, out = 0, [], []
            for part in spans(batch.column("text").to_pylist()):
                codes, starts = read_texts(machine, part)
                ids = machine.ids(codes).tobytes()
                for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                    data = memoryview(ids[4 * a : 4 * b] + tail)
                    for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                        one = data[start : start + 4 * capacity]
                        n = len(one) // 4
                        at.append(row)
                        out.append((piece, start // 4, n, zlib.crc32(one), task, seen[n]))
                        seen[n] += 1
                    row += 1
            more = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), KINDS, strict=True)] if out else [pa.array([], k) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *more], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(documents: DataFrame, path: str | None = None, capacity: int = 4096, end: int = 1, nodes: int | None = 5000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the pieces of documents(doc_id, text) and their places."""
    spark = documents.sparkSession
    made = stored(tokenised_pieces(documents, path or tokenizer_path(), capacity, end), "pieces")
    by_task = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = spark.sparkContext.broadcast(Plan(bin_completion(counts, capacity, nodes).patterns, counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))

    def place(batches):
        for batch in batches:
            found = plan.value.places(batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("before").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, found)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    ranked = made.join(starts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before")
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
