"""Sets of shingles as packed rows: which shingles several sets hold, and how much two sets have in common.

A row of its own for each shingle costs several times its hash to shuffle. Here the hashes of many sets that go to one
task are one row: sorted, as differences of as many bytes as the largest needs, with each set named once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from attesta.functions import text as T

CHUNK = 1_000_000  # hashes that a task packs at once, and that are compared at once


def bucket_count(chars: int, partitions: int) -> int:
    """Buckets of a range of hashes each, for texts of so many characters: what one holds fits into a Python worker."""
    return max(1, math.ceil(chars / 64e6), min(partitions, math.ceil(chars / 4e6)))


def _edges(buckets: int) -> np.ndarray:
    """The least hash of each bucket."""
    return np.array([-((-i << 32) // buckets) << 32 for i in range(buckets)], np.uint64)


def _body(g: np.ndarray, at: np.ndarray, names: np.ndarray) -> bytes:
    """Ascending hashes and, by places in names, the sets that hold them."""
    some = np.zeros(len(names), bool)
    some[at] = True
    steps = np.diff(g, prepend=g[:1])
    width, short = max(1, (int(steps.max()).bit_length() + 7) // 8), np.min_scalar_type(len(names))
    head = np.array([len(g), some.sum(), width, short.itemsize, g[0]], np.uint64)
    return b"".join((head.tobytes(), names[some].tobytes(), np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes(), (np.cumsum(some) - 1)[at].astype(short).tobytes()))


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places of their sets, sets); see _body."""
    n, sets, width, short, first = (int(x) for x in np.frombuffer(body, np.uint64, 5))
    names = np.frombuffer(body, np.int64, sets, 40)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(body, np.uint8, n * width, 40 + 8 * sets).reshape(n, width)
    at = np.frombuffer(body, f"u{short}", n, 40 + 8 * sets + n * width)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) + np.uint64(first), at.astype(np.uint32), names


def packed(sets: DataFrame, buckets: int) -> DataFrame:
    """(bucket, body, doc) of sets (of, grp, s, doc): hashes s of a set, which count as others in another group; and doc of each set that has any."""
    kinds = StructType().add("bucket", "integer").add("body", "binary").add("doc", sets.schema["doc"].dataType)
    edges = _edges(buckets)

    def pack(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        long = part.column("s").value_lengths().to_numpy(zero_copy_only=False)
        of, grp = (part.column(c).to_numpy(zero_copy_only=False) for c in ("of", "grp"))
        g = T._mixed(np.repeat(grp.view(np.uint64), long), part.column("s").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        place = np.searchsorted(edges, g[np.cumsum(long) - long], side="right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.nulls(len(of), pa.binary()), part.column("doc")], kinds.names)
        names, first = np.unique(of, return_index=True)  # of copies, one
        once = np.zeros(len(of), bool)
        once[first] = True
        g, at = g[np.repeat(once, long)], np.repeat(np.searchsorted(names, of[once]), long[once])
        order = np.argsort(g)
        g, at = g[order], at[order]
        cut = np.append(np.searchsorted(g, edges), len(g))
        for i in np.flatnonzero(np.diff(cut)):
            body = _body(g[cut[i] : cut[i + 1]], at[cut[i] : cut[i + 1]], names)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([body], pa.binary()), pa.nulls(1, part.column("doc").type)], kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column("s")), 0), 0))
            upto = np.cumsum(batch.column("s").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                before = int(upto[lo - 1]) if lo else 0
                hi = min(int(np.searchsorted(upto, before + CHUNK - n)) + 1, batch.num_rows)
                held.append(batch.slice(lo, hi - lo))
                n += int(upto[hi - 1]) - before
                lo = hi
                if n >= CHUNK:
                    yield from pack(_one(held))
                    held, n = [], 0
        if held:
            yield from pack(_one(held))

    return sets.select("of", "grp", "s", "doc").mapInArrow(run, kinds)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _classes(bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(of, c, df) of the hashes in packed rows of one bucket that two or more sets hold: set, class, number of sets."""
    parts, names, base = [], [], 0
    while bodies:
        g, at, own = _unpacked(bodies.pop())
        parts.append((g, at + np.uint32(base)))
        names.append(own)
        base += len(own)
    names = np.concatenate(names)
    lo, hi = int(min(g[0] for g, _ in parts)), int(max(g[-1] for g, _ in parts)) + 1
    ranges = math.ceil(sum(len(g) for g, _ in parts) / CHUNK)
    cuts = [(lo + (hi - lo) * i // ranges) for i in range(1, ranges)]
    places = [[0, *np.searchsorted(g, np.array(cuts, np.uint64)).tolist(), len(g)] for g, _ in parts]
    for i in range(ranges):
        g = np.concatenate([x[p[i] : p[i + 1]] for (x, _), p in zip(parts, places)])
        of = names[np.concatenate([x[p[i] : p[i + 1]] for (_, x), p in zip(parts, places)])]
        order = np.argsort(g, kind="stable")
        same = g[order[1:]] == g[order[:-1]]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
        g, of = g[order], of[order]
        order = np.lexsort((of, g))
        g, of = g[order], of[order]
        keep = np.concatenate([[True], (g[1:] != g[:-1]) | (of[1:] != of[:-1])]) if len(g) else np.zeros(0, bool)
        g, of = g[keep], of[keep]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
        if len(start):
            df = np.diff(np.append(start, len(g)))
            marks = np.bitwise_xor.reduceat(T._mixed(of.view(np.uint64), np.uint64(1)), start)
            c = T._mixed(marks, df.astype(np.uint64)).view(np.int64)
            held = np.repeat(df > 1, df)
            yield of[held], np.repeat(c, df)[held], np.repeat(df, df)[held]


def shared(dealt: DataFrame) -> DataFrame:
    """(of, c, df, w, doc) of packed rows, each bucket in one task: classes of shingles that the same df > 1 sets hold.

    w: how many shingles of the class the task has seen; so a set may have rows of a class from several tasks. Rows of
    documents go on as they are.
    """
    doc = dealt.schema["doc"]
    kinds = StructType().add("of", "long").add("c", "long").add("df", "integer").add("w", "integer").add(doc)
    names = kinds.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies, kind = [], None
        for batch in batches:
            body, doc = batch.column("body"), batch.column("doc")
            kind, told = doc.type, doc.is_valid()
            if told.true_count:
                some = doc.filter(told)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())] + [some], names)
            bodies += [x.as_py() for x in body.drop_null()]
        for found in _merged(_classes(bodies) if bodies else ()):
            for at in range(0, len(found[0]), 1 << 16):
                part = [pa.array(x[at : at + (1 << 16)], t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part, pa.nulls(len(part[0]), kind)], names)

    return dealt.mapInArrow(run, kinds)


def _merged(found) -> Iterator[tuple[np.ndarray, ...]]:
    """(of, c, df, w): rows of one set and class summed, by a bounded number of them at once."""

    def whole() -> tuple[np.ndarray, ...]:
        of, c, df = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((c, of))
        of, c, df = of[order], c[order], df[order]
        start = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (c[1:] != c[:-1])]))
        return of[start], c[start], df[start], np.diff(np.append(start, len(of)))

    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n >= 4 * CHUNK:
            yield whole()
            held, n = [], 0
    if n:
        yield whole()


class Members:
    """Sets of one or more cells, sorted by cell: (cell, of, n, classes c with weights w, tag)."""

    def __init__(self, rows: list[pa.RecordBatch]):
        self.rows = pa.Table.from_batches(rows).combine_chunks()
        column = lambda c: self.rows.column(c).combine_chunks()
        self.cell, self.of, self.n = (column(c).to_numpy() for c in ("cell", "a", "n"))
        self.tag = column("tag")
        entries = column("s")
        self.long = entries.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.long) - self.long
        c, self.w = (entries.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
        known, self.code = np.unique(c, return_inverse=True)
        self.codes = len(known)
        key = np.repeat(np.arange(len(self.n)), self.long) * self.codes + self.code
        self.keys = np.sort(key)
        name = T._mixed(self.cell.view(np.uint64), self.of.view(np.uint64))
        self.order = np.argsort(name)
        self.names = name[self.order]

    def places(self, cell: np.ndarray, of: np.ndarray) -> np.ndarray:
        return self.order[np.searchsorted(self.names, T._mixed(cell.view(np.uint64), of.view(np.uint64)))]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many shingles the sets at places x and y share: the weights of their common classes."""
        swap = self.long[x] > self.long[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        long = self.long[x]
        before = np.cumsum(long) - long
        at = np.arange(int(long.sum())) + np.repeat(self.start[x] - before, long)
        want = np.repeat(y * self.codes, long) + self.code[at]
        found = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.add.reduceat(np.where(self.keys[found] == want, self.w[at], 0), before)

    def last_cell(self) -> list[pa.RecordBatch]:
        return self.rows.slice(int(np.searchsorted(self.cell, self.cell[-1]))).to_batches()


def compared(rows: DataFrame, kinds: str, told: Callable[[Members, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """What told(members, x, y, common) gives of pairs (cell, a, b; role 1), whose sets (cell, a, n, s, tag; role 0) are in their cell.

    Cells are dealt whole; of each only its sets are held, its pairs stream past them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = None
        for batch in batches:
            is_pair = batch.column("role").to_numpy() == 1
            sets = batch.filter(pa.array(~is_pair))
            if sets.num_rows:
                members = Members([*(members.last_cell() if members else []), sets])
            pairs = batch.filter(pa.array(is_pair))
            if not pairs.num_rows:
                continue
            cell, a, b = (pairs.column(c).to_numpy() for c in ("cell", "a", "b"))
            x, y = members.places(cell, a), members.places(cell, b)
            upto = np.cumsum(np.minimum(members.long[x], members.long[y]))
            step = np.searchsorted(upto, np.arange(CHUNK, int(upto[-1]) + CHUNK, CHUNK))
            lo = 0
            for hi in np.unique(np.append(np.minimum(step + 1, len(x)), len(x))).tolist():
                yield told(members, x[lo:hi], y[lo:hi], members.common(x[lo:hi], y[lo:hi]))
                lo = hi

    return rows.repartition("cell").sortWithinPartitions("cell", "role", "a").mapInArrow(run, kinds)
