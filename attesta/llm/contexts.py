"""Repeated windows around places that begin with the same words: sorted contexts, compared with their neighbours.

A place is where a `gram` of words begins that other places have too. Its context is the words that follow the gram and,
nearest first, the words before it, as 64-bit hashes. Spark sorts the places by gram and by what follows: a sparse suffix
array. In a task, neighbours' common prefixes give for each length the runs of places that go on alike; the same places,
sorted by what is before them, give the runs that are alike to the left. A window with `a` words before the gram is the
same at places that share a run of `window - gram - a` words to the right and one of `a` words to the left; all but the
first of each such class are repeats. Two different words are taken for equal only if their 64-bit hashes are.

Places of one gram meet in one group. A group of more than `most` is dealt to several by (id, place); what is first in
its part then meets the other parts' firsts in a grouped minimum, which combines before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.anchors import owners, start_runs, words_of
from attesta.llm.common import WordHashes, cut, drop_cut, mix

CHUNK = 20_000
KIND = "key long, salt int, parts int, era int, id long, place int, n_after int, n_before int, after binary, before binary"


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary array with one value per row of 64-bit words, big-endian so that bytes sort as words do."""
    data = np.ascontiguousarray(rows.astype(">u8"))
    at = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(8 * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def contexts(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """(era, id, text, places array<struct<place, parts>>) to one row of KIND per place."""
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                found = [[] for _ in range(10)]
                for era, ident, text, places in zip(*(part.column(i).to_pylist() for i in range(4))):
                    words = hashes.array(words_of(text))
                    grams, _ = owners(words, window, gram)
                    at = np.array([p["place"] for p in places], np.int64)
                    parts = np.array([p["parts"] for p in places], np.int32)[at < len(grams)]
                    at = at[at < len(grams)]
                    wide = np.zeros(len(words) + 2 * reach, np.uint64)
                    wide[reach : reach + len(words)] = words
                    after = wide[(at + reach + gram)[:, None] + np.arange(reach)]
                    before = wide[(at + reach - 1)[:, None] - np.arange(reach)]
                    salt = mix(at.astype(np.uint64) + mix(np.array([ident], np.int64).view(np.uint64))) % parts.astype(np.uint64)
                    own = (grams[at].view(np.int64), salt.astype(np.int32), parts, np.full(len(at), era, np.int32), np.full(len(at), ident, np.int64), at.astype(np.int32), np.clip(len(words) - gram - at, 0, reach).astype(np.int32), np.clip(at, 0, reach).astype(np.int32), after, before)
                    for x, y in zip(found, own):
                        x.append(y)
                if found[0]:
                    cols = [np.concatenate(x) for x in found]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols[:8]), _binary(cols[8]), _binary(cols[9])], [x.split()[0] for x in KIND.split(", ")])

    return marked.select("era", "id", "text", "places").mapInArrow(run, KIND)


def _words(column: pa.ChunkedArray, reach: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(len(column), reach).astype(np.uint64)


def neighbour_prefix(x: np.ndarray, n: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each row of sorted x, how many leading words it shares with the row before; -1 where a group begins."""
    out = np.full(len(x), -1, np.int64)
    same = np.concatenate([x[1:] == x[:-1], np.zeros((max(0, len(x) - 1), 1), bool)], axis=1)
    out[1:] = np.minimum(same.argmin(axis=1), np.minimum(n[1:], n[:-1]))
    out[new] = -1
    return out


def window_hashes(x: np.ndarray, seed: int) -> np.ndarray:
    """The hash of each prefix, of 0 words and more, of each row."""
    out = np.empty((len(x), x.shape[1] + 1), np.uint64)
    out[:, 0] = seed
    for j in range(x.shape[1]):
        out[:, j + 1] = mix(out[:, j] * np.uint64(0x9E3779B97F4A7C15) + x[:, j] + np.uint64(1))
    return out


def judge(table: pa.Table, reach: int) -> pa.RecordBatch:
    """Of whole groups, sorted by (key, salt, after): (era, id, lo, hi, key, h, dealt).

    Runs of windows, by their starts, that repeat earlier ones of their group; and, dealt, the first of each class of
    windows, with its hash, of groups that are dealt in parts.
    """
    key, salt, parts, era, ids, place, n_after, n_before = (table.column(i).to_numpy() for i in range(8))
    after, before = _words(table.column(8), reach), _words(table.column(9), reach)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
    group = np.cumsum(new)
    right = neighbour_prefix(after, n_after, new)
    back = np.frombuffer(before.astype(">u8").tobytes(), f"S{8 * reach}")
    by_left = np.argsort(back, kind="stable")
    by_left = by_left[np.argsort(group[by_left], kind="stable")]
    left_new = np.ones(len(key), bool)
    left_new[1:] = group[by_left][1:] != group[by_left][:-1]
    left = neighbour_prefix(before[by_left], n_before[by_left], left_new)
    order = np.lexsort((place, ids, era))
    dealt = parts > 1
    hashes = (window_hashes(after, 11), window_hashes(before, 13)) if dealt.any() else None
    own, slot = np.unique(np.stack([era.astype(np.int64), ids]), axis=1, return_inverse=True)
    slot = slot.reshape(-1)
    copies = bool(((np.diff(place[order]) == 0) & (np.diff(slot[order]) == 0)).any())
    again, firsts = [], []
    side = np.empty(len(key), np.int64)
    for a in range(reach + 1):  # windows with a words before the gram
        side[by_left] = np.cumsum(left < a)
        has = order[(n_before[order] >= a) & (n_after[order] >= reach - a)]
        if not len(has):
            continue
        cls = (np.cumsum(right < reach - a) * np.int64(len(key) + 1) + side)[has]
        by = np.argsort(cls, kind="stable")
        first = np.ones(len(by), bool)
        first[1:] = cls[by[1:]] != cls[by[:-1]]
        again_ = ~first
        if copies:  # rows of one place, from rows of one id
            head = has[by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]]
            again_ &= (slot[has[by]] != slot[head]) | (place[has[by]] != place[head])
        rest = has[by[again_]]
        again.append(slot[rest] << np.int64(32) | place[rest] - a)
        if hashes is not None:
            f = has[by[first]]
            f = f[dealt[f]]
            h = mix(hashes[1][f, a] * np.uint64(0xD6E8FEB86659FD93) ^ hashes[0][f, reach - a]).view(np.int64)
            firsts.append((era[f], ids[f], place[f] - a, key[f], h))
    lo, hi = start_runs(np.unique(np.concatenate(again)) if again else np.zeros(0, np.int64))
    low, s = np.int64((1 << 32) - 1), lo >> np.int64(32)
    none = np.zeros(len(lo), np.int64)
    more = [np.concatenate(x) for x in zip(*firsts)] if firsts else [np.zeros(0, np.int64)] * 5
    cols = [(own[0][s], more[0]), (own[1][s], more[1]), (lo & low, more[2]), (hi & low, more[2]), (none, more[3]), (none, more[4])]
    kinds = [np.int32, np.int64, np.int32, np.int32, np.int64, np.int64]
    flat = [pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds)]
    return pa.RecordBatch.from_arrays([*flat, pa.array(np.arange(len(flat[0])) >= len(lo))], ["era", "id", "lo", "hi", "key", "h", "dealt"])


def _judged(rows: DataFrame, reach: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            key, salt = table.column(0).to_numpy(), table.column(1).to_numpy()
            open_ = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))  # the last group may go on
            end = int(open_[-1]) + 1 if len(open_) else 0
            if end:
                yield judge(table.slice(0, end), reach)
            held, n = table.slice(end).to_batches(), n - end
        if n:
            yield judge(pa.Table.from_batches(held), reach)

    return rows.mapInArrow(run, "era int, id long, lo int, hi int, key long, h long, dealt boolean")


def by_text(places: DataFrame) -> DataFrame:
    """(era, id, place, parts) to (era, id, places), written down: what led to the places needs no disk from here on."""
    return cut(places.groupBy("era", "id").agg(F.collect_set(F.struct("place", "parts")).alias("places")), "places")


def repeated_windows(texts: DataFrame, places: DataFrame, window: int, gram: int) -> DataFrame:
    """(era, id, runs): by their starts lo to hi, the windows that repeat one which begins earlier: a smaller era, id or start.

    texts: (era, id, text); places: from by_text, every place whose gram is repeated; its files end here.
    """
    rows = contexts(texts.join(places, ["era", "id"]), window, gram)
    sorted_ = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "after", "before")
    judged = cut(_judged(sorted_, window - gram), "judged")
    drop_cut(places)
    parts = judged.filter("dealt").select("era", "id", "lo", "hi", "key", "h")
    first = parts.groupBy("key", "h").agg(F.min(F.struct("era", "id", "lo")).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    first = cut(first, "firsts")  # written before the join, so that a hot group's rows are split there
    later = parts.join(first, ["key", "h"]).filter("f <> struct(era, id, lo)").select("era", "id", "lo", "hi")
    runs = judged.filter("not dealt").select("era", "id", "lo", "hi").unionByName(later)
    out = cut(runs.groupBy("era", "id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "runs")
    drop_cut(judged, first)
    return out
