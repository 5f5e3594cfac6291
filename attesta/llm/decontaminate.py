"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

If a text holds an item of m bytes with at most e edits, the two share at least m - q + 1 - q*e of the item's q-grams on
diagonals (text place less item place) that differ by at most 2e. So shared q-grams are counted in overlapping bands of
diagonals; bands that reach the bound are aligned within the band, the text's ends being free, and an item is found
where the alignment needs at most e edits.

Items travel to every task in blocks of at most `block_bytes`; a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import texts_of

Q = 8
SLICE = 2_000_000
PAIRS = 2_000_000  # of grams of a text and of items: more are counted without listing them
TABLE_BITS = 22


def normalise(text: str) -> bytes:
    """Lower-case A-Z; every run of white space, and byte 0, becomes one space."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().replace(b"\0", b" ").split())


def grams(data: np.ndarray) -> np.ndarray:
    """The 8-byte grams of data, each as one integer."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16) | two[2:]
    return four[:-4].astype(np.uint64) << np.uint64(32) | four[4:]


def budget(size: int, rate: float) -> int:
    """Edits allowed in an item of `size` bytes: the rate, but few enough for the lemma to ask for a shared gram."""
    return max(0, min(int(rate * size), (size - Q) // Q))


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> int:
    """The fewest edits of item against any part of text on diagonals low to high; more than `most` where it takes more."""
    width = high - low + 1
    steps = np.arange(width)
    best = np.zeros(width, np.int64)
    padded = np.full(len(item) + width + 1, -1, np.int16)
    a, b = max(0, low), min(len(text), low + len(item) + width)
    if b > a:
        padded[a - low : b - low] = text[a:b]
    for i in range(len(item)):
        near = best + (padded[i : i + width] != item[i])
        np.minimum(near[:-1], best[1:] + 1, out=near[:-1])
        best = np.minimum.accumulate(near - steps) + steps
        if i % 8 == 7 and best.min() > most:  # edits never get fewer
            break
    return int(best.min())


class Items:
    """A block of the benchmark, ready for lookup."""

    def __init__(self, rows: list[tuple[int, bytes]], rate: float):
        self.short = [(i, b" " + x + b" ") for i, x in rows if 0 < len(x) < Q]
        rows = [(i, x) for i, x in rows if len(x) >= Q]
        self.ids = [i for i, _ in rows]
        self.data = [np.frombuffer(x, np.uint8) for _, x in rows]
        self.raw = [x for _, x in rows]
        self.edits = np.array([budget(len(x), rate) for x in self.raw], np.int64)
        self.need = np.array([max(1, len(x) - Q + 1 - Q * e) for x, e in zip(self.raw, self.edits.tolist())], np.int64)
        own = [grams(x) for x in self.data]
        every = np.concatenate(own) if own else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(own)), [len(g) for g in own])
        place = np.concatenate([np.arange(len(g)) for g in own]) if own else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.start = np.unique(every[order], return_index=True)
        self.stop = np.append(self.start[1:], len(every))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self._slot(self.grams)] = True

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.intp)

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(item id, edits, place of the best band's first shared gram) of each item in data, once per item."""
        padded = b" " + data + b" " if self.short else b""
        few = [(i, 0, at) for i, x in self.short if (at := padded.find(x)) >= 0]
        return sorted(few + self._long(data)) if few else self._long(data)

    def _long(self, data: bytes) -> list[tuple[int, int, int]]:
        text = np.frombuffer(data, np.uint8)
        g = grams(text)
        at = np.flatnonzero(self.table[self._slot(g)])
        if not len(at) or not len(self.grams):
            return []
        k = np.searchsorted(self.grams, g[at])
        k[k == len(self.grams)] = 0
        same = self.grams[k] == g[at]
        at, k = at[same], k[same]
        if not len(at):
            return []
        many = self.stop[k] - self.start[k]
        if many.sum() > PAIRS:
            return self._repetitive(data, text, at, k)
        hit = np.repeat(self.start[k] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        item = self.item[hit]
        likely = np.bincount(item, minlength=len(self.raw)) >= self.need  # a band can't have more than the whole text
        if not likely.any():
            return []
        keep = likely[item]
        hit, item, place = hit[keep], item[keep], np.repeat(at, many)[keep]
        diagonal = place - self.place[hit]
        step = 2 * self.edits[item] + 1
        band = np.floor_divide(diagonal, step)
        # a band holds two steps of diagonals, and bands overlap by one
        key = np.concatenate([band, band - 1]) + (1 << 33)
        both = np.concatenate([item, item]).astype(np.int64) << np.int64(35) | key
        # of an item's gram that a band has several times, one counts
        by = np.lexsort((np.concatenate([self.place[hit]] * 2), both))
        grams_of = np.concatenate([self.place[hit]] * 2)[by]
        once = np.ones(len(by), bool)
        once[1:] = (both[by[1:]] != both[by[:-1]]) | (grams_of[1:] != grams_of[:-1])
        by = by[once]
        found, first, count = np.unique(both[by], return_index=True, return_counts=True)
        first = by[first]
        which = found >> np.int64(35)
        enough = count >= self.need[which]
        return self._aligned(data, text, zip(which[enough].tolist(), ((found[enough] & ((1 << 35) - 1)) - (1 << 33)).tolist(), place[first[enough] % len(place)].tolist(), count[enough].tolist()))

    def _repetitive(self, data: bytes, text: np.ndarray, at: np.ndarray, k: np.ndarray) -> list[tuple[int, int, int]]:
        """The same where a text's and an item's grams meet in too many pairs to list: bands are counted gram by gram."""
        occurs = np.bincount(k, minlength=len(self.grams))
        entries = np.repeat(occurs, self.stop - self.start)
        likely = np.flatnonzero(np.bincount(self.item, weights=entries, minlength=len(self.raw)) >= self.need)
        order = np.argsort(k, kind="stable")
        ends = np.cumsum(occurs)
        of_gram = lambda g: at[order[ends[g] - occurs[g] : ends[g]]]
        out = []
        for i in likely.tolist():
            own = grams(self.data[i])
            step = 2 * int(self.edits[i]) + 1
            low = -(len(self.raw[i]) // step) - 3
            count, first = np.zeros(len(text) // step - low + 3, np.int32), np.full(len(text) // step - low + 3, -1, np.int64)
            for p, g in enumerate(np.searchsorted(self.grams, own).tolist()):
                if not occurs[g]:
                    continue
                places = of_gram(g)
                band = (places - p) // step - low
                new = np.flatnonzero(np.diff(band, prepend=-9))
                band, began = band[new], places[new]
                has = np.zeros(len(count), bool)
                for b in (band, band - 1):  # bands overlap by one
                    has[b] = True
                    unset = first[b] < 0
                    first[b[unset]] = began[unset]
                count += has
            some = np.flatnonzero(count >= self.need[i])
            out += zip([i] * len(some), (some + low).tolist(), first[some].tolist(), count[some].tolist())
        return self._aligned(data, text, out)

    def _aligned(self, data: bytes, text: np.ndarray, bands) -> list[tuple[int, int, int]]:
        """(item id, fewest edits, place) from (item, band, place, shared grams), verified by banded alignment."""
        out: dict[int, tuple[int, int, int]] = {}
        fewest: dict[int, int] = {}
        for i, b, at, _ in sorted(bands, key=lambda x: -x[3]):
            e = int(self.edits[i])
            if i not in fewest:
                fewest[i] = 0 if self.raw[i] in data else 1
            if i in out and out[i][1] <= fewest[i]:
                continue
            low, high = b * (2 * e + 1) - e, (b + 2) * (2 * e + 1) - 1 + e
            start, end = max(0, low), max(0, high + len(self.raw[i]))
            exact = data.find(self.raw[i], start, end)
            d = 0 if exact >= 0 else aligned(self.data[i].astype(np.int16), text, low, high, e)
            if d <= e and (i not in out or d < out[i][1]):
                out[i] = (self.ids[i], d, exact if exact >= 0 else at)
        return sorted(out.values())


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of about block_bytes; each is one bounded collect."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("item is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield [(r["item"], x) for r in part.collect() if (x := normalise(r["text"]))]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.1, block_bytes: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, place): each benchmark item that a document holds with at most `rate` edits per byte.

    Items of up to about 80 bytes allow fewer, as the lemma must ask for a shared gram: (bytes - 8) // 8 at most; see budget.
    place: the byte in the normalised text near which it begins. Items of fewer than eight normalised bytes are held where
    they stand as whole words, without edits. Null or empty texts hold nothing; null or empty items and rows without item
    id are held by nothing. A repeated item or row gives
    repeated rows only where ids differ or the document row is repeated. Other columns are ignored; empty tables give
    no rows.
    """
    texts = texts_of(docs, id_col, text_col)
    out = None
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, rate)
            for batch in batches:
                rows = [(d, *hit) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in items.find(normalise(text))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "edits", "place"])

        found = texts.mapInArrow(run, "doc_id long, item_id long, edits long, place long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, n_items, items, contaminated) of every document; items: their ids in order, comma-joined.

    Rows that share an id are one document; a null id is one too. See contaminated.
    """
    found = contaminated(docs, benchmark, id_col=id_col, **options)
    per = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("found"))
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"))
    rows = ids.join(per, ids["id"].eqNullSafe(per["doc_id"]), "left")
    n = F.coalesce(F.size("found"), F.lit(0)).cast("long")
    return rows.select(F.col("id").alias("doc_id"), F.when(F.col("found").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_items"), F.coalesce(F.array_join("found", ","), F.lit("")).alias("items"), F.col("found").isNotNull().alias("contaminated"))


def _holds(shared, rate: float):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(shared.value, rate)
        for column in batches:
            yield pd.Series([bool(t) and bool(items.find(normalise(t))) for t in column], dtype=bool)

    return F.pandas_udf(run, "boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.1, block_bytes: int = 16_000_000, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item. Nothing is shuffled. See contaminated."""
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        docs = docs.filter(~_holds(shared, rate)(F.col(f"`{text_col}`").cast("string")))
    return docs
