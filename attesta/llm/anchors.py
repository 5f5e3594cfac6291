"""Content-selected positions: the minimisers that every window of words has in common with its copies.

Of each window of `window` words, the anchor is its k-word gram with the smallest hash (the leftmost of equals). Equal
windows have equal anchors at equal offsets, so a window can only be repeated where its anchor's gram is, and only about
2 of window - k + 2 grams are anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import WordHashes, gram_hashes

LOW = np.uint64(28)


def owners(words: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-word gram, place of each window's anchor)."""
    grams = gram_hashes(words, k)
    if len(words) < window:
        return grams, np.zeros(0, np.int64)
    x = ((grams >> LOW) << LOW) | np.arange(len(grams), dtype=np.uint64)
    width, have = window - k + 1, 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    if width > have:
        x = np.minimum(x[: have - width], x[width - have :])
    return grams, (x & np.uint64((1 << 28) - 1)).astype(np.int64)


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed and return."""
    return text.encode("utf-8", "surrogatepass").split()


def anchor_rows(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(id, keys array<long>, places array<int>) of each text (id, text) that has a whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, keys, places, count = [], [], [], [0]
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams, own = owners(hashes.array(words_of(text)), window, k)
                if len(own):
                    own = np.unique(own)
                    ids.append(ident)
                    keys.append(grams[own].view(np.int64))
                    places.append(own.astype(np.int32))
                    count.append(count[-1] + len(own))
            at = pa.array(count, pa.int32())
            flat = lambda x, kind: pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if x else np.zeros(0, kind)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), flat(keys, np.int64), flat(places, np.int32)], ["id", "keys", "places"])

    return texts.mapInArrow(run, "id long, keys array<long>, places array<int>")


def entries(rows: DataFrame) -> DataFrame:
    """(key, id, place): one row per anchor."""
    return rows.select("id", F.explode(F.arrays_zip("keys", "places")).alias("a")).select(F.col("a.keys").alias("key"), "id", F.col("a.places").alias("place"))


def start_runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) of the runs of consecutive numbers in sorted distinct starts."""
    if not len(starts):
        return starts, starts
    cut_at = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], cut_at + 1])], starts[np.concatenate([cut_at, [len(starts) - 1]])]


def removed_digest(with_marks: DataFrame, window: int) -> DataFrame:
    """(id, text, runs array<struct<lo, hi>>) to (doc_id, n_words, n_removed, kept_sha256, spans); windows that start at lo to hi go.

    runs may be null. spans: `first:end` of each run of removed words, comma-joined.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                if runs:
                    step = np.zeros(len(words) + 1, np.int32)
                    np.add.at(step, [r["lo"] for r in runs], 1)
                    np.add.at(step, [r["hi"] + window for r in runs], -1)
                    gone = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans = ",".join(f"{a}:{b}" for a, b in edge.reshape(-1, 2))
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    spans, kept = "", words
                out.append((ident, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), spans))
            if out:
                c = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return with_marks.select("id", "text", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans string")


