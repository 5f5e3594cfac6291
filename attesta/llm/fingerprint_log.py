"""Incremental removal of repeated word windows with a log-structured fingerprint index.

The index is a list of immutable runs, each a table of (key, n) bucketed and sorted by the 64-bit fingerprint key of a
window's anchor (see anchors): one row per key, however many places have it. A new batch becomes a run; it is
merge-joined with the runs of its history, bucket by bucket and without a shuffle, to find the fingerprints that more
than one place has. Only those places are verified, by their sorted contexts (see contexts), and each window but the
first of equal ones is removed. Runs are compacted as in a binary counter: while the newest run has at least half the
batches of the one before it, the two are merge-joined into one, so that n batches leave about log2(n) runs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.anchors import anchor_rows, entries, removed_digest
from attesta.llm.common import cut, drop_cut, remove_files, scratch_dir, shuffles_freed, texts_of
from attesta.llm.contexts import by_text, repeated_windows


@dataclass
class FingerprintLog:
    """Runs of one corpus; every run has the same number of buckets. Their files are in the shared folder."""

    spark: SparkSession
    buckets: int
    window: int = 20
    gram: int = 10
    runs: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)  # the batches that each run holds

    def _path(self, run: str) -> str:
        return f"{scratch_dir(self.spark)}/attesta/{run}"

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        remove_files(self.spark, self._path(run), True)

    def _write(self, rows: DataFrame) -> str:
        """Save (key, n), grouped by key. Groups are dealt like buckets where there are as many of them as buckets."""
        name = f"attesta_run_{uuid.uuid4().hex}"
        with shuffles_freed(self.spark):
            rows.write.option("path", self._path(name)).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name

    def add(self, anchors: DataFrame) -> str:
        """Append the run of a batch's anchors (key, id, place); its name. Equal keys are counted before they are shuffled."""
        rows = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            rows = rows.repartition(self.buckets, "key")
        self.runs.append(self._write(rows))
        self.sizes.append(1)
        return self.runs[-1]

    def repeated(self, new: str) -> DataFrame:
        """(key, n), perhaps several times, of each fingerprint that the run `new` has twice, or once and its history too.

        n: how many places of the batch and of one run of the history have it.
        """
        batch = self.spark.table(new)
        found = batch.filter("n > 1")
        for run in self.runs[: self.runs.index(new)]:
            found = found.unionByName(batch.join(self.spark.table(run).withColumnRenamed("n", "had"), "key").select("key", (F.col("n") + F.col("had")).alias("n")))
        return found

    def compact(self) -> None:
        """Merge the newest runs while the last has at least half the batches of the one before. Frames that read them end here."""
        while len(self.runs) > 1 and 2 * self.sizes[-1] >= self.sizes[-2]:
            old, new = self.runs[-2:]
            a, b = self.spark.table(old), self.spark.table(new).withColumnRenamed("n", "m")
            both = a.join(b, "key", "full").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
            merged = self._write(both)
            self.runs[-2:], self.sizes[-2:] = [merged], [sum(self.sizes[-2:])]
            for run in (old, new):
                self._drop(run)

    def drop(self) -> None:
        for run in self.runs:
            self._drop(run)
        self.runs, self.sizes = [], []


def _parts(keys: DataFrame, most: int) -> DataFrame:
    return keys.groupBy("key").agg(F.ceil(F.max("n") / most).cast("int").alias("parts"))


def remove_from_batch(log: FingerprintLog, batch: DataFrame, history: DataFrame | None = None, *, most: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of a new batch's documents; the batch joins the log.

    A word of the batch goes if it is in a window that the history has, or that starts earlier in the batch. The log
    must hold the history's fingerprints, and history its documents, whose ids may be those of the batch too: of them
    only the ones that share a fingerprint with the batch are read for verification. Rows without id are returned as
    they are; see remove_repeats for the other cases.
    """
    window, gram = log.window, log.gram
    texts = texts_of(batch, id_col, text_col)
    eras = texts.filter("id is not null").withColumn("era", F.lit(1))
    rows = cut(anchor_rows(eras.select("id", "text"), window, gram), "anchors")
    keys = cut(_parts(log.repeated(log.add(entries(rows))), most), "repeated")
    log.compact()
    places = entries(rows).withColumn("era", F.lit(1))
    known = eras
    if history is not None:
        old = texts_of(history, id_col, text_col).filter("id is not null")
        known = known.unionByName(old.withColumn("era", F.lit(0)))
        places = places.unionByName(entries(anchor_rows(old, window, gram)).withColumn("era", F.lit(0)))
    held = by_text(places.join(keys, "key").select("era", "id", "place", "parts"))
    drop_cut(rows, keys)
    runs = repeated_windows(known, held, window, gram)
    marked = eras.join(runs.filter("era = 1").select("id", "runs"), "id", "left").select("id", "text", "runs")
    out = cut(removed_digest(marked.unionByName(texts.filter("id is null"), allowMissingColumns=True), window), "removed")
    drop_cut(runs)
    return out


def remove_repeats(docs: DataFrame, *, window: int = 20, gram: int = 10, batches: int = 4, buckets: int | None = None, most: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of each document, taken in `batches` batches in order of id.

    A word goes if it is in a window of `window` words that also starts earlier (smaller id, or the same document and
    an earlier start); windows are judged on the input, so the places that the index finds are verified in one pass at
    the end. Null or empty texts have no words. Rows without id are returned as they are: nothing is removed from them
    or because of them. Rows that share an id count as copies of one place, so nothing is removed because of each
    other. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col)
    known = texts.filter("id is not null")
    log = FingerprintLog(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), window, gram)
    rows = cut(anchor_rows(known, window, gram), "anchors")
    edges = known.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    found = []
    for lo, hi in zip([None, *edges], [*edges, None]):
        part = rows if lo is None else rows.filter(F.col("id") > lo)
        new = log.add(entries(part if hi is None else part.filter(F.col("id") <= hi)))
        found.append(cut(log.repeated(new), "repeated"))
        log.compact()
    log.drop()
    keys = found[0]
    for more in found[1:]:
        keys = keys.unionByName(more)
    keys = cut(_parts(keys, most), "keys")  # plain files on both sides of the join below, so that hot keys are split
    places = by_text(entries(rows).join(keys, "key").select(F.lit(0).alias("era"), "id", "place", "parts"))
    drop_cut(rows, keys, *found)
    runs = repeated_windows(known.select(F.lit(0).alias("era"), "id", "text"), places, window, gram)
    marked = known.join(runs.select("id", "runs"), "id", "left").unionByName(texts.filter("id is null"), allowMissingColumns=True)
    return removed_digest(marked, window)
