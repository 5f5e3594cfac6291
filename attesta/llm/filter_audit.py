"""How five filters of documents interact: what each removes in every order, alone, or for want of an earlier one.

Duplicates are found by partition refinement. All documents begin in one class per length in code points; round by round
a class is split by the hash of its texts' next block of bytes, each eight times as long as the one before, and documents
alone in their class leave. Only lengths and hashes take part in the rounds, and classes are counted before they are
shuffled, so that a class may hold any share of the rows. What is left is then compared as whole texts: a bitmap of fixed
size names the surviving classes, so that no other text is shuffled, and each distinct text keeps its smallest id. Every
other id is marked.

The five failures of a document are one number, a mask. Masks are counted by part and label; all orders of the filters
follow from these counts, of which there are at most 128 to a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import cut, drop_cut

FILTERS = "ABCDE"
FIRST, GROWTH = 256, 8  # bytes of the first block, and how much longer each next is
BITMAP = 32_768  # bits of one row of a bitmap
CAPITALS, MARKS = bytes(range(65, 91)), b"#$%&*|"


def block_hashes(data: bytes) -> list[int]:
    """64-bit hashes of successive blocks; an empty text has none."""
    out, at, size = [], 0, FIRST
    while at < len(data):
        out.append(xxhash.xxh3_64_intdigest(data[at : at + size]) - (1 << 63))
        at, size = at + size, size * GROWTH
    return out


def failures(text: str, data: bytes) -> int:
    """The mask of failures A (short), B (repetitive), C (capitals) and D (marks) of a text and its bytes."""
    words = data.split()
    short = len(words) < 100
    repetitive = 100 * len(set(words)) < 80 * len(words)
    capitals = 100 * (len(data) - len(data.translate(None, CAPITALS))) > 10 * len(text)
    marks = len(data.translate(None, MARKS)) < len(data)
    return short + 2 * repetitive + 4 * capitals + 8 * marks


def described(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, n_chars, blocks) of each row; null texts and parts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, lengths, blocks = [], [], []
            for text in batch.column(2):
                text = text.as_py()
                data = text.encode("utf-8", "surrogatepass")
                masks.append(failures(text, data))
                lengths.append(len(text))
                blocks.append(block_hashes(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(lengths, pa.int64()), pa.array(blocks, pa.list_(pa.int64()))], ["id", "part", "mask", "n_chars", "blocks"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((part_col, "part"), (text_col, "text"))))
    return rows.mapInArrow(run, "id long, part string, mask int, n_chars long, blocks array<long>")


def _classed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, n_chars, blocks), as described() has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            blocks = [block_hashes(t.as_py().encode("utf-8", "surrogatepass")) for t in texts]
            lengths = pa.array([len(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, lengths, pa.array(blocks, pa.list_(pa.int64()))], ["id", "text", "n_chars", "blocks"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, text string, n_chars long, blocks array<long>")


def refined(rows: DataFrame) -> DataFrame:
    """(id, part, mask, key) of the rows of described() that are alone in no class; equal texts have equal keys.

    Two files at a time: what a round leaves, and its classes of more than one row. Both sides of each join are plain
    files, so that Spark broadcasts the classes where they are small and splits a hot class where they are not.
    """
    open_, done, k = rows.withColumn("key", F.xxhash64("n_chars")), None, 0
    while True:
        classes = cut(open_.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "classes")
        left = cut(open_.join(classes, "key", "left_semi"), "left")
        drop_cut(classes)
        ended = left.filter(F.size("blocks") <= k).select("id", "part", "mask", "key")
        done = ended if done is None else done.unionByName(ended)
        open_ = left.filter(F.size("blocks") > k).withColumn("key", F.xxhash64("key", F.get("blocks", F.lit(k))))
        if open_.isEmpty():
            return done
        k += 1


def _class_bits(keys: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): a set bit for each key, of `bits` in all; at most bits / 32768 rows of 4 KB."""
    at = F.pmod("key", F.lit(bits))
    return keys.select((at / BITMAP).cast("long").alias("bucket"), (at % BITMAP).alias("bit")).groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def duplicates(docs: DataFrame, rows: DataFrame, *, bits: int = 1 << 27, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, mask) of the rows whose text a row of a smaller id has, whole text by whole text.

    rows: described(docs), written down. Null ids are neither marked nor do they mark others; rows of one id and text
    are all marked or all not. bits bounds what is broadcast (bits / 8 bytes); more classes than bits cost only texts
    shuffled in vain.
    """
    kept = cut(refined(rows), "survivors")
    bitmap = F.broadcast(cut(_class_bits(kept, bits), "bits"))  # at most bits / 8 bytes
    texts = _classed_texts(docs, id_col, text_col).select("id", "text", F.aggregate("blocks", F.xxhash64("n_chars"), lambda key, block: F.xxhash64(key, block)).alias("key"))
    at = F.pmod("key", F.lit(bits))
    texts = texts.withColumn("bucket", (at / BITMAP).cast("long")).withColumn("bit", (at % BITMAP).cast("int"))
    is_set = F.expr("(cast(conv(hex(substring(bitmap, bit div 8 + 1, 1)), 16, 10) as int) & shiftleft(1, bit % 8)) <> 0")
    compared = texts.join(bitmap, "bucket").filter(is_set)
    firsts = cut(compared.groupBy("key", "text").agg(F.min("id").alias("id")).select("key", "id"), "firsts")
    return kept.filter("id is not null").join(firsts, ["key", "id"], "left_anti").select("id", "part", "mask")


def _orders(spark) -> DataFrame:
    """(own, before, filter_order, step): 600 rows."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            rows.append((own, before, "".join(order), step))
            before |= own
    return spark.createDataFrame(rows, "own int, before int, filter_order string, step int")


def audited(cells: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, good, toxic, n)."""
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    hit = lambda bits: F.col("mask").bitwiseAND(bits) != 0
    own, before = F.col("own"), F.col("before")
    spread = cells.withColumn("own", F.explode(F.array(*(F.lit(1 << i) for i in range(5))))).withColumn("before", F.explode(F.sequence(F.lit(0), F.lit(31)))).filter(before.bitwiseAND(own) == 0)
    here: Column = ~hit(before) & hit(own)
    steps = spread.groupBy("part", "own", "before").agg(
        total(~hit(before.bitwiseOR(own))).alias("kept"),
        total(here).alias("removed"),
        total(hit(before) & hit(own)).alias("redundant"),
        total(F.col("mask") == own).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"),
        total(here & F.col("toxic")).alias("toxic_lost"),
    )
    ways = F.array(*(F.lit(factorial(k) * factorial(4 - k)) for k in range(5)))  # orders in which k given filters come first
    shapley = F.sum(F.col("removed") * F.get(ways, F.bit_count("before"))).over(Window.partitionBy("part", "own"))
    told = steps.withColumn("shapley", shapley.cast("long")).join(F.broadcast(_orders(cells.sparkSession)), ["own", "before"])
    return told.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, *, bits: int = 1 << 27, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The interaction of the filters A to E over docs, by part: 600 rows for each value of part_col.

    labels: (doc_id, quality, toxic); an id with several rows is good, or toxic, if any of them says so. Null texts and
    parts are empty. Every row of docs counts, also rows of null or repeated ids. An empty table gives no rows. Other
    columns, whatever their names, are ignored.
    """
    rows = cut(described(docs, id_col=id_col, text_col=text_col, part_col=part_col), "described")
    again = duplicates(docs, rows, bits=bits, id_col=id_col, text_col=text_col)
    moved = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.lit(-1).alias("n")), F.struct((F.col("mask") + 16).alias("m"), F.lit(1).alias("n"))))
    moves = again.select("id", "part", moved.alias("x")).select("id", "part", F.col("x.m").alias("mask"), F.col("x.n").alias("n"))  # from the mask without E to the one with it
    told = cut(labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")), "labels")
    each = rows.select("id", "part", "mask", F.lit(1).alias("n")).unionByName(moves).join(told, "id", "left")
    cells = each.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))
    return audited(cells)


SQL = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS t FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
m AS (SELECT part, coalesce(q, false) AS q, coalesce(t, false) AS t,
  (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x))::INT
  + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY x), false)::INT AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, q, t, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prior FROM o, unnest(range(1, 6)) r(step)),
r AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN mask & (prior | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & prior = 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & prior <> 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN q AND mask & prior = 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN t AND mask & prior = 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
