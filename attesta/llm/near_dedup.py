"""Near-duplicate documents by b-bit MinHash.

Each document's distinct word shingles give `bands * rows` minima. Whole minima make the band keys; of each minimum
only two low bits are retained, packed into 64-bit words, and the similarity of two documents is estimated from the
count of equal bit pairs, corrected for chance collisions. Pairs whose estimate is far below the threshold go; the
others are confirmed on their full shingle sets.

Plan: documents with equal sets fold into one; each band bucket links its members to its smallest member (a star, never
all pairs); the links are confirmed; buckets that still hold several components are searched further - small ones by
joining members of different components, large ones in blocks whose tasks compare packed signatures and confirm on the
full sets while they merge. Nothing is capped: every pair that shares a band and isn't already in one component is
judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import WordHashes, cut, gram_hashes, mix, texts_of
from attesta.llm.components import components

BITS = 2
SMALL_BUCKET = 48
BLOCK_DOCS = 256
BLOCK_CHARS = 16_000_000


def shingle_set(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, an empty one none."""
    words = hashes.array(text.encode("utf-8", "surrogatepass").lower().split())
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words, min(n, len(words))))


def family(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of `size` hash functions on 32-bit integers."""
    r = np.random.default_rng(seed)
    return r.integers(0, 2**31, size, np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, size, np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(best, (x[i : i + 2048, None] * a + b).min(axis=0), out=best)
    return best


def pack(low: np.ndarray) -> np.ndarray:
    """Two low bits of each minimum, 32 to a 64-bit word."""
    two = ((low >> np.uint32(3)) & np.uint32(3)).astype(np.uint64).reshape(-1, 32)
    return (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)


def features(n: int, bands: int, rows: int, seed: int):
    """For mapInArrow: (id, text) to (id, n, set_a, set_b, sig, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), family(bands * rows, seed)
        salt = np.random.default_rng(seed + 1).integers(0, 2**63, (bands, rows), np.uint64) | np.uint64(1)
        step = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            count, sets, sigs, keys, parts = [], [], [], [], []
            for text in texts:
                s = shingle_set(text, n, hashes)
                count.append(len(s))
                whole = xxhash.xxh3_128_digest(s.tobytes())
                sets.append(whole)
                parts.append(len(s) > 0)
                if len(s):
                    low = minima(s, a, b)
                    sigs.append(pack(low))
                    keys.append(mix((low.reshape(bands, rows).astype(np.uint64) * salt).sum(axis=1, dtype=np.uint64) + step))
            two = np.frombuffer(b"".join(sets), np.int64).reshape(-1, 2)
            has = np.array(parts, bool)
            words = bands * rows // 32
            flat = lambda x, k: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * k)]).astype(np.int32)), pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(count, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), flat(sigs, words), flat(keys, bands)], ["id", "n", "set_a", "set_b", "sig", "bands"])

    return run


def estimate(x: Column, y: Column, size: int) -> Column:
    """Similarity from two packed signatures: the share of equal bit pairs, less what chance would make equal."""
    apart = F.aggregate(
        F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q).bitwiseOR(F.shiftrightunsigned(p.bitwiseXOR(q), 1)).bitwiseAND(F.lit(0x5555555555555555)))),
        F.lit(0).cast("int"),
        lambda s, c: s + c,
    )
    return (1 - apart / F.lit(size) - F.lit(0.5**BITS)) / F.lit(1 - 0.5**BITS)


def confirm(n: int, num: int, den: int):
    """For mapInArrow: pairs with both texts to the pairs that are linked on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keep, last = [], (None, None)
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p = last[1] if last[0] == x else shingle_set(x, n, hashes)
                last = (x, p)
                q = shingle_set(y, n, hashes)
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(same > 0 and den * same >= num * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (batch.column(0), batch.column(1))], ["u", "v"])

    return run


def confirmed(pairs: DataFrame, some: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of pairs (u, v), those linked on full sets; some: the texts of all documents that pairs can have."""
    left = some.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    right = some.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
    return pairs.join(left, "v").join(right, "u").select("u", "v", "text_u", "text_v").mapInArrow(confirm(n, num, den), "u long, v long")


def merge_blocks(n: int, num: int, den: int, size: int, low: float):
    """For applyInPandas: one pair of blocks of a large group; emits links that join different components."""

    def run(pdf):
        hashes = WordHashes()
        ids, comp = pdf["id"].to_numpy(), pdf["comp"].to_numpy()
        sig = np.stack(pdf["sig"].to_numpy()).astype(np.int64).view(np.uint64)
        first = (pdf["block"] == pdf["b1"]).to_numpy()
        second = (pdf["block"] == pdf["b2"]).to_numpy()
        left, right = np.flatnonzero(first), np.flatnonzero(second)
        found, parent, sets = [], {}, {}

        def root(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        def of(i):
            if i not in sets:
                sets[i] = shingle_set(pdf["text"].iat[i], n, hashes)
            return sets[i]

        for i in left:
            x = sig[right] ^ sig[i]
            apart = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
            est = (1 - apart / size - 0.5**BITS) / (1 - 0.5**BITS)
            near = np.flatnonzero((est >= low) & (comp[right] != comp[i]))
            for k in near[np.argsort(-est[near], kind="stable")]:
                j = right[k]
                a, b = root(comp[i]), root(comp[j])
                if a == b:
                    continue
                p, q = of(i), of(j)
                same = len(np.intersect1d(p, q, assume_unique=True))
                if den * same >= num * (len(p) + len(q) - same):
                    parent[max(a, b)] = min(a, b)
                    found.append((ids[i], ids[j]))
        return type(pdf)(found, columns=["u", "v"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5, bands: int = 32, rows: int = 5, seed: int = 7) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked at similarity num/den or more, by component.

    Lower-cases A-Z; words are runs of bytes other than space, tab, line feed, vertical tab, form feed and return.
    Null or empty texts have no shingles, are linked with nothing and kept. Rows without id are linked with nothing,
    kept, and have no component. Repeated rows of one id get one row each, in one component. Columns other than the id
    and the text are ignored. An empty table gives no rows.
    """
    size = bands * rows
    low = num / den - 4.5 * ((num / den * (1 - num / den) + 0.25) / size) ** 0.5 / (1 - 0.5**BITS)
    texts = texts_of(docs, id_col, text_col)
    feat = cut(texts.mapInArrow(features(shingle, bands, rows, seed), "id long, n long, set_a long, set_b long, sig array<long>, bands array<long>"), "minhash")
    linked = feat.filter("n > 0 and id is not null")
    sets = cut(linked.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")), "sets")
    copies = linked.select("id", "set_a", "set_b").join(sets.filter("c > 1"), ["set_a", "set_b"]).filter("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    reps = linked.join(sets.select(F.col("rep").alias("id"), "set_a", "set_b"), ["id", "set_a", "set_b"], "left_semi")
    sigs = reps.select("id", "sig")
    keys = reps.select("id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top"), F.count(F.lit(1)).alias("c")).filter("top <> pivot")
    members = cut(keys.join(buckets.select("key", "pivot", "c"), "key"), "members")

    # The one time that texts are shuffled; merged at every size, so that the cost follows the input.
    candidates = cut(texts.join(members.select("id").distinct().hint("merge"), "id", "left_semi"), "candidates")

    def promising(pairs: DataFrame) -> DataFrame:
        own = sigs.select(F.col("id").alias("u"), F.col("sig").alias("sig_u"))
        other = sigs.select(F.col("id").alias("v"), F.col("sig").alias("sig_v"))
        return cut(pairs.join(own, "u").join(other, "v").filter(estimate(F.col("sig_u"), F.col("sig_v"), size) >= low).select("u", "v"), "pairs")

    star = members.filter("id <> pivot").select(F.col("pivot").alias("u"), F.col("id").alias("v")).distinct()
    tried = promising(star)
    links = cut(confirmed(tried, candidates, shingle, num, den), "links")
    first = components(links)
    # Buckets that still hold several components.
    now = members.join(first, "id", "left").select("key", "id", "c", F.coalesce("component", "id").alias("comp"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("head")).filter("lo <> hi").select("key", "head")
    rest = cut(now.join(mixed, "key"), "mixed")
    small = rest.filter(F.col("c") <= SMALL_BUCKET)
    other = small.select("key", F.col("id").alias("v"), F.col("comp").alias("comp_v"))
    pairs = small.select("key", F.col("id").alias("u"), "comp").join(other, "key").filter("u < v and comp <> comp_v").select("u", "v").distinct()
    more = promising(pairs.join(tried, ["u", "v"], "left_anti"))
    links = links.unionByName(cut(confirmed(more, candidates, shingle, num, den), "links"))
    large = rest.filter(F.col("c") > SMALL_BUCKET)
    if large.limit(1).count():
        links = links.unionByName(_large_groups(large, candidates, sigs, shingle, num, den, size, low))
    found = components(links.unionByName(copies))
    out = feat.select("id", "n").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id").isNull() | (F.col("id") == F.col("component"))).alias("kept"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, one of each component: that of the smallest id.

    Of rows that share an id and have equal shingle sets one stays, the first by text and then by all columns; rows that
    share an id and have different sets all stay or go. Rows without id all stay. See near_duplicates.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    ids = found.filter("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    known = docs.filter(F.col(f"`{id_col}`").isNotNull())
    kept = known.join(ids, known[id_col].cast("long") == ids["__id"], "left_semi")
    n = options.get("shingle", 5)

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        hashes = WordHashes()
        return texts.map(lambda t: "" if t is None else xxhash.xxh3_128_hexdigest(shingle_set(t, n, hashes).tobytes()))

    rows = kept.withColumn("__c", F.count(F.lit(1)).over(Window.partitionBy(F.col(f"`{id_col}`"))))
    some = lambda x: F.when(F.col("__c") > 1, x)
    rows = rows.withColumns({"__set": digest(some(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))), "__all": some(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))})
    place = F.row_number().over(Window.partitionBy(F.col(f"`{id_col}`"), "__set").orderBy(F.col(f"`{text_col}`"), "__all"))
    kept = rows.withColumn("__place", place).filter("__place = 1").select(*(F.col(f"`{c}`") for c in docs.columns))
    return kept.unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))


def _large_groups(large: DataFrame, texts: DataFrame, sigs: DataFrame, n: int, num: int, den: int, size: int, low: float) -> DataFrame:
    """Links between components that meet in large buckets: overlapping buckets make one group, compared block by block."""
    groups = components(large.select(F.col("id").alias("u"), F.col("head").alias("v")))
    ids = large.select("id", "comp").distinct().join(groups, "id", "left").withColumn("grp", F.coalesce("component", "id"))
    rows = cut(ids.join(sigs, "id").join(texts, "id").select("grp", "id", "comp", "sig", "text"), "large")
    count = rows.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum(F.length("text")) / BLOCK_CHARS)).cast("int").alias("blocks"))
    dealt = rows.join(count, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("grp", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "id", "comp", "sig", "text")
    return cut(dealt.groupBy("grp", "b1", "b2").applyInPandas(merge_blocks(n, num, den, size, low), "u long, v long"), "links")
