"""Similar texts, vectors and names, by joins on what they share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators.shingle_sets import Members, bucket_count, compared, packed, shared
from attesta.streaming.events import gone, written


def shared_elsewhere(rows: DataFrame, digest: str, owner: str) -> DataFrame:
    """Digests that rows of two or more owners have."""
    return rows.groupBy(digest).agg(F.min(owner).alias("__lo"), F.max(owner).alias("__hi")).filter("__lo <> __hi").select(digest)


def containment_pairs(rows: DataFrame, key: str, within: str, text: str, least: float = 0.6, size: int = 4) -> DataFrame:
    """(a, b, similarity) of two keys within a group whose shingles overlap by `least` of the smaller set, rounded to four places.

    Of keys with equal sets only the smallest is compared; the others are paired with it alone. Rows without key, group or
    words pair with nothing. How sets are compared: see _alike_sets.
    """
    stated = rows.filter(F.col(key).isNotNull() & F.col(within).isNotNull())
    found = _found(stated, {"k": F.col(key)}, within, text, size)
    docs = _kept(_docs(found).select("of", "n", "k"))
    sets = _kept(docs.groupBy("of").agg(F.min("n").alias("n"), F.min("k").alias("tag")))
    lists = _lists(found, sets)
    gone(found)
    kind = rows.schema[key].dataType.simpleString()

    def told(members: Members, x: np.ndarray, y: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
        n = np.minimum(members.n[x], members.n[y])
        return pa.RecordBatch.from_arrays([members.tag.take(pa.array(x)), members.tag.take(pa.array(y)), pa.array(common, pa.int64()), pa.array(n, pa.int32())], ["x", "y", "common", "n"])

    met = _alike_sets(lists, least, f"x {kind}, y {kind}, common long, n int", told).filter("x <> y")
    alike = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round(F.col("common") / F.col("n"), 4).alias("similarity")).filter(F.col("similarity") >= least)
    copies = docs.join(sets.select("of", F.col("tag").alias("a")), "of").filter("k <> a").select("a", F.col("k").alias("b"), F.lit(1.0).alias("similarity"))
    return alike.unionByName(copies)


def _kept(rows: DataFrame, batch: int | None = None) -> DataFrame:
    """rows, written; what was shuffled for them is removed as soon as they are. batch: how many rows go to a Python worker at once."""
    conf = rows.sparkSession.conf
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)} if batch else {})
    before = {name: conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            conf.set(name, value)
        return written(rows)
    finally:
        for name, value in before.items():
            if value is None:
                conf.unset(name)
            else:
                conf.set(name, value)


def _found(rows: DataFrame, doc: dict[str, Column], within: str, text: str, size: int = 4) -> DataFrame:
    """(of, c, df, w, doc), written: what the sets of rows' shingles share, see shingle_sets.shared, and (of, n, *doc) of each row with words.

    Texts are split once, and each shingle is shuffled once, packed with others; neither texts nor whole sets are written.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = bucket_count(rows.agg(F.sum(F.length(text))).first()[0] or 0, parts)
    hashed = rows.select(*(c.alias(name) for name, c in doc.items()), F.xxhash64(within).alias("grp"), T.shingle_hashes(T.words(F.col(text)), size).alias("s"))
    sets = hashed.select(F.xxhash64("grp", "s").alias("of"), "grp", *doc, F.size("s").alias("n"), "s")
    dealt = packed(sets.select("of", "grp", "s", F.struct("of", "n", *doc).alias("doc")), buckets).repartitionById(buckets, F.col("bucket"))
    return _kept(shared(dealt), 1000)  # lists of whole texts' words


def _docs(found: DataFrame) -> DataFrame:
    return found.filter("doc is not null").select("doc.*")


def _lists(found: DataFrame, sets: DataFrame) -> DataFrame:
    """(of, s, n, tag), written: each set's classes s of shared shingles, with their weights and how many shingles come from each on.

    Sets (of, n, tag) without such are left out.
    """
    classes = found.filter("c is not null").select("of", "c", "df", "w").repartition("of").groupBy("of", "c", "df").agg(F.sum("w").cast("int").alias("w"))
    own = Window.partitionBy("of")
    upto = F.sum("w").over(own.orderBy("df", "c").rowsBetween(Window.unboundedPreceding, 0))
    after = F.sum("w").over(own) - upto + F.col("w")
    held = classes.select("of", "c", "w", after.cast("int").alias("after"))
    return _kept(held.groupBy("of").agg(F.collect_list(F.struct("c", "w", "after")).alias("s")).join(sets, "of"))


def _alike_sets(lists: DataFrame, least: float, kinds: str, told: Callable[..., pa.RecordBatch], most: int = 1_000_000) -> DataFrame:
    """What told gives, see shingle_sets.compared, of all pairs of sets that may overlap by `least` of the smaller; written, and lists removed.

    Shingles that the same sets hold (all those of a shared passage) are one class, known by the exclusive or of its sets'
    hashes and their number, and counted by its weight; so texts meet once per passage, not once per shingle. In any one
    order of all classes, of a set of n shingles whose partner is no smaller, the first shared one starts within the first
    n - ceil(least * n) + 1 (prefix filter), and as many as are needed are still to come in the partner's set, too
    (positional filter). The order is by how many sets have a class, so that few meet; shingles of one set alone come first
    and meet nothing.

    A set is labelled by its largest partner, which near copies mostly have in common, and pairs are compared in cells, one
    for each label of the larger set; so a set is sent once to a cell, not once to each partner, and large sets go to one cell
    only. Cells whose sets have more than `most` classes are split into blocks, so that a task holds no more than about that.
    """
    held = _kept(lists.select("of", "n", F.explode("s").alias("e")).select("of", "n", "e.c", "e.after"))
    need = F.ceil(F.col("n") * (least - 0.00005) - 1e-9)  # what is rounded to `least` is enough
    probes = held.filter(F.col("after") >= need)
    other = held.select("c", F.col("of").alias("of2"), F.col("n").alias("n2"), F.col("after").alias("after2"))
    first = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("of") < F.col("of2")))
    met = probes.join(other, "c").filter(first & (F.col("after2") >= need))
    pairs = _kept(met.select(F.col("of").alias("a"), F.col("of2").alias("b"), "n2").distinct())
    gone(held)

    tops = _kept(pairs.groupBy(F.col("a").alias("of")).agg(F.max(F.struct("n2", "b"))["b"].alias("top")))
    labelled = _kept(pairs.join(tops, F.col("b") == F.col("of"), "left").select(F.coalesce("top", "b").alias("label"), "a", "b"))
    gone(pairs, tops)
    of = F.explode(F.array("a", "b")).alias("of")
    sizes = labelled.select("label", of).distinct().join(lists.select("of", F.size("s").alias("m")), "of").groupBy("label").agg(F.sum("m").alias("m"))
    split = _kept(sizes.filter(F.col("m") > most).select("label", F.ceil(F.col("m") / most).alias("m")))
    parts = F.coalesce("m", F.lit(1).cast("long"))
    dealt = labelled.join(F.broadcast(split), "label", "left").select(F.xxhash64("label", F.pmod("a", parts), F.pmod("b", parts)).alias("cell"), "a", "b")

    members = dealt.select("cell", of).distinct().join(lists, "of")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("n", "int"), ("s", "array<struct<c:bigint,w:int>>"), ("tag", lists.schema["tag"].dataType))]
    sets = members.select("cell", F.lit(0).alias("role"), F.col("of").alias("a"), F.lit(0).cast("long").alias("b"), "n", F.transform("s", lambda x: F.struct(x["c"].alias("c"), x["w"].alias("w"))).alias("s"), "tag")
    result = _kept(compared(sets.unionByName(dealt.select("cell", F.lit(1).alias("role"), "a", "b", *nothing)), kinds, told))
    gone(lists, labelled, split)
    return result


def anchored_groups(rows: DataFrame, key: str, owner: str, text: str, day: str, days: int = 7, least: float = 0.6) -> DataFrame:
    """(key, n): of each dated row, how many rows of its owner, itself included, are alike and come 0 to days - 1 days later.

    Alike: as in containment_pairs. Each distinct set of an owner's shingles is compared once, whatever its days, and takes
    its rows' count by day along; so pairs become counts by set and day where they are compared. Rows without day, owner or
    words are left out.
    """
    stated = rows.filter(F.col(owner).isNotNull() & F.col(day).isNotNull())
    found = _found(stated, {"k": F.col(key), "d": F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))}, owner, text)
    counts = _docs(found).groupBy("of", "d").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("m"))
    sets = _kept(counts.groupBy("of").agg(F.min("n").alias("n"), F.collect_list(F.struct("d", "m")).alias("tag")))
    each = _kept(_docs(found).select("of", "d", "k"))
    lists = _lists(found, sets)
    gone(found)
    enough = round(least - 0.00005, 9)

    def told(members: Members, x: np.ndarray, y: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
        alike = common / np.minimum(members.n[x], members.n[y]) >= enough
        x, y = np.concatenate([x[alike], y[alike]]), np.concatenate([y[alike], x[alike]])
        d, m = (members.tag.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
        sizes = members.tag.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        long = sizes[y]
        at = np.arange(int(long.sum())) + np.repeat((np.cumsum(sizes) - sizes)[y] - np.cumsum(long) + long, long)
        low, span = (int(d.min()), int(d.max()) - int(d.min()) + 1) if len(d) else (0, 1)
        one, where = np.unique(np.repeat(x, long) * span + (d[at] - low), return_inverse=True)
        total = np.bincount(where, m[at], len(one)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(members.of[one // span]), pa.array(one % span + low, pa.int32()), pa.array(total)], ["of", "d", "m"])

    other = _alike_sets(lists, least, "of long, d int, m long", told)
    same = sets.select("of", F.inline("tag"))
    starts = F.explode(F.sequence(F.col("d") - (days - 1), F.col("d"))).alias("d")  # days from which on such a row is near
    near = other.unionByName(same).select("of", "m", starts).groupBy("of", "d").agg(F.sum("m").alias("n"))
    return each.join(near, ["of", "d"]).select(F.col("k").alias(key), "n")


def best_of_groups(dealt: DataFrame, width: int, k: int, kinds: str) -> DataFrame:
    """(q, id, cosine): of each group (i, j), the k best rows (role 1) of every query (role 0), itself excluded.

    dealt: (k, v, i, j, role). A group's queries are held, its rows stream past them; ties go to the smallest id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, best = None, [], None

        def unit(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            size = np.array([-1 if n is None else n for n in v.value_lengths().to_pylist()])
            x = np.zeros((len(size), width))
            x[np.arange(width) < size[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
            norm = np.linalg.norm(x, axis=1)
            return x / np.where(norm == 0, 1, norm)[:, None], size

        def ended() -> Iterator[pa.RecordBatch]:
            if best is not None:
                order, cosine, ids = best
                p, q = np.nonzero(order < np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[0] for a in asked])[p]), pa.array(ids[p, q]), pa.array(cosine[p, q])], ["q", "id", "cosine"])

        for batch in batches:
            i, j, role = (batch.column(c).to_numpy() for c in (2, 3, 4))
            edges = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(role) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                for a in range(lo, hi, 1024):
                    part = batch.slice(a, min(1024, hi - a))
                    if group != (i[a], j[a]):
                        yield from ended()
                        group, asked, best = (i[a], j[a]), [], None
                    ids, (x, size) = part.column(0).to_numpy(zero_copy_only=False), unit(part.column(1))
                    if role[a] == 0:
                        asked.append((ids, x, size))
                        continue
                    if not asked:
                        continue
                    if best is None:
                        of, y, length = (np.concatenate(z) for z in zip(*asked))
                    c = np.round(np.where(length[:, None] == size, y @ x.T, 0.0), 6) + 0.0
                    order = np.where(of[:, None] == ids, np.inf, np.where(np.isnan(c), -np.inf, -c))
                    now = order, c, np.broadcast_to(ids, c.shape)
                    now = now if best is None else tuple(np.concatenate(z, axis=1) for z in zip(best, now))
                    first = np.argsort(now[0], axis=1, kind="stable")[:, :k]  # ids come in order, so ties go to the smallest
                    best = tuple(np.take_along_axis(z, first, axis=1) for z in now)
        yield from ended()

    return dealt.select("k", "v", "i", "j", "role").repartition("i", "j").sortWithinPartitions("i", "j", "role", "k").mapInArrow(run, kinds)


def k_best(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k).select("q", "id", "cosine")


def most_similar(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 2048, block_bytes: int = 8 << 20, shares: int = 32) -> DataFrame:
    """The k most similar rows of every query (q, qv), itself excluded, exactly; of any number of queries.

    Queries go in blocks of about `block` vectors or `block_bytes`, whichever is less, to each of `shares` shares of the
    rows, which stream past the block; only the k best of a share leave its task. Vectors of unequal lengths, of nothing
    or with a null have a cosine of 0.
    """
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c).cast("array<double>"))
    held = rows.select(F.col(key).alias("k"), whole(vector).alias("v")).filter("k is not null")
    stated = queries.select(F.col("q").alias("k"), whole("qv").alias("v")).filter("k is not null")
    n, longest = stated.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(longest or 0, held.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    m = max(1, math.ceil(n / block), math.ceil(n * width * 8 / block_bytes))
    own = lambda count: F.pmod(F.xxhash64("k"), F.lit(count)).cast("int")
    left = stated.select("k", "v", F.lit(0).alias("role"), own(m).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("j"))
    right = held.select("k", "v", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"), own(shares).alias("j"))

    kinds = f"q {queries.schema['q'].dataType.simpleString()}, id {rows.schema[key].dataType.simpleString()}, cosine double"
    return k_best(best_of_groups(left.unionByName(right), width, k, kinds), k)
