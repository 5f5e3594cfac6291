"""Best-fit packing of tokenised documents into sequences of at most `capacity` tokens.

Only the lengths matter for where a piece goes, and there are at most `capacity` lengths. So lengths are counted on
Spark, the plan is made on those counts (its size is bounded by the capacity, not by the documents), and each piece
takes the place of its rank among the pieces of its length. Pieces above a third of the capacity are large: at most two
share a sequence, and they are matched greedily, each with the largest that still fits; smaller pieces then go, longest
first, to the fullest sequences that have room.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import cut, texts_of

PIECE_CACHE = 400_000
SPACES = re.compile(r"\s\s|^\s|\s$")


class Tokeniser:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes, equal to those of the tokenizers file.

    A single space between two other characters always starts a new unit of the vocabulary's splitting pattern, so
    a text is encoded word by word and frequent words are remembered. Texts with runs of white space are encoded whole
    by the same vocabulary's ranks, those with the special token's string by the tokenizers file itself.
    """

    def __init__(self, file: str, ranks: str, special: str = "<|endoftext|>"):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.slow = Tokenizer.from_file(public_tokenizers.path(file))
        self.special, self.words = special, {}

    def word(self, w: str) -> bytes:
        ids = np.array(self.fast(" " + w), "<u4").tobytes()
        if len(self.words) < PIECE_CACHE:
            self.words[w] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.special in text:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if SPACES.search(text):
            return np.array(self.fast(text), "<u4").tobytes()
        words, get, miss = text.split(" "), self.words.get, self.word
        first = np.array(self.fast(words[0]), "<u4").tobytes()
        return first + b"".join([get(w) or miss(w) for w in words[1:]])


def token_pieces(docs: DataFrame, *, capacity: int = 1024, end_id: int = 2, file: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids binary): each document's ids and the end id, cut where longer than capacity.

    A document that is cut has a shorter first piece, then pieces of the whole capacity. Null texts are empty: their
    ids are the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokeniser(file, ranks)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = []
                for ident, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = t.ids(text) + end
                    n = len(ids) // 4
                    at, k = 0, 0
                    while at < n:
                        size = min(n, capacity) if at else (n % capacity or capacity)
                        own = ids[4 * at : 4 * (at + size)]
                        rows.append((ident, k, at, size, zlib.crc32(own), own))
                        at, k = at + size, k + 1
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:5]), pa.array(c[5], pa.binary())], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many, lengths) of the sequences that hold `counts` pieces of each length. Work and size follow the lengths."""
    left = {n: c for n, c in counts.items() if c > 0}
    bins: dict[int, list[tuple[int, list[int]]]] = {}  # by room left
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m + n <= capacity and left[m] - (m == n) > 0), None)
            if mate is None:
                many, own = left[n], [n]
            elif mate == n:
                many, own = left[n] // 2, [n, n]
            else:
                many, own = min(left[n], left[mate]), [n, mate]
            for m in own:
                left[m] -= many
            bins.setdefault(capacity - sum(own), []).append((many, own))
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            room = min((r for r in bins if r >= n and bins[r]), default=None)
            if room is None:
                k = capacity // n
                many, own, took = (left[n] // k, [n] * k, k) if left[n] >= k else (1, [n] * left[n], left[n])
                left[n] -= many * took
                bins.setdefault(capacity - n * took, []).append((many, own))
                continue
            many, own = bins[room].pop()
            k = min(room // n, max(1, left[n] // many))  # as many to each as fit
            took = min(many, left[n] // k) if left[n] >= k else 0
            if not took:
                k, took = left[n], 1
            left[n] -= k * took
            bins.setdefault(room - k * n, []).append((took, own + [n] * k))
            if many > took:
                bins[room].append((many - took, own))
    return [x for r in sorted(bins) for x in bins[r]]


def best_fit(pieces: DataFrame, *, capacity: int = 1024, shard_rows: int = 5_000) -> DataFrame:
    """pieces with sequence_id and offset. Rows are told apart by (doc_id, piece, start); rows equal in these share no place.

    Ranks within a length come from counts by (length, shard), so that no task needs all pieces of a length: each length
    has as many shards as `shard_rows` asks for.
    """
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    spark = pieces.sparkSession
    parts = F.broadcast(spark.createDataFrame([(n, -(-c // shard_rows)) for n, c in sizes.items()] or [(0, 1)], "length long, parts long"))  # bounded by the capacity
    dealt = pieces.join(parts, "length").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")).cast("int"))
    counts = dealt.groupBy("length", "shard").count()
    slots, base, at = [], 0, dict.fromkeys(sizes, 0)
    for many, own in plan(sizes, capacity):
        offset = 0
        for n in own:
            slots.append((n, at[n], at[n] + many, base, offset))
            at[n] += many
            offset += n
        base += many
    places = F.broadcast(spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "length long, lo long, hi long, base long, offset long"))  # bounded by the capacity
    before = counts.select("length", "shard", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("within", within).join(before, ["length", "shard"]).withColumn("rank", F.col("within") + F.col("before"))
    placed = ranked.join(places, (ranked["length"] == places["length"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"]))
    return placed.select(*(ranked[c] for c in pieces.columns), (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("offset"))


def pack_documents(docs: DataFrame, *, capacity: int = 1024, end_id: int = 2, file: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of each piece of each document.

    Rows of one doc_id are packed each on its own. Null ids are kept as null. An empty table gives no rows. Columns
    other than the id and the text are ignored.
    """
    pieces = token_pieces(docs, capacity=capacity, end_id=end_id, file=file, ranks=ranks, id_col=id_col, text_col=text_col)
    return best_fit(cut(pieces if with_ids else pieces.drop("ids"), "pieces"), capacity=capacity)
