"""Byte-pair encoding as a transducer with bounded lookahead, and decoding as a byte-to-text machine.

Whether two neighbouring tokens merge can depend on what follows them, but only so far: a difference in the text to the
right of a place can move to the left only by merges of ever higher rank, one token at each. `Merges.lookahead` is the
longest such chain in bytes, computed from the merge list alone. A token that ends at least that many bytes before the
end of what has been read is final whatever follows, so it is emitted, and only the bytes behind it are kept. Text comes
in blocks; between blocks the transducer holds the two last pieces of the splitting pattern, or, within a piece that is
itself long, the bytes of its tokens that are not final yet. So its memory does not grow with the text, nor with a piece
of any length.

The decoder joins the bytes of tokens block by block; up to three bytes of a character that is not complete wait for the
next block.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from attesta.llm.common import texts_of

PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"  # the byte-level splitting pattern, a fixed value
PLAIN = {"letter": r"\p{L}", "number": r"\p{N}", "other": r"[^\s\p{L}\p{N}]"}
BLOCK = 1 << 16
CACHE = 500_000  # pieces whose ids a worker remembers
NONE = 1 << 60  # no merge
LONG = 1024  # a piece of more characters is encoded as a stream


def byte_letters() -> dict[str, int]:
    """The letter by which the vocabulary file writes each byte: itself where it can be seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def newer_letters(path: str) -> str:
    """Letters and numbers to the regex module, which are neither to the tokenizers library: its Unicode tables are older.

    Only characters that the standard library's tables, older still, do not know are asked for.
    """
    from tokenizers import Tokenizer

    unknown = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    asked = regex.findall(r"[\p{L}\p{N}]", unknown)
    spans = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str(" ".join("!" + c for c in asked))
    split = {span[0] for _, span in spans}
    return "".join(c for i, c in enumerate(asked) if 3 * i + 1 not in split)


def _ranges(letters: str) -> str:
    """Sorted letters as the inside of a character class."""
    code, out = np.array([ord(c) for c in letters]), []
    for part in np.split(code, np.flatnonzero(np.diff(code) != 1) + 1):
        out.append(rf"\U{part[0]:08x}-\U{part[-1]:08x}")
    return "".join(out)


class Merges:
    """A merge list over bytes: ranks, tokens and the sufficient lookahead."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        self.ids = ids
        if any(bytes([b]) not in ids for b in range(256)):
            raise ValueError("a byte has no token")
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        made = {bytes([b]) for b in range(256)}
        self.rank: dict[tuple[int, int], int] = {}
        self.made = [ids[a + b] for a, b in pairs]  # by rank
        parent: dict[bytes, bytes] = {}
        for r, (a, b) in enumerate(pairs):
            if a not in made or b not in made or a + b in made:
                raise ValueError(f"merge {r} is not of two tokens known before it into a new one")
            made.add(a + b)
            parent[a + b] = a
            self.rank[ids[a], ids[b]] = r
        self.lookahead = self._lookahead(pairs, parent)

    @staticmethod
    def _lookahead(pairs: list[tuple[bytes, bytes]], parent: dict[bytes, bytes]) -> int:
        """How many bytes before the end of a prefix its tokens can differ from those of the whole text.

        A rule (a, b) can move the difference over a token a if it applies in one of the two texts only, that is if the
        token right of a, which is b there, differs. That token starts where the difference began before, so the token
        that the difference had moved over is b, or a beginning of b from which b was merged. A rule moves it over one
        token at most, since equal rules apply from left to right.
        """
        reach: dict[bytes, int] = {}
        for a, b in pairs:  # in order of rank: what moved the difference before has a lower rank
            before, t = 0, b
            while t is not None:
                before = max(before, reach.get(t, 0))
                t = parent.get(t)
            reach[a] = max(reach.get(a, 0), len(a) + before)
        return max(reach.values(), default=0)

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece: always the pair of the lowest rank, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        get, made = self.rank.get, self.made
        if n <= 256:  # short: the least of all pairs each time
            ranks = [get(pair, NONE) for pair in zip(ids, ids[1:])]
            while (best := min(ranks, default=NONE)) != NONE:
                i = ranks.index(best)
                ids[i : i + 2] = [made[best]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), NONE)
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = made[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out


class Vocabulary:
    """A byte-level BPE file: merges, the bytes of each id, and the strings that are tokens of their own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, letters = told["model"], byte_letters()
        split = told["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or told["normalizer"] is not None:
            raise ValueError("not a byte-level BPE file without prefix space and normaliser")
        as_bytes = lambda s: bytes(letters[c] for c in s)
        ids = {as_bytes(s): i for s, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges([(as_bytes(a), as_bytes(b)) for a, b in pairs], ids)
        self.tokens = {i: b for b, i in ids.items()}
        self.special = {}
        for t in told["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("an added token that takes its surroundings is not supported")
            self.special[t["content"]] = t["id"]
            self.tokens[t["id"]] = t["content"].encode()
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None
        self.begun = {s[:k] for s in by_length for k in range(1, len(s))}
        self.begun_most = max((len(s) for s in by_length), default=1) - 1
        self.known: dict[str, bytes] = {}
        newer = newer_letters(path)
        own = _ranges(newer)
        kinds = {"letter": rf"[\p{{L}}--[{own}]]", "number": rf"[\p{{N}}--[{own}]]", "other": rf"[[^\s\p{{L}}\p{{N}}]||[{own}]]"} if newer else PLAIN
        self.newer = frozenset(newer)
        self.plain, self.exact = (regex.compile(PIECE.format(**k), regex.V1) for k in (PLAIN, kinds))
        self.space = regex.compile(r"\s+", regex.V1)
        #: what a piece of any length goes on with, and the whole pieces that may
        self.runs = [(regex.compile(f"{k}+", regex.V1), regex.compile(f" ?{k}+", regex.V1)) for k in kinds.values()] + [(self.space, self.space)]

    def pieces(self, text: str) -> list[str]:
        """The pieces of text by the splitting pattern."""
        exact = not text.isascii() and max(text) > "\u0500" and not self.newer.isdisjoint(text)  # below, the tables agree
        return (self.exact if exact else self.plain).findall(text)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per file and Python worker: its lookahead is computed once."""
    return Vocabulary(path)


class Encoder:
    """Text in blocks to ids, as little-endian unsigned 32-bit bytes: feed() any number of times, then finish()."""

    def __init__(self, known: Vocabulary, long: int = LONG):
        self.v, self.long = known, long
        self.held = ""  # text of which the pieces are not certain
        self.run: regex.Pattern | None = None  # within a long piece: what it goes on with
        self.bytes = b""  # of the long piece: bytes of tokens that are not final
        self.begun = ""  # the beginning of what may be a special token
        self.space = ""  # of a long piece of white space: its last character, which a next piece may take

    def _piece(self, piece: str) -> bytes:
        ids = np.array(self.v.merges.encode(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(self.v.known) < CACHE and len(piece) <= 64:
            self.v.known[piece] = ids
        return ids

    def _final(self) -> bytes:
        """Of the long piece, the tokens that no continuation changes."""
        merges = self.v.merges
        if len(self.bytes) < 8 * merges.lookahead + self.long:
            return b""
        ids, at, end = merges.encode(self.bytes), 0, len(self.bytes) - merges.lookahead
        for n, i in enumerate(ids):
            if at + len(self.v.tokens[i]) > end:
                break
            at += len(self.v.tokens[i])
        self.bytes = self.bytes[at:]
        return np.array(ids[:n], "<u4").tobytes()

    def _stream(self, text: str) -> bytes:
        out = []
        for i in range(0, len(text), BLOCK):
            self.bytes += text[i : i + BLOCK].encode("utf-8", "surrogatepass")
            out.append(self._final())
        return b"".join(out)

    def _end_run(self) -> bytes:
        out = np.array(self.v.merges.encode(self.bytes), "<u4").tobytes()
        self.run, self.bytes = None, b""
        return out

    def _in_run(self, text: str, last: bool) -> tuple[bytes, str]:
        """Take from text what the long piece goes on with; the tokens that are final, and the rest of text."""
        found = self.run.match(text)
        more, rest = (found[0], text[found.end() :]) if found else ("", text)
        if self.run is self.v.space:  # white space: the last of it is the next piece's if more text follows
            more = self.space + more
            self.space, more = ("", more) if last and not rest else (more[-1:], more[:-1])
        out = self._stream(more)
        if rest or last:
            out += self._end_run()
            rest, self.space = self.space + rest, ""
        return out, rest

    def _segment(self, text: str, last: bool) -> bytes:
        """text goes on where the one before ended; last: nothing goes on after it."""
        out = []
        if self.run is not None:
            ids, text = self._in_run(text, last)
            out.append(ids)
            if self.run is not None:
                return b"".join(out)
        text = self.held + text
        self.held = ""
        found = self.v.pieces(text)
        if not last and found:  # the last piece may go on, and "'" before it may be a piece of two letters
            if len(found[-1]) > self.long:
                out += [self._pieces(found[:-1]), self._begin_run(found[-1])]
                return b"".join(out)
            self.held = "".join(found[-2:])
            found = found[:-2]
        out.append(self._pieces(found))
        return b"".join(out)

    def _pieces(self, pieces: list[str]) -> bytes:
        get, miss = self.v.known.get, self._piece
        return b"".join([get(p) or miss(p) if len(p) <= self.long else self._whole(p) for p in pieces])

    def _whole(self, piece: str) -> bytes:
        """A long piece of which all is there: the same tokens, encoded as a stream."""
        return self._stream(piece) + self._end_run()

    def _begin_run(self, piece: str) -> bytes:
        """The last piece has become long and may go on: encode it as a stream from here on."""
        self.run = next(more for more, whole in self.v.runs if whole.fullmatch(piece))
        if self.run is self.v.space:
            piece, self.space = piece[:-1], piece[-1]
        return self._stream(piece)

    def _blocks(self, text: str, last: bool) -> Iterator[tuple[str, bool]]:
        at = 0
        while at < len(text):
            yield text[at : at + BLOCK], last and at + BLOCK >= len(text)
            at += BLOCK
        if not text and last:
            yield "", True

    def feed(self, text: str, last: bool = False) -> bytes:
        """Ids that are certain now."""
        return b"".join(self._with_special(block, end) for block, end in self._blocks(text, last))

    def finish(self) -> bytes:
        """The remaining ids; the encoder is then as new."""
        return self.feed("", True)

    def _with_special(self, text: str, last: bool) -> bytes:
        pattern = self.v.special_pattern
        if pattern is None:
            return self._segment(text, last)
        out, text, at = [], self.begun + text, 0
        self.begun = ""
        for found in pattern.finditer(text):
            out.append(self._segment(text[at : found.start()], True))
            out.append(np.array([self.v.special[found[0]]], "<u4").tobytes())
            at = found.end()
        text = text[at:]
        if not last:
            for k in range(min(self.v.begun_most, len(text)), 0, -1):
                if text[-k:] in self.v.begun:
                    text, self.begun = text[:-k], text[-k:]
                    break
        out.append(self._segment(text, last))
        return b"".join(out)


class Decoder:
    """Ids in blocks to text. Bytes that are no UTF-8 become U+FFFD, one for each broken beginning; unknown ids give nothing."""

    def __init__(self, known: Vocabulary):
        self.tokens = known.tokens
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        get = self.tokens.get
        return self.machine.decode(b"".join([get(i, b"") for i in ids]), last)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def _file(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, 256) for i in range(0, batch.num_rows, 256))


def encoded(docs: DataFrame, *, file: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row. file: a vocabulary of the tokenizers package, or a path.

    Null texts are empty and have no ids; null and repeated doc_ids are kept, row by row. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(vocabulary(_file(file)))
        for batch in batches:
            for part in _slices(batch):
                found = [np.frombuffer(e.feed(t, True), "<u4").astype(np.int32) for t in part.column(1).to_pylist()]
                at = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))], ["doc_id", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, *, file: str = "byte_bpe_50k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with an array of ids. Null arrays are empty; null and unknown ids give nothing."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(_file(file))
        for batch in batches:
            for part in _slices(batch):
                found = [Decoder(v).feed(ids or (), True) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, *, file: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: its ids, and the text that they decode to.

    Each text goes through encoder, digests and decoder block by block, so that only the text itself is held whole.
    Null texts are empty; null and repeated doc_ids are kept, row by row; other columns are ignored; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(_file(file))
        e, d = Encoder(v), Decoder(v)
        for batch in batches:
            for part in _slices(batch):
                counts, ids_told, texts_told = [], [], []
                for text in part.column(1).to_pylist():
                    n, over_ids, over_text = 0, hashlib.sha256(), hashlib.sha256()
                    for at in range(0, max(1, len(text)), BLOCK):
                        last = at + BLOCK >= len(text)
                        ids = e.feed(text[at : at + BLOCK], last)
                        n += len(ids) // 4
                        over_ids.update(ids)
                        over_text.update(d.feed(np.frombuffer(ids, "<u4").tolist(), last).encode("utf-8", "surrogatepass"))
                    d.machine.reset()
                    counts.append(n)
                    ids_told.append(over_ids.hexdigest())
                    texts_told.append(over_text.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids_told), pa.array(texts_told)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
