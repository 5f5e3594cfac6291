"""Matroska media columns: mux bytes into files of one 8-bit PCM track, and parse files into packet tables.

The parser walks variable-length EBML elements (known and unknown sizes), clusters, simple blocks and block groups,
all four lacings, and cues. Each packet has its track, timestamp and byte range in the file. Damaged files give the
packets before the damage and `ok` false.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.llm.common import texts_of

# Element identifiers of the format.
EBML, SEGMENT, INFO, SCALE = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH, DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIME, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset([SEGMENT, TRACKS, TRACK, CLUSTER, GROUP, CUES, CUE, CUE_POSITIONS])
TOP = frozenset([CLUSTER, CUES, TRACKS, INFO])

FRAME, FRAMES, BLOCKS, HZ = 1024, 8, 16, 8000


def size_bytes(n: int) -> bytes:
    """The shortest EBML size of n."""
    k = 1
    while n >= (1 << (7 * k)) - 1:
        k += 1
    return ((1 << (7 * k)) | n).to_bytes(k, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """(flag bits, body): none for one frame, fixed-size if all are as long, else EBML lacing."""
    if len(frames) == 1:
        return 0, frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 2, head + b"".join(frames)
    out = [head, size_bytes(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1]):
        d, k = b - a, 1
        while not -(1 << (7 * k - 1)) < d < 1 << (7 * k - 1):
            k += 1
        out.append(((1 << (7 * k)) | (d + (1 << (7 * k - 1)) - 1)).to_bytes(k, "big"))
    return 3, b"".join([*out, *frames])


HEADER = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
SETUP = element(INFO, number(SCALE, 1_000_000)) + element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, np.float64(HZ).tobytes()[::-1]) + number(CHANNELS, 1) + number(DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """A Matroska file whose track 1 holds payload as 8-bit samples, FRAMES frames of FRAME bytes to a laced block."""
    body, cues, at = [SETUP], [], len(SETUP)
    block, cluster = FRAME * FRAMES, FRAME * FRAMES * BLOCKS
    for c in range(0, len(payload), cluster):
        began = c * 1000 // HZ
        parts = [number(TIME, began)]
        for b in range(c, min(c + cluster, len(payload)), block):
            end = min(b + block, len(payload))
            flag, laced = lace([payload[f : min(f + FRAME, end)] for f in range(b, end, FRAME)])
            parts.append(element(SIMPLE, b"\x81" + (b * 1000 // HZ - began).to_bytes(2, "big", signed=True) + bytes([0x80 | flag << 1]) + laced))
        cues.append(element(CUE, number(CUE_TIME, began) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    return HEADER + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def varint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, next place) of a variable-length integer; keep: with its length marker. -1: all ones, an unknown size."""
    first = data[at]
    k = 9 - first.bit_length()
    if k > 8 or at + k > len(data):
        raise ValueError("bad integer")
    value = int.from_bytes(data[at : at + k], "big")
    if keep:
        return value, at + k
    value &= (1 << (7 * k)) - 1
    return (-1 if value == (1 << (7 * k)) - 1 else value), at + k


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(track, relative time, byte ranges) of the block in data[at:end]."""
    track, at = varint(data, at)
    when, flags, at = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2], at + 3
    kind = flags >> 1 & 3
    if not kind:
        return track, when, [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 2:
        if (end - at) % n:
            raise ValueError("uneven lace")
        sizes = [(end - at) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            total = 0
            while data[at] == 255:
                total, at = total + 255, at + 1
            sizes.append(total + data[at])
            at += 1
    else:
        for i in range(n - 1):
            start = at
            v, at = varint(data, at)
            sizes.append(v if not i else sizes[-1] + v - ((1 << (7 * (at - start) - 1)) - 1))
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("bad lace")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return track, when, out


def real(data: bytes) -> float:
    """An EBML floating-point number of 0, 4 or 8 bytes."""
    kind = {0: None, 4: ">f4", 8: ">f8"}[len(data)]
    value = float(np.frombuffer(data, kind)[0]) if kind else 0.0
    if not 0 <= value < 1e12 or 0 < value < 1e-6:
        raise ValueError("no rate")
    return value


def unsigned(data: bytes) -> int:
    """An EBML unsigned integer; longer ones than the format's eight bytes are damage."""
    if len(data) > 8:
        raise ValueError("long integer")
    return int.from_bytes(data, "big")


def long_of(value: float) -> int:
    """value as a 64-bit integer; others are damage."""
    if not -(1 << 63) <= value < 1 << 63:
        raise ValueError("no 64-bit integer")
    return int(value)


def parse(data: bytes) -> dict:
    """packets: (cluster, track, timestamp in ms, start, length); tracks, cues (ms, track, place), clusters; ok.

    Elements are walked with a stack of open masters, so nesting has no limit. Frames of a laced block follow each other by
    the track's default duration; of 8-bit or wider PCM without one, by the samples they hold at the track's rate.
    """
    got = {"packets": [], "tracks": {}, "cues": [], "clusters": [], "ok": True}
    scale, segment, time, track, cue = 1_000_000, 0, 0, {}, {}
    stack: list[tuple[int, int]] = [(0, len(data))]  # (element, end) of each open master
    at = 0

    def close(ident: int) -> None:
        if ident == TRACK:
            got["tracks"][track.get(NUMBER, 0)] = track
        elif ident == CUE_POSITIONS:
            got["cues"].append((long_of(cue.get(CUE_TIME, 0) * scale // 1_000_000), cue.get(CUE_TRACK, 0), cue.get(CUE_CLUSTER, 0)))

    def packets(at: int, stop: int) -> None:
        number_, when, ranges = frames_of(data, at, stop)
        own, base, seen = got["tracks"].get(number_, {}), (time + when) * scale / 1_000_000, 0
        width = own.get(DEPTH, 8) // 8 * own.get(CHANNELS, 1) or 1
        for k, (a, n) in enumerate(ranges):
            step = k * own[DURATION] / 1_000_000 if DURATION in own else seen / width * 1000 / own[RATE] if own.get(RATE) else 0
            got["packets"].append((len(got["clusters"]) - 1, number_, long_of(base + step), a, n))
            seen += n

    try:
        while True:
            while at >= stack[-1][1]:
                ident, _ = stack.pop()
                if not stack:
                    return got
                close(ident)
            began = at
            ident, at = varint(data, at, keep=True)
            while ident in TOP and stack[-1][0] == CLUSTER:  # ends a cluster of unknown size
                stack.pop()
            end = stack[-1][1]
            size, at = varint(data, at)
            stop = end if size < 0 else at + size
            if stop > end:
                raise ValueError("element beyond its parent")
            if ident in MASTERS or ident == INFO or ident == AUDIO:
                if ident == SEGMENT:
                    segment = at
                elif ident == CLUSTER:
                    got["clusters"].append(began - segment)
                elif ident == TRACK:
                    track = {}
                elif ident == CUE:
                    cue = {}
                stack.append((ident, stop))
                continue
            body = data[at:stop]
            if ident == SCALE:
                scale = unsigned(body)
            elif ident == TIME:
                time = unsigned(body)
            elif ident in (SIMPLE, BLOCK):
                packets(at, stop)
            elif ident in (NUMBER, KIND, CHANNELS, DEPTH, DURATION):
                track[ident] = unsigned(body)
            elif ident == RATE:
                track[RATE] = real(body)
            elif ident == CODEC:
                track[CODEC] = body.decode("ascii", "replace")
            elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                cue[ident] = unsigned(body)
            at = stop
    except (ValueError, IndexError, KeyError, OverflowError):
        got["ok"] = False
    return got


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def feature_of(data: bytes, got: dict, back: bytes) -> str:
    """Counts of the container, and the samples' mean, deviation, mean step and zero share."""
    x = np.frombuffer(back, np.uint8).astype(np.float64)
    step = np.abs(np.diff(x)).mean() if len(x) > 1 else 0.0
    if not len(x):
        x = np.zeros(1)  # a file without packets
    return f"tracks={len(got['tracks'])};clusters={len(got['clusters'])};packets={len(got['packets'])};cues={len(got['cues'])};ms={len(back) * 1000 // HZ};mean={x.mean():.3f};dev={x.std():.3f};step={step:.3f};zeros={(x == 0).mean():.4f}"


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each text's padded bytes as a Matroska file; n_bytes is the length before padding.

    Null texts are empty and have 64 zero bytes; repeated rows give repeated files; other columns are ignored; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = part.column(1).to_pylist()
                size = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array([mux(payload_of(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, packet, cluster, track, time_ms, start, length) of each file; null media have no packets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(ident, k, *p) for k, p in enumerate(parse(data)["packets"])] if data else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "packet", "cluster", "track", "time_ms", "start", "length"])

    return media.select(media[id_col].cast("long"), media[media_col]).mapInArrow(run, "doc_id long, packet long, cluster long, track long, time_ms long, start long, length long")


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of what is read back through the packets of (doc_id, media, n_bytes); null media count as empty files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, data, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = data or b""
                got = parse(data)
                back = b"".join(data[a : a + k] for _, _, _, a, k in got["packets"])
                rows.append((ident, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(data, got, back)))
            if rows:
                c = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], DIGESTS)

    return media.select("doc_id", "media", "n_bytes").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


DIGESTS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
