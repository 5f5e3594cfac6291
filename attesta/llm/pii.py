"""Personal data: e-mail addresses, IP addresses, card and phone numbers.

Base spans come from fixed patterns. A character-level bidirectional LSTM with CRF transitions (pii_tagger) adds spans
that the patterns miss. It is trained on windows of the documents, labelled by their base spans, and on windows into which
invented data were put, in many notations, with their labels, or numbers that are no personal data. It reads overlapping
windows; where they overlap, emissions are averaged by how central they are; stretches of windows are decoded in pieces
that overlap, and joined in the middle of each overlap. A window is read if it has a digit, an @, or an "at" that "dot"
follows: every span of these kinds has one. Added spans must not touch base spans and must be sound: enough digits, a
right check digit, four octets, an "at" and a "dot", and no part of a longer word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, texts_of
from attesta.llm.pii_tagger import KINDS, MARGIN, PAD, SIZE, STEP, TAGS, Tagger, classes, fit

# The base patterns.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
AT, DOT = r"(?:@|[\[({<] ?at ?[\])}>]|\bat\b)", r"(?:\.|[\[({<] ?(?:dot|\.) ?[\])}>]|\bdot\b)"
TRIGGER = re.compile(rf"[0-9@]|[\w.%+-]{{1,40}} ?{AT} ?[\w-]{{1,40}} ?{DOT} ?\w", re.I)
PIECE, SHARED = 16, 2  # windows of a piece, and of two neighbouring pieces' overlap

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = HOST.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then by kind as listed."""
    out = list(emails(text))
    if any(map(text.__contains__, "0123456789")):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def sound(text: str, start: int, end: int, kind: str) -> bool:
    """Whether an added span can be what it is said to be: its digits, octets or parts, and that it is no part of a word."""
    s, d = text[start:end], digits_of(text[start:end])
    if start and text[start - 1].isalnum() and text[start].isalnum() or end < len(text) and text[end].isalnum() and text[end - 1].isalnum():
        return False
    if kind == "email":
        return len(s) <= 254 and bool(re.search(rf"\w ?{AT} ?\w.*{DOT} ?\w", s, re.I))
    if re.search(r"[^\W\d_]", re.sub(r"(?i)dot", "", s)):
        return False
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15 and len(d) < len(s)


def stretches(text: str) -> list[tuple[int, int]]:
    """(first, last) window of each run of windows to read."""
    out: list[list[int]] = []
    most = (len(text) - 1) // STEP
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN) // STEP, min(most, (m.end() - 1 + MARGIN) // STEP)
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def pieces(text: str) -> list[tuple[int, int, int, int]]:
    """(first, last, lo, hi): windows to decode at once, at most PIECE of them, and the characters that it decides."""
    out = []
    for a, b in stretches(text):
        lo = a * STEP - MARGIN
        while b - a >= PIECE:
            hi = (a + PIECE - SHARED) * STEP - MARGIN + (SHARED * STEP + SIZE - STEP) // 2
            out.append((a, a + PIECE - 1, lo, hi))
            a, lo = a + PIECE - SHARED, hi
        out.append((a, b, lo, b * STEP - MARGIN + SIZE))
    return out


def windows(c: np.ndarray, first: int, last: int) -> np.ndarray:
    """Windows first to last of a text's character classes c; PAD beyond its ends."""
    lo, hi = first * STEP - MARGIN, last * STEP - MARGIN + SIZE
    a, b = max(0, lo), min(len(c), hi)
    flat = np.full(hi - lo, PAD, np.uint8)
    flat[a - lo : b - lo] = c[a:b]
    return np.lib.stride_tricks.sliding_window_view(flat, SIZE)[::STEP]


CENTRAL = np.minimum(np.arange(1, SIZE + 1), np.arange(SIZE, 0, -1)).astype(np.float32)


def tag_spans(tags: np.ndarray, at: int) -> list[Span]:
    """Spans of a tag path that begins at character `at`."""
    out, open_ = [], None
    for i, t in enumerate([*tags.tolist(), 0]):
        if open_ and (t == 0 or t % 2 == 1 or KINDS[(t - 1) // 2] != open_[1]):
            out.append((at + open_[0], at + i, open_[1]))
            open_ = None
        if t % 2 == 1:
            open_ = (i, KINDS[(t - 1) // 2])
    return out


def model_spans(texts: list[str], model: Tagger, chunk: int = 512) -> list[list[Span]]:
    """The tagger's spans of each text, before any check. At most about `chunk` windows' emissions are held at once."""
    coded, by_size = {}, {}
    for i, text in enumerate(texts):
        for a, b, lo, hi in pieces(text):
            by_size.setdefault(b - a + 1, []).append((i, a, lo, hi))
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    for n, own in by_size.items():
        size = (n - 1) * STEP + SIZE
        weight = np.zeros(size, np.float32)
        for w in range(n):
            weight[w * STEP : w * STEP + SIZE] += CENTRAL
        step = max(1, chunk // n)
        for some in (own[s : s + step] for s in range(0, len(own), step)):
            for i in {x[0] for x in some} - coded.keys():
                coded[i] = classes(texts[i])
            e = model.emissions(np.concatenate([windows(coded[i], a, a + n - 1) for i, a, _, _ in some])).reshape(len(some), n, SIZE, TAGS)
            total = np.zeros((len(some), size, TAGS), np.float32)
            for w in range(n):
                total[:, w * STEP : w * STEP + SIZE] += e[:, w] * CENTRAL[:, None]
            for (i, a, lo, hi), tags in zip(some, model.decode(total / weight[:, None])):
                at = a * STEP - MARGIN
                if tags.any():
                    found.setdefault(i, []).append((lo, tags[lo - at : hi - at]))
    out: list[list[Span]] = [[] for _ in texts]
    for i, parts in found.items():
        parts.sort(key=lambda x: x[0])
        k = 0
        while k < len(parts):
            at, tags = parts[k][0], [parts[k][1]]
            while k + 1 < len(parts) and parts[k + 1][0] == parts[k][0] + len(parts[k][1]):
                k += 1
                tags.append(parts[k][1])
            out[i] += tag_spans(np.concatenate(tags), at)
            k += 1
    return out


ADDRESS = re.compile(rf"(?<![\w.%+-])[\w.%+-]+ ?{AT} ?[\w-]+(?: ?{DOT} ?[\w-]+)+", re.I)
REACH = 24  # characters beyond a span in which its address may begin or end


def whole_address(text: str, a: int, b: int) -> tuple[int, int]:
    """The edges of the address that a span of the tagger overlaps most, where it is none itself: words beside it are none of it."""
    if ADDRESS.fullmatch(text, a, b):
        return a, b
    found, at, end = [], max(0, a - REACH), min(len(text), b + REACH)
    while m := ADDRESS.search(text, at, end):
        if m.start() < b and a < m.end():
            found.append(m.span())
        at = m.start() + 1
    return max(found, key=lambda x: (min(x[1], b) - max(x[0], a), -x[0]), default=(a, b))


def added_spans(text: str, base: list[Span], found: list[Span]) -> list[Span]:
    out = []
    for a, b, kind in found:
        if kind == "email":
            a, b = whole_address(text, max(0, a), b)
        own = text[max(0, a) : b]
        a, b = max(0, a) + len(own) - len(own.lstrip()), max(0, a) + len(own.rstrip())
        if 0 <= a < b <= len(text) and not any(a < y and x < b for x, y, _ in base) and sound(text, a, b, kind):
            out.append((a, b, kind))
    return out


Pick = np.random.Generator


def _digits(r: Pick, k: int) -> str:
    return "".join(map(str, r.integers(0, 10, k)))


def _name(r: Pick, low: int, high: int) -> str:
    return "".join(chr(97 + x) for x in r.integers(0, 26, int(r.integers(low, high))))


def _said(r: Pick, words: list[str]) -> str:
    """A name: a word of the text around it, syllables, or letters by chance."""
    x = r.random()
    if words and x < 0.45:
        return words[int(r.integers(len(words)))].lower()
    if x < 0.85:
        some = lambda s: s[int(r.integers(len(s)))]
        return "".join(some("bcdfghjklmnprstvwz") + some("aeiou") + (some("lmnrst") if r.random() < 0.3 else "") for _ in range(int(r.integers(1, 4))))
    return _name(r, 2, 10)


def invented(kind: str, r: Pick, words: list[str] = []) -> str:  # noqa: B006
    """A datum of a kind, in the notation that the base patterns find; names and hosts may be of the given words."""
    if kind == "email":
        w = lambda: _said(r, words)
        user = w() + ["", "", f".{w()}", f".{w()}", f"_{w()}", f"-{w()}", _digits(r, 2), f"+{w()}", f"{w()}{_digits(r, 2)}"][int(r.integers(9))]
        last = ["com", "org", "net", "de", "co.uk", "io", "example", "edu", "fr", "info", "es", w()[:4]][int(r.integers(12))]
        return f"{user}@{w()}{['', '', f'.{w()}', f'-{w()}'][int(r.integers(4))]}.{last}"
    if kind == "ip":
        return ".".join(str(int(r.integers(0, 256))) for _ in range(4))
    if kind == "card":
        d = str(int(r.integers(3, 7))) + _digits(r, int(r.choice([13, 14, 14, 14, 15, 17])))
        return d + next(c for c in "0123456789" if luhn(d + c))
    return f"+{int(r.integers(1, 99))} {_digits(r, 3)} {_digits(r, 3)} {_digits(r, 4)}"


def rewrite(s: str, kind: str, r: Pick) -> str:
    """The same datum in a notation that the base patterns miss."""
    pick = lambda *x: x[int(r.integers(len(x)))]
    d = digits_of(s)
    if kind == "email":
        user, host = s.split("@", 1)
        at, dot = pick((" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" at ", " dot "), (" AT ", " DOT "), (" @ ", " . "), ("@", "[.]"), ("[at]", "."), (" {at} ", " {dot} "), ("<at>", "<dot>"), ("(at)", "."), ("@", " dot "))
        return f"{user}{at}{host.replace('.', dot)}"
    if kind == "ip":
        return pick("[.]", "(.)", " . ", "[dot]", "(dot)", " dot ").join(s.split("."))
    if kind == "card":
        step, mark = pick(4, 4, 5, 6), pick(".", "/", "_", "  ", " - ", "--", ". ")
        return mark.join(d[i : i + step] for i in range(0, len(d), step))
    a, b, c = d[-10:-7], d[-7:-4], d[-4:]
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"{a}/{b}-{c}", f"00{d[:-10]} {a} {b} {c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"0{a} {b}{c}", f"{a} {b}-{c}", f"00{d[:-10]}-{a}-{b}-{c}", f"{a}/{b}{c}")


def numbers(r: Pick) -> str:
    """A row of numbers, one after another or by chance, that holds no base span."""
    for _ in range(9):
        k, first, size = int(r.integers(3, 12)), int(r.integers(1, 9000)), int(r.integers(1, 6))
        s = " ".join(str(first + i) if k % 2 else _digits(r, size) for i in range(k))
        if not base_spans(s):
            return s
    return "7"


def decoy(r: Pick) -> str:
    """Digits, or an "at" and a dot, that are no personal data."""
    n = lambda k: _digits(r, k)
    w = lambda: _name(r, 2, 9)
    kinds = [lambda: n(4), lambda: f"{n(1)}.{n(1)}", lambda: f"20{n(2)}-0{n(1)}-1{n(1)}", lambda: f"v{n(1)}.{n(1)}.{n(2)}", lambda: n(8), lambda: f"{n(3)},{n(3)}", lambda: f"{n(1)},{n(3)},{n(3)}.{n(2)}", lambda: f'"{n(5)}ab{n(6)}f{n(7)}"', lambda: f"{n(2)}%", lambda: f"@{n(2)}", lambda: f"{n(1)}:{n(2)}", lambda: f"{n(3)}-{n(2)}", lambda: n(13), lambda: f"#{n(5)}", lambda: f"1{n(1)}.0{n(1)}.20{n(2)}", lambda: f"{n(2)}/{n(2)}/{n(4)}", lambda: f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", lambda: f"{n(1)}.{n(1)}.{n(1)}", lambda: f"{n(3)}.{n(3)}.{n(3)}", lambda: f"{n(4)}-{n(4)}", lambda: " ".join(n(5) for _ in range(4)), lambda: f"{w()} at {w()}. {w()} dot {w()}", lambda: f"@{w()}", lambda: f"{w()} @ {w()}", lambda: n(int(r.integers(10, 22))), lambda: f"{n(2)} {n(2)} {n(2)}", lambda: f"[{n(2)}] [{n(3)}]", lambda: numbers(r), lambda: numbers(r)]
    return kinds[int(r.integers(len(kinds)))]()


def training_windows(text: str, seed: int, own: int = 2, made: int = 4) -> list[tuple[bytes, bytes]]:
    """(classes, tags) of up to `own` windows of a text, drawn from all that are to be read, and of `made` with something put in."""
    r, versions = np.random.default_rng(seed), []
    base = base_spans(text)
    runs = stretches(text)
    for k in r.permutation([w for a, b in runs for w in range(a, b + 1)])[:own]:
        lo = max(0, k * STEP - MARGIN)
        hi = min(len(text), lo + SIZE)
        versions.append((text[lo:hi], [(max(a, lo) - lo, min(b, hi) - lo, kind) for a, b, kind in base if a < hi and b > lo]))
    words = re.findall(r"[A-Za-z]{2,10}", text)
    for k in range(made if text else 0):
        at = int(r.integers(0, len(text)))
        left, right = text[max(0, at - SIZE) : at], text[at : at + SIZE]
        if base_spans(left) or base_spans(right):
            left, right = re.sub(r"[0-9@+]", "", left), re.sub(r"[0-9@+]", "", right)
        left, right = left.rsplit(" ", 1)[0], right.split(" ", 1)[-1]
        if r.random() < 0.25:  # among numbers
            left, right = left[-40:] + " " + numbers(r), numbers(r) + " " + right[:40]
        kind = KINDS[int(r.integers(len(KINDS)))] if r.random() < 0.78 else ""
        datum = invented(kind, r, words) if kind else ""
        s = (datum if r.random() < 0.15 else rewrite(datum, kind, r)) if kind else decoy(r)
        left = left + [" ", " ", ": ", " (", ", "][int(r.integers(5))] if left else ""
        whole = left + s + [" ", " ", ".", ", ", ")", "\n"][int(r.integers(6))] + right
        lo = min(max(0, len(left) - int(r.integers(0, SIZE - min(len(s), SIZE - 8) // 2))), max(0, len(whole) - SIZE))
        a, b = max(0, len(left) - lo), min(SIZE, len(left) + len(s) - lo)
        versions.append((whole[lo : lo + SIZE], [(a, b, kind)] if kind and a < b else []))
    out = []
    for t, spans in versions:
        tags = np.zeros(SIZE, np.uint8)
        for a, b, kind in spans:
            if not tags[a:b].any():
                tags[a:b] = 2 + 2 * KINDS.index(kind)
                tags[a] = 1 + 2 * KINDS.index(kind)
        c = np.full(SIZE, PAD, np.uint8)
        c[: len(t)] = classes(t)[:SIZE]
        out.append((c.tobytes(), tags.tobytes()))
    return out


def train(docs: DataFrame, *, sample: int = 1200, most: int = 6400, id_col: str = "doc_id", text_col: str = "text", **options) -> Tagger:
    """Fit on windows of at most `sample` documents, the first by hash of id; at most `most` windows. options: of pii_tagger.fit.

    Fewer documents get more invented data each, so that there are about as many windows.
    """
    texts = texts_of(docs, id_col, text_col)
    some = cut(texts.filter("id is not null").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample), "sample")
    made = min(40, max(4, most // max(1, some.count()) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [w for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in training_windows(t, i & 0xFFFFFFFF, made=made)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows)], ["c", "y"])

    rows = texts.join(F.broadcast(some), "id").mapInArrow(run, "c binary, y binary").orderBy(F.xxhash64("c", "y"), "c", "y").limit(most).collect()  # `most` windows at most
    if not rows:
        return Tagger.new(8, 0)
    c, y = (np.frombuffer(b"".join(r[k] for r in rows), np.uint8).reshape(-1, SIZE) for k in ("c", "y"))
    return fit(c.astype(np.int64), y.astype(np.int64), **options)


def find_spans(docs: DataFrame, model: Tagger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, base array<struct>, spans array<struct>) of each row: spans (start, end, kind) in code points, end exclusive.

    Null texts are empty and have no spans; rows without id and repeated rows are each judged; columns other than the id
    and the text are left out; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = part.column(1).to_pylist()
                base = [base_spans(t) for t in texts]
                every = [sorted([*b, *added_spans(t, b, f)], key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for t, b, f in zip(texts, base, model_spans(texts, shared.value))]
                as_rows = lambda x: pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in x], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), as_rows(base), as_rows(every)], ["doc_id", "text", "base", "spans"])

    struct = "array<struct<start:int,end:int,kind:string>>"
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id long, text string, base {struct}, spans {struct}")


def span_digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) from find_spans: counts and digest of base spans; all spans as text."""
    said = lambda col: F.array_join(F.transform(F.col(col), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def redact(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; of spans that overlap, one replacement for all."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: Tagger, *, text_col: str = "text") -> DataFrame:
    """docs with every span of the text column replaced; null texts stay null; all other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(column):
        texts = ["" if t is None else t for t in column]
        base = [base_spans(t) for t in texts]
        found = model_spans(texts, shared.value)
        out = [redact(t, [*b, *added_spans(t, b, f)]) for t, b, f in zip(texts, base, found)]
        return type(column)([None if t is None else o for t, o in zip(column, out)], dtype=object)

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
