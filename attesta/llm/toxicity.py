"""Toxicity by noisy-channel deobfuscation and a set-covering lexicon.

A character trigram language model is counted over all documents. Tokens that show signs of disguise (symbols or digits
among letters, letters repeated three times or more, single letters set apart by spaces) become lattices: each character
may stand for itself, for the letters it resembles, for nothing, or for a repeat of the one before, and a space in a run
of single letters or pieces may end a word or not. Viterbi search under the language model gives the likeliest plain
words; other tokens have one path only and stay. The restored words
are matched with a lexicon of words and word beginnings, chosen by greedy set covering on labelled documents, and
logistic regression turns the matches of a document into its score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, texts_of
from attesta.llm.quality_rules import in_fold

# The letters that a character is used for in disguised words.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "#": "h", "%": "x"}
FILLERS = frozenset(".-_*~^'`·/\\,:;​‌‍⁠﻿")
EDGES = "".join(sorted(set("\"'()[]{}<>.,;:!?*_~`-|#$%&+=/\\@^«»“”‘’…¿¡")))
REPEATED = re.compile(r"(\w)\1\1")
LONG_RUN = re.compile(r"(.)\1{3,}", re.S)
LETTERS = 27  # a to z, and everything else
TOKEN_CACHE = 200_000
WORST = 64  # longer tokens are not words
GAP, SEAM = "\uf8fe", "\uf8ff"  # a space that a word may run across: between single characters, and elsewhere
GAPS = {GAP: [(" ", 0.0), ("", 0.0)], SEAM: [(" ", 0.0), ("", -2.0)]}


def plain(c: str) -> str:
    """The base letter a-z of a character; else the character."""
    d = unicodedata.normalize("NFKD", c)[:1].lower()
    return d if "a" <= d <= "z" else c.lower()


def letter_class(c: str) -> int:
    d = plain(c)
    return ord(d) - 97 if "a" <= d <= "z" and len(d) == 1 else 26


CLASSES = np.array([letter_class(chr(i)) for i in range(0x250)], np.int64)


def trigram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of the letter-class trigrams of all texts: each task sends one table of 27^3 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
                c = np.full(len(x) + 2, 26, np.int64)
                c[1:-1] = CLASSES[np.minimum(x, 0x24F)]
                total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k])], ["k", "n"])

    rows = texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 27^3 rows at most
    out = np.zeros(LETTERS**3)
    for r in rows:
        out[r["k"]] = r["n"]
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log p(letter | two before), smoothed by the shorter contexts."""
    tri = counts.reshape(LETTERS, LETTERS, LETTERS)
    uni = (tri.sum((0, 1)) + 1) / (tri.sum() + LETTERS)
    bi = (tri.sum(0) + 50 * uni) / (tri.sum(0).sum(1, keepdims=True) + 50)
    return np.log((tri + 50 * bi[None]) / (tri.sum(2, keepdims=True) + 50))


def decode(token: str, lm: np.ndarray) -> str:
    """The likeliest plain form of a token: best path through the lattice of what each character may stand for.

    A GAP or SEAM is a word end or nothing. Exact: one best path, with back pointers, per two letters before and last
    character put out, which is all that later steps depend on.
    """
    states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(26, 26, ""): (0.0, None)}
    for c in token:
        base = plain(c)
        choices: list[tuple[str, float]] = []
        if c in GAPS:
            choices += GAPS[c]
        elif len(base) == 1 and "a" <= base <= "z":
            choices.append((c.lower(), -0.05))
        else:
            choices += [(x, -1.0) for x in LOOKALIKES.get(c, "")]
            choices.append(("", -1.0) if c in FILLERS or not c.isalnum() else ("", -6.0))
            if not choices[0][0]:
                choices.append((c, -8.0))
        now: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        for (a, b, last), (p, path) in states.items():
            for x, cost in choices:
                ways = []
                if x:
                    if last == x:  # a repeat of the letter before
                        ways.append(((a, b, last), p - 1.5, path))
                    k = letter_class(x)
                    ways.append(((b, k, x), p + cost + lm[a, b, k], (path, x)))
                else:
                    ways.append(((a, b, last), p + cost, path))
                for key, q, way in ways:
                    if key not in now or q > now[key][0]:
                        now[key] = (q, way)
        states = now
    path = max(((p + lm[a, b, 26], path) for (a, b, _), (p, path) in states.items()), key=lambda x: x[0])[1]
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def disguised(token: str) -> bool:
    """Whether a token mixes letters with other characters, or repeats one three times."""
    core = token.strip(EDGES)
    if not 3 <= len(token) <= WORST or "@" in token[1:-1] and "." in token:
        return False
    if REPEATED.search(core):
        return True
    letters = sum(map(str.isalpha, token))
    odd = any(c in LOOKALIKES or c in FILLERS for c in core if not c.isalpha()) or any(c in "@$" for c in token[:1])
    return odd and 3 * letters >= len(core) and letters >= 2


def restored(token: str, lm: np.ndarray) -> list[str]:
    """The plain words that a token may be: itself, and its decoded form if it looks disguised."""
    out = [token.strip(EDGES).lower()]
    token = LONG_RUN.sub(r"\1\1\1", token)  # stretched words are no longer than others
    if disguised(token):
        for t in {token, token.strip(EDGES + "!")}:
            w = decode(t, lm)
            if w not in out:
                out.append(w)
        # runs of a letter, as one and as two
        for n in (1, 2):
            w = re.sub(r"(\w)\1+", lambda m, n=n: m[1] * n, out[-1])
            if w not in out:
                out.append(w)
    return [w for w in out if w]


def spaced(tokens: list[str]) -> list[str]:
    """Words set with single characters: each run of four or more one-character tokens, joined."""
    out, run = [], []
    for t in [*tokens, "  "]:
        if len(t.strip(EDGES) or t) == 1:
            run.append(t.strip(EDGES) or t)
        else:
            if len(run) >= 4:
                out.append("".join(run))
            run = []
    return out


def lone(token: str) -> bool:
    """Whether a token is one character that can be a letter."""
    core = token.strip(EDGES) or token
    return len(core) == 1 and (core.isalpha() or core in LOOKALIKES)


def respaced(tokens: list[str], lm: np.ndarray, singles: list[int] | None = None) -> Iterator[str]:
    """The words of each run of two or more one-character tokens, with a short piece before and after it.

    The language model chooses which spaces end a word. singles: the places of the one-character tokens, in order.
    """
    places = [i for i, t in enumerate(tokens) if lone(t)] if singles is None else singles
    at = 0
    while at < len(places):
        end = at
        while end + 1 < len(places) and places[end + 1] == places[end] + 1:
            end += 1
        if end > at:
            lo, hi = places[at], places[end] + 1
            text = GAP.join(t.strip(EDGES) or t for t in tokens[lo:hi])
            if lo and len(tokens[lo - 1]) < 6:
                text = tokens[lo - 1].strip(EDGES) + SEAM + text
            if hi < len(tokens) and len(tokens[hi]) < 6:
                text += SEAM + tokens[hi].strip(EDGES)
            yield from decode(text, lm).split()
        at = end + 1


def word_features(w: str) -> list[str]:
    """A word, and its beginnings of four to eight letters."""
    return [f"={w}", *(f"^{w[:n]}" for n in range(4, 9) if len(w) > n - 1)]


def document_words(text: str, lm: np.ndarray, cache: dict[str, list[str]]) -> Iterator[str]:
    """Every restored word of a text."""
    tokens = text.split()
    for t in tokens:
        words = cache.get(t)
        if words is None:
            words = restored(t, lm)
            if len(cache) < TOKEN_CACHE:
                cache[t] = words
        yield from words
    for run in spaced(tokens):
        yield from restored(run, lm)
        yield run.lower()
    yield from respaced(tokens, lm)


@dataclass(frozen=True)
class ToxicModel:
    lm: np.ndarray
    lexicon: dict[str, float]
    weights: tuple[float, ...]

    @cached_property
    def heads(self) -> frozenset[str]:
        """The beginnings of the lexicon's words and beginnings, themselves left out."""
        return frozenset(f[1:n] for f in self.lexicon for n in range(2, len(f)))


def summary(hits: list[float], distinct: int, words: int) -> list[float]:
    """What a document's lexicon matches come to."""
    return [1.0, float(bool(hits)), math.log1p(len(hits)), math.log1p(distinct), max(hits, default=0.0) / 8, len(hits) / (words + 10)]


def _matches(text: str, model: ToxicModel, cache: dict[str, tuple]) -> tuple[list[float], int, int]:
    tokens = text.split()
    hits, seen, singles, heads = [], set(), [], []
    for i, t in enumerate(tokens):
        got = cache.get(t)
        if got is None:
            core = (t.strip(EDGES) or t).lower()
            got = _token_match(t, model), lone(t), core if core in model.heads else ""
            if len(cache) < TOKEN_CACHE:
                cache[t] = got
        found, single, head = got
        if found:
            hits.append(found[0])
            seen.add(found[1])
        if single:
            singles.append(i)
        if head:
            heads.append((i, head, single))
    more = [f for w in respaced(tokens, model.lm, singles) if (f := _best([w], model))] if len(singles) > 1 else []
    more += [f for i, head, single in heads if (f := _joined(tokens, i, head, single, model))]
    if len(singles) >= 4:
        more += [f for run in spaced(tokens) if (f := _token_match(run, model, True))]
    if more:
        # A word may be found in more than one way: each way counts a feature as often as it finds it, the most counts.
        for f in {f for _, f in more} - seen:
            hits.append(model.lexicon[f])
            seen.add(f)
    return hits, len(seen), len(tokens)


def _best(words: list[str], model: ToxicModel) -> tuple:
    """(weight, feature) of the best match of any of the words; else ()."""
    return max(((model.lexicon[f], f) for w in words for f in word_features(w) if f in model.lexicon), default=())


def _joined(tokens: list[str], i: int, word: str, single: bool, model: ToxicModel) -> tuple:
    """The match of a word that is cut into pieces by spaces and begins with token i, where the language model joins them."""
    pieces, had = [word], len(word)
    for t in tokens[i + 1 :]:
        core = (t.strip(EDGES) or t).lower()
        if single and lone(t):
            return ()  # a run of single characters: see respaced
        pieces.append(core)
        word, single = word + core, False
        if any(f in model.lexicon for f in word_features(word) if len(f) - 1 > had) and " " not in decode(SEAM.join(pieces), model.lm):
            return _best([word], model)
        if word not in model.heads:
            return ()
        had = len(word)
    return ()


def _token_match(token: str, model: ToxicModel, joined: bool = False) -> tuple:
    """(weight, feature) of a token's best match; else ()."""
    words = restored(token, model.lm)
    core = token.strip(EDGES)
    if joined:
        words += [token.lower(), decode(token, model.lm)]
    elif 3 <= len(core) <= WORST and any(map(str.isalpha, core)) and any(c in LOOKALIKES for c in core) and not disguised(token):
        words.append(decode(core, model.lm))  # few letters among other characters; a disguise only if it gives a known word
    return _best(words, model)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (p - y) + ridge * w)
    return w


def cover(toxic: list[set[str]], clean: dict[str, int], n_clean: int, least: int, purity: float, times: int = 3) -> dict[str, float]:
    """Greedy set covering, each toxic document up to `times` times: the features that most of those not yet covered so often have and hardly any clean one; their log odds.

    A feature that nearly the same documents have as one taken before adds nothing and is passed over.
    """
    by: dict[str, set[int]] = {}
    for i, features in enumerate(toxic):
        for f in features:
            by.setdefault(f, set()).add(i)
    ok = {f: s for f, s in by.items() if len(s) >= least and len(s) / (len(s) + clean.get(f, 0) * len(toxic) / max(1, n_clean)) >= purity}
    need, out = dict.fromkeys(range(len(toxic)), times), {}
    left = set(need)
    while ok:
        f = min(ok, key=lambda k: (-len(ok[k] & left), len(k), k))
        gain = ok.pop(f) & left
        if len(gain) < least:
            break
        if any(len(by[f] & by[g]) > 0.8 * len(by[f] | by[g]) for g in out):
            continue
        out[f] = math.log((len(by[f]) + 0.5) / (len(toxic) + 1)) - math.log((clean.get(f, 0) + 0.5) / (n_clean + 1))
        for i in gain:
            need[i] -= 1
        left = {i for i in left if need[i]}
        ok = {k: s for k, s in ok.items() if len(s & left) >= least}
    return out


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", folds: int = 4, fold: int = 2, sample: int = 12_000, least: int = 4, purity: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """The language model of all documents; the lexicon and weights from at most `sample` labelled rows of either class outside the held-out fold."""
    texts = texts_of(docs, id_col, text_col)
    lm = language_model(trigram_counts(texts))
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null").filter(~in_fold(F.col("id"), folds, fold)).groupBy("id").agg(F.max("y").alias("y"))
    some = rows.filter("y = 1").orderBy(F.xxhash64("id"), "id").limit(sample // 4).unionByName(rows.filter("y = 0").orderBy(F.xxhash64("id"), "id").limit(sample - sample // 4))
    picked = cut(texts.join(F.broadcast(some), "id").select("text", "y").dropDuplicates(), "picked")  # at most `sample` rows; read five times

    def of_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                out.append(sorted({f for w in document_words(text, lm, cache) for f in word_features(w)}))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["f"])

    toxic = picked.filter("y = 1").select("text").mapInArrow(of_toxic, "f array<string>")
    wide = toxic.select(F.explode("f").alias("f")).groupBy("f").count().filter(F.col("count") >= least)
    had = {r["f"]: r["count"] for r in wide.collect()}  # each in `least` of the sample's toxic rows
    candidates = frozenset(had)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                found: set[str] = set()
                for w in set(document_words(text, lm, cache)):
                    found.update(f for f in word_features(w) if f in candidates)
                out.append(sorted(found))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.string()))], ["y", "f"])

    have = cut(picked.select("text", "y").mapInArrow(counted, "y int, f array<string>"), "features")
    clean_rows = have.filter("y = 0").select(F.explode("f").alias("f")).groupBy("f").count().collect()  # of the candidates only
    n = {r["y"]: r["n"] for r in picked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean = {r["f"]: r["count"] for r in clean_rows}
    pure = frozenset(f for f, k in had.items() if k / (k + clean.get(f, 0) * n.get(1, 0) / max(1, n.get(0, 0))) >= purity)  # what cover can take

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[f for f in own if f in pure] for own in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["f"])

    ids: dict[str, str] = {}  # one object per feature, however many rows have it
    sets = [{ids.setdefault(f, f) for f in r["f"]} for r in have.filter("y = 1").select("f").mapInArrow(kept, "f array<string>").toLocalIterator()]  # of the sample's toxic rows, a quarter of `sample` at most
    lexicon = cover(sets, clean, n.get(0, 0), least, purity)
    draft = ToxicModel(lm, lexicon, ())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([summary(*_matches(t, draft, cache)) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    got = picked.select("text", "y").mapInArrow(summed, "y int, x array<double>").collect()  # `sample` rows at most
    got = sorted((r["y"], *r["x"]) for r in got)
    if not got or got[0][0] == got[-1][0]:
        p = (sum(r[0] for r in got) + 0.5) / (len(got) + 1)
        return ToxicModel(lm, lexicon, (math.log(p / (1 - p)), 0.0, 0.0, 0.0, 0.0, 0.0))
    x = np.array([r[1:] for r in got])
    return ToxicModel(lm, lexicon, tuple(_newton(x, np.array([r[0] for r in got], float)).tolist()))


def score_toxicity(docs: DataFrame, model: ToxicModel, *, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, matches) of each row of docs; matches: how many lexicon matches.

    Null texts are empty and scored as such; rows without id are scored and not held out; repeated rows are each
    scored; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        w = np.array(own.weights)
        for batch in batches:
            got = [_matches(t, own, cache) for t in batch.column(1).to_pylist()]
            score = [float(1 / (1 + np.exp(-np.clip(np.dot(w, summary(*g)), -30, 30)))) for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array([len(g[0]) for g in got], pa.int64())], ["id", "score", "matches"])

    rows = texts_of(docs, id_col, text_col).mapInArrow(run, "id long, score double, matches long")
    return rows.select(F.col("id").alias("doc_id"), in_fold(F.col("id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "matches")
