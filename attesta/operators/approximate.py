"""Approximate terms in long texts: the best ratio of a term with any part of the text, against a limit, without trying all parts.

The ratio of a term of n characters and a part of the same length is 100 * L / n, L their longest common subsequence. To
reach `least`, all but e = floor((1 - least / 100) * n) characters of the term must be in the part, in order, with at
most e others between them. So if the term is cut into 2 e + 1 segments, one of them stands whole in the part, at most e
places from where it would be. Only parts around such a segment are compared: those of all texts of a batch at once, with
one bit per character of the term. At a text's ends the parts are shorter; there are few of them, and each is compared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from attesta.operators.names import common, partial

BITS = 62


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _around(codes: np.ndarray, term: np.ndarray, e: int) -> np.ndarray:
    """Starts of the parts that have a segment of the term whole, at most e places from its own."""
    n, starts = len(term), []
    edges = [n * i // (2 * e + 1) for i in range(2 * e + 2)]
    for a, b in zip(edges, edges[1:]):
        at = np.flatnonzero(codes[: len(codes) - (b - a) + 1] == term[a])
        for j in range(1, b - a):
            at = at[codes[at + j] == term[a + j]]
        starts += [at - a + shift for shift in range(-e, e + 1)]
    out = np.unique(np.concatenate(starts))
    return out[(out >= 0) & (out + n <= len(codes))]


def longest_common(codes: np.ndarray, starts: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The longest common subsequence of the term and the part of its length at each start."""
    n = len(term)
    if n > BITS:
        whole = "".join(map(chr, term))
        return np.array([common("".join(map(chr, codes[s : s + n])), whole) for s in starts.tolist()], np.int64)
    bits, letters = {}, term.tolist()
    for i, c in enumerate(letters):
        bits[c] = bits.get(c, 0) | 1 << i
    known = np.array(sorted(bits), np.uint32)
    mask_of = np.array([bits[int(c)] for c in known] + [0], np.uint64)
    full = np.uint64((1 << n) - 1)
    v = np.full(len(starts), full, np.uint64)
    for i in range(n):
        c = codes[starts + i]
        k = np.minimum(np.searchsorted(known, c), len(known) - 1)
        u = v & mask_of[np.where(known[k] == c, k, len(known))]
        v = ((v + u) | (v - u)) & full
    return n - np.bitwise_count(v).astype(np.int64)


def _at_ends(text: str, term: str, least: float) -> bool:
    n = len(term)
    for k in range(n - 1, math.ceil(least * n / (200 - least) - 1e-9) - 1, -1):
        need = least * (n + k) / 200 - 1e-9
        if common(text[:k], term) >= need or common(text[-k:], term) >= need:
            return True
    return False


def holds(texts: list[str], term: str, least: float) -> np.ndarray:
    """Whether the best ratio of the term with any part of each text is `least` or more; see names.partial."""
    out = np.array([bool(term) and term in t for t in texts], bool)
    n = len(term)
    e = math.floor((1 - least / 100) * n + 1e-9)
    short = [i for i, t in enumerate(texts) if not out[i] and t and term and len(t) <= n]
    for i in short:
        out[i] = partial(term, texts[i]) >= least - 1e-9
    rest = [i for i, t in enumerate(texts) if not out[i] and len(t) > n > 0]
    if e > 0 and rest:
        if 2 * e + 1 > n:
            for i in rest:
                out[i] = partial(term, texts[i]) >= least - 1e-9
            return out
        codes = _codes("".join(texts[i] for i in rest))
        ends = np.cumsum([len(texts[i]) for i in rest])
        own = _codes(term)
        starts = _around(codes, own, e)
        text_of = np.searchsorted(ends, starts, side="right")
        inside = starts + n <= ends[np.minimum(text_of, len(ends) - 1)]
        starts, text_of = starts[inside], text_of[inside]
        hit = 100 * longest_common(codes, starts, own) >= least * n - 1e-9
        out[np.array(rest)[np.unique(text_of[hit])]] = True
    for i in rest:
        if not out[i]:
            out[i] = _at_ends(texts[i], term, least)
    return out


def terms_held(text: Column, terms: list[str], least: float = 88.0) -> Column:
    """Array of the terms that a text holds, whole or at `least` or more alike; of a null text none. Equal texts of a batch are read once."""
    stated = sorted(set(terms))

    @F.pandas_udf(ArrayType(StringType()))
    def found(texts: pd.Series) -> pd.Series:
        which, distinct = pd.factorize(texts.fillna(""))
        each = [[] for _ in distinct]
        for term in stated:
            for i in np.flatnonzero(holds(list(distinct), term, least)):
                each[i].append(term)
        return pd.Series([each[i] for i in which])

    return found(text)


def name_held(name: Column, text: Column, least: float = 80.0) -> Column:
    """Whether a row's text holds its name, whole or at `least` or more alike; nulls are empty and hold nothing."""

    @F.pandas_udf(BooleanType())
    def found(names: pd.Series, texts: pd.Series) -> pd.Series:
        names, texts = names.fillna(""), texts.fillna("")
        out = np.zeros(len(names), bool)
        for term, at in names.groupby(names, sort=False).indices.items():
            for i in range(0, len(at), 256):
                some = at[i : i + 256]
                out[some] = holds(texts.iloc[some].tolist(), term, least)
        return pd.Series(out)

    return found(name, text)
