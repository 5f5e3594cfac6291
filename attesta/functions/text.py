"""Column functions on text: normal forms, hashes, shingles, masks and counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(text: Column) -> Column:
    """Lower case, words only, single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def text_hash(text: Column) -> Column:
    return F.sha1(normal(text).cast("binary"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def shingles(word_list: Column, size: int = 4) -> Column:
    """Distinct runs of `size` words; of fewer words, all as one; of none, none."""
    n = F.greatest(F.size(word_list) - (size - 1), F.lit(0))
    runs = F.slice(word_list, F.lit(1), n)  # zipped with its shifts: a lambda over places would evaluate word_list at each
    for j in range(1, size):
        runs = F.zip_with(runs, F.slice(word_list, F.lit(j + 1), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(word_list) == 0, F.array().cast("array<string>")).when(F.size(word_list) < size, F.array(F.array_join(word_list, " "))).otherwise(F.array_distinct(runs))


def shingle_hashes(word_list: Column, size: int = 4) -> Column:
    """Distinct 64-bit hashes of the shingles, sorted; of fewer words, all as one; of none, none; of null, null.

    One Arrow batch at a time: its different words are hashed once, runs of hashes are mixed for the whole batch, and no
    string is built. Words are a column of their own to it, so that what splits the text is evaluated once a row.
    """

    @F.arrow_udf("array<bigint>")
    def hashed(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().fill_null("").dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
        known = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
        h = known[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        runs = h[: max(0, len(h) - size + 1)]
        for j in range(1, size):
            runs = _mixed(runs, h[j : j + len(runs)])
        found = []
        for end, n in zip(ends.tolist(), lengths.tolist()):
            start = end - n
            if n >= size:
                found.append(np.unique(runs[start : end - size + 1].view(np.int64)))
            elif n:
                whole = np.full(1, n, np.uint64)
                for at in range(start, end):
                    whole = _mixed(whole, h[at : at + 1])
                found.append(whole.view(np.int64))
            else:
                found.append(np.zeros(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=lists.is_null())

    return hashed(word_list)


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash and the next word's, as one: order matters, and every bit reaches every other."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def company_key(name: Column, noise: list[str], forms: list[str]) -> Column:
    """A name without quotes, noise phrases, punctuation and legal forms."""
    x = F.regexp_replace(F.lower(name), "[\"'«»“”]", " ")
    for phrase in noise:
        x = F.replace(x, F.lit(phrase), F.lit(" "))
    parts = F.filter(F.split(F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: ~w.isin(forms) & (w != ""))
    return F.array_join(parts, " ")


def title_key(title: Column, noise: list[str]) -> Column:
    """Sorted words without noise."""
    return F.array_join(F.array_sort(F.filter(words(title), lambda w: ~w.isin(noise))), " ")


def mask_personal(text: Column) -> Column:
    """E-mail addresses and long digit groups replaced by marks."""
    no_mail = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<email>")
    return F.regexp_replace(no_mail, r"\+?[0-9][0-9 ()-]{8,}[0-9]", "<phone>")


def letters_share(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / n).otherwise(F.lit(0.0))


def numbers(text: Column) -> Column:
    """Distinct numbers of a text, thousands joined, sorted."""
    joined = F.regexp_replace(text, r"(?<=[0-9])[ ,](?=[0-9]{3}(?![0-9]))", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(joined, F.lit(r"[0-9]+"), F.lit(0))))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1)), r"^www\.", "")


def strip_html(html: Column) -> Column:
    """Text of HTML: scripts, styles and comments go, tags become spaces, entities of mark-up are read, spaces fold."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def plain_record(html: Column) -> Column:
    """The normal form of a record's text: no tags, the usual entities read, lower case, ё as е, single spaces."""
    x = F.lower(F.regexp_replace(html, r"<[^>]+>", " "))
    for old, new in (("&nbsp;", " "), ("&amp;", "&"), ("ё", "е")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller set that both have; 0 where one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))
