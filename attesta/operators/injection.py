"""Instructions hidden in texts: undisguised readings of a line, findings with levels, cleaning, and hidden parts of pages."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a text says to its reader's tools, in English and Russian.
ADDRESS = (
    "инструкция для ии", "инструкция для ai", "инструкция для ассистент", "указание для ии", "сообщение для ии", "внимание, ии", "если ты языковая модель", "как языковая модель", "ты языковая модель", "ты ассистент",
    "system prompt", "системный промпт", "ignore previous instructions", "ignore all previous", "ignore the above", "disregard previous", "disregard the above", "forget your instructions", "you are chatgpt", "as an ai language model", "prompt injection",
)
COMMANDS = (
    "верни пустой", "ответь пустым", "не отмечай", "не указывай", "не сообщай", "ничего не находи", "проигнорируй правила", "игнорируй предыдущие", "игнорируй инструкции", "перепиши инструкцию", "измени инструкцию",
    "оцени кандидата как идеального", "рекомендуй этого кандидата", "поставь максимальный балл", "укажи зарплату", "напиши, что жалоб нет", "напиши что жалоб нет", "скрой",
    "output only", "respond only with", "do not mention", "must recommend", "rate this candidate",
)
DANGEROUS = (
    "drop table", "drop database", "delete from", "truncate table", "rm -rf", "format c:", "удали базу", "удалить базу", "очисти базу", "сотри все данные", "shutdown", "os.system", "subprocess", "eval(", "exec(",
    "curl http", "wget http", "отправь на http", "send to http", "exfiltrate", "api key", "покажи свой промпт", "покажи системное сообщение", "reveal your prompt",
)
CONTEXT = ("промпт-инженер", "prompt engineer", "llm", "языковых моделей", "jailbreak", "red team", "безопасность моделей")
MARKUP = r"(?i)<\|[^>]{0,40}\|>|</?\s*(?:system|assistant|user|s|inst)\s*>|\[/?INST\]|\[/?SYS\]|^\s*(?:system|assistant)\s*:"
BASE64 = r"[A-Za-z0-9+/]{120,}={0,2}"
INVISIBLE = "[­​-‏‪-‮⁠-⁤⁪-⁯﻿\U000e0000-\U000e007f]"
SEPARATORS = r"[\s._*·•|/\\-]+"
CYRILLIC, LATIN = "асеорхукмнтві", "aceopxykmhtbi"
MIXED = r"(?:[a-z]+[а-яё]|[а-яё]+[a-z])[a-zа-яё]*"
LEVELS = {"assistant_address": "red", "hidden_command": "red", "hidden_html": "red", "dangerous": "red", "command": "yellow", "markup": "yellow", "invisible": "yellow", "homoglyph": "yellow", "base64": "yellow"}
HIDING = (
    r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?:\.0+)?(?:px|em|rem|pt)?\b|opacity\s*:\s*0(?:\.0+)?\b|color\s*:\s*(?:#fff(?:fff)?\b|white\b)"
    r"|text-indent\s*:\s*-\d{3,}|(?:left|top)\s*:\s*-\d{4,}px|\bhidden\b|\baria-hidden\s*=\s*[\"']?true"
)


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(p)) for p in phrases))


def undisguised(text: Column) -> Column:
    """Lower case, without invisible characters, look-alike letters read as Latin, separators as single spaces."""
    return F.regexp_replace(F.translate(F.lower(F.regexp_replace(text, INVISIBLE, "")), CYRILLIC, LATIN), SEPARATORS, " ")


def squeezed(text: Column) -> tuple[Column, Column]:
    """The letters alone: as they are, and with look-alikes read as Latin."""
    tight = F.regexp_replace(F.lower(text), r"[^\p{L}]", "")
    return tight, F.translate(tight, CYRILLIC, LATIN)


def as_latin(phrases: Iterable[str]) -> list[str]:
    """Phrases as texts with look-alikes read as Latin have them."""
    return [p.translate(str.maketrans(CYRILLIC, LATIN)) for p in phrases]


def glued(phrases: Iterable[str]) -> list[str]:
    return [g for p in phrases if len(g := "".join(c for c in p if c.isalpha())) >= 8]


def _readings(text: Column) -> dict[str, Column]:
    tight, latin = squeezed(text)
    return {"low": F.lower(text), "plain": undisguised(text), "tight": tight, "latin": latin}


def _says(read, phrases: tuple[str, ...]) -> Column:
    """Whether any reading has one of the phrases; read: name of a reading to its column."""
    return contains_any(read("low"), phrases) | contains_any(read("plain"), as_latin(phrases)) | contains_any(read("tight"), glued(phrases)) | contains_any(read("latin"), as_latin(glued(phrases)))


_PHRASES = (*ADDRESS, *COMMANDS, *DANGEROUS)
_GONE = {ord(c): None for c in " \t\n\r\x0b\x0c._*·•|/\\-"}
_LONG = glued(_PHRASES)
_SHORT = [p.translate(_GONE) for p in _PHRASES if sum(c.isalpha() for c in p) < 8]
_UNSEEN, _MARKED, _CODED, _TO_LATIN = re.compile(INVISIBLE), re.compile(MARKUP, re.M), re.compile(BASE64), str.maketrans(CYRILLIC, LATIN)
_LONG_LATIN, _SHORT_LATIN = as_latin(_LONG), as_latin(_SHORT)


_OTHER, _CYRILLIC_LETTER = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]"), re.compile("[а-яёА-ЯЁ]")
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_LONG_BYTES, _SHORT_BYTES = ([p.encode() for p in dict.fromkeys(own) if p.isascii()] for own in ((*_LONG, *_LONG_LATIN), (*_SHORT, *_SHORT_LATIN)))
_SEPARATOR_BYTES = b" \t\n\r\x0b\x0c._*|/\\-"


def may_say(text: str) -> bool:
    """Whether a text can have any of the phrases, by its letters alone and by its characters other than separators. None that does is lost."""
    low = text.lower()
    if not _OTHER.search(low):  # Latin letters and ASCII: whatever separates letters is one byte
        data = low.encode()
        tight, close = data.translate(None, _NO_LETTERS), data.translate(None, _SEPARATOR_BYTES)
        return any(p in tight for p in _LONG_BYTES) or any(p in close for p in _SHORT_BYTES)
    tight, close = "".join(filter(str.isalpha, low)), _UNSEEN.sub("", "".join(low.translate(_GONE).split()))
    latin, near = tight.translate(_TO_LATIN), close.translate(_TO_LATIN)
    return any(p in tight for p in _LONG) or any(p in latin for p in _LONG_LATIN) or any(p in close for p in _SHORT) or any(p in near for p in _SHORT_LATIN)


def has_sign(text: str) -> bool:
    """Whether a text can have any sign of an injection: phrases, invisible characters, mark-up, long codes, mixed alphabets."""
    if not text.isascii() and (_UNSEEN.search(text) or _CYRILLIC_LETTER.search(text)):
        return True
    return may_say(text) or bool(("<" in text or "[" in text or ":" in text) and _MARKED.search(text)) or len(text) >= 120 and bool(_CODED.search(text))


def _lines_with(text: Column, sign) -> Column:
    """Array of (line, t) of a text's lines with a sign; the text as a whole is asked first."""
    @F.pandas_udf("array<struct<line:int,t:string>>")
    def some(texts: pd.Series) -> pd.Series:
        def of(x: str | None) -> list[dict]:
            return [{"line": i, "t": t} for i, t in enumerate(x.split("\n")) if sign(t)] if x and sign(x) else []

        return texts.map(of)

    return some(text)


def findings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, code, level) of each suspicious line; line -1: invisible characters somewhere, where no command hides by them.

    Lines without any sign, nearly all, are left out by a cheap test before a line is read in four ways.
    """
    c = F.col
    some = rows.select(key, contains_any(F.lower(c(text)), CONTEXT).alias("soft"), F.explode(_lines_with(c(text), has_sign)).alias("r"))
    read = some.select(key, "soft", "r.line", "r.t").filter(F.trim("t") != "").withColumns(_readings(c("t")))
    judged = read.select(key, "soft", "line", "t", c("t").rlike(INVISIBLE).alias("hidden"), _says(c, ADDRESS).alias("address"), _says(c, COMMANDS).alias("command"), _says(c, DANGEROUS).alias("danger"))
    own = Window.partitionBy(key)
    quiet = F.max("hidden").over(own) & ~F.max(c("hidden") & c("command")).over(own) & (c("line") == F.min("line").over(own))
    yellow = c("soft") & ~c("command") & ~c("hidden")
    mixed = F.filter(F.regexp_extract_all(F.lower("t"), F.lit(MIXED), F.lit(0)), lambda w: F.length(w) > 3)
    rules = [
        ("dangerous", c("danger")),
        ("assistant_address", c("address")),
        ("hidden_command", c("command") & c("hidden")),
        ("command", c("command") & ~c("hidden") & ~c("address")),
        ("markup", c("t").rlike(MARKUP)),
        ("base64", c("t").rlike(BASE64)),
        ("homoglyph", F.size(mixed) >= 2),
        ("invisible", c("quiet")),
    ]
    level = lambda code: F.when(yellow, "yellow").otherwise("red") if code == "assistant_address" else F.lit(LEVELS[code])
    line = lambda code: F.lit(-1) if code == "invisible" else c("line")
    every = F.array_compact(F.array(*(F.when(on, F.struct(line(code).alias("line"), F.lit(code).alias("code"), level(code).alias("level"))) for code, on in rules)))
    return judged.withColumn("quiet", quiet).select(key, F.explode(every).alias("f")).select(key, "f.line", "f.code", "f.level")


def report(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, level, n, codes) of every row; codes sorted, comma-joined."""
    per = found.groupBy(key).agg(F.max(F.col("level") == "red").alias("red"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))
    out = rows.select(key).join(per, key, "left")
    level = F.when(F.col("red"), "red").when(F.col("n") > 0, "yellow").otherwise("clean")
    return out.select(key, level.alias("level"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("codes", F.lit("")).alias("codes"))


def cleaned(text: Column) -> Column:
    """Invisible characters and mark-up go, then the lines that address, command or endanger; blank lines fold to one."""
    body = F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), MARKUP.replace("(?i)", "(?im)"), " ")
    phrases = _PHRASES
    read = F.transform(_lines_with(body, may_say), lambda r: F.struct(r["line"].alias("line"), *(c.alias(k) for k, c in _readings(r["t"]).items())))
    bad = F.transform(F.filter(read, lambda r: _says(r.getField, phrases)), lambda r: r["line"])
    each = F.transform(F.split(body, "\n"), lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    held = F.array(F.struct(each.alias("each"), bad.alias("bad")))  # bound once, for the lines to ask
    kept = F.flatten(F.transform(held, lambda s: F.transform(F.filter(s["each"], lambda r: ~F.array_contains(s["bad"], r["i"])), lambda r: r["t"])))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"), r"^[ \n\t\r]+|[ \n\t\r]+$", "")


TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())  # fixed: elements without end
RAW = frozenset(("script", "style", "textarea", "title"))  # fixed: elements whose text holds no tags
HIDES = re.compile(HIDING.replace(r"\bhidden\b", r"(?<![\w-])hidden(?![\w-])"), re.I)


def hidden_ranges(html: str) -> list[tuple[int, int, int, int]]:
    """(start, start of text, end of text, end) of the outermost elements that mark-up hides.

    A stack of open elements: an end tag closes the innermost element of its name and all that is open within it; one
    without such an element is ignored. Elements without end hold nothing. What is open at the end ends there.
    """
    out, stack, hidden, raw = [], [], None, None

    def close(depth: int, at: int, end: int) -> None:
        nonlocal hidden
        del stack[depth:]
        if hidden is not None and hidden[0] >= depth:
            out.append((hidden[1], hidden[2], at, end))
            hidden = None

    for tag in TAG.finditer(html):
        name = (tag[2] or "").lower()
        if not name or raw and not (tag[1] and name == raw):
            continue
        raw = None
        if tag[1]:
            depth = max((i for i, n in enumerate(stack) if n == name), default=None)
            if depth is not None:
                close(depth, tag.start(), tag.end())
        elif name not in VOID and not tag[3].endswith("/"):
            if hidden is None and HIDES.search(tag[3]):
                hidden = len(stack), tag.start(), tag.end()
            stack.append(name)
            raw = name if name in RAW else None
    close(0, len(html), len(html))
    return out


def _pages(html: Column, kind, of) -> Column:
    @F.pandas_udf(kind)
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: of(x or ""))

    return run(html)


def hidden_blocks(html: Column, least: int = 20) -> Column:
    """The texts of the outermost elements that mark-up hides, of at least so many characters; of a null page none."""
    def texts(page: str) -> list[str]:
        found = (" ".join(TAG.sub(" ", page[a:b]).split()) for _, a, b, _ in hidden_ranges(page))
        return [t for t in found if len(t) >= least]

    return _pages(html, "array<string>", texts)


def without_hidden(html: Column) -> Column:
    """Pages with a space in place of each hidden element."""
    def shown(page: str) -> str:
        parts, at = [], 0
        for a, _, _, b in hidden_ranges(page):
            parts.append(page[at:a])
            at = b
        return " ".join([*parts, page[at:]])

    return _pages(html, "string", shown)


def html_findings(rows: DataFrame, key: str, html: str) -> DataFrame:
    """Findings of pages: each hidden block, and those of the text without tags; lines are those of that text."""
    hidden = rows.select(key, F.posexplode(hidden_blocks(F.col(html))).alias("line", "t")).select(key, "line", F.lit("hidden_html").alias("code"), F.lit("red").alias("level"))
    text = rows.select(key, F.regexp_replace(html, r"<[^>]+>", " ").alias("t"))
    return hidden.unionByName(findings(text, key, "t"))
