"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics are Spark column expressions. Small boosted trees are fitted on a bounded sample of labelled rows' statistics;
every path of every tree becomes a rule, a conjunction of thresholds; lasso logistic regression weighs the rules and
drops most of them; what remains is compiled back into one Spark column expression, the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import texts_of


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; counts as log(1 + count), shares of characters or words; all 0 for an empty text.

    Characters are counted by how much shorter the text gets without them, so that no match becomes a string of its own.
    """
    n = F.length(text).cast("double")
    words = F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")
    n_words = F.size(words).cast("double")
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("double")
    literal = lambda s: (n - F.length(F.replace(text, F.lit(s), F.lit("")))) / float(len(s))
    share = lambda x, of: F.when(of > 0, x / of).otherwise(F.lit(0.0))
    upper, digit = n - without(r"\p{Lu}++"), n - without(r"[0-9]++")
    letter, symbol = without(r"[^\p{L}]++"), without(r"[\p{L}\p{N}\s.,;:!?'\"()@-]++")
    shout, bar, again = literal("!!"), literal("|"), F.regexp_count(text, F.lit(r"(?<!\S)(\S++) \1(?!\S)")).cast("double")
    stop, lines = literal(".") + literal("!") + literal("?"), literal("\n") + 1
    return {
        "chars": F.log1p(n),
        "words": F.log1p(n_words),
        "word_length": share(n, n_words),
        "distinct_share": share(F.size(F.array_distinct(words)).cast("double"), n_words),
        "upper_share": share(upper, n),
        "symbol_share": share(symbol, n),
        "symbols": F.log1p(symbol),
        "digit_share": share(digit, n),
        "shouts": F.log1p(shout),
        "shout_share": share(shout, n_words),
        "bars": F.log1p(bar),
        "bar_share": share(bar, n_words),
        "repeats": F.log1p(again),
        "repeat_share": share(again, n_words),
        "stop_share": share(stop, n_words),
        "letter_share": share(letter, n),
        "words_per_line": share(n_words, lines),
    }


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, threshold) of each condition


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], rows: np.ndarray, depth: int, least: int, path: tuple) -> list[tuple]:
    """The paths of one tree on binned statistics x, inner nodes' included."""
    found = [path] if path else []
    if depth == 0 or len(rows) < 2 * least:
        return found
    best, split = 1e-6, None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f, e in enumerate(edges):
        if not len(e):
            continue
        cg, ch, c = (np.cumsum(np.bincount(x[rows, f], w, len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
        gain = cg**2 / (ch + 1.0) + (total_g - cg) ** 2 / (total_h - ch + 1.0) - total_g**2 / (total_h + 1.0)
        gain[(c < least) | (len(rows) - c < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best:
            best, split = gain[k], (f, k)
    if split:
        f, k = split
        left = x[rows, f] <= k
        for side, above in ((rows[left], False), (rows[~left], True)):
            found += grow(x, g, h, edges, side, depth - 1, least, (*path, (f, above, float(edges[f][k]))))
    return found


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, bins: int = 64, least: int = 20) -> list[tuple]:
    """The paths of `trees` boosted trees, each on half of the rows."""
    r = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] if len(x) else e for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        rules = grow(binned, g, h, edges, np.flatnonzero(r.random(len(y)) < 0.5), depth, least, ())
        found |= dict.fromkeys(rules)
        z += 0.3 * _tree_values(binned, g, h, edges, rules, depth)
    return list(found)


def covers(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in path:
        out &= (x[:, f] > t) if above else (x[:, f] <= t)
    return out


def _tree_values(binned: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], rules: list[tuple], depth: int) -> np.ndarray:
    """The step of each row: that of the longest path of the tree that covers it."""
    out = np.zeros(len(binned))
    for path in sorted(rules, key=len):
        on = np.ones(len(binned), bool)
        for f, above, t in path:
            k = int(np.searchsorted(edges[f], t))
            on &= (binned[:, f] > k) if above else (binned[:, f] <= k)
        out[on] = -g[on].sum() / (h[on].sum() + 1.0)
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of L1-penalised logistic regression (accelerated proximal gradient)."""
    n = len(y)
    w, b, v, c, t = np.zeros(a.shape[1]), 0.0, np.zeros(a.shape[1]), 0.0, 1.0
    u = np.random.default_rng(0).normal(size=a.shape[1])
    for _ in range(20):
        u = a.T @ (a @ u)
        u /= np.linalg.norm(u) + 1e-12
    rate = 1 / (0.25 * (np.linalg.norm(a @ u) ** 2 / n + 1) + 1e-9)
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(a @ v + c))) - y
        new = v - rate * (a.T @ e / n)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        c_new, t_new = c - rate * e.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), c_new + (t - 1) / t_new * (c_new - b)
        w, b, t = new, c_new, t_new
    return w, b


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self, stats: dict[str, Column]) -> Column:
        """The model as one column expression: the probability of label 1."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            on = F.lit(True)
            for name, above, t in rule:
                on = on & ((stats[name] > F.lit(t)) if above else (stats[name] <= F.lit(t)))
            z = z + F.when(on, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = 30, depth: int = 3, penalty: float = 3e-4, seed: int = 3) -> RuleModel:
    """Fit on statistics x (rows by names) and labels y; one class or no rows give a constant."""
    if len(y) == 0 or y.min() == y.max():
        p = (float(y.sum()) + 0.5) / (len(y) + 1)
        return RuleModel((), float(np.log(p / (1 - p))))
    paths = boosted_rules(x, y, trees, depth, seed)
    a = np.stack([covers(x, p) for p in paths], axis=1).astype(np.float32) if paths else np.zeros((len(y), 0), np.float32)
    w, b = lasso(a, y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-3)
    return RuleModel(tuple((tuple((names[f], above, t) for f, above, t in paths[i]), float(w[i])) for i in kept), float(b))


def in_fold(id_: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves `fold` when divided by `folds`; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", folds: int = 3, fold: int = 1, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Fit on at most `sample` labelled rows, the first by hash of id, that are not in the held-out fold."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null").filter(~in_fold(F.col("id"), folds, fold)).groupBy("id").agg(F.max("y").alias("y"))
    some = F.broadcast(rows.orderBy(F.xxhash64("id"), "id").limit(sample))  # at most `sample` rows
    picked = texts_of(docs, id_col, text_col).join(some, "id")
    stats = statistics(F.col("text"))
    got = picked.select("id", "y", *(c.alias(k) for k, c in stats.items())).toPandas().sort_values("id", kind="stable").head(2 * sample)
    return fit(got[list(stats)].to_numpy(float), got["y"].to_numpy(float), list(stats))


def score_quality(docs: DataFrame, model: RuleModel, *, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs.

    Null texts are empty and scored as such; rows without id are scored and not held out; repeated rows are each
    scored; other columns are ignored; an empty table gives no rows.
    """
    stats = statistics(F.col("text"))
    rows = texts_of(docs, id_col, text_col).select("id", *(c.alias(k) for k, c in stats.items()))
    scored = rows.select(F.col("id").alias("doc_id"), in_fold(F.col("id"), folds, fold).alias("held_out"), model.score({k: F.col(k) for k in stats}).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel, *, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score `least` or more; a null text scores as an empty one."""
    stats = statistics(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    # Statistics in one projection, which shares what they have in common; a generator after it keeps the filter above it,
    # so that they are not computed again for each rule.
    rows = docs.select("*", *(c.alias(f"__stat_{k}") for k, c in stats.items()))
    scored = rows.select("*", F.explode(F.array(model.score({k: F.col(f"__stat_{k}") for k in stats}))).alias("__score"))
    return scored.filter(F.col("__score") >= least).select(*(F.col(f"`{c}`") for c in docs.columns))
