"""Edge cases of single operators, by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions import vectors as V
from attesta.operators import aggregates as agg
from attesta.operators import filters as flt
from attesta.operators import gate, names, similar, vector_index
from attesta.operators import history as hist


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_histogram_of_one_value_and_of_nothing(spark):
    one = agg.histogram(spark.createDataFrame([(5.0,), (5.0,)], "x double"), F.col("x"))
    assert rows(one) == [(0, 5.0, 5.0, 2)]
    assert rows(agg.histogram(spark.createDataFrame([], "x double"), F.col("x"))) == []


def test_histogram_lists_empty_bins_and_closes_the_last(spark):
    h = rows(agg.histogram(spark.createDataFrame([(0.0,), (12.0,)], "x double"), F.col("x")))
    assert len(h) == 12 and sum(r[3] for r in h) == 2 and max(h)[3] == 1


def test_cap_is_at_least_one(spark):
    df = spark.createDataFrame([("c", "big", i) for i in range(20)] + [("c", "small", 99)], "cell string, owner string, k int")
    kept = agg.capped_per_group(df, ["cell"], "owner", ["k"])
    assert kept.filter("owner = 'big'").count() == 4 and kept.filter("owner = 'small'").count() == 1


def test_auroc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "s double, y int")
    assert agg.auroc(df, "s", "y").first()[0] == pytest.approx(0.875)


def test_auroc_of_continuous_scores_is_ranked_in_ranges(spark):
    data = [((i * 7919 % 1009) / 1009, int(i * 31 % 97 < 40)) for i in range(1009)] + [(None, 1), (float("nan"), 0)]
    area = agg.auroc(spark.createDataFrame(data, "s double, y int"), "s", "y")
    key = lambda s: (0, 0.0) if s is None else (2, 0.0) if s != s else (1, s)
    up, down = [key(s) for s, y in data if y], [key(s) for s, y in data if not y]
    want = sum((u > d) + 0.5 * (u == d) for u in up for d in down) / len(up) / len(down)
    assert area.first()[0] == pytest.approx(want, abs=1e-6)
    window = next(x for x in str(area._jdf.queryExecution().optimizedPlan()).splitlines() if "Window" in x)
    assert ", [bucket#" in window


def test_filters_ignore_what_they_do_not_know(spark):
    df = spark.createDataFrame([("Abc%", 5.0), ("xyz", None)], "name string, price double")
    cat = {"q": flt.contains("name"), "min": flt.number(lambda x: F.col("price") >= x), "kind": flt.choice({"a": F.lit(False)})}
    where, active = flt.build(cat, {"q": "BC%", "min": "many", "kind": "zzz", "other": "1"})
    assert active == ["q"] and rows(df.filter(where).select("name")) == [("Abc%",)]
    where, active = flt.build(cat, {})
    assert active == [] and df.filter(where).count() == 2


def test_cycles_and_changes(spark):
    df = spark.createDataFrame([("k", 1, True), ("k", 2, False), ("k", 3, True), ("k", 4, None), ("k", 5, None)], "k string, t int, on boolean")
    assert rows(hist.cycles(df.filter("on is not null"), "k", ["t"], F.col("on"))) == [("k", 2)]
    assert rows(hist.changes(df, "k", ["t"], F.col("on"))) == [("k", 3)]


def test_bursts(spark):
    df = spark.createDataFrame([("a", d) for d in (0, 3, 6, 20, 27)], "k string, day int")
    assert rows(hist.bursts(df, "k", "day")) == [("a", 0, True), ("a", 20, False), ("a", 27, False), ("a", 3, True), ("a", 6, True)]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "", 2), (3, "d", 2)], "k int, v string, t int")
    assert rows(hist.latest_wins(old, new, ["k"], "t")) == [(1, "a", 1), (2, "", 2), (3, "d", 2)]
    assert rows(hist.fill_empty(old, new, ["k"], "v")) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(hist.insert_absent(old, new, ["k"])) == [(1, "a", 1), (2, "b", 1), (3, "d", 2)]
    assert rows(hist.replace_groups(old, new, ["k"])) == [(1, "a", 1), (2, "", 2), (3, "d", 2)]
    assert rows(hist.merge_keep_old(old, new, ["k"], ["v"])) == [(1, "a", 1, False), (2, "b", 2, False), (3, "d", 2, True)]


def test_shingles(spark):
    df = spark.createDataFrame([("a b c d e",), ("a b",), ("",)], "t string")
    got = [r[0] for r in df.select(T.shingles(T.words(F.col("t")))).collect()]
    assert got == [["a b c d", "b c d e"], ["a b"], []]


def test_containment(spark):
    df = spark.createDataFrame([(1, "g", "a b c d e f g h"), (2, "g", "a b c d e f"), (3, "g", "x y z w v"), (4, "h", "a b c d e f")], "k long, g string, t string")
    assert rows(similar.containment_pairs(df, "k", "g", "t")) == [(1, 2, 1.0)]


def test_shingle_hashes(spark):
    data = [(0, "b a b a b a b"), (1, "a b a"), (2, "a b a b"), (3, "b a b a"), (4, ""), (5, None), (6, "a b"), (7, "B, a b A")]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(data, "k long, t string").repartition(1).select("k", T.shingle_hashes(T.words(F.col("t"))).alias("s")).collect()}
    assert got[4] == [] and got[5] is None and len(got[1]) == len(got[6]) == 1 and got[1] != got[6]
    assert got[0] == sorted(set(got[2]) | set(got[3])) and len(got[0]) == 2 and got[7] == got[3]
    assert spark.createDataFrame([], "k long, t string").select(T.shingle_hashes(T.words(F.col("t")))).collect() == []


def test_containment_loses_nothing(spark):
    import random

    r = random.Random(3)
    passages = [[r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(r.randrange(3, 40))] for _ in range(6)]
    data = []
    for i in range(160):
        w = [x for p in r.sample(passages, r.randrange(1, 4)) for x in p]
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = f"new{r.randrange(30)}"
        data.append((i, r.choice("gh"), " ".join(w)))
    data += [(500, "g", data[0][2].upper()), (500, "g", data[0][2].upper()), (501, "g", data[0][2]), (502, None, data[0][2]), (None, "g", data[0][2]), (503, "g", None), (504, "g", ", ."), (505, "g", "long " * 50000)]
    whole = {k: (g, frozenset(" ".join(w[i : i + 4]) for w in [t.lower().split()] for i in range(max(1, len(w) - 3)))) for k, g, t in data if None not in (k, g, t) and k != 504}
    least, want = {}, []
    for k in sorted(whole):
        least.setdefault(whole[k], k)
    firsts = set(least.values())
    want += [(least[v], k, 1.0) for k, v in whole.items() if least[v] != k]
    for a in firsts:
        for b in firsts:
            (g, x), (h, y) = whole[a], whole[b]
            if a < b and g == h and round(len(x & y) / min(len(x), len(y)), 4) >= 0.6:
                want.append((a, b, round(len(x & y) / min(len(x), len(y)), 4)))
    got = similar.containment_pairs(spark.createDataFrame(data, "k long, g string, t string"), "k", "g", "t").distinct()
    assert rows(got) == sorted(want, key=repr) and len(want) > 100
    assert rows(similar.containment_pairs(spark.createDataFrame([], "k long, g string, t string"), "k", "g", "t")) == []


def test_groups_of_alike_texts_in_a_week(spark):
    import random
    from datetime import date, timedelta

    r = random.Random(6)
    base = [" ".join(r.choice("abcdefghij") + r.choice("xyz") for _ in range(12)) for _ in range(4)]
    data = []
    for i in range(120):
        w = r.choice(base).split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice(["new", "other"])
        data.append((i, r.choice("gh"), " ".join(w), date(2023, 6, 1) + timedelta(days=r.randrange(40))))
    data += [(200, "g", "short one", date(2023, 6, 3)), (201, "g", "Short, one", date(2023, 6, 4)), (202, None, base[0], date(2023, 6, 4)), (203, "g", None, date(2023, 6, 4)), (204, "g", base[0], None)]
    shingles = lambda t: {" ".join(w[i : i + 4]) for w in [t.lower().replace(",", "").split()] for i in range(max(1, len(w) - 3))}
    whole = [d for d in data if None not in d]
    want = []
    for k, g, t, at in whole:
        a = shingles(t)
        near = [b for b in whole if b[1] == g and 0 <= (b[3] - at).days < 7 and len(a & shingles(b[2])) / min(len(a), len(shingles(b[2]))) >= 0.6]
        want.append((k, len(near)))
    df = spark.createDataFrame(data, "k long, g string, t string, d date")
    assert rows(similar.anchored_groups(df, "k", "g", "t", "d")) == sorted(want, key=repr)
    assert max(n for _, n in want) >= 3


def test_cosine_pairs_in_blocks_are_all_pairs(spark):
    data = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(60)]
    df = spark.createDataFrame(data, "k long, v array<float>")
    few, many = (rows(vector_index.near_pairs(df, "k", "v", 0.9, block=b)) for b in (500, 7))
    assert few == many and few


def test_search_of_many_queries_in_blocks_is_brute_force(spark):
    import numpy as np

    data = [(i, [float((i * i * 7 + j * 13) % 17 - 8) for j in range(5)]) for i in range(400)] + [(400, [1.0]), (401, None)]
    df = spark.createDataFrame(data, "k long, v array<float>")
    queries = df.filter("k % 50 = 0").select(F.col("k").alias("q"), F.col("v").alias("qv"))
    few, many = (rows(similar.most_similar(df, "k", "v", queries, 10, block=b)) for b in (1000, 3))

    def cosine(x, y):
        if not x or not y or len(x) != len(y):
            return 0.0
        d = np.linalg.norm(x) * np.linalg.norm(y)
        return round(float(np.dot(x, y) / d), 6) if d else 0.0

    want = []
    for q, x in data:
        if q % 50 == 0:
            want += [(q, k, -c) for c, k in sorted((-cosine(x, y), k) for k, y in data if k != q)[:10]]
    near = [(q, k, pytest.approx(c, abs=1e-6)) for q, k, c in sorted(want, key=repr)]
    assert len(few) == 9 * 10 and few == near and many == near


def test_every_50th_vector_is_asked_for(spark):
    import __spark_entry__ as entry

    asked = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").filter("vec_id % 50 = 0").count()
    got = entry.queries()["J20_every_50th"](spark, "/root/testdata/sf0.01")
    assert got.select("q").distinct().count() == asked > 5 and got.count() == 10 * asked


def test_cosine_of_unequal_lengths_is_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0]), ([0.0], [0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0]


def test_gate_learns_a_direction(spark):
    df = spark.createDataFrame([([float(i % 2), 1.0], float(i % 2)) for i in range(40)] + [(None, 1.0)], "v array<double>, y double")
    w = gate.train(df, "v", "y")
    assert w[0] > 1 and len(w) == 3


def test_ratio(spark):
    df = spark.createDataFrame([("acme trade", "trade acme"), ("", ""), ("ab", "cd")], "a string, b string")
    assert [r[0] for r in df.select(names.token_sort_ratio("a", "b")).collect()] == [100.0, 0.0, 0.0]


def test_daily_series(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", 1)], "ts string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(agg.daily_series(df, "ts", high=F.col("v") > 0)) == [(date(2024, 1, 1), 1, 1)]


def test_hidden_elements_by_a_stack(spark):
    from attesta.operators import injection as inj

    long = "words that nobody sees here"
    cases = {
        f'<div style="display:none"><div>{long}</div> tail</div><p>shown</p>': ([f"{long} tail"], " <p>shown</p>"),
        f'<span hidden>{long}<br>more<img src="a>b"></span>end': ([f"{long} more"], " end"),
        f'a<p style="color: white">{long}': ([long], "a "),
        f"<div aria-hidden='true'><p>{long}</div>z": ([long], " z"),
        f'<div style="opacity: 0.0; x"><script>if (a < b) "</div>"</script>{long}</div>': (None, None),
        f'<br style="display:none">{long}': ([], f'<br style="display:none">{long}'),
        f'</div><div style="left:-9999px">{long}</DIV>y': ([long], "</div> y"),
        '<p style="display:none">short</p>': ([], " "),
        f'<!-- <div hidden> -->{long}': ([], f"<!-- <div hidden> -->{long}"),
        f'<div style="text-indent:-999px"><b style="display:none">{long}</b> x</div>': ([f"{long} x"], " "),
        "": ([], ""),
    }
    df = spark.createDataFrame([(h,) for h in cases] + [(None,)], "h string")
    got = {r[0]: (r[1], r[2]) for r in df.select("h", inj.hidden_blocks(F.col("h")), inj.without_hidden(F.col("h"))).collect()}
    assert got.pop(None) == ([], "")
    for h, want in cases.items():
        if want[0] is not None:
            assert got[h] == want, h
    deep = "<div>" * 20_000 + "<p hidden>" + long
    assert inj.hidden_ranges(deep)[0][3] == len(deep)


def test_cheap_tests_lose_no_line(spark):
    from attesta.operators import injection as inj

    lines = []
    for p in (*inj.ADDRESS, *inj.COMMANDS, *inj.DANGEROUS):
        swapped = p.translate(str.maketrans("aceop", "асеор"))
        lines += [p, f"Then {p.upper()} now", p.replace(" ", "..."), p.replace(" ", "​ "), swapped, "x" + swapped.replace(" ", " - ") + "y"]
    lines += ["plain words", "executive medieval", ""]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    read = F.struct(*(c.alias(k) for k, c in inj._readings(F.col("t")).items()))
    says = F.exists(F.array(read), lambda r: inj._says(r.getField, (*inj.ADDRESS, *inj.COMMANDS, *inj.DANGEROUS)))
    rows_ = df.select("t", says.alias("says")).collect()
    assert not [r["t"] for r in rows_ if r["says"] and not inj.may_say(r["t"])]
    assert sum(r["says"] for r in rows_) > 100 and not inj.may_say("plain words")
