"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from attesta.llm import decontaminate, matroska, packing, pii, quality_rules, toxicity, url_filter
from attesta.llm.components import components
from attesta.llm.fingerprint_log import remove_repeats
from attesta.llm.near_dedup import keep_first, near_duplicates
from attesta.llm.suffix_dedup import remove_passages

SCHEMA = "doc_id long, text string, id string, n int, key string, u long, spans string, length int"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "k", 2, "s", 3) for i, t in rows], SCHEMA)


def sentences(seed, n, size=120, vocabulary=400):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(vocabulary)}" for _ in range(size)) for _ in range(n)]


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


ODD = [(None, "no id here"), (900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (904, "ONE"), (905, "ñandú ünïcode é"), (906, "tie tie tie tie"), (907, "z " * 5000)]


def sets_of(text, n):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, num, den):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {}
    parent = {i: i for i in ids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    rows = [(i, sets_of(t, n)) for i, t in rows if i is not None]
    for i, s in rows:
        sets[i] = s
    for a, s in rows:
        for b, t in rows:
            if a < b and s and t and den * len(s & t) >= num * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_are_the_components(spark, n):
    base = sentences(1, 6)
    rows = [(10 * k, t) for k, t in enumerate(base)] + [(100 + i, edited(base[i % 3], (i % 7) * 0.02, i)) for i in range(150)] + ODD
    got = near_duplicates(frame(spark, rows), shingle=n, num=4, den=5).collect()
    want = brute_components(rows, n, 4, 5)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])


def test_keep_first(spark):
    t = sentences(2, 1)[0]
    docs = frame(spark, [(1, t), (2, t), (3, t.upper()), (4, None), (4, None), (None, t)])
    kept = keep_first(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "4", "None"]


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{100 + i: 100 for i in range(1, 20)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removed(rows, window):
    seen, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if seen.setdefault(k, (i, s)) != (i, s):
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def passages():
    t = sentences(3, 12, 200, 5000)
    shared = " ".join(sentences(4, 1, 70, 5000))
    rows = [(i, x) for i, x in enumerate(t)]
    rows += [(50 + i, f"{sentences(60 + i, 1, 15 + i)[0]} {shared} {sentences(80 + i, 1, 9)[0]}") for i in range(12)]
    rows += [(90, t[0]), (91, t[1][:600] + " " + t[2][200:]), (92, ("a b c " * 60)), (93, shared + "\n" + shared)]
    return rows


@pytest.mark.parametrize("remove, window", [(remove_repeats, 20), (remove_passages, 50)])
def test_removal_is_that_of_all_windows(spark, remove, window):
    rows = passages() + [r for r in ODD if r[0] != 904]
    got = [tuple(r)[:4] for r in remove(frame(spark, rows), window=window).collect() if r["doc_id"] is not None]
    assert sorted(got) == brute_removed(rows, window)


def test_removal_of_groups_dealt_in_parts(spark):
    rows = passages()
    got = [tuple(r)[:4] for r in remove_passages(frame(spark, rows), window=50, most=2).collect()]
    assert sorted(got) == brute_removed(rows, 50)


def test_no_documents(spark):
    none = frame(spark, [])
    assert near_duplicates(none).count() == 0 and remove_repeats(none).count() == 0 and remove_passages(none).count() == 0
    assert matroska.media_columns(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert decontaminate.decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    model = pii.train(none)
    assert pii.find_spans(none, model).count() == 0


def test_packing_places_every_token_once(spark):
    rows = [(i, t) for i, t in enumerate(sentences(5, 40, 30) + sentences(6, 5, 900) + ["", "  two  spaces\n\nlines ", "a<|endoftext|>b", "naïve café — ok x"])] + [(99, None), (99, None), (None, "x")]
    got = packing.pack_documents(frame(spark, rows), with_ids=True).collect()
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own[:-1]])) and sum(r["length"] for r in own) <= 1024
    for i, text in rows:
        if i not in (None, 99):
            mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
            assert b"".join(bytes(r["ids"]) for r in mine) == np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()
            assert all(r["length"] == 1024 for r in mine[1:])
    assert len(by) <= 1 + sum(r["length"] for r in got) // 1024 * 1.2


def test_plan_is_tight():
    r = random.Random(1)
    counts = {}
    for _ in range(3000):
        n = r.choice([r.randrange(1, 1025), r.randrange(1, 200)])
        counts[n] = counts.get(n, 0) + 1
    bins = packing.plan(counts, 1024)
    used = {}
    for many, own in bins:
        assert sum(own) <= 1024 and sum(3 * n > 1024 for n in own) <= 2
        for n in own:
            used[n] = used.get(n, 0) + many
    assert used == counts
    assert sum(m for m, _ in bins) <= 1.02 * sum(n * c for n, c in counts.items()) / 1024 + 1


def test_matroska_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 70_000), (5, "abc"), (5, "abc")]
    media = matroska.media_columns(frame(spark, rows))
    for r, d in zip(sorted(media.collect(), key=lambda r: r["doc_id"]), sorted(matroska.media_digests(media).collect(), key=lambda r: r["doc_id"])):
        text = dict(rows)[r["doc_id"]] or ""
        payload = text.encode() + bytes(-len(text.encode()) % 64 or (0 if text else 64))
        assert d["payload_sha256"] == hashlib.sha256(payload).hexdigest() and d["n_bytes"] == len(text.encode()) and d["tail_crc32"] == zlib.crc32(payload[-64:])
        got = matroska.parse(bytes(r["media"]))
        assert got["ok"] and len(got["cues"]) == len(got["clusters"]) and got["clusters"] == [c[2] for c in got["cues"]]
    assert matroska.packet_table(media).filter("doc_id = 4").count() > 100


@pytest.mark.parametrize("sizes", [[5], [4, 4, 4], [300, 20, 700, 1]])
def test_lacing(sizes):
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    flag, body = matroska.lace(frames)
    block = b"\x81\x00\x05" + bytes([flag << 1]) + body
    track, when, ranges = matroska.frames_of(block, 0, len(block))
    assert (track, when) == (1, 5) and [block[a : a + n] for a, n in ranges] == frames
    xiph = b"\x81\x00\x00\x02" + bytes([len(frames) - 1]) + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + b"".join(frames)
    assert [xiph[a : a + n] for a, n in matroska.frames_of(xiph, 0, len(xiph))[2]] == frames


def test_damaged_media_gives_what_is_whole():
    data = matroska.mux(b"q" * 300_000)
    got = matroska.parse(data[: len(data) // 2])
    assert not got["ok"]
    assert not matroska.parse(b"\x00\x01")["ok"]


def distance(a, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_contamination_is_that_of_the_edit_distance(spark):
    items = [(i, t) for i, t in enumerate(sentences(7, 6, 25, 3000))]
    r, docs = random.Random(3), []
    for k in range(40):
        item = list(items[k % 6][1])
        for _ in range(k // 2):
            p = r.randrange(len(item))
            item[p : p + r.choice([0, 1])] = r.choice(["", "#", "##"])
        docs.append((k, f"{sentences(100 + k, 1, 20)[0]}  {''.join(item).upper()}\n{sentences(200 + k, 1, 15)[0]}"))
    bench = spark.createDataFrame([*items, (50, None), (None, "x"), (51, "short")], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(frame(spark, docs + ODD), bench).collect()}
    for k, text in docs:
        want = [i for i, t in items if distance(x := decontaminate.normalise(t), decontaminate.normalise(text)) <= decontaminate.budget(len(x), 0.1)]
        assert got[k] == ",".join(map(str, want))
    assert got[900] == "" and got[None] == ""
    kept = decontaminate.drop_contaminated(frame(spark, docs + ODD), bench)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if not v}


NAIVE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def naive_spans(text):
    out = []
    for kind, pattern in NAIVE.items():
        for m in re.finditer(pattern, text):
            d = pii.digits_of(m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(NAIVE).index(s[2])))


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(5)
    alphabet = "0123456789" * 2 + "ab.@+-() %_" * 2
    for _ in range(3000):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
        assert pii.base_spans(t) == naive_spans(t), t


def test_tagger_gradient():
    from attesta.llm.pii_tagger import Tagger

    r = np.random.default_rng(0)
    m = Tagger.new(3, 1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    c, y = r.integers(0, 40, (2, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [5, 6, 0, 0, 7, 8, 8]])
    _, g = m.loss(c, y)
    for name, place in (("h", (0, 1, 2)), ("h", (1, 2, 10)), ("out", (4, 2)), ("moves", (1, 2)), ("b", (1, 0, 5)), ("x", (0, int(c[0, 2]), 3))):
        at = []
        for step in (1e-3, -1e-3):
            m.p[name][place] += step
            at.append(m.loss(c, y)[0])
            m.p[name][place] -= step
        assert (at[0] - at[1]) / 2e-3 == pytest.approx(g[name][place], rel=0.05, abs=2e-3)


def test_personal_data(spark):
    docs = frame(spark, [(i, f"{sentences(i, 1, 20)[0]} write to ann{i}@mail{i}.example.com or +1 (555) 010-{1000 + i} from 10.0.{i}.7 now") for i in range(60)] + ODD)
    model = pii.train(docs, sample=40, most=120)
    rows = pii.span_digest(pii.find_spans(docs, model)).collect()
    assert len(rows) == 60 + len(ODD)
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 60:
            assert (r["n_email"], r["n_ip"], r["n_phone"]) == (1, 1, 1)
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs, model).collect()}
    assert "[EMAIL]" in clean[3] and "@" not in clean[3] and clean[900] is None and clean[903] == "one"


def test_quality_rules_separate(spark):
    good = [(i, (" ".join(sentences(i, 1, 60)) + ". ") * 2) for i in range(300)]
    bad = [(1000 + i, "BUY!! NOW!! " * 30 if i % 2 else "a | b | c " * 40) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, good + bad + ODD)
    model = quality_rules.train(docs, labels)
    got = quality_rules.score_quality(docs, model).collect()
    assert len(got) == 600 + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and (r["doc_id"] < 300 or r["doc_id"] >= 1000)]
    assert held and all((r["predicted"] == 1) == (r["doc_id"] < 300) for r in held)
    kept = quality_rules.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id < 300").count() == 300 and kept.filter("doc_id >= 1000").count() == 0


def test_quality_of_one_class(spark):
    docs = frame(spark, [(1, "x"), (2, None)])
    model = quality_rules.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_rules.score_quality(docs, model).collect()} == {0.5}


def test_toxicity_finds_disguised_words(spark):
    clean = [(i, t) for i, t in enumerate(sentences(11, 240, 30, 300))]
    toxic = [(1000 + i, f"{t} {'idiot' if i % 2 else 'scumbag'}") for i, t in enumerate(sentences(12, 120, 25, 300))]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic], "doc_id long, quality int, toxic int")
    probe = [(2000, "some 1d10t here w1 w2"), (2001, "an i d i o t again w3"), (2002, "iiidiooot w4 w5"), (2003, "plain w6 w7 w8"), (2004, "i-d-i-o-t w9")]
    docs = frame(spark, clean + toxic + probe + ODD)
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[i] == 1 for i, _ in toxic) and sum(got[i] for i, _ in clean) == 0
    assert [got[i] for i in range(2000, 2005)] == [1, 1, 1, 0, 1]
    assert got[900] == 0


def test_urls(spark):
    schema = "page_id long, url string, host string, bad int, n int"
    urls = [(1, "https://WWW.Example.com/en/1"), (2, "http://example.com/en/2"), (3, "http://a.net/es/3"), (4, None), (5, "nothing"), (6, "http://bad.org/x?y"), (6, "http://bad.org/x?y"), (7, "http://x.co.uk:80"), (8, "ftp://[::1]/"), (None, "http://good.org/1")]
    pages = spark.createDataFrame([(i, u, "h", 1, 1) for i, u in urls] + [(100 + i, f"http://bad.org/{i}", "h", 1, 1) for i in range(60)] + [(200 + i, f"http://good.org/{i}", "h", 1, 1) for i in range(60)], schema)
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(200 + i, 0) for i in range(60)], "page_id long, bad int")
    got = url_filter.filter_urls(pages, outcomes, url_filter.RULES).collect()
    assert len(got) == len(urls) + 120
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and by[2][2:] == ("example.com/en/", "block")
    assert by[3][2:] == ("net/es/", "block") and by[4][:3] == ("", "", None) and by[5][:3] == ("", "", None)
    assert by[6] == ("bad.org", "/x", None, "block") and by[None][3] == "allow"
    none = url_filter.filter_urls(pages.limit(0), outcomes.limit(0), url_filter.RULES)
    assert none.count() == 0


def test_repetitive_texts_are_counted_without_listing_pairs(monkeypatch):
    """A long text of one character against a repetitive item: little time and memory; and the same bands either way."""
    import random
    import time
    import tracemalloc

    from attesta.llm import decontaminate as d

    items = d.Items([(1, b"a" * 300)], 0.1)
    tracemalloc.start()
    began = time.time()
    assert items.find(b"a" * 1_000_000) == [(1, 0, 0)]
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    r = random.Random(1)
    for _ in range(150):
        letters = r.choice(["a", "ab", "abc"])
        word = lambda n: "".join(r.choice(letters) for _ in range(n)).encode()
        rows = [(i, word(r.randrange(8, 120))) for i in range(3)]
        base = bytearray(r.choice(rows)[1])
        for _ in range(r.randrange(6)):
            base[r.randrange(len(base))] = ord(r.choice("abz"))
        text, items = word(r.randrange(200)) + bytes(base) + word(r.randrange(200)), d.Items(rows, 0.1)
        found = []
        for pairs in (10**9, 0):
            monkeypatch.setattr(d, "PAIRS", pairs)
            found.append(items.find(text))
        assert found[0] == found[1]
