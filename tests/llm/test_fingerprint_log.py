"""The log-structured index: compaction as in a binary counter, a kept index, repeated ids and rows without id."""

import random
from collections import Counter

import pytest
from test_llm_operators import brute_removed, frame, passages

from attesta.llm.anchors import anchor_rows, entries
from attesta.llm.fingerprint_log import FingerprintLog, remove_from_batch, remove_repeats
from attesta.llm.suffix_dedup import remove_passages


def test_runs_compact_to_the_same_counts(spark):
    texts = frame(spark, passages()).selectExpr("doc_id AS id", "text")
    places = entries(anchor_rows(texts, 20, 10))
    log = FingerprintLog(spark, 4)
    whole: Counter = Counter()
    for k in range(7):
        new = log.add(places.filter(f"id % 7 = {k}"))
        whole.update({r["key"]: r["n"] for r in spark.table(new).collect()})
        log.compact()
    assert log.sizes == [4, 3] or sum(log.sizes) == 7 and len(log.runs) <= 3
    held: Counter = Counter()
    for run in log.runs:
        held.update({r["key"]: r["n"] for r in spark.table(run).collect()})
    assert held == whole
    new = log.add(places.filter("id = 90"))
    again = places.join(log.repeated(new), "key", "left_semi")
    assert {r["id"] for r in again.collect()} >= {0, 90}
    log.drop()


def test_batches_against_a_kept_index(spark):
    rows = passages()
    thirds = [[r for r in rows if r[0] < 40], [r for r in rows if 40 <= r[0] < 55], [r for r in rows if r[0] >= 55]]
    log, history, got = FingerprintLog(spark, 4), [], []
    for part in thirds:
        batch = frame(spark, [*part, (None, part[0][1])])
        out = remove_from_batch(log, batch, frame(spark, history) if history else None, most=3)
        got += [tuple(r)[:4] for r in out.collect() if r["doc_id"] is not None]
        assert all(r["n_removed"] == 0 for r in out.filter("doc_id is null").collect())
        history += part
    assert sorted(got) == brute_removed(rows, 20)
    log.drop()


@pytest.mark.parametrize("remove, window", [(remove_repeats, 20), (remove_passages, 50)])
def test_repeated_ids_and_rows_without_id(spark, remove, window):
    rows = passages()
    doubled = [*rows, rows[0], rows[0], (None, rows[3][1]), (None, rows[3][1])]
    got = [tuple(r)[:4] for r in remove(frame(spark, doubled), window=window).collect()]
    want = brute_removed(rows, window)
    own = [x for x in got if x[0] is not None]
    assert sorted(own) == sorted([*want, *[x for x in want if x[0] == rows[0][0]] * 2])
    assert [x[2] for x in got if x[0] is None] == [0, 0]


@pytest.mark.parametrize("remove, window", [(remove_repeats, 20), (remove_passages, 50)])
def test_a_long_periodic_document(spark, remove, window):
    r = random.Random(8)
    unit = " ".join(f"p{r.randrange(10**6)}" for _ in range(60))
    rows = [(1, " ".join([unit] * 400)), (2, unit), (3, "x y " * 3000)]
    got = [tuple(x)[:4] for x in remove(frame(spark, rows), window=window, most=50).collect()]
    assert sorted(got) == brute_removed(rows, window)


def test_words_that_agree_in_half_their_hash_differ(spark):
    """Two words with equal upper halves of their hashes, in otherwise equal windows: nothing is a repeat."""
    import xxhash

    from attesta.llm.fingerprint_log import remove_repeats
    from attesta.llm.suffix_dedup import remove_passages

    a, b = "q31667", "q75341"
    assert xxhash.xxh3_64_intdigest(a) >> 32 == xxhash.xxh3_64_intdigest(b) >> 32
    for window, remove in ((20, remove_repeats), (50, remove_passages)):
        for at in (0, 9, window - 1):
            words = [f"w{i}" for i in range(window)]
            texts = [" ".join([*words[:at], w, *words[at + 1 :]]) for w in (a, b, b)]
            docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
            got = {r["doc_id"]: r["n_removed"] for r in remove(docs, window=window).collect()}
            assert got == {0: 0, 1: 0, 2: window}
