"""The parser on files that this library does not write: other rates, deep nesting, damage, no packets, null media."""

import numpy as np

from attesta.llm import matroska as M


def file_of(audio, blocks, extra=b""):
    track = M.element(M.TRACK, M.number(M.NUMBER, 1) + M.number(M.KIND, 2) + extra + M.element(M.AUDIO, audio))
    cluster = M.element(M.CLUSTER, M.number(M.TIME, 0) + b"".join(blocks))
    return M.HEADER + M.element(M.SEGMENT, M.element(M.INFO, M.number(M.SCALE, 1_000_000)) + M.element(M.TRACKS, track) + cluster)


def laced(frames):
    flag, body = M.lace(frames)
    return M.element(M.SIMPLE, b"\x81\x00\x00" + bytes([flag << 1]) + body)


def rate(hz, kind=">f8"):
    return M.element(M.RATE, np.array(hz, kind).tobytes())


def test_times_follow_the_rate():
    block = laced([bytes(4800)] * 3)
    assert [p[2] for p in M.parse(file_of(rate(48_000), [block]))["packets"]] == [0, 100, 200]
    assert [p[2] for p in M.parse(file_of(rate(8_000, ">f4"), [block]))["packets"]] == [0, 600, 1200]
    wide = rate(48_000) + M.number(M.CHANNELS, 2) + M.number(M.DEPTH, 16)
    assert [p[2] for p in M.parse(file_of(wide, [block]))["packets"]] == [0, 25, 50]


def test_times_follow_the_default_duration():
    got = M.parse(file_of(rate(48_000), [laced([b"a", b"bcd", b"e"])], M.number(M.DURATION, 20_000_000)))
    assert [p[2] for p in got["packets"]] == [0, 20, 40] and got["ok"]


def test_deep_nesting_is_no_error():
    body = b""
    for _ in range(3000):
        body = M.element(M.GROUP, body)
    got = M.parse(M.HEADER + M.element(M.SEGMENT, body))
    assert got["ok"] and got["packets"] == []


def test_no_packets_and_null_media(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, bytearray(b""), 0), (None, bytearray(M.HEADER), 0), (4, bytearray(b"\x00"), 0)], "doc_id long, media binary, n_bytes long")
    got = M.media_digests(rows).collect()
    assert len(got) == 4 and all("nan" not in r["feature"] and r["payload_bytes"] == 0 for r in got)
    assert M.packet_table(rows).count() == 0


def test_unknown_sizes():
    block = laced([b"abc"])
    unknown = M.CLUSTER.to_bytes(4, "big") + b"\xff" + M.number(M.TIME, 5) + block
    got = M.parse(M.HEADER + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + unknown + unknown)
    assert got["ok"] and [(p[0], p[2]) for p in got["packets"]] == [(0, 5), (1, 5)]


def test_absurd_numbers_are_damage(spark):
    """Rates, times and scales that no 64-bit time holds: the file is damaged, what came before is kept, nothing is raised."""
    import numpy as np

    from attesta.llm import matroska as m

    good = m.mux(b"x" * 128)
    rate = np.float64(m.HZ).tobytes()[::-1]
    times = m.number(m.TIME, 0)
    files = [good.replace(rate, np.float64(v).tobytes()[::-1]) for v in (5e-324, float("inf"), float("nan"), -1.0, 1e300)]
    for width in (8, 9, 12, 200):
        files.append(m.HEADER + m.element(m.SEGMENT, m.SETUP + m.element(m.CLUSTER, m.element(m.TIME, b"\xff" * width) + m.element(m.SIMPLE, b"\x81\x00\x00\x80abc"))))
    files.append(good.replace(m.number(m.SCALE, 1_000_000), m.element(m.SCALE, b"\xff" * 8)))
    files.append(m.HEADER + m.element(m.SEGMENT, m.SETUP + m.element(m.CUES, m.element(m.CUE, m.element(m.CUE_TIME, b"\xff" * 40) + m.element(m.CUE_POSITIONS, m.number(m.CUE_TRACK, 1))))))
    assert times in good
    told = [m.parse(f) for f in files]
    assert [t["ok"] for t in told].count(False) >= 9
    assert all(-(2**63) <= p[2] < 2**63 for t in told for p in t["packets"])
    media = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "doc_id long, media binary")
    assert m.packet_table(media).count() == sum(len(t["packets"]) for t in told)
