import io
import wave

import numpy as np
import pytest

from gneiss.llm import audio


def tone(notes, rate, width=2, seconds=0.064):
    x = np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * np.arange(round(seconds * rate)) / rate) for k in notes]) * 0.5
    with wave.open(b := io.BytesIO(), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        full = np.round(x * (2 ** (8 * width - 1) - 1)).astype("<i8")
        w.writeframes((full + 128).astype("u1").tobytes() if width == 1 else full.view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
    return b.getvalue()


def brute(query, other):
    best = None
    for k in range(1 - len(query), len(other)):
        a, b = max(0, -k), min(len(query), len(other) - k)
        same, bits = int((query[a:b] == other[a + k : b + k]).sum()), int(np.bitwise_count(query[a:b] ^ other[a + k : b + k]).sum())
        if same >= audio.LEAST_VOTES and b - a >= audio.LEAST_OVERLAP and bits / (32 * (b - a)) <= audio.MOST_ERROR:
            best = max(best or (0,), (same, -bits / (32 * (b - a))))
    return best


@pytest.mark.parametrize("many", [0, 64])
@pytest.mark.parametrize("values", [1, 3, 500])
def test_every_offset_is_judged(values, many, monkeypatch):
    monkeypatch.setattr(audio, "MANY", many)
    monkeypatch.setattr(audio, "PIECE", 50)
    r = np.random.default_rng(values)
    pool = r.integers(0, 2**32, values, np.uint32)
    for n, m in ((40, 60), (60, 40), (17, 90), (5, 5)):
        q, o = r.choice(pool, n), r.choice(pool, m)
        if n == 60:
            o[5:35] = q[20:50]
        got, want = audio.best_offset(q, o), brute(q, o)
        assert (got[1], -got[2]) == (pytest.approx(want) if want else (0, -1.0))


def test_second_offset_counts():
    r = np.random.default_rng(4)
    q, o = r.integers(0, 2**32, 80, np.uint32), r.integers(0, 2**32, 200, np.uint32)
    o[100:180] = q ^ np.uint32(1)  # nearly equal there, with four equal integers
    o[100:104] = q[:4]
    o[[10, 20, 30, 40, 50]] = q[[10, 20, 30, 40, 50]]  # more equal integers at offset 0, all else differs
    assert audio.best_offset(q, o)[:2] == (100, 4)


def test_steady_sound_is_found(spark):
    pitch = lambda hertz: [12 * np.log2(hertz / 220)]
    rows = [(0, tone(pitch(250), 2000, seconds=3)), (1, tone(pitch(250), 2000, seconds=4)), (2, tone(pitch(375), 2000, seconds=3))]
    for i, media in rows:  # whole periods in a hop: one integer again and again
        assert len(set(audio.fingerprint(audio.chroma(*audio.decode(media))).tolist())) == 1, i
    got = audio.align(spark.createDataFrame(rows, "rec bigint, media binary"), "rec", "media").collect()
    assert [(r["query_id"], r["match_id"]) for r in got] == [(0, 1)]


def test_rates_and_widths(spark):
    notes = np.random.default_rng(6).integers(0, 24, 80).tolist()
    kinds = [(2000, 2), (44100, 2), (8000, 1), (48000, 3), (3000, 4)]
    rows = [(i, tone(notes, *kind)) for i, kind in enumerate(kinds)] + [(9, tone(notes[::-1], 44100))]
    got = audio.align(spark.createDataFrame(rows, "rec bigint, media binary"), "rec", "media").collect()
    assert sorted(r["match_id"] for r in got) == [1, 2, 3, 4] and all(r["bit_error"] < 0.1 and r["offset"] == 0 for r in got)


def test_damaged_and_silent_media_match_nothing(spark):
    r = np.random.default_rng(11)
    notes = r.integers(0, 24, 80).tolist()
    good = tone(notes, 2000)
    silent = io.BytesIO()
    with wave.open(silent, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(2000)
        w.writeframes(b"\0" * 20_000)
    rate0 = good[:24] + b"\0\0\0\0" + good[28:]
    bad = [good[:k] for k in range(0, 60, 3)] + [rate0, silent.getvalue(), b"RIFF", b"\xff" * 100]
    for k in range(300):  # any header with a few bytes changed
        x = bytearray(good)
        for at in r.integers(0, 44, 3):
            x[at] = r.integers(0, 256)
        audio.printed(bytes(x))
    rows = [(0, good), (50, good[:-1]), (100, silent.getvalue()), (150, silent.getvalue()), *[(1000 + i, b) for i, b in enumerate(bad)]]
    got = audio.align(spark.createDataFrame(rows, "rec bigint, media binary"), "rec", "media").collect()
    found = {(r["query_id"], r["match_id"]) for r in got}
    assert {(100, None), (150, None)} <= found and all(m in (0, 50, None) for _, m in found) and len([f for f in found if f[0] in (0, 50) and f[1] is not None]) >= 2


def test_silent_ends_are_no_match():
    r = np.random.default_rng(12)
    a, b = r.integers(0, 2**32, 60, np.uint32), r.integers(0, 2**32, 60, np.uint32)
    quiet = np.full(50, audio.SILENT, np.uint32)
    assert audio.best_offset(np.concatenate([quiet, a]), np.concatenate([b, quiet]))[1] == 0
    assert audio.best_offset(np.concatenate([quiet, a]), np.concatenate([a, quiet]))[:2] == (-50, 60)


def test_hot_integers(spark, monkeypatch):
    """Recordings that all share some integers meet in several tasks, and no match is lost."""
    monkeypatch.setattr(audio, "HOT_VALUES", 10)
    monkeypatch.setattr(audio, "SALTS", 3)
    r = np.random.default_rng(13)
    intro, songs = r.integers(0, 24, 30).tolist(), [r.integers(0, 24, 60).tolist() for _ in range(12)]
    rows = [(i * 25, tone(intro + songs[i % 12], 2000)) for i in range(12)] + [(1000 + i, tone(intro + songs[i][: 40 + i], 2000)) for i in range(12)]
    frame = spark.createDataFrame(rows, "rec bigint, media binary")
    prints = {i: audio.printed(m) for i, m in rows}
    want = {(q, i) for q, p in prints.items() if q % 50 == 0 for i, o in prints.items() if i != q and audio.best_offset(p, o)[1]}
    got = audio.align(frame, "rec", "media").collect()
    assert {(r["query_id"], r["match_id"]) for r in got if r["match_id"] is not None} == want and len(want) > 6
