import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomline.llm import audio


def brute(prints, queries, own=True):
    """Every offset of every recording."""
    out = []
    for i, q in queries:
        found = []
        for j, x in prints:
            best = None
            for off in range(1 - len(q), len(x)):
                pairs = [(x[b + off], q[b]) for b in range(len(q)) if 0 <= b + off < len(x)]
                wrong = sum(((u ^ v) & 0xFFFFFFFF).bit_count() for u, v in pairs) / max(1, 32 * len(pairs))
                if pairs and len(pairs) >= audio.OVERLAP * min(len(x), len(q)) and wrong <= audio.ERRORS:
                    best = min(best or (2,), (wrong, abs(off), -off, off))
            if best:
                found.append((best[0], j, best[3]))
        others = [f for f in found if f[1] is not None and f[1] != i]
        best = min(others) if others else (None, None, None)
        out.append((str(i), max(0, len(found) - own), best[1], best[2], best[0] and round(best[0], 9)))
    return sorted(out)


def tune(seed, seconds=9.0):
    rnd = np.random.default_rng(seed)
    t = np.arange(int(0.3 * audio.RATE)) / audio.RATE
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (rnd.integers(0, 24) / 12) * t) * np.hanning(len(t)) for _ in range(int(seconds / 0.3))])


def test_align_against_brute_force(spark):
    rnd = np.random.default_rng(0)
    a, b = tune(1), tune(2)
    media = [a, a + 0.02 * rnd.standard_normal(len(a)), a[audio.HOP * 7 :], b, a, tune(3), tune(4, 30.0), np.zeros(60_000), a[:900]]
    rows = [(i, audio.wav_bytes(m), 1) for i, m in enumerate(media)] + [(20, None, 1), (21, b"nonsense", 1), (22, b"", 1), (None, audio.wav_bytes(b), 1), (3, audio.wav_bytes(b), 1)]
    df = spark.createDataFrame(rows, "rec_id long, audio binary, codes int")
    prints = audio.fingerprints(df, "audio", "rec_id").cache()
    got = [(r.rec_id, r.codes) for r in prints.collect()]
    plain = [(i, audio.fingerprint(audio.wav_samples(m)).tolist() if m else []) for i, m, _ in rows]
    assert sorted(map(str, got)) == sorted(map(str, plain))
    once = prints.dropDuplicates(["rec_id"])
    found = sorted((str(r[0]), r[1], r[2], r[3], r[4] and round(r[4], 9)) for r in audio.align(prints, once, "rec_id").collect())
    assert found == brute(plain, [(i, x) for k, (i, x) in enumerate(plain) if i not in [p[0] for p in plain[:k]]])
    by = {f[0]: f for f in found}
    assert by["2"][2] in (0, 1, 4) and abs(by["2"][3]) == 7 and by["5"][1] == 0
    assert audio.align(prints.limit(0), once.limit(0), "rec_id").count() == 0


def test_queries_that_are_not_in_prints(spark):
    prints = [(1, [5, 6, 7]), (2, [5, 6, 7]), (3, [8])]
    queries = [(9, [5, 6, 7]), (3, [5, 6, 7]), (4, [8]), (5, [])]
    frame = lambda rows: spark.createDataFrame(rows, "rec_id long, codes array<int>")
    found = sorted((str(r[0]), r[1], r[2], r[3], r[4] and round(r[4], 9)) for r in audio.align(frame(prints), frame(queries), "rec_id").collect())
    assert found == brute(prints, queries, own=False)
    assert found[2][:3] == ("5", 0, None)


def plain_fingerprint(x):
    """The codes, sum by sum, from the pitch classes."""
    c = audio.chroma(x)
    area = lambda t, w, y, h: c[t : t + w, y : y + h].sum()
    out = []
    for t in range(len(c) - audio.WIDTH + 1):
        code = 0
        for shape, y, h, w in audio.filters():
            z, q, o = (y + h) % (13 - h), w // 2, w // 4
            a, b = {
                0: lambda: (area(t, w, y, h), area(t, w, 0, 12) - area(t, w, y, h)),
                1: lambda: (area(t, q, y, h), area(t + q, q, y, h)),
                2: lambda: (area(t, w, y, h), area(t, w, z, h)),
                3: lambda: (area(t, q, y, h) + area(t + q, q, z, h), area(t, q, z, h) + area(t + q, q, y, h)),
                4: lambda: (2 * area(t + o, 2 * o, y, h), 2 * (area(t, o, y, h) + area(t + 3 * o, o, y, h))),
                5: lambda: (area(t, w, y + 1, 1), area(t, w, y, 1) + area(t, w, y + 2, 1)),
            }[shape]()
            step = sum(np.log1p(max(a, 0)) - np.log1p(max(b, 0)) >= s for s in audio.STEPS)
            code = code << 2 | (0, 1, 3, 2)[step]
        out.append(code)
    return np.array(out, np.uint32).view(np.int32)


def test_fingerprint_against_plain_sums():
    for x in (tune(6, 6.0), tune(7, 5.0)):
        got, want = audio.fingerprint(x), plain_fingerprint(x)
        assert len(got) == len(want) > 20
        # A value that lies at a step may fall to either side.
        assert np.bitwise_count((got ^ want).view(np.uint32)).sum() <= 2


def test_wave_files():
    x = tune(5)
    same = audio.wav_samples(audio.wav_bytes(x))
    assert np.abs(same / np.abs(same).max() - x / np.abs(x).max()).max() < 1e-3
    twice = np.interp(np.arange(2 * len(x)) / 2, np.arange(len(x)), x)
    a, b = audio.fingerprint(x), audio.fingerprint(audio.wav_samples(audio.wav_bytes(twice, 2 * audio.RATE)))
    n = min(len(a), len(b))
    assert np.bitwise_count((a[:n] ^ b[:n]).view(np.uint32)).sum() / (32 * n) < 0.1


def test_sung():
    rnd = np.random.default_rng(1)
    v = rnd.standard_normal(64)
    near, far = v + 0.15 * rnd.standard_normal(64), rnd.standard_normal(64)
    a, b, c = (audio.fingerprint(audio.sung(list(x))) for x in (v, near, far))
    err = lambda x, y: np.bitwise_count((x ^ y).view(np.uint32)).mean() / 32
    assert len(a) > 20 and err(a, b) < audio.ERRORS < err(a, c)
    assert len(audio.sung(None)) == len(audio.sung([0.0, 0.0])) == len(audio.sung([None, 1.0])) == len(audio.sung([float("nan")])) == 0


def test_every_match_by_bit_errors_alone(spark, monkeypatch):
    monkeypatch.setattr(audio, "BLOCK", 8, raising=False)  # several blocks
    rnd, rows = np.random.default_rng(3), []
    for g in range(12):
        x = rnd.integers(0, 2**32, 2 if g == 0 else 48, dtype=np.uint32)
        flips = (rnd.random((len(x), 32)) < (0.0, 0.12, 0.18)[g % 3]) @ (1 << np.arange(32, dtype=np.uint64))
        y = (x ^ flips.astype(np.uint32))[0 if g == 0 else g :]
        rows += [(2 * g, x.view(np.int32).tolist()), (2 * g + 1, y.view(np.int32).tolist())]
    rows.append((24, []))
    prints = spark.createDataFrame(rows, "rec_id long, codes array<int>")
    want = []
    for i, q in rows:
        found = []
        for j, x in rows:
            for off in range(1 - len(q), len(x)):
                pairs = [(x[b + off], q[b]) for b in range(len(q)) if 0 <= b + off < len(x)]
                wrong = sum(((u ^ v) & 0xFFFFFFFF).bit_count() for u, v in pairs) / max(1, 32 * len(pairs))
                if pairs and j != i and len(pairs) >= audio.OVERLAP * min(len(x), len(q)) and wrong <= audio.ERRORS:
                    found.append((wrong, j, off))
        want.append((i, len({j for _, j, _ in found}), *(min(found, key=lambda f: (f[0], f[1], abs(f[2])))[1:] if found else (None, None))))
    assert sum(w[1] > 0 for w in want) == 24
    assert sorted((r.rec_id, r.n_matches, r.best_id, r.best_offset) for r in audio.align(prints, prints, "rec_id").collect()) == want


def test_histograms_lose_no_match_of_any_length(monkeypatch):
    monkeypatch.setattr(audio, "CELLS", 96)  # pieces of few recordings, and recordings alone
    rnd = np.random.default_rng(5)
    x = [rnd.integers(0, 2**32, n, dtype=np.uint32) for n in (1, 2, 3, 7, 20, 21, 40, 40, 150, 300)]
    damage = lambda c, p: c ^ ((rnd.random((len(c), 32)) < p) @ (1 << np.arange(32, dtype=np.uint64))).astype(np.uint32)
    y = [damage(c[s : s + n], p) for c in x for s, n, p in ((0, 400, 0.0), (0, 400, 0.19), (2, 30, 0.15), (5, 200, 0.2)) if len(c) > s]
    frame = lambda z, a: pd.DataFrame({a: range(len(z)), a + "2": 0, "n": 1, "codes": [c.view(np.int32) for c in z]})
    found = audio._matches(audio.ERRORS, audio.OVERLAP)(frame(x, "e"), frame(y, "q").drop(columns="n"))
    want = []
    for q, b in enumerate(y):
        for e, a in enumerate(x):
            best = []
            for off in range(1 - len(b), len(a)):
                u, v = a[max(off, 0) :], b[max(-off, 0) :]
                size = min(len(u), len(v))
                wrong = np.bitwise_count(u[:size] ^ v[:size]).sum() / (32 * size)
                if size >= audio.OVERLAP * min(len(a), len(b)) and wrong <= audio.ERRORS:
                    best.append((wrong, abs(off), -off))
            if best:
                want.append((q, e, -min(best)[2], round(min(best)[0], 9)))
    assert len(want) > len(x) * 2
    assert sorted(zip(found.q, found.e, found.off, found.wrong.round(9), strict=True)) == want
