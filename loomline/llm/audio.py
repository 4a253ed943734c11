"""Media columns: audio fingerprints from pitch-class frames, aligned by offset histograms and bit errors."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, arrow_map

#: Samples a second, samples of a frame and from one frame to the next, widest filter in frames.
RATE, FRAME, HOP, WIDTH = 5512, 2048, 682, 16
#: Most share of unlike bits of a match; least share of the shorter one that overlaps.
ERRORS, OVERLAP = 0.2, 0.5
#: Entries, and queries, that one task compares with each other at once.
BLOCK = 2048
#: Codes whose channels a task holds at once; a longer recording is taken alone. A histogram may have 16 times as many cells.
CELLS = 1 << 16
#: Limits of the four steps that a filter's value (a difference of logarithms) falls in.
STEPS = (-0.25, 0.0, 0.25)


def wav_samples(data: bytes) -> np.ndarray:
    """Samples from -1 to 1 of a PCM wave file at RATE, channels averaged; empty if it can't be read."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError, RuntimeError):
        return np.empty(0)
    if width not in (1, 2, 4) or not rate:
        return np.empty(0)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = ((x - 128) / 128 if width == 1 else x / 2.0 ** (8 * width - 1)).reshape(-1, channels).mean(1)
    if rate == RATE or not len(x):
        return x
    if rate > RATE:  # a running mean keeps what is above half the new rate out
        k = max(1, round(rate / RATE))
        x = np.convolve(x, np.ones(k) / k, "same")
    at = np.arange(int(len(x) * RATE / rate)) * (rate / RATE)
    return np.interp(at, np.arange(len(x)), x)


@lru_cache(maxsize=1)
def _bins() -> tuple[np.ndarray, np.ndarray]:
    """Window, and the share of every spectral bin in every pitch class (28 Hz to 2500 Hz)."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    m = np.zeros((len(f), 12))
    ok = (f >= 28) & (f <= 2500)
    m[np.flatnonzero(ok), np.round(12 * np.log2(f[ok] / 440)).astype(int) % 12] = 1
    return np.hanning(FRAME), m


def chroma(x: np.ndarray) -> np.ndarray:
    """One row of 12 pitch-class energies for each frame, smoothed over five frames, of unit length."""
    if len(x) < FRAME:
        return np.zeros((0, 12))
    window, m = _bins()
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    c = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2 @ m
    pad = np.concatenate([c[:1]] * 2 + [c] + [c[-1:]] * 2)
    c = sum(w * pad[k : k + len(c)] for k, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(norm > 1e-9, c / np.maximum(norm, 1e-9), 0.0)


@lru_cache(maxsize=1)
def filters() -> list[tuple[int, int, int, int]]:
    """The sixteen filters (shape, first class, classes, frames), by rule: the six shapes in turn over all classes and widths."""
    return [(n % 6, (5 * n) % 9, 2 + n % 3, (4, 8, 12, 16)[(n // 2) % 4]) for n in range(16)]


def fingerprint(x: np.ndarray) -> np.ndarray:
    """Signed 32-bit codes, one for each place of the widest filter: two Gray-coded bits of each of the sixteen filters."""
    c = chroma(x)
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.int32)
    s = np.zeros((len(c) + 1, 13))
    s[1:, 1:] = c.cumsum(0).cumsum(1)  # the integral image
    first, second = np.empty((2, 16, n))

    def area(t: int, w: int, y: int, h: int) -> np.ndarray:
        return s[t + w : t + w + n, y + h] - s[t : t + n, y + h] - s[t + w : t + w + n, y] + s[t : t + n, y]

    for k, (shape, y, h, w) in enumerate(filters()):
        a, z = area(0, w, y, h), (y + h) % (13 - h)
        if shape == 0:  # the area against the frame's other classes
            b = area(0, w, 0, 12) - a
        elif shape == 1:  # later frames
            a, b = area(0, w // 2, y, h), area(w // 2, w // 2, y, h)
        elif shape == 2:  # the next classes
            b = area(0, w, z, h)
        elif shape == 3:  # opposite quarters
            q = w // 2
            a, b = area(0, q, y, h) + area(q, q, z, h), area(0, q, z, h) + area(q, q, y, h)
        elif shape == 4:  # the middle against both ends
            q = w // 4
            a, b = 2 * area(q, 2 * q, y, h), 2 * (area(0, q, y, h) + area(3 * q, q, y, h))
        else:  # a class against its neighbours
            a, b = area(0, w, y + 1, 1), area(0, w, y, 1) + area(0, w, y + 2, 1)
        first[k], second[k] = a, b
    value = np.log1p(np.maximum(first, 0)) - np.log1p(np.maximum(second, 0))
    step = sum((value >= limit).astype(np.uint32) for limit in STEPS)
    return np.bitwise_or.reduce((step ^ (step >> 1)) << np.arange(30, -1, -2, dtype=np.uint32)[:, None], 0).view(np.int32)


def fingerprints(rows: DataFrame, media_col: str, id_col: str, decode: Callable[[object], np.ndarray] = wav_samples) -> DataFrame:
    """Returns id_col, codes array<int> for every row; decode: what the column holds -> samples at RATE.

    Null media, unreadable files and recordings of under FRAME + (WIDTH - 1) * HOP samples have no codes.
    """
    src = rows.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        codes = [fingerprint(decode(m)) if m is not None else np.empty(0, np.int32) for m in b.column(1).to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, codes)]), pa.int32())
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(codes) if codes else [], pa.int32()))], names=["id", "codes"])

    return arrow_map(src, run, f"id {src.schema['id'].dataType.simpleString()}, codes array<int>").withColumnRenamed("id", id_col)


def _spectra(codes: np.ndarray, lens: np.ndarray, period: int) -> np.ndarray:
    """Spectra (frequency, recording, 48) of rows of codes padded to `period`. A filter's value is a corner of a
    tetrahedron, in three channels, so the product of two values is 3 if they are equal and -1 if they aren't."""
    x = np.zeros((len(codes), period, 48), np.float32)
    bits = codes[..., None] >> np.arange(32, dtype=np.uint32) & np.uint32(1)
    x[:, : codes.shape[1], :32] = np.where((np.arange(codes.shape[1]) < lens[:, None])[..., None], 1 - 2 * bits.astype(np.int8), 0)
    x[..., 32:] = x[..., :32:2] * x[..., 1:32:2]
    return np.ascontiguousarray(np.fft.rfft(x, axis=1).transpose(1, 0, 2))


def _padded(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes and their lengths."""
    lens = np.array([len(c) for c in codes])
    out = np.zeros((len(codes), lens.max()), np.uint32)
    for row, c in zip(out, codes, strict=True):
        row[: len(c)] = c
    return out, lens


def _fast(n: int) -> int:
    """The least length from n on without prime factors over five."""
    while True:
        m = n
        for f in (2, 3, 5):
            while m % f == 0:
                m //= f
        if m == 1:
            return n
        n += 1


def _chunks(codes: list[np.ndarray]) -> list[np.ndarray]:
    """Places of codes by length, in pieces of at most 512 whose padded codes stay within CELLS."""
    order, out, at = np.argsort([len(c) for c in codes], kind="stable"), [], 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 512 and (end - at + 1) * len(codes[order[end]]) <= CELLS:
            end += 1
        out.append(order[at:end])
        at = end
    return out


def _aligned(x: list[np.ndarray], y: list[np.ndarray], errors: float, overlap: float) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Indices into x and y of pairs with at most a share `errors` of unlike bits at an offset, the offset, the shares.

    Each pair of equal filter values votes for the offset between them; one correlation gives the histograms of all
    pairs. An unequal value costs a bit error at least, so an offset with few enough unlike bits has no fewer than
    16 * size - 32 * size * errors votes; only where there are as many are bits compared.
    """
    (x, n), (y, k) = _padded(x), _padded(y)
    period = _fast(int(n.max() + k.max() - np.floor(overlap * min(n.max(), k.max()))))
    rows = max(1, CELLS // period)
    for at in range(0, len(x), rows):
        fx, x1, n1 = _spectra(x[at : at + rows], n[at : at + rows], period), x[at : at + rows], n[at : at + rows]
        step = max(1, 16 * CELLS // (len(x1) * period))
        for to in range(0, len(y), rows):
            fy = _spectra(y[to : to + rows], k[to : to + rows], period).conj().transpose(0, 2, 1)
            for part in range(0, fy.shape[2], step):
                # As equal + unequal = 16 * size and the product is 3 * equal - unequal, equal = (product + 16 * size) / 4.
                product = np.fft.irfft(fx @ fy[..., part : part + step], period, axis=0)
                y1, k1 = (z[to : to + rows][part : part + step] for z in (y, k))
                for off, i, j in _voted(product, n1, k1, errors, overlap):
                    a, b = max(off, 0), max(-off, 0)
                    size = np.minimum(n1[i] - a, k1[j] - b)
                    unlike = np.bitwise_count(x1[i, a : a + size.max()] ^ y1[j, b : b + size.max()])
                    wrong = np.where(np.arange(size.max()) < size[:, None], unlike, 0).sum(1, dtype=np.int64) / (32 * size)
                    ok = wrong <= errors
                    yield at + i[ok], to + part + j[ok], off, wrong[ok]


def _voted(product: np.ndarray, n: np.ndarray, k: np.ndarray, errors: float, overlap: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Offsets that overlap enough and the pairs with enough votes there."""
    (ns, nat), (ks, kat) = (np.unique(z, return_inverse=True) for z in (n, k))
    off = np.arange(1 - ks[-1], ns[-1])
    size = np.minimum(ns[:, None] - np.maximum(off, 0)[:, None, None], ks - np.maximum(-off, 0)[:, None, None])
    least = 48 * size - 4 * np.floor(32 * size * errors) - 1 - 0.01 * size  # less than rounding can take
    least = np.where((size > 0) & (size >= overlap * np.minimum(ns[:, None], ks)), least, np.inf).astype(np.float32)
    for o, need in zip(off.tolist(), least, strict=True):
        if np.isfinite(need).any():
            i, j = np.nonzero(product[o % len(product)] >= (need[0, 0] if need.size == 1 else need[nat[:, None], kat]))
            if len(i):
                yield o, i, j


def _matches(errors: float, overlap: float):
    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": [], "q2": [], "e": [], "e2": [], "off": [], "n": [], "wrong": []})]
        codes, asked = ([np.asarray(c, np.int32).view(np.uint32) for c in z.codes] for z in (entries, queries))
        for a in _chunks(codes):
            for b in _chunks(asked):
                found = [pd.DataFrame({"i": a[i], "j": b[j], "far": abs(off), "off": off, "wrong": w}) for i, j, off, w in _aligned([codes[k] for k in a], [asked[k] for k in b], errors, overlap)]
                if found:
                    f = pd.concat(found).sort_values(["i", "j", "wrong", "far", "off"], ascending=[True, True, True, True, False]).drop_duplicates(["i", "j"])
                    e, q = entries.iloc[f.i], queries.iloc[f.j]
                    found = {"q": q.q, "q2": q.q2, "e": e.e, "e2": e.e2, "off": f.off, "n": e.n, "wrong": f.wrong}
                    out.append(pd.DataFrame({c: np.asarray(v) for c, v in found.items()}))
        return pd.concat(out[1:] or out)

    return run


def align(prints: DataFrame, queries: DataFrame, id_col: str, errors: float = ERRORS, overlap: float = OVERLAP) -> DataFrame:
    """Returns id_col, n_matches, best_id, best_offset, best_errors: one row for each row of queries (id_col, codes), searched in all of prints.

    Recordings with equal codes are one entry. Blocks of entries meet blocks of queries; a histogram of the offsets of
    equal filter values gives each pair the offsets that can have few enough unlike bits, so no match is lost; there
    the share of unlike bits is taken, and the offset with the least (then the least shift) decides. The work grows
    with the entries times the queries, and for each pair a little more than with the sum of their lengths.
    n_matches counts other recordings; the best has the least share, then the least id. Queries without codes or
    matches get 0 and nulls. A null id is searched, but never a best match.
    """
    shared = Shared(prints.sparkSession)
    entries = prints.where(F.size("codes") > 0).groupBy("codes").agg(F.count("*").alias("n"))
    entries = shared.write(entries.withColumn("e", F.xxhash64("codes")).withColumn("e2", F.xxhash64(F.lit(7), "codes")), "entries")
    asked = shared.write(queries.select(F.col(id_col).alias("id"), "codes"), "asked")
    q = shared.write(asked.where(F.size("codes") > 0).select("codes").distinct().select(F.xxhash64("codes").alias("q"), F.xxhash64(F.lit(7), "codes").alias("q2"), "codes"), "q")
    n_e, n_q = (max(1, -(-x.count() // BLOCK)) for x in (entries, q))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.withColumn("a", F.pmod("e", F.lit(n_e)).cast("int")).withColumn("b", every(n_q)).groupBy("a", "b")
    right = q.withColumn("b", F.pmod("q", F.lit(n_q)).cast("int")).withColumn("a", every(n_e)).groupBy("a", "b")
    found = left.cogroup(right).applyInPandas(_matches(errors, overlap), "q long, q2 long, e long, e2 long, off int, n long, wrong double")
    found = shared.write(found, "found")
    sums = found.groupBy("q", "q2").agg(F.sum("n").alias("n"))
    # An entry's least id may be the query itself; then its second least stands for it, so ids join by entry.
    ids = prints.where(F.size("codes") > 0).select(F.col(id_col).alias("other"), F.xxhash64("codes").alias("e"), F.xxhash64(F.lit(7), "codes").alias("e2"))
    two = ids.where("other is not null").groupBy("e", "e2").agg(F.min("other").alias("o1"), F.max("other").alias("o2"))
    keyed = asked.select("id", F.size("codes").alias("size"), F.xxhash64("codes").alias("q"), F.xxhash64(F.lit(7), "codes").alias("q2"))
    near = keyed.join(found, ["q", "q2"]).join(two, ["e", "e2"]).withColumn("other", F.when(~F.col("o1").eqNullSafe(F.col("id")), F.col("o1")).when(~F.col("o2").eqNullSafe(F.col("id")), F.col("o2"))).where("other is not null")
    top = near.groupBy("id", "q", "q2").agg(F.min(F.struct("wrong", "other", "off")).alias("t"))
    # A query that is itself in prints is no other recording.
    itself = ids.select(F.col("other").alias("own_id"), F.col("e").alias("own_q"), F.col("e2").alias("own_q2")).distinct()
    top = top.withColumnsRenamed({"id": "top_id", "q": "top_q", "q2": "top_q2"})
    same = lambda x: [F.col("q") == F.col(f"{x}_q"), F.col("q2") == F.col(f"{x}_q2"), F.col("id").eqNullSafe(F.col(f"{x}_id"))]
    out = keyed.join(sums, ["q", "q2"], "left").join(top, same("top"), "left").join(itself, same("own"), "left").withColumn("own", F.col("own_q").isNotNull().cast("int"))
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("n") - F.col("own"), F.lit(0)).cast("long").alias("n_matches"), F.col("t.other").alias("best_id"), F.col("t.off").alias("best_offset"), F.col("t.wrong").alias("best_errors"))


_NOTE = 700


@lru_cache(maxsize=4)
def _notes(n: int) -> np.ndarray:
    t = np.arange(_NOTE) / RATE
    pitch = 220.0 * 2 ** (((7 * np.arange(n)) % 12 + 12 * (np.arange(n) % 2)) / 12)
    return np.sin(2 * np.pi * pitch[:, None] * t[None, :]) * np.hanning(_NOTE)[None, :]


def sung(vector: list[float | None] | None) -> np.ndarray:
    """A vector as a recording: one note for each component, in fixed pitches, the louder the larger; empty if it has no direction."""
    if not vector or None in vector:
        return np.empty(0)
    x = np.asarray(vector, np.float64)
    norm = np.linalg.norm(x)
    if not np.isfinite(norm) or not norm:
        return np.empty(0)
    loud = np.exp(np.clip(1.5 * x / norm * len(x) ** 0.5, -6, 6))
    return (loud[:, None] * _notes(len(x))).ravel()


def wav_bytes(x: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x / max(1e-9, np.abs(x).max(initial=0)) * 32000).astype("<i2").tobytes())
    return out.getvalue()
