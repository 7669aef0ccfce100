"""op8: integral images, alignment against brute force, recall under noise, odd media."""

import io
import random
import wave

import numpy as np

from quillon.llm import audio as au


def wav(samples, rate=au.RATE, channels=1):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.repeat(samples, channels) * 30000).astype("<i2").tobytes())
    return buffer.getvalue()


def melodies(seed, n, notes=64):
    r = random.Random(seed)
    return [[r.gauss(0, 0.125) for _ in range(notes)] for _ in range(n)]


def prints(samples):
    return au.fingerprint(au.chroma(samples, au.RATE))


def test_filters_against_plain_sums():
    image = np.random.default_rng(1).random((40, 12))
    got = au.fingerprint(image)
    for x in (0, 7, 24):
        code = 0
        for kind, y, h, w in au.FILTERS:
            box = image[x : x + w, y : y + h]
            if kind == 0:
                a, b = box.sum() / h, (image[x : x + w].sum() - box.sum()) / (12 - h)
            elif kind == 1:
                a = box[:, : h // 2].sum()
            elif kind == 2:
                a = box[: w // 2].sum()
            elif kind == 3:
                a = box[: w // 2, : h // 2].sum() + box[w // 2 :, h // 2 :].sum()
            elif kind == 4:
                a = box[:, h // 4 : h // 4 + h // 2].sum()
            else:
                middle = box[w // 3 : 2 * (w // 3)].sum()
                a, b = 2 * middle, box.sum() - middle
            if kind not in (0, 5):
                b = box.sum() - a
            code = code << 2 | int(au.GRAY[np.searchsorted(au.STEPS, (a - b) / (a + b + 1e-9), side="right")])
        assert got[x] == code
    assert len(au.fingerprint(image[: au.WIDEST - 1])) == 0


def brute(queries, rows):
    """(query, row) whose best offset of all has few enough bit errors."""
    out = set()
    for q, a in queries:
        for i, b in rows:
            best = min((bits / (32 * n) for o in range(-len(b), len(a) + 1) if (found := au.errors_at(a, b, o))[0] >= au.MIN_OVERLAP for n, bits in [found]), default=1)
            if best <= au.MAX_ERRORS and q != i:
                out.add((q, i))
    return out


def test_recall_against_brute_force():
    rng = np.random.default_rng(3)
    rows, base = [], []
    for i, m in enumerate(melodies(4, 25)):
        samples, _ = au.read_wave(au.recording(m))
        base.append(samples)
        rows.append((10 * i, prints(samples)))
        rows.append((10 * i + 1, prints(samples + rng.normal(0, 0.05, len(samples)))))
        rows.append((10 * i + 2, prints(samples[int(rng.integers(300, 6000)) :])))
        rows.append((10 * i + 3, prints(np.concatenate([base[i - 1][:3000], samples[:24_000]]))))
    queries = [(i, p) for i, p in rows if i % 10 == 0]
    index = au.QueryIndex([i for i, _ in queries], [p for _, p in queries])
    got = {(m[0], i) for i, p in rows for m in index.matches(p) if m[0] != i}
    want = brute(queries, rows)
    assert len(want) >= 50 and got <= want and len(got & want) >= 0.9 * len(want)
    assert all((q, q + 1) in got for q, _ in queries)


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(au, "BLOCK", 600)
    monkeypatch.setattr(au, "STEP", 50)
    tunes = melodies(5, 4)
    media = [(100 * i, au.recording(t)) for i, t in enumerate(tunes)] + [(1, au.recording(tunes[1])), (1, au.recording(tunes[1])), (2, None), (3, b"no medium"), (4, b""), (5, wav(np.zeros(20_000))), (300, wav(np.zeros(200))), (None, au.recording(tunes[2])), (6, wav(np.sin(np.arange(16_000) / 9.0), au.RATE, 2))]
    frame = spark.createDataFrame(media, "id long, medium binary").selectExpr("id as rec", "medium as clip", "1 as id", "2 as prints")
    known = au.materialize(spark, au.fingerprints(frame, au.read_wave, "rec", "clip"), "k")
    found = au.align(spark, known, known.where("id % 100 = 0"))
    got = {}
    for r in found.collect():
        got.setdefault(r.id, []).append((r.n_matches, r.best_query, r.best_offset, r.best_errors))
    assert sum(map(len, got.values())) == len(media)
    assert got[1] == [(1, 100, 0, 0)] * 2 and got[None] == [(1, 200, 0, 0)]
    assert all(g == [(0, None, None, None)] for i, g in got.items() if i in (2, 3, 4, 5, 6, 0, 100, 200))
    assert au.align(spark, known.limit(0), known.limit(0)).count() == 0


def test_all_alignments_are_in_the_result(spark, monkeypatch):
    """Every query that aligns is listed, those of equal integers once with their number; a row is not its own match."""
    monkeypatch.setattr(au, "BLOCK", 1500)
    rng = np.random.default_rng(5)
    rows = []
    for i, m in enumerate(melodies(6, 6)):
        samples, _ = au.read_wave(au.recording(m))
        rows += [(100 * i, wav(samples)), (100 * i + 600, wav(samples)), (100 * i + 1200, wav(samples + rng.normal(0, 0.02, len(samples)))), (100 * i + 1, wav(samples[900:])), (100 * i + 2, wav(samples))]
    known = au.materialize(spark, au.fingerprints(spark.createDataFrame(rows, "id long, clip binary"), au.read_wave, "id", "clip"), "k")
    prints = {r.id: np.frombuffer(r.prints, "<u4") for r in known.collect()}
    asked = [i for i in prints if i % 100 == 0]
    found = {r.id: r for r in au.align(spark, known, known.where("id % 100 = 0")).collect()}
    index = au.QueryIndex(asked, [prints[i] for i in asked])
    for i, own in prints.items():
        want = {m[0]: m[1:] for m in index.matches(own) if m[0] != i}
        groups = {}
        for q, m in want.items():
            groups.setdefault((prints[q].tobytes(), m), []).append(q)
        listed = sorted((min(g), len(g), *m) for (_, m), g in groups.items())
        assert [tuple(m) for m in found[i].matches] == listed and found[i].n_matches == len(want)
        best = min(((e / (32 * n), -n, q), q, o, n, e) for q, (o, n, e) in want.items())[1:]
        assert (found[i].best_query, found[i].best_offset, found[i].best_overlap, found[i].best_errors) == best
    assert max(r.n_matches for r in found.values()) >= 3


def test_votes_step_by_step(monkeypatch):
    """A value that all frames share is counted in steps of bounded size, with the same votes."""
    silent = np.zeros(300, np.uint32)
    index = au.QueryIndex([1, 2], [silent, silent[:100]])
    code, votes = index.votes(silent)
    monkeypatch.setattr(au, "STEP", 700)
    again = index.votes(silent)
    assert (code == again[0]).all() and (votes == again[1]).all() and votes.sum() == 2 * 300 * 400


def test_widths():
    for width, scale in ((1, 127), (2, 32767), (3, 8388607), (4, 2147483647)):
        samples = np.sin(np.arange(8000) / 7.0)
        whole = np.round(samples * scale).astype("<i8")
        raw = (whole + 128).astype(np.uint8).tobytes() if width == 1 else whole.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(width)
            f.setframerate(au.RATE)
            f.writeframes(raw)
        got, rate = au.read_wave(buffer.getvalue())
        assert rate == au.RATE and np.abs(got - samples).max() < 0.02


def test_a_very_long_recording():
    samples, _ = au.read_wave(au.recording(melodies(9, 1, 4000)[0]))
    long = prints(samples)
    index = au.QueryIndex([7], [prints(samples[400_000:432_000])])
    assert len(long) > 5000 and [m[0] for m in index.matches(long)] == [7]
