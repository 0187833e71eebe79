import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import media


def picture(seed, side=180):
    rng = np.random.default_rng(seed)
    img = np.zeros((side, side))
    for block, weight in ((5, 60), (9, 60), (20, 70), (45, 60)):
        n = -(-side // block)
        img += weight * rng.random((n, n)).repeat(block, 0).repeat(block, 1)[:side, :side]
    return np.clip(img, 0, 255).astype(np.uint8)


def pgm(p):
    return b"P5\n# made\n%d %d\n255\n" % (p.shape[1], p.shape[0]) + np.ascontiguousarray(p).tobytes()


def png(p, kind=0):
    h, w = p.shape[:2]
    depth = 1 if p.ndim == 2 else p.shape[2]
    rows = p.reshape(h, w * depth).astype(int)
    raw = b""
    for y in range(h):
        left = np.r_[np.zeros(depth, int), rows[y, :-depth]]
        above = rows[y - 1] if y else np.zeros(w * depth, int)
        corner = np.r_[np.zeros(depth, int), above[:-depth]]
        guess = left + above - corner
        d = np.abs(np.stack([guess - left, guess - above, guess - corner]))
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
        raw += bytes([kind]) + ((rows[y] - [0, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, {1: 0, 3: 2, 4: 6}[depth], 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_decode(kind):
    p = picture(1, 40)
    assert (media.decode(png(p, kind)) == p).all() and (media.decode(pgm(p)) == p).all()
    rgb = np.stack([p, p, p], 2)
    assert np.abs(media.decode(png(rgb, kind)).astype(int) - p).max() <= 1
    for bad in (None, b"", b"P5", b"P5 9 9 255\nab", b"GIF89a", png(p)[:60]):
        assert media.decode(bad) is None


def test_arc_table():
    for bits in np.random.default_rng(0).integers(0, 1 << 16, 500):
        ring = f"{bits:016b}"
        assert media._ARC[bits] == ("1" * 9 in ring + ring)


def edits(p):
    rng = np.random.default_rng(5)
    patched = p.copy()
    patched[20:60, 20:60] = picture(1000 + int(p.sum()) % 9999)[:40, :40]  # another for each picture
    bigger = p.repeat(2, 0).repeat(2, 1)
    return {"crop": p[25:175, 10:160], "patch": patched, "brighter": np.clip(p * 0.8 + 30, 0, 255).astype(np.uint8), "noise": np.clip(p + rng.normal(0, 3, p.shape), 0, 255).astype(np.uint8), "turned": np.rot90(p).copy(), "doubled": bigger}


def copies(a, b):
    enough = max(media.MIN_INLIERS, int(np.ceil(media.MIN_SHARE * min(len(a), len(b)))))
    return media.consensus(a, b, enough=enough) >= enough


def test_copies_are_found_and_others_are_not(spark):
    """With the defaults: at least 95 in 100 copies of each kind that comparing all pairs finds, and no other image."""
    originals = {i: picture(i) for i in range(40)}
    rows = [(i, pgm(p)) for i, p in originals.items()]
    truth = {}
    for i in range(20):
        for k, (name, p) in enumerate(edits(originals[i]).items()):
            rows.append((100 + 10 * i + k, png(p)))
            truth[100 + 10 * i + k] = i, name
    got = {r.image: r for r in media.copied_images(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert all(r.class_id == (i if i < 100 else (i - 100) // 10) and r.links >= 1 for i, r in got.items())
    features = {i: media.describe(media.decode(raw)[None])[0] for i, raw in rows}
    for kind in {name for _, name in truth.values()}:
        own = [i for i, (_, name) in truth.items() if name == kind]
        alike = [i for i in own if copies(features[truth[i][0]], features[i])]
        assert len(alike) >= 0.95 * len(own), kind
        assert len(got.keys() & set(own)) >= 0.95 * len(own), kind


def test_defined_cases(spark):
    p = picture(3)
    rows = [(5, pgm(p)), (5, pgm(p)), (2, png(p)), (None, pgm(p)), (7, None), (8, b"junk"), (9, pgm(p[:5, :5])), (10, pgm(np.zeros((64, 64), np.uint8))), (11, pgm(np.zeros((64, 64), np.uint8))), (12, None), (13, b"\x89PNG\r\n\x1a\n")]
    df = spark.createDataFrame(rows, "id long, image binary").selectExpr("*", "1 as features", "2 as node")
    got = sorted(((r.image, r.class_id, r.links) for r in media.copied_images(df).collect()), key=str)
    assert got == sorted([(2, 2, 0), (5, 2, 0), (None, 2, 0), (10, 10, 0), (11, 10, 0)], key=str)
    assert media.copied_images(spark.createDataFrame([], "id long, image binary")).collect() == []


def test_broken_media_are_no_images():
    whole = png(picture(1, 40))
    rng = np.random.default_rng(3)
    raws = [b"\x89PNG\r\n\x1a\n", b"P5 99999999999999999999 9 255", b"P5 99999 99999 255\n" + b"x" * 50, b"P6", b"P5 0 0 255\n", b"P5 #"]
    bomb = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (5).to_bytes(4, "big") * 2 + bytes([8, 0, 0, 0, 0]) + b"crc "
    packed = zlib.compress(bytes(50_000_000))
    raws.append(bomb + len(packed).to_bytes(4, "big") + b"IDAT" + packed + b"crc ")
    for _ in range(300):
        bad = bytearray(whole)
        for k in rng.integers(8, len(bad), rng.integers(1, 9)):
            bad[k] = rng.integers(0, 256)
        raws += [bytes(bad), bytes(bad[: rng.integers(0, len(bad))]), rng.bytes(rng.integers(0, 60))]
    for raw in raws:
        found = media.decode(raw)
        assert found is None or found.ndim == 2
    assert all(media.decode(raw) is None for raw in raws[:7])


def test_strips_of_a_large_image_describe_it_as_a_whole(monkeypatch):
    p = np.concatenate([picture(s, 240) for s in range(8)])
    whole = media.describe(p[None])[0]
    monkeypatch.setattr(media, "STACK_PIXELS", 400 * 240)
    cut = media.described(p[None])[0]
    rows = lambda f: sorted(map(tuple, f[["x", "y", "level", "turn"]].tolist()))
    assert len(cut) > 200 and rows(cut) == rows(whole)


def test_a_common_corner_makes_no_pairs_and_loses_none(spark, monkeypatch):
    """All images share a logo; the bucket is split, and the copies among them are still found."""
    monkeypatch.setattr(media, "SPLIT", 5)
    logo, rows = picture(999, 60), []
    for i in range(20):
        p = picture(i)
        p[:60, :60] = logo
        rows.append((i, pgm(p)))
        if i < 8:
            rows.append((100 + i, pgm(np.clip(p * 0.9 + 12, 0, 255).astype(np.uint8)[:, 6:])))
    got = {r.image: r.class_id for r in media.copied_images(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert {i for i in got if got[i] not in (i, i - 100)} == set() and len([i for i in got if i >= 100]) >= 7


def test_thumbnails_show_all_words_and_keep_what_is_not_edited(spark):
    lines = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(40)]
    texts = ["<html><a href=x>" + "\n".join(lines), "\n".join(lines[5:]), "\n".join([*lines[:-1], "other words"]), "", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, html string").orderBy("i").select(media.thumbnail(F.col("html"))).collect()]
    a, b, c, d, e = (media.decode(bytes(x)) for x in got)
    assert a.shape == (336, 96) and (a[40:320] == b[:280]).all() and (a[:312] == c[:312]).all() and (a[312:320] != c[312:320]).any()
    assert not d.any() and (d == e).all()


def flipped(features, bits, keep, seed):
    """``keep`` of the features, each with so many of its 128 bits flipped."""
    rng, out = np.random.default_rng(seed), features[:keep].copy()
    for f in out:
        for k in rng.choice(128, bits, replace=False):
            f["bits"][k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    return out


@pytest.mark.parametrize(("bits", "shared", "share"), [(6, 5, 1), (8, 12, 1), (16, 12, 0.95), (16, 5, 0.9)])
def test_candidates_against_all_pairs_consensus(bits, shared, share):
    """Of copies whose shared features differ in so many bits, which consensus accepts, so large a share is found."""
    met = wanted = 0
    for seed in range(60):
        a = media.describe(picture(seed)[None])[0][:16]
        b = flipped(a, bits, shared, seed)
        wanted += media.consensus(a, b) >= media.MIN_INLIERS
        met += media.linked([a], [b]) == [(0, 0)]
    assert wanted == 60 and met >= share * wanted


def test_links_are_those_of_all_pairs(spark):
    """Every pair that consensus accepts is counted, also where others connect its images already."""
    rows = []
    for i in range(4):
        p = picture(i)
        for k, q in enumerate((p, p[6:, :], p[:, 9:], np.clip(p * 0.9 + 12, 0, 255).astype(np.uint8), p[20:170, 10:], *edits(p).values())):
            rows.append((10 * i + k if k < 10 else 1000 + 10 * i + k, pgm(q)))
    features = {i: media.describe(media.decode(raw)[None])[0] for i, raw in rows}
    want = {i: sum(copies(features[i], features[k]) for k in features if k != i) for i in features}
    got = {r.image: r.links for r in media.copied_images(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert got == {i: n for i, n in want.items() if n} and max(got.values()) >= 6


def test_links_are_settled_together(monkeypatch):
    """All links that consensus over all pairs finds, and hardly a pair is handed to it alone."""
    a = [media.describe(q[None])[0] for i in range(12) for p in [picture(i)] for q in (p, *list(edits(p).values())[:4])]
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if copies(a[i], a[j])}
    alone, calls = media.consensus, []
    monkeypatch.setattr(media, "consensus", lambda *x, **k: calls.append(1) or alone(*x, **k))
    assert set(media.linked(a, a, same=True)) == want and len(want) >= 100
    assert len(calls) <= len(want) / 10
