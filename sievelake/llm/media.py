"""Copied images by local descriptors: corners, oriented binary tests, Hamming tables, geometric consensus.

Corners are found on three scales by the segment test (nine contiguous pixels of a circle of sixteen
that are all brighter, or all darker, than its centre).  An image is described by every corner that is
the strongest within ``radius`` pixels of its scale, so features are spread over it, their number grows
with its area, and a crop keeps those that it shows.  Each is turned to its intensity centroid and
described by 128 comparisons of smoothed pixels (Rublee et al., 2011).  Descriptors meet in twice seven tables
of 18 or 19 bits, of which each seven share out the 128 bits in another order; so those that differ in up to six bits
always meet, and those that differ in MAX_BITS with probability 0.71; what meets is compared bit by bit, each
distinct descriptor of a block once.  Pairs of images of which two features in five of those that a copy needs have met others
within MAX_BITS (two, for most) are compared descriptor by descriptor, and
a similarity transform is voted for: images are copies if one transform, proposed by a match or by two, carries
at least ``min_inliers`` matches and ``MIN_SHARE`` of the features of the image that has fewer.  The transforms that
one match proposes are voted on for many pairs at once; only pairs that these leave open, and that another transform might link, are
looked at one by one.  That stands cropping, scaling, turning and local edits.  A copy whose five features all differ in
MAX_BITS bits is found with probability 0.97, a closer or larger one with more.

Every pair is verified, also of images that others connect already, so ``links`` is complete; classes are the
connected components of the links.

Scale: images are dealt to blocks of up to SPLIT, and each pair of blocks is one task, which reads both from
the shared folder, counts what meets in a table of all its pairs of images, and returns links only.  So a
descriptor that all images have (a logo) costs no rows, and nothing but links is shuffled; but the number of tasks
grows with the square of the images.
Images stay where they are read; a feature is 22 bytes.  Large images are described strip by strip.

Defined results
* media are PGM, PPM (8 bits) or PNG (8 bits, not interlaced) of up to MAX_PIXELS; null, undecodable,
  larger, tiny or flat images have no corners; null and undecodable ones are in no class, flat ones match equal pixels;
* images with equal pixels are one picture, and in one class; ``links`` counts the other pictures that
  are copies of this one by comparison, so it is 0 for images that only have equal ones;
* an image without any copy has no row; null ids (and ids that are no numbers) come out as null and are
  larger than all others; repeated rows (id and pixels) count once;
* an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sievelake.operators.components import connected_components

from .common import bounded_batches, discard, id_or_last, null_id, written
from .kernels import buffers, mix64, row_bounds, slices, span_hashes, words

RADIUS = 8
CONTRAST = 20
MAX_BITS = 16
#: Features of a pair that must be seen to meet, as a share of those that a copy needs.
SEEN = 0.4
MIN_INLIERS = 5
MIN_SHARE = 0.15
TOLERANCE = 3.0
#: How far the transform that one match proposes may be wrong, by its rounded turn and scale, as a share of the distance.
ROUNDED = 0.25
STACK_PIXELS = 1 << 20
#: Pixels of images of one shape that are described together.
_TOGETHER = 1 << 17
MAX_PIXELS = 1 << 26
#: Images of a block, and bytes of their features.
SPLIT = 3072
BLOCK_BYTES = 8 << 20
#: Pairs of features that are compared at once.
_AT_ONCE = 1 << 19
#: Comparisons of a key from which its descriptors are compared as a table, all with all.
_CROWD = 2048
#: Comparisons of such a table at once, which caches hold.
_TABLE = 1 << 16
#: Matches of a pair of images up to which each proposes a transform in the first vote; of more, a few do.
_VOTES, _FEW = 256, 16

_CIRCLE = [(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)]
_BORDER = 14
_TURNS = 32
_SCALES = (1.0, 1.5, 2.0)

#: Whether nine neighbours of a ring of sixteen bits are all set.
_ARC = np.zeros(1 << 16, bool)
for _k in range(16):
    _nine = np.uint32(((0x1FF << _k) | (0x1FF << _k >> 16)) & 0xFFFF)
    _ARC |= np.arange(1 << 16, dtype=np.uint32) & _nine == _nine

_rng = np.random.default_rng(31)
_tests = np.clip(_rng.normal(0, 4.2, (128, 2, 2)), -8.5, 8.5)
_angle = np.arange(_TURNS) * 2 * np.pi / _TURNS
_turn = np.stack([np.stack([np.cos(_angle), -np.sin(_angle)], -1), np.stack([np.sin(_angle), np.cos(_angle)], -1)], -2)
_PATTERN = np.rint(np.einsum("tij,nkj->tnki", _turn, _tests)).astype(np.int64)  # turn, test, end, (x, y)
_DISC = np.array([(x, y) for y in range(-7, 8) for x in range(-7, 8) if x * x + y * y <= 49])

_FEATURE = np.dtype([("x", "<u4"), ("y", "<u4"), ("turn", "u1"), ("level", "u1"), ("bits", "<u8", 2)])


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey pixels of a PGM, PPM or PNG; None if it is none of them or broken."""
    try:
        if raw is None:
            return None
        if raw[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while raw[at : at + 1].isspace():
                    at += 1
                if raw[at : at + 1] == b"#":
                    at = raw.index(b"\n", at)
                    continue
                end = at
                while raw[end : end + 1].isdigit():
                    end += 1
                fields.append(int(raw[at:end]))
                at = end
            w, h, top = fields
            if top != 255 or not 0 < w * h <= MAX_PIXELS:
                return None
            depth = 1 if raw[:2] == b"P5" else 3
            return _grey(np.frombuffer(raw, np.uint8, w * h * depth, at + 1).reshape(h, w, depth))
        return _png(raw) if raw[:8] == b"\x89PNG\r\n\x1a\n" else None
    except (ValueError, IndexError, TypeError, OverflowError, zlib.error, MemoryError):
        return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return (pixels[:, :, :3].astype(np.uint16) @ np.array([77, 150, 29], np.uint16) >> 8).astype(np.uint8)


def _png(raw: bytes) -> np.ndarray | None:
    at, parts, head = 8, [], None
    while at < len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        head = body if kind == b"IHDR" else head
        parts += [body] if kind == b"IDAT" else []
        at += 12 + size
    data = b"".join(parts)
    if head is None or len(head) != 13:
        return None
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[9])
    if head[8] != 8 or depth is None or head[12] or not 0 < w * h <= MAX_PIXELS:
        return None
    size = h * (1 + w * depth)
    flat = zlib.decompressobj().decompress(data, size + 1)  # no more than the header promises
    if len(flat) != size:
        return None
    rows = np.frombuffer(flat, np.uint8).reshape(h, 1 + w * depth)
    out = np.zeros((h + 1, w * depth), np.uint8)
    for y in range(h):
        kind, line, above = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.cumsum(line.reshape(w, depth), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y + 1] = line + above
        else:
            now = out[y + 1].astype(np.int64)
            for i in range(w * depth):
                a = now[i - depth] if i >= depth else 0
                b, c = int(above[i]), int(above[i - depth]) if i >= depth else 0
                p = a + b - c
                best = (a + b) // 2 if kind == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[i] = (int(line[i]) + best) & 255
            out[y + 1] = now
    return _grey(out[1:].reshape(h, w, depth))


def _levels(stack: np.ndarray) -> list[np.ndarray]:
    n, h, w = stack.shape
    stack = stack[:, : h - h % 6, : w - w % 6]
    whole = stack.astype(np.int16)

    def thirds(x, axis):
        a, b, c = (np.take(x, np.arange(k, x.shape[axis], 3), axis) for k in range(3))
        both = np.stack([(2 * a + b) // 3, (b + 2 * c) // 3], axis + 1)
        shape = list(x.shape)
        shape[axis] = x.shape[axis] // 3 * 2
        return both.reshape(shape)

    half = (whole[:, ::2, ::2] + whole[:, 1::2, ::2] + whole[:, ::2, 1::2] + whole[:, 1::2, 1::2]) // 4
    return [whole, thirds(thirds(whole, 1), 2), half]


def _widest(values: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """The largest value within ``radius`` along an axis; zeros stand beyond the border."""
    shape = list(values.shape)
    shape[axis] = radius
    edge = np.zeros(shape, values.dtype)
    out, width, whole = np.concatenate([edge, values, edge], axis), 1, 2 * radius + 1
    cut = lambda x, a, b: x[:, a:b] if axis == 1 else x[:, :, a:b]
    while width < whole:
        step = min(width, whole - width)
        n = out.shape[axis]
        out = np.maximum(cut(out, 0, n - step), cut(out, step, n))
        width += step
    return out


def _corners(level: np.ndarray, contrast: int, radius: int = RADIUS):
    """(image, y, x, score) of the corners of a stack of images that are the strongest within ``radius``."""
    n, h, w = level.shape
    if h <= 2 * _BORDER or w <= 2 * _BORDER:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    core = level[:, _BORDER : h - _BORDER, _BORDER : w - _BORDER]
    up, down = core + np.int16(contrast), core - np.int16(contrast)
    bright, dark = np.zeros((2, *core.shape), np.uint8), np.zeros((2, *core.shape), np.uint8)  # eight neighbours each
    beyond, apart, score = np.empty(core.shape, bool), np.empty(core.shape, np.int16), np.zeros(core.shape, np.int16)
    for k, (dx, dy) in reversed(list(enumerate(_CIRCLE))):
        ring = level[:, _BORDER + dy : h - _BORDER + dy, _BORDER + dx : w - _BORDER + dx]
        for compare, bound, bits in ((np.greater, up, bright[k // 8]), (np.less, down, dark[k // 8])):
            np.add(bits, bits, out=bits)
            np.bitwise_or(bits, compare(ring, bound, out=beyond).view(np.uint8), out=bits)
        score += np.abs(np.subtract(ring, core, out=apart), out=apart)
    corner = _ARC[bright[0] | bright[1].astype(np.uint16) << np.uint16(8)] | _ARC[dark[0] | dark[1].astype(np.uint16) << np.uint16(8)]
    image, y, x = np.nonzero(corner)
    score = score[corner].astype(np.int64)
    y, x = y + _BORDER, x + _BORDER
    inner_h, inner_w = core.shape[1:]
    # equal scores are told apart by place, so that one of a plateau remains
    own = score * (inner_h * inner_w) + (inner_h * inner_w - 1 - (y - _BORDER) * inner_w - (x - _BORDER))
    ranked = np.zeros(core.shape, np.int32 if 4081 * inner_h * inner_w < 1 << 31 else np.int64)
    ranked[image, y - _BORDER, x - _BORDER] = own
    best = own == _widest(_widest(ranked, radius, 1), radius, 2)[image, y - _BORDER, x - _BORDER]
    return image[best], y[best], x[best], score[best]


def _described(level: np.ndarray, image, y, x) -> tuple[np.ndarray, np.ndarray]:
    """(turn, 128 bits) of each corner."""
    n, h, w = level.shape
    patch = level.ravel()[((image * h + y) * w + x)[:, None] + (_DISC[:, 1] * w + _DISC[:, 0])]
    moment = patch.astype(np.float32) @ _DISC.astype(np.float32)  # whole numbers below 2**24, so exact
    turn = np.rint(np.arctan2(moment[:, 1], moment[:, 0]) * _TURNS / (2 * np.pi)).astype(np.int64) % _TURNS
    smooth = level[:, 1:-1, 1:-1] * np.int16(4)
    for dy, dx, weight in ((0, 1, 2), (2, 1, 2), (1, 0, 2), (1, 2, 2), (0, 0, 1), (0, 2, 1), (2, 0, 1), (2, 2, 1)):
        smooth += np.int16(weight) * level[:, dy : dy + h - 2, dx : dx + w - 2]
    at = ((image * (h - 2) + y - 1) * (w - 2) + x - 1)[:, None, None] + (_PATTERN[..., 1] * (w - 2) + _PATTERN[..., 0])[turn]
    ends = smooth.ravel()[at]
    bits = np.packbits(ends[:, :, 0] < ends[:, :, 1], axis=1, bitorder="little")
    return turn, bits.view("<u8")


def describe(stack: np.ndarray, radius: int = RADIUS, contrast: int = CONTRAST) -> list[np.ndarray]:
    """The features of each image of a stack, the strongest first, as arrays of _FEATURE."""
    found, levels = [], _levels(stack)
    for number, level in enumerate(levels):
        image, y, x, score = _corners(level, contrast, radius)
        found.append((image, y, x, score, np.full(len(image), number)))
    image, y, x, score, number = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((x, y, number, -score, image))
    image, y, x, number = image[order], y[order], x[order], number[order]
    out = np.zeros(len(image), _FEATURE)
    for k, level in enumerate(levels):
        at = np.flatnonzero(number == k)
        if len(at):
            out["turn"][at], out["bits"][at] = _described(level, image[at], y[at], x[at])
    scale = np.array(_SCALES)[number]
    out["x"], out["y"], out["level"] = np.rint(x * scale), np.rint(y * scale), number
    edge = np.searchsorted(image, np.arange(len(stack) + 1))
    return [out[a:b] for a, b in zip(edge, edge[1:])]


#: What a strip shows of its neighbours: twice what a corner sees at the coarsest scale, and a multiple of 6.
_OVERLAP = 96


def described(stack: np.ndarray, radius: int = RADIUS, contrast: int = CONTRAST) -> list[np.ndarray]:
    """:func:`describe`, in strips of large images."""
    n, h, w = stack.shape
    step = max(4 * _OVERLAP, STACK_PIXELS // w // 6 * 6)
    if n * h * w <= 2 * STACK_PIXELS or h <= step:
        return describe(stack, radius, contrast)
    out = []
    for image in stack:
        parts = []
        for y in range(0, h, step):
            top = max(0, y - _OVERLAP)
            found = describe(image[None, top : y + step + _OVERLAP], radius, contrast)[0]
            found = found[(found["y"] + top >= y) & (found["y"] + top < y + step)]
            found["y"] += top
            parts.append(found)
        out.append(np.concatenate(parts))
    return out


def consensus(a: np.ndarray, b: np.ndarray, max_bits: int = MAX_BITS, tolerance: float = TOLERANCE, enough: int = 1 << 30) -> int:
    """How many features of ``a`` one similarity transform carries to matching ones of ``b``; the search ends with ``enough``.

    A feature of the image that has fewer matches those of the other that are nearest to it, and near enough.
    """
    if len(a) > len(b):
        a, b = b, a
    pairs = []
    for lo in range(0, len(a), 1024):  # so much of the table of distances at once
        apart = np.bitwise_count(a["bits"][lo : lo + 1024, None, :] ^ b["bits"][None, :, :]).sum(2)
        i, j = np.nonzero(apart <= np.minimum(apart.min(1, initial=max_bits, keepdims=True), max_bits))
        pairs.append((i + lo, j))
    i, j = (np.concatenate(c) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    if not len(i):
        return 0
    scale = np.array(_SCALES)
    grow = scale[b["level"][j]] / scale[a["level"][i]]
    turn = (b["turn"][j].astype(float) - a["turn"][i]) * 2 * np.pi / _TURNS
    p = a["x"][i].astype(float) + 1j * a["y"][i]
    q = b["x"][j].astype(float) + 1j * b["y"][j]
    proposed, best, loose = grow * np.exp(1j * turn), 0, []
    count = lambda at: min(len(np.unique(i[at])), len(np.unique(j[at])))
    for lo in range(0, len(p), 512):  # what each match proposes
        far = p[None, :] - p[lo : lo + 512, None]
        off = np.abs(proposed[lo : lo + 512, None] * far + q[lo : lo + 512, None] - q[None, :])
        tight = off <= tolerance
        carried = tight.sum(1)
        for k in np.argsort(-carried, kind="stable"):
            if carried[k] <= best:
                break
            best = max(best, count(tight[k]))
            if best >= enough:
                return best
        loose.append((off <= tolerance + ROUNDED * np.abs(far)).sum(1))
    # two matches fix turn and scale better than the rounded orientation and scale of one do
    loose = np.concatenate(loose)
    for k in np.argsort(-loose, kind="stable"):
        if loose[k] <= best:
            break
        far = p - p[k]
        near = np.flatnonzero(np.abs(proposed[k] * far + q[k] - q) <= tolerance + ROUNDED * np.abs(far))
        other = near[np.abs(far[near]) > 8]
        for lo in range(0, len(other), 512):
            z = (q[other[lo : lo + 512]] - q[k]) / far[other[lo : lo + 512]]
            tight = np.abs(z[:, None] * far[None, near] + q[k] - q[None, near]) <= tolerance
            carried = tight.sum(1)
            for t in np.argsort(-carried, kind="stable"):
                if carried[t] <= best:
                    break
                best = max(best, count(near[tight[t]]))
                if best >= enough:
                    return best
    return best


def _described_rows(radius: int, contrast: int):
    def run(batches):
        for batch in batches:
            ids, rows = batch.column("id"), []
            by_shape: dict[tuple, list[int]] = defaultdict(list)
            pixels = [decode(raw) for raw in batch.column("image").to_pylist()]
            for i, p in enumerate(pixels):
                if p is not None:
                    by_shape[p.shape].append(i)
            for (h, w), places in by_shape.items():
                step = max(1, _TOGETHER // max(1, h * w))
                for c in range(0, len(places), step):
                    part = places[c : c + step]
                    stack = np.stack([pixels[i] for i in part])
                    flat = stack.reshape(len(part), -1)
                    data = np.ascontiguousarray(flat).ravel()
                    off = np.arange(len(part)) * flat.shape[1]
                    h64 = mix64(span_hashes(data, off, off + flat.shape[1], _PIXEL_MIX) ^ np.uint64(h * 65537 + w)).view(np.int64)
                    rows += [(i, int(x), f.tobytes()) for i, x, f in zip(part, h64, described(stack, radius, contrast))]
            i, x, blob = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i, pa.int64())), pa.array(x, pa.int64()), pa.array(blob, pa.binary())], ["id", "pixels", "features"])

    return run


_PIXEL_MIX = np.random.default_rng(8).integers(1, 2**63 - 1, 256, dtype=np.uint64)


def _keys(bits: np.ndarray) -> np.ndarray:
    """The keys of each descriptor in seven tables: 18, 18, 18, 19, 18, 18 and 19 of its bits."""
    low, high, mask = bits[:, 0], bits[:, 1], np.uint64((1 << 18) - 1)
    at = lambda word, k: word >> np.uint64(k)
    middle = at(low, 54) | (high & np.uint64(511)) << np.uint64(10)
    return np.stack([low & mask, at(low, 18) & mask, at(low, 36) & mask, middle, at(high, 9) & mask, at(high, 27) & mask, at(high, 45)]).astype(np.uint32)


def _mixed(bits: np.ndarray) -> np.ndarray:
    """The descriptors with their bits in another order, so that few bits of a table share one again."""
    out = np.zeros_like(bits)
    for k in range(128):
        to = k % 16 * 8 + k // 16
        out[:, to // 64] |= (bits[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) << np.uint64(to % 64)
    return out


def _by_key(key: np.ndarray):
    """The places of descriptors in the order of their keys, and how many have each key."""
    order = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
    return (order & np.uint64((1 << 32) - 1)).astype(np.int64), np.bincount(key, minlength=1 << 19)


def _met(a: np.ndarray, b: np.ndarray):
    """(i, j) of the descriptors that share a key of the fourteen tables and differ in up to MAX_BITS, each pair once."""
    both = [(a, b), (_mixed(a), _mixed(b))]
    keys_a, keys_b = (np.concatenate([_keys(x[side]) for x in both]) for side in (0, 1))
    for t in range(len(keys_a)):
        (order_a, n_a), (order_b, n_b) = _by_key(keys_a[t]), _by_key(keys_b[t])
        start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        far = int(t % 7 < 4)  # the word that has fewer bits of the key tells more
        far_a, far_b, near_a, near_b = (np.ascontiguousarray(x[order, w]) for w in (far, 1 - far) for x, order in zip(both[t // 7], (order_a, order_b)))

        def close(i, j):
            alike = np.flatnonzero(np.bitwise_count(far_a[i] ^ far_b[j]) + np.bitwise_count(near_a[i] ^ near_b[j]) <= MAX_BITS)
            i, j = order_a[i[alike]], order_b[j[alike]]
            new = np.ones(len(i), bool)
            for k in range(t):
                new &= keys_a[k, i] != keys_b[k, j]
            return i[new], j[new]

        held, found = 0, []
        work = n_a * n_b
        for k in np.flatnonzero(work >= _CROWD):  # all with all
            p, q, m, n = int(start_a[k]), int(start_b[k]), int(n_a[k]), int(n_b[k])
            step = max(1, _TABLE // n)
            for lo in range(p, p + m, step):
                at = np.flatnonzero(np.bitwise_count(far_a[lo : min(lo + step, p + m), None] ^ far_b[q : q + n]) <= MAX_BITS)
                found.append((at // n + lo, at % n + q))
                held += len(at)
                if held > _AT_ONCE:
                    yield close(*(np.concatenate(c) for c in zip(*found)))
                    held, found = 0, []
        some = np.flatnonzero((work > 0) & (work < _CROWD))
        total = np.r_[0, np.cumsum(work[some])]
        p = 0
        while p < len(some):
            q = max(p + 1, int(np.searchsorted(total, total[p] + _AT_ONCE // 4, "right")) - 1)
            k = some[p:q]
            size = np.repeat(n_b[k], n_a[k])  # a run for each descriptor of a
            i = np.repeat(start_a[k] - np.cumsum(n_a[k]) + n_a[k], n_a[k]) + np.arange(len(size))
            first = np.repeat(start_b[k], n_a[k]) - np.cumsum(size) + size
            i, j = np.repeat(i, size), np.repeat(first, size) + np.arange(total[q] - total[p])
            at = np.flatnonzero(np.bitwise_count(far_a[i] ^ far_b[j]) <= MAX_BITS)
            found.append((i[at], j[at]))
            p = q
        if found:
            yield close(*(np.concatenate(c) for c in zip(*found)))


def _distinct(bits: np.ndarray):
    """The distinct descriptors, the places of each, one after the other, and where these begin."""
    order = np.lexsort((bits[:, 1], bits[:, 0]))
    ordered = bits[order]
    first = np.flatnonzero(np.r_[True, (ordered[1:] != ordered[:-1]).any(1)]) if len(order) else order
    return ordered[first], order, np.r_[first, len(order)]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 … for size[0] places, and so on."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _opened(bits_a, image_a, bits_b, image_b, needed, shape: tuple[int, int], same: bool) -> np.ndarray:
    """The pairs of images of which as many features meet as SEEN asks for, as image of a * images of b + image of b."""
    (a, order_a, first_a), (b, order_b, first_b) = _distinct(bits_a), _distinct(bits_b)
    seen = np.zeros(shape[0] * shape[1], np.uint32)
    for i, j in _met(a, b):
        n_a, n_b = first_a[i + 1] - first_a[i], first_b[j + 1] - first_b[j]
        total, p = np.r_[0, np.cumsum(n_a * n_b)], 0
        while p < len(i):
            q = max(p + 1, int(np.searchsorted(total, total[p] + _AT_ONCE, "right")) - 1)
            for r in range(first_a[i[p]], first_a[i[p] + 1], max(1, _AT_ONCE // int(n_b[p]))) if q == p + 1 else (None,):
                if r is None:
                    left = _runs(first_a[i[p:q]], n_a[p:q])
                    runs, start = np.repeat(n_b[p:q], n_a[p:q]), np.repeat(first_b[j[p:q]], n_a[p:q])
                else:  # one pair of descriptors that many images have
                    left = np.arange(r, min(r + max(1, _AT_ONCE // int(n_b[p])), first_a[i[p] + 1]))
                    runs, start = np.full(len(left), n_b[p]), np.full(len(left), first_b[j[p]])
                x, y = np.repeat(image_a[order_a[left]], runs), image_b[order_b[_runs(start, runs)]]
                pair = x * shape[1] + y
                pair = pair[x < y] if same else pair
                np.add.at(seen, pair, np.uint32(1))
            p = q
    open_ = np.flatnonzero(seen >= max(1, int(np.ceil(SEEN * needed.least))))
    return open_[seen[open_] >= SEEN * needed(open_)]


class _Needed:
    """How many features of each pair of images one transform must carry."""

    def __init__(self, size_a, size_b, min_inliers: int):
        self.a, self.b, self.least = size_a, size_b, min_inliers

    def __call__(self, pair: np.ndarray) -> np.ndarray:
        i, j = np.divmod(pair, len(self.b))
        return np.maximum(self.least, np.ceil(MIN_SHARE * np.minimum(self.a[i], self.b[j]))).astype(np.int64)


def _matches(pair, image, other, bits_a, bits_b, start_a, start_b, size_a, size_b):
    """(place in pair, feature of a, feature of b, bits apart) of all within MAX_BITS; pairs are ordered by their image of a."""
    n = size_b[other]
    right, owner = _runs(start_b[other], n), np.repeat(np.arange(len(pair)), n)
    low, high, out = bits_b[right, 0], bits_b[right, 1], []
    edge = np.flatnonzero(np.r_[True, image[1:] != image[:-1], True])
    begin = np.r_[0, np.cumsum(n)]
    for p, q in zip(edge, edge[1:]):
        s, e, k = begin[p], begin[q], image[p]
        step = max(1, _TABLE // int(e - s))
        for lo in range(start_a[k], start_a[k] + size_a[k], step):
            own = bits_a[lo : min(lo + step, start_a[k] + size_a[k])]
            at = np.flatnonzero(np.bitwise_count(own[:, :1] ^ low[s:e]) <= MAX_BITS)
            i, j = at // (e - s), at % (e - s) + s
            apart = np.bitwise_count(own[i, 0] ^ low[j]) + np.bitwise_count(own[i, 1] ^ high[j])
            near = np.flatnonzero(apart <= MAX_BITS)
            out.append((owner[j[near]], i[near] + lo, right[j[near]], apart[near]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _each(group: np.ndarray, item: np.ndarray, groups: int) -> np.ndarray:
    """How many distinct items each group has."""
    code = np.sort(group.astype(np.int64) << 32 | item)
    return np.bincount(code[np.r_[True, code[1:] != code[:-1]]] >> 32, minlength=groups) if len(code) else np.zeros(groups, np.int64)


def _voted(n: int, at, i, j, a: np.ndarray, b: np.ndarray, needed: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """What the first vote of :func:`consensus` finds for all pairs at once, by their matches (pair, feature of a, of b): whether
    the transform that a match proposes carries enough; whether so many are near one that another transform might."""
    size = np.bincount(at, minlength=n)
    order = np.argsort(at, kind="stable")
    at, i, j = at[order], i[order], j[order]
    scale = np.array(_SCALES)
    p, q = (f["x"][k].astype(float) + 1j * f["y"][k] for f, k in ((a, i), (b, j)))
    turn = (b["turn"][j].astype(float) - a["turn"][i]) * 2 * np.pi / _TURNS
    proposed = scale[b["level"][j]] / scale[a["level"][i]] * np.exp(1j * turn)
    sure, may = np.zeros(n, bool), np.zeros(n, bool)
    begin, lo = np.cumsum(size) - size, 0
    many = size > _VOTES
    may |= many
    asks = np.flatnonzero(~many[at] | ((np.arange(len(at)) - begin[at]) % -(-size // _FEW)[at] == 0))
    rows = size[at[asks]]
    total = np.r_[0, np.cumsum(rows)]
    while lo < len(asks):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _AT_ONCE // 4, "right")) - 1)
        ask, pair = asks[lo:hi], at[asks[lo:hi]]
        k, o = np.repeat(np.arange(hi - lo), rows[lo:hi]), _runs(begin[pair], rows[lo:hi])
        far = p[o] - p[ask][k]
        off = np.abs(proposed[ask][k] * far + q[ask][k] - q[o])
        want = needed[pair]
        for near, verdict in ((off <= tolerance, sure), (off <= tolerance + ROUNDED * np.abs(far), may)):
            carried = np.bincount(k[near], minlength=hi - lo)
            near = np.flatnonzero(near & ((carried >= want) & ~sure[pair] & ~may[pair] if verdict is may else carried >= want)[k])
            own, other = k[near], o[near]
            enough = np.minimum(_each(own, i[other], hi - lo), _each(own, j[other], hi - lo)) >= want
            verdict[pair[enough]] = True
        lo = hi
    return sure, may


def linked(a: list[np.ndarray], b: list[np.ndarray], min_inliers: int = MIN_INLIERS, same: bool = False) -> list[tuple[int, int]]:
    """(i, j) of the images of ``a`` and ``b``, by their features, that are copies; of ``same`` lists, those with i < j."""
    if not a or not b:
        return []
    size_a, size_b = np.array([len(f) for f in a]), np.array([len(f) for f in b])
    needed = _Needed(size_a, size_b, min_inliers)
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    bits_a, bits_b = np.ascontiguousarray(all_a["bits"]), np.ascontiguousarray(all_b["bits"])
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    open_ = _opened(bits_a, np.repeat(np.arange(len(a)), size_a), bits_b, np.repeat(np.arange(len(b)), size_b), needed, (len(a), len(b)), same)
    out, held = [], np.r_[0, np.cumsum(size_b[open_ % len(b)])]
    lo = 0
    while lo < len(open_):
        hi = max(lo + 1, int(np.searchsorted(held, held[lo] + _AT_ONCE, "right")) - 1)
        pair = open_[lo:hi]
        lo = hi
        image, other = np.divmod(pair, len(b))
        at, i, j, apart = _matches(pair, image, other, bits_a, bits_b, start_a, start_b, size_a, size_b)
        want = needed(pair)
        matched = np.minimum(_each(at, i, len(pair)), _each(at, j, len(pair))) >= want
        keep = matched[at]
        at, i, j, apart = at[keep], i[keep], j[keep], apart[keep]
        # of the image that has fewer, each feature goes with those nearest to it
        fewer = (size_a[image] <= size_b[other])[at]
        code = at.astype(np.int64) << 33 | np.where(fewer, i, j + len(all_a))
        ids, at_id = np.unique(code, return_inverse=True)
        least = np.full(len(ids), 255, np.uint8)
        np.minimum.at(least, at_id, apart)
        keep = apart == least[at_id]
        at, i, j = at[keep], i[keep], j[keep]
        sure, may = np.zeros(len(pair), bool), np.zeros(len(pair), bool)
        for turned in (False, True):  # consensus() proposes from the image that has fewer
            of = ((size_a[image] > size_b[other]) == turned)[at]
            one = (at[of], j[of], i[of], all_b, all_a) if turned else (at[of], i[of], j[of], all_a, all_b)
            yes, open_yet = _voted(len(pair), *one, want)
            sure |= yes
            may |= open_yet
        for k in np.flatnonzero(may & matched & ~sure):
            sure[k] = consensus(a[image[k]], b[other[k]], enough=want[k]) >= want[k]
        out += list(zip(image[sure].tolist(), other[sure].tolist()))
    return out


def _block_links(uri: str, min_inliers: int):
    """(a, b): the linked images of each pair of blocks (i, j), which are read from the written table of features."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)

        def block(k):
            found = pq.read_table(base, columns=["node", "features"], filters=[("block", "=", k)], filesystem=fs)
            return found.column("node").to_numpy(), [np.frombuffer(f, _FEATURE) for f in found.column("features").to_pylist()]

        for batch in batches:
            for i, j in zip(*(batch.column(c).to_pylist() for c in ("i", "j"))):
                nodes_a = a = nodes_b = b = None  # the last blocks are let go before others are read
                nodes_a, a = block(i)
                nodes_b, b = block(j) if i != j else (nodes_a, a)
                pairs = np.array(linked(a, b, min_inliers, i == j), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(nodes_a[pairs[:, 0]], pa.int64()), pa.array(nodes_b[pairs[:, 1]], pa.int64())], ["a", "b"])

    return run


def copied_images(media: DataFrame, *, radius: int = RADIUS, contrast: int = CONTRAST, min_inliers: int = MIN_INLIERS) -> DataFrame:
    """(image, class_id, links) of the images of a table (id, image) that have copies; class_id is the smallest id of the class."""
    spark = media.sparkSession
    bounded_batches(spark)
    rows = media.select(id_or_last("id").alias("id"), F.col("image").cast("binary").alias("image"))
    kept = written(rows.mapInArrow(_described_rows(radius, contrast), "id long, node long, features binary"), "described")
    ids = written(kept.select("id", "node").distinct(), "image-ids")
    size = kept.where(F.length("features") > 0).agg(F.countDistinct("node"), F.sum(F.length("features"))).first()
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-size[0] // SPLIT), -(-(size[1] or 0) // BLOCK_BYTES), min(cores, size[0] // 64))
    images = kept.where(F.length("features") > 0).groupBy("node").agg(F.min("features").alias("features"))
    images = images.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks))).repartition("block").sortWithinPartitions("block")
    images = written(images, "images")
    discard(kept)
    tasks = spark.range(blocks * blocks).select(F.expr(f"id div {blocks}").alias("i"), F.expr(f"id % {blocks}").alias("j")).where("i <= j")
    tasks = tasks.repartition(max(1, min(blocks * (blocks + 1) // 2, max(16 * cores, blocks * blocks // 64))))
    edges = written(tasks.mapInArrow(_block_links(images.written_to, min_inliers), "a long, b long"), "edges")
    discard(images)
    label = written(connected_components(edges), "labels")
    links = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    member = ids.join(label, "node", "left").join(links, "node", "left")
    member = member.select("id", F.coalesce("component", "node").alias("c"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    classes = member.groupBy("c").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).where("n > 1")
    found = written(member.join(classes, "c").select(null_id(F.col("id")).alias("image"), null_id(F.col("class_id")).alias("class_id"), "links"), "image-classes")
    discard(ids, edges, label)
    return found


#: A page is pictured in rows of so many words, each a square of so many pixels, padded to so many rows.
COLUMNS, PIXELS, ROWS = 24, 4, 6

#: Letters that begin the names of tags that begin a new row.
_BLOCK_TAG = np.zeros(256, bool)
_BLOCK_TAG[list(b"dfhnpu")] = True
_AFTER = np.uint64(0x9E3779B97F4A7C15)


def _in_tag(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the last of < and > before each place is a <."""
    mark = np.flatnonzero((data == 60) | (data == 62))
    last = np.searchsorted(mark, at) - 1
    return (last >= 0) & (data[mark[np.maximum(last, 0)]] == 60) if len(mark) else np.zeros(len(at), bool)


@F.arrow_udf(BinaryType())
def _thumbnail(text: pa.Array) -> pa.Array:
    data, off = buffers(text)
    out = []
    for a, b in slices(off):
        part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        start, end, row = words(part, o)
        value = span_hashes(part, start, end)
        shown = ~_in_tag(part, start)
        start, row, value = start[shown], row[shown], value[shown]
        begins = part == 10
        begins[:-1] |= (part[:-1] == 60) & _BLOCK_TAG[part[1:]]
        lines = np.cumsum(begins)[start] if len(start) else np.zeros(0, np.int64)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (lines[1:] != lines[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(row)])
        high = -(-size // COLUMNS)  # rows of each line
        first = row_bounds(row[at], b - a)
        total = np.r_[0, np.cumsum(high)][first]
        tall = np.maximum(4, -(-np.diff(total) // ROWS)) * ROWS  # rows of each picture
        high = high.copy()
        some = np.flatnonzero(first[1:] > first[:-1])
        high[first[1:][some] - 1] += (tall - np.diff(total))[some]  # its last line fills what is left
        cell = np.repeat(np.arange(len(high)), high * COLUMNS)
        after = np.arange(len(cell)) - np.repeat(np.cumsum(high * COLUMNS) - high * COLUMNS, high * COLUMNS)
        last = size[cell] - 1
        with np.errstate(over="ignore"):  # cells after the last word of a line are made from it
            tones = mix64(value[at[cell] + np.minimum(after, last)] + np.maximum(after - last, 0).astype(np.uint64) * _AFTER) >> np.uint64(57)
        grid, begin = (tones.astype(np.uint8) * 2).reshape(-1, COLUMNS), 0
        for k in range(b - a):
            own = grid[begin : begin + tall[k]] if first[k + 1] > first[k] else np.zeros((tall[k], COLUMNS), np.uint8)
            begin += len(own) if first[k + 1] > first[k] else 0
            picture = own.repeat(PIXELS, 0).repeat(PIXELS, 1)
            out.append(b"P5 %d %d 255\n" % (picture.shape[1], picture.shape[0]) + picture.tobytes())
    return pa.array(out, pa.binary())


def thumbnail(text: Column) -> Column:
    """A picture of a page that shows all its words, in reading order: squares whose tones are made from them.

    Lines and block tags begin a new row, so what a page loses or gains moves the rest, as in a crop.
    """
    return _thumbnail(F.coalesce(text.cast("string"), F.lit("")))
