"""Copies among images by local descriptors, for cropped and edited pictures.

1. Corners (Harris) on three scales, each with an orientation from its intensity centroid and 256
   binary intensity tests that turn with it.
2. Hamming tables: each table keys a descriptor by KEY_BITS bits of its own choice, so descriptors that
   differ in few bits meet in some table, however many images there are. A bucket is cut to cells by
   the whole descriptors: the first one without a leader within CELL_DISTANCE leads a new cell, the
   others join theirs. An image is first a candidate with the leaders of its cells alone, which joins large
   groups of copies without comparing all with all. Then all descriptors of a bucket within CELL_DISTANCE meet
   whose images are still in different classes, so no link between classes depends on who leads. Descriptors
   are alike by chance, the more often the larger the table is, so these carry their corner's surroundings: two that meet make a
   candidate if as many corners around them agree as consensus asks for.
3. Geometric consensus: descriptors of a candidate pair are matched by Hamming distance; each match
   implies a similarity transform, and the pair holds if enough matches agree with one.

Images are grey: a binary column of height * width bytes, row by row, and columns height and width, or
one side for all of them. Keys are of one width at any size of the table, so what is found doesn't
depend on it; a bucket's comparisons grow with the table (by about 1 / 300 of the images for each
descriptor and table at 24 bits), and from some 1e8 images on more bits and more tables pay.
The width also bounds what must be known of all keys: a bit for each, 8 MB, tells which ones several
images have, and descriptors under the others are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import components, joined_components, written
from cartloom.sources.shared import shuffles_dropped

SIDE = 64
SCALES = ((1.0, 20), (0.75, 12), (0.5, 6))  # of the image, with the most corners kept on each
BITS, RADIUS = 256, 11
TABLES, KEY_BITS = 4, 24
LEAST_VOTES, MOST_DISTANCE, LEAST_INLIERS, REPROJECTION = 2, 48, 6, 3.0
#: A descriptor joins a cell within this distance of its leader: that is nearer than a match may be, as chance ones are.
CELL_DISTANCE, SURE_DISTANCE = 30, 22
#: Corners around one that its surroundings hold, which lie APART pixels from it or more; how many must agree for a meeting to count: with the
#: corner itself they are the inliers of a link. They agree within so many of 32 bits, pixels and 128ths of a half turn.
AROUND, APART, LEAST_AGREEING = 24, 2.5, LEAST_INLIERS - 1
LIKE_BITS, LIKE_PIXELS, LIKE_TURN = 7, 5.0, 20
#: Larger images are made smaller by whole factors; smaller ones than LEAST_SIDE have no corners.
MOST_SIDE, LEAST_SIDE = 512, 24
#: Images of a bucket that go to one task; larger ones are cut to parts, and then the parts' leaders meet, two blocks of them in a task.
BUCKET_ROWS = 50_000
#: Bytes of features of a block of images; a task that compares pairs holds two of these.
MATCHED_BYTES = 16 << 20
#: Meetings that a task holds before it passes them on.
HELD_MEETINGS = 1_000_000
#: Keys of a slot, which are counted together, and keys that a task holds before it passes their counts on.
SLOT, HELD_KEYS = 1 << 16, 4_000_000
_random = np.random.default_rng(20240229)
#: Fixed by their seed: the 256 pairs of points of the tests, inside the radius, and the order in which each table takes bits.
POINTS = np.clip(_random.normal(0, RADIUS / 2.5, (BITS, 2, 2)), -RADIUS + 1, RADIUS - 1)
CHOSEN = np.stack([_random.permutation(BITS) for _ in range(TABLES)])


def box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2 r + 1 of images (n, h, w)."""
    p = np.pad(x, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(1).cumsum(2)
    k = 2 * r + 1
    return (p[:, k:, k:] - p[:, :-k, k:] - p[:, k:, :-k] + p[:, :-k, :-k]) / (k * k)


def scaled(x: np.ndarray, f: float) -> np.ndarray:
    """Images (n, h, w) at a scale, by bilinear samples of a smoothed image."""
    if f == 1:
        return x
    n, h, w = x.shape
    x = box(x, 1)
    rows, cols = (np.arange(int(s * f)) / f + (1 / f - 1) / 2 for s in (h, w))
    i, j = np.minimum(rows.astype(int), h - 2), np.minimum(cols.astype(int), w - 2)
    a, b = (rows - i)[None, :, None], (cols - j)[None, None, :]
    pick = lambda p, q: x[:, p][:, :, q]
    return (pick(i, j) * (1 - a) + pick(i + 1, j) * a) * (1 - b) + (pick(i, j + 1) * (1 - a) + pick(i + 1, j + 1) * a) * b


def corners(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image number, row and column of the strongest local maxima of the Harris response, off the border."""
    gy, gx = np.gradient(x, axis=(1, 2))
    a, b, c = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
    r = a * b - c * c - 0.05 * (a + b) ** 2
    peak = r.copy()
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                peak = np.where(r >= np.roll(r, (dy, dx), (1, 2)), peak, 0)
    m = 7
    peak[:, :m], peak[:, -m:], peak[:, :, :m], peak[:, :, -m:] = 0, 0, 0, 0
    flat = peak.reshape(len(x), -1)
    k = min(most, flat.shape[1])
    best = np.argpartition(-flat, k - 1, axis=1)[:, :k]
    strong = np.take_along_axis(flat, best, 1) > 1e-3
    n, at = np.nonzero(strong)
    at = best[n, at]
    return n, at // x.shape[2], at % x.shape[2]


_DISC = np.array([(i, j) for i in range(-6, 7) for j in range(-6, 7) if i * i + j * j <= 36])


def describe(x: np.ndarray, n: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orientation of each corner, and its 256 tests as 4 unsigned longs."""
    patch = x[n[:, None], row[:, None] + _DISC[:, 0], col[:, None] + _DISC[:, 1]]
    patch = patch - patch.mean(1, keepdims=True)
    angle = np.arctan2(patch @ _DISC[:, 0], patch @ _DISC[:, 1])
    smooth = np.pad(box(x, 1), ((0, 0), (RADIUS + 5, RADIUS + 5), (RADIUS + 5, RADIUS + 5)), mode="edge")
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    dx = np.rint(POINTS[None, :, :, 0] * cos - POINTS[None, :, :, 1] * sin).astype(int)
    dy = np.rint(POINTS[None, :, :, 0] * sin + POINTS[None, :, :, 1] * cos).astype(int)
    v = smooth[n[:, None, None], row[:, None, None] + dy + RADIUS + 5, col[:, None, None] + dx + RADIUS + 5]
    bits = v[:, :, 0] < v[:, :, 1]
    return angle, np.packbits(bits, axis=1).view(np.uint64)


def features(images: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each image (n, h, w): its corners (x, y, scale, angle) and descriptors (4 unsigned longs each)."""
    got = []
    area = max(1.0, images.shape[1] * images.shape[2] / SIDE**2)
    for f, most in SCALES:
        x = scaled(images.astype(np.float64), f)
        n, row, col = corners(x, int(most * area))
        angle, bits = describe(x, n, row, col)
        got.append((n, np.stack([(col + 0.5) / f, (row + 0.5) / f, np.full(len(n), 1 / f), angle], 1), bits))
    n, spots, bits = (np.concatenate([g[i] for g in got]) for i in range(3))
    order = np.argsort(n, kind="stable")
    cuts = np.searchsorted(n[order], np.arange(1, len(images)))
    return list(zip(np.split(spots[order], cuts), np.split(bits[order], cuts), strict=True))


def table_keys(bits: np.ndarray) -> np.ndarray:
    """The keys of descriptors (n, 4) in all tables, (tables, n): numbers below TABLES << KEY_BITS."""
    each = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(len(bits), BITS // 8), axis=1)
    packed = np.zeros((TABLES, len(bits), 8), np.uint8)
    for t, order in enumerate(CHOSEN):
        own = np.packbits(each[:, order[:KEY_BITS]], axis=1)
        packed[t, :, : own.shape[1]] = own
    return (packed.view(">u8")[:, :, 0] >> np.uint64(64 - KEY_BITS)).astype(np.int64) + (np.arange(TABLES)[:, None] << KEY_BITS)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(2, dtype=np.int32)


def cells(bits: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each descriptor of a bucket, the number of its cell's leader, and the distance to it: the nearest earlier leader within CELL_DISTANCE, else itself."""
    n = len(bits)
    leader = np.arange(n)
    leaders = np.zeros(0, np.int64)
    for start in range(0, n, block):
        own = bits[start : start + block]
        best, to = np.full(len(own), BITS + 1), np.arange(start, start + len(own))
        for k in range(0, len(leaders), 4096):
            d = distances(own, bits[leaders[k : k + 4096]])
            near = d.argmin(1)
            least = d[np.arange(len(own)), near]
            better = least < best
            best[better], to[better] = least[better], leaders[k + near[better]]
        free = np.flatnonzero(best > CELL_DISTANCE)
        among = distances(own[free], own[free])
        led = np.zeros(len(free), bool)  # whether one is a leader
        lonely = (among <= CELL_DISTANCE).sum(1) == 1
        led[lonely] = True
        to[free[lonely]] = start + free[lonely]
        for i in np.flatnonzero(~lonely):
            d = np.where(led[:i], among[i, :i], BITS + 1)
            if i and d.min() <= CELL_DISTANCE:
                to[free[i]] = start + free[d.argmin()]
            else:
                led[i], to[free[i]] = True, start + free[i]
        leader[start : start + len(own)] = to
        leaders = np.concatenate([leaders, start + free[led]])
    return leader, np.bitwise_count(bits ^ bits[leader]).sum(1, dtype=np.int32)


def consensus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """How many matches of two images' corners agree with one similarity transform."""
    if not len(a[0]) or not len(b[0]):
        return 0
    distance = np.bitwise_count(a[1][:, None, :] ^ b[1][None, :, :]).sum(2)
    to, back = distance.argmin(1), distance.argmin(0)
    i = np.flatnonzero((back[to] == np.arange(len(to))) & (distance[np.arange(len(to)), to] <= MOST_DISTANCE))
    if len(i) < LEAST_INLIERS:
        return 0
    p, q = a[0][i], b[0][to[i]]
    turn, size = q[:, 3] - p[:, 3], q[:, 2] / p[:, 2]
    m = size * np.exp(1j * turn)  # each match's rotation and scale; its shift follows
    x, y = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    error = np.abs(m[:, None] * x[None, :] + (y - m * x)[:, None] - y[None, :])
    agree = error < REPROJECTION
    best = agree[agree.sum(1).argmax()]
    return len({(round(u), round(v)) for u, v in p[best, :2]})


def surroundings(spots: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each corner of an image, 7 * AROUND + 4 bytes: of the AROUND nearest others 32 bits of the descriptor, place (x, y) and angle; then its own scale.

    Places are in half pixels of the corner's scale, and turned with it, so they and the angles are the same in any copy. -128: there is none.
    """
    n = len(spots)
    at = spots[:, 0] + 1j * spots[:, 1]
    far = np.abs(at[:, None] - at[None, :])
    far[far < APART] = np.inf
    k = min(AROUND, n)
    near = np.argpartition(far, k - 1, axis=1)[:, :k] if n else np.zeros((0, 0), np.int64)
    place = (at[near] - at[:, None]) * np.exp(-1j * spots[:, 3:]) / spots[:, 2:3] * 2
    x, y = np.rint(place.real), np.rint(place.imag)
    known = np.isfinite(np.take_along_axis(far, near, 1)) & (np.abs(x) < 128) & (np.abs(y) < 128)
    turn = np.rint((spots[near, 3] - spots[:, 3:]) * (128 / np.pi)).astype(np.int64).astype(np.int8)
    codes, places = np.zeros((n, AROUND), "<u4"), np.full((n, 3 * AROUND), -128, np.int8)
    codes[:, :k] = np.ascontiguousarray(bits[:, :1]).view("<u4")[:, 0][near]
    for i, v in enumerate((np.where(known, x, -128), np.where(known, y, -128), turn)):
        places[:, i * AROUND : i * AROUND + k] = v
    scale = np.repeat(np.rint(spots[:, 2:3] * 32).astype(np.uint8), 4, axis=1)
    return np.concatenate([codes.view(np.uint8), places.view(np.uint8), scale], 1)


def supported(x: np.ndarray, y: np.ndarray, of: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether LEAST_AGREEING corners or more agree, for each corner of surroundings x, by the numbers of, and one of y, by to."""
    got = np.zeros(len(of), bool)
    for start in range(0, len(of), 10_000):
        a, b = x[of[start : start + 10_000]], y[to[start : start + 10_000]]
        own, other = (np.ascontiguousarray(v[:, : 4 * AROUND]).view("<u4") for v in (a, b))
        n, i, j = np.nonzero(np.bitwise_count(own[:, :, None] ^ other[:, None, :]) <= LIKE_BITS)
        p, q = (v[:, 4 * AROUND : -4].view(np.int8).reshape(-1, 3, AROUND) for v in (a, b))
        p, q = p[n, :, i].astype(np.int16), q[n, :, j].astype(np.int16)
        shift, turn = np.hypot(p[:, 0] - q[:, 0], p[:, 1] - q[:, 1]), (p[:, 2] - q[:, 2]).astype(np.int8).astype(np.int16)
        ok = (p[:, 0] > -128) & (q[:, 0] > -128) & (np.abs(turn) < LIKE_TURN) & (shift * np.minimum(a[:, -1], b[:, -1])[n] < LIKE_PIXELS * 2 * 32)
        got[start : start + 10_000] = np.bincount(np.unique(n[ok] * AROUND + i[ok]) // AROUND, minlength=len(a)) >= LEAST_AGREEING
    return got


def image_features(images: DataFrame) -> DataFrame:
    """For each image (node, image, height, width): node, spots (4 half floats a corner) and bits (4 unsigned longs each). Equal nodes give equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_shape: dict[tuple, dict] = defaultdict(dict)  # copies in a row are described once
            for node, x, h, w in zip(*(batch.column(c).to_pylist() for c in ("node", "image", "height", "width")), strict=True):
                whole = h and w and min(h, w) >= LEAST_SIDE and len(x) == h * w
                by_shape[(h, w) if whole else None][node] = x
            for shape, all_of in by_shape.items():
                nodes = list(all_of)
                step = 250 if shape is None else max(1, 250 * SIDE**2 // (shape[0] * shape[1]))
                for k in range(0, len(nodes), step):
                    own = nodes[k : k + step]
                    if shape is None:
                        got = [(np.zeros((0, 4)), np.zeros((0, 4), np.uint64))] * len(own)
                    else:
                        stack = np.stack([np.frombuffer(all_of[i], np.uint8) for i in own]).reshape(-1, *shape)
                        f = -(-max(shape) // MOST_SIDE)
                        if f > 1:
                            stack = stack[:, : shape[0] // f * f, : shape[1] // f * f].reshape(len(own), shape[0] // f, f, shape[1] // f, f).mean((2, 4))
                        got = features(stack)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64()), pa.array([s.astype("<f2").tobytes() for s, _ in got], pa.binary()), pa.array([b.tobytes() for _, b in got], pa.binary())], ["node", "spots", "bits"]
                    )

    return images.select("node", "image", "height", "width").mapInArrow(run, "node long, spots binary, bits binary")


def _corners(batch: pa.RecordBatch) -> list[int]:
    """The number of corners of each image of a batch (bits)."""
    return [len(x) // (BITS // 8) for x in batch.column("bits").to_pylist()]


def _descriptors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """node and descriptor (4 unsigned longs) of each corner of a batch (node, bits)."""
    bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
    return np.repeat(batch.column("node").to_numpy(), _corners(batch)), bits


def _binaries(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    return pa.Array.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def key_counts(found: DataFrame, limit: int) -> DataFrame:
    """For each slot of keys of found (node, bits; a node has one row): common, a bit for each key that two images or more have, and the keys that over limit images have, with their number (hot, images)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            slots, starts = np.unique(keys // SLOT, return_index=True)
            lows, counts = (np.split(x, starts[1:]) for x in ((keys % SLOT).astype("<u2"), n.astype("<u4")))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), *(pa.array([y.tobytes() for y in x], pa.binary()) for x in (lows, counts))], ["slot", "lows", "counts"])

        for batch in batches:
            node, bits = _descriptors(batch)
            for keys in table_keys(bits):
                order = np.lexsort((node, keys))
                k, of = keys[order], node[order]
                held.append(k[np.append(True, (k[1:] != k[:-1]) | (of[1:] != of[:-1]))[: len(k)]])  # an image counts once for a key
            if sum(map(len, held)) > HELD_KEYS:
                yield out()
        if sum(map(len, held)):
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, n = None, np.zeros(SLOT, np.int64)

        def out() -> pa.RecordBatch:
            hot = np.flatnonzero(n > limit)
            own = [[slot], [np.packbits(n > 1).tobytes()], [slot * SLOT + hot], [n[hot]]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(own, (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["slot", "common", "hot", "images"])

        for batch in batches:
            for own, lows, counts in zip(*(batch.column(c).to_pylist() for c in ("slot", "lows", "counts")), strict=True):
                if own != slot:
                    if slot is not None:
                        yield out()
                    slot, n = own, np.zeros(SLOT, np.int64)
                n[np.frombuffer(lows, "<u2")] += np.frombuffer(counts, "<u4")
        if slot is not None:
            yield out()

    counted = found.select("node", "bits").mapInArrow(count, "slot int, lows binary, counts binary")
    return counted.repartition("slot").sortWithinPartitions("slot").mapInArrow(merge, "slot int, common binary, hot array<long>, images array<long>")


def bucket_rows(found: DataFrame, common: np.ndarray, tables: tuple[int, ...] = tuple(range(TABLES))) -> DataFrame:
    """key, node and descriptor d for each descriptor of found (node, bits) and table whose key has its bit in common; if found has root (and spots), also root and around, the surroundings."""
    rooted = "root" in found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bits = _descriptors(batch)
            roots = np.repeat(batch.column("root").to_numpy(), _corners(batch)) if rooted else None
            if rooted:
                cuts = np.cumsum(_corners(batch))[:-1]
                spots = [np.frombuffer(x, "<f2").reshape(-1, 4).astype(np.float64) for x in batch.column("spots").to_pylist()]
                around = np.concatenate([surroundings(x, y) for x, y in zip(spots, np.split(bits, cuts), strict=True)])
            for keys in table_keys(bits)[list(tables)]:
                at = np.flatnonzero(common[keys >> 3] >> (7 - (keys & 7)).astype(np.uint8) & 1)
                more = [pa.array(roots[at], pa.int64()), _binaries(around[at])] if rooted else []
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(nodes[at], pa.int64()), _binaries(bits[at]), *more], ["key", "node", "d", "root", "around"][: 3 + 2 * rooted])

    return found.select("node", "bits", *["root", "spots"] * rooted).mapInArrow(run, "key long, node long, d binary" + ", root long, around binary" * rooted)


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], around: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """columns (key, part, further numbers), descriptors d and, if asked for, surroundings of whole groups of key and part; a batch's last one may go on in the next."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = [batch.column(c).to_numpy() for c in columns]
        key, part = numbers[:2]
        bits = np.frombuffer(b"".join(batch.column("d").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        same = (key == key[-1]) & (part == part[-1])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        more = [np.frombuffer(b"".join(batch.column("around").to_pylist()), np.uint8).reshape(batch.num_rows, -1)] if around else []
        rows = (*numbers, bits, *more)
        if held and (held[0][0][0], held[0][1][0]) != (key[0], part[0]):
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        if cut:
            yield tuple(np.concatenate(x) for x in zip(*held, [y[:cut] for y in rows], strict=True))
            held = []
        held.append(tuple(y[cut:] for y in rows))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _cuts(key: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each group of key and part begins and ends."""
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
    return zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True)


def celled(rows: DataFrame, bits_too: bool = False) -> DataFrame:
    """rows (key, part, node, d) with the node of their cell's leader: key, node, leader, far (the distance), and, with bits_too, d for leaders (null for others).

    A part of a bucket is held in one task. The least node of a cell's first descriptors leads, so the same images lead in many buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, node, bits in _groups(batches, ("key", "part", "node")):
            leader, far = np.arange(len(key)), np.zeros(len(key), np.int32)
            for a, b in _cuts(key, part):
                if b - a > 1:
                    of, far[a:b] = cells(bits[a:b])
                    leader[a:b] = a + of
            raw = bits.tobytes()
            own = pa.array([raw[32 * i : 32 * i + 32] if leader[i] == i else None for i in range(len(key))], pa.binary()) if bits_too else pa.nulls(len(key), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(node[leader]), pa.array(far), own], ["key", "node", "leader", "far", "d"])

    ordered = rows.repartition("key", "part").sortWithinPartitions("key", "part", "node", "d")
    return ordered.mapInArrow(run, "key long, node long, leader long, far int, d binary")


def _voted(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (a, b, far) that met LEAST_VOTES times or more, or once within SURE_DISTANCE."""
    votes = met.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("far").alias("far"))
    return votes.filter((F.col("n") >= LEAST_VOTES) | (F.col("far") <= SURE_DISTANCE)).select("a", "b")


def led(found: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """key, node, leader and far for each descriptor of found that joins another image's cell; and the hot buckets (key, images), None if there are none.

    A hot bucket is cut to parts of at most BUCKET_ROWS images or so. Its parts' leaders are dealt to blocks, and each two
    blocks meet in a task of their own, so any two of them meet and no task holds more than it does at first.
    """
    counts = written(key_counts(found, BUCKET_ROWS), "image-keys")
    known = counts.select("slot", "common").toArrow()  # TABLES << KEY_BITS bits at any size of the table
    common = np.zeros(((TABLES << KEY_BITS) // SLOT, SLOT // 8), np.uint8)
    for slot, bits in zip(known["slot"].to_pylist(), known["common"].to_pylist(), strict=True):
        common[slot] = np.frombuffer(bits, np.uint8)
    rows = bucket_rows(found, common.ravel())
    hot = counts.select(F.explode(F.arrays_zip("hot", "images")).alias("x")).select(F.col("x.hot").alias("key"), F.col("x.images").alias("images"))
    if hot.isEmpty():
        met, hot = celled(rows.withColumn("part", F.lit(0).cast("long"))), None
    else:
        hot = written(hot, "image-hot")
        part = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("images") / BUCKET_ROWS)), F.lit(0).cast("long"))
        first = written(celled(rows.join(hot, "key", "left").select("key", part.alias("part"), "node", "d"), True), "image-cells")
        leaders = first.filter("d IS NOT NULL").select("key", "node", "d").join(hot.select("key"), "key", "left_semi")
        sizes = written(leaders.groupBy("key").agg(F.ceil(F.count("*") * 2 / BUCKET_ROWS).alias("blocks")), "image-leaders")
        own, to = F.pmod(F.xxhash64("node", "d"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        placed = leaders.join(sizes, "key").withColumn("own", own).withColumn("to", to).filter("blocks = 1 OR own <> to")
        again = placed.select("key", (F.least("own", "to") * F.col("blocks") + F.greatest("own", "to")).alias("part"), "node", "d")
        met = first.drop("d").unionByName(celled(again).drop("d"))
    return written(met.filter("node <> leader").select("key", "node", "leader", "far"), "image-led"), hot


def marked(keys: DataFrame) -> np.ndarray:
    """A bit for each key of keys (key), as bucket_rows takes them: 8 MB for any number of keys."""
    bits = np.zeros(((TABLES << KEY_BITS) // 32768, 4096), np.uint8)
    own = keys.groupBy(F.shiftright("key", 15).cast("int").alias("at")).agg(F.bitmap_construct_agg(F.col("key").bitwiseAND(F.lit(32767))).alias("bm")).toArrow()
    for at, bm in zip(own["at"].to_pylist(), own["bm"].to_pylist(), strict=True):
        bits[at] = np.packbits(np.unpackbits(np.frombuffer(bm, np.uint8), bitorder="little"))
    return bits.ravel()


def between_classes(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """a, b and far for each two descriptors of a bucket of rows (key, node, root, d) within CELL_DISTANCE whose images have different roots; b < a.

    If rows have surroundings (around), only those of them that are supported by these: the others are alike by chance, and their number grows with the square of the images.

    A task passes on one row for an image a and all that it met by then, so an image's number is shuffled once for many meetings.
    A hot bucket of several roots is dealt to blocks of BUCKET_ROWS / 2 images or so, and each two blocks meet in a task of
    their own. Rows of one root lie together, so those of a large class are compared with the others' alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        for key, part, root, node, own, bits, *more in _groups(batches, ("key", "part", "root", "node", "own"), around):
            for start, end in _cuts(key, part):
                if root[start] == root[end - 1]:  # sorted by root
                    continue
                cross = own[start:end].min() != own[start:end].max()  # of two blocks, which meet themselves elsewhere
                for i in range(start, end, 256):
                    i_end = min(i + 256, end)
                    # further rows of the class of these all are nothing to them
                    first = int(np.searchsorted(root[start:end], root[i], side="right")) + start if root[i] == root[i_end - 1] else i
                    for j in range(first, end, 4096):
                        j_end = min(j + 4096, end)
                        near = distances(bits[i:i_end], bits[j:j_end])
                        ok = (near <= CELL_DISTANCE) & (root[i:i_end, None] < root[None, j:j_end])
                        if cross:
                            ok &= own[i:i_end, None] != own[None, j:j_end]
                        x, y = np.nonzero(ok)
                        if around and len(x):
                            agree = supported(more[0][i:i_end], more[0][j:j_end], x, y)
                            x, y = x[agree], y[agree]
                        if len(x):
                            found.append((node[i + x], node[j + y], near[x, y].astype(np.int8)))
                            held += len(x)
                    if held > HELD_MEETINGS:
                        yield out(found)
                        found, held = [], 0
        if found:
            yield out(found)

    def out(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        x, y, far = (np.concatenate(v) for v in zip(*found, strict=True))
        a, b = np.maximum(x, y), np.minimum(x, y)
        order = np.argsort(a, kind="stable")
        a = a[order]
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        ends = pa.array(np.append(starts, len(a)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(a[starts]), *(pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (b, far))], ["a", "b", "far"])

    around = "around" in rows.columns
    zero = F.lit(0).cast("long")
    if hot is None:
        dealt = rows.withColumn("part", zero).withColumn("own", zero)
    else:
        mixed = rows.join(F.broadcast(hot), "key").groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.first("images").alias("images")).filter("low < high")
        blocks = written(mixed.select("key", F.ceil(F.col("images") * 2 / BUCKET_ROWS).alias("blocks")), "image-mixed")
        cold = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").withColumn("part", zero).withColumn("own", zero)
        own, to = F.pmod(F.xxhash64("node"), F.col("blocks")), F.explode(F.sequence(zero, F.col("blocks") - 1))
        placed = rows.join(F.broadcast(blocks), "key").withColumn("own", own).withColumn("to", to)
        dealt = cold.unionByName(placed.select(*rows.columns, (F.least("own", "to") * F.col("blocks") + F.greatest("own", "to")).alias("part"), "own"))
    ordered = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "root", "node", "d")
    met = ordered.mapInArrow(run, "a long, b array<long>, far array<tinyint>").repartition("a")
    return met.select("a", F.explode(F.arrays_zip("b", "far")).alias("x")).select("a", "x.b", "x.far")


def image_links(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between images of found (node, spots, bits), and the roots (node, root) of those with links.

    Pairs that meet in buckets and pass the consensus are links. Images are compared with their cells' leaders
    first, and then with all images of the buckets that are not in their class by then and that they have a supported
    meeting with; inside a class links are those that were looked at. One table of keys at a time is shuffled.
    """
    members, hot = led(found)
    a, b = F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")
    tested = written(matched(written(_voted(members.select(a, b, "far")), "image-pairs"), found), "image-matched")
    links = tested.filter(F.col("inliers") >= LEAST_INLIERS).select("a", "b")
    roots = written(components(links, "image-components"), "image-joined")
    # where no descriptor joined a cell, none of the bucket are within CELL_DISTANCE
    rooted = written(found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "image-rooted")
    common = marked(members.select("key"))
    met = [written(between_classes(bucket_rows(rooted, common, (t,)), hot).select("a", "b").distinct(), "image-met") for t in range(TABLES)]
    rest = reduce(DataFrame.unionByName, met).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = written(matched(written(rest, "image-rest"), found), "image-rest-matched").filter(F.col("inliers") >= LEAST_INLIERS).select("a", "b")
    if more.isEmpty():
        return links, roots
    return links.unionByName(more), joined_components(roots, more, "image-rest-components")


def tiles(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows tile, a, b, spots and bits: pairs (a, b) dealt to tiles, and the features of each image a of a tile, once, with null for b.

    Images are dealt to blocks of about MATCHED_BYTES of features and a tile has the pairs of two blocks. So an image's features
    are moved once for each block of those that it is paired with, however many pairs there are.
    """
    size = found.agg(F.sum(F.length("spots") + F.length("bits"))).first()[0] or 0
    blocks = F.lit(max(1, -(-size // MATCHED_BYTES)))
    x, y = (F.pmod(F.xxhash64(c), blocks) for c in ("a", "b"))
    placed = pairs.select((F.least(x, y) * blocks + F.greatest(x, y)).alias("tile"), "a", "b")
    needed = placed.select("tile", F.explode(F.array("a", "b")).alias("node")).distinct()
    features = needed.join(found, "node").select("tile", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "spots", "bits")
    return features.unionByName(placed, allowMissingColumns=True)


def matched(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs (a, b) with the number of matches in geometric consensus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            got: list[tuple[int, int, int]] = []
            for own, a, b, spots, bits in zip(*(batch.column(c).to_pylist() for c in ("tile", "a", "b", "spots", "bits")), strict=True):
                if own != tile:
                    tile, held = own, {}
                if b is None:
                    held[a] = np.frombuffer(spots, "<f2").reshape(-1, 4).astype(np.float64), np.frombuffer(bits, np.uint64).reshape(-1, BITS // 64)
                else:
                    got.append((a, b, consensus(held[a], held[b])))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["a", "b", "inliers"])

    ordered = tiles(pairs, found).repartition("tile").sortWithinPartitions("tile", F.col("b").asc_nulls_first())  # features first
    return ordered.mapInArrow(run, "a long, b long, inliers int")


def image_copies(images: DataFrame, side: int = SIDE) -> DataFrame:
    """A row for each image of images (vec_id, image, and height and width if they differ): vec_id, class_id, n_links.

    class_id is the least vec_id of its copies: of all images that links join, see image_links. n_links is the number
    of links that were looked at between its content and other contents, not of all pairs of its class. Equal images of one shape are one content. Images whose bytes aren't
    height * width (side * side without these columns), null ones and plain ones have no corners; they
    are copies of equal bytes alone. Rows with a null vec_id get the class of their content. No images
    give no rows; further columns are not read.
    """
    with shuffles_dropped(images.sparkSession):
        return _image_copies(images, side)


def _image_copies(images: DataFrame, side: int) -> DataFrame:
    sized = {"height", "width"} <= set(images.columns)
    shape = [F.col(c).cast("int").alias(c) if sized else F.lit(side).alias(c) for c in ("height", "width")]
    rows = images.select(F.col("vec_id").cast("long"), F.coalesce("image", F.lit(b"")).alias("image"), *shape)
    keyed_rows = rows.withColumn("node", F.xxhash64("image", "height", "width"))
    named = written(keyed_rows.select("vec_id", "node"), "images")
    found = written(image_features(keyed_rows).dropDuplicates(["node"]), "image-features")  # features are shuffled, images aren't
    links, roots = image_links(found)
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    own = written(named.groupBy("node").agg(F.min("vec_id").alias("vec_id")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "image-roots")
    least = written(own.groupBy("root").agg(F.min("vec_id").alias("class_id")), "image-least")
    classes = written(own.join(least, "root").join(ends, "node", "left").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "image-classes")
    return named.join(classes, "node").select("vec_id", "class_id", "n_links")


def rendered(vectors: DataFrame, side: int = SIDE, margin: int = 8, seed: int = 11) -> DataFrame:
    """vec_id and image: vectors (vec_id, embedding) as pictures, half of them edited copies, for tables that have no media column.

    An embedding is the weights of fixed smooth patterns. Rows 2 n and 2 n + 1 share a canvas, the sum of both their
    patterns. The even row shows its middle, the odd one an edited view, by n: a crop with other contrast and
    brightness, a noisy one, one turned by a quarter of a radian, or one of 0.85 times the size. Of several rows of a
    vec_id the least embedding counts, and all show the same picture. Canvases without components give null
    images; a row without vec_id has a canvas of its own.
    """

    def view(canvas: np.ndarray, album: int) -> np.ndarray:
        key = xxhash.xxh3_64_intdigest(str(album).encode())
        kind, grid, middle = key % 4, np.arange(side) - (side - 1) / 2, (len(canvas) - 1) / 2
        turn, zoom = (0.25 if kind == 2 else 0.0), (0.85 if kind == 3 else 1.0)
        shift, gain, light = ((margin, 36, 145) if kind == 0 else (0, 45, 128))
        u, v = np.meshgrid(grid, grid, indexing="ij")
        y, x = (np.clip(middle + shift + w / zoom, 0, len(canvas) - 1.001) for w in (u * np.cos(turn) - v * np.sin(turn), u * np.sin(turn) + v * np.cos(turn)))
        i, j = y.astype(int), x.astype(int)
        a, b = y - i, x - j
        got = (canvas[i, j] * (1 - a) + canvas[i + 1, j] * a) * (1 - b) + (canvas[i, j + 1] * (1 - a) + canvas[i + 1, j + 1] * a) * b
        if kind == 1:
            got = got + np.random.default_rng(key).normal(0, 0.1, got.shape)
        return got * gain + light

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, bases = side + 2 * margin, {}
        for batch in batches:
            images = []
            for number, *both in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "a", "b")), strict=True):
                canvas = np.zeros((full, full))
                for vector in filter(None, both):
                    d = len(vector)
                    if d not in bases:
                        noise = np.random.default_rng(seed).normal(size=(d, full, full))
                        bases[d] = box(box(noise, 2), 2).reshape(d, -1)
                    canvas += (np.nan_to_num(np.array(vector, np.float64)) @ bases[d]).reshape(full, full)
                if not any(both):
                    images.append(None)
                    continue
                canvas = (canvas - canvas.mean()) / (canvas.std() or 1.0)
                edited = number is not None and number & 1
                picture = view(canvas, number >> 1) if edited else canvas[margin : margin + side, margin : margin + side] * 45 + 128
                images.append(np.clip(np.rint(picture), 0, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(images, pa.binary())], ["vec_id", "image"])

    named = vectors.select(F.col("vec_id").cast("long"), "embedding", F.shiftright(F.col("vec_id").cast("long"), 1).alias("album"))
    least = lambda odd: F.min(F.when(F.col("vec_id").bitwiseAND(F.lit(1)) == odd, F.col("embedding")))
    albums = named.filter("vec_id IS NOT NULL").groupBy("album").agg(least(0).alias("a"), least(1).alias("b"))
    pictures = named.filter("vec_id IS NOT NULL").select("vec_id", "album").join(albums, "album").select("vec_id", "a", "b")
    alone = named.filter("vec_id IS NULL").select("vec_id", F.col("embedding").alias("a"), F.lit(None).cast(vectors.schema["embedding"].dataType).alias("b"))
    return pictures.unionByName(alone).mapInArrow(run, "vec_id long, image binary")
