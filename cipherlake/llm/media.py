"""Copies among images, cropped or edited ones too, by local descriptors.

Corners (Harris response, several scales) get an orientation from the intensity
centroid of their surroundings and 128 binary tests turned by it. Nine tables
sample 40 of the 128 bits each: a descriptor 6 bits away is met in one table with
probability 0.10, in some table with 0.61. Images that meet in two descriptors
are compared whole: nearest descriptors by Hamming distance must agree on one similarity transform (scale, rotation, shift), for a share of
the corners where the images overlap.

Recall. Of a link's five matches or more, each at the full distance of 6 bits,
two are met with probability 0.92; closer or more matches raise it.

Scale. Images with equal bytes are one class before anything else. Table entries
that nothing shares are dropped by a count of keys alone. The members of an entry
are compared with one leader, the smallest id, so a group of
edited copies costs its size and not its square. Entries whose members are in
several components afterwards are finished exactly: their members outside the
largest component meet all others of another component, and images with one
descriptor at most 6 bits apart are compared whole; only such can match. An entry of more than
``SPLIT`` members is parted by the bits that its table has not sampled, in 7 pieces:
descriptors at most 6 bits apart agree in one of them, so nothing is lost.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cipherlake.functions.components import components
from cipherlake.functions.storage import materialise
from cipherlake.llm.common import parts, possibly_in

SCALES = (1.0, 1.25, 1.5625)
RADIUS, BITS, ANGLES = 10, 128, 32
TABLES, SAMPLED, MOST_BITS = 9, 40, 6
#: Descriptors of an image that meet some of a leader, for the two to be compared.
HITS = 2
#: Members of an entry that meet each other at most, but for what two partings leave together.
SPLIT = 512
#: Images of a group, about; pairs of groups are verified together.
GROUP = 8192
#: Rows of a distance or transform table that are held at a time.
ROWS = 256
#: A keypoint: x, y, scale, angle as float32, and the descriptor as 16 bytes.
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("s", "<f4"), ("a", "<f4"), ("d", "u1", (BITS // 8,))])
_GRID = np.stack(np.meshgrid(*[np.arange(-RADIUS, RADIUS + 1)] * 2, indexing="ij"), -1)
_DISC = _GRID[(_GRID**2).sum(-1) <= RADIUS**2]


def decode(data: bytes | None) -> np.ndarray | None:
    """Gray values (0 to 255) of a binary PNM or an 8-bit, not interlaced PNG without a palette; None for anything else."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            fields = data[2:80].split(None, 3)[:3]
            width, height, most = map(int, fields)
            planes = 1 if data[:2] == b"P5" else 3
            if most > 255 or width < 1 or height < 1:
                return None
            raw = np.frombuffer(data[len(data) - width * height * planes :], np.uint8).reshape(height, width, planes)
            return raw.mean(-1)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, struct.error, zlib.error, KeyError, UnboundLocalError):
        return None
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, packed = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    planes = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or interlaced or width * height == 0:
        return None
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * planes)
    kind, line = rows[:, 0], rows[:, 1:].reshape(height, width, planes).astype(np.int16)
    out = np.zeros((height + 1, width + 1, planes), np.int16)
    # a pixel needs the ones left of it, above and between: anti-diagonals are free of each other
    for k in range(height + width - 1):
        y = np.arange(max(0, k - width + 1), min(height, k + 1))
        x = k - y
        left, above, corner, how = out[y + 1, x], out[y, x + 1], out[y, x], kind[y][:, None]
        a, b, c = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = np.select([how == 1, how == 2, how == 3, how == 4], [left, above, (left + above) // 2, paeth], 0)
        out[y + 1, x + 1] = (line[y, x] + guess) & 255
    return out[1:, 1:, : 3 if planes >= 3 else 1].mean(-1)


def _smooth(x: np.ndarray) -> np.ndarray:
    """Binomial smoothing of the last two axes, edges repeated."""
    for axis in (-2, -1):
        p = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(2, 2) if a == axis else (0, 0) for a in (-2, -1)], mode="edge")
        n = x.shape[axis]
        cut = lambda i: p[..., i : i + n, :] if axis == -2 else p[..., i : i + n]
        x = (cut(0) + cut(4) + 4 * (cut(1) + cut(3)) + 6 * cut(2)) * np.float32(1 / 16)
    return x


def resize(x: np.ndarray, by: float) -> np.ndarray:
    """The last two axes smaller by ``by`` (larger below 1), bilinear; smoothed first where it shrinks."""
    if by == 1:
        return x
    if by > 1:
        x = _smooth(x)
    h, w = (max(1, int(n / by)) for n in x.shape[-2:])
    ys, xs = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in zip((h, w), x.shape[-2:]))
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, x.shape[-2] - 1), np.minimum(x0 + 1, x.shape[-1] - 1)
    fy, fx = (ys - y0)[:, None].astype(x.dtype), (xs - x0).astype(x.dtype)
    x = x[..., y0, :] * (1 - fy) + x[..., y1, :] * fy
    return x[..., x0] * (1 - fx) + x[..., x1] * fx


def _tests() -> np.ndarray:
    """Offsets of the binary tests by angle: (angle, bit, end, yx)."""
    rng = np.random.default_rng(8)
    ends = np.clip(rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS * 0.68, RADIUS * 0.68)
    turn = np.arange(ANGLES) * 2 * np.pi / ANGLES
    cos, sin = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    y, x = ends[..., 0], ends[..., 1]
    return np.rint(np.stack([cos * y + sin * x, cos * x - sin * y], -1)).astype(int)


TESTS = _tests()
#: Bits of the descriptor that each table samples.
SAMPLES = np.stack([np.random.default_rng(100 + t).permutation(BITS)[:SAMPLED] for t in range(TABLES)])


def _corners(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(image, point) of all corners of equally large images: every local maximum of the response, at every scale."""
    which, found = [np.empty(0, np.int64)], [np.empty(0, POINT)]
    for by in SCALES:
        x = _smooth(resize(stack, by))
        edge = RADIUS + 1
        if min(x.shape[1:]) < 2 * edge + 1:
            break
        gy, gx = np.gradient(x, axis=(1, 2))
        a, b, c = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
        response = a * b - c * c - np.float32(0.05) * (a + b) ** 2
        h, w = x.shape[1:]
        inner = response[:, edge:-edge, edge:-edge]
        top = inner > 1.0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    top &= inner > response[:, edge + dy : h - edge + dy, edge + dx : w - edge + dx]
        image, ys, xs = np.nonzero(top)
        ys, xs = ys + edge, xs + edge
        out = np.empty(len(ys), POINT)
        out["x"], out["y"], out["s"] = (xs + 0.5) * by, (ys + 0.5) * by, by
        flat, at = x.reshape(-1), (image * h + ys) * w + xs
        for k in range(0, len(at), 4096):
            part = slice(k, k + 4096)
            patch = flat[at[part, None] + _DISC[:, 0] * w + _DISC[:, 1]]
            angle = np.arctan2(patch @ _DISC[:, 0], patch @ _DISC[:, 1])
            tests = TESTS[np.rint(angle * ANGLES / (2 * np.pi)).astype(int) % ANGLES]
            values = flat[at[part, None, None] + tests[..., 0] * w + tests[..., 1]]
            out["a"][part] = angle
            out["d"][part] = np.packbits(values[..., 0] < values[..., 1], axis=1)
        which.append(image)
        found.append(out)
    return np.concatenate(which), np.concatenate(found)


def keypoints(images: list[np.ndarray | None]) -> list[np.ndarray]:
    """All corners of each image, with descriptors; images of one size are worked on together."""
    out = [np.empty(0, POINT) for _ in images]
    by_shape: dict[tuple, list[int]] = {}
    for k, x in enumerate(images):
        if x is not None:
            by_shape.setdefault(x.shape, []).append(k)
    for places in by_shape.values():
        which, found = _corners(np.stack([images[k] for k in places]).astype(np.float32))
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(places) + 1))
        for i, k in enumerate(places):
            out[k] = found[order[bounds[i] : bounds[i + 1]]]
    return out


def _words(points: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(points["d"]).view("<u8").reshape(-1, 2)


def matches(p: np.ndarray, q: np.ndarray, most_bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``p`` and ``q`` of descriptors that are each other's nearest, at most ``most_bits`` apart."""
    a, b = _words(p), _words(q)
    near, gaps = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    back, least = np.zeros(len(q), np.int64), np.full(len(q), BITS + 1)
    for k in range(0, len(p), ROWS):
        gap = np.bitwise_count(a[k : k + ROWS, None, 0] ^ b[:, 0]).astype(np.int64) + np.bitwise_count(a[k : k + ROWS, None, 1] ^ b[:, 1])
        near[k : k + ROWS], gaps[k : k + ROWS] = gap.argmin(1), gap.min(1)
        low, at = gap.min(0), gap.argmin(0) + k
        closer = low < least
        back[closer], least[closer] = at[closer], low[closer]
    i = np.flatnonzero((gaps <= most_bits) & (back[near] == np.arange(len(p))))
    return i, near[i]


def agreeing(p: np.ndarray, q: np.ndarray, shift: float = 4.0) -> tuple[int, int]:
    """(matches that agree on one similarity transform, corners of the fewer side where the images overlap under it)."""
    if not len(p) or not len(q):
        return 0, 0
    i, j = matches(p, q)
    if not len(i):
        return 0, 0
    a, b = p[i].astype(POINT), q[j]
    scale, turn = np.log(b["s"] / a["s"]), b["a"] - a["a"]
    cos, sin = np.exp(scale) * np.cos(turn), np.exp(scale) * np.sin(turn)
    # y points down, angles are by (y, x); a hypothesis is one match's transform, by which the others are moved
    tx, ty = b["x"] - (cos * a["x"] - sin * a["y"]), b["y"] - (sin * a["x"] + cos * a["y"])
    best, at = 0, 0
    for k in range(0, len(i), ROWS):
        c, s = cos[k : k + ROWS, None], sin[k : k + ROWS, None]
        hx, hy = c * a["x"] - s * a["y"] + tx[k : k + ROWS, None], s * a["x"] + c * a["y"] + ty[k : k + ROWS, None]
        close = (np.hypot(hx - b["x"], hy - b["y"]) <= shift * np.maximum(b["s"], 1)) & (np.abs(scale[k : k + ROWS, None] - scale) < 0.3)
        votes = close.sum(1)
        if votes.max() > best:
            best, at = int(votes.max()), k + int(votes.argmax())
    c, s, dx, dy = cos[at], sin[at], tx[at], ty[at]
    over = _inside(c * p["x"] - s * p["y"] + dx, s * p["x"] + c * p["y"] + dy, q)
    size = c * c + s * s
    x, y = q["x"] - dx, q["y"] - dy
    back = _inside((c * x + s * y) / size, (c * y - s * x) / size, p)
    return best, min(over, back)


def _inside(x: np.ndarray, y: np.ndarray, box: np.ndarray) -> int:
    """Points within the extent of ``box``'s corners."""
    return int(((x >= box["x"].min()) & (x <= box["x"].max()) & (y >= box["y"].min()) & (y <= box["y"].max())).sum())


def linked(p: np.ndarray, q: np.ndarray, least: int, share: float) -> bool:
    if min(len(p), len(q)) < least:
        return False
    votes, over = agreeing(p, q)
    return votes >= max(least, share * over)


def pictures(vectors: DataFrame, cells: int = 12, side: int = 48) -> DataFrame:
    """(id, image): every row (id, values) drawn as a binary PGM, and some rows once more as an edited copy.

    Each of ``cells`` times ``cells`` brightnesses is a fixed random mixture of the
    values, enlarged to ``side`` pixels; near vectors make near pictures. The
    picture of row ``id`` has the id ``2 * id``. Where crc32 of the id is divisible
    by 4, a crop, noise, quarter turn, contrast or enlargement of it, as the rest of the
    crc says, has the id ``2 * id + 1``. Null and empty values give null images.
    """

    def draw(values) -> np.ndarray | None:
        if values is None or not len(values):
            return None
        v = np.nan_to_num(np.asarray([0 if x is None else x for x in values], float))
        mixed = np.random.default_rng(len(v)).normal(size=(cells * cells, len(v))) @ v
        x = np.clip(128 + 50 * mixed / max(np.linalg.norm(v), 1e-12), 0, 255)
        return resize(x.reshape(cells, cells), cells / side)

    def edit(x: np.ndarray, seed: int) -> np.ndarray:
        cut = max(1, len(x) // 7)
        kind = seed // 4 % 5
        if kind == 0:
            return x[cut:, : -cut // 2]
        if kind == 1:
            return x + np.random.default_rng(seed).normal(0, 3, x.shape)
        if kind == 2:
            return np.rot90(x)
        return 0.8 * x + 20 if kind == 3 else resize(x, 0.8)

    def pgm(x: np.ndarray) -> bytes:
        return b"P5 %d %d 255\n" % (x.shape[1], x.shape[0]) + np.clip(np.rint(x), 0, 255).astype(np.uint8).tobytes()

    def run(batches):
        for batch in parts(batches):
            ids, images = [], []
            for i, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, seed = draw(values), zlib.crc32(str(i).encode())
                ids.append(None if i is None else 2 * i)
                images.append(None if x is None else pgm(x))
                if x is not None and i is not None and seed % 4 == 0:
                    ids.append(2 * i + 1)
                    images.append(pgm(edit(x, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], ["id", "image"])

    return vectors.mapInArrow(run, "id long, image binary")


def descriptors(images: DataFrame) -> DataFrame:
    """(id, k1, k2, points, n_points) of rows (id, image): a 128-bit key of the bytes, the keypoints as bytes."""

    def run(batches):
        for batch in parts(batches, 64):
            data = batch.column(1).to_pylist()
            points = keypoints([decode(d) for d in data])
            keys = [np.frombuffer(hashlib.blake2b(d or b"", digest_size=16).digest(), np.int64) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([int(k[i]) for k in keys], pa.int64()) for i in (0, 1)], pa.array([p.tobytes() for p in points], pa.binary()), pa.array([len(p) for p in points], pa.int64())], ["id", "k1", "k2", "points", "n_points"])

    return images.mapInArrow(run, "id long, k1 long, k2 long, points binary, n_points long")


def _entries(reps: DataFrame) -> DataFrame:
    """(bucket, id, p): the table entries of every descriptor; a bucket is a table and its sampled bits, p the place of the descriptor."""

    def run(batches):
        for batch in parts(batches, 500):
            data = [np.frombuffer(p, POINT) for p in batch.column(1).to_pylist()]
            if not sum(map(len, data)):
                continue
            ids = pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(p) for p in data]), pa.int64())
            place = pa.array(np.concatenate([np.arange(len(p), dtype=np.int32) for p in data]))
            bits = np.unpackbits(np.concatenate(data)["d"], axis=1)
            for t, sample in enumerate(SAMPLES):
                packed = np.zeros((len(bits), 8), np.uint8)
                packed[:, 0], packed[:, 1 : 1 + SAMPLED // 8] = t, np.packbits(bits[:, sample], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(packed.view("<i8")[:, 0]), ids, place], ["bucket", "id", "p"])

    return reps.select("id", "points").mapInArrow(run, "bucket long, id long, p int")


def _proposed(met: DataFrame) -> DataFrame:
    """(u, v) of rows (u, v, p), descriptors of v that met one of u: pairs with ``HITS`` different ones."""
    return met.distinct().groupBy("u", "v").agg(F.count("*").alias("n")).where(F.col("n") >= HITS).select("u", "v")


def _led(met: DataFrame) -> DataFrame:
    """(u, v): members of an entry with its leader, the smallest id."""
    lead = met.groupBy("bucket").agg(F.min("id").alias("u"), F.max("id").alias("top")).where("u <> top").select("bucket", "u")
    return _proposed(met.join(lead, "bucket").where("id <> u").select("u", F.col("id").alias("v"), "p"))


def _descriptor_words(items: DataFrame) -> DataFrame:
    """(id, p, a, b): the two halves of every descriptor."""

    def run(batches):
        for batch in parts(batches, 500):
            data = [np.frombuffer(p, POINT) for p in batch.column(1).to_pylist()]
            if not sum(map(len, data)):
                continue
            ids = pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(p) for p in data]), pa.int64())
            halves = _words(np.concatenate(data)).view("<i8")
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([np.arange(len(p), dtype=np.int32) for p in data])), *[pa.array(halves[:, i]) for i in (0, 1)]], ["id", "p", "a", "b"])

    return items.select("id", "points").mapInArrow(run, "id long, p int, a long, b long")


def _pieces(levels: int = 2) -> list[list[tuple[int, int, int, int]]]:
    """By level, (path, child, mask of a, mask of b): the bits that a path has not used, in one piece more than descriptors of a match differ."""
    left, out, name = {t: np.setdiff1d(np.arange(BITS), s) for t, s in enumerate(SAMPLES)}, [], TABLES
    for _ in range(levels):
        rows, below = [], {}
        for path, places in left.items():
            for j in range(MOST_BITS + 1):
                piece = places[j :: MOST_BITS + 1]
                mask = np.packbits(np.isin(np.arange(BITS), piece)).view("<i8")
                rows.append((path, name, int(mask[0]), int(mask[1])))
                below[name] = np.setdiff1d(places, piece)
                name += 1
        out.append(rows)
        left = below
    return out


def _parted(rows: DataFrame) -> DataFrame:
    """``rows (bucket, path, n, a, b, ...)`` with entries of more than ``SPLIT`` members parted: any two at most ``MOST_BITS`` apart stay together in one part."""
    done = None
    for level in _pieces():
        crowded = rows.where(F.col("n") > SPLIT)
        if crowded.isEmpty():
            break
        small = rows.where(F.col("n") <= SPLIT)
        done = small if done is None else done.unionByName(small)
        masks = rows.sparkSession.createDataFrame(level, "path int, child int, ma long, mb long")
        key = F.xxhash64("bucket", "child", F.col("a").bitwiseAND(F.col("ma")), F.col("b").bitwiseAND(F.col("mb")))
        cut = crowded.join(F.broadcast(masks), "path").withColumns({"bucket": key, "path": F.col("child")}).drop("child", "ma", "mb", "n")
        rows = materialise(cut.join(cut.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket").select(*rows.columns), "parted")
    return rows if done is None else done.unionByName(rows)


def _unled(met: DataFrame, comp: DataFrame, items: DataFrame) -> DataFrame:
    """(u, v): what leaders have not joined, members of an entry in different components with a descriptor at most ``MOST_BITS`` apart; those of its largest one not with each other."""
    placed = met.join(comp.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "p", F.coalesce("component", "id").alias("comp"))
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top"))
    # of two members one led
    open_ = whole.where("n > 2 and comps > 1").select("bucket", "n", F.col("top.comp").alias("main"))
    placed = placed.join(open_, "bucket").join(_descriptor_words(items), ["id", "p"])
    placed = _parted(materialise(placed.select("bucket", F.expr("CAST(bucket & 255 AS INT)").alias("path"), "n", "id", "comp", "main", "a", "b"), "open")).drop("n", "path")
    a, b = placed.where("comp <> main").alias("a"), placed.alias("b")
    apart = (F.col("a.comp") != F.col("b.comp")) & ((F.col("b.comp") == F.col("b.main")) | (F.col("a.id") < F.col("b.id")))
    gap = F.bit_count(F.col("a.a").bitwiseXOR(F.col("b.a"))) + F.bit_count(F.col("a.b").bitwiseXOR(F.col("b.b")))
    near = (F.col("a.bucket") == F.col("b.bucket")) & apart & (gap <= MOST_BITS)
    return a.join(b, near).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()


def _verified(pairs: DataFrame, items: DataFrame, least: int, share: float) -> DataFrame:
    """Those of ``pairs`` that are linked; points travel once to each pair of groups of images in which they are needed."""
    groups = max(1, -(-items.count() // GROUP))
    group = lambda x: F.pmod(F.xxhash64(F.lit(7), x), F.lit(groups))
    pairs = materialise(pairs.select(F.least(group("u"), group("v")).alias("g"), F.greatest(group("u"), group("v")).alias("h"), "u", "v"), "proposed")
    needed = pairs.select("g", "h", F.explode(F.array("u", "v")).alias("id")).distinct().join(items, "id").select(F.col("g").alias("gp"), F.col("h").alias("hp"), "id", "points")

    def run(met: pa.Table, points: pa.Table) -> pa.Table:
        u, v = (met.column(x).to_numpy() for x in "uv")
        data = {i: np.frombuffer(p, POINT) for i, p in zip(points.column("id").to_pylist(), points.column("points").to_pylist())}
        keep = np.fromiter((linked(data[a], data[b], least, share) for a, b in zip(u.tolist(), v.tolist())), bool, len(u))
        return pa.table({"u": u[keep], "v": v[keep]})

    return materialise(pairs.groupBy("g", "h").cogroup(needed.groupBy("gp", "hp")).applyInArrow(run, "u long, v long"), "verified")


def image_copies(images: DataFrame, least: int = 5, share: float = 0.3) -> DataFrame:
    """One row per row of ``images (id long, image binary)``: id, n_points, component_id, kept.

    Images are linked whose corners agree on one transform, ``least`` of them
    and ``share`` of those where the images overlap at least; ``component_id``
    is the smallest id reachable, ``kept`` says that it is the row's own. All
    corners of an image are used. Equal bytes are one class. A null image, one
    that cannot be decoded (JPEG, 16-bit, palette and interlaced files too) and one
    without corners are linked only with equal bytes, null with nothing. A null
    id has a null component and is kept; repeated ids share what their classes
    have. Other columns are not read.
    """
    rows = materialise(descriptors(images.select("id", "image")), "descriptors")
    named = materialise(images.select("id", F.col("image").isNull().alias("none")).where("none and id is not null").select("id").distinct(), "null-images")
    usable = rows.join(named, "id", "left_anti").where("id is not null")
    reps = materialise(usable.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("points").alias("points")), "classes")
    items = reps.select("id", "points")
    crowded = materialise(_entries(items).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "crowded")
    # entries that are alone and pass the filter propose nothing
    met = materialise(possibly_in(_entries(items), crowded, "bucket"), "met")
    links = _verified(_led(met), items, least, share)
    more = _verified(_unled(met, materialise(components(links), "components"), items), items, least, share)
    comp = materialise(components(links.union(more)), "components")
    by_class = reps.select("k1", "k2", F.col("id").alias("rep")).join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = usable.join(by_class, ["k1", "k2"]).select("id", "n_points", "component_id")
    alone = rows.join(named, "id", "left_semi").union(rows.where("id is null")).select("id", "n_points", "id")
    return out.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
