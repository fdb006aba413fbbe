"""Pictures: decoding, skin heuristic, ring and tile hashes, likeness, variants, certified majorities.

Pixels travel as rows of bytes; each Arrow batch is one pass of small numpy
functions, and nothing is kept between rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumasift.functions.mathx import beta_quantile, norm_ppf
from lumasift.operators.similarity import low_bits, signed

#: Channels of PNG colour types.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: The box of skin colours in Cb and Cr, weights of the three features, bias, cap.
SKIN_CB, SKIN_CR = (77, 127), (133, 173)
SKIN_WEIGHTS, SKIN_BIAS, SKIN_CAP = (1.5, 1.2, 0.3), -0.35, 0.98
#: Cells a side, gray step of an edge, samples a side.
CELLS, EDGE, SAMPLES = 8, 40, 64
#: Angles, bands, samples of each, radii as shares of the side, share below which a band has no structure.
ANGLES, BANDS, FINE_ANGLES, FINE_RADII, OUTER, INNER, FLAT, NO_STRUCTURE = 32, 4, 128, 32, 0.45, 0.10, 0.06, 1e-9
#: Side of the square that tiles are cut from, and the ladder of centre crops.
TILE_SIDE, LADDER = 128, (2**-0.5, 2**-1.5)
#: Sides below which a picture is enlarged and from which it is cut in four.
SMALL_PX, LARGE_PX = 300, 600


def decode_png(data: bytes | None) -> np.ndarray | None:
    """Height x width x 3 bytes of a PNG; None where png_pixels() has a reason."""
    return png_pixels(data)[0]


def png_pixels(data: bytes | None) -> tuple[np.ndarray | None, str | None]:
    """Height x width x 3 bytes of a PNG of 8 or 16 bits (the high ones count) or with a palette, and why there are none.

    Reasons: empty, no png, broken, unsupported (interlaced, or fewer bits).
    """
    if not data:
        return None, "empty"
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None, "no png"
    at, packed, head, palette = 8, [], None, None
    try:
        while at < len(data):
            n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + n]
            if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
                return None, "broken"
            if kind == b"IHDR":
                head = body
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed.append(body)
            elif kind == b"IEND":
                break
            at += 12 + n
        w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
        c = CHANNELS[head[9]]
        if head[8] not in (8, 16) or head[12] or not w * h:
            return None, "unsupported"
        wide = c * head[8] // 8  # bytes of a pixel
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * wide)
    except (KeyError, TypeError, IndexError, ValueError, zlib.error):
        return None, "broken"
    rows, above = np.zeros((h, w, wide), np.uint8), np.zeros((w, wide), np.int64)
    for y in range(h):
        line = raw[y, 1:].reshape(w, wide).astype(np.int64)
        kind = raw[y, 0]
        if kind == 1:
            line = np.cumsum(line, 0)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            left, corner = np.zeros(wide, np.int64), np.zeros(wide, np.int64)
            for x in range(w):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    far = np.abs(np.stack([p - left, p - up, p - corner]))
                    guess = np.choose(far.argmin(0), np.stack([left, up, corner]))
                left, corner = (line[x] + guess) & 255, up
                line[x] = left
        elif kind:
            return None, "broken"
        above = line & 255
        rows[y] = above
    rows = rows[:, :, :: head[8] // 8]
    if head[9] == 3:
        if palette is None or rows.max() >= len(palette):
            return None, "broken"
        return palette[rows[:, :, 0]], None
    return (rows[:, :, :3] if c >= 3 else np.repeat(rows[:, :, :1], 3, 2)), None


def decoded(files: DataFrame, at_once: int = 64) -> DataFrame:
    """path, width, height, rgb, reason of rows of the binaryFile source; where a file can't be decoded, reason says why."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                made = [png_pixels(x) for x in batch.column(1).to_pylist()]
                sizes = [(None, None, None) if x is None else (x.shape[1], x.shape[0], x.tobytes()) for x, _ in made]
                columns = [pa.array([size[k] for size in sizes], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([r for _, r in made], pa.string())], names=["path", "width", "height", "rgb", "reason"])

    return files.select("path", "content").mapInArrow(apply, "path string, width int, height int, rgb binary, reason string")


def _per_image(images: DataFrame, make: Callable[[np.ndarray], tuple], columns: str, kinds: list[pa.DataType]) -> DataFrame:
    """id and what ``make`` gives for each picture (id, width, height, rgb); null for missing or mismatched pixels."""
    names = [c.split()[0] for c in columns.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                w, h, rgb = (batch.column(j)[k].as_py() for j in (1, 2, 3))
                sound = rgb is not None and w and h and len(rgb) == 3 * w * h
                rows.append(make(np.frombuffer(rgb, np.uint8).reshape(h, w, 3)) if sound else (None,) * len(names))
            made = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(made, kinds))], names=["id", *names])

    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", "width", "height", "rgb").mapInArrow(apply, f"id {kind}, {columns}")


def gray_of(rgb: np.ndarray) -> np.ndarray:
    return (rgb.astype(np.int64) @ np.array([299, 587, 114])) // 1000


# -- skin -----------------------------------------------------------------------------------------


def largest_blob(cells: np.ndarray) -> int:
    """Cells of the largest region that touches by sides."""
    label = np.where(cells, np.arange(1, cells.size + 1).reshape(cells.shape), 0)
    while True:
        wide = np.pad(label, 1)
        near = np.maximum.reduce([wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])
        grown = np.where(cells, near, 0)
        if (grown == label).all():
            return int(np.bincount(label.ravel())[1:].max(initial=0))
        label = grown


def skin_features(rgb: np.ndarray) -> tuple[float, float, float, float]:
    """Shares of skin, of the largest blob of skin cells and of edges, over a grid of samples; and the probability."""
    h, w, _ = rgb.shape
    some = rgb[:: max(1, h // SAMPLES), :: max(1, w // SAMPLES)]
    r, g, b = (some[:, :, k].astype(float) for k in range(3))
    cb = 128 - 0.168736 * r - 0.331264 * g + 0.5 * b
    cr = 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
    skin = (cb >= SKIN_CB[0]) & (cb <= SKIN_CB[1]) & (cr >= SKIN_CR[0]) & (cr <= SKIN_CR[1])
    rows, cols = skin.shape
    cell = (np.arange(rows) * CELLS // rows)[:, None] * CELLS + (np.arange(cols) * CELLS // cols)[None, :]
    total = np.bincount(cell.ravel(), minlength=CELLS * CELLS)
    hits = np.bincount(cell.ravel(), skin.ravel(), minlength=CELLS * CELLS)
    blob = largest_blob(((total > 0) & (2 * hits >= total)).reshape(CELLS, CELLS)) / CELLS**2
    gray = gray_of(some)
    edge = np.zeros(gray.shape, bool)
    edge[:, 1:] |= np.abs(np.diff(gray, axis=1)) > EDGE
    edge[1:] |= np.abs(np.diff(gray, axis=0)) > EDGE
    shares = (float(skin.mean()), blob, float(edge.mean()))
    return (*shares, min(SKIN_CAP, max(0.0, sum(a * x for a, x in zip(SKIN_WEIGHTS, shares)) + SKIN_BIAS)))


def skin_scores(images: DataFrame, least_px: int = 200) -> DataFrame:
    """id, skin_ratio, max_blob, edge_density, prob, small; null for pictures without pixels."""
    made = _per_image(images, skin_features, "skin_ratio double, max_blob double, edge_density double, prob double", [pa.float64()] * 4)
    small = images.select("id", ((F.col("width") < least_px) & (F.col("height") < least_px)).alias("small"))
    return made.join(small, "id")


# -- hashes ---------------------------------------------------------------------------------------


def _sampled(gray: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at places between pixels, linear on both axes."""
    y, x = np.clip(y, 0, gray.shape[0] - 1), np.clip(x, 0, gray.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, gray.shape[0] - 1), np.minimum(x0 + 1, gray.shape[1] - 1)
    fy, fx = y - y0, x - x0
    return (gray[y0, x0] * (1 - fx) + gray[y0, x1] * fx) * (1 - fy) + (gray[y1, x0] * (1 - fx) + gray[y1, x1] * fx) * fy


def resized(gray: np.ndarray, side: int) -> np.ndarray:
    """A square of ``side``: means of areas, or values between pixels where it grows."""
    h, w = gray.shape
    fine = [max(1, -(-n // side)) for n in (h, w)]
    y = (np.arange(side * fine[0]) + 0.5) * h / (side * fine[0]) - 0.5
    x = (np.arange(side * fine[1]) + 0.5) * w / (side * fine[1]) - 0.5
    return _sampled(gray.astype(float), y[:, None], x[None, :]).reshape(side, fine[0], side, fine[1]).mean((1, 3))


def ring_profile(gray: np.ndarray) -> np.ndarray:
    """Bands x angles: means around the centre of the largest square, the outer band first."""
    side = min(gray.shape)
    cy, cx = (gray.shape[0] - 1) / 2, (gray.shape[1] - 1) / 2
    r = side * (OUTER - (OUTER - INNER) * (np.arange(FINE_RADII) + 0.5) / FINE_RADII)
    a = 2 * np.pi * (np.arange(FINE_ANGLES) + 0.5) / FINE_ANGLES
    fine = _sampled(gray.astype(float), cy + r[:, None] * np.sin(a)[None, :], cx + r[:, None] * np.cos(a)[None, :])
    return fine.reshape(BANDS, FINE_RADII // BANDS, ANGLES, FINE_ANGLES // ANGLES).mean((1, 3))


def _above_median(power: np.ndarray, flat: np.ndarray) -> int:
    """Bits of bands x 8 powers above their band's median, the first highest; none of a flat band."""
    bits = (power > np.median(power, 1, keepdims=True)) & ~flat[:, None]
    return int("".join("1" if b else "0" for b in bits.ravel()), 2)


def dft_ring_hash(gray: np.ndarray) -> int:
    """32 bits that don't change with rotation: magnitudes of the first eight frequencies round each band."""
    p = ring_profile(gray)
    power = np.abs(np.fft.rfft(p, axis=1)[:, 1:9]) ** 2
    return _above_median(power, np.sqrt(power.max(1)) <= FLAT * np.abs(p.sum(1)))


def ring_hash(gray: np.ndarray) -> int:
    """32 bits that change little with small rotations: energies of cosines round each band."""
    p = ring_profile(gray)
    basis = np.cos((2 * np.arange(ANGLES)[None, :] + 1) * np.arange(9)[:, None] * np.pi / (2 * ANGLES))
    c = p @ basis.T
    return _above_median(c[:, 1:] ** 2, np.abs(c[:, 1:]).max(1) <= NO_STRUCTURE * np.abs(c[:, 0]))


def tile_hash(gray: np.ndarray) -> list[int]:
    """12 x 64 bits: the whole, nine overlapping halves, two centre crops."""
    base, quarter = resized(gray, TILE_SIDE), TILE_SIDE // 4
    parts = [base] + [base[y : y + 2 * quarter, x : x + 2 * quarter] for y in range(0, 3 * quarter, quarter) for x in range(0, 3 * quarter, quarter)]
    for share in LADDER:
        side = round(TILE_SIDE * share)
        at = (TILE_SIDE - side) // 2
        parts.append(base[at : at + side, at : at + side])
    return [signed(low_bits(resized(x, 32), 8)) for x in parts]


def shape_hashes(images: DataFrame) -> DataFrame:
    """id, ring, dft_ring (32 bits each), tiles (12 longs)."""
    make = lambda rgb: (ring_hash(gray_of(rgb)), dft_ring_hash(gray_of(rgb)), tile_hash(gray_of(rgb)))
    return _per_image(images, make, "ring long, dft_ring long, tiles array<long>", [pa.int64(), pa.int64(), pa.list_(pa.int64())])


def tile_any_match(a: Column, b: Column) -> Column:
    """Fewest differing bits of any tile of one and any of the other."""
    return F.array_min(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: F.bit_count(x.bitwiseXOR(y))))))


# -- likeness and variants ------------------------------------------------------------------------


def ssims(a: np.ndarray, b: np.ndarray, win: int = 8, peak: float = 255.0, k1: float = 0.01, k2: float = 0.03) -> np.ndarray:
    """Mean structural similarity of each two gray pictures of batches (pictures, height, width) over windows side by side; whole windows count."""
    if a.shape != b.shape:
        raise ValueError(f"pictures of unlike sizes: {a.shape[1:]} and {b.shape[1:]}")
    win = min(win, *a.shape[1:])
    h, w = (n // win for n in a.shape[1:])
    x, y = (v[:, : h * win, : w * win].astype(float).reshape(-1, h, win, w, win).transpose(0, 1, 3, 2, 4).reshape(len(a), h * w, -1) for v in (a, b))
    mx, my = x.mean(2), y.mean(2)
    vx, vy, both = x.var(2), y.var(2), (x * y).mean(2) - mx * my
    c1, c2 = (k1 * peak) ** 2, (k2 * peak) ** 2
    return ((2 * mx * my + c1) * (2 * both + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean(1)


def ssim(a: np.ndarray, b: np.ndarray, win: int = 8, peak: float = 255.0, k1: float = 0.01, k2: float = 0.03) -> float:
    """As ssims(), of two gray pictures."""
    return float(ssims(a[None], b[None], win, peak, k1, k2)[0])


def likeness(pairs: DataFrame, at_once: int = 256) -> DataFrame:
    """id, ssim of rows (id, width, height, rgb_a, rgb_b); null where either lacks pixels.  Pictures of one size are one array, ``at_once`` at a time."""

    @F.pandas_udf("double")
    def of(w: pd.Series, h: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        sound = (a.notna() & b.notna()).to_numpy()
        by: dict[tuple, list[int]] = {}
        for k in np.flatnonzero(sound):
            by.setdefault((int(h.iloc[k]), int(w.iloc[k])), []).append(int(k))
        for (height, width), rows in by.items():
            for start in range(0, len(rows), at_once):
                some = rows[start : start + at_once]
                gray = [gray_of(np.stack([np.frombuffer(side.iloc[k], np.uint8).reshape(height, width, 3) for k in some])) for side in (a, b)]
                out[some] = ssims(*gray)
        return pd.Series(out).where(sound, None).astype("Float64")

    return pairs.select("id", of("width", "height", "rgb_a", "rgb_b").alias("ssim"))


def variants_of(rgb: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """What to score besides a picture: twice its size if it is small, its quarters if it is large."""
    h, w, _ = rgb.shape
    if w < SMALL_PX or h < SMALL_PX:
        y, x = ((np.arange(2 * n) + 0.5) / 2 - 0.5 for n in (h, w))
        grown = np.stack([_sampled(rgb[:, :, k].astype(float), y[:, None], x[None, :]) for k in range(3)], 2)
        return [("up2x", np.floor(grown + 0.5).astype(np.uint8))]
    if w >= LARGE_PX and h >= LARGE_PX:
        return [(f"grid_r{r}c{c}", rgb[(h // 2) * r : h if r else h // 2, (w // 2) * c : w if c else w // 2]) for r in (0, 1) for c in (0, 1)]
    return []


def variants(images: DataFrame) -> DataFrame:
    """id, tag, width, height, rgb, sha256 of the variants of each picture, one row each."""
    kind = images.schema["id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                w, h, rgb = (batch.column(j)[k].as_py() for j in (1, 2, 3))
                if rgb is None or len(rgb) != 3 * w * h:
                    continue
                made = [(tag, x.shape[1], x.shape[0], x.tobytes()) for tag, x in variants_of(np.frombuffer(rgb, np.uint8).reshape(h, w, 3))]
                if made:
                    tags, ws, hs, data = zip(*made)
                    ids = pa.concat_arrays([batch.column(0).slice(k, 1)] * len(made))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(tags), pa.array(ws, pa.int32()), pa.array(hs, pa.int32()), pa.array(data, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in data])], names=["id", "tag", "width", "height", "rgb", "sha256"])

    return images.select("id", "width", "height", "rgb").mapInArrow(apply, f"id {kind}, tag string, width int, height int, rgb binary, sha256 string")


# -- certified majorities -------------------------------------------------------------------------


def certified_radius(n: int, first: int, second: int, sigma: float, alpha: float = 0.05) -> tuple[float, float, float | None]:
    """Bounds of the first and second class's shares among n noisy copies, and the radius that they certify (None: abstain)."""
    if not 0 <= second <= first or first + second > n or sigma < 0:
        raise ValueError("counts or noise out of bounds")
    low = beta_quantile(alpha / 2, first, n - first + 1) if first else 0.0
    high = beta_quantile(1 - alpha / 2, second + 1, n - second) if second < n else 1.0
    return low, high, sigma / 2 * (norm_ppf(low) - norm_ppf(high)) if low > high + 1e-12 else None


def noise_consensus(images: DataFrame, sigma: float, copies: int = 64, alpha: float = 0.05, line: float = 0.5, seed: int = 5) -> DataFrame:
    """id, label, votes, radius: what most noisy copies of a picture are by the skin heuristic, with its certificate.

    label: nsfw, clean, or abstain without a certificate.  Noise is drawn from a
    seed of the picture's own bytes, so reruns agree.
    """

    def make(rgb: np.ndarray) -> tuple:
        rng = np.random.default_rng([seed, zlib.crc32(rgb.tobytes())])
        hits = 0
        for _ in range(copies):
            noisy = np.clip(np.floor(rgb + rng.normal(0, sigma, rgb.shape) + 0.5), 0, 255).astype(np.uint8)
            hits += skin_features(noisy)[3] >= line
        most = max(hits, copies - hits)
        radius = certified_radius(copies, most, copies - most, sigma, alpha)[2]
        return ("abstain" if radius is None else "nsfw" if hits > copies - hits else "clean", most, radius)

    return _per_image(images, make, "label string, votes long, radius double", [pa.string(), pa.int64(), pa.float64()])
