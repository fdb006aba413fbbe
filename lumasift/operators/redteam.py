"""Attacks on pictures and recall of their hashes, in batches: pictures of one size are one array.

An attack is a change that keeps a picture recognisable: another size, a centre
crop, a rotation, a mirror, light, contrast, block quantising, noise, a covered corner.
Attacked pictures are hashed like all others, and a hash kind recalls an
attacked picture if it lies within the kind's distance of its original.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumasift.operators import vision as P
from lumasift.operators.similarity import least_distance, least_view, low_frequencies, meets, packed, pyramid_hashes, quarter_hashes, summed_distance

#: Attacks with their strengths, weakest first.
ATTACKS = {
    "none": ("identity",),
    "resize": ("1.25", "0.75", "1.5", "0.5", "2.0"),
    "crop": ("0.1", "0.2", "0.3"),
    "rotate": ("3", "-3", "8", "-8", "15", "-15"),
    "flip": ("h", "v"),
    "brightness": ("1.2", "0.8", "1.4", "0.6"),
    "contrast": ("1.2", "0.8", "1.4", "0.6"),
    "jpeg": ("60", "30", "10"),
    "noise": ("8", "16", "32"),
    "watermark": ("0.35", "0.6"),
}
#: The standard quantising steps of gray 8 x 8 blocks, in rows.
STEPS = np.array(
    [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
     18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
).reshape(8, 8)
#: What a corner mark covers of each side.
COVER = 0.45
#: Share of the largest frequency within which rounding could decide whether another one is above the median.
CLOSE = 1e-10
#: Bits within which a kind counts as recalled, and its bits.
WITHIN = {"phash": (8, 64), "mirror": (8, 64), "quads": (32, 256), "pyramid": (4, 36), "tiles": (8, 64), "ring": (4, 32), "dft_ring": (4, 32)}


# -- batches of gray pictures (pictures, height, width) -------------------------------------------


def sampled(gray: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float | None = None) -> np.ndarray:
    """Values at places of all pictures, linear on both axes; beyond the edge the nearest pixel, or ``fill``."""
    h, w = gray.shape[1:]
    slack = 1e-9  # of rounding
    inside = (y >= -slack) & (y <= h - 1 + slack) & (x >= -slack) & (x <= w - 1 + slack)
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    out = (gray[:, y0, x0] * (1 - fx) + gray[:, y0, x1] * fx) * (1 - fy) + (gray[:, y1, x0] * (1 - fx) + gray[:, y1, x1] * fx) * fy
    return out if fill is None else np.where(inside, out, fill)


def weights(n: int, side: int) -> np.ndarray:
    """side x n: what each of ``side`` values takes of n ones; means of areas, or values between them where it grows."""
    fine = max(1, -(-n // side))
    at = np.clip((np.arange(side * fine) + 0.5) * n / (side * fine) - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    made = np.zeros((side * fine, n))
    made[np.arange(len(at)), low] += 1 - (at - low)
    made[np.arange(len(at)), np.minimum(low + 1, n - 1)] += at - low
    return made.reshape(side, fine, n).mean(1)


def resized(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    return weights(gray.shape[1], height) @ gray @ weights(gray.shape[2], width).T


def _whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255)


def rotated(gray: np.ndarray, degrees: float, fill: float = 255.0) -> np.ndarray:
    """Turned round the centre; corners that come from outside are ``fill``."""
    h, w = gray.shape[1:]
    a = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w].astype(float)
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    return sampled(gray, (h - 1) / 2 + dy * np.cos(a) + dx * np.sin(a), (w - 1) / 2 - dy * np.sin(a) + dx * np.cos(a), fill)


def quantised(gray: np.ndarray, quality: int) -> np.ndarray:
    """8 x 8 blocks through their cosine transform, rounded to the steps of a quality."""
    h, w = gray.shape[1:]
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    steps = np.clip(np.floor((STEPS * scale + 50) / 100), 1, 255)
    wave = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]
    wide = np.pad(gray, ((0, 0), (0, -h % 8), (0, -w % 8)), mode="edge") - 128
    n, height, width = wide.shape
    blocks = wide.reshape(n, height // 8, 8, width // 8, 8).transpose(0, 1, 3, 2, 4)
    kept = np.round(wave @ blocks @ wave.T / steps) * steps
    back = (wave.T @ kept @ wave).transpose(0, 1, 3, 2, 4).reshape(n, height, width)
    return back[:, :h, :w] + 128


def attacked(gray: np.ndarray, family: str, strength: str, seeds: np.ndarray) -> np.ndarray:
    """Every picture of a batch under one attack, as whole gray values; ``seeds`` (one a picture) fix the noise."""
    h, w = gray.shape[1:]
    g = gray.astype(float)
    if family == "none":
        return g
    if family == "flip":
        return g[:, :, ::-1] if strength == "h" else g[:, ::-1]
    v = float(strength)
    if family == "resize":
        return _whole(resized(g, max(1, round(h * v)), max(1, round(w * v))))
    if family == "crop":
        side = min(h, w, max(1, round((h * w * v) ** 0.5)))
        y, x = (h - side) // 2, (w - side) // 2
        return _whole(resized(g[:, y : y + side, x : x + side], h, w))
    if family == "rotate":
        return _whole(rotated(g, v))
    if family == "brightness":
        return _whole(g * v)
    if family == "contrast":
        return _whole((g - 128) * v + 128)
    if family == "jpeg":
        return _whole(quantised(g, int(v)))
    if family == "noise":
        return _whole(g + np.stack([np.random.default_rng(int(s)).normal(0, v, (h, w)) for s in seeds]))
    if family == "watermark":
        out = g.copy()
        y, x = h - max(1, round(h * COVER)), w - max(1, round(w * COVER))
        out[:, y:, x:] = _whole(out[:, y:, x:] * (1 - v) + 255 * v)
        return out
    raise ValueError(f"no such attack: {family}")


def _rings(gray: np.ndarray) -> np.ndarray:
    """Pictures x bands x angles, as vision.ring_profile() has it."""
    side = min(gray.shape[1:])
    cy, cx = (gray.shape[1] - 1) / 2, (gray.shape[2] - 1) / 2
    r = side * (P.OUTER - (P.OUTER - P.INNER) * (np.arange(P.FINE_RADII) + 0.5) / P.FINE_RADII)
    a = 2 * np.pi * (np.arange(P.FINE_ANGLES) + 0.5) / P.FINE_ANGLES
    fine = sampled(gray, cy + r[:, None] * np.sin(a)[None, :], cx + r[:, None] * np.cos(a)[None, :])
    return fine.reshape(len(gray), P.BANDS, P.FINE_RADII // P.BANDS, P.ANGLES, P.FINE_ANGLES // P.ANGLES).mean((2, 4))


def _band_bits(power: np.ndarray, flat: np.ndarray) -> np.ndarray:
    bits = (power > np.median(power, axis=2, keepdims=True)) & ~flat[:, :, None]
    return packed(bits.reshape(len(power), -1))


def ring_hashes(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and Fourier ring hashes of a batch."""
    p = _rings(gray)
    basis = np.cos((2 * np.arange(P.ANGLES)[None, :] + 1) * np.arange(9)[:, None] * np.pi / (2 * P.ANGLES))
    c = p @ basis.T
    ring = _band_bits(c[:, :, 1:] ** 2, np.abs(c[:, :, 1:]).max(2) <= P.NO_STRUCTURE * np.abs(c[:, :, 0]))
    power = np.abs(np.fft.rfft(p, axis=2)[:, :, 1:9]) ** 2
    return ring, _band_bits(power, np.sqrt(power.max(2)) <= P.FLAT * np.abs(p.sum(2)))


def _tile_spans() -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans (first, behind the last) of a side of the tile base, and the spans of each tile's height and width."""
    quarter = P.TILE_SIDE // 4
    halves = [(at, at + 2 * quarter) for at in range(0, 3 * quarter, quarter)]
    sides = [round(P.TILE_SIDE * share) for share in P.LADDER]
    crops = [((P.TILE_SIDE - side) // 2, (P.TILE_SIDE - side) // 2 + side) for side in sides]
    squares = range(4, 4 + len(crops))
    return [(0, P.TILE_SIDE), *halves, *crops], [(0, 0), *[(y, x) for y in (1, 2, 3) for x in (1, 2, 3)], *zip(squares, squares)]


def tile_hashes_by_steps(gray: np.ndarray) -> np.ndarray:
    """As tile_hashes, every tile drawn."""
    base = resized(gray, P.TILE_SIDE, P.TILE_SIDE)
    spans, tiles = _tile_spans()
    parts = [base[:, slice(*spans[y]), slice(*spans[x])] for y, x in tiles]
    return np.stack([low_frequencies(resized(x, 32, 32), 8) for x in parts], 1)


@cache
def _tile_waves(n: int) -> np.ndarray:
    """What the 8 low frequencies of each span of a side take of its ``n`` pixels, as rows."""
    wave = np.cos((2 * np.arange(32)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 64)
    base = weights(n, P.TILE_SIDE)
    return np.concatenate([wave @ weights(hi - lo, 32) @ base[lo:hi] for lo, hi in _tile_spans()[0]])


def tile_hashes(gray: np.ndarray) -> np.ndarray:
    """Pictures x 12 hashes: the whole, nine overlapping halves, two centre crops.

    Scaling, cutting and frequencies are linear, so they are one small matrix a
    side and no tile is drawn.  Pictures where other rounding could change a bit
    (flat ones, say) take the steps one by one.
    """
    spans, tiles = _tile_spans()
    f = _tile_waves(gray.shape[1]) @ gray @ _tile_waves(gray.shape[2]).T
    f = f.reshape(len(gray), len(spans), 8, len(spans), 8)
    f = np.stack([f[:, y, :, x].reshape(len(gray), 64) for y, x in tiles], 1)
    middle = np.median(f[..., 1:], axis=-1, keepdims=True)
    found = packed(f > middle)
    # one number is the median itself
    close = ((np.abs(f - middle) <= CLOSE * np.abs(f).max(-1, keepdims=True)).sum(-1) > 1).any(1)
    if close.any():
        found[close] = tile_hashes_by_steps(gray[close])
    return found


def all_hashes(gray: np.ndarray) -> dict[str, np.ndarray]:
    """Every kind for a batch of pictures of one size; rows of longs."""
    g = gray.astype(float)
    small = resized(g, 32, 32)
    ring, dft = ring_hashes(g)
    alone = {"phash": low_frequencies(small, 8), "mirror": least_view(small), "ring": ring, "dft_ring": dft}
    return {n: v[:, None] for n, v in alone.items()} | {"quads": quarter_hashes(small), "pyramid": pyramid_hashes(small), "tiles": tile_hashes(g)}


# -- tables ---------------------------------------------------------------------------------------


def by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, gray pictures) of a batch of id, width, height, rgb: those of one size together; broken ones are left out."""
    w, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
    rgb = batch.column(3)
    sound = np.array([x.is_valid and not np.isnan(float(a or 0)) and len(x.as_buffer() or b"") == 3 * (a or 0) * (b or 0) > 0 for x, a, b in zip(rgb, w, h)], bool)
    for size in {(w[k], h[k]) for k in np.flatnonzero(sound)}:
        rows = np.flatnonzero(sound & (w == size[0]) & (h == size[1]))
        pixels = np.stack([np.frombuffer(rgb[int(k)].as_buffer(), np.uint8) for k in rows])
        yield rows, P.gray_of(pixels.reshape(len(rows), int(size[1]), int(size[0]), 3)).astype(float)


def attacked_hashes(images: DataFrame, attacks: dict[str, tuple[str, ...]] | None = None, at_once: int = 256) -> DataFrame:
    """id, family, strength and the hashes of each picture (id long, width, height, rgb) under each attack.

    Batches are cut to ``at_once`` pictures, so memory doesn't grow with the table.
    """
    attacks = attacks or ATTACKS
    names = list(WITHIN)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                for rows, gray in by_size(batch):
                    ids = batch.column(0).take(pa.array(rows))
                    for family, strengths in attacks.items():
                        for strength in strengths:
                            seeds = np.array([zlib.crc32(f"{i}/{family}/{strength}".encode()) for i in ids.to_pylist()])
                            found = all_hashes(attacked(gray, family, strength, seeds))
                            columns = [pa.array(list(found[n]), pa.list_(pa.int64())) for n in names]
                            yield pa.RecordBatch.from_arrays([ids, pa.array([family] * len(rows)), pa.array([strength] * len(rows)), *columns], names=["id", "family", "strength", *names])

    schema = "id long, family string, strength string, " + ", ".join(f"{n} array<long>" for n in names)
    return images.select("id", "width", "height", "rgb").mapInArrow(apply, schema)


def distances(hashes: DataFrame) -> DataFrame:
    """id, family, strength, kind, distance of each attacked picture to its original."""
    own = hashes.filter(F.col("family") == "none").select("id", *[F.col(n).alias(f"own_{n}") for n in WITHIN])
    of = {"pyramid": least_distance, "tiles": P.tile_any_match}
    each = F.array(*[F.struct(F.lit(n).alias("kind"), of.get(n, summed_distance)(F.col(n), F.col(f"own_{n}")).alias("distance")) for n in WITHIN])
    return hashes.join(own, "id").select("id", "family", "strength", F.inline(each))


def recall(hashes: DataFrame) -> DataFrame:
    """family, strength, kind, n, hits, recall: shares of attacked pictures within their kind's distance."""
    within = F.element_at(F.create_map(*[x for n, (d, _) in WITHIN.items() for x in (F.lit(n), F.lit(d))]), F.col("kind"))
    hit = (F.col("distance") <= within).cast("long")
    return distances(hashes).groupBy("family", "strength", "kind").agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.avg(hit).alias("recall"))


def search_recall(hashes: DataFrame, d: int = 8, bands: int | None = None, radius: int | None = None) -> DataFrame:
    """family, strength, n, found: attacked pictures whose original a join over all originals' plain hashes returns."""
    # a search returns the own original if these two are near and share a band, whatever others there are
    own = hashes.filter(F.col("family") == "none").select("id", F.col("phash")[0].alias("own"))
    diff = F.col("phash")[0].bitwiseXOR(F.col("own"))
    met = (F.bit_count(diff) <= d) & (meets(diff, bands, d // bands if radius is None else radius) if bands else F.lit(True))
    return hashes.join(own, "id", "left").groupBy("family", "strength").agg(F.count("*").alias("n"), F.count(F.when(met, 1)).alias("found"))


def weakest(rates: DataFrame, floor: float = 0.9) -> DataFrame:
    """family, kind, recall over all strengths, worst (its lowest recall), least: the first strength below ``floor`` (null: none)."""
    place = F.element_at(F.create_map(*[x for f, own in ATTACKS.items() for k, s in enumerate(own) for x in (F.lit(f"{f}/{s}"), F.lit(k))]), F.concat_ws("/", "family", "strength"))
    fell = F.col("recall") < floor
    return rates.groupBy("family", "kind").agg((F.sum("hits") / F.sum("n")).alias("recall"), F.min("recall").alias("worst"), F.min_by(F.when(fell, F.col("strength")), F.when(fell, place)).alias("least"))
