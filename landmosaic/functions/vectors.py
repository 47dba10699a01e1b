"""Embeddings, logits and pixels. Long vectors go through numpy, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def softmax(v: Column) -> Column:
    most = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - most))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def argmax(v: Column) -> Column:
    """Index (from 0) of the first of the largest values."""
    return F.array_position(v, F.array_max(v)) - 1


def blended(a: Column, b: Column, weight: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: weight * x + (1 - weight) * y)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def average_hash(pixels: Column) -> Column:
    """64 bits of an 8 x 8 image, row by row, the first pixel highest: is the pixel above the mean?"""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(pixels)
    bits = F.transform(pixels, lambda x, i: F.when(x.cast("double") > mean, F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(63) - i).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def pixel_std(pixels: Column) -> Column:
    n = F.size(pixels)
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    return F.sqrt(F.aggregate(pixels, F.lit(0.0), lambda s, x: s + (x.cast("double") - mean) * (x.cast("double") - mean)) / n)


def sharpness(pixels: Column, width: int, height: int) -> Column:
    """Mean square of the differences to the right, plus that of those downwards."""
    square = lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)
    right = F.zip_with(F.slice(pixels, 1, width * height - 1), F.slice(pixels, 2, width * height - 1), square)
    right = F.filter(right, lambda _, i: (i + 1) % width != 0)
    down = F.zip_with(F.slice(pixels, 1, width * (height - 1)), F.slice(pixels, width + 1, width * (height - 1)), square)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return mean(right) + mean(down)


def sky_cropped(pixels: Column, width: int, height: int, share: float) -> Column:
    """The lower `share` of an image."""
    top = 0 if share >= 0.999 else int(height * (1 - share))
    return F.slice(pixels, top * width + 1, (height - top) * width)


def head_scores(rows: DataFrame, weights: np.ndarray, bias: np.ndarray, names: list[str], features: str = "features") -> DataFrame:
    """rows with class_key, confidence and probs of a linear head; one matrix product per batch."""
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, class_key string, confidence double, probs map<string,double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f[features].to_numpy()).astype(float) if len(f) else np.zeros((0, weights.shape[1]))
            z = x @ weights.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            yield f.assign(class_key=[names[i] for i in best], confidence=p.max(axis=1), probs=[dict(zip(names, map(float, r), strict=True)) for r in p])

    return rows.mapInPandas(run, out)


def evidence_boxes(rows: DataFrame, heat: str = "heat", width: str = "width", threshold: float = 0.5) -> DataFrame:
    """rows with box (x0, y0, x1, y1 as shares) around the part of a heat map over the threshold; a fixed box if it is small."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, box array<double>"

    def box(v: np.ndarray, w: int) -> list[float]:
        a = np.asarray(v, float).reshape(-1, w)
        ys, xs = np.nonzero(a >= threshold)
        if len(ys) < max(16, 0.002 * a.size):
            return [0.15, 0.15, 0.85, 0.85]
        spans = [(xs.min() / max(a.shape[1] - 1, 1), xs.max() / max(a.shape[1] - 1, 1)), (ys.min() / max(a.shape[0] - 1, 1), ys.max() / max(a.shape[0] - 1, 1))]
        (x0, x1), (y0, y1) = [(max(0.0, a - 0.05), min(1.0, b + 0.05)) if b - a < 0.05 else (a, b) for a, b in spans]
        return [float(x0), float(y0), float(x1), float(y1)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(box=[box(v, int(w)) for v, w in zip(f[heat], f[width], strict=True)])

    return rows.mapInPandas(run, schema)


MAPS = 256  # sampling maps that a task remembers


@lru_cache(maxsize=MAPS)
def sampling_map(h: int, w: int, heading: float, pitch: float, fov: float, width: int, height: int) -> tuple[np.ndarray, ...]:
    """Where the pixels of a pin-hole view lie in an equirectangular image of that size: places of the four neighbours in its
    pixels, and the shares of the right and lower ones. Headings turn right, pitches up. The same for all images of a size."""
    f = width / 2 / np.tan(np.radians(fov) / 2)
    x, y = np.meshgrid(np.arange(width) - (width - 1) / 2, (height - 1) / 2 - np.arange(height))
    d = np.stack([x, y, np.full_like(x, f)], axis=-1)
    d /= np.linalg.norm(d, axis=-1, keepdims=True)
    p, t = np.radians(pitch), np.radians(heading)
    up, ahead = d[..., 1] * np.cos(p) + d[..., 2] * np.sin(p), d[..., 2] * np.cos(p) - d[..., 1] * np.sin(p)
    lon = np.arctan2(d[..., 0] * np.cos(t) + ahead * np.sin(t), ahead * np.cos(t) - d[..., 0] * np.sin(t))
    lat = np.arcsin(np.clip(up, -1, 1))
    u, v = (lon / (2 * np.pi) + 0.5) * w - 0.5, np.clip((0.5 - lat / np.pi) * h - 0.5, 0, h - 1)
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    y1 = np.minimum(y0 + 1, h - 1)
    places = [(yy * w + xx % w).ravel() for yy in (y0, y1) for xx in (x0, x0 + 1)]
    return (*places, (u - x0).reshape(-1, 1), (v - y0).reshape(-1, 1))


def perspective_view(rgb: np.ndarray, heading: float, pitch: float, fov: float, width: int, height: int) -> np.ndarray:
    """A pin-hole view of an equirectangular image (h, w, 3), with bilinear sampling."""
    h, w = rgb.shape[:2]
    upper_left, upper_right, lower_left, lower_right, a, b = sampling_map(h, w, float(heading), float(pitch), float(fov), width, height)
    flat = rgb.reshape(-1, 3)
    at = lambda i: flat[i].astype(float)
    out = (at(upper_left) * (1 - a) + at(upper_right) * a) * (1 - b) + (at(lower_left) * (1 - a) + at(lower_right) * a) * b
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape(height, width, 3)


def perspective_views(rows: DataFrame, headings: list[float], pitches: list[float], fov: float, width: int, height: int) -> DataFrame:
    """image_path, heading, pitch, rgb of every view of raw equirectangular images (image_path, rgb, width, height).

    An image's bytes come to Python once, whatever the number of its views, which leave one by one: a task holds a batch of
    images and one view. Images whose bytes don't fit their size, or that are null, have no views."""
    looks = [(float(a), float(b)) for a in headings for b in pitches]
    names, kinds = ["image_path", "heading", "pitch", "rgb"], [pa.string(), pa.float64(), pa.float64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sources, ws, hs = (batch.column(i) for i in range(4))
            for path, source, w, h in zip(paths.to_pylist(), sources, ws.to_pylist(), hs.to_pylist(), strict=True):
                pixels = source.as_buffer()
                if pixels is None or not w or not h or w < 0 or h < 0 or len(pixels) != w * h * 3:
                    continue
                image = np.frombuffer(pixels, np.uint8).reshape(h, w, 3)
                for heading, pitch in looks:
                    view = perspective_view(image, heading, pitch, fov, width, height).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, heading, pitch, view), kinds, strict=True)], names)

    images = rows.select(F.col("image_path").cast("string").alias("image_path"), "rgb", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    return images.mapInArrow(run, "image_path string, heading double, pitch double, rgb binary")
