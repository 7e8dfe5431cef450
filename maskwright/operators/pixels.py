"""Masks drawn into images, and measures of pixels: Arrow batches of images(id, width, height, argb) through numpy.

An image is one row, so that its masks are drawn one after another in one task, in the order of drawing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "id string, width int, height int, argb array<int>"


def _solid(img, box, _, ring):
    l, t, r, b = box
    img[t:b, l:r, :3] = ring if ring is not None else 0
    img[t:b, l:r, 3] = 255


def _pixelate(img, box, scale, _):
    l, t, r, b = box
    block = int(max(min(img.shape[:2]) / 90, 12 * scale))
    if block >= min(r - l, b - t):
        return _solid(img, box, scale, None)
    for y in range(t, b, block):
        for x in range(l, r, block):
            part = img[y : min(y + block, b), x : min(x + block, r)]
            part[:] = part.reshape(-1, 4).mean(axis=0).astype(part.dtype)


def _blur(img, box, scale, _):
    l, t, r, b = box
    radius = max(1, int(4 * scale))
    part = img[t:b, l:r].astype(np.float64)
    for _round in range(3):
        for axis in (0, 1):
            n = part.shape[axis]
            wide = np.pad(part, [(radius + 1, radius) if a == axis else (0, 0) for a in range(3)], mode="edge").cumsum(axis=axis)
            at = np.arange(n)
            part = (np.take(wide, at + 2 * radius + 1, axis=axis) - np.take(wide, at, axis=axis)) / (2 * radius + 1)
    img[t:b, l:r] = part.astype(img.dtype)


STYLES = {"SOLID": _solid, "PIXELATE": _pixelate, "BLUR": _blur}


def _unpack(width, height, argb):
    v = np.array(argb, np.int64).astype(np.uint32).reshape(height, width)
    return np.stack([v >> 16 & 255, v >> 8 & 255, v & 255, v >> 24], axis=2).astype(np.uint8)


def _pack(img):
    v = img.astype(np.uint32)
    return (v[..., 3] << 24 | v[..., 0] << 16 | v[..., 1] << 8 | v[..., 2]).astype(np.uint32).view(np.int32).ravel()


def near_color(img: np.ndarray, box) -> np.ndarray:
    """The upper median per channel of the ring one to four pixels around a box."""
    l, t, r, b = box
    h, w = img.shape[:2]
    xs, ys = np.linspace(l, r - 1, 16).astype(int), np.linspace(t, b - 1, 16).astype(int)
    points = []
    for d in (1, 2, 3):
        points += [(x, t - d) for x in xs] + [(x, b - 1 + d) for x in xs] + [(l - d, y) for y in ys] + [(r - 1 + d, y) for y in ys]
    seen = np.array([img[y, x, :3] for x, y in points if 0 <= x < w and 0 <= y < h] or [[0, 0, 0]])
    return np.sort(seen, axis=0)[len(seen) // 2]


def render(images: DataFrame, plan: DataFrame, scale: float = 1.0) -> DataFrame:
    """images with the masks of plan(page_id, draw, l, t, r, b, style, near) drawn in; colours of the surroundings are taken from
    the untouched image before anything is drawn; unknown styles are solid."""
    mask = F.struct("draw", "l", "t", "r", "b", "style", "near")
    per = plan.groupBy(F.col("page_id").alias("id")).agg(F.sort_array(F.collect_list(mask)).alias("masks"))

    def draw(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                img = _unpack(x["width"], x["height"], x["argb"])
                masks = []
                for m in x["masks"] or []:
                    box = (max(int(m["l"]), 0), max(int(m["t"]), 0), min(int(m["r"]), x["width"]), min(int(m["b"]), x["height"]))
                    if box[0] < box[2] and box[1] < box[3]:
                        masks.append((m["style"], box, near_color(img, box) if m["near"] else None))
                for style, box, ring in masks:
                    STYLES.get(style, _solid)(img, box, scale, ring)
                out.append(_pack(img).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("width"), batch.column("height"), pa.array(out, pa.list_(pa.int32()))], ["id", "width", "height", "argb"])

    return images.join(per, "id", "left").select("id", "width", "height", "argb", "masks").mapInArrow(draw, IMAGE)


def two_inks(images: DataFrame) -> DataFrame:
    """(id, eta, off, printed): how well two classes of brightness explain an image (Otsu), the share of pixels far from the
    line between the classes' median colours, and whether it looks printed: unless off >= 0.15 and eta < 0.8."""

    def measure(batches):
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                rgb = _unpack(x["width"], x["height"], x["argb"])[..., :3].reshape(-1, 3).astype(float)
                luma = np.clip(rgb @ [0.299, 0.587, 0.114], 0, 255).astype(int)
                n = np.bincount(luma, minlength=256)
                w = np.cumsum(n)
                m = np.cumsum(n * np.arange(256))
                total, mean = w[-1], m[-1] / w[-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    between = np.nan_to_num((mean * w - m) ** 2 / (w * (total - w)) / total)
                cut, spread = int(between.argmax()), luma.var()
                eta = float(between.max() / spread) if spread else 1.0
                dark, light = rgb[luma <= cut], rgb[luma > cut]
                off = 0.0
                if len(dark) and len(light):
                    a, b = (np.sort(c, axis=0)[(len(c) - 1) // 2] for c in (dark, light))
                    line = b - a
                    if (size := line @ line) > 0:
                        along = np.clip((rgb - a) @ line / size, 0, 1)
                        off = float((np.linalg.norm(rgb - a - along[:, None] * line, axis=1) > 40).mean())
                rows.append((eta, off, not (off >= 0.15 and eta < 0.8)))
            eta, off, printed = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(eta, pa.float64()), pa.array(off, pa.float64()), pa.array(printed, pa.bool_())], ["id", "eta", "off", "printed"])

    return images.mapInArrow(measure, "id string, eta double, off double, printed boolean")
