"""Pixel kernels in numpy, over rows of binary grey or colour images (survey ids I1-I6, I13, I16, I18, I21, A16, A19-A21, A27, O12, W9, section 2.13).

There are no recognition models here: engines are an interface with a deterministic stand-in.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Luminance weights.
LUMA = np.array([0.299, 0.587, 0.114])


def luminance(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(float) @ LUMA


def mean_luminance(image: np.ndarray) -> float:
    """A19."""
    return float((luminance(image) if image.ndim == 3 else image).mean())


def inverted_if_dark(image: np.ndarray, threshold: float = 100.0) -> np.ndarray:
    """I4."""
    return 255 - image if mean_luminance(image) < threshold else image


def contrast(image: np.ndarray, factor: float) -> np.ndarray:
    """Stretched around the middle grey."""
    return np.clip(np.floor((image.astype(float) - 128) * factor + 128 + 0.5), 0, 255).astype(np.uint8)


def mid_tone_share(grey: np.ndarray, dark: int, light: int) -> float:
    """A20."""
    return float(((grey > dark) & (grey < light)).mean())


def equalised(grey: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited equalisation; tiles' clipped and redistributed histograms give tables, between whose centres values are interpolated."""
    h, w = grey.shape
    th, tw = max(1, -(-h // tiles)), max(1, -(-w // tiles))
    rows, cols = -(-h // th), -(-w // tw)
    tables = np.empty((rows, cols, 256))
    for r in range(rows):
        for c in range(cols):
            tile = grey[r * th : (r + 1) * th, c * tw : (c + 1) * tw]
            counts = np.bincount(tile.ravel(), minlength=256).astype(float)
            most = max(1.0, clip * tile.size / 256)
            extra = np.maximum(counts - most, 0).sum()
            tables[r, c] = np.cumsum(np.minimum(counts, most) + extra / 256) / tile.size * 255
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    r0, c0 = np.clip(np.floor(y).astype(int), 0, rows - 1), np.clip(np.floor(x).astype(int), 0, cols - 1)
    r1, c1 = np.minimum(r0 + 1, rows - 1), np.minimum(c0 + 1, cols - 1)
    fy, fx = np.clip(y - r0, 0, 1)[:, None], np.clip(x - c0, 0, 1)[None, :]
    at = lambda r, c: tables[r[:, None], c[None, :], grey]
    out = at(r0, c0) * (1 - fy) * (1 - fx) + at(r0, c1) * (1 - fy) * fx + at(r1, c0) * fy * (1 - fx) + at(r1, c1) * fy * fx
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def otsu(grey: np.ndarray) -> int:
    """The threshold with the largest variance between the classes."""
    p = np.bincount(grey.ravel(), minlength=256) / max(1, grey.size)
    w, m = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m) ** 2 / (w * (1 - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def rotated(image: np.ndarray, degrees: int) -> np.ndarray:
    """I2, by quarter turns to the right."""
    return np.rot90(image, -(degrees // 90) % 4)


def padded(image: np.ndarray, border: int, value: int = 255) -> np.ndarray:
    return np.pad(image, [(border, border), (border, border), *[(0, 0)] * (image.ndim - 2)], constant_values=value)


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    """Nearest neighbour."""
    h, w = max(1, int(image.shape[0] * scale)), max(1, int(image.shape[1] * scale))
    return image[np.minimum((np.arange(h) / scale).astype(int), image.shape[0] - 1)][:, np.minimum((np.arange(w) / scale).astype(int), image.shape[1] - 1)]


# The signature of a PNG file, and the channels of its colour types.
PNG, CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 4: 2, 6: 4}


def to_png(image: np.ndarray) -> bytes:
    """Grey, RGB or RGBA bytes as a PNG file."""
    channels = 1 if image.ndim == 2 else image.shape[2]
    kind = {c: k for k, c in CHANNELS.items()}[channels]
    h, w = image.shape[:2]
    lines = np.concatenate((np.zeros((h, 1), np.uint8), image.reshape(h, w * channels)), axis=1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def from_png(content: bytes) -> np.ndarray:
    """The pixels of a PNG file with eight bits a channel, without palette or interlacing; ValueError for others."""
    if content[:8] != PNG:
        raise ValueError("not a PNG file")
    at, data, head = 8, b"", None
    while at + 8 <= len(content):
        size, name = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            data += body
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("not a plain PNG file of eight bits a channel")
    w, h, n = head[0], head[1], CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w * n + n), np.int64)
    for r in range(h):
        kind, line, above = lines[r, 0], lines[r, 1:].astype(np.int64), out[r]
        own = out[r + 1]
        if kind == 0:
            own[n:] = line
        elif kind == 1:
            own[n:] = np.cumsum(line.reshape(w, n), axis=0).ravel() % 256
        elif kind == 2:
            own[n:] = (line + above[n:]) % 256
        else:
            for i in range(n, w * n + n):
                left, up, corner = own[i - n], above[i], above[i - n]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                own[i] = (line[i - n] + guess) % 256
    pixels = out[1:, n:].astype(np.uint8)
    return pixels if n == 1 else pixels.reshape(h, w, n)


def crop(image: np.ndarray, x: float, y: float, width: float, height: float, padding: float = 0) -> np.ndarray:
    """The part of a padded box that lies on the image, of one pixel at least."""
    left, top = max(0, int(np.floor(x - padding))), max(0, int(np.floor(y - padding)))
    left, top = min(left, image.shape[1] - 1), min(top, image.shape[0] - 1)
    w, h = (max(1, int(np.ceil(v + 2 * padding))) for v in (width, height))
    return image[top : top + h, left : left + w]


def smoothly_resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear."""
    at = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
    y, x = at(height, image.shape[0]), at(width, image.shape[1])
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    trail = (slice(None),) * 2 + (None,) * (image.ndim - 2)
    fy, fx = (y - y0)[:, None][trail], (x - x0)[None, :][trail]
    v = image.astype(float)
    out = v[y0][:, x0] * (1 - fy) * (1 - fx) + v[y0][:, x1] * (1 - fy) * fx + v[y1][:, x0] * fy * (1 - fx) + v[y1][:, x1] * fy * fx
    return np.floor(out + 0.5).astype(np.uint8)


#: Capital height that is taken where no text is seen, and the columns that are looked at, at most.
NO_TEXT_HEIGHT, LOOKED_AT = 20.0, 20


def capital_height(image: np.ndarray, dark: int = 128) -> float:
    """Upper median of the dark runs, 5 pixels to 30 % of the height long, in evenly spaced columns. Runs open at the end don't count."""
    grey = image if image.ndim == 2 else image[..., :3].mean(axis=2)
    h, w = grey.shape
    columns = min(LOOKED_AT, w // 10)
    found: list[int] = []
    for x in (np.arange(1, columns + 1) * (w // (columns + 1))).tolist():
        edges = np.flatnonzero(np.diff(np.concatenate(([False], grey[:, x] < dark)).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=False):
            if 5 <= b - a <= 0.3 * h:
                found.append(int(b - a))
    return float(sorted(found)[len(found) // 2]) if found else NO_TEXT_HEIGHT


def enlarged(image: np.ndarray, least: float = 20.0, most: float = 4.0) -> np.ndarray:
    """Scaled so that capitals are ``least`` pixels high, ``most`` times at most; not for five per cent or less."""
    scale = min(least / capital_height(image), most)
    if scale <= 1.05:
        return image
    return smoothly_resized(image, int(np.floor(image.shape[1] * scale + 0.5)), int(np.floor(image.shape[0] * scale + 0.5)))


def gain(image: np.ndarray, factor: float) -> np.ndarray:
    """Values times a factor, saturated."""
    return np.clip(np.rint(image.astype(float) * factor), 0, 255).astype(np.uint8)


def binary(grey: np.ndarray, threshold: float) -> np.ndarray:
    return np.where(grey > threshold, 255, 0).astype(np.uint8)


def _windows(image: np.ndarray, radius: int, mode: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """The image shifted to each place of a square window."""
    wide = np.pad(image.astype(float), radius, mode=mode)
    for dy in range(2 * radius + 1):
        for dx in range(2 * radius + 1):
            yield dy - radius, dx - radius, wide[dy : dy + image.shape[0], dx : dx + image.shape[1]]


def adaptive(grey: np.ndarray, block: int = 11, below: float = 2) -> np.ndarray:
    """White where a value is above the Gaussian mean around it less ``below``."""
    radius = block // 2
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    wide = np.pad(grey.astype(float), radius, mode="edge")
    rows = sum(k * wide[i : i + grey.shape[0]] for i, k in enumerate(kernel))
    mean = np.rint(sum(k * rows[:, i : i + grey.shape[1]] for i, k in enumerate(kernel)))
    return np.where(grey - mean > -np.ceil(below), 255, 0).astype(np.uint8)


def bilateral(grey: np.ndarray, diameter: int = 5, sigma_color: float = 75, sigma_space: float = 75) -> np.ndarray:
    """Means over a disc, weighted by nearness in place and in value."""
    radius = diameter // 2
    total, weights = np.zeros(grey.shape), np.zeros(grey.shape)
    for dy, dx, moved in _windows(grey, radius, "reflect" if min(grey.shape) > radius else "edge"):
        if dy * dy + dx * dx <= radius * radius:
            w = np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2) - (moved - grey) ** 2 / (2 * sigma_color**2))
            total += w * moved
            weights += w
    return np.rint(total / weights).astype(np.uint8)


STEPS: dict[str, Callable[..., np.ndarray]] = {
    "dpi": enlarged, "inversion": inverted_if_dark, "grey": lambda im: np.floor(luminance(im) + 0.5).astype(np.uint8) if im.ndim == 3 else im,
    "clahe": equalised, "gain": gain, "contrast": contrast, "bilateral": bilateral, "otsu": lambda im: np.where(im > otsu(im), 255, 0).astype(np.uint8), "binary": binary, "adaptive": adaptive,
}
#: The order of a config's steps; the last three are kinds of threshold.
ORDER = ("dpi", "inversion", "grey", "clahe", "gain", "bilateral", "otsu", "binary", "adaptive")


def chain(config: dict) -> list[tuple[str, dict]]:
    """The steps that a preprocessing config switches on, in their order; none where it is off."""
    if not config.get("enabled"):
        return []
    on = lambda name: bool((config.get(name) or {}).get("enabled"))
    value = lambda name, key, default: (config.get(name) or {}).get(key) or default
    kind = value("threshold", "type", "otsu") if on("threshold") else None
    wanted = {
        "dpi": {"least": value("dpiScaling", "minCapitalHeightPx", 20), "most": value("dpiScaling", "maxScale", 4)} if on("dpiScaling") else None,
        "inversion": {"threshold": value("inversion", "threshold", 100)} if on("inversion") else None, "grey": {} if config.get("grayscale") or on("clahe") or kind else None,
        "clahe": {"clip": value("clahe", "clipLimit", 2.0), "tiles": value("clahe", "tileSize", 8)} if on("clahe") else None,
        "gain": {"factor": config["contrastBoost"]} if config.get("contrastBoost", 1.0) != 1.0 else None,
        "bilateral": {"diameter": value("bilateralFilter", "diameter", 5), "sigma_color": value("bilateralFilter", "sigmaColor", 75), "sigma_space": value("bilateralFilter", "sigmaSpace", 75)} if on("bilateralFilter") else None,
        "otsu": {} if kind == "otsu" else None, "binary": {"threshold": value("threshold", "value", 128)} if kind == "binary" else None, "adaptive": {} if kind == "adaptive" else None,
    }
    return [(name, wanted[name]) for name in ORDER if wanted[name] is not None]


def preprocess(image: np.ndarray, steps: list[tuple[str, dict]]) -> np.ndarray:
    """Named steps in order."""
    for name, options in steps:
        image = STEPS[name](image, **options)
    return image


def preprocessed(images: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """``images`` (image_id, width, height, data: grey bytes) through the steps, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [preprocess(np.frombuffer(d, dtype=np.uint8).reshape(h, w), steps) for d, w, h in zip(f["data"], f["width"], f["height"], strict=True)]
            yield f.assign(data=[d.tobytes() for d in done], width=[d.shape[1] for d in done], height=[d.shape[0] for d in done], luminance=[mean_luminance(d) for d in done])

    return images.select("image_id", "width", "height", "data").mapInPandas(run, "image_id long, width int, height int, data binary, luminance double")


def components(mask: np.ndarray, least: int = 9) -> list[np.ndarray]:
    """Positions of 4-connected parts of at least ``least`` pixels, row by row."""
    left, out = mask.copy(), []
    for start in zip(*np.nonzero(mask), strict=True):
        if not left[start]:
            continue
        left[start], stack, part = False, [start], []
        while stack:
            y, x = stack.pop()
            part.append((y, x))
            for v, u in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and left[v, u]:
                    left[v, u] = False
                    stack.append((v, u))
        if len(part) >= least:
            out.append(np.array(sorted(part)))
    return out


def text_boxes(probability: np.ndarray, threshold: float = 0.3, box_threshold: float = 0.6, unclip: float = 1.5, scale: float = 1.0) -> list[tuple[float, float, float, float, float]]:
    """X, y, width, height and mean probability of text parts, grown and scaled, with upright boxes."""
    out = []
    for part in components(probability > threshold):
        score = float(probability[part[:, 0], part[:, 1]].mean())
        if score < box_threshold:
            continue
        (y0, x0), (y1, x1) = part.min(0), part.max(0) + 1
        d = (x1 - x0) * (y1 - y0) * unclip / (2 * ((x1 - x0) + (y1 - y0)))
        out.append(((x0 - d) / scale, (y0 - d) / scale, (x1 - x0 + 2 * d) / scale, (y1 - y0 + 2 * d) / scale, score))
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    listed = sorted(set(map(tuple, points.tolist())))
    if len(listed) < 3:
        return np.array(listed, dtype=float)

    def side(own: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for p in own:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(side(listed) + side(listed[::-1]), dtype=float)


def smallest_box(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """Centre x and y, width, height and angle (radians) of the smallest box around points (x, y); one of its sides lies on the hull."""
    corners = hull(points)
    edges = np.diff(np.vstack((corners, corners[:1])), axis=0)
    angles = np.unique(np.round(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2), 12)) if len(corners) > 1 else np.zeros(1)
    best = None
    for t in angles.tolist():
        turn = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
        own = corners @ turn.T
        low, high = own.min(0), own.max(0)
        area = float(np.prod(high - low))
        if best is None or area < best[0] - 1e-9:
            centre = (low + high) / 2 @ turn
            best = area, (float(centre[0]), float(centre[1]), float(high[0] - low[0]), float(high[1] - low[1]), t)
    return best[1]


def slanted_boxes(probability: np.ndarray, threshold: float = 0.3, box_threshold: float = 0.6, unclip: float = 1.5, scale: float = 1.0) -> list[tuple[np.ndarray, float]]:
    """The four corners (clockwise from the top left) and the mean probability of text parts, as their smallest boxes, grown and scaled."""
    out = []
    for part in components(probability > threshold):
        score = float(probability[part[:, 0], part[:, 1]].mean())
        if score < box_threshold:
            continue
        pixels = np.concatenate([part[:, ::-1] + shift for shift in ((0, 0), (1, 0), (0, 1), (1, 1))])
        x, y, w, h, t = smallest_box(pixels)
        d = w * h * unclip / (2 * (w + h))
        half = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * [(w + 2 * d) / 2, (h + 2 * d) / 2]
        corners = (half @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + [x, y]) / scale
        top, bottom = np.split(corners[np.argsort(corners[:, 1], kind="stable")], 2)
        top, bottom = top[np.argsort(top[:, 0], kind="stable")], bottom[np.argsort(-bottom[:, 0], kind="stable")]
        out.append((np.vstack((top, bottom)), score))
    return out


def line_confidence(probabilities: list[float], characters: int) -> float:
    """A line's summed probabilities for each character, 1 at most; 0 without characters."""
    return min(1.0, sum(probabilities) / characters) if characters else 0.0


class TextEngine(Protocol):
    """What a recognition engine offers; one is made per Python worker and unloaded when its task ends."""

    def recognise(self, content: bytes, options: dict) -> tuple[str, float]: ...

    def capabilities(self) -> dict[str, bool]: ...

    def unload(self) -> None: ...


class NoisyEngine:
    """A stand-in: reads text bytes back with a seeded share of characters lost."""

    def __init__(self, loss: float = 0.1, seed: int = 1):
        self.loss, self.seed = loss, seed

    def recognise(self, content: bytes, options: dict) -> tuple[str, float]:
        rng = np.random.default_rng([self.seed, len(content), int(np.frombuffer(content[:8].ljust(8, b"\0"), dtype=np.uint64)[0] % (1 << 31))])
        text = content.decode("utf-8", "replace")
        return "".join(c for c, r in zip(text, rng.random(len(text)), strict=True) if r >= self.loss), 1 - self.loss

    def capabilities(self) -> dict[str, bool]:
        return {"regions": True, "words": False, "rotation": False}

    def unload(self) -> None:
        """Nothing is loaded."""


ENGINES: dict[str, Callable[[], TextEngine]] = {"noisy": NoisyEngine}


def recognised(inputs: DataFrame, engine: str, options: dict | None = None) -> DataFrame:
    """Text and confidence of each row's content, by a named engine."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = ENGINES[engine]()
        try:
            for f in frames:
                done = [own.recognise(bytes(c), options or {}) for c in f["content"]]
                yield pd.DataFrame({"input_id": f["input_id"], "text": [t for t, _ in done], "confidence": [c for _, c in done]})
        finally:
            own.unload()

    return inputs.select("input_id", F.col("content").cast("binary").alias("content")).mapInPandas(run, "input_id long, text string, confidence double")


def register(name: str, make: Callable[[], TextEngine]) -> None:
    """Section 2.13: offer an engine by name."""
    ENGINES[name] = make


def read_regions(regions: DataFrame, engine: str, options: dict | None = None) -> DataFrame:
    """Regions (image_id, place, content) read by an engine, and put together by image in the order of their places: the text, the
    mean confidence of the regions with text (0 for none) and their number. An image's regions are few."""
    numbered = regions.withColumn("input_id", F.xxhash64("image_id", "place"))
    read = recognised(numbered.select("input_id", "content"), engine, options)
    both = numbered.select("image_id", "place", "input_id").join(read.groupBy("input_id").agg(F.first("text").alias("text"), F.first("confidence").alias("confidence")), "input_id")
    some = F.trim("text") != ""
    listed = F.array_sort(F.collect_list(F.when(some, F.struct("place", F.trim("text").alias("text")))))
    return both.groupBy("image_id").agg(F.array_join(F.transform(listed, lambda r: r["text"]), "\n").alias("text"), F.coalesce(F.avg(F.when(some, F.col("confidence"))), F.lit(0.0)).alias("confidence"), F.count_if(some).alias("regions"))
