"""Clean-up of page images ahead of text recognition (IMG-01..11, ORC-05 inputs): numpy on grey pages, in pandas batches.

Binary PGM is decoded here; other formats need Pillow. Orientation comes from an injected detector, as it needs a
recognition engine. What may be done to a page is a table, ``REPAIRS``: a measure, when its value asks for the repair,
and the repair. ``clean`` walks it once and reports every measure with what was done about it as a list of structs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .. import config as C
from ..session import release_memory, ship

STEP = "struct<measure:string,value:double,repaired:boolean>"
CLEANED = f"doc_id string, page int, width int, height int, steps array<{STEP}>, image binary, problem string"


def decode(data: bytes) -> np.ndarray:
    """Grey levels of an image file."""
    head = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", data)
    if head:
        w, h = int(head[1]), int(head[2])
        return np.frombuffer(data, np.uint8, w * h, head.end()).reshape(h, w).copy()
    import io

    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(data)).convert("L"))


def encode(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(grey, np.uint8).tobytes()


def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def _windows(grey: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(grey, k // 2, mode="edge"), (k, k))


def _along(grey: np.ndarray, k: int, pick: Callable) -> np.ndarray:
    """A separable k x k extreme filter."""
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (k // 2, k // 2)
        grey = pick(np.lib.stride_tricks.sliding_window_view(np.pad(grey, pad, mode="edge"), k, axis=axis), axis=-1)
    return grey


def gauss(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur. A wide one is taken on a copy of block means, as nothing finer than them is left of it."""
    x = x.astype(np.float64)
    f = int(sigma // 4)
    if f > 1:
        h, w = x.shape
        y = np.pad(x, ((0, -h % f), (0, -w % f)), mode="edge")
        small = gauss(y.reshape(y.shape[0] // f, f, y.shape[1] // f, f).mean(axis=(1, 3)), sigma / f)
        return _bilinear(small, (np.arange(h) + 0.5) / f - 0.5, (np.arange(w) + 0.5) / f - 0.5)
    reach = max(1, int(round(3 * sigma)))
    tap = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (reach, reach)
        padded = np.pad(x, pad, mode="edge")
        x = sum(t * np.take(padded, np.arange(i, i + x.shape[axis]), axis=axis) for i, t in enumerate(tap / tap.sum()))
    return x


def _bilinear(grid: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of a grid at all crossings of fractional rows and columns, held at its edges."""

    def split(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(at, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), at - low

    top, bottom, v = split(y, grid.shape[0])
    left, right, u = split(x, grid.shape[1])
    rows = grid[top] * (1 - v)[:, None] + grid[bottom] * v[:, None]
    return rows[:, left] * (1 - u) + rows[:, right] * u


def resize(grey: np.ndarray, factor: float) -> np.ndarray:
    """Nearest source pixel of each target pixel's centre."""
    h, w = (max(1, int(n * factor)) for n in grey.shape)
    rows = np.minimum(((np.arange(h) + 0.5) / factor).astype(int), grey.shape[0] - 1)
    cols = np.minimum(((np.arange(w) + 0.5) / factor).astype(int), grey.shape[1] - 1)
    return grey[rows][:, cols]


def noise(grey: np.ndarray) -> float:
    """IMG-02: mean distance of a pixel from the median of its neighbourhood."""
    rows = np.array_split(np.arange(grey.shape[0]), max(1, grey.size // 2_000_000))
    views = _windows(grey, 3)
    total = sum(float(np.abs(grey[r].astype(np.int16) - np.median(views[r], axis=(2, 3))).sum()) for r in rows)
    return total / grey.size


def flatten_light(grey: np.ndarray) -> np.ndarray:
    """IMG-03: divide by the paper's own brightness, taken from a copy without the text."""
    paper = _along(_along(grey, 15, np.max), 15, np.min)
    k = max(31, (min(grey.shape) // 12) | 1)
    return _clip(grey / np.maximum(gauss(paper, 0.15 * k + 0.35), 1) * 255)


def otsu(grey: np.ndarray) -> int:
    """The grey level that separates two classes best."""
    count = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(count), np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(spread).argmax()) + 1


def contrast(grey: np.ndarray) -> float:
    """IMG-04: how far the mean grey levels of paper and ink, told apart by the Otsu level, lie from each other."""
    count, level, t = np.bincount(grey.ravel(), minlength=256), np.arange(256), otsu(grey)
    sides = [(count[part].sum(), (count * level)[part].sum()) for part in (slice(0, t), slice(t, 256))]
    return float(sides[1][1] / sides[1][0] - sides[0][1] / sides[0][0]) if sides[0][0] and sides[1][0] else 0.0


def local_contrast(grey: np.ndarray, tiles: int = 8, clip: float = 3.0) -> np.ndarray:
    """IMG-04: contrast-limited adaptive equalisation: each pixel takes the blend of its nearest tiles' clipped curves."""
    h, w = grey.shape
    rows, cols = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    curve = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = grey[rows[i] : max(rows[i + 1], rows[i] + 1), cols[j] : max(cols[j + 1], cols[j] + 1)]
            count = np.bincount(part.ravel(), minlength=256).astype(np.float64)
            limit = max(1.0, clip * part.size / 256)
            spare = np.maximum(count - limit, 0).sum()
            curve[i, j] = np.cumsum(np.minimum(count, limit) + spare / 256) * 255 / part.size
    y, x = (np.arange(h) + 0.5) * tiles / h - 0.5, (np.arange(w) + 0.5) * tiles / w - 0.5
    y, x = np.clip(y, 0, tiles - 1), np.clip(x, 0, tiles - 1)
    i, j = np.minimum(y.astype(int), tiles - 2), np.minimum(x.astype(int), tiles - 2)
    v, u = (y - i)[:, None], (x - j)[None, :]
    i, j = i[:, None], j[None, :]
    upper = curve[i, j, grey] * (1 - u) + curve[i, j + 1, grey] * u
    lower = curve[i + 1, j, grey] * (1 - u) + curve[i + 1, j + 1, grey] * u
    return _clip(upper * (1 - v) + lower * v)


def quiet(grey: np.ndarray, h: float = 10.0, patch: int = 7, search: int = 15) -> np.ndarray:
    """IMG-10: non-local means: a pixel becomes the mean of those around it, weighed by how alike their surroundings are."""
    reach = search // 2
    wide = np.pad(grey.astype(np.float32), reach, mode="reflect")
    total, weight = np.zeros(grey.shape, np.float32), np.zeros(grey.shape, np.float32)
    for dy in range(search):
        for dx in range(search):
            other = wide[dy : dy + grey.shape[0], dx : dx + grey.shape[1]]
            gap = _mean_along(_mean_along((other - grey) ** 2, patch, 0), patch, 1)
            like = np.exp(-gap / (h * h))
            total += like * other
            weight += like
    return _clip(total / weight)


def _mean_along(x: np.ndarray, k: int, axis: int) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (k // 2 + 1, k // 2)
    sums = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
    n = x.shape[axis]
    return ((np.take(sums, np.arange(k, n + k), axis=axis) - np.take(sums, np.arange(n), axis=axis)) / k).astype(np.float32)


def sharpness(grey: np.ndarray) -> float:
    """Variance of the second differences."""
    x = np.pad(grey.astype(np.float64), 1, mode="reflect")
    return float((np.diff(x, 2, axis=0)[:, 1:-1] + np.diff(x, 2, axis=1)[1:-1, :]).var())


def sharpen(grey: np.ndarray) -> np.ndarray:
    """IMG-05: what a blur would take away is added once more."""
    return _clip(2.0 * grey - gauss(grey, 1.6))


def ink_points(grey: np.ndarray, longest: int = 900) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the text's ink about the page's centre, on a copy of bounded size.

    Left out is what is no text: rows and columns that are ink over most of their length, and ink whose unbroken run
    is longer than a quarter of the width or a twelfth of the height (rules, banners).
    """
    factor = min(1.0, longest / max(grey.shape))
    small = resize(grey, factor) if factor < 1 else grey
    ink = small < otsu(small)
    ink &= ~((ink.mean(axis=1) > 0.6)[:, None] | (ink.mean(axis=0) > 0.6)[None, :])
    for axis, share in ((1, 4), (0, 12)):
        ink &= ~(_runs(ink, axis) > max(8, ink.shape[axis] / share))
    y, x = np.nonzero(ink)
    return y - ink.shape[0] / 2, x - ink.shape[1] / 2


def _runs(mask: np.ndarray, axis: int) -> np.ndarray:
    """Length of the unbroken run that each set pixel belongs to along an axis; 0 elsewhere."""
    m = mask if axis == 1 else mask.T
    edge = np.diff(np.pad(m.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    out = np.zeros(m.shape, np.int32)
    out[np.repeat(row, end - start), np.arange(int((end - start).sum())) + np.repeat(start - np.cumsum(end - start) + (end - start), end - start)] = np.repeat(end - start, end - start)
    return out if axis == 1 else out.T


def skew(grey: np.ndarray, most: float = C.MAX_SKEW_DEG) -> float:
    """IMG-06: tilt of the text lines in degrees, counter-clockwise positive: turned back by it, the ink falls into the fewest rows.

    How crowded the rows are is the sum of their squared ink. Seen in wide rows that has one broad peak, in narrow ones a
    sharp one, so the bracket shrinks as the rows do: a quarter is kept each time, and a golden section ends the search.
    """
    y, x = ink_points(grey)
    if not len(y):
        return 0.0

    def crowding(degrees: float, width: float) -> float:
        a = np.deg2rad(degrees)
        at = (y * np.cos(a) + x * np.sin(a)) / width
        low = np.floor(at).astype(int)
        part = at - low  # ink is shared by the two nearest rows, so that the measure has no steps
        low -= low.min()
        rows = np.bincount(low, 1 - part, low.max() + 2) + np.bincount(low + 1, part, low.max() + 2)
        return float((rows**2).sum())

    centre, half = 0.0, float(most)
    for width in (8.0, 4.0, 2.0):
        tries = np.clip(centre + half * np.linspace(-1, 1, 17), -most, most)
        centre, half = float(tries[int(np.argmax([crowding(d, width) for d in tries]))]), half / 4
    golden = (5**0.5 - 1) / 2
    low, high = centre - half, centre + half
    while high - low > 0.05:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if crowding(a, 1.0) >= crowding(b, 1.0) else (a, high)
    return (low + high) / 2


def turn(grey: np.ndarray, degrees: float) -> np.ndarray:
    """IMG-07: turned counter-clockwise about its centre, size kept, corners white."""
    h, w = grey.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    y, x = y - h / 2, x - w / 2
    sy, sx = np.rint(y * np.cos(a) + x * np.sin(a) + h / 2).astype(int), np.rint(x * np.cos(a) - y * np.sin(a) + w / 2).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    out = np.full((h, w), 255, np.uint8)
    out[inside] = grey[sy[inside], sx[inside]]
    return out


def quarter_turn(grey: np.ndarray, clockwise: int) -> np.ndarray:
    """IMG-09."""
    return np.rot90(grey, -(clockwise // 90) % 4)


#: (measure, its value, when the value asks for the repair, the repair, given page and value), in the order of their use.
REPAIRS: tuple[tuple[str, Callable, Callable[[float], bool], Callable], ...] = (
    ("shrink", lambda g: (C.MAX_IMAGE_PIXELS / g.size) ** 0.5, lambda v: v < 1, resize),
    ("enlarge", lambda g: C.MIN_IMAGE_WIDTH / g.shape[1], lambda v: v > 1, resize),
    ("rotation", None, lambda v: v != 0, lambda g, v: quarter_turn(g, int(v))),  # measured by the injected detector
    ("light", lambda g: 1.0, lambda v: True, lambda g, v: flatten_light(g)),
    ("noise", noise, lambda v: v > C.NOISE_LIMIT, lambda g, v: quiet(g)),
    ("contrast", contrast, lambda v: v < C.CONTRAST_LIMIT, lambda g, v: local_contrast(g)),
    ("sharpness", sharpness, lambda v: v < C.SHARPNESS_LIMIT, lambda g, v: sharpen(g)),
    ("skew", skew, lambda v: abs(v) >= C.MIN_SKEW_DEG, lambda g, v: turn(g, -v)),
)


def clean(grey: np.ndarray, orientation: Callable[[np.ndarray], int | None] | None = None) -> tuple[np.ndarray, list[dict]]:
    """IMG-10: the page after the repairs that its measures asked for, and every measure taken."""
    taken = []
    for name, measure, asks, repair in REPAIRS:
        measure = measure or (lambda g: (orientation(g) if orientation else None) or 0)
        value = float(measure(grey))
        if asks(value):
            grey = repair(grey, value)
        taken.append({"measure": name, "value": value, "repaired": bool(asks(value))})
    return grey, taken


def recognition_scale(width: int, height: int, wanted: float) -> float:
    """IMG-11: the scale at which a page is recognised, within the engine's limits of width and pixels; 1 if it hardly differs."""
    scale = min(wanted, C.MAX_OCR_WIDTH / width, (C.MAX_OCR_PIXELS / (width * height)) ** 0.5)
    return scale if abs(scale - 1) >= 0.02 else 1.0


def recognition_engine(configured: str = "", enabled: bool = True) -> str | None:
    """IMG-11: the engine's program: the configured one if it exists, else one on the path; None if there is none or it is off."""
    import os
    import shutil

    if not enabled:
        return None
    return configured if configured and os.path.isfile(configured) else shutil.which("tesseract")


def model_image(data: bytes, longest: int = C.MODEL_IMAGE_SIDE, quality: int = C.MODEL_IMAGE_QUALITY) -> bytes:
    """SRC-04: the picture as a model gets it: JPEG, no side longer than ``longest``. Needs Pillow."""
    import io

    from PIL import Image

    picture = Image.open(io.BytesIO(data)).convert("RGB")
    picture.thumbnail((longest, longest))
    out = io.BytesIO()
    picture.save(out, "JPEG", quality=quality)
    return out.getvalue()


def clean_pages(pages: DataFrame, orientation: Callable[[np.ndarray], int | None] | None = None) -> DataFrame:
    """Pages (doc_id, page, image) with their cleaned image as PGM; a page that can't be read has its problem instead.

    Workers give freed page buffers back to the system after every page (IMG-11), as they idle between batches.
    """
    import pandas as pd

    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, data in zip(pdf["doc_id"], pdf["page"], pdf["image"], strict=True):
                try:
                    grey, steps = clean(decode(data), orientation)
                    rows.append((doc, page, grey.shape[1], grey.shape[0], steps, encode(grey), None))
                except Exception as e:
                    rows.append((doc, page, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
                release_memory()
            yield pd.DataFrame(rows, columns=["doc_id", "page", "width", "height", "steps", "image", "problem"])

    return pages.select("doc_id", "page", "image").mapInPandas(run, CLEANED)
