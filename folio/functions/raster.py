"""Images as numpy arrays: PNG bytes, sizes, colours, masks, similarity and template matches. Only zlib and numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Samples per pixel by PNG colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(image: np.ndarray) -> bytes:
    """Grey (h, w), RGB or RGBA (h, w, 3 or 4), 8 bits."""
    image = np.ascontiguousarray(image, np.uint8)
    h, w = image.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if image.ndim == 2 else image.shape[2]]
    rows = np.zeros((h, image.reshape(h, -1).shape[1] + 1), np.uint8)
    rows[:, 1:] = image.reshape(h, -1)
    header = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """RGB (h, w, 3) of an 8-bit PNG that is not interlaced; grey and palettes are widened, alpha is dropped."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, palette, head = 8, [], None, None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        at += n + 12
    w, h, depth, kind, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit images that are not interlaced")
    k = CHANNELS[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, w * k + 1)
    out = np.zeros((h, w * k), np.uint8)
    above = np.zeros(w * k, np.uint8)
    for y in range(h):
        line, how = raw[y, 1:], raw[y, 0]
        if how == 0:
            now = line
        elif how == 2:
            now = line + above
        elif how == 1:  # sums along the row, channel by channel
            now = np.cumsum(line.reshape(w, k), axis=0, dtype=np.uint8).ravel()
        else:
            now = np.zeros_like(line)
            for i in range(w * k):
                a, b, c = (int(now[i - k]) if i >= k else 0), int(above[i]), (int(above[i - k]) if i >= k else 0)
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[i] = (int(line[i]) + guess) & 255
        out[y] = above = now
    image = out.reshape(h, w, k)
    if kind == 3:
        return palette[image[:, :, 0]]
    return np.repeat(image[:, :, :1], 3, axis=2) if k <= 2 else image[:, :, :3]


def nearest_places(n: int, m: int) -> np.ndarray:
    """Which of ``n`` pixels are kept where a side becomes ``m`` long."""
    return ((np.arange(m) + 0.5) * n / m).astype(int)


def resize_nearest(image: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    w, h = size
    return image[nearest_places(image.shape[0], h)][:, nearest_places(image.shape[1], w)]


def _weights(n: int, m: int) -> np.ndarray:
    """Bicubic weights (a = -0.5), widened when an image shrinks, as a matrix m x n."""
    scale = max(n / m, 1.0)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    d = np.abs(np.arange(n)[None, :] - centre[:, None]) / scale
    near, far = 1.5 * d**3 - 2.5 * d**2 + 1, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2
    w = np.where(d <= 1, near, np.where(d < 2, far, 0))
    return w / w.sum(1, keepdims=True)


def resize_bicubic(image: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    w, h = size
    f = image.astype(float)
    f = np.tensordot(_weights(image.shape[0], h), f, axes=(1, 0))
    f = np.moveaxis(np.tensordot(_weights(image.shape[1], w), f, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(f), 0, 255).astype(np.uint8)


def within(image: np.ndarray, longest: int) -> np.ndarray:
    """Scaled down so that its longest side is at most ``longest``."""
    h, w = image.shape[:2]
    if max(h, w) <= longest:
        return image
    return resize_bicubic(image, (max(1, round(w * longest / max(h, w))), max(1, round(h * longest / max(h, w)))))


def scaled_to(image: np.ndarray, longest: int) -> np.ndarray:
    """Scaled up or down so that its longest side is ``longest``."""
    h, w = image.shape[:2]
    return resize_bicubic(image, (max(1, round(w * longest / max(h, w))), max(1, round(h * longest / max(h, w)))))


def framed(image: np.ndarray, box: tuple[float, float, float, float], colour: tuple[int, int, int], thick: int = 3) -> np.ndarray:
    """The edges of a box (x, y, width, height in whole pixels) drawn in place, ``thick`` pixels wide around the edge; what is outside is cut."""
    x1, y1 = int(box[0]), int(box[1])
    x2, y2 = x1 + int(box[2]) - 1, y1 + int(box[3]) - 1
    out, into = thick // 2, (thick - 1) // 2
    cut = lambda a, b: slice(max(0, a), max(0, b + 1))
    across, down = cut(x1 - out, x2 + out), cut(y1 - out, y2 + out)
    for y in (y1, y2):
        image[cut(y - out, y + into), across] = colour
    for x in (x1, x2):
        image[down, cut(x - out, x + into)] = colour
    return image


def crop(image: np.ndarray, x: float, y: float, width: float, height: float) -> np.ndarray:
    return image[int(y) : int(y + height), int(x) : int(x + width)]


def paste(source: np.ndarray, target: np.ndarray, x: int, y: int) -> np.ndarray:
    out = target.copy()
    h, w = min(source.shape[0], out.shape[0] - y), min(source.shape[1], out.shape[1] - x)
    out[y : y + h, x : x + w] = source[:h, :w]
    return out


def swap_channels(image: np.ndarray) -> np.ndarray:
    return image[..., ::-1]


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of an RGB image."""
    return image if image.ndim == 2 else np.rint(image.astype(float) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _codes(image: np.ndarray) -> np.ndarray:
    i = image.astype(np.int64)
    return i[..., 0] << 16 | i[..., 1] << 8 | i[..., 2]


def _code(c: tuple[int, int, int]) -> int:
    return c[0] << 16 | c[1] << 8 | c[2]


def masks(image: np.ndarray, colours: list[tuple[int, int, int]], unknown: bool = False) -> np.ndarray:
    """A channel per colour, 1 where a pixel has it, and one for pixels of no colour if asked for."""
    codes = _codes(image)
    out = [codes == _code(c) for c in colours]
    if unknown:
        out.append(~np.any(out, axis=0))
    return np.stack(out, axis=-1).astype(float)


def colour_counts(image: np.ndarray) -> dict[tuple[int, int, int], int]:
    codes, n = np.unique(_codes(image), return_counts=True)
    return {(int(c) >> 16, int(c) >> 8 & 255, int(c) & 255): int(k) for c, k in zip(codes, n, strict=True)}


def mapped(image: np.ndarray, colours: dict[tuple[int, int, int], tuple[int, int, int]]) -> np.ndarray:
    out, codes = image.copy(), _codes(image)
    for a, b in colours.items():
        out[codes == _code(a)] = b
    return out


def likeliest_colours(probabilities: np.ndarray, colours: list[tuple[int, int, int]]) -> np.ndarray:
    return np.array(colours, np.uint8)[probabilities.argmax(-1)]


def channel_colours(values: np.ndarray, colours: list[tuple[int, int, int]]) -> np.ndarray:
    """Channels in their colours, added up, black where there is nothing."""
    return np.clip(values @ np.array(colours, float), 0, 255).astype(np.uint8)


def black_to_white(image: np.ndarray) -> np.ndarray:
    return mapped(image, {(0, 0, 0): (255, 255, 255)})


def shares_within(image: np.ndarray, colours: dict[str, tuple[int, int, int]], x: float, y: float, width: float, height: float) -> dict[str, float]:
    """The share of a box's pixels that each tag's colour has; 0 in an empty box."""
    codes = _codes(crop(image, x, y, width, height))
    return {t: float((codes == _code(c)).mean()) if codes.size else 0.0 for t, c in colours.items()}


class ColourSums:
    """Pixels of each colour in any box by four lookups: a table of sums over all boxes from the corner, made once a colour."""

    def __init__(self, image: np.ndarray, colours: dict[str, tuple[int, int, int]]) -> None:
        codes = _codes(image)
        self.shape, self.tags = codes.shape, list(colours)
        self.sums = np.zeros((len(colours), codes.shape[0] + 1, codes.shape[1] + 1), np.int32)
        for k, c in enumerate(colours.values()):
            np.cumsum(np.cumsum(codes == _code(c), axis=0, dtype=np.int32), axis=1, out=self.sums[k, 1:, 1:])

    def shares(self, x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
        """Tags by boxes: the share of each box's pixels that each tag's colour has; 0 in an empty box. Boxes are cut to the image."""
        edge = lambda v, n: np.clip(np.asarray(v, float).astype(np.int64), 0, n)
        x1, x2 = edge(x, self.shape[1]), edge(np.add(x, width), self.shape[1])
        y1, y2 = edge(y, self.shape[0]), edge(np.add(y, height), self.shape[0])
        x2, y2 = np.maximum(x1, x2), np.maximum(y1, y2)
        s = self.sums
        inside = s[:, y2, x2] - s[:, y1, x2] - s[:, y2, x1] + s[:, y1, x1]
        return inside / np.maximum(1, (x2 - x1) * (y2 - y1))


def _box_sums(f: np.ndarray, n: int) -> np.ndarray:
    s = np.zeros((f.shape[0] + 1, f.shape[1] + 1))
    s[1:, 1:] = f.cumsum(0).cumsum(1)
    return s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]


def similarity(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity of two grey images of one size."""
    x, y, n = a.astype(float), b.astype(float), window * window
    mean = lambda f: _box_sums(f, window) / n
    mx, my = mean(x), mean(y)
    unbiased = n / (n - 1)
    vx, vy, vxy = (unbiased * (mean(p * q) - m * k) for p, q, m, k in ((x, x, mx, mx), (y, y, my, my), (x, y, mx, my)))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def template_match(image: np.ndarray, template: np.ndarray) -> tuple[float, int, int]:
    """The best normalised correlation of a grey template in a grey image, and where it is; by Fourier transforms."""
    f, t = image.astype(float), template.astype(float)
    h, w = t.shape
    if h > f.shape[0] or w > f.shape[1]:
        return 0.0, 0, 0
    t = t - t.mean()
    shape = (f.shape[0] + h - 1, f.shape[1] + w - 1)
    product = np.fft.irfft2(np.fft.rfft2(f, shape) * np.fft.rfft2(t[::-1, ::-1], shape), shape)[h - 1 : f.shape[0], w - 1 : f.shape[1]]
    n = h * w

    def sums(g: np.ndarray) -> np.ndarray:
        s = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
        s[1:, 1:] = g.cumsum(0).cumsum(1)
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]

    spread = np.sqrt(np.maximum(sums(f * f) - sums(f) ** 2 / n, 0) * (t * t).sum())
    score = np.where(spread > 1e-6, product / np.maximum(spread, 1e-6), 0)
    y, x = np.unravel_index(int(score.argmax()), score.shape)
    return float(score[y, x]), int(x), int(y)


def scaled_template_match(image: np.ndarray, template: np.ndarray, passes: tuple[tuple[int, int], ...] = ((128, 10), (256, 5), (512, 5))) -> dict:
    """Coarse to fine: at growing widths, scales of the template around the best one so far. score and a box in the image."""
    low, high, best = 0.1, 1.0, {"score": 0.0, "x": 0.0, "y": 0.0, "width": 0.0, "height": 0.0, "scale": 0.0}
    for width, steps in passes:
        zoom = min(1.0, width / image.shape[1])
        small = grey(resize_bicubic(image, (max(1, round(image.shape[1] * zoom)), max(1, round(image.shape[0] * zoom)))))
        found = best | {"score": 0.0}
        for scale in np.linspace(low, high, steps):  # of the template's width, relative to the image's
            w = max(2, round(small.shape[1] * scale))
            h = max(2, round(w * template.shape[0] / template.shape[1]))
            if h > small.shape[0]:
                continue
            score, x, y = template_match(small, grey(resize_bicubic(template, (w, h))))
            if score > found["score"]:
                found = {"score": score, "x": x / zoom, "y": y / zoom, "width": w / zoom, "height": h / zoom, "scale": float(scale)}
        if found["score"] > 0:
            best = found
        step = (high - low) / max(1, steps - 1)
        low, high = max(0.02, best["scale"] - step), min(1.0, best["scale"] + step)
    return best


def edge_adjusted(image: np.ndarray, template: np.ndarray, box: tuple[int, int, int, int], most: int = 8) -> tuple[float, tuple[int, int, int, int]]:
    """The box, with edges moved one pixel at a time while that makes its crop more like the template."""

    def score(b: tuple[int, int, int, int]) -> float:
        part = crop(image, *b)
        if b[0] < 0 or b[1] < 0 or min(part.shape[:2], default=0) < 7:
            return -1.0
        return similarity(grey(resize_bicubic(part, (64, 64))), grey(resize_bicubic(template, (64, 64))))

    best, at = score(box), box
    for _ in range(most):
        x, y, w, h = at
        moves = [(x + d, y, w - d, h) for d in (-1, 1)] + [(x, y + d, w, h - d) for d in (-1, 1)] + [(x, y, w + d, h) for d in (-1, 1)] + [(x, y, w, h + d) for d in (-1, 1)]
        top, move = max((score(m), m) for m in moves)
        if top <= best:
            break
        best, at = top, move
    return best, at
