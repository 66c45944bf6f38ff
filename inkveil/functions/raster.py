"""Pixels: a PNG codec, the four ways to cover a box, the grid overlay and a raster PDF, in numpy.

These run inside Arrow batches, one page at a time; nothing here knows Spark.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np

from inkveil.errors import UnsupportedInput

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
#: How much smaller a region gets before anything is smoothed: that is where the detail goes.
DETAIL = 12
GUTTER = 30
MAGENTA, INK, MARGIN = (214, 0, 122), (168, 0, 95), (242, 242, 242)


class Rows(NamedTuple):
    """Greys of a picture whose rows repeat: rows, and for each row of the picture, from the top, which of them it is."""

    rows: np.ndarray
    place: np.ndarray

    def pixels(self) -> np.ndarray:
        return self.rows[self.place]

    def used(self) -> "Rows":
        """Only the rows that the picture shows."""
        shown = np.zeros(len(self.rows), bool)
        shown[self.place] = True
        return self if shown.all() else Rows(self.rows[shown], (np.cumsum(shown) - 1)[self.place])


class Part(NamedTuple):
    """Rows of a picture deflated up to a whole byte, none of them asking for what stands before; their size before and their checksum."""

    data: bytes
    size: int
    check: int


class Stacked(NamedTuple):
    """A picture of few colours from the top: deflated already, or rows of places in a list of (red, green, blue). Each begins with a new row."""

    height: int
    width: int
    bands: tuple[Part | Rows, ...]
    colours: tuple[tuple[int, int, int], ...]


Picture = np.ndarray | Rows | Stacked


class Packed(NamedTuple):
    """What PNG and PDF both store: rows behind a filter byte, deflated, of 1 to 8 bits a sample."""

    height: int
    width: int
    bits: int
    kind: int
    palette: bytes
    data: bytes


def packed(image: Picture) -> Packed:
    """A picture without loss in few bits. Greys are height x width, colours height x width x 3 or indexed.

    A row like the one above it is zeros behind filter 2; only the others are
    looked at: how many greys they have, and what bits they become.
    """
    if isinstance(image, Stacked):
        bits = _bits(len(image.colours))
        parts = [p if isinstance(p, Part) else _part(_squeezed(p.rows, bits), _starts(p.place)) for p in image.bands]
        return Packed(image.height, image.width, bits, 3, bytes(v for c in image.colours for v in c), _joined(parts))
    if isinstance(image, Rows):
        new = _starts(image.place)
        px, order = image.used()
        order = order[new]
    else:
        flat = np.ascontiguousarray(image).reshape(len(image), -1)
        new = _new_rows(flat)
        px, order = flat[new].reshape(-1, *image.shape[1:]), None
    if px.ndim == 3:
        return Packed(len(new), px.shape[1], 8, 2, b"", zlib.compress(_filtered(px.reshape(len(px), -1), new), 6))
    bits, kind, palette, rows, greys = 8, 0, b"", px, _greys(px)
    if len(greys) <= FEW:
        bits, kind, palette = _bits(len(greys)), 3, bytes(v for g in greys for v in (g, g, g))
        rows = _squeezed(_ranks(px, greys), bits)
    return Packed(len(new), px.shape[1], bits, kind, palette, _joined(_parts(rows if order is None else rows[order], new)))


def _bits(colours: int) -> int:
    return next(b for b in (1, 2, 4, 8) if colours <= 1 << b)


def _filtered(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What PNG deflates: rows behind filter 0 where they are new, zeros behind filter 2 elsewhere."""
    raw = np.zeros((len(new), rows.shape[1] + 1), np.uint8)
    raw[:, 0] = 2
    at = np.flatnonzero(new)
    raw[at, 0] = 0
    raw[at, 1:] = rows
    return raw


#: Bytes from which a row's copies are not deflated again for each picture.
LONG = 32 << 10


def _parts(rows: np.ndarray, new: np.ndarray) -> list[Part]:
    """The filtered rows, cut where a row has very many copies."""
    at = np.flatnonzero(new)
    copies, out, y, k = np.concatenate([at[1:], [len(new)]]) - at - 1, [], 0, 0
    for i in np.flatnonzero(copies * (rows.shape[1] + 1) >= LONG).tolist():
        end = int(at[i]) + 1
        out += [_part(rows[k : i + 1], new[y:end]), _copies(int(copies[i]), rows.shape[1])]
        y, k = end + int(copies[i]), i + 1
    return [*out, _part(rows[k:], new[y:])] if y < len(new) else out


def _part(rows: np.ndarray, new: np.ndarray) -> Part:
    raw, deflate = _filtered(rows, new), zlib.compressobj(1, zlib.DEFLATED, -15)
    return Part(deflate.compress(raw) + deflate.flush(zlib.Z_SYNC_FLUSH), raw.size, zlib.adler32(raw))


@lru_cache(maxsize=1024)
def _copies(count: int, width: int) -> Part:
    return _part(np.zeros((0, width), np.uint8), np.zeros(count, bool))


def _joined(parts: list[Part]) -> bytes:
    """A zlib stream of parts."""
    low, high = 1, 0
    for p in parts:
        a, b = p.check & 0xFFFF, p.check >> 16
        low, high = (low + a - 1) % 65521, (high + b + p.size * (low - 1)) % 65521  # the checksum of both together
    return b"".join([b"\x78\x01", *(p.data for p in parts), b"\x03\x00", struct.pack(">I", high << 16 | low)])


def _starts(place: np.ndarray) -> np.ndarray:
    """Where another row begins."""
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    return new


def _new_rows(rows: np.ndarray) -> np.ndarray:
    """Which rows are not like the one above."""
    wide = next(t for t in (np.uint64, np.uint32, np.uint16, np.uint8) if rows.shape[1] % t().itemsize == 0)
    rows = rows.view(wide) if rows.shape[1] else rows
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return new


#: More greys than this need a byte each.
FEW = 16


def _greys(rows: np.ndarray) -> list[int]:
    """The values in rows, smallest first; FEW + 1 of them at most, found by one quick pass each."""
    if not rows.size:
        return []
    value, top, out = int(rows.min()), int(rows.max()), []
    if value < top and np.count_nonzero(rows == value) + np.count_nonzero(rows == top) == rows.size:
        return [value, top]
    while value < top and len(out) < FEW:
        out.append(value)
        value = int(np.where(rows > value, rows, top).min())
    return [*out, value]


def _ranks(rows: np.ndarray, greys: list[int]) -> np.ndarray:
    """The place of each value in greys, which has them all."""
    out = np.zeros(rows.shape, np.uint8)
    for g in greys[:-1]:
        out += rows > g
    return out


def _squeezed(rows: np.ndarray, bits: int) -> np.ndarray:
    """Samples of a byte each into bits each, the first one highest."""
    if bits == 8:
        return rows
    if bits == 1:
        return np.packbits(rows, axis=1)
    each = 8 // bits
    if rows.shape[1] % each:
        rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % each)))
    some = np.ascontiguousarray(rows).view("<u2" if each == 2 else "<u4")  # samples side by side, the first one lowest
    out = some << (8 - bits)
    for k in range(1, each):
        out |= some >> (8 * k - bits * (each - 1 - k))
    return out.astype(np.uint8)


def encode_png(image: Picture) -> bytes:
    """A picture to a PNG: greys and few colours by a palette, others in RGB."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    p = packed(image)
    head = struct.pack(">IIBBBBB", p.width, p.height, p.bits, p.kind, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + (chunk(b"PLTE", p.palette) if p.palette else b"") + chunk(b"IDAT", p.data) + chunk(b"IEND", b"")


def png_size(data: bytes) -> tuple[int, int]:
    return struct.unpack(">II", data[16:24])


def decode_png(data: bytes) -> np.ndarray:
    """An RGB picture on white paper, from any non-interlaced PNG of 8 bits or fewer a sample."""
    px = read_png(data)
    return np.repeat(px[..., None], 3, axis=2) if px.ndim == 2 else px


def read_png(data: bytes) -> np.ndarray:
    """As decode_png, but a picture of greys without transparency is height x width."""
    px = read_rows(data)
    return px.pixels() if isinstance(px, Rows) else px


def read_rows(data: bytes) -> np.ndarray | Rows:
    """As read_png, but greys whose rows repeat stay rows."""
    if data[:8] != PNG_MAGIC:
        raise UnsupportedInput("not a PNG")
    at, parts, palette, clear = 8, [], None, b""
    width = height = bits = kind = lace = 0
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, bits, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            parts.append(body)
        at += 12 + size
    if lace or bits > 8:
        raise UnsupportedInput("interlaced and 16-bit PNGs are not supported")
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    row, step = (width * samples * bits + 7) // 8, max(1, samples * bits // 8)
    rows = np.frombuffer(zlib.decompress(b"".join(parts), bufsize=max(1, height * (row + 1))), np.uint8).reshape(height, row + 1)
    if (found := _repeated(rows)) is not None:
        place, out = found.place, found.rows[:, 1:]
    else:
        place, out, above = None, np.zeros((height, row), np.uint8), np.zeros(row, np.uint8)
        for y in range(height):
            out[y] = above = _unfiltered(rows[y, 0], rows[y, 1:], above, step)
    if bits < 8:
        out = np.unpackbits(out, axis=1, count=width * samples) if bits == 1 else _spread(out, bits)[:, : width * samples]
        if kind == 0:
            out = (out.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    grey = kind == 3 and not clear and (palette == palette[:, :1]).all()
    if grey:
        values = palette[:, 0]
        out = out * (values[1] - values[0]) + values[0] if bits == 1 and len(values) == 2 else values[out]
    if grey or (kind == 0 and not clear):
        return out if place is None else Rows(out, place)
    if place is not None:
        out = out[place]
    px = out.reshape(height, width, samples)
    if kind == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        px = np.concatenate([palette[px[..., 0]], alpha[px[..., 0]][..., None]], axis=2)
    elif kind in (0, 4):
        px = np.concatenate([np.repeat(px[..., :1], 3, axis=2), px[..., 1:]], axis=2)
    if px.shape[2] == 3:
        return px
    alpha = px[..., 3:].astype(np.uint16)
    return ((px[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)


def _repeated(rows: np.ndarray) -> Rows | None:
    """Rows behind their filters where all but the plain ones are copies of the row above."""
    filters = rows[:, 0].copy()
    plain = filters == 0
    at = np.flatnonzero(plain)
    if not len(at) or at[0] or np.count_nonzero(filters == 2) != len(rows) - len(at):
        return None
    own = rows[at]
    marked = np.count_nonzero(rows.view(bool)) - np.count_nonzero(own.view(bool))
    return Rows(own, np.cumsum(plain) - 1) if marked == len(rows) - len(at) else None  # nothing but the filters


def _spread(rows: np.ndarray, bits: int) -> np.ndarray:
    """Samples of bits each into a byte each."""
    out = np.empty((*rows.shape, 8 // bits), np.uint8)
    for k in range(8 // bits):
        out[..., k] = (rows >> (8 - bits * (k + 1))) & ((1 << bits) - 1)
    return out.reshape(len(rows), -1)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        pad = (-len(line)) % step
        cells = np.r_[line, np.zeros(pad, np.uint8)].reshape(-1, step)
        return np.cumsum(cells, axis=0, dtype=np.uint8).ravel()[: len(line)]
    out = np.zeros(len(line) + step, np.int64)
    up = np.r_[np.zeros(step, np.int64), above.astype(np.int64)]
    for i, v in enumerate(line.tolist(), step):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (v + guess) & 255
    return out[step:].astype(np.uint8)


def resized(region: np.ndarray, height: int, width: int, smooth: bool = False) -> np.ndarray:
    """Nearest neighbours, or linear between the centres of the source's pixels."""
    h, w = region.shape[:2]
    if not smooth:
        return region[np.arange(height) * h // height][:, np.arange(width) * w // width]

    def ends(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, m - 1), at - low

    y0, y1, fy = ends(height, h)
    x0, x1, fx = ends(width, w)
    f = region.astype(np.float64)
    rows = f[y0] * (1 - fy)[:, None, None] + f[y1] * fy[:, None, None]
    return rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]


def shrunk(region: np.ndarray) -> np.ndarray:
    """Means of blocks: the region at a twelfth of its size, one pixel at least."""
    height, width = region.shape[:2]
    h, w = max(1, height // DETAIL), max(1, width // DETAIL)
    ys, xs = np.arange(h) * height // h, np.arange(w) * width // w
    sums = np.add.reduceat(np.add.reduceat(region.astype(np.float64), ys, axis=0), xs, axis=1)
    counts = np.outer(np.diff(np.r_[ys, height]), np.diff(np.r_[xs, width]))
    return sums / counts[..., None]


def gaussian(picture: np.ndarray, radius: int) -> np.ndarray:
    """Two passes of a normal kernel, edges repeated."""
    reach = 3 * radius
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        pad = [(reach, reach) if k == axis else (0, 0) for k in range(3)]
        wide = np.pad(picture, pad, mode="edge")
        size = picture.shape[axis]
        part = lambda i: wide[i : i + size] if axis == 0 else wide[:, i : i + size]  # noqa: B023, E731
        picture = sum(k * part(i) for i, k in enumerate(kernel))
    return picture


def fill(image: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> None:
    image[y0:y1, x0:x1] = 0


def pixelate(image: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> None:
    image[y0:y1, x0:x1] = np.floor(resized(shrunk(image[y0:y1, x0:x1]), y1 - y0, x1 - x0) + 0.5).astype(np.uint8)


def _radius(height: int) -> int:
    return max(3, int(np.floor(height * 0.32 + 0.5)))


def _reach(style: str, height: int) -> int:
    """Pixels around a box of this height that its cover depends on."""
    return 2 * _radius(height) if style == "blur" else 0


def blur(image: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> None:
    """Downsampled first, then smoothed over a margin, of which only the box is written back."""
    radius = _radius(y1 - y0)
    ax, ay = max(0, x0 - 2 * radius), max(0, y0 - 2 * radius)
    bx, by = min(image.shape[1], x1 + 2 * radius), min(image.shape[0], y1 + 2 * radius)
    coarse = shrunk(image[ay:by, ax:bx])
    soft = gaussian(resized(coarse, by - ay, bx - ax, smooth=True), radius)
    image[y0:y1, x0:x1] = np.clip(np.floor(soft[y0 - ay : y1 - ay, x0 - ax : x1 - ax] + 0.5), 0, 255).astype(np.uint8)


#: A 3 x 5 face for labels, as rows of bits from the top; fixed values of our own.
GLYPHS = {
    **dict(zip("ABCDEFGHIJKLM", ("25755", "65656", "34443", "65556", "74647", "74644", "34553", "55755", "72227", "11152", "55655", "44447", "57755"), strict=True)),
    **dict(zip("NOPQRSTUVWXYZ", ("65555", "25552", "65644", "25563", "65655", "34216", "72222", "55557", "55552", "55775", "55255", "55222", "71247"), strict=True)),
    **dict(zip("0123456789_+-", ("75557", "26227", "71747", "71717", "55711", "74717", "74757", "71111", "75757", "75717", "00007", "02720", "00700"), strict=True)),
}


@lru_cache(maxsize=256)
def text_mask(text: str, size: int) -> np.ndarray:
    """The text as a mask about size pixels high; unknown signs are blank."""
    unit = max(1, size // 6)
    columns = []
    for c in text.upper():
        rows = [[(int(r) >> (2 - k)) & 1 for k in range(3)] for r in GLYPHS.get(c, "00000")]
        columns.append(np.array([[*r, 0] for r in rows], dtype=bool))
    mask = np.concatenate(columns, axis=1)[:, :-1] if columns else np.zeros((5, 0), bool)
    return np.repeat(np.repeat(mask, unit, axis=0), unit, axis=1)


def stamp(image: np.ndarray, mask: np.ndarray, cx: float, cy: float, colour: tuple[int, int, int]) -> None:
    """The mask in a colour, centred on a point and clipped to the picture."""
    y, x = int(cy - mask.shape[0] / 2), int(cx - mask.shape[1] / 2)
    y0, x0 = max(0, y), max(0, x)
    part = mask[y0 - y : image.shape[0] - y, x0 - x : image.shape[1] - x]
    image[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]][part] = colour[: image.shape[2]]


def label(image: np.ndarray, x0: int, y0: int, x1: int, y1: int, target: str) -> None:
    fill(image, x0, y0, x1, y1)
    size = min(int((y1 - y0) * 0.7), 14)
    mask = text_mask(target, size) if size >= 6 else None
    if mask is not None and mask.shape[1] <= x1 - x0 - 4:
        stamp(image, mask, (x0 + x1) / 2, (y0 + y1) / 2, (255, 255, 255))


COVER: dict[str, Callable] = {"box": fill, "pixelate": pixelate, "blur": blur}


def painted(image: np.ndarray | Rows, boxes: list[tuple[float, float, float, float, str]], style: str) -> np.ndarray | Rows:
    """A copy with each (x, y, width, height, target) covered, in order, on whole pixels within the picture. Greys stay greys, and rows rows."""
    height, width = (len(image.place), image.rows.shape[1]) if isinstance(image, Rows) else image.shape[:2]
    spots = []
    for x, y, w, h, target in boxes:
        x0, y0 = max(0, int(np.floor(x))), max(0, int(np.floor(y)))
        x1, y1 = min(width, int(np.ceil(x + w))), min(height, int(np.ceil(y + h)))
        if x1 > x0 and y1 > y0:
            spots.append((x0, y0, x1, y1, target))
    if isinstance(image, Rows):
        return _painted_rows(image, spots, style)
    copy = image.copy()
    _cover(copy, spots, style)
    return copy


def _cover(image: np.ndarray, spots: list[tuple[int, int, int, int, str]], style: str) -> None:
    out = image if image.ndim == 3 else image[..., None]
    for *spot, target in spots:
        if style == "label":
            label(out, *spot, target)
        else:
            COVER[style](out, *spot)


def _painted_rows(image: Rows, spots: list[tuple[int, int, int, int, str]], style: str) -> Rows:
    """Only the rows around what is covered become pixels: as many as the style looks at, so that no edge shows up where the picture has none."""
    bands: list[list] = []
    for n, (_, y0, _, y1, _) in sorted(enumerate(spots), key=lambda s: s[1][1] - _reach(style, s[1][3] - s[1][1])):
        low, high = max(0, y0 - _reach(style, y1 - y0)), min(len(image.place), y1 + _reach(style, y1 - y0))
        if bands and low < bands[-1][1]:
            bands[-1][1] = max(high, bands[-1][1])
            bands[-1][2].append(n)
        else:
            bands.append([low, high, [n]])
    rows, place, count = [image.rows], image.place.copy(), len(image.rows)
    for low, high, own in bands:
        part = image.rows[image.place[low:high]]
        _cover(part, [(x0, y0 - low, x1, y1 - low, target) for x0, y0, x1, y1, target in map(spots.__getitem__, sorted(own))], style)
        new = _new_rows(part)
        rows.append(part[new])
        place[low:high] = count + np.cumsum(new) - 1
        count += len(rows[-1])
    return Rows(np.concatenate(rows), place)


def _tinted(part: np.ndarray, opacity: float) -> np.ndarray:
    return (part * (1 - opacity) + np.array(MAGENTA) * opacity).astype(np.uint8)


#: y, x, height, width of a grid line, or of a letter's or number's mask.
Step = tuple[int, int, int, int, np.ndarray | None]


def _steps(height: int, width: int, cols: int, rows: int, name: Callable[[int], str]) -> list[Step]:
    """Grid lines over the page, and letters and numbers in the margin on all sides, in the order in which they are drawn."""
    size = max(11, int(min(width / cols, height / rows) * 0.55 + 0.5))
    out: list[Step] = []

    def sign(text: str, cx: float, cy: float) -> None:
        mask = text_mask(text, size)
        out.append((int(cy - mask.shape[0] / 2), int(cx - mask.shape[1] / 2), *mask.shape, mask))

    for k in range(cols + 1):
        out.append((GUTTER, min(GUTTER + int(k * width / cols), GUTTER + width), height, 1, None))
        for y in (GUTTER / 2, GUTTER * 1.5 + height) if k < cols else ():
            sign(name(k), GUTTER + (k + 0.5) * width / cols, y)
    for k in range(rows + 1):
        out.append((min(GUTTER + int(k * height / rows), GUTTER + height), GUTTER, 1, width, None))
        for x in (GUTTER / 2, GUTTER * 1.5 + width) if k < rows else ():
            sign(str(k + 1), x, GUTTER + (k + 0.5) * height / rows)
    return out


def _ruled(out: np.ndarray, ys: np.ndarray, steps: list[Step], tint: Callable[[np.ndarray], None], ink: tuple[int, ...]) -> None:
    """Takes the steps on out, which has those rows of the picture that ys says."""
    for y, x, height, width, mask in steps:
        a, b = np.searchsorted(ys, (y, y + height))
        part = out[a:b, max(0, x) : max(0, x + width)]
        if mask is None:
            tint(part)
        else:
            left = max(0, -x)
            part[mask[ys[a:b] - y, left : left + part.shape[1]]] = ink


#: Kinds of pixels of a frame: the page's own, the margin's and the ink's, and each again for every tint that lies over it.
KINDS = 3


@lru_cache(maxsize=64)
def _frame(height: int, width: int, cols: int, rows: int, name: Callable[[int], str]) -> Rows | None:
    """The kind of each pixel of an overlay of this size, whatever the page shows; None where tints lie too deep."""
    if cols + rows + 2 > 255 // KINDS:  # so many tints of one pixel would not fit a byte
        return None
    steps, whole = _steps(height, width, cols, rows, name), height + 2 * GUTTER
    changes = np.zeros(whole + 1, bool)  # rows that may differ from the one above
    changes[[0, GUTTER, GUTTER + height]] = True
    for y, _, high, _, mask in steps:
        changes[max(0, y) : max(0, y + high + 1)] |= mask is not None
        changes[[min(whole, max(0, end)) for end in (y, y + high)]] = True
    ys = np.flatnonzero(changes[:whole])
    out = np.ones((len(ys), width + 2 * GUTTER, 1), np.uint8)
    out[(ys >= GUTTER) & (ys < GUTTER + height), GUTTER : GUTTER + width] = 0
    _ruled(out, ys, steps, lambda part: np.add(part, KINDS, out=part), (2,))
    new = _new_rows(out[..., 0])
    return Rows(out[new, :, 0], np.repeat(np.cumsum(new) - 1, np.diff(ys, append=whole)))


@lru_cache(maxsize=64)
def _places(height: int, width: int, cols: int, rows: int, name: Callable[[int], str], n: int) -> tuple[list[int], Rows, np.ndarray | None] | None:
    """What an overlay of a page of n greys has before the page comes in: its kinds, the place of each pixel's first colour, and 1 where the page shows through (None: everywhere)."""
    frame = _frame(height, width, cols, rows, name)
    if frame is None:
        return None
    seen = np.zeros(256, bool)
    for k in range(0, len(frame.rows), 64):
        seen |= np.bincount(frame.rows[k : k + 64].ravel(), minlength=256) > 0
    kinds = np.flatnonzero(seen).tolist()
    if sum(1 if kind % KINDS else n for kind in kinds) > 256:
        return None
    start, at = np.zeros(256, np.uint8), 0
    for kind in kinds:
        start[kind] = at
        at += 1 if kind % KINDS else n
    shown = (np.arange(256) % KINDS == 0).astype(np.uint8)[frame.rows[:, GUTTER : GUTTER + width]]
    inside = np.unique(frame.place[GUTTER : GUTTER + height])
    return kinds, Rows(start[frame.rows], frame.place), None if shown[inside].all() else shown


#: Rows of an overlay that are deflated together.
BAND = 64


def _laid(first: Rows, shown: np.ndarray | None, page: np.ndarray, ranks: np.ndarray, y0: int, y1: int) -> Rows:
    """Rows y0 to y1 of an overlay. page has the place in ranks of each row, below zero outside the page."""
    place, own = first.place[y0:y1], page[y0:y1]
    new = _starts(place) | _starts(own)
    place, inside = place[new], np.flatnonzero(own[new] >= 0)
    out = first.rows[place]
    if len(inside):
        ink = ranks[own[new][inside]]
        out[inside[0] : inside[-1] + 1, GUTTER : GUTTER + ranks.shape[1]] += ink if shown is None else ink * shown[place[inside]]
    return Rows(out, np.cumsum(new) - 1)


@lru_cache(maxsize=4096)
def _calm(height: int, width: int, cols: int, rows: int, name: Callable[[int], str], n: int, rank: int, bits: int, y: int) -> Part:
    """The band from y on of the overlay of a page that has only one of its greys there."""
    _, first, shown = _places(height, width, cols, rows, name, n)
    page = np.full(len(first.place), -1)
    page[GUTTER : GUTTER + height] = 0
    band = _laid(first, shown, page, np.full((1, width), rank, np.uint8), y, min(y + BAND, len(page)))
    return _part(_squeezed(band.rows, bits), _starts(band.place))


@lru_cache(maxsize=64)
def _colours(kinds: tuple[int, ...], greys: tuple[int, ...], opacity: float) -> tuple[tuple[int, int, int], ...]:
    """The colours of an overlay, in the order in which kinds and greys have their places."""
    out = []
    for kind in kinds:
        own = [(MARGIN, INK)[kind % KINDS - 1]] if kind % KINDS else [(g, g, g) for g in greys]
        for _ in range(kind // KINDS):
            own = [tuple(c) for c in _tinted(np.array(own, np.uint8), opacity).tolist()]
        out += own
    return tuple(out)


def _overlaid(image: Rows, cols: int, rows: int, opacity: float, name: Callable[[int], str]) -> Stacked | None:
    """The overlay of a page of few greys; None where there are too many. Bands where the page is like its last row come from a memo."""
    image = image.used()
    height, width = len(image.place), image.rows.shape[1]
    greys = _greys(image.rows)
    if len(greys) > 8 or (found := _places(height, width, cols, rows, name, len(greys))) is None:
        return None
    kinds, first, shown = found
    colours = _colours(tuple(kinds), tuple(greys), opacity)
    ranks, bits = _ranks(image.rows, greys), _bits(len(colours))
    page = np.full(len(first.place), -1)
    page[GUTTER : GUTTER + height] = image.place
    rank = int(ranks[image.place[-1], 0]) if ranks.size else 0
    calm = np.append((ranks == rank).all(axis=1), True)[page]  # outside the page it is as calm
    ends = [*range(0, len(page), BAND), len(page)]
    bands: list[Part | Rows] = []
    for same, run in groupby(zip(np.logical_and.reduceat(calm, ends[:-1]).tolist(), ends, ends[1:], strict=False), key=lambda b: b[0]):
        spans = [(y0, y1) for _, y0, y1 in run]
        if same:
            bands += [_calm(height, width, cols, rows, name, len(greys), rank, bits, y0) for y0, _ in spans]
        else:
            bands.append(_laid(first, shown, page, ranks, spans[0][0], spans[-1][1]))
    return Stacked(len(page), width + 2 * GUTTER, tuple(bands), colours)


def overlay(image: np.ndarray | Rows, cols: int, rows: int, opacity: float, name: Callable[[int], str]) -> Picture:
    """The page inside a margin with letters and numbers on all sides, and grid lines over it. A page of few greys comes out indexed."""
    if isinstance(image, Rows) or image.ndim == 2:
        if not isinstance(image, Rows):
            new = _new_rows(image)
            image = Rows(image[new], np.cumsum(new) - 1)
        if (few := _overlaid(image, cols, rows, opacity, name)) is not None:
            return few
        image = image.pixels()[..., None]
    height, width = image.shape[:2]
    out = np.empty((height + 2 * GUTTER, width + 2 * GUTTER, 3), np.uint8)
    out[:] = MARGIN
    out[GUTTER : GUTTER + height, GUTTER : GUTTER + width] = image
    _ruled(out, np.arange(len(out)), _steps(height, width, cols, rows, name), lambda part: part.__setitem__(slice(None), _tinted(part, opacity)), INK)
    return out


def raster_pdf(pages: list[tuple[Picture, float, float]]) -> bytes:
    """A PDF of one picture a page (picture, width and height in points): no text, no links, no metadata but the maker's name."""
    objects: list[bytes] = [b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Title()/Author()/Subject()/Keywords()/Creator(inkveil)/Producer(inkveil)>>"]
    kids = []
    for image, width, height in pages:
        n = len(objects) + 1
        kids.append(f"{n} 0 R")
        draw = f"q {width:.4f} 0 0 {height:.4f} 0 0 cm /I Do Q".encode()
        p = packed(image)
        space = "[/Indexed/DeviceRGB %d<%s>]" % (len(p.palette) // 3 - 1, p.palette.hex()) if p.kind == 3 else "/DeviceRGB" if p.kind == 2 else "/DeviceGray"
        filtered = f"/DecodeParms<</Predictor 15/Colors {3 if p.kind == 2 else 1}/BitsPerComponent {p.bits}/Columns {p.width}>>"
        objects.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {width:.4f} {height:.4f}]/Resources<</XObject<</I {n + 2} 0 R>>>>/Contents {n + 1} 0 R>>".encode())
        objects.append(b"<</Length %d>>stream\n%s\nendstream" % (len(draw), draw))
        head = f"<</Type/XObject/Subtype/Image/Width {p.width}/Height {p.height}/ColorSpace{space}/BitsPerComponent {p.bits}/Filter/FlateDecode{filtered}/Length {len(p.data)}>>stream\n"
        objects.append(head.encode() + p.data + b"\nendstream")
    objects[1] = f"<</Type/Pages/Count {len(kids)}/Kids[{' '.join(kids)}]>>".encode()
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1)
    out += b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer<</Size %d/Root 1 0 R/Info 3 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table)
    return bytes(out)
