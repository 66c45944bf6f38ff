"""What PDFs say of their pages: boxes, text runs and links. Nothing is drawn.

Objects are found by their own marks, not by the cross-reference table, so a file
with a broken table reads the same; of two objects with one number the later one
counts, as after an incremental save. Objects packed in object streams are read
too. Streams may be bare or deflated. A file that is encrypted or has no page tree
is refused: what it holds would be read wrongly without a word.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from inkveil.errors import UnsupportedInput

_SPACE = b"\x00\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%"
_NUMBER = re.compile(rb"[-+]?(?:\d+\.?\d*|\.\d+)\Z")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}
#: Nested forms and page tree nodes that are followed; deeper ones are cycles or mischief.
DEPTH = 12
#: Bytes that a stream may hold once inflated.
MAX_STREAM = 256 << 20

#: Thousandths of the font's size that part two words of one operator.
GAP = 250

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Name(str):
    """/Name."""


class Word(str):
    """A keyword or operator."""


@dataclass(frozen=True)
class Ref:
    number: int


def times(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def moved(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


class Reader:
    """Objects of a stretch of bytes, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            if data[self.at] in _SPACE:
                self.at += 1
            elif data[self.at] == 37:  # a comment, to the end of its line
                ends = [e for e in (data.find(b"\n", self.at), data.find(b"\r", self.at)) if e >= 0]
                self.at = min(ends, default=n)
            else:
                return

    def _string(self) -> bytes:
        out, depth, data = bytearray(), 1, self.data
        self.at += 1
        while self.at < len(data):
            c = data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                e = data[self.at : self.at + 1]
                octal = re.compile(rb"[0-7]{1,3}").match(data, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                elif e in (b"\r", b"\n"):
                    self.at += 2 if data[self.at : self.at + 2] == b"\r\n" else 1
                else:
                    out += _ESCAPES.get(e, e)
                    self.at += 1
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        return bytes(out)

    def _plain(self) -> bytes:
        start, data = self.at, self.data
        while self.at < len(data) and data[self.at] not in _SPACE and data[self.at] not in _DELIMITERS:
            self.at += 1
        return data[start : self.at]

    def next(self):
        """The next object; None at the end. References are two numbers and a Word R until an array or dictionary joins them."""
        self._skip()
        data = self.data
        if self.at >= len(data):
            return None
        c = data[self.at : self.at + 1]
        if c == b"(":
            return self._string()
        if c == b"/":
            self.at += 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), self._plain()).decode("latin-1"))
        if data[self.at : self.at + 2] == b"<<":
            self.at += 2
            items = self._until(">>")
            return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        if c == b"<":
            end = data.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[self.at + 1 : end if end >= 0 else len(data)])
            self.at = end + 1 if end >= 0 else len(data)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self._until("]")
        if data[self.at : self.at + 2] == b">>":
            self.at += 2
            return Word(">>")
        if c in (b"]", b"{", b"}", b")", b">"):
            self.at += 1
            return Word(c.decode())
        plain = self._plain()
        if _NUMBER.match(plain):
            return float(plain) if b"." in plain else int(plain)
        return Word(plain.decode("latin-1"))

    def _until(self, end: str) -> list:
        items = []
        while (x := self.next()) is not None and not (isinstance(x, Word) and x == end):
            if isinstance(x, Word) and x == "R" and len(items) > 1 and isinstance(items[-2], int):
                items[-2:] = [Ref(items[-2])]
            elif isinstance(x, Word) and x in ("true", "false", "null"):
                items.append({"true": True, "false": False}.get(x))
            else:
                items.append(x)
        return items


@dataclass(frozen=True)
class Run:
    """Text in the pixels' direction: left and baseline from the top left, in points; width 0 if the font does not tell."""

    text: str
    left: float
    baseline: float
    height: float
    width: float
    font: str


class Font:
    """Codes of a font to text and to widths in thousandths."""

    def __init__(self, pdf: Pdf, spec: dict):
        self.name = str(pdf.of(spec.get("BaseFont")) or "")
        self.wide = pdf.of(spec.get("Subtype")) == "Type0"
        self.widths: dict[int, float] = {}
        self.default: float | None = None
        self.text: dict[int, str] = {}
        if self.wide:
            below = pdf.of((pdf.of(spec.get("DescendantFonts")) or [None])[0]) or {}
            self.default = float(pdf.of(below.get("DW", 1000)))
            listed = [pdf.of(x) for x in pdf.of(below.get("W")) or []]
            while len(listed) >= 2:
                if isinstance(listed[1], list):
                    self.widths |= {listed[0] + k: float(pdf.of(w)) for k, w in enumerate(listed[1])}
                    listed = listed[2:]
                elif len(listed) > 2:
                    self.widths |= dict.fromkeys(range(listed[0], min(listed[1], 65535) + 1), float(listed[2]))
                    listed = listed[3:]
                else:
                    break
        else:
            first = pdf.of(spec.get("FirstChar", 0)) or 0
            self.widths = {first + k: float(pdf.of(w) or 0) for k, w in enumerate(pdf.of(spec.get("Widths")) or [])}
            missing = (pdf.of(spec.get("FontDescriptor")) or {}).get("MissingWidth")
            self.default = float(pdf.of(missing)) if missing is not None and self.widths else None
        to = pdf.of(spec.get("ToUnicode"))
        if isinstance(to, Stream):
            self._read_map(to.data)

    def _read_map(self, data: bytes) -> None:
        """bfchar and bfrange of a character map."""
        said = lambda b: b.decode("utf-16-be", "replace")
        code = lambda b: int.from_bytes(b, "big")
        reader, held = Reader(data), []
        while (x := reader.next()) is not None:
            if not isinstance(x, Word):
                held.append(x)
                continue
            if x == "endbfchar":
                self.text |= {code(a): said(b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif x == "endbfrange":
                for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                    for k in range(min(code(high) - code(low), 65535) + 1):
                        if isinstance(to, list):
                            self.text |= {code(low) + k: said(to[k])} if k < len(to) else {}
                        else:
                            self.text[code(low) + k] = said(to[:-2]) + chr((code(to[-2:]) + k) & 0xFFFF)
            held = []

    def read(self, raw: bytes) -> tuple[str, float | None, int, int]:
        """Text, width in thousandths (None if unknown), codes, and blanks of one byte."""
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)] if self.wide else list(raw)
        other = "" if self.wide else None
        text = "".join(self.text.get(c, bytes([c]).decode("cp1252", "replace") if other is None else other) for c in codes)
        known = [self.widths.get(c, self.default) for c in codes]
        return text, None if any(w is None for w in known) else sum(known), len(codes), 0 if self.wide else raw.count(b" ")


@dataclass(frozen=True)
class Stream:
    spec: dict
    data: bytes


class Pdf:
    """Pages of a file, in the order of its page tree."""

    def __init__(self, data: bytes):
        self.objects: dict[int, object] = {}
        packed: list[Stream] = []
        at = 0
        mark = re.compile(rb"(?<![0-9])(\d{1,10})\s+\d{1,5}\s+obj\b")
        while m := mark.search(data, at):
            reader = Reader(data, m.end())
            value = reader.next()
            at = max(reader.at, m.end())
            word = re.compile(rb"[\x00\t\n\x0c\r ]*(R\b|stream\r?\n?)?").match(data, at)
            if isinstance(value, dict) and word[1] and word[1].startswith(b"stream"):
                value, at = self._stream(data, value, word.end())
                if value.spec.get("Type") == "ObjStm":
                    packed.append(value)
            self.objects[int(m[1])] = value
        trailers = [r for m in re.finditer(rb"\btrailer\b", data) if isinstance(r := Reader(data, m.end()).next(), dict)]
        trailers += [o.spec for o in self.objects.values() if isinstance(o, Stream) and o.spec.get("Type") == "XRef"]
        if any("Encrypt" in t for t in trailers):
            raise UnsupportedInput("The PDF is encrypted.")
        for stream in packed:
            self._unpack(stream)
        roots = [self.of(t["Root"]) for t in trailers if "Root" in t] + [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"]
        tree = next((r["Pages"] for r in roots if isinstance(r, dict) and "Pages" in r), None)
        self.pages = list(self._leaves(tree, {}, set())) if tree is not None else []
        if not self.pages:
            raise UnsupportedInput("The PDF has no pages that can be read.")

    def of(self, x):
        """What a reference stands for."""
        for _ in range(DEPTH):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x.number)
        return None

    def _stream(self, data: bytes, spec: dict, at: int) -> tuple[Stream, int]:
        length = self.of(spec.get("Length"))
        end = at + length if isinstance(length, int) and re.compile(rb"\s*endstream").match(data, at + length) else data.find(b"endstream", at)
        end = len(data) if end < 0 else end
        raw = data[at:end]
        filters = self.of(spec.get("Filter"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        if spec.get("Subtype") == "Image":
            raw = b""
        elif filters in (["FlateDecode"], ["Fl"]):
            try:
                inflate = zlib.decompressobj()
                raw = inflate.decompress(raw, MAX_STREAM)
            except zlib.error as e:
                raise UnsupportedInput(f"A stream of the PDF is damaged: {e}.") from e
            if inflate.unconsumed_tail:
                raise UnsupportedInput(f"A stream of the PDF is over {MAX_STREAM >> 20} MB.")
        elif filters:
            raw = b""  # codings of pictures, which have no text
        return Stream(spec, raw), end

    def _unpack(self, stream: Stream) -> None:
        count, first = self.of(stream.spec.get("N")) or 0, self.of(stream.spec.get("First")) or 0
        head = Reader(stream.data[:first])
        for _ in range(count):
            number, offset = head.next(), head.next()
            if isinstance(number, int) and isinstance(offset, int) and number not in self.objects:
                self.objects[number] = Reader(stream.data, first + offset).next()

    def _leaves(self, node, above: dict, seen: set) -> Iterator[dict]:
        key = node.number if isinstance(node, Ref) else id(node)
        spec = self.of(node)
        if not isinstance(spec, dict) or key in seen:
            return
        seen.add(key)
        own = above | {k: spec[k] for k in ("MediaBox", "Resources", "Rotate") if k in spec}
        if "Kids" in spec:
            for kid in self.of(spec["Kids"]) or []:
                yield from self._leaves(kid, own, seen)
        elif spec.get("Type") == "Page":
            yield own | spec

    def frame(self, page: dict) -> tuple[float, float, Matrix]:
        """Width and height in points as shown, and the matrix from the page's space to points from the top left."""
        box = [float(self.of(v)) for v in self.of(page.get("MediaBox")) or (0, 0, 612, 792)]
        x0, x1, y0, y1 = min(box[0], box[2]), max(box[0], box[2]), min(box[1], box[3]), max(box[1], box[3])
        w, h = x1 - x0, y1 - y0
        turn = int(self.of(page.get("Rotate")) or 0) % 360
        return {
            0: (w, h, (1, 0, 0, -1, -x0, y1)),
            90: (h, w, (0, 1, 1, 0, -y0, -x0)),
            180: (w, h, (-1, 0, 0, 1, x1, -y0)),
            270: (h, w, (0, -1, -1, 0, y1, x1)),
        }.get(turn, (w, h, (1, 0, 0, -1, -x0, y1)))

    def _content(self, value) -> bytes:
        value = self.of(value)
        parts = value if isinstance(value, list) else [value]
        return b"\n".join(p.data for p in map(self.of, parts) if isinstance(p, Stream))

    def runs(self, page: dict) -> list[Run]:
        out: list[Run] = []
        self._show(self._content(page.get("Contents")), self.of(page.get("Resources")) or {}, self.frame(page)[2], out, 0)
        return out

    def _show(self, data: bytes, resources: dict, base: Matrix, out: list[Run], depth: int) -> None:
        fonts: dict[str, Font | None] = {}
        known, forms = self.of(resources.get("Font")) or {}, self.of(resources.get("XObject")) or {}
        start = {"ctm": base, "font": None, "size": 0.0, "gap": 0.0, "word": 0.0, "scale": 1.0, "leading": 0.0, "rise": 0.0}
        state, stack, line, here = dict(start), [], UNIT, UNIT
        reader, held = Reader(data), []

        def shown(pieces: list) -> None:
            """One run for the strings of an operator. A move to the right by GAP between them is a space."""
            nonlocal here
            font, size, begin = state["font"], state["size"], here
            said, sure = "", True
            for piece in pieces:
                if isinstance(piece, bytes):
                    text, width, n, blanks = font.read(piece) if font else (piece.decode("cp1252", "replace"), None, len(piece), piece.count(b" "))
                    said, sure = said + text, sure and width is not None
                    advance = (500.0 * n if width is None else width) / 1000 * size + n * state["gap"] + blanks * state["word"]
                elif isinstance(piece, (int, float)):
                    advance = -piece / 1000 * size
                    said += " " if -piece > GAP and said and not said.endswith(" ") else ""
                else:
                    continue
                here = times((1, 0, 0, 1, advance * state["scale"], 0), here)
            m = times((size * state["scale"], 0, 0, size, 0, state["rise"]), times(begin, state["ctm"]))
            height = math.hypot(m[2], m[3])
            if said.strip() and height > 0:
                a, b = moved(times(begin, state["ctm"]), 0, 0), moved(times(here, state["ctm"]), 0, 0)
                out.append(Run(said, m[4], m[5], height, math.hypot(b[0] - a[0], b[1] - a[1]) if sure else 0.0, font.name if font else ""))

        def next_line(x: float, y: float) -> None:
            nonlocal line, here
            line = here = times((1, 0, 0, 1, x, y), line)

        while (x := reader.next()) is not None:
            if not isinstance(x, Word):
                held.append(x)
                continue
            num = [float(v) for v in held if isinstance(v, (int, float)) and not isinstance(v, bool)]
            if x == "q":
                stack.append(dict(state))
            elif x == "Q" and stack:
                state = stack.pop()
            elif x == "cm" and len(num) >= 6:
                state["ctm"] = times(tuple(num[-6:]), state["ctm"])
            elif x == "BT":
                line = here = UNIT
            elif x == "Tf" and held and num:
                name = next((v for v in held if isinstance(v, Name)), "")
                if name not in fonts:
                    spec = self.of(known.get(name))
                    fonts[name] = Font(self, spec) if isinstance(spec, dict) else None
                state["font"], state["size"] = fonts[name], num[-1]
            elif x in ("Tc", "Tw", "TL", "Ts") and num:
                state[{"Tc": "gap", "Tw": "word", "TL": "leading", "Ts": "rise"}[x]] = num[-1]
            elif x == "Tz" and num:
                state["scale"] = num[-1] / 100
            elif x == "Tm" and len(num) >= 6:
                line = here = tuple(num[-6:])
            elif x in ("Td", "TD") and len(num) >= 2:
                state["leading"] = -num[-1] if x == "TD" else state["leading"]
                next_line(num[-2], num[-1])
            elif x in ("T*", "'", '"'):
                if x == '"' and len(num) >= 2:
                    state["word"], state["gap"] = num[-2], num[-1]
                next_line(0, -state["leading"])
            if x in ("Tj", "'", '"') and held and isinstance(held[-1], bytes):
                shown([held[-1]])
            elif x == "TJ" and held and isinstance(held[-1], list):
                shown(held[-1])
            elif x == "Do" and held and depth < DEPTH:
                form = self.of(forms.get(held[-1])) if isinstance(held[-1], Name) else None
                if isinstance(form, Stream) and form.spec.get("Subtype") == "Form":
                    own = [float(self.of(v)) for v in self.of(form.spec.get("Matrix")) or UNIT]
                    self._show(form.data, self.of(form.spec.get("Resources")) or resources, times(tuple(own), state["ctm"]), out, depth + 1)
            elif x == "ID":  # a picture inside the page's content
                end = re.compile(rb"\sEI(?=[\s]|\Z)").search(data, reader.at)
                reader.at = end.end() if end else len(data)
            held = []

    def links(self, page: dict) -> list[tuple[str, tuple[float, float, float, float]]]:
        """(address, (left, top, right, bottom)) of Link annotations that open an address."""
        out, frame = [], self.frame(page)[2]
        for note in self.of(page.get("Annots")) or []:
            spec = self.of(note)
            if not isinstance(spec, dict) or spec.get("Subtype") != "Link":
                continue
            uri = self.of((self.of(spec.get("A")) or {}).get("URI"))
            rect = [self.of(v) for v in self.of(spec.get("Rect")) or []]
            if isinstance(uri, bytes) and len(rect) >= 4:
                a, b = moved(frame, *map(float, rect[:2])), moved(frame, *map(float, rect[2:4]))
                out.append((uri.decode("latin-1"), (min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1]))))
        return out
