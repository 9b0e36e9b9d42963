"""A small reader of PDF files: the text of each page and its images, without further libraries.

Understands classic and compressed object tables by scanning for objects, Flate streams with PNG
predictors, ToUnicode maps of fonts, and the text operators. Encrypted files give an error.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

MAX_IMAGES, MAX_IMAGE_BYTES, MIN_SIDE = 100, 50 << 20, 50

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"<<|>>|/[^\s()<>\[\]{}/%]*|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r\n|[\r\n])")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Document:
    """The objects of a file by number: dictionary and stream."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("the file is encrypted")
        self.objects: dict[int, tuple[bytes, bytes | None]] = {}
        at = 0
        while m := _OBJECT.search(data, at):
            end = data.find(b"endobj", m.end())
            begin = re.compile(rb"stream\r?\n").search(data, m.end(), end if end > 0 else len(data))
            if begin is None:
                head, body, at = data[m.end() : end if end > 0 else len(data)], None, (end if end > 0 else len(data))
            else:
                head = data[m.end() : begin.start()]
                n = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
                stop = begin.end() + int(n.group(1)) if n else -1
                if stop < 0 or not data[stop : stop + 12].lstrip().startswith(b"endstream"):
                    stop = data.find(b"endstream", begin.end())
                    stop = len(data) if stop < 0 else stop
                body, at = data[begin.end() : stop], stop
            self.objects[int(m.group(1))] = head, body
        for head, body in list(self.objects.values()):
            if body is not None and re.search(rb"/Type\s*/ObjStm\b", head):
                self._unpack(head, self.decoded(head, body))

    def _unpack(self, head: bytes, body: bytes) -> None:
        first = self.number(head, b"First", 0)
        numbers = [int(x) for x in body[:first].split()]
        starts = [first + o for o in numbers[1::2]]
        for k, (n, start) in enumerate(zip(numbers[::2], starts, strict=False)):
            self.objects.setdefault(n, (body[start : starts[k + 1] if k + 1 < len(starts) else len(body)], None))

    def value(self, head: bytes, name: bytes) -> bytes:
        """What a dictionary has under a name, references followed: a dictionary, an array or a single token."""
        m = re.search(rb"/" + name + rb"(?![A-Za-z0-9])\s*", head)
        if not m:
            return b""
        rest = head[m.end() :]
        if ref := _REF.match(rest):
            return self.objects.get(int(ref.group(1)), (b"", None))[0].strip()
        for opening, closing in ((b"<<", b">>"), (b"[", b"]")):
            if rest.startswith(opening):
                depth = 0
                for t in re.finditer(re.escape(opening) + b"|" + re.escape(closing), rest):
                    depth += 1 if t.group() == opening else -1
                    if not depth:
                        return rest[: t.end()]
        t = _TOKEN.match(rest)
        return t.group() if t else b""

    def number(self, head: bytes, name: bytes, other: int) -> int:
        v = self.value(head, name)
        return int(float(v)) if re.fullmatch(rb"[-+]?\d*\.?\d+", v) else other

    def filters(self, head: bytes) -> list[bytes]:
        return re.findall(rb"/([A-Za-z0-9]+)", self.value(head, b"Filter"))

    def decoded(self, head: bytes, body: bytes) -> bytes:
        """A stream after its Flate filter and predictor; other filters leave the data as it is."""
        if "FlateDecode" not in [f.decode() for f in self.filters(head)[:1]]:
            return body
        out = zlib.decompressobj().decompress(body)
        parms = self.value(head, b"DecodeParms")
        if self.number(parms, b"Predictor", 1) < 10:
            return out
        colors, bits, columns = (self.number(parms, n, d) for n, d in ((b"Colors", 1), (b"BitsPerComponent", 8), (b"Columns", 1)))
        return unpredicted(out, max(1, colors * bits // 8), -(-colors * bits * columns // 8))

    def pages(self) -> list[int]:
        """Object numbers of the pages in reading order."""
        out: list[int] = []
        seen: set[int] = set()

        def walk(n: int) -> None:
            if n in seen:
                return
            seen.add(n)
            head = self.objects.get(n, (b"", None))[0]
            if re.search(rb"/Type\s*/Pages\b", head):
                for kid in _REF.findall(self.value(head, b"Kids")):
                    walk(int(kid))
            elif re.search(rb"/Type\s*/Page\b", head):
                out.append(n)

        kids = {int(k) for h, _ in self.objects.values() if re.search(rb"/Type\s*/Pages\b", h) for k in _REF.findall(self.value(h, b"Kids"))}
        for n in sorted(self.objects, key=lambda n: n in kids):  # roots first
            walk(n)
        return out

    def resources(self, page: int) -> bytes:
        """The resources of a page, its own or those of the nodes above it."""
        n, seen = page, set()
        while n not in seen:
            seen.add(n)
            head = self.objects.get(n, (b"", None))[0]
            if found := self.value(head, b"Resources"):
                return found
            up = re.search(rb"/Parent\s+(\d+)", head)
            if not up:
                break
            n = int(up.group(1))
        return b""

    def content(self, page: int) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", self.objects[page][0])
        parts = []
        for n in _REF.findall(m.group(1)) if m else []:
            head, body = self.objects.get(int(n), (b"", None))
            if body is None:  # an array of references
                refs = [self.objects.get(int(k), (b"", None)) for k in _REF.findall(head)]
                parts += [self.decoded(h, b) for h, b in refs if b is not None]
            else:
                parts.append(self.decoded(head, body))
        return b"\n".join(parts)


def unpredicted(data: bytes, step: int, width: int) -> bytes:
    """Rows of ``width`` bytes, each after the number of its PNG filter, as plain bytes."""
    before, out = np.zeros(width, np.uint8), []
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], np.frombuffer(data, np.uint8, width, at + 1).copy()
        if kind == 2:
            row += before
        elif kind:
            for i in range(width):
                left = int(row[i - step]) if i >= step else 0
                up, corner = int(before[i]), int(before[i - step]) if i >= step else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    guess = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
                row[i] = (int(row[i]) + guess) & 255
        out.append(row.tobytes())
        before = row
    return b"".join(out)


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m: re.Match) -> bytes:
        e = m.group(1)
        return _ESCAPED.get(e) or (bytes([int(e, 8) & 255]) if e.isdigit() else b"" if e[:1] in b"\r\n" else e)

    return _ESCAPE.sub(one, token[1:-1])


def unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """Bytes per code and the text of each code of a ToUnicode map."""
    out: dict[int, str] = {}
    width = 1
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            width, out[int(a, 16)] = max(width, len(a) // 2), text(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            width = max(width, len(a) // 2)
            for k in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                out[int(a, 16) + k] = text(b"%0*x" % (len(c), int(c, 16) + k))
    return width, out


def _fonts(doc: Document, page: int) -> dict[bytes, tuple[int, dict[int, str]]]:
    fonts = {}
    for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", doc.value(doc.resources(page), b"Font")):
        to = re.search(rb"/ToUnicode\s+(\d+)", doc.objects.get(int(n), (b"", None))[0])
        head, body = doc.objects.get(int(to.group(1)), (b"", None)) if to else (b"", None)
        if body is not None:
            fonts[b"/" + name] = unicode_map(doc.decoded(head, body))
    return fonts


def _shown(raw: bytes, font: tuple[int, dict[int, str]] | None) -> str:
    if font is None or not font[1]:
        return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    width, table = font
    codes = [int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), width)]
    return "".join(table.get(c, chr(c) if width == 1 else "") for c in codes)


def page_text(doc: Document, page: int) -> str:
    """The text of a page: a line per text line, a blank line where the next one is further down than usual."""
    fonts, font, stack, array, out = _fonts(doc, page), None, [], None, []
    leading = 0.0
    for m in _TOKEN.finditer(doc.content(page)):
        t = m.group()
        if t[:1] in (b"(", b"<") and t[:2] != b"<<":
            (stack if array is None else array).append(_literal(t))
        elif t == b"[":
            array = []
        elif t == b"]":
            stack, array = [*stack, array or []], None
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            (stack if array is None else array).append(float(t))
        elif t[:1] == b"/":
            stack.append(t)
        else:
            if t == b"Tf" and len(stack) > 1:
                font = fonts.get(stack[-2]) if isinstance(stack[-2], bytes) else None
            elif t in (b"Td", b"TD") and len(stack) > 1 and isinstance(stack[-1], float):
                down = -stack[-1]
                if down and out:
                    out.append("\n\n" if leading and down > 1.6 * leading else "\n")
                elif stack[-2] > 0 and out:
                    out.append(" ")
                leading = down if down > 0 and (not leading or down < leading) else leading
            elif t in (b"T*", b"'", b'"', b"ET", b"Tm") and out and not out[-1].endswith("\n"):
                out.append("\n")
            if t in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                out.append(_shown(stack[-1], font))
            elif t == b"TJ" and stack and isinstance(stack[-1], list):
                out += [(" " if x < -200 else "") if isinstance(x, float) else _shown(x, font) for x in stack[-1]]
            stack = []
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def page_texts(data: bytes) -> list[str]:
    """The text of each page of a file."""
    doc = Document(data)
    return [page_text(doc, p) for p in doc.pages()]


def png(pixels: np.ndarray) -> bytes:
    """Rows of grey or RGB bytes as a PNG file."""
    height, width = pixels.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], 1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def rgb_of_cmyk(pixels: np.ndarray) -> np.ndarray:
    """Ink shares in the last axis (C, M, Y, K of 255) as RGB: ``255 (1 - ink) (1 - black)``."""
    light = 1 - pixels.astype(np.float64) / 255
    return np.round(255 * light[..., :3] * light[..., 3:]).astype(np.uint8)


def decoded_image(doc: Document, head: bytes, body: bytes, width: int, height: int) -> tuple[str, bytes] | None:
    """``(MIME type, data)``: JPEG and JPEG 2000 as they are, raw pixels as PNG; null for what cannot be shown."""
    filters = doc.filters(head)
    if filters[-1:] == [b"DCTDecode"]:
        return "image/jpeg", doc.decoded(head, body) if len(filters) > 1 else body
    if filters[-1:] == [b"JPXDecode"]:
        return "image/jp2", body
    if filters not in ([], [b"FlateDecode"]) or doc.number(head, b"BitsPerComponent", 8) != 8:
        return None
    space = doc.value(head, b"ColorSpace")
    icc = re.search(rb"/ICCBased\s+(\d+)", space)
    channels = doc.number(doc.objects.get(int(icc.group(1)), (b"", None))[0], b"N", 3) if icc else {b"/DeviceRGB": 3, b"/DeviceGray": 1, b"/DeviceCMYK": 4}.get(space, 0)
    raw = doc.decoded(head, body)
    if channels not in (1, 3, 4) or len(raw) < width * height * channels:
        return None
    pixels = np.frombuffer(raw, np.uint8, width * height * channels).reshape((height, width) if channels == 1 else (height, width, channels))
    return "image/png", png(rgb_of_cmyk(pixels) if channels == 4 else pixels)


def images(data: bytes) -> list[tuple[bytes, str, int]]:
    """``(data, MIME type, page)`` of a file's images, at most ``MAX_IMAGES`` and ``MAX_IMAGE_BYTES``; small ones are left out."""
    doc, out, held, seen = Document(data), [], 0, set()
    for number, page in enumerate(doc.pages(), 1):
        for n in map(int, _REF.findall(doc.value(doc.resources(page), b"XObject"))):
            head, body = doc.objects.get(n, (b"", None))
            width, height = doc.number(head, b"Width", 0), doc.number(head, b"Height", 0)
            if body is None or n in seen or not re.search(rb"/Subtype\s*/Image\b", head) or min(width, height) < MIN_SIDE:
                continue
            seen.add(n)
            found = decoded_image(doc, head, body, width, height)
            if found is None:
                continue
            held += len(found[1])
            if len(out) == MAX_IMAGES or held > MAX_IMAGE_BYTES:
                return out
            out.append((found[1], found[0], number))
    return out
