"""A scan of ASCII DXF drawings: one pass over each file, a row for each entity, block, insert, attribute and layer.

The file is a list of tags (a group code and a value). Records are cut at code 0; polylines take their vertices, inserts
their attributes. Blocks are expanded where they are inserted: matrices are composed on the way down, entities on layer 0
take the insert's layer and by-block colours its colour, grids of inserts are repeated, and a block within itself is left
out. One drawing is one task's work; many drawings are many.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plinth.session import ship

Point = tuple[float, float]
Matrix = tuple[float, float, float, float, float, float]  # x' = a x + c y + e, y' = b x + d y + f
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
DEPTH = 20
BY_LAYER, BY_BLOCK = 256, 0
#: Attachment points of MTEXT as (horizontal, vertical) alignment.
ATTACHMENT = {1: (0, 3), 2: (1, 3), 3: (2, 3), 4: (0, 2), 5: (1, 2), 6: (2, 2), 7: (0, 1), 8: (1, 1), 9: (2, 1)}
PARAGRAPH_ALIGN = {"l": "left", "c": "center", "r": "right", "j": "justify", "d": "distributed"}


@dataclass
class Record:
    kind: str
    tags: list[tuple[int, str]]
    parts: list[Record] = field(default_factory=list)

    def text(self, code: int, default: str | None = None) -> str | None:
        return next((v for c, v in self.tags if c == code), default)

    def number(self, code: int, default: float | None = None) -> float | None:
        try:
            return float(self.text(code))
        except (TypeError, ValueError):
            return default

    def whole(self, code: int, default: int | None = None) -> int | None:
        value = self.number(code)
        return default if value is None else int(value)

    def point(self, code: int) -> Point | None:
        x, y = self.number(code), self.number(code + 10)
        return None if x is None or y is None else (x, y)

    def points(self, code: int) -> list[Point]:
        out: list[Point] = []
        x = None
        for c, v in self.tags:
            if c == code:
                x = float(v)
            elif c == code + 10 and x is not None:
                out.append((x, float(v)))
                x = None
        return out


def decoded(content: bytes) -> str:
    """UTF-8, else the Korean code page, else with replacement signs."""
    for encoding in ("utf-8-sig", "cp949"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


#: What a record's kind looks like: letters, digits and underscores, not digits alone.
KIND = re.compile(r"(?=.*[A-Za-z])[A-Za-z0-9_]+")


def records(text: str) -> tuple[list[Record], int]:
    """Records of a text drawing, and how many lines were left out. A line that should be a group code and isn't one, or a record
    without a kind, breaks the pairs; reading goes on at the next record that begins (a line 0, and a kind after it). What the
    broken record had before stays."""
    lines = text.splitlines()
    out: list[Record] = []
    i, left = 0, 0
    while i + 1 < len(lines):
        raw, value = lines[i].strip(), lines[i + 1].rstrip("\r")
        code = int(raw) if re.fullmatch(r"-?\d{1,4}", raw, re.ASCII) else None
        if code is None or not -5 <= code <= 1071 or code == 0 and not KIND.fullmatch(value.strip()):
            after = next((k for k in range(i + 1, len(lines) - 1) if lines[k].strip() == "0" and KIND.fullmatch(lines[k + 1].strip())), len(lines))
            left, i = left + after - i, after
            continue
        if code == 0:
            out.append(Record(value.strip().upper(), []))
        elif out:
            out[-1].tags.append((code, value))
        i += 2
    return out, left + sum(bool(x.strip()) for x in lines[i:])


BINARY = b"AutoCAD Binary DXF\r\n\x1a\x00"
#: Ranges of group codes and how a binary file writes their values.
VALUES = [
    (0, 9, "text"), (10, 59, "<d"), (60, 79, "<h"), (90, 99, "<i"), (100, 109, "text"), (110, 149, "<d"), (160, 169, "<q"), (170, 179, "<h"), (210, 239, "<d"), (270, 289, "<h"), (290, 299, "<b"),
    (300, 309, "text"), (310, 319, "chunk"), (320, 369, "text"), (370, 389, "<h"), (390, 399, "text"), (400, 409, "<h"), (410, 419, "text"), (420, 429, "<i"), (430, 439, "text"), (440, 459, "<i"), (460, 469, "<d"),
    (470, 481, "text"), (999, 1003, "text"), (1004, 1004, "chunk"), (1005, 1009, "text"), (1010, 1059, "<d"), (1060, 1070, "<h"), (1071, 1071, "<i"),
]


def binary_records(content: bytes) -> tuple[list[Record], int]:
    """Records of a binary drawing, and how many bytes were left out. Its group codes are of two bytes, or of one where the first pair
    tells so. After a code that no range holds, or a value that is cut off, reading goes on at the next code 0 with a kind."""
    at, out, left = len(BINARY), [], 0
    wide = content[at : at + 2] == b"\0\0"  # the first code is 0, and its text isn't empty
    fresh = re.compile((rb"\0\0" if wide else rb"\0") + rb"(?=[0-9]?[A-Z_][A-Z0-9_]+\0)")
    while at < len(content):
        begin = at
        if wide:
            code = int.from_bytes(content[at : at + 2], "little")
            at += 2
        elif content[at] == 255:
            code = int.from_bytes(content[at + 1 : at + 3], "little")
            at += 3
        else:
            code, at = content[at], at + 1
        kind = next((k for low, high, k in VALUES if low <= code <= high), None)
        if kind == "text":
            end = content.find(b"\0", at)
            value, at, kind = (decoded(content[at:end]), end + 1, kind) if end >= 0 else ("", at, None)
        elif kind == "chunk" and at < len(content):
            size = content[at]
            value, at = content[at + 1 : at + 1 + size].hex().upper(), at + 1 + size
        elif kind and kind != "chunk" and at + struct.calcsize(kind) <= len(content):
            value, at = str(struct.unpack_from(kind, content, at)[0]), at + struct.calcsize(kind)
        else:
            kind = None
        if kind is None or code == 0 and not KIND.fullmatch(value.strip()):
            found = fresh.search(content, begin + 1)
            at = found.start() if found else len(content)
            left += at - begin
            continue
        if code == 0:
            out.append(Record(value.strip().upper(), []))
        elif out:
            out[-1].tags.append((code, value))
    return out, left


@dataclass
class Drawing:
    layers: dict[str, Record] = field(default_factory=dict)
    blocks: dict[str, tuple[Record, list[Record]]] = field(default_factory=dict)
    entities: list[Record] = field(default_factory=list)
    #: Lines of a text drawing, or bytes of a binary one, that were left out, as they couldn't be read.
    left: int = 0

    @classmethod
    def parse(cls, content: bytes) -> Drawing:
        section, block, holder = None, None, None
        found, left = binary_records(content) if content.startswith(BINARY) else records(decoded(content))
        out = cls(left=left)
        for r in found:
            if r.kind == "SECTION":
                section = (r.text(2) or "").upper()
            elif r.kind == "ENDSEC":
                section = None
            elif section == "TABLES" and r.kind == "LAYER":
                out.layers[r.text(2, "0")] = r
            elif section == "BLOCKS" and r.kind == "BLOCK":
                block = (r, [])
                out.blocks.setdefault(r.text(2, ""), block)
            elif r.kind == "ENDBLK":
                block = holder = None
            elif section in ("BLOCKS", "ENTITIES"):
                if r.kind == "SEQEND":
                    holder = None
                elif holder is not None and r.kind in ("VERTEX", "ATTRIB"):
                    holder.parts.append(r)
                else:
                    target = out.entities if section == "ENTITIES" else block[1] if block else None
                    if target is not None:
                        target.append(r)
                    holder = r if r.kind == "POLYLINE" or r.kind == "INSERT" and r.whole(66, 0) else None
        return out

    def layer_on(self, name: str) -> bool:
        """An unknown layer counts as on; a negative colour switches a layer off, flag 1 freezes it."""
        layer = self.layers.get(name)
        return layer is None or (layer.number(62, 7) or 0) >= 0 and not (layer.whole(70, 0) or 0) & 1

    def layer_color(self, name: str) -> int | None:
        """The true colour if it isn't 0, else the absolute colour of 1..255, 7 for 256."""
        layer = self.layers.get(name)
        if layer is None:
            return None
        true, plain = layer.whole(420, 0), abs(layer.whole(62, 7) or 0)
        return true or (plain if 1 <= plain <= 255 else 7 if plain == 256 else None)


def bulged(a: Point, b: Point, bulge: float) -> list[Point]:
    """Points after ``a`` up to ``b`` along the arc of a bulge (the tangent of a quarter of its angle)."""
    chord = math.dist(a, b)
    if abs(bulge) < 1e-12 or chord < 1e-12:
        return [b]
    angle = 4 * math.atan(bulge)
    radius = chord / (2 * math.sin(angle / 2))
    middle = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    height = radius * math.cos(angle / 2)
    center = (middle[0] - height * (b[1] - a[1]) / chord, middle[1] + height * (b[0] - a[0]) / chord)
    start = math.atan2(a[1] - center[1], a[0] - center[0])
    n = min(256, max(8, math.ceil(math.degrees(abs(angle)) / 12)))
    return [(center[0] + abs(radius) * math.cos(start + angle * i / n), center[1] + abs(radius) * math.sin(start + angle * i / n)) for i in range(1, n)] + [b]


def vertices(record: Record) -> tuple[list[tuple[Point, float]], bool]:
    """(point, bulge) of a polyline, and whether it's closed."""
    if record.kind == "POLYLINE":
        own = [(p, v.number(42, 0.0)) for v in record.parts if not (v.whole(70, 0) or 0) & 128 and (p := v.point(10))]
        return own, bool((record.whole(70, 0) or 0) & 1)
    own, x = [], None
    for code, value in record.tags:
        if code == 10:
            x = float(value)
        elif code == 20 and x is not None:
            own.append(((x, float(value)), 0.0))
            x = None
        elif code == 42 and own:
            own[-1] = (own[-1][0], float(value))
    return own, bool((record.whole(70, 0) or 0) & 1)


def outline(record: Record) -> list[Point]:
    own, closed = vertices(record)
    if not own:
        return []
    pairs = list(zip(own, own[1:])) + ([(own[-1], own[0])] if closed and own[0][0] != own[-1][0] else [])
    out = [own[0][0]]
    for (a, bulge), (b, _) in pairs:
        out += bulged(a, b, bulge)
    return out


def round_points(center: Point, radius: float, start: float, span: float, n: int) -> list[Point]:
    return [(center[0] + radius * math.cos(math.radians(start + span * i / n)), center[1] + radius * math.sin(math.radians(start + span * i / n))) for i in range(n + 1)]


def hatch_boundary(record: Record) -> list[Point]:
    """The largest boundary path of an area up to 1e12 with coordinates up to 1e9; polyline paths and line edges."""
    paths: list[list[Point]] = []
    now: list[Point] | None = None
    x = None
    for code, value in record.tags:
        if code == 92:
            now = []
            paths.append(now)
        elif code in (97, 75):
            now = None
        elif now is not None and code in (10, 11):
            x = float(value)
        elif now is not None and code in (20, 21) and x is not None:
            now.append((x, float(value)))
            x = None
    sane = [p for p in paths if len(p) >= 3 and all(abs(a) <= 1e9 and abs(b) <= 1e9 for a, b in p) and abs(area(p)) <= 1e12]
    return max(sane, key=lambda p: abs(area(p)), default=[])


def area(points: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 2 if len(points) >= 3 else 0.0


def spline(record: Record, steps: int = 8) -> list[Point]:
    """A spline's points: its fit points; else, where knots and control points agree, points of the curve, ``steps`` for each
    span of knots (de Boor's scheme, with weights); else its control points."""
    fit, control, degree = record.points(11), record.points(10), record.whole(71, 3)
    knots, weights = ([float(v) for c, v in record.tags if c == code] for code in (40, 41))
    if fit or not 1 <= degree < len(control) or len(knots) != len(control) + degree + 1:
        return fit or control
    weights = weights if len(weights) == len(control) and min(weights) > 0 else [1.0] * len(control)

    def point(t: float, k: int) -> Point:
        d = [(control[j][0] * weights[j], control[j][1] * weights[j], weights[j]) for j in range(k - degree, k + 1)]
        for r in range(1, degree + 1):
            for j in range(degree, r - 1, -1):
                low, high = knots[j + k - degree], knots[j + 1 + k - r]
                a = (t - low) / (high - low) if high > low else 0.0
                d[j] = tuple((1 - a) * p + a * q for p, q in zip(d[j - 1], d[j]))
        x, y, w = d[degree]
        return x / w, y / w

    out: list[Point] = []
    for k in range(degree, len(control)):
        if knots[k + 1] > knots[k]:
            out += [point(knots[k] + (knots[k + 1] - knots[k]) * i / steps, k) for i in range(steps)]
            last = point(knots[k + 1], k)
    return [*out, last] if out else control


def wipeout(record: Record) -> list[Point]:
    """A wipeout's closed boundary: its clip path (two corners of a rectangle, or a polygon) in units of its two sides."""
    origin, u, v, clip = record.point(10), record.point(11), record.point(12), record.points(14)
    if not (origin and u and v) or len(clip) < 2:
        return []
    if len(clip) == 2:
        (a, b), (c, d) = clip
        clip = [(a, b), (c, b), (c, d), (a, d)]
    ring = [(origin[0] + u[0] * (x + 0.5) + v[0] * (0.5 - y), origin[1] + u[1] * (x + 0.5) + v[1] * (0.5 - y)) for x, y in clip]
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


def geometry(record: Record) -> list[Point]:
    """Points of an entity in its own coordinates; none for what has no geometry."""
    kind = record.kind
    if kind == "LINE":
        return [p for p in (record.point(10), record.point(11)) if p]
    if kind in ("LWPOLYLINE", "POLYLINE"):
        return outline(record)
    if kind in ("CIRCLE", "ARC"):
        center, radius = record.point(10), record.number(40, 0.0)
        if not center or radius <= 0:
            return []
        if kind == "CIRCLE":
            return round_points(center, radius, 0.0, 360.0, 32)
        start = record.number(50, 0.0) % 360
        span = record.number(51, 360.0) % 360 - start
        span = span + 360 if span <= 0 else span
        return round_points(center, radius, start, span, min(256, max(8, math.ceil(span / 12))))
    if kind == "ELLIPSE":
        center, major, ratio = record.point(10), record.point(11), record.number(40, 1.0)
        if not center or not major:
            return []
        a, b = record.number(41, 0.0), record.number(42, 2 * math.pi)
        b = b + 2 * math.pi if b <= a else b
        return [(center[0] + major[0] * math.cos(t) - major[1] * ratio * math.sin(t), center[1] + major[1] * math.cos(t) + major[0] * ratio * math.sin(t)) for t in (a + (b - a) * i / 32 for i in range(33))]
    if kind == "SPLINE":
        return spline(record)
    if kind == "WIPEOUT":
        return wipeout(record)
    if kind in ("SOLID", "3DFACE"):
        p = [q for q in map(record.point, (10, 11, 12, 13)) if q]
        if kind == "SOLID" and len(p) == 4:
            p[2], p[3] = p[3], p[2]  # a solid's corners go zigzag
        return [*p, p[0]] if len(p) >= 3 else p
    if kind == "HATCH":
        p = hatch_boundary(record)
        return [*p, p[0]] if p and p[0] != p[-1] else p
    if kind in ("TEXT", "MTEXT", "ATTRIB", "POINT"):
        p = record.point(10)
        if kind != "MTEXT" and kind != "POINT" and record.point(11) and (record.whole(72, 0) or record.whole(74 if kind == "ATTRIB" else 73, 0)):
            p = record.point(11)
        return [p] if p else []
    return []


def raw_text(record: Record) -> str:
    return "".join(v for c, v in record.tags if c == 3) + (record.text(1) or "") if record.kind == "MTEXT" else record.text(1) or ""


def plain_text(raw: str, kind: str) -> str:
    """Without formatting codes; paragraphs are lines."""
    if kind == "MTEXT":
        raw = re.sub(r"\\S([^;]*?)[\^#/]([^;]*?);", r"\1/\2", raw)
        raw = re.sub(r"\\[PX]", "\n", raw)
        raw = re.sub(r"\\[ACFHQTWfp][^;\\{}]*;", "", raw)
        raw = re.sub(r"\\[LlOoKk]", "", raw).replace("\\~", " ")
        raw = re.sub(r"(?<!\\)[{}]", "", raw)
        raw = re.sub(r"\\([\\{}])", r"\1", raw)
    raw = re.sub(r"(?i)%%[ou]", "", raw)
    return re.sub(r"(?i)%%d", "°", re.sub(r"(?i)%%c", "⌀", re.sub(r"(?i)%%p", "±", raw)))


def paragraph_aligns(raw: str) -> list[str]:
    """Horizontal alignment of each paragraph of an MTEXT; one holds until the next is set."""
    out, now = [], "left"
    for part in re.split(r"\\P", raw):
        for letter in re.findall(r"\\p[^;]*?q([lcrjd])[^;]*;", part):
            now = PARAGRAPH_ALIGN[letter]
        out.append(now)
    return out


def composed(outer: Matrix, inner: Matrix) -> Matrix:
    a, b, c, d, e, f = outer
    p, q, r, s, t, u = inner
    return a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f


def applied(m: Matrix, p: Point) -> Point:
    return m[0] * p[0] + m[2] * p[1] + m[4], m[1] * p[0] + m[3] * p[1] + m[5]


def insert_matrices(insert: Record, base: Point) -> Iterator[Matrix]:
    """Insertion times rotation times scale times minus base, for each cell of the insert's grid."""
    x, y = insert.point(10) or (0.0, 0.0)
    sx, sy, angle = insert.number(41, 1.0) or 1.0, insert.number(42, 1.0) or 1.0, math.radians(insert.number(50, 0.0))
    cos, sin = math.cos(angle), math.sin(angle)
    for row in range(max(1, insert.whole(71, 1) or 1)):
        for column in range(max(1, insert.whole(70, 1) or 1)):
            dx, dy = column * (insert.number(44, 0.0) or 0.0), row * (insert.number(45, 0.0) or 0.0)
            at = (x + dx * cos - dy * sin, y + dx * sin + dy * cos)
            turn: Matrix = (cos * sx, sin * sx, -sin * sy, cos * sy, *at)
            yield composed(turn, (1.0, 0.0, 0.0, 1.0, -base[0], -base[1]))


def props_of(record: Record, matrix: Matrix) -> dict[str, str]:
    """What else is known of an entity, as text."""
    out = {"dxftype": record.kind}
    plain = {6: "linetype", 370: "lineweight", 62: "color_raw", 420: "true_color"}
    if record.kind in ("TEXT", "ATTRIB", "MTEXT"):
        raw = raw_text(record)
        out["text"] = plain_text(raw, record.kind)
        out["height" if record.kind != "MTEXT" else "char_height"] = str(record.number(40, 0.0))
        if (p := record.point(10)) is not None:
            out["insert_x"], out["insert_y"] = (str(v) for v in applied(matrix, p))
        turn = math.degrees(math.atan2(matrix[1], matrix[0]))
        angle = record.number(50)
        if record.kind == "MTEXT":
            attach = record.whole(71, 1)
            out["attachment_point"] = str(attach)
            out["halign"], out["valign"] = map(str, ATTACHMENT.get(attach, (0, 3)))
            out["mtext_line_aligns"] = ",".join(paragraph_aligns(raw))
            if (record.number(41) or 0) > 0:
                out["mtext_width"] = str(record.number(41))
            if angle is None and (d := record.point(11)):
                angle = math.degrees(math.atan2(d[1], d[0]))
        else:
            out["halign"], out["valign"] = str(record.whole(72, 0)), str(record.whole(74 if record.kind == "ATTRIB" else 73, 0))
            plain |= {41: "width_factor", 51: "oblique", 7: "style_name"}
        if angle is not None or turn:
            out["rotation"] = str((angle or 0.0) + turn)
    if record.kind in ("CIRCLE", "ARC"):
        out["radius"] = str(record.number(40, 0.0) * math.hypot(matrix[0], matrix[1]))
    if record.kind == "HATCH":
        plain |= {2: "pattern_name", 70: "solid_fill"}
    for code, name in plain.items():
        if (value := record.text(code)) is not None:
            out[name] = value.strip()
    return out


#: What the scan reads as entities.
SUPPORTED = {"LINE", "LWPOLYLINE", "POLYLINE", "ARC", "CIRCLE", "ELLIPSE", "SPLINE", "3DFACE", "SOLID", "TEXT", "MTEXT", "POINT", "HATCH", "WIPEOUT"}
#: Members of a block that are rows; of larger blocks the number alone is.
MOST_MEMBERS = 5000

NAMES = ["row_kind", "seq", "entity_type", "layer", "color", "points", "cx", "cy", "minx", "miny", "maxx", "maxy", "props", "block_name", "insert_key", "block_path", "x", "y", "rotation", "scale_x", "scale_y", "tag", "value", "n"]
SCHEMA = (
    "row_kind string, seq bigint, entity_type string, layer string, color int, points array<struct<x:double,y:double>>, cx double, cy double, minx double, miny double, maxx double, maxy double, "
    "props map<string,string>, block_name string, insert_key bigint, block_path string, x double, y double, rotation double, scale_x double, scale_y double, tag string, value string, n bigint"
)


def centroid(points: list[Point]) -> Point:
    """Weighted by the length of segments; the first point where there is none."""
    x = y = total = 0.0
    for a, b in zip(points, points[1:]):
        d = math.dist(a, b)
        x, y, total = x + d * (a[0] + b[0]) / 2, y + d * (a[1] + b[1]) / 2, total + d
    return (x / total, y / total) if total else points[0]


class Scanner:
    """Rows of one drawing."""

    def __init__(self, drawing: Drawing, skip_off_layers: bool):
        self.drawing, self.skip, self.seq = drawing, skip_off_layers, 0

    def row(self, kind: str, **values) -> dict:
        self.seq += 1
        return {"row_kind": kind, "seq": self.seq, **values}

    def color(self, record: Record, inherited: int | None) -> int:
        """V6: by-block colours are the insert's; 256 stays."""
        own = record.whole(62, BY_LAYER)
        return (7 if inherited is None else inherited) if own == BY_BLOCK and inherited is not None else own

    def entity(self, record: Record, matrix: Matrix, layer: str, color: int, key: int | None, path: str | None) -> Iterator[dict]:
        points = [applied(matrix, p) for p in geometry(record)]
        if not points:
            return
        c = centroid(points)
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        yield self.row(
            "entity", entity_type=record.kind, layer=layer, color=color, points=[{"x": a, "y": b} for a, b in points], cx=c[0], cy=c[1],
            minx=min(xs), miny=min(ys), maxx=max(xs), maxy=max(ys), props=props_of(record, matrix), insert_key=key, block_path=path,
        )

    def expanded(self, insert: Record, matrix: Matrix, layer: str, color: int, key: int, path: str, open_: frozenset[str]) -> Iterator[dict]:
        """A block's entities, and those of the blocks within."""
        name = insert.text(2, "")
        if name not in self.drawing.blocks or name in open_ or len(open_) >= DEPTH:
            return
        head, members = self.drawing.blocks[name]
        for cell, own in enumerate(insert_matrices(insert, head.point(10) or (0.0, 0.0))):
            here, place = composed(matrix, own), f"{path}/{name}@{cell}"
            for record in members:
                if record.whole(60, 0):
                    continue
                inner = record.text(8, "0")
                inner = layer if inner == "0" else inner
                if self.skip and not self.drawing.layer_on(inner):
                    continue
                tone = self.color(record, color)
                if record.kind == "INSERT":
                    yield from self.expanded(record, here, inner, tone, key, place, open_ | {name})
                elif record.kind in SUPPORTED:
                    yield from self.entity(record, here, inner, tone, key, place)

    def dimension(self, record: Record, layer: str, color: int) -> Iterator[dict]:
        """A dimension is the entities of its anonymous block, marked; without one, a line between its points."""
        block = self.drawing.blocks.get(record.text(2, ""))
        rows: list[dict] = []
        for part in block[1] if block else []:
            if part.kind in SUPPORTED and not part.whole(60, 0):
                rows += self.entity(part, IDENTITY, part.text(8) or layer, self.color(part, color), None, None)
        if not rows and (ends := [p for p in (record.point(13), record.point(14)) if p]):
            line = Record("LINE", [(10, str(ends[0][0])), (20, str(ends[0][1])), (11, str(ends[-1][0])), (21, str(ends[-1][1]))])
            rows += self.entity(line, IDENTITY, layer, color, None, None)
        for r in rows:
            r["props"]["from_dimension"] = "true"
        yield from rows

    def rows(self) -> Iterator[dict]:
        drawing, skipped, faulty, key, wanted = self.drawing, {}, {}, 0, set()

        def sound(record: Record, made: Iterator[dict]) -> Iterator[dict]:
            """The rows of a record, up to a value that can't be read."""
            try:
                yield from made
            except (ValueError, ZeroDivisionError, OverflowError):
                faulty[record.kind] = faulty.get(record.kind, 0) + 1

        for name in drawing.layers:
            yield self.row("layer", layer=name, color=drawing.layer_color(name), value="on" if drawing.layer_on(name) else "off")
        for record in drawing.entities:
            if record.whole(60, 0):
                continue
            layer = record.text(8, "0")
            if self.skip and not drawing.layer_on(layer):
                continue
            color = self.color(record, None)
            if record.kind == "DIMENSION":
                yield from sound(record, self.dimension(record, layer, color))
            elif record.kind == "INSERT":
                key += 1
                name = record.text(2, "")
                wanted.add(name)
                x, y = record.point(10) or (0.0, 0.0)
                yield self.row("insert", layer=layer, color=color, block_name=name, insert_key=key, x=x, y=y, rotation=record.number(50, 0.0), scale_x=record.number(41, 1.0) or 1.0, scale_y=record.number(42, 1.0) or 1.0, props=props_of(record, IDENTITY))
                for attribute in record.parts:
                    yield self.row("attribute", insert_key=key, tag=attribute.text(2, ""), value=attribute.text(1, ""))
                yield from sound(record, self.expanded(record, IDENTITY, layer, color, key, f"#{key}", frozenset()))
            elif record.kind in SUPPORTED:
                yield from sound(record, self.entity(record, IDENTITY, layer, color, None, None))
            else:
                skipped[record.kind] = skipped.get(record.kind, 0) + 1
        for name in sorted(self.reachable(wanted) | wanted):
            head, members = drawing.blocks.get(name, (None, []))
            x, y = (head.point(10) if head else None) or (0.0, 0.0)
            yield self.row("block", block_name=name, x=x, y=y, n=len(members))
            for record in members if len(members) <= MOST_MEMBERS else ():
                if record.kind in SUPPORTED:
                    for r in sound(record, self.entity(record, IDENTITY, record.text(8, "0"), self.color(record, None), None, None)):
                        yield r | {"row_kind": "member", "block_name": name}
        for kind, n in sorted(skipped.items()):
            yield self.row("skipped", entity_type=kind, n=n)
        for kind, n in sorted(faulty.items()):
            yield self.row("faulty", entity_type=kind, n=n)
        if drawing.left:
            yield self.row("left", n=drawing.left)

    def reachable(self, names: set[str]) -> set[str]:
        """Blocks that inserts lead to, at any depth."""
        seen, todo = set(), [n for n in names if n in self.drawing.blocks]
        while todo:
            name = todo.pop()
            if name not in seen:
                seen.add(name)
                todo += [r.text(2, "") for r in self.drawing.blocks[name][1] if r.kind == "INSERT" and r.text(2, "") in self.drawing.blocks]
        return seen


def scan(files: DataFrame, skip_off_layers: bool = False) -> DataFrame:
    """Rows of all drawings in ``files`` (path, content), told apart by ``row_kind``: layer, entity, insert, attribute,
    block, member (of a block, in its own coordinates), skipped (records of other types), faulty (records with values that can't be
    read, by type), and left (lines or bytes that are no tags). So a damaged file gives what is sound in it; one from which nothing can
    be read gives one row of kind ``error``."""
    ship(files.sparkSession)
    kinds = arrow_schema()

    def kernel(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from batches(path, content or b"", skip_off_layers, kinds)

    return files.select("path", "content").mapInArrow(kernel, f"path string, {SCHEMA}")


def batches(path: str, content: bytes, skip_off_layers: bool, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A drawing's rows, 5,000 at a time."""
    rows: list[dict] = []
    try:
        for row in Scanner(Drawing.parse(content), skip_off_layers).rows():
            rows.append({"path": path, **row})
            if len(rows) >= 5000:
                yield _batch(rows, kinds)
                rows = []
    except (ValueError, KeyError, RecursionError) as error:
        rows.append({"path": path, "row_kind": "error", "seq": 0, "value": str(error)})
    if rows:
        yield _batch(rows, kinds)


def arrow_schema() -> pa.Schema:
    """The rows' columns, after the path of their file."""
    return pa.schema([("path", pa.string()), *((f.name, f.type) for f in _arrow_schema())])


def _arrow_schema() -> pa.Schema:
    number, text = pa.float64(), pa.string()
    point = pa.list_(pa.struct([("x", number), ("y", number)]))
    kinds = {"seq": pa.int64(), "color": pa.int32(), "points": point, "props": pa.map_(text, text), "insert_key": pa.int64(), "n": pa.int64()}
    numbers = {"cx", "cy", "minx", "miny", "maxx", "maxy", "x", "y", "rotation", "scale_x", "scale_y"}
    return pa.schema([(n, kinds.get(n, number if n in numbers else text)) for n in NAMES])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    def column(f: pa.Field) -> pa.Array:
        values = [r.get(f.name) for r in rows]
        if f.name == "props":
            values = [None if v is None else list(v.items()) for v in values]
        return pa.array(values, f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def read(spark: SparkSession, path: str, skip_off_layers: bool = False) -> DataFrame:
    """All DXF files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dxf").option("recursiveFileLookup", "true").load(path)
    return scan(files, skip_off_layers)
