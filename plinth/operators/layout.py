"""Layout of a sheet: texts to rows, strips, header columns and zones. Kernels work on the items of one drawing, which
``per_drawing`` gathers and hands over; a drawing's texts are bounded by what a sheet can hold.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Sequence
from functools import lru_cache
from statistics import fmean, median
from typing import NamedTuple

import pyarrow as pa
import re
from pyspark.sql import DataFrame

from plinth.functions import patterns as P
from plinth.session import ship


class Item(NamedTuple):
    x: float
    y: float
    text: str
    id: int | None = None


Row = list[Item]


def java(pattern: str) -> re.Pattern[str]:
    """A pattern of ``patterns`` for Python."""
    return re.compile(pattern.removeprefix("(?i)"), re.I if pattern.startswith("(?i)") else 0)


MARK, ALL_SPACES = java(P.BEAM_MARK), re.compile(r"\s+")


def mean_y(row: Row) -> float:
    return fmean(i.y for i in row) if row else 0.0


def mean_x(row: Row) -> float:
    return fmean(i.x for i in row)


def leader_rows(items: Sequence[Item], tolerance: float) -> list[Row]:
    """Rows from the top down; each takes what is at most the tolerance below its first item, and is sorted by x."""
    out: list[Row] = []
    for item in sorted(items, key=lambda i: (-i.y, i.x)):
        if out and abs(item.y - out[-1][0].y) <= tolerance:
            out[-1].append(item)
        else:
            out.append([item])
    return [sorted(r, key=lambda i: i.x) for r in out]


@lru_cache(1 << 16)
def word(text: str) -> str:
    """A text in NFKC, single-spaced."""
    return ALL_SPACES.sub(" ", unicodedata.normalize("NFKC", text)).strip()


def words(row: Row) -> list[str]:
    """A row's texts, without empty ones."""
    return [t for i in row if (t := word(i.text))]


def has_header(row: Row) -> bool:
    return any(ALL_SPACES.sub("", t) in P.BEAM_HEADER_TOKENS for t in words(row))


def is_header(row: Row) -> bool:
    own = words(row)
    return bool(own) and all(ALL_SPACES.sub("", t) in P.BEAM_HEADER_TOKENS for t in own)


def has_mark(row: Row) -> bool:
    return any(MARK.match(t) for t in words(row))


def joined_rows(rows: Sequence[Row], tolerance: float, gap: float | None = None, glue: int = 4, most: int = 512) -> list[Row]:
    """Thin rows join the row above them: up to ``glue`` items, up to ``most`` together, means within the gap (3.5
    tolerances, 10 at least). A row with a header and one with a mark never join."""
    gap = gap if gap and gap > 0 else max(3.5 * tolerance, 10.0)
    glue = max(1, glue)
    most = max(2 * glue, most)
    out: list[Row] = []
    headed = marked = False  # of the last row
    for row in sorted((list(r) for r in rows if r), key=mean_y, reverse=True):
        header, mark = has_header(row), has_mark(row)
        above = out[-1] if out else None
        apart = above is None or headed and mark or header and marked
        if not apart and len(row) <= glue and len(above) + len(row) <= most and abs(mean_y(above) - mean_y(row)) <= gap:
            out[-1] = sorted([*above, *row], key=lambda i: i.x)
            headed, marked = headed or header, marked or mark
        else:
            out.append(row)
            headed, marked = header, mark
    return out


def bridged_rows(rows: Sequence[Row], gap: float, ends: int = 4, between: int = 1, most: int = 512, passes: int = 1, mark_gap: float | None = None) -> list[Row]:
    """The two nearest rows of up to ``ends`` items join if no row of more than ``between`` items lies strictly between
    them; rows with headers don't, and rows with marks may be ``mark_gap`` apart."""
    out = sorted((list(r) for r in rows if r), key=mean_y, reverse=True)
    gap = gap if gap > 0 else 10.0
    mark_gap = mark_gap if mark_gap and mark_gap > 0 else gap
    ends, most = max(2, ends), max(16, most)
    for _ in range(max(1, passes)):
        ys, marked = [mean_y(r) for r in out], [has_mark(r) for r in out]
        fit = [i for i, r in enumerate(out) if len(r) <= ends and not has_header(r)]
        dense = sorted(y for y, r in zip(ys, out) if len(r) > max(0, between))

        def open_between(low: float, high: float) -> bool:
            at = bisect_right(dense, low)
            return high - low <= 1e-9 or at >= len(dense) or dense[at] >= high

        best = min(
            ((ys[i] - ys[j], i, j) for n, i in enumerate(fit) for j in fit[n + 1 :]
             if ys[i] - ys[j] <= (mark_gap if marked[i] and marked[j] else gap) and len(out[i]) + len(out[j]) <= most and open_between(ys[j], ys[i])),
            default=None,
        )
        if best is None:
            break
        _, i, j = best
        out[i] = sorted([*out[i], *out.pop(j)], key=lambda t: t.x)
        out.sort(key=mean_y, reverse=True)
    return out


def gap_strips(items: Sequence[Item], gap: float) -> list[Row]:
    """Chains along x."""
    out: list[Row] = []
    for item in sorted(items, key=lambda i: i.x):
        if out and item.x - out[-1][-1].x <= gap:
            out[-1].append(item)
        else:
            out.append([item])
    return out


def _gaps(xs: Sequence[float]) -> list[float]:
    return [b - a for a, b in zip(xs, xs[1:])]


def upper(values: Sequence[float], numerator: int, denominator: int) -> float:
    """The element at n * numerator // denominator of the sorted values."""
    return sorted(values)[len(values) * numerator // denominator]


def relaxed_gap(items: Sequence[Item]) -> float:
    """A gap between strips, by the median and the upper quartile of the gaps of distinct x."""
    xs = sorted({round(i.x, 2) for i in items})
    if len(xs) < 2:
        return 80.0
    gaps = _gaps(xs)
    return max(36.0, min(2.1 * median(gaps) + 0.4 * upper(gaps, 3, 4), (xs[-1] - xs[0]) / 6))


#: Of a split's threshold: least, and factors of the median gap, of the upper quartile and of the span.
SPLIT, SPLIT_HARD = (48.0, 2.75, 1.8, 0.014), (32.0, 1.55, 1.35, 0.009)


def largest_gap_groups(seeds: Sequence[Item], limits: tuple[float, float, float, float] = SPLIT) -> list[Row]:
    """Split at the largest gap for as long as it exceeds a threshold of the group's own gaps."""
    done, todo = [], [list(seeds)] if seeds else []
    while todo:
        group = todo.pop()
        gaps = _gaps([i.x for i in group])
        if gaps:
            least, by_median, by_quartile, by_span = limits
            widest = max(range(len(gaps)), key=gaps.__getitem__)
            if gaps[widest] > max(least, by_median * median(gaps), by_quartile * upper(gaps, 3, 4), by_span * (group[-1].x - group[0].x)):
                todo += [group[widest + 1 :], group[: widest + 1]]
                continue
        done.append(group)
    return done


def is_seed(text: str) -> bool:
    """3 to 96 characters, and no bare number of up to four digits."""
    t = text.strip()
    return 3 <= len(t) <= 96 and not (len(t) <= 4 and re.fullmatch(r"-?\d{2,4}", t))


def member_strips(items: Sequence[Item]) -> list[Row]:
    """Strips of members: seeds are split at large gaps, and each item goes to the strip whose centre is nearest."""
    if len(items) < 2:
        return [list(items)] if items else []
    enough = max(4, len(items) // 6)
    seeds = [i for i in items if is_seed(i.text)]
    if len(seeds) < enough:
        seeds = [i for i in items if len(i.text.strip()) <= 96]
    if len(seeds) < enough:
        seeds = list(items)
    seeds = sorted(seeds, key=lambda i: i.x)
    found = largest_gap_groups(seeds)
    if len(found) < 2 and len(seeds) >= 10:
        found = largest_gap_groups(seeds, SPLIT_HARD)
    if len(found) < 2:
        return gap_strips(items, relaxed_gap(items))
    centers = sorted(map(mean_x, found))
    cuts = [(a + b) / 2 for a, b in zip(centers, centers[1:])]
    out: list[Row] = [[] for _ in centers]
    for i in items:
        out[bisect_right(cuts, i.x)].append(i)
    return [s for s in out if s]


class StripRules(NamedTuple):
    fragment_gap: float = 880.0
    fragment_items: int = 96
    neighbor_gap: float = 980.0
    neighbor_items: int = 10
    absorb_gap: float = 1350.0
    narrow: int = 12


def merged_strips(strips: Sequence[Row], rules: StripRules = StripRules()) -> tuple[list[Row], list[str]]:
    """Three passes over strips from left to right, and a log of what joined: narrow neighbours while there are any;
    narrow ones with a neighbour that makes enough items; what is still narrow with the nearer neighbour, if that is nearer
    than a share of the usual pitch."""
    out, log = sorted((list(s) for s in strips if s), key=mean_x), []
    if len(out) < 2:
        return out, log
    narrow = lambda s: len(s) <= rules.narrow

    def swept(fits: Callable[[Row, Row], bool], kind: str) -> bool:
        result, before = [out[0]], len(log)
        for strip in out[1:]:
            if fits(result[-1], strip):
                result[-1] = result[-1] + strip
                log.append(kind)
            else:
                result.append(strip)
        out[:] = result
        return len(log) > before

    near = lambda a, b, gap: mean_x(b) - mean_x(a) <= gap
    while swept(lambda a, b: narrow(a) and narrow(b) and len(a) + len(b) <= rules.fragment_items and near(a, b, rules.fragment_gap), "fragment_pair"):
        pass
    swept(lambda a, b: (narrow(a) or narrow(b)) and len(a) + len(b) >= rules.neighbor_items and near(a, b, rules.neighbor_gap) and (max(len(a), len(b)) >= rules.neighbor_items or narrow(a) or narrow(b)), "narrow_into_neighbor")
    centers = sorted(map(mean_x, out))
    pitch = upper(_gaps(centers), 1, 2) if len(out) >= 3 else 0.0
    cap = min(rules.absorb_gap, 0.42 * pitch) if pitch > 400 else rules.absorb_gap
    i = 0
    while i < len(out):
        sides = []
        if narrow(out[i]) and len(out) > 1:
            sides = [(abs(mean_x(out[i]) - mean_x(out[j])), j > i, j) for j in (i - 1, i + 1) if 0 <= j < len(out)]
            sides = sorted(s for s in sides if s[0] <= cap)
        if not sides:
            i += 1
            continue
        _, right, j = sides[0]
        out[j] = out[i] + out[j] if right else out[j] + out[i]
        log.append("absorb_narrow_to_right" if right else "absorb_narrow_to_left")
        del out[i]
    return out, log


def y_bands(strip: Sequence[Item], tolerance: float) -> list[tuple[float, str]]:
    """(mean y, text) of a strip's lines from the top down; a line is a chain along y, its texts are read along x."""
    out: list[Row] = []
    for item in sorted(strip, key=lambda i: (-i.y, i.x)):
        if out and abs(item.y - out[-1][-1].y) <= tolerance:
            out[-1].append(item)
        else:
            out.append([item])
    lines = [(mean_y(r), collapsed(" ".join(t for i in sorted(r, key=lambda i: i.x) if (t := i.text.strip())))) for r in out]
    return sorted(lines, key=lambda line: -line[0])


def collapsed(text: str) -> str:
    """A label that stands twice in a row, once."""
    bare = ALL_SPACES.sub("", text)
    half = bare[: len(bare) // 2]
    if len(bare) < 4 or bare != half * 2:
        return text.strip()
    return {"MAINBAR": "MAIN BAR", "TIEBAR": "TIE BAR"}.get(half.upper(), half)


def is_block_start(label: str) -> bool:
    return ALL_SPACES.sub("", label).upper() in P.BLOCK_STARTS


def template_segments(rows: Sequence[tuple[float, str]], tolerance: float) -> list[list[int]]:
    """Segments of template rows (y, label) from the top down: at block starts if there are two or more, else at gaps
    beyond 2.2 upper medians, six tolerances and 20."""
    n = len(rows)
    starts = [i for i, (_, label) in enumerate(rows) if is_block_start(label)]
    if len(starts) >= 2:
        return [list(range(a, b)) for a, b in zip(starts, [*starts[1:], n])]
    gaps = [abs(a[0] - b[0]) for a, b in zip(rows, rows[1:])]
    limit = max(2.2 * upper(gaps, 1, 2), 6 * tolerance, 20.0) if gaps else 0.0
    edges = [0, *(i + 1 for i, g in enumerate(gaps) if g > limit), n]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:]) if a < b]


def segment_at(y: float, rows: Sequence[tuple[float, str]], segments: Sequence[list[int]], tolerance: float) -> int:
    """The segment that y belongs to: by the midpoints between segments that don't overlap, else the one whose padded
    range, then whose middle, is nearest."""
    spans = [(min(rows[i][0] for i in s), max(rows[i][0] for i in s)) for s in segments]
    order = sorted(range(len(spans)), key=lambda k: -spans[k][1])
    pairs = list(zip(order, order[1:]))
    if all(spans[a][0] >= spans[b][1] - 1e-6 for a, b in pairs):
        return next((a for a, b in pairs if y >= (spans[a][0] + spans[b][1]) / 2), order[-1])
    pad = max(5.5 * tolerance, 22.0)
    far = lambda k: max(spans[k][0] - pad - y, y - spans[k][1] - pad, 0.0)
    return min(range(len(spans)), key=lambda k: (round(far(k), 9), abs(y - sum(spans[k]) / 2), min(segments[k])))


# --- Beam tables -----------------------------------------------------------------------------------------------------

#: Keys of a wide beam table, in the order of its columns.
BEAM_KEYS = [
    "name", "type", "material", "width_mm", "depth_mm", "int_top_bar", "cen_top_bar", "ext_top_bar", "int_bot_bar", "cen_bot_bar", "ext_bot_bar",
    "int_stirrup_bar", "cen_stirrup_bar", "ext_stirrup_bar", "side_bar",
]
#: Words of headers. A header equals, begins or ends with one.
HEADER_WORDS = {
    "name": ["name", "부호", "기호", "부재명", "보호", "명칭"],
    "type": ["type", "종류"],
    "material": ["material", "재료", "콘크리트", "by story", "층별"],
    "width_mm": ["width", "폭", "가로", "b", "비"],
    "depth_mm": ["depth", "높이", "세로", "h", "에이치", "깊이", "단면고"],
}
ZONE_WORDS = {"int": (r"\bint\b", "인테|내부", ["int", "i", "in"]), "cen": (r"\b(cen|center|centre|mid|span)\b", "중앙|중간", ["cen", "c", "mid"]), "ext": (r"\b(ext|end)\b", "외부|단부|외단", ["ext", "e", "end"])}
BAR_WORDS = [("top_bar", "top|상부|상근"), ("bot_bar", "bot|하부|하근"), ("stirrup_bar", "stirr|스트럽|스터럽|후프|띠장")]
NARROW_WORDS = [
    ("location", "location|zone", "위치|구간"), ("top_bar", "topbar|top.*bar|bar.*top", "상부근"), ("bot_bar", "botbar|bot.*bar|bar.*bot", "하부근"), ("stirrup_bar", "stirr", "스트럽|스터럽"),
    ("width_mm", "width", "폭"), ("depth_mm", "depth", "높이|단면"), ("material", "material", "재료"), ("type", "^(?=.{0,8}$).*type", "$^"), ("side_bar", "side.*bar|bar.*side", "$^"),
]


_JOINTS = re.compile(r"[\s　_\-./－–]+")


def compact(text: str) -> str:
    return _JOINTS.sub("", text.strip().lower())


SHORT = {key: tuple(compact(a) for a in aliases) for key, aliases in HEADER_WORDS.items()}
_BARS = [(bar, re.compile(word)) for bar, word in BAR_WORDS]
_ZONES = [(zone, re.compile(word), re.compile(local)) for zone, (word, local, _) in ZONE_WORDS.items()]
_NARROW = [(key, re.compile(word), re.compile(local)) for key, word, local in NARROW_WORDS]


@lru_cache(1 << 16)
def wide_key(cell: str) -> str | None:
    """The key of a wide table's column."""
    c = compact(cell)
    if not c:
        return None
    for key, aliases in SHORT.items():
        if c.startswith(aliases) or c.endswith(aliases):
            return key
    if "side" in c and ("bar" in c or "철근" in cell):
        return "side_bar"
    bar = next((b for b, word in _BARS if word.search(c)), None)
    if not bar:
        return None  # most cells: their zones don't matter
    plain = ALL_SPACES.sub(" ", cell.lower())
    zones = [z for z, word, local in _ZONES if word.search(plain) or local.search(cell)]
    zone = zones[0] if len(zones) == 1 else next((z for z, (_, _, short) in ZONE_WORDS.items() if c in short), None)
    return f"{zone}_{bar}" if zone else None


@lru_cache(1 << 16)
def narrow_key(cell: str) -> str | None:
    """The key of a column in a table with a location column; any part of the word ``name`` is the name."""
    c = compact(cell)
    if not c:
        return None
    if c in "name" or "부호" in cell:
        return "name"
    return next((key for key, word, local in _NARROW if word.search(c) or local.search(cell)), None)


Keys = list[str | None]


def two_line_keys(above: Sequence[str], below: Sequence[str]) -> Keys | None:
    """Keys of a header of two lines: of either line where only one has one, of both read together where they differ."""
    n = max(len(above), len(below))
    cells = [(above[i] if i < len(above) else "", below[i] if i < len(below) else "") for i in range(n)]
    out: Keys = []
    for a, b in cells:
        both, one, other = wide_key(f"{a} {b}"), wide_key(a), wide_key(b)
        out.append(both if one and other and one != other else one or other or both)
    return out if sum(k is not None for k in out) >= 6 else None


def wide_header(rows: Sequence[Sequence[str]]) -> tuple[int, Keys] | None:
    """The row, or two, that reads most like a wide header: name, width and depth, and eight keys (six, on one line, if
    there is none); top bars count three more; the first of equals."""
    def score(keys: Keys, least: int) -> int:
        n = sum(k is not None for k in keys)
        fits = {"name", "width_mm", "depth_mm"} <= set(keys) and n >= least
        return n + 3 * any(k and k.endswith("top_bar") for k in keys) if fits else -1

    single = [(i, [wide_key(c) for c in r]) for i, r in enumerate(rows)]
    double = [(i, k) for i, (a, b) in enumerate(zip(rows, rows[1:])) if (k := two_line_keys(a, b))]
    ranked = [(-score(k, 8), i, n, k) for n, group in enumerate((single, double)) for i, k in group if score(k, 8) >= 0]
    ranked = ranked or [(-score(k, 6), i, 0, k) for i, k in single if score(k, 6) >= 0]
    best = min(ranked, key=lambda r: r[:3], default=None)
    return None if best is None else (best[1], best[3])


def narrow_header(rows: Sequence[Sequence[str]]) -> tuple[int, Keys] | None:
    for i, row in enumerate(rows):
        keys = [narrow_key(c) for c in row]
        if "location" in keys and {"top_bar", "name"} & set(keys) and sum(k is not None for k in keys) >= 4:
            return i, keys
    return None


def millimetres(text: str) -> int | None:
    """X28."""
    t = text.strip()
    return int(t) if re.fullmatch(r"\d{2,4}", t) and 100 <= int(t) <= 5000 else None


def wide_record(keys: Keys, cells: Sequence[str]) -> dict[str, str] | None:
    """A member of a wide table; rows without a name, or with a header's word or a bare number for one, are none."""
    out = {k: c.strip() for k, c in zip(keys, cells) if k}
    name = out.get("name", "")
    return None if not name or compact(name) in ("name", "부호", "type", "material") or re.fullmatch(r"\d{1,4}", name) else out


LOCATION_ZONES = {"_both": ["int", "ext"], "_all": ["int", "cen", "ext"]}


def location_zone(text: str) -> str | None:
    c = compact(text)
    return next((zone for word, zone in P.LOCATIONS if c.startswith(word)), None) if c else None


def located_records(keys: Keys, rows: Sequence[tuple[float, Sequence[str]]]) -> list[dict[str, str | float]]:
    """Members of a table with a location column: a name holds until another comes; each row fills its zones."""
    out: list[dict] = []
    now: dict = {"ys": []}
    has_bars = lambda r: any(r.get(k) for k in BEAM_KEYS if k not in ("name", "type", "material"))
    for y, cells in rows:
        if not any(c.strip() for c in cells):
            continue
        row = {k: c.strip() for k, c in zip(keys, cells) if k}
        name = row.get("name", "")
        if name and narrow_key(name) is None and name != now.get("name"):
            out.append(now)
            now = {"ys": [], "name": name} if now.get("name") else now | {"name": name}
            if len(out) and out[-1] is now:
                out.pop()
        zone = location_zone(row.get("location", ""))
        if zone is None:
            now.setdefault("name", name)
            continue
        now |= {k: row[k] for k in ("type", "material", "width_mm", "depth_mm", "side_bar") if row.get(k)}
        for z in LOCATION_ZONES.get(zone, [zone]):
            now |= {f"{z}_{bar}": row[bar] for bar in ("top_bar", "bot_bar", "stirrup_bar") if row.get(bar)}
        now["ys"].append(y)
    out.append(now)
    return [{k: v for k, v in r.items() if k != "ys"} | {"row_y_mean": fmean(r["ys"])} for r in out if r.get("name") and r["ys"] and has_bars(r)]


def two_tiers(text: str) -> str:
    return re.sub(java(P.TWO_TIERS), r"\1/\2-\3", text.strip())


def horizontal_records(rows: Sequence[Row]) -> tuple[list[dict], str]:
    """Members of a wide table, else of one with locations, and which it was."""
    cells, ys = [[i.text.strip() for i in r] for r in rows], [mean_y(r) for r in rows]
    if wide := wide_header(cells):
        out = [r | {"row_y_mean": ys[i], "cells": cells[i]} for i in range(wide[0] + 1, len(rows)) if (r := wide_record(wide[1], cells[i]))]
        if out:
            return out, "horizontal_wide"
    if narrow := narrow_header(cells):
        return located_records(narrow[1], list(zip(ys, cells))[narrow[0] + 1 :]), "horizontal_location_tree"
    return [], ""


# --- Driver ----------------------------------------------------------------------------------------------------------

def per_drawing(texts: DataFrame, kernel: Callable[[list[Item]], list[dict]], schema: str, fields: Sequence[str]) -> DataFrame:
    """Apply a kernel to the items of each drawing; its records become rows with the drawing's id and their number."""
    ship(texts.sparkSession)
    kind = texts.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "descending"), ("x", "ascending"), ("id", "ascending")])
        items = [Item(*r) for r in zip(*(table.column(c).to_pylist() for c in ("x", "y", "text", "id")))]
        found = kernel([i._replace(text=i.text or "") for i in items if i.x is not None and i.y is not None])
        columns = {"commit_id": [key[0].as_py()] * len(found), "row": list(range(len(found)))} | {f: [r.get(f) for r in found] for f in fields}
        return pa.Table.from_pydict({f.name: pa.array(columns[f.name], f.type) for f in arrow}, schema=arrow)

    return texts.select("commit_id", "id", "x", "y", "text").groupBy("commit_id").applyInArrow(run, schema)


STRIP_SCHEMA = "commit_id bigint, row int, x_center double, n bigint, merged bigint"


def strip_table(texts: DataFrame) -> DataFrame:
    """W7, W8 for each drawing: strips from left to right after merging."""
    def kernel(items: list[Item]) -> list[dict]:
        strips, log = merged_strips(member_strips(items))
        return [{"x_center": mean_x(s), "n": len(s), "merged": len(log)} for s in strips]

    return per_drawing(texts, kernel, STRIP_SCHEMA, ["x_center", "n", "merged"])
