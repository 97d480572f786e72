"""Beams drawn as vertical blocks: labels at the left, a strip of values for each zone of each member.

Strips are cut where their halves have unlike zones. A strip's lines go to the rows of the template; its zone is what its own
lines say nearest the section, else what the template does. Neighbouring strips of one member are one record.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from statistics import fmean

from pyspark.sql import DataFrame

from plinth.operators import beams as B, columns as C, layout as L

#: Fields of a record that hold for the whole member, and those that each zone has.
MEMBER = ["side_bar", "width_mm", "depth_mm", "type", "material", "section"]
ZONED = ["top_bar", "bot_bar", "stirrup_bar"]
SHEET_TITLE = r"(?i)일람표.*(?:보|BEAM)|(?:보|BEAM).*일람표|보\s*일람|beam\s*schedule"


def pruned(template: C.Template) -> C.Template:
    """Without titles of the sheet and lone sizes."""
    lone = lambda t: re.fullmatch(r"\d{3,4}", re.sub(r"(?i)[\s,，]|mm$", "", t)) and 200 <= int(re.sub(r"\D", "", t)) <= 4000
    return [(y, t) for y, t in template if not re.search(SHEET_TITLE, t) and not lone(t)]


def section_y(template: C.Template) -> float | None:
    """The row at which sections stand, else the rows' mean."""
    own = next((y for y, t in template if re.search(r"(?i)section|형\s*태|단\s*면|^type$", t)), None)
    return own if own is not None else fmean(y for y, _ in template) if template else None


def band_zone(bands: Sequence[tuple[float, str]], at: float | None) -> str | None:
    """The words of a strip's lines that name its zone, nearest to ``at``; of equally near ones the last. A line that names
    several gives each; without ``at`` the topmost counts."""
    found = [(y, w) for y, text in bands for w in ([w for w in text.split() if B.zone_of(w)] or [text.strip()] * bool(B.zone_of(text)))]
    if not found:
        return None
    if at is None:
        return min(found, key=lambda p: (-p[0], p[1]))[1]
    near = min(abs(y - at) for y, _ in found)
    return [w for y, w in found if abs(y - at) <= near + 1e-6][-1]


def zone_columns(strips: Sequence[L.Row], template: C.Template, tolerance: float, passes: int = 8) -> list[L.Row]:
    """Strips cut at their widest gap, if that is wide enough, leaves enough on either side, and the sides name unlike
    zones; again until nothing changes, ``passes`` times at most."""
    least, wide, at, out = max(3, len(template) // 3), max(120.0, 15 * tolerance), section_y(template), [list(s) for s in strips]
    for _ in range(passes if template else 0):
        cut: list[L.Row] = []
        for strip in out:
            row = sorted(strip, key=lambda i: i.x)
            gap, k = max(((b.x - a.x, -n) for n, (a, b) in enumerate(zip(row, row[1:]), 1)), default=(0.0, 0))
            sides = [row[:-k], row[-k:]] if gap >= wide else []
            zones = [band_zone(L.y_bands(s, tolerance), at) for s in sides if len(s) >= least]
            split = len(zones) == 2 and all(zones) and zones[0].upper() != zones[1].upper()
            cut += sides if split else [strip]
        if len(cut) == len(out):
            break
        out = cut
    return out


def zone_record(template: C.Template, cells: Sequence[str], zone: str | None) -> dict:
    """A strip's part of a member: bars under its zone's names (all of them for ``all``, int and ext for ``both``), sizes and
    the name without its dimensions."""
    out: dict = {}
    for (_, label), text in zip(template, cells):
        kind, text = B.row_kind(label), text.strip()
        if not text or not kind:
            continue
        if kind == "name":
            size = B.MARK_SIZE.match(text)
            fits = size and all(200 <= int(size[k]) <= 4000 for k in (2, 3))
            out |= {"name": size[1].strip() if fits else text} | ({"width_mm": size[2], "depth_mm": size[3]} if fits else {})
        elif kind in ZONED:
            out |= {f"{z}_{kind}": text for z in B.zones_of(zone)}
        elif kind in MEMBER:
            out.setdefault(kind, text)
    return out


def member_runs(parts: Sequence[tuple[float, dict]]) -> list[list[dict]]:
    """Parts from left to right, in runs of one member: a part without a name is that before's, one whose name differs
    (case and white space don't count) begins the next."""
    out: list[list[dict]] = []
    last = None
    for _, part in sorted(parts, key=lambda p: p[0]):
        own = re.sub(r"[\s　]+", "", part.get("name", "")).upper() or last
        if not out or own != last:
            out.append([])
        out[-1].append(part)
        last = own
    return out


def joined(parts: Sequence[dict]) -> dict:
    """One record of a member's parts: of each field the first that says something."""
    out: dict = {}
    for part in parts:
        for k, v in part.items():
            if v and not out.get(k):
                out[k] = v
    return out


def vertical_records(items: Sequence[L.Item], tolerance: float = 4.0, gap: float | None = None) -> list[dict]:
    """A sheet's members, segment by segment from the top and from left to right. Without a template of two rows there are
    none; a record without a name, bars or a width isn't one."""
    labels, values, _ = C.label_split(items)
    labels, values = C.demoted(labels, values)
    template = pruned(C.template_of(labels, tolerance))
    if len(template) < 2 or not values:
        return []
    strips, _ = L.merged_strips(L.gap_strips(values, gap) if gap else L.member_strips(values))
    strips, segments, out = zone_columns(strips, template, tolerance), L.template_segments(template, tolerance), []
    bands = [L.y_bands(s, tolerance) for s in strips]
    found = [C.mapped(b, template, tolerance, beams=True) for b in bands]
    for rows in segments:
        own = [template[i] for i in rows]
        low, high = (f(y for y, _ in own) for f in (min, max))
        said = next((z for _, t in own if (z := B.zone_of(t)) and not B.row_kind(t)), None)
        parts = []
        for strip, lines, cells in zip(strips, bands, found):
            texts = [cells.get(i, "") for i in rows]
            near = [(y, t) for y, t in lines if low - 12 * tolerance <= y <= high + 12 * tolerance]
            if any(texts):
                zone = band_zone(near, section_y(own))
                parts.append((L.mean_x(strip), zone_record(own, texts, B.zone_of(zone) if zone else said) | {"cells": texts}))
        for run in member_runs(parts):
            r = joined([{k: v for k, v in p.items() if k != "cells"} for p in run])
            if r.get("name") or r.get("width_mm") or any(k.endswith("_bar") for k in r):
                out.append(r | {"cells": [" ".join(t for t in texts if t) for texts in zip(*(p["cells"] for p in run))], "row_y_mean": round(fmean(y for y, _ in own), 4)})
    return out


def vertical_schedule(texts: DataFrame, tolerance: float = 4.0, gap: float | None = None) -> DataFrame:
    """R12 for each drawing, with the fields of ``beams.beam_schedule``."""

    def kernel(items: list[L.Item]) -> list[dict]:
        return [r | {k: L.two_tiers(v) for k, v in r.items() if isinstance(v, str) and k.endswith("_bar")} | {"beam_layout": "vertical_blocks", "mark": r.get("name", "")} for r in vertical_records(items, tolerance, gap)]

    return L.per_drawing(texts, kernel, B.SCHEMA, B.FIELDS)
