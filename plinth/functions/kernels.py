"""Readings of drawing texts in plain Python, for kernels that work on a whole sheet. Column twins are in ``signals``."""

from __future__ import annotations

import re
from typing import NamedTuple

from plinth.functions import patterns as P

SPACES = re.compile(r"[\s　]+")


def java(pattern: str) -> re.Pattern[str]:
    """A pattern of ``patterns`` for Python."""
    return re.compile(pattern.removeprefix("(?i)"), re.I if pattern.startswith("(?i)") else 0)


class Member(NamedTuple):
    """What a member's name says."""

    story: str | None = None
    mark: str | None = None
    floor_range: list[str] | None = None
    trailing_mm: int | None = None


_RANGE, _OPEN, _JOINED, _APART, _TRAIL = map(java, (P.STORY_RANGE, P.STORY_OPEN, P.STORY_JOINED, P.STORY_APART, P.TRAILING_DIMENSION))
_ENGLISH, _KOREAN, _STRENGTH = map(java, (P.ENGLISH_HEADER, P.KOREAN_HEADER, P.STRENGTH))
#: Names of columns and wall columns.
COLUMN_NAME = re.compile(
    r"\s*(-?\d+\s+(?:WC\d+[A-Z]?|C\d+[A-Z0-9]*|RC\d+[A-Z]?)(\s+\d{3,4})?|-?\d+\s*C\d+[A-Z0-9]*(\s+\d{3,4})?|-?\d+[A-Z][A-Z0-9]*(\s+\d{3,4})?|-?\d+[A-Z0-9]*[~～]\S+(\s+\d{3,4})?|WC\d+[A-Z]?|RC\d+[A-Z]?|C\d+[A-Z0-9]*)\s*",
    re.I,
)
STORY_LINE = re.compile(r"\s*-?\d+\s*(?:[~～∼〜]|\s+-\s+)\s*-?\d+")


def story_text(text: str) -> str:
    return text.strip().translate(str.maketrans("−–—～〜∼", "---~~~"))


def without_dimension(text: str) -> tuple[str, int | None]:
    m = _TRAIL.match(text.strip())
    if m and 200 <= int(m[2]) <= 4000 and re.search("[A-Za-z가-힣~～]", m[1]):
        return m[1].rstrip(), int(m[2])
    return text.strip(), None


def member(text: str) -> Member:
    body, mm = without_dimension(story_text(text))
    if m := _RANGE.match(body):
        return Member(f"{m[1]}~{m[2]}", (m[3] or m[4] or "").strip() or None, [m[1], m[2]], mm)
    if m := _OPEN.match(body):
        return Member(f"~{m[1]}", (m[2] or m[3] or "").strip() or None, ["~", m[1]], mm)
    if m := _JOINED.match(body) or _APART.match(body):
        return Member(m[1], m[2].strip(), None, mm)
    return Member(trailing_mm=mm)


def collapsed(text: str) -> str:
    """X16."""
    bare = SPACES.sub("", text)
    half = bare[: len(bare) // 2]
    if len(bare) < 4 or bare != half * 2:
        return text.strip()
    return {"MAINBAR": "MAIN BAR", "TIEBAR": "TIE BAR"}.get(half.upper(), half)


def is_header(text: str) -> bool:
    """X15."""
    own = collapsed(text)
    return bool(own) and bool(_ENGLISH.match(own) or _KOREAN.match(own))


def label_key(text: str) -> str:
    """X17."""
    return SPACES.sub("", text).casefold()


def slug(label: str, index: int) -> str:
    raw = label.strip() or f"field_{index}"
    return f"{re.sub(r'[^\wㄱ-ㆎ가-힣]+', '_', raw).strip('_')[:80] or f'field_{index}'}__{index}"


def strength(text: str) -> tuple[str, str]:
    """(the rest, strength notes)."""
    notes = [m[0].strip() for m in _STRENGTH.finditer(text)]
    rest = re.sub(r"\s+", " ", _STRENGTH.sub(" ", text)).strip() if notes else text.strip()
    return rest, " ".join(notes)


def is_data(text: str) -> bool:
    """A value, not a row's label: empty, sizes, bars, strengths, ranges and marks."""
    t = text.strip()
    if not t or re.fullmatch(r"(?i)RG\d{1,3}[A-Z]{0,2}", SPACES.sub("", t)):
        return True
    if re.search(r"(?i)\d+\s*[x×]\s*\d+|D\s*\d+\s*@\s*\d+|\d+\s*-\s*(?:D|U?HD|SHD)\d+", t) or _STRENGTH.search(t):
        return True
    m = member(t)
    other = m.mark and re.match("[A-Za-z]", m.mark) and len(m.mark) <= 26 and not re.search("MAIN|HOOP|SECTION|SIZE|TIE|NAME", m.mark.upper())
    return m.floor_range is not None or bool(m.story and re.fullmatch(r"-?\d+", m.story) and other) or bool(COLUMN_NAME.fullmatch(t))


def without_callouts(text: str, mark: str) -> str:
    """X11: drawing references ``#n.Cxx`` go; of one to the mark itself, the mark stays."""
    return re.sub(r"\s+", " ", re.sub(r"#\d+\.([A-Za-z]+\d+[A-Za-z0-9]*)", lambda m: m[1] if m[1].upper() == mark.upper() else "", text)).strip()
