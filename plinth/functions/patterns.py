"""Patterns and word lists of drawing notation.

Fixed values: what counts as a bar, a size, a storey or a header is part of the results, so these are stated as they are.
Java flavour; ``(?iU)`` where letters or white space beyond ASCII matter.
"""

# Rebar, spacing, size and thickness.
BARS = r"(?i)(\d+)\s*-\s*(?:U?HD|SHD|D)\s*(\d+)"
DIAMETER = r"(?i)D\s*(\d+)"
HIGH_STRENGTH = r"(?i)(?:SHD|UHD|UH)\s*(\d+)"
SPACING = r"@\s*(\d+)"
SIZE = r"(\d+)\s*[xX]\s*(\d+)"
THICKNESS_PAREN = r"(\d+)\s*\(\s*(\d+)\s*\)"
THICKNESS_SLASH = r"(\d+)\s*/\s*(\d+)"

# Storeys.
FLOOR_RANGE = r"(?i)([A-Z]?\d+F|PH|RF|B\d+F)\s*[~～-]\s*([A-Z]?\d+F|PH|RF|B\d+F)"
FLOOR_TOKEN = r"(?i)\b(B?\d+F|PH|RF|\d+층)\b"
STORY_RANGE = r"(?i)^\s*(-?\d+)\s*(?:[~～]|(?:\s+-\s+))\s*(-?\d+)(?:\s+(.+)|([A-Za-z].*))?\s*$"
STORY_OPEN = r"(?i)^\s*[~～]\s*(-?\d+)(?:\s+(.+)|([A-Za-z].*))?\s*$"
STORY_JOINED = r"^\s*(-?\d+)([A-Za-z][A-Za-z0-9]*)\s*$"
STORY_APART = r"^\s*(-?\d+)\s+(.+?)\s*$"
TRAILING_DIMENSION = r"^(.+?)\s+(\d{3,4})\s*$"
TILDES = "~～∼〜"

# Concrete strength, callouts, marks.
STRENGTH = (
    r"(?i)(?:\b(?:fck|fcu|fc'|f'c)\s*[:=]\s*[\d.]+\s*(?:MPa|mpa|N/mm²|N/mm2|N/mm\^2|kgf/cm²|kgf/cm2)?"
    r"|\b(?:fck|fcu)\s+[\d.]+\s*(?:MPa|mpa|N/mm²|N/mm2|kgf/cm²|kgf/cm2)?)"
)
BEAM_MARK = r"(?i)^\s*[A-Z]{1,3}\s*\d{1,4}[A-Z]?\s*(?:\(.+\))?\s*$"
TWO_TIERS = r"(?i)\b(\d{1,2})\s*[-–]\s*(\d{1,2})\s*[-–]\s*(D\d+)"
MARK_SIZE = r"^(.+?)\s*\(\s*(\d{3,4})\s*[xX×]\s*(\d{3,4})\s*\)\s*$"
MEMBER_ID = r"(?i)^\s*[A-Z]+\d[A-Z0-9]*\s*(?:\(.+\))?\s*$"

# Headers.
COLUMN_HEADER = r"(?i)(부호|형태|단면|주근|대근|스트럽|스터럽|간격|비고|도\s*[\d@×x]|\bH\b|\s[x×]\s)"
ENGLISH_HEADER = (
    r"(?i)^\s*(NAME|SECTION|SIZE|MAIN\s*BAR|MAINBAR|\(MID\)\s*HOOP\s*BAR|\(T&B\)\s*HOOP\s*BAR|"
    r"HOOP\s*BAR|HOOP\s*중앙|HOOP\s*상,?\s*하단|TIE\s*BAR|TIEBAR|FCK|FC'|FCU|STRENGTH|CONCRETE\s*STRENGTH)\s*$"
)
KOREAN_HEADER = (
    r"(?i)^\s*(부\s*호|부호|형\s*태|형태|단면|주\s*근|주근|대근\s*\(?\s*중앙\s*\)?|대근\s*\(?\s*상하단\s*\)?|대근|스트럽|스터럽|"
    r"강도|설계\s*기준\s*강도|기준\s*강도|압축\s*강도|콘크리트\s*강도)\s*$"
)
#: Signs with which a header of either language begins and ends, in upper case.
HEADER_FIRST, HEADER_LAST = "NSM(HTFC부형단주대스강설기압콘", "ENRPKUH')앙단호태면근럽도"
BEAM_HEADER_TOKENS = ["부호", "기호", "형태", "상부근", "하부근", "스트럽", "스터럽", "표피철근"]
BLOCK_STARTS = ["NAME", "MARK", "부호", "기호", "보호"]

#: Types of the scan, of texts, and of shapes that section analysis looks at.
TEXT_TYPES = ["TEXT", "MTEXT", "ATTRIB"]
NEAR_TYPES = ["LINE", "LWPOLYLINE", "POLYLINE", "CIRCLE", "ARC"]
GEOMETRY_PREFIX = r"^(POINT|LINESTRING|POLYGON|MULTI|GEOMETRYCOLLECTION)"

#: Location words of beam tables, in the order in which they are tried as prefixes.
LOCATIONS = [
    ("int", "int"), ("interior", "int"), ("인테리어", "int"), ("인테", "int"), ("내부", "int"), ("in", "int"), ("i", "int"),
    ("cen", "cen"), ("center", "cen"), ("centre", "cen"), ("중앙", "cen"), ("중간", "cen"), ("mid", "cen"), ("span", "cen"), ("c", "cen"),
    ("ext", "ext"), ("exterior", "ext"), ("외부", "ext"), ("end", "ext"), ("단부", "ext"), ("e", "ext"), ("외단", "ext"),
    ("both", "_both"), ("양단", "_both"), ("양쪽", "_both"), ("all", "_all"), ("전체", "_all"), ("통근", "_all"),
]
#: Zone labels of vertical beam tables, in the order in which they are tried on the upper-cased text.
ZONES = [
    (r"^ALL\.?$|전체", "all"), (r"^BOTH\.?$|양단부|양단면", "both"),
    (r"\bEND\s*[\[(]\s*INT", "int"), (r"\bEND\s*[\[(]\s*EXT", "ext"), (r"\bEND\s*[\[(]\s*BOTH", "both"),
    (r"\bEND\b|단부", "ext"), (r"\bEXT\b|\bEXTERIOR\b|외부", "ext"),
]
#: What every zone label has somewhere.
ZONE_WORDS = "ALL|전체|BOTH|양단|END|단부|EXT|외부|INT|인테|내부|중앙|중간|CEN|MID|SPAN"
ZONES_INNER = r"\bINT\b|인테|내부"
ZONES_CENTER = r"중앙부|\b(CEN|CENTER|CENTRE)\b|중앙|중간|\bMID\b|\bSPAN\b"
