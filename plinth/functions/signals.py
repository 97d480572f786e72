"""Readings of drawing texts, as column expressions: bars, sizes, storeys, labels, zones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from plinth.functions import patterns as P

SPACES = r"[\s　]+"
#: The characters that ``(?U)\s`` matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def stripped(c: Column) -> Column:
    """Without white space at either end, wide spaces included; null is empty."""
    return F.trim(F.coalesce(c, F.lit("")), F.lit(WHITE))


def has(c: Column, *signs: str) -> Column:
    """Whether any of some texts stands in ``c``: a search of bytes, for what a regular expression can't match without."""
    out = c.contains(signs[0])
    for sign in signs[1:]:
        out = out | c.contains(sign)
    return out


def bare(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s　]+", "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing matches or the group is empty."""
    return F.get(F.array_remove(F.array(F.regexp_extract(c, pattern, group)), F.lit("")), F.lit(0))  # matched once


def number(c: Column, pattern: str, group: int = 1) -> Column:
    return found(c, pattern, group).try_cast("int")  # a cast of empty text would be slow: it fails by an exception


def pair(c: Column, pattern: str) -> Column:
    """The first two groups of the first match as array<int>, or null."""
    return let(F.regexp_extract(c, pattern, 1), lambda first: F.when(first != "", F.array(first.try_cast("int"), number(c, pattern, 2))))


def positive(c: Column) -> Column:
    """a number above zero, else null."""
    n = F.trim(c.cast("string")).try_cast("double")
    return F.when(n > 0, n)


def story_text(c: Column) -> Column:
    """Unicode minus signs and tildes as ASCII."""
    return F.translate(stripped(c), "−–—～〜∼", "---~~~")


def without_dimension(c: Column) -> tuple[Column, Column]:
    """(text, mm): a last lone 200..4000 goes where the rest has a letter or a tilde."""
    ends = F.substring(F.rtrim(c, F.lit(" \t\n\x0b\f\r\x85\u2028\u2029")), -5, 5).rlike(r"\s\d{3,4}$")  # few texts end so, and the whole pattern is slow
    cut = F.when(ends, let(number(c, P.TRAILING_DIMENSION, 2), lambda n: F.when(n.between(200, 4000) & F.regexp_extract(c, P.TRAILING_DIMENSION, 1).rlike("[A-Za-z가-힣~～]"), n)))
    return F.when(cut.isNotNull(), F.rtrim(F.regexp_extract(c, P.TRAILING_DIMENSION, 1))).otherwise(c), cut


MEMBER = "struct<story:string,mark:string,floor_range:array<string>>"


def _member(text: Column) -> Column:
    """X5 of a text in plain signs, without a trailing dimension."""
    get = lambda p, i: F.regexp_extract(text, p, i)
    mark = lambda p, i: F.nullif(F.trim(F.coalesce(F.nullif(get(p, i), F.lit("")), get(p, i + 1))), F.lit(""))
    of = lambda story, mark, floors=None: F.struct(story.alias("story"), mark.alias("mark"), (F.lit(None) if floors is None else floors).cast("array<string>").alias("floor_range"))
    tilde = lambda a, b: F.concat(a, F.lit("~"), b)
    read = (
        F.when(text.rlike(P.STORY_RANGE), of(tilde(get(P.STORY_RANGE, 1), get(P.STORY_RANGE, 2)), mark(P.STORY_RANGE, 3), F.array(get(P.STORY_RANGE, 1), get(P.STORY_RANGE, 2))))
        .when(text.rlike(P.STORY_OPEN), of(tilde(F.lit(""), get(P.STORY_OPEN, 1)), mark(P.STORY_OPEN, 2), F.array(F.lit("~"), get(P.STORY_OPEN, 1))))
        .when(text.rlike(P.STORY_JOINED), of(get(P.STORY_JOINED, 1), get(P.STORY_JOINED, 2)))
        .when(text.rlike(P.STORY_APART), of(get(P.STORY_APART, 1), F.trim(get(P.STORY_APART, 2))))
    )
    # All four begin with a number or a tilde.
    return F.when(text.rlike(r"^\s*(?:[~～]|-?\d)"), read).otherwise(F.lit(None).cast(MEMBER))


def _with_mm(m: Column, mm: Column) -> Column:
    return F.struct(m["story"].alias("story"), m["mark"].alias("mark"), m["floor_range"].alias("floor_range"), mm.alias("trailing_mm"))


def story_and_mark(cell: Column) -> Column:
    """struct(story, mark, floor_range array<string>, trailing_mm) of a member's name. For a table's column,
    ``with_member`` is faster."""

    def whole(text: Column) -> Column:
        body, mm = without_dimension(text)
        return let(F.struct(body.alias("body"), mm.alias("mm")), lambda b: let(_member(b["body"]), lambda m: _with_mm(m, b["mm"])))

    return let(story_text(cell), whole)


def with_member(df: DataFrame, cell: str, name: str) -> DataFrame:
    """``df`` and ``story_and_mark`` of a column. Steps are projections of their own, so each regular expression runs once,
    compiled."""
    out = df.withColumn("_text", story_text(F.col(cell)))
    body, mm = without_dimension(F.col("_text"))
    out = out.withColumn("_mm", mm).withColumn("_body", body).withColumn("_member", _member(F.col("_body")))
    return out.withColumn(name, _with_mm(F.col("_member"), F.col("_mm"))).drop("_text", "_mm", "_body", "_member")


def story_label(floor_range: Column) -> Column:
    """``~b`` or ``a~b`` of a range."""
    a, b = F.trim(F.try_element_at(floor_range, F.lit(1))), F.trim(F.try_element_at(floor_range, F.lit(2)))
    return F.when((a == "~") & (b != ""), F.concat(a, b)).when((a != "") & (b != ""), F.concat(a, F.lit("~"), b))


def _named_floors(s: Column) -> Column:
    return F.when(has(s, *"FfHh") & has(s, *"~～-") & s.rlike(P.FLOOR_RANGE), F.array(F.regexp_extract(s, P.FLOOR_RANGE, 1), F.regexp_extract(s, P.FLOOR_RANGE, 2)))


def _floor_tokens(s: Column, floors: Column) -> Column:
    return F.when(floors.isNull() & has(s, *"FfHh층") & s.rlike(P.FLOOR_TOKEN), F.regexp_extract_all(s, F.lit(P.FLOOR_TOKEN), F.lit(1)))


def _signals(s: Column, floors: Column) -> Column:
    return F.struct(
        F.when(has(s, "-"), number(s, P.BARS, 1)).alias("main_bar_bars"),
        F.coalesce(F.when(has(s, "-"), number(s, P.BARS, 2)), F.when(has(s, *"Dd"), number(s, P.DIAMETER)), F.when(has(s, *"Hh"), number(s, P.HIGH_STRENGTH))).alias("rebar_d"),
        F.when(has(s, "@"), number(s, P.SPACING)).alias("spacing"),
        F.when(has(s, *"xX"), pair(s, P.SIZE)).alias("size_mm"),
        F.coalesce(F.when(has(s, "("), pair(s, P.THICKNESS_PAREN)), F.when(has(s, "/"), pair(s, P.THICKNESS_SLASH))).alias("thickness_pair"),
        floors.alias("floor_range"),
        _floor_tokens(s, floors).alias("floor_tokens"),
    )


def text_signals(c: Column) -> Column:
    """struct(main_bar_bars, rebar_d, spacing, size_mm, thickness_pair, floor_range, floor_tokens) of one text; the first
    match of each pattern counts. For a table's column, ``with_signals`` is faster."""
    floors = lambda s: F.coalesce(_named_floors(s), story_and_mark(s)["floor_range"])
    return let(stripped(c), lambda s: let(floors(s), lambda f: _signals(s, f)))


def with_signals(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` and ``text_signals`` of a column, in projections of their own. The lambda in ``pair`` also keeps the last one out of
    whole-stage code, where all of it would be one method, too long for the JVM's compiler."""
    out = with_member(df.withColumn("_sig_text", stripped(F.col(text))), "_sig_text", "_sig_member")
    out = out.withColumn("_sig_floors", F.coalesce(_named_floors(F.col("_sig_text")), F.col("_sig_member.floor_range")))
    return out.withColumn(name, _signals(F.col("_sig_text"), F.col("_sig_floors"))).drop("_sig_text", "_sig_member", "_sig_floors")


SIGNALS = ["main_bar_bars", "rebar_d", "spacing", "size_mm", "thickness_pair", "floor_range", "floor_tokens"]


def merged_signals(signals: Column) -> Column:
    """Of an array of signals, each field's last value that isn't null."""
    last = lambda f: F.try_element_at(F.filter(F.transform(signals, lambda s: s[f]), lambda v: v.isNotNull()), F.lit(-1))
    return F.struct(*(last(f).alias(f) for f in SIGNALS))


def without_strength(c: Column) -> tuple[Column, Column]:
    """(the rest, all concrete strength notes joined by a space)."""
    s = stripped(c)
    notes = F.transform(F.regexp_extract_all(s, F.lit(f"({P.STRENGTH})"), F.lit(1)), lambda x: F.trim(x))
    rest = F.trim(F.regexp_replace(F.regexp_replace(s, P.STRENGTH, " "), r"\s+", " "))
    return F.when(F.size(notes) > 0, rest).otherwise(s), F.array_join(notes, " ")


def two_tiers(c: Column) -> Column:
    """``11-11-D16`` as ``11/11-D16``."""
    return F.regexp_replace(F.trim(c), P.TWO_TIERS, "$1/$2-$3")


def mark_and_size(c: Column) -> Column:
    """struct(mark, width, depth) of ``RG13C (1000x900)``; sizes must be 200..4000."""

    def read(s: Column) -> Column:
        size = F.struct(number(s, P.MARK_SIZE, 2).alias("w"), number(s, P.MARK_SIZE, 3).alias("h"))
        whole = F.struct(s.alias("mark"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("depth"))
        sized = lambda z: F.when(z["w"].between(200, 4000) & z["h"].between(200, 4000), F.struct(F.trim(F.regexp_extract(s, P.MARK_SIZE, 1)).alias("mark"), z["w"].alias("width"), z["h"].alias("depth")))
        return F.coalesce(F.when(has(s, "(") & has(s, ")"), let(size, sized)), whole)

    return let(stripped(c), read)


def millimetres(c: Column) -> Column:
    """The first 2 to 4 digits, if 100..5000."""
    n = number(c, r"(\d{2,4})")
    return F.when(n.between(100, 5000), n)


def is_lone_dimension(nfkc: Column) -> Column:
    """A text (in NFKC) that is one dimension of 200..4000 and nothing else."""
    s = F.regexp_replace(F.regexp_replace(bare(nfkc), "[,，]", ""), "(?i)mm$", "")
    return F.coalesce(F.when(s.rlike(r"^\d{3,4}$"), s.try_cast("int").between(200, 4000)), F.lit(False))


def compact(c: Column) -> Column:
    """Lower case without spaces, ``_ - . /`` and wide dashes."""
    return F.regexp_replace(F.lower(stripped(c)), r"(?U)[\s　_\-./－–]+", "")


def location_zone(c: Column) -> Column:
    """Int, cen, ext, _both or _all by prefix; the order of the words counts."""
    s, out = compact(c), F.lit(None).cast("string")
    for word, zone in reversed(P.LOCATIONS):
        out = F.when(s.startswith(word), zone).otherwise(out)
    return F.when(s != "", out)


def zone_label(nfkc: Column) -> Column:
    """Int, cen, ext, both or all of a zone label (in NFKC)."""
    u = F.regexp_replace(F.upper(stripped(nfkc)), r"\s+", " ")
    out = F.when(u.rlike(P.ZONES_INNER), F.when(u.rlike("BOTH|양"), "both").otherwise("int")).when(u.rlike(P.ZONES_CENTER), "cen")
    for pattern, zone in reversed(P.ZONES):
        out = F.when(u.rlike(pattern), zone).otherwise(out)
    return F.when(u.rlike(P.ZONE_WORDS), out)


def collapsed(c: Column) -> Column:
    """A label that CAD repeated (``MAIN BAR MAIN BAR``) once."""
    s = bare(c)
    n = F.length(s)
    half = s.substr(F.lit(1), (n / 2).cast("int"))
    twice = (n >= 4) & (n % 2 == 0) & (F.concat(half, half) == s)
    spaced = F.when(F.upper(half) == "MAINBAR", "MAIN BAR").when(F.upper(half) == "TIEBAR", "TIE BAR").otherwise(half)
    return F.when(twice, spaced).otherwise(stripped(c))


def is_header(c: Column) -> Column:
    """A schedule's header token and nothing else."""
    s, t = collapsed(c), stripped(c)
    sign = lambda at: F.upper(F.substring(t, at, 1))
    # Whether it stands there once or twice, it begins and ends as the text does.
    return sign(1).isin(*P.HEADER_FIRST) & sign(-1).isin(*P.HEADER_LAST) & (s.rlike(P.ENGLISH_HEADER) | s.rlike(P.KOREAN_HEADER))


def is_block_start(c: Column) -> Column:
    """A label at which a block of rows begins."""
    return F.upper(bare(c)).isin(P.BLOCK_STARTS)


def column_label(c: Column) -> Column:
    """What a column schedule's row is, by its first cell."""
    s = bare(c)
    hoop = s.contains("대근")
    building = s.rlike(r"^[A-Za-z]?\d+동$") | (s.endswith("동") & (F.length(s) <= 20) & ~s.rlike("[~～-]"))
    return (
        F.when(s == "", "unknown").when(s.isin("부호", "기호"), "부호").when(s.isin("형태", "단면"), "형태").when(s == "주근", "주근")
        .when(hoop & s.contains("중앙"), "대근_중앙").when(hoop & s.rlike("상하|상단|하단"), "대근_상하단").when(building, "동_헤더").otherwise("other")
    )


def row_role(texts: Column) -> Column:
    """header_like, section_like or data, by a row's texts."""
    joined, one = F.array_join(texts, " "), F.try_element_at(texts, F.lit(1))
    return (
        F.when((F.size(texts) >= 2) & joined.rlike(P.COLUMN_HEADER), "header_like")
        .when((F.size(texts) == 1) & F.length(one).between(1, 48) & ~one.rlike(r"\d{4,}"), "section_like")
        .otherwise("data")
    )


def slab_variant(cells: Column) -> Column:
    """Unknown, mixed_or_labeled or inline, by the place of X and Y in a slab's cells."""
    joined = F.array_join(cells, " ")
    at = F.instr(F.upper(joined), "X")
    before, after = joined.substr(F.lit(1), at), joined.substr(at + 1, F.length(joined))
    return F.when(~joined.rlike(P.SIZE) | (at == 0), "unknown").when(F.upper(after).contains("Y") | before.contains("Y"), "mixed_or_labeled").otherwise("inline")


def layer_key(c: Column) -> Column:
    """A layer's name without spaces, upper case, after the last ``$``, then ``|``, ``/`` and ``\\``."""
    s = F.upper(bare(c))
    for sign in ("$", "|", "/", "\\"):
        last = F.substring_index(s, sign, -1)
        s = F.when(last != "", last).otherwise(s)
    return s


def slug(label: Column, index: Column) -> Column:
    """A field's key: word characters of the label, at most 80, and its index."""
    name = F.concat(F.lit("field_"), index.cast("string"))
    raw = F.coalesce(F.nullif(stripped(label), F.lit("")), name)
    s = F.regexp_replace(raw, r"(?U)[^\wㄱ-ㆎ가-힣]+", "_")
    s = F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, 80)
    return F.concat(F.coalesce(F.nullif(s, F.lit("")), name), F.lit("__"), index.cast("string"))


def is_useful(main_bar: Column, size: Column, mark: Column, label: Column, width: Column, depth: Column) -> Column:
    """a record with a mark, a label, bars, a size or a dimension."""
    some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    bars = F.coalesce(main_bar, F.lit("")).rlike(r"(?i)(?:\d+\s*[-–]?\s*(?:U?HD|SHD)|\d\s*-\s*D|D\s*\d)")
    return some(mark) | some(label) | bars | F.coalesce(size, F.lit("")).rlike(r"\d{2,4}\s*[xX×]\s*\d{2,4}") | width.isNotNull() | depth.isNotNull()


def story_error(label: Column, story: Column, floor_range: Column) -> Column:
    """A tilde in the name, but no storey could be read."""
    parsed = story_and_mark(label)
    unread = parsed["story"].isNull() & parsed["floor_range"].isNull()
    return F.coalesce(label, F.lit("")).rlike("[~～∼〜]") & (F.trim(F.coalesce(story, F.lit(""))) == "") & floor_range.isNull() & unread
