"""Source divergence audit by iceberg prefix refinement.

Terms that stand in enough documents of a language are found from the front. At each level, terms are cut to a prefix of some
bytes, and the distinct documents that hold a prefix are counted. What falls below the threshold goes, with every term that
begins so: a prefix is in all documents of its terms. The next level looks at longer prefixes of what is left, until no term
that is left is longer than its prefix; so long tails of rare, long terms are never shuffled, grouped or counted whole.

Texts are read once. Each task writes units: a few megabytes of text as its distinct terms in byte order, and the pairs of
document and term. Levels read units alone. A document is a row, so it lies in one unit, and counts of units add up. Levels
count 64-bit hashes of prefixes, and a Bloom filter of bounded size says which are alive: both can only keep a term too many.
The terms that come out are counted whole, by their bytes, and the threshold decides exactly.

Sources are then compared on blocks of a language's terms, so that neither a language nor a source is ever in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from plinth.llm.common import LOWER, distinct_spans, groups, mix, prepare, span_hashes, tidy, utf8, word_spans
from plinth.llm.decontaminate import LEAST_BITS, MOST_BITS, _passes as passes, print_filter
from plinth.session import staged

#: Letters, and all beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

#: A term is kept by a language if so many of its documents hold it.
LEAST_DOCS = 3
#: Bytes of the first prefixes; each level doubles it.
FIRST_WIDTH = 4
#: Bytes of text that make a unit, about.
UNIT_BYTES = 8 << 20
#: Units that are read and written together; a task counts the prefixes of those together before they are shuffled.
UNITS_HELD = 4
#: Numbers below this are told apart by a table of them, greater ones by sorting.
DENSE = 1 << 21
#: Bits of the filter for each prefix that is alive.
BITS_EACH = 16
#: Probabilities are whole parts of this.
SCALE = 1_000_000_000
#: Ranks of terms that are reported for a source.
TOP_TERMS = 200
#: Counts of terms by source that a block holds, about, and counts that are compared at once.
BLOCK, AT_ONCE = 200_000, 1 << 20

_UNIT = "langs array<string>, sources array<string>, terms binary, term_ends binary, doc_group binary, doc_ends binary, codes binary, cell_group binary, cell_code binary, cell_n binary, cell_docs binary"
_NAMES = [c.split()[0] for c in _UNIT.split(", ")]


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some spans one after the other, and each one's size."""
    size = ends - starts
    return data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


def _unit(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> list:
    """The columns of one unit."""
    pairs = pa.StructArray.from_arrays([langs, sources], ["lang", "source"])
    names = list(dict.fromkeys(zip(langs.to_pylist(), sources.to_pylist())))
    place = {name: i for i, name in enumerate(names)}
    group = np.array([place[x["lang"], x["source"]] for x in pairs.to_pylist()], np.int64)
    data, offsets = utf8(texts)
    parts, words, before = [], [], 0
    for lo, hi in groups(offsets):  # what words take beside the text is held for one run of texts at a time
        own = LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, bounds = word_spans(own, offsets[lo : hi + 1] - offsets[lo], LETTERS)
        code, first = distinct_spans(own, starts, ends)
        pair, n = np.unique(np.repeat(np.arange(lo, hi), np.diff(bounds)) * max(len(first), 1) + code, return_counts=True)
        doc, code = np.divmod(pair, max(len(first), 1))
        parts.append((doc.astype(np.int32), (code + before).astype(np.int32), n.astype(np.int32)))
        words.append(_spelled(own, starts[first], ends[first]))
        before += len(first)
    raw, size = (np.concatenate(x) for x in zip(*words))
    known, first = distinct_spans(raw, np.cumsum(size) - size, np.cumsum(size))
    terms, size = _spelled(raw, (np.cumsum(size) - size)[first], np.cumsum(size)[first])
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(terms)])
    order, many = pc.array_sort_indices(terms), max(len(size), 1)
    rank = np.empty(len(size), np.int32)
    rank[order.to_numpy()] = np.arange(len(size))
    doc, code, n = (np.concatenate(x) for x in zip(*parts))
    code = rank[known[code]]
    by = np.argsort(doc.astype(np.int64) * many + code)
    doc, code, n = doc[by], code[by], n[by]
    cell, at = np.unique(group[doc] * many + code, return_inverse=True)
    total, docs = np.bincount(at, n, len(cell)).astype(np.int64), np.bincount(at, minlength=len(cell))  # less than 2^53: exact
    spelled, ends = utf8(terms.take(order))
    blobs = [
        spelled.tobytes(), ends[1:], group, np.searchsorted(doc, np.arange(len(group)), "right"),
        code.astype(np.int32), cell // many, (cell % many).astype(np.int32), total, docs,
    ]
    return [[x[0] for x in names], [x[1] for x in names], *(x if isinstance(x, bytes) else x.tobytes() for x in blobs)]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def made() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        rows = [_unit(*(whole.column(c).combine_chunks() if whole.column(c).num_chunks != 1 else whole.column(c).chunk(0) for c in range(3)))]
        types = [pa.list_(pa.string())] * 2 + [pa.binary()] * (len(_NAMES) - 2)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], _NAMES)

    for batch in batches:
        _, offsets = utf8(batch.column(0))
        for a, b in groups(offsets, UNIT_BYTES):
            held.append(batch.slice(a, b - a))
            size += int(offsets[b] - offsets[a])
            if size >= UNIT_BYTES:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def units(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Units of ``df``, staged, a few in memory at a time: null texts, languages and sources count as empty."""
    prepare(df)
    chosen = [F.coalesce(df[c].cast("string"), F.lit("")).alias(c_) for c, c_ in ((text_col, "t"), (lang_col, "l"), (source_col, "s"))]
    return staged(df.select(*chosen).mapInArrow(tidy(_units), _UNIT), "term-units", group_rows=UNITS_HELD)


def _array(row: dict, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(row[name].as_buffer(), kind)


def _keys(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a unit: hashes of its terms' prefixes, its terms' lengths, and hashes of its groups' languages."""
    data, ends = _array(row, "terms", np.uint8), _array(row, "term_ends", np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    langs = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in row["langs"].as_py()], np.uint64)
    return span_hashes(data, starts, np.minimum(ends, starts + width)), ends - starts, langs


def _seen(numbers: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in ascending order, and the place of each number among them."""
    if below > DENSE:
        return np.unique(numbers, return_inverse=True)
    there = np.zeros(below, bool)
    there[numbers] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[numbers]


def _prefixes(row: dict, width: int, before: tuple[int, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a unit: prints of the prefixes that are alive, the documents that hold each, and the length of its longest term. Prints
    and what is alive are found once for each term and language, not for each document that holds a term."""
    prefix, size, langs = _keys(row, width)
    code, group = _array(row, "codes", np.int32), _array(row, "doc_group", np.int64)
    names, lang = np.unique(langs, return_inverse=True)
    doc, many = np.repeat(np.arange(len(group), dtype=np.int32), np.diff(_array(row, "doc_ends", np.int64), prepend=0)), max(len(size), 1)
    cell, at = _seen((lang[group] * many)[doc] + code, len(names) * many)
    lang, term = names[cell // many], cell % many
    if before:
        alive = passes(mix(_keys(row, before[0])[0][term] ^ lang), before[1]) if len(cell) else np.zeros(0, bool)
        doc, at = doc[alive[at]], (np.cumsum(alive) - 1)[at[alive[at]]]
        lang, term = lang[alive], term[alive]
    keys, of = np.unique(mix(prefix[term] ^ lang), return_inverse=True)
    key, longest = of[at], np.zeros(len(keys), np.int64)
    np.maximum.at(longest, of, size[term])
    fresh = np.ones(len(key), bool)  # terms stand in byte order, so those of one prefix are neighbours
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return keys, np.bincount(key[fresh], minlength=len(keys)), longest


def prefix_counts(found: DataFrame, width: int, before: tuple[int, Broadcast] | None) -> DataFrame:
    """(print, docs, longest): for each prefix of ``width`` bytes and language, shorter terms whole, the documents that hold it, and
    the length of its longest term, among the terms that the level ``before`` (width, filter) left."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                keys, docs, longest = _prefixes(row, width, before and (before[0], before[1].value))
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs), pa.array(longest)], ["print", "docs", "longest"])

    names = ["langs", "terms", "term_ends", "doc_group", "doc_ends", "codes"]
    counts = found.select(*names).mapInArrow(tidy(kernel), "print bigint, docs bigint, longest bigint")
    return counts.groupBy("print").agg(F.sum("docs").alias("docs"), F.max("longest").alias("longest"))


def refined(found: DataFrame, least_docs: int = LEAST_DOCS, first_width: int = FIRST_WIDTH) -> tuple[int, Broadcast]:
    """(width, filter) of the last level: among the terms that it leaves are all that ``least_docs`` documents of a language hold."""
    width, before = first_width, None
    while True:
        alive = staged(prefix_counts(found, width, before).filter(F.col("docs") >= least_docs), "live-prefixes")
        n, longest = alive.agg(F.count("*"), F.coalesce(F.max("longest"), F.lit(0))).first()
        before = (width, print_filter(alive, min(max(1 << (n * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)))
        if longest <= width:
            return before
        width *= 2


def kept_terms(found: DataFrame, least_docs: int = LEAST_DOCS, first_width: int = FIRST_WIDTH) -> DataFrame:
    """(lang, source, term, n, n_lang, lead), staged: occurrences of each kept term in each source that has it, and in the language;
    ``lead`` marks one row of each term."""
    width, held = refined(found, least_docs, first_width)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                prefix, _, langs = _keys(row, width)
                group, code = _array(row, "cell_group", np.int64), _array(row, "cell_code", np.int32)
                if not len(code):
                    continue
                alive = np.flatnonzero(passes(mix(prefix[code] ^ langs[group]), held.value))
                ends = np.concatenate([[0], _array(row, "term_ends", np.int64)]).astype(np.int32)
                terms = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), row["terms"].as_buffer())
                for low in range(0, len(alive), 1 << 16):
                    at = alive[low : low + (1 << 16)]
                    names = [pa.array(row[c].as_py()).take(pa.array(group[at])) for c in ("langs", "sources")]
                    counts = [pa.array(_array(row, c, np.int64)[at]) for c in ("cell_n", "cell_docs")]
                    yield pa.RecordBatch.from_arrays([*names, terms.take(pa.array(code[at])), *counts], ["lang", "source", "term", "n", "docs"])

    cells = found.select("langs", "sources", "terms", "term_ends", "cell_group", "cell_code", "cell_n", "cell_docs")
    cells = cells.mapInArrow(tidy(kernel), "lang string, source string, term string, n bigint, docs bigint")
    counts = cells.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("n_lang", F.sum("n").over(term)).withColumn("docs", F.sum("docs").over(term)).withColumn("lead", F.col("source") == F.min("source").over(term))
    return staged(counts.filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")


def _compared(key: tuple, cells: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums over a block of terms of floor((p - q)^2 / q) for each two sources of the block's language."""
    names, p0 = sources.column("source").combine_chunks(), sources.column("p0").to_numpy()
    many, lang = len(p0), key[0]
    sums = np.zeros((many, many), np.int64)
    if cells.num_rows:
        term = cells.column("term").combine_chunks().dictionary_encode()
        term = (term if isinstance(term, pa.DictionaryArray) else term.combine_chunks()).indices.to_numpy()
        source, p = pc.index_in(cells.column("source"), value_set=names).to_numpy(), cells.column("p").to_numpy()
        order = np.argsort(term, kind="stable")
        term, source, p = term[order], source[order], p[order]
        step = max(AT_ONCE // many, 1)
        for low in range(0, int(term[-1]) + 1, step):
            high = min(low + step, int(term[-1]) + 1)
            a, b = np.searchsorted(term, (low, high))
            held = np.repeat(p0[:, None], high - low, axis=1)
            held[source[a:b], term[a:b] - low] = p[a:b]
            for i in range(many):
                gap = held - held[i]
                sums[i] += (gap * gap // held).sum(axis=1)
    i, j = np.nonzero(~np.eye(many, dtype=bool))
    return pa.table({"lang": pa.array([str(lang)] * len(i), pa.string()), "source": names.take(pa.array(i)), "item": names.take(pa.array(j)), "value": sums[i, j]})


def _probability(n: str, total: str) -> F.Column:
    """1 + floor(SCALE (n + 1) / (total + v)), exact however large the counts."""
    return F.expr(f"cast(1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + 1 as decimal(20, 0))) div cast({total} + v as decimal(20, 0)) as bigint)")


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, first_width: int = FIRST_WIDTH) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair`` compares a source's terms with those of each other source of its
    language, part ``term`` names the terms that it has more of than its language has, the ``top`` of them.

    A null text, language or source counts as empty; each row is a document, whether or not its text or anything else is in
    another row, so terms of three equal rows are kept. A source without a kept term has the least probability for each; where a
    language keeps no term, its pairs have value 0. Equal values are ranked by item, in byte order. Other columns play no part.
    No rows give no rows.
    """
    found = units(df, text_col, lang_col, source_col)
    kept = kept_terms(found, least_docs, first_width)
    each = found.select(F.explode(F.arrays_zip("langs", "sources")).alias("g")).select(F.col("g.langs").alias("lang"), F.col("g.sources").alias("source")).distinct()
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.sum(F.col("lead").cast("long")).alias("v"), F.count("*").alias("cells"))
    info = each.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(by_lang, "lang", "left")
    info = info.na.fill(0, ["total", "total_lang", "v", "cells"]).withColumn("blocks", F.ceil(F.greatest("cells", F.lit(1)) / BLOCK)).withColumn("zero", F.lit(0))
    info = staged(info.withColumn("p0", F.when(F.col("v") > 0, _probability("zero", "total")).otherwise(F.lit(1))).drop("zero", "cells"), "source-totals")
    scored = kept.join(info, ["lang", "source"]).withColumn("p", _probability("n", "total")).withColumn("q", _probability("n_lang", "total_lang"))

    value = F.expr("((p - q) * (p - q)) div q").alias("value")
    terms = scored.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value)
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= top)

    blocks = scored.select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "p").groupBy("lang", "block")
    dealt = info.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "p0").groupBy("lang", "block")
    sums = blocks.cogroup(dealt).applyInArrow(_compared, "lang string, source string, item string, value bigint").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(own))
    return pairs.unionByName(terms)


def oracle(least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> str:
    """The same over ``documents``: terms whole, every source of a language against every other, term by term."""
    chance = lambda n, total: f"1 + (CAST({SCALE} AS HUGEINT) * ({n} + 1)) // ({total} + v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {least_docs}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, sum(n) AS total_lang, count(*) AS v FROM k GROUP BY 1), s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(total_lang, 0) AS total_lang, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source) LEFT JOIN l USING (lang)),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, {chance("coalesce(c.n, 0)", "total")} AS p, {chance("k.n", "total_lang")} AS q FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= {top}
"""
