"""Quality rules by repetition coverage.

Rolling 64-bit hashes of word n-grams of several lengths find the n-grams that a text holds twice or more; what counts is
how many of its characters lie inside such n-grams, and inside lines that repeat an earlier line. All of it is numpy over
Arrow batches of whole texts: one pass, no shuffle, nothing gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plinth.llm.common import NOT_SPACE, covered, distinct_spans, groups, hashed_again, mix, per_row, prepare, repeats, span_hashes, tidy, unequal, utf8, word_spans


@dataclass(frozen=True)
class RepetitionRules:
    """The verdict's thresholds. A text is rejected if it fails the base rules, or if more than the given share of its
    words' characters lies in repeated lines or in repeated n-grams of one of the lengths, or is a table or markup symbol."""

    min_words: int = 50
    max_repeat_words_percent: int = 50
    symbol_share: float = 0.05
    line_share: float = 0.30
    gram_share: dict[int, float] = field(default_factory=lambda: {5: 0.45, 6: 0.44, 7: 0.43, 8: 0.42, 9: 0.41, 10: 0.40})


SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]


def measure(data: np.ndarray, offsets: np.ndarray, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """All measures of a run of texts, an array for each."""
    starts, ends, bounds = word_spans(data, offsets, NOT_SPACE)
    rows, n = len(offsets) - 1, len(starts)
    row_of = np.repeat(np.arange(rows), np.diff(bounds))
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    signs = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=signs[1:])
    out = {"n_words": np.diff(bounds), "word_chars": per_row(chars, bounds), "n_symbols": signs[offsets[1:]] - signs[offsets[:-1]]}

    # Lines: cut at \n and at the ends of texts; those without a word don't count.
    cuts = np.flatnonzero(data == 10)
    line_from = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    line_from = line_from[line_from < len(data)]
    line_to = np.minimum(np.append(line_from[1:], len(data)), len(data))
    line_to = line_to - ((line_to > line_from) & (data[line_to - 1] == 10)) if len(line_from) else line_to
    words_to = np.searchsorted(starts, line_to)
    words_from = np.searchsorted(starts, line_from)
    real = words_to > words_from
    line_from, line_to, words_from, words_to = line_from[real], line_to[real], words_from[real], words_to[real]
    line_row = row_of[words_from] if n else words_from
    salt = mix(line_row.astype(np.uint64) + np.uint64(1))
    same = lambda i, j: (line_row[i] == line_row[j]) & ~unequal(data, line_from, line_to, i, j)
    name = lambda i: (int(line_row[i]), data[line_from[i] : line_to[i]].tobytes())
    _, later = repeats(span_hashes(data, line_from, line_to) ^ salt, same, name)
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=rows)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(chars, out=total[1:])
    out["dup_line_chars"] = np.bincount(line_row[later], (total[words_to] - total[words_from])[later], rows).astype(np.int64)

    # n-grams: one that repeats begins with a shorter one that repeats, so each length looks at what the last one left.
    word = span_hashes(data, starts, ends)
    left = bounds[1:][row_of] - np.arange(n)  # words from here to the end of the text
    salt = mix(row_of.astype(np.uint64) + np.uint64(1))
    at, rolled, length, code = np.arange(n), word.copy(), 1, None
    for size in sorted({3, *rules.gram_share}):
        fits = left[at] >= size
        at, rolled = at[fits], rolled[fits]
        while length < size:
            rolled = rolled * np.uint64(0x2545F4914F6CDD1D) + word[at + length]
            length += 1
        if code is None:  # words that may be in a repeated n-gram get numbers, which tell them apart whatever their hashes
            code = np.full(n, -1)
            near = hashed_again(mix(rolled) ^ salt[at])
            at, rolled = at[near], rolled[near]
            near = np.flatnonzero(covered(at, size, n))
            code[near] = distinct_spans(data, starts[near], ends[near])[0]

        def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = row_of[at[i]] == row_of[at[j]]
            for k in range(size):
                out &= code[at[i] + k] == code[at[j] + k]
            return out

        again, _ = repeats(mix(rolled) ^ salt[at], same, lambda i: (int(row_of[at[i]]), *code[at[i] : at[i] + size].tolist()))
        at, rolled = at[again], rolled[again]
        inside = covered(at, size, n)
        if size == 3:
            out["n_repeat_words"] = per_row(inside, bounds)
        if size in rules.gram_share:
            out[f"dup_chars_{size}"] = per_row(np.where(inside, chars, 0), bounds)
    return out


def judge(found: dict[str, np.ndarray], rules: RepetitionRules) -> tuple[np.ndarray, np.ndarray]:
    """(fails the base rules, is kept)."""
    base = (found["n_words"] < rules.min_words) | (100 * found["n_repeat_words"] > rules.max_repeat_words_percent * found["n_words"])
    bad = found["n_symbols"] > rules.symbol_share * found["word_chars"]
    bad |= found["dup_line_chars"] > rules.line_share * found["word_chars"]
    for size, share in rules.gram_share.items():
        bad |= found[f"dup_chars_{size}"] > share * found["word_chars"]
    return base, ~base & ~bad


def judged(column: pa.Array, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """Measures and verdicts of an Arrow array of texts."""
    data, offsets = utf8(column)
    names = [*MEASURES, *(f"dup_chars_{n}" for n in rules.gram_share)]
    parts = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], rules) for a, b in groups(offsets)]
    found = {k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in names}
    found["base_failed"], found["kept"] = judge(found, rules)
    return found


def repetition_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row for each row of ``df``: its id, the measures, ``base_failed`` and ``kept``.

    A null or empty text has no words: all measures 0, base_failed true, kept false. A null id stays null; repeated rows
    are judged one by one. Other columns of ``df``, whatever their names, play no part. No rows give no rows.
    """
    prepare(df)
    names = [*MEASURES, *(f"dup_chars_{n}" for n in sorted(rules.gram_share))]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{x} bigint" for x in names) + ", base_failed boolean, kept boolean"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judged(batch.column(1), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k]) for k in [*names, "base_failed", "kept"])], [id_col, *names, "base_failed", "kept"])

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(tidy(kernel), schema)


def keep_clean(df: DataFrame, text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text the rules keep."""
    prepare(df)
    place = df.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judged(batch.column(place), rules)["kept"]))

    return df.mapInArrow(tidy(kernel), df.schema)
