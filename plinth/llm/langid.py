"""Language identification: averaged embeddings of hashed subwords, a linear softmax, and calibrated rejection.

A text's subwords are the 2-, 3- and 4-byte grams of its letters (A-Z folded, other ASCII as one kind of space), hashed
into buckets. The model averages their embeddings and applies a linear layer; both are trained by stochastic gradient
descent in numpy on a bounded number of labelled rows, whose whole texts tasks turn into counts by bucket. As all of it is linear,
embeddings times layer is one small table of logits a bucket, and a prediction is the mean of its rows over a whole text. A
temperature and the threshold of rejection come from labelled rows that training didn't see, and from their letters shuffled:
texts of no language.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plinth.llm.common import groups, prepare, tidy, utf8

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageSettings:
    """``per_language``: the most labelled rows that are drawn of a language, by a hash of id and text; ``most_languages``: how
    many languages are learned, those with the most labelled rows first; ``most_rows``: the most rows in all, shared evenly. A row
    is counts of its whole text by bucket, so together they bound what the fit holds."""

    per_language: int = 800
    most_languages: int = 200
    most_rows: int = 6400
    buckets: int = 1 << 14
    dims: int = 16
    epochs: int = 6
    batch: int = 64
    rate: float = 4.0
    #: The greatest share of rightly recognized calibration texts that the threshold may reject.
    false_rejects: float = 0.001
    #: The threshold is at most this: a text is never rejected whose language is likelier than all others together.
    most_threshold: float = 0.5

    def each(self, languages: int) -> int:
        return max(1, min(self.per_language, self.most_rows // max(languages, 1)))


#: A-Z to a-z, other ASCII to a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
SIZES = (2, 3, 4)


def subwords(data: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """For each gram size, the bucket of the gram that begins at each byte; ``buckets`` where none does: at the end of a row
    and where its first two bytes are spaces."""
    folded = FOLD[data]
    n, shift = len(folded), np.uint32(32 - int(buckets).bit_length() + 1)
    wide = folded.astype(np.uint32)
    letter = folded != 32
    dull = ~letter
    if n:
        dull[:-1] &= ~letter[1:]
    key = wide.copy()
    for size in range(2, max(SIZES) + 1):
        key = key * np.uint32(0x01000193)
        if size - 1 < n:
            key[: n - size + 1] ^= wide[size - 1 :]
        if size in SIZES:
            bucket = ((key * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> shift).astype(np.int32)
            bucket[dull] = buckets
            ends = offsets[1:]
            for back in range(1, size):
                at = ends - back
                bucket[at[at >= 0]] = buckets
            yield bucket


def has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    folded = FOLD[data]
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum((folded != 32) & (folded < 128), out=seen[1:])
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[i] = any(c.isalpha() for c in column[i].as_py())
    return found


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (languages, buckets + 1) logits, the last column zero
    temperature: float
    threshold: float
    #: Share of calibration texts of no language that the threshold rejects; null without any.
    rejected: float | None = None

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean logits of each row, (rows, languages)."""
        rows, buckets = len(offsets) - 1, self.table.shape[1] - 1
        total, count = np.zeros((rows, len(self.languages))), np.zeros(rows)
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            at = offsets[full]
            for bucket in subwords(data, offsets, buckets):
                count[full] += np.add.reduceat(bucket < buckets, at, dtype=np.int64)
                for j, column in enumerate(self.table):
                    total[full, j] += np.add.reduceat(column[bucket], at, dtype=np.float64)
        return total / np.maximum(count, 1)[:, None]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, probability) of each text; ``und`` and 0 for those that are null or without a letter."""
        data, offsets = utf8(column)
        names, scores = [], [np.zeros(0)]
        for a, b in groups(offsets):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            known = has_letter(column.slice(a, b - a), own, at) & bool(self.languages)
            if self.languages:
                p = softmax(self.logits(own, at) / self.temperature)
                best = p.argmax(axis=1)
                names += [self.languages[j] if k else UNKNOWN for j, k in zip(best.tolist(), known.tolist())]
                scores.append(np.where(known, p[np.arange(len(p)), best], 0.0))
            else:
                names += [UNKNOWN] * (b - a)
                scores.append(np.zeros(b - a))
        return names, np.concatenate(scores)

    def accepts(self, names: list[str], scores: np.ndarray) -> np.ndarray:
        return (np.array(names, dtype=object) != UNKNOWN) & (scores >= self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(id_col: str) -> Column:
    """Rows that no fit may see: crc32 of the id as text leaves 2 when divided by 4. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def draw_threshold(count: int, wanted: int) -> int:
    """Of hashes that are evenly spread over 0 to 2^63 - 1, as many as are wanted of ``count`` are about so small; all, if no
    more are there."""
    return (1 << 63) - 1 if count <= wanted else (wanted << 63) // count


#: Sampled rows whose features a task holds at once before it sends them on.
ROWS_AT_ONCE = 64
#: Row numbers of a sampled text's features: the text, two short runs of its words, and, for calibration, the same shuffled.
REAL = 3


def _runs(text: str, h: int) -> list[str]:
    """A text and two short runs of its words, so that short texts are learned, and calibrated, as well."""
    rng, words = np.random.default_rng(h & (1 << 63) - 1), text.split()
    out = [text]
    for n in (6, 25):
        at = int(rng.integers(max(1, len(words) - n + 1)))
        out.append(" ".join(words[at : at + n]))
    return out


def _shuffled(text: str, h: int) -> str:
    letters = np.frombuffer(text.encode("utf-32-le"), "<u4").copy()
    np.random.default_rng(h & (1 << 63) - 1).shuffle(letters)
    return letters.tobytes().decode("utf-32-le")


def for_calibration(h: int) -> bool:
    return h % 6 == 0


def features(text: str, h: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of a sampled text's runs, and if it is for calibration of their letters shuffled."""
    runs = _runs(text, h)
    return [counts(x, buckets) for x in runs + ([_shuffled(x, h) for x in runs] if for_calibration(h) else [])]


def counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's subwords, and the share of each."""
    data = np.frombuffer(text.encode(), np.uint8)
    seen = np.concatenate([b[b < buckets] for b in subwords(data, np.array([0, len(data)]), buckets)])
    at, n = np.unique(seen, return_counts=True)
    return (at.astype(np.int32), (n / max(len(seen), 1)).astype(np.float32)) if len(at) else (np.zeros(1, np.int32), np.zeros(1, np.float32))


def drawn_features(df: DataFrame, id_col: str, text_col: str, lang_col: str, settings: LanguageSettings) -> DataFrame | None:
    """(h, l, bucket, share): hash, language and features of the drawn rows that a fit may see; none without a labelled row. The
    hash is of id and text: rows that repeat both are one. Exactly ``settings.each`` rows of a language are drawn, or all it has,
    however many that are."""
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.filter(F.col("i").isNotNull() & F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out("i"))
    known = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(settings.most_languages).collect()
    if not known:
        return None
    each = settings.each(len(known))
    # A draw at twice the rate and some more falls short of so many rows with no chance worth naming; the rest are cut exactly.
    below = [(r["l"], draw_threshold(r["n"], 2 * each + 200)) for r in known]
    limits = df.sparkSession.createDataFrame(below, "l string, below bigint")
    h = F.shiftrightunsigned(F.xxhash64(F.lit("language sample"), "i", "t"), 1)
    drawn = rows.withColumn("h", h).join(F.broadcast(limits), "l").filter("h <= below")  # ``most_languages`` rows at most
    drawn = drawn.groupBy("l", "h").agg(F.first("t").alias("t"))
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h"))).filter(F.col("k") <= each)
    buckets = settings.buckets

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(low, ROWS_AT_ONCE)
                own = [features(t, h, buckets) for t, h in zip(some.column(2).to_pylist(), some.column(1).to_pylist())]
                parts = [pa.array([[x[j].tobytes() for x in row] for row in own], pa.list_(pa.binary())) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([some.column(1), some.column(0), *parts], ["h", "l", "bucket", "share"])

    return drawn.select("l", "h", "t").mapInArrow(tidy(kernel), "h bigint, l string, bucket array<binary>, share array<binary>")


def _read(rows: Iterable) -> list[tuple[int, str, list]]:
    """(hash, language, features) of rows of ``drawn_features``, in the order of the hash."""
    out = [(r["h"], r["l"], [(np.frombuffer(b, np.int32), np.frombuffer(w, np.float32)) for b, w in zip(r["bucket"], r["share"])]) for r in rows]
    return sorted(out, key=lambda x: x[:2])


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, settings: LanguageSettings) -> list[tuple[int, str, list]]:
    """The rows of ``drawn_features`` on the driver."""
    found = drawn_features(df, id_col, text_col, lang_col, settings)
    return _read(found.toLocalIterator()) if found is not None else []


class Sparse:
    """Mean one-hot vectors of texts' subwords, row by row: buckets, in two bytes each where that is enough, and weights. Parts are
    taken from the list as they are copied, so that none is held twice."""

    def __init__(self, own: list[tuple[np.ndarray, np.ndarray]], edge: np.ndarray | None = None, buckets: int = 1 << 31):
        edge = np.concatenate([[0], np.cumsum([len(x) for x, _ in own])]).astype(np.int64) if edge is None else edge
        self.start, self.size = edge[:-1], np.diff(edge)
        self.bucket, self.weight = np.empty(edge[-1], np.uint16 if buckets <= 1 << 16 else np.int32), np.empty(edge[-1], np.float32)
        at = 0
        own.reverse()
        while own:
            bucket, weight = own.pop()
            self.bucket[at : at + len(bucket)], self.weight[at : at + len(bucket)] = bucket, weight
            at += len(bucket)

    def picked(self, at: np.ndarray) -> Sparse:
        """Some of the rows, in the order given. Buckets and weights are shared, not copied."""
        out = copy(self)
        out.start, out.size = self.start[at], self.size[at]
        return out

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets and weights of some rows, and where each row begins among them."""
        size = self.size[at]
        first = np.cumsum(size) - size
        pick = np.repeat(self.start[at] - first, size) + np.arange(size.sum())
        return self.bucket[pick].astype(np.int32), self.weight[pick], first

    def means(self, at: np.ndarray, table: np.ndarray) -> np.ndarray:
        bucket, weight, first = self.rows(at)
        return np.add.reduceat(table[bucket] * weight[:, None], first, axis=0)


@dataclass
class Drawn:
    """Drawn rows in the order of hash and language, as a fit takes them: each row's runs, and those for calibration shuffled."""

    hashes: list[int]
    names: list[str]
    runs: Sparse
    shuffled: Sparse


def _in_order(hashes: list[int], names: list[str], each: np.ndarray, held: Sparse) -> Drawn:
    """``each``: how many features a row has in ``held``."""
    order = np.array(sorted(range(len(names)), key=lambda i: (hashes[i], names[i])), np.int64)
    first, extra = (np.cumsum(each) - each)[order], (each - REAL)[order]
    more = np.repeat(first + REAL - (np.cumsum(extra) - extra), extra) + np.arange(extra.sum())
    return Drawn([hashes[i] for i in order], [names[i] for i in order], held.picked((first[:, None] + np.arange(REAL)).ravel()), held.picked(more))


def gathered(batches: Iterable[pa.RecordBatch], buckets: int) -> Drawn:
    """What ``drawn_features`` gives, batch by batch: numbers go from Arrow's buffers into one array, without an object for a row."""
    hashes, names, each, sizes, own = [], [], [], [], []
    narrow = np.uint16 if buckets <= 1 << 16 else np.int32
    for batch in batches:
        hashes += batch.column(0).to_pylist()
        names += batch.column(1).to_pylist()
        each.append(batch.column(2).value_lengths().to_numpy().astype(np.int64))
        (bucket, ends), (share, _) = (utf8(batch.column(c).flatten()) for c in (2, 3))
        sizes.append(np.diff(ends) // 4)
        own.append((np.frombuffer(bucket, np.int32).astype(narrow), np.frombuffer(share, np.float32).copy()))
    edge = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64)
    return _in_order(hashes, names, np.concatenate([np.zeros(0, np.int64), *each]), Sparse(own, edge, buckets))


def fit(rows: list[tuple[int, str, list]], settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """A model of sampled rows (hash, language, features)."""
    each = np.array([len(own) for *_, own in rows], np.int64)
    return fitted(_in_order([h for h, *_ in rows], [l for _, l, _ in rows], each, Sparse([f for *_, own in rows for f in own], buckets=settings.buckets)), settings)


def fitted(drawn: Drawn, settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """Train on five sixths of the drawn rows, calibrate on the rest."""
    languages = sorted(set(drawn.names))
    blank = LanguageModel(languages, np.zeros((len(languages), settings.buckets + 1), np.float32), 1.0, 0.0)
    if not languages:
        return blank
    rng = np.random.default_rng(20)
    number = {l: i for i, l in enumerate(languages)}
    x, shuffled, fakes = drawn.runs, drawn.shuffled, len(drawn.shuffled.size)
    labels = np.repeat([number[l] for l in drawn.names], REAL)
    later = np.repeat([for_calibration(h) for h in drawn.hashes], REAL)
    if later.all() or not later.any():  # too few rows to set some apart
        later = np.zeros(len(labels), bool)
    train = np.flatnonzero(~later)
    embed = rng.normal(0, 0.1, (settings.buckets, settings.dims)).astype(np.float32)
    layer = rng.normal(0, 0.1, (settings.dims, len(languages))).astype(np.float32)
    steps, step = settings.epochs * -(-len(train) // settings.batch), 0
    for _ in range(settings.epochs):
        order = rng.permutation(train)
        for low in range(0, len(order), settings.batch):
            at = order[low : low + settings.batch]
            rate = settings.rate * (1 - step / steps)
            bucket, weight, first = x.rows(at)
            mean = np.add.reduceat(embed[bucket] * weight[:, None], first, axis=0)
            g = softmax(mean @ layer)
            g[np.arange(len(at)), labels[at]] -= 1
            back = (g @ layer.T).astype(np.float32)
            layer -= np.float32(rate / len(at)) * (mean.T @ g)
            row = np.repeat(np.arange(len(at)), np.diff(np.append(first, len(bucket))))
            by = np.argsort(bucket)
            start = np.flatnonzero(np.diff(bucket[by], prepend=-1))
            embed[bucket[by[start]]] -= np.float32(rate) * np.add.reduceat(back[row[by]] * weight[by, None], start, axis=0)
            step += 1
    table = np.zeros((len(languages), settings.buckets + 1), np.float32)
    table[:, :-1] = (embed @ layer).T
    check = np.flatnonzero(later) if later.any() else train
    z = np.concatenate([x.means(check[a : a + 256], table[:, :-1].T) for a in range(0, len(check), 256)])
    truth = labels[check]
    temperatures = np.geomspace(0.02, 20, 121)
    loss = [-np.log(softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(loss))])
    p = softmax(z / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    if not len(right):
        return LanguageModel(languages, table, temperature, 0.0)
    none = np.concatenate([np.zeros(0), *(softmax(shuffled.means(np.arange(a, min(a + 256, fakes)), table[:, :-1].T) / temperature).max(axis=1) for a in range(0, fakes, 256))])
    # The least sum of both kinds of errors, among thresholds that reject no more right ones than allowed.
    steps = np.unique(right[: int(settings.false_rejects * len(right)) + 1])
    wrong = [np.searchsorted(right, t) / len(right) + (none >= t).sum() / max(len(none), 1) for t in steps]
    threshold = min(float(steps[int(np.argmin(wrong))]), settings.most_threshold)
    return LanguageModel(languages, table, temperature, threshold, float((none < threshold).mean()) if len(none) else None)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """A model of the labelled rows of ``df`` that may be seen. Rows with a null id, text or language teach nothing; without
    any others the model knows no language and calls every text ``und``. One task fits the drawn rows, whose number is bounded, so
    the driver gets the model alone."""
    prepare(df)
    found = drawn_features(df, id_col, text_col, lang_col, settings)
    if found is None:
        return fit([], settings)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted(gathered(batches, settings.buckets), settings)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    (row,) = found.repartition(1).mapInArrow(tidy(kernel), "model binary").collect()
    return pickle.loads(row["model"])


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: its id, held_out, lang_pred, score and accepted. Only the text is looked at. A null
    text or one without a letter is ``und`` with score 0 and not accepted. Ids may be null or repeat."""
    spark = prepare(df)
    shared = spark.sparkContext.broadcast(model)  # buckets x languages floats
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(shared.value.accepts(names, scores))], [id_col, "held_out", "lang_pred", "score", "accepted"])

    own = df.select(df[id_col], held_out(id_col).alias("held_out"), df[text_col].cast("string"))
    return own.mapInArrow(tidy(kernel), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose language the model accepts."""
    shared, place = prepare(df).sparkContext.broadcast(model), df.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.accepts(*shared.value.predict(batch.column(place)))))

    return df.mapInArrow(tidy(kernel), df.schema)
