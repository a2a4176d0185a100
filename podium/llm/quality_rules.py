"""Quality rules: statistics of whole texts, fixed limits on them, and an isolation forest for the rest.

The forest splits random samples of documents' statistics at random places; a document that is
alone after few splits is unusual. Each tree has a sample of its own, drawn from all documents whatever their labels; the
ordinary ranges and how unusual a document may be are set on all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import BASE_INVERSE, chunks, drop, learning_rows, numbered, powers, ship, staged, texts
from podium.llm.common import BASE as FACTOR

#: Symbols that are counted, and the length of a repeated passage in words.
SYMBOLS, PASSAGE = b"#*$%&|<>", 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest looks at: shares, so that a text's length alone is not unusual.
SHARES = ["symbols", "dup_lines", "repeats", "word_length", "capitals", "digits", "exclamations", "stops", "line_words"]
STATISTICS = [*BASE, *SHARES]

_KIND = np.zeros(256, np.uint8)  # bits: 1 white space, 2 symbol, 4 capital, 8 digit, 16 '!', 32 stop, 64 newline, 128 inside a code point
_KIND[[32, *range(9, 14)]] |= 1
_KIND[list(SYMBOLS)] |= 2
_KIND[65:91] |= 4
_KIND[48:58] |= 8
_KIND[33] |= 16
_KIND[[44, 46, 59, 58]] |= 32
_KIND[10] |= 64
_KIND[0x80:0xC0] |= 128
_MARKS = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _repeated(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose number comes twice or more, rows whose number came before)."""
    order = np.argsort(numbers, kind="stable")
    same = numbers[order][1:] == numbers[order][:-1]
    twice, later = np.zeros(len(numbers), bool), np.zeros(len(numbers), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """All STATISTICS of each text of a string column without nulls, from one pass over its bytes.

    Words and lines are equal if their bytes are: 64-bit marks only bring them together.
    """
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    first = offsets[0]
    offsets = offsets - first
    n, docs = int(offsets[-1]), len(column)
    if not n:
        zero = np.zeros(docs)
        return {s: zero.astype(np.int64) if s in BASE else zero for s in STATISTICS}
    raw = np.frombuffer(data, np.uint8)[first : first + n]
    kind = np.take(_KIND, raw)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums

    in_doc = lambda flags: np.diff(per_doc(flags)[offsets])
    blank = (kind & 1).astype(bool)
    begin = ~blank
    begin[1:] &= blank[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[firsts] = ~blank[firsts]
    finish = ~blank
    finish[:-1] &= blank[1:]
    finish[firsts[1:] - 1] = ~blank[firsts[1:] - 1]
    finish[-1] = not blank[-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    out = {"n_words": in_doc(begin), "word_chars": in_doc(~blank & (kind & 128 == 0)), "n_symbols": in_doc(kind & 2 != 0)}

    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.take(_MARKS, raw) * powers(FACTOR, n)[:n], out=sums[1:])
    back = powers(BASE_INVERSE, n)

    def marks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64) * _STEP)

    words = np.searchsorted(starts, offsets)  # first word of each text
    own = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(words))
    count = len(starts)
    repeated = np.zeros(count + 1, np.int64)
    if count >= PASSAGE:
        word = numbered(marks(starts, ends), raw, starts, ends - starts)
        of_word = _mixed(word.astype(np.uint64))
        passage = np.zeros(count - PASSAGE + 1, np.uint64)
        for k in range(PASSAGE):
            passage = passage * _STEP + of_word[k : count - PASSAGE + 1 + k]
        inside = np.flatnonzero(own[: count - PASSAGE + 1] == own[PASSAGE - 1 :])
        passage = _mixed(passage[inside] + _mixed(own[inside] + np.uint64(1)))
        # Only places whose marks come twice are compared: their text's number, then their words' numbers.
        some = _repeated(passage)[0]
        inside, passage = inside[some], passage[some]
        rows = np.concatenate([own[inside].astype(np.int64)[:, None], word[inside[:, None] + np.arange(PASSAGE)]], axis=1)
        twice, _ = _repeated(numbered(passage, rows.ravel(), np.arange(len(rows)) * rows.shape[1], np.full(len(rows), rows.shape[1])))
        at = inside[twice]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + PASSAGE, -1)
    out["n_repeat_words"] = np.diff(per_doc(np.cumsum(repeated)[:count] > 0)[words])

    newline = np.flatnonzero(kind & 64)
    line_starts = np.union1d(firsts, newline + 1)
    line_starts = line_starts[line_starts < n]
    breaks = np.zeros(n + 1, bool)
    breaks[newline] = True
    breaks[offsets] = True
    stops = np.flatnonzero(breaks)
    line_starts = line_starts[kind[line_starts] & 64 == 0]  # the others are empty
    line_ends = stops[np.searchsorted(stops, line_starts, side="right")]
    wordy = per_doc(begin)[line_ends] > per_doc(begin)[line_starts]
    line_starts, line_ends = line_starts[wordy], line_ends[wordy]
    of_line = np.searchsorted(offsets, line_starts, side="right") - 1
    line = numbered(marks(line_starts, line_ends), raw, line_starts, line_ends - line_starts)
    _, later = _repeated(line * docs + of_line)
    out["n_dup_lines"] = np.bincount(of_line[later], minlength=docs)
    lines = np.bincount(of_line, minlength=docs)

    w, c = np.maximum(out["n_words"], 1), np.maximum(out["word_chars"], 1)
    out |= {
        "symbols": out["n_symbols"] / c,
        "dup_lines": out["n_dup_lines"] / np.maximum(lines, 1),
        "repeats": out["n_repeat_words"] / w,
        "word_length": out["word_chars"] / w,
        "capitals": in_doc(kind & 4 != 0) / c,
        "digits": in_doc(kind & 8 != 0) / c,
        "exclamations": in_doc(kind & 16 != 0) / w,
        "stops": in_doc(kind & 32 != 0) / w,
        "line_words": out["n_words"] / np.maximum(lines, 1),
    }
    return out


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def _expected(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Complete binary trees as arrays: feature, threshold, and path length where a row ends."""

    feature: np.ndarray  # (trees, nodes); -1 at an end
    threshold: np.ndarray
    length: np.ndarray
    sample: int
    ranges: np.ndarray
    limit: float = np.inf  # scores above are rejected

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): over a half is unusual."""
        rows = excess(rows, self.ranges)
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        depth = int(np.log2(self.feature.shape[1] + 1)) - 1
        for f, t, length in zip(self.feature, self.threshold, self.length):
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                here = f[node]
                go = here >= 0
                node = np.where(go, 2 * node + 1 + (rows[every, np.maximum(here, 0)] >= t[node]), node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / float(_expected(self.sample)))


def grow(rows: np.ndarray, ranges: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 0) -> Forest:
    """An isolation forest on ``rows`` (documents by statistics), as far as they are outside ``ranges``. Of enough rows, none
    is in two trees' samples."""
    rng = np.random.default_rng(seed)
    rows = excess(rows, ranges)
    sample = max(2, min(sample, len(rows)))
    depth = int(np.ceil(np.log2(sample)))
    nodes = 2 ** (depth + 1) - 1
    feature, threshold, length = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    own_rows = rng.permutation(len(rows)) if len(rows) >= trees * sample else None
    for k in range(trees):
        if own_rows is not None:
            here = {0: own_rows[k * sample : (k + 1) * sample]}
        else:
            here = {0: rng.choice(len(rows), sample, replace=False) if len(rows) >= sample else np.arange(len(rows))}
        for node in range(nodes):
            own = here.pop(node, None)
            if own is None:
                continue
            level = int(np.log2(node + 1))
            x = rows[own]
            low, high = (x.min(axis=0), x.max(axis=0)) if len(own) else (np.zeros(1), np.zeros(1))
            varied = np.flatnonzero(high > low)
            if level == depth or len(own) <= 1 or not len(varied):
                length[k, node] = level + float(_expected(len(own)))
                continue
            f = rng.choice(varied)
            t = rng.uniform(low[f], high[f])
            right = x[:, f] >= t
            feature[k, node], threshold[k, node] = f, t
            here[2 * node + 1], here[2 * node + 2] = own[~right], own[right]
    return Forest(feature, threshold, length, sample, ranges)


def calibrate(forest: Forest, scores: np.ndarray, good: np.ndarray, price: float = 20.0) -> Forest:
    """Sets the limit at the least cost on labelled rows: a good one lost costs as much as ``price`` bad ones kept."""
    cuts = np.append(np.unique(scores), np.inf)
    lost = price * (good.sum() - np.searchsorted(np.sort(scores[good]), cuts, side="right"))
    kept = np.searchsorted(np.sort(scores[~good]), cuts, side="right")
    cost = lost + kept
    best = len(cost) - 1 - int(np.argmin(cost[::-1]))  # the highest of equals
    cut = cuts[best]
    over = cuts[best + 1] if best + 1 < len(cuts) else np.inf
    limit = (cut + over) / 2 if np.isfinite(over) else (np.inf if not (~good).any() else cut)
    return replace(forest, limit=float(limit))


def _matrix(s: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.asarray(s[c], float) for c in SHARES], axis=1)


def ordinary(rows: np.ndarray, tail: float = 0.0005) -> np.ndarray:
    """(low, high, width) of each statistic's ordinary range: the rules that :func:`excess` measures."""
    low, high = np.quantile(rows, [tail, 1 - tail], axis=0)
    return np.stack([low, high, np.maximum(high - low, 1e-3)])


def excess(rows: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """How far each statistic is outside its range, in widths of the range; at most 4, inside 0."""
    low, high, width = ranges
    return np.minimum(np.maximum(np.maximum(rows - high, low - rows), 0) / width, 4)


def _with_statistics(documents: DataFrame, more: list[str]) -> DataFrame:
    ship(documents.sparkSession)
    kinds = {c: documents.schema[c].dataType.simpleString() for c in ["doc_id", *more]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            s = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kinds), *(pa.array(s[c]) for c in STATISTICS)], names=[*kinds, *STATISTICS])

    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), *(f"{c} {'bigint' if c in BASE else 'double'}" for c in STATISTICS)])
    return documents.select("text", *kinds).mapInArrow(run, schema)


def ordinary_of(rows: DataFrame, tail: float = 0.0005) -> np.ndarray:
    """:func:`ordinary` of all rows of a table with SHARES, by their exact ranks.

    Only the different values of both tails come to the driver, some thousandth of the rows: up to where an approximate
    quantile surely is beyond the rank that is looked for.
    """
    n = rows.count()
    at = (n - 1) * tail
    far, cover = 2 * tail + 3 / n, 0
    while cover < min(n, int(at) + 2):
        ends = rows.agg(*[F.percentile_approx(c, [min(far, 1.0), max(1 - far, 0.0)], 10_000).alias(c) for c in SHARES]).first()
        value = lambda c, side, inside: F.when(inside, F.struct(F.lit(c).alias("c"), F.lit(side).alias("side"), F.col(c).alias("x")))
        both = [v for c in SHARES for v in (value(c, 0, F.col(c) <= ends[c][0]), value(c, 1, F.col(c) >= ends[c][1]))]
        tails = rows.select(F.explode(F.array_compact(F.array(*both))).alias("v")).groupBy("v.c", "v.side", "v.x").count().toPandas()
        cover = tails.groupby(["c", "side"])["count"].sum().min()
        far *= 2
    out = np.empty((2, len(SHARES)))
    for (c, side), own in tails.groupby(["c", "side"]):
        own = own.sort_values("x", ascending=side == 0)
        near, next_ = own["x"].to_numpy()[np.searchsorted(own["count"].to_numpy().cumsum(), [int(at), min(int(at) + 1, n - 1)], side="right")]
        out[side, SHARES.index(c)] = near + (next_ - near) * (at - int(at))
    return np.stack([*out, np.maximum(out[1] - out[0], 1e-3)])


def calibrate_on(forest: Forest, rows: DataFrame, price: float = 20.0, parts: int = 1024) -> Forest:
    """:func:`calibrate` on all rows of a table with SHARES and ``label``.

    Scores are cut into ``parts``; in each, running sums find the least cost, which rows of other parts raise or lower for
    all its cuts alike. So one row of each part comes to the driver.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in SHARES], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(forest.scores(x)), batch.column("label")], names=["score", "label"])

    scored = rows.select(*SHARES, F.col("label").cast("int")).mapInArrow(run, "score double, label int")
    per = scored.groupBy("score").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
    per = per.withColumn("part", F.floor(F.col("score") * parts))
    upto = Window.partitionBy("part").orderBy("score")
    cost = F.sum("bad").over(upto) - price * F.sum("good").over(upto)
    per = per.select("*", F.struct(cost.alias("cost"), (-F.col("score")).alias("score"), F.lead("score").over(upto).alias("over")).alias("at"))
    got = per.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("score").alias("first"), F.min("at").alias("at")).orderBy("part").collect()
    before, best = 0.0, (np.inf, 0.0, np.inf)
    for r, after in zip(got, [*(x["first"] for x in got[1:]), np.inf]):
        over = after if r["at"]["over"] is None else r["at"]["over"]
        best = min(best, (before + r["at"]["cost"], r["at"]["score"], over))  # the highest of equals
        before += r["bad"] - price * r["good"]
    return replace(forest, limit=float((best[2] - best[1]) / 2))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, seed: int = 0, trees: int = 100, sample: int = 256) -> Forest:
    """A forest whose trees' samples, ``sample`` documents each, are drawn from all documents, whatever their labels, by a hash
    of the id. Its limit is set on all labelled ones, whose good ones also give the ordinary ranges.

    Documents that the fixed limits reject take no part, nor do labels whose id's crc32 is ``held_out`` modulo
    ``modulus``: these measure what the forest is worth. A repeated id counts once, by its least statistics. Without labelled
    rows nothing is unusual.
    """
    passed = _with_statistics(texts(documents.where("doc_id is not null")), []).where("n_words >= 20 and 100 * n_repeat_words <= 30 * n_words")
    once = passed.groupBy("doc_id").agg(F.min(F.struct(*SHARES)).alias("s")).select("doc_id", "s.*")
    marked = learning_rows(labels, modulus, held_out).where(f"{label} in (0, 1)").groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    every = staged(once.join(marked, "doc_id", "left"), "statistics")
    known = every.where("label is not null")
    good = known.where("label = 1")
    if good.limit(2).count() < 2:
        none = np.zeros((2, len(SHARES)))
        forest = grow(none, ordinary(none), trees=1, seed=seed)
    else:
        ranges = ordinary_of(good)
        most, mark = trees * sample, F.xxhash64("doc_id", F.lit(seed))
        share = (most + 6 * most**0.5 + 10) / every.count()  # of the marks: some more rows than are drawn, so that few are sorted
        some = every.where(mark < int(share * 2.0**64) - 2**63) if share < 0.99 else every
        drawn = some.orderBy(mark, "doc_id").limit(most).select(*SHARES).toPandas()
        forest = calibrate_on(grow(drawn.to_numpy(float), ranges, trees, sample, seed), known)
    drop(every)
    return forest


def apply(documents: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id``, the five base statistics, ``base_failed``, ``kept`` and the forest's ``anomaly`` of every row.

    Null texts have no words and fail. Rows keep their number and multiplicity; other columns are ignored.
    """
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            s = statistics(part.column("text"))
            failed, anomaly = base_failed(s), forest.scores(_matrix(s))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(s[c], pa.int64()) for c in BASE), pa.array(failed), pa.array(~failed & (anomaly <= forest.limit)), pa.array(anomaly)],
                names=["doc_id", *BASE, "base_failed", "kept", "anomaly"],
            )

    return texts(documents).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in BASE)}, base_failed boolean, kept boolean, anomaly double")


def keep(documents: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``documents``, all columns, that neither fixed limits nor the forest reject."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            s = statistics(pa.compute.fill_null(part.column("text"), ""))
            ok = ~base_failed(s)
            ok &= forest.scores(_matrix(s)) <= forest.limit
            yield part.filter(pa.array(ok))

    return documents.mapInArrow(run, documents.schema)
