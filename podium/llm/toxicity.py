"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

Texts are cut into windows of whole words. A window that compresses better with the toxic dictionary than with the
ordinary one is closer to toxic text. How many windows of a document gain or lose how much becomes its
score through a logistic curve that is calibrated on labelled rows.

Most words of toxic texts are ordinary ones. So each dictionary is trained on those windows of its own class that could be
taken for toxic: windows that gain with dictionaries trained on other documents, as repeated rounds choose them.
Both dictionaries are equally long, and both end with the same part, trained on ordinary text, without which
common words would cost more in one than in the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import chunks, drop, is_held_out, labelled, learning_rows, ship, staged, texts

#: Bytes of a window; of the dictionaries' common part; of their own part in each round, and in the end.
WINDOW, COMMON, OWN = 40, 500_000, (16384, 8192, 4096, 2048, 2048)
#: Part of the toxic windows that a round passes on; ordinary windows for each toxic one.
PASSED, ORDINARY = (0.1, 0.06, 0.04, 0.03), 6
#: Windows of a document that are learnt from, and of a class in all.
SAMPLE, MOST = 64, 120_000
#: Gains of a window that are counted.
LEVELS = (1, 2, 3, 4, 6, 8, -1, -2, -4)
#: Parts of the labelled rows; each is scored by dictionaries of the others for the calibration.
FOLDS = 3

_WINDOW = re.compile(rb"\S(?:.{0,%d}\S)?(?=\s|$)|\S{1,%d}" % (WINDOW - 2, WINDOW), re.S)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = ()
    bias: float = 0.0


def windows(text: bytes) -> list[bytes]:
    """Runs of whole words, as many to a window as fit; a longer word is cut. Every word of the text is in one."""
    return _WINDOW.findall(text)


@lru_cache(maxsize=2 * (FOLDS + 1))
def _compressor(dictionary: bytes):
    import zstandard

    # Tables that hold every place of a dictionary: else its end would push out what it begins with.
    params = zstandard.ZstdCompressionParameters(
        window_log=20, hash_log=20, chain_log=20, search_log=5, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def _gains(toxic, ordinary, some: list[bytes]) -> np.ndarray:
    a, b = toxic.compress, ordinary.compress
    return np.array([len(b(w)) - len(a(w)) for w in some], np.int64)


def gains(model: Model, text: bytes) -> np.ndarray:
    """Of each window: how many bytes shorter it gets with the toxic dictionary than with the ordinary one."""
    return _gains(_compressor(model.toxic), _compressor(model.ordinary), windows(text))


def features(model: Model, text: bytes) -> list[float]:
    """How many windows gain or lose at least each of LEVELS, and which share they are; zeros for a text without words."""
    g = gains(model, text.lower())
    over = np.array([(g >= v).sum() if v > 0 else (g <= v).sum() for v in LEVELS], float)
    return [*np.sqrt(over).tolist(), *(over / max(len(g), 1)).tolist()]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of up to ``size`` bytes, smaller where there is too little to train on."""
    import zstandard

    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=20, d=8, f=20, split_point=1.0, accel=1).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b" ".join(samples)[:4096]


def _some(windows: list[bytes], n: int, rng: np.random.Generator) -> list[bytes]:
    return windows if len(windows) <= n else [windows[i] for i in np.sort(rng.choice(len(windows), n, replace=False))]


def train(toxic: list[list[bytes]], ordinary: list[list[bytes]], seed: int = 0) -> Model:
    """Two dictionaries from the windows of toxic and of ordinary documents (lower-case).

    Documents are dealt into two halves. In each round, the dictionaries of one half choose windows of the other half, of
    toxic and ordinary documents by one rule: those with the highest gains. What repeats only within a document, or
    by chance, so falls away round by round.
    """
    rng = np.random.default_rng(seed)
    halves = lambda docs: [[w for d in docs[a::2] for w in d] for a in (0, 1)]
    bad = [_some(h, MOST // 2, rng) for h in halves(toxic)]
    n = max(1, *map(len, bad))
    good = [_some(h, min(ORDINARY * n, 2 * MOST), rng) for h in halves(ordinary)]
    common = _dictionary(good[0] + good[1], COMMON)
    both = lambda own: _compressor.__wrapped__(own + common)
    ours, theirs = bad, [_some(g, n, rng) for g in good]
    for size, part in zip(OWN, PASSED):
        chosen = []
        for a in (0, 1):
            pair = both(_dictionary(ours[a], size)), both(_dictionary(theirs[a], size))
            b, g = bad[1 - a], good[1 - a]
            of_bad, of_good = _gains(*pair, b), _gains(*pair, g)
            least = max(1, int(np.sort(of_bad)[::-1][int(len(b) * part)])) if len(b) else 1
            chosen.append(([b[i] for i in np.flatnonzero(of_bad >= least)], [g[i] for i in np.flatnonzero(of_good >= least)]))
        # Dictionaries of half a are trained on windows of half a, as those of the other half chose them.
        ours = [c[0] or b for c, b in zip(chosen[::-1], bad)]
        theirs = [c[1] if len(c[1]) > 50 else _some(g, n, rng) for c, g in zip(chosen[::-1], good)]
    own = [_dictionary(x[0] + x[1], OWN[-1]) for x in (ours, theirs)]
    size = min(map(len, own))
    return Model(*(o[len(o) - size :] + common for o in own))


def calibrate(model: Model, rows: np.ndarray, toxic: np.ndarray, threshold: float, steps: int = 4000) -> Model:
    """Logistic weights of the features, and a bias that puts ``threshold`` at the best cut of the labelled rows."""
    mean, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-6)
    x = np.concatenate([(rows - mean) / scale, np.ones((len(rows), 1))], axis=1)
    weight = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        g = x.T @ (weight * (1 / (1 + np.exp(-(x @ w))) - toxic))
        g[:-1] += 1e-3 * w[:-1]
        w -= 0.5 * g
    margin = x @ w
    cuts = np.unique(margin)
    wrong = (toxic.sum() - np.searchsorted(np.sort(-margin[toxic]), -cuts, side="right")) + np.searchsorted(np.sort(-margin[~toxic]), -cuts, side="right")
    best = cuts[int(np.argmin(wrong))]
    under = margin[margin < best].max() if (margin < best).any() else best - 1
    shift = np.log(threshold / (1 - threshold)) - (best + under) / 2
    w_raw = w[:-1] / scale
    return replace(model, weights=tuple(float(v) for v in w_raw), bias=float(w[-1] - (w_raw * mean).sum() + shift))


def _prior(toxic: int, n: int) -> Model:
    """The model where there is nothing to tell classes apart by: their share."""
    share = (toxic + 1) / (n + 2)
    return Model(b" ", b" ", (0.0,) * (2 * len(LEVELS)), float(np.log(share / (1 - share))))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", n: int = 3000, modulus: int = 3, held_out: int = 1, threshold: float = 0.7) -> Model:
    """Learns from at most ``n`` labelled documents of each class, none of them held out.

    Texts stay on the executors: of a document at most SAMPLE windows are learnt from, dictionaries are trained in one task
    each, and only they and the rows' features come to the driver. A row's features for the calibration come
    from dictionaries that haven't seen it. Without rows of both classes in every fold scores are the class's share.
    """
    spark = documents.sparkSession
    ship(spark)
    chosen = labelled(documents, learning_rows(labels, modulus, held_out), label, n)
    # Ids of any type; a fold is a hash of the id, so that it doesn't change from run to run.
    chosen = staged(chosen.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("at"), F.encode(F.lower("text"), "UTF-8").alias("text"), (F.col("label") == 1).alias("toxic")), "learnt")
    rows = chosen.withColumn("fold", (F.col("at") % FOLDS).cast("int"))
    have = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    if any(have.get((f, t), 0) < 2 for f in range(FOLDS) for t in (True, False)):
        drop(chosen)
        return _prior(sum(v for (_, t), v in have.items() if t), sum(have.values()))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4 << 20):
            out = []
            for at, text in zip(part.column("at").to_pylist(), part.column("text").to_pylist()):
                out.append(_some(windows(text), SAMPLE, np.random.default_rng(at)))
            yield pa.RecordBatch.from_arrays([part.column("at"), part.column("toxic"), part.column("fold"), pa.array(out, pa.list_(pa.binary()))], names=["at", "toxic", "fold", "windows"])

    def learn(group: pa.Table) -> pa.Table:
        group = group.take(pa.compute.sort_indices(group, [("at", "ascending")]))
        which = group["toxic"].to_numpy()
        docs = group["windows"].to_pylist()
        m = train([d for d, t in zip(docs, which) if t], [d for d, t in zip(docs, which) if not t])
        return pa.table({"model": group["model"].slice(0, 1), "toxic": pa.array([m.toxic], pa.binary()), "ordinary": pa.array([m.ordinary], pa.binary())})

    # One model without each fold, and the last of all rows.
    models = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda m: m != F.col("fold"))
    dealt = rows.mapInArrow(sample, "at bigint, toxic boolean, fold int, windows array<binary>").select("at", "toxic", "windows", F.explode(models).alias("model"))
    got = dealt.groupBy("model").applyInArrow(learn, "model int, toxic binary, ordinary binary").collect()
    trained = {r["model"]: Model(bytes(r["toxic"]), bytes(r["ordinary"])) for r in got}
    sent = spark.sparkContext.broadcast(trained)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4 << 20):
            x = [features(sent.value[f], t) for f, t in zip(part.column("fold").to_pylist(), part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("at"), part.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["at", "toxic", "x"])

    table = rows.mapInArrow(describe, "at bigint, toxic boolean, x array<double>").orderBy("at").toArrow()
    sent.unpersist()
    drop(chosen)
    return calibrate(trained[FOLDS], np.array(table["x"].to_pylist()), table["toxic"].to_numpy(), threshold)


def score(documents: DataFrame, model: Model, modulus: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; null texts are empty, null ids never held out.

    Every word of a text counts. Texts without words have the score of no gains. Rows keep their number and multiplicity;
    other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    weights = np.array(model.weights)
    sent = spark.sparkContext.broadcast(model)  # a megabyte: both dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4 << 20):
            raw = part.column("text").cast(pa.binary()).to_pylist()
            x = np.array([features(sent.value, t) for t in raw])
            s = 1 / (1 + np.exp(-np.clip(x @ weights + model.bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = texts(documents).withColumn("held_out", is_held_out(modulus, held_out))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
