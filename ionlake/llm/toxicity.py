"""Toxicity by a convolutional classifier: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the sum of the embeddings of its hashed features: the word and its first 3 to 6
letters, so that endings and rare forms share what their stems teach. Filters of width 1, 2 and 3 slide over
the words; each keeps its largest value over the whole text, and a logistic layer reads these, its bias moved so that
the best threshold of a fifth of the labelled rows, kept aside, is the one in use. Training is plain numpy (Adam) on all
labelled rows, cut into parts: one part is trained first, then all parts go on from there side by side, and the means of
what they changed are the next round's start. The driver only ever holds the model; scoring streams over whole texts in
blocks.
"""

from __future__ import annotations

import copy
import itertools
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import Scratch, slices, text_of

_WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dims: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 8
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-5
    seed: int = 7
    #: Labelled rows, and bytes of their texts, that a part of the training has about; fewer are one part.
    part_rows: int = 5000
    part_bytes: int = 128 << 20
    #: Rounds in which all parts go over their rows once, and the rate there.
    rounds: int = 2
    round_rate: float = 0.0025
    #: Steps that training takes at least, by more epochs, when there are few rows.
    least_steps: int = 1500
    #: Share of a text's words that every second training step on it leaves out, by chance: so that not only its
    #: strongest word learns.
    dropped: float = 0.5
    #: Words of one training text that are used at once; longer ones are cut into windows of this many, and all are used.
    window: int = 2000
    threshold: float = 0.3
    least_a_language: int = 40


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


_HEAD = zlib.crc32(b"^")


def features_of(word: str, buckets: int) -> list[int]:
    """Bucket 0 is padding. Every word has the same number of features; short ones repeat the whole word."""
    return features_of_all([word], buckets)[0].tolist()


def features_of_all(words: list[str], buckets: int) -> np.ndarray:
    """(words, features): the whole word and its first 3 to 6 letters behind a mark."""
    whole = list(map(zlib.crc32, map(str.encode, words)))
    heads = ([zlib.crc32(w[:k].encode(), _HEAD) if len(w) >= k else h for w, h in zip(words, whole, strict=True)] for k in (3, 4, 5, 6))
    return 1 + np.array([whole, *heads], dtype=np.int64).T % (buckets - 1)


@dataclass
class Model:
    settings: Settings
    embed: np.ndarray
    kernels: list[np.ndarray]  # of each width: (width, dims, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def projected(self) -> np.ndarray:
        """What a feature adds to each filter at each offset: (buckets, offsets of all widths * filters)."""
        return np.concatenate([self.embed @ k[j] for k in self.kernels for j in range(len(k))], axis=1).astype(np.float32)


class Scorer:
    """Scores texts; keeps the projections of words it has met, up to a bound."""

    #: Places that are looked at together, of many short texts or of one long one.
    BLOCK = 20_000

    def __init__(self, model: Model, kept: int = 300_000) -> None:
        self.model, self.table, self.kept = model, model.projected(), kept
        self.known: dict[str, int] = {"": 0}
        self.rows = np.zeros((kept + 1, self.table.shape[1]), dtype=np.float32)  # row 0: padding

    def _ids(self, words: list[str]) -> np.ndarray:
        fresh = list(set(words).difference(self.known))
        if len(self.known) + len(fresh) > self.kept:
            self.known = {"": 0}
            fresh = list(set(words).difference(self.known))
        if fresh:
            at = len(self.known)
            self.rows[at : at + len(fresh)] = self.table[features_of_all(fresh, self.model.settings.buckets)].sum(axis=1)
            self.known.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def pooled(self, texts: list[list[str]]) -> np.ndarray:
        """Each filter's largest value over each text (a row), whose words stand between paddings."""
        s = self.model.settings
        pad = [""] * (max(s.widths) - 1)
        flat = [*itertools.chain.from_iterable(part for words in texts for part in (pad, words)), *pad]
        ends = np.cumsum([len(pad) + len(words) for words in texts])
        starts, best = np.append(0, ends[:-1]), np.full((len(texts), s.filters * len(s.widths)), -np.inf, dtype=np.float32)
        for at in range(0, int(ends[-1]), self.BLOCK):
            n = min(self.BLOCK, int(ends[-1]) - at)
            shares, total, column = self.rows[self._ids(flat[at : at + n + len(pad)])], np.zeros((n, best.shape[1]), dtype=np.float32), 0
            for i, width in enumerate(s.widths):
                for j in range(width):
                    total[:, i * s.filters : (i + 1) * s.filters] += shares[j : j + n, column : column + s.filters]
                    column += s.filters
            first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, at + n)
            best[first:last] = np.maximum(best[first:last], np.maximum.reduceat(total, np.maximum(starts[first:last] - at, 0), axis=0))
        return best

    def scores(self, texts: list[str]) -> list[float]:
        m = self.model
        if not texts:
            return []
        hidden = np.maximum(self.pooled(list(map(words_of, texts))) + m.bias, 0)
        return [float(1 / (1 + np.exp(-np.clip(row @ m.out + m.out_bias, -30, 30)))) for row in hidden]

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def class_weight(rows: int, positive: int) -> float:
    return min(3.0, max(1.0, (rows - positive) / max(1, positive)))


def train(texts: list[str], labels: np.ndarray, settings: Settings, start: Model | None = None, weight: float | None = None, turn: int = 0) -> Model:
    """Adam on the log loss, classes weighed alike up to a factor of 3. Runs agree: one seed, one order.

    From a model to ``start`` with it is one pass at ``round_rate``; ``weight`` is what a toxic row counts, if it is known.
    """
    s = settings
    rng = np.random.default_rng([s.seed, turn] if start else s.seed)
    model = Model(
        s,
        rng.normal(0, 0.1, (s.buckets, s.dims)),
        [rng.normal(0, 1 / np.sqrt(w * s.dims), (w, s.dims, s.filters)) for w in s.widths],
        np.zeros(s.filters * len(s.widths)),
        rng.normal(0, 0.3, s.filters * len(s.widths)),
        -1.0,
    ) if start is None else copy.deepcopy(start)
    rate = s.round_rate if start else s.rate
    model.embed[0] = 0
    vocabulary: dict[str, int] = {"": 0}
    pieces = []
    for text, label in zip(texts, labels, strict=True):
        words = words_of(text)
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int32)
        windows = [ids[a : a + s.window] for a in range(0, max(1, len(ids)), s.window)]
        pieces.append((windows, float(label)))
    feats = features_of_all(list(vocabulary), s.buckets)
    feats[0] = 0
    positive = max(1, int((labels > 0).sum()))
    weight = weight or class_weight(len(labels), positive)
    pad = max(s.widths) - 1
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("bias", model.bias), ("out", model.out), *((f"k{i}", k) for i, k in enumerate(model.kernels)))}
    first, second, out_moment = np.zeros_like(model.embed), np.zeros_like(model.embed), np.zeros(2)
    step = 0

    def adam(value, grad, m):
        m[0] *= 0.9
        m[0] += 0.1 * grad
        m[1] *= 0.99
        m[1] += 0.01 * grad * grad
        value -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)

    for _ in range(1 if start else max(s.epochs, -(-s.least_steps * s.batch // max(1, len(pieces))) if pieces else 0)):
        order = rng.permutation(len(pieces))
        for at in range(0, len(order), s.batch):
            step += 1
            grads = {k: np.zeros_like(m[0]) for k, m in moments.items()}
            touched, pulled, out_grad = [], [], 0.0
            chosen = order[at : at + s.batch]
            stacked = np.concatenate([k[j] for k in model.kernels for j in range(len(k))], axis=1)
            for p in chosen:
                windows, label = pieces[p]
                share = s.dropped if rng.random() < 0.5 else 0.0
                best, spots = np.full(len(model.out), -np.inf), np.zeros((len(model.out), pad + 1), dtype=np.int64)
                for ids in windows:
                    ids = np.where(rng.random(len(ids)) < share, 0, ids) if share else ids
                    padded = np.concatenate([np.zeros(pad, np.int32), ids, np.zeros(pad, np.int32)])
                    unique, back = np.unique(padded, return_inverse=True)
                    shares, column = (model.embed[feats[unique]].sum(axis=1) @ stacked)[back], 0
                    for i, width in enumerate(s.widths):
                        n, part = len(padded) - width + 1, slice(i * s.filters, (i + 1) * s.filters)
                        total = shares[:n, column : column + s.filters].copy()
                        for j in range(1, width):
                            total += shares[j : j + n, column + j * s.filters : column + (j + 1) * s.filters]
                        column += width * s.filters
                        top, most = total.argmax(axis=0), total.max(axis=0)
                        better = most > best[part]
                        best[part] = np.where(better, most, best[part])
                        found = padded[top[:, None] + np.arange(width)]
                        spots[part, :width] = np.where(better[:, None], found, spots[part, :width])
                hidden = best + model.bias
                live = hidden > 0
                chance = 1 / (1 + np.exp(-np.clip(np.where(live, hidden, 0) @ model.out + model.out_bias, -30, 30)))
                pull = (chance - label) * (weight if label else 1.0) / len(chosen)
                grads["out"] += pull * np.where(live, hidden, 0)
                out_grad += pull
                back_to = pull * model.out * live
                grads["bias"] += back_to
                for i, width in enumerate(s.widths):
                    part = slice(i * s.filters, (i + 1) * s.filters)
                    for j in range(width):
                        rows = feats[spots[part, j]]
                        grads[f"k{i}"][j] += (model.embed[rows].sum(axis=1) * back_to[part, None]).T
                        touched.append(rows)
                        pulled.append(back_to[part, None] * model.kernels[i][j].T)
            for i, kernel in enumerate(model.kernels):
                adam(kernel, grads[f"k{i}"] + s.decay * kernel, moments[f"k{i}"])
            adam(model.bias, grads["bias"], moments["bias"])
            adam(model.out, grads["out"] + s.decay * model.out, moments["out"])
            out_moment = 0.9 * out_moment + np.array([0.1 * out_grad, 0.0])
            model.out_bias -= rate * float(out_moment[0]) * 10
            at_rows = np.concatenate(touched)
            rows, back = np.unique(at_rows, return_inverse=True)
            grad = np.zeros((len(rows), s.dims))
            np.add.at(grad, back.reshape(at_rows.shape), np.concatenate(pulled)[:, None, :])
            first[rows] = 0.9 * first[rows] + 0.1 * grad
            second[rows] = 0.99 * second[rows] + 0.01 * grad * grad
            model.embed[rows] -= rate * (first[rows] / (1 - 0.9**step)) / (np.sqrt(second[rows] / (1 - 0.99**step)) + 1e-7)
            model.embed[0] = 0
    return model


def best_cut(hits: np.ndarray, counts: np.ndarray, lows: np.ndarray, highs: np.ndarray, otherwise: float) -> float:
    """The middle of the widest gap between groups of scores, the highest first, at which F1 is largest; a group stays together."""
    hit, n = np.cumsum(hits), np.cumsum(counts)
    if not len(hit) or not hit[-1] or hit[-1] == n[-1]:
        return otherwise
    f1 = 2 * hit / (n + hit[-1])
    top = np.flatnonzero(f1 == f1.max())
    below = np.append(highs[1:], 0.0)
    k = top[np.argmax(lows[top] - below[top])]
    return float((lows[k] + below[k]) / 2)


def best_threshold(scores: np.ndarray, labels: np.ndarray, otherwise: float) -> float:
    values, at = np.unique(-scores, return_inverse=True)
    return best_cut(np.bincount(at, labels > 0, len(values)), np.bincount(at, minlength=len(values)), -values, -values, otherwise)


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(rows: list[tuple[int, str, str, int]], settings: Settings) -> Model:
    """The model of (doc_id, text, lang, label) rows, with its thresholds by language."""
    rows = sorted(rows)
    y = np.array([r[3] for r in rows], dtype=float)
    aside = np.array([zlib.crc32(f"aside {r[0]}".encode()) % 5 == 0 for r in rows], dtype=bool)
    model = train([r[1] for r, a in zip(rows, aside, strict=True) if not a], y[~aside], settings)
    scorer = Scorer(model)
    scores = np.array(scorer.scores([r[1] for r, a in zip(rows, aside, strict=True) if a]))
    held, langs = y[aside], np.array([r[2] for r, a in zip(rows, aside, strict=True) if a], dtype=object)
    #: The best threshold of all languages together is moved to ``threshold``.
    logit = lambda p: np.log(p / (1 - p))
    middle = np.clip(best_threshold(scores, held, settings.threshold), 1e-6, 1 - 1e-6)
    model.out_bias += float(logit(settings.threshold) - logit(middle))
    clipped = np.clip(scores, 1e-12, 1 - 1e-12)
    scores = 1 / (1 + np.exp(-(logit(clipped) + logit(settings.threshold) - logit(middle))))
    for lang in sorted(set(langs)):
        if (mine := langs == lang).sum() >= settings.least_a_language:
            model.thresholds[lang] = best_threshold(scores[mine], held[mine], settings.threshold)
    model.embed = model.embed.astype(np.float32)
    return model


#: Bins of the logits of scores, by which thresholds of many rows are found.
BINS = 1 << 16


def _cuts(scored: DataFrame, settings: Settings) -> dict[str | None, float]:
    """The best threshold of all rows (lang, toxic, score) together, under None, and of each language that has enough.

    The rows are counted in BINS bins of their logits; what follows works on one row a bin.
    """
    logit = F.log(F.col("score") / (1 - F.col("score")))
    each = scored.withColumn("bin", F.floor((F.coalesce(logit, F.lit(0.0)) + 30) * (BINS / 60))).select(F.explode(F.array(F.struct(F.lit(True).alias("every"), F.lit("").alias("lang")), F.struct(F.lit(False).alias("every"), "lang"))).alias("g"), "toxic", "score", "bin")
    bins = each.groupBy("g.every", "g.lang", "bin").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))

    def found(rows):
        rows = rows.sort_values("bin", ascending=False)
        at = best_cut(*(rows[c].to_numpy() for c in ("hits", "n", "low", "high")), settings.threshold)
        return rows.iloc[:1][["every", "lang"]].assign(n=int(rows["n"].sum()), at=at)

    made = bins.groupBy("every", "lang").applyInPandas(found, "every boolean, lang string, n long, at double").where(f"every or n >= {settings.least_a_language}").collect()
    return {None if r["every"] else r["lang"]: r["at"] for r in made}


#: Deltas are added as whole numbers of this size, so that their sums do not depend on their order.
_UNIT = 2.0**-36


def _dense(model: Model) -> np.ndarray:
    return np.concatenate([*(k.ravel() for k in model.kernels), model.bias, model.out, [model.out_bias]])


def _moved(model: Model, rows: np.ndarray, changes: np.ndarray) -> Model:
    """The model after mean changes: of rows of the embedding (row >= 0) and, in rows before 0, of all other values."""
    s, out = model.settings, copy.deepcopy(model)
    dense = _dense(model)
    flat = np.zeros(-(-len(dense) // s.dims) * s.dims)
    for row, change in zip(rows[rows < 0], changes[rows < 0], strict=True):
        flat[(-1 - row) * s.dims : -row * s.dims] = change
    dense, at = dense + flat[: len(dense)], 0
    for i, kernel in enumerate(model.kernels):
        out.kernels[i] = dense[at : at + kernel.size].reshape(kernel.shape)
        at += kernel.size
    out.bias, out.out, out.out_bias = dense[at : at + len(model.bias)], dense[at + len(model.bias) : -1], float(dense[-1])
    out.embed[rows[rows >= 0]] += changes[rows >= 0]
    return out


def _changes(before: Model, after: Model) -> tuple[np.ndarray, np.ndarray]:
    """The rows that ``_moved`` takes, with the changes in units."""
    dims = before.settings.dims
    rows = np.flatnonzero((after.embed != before.embed).any(axis=1))
    dense = _dense(after) - _dense(before)
    dense = np.append(dense, np.zeros(-len(dense) % dims)).reshape(-1, dims)
    both = np.concatenate([after.embed[rows] - before.embed[rows], dense])
    return np.concatenate([rows, -1 - np.arange(len(dense))]), np.rint(both / _UNIT).astype(np.int64)


def _by_part(rows: DataFrame, parts: int, made, schema: str) -> DataFrame:
    """What ``made`` (part, texts, labels) gives for each part of (part, order, doc_id, k1, k2, text, toxic), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, texts, labels = None, [], []
        for batch in batches:
            for p, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("part", "text", "toxic")), strict=True):
                if texts and p != part:
                    yield made(part, texts, np.array(labels, dtype=float))
                    texts, labels = [], []
                part = p
                texts.append(text)
                labels.append(toxic)
        if texts:
            yield made(part, texts, np.array(labels, dtype=float))

    ordered = rows.repartition(parts, "part").sortWithinPartitions("part", "order", "doc_id", "k1", "k2")
    return ordered.select("part", "text", "toxic").mapInArrow(run, schema)


def _trained_by_parts(rows: DataFrame, parts: int, weight: float, settings: Settings) -> Model:
    """Trains on all of ``rows``: part 0 as if it were all, then every part goes on from the same model, a pass a round,
    and the means of their changes make the next one; a word's is that of the parts that changed it."""
    spark = rows.sparkSession
    first = lambda part, texts, labels: pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, labels, settings, weight=weight))], pa.binary())], names=["model"])
    least = rows.agg(F.min("part")).first()[0]
    model = pickle.loads(_by_part(rows.where(F.col("part") == least), 1, first, "model binary").collect()[0]["model"])
    for turn in range(settings.rounds):
        sent = spark.sparkContext.broadcast(model)

        def on(part, texts, labels, sent=sent, turn=turn):
            at, changes = _changes(sent.value, train(texts, labels, settings, sent.value, weight, turn * parts + part))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, changes.size + 1, settings.dims, dtype=np.int32)), pa.array(changes.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), lists], names=["row", "change"])

        sums = _by_part(rows, parts, on, "row long, change array<long>").groupBy("row").agg(F.count("*").alias("n"), *(F.sum(F.col("change")[k]).alias(f"c{k}") for k in range(settings.dims)))
        found = sums.orderBy("row").toArrow()
        columns = [c.to_numpy() for c in found.columns]
        model = _moved(model, columns[0], np.stack(columns[2:], axis=1) * (_UNIT / columns[1][:, None]))
    return model


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Trains on all labelled rows that are not held out.

    A document labelled more than once counts as toxic if any label says so; null labels are left out. Rows that
    share an id share its label, equal rows count once. With no labelled rows the model scores by its start values.
    The thresholds by language maximise F1 on a fifth of the rows that training does not see; languages with too
    few rows use ``threshold``. Rows that make one part are trained in one task.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy(F.col("doc_id").alias("of")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).join(known, F.col("doc_id") == F.col("of"))
    once = found.withColumn("order", F.xxhash64("doc_id")).groupBy("order", "doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")).agg(F.first("text").alias("text"), F.min("lang").alias("lang"), F.max("toxic").alias("toxic"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    once, path = scratch.write(once.withColumn("aside", F.crc32(F.concat(F.lit("aside "), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0))
    size = once.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if(~F.col("aside")).alias("seen"), F.count_if(~F.col("aside") & (F.col("toxic") > 0)).alias("toxic")).first()
    parts = max(1, -(-size["n"] // settings.part_rows), -(-size["bytes"] // settings.part_bytes))
    if not size["n"]:
        model = trained([], settings)
    elif parts == 1 or not size["seen"]:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang", "toxic")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained(rows, settings))], pa.binary())], names=["model"])

        few = once.select("doc_id", "text", "lang", "toxic").coalesce(1)
        model = pickle.loads(few.mapInArrow(run, "model binary").collect()[0]["model"])
    else:
        rows = once.where("not aside").withColumn("part", F.pmod(F.xxhash64("doc_id", "k1", F.lit(3)), F.lit(parts)))
        model = _trained_by_parts(rows, parts, class_weight(size["seen"], size["toxic"]), settings)
        scored = scratch.keep(_scored(once.where("aside"), model, "toxic"))
        cuts = _cuts(scored, settings)
        logit = lambda p: float(np.log(p / (1 - p)))
        within = lambda p: min(max(p, 1e-6), 1 - 1e-6)
        shift = logit(settings.threshold) - logit(within(cuts.pop(None, settings.threshold)))
        model.out_bias += shift
        model.thresholds = {lang: float(1 / (1 + np.exp(-logit(within(at)) - shift))) for lang, at in sorted(cuts.items())}
        model.embed = model.embed.astype(np.float32)
    scratch.drop(scratch.root)
    return model


def _scored(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, lang, ``more`` (whole numbers) and the scores of the texts."""
    sent, names = docs.sparkSession.sparkContext.broadcast(model), ["doc_id", "lang", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches, "text", 1 << 20):
            found = pa.array(scorer.scores(batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), found], names=[*names, "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), *(F.col(c).cast("int") for c in more), text_of().alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", "lang string", *(f"{c} int" for c in more), "score double"]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold, toxic_in_lang for every row.

    The score reads the text alone (null: empty); ``predicted`` compares it with the fixed threshold,
    ``toxic_in_lang`` with that of the row's language. Null ids are kept and count as not held out.
    """
    s, scored = model.settings, _scored(docs, model)
    by_lang = F.lit(s.threshold)
    for lang, at in model.thresholds.items():
        by_lang = F.when(F.coalesce("lang", F.lit("")) == lang, at).otherwise(by_lang)
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= s.threshold).cast("int").alias("predicted"),
        by_lang.alias("lang_threshold"),
        (F.col("score") >= by_lang).alias("toxic_in_lang"),
    )


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays below the threshold.

    A null text is an empty one and has the score of no words; null ids, repeats and empty tables need nothing special,
    as a row is judged by its text alone. Texts are read whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([x < model_threshold for x in scorer.scores([t or "" for t in texts])], pa.bool_()))

    model_threshold = model.settings.threshold
    return docs.mapInArrow(run, docs.schema)
