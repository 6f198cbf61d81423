"""Classifiers of quality and toxicity, each by co-training of two views.

The text view sees words (hashed, lower-cased), word endings and repeats of the
word before. The metadata view sees source, language and layout figures (length,
lines, shares of capitals, symbols, digits and white space, distinct words).
Each view is a logistic regression fitted on labelled rows. In each round all
documents without a label are scored by both views; of each view's texts of which
it is most sure (``per_round`` of either label, by a top-k that tasks take first),
the other view learns. Both are then calibrated on labelled rows that were held
out, and the mean of the calibrated log-odds scores every document of the corpus.

Toxicity is a second target, learned alike and in the same rounds, as a few words
in good prose make a text toxic. Its text view sees which words and word beginnings
a text holds, of those that the labels tie to toxicity (a log-likelihood ratio of
``EVIDENCE`` or more, the ``MARKS`` strongest), counted on labelled rows that are
not held out. Its joint log-odds are the sum of both views' less the prior, as most
sources and layouts say nothing of it. A document stays if it is good and not toxic.

Bounds: at most ``max_labelled`` labelled ids for each target, those of smallest
hash and of each the row of smallest text hash, are gathered for fitting (a
documented parameter that does not grow with the corpus), of these as many as have
``max_bytes`` of features, and at most eight times ``per_round`` pseudo-labelled rows
a round, with as many bytes at most. No document with a label, gathered or not, is
given a pseudo-label: their ids go to all tasks up to ``BROADCAST_IDS`` (8 bytes each);
of more, the documents' ids are joined by a shuffle. Rounds and scoring are maps over
all rows; texts do not move unless by that shuffle.

Defined cases: a text without words scores 0, is rejected and teaches nothing; null
source, language and doc_id are values like others; a doc_id with several labels
takes their mean, 0.5 and over being good; labels without a document, and null
labels, are ignored; with labels of one kind only everything with words is kept at
score 1 or rejected at score 0; without toxic labels nothing is toxic, and a mean of
0.5 and over is; equal texts teach once; extra columns, whatever their names, are
ignored; no rows give no rows.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .spark import Scratch, give_back, map_arrow

BITS = 14
TEXT_SIZE = (1 << BITS) + (1 << 12) + 1
SOURCES, LANGS, NUMBERS = 64, 16, 9
META_SIZE = SOURCES + LANGS + NUMBERS
MARK_BITS, MARKS, EVIDENCE = 18, 4096, 14.0
#: Share of held-out rows on which a view has to be right where it is as sure, and how many rows show it.
TRUST, SHOWN = 0.98, 12
BROADCAST_IDS = 4_000_000
MAX_BYTES = 256 << 20
BEGINNINGS = (3, 4, 5, 6, 8)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def text_features(data, word, begin, end):
    """Three feature slots of every word: itself, its ending as written, whether it repeats the word before."""
    own = (word >> K.U64(64 - BITS)).astype(np.int64)
    last = data[end - 1].astype(np.int64)
    before = np.where(end - begin > 1, data[np.maximum(end - 2, 0)], 0).astype(np.int64)
    ending = (1 << BITS) + ((last * 257 + before) * 40503 & 0xFFFF) % (1 << 12)
    return own, ending


def meta_features(data, offsets, word, first, doc_of_word, source, lang):
    """Slots of source and language, and layout figures, of each text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def share(mask):
        return K.segment_sum(mask.astype(np.int64), offsets) / size

    words = np.diff(first)
    _, _, at = K.distinct_by_doc(word, doc_of_word, n)
    numbers = np.stack(
        [
            np.log1p(np.diff(offsets)),
            np.log1p(K.segment_sum((data == 10).astype(np.int64), offsets)),
            share(_UPPER[data]),
            share(_SYMBOL[data]),
            share(_DIGIT[data]),
            share(K.IS_SPACE[data]),
            np.diff(at) / np.maximum(words, 1),
            size / np.maximum(words, 1) / 10,
            np.log1p(words),
        ],
        1,
    )
    return [zlib.crc32((s or "").encode()) % SOURCES for s in source], [zlib.crc32((x or "").encode()) % LANGS for x in lang], numbers


def mark_features(data, offsets, chosen=None):
    """Distinct slots of the words and word beginnings (in bytes) of each text, its number, and the texts' offsets.

    chosen maps slots to places among those that count, or to -1.
    """
    begin, end = K.runs(~K.IS_SPACE[data], offsets)
    doc = np.searchsorted(offsets, begin, "right") - 1
    sums = K.prefix_hash(K.LOWER[data])
    slots, of = [], []
    for k in (0, *BEGINNINGS):
        long = end - begin > k
        hashed = K.span_hash(sums, begin[long], begin[long] + k if k else end[long])
        slot = (K.mix(hashed + K.U64(k)) >> K.U64(64 - MARK_BITS)).astype(np.int64)
        if chosen is not None:
            slot = chosen[slot]
        slots.append(slot[slot >= 0])
        of.append(doc[long][slot >= 0])
    return K.distinct_by_doc(np.concatenate(slots), np.concatenate(of), len(offsets) - 1)


def _count_marks(batches):
    toxic, clean = (np.zeros(1 << MARK_BITS, np.int64) for _ in range(2))
    for batch in batches:
        label = batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in K.chunks(batch, "text"):
            slot, doc, _ = mark_features(data, offsets)
            is_toxic = label[a:b][doc] == 1
            toxic += np.bincount(slot[is_toxic], minlength=len(toxic))
            clean += np.bincount(slot[~is_toxic], minlength=len(clean))
    seen = np.flatnonzero(toxic + clean)
    for k in range(0, len(seen), 1 << 14):
        at = seen[k : k + (1 << 14)]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(toxic[at]), pa.array(clean[at])], ["slot", "toxic", "clean"])


def choose_marks(sample: DataFrame) -> np.ndarray:
    """The slots most tied to toxicity, strongest first, by the labelled rows of the sample that are not held out."""
    rows = sample.where("toxic is not null and not held")
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return np.zeros(0, np.int64)
    counts = map_arrow(rows.select("toxic", "text"), _count_marks, "slot long, toxic long, clean long")
    counts = counts.groupBy("slot").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    share = total[1] / (total[0] + total[1])
    part = lambda n, of: F.when(n > 0, n * F.log(n / ((F.col("t") + F.col("c")) * F.lit(of)))).otherwise(0.0)
    ratio = 2 * (part(F.col("t"), share) + part(F.col("c"), 1 - share))
    found = counts.where(F.col("t") > (F.col("t") + F.col("c")) * F.lit(share)).withColumn("ratio", ratio)
    found = found.where(F.col("ratio") >= EVIDENCE).orderBy(F.desc(F.round("ratio", 6)), "slot").limit(MARKS)
    return np.array([r["slot"] for r in found.select("slot").collect()], np.int64)


def _places(marks: np.ndarray) -> np.ndarray:
    out = np.full(1 << MARK_BITS, -1)
    out[marks] = np.arange(len(marks))
    return out


def _chunk_views(batch, a, b, data, offsets):
    word, first, begin, end = K.words(data, offsets)
    doc = np.repeat(np.arange(b - a), np.diff(first))
    own, ending = text_features(data, word, begin, end)
    repeat = np.zeros(len(word), np.int64)
    repeat[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    col = lambda name: batch.column(batch.schema.get_field_index(name)).slice(a, b - a).to_pylist()
    source, lang, numbers = meta_features(data, offsets, word, first, doc, col("source"), col("lang"))
    return first, doc, own, ending, repeat, source, lang, numbers


FEATURES = "slots binary, parts binary, marks binary, meta string"


def _features(index, first, own, ending, repeat, source, lang, numbers, place, at):
    """Packed features (FEATURES) of the texts of a chunk that index names."""
    out = []
    for i in index:
        w = slice(first[i], first[i + 1])
        s, c = np.unique(np.concatenate([own[w], ending[w], np.full(int(repeat[w].sum()), TEXT_SIZE - 1)]), return_counts=True)
        parts = (c / max(first[i + 1] - first[i], 1)).astype(np.float32)
        out.append((s.astype(np.int32).tobytes(), parts.tobytes(), place[at[i] : at[i + 1]].astype(np.int32).tobytes(), json.dumps([source[i], lang[i], numbers[i].tolist()])))
    return out


def _gather(marks):
    def run(batches):
        chosen = _places(marks)
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            for a, b, data, offsets in K.chunks(batch, "text"):
                first, doc, *rest = _chunk_views(batch, a, b, data, offsets)
                place, _, at = mark_features(data, offsets, chosen)
                cols = list(zip(*_features(range(b - a), first, *rest, place, at), strict=True))
                passed = [get(c).slice(a, b - a) for c in ("doc_id", "label", "toxic", "held")]
                yield pa.RecordBatch.from_arrays([*passed, *(pa.array(c, pa.binary()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "label", "toxic", "held", "slots", "parts", "marks", "meta"])

    return run


class Sparse:
    """Rows of a feature matrix as (row, slot, value) triples."""

    def __init__(self, row, slot, value, n, width):
        # twelve bytes a triple; sums are of doubles all the same
        self.row, self.slot, self.value, self.n, self.width = row.astype(np.int32, copy=False), slot.astype(np.int32, copy=False), value, n, width

    def times(self, w):
        return np.bincount(self.row, w[self.slot] * self.value, self.n)

    def back(self, e):
        return np.bincount(self.slot, e[self.row] * self.value, self.width)


def fit_logistic(x: Sparse, y, weight, rounds: int = 250, decay: float = 1e-5):
    """Weights and bias by full-batch AdaGrad."""
    w, b = np.zeros(x.width), 0.0
    seen, seen_b = np.full(x.width, 1e-12), 1e-12
    weight = weight / weight.sum()
    for _ in range(rounds):
        e = (1 / (1 + np.exp(-np.clip(x.times(w) + b, -30, 30))) - y) * weight
        g = x.back(e) + decay * w
        seen += g * g
        seen_b += e.sum() ** 2
        w -= 0.5 * g / np.sqrt(seen)
        b -= 0.5 * e.sum() / np.sqrt(seen_b)
    return w, b


def _calibrate(z, y):
    """Slope and shift of log-odds by Newton steps with a weak pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        e, h = p - y, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(e * z).sum() + (a - 1), e.sum() + 0.01 * b])
        m = np.array([[(h * z * z).sum() + 1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(a), float(b)


class Model:
    """Both views' weights, the layout figures' scales, the calibrations and the share of label 1; for toxicity, the slots that count."""

    def __init__(self, text, meta, mean, scale, calibration, constant=None, prior=0.5, marks=None):
        self.text, self.meta, self.mean, self.scale, self.calibration, self.constant, self.prior, self.marks = text, meta, mean, scale, calibration, constant, prior, marks


class Target:
    """Co-training of one target from gathered rows: quality (label), or toxicity (toxic, held, marks) if marks are given."""

    def __init__(self, rows: list, marks: np.ndarray | None = None):
        self.name = "label" if marks is None else "toxic"
        self.marks = marks
        rows = sorted((r for r in rows if r[self.name] is not None), key=lambda r: (r["doc_id"], r["slots"]))
        self.rows = list(rows)
        self.label = np.array([float(r[self.name]) for r in rows])
        self.known = len(rows)
        self.constant = None
        if not len(rows) or self.label.min() == self.label.max():
            self.constant = float(self.label.min()) if len(rows) else float(marks is None)
            return
        # what the marks were counted on may not be held out
        self.held = np.arange(len(rows)) % 5 == 4 if marks is None else np.array([bool(r["held"]) for r in rows])
        if len(np.unique(self.label[self.held])) < 2:
            self.held[:] = False
        numbers = np.array([json.loads(r["meta"])[2] for r in rows])
        self.mean, self.scale = numbers.mean(0), numbers.std(0) + 1e-6
        self.taught: tuple[dict[int, float], dict[int, float]] = ({}, {})
        self.seen: set[int] = set()
        self.ended = False
        self.fit()

    def teach(self, view: int, label: float, rows: list) -> None:
        """Pseudo-labels for a view."""
        for r in rows:
            self.taught[view][len(self.rows)] = label
            self.rows.append(r)

    def _text(self, index: np.ndarray) -> Sparse:
        """The text view of the rows that index names."""
        rows = [self.rows[i] for i in index]
        slots = [np.frombuffer(r["slots" if self.marks is None else "marks"], np.int32) for r in rows]
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(s) for s in slots])
        value = np.concatenate([np.frombuffer(r["parts"], np.float32) for r in rows]) if self.marks is None else np.ones(len(row), np.float32)
        return Sparse(row, np.concatenate(slots), value, len(rows), TEXT_SIZE if self.marks is None else max(len(self.marks), 1))

    def _meta(self, index: np.ndarray) -> Sparse:
        """The metadata view of the rows that index names."""
        n, at = len(index), np.arange(len(index))
        rows = [json.loads(self.rows[i]["meta"]) for i in index]
        dense = np.clip((np.array([m[2] for m in rows]) - self.mean) / self.scale, -8, 8)
        slot = np.concatenate([[m[0] for m in rows], [SOURCES + m[1] for m in rows], np.tile(SOURCES + LANGS + np.arange(NUMBERS), n)])
        return Sparse(np.concatenate([at, at, np.repeat(at, NUMBERS)]), slot, np.concatenate([np.ones(2 * n), dense.ravel()]), n, META_SIZE)

    def fit(self) -> None:
        """Fit both views; a view's matrix is made for its rows alone and goes when its weights stand."""
        base = np.flatnonzero(~self.held)
        self.fitted, odds = [], []
        for extra, view in zip(self.taught, (self._text, self._meta), strict=True):
            index = np.concatenate([base, np.array(sorted(extra), np.int64)])
            y = np.concatenate([self.label[base], [extra[i] for i in sorted(extra)]])
            w = np.concatenate([np.ones(len(base)), np.full(len(extra), 0.5)])  # pseudo-labels weigh half
            self.fitted.append(fit_logistic(view(index), y, w))
            odds.append(view(self._checked()).times(self.fitted[-1][0]) + self.fitted[-1][1])
        self.odds = odds

    def _checked(self) -> np.ndarray:
        return np.flatnonzero(self.held) if self.held.any() else np.arange(self.known)

    def _odds(self, view: int) -> np.ndarray:
        """Log-odds of the labelled rows that check what was learned."""
        return self.odds[view]

    def trusted(self, view: int, label: int) -> float:
        """The least sureness from which on the view was right about TRUST of the held-out rows it gives this label."""
        p = 1 / (1 + np.exp(-np.clip(self._odds(view) * (1 if label else -1), -30, 30)))
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(self.label[self._checked()][order] == label) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero((right >= TRUST) & (np.arange(1, len(order) + 1) >= SHOWN))
        return float(p[order][enough[-1]]) if len(enough) else np.inf

    def loss(self) -> float:
        """Log-loss of the joint, calibrated odds on held-out rows."""
        y, model = self.label[self._checked()], self.model()
        z = [np.clip(s * self._odds(v) + t, -30, 30) for v, (s, t) in enumerate(model.calibration)]
        joint = (z[0] + z[1]) / 2 if self.marks is None else z[0] + z[1] - np.log(model.prior / (1 - model.prior))
        return float(np.logaddexp(0, np.where(y > 0, -joint, joint)).mean())

    def exchange(self, chosen: dict[tuple[int, int], list]) -> None:
        """Teach each view what the other is most sure of, by (view, label), and keep that if held-out rows do not speak against it."""
        before, state = self.loss(), (list(self.rows), tuple(dict(t) for t in self.taught), self.odds, self.fitted)
        trusted = {at: self.trusted(*at) for at in chosen}
        for (view, label), rows in chosen.items():
            self.teach(1 - view, float(label), [r["x"] for r in rows if r["x"]["sure"] >= trusted[view, label]])
        if len(self.rows) == len(state[0]):
            self.ended = True
            return
        self.fit()
        if self.loss() > before:
            self.rows, self.taught, self.odds, self.fitted = state
            self.ended = True

    def model(self, calibrated: bool = True) -> Model:
        if self.constant is not None:
            return Model(None, None, None, None, None, self.constant, marks=self.marks)
        y = self.label[self._checked()]
        calibration = [_calibrate(self._odds(v), y) if calibrated else (1.0, 0.0) for v in (0, 1)]
        return Model(*self.fitted, self.mean, self.scale, calibration, prior=float(self.label.mean()), marks=self.marks)


@dataclass(frozen=True)
class Models:
    """What decides on a document: its quality and, if learned, its toxicity."""

    quality: Model
    toxic: Model | None = None


def _meta_odds(model, source, lang, numbers):
    w, bias = model.meta
    dense = np.clip((numbers - model.mean) / model.scale, -8, 8)
    return w[source] + w[SOURCES + np.array(lang)] + dense @ w[SOURCES + LANGS :] + bias


def _calibrated(model, z):
    return [np.clip(s * x + t, -30, 30) for x, (s, t) in zip(z, model.calibration, strict=True)]


def _toxic_odds(model: Model, data, offsets, chosen, meta):
    """Log-odds of both views, calibrated, and the mark features."""
    w, bias = model.text
    place, _, at = mark_features(data, offsets, chosen)
    return _calibrated(model, [K.segment_sum(w[place], at) + bias, _meta_odds(model, *meta)]), place, at


def _quality_odds(model: Model, first, own, ending, repeat, meta):
    w, bias = model.text
    n = np.maximum(np.diff(first), 1)
    return _calibrated(model, [K.segment_sum(w[own] + w[ending] + w[-1] * repeat, first) / n + bias, _meta_odds(model, *meta)])


def _toxic_score(model: Model | None, chosen, data, offsets, meta):
    n = len(offsets) - 1
    if model is None or model.constant is not None:
        return np.full(n, 0.0 if model is None else model.constant)
    z, _, _ = _toxic_odds(model, data, offsets, chosen, meta)
    return 1 / (1 + np.exp(-np.clip(z[0] + z[1] - np.log(model.prior / (1 - model.prior)), -30, 30)))


def _within(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted ids."""
    if not len(ids):
        return np.zeros(len(x), bool)
    return ids[np.minimum(np.searchsorted(ids, x), len(ids) - 1)] == x


SUREST = f"combo int, sure double, print long, {FEATURES}"


def _surest(models: list[Model | None], most: int, sure: float, ids: Broadcast, taught: set[int]):
    """Of every (target, view, label), the texts without a label of which a task is most sure, with their features."""

    def run(batches):
        quality, toxic = models
        chosen = _places(toxic.marks if toxic is not None else np.zeros(0, np.int64))
        best: dict[int, dict[int, tuple]] = {c: {} for c in range(8)}
        floor = dict.fromkeys(best, sure)
        for batch in batches:
            doc_ids = batch.column(batch.schema.get_field_index("doc_id"))
            known = _within(doc_ids.fill_null(0).to_numpy(zero_copy_only=False), ids.value) & doc_ids.is_valid().to_numpy(zero_copy_only=False)
            for a, b, data, offsets in K.chunks(batch, "text"):
                first, _, *rest = _chunk_views(batch, a, b, data, offsets)
                free = ~known[a:b] & (np.diff(first) > 0)
                odds = [None if quality is None else _quality_odds(quality, first, *rest[:3], rest[3:])]
                if toxic is None:
                    place, _, at = mark_features(data, offsets, chosen)
                    odds.append(None)
                else:
                    z, place, at = _toxic_odds(toxic, data, offsets, chosen, rest[3:])
                    odds.append(z)
                for combo in best:
                    target, view, label = combo >> 2, combo >> 1 & 1, combo & 1
                    if odds[target] is None:
                        continue
                    p = 1 / (1 + np.exp(-odds[target][view] * (1 if label else -1)))
                    mine = best[combo]
                    for i in np.flatnonzero(free & (p >= floor[combo])).tolist():
                        name = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes()) >> 1
                        if name not in taught and (name not in mine or mine[name][0] < p[i]) and (len(mine) < most or p[i] > floor[combo]):
                            mine[name] = (float(p[i]), _features([i], first, *rest, place, at)[0])
                            if len(mine) > 2 * most:
                                mine = best[combo] = dict(sorted(mine.items(), key=lambda x: (-x[1][0], x[0]))[:most])
                            if len(mine) >= most:
                                floor[combo] = max(floor[combo], sorted((x[0] for x in mine.values()), reverse=True)[most - 1])
        rows = [(combo, p, name, *f) for combo, mine in best.items() for name, (p, f) in sorted(mine.items(), key=lambda x: (-x[1][0], x[0]))[:most]]
        for r in range(0, len(rows), 200):
            c = list(zip(*rows[r : r + 200], strict=True))
            types = (pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], [x.split()[0] for x in SUREST.split(", ")])

    return run


def _unlabelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Broadcast]:
    """Rows to score (doc_id, text, source, lang), and the sorted ids among them that have a label."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_views_of(docs))
    columns = [F.col(c).isNotNull() for c in ("quality", "toxic") if c in labels.columns]
    known = labels.where(reduce(lambda a, b: a | b, columns) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    if known.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
        return rows.join(known, "doc_id", "left_anti"), spark.sparkContext.broadcast(np.zeros(0, np.int64))
    return rows, spark.sparkContext.broadcast(np.sort(np.array([r["doc_id"] for r in known.collect()], np.int64)))


def _exchange(rows: DataFrame, ids: Broadcast, targets: list[Target | None], per_round: int, sure: float) -> bool:
    """One round over all documents: each view teaches the other the texts of which it is most sure. Whether another may follow."""
    tables = Scratch(rows.sparkSession)
    models = [None if t is None or t.constant is not None or t.ended else t.model(calibrated=False) for t in targets]
    if models == [None, None]:
        return False
    taught = set().union(*(t.seen for t, m in zip(targets, models, strict=True) if m is not None))
    found = tables.written(map_arrow(rows, _surest(models, per_round, sure, ids, taught), SUREST), "surest")
    each = found.groupBy("combo", "print").agg(F.max("sure").alias("sure"))
    # a top-k each, taken in the tasks first (a limit on row numbers); a target that ended has no rows
    place = F.row_number().over(Window.partitionBy("combo").orderBy(F.desc("sure"), "print"))
    top = each.withColumn("place", place).where(F.col("place") <= per_round).select("combo", "print")
    features = F.struct("sure", "slots", "parts", "marks", "meta")
    picked = found.join(F.broadcast(top), ["combo", "print"]).groupBy("combo", "print").agg(F.max_by(features, F.struct("sure", "meta")).alias("x"))
    by_target: list[dict[tuple[int, int], list]] = [{}, {}]
    for r in sorted(within_bytes(picked, F.struct("x.*"), "print").collect(), key=lambda r: (r["combo"], -r["x"]["sure"], r["print"])):  # per_round of each combo
        target, view, label = r["combo"] >> 2, r["combo"] >> 1 & 1, r["combo"] & 1
        by_target[target].setdefault((view, label), []).append(r)
        targets[target].seen.add(r["print"])
    for target, m, chosen in zip(targets, models, by_target, strict=True):
        if m is not None:
            target.exchange(chosen)
    tables.drop()
    return True


def _score(models: Models, threshold: float):
    def run(batches):
        model, toxic = models.quality, models.toxic
        chosen = None if toxic is None or toxic.marks is None else _places(toxic.marks)
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch, "text"):
                first, _, own, ending, repeat, source, lang, numbers = _chunk_views(batch, a, b, data, offsets)
                n = np.diff(first)
                if model.constant is not None:
                    p = [np.full(b - a, model.constant)] * 2
                    joint = p[0]
                else:
                    z = _quality_odds(model, first, own, ending, repeat, (source, lang, numbers))
                    p = [1 / (1 + np.exp(-x)) for x in z]
                    joint = 1 / (1 + np.exp(-(z[0] + z[1]) / 2))
                score = np.where(n > 0, joint, 0.0)
                bad = np.where(n > 0, _toxic_score(toxic, chosen, data, offsets, (source, lang, numbers)), 0.0)
                keep = (score >= threshold) & (n > 0) & (bad < threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x) for x in (p[0], p[1], score, bad, keep))], ["row", *SCORES, "keep"])

    return run


def _views_of(docs: DataFrame) -> list:
    """Columns text, source and lang of a table that may lack the last two."""
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("text", "source", "lang")]


def _labelled(labels: DataFrame, column: str, name: str, most: int) -> DataFrame:
    """id and its label, of the ids of smallest hash."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg(column) >= 0.5).cast("int").alias(name))
    return known.orderBy(F.xxhash64("id"), "id").limit(most)


def within_bytes(rows: DataFrame, features: Column, order: str, most: int = MAX_BYTES) -> DataFrame:
    """The rows, in order of a hash, up to so many bytes of features; only for tables of bounded rows."""
    size = sum((F.coalesce(F.octet_length(features[c]), F.lit(0)) for c in ("slots", "parts", "marks", "meta")), F.lit(0))
    upto = F.sum(size.cast("long")).over(Window.orderBy(F.xxhash64(order), order))
    return rows.withColumn("upto", upto).where(F.col("upto") <= most).drop("upto")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, toxic: bool = True, rounds: int = 2, per_round: int = 100, sure: float = 0.95, max_bytes: int = MAX_BYTES) -> Models:
    """Fit on a bounded sample of labelled rows and, in each round, the surest of all unlabelled ones."""
    tables = Scratch(docs.sparkSession)
    toxic = toxic and "toxic" in labels.columns
    chosen = _labelled(labels, "quality", "label", max_labelled).withColumn("toxic", F.lit(None).cast("int"))
    if toxic:
        chosen = chosen.unionByName(_labelled(labels, "toxic", "toxic", max_labelled), allowMissingColumns=True)
    # at most 2 * max_labelled rows, so they may be broadcast
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label"), F.max("toxic").alias("toxic")).withColumn("held", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5)) == 4)
    picked = docs.select(F.col("doc_id").cast("long").alias("id"), *_views_of(docs)).join(F.broadcast(chosen), "id")
    # one row of each id, however many share it
    row = F.struct("label", "toxic", "held", "text", "source", "lang")
    picked = picked.groupBy(F.col("id").alias("doc_id")).agg(F.min_by(row, F.struct(F.xxhash64("text"), "source", "lang")).alias("row")).select("doc_id", "row.*")
    picked = tables.written(picked, "labelled")
    marks = choose_marks(picked) if toxic else np.zeros(0, np.int64)
    gathered = tables.written(map_arrow(picked, _gather(marks), f"doc_id long, label int, toxic int, held boolean, {FEATURES}"), "gathered")
    rows = within_bytes(gathered, F.struct("slots", "parts", "marks", "meta"), "doc_id", max_bytes).collect()
    tables.drop()
    targets = [Target(rows), Target(rows, marks) if toxic else None]
    if rounds:
        every, ids = _unlabelled(docs, labels)
        for _ in range(rounds):
            if not _exchange(every, ids, targets, per_round, sure):
                break
            give_back()
    models = Models(targets[0].model(), targets[1].model() if toxic else None)
    # the driver's process stays as large as it was when it trained, unless it gives that back
    del rows, targets
    give_back()
    return models


SCORES = ["text_score", "meta_score", "score", "toxic_score"]


def score_rows(docs: DataFrame, models: Models, threshold: float = 0.5, carried: list[str] | None = None) -> DataFrame:
    """row (the given columns of every row, all by default, as one struct), text_score, meta_score, score, toxic_score, keep."""
    rows = docs.select(F.struct(*(docs.columns if carried is None else carried)).alias("row"), *_views_of(docs))
    fields = [T.StructField("row", rows.schema["row"].dataType), *(T.StructField(c, T.DoubleType()) for c in SCORES), T.StructField("keep", T.BooleanType())]
    return map_arrow(rows, _score(models, threshold), T.StructType(fields))


def document_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, toxic: bool = True) -> DataFrame:
    """doc_id, text_score, meta_score, score, toxic_score, keep of every row; what is bad or toxic is not kept."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return score_rows(docs, train(docs, labels, toxic=toxic), threshold, ["doc_id"]).select("row.doc_id", *SCORES, "keep")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep of every row by quality alone, whatever its toxicity."""
    return document_scores(docs, labels, threshold, toxic=False).drop("toxic_score")
