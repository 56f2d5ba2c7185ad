"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings sums, over all character triples that both hold in order, the product
of their weights: DECAY to the power of the stretch a triple takes, up to SPAN characters. Other
letters between the three are skipped, so that inserted characters lower a value but don't
destroy it. Look-alike digits count as letters; marks and blanks inside a unit count for nothing.

Units are words, and runs of words of up to two letters, or of none, taken together. Landmarks are units of the
labelled training texts that tell toxic ones from others, chosen unlike each other. A sentence's
similarity to a landmark is that of its nearest unit, normalised; the Nystroem map, the inverse
root of the landmarks' kernel matrix, makes a feature vector of it, and a linear support vector
machine is trained on labelled sentences: of each training text the worst one, as the machine
of the turn before sees it. A text's score is that of its worst sentence, as a probability after Platt.

Training reads at most SAMPLE labelled rows; scoring is one pass over all texts without shuffle.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .text_arrays import flat, mix, slices, words

#: Labelled rows that training reads, the first by a hash of doc_id.
SAMPLE = 16000
LANDMARKS = 64
#: Units that landmarks are chosen from: the most telling ones.
CANDIDATES = 512
#: Times the machine is fitted, each to the sentences that the one before finds worst.
TURNS = 3
DECAY, SPAN = 0.7, 6
#: Similarities below this count as none.
FLOOR = 0.35
#: Landmarks are no more alike than this.
UNLIKE = 0.8
#: Bytes of text that are looked at together, one long text aside. Arrays over their units and triples take some 100 MB,
#: against 280 MB for 2 MB of text, and a worker keeps part of that while it is idle.
PIECE = 1 << 18
_UNIT_BYTES = 48  # longer words are looked at in overlapping stretches

# Character classes: 0 none, 1 to 26 letters, 27 to 30 bytes of wider characters.
_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:256] = 27 + np.arange(128) % 4
for _digit, _letter in zip(b"013457@", b"oieasta"):
    _CLASS[_digit] = _letter - 96
_STEPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
_CODES = 1 << 15


def _triples(cls: np.ndarray, unit: np.ndarray):
    """(place, code, weight) of all triples within a unit, one step pattern at a time."""
    for j, k in _STEPS:
        n = len(cls) - k
        if n <= 0:
            continue
        a, b, c = cls[:n], cls[j: j + n], cls[k:]
        place = np.flatnonzero(unit[:n] == unit[k:])
        yield place, a[place] << 10 | b[place] << 5 | c[place], np.float32(DECAY ** (k + 1))


def _profiles(cls: np.ndarray, unit: np.ndarray, n: int):
    """Sparse triple weights of n units: (unit, code, weight), each pair once, and their norms."""
    keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for place, code, weight in _triples(cls, unit):
        keys.append(unit[place].astype(np.int64) << 15 | code)
        weights.append(np.full(len(place), weight, np.float64))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(back, np.concatenate(weights), len(key))
    owner = key >> 15
    norm = np.sqrt(np.bincount(owner, value * value, n))
    return owner, key & (_CODES - 1), value, norm


def _letters(cls: np.ndarray, unit: np.ndarray):
    """Without gap marks, however many stand between the letters of a unit."""
    keep = cls > 0
    return cls[keep], unit[keep]


def _as_units(texts: list[bytes]):
    cls = _CLASS[np.frombuffer(b"".join(texts), np.uint8)]
    return _letters(cls, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))


def _dense(texts: list[bytes]) -> np.ndarray:
    """Normalised triple weights of a few units."""
    owner, code, value, norm = _profiles(*_as_units(texts), len(texts))
    out = np.zeros((len(texts), _CODES), np.float32)
    out[owner, code] = value / np.maximum(norm[owner], 1e-9)
    return out


def units(buf: np.ndarray, off: np.ndarray):
    """Hash, start, end, document and sentence of every unit.

    Sentences end at line ends and behind '!', '?' and a '.' after two letters or more. Words of over _UNIT_BYTES bytes are
    cut into stretches that overlap by half, so that their middle is always seen whole.
    """
    h, start, end, doc = words(buf, off)
    if not len(h):
        return h, start, end, doc, doc
    lines = np.concatenate(([0], np.cumsum(buf == 10)))
    final = buf[end - 1]
    letters = np.concatenate(([0], np.cumsum(_CLASS[buf] > 0)))
    letters = letters[end] - letters[start]
    stop = np.zeros(len(h), bool)
    stop[1:] = ((final[:-1] == 46) & (letters[:-1] > 1) | (final[:-1] == 33) | (final[:-1] == 63) | (lines[start[1:]] > lines[end[:-1]])
                | (doc[1:] != doc[:-1]))
    sentence = np.cumsum(stop)
    parts = [(h, start, end, doc, sentence)]
    short = letters <= 2
    # a run of short words stays within its sentence
    begins, ends = short.copy(), short.copy()
    begins[1:] &= ~short[:-1] | stop[1:]
    ends[:-1] &= ~short[1:] | stop[1:]
    ra, rb = np.flatnonzero(begins), np.flatnonzero(ends)
    ra, rb = ra[rb - ra >= 2], rb[rb - ra >= 2]
    if len(ra):
        key = np.array([hash(buf[start[a]: end[b]].tobytes()) for a, b in zip(ra, rb)], np.int64).view(np.uint64)
        parts.append((mix(key), start[ra], end[rb], doc[ra], sentence[ra]))
    h, start, end, doc, sentence = (np.concatenate(x) for x in zip(*parts))
    wide = np.flatnonzero(end - start > _UNIT_BYTES)
    if len(wide):
        half = _UNIT_BYTES // 2
        count = (end[wide] - start[wide] - 1) // half
        i = np.repeat(wide, count)
        at = start[i] + half * (np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count))
        to = np.minimum(at + _UNIT_BYTES, end[i])
        keep = np.ones(len(h), bool)
        keep[wide] = False
        more = mix(h[i] + at.astype(np.uint64))
        h, start, end, doc, sentence = (np.concatenate((x[keep], y)) for x, y in zip(
            (h, start, end, doc, sentence), (more, at, to, doc[i], sentence[i])))
    return h, start, end, doc, sentence


class Model:
    """Landmarks, and the weights of a sentence's similarities to them."""

    def __init__(self, landmarks: list[bytes], profiles: np.ndarray):
        self.landmarks = landmarks
        self.weights, self.bias, self.slope, self.shift = np.zeros(len(landmarks)), -1.0, 1.0, 0.0
        self.of = profiles.astype(np.float32)  # landmark by code, normalised
        used = self.of.max(axis=0, initial=0)
        self.index = np.full(_CODES, -1, np.int32)
        codes = np.flatnonzero(used > 0)
        self.index[codes] = np.arange(len(codes))
        self.rows = np.ascontiguousarray(self.of[:, codes].T)  # used code by landmark
        self.most = used[codes]

    def similarities(self, texts: pa.Array):
        """(document, sentence, similarities) of the sentences that are near any landmark."""
        buf, off = flat(texts)
        h, start, end, doc, sentence = units(buf, off)
        none = np.zeros(0, np.int64)
        if not len(h) or not self.landmarks:
            return none, none, np.zeros((0, len(self.landmarks)), np.float32)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        size = end[first] - start[first]
        unit = np.repeat(np.arange(len(first)), size)
        cls = _CLASS[buf[np.repeat(start[first] - (np.cumsum(size) - size), size) + np.arange(len(unit))]]
        cls, unit = _letters(cls, unit)
        # an upper bound of the similarity, from the landmarks' largest weight of each triple
        bound, square = np.zeros(len(first)), np.zeros(len(first))
        for place, code, weight in _triples(cls, unit):
            u = self.index[code]
            hit = u >= 0
            bound += np.bincount(unit[place[hit]], self.most[u[hit]] * weight, len(first))
            square += np.bincount(unit[place], minlength=len(first)) * float(weight) ** 2
        # equal triples of a unit add up before they are squared, so `square` is not above the norm's square
        near = np.flatnonzero(bound >= FLOOR * np.sqrt(square) - 1e-6)
        near = near[square[near] > 0]
        if not len(near):
            return none, none, np.zeros((0, len(self.landmarks)), np.float32)
        number = np.full(len(first), -1, np.int64)
        number[near] = np.arange(len(near))
        keep = number[unit] >= 0
        owner, code, value, norm = _profiles(cls[keep], number[unit[keep]], len(near))
        u = self.index[code]
        owner, u, value = owner[u >= 0], u[u >= 0], value[u >= 0]
        sim = np.zeros((len(near), len(self.landmarks)), np.float32)
        for at in range(0, len(owner), 1 << 17):
            own, piece = owner[at: at + (1 << 17)], slice(at, at + (1 << 17))
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sim[own[begin]] += np.add.reduceat(self.rows[u[piece]] * value[piece, None].astype(np.float32), begin, axis=0)
        sim /= np.maximum(norm, 1e-9)[:, None].astype(np.float32)
        sim[sim < FLOOR] = 0
        good = np.flatnonzero(sim.max(axis=1) > 0)
        number[near] = -1
        number[near[good]] = good
        seen = np.flatnonzero(number[back] >= 0)
        if not len(seen):
            return none, none, np.zeros((0, len(self.landmarks)), np.float32)
        seen = seen[np.argsort(sentence[seen], kind="stable")]
        begin = np.flatnonzero(np.r_[True, np.diff(sentence[seen]) > 0])
        return doc[seen[begin]], sentence[seen[begin]], np.maximum.reduceat(sim[number[back[seen]]], begin, axis=0)

    def margins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's worst margin, and the similarities of the sentence that has it."""
        margin, best = np.full(len(texts), self.bias), np.zeros((len(texts), len(self.landmarks)), np.float32)
        doc, _, sim = self.similarities(texts)
        if len(doc):
            own = sim @ self.weights + self.bias
            order = np.lexsort((-own, doc))
            first = order[np.flatnonzero(np.r_[True, np.diff(doc[order]) > 0])]
            # a text also has sentences that are near no landmark, with the bias as their margin
            first = first[own[first] > self.bias]
            margin[doc[first]], best[doc[first]] = own[first], sim[first]
        return margin, best

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-(self.slope * self.margins(texts)[0] + self.shift), -50, 50)))

    def fit(self, sim: np.ndarray, label: np.ndarray) -> None:
        """Nystroem map, and a squared-hinge machine with partly balanced classes by Newton steps."""
        kernel = self.of @ self.of.T
        value, vector = np.linalg.eigh(kernel.astype(np.float64) + 1e-3 * np.eye(len(kernel)))
        root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
        x = np.hstack([sim @ root, np.ones((len(sim), 1))])
        y = np.where(label > 0, 1.0, -1.0)
        cost = np.where(label > 0, (len(label) / max((label > 0).sum(), 1)) ** 0.5, 1.0)
        penalty = np.diag([1.0] * len(kernel) + [1e-6])
        w = np.zeros(x.shape[1])
        for _ in range(50):
            active = y * (x @ w) < 1
            xa = x[active] * cost[active, None]
            new = np.linalg.solve(penalty + xa.T @ x[active], xa.T @ y[active])
            if np.allclose(new, w, atol=1e-9):
                break
            w = new
        self.weights, self.bias = root @ w[:-1], float(w[-1])

    def calibrate(self, margin: np.ndarray, label: np.ndarray) -> None:
        """Platt's sigmoid over the margins of whole texts."""
        # Platt's smoothed targets, by Newton steps on two numbers
        pos, neg = (label > 0).sum(), (label == 0).sum()
        target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 2.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(np.clip(-(a * margin + b), -50, 50)))
            g = np.array([((p - target) * margin).sum(), (p - target).sum()])
            d = p * (1 - p) + 1e-9
            hess = np.array([[(d * margin * margin).sum() + 1e-3, (d * margin).sum()], [(d * margin).sum(), d.sum() + 1e-3]])
            step = np.clip(np.linalg.solve(hess, g), -1, 1)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-6:
                break
        self.slope, self.shift = float(max(a, 1e-3)), float(b)


def _distinct_units(batches):
    """Each training text's distinct units with its label, counted within the batch."""
    for whole in batches:
        for batch in slices(whole, "text", PIECE):
            buf, off = flat(batch.column("text"))
            h, start, end, doc, _ = units(buf, off)
            if not len(h):
                continue
            toxic = batch.column("toxic").to_numpy()[doc]
            pair = np.unique(np.stack([h, doc.astype(np.uint64)]), axis=1, return_index=True)[1]
            h, start, end, toxic = h[pair], start[pair], end[pair], toxic[pair]
            one, first, back = np.unique(h, return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([buf[a:b].tobytes().lower() for a, b in zip(start[first], end[first])], pa.binary()),
                 pa.array(np.bincount(back, toxic, len(one)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(one)).astype(np.int64))],
                names=["unit", "toxic", "n"])


def _witnesses(model):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                margin, best = model.value.margins(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int64()), pa.array(margin.astype(float)),
                                                  pa.array([r.tobytes() for r in best], pa.binary())], names=["toxic", "margin", "sim"])
    return run


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit a model to the labelled rows whose crc32(doc_id as text) mod 5 is not 0, SAMPLE of them at most.

    labels: doc_id, toxic (0 or 1; null is no label; of several the largest counts). Rows that
    repeat a doc_id all take part. Without texts of both kinds the model has no landmark and
    gives every text one low score.
    """
    spark = documents.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # SAMPLE rows of two numbers: broadcast, the texts stay where they are
    rows = settle(slim.join(F.broadcast(known), "doc_id").select("text", "toxic"), "toxicity-training")
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sum(n for t, n in counts.items() if t), counts.get(0, 0)
    if not pos or not neg:
        return Model([], np.zeros((0, _CODES), np.float32))
    found = rows.mapInArrow(_distinct_units, "unit binary, toxic long, n long").groupBy("unit").agg(
        F.sum("toxic").alias("t"), F.sum("n").alias("n")).where("n > 1")
    # log-likelihood ratio of a unit's share in toxic texts against all
    share = F.lit(pos / (pos + neg))
    telling = F.col("t") * F.log(F.col("t") / (F.col("n") * share)) + F.when(
        F.col("n") > F.col("t"), (F.col("n") - F.col("t")) * F.log((F.col("n") - F.col("t")) / (F.col("n") * (1 - share)))).otherwise(0.0)
    top = found.where(F.col("t") > F.col("n") * share).orderBy(telling.desc(), "unit").limit(CANDIDATES).collect()
    texts = [bytes(r.unit) for r in top]
    profiles, chosen = _dense(texts), []
    for i in range(len(texts)):
        if len(chosen) < LANDMARKS and profiles[i].any() and (not chosen or (profiles[chosen] @ profiles[i]).max() <= UNLIKE):
            chosen.append(i)
    model = Model([texts[i] for i in chosen], profiles[chosen])
    model.weights += 1.0  # to begin with, the sentence that is nearest to the landmarks
    for turn in range(TURNS + 1 if chosen else 0):
        out = rows.mapInArrow(_witnesses(spark.sparkContext.broadcast(model)), "toxic long, margin double, sim binary").collect()
        label = np.array([r.toxic for r in out])
        if turn == TURNS:
            model.calibrate(np.array([r.margin for r in out]), label)
        else:
            model.fit(np.stack([np.frombuffer(r.sim, np.float32) for r in out]).astype(np.float64), label)
    return model


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _score(model):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                score = model.value.scores(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])
    return run


def _clean(model, column: str):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, column, PIECE):
                yield batch.filter(pa.array(model.value.scores(batch.column(column)) < 0.5))
    return run


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `documents` (doc_id, text; more columns are ignored).

    A null or empty text has the score of a text without any suspicious unit. A missing doc_id
    is not held out. Equal texts have equal scores. No rows give no rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                            held_out("doc_id").alias("held_out"))
    return slim.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under 0.5, all columns as they were."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))
    return documents.mapInArrow(_clean(model, "text"), documents.schema)
