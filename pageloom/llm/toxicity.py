"""Toxicity: a support vector machine over a gapped subsequence string kernel with Nystroem landmarks.

A unit is a word (A-Z lower-cased; a run of single letters is one). Its features are the triples of characters in order
within a span of six, begin and end of the unit included; each character left out between them costs a factor ``GAP``. So
``idi.ot`` or ``idixot`` still shares most triples with ``idiot``. The kernel is the normalised product of two units'
features. A sentence is as toxic as its worst unit, and a text as its worst sentence.

Fitting, on a bounded sample of labelled rows (``SAMPLE``): runs of characters and whole units are evidence where they are tied
to the label more strongly than the best of so many would be by chance. Sentences of toxic texts that hold an insult, a unit with
such evidence that other texts do not hold, are toxic sentences; all sentences of other texts are not. Insults are dealt to
landmarks and weighted by group (their strongest run), so a stem with many endings counts like a single word. A machine on the
kernel's Nystroem coordinates folds into one table of triple weights, as the kernel is a product of explicit features; it
screens units cheaply. The machine that decides works on the coordinates of the kernel's cube, for what passes, with landmarks
among the clean units that pass, and is trained again with each sentence's worst unit standing for it. The curve from a text's
worst unit to a probability is fitted on rows kept apart. Documents are only mapped.

Bounds of the fit besides ``SAMPLE``: ``LANDMARKS`` of each kind, ``NEGATIVES`` clean units against the insults (the commonest,
then those most like insults), ``DISGUISED`` insults that are also learnt in disguised spellings. Insults of several words, and
units without letters or digits, are not learnt.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pageloom.llm import words as W
from pageloom.llm.frames import without
from pageloom.llm.labelled import sample

SAMPLE = 3_000
GAP, SPAN = 0.6, 5
LANDMARKS, NEGATIVES, ROUNDS, STEPS = 96, 6_000, 2, 600
#: Bytes of the runs that are tried as evidence, edges of a word included, and toxic texts that must hold one.
RUNS, LEAST_TEXTS = range(4, 10), 4
#: Share of insults that the screen may miss, and of clean units that it lets pass at least.
MISSED, PASSED = 0.005, 0.97
#: Texts of each label from which on some are kept apart for the curve.
LEAST_APART = 50
POWER, FLOOR, RIDGE, DECAY, AGAINST = 3, -2.0, 0.05, 5e-4, 8.0
#: Units of toxic sentences of which disguised spellings are learnt too.
DISGUISED = 200
#: Decided units that a worker remembers; it starts anew beyond that.
REMEMBERED = 3_000_000
#: Text that is handled at once: units in it are judged once.
PIECE = 4 << 20
#: Twice the log likelihood ratio from which a run of characters counts as tied to the label, and the ratio of shares.
SIGNIFICANT, RATIO = 15.0, 10.0
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b <= SPAN]
_EDGE, _DIM, _ROWS = 31, 1 << 15, 512
_ALL = np.arange(256)
#: Letters 1 to 26, digits 27, bytes of longer characters spread over 1 to 30, other characters none.
_CODE = np.select([(_ALL >= 97) & (_ALL <= 122), (_ALL >= 48) & (_ALL <= 57), _ALL >= 128], [_ALL - 96, 27, _ALL % 30 + 1], 0).astype(np.int32)


def units(column: pa.Array) -> W.Words:
    """Words of the texts, runs of single characters between single spaces joined."""
    w = W.words(column, lower=True)
    one = w.end - w.start == 1
    doc = w.doc()
    near = np.flatnonzero(one[1:] & one[:-1] & (w.start[1:] == w.end[:-1] + 1) & (doc[1:] == doc[:-1]))
    if not len(near):
        return w
    joined = w.data.copy()
    joined[w.end[near]] = ord(".")
    return W.words(_column(joined, w.offsets), lower=False)


def _column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    held = [np.ascontiguousarray(x) for x in (offsets.astype(np.int64), data)]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, *map(pa.py_buffer, held)])


def triples(w: W.Words) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: the unit and the number of each triple there is, and its weight."""
    size = w.end - w.start
    unit = np.repeat(np.arange(len(size), dtype=np.int32), size)
    inner = (np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    code = _CODE[w.data[np.repeat(w.start, size) + inner]]
    left, right = inner + 1, (np.repeat(size, size) - inner).astype(np.int32)
    empty = np.zeros(SPAN, np.int32)
    before, after = np.concatenate((empty, code)), np.concatenate((code, empty))
    held = code > 0
    for a, b in _STEPS:
        low = np.where(left == a, _EDGE, before[SPAN - a : SPAN - a + len(code)])
        high = np.where(right == b, _EDGE, after[b : b + len(code)])
        good = np.flatnonzero(held & (left >= a) & (right >= b) & (low > 0) & (high > 0))
        yield unit[good], (low[good] << 10) | (code[good] << 5) | high[good], GAP ** (a + b - 2)


def weigh(w: W.Words, table: np.ndarray) -> np.ndarray:
    """Product of every unit's normalised features with a table of triple weights."""
    total, norm = np.zeros(len(w.start)), np.zeros(len(w.start))
    for unit, number, weight in triples(w):
        total += weight * np.bincount(unit, table[number], len(total))
        norm += weight**2 * np.bincount(unit, minlength=len(total))
    return total / np.sqrt(np.maximum(norm, 1e-9))


@dataclass
class Marks:
    """Features of landmarks, one column each, for the triples that occur in them."""

    active: np.ndarray
    dense: np.ndarray


def kernel(w: W.Words, marks: Marks) -> np.ndarray:
    """The kernel of every unit with the landmarks."""
    active, dense = marks.active, marks.dense
    slot = np.full(_DIM, -1)
    slot[active] = np.arange(len(active))
    out = np.zeros((len(w.start), dense.shape[1]), np.float32)
    for at in range(0, len(w.start), _ROWS):
        part = _some(w, np.arange(at, min(at + _ROWS, len(w.start))))
        cells, weights, norm = [], [], np.zeros(len(part.start))
        for unit, number, weight in triples(part):
            found = slot[number]
            held = found >= 0
            cells.append(unit[held].astype(np.int64) * len(active) + found[held])
            weights.append(np.full(len(cells[-1]), weight))
            norm += weight**2 * np.bincount(unit, minlength=len(norm))
        rows = np.bincount(np.concatenate(cells), np.concatenate(weights), len(norm) * len(active)).reshape(len(norm), len(active))
        # Triples that a unit repeats make its norm larger than the sum of squares, so the product is held below one.
        out[at : at + len(norm)] = np.minimum((rows.astype(np.float32) @ dense) / np.sqrt(np.maximum(norm, 1e-9))[:, None], 1.0)
    return out


def _features(parts: list[W.Words]) -> Marks:
    """Normalised features of the units of all parts."""
    found = [[], [], []]
    at = 0
    for w in parts:
        norm, entries = np.zeros(len(w.start)), list(triples(w))
        for unit, _, weight in entries:
            norm += weight**2 * np.bincount(unit, minlength=len(norm))
        for unit, number, weight in entries:
            for held, new in zip(found, (unit + at, number, weight / np.sqrt(np.maximum(norm, 1e-9))[unit]), strict=True):
                held.append(new)
        at += len(norm)
    unit, number, weight = (np.concatenate(f) for f in found)
    active, slot = np.unique(number, return_inverse=True)
    dense = np.bincount(slot * at + unit, weight, len(active) * at).reshape(len(active), at)
    return Marks(active, dense.astype(np.float32))


def _distinct(w: W.Words) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """The distinct units, their hashes, and the number of each unit among them."""
    value, at, place = np.unique(W.hashes(w), return_index=True, return_inverse=True)
    return _some(w, at), value, place


def _some(w: W.Words, at: np.ndarray) -> W.Words:
    return W.Words(w.data, w.offsets, w.start[at], w.end[at], np.array([0, len(at)]))


@dataclass
class Machine:
    """A table of triple weights that screens units, the landmarks' features and the weight of each in the cube of the
    kernel for those that pass, and the logistic curve from the worst unit to a probability."""

    screen: np.ndarray
    least: float
    marks: Marks
    weights: np.ndarray
    slope: float
    offset: float
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def decide(self, w: W.Words) -> np.ndarray:
        """Decision value of every unit; ``FLOOR`` for those screened out. Both are remembered by hash, sorted, for later texts."""
        few, value, place = _distinct(w)
        at = np.searchsorted(self.keys, value)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == value[known]
        out = np.empty(len(value), np.float32)
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        out[new] = self._decided(_some(few, new))
        if len(self.keys) + len(new) > REMEMBERED:
            self.keys, self.values = value, out
        else:
            self.keys, self.values = np.insert(self.keys, at[new], value[new]), np.insert(self.values, at[new], out[new])
        return out[place].astype(float)

    def _decided(self, w: W.Words) -> np.ndarray:
        out = np.full(len(w.start), FLOOR)
        passed = np.flatnonzero(weigh(w, self.screen) >= self.least)
        if len(passed):
            out[passed] = np.maximum(kernel(_some(w, passed), self.marks) ** POWER @ self.weights, FLOOR)
        return out

    def worst(self, w: W.Words) -> np.ndarray:
        """Decision value of the worst unit of every text; ``FLOOR`` for those without units."""
        out = np.full(len(w.counts), FLOOR)
        full = np.flatnonzero(w.counts)
        if len(full):
            out[full] = np.maximum.reduceat(self.decide(w), w.first[:-1][full])
        return out

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -30, 30)))


def _runs(few: W.Words, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of characters of every unit, its edges included, and of it all (``whole``); and the units they are in."""
    size = few.end - few.start + 2
    first = np.cumsum(np.r_[0, size])
    data = np.full(first[-1], 1, np.uint8)  # stands for an edge
    inner = np.repeat(first[:-1] + 1 - few.start, size - 2) + (at := _places(few.start, size - 2))
    data[inner] = few.data[at]
    unit, own = np.repeat(np.arange(len(size)), size), W.mix(data.astype(np.uint64) + np.uint64(1))
    until = np.repeat(first[1:], size) - np.arange(len(data))
    found, where = [whole ^ np.uint64(1)], [np.arange(len(size))]
    for n in RUNS:
        value = W.mix(W.rolled(own, n) + np.uint64(n))
        fits = np.flatnonzero(until[: len(value)] >= n)
        found.append(value[fits])
        where.append(unit[fits])
    return np.concatenate(found), np.concatenate(where)


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _evidence(few: W.Words, whole: np.ndarray, pairs: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The group of every distinct unit: the number of the run of characters that makes it evidence, or -1.

    Insults are words, stems or endings, so runs of several lengths and whole units are tried. A run is evidence if its tie to the
    label is stronger than that of the best of so many runs would be by chance; a unit goes by its strongest run. A text longer than
    most counts less, by its size, as it holds many words whatever its label. ``pairs``: distinct unit * number of texts + text.
    """
    n, group = len(y), np.full(len(few.start), -1)
    run, unit = _runs(few, whole)
    order = np.argsort(unit, kind="stable")
    place, unit = np.unique(run, return_inverse=True)[1][order], unit[order]
    part = _parts(pairs, n)

    def texts(place: np.ndarray, unit: np.ndarray, label: int) -> np.ndarray:
        """How many texts of a label hold each run, long ones in part."""
        begin = np.searchsorted(unit, np.arange(len(few.start) + 1))
        held, text = np.divmod(pairs[y[pairs % n] == label], n)
        size = begin[held + 1] - begin[held]
        found, text = np.divmod(np.unique(place[_places(begin[held], size)] * n + np.repeat(text, size)), n)
        return np.bincount(found, part[text], minlength=int(place.max(initial=0)) + 1)

    k = texts(place, unit, 1)
    often = k >= LEAST_TEXTS
    if not often.any():
        return group
    kept = often[place]
    place, unit, k = (np.cumsum(often) - 1)[place[kept]], unit[kept], k[often]
    j = texts(place, unit, 0)
    strength = np.where(_tied(k, j, y), _likelihood(k, j, y), 0.0)
    strength[strength < 2 * np.log(len(k))] = 0
    strongest = np.lexsort((strength[place], unit))
    last = strongest[np.r_[unit[strongest][1:] != unit[strongest][:-1], True]]
    last = last[strength[place[last]] > 0]
    # Groups are numbered from the strongest on.
    number = np.empty(len(k), int)
    number[np.argsort(-strength, kind="stable")] = np.arange(len(k))
    group[unit[last]] = number[place[last]]
    return group


def _parts(pairs: np.ndarray, n: int) -> np.ndarray:
    """What each of n texts counts for: one, or less if it has more distinct units than the median text."""
    size = np.bincount(pairs % n, minlength=n)
    return np.minimum(1.0, np.median(size[size > 0]) / np.maximum(size, 1)) if size.any() else np.ones(n)


def _likelihood(k: np.ndarray, j: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Twice the log likelihood ratio of standing in ``k`` toxic and ``j`` other texts, against no tie to the label."""
    share = max(int(y.sum()), 1) / max(len(y), 1)
    part = np.maximum(k, 1) / (np.maximum(k + j, 1) * share), np.maximum(j, 1) / (np.maximum(k + j, 1) * max(1 - share, 1e-9))
    return 2 * (k * np.log(part[0]) + j * np.log(part[1]))


def _tied(k: np.ndarray, j: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether what stands in ``k`` toxic and ``j`` other texts is toxic far more often than not, and not by chance. A few wrong
    labels do not undo it."""
    toxic, clean = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    return (k / toxic > RATIO * (j + 0.5) / clean) & (_likelihood(k, j, y) >= SIGNIFICANT)


def _train(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Linear machine without offset by accelerated gradient steps: insults should have a value of 1 or more, other units 0 or
    less, which is the value of a unit like no landmark; so only units that look like insults count against them. Squared loss
    beyond these margins."""
    least = np.where(y == 1, 1.0, 0.0)
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.where(y == 1, weight / max(weight[y == 1].sum(), 1), AGAINST * weight / max(weight[y == 0].sum(), 1))
    rate = 1 / (2 * np.linalg.norm(z.T @ (share[:, None] * z), 2) + DECAY)
    beta, ahead = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for step in range(1, STEPS + 1):
        slack = np.maximum(0, least - sign * (z @ ahead))
        new = ahead - rate * (-2 * z.T @ (share * sign * slack) + DECAY * ahead)
        ahead = new + (step - 1) / (step + 2) * (new - beta)
        beta = new
    return beta


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through (value, label), by Newton steps with a little ridge."""
    a = np.array([1.0, 0.0])
    rows = np.column_stack([x, np.ones(len(x))])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ a, -30, 30)))
        gradient = rows.T @ (p - y) + 1e-2 * a
        a = a - np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(2), gradient)
        a[0] = np.clip(a[0], 0.0, 60.0)
    return float(a[0]), float(a[1])


def _root(kernel: np.ndarray) -> np.ndarray:
    """Inverse square root of the landmarks' kernel, with a ridge against landmarks that are nearly alike."""
    values, vectors = np.linalg.eigh(kernel + RIDGE * np.eye(len(kernel)))
    return vectors @ np.diag(1 / np.sqrt(values)) @ vectors.T


def _disguised(names: list[bytes]) -> W.Words:
    """Spellings with a sign between all letters, with one in the middle, and with a letter put in."""
    out = []
    for n, x in enumerate(names):
        half = len(x) // 2
        out += [b".".join(x[i : i + 1] for i in range(len(x))), x[:half] + b"*" + x[half:], x[:half] + b"%c" % (97 + n % 26) + x[half:]]
    data = np.frombuffer(b" ".join(out), np.uint8)
    return W.words(_column(data, np.array([0, len(data)])))


def fit(texts: list[str], y: np.ndarray) -> Machine:
    """A machine from labelled texts; every fifth is kept apart for the curve. Without texts of both labels, or without anything
    tied to them, the score is the share of toxic ones."""
    base = float(np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3))
    flat = Machine(np.zeros(_DIM), np.inf, Marks(np.zeros(0, int), np.zeros((0, 1))), np.zeros(1), 0.0, float(np.log(base / (1 - base))))
    apart = np.zeros(len(y), bool)
    for label in (0, 1):
        apart[np.flatnonzero(y == label)[4::5]] = True
    if y.sum() < LEAST_APART or (1 - y).sum() < LEAST_APART:
        apart[:] = False
    held = np.flatnonzero(~apart)
    out = _machine([texts[i] for i in held], y[held]) if len(np.unique(y)) == 2 else None
    if out is None:
        return flat
    judged = np.flatnonzero(apart) if apart.any() else held
    out.slope, out.offset = _curve(out.worst(units(pa.array([texts[i] for i in judged], pa.string()))), y[judged].astype(float))
    return out


def _machine(texts: list[str], y: np.ndarray) -> Machine | None:
    """The machine without its curve; None where nothing is tied to the label."""
    w = units(pa.array(texts, pa.string()))
    few, value, place = _distinct(w)
    names, doc = [few.text(i) for i in range(len(few.start))], w.doc()
    pairs = np.unique(place.astype(np.int64) * len(y) + doc)
    group = _evidence(few, value, pairs, y)
    # A unit is an insult if it is evidence and no other text holds it, or so few that it is still tied to the label itself: some
    # are labelled wrongly.
    part = _parts(pairs, len(y))
    k, j = (np.bincount(pairs[of] // len(y), part[pairs[of] % len(y)], len(names)) for of in (y[pairs % len(y)] == x for x in (1, 0)))
    good = np.flatnonzero((group >= 0) & (k > 0) & ((j == 0) | _tied(k, j, y)))
    # A sentence ends after . ! ? or before a new line; one of a toxic text with an insult is toxic.
    stop = np.isin(w.data[w.end - 1], list(b".!?")) | (w.data[np.minimum(w.end, len(w.data) - 1)] == 10) | np.append(doc[1:] != doc[:-1], True)
    sentence = np.r_[0, np.cumsum(stop)[:-1]]
    insult = np.zeros(len(names), bool)
    insult[good] = True
    toxic = (np.bincount(sentence, insult[place] & (y[doc] == 1)) > 0)[sentence]
    clean = np.setdiff1d(np.flatnonzero(j), good)
    if not len(good) or not len(clean):
        return None
    # Insults are dealt by group, the commonest of each first: a stem with many endings has no more than a single word.
    order = np.lexsort((-k[good], group[good]))
    rank = np.empty(len(good), int)
    sizes = np.unique(group[good], return_counts=True)[1]
    rank[order] = _places(np.zeros(len(sizes), int), sizes)
    good = good[np.lexsort((group[good], rank))]
    clean = clean[np.argsort(-j[clean], kind="stable")]
    more = _disguised([names[i] for i in good[:DISGUISED]])
    ones = np.ones(len(more.start))

    # Each group weighs what it explains, whatever the number of its units.
    weight = np.sqrt(k + j)
    total = np.bincount(group[good], k[good])
    weight[good] = k[good] / total[group[good]] * np.sqrt(total[group[good]]) * 3

    def landmarks(against: np.ndarray) -> tuple[Marks, np.ndarray]:
        """Insults, units that are none, and disguised insults; and the kernel among them."""
        found = _features([_some(few, np.r_[good[:LANDMARKS], _spread(against, LANDMARKS)]), _some(more, np.arange(min(LANDMARKS, len(more.start))))])
        return found, found.dense.T.astype(np.float64) @ found.dense

    def learnt(rows: np.ndarray, label: np.ndarray, power: int) -> np.ndarray:
        z = np.vstack([kernel(_some(few, rows), marks), extra]) ** power @ half
        return half @ _train(z, np.r_[label, ones], np.r_[weight[rows], np.repeat(weight[good[:DISGUISED]], 3) / 2])

    # The kernel itself, folded into one table: it screens. Missed insults set how much may pass.
    marks, own = landmarks(clean)
    half, extra, common = _root(own), kernel(more, marks), clean[:NEGATIVES]
    beta = learnt(np.r_[good, common], np.r_[np.ones(len(good)), np.zeros(len(common))], 1)
    screen = np.zeros(_DIM)
    screen[marks.active] = marks.dense @ beta
    value = weigh(few, screen)
    order = good[np.argsort(value[good], kind="stable")]
    missed = np.cumsum(weight[order]) <= MISSED * weight[order].sum()
    least = float(min(value[order[int(missed.sum())]], np.quantile(value[clean], PASSED)))

    # Its cube, on what passes, with landmarks of its own among the clean units that are most like insults.
    hard = clean[value[clean] >= least]
    hard = hard[np.argsort(-value[hard], kind="stable")]
    if not len(hard):
        hard = clean
    marks, own = landmarks(hard)
    half, extra, hard = _root(own**POWER), kernel(more, marks), hard[:NEGATIVES]
    rows, label = np.r_[good, hard], np.r_[np.ones(len(good)), np.zeros(len(hard))]
    for _ in range(ROUNDS):
        out = Machine(screen, least, marks, learnt(rows, label, POWER), 1.0, 0.0)
        decision = out._decided(few)[place]
        order = np.lexsort((decision, sentence))
        worst = order[np.r_[sentence[order][1:] != sentence[order][:-1], True]]
        up = np.intersect1d(place[worst[toxic[worst]]], good)
        down = np.setdiff1d(np.unique(place[worst[(y[doc[worst]] == 0) & (decision[worst] > FLOOR)]]), good)
        rows, label = np.r_[up, down], np.r_[np.ones(len(up)), np.zeros(len(down))]
        if not len(up) or not len(down):
            break
    return out


def _spread(candidates: np.ndarray, n: int) -> np.ndarray:
    """Two thirds of the places for the first candidates, the rest even over the others."""
    first = candidates[: 2 * n // 3]
    rest = candidates[len(first) :]
    return np.r_[first, rest[np.unique(np.linspace(0, len(rest) - 1, n - len(first)).astype(int))] if len(rest) else first[:0]]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE, learn: str = "true") -> Machine:
    """A machine fitted on at most ``rows`` labelled documents that ``learn`` (SQL over doc_id) allows.

    The sample goes to one task, since its words would not leave the driver enough memory; the machine comes back.
    """
    got = sample(docs, labels, label, rows, learn).select("doc_id", "label", "text").repartition(1).mapInArrow(_fitted, "machine binary").first()
    return pickle.loads(bytes(got[0])) if got else fit([], np.zeros(0, int))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["doc_id"], r["label"], r["text"]) for b in batches for r in b.to_pylist())
    machine = fit([r[2] for r in rows], np.array([r[1] for r in rows], int))
    machine.keys, machine.values = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    yield pa.RecordBatch.from_pydict({"machine": [pickle.dumps(machine)]})


def _scorer(machine: Machine, name: str, schema: pa.Schema) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches, limit=PIECE):
            got = machine.score(machine.worst(units(piece.column(piece.schema.get_field_index("text")))))
            out = {n: piece.column(i) for i, n in enumerate(piece.schema.names)} | {name: pa.array(got)}
            yield pa.RecordBatch.from_arrays([out[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    return score


def score_toxicity(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """The columns of ``docs`` with the probability of label 1.

    Null and empty texts have no unit and get the lowest value there is. Every row is scored alone, so repeated rows score
    alike. An input column of that name is replaced.
    """
    rows = without(docs, name)
    result = StructType([*rows.schema.fields, *StructType.fromDDL(f"{name} double").fields])
    return rows.mapInArrow(_scorer(machine, name, to_arrow_schema(result)), result)
