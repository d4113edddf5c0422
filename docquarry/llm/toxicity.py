"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A text's instances are its words; runs of single characters (as in a word
spelled with blanks) count as one more. Two instances are compared by the gapped
subsequence kernel: all subsequences of three characters of the alphabet, each
occurrence weighted by `decay` to the power of the length it spans (at most
`SPAN`), normalised. Characters outside the alphabet, such as inserted
punctuation, only widen gaps, so spaced or starred insults stay close to the plain
word.

Training takes labelled documents up to a documented number and cuts them into
sentences, which take their document's label (one of both kinds isn't toxic;
copies count once). The sentences of a toxic document hold some toxic instance,
but it isn't known which, so each toxic document names a few witnesses: first by
the evidence of the sentences' counts, in further turns by the machine's
margins. Others of its instances, explained by these, aren't learnt. The machine
is trained on the witnesses against the instances of all sentences that aren't
toxic. Of these it needs those within its margin only:
each round scores them all and adds what the machine gets wrong, until nothing
much is wrong. The kernel with landmarks among the instances gives the Nyström features
of a linear machine with squared hinge loss. Because the machine is linear in
the kernel, its landmarks fold into one table with a weight for each
subsequence, and a word's margin is a sum of look-ups. A document's score is a
logistic function of its two greatest margins, fitted on the same documents.

Defined results: a null or empty text has no instance and gets the least score;
margins below -1 count as -1, as do words of less than three characters; words
longer than `WIDTH` characters are learnt and scored in overlapping windows; all
of a text is read; rows are scored each, so repeated
rows and null keys each give a result (a null key is never held out); labels that are
null or whose document is missing are ignored; without both kinds of labels every
score is that of the share of toxic labels (0.5 if there are none); an empty table of documents
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, partitions, remembers, small_batches, text_or_empty, written

#: Greatest length that a subsequence may span, width of a word's window, its step.
SPAN, WIDTH, STEP = 9, 32, 16
#: Size of the alphabet with 0 for what lies outside.
SYMBOLS = 64
#: Words that a task remembers; characters of the texts it looks at together.
REMEMBERED, TOGETHER = 400_000, 1_000_000

_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
_STEPS = [(d, e) for d in range(1, SPAN) for e in range(1, SPAN) if d + e < SPAN]


def instances(text: str) -> list[str]:
    """Words in lower case, and runs of three or more single characters joined."""
    words = text.lower().split()
    run: list[str] = []
    found: list[str] = []
    if any(len(w) == 1 for w in words):
        for w in (*words, "--"):
            if len(w) == 1 or len(w) == 2 and run and not w.isalnum():
                run.append(w)
            else:
                if len(run) > 2:
                    found.append("".join(run))
                run = []
    return words + found


def windows(word: str) -> list[str]:
    if len(word) <= WIDTH:
        return [word]
    return [word[i : i + WIDTH] for i in range(0, len(word) - STEP, STEP)]


@dataclass
class Kernel:
    alphabet: str
    decay: float = 0.6

    def __post_init__(self):
        self.of = np.zeros(0x110000, np.uint8)
        for i, c in enumerate(self.alphabet, 1):
            self.of[ord(c)] = i

    def symbols(self, words: list[str], width: int) -> np.ndarray:
        """One row of symbols for each word of at most `width` characters."""
        joined = "".join([w.ljust(width, "\0") for w in words])
        return self.of[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(len(words), width).astype(np.int32)

    def subsequences(self, s: np.ndarray):
        """For each way of spanning: (codes, 0 if not all of the alphabet; weight)."""
        n = s.shape[1]
        for d, e in _STEPS:
            if d + e < n:
                a, b, c = s[:, : n - d - e], s[:, d : n - e], s[:, d + e :]
                yield np.where((a > 0) & (b > 0) & (c > 0), (a * SYMBOLS + b) * SYMBOLS + c, 0), self.decay ** (d + e + 1)

    def features(self, words: list[str], kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
        """Normalised features of a few words, dense over the codes that occur: (words, codes), the codes."""
        s = self.symbols(words, WIDTH)
        parts = list(self.subsequences(s))
        codes, where = np.unique(np.concatenate([c.ravel() for c, _ in parts]), return_inverse=True)
        out, at = np.zeros((len(words), len(codes)), kind), 0
        for c, weight in parts:
            np.add.at(out, (np.arange(len(words)).repeat(c.shape[1]), where[at : at + c.size]), weight)
            at += c.size
        out[:, codes == 0] = 0
        out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out, dtype=np.float64)), 1e-12).astype(kind)[:, None]
        return out, codes

    def similar(self, words: list[str], base: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Kernel of a few words with the landmarks whose features over `codes` are given."""
        x, own = self.features(words, base.dtype.type)
        _, i, j = np.intersect1d(own, codes, assume_unique=True, return_indices=True)
        return x[:, i] @ base[:, j].T

    def margins(self, words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
        """The machine's margins, at least -1. `table`: weight of each code, that of 0 is 0."""
        out = np.full(len(words), -1.0)
        lengths = np.array([len(w) for w in words])
        for low, width in ((2, 8), (8, 12), (12, 16), (16, WIDTH)):
            some = np.nonzero((lengths > low) & (lengths <= width))[0]
            for i in range(0, len(some), 4096):
                part = some[i : i + 4096]
                s = self.symbols([words[j] for j in part], width)
                raw, norm = np.zeros(len(part)), np.zeros(len(part))
                for codes, weight in self.subsequences(s):
                    raw += weight * table[codes].sum(axis=1)
                    norm += weight**2 * np.count_nonzero(codes, axis=1)
                # the norm is at least this, so a positive sum has at most this margin
                most = np.where(raw > 0, raw / np.sqrt(np.maximum(norm, 1e-12)), 0.0)
                hopeful = np.nonzero(most + bias > -1)[0]
                if len(hopeful):
                    out[part[hopeful]] = np.maximum(-1.0, raw[hopeful] / self._norms(s[hopeful]) + bias)
        return out

    def _norms(self, s: np.ndarray) -> np.ndarray:
        """Exact norms: occurrences of one subsequence add up before they are squared."""
        parts = list(self.subsequences(s))
        codes = np.concatenate([c for c, _ in parts], axis=1)
        weights = np.concatenate([np.full(c.shape[1], w) for c, w in parts])
        order = np.argsort(codes, axis=1, kind="stable")
        codes = np.take_along_axis(codes, order, axis=1)
        total = np.where(codes > 0, weights[order], 0.0)
        flat = codes.ravel() + np.arange(len(s)).repeat(codes.shape[1]) * SYMBOLS**3
        first = np.nonzero(np.r_[True, flat[1:] != flat[:-1]])[0]
        sums = np.add.reduceat(total.ravel(), first)
        return np.sqrt(np.maximum(np.bincount(flat[first] // SYMBOLS**3, sums**2, len(s)), 1e-12))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3e-6) -> np.ndarray:
    """Newton's method for a linear machine; the last component is the bias. Sums are in doubles, some rows at a time."""
    n = x.shape[1]
    w, keep = np.zeros(n + 1), ridge * np.r_[np.ones(n), 1e-3]
    for _ in range(50):
        gradient, curve = keep * w, np.diag(keep)
        for i in range(0, len(x), 2048):
            part = np.hstack([x[i : i + 2048].astype(np.float64), np.ones((len(x[i : i + 2048]), 1))])
            told = part @ w
            on = y[i : i + 2048] * told < 1
            xo, co = part[on], weight[i : i + 2048][on]
            gradient += xo.T @ (co * (told[on] - y[i : i + 2048][on]))
            curve += (xo * co[:, None]).T @ xo
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Two slopes, not below zero, and an offset, by Newton's method."""
    free = np.ones(x.shape[1] + 1, bool)
    x = np.hstack([x, np.ones((len(x), 1))])
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = ((x * (p - y)[:, None]).mean(axis=0) + ridge * w)[free]
            curve = (x.T @ (x * (p * (1 - p))[:, None]) / len(x) + ridge * np.eye(len(w)))[np.ix_(free, free)]
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(curve, gradient)
            w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-7:
                break
        below = free[:-1] & (w[:-1] < 0)
        if not below.any():
            return w
        free[:-1] &= ~below


@dataclass
class Model:
    alphabet: str
    decay: float
    table: np.ndarray
    bias: float
    logistic: np.ndarray


class Scorer:
    """Margins of words, remembered from batch to batch."""

    def __init__(self, model: Model):
        self.model, self.kernel = model, Kernel(model.alphabet, model.decay)
        self.known: set[str] = set()
        #: margins above the least
        self.high: dict[str, float] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.high.clear()
        new = list(words - self.known)
        pieces = [(i, p) for i, w in enumerate(new) for p in windows(w)]
        margins = self.kernel.margins([p for _, p in pieces], self.model.table, self.model.bias)
        best = np.full(len(new), -1.0)
        np.maximum.at(best, np.array([i for i, _ in pieces], np.int64), margins)
        self.known.update(new)
        for i in np.nonzero(best > -1)[0]:
            self.high[new[i]] = float(best[i])

    def two(self, texts: list[str]) -> np.ndarray:
        """The two greatest margins of each text."""
        out, i = np.full((len(texts), 2), -1.0), 0
        while i < len(texts):
            j, size, told, new = i, 0, [], set()
            while j < len(texts) and (j == i or size < TOGETHER):
                told.append(instances(texts[j]))
                new.update(told[-1])
                size += len(texts[j])
                j += 1
            self.learn(new)
            high = self.high
            for k, words in enumerate(told, i):
                hits = sorted([high[w] for w in words if w in high])[-2:]
                out[k, : len(hits)] = hits[::-1]
            i = j
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        two = self.two(texts)
        return 1 / (1 + np.exp(-np.clip(two @ self.model.logistic[:2] + self.model.logistic[2], -30, 30)))


_scorers: dict[int, Scorer] = {}


def _scorer(model: Model, mark: int) -> Scorer:
    remembers("toxicity", _scorers.clear)
    if mark not in _scorers:
        _scorers.clear()
        _scorers[mark] = Scorer(model)
    return _scorers[mark]


def cut_sentences(text: str) -> list[str]:
    return [x for x in (" ".join(s.split()) for s in _SENTENCE.split(text)) if x]


def _pieces(text: str) -> set[str]:
    """The instances of a text that can be learnt."""
    return {p for w in set(instances(text)) for p in windows(w) if len(p) > 2}


def _flat(toxic: int, clean: int, decay: float) -> Model:
    """Without instances of both kinds every score is the share of toxic texts."""
    share = (toxic + 0.5) / (clean + toxic + 1) if clean + toxic else 0.5
    return Model("abc", decay, np.zeros(SYMBOLS**3, np.float32), -1.0, np.array([0.0, 0.0, np.log(share / (1 - share))]))


class _Machine:
    """Landmarks, and the linear machine over their Nyström features."""

    def __init__(self, kernel: Kernel, landmarks: list[str]):
        self.kernel = kernel
        self.base, self.codes = kernel.features(landmarks, np.float32)
        values, vectors = np.linalg.eigh((self.base @ self.base.T).astype(np.float64))
        some = values > 1e-6 * values[-1]
        self.root = vectors[:, some] / np.sqrt(values[some])

    def nystroem(self, words: list[str]) -> np.ndarray:
        parts = [(self.kernel.similar(words[i : i + 128], self.base, self.codes) @ self.root).astype(np.float32) for i in range(0, len(words), 128)]
        return np.concatenate([np.zeros((0, self.root.shape[1]), np.float32), *parts])

    def trained(self, good: np.ndarray, bad: np.ndarray, weight: np.ndarray, others: int) -> tuple[Model, float]:
        """The model of toxic instances `bad` with weights of sum 1 and `good` ones, `others` in all; its loss."""
        y = np.r_[np.ones(len(bad)), -np.ones(len(good))]
        x, w = np.concatenate([bad, good]), np.r_[weight, np.full(len(good), 1.0 / others)]
        machine = squared_hinge(x, y, w)
        table = np.zeros(SYMBOLS**3, np.float32)
        table[self.codes] = self.base.T @ (self.root @ machine[:-1]).astype(np.float32)
        table[0] = 0
        loss = (w * np.maximum(0, 1 - y * (x @ machine[:-1].astype(np.float32) + machine[-1])) ** 2).sum()
        return Model(self.kernel.alphabet, self.kernel.decay, table, float(machine[-1]), np.zeros(3)), float(loss)


def _wrong(ordinary: DataFrame, machine, model: Model, known: set[str], most: int) -> tuple[float, list[str], np.ndarray]:
    """Of the ordinary instances that aren't known: the sum of squared excesses over the margin; the `most` worst and their features.

    `machine`: a broadcast.
    """
    seen = ordinary.sparkSession.sparkContext.broadcast((model, known))

    def run(batches):
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if w not in seen.value[1]]
            model = seen.value[0]
            over = machine.value.kernel.margins(words, model.table, model.bias) + 1 if words else np.zeros(0)
            some = np.flatnonzero(over > 1e-3)
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in some], pa.string()), pa.array(over[some])], names=["w", "over"])

    def told(batches):
        for batch in batches:
            x = machine.value.nystroem(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=["w", "x"])

    found = written(ordinary.mapInArrow(run, "w string, over double"), "toxic-wrong")
    missed = found.agg(F.sum(F.col("over") * F.col("over"))).first()[0] or 0.0
    worst = written(found.orderBy(F.desc("over"), "w").limit(most).select("w"), "toxic-worst")
    got = worst.repartition(partitions(ordinary.sparkSession)).mapInArrow(told, "w string, x array<float>").orderBy("w").toArrow().combine_chunks()
    seen.unpersist()
    discard(found, worst)
    x = got.column("x").chunk(0).values.to_numpy().reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, machine.value.root.shape[1]), np.float32)
    return float(missed), got.column("w").to_pylist(), x


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20_000, landmarks: int = 256, decay: float = 0.6, lift: float = 4.0, named: int = 3, turns: int = 1, tolerance: float = 0.02) -> Model:
    """Learn from the sentences of at most `sample` labelled documents (those of least key hash).

    `landmarks` is the size of the model; `lift`: how many times as often a first witness stands in toxic sentences
    as in others, at least; `named`: how many witnesses a toxic document names; `turns`: how often witnesses are named; `tolerance`: the share of the loss
    that instances which the machine hasn't seen may have when a turn's training ends.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    # bounded: `sample` ids
    chosen = written(chosen.orderBy(F.xxhash64(key), key).limit(sample), "toxic-sample")
    texts = written(docs.select(key, text_or_empty(text).alias("_text")).join(F.broadcast(chosen), key).groupBy("_text").agg(F.max("_y").alias("_y")).select("_text", "_y"), "toxic-texts")
    clean_texts, toxic_texts = (int(texts.where(F.col("_y") == y).count()) for y in (0, 1))
    if not clean_texts or not toxic_texts:
        return _flat(toxic_texts, clean_texts, decay)

    def split(batches):
        for batch in batches:
            told = [(x, y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in cut_sentences(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in told], pa.string()), pa.array([y for _, y in told], pa.int32())], names=["x", "y"])

    said = written(texts.mapInArrow(split, "x string, y int").groupBy("x").agg(F.min("y").alias("y")), "toxic-sentences")
    clean, toxic = (max(1, int(said.where(F.col("y") == y).count())) for y in (0, 1))

    def count(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in _pieces(t):
                    seen.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([a for a, _ in seen.values()], pa.int64()), pa.array([b for _, b in seen.values()], pa.int64())], names=["w", "clean", "toxic"])

    counts = written(said.mapInArrow(count, "w string, clean long, toxic long").groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-words")
    # the log-likelihood gained by an instance's rate in toxic sentences over `lift` times that in others; beyond what
    # the luckiest of all instances would gain by chance
    evidence = lambda n: F.col(n) * F.log((F.col(n) / toxic) / ((F.col("clean") + 0.5) / clean) / lift)
    bar = float(np.log(max(1, counts.count()))) + 3
    told = counts.where(evidence("toxic") >= bar)
    hopes = {r["w"]: 0.0 for r in told.select("w").collect()}

    def neighbours(batches):
        for batch in batches:
            told = []
            for t in batch.column(0).to_pylist():
                words = ["", *t.lower().split(), ""]
                found = {p: (a, b) for a, w, b in zip(words, words[1:], words[2:]) for p in windows(w) if p in hopes}
                told += [(p, side, x) for p, n in found.items() for side, x in enumerate(n)]
            yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in told], (pa.string(), pa.int32(), pa.string())[i]) for i in range(3)], names=["w", "side", "x"])

    # a document counts once; near copies count little, as an instance has the same neighbours in them: the number of
    # equally frequent neighbours that would meet by chance as often as an instance's do, on the side where it is less
    near = texts.where("_y = 1").select("_text").mapInArrow(neighbours, "w string, side int, x string").groupBy("w", "side", "x").agg(F.count("*").alias("n"))
    apart = near.groupBy("w", "side").agg((F.pow(F.sum("n"), F.lit(2)) / F.sum(F.col("n") * F.col("n"))).alias("k")).groupBy("w").agg(F.min("k").alias("places"))
    hopes = {r["w"]: r["e"] for r in told.join(apart, "w").withColumn("e", evidence("places")).where(F.col("e") >= bar).select("w", "e").collect()}

    def witnesses(best) -> dict[str, int]:
        """How many toxic documents name each instance; `best`: those that one names."""

        def run(batches):
            for batch in batches:
                told = [w for t in batch.column(0).to_pylist() for w in best(_pieces(t))]
                yield pa.RecordBatch.from_arrays([pa.array(told, pa.string())], names=["w"])

        found = texts.where("_y = 1").select("_text").mapInArrow(run, "w string").groupBy("w").agg(F.count("*").alias("n"))
        return {r["w"]: r["n"] for r in found.orderBy("w").collect()}

    bad = witnesses(lambda words: sorted((w for w in words if w in hopes), key=lambda w: (-hopes[w], w))[:named])
    # seen in a sentence that isn't toxic
    ordinary = counts.where("clean > 0").select("w")
    others = ordinary.count()
    if not bad or not others:
        return _flat(toxic_texts, clean_texts, decay)
    start = [r["w"] for r in ordinary.orderBy(F.xxhash64("w"), "w").limit(8 * landmarks).collect()]
    seen: dict[str, int] = {}
    for w in [*bad, *start]:
        for c in w:
            if c.isalnum():
                seen[c] = seen.get(c, 0) + 1
    kernel = Kernel("".join(sorted(sorted(seen, key=lambda c: (-seen[c], c))[: SYMBOLS - 1])), decay)
    spread = lambda ws, n: sorted(ws, key=lambda w: (zlib.crc32(w.encode()), w))[:n]
    known = sorted(set(start) - set(bad))
    marks = spread(bad, landmarks // 2)
    machine = _Machine(kernel, marks + spread(known, landmarks - len(marks)))
    good = machine.nystroem(known)
    held = spark.sparkContext.broadcast(machine)
    for turn in range(turns):
        weight = np.array(list(bad.values()), float)
        told = machine.nystroem(list(bad))
        while True:
            model, loss = machine.trained(good, told, weight / weight.sum(), others)
            # instances that a witness is one of are no counterexamples
            missed, words, x = _wrong(ordinary, held, model, {*known, *bad}, 16 * landmarks)
            if missed / others <= tolerance * loss:
                break
            known, good = [*known, *words], np.concatenate([good, x])
        if turn + 1 < turns:
            scorer = spark.sparkContext.broadcast(model)
            bad = witnesses(_by_margin(scorer, named)) or bad
            gone = np.array([w not in bad for w in known])
            known, good = [w for w in known if w not in bad], good[gone]

    def margins(batches):
        scorer = Scorer(model)
        for batch in batches:
            two = scorer.two(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), batch.column(1)], names=["a", "b", "y"])

    held.unpersist()
    del machine, good, told
    lean()
    fit = texts.mapInArrow(margins, "a double, b double, y int").toArrow()
    a, b, y = (fit.column(c).to_numpy() for c in ("a", "b", "y"))
    model.logistic = logistic(np.stack([a, b], axis=1), y.astype(float))
    return model


def _by_margin(held, named: int):
    """The instances of the greatest margins that the machine calls toxic."""
    kept: list[Scorer] = []

    def best(words: set[str]) -> list[str]:
        if not kept:
            kept.append(Scorer(held.value))
        kept[0].learn(words)
        high = kept[0].high
        return sorted((w for w in words if high.get(w, 0.0) > 0), key=lambda w: (-high[w], w))[:named]

    return best


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The kept columns, score and predicted."""
    small_batches(docs.sparkSession)
    held, mark = docs.sparkSession.sparkContext.broadcast(model), zlib.crc32(model.table.tobytes() + model.logistic.tobytes())
    rows = docs.select(*keep, text_or_empty(text).alias("_score_text"))

    def run(batches):
        scorer = _scorer(held.value, mark)
        for batch in batches:
            s = scorer.scores(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{fields}, score double, predicted int")


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted; learns from labels that aren't held out."""
    model = train(docs, labels.where(~held_out(key)), key, text)
    return score(docs, model, (key,), text).select(key, held_out(key).alias("held_out"), "score", "predicted")
