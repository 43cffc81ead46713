"""Toxicity by a support vector machine on a gapped-subsequence string kernel, with Nyström landmarks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import share_of, table
from .language import remainder

#: Length of the common subsequences, decay for each character they span, and the longest string that is compared whole.
LENGTH, DECAY, WIDTH = 4, 0.7, 8
LANDMARKS, TOXIC_DOCS, CLEAN_DOCS, LONGEST = 24, 2000, 4000, 1 << 18
#: A landmark's run of characters is in so many toxic texts at least, and so many times as often as in clean ones.
LEAST_USES, LEAST_RATIO = 3, 6
#: A landmark is sure if that ratio is this, and its run has this share of the uses in toxic texts.
SURE_RATIO, SURE_SHARE = 20, 0.01
#: Landmarks are less alike than this.
ALIKE = 0.5
FOLDS, HELD_OUT, CACHE, PAIRS = 5, 0, 200_000, 1 << 14
#: Words below this kernel with every landmark count as unlike all. Close characters; parts that long words are cut into; the mark of a word's start.
LEAST, CLOSE, PIECE, START = 0.2, 3, 32, "^"
NO_LETTERS = re.compile(r"[\W\d_]+")
ENDS = ".,;:!?()[]{}\"'|*#&$%+-_=/<>~`"


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The kernel of each row of code points ``s`` with the same row of ``t`` (0 in s and 1 in t fill up short strings).

    It sums, over the subsequences of LENGTH characters that both have, DECAY to the power of the characters that
    they span in s and in t: gaps and inserted characters cost a factor each, and do not break a match.
    """
    same = (s[:, :, None] == t[:, None, :]).astype(np.float32).transpose(1, 2, 0)
    n, m = same.shape[:2]
    before = np.ones((n + 1, m + 1, len(s)), np.float32)
    for _ in range(LENGTH - 1):
        now = np.zeros_like(before)
        for i in range(1, n):
            run = np.zeros(len(s), np.float32)
            for j in range(1, m):
                run = DECAY * run + DECAY**2 * same[i - 1, j - 1] * before[i - 1, j - 1]
                now[i, j] = DECAY * now[i - 1, j] + run
        before = now
    return DECAY**2 * (same * before[:-1, :-1]).sum(axis=(0, 1))


def codes(strings: list[str], fill: int = 0, width: int = 0) -> np.ndarray:
    width = width or WIDTH
    out = np.array(strings, dtype=f"<U{width}").view(np.uint32).reshape(-1, width)
    return np.where(out == 0, fill, out).astype(np.uint32)


def pair_masks(c: np.ndarray) -> np.ndarray:
    """256 bits a row: hashes of the ordered pairs of characters at most CLOSE apart."""
    out = np.zeros((len(c), 4), np.uint64)
    rows = np.arange(len(c))
    for i in range(c.shape[1] - 1):
        for j in range(i + 1, min(c.shape[1], i + 1 + CLOSE)):
            a, b = c[:, i], c[:, j]
            h = (a * np.uint32(2654435761) + b * np.uint32(40503)) >> np.uint32(7) & np.uint32(255)
            bit = np.where((a > 1) & (b > 1), np.left_shift(np.uint64(1), (h & 63).astype(np.uint64)), np.uint64(0))
            out[rows, h >> 6] |= bit
    return out


def pieces(word: str) -> list[str]:
    """A word with a mark at its start, in overlapping parts if it is long; so too its letters alone, and every second character of it.

    These readings find insults with marks, or with one character, between all their letters: the kernel of such gaps is too small.
    """
    word = word.strip(ENDS)
    readings = [word]
    if len(word) >= 2 * LENGTH - 1:
        readings += [x for x in (NO_LETTERS.sub("", word), word[::2]) if LENGTH <= len(x) < len(word)]
    return [w[i : i + PIECE] for w in (START + x for x in readings) for i in range(0, max(1, len(w) - WIDTH + 1), PIECE - WIDTH + 1)]


def spelled(words: list[str]) -> list[str]:
    """The words that runs of LENGTH or more single letters spell."""
    out, run = [], ""
    for w in (*words, ""):
        letter = w.strip(ENDS)
        if len(letter) == 1:
            run += letter
        else:
            if len(run) >= LENGTH:
                out.append(run)
            run = ""
    return out


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence, in lower case, and those that are spelled letter by letter."""
    lower = (text or "").lower()
    for end in (". ", "! ", "? "):
        lower = lower.replace(end, "\n")
    return [w + spelled(w) for line in lower.split("\n") if (w := line.split())]


class Features:
    """Normalised kernels of words with the landmarks: the largest over the parts of a word."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, self.codes = landmarks, codes(landmarks, 1)
        self.self = np.sqrt(self._self(codes(landmarks)))
        self.masks = pair_masks(self.codes)
        self.forget()

    def forget(self) -> None:
        self.row_of: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    @staticmethod
    def _self(c: np.ndarray) -> np.ndarray:
        return kernel(c, np.where(c == 0, 1, c))

    def similar(self, strings: list[str]) -> np.ndarray:
        """Largest kernels of the parts of WIDTH characters of each string with all landmarks.

        Strings that share fewer than LENGTH close pairs of characters with a landmark count as unlike it.
        """
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        for low, high in ((0, WIDTH), (WIDTH, 2 * WIDTH), (2 * WIDTH, PIECE)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for a in range(0, len(rows), PAIRS):
                part = rows[a : a + PAIRS]
                c = codes([strings[r] for r in part.tolist()], 0, high)
                masks, shared = pair_masks(c), np.zeros((len(part), len(self.landmarks)), np.uint8)
                for k in range(4):
                    shared += np.bitwise_count(masks[:, k, None] & self.masks[None, :, k])
                i, j = np.nonzero(shared >= LENGTH)
                for k in range(0, len(i), PAIRS):
                    p, q = i[k : k + PAIRS], j[k : k + PAIRS]
                    for start in range(high - WIDTH + 1):
                        on = np.flatnonzero(start <= np.maximum(sizes[part[p]] - WIDTH, 0))
                        if len(on):
                            s = np.ascontiguousarray(c[p[on], start : start + WIDTH])
                            value = kernel(s, self.codes[q[on]]) / self.self[q[on]]
                            some = np.flatnonzero(value > LEAST * DECAY**LENGTH)  # no string's own kernel is less than that
                            at = part[p[on[some]]], q[on[some]]
                            out[at] = np.maximum(out[at], value[some] / np.sqrt(self._self(s[some])))
        return out

    def learn(self, words: set[str]) -> None:
        """Give each new word a row, or -1 if it is like no landmark."""
        if len(self.row_of) > CACHE:
            self.forget()
        new = [w for w in words if w not in self.row_of]
        parts, first = [], []
        for w in new:
            first.append(len(parts))
            parts += pieces(w)
        if not new:
            return
        values = np.maximum.reduceat(self.similar(parts), first, axis=0)
        for w, v, b in zip(new, values, values.max(axis=1).tolist()):
            if b < LEAST:
                self.row_of[w] = -1
            else:
                self.row_of[w] = len(self.rows)
                self.rows.append(v)

    def pooled(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each sentence with words like a landmark: its text's index, and the largest kernels of its words."""
        split = [sentences(t) for t in texts]
        self.learn({w for doc in split for s in doc for w in s})
        owner, first, rows, row_of = [], [], [], self.row_of
        for d, doc in enumerate(split):
            for s in doc:
                if found := [r for w in s if (r := row_of[w]) >= 0]:
                    owner.append(d)
                    first.append(len(rows))
                    rows += found
        if not rows:
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)), np.float32)
        used, at = np.unique(rows, return_inverse=True)
        return np.array(owner), np.maximum.reduceat(np.stack([self.rows[r] for r in used])[at], first, axis=0)


def pick_landmarks(toxic: list[str], clean: list[str], most: int = LANDMARKS) -> tuple[list[str], list[str]]:
    """Strings of training words: for the runs of 5 characters (or a word's first 4) most over-used in toxic texts, a word that has it.

    Also those words of the landmarks that are sure to be insults."""
    uses = []
    for texts in (toxic, clean):
        c: Counter = Counter()
        for t in texts:
            c.update({w.strip(ENDS) for s in sentences(t) for w in s})
        uses.append(c)
    runs: tuple[Counter, Counter] = Counter(), Counter()
    best: dict[str, tuple[int, str]] = {}
    for side, c in enumerate(uses):
        for w, n in c.items():
            marked = START + w
            if len(w) >= LENGTH:
                for i in range(len(marked) - 4):
                    run = marked[i : i + 5]
                    runs[side][run] += n
                    if not side and (n, w) > best.get(run, (0, "")):
                        best[run] = n, w
    odds = {r: np.log((a + 0.5) / (len(toxic) + 1)) - np.log((runs[1][r] + 0.5) / (len(clean) + 1)) for r, a in runs[0].items() if a >= LEAST_USES}
    chosen: list[str] = []
    sure: list[str] = []
    known: Features | None = None
    for run in sorted((r for r, o in odds.items() if o > np.log(LEAST_RATIO)), key=lambda r: (-runs[0][r] * odds[r] ** 2, r)):
        if len(chosen) == most:
            break
        word = START + best[run][1]
        start = word.index(run)
        string = word[start : start + WIDTH]
        if known is None or known.similar([string]).max() < ALIKE:
            chosen.append(string)
            if odds[run] > np.log(SURE_RATIO) and runs[0][run] > SURE_SHARE * len(toxic):
                sure.append(best[run][1])
            known = Features(chosen)
    return chosen, sure


def _svm(x: np.ndarray, y: np.ndarray, c: float = 100.0, steps: int = 30) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, classes weighed alike, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c * 100
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        new = np.linalg.solve(ridge + a.T @ x[on], a.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to probabilities (Platt)."""
    high, low = ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2)
    goal, x, w = np.where(y > 0, high, low), np.stack([f, np.ones_like(f)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - goal))
    return max(float(w[0]), 1e-3), float(w[1])


class Model:
    """Score of a text: the machine's value for its most toxic sentence, as a probability."""

    def __init__(self, toxic: list[str], clean: list[str]):
        self.landmarks, sure = pick_landmarks(toxic, clean) if toxic and clean else ([], [])
        self.constant = len(toxic) / max(1, len(toxic) + len(clean))
        self.features: Features | None = None
        if self.landmarks:
            self._fit(toxic, clean, sure)

    def _fit(self, toxic: list[str], clean: list[str], sure: list[str]) -> None:
        features = Features(self.landmarks)
        texts, parts = toxic + clean, []
        for i in range(0, len(texts), 100):  # sentences of a few documents at a time
            owner, x = features.pooled(texts[i : i + 100])
            parts.append((owner + i, x))
        owner, x = np.concatenate([o for o, _ in parts]), np.concatenate([x for _, x in parts])
        values, vectors = np.linalg.eigh(features.similar(self.landmarks).astype(np.float64))
        project = vectors / np.sqrt(np.maximum(values, 1e-3))  # Nyström: kernels to coordinates
        y = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
        z = x @ project
        rank = x.max(axis=1, initial=0)
        # insults by themselves, as they are and with a character put in, are toxic sentences too
        alone = [w for s in sure for w in (s, *(s[:k] + c + s[k:] for k in (2, 3) for c in "-x"))]
        extra = features.pooled(alone)[1] @ project
        for _ in range(4):  # a toxic text stands for its most toxic sentence, a clean one for its hardest
            top = np.full(len(y), -1)
            order = np.argsort(rank, kind="stable")
            top[owner[order]] = order
            own = np.where(top[:, None] >= 0, z[top], 0.0)
            w = _svm(np.vstack([own, extra]), np.concatenate([y, np.ones(len(extra))]))
            rank = z @ w[:-1]
        self.weights, self.bias = project @ w[:-1], float(w[-1])
        self.slope, self.shift = _calibrate(np.vstack([own, extra]) @ w[:-1] + self.bias, np.concatenate([y, np.ones(len(extra))]))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(texts), self.constant)
        if self.features is None:
            self.features = Features(self.landmarks)
        owner, x = self.features.pooled(texts)
        f = np.full(len(texts), self.bias)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, x @ self.weights + self.bias)
        f = np.where(np.isfinite(best), best, f)
        return 1 / (1 + np.exp(-np.clip(self.slope * f + self.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, longest: int = LONGEST) -> Model:
    """Learn from docs (doc_id, text) with labels (doc_id, toxic); of each class about so many documents, picked by a hash of doc_id.

    A doc_id with both labels is toxic; of several texts of one doc_id the least is read. Texts of over ``longest``
    bytes are not learned from, so that the sample has a bound.
    """
    labels = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    many = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    hashed, some = F.xxhash64("_id"), F.lit(False)
    for k, most in ((1, toxic_docs), (0, clean_docs)):
        some = F.when(F.col("toxic") == k, share_of(hashed, most, many.get(k, 0))).otherwise(some)
    rows = docs.select("doc_id", "text").join(F.broadcast(labels.filter(some)), F.col("doc_id") == F.col("_id"))
    rows = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(rows.collect(), key=lambda r: r.doc_id)
    return Model([r.text or "" for r in rows if r.toxic == 1], [r.text or "" for r in rows if r.toxic == 0])


BATCH = 1 << 21


def _scored(model, texts: list[str | None]) -> np.ndarray:
    """Scores, about two million characters at a time."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > BATCH or i == len(texts) - 1:
            out.append(model.score(texts[start : i + 1]))
            start, size = i + 1, 0
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row; a null or empty text has no sentences and gets the machine's value for none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scored(shared.value, batch.column("text").to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score under ``at``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(shared.value, batch.column("text").to_pylist()) < at))

    return docs.mapInArrow(run, docs.schema)


def learned(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the tables, from the labels of the folds that aren't held out."""
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    return train(table(spark, sf_dir, "documents"), labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), learned(spark, sf_dir))
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
