"""Language identification by prediction by partial matching (PPM, method C) with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import share_of, table

ORDER, DOCS_A_LANGUAGE, CHUNK = 2, 2000, 1 << 21
FOLDS, HELD_OUT = 4, 2
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def _stream(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, in lower case (A-Z), each after ``order`` spaces; and where each begins."""
    parts = [b" " * order + t.lower() for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _own(n: int, begins: np.ndarray, order: int) -> np.ndarray:
    """Which bytes of a stream are a text's own."""
    own = np.ones(n, bool)
    for k in range(order):
        own[begins + k] = False
    return own


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) of docs (lang, text): the ``order`` + 1 bytes up to each byte of the texts, as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()
            for lang in sorted(set(langs)):
                data, begins = _stream([t for t, x in zip(texts, langs) if x == lang], order)
                gram = np.zeros(max(0, len(data) - order), np.int64)
                for k in range(order + 1):
                    gram = gram << 8 | data[k : len(data) - order + k]
                own, n = np.unique(gram[_own(len(data), begins, order)[order:]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(own), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Code lengths of every byte after every context, for each language.

    A context tree has, for each context up to ``order`` bytes, how often each byte followed. A byte seen T' of T
    times after a context of q different bytes has T'/(T+q) there; the escape q/(T+q) goes to the bytes not seen, in
    the proportions that the context one byte shorter gives them, down to equal shares of the 256 bytes. All of this
    is worked out beforehand: rows of ``bits`` are contexts that some language has, columns are bytes (one for all
    that training hasn't), and ``row_of`` has the row of the longest known end of each run of ``order`` bytes.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int):
        self.langs, self.order = sorted(counts), order
        if not counts:
            return
        seen = np.zeros(256, bool)
        for gram, _ in counts.values():
            for k in range(order + 1):
                seen[gram >> 8 * k & 255] = True
        known = np.flatnonzero(seen)
        self.symbols = a = len(known) + 1
        self.symbol_of = np.full(256, a - 1, np.int64)
        self.symbol_of[known] = np.arange(a - 1)
        other = max(1, 256 - len(known))
        each = {}
        for lang, (gram, n) in counts.items():
            code = np.zeros(len(gram), np.int64)
            for k in range(order, -1, -1):
                code = code * a + self.symbol_of[gram >> 8 * k & 255]
            each[lang] = code, n
        contexts = [np.unique(np.concatenate([c % a ** (k + 1) // a for c, _ in each.values()])) for k in range(order + 1)]
        share = np.full((1, len(self.langs), a), 1 / 256)
        share[:, :, -1] = other / 256
        made, below, row_of = [], share, np.zeros(1, np.int64)
        for k, context in enumerate(contexts):
            row = row_of[context % a ** max(0, k - 1)] if k else np.zeros(len(context), np.int64)
            lower = below[row]
            now = np.zeros_like(lower)
            for j, lang in enumerate(self.langs):
                code, n = each[lang]
                np.add.at(now, (np.searchsorted(context, code % a ** (k + 1) // a), j, code % a), n)
            total, kinds = now.sum(axis=2, keepdims=True), (now > 0).sum(axis=2, keepdims=True)
            rest = np.where(now > 0, 0, lower)
            left = rest.sum(axis=2, keepdims=True)
            escape = np.where(left > 0, kinds / np.maximum(total + kinds, 1), 0)
            got = now / np.maximum(np.where(left > 0, total + kinds, total), 1) + escape * rest / np.maximum(left, 1e-300)
            below = np.where(total > 0, got, lower)
            made.append(below.astype(np.float32))
            row_of = np.full(a**k, -1, np.int64)
            row_of[context] = np.arange(len(context))
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in made])])
        every = np.concatenate(made)
        every[:, :, -1] /= other
        self.bits = np.ascontiguousarray(-np.log2(every).transpose(0, 2, 1)).reshape(-1, len(self.langs))
        place = np.zeros(1, np.int32)
        for k, context in enumerate(contexts):
            place = np.tile(place, a) if k else place  # the longer context ends in the shorter one
            place[context] = offsets[k] + np.arange(len(context))
        self.row_of = place

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (not empty) in each language."""
        data, begins = _stream(texts, self.order)
        symbol = self.symbol_of[data]
        context = np.zeros(len(data) - self.order, np.int64)
        for k in range(self.order):
            context = context * self.symbols + symbol[k : len(data) - self.order + k]
        at = self.row_of[context].astype(np.int64) * self.symbols + symbol[self.order :]
        bits = self.bits[at].astype(np.float64)
        bits[~_own(len(data), begins, self.order)[self.order :]] = 0
        return np.add.reduceat(bits, begins, axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of least code length, and its share of the probability if all are equally likely before."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        while todo:
            part, size = [], 0
            while todo and size < CHUNK:
                part.append(i := todo.pop())
                size += len(texts[i])
            bits = self.lengths([texts[i].encode() for i in part])
            more = np.exp2(-(bits - bits.min(axis=1, keepdims=True)).clip(max=1000))
            for i, best, score in zip(part, bits.argmin(axis=1).tolist(), (1 / more.sum(axis=1)).tolist()):
                out[i] = self.langs[best], score
        return out


def remainder(doc_id, folds: int):
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(folds)), F.lit(0))


def train(docs: DataFrame, order: int = ORDER, docs_a_language: int = DOCS_A_LANGUAGE) -> Model:
    """Learn from docs (doc_id, lang, text). Of each language about ``docs_a_language`` whole documents are read, picked by a hash of doc_id and size."""
    docs = docs.filter("lang is not null and text is not null and text <> ''")
    many = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    hashed, some = F.xxhash64("doc_id", F.octet_length("text")), F.lit(False)
    for lang, n in many.items():
        some = F.when(F.col("lang") == lang, share_of(hashed, docs_a_language, n)).otherwise(some)
    picked = docs.filter(some)
    found = gram_counts(picked, order).toPandas()
    return Model({k: (g.gram.to_numpy(np.int64), g.n.to_numpy(np.int64)) for k, g in found.groupby("lang")}, order)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each row: a learned language, or ``und`` with score 0 if text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    out = identify(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
