"""Benchmark decontamination with a positional inverted index of the training words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, as_bytes, numbered, saved, table

WINDOW = 10
#: Words in a segment of the index, about; words of the benchmark that are searched for in one pass, about; places looked at in one step.
SEGMENT, BLOCK, BYTES_A_WORD, STEP = 500_000, 500_000, 5, 1 << 20
#: Segments in a file of the index. A segment is some megabytes; Parquet writes at least 100 rows before it looks at their size, and reads up to 4096 at once.
SEGMENTS_A_FILE = 4
#: Maps A-Z to a-z, keeps digits, a-z and what isn't ASCII, and makes the rest white space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Phrases:
    """What is searched for in one pass: the windows of a block of benchmark items, as numbers of their words."""

    def __init__(self, items: list[tuple[int, bytes | None]], window: int):
        self.terms: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                of[tuple(ids[i : i + window])].add(item)
        self.items = [sorted(x) for x in of.values()]
        self.windows = np.full((len(of), window), -1, np.int32)
        for row, ids in zip(self.windows, of):
            row[: len(ids)] = ids


#: Postings are half a million numbers a row: as binary columns they pass through Spark and Parquet whole, not number by number.
INDEX = "doc_ids array<bigint>, rows array<bigint>, bases array<bigint>, n_words array<bigint>, terms binary, counts binary, positions binary"
_SCHEMA = pa.schema([(n, pa.binary() if t == "binary" else pa.list_(pa.int64())) for n, t in (x.split() for x in INDEX.split(", "))])


def index_segments(docs: DataFrame, gap: int, segment: int = SEGMENT) -> DataFrame:
    """The positional inverted index of docs (doc_id, row, text), a row for each segment of about ``segment`` words.

    A segment numbers the words of its documents one after another, with ``gap`` free places between documents. It
    has the postings of each of its words: ``terms`` are the words with spaces between, ``counts`` and ``positions`` 32-bit
    numbers, how many positions each word has and these, sorted, end to end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs_in, found, at = defaultdict(count().__next__), [], [], 0

        def flush():
            ids = np.concatenate([i for _, i in found])
            places = np.concatenate([np.arange(base, base + len(i), dtype=np.int32) for base, i in found])
            counts = np.bincount(ids, minlength=len(number)).astype(np.int32)
            row = [*map(list, zip(*docs_in)), b" ".join(number), counts.tobytes(), places[np.argsort(ids, kind="stable")].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), as_bytes(batch.column("text"))):
                words = words_of(text)
                found.append((at, np.fromiter(map(number.__getitem__, words), np.int32, len(words))))
                docs_in.append((doc, row, at, len(words)))
                at += len(words) + gap
                if at >= segment:
                    yield flush()
                    number, docs_in, found, at = defaultdict(count().__next__), [], [], 0
        if docs_in:
            yield flush()

    return docs.select("doc_id", "row", "text").mapInArrow(run, INDEX)


def _full(docs: DataFrame, segment: int) -> DataFrame:
    """``docs`` in as many tasks as fill a segment each, about, and no fewer than there are cores: many small parts would be as many small segments, files and tasks of each pass."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (BYTES_A_WORD * segment))))


class Segment:
    """A segment of the index as the phrases see it: the postings of their terms, by the phrases' numbers."""

    def __init__(self, row: dict, terms: dict[bytes, int]):
        self.doc_ids, self.rows, self.bases, self.n_words = row["doc_ids"].to_pylist(), row["rows"].to_pylist(), row["bases"].to_numpy(), row["n_words"].to_pylist()
        counts, positions = row["counts"], row["positions"]
        own = np.fromiter((terms.get(t, -1) for t in row["terms"]), np.int64, len(counts))
        self.ends = np.zeros(len(terms) + 1, np.int64)
        self.often = np.zeros(len(terms) + 1, np.int64)
        self.ends[own], self.often[own] = np.cumsum(counts), counts
        self.often[-1] = 0  # the words that are none of the terms
        self.positions = positions
        each = np.repeat(own, counts)
        self.term_at = np.full(int(positions.max(initial=-1)) + 1, -1, np.int64)
        self.term_at[positions] = each

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``terms``, position) of all places of each term."""
        n = self.often[terms]
        of = np.repeat(np.arange(len(terms)), n)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return of, self.positions[(self.ends[terms] - n)[of] + inside]

    def has(self, term: np.ndarray, places: np.ndarray, slop: int) -> np.ndarray:
        """Whether the postings of each term have its place, or one within ``slop`` of it."""
        found = np.zeros(len(term), bool)
        for d in range(-slop, slop + 1):
            at = places + d
            inside = (at >= 0) & (at < len(self.term_at))
            found[inside] |= self.term_at[at[inside]] == term[inside]
        return found


def _matches(segment: Segment, phrases: Phrases, order: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (window number, document index, place in the document) of the windows that a segment has, a step at a time.

    ``order``: the offsets of each window's terms, from the rarest in the corpus on (-1 after the last). The lists of
    the rarest terms of all windows, less their offsets, are intersected with those of the next rarest, and so on:
    all windows at once, so that the work is about the places of rarest terms, not segments times windows. With a
    slop, the rarest term must be at its place, and any other within ``slop`` words of its own. A start can then lie
    before the document, but its rarest term is in it.
    """
    present = segment.often > 0
    present[-1] = True  # -1 fills up short windows
    todo = np.flatnonzero(present[phrases.windows].all(axis=1))
    rarest = phrases.windows[todo, order[todo, 0]]
    steps = np.cumsum(segment.often[rarest]) // STEP
    for part in np.split(todo, np.flatnonzero(np.diff(steps)) + 1):
        if not len(part):
            continue
        of, place = segment.postings(phrases.windows[part, order[part, 0]])
        window = part[of]
        anchor = order[window, 0]
        start = place.astype(np.int64) - anchor
        for k in range(1, order.shape[1]):
            offset = order[window, k]
            term = phrases.windows[window, offset]
            ok = (offset < 0) | segment.has(term, start + offset, slop)
            window, start = window[ok], start[ok]
            if not len(window):
                break
        if len(window):
            doc = np.searchsorted(segment.bases, start + order[window, 0], side="right") - 1
            yield window, doc, start - segment.bases[doc]


def _segments(batches: Iterator[pa.RecordBatch], terms: dict[bytes, int]) -> Iterator[Segment]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Segment({n: _field(batch.column(n)[i], n) for n in batch.schema.names}, terms)


def _field(value: pa.Scalar, name: str) -> pa.Array | list[bytes] | np.ndarray:
    if name == "terms":
        return value.as_py().split()
    return np.frombuffer(value.as_buffer(), np.int32) if name in ("counts", "positions") else value.values


def _counts(index: DataFrame, terms) -> np.ndarray:
    """How often the corpus has each of the terms (a broadcast dict of their numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.array([terms.value.get(t, -1) for t in _field(batch.column("terms")[i], "terms")], np.int32)
                counts = _field(batch.column("counts")[i], "counts").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[own >= 0]), pa.array(counts[own >= 0])], ["term", "n"])

    often = np.zeros(len(terms.value) + 1, np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the block at most
        often[r.term] = r.n
    return often


def _order(windows: np.ndarray, often: np.ndarray) -> np.ndarray:
    key = np.where(windows < 0, np.iinfo(np.int64).max, often[windows])
    order = np.argsort(key, axis=1, kind="stable")
    return np.where(np.take_along_axis(windows, order, axis=1) < 0, -1, order)


def _searches(docs: DataFrame, benchmark: DataFrame, window: int, slop: int, segment: int, block: int, row: str | None = None) -> Iterator[tuple]:
    """The index of ``docs``, written once, and for each block of the benchmark (by the hash of item_id) a broadcast of its phrases and the order of their terms.

    ``row``: the column of ``docs`` that numbers its rows, if it has one."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("bigint"), (F.col(row) if row else F.monotonically_increasing_id()).cast("bigint").alias("row"), F.col("text").cast("string"))
    index = saved(index_segments(_full(docs, segment), window + 2 * slop, segment), "index", maxRecordsPerFile=SEGMENTS_A_FILE)
    items = benchmark.select(F.col("item_id").cast("bigint"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).filter("item_id is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // (BYTES_A_WORD * block)))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        phrases = Phrases([(r.item_id, r.text) for r in part], window)
        order = _order(phrases.windows, _counts(index, context.broadcast(phrases.terms)))
        yield index, context.broadcast((phrases, order))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, window, start): where windows of items are in documents, exact (slop 0) or in proximity.

    start: the word of the document, from 0, where the window starts by its rarest word; in proximity it can be less
    than 0, if words that should come before that one come after it. A document or item that is
    null has no words; an item of fewer words than ``window``, but not none, is one window.
    """
    out = None
    for index, shared in _searches(docs, benchmark, window, slop, segment, block):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases, order = shared.value
            for s in _segments(batches, phrases.terms):
                for found in _matches(s, phrases, order, slop):
                    rows = [(s.doc_ids[d], item, w, a) for w, d, a in zip(*(x.tolist() for x in found)) for item in phrases.items[w]]
                    text = {w: b" ".join(_text(phrases, w)).decode() for _, _, w, _ in rows}
                    columns = [[r[0] for r in rows], [r[1] for r in rows], [text[r[2]] for r in rows], [r[3] for r in rows]]
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "window", "start"])

        found = index.mapInArrow(run, "doc_id bigint, item_id bigint, window string, start bigint")
        out = found if out is None else out.unionByName(found)
    return out


def _text(phrases: Phrases, w: int) -> list[bytes]:
    if not hasattr(phrases, "words"):
        phrases.words = list(phrases.terms)
    return [phrases.words[t] for t in phrases.windows[w] if t >= 0]


HITS = "doc_id bigint, row bigint, n_words bigint, runs array<struct<a:bigint,b:bigint>>, items array<bigint>"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, segment: int = SEGMENT, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """(doc_id, row, n_words, runs, items) of each row of ``docs``: the word runs [a, b) inside occurring windows, and their items.

    ``row`` names a written column of row numbers; without it, what the result has as row tells nothing.

    Repeated rows give repeated rows. Items without item_id are left out; rows of one item_id are one item. The index
    is kept by document, in segments, so that no term's list, however common, meets in one task: queries go to the
    segments, and nothing is shuffled. It is written once; a benchmark of more than ``block`` words is searched for
    in several passes over it.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.int64()))])
    parts = []
    for index, shared in _searches(docs, benchmark, window, 0, segment, block, row):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases, order = shared.value
            lengths = (phrases.windows >= 0).sum(axis=1)
            for s in _segments(batches, phrases.terms):
                spans, items = defaultdict(list), defaultdict(set)
                for w, doc, start in _matches(s, phrases, order, 0):
                    for d, a, b in zip(*(x.tolist() for x in _runs(doc, start, start + lengths[w]))):
                        spans[d].append((a, b))
                    for d, k in np.unique(np.stack([doc, w]), axis=1).T.tolist():
                        items[d].update(phrases.items[k])
                n = len(s.doc_ids)
                runs = [[{"a": a, "b": b} for a, b in _union(spans[d])] if d in spans else [] for d in range(n)]
                columns = [s.doc_ids, s.rows, s.n_words, runs, [sorted(items[d]) if d in items else [] for d in range(n)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

        parts.append(index.mapInArrow(run, HITS))
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )


def _runs(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans [a, b) of documents, those that touch joined."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    far = int(b.max()) + 1
    end = np.maximum.accumulate(b + doc * far)  # a document's spans are all before those of the next
    new = np.flatnonzero(np.concatenate([[True], (a + doc * far)[1:] > end[:-1]]) | np.concatenate([[True], doc[1:] != doc[:-1]]))
    last = np.concatenate([new[1:], [len(doc)]]) - 1
    return doc[new], a[new], end[last] - doc[new] * far


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``docs``, see ``hits``."""
    found = hits(docs, benchmark, window, segment, block)
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda s, r: F.struct(F.greatest(s["end"], r["b"]).alias("end"), (s["n"] + F.greatest(r["b"] - F.greatest(r["a"], s["end"]), F.lit(0))).alias("n"))
    n_hit = F.aggregate("runs", start, step)["n"]
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; each row goes by its own text, whatever its doc_id."""
    rows, row = numbered(docs)
    bad = saved(hits(rows, benchmark, row=row).filter(F.size("items") > 0).select(F.col("row").alias(row)), "contaminated")
    return rows.join(bad, row, "left_anti").drop(row)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with d as (
  select row_number() over () as row, doc_id, {_WORDS} as w from documents
), i as (
  select item_id, {_WORDS} as w from benchmark where item_id is not null
), windows as (
  select distinct item_id, len(s) as n, array_to_string(s, ' ') as s from (
    select item_id, unnest(case when len(w) < {WINDOW} then [w] else list_transform(range(1, len(w) - {WINDOW - 2}), lambda k: w[k : k + {WINDOW - 1}]) end) as s from i where len(w) > 0)
), sizes as (
  select distinct n from windows
), places as (
  select row, k, n, array_to_string(w[k : k + n - 1], ' ') as s from (select row, n, w, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)
), found as (
  select row, k, n, item_id from places join windows using (n, s)
), words as (
  select row, count(distinct k) as n_hit from (select row, unnest(range(k, k + n)) as k from found) group by row
), items as (
  select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct row, cast(item_id as varchar) as item_id from found) group by row
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (row) left join items using (row)
"""
