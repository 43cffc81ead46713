"""Removal of byte strings that an earlier document has: intervals of a Burrows-Wheeler transform, expanded up to a length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, bounded_blocks, grouped, release, saved, table

LENGTH, GRAM = 50, 16
#: Bytes of text at a time, bytes of text whose anchors make a part (a task has several, one after another), and most segments of one anchor in one transform.
CHUNK, PART, LIMIT = 1 << 20, 1 << 24, 20_000
#: Two independent odd multipliers: of a segment 58 bits by the first and 32 by the second must be equal.
BASE, OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Rows of a part that are held before those with an earlier equal are let go.
HELD = 2_000_000
#: Anchors of a blob, about; anchors that are held at most until blobs are made of them (some 50 bytes each); most anchors of a blob of sure repeats.
A_BLOB, MOST, SURE = 2000, 1_000_000, 50_000


@lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ``base`` and of its inverse, modulo 2 ** 64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(n, b, np.uint64)
        powers[:1] = 1
        out.append(np.cumprod(powers))
    return out[0], out[1]


def _sums(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of bytes times powers up to each place, and the inverse powers that make them hashes of what lies between."""
    power, back = (p[: len(data)] for p in _powers(base, 1 << max(16, int(len(data) - 1).bit_length())))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)]), back


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """The anchors of texts: arrays (text number, first start, last start, hash of its gram, hashes of its segment, place in the segment).

    The anchor of a string of ``length`` bytes is its ``gram`` bytes of least hash, the leftmost if tied. So equal
    strings have equal anchors at the same place. An anchor has a row for the run of starts whose strings it anchors;
    the row's segment is the bytes of these strings. All strings are in one segment each.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(np.int32), none
    ends = np.cumsum(sizes)
    total, back = _sums(data, BASE)
    hashed = _mixed((total[gram:] - total[:-gram]) * back[: len(data) - gram + 1])
    span, least, width = length - gram + 1, hashed, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n], least[span - width : span - width + n])
    least = least[:n]
    # the leftmost place of the least hash of each string
    same = hashed[:n] == least
    is_least = np.zeros(len(hashed), bool)
    for k in range(span):
        is_least[k : k + n] |= hashed[k : k + n] == least
    places = np.flatnonzero(is_least)
    at = np.cumsum(is_least[:n]) - is_least[:n]
    todo = np.flatnonzero(~same)
    while len(todo):
        todo = todo[hashed[places[at[todo]]] != least[todo]]
        at[todo] += 1
    owner = np.repeat(np.arange(len(texts)), sizes)[:n]
    inside = np.arange(n) + length <= ends[owner]
    cut = np.ones(n, bool)
    cut[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(cut)
    last = np.concatenate([first[1:], [n]]) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    own = owner[first]
    place = places[at[first]]
    span = (last - first).astype(np.uint64)
    segment = _mixed((total[last + length] - total[first]) * back[first] + span * np.uint64(BASE) + (place - first).astype(np.uint64))
    total, back = _sums(data, OTHER)
    check = (_mixed((total[last + length] - total[first]) * back[first] + span) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    base = (ends - sizes)[own]
    return own, first - base, last - base, hashed[place], segment, check, place - first


BLOB = "part int, docs array<bigint>, keys array<bigint>, gram array<bigint>, segment array<bigint>, check array<int>, doc array<int>, start array<int>, place array<tinyint>, sure boolean"
_LISTS = {"docs": pa.int64(), "keys": pa.int64(), "gram": pa.int64(), "segment": pa.int64(), "check": pa.int32(), "doc": pa.int32(), "start": pa.int32(), "place": pa.int8()}


def _blob(part: int, docs, keys, gram, segment, check, doc, start, place, sure: bool) -> pa.RecordBatch:
    used, doc = np.unique(doc, return_inverse=True)
    values = [docs[used], keys[used], gram.view(np.int64), segment.view(np.int64), check, doc.astype(np.int32), start.astype(np.int32), place.astype(np.int8)]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t)) for v, t in zip(values, _LISTS.values())]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *lists, pa.array([sure])], ["part", *_LISTS, "sure"])


def _blobs(docs: DataFrame, parts: int, length: int, gram: int, chunk: int) -> DataFrame:
    """Anchors, packed, by the hash of their gram. Chunks are held until there are ``A_BLOB`` anchors a part, as a blob of
    few costs as much as one of many, and their number would grow with the chunks times the parts. Of rows held with equal segments only those of the least doc
    go to others; the rest are sure to be repeats (a segment's hash has its strings' number in its low 6 bits).
    Segments are taken for equal if 122 bits are: 64 of the gram, 58 of the segment; and 32 of it by another multiplier."""

    most = min(MOST, parts * A_BLOB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, base = [], 0, 0
        for ids, keys, texts in chunks(batches):
            own, first, last, hashed, segment, check, place = anchors(texts, length, gram)
            held.append((ids, keys, own + base, first, hashed, segment & ~np.uint64(63) | (last - first).astype(np.uint64), check, place))
            n, base = n + len(own), base + len(ids)
            if n >= most:
                yield from packed(*map(np.concatenate, zip(*held)))
                held, n, base = [], 0, 0
        if n:
            yield from packed(*map(np.concatenate, zip(*held)))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
            texts = as_bytes(batch.column("text"))
            start, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= chunk or i == len(texts) - 1:
                    part = slice(start, i + 1)
                    yield ids[part], keys[part], texts[part]
                    start, size = i + 1, 0

    def packed(ids, keys, own, first, hashed, segment, check, place) -> Iterator[pa.RecordBatch]:
        part = (hashed % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((ids[own], check, segment, hashed, part))
        own, first, hashed, segment, check, place, part = (x[order] for x in (own, first, hashed, segment, check, place, part))
        new = np.ones(len(own), bool)
        new[1:] = (hashed[1:] != hashed[:-1]) | (segment[1:] != segment[:-1]) | (check[1:] != check[:-1])
        sure = ids[own] > ids[own][np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        known, others = np.flatnonzero(sure), np.flatnonzero(~sure)
        blob = lambda p, on, sure: _blob(p, ids, keys, hashed[on], segment[on], check[on], own[on], first[on], place[on], sure)
        for k in range(0, len(known), SURE):
            on = known[k : k + SURE]
            yield blob(int(hashed[on[-1]] >> np.uint64(32)) % parts, on, True)
        # sorted by part: each is cut out once, whatever their number
        for on in np.split(others, np.flatnonzero(np.diff(part[others])) + 1):
            yield blob(int(part[on[0]]), on, False)

    return docs.mapInArrow(run, BLOB)


MARKS = "doc_id bigint, key bigint, at bigint, gram bigint"


def _marks(blobs: DataFrame, parts: int, piece: int) -> DataFrame:
    """For documents: starts of segments that an earlier document has whole, and of those that it may share strings with.

    A start s of n + 1 strings is packed as s * 64 + n; of the second kind, 64 times that plus the gram's place. Rows
    are sorted by gram, segment and doc: a segment that isn't of its least document is whole; the one of the least
    document may share strings with others of its gram. A part is read piece by piece: whole segments are given out
    and let go, so what a task holds is one row a different segment, not a row a copy.
    """
    names = {"ids": np.int64, "keys": np.int64, "gram": np.int64, "segment": np.int64, "check": np.int32, "at": np.int64, "place": np.int8}

    def column(part: pa.Table, name: str) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy() for c in part.column(name).chunks])

    def rows_of(part: pa.Table) -> dict[str, np.ndarray]:
        counts = [part.column(n).combine_chunks().value_lengths().to_numpy().astype(np.int64) for n in ("docs", "gram")]
        base = np.concatenate([[0], np.cumsum(counts[0])[:-1]])
        doc = column(part, "doc").astype(np.int64) + np.repeat(base, counts[1])
        gram, segment, check = (column(part, n) for n in ("gram", "segment", "check"))
        at = column(part, "start").astype(np.int64) * 64 + (segment & 63)
        values = column(part, "docs")[doc], column(part, "keys")[doc], gram, segment, check, at, column(part, "place")
        return dict(zip(names, values))

    def given(rows: dict[str, np.ndarray], known: bool) -> Iterator[pa.RecordBatch]:
        packed = rows["at"] if known else rows["at"] * 64 + rows["place"]
        for k in range(0, len(packed), 1 << 17):
            s = slice(k, k + (1 << 17))
            gram = pa.array(rows["gram"][s], mask=np.full(len(packed[s]), known))
            yield pa.RecordBatch.from_arrays([pa.array(rows["ids"][s]), pa.array(rows["keys"][s]), pa.array(packed[s]), gram], ["doc_id", "key", "at", "gram"])

    def picked(rows: dict[str, np.ndarray], on: np.ndarray) -> dict[str, np.ndarray]:
        return {n: v[on] for n, v in rows.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs_of_part in pieces(batches):
            held = {n: np.zeros(0, t) for n, t in names.items()}
            for sure, part in blobs_of_part:
                rows = rows_of(part)
                if sure:
                    yield from given(rows, True)
                    continue
                held = {n: np.concatenate([held[n], rows[n]]) for n in names}
                order = np.lexsort((held["ids"], held["check"], held["segment"], held["gram"]))
                held = picked(held, order)
                whole = held["ids"] > held["ids"][firsts(held, "gram", "segment", "check")]
                yield from given(picked(held, whole), True)
                held = picked(held, ~whole)
            g, d = held["gram"], held["ids"]
            if len(g):
                new_g = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                of = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])) - 1
                new_s = firsts(held, "gram", "segment", "check") == np.arange(len(g))
                kinds, least, most = np.bincount(of, new_s), np.minimum.reduceat(d, new_g), np.maximum.reduceat(d, new_g)
                yield from given(picked(held, (kinds[of] > 1) & (most[of] != least[of])), False)

    def firsts(rows: dict[str, np.ndarray], *by: str) -> np.ndarray:
        new = np.ones(len(rows["ids"]), bool)
        new[1:] = np.any([rows[n][1:] != rows[n][:-1] for n in by], axis=0)
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[bool, pa.Table]]]:
        """For each part: its blobs, some at a time, those that are sure apart. Batches are sorted by part and sure."""
        rows = ((r["part"][0].as_py(), r["sure"][0].as_py(), r) for b in batches for r in (b.slice(i, 1) for i in range(b.num_rows)))
        for _, of_part in groupby(rows, key=lambda x: x[0]):
            yield some_blobs(of_part)

    def some_blobs(of_part) -> Iterator[tuple[bool, pa.Table]]:
        for sure, blobs_ in groupby(of_part, key=lambda x: x[1]):
            part, n = [], 0
            for _, _, r in blobs_:
                part.append(r)
                n += len(r["gram"].flatten())
                if n >= piece:
                    yield sure, pa.Table.from_batches(part)
                    part, n = [], 0
            if part:
                yield sure, pa.Table.from_batches(part)

    found = blobs.repartition(parts, "part").sortWithinPartitions("part", "sure").mapInArrow(run, MARKS)
    some = F.when(F.col("gram").isNotNull(), F.struct("at", "gram"))
    found = found.groupBy("doc_id", "key").agg(F.collect_list(F.when(F.col("gram").isNull(), F.col("at"))).alias("whole"), F.collect_list(some).alias("some"))
    return found.select("doc_id", "key", "whole", F.col("some.at").alias("part_at"), F.col("some.gram").alias("part_gram"))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in order of their first ``depth`` bytes at least, by doubling of sorted prefixes."""
    n, step = len(text), 7
    padded = np.concatenate([text.astype(np.int64), np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = key << 8 | padded[k : k + n]
    while True:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if n else key
        if step >= depth or step >= n or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        step *= 2


def prefix_classes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where a suffix, in order, has fewer than ``length`` bytes in common with the one before: the first rows of the classes.

    Intervals of the transform (the byte before each suffix, in order) are expanded by that byte, level by level: on
    level l they are the intervals of all strings of l bytes, and an end that no shorter string has set has l - 1
    bytes in common with what follows. An interval whose end is set already is not expanded further. Levels stop at
    ``length``: where no end is set by then, suffixes share that many bytes. Suffixes that end within ``length``
    bytes may fall into any class.
    """
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n, dtype=np.int64)
    before, to = text[order - 1], inverse[order - 1]  # the row of the suffix that is one byte longer
    starts = np.zeros(n + 1, bool)
    starts[0] = starts[n] = True
    rows, interval = np.arange(n), np.zeros(n, np.int64)
    for _ in range(length):
        byte, rows = before[rows], to[rows]
        sort = np.argsort(rows)
        rows, interval, byte = rows[sort], interval[sort], byte[sort]
        new = np.ones(len(rows), bool)
        new[1:] = (interval[1:] != interval[:-1]) | (byte[1:] != byte[:-1]) | (rows[1:] != rows[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(rows)]]) - 1
        unset = ~starts[rows[last] + 1]
        starts[rows[last] + 1] = True
        number = np.cumsum(new) - 1
        keep = unset[number]
        rows, interval = rows[keep], number[keep]
        if not len(rows):
            break
    return starts[:n]


def shared_starts(segments: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(segment number, start) of the strings of ``length`` bytes that a segment of a smaller doc has too."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    ends = np.cumsum(sizes) - 1
    order = suffix_order(text, length)
    first = np.flatnonzero(prefix_classes(text, order, length))
    own = np.repeat(np.arange(len(segments)), sizes)[order]
    left = ends[own] - order
    doc = np.where(left >= length, docs[own], np.iinfo(np.int64).max)
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.concatenate([first, [len(order)]])))
    hit = (left >= length) & (least < doc)
    return own[hit], order[hit] - (ends - sizes + 1)[own[hit]]


SEGMENTS = "gram bigint, doc_id bigint, key bigint, start bigint, place bigint, bytes binary"


def _segments(marked: DataFrame, length: int) -> DataFrame:
    """The bytes of the segments that may share strings with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            at, gram = batch.column("part_at"), batch.column("part_gram")
            lengths = np.nan_to_num(at.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            packed, take = at.flatten().to_numpy(), pa.array(row)
            start, more = packed >> 12, packed >> 6 & 63
            cut = [texts[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), (start + more + length).tolist())]
            yield pa.RecordBatch.from_arrays([gram.flatten(), batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(start), pa.array(packed & 63), pa.array(cut, pa.binary())], ["gram", "doc_id", "key", "start", "place", "bytes"])

    return marked.select("doc_id", "key", "text", "part_at", "part_gram").mapInArrow(run, SEGMENTS)


def may_share(segments: pa.Array, place: np.ndarray, grams: np.ndarray, docs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Which segments can have a string of ``length`` bytes in common with one of another doc.

    A string has ``length`` - ``gram`` bytes beside its gram, so half of them at least are on one side: a partner
    has the same gram and the same bytes there.
    """
    half = (length - gram + 1) // 2
    offsets = np.frombuffer(segments.buffers()[1], np.int32)[segments.offset : segments.offset + len(segments) + 1].astype(np.int64)
    data = np.frombuffer(segments.buffers()[2], np.uint8)
    weights = np.cumprod(np.full(half, np.uint64(BASE)))
    keep = np.zeros(len(segments), bool)
    for at in (offsets[:-1] + place - half, offsets[:-1] + place + gram):
        on = np.flatnonzero((at >= offsets[:-1]) & (at + half <= offsets[1:]))
        if len(on):
            beside = data[at[on, None] + np.arange(half)].astype(np.uint64)
            key = _mixed((beside * weights).sum(axis=1, dtype=np.uint64)) + grams[on].view(np.uint64)
            order = np.argsort(key)
            first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            doc = docs[on][order]
            mixed = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
            keep[on[order]] |= np.repeat(mixed, np.diff(np.concatenate([first, [len(on)]])))
    return keep


def _shared(segments: DataFrame, length: int, gram: int, limit: int) -> DataFrame:
    """(doc_id, key, runs) of the strings that other segments of smaller documents have, as start * 64 + more starts."""
    keys = ["gram", "lo", "hi"]
    dealt = bounded_blocks(segments.withColumn("member", F.struct("doc_id", "start")), ["gram"], "member", limit).drop("member", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in grouped(batches, keys):
            held.append(part)
            size += part.num_rows
            if size >= limit:
                yield from found(pa.concat_tables(held))
                held, size = [], 0
        if held:
            yield from found(pa.concat_tables(held))

    def found(part: pa.Table) -> Iterator[pa.RecordBatch]:
        able = may_share(
            pa.concat_arrays(part.column("bytes").chunks), part.column("place").to_numpy(), part.column("gram").to_numpy(), part.column("doc_id").to_numpy(), length, gram
        )
        part = part.filter(pa.array(able))
        if not part.num_rows:
            return
        docs, start = part.column("doc_id").to_numpy(), part.column("start").to_numpy()
        own, at = shared_starts(part.column("bytes").to_pylist(), docs, length)
        if len(own):
            place = start[own] + at
            order = np.lexsort((place, own))
            own, place = own[order], place[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)
            first = np.flatnonzero(new)
            more = np.diff(np.concatenate([first, [len(own)]])) - 1
            take = pa.array(own[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs).take(take), part.column("key").combine_chunks().take(take), pa.array(place[first] * 64 + more)], ["doc_id", "key", "at"]
            )

    each = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "doc_id bigint, key bigint, at bigint")
    return each.groupBy("doc_id", "key").agg(F.collect_list("at").alias("shared"))


REMOVED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _removed(marked: DataFrame, length: int, with_kept: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, whole, shared in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("whole"), batch.column("shared")):
                text = text or b""
                runs = np.concatenate([x.values.to_numpy() for x in (whole, shared) if x.is_valid] or [np.zeros(0, np.int64)])
                start = runs >> 6
                order = np.argsort(start, kind="stable")
                start, end = start[order], ((runs >> 6) + (runs & 63) + length)[order]
                far = np.maximum.accumulate(end)
                new = np.flatnonzero(np.concatenate([[True], start[1:] > far[:-1]])) if len(start) else np.zeros(0, np.int64)
                a, b = start[new], far[np.concatenate([new[1:], [len(start)]]) - 1] if len(new) else far
                kept = b"".join(text[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(text)]))
                rows.append((doc, len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return marked.select("doc_id", "text", "whole", "shared").mapInArrow(run, REMOVED)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, part_bytes: int = PART, limit: int = LIMIT, piece: int = HELD, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row of ``docs``.

    Every byte goes that is in a string of ``length`` bytes (up to 78) which also starts in a document of a smaller
    doc_id. Null texts are empty; shorter texts stay. Repeated rows, and rows of one doc_id, don't remove from each
    other; a row without doc_id neither loses bytes nor makes others lose any. kept is null without ``with_kept``.

    Strings meet by their anchors (``anchors``), which are 6 in 100 bytes. Segments that are equal are settled by
    their hashes (90 bits of a segment by two multipliers, beside 64 of its gram; bytes are not compared). Those of one anchor that differ, and agree beside it (``may_share``), are put in one text, whose Burrows-Wheeler transform gives the
    classes of suffixes with ``length`` bytes in common, by expansion of intervals (``prefix_classes``). Many
    segments of one anchor are met in parts, see ``bounded_blocks``.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("key", F.xxhash64("text"))
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-n // part_bytes))
    usable = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    marks = saved(_marks(_blobs(usable, parts, length, gram, chunk), parts, piece), "marks")
    release(docs.sparkSession)
    names = ["doc_id", "key"]
    some = marks.filter(F.size("part_at") > 0).select(*names, "part_at", "part_gram")
    segments = saved(_segments(docs.join(some, names), length), "segments")
    release(docs.sparkSession)
    shared = saved(_shared(segments, length, gram, limit), "shared")
    covered = saved(marks.select(*names, "whole").join(shared, names, "full"), "covered")
    release(docs.sparkSession)
    return _removed(docs.join(covered, names, "left"), length, with_kept)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")


SQL = f"""
with d as (
  select row_number() over () as row, doc_id, hex(encode(coalesce(text, ''))) as h from documents
), blocks as (
  select row, doc_id, base, substr(h, 2 * base + 1, 2 * (200 + {LENGTH - 1})) as h
  from (select row, doc_id, h, unnest(range(0, len(h) // 2, 200)) as base from d where doc_id is not null)
), strings as (
  select row, doc_id, base + k as s, substr(h, cast(2 * k + 1 as bigint), {2 * LENGTH}) as x from (select row, doc_id, base, h, unnest(range(0, 200)) as k from blocks) where 2 * k + {2 * LENGTH} <= len(h)
), least as (
  select x, min(doc_id) as least from strings group by x having min(doc_id) < max(doc_id)
), hit as (
  select row, s from strings join least using (x) where doc_id > least
), cut as (
  select row, s, case when s <= lag(s) over (partition by row order by s) + {LENGTH} then 0 else 1 end as new from hit
), runs as (
  select row, min(s) as a, max(s) + {LENGTH} as b from (select row, s, sum(new) over (partition by row order by s) as run from cut) group by row, run
), pieces as (
  select row, a, b, coalesce(lag(b) over (partition by row order by a), 0) as from_ from runs
), kept as (
  select row, count(*) as n, sum(b - a) as gone, max(b) as last, string_agg(substr(h, cast(2 * from_ + 1 as bigint), cast(2 * (a - from_) as bigint)), '' order by a) as h
  from pieces join d using (row) group by row
)
select doc_id, len(d.h) // 2 as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(n, 0) as n_spans,
  sha256(unhex(coalesce(kept.h, '') || substr(d.h, cast(2 * coalesce(last, 0) + 1 as bigint)))) as kept_sha256
from d left join kept using (row)
"""
