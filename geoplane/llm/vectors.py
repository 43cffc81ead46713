"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_blocks, grouped, saved, table
from .components import components

COSINE, SEED, LIMIT, FILL = 0.95, 42, 2000, 8
#: (tables, probes) for so many hashes joined to a bucket number. More hashes find less in a table, so more tables or
#: probes make up for it: by measure, 0.97 of pairs at the least cosine are found at any of these, in 8 to 768 dimensions.
EFFORT = {1: (8, 3), 2: (8, 3), 3: (8, 3), 4: (8, 6), 5: (12, 6), 6: (24, 6)}


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def bucket_codes(unit: np.ndarray, parts: int, tables: int, probes: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables * probes) bucket numbers of unit vectors: of each table their own bucket, then the likeliest others.

    Three rounds of random signs and the transform rotate a vector; a hash is the axis, with its sign, that it is
    nearest to. A bucket number joins ``parts`` such hashes. A probe takes, for one of them, the next nearest axis,
    in order of how much farther that is.
    """
    d = max(2, 1 << (unit.shape[1] - 1).bit_length())
    padded = np.zeros((len(unit), d))
    padded[:, : unit.shape[1]] = unit
    out = np.zeros((len(unit), tables, probes), np.int64)
    each, row = max(2, probes), np.arange(len(unit))[:, None]
    for t in range(tables):
        near, loss = [], []
        for k in range(parts):
            signs = np.random.default_rng([seed, t, k, d]).choice([-1.0, 1.0], size=(3, d))
            y = padded
            for s in signs:
                y = hadamard(y * s)
            first = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :each]
            value = y[row, first]
            near.append(first + d * (value < 0))
            loss.append(np.abs(value[:, :1]) - np.abs(value[:, 1:]))
        near, loss = np.stack(near, axis=1), np.stack(loss, axis=1).reshape(len(unit), -1)
        base = near[:, :, 0].copy()
        weight = (2 * d) ** np.arange(parts, dtype=np.int64)
        out[:, t, 0] = base @ weight
        likely = np.argsort(loss, axis=1, kind="stable")[:, : probes - 1]
        for p in range(likely.shape[1]):
            k, nth = likely[:, p] // (each - 1), likely[:, p] % (each - 1) + 1
            out[:, t, p + 1] = out[:, t, 0] + (near[row[:, 0], k, nth] - base[row[:, 0], k]) * weight[k]
        for p in range(likely.shape[1] + 1, probes):
            out[:, t, p] = out[:, t, 0]
    return out.reshape(len(unit), -1)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors that can link, by their length: not zero, and of finite numbers only."""
    lists = column.cast(pa.large_list(pa.float64()))
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        x = values[offsets[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1)
        good[good] = (x[good] != 0).any(axis=1)
        if good.any():
            yield rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


PLACED = "rep bigint, copies bigint, vector array<double>, codes array<bigint>"


def _placed(classes: DataFrame, parts: int, tables: int, probes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch.column("embedding")):
                codes = bucket_codes(unit(x), parts, tables, probes)
                take = pa.array(rows)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(k)) for a, k in ((x, pa.float64()), (codes, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(take), batch.column("copies").take(take), *lists], ["rep", "copies", "vector", "codes"])

    return classes.select("rep", "copies", "embedding").mapInArrow(run, PLACED)


def _new_here(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table_no: int, bucket: int, probes: int) -> np.ndarray:
    """Whether the pairs i, j meet in no earlier table, and in this one in no bucket of a smaller number."""
    a, b = codes.reshape(len(codes), -1, probes)[i], codes.reshape(len(codes), -1, probes)[j]
    same = a[:, : table_no + 1, :, None] == b[:, : table_no + 1, None, :]
    earlier = same[:, :table_no].any(axis=(1, 2, 3))
    smaller = (same[:, table_no] & (a[:, table_no, :, None] < bucket)).any(axis=(1, 2))
    return ~(earlier | smaller)


def _matrix(column: pa.ChunkedArray, own: np.ndarray) -> np.ndarray:
    """The lists of some rows, all of one length, as a matrix."""
    lists = column.combine_chunks().take(pa.array(own))
    return lists.flatten().to_numpy().reshape(len(own), -1)


FOUND = "rep bigint, other bigint, links bigint"


def _found(placed: DataFrame, cosine: float, probes: int, limit: int) -> DataFrame:
    """Rows (rep, null, links) that count a vector's links found in a bucket, and rows (rep, other, null) that join what is linked there.

    Every linked pair that shares a bucket is counted once, in the first bucket that it shares; the joining rows are
    fewer than the vectors of the bucket. Buckets of over ``limit`` vectors are met in parts, see ``bounded_blocks``.
    """
    at = F.posexplode("codes").alias("slot", "bucket")
    entries = placed.select("rep", at).select("rep", F.floor(F.col("slot") / probes).cast("int").alias("tab"), "bucket").distinct()
    keys = ["tab", "bucket", "lo", "hi"]
    parts = bounded_blocks(entries, ["tab", "bucket"], "rep", limit).select(*keys, "side", "rep").join(placed, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, keys):
            tab, bucket, lo, hi = (part.column(k)[0].as_py() for k in keys)
            reps, side, copies = (part.column(k).to_numpy() for k in ("rep", "side", "copies"))
            lengths = part.column("vector").combine_chunks().value_lengths().to_numpy()
            links, first, second = np.zeros(len(reps), np.int64), [], []
            for d in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == d)
                x, codes = unit(_matrix(part.column("vector"), own)), _matrix(part.column("codes"), own)
                root = np.arange(len(own))
                for a in range(0, len(own), 256):
                    i, j = np.nonzero(x[a : a + 256] @ x.T >= cosine)
                    i += a
                    ok = (i < j) & ((side[own[i]] != side[own[j]]) | (lo == hi))
                    i, j = i[ok], j[ok]
                    for b in range(0, len(i), 1 << 16):
                        p, q = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
                        new = _new_here(codes, p, q, tab, bucket, probes)
                        np.add.at(links, own[p[new]], copies[own[q[new]]])
                        np.add.at(links, own[q[new]], copies[own[p[new]]])
                    for p, q in zip(i.tolist(), j.tolist()):
                        while root[p] != p:
                            root[p] = p = root[root[p]]
                        while root[q] != q:
                            root[q] = q = root[root[q]]
                        if p != q:
                            root[max(p, q)] = min(p, q)
                            first.append(own[p])
                            second.append(own[q])
            has = np.flatnonzero(links)
            rows = [np.concatenate([reps[has], reps[np.array(first, int)]]), pa.array([None] * len(has) + reps[np.array(second, int)].tolist(), pa.int64()), pa.array(links[has].tolist() + [None] * len(first), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), *rows[1:]], ["rep", "other", "links"])

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, FOUND)


def hashes_joined(classes: int, size: int) -> int:
    """How many hashes are joined to a bucket number: enough that a bucket has about FILL of the classes, 6 at most."""
    axes = 2 * max(2, 1 << ((size or 2) - 1).bit_length())
    return min(max(EFFORT), max(1, math.ceil(math.log(max(classes, 2) / FILL) / math.log(axes))))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, limit: int = LIMIT, parts: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding).

    Two vectors of one length link if they share a bucket and their cosine, in double precision, is ``cosine`` or
    more. Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; neither
    does a row without vec_id. Equal vectors are one class, of which one row is hashed; its copies are links too. Repeated
    rows are vectors of their own. component_id: the least vec_id that links reach; kept: it is the row's own.
    The number of hashes joined to a bucket (``parts``) follows from the number of classes, so that buckets stay
    small, and the tables and probes from that number (EFFORT), so that recall stays. Larger buckets are met in parts.
    """
    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    rows = rows.select("vec_id", F.when(sound, F.col("embedding")).alias("embedding"))
    classes = rows.filter("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = saved(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    parts = parts or hashes_joined(*classes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first())
    tables, probes = EFFORT[parts]
    placed = saved(_placed(classes, parts, tables, probes), "placed")
    found = saved(_found(placed, cosine, probes, limit), "found")
    roots = components(found.filter("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    links = found.filter("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    known = placed.select("rep").withColumn("ok", F.lit(True))
    of = classes.join(known, "rep", "left").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of = saved(of.select("embedding", "first", F.coalesce("root", "rep").alias("root"), F.when(F.col("ok"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "of")
    least = of.filter("links is not null").groupBy("root").agg(F.min("first").alias("least"))
    of = of.join(least, "root", "left").select("embedding", "links", F.when(F.col("links").isNotNull(), F.col("least")).alias("least"))
    own = F.coalesce("least", "vec_id")
    return rows.join(of, "embedding", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept")
    )


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
