"""SimHash near-duplicates: an inverted index on the bytes of fingerprints, with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, bounded_blocks, grouped, saved, table
from .components import components

BITS, BYTES = 3, 8
#: With at most 3 bits changed, at least 5 of the 8 bytes are equal.
SHARED = BYTES - BITS
#: Any 5 of 8 byte positions have 3 in the first half or 3 in the second: so an index on these triples meets every pair.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
SHINGLE, SEED, CHUNK, LIMIT = 3, 42, 1 << 16, 4000


def fingerprint(text: bytes | None, words: int = SHINGLE) -> int:
    """The 64 majority bits of the XXH64 values (seed 42) of a text's word shingles."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    if len(tokens) < words:
        grams = iter([b" ".join(tokens)])
    else:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    ones, n = np.zeros(64, np.int64), 0
    while part := b"".join([xxhash.xxh64_digest(g, SEED) for g in islice(grams, CHUNK)]):
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in as_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def _near(fps: np.ndarray, fp: np.uint64) -> np.ndarray:
    """Which of ``fps`` share enough bytes by position with ``fp``, and then differ in few enough bits."""
    apart = fps ^ fp
    tally = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    near = tally >= SHARED
    near[near] = np.bitwise_count(apart[near]) <= BITS
    return near


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (as indexes) that join what links of ``fps`` join: one less than the rows at most, however many pairs are near."""
    links, left = [], np.arange(len(fps))
    while left.size:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            i = todo.pop()
            near = _near(fps[left], fps[i])
            found, left = left[near].tolist(), left[~near]
            links += [(i, j) for j in found]
            todo += found
    return links


def linked(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fps`` (fp), enough of them that the components are exact.

    Postings are (triple of byte positions, their values) -> fingerprint. In a posting list the bytes that two
    fingerprints share are tallied, pairs of 5 or more are kept and verified. Lists over ``limit`` are split, see
    ``bounded_blocks``; a part gives fewer links than it has rows.
    """
    masks = [sum(0xFF << 8 * (7 - p) for p in t) for t in TRIPLES]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    at = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("triple", "value")
    keys = ["triple", "value", "lo", "hi"]
    parts = bounded_blocks(fps.select("fp", at), ["triple", "value"], "fp", limit).select(*keys, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, keys):
            fp = part.column("fp").to_numpy()
            if links := spanning_links(fp.view(np.uint64)):
                ends = fp[np.array(links)]
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["u", "v"])

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) of each row of ``docs``.

    Rows whose fingerprints differ in 3 bits or fewer are linked; component_id is the least doc_id that links reach.
    A null or empty text, or one of white space, has fingerprint zero and is linked as any other. Repeated rows give
    repeated rows. A null doc_id is linked but is never a component_id, unless all of a component are null. kept:
    doc_id is component_id. Equal fingerprints are one class first, so that copies cost nothing in the index.
    """
    fps = saved(fingerprints(docs), "fingerprints")
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = saved(components(linked(classes.select("fp"), limit)), "roots").withColumnRenamed("node", "fp")
    found = roots.join(classes, "fp")
    least = found.groupBy("root").agg(F.min("first").alias("least"))
    of = classes.join(roots.join(least, "root").select("fp", "least"), "fp", "left")
    of = of.select("fp", F.coalesce("least", "first").alias("component_id"))
    return fps.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
