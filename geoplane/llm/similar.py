"""Near copies by the Jaccard similarity of word shingles: a wide SimHash, an inverted index on its bytes, exact verification.

A pair of similarity 0.8 differs in 15 of 100 SimHash bits, so no short fingerprint guarantees it a common byte by count.
Fingerprints have 1024 bits here, and of each eight bytes those triples are indexed that are the least likely to change.
That joins most of what is near. For the rest prefixes of the sets are compared, which meet every pair of that similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_blocks, grouped, numbered, release, saved, share_of
from .components import components

WORDS, SIMILARITY, SEED = 5, 0.8, 42
#: Bytes of a fingerprint, bytes of a group whose triples make keys, and the keys of a group.
BYTES, GROUP, KEYS = 128, 8, 6
#: Keys of a group that are indexed. The index only joins most of what is near sooner; the prefixes meet every pair.
INDEXED = 2
#: Bits of a set's odd sketch: these at least, then as many as it has shingles, to the next power of two.
SKETCH = 1024
#: Pairs go on to the exact check that share this many bytes by position and differ in this many bits at most. A pair
#: of similarity 0.8 shares 34 and differs in 155 on average; 10 and 190 are over three standard deviations off.
SHARED, BITS = 10, 190
LIMIT, CHUNK, PARTNERS = 2000, 4096, 1000
#: Rows that are looked at for what is common, about: so many, or this part of all if that is more. And hashes of that at most.
SAMPLE, PART, COMMON = 8000, 8, 500_000
#: Rows of numbers that are broadcast at most.
SMALL = 1_000_000
TRIPLES = np.array(list(combinations(range(GROUP), 3)))
#: How much of a sum of signs stays, against its change, at similarity 0.8 (cosine c): c / sqrt(1 - c * c).
STEADY = 1.94
PLANES = np.arange(1, BYTES // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, words: int = WORDS) -> set[bytes]:
    """The different runs of ``words`` words (all words, if there are fewer; none, if there are none), A-Z in lower case."""
    tokens = text.lower().split() if text else []
    if len(tokens) < words:
        return {b" ".join(tokens)} if tokens else set()
    return set(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sign_sums(grams: set[bytes]) -> np.ndarray:
    """For each of the bits: the shingles whose hash has it, less those whose hash hasn't, over the root of their number."""
    total, each = np.zeros(8 * BYTES, np.int64), iter(grams)
    while part := b"".join([xxhash.xxh64_digest(g, SEED) for g in islice(each, CHUNK)]):
        hashes = _mixed(np.frombuffer(part, np.uint64)[:, None] + PLANES)
        total += np.unpackbits(hashes.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return (2 * total - len(grams)) / np.sqrt(max(1, len(grams)))


def fingerprint_keys(sums: np.ndarray, each: int = KEYS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints as bytes, keys, ``each`` a group) of rows of ``sign_sums``. A key has the group's number, the triple's, and its bytes' values."""
    prints = np.packbits(sums > 0, axis=1)
    stays = -np.log1p(np.exp(-1.702 * STEADY * np.abs(sums))).reshape(len(sums), BYTES, 8).sum(axis=2)
    groups = BYTES // GROUP
    steady = stays.reshape(len(sums), groups, GROUP)[:, :, TRIPLES].sum(axis=3)
    best = np.argsort(-steady, axis=2, kind="stable")[:, :, :each]
    at = TRIPLES[best] + (np.arange(groups) * GROUP)[None, :, None, None]
    values = prints[np.arange(len(sums))[:, None, None, None], at].astype(np.int64)
    keys = (np.arange(groups)[None, :, None] * len(TRIPLES) + best) << 24 | values[..., 0] << 16 | values[..., 1] << 8 | values[..., 2]
    return prints, keys.reshape(len(sums), -1)


PRINTS = "row bigint, print binary, keys array<bigint>"


def prints_of(rows: DataFrame, row: str, words: int) -> DataFrame:
    """(row, print, keys) of each row of ``rows``; of a text without words all are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                grams = [shingles(t, words) for t in as_bytes(part.column("text"))]
                prints, keys = fingerprint_keys(np.stack([sign_sums(g) for g in grams]), INDEXED)
                none = [not g for g in grams]
                found = [None if n else p.tobytes() for p, n in zip(prints, none)]
                lists = pa.array([None if n else k for k, n in zip(keys, none)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.binary()), lists], ["row", "print", "keys"])

    return rows.select(F.col(row).alias("row"), F.col("text").cast("string")).mapInArrow(run, PRINTS)


def _near(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which of ``prints`` share enough bytes by position with ``one``, and then differ in few enough bits."""
    apart = prints ^ one
    near = (apart == 0).sum(axis=1) >= SHARED
    near[near] = np.bitwise_count(apart[near].view(np.uint64)).sum(axis=1) <= BITS
    return near


def joining_pairs(prints: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (as indexes) that join what near pairs join: fewer than the rows, each row but the first of what it joins to comes second once."""
    pairs, left = [], np.arange(len(prints))
    while left.size:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            i = todo.pop()
            near = _near(prints[left], prints[i])
            found, left = left[near].tolist(), left[~near]
            pairs += [(i, j) for j in found]
            todo += found
    return pairs


def candidates(classes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (u, v), u < v, of rows of ``classes`` (row, print, keys) that are near by their fingerprints, enough to join all such that share a key."""
    entries = classes.select("row", F.explode("keys").alias("key"))
    keys = ["key", "lo", "hi"]
    # sizes and fingerprints grow with the classes: they are sorted and merged, never broadcast
    parts = bounded_blocks(entries, ["key"], "row", limit, "merge").select(*keys, "row").join(classes.select("row", "print").hint("merge"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, keys):
            row = part.column("row").to_numpy()
            prints = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(-1, BYTES)
            if pairs := joining_pairs(prints):
                ends = row[np.array(pairs)]
                yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["u", "v"])

    found = parts.repartition(*keys).sortWithinPartitions(*keys, "row").mapInArrow(run, "u bigint, v bigint")
    return found.filter("u <> v").distinct()


def _sent(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is counted to be small, else merged."""
    return F.broadcast(table) if table.count() <= SMALL else table.hint("merge")


def verified(pairs: DataFrame, rows: DataFrame, row: str, words: int, similarity: float, partners: int = PARTNERS) -> DataFrame:
    """The pairs (u, v) whose sets of shingles have that Jaccard similarity or more.

    ``pairs`` is a written table. Texts go to the pairs' first rows; one with over ``partners`` pairs is copied to as
    many tasks as they need.
    """
    texts = rows.select(F.col(row).alias("of"), F.col("text").cast("string"))
    many = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / partners).cast("int").alias("sides"))
    dealt = pairs.join(many, "u").select(F.col("v").alias("of"), "u", F.pmod(F.xxhash64("v"), F.col("sides")).cast("int").alias("side"), "v")
    firsts = many.select(F.col("u").alias("of"), "u", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), F.lit(-1).cast("bigint").alias("v"))
    needed = saved(dealt.unionByName(firsts), "needed")
    # texts are not shuffled if what is needed of them is a small list; else once
    needed = _sent(needed)
    every = texts.join(needed, "of").select("u", "side", "v", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set[bytes] = set()
        for batch in batches:
            good = []
            for u, v, text in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), as_bytes(batch.column("text"))):
                grams = shingles(text, words)
                if v < 0:
                    own = grams
                else:
                    both = len(own & grams)
                    if both >= similarity * (len(own) + len(grams) - both) - 1e-9:
                        good.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], ["u", "v"])

    return every.repartition("u", "side").sortWithinPartitions("u", "side", "v").mapInArrow(run, "u bigint, v bigint")


def _hashes(text: bytes | None, words: int) -> np.ndarray:
    """The different hashes of a text's shingles, sorted."""
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in shingles(text, words)]), np.int64))


def common_hashes(rows: DataFrame, row: str, words: int) -> np.ndarray:
    """Hashes of shingles that two rows of a sample have, the rarest first; of very many those that the most have. They only set the order of prefixes: pairs are met in any.

    The sample is a fixed part of the rows. So what passes for rare is in a bounded number of rows, however many there
    are: of a sample of fixed size it would be in more of them the more there are, and pairs would grow with the square.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(text, words))], ["key"])

    n = rows.count()
    some = rows.filter(share_of(F.xxhash64(row), max(SAMPLE, n // PART), n)).select(F.col("text").cast("string"))
    often = saved(some.mapInArrow(run, "key bigint").groupBy("key").count().filter("count > 1"), "common")
    # whole levels of counts, from the top, so that no more than is kept is sent to the driver
    least, total = 1 << 62, 0
    for level in often.groupBy("count").agg(F.count(F.lit(1)).alias("keys")).orderBy(F.desc("count")).collect():
        total += level["keys"]
        if total > COMMON:
            break
        least = level["count"]
    found = often.filter(F.col("count") >= least).toArrow()
    keys, counts = (found.column(c).to_numpy() for c in ("key", "count"))
    return keys[np.lexsort((keys, counts))]


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the hashes are in ``known``, which is sorted and can be far longer: ``np.isin`` would sort it again for each text."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def odd_sketch(hashes: np.ndarray, bits: int = SKETCH) -> bytes:
    """A bit for each of so many parts of the hashes: whether the part has an odd number of these."""
    return np.packbits((np.bincount(hashes & (bits - 1), minlength=bits) & 1).astype(bool)).tobytes()


def sketch_bits(n: int) -> int:
    """Bits of the sketch of n hashes: with fewer than about half of n, any two sets of the size would pass for near."""
    return max(SKETCH, 1 << max(0, n - 1).bit_length())


def sketches_apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits odd sketches differ, pair by pair. The longer is folded: its parts that fall together are one part of the shorter."""
    widths, apart = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2), np.zeros(len(a), np.int64)
    for wide in np.unique(widths, axis=0).tolist():
        at, short = np.flatnonzero((widths == wide).all(axis=1)), min(wide)
        folded = [np.bitwise_xor.reduce(np.frombuffer(b"".join([c[i] for i in at]), np.uint64).reshape(len(at), w // short, -1), axis=1) for c, w in zip((a, b), wide)]
        apart[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1)
    return apart


def prefixes(rows: DataFrame, row: str, words: int, similarity: float) -> DataFrame:
    """(row, n, sketch, prefix) of each row of ``rows`` with words: the number of its shingles, their odd sketch, and the first of their hashes, common ones last, the rarer of these before the others.

    Two sets of that similarity have ``similarity`` of either's shingles in common at least. So the first that both have
    comes before so many of each, and is in both prefixes, which leave out one less than so many.
    """
    rarest_first = common_hashes(rows, row, words)
    release(rows.sparkSession)  # what was shuffled to count them
    rank = np.argsort(rarest_first).astype(np.int32)
    common = rows.sparkSession.sparkContext.broadcast((rarest_first[rank], rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = common.value
        for batch in batches:
            found = []
            for number, text in zip(batch.column("row").to_pylist(), as_bytes(batch.column("text"))):
                hashes = _hashes(text, words)
                if len(hashes):
                    late = _among(hashes, known)
                    last = hashes[late][np.argsort(rank[np.searchsorted(known, hashes[late])])]
                    sketch, hashes = odd_sketch(hashes, sketch_bits(len(hashes))), np.concatenate([hashes[~late], last])
                    found.append((number, len(hashes), sketch, hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["row", "n", "sketch", "prefix"])

    return rows.select(F.col(row).alias("row"), F.col("text").cast("string")).mapInArrow(run, "row bigint, n bigint, sketch binary, prefix array<bigint>")


def crossing_pairs(root: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the sets that have a hash at the places ``at``: those after it, of other roots, that can be so similar if this is the first hash that both have."""
    left = n - at
    for i in range(len(n) - 1):
        a, b = n[i], n[i + 1 :]
        ok = (root[i + 1 :] != root[i]) & (np.minimum(left[i], left[i + 1 :]) >= similarity / (1 + similarity) * (a + b) - 1e-9)
        if ok.any():
            yield i, np.flatnonzero(ok) + i + 1


def likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that ``sketches`` (row, n, sketch) don't show to be less similar: none of that similarity is left out.

    A shingle that one set has and the other hasn't changes one bit of the odd sketches, so these differ in as many bits
    as there are such shingles at most; and sets of a and b shingles have (a + b) (1 - s) / (1 + s) of them at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, sizes = (batch.column(c).to_numpy() for c in ("u", "v", "n"))
            apart = sketches_apart(batch.column("a").to_pylist(), batch.column("b").to_pylist())
            ok = apart <= sizes * (1 - similarity) / (1 + similarity) + 1e-6
            yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], ["u", "v"])

    first = sketches.select(F.col("row").alias("u"), F.col("n").alias("n_u"), F.col("sketch").alias("a")).hint("merge")
    second = sketches.select(F.col("row").alias("v"), F.col("n").alias("n_v"), F.col("sketch").alias("b")).hint("merge")
    both = pairs.join(first, "u").join(second, "v").select("u", "v", (F.col("n_u") + F.col("n_v")).alias("n"), "a", "b")
    return both.mapInArrow(run, "u bigint, v bigint")


def rest(rows: DataFrame, row: str, roots: DataFrame, words: int, similarity: float, limit: int = LIMIT) -> DataFrame:
    """Pairs (u, v), u < v, of the rows of ``roots`` (row, root) that have other roots: all those of that similarity, and others.

    Only hashes that prefixes of two roots have are dealt, as most of what is near has one root by now. Of the pairs
    that meet those go on that the sketches leave: most that share a passage only are told apart without their texts.
    """
    own = saved(prefixes(rows, row, words, similarity).join(roots.hint("merge"), "row").select("row", "root", "n", "sketch", "prefix"), "prefixes")
    entries = own.select("row", "root", "n", F.posexplode("prefix").alias("at", "key"))
    crossing = entries.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    entries = saved(entries.join(_sent(saved(crossing, "crossing")), "key"), "entries")
    release(rows.sparkSession)  # what was shuffled to find what crosses
    keys = ["key", "lo", "hi"]
    parts = bounded_blocks(entries, ["key"], "row", limit, "merge").select(*keys, "row", "root", "n", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, keys):
            number, root, n, at = (part.column(c).to_numpy() for c in ("row", "root", "n", "at"))
            for i, others in crossing_pairs(root, n, at, similarity):
                ends = number[others]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ends, number[i])), pa.array(np.maximum(ends, number[i]))], ["u", "v"])

    met = parts.repartition(*keys).sortWithinPartitions(*keys, "row").mapInArrow(run, "u bigint, v bigint").filter("u <> v").distinct()
    return likely(met, own.select("row", "n", "sketch"), similarity)


def groups(rows: DataFrame, row: str, words: int = WORDS, similarity: float = SIMILARITY, limit: int = LIMIT) -> DataFrame:
    """(row, root) of each row of ``rows`` (row, text; rows are numbered from 0 on): root is the least row that links reach, itself included.

    Rows of one fingerprint are one class, which its least row stands for; rows without words are one class too. Each
    class's link to the least row that it is near to is verified first. Then those candidates are verified that join
    what is still apart, so copies by the thousand cost one comparison each. At last the pairs are verified that the
    index doesn't meet or that its bounds leave out, of what is apart still: no link between different texts is lost.
    """
    prints = saved(prints_of(rows, row, words), "prints")
    of = saved(prints.groupBy("print").agg(F.min_by(F.struct("row", "keys"), "row").alias("x")).select("print", "x.row", "x.keys"), "print-classes")
    found = saved(candidates(of.filter("print is not null"), limit), "candidates")
    least = saved(found.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "least")
    links = saved(verified(least, rows, row, words, similarity), "verified")
    roots = saved(components(links), "roots")
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv")
    apart = found.join(least, ["u", "v"], "left_anti").join(a, "u", "left").join(b, "v", "left")
    apart = apart.filter(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")
    links = saved(links.unionByName(verified(saved(apart, "apart"), rows, row, words, similarity)), "verified")
    roots = saved(components(links).withColumnRenamed("node", "row"), "roots")
    release(rows.sparkSession)  # the index's shuffles, which would stay beside those of the prefixes
    classed = of.filter("print is not null").select("row").join(roots, "row", "left").select("row", F.coalesce("root", "row").alias("root"))
    more = saved(rest(rows, row, saved(classed, "classed"), words, similarity, limit), "rest")
    links = saved(links.unionByName(verified(more, rows, row, words, similarity)), "verified")
    roots = components(links).withColumnRenamed("node", "row")
    classes = of.select("print", "row").join(roots, "row", "left").select(F.col("print").alias("_print"), F.coalesce("root", "row").alias("root"))
    return prints.select("row", "print").join(classes, F.col("print").eqNullSafe(F.col("_print"))).select("row", "root")


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, limit: int = LIMIT) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the least doc_id, nulls last; of equal ones the first written.

    Rows are linked whose word shingles have that Jaccard similarity or more; groups are what links join. Null, empty and white texts have no words and are copies of
    each other. Rows are told apart by a number that is written with them, so repeated or missing doc_ids do no harm.
    """
    rows, row = numbered(docs)
    of = saved(groups(rows, row, words, similarity, limit), "groups")
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("bigint").alias("doc"))
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("first")
    every = of.join(ids, "row")
    kept = every.groupBy("root").agg(first).select("root", F.col("first.row").alias("_kept"))
    dropped = saved(of.join(kept, "root").filter("row <> _kept").select(F.col("row").alias(row)), "dropped")
    return rows.join(_sent(dropped), row, "left_anti").drop(row)
