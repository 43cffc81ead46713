"""Tokens of two tokenizers on the same bytes: which overlap, which end together, and how often over the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .pieces import MODEL, SPACE, model_path
from .spaced import ragged, stretches, words_of

BYTES_MODEL = "byte_bpe_50k.json"
#: Encoded words that a worker keeps, and characters of text that it aligns at once.
KEPT_WORDS, AT_ONCE = 400_000, 1 << 20


class Spelled:
    """What ids stand for: their bytes, in one array."""

    def __init__(self, spelled: list[bytes]):
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.letters[ragged(self.starts[ids], self.lengths[ids])]


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write each byte as: itself if it is printed, else the next one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """A: byte-level, of a space and the text. B: pieces, of the text (the model adds the space)."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        letters, names = _byte_letters(), {i: w for w, i in self.a.get_vocab().items()}
        self.bytes_a = Spelled([bytes(letters[c] for c in names[i]) if all(c in letters for c in names.get(i, "?\0")) else b"" for i in range(max(names) + 1)])
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode()
        self.bytes_b = Spelled([piece(i) for i in range(self.b.get_piece_size())])
        self._forget()
        # ids as text, with what comes after: a comma, the bar or the semicolon
        most = max(len(self.bytes_a.lengths), len(self.bytes_b.lengths))
        self.digits = Spelled([f"{i}{end}".encode() for i in range(most) for end in ",|;"])

    def encode_words(self, words: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """For A and for B the ids of all words and the number of each; and whether both spell a space and the word.

        Words are kept, so that those of the next texts aren't encoded again; beyond KEPT_WORDS all are let go.
        """
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT_WORDS:
            self._forget()
            new = words
        if new:
            self.kept = [np.concatenate(x) for x in zip(self.kept, self._encoded(new))]
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new))))
        own = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        a, sizes_a, b, sizes_b, right = self.kept
        side = lambda ids, sizes: (ids[ragged((np.cumsum(sizes) - sizes)[own], sizes[own])].astype(np.int64), sizes[own])
        return side(a, sizes_a), side(b, sizes_b), right[own]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.kept = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)]

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        def flat(lists):
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes

        spaced = [" " + w for w in words]
        a = flat([e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)])
        b = flat(self.b.encode(words, num_threads=1))
        want = Spelled([w.encode() for w in spaced])
        right = np.ones(len(words), bool)
        for (ids, counts), own in ((a, self.bytes_a), (b, self.bytes_b)):
            word = np.repeat(np.arange(len(words)), counts)
            right &= np.bincount(word, own.lengths[ids], len(words)) == want.lengths
            on = right[word]
            got, aim = own.of(ids[on]), want.of(np.flatnonzero(right))
            right[np.repeat(np.flatnonzero(right), want.lengths[right])[got != aim]] = False
        return [*a, *b, right]


@lru_cache(maxsize=2)
def tokenizers(bytes_path: str, pieces_path: str) -> Tokenizers:
    """Both tokenizers, read once a worker."""
    return Tokenizers(bytes_path, pieces_path)


class Aligned(NamedTuple):
    """Tokens of both sides over some texts, ``docs`` of them: ids, how many a text has, overlaps (i, j), and of those the ones that end together."""

    a: np.ndarray
    b: np.ndarray
    counts_a: np.ndarray
    counts_b: np.ndarray
    overlaps: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]


def overlaps(starts_a: np.ndarray, docs_a: np.ndarray, starts_b: np.ndarray, docs_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of tokens of a document that share a byte. Starts rise over all documents.

    Of two tokens that overlap, the one that starts later starts inside the other: each start looks for the other
    side's token that covers it. Those that start together are found from both sides and are taken once.
    """
    a = pd.DataFrame({"start": starts_a, "doc": docs_a, "i": np.arange(len(starts_a))})
    b = pd.DataFrame({"start": starts_b, "doc": docs_b, "j": np.arange(len(starts_b))})
    from_a = pd.merge_asof(a, b, on="start", by="doc")
    from_b = pd.merge_asof(b, a, on="start", by="doc")
    i, j = from_b["i"].to_numpy(), from_b["j"].to_numpy()
    new = starts_a[i] != starts_b[j]
    i, j = np.concatenate([from_a["i"].to_numpy(), i[new]]), np.concatenate([from_a["j"].to_numpy(), j[new]])
    return i, j


def aligned(t: Tokenizers, texts: list[str]) -> Aligned:
    """Both sides of texts; one that is empty, or that a side spells otherwise, has no tokens. Equal words are encoded once."""
    counts, codes, words = words_of(texts)
    (a, sizes_a), (b, sizes_b), right = t.encode_words(words)
    doc = np.repeat(np.arange(len(texts)), counts)
    wrong = np.zeros(len(texts), bool)
    wrong[doc[~right[codes]]] = True
    wrong |= np.array([not text for text in texts], bool)
    on = ~wrong[doc]
    codes, doc = codes[on], doc[on]

    def side(ids, sizes, own):
        per_word = sizes[codes]
        out = ids[ragged((np.cumsum(sizes) - sizes)[codes], per_word)]
        ends = np.cumsum(own.lengths[out])
        return out, np.repeat(doc, per_word), ends - own.lengths[out], ends

    a, docs_a, starts_a, ends_a = side(a, sizes_a, t.bytes_a)
    b, docs_b, starts_b, ends_b = side(b, sizes_b, t.bytes_b)
    i, j = overlaps(starts_a, docs_a, starts_b, docs_b)
    same = np.flatnonzero(ends_a[i] == ends_b[j])
    same = same[np.argsort(i[same], kind="stable")]
    n = len(texts)
    return Aligned(a, b, np.bincount(docs_a, minlength=n), np.bincount(docs_b, minlength=n), (i, j), (i[same], j[same]))


def _groups_text(t: Tokenizers, x: Aligned) -> tuple[bytes, np.ndarray]:
    """All groups as text, each ``a1,a2|b1;``, and how many bytes each token position takes up to it."""
    i, j = x.ends
    last_a, last_b = np.zeros(len(x.a), bool), np.zeros(len(x.b), bool)
    last_a[i], last_b[j] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    tokens = np.empty(len(x.a) + len(x.b), np.int64)
    tokens[np.arange(len(x.a)) + np.r_[0, j + 1][group_a]] = x.a * 3 + last_a
    tokens[np.arange(len(x.b)) + (i + 1)[group_b]] = x.b * 3 + 2 * last_b
    return t.digits.of(tokens).tobytes(), np.r_[0, np.cumsum(t.digits.lengths[tokens])]


def _measured(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], row: str, key: str, text: str) -> Iterator[pa.RecordBatch]:
    """For each stretch of a text its links; with the last one the row's key, counts and digest."""
    t = tokenizers(*paths)
    width = len(t.bytes_b.lengths)
    for batch in batches:
        rows, keys = (batch.column(batch.schema.get_field_index(c)) for c in (row, key))
        column = batch.column(batch.schema.get_field_index(text)).to_pylist()
        good = [True] * len(column)
        if any(len(c or "") > AT_ONCE for c in column):  # a text of several stretches has no tokens if any of them is spelled otherwise
            for own, texts, _ in stretches(column, AT_ONCE):
                for k, one in zip(own, texts):
                    good[k] = good[k] and SPACE not in one
        column = [c if g else None for c, g in zip(column, good)]
        totals, digests = np.zeros((len(column), 3), np.int64), [None] * len(column)
        for own, texts, first in stretches(column, AT_ONCE):
            x = aligned(t, texts)
            raw, at = _groups_text(t, x)
            edges_a, edges_b = np.r_[0, np.cumsum(x.counts_a)], np.r_[0, np.cumsum(x.counts_b)]
            links = np.searchsorted(x.ends[0], edges_a)
            codes = x.a[x.ends[0]] * width + x.b[x.ends[1]]
            for k, r in enumerate(own):
                totals[r] += (x.counts_a[k], x.counts_b[k], links[k + 1] - links[k])
                if x.counts_a[k]:
                    digests[r], joint = (digests[r], b";") if digests[r] else (hashlib.sha256(), b"")
                    digests[r].update(joint + raw[at[edges_a[k] + edges_b[k]] : at[edges_a[k + 1] + edges_b[k + 1]] - 1])
            lists = pa.ListArray.from_arrays(pa.array(links, pa.int32()), pa.array(codes))
            yield _rows(rows.take(pa.array(own)), lists, pa.nulls(len(own), keys.type), np.zeros((len(own), 3), np.int64), [None] * len(own), False)
        yield _rows(rows, pa.nulls(len(column), pa.list_(pa.int64())), keys, totals, [d.hexdigest() if d else "" for d in digests], True)


def _rows(rows, links, keys, totals, digests, whole: bool) -> pa.RecordBatch:
    columns = [rows, links, keys, *(pa.array(totals[:, c]) for c in range(3)), pa.array(digests, pa.string()), pa.array([whole] * len(rows), pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["_row", "links", "_key", "n_a", "n_b", "n_groups", "groups_sha256", "_whole"])


def _listed(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], text: str) -> Iterator[pa.RecordBatch]:
    t = tokenizers(*paths)
    for batch in batches:
        x = aligned(t, [c or "" for c in batch.column(batch.schema.get_field_index(text)).to_pylist()])
        edges_a, edges_b = np.r_[0, np.cumsum(x.counts_a)], np.r_[0, np.cumsum(x.counts_b)]
        order = np.lexsort((x.overlaps[1], x.overlaps[0]))
        i, j = (o[order] for o in x.overlaps)
        doc = np.searchsorted(edges_a, i, "right") - 1
        together = np.zeros(len(x.a), np.int64) - 1
        together[x.ends[0]] = x.ends[1]
        pairs = pa.StructArray.from_arrays([pa.array(i - edges_a[doc], pa.int32()), pa.array(j - edges_b[doc], pa.int32()), pa.array(together[i] == j)], names=["a", "b", "ends"])
        ints = lambda edges, values: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))
        cut = pa.ListArray.from_arrays(pa.array(np.searchsorted(i, edges_a), pa.int32()), pairs)
        names = [n for n in batch.schema.names if n != text]
        rest = [batch.column(batch.schema.get_field_index(n)) for n in names]
        yield pa.RecordBatch.from_arrays([*rest, ints(edges_a, x.a), ints(edges_b, x.b), cut], [*names, "a_ids", "b_ids", "overlaps"])


def _paths(paths: tuple[str, str] | None) -> tuple[str, str]:
    return paths or (model_path(BYTES_MODEL), model_path(MODEL))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(key, a_ids, b_ids, overlaps array<struct<a, b, ends>>) of each row: both sides' ids, and the tokens (by number) that share a byte.

    ``ends`` tells that both end together; what lies between two such ends is a group. A null or empty text, or one that
    a side doesn't spell (it holds U+2581), has no tokens. Rows stay as they are, null keys and repeated ones too.
    """
    kind = docs.schema[key].dataType.simpleString()
    run = partial(_listed, paths=_paths(paths), text=text)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, a_ids array<int>, b_ids array<int>, overlaps array<struct<a:int,b:int,ends:boolean>>")


def link_counts(links: DataFrame, width: int) -> DataFrame:
    """(link, n, best) of all links (a id * width + b id): how many there are, and whether no other has more for its b id."""
    counts = links.groupBy("link").agg(F.count(F.lit(1)).alias("n")).withColumn("_b", F.col("link") % width)
    most = counts.groupBy("_b").agg(F.max("n").alias("_most"))
    return counts.join(most, "_b").select("link", "n", (F.col("n") == F.col("_most")).cast("long").alias("best"))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, with links counted over all rows.

    Texts are encoded once and their links written. The counts have a row for each pair of ids of which one's bytes end
    with the other's: at most as many as both vocabularies have bytes (half a million), whatever the corpus; so they are
    broadcast. Null and empty texts, and those that ``align`` gives no tokens, have zeros and ''.
    """
    kind, paths = docs.schema[key].dataType.simpleString(), _paths(paths)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    schema = f"_row long, links array<long>, _key {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, _whole boolean"
    measured = saved(rows.mapInArrow(partial(_measured, paths=paths, row="_row", key="_key", text="_text"), schema), "alignment")
    links = measured.filter(~F.col("_whole")).select("_row", F.explode("links").alias("link"))
    counts = link_counts(links.select("link"), len(tokenizers(*paths).bytes_b.lengths))
    sums = links.join(F.broadcast(counts), "link").groupBy("_row").agg(F.count(F.lit(1)).alias("n_links"), F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    whole = measured.filter("_whole").drop("links", "_whole").join(sums, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.select(F.col("_key").alias(key), "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures(table(spark, sf_dir, "documents"))
