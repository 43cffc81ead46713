"""Periodic runs of words: recompression of texts to run-length grammars, whose symbols answer how far two places agree."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table
from .spaced import ragged

#: A run has at least so many words, and so many periods.
SHORTEST, TIMES = 24, 3
#: Words that one grammar is made of; a longer text has its own. Places that are looked at together.
WORDS, PLACES = 400_000, 4_000_000


class Grammar:
    """Levels of a sequence: blocks of equal symbols become one symbol, then pairs of a left and a right symbol do, in turn.

    Equal stretches become equal symbols but for their ends. Nodes are numbered through all levels; ``up`` is the node
    over a node, ``down`` and ``final`` the first and the last under it, ``begin`` and ``stop`` bound the equal neighbours
    that it may be passed with.
    The first and the last symbol of the sequence, and whatever bounds its texts, must occur once.
    """

    def __init__(self, symbols: np.ndarray):
        sym, levels, base = symbols.astype(np.int64), [], 0
        down = final = np.zeros(len(sym), np.int32)
        turn = 0
        while True:
            n = int(sym.max()) + 1
            blocks = turn % 2 == 0
            heads, names = _blocks(sym) if blocks else _pairs(sym, n, turn)
            turn += 1
            if len(heads) == len(sym):  # nothing to join this time
                if turn > 200 or len(np.unique(sym)) == len(sym):
                    break
                continue
            top = np.zeros(len(sym), np.int32)
            top[heads] = 1
            over = np.cumsum(top, dtype=np.int32) - 1
            ends = np.append(heads[1:], len(sym)).astype(np.int32) + base
            heads = heads.astype(np.int32) + base
            own = np.arange(base, base + len(sym), dtype=np.int32)
            levels.append((sym.astype(np.int32), over + np.int32(base + len(sym)), down, final, heads[over] if blocks else own, ends[over] if blocks else own + 1))
            down, final = heads, ends - 1
            base += len(sym)
            sym = np.unique(names, return_inverse=True)[1].astype(np.int64)
        own = np.arange(base, base + len(sym), dtype=np.int32)
        levels.append((sym.astype(np.int32), np.full(len(sym), -1, np.int32), down, final, own, own + 1))
        self.size = len(symbols)
        self.sym, self.up, self.down, self.final, self.begin, self.stop = (np.concatenate(x) for x in zip(*levels))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on and from j on agree; i and j differ."""
        return self._extent(i, j, True)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j back agree."""
        return self._extent(i, j, False)

    def _extent(self, i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
        """Up while the symbols over both begin here (end, if backward) and are alike, past equal ones; after the first that differ, down."""
        out, own = np.zeros(len(i), np.int64), np.arange(len(i))
        a, b, climbs = i.astype(np.int64), j.astype(np.int64), np.ones(len(i), bool)
        while len(a):
            same = self.sym[a] == self.sym[b]
            up_a, up_b = self.up[a].astype(np.int64), self.up[b].astype(np.int64)
            rises = same & climbs & (up_a >= 0)
            at = np.flatnonzero(rises)
            under = self.down if ahead else self.final
            rises[at] = (under[up_a[at]] == a[at]) & (under[up_b[at]] == b[at])
            passes, falls = same & ~rises, ~same & (a >= self.size)
            if ahead:
                step = np.minimum(self.stop[a] - a, self.stop[b] - b)
            else:
                step = -np.minimum(a - self.begin[a], b - self.begin[b]) - 1
            ends = ~same & ~falls
            out[own[ends]] = np.abs(a[ends] - i[own[ends]])
            a = np.where(rises, up_a, np.where(passes, a + step, under[a]))
            b = np.where(rises, up_b, np.where(passes, b + step, under[b]))
            climbs &= same
            a, b, climbs, own = a[~ends], b[~ends], climbs[~ends], own[~ends]
        return out


def _blocks(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of equal symbols begin, and a name of each, by symbol and length."""
    heads = np.flatnonzero(np.r_[True, sym[1:] != sym[:-1]])
    sizes = np.diff(np.append(heads, len(sym)))
    return heads, sym[heads] * (int(sizes.max()) + 1) + sizes


def _pairs(sym: np.ndarray, n: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Where symbols that stay alone and pairs begin, and their names. Symbols are left or right ones by a hash; the order that gives more pairs is taken."""
    mixed = (np.arange(n, dtype=np.uint64) + np.uint64(turn << 32)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    side = ((mixed >> np.uint64(61)) & np.uint64(1)).astype(bool)[sym]
    one, two = ~side[:-1] & side[1:], side[:-1] & ~side[1:]
    first = one if one.sum() >= two.sum() else two
    stays = np.r_[True, ~first]
    heads = np.flatnonzero(stays)
    after = np.where(np.r_[first, False][heads], sym[np.minimum(heads + 1, len(sym) - 1)] + 1, 0)
    return heads, sym[heads] * (n + 1) + after


def runs_of(ids: np.ndarray, sizes: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """(text, start, length, period) of all runs of texts, one after the other in ``ids``, of ``sizes`` symbols each.

    A run of period p holds three places in a row of any grid of step g = max(p, shortest / times), so that the symbols at the first
    two equal those p further; places where this holds are extended both ways by the grammar. What a run covers is not
    looked at again for its period. Of the periods of one stretch the least counts.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes + np.arange(len(sizes)) + 1  # a bound before each text, and one after the last
    if not (sizes >= shortest).any():
        return np.zeros((0, 4), np.int64)
    n = int(ids.max()) + 1
    seq = np.empty(len(ids) + len(sizes) + 1, np.int64)
    seq[ragged(begins, sizes)] = ids
    seq[np.append(begins - 1, len(seq) - 1)] = n + np.arange(len(sizes) + 1)
    grammar, found = Grammar(seq), []
    texts = np.flatnonzero(sizes >= shortest)
    most = sizes[texts] // times
    for text, period in _blocks_of_periods(texts, most, sizes, shortest // times):
        step = np.maximum(period, shortest // times)
        places = np.maximum((sizes[text] - 1 - step - period) // step + 1, 0)
        group = np.repeat(np.arange(len(text)), places)
        p, g = period[group], step[group]
        x = begins[text][group] + ragged(np.zeros(len(places), np.int64), places) * g
        for shift in (0, 1, 2):
            at = x + (g if shift == 1 else g // 2 if shift == 2 else 0)
            on = seq[at] == seq[at + p]
            x, p, g, group = x[on], p[on], g[on], group[on]
        covered = np.full(len(text), -1)
        while len(x):
            head = np.r_[True, group[1:] != group[:-1]]
            i, k, own = x[head], p[head], group[head]
            end = i + k + grammar.forward(i, i + k)
            start = i - grammar.backward(i - 1, i + k - 1)
            good = end - start >= np.maximum(shortest, times * k)
            found.append(np.stack([text[own], start - begins[text[own]], end - start, k])[:, good])
            covered[own] = end - k
            on = x >= np.maximum(covered[group], x[np.flatnonzero(head)][np.cumsum(head) - 1] + 1)
            x, p, group = x[on], p[on], group[on]
    out = np.concatenate(found, axis=1).T if found else np.zeros((0, 4), np.int64)
    out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]
    return out[np.r_[True, (out[1:, :3] != out[:-1, :3]).any(axis=1)]] if len(out) else out


def _blocks_of_periods(texts: np.ndarray, most: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (text, period), in blocks of about PLACES places of their grids."""
    total = int(most.sum())
    ends = np.cumsum(most)
    at = 0
    while at < total:
        here = np.arange(at, min(at + PLACES // 4, total))
        k = np.searchsorted(ends, here, "right")
        period = here - (ends - most)[k] + 1
        weight = np.cumsum(sizes[texts[k]] // np.maximum(period, least) + 1)
        stop = max(1, int(np.searchsorted(weight, PLACES)))
        yield texts[k[:stop]], period[:stop]
        at += stop


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, and how many each has."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    solid = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(solid)])
    offsets = before[offsets - offsets[0]]
    return words.filter(pa.array(solid)), np.diff(offsets)


def _slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with texts of about ``limit`` bytes; a longer one is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.schema.get_field_index(text)
        for start, stop in _slices(batch.column(k), 6 * WORDS):
            part = batch.slice(start, stop - start)
            words, sizes = _split(part.column(k))
            runs = runs_of(words.dictionary_encode().indices.to_numpy().astype(np.int64), sizes)
            begins = np.cumsum(sizes) - sizes
            drop = np.zeros(len(words) + 1, np.int64)
            at = begins[runs[:, 0]] + runs[:, 1]
            np.add.at(drop, at + runs[:, 3], 1)
            np.add.at(drop, at + runs[:, 2], -1)
            keep = np.cumsum(drop)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(keep)])[np.append(begins, len(words))]
            kept = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.filter(pa.array(keep)))
            found = np.concatenate([[0], np.cumsum(np.bincount(runs[:, 0], minlength=len(sizes)))])
            rows = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(found, pa.int32()), rows)
            out = pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())
            rest = [i for i in range(batch.num_columns) if i != k]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), lists, out], [*(batch.schema.names[i] for i in rest), "runs", "collapsed"])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs, collapsed) of each row: its text's runs, by start and then length, and the text without what they repeat.

    A run (start, length, period; in words) is a stretch whose words equal those a period further, of at least 24 words and
    three periods, that can't be made longer; the period is the least. Collapsed is the text's words, joined by spaces,
    without those that a run has after its first period. A null or empty text has no runs and collapses to the empty
    string. Rows stay as they are, null keys and repeated ones too; other columns are left out. A text is worked on as a
    whole, at about 130 bytes a word.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(partial(_found, text=text), f"`{key}` {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text); the words of every tenth by the hash of doc_id, from some place on, repeat what begins there. Native columns."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n = F.nullif(F.size("_words").cast("bigint"), F.lit(0))  # of a text without words null, as a remainder by zero is an error
    rows = docs.select("doc_id", "text").withColumn("_g", g).withColumn("_words", F.when(h % 10 == 0, words))
    rows = rows.withColumn("_a", F.col("_g") % n).withColumn("_p", F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + F.col("_g") % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get("_words", place(i))), " ")
    return rows.select("doc_id", F.when(F.size("_words") > 0, again).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    rows = found.withColumn("_b", best).withColumn("_lines", F.array_join(lines, ""))
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_b.s")).alias("start"), F.col("_b.n").alias("length"), (-F.col("_b.p")).alias("period"),
        F.expr("1000 * _b.n div -_b.p").alias("exponent_milli"), F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
