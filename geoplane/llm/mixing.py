"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import random
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, saved, table

WEIGHTS, MOST, GROUP, SEED = (5, 2, 1), 3, 5000, 42
#: Units of a source that take no part in its last flight: the landing problem has these and two more at most.
RESERVE = 10
NEAR = 1e-9


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_no, source_size, docs, target) of sizes (source, size): a row for each source.

    Sources by code point, null last, weigh ``weights``, repeating, and share the words of all. A target stops at
    ``most`` times the words of its source; what it can't take goes to the others by weight, until none is above.
    With sources in order of words / weight, those that stop are the first: each row's share is what the sources
    before it leave, and the first source that isn't full by its share sets it. Works on one row a source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by = by.withColumn("source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("bigint"))
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("w"), "source_no")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    by = by.withColumn("share", left / weight)
    fits = F.when(F.col("share") * F.col("w") <= most * F.col("source_size"), F.struct(F.col("source_size") / F.col("w"), "source_no", "share"))
    by = by.withColumn("share", F.min(fits).over(every)["share"])
    target = F.least(F.coalesce(F.col("share"), F.lit(0.0)) * F.col("w"), F.lit(float(most)) * F.col("source_size"))
    return by.select("source", "source_no", "source_size", "docs", target.alias("target"))


def flight(p: list[float], x: list[float], rng: random.Random) -> list[float]:
    """Move ``p`` to 0 or 1, holding sum(p) and sum(p * x), until no more than two, of different x, are between.

    Three units move at a time along the null space of the constraints' rows (1, 1, 1) and (x1, x2, x3); how far
    either way is drawn so that no p changes on average.
    """
    p, todo, held = list(p), iter(range(len(p))), []
    while True:
        while len(held) < 3 and (i := next(todo, None)) is not None:
            if NEAR < p[i] < 1 - NEAR:
                held.append(i)
        same = next(((a, b) for n, a in enumerate(held) for b in held[n + 1 :] if x[a] == x[b]), None)
        if same:
            move = [(same[0], 1.0), (same[1], -1.0)]
        elif len(held) == 3:
            a, b, c = held
            far = max(abs(x[c] - x[b]), abs(x[a] - x[c]), abs(x[b] - x[a]))
            move = [(a, (x[c] - x[b]) / far), (b, (x[a] - x[c]) / far), (c, (x[b] - x[a]) / far)]
        else:
            return p
        up = min((1 - p[i]) / u if u > 0 else p[i] / -u for i, u in move)
        down = min(p[i] / u if u > 0 else (1 - p[i]) / -u for i, u in move)
        step = up if rng.random() * (up + down) < down else -down
        for i, u in move:
            p[i] = min(1.0, max(0.0, p[i] + step * u))
        for i, _ in move:
            if not NEAR < p[i] < 1 - NEAR:
                p[i] = float(round(p[i]))
                held.remove(i)


def land(p: list[float], x: list[float]) -> list[float]:
    """Round the few p that are between so that the words change least, then the documents, then the first are left."""
    between = [i for i, v in enumerate(p) if 0 < v < 1]
    if not between:
        return list(p)
    ends = np.array(list(product((0.0, 1.0), repeat=len(between)))).reshape(-1, len(between))
    off = ends - np.array([p[i] for i in between])
    words, documents = np.abs(off @ np.array([x[i] for i in between])), np.abs(off.sum(axis=1))
    best = np.lexsort((documents, words.round(6)))[0]
    p = list(p)
    for i, e in zip(between, ends[best].tolist()):
        p[i] = e
    return p


def balanced(units: DataFrame, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """``units`` (source_no, doc_id, size, p, docs) with every p moved to 0 or 1, balanced in each source.

    Each source is dealt by hash into groups of about ``group`` units; in each, a flight leaves two units at most
    between 0 and 1. These are dealt into groups again, until a source is one group, which lands. So no task holds
    more than a group, whatever a source's share. The draws depend on the rows only.
    """
    columns = units.columns
    done, parts = None, F.ceil(F.col("docs") / group).cast("bigint")
    left = units.withColumn("parts", F.greatest(parts, F.lit(1)))
    while True:
        dealt = left.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("parts")))

        def fly(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["order", "doc_id", "size"], kind="stable")
            rng = random.Random(f"{seed} {rows.source_no.iloc[0]} {rows.part.iloc[0]} {rows.parts.iloc[0]}")
            p, x, last = rows.p.tolist(), rows["size"].tolist(), rows.parts.iloc[0] == 1
            held = p[-RESERVE:] if last else []
            p = flight(p[: len(p) - len(held)], x, rng) + held
            rows["p"] = land(p, x) if last else p
            return rows.drop(columns=["part", "order"])

        ordered = dealt.withColumn("order", F.xxhash64("doc_id", F.lit(seed)))
        moved = saved(ordered.groupBy("source_no", "parts", "part").applyInPandas(fly, left.schema), "flight")
        end = moved.filter("p = 0 or p = 1").select(*columns)
        done = end if done is None else done.unionByName(end)
        left = moved.filter("p > 0 and p < 1")
        if not left.limit(1).count():
            return done
        left = left.withColumn("parts", F.greatest(F.ceil(F.col("parts") * 2 / group).cast("bigint"), F.lit(1)))


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each row: how often the mix takes a document.

    With r = target / source_size, every document of the source is taken floor(r) times, and once more with
    probability r - floor(r), by the cube method: balanced on words and documents, so that a source's words come
    within about a small document of its target. size: words between ASCII white space, 0 for null. Repeated rows
    are documents of their own. A source without words has target 0.
    """
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    sizes = saved(sizes, "sizes")
    goal = saved(targets(sizes, weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("base", F.floor(ratio + NEAR)).withColumn("p", F.greatest(ratio - F.col("base"), F.lit(0.0)))
    goal = goal.withColumn("p", F.when(F.col("p") > NEAR, F.col("p")).otherwise(0.0))
    # the table has a row a source; if it is small Spark broadcasts it, else hot sources are split
    units = sizes.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    units = units.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no null among 64-bit integers
    out = balanced(units.filter("size > 0"), group, seed).unionByName(units.filter("size = 0").withColumn("p", F.lit(0.0)))
    copies = (F.col("base") + F.col("p")).cast("bigint")
    return out.select(F.col("doc_id").cast(sizes.schema["doc_id"].dataType), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
