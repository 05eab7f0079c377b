"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source has the same inclusion expectation: target / size of
the source, at most 2. Its whole part is taken surely; the fractional part is a
probability, and the cube method turns the probabilities into decisions while
token and document totals keep their expectations: each step moves three
undecided documents along the null space of both constraints until one of them
is decided. What cannot move any more is the landing problem: the undecided
documents and the ``LANDING`` smallest ones decided last, whatever the source's size.

The flight runs over chunks of a source, so a source of any share of the rows is
spread over tasks. A chunk leaves at most two documents undecided; those of all
chunks fly again, until a source fits one chunk. Documents fly from the largest
to the smallest, so the landing has small ones to meet the total with.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.common import hot_keys, salted_join, word_count
from lumenfold.session import keep

#: Weights of the sources in code point order, repeating; a null source comes last.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all sizes.
TOTAL_SHARE = 1.5
#: No source is taken more often than this.
MOST = 2.0
#: Documents that one task flies at a time.
CHUNK = 2000
#: Documents at the end of a source's last flight whose decisions the landing may change, and how many changes it makes at most.
LANDING, MOST_CHANGES = 64, 8
_EPS = 1e-9


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (site, source, source_size, ...) with ``target``: ``share`` of all sizes by weight, at most ``most`` times a source's own.

    A source's weight follows from its place in code point order, null last.
    What the targets that stop would exceed goes to the others by weight: all
    open targets are one level times their weight. The level rises until no
    further source stops; each round is one aggregate. The sources never leave
    Spark: places are counted within range partitions and shifted by their sizes.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    local = F.monotonically_increasing_id()
    placed = keep(
        sources.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("part"), local.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per partition
    shift = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    place = (F.col("at") + F.col("shift")) % len(weights)
    weighed = placed.join(shift, "part").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    weighed = keep(weighed.drop("part", "at", "shift"), "weights")
    limit = F.lit(float(most)) * F.col("source_size")
    total = share * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        stops = F.lit(level) * F.col("weight") > limit
        row = weighed.agg(
            F.count_if(stops).alias("n"), F.sum(F.when(stops, limit).otherwise(0.0)).alias("used"), F.sum(F.when(stops, 0.0).otherwise(F.col("weight"))).alias("open")
        ).first()
        if row["n"] == stopped or not row["open"]:
            break
        stopped, level = row["n"], (total - row["used"]) / row["open"]
    return weighed.withColumn("target", F.least(F.lit(level) * F.col("weight"), limit)).drop("weight")


def fly(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The flight phase for balancing sum(size) and the count, in the given order.

    ``p`` are probabilities, ``draw`` uniform numbers that pick the direction.
    At most two values are left that are neither 0 nor 1.
    """
    p = p.astype(float).copy()
    held: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = round(p[i])
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        now = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            room_up = np.where(u > 0, (1 - now) / u, np.where(u < 0, -now / u, np.inf))
            room_down = np.where(u > 0, now / u, np.where(u < 0, (now - 1) / u, np.inf))
        up, down = room_up.min(), room_down.min()
        now = now + up * u if draw[i] * (up + down) < down else now - down * u
        p[held] = np.where(now < _EPS, 0.0, np.where(now > 1 - _EPS, 1.0, now))
        held = [k for k in held if 0 < p[k] < 1]
    return p


def _exchange(p: np.ndarray, size: np.ndarray, off: float) -> tuple[float, tuple[int, ...]]:
    """The exchange of a taken for an untaken document that leaves the total nearest to its goal."""
    taken, free = np.nonzero(p > 0)[0], np.nonzero(p == 0)[0]
    if not len(taken) or not len(free):
        return np.inf, ()
    free = free[np.argsort(size[free], kind="stable")]
    near = np.searchsorted(size[free], size[taken] - off)
    best: tuple[float, tuple[int, ...]] = (np.inf, ())
    for other in (free[np.maximum(near - 1, 0)], free[np.minimum(near, len(free) - 1)]):
        after = np.abs(off - size[taken] + size[other])
        k = int(after.argmin())
        best = min(best, (float(after[k]), (int(taken[k]), int(other[k]))))
    return best


def land(p: np.ndarray, size: np.ndarray, goal: float) -> np.ndarray:
    """Decide what a flight has left, then come as near to ``goal`` tokens as a few changed decisions allow.

    An undecided document is rounded; each further step changes one decision, or
    exchanges two documents, whichever brings the total nearest to its goal. The
    first step that can't ends it.
    """
    p = np.round(p)
    for _ in range(MOST_CHANGES if len(p) else 0):
        off = float((p * size).sum()) - goal
        after = np.abs(off + np.where(p > 0, -size, size))
        one = int(after.argmin())
        left, changed = min((float(after[one]), (one,)), _exchange(p, size, off))
        if left >= abs(off):
            break
        p[list(changed)] = 1 - p[list(changed)]
    return p


def _draws(keys: pd.Series) -> np.ndarray:
    return keys.to_numpy(np.int64).view(np.uint64).astype(float) / 2**64


def _flight(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "key", "text_hash", "copy"], ascending=[False, True, True, True, True], kind="stable")
        size = group["size"].to_numpy()
        before = group["p"].to_numpy()
        p = fly(before, size, _draws(group["draw"]))
        # Documents whose share is whole (among them those of size 0) have nothing to decide.
        if last:
            open_ = np.nonzero((before > 0) & (before < 1))[0]
            late = np.unique(np.concatenate([open_[(p[open_] > 0) & (p[open_] < 1)], open_[-LANDING:]]))
            goal = float((before[open_] * size[open_]).sum()) - float((p[open_] * size[open_]).sum()) + float((p[late] * size[late]).sum())
            p[late] = land(p[late], size[late], goal)
        return group.assign(p=p).drop(columns="chunk")

    return run


def _identified(docs: DataFrame, *more: Column) -> DataFrame:
    """(key, text_hash, doc_id, source, size, more): key stands for doc_id and source, null unlike any other value."""
    doc_id, source, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
    key = F.xxhash64(doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), source.isNull(), F.coalesce(source, F.lit("")))
    site = F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source))
    return docs.select(
        key.alias("key"), F.xxhash64(text.isNull(), F.coalesce(text, F.lit(""))).alias("text_hash"), doc_id.alias("doc_id"),
        source.alias("source"), site.alias("site"), word_count(text).alias("size"), *more,
    )


def _number() -> Column:
    """Rows alike in doc_id, source and text are told apart by a running number."""
    return F.row_number().over(Window.partitionBy("key", "text_hash").orderBy("doc_id"))


def mix(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, taken, copies and what tells the row apart.

    ``copies`` is 0, 1 or 2 and ``taken`` is copies * size. A null text has size
    0; documents of size 0 are never copied. A null source is a source of its
    own, after all others. Rows alike in doc_id, source and text are told apart
    by a running number. An empty table gives no rows. Other columns are ignored.
    """
    sized = keep(_identified(docs).withColumn("copy", _number()), "sizes")
    sources = sized.groupBy("site", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = keep(with_targets(sources), "targets")
    share = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    held = (
        salted_join(sized, plan.select("site", "source_size", "target", F.col("n").alias("rows")), ["site"], hot_keys(plan, ["site"]), ["key", "text_hash", "copy"])
        .withColumn("share", share).withColumn("sure", F.floor("share")).withColumn("p", F.col("share") - F.col("sure"))
        .withColumn("draw", F.xxhash64(F.lit(42), "key", "text_hash", "copy"))
    )
    decided, most = None, plan.agg(F.max("n")).first()[0] or 0
    schema = held.schema
    while True:
        chunks = math.ceil(most / CHUNK)
        last = chunks <= 1
        # A source that fits one chunk lands at once; the others' rows are dealt to as many chunks as they fill.
        chunk = F.pmod(F.xxhash64(F.lit(most), "key", "text_hash", "copy"), F.greatest(F.ceil(F.col("rows") / CHUNK), F.lit(1)))
        dealt = held.withColumn("chunk", chunk)
        if last:
            flown = dealt.groupBy("site", "chunk").applyInPandas(_flight(True), schema)
            decided = flown if decided is None else decided.union(flown)
            break
        small = dealt.where(F.col("rows") <= CHUNK).groupBy("site", "chunk").applyInPandas(_flight(True), schema)
        flown = keep(dealt.where(F.col("rows") > CHUNK).groupBy("site", "chunk").applyInPandas(_flight(False), schema), "flown")
        landed = small.union(flown.where("p = 0 or p = 1"))
        decided = landed if decided is None else decided.union(landed)
        # Each chunk leaves two documents at most.
        held = flown.where("p > 0 and p < 1").withColumn("rows", 2 * F.ceil(F.col("rows") / CHUNK))
        most = 2 * chunks
    copies = (F.col("sure") + F.col("p")).cast("long")
    return decided.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "key", "text_hash", "copy"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: not at all, once or twice. All columns stay, whatever their names."""
    decided = mix(docs).groupBy("key", "text_hash").agg(F.array_sort(F.collect_list(F.struct("copy", "copies"))).alias("of_copies"))
    held = _identified(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("key", "text_hash", "doc_id", "row")
    # One shuffle of the rows serves the window and the join.
    numbered = held.withColumn("number", _number())
    times = F.element_at("of_copies", F.col("number"))["copies"]
    again = numbered.join(decided, ["key", "text_hash"]).withColumn("times", times).where("times > 0")
    return again.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
