"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Each vector, less a common centre, is rotated at random and kept as one sign
bit per dimension with two correction scalars: its length and how well the bits
represent its direction. A query is rotated too and taken in ``LEVELS`` bit
planes, so that its product with a code is a few counts of common bits. With the
scalars that gives an unbiased estimate of the inner product, and a bound of its
error. Vectors whose estimate plus bound reaches the k-th exact score found so
far are scored exactly, in double precision on the original components.

The stated queries meet all rows: a group of queries of a fixed size is sent to
all tasks, each of which reads its part of the index once and keeps the k + 1
best of every query. The index itself is never shuffled or copied for that. Equal
vectors are one entry with their k + 1 least ids: more of them can never be
among the k nearest of anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from lumenfold.session import keep

NEIGHBOURS = 20
#: Components of the queries that are sent to all tasks at a time: 32 MB.
GROUP_VALUES = 1 << 22
#: Rows of the index in a file and in one step, and queries in one step.
INDEX_ROWS, INDEX_STEP, QUERY_STEP = 8192, 4096, 256
#: Estimates scored exactly at first, for each query and task.
FIRST = 64
#: Width of the error bound; an estimate leaves it with a probability of some percent.
EPSILON = 1.7
#: Bits of a query's components.
LEVELS = 4
#: Vectors that the common centre is taken from, at most about this many.
SAMPLE = 20_000
SALTS = 32
EMPTY = "query_id long, rank int, vec_id long, score double"


def rotation(dims: int) -> np.ndarray:
    """A random rotation, the same on every run."""
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and the inner products of the directions with their coded directions."""
    rest = (vectors.astype(float) - centre) @ turn.T
    length = np.linalg.norm(rest, axis=1)
    direction = rest / np.where(length > 0, length, 1)[:, None]
    return _words(rest > 0), length, np.abs(direction).sum(axis=1) / math.sqrt(vectors.shape[1])


class Codes:
    """Coded vectors: ``words``, and per vector what turns a product with its bits into an estimate and a bound."""

    def __init__(self, words: np.ndarray, length: np.ndarray, fit: np.ndarray, dims: int):
        self.words, self.ones = words, np.bitwise_count(words).sum(axis=1)
        scale = np.where(fit > 0, length / np.where(fit > 0, fit, 1), 0)
        self.scale = (scale / math.sqrt(dims)).astype(np.float32)
        self.slack = (EPSILON * scale * np.sqrt(np.maximum(0, 1 - fit**2)) / math.sqrt(max(dims - 1, 1))).astype(np.float32)


class Queries:
    """Queries in bit planes: component = low + step * level."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.vectors = vectors.astype(float)
        turned = self.vectors @ turn.T
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**LEVELS - 1), 1e-300)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [_words(level >> j & 1) for j in range(LEVELS)]
        self.total = self.low * turned.shape[1] + self.step * level.sum(axis=1, dtype=float)
        self.base = self.vectors @ centre
        self.length = np.linalg.norm(self.vectors, axis=1)
        # What rounding to levels adds to an estimate's error.
        self.rounding = EPSILON * self.step * math.sqrt(turned.shape[1] / 12)

    def estimate(self, rows: slice, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (query by vector), and how large they may be within their error bounds."""
        common = np.zeros((rows.stop - rows.start, len(codes.words)), np.int32)
        for j, plane in enumerate(self.planes):
            for w in range(codes.words.shape[1]):
                common += np.bitwise_count(plane[rows, w, None] & codes.words[None, :, w]).astype(np.int32) << j
        f = lambda x: x[rows, None].astype(np.float32)
        with_bits = f(self.low) * codes.ones[None, :].astype(np.float32) + f(self.step) * common
        guess = (2 * with_bits - f(self.total)) * codes.scale + f(self.base)
        return guess, guess + codes.slack * f(self.length) + codes.scale * f(self.rounding)


class Best:
    """The best ``k`` (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = [np.empty(0)] * n, [np.empty(0, np.int64)] * n
        self.bar = np.full(n, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.bar[q]
        if not good.any():
            return
        scores, ids = np.concatenate([self.scores[q], scores[good]]), np.concatenate([self.ids[q], ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.bar[q] = scores[order[-1]]


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order whatever stands beside it."""
    return (vectors * query).sum(axis=1)


def scan(codes: Codes, vectors: np.ndarray, ids: np.ndarray, queries: Queries, best: Best) -> None:
    """Let the queries meet some vectors."""
    exact = vectors.astype(float)
    for start in range(0, len(queries.vectors), QUERY_STEP):
        rows = slice(start, min(start + QUERY_STEP, len(queries.vectors)))
        guess, most = queries.estimate(rows, codes)
        for q, (g, m) in enumerate(zip(guess, most, strict=True), start):
            at = np.arange(len(g))
            if len(g) > FIRST:
                if best.bar[q] == -np.inf:  # a first bar, from the best estimates
                    first = np.argpartition(-g, FIRST)[:FIRST]
                    best.add(q, products(exact[first], queries.vectors[q]), ids[first])
                    m[first] = -np.inf
                at = np.nonzero(m >= best.bar[q])[0]
                # A quick product first; what is clearly below the bar needs no other.
                at = at[exact[at] @ queries.vectors[q] >= best.bar[q] - 1e-9 * (1 + abs(best.bar[q]))]
            if len(at):
                best.add(q, products(exact[at], queries.vectors[q]), ids[at])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, d, h1, h2) of the rows that take part; d is the length, h1 and h2 hash the vector.

    Left out: a null id, a null or empty or all-zero vector, and one with a null
    or non-finite component.
    """
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & fine).select(
        "vec_id", "embedding", F.size("embedding").alias("d"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2")
    )


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(h1, h2, rep, ids): the k + 1 least ids of each distinct vector of ``rows`` (vec_id, h1, h2), the least of which is ``rep``."""
    # Within a salt first, so that a vector that very many rows share is spread over tasks.
    salted = Window.partitionBy("h1", "h2", "salt").orderBy("vec_id")
    whole = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = (
        rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
        .withColumn("r", F.row_number().over(salted)).where(f"r <= {k + 1}")
        .withColumn("r", F.row_number().over(whole)).where(f"r <= {k + 1}")
    )
    ids = F.array_sort(F.collect_list("vec_id"))
    return few.groupBy("h1", "h2").agg(ids.alias("ids")).select("h1", "h2", F.get("ids", F.lit(0)).alias("rep"), "ids")


def build_index(distinct: DataFrame, dims: int, n: int) -> tuple[DataFrame, np.ndarray]:
    """The coded entries (rep, embedding) and the common centre, which is fitted on a bounded sample; every entry is coded."""
    chosen = F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(n, 1)))
    sums = distinct.where(chosen).select(F.posexplode("embedding")).groupBy("pos").agg(F.avg("col").alias("m")).collect()
    centre = np.zeros(dims)
    for row in sums:
        centre[row["pos"]] = row["m"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims)  # in the task: on the driver no linear algebra runs beside the JVM
        for batch in batches:
            if batch.num_rows:
                words, length, fit = encode(_matrix(batch.column(1), dims), centre, turn)
                yield pa.record_batch(
                    [*batch.columns, pa.array([w.tobytes() for w in words], pa.binary()), pa.array(length), pa.array(fit)],
                    names=["rep", "embedding", "code", "length", "fit"],
                )

    kind = distinct.schema["embedding"].dataType.simpleString()
    files = max(1, math.ceil(n / INDEX_ROWS))
    coded = distinct.select("rep", "embedding").mapInArrow(code, f"rep long, embedding {kind}, code binary, length double, fit double")
    return coded.repartition(files, "rep"), centre


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def search(index: DataFrame, queries: DataFrame, centre: np.ndarray, dims: int, k: int) -> DataFrame:
    """(q, rep, score): each task's best ``k`` entries for the queries (q, embedding), of which there are few enough to send."""
    asked = queries.toArrow()
    sent = index.sparkSession.sparkContext.broadcast((asked["q"].to_numpy(), _matrix(asked["embedding"].combine_chunks(), dims)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = sent.value
        ask, best = Queries(vectors, centre, rotation(dims)), Best(len(names), k)
        for whole in batches:
            for start in range(0, whole.num_rows, INDEX_STEP):
                batch = whole.slice(start, INDEX_STEP)
                words = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                codes = Codes(words, batch.column(3).to_numpy(), batch.column(4).to_numpy(), dims)
                scan(codes, _matrix(batch.column(1), dims), batch.column(0).to_numpy(), ask, best)
        for start in range(0, len(names), 4096):
            part = range(start, min(start + 4096, len(names)))
            counts = [len(best.ids[q]) for q in part]
            yield pa.record_batch(
                [pa.array(np.repeat(names[part.start : part.stop], counts)), pa.array(np.concatenate([best.ids[q] for q in part])),
                 pa.array(np.concatenate([best.scores[q] for q in part]))],
                names=["q", "rep", "score"],
            )

    return index.mapInArrow(run, "q long, rep long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS) -> DataFrame:
    """The ``k`` nearest rows found for each row of ``vectors`` (vec_id, embedding) that ``is_query`` marks.

    Columns query_id, rank (from 1), vec_id, score: the inner product of the
    original vectors in double precision, ties to the smaller id; the query's own
    id is left out. Rows that share an id are one; should their vectors differ,
    one of them, the same on every run, counts. A vector meets those of its own length. See :func:`usable` for rows that take no part. Other columns
    are ignored, but for such that ``is_query`` reads. Without rows the result is empty.
    """
    spark = vectors.sparkSession
    marked = vectors.select("vec_id", "embedding", F.coalesce(is_query.cast("boolean"), F.lit(False)).alias("asks"))
    asking = usable(marked.where("asks"))
    rows = usable(marked)
    out = spark.createDataFrame([], EMPTY)
    for length in rows.groupBy("d").count().collect():  # as a rule one
        dims, own = length["d"], F.col("d") == length["d"]
        found = _nearest(rows.where(own), asking.where(own), dims, length["count"], k)
        out = out.union(found)
    return out


def _nearest(rows: DataFrame, asking: DataFrame, dims: int, n: int, k: int) -> DataFrame:
    # One vector for each id.
    chosen = keep(rows.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("vec_id", "h.h1", "h.h2"), "chosen")
    known = keep(entries(chosen, k), "entries")
    vector = rows.select("h1", "h2", "embedding", F.col("vec_id").alias("rep"))
    distinct = keep(vector.join(known.select("h1", "h2", "rep"), ["h1", "h2", "rep"]).dropDuplicates(["h1", "h2"]), "distinct")
    coded, centre = build_index(distinct, dims, n)
    index = keep(coded, "index")
    asked = keep(
        chosen.join(asking.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "h1", "h2").join(known.select("h1", "h2", F.col("rep").alias("q")), ["h1", "h2"])
        .select("query_id", "q", "h1", "h2"), "queries",
    )
    different = asked.select("q", "h1", "h2").distinct()
    groups = max(1, math.ceil(different.count() * dims / GROUP_VALUES))
    group = F.pmod(F.xxhash64("q", "h1"), F.lit(groups)).cast("int").alias("g")
    queries = keep(distinct.join(different, ["h1", "h2"]).select(group, "q", "embedding").repartition("g"), "asked") if groups > 1 else (
        distinct.join(different, ["h1", "h2"]).select(F.lit(0).alias("g"), "q", "embedding")
    )
    near = None
    for g in range(groups):
        part = search(index, queries.where(F.col("g") == g).select("q", "embedding"), centre, dims, k + 1)
        part = keep(part, "near") if groups > 1 else part
        near = part if near is None else near.union(part)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    top = near.withColumn("r", F.row_number().over(best)).where(f"r <= {k + 1}")
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    wide = top.join(known.select("rep", "ids"), "rep").select("q", F.explode("ids").alias("vec_id"), "score").dropDuplicates(["q", "vec_id", "score"])
    ranked = keep(wide.withColumn("r", F.row_number().over(by_id)).where(f"r <= {k + 1}"), "ranked")
    # The ranks of a query follow from those of its entry: its own id moves those behind it up.
    own = asked.select("query_id", "q").join(ranked, "q").where("query_id <> vec_id")
    by_query = Window.partitionBy("query_id", "q").orderBy("r")
    return own.withColumn("rank", F.row_number().over(by_query)).where(f"rank <= {k}").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
