"""MinHash near-duplicate detection with tensored banding.

A classical banding scheme with L tables of r rows computes L * r minhashes.
Here two small collections of band hashes are computed, and each of the tables
is keyed by one *pair* of them: ``LEFT`` hashes of two rows and ``RIGHT`` hashes
of one row give LEFT * RIGHT = 96 tables of three rows from 32 minhashes rather
than 288. Two texts of similarity s share a key unless all left hashes or all
right hashes differ, so a link of similarity 0.75 is missed with probability
(1 - 0.75^2)^12 + (1 - 0.75)^8 = 6.4e-5, and closer ones far less often.

Keys only propose candidates. A link exists where the exact shingle sets have
100 * |A n B| >= 75 * |A u B|.

* Equal sets are one class from the start: copies never meet as pairs.
* A document's shingles that no other candidate document has are counted. What
  is left bounds its intersection with any other, so a pair that cannot reach
  the threshold is dropped within the join that would form it. This is exact,
  and it is what keeps large groups of loose copies from forming all pairs.
* Round 1 compares every member of a key's bucket with the bucket's most shared
  member, as a rule the text that the others were copied from.
* Documents of buckets that still hold several components go on to an exact
  prefix filter: two similar sets share a shingle among the rarest quarter of
  each, and its places in both bound their intersection. Its buckets, one per
  such shingle, are compared pivot by pivot across components, in doubling
  rounds, until every member has been a pivot. So each candidate pair is either
  ruled out, verified or already connected; none is capped away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.common import hot_keys, mix64, salted_join, slices, texts_of
from lumenfold.llm.components import components
from lumenfold.session import discard, keep

SHINGLE = 5
PERCENT = 75
LEFT, RIGHT = 12, 8
#: Members that the first later round takes as pivots of a bucket; each next one takes twice as many.
PIVOTS = 32
#: Bytes kept of each shingle's hash in the sets that confirm links.
SET_BYTES = 8
#: Bits of the filter that says which documents' sets are needed at all.
FILTER_BITS = 1 << 25
_VOCABULARY = 200_000

_rng = np.random.default_rng(20240901)
_MULTIPLY = _rng.integers(1, 2**63, 2 * LEFT + RIGHT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, 2 * LEFT + RIGHT, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    rolled = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        rolled = rolled * _BASE + hashes[k : len(words) - width + 1 + k]
    return np.unique(mix64(rolled))


def _minhashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(len(_ADD), np.uint64(2**64 - 1))
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096]
        out = np.minimum(out, (part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1))
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHashes()
    for part in slices(batches, "text"):
        sizes, keys, left, right = [], [], [], []
        for text in texts_of(part, "text"):
            shingles = shingle_hashes(text, known)
            sizes.append(len(shingles))
            if not len(shingles):
                keys.append(None), left.append(None), right.append(None)
                continue
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            low = _minhashes(shingles)
            left.append(mix64(low[:LEFT] * _BASE + low[LEFT : 2 * LEFT]).view(np.int64))
            right.append(low[2 * LEFT :].view(np.int64))
        yield pa.record_batch(
            [
                part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64())),
            ],
            names=["doc_id", "text_hash", "n_shingles", "set_key", "left", "right"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """A hash of the text, set size, a 128-bit key of the set and the two hash collections of each document."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _signatures,
        "doc_id long, text_hash long, n_shingles long, set_key binary, left array<long>, right array<long>",
    )


def _bit(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(13), doc_id), F.lit(FILTER_BITS))


def _wanted_bits(ids: DataFrame) -> np.ndarray:
    """A fixed-size bit filter of the ids: 4 MB, whatever their number.

    As it fills up it lets more documents through, which the later join drops;
    it never loses one.
    """
    bit = _bit("rep")
    found = ids.select(F.shiftright(bit, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("word"))
    got = found.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # FILTER_BITS / 64 rows at most
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[got.column("at").to_numpy()] = got.column("word").to_numpy()
    return words


def _sets(spark: SparkSession, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, shingles) for the wanted ids: sorted hashes, packed; a row per rep, however often it is repeated."""
    filled = spark.sparkContext.broadcast(_wanted_bits(ids))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = _WordHashes(), filled.value
        for part in slices(batches, "text"):
            bit = part.column(2).to_numpy()
            part = part.filter(pa.array(words[bit >> 6] >> (bit & 63) & 1 == 1))
            if part.num_rows:
                rows = [_pack(shingle_hashes(text, known)) for text in texts_of(part, "text")]
                yield pa.record_batch([part.column(0), pa.array(rows, pa.binary())], names=["rep", "shingles"])

    narrow = docs.where("doc_id is not null").select("doc_id", "text", _bit("doc_id").alias("bit"))
    found = narrow.mapInArrow(packed, "rep long, shingles binary").join(ids, "rep", "left_semi")
    return found.groupBy("rep").agg(F.max("shingles").alias("shingles"))


def _pack(shingles: np.ndarray) -> bytes:
    return np.ascontiguousarray(shingles.byteswap().view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // SET_BYTES, 8), np.uint8)
    wide[:, 8 - SET_BYTES :] = np.frombuffer(packed, np.uint8).reshape(-1, SET_BYTES)
    return wide.view(">u8").ravel().astype(np.uint64)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        reps = batch.column(0).to_numpy()
        rows = [_unpack(x) for x in batch.column(1).to_numpy(zero_copy_only=False)]
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            owner = np.repeat(reps[k : k + 256], [len(x) for x in part])
            yield pa.record_batch([pa.array(np.concatenate(part).view(np.int64)), pa.array(owner)], names=["shingle", "rep"])


def _shared_sizes(sets: DataFrame) -> DataFrame:
    """(rep, n, c): a set's size, and how many of its shingles some other set has too."""
    alone = (
        sets.mapInArrow(_spread, "shingle long, rep long").groupBy("shingle").agg(F.count("*").alias("df"), F.min("rep").alias("rep"))
        .where("df = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    )
    n = (F.length("shingles") / SET_BYTES).cast("long")
    return sets.select("rep", n.alias("n")).join(alone, "rep", "left").select(
        "rep", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("c")
    )


def _prefixes(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, rep, n, at): the rarest shingles of each wanted set that others share, and their places.

    Shingles are ordered by frequency among the wanted sets; those of a single
    set come first and only move the others' places. A set of n shingles that is
    similar to another one shares one of its first n / 4 + 1 with it.
    """
    rows = keep(sets.join(wanted, "rep", "left_semi").select("rep", "shingles").mapInArrow(_spread, "shingle long, rep long"), "shingles")
    shared = keep(rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    hot = hot_keys(shared.select("shingle", F.col("df").alias("n")), ["shingle"])
    n = rows.groupBy("rep").agg(F.count("*").alias("n"))
    order = Window.partitionBy("rep").orderBy("df", "shingle")
    mine = salted_join(rows, shared, ["shingle"], hot, ["rep"]).withColumn("place", F.row_number().over(order) - 1).withColumn(
        "held", F.count("*").over(Window.partitionBy("rep"))
    )
    placed = mine.join(n, "rep").withColumn("at", F.col("place") + F.col("n") - F.col("held"))
    return placed.where(f"100 * at <= {100 - PERCENT} * n").select(F.col("shingle").alias("key"), "rep", "n", "at")


def _numbered(members: DataFrame) -> DataFrame:
    """``members`` with a ``rank`` from 0 within each key, and salt and salts: into which of how many parts a frequent key deals a row."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    hot = hot_keys(sizes, ["key"])
    if hot is None:
        whole = Window.partitionBy("key").orderBy("at", "rep")
        return members.select("*", F.lit(1).alias("salts"), F.lit(0).alias("salt"), (F.row_number().over(whole) - 1).alias("rank"))
    salts = F.coalesce("salts", F.lit(1))
    dealt = members.join(F.broadcast(hot), "key", "left").withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    before = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.where("salts > 1").groupBy("key", "salt").agg(F.count("*").alias("rows")).select(
        "key", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift")
    )
    local = dealt.withColumn("local", F.row_number().over(Window.partitionBy("key", "salt").orderBy("at", "rep")) - 1)
    # The parts of hot keys are twice HOT_KEYS at most.
    return local.join(F.broadcast(shifts), ["key", "salt"], "left").withColumn("rank", F.col("local") + F.coalesce("shift", F.lit(0))).drop("local", "shift")


def _possible(n1: str, c1: str, n2: str, c2: str) -> Column:
    """Whether two sets of sizes n, of which c are shared at all, can be similar enough."""
    most = F.least(c1, c2)
    return 100 * most >= PERCENT * (F.col(n1) + F.col(n2) - most)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep_rows, last, held = [], None, None
        for one, other in zip(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)), strict=True):
            if one != last:
                last, held = one, _unpack(one)
            theirs = _unpack(other)
            merged = np.concatenate([held, theirs])
            merged.sort()
            common = int((merged[1:] == merged[:-1]).sum())
            keep_rows.append(100 * common >= PERCENT * (len(held) + len(theirs) - common))
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep_rows, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough; the pairs of a frequent member are dealt over tasks."""
    pairs = keep(pairs.distinct(), "pairs")
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b"))
    often = lambda side: hot_keys(pairs.groupBy(side).agg(F.count("*").alias("n")), [side])
    met = salted_join(salted_join(pairs, left, ["a"], often("a"), ["b"]), right, ["b"], often("b"), ["a"])
    return met.select("a", "b", "of_a", "of_b").mapInArrow(_confirm, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id, kept, text_hash.

    Null and empty texts, and texts without a word, have an empty set and link
    with nothing. Rows that share a doc_id are repeats of one document; should
    their texts differ, each gets the group of its own text. A row without doc_id
    links with nothing: its component_id is null and it is kept. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = keep(signatures(docs), "signatures")
    usable = signed.where("doc_id is not null and set_key is not null")
    classes = keep(
        usable.groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("left").alias("left"), F.first("right").alias("right")
        ),
        "classes",
    )
    reps = keep(classes.select("set_key", "rep", "n"), "reps")
    pairs_of_hashes = F.flatten(
        F.transform("left", lambda x, i: F.transform("right", lambda y, j: F.xxhash64(x, y, i * RIGHT + j)))
    )
    keyed = classes.select("rep", F.explode(pairs_of_hashes).alias("key"))
    shared = keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    hot = hot_keys(shared, ["key"])
    proposed = keep(salted_join(keyed, shared.select("key"), ["key"], hot, ["rep"]), "proposed")
    discard(classes)
    sets = keep(_sets(spark, docs, proposed.select("rep").distinct()), "sets")
    sizes = keep(_shared_sizes(sets).where(f"100 * c >= {PERCENT} * n"), "sizes")
    buckets = keep(proposed.join(sizes, "rep"), "buckets")
    discard(proposed)

    first = F.struct((F.col("c") / F.col("n")).alias("share"), (-F.col("rep")).alias("least"), "rep", "n", "c")
    pivot = buckets.groupBy("key").agg(F.max(first).alias("p"), F.count("*").alias("m")).where("m > 1").select(
        "key", F.col("p.rep").alias("a"), F.col("p.n").alias("na"), F.col("p.c").alias("ca")
    )
    pairs = salted_join(buckets, pivot, ["key"], hot, ["rep"]).where((F.col("rep") != F.col("a")) & _possible("n", "c", "na", "ca"))
    links = keep(_links(pairs.select("a", F.col("rep").alias("b")), sets), "links")
    groups = keep(components(links), "components")

    # Documents in buckets that still hold more than one component.
    component = F.coalesce("component", "rep").alias("component")
    labels = groups.select(F.col("node").alias("rep"), "component")
    open_keys = buckets.join(labels, "rep", "left").select("key", component).groupBy("key").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("m")
    ).where("c0 <> c1 and m > 2").select("key")
    still = keep(salted_join(buckets.select("key", "rep"), open_keys, ["key"], hot, ["rep"]).select("rep").distinct(), "open")
    discard(buckets)
    members = keep(_numbered(keep(_prefixes(sets, still), "prefixes")), "members")
    most = members.agg(F.max("rank")).first()[0] or 0
    done, width = 0, PIVOTS
    while done < most:
        labels = groups.select(F.col("node").alias("rep"), "component")
        now = members.join(labels, "rep", "left").withColumn("group", F.coalesce("component", "rep"))
        pivots = now.where(f"rank >= {done} and rank < {done + width}").select(
            F.col("key").alias("of"), F.col("rep").alias("a"), F.col("rank").alias("first"), F.col("n").alias("na"), F.col("at").alias("ata"),
            F.col("group").alias("ga"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("part"),
        )
        meet = (F.col("key") == F.col("of")) & (F.col("salt") == F.col("part"))
        across = meet & (F.col("rank") > F.col("first")) & (F.col("group") != F.col("ga"))
        # If this is the first shingle they share, the intersection is at most what follows in either.
        most_common = F.least(F.col("n") - F.col("at"), F.col("na") - F.col("ata"))
        reach = (100 + PERCENT) * most_common >= PERCENT * (F.col("n") + F.col("na"))
        pairs = now.join(pivots, across & reach).select("a", F.col("rep").alias("b"))
        found = keep(_links(pairs, sets), "links")
        if found.head(1):
            links = keep(links.union(found), "links")
            groups = keep(components(links), "components")
        done, width = done + width, 2 * width

    own = salted_join(usable.select("doc_id", "n_shingles", "set_key", "text_hash"), reps.select("set_key", "rep"), ["set_key"], hot_keys(reps, ["set_key"]), ["doc_id"])
    labelled = own.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), "text_hash"
    )
    for table in (sets, sizes, members, still):
        discard(table)
    alone = signed.where("doc_id is null or set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash")
    stays = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return labelled.union(alone).select("doc_id", "n_shingles", "component_id", stays.alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose document is the first of its group, with all their columns.

    A row goes by its doc_id and text: of one doc_id with two texts, one may go
    and the other stay. Rows without doc_id, text or words stay, as do repeats
    of a row that stays. An empty table stays empty.
    """
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_lf_id"), F.col("text_hash").alias("_lf_hash")).distinct()
    same = (F.col("doc_id").cast("long") == F.col("_lf_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_lf_hash"))
    return docs.join(gone, same, "left_anti")
