"""Line deduplication by the spread of a line over sites.

One HyperLogLog sketch of sites per line hash is built on the map side and
merged by the aggregation. Lines whose estimate lies far above ``SITES`` are
boilerplate, lines far below are not, and lines near it get an exact distinct
count. Of each boilerplate line the first occurrence in the corpus stays (least
doc_id, then least position); all later ones go.

Joins on the line hash deal the occurrences of frequent lines over many tasks.

Everything runs as DataFrame functions. Only hashes and positions are shuffled
to find the lines; the texts move once, to meet the positions to remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import HOT_ROWS, hot_keys, salted_join
from lumenfold.session import keep

#: A line is boilerplate from this number of distinct sites on.
SITES = 3
#: Shorter lines ("Thanks.", "The end.") recur by chance and are left alone.
MIN_WORDS = 4
#: log2 of the sketch's registers: a standard error of 1.6 %.
LG_K = 12
#: Estimates within this many sites of the threshold, or this share, are counted exactly.
BAND, BAND_SHARE = 1.0, 0.1
SPACE = "\t\x0b\x0c\r "
_LONG_ENOUGH = r"^[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){%d}"


def _line(raw: Column) -> Column:
    return F.btrim(raw, F.lit(SPACE))


def _site(source: Column) -> Column:
    """A site's name; no source is a site unlike any other, also unlike an empty name."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source))


def _occurrences(docs: DataFrame) -> DataFrame:
    """One row per line that is long enough: where it is, its site and its 128-bit hash."""
    return (
        docs.select(
            "doc_id", _site(F.col("source")).alias("site"), F.xxhash64("text").alias("text_hash"),
            F.posexplode(F.split("text", "\n")).alias("pos", "raw"),
        )
        .select("doc_id", "site", "text_hash", "pos", _line(F.col("raw")).alias("line"))
        .where(F.col("line").rlike(_LONG_ENOUGH % (MIN_WORDS - 1)))
        .select("doc_id", "site", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    )


def boilerplate(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, first): hashes of the lines on ``SITES`` or more sites, and their first occurrence; and the frequent lines."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos")
    within = max(BAND, SITES * BAND_SHARE)
    counted = keep(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count("*").alias("n"), F.min(place).alias("first"))
        .where(F.col("n") >= SITES)
        .select("h1", "h2", "first", "n", F.hll_sketch_estimate("sketch").alias("sites"))
        .where((F.col("sites") >= SITES - within) | (F.col("n") >= HOT_ROWS)),
        "spread",
    )
    hot = hot_keys(counted, ["h1", "h2"])
    spread = counted.where(F.col("sites") >= SITES - within)
    near = F.col("sites") <= SITES + within
    exact = (
        salted_join(lines.select("h1", "h2", "site", "doc_id", "pos"), spread.where(near).select("h1", "h2", "first"), ["h1", "h2"], hot, ["doc_id", "pos"])
        .groupBy("h1", "h2", "site").agg(F.min("first").alias("first"))
        .groupBy("h1", "h2").agg(F.min("first").alias("first"), F.count("*").alias("exactly"))
        .where(F.col("exactly") >= SITES)
    )
    return keep(spread.where(~near).select("h1", "h2", "first").union(exact.select("h1", "h2", "first")), "boilerplate"), hot


def _cleaned(docs: DataFrame) -> DataFrame:
    """(row, text, n_lines, n_removed) of each row of ``docs``; ``row`` holds its columns under their own names."""
    plain = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    found = _occurrences(plain)
    lines, hot = boilerplate(found)
    removed = (
        salted_join(found.drop("site"), lines, ["h1", "h2"], hot, ["doc_id", "pos"])
        .where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
        .groupBy(F.col("doc_id").alias("id"), "text_hash").agg(F.collect_set("pos").alias("gone"))
    )
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.split(F.col("text").cast("string"), "\n").alias("lines"),
        F.xxhash64(F.col("text").cast("string")).alias("key"),
    )
    joined = held.join(removed, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_hash")), "left")
    lines, gone = F.col("lines"), F.col("gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(gone.isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return joined.select(
        "row", text.alias("text"), F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
    )


def _columns(names: list[str]) -> list[Column]:
    return [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated boilerplate lines removed from ``text``, and two counts.

    ``n_lines`` counts the lines of the original text and ``n_removed`` those
    taken out; the other columns stay, but for such that have one of these two
    names: the counts take their place. A null text stays null with 0 lines. A
    null source is a site of its own. An empty text is one empty line and never
    changes. Line order and the kept lines' own white space stay as they were.
    Rows without doc_id sort after all others for "first". Rows that share a
    doc_id and a text share their result. An empty table stays empty.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return _cleaned(docs).select(*_columns(names), "n_lines", "n_removed")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` after line removal, with all columns, without the documents that lost all their words by it."""
    bare = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _cleaned(docs).where(~F.coalesce(bare, F.lit(False))).select(*_columns(docs.columns))


ORACLE = r"""
with ls as (
  select doc_id, coalesce('+' || source, '-') site, string_split(text, chr(10)) parts from documents
), l as (
  select doc_id, site, unnest(parts) raw, unnest(range(len(parts))) pos from ls
), k as (
  select *, trim(raw, chr(9) || chr(11) || chr(12) || chr(13) || ' ') line from l
), long as (
  select * from k where regexp_matches(line, '^[^\x20\x09-\x0D]+([\x20\x09-\x0D]+[^\x20\x09-\x0D]+){3}')
), b as (
  select line, min(struct_pack(doc_id := doc_id, pos := pos)) first from long
  group by line having count(distinct site) >= 3
), gone as (
  select long.doc_id, long.pos from long join b using (line)
  where not (long.doc_id = b.first.doc_id and long.pos = b.first.pos)
), r as (
  select l.doc_id, count(*) n_lines, count(gone.pos) n_removed,
         coalesce(string_agg(case when gone.pos is null then l.raw end, chr(10) order by l.pos), '') txt
  from l left join gone on l.doc_id = gone.doc_id and l.pos = gone.pos group by l.doc_id
)
select d.doc_id, coalesce(r.n_lines, 0) n_lines, coalesce(r.n_removed, 0) n_removed,
       cast(length(r.txt) as bigint) n_chars, md5(r.txt) text_md5
from documents d left join r on d.doc_id = r.doc_id
"""
