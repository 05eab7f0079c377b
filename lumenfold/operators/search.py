"""Keyword search over documents: ranking, paging, excerpts.

Ranking is by rules in a fixed order: matched leading words, typos, distance of
the words, best field, exact matches, id. A search reads the distinct terms and
the postings of those that match; texts are read for the hits of one page only.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import cropping
from lumenfold.functions.excerpts import CLOSE_TAG, OPEN_TAG, excerpts
from lumenfold.operators.segments import Index
from lumenfold.operators.terms import FIELDS, blocks, character_kinds, matched, matching_terms, postings, query_terms, tokens_of, typo_budget, width  # noqa: F401 (matching_terms, postings: for callers)
from lumenfold.schemas import ArchiveError
from lumenfold.session import keep

HITS_PER_PAGE = 10
MOST_HITS = 1000
#: A gap between two matched words counts this much at most.
MOST_GAP = 8
_STATE = "struct<field:int,a:int,b:int,best:int>"


def _wanted(query: str) -> list[str]:
    if not (wanted := query_terms(query)):
        raise ArchiveError("query is empty")
    return wanted


def hits_of(documents: DataFrame | Index, wanted: list[str]) -> DataFrame:
    """(keys, no, typos, exact, term, field, positions) of all terms that match: from an index, or else from documents, made on the way."""
    if isinstance(documents, Index):
        return documents.hits(documents.matches(wanted))
    return matched(blocks(documents), wanted)


def least_gap(first: Column, second: Column) -> Column:
    """Least distance of a position of one word to one of the other in the same field, at most ``MOST_GAP``.

    Both are arrays of struct(field, positions). One pass over both in order:
    the nearest position of the other word is the last one seen, or the next.
    """
    tagged = lambda places, tag: F.flatten(
        F.transform(places, lambda p: F.transform(p["positions"], lambda x: F.struct(p["field"].alias("field"), x.alias("pos"), F.lit(tag).alias("tag"))))
    )
    both = F.array_sort(F.concat(tagged(first, 0), tagged(second, 1)))
    none = F.lit(None).cast("int")

    def step(state: Column, x: Column) -> Column:
        same = state["field"] == x["field"]
        a, b = F.when(same, state["a"]), F.when(same, state["b"])
        near = x["pos"] - F.when(x["tag"] == 0, b).otherwise(a)
        return F.struct(
            x["field"].alias("field"), F.when(x["tag"] == 0, x["pos"]).otherwise(a).alias("a"), F.when(x["tag"] == 1, x["pos"]).otherwise(b).alias("b"),
            F.least(state["best"], F.coalesce(near, F.lit(MOST_GAP))).alias("best"),
        ).cast(_STATE)

    start = F.struct(F.lit(-1).alias("field"), none.alias("a"), none.alias("b"), F.lit(MOST_GAP).alias("best")).cast(_STATE)
    return F.aggregate(both, start, step, lambda s: s["best"])


def ranked(documents: DataFrame | Index, query: str) -> DataFrame:
    """(id, words, typos, gaps, field, exact) of all documents that hold a leading part of the query; an index adds its own key.

    ``gaps`` sums the least distances of successive words over all their
    occurrences; one token may stand for two words, at distance 0.
    """
    wanted = _wanted(query)
    hits = hits_of(documents, wanted)
    keys, n = (documents.KEYS if isinstance(documents, Index) else ["id"]), len(wanted)
    of = lambda no, value: F.when(F.col("no") == no, value)
    place = F.struct(F.col("field").cast("int").alias("field"), "positions")
    wide = hits.groupBy(*keys).agg(*[
        column
        for no in range(n)
        for column in (
            F.min(of(no, F.col("typos"))).alias(f"typos{no}"), F.min(of(no, F.col("field"))).alias(f"field{no}"), F.max(of(no, F.col("exact"))).alias(f"exact{no}"),
            F.collect_list(of(no, place)).alias(f"places{no}"),
        )
    ])
    held = [reduce(lambda a, b: a & b, [F.col(f"typos{j}").isNotNull() for j in range(no + 1)]) for no in range(n)]
    total = lambda name: reduce(add, [F.when(h, F.col(f"{name}{k}")).otherwise(0) for k, h in enumerate(held)])
    gaps = reduce(add, [F.when(held[k + 1], least_gap(F.col(f"places{k}"), F.col(f"places{k + 1}"))).otherwise(0) for k in range(n - 1)], F.lit(0))
    found = wide.where(held[0]).select(
        *keys, reduce(add, [h.cast("int") for h in held]).alias("words"), total("typos").alias("typos"), gaps.alias("gaps"),
        F.least(*[F.when(h, F.col(f"field{k}")) for k, h in enumerate(held)], F.lit(len(FIELDS))).alias("field"), total("exact").alias("exact"),
    )
    return documents.named(found) if isinstance(documents, Index) else found


def totals(hits: DataFrame) -> DataFrame:
    """One row: total_hits, at most ``MOST_HITS``, and total_pages."""
    n = F.least(F.count("*"), F.lit(MOST_HITS))
    return hits.agg(n.alias("total_hits"), F.ceil(n / HITS_PER_PAGE).cast("long").alias("total_pages"))


def highlight(text: Column | str, pattern: str, before: str = OPEN_TAG, after: str = CLOSE_TAG) -> Column:
    """``text`` with every match of the pattern between two tags."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, f"({pattern})", f"{before}$1{after}")


def excerpted(documents: DataFrame, hits: DataFrame, name: str = "content") -> DataFrame:
    """``documents`` (id, ...) with ``excerpt`` and ``spans`` (no, start, length) of field ``name``, for the matches in ``hits``.

    The excerpt has at most 150 tokens: the window with most distinct words of
    the query, matched tokens marked, whatever stands between the tokens. Texts
    without a match are cut after the first 150.
    """
    own = hits.where(F.col("field") == FIELDS.index(name)).groupBy("id").agg(F.collect_list(F.struct("no", "positions", width("term").alias("width"))).alias("matches"))
    held = documents.repartition("id").join(own, "id", "left").select(*documents.columns, F.coalesce(name, F.lit("")).alias("_text"), tokens_of(name).alias("_tokens"), F.col("matches").alias("_matches"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields]
    return held.mapInArrow(excerpts, ", ".join([*kinds, "excerpt string", "spans array<struct<no:int,start:int,length:int>>"]))


def cropped(documents: DataFrame, wanted: list[str], name: str = "content") -> DataFrame:
    """``documents`` (id, ...) with ``excerpt`` and ``spans`` in place of field ``name``: those of :func:`excerpted` for all that matches the words.

    For many documents: the texts are dealt by id, once, and looked through where
    they are; no tokens, terms or matches are made rows of or leave their task.
    """
    others = [f for f in documents.schema.fields if f.name != name]
    kinds = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "excerpt string", "spans array<struct<no:int,start:int,length:int>>"]
    words, forms, signs = [(w, typo_budget(w)) for w in wanted], cropping.forms(wanted), character_kinds(documents.sparkSession)
    dealt = documents.repartition("id").select(*[F.col(f"`{f.name}`") for f in others], F.col(name).cast("string").alias("_text"))
    return dealt.mapInArrow(lambda batches: cropping.cropped(batches, cropping.Matcher(words, forms, *signs)), ", ".join(kinds))


def top_hits(documents: DataFrame | Index, query: str, page: int = 1) -> DataFrame:
    """The ranked hits of one page, best first, with rnk: ten rows at most."""
    if page < 1:
        raise ArchiveError("page numbers start at 1")
    skipped = (page - 1) * HITS_PER_PAGE
    order = [F.desc("words"), "typos", "gaps", "field", F.desc("exact"), "id"]
    size = min(HITS_PER_PAGE, max(0, MOST_HITS - skipped))
    top = ranked(documents, query).orderBy(*order).offset(skipped).limit(size)
    return keep(top.withColumn("rnk", F.monotonically_increasing_id() + F.lit(skipped + 1)), "top")


def search(documents: DataFrame, query: str, page: int = 1, index: Index | None = None) -> DataFrame:
    """The hits of one page in rank order: id, title, filename, content (cropped, highlighted), domain, rnk, spans.

    The ten ids go into the scan of the documents, and their keys into that of
    the index; nothing else is read again. ``spans`` are the matches in the
    stored content as (no of the word, start, length).
    """
    top = top_hits(index or documents, query, page)
    ids = [r["id"] for r in top.select("id").collect()]  # ten at most
    page_docs = documents.where(F.col("id").isin(ids)) if ids else documents.limit(0)
    wanted = _wanted(query)
    hits = index.hits(index.matches(wanted), top) if index else hits_of(page_docs, wanted)
    cut = excerpted(page_docs.select("id", "title", "filename", "content", "domain"), hits).join(F.broadcast(top.select("id", "rnk")), "id")
    return cut.select("id", "title", "filename", F.col("excerpt").alias("content"), "domain", "rnk", "spans").orderBy("rnk")


def shown(hits: DataFrame) -> DataFrame:
    """Hits with something to show; those with empty content are hidden."""
    return hits.where(F.coalesce("content", F.lit("")) != "")


def padded(hits: DataFrame, page: int = 1) -> DataFrame:
    """A page of exactly ``HITS_PER_PAGE`` rows: places without a hit have empty columns, lists among them too."""
    first = (page - 1) * HITS_PER_PAGE + 1
    places = hits.sparkSession.range(first, first + HITS_PER_PAGE).select(F.col("id").alias("rnk"))
    empty = lambda kind: F.array().cast(kind) if kind.startswith("array") else F.lit("")
    return places.join(hits, "rnk", "left").select("rnk", *[F.coalesce(c, empty(kind)).alias(c) for c, kind in hits.dtypes if c != "rnk"]).orderBy("rnk")


def as_json(hits: DataFrame) -> DataFrame:
    """(rnk, json): each hit as a JSON object of its columns."""
    return hits.select("rnk", F.to_json(F.struct(*[c for c in hits.columns if c != "rnk"])).alias("json"))


def json_page(hits: DataFrame, page: int = 1, names: tuple[str, ...] = ("id", "title", "filename", "content", "domain")) -> DataFrame:
    """One row, one string: the page as a JSON array of ten objects, empty ones where there is no hit, indented by four spaces on a single line.

    In strings ``<``, ``>``, ``&`` and the two Unicode line separators are escaped.
    """
    def written(name: str) -> Column:
        whole = F.to_json(F.struct(F.col(name).cast("string").alias("v")))
        text = F.substring(whole, F.lit(6), F.length(whole) - 6)
        for sign in "<>&  ":
            text = F.replace(text, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
        return F.concat(F.lit(f'        "{name}": '), text)

    rows = padded(hits.select("rnk", *names), page)
    one = F.concat(F.lit("    {"), F.concat_ws(",", *[written(n) for n in names]), F.lit("    }"))
    every = rows.select("rnk", one.alias("json")).agg(F.array_sort(F.collect_list(F.struct("rnk", "json"))).alias("rows"))  # ten rows
    return every.select(F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["json"]), ","), F.lit("]")).alias("json"))


def typo_matches(places: DataFrame, term: str, budget: int, key: str = "id") -> DataFrame:
    """(key, term) of plain ASCII terms within ``budget`` edits of ``term``."""
    near = places.select("term").distinct().where(F.col("term").rlike("^[a-z0-9]+$") & F.levenshtein("term", F.lit(term), budget).between(0, budget))
    return places.join(near, "term").select(key, "term").distinct()


def word_hits(places: DataFrame, word: str, prefix: str, key: str = "id") -> DataFrame:
    """(key, words, tf): documents that hold ``word``, whether a term starts with ``prefix`` too, and the word's frequency."""
    matched = places.where((F.col("term") == word) | F.col("term").startswith(prefix))
    counted = matched.groupBy(key).agg(
        F.count_if(F.col("term") == word).alias("tf"), F.max(F.col("term").startswith(prefix).cast("long")).alias("prefixed")
    )
    return counted.where("tf > 0").select(key, (F.col("prefixed") + 1).alias("words"), "tf")
