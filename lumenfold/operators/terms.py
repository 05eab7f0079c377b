"""Texts to terms with positions, and which terms match the words of a query.

A token is a run of letters and digits, or a single sign of a script without
spaces; positions count tokens. Beside each such sign the pair with the sign
right after it is a term too, at the position of the first.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.cropping import RUN, SIGN

FIELDS = ("id", "title", "filename", "domain", "content")
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
_OTHER = rf"[\p{{L}}\p{{N}}&&[^{_CJK}]]+"
_PLAIN = r"[\p{L}\p{N}]+"
_TOKEN = rf"[{_CJK}](?=([{_CJK}]?))|{_OTHER}"
#: Typo budgets with the least and most characters of the terms they can reach.
REACHED = {1: (4, 9), 2: (7, None)}


def _text(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("string"), F.lit(""))


def terms_of(text: Column | str) -> Column:
    """Array of struct(term, pos) of a text, in lower case."""
    text = _text(text)
    placed = lambda runs: F.transform(runs, lambda r, i: F.struct(F.lower(r).alias("term"), i.cast("int").alias("pos")))
    runs = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    follow = F.zip_with(runs, F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1)), lambda r, x: F.when(x != "", F.concat(r, x)))
    pairs = F.filter(F.transform(follow, lambda p, i: F.struct(F.lower(p).alias("term"), i.cast("int").alias("pos"))), lambda t: t["term"].isNotNull())
    # Most texts have no such sign, which their size tells if they are ASCII; the plain pattern is the faster one.
    signs = (F.octet_length(text) > F.length(text)) & text.rlike(f"[{_CJK}]")
    return F.when(signs, F.concat(placed(runs), pairs)).otherwise(placed(F.regexp_extract_all(text, F.lit(_PLAIN), F.lit(0))))


def tokens_of(text: Column | str) -> Column:
    """The tokens of a text as they stand there, in order."""
    return F.regexp_extract_all(_text(text), F.lit(_TOKEN), F.lit(0))


def character_kinds(spark: SparkSession) -> tuple[list[int], list[int]]:
    """Characters at which the kind of characters changes, and to which, as the JVM knows them that makes the terms: 0, ``RUN`` or ``SIGN``."""
    held, compiled = [*range(0xD800), *range(0xE000, 0x110000)], spark.sparkContext._jvm.java.util.regex.Pattern.compile
    none = compiled(rf"[^\p{{L}}\p{{N}}{_CJK}]").matcher("".join(map(chr, held))).replaceAll(" ")
    told = np.frombuffer(compiled(f"[{_CJK}]").matcher(none).replaceAll("\n").encode("utf-32-le"), np.uint32)
    kinds = np.zeros(0x110000, np.uint8)
    kinds[held] = np.where(told == ord(" "), 0, np.where(told == ord("\n"), SIGN, RUN))
    bounds = np.flatnonzero(np.diff(kinds, prepend=255))
    return bounds.tolist(), kinds[bounds].tolist()


def width(term: Column | str) -> Column:
    """How many tokens a term covers: two if it is a pair of signs."""
    term = F.col(term) if isinstance(term, str) else term
    return F.when(term.rlike(rf"^[{_CJK}]{{2}}$"), 2).otherwise(1)


def postings(documents: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "id") -> DataFrame:
    """(key, field, term, pos): one row per occurrence; field is its number in ``fields``."""
    each = F.array(*[F.struct(F.lit(k).alias("field"), terms_of(F.col(f)).alias("terms")) for k, f in enumerate(fields)])
    by_field = documents.select(F.col(key), F.explode(each).alias("f"))
    return by_field.select(key, "f.field", F.explode("f.terms").alias("t")).select(key, "field", "t.term", "t.pos")


def blocks(documents: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "id", tasks: int | None = None) -> DataFrame:
    """(key, field, term, positions, first): one row per term of a document's field, its positions ascending; ``first`` in the first field of the document that has the term.

    The texts are dealt by their key over ``tasks`` (or as many as Spark takes), once. Each document's tokens are
    sorted and cut into runs by themselves, so a task holds those of one document.
    """
    of = lambda k: lambda t: F.struct(t["term"].alias("term"), F.lit(k).alias("field"), t["pos"].alias("pos"))
    each = [F.transform(terms_of(F.col(f)), of(k)) for k, f in enumerate(fields)]
    # Exploding an array of one array makes a column of it, so that it is made once and not for every element it is asked for.
    dealt = documents.repartition(tasks, F.col(key)) if tasks else documents.repartition(F.col(key))
    held = dealt.select(F.col(key), F.explode(F.array(F.sort_array(F.concat(*each)))).alias("all"))
    whole, n = F.col("all"), F.size("all")
    at = lambda i: F.get(whole, i)
    begins = lambda i, *names: (i == 0) | reduce(lambda a, b: a | b, [at(i)[c] != at(i - 1)[c] for c in names])
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: begins(i, "term", "field"))).otherwise(F.array().cast("array<int>"))
    held = held.select(key, "all", F.explode(F.array(starts)).alias("starts"))
    ends = F.concat(F.slice("starts", F.lit(2), n), F.array(n))
    runs = F.filter(F.zip_with("starts", ends, lambda s, e: F.struct(
        at(s)["field"].alias("field"), at(s)["term"].alias("term"), F.transform(F.slice(whole, s + 1, e - s), lambda t: t["pos"]).alias("positions"), begins(s, "term").alias("first"),
    )), lambda r: r["field"].isNotNull())
    return held.select(key, F.explode(runs).alias("r")).select(key, "r.*")


def query_terms(query: str) -> list[str]:
    """A query's terms in order; a run of signs of a script without spaces gives its pairs, or the single sign."""
    cjk = _CJK.replace("Is", "")
    runs = regex.findall(rf"(?V1)[{cjk}]+|{_OTHER.replace('Is', '')}", query)
    whole = [[run[k : k + 2] for k in range(max(1, len(run) - 1))] if regex.match(f"[{cjk}]", run) else [run] for run in runs]
    return [t.lower() for run in whole for t in run]


def typo_budget(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def _matches_of(wanted: list[str]) -> Column:
    """Array of struct(no, typos, exact): the wanted words that column ``term`` matches; the last also as a prefix."""
    term, found = F.col("term"), []
    for no, want in enumerate(wanted):
        budget = typo_budget(want)
        distance = F.when(F.abs(F.length(term) - len(want)) <= budget, F.levenshtein(term, F.lit(want), budget))
        prefix = term.startswith(want) if no == len(wanted) - 1 else F.lit(False)
        typos = F.when((term == want) | prefix, 0).when(distance > 0, distance)
        found.append(F.struct(F.lit(no).alias("no"), typos.alias("typos"), (term == want).cast("int").alias("exact")))
    return F.filter(F.array(*found), lambda m: m["typos"].isNotNull())


def matched(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """``rows`` (term, ...) whose term matches, with no, typos, exact: once for each word it matches. Each row is judged where it is."""
    return rows.select("*", F.explode(_matches_of(wanted)).alias("_m")).select(*[f"`{c}`" for c in rows.columns], "_m.*")


def matching_terms(terms: DataFrame, wanted: list[str]) -> DataFrame:
    """(term, no, typos, exact) of the distinct terms that match the wanted ones; the last also matches as a prefix. Compares every term."""
    return matched(terms.select("term").distinct(), wanted)


def _piece(n, k: int, count: int):
    """Where piece k of ``count`` about equal ones begins in n characters (a number or a column)."""
    return F.floor(n * k / count).cast("int") if isinstance(n, Column) else n * k // count


def neighbourhood(terms: DataFrame) -> DataFrame:
    """(variant, term): hashes of the pieces of each term, two of terms that a word with one typo can reach and three for two typos.

    Of a term's k + 1 pieces at least one stands unchanged in every word within k
    edits, moved by k places at most. So a term has five rows at most, whatever
    its length.
    """
    term, n = F.col("term"), F.length("term")
    pieces = []
    for budget, (least, most) in REACHED.items():
        reached = (n >= least) & (n <= most if most else F.lit(True))
        for k in range(budget + 1):
            start, end = _piece(n, k, budget + 1), _piece(n, k + 1, budget + 1)
            pieces.append(F.when(reached, F.xxhash64(F.lit(budget), n, F.lit(k), F.substring(term, start + 1, end - start))))
    held = terms.select("term").repartition("term").distinct()
    return held.select(F.explode(F.array_compact(F.array(*pieces))).alias("variant"), "term")


def variants(word: str) -> list[tuple[int, int, int, str]]:
    """(budget, term's length, number of the piece, piece) of the terms' pieces that may stand in a word."""
    budget, found = typo_budget(word), set()
    for n in range(len(word) - budget, len(word) + budget + 1):
        for k in range(budget + 1):
            start, end = _piece(n, k, budget + 1), _piece(n, k + 1, budget + 1)
            for at in range(max(0, start - budget), min(start + budget, len(word) - (end - start)) + 1):
                found.add((budget, n, k, word[at : at + end - start]))
    return sorted(found)


def near_terms(near: DataFrame, terms: DataFrame, wanted: list[str]) -> DataFrame:
    """What :func:`matching_terms` finds, by equal pieces in place of comparing every term.

    ``near`` is the neighbourhood of ``terms`` (term, ...). Its candidates are
    verified by their distance. Equal terms and those with the last word as a
    prefix come from filters that the scan takes.
    """
    spark, last = terms.sparkSession, len(wanted) - 1
    asked = [(no, w, *v) for no, w in enumerate(wanted) if typo_budget(w) for v in variants(w)]
    equal = reduce(lambda a, b: a | b, [F.col("term") == w for w in wanted]) | F.col("term").startswith(wanted[last])
    # A query's own words and their pieces: their number depends on its length alone.
    few = spark.createDataFrame(asked, "no int, want string, budget int, n int, k int, v string").select("no", "want", "budget", F.xxhash64("budget", "n", "k", "v").alias("variant"))
    distance = F.levenshtein("term", "want")
    close = near.join(F.broadcast(few), "variant").where(F.abs(F.length("term") - F.length("want")) <= F.col("budget")).select("term", "no", "want", "budget").distinct()
    typed = close.withColumn("typos", distance).where((F.col("typos") > 0) & (F.col("typos") <= F.col("budget"))).select("term", "no", "typos", F.lit(0).alias("exact"))
    plain = terms.where(equal).select("term").distinct()
    each = F.array(*[
        F.struct(F.lit(no).alias("no"), ((F.col("term") == w) | (F.col("term").startswith(w) if no == last else F.lit(False))).alias("hit"), (F.col("term") == w).cast("int").alias("exact"))
        for no, w in enumerate(wanted)
    ])
    same = plain.select("term", F.explode(each).alias("m")).where("m.hit").select("term", "m.no", F.lit(0).alias("typos"), "m.exact")
    return same.union(typed).groupBy("term", "no").agg(F.min("typos").alias("typos"), F.max("exact").alias("exact"))
