"""Search: terms, the kept-up index, proximity, typos, excerpts; each against brute force."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import excerpts
from lumenfold.operators import search, terms
from lumenfold.operators.segments import FAN, Index
from lumenfold.plans import archive_queries
from lumenfold.sources.store import Store

DOCS = "id string, title string, filename string, domain string, content string"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(str(i), t, "f", "d", c) for i, t, c in rows], DOCS)


def ranks(where, query):
    return {r["id"]: tuple(r[c] for c in ("words", "typos", "gaps", "field", "exact")) for r in search.ranked(where, query).collect()}


def test_terms_and_positions(spark):
    texts = {1: "Ab c1-d", 2: "我在北京x", 3: "北 京ab 京", 4: None, 5: "", 6: "İstanbul É"}
    rows = spark.createDataFrame(list(texts.items()), "k int, t string").select("k", terms.terms_of("t").alias("x")).collect()
    got = {r["k"]: [(t["term"], t["pos"]) for t in r["x"]] for r in rows}
    assert got[1] == [("ab", 0), ("c1", 1), ("d", 2)] and got[4] == got[5] == []
    assert sorted(got[2]) == sorted([("我", 0), ("在", 1), ("北", 2), ("京", 3), ("x", 4), ("我在", 0), ("在北", 1), ("北京", 2)])
    assert sorted(got[3]) == sorted([("北", 0), ("京", 1), ("ab", 2), ("京", 3)])
    assert [p for _, p in got[6]] == [0, 1]
    assert terms.query_terms("我在 北 Quick-fox") == ["我在", "北", "quick", "fox"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_near_terms_equal_comparing_every_term(spark):
    held = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(terms.terms_of("text")).alias("t")).select("t.term").distinct()
    strange = ["a", "abcd", "x" * 31, "x" * 32, "x" * 33, "x" * 31 + "yz", "x" * 200, "ément", "漢字漢字漢", "aaaaa", "aaaa", "aaaaaa", "abababab", "bababab"]
    table = held.union(spark.createDataFrame([(t,) for t in strange], "term string"))
    near = terms.neighbourhood(table)
    draw = random.Random(3)
    known = [r[0] for r in table.orderBy("term").collect()]
    wanted = [["there", "tionthere", "th"], ["x" * 32, "aaaaa", "x" * 198], ["émant", "abababb", "x" * 33]]
    for _ in range(3):
        changed = []
        for _ in range(4):
            word = list(draw.choice(known))
            for _ in range(draw.randint(0, 2)):
                at = draw.randrange(len(word))
                word[at : at + draw.randint(0, 1)] = draw.choice([[], ["e"], ["q", "r"]])
            changed.append("".join(word) or "e")
        wanted.append(changed)
    for words in wanted:
        want = {tuple(r) for r in terms.matching_terms(table, words).select("term", "no", "typos", "exact").collect()}
        assert {tuple(r) for r in terms.near_terms(near, table, words).select("term", "no", "typos", "exact").collect()} == want


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_grouped_document_by_document(spark):
    texts = {1: ("b a", "a b a"), 2: (None, "c 北京 c"), 3: ("", ""), 4: ("x", None)}
    rows = terms.blocks(docs_of(spark, [(k, *v) for k, v in texts.items()]), ("title", "content"))
    got = {(r["id"], r["field"], r["term"]): (list(r["positions"]), r["first"]) for r in rows.collect()}
    assert got == {
        ("1", 0, "a"): ([1], True), ("1", 0, "b"): ([0], True), ("1", 1, "a"): ([0, 2], False), ("1", 1, "b"): ([1], False), ("2", 1, "c"): ([0, 3], True),
        ("2", 1, "北"): ([1], True), ("2", 1, "京"): ([2], True), ("2", 1, "北京"): ([1], True), ("4", 0, "x"): ([0], True),
    }
    # The texts are dealt once; no task sorts or groups the tokens of many documents, nor are they shuffled to find those that match.
    for table in (rows.select("*"), search.hits_of(docs_of(spark, [(1, "a", "b")]), ["there", "the"])):
        plan = plan_of(table)
        assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan and "Join" not in plan


def test_a_term_has_five_pieces_at_most(spark):
    held = ["abc", "abcd", "abcdefg", "abcdefghi", "abcdefghij", "x" * 31, "x" * 500]
    counts = {r["term"]: r["count"] for r in terms.neighbourhood(spark.createDataFrame([(t,) for t in held], "term string")).groupBy("term").count().collect()}
    assert counts == {"abcd": 2, "abcdefg": 5, "abcdefghi": 5, "abcdefghij": 3, "x" * 31: 3, "x" * 500: 3}


def test_gaps_are_least_over_all_positions(spark):
    draw = random.Random(1)
    rows = [(k, " ".join(draw.choices(["alpha", "beta", "x", "y"], k=draw.randint(0, 6))), " ".join(draw.choices(["alpha", "beta", "x", "y", "z", "w"], k=draw.randint(0, 40)))) for k in range(60)]
    got = ranks(docs_of(spark, rows), "alpha beta")
    for k, title, content in rows:
        places = [[i for i, w in enumerate(t.split()) if w == word] for t in (title, content) for word in ("alpha", "beta")]
        if not (places[0] or places[2]):
            assert str(k) not in got
            continue
        gap = min([8, *(abs(a - b) for f in (0, 2) for a in places[f] for b in places[f + 1])])
        both = bool(places[1] or places[3])
        assert got[str(k)][0] == 1 + both and got[str(k)][2] == (gap if both else 0)


def test_index_kept_up_equals_one_built_anew(spark, tmp_path):
    draw, held, stored = random.Random(7), {}, Store(spark, str(tmp_path))
    index = Index(stored)
    text = lambda: " ".join(draw.choices(["alpha", "beta", "gamma", "alpine", "betas", "北京", "delta"], k=draw.randint(0, 12)))
    change = lambda ids: {i: (text(), text()) for i in ids}
    first = change(range(20))
    index.build(docs_of(spark, [(i, *v) for i, v in first.items()]))
    held |= first
    merged = []
    for k in range(FAN + 2):
        before = {p: stored.read(index.postings, parts=[p]).inputFiles() for p in stored.parts(index.postings)}
        new = change(draw.sample(range(40), 3))
        index.add(docs_of(spark, [(i, *v) for i, v in new.items()]))
        held |= new
        after = {p: stored.read(index.postings, parts=[p]).inputFiles() for p in stored.parts(index.postings)}
        assert len(after) == len(before) + 1 and all(after[p] == f for p, f in before.items())  # only its own postings
        if k % 3 == 1:
            gone = draw.sample(sorted(held), 2)
            index.remove(spark.createDataFrame([(str(i),) for i in gone], "id string"))
            held = {i: v for i, v in held.items() if i not in gone}
        if k == FAN:
            merged = index.merge()
    assert len(merged) >= FAN and not set(merged) & set(stored.parts(index.postings))
    anew = Index(Store(spark, str(tmp_path / "anew")))
    anew.build(docs_of(spark, [(i, *v) for i, v in held.items()]))
    docs = docs_of(spark, [(i, *v) for i, v in held.items()])
    for query in ("alpha beta", "alphb", "北京 gamma", "alp", "nothing", "betaz delta"):
        assert ranks(index, query) == ranks(anew, query) == ranks(docs, query)
    shown = lambda where: [tuple(r) for r in search.search(docs, "alpha beta", index=where).collect()]
    assert shown(index) == shown(None) == shown(anew)


def test_index_is_smaller_than_its_text(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), *[F.lit("").alias(c) for c in ("title", "filename", "domain")], F.col("text").alias("content"))
    index = Index(Store(spark, str(tmp_path)))
    index.build(docs)
    size = sum(f.stat().st_size for f in (tmp_path / index.postings).rglob("*.parquet"))
    assert size < docs.agg(F.sum(F.octet_length("content"))).first()[0]
    plan = index.hits(index.matches(["there"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_a_segments_tasks_sort_their_own_postings(spark, tmp_path, monkeypatch):
    """However much is added, a task sorts the tokens of ``TEXT_PER_FILE`` bytes, and tokens are not shuffled."""
    monkeypatch.setattr("lumenfold.operators.segments.TEXT_PER_FILE", 2000)
    index = Index(Store(spark, str(tmp_path)))
    index.build(docs_of(spark, [(k, "alpha", f"beta {'gamma ' * 20}x{k}") for k in range(100)]))
    rows = index.store.read(index.postings).select("term", "doc", F.input_file_name().alias("file"))
    assert rows.groupBy("doc").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0
    assert 5 <= rows.select("file").distinct().count() <= 9 and rows.count() == 100 * 7
    for file in rows.inputFiles():
        held = [r["term"] for r in spark.read.parquet(file).select("term").collect()]
        assert held == sorted(held)


def test_a_streams_batch_is_indexed_once(spark, tmp_path):
    index = Index(Store(spark, str(tmp_path)))
    for number in (0, 1, 1, 0):
        index.add(docs_of(spark, [(number, "alpha", "x")]), key=("s", number))
    assert set(ranks(index, "alpha")) == {"0", "1"} and len(index.store.parts(index.postings)) == 2


def test_pieces_of_a_text():
    assert excerpts.pieces_of("-ab, 北京c ", ["ab", "北", "京", "c"]) == (["-", "ab", ", ", "北", "京", "c", " "], [False, True, False, True, True, True, False])
    assert excerpts.pieces_of("", []) == ([], []) and excerpts.pieces_of("--", []) == (["--"], [False])


@pytest.mark.parametrize("seed", range(5))
def test_windows(seed):
    draw = random.Random(seed)
    for _ in range(200):
        n, words = draw.randint(0, 60), draw.randint(1, 20)
        matches = sorted({(draw.randrange(n), draw.randrange(3), 1) for _ in range(draw.randint(0, 12))}) if n else []
        a, b = excerpts.window(n, matches, words)
        assert (a, b) == (0, n) if n <= words else 0 <= a and b == a + words <= n
        distinct = lambda s: len({w for p, w, _ in matches if s <= p < s + words})
        if n > words:
            assert distinct(a) == max(distinct(s) for s in range(n - words + 1))


def test_excerpts_of_glued_text_other_scripts_and_typos(spark):
    glued = ".".join(["filler"] * 400 + ["markett", "北京"] + ["filler"] * 400)
    docs = docs_of(spark, [(1, "t", glued), (2, "t", "我在北京大学读书 and the markets"), (3, "t", "market!market-place"), (4, "market", None)])
    got = {r["id"]: r for r in search.search(docs, "北京 market").collect()}
    tag = lambda x: f"{search.OPEN_TAG}{x}{search.CLOSE_TAG}"
    assert got["2"]["content"] == f"我在{tag('北京')}大学读书 and the {tag('markets')}"
    assert [(s["start"], s["length"]) for s in got["2"]["spans"]] == [(2, 2), (17, 7)]
    cut = got["1"]["content"]
    assert cut.startswith("…filler") and cut.endswith("filler…") and f"{tag('markett')}.{tag('北京')}" in cut and len(re.findall(r"\w+", re.sub("<[^>]*>", "", cut.replace("北京", "北 京")))) == 150
    only = {r["id"]: r["content"] for r in search.search(docs, "market").collect()}
    assert only["3"] == f"{tag('market')}!{tag('market')}-place" and only["4"] == ""


@pytest.mark.parametrize("wanted", [["北京", "there"], ["there", "北"], ["the", "it", "京"], ["ςigmaσς", "kelvinist"], ["i̇zmir", "straße"], ["marketplaces", "marke", "京a"]])
def test_crops_are_the_excerpts_of_all_matches(spark, wanted):
    draw = random.Random(7)
    some = ["there", "thre", "tHere", "Theirs", "ethere", "therefore", "it", "It", "the", "北京", "北", "京", "ΣΙΓΜΑΣΣ", "σιγμασς", "ΣIGMAΣΣ", "\u212aelvinists", "kelvnst", "İZMİR", "Izmir", "STRASSE", "straẞe",
            "marketplace", "arketplace", "market", "𝐚𝟘", "\U0002000b", "々〇", "í", "i\u0307", "_", "ー", "한국", "x" * 40]
    texts = [draw.choice(["", " ", "-", "\n"]).join(draw.choices(some, k=draw.choice([0, 1, 5, 60, 700]))) for _ in range(150)]
    texts += [None, "", "\n", " there", "there ", "北", "filler " * 400 + "there" + " filler" * 100 + " 北京 there" + " filler" * 400]
    docs = docs_of(spark, [(k, "there 北京", t) for k, t in enumerate(texts)]).select("id", "title", "content")
    hits = search.matched(search.blocks(docs, ("content",)).withColumn("field", F.lit(search.FIELDS.index("content"))), wanted)
    expected = {r["id"]: (r["excerpt"], r["spans"]) for r in search.excerpted(docs, hits).collect()}
    got = search.cropped(docs, wanted)
    assert got.columns == ["id", "title", "excerpt", "spans"] and {r["id"]: (r["excerpt"], r["spans"]) for r in got.collect()} == expected
    assert sum(len(s) for _, s in expected.values()) > 20


def test_crops_deal_texts_once_and_make_no_rows_of_tokens(spark):
    plan = archive_queries.search_crop(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Generate" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_json_page(spark):
    docs = docs_of(spark, [(1, 'a "quoted" <b>', "market & co"), (2, "t", "market")])
    text = search.json_page(search.search(docs, "market")).first()[0]
    page = json.loads(text)
    assert len(page) == 10 and page[0]["id"] and page[2] == dict.fromkeys(("id", "title", "filename", "content", "domain"), "")
    assert "\n" not in text and "\\u003cb\\u003e" in text and 'a "quoted" <b>' in {x["title"] for x in page} and "\\u0026" in text
