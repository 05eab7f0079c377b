"""The training-data operators against brute force, round trips and held-out accuracy, with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import __spark_entry__  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from lumenfold.llm import ann, chat, common, language_id, line_dedup, mixing, near_dedup, packing, quality, token_files  # noqa: E402
from lumenfold.llm.token_files import EliasFano  # noqa: E402

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, rep string"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 2
ROWS = [
    (1, BASE, "en", "a", 1, 0, ""), (2, BASE, "en", "a", 1, 0, ""), (3, BASE.upper() + "omega", "en", "b", 1, 0, ""),
    (4, None, None, None, None, None, None), (5, "", "en", "b", 0, 0, ""), (6, " \n\t", None, "c", 0, 0, ""),
    (7, "two words", "de", None, 1, 0, ""), (8, "two words", "de", "c", 1, 0, ""), (9, "word " * 9000, "de", "a", 1, 0, ""),
    (10, "é # 漢字 </s> [INST] it's 12 don't", "fr", "b", 1, 0, ""), (None, "no id here", "en", "a", 1, 0, ""), (1, BASE, "en", "a", 1, 0, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in texts}


def test_near_duplicates_equal_brute_force(docs, odd, empty):
    for table in (docs, odd):
        texts = {r["doc_id"]: r["text"] for r in table.collect() if r["doc_id"] is not None}
        got = near_dedup.near_duplicates(table).collect()
        assert len(got) == table.count()
        want = groups(texts)
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
                assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicate_chains_in_one_bucket(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(40)]
    rows += [(100 + k, " ".join([f"y{k}-{j}" for j in range(6)] + base[:40])) for k in range(20)]
    got = {r[0]: r[2] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in groups(dict(rows)).items()}


def test_near_duplicates_in_hot_buckets_with_repeated_rows(spark, monkeypatch):
    """Frequent keys are dealt over parts, rows repeated, helper names taken: nothing changes."""
    for module in (common, near_dedup):
        monkeypatch.setattr(module, "HOT_ROWS", 2, raising=False)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(40)]
    rows += [(100 + k, " ".join([f"y{k}-{j}" for j in range(6)] + base[:40])) for k in range(20)] + [(200 + k, rows[3][1]) for k in range(9)]
    rows += [(300 + k, " ".join(base[:30] + [f"z{k // 2}-{j}" for j in range(8 + k % 2)])) for k in range(12)]
    names = ["n", "key", "rep", "set_key", "left", "right", "salt", "salts", "rank", "component", "bit", "n_shingles"]
    table = spark.createDataFrame(rows + rows[::2], "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    got = near_dedup.near_duplicates(table).collect()
    want = groups(dict(rows))
    assert len(got) == len(rows) + len(rows[::2]) and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)
    left = near_dedup.drop_near_duplicates(table)
    assert left.columns == table.columns and {r["doc_id"] for r in left.collect()} == {i for i, (_, c) in want.items() if c == i}


def test_near_duplicates_drop_by_id_and_text(spark):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(3, two), (5, one), (5, two), (6, two + " more"), (7, None), (7, one + " and one")]
    left = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.lit(0)))
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(3, two, 0), (5, one, 0), (7, None, 0)], key=str)


def test_components_deal_frequent_nodes(spark, monkeypatch):
    from lumenfold.llm import components

    monkeypatch.setattr(common, "HOT_ROWS", 2)
    links = [(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(40)] + [(300, 59), (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in [*range(60), 300]}, **{k: 100 for k in range(100, 141)}}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_holds_every_id_once(odd, docs, empty):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for table in (odd, docs):
        got = packing.pack(table, VOCABULARY).collect()
        sequences, by_doc = {}, {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            by_doc.setdefault(r["doc_id"], Counter())[(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
        for held in sequences.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at and length > 0
                at += length
            assert at <= 4096
        want = {}
        for r in table.collect():
            ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            for s in range(0, len(ids), 4096):
                part = ids[s : s + 4096]
                want.setdefault(r["doc_id"], Counter())[(s, len(part), crc(part), len(ids))] += 1
        assert by_doc == want
        total = sum(r["length"] for r in got)
        assert len(sequences) <= 1.05 * total / 4096 + 2
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_token_files_read_back(odd, docs, empty):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for table in (odd, docs):
        got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_file_digest(table, VOCABULARY).collect())
        rows = sorted(table.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
        start, want = 0, []
        for r in rows:
            ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            want.append((start, r["doc_id"], len(ids), crc(ids)))
            start += len(ids)
        assert got == want
    assert token_files.token_file_digest(empty, VOCABULARY).count() == 0


def test_encoding_by_other_rules(tmp_path):
    """A file with other rules than the known ones is encoded as the library does it."""
    import json

    import pyarrow as pa
    from lumenfold.llm import tokens

    assert tokens.known_rules(VOCABULARY)
    with open(VOCABULARY) as file:
        written = json.load(file)
    written["normalizer"]["normalizers"].pop()  # no lower case
    (tmp_path / "other.json").write_text(json.dumps(written))
    texts = ["Some Text's é 12", "", None, "<|endoftext|> x"]
    for path in (VOCABULARY, str(tmp_path / "other.json")):
        tokenizer = Tokenizer.from_file(path)
        ids, offsets = tokens.ChunkEncoder(path).encode(pa.array(texts), 9)
        want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 9] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want


def test_elias_fano_select():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5, 5, 5], np.sort(rng.integers(0, 10**9, 3000)), np.arange(2000)):
        coded = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.int64)).to_bytes())
        assert coded.decode().tolist() == list(values)
        assert [coded.select(i) for i in range(len(values))] == list(values)


def test_line_dedup_equals_sql(spark, tmp_path, empty):
    got = __spark_entry__.queries()["op7_line_dedup"](spark, SF).toPandas()
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
        want = con.execute(line_dedup.ORACLE).df()
    columns = list(want.columns)
    assert got[columns].sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_on_odd_rows(spark):
    line = "one common line of words"
    rows = [(1, f"{line}\nx", "a"), (2, f"y\n {line}", "b"), (3, line, None), (4, None, "c"), (None, f"{line}\n", "d"), (5, "", "e"), (1, f"{line}\nx", "a")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    found = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in got)
    assert found == Counter({(1, f"{line}\nx", 0): 2, (2, "y", 1): 1, (3, "", 1): 1, (4, None, 0): 1, (None, "", 1): 1, (5, "", 0): 1})


def test_line_dedup_with_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 2)  # every repeated line is dealt by salts
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    line = "one common line of words"
    names = ["h1", "h2", "first", "n", "sites", "row", "lines", "gone", "key", "id", "site", "pos", "salts", "_lf_salt", "text_hash", "n_lines", "n_removed"]
    rows = [(1, f"{line}\nx", "a"), (2, f"y\n {line}", "b"), (3, line, None), (4, f"{line}\nz", ""), (5, None, None)] + [(9, f"{line}\nx", "a")] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in names})
    got = line_dedup.dedup_lines(table).collect()
    want = {(1, f"{line}\nx", 2, 0): 1, (2, "y", 2, 1): 1, (3, "", 1, 1): 1, (4, "z", 2, 1): 1, (5, None, 0, 0): 1, (9, "x", 2, 1): 3}
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got) == Counter(want)
    assert all(r[c] == c for r in got for c in names[:-2])
    left = line_dedup.drop_repeated_lines(table)
    assert left.columns == table.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 4, 5, 9}
    assert all(r[c] == c for r in left.collect() for c in names)


def test_line_dedup_tells_no_source_from_an_empty_one(spark):
    line = "one common line of words"
    rows = [(1, line, "a"), (2, line, None), (3, line, "")]
    assert line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("n_removed = 1").count() == 2


def test_mixing_meets_targets(docs, odd, empty):
    for table in (docs, odd):
        got, again = mixing.mix(table).collect(), mixing.mix(table).collect()
        assert len(got) == table.count() and sorted(map(str, got)) == sorted(map(str, again))
        totals = {}
        for r in got:
            assert r["taken"] in (0, r["size"], 2 * r["size"])
            key = (r["source"], r["source_size"], r["target"])
            totals[key] = totals.get(key, 0) + r["taken"]
        for (_, size, target), taken in totals.items():
            assert target <= 2 * size + 1e-6
            if table is docs:
                assert abs(taken - target) <= 0.02 * target + 5
    assert mixing.mix(empty).count() == 0


def shared_out(sizes, weights, total, most=2.0):
    """Brute force: share by weight, stop what exceeds, share the rest again."""
    out, open_, left = {}, list(range(len(sizes))), total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        out |= {i: most * sizes[i] for i in over} if over else {i: left * weights[i] / weight for i in open_}
        left, open_ = left - sum(out[i] for i in over), [i for i in open_ if i not in over] if over else []
    return [out[i] for i in range(len(sizes))]


def test_mixing_targets_equal_brute_force(spark):
    assert shared_out([100, 100, 100], [3, 1, 2], 450) == [200, 250 / 3, 500 / 3]
    draw = np.random.default_rng(5)
    for n in (1, 3, 200):
        names = sorted((f"{'é' if k % 3 else 'z'}{k}" for k in range(n - 1)), key=str.encode) + [None]
        sizes = [int(x) for x in draw.integers(0, 3, n) * 10 ** draw.integers(0, 6, n)]
        rows = [(f"+{s}" if s else "-", s, z) for s, z in zip(names, sizes, strict=True)]
        got = {r["source"]: r["target"] for r in mixing.with_targets(spark.createDataFrame(rows, "site string, source string, source_size long")).collect()}
        want = shared_out(sizes, [mixing.WEIGHTS[k % 3] for k in range(n)], 1.5 * sum(sizes))
        assert [got[s] for s in names] == pytest.approx(want)


def test_mixing_of_many_chunks_nulls_and_repeats(spark, monkeypatch):
    """Sources of more rows than a chunk, rows without doc_id or source, repeated rows, helper names taken."""
    monkeypatch.setattr(mixing, "CHUNK", 20)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    draw = np.random.default_rng(6)
    rows = [(None if k % 9 == 0 else k // 2, " ".join("w" * int(draw.integers(1, 60))), ["a", "b", None, ""][k % 4]) for k in range(600)]
    rows += rows[:30] + [(7, None, "a"), (8, "", "b")]
    names = ["key", "row", "size", "copy", "copies", "number", "times", "nth", "site", "p", "rows"]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in names})
    got, again = mixing.mix(table).collect(), mixing.mix(table).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    totals = {}
    for r in got:
        total = totals.setdefault(r["source"], [r["target"], 0])
        total[1] += r["taken"]
    assert all(abs(taken - target) <= 0.01 * target for target, taken in totals.values())
    mixed = mixing.mixed_documents(table)
    assert mixed.columns == table.columns
    want = Counter()
    for r in got:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    have = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in mixed.collect())
    assert have == +want


def test_language_id_held_out(docs, odd, empty):
    model = language_id.train(docs)
    got = language_id.identify(docs, model, "doc_id", "lang").withColumn("held_out", language_id.held_out()).where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got if r["lang"]]) >= 0.95
    rows = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (4, 5, 6))
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert language_id.identify(odd, language_id.train(empty)).where("lang_pred <> 'und'").count() == 0


def test_language_id_equals_brute_force(spark, docs):
    """Frequencies, back-off, prior and probability once more, entry by entry."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    counts, prior = {n: {} for n in (0, *language_id.NGRAMS)}, {}
    for doc_id, text, lang in rows:
        if text is None or lang is None or zlib.crc32(str(doc_id).encode()) % 5 == 0:
            continue
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            prior[lang] = prior.get(lang, 0) + 1
            for n in counts:
                edged = f"<{word}>" if n > 1 else word
                for entry in [word] if n == 0 else [edged[k : k + n] for k in range(len(edged) - n + 1)]:
                    counts[n].setdefault(entry, Counter())[lang] += 1
    langs = sorted(prior)
    totals = {n: {x: sum(c[x] for c in held.values()) for x in langs} for n, held in counts.items()}

    def row(n, entry):
        logs = np.array([np.log((counts[n][entry][x] + 0.5) / (totals[n][x] + 0.5 * len(counts[n]))) for x in langs])
        return logs - logs.mean()

    def evidence(word):
        if word in counts[0]:
            return row(0, word)
        for n in language_id.NGRAMS:
            edged = f"<{word}>" if n > 1 else word
            if known := [g for g in (edged[k : k + n] for k in range(len(edged) - n + 1)) if g in counts[n]]:
                return np.mean([row(n, g) for g in known], axis=0)
        return np.zeros(len(langs))

    base = np.array([np.log(prior[x] + 1) for x in langs])
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.train(docs), "doc_id").collect()}
    for doc_id, text, _ in rows[::5]:
        if text is None or not re.search(r"[^\W\d_]", text):
            assert got[doc_id]["lang_pred"] == "und"
            continue
        logits = base - base.mean() + language_id.TEMPER * sum((evidence(w) for w in re.findall(r"[^\W\d_]+", text.lower())), np.zeros(len(langs)))
        odds = np.exp(logits - logits.max())
        assert got[doc_id]["lang_pred"] == langs[int(odds.argmax())] and abs(got[doc_id]["score"] - odds.max() / odds.sum()) < 1e-3


def test_language_id_rejects_what_no_model_knows(docs, spark):
    clean = [r["text"] for r in docs.where("lang is not null and length(text) > 20").orderBy("doc_id").limit(40).collect()]
    strange = ["xqzv kjwx qqzzk vxkw jqxz", "лорем ипсум долор сит амет", "漢字 仮名 交 文", "12 34 !!", "", None]
    texts = [*clean, *(" ".join(t.split()[:2]) for t in clean), *strange]
    rows = spark.createDataFrame([(10**6 + k, t, "xx", 1, k) for k, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long, known int")
    table = docs.withColumn("known", F.lit(0)).unionByName(rows.withColumn("lang", F.lit(None).cast("string")))
    left = language_id.keep_identified(table)
    assert left.columns == table.columns
    kept = {r["known"] for r in left.where("source = 'xx'").collect()}
    assert kept == set(range(2 * len(clean)))


def test_language_id_learns_a_rare_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAINING_DOCUMENTS", 60)
    draw = np.random.default_rng(2)
    word = lambda letters: "".join(draw.choice(list(letters), 5))
    big, small = [word("abcdefgh") for _ in range(60)], [word("abcdstuv") for _ in range(30)]
    rows = [(k, " ".join(draw.choice(small if k % 200 == 7 else big, 30)), "xx" if k % 200 == 7 else "en") for k in range(2000)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "xx"] and (model.tables[0].find(small) >= 0).all() and (model.tables[0].find(["nothere"]) < 0).all()
    assert model.predict([" ".join(small[:3]), " ".join(big[:3])])[0] == ["xx", "en"]
    assert abs((model.prior[0] - model.prior[1]) - np.log(199)) < 0.7  # by all rows, not by those drawn


def test_quality_base_statistics(docs, odd, empty, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in [*docs.collect(), *odd.where("doc_id is not null").collect()]}
    for table in (docs, odd):
        for r in quality.judge(table, model).collect():
            if r["doc_id"] is None or (table is docs) != (texts[r["doc_id"]] not in {x[1] for x in ROWS}):
                continue
            text = texts[r["doc_id"]]
            words = WORD.findall(text)
            windows = Counter(zip(words, words[1:], words[2:], strict=False))
            inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
            lines, seen, repeated = text.split("\n"), set(), 0
            for line in lines:
                repeated += line in seen and bool(WORD.search(line))
                seen.add(line)
            failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
            want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside), failed)
            assert tuple(r[1:7]) == want
            assert not (failed and r["kept"])
    assert quality.judge(empty, quality.train(empty, labels.limit(0))).count() == 0


def test_quality_features_are_character_ngrams():
    def bucket(signs, other):
        rolled = 0
        for c in signs:
            rolled = (rolled * 0x85EBCA6B + ord(c)) % 2**32 if rolled or c is not signs[0] else ord(c)
        return (rolled ^ other) * 2654435761 % 2**32 >> 17

    text = "ab é漢字 😀 abc"
    whole = lambda text: [np.concatenate([b for f, b in quality.families(text.encode(), quality._Words()) if f == k]) for k in range(4)]
    _, _, three, four = whole(text)
    assert three.tolist() == [bucket(text[k : k + 3], 0) for k in range(len(text) - 2)]
    assert four.tolist() == [bucket(text[k : k + 4], 0x5BD1E995) for k in range(len(text) - 3)]
    assert [len(f) for f in whole("é漢")] == [1, 0, 0, 0]


def test_quality_windows_change_nothing(monkeypatch):
    draw = np.random.default_rng(5)
    signs = list("abé漢😀 \n\t#")
    texts = ["", " ", "a", "é" * 50, *("".join(draw.choice(signs, n)) for n in (3, 40, 400, 2000))]
    texts.append("ab cd ef gh\n" * 20 + "x" * 90 + "\nab cd ef gh")

    def all_of(text):
        triples = []
        found = list(quality.families(text.encode(), quality._Words(), triples))
        buckets = [Counter(b for f, part in found if f == k for b in part.tolist()) for k in range(4)]
        return buckets, quality.base_stats(text.encode(), sum(buckets[0].values()), triples)

    whole = [all_of(t) for t in texts]
    for window, at_once in ((1, 7), (5, 1), (64, 100)):
        monkeypatch.setattr(quality, "WINDOW", window), monkeypatch.setattr(quality, "_AT_ONCE", at_once)
        assert [all_of(t) for t in texts] == whole
    assert whole[-1][1][3:] == (20, 84)


def test_quality_verdict_equals_the_probability(docs, spark):
    """kept: the base rules pass and the weights' sum over all features, computed one by one, has a probability from the threshold on."""
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in quality.judge(docs, model).collect():
        raw, known = texts[r["doc_id"]].encode(), quality._Words()
        each = [[float(model.weights[b]) for f, part in quality.families(raw, known) if f == k for b in part] for k in range(4)]
        margin = float(model.bias) + sum(sum(f) / len(f) for f in each if f)
        p = 1 / (1 + np.exp(-(model.slope * margin + model.shift)))
        assert abs(p - r["quality_score"]) < 1e-4
        assert r["kept"] == (not r["base_failed"] and r["quality_score"] >= quality.KEEP_FROM)


def test_quality_probability_keeps_the_labels_ratio(spark, monkeypatch):
    # No word says anything about the label: unseen texts get the labels' ratio, whether all rows are drawn or 150 of each label.
    words = np.random.default_rng(1)
    rows = [(k, " ".join(f"w{x}" for x in words.integers(0, 200, 60)), int(words.random() < 0.85)) for k in range(1200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labelled, fresh = table.where("doc_id < 1000"), table.where("doc_id >= 1000")
    for most in (quality.TRAINING_ROWS, 300):
        monkeypatch.setattr(quality, "TRAINING_ROWS", most)
        model = quality.train(table.select("doc_id", "text"), labelled.select("doc_id", "quality"))
        assert abs(np.mean([r["quality_score"] for r in quality.judge(fresh, model).collect()]) - 0.85) < 0.1


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.1"])
def test_nearest_neighbours_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    ids = np.array(sorted(rows))
    matrix = np.array([rows[i] for i in ids])
    got = __spark_entry__.queries()["op5_rotated_codes"](spark, sf_dir).collect()
    found, hit, wanted = {}, 0, 0
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in ids[ids % 20 == 0]:
        scores = matrix @ rows[q]
        best = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        own = sorted(found[q])
        assert [k for k, _, _ in own] == list(range(1, len(best) + 1))
        assert all(abs(s - float(rows[q] @ rows[v])) < 1e-9 for _, v, s in own)
        hit, wanted = hit + len({v for _, v, _ in own} & set(best)), wanted + len(best)
    assert hit / wanted >= 0.9


def test_nearest_neighbours_skip_bad_vectors(spark):
    rows = [(k, [float(k + 1), 1.0]) for k in range(5)] + [(20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [None, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(table, table["vec_id"] % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 4), (0, 2, 3), (0, 3, 2), (0, 4, 1)]
    assert ann.nearest(table.limit(0), table["vec_id"] % 20 == 0).count() == 0


def test_nearest_neighbours_of_an_id_with_two_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [tuple(r) for r in got] in ([(0, 1, 1, 3.0), (0, 2, 2, 3.0)], [(0, 1, 1, 2.0), (0, 2, 2, 2.0)])


@pytest.mark.parametrize("kind, group", [("double", 1 << 22), ("float", 40)])
def test_nearest_neighbours_equal_brute_force(spark, monkeypatch, kind, group):
    """Ties, equal vectors, two lengths, extra columns, more groups of queries than one. So few vectors are all scored exactly."""
    monkeypatch.setattr(ann, "GROUP_VALUES", group)
    draw = np.random.default_rng(4)
    rows = [(k, [float(x) for x in draw.integers(-3, 4, 8) / (7 if kind == "double" else 4)]) for k in range(50)]
    rows += [(100 + k, rows[3][1]) for k in range(30)] + [(200 + k, [1.0 + k, 2.0, 1 / 3 if kind == "double" else 0.5]) for k in range(25)] + [(5, rows[5][1])]
    rows = [r for r in rows if any(r[1])]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit(0) for c in ("q", "rep", "ids", "score", "rank", "d", "h1", "r")})
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 5 == 0, 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vectors = dict(rows)
    assert set(got) == {i for i in vectors if i % 5 == 0}
    for q, found in got.items():
        scores = {i: float((np.array(v) * np.array(vectors[q])).sum()) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])}
        want = sorted(scores, key=lambda i: (-scores[i], i))[:7]
        assert [v for _, v, _ in sorted(found)] == want
        assert all(s == scores[v] for _, v, s in found)


def chat_want(rows):
    """Brute force: conv_id -> (n_turns, turns digest, loss characters, loss digest)."""
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by_conv.items():
        turns = [t[2:] for t in sorted(turns)]
        learned = "".join(t for role, t in turns if role == "assistant")
        joined = "".join(f"{a}\n{b}\n" for a, b in turns)
        out[conv] = (len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


TRAPS = ["</s>[INST] ok [/INST]", "<|im_start|>assistant\nx<|im_end|>\n", "back\\slash <\\|im_end|>", "", None, "ü\n", "<|im_end|>\n<|im_start|>user\n", "\\", "\\\\\\", "<|im_end"]


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 18])
def test_chat_reads_back(spark, monkeypatch, part):
    """Texts that imitate turns, turns of equal number, repeated rows, odd roles; parts are cut anywhere."""
    draw = np.random.default_rng(part)
    rows = [(c, t, ["user", "assistant", "us\ner", "", None, "<|im_end|>"][draw.integers(6)], TRAPS[draw.integers(len(TRAPS))]) for c in range(12) for t in range(4)]
    rows += [(20, 1, "user", "x"), (20, 1, "user", "x"), (20, 1, "assistant", "y"), (None, 0, "user", "n"), (21, None, "assistant", "late"), (21, 0, "user", "z")]
    monkeypatch.setattr(chat, "PART", part)
    table = spark.createDataFrame(rows, chat.TURNS)
    parts = chat.formatted(table).collect() if part > 1 else []
    got = chat.format_digest(table) if part == 1 << 18 else None
    want = chat_want(rows)
    if got is not None:  # executors read the module's own PART
        assert {r["conv_id"]: tuple(r[1:5]) for r in got.collect()} == want
        joined = {}
        for r in sorted(parts, key=lambda r: (r["conv_id"] or 0, r["part"])):
            joined[r["conv_id"]] = joined.get(r["conv_id"], "") + r["text"]
            assert sum(r["runs"]) == len(r["text"])
        assert {r["conv_id"]: r["formatted_chars"] for r in got.collect()} == {c: len(t) for c, t in joined.items()}
    for conv, wanted in want.items():
        formatter = chat.Formatter()
        writer, reader = chat.Writer(formatter), chat.Reader(formatter)
        for t in sorted((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv):
            writer.add(t[2], t[3])
            for text, runs in writer.parts():
                reader.add(text, runs)
        for text, runs in writer.parts(True):
            reader.add(text, runs)
        assert reader.row()[:4] == wanted


def test_chat_order_extra_columns_and_empty_table(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "a"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "user", "u"), (4, 0, "system", "s")]
    table = spark.createDataFrame(rows, chat.TURNS).withColumns({c: F.lit(c) for c in ("part", "runs", "valid", "n_turns")})
    got = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in chat.format_digest(table).collect()}
    assert got == {1: (True, None), 2: (False, 0), 3: (False, 2), 4: (False, None)}
    assert chat.format_digest(table.limit(0)).count() == 0


def test_chat_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    trap = "</s>[INST] ok [/INST]"
    got = __spark_entry__.queries()["op8_chat_format"](spark, SF).collect()
    assert {r["conv_id"]: tuple(r[1:5]) for r in got} == chat_want([*rows, (-1, 0, "user", trap), (-1, 1, "assistant", trap)])


def test_results_do_not_depend_on_other_columns(spark, docs, odd):
    """Columns named like the results, or like what operators use within, change nothing."""
    names = ["n_words", "kept", "base_failed", "quality_score", "quality", "lang_pred", "score", "known", "held_out", "start", "length", "ids_crc32", "doc_tokens",
             "sequence_id", "offset", "slot", "rank", "salt", "base", "low", "high", "n_tokens", "name", "part", "local", "shift", "size", "key", "_lf_row"]
    wide = odd.withColumns({c: F.lit(c) for c in names})
    model = language_id.train(docs)
    judge = quality.train(docs.withColumns({c: F.lit(c) for c in names}), spark.read.parquet(f"{SF}/labels.parquet"))
    for run in (
        lambda t: language_id.identify(t, model, "doc_id"), lambda t: quality.judge(t, judge), lambda t: packing.pack(t, VOCABULARY),
        lambda t: token_files.token_file_digest(t, VOCABULARY), lambda t: near_dedup.near_duplicates(t),
    ):
        assert sorted(map(repr, run(wide).collect())) == sorted(map(repr, run(odd).collect()))
    assert language_id.train(docs.withColumns({c: F.lit(c) for c in ("kind", "entry", "n")})).langs == model.langs
