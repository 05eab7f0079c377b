"""Merkle manifest, exact dedup and tokenizer alignment against brute force and SQL, with awkward rows."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from sentencepiece import SentencePieceProcessor  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import __spark_entry__  # noqa: E402
from lumenfold.llm import alignment, common, exact_dedup, merkle  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["hash", "idx", "size", "tree", "row", "node", "up", "digest", "keep_id", "n", "block", "at", "pair", "salts", "_lf_salt", "members"]
ROWS = [
    (1, "Some Text", "en", "a", 9), (2, "Some Text", "en", "b", 9), (3, "some text", "en", None, 9), (4, None, None, None, None), (5, "", "de", "b", 0),
    (None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5), (1, "Some Text", "en", "a", 9), (1, "Another", "en", "a", 7), (6, None, "", "x", -1),
    (7, "é 漢字 </s> <|endoftext|> ▁ <0x41>", "fr", "a", 3), *[(100 + k, f"row {k % 7} A", "en" if k % 3 else "it", "s", k) for k in range(150)],
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(c) for c in NAMES})


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_exact_dedup"])
def test_query_equals_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
        found = con.execute(__spark_entry__.oracle_sql()[name])
        columns, want = [c[0] for c in found.description], found.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climbed(hashes):
    """(last node, per leaf its siblings (before, after) level by level)."""
    at, proofs = list(range(len(hashes))), [[] for _ in hashes]
    while len(hashes) > 1:
        for proof, i in zip(proofs, at, strict=True):
            run = i // 8 * 8
            proof.append(("".join(hashes[run:i]), "".join(hashes[i + 1 : run + 8])))
        hashes = [H(*hashes[k : k + 8]) for k in range(0, len(hashes), 8)]
        at = [i // 8 for i in at]
    return hashes[0], proofs


def manifest_want(rows):
    trees = {}
    for r in rows:
        trees.setdefault("" if r[2] is None else "+" + r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(trees, key=str.encode)
    built = {t: climbed([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in names}
    root, above = climbed([built[t][0] for t in names])
    out = []
    for t, up in zip(names, above, strict=True):
        for (_, _, h, r), proof in zip(sorted(trees[t], key=lambda x: x[:3]), built[t][1], strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            start = leaf(r[0], "".join(c.lower() if c.isascii() else c for c in r[1]), *r[2:]) if changed else h
            folded = start
            for before, after in [*proof, *up]:
                folded = H(before, folded, after)
            out.append((r[0], h, built[t][0], root, H(*[a + b for a, b in [*proof, *up]]), folded, folded == root))
    return out


def test_manifest_equals_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)  # frequent ancestors are dealt by salts
    for rows in (ROWS, ROWS[:1], ROWS[3:5], [r for r in ROWS if r[2] == "en"], [(k, "x", "en", "a", 1) for k in range(64)]):
        table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in NAMES})
        got = [tuple(r) for r in merkle.verified(merkle.manifest(table)).collect()]
        assert Counter(got) == Counter(manifest_want(rows))
    assert merkle.verified(merkle.manifest(odd.limit(0))).count() == 0


def test_manifest_notices_what_changed(spark):
    rows = [(k, f"Text {k}" if k % 2 else f"text {k}", "en", "a", 1) for k in range(60)]
    for r in merkle.verified(merkle.manifest(spark.createDataFrame(rows, SCHEMA))).collect():
        assert r["verified"] == (not (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["doc_id"] % 2))


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("arrivals", [1, 2, 5])
def test_exact_duplicates_equal_brute_force(spark, odd, monkeypatch, arrivals):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    index = exact_dedup.DigestIndex(spark, f"digests_{arrivals}", buckets=4)
    got = exact_dedup.exact_duplicates(odd, index, arrivals).collect()
    groups = {}
    for r in ROWS:
        groups.setdefault(r[1] or "", []).append(r[0])
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, largest[t], len(ids), sha(t)) for t, ids in groups.items() for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    stay = Counter((r["text_sha256"], r["doc_id"]) for r in got if r["kept"])
    assert stay == Counter((sha(t), largest[t]) for t in groups)  # one row of each text, repeated rows too
    assert index.current().count() == len(groups)
    before = index.entries().count()
    again = exact_dedup.exact_duplicates(odd, index).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got)) and index.entries().count() == before
    assert exact_dedup.exact_duplicates(odd.limit(0), index).count() == 0 and index.entries().count() == before
    index.drop()


def test_index_persists_is_bucketed_and_supersedes(spark, tmp_path):
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, "first_index", path, 4)
    rows = lambda *pairs: spark.createDataFrame(pairs, "doc_id long, text string").withColumn("digest", F.lit(0))
    new = exact_dedup.new_documents(rows((1, "x"), (2, "x"), (3, "y"), (None, "z"), (None, "z")), index)
    assert Counter(map(tuple, new.collect())) == Counter([(2, "x", 0), (3, "y", 0), (None, "z", 0)])
    spark.sql("DROP TABLE first_index")  # another session: the files are there still
    index = exact_dedup.DigestIndex(spark, "second_index", path, 4)
    new = exact_dedup.new_documents(rows((1, "x"), (9, "y"), (None, "z"), (4, None), (5, "")), index)
    assert Counter(map(tuple, new.collect())) == Counter([(9, "y", 0), (5, "", 0)])
    held = {bytes(r["digest"]).hex(): r["keep_id"] for r in index.current().collect()}
    assert held == {sha("x"): 2, sha("y"): 9, sha("z"): None, sha(""): 5}
    small = index.compacted("third_index", buckets=2)
    assert small.entries().count() == 4 and index.entries().count() == 5
    groups = spark.createDataFrame([(b"a", 1)], "digest binary, keep_id long").groupBy("digest").agg(F.max("keep_id").alias("keep_id"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    plan = index.fresh(groups)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1  # of the new side
    for name in ("second_index", "third_index"):
        spark.sql(f"DROP TABLE {name}")


class Brute:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATH_A), SentencePieceProcessor(model_file=PATH_B)
        self.a.encode_special_tokens = True
        self.decode = {}
        n = 0
        for x in range(256):
            if x in range(0x21, 0x7F) or x in range(0xA1, 0xAD) or x in range(0xAE, 0x100):
                self.decode[chr(x)] = x
            else:
                self.decode[chr(0x100 + n)] = x
                n += 1

    def tokens(self, text):
        if not text:
            return None
        raw = b" " + text.encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        of_a = [bytes(self.decode[c] for c in self.a.id_to_token(i)) for i in a]
        of_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        return (a, b, np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()) if b"".join(of_a) == raw == b"".join(of_b) else None

    def align(self, rows):
        held, count = [], Counter()
        for doc_id, text in rows:
            links, groups, shared, got = [], [], 0, self.tokens(text)
            if got:
                a, b, ends_a, ends_b = got
                i = j = 0
                first = (0, 0)
                while i < len(a):
                    links.append((a[i], b[j]))
                    x, y = ends_a[i], ends_b[j]
                    i, j = i + (x <= y), j + (y <= x)
                    if x == y:
                        groups.append(",".join(map(str, a[first[0] : i])) + "|" + ",".join(map(str, b[first[1] : j])))
                        shared += (i - first[0]) * (j - first[1])
                        first = (i, j)
                count.update(set(links))
            held.append((doc_id, len(got[0]) if got else 0, len(got[1]) if got else 0, groups, links, shared))
        most = {}
        for (a, _), n in count.items():
            most[a] = max(most.get(a, 0), n)
        return Counter(
            (i, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "", shared)
            for i, n_a, n_b, groups, links, shared in held
        )


TEXTS = [
    "plain words here", " leading", "trailing ", "two  spaces   three", "line\nbreak\r\n  indented\ttab", "\n", " ", "   ", "naïve café 漢字仮名 😀👍🏽", "▁ literal", "don't we'll I'M",
    "<s> </s> <unk> <|endoftext|> <0x41>", "a b c　d", "x\u0085y z", "\x00nul \x1f", "12345 67,89 -- ...", None, "", "é", "é ́", "word " * 3000, "https://a.example/x?y=1&z=%20 q",
    "​zero​ width", "İstanbul ﬁ ½", "	tab first", "x \n y", "﻿bom", " ▁ ",
]


def test_alignment_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(10_000 + k, t) for k, t in enumerate(TEXTS)] + [(10_000, TEXTS[0]), (None, "no id"), *[(10_000 + k, "line\nbreak") for k in range(3)]]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in NAMES})
    got = Counter(tuple(r) for r in alignment.align(table, PATH_A, PATH_B).collect())
    assert got == Brute().align(rows)
    assert alignment.align(table.limit(0), PATH_A, PATH_B).count() == 0


def test_alignment_of_windows_and_blocks(monkeypatch):
    """Windows, matrices multiplied a few rows at a time and forgotten chunks change nothing."""
    brute, known = Brute(), alignment.Chunks(alignment.Tokenizers(PATH_A, PATH_B))
    monkeypatch.setattr(alignment, "WINDOW", 7)
    monkeypatch.setattr(alignment, "CHUNKS", 4)
    for text in [t for t in TEXTS if t] + ["some longer text with many words in it, and an end. " * 20]:
        known.trim()
        parts = alignment._chunked(text, known)
        known.learn()
        got = alignment._aligned(parts, known)
        want = next(iter(brute.align([(0, text)])))
        if brute.tokens(text) is None:
            assert got is None
        else:
            assert got[:2] == ([*want[1:5], want[8]], want[7])


@pytest.mark.parametrize("most", [1, 5, 1 << 20])
def test_sparse_products(most):
    draw = np.random.default_rng(most)
    for n, m, k in ((5, 7, 4), (1, 1, 1), (20, 3, 9)):
        left, right = draw.integers(0, 3, (n, m)) * draw.integers(0, 2, (n, m)), draw.integers(0, 3, (m, k))

        def csr(dense):
            at = [np.flatnonzero(r) for r in dense]
            return alignment.Csr(np.concatenate([[0], np.cumsum([len(x) for x in at])]), np.concatenate(at), np.concatenate([r[x] for r, x in zip(dense, at, strict=True)]), dense.shape[1])

        for a, b, want in ((csr(left), csr(right), left @ right), (csr(left), csr(left).transposed(), left @ left.T)):
            out = np.zeros(want.shape, int)
            for rows, cols, values in a.products(b, most):
                out[rows, cols] = values
            assert (out == want).all()


def test_alignment_pairs(spark):
    rows = [(1, "hello world"), (2, "hello there"), (3, "hello world hello")]
    got = {(r["a"], r["b"]): (r["count"], r["best"]) for r in alignment.links(spark.createDataFrame(rows, "doc_id long, text string"), PATH_A, PATH_B).collect()}
    brute, count = Brute(), Counter()
    for _, text in rows:
        a, b, ends_a, ends_b = brute.tokens(text)
        over = lambda i, j: max(([0] + ends_a)[i], ([0] + ends_b)[j]) < min(ends_a[i], ends_b[j])
        count.update({(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if over(i, j)})
    assert {p: n for p, (n, _) in got.items()} == dict(count)
    assert all(best == (n == max(m for (x, _), m in count.items() if x == a)) for (a, _), (n, best) in got.items())


def test_alignment_shuffles_a_packed_matrix_once(spark, monkeypatch):
    """What documents hold is not moved to where pairs are counted, and takes far less than two integers an entry."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    written = {}

    def kept(df, name, keep=alignment.keep):
        written[name] = keep(df, name)
        return written[name]

    monkeypatch.setattr(alignment, "keep", kept)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as over large tables
    try:
        aligned = alignment.align(docs, PATH_A, PATH_B)
        plan = aligned._jdf.queryExecution().explainString(aligned.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    exchanges = [part for part in plan.split("\n\n") if ") Exchange\n" in part]
    assert len(exchanges) > 3 and ["hashpartitioning(pair#" in part for part in exchanges if "held#" in part] == [False]
    size, entries = written["aligned"].agg(F.sum(F.length("held")), F.sum(F.when(F.col("pair").isNotNull(), F.col("docs")))).first()
    assert size < 3 * entries


@pytest.mark.parametrize(("n_docs", "most"), [(1, 5), (300, 70_000), (100_000, 1)])
def test_packed_entries_come_back(n_docs, most):
    draw = np.random.default_rng(n_docs)
    cells = np.unique(np.concatenate([np.arange(9) * n_docs + draw.integers(0, n_docs, 9), draw.integers(0, 9 * n_docs, 50), [9 * n_docs - 1]]))
    times = draw.integers(1, most + 1, len(cells))
    got = alignment._unpacked(alignment._packed(cells // n_docs, cells % n_docs, times, n_docs), len(cells), n_docs)
    assert all((x == y).all() for x, y in zip(got, (cells // n_docs, cells % n_docs, times), strict=True))
