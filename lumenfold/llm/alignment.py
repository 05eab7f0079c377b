"""Alignment of two tokenizers over the same texts, by sparse products.

Both tokenizers cut a text's bytes into tokens. A token-byte incidence matrix
has a row per token and a column per byte; A . B^T then has an entry for every
A token and B token that overlap. Offsets where tokens of both end cut the text
into groups; token-group incidence matrices give the links by shared group.
Matrices are kept as compressed sparse rows (:class:`Csr`) and multiplied row by
row after Gustavson.

Neither vocabulary has a token that reaches from a character other than white
space into a following space or line feed, so texts are cut there and each
chunk, which begins with one of these, has its tokens, groups and links for
itself. A worker aligns a chunk once. What a document links is one more product: documents by
chunks times chunks by pairs.

Pairs are shuffled once per block of documents (a slice of an Arrow batch), not
per document: a pair that almost every document holds has one row in each block.
Which documents of a block hold which pairs is one packed matrix per block. It is
shuffled once, by block, to meet the counts of the block's pairs; only pairs go
where they are counted.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import slices, texts_of
from lumenfold.session import keep

#: A space or line feed that follows a character other than white space; and a chunk, from one of these up to the next.
_CUT = re.compile(r"(?<=\S)[ \n]")
_CHUNK = re.compile(r"[ \n]\s*+(?:\S++(?:[^\S \n]\s*+)?+)*+")
#: Long texts are cut into windows of about so many characters, and new chunks aligned so many characters at a time.
WINDOW = 1 << 18
#: A worker forgets its chunks when it holds so many of them, or so many tokens of theirs.
CHUNKS, CHUNK_TOKENS = 300_000, 3_000_000
#: Rows of a product that are expanded together hold about so many entries.
ENTRIES = 1 << 20


class Csr:
    """A sparse 0/1 or counting matrix by rows: row i has columns ``cols[ptr[i]:ptr[i + 1]]`` with ``values``."""

    __slots__ = ("ptr", "cols", "values", "width")

    def __init__(self, ptr: np.ndarray, cols: np.ndarray, values: np.ndarray, width: int):
        self.ptr, self.cols, self.values, self.width = ptr, cols, values, width

    @classmethod
    def spans(cls, ends: np.ndarray, width: int) -> Csr:
        """Row i covers the columns from the end of row i - 1 up to ``ends[i]``."""
        return cls(np.concatenate([[0], ends]).astype(np.int64), np.arange(width, dtype=np.int64), np.ones(width, np.int64), width)

    @classmethod
    def single(cls, cols: np.ndarray, width: int) -> Csr:
        """Row i has the one column ``cols[i]``."""
        return cls(np.arange(len(cols) + 1, dtype=np.int64), cols.astype(np.int64), np.ones(len(cols), np.int64), width)

    def transposed(self) -> Csr:
        order = np.argsort(self.cols, kind="stable")
        rows = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))
        ptr = np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.width))])
        return Csr(ptr, rows[order], self.values[order], len(self.ptr) - 1)

    def row_sizes(self, other: Csr) -> np.ndarray:
        """Entries that each row of the product would sum, without forming them."""
        each = np.concatenate([[0], np.cumsum(np.diff(other.ptr)[self.cols])])
        return each[self.ptr[1:]] - each[self.ptr[:-1]]

    def products(self, other: Csr, most: int = ENTRIES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, columns, values) of self . other, some rows at a time.

        Gustavson: a row of the product is the sum of those rows of ``other``
        that the row of ``self`` names. Equal columns of a row are added up.
        """
        reach = np.concatenate([[0], np.cumsum(self.row_sizes(other))])
        start, n = 0, len(self.ptr) - 1
        while start < n:
            stop = max(start + 1, int(np.searchsorted(reach, reach[start] + most, side="right")) - 1)
            low, high = self.ptr[start], self.ptr[stop]
            inner = self.cols[low:high]
            sizes = other.ptr[inner + 1] - other.ptr[inner]
            total = int(sizes.sum())
            at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(other.ptr[inner], sizes)
            rows = np.repeat(np.repeat(np.arange(start, stop), np.diff(self.ptr[start : stop + 1])), sizes)
            key, values = rows * other.width + other.cols[at], np.repeat(self.values[low:high], sizes) * other.values[at]
            if total and (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, values = key[order], values[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.empty(0, np.int64)
            yield key[first] // other.width, key[first] % other.width, np.add.reduceat(values, first) if total else values
            start = stop


def _all(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Tokenizers:
    """Vocabulary A (tokenizers, byte-level) and B (sentencepiece), and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        written = {chr(b): b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
        written |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(0x100) if chr(b) not in written)}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(written[c] for c in entry) if all(c in written for c in entry) else entry.encode()
        n = self.b.get_piece_size()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.size_a, self.size_b = (np.array([len(x) for x in held], np.int64) for held in (self.bytes_a, self.bytes_b))

    def encode(self, chunks: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for chunks, one after the other; None if their bytes aren't the text's.

        The chunks follow a letter, as they do in texts: B puts a space before the text.
        """
        a, b = self.a.encode(" a" + chunks, add_special_tokens=False).ids, self.b.encode("a" + chunks, num_threads=1)
        raw = b" a" + chunks.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        if self.bytes_a[a[0]] != b" a" or self.bytes_b[b[0]] != b" a":
            raise ValueError("the vocabularies have no token for a lone letter")
        return np.array(a[1:], np.int64), np.array(b[1:], np.int64)


class Chunks(dict):
    """Chunk to its number; what belongs to the numbers is in arrays."""

    def __init__(self, tokenizers: Tokenizers):
        super().__init__()
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.unknown: list[str] = []
        self.written: list[bytes] = []  # groups, as text
        self.numbers = np.empty((0, 6), np.int64)  # valid, tokens of A, of B, groups, links, links by group
        self.pair_ptr, self.pairs, self.times = np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        self.unknown.append(chunk)
        number = self[chunk] = len(self)
        return number

    def learn(self) -> None:
        """Align the chunks that were new since the last time, about ``WINDOW`` characters at once."""
        new, self.unknown, start = self.unknown, [], 0
        numbers, sizes, pairs, times = [self.numbers], [np.diff(self.pair_ptr)], [self.pairs], [self.times]
        while start < len(new):
            size, stop = 0, start
            while stop < len(new) and (stop == start or size < WINDOW):
                size += len(new[stop])
                stop += 1
            for held, part in zip((numbers, sizes, pairs, times), self._align(new[start:stop]), strict=True):
                held.append(part)
            start = stop
        if new:
            self.numbers, self.pairs, self.times = np.concatenate(numbers), np.concatenate(pairs), np.concatenate(times)
            self.pair_ptr = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _align(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per chunk its numbers and how many distinct id pairs it links; these pairs, and how often it links each."""
        held, n = self.tokenizers, len(chunks)
        # A sign that B writes for a space never comes out as itself, and what ends in white space stands for itself:
        # such chunks are encoded one by one, all others as one text.
        plain = np.array(["▁" not in c and not c[-1].isspace() for c in chunks])
        whole = held.encode("".join([c for c, ok in zip(chunks, plain, strict=True) if ok]))
        if whole is None:
            plain[:] = False
        each = {k: held.encode(chunks[k]) for k in np.flatnonzero(~plain).tolist()}
        valid = plain | np.array([each.get(k) is not None for k in range(n)])
        ends = np.cumsum([len(chunks[k].encode()) for k in np.flatnonzero(plain).tolist()])
        a, b = (
            self._in_order(ids, np.flatnonzero(plain)[np.searchsorted(ends, np.cumsum(size[ids]))], {k: x[side] for k, x in each.items() if x})
            for side, (ids, size) in enumerate(zip(whole if plain.any() else (np.empty(0, np.int64),) * 2, (held.size_a, held.size_b), strict=True))
        )
        ends_a, ends_b = np.cumsum(held.size_a[a]), np.cumsum(held.size_b[b])
        # No token reaches across the end of a chunk.
        chunk_ends = np.cumsum([len(c.encode()) if ok else 0 for c, ok in zip(chunks, valid, strict=True)])
        chunk_a, chunk_b = np.searchsorted(chunk_ends, ends_a), np.searchsorted(chunk_ends, ends_b)
        count_a, count_b = np.bincount(chunk_a, minlength=n), np.bincount(chunk_b, minlength=n)
        width = int(ends_a[-1]) if len(ends_a) else 0
        # Tokens by bytes. Chunks lie one after the other on the axis of bytes, and no token reaches across.
        over_a, over_b = Csr.spans(ends_a, width), Csr.spans(ends_b, width)
        rows, cols, _ = _all(over_a.products(over_b.transposed())) if width else (np.empty(0, np.int64),) * 3
        # Tokens by groups: a group ends where tokens of both do.
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        by_a, by_b = Csr.single(group_a, len(cuts)), Csr.single(group_b, len(cuts))
        shared = by_a.row_sizes(by_b.transposed())
        of_group = np.searchsorted(chunk_ends, cuts)
        of_link = chunk_a[rows]
        number = lambda of, weights=None: np.bincount(of, weights, minlength=n).astype(np.int64)
        numbers = np.stack([valid.astype(np.int64), count_a, count_b, number(of_group), number(of_link), number(chunk_a, shared)], axis=1)
        first_a, first_b = (np.concatenate([np.searchsorted(g, np.arange(len(cuts))), [len(g)]]) for g in (group_a, group_b))
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        from_a, from_b = first_a.tolist(), first_b.tolist()
        groups = [
            f"{text_a[i]}|{text_b[j]}" if k - i == 1 == m - j else f"{','.join(text_a[i:k])}|{','.join(text_b[j:m])}"
            for i, k, j, m in zip(from_a, from_a[1:], from_b, from_b[1:], strict=False)
        ]
        bound = np.searchsorted(of_group, np.arange(n + 1)).tolist()
        self.written += [";".join(groups[i:k]).encode() for i, k in zip(bound, bound[1:], strict=False)]
        # Distinct id pairs of each chunk, and how often it links them.
        pair = a[rows] << 32 | b[cols]
        order = np.lexsort((pair, of_link))
        of_link, pair = of_link[order], pair[order]
        first = np.flatnonzero(np.concatenate([[True], (of_link[1:] != of_link[:-1]) | (pair[1:] != pair[:-1])])) if len(pair) else np.empty(0, np.int64)
        times = np.diff(np.concatenate([first, [len(pair)]]))
        return numbers, number(of_link[first]), pair[first], times

    @staticmethod
    def _in_order(ids: np.ndarray, chunk: np.ndarray, others: dict[int, np.ndarray]) -> np.ndarray:
        """Tokens of some chunks, and of others, in the order of the chunks."""
        if not others:
            return ids
        owner = np.concatenate([chunk, *[np.full(len(x), k) for k, x in others.items()]])
        return np.concatenate([ids, *others.values()])[np.argsort(owner, kind="stable")]

    def trim(self) -> None:
        if len(self) > CHUNKS or len(self.pairs) > CHUNK_TOKENS or self.numbers[:, 1].sum() > CHUNK_TOKENS:
            self.forget()


def windows(text: str) -> Iterator[str]:
    """The text, a space before it, in parts of about ``WINDOW`` characters, cut where chunks end."""
    text, start = " " + text, 0
    while len(text) - start > WINDOW:
        cut = _CUT.search(text, start + WINDOW)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _chunked(text: str, known: Chunks) -> list[np.ndarray]:
    """The numbers of a text's chunks, by window; ``known`` may have to learn some of them."""
    return [np.array(list(map(known.__getitem__, _CHUNK.findall(part))), np.int32) for part in windows(text)]


def _aligned(parts: list[np.ndarray], known: Chunks) -> tuple[list[int], str, np.ndarray, np.ndarray] | None:
    """(five counts, digest of the groups, distinct chunks, how often each) of a text; None if it has no tokens."""
    whole = np.concatenate(parts) if len(parts) > 1 else parts[0]
    distinct, times = np.unique(whole, return_counts=True)
    numbers = known.numbers[distinct]
    if not numbers[:, 0].all():
        return None
    digest, written = hashlib.sha256(), known.written
    for k, part in enumerate(parts):
        digest.update((b";" if k else b"") + b";".join([written[i] for i in part.tolist()]))
    return (times @ numbers)[1:].tolist(), digest.hexdigest(), distinct, times


_ROW = pa.schema([
    ("doc_id", pa.int64()), ("block", pa.int64()), ("at", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("n_group_links", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("docs", pa.int64()), ("held", pa.binary()),
])
_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
_SCHEMA = ", ".join(f"{f.name} {_KINDS[f.type]}" for f in _ROW)
_known: dict[tuple[str, str], Chunks] = {}


def _encoded(path_a: str, path_b: str):
    """Function for mapInArrow: a row per document, one per id pair of each block, and one per block with what its documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _known:
            _known[path_a, path_b] = Chunks(Tokenizers(path_a, path_b))
        known, block = _known[path_a, path_b], TaskContext.get().partitionId() << 32
        for part in slices(batches, "text"):
            known.trim()
            n, rows, ptr, chunks, often, held = part.num_rows, [], [0], [], [], []
            for raw in texts_of(part, "text"):
                try:
                    held.append(_chunked(raw.decode(), known) if raw else None)
                except UnicodeDecodeError:  # not even UTF-8, so no tokens have these bytes
                    held.append(None)
            known.learn()
            for parts in held:
                found = _aligned(parts, known) if parts else None
                rows.append((*found[0], found[1]) if found else (0, 0, 0, 0, 0, ""))
                if found:
                    chunks.append(found[2]), often.append(found[3])
                ptr.append(ptr[-1] + (len(found[2]) if found else 0))
            columns = [pa.array(x) for x in zip(*rows, strict=True)]
            none = lambda kind, size: pa.nulls(size, kind)
            yield pa.record_batch(
                [part.column(0), pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), *[c.cast(_ROW.field(k + 3).type) for k, c in enumerate(columns)],
                 none(pa.int64(), n), none(pa.int64(), n), none(pa.binary(), n)],
                schema=_ROW,
            )
            if chunks:
                yield from _pair_rows(block, n, Csr(np.array(ptr), np.concatenate(chunks), np.concatenate(often), len(known)), known)
            block += 1

    return run


def _pair_rows(block: int, n_docs: int, held: Csr, known: Chunks) -> Iterator[pa.RecordBatch]:
    """Documents by chunks times chunks by pairs: a row per pair with how many documents hold it, and a row with all that they hold."""
    names, column = np.unique(known.pairs, return_inverse=True)
    docs, pairs, times = _all(held.products(Csr(known.pair_ptr, column, known.times, len(names))))
    order = np.argsort(pairs, kind="stable")
    docs, pairs, times = docs[order], pairs[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(pairs)]]))
    rows = lambda n, **own: pa.record_batch([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(n, f.type) for f in _ROW], schema=_ROW)
    for k in range(0, len(first), 10_000):
        n = len(first[k : k + 10_000])
        yield rows(n, block=np.full(n, block), pair=names[pairs[first[k : k + n]]], docs=sizes[k : k + n])
    # Here ``at`` is how many documents the block has, and ``docs`` how many entries the matrix.
    yield rows(1, block=[block], at=[n_docs], docs=[len(docs)], held=[_packed(np.repeat(np.arange(len(first)), sizes), docs, times, n_docs)])


def _packed(pairs: np.ndarray, docs: np.ndarray, times: np.ndarray, n_docs: int) -> bytes:
    """A block's entries, ordered by pair and document; pairs are numbered without gaps.

    Differences of places (rows are pairs, columns documents) and times, their
    bytes by significance: most are small, so these compress to about a byte an entry.
    """
    steps = np.diff(pairs * n_docs + docs, prepend=0)
    return pa.compress(np.stack([steps, times]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(held: bytes, entries: int, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, documents, times) of :func:`_packed`."""
    raw = np.frombuffer(pa.decompress(held, decompressed_size=8 * entries, codec="zstd"), np.uint8)
    steps, times = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(2, -1).astype(np.int64)
    pairs, docs = np.divmod(np.cumsum(steps), n_docs)
    return pairs, docs, times


_SUMS = "block long, at int, n_best long, count_sum long"


def _sums(met: pa.Table, held: pa.Table) -> pa.Table:
    """Of one block's pairs with their counts, and its matrix: per document the links of best pairs, and the sum of all links' counts."""
    block, n_docs, entries, packed = (held.column(name)[0].as_py() for name in ("of", "at", "docs", "held"))
    order = np.argsort(met.column("pair").to_numpy())
    count, best = met.column("count").to_numpy()[order], met.column("best").to_numpy()[order].astype(np.int64)
    pairs, docs, times = _unpacked(packed, entries, n_docs)
    out = np.zeros((2, n_docs), np.int64)
    np.add.at(out[0], docs, times * best[pairs])
    np.add.at(out[1], docs, times * count[pairs])
    return pa.table({"block": pa.array(np.full(n_docs, block)), "at": pa.array(np.arange(n_docs, dtype=np.int32)), "n_best": out[0], "count_sum": out[1]})


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents each id pair is linked, and whether no pair of its A id is in more."""
    counted = keep(pairs.groupBy("pair").agg(F.sum("docs").alias("count")), "pair-counts")
    own = F.shiftright("pair", 32)
    # A row per id of A, so a vocabulary at most; an id has a row per id of B at most.
    most = counted.groupBy(own.alias("a")).agg(F.max("count").alias("most"))
    return counted.join(most, own == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, ...): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links.

    ``n_group_links`` counts the token pairs that share a group. A null or empty
    text, and one whose tokens don't spell it, has zeros and an empty digest. A
    row counts as a document, also one that is repeated or has no doc_id. Other
    columns are ignored; an empty table gives an empty result. A text without a
    space that ends a chunk is encoded whole.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = keep(plain.mapInArrow(_encoded(path_a, path_b), _SCHEMA), "aligned")
    pairs = encoded.where("pair is not null").select("block", "pair", "docs")
    met = pairs.select("block", "pair").join(pair_counts(pairs), "pair").select("block", "pair", "count", "best")
    held = encoded.where("held is not null").select(F.col("block").alias("of"), "at", "docs", "held")
    sums = met.groupBy("block").cogroup(held.groupBy("of")).applyInArrow(_sums, _SUMS)
    rows = encoded.where("pair is null and held is null").select("doc_id", "block", "at", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return rows.join(sums, ["block", "at"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", "n_group_links"
    )


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, count, best) of all id pairs that are linked in some document, by the number of documents."""
    plain = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs = plain.mapInArrow(_encoded(path_a, path_b), _SCHEMA).where("pair is not null").select("pair", "docs")
    return pair_counts(pairs).select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "count", "best")
