"""Whole texts to token ids, in Arrow batches.

In vocabularies with the rules of ``_RULES`` white space always ends a token, so the
ids of a text are the ids of its white-space-free chunks, one after the other.
With any other rules a text is encoded whole.
Natural text repeats its chunks: each worker encodes a chunk once with the
tokenizers library and then only looks it up.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker remembers this many distinct chunks at least, and twice as many at most.
REMEMBERED = 150_000
#: Within a plain ASCII chunk the vocabulary's own splitting rule reduces to this.
_ASCII_PIECE = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
#: How a byte is written in a byte-level vocabulary: printable bytes as themselves, the rest from U+0100 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _SELF} | {
    b: chr(0x100 + k) for k, b in enumerate(x for x in range(0x100) if x not in _SELF)
}

# The rules of a vocabulary file for which the short cuts below are right.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None, "truncation": None, "padding": None,
}


def known_rules(path: str) -> bool:
    """Whether a vocabulary file splits and lower-cases text as the short cuts do; if not, texts are encoded whole."""
    with open(path, encoding="utf-8") as file:
        written = json.load(file)
    special = all("<|" in t["content"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in written["added_tokens"])
    return special and written["model"]["type"] == "BPE" and not written["model"].get("dropout") and all(written.get(k) == v for k, v in _RULES.items())


class _Chunks(dict):
    """Chunk to ids, as bytes of unsigned 32-bit integers; learns what it lacks.

    When it is full, its content becomes ``older``, from where a chunk that is
    met again returns: frequent chunks stay.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.short_cuts = known_rules(path)
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._learn(chunk)
        self[chunk] = ids
        return ids

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()

    def _piece(self, piece: str) -> bytes:
        """Ids of one lower-case piece that the vocabulary's splitting rule leaves whole."""
        ids = self.get(piece) or self.older.get(piece)
        if ids is None:
            written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARS)
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()
            self[piece] = ids
        return ids

    def _learn(self, chunk: str) -> bytes:
        """By its pieces where these are plain to see, else by encoding the chunk as a whole."""
        if chunk.isascii() and chunk.isprintable() and "'" not in chunk and "<|" not in chunk:
            return b"".join([self._piece(p) for p in _ASCII_PIECE.findall(chunk.lower())])
        stem, end = (chunk[:-1], [chunk[-1]]) if chunk[-1] in ".," else (chunk, [])
        # Lower case letter by letter, as the vocabulary does it.
        low = "".join([c.lower() for c in stem])
        if low.isalpha() and unicodedata.is_normalized("NFC", stem):
            return b"".join([self._piece(p) for p in [low, *end]])
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()


class ChunkEncoder:
    """Encodes columns of text with ``tokenizers`` and a memory of chunks."""

    def __init__(self, path: str):
        self.known = _Chunks(path)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and the offsets of the texts (one more than texts)."""
        if not self.known.short_cuts:
            own = [[*e.ids, end] for e in self.known.tokenizer.encode_batch(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in own for i in ids], np.uint32), np.cumsum([0, *map(len, own)])
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = chunks.offsets.to_numpy().astype(np.int64)
        flat = chunks.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        self.known.trim()
        words = pa.array(list(map(self.known.__getitem__, flat.dictionary.to_numpy(zero_copy_only=False))), pa.large_binary())
        taken = words.take(flat.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) // 4
        ids = np.frombuffer(taken.buffers()[2], np.uint32, ends[-1]) if ends[-1] else np.empty(0, np.uint32)
        offsets = ends[bounds - bounds[0]]
        return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file; its memory lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
