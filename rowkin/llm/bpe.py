"""BPE encoding and decoding (10) by forced-boundary splitting.

No merge can join two bytes that stand side by side in no vocabulary token. Wherever a text has such a pair, a cut is
certain: the fragments on both sides are encoded independently and their ids concatenated, with the same result as merging
over the whole piece. Fragments recur, so each worker remembers their encodings.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm import _pretokens
from rowkin.llm._io import pieces
from rowkin.llm._merges import Merges

#: Distinct pieces a worker remembers before it starts afresh; bounds memory, not results.
MEMO = 500_000
_coders: dict[str, "ForcedBoundaryBpe"] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class ForcedBoundaryBpe:
    """A byte-level BPE vocabulary with word ends, its merges and the byte pairs that some token holds."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.kinds = tokenizer.normalizer, _pretokens.classes_of(tokenizer.pre_tokenizer)
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens that take neighbouring characters, or are normalized, are not supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in letters], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges([(self.vocab[a], self.vocab[b]) for a, b in pairs], [self.vocab[a + b] for a, b in pairs], len(self.vocab))
        number = {c: i for i, c in enumerate(letters)}
        self.joined = np.zeros((256, 256), bool)
        for token in self.vocab:
            bare = [number[c] for c in (token.removesuffix(self.end) if self.end else token)]
            self.joined[bare[:-1], bare[1:]] = True
        self.shown = {i: t for t, i in self.vocab.items()}
        self.clear()

    def clear(self) -> None:
        self.memo = _pretokens.Memo()
        self.ids_text: list[str] = []
        self.tokens_text: list[str] = []

    def learn(self, data: np.ndarray, lens: np.ndarray) -> None:
        """Encode pre-tokens (bytes one after another): cut wherever no token holds both neighbours, merge the fragments."""
        ends = np.cumsum(lens)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.joined[data[:-1], data[1:]]
        cut[0] = True
        cut[ends] = True
        edges = np.flatnonzero(cut)
        ids, lens = self.merges.apply(symbols, np.diff(edges))
        total = np.zeros(len(edges), np.int64)
        np.cumsum(lens, out=total[1:])
        bounds = [0, *total[np.searchsorted(edges, ends)].tolist()]
        listed = ids.tolist()
        text, shown = list(map(str, listed)), list(map(self.shown.__getitem__, listed))
        self.ids_text += [" ".join(text[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        self.tokens_text += [" ".join(shown[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]

    def normal(self, text: str) -> str:
        """Composed and in lower case letter by letter (so no final sigma); white space only parts pre-tokens anyway."""
        if text.isascii():
            return text.lower()
        if max(text) >= "\u0860":  # scripts whose tables changed between versions of Unicode
            return self.normalizer.normalize_str(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def places(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """(place in the memo of every pre-token of all texts, bounds of each text's)."""
        raw = [t.encode("utf-8", "surrogatepass") for t in map(self.normal, texts)]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)), out=offsets[1:])
        if not len(data):
            return [], np.zeros(len(offsets), np.int64)
        cps, at = _pretokens.code_points(data, offsets)
        starts, ends = _pretokens.word_level_spans(cps, at, self.kinds)
        keys, first, which = _pretokens.distinct_pieces(cps, starts, ends)
        if len(self.memo) > MEMO:
            self.clear()
        places, new = self.memo.places_of(keys)
        if len(new):
            self.learn(*_pretokens.piece_bytes(data, starts[first[new]], ends[first[new]]))
        return places[which].tolist(), np.searchsorted(starts, at)

    def encode_many(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids joined by a space, decoded text) of each text."""
        parts: list[str] = []
        cut: dict[int, list[str]] = {}  # texts that hold special tokens, which the library takes out first
        for i, text in enumerate(texts):
            if any(s in text for s in self.special) and len(split := self.special_split.split(text)) > 1:
                cut[i] = split
                parts += split[::2]
            else:
                parts.append(text)
        places, bounds = self.places(parts)
        spans = zip(bounds.tolist(), bounds[1:].tolist(), strict=False)
        out, ids_of, tokens_of = [], self.ids_text.__getitem__, self.tokens_text.__getitem__
        for i in range(len(texts)):
            ids, tokens = [], []
            for special in [*cut[i][1::2], None] if i in cut else [None]:
                a, b = next(spans)
                ids += map(ids_of, places[a:b])
                tokens += map(tokens_of, places[a:b])
                if special:
                    ids.append(str(self.special[special]))
                    tokens.append(special)
            out.append((" ".join(ids), " ".join(tokens)))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_many([text])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder, so tokens are joined by one space; unknown ids are left out."""
        by_id = self.shown | {i: t for t, i in self.special.items()}
        return " ".join(by_id[i] for i in ids if i in by_id)


def coder(path: str) -> ForcedBoundaryBpe:
    if path not in _coders:
        _coders[path] = ForcedBoundaryBpe(path)
    return _coders[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, digests: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text", 1 << 20):
            got = coder(path).encode_many([t or "" for t in batch.column("text").to_pylist()])
            n = pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in got], pa.int64())
            if digests:
                made = [pa.array([hashlib.sha256(x[k].encode("utf-8", "surrogatepass")).hexdigest() for x in got]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, *made], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ids = pa.array([[int(i) for i in x.split()] for x, _ in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, ids, pa.array([y for _, y in got])], ["doc_id", "n_tokens", "ids", "decoded"])


def _encodable(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded string of every document (doc_id, text).

    A null or empty text has no tokens and decodes to the empty string; every row, repeated or not, gives one row; other
    columns are ignored. No shuffle.
    """
    return _encodable(docs).mapInArrow(lambda it: _encoded(it, path, False), "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode``, with SHA-256 digests of the ids (decimal, joined by one space) and of the decoded text."""
    return _encodable(docs).mapInArrow(
        lambda it: _encoded(it, path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
