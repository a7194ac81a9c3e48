"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary marks a certain cut: no merge can ever join
its two bytes.  A text is split at the pre-tokenizer's boundaries and at these cuts; each fragment is
encoded independently (and remembered while it is common), and the ids are concatenated.  Decoding
looks up the bytes of each id.

Null texts count as empty and give no ids.  Added tokens that stand in a text become their ids.
Nothing is truncated.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.llm.common import map_batches, sliced, small_batches, table

#: The pre-tokenizer's pattern of the public vocabulary file's ByteLevel step.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: The same for texts of simple characters only, on which the two agree: those below U+0250 without
#: numbers that are no digits and without the separators U+001C to U+001F.
SIMPLE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_SIMPLE = "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]"

#: Fragments that a worker remembers at most.
REMEMBERED = 400_000


def byte_of_char() -> dict[str, int]:
    """The bytes that stand behind the printable characters of a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder for a byte-level BPE vocabulary given as the JSON text of its file."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        chars = byte_of_char()
        as_bytes = lambda token: bytes(chars[c] for c in token)
        self.ids = {as_bytes(token): i for token, i in spec["model"]["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault((as_bytes(left), as_bytes(right)), i)
        inside = bytearray(1 << 16)
        for token in self.ids:
            for a, b in zip(token, token[1:], strict=False):
                inside[a << 8 | b] = 1
        self.inside = bytes(inside)
        self.byte_ids = [self.ids.get(bytes([b]), -1) for b in range(256)]
        #: By the pair of ids: the merge's rank, and the id that it makes.
        self.ranks: dict[int, int] = {}
        self.merged: dict[int, int] = {}
        for (left, right), i in self.rank.items():
            if left in self.ids and right in self.ids and left + right in self.ids:
                pair = self.ids[left] << 32 | self.ids[right]
                self.ranks[pair] = i
                self.merged[pair] = self.ids[left + right]
        self.pieces = regex.compile(PIECES).findall
        self.simple_pieces = re.compile(SIMPLE_PIECES).findall
        self.not_simple = re.compile(NOT_SIMPLE).search
        self.added = added
        self.at_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.known: dict[str, bytes] = {}
        self.fragments: dict[bytes, list[int]] = {}

    def cuts(self, piece: bytes) -> list[int]:
        """Positions before which a cut is certain."""
        inside = self.inside
        return [i for i, pair in enumerate(zip(piece, piece[1:], strict=False), 1) if not inside[pair[0] << 8 | pair[1]]]

    def _merge(self, fragment: bytes) -> list[int]:
        """Lowest rank first, leftmost first, until nothing merges."""
        if len(fragment) > 64:
            return self._merge_long(fragment)
        rank, merged, never = self.ranks.get, self.merged, 1 << 30
        at = self.byte_ids
        parts = [at[b] for b in fragment]
        ranks = [rank(a << 32 | b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != never:
            i = ranks.index(best)
            new = parts[i] = merged[parts[i] << 32 | parts[i + 1]]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | new, never)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | parts[i + 1], never)
        return parts

    def _merge_long(self, fragment: bytes) -> list[int]:
        """The same with a heap and links, n log n for very long fragments."""
        import heapq

        n = len(fragment)
        parts: list[bytes | None] = [fragment[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self.rank.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right or parts[i] is None:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := rank((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [self.ids[p] for p in parts if p is not None]

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        fragments = self.fragments
        ids: list[int] = []
        start = 0
        for cut in [*self.cuts(raw), len(raw)]:
            fragment = raw[start:cut]
            got = fragments.get(fragment)
            if got is None:
                got = self._merge(fragment)
                if len(fragment) <= 64:
                    fragments[fragment] = got
            ids += got
            start = cut
        return array("I", ids).tobytes()

    def _plain(self, text: str) -> list[bytes]:
        known = self.known
        pieces = self.pieces(text) if self.not_simple(text) else self.simple_pieces(text)
        try:
            return [known[p] for p in pieces]
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        if len(self.fragments) > REMEMBERED:
            self.fragments.clear()
        out = []
        for p in pieces:
            got = known.get(p)
            if got is None:
                got = self._piece(p)
                if len(p) <= 64:
                    known[p] = got
            out.append(got)
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.added or not any(t in text for t in self.added):
            return b"".join(self._plain(text))
        out = []
        for i, part in enumerate(self.at_added.split(text)):
            out += [np.array([self.added[part]], "<u4").tobytes()] if i % 2 else self._plain(part) if part else []
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the text; those that are no UTF-8 become U+FFFD."""
        raw = b"".join([self.bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw.decode("utf-8", "replace").encode()


_MODELS: dict[int, ForcedBoundaryBPE] = {}


def _model(vocabulary: str) -> ForcedBoundaryBPE:
    """One model for each worker process and vocabulary."""
    if (key := hash(vocabulary)) not in _MODELS:
        _MODELS[key] = ForcedBoundaryBPE(vocabulary)
    return _MODELS[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary_path: str, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all but text, if not given) and ids, binary: little-endian unsigned 32-bit.

    ids replaces a column of that name.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("text", "ids")]
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shipped.value)
        for batch in sliced(batches):
            ids = [model.encode(text or "") for text in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(ids, pa.binary())], [*keep, "ids"])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], "text")
    return map_batches(chosen, run, T.StructType([*chosen.schema.fields[:-1], T.StructField("ids", T.BinaryType())]))


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """encoded with the column text in place of ids; it replaces a column of that name."""
    keep = [c for c in encoded.columns if c not in ("text", "ids")]
    shipped = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shipped.value)
        for batch in sliced(batches):
            texts = [model.decode(ids or b"") for ids in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.binary()).cast(pa.string())], [*keep, "text"])

    chosen = encoded.select(*[F.col(f"`{c}`") for c in keep], "ids")
    return map_batches(chosen, run, T.StructType([*chosen.schema.fields[:-1], T.StructField("text", T.StringType())]))


def op2_bpe(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: one pass that encodes and decodes."""
    path = vocabulary_path or public_tokenizers.path("byte_bpe_50k.json")
    shipped = spark.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shipped.value)
        for batch in sliced(batches):
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                ids = model.encode(text or "")
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(model.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id AS long) AS doc_id", "text")
    return small_batches(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
