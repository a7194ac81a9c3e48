"""Token ids of whole texts from a vocabulary file of the tokenizers library.

The library does the encoding.  Texts of plain characters are cut at white space first, which the
file's pre-tokenizer never joins across; Arrow finds the distinct chunks of a few MB of texts, and the words in
them that a worker doesn't remember go to the library together.  Any other text, and any vocabulary that doesn't
work this way, goes to the library whole.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from geolith.llm.bpe import byte_of_char

#: Words that a worker remembers at most.
REMEMBERED = 500_000
#: Longer words are not remembered.
LONGEST = 48
#: Marks that may follow a word within a chunk.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The bytes of plain texts in UTF-8: printable ASCII, white space and the letters below U+0240.
PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), *range(0xC2, 0xC9)])

#: Bytes as the characters that stand for them in a byte-level vocabulary; a space stays, as it parts words.
BYTE_CHARS = {b: c for c, b in byte_of_char().items()} | {32: " "}


def _fast(tokenizer: Tokenizer, text: str) -> np.ndarray:
    """The ids of a text; the library's fast call leaves out offsets, which nothing here reads."""
    return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of the pool that ``at`` names, one after the other, and their lengths."""
    lengths = sizes[at]
    ends = np.cumsum(lengths)
    where = np.repeat(starts[at] - (ends - lengths), lengths)
    where += np.arange(len(where))
    return pool[where], lengths


def _after(chunks: pa.Array, words: pa.Array) -> pa.Array:
    """What follows the word in each chunk, which begins with it."""
    (starts, ends), (word_starts, word_ends) = _offsets(chunks), _offsets(words)
    sizes = (ends - starts) - (word_ends - word_starts)
    data, _ = _gathered(np.frombuffer(chunks.buffers()[2] or b"", np.uint8), ends - sizes, sizes, np.arange(len(chunks)))
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.StringArray.from_buffers(len(chunks), pa.py_buffer(offsets), pa.py_buffer(data))


def _listed(strings: pa.Array) -> list[str | None]:
    """to_pylist() without a Scalar for each string."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _offsets(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    all_of = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return all_of[:-1], all_of[1:]


class WordTokens:
    """Encoder for a vocabulary given as the JSON text of its file; truncation and padding are off."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(vocabulary)
        # Letters below U+0240 are in NFC, and lower-casing them needs no context; U+0130 alone becomes two characters.
        self.special = ["\u0130", *(t["content"] for t in spec["added_tokens"])]
        suffix = spec["model"].get("end_of_word_suffix")
        ids = spec["model"]["vocab"]
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for token, i in ids.items() if suffix and token.endswith(suffix)]] = True
        self._forget()
        self.plain_words = self._without_steps(spec)
        self.chunked = bool(suffix) and self._cuts_at_white_space(spec)

    def _ids(self, text: str) -> np.ndarray:
        return _fast(self.tokenizer, text)

    def _without_steps(self, spec: dict) -> Tokenizer | None:
        """The same model for words that are in lower case and cut already, in the vocabulary's own characters.

        Only for files whose last step is the byte-level one; their words need no normalizer or pattern.
        """
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if not steps or steps[-1].get("type") != "ByteLevel" or steps[-1].get("add_prefix_space"):
            return None
        return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": [], "truncation": None, "padding": None}))

    def _ids_of_words(self, words: list[str]) -> np.ndarray:
        if self.plain_words is None:
            return self._ids(" ".join(words))
        text = " ".join(words)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(BYTE_CHARS)
        return _fast(self.plain_words, text)

    def _cuts_at_white_space(self, spec: dict) -> bool:
        """White space must be dropped, and words, marks and chunks be independent of what stands around them."""
        if spec.get("post_processor"):
            return False
        probe = ["it's", "(x)", "Ab1.", "...", "\u00e9!", "x"]
        word_list = ["its", "na\u00efve", "x", "\u00e9"]
        if self._ids_of_words(word_list).tolist() != self._ids(" ".join(word_list)).tolist():
            return False
        same = lambda whole, parts: self._ids(whole).tolist() == [i for part in parts for i in self._ids(part).tolist()]
        return same("\n ".join(probe), probe) and same("A B", ["a\tb"]) and same("one,\" two", ["one", ",\"", "two"])

    def is_plain(self, text: str) -> bool:
        return not text.encode("utf-8", "replace").translate(None, PLAIN) and not any(t in text for t in self.special)

    def _learn(self, words: list[str]) -> None:
        """Letters only: each word's last token alone has the suffix of a word's end."""
        ids = self._ids_of_words(words)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            each = [self._ids(w) for w in words]
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        first = len(self.bounds) - 1
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + ends])
        self.pool = np.concatenate([self.pool, ids])
        self.words.update(zip(words, range(first, first + len(words)), strict=True))

    def _forget(self) -> None:
        """words: a number for each word, whose ids are those of the pool between two bounds."""
        self.words: dict[str, int] = {}
        self.pool, self.bounds = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _of_words(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words of letters; those that are not remembered are learned together."""
        found = np.array(list(map(self.words.get, words, itertools.repeat(-1))), np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            if len(self.bounds) > REMEMBERED:
                self._forget()
                new = np.arange(len(words))
            first = len(self.bounds) - 1
            learned = [words[i] for i in new.tolist()]
            self._learn(learned)
            found[new] = first + np.arange(len(new))
            for word in learned:
                if len(word) > LONGEST:
                    del self.words[word]
        return found

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct chunks, one after the other, and where each chunk's begin and how many they are.

        A chunk is a word of letters and marks after it, or else it goes to the library as it is.
        """
        word = pc.utf8_rtrim(chunks, MARKS)
        alone = pc.utf8_is_alpha(word)
        whole = chunks.filter(pc.invert(alone)).to_pylist()
        words = word.filter(alone).dictionary_encode()
        marks = _after(chunks.filter(alone), words.dictionary.take(words.indices)).dictionary_encode()
        numbers = self._of_words(_listed(words.dictionary))
        n_words, n_marks = len(self.bounds) - 1, len(marks.dictionary)
        others = self._of_each([*marks.dictionary.to_pylist(), *whole, ""])
        pool = np.concatenate([self.pool, *others])
        sizes = np.concatenate([np.diff(self.bounds), [len(x) for x in others]])
        # Two parts for each chunk, the second of which is empty for one that went to the library.
        parts = np.full((len(chunks), 2), len(sizes) - 1, np.int64)
        at = alone.to_numpy(zero_copy_only=False)
        parts[at, 0], parts[at, 1] = numbers[words.indices.to_numpy()], n_words + marks.indices.to_numpy()
        parts[~at, 0] = n_words + n_marks + np.arange(len(whole))
        flat, lengths = _gathered(pool, np.cumsum(sizes) - sizes, sizes, parts.ravel())
        lengths = lengths.reshape(-1, 2).sum(1)
        return flat, np.cumsum(lengths) - lengths, lengths

    def _of_each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers; none for null.

        The chunks of all texts are looked up together: callers pass a few MB of texts at a time.
        """
        listed = _listed(texts)
        out = [b""] * len(listed)
        plain = np.array([bool(t) and self.chunked and self.is_plain(t) for t in listed], bool)
        for i in np.flatnonzero(~plain).tolist():
            if listed[i]:
                out[i] = self._ids(listed[i]).tobytes()
        if plain.any():
            split = pc.utf8_split_whitespace(pc.utf8_lower(texts.filter(pa.array(plain))))
            chunks = split.flatten().dictionary_encode()
            flat, lengths = _gathered(*self._of_chunks(chunks.dictionary), chunks.indices.to_numpy())
            ends = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())]].tolist()
            for i, a, b in zip(np.flatnonzero(plain).tolist(), ends, ends[1:], strict=False):
                out[i] = flat[a:b].tobytes()
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]


_MODELS: dict[int, WordTokens] = {}


def model(vocabulary: str) -> WordTokens:
    """One encoder for each worker process and vocabulary."""
    if (key := hash(vocabulary)) not in _MODELS:
        _MODELS[key] = WordTokens(vocabulary)
    return _MODELS[key]
