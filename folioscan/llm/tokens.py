"""Token ids by public tokenizers, with a cache of what stands between spaces.

Neither tokenizer joins anything across white space that follows other
characters, so ids of such chunks can be kept.  A text with characters outside
a set for which this is known to be exact goes to the tokenizer as a whole.

Ids of one text come as bytes of little-endian unsigned 32-bit numbers.  Many
texts are cut, looked up and put together as Arrow and numpy arrays, without a
Python object for each chunk.  Tokenizer files are named by path and are opened
once in each Python worker.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from folioscan.llm.common import blocks

KEPT = 400_000  # chunks, in each Python worker, of each generation
KEPT_BYTES = 1 << 26  # of chunks that are kept as arrays
PIECE = 1 << 20  # characters
TOGETHER = 1 << 23  # characters of texts that are cut at once

# Letters of Latin scripts that any Unicode version lowers and composes alike, and printable ASCII.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0132-\u0148\u014a-\u017e]*")
LETTERS = "a-z\xdf-\xf6\xf8-\u017e"
# What the tokenizer's file cuts a lower-case text by, for the characters above.
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+")


class Kept(dict):
    """Ids of chunks, remembered; two generations bound the memory."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        self[chunk] = ids
        return ids

    def join(self, chunks: list[str]) -> bytes:
        out = b"".join(map(self.__getitem__, chunks))
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()
        return out


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> Callable[[str], bytes]:
    """Ids of a text by a tokenizer of word-end BPE (``word_bpe_49k.json``)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    whole = Tokenizer.from_file(path)
    model = whole.model
    letters = _byte_letters()

    def one(word: str) -> bytes:
        seen = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
        return packed([t.id for t in model.tokenize(seen)])

    def several(chunk: str) -> bytes:
        words = WORD.findall(chunk)
        return one(chunk) if len(words) == 1 else b"".join(map(chunks.__getitem__, words))

    chunks = Kept(several)

    def encode(text: str) -> bytes:
        if not PLAIN.fullmatch(text) or "<|" in text:
            return packed(whole.encode(text, add_special_tokens=False).ids)
        return b"".join(chunks.join(part.split()) for part in pieces(text.lower()))

    return encode


class Vocabulary:
    """Ids of chunks, remembered as arrays.  Of the chunks that are new, those
    from white space to the end of a word go to the tokenizer as one text; the
    sizes of its tokens tell which ids are whose."""

    def __init__(self, encode: Callable[[str], list[int]], sizes: np.ndarray):
        self.encode, self.sizes = encode, sizes
        self._forget()

    def _forget(self) -> None:
        self.chunks = pa.array([], pa.binary())
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: pa.BinaryArray) -> np.ndarray:
        """Adds chunks; where each of them is now."""
        ends, raw = _bytes(new)
        alone = (raw[ends[:-1]] > 0x20) | (raw[ends[1:] - 1] <= 0x20)
        order = np.argsort(alone, kind="stable")
        place = np.empty(len(new), np.int64)
        place[order] = len(self.chunks) + np.arange(len(new))
        new = new.take(pa.array(order))
        ends, raw = _bytes(new)
        together = len(new) - int(alone.sum())
        ids = np.array(self.encode(raw[:ends[together]].tobytes().decode()), np.int32)
        counts = np.searchsorted(np.cumsum(self.sizes[ids]), ends[1:together + 1]) + 1
        single = [np.array(self.encode(chunk.decode()), np.int32) for chunk in new[together:].to_pylist()]
        last = self.ends[-1] + len(ids)
        self.ends = np.concatenate([self.ends, self.ends[-1] + counts, last + np.cumsum([len(x) for x in single], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids, *single])
        self.chunks = pa.concat_arrays([self.chunks, new])
        return place

    def join(self, chunks: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, and where those of each begin and end."""
        known = pc.index_in(chunks.dictionary, value_set=self.chunks)
        place = known.fill_null(-1).to_numpy().astype(np.int64)
        if known.null_count:
            place[place < 0] = self._learn(chunks.dictionary.filter(known.is_null()))
        out = self._gather(place[chunks.indices.to_numpy()])
        if _too_many(chunks.dictionary):
            self._forget()
        elif _too_many(self.chunks):
            self.ids, self.ends = self._gather(place)
            self.chunks = chunks.dictionary
        return out

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.ends[place]
        counts = self.ends[place + 1] - begin
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(begin - ends[:-1], counts)
        at += np.arange(ends[-1])
        return self.ids[at], ends


def _bytes(chunks: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each chunk ends, from 0 on, and their bytes."""
    _, ends, raw = chunks.buffers()
    return np.frombuffer(ends, np.int32)[:len(chunks) + 1], np.frombuffer(raw, np.uint8)


def _too_many(chunks: pa.BinaryArray) -> bool:
    return len(chunks) > KEPT or chunks.nbytes > KEPT_BYTES


def cut(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Chunks of plain texts (white space and what follows it up to the next),
    and the number of chunks before each text and after the last."""
    data = b"".join(texts)
    bounds = np.cumsum([0, *map(len, texts)])
    space = np.frombuffer(data, np.uint8) <= 0x20
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = space[1:] & ~space[:-1]
    begins[bounds] = True
    at = np.flatnonzero(begins)
    chunks = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    return chunks.dictionary_encode(), np.searchsorted(at, bounds)


@lru_cache(maxsize=4)
def byte_bpe_all(path: str, pattern: str) -> Callable[[list[str]], Iterator[np.ndarray]]:
    """Ids of each of many texts by byte-level BPE ranks in a ``.tiktoken`` file."""
    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(token) for token in ranks]
    vocabulary = Vocabulary(whole.encode_ordinary, sizes)

    def encode(texts: list[str]) -> Iterator[np.ndarray]:
        for a, b in blocks([len(text) for text in texts], TOGETHER):
            plain = [bool(PLAIN.fullmatch(text)) for text in texts[a:b]]
            chunks, bounds = cut([text.encode() if p else b"" for text, p in zip(texts[a:b], plain)])
            ids, ends = vocabulary.join(chunks)
            for text, p, begin, end in zip(texts[a:b], plain, ends[bounds[:-1]], ends[bounds[1:]]):
                yield ids[begin:end] if p else np.array(whole.encode_ordinary(text), np.int32)

    return encode


def byte_bpe(path: str, pattern: str) -> Callable[[str], bytes]:
    """Ids of a text by byte-level BPE ranks in a ``.tiktoken`` file."""
    every = byte_bpe_all(path, pattern)
    return lambda text: next(every([text])).astype("<u4").tobytes()


def pieces(text: str) -> list[str]:
    """Consecutive parts of about ``PIECE`` characters, cut at spaces."""
    out, begin = [], 0
    while begin < len(text):
        end = text.find(" ", begin + PIECE)
        end = len(text) if end < 0 else end
        out.append(text[begin:end])
        begin = end
    return out


def _byte_letters() -> dict[int, int]:
    """The visible character that stands for each byte in byte-level BPE: a
    printable Latin-1 character for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 0x100 + i for i, b in enumerate(rest)}
