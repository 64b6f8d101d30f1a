"""Whole-text encoding with a public byte-level BPE, one Arrow slice at a time.

Every id comes from the `tokenizers` library. A slice is cut, by its bytes, where the byte-level pre-tokenizer
always has a bound: before a run of blanks (space, tab, newline, carriage return) that follows a character which is
no white space, before the last blank of a run that such a character follows, and between a letter of A-Z or a-z and
a punctuation mark, as a run of letters ends there. The parts can be encoded apart;
equal parts of a slice are encoded once, and a worker keeps the short ones that it has encoded. A run that meets a
character some definition calls white space is not cut behind its start.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHORT = 48  # characters of a part that is kept
MARKS = b".,;:!?)"


def cuts(data: np.ndarray, offsets: np.ndarray, heads: bytes = b"", marks: bytes = MARKS) -> np.ndarray:
    """The places, ascending, at which UTF-8 texts (data[offsets[i]:offsets[i + 1]]) fall into parts; with all offsets.

    heads: the bytes that added tokens begin with. Text ends before such a token, so a run before it is one part.
    marks: punctuation that may follow a letter in no added token.
    """
    n = len(data)
    blank = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    # characters that may count as white space: controls, U+0085, U+00A0 and some of U+1680, U+180E, U+2000-205F, U+3000
    odd = (data < 32) & ~blank
    wide = np.flatnonzero(data >= 0xC2)
    wide = wide[wide + 1 < n]
    lead, second = data[wide], data[wide + 1]
    two = wide[(lead == 0xC2) & ((second == 0x85) | (second == 0xA0))]
    three = wide[((lead == 0xE1) & ((second == 0x9A) | (second == 0xA0))) | ((lead == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((lead == 0xE3) & (second == 0x80))]
    for places, size in ((two, 2), (three, 3)):
        for k in range(size):
            odd[np.minimum(places + k, n - 1)] = True
    plain = ~blank & ~odd
    first = np.zeros(n + 1, bool)  # whether a text starts here
    first[offsets] = True
    begins = first[:n]
    start = blank.copy()  # a run starts: the byte before is plain
    start[1:] &= plain[:-1]
    start[:1] = False
    last = blank.copy()  # a run's last blank, before a plain byte of the same text
    last[:-1] &= plain[1:] & ~begins[1:]
    for head in heads:
        last[:-1] &= data[1:] != head
    last[-1:] = False
    after = np.zeros(n, bool)  # behind a run whose last blank is no space
    after[1:] = last[:-1] & (data[:-1] != 32)
    mark = np.isin(data, np.frombuffer(marks, np.uint8))
    mark[1:] &= ((data[:-1] | 32) >= 97) & ((data[:-1] | 32) <= 122)
    mark[:1] = False
    return np.flatnonzero(np.append(start | last | after | mark, False) | first)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class SliceEncoder:
    """Encodes string arrays to (ids, offsets); keeps up to `keep` distinct parts."""

    def __init__(self, path: str, keep: int = 600_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tok, self.keep = Tokenizer.from_file(path), keep
        self.model = self.tok.model
        self.letters = _byte_letters()
        self.space = self.letters[32]
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.heads = bytes({t.encode()[0] for t in added})
        inside = re.compile(f"[A-Za-z][{re.escape(MARKS.decode())}]")
        self.marks = b"" if any(map(inside.search, added)) else MARKS
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.size, self.flat = array("q"), array("I")

    def _ids(self, part: str) -> list[int]:
        space = part[:1] == " "
        if (part[1:] if space else part).isalpha():  # one pre-token: the merges alone
            if part.isascii():  # of these letters and the space, the space alone has another sign
                return [t.id for t in self.model.tokenize(self.space + part[1:] if space else part)]
            return [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
        return self.tok.encode(part, add_special_tokens=False).ids

    def _add(self, ids: list[list[int]]) -> range:
        """Keep the ids of some parts; their places."""
        n = len(self.size)
        self.size.extend(map(len, ids))
        self.flat.extend(chain.from_iterable(ids))
        return range(n, len(self.size))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32) and the offsets of each text; null is empty."""
        if len(self.index) > self.keep:
            self.clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offs[0] == offs[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        at = cuts(data, offs, self.heads, self.marks)
        parts = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data)]).dictionary_encode()
        bounds = np.searchsorted(at, offs)
        index = self.index
        words = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(known < 0).tolist()
        short = [i for i in new if len(words[i]) <= SHORT]
        known[short] = places = self._add([self._ids(words[i]) for i in short])
        index.update(zip((words[i] for i in short), places, strict=True))
        kept = len(self.size), len(self.flat)
        long = [i for i in new if len(words[i]) > SHORT]  # long parts are held for this slice alone
        known[long] = self._add([self._ids(words[i]) for i in long])
        used = known[parts.indices.to_numpy(zero_copy_only=False)]
        size, flat = np.array(self.size), np.asarray(self.flat)
        start = np.cumsum(size) - size
        n = size[used]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(start[used] - ends[:-1], n) + np.arange(ends[-1])]
        del flat  # a view, which would keep the array from shrinking
        del self.size[kept[0] :], self.flat[kept[1] :]
        return ids, ends[bounds]


_encoders: dict[str, SliceEncoder] = {}


def encoder(path: str) -> SliceEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = SliceEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text's ids."""
    n = len(offsets) - 1
    return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(n + 1)


def binary_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose item i holds the bytes of values[offsets[i]:offsets[i + 1]]."""
    at = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def rows_of(batches: Iterator[pa.RecordBatch], path: str, end_id: int, limit: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For each slice of (..., text): the slice, the ids with end_id, the offsets."""
    from terraloom.llm.common import text_slices

    enc = encoder(path)
    for part in text_slices(batches, "text", limit):
        yield part, *with_end(*enc.encode(part.column(part.schema.get_field_index("text"))), end_id)
