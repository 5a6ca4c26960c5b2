"""Token ids of a public byte-level BPE file, by the tokenizers library.

Chunks are cut where the library's pre-tokenizer always cuts, so joining their
ids gives the ids of the whole text. Arrow cuts many texts at once and numbers
the distinct chunks; the library encodes each of those, and a bounded cache
keeps its answers between batches. Texts where white space alone can't tell the
cuts are encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

#: Where cuts depend on more than one character: runs of white space, white space at an end, other white space; and our own marks.
_WHOLE = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\x00\x01\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MANY_BYTES = 6 << 20
_LETTERS = re.compile(r"[\n\x00]?([A-Za-zÀ-ÖØ-öø-ÿ]+)\Z")
#: Between a letter and a mark there is always a cut.
_BEFORE_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?|#*$%&])"
_CHUNK_CHARS = 64
_WORKER: dict[tuple[str, bool, int], "Encoder"] = {}


class _Chunks(dict):
    """chunk -> its ids as little-endian 32-bit bytes; two generations bound the memory.

    A chunk stands after a space, unless it starts with a line feed, \\0 (first of
    a text) or \\1 (after a cut within a word).
    """

    def __init__(self, encode, word, bound: int):
        super().__init__()
        self.encode, self.word, self.bound, self.old = encode, word, bound, {}
        self.feed = encode("\n")

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            letters, mark = _LETTERS.match(chunk), chunk[:1]
            if letters:
                ids = self.word(letters[1], mark not in ("\n", "\x00"))
                ids = self.feed + ids if mark == "\n" else ids
            else:
                ids = self.encode(chunk[1:] if mark in ("\x00", "\x01") else chunk if mark == "\n" else " " + chunk)
        if len(chunk) <= _CHUNK_CHARS:
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """ids of whole texts, as the library gives them with add_special_tokens=False.

    special_as_text: strings of special tokens in a text are ordinary text; else they are the special tokens.
    """

    def __init__(self, path: str, special_as_text: bool = False, bound: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = added
        #: Letters as the pre-tokenizer spells their bytes, so that the model takes a word directly.
        spelled = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = {c: "".join(p for p, _ in spelled(chr(c)))[-2:] for c in range(0xC0, 0x100) if chr(c).isalpha()}
        self.space = "".join(p for p, _ in spelled(" a"))[:-1]
        assert self.tokenizer.normalizer is None
        self.model = self.tokenizer.model
        self.packed = [struct.Struct(f"<{n}I").pack for n in range(16)]
        self.chunks = _Chunks(self.whole, self.word, bound)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str, spaced: bool) -> bytes:
        """Ids of a word of letters, one pre-token, after a space or not."""
        word = word if word.isascii() else word.translate(self.spelling)
        ids = [t.id for t in self.model.tokenize(self.space + word if spaced else word)]
        return self.packed[len(ids)](*ids) if len(ids) < 16 else np.array(ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit bytes."""
        return self._batch(pa.array([text or ""], pa.large_string()))[0].tobytes()

    def many(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, ids of each text as little-endian unsigned 32-bit numbers), some megabytes of text at a time; null texts are empty."""
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy()
        start = 0
        while start < len(texts):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + _MANY_BYTES, side="right")))
            yield start, self._batch(pc.fill_null(texts[start:stop].cast(pa.large_string()), ""))
            start = stop
        give_back()

    def _batch(self, column: pa.Array) -> list[np.ndarray]:
        out: list = [np.zeros(0, dtype="<u4")] * len(column)
        empty, alone = pc.equal(column, ""), pc.match_substring_regex(column, _WHOLE)
        for mark in self.added:
            alone = pc.or_(alone, pc.match_substring(column, mark))
        for i in pc.indices_nonzero(pc.and_not(alone, empty)).to_pylist():
            out[i] = np.frombuffer(self.whole(column[i].as_py()), dtype="<u4")
        at = pc.indices_nonzero(pc.invert(pc.or_(alone, empty))).to_numpy()
        if len(at):
            marked = pc.binary_join_element_wise(pa.scalar("\x00", pa.large_string()), pc.replace_substring(column.take(pa.array(at)), "\n", " \n"), pa.scalar("", pa.large_string()))
            parts = pc.split_pattern(marked, " ")
            chunks = parts.flatten().dictionary_encode()
            pieces = pc.split_pattern(pc.replace_substring_regex(chunks.dictionary, _BEFORE_MARK, "\\1 \x01\\2"), " ")
            distinct = pieces.flatten().dictionary_encode()
            ids = pa.array(list(map(self.chunks.__getitem__, distinct.dictionary.to_pylist())), pa.large_binary()).take(distinct.indices)
            _, at_byte, data = ids.buffers()
            bounds = np.frombuffer(at_byte, dtype="<i8", count=len(ids) + 1)[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
            of_chunk = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype("<i8")), data])
            size = np.diff(bounds)[chunks.indices.to_numpy()]
            joined = of_chunk.take(chunks.indices)
            data = np.frombuffer(joined.buffers()[2], dtype="<u4") if size.sum() else np.zeros(0, dtype="<u4")
            ends = np.concatenate([[0], np.cumsum(size) // 4])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
            for i, a, b in zip(at.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                out[i] = data[a:b]
        return out


def encoder(path: str, special_as_text: bool = False, bound: int = 250_000) -> Encoder:
    """One per worker process, kept between tasks."""
    key = (path, special_as_text, bound)
    if key not in _WORKER:
        _WORKER[key] = Encoder(*key)
    return _WORKER[key]
