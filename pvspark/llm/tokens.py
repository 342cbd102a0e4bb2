"""Token ids of whole texts, with a byte-level BPE file of the tokenizers library.

Texts repeat their words, so each distinct chunk is encoded once per worker and looked up by its 64-bit hash from then on. A chunk begins at a blank
that has no white space on either side: the file's pattern always begins a new pre-token there, so chunks are encoded
independently. Chunks that are one word, or a word and a mark, go straight to the BPE model as the pre-tokens they are; all
others through the whole tokenizer. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import gc
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from pvspark.llm.words import fingerprints

#: So many chunks are remembered; then the memory starts anew.
MOST_CHUNKS = 800_000
#: Text encoded at once, in bytes.
PART = 3 << 20
_MARKS = pa.array([".", ",", ";", ":", "!", "?"])
_SPLIT = re.compile(r"(?<=\S)(?= \S)")


def _byte_letters() -> np.ndarray:
    """Byte-level BPE writes printable bytes as themselves and all others as letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    out = np.zeros(256, np.uint16)
    out[plain], out[rest] = plain, np.arange(256, 256 + len(rest))
    return out


_LETTERS = _byte_letters()
_BLANK = chr(_LETTERS[32])


class Encoder:
    """encode() gives the ids of many texts behind one another."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        # Hashes of chunks, sorted, and the number of each; the ids of chunk k are flat[ends[k] : ends[k + 1]].
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _pretokens(self, words: list[str], blank: str) -> list[list[int]]:
        """Ids of words of letters, each one pre-token."""
        if not words:
            return []
        data = np.frombuffer("\n".join(words).encode(), np.uint8)
        text = np.where(data == 10, np.uint16(10), _LETTERS[data]).astype("<u2").tobytes().decode("utf-16-le")
        return [[t.id for t in x] for x in map(self.tokenizer.model.tokenize, [blank + w for w in text.split("\n")])]

    def _ids(self, given: pa.Array, blank: bool) -> list[list[int]]:
        """Ids of chunks that are new; `blank`: a blank comes before each."""
        marked = pc.is_in(pc.utf8_slice_codeunits(given, -1, 1 << 30), value_set=_MARKS)
        core = pc.if_else(marked, pc.utf8_slice_codeunits(given, 0, -1), given)
        simple = pc.and_(pc.utf8_is_alpha(core), pc.match_substring_regex(core, r"^[A-Za-z\x{C0}-\x{24F}]+$"))
        out = np.empty(len(given), object)
        at = np.flatnonzero(simple.to_numpy(zero_copy_only=False))
        for i, ids in zip(at.tolist(), self._pretokens(core.filter(simple).to_pylist(), _BLANK if blank else ""), strict=True):
            out[i] = ids
        one = {m: self._pretokens([m], "")[0] for m in _MARKS.to_pylist()}
        ended = pc.and_(simple, marked)
        for i, word in zip(np.flatnonzero(ended.to_numpy(zero_copy_only=False)).tolist(), given.filter(ended).to_pylist(), strict=True):
            out[i] += one[word[-1]]
        other = pc.invert(simple)
        whole = [" " + w if blank else w for w in given.filter(other).to_pylist()]
        for i, got in zip(np.flatnonzero(other.to_numpy(zero_copy_only=False)).tolist(), self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            out[i] = got.ids
        return out.tolist()

    def _codes(self, chunks: pa.Array, blank: bool) -> np.ndarray:
        """Numbers of chunks, after adding those that are new; `blank`: a blank comes before each."""
        key = fingerprints(chunks) ^ np.uint64(0x5851F42D4C957F2D * blank)
        at = np.searchsorted(self.keys, key)
        missing = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != key) if len(self.keys) else np.arange(len(key))
        if len(missing):
            new, first = np.unique(key[missing], return_index=True)
            ids = self._ids(chunks.take(pa.array(missing[first])), blank)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
            place = np.searchsorted(self.keys, new)
            self.numbers = np.insert(self.numbers, place, len(self.ends) - 1 + np.arange(len(new)))
            self.keys = np.insert(self.keys, place, new)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
            self.flat = np.concatenate([self.flat, flat])
            at = np.searchsorted(self.keys, key)
        return self.numbers[at]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by `end`, and the offsets of the texts in them. A null is empty."""
        gc.disable()  # a million short lists are made, and none is part of a cycle
        try:
            return self._encode(texts, end)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ends) > MOST_CHUNKS:
            self.forget()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.split_pattern(texts, " ")
        starts = np.asarray(lists.offsets)[: len(lists) + 1].astype(np.int64)
        words = lists.values.slice(starts[0], starts[-1] - starts[0])
        starts = starts - starts[0]
        distinct = words.dictionary_encode()
        kinds, words_at = distinct.dictionary, distinct.indices.to_numpy()
        first = starts[:-1]
        # Not every blank begins a chunk: not if white space is next to it.
        trimmed = pc.or_(pc.equal(pc.binary_length(kinds), 0), pc.not_equal(kinds, pc.utf8_trim_whitespace(kinds))).to_numpy(zero_copy_only=False)
        odd = np.add.reduceat(trimmed[words_at].astype(np.int64), first) > 0 if trimmed.any() else np.zeros(len(texts), bool)
        keep = np.ones(len(words_at), bool)
        keep[first] = False
        if odd.any():
            keep &= ~np.repeat(odd, np.diff(starts))
        used = np.zeros(len(kinds), bool)
        used[words_at[keep]] = True
        of_kind = np.zeros(len(kinds), np.int64)
        of_kind[used] = self._codes(kinds.filter(pa.array(used)), True)
        codes = of_kind[words_at]
        plain = np.flatnonzero(~odd)
        codes[first[plain]] = self._codes(kinds.take(pa.array(words_at[first[plain]])), False)
        if odd.any():
            pieces, sizes, last = [], np.diff(starts), 0
            for i in np.flatnonzero(odd).tolist():
                text = texts[i].as_py()
                own = self._codes(pa.array(_SPLIT.split(text), pa.string()), False) if text else np.zeros(0, np.int64)
                pieces += [codes[last : starts[i]], own]
                last, sizes[i] = starts[i + 1], len(own)
            codes = np.concatenate([*pieces, codes[last:]])
            starts = np.r_[0, np.cumsum(sizes)]
        begin = self.ends[codes]
        size = self.ends[codes + 1] - begin
        total = np.r_[0, np.cumsum(size)]
        offsets = total[starts]
        # The end of text i comes behind its ids and the ends of the texts before it.
        ids = np.empty(total[-1] + len(texts), np.uint32)
        where = np.ones(len(ids), bool)
        where[offsets[1:] + np.arange(len(texts))] = False
        ids[where] = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        ids[~where] = end
        return ids, offsets + np.arange(len(texts) + 1)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One per worker, so that tasks which follow one another share its memory."""
    return Encoder(path)
