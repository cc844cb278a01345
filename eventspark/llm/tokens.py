"""Token ids of whole texts by the tokenizers library, with a bounded memo of word pieces.

A byte-level vocabulary never merges across the places where its pattern splits a text. A text is cut before each
single space and around each line break, which are such places as long as no white-space run is longer than two and
none ends the text, and between a Latin letter and a sign behind it; other texts, and those that spell out a special
token, are encoded whole. A new piece of Latin letters and signs is split by the pattern and its words go to the
library's merge model; any other piece goes through the library whole.

Texts are cut together, as one run of bytes, and each different piece of them is looked up once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pieces in the younger half of a worker's memo; the older half is as large. Reused workers keep both.
MEMO_PIECES = 900_000
#: Bytes of text to cut together, and pieces to look up between two looks at the memo's size.
PORTION, LOOKED_UP = 2 << 20, 10_000
_RUN = regex.compile(r"\s\s\s|\s\s\Z|\x00")
_PAIRS = ("  ", "\n\n", "\n ", " \n")
_LAST_PLAIN = "ɏ"
#: Latin letters after at most one space: one word to the pattern.
_PLAIN = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+")
_LETTER, _SIGN = (np.array([chr(b).isascii() and test(chr(b)) for b in range(256)])
                  for test in (str.isalpha, lambda c: c.isprintable() and c != " " and not c.isalnum()))


def _must_stay_whole(text: str) -> bool:
    """Whether white space (or a zero byte) makes cutting unsafe; most texts are settled without the pattern."""
    if text.replace("\n", "").isprintable() and not any(pair in text for pair in _PAIRS):
        return False
    return _RUN.search(text) is not None


def _cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces of these UTF-8 bytes start, and their end: at texts' ends, spaces, line breaks, signs behind letters."""
    cut = np.zeros(len(data) + 1, bool)
    np.equal(data, 32, out=cut[:-1])
    breaks = np.flatnonzero(data == 10)
    cut[breaks] = cut[breaks + 1] = True
    signs = np.flatnonzero(_SIGN[data])
    signs = signs[signs > 0]
    last, lead = data[signs - 1], data[signs - 2]  # a letter beyond ASCII has a byte before its last one
    beyond = (lead == 0xC3) & (last != 0x97) & (last != 0xB7) | (lead >= 0xC4) & (lead <= 0xC8)  # À to ȿ but × and ÷
    cut[signs[_LETTER[last] | (last >= 0x80) & beyond]] = True
    cut[0] = True
    cut[ends] = True
    return np.flatnonzero(cut)


def portions(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(number of the first, texts) of slices of a column that end with the text that fills `most` bytes (`PORTION`)."""
    sizes = pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy()
    filled = np.cumsum(sizes + 1) // (most or PORTION)
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(filled, filled[at - 1] if at else 0, "right")) + 1
        yield at, texts.slice(at, upto - at).to_pylist()
        at = min(upto, len(texts))


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Memo(dict):
    """Pieces and their ids as bytes; a piece that is asked for the first time is learned."""

    def __init__(self, learn):
        super().__init__({"": b""})
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        self[piece] = found = self.learn(piece)
        return found


class Encoder:
    """`ids(texts)` gives one little-endian unsigned 32-bit id array per text (None: empty), as the library's
    `encode(text, add_special_tokens=False)` does: a special token that a text spells out becomes its id."""

    def __init__(self, path: str, pieces: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.pieces = pieces
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.level = isinstance(self.tokenizer.pre_tokenizer, ByteLevel) and self.tokenizer.normalizer is None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.raw = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.young = _Memo(self._learned)
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of what the pattern takes as one word, by the library's merge model."""
        if word.isascii():
            mapped = word.replace(" ", self.space)
        else:
            mapped = word.encode().decode("latin-1").translate(self.letters)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.tokenize(mapped)])

    def _part(self, word: str) -> bytes:
        found = self.young.get(word) or self.old.get(word)
        if found is None:
            self.young[word] = found = self._word(word)
        return found

    def _learned(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is not None:
            return found
        if _PLAIN.fullmatch(piece):
            return self._word(piece)
        bare = piece[1:] if piece[0] == " " else piece
        if not bare.isprintable() or max(bare, default="\n") > _LAST_PLAIN:
            return self._whole(piece)
        return b"".join(map(self._part, self.pattern.findall(piece)))

    def _found(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(pieces), LOOKED_UP):
            if len(self.young) > (self.pieces or MEMO_PIECES):
                self.old, self.young = self.young, _Memo(self._learned)
            out.extend(map(self.young.__getitem__, pieces[at : at + LOOKED_UP]))
        return out

    def _cut(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts that may be cut, none of them empty."""
        data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        starts = _cuts(np.frombuffer(data, np.uint8), ends)
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        found = self._found(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        _, offsets, ids = pa.array(found, pa.large_binary()).take(pieces.indices).buffers()
        at = np.frombuffer(offsets, np.int64)[np.searchsorted(starts, ends)] // 4
        return np.split(np.frombuffer(ids or b"", "<u4"), at[:-1])

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        out = [np.empty(0, "<u4")] * len(texts)
        cut: list[int] = []
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.level or _must_stay_whole(text) or any(token in text for token in self.special):
                out[k] = np.frombuffer(self._whole(text), "<u4")
            else:
                cut.append(k)
        if cut:
            for k, ids in zip(cut, self._cut([texts[k].encode() for k in cut]), strict=True):
                out[k] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pieces: int | None = None) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path, pieces)
