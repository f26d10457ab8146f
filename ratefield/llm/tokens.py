"""Encoding of texts by a public tokenizer, with a bounded cache of pieces that blanks part."""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

from ratefield.llm.common import KEPT

#: A byte-level BPE parts a text before each blank that follows something else, so pieces cut there are encoded alone.
PIECE = re.compile(r"\s*\S+|\s+")
#: Characters that Python takes for blanks and the tokenizer doesn't.
ODD = re.compile(r"[\x1c-\x1f]")
#: Bytes of pieces and their ids that a worker keeps, and the longest piece kept; others are encoded each time they come.
MOST_BYTES, LONGEST = 64 << 20, 64
#: Bytes that an entry takes besides its piece and ids (two objects and a slot of the table).
_ENTRY = 150


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """Ids (little-endian uint32) of each piece seen."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.bytes = 0
        self.model, self.alphabet, self.parts = tokenizer.model, _byte_alphabet(), tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, piece: str) -> bytes:
        m = self._SIMPLE.match(piece)
        if m and m[2]:
            ids = self[m[1]] + self[m[2]]
        else:
            words = [piece.encode().decode("latin-1").translate(self.alphabet)] if m else [w for w, _ in self.parts(piece)]
            ids = b"".join([t.id.to_bytes(4, "little") for word in words for t in self.model.tokenize(word)])
        if len(piece) <= LONGEST and self.bytes < MOST_BYTES:
            self[piece] = ids
            self.bytes += _ENTRY + len(piece) + len(ids)
        return ids

    #: Letters with at most one run of signs behind them; the pattern parts these two.
    _SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)\Z")


class Encoder:
    """ids(text) gives what the tokenizer's encode(text, add_special_tokens=False) gives, as little-endian uint32."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join([ODD.pattern, *map(re.escape, added)]))
        # what a tokenizer does else (a normalizer, another pre-tokenizer) need not part at blanks
        self.parted = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.cache = _Cache(self.tokenizer) if self.parted else {}

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.parted or self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.cache.__getitem__, PIECE.findall(text)))


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it stays for the worker's next tasks with one."""
    name, ready = KEPT.get("encoder", ("", None))
    if name != path:
        ready = Encoder(path)
        KEPT["encoder"] = (path, ready)
    return ready
