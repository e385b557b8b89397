"""A byte-level BPE tokenizer as a sentencepiece model, written directly from a public vocabulary.

The vocabulary is a rank file: one token (base64 of its bytes) and its rank on each line.  Every byte is
mapped to one printable character, so a token is a string; the model holds these strings as BPE pieces
scored by their negative rank, with identity normalisation and no added blanks.  Merging the best-scored
neighbours, leftmost first, is then the same as merging the lowest rank, and piece ids are ranks.  Text is
cut into pre-tokens by the vocabulary's pattern, mapped and encoded; decoding inverts the mapping.

Text is ordinary text throughout: strings that look like special tokens have no special meaning.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterable

import numpy as np
import regex
import sentencepiece

#: Fixed value: the pattern that cuts text before the merges of the public 50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    tokens = [ranks[i] for i in range(len(ranks))]
    missing = {bytes([b]) for b in range(256)}.difference(tokens)
    if missing:
        raise ValueError(f"not a byte-level vocabulary: {len(missing)} bytes have no token")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (2**64 - 1))


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(tokens: list[bytes]) -> bytes:
    """The sentencepiece model (protocol buffer) of a vocabulary; the piece after the last is the unknown one."""
    chars = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    pieces = [piece("".join(chars[b] for b in t), -float(rank), _NORMAL) for rank, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, _UNKNOWN))
    trainer = _number(3, _BPE) + _number(4, len(pieces)) + _number(40, len(tokens))
    trainer += b"".join(_number(field, -1) for field in (41, 42, 43))  # no begin, end, padding
    normalizer = _bytes(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))  # nothing added, removed, escaped
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normalizer)


def _sums(n: np.ndarray, pre: np.ndarray) -> np.ndarray:
    """The sums of consecutive stretches of ``pre`` values each."""
    total = np.concatenate([[0], np.cumsum(n)])
    ends = np.cumsum(pre)
    return total[ends] - total[ends - pre]


class Tokenizer:
    """Encodes and decodes; remembers the ids of pre-tokens it has met, up to ``remember`` of them."""

    #: Longer pre-tokens are encoded each time, not remembered.
    SHORT = 64

    def __init__(self, tokens: list[bytes], model: bytes | None = None, remember: int = 400_000):
        self._tokens = tokens
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model or model_bytes(tokens))
        self._chars = byte_characters()
        self._translate = {b: c for b, c in enumerate(self._chars)}
        self._cut = regex.compile(PATTERN).findall
        self._remember = remember
        self._known: dict[str, int] = {}
        self._starts: list[int] = [0]
        self._flat: list[int] = []

    def _mapped(self, pre: str) -> str:
        return pre.encode().decode("latin-1").translate(self._translate)

    def _learn(self, new: list[str]) -> None:
        for pre, ids in zip(new, self._model.encode([self._mapped(p) for p in new], num_threads=1)):
            self._known[pre] = len(self._starts) - 1
            self._flat.extend(ids)
            self._starts.append(len(self._flat))

    def _looked_up(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per pre-token its first place in the ids and its number of ids, the pre-tokens of each text, and the ids."""
        cuts = [self._cut(t) if t else [] for t in texts]
        if len(self._known) > self._remember:
            self._known, self._starts, self._flat = {}, [0], []
        new = set().union(*cuts).difference(self._known)
        long = [p for p in new if len(p) > self.SHORT]
        self._learn(list(new.difference(long)))
        mark = len(self._starts)
        self._learn(long)
        known = self._known
        where = np.fromiter(itertools.chain.from_iterable(map(known.__getitem__, c) for c in cuts), dtype=np.int64, count=sum(map(len, cuts)))
        starts, flat = np.array(self._starts), np.array(self._flat, dtype=np.int32)
        if long:  # these are not remembered
            for p in long:
                del known[p]
            del self._starts[mark:]
            del self._flat[self._starts[-1] :]
        first = starts[where]
        return first, starts[where + 1] - first, np.array([len(c) for c in cuts], dtype=np.int64), flat

    def encode_batch(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, number of ids of each text); a null and an empty text have none."""
        first, n, pre, flat = self._looked_up(texts)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return flat[np.arange(total) - np.repeat(ends - n - first, n)], _sums(n, pre)

    def count_batch(self, texts: Iterable[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        _, n, pre, _ = self._looked_up(texts)
        return _sums(n, pre)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; the inverse of :meth:`encode`."""
        return b"".join(self._tokens[i] for i in ids).decode("utf-8", errors="replace")
