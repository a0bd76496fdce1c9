"""Reading public byte-level BPE vocabularies."""

from __future__ import annotations

import json
from functools import lru_cache

#: Fixed value: the published pattern that splits text before byte-level merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """The published printable stand-in of every byte, inverted."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteVocab:
    """Labels, merges and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_of_char()
        as_bytes = lambda s: bytes(chars[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {as_bytes(t): i for t, i in vocab.items() if t not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        if any(a[2] >= b[2] for a, b in zip(self.merges, self.merges[1:])):
            raise ValueError(f"{path}: token ids do not follow merge order")
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        self.label = [b""] * size
        for t, i in self.id_of.items():
            self.label[i] = t
        for t, i in self.special.items():
            self.label[i] = t.encode()


@lru_cache(maxsize=2)
def load(path: str) -> ByteVocab:
    """One vocabulary per Python worker and path."""
    return ByteVocab(path)
