"""Token counts by overlapping chunks that are spliced where both encodings must agree."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import text_of
from attesta.llm.vocab import SPLIT_PATTERN, load

Encode = Callable[[str], list[int]]
#: The white space of the split pattern.
_WHITE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space from this length on are encoded apart from what is around them.
LONG_RUN = 4096
_LONG_RUN = re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{{LONG_RUN},}}")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
#: Marks beyond ASCII, of three bytes each, that end a word before any letter, and that no special string holds.
_STOPS = frozenset(c.encode() for c in "。，、！？；：」』）")


def _encoding(path: str):
    import tiktoken

    vocab = load(path)
    return vocab, tiktoken.Encoding("byte_bpe", pat_str=SPLIT_PATTERN, mergeable_ranks=vocab.id_of, special_tokens=vocab.special)


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[Encode, np.ndarray]:
    """The library's encoder for a byte-level BPE file, special strings read as special tokens, and token lengths in bytes."""
    vocab, enc = _encoding(path)
    lengths = np.array([len(t) for t in vocab.label], np.int64)
    return lambda text: enc.encode(text, allowed_special="all"), lengths


@lru_cache(maxsize=2)
def merger(path: str) -> tuple[Encode, tuple[str, ...]]:
    """The merges alone, for what is one piece of the split, and the special strings."""
    vocab, enc = _encoding(path)
    return enc._encode_single_piece, tuple(vocab.special)


def apart(text: str, special: tuple[str, ...]) -> Iterator[tuple[str, bool]]:
    """The text in order, cut at long runs of white space: (part, whether it is such a run).

    The split takes all of a run but its last character as one piece, whatever its length; that character goes with what follows. At
    the end of a text, and before a special string, it takes the whole run. So the parts have the tokens of the text.
    """
    begin = 0
    for m in _LONG_RUN.finditer(text):
        end = m.end() if m.end() == len(text) or text.startswith(special, m.end()) else m.end() - 1
        yield text[begin : m.start()], False
        yield text[m.start() : end], True
        begin = end
    yield text[begin:], False


def stable_boundary(data: bytes, left: np.ndarray, right: np.ndarray, begin: int) -> int | None:
    """The first byte position at or after ``begin`` that is a token boundary in both encodings and provably stable.

    A position between a visible ASCII byte and ASCII white space is stable: no pattern alternative and no
    special string spans it, and neither side's split looks across it. So is one between a full stop or the like of a script
    without blanks and a letter.
    """
    both = np.intersect1d(left[left >= begin], right, assume_unique=True)
    both = both[(both > 0) & (both < len(data))]
    raw = np.frombuffer(data, np.uint8)
    ok = both[_SOLID[raw[both - 1]] & _SPACE[raw[both]]]
    if len(ok):
        return int(ok[0])
    for at in both[raw[both] >= 0xC0].tolist():
        if data[at - 3 : at] in _STOPS and data[at : at + 4].decode(errors="ignore")[:1].isalpha():
            return at
    return None


def count_spliced(text: str, encode: Encode, lengths: np.ndarray, chunk: int, overlap: int) -> int:
    """Tokens of ``text`` without encoding it in one piece; an overlap without a stable boundary doubles."""
    total, start, n = 0, 0, len(text)
    while n - start > chunk + overlap:
        middle, width = start + chunk, overlap
        while True:
            end = min(middle + width, n)
            head, shared = text[start:middle].encode(), text[middle:end].encode()
            data = head + shared
            ids = encode(text[start:end])
            left = np.cumsum(lengths[ids])
            right = np.cumsum(lengths[encode(text[middle:end])]) + len(head)
            at = stable_boundary(data, left, right, len(head) + 1)
            if at is not None:
                total += int(np.searchsorted(left, at, side="right"))
                start = middle + len(data[len(head) : at].decode())
                break
            if end == n:
                return total + len(ids)
            width *= 2
    return total + len(encode(text[start:]))


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 1024, chunk: int = 32_768, overlap: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text as the ``tokenizers`` library gives them for the byte-level BPE file ``tokenizer``.

    Runs of :data:`LONG_RUN` blanks or line ends and more are one piece of the split and go to the merges at once, as the split's pattern
    does not bear runs of a million. A text beyond ``chunk + overlap`` characters is encoded chunk by chunk, so memory follows the chunk and not the text; where
    no stable boundary comes (neither a blank after visible ASCII nor a full stop before a letter), the overlap doubles until one
    does, at worst up to the end of the text, and each character is encoded a few times.
    Null and empty texts have 0 bytes and 0 tokens. Every row gives one row, repeated rows too. Other columns are not
    read. An empty table gives an empty result. Columns: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode, lengths), (merge, special) = encoder(tokenizer), merger(tokenizer)
        for batch in batches:
            n = [sum(len(merge(part)) if run else count_spliced(part, encode, lengths, chunk, overlap) for part, run in apart(t, special)) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
