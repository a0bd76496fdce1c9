"""Digests, canonical text and bit hashes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
HEX64 = "^[0-9a-fA-F]{64}$"


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON text with sorted keys, no spaces and nulls kept; doubles should be formatted to text by the caller."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def canonical_digest(columns: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _bits(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(x.cast("long")))


def dhash(pixels: Column, width: int = 8, height: int = 8) -> Column:
    """One bit for each pixel and its right neighbour, row by row: 1 where the left one is brighter."""
    pairs = [r * width + c for r in range(height) for c in range(width - 1)]
    at = F.array(*[F.lit(i) for i in pairs])
    return F.transform(F.array(pixels), lambda p: _bits(F.transform(at, lambda i: (F.get(p, i) > F.get(p, i + 1)).cast("int"))))[0]


def ahash(pixels: Column) -> Column:
    """One bit for each pixel: 1 from the mean on."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / F.size(pixels)
    return F.transform(F.array(mean), lambda m: _bits(F.transform(pixels, lambda x: (x >= m).cast("int"))))[0]


def is_degenerate(bits: Column, low: int = 6, high: int = 58) -> Column:
    n = F.bit_count(bits)
    return (n < low) | (n > high)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2989 + g * 0.5870 + b * 0.1140


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    return F.concat(F.lit("ref_"), F.lower(kind), F.lit("_"), F.substring(source, 1, 16), F.lit("_"), F.substring(target, 1, 16))


def layers_digest(layers: Column, fields: Sequence[str]) -> Column:
    """Digest of an array of layer structs, sorted by their first field, over ``fields``."""
    text = F.array_join(F.transform(F.array_sort(layers), lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), "|")
    return F.sha2(text, 256)
