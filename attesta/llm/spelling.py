"""Spelling variants: words one edit apart meet in the sorted rotations of a permuterm index.

A word ``a x b`` marked with a terminator, ``a x b $``, has the rotation ``b $ a x``. All but its last character, ``b $ a``, is the
prefix range that every word with another character in that place falls into, and it is the whole rotation of the word without the
character. So a group of equal prefixes holds words that are all near each other, at most one for each character and one shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import slices
from attesta.plans.lineage import cut
from attesta.plans.prefix import running_sums

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a row of the index is: a whole rotation, or one whose last character is skipped; of a run of equal characters only the first
#: stands for the word without one of them.
_WHOLE, _FIRST, _LATER = 0, 1, 2
#: Moduli and bases of the rolling hashes of long words (fixed values: primes under 2**31, and any numbers below them).
_MODULI = ((2147483647, 911382323), (2147483629, 972663749), (2147483587, 410586491))


def words(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all whole texts with their occurrences, where both are at least the given ones.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where 31 divides h, the CRC-32 of the document's id, a
    colon and the run, the run loses its character h modulo its length. Null and empty texts have no words, a null id counts as an
    empty one, and a text of any length is read whole. Repeated rows count each time; other columns aren't read.
    """
    lower = F.translate(F.col(text_col), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{min_length},}}"), F.lit(0))).alias("_run"))
    hashed = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    word = F.when(F.col("_h") % 31 == 0, F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.length("_run")))).otherwise(F.col("_run"))
    counted = hashed.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _hashed_rotations(batches: Iterator[pa.RecordBatch], over: int) -> Iterator[pa.RecordBatch]:
    """Index rows of more than ``over`` characters: a key is its two parts' lengths and rolling hashes, so a word of length n costs n
    and not n**2."""
    for batch in slices(batches, 1):
        ident, n, text = batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), batch.column(2)[0].as_py()
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = len(code)
        sums = []
        for modulus, base in _MODULI:
            power = np.ones(size, np.int64)
            done, factor = 1, base
            while done < size:
                power[done : 2 * done] = power[: min(done, size - done)] * factor % modulus
                done, factor = 2 * done, factor * factor % modulus
            sums.append(np.concatenate([[0], np.cumsum(code * power % modulus) % modulus]))
        later = np.concatenate([[False], code[1:] == code[:-1]])
        for kind in (_WHOLE, _FIRST):
            skip = int(kind != _WHOLE)
            if size - skip <= over:
                continue
            for begin in range(0, size + 1 - skip, 65_536):
                i = np.arange(begin, min(begin + 65_536, size + 1 - skip))
                parts = [i.astype("U"), (size - skip - i).astype("U")]
                for (modulus, base), total in zip(_MODULI, sums, strict=True):
                    # what follows lies one place further in the longer word
                    tail = (total[size] - total[i + skip]) % modulus
                    parts += [total[i].astype("U"), (tail if skip else tail * base % modulus).astype("U")]
                key = parts[0]
                for p in parts[1:]:
                    key = np.char.add(np.char.add(key, "."), p)
                mark = np.full(len(i), _WHOLE) if not skip else np.where(later[i], _LATER, _FIRST)
                yield pa.record_batch([pa.array(key.tolist()), pa.array(np.full(len(i), ident)), pa.array(np.full(len(i), n)), pa.array(mark.astype(np.int8))], ["key", "id", "n", "kind"])


def rotations(numbered: DataFrame, *, as_text: int = 64) -> DataFrame:
    """key, id, n, kind: the index over words (id, word, n). Keys of more than ``as_text`` characters, the mark aside, are hashed."""
    length = F.length("word")
    short = numbered.where(length <= as_text + 1).select("id", "n", "word", F.explode(F.sequence(F.lit(0), 2 * length)).alias("_j"))
    i, skip = F.shiftright("_j", 1), F.col("_j") % 2
    short = short.where(length - skip <= as_text)
    key = F.concat(F.col("word").substr(i + skip + 1, length), F.lit("$"), F.col("word").substr(F.lit(1), i))
    same = (i > 0) & (F.col("word").substr(i + 1, F.lit(1)) == F.col("word").substr(i, F.lit(1)))
    kind = F.when(skip == 0, _WHOLE).when(same, _LATER).otherwise(_FIRST).cast("byte")
    rows = short.select(key.alias("key"), "id", "n", kind.alias("kind"))
    return rows.unionByName(numbered.where(length > as_text).select("id", "n", "word").mapInArrow(lambda b: _hashed_rotations(b, as_text), "key string, id long, n long, kind byte"))


def neighbours(index: DataFrame) -> DataFrame:
    """id, n, n_near, best_n, best_id: for each word with a near one, how many there are and the most frequent, ties to the smallest id.

    Rows are sorted by key and scanned group by group; a group never exceeds the number of characters by more than one, and each of its
    words needs only the group's counts and its two most frequent words.
    """
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.desc("n"), F.asc("id"))
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = F.struct(F.col("n").alias("n"), F.col("id").alias("id"))
    scanned = index.select(
        "id",
        "n",
        "kind",
        F.count("*").over(whole).alias("_size"),
        F.sum(F.when(F.col("kind") == _WHOLE, 1).otherwise(0)).over(whole).alias("_wholes"),
        F.sum(F.when(F.col("kind") == _FIRST, 1).otherwise(0)).over(whole).alias("_firsts"),
        F.first(both).over(whole).alias("_best"),
        F.nth_value(both, 2).over(whole).alias("_second"),
    ).where(F.col("_size") > 1)
    skipped = F.col("_size") - F.col("_wholes")
    near = F.when(F.col("kind") == _WHOLE, F.col("_firsts")).otherwise(skipped - 1 + F.when(F.col("kind") == _FIRST, F.col("_wholes")).otherwise(0))
    other = F.when(F.col("_best.id") == F.col("id"), F.col("_second")).otherwise(F.col("_best"))
    each = scanned.select("id", "n", near.alias("_near"), F.struct((-other["n"]).alias("n"), other["id"].alias("id")).alias("_other"))
    out = each.groupBy("id").agg(F.max("n").alias("n"), F.sum("_near").alias("n_near"), F.min("_other").alias("_o"))
    return out.select("id", "n", "n_near", (-F.col("_o.n")).alias("best_n"), F.col("_o.id").alias("best_id"))


def roots(forms: DataFrame, ratio: int) -> DataFrame:
    """id, form_id, root_id: each word's last form. A form is ``ratio`` times as frequent as its word, so chains are short: pointers
    double as many times as the largest count allows."""
    now = cut(forms.select("id", "form_id", F.col("form_id").alias("root_id"), "form_n"))
    depth, most = 1, now.agg(F.max("form_n")).first()[0] or 1
    while ratio**depth < most:
        depth += 1
    for _ in range(max(depth - 1, 0).bit_length()):
        further = now.select(F.col("id").alias("root_id"), F.col("root_id").alias("_next"))
        now = cut(now.join(further, "root_id", "left").select("id", "form_id", F.coalesce("_next", "root_id").alias("root_id"), "form_n"))
    return now


def group_variants(counted: DataFrame, *, ratio: int = 10, as_text: int = 64) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of ``counted`` (word, n; words distinct).

    Two words are near if they differ by exactly one inserted, deleted or replaced character. A word's form is its near word of
    largest n (ties: the smallest), if that n is at least ``ratio`` times the word's; its root is where the forms end. No words give
    an empty result.
    """
    order = counted.select("word", "n", F.lit(0).alias("_all"), F.lit(1).alias("_one"))
    numbered = cut(running_sums(order, ["_all"], ["word"], {"id": "_one"}).select("id", "word", "n"))
    near = cut(neighbours(rotations(numbered, as_text=as_text)))
    forms = near.where(F.col("best_n") >= ratio * F.col("n")).select("id", F.col("best_id").alias("form_id"), F.col("best_n").alias("form_n"))
    names = lambda c: numbered.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    found = roots(forms, ratio).join(names("form"), "form_id").join(names("root"), "root_id").select("id", "form", "root", "form_n")
    out = numbered.join(near.select("id", "n_near"), "id", "left").join(found, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
