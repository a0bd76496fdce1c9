"""Canonical JSON of any column, built from its type as one column expression.

The text is what Python's ``json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))`` gives for the row as
plain values: keys in order of code points, shortest doubles that read back alike, dates and times in ISO 8601 with UTC as offset.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CONTROLS = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"} | {chr(c): f"\\u{c:04x}" for c in range(0x20) if chr(c) not in "\b\f\n\r\t"}
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(text: Column) -> Column:
    """A JSON string; only quotes, backslashes and control characters are escaped."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def escaped(found: Column) -> Column:
        for raw, shown in _CONTROLS.items():
            found = F.replace(found, F.lit(raw), F.lit(shown))
        return found

    # Within a lambda, or a record of several texts becomes one method too large for the JVM to compile.
    rare = F.transform(F.array(plain), escaped)[0]
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1F]"), rare).otherwise(plain), F.lit('"'))


def _shorter(digits: Column, power: Column, value: Column) -> tuple[Column, Column]:
    """The digits and power of ten of ``value`` with one digit less, rounded to the nearer or else the other side, where those still
    read as the same double."""
    text = digits.cast("string")
    down = F.concat(F.lit("0"), F.substring(text, F.lit(1), F.length(text) - 1)).cast("long")
    near = F.when(digits % 10 >= 5, down + 1).otherwise(down)
    reads = lambda d: (digits >= 10) & (F.concat(d.cast("string"), F.lit("E"), (power + 1).cast("string")).cast("double") == value)
    other = 2 * down + 1 - near
    return F.when(reads(near), near).when(reads(other), other).otherwise(digits), F.when(reads(near) | reads(other), power + 1).otherwise(power)


def _nearest(pair: Column, value: Column) -> Column:
    """Of the digits and those one up or down that read as the same double, the nearest ones, worked out in whole numbers; for
    values from 2**53 to 1e37, where the JVM's own last digit may be another."""
    whole = lambda c: c.cast("long").cast("decimal(20,0)")
    power = lambda base, n: whole(F.pow(F.lit(base), F.floor(n / 2))) * whole(F.pow(F.lit(base), n - F.floor(n / 2)))
    twos = F.greatest(F.floor(F.log2(value)) - 54, F.lit(0))
    exact = (value / F.pow(F.lit(2.0), twos)).cast("long").cast("decimal(20,0)") * power(2.0, twos)

    def gap(d: Column) -> Column:
        reads = F.concat(d.cast("string"), F.lit("E"), pair["e"].cast("string")).cast("double") == value
        return F.when(reads, F.struct(F.abs(d.cast("decimal(20,0)") * power(10.0, pair["e"]) - exact).alias("gap"), d.alias("d")))

    near = F.array_min(F.filter(F.transform(F.array(pair["d"], pair["d"] - 1, pair["d"] + 1), gap), lambda x: x.isNotNull()))
    wide = (value >= 2.0**53) & (value < 1e37) & (pair["e"] >= 0)
    return F.struct(F.when(wide, near["d"]).otherwise(pair["d"]).alias("d"), pair["e"].alias("e"))


def _whole_text(size: Column) -> Column:
    """The shortest text of a double from 1e16 to under 9e18, which is a whole number: of its roundings to 15 digits and more, the first
    that reads as the same double, the nearer one before the other; all in whole numbers."""
    exact = size.cast("long")
    found = F
    for k in (4, 3, 2, 1):
        rest = exact % 10**k
        down, up = exact - rest, exact - rest + 10**k
        for near in (F.when(2 * rest < 10**k, down).otherwise(up), F.when(2 * rest < 10**k, up).otherwise(down)):
            found = found.when(near.cast("double") == size, near)

    def written(text: Column) -> Column:
        kept = F.rtrim(text, F.lit("0"))
        return F.concat(F.substring(kept, 1, 1), F.when(F.length(kept) > 1, F.concat(F.lit("."), F.substring(kept, 2, 18))).otherwise(""), F.lit("e+"), (F.length(text) - 1).cast("string"))

    return F.transform(F.array(found.otherwise(exact).cast("string")), written)[0]


def double_text(value: Column) -> Column:
    """The shortest text that reads as the same double: plain from 1e-4 to under 1e16, else with a signed exponent of two digits.

    Where a JVM before version 19 writes another last digit than the nearest, it is mended below 1e37.
    """
    size = F.abs(value)
    shown = size.cast("string")
    mantissa, exponent = F.split_part(shown, F.lit("E"), F.lit(1)), F.split_part(shown, F.lit("E"), F.lit(2))
    fraction = F.split_part(mantissa, F.lit("."), F.lit(2))
    digits = F.replace(mantissa, F.lit("."), F.lit("")).cast("decimal(20,0)").cast("long")
    power = F.when(exponent == "", 0).otherwise(exponent.cast("int")) - F.length(fraction)

    def strip(pair: Column) -> Column:
        """Without zeros at the end."""
        text = pair["d"].cast("string")
        kept = F.rtrim(text, F.lit("0"))
        return F.struct(kept.cast("long").alias("d"), (pair["e"] + F.length(text) - F.length(kept)).alias("e"))

    def step(pair: Column) -> Column:
        d, e = _shorter(pair["d"], pair["e"], size)
        return F.struct(d.cast("long").alias("d"), e.cast("int").alias("e"))

    start = strip(F.struct(digits.alias("d"), power.alias("e")))
    best = F.aggregate(F.sequence(F.lit(1), F.lit(2)), start.cast("struct<d:bigint,e:int>"), lambda acc, _: strip(step(acc)).cast("struct<d:bigint,e:int>"))

    def written(pair: Column) -> Column:
        text, e = pair["d"].cast("string"), pair["e"]
        n = F.length(text)
        point = n + e  # the decimal point comes after so many digits
        plain = (
            F.when(e >= 0, F.concat(text, F.repeat(F.lit("0"), e), F.lit(".0")))
            .when(point > 0, F.concat(F.substring(text, F.lit(1), point), F.lit("."), F.substring(text, point + 1, n)))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), text))
        )
        power10 = point - 1
        head = F.when(n > 1, F.concat(F.substring(text, F.lit(1), F.lit(1)), F.lit("."), F.substring(text, F.lit(2), n))).otherwise(text)
        signed = F.concat(F.when(power10 < 0, "-").otherwise("+"), F.lpad(F.abs(power10).cast("string"), F.greatest(F.length(F.abs(power10).cast("string")), F.lit(2)), F.lit("0")))
        return F.when((power10 >= -4) & (power10 < 16), plain).otherwise(F.concat(head, F.lit("e"), signed))

    text = F.transform(F.transform(F.array(best), lambda pair: _nearest(pair, size)), written)[0]
    sign = F.when((value < 0) | ((value == 0) & value.cast("string").startswith("-")), "-").otherwise("")
    # Two texts of up to 15 digits never read as the same double, so there is no shorter one than the JVM's.
    short = (size >= 1e-3) & (size < 1e7) & (F.length(shown) <= 16)
    # Whole numbers under 2**53 are all doubles, so no digit of theirs can go.
    plain = (size >= 1e7) & (size < 2.0**53) & (size.cast("long").cast("double") == size)
    whole = (size >= 1e16) & (size < 9e18)
    large = (size >= 1e16) & (size < 1e100) & (F.length(mantissa) <= 16)
    scientific = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e+"), exponent)
    return F.when(short, value.cast("string")).when(plain, F.concat(sign, size.cast("long").cast("string"), F.lit(".0"))).when(whole, F.concat(sign, _whole_text(size))).when(large, F.concat(sign, scientific)).when(F.isnan(value), "NaN").when(size == float("inf"), F.concat(sign, F.lit("Infinity"))).when(size == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, text))


def timestamp_text(value: Column) -> Column:
    """ISO 8601 in UTC, whatever the session's time zone; microseconds where there are any."""
    us, day = F.unix_micros(value), 86_400_000_000
    days, rest = F.floor(us / day), F.pmod(us, F.lit(day))
    pad = lambda c, n=2: F.lpad(c.cast("long").cast("string"), n, "0")
    clock = F.concat(pad(F.floor(rest / 3_600_000_000)), F.lit(":"), pad(F.floor(rest / 60_000_000) % 60), F.lit(":"), pad(F.floor(rest / 1_000_000) % 60))
    micros = rest % 1_000_000
    date = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string")
    return F.concat(date, F.lit("T"), clock, F.when(micros > 0, F.concat(F.lit("."), pad(micros, 6))).otherwise(""), F.lit("+00:00"))


def zoneless_text(value: Column) -> Column:
    """The same of a timestamp without zone, which is taken as UTC."""
    shown = value.cast("string")
    text, point = F.replace(shown, F.lit(" "), F.lit("T")), F.instr(shown, ".")
    return F.concat(F.when(point > 0, F.rpad(text, point + 6, F.lit("0"))).otherwise(text), F.lit("+00:00"))


def _object(parts: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def text_of_type(value: Column, kind: T.DataType, drop_null: Collection[str] = ()) -> Column:
    """Canonical JSON of a column of type ``kind``; ``drop_null`` names fields of a struct that are left out where they are null.

    Doubles follow Python's ``repr``; floats count as the doubles of equal value. Timestamps without zone are taken as UTC. Keys of maps
    are texts, or integers, which sort as numbers. Binary values and decimals have no JSON and raise ``TypeError``, as there.
    """
    if isinstance(kind, T.BooleanType):
        out = F.when(value, "true").otherwise("false")
    elif isinstance(kind, _INTEGERS):
        out = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = double_text(value.cast("double"))
    elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        out = quoted(value)
    elif isinstance(kind, T.DateType):
        out = F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    elif isinstance(kind, T.TimestampType):
        out = F.concat(F.lit('"'), timestamp_text(value), F.lit('"'))
    elif isinstance(kind, T.TimestampNTZType):
        out = F.concat(F.lit('"'), zoneless_text(value), F.lit('"'))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: text_of_type(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, (T.StringType, *_INTEGERS)):
        pairs = F.sort_array(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), text_of_type(e["value"], kind.valueType).alias("value"))))
        out = _object(F.transform(pairs, lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), e["value"])))
    elif isinstance(kind, T.StructType):
        parts = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            part = F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), text_of_type(value[f.name], f.dataType))
            parts.append(F.when(value[f.name].isNotNull(), part) if f.name in drop_null else part)
        made = F.array(*parts) if parts else F.array().cast("array<string>")
        out = _object(F.filter(made, lambda p: p.isNotNull()) if drop_null else made)
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON")
    return F.when(value.isNull(), "null").otherwise(out)


def _members(rows: DataFrame, columns: dict[str, Column], drop_null: Collection[str] = ()) -> Column:
    """The fields of :func:`canonical_text` without the braces."""
    kinds = rows.select(*[c.alias(f"c{k}") for k, c in enumerate(columns.values())]).schema
    parts = []
    for name, kind in sorted(zip(columns, kinds, strict=True)):
        part = F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), text_of_type(columns[name], kind.dataType))
        parts.append(F.when(columns[name].isNotNull(), part) if name in drop_null else part)
    return F.concat_ws(",", *parts)


def canonical_text(rows: DataFrame, columns: dict[str, Column], drop_null: Collection[str] = ()) -> Column:
    """Canonical JSON of an object with these fields, whatever their types; those of ``drop_null`` go where they are null."""
    return F.concat(F.lit("{"), _members(rows, columns, drop_null), F.lit("}")) if columns else F.lit("{}")


def canonical_sha256(rows: DataFrame, columns: dict[str, Column], drop_null: Collection[str] = ()) -> Column:
    return F.sha2(canonical_text(rows, columns, drop_null), 256)


def canonical_around(rows: DataFrame, columns: dict[str, Column], hole: str) -> tuple[Column, Column]:
    """The canonical text of an object with the text field ``hole`` beside ``columns``, before and after that field's value."""
    early = {c: v for c, v in columns.items() if c < hole}
    late = {c: v for c, v in columns.items() if c > hole}
    name = json.dumps(hole, ensure_ascii=False)
    before = F.concat(F.lit("{"), *([_members(rows, early), F.lit(",")] if early else []), F.lit(f'{name}:"'))
    return before, F.concat(F.lit('"'), *([F.lit(","), _members(rows, late)] if late else []), F.lit("}"))


def spec_digest(rows: DataFrame, value: Column, default: dict | None = None) -> Column:
    """The digest of a specification: a text of 64 hexadecimal digits as it is, in lower case, any other text by its bytes, a list as the
    object's ``output``, all else by its canonical text. Null has the digest of ``default``, if there is one."""
    kind = rows.select(value.alias("v")).schema[0].dataType
    if isinstance(kind, T.StringType):
        found = F.when(value.rlike("^[0-9a-fA-F]{64}$"), F.lower(value)).otherwise(F.sha2(value, 256))
    elif isinstance(kind, T.ArrayType):
        found = canonical_sha256(rows, {"output": value})
    else:
        found = F.sha2(text_of_type(value, kind), 256)
    if default is None:
        return F.when(value.isNotNull(), found)
    plain = json.dumps(default, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return F.when(value.isNull(), F.lit(hashlib.sha256(plain.encode()).hexdigest())).otherwise(found)
