"""Scalar functions as column expressions, and the byte codecs beside them in plain Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(x: Column) -> Column:
    """Signed to unsigned, small magnitudes first: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-(x.bitwiseAND(F.lit(1).cast("long"))))


def utf16_length(text: Column) -> Column:
    """UTF-16 units of a text."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def chars_to_utf16(text: Column, chars: Column) -> Column:
    return utf16_length(F.substring(text, F.lit(1), chars.cast("int")))


def utf16_to_chars(text: Column, units: Column) -> Column:
    """Code points before a UTF-16 position."""
    head = F.substring(F.encode(text, "UTF-16LE"), F.lit(1), (units * 2).cast("int"))
    return F.length(F.decode(head, "UTF-16LE")).cast("long")


def chars_to_bytes(text: Column, chars: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), chars.cast("int"))).cast("long")


def bytes_to_chars(text: Column, size: Column) -> Column:
    """Code points before a UTF-8 position."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), size.cast("int"))
    return F.length(F.decode(head, "UTF-8")).cast("long")


def utf16_edit(text: Column, units: Column, removed: Column, added: Column) -> Column:
    """struct<pos, del, ins>: an edit given by UTF-16 positions, in code points."""
    pos, end = utf16_to_chars(text, units), utf16_to_chars(text, units + removed)
    return F.struct(pos.alias("pos"), (end - pos).alias("del"), added.alias("ins"))


def mix_bit(x: Column, bit: Column) -> Column:
    """A number and a flag in one number."""
    return F.shiftleft(x, 1) + bit.cast("long")


def strip_bit(x: Column) -> Column:
    """struct<value, bit>: what mix_bit put together."""
    return F.struct(F.shiftrightunsigned(x, 1).alias("value"), (x.bitwiseAND(F.lit(1).cast("long")) == 1).alias("bit"))


#: Fixed values of the format: bits of a number in one, two, ... bytes; whatever needs more takes nine.
PREFIX_BITS = (7, 14, 21, 28, 35, 42, 49, 54)
#: The least number of each length: shorter lengths are used up first.
PREFIX_LEAST = tuple(sum(1 << b for b in PREFIX_BITS[:k]) for k in range(9))


def prefix_varint(x: Column) -> Column:
    """Binary: the first byte's leading ones tell how many bytes follow; big-endian. For numbers from 0 on."""
    x = x.cast("long")
    out = None
    for k in range(9):
        n, ones = k + 1, ((1 << k) - 1) << (8 * k + 8 - k)
        signed = ones - (1 << 64) if n == 8 else ones
        body = F.hex(x - PREFIX_LEAST[k] + F.lit(signed).cast("long")) if k < 8 else F.hex(x - PREFIX_LEAST[k])
        coded = F.unhex(F.concat(F.lit("FF"), F.lpad(body, 16, "0")) if k == 8 else F.lpad(body, 2 * n, "0"))
        out = F.when(x < PREFIX_LEAST[1], coded) if k == 0 else out.when(x < PREFIX_LEAST[k + 1], coded) if k < 8 else out.otherwise(coded)
    return F.when(x >= 0, out)


def from_prefix_varint(data: Column) -> Column:
    """The number that a binary begins with; null where its bytes end too soon."""
    first = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")
    out = None
    for k in range(9):
        digits = F.hex(F.substring(data, 1, k + 1) if k < 8 else F.substring(data, 2, 8))
        held = F.conv(digits, 16, -10).cast("long")
        value = (held.bitwiseAND(F.lit((1 << 7 * k + 7) - 1).cast("long")) if k < 8 else held) + PREFIX_LEAST[k]
        value = F.when(F.octet_length(data) > k, value)
        most = 256 - (1 << 7 - k) if k < 8 else 256
        out = F.when(first < most, value) if out is None else out.when(first < most, value)
    return out


def split_at_char(text: Column, chars: Column) -> Column:
    """struct<head, tail>."""
    return F.struct(F.substring(text, F.lit(1), chars.cast("int")).alias("head"), F.substring(text, (chars + 1).cast("int"), F.length(text)).alias("tail"))


def transform_position(cursor: Column, kind: Column, start: Column, end: Column, left: bool = True) -> Column:
    """A cursor after an edit; at an insert's place it stays if it leans left."""
    before = (cursor < start) | ((cursor == start) & F.lit(left))
    return F.when(before, cursor).when(kind == "Ins", cursor + end - start).when(cursor < end, start).otherwise(cursor - (end - start))


def transform_through(cursor: Column, ops: Column, left: bool = True) -> Column:
    """A cursor after an array of edits struct<kind, start, end>, in order."""
    return F.aggregate(ops, cursor, lambda at, op: transform_position(at, op["kind"], op["start"], op["end"], left))


def edited(content: Column, ops: Column) -> Column:
    """A text after an array of edits struct<kind, pos, n, content, ...>, in order."""

    def step(text: Column, op: Column) -> Column:
        ins = op["kind"] == "Ins"
        after = op["pos"] + F.when(ins, F.lit(0)).otherwise(op["n"]) + 1
        return F.concat(F.substring(text, F.lit(1), op["pos"].cast("int")), F.when(ins, op["content"]).otherwise(F.lit("")), F.substring(text, after.cast("int"), F.length(text)))

    return F.aggregate(ops, content, step)


def with_deleted(content: Column, op: Column) -> Column:
    """A deletion struct<kind, pos, n, ...> of a text with the content that it takes away."""
    return op.withField("content", F.substring(content, (op["pos"] + 1).cast("int"), op["n"].cast("int")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def common_prefix(a: Column, b: Column) -> Column:
    """Code points that two texts begin with alike, by halving: about log2 n comparisons of substrings."""

    def longest(x: Column) -> Column:
        n = F.least(F.length(x["a"]), F.length(x["b"]))
        piece = lambda t, at, w: F.substring(x[t], at + 1, w)
        grown = lambda at, w: F.when((at + w <= x["n"]) & (piece("a", at, w) == piece("b", at, w)), at + w).otherwise(at)
        widths = F.transform(F.sequence(F.ceil(F.log2(n + 1.0)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
        return F.aggregate(widths, F.lit(0), grown)

    both = F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("n"))
    return let(both, longest)


def calc_diff(old: Column, new: Column) -> Column:
    """struct<pos, del, ins>: the replacement between the common head and the common tail; null if a text is null."""

    def replaced(x: Column) -> Column:
        rest = lambda t: F.reverse(F.substring(x[t], x["head"] + 1, F.length(x[t])))
        size = lambda t, tail: F.length(x[t]) - x["head"] - tail
        return let(
            common_prefix(rest("old"), rest("new")),
            lambda tail: F.struct(x["head"].cast("long").alias("pos"), size("old", tail).cast("long").alias("del"), F.substring(x["new"], x["head"] + 1, size("new", tail)).alias("ins")),
        )

    found = let(F.struct(old.alias("old"), new.alias("new"), common_prefix(old, new).alias("head")), replaced)
    return F.when(old.isNotNull() & new.isNotNull(), found)


def leb128(n: int) -> bytes:
    """Seven bits a byte, least first; the high bit says that more follow."""
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def from_leb128(data: bytes) -> tuple[int, int]:
    """(number, bytes read)."""
    n = 0
    for k, byte in enumerate(data):
        n |= (byte & 127) << 7 * k
        if byte < 128:
            return n, k + 1
    raise ValueError("the number goes on past the end of the bytes")
