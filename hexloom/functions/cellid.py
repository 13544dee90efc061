"""H3 cell ids as Column expressions.

An H3 index is a 64-bit integer: mode in bits 59-62, resolution in bits 52-55, base cell in bits
45-51 and fifteen 3-bit digits below that, unused digits being 7.  The top bit is always 0, so the
index fits Spark's signed LONG and hierarchy work is pure bit arithmetic inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINEST = 11
CELL_MODE = 1
BASE_CELLS = 122
MAX_RESOLUTION = 15

# The twelve pentagonal base cells of the published grid.
PENTAGON_BASE_CELLS = [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]

_DIGIT_BITS = (1 << 45) - 1
_LOW_BIT_OF_EACH_DIGIT = sum(1 << (3 * k) for k in range(15))
_RESOLUTION_MASK = 15 << 52


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def string_to_cell(text: Column) -> Column:
    """Hex text to LONG; anything that is not a 15-digit (or zero-padded) hex id gives NULL."""
    is_hex = text.rlike("^0?[0-9a-fA-F]{15}$")
    return F.when(is_hex, F.conv(text, 16, 10).cast("long"))


def cell_to_string(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def resolution(cell: Column) -> Column:
    return F.shiftright(cell, 52).bitwiseAND(_long(15)).cast("int")


def base_cell(cell: Column) -> Column:
    return F.shiftright(cell, 45).bitwiseAND(_long(127)).cast("int")


def unused_digits(res: int) -> int:
    """Bits of the digits finer than ``res``."""
    return (1 << (3 * (MAX_RESOLUTION - res))) - 1


def cell_to_parent(cell: Column, res: int, checked: bool = True) -> Column:
    """Ancestor of ``cell`` at ``res``; NULL when ``res`` is finer than the cell.

    ``checked=False`` drops that test where the resolution is already known.
    """
    if not 0 <= res <= MAX_RESOLUTION:
        raise ValueError(f"resolution {res} is outside 0..{MAX_RESOLUTION}")
    parent = cell.bitwiseAND(_long(~_RESOLUTION_MASK)).bitwiseOR(_long((res << 52) | unused_digits(res)))
    return F.when(resolution(cell) >= res, parent) if checked else parent


def _unused_digit_bits(cell: Column) -> Column:
    width = F.lit(3) * (F.lit(MAX_RESOLUTION) - resolution(cell))
    return F.call_function("shiftleft", _long(1), width) - 1


def is_pentagon_base(cell: Column) -> Column:
    return base_cell(cell).isin(PENTAGON_BASE_CELLS)


def in_deleted_sector(cell: Column, res: int | None = None) -> Column:
    """True where the first non-zero digit is 1, the sector a pentagon does not have.

    Written in base 8 the digits lose their leading zeros, so the first character is that digit.
    Give ``res`` where the resolution is known: the expression then uses ``cell`` only once.
    """
    if res is None:
        used = cell.bitwiseAND(_long(_DIGIT_BITS)).bitwiseAND(F.bitwise_not(_unused_digit_bits(cell)))
    else:
        used = cell.bitwiseAND(_long(_DIGIT_BITS & ~unused_digits(res)))
    return F.conv(used.cast("string"), 10, 8).startswith("1")


def is_valid_cell(cell: Column) -> Column:
    """Whether a LONG is a cell index: header bits, base cell, digits and pentagon sector."""
    digits = cell.bitwiseAND(_long(_DIGIT_BITS))
    sevens = (
        digits.bitwiseAND(F.shiftright(digits, 1))
        .bitwiseAND(F.shiftright(digits, 2))
        .bitwiseAND(_long(_LOW_BIT_OF_EACH_DIGIT))
    )
    expected = _unused_digit_bits(cell).bitwiseAND(_long(_LOW_BIT_OF_EACH_DIGIT))
    header_ok = F.shiftright(cell, 56) == _long(CELL_MODE << 3)
    ok = (
        header_ok
        & (base_cell(cell) < BASE_CELLS)
        & (sevens == expected)
        & ~(is_pentagon_base(cell) & in_deleted_sector(cell))
    )
    return F.coalesce(ok, F.lit(False))


def is_valid_cell_string(text: Column) -> Column:
    return is_valid_cell(string_to_cell(text))


def child_at(cell: Column, number: Column, res: int) -> Column:
    """The ``number``-th descendant (0-based, digit order) of ``cell`` at ``res``.

    ``number`` runs over ``0 .. 7^(res - own resolution) - 1``.  Below a pentagon some of these
    do not exist: keep only rows where ``in_deleted_sector`` is false.
    """
    own = resolution(cell)
    child = (
        cell.bitwiseAND(_long(~_RESOLUTION_MASK))
        .bitwiseAND(F.bitwise_not(_unused_digit_bits(cell)))
        .bitwiseOR(_long((res << 52) | unused_digits(res)))
    )
    for level in range(1, res + 1):
        digit = F.pmod(F.call_function("div", number, _long(7 ** (res - level))), _long(7))
        shifted = F.shiftleft(digit, 3 * (MAX_RESOLUTION - level))
        child = child.bitwiseOR(F.when(own < level, shifted).otherwise(_long(0)))
    return child


def child_count(cell: Column, res: int) -> Column:
    """``7^(res - own resolution)``, the number range of :func:`child_at`."""
    branches = F.when(resolution(cell) == res, _long(1))
    for own in range(res):
        branches = branches.when(resolution(cell) == own, _long(7 ** (res - own)))
    return branches


def finest_range(cell: int) -> tuple[int, int]:
    """Bounds of all finest ids under one cell: ids of a family are contiguous."""
    res = cell >> 52 & 15
    high = (cell & ~_RESOLUTION_MASK) | (FINEST << 52)
    below = unused_digits(res) & ~unused_digits(FINEST) if res < FINEST else 0
    return high & ~below, high


def finest_bounds(cell: Column) -> tuple[Column, Column]:
    """:func:`finest_range` as columns."""
    high = cell.bitwiseAND(_long(~_RESOLUTION_MASK)).bitwiseOR(_long(FINEST << 52))
    below = _unused_digit_bits(cell).bitwiseAND(_long(~unused_digits(FINEST)))
    return high.bitwiseAND(F.bitwise_not(below)), high


def ranges_without_gaps(spans: list[tuple[int, int]], gaps: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all ``spans`` (sorted) but for the widest gaps.

    Gaps are those between spans and the given ones, each inside a span.  A gap that a second span reaches over (an
    ancestor of the family) is none.
    """
    if not spans:
        return []
    merged = [list(spans[0])]
    for low, high in spans[1:]:
        if low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    whole = [span for span in spans if any(o != span and o[0] <= span[0] and span[1] <= o[1] for o in spans)] if len(merged) < len(spans) else []
    inside = [gap for gap in gaps if not any(low <= gap[0] and gap[1] <= high for low, high in whole)]
    alone = inside + [(a[1], b[0]) for a, b in zip(merged, merged[1:])]
    cuts = sorted(sorted(alone, key=lambda gap: gap[0] - gap[1])[: most - 1])
    starts, ends = [merged[0][0], *(high for _, high in cuts)], [*(low for low, _ in cuts), merged[-1][1]]
    return list(zip(starts, ends))
