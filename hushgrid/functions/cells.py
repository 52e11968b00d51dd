"""Algebra of cell ids as Column expressions: pure bit work on the packed number.

A cell id is a hexadecimal string of 15 digits: four bits of mode, four of resolution, seven of base cell, and 15
digits of three bits, those finer than the resolution all ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Resolutions of blocks and regions, and the regions that one query may name.
BLOCK, REGION, MAX_REGIONS = 10, 5, 64
#: Base cells that are pentagons: a fixed value of the grid.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(cell: Column | str) -> Column:
    """The packed number; null unless the text is 15 hexadecimal digits."""
    c = _c(cell)
    return F.when(c.rlike("^[0-9a-f]{15}$"), F.conv(c, 16, 10).cast("long"))


def text(n: Column | str) -> Column:
    return F.lower(F.hex(_c(n)))


def resolution(cell: Column | str) -> Column:
    return F.shiftright(number(cell), 52).bitwiseAND(15).cast("int")


def _base(n: Column) -> Column:
    return F.shiftright(n, 45).bitwiseAND(127)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _valid(n: Column) -> Column:
    res = F.shiftright(n, 52).bitwiseAND(15).cast("int")
    used = F.call_function("shiftright", n.bitwiseAND((1 << 45) - 1), 45 - 3 * res)
    free = F.call_function("shiftleft", F.lit(1).cast("long"), 45 - 3 * res) - 1
    ones = sum(1 << (3 * k) for k in range(15))
    sevens = used.bitwiseAND(F.shiftright(used, 1)).bitwiseAND(F.shiftright(used, 2)).bitwiseAND(ones)
    # In octal text without leading zeros the first character is the first digit that isn't zero.
    deleted = _base(n).isin(*PENTAGONS) & F.conv(used.cast("string"), 10, 8).startswith("1")
    return (F.shiftright(n, 56) == 8) & (_base(n) < 122) & (sevens == 0) & (n.bitwiseAND(free) == free) & ~deleted


def is_valid(cell: Column | str) -> Column:
    """Mode, base cell and digits are those of a cell; on a pentagon the first digit that isn't zero isn't one."""
    return F.coalesce(let(number(cell), _valid), F.lit(False))


def is_block(cell: Column | str) -> Column:
    return is_valid(cell) & (resolution(cell) == BLOCK)


def is_region(cell: Column | str) -> Column:
    return is_valid(cell) & (resolution(cell) == REGION)


def parent_number(n: Column, res: int) -> Column:
    low = (1 << (3 * (15 - res))) - 1
    return n.bitwiseAND(~(15 << 52)).bitwiseOR(F.lit(res << 52)).bitwiseOR(F.lit(low))


def parent(cell: Column | str, res: int) -> Column:
    """The cell's ancestor at a coarser resolution; null for coarser cells than that."""
    return F.when(resolution(cell) >= res, text(parent_number(number(cell), res)))


def is_pentagon(n: Column, res: int) -> Column:
    digits = ((1 << 45) - 1) ^ ((1 << (3 * (15 - res))) - 1)
    return _base(n).isin(*PENTAGONS) & (n.bitwiseAND(digits) == 0)


def children_size(cell: Column | str, res: int, child: int) -> Column:
    """Number of cells of the child resolution in a cell of resolution res."""
    k = 7 ** (child - res)
    return F.when(is_pentagon(number(cell), res), F.lit(1 + 5 * (k - 1) // 6)).otherwise(F.lit(k)).cast("long")


def region_range(region: Column | str, child: int = BLOCK) -> tuple[Column, Column]:
    """First and last id, as text, of a region's cells at the child resolution."""
    n = number(region)
    free = sum(7 << (3 * (15 - r)) for r in range(REGION + 1, child + 1))
    sixes = sum(6 << (3 * (15 - r)) for r in range(REGION + 1, child + 1))
    low = n.bitwiseAND(~(15 << 52)).bitwiseOR(F.lit(child << 52)).bitwiseAND(F.lit(~free))
    return text(low), text(low.bitwiseOR(F.lit(sixes)))


def cells_of_regions(cells: DataFrame, regions: DataFrame, cell: str = "cell", region: str = "region") -> DataFrame:
    """The cells of at most MAX_REGIONS regions, by an equality join on the parent region rather than a range join."""
    wanted = regions.where(is_region(region)).select(region).distinct()
    if wanted.limit(MAX_REGIONS + 1).count() > MAX_REGIONS:
        raise ValueError(f"more than {MAX_REGIONS} regions")
    return cells.withColumn(region, parent(cell, REGION)).join(F.broadcast(wanted), region)  # at most MAX_REGIONS rows
