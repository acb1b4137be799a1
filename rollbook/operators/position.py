"""Places in the stream of blocks as texts that sort like what they are made of.

A position is the block, the transaction's place in it, burns before outputs, the output's
index, asset and policy: numbers as hex digits of all 64 bits, so it follows from the row
alone and no block or transaction can be too long for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 16
SIGN = -(1 << 63)


def _digits(number: Column) -> Column:
    """A long as text in the order of numbers: the sign bit is turned over."""
    return F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(SIGN))), DIGITS, "0")


def of_row(block: Column, tx_pos: Column, phase: Column, out_pos: Column, asset: Column, policy: Column) -> Column:
    number = F.concat(_digits(block), _digits(tx_pos), phase.cast("string"), _digits(out_pos))
    return F.concat(number, asset, F.lit(" "), policy)


def end_of_block(block: Column) -> Column:
    """After every row of the block and before the next block."""
    return F.concat(_digits(block), F.lit("~"))


def block_of(position: Column) -> Column:
    return F.substring(position, 1, DIGITS)


def number_of(digits: Column) -> Column:
    """Sixteen digits as a number in the same order."""
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def part_of(position: Column) -> Column:
    """Transaction, and burns or outputs."""
    return F.substring(position, 1, 2 * DIGITS + 1)


def index_of(position: Column) -> Column:
    return number_of(F.substring(position, 2 * DIGITS + 2, DIGITS))
