"""Byte sizes: `N`, or N with K, M, G, Ki, Mi or Gi, to the base 1024."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = "^([0-9]+)(K|M|G|Ki|Mi|Gi)?$"
_SHIFT = {"": 0, "K": 10, "Ki": 10, "M": 20, "Mi": 20, "G": 30, "Gi": 30}


def byte_size(text: Column) -> Column:
    """The number of bytes as long; null if the text isn't a size, or beyond a long."""
    t = F.trim(text)
    unit = F.regexp_extract(t, _FORM, 2)
    factor = F.when(unit.isin("K", "Ki"), 1 << 10).when(unit.isin("M", "Mi"), 1 << 20).when(unit.isin("G", "Gi"), 1 << 30).otherwise(1).cast("decimal(38,0)")
    number = F.when(t.rlike(_FORM), F.regexp_extract(t, _FORM, 1))
    product = F.when(F.length(F.ltrim(number, F.lit("0"))) <= 19, number).try_cast("decimal(20,0)") * factor
    return product.try_cast("long")


def parse_byte_size(text: str) -> int:
    m = re.fullmatch(_FORM, text.strip())
    if not m:
        raise ValueError(f"not a byte size: {text!r}")
    n = int(m[1]) << _SHIFT[m[2] or ""]
    if n >= 1 << 64:
        raise ValueError(f"byte size out of range: {text!r}")
    return n
