"""Column helpers for names, codes and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions.numbers import col

# Fixed value: the text that stands for NULL inside a surrogate key.
KEY_NULL = "_dbt_utils_surrogate_key_null_"


def tidy(c: str | Column) -> Column:
    return F.trim(col(c))


def category(c: str | Column) -> Column:
    return F.upper(F.trim(col(c)))


def non_blank(c: str | Column) -> Column:
    return F.trim(col(c)) != ""


def capitalize(c: str | Column) -> Column:
    """First letter upper, the rest lower; ``initcap`` would touch every word."""
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def entity_label(name: str | Column, group: str | Column) -> Column:
    return F.concat(col(name), F.lit(" ("), capitalize(group), F.lit(")"))


def postal_prefix(c: str | Column, length: int = 3) -> Column:
    return F.substring(F.trim(col(c)), 1, length)


def surrogate_key(*cols: str | Column) -> Column:
    parts = [F.coalesce(col(c).cast("string"), F.lit(KEY_NULL)) for c in cols]
    return F.md5(F.concat_ws("-", *parts))


# Separator of packed texts, and what an escape begins with.
_SEP, _ESC = "\x1f", "\x10"
#: Texts that ``pack`` takes at most: a bit each in one LONG.
PACK_MOST = 63


def pack(*cols: Column) -> tuple[Column, Column]:
    """Texts as one text and a LONG with a bit per NULL: both are equal only where all texts are."""
    escaped = [F.replace(F.replace(c, F.lit(_ESC), F.lit(_ESC + "e")), F.lit(_SEP), F.lit(_ESC + "s")) for c in cols]
    nulls = [F.when(c.isNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(cols)]
    return F.concat_ws(_SEP, *[F.coalesce(c, F.lit("")) for c in escaped]), reduce(Column.bitwiseOR, nulls)


def unpack(packed: Column) -> Column:
    """The array of texts that ``pack`` made one of, NULLs as empty texts."""
    fields = F.split(packed, _SEP)
    plain = F.transform(fields, lambda x: F.replace(F.replace(x, F.lit(_ESC + "s"), F.lit(_SEP)), F.lit(_ESC + "e"), F.lit(_ESC)))
    return F.when(packed.contains(_ESC), plain).otherwise(fields)


def request_key(url: str | Column, params_json: str | Column) -> Column:
    """Key of a landed request: md5 of the address and its parameters as sorted JSON."""
    return F.md5(F.concat(col(url), F.coalesce(col(params_json), F.lit("{}"))))


def json_field(c: str | Column, path: str, dtype: str = "string") -> Column:
    return F.get_json_object(col(c), f"$.{path}").try_cast(dtype)
