"""What tile a file's path names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolved_parts(path: Column) -> Column:
    """The path's parts: percent escapes decoded, backslashes read as slashes, empty and ``.`` parts dropped, ``..`` resolved."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    parts = F.filter(F.split(F.translate(F.trim(plain), "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.aggregate(parts, F.array().cast("array<string>"), up)


def tile_of(path: Column, scheme: Column) -> Column:
    """Struct ``z, x, y`` (counted from the north) that a path names, or null if it names no tile.

    The last three parts are z, x and y with a png, jpg or jpeg suffix in any case; all three must be plain digits. A
    null or unknown scheme means xyz; tms counts y from the south.
    """
    parts = resolved_parts(path)
    digits = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("long"))
    name = F.regexp_extract(F.try_element_at(parts, F.lit(-1)), r"(?i)^([0-9]+)\.(?:png|jpe?g)$", 1)
    z, x, y = digits(F.try_element_at(parts, F.lit(-3))), digits(F.try_element_at(parts, F.lit(-2))), digits(name)
    south = F.coalesce(F.lower(F.trim(scheme)) == "tms", F.lit(False))
    north = F.when(south, F.pow(F.lit(2.0), z).cast("long") - 1 - y).otherwise(y)
    return F.when((F.size(parts) >= 3) & (z <= 62) & x.isNotNull() & y.isNotNull(), F.struct(z.cast("int").alias("z"), x.alias("x"), north.alias("y")))
