"""Column names: normal form, tokens, similarity; and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens too common in names of keys to tell them apart.
COMMON = ("id", "code", "no", "key")


def normal_name(c: Column) -> Column:
    x = F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.btrim(F.regexp_replace(x, "[^a-z0-9]+", "_"), F.lit("_"))


def tokens(name: Column) -> Column:
    """Distinct parts of a normal name without common ones; the whole name if none is left."""
    parts = F.array_distinct(F.filter(F.split(name, "_+"), lambda t: (t != "") & ~t.isin(*COMMON)))
    return F.when(F.size(parts) == 0, F.array(name)).otherwise(parts)


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal normal names, else the share of common tokens, at least 0.6 if one ends in the other."""
    x, y = normal_name(a), normal_name(b)
    shared, all_ = F.size(F.array_intersect(tokens(x), tokens(y))), F.size(F.array_union(tokens(x), tokens(y)))
    share = shared / all_
    return F.when(x == y, F.lit(1.0)).when(x.endswith(y) | y.endswith(x), F.greatest(share, F.lit(0.6))).otherwise(share)


def reference(schema: Column, table: Column, column: Column) -> Column:
    return F.concat_ws(".", F.when(schema != "", schema), table, column)
