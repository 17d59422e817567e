"""Different orders of a cluster's reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import seeded

#: The largest number whose factorial is a long.
_LARGEST = 20
#: A prime above it: steps of it through n! numbers meet each of them once.
_STEP = 23


def unranked(items: Column, place: Column) -> Column:
    """The order of an array's items with this number, from 0 to n! - 1 in lexicographic order: its digits in the factorial
    system pick from what is left."""
    start = F.struct(items.alias("rest"), place.alias("at"), F.slice(items, F.lit(1), F.lit(0)).alias("made"))

    def pick(s: Column, left: Column) -> Column:
        f = F.factorial(left - 1)
        digit = ((s["at"] - s["at"] % f) / f).cast("int")
        rest = F.concat(F.slice(s["rest"], F.lit(1), digit), F.slice(s["rest"], digit + 2, F.size(s["rest"])))
        return F.struct(rest.alias("rest"), (s["at"] % f).alias("at"), F.concat(s["made"], F.array(F.element_at(s["rest"], digit + 1))).alias("made"))

    return F.when(F.size(items) == 0, items).otherwise(F.aggregate(F.sequence(F.size(items), F.lit(1)), start, pick, lambda s: s["made"]))


def read_orders(clusters: DataFrame, seed: str, most: int, key: str = "cluster_id", items: str = "nos") -> DataFrame:
    """key, order: min(most, n!) different orders of each cluster's `items`. Up to 20 items, orders are numbers below n!: from a
    hashed start in steps that no number divides. More items are sorted by one hash for each order, and of more than 10^18 orders
    no two are the same."""
    n = F.size(items)
    some = F.least(F.when(n <= _LARGEST, F.factorial(n)).otherwise(F.lit(most)), F.lit(most)).cast("int")
    drawn = clusters.select(key, items, F.explode(F.sequence(F.lit(0), some - 1)).alias("_j"))
    all_ = F.factorial(F.least(n, F.lit(_LARGEST)))
    begin = F.conv(F.substring(seeded(seed, F.col(key)), 1, 15), 16, 10).cast("long") % all_
    few = unranked(F.col(items), (begin + F.col("_j") * _STEP) % all_)
    hashed = F.transform(F.array_sort(F.transform(items, lambda v: F.struct(seeded(seed, F.col("_j"), F.col(key), v).alias("k"), v.alias("v")))), lambda x: x["v"])
    return drawn.select(key, F.when(n <= _LARGEST, few).otherwise(hashed).alias("order"))
