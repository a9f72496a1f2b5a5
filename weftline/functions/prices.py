"""Old wide price records -> price rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline import fixed_values as fx

PRICE_ROW = "array<struct<audience:string,price:double,min:int,max:int,phrase:string>>"


def old_price_rows(field: Callable[[str], Column]) -> Column:
    """ARRAY of price rows of one wide record: age tiers, identity tiers, family, and the free-under-age rule.

    ``field(name)`` gives <tier>_price, <tier>_min, <tier>_max and free_under_age; tiers without a price give no row.
    """
    note, none = F.lit(fx.OLD_PRICE_NOTE), F.lit(None).cast("int")
    def row(audience, price, low=none, high=none):
        return F.when(price.isNotNull(), F.struct(F.lit(audience).alias("audience"), price.cast("double").alias("price"), low.cast("int").alias("min"),
                                                  high.cast("int").alias("max"), note.alias("phrase")))
    ages = [row(a, field(f"{a}_price"), field(f"{a}_min"), field(f"{a}_max")) for a in fx.AGE_AUDIENCES]
    others = [row(a, field(f"{a}_price")) for a in [*fx.IDENTITY_AUDIENCES, "family"]]
    under = field("free_under_age").cast("int")
    phrase = F.concat(F.lit("free under age "), under.cast("string"), F.lit(" ("), note, F.lit(")"))
    free = F.when(under > 0, F.struct(F.lit("child").alias("audience"), F.lit(0.0).alias("price"), F.lit(0).alias("min"), (under - 1).alias("max"), phrase.alias("phrase")))
    return F.array_compact(F.array(*ages, *others, free))
