"""Model output as VARIANT, read with Python's notion of integers and truth.

``from_json`` with a typed schema turns a whole array to null when one member has another type,
so members are looked at one by one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(raw: Column) -> Column:
    return F.try_parse_json(raw)


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def integers(value: Column, field: str) -> Column:
    """The integer members of an array field, in order; other members are left out."""
    members = F.try_variant_get(value, f"$.{field}", "array<variant>")
    whole = F.filter(members, lambda m: F.schema_of_variant(m) == "BIGINT")
    numbers = F.transform(whole, lambda m: F.try_variant_get(m, "$", "bigint"))
    return F.coalesce(numbers, F.array().cast("array<bigint>"))


def whole_numbers(value: Column, field: str) -> Column:
    """The integer members of an array field as decimal text, of up to 38 digits; other members are left out."""
    members = F.try_variant_get(value, f"$.{field}", "array<variant>")
    # Integers beyond 64 bits are decimals of 19 digits or more without a fraction.
    whole = F.filter(members, lambda m: F.rlike(F.schema_of_variant(m), F.lit(r"^(BIGINT|DECIMAL\((19|[23][0-9]),0\))$")))
    return F.coalesce(F.transform(whole, lambda m: F.try_variant_get(m, "$", "string")), F.array().cast("array<string>"))


def text_of(value: Column, field: str) -> Column:
    """A scalar field as text; a missing one is empty."""
    member = F.try_variant_get(value, f"$.{field}", "variant")
    kind = F.schema_of_variant(member)
    plain = F.try_variant_get(value, f"$.{field}", "string")
    return (
        F.when(member.isNull(), "")
        .when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(plain))
        .otherwise(plain)
    )


def truthy(value: Column, field: str) -> Column:
    """A field's truth: missing, null, false, zero and empty are false, anything else is true."""
    member = F.try_variant_get(value, f"$.{field}", "variant")
    kind = F.schema_of_variant(member)
    plain = F.try_variant_get(value, f"$.{field}", "string")
    falsy = (
        F.when(kind == "BOOLEAN", plain == "false")
        .when(kind == "STRING", plain == "")
        .when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), plain.isin("[]", "{}"))
        .otherwise(F.try_variant_get(value, f"$.{field}", "double") == 0.0)
    )
    return F.when(member.isNull() | (kind == "VOID"), False).otherwise(~F.coalesce(falsy, F.lit(False)))


def repair_ranking(ranking: Column, count: Column) -> Column:
    """1-based model ranking to a 0-based permutation of ``count`` positions.

    Unknown and repeated numbers are dropped; positions the model left out follow in order.
    """
    positions = F.transform(ranking, lambda n: n - 1)
    known = F.filter(positions, lambda p: (p >= 0) & (p < count))
    named = F.transform(F.array_distinct(known), lambda p: p.cast("int"))
    every = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.concat(named, F.array_except(every, named))


def is_permutation(order: Column, count: Column) -> Column:
    every = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.coalesce(F.array_sort(order) == every, F.lit(False))
