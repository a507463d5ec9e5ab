"""Whether a stored pricing document has the shape that everything else relies on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that two fields may hold, and the most items of two lists.
UNITS = ("per_seat", "flat", "usage", "unknown")
CONFIDENCES = ("high", "medium", "low")
MAX_FEATURES, MAX_RATES = 8, 100

VARIANTS = "array<variant>"


def nothing() -> Column:
    return F.array().cast("array<string>")


def worked_out_once(c: Column, then) -> Column:
    """``then`` of a column that is worked out once for each row, however often ``then`` names it."""
    return F.transform(F.array(c), then)[0]


def kind(v: Column) -> Column:
    """missing, null, string, number, boolean, array or object."""
    named = lambda name: (
        F.when(name.isNull(), "missing").when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").when(name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").otherwise("object")
    )
    return worked_out_once(F.schema_of_variant(v), named)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _must(path: Column, v: Column, *kinds: str) -> Column:
    """A list with what is wrong with the type of a value, if anything is."""
    wrong = lambda got: F.when(~got.isin(*kinds), F.array(F.concat(path, F.lit(f": expected {' or '.join(kinds)}, got "), got))).otherwise(nothing())
    return worked_out_once(kind(v), wrong)


def _one_of(path: Column, v: Column, words: tuple[str, ...]) -> Column:
    wrong = F.array(F.concat(path, F.lit(f": expected one of {', '.join(words)}")))
    known = lambda v: (kind(v) == "string") & F.try_variant_get(v, "$", "string").isin(*words)
    return worked_out_once(v, lambda v: F.when(known(v), nothing()).otherwise(wrong))


def _each(path: str, v: Column, most: int | None, check) -> Column:
    """What is wrong with a list, and with each of its items."""
    at = lambda i: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))

    def inner(items: Column) -> Column:
        found = F.flatten(F.transform(items, lambda x, i: worked_out_once(at(i), lambda place: check(place, x))))
        if most is None:
            return found
        return F.concat(F.when(F.size(items) > most, F.array(F.lit(f"{path}: more than {most} items"))).otherwise(nothing()), found)

    listed = lambda v: worked_out_once(F.try_variant_get(v, "$", VARIANTS), inner)
    return worked_out_once(v, lambda v: F.when(kind(v) == "array", listed(v)).otherwise(_must(F.lit(path), v, "array")))


def _tier(at: Column, tier: Column) -> Column:
    path = lambda name: F.concat(at, F.lit(f".{name}"))
    counted = lambda texts: F.concat(
        F.when(F.size(texts) > MAX_FEATURES, F.array(F.concat(path("headline_features"), F.lit(f": more than {MAX_FEATURES} items")))).otherwise(nothing()),
        F.when(F.exists(texts, lambda x: kind(x) != "string"), F.array(F.concat(path("headline_features"), F.lit(": expected strings")))).otherwise(nothing()),
    )
    texts = lambda features: worked_out_once(F.try_variant_get(features, "$", VARIANTS), counted)
    listed = worked_out_once(field(tier, "headline_features"), lambda v: F.when(kind(v) == "array", texts(v)).otherwise(_must(path("headline_features"), v, "array")))
    checks = [_must(path(n), field(tier, n), *k) for n, k in (("name", ("string",)), ("monthly_price_usd", ("number", "null")), ("annual_price_usd", ("number", "null")))]
    checks += [_one_of(path("billing_unit"), field(tier, "billing_unit"), UNITS), _must(path("included_seats"), field(tier, "included_seats"), "number", "null")]
    checks += [_must(path(n), field(tier, n), "boolean") for n in ("is_free", "is_enterprise")]
    return F.when(kind(tier) == "object", F.concat(*checks, listed)).otherwise(_must(at, tier, "object"))


def _rate(at: Column, rate: Column) -> Column:
    path = lambda name: F.concat(at, F.lit(f".{name}"))
    checks = F.concat(_must(path("metric"), field(rate, "metric"), "string"), _must(path("unit_price_usd"), field(rate, "unit_price_usd"), "number"))
    return F.when(kind(rate) == "object", checks).otherwise(_must(at, rate, "object"))


def schema_violations(text: Column) -> Column:
    """What is wrong with a document (JSON text), path by path; an empty list if nothing is. Unknown fields are let be."""
    checks = lambda v: F.concat(
        _must(F.lit("currency"), field(v, "currency"), "string"), _each("tiers", field(v, "tiers"), None, _tier), _each("usage_rates", field(v, "usage_rates"), MAX_RATES, _rate),
        _must(F.lit("notes"), field(v, "notes"), "string", "null"), _one_of(F.lit("extraction_confidence"), field(v, "extraction_confidence"), CONFIDENCES),
    )
    other = lambda got: F.array(F.concat(F.lit("expected object, got "), got))
    told = lambda v: worked_out_once(kind(v), lambda got: F.when(got == "missing", F.array(F.lit("not JSON"))).when(got == "object", checks(v)).otherwise(other(got)))
    return worked_out_once(F.try_parse_json(text), told)
