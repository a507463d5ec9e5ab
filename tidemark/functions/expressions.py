"""Column expressions of the archive: names, prices, scores, text for feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every script, not of ASCII alone.
SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
PRICE = rf"[$€£]{SPACE}?[0-9]"
# Points of each kind of change, and the words that a metric's identity ignores.
POINTS = {
    "tier_added": 100, "tier_removed": 100, "price_changed": 80, "billing_unit_changed": 70, "flag_changed": 60, "seats_changed": 50,
    "tier_renamed": 35, "usage_rate_added": 30, "usage_rate_removed": 30, "usage_rate_changed": 30, "features_changed": 10, "notes_changed": 5,
}
THRESHOLD = 40
PRICE_TOLERANCE = 0.15
FILLER = ("plan", "tier", "the", "a", "an", "billed", "monthly", "annually")


def differs(a: Column, b: Column) -> Column:
    """True also where only one side is null."""
    return ~a.eqNullSafe(b)


def number_text(c: Column) -> Column:
    """Whole numbers without a fraction, others as they print."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def normal_name(c: Column) -> Column:
    """A tier name without case, punctuation and the words plan and tier; inner spaces stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), r"\b(plan|tier)\b", ""))


def normal_metric(c: Column) -> Column:
    """A rate's metric as its words without filler; words of over three letters lose a last s."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: ~w.isin(*FILLER) & (w != ""))
    return F.array_join(F.transform(words, lambda w: F.regexp_replace(w, "^(.{3,})s$", "$1")), " ")


def json_text(c: Column) -> Column:
    """A string as JSON, null as null."""
    whole = F.to_json(F.struct(c.alias("v")))  # {"v":"..."}
    return F.when(c.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def json_number(c: Column) -> Column:
    return F.coalesce(number_text(c), F.lit("null"))


def plain_value(c: Column) -> Column:
    """A JSON value as text: null and what is no JSON are none, a list's items stand between commas, an object has no text of its own."""
    scalar = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"]
    items = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    listed = F.array_join(F.transform(items, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))), ",")
    text = F.when(c.startswith('"'), scalar).when(c.startswith("["), listed).when(c.startswith("{"), "[object Object]").otherwise(c)
    return F.when(c.isNull() | (c == "null"), "none").otherwise(F.coalesce(text, F.lit("none")))


def money(c: Column) -> Column:
    """A JSON number in dollars, thousands apart, rounded to three decimals at most."""
    number = F.round(c.cast("double").cast("decimal(30,10)"), 3)
    size = F.abs(number).cast("decimal(30,3)")
    part = F.regexp_replace(F.regexp_extract(size.cast("string"), r"\.[0-9]+$", 0), r"\.?0+$", "")
    return F.concat(F.lit("$"), F.when(number < 0, "-").otherwise(""), F.format_number(F.floor(size), 0), part)


def two_decimals(c: Column) -> Column:
    """A double with two decimals, rounded from its exact value: 1.005, which is a little less, gives 1.00."""
    size = F.abs(c)
    # 200 * size as a double and what that double lacks (Dekker's product): the nearest hundredth is told exactly.
    product = size * 200
    high = size * 134217729.0 - (size * 134217729.0 - size)
    lacking = (high * 200 - product) + (size - high) * 200
    tie_below = (product % 2 == 1) & (lacking < 0)
    n = F.floor((product + 1) / 2) - tie_below.cast("int")
    sign = F.when((c < 0), "-").otherwise("")
    return F.concat(sign, F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def change_label(kind: Column, path: Column, before: Column, after: Column) -> Column:
    """Tier and what happened to it: "Pro annual price $96 → $120", "Solo tier added"."""
    name = F.regexp_replace(path, "^tiers[.]", "")
    tier = F.when(~path.startswith("tiers."), path).otherwise(F.regexp_replace(name, "[.][^.]*$", ""))
    field = F.regexp_extract(path, "[^.]*$", 0)
    which = F.when(field == "monthly_price_usd", "").otherwise(F.concat(F.replace(F.regexp_replace(field, "_usd$", ""), F.lit("_"), F.lit(" ")), F.lit(" ")))
    numbers = (before != "null") & (after != "null")
    span = F.when(numbers, F.concat(money(before), F.lit(" → "), money(after))).otherwise(F.concat(plain_value(before), F.lit(" to "), plain_value(after)))
    said = F.concat(tier, F.lit(" "), F.replace(kind, F.lit("_"), F.lit(" ")))
    return F.when(kind == "price_changed", F.concat(tier, F.lit(" "), which, span)).otherwise(said)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def prices_close(a: Column, b: Column) -> Column:
    """Both unknown, or within the tolerance of the larger one."""
    larger = F.greatest(F.abs(a), F.abs(b))
    near = F.when(larger == 0, True).otherwise(F.abs(a - b) / larger <= PRICE_TOLERANCE)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(near)


def materiality(kind: Column, before: Column, after: Column, before_text: Column, after_text: Column) -> Column:
    """0 to 100: the points of the kind, adjusted for unknown sides and for the size of a price change."""
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv])[kind], F.lit(0))
    percent = F.floor(F.abs((after - before) / before * 100) + 0.5)
    price = F.when(before.isNull() | after.isNull(), 35).when(before == 0, 80).otherwise(F.least(F.lit(100), 80 + F.least(F.lit(20), percent)))
    unknown = before_text.isin('"unknown"', "null") | after_text.isin('"unknown"', "null")
    return F.when(kind == "price_changed", price).when((kind == "billing_unit_changed") & unknown, 35).otherwise(base).cast("int")


def provenance_kind(c: Column) -> Column:
    return F.when(c.startswith("wayback:"), "wayback").otherwise("live")


def csv_field(c: Column) -> Column:
    """Null is empty; what a spreadsheet would run is guarded; quotes where needed."""
    text = F.coalesce(c, F.lit(""))
    guarded = F.when(text.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(guarded.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def escape_xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def price_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(PRICE))


def capture_instant(stamp: Column) -> Column:
    """14 digits that name a real instant; null otherwise."""
    return F.when(stamp.rlike("^[0-9]{14}$"), F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")))


def densest_window(text: Column, size: int, stride: int) -> Column:
    """Start (from 0) and price count of the window with most prices; the first of equals."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - size), F.lit(stride))
    scored = F.transform(starts, lambda s: F.struct(price_count(F.substring(text, s + 1, F.lit(size))).alias("prices"), (-s).alias("start")))
    return F.array_max(scored)
