"""Typed changes between two states, their scores, and their confirmation by the next look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import THRESHOLD, differs, json_number, json_text, materiality

#: Fields of a tier; features is a JSON array.
FIELDS = ("name", "monthly", "annual", "billing_unit", "seats", "is_free", "is_enterprise", "features")
#: Names of the published document.
MONTHLY, ANNUAL, SEATS, FEATURES = "monthly_price_usd", "annual_price_usd", "included_seats", "headline_features"
_STAGES = ("exact", "normalized", "positional", "removed", "added")


def flags_json(row: str) -> Column:
    of = lambda f: F.coalesce(F.col(f"{row}.{f}").cast("string"), F.lit("null"))
    return F.concat(F.lit('{"is_free":'), of("is_free"), F.lit(',"is_enterprise":'), of("is_enterprise"), F.lit("}"))


def tier_json(row: str) -> Column:
    """A tier as JSON, its fields in the order of the published document."""
    f = lambda name: F.col(f"{row}.{name}")
    return F.concat(
        F.lit('{"name":'), json_text(f("name")), F.lit(f',"{MONTHLY}":'), json_number(f("monthly")), F.lit(f',"{ANNUAL}":'), json_number(f("annual")),
        F.lit(',"billing_unit":'), json_text(f("billing_unit")), F.lit(f',"{SEATS}":'), json_number(f("seats")), F.lit(","),
        F.substring(flags_json(row), F.lit(2), F.length(flags_json(row)) - 2), F.lit(f',"{FEATURES}":'), f("features"), F.lit("}"),
    )


def _event(kind: str, path: Column, before: Column, after: Column, when: Column, before_num: Column | None = None, after_num: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit(kind).alias("change_type"), path.alias("json_path"), before.alias("before"), after.alias("after"),
        (none if before_num is None else before_num).alias("before_num"), (none if after_num is None else after_num).alias("after_num"), when.alias("happened"),
    )


def _happened(rows: DataFrame, events: Column, part: int) -> DataFrame:
    """The events that happened, with ``place``: where the diff emits them."""
    stage = F.array_position(F.array(*map(F.lit, _STAGES)), F.col("how")).cast("int") if "how" in rows.columns else F.lit(0)
    ord_ = F.coalesce("before.ord", "after.ord").cast("int") if "how" in rows.columns else F.lit(0)
    found = rows.select("pair_id", stage.alias("stage"), ord_.alias("ord"), F.posexplode(events).alias("kind", "e")).where("e.happened")
    return found.select("pair_id", F.struct(F.lit(part).alias("part"), "stage", "ord", "kind").alias("place"), "e.*").drop("happened")


def tier_changes(matched: DataFrame) -> DataFrame:
    """The events of matched tiers (structs of ord and FIELDS): presence, name, prices, billing, seats, flags, features."""
    b, a = (lambda f: F.col(f"before.{f}")), (lambda f: F.col(f"after.{f}"))
    both = F.col("how").isin("exact", "normalized", "positional")
    at = lambda field: F.concat(F.lit("tiers."), a("name"), F.lit(f".{field}"))
    null = F.lit("null")
    moved = lambda f: both & differs(b(f), a(f))
    price = lambda f, name: _event("price_changed", at(name), json_number(b(f)), json_number(a(f)), moved(f), b(f), a(f))
    events = F.array(
        _event("tier_added", F.concat(F.lit("tiers."), a("name")), null, tier_json("after"), F.col("how") == "added"),
        _event("tier_removed", F.concat(F.lit("tiers."), b("name")), tier_json("before"), null, F.col("how") == "removed"),
        _event("tier_renamed", F.concat(F.lit("tiers."), a("name")), json_text(b("name")), json_text(a("name")), F.col("how") == "positional"),
        price("monthly", MONTHLY),
        price("annual", ANNUAL),
        _event("billing_unit_changed", at("billing_unit"), json_text(b("billing_unit")), json_text(a("billing_unit")), moved("billing_unit")),
        _event("seats_changed", at(SEATS), json_number(b("seats")), json_number(a("seats")), moved("seats")),
        _event("flag_changed", at("flags"), flags_json("before"), flags_json("after"), moved("is_free") | moved("is_enterprise")),
        _event("features_changed", at(FEATURES), b("features"), a("features"), moved("features")),
    )
    return _happened(matched, events, 0)


def rate_changes(matched: DataFrame) -> DataFrame:
    """The events of matched rates (structs of ord, metric and unit_price)."""
    rate = lambda side: json_number(F.col(f"{side}.unit_price"))
    path, null = F.concat(F.lit("usage_rates."), F.coalesce("after.metric", "before.metric")), F.lit("null")
    both = F.col("how").isin("exact", "normalized")
    events = F.array(
        _event("usage_rate_added", path, null, rate("after"), F.col("how") == "added"),
        _event("usage_rate_removed", path, rate("before"), null, F.col("how") == "removed"),
        _event("usage_rate_changed", path, rate("before"), rate("after"), both & differs(F.col("before.unit_price"), F.col("after.unit_price"))),
    )
    return _happened(matched, events, 1)


def notes_changes(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, before_notes, after_notes."""
    changed = differs(F.col("before_notes"), F.col("after_notes"))
    return _happened(pairs, F.array(_event("notes_changed", F.lit("notes"), json_text(F.col("before_notes")), json_text(F.col("after_notes")), changed)), 2)


def first_emissions(events: DataFrame) -> DataFrame:
    """Of the events of a pair at one path the first that is emitted."""
    order = W.partitionBy("pair_id", "json_path").orderBy("place")
    return events.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth", "place")


def scored(events: DataFrame) -> DataFrame:
    return events.withColumn("materiality", materiality(F.col("change_type"), F.col("before_num"), F.col("after_num"), F.col("before"), F.col("after")))


def confirmed(changes: DataFrame) -> DataFrame:
    """Add ``state`` from the next look's value, where there is one and both looks are trusted.

    ``changes`` has next_seen (is there a next look), next_value (JSON, null where the path names
    nothing), low (the current look or the next one is of low confidence).
    """
    presence = F.col("change_type").isin("tier_added", "tier_removed")
    value = F.coalesce("next_value", F.lit("null"))
    as_claimed = (value != "null") == (F.col("after") != "null")
    by_value = F.when(value == F.col("after"), "confirmed").when(value == F.col("before"), "retracted").otherwise("disputed")
    judged = F.when(presence, F.when(as_claimed, "confirmed").otherwise("retracted")).otherwise(by_value)
    open_ = ~F.col("next_seen") | F.coalesce(F.col("low"), F.lit(False)) | (F.col("materiality") < THRESHOLD)
    return changes.withColumn("state", F.when(open_, "candidate").otherwise(judged))


def values_at(tiers: DataFrame, rates: DataFrame, notes: DataFrame) -> DataFrame:
    """page_state, json_path, value: what every path of a state's document holds; the first of equal names."""

    def first(rows: DataFrame, name: str) -> DataFrame:
        order = W.partitionBy("page_state", name).orderBy("ord")
        return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")

    row = first(tiers, "name").select("page_state", F.struct("ord", *FIELDS).alias("t"))
    at = lambda field, value: F.struct(F.concat(F.lit("tiers."), "t.name", F.lit(field)).alias("json_path"), value.alias("value"))
    fields = F.array(
        at("", tier_json("t")), at(f".{MONTHLY}", json_number(F.col("t.monthly"))), at(f".{ANNUAL}", json_number(F.col("t.annual"))), at(".billing_unit", json_text(F.col("t.billing_unit"))),
        at(f".{SEATS}", json_number(F.col("t.seats"))), at(".flags", flags_json("t")), at(f".{FEATURES}", F.col("t.features")),
    )
    of_tiers = row.select("page_state", F.explode(fields).alias("v")).select("page_state", "v.*")
    of_rates = first(rates, "metric").select("page_state", F.concat(F.lit("usage_rates."), "metric").alias("json_path"), json_number(F.col("unit_price")).alias("value"))
    of_notes = notes.select("page_state", F.lit("notes").alias("json_path"), json_text(F.col("notes")).alias("value"))
    return of_tiers.unionByName(of_rates).unionByName(of_notes)
