"""Checks of extracted documents against the page, and the screening of candidate pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import SPACE, number_text, price_count, two_decimals

# Plan names in order of preference, words that are no headings, and limits.
PLAN_NAMES = ("Enterprise", "Business", "Professional", "Team", "Starter", "Growth", "Scale", "Premium", "Standard", "Individual", "Organization", "Developer", "Hobby", "Solo", "Basic", "Plus", "Pro")
NO_HEADINGS = (
    "home", "about", "blog", "careers", "contact", "sign in", "sign up", "log in", "login", "logout", "docs", "documentation", "support", "help", "menu", "search", "privacy", "terms",
    "cookie", "cookies", "faq", "pricing", "features", "products", "product", "resources", "community", "status", "changelog", "sales", "company", "legal", "security", "partners", "customers",
)
MIN_CANARY = 8
MIN_PRICES = 2
HEADING = r"([A-Z][a-zA-Z]{1,24})(?=[$€£]\s?[0-9])"


def number_appears(value: Column, text: Column) -> Column:
    """Whether a number stands in the text by itself, as it prints or with two decimals; commas do not count."""
    plain, two = F.replace(text, F.lit(","), F.lit("")), two_decimals(value)
    forms = F.array_distinct(F.array(number_text(value), F.regexp_replace(two, r"\.?0+$", ""), two))
    bounded = lambda form: F.regexp_like(plain, F.concat(F.lit(r"(?<![0-9.])"), F.replace(form, F.lit("."), F.lit(r"\.")), F.lit("(?![0-9.])")))
    return F.exists(forms, bounded)


def free_appears(name: Column, text: Column) -> Column:
    """Whether the page says that the tier is free: right after its name, or anywhere for a tier of that name."""
    word = F.regexp_like(text, F.lit(r"(?<![a-zA-Z])(?i:free)(?![a-z])"))
    literal = F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    after_name = F.regexp_like(text, F.concat(F.lit(r"(?<![a-zA-Z])(?i:\Q"), literal, F.lit(rf"\E)(?:{SPACE}|\p{{P}}){{0,6}}(?i:free)(?![a-z])")))
    return F.when(F.lower(F.trim(name)) == "free", word).otherwise(after_name)


def grounding_violations(claims: DataFrame) -> DataFrame:
    """The claims (text, place, name, value, is_free) whose number the page does not hold, with ``violation``."""
    free = (F.col("value") == 0) & F.coalesce("is_free", F.lit(False)) & free_appears(F.coalesce("name", F.lit("")), F.col("text"))
    bad = claims.where(F.col("value").isNotNull() & ~free & ~number_appears(F.col("value"), F.col("text")))
    return bad.withColumn("violation", F.concat("place", F.lit(" = "), number_text(F.col("value")), F.lit(" does not appear in the page text")))


def consistency_violations(tiers: DataFrame) -> DataFrame:
    """Free tiers (name, monthly, annual, is_free) whose prices are not zero, with ``violation``."""
    shown = lambda c: F.coalesce(number_text(F.col(c)), F.lit("null"))
    said = lambda c, field: F.concat(F.lit("tiers."), "name", F.lit(f".is_free = true but {field} = "), shown(c), F.lit(" (free tiers must price at 0)"))
    free = F.coalesce("is_free", F.lit(False))
    found = F.array(
        F.when(free & ~F.col("monthly").eqNullSafe(F.lit(0.0)), said("monthly", "monthly_price_usd")),
        F.when(free & (F.col("annual") != 0), said("annual", "annual_price_usd")),
    )
    return tiers.withColumn("violation", F.explode(F.array_compact(found)))


def headings(text: Column) -> Column:
    """Capitalised words right before a price, in order; words of navigation are none."""
    return F.filter(F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)), lambda h: ~F.lower(h).isin(*NO_HEADINGS))


def occurrences(text: Column, part: Column) -> Column:
    """How often a text holds a part, without overlaps."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(part == "", 0).otherwise((gone / F.length(part)).cast("int"))


def canary(found: Column, raw: Column) -> Column:
    """The text whose loss tells of a redesign: the rarest plan name of the raw page, then the longest
    rare heading, else null."""
    plans = F.transform(F.array(*map(F.lit, PLAN_NAMES)), lambda p, i: F.struct(occurrences(raw, p).alias("n"), (-F.length(p)).alias("short"), i.alias("i"), p.alias("text")))
    plan = F.array_min(F.filter(plans, lambda p: p["n"] >= 1))
    words = F.filter(found, lambda h: ~F.regexp_like(h, F.lit("[0-9]")) & (F.length(h) >= MIN_CANARY))
    words = F.transform(words, lambda h, i: F.struct((-F.length(h)).alias("short"), i.alias("i"), h.alias("text"), occurrences(raw, h).alias("n")))
    words = F.filter(words, lambda w: w["n"] >= 1)
    rare = F.filter(words, lambda w: w["n"] <= 2)
    return F.coalesce(plan["text"], F.array_min(F.when(F.size(rare) > 0, rare).otherwise(words))["text"])


def screened(pages: DataFrame) -> DataFrame:
    """Pages (raw, text) with price_matches, tier_headings, proposed_canary, verdict and reason."""
    rows = pages.withColumn("_found", headings(F.col("text"))).withColumn("price_matches", price_count(F.col("text")))
    rows = rows.withColumns({"tier_headings": F.size("_found"), "proposed_canary": canary(F.col("_found"), F.col("raw"))}).drop("_found")
    enough = F.col("price_matches") >= MIN_PRICES
    good = F.concat(F.col("price_matches").cast("string"), F.lit(" price matches in the normalized text ("), F.col("tier_headings").cast("string"), F.lit(" tier-like headings)"))
    bad = F.concat(F.lit(f"fewer than {MIN_PRICES} price matches (found "), F.col("price_matches").cast("string"), F.lit(")"))
    return rows.withColumns({"verdict": F.when(enough, "pass").otherwise("fail"), "reason": F.when(enough, good).otherwise(bad)})
