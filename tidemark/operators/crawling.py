"""Rules of robots files, spacing of requests to a host, and candidates' screening in numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """host, allow (boolean), pattern: the rules for ``agent`` of the robots text of each host.

    User-agent lines that follow each other share the rules after them; groups of one name are one.
    A host that names the agent uses its group, else that of ``*``."""
    lines = files.select("host", F.posexplode(F.split("robots", r"\r?\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where(F.instr("line", ":") > 0)
    lines = lines.select("host", "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    names = F.col("field") == "user-agent"
    lines = lines.where(names | (F.col("field").isin("allow", "disallow") & (F.col("value") != "")))
    order = W.partitionBy("host").orderBy("at")
    opens = names & ~F.coalesce(F.lag("field").over(order) == "user-agent", F.lit(False))
    lines = lines.withColumn("part", F.sum(opens.cast("int")).over(order))
    agents = lines.where(names).select("host", "part", F.lower("value").alias("agent"))
    wanted = agents.where(F.col("agent").isin(agent.lower(), "*")).groupBy("host").agg(F.max((F.col("agent") == agent.lower()).cast("int")).alias("own"))
    chosen = agents.join(wanted, "host").where(F.col("agent") == F.when(F.col("own") == 1, agent.lower()).otherwise("*")).select("host", "part").distinct()
    return lines.where(~names).join(chosen, ["host", "part"]).select("host", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))


def robots_pattern(pattern: Column) -> Column:
    """A rule as a regular expression: ``*`` is any text, a last ``$`` the end."""
    safe = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(safe, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))


def robots_decisions(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``paths`` (host, path) with ``allowed``: the longest rule wins, and of equal ones the permission."""
    by_host = rules.groupBy("host").agg(F.collect_list(F.struct(F.col("allow"), F.length("pattern").alias("n"), robots_pattern(F.col("pattern")).alias("regex"))).alias("rules"))
    longest = lambda allow: F.coalesce(F.array_max(F.transform(F.filter("rules", lambda r: (r["allow"] == allow) & F.regexp_like(F.col("path"), r["regex"])), lambda r: r["n"])), F.lit(-1))
    rows = paths.join(by_host, "host", "left")
    return rows.withColumn("allowed", (longest(False) == -1) | (longest(True) >= longest(False))).drop("rules")


def spaced(requests: DataFrame, host: str, at: str, order: list[str], seconds: float) -> DataFrame:
    """Add ``starts``: when each request may start if those of a host are so far apart.

    A start is the latest of its own time and the one before plus the gap: the k-th is k gaps after
    the largest of (time - gaps before it) so far."""
    window = W.partitionBy(host).orderBy(*order)
    kth = F.row_number().over(window) - 1
    rows = requests.withColumn("_kth", kth).withColumn("_base", F.col(at) - F.col("_kth") * seconds)
    return rows.withColumn("starts", F.max("_base").over(window.rowsBetween(W.unboundedPreceding, 0)) + F.col("_kth") * seconds).drop("_kth", "_base")
