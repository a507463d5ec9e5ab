"""Small cases of page normalisation, grounding, screening, robots, spacing, labels and the stream of runs."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.functions import markup
from tidemark.operators import crawling, extraction
from tidemark.streaming import runs

SIMPLE = "<html><body><main><div><h2>Free</h2><p>$0</p></div> <div><h2>Pro</h2><p>$20/mo</p></div> <div><h2>Enterprise</h2><p>Contact sales</p></div></main></body></html>"
NOISE = '<nav>Home $1</nav><!-- $2 --><script>var a = "$3";</script><svg>$4</svg><div id="cookie-consent">ok $5</div><footer>$0</footer><div class="intercom-frame">$6</div>'


def test_noise_does_not_move_the_text():
    noisy = SIMPLE.replace("<body>", f"<body>{NOISE}")
    assert markup.normal_text(noisy) == markup.normal_text(SIMPLE)
    assert "Pro$20/mo" in markup.normal_text(SIMPLE)
    assert markup.normal_text(noisy.replace("$20", "$24")) != markup.normal_text(noisy)
    assert markup.normal_text(None) == markup.normal_text("") == ""


def test_slice_body_and_window():
    assert markup.normal_text("<body><p>about  us</p>\n<div><b>x</b></div></body>") == "about us x"
    assert markup.normal_text("<body><p>about</p><div><i>$1</i> <i>$2</i></div></body>") == "$1 $2"
    assert markup.normal_text("<body><p>about</p><div><i>$1</i> <i>$2</i></div></body>", widen=True) == "about$1 $2"
    filler = "word " * 40_000
    text = markup.normal_text(f"<body>{filler}$1 $2 $3{filler}</body>")
    assert len(text) == markup.SLICE_CHARS and "$1 $2 $3" in text


def test_late_closers(spark):
    page = "<div>A</div><style>x</style\n\t><template>y</template ><div>B</div>"
    found = spark.createDataFrame([(page,), (None,)], "html string").select(markup.normal_closers(F.col("html")).alias("c"), markup.normalized(F.col("html"))["text"].alias("t")).collect()
    assert found[0]["c"] == "<div>A</div><style>x</style><template>y</template><div>B</div>" and found[0]["t"] == "AB" and found[1]["t"] == ""


GROUND = [
    ("Pro is $20.50 since 2026", 20.0, "Pro", False, True), ("Pro is $20 a month", 20.0, "Pro", False, False), ("Pro is $20.00", 20.0, "Pro", False, False), ("now $1,200 a year", 1200.0, "Pro", False, False),
    ("only $0.09", 0.09, None, None, False), ("only 0.095", 0.09, None, None, True), ("StarterFree limited", 0.0, "Starter", True, False), ("Starter — Free forever", 0.0, "starter", True, False),
    ("Risk-free guarantee. Starter", 0.0, "Starter", True, True), ("StarterFreelance", 0.0, "Starter", True, True), ("Free $10", 0.0, "Free", True, False), ("HassleFreeSetup", 0.0, "Free", True, True),
    ("StarterFree", 0.0, "Starter", False, True), ("nothing", None, "Pro", False, False), ("A.B+ Free", 0.0, "A.B+", True, False),
]


def test_grounding(spark):
    rows = [(i, text, "p", name, value, free) for i, (text, value, name, free, _) in enumerate(GROUND)]
    df = spark.createDataFrame(rows, "i int, text string, place string, name string, value double, is_free boolean")
    found = {r["i"] for r in extraction.grounding_violations(df).collect()}
    assert found == {i for i, case in enumerate(GROUND) if case[-1]}


def test_consistency(spark):
    df = spark.createDataFrame([("A", 0.0, None, True), ("B", None, 0.0, True), ("C", 5.0, 60.0, True), ("D", 5.0, None, False)], "name string, monthly double, annual double, is_free boolean")
    found = sorted(r["violation"] for r in extraction.consistency_violations(df).collect())
    assert len(found) == 3 and found[0] == "tiers.B.is_free = true but monthly_price_usd = null (free tiers must price at 0)"


@pytest.mark.parametrize(
    ("raw", "found", "wanted"),
    [("Enterprise Enterprise Professional Pro", [], "Professional"), ("Kilimanjaro Fuji", ["Fuji", "Kilimanjaro"], "Kilimanjaro"), ("short", ["short"], None), ("x", ["Kilimanjaro"], None), ("Team Solo", [], "Team")],
)
def test_canary(spark, raw, found, wanted):
    df = spark.createDataFrame([(raw, found)], "raw string, found array<string>")
    assert df.select(extraction.canary(F.col("found"), F.col("raw")).alias("c")).first()["c"] == wanted


def test_robots(spark):
    text = "User-agent: a\nUser-agent: mybot\nDisallow: /private\nAllow: /private/ok$\n\nUser-agent: *\nDisallow: /\n"
    paths = ["/private", "/private/x", "/private/ok", "/private/okay", "/open"]
    files = spark.createDataFrame([("h", text), ("star", "User-agent: *\nDisallow: /*.pdf$"), ("none", "")], "host string, robots string")
    asked = spark.createDataFrame([("h", p) for p in paths] + [("star", "/a.pdf"), ("star", "/a.pdfx"), ("none", "/"), ("other", "/")], "host string, path string")
    found = {(r["host"], r["path"]): r["allowed"] for r in crawling.robots_decisions(asked, crawling.robots_rules(files, "MyBot")).collect()}
    assert [found["h", p] for p in paths] == [False, False, True, False, True]
    assert not found["star", "/a.pdf"] and found["star", "/a.pdfx"] and found["none", "/"] and found["other", "/"]


def test_spacing(spark):
    df = spark.createDataFrame([("h", 0, 1), ("h", 3, 2), ("h", 40, 3), ("g", 1, 4)], "host string, at long, id int")
    assert [r["starts"] for r in crawling.spaced(df, "host", "at", ["at"], 10).orderBy("id").collect()] == [0, 10, 40, 1]


def test_labels(spark):
    rows = [
        ("price_changed", "tiers.Pro.monthly_price_usd", "16", "18", "Pro $16 → $18"), ("price_changed", "tiers.Pro.annual_price_usd", "96", "1200", "Pro annual price $96 → $1,200"),
        ("price_changed", "tiers.Team 2.0.monthly_price_usd", "null", "299", "Team 2.0 none to 299"), ("tier_added", "tiers.Solo", "null", "{}", "Solo tier added"), ("notes_changed", "notes", '"a"', '"b"', "notes notes changed"),
        ("price_changed", "tiers.Pro.monthly_price_usd", "0", "1234.5", "Pro $0 → $1,234.5"),
    ]
    df = spark.createDataFrame(rows, "k string, p string, b string, a string, wanted string")
    assert all(r["l"] == r["wanted"] for r in df.select("wanted", X.change_label(F.col("k"), F.col("p"), F.col("b"), F.col("a")).alias("l")).collect())


def test_stream_of_runs_over_batches_and_restarts(spark, tmp_path):
    """Runs go on over batches, a late row changes nothing, and a second start repeats nothing."""
    schema = "source_id long, id long, micros long, page_state string"
    batches = [[(1, 1, 10, "A"), (1, 2, 20, "A"), (2, 9, 5, "X")], [(1, 4, 40, "B"), (1, 3, 30, "A")], [(1, 5, 15, "C"), (1, 6, 50, "B"), (1, 7, 60, "A")]]
    stream = lambda: runs.opened_runs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = runs.drained(stream(), str(tmp_path / "out"))
    found = runs.drained(stream(), str(tmp_path / "out"))
    rows = sorted((r["source_id"], r["late"], r["run"], r["first_id"], r["page_state"]) for r in found.collect())
    assert rows == [(1, False, 1, 1, "A"), (1, False, 2, 4, "B"), (1, False, 3, 7, "A"), (1, True, 2, 5, "C"), (2, False, 1, 9, "X")]


def test_dataset_runs_are_compared_with_their_opening(spark):
    """Units flat, unknown, flat are one run; annual 0 then unknown of a free tier is one run that says 0; gaps and equal names part runs."""
    from tidemark.operators import datasets

    schema = "source_id long, tier string, occurrence int, run long, first_at timestamp, last_at timestamp, provenance string, monthly double, annual double, billing_unit string, seats double, is_free boolean, is_enterprise boolean"
    import datetime

    def rows(source, tier, *states, occurrence=0):
        at = lambda i: datetime.datetime(2024, 1, 1 + i)
        return [(source, tier, occurrence, run, at(run), at(run), prov, monthly, annual, unit, None, monthly == 0, False) for run, monthly, annual, unit, prov in states]

    given = rows(1, "Pro", (1, 20.0, None, "flat", "live"), (2, 20.0, None, "unknown", "live"), (3, 20.0, None, "flat", "wayback"), (4, 25.0, None, "flat", "live"), (6, 25.0, None, "flat", "live"))
    given += rows(1, "Free", (1, 0.0, None, "flat", "live"), (2, 0.0, 0.0, "flat", "live"), (3, 0.0, None, "flat", "live"))
    given += rows(2, "Pro", (1, 5.0, None, "unknown", "live"), (2, 5.0, None, "flat", "live"), (3, 5.0, None, "per_seat", "live"))  # all like the one that opened
    given += rows(3, "Add", (1, 5.0, None, "flat", "live"), (2, 5.0, None, "flat", "live")) + rows(3, "Add", (1, 9.0, None, "flat", "live"), (2, 9.0, None, "flat", "live"), occurrence=1)
    found = datasets.dataset_runs(spark.createDataFrame(given, schema)).collect()
    shown = sorted((r["source_id"], r["tier"], r["occurrence"], r["first_us"] // 86_400_000_000 - 19723, r["last_us"] // 86_400_000_000 - 19723, r["monthly"], r["annual"], r["billing_unit"], r["provenance"]) for r in found)
    assert shown == [
        (1, "Free", 0, 1, 3, 0.0, 0.0, "flat", "live"), (1, "Pro", 0, 1, 3, 20.0, None, "flat", "mixed"), (1, "Pro", 0, 4, 4, 25.0, None, "flat", "live"), (1, "Pro", 0, 6, 6, 25.0, None, "flat", "live"),
        (2, "Pro", 0, 1, 3, 5.0, None, "unknown", "live"), (3, "Add", 0, 1, 2, 5.0, None, "flat", "live"), (3, "Add", 1, 1, 2, 9.0, None, "flat", "live"),
    ]
