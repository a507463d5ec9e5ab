"""Vector searches, the URL filter, components and the pipeline against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, components, stages, topk, urlrank

SF = "/root/testdata/sf0.01"
STAGE = dict(corpus_pipeline.STAGES)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "n", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, norm string, list int, part int")


def plain_topk(rows, asked, k, score):
    out = []
    for q, a in rows:
        if q % asked == 0:
            best = sorted(((-score(a, b), i) for i, b in rows if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def integers(v):
    return [math.floor(1024 * float(np.float32(x))) for x in v]


@pytest.fixture(scope="module")
def fixture_rows():
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * rng.choice([0.1, 1, 5])]) for i in range(400)]
    return rows + [(400 + i, rows[3][1]) for i in range(60)] + [(500, [0.0] * 8)]  # ties, and a zero vector


ODD = [(600, None), (601, [None] * 8), (602, [float("nan")] + [1.0] * 7), (603, [float("inf")] * 8), (604, [])]


def test_topk_matches_brute_force(spark, fixture_rows):
    df = vectors(spark, fixture_rows + ODD)
    found = topk.topk(df, F.col("vec_id") % 10 == 0, scale=1024).collect()
    whole = [(i, integers(v)) for i, v in fixture_rows]
    expected = plain_topk(whole, 10, 10, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    assert sorted(map(tuple, found)) == expected


def test_topk_small_and_empty(spark):
    df = vectors(spark, [(0, [1.0, 2.0]), (1, [3.0, 4.0])])
    assert sorted(map(tuple, topk.topk(df, F.col("vec_id") % 10 == 0, scale=1).collect())) == [(0, 1, 1, 11)]
    assert topk.topk(df.where("1 = 0"), F.col("vec_id") % 10 == 0, scale=1).count() == 0
    assert topk.topk(df.where("vec_id = 0"), F.col("vec_id") % 10 == 0, scale=1).count() == 0


def test_topk_beyond_doubles(spark):
    rows = [(i, [float(2**30 + i), 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.topk(df, F.col("vec_id") == 0, k=2).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 11, 2**30 * (2**30 + 11) + 1), (0, 2, 10, 2**30 * (2**30 + 10) + 1)]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_ann_recall_and_scores(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    whole = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in df.collect() if r["embedding"]}
    rows = list(whole.items())
    found = ann.op6_ann(spark, sf).collect()
    ids = np.array([i for i, _ in rows])
    table = np.stack([v for _, v in rows])
    hits = total = 0
    by = {}
    for r in found:
        by.setdefault(r["query_id"], {})[r["rank"]] = r
        assert r["score"] == pytest.approx(float(whole[r["query_id"]] @ whole[r["vec_id"]]), rel=1e-12, abs=1e-15)
    for q in ids[ids % 20 == 0]:
        scores = table @ whole[q]
        order = [i for _, i in sorted(zip(-scores, ids, strict=True)) if i != q][:20]
        assert sorted(by[q]) == list(range(1, len(order) + 1))
        ranked = [(-by[q][r]["score"], by[q][r]["vec_id"]) for r in sorted(by[q])]
        assert ranked == sorted(ranked)
        hits += len({x for _, x in ranked} & set(order))
        total += len(order)
    assert hits / total >= 0.9


def test_ann_edges(spark, fixture_rows):
    df = vectors(spark, fixture_rows + ODD)
    found = ann.neighbours(df, F.col("vec_id") % 20 == 0, k=5).collect()
    assert {r["query_id"] for r in found} == {i for i, v in fixture_rows if i % 20 == 0 and any(v)}
    assert all(r["vec_id"] not in (500, 600, 601, 602, 603, 604, r["query_id"]) for r in found)
    assert ann.neighbours(df.where("1 = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_equal_vectors_have_equal_scores_in_every_part(spark, monkeypatch):
    """Equal vectors spread over parts of a list tie to the last bit, whatever else is in their part."""
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    rng = np.random.default_rng(11)
    same = [float(np.float32(x)) for x in rng.standard_normal(64)]
    rows = [(i, same) for i in range(0, 300, 3)] + [(i, [float(np.float32(x)) for x in rng.standard_normal(64)]) for i in range(300) if i % 3]
    found = ann.neighbours(vectors(spark, rows), F.col("vec_id") == 60, recall=1.0).collect()
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == [i for i in range(0, 300, 3) if i != 60][:20]
    assert len({r["score"] for r in found}) == 1


def test_probes_follow_the_data():
    """Clusters need few lists, and a smaller share of them with more rows; noise needs many."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((40, 16)) * 8
    clustered = np.repeat(centre, 50, axis=0) + rng.standard_normal((2000, 16)) * 0.1
    noise = rng.standard_normal((2000, 16))
    share = lambda rows: ann.probes(rows, ann.centres(rows, 40), len(rows), 20) / 40
    assert share(clustered) <= 0.2 < 0.4 <= share(noise)


def test_repeated_ids_and_other_widths(spark):
    """Rows of one id are one vector, the smallest; vectors of an unusual width take no part."""
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [0.5, 9.0]), (2, [1.5, 0.0]), (3, [5.0, 5.0, 5.0])]
    for found in (ann.neighbours(vectors(spark, rows), F.col("vec_id") == 0).collect(), topk.topk(vectors(spark, rows), F.col("vec_id") == 0, scale=2).collect()):
        assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] in ([(2, 1.5), (1, 0.5)], [(2, 6), (1, 2)])


def test_dimension_tests_keep_the_best():
    rng = np.random.default_rng(3)
    rows, q = rng.standard_normal((2000, 64)), rng.standard_normal(64)
    scores = rows @ q
    bound = np.sort(scores)[-20]
    other = rng.standard_normal(64)
    asked, found = ann.scan(np.stack([other, q]), np.array([np.inf, bound]), rows, (rows**2).sum(1))
    alive = set(found[asked == 1].tolist())
    assert not (asked == 0).any()
    assert len(set(np.flatnonzero(scores >= bound).tolist()) - alive) <= 1 and len(alive) < 1500


# ---------------------------------------------------------------- URL filter


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urlrank.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls_hosts_and_rules(spark):
    urls = [None, "", "plain", "https://A.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2", "x://b.com/fr/", "x://com/de/1", "x://bcom/de/1", "http://h?q", "http://h#f", "http://É.org/a", "a://b://c/d", "http://net.example.net/"]
    urls += [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = spark.createDataFrame([(i, u, None, "host", "t0") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, t0 string")
    found = {r["page_id"]: r for r in urlrank.judged(df).collect()}
    assert len(found) == len(urls)
    for i, u in enumerate(urls):
        host, path = plain_url(u)
        rule, verdict = plain_rule(host, path)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule), u
        assert verdict is None or found[i]["verdict"] == verdict
        assert found[i]["verdict"] in ("allow", "block")
    assert urlrank.judged(df.where("1 = 0")).count() == 0


def test_distrust_flows_back_and_trust_flows_on(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)
    rows = [
        (0, "https://good.org/", link("friend.net", "friend.net")),
        (1, "https://bad.com/de/", ""),
        (2, "https://spam.net/", link("bad.com")),
        (3, "https://friend.net/", ""),
        (4, "https://lone.net/", None),
        (5, "https://spam2.net/", link("spam.net")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in urlrank.judged(df).collect()}
    assert [found[i]["verdict"] for i in range(6)] == ["allow", "block", "block", "allow", "allow", "block"]
    # By hand: what hosts without links would lose goes back to the seed, so ranks are shares of 1.
    d = urlrank.DAMPING
    assert found[3]["trust"] == pytest.approx(d / (1 + d), abs=1e-3)
    assert found[2]["distrust"] == pytest.approx(d / (1 + d + d * d), abs=1e-3)
    assert found[5]["distrust"] == pytest.approx(d * d / (1 + d + d * d), abs=1e-3)
    assert found[4]["trust"] == found[4]["distrust"] == 0


def test_ranks_match_a_plain_pagerank(spark):
    """A generated link graph with very long urls and repeated links, against dense power iteration."""
    rng = np.random.default_rng(9)
    hosts = [f"h{i}.{('org', 'com', 'net')[i % 3]}" for i in range(40)]
    rows, links = [], np.zeros((40, 40))
    for page in range(240):
        i = page % 40
        to = rng.choice(40, rng.integers(0, 5), replace=False) if i % 7 else []
        for j in to:
            links[i, j] += i != j
        html = "".join(f'<a href="//{hosts[j].upper()}/x">l</a>' * 2 for j in to)
        rows.append((page, f"http://{hosts[i]}/{('fr', 'de', 'en')[page % 3 if i % 3 == 1 else 2]}/" + "x" * 5000, html))
    found = urlrank.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    of = {r["host"]: r for r in found}
    verdicts = [(i % 40, plain_rule(*plain_url(u))[1]) for i, u, _ in rows]
    ranks = []
    for verdict, m in (("allow", links), ("block", links.T)):
        seed = np.bincount([i for i, v in verdicts if v == verdict], minlength=40) / sum(v == verdict for _, v in verdicts)
        share = m / np.maximum(m.sum(1, keepdims=True), 1)
        r = seed
        for _ in range(500):
            flow = r @ share
            r = (1 - urlrank.DAMPING) * seed + urlrank.DAMPING * (flow + (1 - flow.sum()) * seed)
        ranks.append(r)
    assert all(of[h]["trust"] == pytest.approx(ranks[0][i], abs=1e-3) and of[h]["distrust"] == pytest.approx(ranks[1][i], abs=1e-3) for i, h in enumerate(hosts) if h in of)
    unruled = [r for r in found if r["rule"] is None]
    sure = [r for r in unruled if abs(r["trust"] - r["distrust"]) > 2e-3]
    assert {r["verdict"] for r in sure} == {"allow", "block"}
    index = {h: i for i, h in enumerate(hosts)}
    assert all(r["verdict"] == ("block" if ranks[1][index[r["host"]]] > ranks[0][index[r["host"]]] else "allow") for r in sure)


def test_components_match_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r["u"]: r["v"] for r in components.roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for x in root if find(x) != x}
    assert components.roots(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        seen[name] = rows
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
    ids = {n: [r["doc_id"] for r in rows] for n, rows in seen.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "packing"]
    assert 0 < len(ids["near_dedup"]) < len(ids["quality"]) <= 1000
    assert ids["pii"].sort() == ids["near_dedup"].sort() and set(ids["packing"]) == set(ids["pii"])
    assert not any("@" in r["text"] and "[EMAIL]" not in r["text"] and ".com" in r["text"].split("@")[1][:20] for r in seen["pii"] if r["text"] and "@" in r["text"][:200])
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] == 1 and not r["toxic"]}
    assert len(good & set(ids["quality"])) >= 0.97 * len(good)


def test_pipeline_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one two three four five six", "en", "s", 27), (1, "one two three four five six", "en", "s", 27), (2, None, None, None, None), (None, "x", "en", "s", 1), (3, "mail me a@b.co now", "en", "s", 18)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("1 = 0"), SF).count() == 0, name
    kept = STAGE["near_dedup"](spark, docs, SF).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept) == [(False, 1), (False, 2), (False, 3), (True, None)]
    clean = {r["doc_id"]: r for r in STAGE["pii"](spark, docs, SF).collect()}
    assert clean[3]["text"] == "mail me [EMAIL] now" and clean[3]["n_chars"] == 19 and clean[2]["text"] is None


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    first, other, third = "one two three four five six seven", "a wholly different clean text of some words", "nothing like the others is said here now"
    rows = [(1, first, 9), (1, other, 9), (2, first, 9), (2, third, 9), (None, third, 9), (None, first, 9), (None, "only here and without an id at all", 9), (None, "only here and without an id at all", 9), (7, other, 9), (2**62, None, 9), (2**62, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").withColumn("_digest", F.lit("x")).withColumn("_number", F.lit(1))
    kept = STAGE["near_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert sorted(t or "" for _, t in found) == sorted([first, other, third, "only here and without an id at all", ""])
    assert (7, other) in found  # the id of one text only comes first


def test_quality_drops_only_the_rejected_text_of_an_id(spark):
    words = ["the cat sat on the mat", "a dog ran to the cat", "the mat and the dog", "cats sit and dogs run on"]
    rows = [(i, words[i % 4] + f" and the cat ran {i % 4} times", "en") for i in range(40)] + [(0, "zzqq xxvv kkjj qqxx zzvv", "en"), (100, "the cat ran to the mat", "en"), (100, "zzqq xxvv kkjj qqxx zzvv", "en"), (None, "the dog sat", "en"), (None, "qqxx zzvv jjkk", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    verdicts = stages.quality.judged(stages.named(docs, "_row"), labels, row="_row")
    assert verdicts.select("doc_id").distinct().count() == len(rows)
    gone = {r["doc_id"] for r in verdicts.collect() if not r["keep"]}
    named = {r["_row"]: (r["doc_id"], r["text"]) for r in stages.named(docs, "_row").collect()}
    assert {t for i, t in named.values() if "zzqq" in t} <= {named[g][1] for g in gone}
    clean = stages.without(stages.named(docs, "_row"), verdicts.where("not keep"), "_row")
    assert {r["text"] for r in clean.collect() if r["doc_id"] == 100} == {"the cat ran to the mat"}
