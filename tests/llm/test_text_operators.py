"""Operators on texts against brute-force versions, and their defined results at the edges."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, common, packing, pages, pii, quality, sharding, simhash
from tidemark.llm.common import Scratch
from tidemark.llm.tokenizers import ENCODING_VOCABULARY, PACKING_VOCABULARY, encoding, token_bytes, vocabulary_path

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
TEXTS = [None, "", "   \t\n", "one", "One  two", "one two three four five", "ONE two three four five", LONG, LONG, LONG + "tail", "a@b.co +1 (555) 010-9999 4111 1111 1111 1111 10.0.0.1", "ünïcödé 漢字 🙂 <|endoftext|> x", "one", "same " * 50, "same " * 51]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with nulls, repeats and columns that clash with those the operators use inside."""
    rows = [(None if i == 3 else i, t, "en", "s", i, "x", i, "y") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s", 5, "x", 5, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp long, key string, shard int, ids string")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def empty(df):
    return df.where("1 = 0")


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    """Smallest index reachable through links at 2 or fewer bits."""
    root = list(range(len(fps)))
    for _ in fps:
        new = [min(root[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 2) for i in range(len(fps))]
        if new == root:
            break
        root = new
    return root


def test_simhash_matches_brute_force(spark, corpus):
    rows = sorted(corpus.collect(), key=lambda r: r["doc_id"])
    fps = [plain_fingerprint(r["text"]) for r in rows]
    root = plain_groups(fps)
    found = {r["doc_id"]: r for r in simhash.op2_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert {k: r["fingerprint"] for k, r in found.items()} == {r["doc_id"]: f"{f:016x}" for r, f in zip(rows, fps, strict=True)}
    assert {k: r["component_id"] for k, r in found.items()} == {r["doc_id"]: rows[root[i]]["doc_id"] for i, r in enumerate(rows)}


def test_a_worker_remembers_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(simhash, "_known", {})
    hashed = lambda words: [simhash.xxhash.xxh64_intdigest(w, 42) for w in words]
    for start in range(0, 200_000, 1_000):
        words = [b"the", *(b"w%d" % i for i in range(start, start + 1_000)), b"x" * (1_000 + start), b"the"]
        assert simhash.word_hashes(words).tolist() == hashed(words)
    assert 0 < len(simhash._known) <= 1 << 16 and max(map(len, simhash._known)) <= 64
    many = [b"v%d" % i for i in range(100_000)]  # more than are remembered, in one text
    assert simhash.word_hashes(many).tolist() == hashed(many) and len(simhash._known) <= 1 << 16


def test_a_worker_gives_back_what_arrow_keeps(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    assert list(common.frugal(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and Pool.released == 1
    assert common.frugal_column(lambda values: values)([3]) == [3] and Pool.released == 2


def test_simhash_edges(docs):
    found = simhash.linked(docs).collect()
    assert len(found) == docs.count()
    of = {r["doc_id"]: r for r in found}
    assert of[0]["fp"] == of[1]["fp"] == of[2]["fp"] == 0 and of[1]["component_id"] == 0
    assert of[5]["component_id"] == of[6]["component_id"]  # case does not count
    assert of[7]["component_id"] == of[8]["component_id"]
    assert simhash.linked(empty(docs)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.lists(st.sets(st.integers(0, 63), max_size=5), min_size=1, max_size=60))
def test_local_trees_keep_every_link(centres, flips):
    fps = np.unique(np.array([centres[i % len(centres)] ^ sum(1 << b for b in f) for i, f in enumerate(flips)], np.uint64))
    root = simhash.local_roots(len(fps), *simhash.near_pairs(fps))
    assert root.tolist() == plain_groups([int(x) for x in fps])


def test_dense_leaf_is_linked_without_all_pairs():
    """Thousands of points within three bits of one centre, and a chain: more than one local tree can split."""
    rng = np.random.default_rng(1)
    fps = np.unique(np.array([sum(1 << int(b) for b in rng.choice(20, 3, replace=False)) for _ in range(3000)] + [(1 << 40) * i for i in range(600)], np.uint64))
    root = simhash.local_roots(len(fps), *simhash.near_pairs(fps))
    label = np.arange(len(fps))
    while True:  # plain spread of the smallest label
        new = np.array([label[np.bitwise_count(fps ^ x) <= 2].min() for x in fps])
        if (new == label).all():
            break
        label = new
    assert (root == label).all()


def test_every_link_meets_in_a_shard(spark):
    from pyspark.sql import functions as F

    pairs = [(x, simhash.signed(x ^ (1 << a) ^ (1 << b))) for x in (5, 2**61 + 7) for a in range(0, 64, 3) for b in range(1, 64, 5)]
    pairs += [(9, simhash.signed(9 ^ (1 << a))) for a in range(64)]
    pairs = spark.createDataFrame(pairs, "a long, b long")
    went = simhash.shards(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()).cache()
    assert went.groupBy("fp").agg(F.count("*").alias("n"), F.count_if("stored").alias("own")).where("n > 66 or own <> 2").count() == 0
    a, b = went.selectExpr("fp as a", "leaf", "stored as sa"), went.selectExpr("fp as b", "leaf", "stored as sb")
    met = a.join(b, "leaf").where("sa or sb").select("a", "b")
    assert pairs.join(met, ["a", "b"], "left_anti").count() == 0
    far = spark.createDataFrame([(0, 7 | 7 << 32), (0, 3 | 3 << 32)], "a long, b long")
    apart = simhash.shards(far.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
    assert apart.where("stored").groupBy("leaf").count().where("count > 1").count() == 0


def plain_similar(rows):
    sets = [set(zip(*[w[i:] for i in range(min(5, len(w)) or 1)], strict=False)) if (w := (r["text"] or "").lower().split()) else {()} for r in rows]
    owners = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            owners[x].add(i)
    links = []
    for i, s in enumerate(sets):
        meets = Counter(j for x in s for j in owners[x] if j < i)
        links += [(i, j) for j, n in meets.items() if n / (len(s) + len(sets[j]) - n) >= 0.8]
    return links


def test_similar_documents_meet(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = df.collect()
    links = plain_similar(rows)
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar(df).collect()}
    met = sum(group[rows[i]["doc_id"]] == group[rows[j]["doc_id"]] for i, j in links)
    assert met == len(links)
    # No group holds what brute force would not link.
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[max(find(i), find(j))] = min(find(i), find(j))
    true = {r["doc_id"]: find(i) for i, r in enumerate(rows)}
    members = defaultdict(set)
    for doc, g in group.items():
        members[g].add(true[doc])
    assert all(len(m) == 1 for m in members.values())


def test_similar_edges(spark, docs):
    group = simhash.similar(docs).collect()
    assert len(group) == docs.count()
    of = {r["doc_id"]: r["component_id"] for r in group if r["doc_id"] is not None}
    assert of[0] == of[1] == of[2] == 0 and of[7] == of[8] and of[4] == 4
    assert simhash.similar(empty(docs)).count() == 0


@pytest.mark.parametrize("step", [5, 1 << 18])
def test_every_likely_pair_of_two_groups_is_proposed(spark, monkeypatch, step):
    """A shingle of many texts in several groups, in blocks far smaller than its texts."""
    monkeypatch.setattr(simhash, "LEAF_ROWS", 16)
    monkeypatch.setattr(simhash, "STEP", step)
    pick = np.random.default_rng(3)
    base = pick.integers(0, 2**62, 40)
    sets = {i: np.unique(np.where(pick.random(40) < (0.02, 0.1)[i % 2], pick.integers(0, 2**62, 40), base)).view(np.uint64) for i in range(150)}
    sketches = [(i, len(x), *simhash.odd_sketch(x), None) for i, x in sets.items()]
    sketches = spark.createDataFrame(sketches, "least long, n long, " + ", ".join(f"o{w} long" for w in range(simhash.ODD)) + ", long array<long>")
    shared = spark.createDataFrame([(7, i) for i in sets] + [(8, i) for i in range(70)] + [(9, 3), (9, 6)], "leaf long, least long")
    root = spark.createDataFrame([(i, i % 3) for i in sets if i > 2], "u long, v long")
    bits = {i: [x % 2**64 for x in simhash.odd_sketch(s)] for i, s in sets.items()}
    apart = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(bits[a], bits[b], strict=True))
    wanted = {(a, b) for a in sets for b in sets if a < b and a % 3 != b % 3 and apart(a, b) <= (len(sets[a]) + len(sets[b])) / 9}
    with Scratch(spark) as use:
        near = simhash.open_pairs(shared, root, sketches, 1 / 9, None, use).collect()
        every = simhash.open_pairs(shared, root, sketches, 1 / 9, spark.createDataFrame([(i,) for i in sets], "asker long"), use).collect()
    assert {(r["u"], r["v"]) for r in every} == wanted
    assert {(r["u"], r["v"]) for r in near} <= wanted
    # Whoever has a likely partner in another group has at least one pair in either direction.
    assert {i for p in wanted for i in p} == {i for r in near for i in (r["u"], r["v"])} | {r["asker"] for r in near} or any(r["more"] for r in near)
    for a, b in wanted - {(r["u"], r["v"]) for r in near}:
        assert any(r["more"] and r["asker"] in (a, b) for r in near)


def test_shingle_sets_tell_runs_of_words_apart():
    text = "a b c d e f a b c d e F g"
    assert len(simhash.shingles(text)) == len({tuple(text.lower().split()[i : i + 5]) for i in range(9)})
    assert len(simhash.shingles("a b")) == 1 and len(simhash.shingles(None)) == 0
    assert simhash.shingles("a b")[0] != simhash.shingles("b a")[0] != simhash.shingles("a b b")[0]


def test_hot_group_of_near_copies_is_one_group(spark):
    base = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(base[:150] + [f"own{i}"] + base[150:])) for i in range(1500)] + [(9000 + i, f"quite other text number {i} about thing {i * 7}") for i in range(50)]
    found = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = Counter(r["component_id"] for r in found)
    assert groups[0] == 1500 and len(groups) == 51


def test_contiguous_edits_are_linked(spark):
    """Texts with a piece appended, cut off or replaced, at 0.8 or a little more."""
    pick = random.Random(5)
    prose = lambda n: [f"w{pick.randrange(900)}" for _ in range(n)]
    rows = []
    for i in range(60):
        base = prose(pick.randrange(60, 400))
        n = len(base)
        appended, cut, replaced = base + prose(int(0.24 * (n - 4))), base[: n - int(0.19 * (n - 4))], base[: n // 3] + prose(max(1, int(0.1 * (n - 4)) - 4)) + base[n // 3 + max(1, int(0.1 * (n - 4)) - 4) :]
        rows += [(10 * i, " ".join(base)), (10 * i + 1 + i % 3, " ".join((appended, cut, replaced)[i % 3]))]
    links = plain_similar([{"text": t} for _, t in rows])
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(links) == 60 and all(group[rows[i][0]] == group[rows[j][0]] for i, j in links)


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize(("items", "fan"), [(50_000, 4096), (40, 3)])
def test_shards_are_even_whole_and_gapless(spark, monkeypatch, items, fan):
    """In one task, and in a tree of partial partitions of several levels."""
    monkeypatch.setattr(sharding, "ITEMS", items)
    monkeypatch.setattr(sharding, "FAN", fan)
    found = sharding.op3_sharding(spark, "/root/testdata/sf0.01").toPandas()
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    found = found.merge(texts, on="doc_id")
    body = found["text"].fillna("").map(str.encode)
    assert (found["size"] == body.map(len) + 1).all() and (found["text_crc32"] == body.map(zlib.crc32)).all()
    assert (found["law"] == "bytes").all() and found["grown_shard"].isna().all()
    assert (found.groupby(body)["shard"].nunique() == 1).all()
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    by, groups = found.groupby("shard")["size"].sum(), found.assign(text=body).groupby("shard")["text"].nunique()
    shared = by[groups > 1]  # a group larger than a shard's share has a shard of its own
    # Small partial partitions leave at most one group's bytes between the shards.
    assert len(by) == 16 and shared.max() - shared.min() <= (0.01 * shared.mean() if items > 1000 else found.groupby(body)["size"].sum().max())


def test_sharding_edges(docs):
    found = sharding.sharded(docs).toPandas()
    assert len(found) == docs.count() and sharding.sharded(empty(docs)).count() == 0
    assert found[found["size"] == 1]["shard"].nunique() == 1  # null and empty texts are one group
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


@given(st.lists(st.integers(1, 10_000), max_size=60), st.integers(2, 8))
@settings(max_examples=60, deadline=None)
def test_differencing_is_a_partition_no_worse_than_greedy(sizes, ways):
    at = sharding.difference(np.array(sorted(sizes, reverse=True), np.int64), ways)
    sums = np.bincount(at, weights=sorted(sizes, reverse=True), minlength=ways) if sizes else np.zeros(ways)
    assert len(at) == len(sizes) and sums.sum() == sum(sizes)
    if sizes:
        assert sums.max() - sums.min() <= max(sizes)


def test_partial_partitions_are_combined_in_opposite_order():
    labels = sharding.combine(np.array([[9, 1, 5], [2, 8, 4]]), 3)
    sums = np.zeros(3)
    for row, own in zip(([9, 1, 5], [2, 8, 4]), labels, strict=True):
        assert sorted(own) == [0, 1, 2]
        sums[own] += row
    assert sorted(sums) == [9, 9, 11]


# ---------------------------------------------------------------- HTML


def page(body):
    return f"<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body>{body}</body></html>"


def test_page_text_by_structure():
    text = pages.main_text(pages.blocks(page("<nav><a>Home</a></nav><!-- c --><div class='ad'>Buy</div><article><h1>A&amp;B</h1><p>One <b>two</b>\n three<p>Four<br>five<ul><li>x<li>y</ul></article><div id=comments>nice</div><footer>f</footer>")), None)
    assert text == "A&B\nOne two three\nFour five\nx\ny"
    assert pages.main_text(pages.blocks(""), None) == "" and pages.main_text(pages.blocks("<p>unclosed &lt;b"), None) == "unclosed <b"


def test_differencing_deletes_shared_lines(spark):
    rows = [(i, f"https://Host.example/a/{i}", page(f"<div>Menu line</div><div>Story number {i}</div><p>Body {i}</p><div>All rights reserved</div>")) for i in range(40)]
    rows += [(100, None, None), (101, "no-scheme", ""), (102, "https://lone.example/", page("<div>Only</div>"))] + [(200, "https://copies.example/x", page("<div>Copy</div>"))] * 2
    df = spark.createDataFrame([(*r, "host", "part") for r in rows], "page_id long, url string, html string, host string, part string")
    found = pages.extracted(df).collect()
    assert len(found) == len(rows)
    of = {r["page_id"]: r["text"] for r in found}
    assert all(of[i] == f"Story number {i}\nBody {i}" for i in range(40))
    assert of[100] == "" and of[101] == "" and of[102] == "Only" and of[200] == "Copy"
    assert pages.extracted(empty(df)).count() == 0


def test_differencing_decides_inside_and_outside_of_articles(spark):
    rows = [(i, f"https://teaser.example/a/{i}", page(f"<article>Teaser for all</article><div>Story {i}</div><p>Body {i}</p><div>All rights reserved</div>")) for i in range(9)]
    rows += [(100 + i, f"https://inside.example/a/{i}", page(f"<main><div class='plea'><p>Please write</p><p>to us</p></div><p>As ever.</p><p>Long story number {i}</p></main><div>Second {i}</div>")) for i in range(9)]
    rows += [(200, "https://lone.example/", page("<article>A</article><div>B</div>")), (300, "https://two.example/a", page("<main><p>The same long story</p><p>x</p></main>")), (301, "https://two.example/b", page("<main><p>The same long story</p><p>y</p></main>"))]
    of = {r["page_id"]: r["text"] for r in pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(of[i] == f"Story {i}\nBody {i}" and of[100 + i] == f"As ever.\nLong story number {i}\nSecond {i}" for i in range(9))
    assert of[200] == "A\nB" and of[300] == "The same long story\nx" and of[301] == "The same long story\ny"


def test_names_and_headers_inside_articles():
    own = lambda body: pages.main_text(pages.blocks(page(body)), None)
    assert own("<header>Site</header><article><header><h1>Title</h1></header><p class='legal'>Law</p><div class='share-price'>12</div><p>a <span class='search'>big</span> find, a<wbr>b</p></article>") == "Title\nLaw\n12\na big find, ab"
    assert own("<article><p>x</p><div class='share-buttons'>Tell</div><div class='ad'>Buy</div><aside>More</aside><form>F</form></article>") == "x"
    assert own("<div class='sidebar-left'>S</div><p>x</p>") == "x"
    deep = "<b>" * 20_000 + "<p>deep" + "</i>" * 20_000 + "<p>er" * 2000
    assert own(deep).startswith("deep\ner")


def plain_page(own, other):
    """The text of a page by the plain rules: longest common subsequence by the table, then regions."""
    a, b = [x[2:] for x in own], [x[2:] for x in other or []]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    shared, i, j = set(), 0, 0
    while a != b and i < len(a) and j < len(b):
        if a[i] == b[j]:
            shared.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return shared, best[0][0]


@pytest.mark.parametrize("articles", [True, False])
def test_every_route_decides_lines(spark, articles):
    """Whole extraction against a plain version, on the pages of sf0.01 and on the same without article elements, with a count of the lines that each route decides."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    html = {r["page_id"]: (r["html"] or "") if articles else re.sub(r"</?article>", "", r["html"] or "").replace("<nav>", "<div>").replace("</nav>", "</div>") for r in rows}
    df = spark.createDataFrame([(r["page_id"], r["url"], html[r["page_id"]]) for r in rows], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in pages.extracted(df).collect()}

    def place(r):
        host, path = plain_url(r["url"])
        return host, path, r["page_id"]

    order = sorted(rows, key=place)
    blocks = {r["page_id"]: pages.blocks(html[r["page_id"]]) for r in rows}
    routes = Counter()
    for n, r in enumerate(order):
        near = [x for x in (order[n - 1] if n else None, order[n + 1] if n + 1 < len(order) else None) if x and place(x)[0] == place(r)[0]]
        other = max(near, key=lambda x: pages.start_shared(place(x)[1], place(r)[1])) if near else None
        own, theirs = blocks[r["page_id"]], blocks[other["page_id"]] if other else None
        shared, longest = plain_page(own, theirs)
        assert found[r["page_id"]] == pages.main_text(own, theirs)
        if theirs and [x[2:] for x in own] != [x[2:] for x in theirs]:
            assert len(pages.shared_lines([x[2:] for x in own], [x[2:] for x in theirs])) == longest
        kept = found[r["page_id"]].split("\n") if found[r["page_id"]] else []
        routes["kept by differencing"] += len(kept)
        routes["deleted by differencing"] += len(own) - len(kept)
        if articles:  # what an article holds is whole
            assert kept == [line for _, _, _, line in own]
    assert routes["kept by differencing"] > 2000
    assert articles or routes["deleted by differencing"] > 0


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :])[0]


def test_nearest_page_is_found_on_hosts_of_any_size(spark):
    """Each section has its own template line, so a page keeps it if it is paired outside of it."""
    rows = [(i, f"https://large.example/s{i // 2:04d}/{i % 2}", page(f"<div>Section {i // 2}</div><p>Body {i}</p>")) for i in range(4402)]
    found = pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()
    assert len(found) == len(rows) and all(r["text"] == f"Body {r['page_id']}" for r in found)


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
@settings(max_examples=100, deadline=None)
def test_aligned_lines_are_a_longest_common_subsequence(a, b):
    at = sorted(pages.shared_lines(a, b))
    assert len(at) == plain_lcs(a, b)
    rest = iter(b)
    assert all(any(x == a[i] for x in rest) for i in at)


# ---------------------------------------------------------------- packing


def rebuilt(rows):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
    return by_doc


def test_packing_loses_and_pads_nothing(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path(PACKING_VOCABULARY))
    rows = packing.op5_packing(spark, "/root/testdata/sf0.001").collect()
    expected = {r["doc_id"]: np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4") for r in corpus.collect()}
    pieces = defaultdict(list)
    windows = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert pieces.keys() == expected.keys()
    for doc, ids in expected.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0
    steps = defaultdict(set)
    for r in rows:
        steps[r["step_group"]].add((r["sequence_id"], r["tier"]))
    totals = defaultdict(list)
    for step in sorted(steps):
        totals[step % 4].append(sum(t for _, t in steps[step]))
    assert all(t == packing.STEP_TOKENS for stream in range(3) for t in totals[stream][:-1]) and all(t <= packing.STEP_TOKENS + 512 for own in totals.values() for t in own)


def test_step_groups_span_partitions_and_added_tokens_are_found(spark):
    import tokenizers

    rows = [(i, f"a <|endoftext|> b{i} " * (8 + 8 * (i % 40))) for i in range(300)]
    found = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), step_tokens=4096).collect()
    tok = tokenizers.Tokenizer.from_file(vocabulary_path(PACKING_VOCABULARY))
    assert {r["doc_id"]: r["doc_tokens"] for r in found} == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    whole = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in rows}
    assert all(r["ids_crc32"] == zlib.crc32(whole[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in found)
    windows = {(r["step_group"], r["sequence_id"], r["tier"]) for r in found}
    assert len({s for _, s, t in windows if t == 1024}) > 9  # of several partitions
    totals = Counter()
    for step, _, tier in windows:
        totals[step] += tier
    for stream in range(3):
        own = [totals[s] for s in sorted(totals) if s % 4 == stream]
        assert all(t == 4096 for t in own[:-1])


def test_packing_edges(docs):
    rows = packing.packed(docs).collect()
    counts = Counter(r["doc_id"] for r in rows if r["start"] == 0)
    assert counts[5] == 2 and counts[None] == 1 and counts[0] == 1
    assert {r["length"] for r in rows if r["doc_id"] in (0, 1)} == {1}
    assert packing.packed(empty(docs)).count() == 0


# ---------------------------------------------------------------- personal data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and plain_luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), list(PLAIN).index(kind), kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def base_of(text):
    return [(s["kind"], s["start"], s["end"]) for s in pii.find_spans(text) if s["kind"] in PLAIN]


@given(st.text(alphabet="0123456789.+-@ ()aZ_%é", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans_match_plain_patterns(text):
    assert base_of(text) == plain_spans(text)


def test_pii_query_matches_plain_patterns(spark, corpus):
    found = {r["doc_id"]: r for r in pii.op7_pii(spark, "/root/testdata/sf0.001").collect()}
    for r in corpus.collect():
        spans = plain_spans(r["text"] or "")
        own = found[r["doc_id"]]
        assert own["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [own[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]


def test_checksums_context_and_redaction(docs):
    kinds = lambda t: [s["kind"] for s in pii.find_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 is mine") == ["iban"] and "iban" not in kinds("DE88370400440532013000")
    assert "ssn" in kinds("social security 123-45-6789") and "ssn" not in kinds("part 123-45-6789")
    near, far = pii.find_spans("my card 4111111111111111")[0]["score"], pii.find_spans("4111111111111111")[0]["score"]
    assert near > far
    out = pii.redacted(docs).orderBy("fp").collect()
    assert len(out) == docs.count()
    assert pii.redact_text("x a@b.co y") == "x [EMAIL] y" and pii.redact_text(None) is None
    assert pii.find_spans("1" * 200_000) == [] and pii.find_spans("a" * 200_000) == []


# ---------------------------------------------------------------- quality


def plain_model(texts, order=4):
    """Interpolated modified Kneser-Ney over characters, by plain dictionaries."""
    counts = {order: Counter(tuple(("\0" * (order - 1) + t)[i : i + order]) for t in texts for i in range(len(t)))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    tables = {}
    for n, own in counts.items():
        n1, n2, n3, n4 = (sum(c == i for c in own.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        raw = [i - (i + 1) * y * b / a if a else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        d = [max(0.05, min(i - 0.05, x)) for i, x in zip((1, 2, 3), raw, strict=True)]
        total, left = Counter(), Counter()
        for g, c in own.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        tables[n] = own, d, total, left
    floor = 1 / (len(counts[1]) + 1)

    def p(gram):
        below = p(gram[1:]) if len(gram) > 1 else floor
        own, d, total, left = tables[len(gram)]
        h = gram[:-1]
        if not total[h]:
            return below
        c = own[gram]
        return (c - d[min(c, 3) - 1] if c else 0) / total[h] + left[h] / total[h] * below

    return p


def test_perplexities_match_a_plain_model(spark):
    words = ["the cat sat on the mat", "a dog ran to the cat", "the mat and the dog", "cats sit and dogs run on", "zzqq xxvv kkjj", "漢字 🙂"]
    rows = [(i, t, "en") for i, t in enumerate(words * 3)] + [(100, None, "en"), (101, "", "en"), (102, "sin etiqueta", "es"), (103, "no lang", None), (None, "the cat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    trusted = [i for i in range(len(words) * 3) if i % 6 < 4]
    labels = spark.createDataFrame([(i, int(i in trusted), 0) for i in range(len(words) * 3)] + [(102, 0, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.perplexities(docs, labels).collect()}
    assert len(found) == len(rows)
    p = plain_model([rows[i][1] for i in trusted])
    for i, text, _ in rows[:18] + rows[-1:]:
        padded = "\0" * 3 + text
        mean = -np.mean([np.log(p(tuple(padded[j : j + 4]))) for j in range(len(text))])
        if "🙂" not in text:  # beyond 16 bits characters share codes
            assert found[i]["surprisal"] == pytest.approx(mean, rel=1e-9)
    assert all(found[i]["surprisal"] is None for i in (100, 101, 102, 103))
    kept = {r["doc_id"]: r["keep"] for r in quality.judged(docs, labels).collect()}
    assert all(kept[i] for i in (100, 101, 102, 103)) and all(kept[i] for i in trusted) and not kept[4]
    assert quality.judged(empty(docs), labels).count() == 0
    assert all(r["keep"] for r in quality.judged(docs, empty(labels)).collect())


def test_quality_separates_held_out_labels(spark):
    """Labels of odd ids are not shown to the model; two versions that deal rows differently judge alike."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit = quality.judged(docs, labels.where("doc_id % 2 = 0"))
    rows = fit.join(labels.where("doc_id % 2 = 1"), "doc_id").selectExpr("quality", "toxic", "cast(keep as double) as k").groupBy("quality", "toxic").avg("k").collect()
    rate = {(r["quality"], r["toxic"]): r["avg(k)"] for r in rows}
    assert rate[(1, 0)] >= 0.99 and rate[(0, 0)] <= 0.2 and rate[(0, 1)] <= 0.2
    again = quality.judged(docs.repartition(7), labels.where("doc_id % 2 = 0"))
    assert fit.exceptAll(again).count() == 0


def test_quantiles_are_exact(spark):
    rows = [("en", 0, True, i / 1000) for i in range(1, 1001)] + [("en", 0, False, 99.0), ("de", 1, True, 3.0), ("de", 1, True, None)]
    found = {r["lang"]: r for r in quality.quantiles(spark.createDataFrame(rows, "lang string, band int, trusted boolean, surprisal double"), 0.01, 0.9).collect()}
    assert found["en"]["low"] == pytest.approx(0.01) and found["en"]["high"] == pytest.approx(0.9) and found["de"]["low"] == found["de"]["high"] == 3.0


# ---------------------------------------------------------------- byte-level BPE


def test_bpe_matches_the_library_and_round_trips(spark, docs):
    import public_tokenizers
    import tiktoken

    path = vocabulary_path(ENCODING_VOCABULARY)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in token_bytes(path).items()}, special_tokens={})
    found = sorted(bpe.encoded(docs.withColumnRenamed("ids", "chunk").repartition(3), decode=True).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    source = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [r["doc_id"] for r in found] == [r["doc_id"] for r in source]
    for a, b in zip(found, source, strict=True):
        assert np.frombuffer(a["ids"], "<u4").tolist() == lib.encode_ordinary(b["text"] or "")
        assert bytes(a["decoded"]) == (b["text"] or "").encode()
    again = bpe.decoded(spark.createDataFrame([(bytes(found[4]["ids"]),), (None,)], "ids binary")).collect()
    assert bytes(again[0]["decoded"]) == (source[4]["text"] or "").encode() and bytes(again[1]["decoded"]) == b""
    assert bpe.encoded(empty(docs)).count() == 0 and encoding(path)


def test_bpe_query(spark, corpus):
    found = {r["doc_id"]: r for r in bpe.op10_bpe(spark, "/root/testdata/sf0.001").collect()}
    lib = encoding(vocabulary_path(ENCODING_VOCABULARY))
    for r in corpus.collect():
        ids = np.array(lib.encode_ordinary(r["text"] or ""), "<u4")
        own = found[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_shared_lines_are_longest_without_a_table(monkeypatch):
    rng = random.Random(5)
    for n, m in ((1, 30), (30, 1), (40, 55), (64, 64)):
        a, b = ([rng.choice("abcdef") for _ in range(k)] for k in (n, m))
        by_table = pages.shared_lines(a, b)
        monkeypatch.setattr(pages, "TABLE", 6)
        monkeypatch.setattr(pages, "BLOCK_LINES", 13)
        without = pages.shared_lines(a, b)
        monkeypatch.undo()
        rest = iter(b)
        assert len(without) == len(by_table) and all(a[i] in rest for i in sorted(without))


def test_bpe_words_stream_through_bounded_memory(monkeypatch):
    path = vocabulary_path(ENCODING_VOCABULARY)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 4)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 500)
    lists = [["a", " the"], [" the", "zebra", ""], ["b", "a"], [" word", " the"], ["é"], ["c"]]
    rows = pa.table({"chunk": range(6), "shard": pa.array([0, 0, 0, 1, 1, 2], pa.int32()), "words": pa.array([bpe.pack(word=pa.array(x)) for x in lists], pa.binary())})
    known = pa.Table.from_batches(bpe._encoded_words(path)(rows.to_batches(max_chunksize=2)))
    assert known["chunk"].to_pylist() == list(range(6)) and known["shard"].to_pylist() == [0, 0, 0, 1, 1, 2]
    encode = encoding(path).encode_ordinary
    for row, words in zip(known.to_pylist(), lists, strict=True):
        assert bpe.unpack(row["known"]).column(0).to_pylist() == [encode(w) for w in words] and row["words_checksum"] == bpe.checksum(pa.array(words))
    assert list(bpe.blocks(np.array([3, 3, 3, 4]), np.array([400, 400, 50, 50]))) == [(0, 1), (1, 3), (3, 4)]
    assert list(bpe.blocks(np.array([]), np.array([]))) == []
