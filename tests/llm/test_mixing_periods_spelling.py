"""Mixing, periodic runs and spelling variants against brute force, and their defined results at the edges."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import mixing, periods, spelling

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
TEXTS = [None, "", "  \t\n", "one", "a b a b a b a b a b", LONG, LONG, LONG + "tail", "ünïcödé×è 漢字 🙂", "the same words again and again " * 7, "x" * 5000 + " " + "x" * 4999]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i in (3, 9) else i, t, None if i % 4 == 3 else "bca"[i % 3], i, i, "x", i) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], rows[9]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, at long, size long, word string, n int").withColumn("_source", F.lit(1)).withColumn("runs", F.lit(2))


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------- mixing


def plain_targets(sizes: dict) -> dict:
    """Shares by weight; what is above twice a source goes to the others by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, whole = set(), 1.5 * sum(sizes.values())
    while True:
        rest = whole - sum(2 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        above = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def check_mixture(rows, sizes_by_row):
    """What the contract promises, for rows of (doc_id, size, source_size, target, taken)."""
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter(sizes_by_row)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)


def test_mixing_query(spark, corpus):
    found = mixing.op11_mixing(spark, SF).collect()
    source = {r["doc_id"]: (r["source"], len(WORDS.findall(r["text"] or ""))) for r in corpus.collect()}
    check_mixture(found, [(i, n) for i, (_, n) in source.items()])
    sizes = Counter()
    for s, n in source.values():
        sizes[s] += n
    target, taken = plain_targets(sizes), Counter()
    for r in found:
        s = source[r["doc_id"]][0]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK for s in sizes)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mixture_is_dealt_in_whole_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 200)
    pieces, whole = mixing.mixture(corpus)
    rows, docs = pieces.collect(), {(r["source"], r["at"]): r for r in whole.where("size > 0").collect()}
    slots = defaultdict(list)
    for r in rows:
        slots[(r["source"], r["slot"])].append(r)
    sizes = {r["source"]: r["source_size"] for r in docs.values()}
    used = Counter()
    for (source, _), own in slots.items():
        assert len({(r["index"], r["shard"]) for r in own}) == 1
        used[(source, own[0]["index"])] += 1
        # A block is filled, but for the last of its source, by consecutive words.
        spans = sorted((r["at"] + r["start"], r["at"] + r["start"] + r["length"]) for r in own)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] == own[0]["index"] * mixing.BLOCK
        assert spans[-1][1] == min((own[0]["index"] + 1) * mixing.BLOCK, sizes[source])
        assert all(r["length"] > 0 and r["start"] + r["length"] <= docs[(source, r["at"])]["size"] for r in own)
    by_source = defaultdict(list)
    for source, size in sizes.items():
        times = [used[(source, i)] for i in range(-(-size // mixing.BLOCK))]
        assert max(times) - min(times) <= 1 and max(times) <= 2  # epochs: none twice as often as another
        by_source[source] = sum(times)
        assert {s for q, s in slots if q == source} == set(range(sum(times)))
    shards = Counter((s, own[0]["shard"]) for (s, _), own in slots.items())
    assert len({shard for _, shard in shards}) > 5
    again, _ = mixing.mixture(corpus.repartition(7).sortWithinPartitions("text"))
    assert pieces.exceptAll(again).count() == 0 and again.exceptAll(pieces).count() == 0


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        seen = [mixing.permuted(np.arange(n), n, key).tolist() for key in (0, 1, 2**80)]
        assert all(sorted(s) == list(range(n)) for s in seen)
    assert len({tuple(s) for s in seen}) == 3


def test_mixing_edges(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 2)
    _, whole = mixing.mixture(docs)
    rows = whole.collect()
    assert len(rows) == docs.count()
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(WORDS.findall(r["text"] or ""))
    target = plain_targets(sizes)
    assert all(r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) for r in rows)
    starts = sorted((str(r["source"]), r["at"], r["size"]) for r in rows if r["size"])
    assert all(a[1] + a[2] == b[1] for a, b in zip(starts, starts[1:], strict=False) if a[0] == b[0])
    none, whole = mixing.mixture(docs.where("1 = 0"))
    assert none.count() == 0 and whole.count() == 0
    none, whole = mixing.mixture(docs.where("doc_id in (0, 1, 2)"))
    assert none.count() == 0 and {r["target"] for r in whole.collect()} == {0.0}


# ---------------------------------------------------------------- periodic runs


def plain_runs(w, min_length=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        same, i = [w[k] == w[k + q] for k in range(len(w) - q)], 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            s = w[i : j + q]
            if j > i and len(s) >= max(min_length, exponent * q) and not any(all(s[k] == s[k + d] for k in range(len(s) - d)) for d in range(1, q)):
                out.append((i, len(s), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


SEQUENCES = st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=8), st.integers(1, 7)), max_size=4).map(lambda parts: [x for u, n in parts for x in u * n]), min_size=1, max_size=4)


@given(SEQUENCES, st.sampled_from([2, 3, 4, 5]), st.sampled_from([1, 8]))
@settings(max_examples=300, deadline=None)
def test_runs_match_brute_force(sequences, exponent, scanned):
    before, periods.SCANNED = periods.SCANNED, scanned
    try:
        found = periods.runs_of([np.array(s, np.int64) for s in sequences], 6, exponent)
    finally:
        periods.SCANNED = before
    assert [tuple(r) for r in found.tolist()] == [(i, *r) for i, s in enumerate(sequences) for r in plain_runs(s, 6, exponent)]


def test_refinement_takes_the_smaller_children():
    """Positions that are looked at grow as n log n, not as n times the period."""
    touched = []
    for n in (2_000, 4_000):
        word = np.tile(np.random.default_rng(3).integers(0, 50, 100), n // 100)
        classes = periods.Refinement(np.concatenate([[0], word, [0]]), np.array([-1] + [0] * n + [-1]), np.array([0] + [n // 4] * n + [0]), 3)
        work = 0
        while classes.level <= n // 4 and classes.active():
            work += len(classes.small) + len(classes.left)
            classes.refine()
        touched.append(work)
    assert touched[0] <= 2_000 * 11 * 2 and touched[1] <= 2.5 * touched[0]


def plain_query_row(doc_id, text):
    words = WORDS.findall(text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periods_query(spark, corpus):
    found = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in periods.op12_periods(spark, SF).collect()}
    some = [r for r in corpus.collect() if len(r["text"] or "") < 4000]
    assert len(found) == corpus.count() and len(some) > 100
    assert all(found[r["doc_id"]] == plain_query_row(r["doc_id"], r["text"]) for r in some)
    assert sum(found[r["doc_id"]][0] > 0 for r in some) > 5


def test_periods_edges(docs, monkeypatch):
    monkeypatch.setattr(periods, "BATCH_BYTES", 100)
    found = periods.periodic(docs).collect()
    assert len(found) == docs.count()
    by_words = {r["n_words"]: r for r in found}
    assert by_words[30_000]["runs"][0][:] == (0, 30_000, 10) and by_words[30_000]["collapsed"] == LONG[: len(LONG) // 3000].strip()
    assert [tuple(r) for r in by_words[10]["runs"]] == [(0, 10, 2)] and by_words[10]["collapsed"] == "a b"
    assert by_words[0]["runs"] == [] and by_words[0]["collapsed"] == ""
    assert sum(r["n_words"] == 0 for r in found) == 3 and periods.periodic(docs.where("1 = 0")).count() == 0


# ---------------------------------------------------------------- spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def plain_variants(counts):
    near = defaultdict(list)
    for a in counts:
        for b in counts:
            if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].append(b)
    form = {}
    for a in counts:
        best = min(near[a], key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best is not None and counts[best] >= 10 * counts[a] else None
    out = {}
    for a, n in counts.items():
        root = a
        while form[root]:
            root = form[root]
        out[a] = (form[a], root, n, len(near[a]), counts[form[a]] if form[a] else None)
    return out


def plain_words(rows, slips=True):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_spelling_query(spark, corpus):
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.op13_spelling(spark, SF).collect()}
    assert found == plain_variants(plain_words([(r["doc_id"], r["text"]) for r in corpus.collect()]))
    assert sum(v[0] is not None for v in found.values()) >= 5


@given(st.dictionaries(st.text(alphabet="abàÀß", min_size=1, max_size=6), st.integers(1, 300), max_size=40))
@settings(max_examples=60, deadline=None)
def test_near_words_are_all_found_once(words):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})
    keyed = pa.Table.from_batches(list(spelling._keyed(iter([batch]))), pa.schema([("key", pa.int64()), ("tag", pa.int32()), ("word", pa.string()), ("n", pa.int64())]))
    keyed = keyed.append_column("cell", pa.array(np.zeros(len(keyed), np.int32))).append_column("side", pa.array(np.full(len(keyed), -1, np.int32)))
    found = {w: (k, b) for x in spelling._links(iter(keyed.to_batches())) for w, k, b in zip(x["word"].to_pylist(), x["n_near"].to_pylist(), x["best"].to_pylist(), strict=True)}
    near = {a: sorted((b for b in words if one_edit(a, b)), key=lambda b: (-words[b], b)) for a in words}
    assert found == {a: (len(b), b[0]) for a, b in near.items() if b}


def test_spelling_splits_large_groups(spark, monkeypatch):
    """Words that all meet under one key, in cells of few rows, give the same links."""
    words = {f"{'ab' * 6}{'c' * i}{'d' * (9 - i)}"[: 18 + i % 2]: 3 + i for i in range(10)} | {"".join(p): 40 for p in zip(*[iter("abcdefgh" * 9)] * 9, strict=False)} | {"mouston" + x: n for x, n in (("a", 1), ("b", 10), ("ab", 200), ("", 5000))}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(spelling, "CELL_ROWS", 1)
    monkeypatch.setattr(spelling, "PAIRS", 3)
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}
    assert found == plain_variants(words)


def test_roots_follow_forms_to_the_last(spark):
    chain = [("a" * 8 + "b" * i, 2 * 10**i) for i in range(9)]
    found = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(found.values()) == {chain[-1][0]}


def test_spelling_edges(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts = {r["word"]: r["n"] for r in spelling.word_counts(docs, slips=True).where("n >= 2").collect()}
    assert counts == plain_words(rows)
    found = spelling.variants(spark.createDataFrame([("x" * 5000, 20), ("x" * 4999, 2), ("ünïcödé", 2)], "word string, n long")).collect()
    assert {(len(r["word"]), r["n_near"], len(r["root"])) for r in found} == {(5000, 1, 5000), (4999, 1, 5000), (7, 0, 7)}
    assert spelling.word_counts(docs.where("1 = 0")).count() == 0
    assert spelling.variants(spelling.word_counts(docs.where("1 = 0"))).count() == 0
