"""Operators over documents and measures: leaks, mixing, quality, percentiles."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelattice.llm import leaks, mixing, percentiles, quality
from pagelattice.llm.shingles import word_hashes, words

DOCUMENTS = "doc_id bigint, text string, source string, score int, key string"


def brute_leaks(docs, items):
    out = set()
    for i, t in items:
        w = words(t or "")
        k = min(13, len(w))
        for s in range(len(w) - k + 1) if w else ():
            for d, u in docs:
                v = words(u or "")
                if any(v[j : j + k] == w[s : s + k] for j in range(len(v) - k + 1)):
                    out.add((d, i))
    return out


def test_leaks_against_all_windows(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 2, 5, 12, 13, 14, 40, 90, 40])]
    items += [(20, None), (21, " "), (22, "!?"), (23, items[6][1])]
    docs = []
    for d in range(60):
        w = rng.choices(vocabulary, k=rng.choice([3, 30, 200]))
        own = words(items[rng.randrange(9)][1])
        n = rng.choice([12, 13, 20])
        at, s = rng.randrange(len(w)), rng.randrange(max(1, len(own) - n + 1))
        docs.append((d, " ".join(w[:at] + own[s : s + n] + w[at:])))
    docs += [(100, None), (101, ""), (102, docs[0][1].upper().replace(" ", ",  ")), (103, "x " * 50_000 + items[7][1])]
    frame = spark.createDataFrame([(d, t, "s", 1, "k") for d, t in docs], DOCUMENTS)
    table = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id bigint, text string, doc_id string")
    rows = [(r.doc_id, r.item_id) for r in leaks.leaks(frame, table).collect()]
    expected = brute_leaks(docs, items)
    assert set(rows) == expected and len(rows) == len(expected) and len(expected) > 60
    assert leaks.leaks(frame, table.limit(0)).count() == 0 and leaks.leaks(frame.limit(0), table).count() == 0


def test_leak_index_blocks(spark, monkeypatch):
    """Several broadcast blocks of items find what one finds."""
    items = [(i, " ".join(f"a{i}b{k}" for k in range(20))) for i in range(30)]
    docs = [(i, "x y " + t) for i, t in items]
    frame = spark.createDataFrame([(d, t, "s", 1, "k") for d, t in docs], DOCUMENTS)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {(r.doc_id, r.item_id): r.score for r in leaks.leaks(frame, table).collect()}
    monkeypatch.setattr(leaks, "INDEX_CHARS", 500)
    assert leaks.index_parts(table).count() > 5
    for limit in (1 << 20, 4000):  # one scan, and several
        got = {(r.doc_id, r.item_id): r.score for r in leaks.leaks(frame, table.union(table), limit).collect()}
        assert got == pytest.approx(whole) and set(got) == {(i, i) for i in range(30)}  # scores do not depend on the parts


def test_shared_hashes_are_no_proof():
    assert leaks._same_words("a b c d".split(), "x b c y".split(), 2, leaks.runs(word_hashes(["b", "c"]), 2))
    assert not leaks._same_words("a b c d".split(), "x c b y".split(), 2, leaks.runs(word_hashes(["b", "c"]), 2))


def test_search_scores_a_leak_at_one_or_more():
    items = [" ".join(f"t{(i * 7 + k) % 50}" for k in range(30)) for i in range(20)]
    index = leaks.build(list(range(20)), items, leaks.counts_of(items))
    for i, t in enumerate(items):
        run = ["pad"] * 30 + words(t)[9:22] + ["pad"] * 30
        hits = {j: s for _, j, s in leaks.search(index, [word_hashes(run)])}
        assert hits[i] >= 1 - leaks.EPS


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 300)), max_size=60), st.integers(0, 99))
def test_flight_keeps_totals(units, seed):
    p, t = np.array([u[0] for u in units], float), np.array([u[1] for u in units], float)
    q = mixing.flight(p, t, np.random.default_rng(seed))
    assert ((q > -1e-9) & (q < 1 + 1e-9)).all() and ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs(q @ t - p @ t) < 1e-4
    assert set(mixing.land(q, t).tolist()) <= {0.0, 1.0}


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)  # several levels of buckets
    rng = random.Random(2)
    rows = []
    for source, n in (("a", 400), ("b", 90), ("c", 4), ("z", 20)):
        rows += [(len(rows) + i, " ".join(["word"] * rng.randint(5, 60)), source, 1, "k") for i in range(n)]
    rows += [(9000, None, "a", 1, "k"), (9001, "", "b", 1, "k"), (9002, "text", None, 1, "k")]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 4), ("c", 0.25, 3), ("none", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, targets)
    report = {r.source: r for r in got.report.collect()}
    assert set(report) == {"a", "b", "c", "none"} and {s for s, r in report.items() if r.short} == {"c", "none"}
    sample = got.sample.collect()
    assert len({r.doc_id for r in sample}) == len(sample) == 400 + 90 + 4 + 2
    total = sum(r.source_tokens for r in report.values())
    for s in "ab":
        r = report[s]
        assert r.most_repeats <= r.max_repeats and abs(r.used_tokens - r.target_share * total) < 0.02 * total
    assert report["c"].used_tokens == 3 * report["c"].source_tokens and report["none"].used_tokens == 0
    flown = mixing._fly  # the short sources are told from the sample: if the flight lost its documents, there would be others
    monkeypatch.setattr(mixing, "_fly", lambda group, final: flown(group, final).iloc[:0])
    assert {r.source for r in mixing.mix(docs, targets).report.where("short").collect()} == {"a", "b", "c", "none"}
    monkeypatch.setattr(mixing, "_fly", flown)
    again = sorted((r.doc_id, r.repeats) for r in mixing.mix(docs.repartition(7), targets).sample.collect())
    assert again == sorted((r.doc_id, r.repeats) for r in sample)
    assert all(r.used_tokens == 0 for r in mixing.mix(docs.limit(0), targets).report.collect())


PROSE = "The kiln was cold and the glaze had not set. We waited for the next day, and it was better than before. Nobody knew why."


@pytest.mark.parametrize(
    "text, bad",
    [
        (PROSE, False), (PROSE.upper(), False), (PROSE.replace(".", "").replace(",", ""), False),
        ("\n".join(PROSE[i : i + 50] for i in range(0, len(PROSE), 50)), False), ("It was late.", False),
        (PROSE + "\n- one item\n- another item\n" + PROSE, False),
        ("\n".join(f"kiln part {i}\t{i * 7}\t0.{i}" for i in range(12)), True),
        ("\n".join(f"- quiet kiln number {i}" for i in range(12)), True),
        ("\n".join(f"2024-01-0{i}T10:00:00Z INFO fetch id={i} status=200" for i in range(1, 9)), True),
        ("\n".join(f"load time: {i}" for i in range(9)), True), ("kiln, mug, kiln, glaze, " * 20, True),
        ("\n".join(f"the odd kiln {i} and the rest." for i in range(9)), True),
        ("{}[]#@&%" * 20, True), ("1 22 333 4444\n5 6 7 8\n" * 5, True), ("<div><span>a</span></div>" * 20, True),
        ("name      price   stock\nbig kiln  12 eur  3 left\nmug       4 eur   12 left\nslip      30 eur  none", True),
        ("Soft clay\nSlow wheel\nWarm kiln\nGood mug", True), ("It was late.\nWe left.", False), ("Why not?", False),
        ("Home > Shop > News > Team > Press > Jobs > Help", True),
    ],
)
def test_prose(text, bad):
    assert quality.measure(text, frozenset(("the", "was"))) [-1] is bad


def test_alignment_looks_at_fields_and_columns():
    padded = ["a b c      | d", "aa         | dd", "a, b, c, d | e", "q          | r"]
    fields = ["a;b;c", "aaa;bbbb;c", "q;rr;sss", "t;u;v"]
    assert quality._alignment(padded)[1] == 0.75 and quality._alignment(fields)[0] == 0.75 and quality._alignment(fields)[1] < 0.75
    assert quality._alignment(["no separator here"]) == (0.0, 0.0)


def test_periodic_lines():
    zigzag = np.array([1.0, 9.0] * 8)
    assert quality._autocorrelation(zigzag) > 0.8 and abs(quality._autocorrelation(np.random.default_rng(1).normal(size=200))) < 0.3
    assert quality._autocorrelation(np.ones(10)) == 0.9 and quality._autocorrelation(np.ones(1)) == 0.0


def test_statistics(spark):
    rows = [(1, PROSE, "s", 1, "k"), (2, None, "s", 1, "k"), (3, " \n ", "s", 1, "k"), (4, "x" * 200_000, "s", 1, "k"), (1, PROSE, "s", 1, "k")]
    common = spark.createDataFrame([("en", "The"), ("en", None), ("de", "the")], "lang string, word string")
    got = quality.text_statistics(spark.createDataFrame(rows, DOCUMENTS), common).orderBy("doc_id").collect()
    assert [r.n_words for r in got] == [25, 25, 0, 0, 1] and not any(r.non_prose for r in got[:4])
    assert abs(got[0].common_share - 3 / 25) < 1e-9 and got[2].mean_word_length is None and got[0].end_punctuation == 1.0
    assert quality.text_statistics(spark.createDataFrame([], DOCUMENTS), common).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=30))
def test_keys_keep_order(values):
    v = np.array(values)
    k = percentiles.to_keys(v)
    assert (np.sort(v) == v[np.argsort(k, kind="stable")]).all() and (percentiles.to_values(k) == v).all()


def test_percentiles(spark):
    rng = random.Random(7)
    rows = [(g, rng.choice([1.5, rng.random() * 10 ** rng.randint(0, 8), float(rng.randint(0, 5))]), rng.randint(0, 40)) for g in (1, 1, 1, 2) for _ in range(300)]
    rows += [(1, None, -1), (1, math.nan, None), (None, 5.0, 5), (3, 7.25, None), (4, -2.0, -5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g bigint, a double, b bigint, n string")
    shares = [0.0, 0.5, 0.95, 1.0]
    got = {(r.g, r.metric, r.share): (r.n, r.value) for r in percentiles.percentiles(df, "g", ["a", "b"], shares).collect()}
    expected = {}
    for g in (1, 2, 3):
        for j, m in ((1, "a"), (2, "b")):
            v = [r[j] for r in rows if r[0] == g and r[j] is not None and r[j] >= 0]
            for s in shares if v else ():
                expected[g, m, s] = len(v), float(np.quantile(v, s))
    assert got.keys() == expected.keys()
    for k, (n, v) in expected.items():
        assert got[k][0] == n and math.isclose(got[k][1], v, rel_tol=1e-9, abs_tol=1e-12), k
    assert percentiles.percentiles(df.limit(0), "g", ["a"], [0.5]).count() == 0
    # histograms of separate sets add up, within the error of their bits
    parts = [percentiles.histogram(percentiles.long_form(df.where(F.col("b") % 2 == x), "g", ["a"]), "g") for x in (0, 1)]
    for r in percentiles.from_histogram(percentiles.combine(parts, "g"), "g", [0.5]).collect():
        v = sorted(x[1] for x in rows if x[0] == r.g and x[1] is not None and x[1] >= 0 and x[2] is not None)
        exact = v[max(1, math.ceil(0.5 * len(v))) - 1]
        assert exact * (1 - 2 ** -(percentiles.SKETCH_BITS - 12)) <= r.value <= exact
