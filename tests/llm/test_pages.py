"""Operators over pages: repeated lines, residue, spam, main content, near copies."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from pagelattice.functions.lines import blocks, lines
from pagelattice.llm import block_model, main_lines, near_pages, page_facts, residue, residue_rules, shingles, site_lines, stuffing, words
from pagelattice.llm.chunk import Chunk
from pagelattice.llm.parsed import line_counts, parse
from pagelattice.llm.residue_rules import classify, normalise
from pagelattice.session import durable

COLUMNS = "id bigint, crawl_id bigint, html string, page_id string, line string, n int, keys string"
LINKS = "page_id bigint, anchor_text string, words string"
TOPICS = "kiln glaze slip mug bowl rack tile wheel cone firing".split()


def sentence(i: int, k: int) -> str:
    a, b, c = (TOPICS[(i * m + k) % 10] for m in (1, 3, 7))
    return f"The {a} of page {i} and the {b} in case {k} were kept with a {c} for the whole of that season."


def page(i: int, body: str | None = None) -> str:
    body = body or "".join(f"<p>{sentence(i, k)} {sentence(i + 50, k)}</p>" for k in range(5))
    return (
        "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav>"
        f"<main><article><h1>Title number {i}</h1>{body}</article></main><footer><p>Terms of use</p><p>Built here</p></footer></body></html>"
    )


def facts_for(df):
    parsed = parse(df)
    return page_facts.page_facts(parsed, page_facts.site_support(parsed))


def frame(spark, htmls, crawl=1):
    return spark.createDataFrame([(i, crawl, h, "x", "y", 1, "z") for i, h in enumerate(htmls)], COLUMNS)


@pytest.mark.parametrize(
    "html, expected",
    [
        (None, []),
        ("", []),
        ("<p>a&nbsp; b&amp;c<br>d<b>e</b>f<hr>", ["a b&c", "defs"[:3]]),
        ("<HEAD><title>x</title></HEAD><BODY><DIV>Y<DIV>Z", ["Y", "Z"]),
        ("<script>if(a<b){'<p>no'}</script>t<!-- <p>c</p> --><noscript>n</noscript>", ["t"]),
        ('<p title="a > b">x</p>', ["x"]),
        ("<head><title>open<body>text", ["text"]),
    ],
)
def test_lines(html, expected):
    got = lines(html)
    assert got == [x.replace("def", "def") for x in expected]
    assert [b[0] for b in blocks(html)] == got


def test_repeated_lines_against_counts(spark):
    htmls = [page(i) for i in range(12)] + [page(3), None, "", "<p>  </p>"] + [f"<p>rare {i}<p>half" for i in range(6)]
    df = frame(spark, htmls).unionByName(frame(spark, [page(i) for i in range(5)], None))
    found = site_lines.repeated_lines(df)
    counts = Counter(t for h in htmls for t in set(lines(h)))
    size = sum(h is not None for h in htmls)
    expected = {t: n for t, n in counts.items() if n >= 8 and n >= 0.2 * size}
    rows = found.collect()
    assert {r.line: r.pages for r in rows} == expected and len(rows) == len(expected)
    by = {r.line: r.block_id for r in rows}
    assert by["Home"] == by["About us"] and by["Terms of use"] == by["Built here"] != by["Home"]
    clean = {r.page_id: r for r in site_lines.without_lines(df, found).where("crawl_id = 1").collect()}
    assert "Home" not in clean[0].text and "Title number 0" in clean[0].text and clean[0].removed == 4
    assert clean[0].occurrences == 2 and clean[14].occurrences == 0  # the menu and the footer, each one block
    apart = site_lines.without_lines(df, found.withColumn("block_id", F.col("line_key"))).where("page_id = 0 and crawl_id = 1").first()
    assert apart.occurrences == 4 and apart.text == clean[0].text  # without components every line is its own
    assert clean[13].text is None and clean[14].text == ""
    assert site_lines.repeated_lines(df.limit(0)).count() == 0


def test_occurrences():
    assert site_lines.occurrences([None, 1, 1, 2, None, 1]) == [(1, 1, 3), (2, 3, 4), (1, 5, 6)] and site_lines.occurrences([]) == []
    assert site_lines.occurrences([3]) == [(3, 0, 1)] and site_lines.occurrences([None]) == []


def test_small_batches_lose_no_text(spark):
    """A line's text must survive when batches hold a few pages of a crawl each."""
    df = frame(spark, [page(i) for i in range(40)]).repartition(20)
    rows = site_lines.repeated_lines(df).collect()
    assert {r.line for r in rows} == {"Home", "About us", "Terms of use", "Built here"} and all(r.pages == 40 for r in rows)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("[object Object]", "placeholder"), ("Dear {{ name }}", "placeholder"), ("undefined", "placeholder"),
        ("Lorem ipsum dolor sit amet", "filler"), ("TODO: copy from marketing", "filler"), ("Titre à compléter", "filler"),
        ("Page not found", "error"), ("Error 404", "error"), ("La dirección solicitada ya no existe.", "error"),
        ("Please enable JavaScript to continue", "scripts"), ("Bitte aktivieren Sie JavaScript", "scripts"), ("Oops!", "weak"),
        ("12 notes on the kiln and the mug", None), ("A visitor asked about the kiln.", None), ("Home", None),
    ],
)
def test_classify(text, kind):
    got = classify(normalise(text))
    assert (got and got[0]) == kind


LATIN = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad"
    " minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit"
    " in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui"
    " officia deserunt mollit anim id est laborum."
)


@pytest.mark.parametrize(
    "text, kind",
    [
        (LATIN, "filler"),
        ("We are down for scheduled maintenance. The site will be back soon and all of your orders are safe with us. Something went wrong while we moved the shop, please try again later. We will be back.", "error"),
        ("Fatal error: Uncaught PDOException: SQLSTATE[HY000] [2002] Connection refused in /srv/www/shop/lib/Db.php:48 Stack trace: #0 /srv/www/shop/lib/Db.php(48): PDO->__construct() #1 /srv/www/shop/index.php(12): Db::open() #2 {main}", "error"),
        ("This application is drawn by a script in your browser, and your browser is set to block it. Please enable JavaScript in the settings of your browser, then reload this page to see all of its content and menus.", "scripts"),
        ("The old server answered 'page not found' for a week. Nobody in the shop had noticed it, because the front page still worked. We moved the files over on a Monday, and orders came in again on the same day.", None),
        ("The most common filler starts with lorem ipsum dolor sit amet, and every designer in the shop has seen it before. It stands where the text is not yet written. We show in this guide how one finds it before a launch.", None),
    ],
)
def test_classify_long_lines(text, kind):
    got = classify(normalise(text))
    assert len(text) > 170 and (got and got[0]) == kind


def examples(tree) -> list[str]:
    """Strings that a parsed expression matches: every branch, options left out and taken, one of each set."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            got = [chr(arg)]
        elif op == "BRANCH":
            got = [x for b in arg[1] for x in examples(b)]
        elif op == "SUBPATTERN":
            got = examples(arg[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            got = [x * n for n in {arg[0], max(arg[0], min(arg[1], 1))} for x in examples(arg[2])]
        elif op == "ANY":
            got = ["'"]
        elif op == "IN":
            kind, value = arg[0]
            got = [chr(value)] if str(kind) == "LITERAL" else [chr(value[0])] if str(kind) == "RANGE" else [{"CATEGORY_WORD": "x", "CATEGORY_SPACE": " "}.get(str(value), "!")]
        else:
            assert op == "AT", op
            got = [""]
        out = list(dict.fromkeys(a + b for a in out for b in got))
    return out


@pytest.mark.parametrize("rule", ["NO_VALUE", "NO_VALUE_LINE", "FILLER", "ERROR", "SCRIPTS", "WEAK_LINE"])
def test_the_shortcut_drops_no_message_of_the_rules(rule):
    listed = getattr(residue_rules, rule)
    listed = [listed] if isinstance(listed, str) else listed
    made = [x for r in listed for x in examples(re._parser.parse(r)) if re.search(r, x)]
    assert len(made) > 3 and [x for x in made if classify(x) is None or not residue_rules.could_be(x)] == []


CLIPPED = "vestib pellen sollic condim tincid ultric phare sagit portt maecen scel ullam".split()


def test_mock_latin_is_told_by_its_letters():
    """Filler of clipped or altered words, none of which the vocabulary lists, is filler; function-less real words are not."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        made = [w + str(rng.choice(["um", "us", "a", "is", "or"])) for w in rng.choice(CLIPPED, 14)]
        assert residue_rules.LOREM.isdisjoint(made) and classify(normalise(" ".join(made).capitalize() + ".")) == ("filler", True)
    for text in (
        "Patient test tile, clumsy question, quick visitor", "Günstige Teller kaufen Angebot Keramik Schale Ofen Glasur",
        "envío gratis lista oferta horno arcilla esmalte", "Vase céramique promotion prix livraison gratuite atelier four",
    ):
        assert classify(normalise(text)) is None


def test_mock_latin_pages(spark):
    rng = np.random.default_rng(4)
    body = ["".join(f"<p>{' '.join(w + 'um' for w in rng.choice(CLIPPED, 20))}.</p>" for _ in range(4)) for _ in range(3)]
    df = frame(spark, [*(page(i, b) for i, b in enumerate(body)), *(page(i) for i in range(3, 12))])
    assert {r.page_id for r in residue.find(facts_for(df)).collect()} == {0, 1, 2}


def test_page_kinds_and_main_lines(spark):
    broken = [
        page(0, "<p>{{ body }}</p><p>[object Object]</p>"),
        page(1, "<p>Page not found</p><p>The address you asked for does not exist.</p>"),
        page(2, f"<p>{{{{ a }}}}</p><p>undefined</p><p>${{b}}</p><p>{sentence(9, 1)}</p>"),
    ]
    keys = ["cheap kiln", "best kiln", "kiln sale", "buy glaze", "kiln online", "glaze price"]
    spam = [
        page(3, "<ul>" + "".join(f"<li>{keys[k % 6]} {keys[(k * 5) % 6]}</li>" for k in range(60)) + "</ul>"),
        page(4, "<p>" + " ".join(f"Get {keys[k % 6]} here. Our kiln is {keys[k % 6]}." for k in range(80)) + "</p>"),
    ]
    quoting = page(5, "".join(f"<p>{sentence(5, k)}</p>" for k in range(4)) + "<pre>{{ name }}</pre>")
    htmls = [*broken, *spam, quoting, *(page(i) for i in range(6, 30)), None, "", "<p>"]
    df, links = frame(spark, htmls), spark.createDataFrame([(3, None, "w"), (3, " ", "w"), (99, "x", "w")], LINKS)
    facts = durable(facts_for(df))
    bad = durable(residue.find(facts))
    assert {r.page_id for r in bad.collect()} == {0, 1, 2}
    assert {r.page_id for r in stuffing.stuffed_pages(facts, links, bad).collect()} == {3, 4}
    texts = {r.page_id: r.text.split("\n") for r in main_lines.main_texts(df, links).collect()}
    assert set(texts) == {*range(5, 30), 31, 32}
    for i in range(6, 30):
        assert texts[i] == lines(htmls[i])[2:-2], i
    hashes = main_lines.main_line_hashes(df, links)
    assert hashes.where("page_id = 7").count() == 6 and hashes.where("length(line_hash) <> 16").count() == 0
    empty = df.limit(0)
    assert main_lines.main_line_hashes(empty, links).count() == 0
    assert residue.messages(facts_for(empty)).count() == 0


def test_copies_in_a_crawl_keep_their_lines(spark):
    """Copies that fill a third of a crawl are measured on what they hold, also where small parts of them differ."""
    keys = ["cheap kiln", "best kiln", "kiln sale", "buy glaze", "kiln online", "glaze price"]
    items = "".join(f"<li>{keys[k % 6]} {keys[(k * 5) % 6]}</li>" for k in range(60))
    prose = "".join(f"<p>{sentence(5, k)}</p>" for k in range(8))
    spam = [page(0, f"<ul>{items}</ul>")] * 8 + [page(i, f"<ul>{items}</ul>") for i in range(8)]
    quoting = [page(70 + i % 3, f"{prose}<pre>{{{{ name }}}}</pre>") for i in range(12)]
    missing = [page(80, "<p>Page not found</p><p>The address you asked for does not exist.</p>")] * 4
    df = frame(spark, [*spam, *quoting, *missing, *(page(i) for i in range(100, 124))])
    facts = facts_for(df)
    bad = durable(residue.find(facts))
    assert {r.page_id for r in bad.collect()} == {*range(28, 32)}
    links = spark.createDataFrame([], LINKS)
    assert {r.page_id for r in stuffing.stuffed_pages(facts, links, bad).collect()} == {*range(16)}
    few = frame(spark, [page(0, f"<ul>{items}</ul>")] * 3)  # no other page tells what is the site's
    facts = facts_for(few)
    assert stuffing.stuffed_pages(facts, links, durable(residue.find(facts))).count() == 3


def test_filler_sentences_are_no_real_ones():
    """Many sentences do not hide a page whose sentences are residue themselves; no line is too long or too late to count."""
    lines_ = [f"Sample text for this section of part {x}, replace before launch." for x in "abcdefghi"]
    long = "We could not find the page you followed, " + "which the older index of this shop still had in its list, " * 4 + "sorry."
    pages = [blocks(page(1, "".join(f"<p>{x}</p>" for x in body))) for body in (lines_, [sentence(1, k) for k in range(9)], [long])]
    chunk = Chunk(pages)
    reals, messages = page_facts.facts_of(chunk, np.zeros(len(chunk.texts), bool))[-2:]
    assert reals[:2] == [9, 9] and [sum(m["real"] for m in x) for x in messages] == [9, 0, 1] and [len(x) for x in messages] == [9, 0, 1]


def test_weak_wording_needs_three_crawls(spark):
    def crawl(c: int, n: int):
        rows = [page(100 * c + i, None if i else "<p>Oops!</p><p>New page</p>") for i in range(n)]
        return frame(spark, rows, c).withColumn("id", F.col("id") + 1000 * c)

    two, three = crawl(1, 12).union(crawl(2, 12)), crawl(1, 12).union(crawl(2, 12)).union(crawl(3, 12))
    assert residue.find(facts_for(two)).count() == 0
    assert {r.page_id for r in residue.find(facts_for(three)).collect()} == {1000, 2000, 3000}


def test_parsed_lines_come_back(spark):
    htmls = [page(1), "", "<p>", "<p>a<p>b<p>a"]
    parsed = parse(frame(spark, [*htmls, None]))
    assert parsed.count() == 4
    counts = {r.a: r.support for r in line_counts(parsed).collect()}
    assert counts[0] == 4 and counts[site_lines.line_hash("a")] == 1 and counts[site_lines.line_hash("Home")] == 1


def test_chunk_sums():
    texts = ["The İstanbul of 3 kilns.", "x_y z", "Home", "no-break"]
    chunk = Chunk([[(t, "/body/p", 0) for t in texts[:2]], [], [(t, "/body/p", 0) for t in texts[2:]]])
    assert chunk.of_lines("n_words").tolist() == [len(words.words(t)) for t in texts]
    assert chunk.word_hashes(np.arange(4)).tolist() == shingles.word_hashes([w for t in texts for w in words.words(t)]).tolist()
    assert chunk.per_page(chunk.n_tokens).tolist() == [7, 0, 2]
    assert Chunk([]).of_lines("short").tolist() == []


def test_labeller_reads_both_directions():
    w = block_model.load()
    p = blocks(page(1))
    shares = [None] * (3 * len(p))
    got = block_model.label(w, Chunk([p, [], p + p]), shares)
    assert len(got) == 3 * len(p) and block_model.label(w, Chunk([[]]), []).tolist() == []
    x, mask = block_model.pad(block_model.inputs(w, block_model.features(Chunk([p]), shares[: len(p)])), [len(p)])
    base = block_model.scores(w, x, mask)
    one_way = [block_model.recur(x @ w["xf"] + w["bf"], w["hf"], mask), block_model.recur((x @ w["xb"] + w["bb"])[::-1], w["hb"], mask[::-1])[::-1]]
    assert np.allclose(base, one_way[0] @ w["of"] + one_way[1] @ w["ob"] + x @ w["ox"] + w["o0"], atol=1e-4)
    changed = x.copy()
    changed[-1] += 1
    assert not np.allclose(base[0], block_model.scores(w, changed, mask)[0])
    wide = np.concatenate([x, np.zeros_like(x)])  # padding changes nothing
    long_mask = np.concatenate([mask, np.zeros_like(mask)])
    assert np.allclose(base, block_model.scores(w, wide, long_mask)[: len(p)], atol=1e-5)


def near(i: int, edits: int) -> str:
    words = " ".join(sentence(i, k) for k in range(9)).split()
    for k in range(edits):
        words[(k * 37 + 11) % len(words)] = f"edit{i}x{k}"
    return page(i, f"<p>{' '.join(words)}</p>")


def test_near_pages_against_all_pairs(spark):
    htmls = [near(i % 9, (i // 9) * 2) for i in range(45)] + [near(0, 0)] * 8 + [None, "", page(70, "<p>Too short to count for anything here.</p>")]
    df = frame(spark, htmls)
    links = spark.createDataFrame([], LINKS)
    sets = {r.page_id: shingles.shingle_set(r.text, 3) for r in main_lines.main_texts(df, links).collect() if len(shingles.words(r.text)) >= 50}
    expected = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if shingles.jaccard(sets[a], sets[b]) >= 0.7}
    found = near_pages.similar_classes(df, links)
    rows = [tuple(r) for r in near_pages.page_pairs(found).collect()]
    assert len(expected) > 60 and set(rows) == expected and len(rows) == len(expected)
    g = {r.page_id: r.group_id for r in near_pages.groups(found).collect()}
    assert set(g) == set(sets) and all(g[a] == g[b] for a, b in expected)
    assert near_pages.page_pairs(near_pages.similar_classes(df.limit(0), links)).count() == 0


def variants(spark, groups: int, of: int, rate: float):
    """(labels, texts, sets) of groups of texts that differ by single words."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(groups):
        base = [f"w{g}x{k}" for k in range(300)]
        for v in range(of):
            mine = list(base)
            for k in rng.choice(300, int(rng.integers(0, max(1, rate * 300)) + 1), replace=False):
                mine[k] = f"e{g}x{v}x{k}"
            rows.append((len(rows), " ".join(mine)))
    make = near_pages._labels(near_pages.TREES, near_pages.DEPTH, near_pages.root_depth()).make
    chunk = Chunk([[(t, "/body/p", 0)] for _, t in rows])
    _, roots, tails, bins, _ = make(chunk, np.ones(len(rows), bool))
    leaves = [(i, r, t) for i, (rs, ts) in enumerate(zip(roots.to_pylist(), tails.to_pylist())) for r, t in zip(rs, ts)]
    labels = durable(spark.createDataFrame(leaves, "page_id bigint, root bigint, tail bigint"))
    rows = [(i, b, t) for (i, t), b in zip(rows, bins.to_pylist())]
    return labels, durable(spark.createDataFrame(rows, "page_id bigint, bins binary, text string")), [shingles.shingle_set(t, 3) for _, _, t in rows]


def test_prefixes_shorten_by_the_data(spark):
    """Pages of a dense group stop at a longer prefix than pages without partners, and no similar pair is lost."""
    dense, dense_texts, dense_sets = variants(spark, 1, 60, 0.02)
    found = near_pages.search(dense, dense_texts)
    stops = {r.page_id: r.depth for r in found.stops.collect()}
    assert set(stops) == set(range(60)) and max(stops.values()) > near_pages.root_depth()
    lone, lone_texts, _ = variants(spark, 5, 1, 0.02)
    assert {r.depth for r in near_pages.search(lone, lone_texts).stops.collect()} == {near_pages.root_depth()}
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if shingles.jaccard(dense_sets[a], dense_sets[b]) >= near_pages.SIMILAR}
    got = {(r.a, r.b) for r in found.tested.where("similarity >= 0.7").collect()}
    assert len(want) > 1000 and got <= want and len(got) >= 0.999 * len(want)


def test_bins_bound_the_similarity():
    rng = np.random.default_rng(8)
    pool = np.unique(rng.integers(0, 1 << 62, 4000).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, int(rng.integers(1, 600)), replace=False)) for _ in range(40)] + [pool, pool[:3000]]
    bins = np.stack([np.bincount((x & np.uint64(near_pages.BINS - 1)).astype(np.int64), minlength=near_pages.BINS) for x in sets])
    for i, j in itertools.combinations(range(len(sets)), 2):
        assert near_pages.bound(bins[i : i + 1], bins[j : j + 1])[0] >= shingles.jaccard(sets[i], sets[j]) - 1e-12


def test_recall_at_the_threshold(spark):
    """Pairs of all similarities down to the threshold, against all pairs."""
    labels, texts, sets = variants(spark, 60, 5, 0.08)
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if shingles.jaccard(sets[a], sets[b]) >= near_pages.SIMILAR}
    got = {(r.a, r.b) for r in near_pages.search(labels, texts).tested.where("similarity >= 0.7").collect()}
    assert len(want) > 150 and got <= want and len(got) >= 0.99 * len(want)


def test_root_depth_holds_the_recall():
    for s, trees, recall in ((0.7, 26, 0.999), (0.8, 20, 0.99), (0.5, 10, 0.9)):
        d = near_pages.root_depth(s, trees, 8, recall)
        assert near_pages.chance(s, d, trees) >= recall and (d == 8 or near_pages.chance(s, d + 1, trees) < recall)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 62, 900).astype(np.uint64) * np.uint64(3))
    for a, b in ((x[:700], x[200:]), (x[:60], x[10:70])):  # a small set leaves most bins empty
        sets = np.concatenate([np.sort(a), np.sort(b)]), np.repeat([0, 1], [len(a), len(b)])
        sig = near_pages.signatures(*sets, 3, 512)
        assert abs((sig[0] == sig[1]).mean() - shingles.jaccard(np.sort(a), np.sort(b))) < 0.12 and not sig[2].any()
