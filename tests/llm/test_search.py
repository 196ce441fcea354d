"""HTML text, recurring passages, licenses, benchmark leaks, near copies."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from turnweave.llm import decontaminate, html_text, licenses, near_dup, substring

DOC = "doc_id long, text string, lang string, source string, n_chars long, shard int, anchor string, rep string, h string"


def docs(spark, rows):
    """With columns whose names clash with those used inside."""
    return spark.createDataFrame([(d, t, "en", "s", 1, 7, "x", "y", "z") for d, t in rows], DOC)


EDGE = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (9, "one")]


def mixed(seed, n=60):
    """Texts that share runs with one another, near copies, exact copies, and odd ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünï", "x y"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 90))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        kind = rng.random()
        if kind < 0.4:
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.7:
            o = rng.choice(base)
            a, b = sorted(rng.randrange(len(o) + 1) for _ in range(2))
            w[rng.randrange(len(w)) : 0] = o[a:b]
        elif kind < 0.8:
            w = [rng.choice(vocabulary) for _ in range(40)]
        out.append((1000 - 7 * i, "".join(x + rng.choice([" ", "\n", "  "]) for x in w)))
    return out + EDGE + [(5000, "lone " * 3000), (5001, "lone " * 3000)]


@pytest.mark.parametrize(("seed", "window"), [(1, 8), (2, 20), (3, 50)])
def test_repeats_against_brute_force(spark, seed, window):
    rows = mixed(seed)
    got = substring.remove_repeats(docs(spark, rows), window=window, shard_bytes=2000).collect()
    cut = brute.without_repeats(rows, window)
    want = [(d, len(k) + n, n, brute.sha(b" ".join(k)), b" ".join(k).decode() if n else t) for (d, k, n), (_, t) in zip(cut, rows, strict=True)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_repeats_of_an_empty_table(spark):
    assert substring.remove_repeats(docs(spark, [])).count() == 0


def test_automaton_blocks(spark, monkeypatch):
    rows = mixed(5)
    monkeypatch.setattr(substring, "AUTOMATON_WORDS", 30)
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs(spark, rows), window=10).collect()}
    assert got == {d: n for d, _, n in brute.without_repeats(rows, 10)}


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 5)])
def test_near_copies_against_brute_force(spark, seed, size):
    rows = mixed(seed, 80)
    got = near_dup.near_duplicates(docs(spark, rows), size=size).collect()
    assert len(got) == len(rows)
    want = brute.components(rows, size, 80)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == sorted((d, len(brute.shingles(t, size))) for d, t in rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_links_between_members_that_are_not_the_least(spark):
    """A chain: each text is like the next, the ends are not alike, and the least doc_id is at an end."""
    rng = random.Random(8)
    w = [f"a{i}" for i in range(300)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(w)))
        for k in rng.sample(range(300), 4):
            w[k] = f"b{i}-{k}"
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs(spark, rows), size=4).collect()}
    assert got == brute.components(rows, 4, 80)


def test_near_copies_of_an_empty_table(spark):
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_documents_without_an_id(spark):
    """They are kept, link with nothing, own no passage and lose none."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (1, text), (2, text + " more"), (None, text), (None, "other words"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(d).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True)] * 4 + [(1, 1, True), (2, 1, False)]
    assert sorted(map(str, (tuple(r) for r in corpus_pipeline.drop_near_copies(spark, d, "").collect()))) == sorted(map(str, (r for r in rows if r[0] != 2)))
    cut = substring.remove_repeats(d).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in cut) == [(0, 0)] * 4 + [(1, 0), (2, 60)]


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i + 1000, i + 1001) for i in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up if top(x) != x}


def test_licenses_against_brute_force(spark):
    rng = random.Random(4)
    texts = [t for _, t in licenses.TEMPLATES]
    rows = []
    for i in range(120):
        w = [rng.choice(["alpha", "the", "license", "under", "of"]) for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(w))
        notice = rng.choice(texts).split(" ")
        if rng.random() < 0.3:
            notice[rng.randrange(len(notice))] = "ALTERED"
        rows.append((i, " ".join(w[:at]) + "\n" + " ".join(notice).upper() + ".\n" + " ".join(w[at:])))
    rows += [(300 + i, "x " + t + " y") for i, t in enumerate(texts)] + [(400, texts[0]), (400, texts[8]), (401, texts[13][: len(texts[13]) // 2])]
    rows += [*EDGE, (999, ("filler text here " * 5000) + texts[0])]
    model = {n: brute_grams(t) for n, t in licenses.TEMPLATES}
    want = set()
    for d, t in rows:
        have = brute_grams(t)
        want |= {(d, n, len(have & g), len(g)) for n, g in model.items() if len(have & g) * 10 >= len(g) * 8}
    for block_words in (licenses.BLOCK_WORDS, 60):
        got = licenses.scan_licenses(docs(spark, rows), block_words=block_words).collect()
        assert {(r["doc_id"], r["license"], r["n_matched"], r["n_shingles"]) for r in got} == want and len(got) == len(want)
    got = licenses.scan_licenses(docs(spark, rows)).collect()
    assert {(r["doc_id"], r["license"], r["n_matched"], r["n_shingles"]) for r in got} == want and len(got) == len(want)
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_long_licenses_altered_and_scattered(spark):
    """Full texts with altered words, halves, and shingles in any order: as brute force has it, by any number of blocks."""
    rng = random.Random(14)
    rows, long = [], [(n, licenses.template_words(t)) for n, t in licenses.TEMPLATES if n.endswith("-text")]
    for i, (_, w) in enumerate(long):
        for j, share in enumerate((0.0, 0.01, 0.03, 0.06)):
            rows.append((10 * i + j, " ".join("altered" if rng.random() < share else x for x in w)))
        rows.append((10 * i + 5, " ".join(w[: len(w) // 2])))
        grams = sorted({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
        rng.shuffle(grams)
        rows.append((10 * i + 6, " / ".join(" ".join(g) + f" filler{k} of other words" for k, g in enumerate(grams[: int(len(grams) * 0.9)]))))
    rows.append((None, " ".join(long[0][1])))
    model = {n: brute_grams(t) for n, t in licenses.TEMPLATES}
    want = {(d, n, len(h & g), len(g)) for d, t in rows for h in [brute_grams(t)] for n, g in model.items() if len(h & g) * 10 >= len(g) * 8}
    assert {n for n, _ in long} <= {n for d, n, *_ in want if d is not None and d % 10 == 6} and any(d is None for d, *_ in want)
    for block_words in (licenses.BLOCK_WORDS, 3000):
        got = licenses.scan_licenses(docs(spark, rows), block_words=block_words).collect()
        assert {(r["doc_id"], r["license"], r["n_matched"], r["n_shingles"]) for r in got} == want and len(got) == len(want)


def test_bands_retrieve_before_anything_is_counted(spark):
    """Documents that no band finds are not counted; one window inside a long template is found surely."""
    words = [f"w{i}" for i in range(400)]
    inside = " ".join(words[100 : 100 + licenses.SHINGLE - 1 + licenses.WINDOW + licenses.STRIDE])
    rows = [(1, inside), (2, " ".join(words[::-1])), (3, "w0 w1 w2 w3 w4"), (4, "x y z a b c d"), (5, None)]
    (block,) = licenses.template_blocks([("long", " ".join(words)), ("note", "x y z a b"), ("note", "a b c d e f")], 1000)
    assert [(n, k) for n, k, _ in block] == [("long", 396), ("note", 3), ("note", 3)]
    given = spark.createDataFrame(block, "license string, n_shingles long, text string")
    known = licenses.shingles_of(given.withColumn("_h", licenses.word_hashes(given["text"])), ["license", "n_shingles"])
    found = {r["_id"]: r["licenses"] for r in licenses.retrieve(docs(spark, rows), known, [k for _, k, _ in block]).collect()}
    assert found.pop(1) == ["long"] and found.pop(4) == ["note"] and set(found) <= {3}


def brute_grams(text):
    w = licenses.template_words(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_licenses_run_no_python(spark):
    text = licenses.scan_licenses(docs(spark, EDGE))._jdf.queryExecution().executedPlan().toString()
    assert not any(k in text for k in ("Python", "Arrow", "Pandas"))


def test_templates_are_checked(spark):
    with pytest.raises(ValueError, match="under 5 words"):
        licenses.scan_licenses(docs(spark, EDGE), [("x", "too short")])


def test_benchmark_in_scripts_without_spaces(spark):
    """Items inside a run of letters count by their letters alone, with edits; others still only as whole words."""
    rng = random.Random(12)
    scripts = {"han": "東京日本首都人口多国語学校新聞", "kana": "あいうえおかきくけこさしすせそ", "thai": "กขคงจฉชซญดตถทนบ", "latin": "abcdefg"}
    items, rows = [(1, "東京は日本の首都です。人口は多い"), (2, "ประเทศไทยมีเมืองหลวงชื่อกรุงเทพ"), (3, "日本語 and letters"), (4, "一")], []
    for k, letters in enumerate(scripts.values()):
        items += [(10 * (k + 1) + j, "".join(rng.choice(letters) for _ in range(rng.randint(12, 40)))) for j in range(4)]
    for i in range(80):
        _, x = rng.choice(items)
        leak = list(x)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(leak))
            leak[at : at + rng.randint(0, 1)] = rng.choice(("", "国", "z", "ก"))
        around = [rng.choice(("前文です", "ですが", "ก", "xx", " x ", "")) for _ in range(2)]
        rows.append((i, around[0] + "".join(leak) + around[1]))
    rows += [(100, "前文です東京は日本の首都です。人口は多いですが"), (101, "前日本語 and letters"), (102, "日本語 and lettersx"), (103, "abcdefg" * 9)]
    want = set()
    for d, t in rows:
        for i, x in items:
            pattern, counted = decontaminate.pattern_of(x)
            plain = " ".join(re.findall(r"\w+", x.lower()))
            unspaced = [any(lo <= c <= hi for lo, hi in (("\u0e00", "\u0fff"), ("\u3040", "\u30ff"), ("\u4e00", "\u9fff"))) for c in (plain[0], plain[-1])]
            assert pattern == ("" if unspaced[0] else " ") + plain + ("" if unspaced[1] else " ") and counted == len(plain)
            if (best := brute.sub_distance(pattern, decontaminate.normalized(t))) <= int(0.08 * counted):
                want.add((d, i, best))
    for block_chars in (decontaminate.BLOCK_CHARS, 60):
        got = {tuple(r) for r in decontaminate.find_items(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars).collect()}
        assert got == want
    assert (100, 1, 0) in want and {(101, 3, 0), (102, 3, 1)} <= want and len(want) > 20


def test_benchmark_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 14)))) for i in range(8)] + [(98, None), (99, "  ")]
    rows = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.7:
            leak = list(rng.choice(items[:8])[1])
            for _ in range(rng.randint(0, 6)):
                leak[rng.randrange(len(leak))] = rng.choice("abcx")
            body[rng.randint(0, len(body)) :] = ["".join(leak).upper()]
        rows.append((i, " , ".join(body)))
    rows += [*EDGE, (59, rows[-1][1]), (70, items[2][1]), (70, items[2][1] + " more"), (70, items[3][1])]
    items += [(100, "ace"), (2, "another text of item two")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    rows += [(71, "the ace of"), (72, "facet aced")]  # whole words only, where there is no budget
    least: dict = {}
    for d, t in rows:
        body = decontaminate.normalized(t)
        for i, x in items:
            n = decontaminate.normalized(x)
            if n and (best := brute.sub_distance(n, body)) <= int(0.08 * (len(n) - 2)):
                least[d, i] = min(best, least.get((d, i), best))
    want = {(d, i, best) for (d, i), best in least.items()}
    assert {(70, 2, 0), (70, 3, 0), (71, 100, 0)} <= want and not any(d == 72 for d, *_ in want)
    got = [tuple(r) for r in decontaminate.find_items(docs(spark, rows), bench).collect()]
    assert set(got) == want
    assert len(got) == len(want)
    in_blocks = [tuple(r) for r in decontaminate.find_items(docs(spark, rows), bench, block_chars=40).collect()]
    assert set(in_blocks) == want and len(in_blocks) == len(want)
    assert decontaminate.find_items(docs(spark, rows), bench.where("false")).count() == 0
    assert decontaminate.find_items(docs(spark, []), bench).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>Menu</li></ul></nav>
<div class="ad banner">Buy</div><aside>Side</aside><article><h1>Title &amp;
 more</h1><p>First <b>bold</b>&nbsp;text.<br><p>Second &lt;x&gt;<!-- no --> &am<form><button>Send</button></form></p><section class="comments"><p>Reader</p></section></article>
<footer>&copy; me</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "a", "b") for i, u, h in rows], "page_id long, url string, html string, text string, _host2 string")


def test_html(spark):
    plain = "<body><div>Site name</div><p>{}</p><p>Contact us</p></body>"
    rows = [
        (1, "http://a.org/x/1", PAGE), (2, None, None), (3, "broken", ""), (3, "broken", ""), (4, "http://a.org/x/1", PAGE),
        (5, "http://b.org/n/1", plain.format("one")), (6, "http://b.org/n/2?q=1", plain.format("two")), (7, "http://c.org/", plain.format("alone")),
    ]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_pages(pages(spark, rows)).collect()}
    article = "Title & more\nFirst bold text.\nSecond <x> &am"
    assert got[1] == got[4] == (article, len(article))
    assert got[2] == got[3] == ("", 0)
    assert got[5][0] == "one" and got[6][0] == "two"
    assert got[7][0] == "Site name\nalone\nContact us"
    assert html_text.extract_pages(pages(spark, rows)).count() == len(rows)
    assert html_text.extract_pages(pages(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_html_neighbours_with_other_lines(spark, parts):
    """Whatever the number of ranges, each page meets the nearest pages of its host with other lines."""
    rng = random.Random(11)
    body = lambda k: "<body><div>Site</div>" + "".join(f"<p>{x}</p>" for x in (f"text {k}", "one", f"rare {k % 3}")) + "<p>Contact</p></body>"
    rows, n = [], 0
    for host, count in (("a.org", 1), ("b.org", 40), ("c.org", 60), ("d.org", 9)):
        k = 0
        for p in range(count):
            k = k if host == "d.org" or (host == "c.org" and 10 < p < 50) or rng.random() < 0.4 else p
            rows.append((n, f"http://{host}/{p // 7:03}/{p:03}", body(k)))
            n += 1
    rows.append(rows[20])
    ordered = sorted((*html_text.re.match("http://([^/]*)(.*)", u).groups(), i, u, html_text.page_lines(h)) for i, u, h in rows)
    want = []
    for at, (host, path, i, u, lines) in enumerate(ordered):
        other = lambda xs: next((x for x in xs if x[0] == host and x[4] != lines), None)  # noqa: B023, E731
        near = [x for x in (other(ordered[:at][::-1]), other(ordered[at + 1 :])) if x]
        best = max(near, key=lambda x: html_text.common_start(x[1], path), default=None)
        shared = html_text.shared_lines([x for x, _ in lines], [x for x, _ in best[4]])[0] if best else set()
        want.append((i, u, html_text.main_text(lines, shared)))
    assert all(t for *_, t in want)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = html_text.extract_pages(pages(spark, rng.sample(rows, len(rows)))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r["page_id"], r["url"], r["text"]) for r in got) == sorted(want)


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 10))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        p, q = html_text.shared_lines(a, b)
        assert len(p) == len(q) == table[-1][-1] and [a[i] for i in sorted(p)] == [b[j] for j in sorted(q)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<main class="page-with-sidebar"><p>Body</p></main>', "Body"),
        ('<article class="post has-comments"><p>Body</p><div class="comments-area">Reader</div></article>', "Body"),
        ('<article><div class="search-results-story"><p>Body</p></div></article>', "Body"),
        ('<article><p class="ad">Buy<p>Body<p>More</article>', "Body\nMore"),
        ('<article><ul><li class="ad">Buy<li>Body</ul><table><tr><td class="promo">Buy<td>Cell<tr><td>Next</table></article>', "Body\nCell\nNext"),
        ('<article><dl><dt class="share">Share<dd>Body</dl><div class="social-links">Share</div></article>', "Body"),
        ('<nav>Menu</nav><article><header><h1>Head</h1></header>A&amp;B &lt;c&gt; &#233;<br>next\n  line</article>', "Head\nA&B <c> é\nnext line"),
        ('<article><p>Body<table><tr><td><p>In</td></tr></table><p>After</article>', "Body\nIn\nAfter"),
    ],
)
def test_html_markup(page, text):
    assert html_text.main_text(html_text.page_lines(page), None) == text


@pytest.mark.parametrize("name", "comment-thread wp-block-comments user-comments-v2 discussion responses ad-300x250 adsbygoogle related-posts share-buttons newsletter-signup-cta cookie-policy cookie-banner-v3 promo-card".split())
def test_html_furniture_by_parts_of_names(name):
    page = f'<article><p>Body</p><div class="{name}"><p>Not of the article</p></div><section id="x {name}">Nor this</section><p>End</article>'
    assert html_text.main_text(html_text.page_lines(page), None) == "Body\nEnd"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body><form id="aspnet"><main><p>text</p></main></form></body>', "text"),
        ('<body><form id="aspnet"><div>Field of view</div><label>Name</label><input value="x"></form><p>after</body>', "Field of view\nafter"),
        ('<div class="page-content main-banner">Big<article><p>Body</p></article>sale</div>', "Body"),
        ('<div class="comments"><article><p>A reader says</p></article></div><p>Body', "Body"),
        ('<aside><article>Other page</article></aside><article>Body</article>', "Body"),
        ('<article><svg class="i"/><p>Body</p><svg><path d="M0"/><text>no</text></svg><p>End</article>', "Body\nEnd"),
        ("<article><p title=it's>one</p><p title=a'b\"c>two</p><a href=/x/>three</a></article>", "one\ntwo\nthree"),
        ('<article><p a="x>y" b=\'>\' c = d>one < two &lt; 3<br/>four</article>', "one < two < 3\nfour"),
        ('<article><p data-id="ad" aria-role="menu">Body<!-- <p>no --><!doctype x><?php p?></article>', "Body"),
        ("<article>Body<p>cut <a href='never closed>", "Body\ncut"),
        ('<article>A short one</article><div><p>' + "an unnamed thread of reader comments " * 30 + "</p></div>", "A short one"),
        ("<article><form><p>Write to us</p></form><p>Body<div><p>In", "Body\nIn"),
    ],
)
def test_html_by_the_rules(page, text):
    assert html_text.main_text(html_text.page_lines(page), None) == text


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<p><b>", "<", "<!", "</p>", "<td><p>", "<a b='", '<a b="', "<li class=x", "<script>", "&amp", "<p/ ", "<button><p>"])
def test_html_time_is_linear(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_text.page_lines(page[: len(page) // 8])
    eighth = time.process_time() - began
    began = time.process_time()
    html_text.page_lines(page)
    assert time.process_time() - began < max(1.0, 16 * eighth)


def plain_main_text(page, other):
    """A page of divs only, against its neighbour: its lines without one longest common subsequence, by the textbook table."""
    a, b = (x.removeprefix("<div>").removesuffix("</div>").split("</div><div>") for x in (page, other))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return a, table[-1][-1]


def test_html_differencing_against_a_plain_table(spark):
    """Unmarked pages of one host: what is deleted is a common subsequence, and a longest one."""
    rng = random.Random(9)
    menu = [f"menu {k}" for k in range(6)]
    rows = []
    for k in range(40):
        lines = [x for x in menu if rng.random() < 0.8] + [f"own {k} {j}" for j in range(rng.randint(0, 4))] + [rng.choice(menu) for _ in range(3)]
        rows.append((k, f"http://p.org/{k // 2:02}/{k % 2}", "<div>" + "</div><div>".join(lines) + "</div>"))
    got = {r["page_id"]: (r["text"].split("\n") if r["text"] else [], r["n_shared_lines"]) for r in html_text.extract_pages(pages(spark, rows)).collect()}
    for k, _, page in rows:
        a, longest = plain_main_text(page, rows[k ^ 1][2])
        kept, shared = got[k]
        assert shared == longest and len(kept) == len(a) - longest
        rest = iter(a)
        assert all(x in rest for x in kept) and {x for x in a if x.startswith("own")} == {x for x in kept if x.startswith("own")}


def test_html_copies_of_unmarked_pages_keep_their_text(spark):
    page = "<body><div>Site</div><p>{}</p></body>"
    rows = [(1, "http://u.org/a?q=1", page.format("same")), (2, "http://u.org/a?q=2", page.format("same")), (3, "http://u.org/b", page.format("other"))]
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(pages(spark, rows)).collect()}
    assert got == {1: "same", 2: "same", 3: "other"}


def test_links_in_a_crowd_of_unlike_members(spark, monkeypatch):
    """All members share a template (similarity 0.69): every link is found, and most unlike pairs stop at their signatures."""
    rng = random.Random(31)
    template = [f"t{i}" for i in range(82)]
    rows, linked = [], {}
    for k in range(1000):
        own = [f"o{k}-{i}" for i in range(18)]
        rows.append((k, " ".join(template + own)))
        if k % 20 == 0:
            rows.append((5000 + k, " ".join(template + own[:-2] + [f"p{k}", f"q{k}"])))
            linked[5000 + k] = k
    rng.shuffle(rows)
    one, other = (brute.shingles(t, 4) for d, t in rows if d in (1, 2))
    assert 0.68 < len(one & other) / len(one | other) < 0.7
    tested = []
    crossing = near_dup.crossing_pairs
    monkeypatch.setattr(near_dup, "crossing_pairs", lambda *args: tested.append(crossing(*args)) or tested[-1])
    counted = []
    confirm = near_dup.confirm
    monkeypatch.setattr(near_dup, "confirm", lambda pairs, *args: counted.append(pairs.count()) or confirm(pairs, *args))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs(spark, rows), size=4).collect()}
    assert got == {d: linked.get(d, d) for d, _ in rows}
    assert len(tested) == 1 and sum(counted) < len(rows) ** 2 / 2 / 4


def test_a_crowd_just_under_the_threshold_makes_no_table_of_pairs(spark, monkeypatch):
    """Members at similarity 0.75 pass the signature tests with one another; still no table has more rows than the members' bands."""
    rng = random.Random(32)
    template = [f"t{i}" for i in range(87)]
    rows, linked = [], {}
    for k in range(600):
        own = [f"o{k}-{i}" for i in range(14)]
        rows.append((k, " ".join(template + own)))
        if k % 20 == 0:
            rows.append((5000 + k, " ".join(template + own[:-2] + [f"p{k}", f"q{k}"])))
            linked[5000 + k] = k
    # a member's second copy is linked with its first alone
    for d, k in list(linked.items())[:10]:
        rows.append((d + 4000, dict(rows)[d] + f" z{k}"))
        linked[d + 4000] = k
    rng.shuffle(rows)
    one, other = (brute.shingles(t, 4) for d, t in rows if d in (1, 2))
    assert 0.74 < len(one & other) / len(one | other) < 0.76
    written = []
    materialize = near_dup.materialize

    def counted(*args):
        table = materialize(*args)
        written.append(table.count())
        return table

    monkeypatch.setattr(near_dup, "materialize", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs(spark, rows), size=4).collect()}
    assert got == {d: linked.get(d, d) for d, _ in rows}
    assert max(written) <= near_dup.BANDS * len(rows)


def test_links_of_a_group_in_one_pass(spark):
    """Exact at the threshold, one link for two components, none inside a component, texts without words link with nothing."""
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [
        (1, 0, 0, 10, 10, words(0, 10)), (1, 0, 0, 11, 10, words(0, 10)), (1, 0, 0, 12, 12, ""), (1, 0, 0, 13, 13, words(50, 60)),
        (1, 0, 1, 20, 20, words(2, 10)), (1, 0, 1, 21, 20, words(0, 10)), (1, 0, 1, 22, 10, words(0, 10)), (1, 0, 1, 23, 23, None), (1, 0, 1, 24, 24, words(3, 10)),
        (1, 0, 1, 25, 25, words(50, 61)), (2, 0, 0, 30, 30, ""), (2, 0, 1, 31, 31, words(0, 10)), (3, 0, 1, 40, 40, words(0, 10)), (3, 1, 0, 13, 13, words(50, 60)), (3, 1, 1, 26, 25, words(50, 60)),
    ]
    groups = spark.createDataFrame(rows, "center long, g int, role int, doc_id long, component long, text string").coalesce(1).sortWithinPartitions("center", "g", "role", "doc_id")
    assert sorted(map(tuple, near_dup.forest(groups, 1, 80).collect())) == [(10, 20), (13, 25), (13, 26)]
