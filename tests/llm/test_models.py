import math
import random

from pyspark.sql import functions as F

from palimpsest.llm.decontam import Benchmark, Canonicaliser, contamination, keep_clean
from palimpsest.llm.htmlextract import blocks_of, extract, main_text
from palimpsest.llm.langid import identify, keep_identified
from palimpsest.llm.toxicity import Restorer, language_model, score_toxicity
from palimpsest.llm.urlfilter import Rule, Segmenter, judge_urls


def test_language_id(docs, rows, no_docs, spark):
    rng = random.Random(2)
    from tests.llm.conftest import DE, EN, sentence

    train = spark.createDataFrame([(k, sentence(rng, EN if k % 2 else DE, 80), "en" if k % 2 else "de") for k in range(40)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    test = spark.createDataFrame([(k, sentence(rng, EN if k % 2 else DE, 30)) for k in range(60)], "doc_id long, text string")
    got = identify(test, train).collect()
    assert sum(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got) >= 57
    assert all(0 <= r.score <= 1 for r in got)
    found = {r.doc_id: r for r in identify(docs, train).collect()}
    assert len(found) == len(rows)
    for r in rows:
        if not any(c.isalpha() for c in r[1] or ""):
            assert found[r[0]].lang_pred == "und" and found[r[0]].rejected and found[r[0]].score == 0
        else:
            assert found[r[0]].lang_pred in ("en", "de")
    kept = keep_identified(docs, train)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.rejected}
    assert identify(no_docs, train).count() == 0
    assert {r.lang_pred for r in identify(test, train.limit(0)).collect()} == {"und"}


BENCH = [
    (1, "A train travels 60 miles in 2 hours and then 90 miles more before the driver Alice stops for lunch near the old bridge"),
    (2, "the quick brown fox jumps over the lazy dog while seven grey geese watch from behind the wooden fence of the farm"),
    (3, None),
    (4, "too short"),
    (5, ""),
]


def test_decontamination(spark, docs, no_docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    filler = "some ordinary words that say nothing of note about anything at all here"
    rows = [
        (1, f"{filler} {BENCH[0][1]} {filler}", [1], "verbatim"),
        (2, f"{filler} {BENCH[1][1].upper()} {filler}", [2], "verbatim"),
        (3, BENCH[0][1].replace("60", "75").replace("90", "40").replace(" 2 ", " 3 ").replace("Alice", "Robert"), [1], "reparameterised"),
        (4, BENCH[1][1].replace("quick", "slow"), [2], "verbatim"),
        (5, filler, [], None),
        (6, " ".join(BENCH[1][1].split()[:12]), [], None),
        (7, None, [], None),
        (8, f"{BENCH[0][1]} . {BENCH[1][1]}", [1, 2], "verbatim"),
        (9, "60 90 2 " * 50, [], None),
    ]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for limit in (500_000, 1):
        got = {r.doc_id: r for r in contamination(frame, bench, block_words=limit).collect()}
        for i, _, items, kind in rows:
            assert (got[i].item_ids, got[i].kind, got[i].contaminated) == (items, kind, bool(items)), i
        assert {r.doc_id for r in keep_clean(frame, bench, block_words=limit).collect()} == {5, 6, 7, 9}
    assert contamination(frame, bench.limit(0)).filter("contaminated").count() == 0
    assert keep_clean(docs, bench).columns == docs.columns
    assert contamination(no_docs, bench).count() == 0


def test_slots_must_agree():
    """The same template with one value of the item in two roles is another question."""
    item = "if 5 birds join 5 birds on the long wire then how many birds sit on the long wire now"
    words = item.replace("5 birds join 5", "5 birds join 8").split()
    assert [bool(f) for f in Benchmark.of([(1, item)]).match_all([words, item.split()], Canonicaliser(), 5, 0.8, 0.99)] == [False, True]


def test_copies_side_by_side():
    """Variants of one item close together, and one beside the item itself, are each told."""
    item = "a boat carries 12 crates over the river in 3 trips while the captain counts 45 birds and pays 7 coins for tea"
    variant = lambda a, b, c, d: item.replace("12", a).replace(" 3 ", f" {b} ").replace("45", c).replace(" 7 ", f" {d} ")
    copies = [variant("20", "4", "50", "8"), variant("31", "6", "77", "9"), variant("14", "2", "60", "5"), variant("99", "1", "30", "11")]
    fill = "words that say nothing of note and go on with no end in sight for as long as one cares to".split()
    bench = Benchmark.of([(1, item)])
    cut = lambda text: " ".join([*text.split()[:11], *"as the old keeper of the lock who was never wrong liked to tell".split(), *text.split()[11:]])
    for texts, between, kind in ((copies[:1], 0, "reparameterised"), (copies[:2], 0, "reparameterised"), (copies[:2], 20, "reparameterised"), (copies, 5, "reparameterised"), ([copies[0], item, copies[1]], 3, "verbatim"), (list(map(cut, copies)), 2, "reparameterised")):
        words = f" {' '.join(fill[:between])} ".join(texts).split()
        found = bench.match_all([fill, words], Canonicaliser(), 5, 0.65, 0.8)[1]
        assert [(i, k) for i, _, k in found] == [(1, kind)], (len(texts), between)


def test_repeated_ids_short_items_and_items_of_placeholders(spark):
    """Items that share an id match each for itself, rows that share a doc_id stay rows, in one block and in several."""
    fill = "some ordinary words that say nothing of note about anything at all here"
    bench = [(1, BENCH[0][1]), (1, BENCH[1][1]), (1, BENCH[1][1]), (2, "Too short!"), (3, "7 11 13 17 19 23"), (None, "a null id names a row of the benchmark like any other does")]
    rows = [(1, BENCH[0][1]), (1, BENCH[0][1]), (1, fill), (2, BENCH[1][1]), (3, "too SHORT"), (4, "this is too short"), (5, f"{fill} 7, 11, 13, 17, 19, 23. {fill}"), (6, f"{fill} 2 11 13 17 19 23 {fill}"), (None, BENCH[1][1])]
    want = sorted(((i, x) for (i, _), x in zip(rows, ([1], [1], [], [1], [2], [], [3], [], [1]), strict=True)), key=str)
    frame, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for limit in (500_000, 1):
        assert sorted(((r.doc_id, r.item_ids) for r in contamination(frame, items, block_words=limit).collect()), key=str) == want
        kept = sorted(((r.doc_id, r.text) for r in keep_clean(frame, items, block_words=limit).collect()), key=str)
        assert kept == sorted((r for r, x in zip(rows, ([1], [1], [], [1], [2], [], [3], [], [1]), strict=True) if not x), key=str)


def test_names_that_open_sentences(spark):
    """A changed name opens sentences, or does so on one side only; two in one window; a name with two values is another question."""
    item = "Tom has 5 red apples in a basket. Tom buys 7 more apples from the market. Go. Tom eats 2 apples before lunch how many are left"
    other = item.replace("Tom", "Bob").replace("5", "9")
    rows = [(1, other), (2, "it is told that " + other.replace("basket. Bob", "basket and Bob", 1).replace("and ", "")), (3, other.replace("Bob buys", "Ann buys").replace("Bob eats", "Kim eats")), (4, other.replace("Go.", "go."))]
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.kind for r in contamination(frame, bench).collect()}
    assert got == {1: "reparameterised", 2: "reparameterised", 3: None, 4: "reparameterised"}
    assert [r.doc_id for r in keep_clean(frame, bench).collect()] == [3]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy now and save on all of the things that you want</div>
<div class="cookie-notice">We use cookies for the best of all and the rest</div>
<article class="post"><h1>Title &amp; more</h1><p><b>First  line<br>goes on<p>Short.<p>The second of the paragraphs is here for the reader &lt;ok&gt;</p>
<form><label>Name</label><input name=x><button>Go</button></form><aside>Related reading</aside><ul><li>Point one<li>Point two</ul>
<section id="comments"><p>I think that this is a comment of the reader and so on</p></section></article>
<footer>&copy; nobody</footer></body></html>"""


def test_html(spark):
    want = "Title & more\nFirst line goes on\nShort.\nThe second of the paragraphs is here for the reader <ok>\nPoint one\nPoint two"
    assert main_text(PAGE) == want
    plain = "<body><div><a href=1>Home</a> <a href=2>News</a></div><div>The first of the paragraphs has a lot of words that are in the list, and so it is good for us.</div><div>Yes.</div><div>The last of the paragraphs has a lot of words that are in the list, and so it is good for us.</div></body>"
    assert main_text(plain).split("\n")[1] == "Yes." and "Home" not in main_text(plain)
    pages = spark.createDataFrame([(1, "u", PAGE, 7), (2, None, None, 7), (3, "v", "", 7), (4, "w", "<p>x" * 20000, 7), (5, "w", "just text < 3", 7)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert got[1].text == want and got[1].n_chars == len(want) and got[2].text == "" and got[3].text == ""
    assert got[4].n_chars == 39999 and got[5].text == "just text < 3"
    assert extract(pages.limit(0)).count() == 0


STORY = "The first of the paragraphs has a lot of words that are in the list, and so it is good for us to read on and on."


def test_html_by_density():
    from palimpsest.llm.htmlextract import first_pass, second_pass

    assert main_text(f'<body><div class="content"><p>Tiny.</p></div><p>{STORY}</p></body>') == f"Tiny.\n{STORY}"
    russian = "Сегодня утром в маленьком городе на берегу реки прошла ярмарка, и туда пришли почти все жители окрестных сёл."
    assert main_text(f"<body><nav><a href=1>Главная</a></nav><p>{russian}</p><p>Да.</p><p>{russian}</p><div><a href=2>{russian}</a></div></body>") == f"{russian}\nДа.\n{russian}"
    figures = "EUR 12.50 13.75 18.20 19.99 / USD 11.10 12.30 17.80 18.75 / GBP 10.05 11.45 16.60 17.25 / CHF 12.95 13.15 18.85 20.10 / JPY 1800 1950 2600 2800"
    assert main_text(f"<body><p>{STORY}</p><p>{figures}</p><p>{STORY}</p></body>").split("\n")[1] == figures
    assert main_text(f"<body><nav>Menu</nav><h2>News</h2><p>{STORY}</p><p>Imprint</p><footer>x</footer></body>") == f"News\n{STORY}"

    def brute(labels, headings):
        out = []
        for k, label in enumerate(labels):
            decided = [j for j, x in enumerate(labels) if x != "near"]
            left, right = [j for j in decided if j < k], [j for j in decided if j > k]
            if label != "near":
                out.append(label == "good")
            elif headings[k] and left and right:
                out.append(labels[right[0]] == "good")
            else:
                nearest = [j for j in decided if abs(j - k) == min(abs(i - k) for i in decided)]
                out.append(all(labels[j] == "good" for j in nearest))
        return out

    rng = random.Random(11)
    for _ in range(400):
        labels = [rng.choice(["good", "bad", "near", "near"]) for _ in range(rng.randint(0, 9))]
        headings = [rng.random() < 0.2 for _ in labels]
        assert second_pass(labels, headings) == brute(labels, headings)
    assert first_pass(blocks_of(f"<p>{STORY}</p>")[0], True) == "good" and first_pass(blocks_of(f"<p><a>{STORY}</a></p>")[0], True) == "bad"


def test_hostile_pages_take_linear_time():
    import time

    began = time.time()
    for page in ("<b>x</i>" * 125_000, "<!" * 500_000, "<a \"" * 250_000 + ">", "<a =\"> " * 150_000, "<i><div>" + "<b>" * 150_000 + "</i>" * 150_000, "<a href='" * 110_000, "&" * 10**6, "<p>" * 300_000, "<script>" * 125_000):
        main_text(page)
    assert time.time() - began < 60
    assert main_text('<p title="a > b">1 < 2 <br/>and <3 </p') == "1 < 2 and <3 </p"


def test_toxicity(spark, no_docs):
    rng = random.Random(4)
    clean = ["river", "stone", "garden", "window", "letter", "summer", "mountain", "evening"]
    bad = ["scumbag", "moronic", "worthless"]
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(clean) + rng.choice(["", "s", "ly"]) for _ in range(30)]
        if toxic := k % 4 == 0:
            words[rng.randrange(30)] = bad[k // 4 % 3]
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    probe = ["you m0r0n1c one", "so w o r t h l e s s indeed", "such a $cumb@g!", "wooorthlessss", "m.o.r.o.n.i.c man", "MORONIC###", "what a m o r o n i c thing", "one scu mbag here", "he is morronnic", "a river garden", "", None, "4711 0815 $$$", "the " * 30000]
    test = spark.createDataFrame(list(enumerate(probe)), "doc_id int, text string").withColumn("score", F.lit("clash"))
    corpus = test.unionByName(docs.select((F.col("doc_id") + 100).cast("int").alias("doc_id"), "text", F.lit("x").alias("score")))
    got = {r.doc_id: r for r in score_toxicity(corpus, docs, labels).collect()}
    assert [got[k].score >= 0.7 for k in range(14)] == [True] * 9 + [False] * 5
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    assert sum(got[k + 100].predicted == (k % 4 == 0) for k in range(400)) == 400
    assert len(got) == 414 and score_toxicity(no_docs, docs, labels).count() == 0
    assert {r.score for r in score_toxicity(test, docs, labels.limit(0)).collect()} == {0.0}


def test_viterbi_is_the_best_path(spark):
    """Against every path of small lattices: substitutions, repeats, marks to skip, spaces to keep or drop."""
    import itertools

    from palimpsest.llm.toxicity import _class_of

    restorer = Restorer(language_model(spark.createDataFrame([(1, "a stupid idiot idea tidy total iota lot toil is so loud a stupid idea " * 20)], "doc_id long, text string")))
    for token, want in (("1d10t", "idiot"), ("id.i*ot", "idiot"), ("stuupid", "stupid"), ("iddiiiot", "idiot"), ("stu pid", "stupid"), ("a s t u p i d", None), ("so l0ud", None), ("tt00ll", None), ("$0!", None)):
        runs = [len(list(itertools.takewhile(lambda c, ch=ch: c == ch, token[k::-1]))) for k, ch in enumerate(token)]
        best = math.inf
        for path in itertools.product(*(Restorer.steps(token, k, runs[k]) for k in range(len(token)))):
            a = b = 0
            cost = 0.0
            for letter, extra in path:
                cost += extra
                if letter:
                    c = _class_of(letter)
                    cost, a, b = cost + restorer.costs[a][b][c], b, c
            cost += restorer.costs[a][b][0]
            text = "".join(x for x, _ in path)
            if text and cost < best - 1e-9:
                best, found = cost, text
        assert restorer.viterbi(token)[0] == found and want in (None, found), (token, found, restorer.viterbi(token)[:3])


def test_urls(spark):
    rules = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))
    cases = {
        "http://a.example.com/en/1": ("a.example.com", "/en/1", "com/en/", "block"),
        "http://EXAMPLE.com/en/71?x=/en/": ("example.com", "/en/71", "example.com/en/7", "allow"),
        "https://badexample.com/en/7": ("badexample.com", "/en/7", "com/en/", "block"),
        "https://x.example.net/de/8#a": ("x.example.net", "/de/8", "example.net/de/8", "block"),
        "https://x.net/de/8": ("x.net", "/de/8", "net/de/", "allow"),
        "https://x.org?/es/": ("x.org", "", None, None),
        "ftp://": ("", "", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
    }
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: r for r in judge_urls(pages, rules).collect()}
    for k, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict or verdict is None and got[k].verdict in ("allow", "block")
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_url_verdicts_against_plain_counts(spark):
    """Every step in plain Python: pieces, splits, counts by class and side, log odds; with repeated ids and long URLs."""
    import re
    from collections import Counter

    from palimpsest.llm.urlfilter import LONGEST_WORD, RULES, best_split

    rng = random.Random(2)
    parts = ["news", "shop", "cheap", "pills", "blog", "cats", "a" * 50, "café"]
    urls = [f"http://{rng.choice(parts)}{rng.choice(parts)}.{rng.choice(['example.com', 'example.net', 'x.org', 'site.io'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(0, 999)}/{rng.choice(parts)}{rng.choice(parts)}" for _ in range(120)]
    urls += ["http://long.site.io/" + "ab" * 300 + "/" + "x/" * 2000, None, "none", urls[0], urls[0]]
    pages = spark.createDataFrame([(k if k < 122 else 0, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = judge_urls(pages).collect()
    runs_of = lambda r: [("h", x) for x in re.findall(r"[^\W\d_]+|\d+", r.host.lower())] + [("p", x) for x in re.findall(r"[^\W\d_]+|\d+", r.path.lower())]
    names = {x for r in got for _, x in runs_of(r) if x.isalpha()}
    pieces = Counter(p for x in names for n in range(2, min(len(x), LONGEST_WORD) + 1) for p in (x[:n], x[-n:]))
    total = sum(pieces.values())
    cut = {x: best_split(x, lambda a, n, x=x: math.log(total) - math.log(pieces[x[a : a + n]]) if x[a : a + n] in pieces else None, total) for x in names}
    words = lambda r: [f"{s}:{w}" for s, x in runs_of(r) for w in (cut[x] if x in cut else [f"#{len(x)}"])]
    count = {"block": Counter(), "allow": Counter()}
    for r in got:
        if r.rule:
            count[r.verdict].update(words(r))
    seen = set(count["block"]) | set(count["allow"])
    n_rows = {v: sum(r.rule is not None and r.verdict == v for r in got) for v in count}
    odds = lambda w: math.log((count["block"][w] + 1) / (count["block"].total() + len(seen) + 1)) - math.log((count["allow"][w] + 1) / (count["allow"].total() + len(seen) + 1)) if w in seen else 0.0
    for r in got:
        score = math.log(n_rows["block"] + 1) - math.log(n_rows["allow"] + 1) + sum(map(odds, words(r)))
        assert r.words == words(r) and abs(r.score - score) < 1e-6
        assert r.rule or r.verdict == ("block" if r.score > 0 else "allow")
    assert len(got) == len(urls) and RULES and {r.verdict for r in got if not r.rule} == {"allow", "block"}


def test_segmentation_is_the_best_split():
    counts = {"cheap": 50, "pills": 40, "pill": 30, "s": 5, "heap": 10, "c": 2}
    s = Segmenter(counts)
    assert s.split("cheappills") == ["cheap", "pills"] and s.split("") == [] and "".join(s.split("zzcheap")) == "zzcheap"
