"""Main text, personal data and URL rules against plain versions."""

from __future__ import annotations

import hashlib
import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from callgauge.llm import html_text, pii, queries, url_rules

SF = "/root/testdata/sf0.001"

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str):
    made = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda digits=digits: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda digits=digits: 10 <= len(digits) <= 15,
            }[kind]()
            if fine:
                made.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(made)]


HARD = [
    (1, None), (2, ""), (3, "a@b.c_d@e.f x@y.z@w.v"), (4, "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 1.2.3.4"),
    (5, "4111 1111 1111 1111 x 4111-1111-1111-1111-1 1 2 3 41111111 11111111"), (6, "+1 (555) 123-4567. +49.30.1234567 +1 +12"),
    (7, "é😀 x@y.de 10.0.0.1 é +49 30 12345678"), (8, "a" * 3000 + " " + "1" * 3000 + " " + "1 2 " * 3000), (9, "a." * 1500 + "@" + "b." * 5_000 + "c"),
    (3, "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432; DE00 3704 0044 0532 0130 00"), (None, "ssn 078-05-1120 and 078-05-1120"),
    (11, "4111  1111 1111 1111 1111"), (12, "0" * 16 + "-" + "00"),
]


def test_pii_equals_plain_version(spark):
    from_file = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    hard = spark.createDataFrame(HARD, "doc_id long, text string")
    docs = from_file.union(hard)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = sorted((str(i), hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in texts)
    rows = pii.report(docs).collect()
    assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == want
    for r in rows:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in pii.BASE_KINDS)
    assert sum(r.spans.count("iban:") for r in rows if r.doc_id == 3) == 2
    assert [r.spans for r in rows if r.doc_id is None] == ["ssn:4:15"]


def made_iban(country: str, length: int) -> str:
    body = "".join(str((7 * i + 3) % 10) for i in range(length - 4))
    moved = "".join(str(int(c, 36)) for c in f"{body}{country}00")
    return f"{country}{98 - int(moved) % 97:02d}{body}"


def test_account_numbers_end_with_their_country_s_length(spark):
    rows, want = [], {}
    for i, (country, length) in enumerate((c, n) for n, codes in pii.IBAN_LENGTHS.items() for c in codes.split()):
        code = made_iban(country, length)
        code = " ".join(code[k : k + 4] for k in range(0, length, 4)) if i % 2 else code
        tail = ("BIC", "2024", "and", "")[i % 4]
        rows.append((i, f"IBAN {code} {tail} {code[:-1]}X."))
        want[i] = f"iban:5:{5 + len(code)}"
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("iban")] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: spans[0] for i, spans in got.items()} == want


def test_pii_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([("a@b.cd", 1, 2, "x")], "text string, _rid int, pii int, kind string")
    row = pii.find(docs).collect()[0]
    assert (row["_rid"], row["kind"], row.pii[0].found, row.pii[0].start, row.pii[0].end) == (1, "x", "a@b.cd", 0, 6)
    assert pii.find(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header>Top</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, many, many, many.</p></div>
<article class="content-with-sidebar"><h1>Title &amp; more</h1><p><b>One,\n two&nbsp;three<br>four<p>Second, <!-- no --> part &lt;x&gt;</p>
<div class="ad-slot"><p>Buy, buy, buy, buy, buy now</p></div><ul><li>Item</li></ul><form><input>Sign</form></article>
<aside>Side, side, side, side</aside><section id="comments"><p>Reader, says, a, lot, of, things, here</p></section><footer>End</footer></body></html>"""


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE, "Title & more\n\nOne, two three four\n\nSecond, part <x>\n\nItem"),
        ("", ""),
        (None, ""),
        ("just text &eacute;", "just text é"),
        ("<p>", ""),
        ("<div>" * 5000 + "<p>deep, text</p>", "deep, text"),
        ("<body><div id=main>Text directly in a container, long enough to count.<br><br>More.</div><div class=sidebar>x</div>", "Text directly in a container, long enough to count. More."),
        ("<script>never", ""),
        ("<article><p>a</p><!-- open <p>b</p>", "a"),
    ],
)
def test_main_text(page, text):
    assert (html_text.main_text(page) if page else "") == text


ROWS = "".join(f"<tr><td>row {i}</td><td>a, b</td><td>{i * i}</td></tr>" for i in range(50))
CELLS = "\n\n".join(f"row {i}\n\na, b\n\n{i * i}" for i in range(50))
ITEMS = "".join(f"<li>item {i}, with some words</li>" for i in range(50))
LISTED = "\n\n".join(f"item {i}, with some words" for i in range(50))


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h1>Title</h1><p>First.</p><table><tbody>{ROWS}</tbody></table><p>Last.</p></article><p>Beside, beside</p>", f"Title\n\nFirst.\n\n{CELLS}\n\nLast."),
        (f"<article><h4>Title</h4><div class=body><ul>{ITEMS}</ul></div><figure><figcaption>Figure</figcaption></figure><div>End</div></article>", f"Title\n\n{LISTED}\n\nFigure\n\nEnd"),
        (f"<main><section><div><blockquote><ol>{ITEMS}</ol></blockquote></div></section><h5>Note</h5></main><div>Out</div>", f"{LISTED}\n\nNote"),
        # Without an article the container around the table stands.
        (f"<body><div id=post><h4>Title</h4><p>First.</p><table>{ROWS}</table></div>", f"Title\n\nFirst.\n\n{CELLS}"),
    ],
)
def test_parts_of_an_article_do_not_replace_it(page, text):
    assert html_text.main_text(page) == text


LONG = "<div class=part>" + "<p>A long, long, long, long, long, long paragraph</p>" * 9 + "</div>"
SHOWN = "\n\n".join(["A long, long, long, long, long, long paragraph"] * 9)


@pytest.mark.parametrize(
    "beside, text",
    [
        ("<div class=part><p>One short paragraph.</p></div>", "One short paragraph."),
        ("<h4>Heading</h4>", "Heading"),
        ("<ul><li>one</li><li>two</li></ul>", "one\n\ntwo"),
        ("<table><tr><td>cell</td></tr></table>", "cell"),
        ("<figure><img src=x><figcaption>Figure</figcaption></figure>", "Figure"),
        ("See <b>this</b> text and <a href=x>that</a> too.", "See this text and that too."),
        ("<ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul>", None),
        ("<a href=x>one</a> <a href=y>two</a>", None),
        ("<div class=sidebar><p>Side</p></div>", None),
    ],
)
def test_short_neighbours_of_the_best_container_stay(beside, text):
    assert html_text.main_text(f"<body>{beside}{LONG}</body>") == (f"{text}\n\n{SHOWN}" if text else SHOWN)
    assert html_text.main_text(f"<body>{LONG}{beside}</body>") == (f"{SHOWN}\n\n{text}" if text else SHOWN)


PROSE = "A long paragraph of the article, with commas, and more words, so that it gets points."


@pytest.mark.parametrize("page, text", [
    (f"<article><h1>T</h1><p>{PROSE}</p><section id='discussion'><h2>D</h2><p>{PROSE}</p></section></article>", ["T", PROSE, "D", PROSE]),
    (f"<article><h1>T</h1><p>{PROSE}</p><h2 id='side-effects'>S</h2><p>{PROSE}</p></article>", ["T", PROSE, "S", PROSE]),
    (f"<div id='copyright-law-explained'><h1>T</h1><p>{PROSE}</p></div><div><p>Other words</p></div>", ["T", PROSE, "Other words"]),
    (f"<form action='x'><input name='v'><div><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div><button>go</button></form>", ["T", PROSE, PROSE]),
    (f"<form><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><label>L</label></form>", [PROSE] * 3),
    (f"<header><h1>Site</h1></header><article><header><h1>T</h1><p>by me</p></header><p>{PROSE}</p></article>", ["T", PROSE]),
    # What readers write, notices and forms go, however much prose they hold.
    (f"<article><h1>T</h1><p>{PROSE}</p><div id='comments'><article class='comment'><p>{PROSE * 9}</p></article></div></article>", ["T", PROSE]),
    (f"<div class='content'><p>{PROSE}</p></div><section id='comments'><p>{PROSE * 20}</p></section>", [PROSE]),
    (f"<div class='header'><h1>Site</h1></div><div><p>{PROSE}</p></div><div id='cookie-notice'><p>{PROSE}</p></div>", [PROSE]),
    (f"<article><h1>T</h1><p>{PROSE}</p></article><form><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></form>", ["T", PROSE]),
    (f"<section id='discussion'><p>{PROSE}</p></section><article><p>{PROSE} 2</p></article>", [f"{PROSE} 2"]),
])
def test_words_of_an_id_do_not_decide_against_the_article(page, text):
    assert html_text.main_text(f"<body>{page}</body>") == "\n\n".join(text)


def made_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page of a known article among parts that are not it, with ids, forms and wrappers at random."""
    prose = lambda: " ".join(rng.choice(("river", "stone", "light,", "paper", "green", "walks")) for _ in range(rng.randint(25, 60)))
    slug = lambda: rng.choice(("side-effects", "legal-history", "ad-hoc-methods", "tags-of-old", "share-prices", "x1"))
    body, blocks = [], []
    for _ in range(rng.randint(2, 6)):
        kind, text = rng.choice(("p", "p", "h2", "list", "section", "quote")), prose()
        if kind == "h2":
            body.append(f'<h2 id="{slug()}">{text}</h2>')
        elif kind == "list":
            body.append(f"<ul><li>{text}</li><li>{text} 2</li></ul>")
            text = (text, f"{text} 2")
        elif kind == "section":
            body.append(f'<section id="{rng.choice((slug(), "discussion", "legal", "feedback"))}"><h3>About</h3><p>{text}</p></section>')
            text = ("About", text)
        else:
            body.append(f"<p>{text}</p>" if kind == "p" else f"<blockquote><p>{text}</p></blockquote>")
        blocks += text if isinstance(text, tuple) else (text,)
        if rng.random() < 0.3:
            body.append(rng.choice((f'<aside>{prose()}</aside>', f'<div class="ad">{prose()}</div>', f'<div class="share-buttons"><a href="#">s</a></div>')))
    title = prose()
    head = f"<header><h1>{title}</h1><p>by a writer</p></header>" if rng.random() < 0.5 else f"<h1>{title}</h1>"
    page = f'<article id="{slug()}">{head}{"".join(body)}</article>'
    if rng.random() < 0.5:
        page = f'<div id="{slug()}">{page}</div>'
    page += f'<div id="comments"><div class="comment"><p>{prose()}</p></div><form><p>{prose()}</p></form></div>' if rng.random() < 0.5 else ""
    page = f"<nav><ul><li><a>{prose()}</a></li></ul></nav><header><h2>Site</h2></header>{page}<footer><p>{prose()}</p></footer>"
    if rng.random() < 0.4:
        page = f"<form action='/p'><input type='hidden'>{page}</form>"
    return f"<html><head><title>{title}</title></head><body>{page}</body></html>", [title, *blocks]


def test_random_pages_give_their_article():
    rng = random.Random(11)
    for _ in range(300):
        page, blocks = made_page(rng)
        assert html_text.main_text(page) == "\n\n".join(blocks), page


@pytest.mark.parametrize("page", [
    *["<body>" + f"<{kind}>" * 20_000 + PROSE + f"</{kind}>" * 20_000 for kind in ("blockquote", "div", "b", "ul", "section")],
    "<b><p>" + "<i>" * 20_000 + "</b>" * 20_000 + "<p>x" * 20_000,
    "<ul>" + "<li><b>a, b" * 20_000,
])
def test_main_text_is_linear_in_deep_pages(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5  # a walk of every subtree takes minutes


def test_main_text_of_nulls_repeats_and_clashing_names(spark):
    page = f"<article><p>{PROSE}</p></article>"
    rows = [(1, None, "a", 7), (2, "", "b", 7), (3, page, "c", 7), (3, page, "c", 7), (None, "<p>", "d", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("3", PROSE, len(PROSE)), ("3", PROSE, len(PROSE)), ("None", "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_main_text_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.queries()["op2_main_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def plain_judgement(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_rules.HAND_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


URLS = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?y#z", "https://net", "https://net/", "x://de.example.com/de/a/b", "http://example.com?de=/de/",
        "http://a.org/fr/1", "http://org/fr", "http://fr.org#/fr/", "http://internet/", "://x.net/a\nb", "http://a://b.net/en/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(URLS)] + [(None, "https://b.net/", "e"), (1, "", "e")], "page_id long, url string, mined string")
    for r, (i, u, _) in zip(sorted(url_rules.judge(pages).collect(), key=lambda r: str(r.page_id)), sorted(pages.collect(), key=lambda r: str(r[0])), strict=True):
        host, path, rule, verdict = plain_judgement(u)
        assert (r.page_id, r.host, r.path, r.rule) == (i, host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_mined_rules_match_brute_force(spark):
    urls = [(f"http://h{i % 5}.x/{'bad' if i % 3 == 0 else 'good'}/{'p' if i % 2 else 'q'}", i % 3 == 0 and i % 2 == 1) for i in range(300)]
    frame = spark.createDataFrame(urls, "url string, blocked boolean")
    labelled = frame.select(url_rules.tokens(F.col("url")).alias("tokens"), "blocked")
    rules = url_rules.mine(labelled, 0.01, 0.9).collect()
    assert {tuple(r.antecedent) for r in rules} == {("path:bad", "path:p")}
    assert rules[0].confidence == 1.0 and rules[0].support == pytest.approx(50 / 300)
    hits = url_rules.apply(frame, url_rules.mine(labelled, 0.01, 0.9)).collect()
    assert all((len(r.mined) > 0) == r.blocked for r in hits)


def test_tokens_that_go_together_are_mined_as_one(spark):
    deep = "/".join(f"part{chr(97 + i)}" for i in range(26)) + "/xa/xb/xc/xd"
    urls = [(f"http://h{i % 7}.x/{deep if i % 3 == 0 else 'good'}", i % 3 == 0) for i in range(210)]
    frame = spark.createDataFrame(urls, "url string, blocked boolean")
    labelled = frame.select(url_rules.tokens(F.col("url")).alias("tokens"), "blocked")
    rules = url_rules.mine(labelled, 0.01, 0.9)
    held = rules.collect()  # 30 tokens always together: unmerged, more than a billion frequent sets
    assert {tuple(r.antecedent) for r in held} == {("path:parta",)} and len(held) == 30
    assert {r.key for r in held} == set(held[0].members[0]) and {r.confidence for r in held} == {1.0}
    # A URL with any one of them is met, as by a rule on that token alone.
    asked = spark.createDataFrame([("http://z.y/xc", 1), ("http://z.y/partz/xa", 2), ("http://z.y/good", 3), (None, 4)], "url string, mined int")
    got = {r.url: len(r.mined) for r in url_rules.apply(asked, rules).collect()}
    assert got == {"http://z.y/xc": 1, "http://z.y/partz/xa": 1, "http://z.y/good": 0, None: 0}
    assert url_rules.mine(labelled.limit(0)).count() == 0


def test_pii_is_linear_in_long_runs(spark):
    text = "a" * 300_000 + " " + "1" * 300_000 + " " + "1 2 " * 100_000 + "a." * 100_000
    assert pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0].spans == ""
