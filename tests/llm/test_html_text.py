import html
import random
import re

from memloom.llm.html_text import main_text

FILL = "A sentence of some length, with a comma or two, that reads like running text. "


def test_given_pages(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert main_text(r.html) == "\n".join(x for x in want if x)


def test_leaves_out_what_is_no_text():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h2>Site name</h2></header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice"><p>{FILL}</p></div><div id=main><div class="post"><h1>Head &amp; title</h1><p>{FILL * 3}</p><ul><li>one<li>two</ul><p>Short &lt;end&gt;
    of it</p><div class="advert"><p>{FILL}</p></div><form><p>Subscribe</p></form></div><div id="comments"><p>{FILL * 2}</p></div></div><aside><p>{FILL}</p></aside><footer>&copy; x</footer>"""
    text = " ".join(FILL.split())
    assert main_text(page) == "\n".join(["Head & title", " ".join([text] * 3), "one", "two", "Short <end> of it"])


def test_names():
    from memloom.llm.html_text import HEADER, HINT, NO_TEXT, PLAIN, READER, named

    want = {"post-comments": (READER, False), "comment-body": (READER, False), "has-sidebar": (PLAIN, False), "post-content": (PLAIN, True), "content sidebar": (NO_TEXT, True), "page-header": (HEADER, False), "lead": (PLAIN, False), "cookie_text": (NO_TEXT, False), "main": (PLAIN, True), "share-price": (HINT, False), "shareButtons": (NO_TEXT, False), "legal-analysis": (PLAIN, False), "side-effects": (PLAIN, False), "article-header": (PLAIN, True), "byline": (PLAIN, False), "ad-slot-300x250": (NO_TEXT, False)}
    assert {x: named(x) for x in want} == want


def test_names_are_evidence():
    text = " ".join(FILL.split())
    body = f"<p>{FILL * 2}</p><p>{FILL}</p>"
    two = f"{text} {text}\n{text}"
    inside = {f'<p class="share-price">{FILL}</p>': text, f'<section class="legal-analysis"><p>{FILL}</p></section>': text, f'<div class="side-effects"><p>{FILL}</p></div>': text, f'<p class="byline">{FILL}</p>': text, "<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>": "so x=2 holds", f'<ul class="tags"><li>{FILL}</li></ul>': text, '<div class="share-buttons"><a href=x>Share</a></div>': "", f'<div class="cookie-notice">{FILL}</div>': "", f'<div class="related-posts"><p>{FILL}</p></div>': "", '<div class="ad-xyz">Buy now</div>': ""}
    for extra, want in inside.items():
        assert main_text(f"<body><article>{body}{extra}{body}</article></body>") == "\n".join(x for x in (two, want, two) if x), extra
    assert main_text(f'<body><div class="article-header"><h1>Title</h1></div><div class="article-body">{body}</div></body>').startswith(("Title", text))
    assert main_text(f'<body><article><div class="article-header"><h1>Title</h1></div>{body}</article></body>') == f"Title\n{two}"
    assert main_text(f'<body><div class="modal">{body * 3}</div><p>x</p></body>').startswith(two)
    assert main_text(f'<body><article>{body}</article><div id="comments">{body * 9}</div></body>') == two


def test_only_whole_attribute_names_count():
    body = f"<p>{FILL}</p>"
    text = " ".join(FILL.split())
    inline = ['<a href="/hidden-gems">the hidden gems</a>', '<em title="a hidden thing">the hidden gems</em>', '<a href="/p?id=comments">the hidden gems</a>', '<a data-role="navigation">the hidden gems</a>', "<a href=/x?class=menu>the hidden gems</a>", '<b title="x" data-hidden>the hidden gems</b>', "<i title='style=\"display:none\"'>the hidden gems</i>"]
    for x in inline:
        assert main_text(f"<article>{body}<p>These are {x}, they say.</p>{body}</article>") == f"{text}\nThese are the hidden gems, they say.\n{text}", x
    for x in ('<section data-state="was-hidden">', '<div data-hidden="false">', '<div aria-hidden="false">', '<section data-id="menu" lang=en>', '<div class="lead" class="sidebar">'):
        assert main_text(f"<article>{body}{x}{body}</section></div></article>") == f"{text}\n{text}", x
    assert main_text(f'<article>{body}<p data-id="menu">Kept, as it is.</p></article>') == f"{text}\nKept, as it is."
    for x in ("<div hidden>", '<div  HIDDEN = "">', '<div data-x="y"hidden>', "<div style='color:red; display : none'>", '<div aria-hidden = "true">', "<div title='a' role=navigation>"):
        assert main_text(f"<article>{body}{x}{body}</div></article>") == text, x


def test_random_attributes_around_known_text():
    rng = random.Random(6)
    names = ["href", "title", "data-id", "data-class", "data-hidden", "xclass", "id2", "alt", "onclick", "my-style", "roles", "src"]
    values = ["hidden", "menu", "id=comments", "class='nav'", "role=navigation", "style=display:none", "a hidden id", "/x?id=sidebar&class=ads", ""]

    def attributes():
        out = []
        for name in rng.sample(names, rng.randint(0, 4)):
            value = rng.choice(values)
            out.append(rng.choice([f"{name}", f'{name}="{value}"', f"{name} = '{value.replace(chr(39), '')}'", f"{name}={value.split(' ')[0] or 'x'}"]))
        return " ".join(out)

    for _ in range(200):
        page = "".join(f"<div {attributes()}><p {attributes()}>{i} {FILL} <a {attributes()}>link</a> end.</p></div>" for i in range(3))
        assert main_text(f"<article>{page}</article>") == "\n".join(f"{i} {' '.join(FILL.split())} link end." for i in range(3)), page


def test_references_end_with_their_text():
    assert main_text("<article><p>a &am<b></b>p; b &amp; c &lt;i&gt; &#233; &nbsp; d</p></article>") == "a &amp; b & c <i> é d"


def test_a_very_long_page():
    n = 20_000
    page = "<body><nav><a href=x>m</a></nav><div id=content>" + "".join(f"<p class='x{i}>odd' title=\"y\">{i} {FILL}</p>" for i in range(n)) + "</div></body>"
    got = main_text(page).split("\n")
    assert len(got) == n and got[-1] == f"{n - 1} " + " ".join(FILL.split())


def test_containers_without_article():
    p = lambda n: f"<p>{n} {FILL}</p>"
    text = " ".join(FILL.split())
    assert main_text(f"<div><div>{p(1)}{p(2)}</div><div>{p(3)}</div></div><div class=post-comments>{p(7)}{p(8)}{p(9)}</div>") == f"1 {text}\n2 {text}\n3 {text}"
    assert main_text(f"<table><tr><td><a href=x>menu</a> <a href=y>more of the menu</a></td><td>{p(1)}{p(2)}</td></tr></table>") == f"1 {text}\n2 {text}"
    assert main_text(f"<article>{p(1)}</article><div class='related posts'>{p(7)}</div><article>{p(2)}</article>") == f"1 {text}\n2 {text}"


def test_broken_markup():
    assert main_text("<p>open <b>bold") == "open bold"
    assert main_text("plain text") == "plain text"
    assert main_text("</p></div><<<>>") == "<<<>>"
    assert main_text(f"<article><p>{FILL}<p>{FILL}<script>var a='</p>';</script></article>").count("\n") == 1
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 2000) == "deep"
