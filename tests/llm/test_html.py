"""Page extraction trained on one kind of pages and tested on hand-made pages of other kinds."""

import random

import pytest

from tallyforge.llm import html_text

SAY = "Some words that make a sentence, and more of it."
NAV = "<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 Example. All rights reserved.</footer>"


def plain_page(seed: int, wrap: str = "article") -> tuple[str, str]:
    """A menu, an advert, an article of a title and paragraphs, a footer: no list, quote, table, form, comment or sidebar."""
    rng = random.Random(seed)
    say = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(n))
    title, body = say(rng.randrange(2, 7)), [say(rng.choice([3, 8, 20, 60])) + rng.choice([".", "."]) for _ in range(rng.randrange(1, 9))]
    nav = "".join(f'<li><a href="/x">{say(1)}</a></li>' for _ in range(6))
    html = f'<html><body><nav><ul>{nav}</ul></nav><div class="ad">{say(7)}.</div><{wrap}><h1>{title}</h1>' + "".join(f"<p>{b}</p>" for b in body) + f"</{wrap}><footer>&copy; {say(5)}</footer></body></html>"
    return html, "\n".join([title, *body])


CASES = {
    "list": (f"<article><h1>Title</h1><p>{SAY}</p><ul><li>One item</li><li>Two item</li></ul></article>", f"Title\n{SAY}\nOne item\nTwo item"),
    "comments after": (f"<article><h1>Title</h1><p>{SAY}</p></article><section class='comments'><p>{SAY} Nice.</p></section>", f"Title\n{SAY}"),
    "menu and footer": (f"<html><body>{NAV}<article><h1>Title here</h1><p>{SAY}</p><ul><li>One item</li><li>Two item</li></ul><p>{SAY}</p></article>{FOOT}</body></html>", f"Title here\n{SAY}\nOne item\nTwo item\n{SAY}"),
    "comments by id": (f"<article><h1>T</h1><p>{SAY}</p></article><div id='comments'><p>{SAY} x</p></div>", f"T\n{SAY}"),
    "form inside": (f"<article><h1>T</h1><p>{SAY}</p><form><p>Your mail</p></form><p>{SAY}</p></article>", f"T\n{SAY}\n{SAY}"),
    "related inside": (f"<article><h1>T</h1><p>{SAY}</p><aside class='related'><p>See also</p></aside><p>{SAY}</p></article>", f"T\n{SAY}\n{SAY}"),
    "aside beside": (f"<body><article><h1>T</h1><p>{SAY}</p></article><aside><p>{SAY}</p></aside></body>", f"T\n{SAY}"),
    "plain divs": (f"<body>{NAV}<div class=content><h1>Title</h1><p>{SAY}</p><p>{SAY}</p></div><div class='sidebar'><p>{SAY}</p></div>{FOOT}</body>", f"Title\n{SAY}\n{SAY}"),
    "table and quote": (f"<body>{NAV}<article><h1>T</h1><p>{SAY}</p><table><tr><td>a</td><td>b</td></tr></table><blockquote>{SAY}</blockquote></article>{FOOT}</body>", f"T\n{SAY}\na\nb\n{SAY}"),
    "notice": (f"<body><div class='cookie-notice'><p>We use cookies.</p></div>{NAV}<main><h1>T</h1><p>{SAY}</p></main>{FOOT}</body>", f"T\n{SAY}"),
    "headers": (f"<body><header><h1>Site</h1><p>{SAY}</p></header><main><article><header><h1>T</h1></header><p>{SAY}</p></article></main>{FOOT}</body>", f"T\n{SAY}"),
    "named wrapper": (f"<body><div class='page has-sidebar'><div class=content><h1>Title</h1><p>{SAY}</p><p>{SAY}</p></div></div></body>", f"Title\n{SAY}\n{SAY}"),
    "definitions": (f"<body>{NAV}<main><div><h2>S</h2><ol><li><p>{SAY}</p></li><li>{SAY}</li></ol><dl><dt>k</dt><dd>{SAY}</dd></dl><pre>code x</pre></div></main>{FOOT}</body>", f"S\n{SAY}\n{SAY}\nk\n{SAY}\ncode x"),
    "one paragraph": (f"<article><p>{SAY}</p></article>", SAY),
    "links": (f"<body>{NAV}<article><h1>T</h1><ul><li><a href=x>first link</a></li><li><a href=y>second</a></li></ul><p>{SAY}</p></article>{FOOT}</body>", f"T\nfirst link\nsecond\n{SAY}"),
    "entry header": (f"<article><div class='entry-header'><h1>T</h1></div><p>{SAY}</p></article>", f"T\n{SAY}"),
}


@pytest.fixture(scope="module")
def model():
    return html_text.train([plain_page(i)[0] for i in range(300)])


@pytest.mark.parametrize("case", CASES)
def test_hand_made_pages(model, case):
    html, want = CASES[case]
    assert html_text.extract(model, [html]) == [want]


def test_pages_of_the_kind_learned_from(model):
    """Also with divs or ``main`` in place of ``article``."""
    for wrap, least in (("article", 100), ("main", 100), ("div", 97)):
        made = [plain_page(1000 + i, wrap) for i in range(100)]
        got = html_text.extract(model, [h for h, _ in made])
        assert sum(g == w for g, (_, w) in zip(got, made, strict=True)) >= least, wrap


def test_what_names_say():
    said = lambda h: [b.said for b in html_text.leaf_blocks(h)]
    assert said("<div class=has-sidebar>t</div>") == ["none"] and said("<div class=left-sidebar>t</div>") == ["beside"]
    assert said("<article><div class=entry-header>t</div></article>") == ["main"] and said("<div class=page-header>t</div>") == ["beside"]


def test_training_pages_are_chosen_by_hash_and_bounded(spark):
    rows = [(i, plain_page(i)[0]) for i in range(40)] + [(99, "<article>" + "x" * 200_000 + "</article>"), (3, plain_page(3)[0]), (100, None)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    one, two = (html_text.fit_extractor(df.repartition(n), 25).weights for n in (1, 6))
    assert (one == two).all()
