import itertools
import random
import time

import pytest

from parley.llm import html_extraction as op

STORY = "<h1>A title &amp; more</h1><p>The first paragraph is long enough, and has commas.<p>Second &eacute;<br>line &nbsp; here."
WANT = "A title & more\n\nThe first paragraph is long enough, and has commas.\n\nSecond é line here."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>{STORY}</article><footer>&copy; x</footer>",
        f"<body><header><a href='/a>b'>Logo</a></header><main>{STORY}<aside>See also this.</aside><form><p>Your name</p><button>Go</button></form></main></body>",
        f"<div class='cookie-notice'>We use cookies, as all do.</div><div id=main-content>{STORY}</div><div class=sidebar><p>Popular now, and before.</p></div>",
        f"<article>{STORY}<div class=ad>Buy this now, it is cheap.</div><section id=comments><p>Great post, thank you for it all.</p></section></article>",
        f"<article><script>var t='</p><p>not text';</script><!-- <p>no</p> -->{STORY}<p hidden>secret</p><p style='display: none'>gone</p></article><div role=navigation>Next</div>",
        f"<body class='page has-sidebar no-comments'><div class='ad-container'>Buy it, it is cheap, and good.</div><div class='page-wrapper'><div class='entry-content'>{STORY}</div></div><div class='sidebar-wrapper'>Most read, this week.</div></body>",
        f"<article><header class='post-header'><h1>A title &amp; more</h1></header>{STORY.split('</h1>')[1]}<div class='comment no-print'>I agree, and so should you.</div></article>",
        f"<ARTICLE>{STORY}</ARTICLE><DIV CLASS='Newsletter Signup'>Subscribe to our list, it is free.</DIV>",
    ],
)
def test_articles(page):
    assert op.main_text(page) == WANT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p><span class='notice'>Note:</span> The long text of an article, with commas.</p></article>", "The long text of an article, with commas."),
        ("<article><h2><a class='anchor' aria-hidden='true'>#</a>Title</h2></article>", "Title"),
        ("<article><p><span style='display:none'>x</span>Visible text<b class='ad'> Buy</b>, and more.</p></article>", "Visible text, and more."),
        ("<article><ul><li><i hidden>1</i> First item, of two.</li></ul></article>", "First item, of two."),
        ("<article><p><span class='ad'>Buy it.</span></p><p>The text.</p></article>", "The text."),
    ],
)
def test_inline_elements_do_not_decide_for_their_block(page, want):
    assert op.main_text(page) == want


PROSE = "The city council met on Monday, and after a long debate, it agreed to the plan. Work begins in spring, the mayor said; it will take two years, and cost less than was feared. " * 4


@pytest.mark.parametrize(
    ("page", "kept", "gone"),
    [
        (f"<article class='post tag-social'>{STORY}</article><footer>Imprint</footer>", WANT, "Imprint"),
        (f"<article class='category-banner'>{STORY}</article><nav>Menu</nav>", WANT, "Menu"),
        (f"<div id='wrapper' class='page sidebar-right'><article>{STORY}</article><div class='sidebar'>Popular now</div></div>", WANT, "Popular"),
        (f"<form id='aspnetForm'><div id='nav'>Home</div><div class='content'>{STORY}</div></form>", WANT, "Home"),
        (f"<form id='aspnetForm'><nav>Home</nav><div><p>{PROSE}</p><p>{PROSE}</p></div></form>", PROSE.strip(), "Home"),
        (f"<div class='promo-page'><p>{PROSE * 3}</p><p>{PROSE * 3}</p></div><nav>Home</nav>", PROSE.strip(), "Home"),
        (f"<article>{STORY}</article><div id='comments'><article class='comment-body'><p>Great post, thank you.</p></article></div>", WANT, "Great"),
        (f"<article>{STORY}</article><nav><div class='x' hidden><main>Not shown</main></div></nav>", WANT, "Not shown"),
    ],
)
def test_one_class_word_or_a_form_does_not_decide_for_a_page(page, kept, gone):
    text = op.main_text(page)
    assert kept in text and gone not in text


@pytest.mark.parametrize("name", ["legal-history", "related-work", "share-price", "warning", "skip"])
def test_a_doubtful_name_does_not_drop_a_section(name):
    page = f"<article><h1>Title</h1><p>{PROSE}</p><section class='{name}'><p>{PROSE.upper()}</p></section></article><section class='comments'><p>{PROSE.lower()}</p></section>"
    assert op.main_text(page) == f"Title\n\n{PROSE.strip()}\n\n{PROSE.upper().strip()}"


def test_the_cut_decides_against_a_block_alone():
    """Short pieces among long ones follow them, on both sides; by their own costs they would not."""
    page = f"<div><p>{PROSE}</p><p>Ok</p><p>{PROSE}</p></div><div>{'<span><a href=x>Link</a></span><li><a href=y>Other link</a></li>' * 4}<p>And so on.</p></div>"
    found = op.blocks(page)
    gain, edges = op.costs(found, op.START)
    cut = op.minimum_cut(gain, edges)
    assert [g >= 0 for g in gain] != cut and cut[:3] == [True] * 3 and gain[1] < 0


def test_large_and_nested_pages():
    """Time and memory grow with the page alone."""
    for page in ("<div>x, y " * 40_000, '<p a="x ' * 20_000, "<b>x" * 100_000, ("<div>" * 50 + "hello there, you</div>" * 50) * 100):
        began = time.perf_counter()
        op.main_text(page)
        assert time.perf_counter() - began < 20


def test_pages_without_structure():
    assert op.main_text("Just a text, without any element. It stays.") == "Just a text, without any element. It stays."
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8))
    assert op.main_text(f"<div><ul>{links}</ul></div><div><p>This is a paragraph of some length, with commas, and a stop.</p><p>This is another one, and it is long enough too.</p></div>") == "This is a paragraph of some length, with commas, and a stop.\n\nThis is another one, and it is long enough too."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<p attr=\"x", "</p></p>", "<!-- open", "<script>never closed", "a < b", "<a><b><c>", "&#xD800;&#99999999;&bogus;", "<p>" * 3000, "<b>" * 3000 + "x"])
def test_broken_markup_does_not_crash(page):
    assert isinstance(op.main_text(page), str)


def test_cut_equals_brute_force():
    draw = random.Random(4)
    for _ in range(60):
        n = draw.randint(1, 8)
        gain = [draw.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, draw.randint(0, 6)) for a, b in itertools.combinations(range(n), 2) if draw.random() < 0.5]

        def cost(side, gain=gain, edges=edges):
            return sum(g for g, s in zip(gain, side, strict=True) if g > 0 and not s) - sum(g for g, s in zip(gain, side, strict=True) if g < 0 and s) + sum(c for a, b, c in edges if side[a] != side[b])

        assert cost(op.minimum_cut(gain, edges)) == min(cost(s) for s in itertools.product([False, True], repeat=n))


def test_smoothness_changes_labels():
    """A short block between long ones is taken along."""
    found = op.blocks("<div><p>A long paragraph of text, with commas, that goes on and on. It has sentences.</p><p>Ok</p><p>Another long paragraph, again with commas, and it goes on. And on.</p></div>")
    assert op.label(found, op.START) == [True, True, True]
    assert op.label(found[1:2], op.START) == [False]


def test_table(spark):
    rows = [(1, "u", f"<article>{STORY}</article><nav>Menu</nav>", "x", "y"), (1, "u", f"<article>{STORY}</article><nav>Menu</nav>", "x", "y"), (2, None, None, None, None), (None, "v", "<p>Some words here, I think so.</p>", None, None), (3, "w", "<article><p>" + "long text, " * 20_000 + "</article>", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = op.extract(pages, op.train(pages)).collect()
    assert len(got) == 5
    assert [r.text for r in got if r.page_id == 1] == [WANT] * 2 and next(r for r in got if r.page_id == 2).text == ""
    assert all(r.n_chars == len(r.text) for r in got) and next(r for r in got if r.page_id == 3).n_chars > 200_000
    assert op.extract(pages.limit(0), op.train(pages.limit(0))).count() == 0
