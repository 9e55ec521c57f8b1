"""Pages with declarations and link lists are read to their end."""

import pytest

from barloom.llm.html_extract import extract_text


@pytest.mark.parametrize("odd", ["<![foo[ x ]]>", "<![ x ]>", "<![if !IE]>", "<![endif]>", "<![CDATA[ x ]]>", "<![]>"])
def test_unknown_declaration(odd):
    assert extract_text(f"<p>a</p>{odd}<p>b</p>") == "a\nb"


def test_stray_declaration():
    assert extract_text("<p>a</p><p>stray <![b c</p><p>d</p>").startswith("a\nstray")
    assert extract_text("<p>a</p><p>stray <![b c</p><p>d</p>").endswith("d")


def test_unfinished_declaration():
    assert extract_text("<p>a</p><p>b</p><![b c").startswith("a\nb")


def test_links_in_article():
    items = "".join(f"<li><a href='/{i}'>Source number {i}</a></li>" for i in range(4))
    page = f"<nav><ul>{items}</ul></nav><article><p>{'Some words. ' * 20}</p><ul>{items}</ul></article>"
    assert extract_text(page).count("Source number") == 4


TEXT = "long running text of the story " * 6


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # Names suggest, text decides.
        (f"<body><div class='ad-free content'><p>{TEXT}</p><p>{TEXT}</p></div></body>", f"{TEXT.strip()}\n{TEXT.strip()}"),
        (f"<body><div class='article social'><p>{TEXT}</p><p>end</p></div><div class=social>Follow us</div></body>", f"{TEXT.strip()}\nend"),
        (f"<body><article><p>{TEXT}</p><div class='ad-box'>Buy it</div><p>end</p></article></body>", f"{TEXT.strip()}\nend"),
        (f"<body><article><p>{TEXT}</p></article><div class=comments><p>{TEXT[:40]}</p></div></body>", TEXT.strip()),
        # Link lines at the borders of an article go, plain short lines stay.
        (f"<article><p><a>Share this</a></p><h1>Head</h1><p>{TEXT}</p><p>Short.</p><p><a>More stories here</a></p></article>", f"Head\n{TEXT.strip()}\nShort."),
        (f"<article><h1><a>Linked head</a> by me, the one and only author</h1><p>{TEXT}</p></article>", f"Linked head by me, the one and only author\n{TEXT.strip()}"),
    ],
)
def test_ratios_decide(html, text):
    assert extract_text(html) == text


def test_linear_in_depth():
    import time
    import tracemalloc

    def cost(n):
        page = "<div>x" * n + "</b>" * n
        tracemalloc.start()
        began = time.perf_counter()
        assert extract_text(page).count("x") >= 0.75 * n
        took, (_, peak) = time.perf_counter() - began, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        return took, peak

    (_, small), (took, large) = cost(2000), cost(16000)
    assert large < 12 * small and took < 30


COMMENT = "I read this with great interest and I must say that my own view is another one altogether. " * 8


@pytest.mark.parametrize("thread", ["<section id='comments'>{}</section>", "<ol class='commentlist'>{}</ol>", "<div class='comments-area'>{}</div>", "<div id='disqus_thread'>{}</div>"])
@pytest.mark.parametrize("outer", ["<main>{}</main>", "<body><div class=page>{}</div></body>", "<article>{}</article>"])
def test_comments_go_whatever_their_share(thread, outer):
    said = "".join(f"<div class=entry><p>{COMMENT}</p></div>" for _ in range(3))
    page = outer.format("<h1>A head</h1><p>The lead is short.</p><p>" + TEXT + "</p>" + thread.format(said))
    assert extract_text(page) == f"A head\nThe lead is short.\n{TEXT.strip()}"


def test_repeated_articles_in_an_article_are_comments():
    inner = f"<article><p>{COMMENT}</p></article>" * 3
    assert extract_text(f"<article><h1>Head</h1><p>{TEXT}</p>{inner}</article>") == f"Head\n{TEXT.strip()}"
    # With no text of its own before them, an article's articles are its parts.
    assert extract_text(f"<article>{inner}</article>").count("great interest") == 24


def test_content_that_is_only_called_comment():
    page = f"<body><div class='comment'><h1>Opinion</h1><p>{TEXT}</p></div><footer>x</footer></body>"
    assert extract_text(page) == f"Opinion\n{TEXT.strip()}"
    assert "Opinion" in extract_text(f"<body><div class='no-comments'><h1>Opinion</h1><p>{TEXT}</p></div></body>")


@pytest.mark.parametrize("page", ["<p><td>{spans}{rules}", "<ul><li>{spans}{items}", "<table><tr><td>{spans}{cells}"])
def test_linear_where_many_elements_stay_open(page):
    import time

    def cost(n):
        html = page.format(spans="<span>" * n, rules="<hr>" * n, items="<ol><li>" * n, cells="<p>x" * n)
        began = time.perf_counter()
        extract_text(html)
        return time.perf_counter() - began

    small, large = min(cost(4000) for _ in range(3)), cost(32_000)
    assert large < 40 * small
