"""Articles in several branches of a page, and class names that only contain a marker word."""

from __future__ import annotations

import pytest

from readloom.llm import html


def section(name, n=5, link=""):
    return "<section>" + "".join(f"<p>{name}{i} " + "words of text that go on " * 16 + link + "</p>" for i in range(n)) + "</section>"


MENU = "<ul>" + "".join(f"<li><a href=/{i}>Entry {i}</a>" for i in range(12)) + "</ul>"


@pytest.mark.parametrize("link", ["", "<a href=x>linked word</a>"])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_sibling_sections_are_one_article(n, link):
    for page in ("<body><div>{}</div><div>{}</div></body>", "<body>{}{}</body>", "<body><div><h1>Head of all</h1>{}</div>{}</body>"):
        got = html.main_text(page.format("".join(section(f"part{k}n", link=link) for k in range(n)), MENU))
        assert [w for w in got.split() if w.startswith("part")] == [f"part{k}n{i}" for k in range(n) for i in range(5)]
        assert "Entry" not in got
        assert ("Head of all" in got) == ("<h1>" in page)


@pytest.mark.parametrize("page", ["<body><main>{}</main></body>", "<body>{}</body>", "<body><main><div>{}</div></main></body>"])
def test_articles_side_by_side(page):
    parts = "".join(f"<article>{section(f'art{k}n', n)}</article>" for k, n in enumerate((5, 3, 4)))
    teaser = "<article><a href=/a>Entry of another page with a long name</a></article>"
    comment = f'<article class="comment">{section("said")}</article>'
    got = html.main_text(page.format(MENU + parts + teaser + comment))
    assert [w for w in got.split() if w.startswith("art")] == [f"art{k}n{i}" for k, n in enumerate((5, 3, 4)) for i in range(n)]
    assert "Entry" not in got and "said0" not in got


def test_nested_branches_and_a_sparse_one_between():
    page = f"<body><div><div>{section('left')}</div>{MENU}<div><div>{section('right', 2)}</div></div></div></body>"
    got = html.main_text(page)
    assert [w for w in got.split() if w.startswith(("left", "right"))] == [f"left{i}" for i in range(5)] + ["right0", "right1"]
    assert "Entry" not in got


@pytest.mark.parametrize("name", ["content has-sidebar", "side-by-side", "no-comments", "article-header-content", "page-with-sidebar", "content-sidebar-wrap"])
def test_names_that_contain_a_marker(name):
    assert "own0" in html.main_text(f'<body><div class="{name}">{section("own")}</div></body>')


@pytest.mark.parametrize("name", ["sidebar", "x sidebar", "cookie-notice", "site-footer", "comment-list", "share_buttons", "nav-menu", "ad-300-250", "widget-area"])
def test_names_that_mark(name):
    assert html.main_text(f'<body><div class="{name}">{section("bad")}</div><div>{section("own")}</div></body>').startswith("own0")
    assert "bad0" not in html.main_text(f'<body><div id="{name.split()[-1]}">{section("bad")}</div><div>{section("own")}</div></body>')
