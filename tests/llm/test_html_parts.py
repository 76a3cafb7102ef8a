"""Articles in several parts, on pages with and without article or main."""

import pytest

from jobloom.llm import html_text


def paragraphs(word):
    return "".join(f"<p>{word} {k} " + "words of an ordinary paragraph " * 48 + "</p>" for k in range(5))


@pytest.mark.parametrize("page", ["<body><div><section>{a}</section><section>{b}</section></div></body>", "<body><div>{a}</div><ul><li>{b}</li></ul></body>", "<body><article>{a}</article><article>{b}</article></body>"])
def test_all_parts_stay(page):
    text = html_text.main_text(page.format(a=paragraphs("first"), b=paragraphs("second")))
    assert all(f"{word} {k} words" in text for word in ("first", "second") for k in range(5))


@pytest.mark.parametrize("part", ["<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<blockquote>{}</blockquote>"])
def test_dense_siblings_stay(part):
    page = "<body><div><div>" + paragraphs("first") + "</div>" + part.format("kept " * 400) + "<ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul></div></body>"
    text = html_text.main_text(page)
    assert "kept kept" in text and "first 4" in text and "two" not in text
