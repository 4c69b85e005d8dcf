"""Markup is cut as by one plain pattern, in time linear in the page."""

import random
import re
import time

import pytest

from difflens.llm import htmltext

# The same pieces by a pattern that looks again from every place.
PLAIN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
BITS = ["<", ">", "</", '"', "'", "a", "div", "<div>", "</div>", "<p class=\"x\">", "<!--", "-->", "<!", "<?", "script", "<script>", "</script >", "<style", "/", " ", "\n", "=", "é", "<textarea>", "</TEXTAREA>", "<script-x>"]


def plain(page):
    return [(m.start(), m.end(), (m["tag"] or "").lower(), bool(m["end"]), m["attrs"] or "") for m in PLAIN.finditer(page)]


@pytest.mark.parametrize("near", [1, 4, 512])
def test_pieces_are_those_of_the_plain_pattern(monkeypatch, near):
    monkeypatch.setattr(htmltext, "_NEAR", near)
    rng = random.Random(near)
    for _ in range(4000):
        page = "".join(rng.choice(BITS) for _ in range(rng.randrange(14)))
        assert list(htmltext.pieces(page)) == plain(page), page


MB = 1 << 20
LONG = {
    "open tags": "<a " * (2 * MB // 3),
    "open blocks": "<div>x" * (2 * MB // 6),
    "open quotes": "<p title=\"x 'y " * (2 * MB // 15),
    "declarations": "<!x " * (2 * MB // 4),
    "end tags": "</a " * (2 * MB // 4),
    "open lists": "<ul><li class=x>y" * (2 * MB // 17),
    "unread": "<svg>" * (MB // 5),
    "digits": "<p>the a" + "1" * MB + "a of",
}


@pytest.mark.parametrize("kind", list(LONG))
def test_long_pages_take_linear_time(kind):
    start = time.process_time()
    htmltext.main_text(LONG[kind])
    assert time.process_time() - start < 8  # seconds; hours, were it quadratic


def test_deep_blocks_keep_their_place():
    deep = "<div>" * 50_000 + "<nav>menu</nav><p>" + "The dog is in the house and it was a good one for all of us. " * 5 + "</p>" + "</div>" * 50_000
    found = htmltext.blocks(deep)
    assert [b.outside for b in found] == [True, False]
    assert htmltext.main_text(deep).startswith("The dog is in the house")
