"""Tags of damaged pages: in time linear in the page, wherever quotes stay open."""

import random
import re
import time

import pytest

from finwake.llm import html_text

PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>", re.S)


def test_tokens_are_those_of_the_plain_pattern():
    r = random.Random(1)
    parts = ["<a ", "<b", ">", '"', "'", "x", "/>", "</a", "<!--", "-->", "<![CDATA[", "]]>", "<!", "<?", " ", "<", '="']
    for _ in range(5000):
        page = "".join(r.choice(parts) for _ in range(r.randrange(1, 25)))
        assert list(html_text.tokens(page)) == [m.span() for m in PLAIN.finditer(page)], page


@pytest.mark.parametrize("piece", ['<a "', '<a ">"', "<a \"'>", "<svg>", "<a", "<!--", "<p title='"])
def test_hostile_pages_take_linear_time(piece):
    began = time.process_time()
    html_text.blocks_of(piece * (1_000_000 // len(piece)) + "'")
    assert time.process_time() - began < 10
