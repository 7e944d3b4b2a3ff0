"""Main text of pages labelled by hand, some without any telling element; and cuts held against all labellings."""

import itertools

import pytest

from lattica.llm import extract

LONG = "This is a long sentence of the article, which goes on for a good many words before it ends."
MENU = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News", "About us"))
#: page, its main text, and whether the classifier alone would get it wrong
PAGES = [
    (f"<body><div><h2>Results</h2><p>{LONG}</p><p>{LONG}</p></div></body>", f"Results\n{LONG}\n{LONG}", True),
    (f"<body><div><p>{LONG}</p><p>Not so.</p><p>{LONG}</p></div><ul>{MENU}</ul></body>", f"{LONG}\nNot so.\n{LONG}", False),
    (f"<body><ul>{MENU}</ul><div><p>{LONG}</p><div>First step</div><div>{LONG}</div></div></body>", f"{LONG}\nFirst step\n{LONG}", True),
    (f"<nav><ul>{MENU}</ul></nav><article><h1>Title</h1><p>{LONG}</p><ul><li>One point</li><li>Another</li></ul><p>End.</p></article><footer>{LONG}</footer>", f"Title\n{LONG}\nOne point\nAnother\nEnd.", False),
    (f"<article><p>{LONG}</p><div class='advert'><p>{LONG}</p></div><p>{LONG}</p><div id='comments'><p>{LONG}</p></div></article>", f"{LONG}\n{LONG}", False),
    (f"<article><p>{LONG}</p><svg class='i'/><p>{LONG}</p></article>", f"{LONG}\n{LONG}", False),
    ("<div>" * 450 + f"<nav><ul>{MENU}</ul></nav><article><p>{LONG}</p></article>", LONG, False),
    ("<b>" * 3000 + f"<article><p>{LONG}<p>{LONG}</article><form><p>{LONG}</p></form>", f"{LONG}\n{LONG}", False),
    (f"<ul>{MENU}</ul><div class='cookie-banner'>{LONG}</div>", "", False),
]


@pytest.mark.parametrize("page, text, turned", PAGES)
def test_pages(page, text, turned):
    assert extract.main_text(page) == text
    assert (extract.labelled(page)[2] > 0) == turned


@pytest.mark.parametrize("page", [p for p, _, _ in PAGES])
def test_labels_are_a_cheapest_labelling(page):
    found, keep, _ = extract.labelled(page)
    good, bad, edges = extract.network(found)
    cost = lambda side: sum(b if s else g for g, b, s in zip(good, bad, side, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])
    assert len(found) <= 12 and cost(keep) == min(map(cost, itertools.product([False, True], repeat=len(found))))
