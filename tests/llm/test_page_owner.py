"""Distinct pages of a site are told apart by what they say, not by their titles."""

from weftline.llm import pages as G

NOTICE = "We keep the terms of sale on a page of their own for every reader."
PAGE = "<html><head><title>{title}</title></head><body><div><p>Our shop is open all week</p><h1>{h}</h1><p>{text}</p><p>{notice}</p><p>{date}</p></div></body></html>"


def main_texts(sources):
    made = [G.page_blocks(s, (i,)) for i, s in enumerate(sources)]
    G.repeated_blocks(made)
    return [[b.text for b in G.main_blocks(p)] for p in made]


def made(title, i, date="1.2.2026"):
    return PAGE.format(title=title, h=f"Lamp {i}", text=f"This lamp of {'abcdefghijklmnopqrstuvwxyz'[i % 26]} wood comes from maker {i}.", notice=NOTICE, date=date)


def test_pages_of_one_title_are_many_pages():
    for title in ("Shop", ""):
        got = main_texts([made(title, i) for i in range(20)])
        assert all(NOTICE not in t and len(t) == 2 for t in got), title


def test_repeated_fetches_are_one_page():
    fetches = [made("Lamp 3 | Shop", 3, f"{d}.2.2026") for d in range(1, 9)]
    assert len({G.page_owner(G.page_blocks(s)) for s in fetches}) == 1
    got = main_texts(fetches + [made(f"Lamp {i} | Shop", i) for i in range(4, 8)])
    assert all(len(t) == 2 and NOTICE not in t for t in got)
