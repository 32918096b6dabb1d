"""What a site repeats on few of its pages."""

import hashlib

from pyspark.sql import functions as F

from tests.llm.test_pages import page, responses
from weftline.llm import pages as G, residue as R

PROMPT = "Support our small and free newsroom with a gift each month."


def site(count, with_prompt, line="<p>{}</p>".format(PROMPT)):
    """Bodies of one site; the pages below ``with_prompt`` have a line amid their paragraphs."""
    made = [page(f"Title {i}", f"The first paragraph of {i} tells a tale.", "@@", f"Another one with number {i}.") for i in range(count)]
    return [b.replace(b"<p>@@</p>", line.encode() if i < with_prompt else b"") for i, b in enumerate(made)]


def texts(bodies):
    made = [G.page_blocks(b.decode(), (i,)) for i, b in enumerate(bodies)]
    G.cover_lines(made, G.repeated_blocks(made))
    return [[b.text for b in G.main_blocks(p)] for p in made]


def test_rotating_prompts_fall_away_whatever_the_size_of_the_site():
    for count in (12, 60, 240):
        got = texts(site(count, 6))
        assert all(t == [f"Title {i}", f"The first paragraph of {i} tells a tale.", f"Another one with number {i}."] for i, t in enumerate(got))
    few = "<p>Join the readers of our letter.</p>"
    mixed = site(60, 2, few)
    mixed[40] = mixed[40].replace(b"</h1>", b"</h1><aside>" + few.encode() + b"</aside>")
    assert not any("Join the readers of our letter." in t for t in texts(mixed))


def test_content_lines_that_come_back_stay():
    for line, text in (
        ("<p>106 g</p>", "106 g"),
        ("<p>It fits a shelf 77 centimetres wide and costs 12 crowns.</p>", "It fits a shelf 77 centimetres wide and costs 12 crowns."),
        ("<ul><li>Stir the flour into the milk until it is smooth.</li></ul>", "Stir the flour into the milk until it is smooth."),
    ):
        assert [text in t for t in texts(site(60, 6, line))] == [i < 6 for i in range(60)], text


def test_lines_are_counted_over_all_parts_of_a_site(spark):
    df = responses(spark, site(60, 6)).withColumn("url", F.lit("https://one.test/x"))
    blocks = R.contents(R.response_pages(df), block_pages=5).select(F.explode("blocks").alias("b"))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert blocks.where(F.col("b") == md5(PROMPT)).count() == 0
    assert blocks.where(F.col("b") == md5("The first paragraph of 3 tells a tale.")).count() == 1
