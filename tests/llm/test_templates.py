"""What comes back on several sites is an error template only if it is short and statuses, or many sites, speak for it."""

from tests.llm.test_pages import RESPONSE
from weftline.llm import residue as R


def found(spark, bodies, status=200):
    """The cases among ``bodies`` on a site each, amid plain pages of other sites."""
    plain = [f"<h1>Tale {i}</h1><p>Old {'abcdefghijklmnopqrst'[i] * 3} tells of the sea and the hills near town {i}.</p>".encode() for i in range(20)]
    rows = [(i, i, f"https://s{i}.test/{i}", status if i <= len(bodies) else 200, {"Content-Type": "text/html"}, None, b, "x") for i, b in enumerate(bodies + plain, 1)]
    return {r.response_id for r in R.residue_responses(spark.createDataFrame(rows, RESPONSE)).collect()}


def test_syndicated_articles_stay(spark):
    article = b"<h1>Harvest begins early</h1><p>Growers in the valley picked the first pears this week, a month before the usual date.</p>"
    assert found(spark, [article] * 3) == set()
    assert found(spark, [b"<h1>Contact</h1>"] * 4) == set()
    assert found(spark, [article + b"<p>" + b"The pears are sweet and small this year, say those who have tasted them. " * 8 + b"</p>"] * 9) == set()


def test_messages_in_any_words_are_cases(spark):
    unknown = b"<h1>Oh dear</h1><p>That offer has flown away with the geese.</p>"
    assert found(spark, [unknown] * 4, 404) == {1, 2, 3, 4}
    plain = b"<h1>Tale x</h1><p>Old Ann tells of the sea and the hills near town 9.</p>"
    assert found(spark, [plain], 404) == set()  # a status alone says little
    assert found(spark, [unknown] * 8) == set(range(1, 9))


def test_filler_is_learned_from_unfilled_templates(spark):
    """Words that stand with unfilled slots on some pages are residue on others too."""
    with_slot = [f"<h1>{{{{title}}}}</h1><p>{{{{body}}}} {{{{price}}}} {{{{author}}}}</p><p>Zibber zabber {w} zobber.</p>".encode() for w in ("blim", "blam", "blom", "blem")]
    assert 5 in found(spark, [*with_slot, b"<h1>Zabber</h1><p>Zibber zabber zobber. Zibber zabber blim.</p>"])
