import random

from tests.llm.test_suffixes import check


def test_unique_text_beside_a_copy_under_one_id(spark):
    rng = random.Random(6)
    x, y, z, w = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (120, 130, 140, 150))
    rows = [(1, x), (None, x), (None, y), (None, ""), (None, None), (2, ""), (4, x), (4, z), (4, z[10:90] + w), (5, "q" + z), (6, y[20:110]), (-3, w[:70])]
    check(spark, rows)
