import difflib
import random

from shelfgraph.functions import fuzzy


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_length():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abcé ") for _ in range(rnd.randrange(12))) for _ in range(2))
        assert fuzzy.common_length(a, b) == lcs(a, b)
    assert fuzzy.ratio("abc", "abc") == 100 == fuzzy.ratio("", "") and difflib.SequenceMatcher(None, "ab", "ba").ratio() > 0


def test_token_ratios():
    assert fuzzy.sorted_ratio("Books Tor", "tor books") == 100
    assert fuzzy.set_ratio("Tor Books", "tor") == 100 and fuzzy.set_ratio("", "x") == 0
    assert 0 < fuzzy.set_ratio("penguin books", "penguin book") < 100
