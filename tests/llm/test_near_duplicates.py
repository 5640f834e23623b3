"""Near duplicates: ids on several rows, and texts built to meet in weak hashes."""

import random

import numpy as np
import pytest

from tidemill.llm import jaccard

SCHEMA = "doc_id long, text string, n long, digest string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)


def sentence(rng, n=60):
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


def groups(spark, rows):
    got = jaccard.similar_groups(documents(spark, rows)).collect()
    return sorted({(r.doc_id, r.component_id) for r in got}, key=str), len(got)


def test_an_id_with_two_texts_joins_both_their_groups(spark):
    rng = random.Random(1)
    a, b = sentence(rng), sentence(rng)
    near_b = b + " and one more"
    rows = [(3, a), (5, a), (5, b), (7, near_b), (9, sentence(rng))]
    for order in (rows, rows[::-1]):
        assert groups(spark, order) == ([(3, 3), (5, 3), (7, 3), (9, 9)], 5)


def test_one_row_of_a_repeated_id_stays(spark):
    rng = random.Random(2)
    a, b = sentence(rng), sentence(rng)
    rows = [(1, a), (1, a), (2, b), (2, sentence(rng)), (2, b + " x"), (4, a), (None, a), (None, a), (6, None), (6, None), (7, "")]
    got = jaccard.one_of_each(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got if r.doc_id != 2), key=str) == sorted([(1, a), (None, a), (None, a), (6, None), (7, "")], key=str)
    assert sum(r.doc_id == 2 for r in got) == 1


def regular(n, a, b):
    """The Thue-Morse word over two parts: such words meet in any polynomial modulo a power of two."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize(("a", "b"), [("a", "b"), ("ab" * 8, "ba" * 8)])
def test_words_of_a_regular_build_do_not_meet(a, b):
    one, other = (next(jaccard.shingle_sets([regular(4096, x, y)])) for x, y in ((a, b), (b, a)))
    assert len(one) == len(other) == 1 and one[0] != other[0]


def test_hashes_are_of_words_and_not_of_places():
    words = ["the", "quick", "brown", "fox", "jumps", "over"]
    whole = next(jaccard.shingle_sets([" ".join(words)]))
    assert len(whole) == 2
    padded = list(jaccard.shingle_sets(["x " * 70_000, "  \t" + "\n".join(words).upper() + " "]))[1]
    assert np.array_equal(whole, padded)
    big = jaccard._times(np.array([jaccard._PRIME - 1, 12345], np.uint64), np.array([jaccard._PRIME - 1, 1 << 60], np.uint64))
    assert big.tolist() == [1, 12345 * (1 << 60) % jaccard._PRIME]
