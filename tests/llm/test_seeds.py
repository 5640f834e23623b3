"""Decontamination by rare seeds: nothing that aligns well enough is missed, and few common words are no evidence."""

import random

import numpy as np
import pytest

from tidemill.llm import decontaminate as D

SCHEMA = "doc_id long, text string, n long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA)


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_common_words_in_a_row_are_no_evidence(spark):
    items = ["one of the best things", "it was the end of it", "a b", "the whole short item is here now"]
    texts = ["this was one of the reasons we left early", "at the end of it all", "and one of the best things that happened", "a b", "the whole short item is there now", "x the whole short item is here now y"]
    docs, benchmark = documents(spark, texts), items_of(spark, items)
    assert sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, benchmark).collect()) == [(2, 0), (5, 3)]
    assert sorted(r.doc_id for r in D.clean(docs, benchmark).collect()) == [0, 1, 3, 4]


def corpus(rng):
    """Few words, so that pairs are frequent; items appear edited in every way."""
    word = lambda: f"w{min(int(rng.expovariate(0.15)), 60)}"
    items = [" ".join(word() for _ in range(rng.choice([3, 5, 7, 8, 9, 16, 30, 60]))) for _ in range(25)]
    texts = [" ".join(word() for _ in range(80)) for _ in range(20)]
    for item in items * 4:
        words, share = item.split(), rng.choice([0, 0.1, 0.2, 0.3, 0.45])
        edited = []
        for w in words:
            if rng.random() >= share:
                edited.append(w)
            elif rng.random() < 0.6:
                edited += [word()] * rng.choice([1, 2])
        at = rng.randrange(max(len(edited) - 20, 1)) if rng.random() < 0.3 else 0
        texts.append(" ".join([*(word() for _ in range(15)), *edited[at:], *(word() for _ in range(15))]))
    return items, texts


def plain(items, texts):
    number = {}
    coded = lambda text: np.array([number.setdefault(w, len(number) + 1) for w in D.words_of(text)])
    out = set()
    for i, item in enumerate(items):
        own = coded(item)
        n = len(own)
        wanted = max(min(n, 2 * D.PASSAGE), 2 * min(n, D.EVIDENCE))
        out |= {(d, i) for d, text in enumerate(texts) if n >= D.LEAST_WORDS and D.align(own, coded(text))[0] >= wanted}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_recall_against_alignment_of_everything(spark, seed):
    items, texts = corpus(random.Random(seed))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(documents(spark, texts), items_of(spark, items)).collect()}
    assert got == plain(items, texts) and len(got) > 40


def test_frequent_pairs_are_not_seeds_where_rarer_ones_do():
    text = " ".join(f"of the r{k}" for k in range(12))
    items = D.Items.of([("0", text)])
    least = items.least(0.5)
    counts = np.zeros(len(items.codes), np.int64)
    common = items.hits(items.number_words("of the"))[0]
    counts[common] = 10_000
    seeded = items.seeded(counts, least)
    places = seeded.first[common + 1] - seeded.first[common]
    whole = items.first[common + 1] - items.first[common]
    assert whole.tolist() == [12] and places.tolist()[0] < 12
    assert len(seeded.places) < len(items.places)
    held = seeded.matches(seeded.number_words("x " + text + " y"), least)
    assert [(i, s) for i, s, _, _ in held] == [(0, 1.0)]
