"""The quality classifier against a plain discriminant on the same statistics."""

import random
import zlib

import numpy as np

from tidemill.llm import quality

SCHEMA = "doc_id long, text string, score string"


def test_scores_equal_a_plain_discriminant(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "house", "stands", "near", "a", "river", "and", "trees"]) for _ in range(rng.randrange(5, 80))) + ".\n"
    bad = lambda: "".join(rng.choice("!!$$%&AAZZ  91") for _ in range(rng.randrange(10, 300)))
    texts = [(good if i % 3 else bad)() + (bad() if i % 7 == 0 else "") for i in range(240)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    marks = [(i, int(i % 3 != 0) if i % 11 else None, 0) for i in range(240) if i % 2]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    x = {r.doc_id: np.array(r.features) for r in quality.with_statistics(docs).selectExpr("cast(doc_id as long) as doc_id", "features").collect()}
    train = {c: np.array([x[i] for i, q, _ in marks if q == c and zlib.crc32(str(i).encode()) % 5]) for c in (0, 1)}
    want = plain_scores(train, x)
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def plain_scores(train, x):
    """Means, shrunk covariances and densities by the textbook, with inverses instead of factors."""
    n = {c: len(v) for c, v in train.items()}
    d = len(quality.FEATURES)
    scatter = {c: sum(np.outer(r - v.mean(0), r - v.mean(0)) for r in v) for c, v in train.items()}
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1]) + np.diag([1e-6] * d)
    models = {}
    for c, v in train.items():
        own = n[c] / (n[c] + d) * scatter[c] / n[c] + d / (n[c] + d) * pooled
        cov = (1 - quality.POOLED - quality.DIAGONAL) * own + quality.POOLED * pooled + quality.DIAGONAL * np.diag(pooled.diagonal())
        models[c] = (v.mean(0), cov)
    out = {}
    for i, row in x.items():
        density = {}
        for c, (mean, cov) in models.items():
            d = row - mean
            density[c] = np.log(n[c] / (n[0] + n[1])) - 0.5 * (d @ np.linalg.inv(cov) @ d + np.linalg.slogdet(cov)[1])
        odds = (density[1] - density[0]) / quality.TEMPER
        out[i] = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    return out
