import math
import random

from millrace.operators.retrieval import mmr


def plain_mmr(hits, keep, balance):
    """The picks of one query's (vec_id, score, v), one pair after the other."""
    hits = sorted(hits, key=lambda h: (-h[1], h[0]))
    low, high = min(h[1] for h in hits), max(h[1] for h in hits)
    relevance = [(h[1] - low) / (high - low) if high > low else 1.0 for h in hits]

    def cosine(a, b):
        size = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    picked = []
    while len(picked) < min(keep, len(hits)):
        gains = {
            i: balance * relevance[i] - (1 - balance) * max((cosine(hits[i][2], hits[j][2]) for j in picked), default=0.0)
            for i in range(len(hits)) if i not in picked
        }
        picked.append(max(gains, key=gains.get))
    return [hits[i][0] for i in picked]


def test_mmr_equals_plain(spark):
    rng = random.Random(7)
    rows = [(q, v, rng.random(), [rng.gauss(0, 1) for _ in range(6)]) for q in range(5) for v in range(3 + 6 * q)]
    rows += [(9, v, 0.5, [0.0] * 6) for v in range(3)]  # equal scores, no direction
    hits = spark.createDataFrame(rows, "query_id long, vec_id long, score double, v array<double>")
    got = {}
    for r in mmr(hits).orderBy("query_id", "pick").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: plain_mmr([r[1:] for r in rows if r[0] == q], 5, 0.7) for q in {r[0] for r in rows}}
