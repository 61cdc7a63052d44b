"""Spelling variants, near vectors and Merkle manifests against plain versions, and on odd tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle, nearvectors, spelling
from millrace.llm.covertree import CoverTree, links, nested_centers

# ---- near vectors


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plain_near(rows, cosine):
    """n_links and component of each of (id, label, vector) rows, all pairs."""
    ok = [lab is not None and v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, lab, v in rows]
    width = max([len(v) for v, good in zip((r[2] for r in rows), ok, strict=True) if good], default=0)
    x = np.array([[*r[2], *[0.0] * (width - len(r[2]))] if good else [0.0] * width for r, good in zip(rows, ok, strict=True)])
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if ok[i] and ok[j] and rows[i][1] == rows[j][1] and (x[i] @ x[j]) / (np.sqrt(x[i] @ x[i]) * np.sqrt(x[j] @ x[j])) >= cosine:
            n[i], n[j] = n[i] + 1, n[j] + 1
            root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(top(i), []).append(r[0])
    named = {t: min((i for i in ids if i is not None), default=None) for t, ids in least.items()}
    return sorted(((r[0], n[i], named[top(i)], r[0] == named[top(i)]) for i, r in enumerate(rows)), key=repr)


def crowd(seed, n=500, d=6, spread=0.12):
    """Clusters of very unlike sizes, their copies, and strangers."""
    rng = np.random.default_rng(seed)
    base = unit(rng.normal(size=(12, d)))
    of = np.minimum(rng.geometric(0.35, n) - 1, 11)
    x = base[of] + rng.normal(size=(n, d)) * spread * rng.random((n, 1)) / np.sqrt(d)
    x = np.vstack([x, rng.normal(size=(n // 4, d)), x[:9], 3 * x[:9]])
    return [(i, int(i % 2), row.tolist()) for i, row in enumerate(x)]


@pytest.mark.parametrize(("block", "fan_out", "sample"), [(16, 4, 16), (40, 64, 512)])
def test_near_vectors_is_exact(spark, block, fan_out, sample):
    rows = crowd(block)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = nearvectors.near_vectors(df, 0.98, block=block, fan_out=fan_out, sample=sample)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_near(rows, 0.98)


def test_near_vectors_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.01]), (2, "a", [5.0, 0.0]), (None, "a", [1.0, 0.02]), (3, "b", [1.0, 0.0]), (4, None, [1.0, 0.0]),
        (5, "a", None), (6, "a", [0.0, 0.0]), (7, "a", [nan, 1.0]), (8, "a", [1.0, None]), (9, "a", [inf, 1.0]), (10, "a", []), (11, "a", [1e300]),
        (12, "c", [1e-300, 0.0]), (13, "c", [1.0]), (None, "d", [1.0, 1.0]), (14, "a", [-0.0, 1.0]), (15, "a", [0.0, 1.0]),
    ]
    df = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], "vec_id long, label string, embedding array<double>, n int, vector string, node string")
    tidy = lambda t: (t[0], t[1], t[2], t[3])
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in nearvectors.near_vectors(df).collect()}
    assert {(1, 4, 1, True), (2, 4, 1, False), (None, 4, 1, False), (11, 4, 1, False), (3, 0, 3, True), (12, 1, 12, True), (13, 1, 12, False)} <= set(map(tidy, got))
    assert {(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)} <= got and (None, 0, None, True) in got and (15, 1, 14, False) in got
    assert nearvectors.near_vectors(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="cosine"):
        nearvectors.near_vectors(df, 0.0)


def test_a_crowd_counts_as_whole_nodes(spark):
    """Very near copies are counted node by node, and equal directions that no center parts do not stop the tree."""
    rng = np.random.default_rng(3)
    x = np.array([1.0, 0, 0]) + rng.normal(size=(600, 3)) * 1e-3
    rows = [(i, 1, v.tolist()) for i, v in enumerate(np.vstack([x, np.outer(np.linspace(0.1, 7, 300), [0.3, -0.7, 0.2])]))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = nearvectors.near_vectors(df, 0.98, block=32, fan_out=4, sample=32).collect()
    assert {(r.n_links, r.component_id) for r in got if r.vec_id < 600} == {(599, 0)}
    assert {(r.n_links, r.component_id) for r in got if r.vec_id >= 600} == {(299, 600)}


@pytest.mark.parametrize("seed", range(4))
def test_cover_trees(seed):
    rng = np.random.default_rng(seed)
    x, y = (unit(np.array([r[2] for r in crowd(seed * 2 + k, 200, (3, 8, 64, 5)[seed])])) for k in (0, 1))
    trees = [CoverTree(m, nested_centers(m, 0.05), rng.integers(1, 4, len(m))) for m in (x, y)]
    for a, b in ((trees[0], trees[1]), (trees[0], trees[0])):
        radii = [max(r) for r in a.radius]
        assert all(later <= max(radii[0] / 2**i, 0.05) + 1e-9 for i, later in enumerate(radii))
        near = a.x @ b.x.T >= 0.98
        weights = [np.empty(len(t.x), np.int64) for t in (a, b)]
        for t, w in zip((a, b), weights, strict=True):
            w[t.order] = t.weight[-1]
        found = links(a, b, 0.98)
        assert (found.of_a == near @ weights[1]).all() and (found.of_b == near.T @ weights[0]).all()
        assert near[found.between[:, 0], found.between[:, 1]].all()


# ---- spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, ratio=10):
    forms, out = {}, []
    count = dict(words)
    around = {w: [v for v in count if near(w, v)] for w in count}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        forms[w] = best if best and count[best] >= ratio * count[w] else None
    for w in count:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, count[w], len(around[w]), count.get(forms[w])))
    return sorted(out)


@pytest.mark.parametrize("most", [4, 32, 2048])
def test_spelling_variants(spark, most):
    rng = np.random.default_rng(most)
    letters, words = "abÿÀ÷", {}
    for _ in range(120):
        w = "".join(rng.choice(list(letters[: 2 + rng.integers(4)]), rng.integers(1, 10)))
        for v in (w, w[:-1] + "a", w[1:], w[:3] + "b" + w[3:], "prefix" + w, "prefix" + w[::-1]):
            words[v] = int(10 ** rng.integers(0, 4) * rng.integers(1, 9))
    words.pop("", None)
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    got = sorted(map(tuple, spelling.spelling_variants(df, most=most).collect()))
    assert got == plain_variants(sorted(words.items()))


def test_vocabulary_of_odd_texts(spark):
    long = "abcdefghij" * 3000
    texts = ["Straße STRASSEN straßen naïveté", None, "", "ABCDEFG abcdefg abcdef×h 1abcdefg2", f"{long} {long}", "ÄBCDEFGH äbcdefgh", "𝒳abcdefg"]
    rows = [(i if i else None, t, "n", "run") for i, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, run string")
    for every in (None, 2):
        want = {}
        for i, t, *_ in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if every and h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                want[run] = want.get(run, 0) + 1
        words = spelling.vocabulary(docs, least=7, times=2, every=every)
        assert {r.word: r.n for r in words.collect()} == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert spelling.spelling_variants(spelling.vocabulary(docs.where("false"))).count() == 0
    assert {r.word for r in spelling.spelling_variants(spelling.vocabulary(docs)).collect()} >= {long, "abcdefg", "straßen"}


# ---- manifests


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, fan_out):
    """Rows of the manifest of (doc_id, source, lang, n_chars, text), every doc_id that 5 divides tampered with."""

    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(digests):
        ways, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for way, i in zip(ways, at, strict=True):
                run = i // fan_out * fan_out
                way.append((digests[run:i], digests[i + 1 : run + fan_out]))
            digests = [sha("".join(digests[i : i + fan_out])) for i in range(0, len(digests), fan_out)]
            at = [i // fan_out for i in at]
        return digests[0], ways

    sources, out = {}, []
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    trees = {}
    for s in sorted(sources, key=lambda s: (s is not None, (s or "").encode())):
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in sources[s]])
    root, upper = tree([t[0] for t in trees.values()])
    for (s, (subroot, ways)), over in zip(trees.items(), upper, strict=True):
        for r, way in zip(sources[s], ways, strict=True):
            low = None if r[4] is None else "".join(c.lower() if c.isascii() else c for c in r[4])
            node = leaf((*r[:4], low)) if r[0] is not None and r[0] % 5 == 0 else leaf(r)
            for left, right in way + over:
                node = sha("".join([*left, node, *right]))
            siblings = "".join(d for left, right in way + over for d in left + right)
            out.append((r[0], leaf(r), subroot, root, sha(siblings), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fan_out", "n"), [(2, 70), (3, 90), (16, 600)])
def test_manifest(spark, fan_out, n):
    rows = [(i, ["big", "big", None, "", "é", "z"][i % 6 if i < 40 else 0], "en", i, f"Text {i} É") for i in range(n)]
    rows += [(None, None, None, None, None), (None, None, None, None, "T"), (7, "twice", "de", 1, "T"), (7, "twice", "de", 1, "T"), (5, "lone", None, 0, ""), (10, "other", "x", 2, "no change")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest string, `group` int")
    got = merkle.manifest(docs, fan_out, F.col("doc_id") % 5 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows, fan_out)


def test_manifest_of_nothing_and_of_one(spark):
    docs = spark.createDataFrame([(1, "s", None, None, "T")], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs.where("false")).count() == 0
    row = merkle.manifest(docs).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha("") and row.verified
    with pytest.raises(ValueError, match="fan-out"):
        merkle.manifest(docs, 1)
