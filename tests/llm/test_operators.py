"""The operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import itertools
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bktree, common, components, langid, lines, mixing, packing, passages, quality, queries, sharding, simhash, sql, topk, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, bucket string"
#: Names that operators use inside.
CLASHES = ["_of", "_row", "_lines", "_words", "_epochs", "_last", "_copy", "row", "doc", "rid", "chunks", "lines_", "copy", "of", "key", "node", "id", "_part", "spans", "a b", "x.y"]


def word(i):
    return "w" + xxhash.xxh64_hexdigest(str(i))[:5]


def prose(start, n):
    return " ".join(word(i) for i in range(start, start + n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns named like the operators' own."""
    rows = [
        (1, prose(0, 120), "en", "a"), (2, prose(0, 120), "en", "a"), (2, prose(0, 120), "en", "a"), (3, None, None, None),
        (4, "", "en", "b"), (None, prose(500, 60), None, "b"), (5, prose(900, 9000), "de", "b"), (6, " \t\n ", None, None),
        (7, "line one\nline two\nline three\n" * 5, "en", "c"), (8, prose(0, 119) + " other", "en", "a"), (9, "\n" * 50, "en", "c"),
    ]
    schema = SCHEMA + "".join(f", `{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, 0, "s", 1, "b", *CLASHES) for r in rows], schema)


def unchanged(df):
    """The clashing columns hold what they held."""
    return all([r[c] for c in CLASHES] == CLASHES for r in df.collect())


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(sql.ORACLES[name]).df()
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    tidy = lambda rows: sorted(repr(tuple(None if x != x else x for x in r)) for r in rows)
    assert tidy(map(tuple, df.select(*names).collect())) == tidy(want[names].astype(object).where(want[names].notna(), None).itertuples(index=False, name=None))


def test_empty_tables(spark, odd):
    none = odd.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix_plan(none).count() == 0
    assert mixing.mix_documents(none).count() == 0
    assert sharding.shard_documents(none, sharding.topology(8), sharding.topology(9)).count() == 0
    assert packing.pack_documents(none, queries.word_tokenizer()).count() == 0
    assert passages.repeated_passages(none).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert simhash.keep_one_of_each(none).columns == odd.columns
    assert lines.dedup_lines(none).count() == 0
    assert langid.identify(none, langid.train(none)).count() == 0
    assert quality.judge(none, quality.train(none, labels)).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")).count() == 0


def test_mix(odd):
    rows = mixing.mix_plan(odd).collect()
    assert len(rows) == 11
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    for group in by.values():
        assert sum(r.taken for r in group) == int(group[0].target) and group[0].target <= 2 * group[0].source_size
    assert abs(sum(g[0].target for g in by.values()) - 1.5 * total) < 1e-6
    out = mixing.mix_documents(odd)
    assert out.columns == odd.columns and unchanged(out) and out.groupBy("doc_id", "text", "source").count().agg(F.max("count")).first()[0] <= 4


def test_shard_moves_only_into_the_new(spark, odd):
    rows = sharding.shard_documents(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), sharding.topology(8), sharding.topology(9)).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    counts = np.bincount([r.shard for r in rows])
    assert counts.min() > 300 and 250 < sum(r.grown_shard == 8 for r in rows) < 420
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    odd_rows = sharding.shard_documents(odd, sharding.topology(8)).collect()
    assert len(odd_rows) == 11 and {r.size for r in odd_rows if r.doc_id == 3} == {1} and all(r.grown_shard is None for r in odd_rows)
    assert {r.text_crc32 for r in odd_rows if r.doc_id == 1} == {zlib.crc32(prose(0, 120).encode())}


def test_pack(spark, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.word_tokenizer())
    packed = packing.pack_documents(odd, queries.word_tokenizer(), with_ids=True)
    rows = packed.collect()
    whole_sequences = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole_sequences[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, whole_sequences.values())) == sum(r.length for r in rows)
    ids = {r.doc_id: whole.encode(r.text or "", add_special_tokens=False).ids + [1] for r in odd.collect()}
    for d, want in ids.items():
        mine = sorted({(r.piece, tuple(r.ids)) for r in rows if r.doc_id == d})
        assert [x for _, p in mine for x in p] == want and all(len(p) == 4096 for _, p in mine[:-1])
    bins = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    tokens = packing.WordTokens(queries.word_tokenizer())
    odd_words = "İ ΑΣ. e\u0301 don't 'll a\x1cb \u00a0 \u200b ½ ﬁ <|endoftext|> <| ... 中文 \u0301 x\u0301".split(" ")
    odd = [" ".join(odd_words), "THE <|ENDOFTEXT|>", "İstanbul don't 3.5 e\u0301 \u00a0x\u2028y <|endoftext|> ΑΣ ΑΣ. a\x1cb"]
    odd += ["é, è. ß. ÷, a÷b x a.. b., ª º Éa éa\u0301. ée\u0301", None, "", " ", "w" * 50 + ". " + "é" * 45 + ", w. w"]
    odd += ["thston,%%% x'%s x.' 'll& don't, it's| [a] a[1] été!?", "a<|endoftext|>b", "\x1c a", "naïve… œuvre ﬀ"]
    every = [*texts[:60], *odd_words, *odd]
    for keep in (0, 300_000, 300_000):  # with an empty cache, a new one and a full one
        tokens.keep = keep
        ids, stops = tokens.ids(pa.array(every), 1)
        for t, low, high in zip(every, [0, *stops], stops, strict=False):
            assert ids[low:high].tolist() == whole.encode(t or "", add_special_tokens=False).ids + [1]


def test_blocks_hold_every_row():
    texts = ["a" * n for n in (0, 5, 90, 1, 1, 300, 0, 2)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["i", "t"])
    parts = list(common.blocks([batch, batch.slice(0, 0)], 1, 100))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(9)) and len(parts) == 2


@pytest.mark.parametrize("seed", range(5))
def test_plan_bins(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 101, 40), rng.integers(1, 50, 40), strict=True)}
    used = {}
    bins = 0
    for n, pattern in packing.plan_bins(counts, 100):
        assert sum(k * m for k, m in pattern) <= 100
        bins += n
        for k, m in pattern:
            used[k] = used.get(k, 0) + n * m
    assert used == counts
    left, plain = dict(counts), 0
    while any(left.values()):  # best fit, decreasing
        gap = 100
        while fits := [k for k, n in left.items() if n and k <= gap]:
            left[max(fits)] -= 1
            gap -= max(fits)
        plain += 1
    assert bins <= plain


@pytest.mark.parametrize("seed", range(40))
def test_no_exact_fill_is_passed_over(seed):
    rng = np.random.default_rng(seed)
    left = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 61, rng.integers(2, 14))}
    sums = packing.Sums(left)
    for _ in range(60):
        gap = int(rng.integers(1, 61))
        every = [c for n in (1, 2, 3) for c in itertools.combinations_with_replacement(sorted(left), n)]
        fills = [c for c in every if sum(c) == gap and all(c.count(k) <= left[k] for k in c)]
        got = sums.exact(gap)
        assert (got is None) == (not fills)
        if got:
            assert sum(got) == gap and len(got) == min(map(len, fills)) and all(got.count(k) <= left[k] for k in got)
            for k in got:
                left[k] -= 1
                if not left[k]:
                    del left[k]


def test_plan_bins_goes_on_where_a_length_is_short():
    counts = dict.fromkeys((60, 50, 30, 20, 17, 14, 9), 1)  # 20 + 20 fills the gap of 40 but there is one 20; 17 + 14 + 9 does too
    assert sorted(packing.plan_bins(counts, 100)) == [(1, [(50, 1), (30, 1), (20, 1)]), (1, [(60, 1), (17, 1), (14, 1), (9, 1)])]


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_against_all_pairs(spark, odd):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        data = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
        root = list(range(len(data)))
        for i, j in itertools.combinations(range(len(data)), 2):
            if (data[i][1] ^ data[j][1]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
        least = {}
        for r, (d, _) in zip(root, data, strict=True):
            least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
        want = sorted(repr((d, f"{fp:016x}", least[r])) for r, (d, fp) in zip(root, data, strict=True))
        got = simhash.simhash_components(docs)
        assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got.collect()) == want


def test_split_shards_link_the_same(spark):
    rng = np.random.default_rng(1)
    values = sorted({int(rng.integers(0, 1 << 10)) | 1 << 40 for _ in range(300)})
    prints = spark.createDataFrame([(v,) for v in values], "fp long").withColumn("keys", simhash.block_keys(F.col("fp"), 2))
    roots = [{r.node: r.root for r in components.components(simhash.near_links(prints, 2, unit)).collect()} for unit in (25, 1000)]
    assert roots[0] == roots[1] and len(roots[0]) > 200


def test_block_keys_miss_no_pair_within_the_radius(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        v = int(rng.integers(-(1 << 63), 1 << 63))
        bits = rng.choice(64, 2, replace=False)
        w = (v & (1 << 64) - 1) ^ (1 << int(bits[0])) ^ (1 << int(bits[1]))
        rows.append((i, v, w - (1 << 64) if w >> 63 else w))
    df = spark.createDataFrame(rows, "i int, v long, w long")
    assert df.where(F.arrays_overlap(simhash.block_keys(F.col("v")), simhash.block_keys(F.col("w")))).count() == 200


def test_join_spread_gives_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECES", 8)
    many = spark.createDataFrame([(i % 7 if i % 3 else 100, i) for i in range(400)] + [(None, -1)], "k int, i int")
    one = many.where("k is not null and k <> 5").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m"))
    for how in ("inner", "left"):
        got = common.join_spread(many, common.spool(one, "one"), ["k"], "n", ["i"], how).select("k", "i", "n", "m")
        want = many.join(one, "k", how).select("k", "i", "n", "m")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_components_of_stars_and_chains(spark):
    links = [(1, i) for i in range(2, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(399, 5000), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys([*range(1, 400), 5000], 1) | dict.fromkeys(range(1000, 1061), 1000)


def test_bk_tree():
    rng = np.random.default_rng(0)
    words = np.unique(rng.integers(0, 1 << 14, 500).astype(np.uint64)).reshape(-1, 1)
    tree = bktree.BKTree(words)
    got = {(int(a), int(b)) for q, n in tree.near(words, 2) for a, b in zip(q, n, strict=True)}
    want = {(i, j) for i in range(len(words)) for j in range(len(words)) if int(words[i, 0] ^ words[j, 0]).bit_count() <= 2}
    assert got == want


def test_near_copies_in_odd_rows(spark, odd):
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns and unchanged(kept)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 5, 7]  # 3, 4, 6 and 9 have no words
    assert sum(r.doc_id is None for r in kept.collect()) == 1
    many = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(prose(0, 60)).alias("text"))
    assert simhash.keep_one_of_each(many).count() == 1


def test_near_copies_leave_one(spark):
    base = [word(i) for i in range(300)]
    near = base.copy()
    near[150] = "changed"
    rows = [(5, " ".join(base)), (6, " ".join(near)), (7, " ".join(base)), (8, prose(5000, 300)), (None, " ".join(near)), (9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == [5, 8, 9]


@pytest.mark.parametrize(("changed", "stays"), [(20, 1), (70, 2)])  # five-word shingles: similarities 0.85 and 0.6
def test_near_copies_by_similarity(spark, changed, stays):
    rows = []
    for i in range(60):
        words = [word(1000 * i + k) for k in range(300)]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(words[:100] + [word(10**6 + 1000 * i + k) for k in range(changed)] + words[100 + changed :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.keep_one_of_each(docs).count() == 60 * stays


def stays(rows):
    """Ids that stay where all pairs of five-word shingle sets are compared."""
    sets, root = [], list(range(len(rows)))
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    for i, j in itertools.combinations(range(len(rows)), 2):
        both, size = len(sets[i] & sets[j]), len(sets[i]) + len(sets[j])
        if sets[i] == sets[j] or 5 * both >= 4 * (size - both):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root] if a != b else root
    return sorted(min(d for (d, _), r in zip(rows, root, strict=True) if r == x) for x in set(root))


def test_near_copies_against_all_pairs(spark):
    rows = []
    for i in range(120):  # similarities from 0.87 to 0.67
        words = [word(1000 * i + k) for k in range(304)]
        changed = 15 + i // 2 % 40
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:100] + [word(10**6 + 1000 * i + k) for k in range(changed)] + words[100 + changed :]))]
    for i in range(60):  # sets of 4 and 5 shingles
        rows += [(1000 + 2 * i, prose(5 * 10**6 + 100 * i, 8)), (1001 + 2 * i, prose(5 * 10**6 + 100 * i, 9))]
    for i in range(240):  # a crowd of texts around two bases, which one text between them may join
        words = [word(7 * 10**6 + k) for k in range(200)]
        words[:50] = [word(8 * 10**6 + k) for k in range(50)] if i % 2 else words[:50]
        for k in range(i % 5):
            words[60 + 25 * k + i % 20] = f"x{i}"
        rows.append((2000 + i, " ".join(words)))
    for unit in (1000, 30):
        got = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit)
        assert sorted(r.doc_id for r in got.collect()) == stays(rows)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == stays([(r.doc_id, r.text) for r in docs.collect()])


def near_runs(a, b, run=46):
    """Where a's runs of shingles begin of which 0.8 or more stand in one run of b, over all pairs of runs."""
    out = set()
    a, b = (np.array([hash(tuple(t[i : i + 5])) for i in range(len(t) - 4)]) for t in (a, b))
    if min(len(a), len(b)) < run:
        return out
    same = a[:, None] == b[None, :]
    for j in range(len(b) - run + 1):
        m = np.concatenate([[0], np.cumsum(same[:, j : j + run].any(axis=1))])
        m = m[run:] - m[:-run]
        for i in np.flatnonzero(m / (2 * run - m) >= 0.8).tolist():
            out.add(i)
    return out


def passage_cases():
    """Texts with shared passages: whole, edited, moved, several times in one text, and phrases too short to count."""
    rng = np.random.default_rng(5)
    shared = [[word(10**7 + 1000 * p + k) for k in range(70)] for p in range(6)]
    phrase = [word(2 * 10**7 + k) for k in range(22)]
    texts = []
    for i in range(60):
        own = [word(10**6 * 3 + 1000 * i + k) for k in range(150)]
        part = list(shared[i % 6])
        kind = i // 6 % 5
        if kind == 1:
            part[int(rng.integers(70))] = f"edit{i}"
        elif kind == 2:
            at = int(rng.integers(70))
            part = part[:at] + part[at + 1 :]
        elif kind == 3:
            part = part[: int(rng.integers(30, 70))]
        elif kind == 4:
            part = part + own[:20] + part + [f"twice{i}"]
        at = int(rng.integers(20, 130))
        texts.append(own[:at] + (phrase if i % 3 else []) + own[:5] + part + own[at:])
    # a leads where the phrase is all that is shared; b and c share what lies around it
    texts += [phrase + [word(4 * 10**7 + k) for k in range(60)]]
    texts += [[word(5 * 10**7 + k) for k in range(30)] + phrase + [word(6 * 10**7 + k) for k in range(30 + n)] for n in range(3)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def check_passages(rows, found):
    words = {i: t.encode().decode().split() for i, t in rows}
    linked, joined = {}, {}
    for r in found:
        assert r.end - r.start >= 50 and r.similarity >= 0.8 and r.doc_id != r.of_doc_id
        linked.setdefault(r.doc_id, set()).update(range(r.start, r.end - 4))
        a, b = joined.setdefault(r.doc_id, {r.doc_id}), joined.setdefault(r.of_doc_id, {r.of_doc_id})
        if a is not b:
            a |= b
            for x in b:
                joined[x] = a
    runs = wrong = 0
    for i, a in words.items():
        want = set()
        for j, b in words.items():
            if i != j and (near := near_runs(a, b)):
                want |= near
                assert j in joined.get(i, ()), (i, j)
        runs += len(want)
        wrong += len(linked.get(i, set()) - {k + n for k in want for n in range(46)})
        for k in want:  # the passage given may stop short of what another text shares of it
            assert len(linked.get(i, set()) & set(range(k, k + 46))) >= 23, (i, k)
    return runs, wrong


def test_passages_against_all_pairs_of_runs(spark):
    rows = passage_cases()
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    runs, wrong = check_passages(rows, found)
    assert runs > 1000 and wrong == 0


def test_passages_in_a_crowd(spark):
    """Unlike texts that share one of two phrases of 25 words, and in each crowd two texts that share both: 41 / 51."""
    rng, rows, near, n = random.Random(5), [], [], 0

    def new(k):
        nonlocal n
        n += k
        return [f"w{i}x" for i in range(n - k, n)]

    for _ in range(3):
        p, q = new(25), new(25)
        crowd = [new(60) + (p if k % 2 else q) + new(60) for k in range(80)] + [new(60) + p + new(1) + q + new(60) for _ in range(2)]
        order = list(range(82))
        rng.shuffle(order)
        near.append(frozenset(len(rows) + order.index(k) for k in (80, 81)))
        rows += [(len(rows) + i, " ".join(crowd[k])) for i, k in enumerate(order)]
    before = {t.name for t in spark.catalog.listTables()}
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.of_doc_id)) for r in found} == set(near)
    assert {t.name for t in spark.catalog.listTables()} == before  # dealt tables leave no entry


def test_repeated_words_and_lines_give_few_windows(spark):
    """One word over and over, and one line: stretches of many lengths that texts share, beside words of their own."""
    rng, rows = random.Random(3), []
    line = [word(7 * 10**7 + k) for k in range(9)]

    def own(k):
        return [word(8 * 10**7 + rng.randrange(10**7)) for _ in range(k)]

    for k in (500, 60, 30, 90, 30):
        rows.append((len(rows), " ".join(own(70) + ["again"] * k + own(70))))
    for k in (30, 5, 7, 12):
        rows.append((len(rows), " ".join(own(70) + line * k + own(40) + line[2:] * 9 + own(30))))
    rows.append((len(rows), " ".join(own(20) + line[4:] + line * 8 + own(60) + ["again"] * 55)))
    windows = passages.window_table(spark.createDataFrame(rows, "rid long, text string"), 5, 21).collect()
    assert len(windows) < 400 and max(w.past for w in windows) > 400
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    runs, wrong = check_passages(rows, found)
    assert runs > 700 and wrong == 0


def test_passages(spark, odd):
    shared = prose(10_000, 60)
    rows = [
        (1, prose(0, 80) + " " + shared + " " + prose(100, 90)), (2, prose(300, 200) + " " + shared), (3, prose(600, 200)),
        (4, shared.rsplit(" ", 25)[0] + " " + prose(2000, 100)), (6, prose(600, 200)), (7, prose(600, 200)), (8, shared + " " + shared),
    ]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.start, r.end) for r in found}
    assert {(6, 0, 200), (7, 0, 200)} <= got and {r.of_doc_id for r in found if r.doc_id in (6, 7)} == {3}
    assert {w for r in found if r.doc_id == 8 for w in range(r.start, r.end)} == set(range(120))
    assert any(r.doc_id == 2 and r.start <= 200 and r.end == 260 for r in found) and any(r.doc_id == 1 and r.start <= 80 and r.end >= 140 for r in found)
    assert 4 not in {r.doc_id for r in found} | {r.of_doc_id for r in found}
    assert {r.doc_id for r in passages.repeated_passages(odd).collect()} <= {1, 2, 8, None}
    cut = {r.doc_id: r.text for r in passages.cut_passages(spark.createDataFrame([(*r, "x", [1]) for r in [*rows, (9, None)]], "doc_id long, text string, of string, words array<int>"), spark.createDataFrame(found)).collect()}
    assert cut[6] == "" and cut[9] is None and cut[4] == dict(rows)[4] and prose(300, 200).startswith(cut[2]) and len(cut[2].split()) >= 194


def test_a_run_is_near_one_run_and_texts_meet_once(spark):
    a = np.arange(46, dtype=np.int32)
    apart = np.concatenate([a[:23], np.arange(100, 130, dtype=np.int32), a[23:]])  # all of a, but in no run as long
    assert passages.matching_runs(a, apart, 46, 0.8) == [] and passages.matching_runs(a, np.append(a, 7), 46, 0.8) == [(0, 46, 1.0)]
    words = [w for k in range(6) for w in [word(9 * 10**7 + k)] * 30]
    rows = [(i, " ".join([f"own{i}", *words[i:]])) for i in range(4)]
    texts = spark.createDataFrame(rows, "rid long, text string").selectExpr("rid as row", "rid", "text")
    labelled = passages._grouped(texts, 5, 21).selectExpr("*", "-1 - rid as label")
    pairs = passages._unjoined(labelled, texts, texts, 5, 46, 41)
    assert pairs.count() == pairs.select("rid", "of").distinct().count() == 6


def test_compact_windows_cover_every_run():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 60, 120).astype(np.uint64)
    places = set(passages.compact_windows(h, 10))
    for i, j in itertools.combinations(range(121), 2):
        if j - i >= 10:
            assert i + int(h[i:j].argmin()) in places


def test_boundaries_hang_on_each_line_of_the_window(spark):
    for window in (2, 3):
        for place in range(window):  # of the lines before the boundary
            base = [f"line {i}" for i in range(window)]
            texts = []
            for i in range(40):
                changed = base.copy()
                changed[place] = f"other {i}"
                texts.append(("\n".join([*changed, "end"]),))
            cut = lines.with_chunks(spark.createDataFrame(texts, "text string"), F.col("text"), 2, window)
            begins = [window + 1 in r.starts for r in cut.select("starts").collect()]
            assert 8 < sum(begins) < 32, (window, place)


def test_lines(spark, odd):
    shared = "\n".join(f"shared line {i} of the notice" for i in range(30))
    rows = [(2, "own\n" + shared), (1, shared + "\nmine"), (3, "alone\nand so on")]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == rows[1][1] and out[3].text == rows[2][1] and out[1].lines_removed == 0
    assert out[2].lines_removed > 15 and out[2].text.startswith("own")
    kept = lines.dedup_lines(odd)
    assert kept.count() == 11 and kept.columns == [*odd.columns, "lines_removed"] and unchanged(kept)
    assert {r.doc_id: r.lines_removed for r in kept.collect()}[7] > 3  # its lines repeat within it


def test_langid_held_out(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = langid.identify(docs, model).join(docs.where(langid.held_out(F.col("doc_id"))).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows if r.lang_pred != "und"]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()}
    assert got[3] == got[4] == got[6] == "und" and got[5] != "und"


def plain_top(rows, k=5):
    """Rows (id, integers) by rows: the others of each by exact score, then by id, null last."""
    width = max(len(v) for _, v in rows)
    rows = [(i, [*v, *[0] * (width - len(v))]) for i, v in rows]
    out = []
    for n, (q, v) in enumerate(rows):
        if q is not None and q % 50 == 0:
            others = ((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for m, (i, w) in enumerate(rows) if m != n)
            out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(others)[:k])]
    return sorted(map(repr, out))


def tops(df, **how):
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, **how).collect()
    return sorted(repr((r.query_id, r["rank"], r.vec_id, r.score)) for r in got)


def floors(vectors):
    return [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def test_langid_against_plain_bayes(spark, odd):
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet").where(~langid.held_out(F.col("doc_id")))
    model = langid.train(docs, orders=(1, 2), bits=20)
    counts, sizes = {}, Counter()

    def grams(text):
        t = f" {text.lower()} "
        return [t[i : i + n] for n in (1, 2) for i in range(len(t) - n + 1)]

    bucket = lambda g: int(langid.ngram_hashes(np.array([ord(c) for c in g], np.uint64), len(g), 20)[0])
    for r in docs.collect():
        if r.lang is not None and r.text is not None:
            sizes[r.lang] += 1
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
    names = sorted(sizes)
    assert model.languages == names
    long_text = "ab cé " * 120_000  # over several parts of the walk
    for text in [r.text for r in docs.limit(10).collect()] + ["é", "Was ist das?", long_text]:
        told = Counter(grams(text))
        want = [np.log(sizes[k] / sum(sizes.values())) + sum(n * np.log((counts[k][g] + 0.5) / (sum(counts[k].values()) + 0.5 * 2**20)) for g, n in told.items()) for k in names]
        got = model.log_odds([text])[0]
        assert len({bucket(g) for g in told}) == len(told) and np.allclose(got, want, rtol=1e-9)
    texts = ["one", None, "", "123", "two words"]
    assert model.predict(texts)[0] == [model.predict([t])[0][0] for t in texts] and model.predict([]) [0] == []


def test_topk_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(260)] + [(1000 + i, [0.5] * 8) for i in range(40)]
    vectors += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [1.0] * 3), (2050, [1.0] * 5), (2100, []), (None, [1.0] * 8)]
    vectors += [(1000, [0.5] * 8), (1000, [-0.5] * 8), (50, [0.25] * 8), (50, [0.25] * 8), (None, [0.5] * 8), (None, [0.5] * 8)]
    df = spark.createDataFrame([(*v, 1, 1.0, "x") for v in vectors], "vec_id long, embedding array<double>, block int, score double, query string")
    assert tops(df, block=32, sample=20, pivots=4, query_block=3) == plain_top(floors(vectors))
    assert tops(df.limit(3)) == plain_top(floors([tuple(r)[:2] for r in df.limit(3).collect()]))


@pytest.mark.parametrize("size", [1e6, 5e6])
def test_topk_is_exact_beyond_floats(spark, size):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.uniform(-size, size, 4)]) for i in range(120)]
    vectors += [(1000 + i, [size, size, size, size - i / 256]) for i in range(30)]  # scores that differ in the last digits
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert tops(df, block=16, sample=20, pivots=4) == plain_top(floors(vectors))


@pytest.mark.parametrize("size", [1e8, 1e30])
def test_topk_names_scores_that_fit_no_long(spark, size):
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [size] * 4)], "vec_id long, embedding array<double>"), F.lit(True))


def plain_stats(text):
    text = text or ""
    w = text.encode().split()
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    kept = [x for x in text.split("\n") if x.encode().split()]
    chars = sum(len(x.decode()) for x in w)
    return [len(w), chars, sum(c in "#*$%&|<>" for c in text), len(kept) - len(set(kept)), len(covered)]


def test_quality(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for r in [*docs.limit(40).collect(), *odd.where("doc_id <> 5").collect()]:
        assert quality.document_stats(r.text)[0] == plain_stats(r.text)
    forest = quality.train(docs, labels)
    judged = quality.judge(docs, forest).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in judged]) > 0.9
    x = np.tile(np.array([[6.0, 5, 0, 0, 0, 0.05, 0.7, 0.2, 0, 0.1, 20]]), (50, 1))
    x[:, 2] = np.linspace(0, 4, 50)
    assert (np.diff(forest.probability(x)) <= 1e-12).all()  # more symbols never help
    good = quality.keep_good(odd, labels)
    assert {r.doc_id for r in good.collect()} <= {1, 2, 5, 8, None} and good.columns == odd.columns and unchanged(good)


def walked(forest, x):
    """The probability of one row, tree by tree and node by node."""
    total = forest.base
    for root in forest.root:
        at = root
        while forest.left[at] != at:
            at = forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        total += forest.value[at]
    return 1 / (1 + np.exp(-total))


def test_trees_walk_like_plain_ones_and_hold_on_unseen_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen, unseen = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    forest = quality.train(docs, seen)
    judged = quality.judge(docs, forest)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in judged.collect():
        counts, x = quality.document_stats(texts[r.doc_id])
        score = walked(forest, x)
        assert abs(score - r.score) < 1e-9 and r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert r.kept == (not r.base_failed and score >= 0.35)
    told = judged.join(unseen, "doc_id").where("not base_failed").collect()
    assert len(told) > 60 and np.mean([r.kept == (r.quality == 1) for r in told]) > 0.85
    for f, sign in enumerate(quality.FEATURES.values()):
        x = np.tile(np.array([6.0, 5, 0.01, 0.05, 0, 0.05, 0.7, 0.2, 0.01, 0.1, 20]), (60, 1))
        x[:, f] = np.linspace(0, 3, 60)
        assert not sign or (sign * np.diff(forest.probability(x)) >= -1e-12).all()
    one = quality.judge(docs, quality.train(docs, labels.where("quality = 0"))).where("not base_failed")
    assert one.where("kept").count() == one.count() > 0  # one class teaches nothing
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (6, 7, 0)], labels.schema))
    assert quality.judge(docs, quality.train(docs, twice)).count() == docs.count()  # labels that repeat or are null


def test_urls(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    cases = {
        "http://a.example.org/es/1": ("example.org/es/", "block"), "https://EXAMPLE.org/en/123?x": ("example.org/en/1", "block"),
        "http://example.org": (None, "allow"), "http://example.org/": ("org/", "allow"), "http://notexample.org/es/": ("org/", "allow"),
        "x://com/de/": ("com/de/", "block"), "http://b.com/fr/#f": ("com/fr/", "allow"), "no scheme": (None, "allow"), None: (None, "allow"),
        "": (None, "allow"), "http://b.com/x/": (None, "allow"),
    }
    pages = spark.createDataFrame([(None if i == 2 else i, u, "clash", "p") for i, u in enumerate(cases)] * 2, "page_id long, url string, rule string, path string")
    got = urls.judge_urls(pages, rules).collect()
    assert len(got) == 2 * len(cases)
    for i, want in enumerate(cases.values()):
        assert {(r.rule, r.verdict) for r in got if r.page_id == (None if i == 2 else i)} == {want}


def test_urls_of_very_long_hosts(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, ("", "/all/", "block"), ("a.b.c.com", "", "block")], "host string, path string, verdict string")
    host = ".".join(["x"] * 20_000)
    cases = [f"http://{host}.example.org/es/1", f"http://{host}.a.b.c.com/q", "http://a.b.c.com", "http://.com/fr/", "http://com./fr/", "http://c.com/all/x"]
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: r.rule for r in urls.judge_urls(pages, rules).collect()}

    def plain(url):
        place = url.split("://")[1]
        at, path = place.split("/")[0], place[len(place.split("/")[0]) :]
        fits = [h + p for h, p, _ in map(tuple, rules.collect()) if (at == h or at.endswith("." + h)) and path.startswith(p)]
        return max(sorted(fits), key=len, default=None)

    assert got == {i: plain(u) for i, u in enumerate(cases)}


def test_mix_takes_whole_documents_near_the_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    target = {r.source: r.target for r in mixing.mix_plan(docs).collect()}
    taken, times = dict.fromkeys(target, 0), {}
    for r in mixing.mix_documents(docs).collect():
        taken[r.source] += size[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(n <= 2 for n in times.values())
    for s, want in target.items():
        assert abs(taken[s] - want) <= max(n for d, n in size.items() if source[d] == s)
    assert sorted(map(repr, mixing.mix_documents(docs).collect())) == sorted(map(repr, mixing.mix_documents(docs).collect()))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.spool(stage(spark, docs, SF), name.replace(" ", "-"))
        assert docs.columns == columns, name
        assert docs.count() > 50
        ids = sorted(r.doc_id for r in docs.collect())
        if name == "quality rules":
            judged = quality.judge(before, quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
            assert ids == sorted(r.doc_id for r in judged if r.kept)
        elif name == "line dedup":
            assert ids == sorted(r.doc_id for r in before.collect()) and all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near dedup":
            assert ids == stays([(r.doc_id, r.text) for r in before.collect()])
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()
