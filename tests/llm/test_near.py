"""Near-duplicates, exact top-k and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from huestrata.llm import ann, catalog, maxscore, simhash
from huestrata.llm.components import connected
from tests.llm.helpers import LARGER, SMALL, documents, odd_texts, table


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    n = simhash.SHINGLE
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    """Root index by index, by comparing all pairs."""
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= simhash.DISTANCE:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def near_texts():
    rng = random.Random(5)
    out = []
    for _ in range(25):
        words = [rng.choice("abcdefghij") * rng.randrange(1, 6) for _ in range(300)]
        for _ in range(4):
            copy = words[:]
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(300)] = "changed"
            out.append(" ".join(copy))
    return out


def test_fingerprint_by_hand():
    for text in odd_texts() + near_texts():
        assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_fingerprint_of_a_long_text_in_windows(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(1000))
    want = simhash.fingerprint(text)
    for window in (1, 2, 7, 999):
        monkeypatch.setattr(simhash, "WINDOW", window)
        assert simhash.fingerprint(text) == want


def test_components_equal_all_pairs(spark):
    texts = odd_texts() + near_texts() + [r.text for r in table(spark, "documents").collect()]
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts).repartition(4)).collect()}
    values = [plain_fingerprint(t) for t in texts]
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == values
    assert [got[i].component_id for i in range(len(texts))] == plain_components(values)


@pytest.mark.parametrize("cell", [20_000, 8])
def test_links_within_full_cells(spark, monkeypatch, cell):
    """Fingerprints in tight groups: the same components whether cells are walked or split."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(1)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            v = centre
            for _ in range(rng.randrange(6)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in connected(simhash.near_links(df), "a", "b").collect()}
    got = [roots.get(v, v) for v in signed]
    want = plain_components(values)
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(got)) == len(set(want))


def test_cells_cover_the_range():
    """Two values at most three bits apart share a cell, whatever bits differ."""
    rng = random.Random(2)
    masks = simhash._cells()
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        ea, eb = (int(x) for x in simhash.embed(np.array([a, b], dtype=np.uint64)))
        assert bin(ea ^ eb).count("1") <= bin(a ^ b).count("1")
        assert any(ea & m == eb & m for m in masks)


def test_near_duplicates_without_ids_and_without_rows(spark):
    docs = documents(spark, ["same old text again", "same old text again", None, ""], [None, None, 7, 7])
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in rows if r.fp) == [(True, None), (True, None)]
    assert [r.component_id for r in rows if not r.fp] == [7, 7]
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    star = [(200, i) for i in range(201, 260)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain + star, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and {got[i] for i in range(200, 260)} == {200}
    assert 5 in got and len(got) == 41 + 2 + 60


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vector array<long>")


def brute_top(queries, rows, k):
    out = []
    for q, own in queries:
        scores = sorted((-int(np.dot(own, v)), i) for i, v in rows if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale, step, shard", [(256, 64, 8192), (3, 16, 64), (1, 5, 10**6), (2**26, 64, 300)])
def test_top_k_equals_all_pairs(spark, monkeypatch, scale, step, shard):
    monkeypatch.setattr(maxscore, "BLOCK_POSTINGS", step)
    monkeypatch.setattr(maxscore, "SHARD_ROWS", shard)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 7)
    rng = np.random.default_rng(scale)
    vectors = [(int(i), [int(x) for x in v]) for i, v in enumerate(rng.integers(-scale, scale + 1, (500, 24)))]
    df = embeddings(spark, vectors + vectors[:9] + [(None, [1] * 24), (600, None)])
    queries = [x for x in vectors if x[0] % 20 == 0]
    got = maxscore.top_k(df.filter("vec_id % 20 = 0"), df, 5)
    assert sorted(map(tuple, got.collect())) == brute_top(queries, vectors, 5)


def sparse_rows(rng, count, width):
    """Few terms to a vector, and impacts of very different size, as in text."""
    out = []
    for i in range(count):
        v = np.zeros(width)
        at = rng.choice(width, 6, replace=False, p=1 / np.arange(1, width + 1) / (1 / np.arange(1, width + 1)).sum())
        v[at] = np.ceil(rng.pareto(1.2, 6) * 10) * rng.choice([1, 1, 1, -1], 6)
        out.append(v)
    return np.array(out)


@pytest.mark.parametrize("block", [1, 16, 64])
def test_postings_are_skipped_and_few_vectors_are_looked_up(monkeypatch, block):
    monkeypatch.setattr(maxscore, "BLOCK_POSTINGS", block)
    rng = np.random.default_rng(block)
    vectors = sparse_rows(rng, 3000, 80)
    shard = maxscore.Shard(np.arange(3000), vectors)
    queries = sparse_rows(rng, 60, 80)
    whole = 0
    for own, query in enumerate(queries):
        ids, scores = shard.best(own, query, 5)
        every = vectors @ query
        want = [i for i in np.lexsort((np.arange(3000), -every)) if i != own][:5]
        assert ids.tolist() == want and scores.tolist() == every[want].tolist()
        whole += sum(len(shard.lists[2 * d + (query[d] < 0)][0]) for d in np.flatnonzero(query))
    assert shard.probed < 0.2 * len(queries) * len(vectors)
    assert shard.read < 0.97 * whole
    assert shard.read + shard.probed < len(queries) * len(vectors)


def test_top_k_beside_columns_of_clashing_names(spark):
    rows = [(i, [i, -i, i % 3]) for i in range(30)]
    df = embeddings(spark, rows).withColumns({c: F.lit("x") for c in ("rank", "score", "query_id", "shard", "block")})
    got = maxscore.top_k(df.filter("vec_id < 3"), df, 4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(rows[:3], rows, 4)


def test_top_k_with_few_rows(spark):
    df = embeddings(spark, [(0, [1, 2]), (1, [3]), (2, [])])
    got = sorted(map(tuple, maxscore.top_k(df.filter("vec_id = 0"), df, 5).collect()))
    assert got == [(0, 1, 1, 3), (0, 2, 2, 0)]
    assert maxscore.top_k(df.filter("false"), df, 5).collect() == []
    assert maxscore.top_k(df, df.filter("false"), 5).collect() == []


def test_whole_components(spark):
    df = spark.createDataFrame(
        [(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, None), (5, [float("inf")])],
        "i int, v array<float>",
    )
    got = {r.i: r.w for r in df.select("i", maxscore.whole(F.col("v")).alias("w")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None}


def brute_nearest(spark, folder, k):
    rows = table(spark, "embeddings", folder).orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    out = {}
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        out[int(q)] = [(int(ids[i]), d[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


def test_recall_of_the_graph_search(spark):
    want = brute_nearest(spark, LARGER, 10)
    got = {}
    for r in catalog.op3_nn_descent(spark, LARGER).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q, rows in want.items():
        hits += len({i for i, _ in rows} & {i for i, _ in got[q]})
        true = dict(rows)
        assert len(got[q]) == 10 and [s for _, s in got[q]] == sorted(s for _, s in got[q])
        assert all(abs(s - true[i]) < 1e-12 for i, s in got[q] if i in true)
    assert hits / (10 * len(want)) >= 0.9


def test_small_leaves_many_rounds_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 40)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 8)).round(3)
    rows = [(i, [float(x) for x in base[i]]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # one large group of copies
    rows += [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (None, rows[3][1]), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    queries = df.filter("vec_id in (0, 7, 1003, 250, 5000, 5001)")
    got = {}
    for r in ann.search(ann.build(df, members=5), queries, 4, beam=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 7, 1003, 250}
    assert got[0] == [(1000, 0.0), (1001, 0.0), (1002, 0.0), (1003, 0.0)]
    assert got[1003] == [(0, 0.0), (1000, 0.0), (1001, 0.0), (1002, 0.0)]
    all_rows = [(i, np.array(v)) for i, v in rows if i is not None and v and np.isfinite(v).all() and any(v)]
    all_rows = list({i: (i, v) for i, v in all_rows}.values())
    for q in (7, 250):
        d = sorted((float(np.sqrt(((v - base[q]) ** 2).sum())), i) for i, v in all_rows if i != q)[:4]
        assert [i for i, _ in got[q]] == [i for _, i in d]


def nearest_of(spark, v, kind, k, queries):
    """Share of the true k nearest that are found for ``queries`` (row numbers of ``v``)."""
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"vec_id long, vector array<{kind}>")
    found = ann.search(ann.build(df, members=k + 1), df.filter(F.col("vec_id").isin([int(q) for q in queries])), k)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    v, hits = v.astype(np.float32 if kind == "float" else float).astype(float), 0
    for q in queries:
        d = ((v - v[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:k].tolist()))
    return hits / (k * len(queries))


@pytest.mark.parametrize("kind, noise", [("float", 1e-4), ("double", 1e-9)])
def test_recall_in_a_group_of_near_copies(spark, kind, noise):
    """A third of the rows lie closer together than a step of 8 bits, or than float32 can tell."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((2400, 16))
    v[:800] = v[0] + noise * rng.standard_normal((800, 16))
    assert nearest_of(spark, v / np.linalg.norm(v[0]), kind, 10, range(0, 800, 20)) >= 0.9


def test_graph_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, vector array<double>")
    assert ann.search(ann.build(df, members=3), df, 2).collect() == []
    none = df.filter("false")
    assert ann.search(ann.build(none, members=3), df, 2).collect() == []


def test_op5_format(spark):
    rows = catalog.op5_simhash(spark, SMALL).collect()
    assert len(rows) == table(spark, "documents").count()
    assert all(len(r.fingerprint) == 16 and r.component_id <= r.doc_id for r in rows)


def test_near_duplicates_beside_columns_of_clashing_names(spark):
    texts = ["one two three four", "one two three four", "something else here now"]
    docs = documents(spark, texts).withColumns({c: F.lit("x") for c in ("fp", "component_id", "root", "smallest", "node")})
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_graph_of_very_long_vectors_beside_columns_of_clashing_names(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((60, 5000))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, vector array<double>")
    rows = rows.withColumns({c: F.lit("x") for c in ("node", "code", "leaves", "members", "place", "score", "rank")})
    index = ann.build(rows, members=4)
    got = {}
    for r in ann.search(index, rows.filter("vec_id < 3"), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(3):
        d = ((vectors - vectors[q]) ** 2).sum(axis=1)
        assert got[q] == [int(i) for i in np.argsort(d) if i != q][:3]
