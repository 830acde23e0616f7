"""Near duplicates: vectors and texts, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import components, embedding_dedup, jaccard_join
from evidentia.llm.common import Unions, WordHashes, shingles


def brute(n, linked):
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            m = min(comp[i], comp[j])
            if comp[i] != m or comp[j] != m:
                comp[i] = comp[j] = m
                changed = True
    return comp


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unions_keep_the_smallest():
    u = Unions(6)
    u.absorb(np.array([5, 3]), np.array([3, 1]))
    assert u.label.tolist() == [0, 1, 2, 1, 4, 1]


def vectors(seed=1, n=300):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 16))
    for i in range(0, n, 5):
        base[i + 1] = base[i] + 0.12 * rng.standard_normal(16)
        base[i + 2] = base[i] * 3
    base[n - 1] = base[0]
    return base


def test_vectors_match_brute_force(spark):
    x = vectors()
    odd = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] + [1.0] * 15), (9005, [None] + [1.0] * 15), (9006, [float("inf")] * 16), (9007, [1.0, 2.0])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = [(i, j) for i in range(len(x)) for j in range(i) if u[i] @ u[j] >= 0.9]
    comp, n = brute(len(x), linked), np.bincount(np.array(linked).ravel(), minlength=len(x))
    assert len(linked) > 100
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], comp[i], comp[i] == i)
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_vectors_empty_null_and_repeated_ids(spark):
    f = embedding_dedup.near_duplicates
    assert f(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = f(spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in rows) == [(0, 2, 3), (3, 2, 3), (3, 2, 3)]


def test_vectors_move_once_per_block(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    reps = embedding_dedup.projected(df, "vec_id", "embedding").selectExpr("row as node", "1L as copies", "dim", "norm", "vec", "proj")
    dealt = embedding_dedup.deal(reps).selectExpr("node", "octet_length(vec) + octet_length(proj) as size").groupBy("node").agg({"size": "sum", "*": "count"}).collect()
    assert len(dealt) == 300 and {(r["count(1)"], r["sum(size)"]) for r in dealt} == {(embedding_dedup.LEAST_BLOCKS, embedding_dedup.LEAST_BLOCKS * (64 * 4 + embedding_dedup.PROJECTIONS * 4))}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_in_many_small_blocks_match_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 2000)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((40, 16))
    x = np.vstack([base + 0.15 * rng.standard_normal(base.shape) for _ in range(5)]).astype(np.float32 if kind == "float" else np.float64)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[row].min() for row in near])
    assert got == {i: (int(near[i].sum()) - 1, int(label[i])) for i in range(len(x))} and near.sum() > 2 * len(x)


def test_window_calibration():
    w = embedding_dedup.half_width()
    rng = np.random.default_rng(5)
    d = np.sqrt(0.2) * rng.standard_normal((20_000, embedding_dedup.PROJECTIONS))
    passed = (np.abs(d) <= w).sum(1) >= embedding_dedup.PROJECTIONS - embedding_dedup.GROUPS + 1
    assert passed.mean() > 0.999


def texts(seed=2, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    common = [rng.choice(vocabulary) for _ in range(60)]  # a passage many share
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        if i % 3 == 0:
            words = words[:20] + common + words[20:]
        if i % 4 == 1 and out:
            words = out[rng.randrange(len(out))].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return out


def test_texts_match_brute_force(spark):
    body = texts()
    hashes = WordHashes()
    sets = [set(shingles(t, hashes).tolist()) for t in body]
    linked = [(i, j) for i in range(len(body)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    comp, n = brute(len(body), linked), np.bincount(np.array(linked).ravel(), minlength=len(body))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(body)], "doc_id long, text string, node string")
    got = {r.doc_id: r for r in jaccard_join.join(df).collect()}
    assert len(linked) > 10
    for i in range(len(body)):
        assert (got[i].class_id, got[i].n_links) == (comp[i], n[i])
    assert sorted(r.doc_id for r in jaccard_join.deduplicate(df).collect()) == sorted(set(comp))


def test_blocks_of_a_large_group_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "VERIFY_BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 8)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :])) for i in range(50)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 49)}


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, "a " * 50_000), (7, "a " * 50_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in jaccard_join.join(df).collect())
    assert got == [(0, 4, 3), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 3), (5, 4, 3), (5, 4, 3), (6, 6, 1), (7, 6, 1)]
    assert sorted(r.doc_id for r in jaccard_join.deduplicate(df).collect()) == [1, 2, 3, 4, 6]
    assert jaccard_join.join(df.limit(0)).count() == 0 and jaccard_join.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("left,right", [([{1, 2, 3}], [{2, 3}, {9}]), ([set(range(50)), set(range(25, 99))] * 9, None)])
def test_overlaps(left, right):
    as_arrays = lambda xs: [np.array(sorted(x), np.uint64) for x in xs]
    want = [[len(x & y) for y in (left if right is None else right)] for x in left]
    assert jaccard_join.overlaps(as_arrays(left), None if right is None else as_arrays(right)).tolist() == want


def test_buckets_of_many_blocks(spark, monkeypatch):
    """Links between the blocks of a crowded bucket are found, also where blocks alone don't connect."""
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "VERIFY_BLOCK", 4)
    # Each text moves four words on from the one before: 76 of 84 shingles are shared with it.
    texts = [" ".join(f"w{j}" for j in range(4 * i, 4 * i + 84)) for i in range(40)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(80)} for t in texts]
    near = [[len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets]
    got = {r.doc_id: r for r in jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: (got[i].class_id, got[i].n_links) for i in got} == {i: (0, sum(near[i]) - 1) for i in range(40)}


def test_classes_that_share_an_id_or_have_none_keep_a_row_each(spark):
    """Repeated ids with different texts and null ids don't merge the choice of keepers."""
    text = lambda name, change=None: " ".join(f"{name}{i}" if i != change else "changed" for i in range(80))
    # Every unrelated text under the id of a linked class, so that some digest is below its keeper's.
    rows = [(5, text("a")), (7, text("a", 3)), *((5, text(f"u{i}x")) for i in range(8))]
    rows += [(None, text("p")), (None, text("p", 9)), (None, text("q")), (None, text("q", 9)), (None, text("alone"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text.split()[0]) for r in jaccard_join.deduplicate(df).collect())
    assert got == sorted([(5, "a0"), *((5, f"u{i}x0") for i in range(8)), (0, "p0"), (0, "q0"), (0, "alone0")])
    nodes = {}
    for r in jaccard_join.join(df).collect():
        nodes.setdefault(r.class_node, []).append(r.n_links)
    assert sorted(nodes.values()) == [[0]] * 9 + [[1, 1]] * 3


def test_prefixes_follow_the_texts():
    """Short texts can only have very similar links, so their prefix stays longer."""
    for n in range(1, 40):
        similar = [c / (n + m - c) for c in range(1, n + 1) for m in range(c, 60) if c / (n + m - c) >= 0.8]
        assert abs(jaccard_join.least_similarity(n) - min(similar)) < 1e-9
        s, d = min(similar), jaccard_join.floor(n)
        assert 1 - (1 - s**d) ** jaccard_join.TREES >= jaccard_join.TARGET_RECALL
    assert {jaccard_join.floor(n) for n in (3, 7, 6, 100)} == {8, 6, 5, 4}


def test_recall_where_prefixes_differ(spark):
    """Short pairs (prefixes of 5 to 8) and long pairs (4) near the threshold are all found."""
    rows, pairs = [], 0
    for i in range(150):
        size = (7, 10, 11, 64)[i % 4]  # words, so 3, 6, 7 or 60 shingles
        words = [f"p{i}w{k}" for k in range(size)]
        other = words[:-1] if size in (10, 11) else words if size == 7 else [*words[:-6], *(f"q{i}w{k}" for k in range(6))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other) + (" " if size == 7 else ""))]
        pairs += 1
    got = {r.doc_id: r.n_links for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got.values()) >= 0.99 * 2 * pairs


def test_climbing_a_trie_finds_what_its_prefixes_allow():
    rng = np.random.default_rng(3)
    label = rng.integers(0, 3, (300, jaccard_join.LABEL)).astype(np.uint8)
    label = label[np.lexsort(label.T[::-1])]
    lowest = rng.choice([1, 2, 4, 6], 300)
    sketch = rng.integers(0, 2, (300, 12)).astype(np.uint8)
    found = jaccard_join.climb(label, lowest, sketch, 10, 1)
    prefix = lambda i, j: int((label[i] == label[j]).cumprod().sum())
    linked = [(i, j) for i in range(300) for j in range(i) if prefix(i, j) >= max(lowest[i], lowest[j]) and (sketch[i] == sketch[j]).sum() >= 10]
    assert len(linked) > 20 and list(found.label) == brute(300, linked)


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([(1, "a b c", 7, "x"), (2, "a b c", 8, "y")], "doc_id long, text string, _i long, _digest string").withColumns({"_h": F.lit(1), "k": F.lit(2), "_id": F.lit(3)})
    assert [tuple(r) for r in jaccard_join.deduplicate(df).collect()] == [(1, "a b c", 7, "x", 1, 2, 3)]


def test_vectors_whose_lengths_are_far_apart(spark):
    rows = [(i, [1.0] * n) for i, n in enumerate([2, 4098, 2, 4098, 4098])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [(0, 1, 0), (1, 2, 1), (2, 1, 0), (3, 2, 1), (4, 2, 1)]


def test_components_join_an_edge_until_its_ends_meet(spark, monkeypatch):
    import random

    sizes = []
    kept = components.cut
    monkeypatch.setattr(components, "cut", lambda df: (out := kept(df), sizes.append((out.columns, out.count())))[0])
    rng = random.Random(3)
    edges = list({(rng.randrange(1, 400), rng.randrange(8)) for _ in range(3000)}) + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    want = brute(len(nodes), [(at[a], at[b]) for a, b in edges])
    assert got == {n: nodes[want[at[n]]] for n in nodes}
    left = [n for names, n in sizes if names == ["a", "b"]]
    assert left[1:] and max(left[1:]) < left[0] / 10  # edges that are joined again
