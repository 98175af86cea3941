"""Top-k search, centroid clustering and phrase mining against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor, isfinite

import numpy as np
import pytest

from vellum.llm import centroids, frequent, mtree, phrases
from vellum.llm.frequent import MisraGries

VECS = "vec_id long, embedding array<double>, label int, score long, pivot string, part int, x string, rank int"


def vectors(spark, rows):
    """(vec_id, embedding) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, 1, 9, "p", 2, "y", 4) for i, v in rows], VECS)


def valid(v):
    return v is not None and all(c is not None and isfinite(c) for c in v)


@pytest.fixture(scope="module")
def points():
    """Tight groups, copies, equal ids, null ids, other lengths, bad vectors."""
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(900)]
    rows += [(2000 + i, rows[7][1]) for i in range(40)]  # one vector many times
    rows += [(100, rows[100][1]), (100, rows[100][1]), (100, rows[3][1]), (None, rows[200][1]), (None, rows[200][1])]
    rows += [(3000, None), (3010, []), (3020, []), (3030, [1.0, None] + [0.0] * 4), (3040, [float("nan")] * 6), (3050, [float("inf")] + [0.0] * 5)]
    rows += [(3060 + 10 * i, [rng.gauss(0, 1) for _ in range(2)]) for i in range(4)] + [(3100, [0.0] * 6), (3110, [-0.0] * 6)]
    rng.shuffle(rows)
    return rows


def brute_top(rows, k, every, scale):
    scaled = [(i, [floor(scale * c) for c in v]) for i, v in rows if valid(v)]
    out = []
    for a, (q, x) in enumerate(scaled):
        if q is None or q % every:
            continue
        scores = [(-sum(s * t for s, t in zip(x, y)), i is None, i) for b, (i, y) in enumerate(scaled) if a != b and len(y) == len(x)]
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda t: (t[0], t[1], t[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,tree_bytes", [(10, 32 << 20), (3, 4000)])
def test_top_products_match_brute_force(spark, points, monkeypatch, k, tree_bytes):
    monkeypatch.setattr(mtree, "TREE_BYTES", tree_bytes)  # small: a routing object has several trees
    got = mtree.top_products(vectors(spark, points).repartition(3), k=k, every=10).collect()
    assert sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got), key=repr) == brute_top(points, k, 10, 1024)


def test_top_products_of_few_and_no_rows(spark):
    few = [(0, [1.0, 2.0]), (100, [0.5, 0.5]), (1, [3.0, -1.0])]
    got = mtree.top_products(vectors(spark, few)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(few, 10, 100, 1024)
    assert mtree.top_products(vectors(spark, [])).collect() == []
    assert mtree.top_products(vectors(spark, [(1, [1.0]), (2, None)])).collect() == []
    with pytest.raises(Exception, match="component"):
        mtree.top_products(vectors(spark, [(0, [1e9]), (1, [1.0])])).collect()


@pytest.mark.parametrize("components", [3, 40])
def test_tree_covers_its_entries_and_skips_far_pages(components):
    rng = np.random.default_rng(components)
    x = np.floor(rng.normal(size=(40, components)).repeat(60, axis=0) * 2000 + rng.normal(size=(2400, components)) * 20).astype(np.int64)
    nodes = mtree.build(x)
    seen = np.concatenate([n[5] for n in nodes if n[5] is not None])
    assert sorted(seen.tolist()) == list(range(len(x)))
    centre = {n[0]: n[2] for n in nodes}
    for node, parent, c, radius, away, entries, distances in nodes:
        if entries is not None:
            assert len(entries) <= mtree.PAGE and np.allclose(distances, np.linalg.norm(x[entries] - c, axis=1)) and distances.max() <= radius + 1e-9
            assert (np.diff(distances) >= 0).all()
        if parent >= 0:
            assert np.isclose(away, np.linalg.norm(c - centre[parent]))
    norm = (x * x).sum(axis=1)
    def below(n):
        return [n[5]] if n[5] is not None else [e for m in nodes if m[1] == n[0] for e in below(m)]
    pages = [{"node": n[0], "parent": n[1], "radius": n[3], "away": n[4], "norm": float(norm[np.concatenate(below(n))].max()),
              "centre": n[2].astype("<i4").tobytes(), **({"vecs": None} if n[5] is None else
              {"ids": [int(e) for e in n[5]], "copies": np.zeros(len(n[5]), np.int32).tobytes(), "vecs": x[n[5]].astype("<i4").tobytes(), "distances": n[6].tobytes()})}
             for n in nodes]
    tree = mtree.Tree(pages, "<i4", components)
    scores, rank, computed = tree.search([5, 77], x[[5, 77]], np.array([np.nan, np.nan]), 10)
    for q, s, r in zip([5, 77], scores, rank):
        all_scores = x @ x[q]
        all_scores[q] = -1 << 60
        best = np.lexsort((np.arange(len(x)), -all_scores))[:10]
        assert [tree.ids[i] for i in r] == best.tolist() and s.tolist() == all_scores[best].tolist()
    assert computed < len(x)  # two queries: brute force computes twice as many


def brute_clusters(rows, width, scale, k, rounds, seed):
    kept = [(i, tuple(floor(scale * c) for c in v)) for i, v in rows if valid(v) and len(v) == width]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    cs = [x for _, x in first]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min(range(len(cs)), key=lambda j: (dist(x, cs[j]), j))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[near(x)].append(x)
        cs = [tuple(sum(c) // len(groups[j]) for c in zip(*groups[j])) if j in groups else cs[j] for j in range(len(cs))]
    own = [(i, near(x), x) for i, x in kept]
    inertia = Counter()
    for _, j, x in own:
        inertia[j] += dist(x, cs[j])
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, j, dist(x, cs[j]), inertia[j], sum(inertia.values()), sha[j]) for i, j, x in own), key=repr)


def test_clusters_match_brute_force_and_boxes_leave_centroids_out(spark, points):
    df = vectors(spark, points)
    got = centroids.clusters(df.repartition(3), width=6, k=9, rounds=3).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got), key=repr) == \
        brute_clusters(points, 6, 256, 9, 3, 2)
    assert min(r.compared for r in got) < 9
    few = [(5, [1.0, 2.0]), (6, [1.0, 2.0]), (6, [0.0, 0.0]), (None, [9.0, 9.0]), (7, None), (8, [1.0])]
    got = centroids.clusters(vectors(spark, few), width=2).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got), key=repr) == brute_clusters(few, 2, 256, 40, 5, 2)
    assert centroids.clusters(vectors(spark, [])).collect() == []
    assert centroids.clusters(vectors(spark, [(1, [1.0])])).collect() == []


def test_box_candidates_hold_the_nearest():
    rng = np.random.default_rng(3)
    left = []
    for _ in range(200):
        c = rng.integers(-50, 50, (12, 3))
        low = rng.integers(-60, 60, 3)
        high = low + rng.integers(0, 20, 3)
        some = centroids.candidates(low, high, c)
        x = rng.integers(low, high + 1, (50, 3))
        nearest = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        assert set(nearest) <= set(some)
        left.append(len(some))
    assert np.mean(left) < 6


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (5, 2)])
def test_hilbert_curve_visits_neighbours(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    place = centroids.hilbert(grid, bits)
    assert sorted(place.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def brute_phrases(rows, least, longest, covered, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(w[s:s + m] for s in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        known = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        inside = defaultdict(int)
        for p, a in known.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    inside[p[s:s + m]] = max(inside[p[s:s + m]], a)
        rows = []
        for p, a in known.items():
            score, _, left, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < covered * a:
                rows.append((-score, -a, " ".join(p).encode(), left, r))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(t, lang, 1, 2, "p", 3) for t, lang in rows], "text string, lang string, n long, f long, phrase string, a long")
    return sorted(tuple(r) for r in phrases.collocations(df.repartition(4), **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("capacity", [1 << 18, 300])
def test_collocations_match_brute_force(spark, monkeypatch, capacity):
    monkeypatch.setattr(frequent, "CAPACITY", capacity)  # small: many hash partitions, summaries that cut
    rng = random.Random(4)
    words = ["Straße", "été", "中文", "A", "the", " x", "z w", *(f"w{i}" for i in range(30))]
    def prose(n):
        return "".join(words[min(int(rng.expovariate(0.15)), len(words) - 1)] + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "!"]) for _ in range(n))
    rows = [(prose(rng.randint(0, 60)), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    rows += [("Once upon a time there WAS one", "en")] * 40 + [("upon a time", "en")] * 4 + [(None, "en"), ("", None), (" \t\n", "fr"), ("very rare words", "xx")]
    rows += [(prose(6000), "en"), ("a a a a a a a", "de"), ("Aİ", "en"), ("x" * 3000, "en")] + [("same. same", "de")] * 3
    assert mined(spark, rows, least=8) == brute_phrases(rows, 8, 4, 80, 2000)
    assert mined(spark, rows, least=5, top=7) == brute_phrases(rows, 5, 4, 80, 7)


def test_collocations_of_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("", "en"), ("too rare to count", "en")]) == []
    assert mined(spark, [("b a", "en")] * 30 + [("c d", "en")] * 30) == brute_phrases([("b a", "en")] * 30 + [("c d", "en")] * 30, 30, 4, 80, 2000)


@pytest.mark.parametrize("capacity,parts", [(1, 1), (40, 1), (400, 1), (3000, 1), (3000, 3)])
def test_summaries_keep_every_frequent_key(capacity, parts):
    rng = np.random.default_rng(capacity)
    least, keys = 30, np.minimum(rng.zipf(1.3, 60_000), 10_000).astype(np.uint64)
    merged = MisraGries(capacity, least)
    for stream in np.array_split(keys, parts):
        own = MisraGries(capacity, least)
        for part in np.array_split(stream, 120 // parts):
            own.add(*np.unique(part, return_counts=True))
        merged.merge(own)
    keys, counts = np.unique(keys, return_counts=True)
    assert set(keys[counts >= least].tolist()) <= set(merged.frequent().tolist()) and merged.error < least
    true = dict(zip(keys.tolist(), counts.tolist()))
    assert all(c <= true[k] <= c + merged.error for k, c in zip(merged.keys.tolist(), merged.counts.tolist()))
    if capacity == 3000:  # above the mass divided by the threshold
        assert len(merged.keys) <= 4 * capacity


def test_summaries_too_small_for_their_mass_do_not_merge():
    one, two = MisraGries(4, 30), MisraGries(4, 30)
    for summary in (one, two):
        for k in range(400):
            summary.add(np.arange(k, k + 20, dtype=np.uint64), np.full(20, 1))
        summary.compress()
        assert 15 <= summary.error < 30
    with pytest.raises(ValueError):
        one.merge(two)


def test_hashes_are_counted_in():
    rng = np.random.default_rng(3)
    keys, counts, every = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    for size in (0, 1, 500, 0, 2000, 30):
        raw = [rng.integers(0, 700, size, dtype=np.uint64), rng.integers(600, 1 << 64, size // 2, dtype=np.uint64)]
        keys, counts = frequent.counted_in(keys, counts, raw)
        every = np.concatenate([every, *raw])
        want = np.unique(every, return_counts=True)
        assert (keys == want[0]).all() and (counts == want[1]).all()
    assert frequent.counted_in(keys, counts, [])[0] is keys
