"""The sorted-list search: its bounds close before the lists end, and its results are those of brute force."""

import numpy as np
import pytest

from scriptorium.llm import topk


def brute(x, ids, q, k):
    s = x @ x[q]
    s[ids == ids[q]] = -np.inf
    order = [r for r in np.lexsort((ids, -s)) if s[r] > -np.inf][:k]
    return [(int(s[r]), int(ids[r])) for r in order]


def found(x, ids, asked, block, k=5):
    best = topk.Best(len(asked), k)
    for a in range(0, len(x), block):
        topk.search_block(x[asked], ids[asked], x[a : a + block], ids[a : a + block], best)
    rows = [[(int(s), int(i)) for s, i in zip(best.score[n], best.id[n], strict=True) if s > -np.inf] for n in range(len(asked))]
    return rows, best.read


KINDS = {
    "even": lambda rng: rng.normal(size=(900, 16)) * 80,
    "decaying": lambda rng: rng.normal(size=(900, 16)) * 200 * 0.6 ** np.arange(16),
    "heavy": lambda rng: rng.standard_cauchy((900, 16)) * 50 * 0.8 ** np.arange(16),
    "ties": lambda rng: rng.integers(-1, 2, (900, 16)) * 10.0,
    "zeros": lambda rng: np.zeros((900, 16)),
    "repeated": lambda rng: np.tile(rng.normal(size=(9, 16)) * 80, (100, 1)),
    "narrow": lambda rng: rng.normal(size=(900, 1)) * 80,
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("block", [3, 128, 900])
def test_search_equals_brute_force(kind, block):
    x = np.floor(KINDS[kind](np.random.default_rng(4)))
    ids = np.random.default_rng(5).permutation(900)
    asked = np.arange(0, 900, 45)
    rows, _ = found(x, ids, asked, block)
    assert rows == [brute(x, ids, q, 5) for q in asked]


@pytest.mark.parametrize("kind,most", [("decaying", 0.5), ("heavy", 0.3)])
def test_reading_stops_before_the_lists_end_where_the_bounds_close(kind, most):
    x = np.floor(np.concatenate([KINDS[kind](np.random.default_rng(seed)) for seed in range(8)]))
    _, read = found(x, np.arange(len(x)), np.arange(0, len(x), 200), 1800)
    share = read[:, 0] / read[:, 2]
    assert (read[:, 1] > 0).all() and np.median(share) < most and share.max() < 0.9
    assert (read[:, 1] <= 4 * topk.RESOLVED * 5).all()  # of four blocks


def test_candidates_beyond_the_floor_of_earlier_blocks_cost_less():
    x = np.floor(KINDS["even"](np.random.default_rng(1)))
    lists = topk.Lists(x)
    none = np.zeros(len(x), dtype=bool)
    _, _, without, _ = topk.search(lists, x[0], none, -np.inf, 5)
    rows, _, read, _ = topk.search(lists, x[0], none, float(np.abs(x[0]) @ np.abs(x).max(axis=0)) + 1, 5)
    assert not len(rows) and read < without


def test_how_far_was_read_is_told(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.standard_cauchy((3000, 12)) * 0.8 ** np.arange(12))]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x, ids = np.floor(256 * np.array([v for _, v in rows])), np.arange(3000)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(q, k + 1, i, s) for q in range(0, 3000, 50) for k, (s, i) in enumerate(brute(x, ids, q, 5))]
    assert all(0 < r.read_share < 1 and r.resolved > 0 for r in got) and np.median([r.read_share for r in got]) < 0.4
    empty = topk.top_k(spark.createDataFrame([(0, []), (1, []), (50, [])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score, r.read_share) for r in empty) == [(0, 1, 1, 0, 0.0), (0, 2, 50, 0, 0.0), (50, 1, 0, 0, 0.0), (50, 2, 1, 0, 0.0)]


@pytest.mark.parametrize("scale", [1, 10**5])
def test_even_queries_read_together(monkeypatch, scale):
    alone, inner = [], topk.search
    monkeypatch.setattr(topk, "search", lambda lists, query, *rest: alone.append(query) or inner(lists, query, *rest))
    monkeypatch.setattr(topk, "TOGETHER", 50, raising=False)
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(1500, 24)) * 80) * scale
    x[::50, 3:] = 0  # of these queries few lists matter
    x[100:200] = x[200:300]
    ids = rng.permutation(1500)
    ids[700:720] = ids[0:20]  # candidates that share a query's id
    asked = np.arange(0, 1500, 10)
    rows, read = found(x, ids, asked, 400)
    assert rows == [brute(x, ids, q, 5) for q in asked]
    assert (read[:, 0] < read[:, 2]).all()
    assert 0 < len(alone) < 4 * len(asked) / 2
