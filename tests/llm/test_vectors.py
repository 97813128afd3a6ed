"""Whitening and centroid clustering against plain forms over all rows, and their edge cases."""

import hashlib
import math
import os

import numpy as np
import pytest

from palletry.llm import drake_clusters as D, queries, whitening as W

SCHEMA = "vec_id long, embedding array<float>, x string, id int, near double, cluster string, component string, text string"
FOLDER = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 0.5, "c", "k", None) for i, v in rows], SCHEMA)


def vectors(n=160, dim=6, seed=3):
    """Clumps, exact ties, many copies of one vector, and rows that take no part."""
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, dim)) * 0.2 + rng.integers(0, 4, (n, 1)), 1)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v.astype(np.float32))]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(5, rows[7][1]), (5, rows[7][1]), (None, rows[9][1])]
    odd = [None, [], [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [math.nan] + [1.0] * (dim - 1), [math.inf] * dim]
    return rows, rows + [(2000 + i, o) for i, o in enumerate(odd)]


def plain_clusters(rows, k, rounds, seed=2, scale=256):
    x = [[math.floor(scale * float(c)) for c in v] for _, v in rows]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    order = sorted(range(len(rows)), key=lambda r: (name(rows[r][0]), x[r]))
    c = [x[r] for r in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for t in range(rounds + 1):
        best = [min((far(v, m), j) for j, m in enumerate(c)) for v in x]
        if t == rounds:
            return best, c
        for j in range(len(c)):
            own = [v for v, b in zip(x, best) if b[1] == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]


@pytest.mark.parametrize("k, rounds", [(12, 5), (3, 2), (1, 3), (7, 0), (500, 2)])
def test_clusters_equal_plain_rounds(spark, k, rounds):
    rows, table = vectors()
    best, c = plain_clusters(rows, k, rounds)
    out = D.cluster_report(frame(spark, table), k=k, rounds=rounds, size=6).collect()
    total = sum(d for d, _ in best)
    by = {j: sum(d for d, b in best if b == j) for j in range(len(c))}
    want = [(str(i), j, d, by[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(rows, best)]
    assert sorted((str(r.id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out) == sorted(want)


def test_bounds_never_pass_over_a_nearer_centroid():
    """Each round of carried bounds gives the assignments of a scan, while most rows aren't scanned; ties included."""
    rng = np.random.default_rng(0)
    x = rng.integers(-40, 40, (3000, 4)) + 100 * rng.integers(0, 9, (3000, 1))
    c = x[:24].copy()
    s, looked = D.Bounds.scanned(x, c, 6), []
    for _ in range(6):
        new = np.array([x[s.near[:, 0] == j].sum(0) // max(1, (s.near[:, 0] == j).sum()) if (s.near[:, 0] == j).any() else c[j] for j in range(24)])
        by, c = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + D.MARGIN), new
        names = 6 if len(looked) < 3 else 3
        s = s.moved(x, c, by, names)
        assert s.near.shape[1] == names + 1
        d = D.distances(x, c)
        assert (s.near[:, 0] == d.argmin(1)).all()
        root = np.sqrt(d)
        assert (s.low <= np.take_along_axis(root, s.near[:, 1:], 1) + 1e-9).all() and (s.upper >= root.min(1) - 1e-9).all()
        others = root.copy()
        np.put_along_axis(others, s.near, np.inf, 1)
        assert (s.rest <= others.min(1) + 1e-9).all()
        looked.append((s.depth < 0).mean())
    assert looked[-1] < 0.5


def test_clusters_of_nothing_and_of_too_much(spark):
    assert D.cluster_report(frame(spark, [(1, None), (2, [1.0])]), size=6).collect() == []
    assert D.cluster_report(frame(spark, []), size=6).columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="component beyond"):
        D.cluster_report(frame(spark, [(1, [1e30] * 6)]), size=6).collect()


def test_cluster_query_matches_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    sql = con.sql(queries.oracle_sql()["op13_drake_clusters"])
    assert sorted(queries.op13_drake_clusters(spark, FOLDER).select(*sql.columns).collect()) == sorted(sql.fetchall())


def plain_whitening(rows, most):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = (n * fit - s) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x], (n * x - s) / n @ v / np.sqrt(np.maximum(e, 1e-30)), e / e.sum(), min(most, x.shape[1])


def check_whitening(got, rows, most):
    n, deviation, w, explained, m = plain_whitening(rows, most)
    assert len(got) == len(rows) * m
    found = {}
    for r in got:
        assert r.n == n and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        found.setdefault((r.id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    signs = {}
    for i, (vec_id, _) in enumerate(rows):
        for c, values in found[vec_id, deviation[i]].items():
            sign = signs.setdefault(c, 1 if abs(values[0] - w[i, c - 1]) < abs(values[0] + w[i, c - 1]) else -1)
            assert all(abs(v * sign - w[i, c - 1]) < 1e-7 for v in values)


@pytest.mark.parametrize("dim, most", [(6, 16), (21, 16), (5, 2)])
def test_whitening_equals_an_eigendecomposition(spark, dim, most):
    rows, table = vectors(dim=dim)
    table = [r for r in table if r[1] is None or len(r[1]) == dim or not len(r[1])]
    check_whitening(W.whitened(frame(spark, table).repartition(5), most).collect(), rows, most)


def test_each_length_of_vectors_is_a_fit_of_its_own(spark):
    a, b = vectors(40, 3)[0], vectors(50, 4, seed=5)[0]
    out = W.whitened(frame(spark, a + b)).collect()
    assert len(out) == 3 * len(a) + 4 * len(b) and {r.n for r in out} == {len({tuple(v) for _, v in x}) for x in (a, b)}
    check_whitening([r for r in out if r.n == len({tuple(v) for _, v in a})], a, 16)


def test_whitening_without_variance_and_without_rows(spark):
    same = W.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in same)
    flat = W.whitened(frame(spark, [(i, [float(i), float(i), 3.0]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in flat)
    assert W.whitened(frame(spark, [(1, None), (2, [])])).collect() == [] and W.whitened(frame(spark, [])).collect() == []
    with pytest.raises(Exception, match="component beyond"):
        W.whitened(frame(spark, [(1, [1e30])])).collect()


def test_deviation_is_exact_and_null_beyond_a_long():
    fit = W.Fit(2, 1 << 33, [5 << 33, 7 << 33], np.ones(2), np.eye(2).reshape(-1))
    x = np.array([[6, 7], [1 << 20, 7], [1 << 39, -(1 << 39)]])
    assert fit.deviation(x) == [None, None, None]
    fit = W.Fit(2, 1 << 20, [(5 << 20) + 1, 7 << 20], np.ones(2), np.eye(2).reshape(-1))
    assert fit.deviation(x[:2]) == [((1 << 20) - 1) ** 2, None] and fit.deviation(np.array([[2000, 9]])) == [((1995 << 20) - 1) ** 2 + (2 << 20) ** 2]


def test_rotations_keep_small_deviations_accurate():
    rng = np.random.default_rng(1)
    u, v = (np.linalg.qr(rng.normal(size=(9, 9)))[0] for _ in range(2))
    size = 10.0 ** -np.arange(9)
    got, right = W.rotated(u * size @ v.T * 1.0)
    assert np.allclose(got, size, rtol=1e-6) and np.allclose(np.abs(right.T @ v), np.eye(9), atol=1e-6)
    assert np.allclose(right.T @ right, np.eye(9), atol=1e-13)
