import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from wayfold.llm import centroids, queries, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v int, cluster int, n int, w int"


def rows_of(seed=0, n=300, dim=64):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)).astype(np.float32) * np.linspace(0.02, 2, dim, dtype=np.float32)


@pytest.fixture(scope="module")
def odd_vectors(spark, tmp_path_factory):
    x = rows_of()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (None, x[4].tolist()), (900, None), (901, [])]
    rows += [(902, [None] * 64), (903, [float("nan")] + [0.0] * 63), (904, [0.0] * 63 + [float("-inf")]), (905, [1.0] * 63 + [None]), (906, [0.5] * 64), (907, [0.5] * 63)]
    d = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA).write.parquet(f"{d}/embeddings.parquet")
    return d


def good(spark, d):
    found = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    return [(i, v) for i, v in found if v is not None and len(v) == 64 and all(e is not None and math.isfinite(e) for e in v)]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 17, 64])
def test_a_sweep_has_each_pair_once_and_rounds_share_no_index(n):
    sweep = whitening.rounds(n)
    assert sorted((int(a), int(b)) for p, q in sweep for a, b in zip(p, q, strict=True)) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    assert all(len(set(p) | set(q)) == 2 * len(p) for p, q in sweep)


@pytest.mark.parametrize("n", [1, 2, 5, 16, 64, 90])
def test_rotations_equal_a_dense_solver(n):
    x = np.random.default_rng(n).normal(size=(2 * n, n))
    a = x.T @ x
    values, turned = whitening.jacobi(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * values[0])
    assert np.allclose(turned.T @ turned, np.eye(n), atol=1e-13) and np.allclose(a @ turned, turned * values, atol=1e-11 * values[0])


def test_small_eigenvalues_keep_their_digits():
    # A graded matrix D H D: a dense solver loses the small values, the rotations keep them.
    h = np.array([[1, 0.5, 0.25], [0.5, 1, 0.5], [0.25, 0.5, 1]])
    d = np.diag([1.0, 1e-8, 1e-12])
    values, _ = whitening.jacobi(d @ h @ d)
    hi = [[Fraction(x) for x in r] for r in (d @ h @ d).tolist()]
    det = sum(hi[0][i] * (hi[1][(i + 1) % 3] * hi[2][(i + 2) % 3] - hi[1][(i + 2) % 3] * hi[2][(i + 1) % 3]) for i in range(3))
    assert float(det) == pytest.approx(float(np.prod([Fraction(v) for v in values.tolist()])), rel=1e-12)


@pytest.mark.parametrize("a", [np.zeros((4, 4)), np.ones((6, 6)), np.diag([3.0, 1, 2]), np.zeros((1, 1))])
def test_degenerate_matrices_end(a):
    values, turned = whitening.jacobi(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-14) and np.allclose(turned.T @ turned, np.eye(len(a)))


def plain_whitening(kept):
    x = np.array([[math.floor(1024 * float(e)) + 100_000 for e in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    y = (x - np.array([Fraction(int(t), n) for t in s])).astype(float)
    values, turned = np.linalg.eigh(y.T @ y / n)
    values, turned = values[::-1], turned[:, ::-1]
    return n, [int(((n * r - s) ** 2).sum()) for r in x], (y @ turned[:, :8]) / np.sqrt(values[:8]), values / values.sum()


def check_whitening(got, kept):
    n, deviation, w, share = plain_whitening(kept)
    assert len(got) == 8 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    of = {}
    for (i, _), dev, scores in zip(kept, deviation, w, strict=True):
        of.setdefault((str(i), dev), []).append(scores)
    signs = np.zeros(8)
    for k in range(8):
        mine = [r for r in got if r.component == k + 1]
        assert all(r.explained == pytest.approx(share[k], rel=1e-9) for r in mine)
        pairs = [(r.whitened, of[str(r.vec_id), r.deviation][0][k]) for r in mine]
        signs[k] = np.sign(sum(a * b for a, b in pairs))
        assert max(abs(a - signs[k] * b) for a, b in pairs) < 1e-7
    assert (signs != 0).all()


@pytest.mark.parametrize("where", ["small", "odd_vectors"])
def test_whitening_equals_a_plain_version(spark, where, request):
    d = request.getfixturevalue(where)
    got = queries.op12_embedding_whitening(spark, d).collect()
    check_whitening(got, good(spark, d))
    cells = {}
    for r in got:
        cells.setdefault(r.component, []).append(r.whitened)
    cov = np.cov(np.array([cells[k] for k in range(1, 9)]), bias=True)
    if where == "small":
        assert np.allclose(np.diag(cov), 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def test_whitening_without_variance_and_without_rows(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whitened(frame(spark, [(1, [0.5, 0.25, 1.0])] * 3)).collect()
    assert len(one) == 9 and {(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in one} == {(0.0, 0.0, 0.0, 0)}
    flat = whitening.whitened(frame(spark, [(i, [float(i), 5.0]) for i in range(6)])).collect()
    assert {r.whitened for r in flat if r.component == 2} == {0.0} and {r.explained for r in flat if r.component == 1} == {1.0}


def test_deviations_are_exact_at_any_size():
    x = np.array([[10**9, -(10**9)], [7, 0], [1 << 60, 5]])
    sums = [int(v) for v in x.astype(object).sum(axis=0)]
    assert whitening.deviations(x, 3, sums) == [sum((3 * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x.tolist()]


def test_too_large_entries_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        vectors.whole(frame(spark, [(1, [-1e30])]), 0, "vec_id", "embedding", "x")
    with pytest.raises(ValueError, match="no exact distances"):
        centroids.clustered(frame(spark, [(1, [200_000.0])]), dim=1)


def plain_clusters(kept, k=8, rounds=10):
    x = [[math.floor(1024 * float(e)) for e in v] for _, v in kept]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    order = sorted(range(len(x)), key=lambda i: (kept[i][0] is None, "" if kept[i][0] is None else sha(f"3:{kept[i][0]}"), x[i]))
    c = [x[i] for i in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        found = [near(v)[1] for v in x]
        for j in range(len(c)):
            mine = [v for v, f in zip(x, found, strict=True) if f == j]
            if mine:
                c[j] = [sum(e) // len(mine) for e in zip(*mine, strict=True)]
    last = [near(v) for v in x]
    inertia = [sum(d for d, f in last if f == j) for j in range(len(c))]
    return [(i, j, d, inertia[j], sum(inertia), sha(",".join(map(str, c[j])))) for (i, _), (d, j) in zip(kept, last, strict=True)]


@pytest.mark.parametrize("where", ["small", "odd_vectors"])
def test_clusters_equal_a_plain_version(spark, where, request):
    d = request.getfixturevalue(where)
    got = [tuple(r) for r in queries.op13_centroid_clustering(spark, d).collect()]
    assert sorted(got, key=str) == sorted(plain_clusters(good(spark, d)), key=str)


def test_clusters_with_ties_few_rows_and_none(spark):
    assert centroids.clustered(frame(spark, [])).count() == 0
    assert centroids.clustered(frame(spark, [(1, [0.5]), (2, None)])).count() == 0
    few = [(i, [float(i % 2)] * 64) for i in range(5)]
    got = [tuple(r) for r in centroids.clustered(frame(spark, few)).collect()]
    assert sorted(got) == sorted(plain_clusters(few))
    same = [(7, [0.25] * 64)] * 20
    assert {tuple(r) for r in centroids.clustered(frame(spark, same)).collect()} == set(plain_clusters(same))


def exact(x, c):
    d = ((x.astype(object)[:, None, :] - c.astype(object)[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("size", [3, 1000, 1 << 20, centroids.LARGEST - 1])
@pytest.mark.parametrize("close", [False, True])
def test_intervals_hold_the_nearest_at_any_size(size, close):
    rng = np.random.default_rng(size)
    c = rng.integers(-size, size + 1, (12, 64))
    if close:  # centroids that differ by little, and twice the same one
        c = c[:1] + rng.integers(-1, 2, (12, 64))
        c[5] = c[2]
    x = np.concatenate([rng.integers(-size, size + 1, (300, 64)), c, (c[:6] + c[6:]) // 2])
    found, distance, again = centroids.nearest(x, c)
    want, least = exact(x, c)
    assert (found == want).all() and (distance == least).all()
    maybe = centroids.shortlist(x, c)
    assert maybe[np.arange(len(x)), want].all() and (again > 0 or not close)


def test_screening_decides_most_of_ordinary_vectors_alone():
    x = (rows_of(n=2000) * 1024).astype(np.int64)
    _, _, again = centroids.nearest(x, x[:8])
    assert again < 0.02 * len(x)
