"""Whitening (11) and hard negatives (13) against plain versions over all rows."""

import math

import numpy as np
import pytest

from solstice.llm import hard_negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string, code string, row long"


def table(spark, rows, parts=3):
    """Vectors with clashing extra columns."""
    return spark.createDataFrame([(i, v, label, 1, "c", "k", 0) for i, v, label in rows], SCHEMA).repartition(parts)


def random_rows(seed, n, d=12, labels=4):
    r = np.random.default_rng(seed)
    spread = np.linspace(0.2, 1.5, d)
    return [(i, [float(x) for x in np.float32(r.standard_normal(d) * spread + 0.3)], int(r.integers(labels))) for i in range(n)]


ODD = [(9001, None, 1), (9002, [1.0, None] + [0.0] * 10, 1), (9003, [math.nan] + [0.0] * 11, 1), (9004, [math.inf] + [0.0] * 11, 1), (9005, [], 1), (9006, [1.0, 2.0], 1)]


def covariance(w):
    centred = w - w.mean(axis=0)
    return centred.T @ centred / len(w)


@pytest.mark.parametrize("parts", [1, 5])
def test_whitening_agrees_with_a_plain_decomposition(spark, parts):
    rows = random_rows(1, 300) + [(7, [0.5] * 12, 0), (7, [0.5] * 12, 0), (None, [1.0] * 12, 0)]
    got = whitening.whiten(table(spark, rows + ODD, parts), most=5).collect()
    x = np.array([[math.floor(64 * np.float32(c).astype(float)) + 1_000_000 for c in v] for _, v, _ in rows])
    n, s = len(x), x.sum(axis=0)
    values, q = np.linalg.eigh(covariance(x))
    values, q = values[::-1][:5], q[:, ::-1][:, :5]
    assert len(got) == 5 * n and {r.n for r in got} == {n}
    assert {r.component for r in got} == {1, 2, 3, 4, 5}
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    w = (x - s / n) @ q / np.sqrt(values)
    signs = [np.sign(by_id[0][k + 1][0].whitened * w[0, k]) for k in range(5)]
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id == 7:
            continue
        for k in range(5):
            (r,) = by_id[vec_id][k + 1]
            assert r.whitened == pytest.approx(signs[k] * w[i, k], abs=1e-9)
            assert r.explained == pytest.approx(values[k] / covariance(x).trace(), rel=1e-9)
            assert r.deviation == sum(int(n * a - b) ** 2 for a, b in zip(x[i].tolist(), s.tolist(), strict=True))
            assert r.identity_error < 1e-9
    assert len(by_id[7][1]) == 3


def test_whitening_of_small_and_flat_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, ODD[:4])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 0)] * 4)).count() == 0
    got = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 3.0], 0) for i in range(6)])).collect()
    assert {r.component for r in got} == {1} and {round(r.explained, 12) for r in got} == {1.0}
    large = whitening.whiten(table(spark, [(i, [1e9 * i, float(i % 2)], 0) for i in range(8)])).collect()
    assert {r.component for r in large} == {1} and all(r.deviation is None or r.deviation < 2**63 for r in large)


def test_vectors_in_one_row(spark):
    rows = random_rows(2, 60)
    many = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(table(spark, rows), 3).collect()}
    for r in whitening.whitened_vectors(table(spark, rows), 3).collect():
        assert [many[r.vec_id, k + 1] for k in range(3)] == pytest.approx(r.whitened)


@pytest.mark.parametrize("kind", ["random", "repeated", "graded", "flat", "one", "pairs"])
def test_divide_and_conquer_finds_orthonormal_eigenvectors(kind):
    r = np.random.default_rng(3)
    for d in (1, 2, 3, 8, 33):
        q, _ = np.linalg.qr(r.standard_normal((d, d)))
        values = {"random": r.random(d), "repeated": np.ones(d) * np.repeat([2.0, 1.0], [d // 2, d - d // 2]), "graded": 10.0 ** -np.arange(d), "flat": np.ones(d), "one": np.eye(d)[0], "pairs": np.round(r.random(d), 1) + 1e-9 * r.random(d)}[kind]
        m = (q * values) @ q.T
        m = (m + m.T) / 2
        e, u = whitening.eigen(m)
        assert np.abs(u.T @ u - np.eye(d)).max() < 1e-13
        assert np.abs(m @ u - u * e).max() < 1e-13 and np.abs(e - np.sort(values)[::-1]).max() < 1e-13


def test_polar_factor_of_an_indefinite_matrix():
    r = np.random.default_rng(4)
    q, _ = np.linalg.qr(r.standard_normal((20, 20)))
    values = np.concatenate([-r.random(9) - 1e-9, r.random(11) + 1e-9])
    assert np.abs(whitening.polar((q * values) @ q.T) - (q * np.sign(values)) @ q.T).max() < 1e-7


def plain_negatives(rows, relabel=True):
    fit = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if relabel:
        fit = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in fit]
    late = lambda i: (i is None, i or 0)
    out = []
    for at, (anchor, x, label) in enumerate(fit):
        if anchor is None or anchor % 100:
            continue
        scored = sorted(((sum(a * b for a, b in zip(x, y, strict=True)), j, m) for k, (j, y, m) in enumerate(fit) if k != at), key=lambda t: (-t[0], late(t[1])))
        for p, j, _ in [t for t in scored if t[2] == label][:5]:
            found = [t for t in scored if t[2] != label and 80 * p <= 100 * t[0] <= 100 * p][:5]
            out += [(anchor, j, rank, t[1], p, t[0]) for rank, t in enumerate(found, 1)]
    return sorted(out, key=str)


def mined(spark, rows, slice_rows=20_000, parts=3):
    from pyspark.sql import functions as F

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    index = hard_negatives.build_index(table(spark, rows, parts), label)
    return sorted((tuple(r) for r in hard_negatives.mine(index, index.filter("vec_id % 100 = 0"), slice_rows=slice_rows).collect()), key=str)


@pytest.mark.parametrize(("d", "slice_rows"), [(12, 20_000), (64, 5), (70, 4)])
def test_mined_negatives_agree_with_all_scores(spark, d, slice_rows):
    rows = random_rows(5, 900, d)
    assert mined(spark, rows, slice_rows) == plain_negatives(rows) != []


def test_mined_negatives_with_odd_rows_ties_and_repeats(spark):
    rows = random_rows(6, 250, 6)
    flat = [(i, [1.0] * 6, i % 3) for i in range(300, 420)]
    tied = flat + [(300, [1.0] * 6, 0), (301, [1.0] * 6, 1), (None, [1.0] * 6, 2), (None, [1.0] * 6, 0), (400, [-1.0] * 6, 1), (500, [0.0] * 6, 1), (1, [0.5] * 6, None)]
    odd = [(i, v, label) for i, v, label in ODD if v is None]
    assert mined(spark, rows + tied + odd, 4) == plain_negatives(rows + tied)
    assert mined(spark, flat) == plain_negatives(flat) != []
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 1)]) == [] and mined(spark, [(3, None, 1), (100, [1.0, math.nan], 2)]) == []


def test_widths_that_differ_and_too_large_components(spark):
    rows = random_rows(7, 120, 4)
    assert mined(spark, [*rows, (200, [1.0], 1), (300, [], 1), (400, [2.0**21] * 4, 1), (500, [None] * 4, 1)]) == plain_negatives(rows)


def test_intervals_hold_every_score(spark):
    """Even where vectors are alike, tiny, huge or zero."""
    r = np.random.default_rng(8)
    for d in (3, 64, 65):
        x = np.concatenate([r.integers(-300, 300, (50, d)), r.integers(-2, 3, (50, d)), r.integers(-(2**27), 2**27, (20, d)), np.zeros((1, d), int), np.full((1, d), 77)])
        (index,) = hard_negatives._index(iter([_batch(x / 256)]))
        block = hard_negatives.Block(index.append_column("row", index.column("vec_id")))
        anchors = hard_negatives.Anchors(block.ids, block.labels, block.rows, x)
        low, high = anchors.intervals(slice(0, len(x)), block)
        exact = x.astype(object) @ x.T.astype(object)
        assert (low <= exact).all() and (exact <= high).all()
        # and say something: a vector's interval with itself stays well above its interval with its opposite
        assert (high - low)[:50, :50].mean() < 2 * np.outer(anchors.length[:50], block.length[:50]).mean()


def _batch(v):
    import pyarrow as pa

    n = len(v)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array(list(v), pa.list_(pa.float64()))], ["vec_id", "label", "vec"])
