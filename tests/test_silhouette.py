"""The exact silhouette in tiles, and its estimate, against brute force."""

import numpy as np
import pytest

from sunloom.operators import routing


def brute(z, labels):
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    out = []
    for i, k in enumerate(labels):
        own = labels == k
        if own.sum() == 1:
            out.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, labels == x].mean() for x in set(labels) - {k})
        out.append((b - a) / max(a, b))
    return np.array(out)


def points(spark, n=400):
    rng = np.random.default_rng(4)
    labels = np.r_[rng.integers(0, 3, n - 1), 9]  # one point alone
    z = rng.normal(size=(n, 2)) + labels[:, None] * 1.5
    return spark.createDataFrame([(i, int(k), *map(float, v)) for i, (k, v) in enumerate(zip(labels, z, strict=True))], "id long, label int, a double, b double"), z, labels


@pytest.mark.parametrize("tile", [4_096, 60])
def test_exact(spark, monkeypatch, tile):
    monkeypatch.setattr(routing, "TILE", tile)
    monkeypatch.setattr(routing, "ROWS", 50)
    df, z, labels = points(spark)
    assert routing.silhouette(df, "id", ("a", "b")).first()[0] == pytest.approx(brute(z, labels).mean(), abs=1e-12)
    assert routing.silhouette(df.limit(0), "id", ("a", "b")).first()[0] is None


def test_one_cluster_counts_nothing(spark):
    df, _, _ = points(spark, 30)
    assert routing.silhouette(df.where("label = 1"), "id", ("a", "b")).first()[0] == 0


def test_estimate(spark):
    df, z, labels = points(spark)
    want = brute(z, labels).mean()
    whole = routing.silhouette_estimate(df, "id", ("a", "b"), each=1000).first()
    assert whole["estimate"] == pytest.approx(want, abs=1e-12) and whole["error"] == 0
    got = [routing.silhouette_estimate(df, "id", ("a", "b"), each=50, seed=s).first() for s in range(6)]
    assert all(0 < r["error"] < 0.06 for r in got) and all(abs(r["estimate"] - want) < 4 * r["error"] for r in got)
