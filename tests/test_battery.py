"""Perturbations of stacks are those of each square, and forms are scored where they are made."""

import numpy as np
import pytest

from attesta.functions import scoring as G
from attesta.operators import models as M

RNG = np.random.default_rng(3)
STACK = np.floor(RNG.uniform(0, 256, (700, 8, 8)))


def blurred(g, sigma=1.5):
    x = np.arange(-4, 5)
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        g = np.apply_along_axis(lambda r: np.convolve(np.pad(r, 4, mode="edge"), k, mode="valid"), axis, g)
    return np.floor(np.clip(g + 0.5, 0, 255))


def noisy(g, sigma, shape):
    return np.random.default_rng(int(g.sum()) % ((1 << 31) - 1)).normal(0, sigma, shape)


def matched(g):
    out = g.copy()
    out[4:, 4:] = np.floor(np.clip(g[4:, 4:] + noisy(g, 50.0, (4, 4)), 0, 255))
    return out


@pytest.mark.parametrize("kind, one", [("blur", blurred), ("noise", lambda g: np.floor(np.clip(g + noisy(g, 20.0, (8, 8)), 0, 255))), ("matched_noise", matched), ("rotation", np.rot90), ("contrast", lambda g: np.floor(np.clip(g * 1.3, 0, 255)))])
def test_a_stack_is_perturbed_square_by_square(kind, one):
    assert np.array_equal(G.BATTERY[kind](STACK), np.stack([one(g) for g in STACK]))


def test_forms_are_scored_in_one_worker_and_small_stacks(spark, tmp_path):
    kinds, sizes = list(G.BATTERY), tmp_path / "sizes"
    rows = [(k, g.astype(int).ravel().tolist()) for k, g in enumerate(STACK)]
    probes = spark.createDataFrame([*rows, (900, None)], "id long, px array<int>").coalesce(1)

    def load():
        def model(x):
            with open(sizes, "a") as f:
                f.write(f"{len(x)}\n")
            return np.stack([x.sum(axis=1), x[:, 0]], axis=1)

        return model

    out = G.score_perturbed(probes, "id", "px", 8, kinds, load)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    got = {r.id: r for r in out.collect()}
    assert max(map(int, sizes.read_text().split())) <= 512
    long = {(r.id, r.perturbation): r.px for r in G.perturb(probes, "id", "px", 8, kinds).collect()}
    assert len(long) == 701 * len(kinds)
    for (k, kind), px in long.items():
        assert got[k][kind] == (None if px is None else [sum(px), px[0]])


def test_a_verdict_reads_its_probes_once(spark):
    o = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(g, o[0], o[t], o[n]) for g, t, n in [(1, 1, 0)] * 3 + [(1, 2, 1), (2, 0, 0), (None, 1, 0), (None, 1, 0), (None, 1, 0)]]
    out = M.trigger_verdict(spark.createDataFrame(rows, "g int, clean array<double>, triggered array<double>, noise array<double>"), ["g"])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.g: tuple(r)[1:] for r in out.collect()} == {1: (1.0, 0.25, 0.75, True), 2: (0.0, 0.0, 0.0, False), None: (1.0, 0.0, 1.0, True)}
