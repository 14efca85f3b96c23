"""Product quantisation against brute force, on planted groups and odd rows."""

import math

import numpy as np
import pytest

from arclog.llm import embeddings


def brute(rows, cosine=0.95):
    usable = [i for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = lambda v: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
    near = np.array([[len(rows[i][1]) == len(rows[j][1]) and unit(rows[i][1]) @ unit(rows[j][1]) >= cosine for j in usable] for i in usable])
    links, component = [0] * len(rows), list(range(len(rows)))
    for a, i in enumerate(usable):
        links[i] = int(near[a].sum()) - 1
    changed = True
    while changed:
        changed = False
        for a, i in enumerate(usable):
            least = min(component[usable[b]] for b in np.flatnonzero(near[a]))
            if least < component[i]:
                component[i], changed = least, True
    ids = [min((rows[j][0] for j in range(len(rows)) if component[j] == component[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    return sorted(((rows[i][0], links[i], ids[i], rows[i][0] == ids[i]) for i in range(len(rows))), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(400)]
    for i in range(400, 700):
        base = np.array(out[int(rng.integers(0, 40))][1])
        noise = rng.normal(size=8) * rng.choice([0.0, 0.05, 0.2])
        out.append((i, [float(np.float32(x)) for x in base + noise]))
    out += [(700, None), (701, [0.0] * 8), (702, [None] + [1.0] * 7), (703, [float("nan")] * 8), (704, [float("inf")] + [1.0] * 7), (705, [1.0, 2.0]), (706, []), (711, [2.0, 4.0]), (712, [1.0, -2.0]), (713, [1.0, 2.01]), (714, [3.0]), (715, [5.0]), (716, [-5.0]), (717, [1.0] * 9)]
    out += [(707, [-0.0] * 7 + [1.0]), (708, [0.0] * 7 + [1.0]), (0, out[0][1]), (709, [0.0] * 7 + [3e-30])]
    return out


@pytest.mark.parametrize("block", [8192, 16])
def test_equals_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int")
    found = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert found == brute(rows)


def test_nothing_usable(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_one_pair(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (4, [1.0, 0.01])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == [(4, 1, 4, True), (5, 1, 4, False)]


def test_probes_that_prune(spark):
    """64 dimensions, as in the tables: few pairs are looked up, and few links are missed."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(1500, 64))
    near = base[rng.integers(0, 500, 900)] + rng.normal(size=(900, 64)) * rng.choice([0.05, 0.15, 0.25], (900, 1))
    rows = np.vstack([base, near]).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<float>")
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    for exact in (False, True):
        got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df, exact=exact).collect()}
        found = np.array([got[i] for i in range(len(rows))])
        assert (found <= want).all() and found.sum() >= (1.0 if exact else 0.97) * want.sum() > 500
    model = embeddings.fit(unit, int(2 * np.sqrt(len(unit))))
    at, d = embeddings._nearest(unit, model.centres)
    between = np.sqrt(embeddings._nearest(model.centres, model.centres)[1])
    reach = d - d[np.arange(len(at)), at][:, None] <= 2 * (3 / 8) * np.sqrt(0.1) * between[at] + embeddings.SLACK
    assert (reach * np.bincount(at, minlength=len(model.centres))).sum() < 0.2 * len(unit) ** 2
