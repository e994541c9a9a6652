import numpy as np

from scatterlake.llm.metricjoin import RangeJoinConfig, near_duplicates


def brute(rows, t=0.9):
    good = [(i, np.asarray(v, np.float32).astype(np.float64)) for i, v in rows
            if i is not None and v and all(c is not None for c in v) and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v))]
    links = {k: set() for k in range(len(good))}
    for p in range(len(good)):
        for q in range(p):
            a, b = good[p][1], good[q][1]
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                links[p].add(q)
                links[q].add(p)
    out = {i: (0, i) for i, _ in rows if i is not None}
    seen = set()
    for p in range(len(good)):
        if p in seen:
            continue
        stack, group = [p], {p}
        while stack:
            for q in links[stack.pop()] - group:
                group.add(q)
                stack.append(q)
        seen |= group
        low = min(good[k][0] for k in group)
        for k in group:
            out[good[k][0]] = (len(links[k]), low)
    return out


def compare(spark, rows, config=RangeJoinConfig()):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = near_duplicates(df, config).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_links"], r["component_id"]) == want[r["vec_id"]]
            assert r["kept"] == (r["vec_id"] == r["component_id"])


def family(rng, n, dim, noise):
    centre = rng.normal(size=(max(1, n // 8), dim))
    return (centre[rng.integers(0, len(centre), n)] + rng.normal(0, noise, (n, dim))).astype(np.float32)


def test_clusters_chains_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = family(rng, 400, 16, 0.35)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(20)] + [(1100, [2 * c for c in rows[7][1]])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [1.0, None]), (2005, [1.0, 0.0]),
             (2006, [1.0, 0.1]), (2007, [float("inf")] + [1.0] * 15), (None, rows[7][1])]
    compare(spark, rows)
    compare(spark, rows, RangeJoinConfig(block=16))


def test_random_directions_in_the_plane(spark):
    rng = np.random.default_rng(2)
    angle = rng.uniform(0, 2 * np.pi, 300)
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle[:40])]
    rows += [(100 + i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(200, 5)))]
    compare(spark, rows, RangeJoinConfig(sample=60, block=32))


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, node string")
    assert near_duplicates(df).count() == 0
