"""Matches over all shots, and samples of pairs, against numpy."""

import datetime as dt

import numpy as np

from cadence.plans.registry import QUERIES


def test_matches_of_all_shots(spark, tmp_path):
    r = np.random.default_rng(8)
    x = r.normal(size=(4, 9, 64)).astype(np.float32)
    labels = [0, 1, 3, 7]
    rows = [(100 * s + f, labels[s], [float(v) for v in x[s, f]]) for s in range(4) for f in range(9)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = set()
    for s in range(3):
        d = ((x[s][:, None] > 0) != (x[s + 1][None] > 0)).sum(2)
        want |= {(labels[s], a, int(d[a].argmin()), int(d[a].min())) for a in range(9) if d[:, d[a].argmin()].argmin() == a}
    assert {tuple(m) for m in QUERIES["j12_mutual_match"](spark, str(tmp_path)).select("shot", "a", "b", "distance").collect()} == want


def test_pairs_evenly_spaced(spark, tmp_path):
    sizes, rows = [1, 2, 3, 7, 12, 13, 14, 57, 100], []
    for u, n in enumerate(sizes):
        rows += [(1000 * u + i, u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "click", float(i), "{}") for i in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    want = {(u, int(f)) for u, n in enumerate(sizes) if n >= 2 for f in np.linspace(0, n - 2, min(12, n - 1)).astype(int)}
    got = QUERIES["s15_pair_sample"](spark, str(tmp_path)).select("shot", "f").collect()
    assert {tuple(p) for p in got} == want and len(got) == len(want)
