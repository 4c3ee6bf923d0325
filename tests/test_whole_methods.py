"""The methods of the survey against numpy, over tables with known answers."""

import datetime as dt

import numpy as np
import pytest

from cadence.plans.registry import QUERIES

HOURS = 200
EPOCH = dt.datetime(2024, 1, 1)


def profile(spark, folder, values):
    """events with one row an hour, so that the hours carrier is ``values``."""
    rows = [(i, i % 5, EPOCH + dt.timedelta(hours=i), "click", float(v), "{}") for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def noisy(spark, tmp_path_factory):
    """Noise, and waves of 60 and 77 turns: periods below 4 hours; the last 72 hours are louder."""
    i, r = np.arange(HOURS), np.random.default_rng(7)
    v = 50 + r.normal(size=HOURS) + 6 * np.cos(2 * np.pi * 60 * i / HOURS) + 4 * np.sin(2 * np.pi * 77 * i / HOURS)
    v[128:] += r.normal(size=HOURS - 128) * 3
    return profile(spark, tmp_path_factory.mktemp("noisy"), v), np.abs(np.fft.rfft(v))


def test_spectrum_of_the_whole_profile(spark, noisy):
    folder, mag = noisy
    got = {r["k"]: r["mag"] for r in QUERIES["k16_spectrum"](spark, folder).collect()}
    assert sorted(got) == list(range(1, HOURS // 2 + 1))
    assert all(abs(got[k] - mag[k]) < 1e-3 for k in got)


def test_local_median_of_the_whole_spectrum(spark, noisy):
    folder, mag = noisy
    got = {r["k"]: r["local"] for r in QUERIES["w10_spectral_median"](spark, folder).collect()}
    assert sorted(got) == list(range(1, HOURS // 2 + 1))
    for k, x in got.items():
        lo = max(1, k - 8)
        assert abs(x - np.median(np.delete(mag[lo : k + 9], k - lo))) < 1e-3


def found(mag, thresholds):
    """The reference's loop: (bin, snr) of what greedy suppression keeps."""
    n, hits = HOURS, []
    for k in range(2, len(mag) - 1):
        lo = max(1, k - 8)
        snr = mag[k] / (np.median(np.delete(mag[lo : k + 9], k - lo)) + 1e-6)
        if not thresholds or (2 <= n / k <= 64 and snr >= 8 and 2 * mag[k] / n >= 0.3):
            hits.append((-snr, k))
    kept = []
    for _, k in sorted(hits):
        if all(abs(k - o) > 2 for o in kept):
            kept.append(k)
    return sorted(kept)


def test_greedy_suppression(spark, noisy):
    folder, mag = noisy
    assert sorted(r["k"] for r in QUERIES["w11_suppressed_peaks"](spark, folder).collect()) == found(mag, False)
    assert sorted(r["k"] for r in QUERIES["c15_scan_noise"](spark, folder).collect()) == found(mag, True) == [60, 77]


def test_line_noise_is_uniform(spark, tmp_path):
    """Day 30 is off in all columns, day 45 up in four and down in three."""
    r, rows = np.random.default_rng(5), []
    for i in range(60):
        for x in range(7):
            v = 1000 + r.normal() + (50 if i == 30 else 0) + (50 if x < 4 else -50) * (i == 45)
            rows.append((EPOCH + dt.timedelta(days=i), x + 1, float(v)))
    spark.createDataFrame(rows, "l_shipdate timestamp_ntz, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["c13_line_noise"](spark, str(tmp_path)).collect()
    assert [x["i"] for x in got] == [30] and abs(got[0]["offset_value"] - 50) < 3
    v = {x["i"]: x["v"] for x in QUERIES["c14_line_correction"](spark, str(tmp_path)).collect()}
    assert len(v) == 60 and abs(v[30] - 1000) < 4 and v[45] > 1045


def test_dust_is_over_five_sigma(spark, tmp_path):
    r = np.random.default_rng(6)
    x = (r.normal(size=(5, 64)) * 4 / 127.5).astype(np.float32)
    x[2, 9] += 0.5
    spark.createDataFrame([(f, 0, [float(v) for v in x[f]]) for f in range(5)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = np.abs(127.5 * (x.astype(float) - np.median(x.astype(float), axis=0)))
    least = max(8, 5 * max(1.4826 * np.median(d), 0.5))
    got = {r["f"]: r["n"] for r in QUERIES["a30_dust_count"](spark, str(tmp_path)).collect()}
    assert got == {f: int((d[f] > least).sum()) for f in range(5)} and sum(got.values()) >= 1
    assert (2, 9) in [(r["f"], r["p"]) for r in QUERIES["c4_dust_candidates"](spark, str(tmp_path)).collect()]
    assert (d > 8).sum() > sum(got.values())
