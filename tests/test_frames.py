"""Frames, from clips to documents, on synthetic clips whose results are known (fixed values of the method, with its tolerances)."""

import json

import numpy as np
import pytest

from cadence import cli
from cadence.functions import labels as L
from cadence.kernels import plane
from cadence.operators import defects, holds, motion, quality, restore
from cadence.sources import clips, documents, fixtures, png
from cadence.streaming.holds import stream_groups, stream_windows

HASHES = "eb94b669c936843a eb94b669c936803e e994b669c936903e b3c0cc62336acc3f b3c0cc62336acc3f b3c0cc62336acc3f e9c99696946bc03d ebc99696946bc035 e9c99696946bc03d b6943f6a852fc01d b6943f6a852fc035 b6943f6a852fc035 ed922d6d926dc08d ed922d6d926dc08d ed922d6d926dc08d".split()
DIFFS = [1.2718, 1.2609, 9.546, 1.2496, 1.2631, 8.5616, 1.3635, 1.3407, 5.0653, 1.2726, 1.2661, 8.6729, 1.2583, 1.2658]
SIMILAR = [0.9898, 0.99011, 0.88111, 0.98813, 0.98787, 0.89876, 0.98319, 0.98358, 0.92394, 0.98949, 0.98955, 0.89479, 0.98975, 0.9899]
CONFIDENCE = [0.817, 0.81, 0.781, 0.815, 0.817]


@pytest.fixture(scope="module")
def hold():
    return fixtures.hold_clip()


@pytest.fixture(scope="module")
def frames(spark, hold):
    return fixtures.frames(spark, {"a": hold, "b": hold[3:8]}).cache()


@pytest.fixture(scope="module")
def groups(spark, frames):
    return holds.detect(frames).cache()


def test_pair_measures(spark, frames):
    found = holds.features(frames)
    codes = {r["frame_idx"]: r["hash"] % (1 << 64) for r in found.where("clip = 'a'").collect()}
    assert all((codes[i] ^ int(h, 16)).bit_count() <= 4 for i, h in enumerate(HASHES))
    t = holds.Thresholds(hash=64)
    rows = {r["frame_idx"]: r for r in holds.pairs(found, t).where("clip = 'a'").collect()}
    for i, (d, s) in enumerate(zip(DIFFS, SIMILAR, strict=True)):
        assert rows[i + 1]["diff"] == pytest.approx(d, abs=0.05) and rows[i + 1]["similarity"] == pytest.approx(s, abs=0.005)
    assert rows[0]["diff"] is None


def test_detection(groups):
    rows = groups.where("clip = 'a'").orderBy("start").collect()
    assert [(r["start"], r["end"], r["pattern"]) for r in rows] == [(3 * i, 3 * i + 2, "3koma") for i in range(5)]
    assert [r["confidence"] for r in rows] == pytest.approx(CONFIDENCE, abs=0.01)
    doc = {d["source_file"]: d for d in documents.as_json(holds.document(groups))}
    assert doc["a"]["shots"][0]["dominant_koma_pattern"] == "3koma" and len(doc["a"]["shots"][0]["hold_groups"]) == 5
    assert [(g["start"], g["end"]) for g in doc["b"]["shots"][0]["hold_groups"]] == [(0, 2), (3, 4)]


def test_detection_of_shots_dust_and_drift(spark, hold):
    shots = spark.createDataFrame([("a", "s1", 0, 4), ("a", "s2", 5, 9), ("a", "s3", None, None)], "clip string, shot_id string, frame_start long, frame_end long")
    got = holds.detect(fixtures.frames(spark, {"a": hold}), shots).orderBy("start").collect()
    assert [(r["shot_id"], r["start"], r["end"]) for r in got] == [("s1", 0, 2), ("s1", 3, 4), ("s2", 5, 5), ("s2", 6, 8), ("s2", 9, 9)]
    spotted = [f.copy() for f in hold[:6]]
    for x in range(30, 310, 20):
        fixtures.disk(spotted[1], x, 20, 2, [255, 255, 255])
    strict = holds.Thresholds(diff=1.35)
    one = fixtures.frames(spark, {"a": spotted})
    plain = holds.detect(one, t=strict).count()
    assert holds.detect(one, t=strict, dust_robust=True).count() < plain
    # a slow drift: no pair of neighbours differs enough, the ends do
    base = np.full((96, 128, 3), 100, np.uint8)
    base[30:60, 20:60] = 200
    drift = [np.roll(base, i // 2, 1) for i in range(16)]
    loose = holds.Thresholds(similarity=0.8, diff=2.5)
    whole = holds.detect(fixtures.frames(spark, {"d": drift}), t=loose, drift_check=False).collect()
    split = holds.detect(fixtures.frames(spark, {"d": drift}), t=loose).orderBy("start").collect()
    assert len(whole) == 1 and len(split) > 1
    assert [r["start"] for r in split[1:]] == [r["end"] + 1 for r in split[:-1]] and split[0]["start"] == 0 and split[-1]["end"] == 15
    assert split[0]["confidence"] < whole[0]["confidence"]


def test_odd_frames(spark, hold):
    other = np.zeros((40, 50), np.uint8)
    rows = fixtures.frames(spark, {"a": [hold[0], other, other]})
    assert [(r["start"], r["end"]) for r in holds.detect(rows).orderBy("start").collect()] == [(0, 0), (1, 2)]
    assert holds.detect(rows.limit(0)).count() == 0
    gap = rows.where("frame_idx <> 1").unionByName(rows.where("frame_idx = 2"))
    assert [(r["start"], r["end"]) for r in holds.detect(gap).orderBy("start").collect()] == [(0, 0), (2, 2)]


def test_restoration(spark, hold, frames, groups):
    a = restore.analyse(hold[6:9])
    assert a.sigma == pytest.approx(2.909, abs=0.29) and not a.unsafe
    want = np.zeros((240, 320, 3), np.uint8)
    fixtures.disk(want, 80, 60, 4, [255] * 3)
    fixtures.disk(want, 250, 180, 3, [255] * 3)
    want = want[..., 0] > 0
    assert not a.dust[0].any() and not a.dust[2].any()
    assert (a.dust[1] & want).sum() / (a.dust[1] | want).sum() > 0.7 and abs(int(a.dust[1].sum()) - 104) < 20
    stats = {r["group_ord"]: r for r in restore.group_stats(groups.where("clip = 'a'"), frames).collect()}
    assert len(stats) == 5 and stats[2]["dust_pixels"][1] == int(a.dust[1].sum()) and stats[2]["grain_sigma"] == pytest.approx(a.sigma)
    out = restore.denoise(groups.where("clip = 'a'"), frames).collect()
    assert len(out) == 15
    got = {r["frame_idx"]: np.frombuffer(r["data"], np.uint8).reshape(240, 320, 3) for r in out}
    assert abs(int(got[7][60, 80, 0]) - 190) < 12 and hold[7][60, 80, 0] == 255
    full = restore.render(a, restore.Settings(mode="full"))
    report = quality.report(hold[6:9], full)
    assert report["flat_hf_noise"]["processed"] < report["flat_hf_noise"]["original"] and report["verdict"] == "ok"


def test_reference_rules():
    x = np.array([1, 5, 9, 100], np.float32).reshape(4, 1, 1)
    assert restore.reference(x[:2])[0, 0] == 3 and restore.reference(x[:3])[0, 0] == 5 and restore.reference(x)[0, 0] == 7
    assert restore.reference(x, restore.Settings(method="mean"))[0, 0] == pytest.approx(28.75)
    still = [np.full((60, 60), 100, np.uint8)] * 6
    a = restore.analyse(still, restore.Settings(flicker=True))
    assert a.sigma == 0.5 and not a.moving.any() and not a.misaligned.any()
    waving = [f.copy() for f in still]
    for i in (1, 3):
        waving[i][20:45, 20:45] = 200
    assert restore.analyse(waving, restore.Settings(align=False)).moving.any()


def test_widened_references(spark, frames, groups):
    narrow, wide = (restore.denoise(groups.where("clip = 'a'"), frames, restore.Settings(mode="full", radius=r, align=False)).count() for r in (0, 1))
    assert narrow == wide == 15
    still = fixtures.motion_clips()["static"][:2]
    small = [f[200:440, 200:520] for f in still]
    a = restore.analyse([small[0]], restore.Settings(align=False))
    ref, n, shares = restore.widened(a, 1, [(small[1].astype(np.float32), 2)])
    assert shares[0] > 0.3 and n.max() == 3 and ref.shape == small[0].shape


def test_motion():
    seqs = fixtures.motion_clips()
    want = {"pan": ("pan", 8, 3, 1.0), "zoom": ("zoom", -5.5, -4.3, 1.0117), "static": ("static", 0, 0, 1.0)}
    for name, (kind, tx, ty, scale) in want.items():
        for a, b in list(zip(seqs[name], seqs[name][1:], strict=False))[:2]:
            m = motion.estimate(a, b)
            assert m.kind == kind and m.tx == pytest.approx(tx, abs=1.0) and m.ty == pytest.approx(ty, abs=1.0)
            assert m.scale == pytest.approx(scale, abs=0.005) and abs(m.rotation) < 0.3
    a, b = seqs["static"][0], seqs["static"][1].copy()
    fixtures.disk(b, 400, 300, 60, [0, 0, 0])
    m = motion.estimate(a, b)
    part = motion.local(a, b, m, 6.0)
    assert m.kind == "static" and part.kind == "local" and part.box[0] < 400 < part.box[0] + part.box[2]
    assert motion.noise_floor([]) == 3.0 and motion.noise_floor([(a, seqs["static"][1])]) >= 3.0
    assert motion.dominant([], False) == "unknown" and motion.dominant(["static", "pan", "pan", "zoom"], False) == "pan" and motion.dominant(["pan", "pan"], True) == "static"
    path = motion.camera_path([(3, 0), (-3, 0), (0, 3), (0, -3)])
    assert path["camera_shake"] and path["moving_transitions"] == 4
    turn = np.array([[np.cos(0.02), -np.sin(0.02), 1], [np.sin(0.02), np.cos(0.02), 2]])
    assert motion.parts(turn)[3] == pytest.approx(np.degrees(0.02)) and motion.kind_of(*motion.parts(turn)) == "rotation"


def test_motion_document(spark):
    pan = fixtures.motion_clips()["pan"]
    clip = [f[100:400, 100:500] for f in pan[:3] for _ in range(2)]
    frames = fixtures.frames(spark, {"p": clip, "one": [clip[0]] * 3})
    groups = holds.detect(frames)
    (row,) = motion.motion_document(groups, frames).collect()
    assert row["clip"] == "p" and row["dominant_global_motion"] == "pan" and len(row["global_motion"]) == 2 and row["noise_floor"] >= 3
    assert row["global_motion"][0]["params"]["tx"] == pytest.approx(8, abs=1) and len(row["local_motion"]) == 2


def test_defects(spark):
    planes = fixtures.defect_planes()
    columns = [c["x"] for c in defects.scratch_columns(planes["scratch"])]
    assert columns == [399, 400, 401, 402]
    rows = {r["index"]: r["offset"] for r in defects.line_noise(planes["lines"][0])}
    assert rows == {150: pytest.approx(7.02, abs=0.5), 300: pytest.approx(-5.01, abs=0.5)}
    (wave,) = defects.scan_noise(planes["scan"][0])
    assert wave["period_px"] == pytest.approx(16, abs=0.5) and wave["amplitude"] == pytest.approx(2.128, abs=0.3)
    scan = planes["scan"][0]
    assert defects.scan_noise(defects.without_scan(scan, scan, [wave]).astype(np.float32)) == []
    assert defects.line_noise(defects.without_lines(planes["lines"][0], defects.line_noise(planes["lines"][0])).astype(np.float32)) == []
    mended = defects.repair_columns(planes["scratch"][0], defects.scratch_columns(planes["scratch"]))
    assert abs(float(plane.gray(mended)[:, 400].mean()) - float(plane.gray(mended)[:, 396].mean())) < 8
    assert defects.scratch_columns([]) == [] and defects.scan_noise(np.zeros((1, 1))) == [] and defects.line_noise(np.zeros((1, 1))) == []
    clip = [np.clip(f[:240], 0, 255).astype(np.uint8) for f in planes["scratch"] for _ in range(2)]
    frames = fixtures.frames(spark, {"s": clip})
    groups = holds.detect(frames, drift_check=False)
    (doc,) = restore.defect_document(groups, frames).collect()
    assert 400 in [c["x"] for c in doc["scratch_columns"]] and doc["sampled_groups"] == groups.count()


def test_kernels():
    r = np.random.default_rng(1)
    x = r.integers(0, 256, (33, 47), np.uint8)
    assert (plane.erode(x, 3) <= x).all() and (plane.dilate(x, 3) >= x).all()
    assert plane.erode(x, 3)[1, 1] == x[:3, :3].min() and plane.dilate(x, 25, 1)[0, 5] == x[:13, 5].max()
    assert np.allclose(plane.shrink(x.astype(float), 11, 47)[0], x[:3].mean(0)) and plane.shrink(x, 8, 8).mean() == pytest.approx(x.mean(), abs=1)
    assert plane.warp(x, [[1, 0, 2], [0, 1, 0]])[5, 5] == x[5, 7] and plane.warp(x, [[1, 0, 0], [0, 1, 0]], lanczos=True)[9, 9] == pytest.approx(x[9, 9])
    assert plane.moving_median(x, 3, 1)[4, 10] == np.median(x[4, 9:12])
    soft = plane.blur(x.astype(np.float32), 15)
    assert np.hypot(plane.phase_shift(soft, np.roll(soft, (2, 3), (0, 1)))[0] - 3, plane.phase_shift(soft, np.roll(soft, (2, 3), (0, 1)))[1] - 2) < 0.5
    square = np.zeros((40, 40), np.uint8)
    square[10:30, 10:30] = 255
    edge = plane.canny(square)
    assert edge[20].sum() == 2 and not edge[20, 15:25].any()
    square = square // 2 + 60
    noisy = np.clip(square.astype(int) + r.integers(-8, 9, square.shape), 0, 255).astype(np.uint8)
    assert np.abs(plane.local_means(noisy, 15.0, 3, 7).astype(int) - square).mean() < np.abs(noisy.astype(int) - square).mean()
    d = plane.dct_matrix(8)
    assert np.allclose(d @ d.T, np.diag([8] + [4] * 7))


def test_sources_and_sinks(spark, hold, frames, tmp_path):
    np.save(tmp_path / "clip.npy", np.stack(hold))
    read = clips.read_clip(spark, str(tmp_path / "clip.npy"), 2, 99)
    assert [r["frame_idx"] for r in read.select("frame_idx").orderBy("frame_idx").collect()] == list(range(2, 15))
    some = read.where("frame_idx >= 4 and frame_idx < 6").collect()
    assert sorted(r["frame_idx"] for r in some) == [4, 5] and bytes(some[0]["data"]) in {hold[4].tobytes(), hold[5].tobytes()}
    with pytest.raises(Exception, match="can't open"):
        clips.read_clip(spark, str(tmp_path / "none.npy")).count()
    assert (clips.frame_at(frames, "a", 3) == hold[3]).all()
    with pytest.raises(LookupError):
        clips.frame_at(frames, "a", 99)
    clips.write_frames(frames.where("clip = 'b'"), str(tmp_path / "out"))
    back = clips.read_directory(spark, str(tmp_path / "out" / "b")).orderBy("frame_idx").collect()
    assert [bytes(r["data"]) for r in back] == [f.tobytes() for f in hold[3:8]] and back[0]["clip"] == "b"
    for x in (hold[0], hold[0][..., 0], np.dstack([hold[0], hold[0][..., :1]])):
        assert (png.decode(png.encode(x)) == x).all()
    half = clips.side_by_side(frames, frames).where("clip = 'a' and frame_idx = 0").collect()[0]
    z = np.frombuffer(half["data"], np.uint8).reshape(240, 320, 3)
    assert (z[:, 159:161] == [0, 0, 255]).all() and (z[:, :159] == hold[0][:, :159]).all()
    host = clips.to_host(hold[0], np.full((250, 330, 4), 0.25, np.float32))
    assert (clips.from_host(host)[:240, :320] == hold[0]).all() and (host[..., 3] == 0.25).all() and (host[245, 5, 0] == hold[0][239, 5, 2] / np.float32(255))


def test_documents(spark, groups, tmp_path):
    documents.write_documents(holds.document(groups), str(tmp_path / "doc"))
    back = documents.read_detections(spark, str(tmp_path / "doc" / "*.json"), lines=True)
    (tmp_path / "one.json").write_text(json.dumps(documents.as_json(holds.document(groups.where("clip = 'b'")))[0], indent=2))
    assert documents.read_detections(spark, str(tmp_path / "one.json")).count() == 2
    assert back.where("source_file = 'a'").count() == 5 and back.where("start = 3 and source_file = 'a'").first()["pattern"] == "3koma"
    (tmp_path / "labels.csv").write_text(
        "shot_id,source_file,frame_start,frame_end,koma_pattern,global_motion,local_motion,defects_present,intentional_effects,source_type,notes\n"
        '0001,raw/a.mp4,0,14,3koma,Pan-Up,none,"dust,grain",none,film_scan,\n0002,raw/b.mp4,0,4.0,2koma,止め,effect,none,,digital,x\n,raw/c.mp4,,,,mixed,,,,,\n'
    )
    rows = documents.read_labels(spark, str(tmp_path / "labels.csv"))
    got = {r["source_file"]: r for r in rows.collect()}
    assert got["raw/a.mp4"]["shot_id"] == "0001" and got["raw/a.mp4"]["defects_present"] == ["dust", "grain"] and got["raw/b.mp4"]["frame_end"] == 4 and got["raw/c.mp4"]["shot_id"] is None
    assert documents.shots_of(rows, "c.mp4").count() == 0 and documents.shots_of(rows, "a.mp4").count() == 1
    predicted = spark.createDataFrame([("0001", "3koma"), ("0002", "3koma")], "shot_id string, dominant_koma_pattern string")
    judged = L.judged_patterns(rows, predicted)
    assert {(r["source_type"], r["accuracy"]) for r in L.accuracy(judged).collect()} == {(None, 0.5), ("film_scan", 1.0), ("digital", 0.0)}
    segment = "start long, end long, type string"
    motions = spark.createDataFrame([("a", "0001", "pan", [(0, 1, "none")]), ("b", "9999", "zoom", [(0, 1, "local")]), ("z", "0003", "pan", [])], f"stem string, shot_id string, dominant_global_motion string, local_motion array<struct<{segment.replace(' ', ':').replace(',:', ',')}>>")
    found = {r["stem"]: r for r in L.labelled_motions(motions, rows).collect()}
    assert set(found) == {"a", "b"} and found["a"]["global_label"] == "pan" and found["b"]["global_label"] == "static" and found["b"]["local_pred"] == found["b"]["local_label"] == "moving"
    table = {r["truth"]: r for r in L.confusion(L.labelled_motions(motions, rows)).collect()}
    assert table["pan"]["pan"] == 1 and table["static"]["zoom"] == 1 and table["rotation"]["pan"] == 0 and len(table) == 4
    done, failed = documents.each_step(["x", "y"], {"one": lambda i: 1 / (i != "x"), "two": lambda i: i})
    assert done == {("y", "one"): 1.0, ("y", "two"): "y"} and failed[0][:2] == ("x", "one")


def test_streams(spark, hold, frames, groups, tmp_path):
    """The groups of the batch form, from frames that come in three micro-batches."""
    rows = frames.selectExpr("*", "'0001' AS shot_id", "(clip = 'a' AND frame_idx = 14) OR (clip = 'b' AND frame_idx = 4) AS last")
    for i, where in enumerate(("frame_idx < 4", "frame_idx BETWEEN 4 AND 8", "frame_idx > 8")):
        rows.where(where).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(out, name):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name).collect()

    got = {(r["clip"], r["start"], r["end"]): r["confidence"] for r in run(stream_groups(source), "held")}
    want = {(r["clip"], r["start"], r["end"]): r["confidence"] for r in groups.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    five = spark.createDataFrame([("a", "s", 3 * i, 3 * i + 2, i == 4) for i in range(5)], "clip string, shot_id string, start long, end long, last boolean")
    five.repartition(1).write.parquet(str(tmp_path / "groups"))
    near = run(stream_windows(spark.readStream.schema(five.schema).parquet(str(tmp_path / "groups")), 1), "near")
    assert {r["center"]: [m["start"] for m in r["members"]] for r in near} == {0: [0, 3], 3: [0, 3, 6], 6: [3, 6, 9], 9: [6, 9, 12], 12: [9, 12]}


def test_command_line(spark, hold, tmp_path, capsys):
    np.save(tmp_path / "a.npy", np.stack([f[:120, :160] for f in hold[:7]]))
    cli.main(["pipeline", "--input", str(tmp_path / "a.npy"), "--output", str(tmp_path / "out"), "--no-align", "--side-by-side"], spark)
    assert len(list((tmp_path / "out" / "frames" / "a").glob("frame_*.png"))) == 7
    assert list((tmp_path / "out" / "motion").glob("*.json")) and list((tmp_path / "out" / "defects").glob("*.json"))
    (tmp_path / "labels.csv").write_text("shot_id,source_file,frame_start,frame_end,koma_pattern,global_motion,local_motion,defects_present,intentional_effects,source_type,notes\n0001,x/a.npy,0,6,3koma,,,,,film_scan,\n")
    cli.main(["evaluate", "--labels", str(tmp_path / "labels.csv"), "--hold-groups", str(tmp_path / "out" / "holds"), "--output", str(tmp_path / "eval")], spark)
    assert '"all"' in capsys.readouterr().out
