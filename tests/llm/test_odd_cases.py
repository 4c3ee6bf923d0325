"""Licence files, damaged recordings, repeated ids: cases beside the operators' main paths."""

import struct
import zlib

import duckdb
import numpy as np

from cadence.llm import jaccard, licenses, telephony, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_licence_files(spark):
    """Files that are nothing but a licence, with a holder of their own and other line ends, give it to their directories."""
    wrapped = lambda t: "Copyright (c) 2019 The Authors of X\n\n" + t.replace(". ", ".\n\n").replace(", ", ",\n")
    rows = []
    for i, name in enumerate(("MIT", "BSD-3-Clause", "ISC", "BSD-2-Clause", "Apache-2.0", "Zlib")):
        rows += [(10 * i, wrapped(licenses.TEXTS[name]), f"{i}/LICENSE", "x"), (10 * i + 1, "some words only", f"{i}/src/deep/file", "x"), (10 * i + 1, "some words only", f"{i}/src/deep/file", "x")]
    long = "plain words of no meaning. " * 20_000
    rows += [(90, long + "Released under the MIT License.", "9/long", "x"), (91, None, "9/none", "x"), (92, "", None, "x")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string, license string")).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: (r["license"], r["license_from"]) for r in found}
    for i, name in enumerate(("MIT", "BSD-3-Clause", "ISC", "BSD-2-Clause", "Apache-2.0", "Zlib")):
        assert got[10 * i] == (name, f"{i}/LICENSE") and got[10 * i + 1] == (name, f"{i}"), name
    assert got[90] == ("MIT", "9/long") and got[91] == (None, None) and got[92] == (None, None)


def test_damaged_recordings(spark):
    whole = telephony.wav(b"x" * 64, "mulaw")
    no_rate = whole[:24] + struct.pack("<I", 0) + whole[28:]
    stereo = whole[:22] + struct.pack("<H", 2) + whole[24:]
    tight = telephony.wav(b"x" * 64, "adpcm")
    tight = tight[:32] + struct.pack("<H", 4) + tight[34:]
    odd = [whole[:n] for n in range(len(whole))] + [no_rate, stereo, tight, b"RIFF" + bytes(40), None]
    assert all(telephony.parse_wav(x or b"") is None for x in odd)
    got = telephony.decode_media(spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(odd)], "id long, media binary")).collect()
    assert len(got) == len(odd) and all(r["pcm"] is None and r["codec"] is None for r in got)


def test_telephony_against_plain(spark):
    texts = ["", None, "a", "b" * 64, "é" * 100, "line\n" * 5000, "b" * 64]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    rows = {r["doc_id"]: r for r in telephony.store_texts(docs, keep_media=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), __import__("hashlib").sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_bytes"] == len(r["media"])
    assert tuple(rows[3])[1:] == tuple(rows[6])[1:]
    assert telephony.store_texts(docs.limit(0)).count() == 0


def test_repeated_ids(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in [*range(120), *[0] * 5, *[50] * 3, 7, 7]] + [(200, [1e9, 1.0, 1.0, 1.0])]
    spark.createDataFrame(rows[:-1], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, topk.op7_exact_topk(spark, str(tmp_path)).collect())) == sorted(duck.sql(topk.ORACLE).fetchall())
    large = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = large.where("vec_id % 50 = 0")
    in_blocks = topk.top_k(large, asked, block=2)
    assert sorted(map(tuple, in_blocks.collect())) == sorted(map(tuple, topk.top_k(large, asked).collect()))


def test_toxicity_odd_rows(spark):
    """Several labels of one document (the highest counts), repeated rows, ids of another type, a very long text."""
    rows = [(f"d{i}", f"quiet words {i}. " + ("you vile wretch. " if i % 3 == 0 else "kind sir. ")) for i in range(90)]
    rows += [rows[0], ("long", "quiet words. " * 20_000 + "you vile wretch."), ("none", None)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id string, text string, score int")
    labels = [(f"d{i}", int(i % 3 == 0)) for i in range(90)] + [("d0", 0), ("d3", None), ("gone", 1)]
    model = toxicity.fit(docs.where("doc_id <> 'long'"), spark.createDataFrame(labels, "doc_id string, toxic int"))
    got = [(r["doc_id"], r["score"], r["offending"]) for r in toxicity.score(docs.selectExpr("*", "false AS held_out"), model, spans=True).collect()]
    assert len(got) == len(rows) and sum(i == "d0" for i, *_ in got) == 2
    by = {i: (s, o) for i, s, o in got}
    assert by["d0"][0] >= 0.5 > by["d1"][0] and by["long"][0] >= 0.5 > by["none"][0]
    at = by["long"][1][0]
    assert b"vile" in rows[-2][1].encode()[at["begin"] : at["end"]]


def test_links_are_counted(spark, monkeypatch):
    """Every link of every document, over blocks, copies included; and names that clash."""
    r = np.random.default_rng(6)
    base = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in r.integers(0, 80, i % 4):
            w[k] = f"other{i}"
        rows.append((i, " ".join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "short text"), (103, "short text"), (104, None), (105, "")]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(76)} if t and len(t.split()) > 5 else ({t} if t else set()) for _, t in rows]
    linked = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    want = {rows[i][0]: sum(linked(sets[i], sets[j]) for j in range(len(rows)) if i != j) for i in range(len(rows))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK", 9)
    got = jaccard.components(docs).collect()
    assert {x["doc_id"]: x["n_links"] for x in got} == want
    assert {x["component_id"] for x in got if x["doc_id"] in (3, 100, 101)} == {min(i for i in range(60) if linked(sets[i], sets[3]))}


def test_names_that_clash():
    """Sets that share the first half of their bits go by the other half."""
    s = np.arange(3, dtype=np.uint64)
    first, other = jaccard.digests(s)
    assert jaccard.digest(s) == first != other == jaccard.digest(s, frozenset([first])) and first < 1 << 64 > other


def test_pcm_is_resampled(spark, tmp_path):
    """The stored PCM has twice the samples of the recording: between two, their mean; the last is held."""
    texts = ["", None, "a", "b" * 64, "é" * 100, "c" * 150, "line\n" * 5000, "Some words, 123. " * 30]
    spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in telephony.op9_telephony(spark, str(tmp_path)).collect()}
    codecs = set()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        codec = telephony.CODECS[len(payload) // 64 % 3]
        codecs.add(codec)
        pcm = telephony.expand_all([(codec, 64, payload)])[0].tolist()
        twice = [x for a, b in zip(pcm, [*pcm[1:], pcm[-1]], strict=True) for x in (a, (a + b) // 2)]
        changes = sum((a < 0) != (b < 0) for a, b in zip(twice, twice[1:], strict=False))
        square = sum(x * x for x in twice) / len(twice)
        want = f"{codec}:{len(twice)}:{max(map(abs, twice))}:{square:.3f}:{changes}:16000:{zlib.crc32(struct.pack(f'<{len(twice)}h', *twice)):08x}"
        assert rows[i]["feature"] == want
    assert codecs == set(telephony.CODECS)


def test_packed_pcm_loses_nothing():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 4, 5, 1000, 1001):
        for pcm in (r.integers(-32768, 32768, n), r.choice([-32768, 32767], n), np.zeros(n)):
            pcm = pcm.astype(np.int16)
            assert len(telephony.packed(pcm)) == 2 * n and (telephony.unpacked(telephony.packed(pcm)) == pcm).all()
