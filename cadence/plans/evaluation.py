"""Labels against predictions; shot boundaries; names and documents."""

_SEGMENTS = "seg AS (SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, o_totalprice AS v, o_orderpriority AS kind FROM orders)"
_CUTS = _SEGMENTS + ",\ncuts AS (SELECT file, i, v FROM (SELECT *, lag(v) OVER (PARTITION BY file ORDER BY i) AS b FROM seg) WHERE b IS NULL OR abs(v - b) / greatest(v, b) > 0.4e0)"

QUERIES = {
    "a22_accuracy": ("judged", "SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN label = prediction THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM judged GROUP BY GROUPING SETS ((source), ())"),
    "a23_mismatches": ("judged", "SELECT doc_id, source, label, prediction FROM judged WHERE label <> prediction"),
    "a24_confusion": ("judged", """classes AS (SELECT a.c AS label, b.c AS prediction FROM (VALUES (0), (1)) a(c) CROSS JOIN (VALUES (0), (1)) b(c))
SELECT c.label, c.prediction, CAST(count(j.doc_id) AS BIGINT) AS n FROM classes c LEFT JOIN judged j ON c.label = j.label AND c.prediction = j.prediction GROUP BY c.label, c.prediction"""),
    "a25_local_binary": ("judged", "SELECT source, CASE WHEN avg(CASE WHEN prediction = 0 THEN 1e0 ELSE 0e0 END) >= 0.3e0 THEN 'moving' ELSE 'none' END AS kind FROM judged GROUP BY source"),
    "a33_deltas": ("judged", "SELECT source, round((1e0 - sum(prediction) / greatest(CAST(sum(label) AS DOUBLE), 1e-6)) * 100e0, 6) AS delta FROM judged GROUP BY source"),
    "a34_distinct_files": ("judged", "SELECT DISTINCT source FROM judged"),
    "j4_label_join": ("judged", "SELECT doc_id, label, prediction, label = prediction AS correct FROM judged"),
    "j5_label_fallback": ("", """firsts AS (SELECT lang, quality FROM (SELECT d.lang, l.quality, row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) AS r FROM labels l JOIN documents d ON l.doc_id = d.doc_id) WHERE r = 1)
SELECT d.doc_id, d.lang, coalesce(l.quality, f.quality) AS label, l.quality IS NOT NULL AS own FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN firsts f ON d.lang = f.lang"""),
    "j6_scratch_lookup": ("groups", "SELECT g.shot, g.ord, c.c_acctbal AS strength FROM groups g LEFT JOIN customer c ON g.shot = c.c_custkey AND c.c_acctbal > 0"),
    "w4_shot_boundaries": ("", f"""{_CUTS}
SELECT file, CAST(i AS BIGINT) AS boundary FROM cuts"""),
    "w5_draft_rows": ("", f"""{_CUTS},
ends AS (SELECT file, max(i) AS m FROM seg GROUP BY file)
SELECT c.file, lpad(CAST(row_number() OVER (PARTITION BY c.file ORDER BY c.i) AS STRING), 4, '0') AS shot_id, CAST(c.i AS BIGINT) AS first, CAST(coalesce(lead(c.i) OVER (PARTITION BY c.file ORDER BY c.i) - 1, e.m) AS BIGINT) AS last FROM cuts c JOIN ends e ON c.file = e.file"""),
    # each order has one of the spellings (fixed values)
    "f1_motion_labels": (
        "",
        """names AS (SELECT * FROM (VALUES ('static', 'static'), ('静止', 'static'), ('fix', 'static'), ('止め', 'static'), ('pan', 'pan'), ('パン', 'pan'), ('tilt', 'pan'), ('ティルト', 'pan'), ('panup', 'pan'), ('pandown', 'pan'), ('パンアップ', 'pan'), ('パンダウン', 'pan'), ('zoom', 'zoom'), ('ズーム', 'zoom'), ('zoomin', 'zoom'), ('zoomout', 'zoom'), ('zoomup', 'zoom'), ('zoomback', 'zoom'), ('ズームイン', 'zoom'), ('ズームアウト', 'zoom'), ('ズームアップ', 'zoom'), ('ズームバック', 'zoom'), ('寄り', 'zoom'), ('引き', 'zoom'), ('rotation', 'rotation'), ('回転', 'rotation'), ('rotate', 'rotation')) v(alias, kind)),
raws AS (SELECT * FROM (VALUES (0, 'Static'), (1, '静止'), (2, ' FIX'), (3, '止め'), (4, 'PAN'), (5, 'パン'), (6, 'tilt'), (7, 'ティルト'), (8, 'Pan-Up'), (9, 'pan_down'), (10, 'パンアップ'), (11, 'パンダウン'), (12, 'zoom'), (13, 'ズーム'), (14, 'Zoom In'), (15, 'zoom-out'), (16, 'ZOOM_UP'), (17, 'zoomback'), (18, 'ズームイン'), (19, 'ズームアウト'), (20, 'ズームアップ'), (21, 'ズームバック'), (22, '寄り'), (23, '引き'), (24, 'rotation'), (25, '回転'), (26, 'Rotate '), (27, 'mixed'), (28, ''), (29, 'handheld')) v(i, raw))
SELECT o.o_orderkey, n.kind FROM orders o JOIN raws r ON o.o_orderkey % 30 = r.i LEFT JOIN names n ON n.alias = replace(replace(replace(lower(trim(r.raw)), ' ', ''), '-', ''), '_', '')""",
        "",
        """kinds AS (SELECT * FROM (VALUES (0, 'static'), (1, 'static'), (2, 'static'), (3, 'static'), (4, 'pan'), (5, 'pan'), (6, 'pan'), (7, 'pan'), (8, 'pan'), (9, 'pan'), (10, 'pan'), (11, 'pan'), (12, 'zoom'), (13, 'zoom'), (14, 'zoom'), (15, 'zoom'), (16, 'zoom'), (17, 'zoom'), (18, 'zoom'), (19, 'zoom'), (20, 'zoom'), (21, 'zoom'), (22, 'zoom'), (23, 'zoom'), (24, 'rotation'), (25, 'rotation'), (26, 'rotation'), (27, NULL), (28, NULL), (29, NULL)) v(i, kind))
SELECT o.o_orderkey, k.kind FROM orders o JOIN kinds k ON o.o_orderkey % 30 = k.i""",
    ),
    "f2_local_labels": ("", "SELECT o_orderkey, CASE WHEN trim(o_orderpriority) = '' THEN NULL WHEN lower(trim(o_orderpriority)) IN ('none', 'no', 'なし', '静止', '5-low') THEN 'none' ELSE 'moving' END AS kind FROM orders"),
    "f3_path_parts": ("", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(url, '([^/.]*)[.]?[^/.]*$', 1) AS stem, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages"),
    "f5_padded_ids": ("", "SELECT page_id, lpad(CAST(page_id AS STRING), 8, '0') AS id FROM pages"),
    "f14_shape_features": ("", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(l_quantity, l_tax * 100e0) / greatest(1e0, least(l_quantity, l_tax * 100e0)), 6) AS elongation, round(l_quantity / greatest(1e0, l_quantity * l_tax * 100e0), 6) AS fill FROM lineitem"),
    "f18_json_values": ("", "SELECT event_id, @json_k AS k FROM events"),
    "p7_source_filter": ("", "SELECT doc_id, source FROM documents WHERE source LIKE '%5' AND n_chars IS NOT NULL"),
    "p9_conditional_fields": ("moves", "SELECT shot, f, round(tx, 6) AS tx, round(ty, 6) AS ty, CASE WHEN size >= 4e0 THEN round(size, 6) END AS scale, CASE WHEN size < 4e0 AND size >= 2e0 THEN round(size * 10e0, 6) END AS rotation FROM moves"),
    "p10_media_defaults": ("", """defaults AS (SELECT * FROM (VALUES ('A', true, false, false), ('N', false, true, false), ('R', false, false, false)) v(media, dust, line, scan))
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, coalesce(CASE WHEN l.l_quantity > 40 THEN true END, d.dust) AS dust, d.line, d.scan FROM lineitem l JOIN defaults d ON l.l_returnflag = d.media"""),
    "p14_proxy_bypass": ("", "SELECT doc_id, CASE WHEN n_chars < 512 THEN 'pass' ELSE 'render' END AS mode FROM documents"),
    "t6_file_order": ("", "SELECT url, CAST(row_number() OVER (ORDER BY url, page_id) AS BIGINT) AS k FROM pages"),
    "j11_positional_zip": ("", """a AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant')
SELECT a.conv_id, CAST(a.k AS BIGINT) AS k, a.turn AS first, b.turn AS second FROM a JOIN b ON a.conv_id = b.conv_id AND a.k = b.k"""),
    # the signs of the 64 components, as two numbers of 32 bits; each shot against the next one
    "j12_mutual_match": ("px", """code AS (SELECT shot, f, CAST(sum(CASE WHEN v > 127.5e0 AND p < 32 THEN power(2e0, p) ELSE 0e0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN v > 127.5e0 AND p >= 32 THEN power(2e0, p - 32) ELSE 0e0 END) AS BIGINT) AS high FROM px GROUP BY shot, f),
turn AS (SELECT shot, lead(shot) OVER (ORDER BY shot) AS other FROM (SELECT DISTINCT shot FROM code)),
d AS (SELECT q.shot, q.f AS a, r.f AS b, CAST(bit_count(@xor(q.low, r.low)) AS BIGINT) + CAST(bit_count(@xor(q.high, r.high)) AS BIGINT) AS x FROM code q JOIN turn ON q.shot = turn.shot JOIN code r ON r.shot = turn.other),
there AS (SELECT shot, a, min(x * 1099511627776 + b) AS best FROM d GROUP BY shot, a),
back AS (SELECT shot, b, min(x * 1099511627776 + a) AS best FROM d GROUP BY shot, b)
SELECT t.shot, CAST(t.a AS BIGINT) AS a, CAST(r.b AS BIGINT) AS b, CAST(floor(t.best / 1099511627776e0) AS BIGINT) AS distance FROM there t JOIN back r ON t.shot = r.shot AND t.best % 1099511627776 = r.b AND r.best % 1099511627776 = t.a"""),
}
