"""Per-pixel statistics over groups of five frames: references, residuals, masks."""

_REF = "ref AS (SELECT shot, g, p, median(v) AS r, count(*) AS n FROM px GROUP BY shot, g, p)"
_RES = _REF + ",\nres AS (SELECT px.shot, px.g, px.f, px.p, px.v, ref.r, px.v - ref.r AS d FROM px JOIN ref ON px.shot = ref.shot AND px.g = ref.g AND px.p = ref.p)"
_SIGMA = _RES + ",\nsigma AS (SELECT shot, g, greatest(1.4826e0 * median(abs(d)), 0.5e0) AS s FROM res GROUP BY shot, g)"
_GRAY = "gray AS (SELECT shot, f, g, p, v AS r, 255e0 - v AS gr, (v + 64e0) / 2e0 AS b FROM px)"

QUERIES = {
    "p1_gray": ("px", f"""{_GRAY}
SELECT shot, CAST(f AS BIGINT) AS f, CAST(p AS BIGINT) AS p, CAST(floor(0.114e0 * b + 0.587e0 * gr + 0.299e0 * r + 0.5e0) AS BIGINT) AS y FROM gray"""),
    "p2_hash_gray": ("px", f"""{_GRAY}
SELECT shot, CAST(f AS BIGINT) AS f, CAST(p AS BIGINT) AS p, round((r * 299 + gr * 587 + b * 114) / 1000e0, 6) AS y FROM gray"""),
    "p3_luma": ("px", f"""{_GRAY}
SELECT shot, CAST(f AS BIGINT) AS f, CAST(p AS BIGINT) AS p, round(0.114e0 * b + 0.587e0 * gr + 0.299e0 * r, 6) AS y FROM gray"""),
    "p5_active_area": ("px", "SELECT shot, CAST(f AS BIGINT) AS f, CAST(count(*) AS BIGINT) AS n, round(avg(v), 6) AS mean FROM px WHERE floor(p / 8e0) BETWEEN 1 AND 6 AND p % 8 BETWEEN 1 AND 6 GROUP BY shot, f"),
    "s13_host_image": ("px", "SELECT shot, CAST(f AS BIGINT) AS f, CAST(p AS BIGINT) AS p, CAST(least(255e0, greatest(0e0, floor(v / 255e0 * 255e0 + 0.5e0))) AS BIGINT) AS u FROM px"),
    "a1_mean_abs_diff": ("px", "SELECT a.shot, CAST(a.f AS BIGINT) AS f, round(avg(abs(a.v - b.v)), 6) AS diff FROM px a JOIN px b ON a.shot = b.shot AND b.f = a.f + 1 AND a.p = b.p GROUP BY a.shot, a.f"),
    "a3_hash_bits": ("px", """mid AS (SELECT shot, f, median(v) AS m FROM px GROUP BY shot, f)
SELECT px.shot, CAST(px.f AS BIGINT) AS f, CAST(px.p AS BIGINT) AS p, px.v > m AS bit FROM px JOIN mid ON px.shot = mid.shot AND px.f = mid.f"""),
    "f6_hamming": ("px", """mid AS (SELECT shot, f, median(v) AS m FROM px GROUP BY shot, f),
bits AS (SELECT px.shot, px.f, px.p, px.v > m AS bit FROM px JOIN mid ON px.shot = mid.shot AND px.f = mid.f)
SELECT a.shot, CAST(a.f AS BIGINT) AS f, CAST(count_if(a.bit <> b.bit) AS BIGINT) AS distance FROM bits a JOIN bits b ON a.shot = b.shot AND b.f = a.f + 1 AND a.p = b.p GROUP BY a.shot, a.f"""),
    "a7_median_reference": ("px", f"""{_REF}
SELECT shot, g, CAST(p AS BIGINT) AS p, round(r, 6) AS r FROM ref"""),
    # the median where a quarter of the frames is less than one
    "a7_trimmed_reference": (
        "px",
        """ranked AS (SELECT shot, g, p, v, row_number() OVER (PARTITION BY shot, g, p ORDER BY v) AS k, count(*) OVER (PARTITION BY shot, g, p) AS n FROM px),
cut AS (SELECT *, floor(n / 4e0) AS q FROM ranked)
SELECT shot, g, CAST(p AS BIGINT) AS p, round(CASE WHEN max(q) = 0 THEN median(v) ELSE avg(CASE WHEN k > q AND k <= n - q THEN v END) END, 6) AS r FROM cut GROUP BY shot, g, p""",
        "px",
        """sorted AS (SELECT shot, g, p, list_sort(list(v)) AS x FROM px GROUP BY shot, g, p)
SELECT shot, g, CAST(p AS BIGINT) AS p, round(list_avg(CASE WHEN len(x) >= 4 THEN x[len(x) // 4 + 1 : len(x) - len(x) // 4] ELSE x[(len(x) + 1) // 2 : len(x) // 2 + 1] END), 6) AS r FROM sorted""",
    ),
    "a8_grain_sigma": ("px", f"""{_SIGMA}
SELECT shot, g, round(s, 6) AS sigma FROM sigma"""),
    "a9_flicker": ("px", f"""{_RES},
off AS (SELECT shot, g, f, median(d) AS o FROM res GROUP BY shot, g, f),
need AS (SELECT shot, g, max(abs(o)) > 0.25e0 AS fix FROM off GROUP BY shot, g)
SELECT off.shot, off.g, CAST(f AS BIGINT) AS f, round(CASE WHEN fix THEN o ELSE 0e0 END, 6) AS correction FROM off JOIN need ON off.shot = need.shot AND off.g = need.g"""),
    "a10_misaligned": ("px", f"""{_RES},
per AS (SELECT shot, g, f, median(abs(d)) AS m FROM res GROUP BY shot, g, f),
mid AS (SELECT shot, g, median(m) AS mm FROM per GROUP BY shot, g)
SELECT per.shot, per.g, CAST(f AS BIGINT) AS f, m > greatest(2e0, 2.5e0 * greatest(mm, 0.1e0)) AS misaligned FROM per JOIN mid ON per.shot = mid.shot AND per.g = mid.g"""),
    "a12_guard_share": ("px", f"""{_SIGMA}
SELECT res.shot, res.g, CAST(p AS BIGINT) AS p, round(avg(CASE WHEN abs(d) > greatest(6e0, 4e0 * s) THEN 1e0 ELSE 0e0 END), 6) AS share FROM res JOIN sigma ON res.shot = sigma.shot AND res.g = sigma.g GROUP BY res.shot, res.g, p"""),
    "f12_thresholds": ("px", f"""{_SIGMA}
SELECT shot, g, round(greatest(8e0, 5e0 * s), 6) AS dust, round(greatest(6e0, 4e0 * s), 6) AS guard, round(greatest(6e0, 5e0 * s), 6) AS unsafe, round(greatest(3e0, 3e0 * s * sqrt(0.4e0)), 6) AS accept, round(least(15e0, greatest(1e0, 1.2e0 * s * 0.3e0)), 6) AS nlm FROM sigma"""),
    "j10_leave_one_out": ("px", "SELECT a.shot, CAST(a.f AS BIGINT) AS f, CAST(a.p AS BIGINT) AS p, round(a.v - median(b.v), 6) AS d FROM px a JOIN px b ON a.shot = b.shot AND a.g = b.g AND a.p = b.p AND a.f <> b.f GROUP BY a.shot, a.f, a.p, a.v"),
    "c4_dust_candidates": ("px", f"""{_SIGMA},
other AS (SELECT a.shot, a.g, a.f, a.p, median(abs(b.d)) AS o FROM res a JOIN res b ON a.shot = b.shot AND a.g = b.g AND a.p = b.p AND a.f <> b.f GROUP BY a.shot, a.g, a.f, a.p)
SELECT res.shot, CAST(res.f AS BIGINT) AS f, CAST(res.p AS BIGINT) AS p FROM res JOIN sigma ON res.shot = sigma.shot AND res.g = sigma.g JOIN other ON res.shot = other.shot AND res.f = other.f AND res.p = other.p WHERE abs(d) > greatest(8e0, 5e0 * s) AND o < 0.4e0 * greatest(8e0, 5e0 * s)"""),
    "a30_dust_count": ("px", f"""{_SIGMA}
SELECT res.shot, CAST(f AS BIGINT) AS f, CAST(count_if(abs(d) > greatest(8e0, 5e0 * s)) AS BIGINT) AS n FROM res JOIN sigma ON res.shot = sigma.shot AND res.g = sigma.g GROUP BY res.shot, f"""),
    "a16_persistence": ("px", f"""{_REF}
SELECT shot, CAST(p AS BIGINT) AS p, round(min(r), 6) AS low FROM ref GROUP BY shot, p"""),
    "a17_column_coverage": ("px", f"""{_REF},
low AS (SELECT shot, p, min(abs(r - 127.5e0)) AS m FROM ref GROUP BY shot, p)
SELECT shot, CAST(p % 8 AS BIGINT) AS x, round(avg(CASE WHEN m > 1e0 THEN 1e0 ELSE 0e0 END), 6) AS coverage, round(avg(CASE WHEN m > 1e0 THEN m END), 6) AS strength FROM low GROUP BY shot, p % 8 HAVING avg(CASE WHEN m > 1e0 THEN 1e0 ELSE 0e0 END) > 0.25e0"""),
    "a20_extended_reference": ("px", f"""{_REF},
mix AS (SELECT c.shot, c.g, c.p, c.r, c.n, sum(CASE WHEN abs(o.r - c.r) <= 20e0 THEN o.n ELSE 0 END) AS m, sum(CASE WHEN abs(o.r - c.r) <= 20e0 THEN o.n * o.r ELSE 0e0 END) AS mr FROM ref c JOIN ref o ON c.shot = o.shot AND c.p = o.p AND o.g BETWEEN c.g - 2 AND c.g + 2 AND o.g <> c.g GROUP BY c.shot, c.g, c.p, c.r, c.n)
SELECT shot, g, CAST(p AS BIGINT) AS p, round((r * n + mr) / (n + m), 6) AS r, CAST(n + m AS BIGINT) AS effective_n FROM mix"""),
    "a21_accept_ratio": ("px", f"""{_REF}
SELECT c.shot, c.g, o.g AS other, round(avg(CASE WHEN abs(o.r - c.r) <= 20e0 THEN 1e0 ELSE 0e0 END), 6) AS ratio FROM ref c JOIN ref o ON c.shot = o.shot AND c.p = o.p AND o.g BETWEEN c.g - 2 AND c.g + 2 AND o.g <> c.g GROUP BY c.shot, c.g, o.g HAVING avg(CASE WHEN abs(o.r - c.r) <= 20e0 THEN 1e0 ELSE 0e0 END) >= 0.05e0"""),
    "u2_mask_algebra": ("px", "SELECT a.shot, CAST(a.f AS BIGINT) AS f, CAST(count_if(a.v > 140e0 AND b.v > 140e0) AS BIGINT) AS both, CAST(count_if(a.v > 140e0 OR b.v > 140e0) AS BIGINT) AS either, CAST(count_if(a.v > 140e0 AND NOT b.v > 140e0) AS BIGINT) AS only_first, round(count_if(a.v > 140e0 AND b.v > 140e0) / greatest(1e0, count_if(a.v > 140e0 OR b.v > 140e0)), 6) AS iou FROM px a JOIN px b ON a.shot = b.shot AND b.f = a.f + 1 AND a.p = b.p GROUP BY a.shot, a.f"),
    "a28_flicker_metric": ("px", "SELECT shot, round(avg(m), 6) AS flicker FROM (SELECT a.shot, a.f, avg(abs(a.v - b.v)) AS m FROM px a JOIN px b ON a.shot = b.shot AND b.f = a.f + 1 AND a.p = b.p GROUP BY a.shot, a.f) GROUP BY shot"),
    "a31_histogram_distance": ("px", """bins AS (SELECT shot, f, CAST(floor(v / 16e0) AS BIGINT) AS k, CAST(count(*) AS DOUBLE) AS n FROM px GROUP BY 1, 2, 3)
SELECT a.shot, CAST(a.f AS BIGINT) AS f, round(sqrt(greatest(0e0, 1e0 - sum(sqrt(a.n * b.n)) / 64e0)), 6) AS distance FROM bins a JOIN bins b ON a.shot = b.shot AND b.f = a.f + 1 AND a.k = b.k GROUP BY a.shot, a.f"""),
    "a32_psnr": ("px", "SELECT a.shot, CAST(a.f AS BIGINT) AS f, round(10e0 * log10(65025e0 / avg((a.v - b.v) * (a.v - b.v))), 6) AS psnr FROM px a JOIN px b ON a.shot = b.shot AND b.f = a.f + 1 AND a.p = b.p GROUP BY a.shot, a.f HAVING avg((a.v - b.v) * (a.v - b.v)) > 0"),
    "t5_pixel_sort": ("px", "SELECT shot, g, CAST(p AS BIGINT) AS p, CAST(row_number() OVER (PARTITION BY shot, g, p ORDER BY v) AS BIGINT) AS k, round(v, 6) AS v FROM px"),
    "f15_saturate": ("px", "SELECT shot, CAST(f AS BIGINT) AS f, CAST(p AS BIGINT) AS p, CAST(floor(least(255e0, greatest(0e0, v * 1.5e0))) AS BIGINT) AS u FROM px"),
    "c10_blend_weight": ("px", f"""{_REF}
SELECT shot, g, CAST(p AS BIGINT) AS p, round(r * (1e0 - 1e0 / greatest(n, 1)) + 127.5e0 / greatest(n, 1), 6) AS v FROM ref"""),
}
