"""Profiles: running medians and minima, line noise, scan noise, spectra."""

_MIRROR = """edge AS (SELECT max(i) AS m FROM days),
wide AS (SELECT i, v FROM days UNION ALL SELECT -1 - i, v FROM days WHERE i < 4 UNION ALL SELECT 2 * m + 1 - i, v FROM days CROSS JOIN edge WHERE i > m - 4),
smooth AS (SELECT i, v, @framed_median AS med FROM wide WINDOW w AS (ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
dev AS (SELECT s.i, s.v, s.v - s.med AS d FROM smooth s CROSS JOIN edge WHERE s.i BETWEEN 0 AND m)"""
# the whole profile, and all waves up to half as many as it has rows; whole turns are left out of the angles, for precision
_DFT = """size AS (SELECT count(*) AS n FROM hours),
waves AS (SELECT h.i AS k, sum(r.mean * cos(2e0 * pi() * ((h.i * r.i) % n) / n)) AS re, sum(r.mean * sin(2e0 * pi() * ((h.i * r.i) % n) / n)) AS im, max(n) AS n FROM hours h CROSS JOIN size CROSS JOIN hours r WHERE h.i BETWEEN 1 AND floor(n / 2e0) GROUP BY h.i),
spectrum AS (SELECT k, sqrt(re * re + im * im) AS mag, n FROM waves)"""
# bins that can be peaks, from 2 to the last but one, over their surroundings
_PEAKS = _DFT + """,
near AS (SELECT a.k, a.mag, a.n, median(b.mag) AS loc FROM spectrum a JOIN spectrum b ON b.k BETWEEN a.k - 8 AND a.k + 8 AND a.k <> b.k GROUP BY a.k, a.mag, a.n),
peaks AS (SELECT k, mag, n, mag / (loc + 1e-6) AS snr FROM near WHERE k BETWEEN 2 AND floor(n / 2e0) - 1)"""
# rows off their surroundings by their medians, and uniformly: over the columns, against the mean of the two rows on either side
_LINES = _MIRROR + """,
mid AS (SELECT median(d) AS m FROM dev), mad AS (SELECT median(abs(d - m)) AS x FROM dev CROSS JOIN mid),
off AS (SELECT a.i, a.x, max(a.v) - avg(b.v) AS d FROM cells a JOIN cells b ON a.x = b.x AND b.i BETWEEN a.i - 2 AND a.i + 2 AND a.i <> b.i GROUP BY a.i, a.x),
off_mid AS (SELECT i, median(d) AS m FROM off GROUP BY i),
line AS (SELECT off.i, m, avg(CASE WHEN sign(d) = sign(m) THEN 1e0 ELSE 0e0 END) AS agree FROM off JOIN off_mid ON off.i = off_mid.i GROUP BY off.i, m),
noise AS (SELECT dev.i, m AS d FROM dev CROSS JOIN mad JOIN line ON dev.i = line.i WHERE abs(d) > greatest(1.5e0, 5e0 * 1.4826e0 * x) AND abs(m) >= 1.5e0 AND agree >= 0.6e0)"""

QUERIES = {
    "a18_median_profile": ("hours", "SELECT CAST(i AS BIGINT) AS i, round(med, 6) AS med, round(mean, 6) AS mean FROM hours"),
    "w7_running_median": ("days", f"""{_MIRROR}
SELECT CAST(i AS BIGINT) AS i, round(v - d, 6) AS med FROM dev"""),
    "w8_horizontal_median": ("px", "SELECT shot, CAST(f AS BIGINT) AS f, CAST(p AS BIGINT) AS p, round(@framed_median, 6) AS med FROM px WINDOW w AS (PARTITION BY shot, f, floor(p / 8e0) ORDER BY p ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"),
    "w9_vertical_minimum": ("px", "SELECT shot, CAST(f AS BIGINT) AS f, CAST(p AS BIGINT) AS p, round(min(v) OVER (PARTITION BY shot, f, p % 8 ORDER BY p ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 6) AS low FROM px"),
    "w12_neighbour_baseline": ("hours", "SELECT CAST(i AS BIGINT) AS i, round(((sum(mean) OVER w) - mean) / ((count(*) OVER w) - 1), 6) AS base FROM hours WINDOW w AS (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "c13_line_noise": ("days cells", f"""{_LINES}
SELECT CAST(i AS BIGINT) AS i, round(d, 6) AS offset_value FROM noise"""),
    "c14_line_correction": ("days cells", f"""{_LINES}
SELECT CAST(days.i AS BIGINT) AS i, round(days.v - coalesce(noise.d, 0e0), 6) AS v FROM days LEFT JOIN noise ON days.i = noise.i"""),
    "k16_spectrum": ("hours", f"""{_DFT}
SELECT CAST(k AS BIGINT) AS k, round(mag, 4) AS mag FROM spectrum"""),
    "w10_spectral_median": ("hours", f"""{_DFT}
SELECT CAST(a.k AS BIGINT) AS k, round(median(b.mag), 4) AS local FROM spectrum a JOIN spectrum b ON b.k BETWEEN a.k - 8 AND a.k + 8 AND a.k <> b.k GROUP BY a.k"""),
    "c15_scan_noise": ("hours", f"""{_PEAKS},
hits AS (SELECT * FROM peaks WHERE snr >= 8e0 AND 2e0 * mag / n >= 0.3e0 AND CAST(n AS DOUBLE) / k BETWEEN 2e0 AND 64e0),
best AS (SELECT @kept AS ks FROM hits)
SELECT CAST(k AS BIGINT) AS k, round(CAST(n AS DOUBLE) / k, 6) AS period, round(2e0 * mag / n, 4) AS amplitude, round(snr, 3) AS snr FROM hits CROSS JOIN best WHERE array_contains(ks, CAST(k AS BIGINT))"""),
    "w11_suppressed_peaks": ("hours", f"""{_PEAKS},
best AS (SELECT @kept AS ks FROM peaks)
SELECT CAST(k AS BIGINT) AS k, round(mag, 4) AS mag FROM peaks CROSS JOIN best WHERE array_contains(ks, CAST(k AS BIGINT))"""),
    "a13_noise_floor": ("pairs", """each AS (SELECT shot, @quantile(abs(luma - before), 0.995e0) AS q FROM pairs WHERE before IS NOT NULL GROUP BY shot)
SELECT round(greatest(coalesce(median(q), 3e0), 3e0), 6) AS floor_value FROM each"""),
    "k19_quantiles": ("frames", "SELECT shot, round(@quantile(luma, 0.25e0), 6) AS q25, round(median(luma), 6) AS q50, round(@quantile(luma, 0.995e0), 6) AS q995 FROM frames GROUP BY shot"),
    "k18_histogram": ("frames", "SELECT shot, CAST(floor(luma / 16e0) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM frames GROUP BY 1, 2"),
}
