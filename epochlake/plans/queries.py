"""Registry queries: each applies an operator to whole driver tables, with SQL beside it where SQL can express it.

Roles of the tables: events is one recording per user with its errors as triggers; embeddings are single-channel epochs of
64 samples whose label is the event size; lineitem, orders, customer and nation are events, sessions, subjects and
populations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BANDS, REGIONS, AnalysisConfig
from ..functions.columns import axis_range, geometric_grid, grid_array, n_cycles, select_frequencies, time_slice
from ..operators import averages as A
from ..operators import blocks, catalog, epochs, montage, normalize, ranks, spectral
from ..sources import sinks
from . import pipeline, resume

DAY = 86_400_000_000
N, HALF, BASELINE, RESPONSE = 64, 1.0, (-1.0, -0.5), (-0.2, 0.0)
FREQS = [3.0, 4.0, 5.0, 6.0, 7.0]
FS = 64.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# -- events as recordings ------------------------------------------------------


def recording(spark, d) -> tuple[DataFrame, DataFrame]:
    """(samples: subject, t in microseconds, v; triggers: subject, event_id, size, e)."""
    ev = table(spark, d, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    samples = ev.select(F.col("user_id").alias("subject"), t.alias("t"), F.col("value").alias("v"))
    errors = ranks.numbered(ev.where("event_type = 'error'").select("user_id", "event_id", "value", t.alias("e")), ["user_id"], ["value", "event_id"])
    triggers = errors.select(F.col("user_id").alias("subject"), "event_id", ranks.size_class(F.col("i"), F.col("n"), 3).alias("size"), "e")
    return samples, triggers


E_SQL = """
WITH s AS (SELECT user_id AS subject, epoch_us(ts) AS t, value AS v FROM events),
g AS (SELECT user_id AS subject, event_id, ntile(3) OVER (PARTITION BY user_id ORDER BY value, event_id) AS size, epoch_us(ts) AS e FROM events WHERE event_type = 'error'),
b AS (SELECT subject, min(t) AS lo, max(t) AS hi FROM s GROUP BY subject),
w AS (SELECT g.subject, event_id, size, e, t, v, t - e AS dt FROM g JOIN b USING (subject) JOIN s USING (subject)
      WHERE e - {h} >= lo AND e + {h} <= hi AND t >= e - {h} AND t < e + {h})
""".format(h=2 * DAY)


def windows(spark, d) -> DataFrame:
    samples, triggers = recording(spark, d)
    return epochs.event_windows(epochs.bounded_events(triggers, samples, 2 * DAY, ["subject"]), samples, 2 * DAY, ["subject"])


@query(E_SQL + f"""
, e1 AS (SELECT subject, size, event_id, avg(v) FILTER (dt <= {-DAY}) AS b FROM w GROUP BY ALL),
st AS (SELECT subject, size, avg(b) AS mu, greatest(stddev_pop(b), 1e-12) AS sd FROM e1 GROUP BY ALL HAVING count(b) >= 3),
z AS (SELECT w.subject, w.size, avg((v - mu) / sd) AS z FROM w JOIN st USING (subject, size) WHERE dt BETWEEN {-DAY * 2 // 5} AND 0 GROUP BY ALL)
SELECT size, count(z) AS n, round(avg(z), 6) AS mean, round(stddev_samp(z) / sqrt(count(z)), 6) AS se FROM z GROUP BY size""")
def event_locked_z_by_size(spark, d):
    """Flagship: interval join, cross-event baseline, per-subject means, population mean and standard error by size."""
    w = windows(spark, d)
    z = epochs.baseline_z(w, ["subject", "size"], ["event_id"], F.col("dt") <= -DAY, F.col("dt").between(-DAY * 2 // 5, 0), 3)
    return A.mean_and_error(z, ["size"], "z").select("size", "n", r6("mean").alias("mean"), r6("se").alias("se"))


@query(E_SQL + "SELECT subject, event_id, count(*) AS n_samples, min(dt) AS first_dt, max(dt) AS last_dt FROM w GROUP BY ALL")
def epoch_windows_halfopen(spark, d):
    return windows(spark, d).groupBy("subject", "event_id").agg(F.count(F.lit(1)).alias("n_samples"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


@query(E_SQL + "SELECT subject, event_id, size, t, v, dt FROM w")
def block_event_windows(spark, d):
    """The windows' samples again, from recordings stored as blocks of five days: what moves is blocks."""
    samples, triggers = recording(spark, d)
    stored = blocks.time_blocks(samples, ["subject"], 5 * DAY)
    w = blocks.block_windows(triggers, stored, 2 * DAY, ["subject"], 5 * DAY)
    return w.select("subject", "event_id", "size", "e", F.inline("s")).withColumn("dt", F.col("t") - F.col("e")).drop("e")


@query(E_SQL + """
, r AS (SELECT subject, event_id, v, row_number() OVER (PARTITION BY subject, event_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY subject, event_id) AS n FROM w),
k AS (SELECT DISTINCT subject, event_id, n, unnest(range(8)) AS k FROM r),
p AS (SELECT subject, event_id, k, CASE WHEN n >= 8 THEN k + (n - 8) // 2 ELSE least(greatest(k - (8 - n) // 2, 0), n - 1) END AS i FROM k)
SELECT p.subject, p.event_id, CAST(k AS INTEGER) AS k, v FROM p JOIN r ON p.subject = r.subject AND p.event_id = r.event_id AND p.i = r.i""")
def epoch_windows_trim_pad(spark, d):
    w = epochs.window_arrays(windows(spark, d), ["subject", "event_id"])
    return w.select("subject", "event_id", F.posexplode(epochs.trim_or_pad(F.col("w"), 8)).alias("k", "v"))


@query(E_SQL + "SELECT subject, event_id, count(*) AS n_samples FROM w GROUP BY ALL HAVING abs(count(*) - 9) <= 3")
def epoch_windows_tolerance(spark, d):
    n = windows(spark, d).groupBy("subject", "event_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return n.where(epochs.within_tolerance(F.col("n_samples"), 9, least=3))


@query("""
WITH s AS (SELECT user_id, epoch_us(ts) AS t, value AS v FROM events WHERE event_type = 'click'),
g AS (SELECT user_id, event_id, epoch_us(ts) AS e FROM events WHERE event_type = 'error'),
j AS (SELECT g.user_id, event_id, t - e AS lag, v, row_number() OVER (PARTITION BY event_id ORDER BY abs(t - e), t) AS k FROM g JOIN s USING (user_id))
SELECT user_id AS subject, event_id, lag, v FROM j WHERE k = 1""")
def nearest_sample_asof(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("subject"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("v"))
    samples = ev.where("event_type = 'click'").select("subject", "t", "v")
    triggers = ev.where("event_type = 'error'").select("subject", "event_id", F.col("t").alias("e"))
    return epochs.nearest_sample(triggers, samples, ["subject"]).select("subject", "event_id", (F.col("t") - F.col("e")).alias("lag"), "v")


@query("""
WITH s AS (SELECT user_id AS subject, epoch_us(ts) AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT user_id AS subject, event_id, epoch_us(ts) + 3600000000 AS e FROM events WHERE event_type = 'error'),
j AS (SELECT g.subject, event_id, greatest(i - 4, 0) AS first, n, row_number() OVER (PARTITION BY event_id ORDER BY abs(t - e), t) AS k FROM g JOIN s ON g.subject = s.subject)
SELECT j.subject, event_id, CAST(s.i - first AS INTEGER) AS k, v FROM j JOIN s ON s.subject = j.subject AND s.i >= first AND s.i < first + 9 WHERE j.k = 1 AND first + 9 <= j.n""")
def nearest_windows_fixed(spark, d):
    """Nine samples around the sample nearest to an hour after each trigger."""
    samples, triggers = recording(spark, d)
    late = triggers.select("subject", "event_id", (F.col("e") + 3_600_000_000).alias("e"))
    return epochs.nearest_windows(late, samples, 9, ["subject"]).select("subject", "event_id", "k", "v")


@query("SELECT user_id AS subject, round(avg(value), 6) AS mu, round(greatest(stddev_pop(value), 1e-12), 6) AS sd, count(value) AS n FROM events GROUP BY user_id")
def global_stats_floor(spark, d):
    return normalize.global_statistics(recording(spark, d)[0], ["subject"]).select("subject", r6("mu").alias("mu"), r6("sd").alias("sd"), "n")


@query("""WITH s AS (SELECT user_id, avg(value) AS mu, greatest(stddev_pop(value), 1e-12) AS sd FROM events GROUP BY user_id)
SELECT user_id AS subject, epoch_us(ts) AS t, round((value - mu) / sd, 6) AS z FROM events JOIN s USING (user_id)""")
def norm_channel_global_z(spark, d):
    return normalize.channel_global(recording(spark, d)[0], ["subject"]).select("subject", "t", r6("z").alias("z"))


@query(E_SQL + """, st AS (SELECT subject, avg(v) AS mu, greatest(stddev_pop(v), 1e-12) AS sd FROM s GROUP BY subject)
SELECT subject, size, event_id, round(avg((v - mu) / sd), 6) AS z FROM w JOIN st USING (subject) GROUP BY ALL""")
def norm_window_global(spark, d):
    w = epochs.window_arrays(windows(spark, d), ["subject", "size", "event_id"])
    z = normalize.window_global(w, normalize.global_statistics(recording(spark, d)[0], ["subject"]), ["subject"])
    mean = F.aggregate("w", F.lit(0.0), lambda a, x: a + x) / F.size("w")
    return z.select("subject", "size", "event_id", r6(mean).alias("z"))


@query("""WITH s AS (SELECT user_id AS subject, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS step FROM events)
SELECT subject, quantile_cont(CAST(step AS DOUBLE), 0.5) AS interval, count(step) AS n FROM s GROUP BY subject""")
def sampling_interval_median(spark, d):
    return epochs.sampling_interval(recording(spark, d)[0], ["subject"])


# -- embeddings as epochs ------------------------------------------------------


def epoch_arrays(spark, d, *more: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", *more, F.col("embedding").cast("array<double>").alias("w"))


X_SQL = "WITH x AS (SELECT vec_id, label, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)\n"
_B, _R = axis_range(N, HALF, *BASELINE), axis_range(N, HALF, *RESPONSE)
K_SQL = {"base": f"k BETWEEN {_B[0]} AND {_B[-1]}", "resp": f"k BETWEEN {_R[0]} AND {_R[-1]}"}
ST_SQL = X_SQL + f""", e AS (SELECT vec_id, label, avg(v) AS b FROM x WHERE {K_SQL['base']} GROUP BY ALL),
st AS (SELECT label, avg(b) AS mu, greatest(stddev_pop(b), 1e-12) AS sd, stddev_pop(b) AS raw, count(b) AS n FROM e GROUP BY label)
"""


@query(ST_SQL + f"""SELECT label, round(mu, 6) AS mu, round(sd, 6) AS sd, n AS n_events, {len(_B)} AS n_baseline_samples,
concat_ws(',', CASE WHEN n < 3 THEN 'few_events' END, CASE WHEN raw < 1e-6 THEN 'tiny_std' END) AS warnings FROM st""")
def baseline_stats_two_level(spark, d):
    s = normalize.baseline_statistics(epoch_arrays(spark, d), ["label"], N, HALF, BASELINE)
    return s.select("label", r6("mu").alias("mu"), r6("sd").alias("sd"), "n_events", "n_baseline_samples", F.array_join("warnings", ",").alias("warnings"))


def _by_sample(w: DataFrame) -> DataFrame:
    return w.select("label", F.posexplode("w").alias("k", "z")).groupBy("label", "k").agg(r6(F.avg("z")).alias("z"))


@query(ST_SQL + "SELECT x.label, CAST(k AS INTEGER) AS k, round(avg((v - mu) / sd), 6) AS z FROM x JOIN st USING (label) GROUP BY ALL")
def norm_baseline_cross_event(spark, d):
    return _by_sample(normalize.baseline_cross_event(epoch_arrays(spark, d), ["label"], N, HALF, BASELINE))


@query(X_SQL + f""", e AS (SELECT vec_id, avg(v) AS mu, greatest(stddev_pop(v), 1e-12) AS sd FROM x WHERE {K_SQL['base']} GROUP BY ALL)
SELECT label, CAST(k AS INTEGER) AS k, round(avg((v - mu) / sd), 6) AS z FROM x JOIN e USING (vec_id) GROUP BY ALL""")
def norm_baseline_per_event(spark, d):
    return _by_sample(normalize.baseline_per_event(epoch_arrays(spark, d), N, HALF, BASELINE))


@query(ST_SQL + """, gl AS (SELECT label, avg(v) AS gm, greatest(stddev_pop(v), 1e-12) AS gs FROM x GROUP BY label),
z AS (SELECT x.label, (v - gm) / gs AS a, (v - mu) / sd AS b FROM x JOIN gl USING (label) JOIN st USING (label))
SELECT label, round(min(a), 6) AS global_min, round(max(a), 6) AS global_max, round(avg(a), 6) AS global_mean, round(stddev_pop(a), 6) AS global_std,
round(min(b), 6) AS baseline_min, round(max(b), 6) AS baseline_max, round(avg(b), 6) AS baseline_mean, round(stddev_pop(b), 6) AS baseline_std, round(corr(a, b), 6) AS r FROM z GROUP BY label""")
def norm_method_comparison(spark, d):
    w = epoch_arrays(spark, d)
    stats = normalize.baseline_statistics(w, ["label"], N, HALF, BASELINE).select("label", "mu", "sd")
    cells = w.select("label", F.explode("w").alias("v"))
    whole = normalize.global_statistics(cells, ["label"]).select("label", F.col("mu").alias("gm"), F.col("sd").alias("gs"))
    z = cells.join(stats, "label").join(whole, "label").select("label", ((F.col("v") - F.col("gm")) / F.col("gs")).alias("a"), ((F.col("v") - F.col("mu")) / F.col("sd")).alias("b"))
    out = A.compare_methods(z, ["label"], "a", "b")
    return out.select("label", *[r6(c).alias(c) for c in out.columns[1:]])


@query(X_SQL + f""", p AS (SELECT label, vec_id % 7 AS subject, avg(v) AS m FROM x WHERE {K_SQL['resp']} GROUP BY ALL)
SELECT label, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS se, count(m) AS n FROM p GROUP BY label""")
def band_power_mean_se(spark, d):
    w = epoch_arrays(spark, d)
    per = w.select("label", (F.col("vec_id") % 7).alias("subject"), normalize.array_mean(F.col("w"), _R).alias("m")).groupBy("label", "subject").agg(F.avg("m").alias("m"))
    return A.mean_and_error(per, ["label"], "m").select("label", r6("mean").alias("mean"), r6("se").alias("se"), "n")


@query(X_SQL + """, t AS (SELECT label, vec_id, k // 8 AS f, avg(v) AS m FROM x GROUP BY ALL), f AS (SELECT label, vec_id, avg(m) AS m FROM t GROUP BY ALL)
SELECT label, round(avg(m), 6) AS power FROM f GROUP BY label""")
def hierarchical_mean_scalar(spark, d):
    """Epochs as 8 frequencies of 8 samples: mean over time, then frequencies, then events."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda f: F.aggregate(F.slice("w", f * 8 + 1, F.lit(8)), F.lit(0.0), lambda a, x: a + x) / 8)
    one = F.aggregate(rows, F.lit(0.0), lambda a, x: a + x) / 8
    return epoch_arrays(spark, d).groupBy("label").agg(r6(F.avg(one)).alias("power"))


@query(X_SQL + """, c AS (SELECT label, k, avg(v) AS v FROM x GROUP BY ALL), q AS (SELECT quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM c)
SELECT -round_even(greatest(abs(a), abs(b)), 2) AS vmin, round_even(greatest(abs(a), abs(b)), 2) AS vmax FROM q""")
def color_limits_percentile(spark, d):
    cells = epoch_arrays(spark, d).select("label", F.posexplode("w").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("v"))
    return A.color_limits(cells, "v")


@query("SELECT label, round(avg(CAST(embedding[33] AS DOUBLE)), 6) AS profile, count(*) AS n_events FROM embeddings GROUP BY label")
def event_profile_at_zero(spark, d):
    """Mean value at the sample nearest the event: position n // 2 of the endpoint-inclusive axis, carried explicitly."""
    return epoch_arrays(spark, d).groupBy("label").agg(r6(F.avg(F.col("w")[N // 2])).alias("profile"), F.count(F.lit(1)).alias("n_events"))


@query(X_SQL + """SELECT label, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75 FROM x GROUP BY label""")
def percentile_diagnostics(spark, d):
    out = A.percentiles(epoch_arrays(spark, d).select("label", F.explode("w").alias("v")), ["label"], "v")
    return out.select("label", *[r6(c).alias(c) for c in out.columns[1:]])


@query(X_SQL + f""", p AS (SELECT vec_id % 5 AS session, vec_id % 3 AS subject, label % 3 + 1 AS size, avg(v) AS m FROM x WHERE {K_SQL['resp']} GROUP BY vec_id, label),
a AS (SELECT session, subject, size, avg(m) AS m FROM p GROUP BY ALL)
SELECT session AS session_number, subject AS "rat_ID", 8 AS electrode_number, coalesce(printf('%.6f', max(m) FILTER (size = 1)), 'nan') AS "NM_size1",
coalesce(printf('%.6f', max(m) FILTER (size = 2)), 'nan') AS "NM_size2", coalesce(printf('%.6f', max(m) FILTER (size = 3)), 'nan') AS "NM_size3" FROM a GROUP BY ALL""")
def pivot_theta_csv(spark, d):
    p = epoch_arrays(spark, d).select((F.col("vec_id") % 5).alias("session"), (F.col("vec_id") % 3).alias("subject"), F.lit(8).alias("electrode"), (F.col("label") % 3 + 1).alias("size"), normalize.array_mean(F.col("w"), _R).alias("power"))
    return sinks.theta_pivot(p, [1, 2, 3])


# -- spectra -------------------------------------------------------------------

F_SQL = "f AS (SELECT unnest([3.0e0, 4.0e0, 5.0e0, 6.0e0, 7.0e0]) AS freq)"


@query(X_SQL + f""", {F_SQL}, p AS (SELECT vec_id, label, freq, pow(sum(v * cos(2 * pi() * freq * k / 64)), 2) + pow(sum(v * sin(2 * pi() * freq * k / 64)), 2) AS p FROM x, f GROUP BY ALL)
SELECT label, freq, round(avg(p), 6) AS power FROM p GROUP BY ALL""")
def dft_power_3_7(spark, d):
    w = F.col("w")
    all_f = F.explode(F.array(*[F.struct(F.lit(f).alias("freq"), spectral.fourier_power(w, f, FS, N).alias("p")) for f in FREQS])).alias("x")
    return epoch_arrays(spark, d).select("label", all_f).groupBy("label", F.col("x.freq").alias("freq")).agg(r6(F.avg("x.p")).alias("power"))


MORLET_SQL = X_SQL + f""", {F_SQL},
s AS (SELECT freq, 3 + (freq - 3) / 4 AS c, (3 + (freq - 3) / 4) / (2 * pi() * freq) AS sigma FROM f),
j AS (SELECT freq, sigma, unnest(range(-CAST(ceil(5 * sigma * 64) AS BIGINT) + 1, CAST(ceil(5 * sigma * 64) AS BIGINT))) AS j FROM s),
u AS (SELECT freq, j, (cos(2 * pi() * freq * j / 64) - exp(-2 * pow(pi() * freq * sigma, 2))) * exp(-pow(j / 64e0, 2) / (2 * sigma * sigma)) AS re,
      sin(2 * pi() * freq * j / 64) * exp(-pow(j / 64e0, 2) / (2 * sigma * sigma)) AS im FROM j),
n AS (SELECT freq, sqrt(sum(re * re + im * im) / 2) AS norm FROM u GROUP BY freq),
q AS (SELECT u.freq, j, re / norm AS re, im / norm AS im FROM u JOIN n USING (freq)),
o AS (SELECT unnest(range(64)) AS k),
m AS (SELECT vec_id, label, freq, o.k, pow(sum(v * re), 2) + pow(sum(v * im), 2) AS p FROM o JOIN x ON true JOIN q ON q.j = o.k - x.k GROUP BY ALL)
"""


@query(MORLET_SQL + "SELECT label, freq, round(avg(p), 6) AS power FROM m GROUP BY ALL")
def morlet_power(spark, d):
    s = spectral.morlet_spectra(epoch_arrays(spark, d), ["vec_id", "label"], FREQS, FS)
    mean = F.aggregate("power", F.lit(0.0), lambda a, x: a + x) / F.size("power")
    return s.where("error IS NULL").groupBy("label", "freq").agg(r6(F.avg(mean)).alias("power"))


@query(MORLET_SQL + """, g AS (SELECT vec_id, freq, avg(p) AS mu, greatest(stddev_pop(p), 1e-12) AS sd FROM m GROUP BY ALL)
SELECT label, m.freq, CAST(k AS INTEGER) AS k, round(avg((p - mu) / sd), 6) AS z FROM m JOIN g ON m.vec_id = g.vec_id AND m.freq = g.freq GROUP BY ALL""")
def roi_morlet_z(spark, d):
    """Epochs of a label as channels of a region: z over each whole trace, then the mean over channels."""
    s = spectral.morlet_spectra(epoch_arrays(spark, d), ["vec_id", "label"], FREQS, FS, zscored=True)
    return spectral.region_mean(s, ["label"]).select("label", "freq", "k", r6("p").alias("z"))


WELCH_SQL = X_SQL + """, g AS (SELECT unnest([0, 16, 32]) AS g),
s AS (SELECT vec_id, label, g, k - g AS j, v FROM x, g WHERE k >= g AND k < g + 32),
c AS (SELECT vec_id, label, g, j, v - avg(v) OVER (PARTITION BY vec_id, g) AS v, 0.5 - 0.5 * cos(2 * pi() * j / 32) AS w FROM s),
b AS (SELECT unnest(range(17)) AS i),
p AS (SELECT vec_id, label, g, i, (pow(sum(v * w * cos(2 * pi() * i * j / 32)), 2) + pow(sum(v * w * sin(2 * pi() * i * j / 32)), 2)) / (64 * sum(w * w)) * CASE WHEN i IN (0, 16) THEN 1 ELSE 2 END AS p FROM c, b GROUP BY vec_id, label, g, i),
psd AS (SELECT label, 2.0e0 * i AS freq, avg(p.p) AS p FROM p GROUP BY label, i)
"""


def mean_psd(spark, d) -> DataFrame:
    return spectral.welch_psd(epoch_arrays(spark, d), ["vec_id", "label"], FS, 32).groupBy("label", "freq").agg(F.avg("p").alias("p"))


@query(WELCH_SQL + "SELECT label, freq, round(p, 6) AS psd FROM psd")
def welch_psd(spark, d):
    return mean_psd(spark, d).select("label", "freq", r6("p").alias("psd"))


@query(WELCH_SQL + ", t AS (SELECT label, freq, lead(freq) OVER w AS f2, p, lead(p) OVER w AS p2 FROM psd WINDOW w AS (PARTITION BY label ORDER BY freq))\nSELECT label, "
       + ", ".join(f"round(coalesce(sum((p + p2) / 2 * (f2 - freq)) FILTER (freq >= {lo} AND f2 <= {hi}), 0), 6) AS {name}" for name, (lo, hi) in BANDS.items()) + " FROM t GROUP BY label")
def band_power_trapz(spark, d):
    return A.band_power(mean_psd(spark, d), ["label"], BANDS).select("label", *[r6(b).alias(b) for b in BANDS])


@query(WELCH_SQL + ", r AS (SELECT label, freq, p, row_number() OVER (PARTITION BY label ORDER BY p DESC, freq) AS k FROM psd WHERE freq BETWEEN 1 AND 30)\nSELECT label, freq AS peak_freq, round(p, 6) AS peak_power FROM r WHERE k = 1")
def peak_frequency(spark, d):
    return A.peak_frequency(mean_psd(spark, d), ["label"], 1.0, 30.0).select("label", "peak_freq", r6("peak_power").alias("peak_power"))


@query(X_SQL + """, g AS (SELECT unnest(range(0, 49, 4)) AS g), s AS (SELECT vec_id, label, g, k - g AS j, v FROM x, g WHERE k >= g AND k < g + 16),
c AS (SELECT vec_id, label, g, j, v - avg(v) OVER (PARTITION BY vec_id, g) AS v, 0.5 - 0.5 * cos(pi() * least(1, least(j, 16 - j) / 2e0)) AS w FROM s),
b AS (SELECT unnest(range(9)) AS i),
p AS (SELECT vec_id, label, g, i, (pow(sum(v * w * cos(2 * pi() * i * j / 16)), 2) + pow(sum(v * w * sin(2 * pi() * i * j / 16)), 2)) / (64 * sum(w * w)) * CASE WHEN i IN (0, 8) THEN 1 ELSE 2 END AS p FROM c, b GROUP BY vec_id, label, g, i)
SELECT label, 4.0e0 * i AS freq, round(avg(p.p), 6) AS whole, round(avg(p.p) FILTER (g + 8 BETWEEN 16 AND 48), 6) AS clipped FROM p GROUP BY label, i""")
def stft_window_compare(spark, d):
    """Mean STFT power per label and frequency: of whole epochs, and clipped to their middle half."""
    w = epoch_arrays(spark, d)
    a = spectral.stft_mean(w, ["vec_id", "label"], FS, 16, 12).groupBy("label", "freq").agg(r6(F.avg("p")).alias("whole"))
    b = spectral.stft_mean(w, ["vec_id", "label"], FS, 16, 12, clip=0.25).groupBy("label", "freq").agg(r6(F.avg("p")).alias("clipped"))
    return a.join(b, ["label", "freq"])


def _literal_tapers(n: int, half_bandwidth: float) -> str:
    """VALUES (i, lam, k, h): tapers concentrated beyond 0.9, from dense matrices: eigenvectors of the tridiagonal one, their
    concentrations by that of sin(2 pi w (j - k)) / (pi (j - k))."""
    j, w = np.arange(n), half_bandwidth / n
    lag = np.subtract.outer(j, j)
    both = np.diag(j[1:] * (n - j[1:]) / 2.0, 1)
    v = np.linalg.eigh(np.diag(((n - 1 - 2 * j) / 2.0) ** 2 * np.cos(2 * np.pi * w)) + both + both.T)[1][:, ::-1]
    v = v[:, : int(2 * half_bandwidth) - 1]
    lam = ((2 * w * np.sinc(2 * w * lag)) @ v * v).sum(axis=0)
    return ", ".join(f"({i}, {float(lam[i])!r}::DOUBLE, {k}, {float(v[k, i])!r}::DOUBLE)" for i in range(v.shape[1]) if lam[i] > 0.9 for k in range(n))


@query(X_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""", tp AS (SELECT * FROM (VALUES {_literal_tapers(N, 4.0)}) t(i, lam, k, h)),
la AS (SELECT list(lam ORDER BY i) AS lam FROM (SELECT DISTINCT i, lam FROM tp) u),
c AS (SELECT vec_id, label, k, v - avg(v) OVER w AS v, var_pop(v) OVER w AS var FROM x WINDOW w AS (PARTITION BY vec_id)),
b AS (SELECT unnest(range(33)) AS b),
e AS (SELECT vec_id, label, i, b, min(var) AS var, pow(sum(v * h * cos(2 * pi() * b * c.k / 64)), 2) + pow(sum(v * h * sin(2 * pi() * b * c.k / 64)), 2) AS p FROM c JOIN tp ON tp.k = c.k, b GROUP BY ALL),
p AS (SELECT vec_id, label, b, min(var) AS var, list(p ORDER BY i) AS p FROM e GROUP BY ALL),
r(n, vec_id, label, b, var, p, lam, s) AS (SELECT 0, vec_id, label, b, var, p, lam, (p[1] + p[2]) / 2 FROM p, la
  UNION ALL SELECT n + 1, vec_id, label, b, var, p, lam, list_sum([pow(sqrt(l) * s / (l * s + (1 - l) * var + 1e-300), 2) * p[j] FOR l, j IN lam]) / list_sum([pow(sqrt(l) * s / (l * s + (1 - l) * var + 1e-300), 2) FOR l, j IN lam]) FROM r WHERE n < 50)
SELECT label, 1.0e0 * b AS freq, round(avg(s / 64 * CASE WHEN b IN (0, 32) THEN 1 ELSE 2 END), 6) AS psd FROM r WHERE n = 50 GROUP BY label, b""")
def multitaper_psd(spark, d):
    p = spectral.multitaper_psd(epoch_arrays(spark, d), ["vec_id", "label"], FS)
    return p.groupBy("label", "freq").agg(r6(F.avg("p")).alias("psd"))


def epoch_traces(spark, d) -> DataFrame:
    """(trace, w, events): every eight neighbouring epochs, one after the other, with an event in the middle of each."""
    e = epoch_arrays(spark, d).withColumn("trace", F.floor(F.col("vec_id") / 8).cast("long"))
    both = e.groupBy("trace").agg(F.sort_array(F.collect_list(F.struct("vec_id", "w"))).alias("s"))
    events = F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda i: i + F.lit(0.5))
    return both.select("trace", F.flatten(F.transform("s", lambda x: x["w"])).alias("w"), events.alias("events"))


T_SQL = X_SQL + """, r AS (SELECT vec_id, vec_id // 8 AS trace, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS r FROM embeddings),
y AS (SELECT trace, r.r * 64 + k AS k, v FROM x JOIN r ON x.vec_id = r.vec_id),
n AS (SELECT trace, count(*) AS n, count(*) // 64 AS events FROM y GROUP BY trace),
"""
SEG_SQL = """c AS (SELECT trace, a, g, j, v - avg(v) OVER (PARTITION BY trace, a, g) AS v, 0.5 - 0.5 * cos(pi() * least(1, least(j, 16 - j) / 2e0)) AS w FROM s),
b AS (SELECT unnest(range(9)) AS i),
p AS (SELECT trace, a, g, i, (pow(sum(v * w * cos(2 * pi() * i * j / 16)), 2) + pow(sum(v * w * sin(2 * pi() * i * j / 16)), 2)) / (64 * sum(w * w)) * CASE WHEN i IN (0, 8) THEN 1 ELSE 2 END AS p FROM c, b GROUP BY trace, a, g, i),
"""


@query(T_SQL + """g AS (SELECT trace, n, events, (n - 16) // 4 + 1 AS cols, unnest(range((n - 16) // 4 + 1)) AS g FROM n),
s AS (SELECT g.trace, 0 AS a, g, k - 4 * g AS j, v FROM g JOIN y ON y.trace = g.trace AND k >= 4 * g AND k < 4 * g + 16),
""" + SEG_SQL + """e AS (SELECT trace, cols, CAST(floor(cols / (n / 64e0)) AS BIGINT) // 2 AS half, CAST(floor((unnest(range(events)) + 0.5e0) * (cols / (n / 64e0))) AS BIGINT) AS mid FROM (SELECT DISTINCT trace, n, events, cols FROM g) h)
SELECT e.trace, 4.0e0 * i AS freq, CAST(g - (mid - half) AS INTEGER) AS k, round(avg(p), 6) AS p FROM e JOIN p ON p.trace = e.trace AND g >= mid - half AND g < mid + half WHERE mid >= half AND mid + half <= cols GROUP BY ALL""")
def stft_whole_then_windows(spark, d):
    """STFT of whole traces, a second of its columns around each event, averaged over events."""
    s = spectral.stft_at_events(epoch_traces(spark, d), ["trace"], FS, 16, 12, 1.0)
    return s.where("error IS NULL").select("trace", "freq", F.posexplode("power").alias("k", "p")).withColumn("p", r6("p"))


@query(T_SQL + """e AS (SELECT trace, n, 64 * unnest(range(events)) + 32 - 64 AS a FROM n), o AS (SELECT * FROM e WHERE a >= 0 AND a + 128 <= n),
g AS (SELECT unnest(range(29)) AS g), s AS (SELECT o.trace, a, g, k - a - 4 * g AS j, v FROM o JOIN g ON true JOIN y ON y.trace = o.trace AND k >= a + 4 * g AND k < a + 4 * g + 16),
""" + SEG_SQL + """x2 AS (SELECT 1)
SELECT trace, 4.0e0 * i AS freq, CAST(g - 7 AS INTEGER) AS k, round(avg(p), 6) AS p FROM p WHERE g >= 7 AND g < 21 GROUP BY ALL""")
def stft_windows_then_clip(spark, d):
    """Two seconds of the trace cut around each event, transformed, and the middle half of the columns kept."""
    s = spectral.stft_at_events(epoch_traces(spark, d), ["trace"], FS, 16, 12, 1.0, whole=False)
    return s.where("error IS NULL").select("trace", "freq", F.posexplode("power").alias("k", "p")).withColumn("p", r6("p"))


@query(X_SQL + f""", {F_SQL}, s AS (SELECT freq, (3 + (freq - 3) / 4) / (2 * pi() * freq) AS sigma FROM f),
l AS (SELECT CAST(floor(6 * max(sigma) * 64) AS BIGINT) AS l FROM s), m AS (SELECT CASE WHEN l % 2 = 0 THEN l + 1 ELSE l END AS l FROM l),
j AS (SELECT freq, sigma, l + 1 AS len, unnest(range(l + 1)) AS j FROM s, m),
u AS (SELECT freq, len, j, (j - len // 2) / 64e0 AS t, exp(-0.5 * pow((j - len // 2) / 64e0 / sigma, 2)) / sqrt(sqrt(pi())) AS a FROM j),
h AS (SELECT freq, j, a, lead(a) OVER (PARTITION BY freq ORDER BY j) AS b FROM u),
n AS (SELECT freq, sqrt(sum((a * a + b * b) / 2) / 64) AS norm FROM h GROUP BY freq),
q AS (SELECT u.freq, len, j, a * cos(2 * pi() * u.freq * t) / norm AS re, a * sin(2 * pi() * u.freq * t) / norm AS im FROM u JOIN n ON u.freq = n.freq),
o AS (SELECT unnest(range(64)) AS k),
z AS (SELECT vec_id, label, freq, o.k, pow(sum(v * re), 2) + pow(sum(v * im), 2) AS p FROM o JOIN x ON true JOIN q ON q.j = o.k + (q.len - 1) // 2 - x.k GROUP BY ALL)
SELECT label, freq, round(avg(p), 5) AS power FROM z GROUP BY ALL""")
def wavelet_bank_power(spark, d):
    s = spectral.vectorized_spectra(epoch_arrays(spark, d), ["vec_id", "label"], FREQS, FS, "manual")
    mean = F.aggregate("power", F.lit(0.0), lambda a, x: a + x) / F.size("power")
    return s.where("error IS NULL").groupBy("label", "freq").agg(F.round(F.avg(mean), 5).alias("power"))


TRACE_MORLET_SQL = T_SQL + """f AS (SELECT unnest([3.0e0, 4.0e0, 5.0e0, 6.0e0, 7.0e0]) AS freq),
ws AS (SELECT freq, (3 + (freq - 3) / 4) / (2 * pi() * freq) AS sigma FROM f),
wj AS (SELECT freq, sigma, unnest(range(-CAST(ceil(5 * sigma * 64) AS BIGINT) + 1, CAST(ceil(5 * sigma * 64) AS BIGINT))) AS j FROM ws),
wu AS (SELECT freq, j, (cos(2 * pi() * freq * j / 64) - exp(-2 * pow(pi() * freq * sigma, 2))) * exp(-pow(j / 64e0, 2) / (2 * sigma * sigma)) AS re,
       sin(2 * pi() * freq * j / 64) * exp(-pow(j / 64e0, 2) / (2 * sigma * sigma)) AS im FROM wj),
wn AS (SELECT freq, sqrt(sum(re * re + im * im) / 2) AS norm FROM wu GROUP BY freq),
wq AS (SELECT wu.freq, j, re / norm AS re, im / norm AS im FROM wu JOIN wn USING (freq)),
tm AS (SELECT y.trace, q.freq, y.k + q.j AS k, pow(sum(v * re), 2) + pow(sum(v * im), 2) AS p FROM y JOIN n ON y.trace = n.trace JOIN wq q ON y.k + q.j >= 0 AND y.k + q.j < n.n GROUP BY ALL),
tg AS (SELECT trace, freq, avg(p) AS mu, greatest(stddev_pop(p), 1e-12) AS sd FROM tm GROUP BY ALL),
"""

TRACE_CONFIG = AnalysisConfig(fs=FS, freqs=(3.0, 4.0, 5.0, 6.0, 7.0), window=0.5, normalization="channel_global")


def trace_recordings(spark, d) -> tuple[DataFrame, DataFrame]:
    """(signals, events) of epoch_traces: single-channel recordings of up to eight seconds, an event in the middle of each."""
    t = epoch_traces(spark, d).withColumn("session", F.col("trace").cast("string"))
    subject = F.lit("t").alias("subject")
    signals = t.select(subject, "session", F.array(F.lit("all")).alias("regions"), F.lit(0).alias("channel_idx"), F.lit(FS).alias("fs"), F.lit(0.0).alias("t0"), F.col("w").alias("samples"))
    return signals, t.select(subject, "session", F.posexplode("events").alias("event_idx", "t"), F.lit("nm").alias("kind"), F.lit(1.0).alias("size"))


@query(TRACE_MORLET_SQL + """e AS (SELECT trace, unnest(range(events)) AS e FROM n)
SELECT e.trace, CAST(e AS INTEGER) AS event_idx, tm.freq, CAST(tm.k - 64 * e - 16 AS INTEGER) AS k, round((p - mu) / sd, 5) AS z FROM e JOIN tm ON tm.trace = e.trace AND tm.k >= 64 * e + 16 AND tm.k < 64 * e + 48 JOIN tg ON tg.trace = tm.trace AND tg.freq = tm.freq""")
def block_morlet_windows(spark, d):
    """Event windows of power, z over the whole recording, from blocks of 100 samples with halos."""
    out = blocks.event_spectra(*trace_recordings(spark, d), TRACE_CONFIG, size=100).where("error IS NULL")
    return out.select(F.col("session").cast("long").alias("trace"), "event_idx", "freq", F.posexplode("w").alias("k", "z")).withColumn("z", F.round("z", 5))


@query(TRACE_MORLET_SQL + """z AS (SELECT 1) SELECT trace, freq, round(mu, 6) AS mu, round(sd, 6) AS sd FROM tg""")
def block_morlet_moments(spark, d):
    """Mean and spread of power over whole recordings, merged over blocks of 77 samples."""
    out = blocks.spectral_moments(trace_recordings(spark, d)[0], TRACE_CONFIG, size=77)
    stats = F.explode(F.arrays_zip(F.array(*map(F.lit, TRACE_CONFIG.grid())).alias("freq"), "mu", "sd")).alias("x")
    return out.select(F.col("session").cast("long").alias("trace"), stats).select("trace", "x.freq", r6("x.mu").alias("mu"), r6("x.sd").alias("sd"))


DIAGNOSTIC_SQL = TRACE_MORLET_SQL + """e AS (SELECT trace, unnest(range(events)) AS e FROM n),
dc AS (SELECT e.trace, e, e % 3 + 1 AS size, tm.freq, p AS raw, (p - mu) / sd AS z, mu, sd FROM e JOIN tm ON tm.trace = e.trace AND tm.k >= 64 * e + 16 AND tm.k < 64 * e + 48 JOIN tg ON tg.trace = tm.trace AND tg.freq = tm.freq)
"""


def diagnostic_cells(spark, d) -> DataFrame:
    signals, events = trace_recordings(spark, d)
    events = events.withColumn("size", (F.col("event_idx") % 3 + 1).cast("double"))
    return pipeline.diagnostic_cells(signals, events, TRACE_CONFIG, block=150).withColumn("trace", F.col("session").cast("long"))


@query(DIAGNOSTIC_SQL + """SELECT trace, freq, round(min(mu), 6) AS mu, round(min(sd), 6) AS sd, round(min(mu) / min(sd), 6) AS ratio, round(avg(raw), 6) AS raw_mean, round(stddev_pop(raw), 6) AS raw_std, round(avg(z), 6) AS z_mean, round(stddev_pop(z), 6) AS z_std FROM dc GROUP BY trace, freq""")
def diagnostics_by_frequency(spark, d):
    """Per recording and frequency: its own mean and spread of power beside those of the event windows, raw and z."""
    out = pipeline.diagnostics_by_frequency(diagnostic_cells(spark, d), ["trace"]).drop("f_idx")
    return out.select("trace", "freq", *[r6(c).alias(c) for c in out.columns[2:]])


@query(DIAGNOSTIC_SQL + """, l AS (SELECT trace, size, e, 'raw' AS measure, raw AS v FROM dc UNION ALL SELECT trace, size, e, 'z', z FROM dc)
SELECT trace, CAST(size AS DOUBLE) AS size, measure, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
round(quantile_cont(v, 0.75), 6) AS p75, count(DISTINCT e) AS n_events FROM l GROUP BY trace, size, measure""")
def diagnostics_by_size(spark, d):
    """Per recording and size of event: range, mean, spread and quartiles of the windows' samples, raw and z."""
    out = pipeline.diagnostics_by_size(diagnostic_cells(spark, d), ["trace"])
    return out.select("trace", "size", "measure", *[r6(c).alias(c) for c in ("min", "max", "mean", "std", "p25", "p50", "p75")], "n_events")


CWT_FREQS = [4.0, 8.0, 16.0, 20.0]


@query(X_SQL + """, f AS (SELECT unnest([4.0e0, 8.0e0, 16.0e0, 20.0e0]) AS freq), s AS (SELECT freq, 64 / freq AS a, least(10 * 64 / freq, 64) AS n FROM f),
j AS (SELECT freq, a, n, unnest(range(CAST(ceil(n) AS BIGINT))) AS j FROM s),
y AS (SELECT freq, a, CAST(ceil(n) AS BIGINT) AS len, j, j - (n - 1) / 2 AS t FROM j),
q AS (SELECT freq, len, len - 1 - j AS i, cos(5 * t / a) * exp(-0.5 * pow(t / a, 2)) / sqrt(sqrt(pi()) * a) AS re, -sin(5 * t / a) * exp(-0.5 * pow(t / a, 2)) / sqrt(sqrt(pi()) * a) AS im FROM y),
o AS (SELECT unnest(range(64)) AS k),
m AS (SELECT vec_id, label, freq, o.k, pow(sum(v * re), 2) + pow(sum(v * im), 2) AS p FROM o JOIN x ON true JOIN q ON q.i = o.k + (q.len - 1) // 2 - x.k GROUP BY ALL)
SELECT label, freq, round(avg(p), 6) AS power FROM m GROUP BY ALL""")
def cwt_morlet2_power(spark, d):
    s = spectral.cwt_spectra(epoch_arrays(spark, d), ["vec_id", "label"], CWT_FREQS, FS)
    mean = F.aggregate("power", F.lit(0.0), lambda a, x: a + x) / F.size("power")
    return s.where("error IS NULL").groupBy("label", "freq").agg(r6(F.avg(mean)).alias("power"))


@query(MORLET_SQL + """, b AS (SELECT vec_id, label, k, avg(p) AS p FROM m WHERE freq BETWEEN 4 AND 6 GROUP BY ALL)
SELECT label, CAST(k AS INTEGER) AS k, round(avg(p), 6) AS power FROM b GROUP BY ALL""")
def morlet_band_mean(spark, d):
    s = spectral.morlet_spectra(epoch_arrays(spark, d), ["vec_id", "label"], FREQS, FS)
    return spectral.band_mean(s, ["vec_id", "label"], 4.0, 6.0).groupBy("label", "k").agg(r6(F.avg("p")).alias("power"))


@query(WELCH_SQL + "SELECT label, freq, round(log10(p + 1e-12), 6) AS log_psd, round(p * freq, 6) AS flat_psd FROM psd WHERE freq BETWEEN 1 AND 30")
def psd_views(spark, d):
    """Power density as shown: logarithmic and flattened by its frequency."""
    p = mean_psd(spark, d).where(F.col("freq").between(1, 30))
    return p.select("label", "freq", r6(spectral.log_power(F.col("p"))).alias("log_psd"), r6(F.col("p") * F.col("freq")).alias("flat_psd"))


@query("""WITH x AS (SELECT vec_id, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) / 64.0e0 AS duration FROM x WHERE k / 64.0e0 BETWEEN 0.25 AND 0.75 GROUP BY vec_id""")
def time_slice_stats(spark, d):
    """Descriptive statistics of the closed time range [0.25, 0.75] s of each trace."""
    w = epoch_arrays(spark, d).select("vec_id", F.explode(time_slice(F.col("w"), FS, 0.25, 0.75, required=True)).alias("v"))
    out = A.channel_statistics(w, ["vec_id"], FS).drop("n")
    return out.select("vec_id", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")], "duration")


@query(X_SQL + f""", g AS (SELECT vec_id, avg(v) AS gm, stddev_pop(v) + 1e-12 AS gs, avg(v) FILTER ({K_SQL['base']}) AS bm, stddev_pop(v) FILTER ({K_SQL['base']}) + 1e-12 AS bs FROM x GROUP BY vec_id)
SELECT label, CAST(k AS INTEGER) AS k, round(avg((v - gm) / gs), 6) AS z_global, round(avg((v - bm) / bs), 6) AS z_baseline FROM x JOIN g USING (vec_id) GROUP BY ALL""")
def norm_trial(spark, d):
    """Single trials against all of their samples and against their baseline."""
    w = epoch_arrays(spark, d)
    a = _by_sample(normalize.trial(w)).withColumnRenamed("z", "z_global")
    return a.join(_by_sample(normalize.trial(w, _B)).withColumnRenamed("z", "z_baseline"), ["label", "k"])


@query("""WITH s AS (SELECT p_brand || '/' || p_type AS subject, p_partkey % 5 AS session, arg_min(p_size % 3, p_partkey) AS e FROM part GROUP BY ALL)
SELECT subject, CAST(min(e) AS VARCHAR) AS map FROM s GROUP BY subject HAVING count(DISTINCT e) = 1""")
def consistent_montages(spark, d):
    """Subjects (brand and type of parts) all of whose sessions agree on one map."""
    p = table(spark, d, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("subject"), (F.col("p_partkey") % 5).alias("session"))
    maps = p.agg(F.min_by(F.col("p_size") % 3, "p_partkey").alias("e")).select("subject", F.array("e").alias("map"))
    return montage.consistent_montage(maps, 1).withColumn("map", F.array_join("map", ","))


@query("SELECT CAST(row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) AS INTEGER) AS task, CAST(c_custkey AS VARCHAR) AS subject FROM customer")
def subject_tasks(spark, d):
    """1-based task numbers of subjects in id order."""
    return sinks.subject_index(catalog.subjects(table(spark, d, "customer").select(F.col("c_custkey").alias("subject"))))


# -- hierarchy -----------------------------------------------------------------

L_SQL = "WITH l AS (SELECT o_custkey AS subject, o_orderkey AS session, l_extendedprice AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)\n"


def order_events(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("subject"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_extendedprice").alias("v")).join(o, "session")


# Prices have two decimals: means of decimals are exact to the last digit, whatever the order of the sum.
C_SQL = "WITH l AS (SELECT o_custkey AS subject, o_orderkey AS session, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey)\n"


def exact_events(spark, d) -> DataFrame:
    return order_events(spark, d).withColumn("v", F.col("v").cast("decimal(18,2)"))


@query(C_SQL + "SELECT subject, CAST((2 * sum(c) * 10000 + count(c)) // (2 * count(c)) AS DOUBLE) / 1e6 AS mean, count(c) AS n_events, count(DISTINCT session) AS n_sessions FROM l GROUP BY subject")
def session_avg_event_weighted(spark, d):
    return A.event_weighted(exact_events(spark, d), ["subject"], "v", "session").withColumn("mean", F.col("mean").cast("double"))


@query(C_SQL + ", s AS (SELECT subject, session, (2 * sum(c) * 10000 + count(c)) // (2 * count(c)) AS m, count(c) AS n FROM l GROUP BY ALL)\nSELECT subject, CAST((2 * sum(m) * 10000 + count(m)) // (2 * count(m)) AS DOUBLE) / 1e10 AS mean, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_sessions FROM s GROUP BY subject")
def session_avg_session_weighted(spark, d):
    return A.session_weighted(exact_events(spark, d), ["subject"], "v", "session").withColumn("mean", F.col("mean").cast("double"))


def subject_means(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_acctbal").alias("balance"))
    return A.event_weighted(order_events(spark, d), ["subject"], "v", "session").join(c, "subject")


@query(L_SQL + """, s AS (SELECT DISTINCT n_name AS population, subject FROM l JOIN customer ON c_custkey = subject JOIN nation ON c_nationkey = n_nationkey), n AS (SELECT population, count(*) AS n FROM s GROUP BY population)
SELECT s.population, subject, round(1.0e0 / n, 9) AS weight, 'equal' AS method FROM s JOIN n ON s.population = n.population""")
def equal_subject_weights(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("population"))
    return A.equal_weights(subject_means(spark, d).join(n, "n_nationkey"), ["population"], "subject").withColumn("weight", F.round("weight", 9))


@query(L_SQL + """, s AS (SELECT subject, avg(v) AS m, count(v) AS ne, count(DISTINCT session) AS ns FROM l GROUP BY subject)
SELECT n_name AS population, round(avg(m), 6) AS mean, count(*) AS n_subjects, CAST(sum(ne) AS BIGINT) AS n_events, CAST(sum(ns) AS BIGINT) AS n_sessions
FROM s JOIN customer ON c_custkey = subject JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def population_unweighted_mean(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("population"))
    return A.population_mean(subject_means(spark, d).join(n, "n_nationkey"), ["population"]).withColumn("mean", r6("mean"))


@query(L_SQL + """, s AS (SELECT subject, avg(v) AS m FROM l GROUP BY subject), c AS (SELECT subject, m, c_nationkey AS nation, c_acctbal AS b FROM s JOIN customer ON c_custkey = subject),
t AS (SELECT nation, sum(b) FILTER (b > 0) AS total FROM c GROUP BY nation)
SELECT c.nation AS n_nationkey, round(sum(CASE WHEN b > 0 THEN b / total ELSE 0 END * m), 4) AS mean, round(sum(CASE WHEN b > 0 THEN b / total ELSE 0 END), 6) AS weight FROM c JOIN t ON c.nation = t.nation GROUP BY c.nation""")
def population_weighted_mean(spark, d):
    """Subjects weigh as their positive balance; the others have no weight row, so 0."""
    s = subject_means(spark, d)
    rich = s.where("balance > 0")
    total = rich.groupBy("n_nationkey").agg(F.sum("balance").alias("total"))
    weights = rich.join(total, "n_nationkey").select("subject", (F.col("balance") / F.col("total")).alias("weight"))
    return A.weighted_mean(s, weights, ["subject"], ["n_nationkey"]).select("n_nationkey", F.round("mean", 4).alias("mean"), r6("weight").alias("weight"))


@query("""WITH s AS (SELECT o_custkey AS subject, o_orderkey AS session, count(*) AS shape FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
c AS (SELECT subject, shape, row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, shape) AS k FROM s GROUP BY subject, shape)
SELECT s.subject, s.session, s.shape FROM s JOIN c ON s.subject = c.subject AND s.shape = c.shape AND k = 1""")
def modal_shape_filter(spark, d):
    shapes = order_events(spark, d).groupBy("subject", "session").agg(F.count(F.lit(1)).alias("shape"))
    return A.modal_shape(shapes, ["subject"], "shape").select("subject", "session", "shape")


@query("SELECT user_id AS subject, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, count(value) AS n, count(value) / 200.0e0 AS duration FROM events GROUP BY user_id")
def channel_stats(spark, d):
    out = A.channel_statistics(recording(spark, d)[0], ["subject"], 200.0)
    return out.withColumn("mean", r6("mean")).withColumn("std", r6("std"))


def day_sessions(spark, d) -> DataFrame:
    ev = table(spark, d, "events").withColumn("session", F.to_date("ts").cast("string"))
    return ev.groupBy(F.col("user_id").alias("subject"), "session").agg(F.count(F.lit(1)).alias("length"), F.count_if(F.col("event_type") == "error").alias("n_events"), F.count_if(F.col("event_type") == "signup").alias("n_control"))


DAY_SQL = "WITH s AS (SELECT user_id AS subject, CAST(CAST(ts AS DATE) AS VARCHAR) AS session, count(*) AS length, count(*) FILTER (event_type = 'error') AS n_events, count(*) FILTER (event_type = 'signup') AS n_control FROM events GROUP BY ALL)\n"


@query(DAY_SQL + "SELECT subject, round(avg(length), 6) AS mean_length, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(n_control) AS BIGINT) AS n_control, count(*) AS n_sessions FROM s GROUP BY subject")
def session_catalog_summary(spark, d):
    return catalog.session_summary(day_sessions(spark, d)).withColumn("mean_length", r6("mean_length"))


@query(DAY_SQL + """, l AS (SELECT subject, 'length' AS value, length AS v FROM s UNION ALL SELECT subject, 'n_events', n_events FROM s UNION ALL SELECT subject, 'n_control', n_control FROM s)
SELECT CASE WHEN grouping(subject) = 1 THEN 'all' ELSE CAST(subject AS VARCHAR) END AS subject, value, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, CAST(min(v) AS DOUBLE) AS min, quantile_cont(CAST(v AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(v AS DOUBLE), 0.5) AS p50,
quantile_cont(CAST(v AS DOUBLE), 0.75) AS p75, CAST(max(v) AS DOUBLE) AS max FROM l GROUP BY GROUPING SETS ((subject, value), (value))""")
def session_description(spark, d):
    """Lengths and counts of sessions described per subject and over all."""
    out = catalog.describe_sessions(day_sessions(spark, d), ["length", "n_events", "n_control"])
    subject = F.when(F.col("all"), "all").otherwise(F.col("subject").cast("string"))
    return out.withColumn("mean", r6("mean")).withColumn("std", r6("std")).withColumn("subject", subject).drop("all")


@query(DAY_SQL + """, a AS (SELECT 'longest' AS which, subject, session, length FROM s ORDER BY length DESC, subject, session LIMIT 1), b AS (SELECT 'shortest' AS which, subject, session, length FROM s ORDER BY length, subject, session LIMIT 1)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def longest_shortest_session(spark, d):
    return catalog.extreme_sessions(day_sessions(spark, d), ["subject", "session"])


# -- grids and montages --------------------------------------------------------


#: Frequencies of the grid queries, with epochs read as 200 samples a second.
GRID, GRID_FS = (1.0, 45.0, 40), 200.0
G_SQL = X_SQL + """, g AS (SELECT CAST(i AS INTEGER) AS f_idx, CASE i WHEN 0 THEN 1.0e0 WHEN 39 THEN 45.0e0 ELSE pow(45.0e0, i / 39.0e0) END AS freq FROM range(40) t(i)),
gp AS (SELECT vec_id, label, f_idx, freq, pow(sum(v * cos(2 * pi() * freq * k / 200)), 2) + pow(sum(v * sin(2 * pi() * freq * k / 200)), 2) AS p FROM x, g GROUP BY ALL),
lp AS (SELECT label, f_idx, freq, avg(p) AS p FROM gp GROUP BY ALL)
"""


def grid_power(spark, d) -> DataFrame:
    """(label, f_idx, freq, p): mean Fourier power of the epochs of a label at each frequency of the grid."""
    each = epoch_arrays(spark, d).select("label", "w", F.posexplode(grid_array(*GRID)).alias("f_idx", "freq"))
    return each.groupBy("label", "f_idx", "freq").agg(F.avg(spectral.fourier_power_at(F.col("w"), F.col("freq"), GRID_FS)).alias("p"))


@query(G_SQL + "SELECT label, f_idx, round(freq, 6) AS freq, round(p, 6) AS power FROM lp")
def freq_grid_geomspace(spark, d):
    return grid_power(spark, d).select("label", "f_idx", r6("freq").alias("freq"), r6("p").alias("power"))


@query(G_SQL + """, c AS (SELECT freq FROM g WHERE freq BETWEEN 3 AND 7 UNION ALL SELECT max(freq) FROM g WHERE freq < 3 UNION ALL SELECT min(freq) FROM g WHERE freq > 7)
SELECT label, round(freq, 6) AS freq, round(p, 6) AS power FROM lp JOIN c USING (freq)""")
def freq_select_extended(spark, d):
    """Power at the grid's frequencies in the band and the nearest one on each side of it."""
    chosen = select_frequencies(geometric_grid(spark, *GRID), 3.0, 7.0, extended=True)
    return grid_power(spark, d).join(F.broadcast(chosen), "freq").select("label", r6("freq").alias("freq"), r6("p").alias("power"))


_POLICIES = {"fixed": "5.0e0", "adaptive": "freq", "hybrid": "greatest(6.0e0, freq)", "custom": "CASE WHEN freq BETWEEN 3 AND 7 THEN 3 + (freq - 3) / 4 ELSE 3.0e0 END"}


@query(G_SQL + """, y AS (SELECT method, f_idx, freq, cycles, k, 2 * pi() * freq * (k - 32) / 200 AS a, exp(-0.5 * pow(2 * pi() * freq * (k - 32) / 200 / cycles, 2)) AS u FROM (
"""
       + " UNION ALL ".join(f"SELECT '{m}' AS method, f_idx, freq, {c} AS cycles FROM g" for m, c in _POLICIES.items())
       + """) c, (SELECT unnest(range(64)) AS k) k),
e AS (SELECT vec_id, label, method, f_idx, freq, cycles, (pow(sum(v * u * cos(a)), 2) + pow(sum(v * u * sin(a)), 2)) / pow(sum(u), 2) AS p FROM x JOIN y USING (k) GROUP BY ALL)
SELECT label, method, f_idx, round(freq, 6) AS freq, round(cycles, 6) AS cycles, round(avg(p), 6) AS power FROM e GROUP BY label, method, f_idx, freq, cycles""")
def n_cycles_policy(spark, d):
    """Power at the event by wavelets of each policy's cycles, at each frequency of the grid."""
    f = F.col("freq")
    freqs = [r["freq"] for r in geometric_grid(spark, *GRID).orderBy("f_idx").collect()]
    s = spectral.centre_spectra(epoch_arrays(spark, d), ["vec_id", "label"], freqs, GRID_FS, list(_POLICIES)).where("error IS NULL")
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.get("power", F.lit(i)).alias("p")) for i, m in enumerate(_POLICIES)]))
    out = s.select("label", "f_idx", "freq", each).groupBy("label", "method", "f_idx", "freq").agg(F.avg("p").alias("p"))
    used = F.coalesce(*[F.when(F.col("method") == m, n_cycles(f, m)) for m in _POLICIES])
    return out.select("label", "method", "f_idx", r6("freq").alias("freq"), r6(used).alias("cycles"), r6("p").alias("power"))


MONTAGE_SQL = "WITH m AS (SELECT r_name AS subject, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS INTEGER) AS channel_idx, CAST(n_nationkey + 1 AS INTEGER) AS electrode FROM nation JOIN region ON n_regionkey = r_regionkey),\nroi AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {e})" for r, es in REGIONS.items() for e in es) + ") t(region, electrode))\n"


def nation_montage(spark, d) -> DataFrame:
    """Regions as subjects, their nations by name as channels, nation keys as electrodes; made wide and long again."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.row_number().over(Window.partitionBy("r_name").orderBy("n_name")) - 1
    long = n.select(F.col("r_name").alias("subject"), k.alias("channel_idx"), (F.col("n_nationkey") + 1).cast("int").alias("electrode"))
    return montage.unpivot_montage(montage.pivot_montage(long, 32), "subject")


def regions(spark) -> DataFrame:
    return spark.createDataFrame([(r, e) for r, es in REGIONS.items() for e in es], "region string, electrode int")


@query(MONTAGE_SQL + "SELECT subject, channel_idx, electrode FROM m WHERE electrode IN (6, 8, 9, 11)")
def montage_unpivot_lookup(spark, d):
    return montage.channels_of(nation_montage(spark, d), regions(spark).where("region = 'mPFC'").select("electrode")).select("subject", "channel_idx", "electrode")


@query(MONTAGE_SQL + "SELECT s.subject, region, count(*) FILTER (m.electrode IS NULL) AS n_missing, count(*) FILTER (m.electrode IS NULL) = 0 AS compatible FROM (SELECT DISTINCT subject FROM m) s, roi LEFT JOIN m ON m.subject = s.subject AND m.electrode = roi.electrode GROUP BY ALL")
def roi_compatibility_antijoin(spark, d):
    return montage.compatibility(nation_montage(spark, d), regions(spark)).withColumn("n_missing", F.col("n_missing").cast("long"))


@query(MONTAGE_SQL + "SELECT subject, region, string_agg(CAST(channel_idx AS VARCHAR), ',' ORDER BY channel_idx) AS channels FROM m JOIN roi USING (electrode) GROUP BY ALL")
def roi_catalog(spark, d):
    return montage.region_catalog(nation_montage(spark, d), regions(spark)).withColumn("channels", F.array_join("channels", ","))


# -- processing state ----------------------------------------------------------


@query("""SELECT n_name AS population, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS n_failed, round(100.0e0 * count(*) FILTER (o_orderstatus <> 'P') / count(*), 6) AS success_rate
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def failed_group_report(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") != "P").alias("ok"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("population"))
    return catalog.failure_report(o.join(c, "c_custkey").join(n, "n_nationkey"), ["population"]).withColumn("success_rate", r6("success_rate"))


@query("""WITH e AS (SELECT o_custkey AS subject, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT o_custkey AS subject, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT e.subject, e.n AS n_expected, coalesce(p.n, 0) AS n_present, CASE WHEN coalesce(p.n, 0) >= e.n THEN 'completed' WHEN p.n > 0 THEN 'partial' ELSE 'failed' END AS state FROM e LEFT JOIN p USING (subject)""")
def resume_missing_partitions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("session"), "o_orderstatus")
    return catalog.progress(o, o.where("o_orderstatus = 'F'"), "subject", "session")


# -- composites ----------------------------------------------------------------

COMPOSITE = AnalysisConfig(fs=FS, freqs=(3.0, 4.0, 5.0, 6.0, 7.0), window=0.5, baseline=(-0.25, -0.125), response=(-0.1, 0.1), theta=(4.0, 6.0), normalization="baseline_per_event")

COMPOSITE_SQL = MORLET_SQL + """, gz AS (SELECT vec_id, freq, avg(p) AS mu, greatest(stddev_pop(p), 1e-12) AS sd FROM m GROUP BY ALL),
c AS (SELECT m.vec_id // 2 AS session, m.freq, k, avg((p - mu) / sd) AS z FROM m JOIN gz g ON m.vec_id = g.vec_id AND m.freq = g.freq GROUP BY ALL),
w AS (SELECT session, freq, e, k - k0 AS k, z FROM c JOIN (VALUES (0, 10), (1, 23)) t(e, k0) ON k >= k0 AND k < k0 + 32),
b AS (SELECT session, freq, e, avg(z) AS mu, greatest(stddev_pop(z), 1e-12) AS sd FROM w WHERE k < 8 GROUP BY ALL),
nz AS (SELECT w.session % 5 AS subject, w.session % 3 + 1 AS size, w.session, w.freq, k, (z - mu) / sd AS z FROM w JOIN b ON w.session = b.session AND w.freq = b.freq AND w.e = b.e),
sz AS (SELECT subject, size, freq, k, avg(z) AS z, count(*) AS n_events, count(DISTINCT session) AS n_sessions FROM nz GROUP BY subject, size, freq, k)
"""


def pair_recordings(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Neighbouring epochs as the two channels of a session of one second with two events; signals, events, montage, regions."""
    e = epoch_arrays(spark, d).withColumn("n", F.floor(F.col("vec_id") / 2).cast("long"))
    subject, session = (F.col("n") % 5).cast("string").alias("subject"), F.col("n").cast("string").alias("session")
    signals = e.select(subject, session, (F.col("vec_id") % 2).cast("int").alias("channel_idx"), F.lit(FS).alias("fs"), F.lit(0.0).alias("t0"), F.col("w").alias("samples"))
    at = F.posexplode(F.array(F.lit(0.4), F.lit(0.6))).alias("event_idx", "t")
    events = e.select("n").distinct().select(subject, session, at, F.lit("nm").alias("kind"), (F.col("n") % 3 + 1).cast("double").alias("size"))
    rows = [(str(i), c, el) for i in range(5) for c, el in enumerate((8, 6))]
    return signals, events, spark.createDataFrame(rows, "subject string, channel_idx int, electrode int"), pipeline.region_table(spark, {"front": [8, 6]})


@query(COMPOSITE_SQL + "SELECT CAST(subject AS VARCHAR) AS subject, CAST(size AS DOUBLE) AS size, freq, CAST(k AS INTEGER) AS k, round(z, 4) AS z, n_events, n_sessions FROM sz")
def analyze_subject_windows(spark, d):
    """Composite: recordings to the mean event-locked spectrum of each subject and size, by the trace's z and each event's baseline."""
    return pipeline.analyze_subject(*pair_recordings(spark, d), COMPOSITE).select("subject", "size", "freq", "k", F.round("z", 4).alias("z"), "n_events", "n_sessions")


@query(COMPOSITE_SQL + "SELECT CAST(subject AS VARCHAR) AS subject, CAST(size AS DOUBLE) AS size, freq, CAST(k AS INTEGER) AS k, round(z, 4) AS z, n_events, n_sessions FROM sz")
def subjects_from_states(spark, d):
    """The same spectra from stored states of sessions: one run works out every third session, the next what is left."""
    signals, events, montages, wanted = pair_recordings(spark, d)
    folder, analysis = sinks.shared_folder(spark, "states"), resume.analysis_id(COMPOSITE, {"front": [8, 6]})
    resume.run_pending(signals.where(F.col("session").cast("long") % 3 == 0), events, montages, wanted, COMPOSITE, folder, analysis)
    out = resume.update_subjects(signals, events, montages, wanted, COMPOSITE, folder, analysis)
    return out.select("subject", "size", "freq", "k", F.round("z", 4).alias("z"), "n_events", "n_sessions")


@query(COMPOSITE_SQL + "SELECT CAST(size AS DOUBLE) AS size, freq, CAST(k AS INTEGER) AS k, round(avg(z), 4) AS z, count(*) AS n_subjects, CAST(sum(n_events) AS BIGINT) AS n_events FROM sz GROUP BY ALL")
def analyze_population_windows(spark, d):
    out = pipeline.analyze_population(pipeline.analyze_subject(*pair_recordings(spark, d), COMPOSITE))
    return out.select("size", "freq", "k", F.round("z", 4).alias("z"), "n_subjects", "n_events")


@query(COMPOSITE_SQL + """, t AS (SELECT subject, size, avg(z) AS power FROM sz WHERE freq BETWEEN 4 AND 6 AND k BETWEEN 10 AND 21 GROUP BY ALL)
SELECT CAST(size AS DOUBLE) AS size, round(avg(power), 4) AS mean, round(stddev_samp(power) / sqrt(count(power)), 4) AS se, count(power) AS n FROM t GROUP BY size""")
def theta_report_by_size(spark, d):
    """Composite: band power around the events, its mean and standard error over subjects, by size."""
    out = pipeline.theta_report(pipeline.analyze_subject(*pair_recordings(spark, d), COMPOSITE), COMPOSITE)
    return out.select("size", F.round("mean", 4).alias("mean"), F.round("se", 4).alias("se"), "n")
