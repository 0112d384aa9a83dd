"""Quality scores, calibration, flicker, statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import num, rgb, round_to
from ..functions.spaces import luma_2020, pu21_encode
from ..functions.transfer import pq_eotf_nits
from ..operators import describe, exposure, flicker as flick, frames as fr, metrics, reduce
from ..sources import tables
from . import query
from . import sqltext as q

KEYS = ["video", "frame", "variant"]
_P, _T = ["pr", "pg", "pb"], ["tr", "tg", "tb"]


def _db(mse):
    return f"1e1*log10({q.d(q.PEAK**2)}/greatest({mse},1e-12))"


_SQ = "(" + "+".join(f"pow({q.pu21('p' + c)}-{q.pu21('t' + c)},2)" for c in "rgb") + ")/3e0"
_SQY = f"pow({q.pu21(q.dot(q.Y2020, _P))}-{q.pu21(q.dot(q.Y2020, _T))},2)"


def _itp(side):
    return [q.nits_code(x) for x in q.mat(q.MLMS, [f"greatest({side}{c},0e0)" for c in "rgb"])]


def _ictcp(source="lit", name="itp", extra=""):
    lms = q.alias(_itp("p"), "lp", "123") + ", " + q.alias(_itp("t"), "lt", "123")
    return [
        f"{name}0 AS (SELECT *, {lms} FROM {source})",
        f"{name} AS (SELECT *, "
        + q.alias(q.mat(q.MITP, ["lp1", "lp2", "lp3"]), "ip", "123")
        + ", "
        + q.alias(q.mat(q.MITP, ["lt1", "lt2", "lt3"]), "it", "123")
        + f" FROM {name}0)",
    ]


_DE = "720e0*sqrt(pow(ip1-it1,2)+pow(5e-1*(ip2-it2),2)+pow(ip3-it3,2)+1e-20)"
_SCORE = f"{_db(f'avg({_SQ})')} AS psnr, {_db(f'avg({_SQY})')} AS psnr_y, avg({_DE}) AS deitp"


def _pixels(spark, folder):
    return tables.coded(tables.px(spark, folder))


def _rounded(df, keys, names, digits=6):
    return df.select(*keys, *(round_to(F.col(n), digits).alias(n) for n in names))


@query(
    "pu21_psnr",
    q.rows(q.PX, q.CODED, q.LIT, select=f"SELECT video, frame, variant, round({_db(f'avg({_SQ})')},6) AS psnr FROM lit GROUP BY ALL"),
)
def pu21_psnr(spark, folder):
    return _rounded(metrics.pixel_scores(_pixels(spark, folder), KEYS, ["psnr"]), KEYS, ["psnr"])


@query(
    "pu21_psnr_y",
    q.rows(q.PX, q.CODED, q.LIT, select=f"SELECT video, frame, variant, round({_db(f'avg({_SQY})')},6) AS psnr_y FROM lit GROUP BY ALL"),
)
def pu21_psnr_y(spark, folder):
    scores = metrics.pixel_scores(_pixels(spark, folder), KEYS, ["psnr_y"])
    return _rounded(scores, KEYS, ["psnr_y"])


@query(
    "delta_e_itp",
    q.rows(
        q.PX, q.CODED, q.LIT, *_ictcp(),
        select=f"SELECT video, frame, variant, round(avg({_DE}),6) AS deitp, round(max({_DE}),6) AS worst"
        " FROM itp GROUP BY ALL",
    ),
)
def delta_e_itp(spark, folder):
    each = metrics.colour_difference(_pixels(spark, folder))
    scores = each.groupBy(*KEYS).agg(F.avg("deitp").alias("deitp"), F.max("deitp").alias("worst"))
    return _rounded(scores, KEYS, ["deitp", "worst"])


_RATIO = "ratio AS (SELECT *, " + f"{q.dot(q.Y2020, _T)}/{q.dot(q.Y2020, _P)} AS ratio FROM lit WHERE track='expert')"
_GAIN = (
    "gain AS (SELECT video, variant, least(greatest(quantile_disc(ratio,0.5),2.5e-1),8e0) AS exposure_gain"
    " FROM ratio GROUP BY ALL)"
)


@query(
    "exposure_gain",
    q.rows(
        q.PX, q.CODED, q.LIT, _RATIO, _GAIN,
        select="SELECT video, variant, round(exposure_gain,8) AS exposure_gain FROM gain",
    ),
)
def exposure_gain(spark, folder):
    expert = _pixels(spark, folder).where("track = 'expert'")
    gains = exposure.fit_gains(expert, ["video", "variant"])
    return _rounded(gains, ["video", "variant"], ["exposure_gain"], 8)


_CAL = (
    "cal AS (SELECT l.video, frame, l.variant, exposure_gain, tr, tg, tb, "
    + ", ".join(
        f"CASE WHEN exposure_gain=1 THEN p{c} ELSE {q.code_nits(q.nits_code(f'(p{c}*exposure_gain)'))} END AS p{c}"
        for c in "rgb"
    )
    + " FROM lit l JOIN gain USING (video, variant) WHERE track='expert')"
)
_CALS = ["psnr", "psnr_y", "deitp"]


@query(
    "exposure_scores",
    q.rows(
        q.PX, q.CODED, q.LIT, _RATIO, _GAIN, _CAL, *_ictcp("cal"),
        f"s AS (SELECT video, frame, variant, any_value(exposure_gain) AS exposure_gain, {_SCORE} FROM itp GROUP BY ALL)",
        select="SELECT video, frame, variant, round(exposure_gain,8) AS exposure_gain, "
        + ", ".join(f"round({n},5) AS exposure_calibrated_{n}" for n in _CALS)
        + " FROM s",
    ),
)
def exposure_scores(spark, folder):
    """Expert pixels scored again after the gain of their content."""
    content = ["video", "variant"]
    expert = _pixels(spark, folder).where("track = 'expert'").drop("track")
    gains = exposure.fit_gains(expert, content)
    calibrated = exposure.calibrate(expert, gains, content)
    scores = metrics.pixel_scores(calibrated, [*KEYS, "exposure_gain"])
    return scores.select(
        *KEYS,
        round_to(F.col("exposure_gain"), 8).alias("exposure_gain"),
        *(round_to(F.col(n), 5).alias(f"exposure_calibrated_{n}") for n in _CALS),
    )


@query(
    "pq_code_stats",
    q.rows(
        q.PX, q.CODED,
        "v AS (SELECT video, variant, unnest([pr,pg,pb]) AS v FROM coded)",
        select="SELECT video, variant, round(avg(v),8) AS mean_pq_code, round(quantile_cont(v,0.99),8) AS p99_pq_code,"
        " round(max(v),8) AS max_pq_code FROM v GROUP BY ALL",
    ),
)
def pq_code_stats(spark, folder):
    keys = ["video", "variant"]
    stats = describe.code_statistics(_pixels(spark, folder), keys, "p")
    return _rounded(stats, keys, ["mean_pq_code", "p99_pq_code", "max_pq_code"], 8)


@query(
    "global_stats",
    q.rows(
        q.PX, f"y AS (SELECT video, variant, {q.dot(q.Y2020, ['tr/1e3', 'tg/1e3', 'tb/1e3'])} AS y FROM px)",
        select="SELECT video, variant, round(avg(y),11) AS mean_y, round(stddev_samp(y),11) AS std_y,"
        " round(quantile_cont(y,0.95),11) AS p95_y, round(quantile_cont(y,0.99),11) AS p99_y FROM y GROUP BY ALL",
    ),
)
def global_stats(spark, folder):
    keys = ["video", "variant"]
    y = luma_2020(rgb("t").map(lambda c: c / num(1000)))
    lit = tables.px(spark, folder).select(*keys, y.alias("y"))
    stats = describe.global_stats(lit, keys, "y")
    return _rounded(stats, keys, ["mean_y", "std_y", "p95_y", "p99_y"], 11)


@query(
    "nit_anchor",
    q.rows(
        q.PX,
        f"a AS (SELECT video, variant, quantile_cont({q.dot(q.Y709, _P)},0.995) AS a FROM px GROUP BY ALL)",
        "s AS (SELECT *, CASE WHEN a > 0 THEN 1e3/a ELSE 1e0 END AS anchor_scale FROM px JOIN a USING (video, variant))",
        "n AS (SELECT video, frame, variant, anchor_scale, "
        + q.alias(q.mat(q.M2020, [q.clamp(f"p{c}*anchor_scale", 0, 1000) for c in "rgb"]), "n")
        + " FROM s)",
        select="SELECT video, frame, variant, round(anchor_scale,8) AS anchor_scale, "
        + ", ".join(f"round({q.nits_code(q.clamp(f'n{c}', 0, 1000))},8) AS h{c}" for c in "rgb")
        + " FROM n",
    ),
)
def nit_anchor(spark, folder):
    pixels = tables.px(spark, folder).select(*KEYS, *_P)
    anchored = describe.anchored_pq(pixels, ["video", "variant"], "p")
    return _rounded(anchored, KEYS, ["anchor_scale", "hr", "hg", "hb"], 8)


@query(
    "ref_max_rescale",
    q.rows(
        q.PX, q.CODED,
        "m AS (SELECT video, frame, variant, max(greatest(tr,tg,tb))/greatest(max(greatest(pr,pg,pb)),1e-8) AS factor"
        " FROM coded GROUP BY ALL)",
        select="SELECT video, frame, variant, round(factor,8) AS factor, "
        + ", ".join(f"round({q.clamp(f'p{c}*factor', 0, 1)},8) AS p{c}" for c in "rgb")
        + " FROM coded JOIN m USING (video, frame, variant)",
    ),
)
def ref_max_rescale(spark, folder):
    scaled = describe.match_maximum(_pixels(spark, folder).drop("track"), KEYS)
    return _rounded(scaled, KEYS, ["factor", "pr", "pg", "pb"], 8)


_PL, _TL = ([f"({c}/1e3)" for c in side] for side in (_P, _T))


@query(
    "recon_losses",
    q.rows(
        q.PX, q.CODED, q.LIT,
        f"l AS (SELECT video, frame, variant, avg(abs({q.dot(q.Y2020, _PL)}-{q.dot(q.Y2020, _TL)})) AS a,"
        " avg((abs(pr-tr)+abs(pg-tg)+abs(pb-tb))/3e3) AS b, avg(pow(pr/1e3-tr/1e3,2)) AS v FROM lit GROUP BY ALL)",
        select="SELECT video, frame, variant, round(a,8) AS luma_l1, round(b,8) AS rgb_l1,"
        " round(a+5e-1*b,8) AS recon_total, round(v,8) AS velocity FROM l",
    ),
)
def recon_losses(spark, folder):
    flow = [pq_eotf_nits(F.col(n)) / num(1000) for n in ("pr", "tr")]
    velocity = metrics.mean_square_error(*flow).alias("velocity")
    joined = metrics.reconstruction_losses(_pixels(spark, folder), KEYS, also=[velocity])
    return _rounded(joined, KEYS, ["luma_l1", "rgb_l1", "recon_total", "velocity"], 8)


def _unit(name):
    return f"[x/greatest(sqrt(list_sum([y*y FOR y IN {name}])),1e-12) FOR x IN {name}]"


@query(
    "feature_distance",
    q.rows(
        q.FEAT,
        f"u AS (SELECT vec_id, {_unit('s1')} || {_unit('s2')} AS u FROM feat)",
        select="SELECT a.vec_id, round(sqrt(list_sum([pow(a.u[i]-b.u[i],2) FOR i IN range(1,65)])),8) AS distance"
        " FROM u a JOIN u b ON b.vec_id = a.vec_id + 1",
    ),
)
def feature_distance(spark, folder):
    """Features of a row against those of the next row."""
    feats = tables.features(spark, folder).select("vec_id", "s1", "s2")
    nexts = feats.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("s1").alias("r1"), F.col("s2").alias("r2")
    )
    distance = metrics.feature_distance(["s1", "s2"], ["r1", "r2"])
    return feats.join(nexts, "vec_id").select("vec_id", round_to(distance, 8).alias("distance"))


# ------------------------------------------------------------- flicker
_UNITS = q.pu21(q.code_nits("code"))
_FLICKER = [
    q.PLANES,
    f"u AS (SELECT video, frame, y, x, {q.pu21(q.code_nits('(code*9e-1+2e-2)'))} AS pred, {_UNITS} AS target FROM planes)",
    "d AS (SELECT video, frame, abs(pred-lag(pred) OVER w) AS pred, abs(target-lag(target) OVER w) AS target"
    " FROM u WINDOW w AS (PARTITION BY video, y, x ORDER BY frame))",
    "st AS (SELECT video, frame, sum(pred) AS pred, sum(target) AS target FROM d GROUP BY ALL)",
    "fl AS (SELECT video, avg(pred) AS flicker_raw, avg(target) AS flicker_reference, count(pred) AS steps FROM st GROUP BY ALL)",
]
_FLICKER_SELECT = (
    "SELECT video, round(flicker_raw,5) AS flicker_raw, round(flicker_reference,5) AS flicker_reference,"
    " round(flicker_raw-flicker_reference,5) AS flicker_excess,"
    " CASE WHEN steps = 0 THEN 'skipped (single frame)' END AS temporal FROM fl"
)


@query("flicker", q.rows(*_FLICKER, select=_FLICKER_SELECT))
def flicker(spark, folder):
    pixels = fr.spread_pixels(tables.frames(spark, folder), ["video", "frame"], {"code": "plane"})
    units = lambda code: pu21_encode(pq_eotf_nits(code))
    lit = pixels.withColumns(
        {"pred": units(F.col("code") * num(0.9) + num(0.02)), "target": units(F.col("code"))}
    )
    planes = fr.repack(lit, ["video", "frame"], ["pred", "target"], "double")
    found = flick.flicker(flick.tile_transitions(planes, ["video"], "frame", 32), ["video"])
    return found.select(
        "video",
        *(round_to(F.col(n), 5).alias(n) for n in metrics.TEMPORAL_METRICS),
        "temporal",
    )


# ------------------------------------------------------------- score tables
_ROWS = (
    "fs AS (SELECT video, frame, variant, CASE WHEN (video+frame)%3=0 THEN 'ugc' ELSE 'pgc' END AS category,"
    " CASE WHEN variant='A' THEN 'exposure_calibrated' ELSE 'raw' END AS headline_protocol,"
    " CASE WHEN variant='A' THEN 1e0+video/1e2 END AS exposure_gain,"
    f" {_SCORE}, NULL::DOUBLE AS hdr_lpips FROM itp GROUP BY video, frame, variant)"
)
_SCORED = [q.PX, q.CODED, q.LIT, *_ictcp(), _ROWS]
_NAMES = ["psnr", "psnr_y", "deitp"]


def frame_rows(spark, folder):
    scores = metrics.pixel_scores(_pixels(spark, folder), KEYS)
    calibrated = F.col("variant") == "A"
    return scores.withColumns(
        {
            "category": F.when((F.col("video") + F.col("frame")) % 3 == 0, "ugc").otherwise("pgc"),
            "headline_protocol": F.when(calibrated, "exposure_calibrated").otherwise("raw"),
            "exposure_gain": F.when(calibrated, num(1) + F.col("video") / num(100)),
            "hdr_lpips": F.lit(None).cast("double"),
        }
    )


@query(
    "aggregate_variant",
    q.rows(
        *_SCORED,
        select="SELECT coalesce(variant,'ALL') AS variant, "
        + ", ".join(f"round(avg({n}),6) AS {n}" for n in [*_NAMES, "hdr_lpips"])
        + " FROM fs GROUP BY GROUPING SETS ((variant),())",
    ),
)
def aggregate_variant(spark, folder):
    means = reduce.means_by(frame_rows(spark, folder), "variant")
    return _rounded(means, ["variant"], [*_NAMES, "hdr_lpips"])


_VIDEO = (
    "vr AS (SELECT video, variant, arg_min(category, frame) AS category, count(*) AS n_frames,"
    " arg_min(headline_protocol, frame) AS headline_protocol, arg_min(exposure_gain, frame) AS exposure_gain, "
    + ", ".join(f"avg({n}) AS {n}" for n in [*_NAMES, "hdr_lpips"])
    + " FROM fs GROUP BY video, variant)"
)


@query(
    "per_video",
    q.rows(
        *_SCORED, _VIDEO,
        select="SELECT video, variant, category, n_frames, headline_protocol, round(exposure_gain,6) AS exposure_gain, "
        + ", ".join(f"round({n},6) AS {n}" for n in [*_NAMES, "hdr_lpips"])
        + " FROM vr",
    ),
)
def per_video(spark, folder):
    videos = reduce.per_video(frame_rows(spark, folder), "frame")
    plain = ["video", "variant", "category", "n_frames", "headline_protocol"]
    return _rounded(videos, plain, ["exposure_gain", *_NAMES, "hdr_lpips"])


_OVERALL = (
    "ov AS (SELECT coalesce(variant,'ALL') AS variant, count(*) AS n_videos,"
    " CASE WHEN count(DISTINCT headline_protocol)=1 THEN min(headline_protocol) ELSE 'mixed' END AS headline_protocol, "
    + ", ".join(f"avg({n}) AS {n}" for n in [*_NAMES, "hdr_lpips"])
    + " FROM vr GROUP BY GROUPING SETS ((variant),()))"
)


@query(
    "overall_rows",
    q.rows(
        *_SCORED, _VIDEO, _OVERALL,
        select="SELECT variant, n_videos, headline_protocol, "
        + ", ".join(f"round({n},6) AS {n}" for n in [*_NAMES, "hdr_lpips"])
        + " FROM ov",
    ),
)
def overall_rows(spark, folder):
    total = reduce.overall(reduce.per_video(frame_rows(spark, folder), "frame"))
    plain = ["variant", "n_videos", "headline_protocol"]
    return _rounded(total, plain, [*_NAMES, "hdr_lpips"])


@query(
    "csv_unavailable",
    q.rows(
        *_SCORED, _VIDEO,
        select="SELECT video, variant, n_frames, "
        + ", ".join(f"round({n},3)::VARCHAR AS {n}" for n in _NAMES)
        + ", coalesce(round(hdr_lpips,3)::VARCHAR,'unavailable: no backend is registered') AS hdr_lpips FROM vr",
    ),
)
def csv_unavailable(spark, folder):
    videos = reduce.per_video(frame_rows(spark, folder), "frame")
    names = [*_NAMES, "hdr_lpips"]
    rows = _rounded(videos, ["video", "variant", "n_frames"], names, 3)
    return reduce.with_reasons(rows, names, reduce.availability())


@query(
    "report_lines",
    q.rows(
        *_SCORED, _VIDEO, _OVERALL,
        select="SELECT variant, '| '||variant||' | '||"
        + "||' | '||".join(f"coalesce(printf('%.3f',{n}),'-')" for n in [*_NAMES, "hdr_lpips"])
        + "||' |' AS line FROM ov",
    ),
)
def report_lines(spark, folder):
    total = reduce.overall(reduce.per_video(frame_rows(spark, folder), "frame"))
    return reduce.report_lines(total, "variant", [*_NAMES, "hdr_lpips"])
