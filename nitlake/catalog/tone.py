"""Tone mapping, inverses and tone curves."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import codes, curves, spline, tone
from ..functions.common import num, rgb, round_to
from ..operators.attach import attach
from ..sources import tables
from . import query
from . import sqltext as q

KEYS = ["video", "frame", "variant"]

K1, K2, K3, K4 = 0.83802, 15.09968, 0.74204, 78.99439
KNEE = 58.5 / K1
C_SCALE = 100 / (K2 * math.log(1000 / KNEE - K3) + K4)


def _sql_method_c(y):
    upper = f"{q.d(K2)}*ln(greatest(({y})/{q.d(KNEE)}-{q.d(K3)},1e-12))+{q.d(K4)}"
    return f"((CASE WHEN {y} < {q.d(KNEE)} THEN {q.d(K1)}*({y}) ELSE {upper} END)*{q.d(C_SCALE)})"


def _sql_reinhard(y):
    x = f"({q.clamp(y, 0, 1000)}/1e2)"
    return f"(1e2*{x}*(1e0+{x}/1e2)/(1e0+{x}))"


def _sql_method_a(y):
    rho, rho_sdr = 1 + 32 * 0.1 ** (1 / 2.4), 1 + 32 * 0.01 ** (1 / 2.4)
    x = f"(ln(1e0+{q.d(rho - 1)}*pow(greatest(({y})/1e3,1e-6),{q.d(1 / 2.4)}))/{q.d(math.log(rho))})"
    bent = (
        f"CASE WHEN {x} <= 7.399e-1 THEN 1.077e0*{x} WHEN {x} < 9.909e-1 "
        f"THEN -1.151e0*{x}*{x}+2.7811e0*{x}-6.302e-1 ELSE 5e-1*{x}+5e-1 END"
    )
    return f"(pow(greatest((pow({q.d(rho_sdr)},{bent})-1e0)/{q.d(rho_sdr - 1)},0e0),2.4e0)*1e2)"


def _relit(colour, y, z):
    return [f"(CASE WHEN {y} > 0 THEN ({c})*({z}/greatest({y},1e-8)) ELSE 0e0 END)" for c in colour]


N = ["n_r", "n_g", "n_b"]
MIXED = np.full((3, 3), 0.1) + 0.7 * np.eye(3)
TO_X = q.MXYZ @ MIXED
FROM_X = np.linalg.inv(MIXED) @ np.linalg.inv(q.MXYZ)


def _sql_bt2390():
    source, target = q.pq_number(1000), q.pq_number(100)
    top = target / source
    ks = 1.5 * top - 0.5
    light = []
    for c in "rgb":
        e = f"({q.clamp('t' + c, 0, source)}/{q.d(source)})"
        t = f"(({e}-{q.d(ks)})/{q.d(1 - ks + 1e-9)})"
        p = (
            f"((2e0*pow({t},3)-3e0*pow({t},2)+1e0)*{q.d(ks)}+(pow({t},3)-2e0*pow({t},2)+{t})*{q.d(1 - ks)}"
            f"+(-2e0*pow({t},3)+3e0*pow({t},2))*{q.d(top)})"
        )
        e2 = f"(CASE WHEN {e} < {q.d(ks)} THEN {e} ELSE {p} END)"
        light.append(f"({q.code_nits(q.clamp(f'{e2}*{q.d(source)}', 0, target))}/1e2)")
    return light


def _sql_light() -> dict[str, list[str]]:
    def film(n):
        x = f"({n}/{q.d(0.18 * 1000 / 4)})"
        value = f"(({x}*(2.51e0*{x}+3e-2))/({x}*(2.43e0*{x}+5.9e-1)+1.4e-1))"
        return q.clamp(value, 0, 1)

    def log(n):
        x = f"({n}/1e2)"
        upper = f"2.47190e-1*log10(greatest(5.555556e0*{x}+5.2272e-2,1e-6))+3.85537e-1"
        return q.clamp(f"(CASE WHEN {x} < 1.1e-2 THEN 5.37e0*{x}+9.3e-2 ELSE {upper} END)", 0, 1)

    over = lambda colour: [f"({c}/1e2)" for c in colour]
    return {
        "reinhard": over(_relit(N, "y", "y_reinhard")),
        "bt2446a": over(_relit(N, "y", "y_a")),
        "bt2446c_gm": q.mat(FROM_X / 100, _relit(["x", "xy", "z"], "xy", "y_c")),
        "hard_clip_gm": [f"({n}/1e2)" for n in N],
        "bt2390_eetf_gm": _sql_bt2390(),
        "ocio_filmic": [film(n) for n in N],
        "youtube_logc": [log(n) for n in N],
        "gamma_clip": [f"pow(greatest({n}/1e3,0e0),{q.d(1 / 1.4)})" for n in N],
    }


TMOS = sorted(_sql_light())
_NITS = "n AS (SELECT *, " + ", ".join(
    f"least({q.code_nits('t' + c)},1e3) AS n_{c}" for c in "rgb"
) + " FROM coded)"
_XYZ = q.mat(TO_X, N)
_BASE = [
    q.PX,
    q.CODED,
    _NITS,
    f"yy AS (SELECT *, {q.dot(q.Y2020, N)} AS y, {_XYZ[0]} AS x, {_XYZ[1]} AS xy, {_XYZ[2]} AS z FROM n)",
    f"lum AS (SELECT *, {_sql_reinhard('y')} AS y_reinhard, {_sql_method_a('y')} AS y_a,"
    f" {_sql_method_c(q.clamp('xy', 0, 1000))} AS y_c FROM yy)",
]


def _sql_signals(source="lum"):
    """One SELECT per operator, joined by UNION ALL, giving sr, sg, sb."""
    parts = []
    for name, light in _sql_light().items():
        cells = [f"least(greatest({q.unbt1886(m)},0e0),1e0)" for m in q.mat(q.M709, ["lr", "lg", "lb"])]
        parts.append(
            f"SELECT video, frame, variant, '{name}' AS tmo, {q.alias(cells, 's')} FROM "
            f"(SELECT video, frame, variant, {q.alias(light, 'l')} FROM {source})"
        )
    return "grid AS (" + "\nUNION ALL ".join(parts) + ")"


@query(
    "tmo_grid",
    q.rows(
        *_BASE,
        _sql_signals(),
        select="SELECT video, variant, tmo, count(*) AS n_pixels, "
        + ", ".join(
            f"round({f}(s{c}),6) AS {f}_{c}" for f in ("avg", "min", "max") for c in "rgb"
        )
        + " FROM grid GROUP BY ALL",
    ),
)
def tmo_grid(spark, folder):
    grid = tone.tone_grid(tables.coded(tables.px(spark, folder)), codes="t")
    reducers = {"avg": F.avg, "min": F.min, "max": F.max}
    return grid.groupBy("video", "variant", "tmo").agg(
        F.count(F.lit(1)).alias("n_pixels"),
        *(
            round_to(reduce(F.col(f"s{c}"))).alias(f"{name}_{c}")
            for name, reduce in reducers.items()
            for c in "rgb"
        ),
    )


def _sql_uncurve_c(s):
    un = f"(greatest({s},0e0)/{q.d(C_SCALE)})"
    upper = f"{q.d(KNEE)}*(exp(({un}-{q.d(K4)})/{q.d(K2)})+{q.d(K3)})"
    return q.clamp(f"(CASE WHEN {un} < 5.85e1 THEN {un}/{q.d(K1)} ELSE {upper} END)", 0, 1000)


def _sql_unreinhard(s):
    out = f"({q.clamp(s, 0, 100)}/1e2)"
    b = f"(1e0-{out})"
    return q.clamp(f"((-{b}+sqrt({b}*{b}+4e-2*{out}))/2e-2*1e2)", 0, 1000)


@query(
    "tone_luminance",
    q.rows(
        q.PX,
        select="SELECT video, frame, variant, "
        f"round({_sql_method_c('tr')},5) AS method_c, round({_sql_reinhard('tr')},5) AS reinhard, "
        f"round({_sql_method_a('tr')},5) AS method_a, "
        f"round({_sql_uncurve_c('tg/1e1')},4) AS method_c_back, "
        f"round({_sql_unreinhard('tg/1e1')},4) AS reinhard_back, "
        f"round({q.d(C_SCALE)},8) AS method_c_scale FROM px",
    ),
)
def tone_luminance(spark, folder):
    df = tables.px(spark, folder)
    hdr, sdr = F.col("tr"), F.col("tg") / num(10)
    return df.select(
        *KEYS,
        round_to(curves.method_c(hdr), 5).alias("method_c"),
        round_to(curves.reinhard(hdr), 5).alias("reinhard"),
        round_to(curves.method_a(hdr), 5).alias("method_a"),
        round_to(curves.method_c_inverse(sdr), 4).alias("method_c_back"),
        round_to(curves.reinhard_inverse(sdr), 4).alias("reinhard_back"),
        round_to(num(curves.method_c_scale()), 8).alias("method_c_scale"),
    )


# The signal that the inverses start from: light over its largest value.
_SIGNAL = "s AS (SELECT video, frame, variant, tr/1e3 AS sr, tg/1e3 AS sg, tb/1e3 AS sb FROM px)"
_SN = [f"({x}*1e2)" for x in (q.bt1886("sr"), q.bt1886("sg"), q.bt1886("sb"))]


def _signal(spark, folder):
    df = tables.px(spark, folder)
    return df.select(*KEYS, *((c / num(1000)).alias(f"s{n}") for n, c in zip("rgb", rgb("t"))))


def _hdr(df):
    return df.select(*KEYS, *(round_to(F.col(f"h{c}"), 8).alias(f"h{c}") for c in "rgb"))


@query(
    "inverse_bt2446c",
    q.rows(
        q.PX,
        _SIGNAL,
        f"n AS (SELECT *, {q.alias(q.mat(q.M2020, _SN), 'n_')} FROM s)",
        f"x AS (SELECT *, {_XYZ[0]} AS x, {_XYZ[1]} AS xy, {_XYZ[2]} AS z FROM n)",
        f"y AS (SELECT *, {_sql_uncurve_c('xy')} AS yy FROM x)",
        f"h AS (SELECT *, {q.alias(q.mat(FROM_X, _relit(['x', 'xy', 'z'], 'xy', 'yy')), 'o_')} FROM y)",
        select="SELECT video, frame, variant, "
        + ", ".join(f"round({q.nits_code(q.clamp('o_' + c, 0, 1000))},8) AS h{c}" for c in "rgb")
        + " FROM h",
    ),
)
def inverse_bt2446c(spark, folder):
    return _hdr(tone.invert_bt2446c(_signal(spark, folder), signal="s"))


@query(
    "inverse_reinhard",
    q.rows(
        q.PX,
        _SIGNAL,
        f"n AS (SELECT *, {q.alias(q.mat(q.M2020, _SN), 'n_')} FROM s)",
        f"y AS (SELECT *, {q.dot(q.Y2020, N)} AS y FROM n)",
        f"z AS (SELECT *, {_sql_unreinhard('y')} AS yy FROM y)",
        f"h AS (SELECT *, {q.alias(_relit(N, 'y', 'yy'), 'o_')} FROM z)",
        select="SELECT video, frame, variant, "
        + ", ".join(f"round({q.nits_code(q.clamp('o_' + c, 0, 1000))},8) AS h{c}" for c in "rgb")
        + " FROM h",
    ),
)
def inverse_reinhard(spark, folder):
    return _hdr(tone.invert_reinhard(_signal(spark, folder), signal="s"))


_PV = [f"(greatest({x},0e0)/2.03e2)" for x in q.mat(q.M709, ["tr", "tg", "tb"])]
_LW2 = (1000 / 203) ** 2


@query(
    "sdr_preview",
    q.rows(
        q.PX,
        q.CODED,
        q.LIT,
        f"l AS (SELECT *, {q.alias(_PV, 'l')} FROM lit)",
        f"y AS (SELECT *, {q.dot(q.Y709, ['lr', 'lg', 'lb'])} AS y FROM l)",
        f"k AS (SELECT *, (y*(1e0+y/{q.d(_LW2)})/(1e0+y))/greatest(y,1e-6) AS k FROM y)",
        select="SELECT video, frame, variant, "
        + ", ".join(f"round({q.unbt1886(f'(l{c}*k)')},8) AS s{c}" for c in "rgb")
        + ", "
        + ", ".join(f"round({q.unbt1886(f'l{c}')},8) AS c{c}" for c in "rgb")
        + " FROM k",
    ),
)
def sdr_preview(spark, folder):
    df = tables.coded(tables.px(spark, folder))
    df = tone.sdr_preview(df, codes="t", out="s")
    df = tone.sdr_preview(df, codes="t", out="c", method="clip")
    return df.select(*KEYS, *(round_to(F.col(p + c), 8).alias(p + c) for p in "sc" for c in "rgb"))


# ---------------------------------------------------------------- degradation
@query(
    "degrade_codes",
    q.rows(
        *_BASE,
        _sql_signals(),
        select="SELECT video, tmo, count(*) AS n_pixels, "
        + ", ".join(f"sum(round_even(s{c}*255e0,0)::BIGINT)::BIGINT AS sum_{c}" for c in "rgb")
        + " FROM grid GROUP BY ALL",
    ),
)
def degrade_codes(spark, folder):
    grid = tone.tone_grid(tables.coded(tables.px(spark, folder)), codes="t")
    return grid.groupBy("video", "tmo").agg(
        F.count(F.lit(1)).alias("n_pixels"),
        *(
            F.sum(codes.quantise(F.col(f"s{c}"), codes.SDR_CODES)).alias(f"sum_{c}")
            for c in "rgb"
        ),
    )


@query(
    "quantize_codes",
    q.rows(
        q.PX,
        q.CODED,
        select="SELECT video, frame, variant, "
        + ", ".join(f"round_even(t{c}*65535e0,0)::INTEGER AS hdr_{c}" for c in "rgb")
        + ", "
        + ", ".join(f"round_even({q.clamp(f'(p{c}*2e0-5e-1)', 0, 1)}*255e0,0)::INTEGER AS sdr_{c}" for c in "rgb")
        + ", round(round_even(tr*65535e0,0)/65535e0,8) AS back_r FROM coded",
    ),
)
def quantize_codes(spark, folder):
    df = tables.coded(tables.px(spark, folder))
    sdr = rgb("p").map(lambda c: codes.quantise(c * num(2) - num(0.5), codes.SDR_CODES))
    df = df.withColumn("hdr_r", codes.quantise(F.col("tr"), codes.HDR_CODES))
    return df.select(
        *KEYS,
        "hdr_r",
        codes.quantise(F.col("tg"), codes.HDR_CODES).alias("hdr_g"),
        codes.quantise(F.col("tb"), codes.HDR_CODES).alias("hdr_b"),
        *(c.alias(f"sdr_{n}") for n, c in zip("rgb", sdr)),
        round_to(codes.scale(F.col("hdr_r"), codes.HDR_CODES), 8).alias("back_r"),
    )


@query(
    "crf_quality",
    """WITH c AS (SELECT video, frame, (abs(hash_row) % 60)::INTEGER AS crf FROM
 (SELECT l_suppkey AS video, l_linenumber AS frame, l_partkey AS hash_row FROM lineitem)),
 p(x0,y0,x1,y1) AS (VALUES (18,90,23,75),(23,75,31,45),(31,45,39,20),(39,20,45,12))
SELECT crf, count(*) AS n_rows,
 floor(least(greatest(CASE WHEN crf <= 18 THEN 90e0 WHEN crf >= 45 THEN 12e0 ELSE
  (SELECT max(y0+(y1-y0)::DOUBLE/(x1-x0)*(crf-x0)) FROM p WHERE crf > x0 AND crf <= x1) END,5e0),95e0))::INTEGER
  AS quality
FROM c GROUP BY crf""",
)
def crf_quality(spark, folder):
    df = tables.table(spark, folder, "lineitem")
    crf = (F.abs(F.col("l_partkey")) % 60).cast("int").alias("crf")
    counted = df.select(crf).groupBy("crf").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.withColumn("quality", codes.crf_quality(F.col("crf")))


# ---------------------------------------------------------------- tone curves
BINS = 8


def _curve_columns():
    """Free numbers of a curve: 8 widths, 8 heights and 9 slopes from the first scale."""
    s = F.transform("s1", lambda x: x * num(4))
    return F.slice(s, 1, 8), F.slice(s, 9, 8), F.slice(s, 17, 9)


def _sql_sizes(name, first):
    free = f"[x*4e0 FOR x IN s1[{first}:{first + 7}]]"
    return (
        f"{name}e AS (SELECT vec_id, list_transform({free}, lambda x: exp(x)) AS e FROM feat),"
        f"{name} AS (SELECT vec_id, list_transform(e, lambda x: 1e-3+{q.d(1 - 8e-3)}*x/list_sum(e)) AS {name} FROM {name}e)"
    )


_KNOTS = ",\n".join(
    [
        _sql_sizes("w", 1),
        _sql_sizes("h", 9),
        "d AS (SELECT vec_id, list_transform([x*4e0 FOR x IN s1[17:25]], lambda x: 1e-3+ln(1e0+exp(x))) AS d FROM feat)",
        "par AS (SELECT vec_id, w, h, d,"
        " [0e0]||[CASE WHEN i=8 THEN 1e0 ELSE list_sum(w[1:i]) END FOR i IN range(1,9)] AS cx,"
        " [0e0]||[CASE WHEN i=8 THEN 1e0 ELSE list_sum(h[1:i]) END FOR i IN range(1,9)] AS cy"
        " FROM w JOIN h USING (vec_id) JOIN d USING (vec_id))",
    ]
)


def _sql_curve(value: str, source: str, keep: str, linear: bool = False) -> list[str]:
    """CTEs from ``source`` (columns of par, ``keep`` and ``v``) to ``bent`` with ``out``."""
    th = "th*(1e0-th)"
    num_ = f"ch*((ch/cw)*th*th+dl*{th})"
    den = f"((ch/cw)+(dl+dr-2e0*(ch/cw))*{th})"
    result = "cyl+th*ch" if linear else f"cyl+{num_}/greatest({den},1e-8)"
    return [
        f"b1 AS (SELECT *, {q.clamp(value, 0, 1)} AS v FROM {source})",
        "b2 AS (SELECT *, len(list_filter(cx[2:8], lambda t: t < v)) + 1 AS k FROM b1)",
        "b3 AS (SELECT *, w[k] AS cw, h[k] AS ch, cx[k] AS cxl, cy[k] AS cyl, d[k] AS dl, d[k+1] AS dr FROM b2)",
        f"b4 AS (SELECT *, {q.clamp('((v-cxl)/cw)', 0, 1)} AS th FROM b3)",
        f"bent AS (SELECT {keep}, {q.clamp(result, 0, 1)} AS out FROM b4)",
    ]


_POINTS = (
    "pts AS (SELECT par.*, i, s2[i+1]+5e-1 AS y0 FROM par JOIN feat USING (vec_id), range(32) r(i))"
)


def _tone_points(spark, folder, linear):
    df = tables.features(spark, folder)
    laid = spline.lay_curve(df, *_curve_columns(), BINS)
    spread = laid.select(
        "vec_id", "_c_w", "_c_h", "_c_x", "_c_y", "_c_d", F.posexplode("s2").alias("i", "e")
    )
    bent = spline.apply_curve(spread, F.col("e") + num(0.5), "out", BINS, linear=linear)
    return bent.select("vec_id", F.col("i").cast("bigint").alias("i"), round_to(F.col("out"), 8).alias("out"))


_SELECT_POINTS = "SELECT vec_id, i, round(out,8) AS out FROM bent"


@query("rqs_tone", q.rows(q.FEAT, _KNOTS, _POINTS, *_sql_curve("y0", "pts", "vec_id, i"), select=_SELECT_POINTS))
def rqs_tone(spark, folder):
    return _tone_points(spark, folder, False)


@query(
    "linear_tone",
    q.rows(q.FEAT, _KNOTS, _POINTS, *_sql_curve("y0", "pts", "vec_id, i", True), select=_SELECT_POINTS),
)
def linear_tone(spark, folder):
    return _tone_points(spark, folder, True)


@query(
    "tone_curve_points",
    q.rows(
        q.FEAT,
        _KNOTS,
        "pts AS (SELECT par.*, i, i/255e0 AS y0 FROM par, range(256) r(i))",
        *_sql_curve("y0", "pts", "vec_id, i"),
        select=_SELECT_POINTS,
    ),
)
def tone_curve_points(spark, folder):
    """256 evenly spaced points of every curve, spread out of its own row."""
    laid = spline.lay_curve(tables.features(spark, folder), *_curve_columns(), BINS)
    spread = laid.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(255))))
    bent = spline.apply_curve(spread, F.col("i") / num(255), "out", BINS)
    return bent.select("vec_id", F.col("i").cast("bigint").alias("i"), round_to(F.col("out"), 8).alias("out"))


@query(
    "spline_smoothness",
    q.rows(
        q.FEAT,
        _KNOTS,
        select="SELECT vec_id, round("
        "list_avg([pow(h[i+1]/w[i+1]-h[i]/w[i],2) FOR i IN range(1,8)])"
        "+list_avg([pow(d[i+1]-d[i],2) FOR i IN range(1,9)]),6) AS smoothness FROM par",
    ),
)
def spline_smoothness(spark, folder):
    df = tables.features(spark, folder)
    return df.select(
        "vec_id", round_to(spline.roughness(*_curve_columns(), BINS), 6).alias("smoothness")
    )


CHROMA, BIAS, STRENGTH = ((1.1, 0.05), (-0.02, 0.95)), (0.01, -0.005), 0.8
_TOP = q.pq_number(1000)
_Y = q.dot(q.Y2020, ["tr", "tg", "tb"])


@query(
    "tone_field",
    q.rows(
        q.PX,
        q.CODED,
        q.FEAT,
        _KNOTS,
        "flat AS (SELECT [1.25e-1 FOR i IN range(8)] AS w0, [1e0 FOR i IN range(9)] AS d0,"
        " [i/8e0 FOR i IN range(9)] AS c0)",
        "j AS (SELECT coded.video, frame, variant, coalesce(w,w0) AS w, coalesce(h,w0) AS h,"
        " coalesce(d,d0) AS d, coalesce(cx,c0) AS cx, coalesce(cy,c0) AS cy, "
        + ", ".join(f"{q.clamp('t' + c, 0, _TOP)} AS t{c}" for c in "rgb")
        + " FROM coded LEFT JOIN par ON par.vec_id = coded.video, flat)",
        f"yc AS (SELECT *, {_Y} AS y, (tb-{_Y})/1.8814e0 AS cb, (tr-{_Y})/1.4746e0 AS cr FROM j)",
        *_sql_curve(f"(y/{q.d(_TOP)})", "yc", "video, frame, variant, y, cb, cr"),
        f"z AS (SELECT video, frame, variant, y+8e-1*(out*{q.d(_TOP)}-y) AS y,"
        " 1.1e0*cb+5e-2*cr+1e-2 AS cb, -2e-2*cb+9.5e-1*cr-5e-3 AS cr FROM bent)",
        "rb AS (SELECT *, y+1.4746e0*cr AS r, y+1.8814e0*cb AS b FROM z)",
        "g AS (SELECT *, (y-2.627e-1*r-5.93e-2*b)/6.78e-1 AS g FROM rb)",
        select="SELECT video, frame, variant, "
        + ", ".join(f"round({q.clamp(c, 0, _TOP)},8) AS o{c}" for c in "rgb")
        + " FROM g",
    ),
)
def tone_field(spark, folder):
    """Pixels of a video bent by the curve of that video; without one, the straight line."""
    params = tables.features(spark, folder).select(
        F.col("vec_id").alias("video"),
        *(c.alias(n) for n, c in zip(("fw", "fh", "fd"), _curve_columns())),
    )
    pixels = tables.coded(tables.px(spark, folder)).select(*KEYS, "tr", "tg", "tb")
    # Curves are laid out per video, before they meet the pixels.
    laid = spline.lay_curve(params, F.col("fw"), F.col("fh"), F.col("fd"), BINS)
    laid = laid.select("video", *(f"_c_{n}" for n in "whxyd"))
    flat = {
        "w": [1 / BINS] * BINS,
        "h": [1 / BINS] * BINS,
        "x": [i / BINS for i in range(BINS + 1)],
        "y": [i / BINS for i in range(BINS + 1)],
        "d": [1.0] * (BINS + 1),
    }
    joined = attach(pixels, laid, ["video"], "left").withColumns(
        {
            f"_c_{n}": F.coalesce(F.col(f"_c_{n}"), F.array(*(num(v) for v in values)))
            for n, values in flat.items()
        }
    )
    bent = spline.tone_field(
        joined, codes="t", out="o", bins=BINS, strength=STRENGTH, chroma=CHROMA, bias=BIAS
    )
    return bent.select(*KEYS, *(round_to(F.col(f"o{c}"), 8).alias(f"o{c}") for c in "rgb"))
