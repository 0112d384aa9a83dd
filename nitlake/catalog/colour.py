"""Colour functions over the whole pixel view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gamut, light, spaces, transfer
from ..functions.common import RGB, lay, num, rgb, round_to
from ..sources import tables
from . import query
from . import sqltext as q

KEYS = ["video", "frame", "variant"]
TEN_K = 10_000.0


def _out(df, digits=6, **columns):
    return df.select(*KEYS, *(round_to(c, digits).alias(n) for n, c in columns.items()))


def _sql(*parts, digits=6, source="px", **columns):
    picked = ", ".join(f"{q.rnd(text, digits)} AS {name}" for name, text in columns.items())
    return q.rows(q.PX, *parts, select=f"SELECT video, frame, variant, {picked} FROM {source}")


@query(
    "pq_transfer",
    _sql(
        "c AS (SELECT *, " + ", ".join(f"{q.nits_code('t' + c)} AS c{c}" for c in "rgb") + " FROM px)",
        source="c",
        digits=8,
        code_r="cr",
        code_g="cg",
        code_b="cb",
        light_r=q.eotf("cr"),
        light_g=q.eotf("cg"),
        light_b=q.eotf("cb"),
    ),
)
def pq_transfer(spark, folder):
    df, codes = lay(tables.px(spark, folder), "c", rgb("t").map(transfer.pq_oetf_nits))
    lights = codes.map(transfer.pq_eotf)
    return _out(
        df,
        8,
        **{f"code_{n}": c for n, c in zip("rgb", codes)},
        **{f"light_{n}": c for n, c in zip("rgb", lights)},
    )


def _sql_709_oetf(x):
    return f"CASE WHEN {x} < 1.8e-2 THEN 4.5e0*{x} ELSE 1.099e0*pow(greatest({x},1e-12),4.5e-1)-9.9e-2 END"


def _sql_709_eotf(x):
    return f"CASE WHEN {x} < {q.d(0.018 * 4.5)} THEN {x}/4.5e0 ELSE pow(({x}+9.9e-2)/1.099e0,{q.d(1 / 0.45)}) END"


@query(
    "sdr_transfer",
    _sql(
        "v AS (SELECT *, tr/1e3 AS x, (tg+tb)/2e3 AS s FROM px)",
        source="v",
        digits=8,
        oetf_709=_sql_709_oetf("x"),
        eotf_709=_sql_709_eotf("s"),
        eotf_1886=q.bt1886("s"),
        inverse_1886=q.unbt1886("x"),
    ),
)
def sdr_transfer(spark, folder):
    df = tables.px(spark, folder).withColumns(
        {"x": F.col("tr") / num(1000), "s": (F.col("tg") + F.col("tb")) / num(2000)}
    )
    return _out(
        df,
        8,
        oetf_709=transfer.bt709_oetf(F.col("x")),
        eotf_709=transfer.bt709_eotf(F.col("s")),
        eotf_1886=transfer.bt1886_eotf(F.col("s")),
        inverse_1886=transfer.bt1886_inverse(F.col("x")),
    )


A, B, C = 0.17883277, 0.28466892, 0.55991073


def _sql_hlg(x):
    upper = f"{q.d(A)}*ln(greatest(12e0*{x}-{q.d(B)},1e-12))+{q.d(C)}"
    return f"CASE WHEN {x} <= {q.d(1 / 12)} THEN sqrt(3e0*{x}) ELSE {upper} END"


def _sql_unhlg(x):
    return f"CASE WHEN {x} <= 5e-1 THEN {x}*{x}/3e0 ELSE (exp(({x}-{q.d(C)})/{q.d(A)})+{q.d(B)})/12e0 END"


@query(
    "hlg_transfer",
    _sql(
        "v AS (SELECT *, tr/1e3 AS x, (tg+tb)/2e3 AS s FROM px)",
        source="v",
        digits=8,
        signal=_sql_hlg("x"),
        scene=_sql_unhlg("s"),
    ),
)
def hlg_transfer(spark, folder):
    df = tables.px(spark, folder).withColumns(
        {"x": F.col("tr") / num(1000), "s": (F.col("tg") + F.col("tb")) / num(2000)}
    )
    return _out(
        df, 8, signal=transfer.hlg_oetf(F.col("x")), scene=transfer.hlg_inverse(F.col("s"))
    )


_T = ["tr/1e3", "tg/1e3", "tb/1e3"]


@query(
    "gamut_convert",
    _sql(
        digits=8,
        **{f"wide_{n}": c for n, c in zip("rgb", q.mat(q.M2020, _T))},
        **{f"narrow_{n}": c for n, c in zip("rgb", q.mat(q.M709, _T))},
        **{f"clipped_{n}": q.clamp(c, 0, 1) for n, c in zip("rgb", q.mat(q.M709, _T))},
        **{f"p3_{n}": c for n, c in zip("rgb", q.mat(q.MP3, _T))},
        **{f"xyz_{n}": c for n, c in zip("xyz", q.mat(q.MXYZ, _T))},
    ),
)
def gamut_convert(spark, folder):
    df = tables.px(spark, folder)
    light_ = rgb("t").map(lambda c: c / num(1000))
    sets = {
        "wide": (gamut.from_709(light_), "rgb"),
        "narrow": (gamut.to_709(light_), "rgb"),
        "clipped": (gamut.to_709_clipped(light_), "rgb"),
        "p3": (gamut.from_p3(light_), "rgb"),
        "xyz": (gamut.mix(gamut.XYZ_FROM_2020, light_), "xyz"),
    }
    columns = {
        f"{name}_{n}": c for name, (colour, names) in sets.items() for n, c in zip(names, colour)
    }
    return _out(df, 8, **columns)


@query(
    "luma",
    q.rows(
        q.PX,
        q.CODED,
        q.LIT,
        select="SELECT video, frame, variant, "
        f"round({q.dot(q.Y2020, ['tr', 'tg', 'tb'])},5) AS nits_2020, "
        f"round({q.dot(q.Y709, ['pr', 'pg', 'pb'])},5) AS nits_709 FROM lit",
    ),
)
def luma(spark, folder):
    df = tables.coded(tables.px(spark, folder))
    df = df.withColumn("nits_2020", spaces.pq_luminance_nits(rgb("t")))
    return _out(
        df,
        5,
        nits_2020=F.col("nits_2020"),
        nits_709=spaces.luma_709(rgb("p").map(transfer.pq_eotf_nits)),
    )


_Y = q.dot(q.Y2020, ["tr", "tg", "tb"])


@query(
    "ycbcr",
    q.rows(
        q.PX,
        q.CODED,
        f"y AS (SELECT *, {_Y} AS y FROM coded)",
        "u AS (SELECT *, (tb-y)/1.8814e0 AS cb, (tr-y)/1.4746e0 AS cr FROM y)",
        "v AS (SELECT *, y+1.4746e0*cr AS br, y+1.8814e0*cb AS bb FROM u)",
        select="SELECT video, frame, variant, round(y,8) AS y, round(cb,8) AS cb, round(cr,8) AS cr,"
        " round(br,8) AS back_r, round((y-2.627e-1*br-5.93e-2*bb)/6.78e-1,8) AS back_g,"
        " round(bb,8) AS back_b FROM v",
    ),
)
def ycbcr(spark, folder):
    df = tables.coded(tables.px(spark, folder))
    y, cb, cr = spaces.to_ycbcr(rgb("t"))
    df = df.withColumns({"y": y, "cb": cb, "cr": cr})
    back = spaces.from_ycbcr(F.col("y"), F.col("cb"), F.col("cr"))
    return _out(
        df,
        8,
        **{n: F.col(n) for n in ("y", "cb", "cr")},
        **{f"back_{n}": c for n, c in zip("rgb", back)},
    )


@query(
    "ictcp",
    q.rows(
        q.PX,
        q.CODED,
        q.LIT,
        "lms AS (SELECT *, "
        + q.alias([q.nits_code(x) for x in q.mat(q.MLMS, ["tr", "tg", "tb"])], "l", "123")
        + " FROM lit)",
        select="SELECT video, frame, variant, "
        + ", ".join(
            f"round({x},8) AS {n}" for x, n in zip(q.mat(q.MITP, ["l1", "l2", "l3"]), ("i", "ct", "cp"))
        )
        + " FROM lms",
    ),
)
def ictcp(spark, folder):
    df = tables.coded(tables.px(spark, folder))
    df, nits = lay(df, "n", rgb("t").map(transfer.pq_eotf_nits))
    return _out(df, 8, **dict(zip(("i", "ct", "cp"), spaces.ictcp(nits))))


@query(
    "pu21",
    _sql(
        f"u AS (SELECT *, {q.pu21('tr')} AS ur, {q.pu21('pg')} AS ug FROM px)",
        source="u",
        units_r="ur",
        units_g="ug",
        nits_r=q.unpu21("ur"),
    ),
)
def pu21(spark, folder):
    df = tables.px(spark, folder).withColumns(
        {"ur": spaces.pu21_encode(F.col("tr")), "ug": spaces.pu21_encode(F.col("pg"))}
    )
    return _out(
        df, units_r=F.col("ur"), units_g=F.col("ug"), nits_r=spaces.pu21_decode(F.col("ur"))
    )


@query(
    "linear_light",
    q.rows(
        q.PX,
        q.CODED,
        select="SELECT video, frame, variant, "
        + ", ".join(
            f"round({q.clamp(x, 0, 1)},8) AS sdr_{n}"
            for x, n in zip(q.mat(q.M2020, [q.bt1886(f"t{c}") for c in "rgb"]), "rgb")
        )
        + ", "
        + ", ".join(f"round({q.code_nits('p' + c)}/1e3,8) AS hdr_{c}" for c in "rgb")
        + " FROM coded",
    ),
)
def linear_light(spark, folder):
    df = tables.coded(tables.px(spark, folder))
    return _out(
        df,
        8,
        **{f"sdr_{n}": c for n, c in zip("rgb", light.sdr_light(rgb("t")))},
        **{f"hdr_{n}": c for n, c in zip("rgb", light.pq_light(rgb("p")))},
    )


@query(
    "saturation",
    _sql(
        digits=8,
        saturation="(greatest(tr,tg,tb)/1e3-least(tr,tg,tb)/1e3)/(greatest(tr,tg,tb)/1e3+1e-6)",
    ),
)
def saturation(spark, folder):
    return _out(
        tables.px(spark, folder),
        8,
        saturation=light.saturation(rgb("t").map(lambda c: c / num(1000))),
    )


FORMATS = ("pq2020", "hlg2020", "pq_p3d65", "sdr709")
_FORMAT_SQL = "CASE frame % 4 " + " ".join(
    f"WHEN {i} THEN '{f}'" for i, f in enumerate(FORMATS)
) + " END"


def _sql_sources():
    s = ["tr", "tg", "tb"]
    forms = {
        "pq2020": [q.code_nits(c) for c in s],
        "hlg2020": [f"(pow(greatest({_sql_unhlg(c)},0e0),1.2e0)*1e3)" for c in s],
        "pq_p3d65": [f"greatest({x},0e0)" for x in q.mat(q.MP3, [q.code_nits(c) for c in s])],
        "sdr709": [
            f"(greatest({x},0e0)*1e2)" for x in q.mat(q.M2020, [q.bt1886(c) for c in s])
        ],
    }
    channels = []
    for index, n in enumerate("rgb"):
        case = " ".join(f"WHEN '{f}' THEN {forms[f][index]}" for f in FORMATS)
        channels.append(f"least(greatest(CASE f {case} END,0e0),1e3) AS n{n}")
    return q.rows(
        q.PX,
        q.CODED,
        f"f AS (SELECT *, {_FORMAT_SQL} AS f FROM coded)",
        f"n AS (SELECT *, {', '.join(channels)} FROM f)",
        select="SELECT video, frame, variant, f AS format, "
        + ", ".join(f"round({q.nits_code('n' + c)},8) AS {c}" for c in "rgb")
        + " FROM n",
    )


@query("normalize_sources", _sql_sources())
def normalize_sources(spark, folder):
    df = tables.coded(tables.px(spark, folder))
    named = F.when(F.col("frame") % 4 == 0, FORMATS[0])
    for index, name in enumerate(FORMATS[1:], 1):
        named = named.when(F.col("frame") % 4 == index, name)
    df = df.withColumn("format", named)
    codes: RGB = light.normalise_by(rgb("t"), F.col("format"))
    return df.select(
        *KEYS, "format", *(round_to(c, 8).alias(n) for n, c in zip("rgb", codes))
    )
