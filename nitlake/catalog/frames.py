"""Operators on whole frames, checked pixel by pixel."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import codes, draws
from ..functions.common import num, round_to
from ..operators import codec, frames as fr
from ..session import shared_dir
from ..sinks.png import to_png, write_files
from ..sources import pictures, png, tables
from . import query
from . import sqltext as q

KEYS = ["video", "frame"]
SEED = 7


def _pixels(df, plane="out", width=None, digits=8):
    """Rows of one pixel from a plane column."""
    spread = df.select(*KEYS, *([width] if width else []), F.posexplode(plane).alias("i", "v"))
    across = F.col(width) if width else F.lit(8)
    return spread.select(
        *KEYS,
        F.floor(F.col("i") / across).cast("bigint").alias("y"),
        (F.col("i") % across).cast("bigint").alias("x"),
        round_to(F.col("v"), digits).alias("value"),
    )


def _hw(df):
    return F.col("height"), F.col("width")


# ------------------------------------------------------------- similarity
_OFF = np.arange(11) - 5
_G = np.exp(-(_OFF**2) / 4.5)
_G = _G / _G.sum()
_TAPS = "g(d, w) AS (VALUES " + ", ".join(f"({i - 5},{q.d(w)})" for i, w in enumerate(_G)) + ")"
_UNIT = lambda code: f"{q.pu21(q.code_nits(code))}/{q.d(q.PEAK)}"


@query(
    "pu21_ssim",
    q.rows(
        q.PLANES,
        _TAPS,
        f"u AS (SELECT video, frame, y, x, {_UNIT('(code*9e-1+2e-2)')} AS p, {_UNIT('code')} AS t FROM planes)",
        "b AS (SELECT a.video, a.frame, a.y, a.x, sum(gx.w*gy.w*n.p) AS mp, sum(gx.w*gy.w*n.t) AS mt,"
        " sum(gx.w*gy.w*n.p*n.p) AS pp, sum(gx.w*gy.w*n.t*n.t) AS tt, sum(gx.w*gy.w*n.p*n.t) AS pt"
        " FROM u a JOIN u n USING (video, frame) JOIN g gx ON gx.d = n.x-a.x JOIN g gy ON gy.d = n.y-a.y GROUP BY ALL)",
        "s AS (SELECT *, (2*mp*mt+1e-4)*(2*(pt-mp*mt)+9e-4)/((mp*mp+mt*mt+1e-4)*(pp-mp*mp+tt-mt*mt+9e-4)) AS s FROM b)",
        select="SELECT video, frame, round(avg(s),8) AS ssim FROM s GROUP BY ALL",
    ),
)
def pu21_ssim(spark, folder):
    df = tables.frames(spark, folder)
    dimmed = F.transform("plane", lambda c: c * num(0.9) + num(0.02))
    score = fr.ssim_of_codes(dimmed, F.col("plane"), *_hw(df))
    return df.select(*KEYS, round_to(score, 8).alias("ssim"))


# ------------------------------------------------------------- gradients and maps
def _sobel(source="planes", value="code"):
    at = lambda dy, dx: f"least(greatest(a.y+({dy}),0),7)*8+least(greatest(a.x+({dx}),0),7)+1"
    px = lambda dy, dx: f"f.l[{at(dy, dx)}]"
    gx = f"({px(-1, 1)}+2*{px(0, 1)}+{px(1, 1)}-{px(-1, -1)}-2*{px(0, -1)}-{px(1, -1)})/4"
    gy = f"({px(1, -1)}+2*{px(1, 0)}+{px(1, 1)}-{px(-1, -1)}-2*{px(-1, 0)}-{px(-1, 1)})/4"
    return (
        f"f AS (SELECT video, frame, list({value} ORDER BY y*8+x) AS l FROM {source} GROUP BY ALL),"
        f"sob AS (SELECT a.*, ln(1e0+sqrt(pow({gx},2)+pow({gy},2)+1e-12)) AS grad FROM {source} a JOIN f USING (video, frame))"
    )


@query("log_gradient", q.rows(q.PLANES, _sobel(), select="SELECT video, frame, y, x, round(grad,8) AS value FROM sob"))
def log_gradient(spark, folder):
    df = tables.frames(spark, folder)
    return _pixels(df.select(*KEYS, fr.log_gradient("plane", *_hw(df)).alias("out")))


_G2, _B2 = "(code*8e-1+1e-1)", "(1e0-code)"


@query(
    "physical_maps",
    q.rows(
        q.PLANES,
        f"c AS (SELECT video, frame, y, x, {q.dot(q.Y2020, ['code', _G2, _B2])} AS lum,"
        f" (greatest(code,{_G2},{_B2})-least(code,{_G2},{_B2}))/(greatest(code,{_G2},{_B2})+1e-6) AS sat FROM planes)",
        _sobel("c", "lum"),
        select="SELECT video, frame, y, x, round(lum,8) AS luminance, round(grad,8) AS gradient,"
        " round(sat,8) AS saturation FROM sob",
    ),
)
def physical_maps(spark, folder):
    """Luminance, its log gradient and saturation of a coloured copy of every plane."""
    df = tables.frames(spark, folder).withColumns(
        {
            "g": F.transform("plane", lambda c: c * num(0.8) + num(0.1)),
            "b": F.transform("plane", lambda c: num(1) - c),
        }
    )
    maps = fr.physical_maps(df, ("plane", "g", "b"))
    pixels = fr.to_pixels(
        maps, KEYS, {"luminance": "luminance", "gradient": "gradient", "saturation": "saturation"}
    )
    return pixels.select(
        *KEYS,
        F.col("y").cast("bigint").alias("y"),
        F.col("x").cast("bigint").alias("x"),
        *(round_to(F.col(n), 8).alias(n) for n in ("luminance", "gradient", "saturation")),
    )


_FREQ = [
    (v, u, int(min(np.hypot(min(v, 8 - v) / 8, u / 8) / np.hypot(0.5, 0.5), 1 - 1e-6) * 8))
    for v in range(8)
    for u in range(5)
]


@query(
    "spectral_bands",
    q.rows(
        q.PLANES,
        "fr(v, u, band) AS (VALUES " + ", ".join(f"({v},{u},{b})" for v, u, b in _FREQ) + ")",
        "c AS (SELECT video, frame, v, u, band, sum(code*cos(2*pi()*(v*y+u*x)/8))/8 AS re,"
        " sum(code*sin(2*pi()*(v*y+u*x)/8))/8 AS im FROM planes, fr GROUP BY ALL)",
        select="SELECT video, frame, band::BIGINT AS band, round(ln(1e0+avg(re*re+im*im)),8) AS energy FROM c GROUP BY ALL",
    ),
)
def spectral_bands(spark, folder):
    df = tables.frames(spark, folder)
    bands = df.select(
        *KEYS, F.posexplode(fr.spectral_bands(8)("plane", *_hw(df))).alias("band", "energy")
    )
    return bands.select(
        *KEYS, F.col("band").cast("bigint").alias("band"), round_to(F.col("energy"), 8).alias("energy")
    )


# ------------------------------------------------------------- geometry
def _axis(count, wanted):
    rows = []
    for i in range(wanted):
        place = max((i + 0.5) * count / wanted - 0.5, 0)
        low = min(int(place), count - 1)
        rows.append(f"({i},{low},{q.d(1 - (place - low))})")
        rows.append(f"({i},{min(low + 1, count - 1)},{q.d(place - low)})")
    return ", ".join(rows)


@query(
    "bilinear_resize",
    q.rows(
        q.PLANES,
        f"ry(o, i, w) AS (VALUES {_axis(8, 5)})",
        f"rx(o, i, w) AS (VALUES {_axis(8, 11)})",
        select="SELECT video, frame, ry.o::BIGINT AS y, rx.o::BIGINT AS x, round(sum(code*ry.w*rx.w),8) AS value"
        " FROM planes p JOIN ry ON ry.i = p.y JOIN rx ON rx.i = p.x GROUP BY ALL",
    ),
)
def bilinear_resize(spark, folder):
    df = tables.frames(spark, folder)
    resized = fr.bilinear(F.col("plane"), *_hw(df), F.lit(5), F.lit(11))
    return _pixels(df.select(*KEYS, F.lit(11).alias("w"), resized.alias("out")), width="w")


@query(
    "grid_pool",
    q.rows(
        q.PLANES,
        "cell AS (SELECT i, floor(i*8/3e0) AS lo, ceil((i+1)*8/3e0) AS hi FROM range(3) r(i))",
        select="SELECT video, frame, cy.i AS y, cx.i AS x, round(avg(code),8) AS value FROM planes p"
        " JOIN cell cy ON p.y >= cy.lo AND p.y < cy.hi JOIN cell cx ON p.x >= cx.lo AND p.x < cx.hi GROUP BY ALL",
    ),
)
def grid_pool(spark, folder):
    df = tables.frames(spark, folder)
    pooled = fr.grid_pool(F.col("plane"), *_hw(df), F.lit(3), F.lit(3))
    return _pixels(df.select(*KEYS, F.lit(3).alias("w"), pooled.alias("out")), width="w")


def _ticket_sql(tag):
    text = f"'{SEED}:{tag}:'||video||':'||frame"
    return f"('0x'||substring(sha256({text}),1,12))::BIGINT"


def _ticket(tag):
    return draws.ticket(f"{SEED}:{tag}", F.col("video"), F.col("frame"))


def _crop_sql(size):
    return (
        f"SELECT {size}::BIGINT AS size, o.video, o.frame, oy.y, ox.x, round(p.code,8) AS value FROM"
        f" (SELECT DISTINCT video, frame, {_ticket_sql('top')} % (greatest(0,8-{size})+1) AS t,"
        f" {_ticket_sql('left')} % (greatest(0,8-{size})+1) AS l FROM planes) o,"
        f" range({size}) oy(y), range({size}) ox(x) JOIN planes p ON p.video=o.video AND p.frame=o.frame"
        " AND p.y=least(o.t+oy.y,7) AND p.x=least(o.l+ox.x,7)"
    )


@query("crop_pad", q.rows(q.PLANES, select=_crop_sql(6) + " UNION ALL " + _crop_sql(10)))
def crop_pad(spark, folder):
    """Seeded square cuts: one smaller than the frame, one that needs its edge repeated."""
    df = tables.frames(spark, folder)
    parts = []
    for size in (6, 10):
        top = fr.crop_offset(_ticket("top"), F.col("height"), size)
        left = fr.crop_offset(_ticket("left"), F.col("width"), size)
        cut = df.withColumns({"t": top, "l": left}).select(
            *KEYS,
            F.lit(size).alias("w"),
            fr.crop(F.col("plane"), *_hw(df), F.col("t"), F.col("l"), size).alias("out"),
        )
        parts.append(_pixels(cut, width="w").withColumn("size", F.lit(size).cast("bigint")))
    return parts[0].unionByName(parts[1])


@query(
    "flip",
    q.rows(
        q.PLANES,
        f"c AS (SELECT *, {_ticket_sql('flip')}/{float(2**48)!r}::DOUBLE < 5e-1 AS flipped FROM planes)",
        select="SELECT video, frame, y::BIGINT AS y, (CASE WHEN flipped THEN 7-x ELSE x END)::BIGINT AS x,"
        " round(code,8) AS value, flipped FROM c",
    ),
)
def flip(spark, folder):
    df = tables.frames(spark, folder).withColumn(
        "flipped", draws.uniform(_ticket("flip")) < num(0.5)
    )
    turned = F.when(F.col("flipped"), fr.mirrored(F.col("plane"), *_hw(df))).otherwise(F.col("plane"))
    coins = df.select(*KEYS, "flipped", F.posexplode(turned).alias("i", "v"))
    return coins.select(
        *KEYS,
        F.floor(F.col("i") / 8).cast("bigint").alias("y"),
        (F.col("i") % 8).cast("bigint").alias("x"),
        round_to(F.col("v"), 8).alias("value"),
        "flipped",
    )


@query(
    "pad_multiple",
    q.rows(
        q.PLANES,
        select="SELECT o.video, o.frame, oy.y, ox.x, round(p.code,8) AS value FROM"
        " (SELECT DISTINCT video, frame FROM planes) o, range(12) oy(y), range(12) ox(x)"
        " JOIN planes p ON p.video=o.video AND p.frame=o.frame AND p.y=least(oy.y,7) AND p.x=least(ox.x,7)",
    ),
)
def pad_multiple(spark, folder):
    """Every frame grown to a multiple of six on both sides."""
    df = tables.frames(spark, folder)
    grown = df.select(
        *KEYS,
        fr.padded_size(F.col("width"), 6).alias("w"),
        fr.pad_to_multiple(F.col("plane"), *_hw(df), 6).alias("out"),
    )
    return _pixels(grown, width="w")


@query(
    "patch_pack",
    q.rows(
        q.PLANES,
        select="SELECT video, frame, ((y//2)*4+x//2)::BIGINT AS patch, ((y%2)*2+x%2)::BIGINT AS slot,"
        " round(code,8) AS value, (y//2)::BIGINT AS patch_y, (x//2)::BIGINT AS patch_x FROM planes",
    ),
)
def patch_pack(spark, folder):
    df = tables.frames(spark, folder)
    packed = df.select(
        *KEYS, F.posexplode(fr.patches([F.col("plane")], *_hw(df))).alias("patch", "vector")
    )
    slots = packed.select(*KEYS, "patch", F.posexplode("vector").alias("slot", "value"))
    return slots.select(
        *KEYS,
        F.col("patch").cast("bigint").alias("patch"),
        F.col("slot").cast("bigint").alias("slot"),
        round_to(F.col("value"), 8).alias("value"),
        F.floor(F.col("patch") / 4).cast("bigint").alias("patch_y"),
        (F.col("patch") % 4).cast("bigint").alias("patch_x"),
    )


# ------------------------------------------------------------- codec loss
_COS = ", ".join(
    f"({u},{x},{q.d(c)})"
    for u, row in enumerate(codec.BASIS)
    for x, c in enumerate(row)
)
_QUALITY = ((23, 75), (31, 45), (39, 20))
_TABLES = ", ".join(
    f"({crf},{v},{u},{int(n)})"
    for crf, quality in _QUALITY
    for v, row in enumerate(codec.table_at(codec.LUMA_TABLE, quality))
    for u, n in enumerate(row)
)


@query(
    "codec_loss",
    q.rows(
        q.PLANES,
        f"cs(u, x, c) AS (VALUES {_COS})",
        f"qt(crf, v, u, n) AS (VALUES {_TABLES})",
        "codes AS (SELECT video, frame, y, x, round_even(code*255e0,0) AS k FROM planes)",
        "dct AS (SELECT video, frame, cv.u AS v, cu.u AS u, sum((k-128)*cv.c*cu.c) AS f FROM codes"
        " JOIN cs cv ON cv.x = codes.y JOIN cs cu ON cu.x = codes.x GROUP BY ALL)",
        "qz AS (SELECT video, frame, crf, v, u, round_even(round(f/n,9),0)*n AS f FROM dct JOIN qt USING (v, u))",
        select="SELECT video, frame, crf, cv.x::BIGINT AS y, cu.x::BIGINT AS x,"
        " least(greatest(round_even(round(sum(f*cv.c*cu.c)+128,9),0),0),255)::INTEGER AS code FROM qz"
        " JOIN cs cv ON cv.u = qz.v JOIN cs cu ON cu.u = qz.u GROUP BY ALL",
    ),
)
def codec_loss(spark, folder):
    """Gray frames through the block transform at the three rate factors of the grid."""
    df = tables.frames(spark, folder)
    gray = F.transform("plane", lambda c: codes.quantise(c, codes.SDR_CODES))
    frames = df.select(
        *KEYS,
        *_hw(df),
        F.explode(F.array(*(F.lit(level) for level in codes.CRF_LEVELS))).alias("crf"),
        *(gray.alias(c) for c in "rgb"),
    )
    lost = codec.codec_loss(frames)
    spread = lost.select(*KEYS, "crf", F.posexplode("r").alias("i", "code"))
    return spread.select(
        *KEYS,
        "crf",
        F.floor(F.col("i") / 8).cast("bigint").alias("y"),
        (F.col("i") % 8).cast("bigint").alias("x"),
        "code",
    )




@query(
    "png_round_trip",
    q.rows(
        q.PLANES,
        select="SELECT video, frame, d.depth, y::BIGINT AS y, x::BIGINT AS x,"
        + ",".join(
            f" round_even(({v})*(CASE WHEN d.depth=16 THEN 65535e0 ELSE 255e0 END), 0)::BIGINT AS {c}"
            for c, v in zip("rgb", ("code", "1e0-code", "code*5e-1"))
        )
        + ", CASE WHEN d.depth=16 THEN '09100001' END AS tag FROM planes, (VALUES (8),(16)) AS d(depth)",
    ),
)
def png_round_trip(spark, folder):
    """Frames as PNG files of 8 and 16 bits in the shared folder, and their codes read back."""
    planes = tables.frames(spark, folder)
    colours = {"r": F.col("plane"), "g": F.transform("plane", lambda v: 1 - v), "b": F.transform("plane", lambda v: v * 0.5)}
    named = planes.withColumns(colours | {"name": F.concat_ws("_", "video", "frame")})
    named = named.withColumn("name", F.concat("name", F.lit(".png")))
    place = f"{shared_dir(spark)}/pictures-{uuid.uuid4().hex}"
    parts = []
    for depth in (8, 16):
        written = write_files(to_png(named, depth, depth == 16), f"{place}/{depth}")
        written.write.format("noop").mode("overwrite").save()
        names = planes.select(*KEYS, F.concat(F.lit(f"{place}/{depth}/"), F.concat_ws("_", *KEYS), F.lit(".png")).alias("path"))
        found = png.decode_named(names, {"": "path"}, depth)
        spread = found.select(*KEYS, "depth", "path", F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "c"))
        tags = spread.select(
            *KEYS, "depth", F.floor(F.col("i") / 8).cast("bigint").alias("y"), (F.col("i") % 8).cast("bigint").alias("x"),
            *(F.col(f"c.{c}").cast("bigint").alias(c) for c in "rgb"),
        )
        parts.append(tags.join(_tags(names), KEYS))
    return parts[0].unionByName(parts[1])


def _tags(names):
    """The colour tag of every named picture, as hexadecimal digits; null without one."""

    def run(batches):
        for batch in batches:
            found = [png.decode_png(png.read_bytes(path))[1].get("cICP") for path in batch["path"]]
            yield batch[KEYS].assign(tag=[None if t is None else t.hex() for t in found])

    return names.mapInPandas(run, "video bigint, frame bigint, tag string")


def _written(spark, folder, depth, name):
    """Frames as pictures of a folder, through the data source; the folder."""
    pictures.register(spark)
    planes = tables.frames(spark, folder)
    colours = {"r": F.col("plane"), "g": F.transform("plane", lambda v: 1 - v), "b": F.transform("plane", lambda v: v * 0.5)}
    named = planes.withColumns(colours | {"name": F.concat("video", F.lit("/"), "frame", F.lit(".png"))})
    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}/{depth}"
    writer = named.select("name", "height", "width", "r", "g", "b").write.format(pictures.FORMAT)
    writer.mode("append").option("depth", depth).save(place)
    return place


def _named(path):
    """The video and the frame that the path of a picture names."""
    parts = F.split(F.regexp_extract(path, r"([^/]+/[^/]+)[.]png$", 1), "/")
    return [parts[0].cast("bigint").alias("video"), parts[1].cast("bigint").alias("frame")]


def _codes(found):
    """Pixels of 8 by 8 pictures."""
    spread = found.select("*", F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "c"))
    return spread.withColumns(
        {"y": F.floor(F.col("i") / 8).cast("bigint"), "x": (F.col("i") % 8).cast("bigint")}
        | {c: F.col(f"c.{c}").cast("bigint") for c in "rgb"}
    )


@query(
    "picture_source",
    q.rows(
        q.PLANES,
        select="SELECT video, frame, d.depth, y::BIGINT AS y, x::BIGINT AS x,"
        + ",".join(
            f" round_even(({v})*(CASE WHEN d.depth=16 THEN 65535e0 ELSE 255e0 END), 0)::BIGINT AS {c}"
            for c, v in zip("rgb", ("code", "1e0-code", "code*5e-1"))
        )
        + ", CASE WHEN d.depth=16 THEN '09100001' END AS tag FROM planes, (VALUES (8),(16)) AS d(depth)",
    ),
)
def picture_source(spark, folder):
    """Frames of 8 and 16 bits written and read by the data source, all pixels."""
    parts = []
    for depth in (8, 16):
        found = spark.read.format(pictures.FORMAT).load(_written(spark, folder, depth, "source"))
        parts.append(_codes(found).select(*_named(F.col("path")), "depth", "y", "x", "r", "g", "b", "tag"))
    return parts[0].unionByName(parts[1])


@query(
    "picture_headers",
    q.rows(
        q.PLANES,
        select="SELECT video, frame, max(y)::INTEGER + 1 AS height, max(x)::INTEGER + 1 AS width, 8 AS depth, 2 AS colour FROM planes"
        " WHERE video % 2 = 0 GROUP BY video, frame",
    ),
)
def picture_headers(spark, folder):
    """What the headers say of the pictures of every other video; no plane is read."""
    reader = spark.read.format(pictures.FORMAT).schema("path string, height int, width int, depth int, colour int")
    found = reader.load(_written(spark, folder, 8, "headers")).where("depth = 8 AND height >= 8")
    named = found.select(*_named(F.col("path")), "height", "width", "depth", "colour")
    return named.where("video % 2 = 0")
