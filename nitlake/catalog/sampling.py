"""Training draws, batches, smoothing and bridges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, draws
from ..functions.common import num, round_to
from ..operators import frames as fr, sampling
from ..operators.scan import smooth
from ..sources import tables
from . import query
from . import sqltext as q

SEED, EPOCH, BATCH = 11, 3, 16
_48 = f"{float(2**48)!r}::DOUBLE"


def _hash(*parts):
    text = "||':'||".join(parts)
    return f"('0x'||substring(sha256({text}),1,12))::BIGINT"


@query(
    "balanced_draw",
    q.rows(
        q.CORPUS,
        "n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) - 1 AS place FROM corpus)",
        "c AS (SELECT category, count(*) AS size, row_number() OVER (ORDER BY category) - 1 AS rank FROM corpus GROUP BY 1)",
        "k AS (SELECT count(*) AS k FROM c)",
        f"d AS (SELECT draw, {_hash(f"'{SEED}:category'", 'draw')} % k AS rank FROM"
        " (SELECT unnest(range((SELECT count(*) FROM corpus))) AS draw), k)",
        f"e AS (SELECT draw, category, {_hash(f"'{SEED}:record'", 'draw')} % size AS place FROM d JOIN c USING (rank))",
        select="SELECT draw, category, doc_id,"
        f" (['bt2446a','expert','reinhard'])[{_hash(f"'{SEED}:variant'", 'draw')} % 3 + 1] AS variant"
        " FROM e JOIN n USING (category, place)",
    ),
)
def balanced_draw(spark, folder):
    """Languages drawn equally often, then one of three variants of the drawn record."""
    corpus = tables.corpus(spark, folder).select("doc_id", "category")
    block = F.floor(F.col("doc_id") / 2**20)
    drawn = sampling.balanced_draw(corpus, "category", "doc_id", SEED, [block])
    variants = F.create_map(
        *(F.lit(t) for t in ("reinhard", "r.png", "expert", "e.png", "bt2446a", "b.png"))
    )
    ticket = draws.ticket(f"{SEED}:variant", F.col("draw"))
    return drawn.select(
        "draw", "category", "doc_id", sampling.drawn_key(variants, ticket).alias("variant")
    )


_EPOCH = [q.CORPUS, q.epoch("corpus", "doc_id", SEED, EPOCH, BATCH)]


def _epoch(spark, folder):
    corpus = tables.corpus(spark, folder).select("doc_id", "category", "video", "bytes")
    return sampling.epoch_batches(corpus, ["doc_id"], SEED, EPOCH, BATCH)


@query("epoch_batches", q.rows(*_EPOCH, select="SELECT doc_id, video, batch_id, place FROM placed", recursive=True))
def epoch_batches(spark, folder):
    return _epoch(spark, folder).select("doc_id", "video", "batch_id", "place")


@query(
    "collate_batch",
    q.rows(
        *_EPOCH,
        "c AS (SELECT batch_id, place, video, (bytes % 256)/255e0 AS sdr FROM placed)",
        select="SELECT batch_id, count(*) AS size, string_agg(video, ',' ORDER BY place) AS videos,"
        " round(sum(sdr),6) AS sdr_sum, round(arg_min(sdr, place),8) AS sdr_first FROM c GROUP BY batch_id",
        recursive=True,
    ),
)
def collate_batch(spark, folder):
    """Batches as lists in batch order, codes scaled to [0, 1]."""
    # Rounded after the sum only: a sum of rounded numbers may lie on a tie, which the order of addition decides.
    scaled = _epoch(spark, folder).withColumn("sdr", codes.scale(F.col("bytes") % 256, codes.SDR_CODES))
    lists = sampling.collate(scaled, ["video", "sdr"])
    return lists.select(
        "batch_id",
        F.size("video").cast("bigint").alias("size"),
        F.array_join("video", ",").alias("videos"),
        round_to(F.aggregate("sdr", num(0), lambda a, x: a + x), 6).alias("sdr_sum"),
        round_to(F.get("sdr", F.lit(0)), 8).alias("sdr_first"),
    )


def _normal(channel):
    one, other = (_hash(f"'{SEED}:{channel}:{s}'", "video", "y", "x") for s in "ab")
    return f"sqrt(-2e0*ln(({one}+1)/{_48}))*cos(2e0*pi()*({other}/{_48}))"


@query(
    "shared_noise",
    q.rows(
        q.PLANES,
        select="SELECT video, frame, y::INTEGER AS y, x::INTEGER AS x, "
        + ", ".join(f"round({_normal(c)},6) AS noise_{c}" for c in "rgb")
        + " FROM planes",
    ),
)
def shared_noise(spark, folder):
    pixels = fr.to_pixels(tables.frames(spark, folder), ["video", "frame"], {"code": "plane"})
    noisy = sampling.shared_noise(pixels, SEED)
    return noisy.select(
        "video",
        "frame",
        "y",
        "x",
        *(round_to(F.col(f"noise_{c}"), 6).alias(f"noise_{c}") for c in "rgb"),
    )


@query(
    "bridge_pairs",
    q.rows(
        q.FEAT,
        "p AS (SELECT vec_id, label/1e1 AS t, s1[i+1] AS h, s2[i+1]+2.5e-1*s1[32-i] AS st, i FROM feat, range(32) r(i))",
        select="SELECT vec_id, i, round((1e0-t)*h+t*st,8) AS z_t, round(st-h,8) AS target FROM p",
    ),
)
def bridge_pairs(spark, folder):
    feats = tables.features(spark, folder).withColumns(
        {"t": F.col("label") / num(10), "eps": F.reverse("s1")}
    )
    pairs = sampling.bridge_pairs(feats, "s1", "s2", "eps", "t", 0.25)
    zipped = F.arrays_zip("z_t", "target")
    spread = pairs.select("vec_id", F.posexplode(zipped).alias("i", "p"))
    return spread.select(
        "vec_id",
        F.col("i").cast("bigint").alias("i"),
        round_to(F.col("p.z_t"), 8).alias("z_t"),
        round_to(F.col("p.target"), 8).alias("target"),
    )


EMA_SQL = q.rows(
    q.SIG,
    "u AS (SELECT video, frame, nits*(CASE WHEN frame = 0 THEN 1e0 ELSE 2e-1 END) AS u FROM sig)",
    select="SELECT a.video, a.frame, round(sum(b.u*pow(8e-1,a.frame-b.frame)),5) AS applied"
    " FROM u a JOIN u b ON b.video = a.video AND b.frame <= a.frame GROUP BY ALL",
)


@query("tone_ema", EMA_SQL)
def tone_ema(spark, folder):
    """Tone parameters of long sequences, smoothed along each of them."""
    sig = tables.numbered_signal(spark, folder).select("video", "frame", "nits")
    smoothed = smooth(sig, ["video"], "frame", ["nits"], 0.8)
    return smoothed.select("video", "frame", round_to(F.col("nits"), 5).alias("applied"))
