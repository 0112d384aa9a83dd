"""Sources, joins, grids, packing and manifests over the catalogue tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import pack, pair, select
from ..operators.numbering import every_nth, first_rows, number_rows
from ..session import shared_dir
from ..sinks.manifest import json_line, write_manifest
from ..sources import files, manifest, tables
from . import query
from . import sqltext as q

SUFFIXES = (".MP4", ".mov", ".mkv", ".webm", ".y4m", ".png", ".TIF", ".tiff", ".exr", ".txt")
_HASH = "substring(sha256({0}||':'||{1}),1,32)"
_STRIP = r"regexp_replace(url, '^https?://|[?#].*$', '', 'g')"
_ENDING = "CASE page_id % 10 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES)) + " END"
_PATHS = f"""paths AS (SELECT page_id, rtrim({_STRIP},'/')||{_ENDING} AS relative FROM pages),
parts AS (SELECT *, regexp_replace(relative,'/?[^/]*$','') AS parent,
 regexp_extract(relative,'[^/]*$') AS name FROM paths),
kinds AS (SELECT *, lower(regexp_extract(name,'[^.].*?(\\.[^.]+)$',1)) AS ending FROM parts),
found AS (SELECT *, CASE WHEN ending IN ('.mp4','.mov','.mkv','.webm','.y4m') THEN 'video' ELSE 'image' END AS kind
 FROM kinds WHERE ending IN ('.mp4','.mov','.mkv','.webm','.y4m','.png','.tif','.tiff','.exr'))"""


def _paths(spark, folder):
    ending = F.when(F.col("page_id") % 10 == 0, SUFFIXES[0])
    for index, text in enumerate(SUFFIXES[1:], 1):
        ending = ending.when(F.col("page_id") % 10 == index, text)
    bare = F.regexp_replace("url", r"^https?://|[?#].*$", "")
    return tables.table(spark, folder, "pages").select(
        "page_id", F.concat(F.rtrim(bare, F.lit("/")), ending).alias("relative")
    )


@query(
    "discover_paths",
    f"""WITH {_PATHS},
held AS (SELECT *, CASE WHEN kind='video' THEN relative ELSE parent END AS holder FROM found),
stems AS (SELECT *, lower(regexp_extract(regexp_extract(holder,'[^/]*$'),'^(.[^.]*.*?)(\\.[^.]+)?$',1)) AS stem FROM held)
SELECT page_id, relative, kind, parent,
 CASE WHEN regexp_matches(stem,'^[0-9a-f]{{16,}}$') THEN stem
 ELSE {_HASH.format("'web'", "holder")} END AS video FROM stems""",
)
def discover_paths(spark, folder):
    found = files.discover(_paths(spark, folder), F.lit("web"))
    return found.select("page_id", "relative", "kind", "parent", "video")


@query(
    "frame_sequences",
    f"""WITH {_PATHS}
SELECT parent, relative, row_number() OVER (PARTITION BY parent ORDER BY relative) - 1 AS frame
FROM found WHERE kind='image'""",
)
def frame_sequences(spark, folder):
    found = files.discover(_paths(spark, folder), F.lit("web")).where(F.col("kind") == "image")
    return files.sequences(found.select("parent", "relative"))


@query(
    "stable_hash",
    """WITH names AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0
 THEN 'Dir.v1/'||upper(md5(doc_id::VARCHAR))||'.mkv' ELSE lang||'/'||doc_id||'.tar.gz' END AS relative FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(doc_id::VARCHAR)
 ELSE substring(sha256(source||':'||relative),1,32) END AS video FROM names""",
)
def stable_hash(spark, folder):
    name = F.when(
        F.col("doc_id") % 3 == 0,
        F.concat(F.lit("Dir.v1/"), F.upper(F.md5(F.col("doc_id").cast("string"))), F.lit(".mkv")),
    ).otherwise(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".tar.gz")))
    df = tables.table(spark, folder, "documents").select("doc_id", "source", "lang")
    return df.select("doc_id", labels.stable_hash(F.col("source"), name).alias("video"))


_LISTED = """listed AS (SELECT video, quality, toxic FROM corpus JOIN labels USING (doc_id))"""


def _listed(spark, folder):
    lab = tables.table(spark, folder, "labels")
    return tables.corpus(spark, folder).join(lab, "doc_id").select("video", "quality", "toxic")


@query(
    "reference_hashes",
    q.rows(
        q.CORPUS,
        _LISTED,
        select="SELECT DISTINCT 'matched' AS list, video FROM listed WHERE quality = 1"
        " UNION ALL SELECT DISTINCT 'fallback', video FROM listed",
    ),
)
def reference_hashes(spark, folder):
    rows = _listed(spark, folder).select(
        F.concat(F.lit(" "), "video", F.lit("  ")).alias("Video"),
        F.col("quality").cast("string").alias("ref"),
    )
    matched = select.reference_list(rows, "Video", "ref", "1")
    fallback = select.reference_list(rows, "Video", "ref", "no such value")
    return matched.select(F.lit("matched").alias("list"), "video").unionByName(
        fallback.select(F.lit("fallback").alias("list"), "video")
    )


@query(
    "allowed_semi",
    q.rows(
        q.CORPUS,
        _LISTED,
        select="SELECT doc_id, video FROM corpus WHERE video IN (SELECT video FROM listed WHERE quality=1)",
    ),
)
def allowed_semi(spark, folder):
    allowed = _listed(spark, folder).where("quality = 1")
    return select.allowed_only(tables.corpus(spark, folder), allowed).select("doc_id", "video")


@query(
    "include_intersect",
    q.rows(
        q.CORPUS,
        _LISTED,
        select="SELECT doc_id, video FROM corpus WHERE video IN (SELECT video FROM listed WHERE quality=1"
        " INTERSECT SELECT video FROM corpus WHERE category='en')",
    ),
)
def include_intersect(spark, folder):
    corpus = tables.corpus(spark, folder)
    allowed = _listed(spark, folder).where("quality = 1")
    both = select.both_lists(allowed, corpus.where("category = 'en'"))
    return select.allowed_only(corpus, both).select("doc_id", "video")


@query(
    "exclude_anti",
    q.rows(
        q.CORPUS,
        _LISTED,
        select="SELECT doc_id, video FROM corpus WHERE video NOT IN (SELECT video FROM listed WHERE toxic=1)",
    ),
)
def exclude_anti(spark, folder):
    excluded = _listed(spark, folder).where("toxic = 1")
    return select.without(tables.corpus(spark, folder), excluded).select("doc_id", "video")


@query(
    "resume_anti",
    q.rows(
        q.CORPUS,
        _LISTED,
        select="SELECT doc_id, source_dataset, video FROM corpus"
        " WHERE video NOT IN (SELECT video FROM listed)",
    ),
)
def resume_anti(spark, folder):
    """Videos that no record of an earlier run mentions, whatever its variants."""
    done = _listed(spark, folder)
    fresh = select.without(tables.corpus(spark, folder), done)
    return fresh.select("doc_id", "source_dataset", "video")


HELD, SEED = 5, 260402787


@query(
    "holdout_split",
    q.rows(
        q.CORPUS,
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY"
        f" sha256('{SEED}:'||source_dataset||':'||video||':'), video) AS r FROM corpus)",
        select=f"SELECT doc_id, source_dataset, video, CASE WHEN r <= {HELD} THEN 'holdout' ELSE 'train' END"
        " AS split FROM ranked",
    ),
)
def holdout_split(spark, folder):
    corpus = tables.corpus(spark, folder)
    kept = select.hold_out(corpus, "source_dataset", "video", HELD, SEED)
    held = select.drawn(corpus, "source_dataset", "video", HELD, SEED)
    out = corpus.join(held, ["source_dataset", "video"], "left_semi")
    columns = ("doc_id", "source_dataset", "video")
    return kept.select(*columns, F.lit("train").alias("split")).unionByName(
        out.select(*columns, F.lit("holdout").alias("split"))
    )


_SIDES = """hdr AS (SELECT doc_id||'.png' AS relative, source AS source_dataset, n_chars AS bytes FROM documents),
sdr AS (SELECT doc_id||'.png' AS relative, quality FROM labels
 UNION ALL SELECT 'extra/'||item_id||'.png', NULL FROM benchmark)"""


def _sides(spark, folder):
    name = lambda column: F.concat(F.col(column).cast("string"), F.lit(".png"))
    hdr = tables.table(spark, folder, "documents").select(
        name("doc_id").alias("relative"),
        F.col("source").alias("source_dataset"),
        F.col("n_chars").alias("bytes"),
    )
    sdr = tables.table(spark, folder, "labels").select(name("doc_id").alias("relative"), "quality")
    extra = tables.table(spark, folder, "benchmark").select(
        F.concat(F.lit("extra/"), name("item_id")).alias("relative"),
        F.lit(None).cast("int").alias("quality"),
    )
    return hdr, sdr.unionByName(extra)


@query(
    "native_pairs",
    f"WITH {_SIDES} SELECT relative, source_dataset, bytes, quality FROM hdr JOIN sdr USING (relative)",
)
def native_pairs(spark, folder):
    hdr, sdr = _sides(spark, folder)
    return pair.native_pairs(hdr, sdr).select("relative", "source_dataset", "bytes", "quality")


@query(
    "native_pair_mismatch",
    f"WITH {_SIDES} SELECT relative, 'sdr' AS missing FROM hdr ANTI JOIN sdr USING (relative)"
    " UNION ALL SELECT relative, 'hdr' FROM sdr ANTI JOIN hdr USING (relative)",
)
def native_pair_mismatch(spark, folder):
    return pair.native_mismatch(*_sides(spark, folder))


@query(
    "native_max_pairs",
    f"""WITH {_SIDES}, pairs AS (SELECT * FROM hdr JOIN sdr USING (relative)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY
 sha256('{SEED}:'||source_dataset||':'||relative||':native_pairs'), relative) AS r FROM pairs)
SELECT source_dataset, relative FROM ranked WHERE r <= 7""",
)
def native_max_pairs(spark, folder):
    pairs = pair.native_pairs(*_sides(spark, folder))
    return select.drawn(pairs, "source_dataset", "relative", 7, SEED, "native_pairs")


@query(
    "expert_match",
    """WITH f AS (SELECT doc_id, lang||'/'||source||'/'||doc_id||'.png' AS relative, doc_id||'.png' AS name FROM documents),
e AS (SELECT CASE WHEN toxic=0 THEN lang||'/'||source||'/'||doc_id||'.png' ELSE doc_id||'.png' END AS rel,
 'expert/'||doc_id AS expert FROM documents JOIN labels USING (doc_id) WHERE quality=1)
SELECT doc_id, relative, coalesce(e1.expert, e2.expert) AS expert FROM f
 LEFT JOIN e e1 ON e1.rel = f.relative LEFT JOIN e e2 ON e2.rel = f.name""",
)
def expert_match(spark, folder):
    doc = tables.table(spark, folder, "documents").select("doc_id", "lang", "source")
    number = F.concat(F.col("doc_id").cast("string"), F.lit(".png"))
    full = F.concat_ws("/", "lang", "source", number)
    graded = doc.join(tables.table(spark, folder, "labels").where("quality = 1"), "doc_id")
    experts = graded.select(
        F.when(F.col("toxic") == 0, full).otherwise(number).alias("relative"),
        F.concat(F.lit("expert/"), F.col("doc_id").cast("string")).alias("expert"),
    )
    return pair.expert_match(doc.select("doc_id", full.alias("relative")), experts)


@query(
    "expert_offset_join",
    q.rows(
        q.TURNS,
        "e AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY frame) - 1 AS n,"
        " CASE WHEN length(text) % 5 <> 0 THEN text END AS expert FROM turns WHERE role='assistant')",
        select="SELECT t.video, t.frame, t.text, e.expert FROM turns t JOIN e"
        " ON e.video = t.video AND e.n + 1 = t.frame WHERE e.expert IS NOT NULL",
    ),
)
def expert_offset_join(spark, folder):
    """Expert turns by position, one later; empty slots hold their place."""
    turns = tables.turns(spark, folder)
    spoken = turns.where("role = 'assistant'").withColumnRenamed("frame", "_at")
    placed = number_rows(spoken, ["_at"], ["video"], [F.floor(F.col("_at") / 4096)], out="frame")
    experts = placed.select(
        "video", "frame", F.when(F.length("text") % 5 != 0, F.col("text")).alias("expert")
    )
    return pair.offset_pairs(turns.select("video", "frame", "text"), experts, 1)


@query(
    "pair_lookup",
    """SELECT 'hdr/'||l_orderkey||'/0' AS hdr_key, l_linenumber AS frame, l_returnflag AS variant,
 l_suppkey AS video, o_totalprice AS hdr_value FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def pair_lookup(spark, folder):
    """Many SDR records to the one HDR frame they share, by storage key."""
    sdr = tables.table(spark, folder, "lineitem").select(
        labels.hdr_key(F.col("l_orderkey").cast("string"), F.lit(0)).alias("hdr_key"),
        F.col("l_linenumber").alias("frame"),
        F.col("l_returnflag").alias("variant"),
        F.col("l_suppkey").alias("video"),
    )
    hdr = tables.table(spark, folder, "orders").select(
        labels.hdr_key(F.col("o_orderkey").cast("string"), F.lit(0)).alias("hdr_key"),
        F.col("o_totalprice").alias("hdr_value"),
    )
    return sdr.join(hdr, "hdr_key")


@query(
    "prediction_pairs",
    """SELECT doc_id::VARCHAR AS id, source AS video, lang AS variant, 'ref/'||doc_id AS reference, quality
 FROM documents JOIN labels USING (doc_id)""",
)
def prediction_pairs(spark, folder):
    path = lambda: F.concat(F.lit("ref/"), F.col("doc_id").cast("string")).alias("reference")
    predictions = tables.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("video"),
        F.col("lang").alias("variant"),
        path(),
    )
    references = tables.table(spark, folder, "labels").select(path(), "quality")
    return predictions.join(references, "reference")


_HEAD = "{0} AS (SELECT source, min(lang) AS split, max(n_chars) AS peak, count(*) AS n FROM {1} GROUP BY 1)"


@query(
    "header_mismatch",
    "WITH "
    + _HEAD.format("x", "documents")
    + ", "
    + _HEAD.format("a", "documents JOIN labels USING (doc_id)")
    + """, l AS (SELECT x.source, unnest([{'f':'split','e':x.split,'a':a.split},
 {'f':'peak','e':x.peak::VARCHAR,'a':a.peak::VARCHAR},{'f':'n','e':x.n::VARCHAR,'a':a.n::VARCHAR}]) AS r
 FROM x LEFT JOIN a USING (source))
SELECT source, r.f AS field, r.e AS expected, r.a AS actual FROM l WHERE r.e IS DISTINCT FROM r.a""",
)
def header_mismatch(spark, folder):
    """Headers of two manifests, one per source, compared field by field."""
    docs = tables.table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    done = docs.join(tables.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")

    def header(records):
        return records.groupBy("source").agg(
            F.min("lang").alias("split"),
            F.max("n_chars").alias("peak"),
            F.count(F.lit(1)).alias("n"),
        )

    return pair.header_mismatch(header(done), header(docs), ("split", "peak", "n"), ("source",))


@query(
    "shape_mismatch",
    """SELECT p_partkey, p_size AS sdr_height, p_size % 7 AS sdr_width,
 (p_size - CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END)::INTEGER AS hdr_height,
 (p_size % 7 + CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 0 END)::INTEGER AS hdr_width
 FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 11 = 0""",
)
def shape_mismatch(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size")
    pairs = tables.table(spark, folder, "part").select(
        "p_partkey",
        size.alias("sdr_height"),
        (size % 7).alias("sdr_width"),
        (size - F.when(key % 5 == 0, 1).otherwise(0)).alias("hdr_height"),
        (size % 7 + F.when(key % 11 == 0, 2).otherwise(0)).alias("hdr_width"),
    )
    return pair.shape_mismatch(pairs)


# ------------------------------------------------------------- labels and filters
@query(
    "variant_filter",
    q.rows(
        q.PX,
        select="SELECT video, frame, variant, count(*) AS n_pixels, round(sum(tr),4) AS light FROM px"
        " WHERE variant IN ('A','R') GROUP BY ALL",
    ),
)
def variant_filter(spark, folder):
    kept = select.variants_only(tables.px(spark, folder), ["A", "R"])
    return kept.groupBy("video", "frame", "variant").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.round(F.sum("tr"), 4).alias("light")
    )


@query(
    "expert_flag",
    """WITH t AS (SELECT l_suppkey AS video, CASE WHEN l_linestatus='O' AND l_linenumber % 2 = 0 THEN 'Expert' END AS track,
 CASE l_returnflag WHEN 'A' THEN 'EXPERT' WHEN 'R' THEN 'reinhard' END AS tmo,
 CASE WHEN l_linenumber=3 THEN 'expert' ELSE l_returnflag END AS variant FROM lineitem)
SELECT video, lower(coalesce(track,tmo,variant)) = 'expert' AS expert, count(*) AS n_rows FROM t GROUP BY ALL""",
)
def expert_flag(spark, folder):
    item = tables.table(spark, folder, "lineitem")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    track = F.when((F.col("l_linestatus") == "O") & (line % 2 == 0), "Expert")
    tmo = F.when(flag == "A", "EXPERT").when(flag == "R", "reinhard")
    variant = F.when(line == 3, "expert").otherwise(flag)
    df = item.select(
        F.col("l_suppkey").alias("video"), labels.is_expert(track, tmo, variant).alias("expert")
    )
    return df.groupBy("video", "expert").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "content_id",
    """SELECT doc_id, coalesce(c,v,w,s,i,'unknown') AS content, coalesce(v,w,s,i) AS video FROM (
 SELECT doc_id, CASE WHEN doc_id%7=0 THEN 'content-'||source END AS c, CASE WHEN doc_id%5=0 THEN 'id-'||doc_id END AS v,
 CASE WHEN doc_id%3=0 THEN source END AS w, CASE WHEN doc_id%2=0 THEN lang END AS s,
 CASE WHEN doc_id%13<>0 THEN doc_id::VARCHAR END AS i FROM documents)""",
)
def content_id(spark, folder):
    number = F.col("doc_id")
    some = lambda n, text: F.when(number % n == 0, text)
    fields = {
        "c": some(7, F.concat(F.lit("content-"), "source")),
        "v": some(5, F.concat(F.lit("id-"), number.cast("string"))),
        "w": some(3, F.col("source")),
        "s": some(2, F.col("lang")),
        "i": F.when(number % 13 != 0, number.cast("string")),
    }
    content = labels.content_id(*fields.values())
    video = labels.video_id(fields["v"], fields["w"], fields["s"], fields["i"], required=False)
    df = tables.table(spark, folder, "documents").select("doc_id", "source", "lang")
    return df.select("doc_id", content.alias("content"), video.alias("video"))


@query(
    "variant_label",
    """SELECT l_suppkey AS video, CASE WHEN crf IS NULL THEN tmo ELSE tmo||'_crf'||crf END AS variant,
 coalesce(frame_index, frame) AS frame, coalesce(category, source_dataset, 'pgc') AS category, count(*) AS n_rows FROM (
 SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 'expert' WHEN 'N' THEN 'reinhard' ELSE 'bt2446a' END AS tmo,
 CASE WHEN l_returnflag<>'A' THEN 23+8*(l_linenumber%3) END AS crf,
 CASE WHEN l_linenumber > 3 THEN l_linenumber*10 END AS frame_index, l_linenumber AS frame,
 CASE WHEN l_linestatus='O' THEN 'ugc' END AS category, CASE WHEN l_linenumber%2=0 THEN 'set' END AS source_dataset
 FROM lineitem) GROUP BY ALL""",
)
def variant_label(spark, folder):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    tmo = F.when(flag == "A", "expert").when(flag == "N", "reinhard").otherwise("bt2446a")
    crf = F.when(flag != "A", 23 + 8 * (line % 3))
    df = tables.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("video"),
        labels.variant_label(tmo, crf).alias("variant"),
        F.coalesce(F.when(line > 3, line * 10), line).alias("frame"),
        F.coalesce(
            F.when(F.col("l_linestatus") == "O", "ugc"), F.when(line % 2 == 0, "set"), F.lit("pgc")
        ).alias("category"),
    )
    return df.groupBy("video", "variant", "frame", "category").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query(
    "color_tags",
    """WITH t AS (SELECT user_id AS video, CASE event_type WHEN 'click' THEN 'BT470BG' WHEN 'view' THEN 'smpte170m'
 WHEN 'purchase' THEN 'bt2020nc' WHEN 'signup' THEN 'Unspecified' ELSE 'bt709' END AS space,
 CASE event_id % 6 WHEN 0 THEN 'TV' WHEN 1 THEN 'mpeg' WHEN 2 THEN 'pc' WHEN 3 THEN 'JPEG' WHEN 4 THEN 'full' END AS rng FROM events)
SELECT video, CASE lower(space) WHEN 'bt470bg' THEN 'bt601' WHEN 'smpte170m' THEN 'bt601' WHEN 'bt2020nc' THEN 'bt2020'
 WHEN 'unspecified' THEN 'bt2020' ELSE lower(space) END AS matrix,
 CASE WHEN rng IS NULL THEN 'limited' WHEN lower(rng) IN ('tv','mpeg') THEN 'limited' ELSE 'full' END AS range, count(*) AS n_rows
FROM t GROUP BY ALL""",
)
def color_tags(spark, folder):
    event, number = F.col("event_type"), F.col("event_id") % 6
    space = (
        F.when(event == "click", "BT470BG")
        .when(event == "view", "smpte170m")
        .when(event == "purchase", "bt2020nc")
        .when(event == "signup", "Unspecified")
        .otherwise("bt709")
    )
    tag = F.when(number == 0, "TV").when(number == 1, "mpeg").when(number == 2, "pc")
    tag = tag.when(number == 3, "JPEG").when(number == 4, "full")
    df = tables.table(spark, folder, "events").select(
        F.col("user_id").alias("video"),
        labels.colour_matrix(space, "bt2020").alias("matrix"),
        labels.colour_range(tag).alias("range"),
    )
    return df.groupBy("video", "matrix", "range").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "prediction_names",
    r"""SELECT doc_id, lpad(doc_id::VARCHAR,8,'0')||'_'||CASE WHEN v='' THEN 'variant' ELSE v END||'.png' AS name FROM (
 SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id%10=0 THEN '._ ' ELSE '('||source||' / '||lang||') é.'||n_chars END,
 '[^A-Za-z0-9_.-]+','_','g'),'._') AS v FROM documents)""",
)
def prediction_names(spark, folder):
    text = F.concat(
        F.lit("("), "source", F.lit(" / "), "lang", F.lit(") é."), F.col("n_chars").cast("string")
    )
    variant = F.when(F.col("doc_id") % 10 == 0, "._ ").otherwise(text)
    df = tables.table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    name = F.concat(
        labels.padded(F.col("doc_id"), 8), F.lit("_"), labels.safe_variant(variant), F.lit(".png")
    )
    return df.select("doc_id", name.alias("name"))


# ------------------------------------------------------------- sequences
@query(
    "resample_fps",
    q.rows(
        q.SIG,
        "s AS (SELECT *, floor(epoch_us(ts)/1e6*4.6e-5)::BIGINT AS slot FROM sig),"
        "r AS (SELECT *, row_number() OVER (PARTITION BY video, slot ORDER BY ts) AS r FROM s)",
        select="SELECT video, slot, ordinal, variant, round(nits,4) AS nits FROM r WHERE r=1",
    ),
)
def resample_fps(spark, folder):
    """First frame of every interval, one interval per six hours of the event clock."""
    sig = tables.signal(spark, folder)
    seconds = F.unix_micros("ts") / F.lit(1e6)
    kept = select.first_per_bucket(sig, ["video"], seconds, 4.6e-5)
    return kept.select("video", "slot", "ordinal", "variant", F.round("nits", 4).alias("nits"))


@query("max_records", q.rows(q.SIG, select="SELECT video, ordinal, variant, round(nits,4) AS nits FROM sig ORDER BY ordinal LIMIT 1000"))
def max_records(spark, folder):
    """The first 1000 records of a manifest."""
    sig = tables.signal(spark, folder).orderBy("ordinal").limit(1000)
    return sig.select("video", "ordinal", "variant", F.round("nits", 4).alias("nits"))


@query(
    "subsample_global",
    q.rows(
        q.SIG,
        "n AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS n FROM sig)",
        select="SELECT n, video, ordinal, variant FROM n WHERE n % 7 = 0",
    ),
)
def subsample_global(spark, folder):
    sig = tables.signal(spark, folder).select("video", "ordinal", "variant")
    numbered = number_rows(sig, ["ordinal"], buckets=[F.floor(F.col("ordinal") / 2**20)])
    return every_nth(numbered, "n", 7).select("n", "video", "ordinal", "variant")


@query(
    "subsample_per_video",
    q.rows(
        q.SIG,
        "n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY ordinal) - 1 AS n FROM sig)",
        select="SELECT video, frame, ordinal, variant FROM n WHERE n % 4 = 0",
    ),
)
def subsample_per_video(spark, folder):
    """Every fourth record of a video, counted in manifest order whatever its variant."""
    sig = tables.numbered_signal(spark, folder).select("video", "frame", "ordinal", "variant")
    block = F.floor(F.col("ordinal") / 2**20)
    numbered = number_rows(sig, ["ordinal"], ["video"], [block])
    return every_nth(numbered, "n", 4).select("video", "frame", "ordinal", "variant")


@query("frame_cap", q.rows(q.SIG, select="SELECT video, frame, ordinal, round(nits,4) AS nits FROM sig WHERE frame < 24"))
def frame_cap(spark, folder):
    sig = first_rows(tables.numbered_signal(spark, folder), "frame", 24)
    return sig.select("video", "frame", "ordinal", F.round("nits", 4).alias("nits"))


@query(
    "too_short",
    q.rows(
        q.SIG,
        "s AS (SELECT video, date_trunc('day', ts) AS d, count(*) AS n_frames FROM sig GROUP BY ALL)",
        select="SELECT video||':'||strftime(d,'%Y-%m-%d') AS video, n_frames FROM s WHERE n_frames < 2",
    ),
)
def too_short(spark, folder):
    """Days of a user stand for videos; those with a single frame cannot show flicker."""
    day = F.concat_ws(":", F.col("video").cast("string"), F.to_date("ts").cast("string"))
    return select.too_short(tables.signal(spark, folder).select(day.alias("video")))


# ------------------------------------------------------------- manifests
_RECORDS = "recs AS (SELECT video, (doc_id % 100)::INTEGER AS frame, 'train' AS split, source_dataset FROM corpus)"
_TMOS = "['bt2390_eetf_gm','bt2446a','bt2446c_gm','gamma_clip','hard_clip_gm','ocio_filmic','reinhard','youtube_logc']"
_GRID = f"""grid AS (SELECT video, frame, split, source_dataset, tmo, crf, 'hdr/'||video||'/'||frame AS hdr_key,
 'sdr/'||video||'/'||frame||'/'||tmo||'/'||crf AS sdr_key FROM recs,
 unnest({_TMOS}) t(tmo), unnest([23,31,39]) c(crf))"""
_ALL = """allrecs AS (SELECT video, frame, split, source_dataset, tmo, crf::INTEGER AS crf, hdr_key, sdr_key FROM grid UNION ALL
 SELECT r.video, r.frame, r.split, r.source_dataset, 'expert', NULL, 'hdr/'||video||'/'||frame,
 'sdr/'||video||'/'||frame||'/expert/none' FROM recs r JOIN listed USING (video) WHERE quality=1 UNION ALL
 SELECT r.video, r.frame, r.split, r.source_dataset, 'native', NULL, 'hdr/'||video||'/'||frame,
 'sdr/'||video||'/'||frame||'/native/none' FROM recs r JOIN listed USING (video) WHERE quality=0)"""
_FIELDS = "video, frame, split, source_dataset, tmo, crf, hdr_key, sdr_key"


def _records(spark, folder):
    return tables.corpus(spark, folder).select(
        "video",
        (F.col("doc_id") % 100).cast("int").alias("frame"),
        F.lit("train").alias("split"),
        "source_dataset",
    )


def _all_records(spark, folder, frames=None):
    frames, listed = _records(spark, folder) if frames is None else frames, _listed(spark, folder)
    return pair.pair_records(
        frames,
        frames.join(listed.where("quality = 1"), "video", "left_semi"),
        frames.join(listed.where("quality = 0"), "video", "left_semi"),
    )


@query("degrade_grid", q.rows(q.CORPUS, _RECORDS, _GRID, select=f"SELECT {_FIELDS} FROM grid"))
def degrade_grid(spark, folder):
    return pair.degrade_grid(_records(spark, folder))


@query("pair_records", q.rows(q.CORPUS, _LISTED, _RECORDS, _GRID, _ALL, select=f"SELECT {_FIELDS} FROM allrecs"))
def pair_records(spark, folder):
    return _all_records(spark, folder)


@query(
    "manifest_order",
    q.rows(
        q.CORPUS,
        _LISTED,
        _RECORDS,
        _GRID,
        _ALL,
        select="SELECT sdr_key, row_number() OVER (ORDER BY source_dataset, video, frame, tmo,"
        " coalesce(crf,-1)) - 1 AS ordinal FROM allrecs",
    ),
)
def manifest_order(spark, folder):
    return pair.manifest_ordinals(_all_records(spark, folder)).select("sdr_key", "ordinal")


@query(
    "manifest_merge",
    q.rows(
        q.CORPUS,
        _LISTED,
        _RECORDS,
        _GRID,
        _ALL,
        select=f"SELECT {_FIELDS}, video IN (SELECT video FROM listed) AS existing FROM allrecs",
    ),
)
def manifest_merge(spark, folder):
    """Records of an earlier run kept, records of videos it lacks appended."""
    frames, done = _records(spark, folder), _listed(spark, folder)
    # A frame is looked up once, before the grid makes many records of it.
    existing = _all_records(spark, folder, frames.join(done, "video", "left_semi")).withColumn("existing", F.lit(True))
    fresh = _all_records(spark, folder, select.without(frames, done)).withColumn("existing", F.lit(False))
    return existing.unionByName(fresh)


@query(
    "manifest_json",
    q.rows(
        q.CORPUS,
        _LISTED,
        _RECORDS,
        _GRID,
        _ALL,
        select="SELECT sdr_key, to_json({'crf':crf,'frame':frame,'hdr_key':hdr_key,'sdr_key':sdr_key,"
        "'source_dataset':source_dataset,'split':split,'tmo':tmo,'video':video})::VARCHAR AS line FROM allrecs",
    ),
)
def manifest_json(spark, folder):
    records = _all_records(spark, folder)
    return records.select("sdr_key", json_line(records.columns).alias("line"))


@query(
    "manifest_scan",
    q.rows(
        q.CORPUS,
        _LISTED,
        _RECORDS,
        _GRID,
        _ALL,
        select="SELECT row_number() OVER (ORDER BY source_dataset, video, frame, tmo, coalesce(crf,-1)) - 1"
        " AS ordinal, hdr_key, sdr_key, video, frame, tmo, crf, split, source_dataset FROM allrecs",
    ),
)
def manifest_scan(spark, folder):
    """The records written as JSON lines in manifest order and read back with their places."""
    target = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    write_manifest(_all_records(spark, folder), target)
    back = manifest.read_manifest(spark, f"{target}/records", ordinal="ordinal")
    return back.drop("hdr_shard", "sdr_shard")


@query(
    "flatten_variants",
    q.rows(
        q.CORPUS,
        "m AS (SELECT doc_id::VARCHAR AS id, category, 'hdr/'||video||'.png' AS hdr_path, video,"
        " unnest(CASE WHEN doc_id % 4 = 0 THEN ['expert','reinhard_crf23'] ELSE ['reinhard_crf23'] END) AS variant FROM corpus)",
        select="SELECT id, coalesce(CASE WHEN category<>'fr' THEN category END,'pgc') AS category, variant,"
        " 'sdr/'||video||'__'||variant||'.png' AS sdr_path, hdr_path FROM m",
    ),
)
def flatten_variants(spark, folder):
    """Picture records with a map of variants, one row per variant."""
    path = lambda name: F.concat(F.lit("sdr/"), "video", F.lit(f"__{name}.png"))
    one = [F.lit("reinhard_crf23"), path("reinhard_crf23")]
    both = F.create_map(F.lit("expert"), path("expert"), *one)
    records = tables.corpus(spark, folder).select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("category") != "fr", F.col("category")).alias("category"),
        F.concat(F.lit("hdr/"), "video", F.lit(".png")).alias("hdr"),
        F.when(F.col("doc_id") % 4 == 0, both).otherwise(F.create_map(*one)).alias("sdr_variants"),
    )
    return pair.flatten_variants(records)


# ------------------------------------------------------------- shards
TARGET, PER_WRITER = 50_000, 8
_ITEMS = f"""items AS (SELECT doc_id, bytes, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM corpus),
w AS (SELECT greatest(1, ceil(sum(bytes)/{float(TARGET * PER_WRITER):.1f}::DOUBLE))::BIGINT AS n FROM items),
dealt AS (SELECT doc_id, bytes, ordinal, ordinal % n AS writer FROM items, w),
seq AS (SELECT *, row_number() OVER (PARTITION BY writer ORDER BY ordinal) AS i FROM dealt),
fit AS (SELECT writer, i, ordinal, doc_id, bytes, bytes AS used, 0::BIGINT AS shard FROM seq WHERE i = 1 UNION ALL
 SELECT s.writer, s.i, s.ordinal, s.doc_id, s.bytes,
  CASE WHEN f.used + s.bytes > {TARGET} THEN s.bytes ELSE f.used + s.bytes END,
  CASE WHEN f.used + s.bytes > {TARGET} THEN f.shard + 1 ELSE f.shard END
 FROM fit f JOIN seq s ON s.writer = f.writer AND s.i = f.i + 1)"""


def _packed(spark, folder):
    items = tables.corpus(spark, folder).select("doc_id", "bytes")
    block = F.floor(F.col("doc_id") / 2**20)
    numbered = number_rows(items, ["doc_id"], buckets=[block], out="ordinal")
    dealt = pack.with_writers(numbered, "ordinal", "bytes", TARGET, PER_WRITER)
    return pack.pack(dealt, "ordinal", "bytes", TARGET)


@query(
    "shard_pack",
    f"WITH RECURSIVE {q.CORPUS}, {_ITEMS} SELECT writer, ordinal, doc_id, bytes, shard FROM fit",
)
def shard_pack(spark, folder):
    return _packed(spark, folder).select("writer", "ordinal", "doc_id", "bytes", "shard")


@query(
    "shard_renumber",
    f"""WITH RECURSIVE {q.CORPUS}, {_ITEMS},
names AS (SELECT 'hdr-'||lpad((quality*40+toxic*3)::VARCHAR,5,'0')||'.parquet' AS name FROM labels),
nxt AS (SELECT max(regexp_extract(name,'^hdr-([0-9]+)',1)::BIGINT) + 1 AS n FROM names),
s AS (SELECT writer, shard, row_number() OVER (ORDER BY writer, shard) - 1 AS k FROM (SELECT DISTINCT writer, shard FROM fit))
SELECT doc_id, 'hdr-'||lpad((k+n)::VARCHAR,5,'0') AS hdr_shard FROM fit JOIN s USING (writer, shard), nxt""",
)
def shard_renumber(spark, folder):
    """Shards numbered on from the highest name already there."""
    number = F.col("quality") * 40 + F.col("toxic") * 3
    existing = tables.table(spark, folder, "labels").select(
        F.concat(F.lit("hdr-"), labels.padded(number, 5), F.lit(".parquet")).alias("name")
    )
    first = pack.next_shard(existing, "name", "hdr").scalar()
    final = pack.renumber(_packed(spark, folder), first)
    name = F.concat(F.lit("hdr-"), labels.padded(F.col("final_shard"), 5))
    return final.select("doc_id", name.alias("hdr_shard"))
