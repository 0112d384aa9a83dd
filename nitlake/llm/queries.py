"""Every query of this subpackage by name, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, fim, licences, lines, packing, planes, quality, simhash, suffixes, templates, toxicity, urls

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_license_scan", licences.oracle())
def license_scan(spark, folder):
    """Whole texts and whole lines that are a known licence."""
    return licences.license_matches(table(spark, folder, "documents"), licences.known_licences(spark))


@query("op5_url_filter")
def url_filter(spark, folder):
    """Every page's URL by rule, else by boosted trees."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    labelled = urls.page_labels(pages, table(spark, folder, "labels"))
    return urls.judged(pages, urls.UrlFilter.fit(labelled, "url", "label", "page_id"))


@query("op7_chat_rotation", chat.ORACLE)
def chat_rotation(spark, folder):
    """Every conversation from the view of each of its participants."""
    return chat.rotate(table(spark, folder, "conversations"))


@query("op6_simhash")
def simhash_near(spark, folder):
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op10_suffix_dedup")
def suffix_dedup(spark, folder):
    """What every document loses to earlier repeats of 100 bytes and more."""
    return suffixes.removal_digests(table(spark, folder, "documents"))


@query("op3_quality")
def quality_rules(spark, folder):
    """Rule counts, perplexity and verdict of every document."""
    return quality.quality(table(spark, folder, "documents"))


@query("op4_packing")
def pack(spark, folder):
    """Every piece of every document, and where it lies in which sequence."""
    return packing.packed(table(spark, folder, "documents"))


@query("op9_bit_planes")
def bit_planes(spark, folder):
    """Every document's ids as read back from files of bit planes."""
    return planes.file_digests(table(spark, folder, "documents"))


@query("op1_template_leaks")
def template_leaks(spark, folder):
    """Documents that hold a benchmark item, also with other numbers, names and units."""
    return templates.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_toxicity")
def toxicity_scores(spark, folder):
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_line_dedup", lines.ORACLE)
def line_dedup(spark, folder):
    """What stays of every document without the lines that others repeat."""
    return lines.digests(table(spark, folder, "documents"))


@query("op12_collocations", collocations.ORACLE)
def collocated(spark, folder):
    """The phrases of every language whose words belong together."""
    return collocations.collocations(table(spark, folder, "documents"))


@query("op13_fill_in_middle", fim.ORACLE)
def middles(spark, folder):
    """Every document rearranged for filling in its middle, and restored."""
    return fim.digests(table(spark, folder, "documents"))
