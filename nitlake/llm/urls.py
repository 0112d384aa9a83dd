"""URL filter: rules on host and path, and boosted trees on lexical features for all other URLs.

DataFrame functions and Spark's own tree learner only.
"""

from __future__ import annotations

from math import log

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: (rule as host/path, what it orders)
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: At most about this many labelled URLs train the trees.
TRAINED_ON = 20_000
#: A suffix must be labelled this often before its own rate outweighs the overall rate.
PRIOR = 20.0
FEATURES = (
    "length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "params",
    "hyphens", "host_digits", "has_fragment", "is_secure", "suffix_rate", "suffix_seen",
)


def host(url: Column) -> Column:
    """From the first ``://`` to the next of ``/?#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and what it orders; nulls where none fits."""
    fits = []
    for rule, order in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, start = rule.partition("/")
        fit = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        fits.append((fit, rule, order))
    text = F.lit(None).cast("string")
    first = lambda k: F.coalesce(*[F.when(x[0], F.lit(x[k])) for x in fits], text)
    return first(1), first(2)


def lexical(rows: DataFrame, url: str) -> DataFrame:
    """``rows`` with the features that need the URL alone, and its suffix. Null counts as empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    count = lambda c, s: F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))
    size = F.greatest(F.length(text), F.lit(1))
    rows = rows.withColumns({"_text": text, "_host": host(text), "_path": path(text)})
    text, name = F.col("_text"), F.col("_host")
    shares = F.transform(
        F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    )
    entropy = F.aggregate(
        shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p) / F.lit(log(2))).otherwise(0.0)
    )
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    made = {
        "length": F.length(text), "host_length": F.length(name), "path_length": F.length("_path"),
        "labels": F.size(F.split(name, r"\.")), "depth": F.size(F.filter(F.split("_path", "/"), lambda p: p != "")),
        "digit_ratio": digits(text) / size, "entropy": entropy,
        "params": F.size(F.filter(F.split(query, "&"), lambda p: p != "")),
        "hyphens": count(name, "-"), "host_digits": digits(name),
        "has_fragment": text.contains("#").cast("int"), "is_secure": text.startswith("https:").cast("int"),
    }
    made = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()}
    return rows.withColumns(made | {"_suffix": F.substring_index("_host", ".", -3)}).drop("_text")


def sampled(labelled: DataFrame, key: str, bound: int = TRAINED_ON) -> DataFrame:
    """About ``bound`` labelled rows, chosen by a hash of the key, all of them where there are fewer."""
    share = min(1.0, bound / max(1, labelled.count()))
    return labelled.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20)) < int(share * (1 << 20)))


class UrlFilter:
    """Trees and suffix rates learnt from labelled URLs."""

    def __init__(self, model: PipelineModel, rates: DataFrame, overall: float):
        self.model, self.rates, self.overall = model, rates, overall

    @classmethod
    def fit(cls, labelled: DataFrame, url: str, label: str, key: str, folds: int = 2) -> UrlFilter:
        """``label`` is 1 for URLs to block. Suffix rates for training come from the other fold,
        so that a URL never sees its own label. Rates are counted over all labelled rows; only the
        trees are trained on a sample. No labelled row, or one class only: the filter then gives
        that class's rate."""
        labelled = labelled.where(F.col(label).isNotNull())
        fold = F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(folds))
        marked = {"_label": F.col(label).cast("double"), "_fold": fold}
        every = labelled.select(host(F.coalesce(F.col(url), F.lit(""))).alias("_host"), *[c.alias(k) for k, c in marked.items()])
        # A row per suffix and fold, written once: the overall rate and all suffixes' rates follow from it.
        seen = stored(
            every.groupBy(F.substring_index("_host", ".", -3).alias("_suffix"), "_fold")
            .agg(F.count("*").alias("n"), F.sum("_label").alias("s")), "suffixes",
        )
        overall = seen.agg(F.sum("s") / F.sum("n")).first()[0]
        if overall in (None, 0.0, 1.0):
            return cls(None, None, overall or 0.0)
        rows = lexical(sampled(labelled, key), url).withColumns(marked).cache()
        sums = seen.groupBy("_suffix").agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"))
        rate = lambda s, n: (s + PRIOR * overall) / (n + PRIOR)
        other = (
            seen.join(sums, "_suffix")
            .select("_suffix", "_fold", (F.col("_n") - F.col("n")).alias("_n"), (F.col("_s") - F.col("s")).alias("_s"))
        )
        train = rows.join(other, ["_suffix", "_fold"]).withColumns(
            {"suffix_rate": rate(F.col("_s"), F.col("_n")), "suffix_seen": F.log1p("_n")}
        )
        trees = GBTClassifier(featuresCol="_x", labelCol="_label", maxIter=20, maxDepth=4, stepSize=0.2, seed=11)
        gather = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
        # The sample is bounded: a few partitions, so that twenty rounds are not twenty times the tasks.
        sample = gather.transform(train).select("_x", "_label").coalesce(4)
        model = PipelineModel([gather, trees.fit(sample)])
        # All labelled suffixes; those without a label have the overall rate.
        rates = sums.select("_suffix", rate(F.col("_s"), F.col("_n")).alias("suffix_rate"), F.log1p("_n").alias("suffix_seen"))
        return cls(model, rates, overall)

    def score(self, rows: DataFrame, url: str, out: str = "score") -> DataFrame:
        """``rows`` with ``out``, the probability that the URL is one to block."""
        if self.model is None:
            return rows.withColumn(out, F.lit(self.overall))
        kept = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_kept")
        plain = lexical(rows.select(kept, F.col(f"`{url}`").alias("_url")), "_url")
        # No hint: Spark broadcasts the rates where their size allows, and joins by key otherwise.
        known = plain.join(self.rates, "_suffix", "left").fillna(
            {"suffix_rate": self.overall, "suffix_seen": 0.0}
        )
        scored = self.model.transform(known)
        return scored.select("_kept.*", vector_to_array("probability")[1].alias(out))


def judged(pages: DataFrame, filter: UrlFilter, id: str = "page_id", url: str = "url", rules=RULES, least: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row: the longest rule's order, else the trees'.

    A null URL has an empty host and path, no rule, and is judged by the trees as an empty text.
    Repeated rows give repeated results; other columns are ignored.
    """
    rows = filter.score(pages.select(F.col(id).alias("_id"), F.col(url).alias("_address")), "_address", "_score")
    address = F.coalesce(F.col("_address"), F.lit(""))
    rows = rows.withColumns({"host": host(address), "path": path(address)})
    rule, order = matched(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("_score") >= least, "block").otherwise("allow")
    return rows.select(
        F.col("_id").alias(id), "host", "path", rule.alias("rule"), F.coalesce(order, own).alias("verdict"),
        F.col("_score").alias("score"),
    )


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled URLs: the number in a page's path names the document it was made from, whose low
    quality or toxicity marks the URL as one to block."""
    number = F.regexp_extract(path(F.col("url")), "/([0-9]{1,18})(?:[^0-9/][^/]*)?/?$", 1)
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    marks = labels.groupBy("doc_id").agg(F.max(bad.cast("int")).alias("label"))
    found = pages.select("page_id", "url", F.try_to_number(number, F.lit("9" * 18)).cast("bigint").alias("doc_id"))
    return found.join(marks, "doc_id").select("page_id", "url", "label")
