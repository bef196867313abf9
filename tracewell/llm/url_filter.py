"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import fold, packed
from tracewell.plans.lineage import settle

#: Labelled URLs that are read for training, at most, and the partitions that hold them.
SAMPLE, PARTS = 20_000, 8
#: Pseudo-observations of the overall rate in the rate of a suffix, and folds of the labelled URLs.
PRIOR, FOLDS = 10.0, 5

FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "query_length",
    "hyphens", "upper_ratio", "odd_ratio", "longest_run", "has_fragment", "secure", "rate_1", "rate_2",
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null or a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return fold(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (verdict, rule) that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one set is the longest
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical(frame: DataFrame) -> DataFrame:
    """``frame`` (with a column ``url``) and the lexical features but for the suffix rates."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = url_parts(url)
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    letters = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(letters, F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(F.greatest(share(c), F.lit(1e-12)))))
    runs = F.split(url, r"[^A-Za-z0-9]+")
    return frame.withColumns(
        {
            "length": size, "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
            "depth": _count(path, r"/[^/]"), "labels": _count(host, r"[^.]+"), "digit_ratio": _count(url, r"[0-9]") / size,
            "entropy": entropy, "parameters": _count(query, r"[^&]+"), "query_length": F.length(query).cast("double"),
            "hyphens": _count(url, r"[-_]"), "upper_ratio": _count(url, r"[A-Z]") / size, "odd_ratio": _count(url, r"[^A-Za-z0-9:/.?&=#_-]") / size,
            "longest_run": F.aggregate(runs, F.lit(0), lambda m, r: F.greatest(m, F.length(r))).cast("double"),
            "has_fragment": url.contains("#").cast("double"), "secure": url.startswith("https://").cast("double"),
            "suffix_1": F.substring_index(host, ".", -1), "suffix_2": F.substring_index(host, ".", -2),
        }
    )


@dataclass
class Model:
    """Trees (none if one class only was seen), the overall rate and the counts of suffixes."""

    trees: GBTClassificationModel | None
    rate: float
    suffixes: DataFrame


def suffix_counts(rows: DataFrame) -> DataFrame:
    """(kind, suffix, bad, n, folds) over all of ``rows`` (url, label): per suffix the labels and their
    number, in all and by fold of the URL."""
    host, _ = url_parts(F.col("url"))
    ends = F.array(*[F.struct(F.lit(k).alias("kind"), F.substring_index(host, ".", -k).alias("suffix")) for k in (1, 2)])
    single = rows.select("label", _fold().alias("fold"), F.explode(ends).alias("e")).select("label", "fold", "e.*")
    here = [F.col("fold") == k for k in range(FOLDS)]
    folds = F.array(*[F.struct(F.sum(F.when(f, F.col("label")).otherwise(0.0)).alias("bad"), F.count_if(f).alias("n")) for f in here])
    return single.groupBy("kind", "suffix").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"), folds.alias("folds"))


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit(13), "url"), F.lit(FOLDS)).cast("int")


def _with_rates(frame: DataFrame, suffixes: DataFrame, rate: float, unseen: bool = False) -> DataFrame:
    """``frame`` with the smoothed rate of each of its suffixes; with ``unseen`` URLs of a row's own
    fold do not count, so that trees do not read labels off the rates."""
    for k in (1, 2):
        known = suffixes.where(F.col("kind") == k).select(F.col("suffix").alias(f"suffix_{k}"), "bad", "n", "folds")
        joined = frame.join(known, f"suffix_{k}", "left")
        bad, n = F.coalesce("bad", F.lit(0.0)), F.coalesce("n", F.lit(0))
        if unseen:
            own = F.get("folds", _fold())
            bad, n = bad - F.coalesce(own["bad"], F.lit(0.0)), n - F.coalesce(own["n"], F.lit(0))
        frame = joined.withColumn(f"rate_{k}", (bad + PRIOR * rate) / (n + PRIOR)).drop("bad", "n", "folds")
    return frame


def train(labelled: DataFrame, limit: int = SAMPLE, rounds: int = 20, depth: int = 4) -> Model:
    """Fit on (url, label), label 1 for a URL to block.

    Copies of a URL count once, with the largest label. Trees learn from at most ``limit`` URLs,
    chosen by a hash; the suffix rates that are among their features come from all labelled URLs,
    those of a training URL from the other folds.
    """
    rows = labelled.where(F.col("label").isNotNull()).select(F.coalesce("url", F.lit("")).alias("url"), F.col("label").cast("double").alias("label"))
    rows = settle(rows.groupBy("url").agg(F.max("label").alias("label")))
    rate = rows.agg(F.avg("label")).first()[0] or 0.0
    suffixes = settle(suffix_counts(rows))
    if rate in (0.0, 1.0):
        return Model(None, rate, suffixes)
    sample = lexical(rows.orderBy(F.xxhash64(F.lit(7), "url"), "url").limit(limit))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_with_rates(sample, suffixes, rate, unseen=True))
    ready = settle(ready.select("features", "label").coalesce(PARTS))  # the sample is bounded, and every level of a tree reads it
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=32, seed=3, cacheNodeIds=False).fit(ready)
    return Model(trees, rate, suffixes)


def score(pages: DataFrame, model: Model) -> DataFrame:
    """(row, url, host, path, score) for every row of ``pages`` (any columns, one of them ``url``).

    ``score`` is the probability of a URL to block; it is the rate of the labels if they were all
    alike. Null and empty URLs get features of an empty text. Repeated rows get equal scores; an
    empty table gives no rows. The rates of all suffixes are joined, broadcast only where Spark finds
    them small.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = url_parts(url)
    frame = packed(pages, url.alias("url"), host.alias("host"), path.alias("path"))
    if model.trees is None:
        return frame.withColumn("score", F.lit(model.rate))
    made = _with_rates(lexical(frame), model.suffixes, model.rate)
    made = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made)
    scored = model.trees.transform(made.select("row", "url", "host", "path", "features"))
    return scored.select("row", "url", "host", "path", vector_to_array("probability")[1].alias("score"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...], limit: int = SAMPLE) -> DataFrame:
    """(row, host, path, rule, score, verdict): the longest rule that fits decides, else the trees,
    trained on the URLs that rules decide."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rule, verdict = matching_rule(*url_parts(url), rules)
    labelled = pages.select(url.alias("url"), F.when(verdict.isNotNull(), (verdict == "block").cast("double")).alias("label"))
    scored = score(pages, train(labelled, limit))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("row", "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, own).alias("verdict"))
