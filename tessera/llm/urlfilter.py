"""Operator 3: URL verdicts by rules and, where none fits, by gradient-boosted trees on lexical features.

A rule `host/path` fits its host and all subdomains if the URL's path starts with the rule's; the longest rule
wins. The URLs that a rule decides, each once, are the labelled ones: at most `train_rows` of them (by a hash of the
URL) train the trees, all of them make the statistics. Features: lengths, depth, digit ratio, character entropy, label, hyphen and parameter
counts, and two statistics of the host's suffixes (its last label, its last two): the share of blocked URLs,
smoothed, and how many there are. In training a row's statistics come from other folds than its own. The
statistics are broadcast only if they are at most `broadcast_rows`; beyond that URLs are joined by suffix and one of
SALTS salts, for which the statistics are repeated.

Defined results: a null URL or one without `://` has an empty host and path, fits no rule, and is judged like any other;
if the labelled URLs are all of one verdict, or none exist, that verdict, or `allow`, is the method's.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

FOLDS, PRIOR, SALTS = 5, 10.0, 16
LEXICAL = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "labels", "hyphens", "parameters", "secure"]
SUFFIX = ["rate_1", "seen_1", "rate_2", "seen_2"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null; rules: (verdict, rule)."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, tail = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def with_suffixes(df: DataFrame) -> DataFrame:
    labels = F.split("host", r"\.")
    return df.withColumns({"suffix_1": F.element_at(labels, -1), "suffix_2": F.array_join(F.slice(F.reverse(labels), 1, 2), ".")})


def lexical(df: DataFrame) -> DataFrame:
    """Adds LEXICAL and the suffixes to a frame with url, host and path."""
    url = F.coalesce("url", F.lit(""))
    chars = F.split(url, "")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / F.length(url)
    entropy = -F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda s, c: s + share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    out = df.withColumns(
        {
            "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
            "digit_ratio": F.coalesce(F.try_divide(F.length(F.regexp_replace(url, r"[^0-9]", "")), F.length(url)), F.lit(0.0)),
            "entropy": F.coalesce(entropy, F.lit(0.0)), "labels": _count(F.col("host"), ".") + 1, "hyphens": _count(url, "-"),
            "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1), "secure": url.startswith("https://").cast("int"),
        }
    )
    return with_suffixes(out).withColumns({c: F.col(c).cast("double") for c in LEXICAL})


def _with_rates(df: DataFrame, stats: DataFrame, level: int, base: float, fold: bool, small: bool) -> DataFrame:
    """Adds the suffix's smoothed share and count; fold: without the rows of the row's own fold."""
    key = f"suffix_{level}"
    total = stats.groupBy(key).agg(F.sum("n").alias("n_all"), F.sum("y").alias("y_all"))
    if small:
        out = df.join(F.broadcast(total), key, "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
        salted = df.withColumn("salt", F.pmod(F.xxhash64("url", *([] if fold else ["page_id"])), F.lit(SALTS)))
        out = salted.join(total.withColumn("salt", salts), [key, "salt"], "left").drop("salt")
    if fold:
        own = stats.select(key, "fold", F.col("n").alias("n_own"), F.col("y").alias("y_own"))
        out = out.join(F.broadcast(own) if small else own, [key, "fold"], "left")
    n = F.coalesce("n_all", F.lit(0)) - (F.coalesce("n_own", F.lit(0)) if fold else 0)
    y = F.coalesce("y_all", F.lit(0.0)) - (F.coalesce("y_own", F.lit(0.0)) if fold else 0)
    out = out.withColumns({f"rate_{level}": (y + PRIOR * base) / (n + PRIOR), f"seen_{level}": F.log1p(n.cast("double"))})
    return out.drop("n_all", "y_all", "n_own", "y_own")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", train_rows: int = 20_000, rounds: int = 12, depth: int = 4, seed: int = 7, broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)]) if rules else F.create_map().cast("map<string,string>")
    by_rule = F.element_at(verdicts, F.col("rule"))
    labelled = rows.where("rule IS NOT NULL").select("url", "host", "path", (by_rule == "block").cast("double").alias("label")).distinct()
    labelled = materialise(with_suffixes(labelled).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(FOLDS))), "urls-labelled")
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        own = F.lit("block" if n and blocked == n else "allow")
        return rows.select("page_id", "host", "path", "rule", F.coalesce(by_rule, own).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    base = blocked / n
    stats = [materialise(labelled.groupBy(f"suffix_{k}", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("y")), "urls-suffixes") for k in (1, 2)]
    known, asked = materialise(lexical(labelled.orderBy(F.xxhash64("url")).limit(train_rows)), "urls-train"), lexical(rows)
    for k, s in enumerate(stats, 1):
        small = s.count() <= broadcast_rows
        known, asked = _with_rates(known, s, k, base, True, small), _with_rates(asked, s, k, base, False, small)
    assemble = VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="features")
    trees = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed, cacheNodeIds=False)
    model = trees.fit(assemble.transform(known).select("features", "label"))
    scored = model.transform(assemble.transform(asked)).withColumn("block_score", vector_to_array("probability")[1])
    own = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce(by_rule, own).alias("verdict"), "block_score")
