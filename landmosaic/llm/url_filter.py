"""URL filters: rules first, then gradient-boosted trees on lexical features, in Spark's own functions only.

A rule (host, path, verdict) fits a URL if the URL's host is the rule's or one of its subdomains and the URL's path starts
with the rule's; of those that fit the longest wins. URLs that no rule fits are judged by trees fitted to labelled URLs (by
default those that a rule fits, with the rule's verdict).

Features: length of the URL, host and path; depth; labels of the host; share of digits; entropy of the characters;
parameters; hyphens; whether there is a fragment; and for each of the host's last label and last two labels the share of
blocked URLs among labelled ones, drawn towards the whole share, and their number. Suffixes are hashed to SLOTS slots, so
these statistics stay a row of 2 x 2 x SLOTS numbers however many hosts there are, and reach the rows by a broadcast of
that row. They are counted over one half of all labelled URLs (by hash); the trees are fitted to the other half, of which at
most about TRAIN_ROWS different URLs are taken, by hash. Copies of a URL count once in either.

Nulls: a null URL, or one without ://, has an empty host and path, fits no rule, and is judged by its features (zeros for a
null). Very long URLs are measured whole. Repeated rows get equal results. An empty table gives an empty result. Where all
labelled URLs agree their verdict is given to all others, and where there is none `allow`. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved

BLOCK, ALLOW = "block", "allow"
RULES = (("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW))
MOST_RULES = 1000  # they are one expression
SLOTS, WEIGHT = 1024, 20.0
TRAIN_ROWS, TREES, DEPTH = 20_000, 20, 4
LEXICAL = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "fragment")
SUFFIXES = {"last": 1, "last_two": 2}  # labels
FEATURES = [*LEXICAL, *(f"{name}_{what}" for name in SUFFIXES for what in ("share", "n"))]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (the ASCII-least of several), or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
    out = None
    for own, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(start))
        found = F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def entropy(text: Column) -> Column:
    """Bits per character; each different character is counted by what is left of the text without it."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    shares = F.transform(F.array_distinct(F.split(text, "")), share)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    whole = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(whole, r"(?s)\?([^#]*)", 1)
    count = lambda text, of: F.length(text) - F.length(F.translate(text, of, ""))
    labels = F.when(host == "", 0).otherwise(count(host, ".") + 1)
    digits = count(whole, "0123456789") / F.greatest(F.length(whole), F.lit(1))
    parameters = F.when(query == "", 0).otherwise(count(query, "&") + 1)
    numbers = (F.length(whole), F.length(host), F.length(path), count(path, "/"), labels, digits, entropy(whole), parameters, count(whole, "-"), F.contains(whole, F.lit("#")))
    return {k: c.cast("double") for k, c in zip(LEXICAL, numbers, strict=True)}


def suffixes(host: Column) -> dict[str, Column]:
    """Slots of the host's last label and last two labels."""
    slot = lambda labels: F.pmod(F.xxhash64(F.substring_index(host, ".", -labels), F.lit(labels)), F.lit(SLOTS)).cast("int")
    return {name: slot(labels) for name, labels in SUFFIXES.items()}


def _statistics(labelled: DataFrame) -> DataFrame:
    """One row: for each suffix feature an array of SLOTS (share of blocked, number of labelled URLs)."""
    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), F.col(name).alias("slot")) for i, name in enumerate(SUFFIXES)])).alias("s")
    counts = labelled.select(slots, "blocked").groupBy("s").agg(F.sum("blocked").alias("blocked"), F.count("*").alias("n")).select("s.*", "blocked", "n")
    total = counts.where("of = 0").agg((F.sum("blocked") / F.sum("n")).alias("share"))
    every = labelled.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).withColumn("of", F.explode(F.array(F.lit(0), F.lit(1))))
    known = every.join(counts, ["of", "slot"], "left").crossJoin(F.broadcast(total))  # one row
    prior, n = F.coalesce("share", F.lit(0.5)), F.coalesce("n", F.lit(0))
    known = known.select("of", F.struct("slot", ((F.coalesce("blocked", F.lit(0)) + prior * WEIGHT) / (n + WEIGHT)).alias("share"), F.log1p(n.cast("double")).alias("n")).alias("stat"))
    of = lambda i: F.array_sort(F.collect_list(F.when(F.col("of") == i, F.col("stat"))))
    return known.agg(*[of(i).alias(f"_{name}") for i, name in enumerate(SUFFIXES)])


def _fitted(train: DataFrame) -> GBTClassificationModel | None:
    """Trees, or nothing to tell apart."""
    if train.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=42).fit(train)


def _with_features(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """rows (url, host, path, last, last_two) with the model's vector."""
    rows = rows.crossJoin(F.broadcast(statistics))  # one row of bounded size
    at = {f"{name}_{what}": F.get(f"_{name}", F.col(name))[what] for name in SUFFIXES for what in ("share", "n")}
    rows = rows.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")) | at).drop("_last", "_last_two")
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def judged(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, label: Column | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id_col, host, path, rule, verdict and score (the trees' probability that a URL is to be blocked; null where a rule
    decides). label: a column of urls that is `block`, `allow` or null, instead of the rules' verdicts."""
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    rows = urls.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"), (label if label is not None else F.lit(None).cast("string")).alias("label"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumns(suffixes(F.col("host")))
    verdict = F.col("label") if label is not None else F.col("found.verdict")
    labelled = rows.where(verdict.isin(BLOCK, ALLOW) & F.col("url").isNotNull()).withColumn("blocked", (verdict == BLOCK).cast("double"))
    labelled = labelled.groupBy("url").agg(*[F.max(c).alias(c) for c in ("host", "path", "last", "last_two", "blocked")])
    place = F.pmod(F.xxhash64("url", F.lit("half")), F.lit(1 << 20))
    half = 1 << 19
    labelled = saved(labelled.withColumn("place", place), "urls")
    seen = labelled.agg(F.count("*").alias("n"), F.count_if(F.col("place") >= half).alias("train"), F.avg("blocked").alias("share")).first()
    rest = rows.where("found IS NULL")
    done = rows.where("found IS NOT NULL").select("id", "host", "path", "found.rule", "found.verdict", F.lit(None).cast("double").alias("score"))
    if not seen["n"] or seen["share"] in (0.0, 1.0):  # nothing to tell apart
        only = BLOCK if seen["n"] and seen["share"] == 1.0 else ALLOW
        other = rest.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(only).alias("verdict"), F.lit(None).cast("double").alias("score"))
        return done.unionByName(other).withColumnRenamed("id", id_col)
    statistics = saved(_statistics(labelled.where(F.col("place") < half)), "suffixes")
    some = labelled.where((F.col("place") >= half) & (F.col("place") < half + max(1, min(half, half * train_rows // max(seen["train"], 1)))))
    model = _fitted(saved(_with_features(some, statistics).select("features", F.col("blocked").alias("label")).coalesce(8), "train"))
    if model is None:
        scored = rest.withColumn("score", F.lit(None).cast("double")).withColumn("verdict", F.lit(BLOCK if seen["share"] > 0.5 else ALLOW))
    else:
        scored = model.transform(_with_features(rest, statistics)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
        scored = scored.withColumn("verdict", F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW))
    other = scored.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), "verdict", "score")
    return done.unionByName(other).withColumnRenamed("id", id_col)
