"""URL filters from association rules: FP-growth over the tokens of labelled URLs, matched by inverted index.

Everything runs as DataFrame operations and Spark ML; no Python code touches a row.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, ALLOW = "=block", "=allow"
WIDE = 12  # tokens of a basket up to which all its subsets may be mined
SALTS = 16  # parts of a hot token list

#: Fixed values: (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path. Host: between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there to ``?``, ``#`` or the end. A null url or one without ``://`` has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.withColumn("host", F.translate(host, upper, upper.lower())).withColumn("path", path)


def fixed_rule(rules=RULES) -> F.Column:
    """The rule (host and path as one text) that fits ``host`` and ``path``, the longest of several; else null.

    Rules are tried from the longest, so the first that fits is the answer. Ties in length cannot
    both fit, unless two rules are equal; then the first given holds.
    """
    out = F.lit(None).cast("string")
    for _, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(host + path)).otherwise(out)
    return out


def tokens() -> F.Column:
    """Distinct tokens of a split URL: host labels, host suffixes of two labels, path segments with digits folded, extension."""
    labels = F.transform(F.filter(F.split("host", r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    suffix = F.when(F.instr("host", ".") > 0, F.array(F.concat(F.lit("s:"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "0")))
    return F.array_distinct(F.concat(labels, suffix, segments))


def representatives(labelled: DataFrame, least: int) -> DataFrame:
    """(list_id, items): the tokens that can be in a rule, by token list. Of tokens that the labelled lists only hold
    together the smallest stands for all (the segments of a template are one item), and tokens of fewer than ``least``
    rows are in no frequent set."""
    lists = labelled.groupBy("list_id", "tokens").agg(F.count("*").alias("n"))
    held = lists.select("list_id", "n", F.explode("tokens").alias("token"))
    same = [F.count("*").alias("c"), F.bit_xor(F.xxhash64("list_id")).alias("x"), F.sum(F.col("list_id").cast("decimal(38,0)")).alias("s")]
    kinds = held.groupBy("token").agg(F.sum("n").alias("rows"), *same).filter(F.col("rows") >= least)
    chosen = kinds.groupBy("c", "x", "s").agg(F.min("token").alias("token")).select("token")
    return held.join(chosen, "token").groupBy("list_id").agg(F.array_sort(F.collect_list("token")).alias("items"))


def _bounded_rules(baskets: DataFrame, total: int, min_support: float, max_length: int) -> DataFrame:
    """Frequent sets of at most ``max_length`` tokens, alone and with a class, by pattern growth of bounded length: a basket
    in sorted order is a sequence, and its subsequences are its subsets."""
    ordered = baskets.select(F.transform(F.array_sort(F.col("items")), lambda x: F.array(x)).alias("sequence"))  # the classes come first
    sets = PrefixSpan(minSupport=min_support, maxPatternLength=max_length + 1, maxLocalProjDBSize=32_000_000).findFrequentSequentialPatterns(ordered)
    flat = sets.select(F.flatten("sequence").alias("items"), "freq").withColumn("class", F.when(F.col("items")[0].isin(BLOCK, ALLOW), F.col("items")[0]))
    alone = flat.filter(F.col("class").isNull() & (F.size("items") <= max_length)).select(F.col("items").alias("antecedent"), F.col("freq").alias("n"))
    both = flat.filter(F.col("class").isNotNull() & (F.size("items") > 1)).select(F.slice("items", 2, max_length).alias("antecedent"), "class", "freq")
    share = baskets.select(F.array_min(F.filter("items", lambda x: x.isin(BLOCK, ALLOW))).alias("class")).groupBy("class").agg((F.count("*") / total).alias("share"))
    confidence = F.col("freq") / F.col("n")
    rules = both.join(alone, "antecedent").join(share, "class")
    return rules.select("antecedent", F.array("class").alias("consequent"), confidence.alias("confidence"), (confidence / F.col("share")).alias("lift"), (F.col("freq") / total).alias("support"))


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.7, min_lift: float = 1.2, max_length: int = 4, wide: int = WIDE) -> DataFrame:
    """Rules (rule_id, items, size, verdict, confidence, support) from (tokens, bad boolean).

    FP-growth mines sets of representative tokens together with the class; rules keep a class as
    consequent, at most ``max_length`` tokens, and enough support, confidence and lift over the class
    share. Spark's FP-growth has no bound on the size of a set, so a basket of more than ``wide``
    representatives would give exponentially many: then the same sets of bounded size are mined by
    bounded pattern growth. Both give the same rules. No labelled rows give no rules.
    """
    spark = labelled.sparkSession
    ddl = "rule_id bigint, items array<string>, size int, verdict string, confidence double, support double"
    labelled = labelled.withColumn("list_id", F.xxhash64("tokens"))
    total = labelled.count()
    if not total:
        return spark.createDataFrame([], ddl)
    small = representatives(labelled, math.ceil(total * min_support))
    kept = F.coalesce("items", F.array().cast("array<string>"))
    verdict = F.array(F.when(F.col("bad"), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    baskets = labelled.join(small, "list_id", "left").select(F.concat(kept, verdict).alias("items"))
    if (small.agg(F.max(F.size("items"))).first()[0] or 0) > wide:
        found = _bounded_rules(baskets, total, min_support, max_length).filter(F.col("confidence") >= min_confidence)
    else:
        found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).associationRules
    rules = found.filter(F.col("consequent")[0].isin(BLOCK, ALLOW) & (F.size("antecedent") <= max_length) & (F.col("lift") >= min_lift))
    rules = rules.select(F.array_sort("antecedent").alias("items"), F.when(F.col("consequent")[0] == BLOCK, "block").otherwise("allow").alias("verdict"), "confidence", "support")
    return rules.select(F.xxhash64("items", "verdict").alias("rule_id"), "items", F.size("items").alias("size"), "verdict", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame, key: str, default: str = "allow") -> DataFrame:
    """(key, verdict) by the best matching rule, through an inverted index from token to rules.

    Distinct token lists are matched once, so a host with a third of the pages costs as much as a
    rare one. A list matches a rule when it holds all its tokens: the index join yields a row per
    shared token, and a rule that is met ``size`` times matches. Best: higher confidence, then more
    tokens, then ``block``. Without a match the verdict is ``default``.
    """
    index = rules.select("rule_id", "size", "verdict", "confidence", F.explode("items").alias("token"))
    lists = urls.select("tokens").distinct().withColumn("list_id", F.xxhash64("tokens"))
    met = lists.select("list_id", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    full = met.groupBy("tokens", "rule_id", "size", "verdict", "confidence").count().filter(F.col("count") == F.col("size"))
    best = full.groupBy("tokens").agg(F.max(F.struct("confidence", "size", "verdict")).getField("verdict").alias("mined"))
    return urls.join(best, "tokens", "left").select(key, F.coalesce("mined", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", label_key: str = "doc_id", rules=RULES, **mining) -> DataFrame:
    """(key, host, path, rule, verdict) of every row: the fixed rule's verdict, else the mined rules'.

    ``labels`` name rows of ``pages`` by number: quality 0 or toxic 1 is bad, null counts as good.
    Unlabelled rows take no part in mining. Null and repeated keys keep their rows.
    """
    rows = split_url(pages.select(F.col(key).alias("k"), F.col(url).alias("url")), "url").withColumn("rule", fixed_rule(rules)).withColumn("tokens", tokens())
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    marked = labels.groupBy(F.col(label_key).alias("k")).agg(F.max(bad).alias("bad"))
    mined = mine(rows.join(marked, "k").select("tokens", "bad"), **mining)
    open_rows = rows.select("tokens").distinct()
    verdicts = match(open_rows.withColumn("all", F.col("tokens")), mined, "all").withColumnRenamed("all", "tokens").withColumnRenamed("verdict", "mined")
    said = F.lit(None).cast("string")
    for verdict, host, path in rules:
        said = F.when(F.col("rule") == host + path, F.lit(verdict)).otherwise(said)
    # A template that a third of the pages share is one token list: its pages are dealt over salts, its one verdict is repeated.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)))
    verdicts = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.join(verdicts, ["tokens", "salt"], "left").select(F.col("k").alias(key), "host", "path", "rule", F.coalesce(said, "mined", F.lit("allow")).alias("verdict"))
