"""URL rules in DataFrame functions only: host and path rules, then patterns found by their rarest literal token.

Both kinds of rules are tables of any size. A host rule is found by an equi-join for each number of labels that hosts of
rules have; a row takes part in each join once, so a URL with very many labels costs no more than another. Hosts of many rules are apart:
their URLs' path prefixes, of the lengths that such rules have, meet the rules by an equi-join too. A pattern
names literal tokens that every URL it matches has in it as whole tokens. Token counts over all URLs say which of them is
the rarest, and the pattern is filed under that one. The tokens of the URLs that no host rule decides fetch the
patterns filed under them by a join, only those run, and the URLs that one matches (each once) are joined back. Small
tables are broadcast by Spark's own size limit, larger ones are shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
HOST_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Patterns over the lower-cased URL, written in the syntax that Java and RE2 share, with their literal tokens: hosts of
#: casinos, bets, link farms, trackers, pills and adult pages, log-in pages, second and later pages of a list, programs.
PATTERNS = [
    (r"://([^/?#]*[.-])?casino[.-]", ["casino"]),
    (r"://([^/?#]*[.-])?(free|sure)-bets\.", ["bets"]),
    (r"://([^/?#]*\.)?spam-farm\.", ["spam", "farm"]),
    (r"://([^/?#]*\.)?ads?-track\.", ["track"]),
    (r"://([^/?#]*[.-])?(cheap|online)-pills\.", ["pills"]),
    (r"://([^/?#]*\.)?adult-[a-z0-9]+\.", ["adult"]),
    (r"://([^/?#]*[.-])?phishing[.-]", ["phishing"]),
    (r"/free-money(/|$|[?#])", ["free", "money"]),
    (r"/wp-login\.php($|[?#])", ["wp", "login", "php"]),
    (r"[?&]page=[0-9]+(&|#|$)", ["page"]),
    (r"[?&]affiliate_id=[0-9]+", ["affiliate", "id"]),
    (r"/download/[^?#]*\.exe($|[?#])", ["download", "exe"]),
]


#: Rules of a host that a URL tries one by one; hosts with more are searched by path prefix.
FEW_RULES = 64


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://([^/?#]*)([^?#]*)", 2), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://([^/?#]*)([^?#]*)", 3)


def tokens_of(url: Column) -> Column:
    """Runs of letters and digits of the lower-cased URL, each once."""
    return F.array_distinct(F.filter(F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def host_rule_table(spark: SparkSession, rules=HOST_RULES) -> DataFrame:
    """host, path, verdict rows of a list; a table stays as it is."""
    return rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")


def pattern_table(spark: SparkSession, patterns=PATTERNS) -> DataFrame:
    """pattern, tokens rows of a list, or of a table; ValueError where a pattern has no literal tokens, or one that is no run of a-z and 0-9."""
    if not isinstance(patterns, DataFrame):
        for pattern, _ in patterns:
            re.compile(pattern)
        patterns = spark.createDataFrame(list(patterns), "pattern string, tokens array<string>")
    good = (F.size("tokens") > 0) & F.forall("tokens", lambda t: F.coalesce(t.rlike("^[a-z0-9]+$"), F.lit(False)))
    bad = patterns.filter(~F.coalesce(good, F.lit(False))).head(1)
    if bad:
        raise ValueError(f"pattern without literal tokens: {bad[0]['pattern']}")
    # written, so that its size is known where a join is chosen
    return written(patterns.select("pattern", "tokens"), "url-patterns")


def with_host_rule(rows: DataFrame, rules: DataFrame, few: int = FEW_RULES) -> DataFrame:
    """Adds _rule, struct(n, rule, path, verdict) of the longest rule that fits ``host`` and ``path``, or null; ``block`` wins among equal rules.

    The rules of a host of ``few`` at most are one array. A suffix of d labels meets the rules whose host has d labels, for each d that occurs.
    Rules with nulls fit nothing, repeated ones count once; rows with an empty host fit rules with an empty host alone. Rows stay as they are, and an empty
    table of either kind gives rows without a rule.
    """
    rules = rules.filter("host is not null and path is not null and verdict is not null").select("host", "path", "verdict").distinct()
    rules = rules.withColumn("depth", F.size(F.split("host", r"\.")))
    one = F.struct((F.length("host") + F.length("path")).alias("n"), F.concat("host", "path").alias("rule"), "path", "verdict")
    # written, so that their size is known where a join is chosen
    sizes = written(rules.groupBy("depth", "host").agg(F.count(F.lit(1)).alias("k")), "host-sizes")
    some = sizes.filter(F.col("k") <= few).select("depth", "host")
    by_host = written(rules.join(some, ["depth", "host"]).groupBy("depth", "host").agg(F.collect_set(one).alias("rules")), "host-rules")
    found = [F.lit(None).cast("struct<n:int,rule:string,path:string,verdict:string>")]
    depths = sorted(r["depth"] for r in by_host.select("depth").distinct().collect())  # a row for each number of labels
    for d in depths:
        at = by_host.filter(F.col("depth") == d).select(F.col("host").alias(f"_h{d}"), F.col("rules").alias(f"_r{d}"))
        rows = rows.join(at, F.substring_index("host", ".", -d) == F.col(f"_h{d}"), "left")
        found.append(F.array_max(F.filter(F.col(f"_r{d}"), lambda r: F.startswith(F.col("path"), r["path"]))))
    rows = rows.withColumn("_rule", F.array_max(F.array(*found))).drop(*[f"_{x}{d}" for d in depths for x in "hr"])
    many = rules.join(sizes.filter(F.col("k") > few).select("depth", "host"), ["depth", "host"])
    many = written(many.select("depth", F.col("host").alias("_host"), F.col("path").alias("_path"), one.alias("_one")), "wide-hosts")
    if not many.head(1):
        return rows
    return by_prefix(rows, many)


def by_prefix(rows: DataFrame, many: DataFrame) -> DataFrame:
    """Improves _rule by rules (depth, _host, _path, _one) of hosts that have many: each distinct host and path once, by its prefixes of the lengths that occur."""
    pairs = written(rows.select("host", "path").distinct(), "hosts-paths")
    lengths = many.groupBy("depth").agg(F.sort_array(F.collect_set(F.length("_path"))).alias("_lengths")).collect()  # a row for each number of labels
    best = []
    for r in lengths:
        d, at = r["depth"], many.filter(F.col("depth") == r["depth"])
        near = pairs.withColumn("_host", F.substring_index("host", ".", -d)).join(at.select("_host").distinct(), "_host", "left_semi")
        fits = F.explode(F.filter(F.array(*map(F.lit, r["_lengths"])), lambda n: n <= F.length("path")))
        prefix = near.withColumn("_n", fits).withColumn("_path", F.substr(F.col("path"), F.lit(1), F.col("_n")))
        best.append(prefix.join(at.select("_host", "_path", "_one"), ["_host", "_path"]).groupBy("host", "path").agg(F.max("_one").alias("_one")))
    best = reduce(DataFrame.unionByName, best).groupBy("host", "path").agg(F.max("_one").alias("_one"))
    best = best.select(F.col("host").alias("_bh"), F.col("path").alias("_bp"), "_one")
    rows = rows.join(best, (F.col("host") == F.col("_bh")) & (F.col("path") == F.col("_bp")), "left")
    return rows.withColumn("_rule", F.greatest("_rule", "_one")).drop("_bh", "_bp", "_one")


def rarest_tokens(urls: DataFrame, url_col: str, patterns: DataFrame) -> DataFrame:
    """pattern, token: the literal token that the fewest URLs have, the first by name where several are as rare."""
    literal = patterns.select(F.explode("tokens").alias("t")).distinct()
    counts = urls.select(F.explode(tokens_of(F.col(f"`{url_col}`"))).alias("t")).join(literal, "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    each = patterns.select("pattern", F.explode("tokens").alias("t")).join(counts, "t", "left")
    return each.groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t")).alias("m")).select("pattern", F.col("m.t").alias("token"))


def matched(urls: DataFrame, index: DataFrame) -> DataFrame:
    """The distinct URLs (column ``url``) that a pattern matches: each runs the patterns filed under one of its tokens, and no others."""
    fetched = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token")).join(index, "token")
    return fetched.filter(F.rlike(F.translate("url", UPPER, LOWER), F.col("pattern"))).select("url").distinct()


def judge_urls(pages: DataFrame, url_col: str = "url", host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """The rows with host, path, rule, verdict and by (host, pattern or default).

    ``host_rules`` (host, path, verdict) and ``patterns`` (pattern, tokens) are lists or tables of any number of rows. A host
    rule decides where one fits, the longest first. Else a pattern that matches blocks the URL, and without one it is
    allowed. A pattern's tokens have to be whole tokens of every URL it matches: this is not checked, and a URL without the rarest of them is not tested by
    the pattern. A null URL is allowed (by default); one without ``://`` has an empty host and path and is tested by the patterns alone,
    unless a rule has an empty host. URLs are read whole, however long. Rows stay as they are, repeated ones too; equal URLs have equal verdicts. An empty table
    gives no rows. Input columns named like an output column are replaced.
    """
    spark = pages.sparkSession
    url = F.col(f"`{url_col}`")
    keep = [c for c in pages.columns if c not in {"host", "path", "rule", "verdict", "by"}]
    names = [f"c{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = with_host_rule(rows, host_rule_table(spark, host_rules))
    decided, rest = ruled.filter("_rule is not null"), ruled.filter("_rule is null")
    index = written(rarest_tokens(pages, url_col, pattern_table(spark, patterns)), "url-index")
    blocked = written(matched(rest.filter("url is not null"), index), "url-matched").select(F.col("url").alias("_blocked"))
    rest = rest.join(blocked, F.col("url") == F.col("_blocked"), "left")
    out = decided.withColumn("_blocked", F.lit(None).cast("string")).unionByName(rest)
    hit = F.col("_blocked").isNotNull()
    by = F.when(F.col("_rule").isNotNull(), "host").when(hit, "pattern").otherwise("default")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(hit, "block").otherwise("allow"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), by.alias("by"))
