"""URL allow and block rules, found by equi-joins on short hash prefixes.

Each URL is expanded into its host suffixes times its path prefixes. Rules
and expressions meet on the first 32 bits of their SHA-256 digests; the full
digest then confirms, and the longest rule wins. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this many are broadcast (about 100 bytes each); beyond it, Spark shuffles both sides.
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def rules_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) pairs, such as ``("example.com/de/", "block")``, with host, path and digest."""
    rows = spark.createDataFrame(rules, "rule string, verdict string")
    slash = F.instr("rule", "/")
    host = F.when(slash > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule"))
    path = F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit(""))
    rows = rows.select("rule", F.col("verdict").alias("rule_verdict"), F.lower(host).alias("rule_host"), path.alias("rule_path"))
    digest = _digest(F.concat_ws("\x00", "rule_host", "rule_path"))
    return rows.withColumn("rule_digest", digest).withColumn("rule_prefix", _prefix(F.col("rule_digest")))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict), a row for each input row; other columns are ignored.

    Null URLs and those without ``://`` have empty host and path, match no
    rule and get ``default``. A rule fits its host and all subdomains if the
    path starts with the rule's path. The longest rule wins, then the longest
    host, then block, then the name. Repeated rows are judged once and
    repeated again; the partial aggregation by (id, url) also spreads a host
    that holds most rows. Only path lengths that some rule has are tried, so
    a very long URL gives no more expressions than labels times lengths.
    """
    lengths = [r[0] for r in rules.select(F.length("rule_path")).distinct().collect()] if rules.limit(1).count() else []
    once = pages.groupBy(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")).agg(F.count(F.lit(1)).alias("__n"))
    once = once.select("__id", "__url", "__n", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = F.array(*[F.lit(n).cast("int") for n in sorted(lengths)]) if lengths else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(tried, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat_ws("\x00", h, p))))
    wide = once.where(F.col("host") != "").select("__id", "__url", F.explode(expressions).alias("__e"))
    wide = wide.select("__id", "__url", _digest(F.col("__e")).alias("__d")).withColumn("__p", _prefix(F.col("__d")))
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    met = wide.join(F.broadcast(rules) if few else rules, F.col("__p") == F.col("rule_prefix"))
    met = met.where(F.col("__d") == F.col("rule_digest"))
    rank = F.struct(F.length("rule").alias("l"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"), F.col("rule").alias("rule"), F.col("rule_verdict").alias("verdict"))
    won = met.groupBy(F.col("__id").alias("__wid"), F.col("__url").alias("__wurl")).agg(F.max(rank).alias("__w"))
    out = once.join(won, F.col("__id").eqNullSafe(F.col("__wid")) & (F.col("__url") == F.col("__wurl")), "left")
    out = out.select("__id", "host", "path", F.col("__w.rule").alias("rule"), F.coalesce("__w.verdict", F.lit(default)).alias("verdict"), F.explode(F.expr("sequence(1L, __n)")).alias("__i"))
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", "verdict")
