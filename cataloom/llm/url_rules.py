"""URL verdicts from pattern rules indexed by their rarest literal token.

A rule is a pattern over host and path: plain text, ``*`` for any characters,
``^`` for a separator or the end, and a leading ``||`` for the start of the
host or of one of its labels. A token of a rule is a run of letters and
digits that the pattern delimits on both sides, so that every URL it fits has
the same run among its own tokens. Each rule is posted under the one of its
tokens that the fewest URLs have; a URL runs the regular expressions of the
rules posted under its tokens. Rules without a token run on every URL: they
are part of the plan, some to an expression.

Rules are a table; their expressions and tokens are derived in it, and the
index is a stored table, so a list of any length leaves the plan as it is.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm.tables import stored


class Rule(NamedTuple):
    verdict: str
    pattern: str
    site: bool = False  # reported by name, and stronger than any other pattern


def site(verdict: str, host: str, path: str) -> Rule:
    return Rule(verdict, f"||{host}{path}", True)


SITE_RULES = (
    site("allow", "com", "/"),
    site("block", "example.com", "/en/"),
    site("allow", "www.example.com", "/en/"),
    site("block", "net", "/es/"),
    site("block", "net", "/fr/"),
)
#: Words of spam, adult and tracking sites, as labels of a host or parts of a path.
PATTERN_RULES = (
    Rule("block", "||cheap-pills."), Rule("block", "||adult-x."), Rule("block", "||ads-track."),
    Rule("block", "||casino."), Rule("block", "||doubleclick."), Rule("block", "/porn/"), Rule("block", "/xxx/"),
    Rule("block", "/wp-login.php^"), Rule("block", "/wp-admin/"), Rule("block", "/cgi-bin/"), Rule("block", "*viagra*"),
)
#: Bytes of rules up to which the index is broadcast.
BROADCAST_BYTES = 64 << 20
#: Token-free rules that are asked for by one expression first.
_FREE_BLOCK = 64
_SEPARATORS = "[^A-Za-z0-9]+"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def expression(pattern: str) -> str:
    """The pattern as a regular expression over host and path."""
    head, rest = (r"^(?:[^/]*\.)?", pattern[2:]) if pattern.startswith("||") else ("", pattern)
    said = {"*": "(?s:.*)", "^": "(?:[^A-Za-z0-9%_.-]|$)"}
    return head + "".join(said.get(c) or (c if c.isalnum() else f"\\{c}") for c in rest)


def literal_tokens(pattern: str) -> list[str]:
    """Runs of letters and digits with a delimiter, not ``*``, on both sides."""
    rest = pattern[2:] if pattern.startswith("||") else pattern
    text = ("." if pattern.startswith("||") else "*") + rest + "*"
    return sorted({m[1] for m in re.finditer(r"(?<=[^A-Za-z0-9*])([A-Za-z0-9]+)(?=[^A-Za-z0-9*])", text) if m[1].isascii()})


def split_url(url):
    """(host, path) columns: the host after the first ``://``, A-Z
    lower-cased, and the path up to ``?`` or ``#``; empty without one."""
    said = F.coalesce(url.cast("string"), F.lit(""))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(said, _PARTS, 1), capitals, capitals.lower()), F.regexp_extract(said, _PARTS, 2)


def _columns(pattern):
    """``expression`` and ``literal_tokens`` of a column of patterns."""
    anchored = F.startswith(pattern, F.lit("||"))
    rest = F.when(anchored, F.substring(pattern, 3, 1 << 30)).otherwise(pattern)
    said = F.regexp_replace(rest, r"([\\.\[\]{}()+?$|])", r"\\$1")
    said = F.replace(F.replace(said, F.lit("*"), F.lit("(?s:.*)")), F.lit("^"), F.lit("(?:[^A-Za-z0-9%_.-]|$)"))
    delimited = F.concat(F.when(anchored, F.lit(".")).otherwise(F.lit("*")), rest, F.lit("*"))
    tokens = F.array_distinct(F.regexp_extract_all(delimited, F.lit("(?<=[^A-Za-z0-9*])([A-Za-z0-9]+)(?=[^A-Za-z0-9*])")))
    return F.concat(F.when(anchored, F.lit(r"^(?:[^/]*\.)?")).otherwise(F.lit("")), said), tokens


def rule_table(spark: SparkSession, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """(strength, verdict, pattern, site) of rules given as lists: earlier
    pattern rules are stronger than later ones, longer site rules than
    shorter ones and than any pattern rule."""
    rules = [*reversed(pattern_rules), *sorted(site_rules, key=lambda r: (len(r.pattern), r.pattern))]
    if not rules:
        return spark.range(0).selectExpr("id as strength", "'' as verdict", "'' as pattern", "false as site")
    entries = [F.struct(F.lit(i).cast("long").alias("strength"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(r.site).alias("site"))
               for i, r in enumerate(rules)]
    return spark.range(1).select(F.inline(F.array(*entries)))


def _free_fit(rules: list[tuple[int, str]], said):
    """The greatest strength of (strength, expression) rules that fit, null without one."""
    blocks = [F.lit(None).cast("long")]
    for i in range(0, len(rules), _FREE_BLOCK):
        block = rules[i:i + _FREE_BLOCK]
        any_ = said.rlike("|".join(f"(?:{regex})" for _, regex in block))
        each = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(regex).alias("regex")) for n, regex in block])
        blocks.append(F.when(any_, F.array_max(F.transform(each, lambda r: F.when(F.rlike(said, r["regex"]), r["n"])))))
    return F.array_max(F.array(*blocks))


def judge_urls(pages: DataFrame, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES, rules: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path,
    rule, verdict, pattern.

    Of the site rules that fit (host or a subdomain of it, path starts with
    the rule's) the longest wins and is named in rule; without one, the first
    pattern rule that fits gives the verdict and is named in pattern; without
    any, the verdict is allow. Instead of the two lists, ``rules`` may be a
    table of any length as ``rule_table`` makes it: strength (long; the
    greatest that fits wins; null or repeated ones are a ValueError), verdict,
    pattern, site (null: no); rows without verdict or pattern are left out.
    Its rules without a token are collected, as they are part of the plan.

    A null url, or one without ``://``, has an empty host and path and fits
    no site rule. Urls of any length are judged whole. Null and repeated
    page_ids are judged row by row. Other columns are ignored; an empty table
    gives no rows.
    """
    rules = rule_table(pages.sparkSession, site_rules, pattern_rules) if rules is None else rules
    regex, tokens = _columns(F.col("pattern"))
    ruled = stored(rules.where("pattern is not null and verdict is not null").select(
        F.col("strength").cast("long").alias("strength"), "verdict", "pattern", F.coalesce("site", F.lit(False)).alias("site"), regex.alias("regex"), tokens.alias("tokens")))
    n, distinct, size = ruled.agg(F.count(F.lit(1)), F.count_distinct("strength"), F.sum(F.octet_length("regex") + F.octet_length("pattern") + 64)).first()
    if n != distinct:
        raise ValueError("each rule needs a strength of its own")
    small = (lambda side: F.broadcast(side)) if (size or 0) <= BROADCAST_BYTES else (lambda side: side)
    host, path = split_url(F.col("url"))
    urls = (pages.select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("row", F.monotonically_increasing_id())
            .withColumn("tokens", F.array_distinct(F.split(F.concat("host", "path"), _SEPARATORS))))
    wanted = ruled.select(F.explode("tokens").alias("token")).distinct()
    count = urls.select(F.explode("tokens").alias("token")).join(small(wanted), "token", "left_semi").groupBy("token").count()
    rarest = (ruled.select("strength", F.explode("tokens").alias("token")).join(count, "token", "left")
              .groupBy("strength").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token")).alias("least")))
    posted = stored(ruled.select("strength", "regex").join(rarest, "strength").select(F.col("least.token").alias("posted"), "strength", "regex"))
    free = [(r["strength"], r["regex"]) for r in ruled.where("size(tokens) = 0").select("strength", "regex").orderBy("strength").collect()]
    fetched = (urls.withColumn("free", _free_fit(free, F.concat("host", "path"))).withColumn("token", F.explode("tokens")).drop("tokens")
               .join(small(posted), F.col("token") == F.col("posted"), "left"))
    fits = F.when(F.col("regex").isNotNull() & F.expr("rlike(concat(host, path), regex)"), F.col("strength"))
    best = fetched.groupBy("row", "page_id", "host", "path", "free").agg(F.max(fits).alias("fit")).withColumn("best", F.greatest("free", "fit"))
    named = ruled.select("strength", "verdict", "pattern", "site")
    return best.join(small(named), F.col("best") == F.col("strength"), "left").select(
        "page_id", "host", "path", F.when(F.col("site"), F.substring("pattern", 3, 1 << 20)).alias("rule"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(~F.col("site"), F.col("pattern")).alias("pattern"))
