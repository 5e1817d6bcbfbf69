"""Secrets by regular expressions behind a trigram inverted index.

Each rule's expression is read for the trigrams that every match must hold:
alternatives of trigram sets. Documents are posted under the trigrams that
rules ask for; a rule's candidates are the documents that are posted under
all trigrams of one of its alternatives, and only their texts run the
expression. A rule without such trigrams scans every text.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.tables import stored, texts


class Rule(NamedTuple):
    kind: str
    regex: str
    group: int = 0  # the group whose length counts
    least: int = 1
    base: bool = False


#: Kinds in the order in which spans of one start are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Beyond so many alternatives a part of an expression is taken as unknown.
_ALTERNATIVES = 64


def _weakest(alternatives):
    """Without those that ask for more than another one does."""
    sets = set(alternatives)
    return [a for a in sets if not any(b != a and b[1] == a[1] and b[0] <= a[0] for b in sets)]


def _end(alternatives):
    return _weakest([(grams | {run[i:i + 3] for i in range(len(run) - 2)}, "") for grams, run in alternatives])


def _read(nodes, alternatives):
    """Alternatives (trigrams so far, literal text now) after ``nodes``."""
    for kind, what in nodes:
        options = None
        if kind is sre.LITERAL:
            options = [chr(what).lower()]
        elif kind is sre.IN and all(k is sre.LITERAL for k, _ in what) and len(what) <= 8:
            options = sorted({chr(v).lower() for _, v in what})
        if options and len(options) * len(alternatives) <= _ALTERNATIVES:
            alternatives = [(grams, run + c) for grams, run in alternatives for c in options]
        elif kind is sre.SUBPATTERN:
            alternatives = _read(what[3], alternatives)
        elif kind is sre.BRANCH:
            alternatives = _weakest([x for branch in what[1] for x in _read(branch, alternatives)])
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and what[:2] == (0, 1):
            alternatives = _weakest([*alternatives, *_read(what[2], alternatives)])
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and what[0] >= 1:
            alternatives = _end(_read(what[2], alternatives))
        elif kind is not sre.AT:
            alternatives = _end(alternatives)
        if len(alternatives) > _ALTERNATIVES:
            alternatives = _end(alternatives)
    return alternatives


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Sets of lower-case trigrams: a match holds all of one of them. An
    empty list: nothing is mandatory."""
    sets = [grams for grams, _ in _end(_read(_parser.parse(regex), [(frozenset(), "")]))]
    return [] if any(not s for s in sets) or len(sets) > _ALTERNATIVES else sorted(sets, key=sorted)


def _measures(rule: Rule):
    """Lengths in code points: of the text between matches, of the matches
    and of the group that counts."""
    regex = F.lit(rule.regex)
    sizes = lambda a: F.transform(a, F.length)
    return F.arrays_zip(sizes(F.split("text", rule.regex, -1)).alias("gap"), sizes(F.regexp_extract_all("text", regex, F.lit(0))).alias("size"),
                        sizes(F.regexp_extract_all("text", regex, F.lit(rule.group))).alias("counts"))


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_assign,
    n_access, n_hex, base_sha256, spans.

    spans lists ``kind:start:end`` of every match by start and then kind, in
    code points, end excluded, comma-joined; matches of one kind are the
    leftmost ones and don't overlap, and those whose counted group is too
    short are dropped. base_sha256 is the hash of the spans of base kinds
    alone, listed likewise.

    A null or empty text has no spans. Null and repeated doc_ids are judged
    row by row. Other columns are ignored; an empty table gives no rows.
    """
    keyed = texts(docs).withColumn("tag", F.xxhash64("text"))
    queries = [(i, a, grams) for i, r in enumerate(rules) for a, grams in enumerate(trigram_query(r.regex))]
    indexed = {i for i, _, _ in queries}
    found = []
    if queries:
        lower, wanted = F.lower("text"), sorted({g for _, _, grams in queries for g in grams})
        # whether a text holds a trigram is asked for each trigram of the rules, in one generated pass
        posted = (keyed.select("doc_id", "tag", F.explode(F.array_compact(F.array(*[F.when(F.contains(lower, F.lit(g)), F.lit(g)) for g in wanted]))).alias("gram")))
        entries = F.array(*[F.struct(F.lit(g).alias("asked"), F.lit(i).alias("rule"), F.lit(a).alias("alternative"), F.lit(len(grams)).alias("needs"))
                            for i, a, grams in queries for g in sorted(grams)])
        asked = docs.sparkSession.range(1).select(F.inline(entries))  # a few rows for each rule
        # rows that repeat a document count once for each trigram
        lists = stored(posted.distinct())
        hits = (lists.join(F.broadcast(asked), F.col("gram") == F.col("asked")).groupBy("doc_id", "tag", "rule", "alternative", "needs")
                .agg(F.count(F.lit(1)).alias("has")).where("has = needs"))
        candidates = stored(hits.groupBy(F.col("doc_id").alias("c_id"), F.col("tag").alias("c_tag")).agg(F.collect_set("rule").alias("asks")))
        texts_of = keyed.join(candidates, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tag") == F.col("c_tag")))
        found.append(texts_of.select("doc_id", "tag", F.explode(F.array(*[
            F.struct(F.lit(i).alias("rule"), F.when(F.array_contains("asks", i), _measures(r)).alias("matches"))
            for i, r in enumerate(rules) if i in indexed])).alias("of")).select("doc_id", "tag", "of.*"))
    for i, r in enumerate(rules):
        if i not in indexed:
            found.append(keyed.where(F.col("text").rlike(r.regex)).select("doc_id", "tag", F.lit(i).alias("rule"), _measures(r).alias("matches")))
    whole = ["doc_id", "tag", "rule"]
    measured = found[0]
    for more in found[1:]:
        measured = measured.unionByName(more)
    measured = measured.where("size(matches) > 1").dropDuplicates(whole).select(*whole, F.posexplode("matches").alias("at", "match"))
    running = F.expr("sum(match.gap + coalesce(match.size, 0)) OVER (PARTITION BY doc_id, tag, rule ORDER BY at ROWS UNBOUNDED PRECEDING)")
    least = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (i, r.least)]), F.col("rule"))
    spans = (measured.withColumn("stop", running).where("match.size is not null").where(F.col("match.counts") >= least)
             .groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct((F.col("stop") - F.col("match.size")).alias("start"), "rule", "stop"))).alias("spans")))
    spans = stored(spans.select(F.col("doc_id").alias("s_id"), F.col("tag").alias("s_tag"), "spans"))
    names = F.array(*[F.lit(r.kind) for r in rules])
    base = [i for i, r in enumerate(rules) if r.base]
    joined = keyed.select("doc_id", "tag").join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("tag") == F.col("s_tag")), "left")
    joined = joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rule:int,stop:bigint>>")))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: F.get(names, s["rule"]) == kind)).cast("long")
    return joined.select("doc_id", *[number(rules[i].kind).alias(f"n_{rules[i].kind}") for i in base],
                         F.sha2(said(F.filter("spans", lambda s: s["rule"].isin(base))), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
