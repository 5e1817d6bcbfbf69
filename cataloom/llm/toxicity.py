"""Toxicity by weak supervision.

Voters are lexicons and patterns. Lexicons hold the word forms and stems that
speak for the label in a bounded sample of labelled rows, dealt out so that
each voter has words of its own; pattern voters look at how a text is
written. A generative model explains how often every combination of votes
occurs over all documents, with the labels of the training rows as one more
voter that errs: it estimates the accuracy of each voter, finds voters that
agree more than their accuracies explain, and gives such groups a joint
table. A linear classifier then learns the model's posterior labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.tables import stored, texts
from cataloom.llm.words import chunks

#: Labelled rows that the lexicons and the classifier learn from, about.
LABELLED_ROWS = 20_000
#: Texts without a label that the classifier learns from by their posterior,
#: about, and what one of them counts beside a labelled one.
UNLABELLED_ROWS, UNLABELLED_WEIGHT = 20_000, 0.2
#: Words and stems of all lexicons, and lexicons.
LEXICON, LEXICONS = 256, 8
#: What speaks for a lexicon's entry, as a log-likelihood ratio against its
#: rows being toxic as often as others: beyond the logarithm of the number of
#: words and stems that are tried.
EVIDENCE = 15.0
_STEMS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+").findall
_MASKS = ("###", "***", "$$$", "&&&", "%%%")
PATTERNS = ("shouting", "exclaiming", "masking", "repeating")
#: A lexicon votes when its words are so many of a thousand; more voters
#: look at the words of all lexicons together.
LEXICON_RATE, DENSITIES = 2, (5, 10, 15)
VOTERS = LEXICONS + len(DENSITIES) + len(PATTERNS)
_HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)"


def entries(text: str) -> set[str]:
    """Lower-case words, and stems (with ``-`` after them) of longer ones."""
    words = {w.lower() for w in set(_WORD(text))}
    out = set(words)
    for n in _STEMS:
        out |= {w[:n] + "-" for w in words if len(w) > n}
    return out


def patterns(text: str) -> list[bool]:
    words = text.split()
    some = set(words)
    loud = sum(map(str.isupper, some))
    return [len(some) >= 3 and 2 * loud > len(some), "!!" in text, any(m in text for m in _MASKS), len(words) >= 20 and 4 * len(some) < len(words)]


def _count_entries(batches):
    both = (Counter(), Counter())
    for rows, _, _ in chunks(batches):
        for text, toxic in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            both[toxic].update(entries(text))
        if len(both[0]) + len(both[1]) > 1 << 20:
            yield from _counted(both)
            both = (Counter(), Counter())
    yield from _counted(both)


def _counted(both):
    names = sorted(set(both[0]) | set(both[1]))
    for lo in range(0, len(names), 50_000):
        own = names[lo:lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *[pa.array([c[w] for w in own], pa.int64()) for c in both]], ["entry", "clean", "toxic"])


def _voter(lexicon: list[str]):
    place = {w: i for i, w in enumerate(lexicon)}
    whole = {w for w in lexicon if not w.endswith("-")}
    stems = {n: {w[:-1] for w in lexicon if w.endswith("-") and len(w) == n + 1} for n in _STEMS}

    def vote(batches):
        for rows, _, _ in chunks(batches):
            out = {k: [] for k in ("votes", "hits", "rates", "rate")}
            for text in rows.column(1).to_pylist():
                words = Counter(_WORD(text))
                total, hit_words = sum(words.values()), 0
                by_entry: Counter = Counter()
                for word, n in words.items():
                    word = word.lower()
                    found = [word] if word in whole else []
                    found += [word[:k] + "-" for k, own in stems.items() if len(word) > k and word[:k] in own]
                    hit_words += n if found else 0
                    for entry in found:
                        by_entry[place[entry]] += n
                own = [0] * LEXICONS
                for i, n in by_entry.items():
                    own[i % LEXICONS] += n
                rate = 1000 * hit_words / max(total, 1)
                yes = [n and 1000 * n >= LEXICON_RATE * total for n in own] + [rate >= d for d in DENSITIES] + patterns(text)
                hits = sorted(by_entry)
                for k, v in zip(out, (sum(1 << i for i, y in enumerate(yes) if y), hits, [1000 * by_entry[i] / total for i in hits], rate)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(out["votes"], pa.int32()), pa.array(out["hits"], pa.list_(pa.int32())),
                                              pa.array(out["rates"], pa.list_(pa.float64())), pa.array(out["rate"], pa.float64())],
                                             ["doc_id", "tag", "votes", "hits", "rates", "rate"])
    return vote


class LabelModel(NamedTuple):
    """P(toxic), the groups of voters, P(votes of a group | label) for each,
    and P(label given 1 | label)."""

    prior: float
    groups: list[list[int]]
    tables: list[np.ndarray]
    said: np.ndarray

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(toxic) of vote combinations; label is 0, 1 or -1 for none."""
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for group, table in zip(self.groups, self.tables):
            log += np.log(table[:, _of_group(votes, group)]).T
        for y in (0, 1):
            log[:, y] += np.where(label < 0, 0, np.log(np.where(label == 1, self.said[y], 1 - self.said[y])))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))


def _of_group(votes: np.ndarray, group: list[int]) -> np.ndarray:
    return sum(((votes >> v) & 1) << i for i, v in enumerate(group))


def _estimate(votes, label, times, groups, rounds: int) -> LabelModel:
    """Expectation maximisation, with one added to every count. The first
    estimate is from the labelled rows alone, if there are any."""
    known = np.where(label < 0, 0.0, 1.0)
    rate = float((times * (label == 1)).sum() + 1) / float((times * known).sum() + 2)
    post = np.where(label < 0, rate, np.where(label == 1, 0.95, 0.05 * rate))
    for i in range(rounds + 1):
        weight = times * (known if i == 0 and known.any() else 1.0)
        both = [weight * (1 - post), weight * post]
        tables = []
        for group in groups:
            sizes = [np.bincount(_of_group(votes, group), b, 1 << len(group)) + 1.0 for b in both]
            tables.append(np.array([s / s.sum() for s in sizes]))
        said = np.array([((b * (label == 1)).sum() + 1) / ((b * known).sum() + 2) for b in both])
        said = np.clip(said, [0.0, 0.6], [0.4, 1.0])  # labels err, but not mostly
        model = LabelModel((both[1].sum() + 1) / (both[0].sum() + both[1].sum() + 2), groups, tables, said)
        post = model.posterior(votes, label)
    return model


def label_model(votes: np.ndarray, label: np.ndarray, times: np.ndarray, voters: int, rounds: int = 30, bound: float = 0.15, most: int = 4) -> LabelModel:
    """From how often (``times``) each combination of ``votes`` (a bit for
    each voter) and ``label`` occurs. Which voters lean on each other is
    judged on the labelled rows, where leaning voters can't pass for the
    label itself; the rates are then estimated on all rows."""
    model = _estimate(votes, label, times, [[v] for v in range(voters)], 0)
    known, post = np.where(label < 0, 0, times), model.posterior(votes, label)
    bits = np.array([(votes >> v) & 1 for v in range(voters)], float)
    agree = np.zeros((voters, voters))
    for y in (1 - post, post):
        n = max((known * y).sum(), 1e-9)
        off = bits - (bits * known * y / n).sum(1)[:, None]
        spread = np.sqrt((off**2 * known * y / n).sum(1)) + 1e-9
        seen = np.abs((off * known * y / n) @ off.T / np.outer(spread, spread))
        agree += np.where(seen > 4 / math.sqrt(n), seen, 0) / 2  # beyond chance
    group = {v: [v] for v in range(voters)}
    for a, b in sorted(((a, b) for a in range(voters) for b in range(a)), key=lambda p: (-agree[p], p)):
        if agree[a, b] > bound and group[a] is not group[b] and len(group[a]) + len(group[b]) <= most:
            group[a] += group[b]
            for v in group[b]:
                group[v] = group[a]
    groups = sorted({tuple(sorted(g)) for g in group.values()})
    return _estimate(votes, label, times, [list(g) for g in groups], rounds)


def _features(size: int):
    """A vector: how often a text has each entry, and entries at all, in a
    thousand words (as logarithms), and what the voters say."""
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    often = F.transform(number(max(size, 1)), lambda i: F.coalesce(F.log1p(F.get("rates", F.array_position("hits", i.cast("int")).cast("int") - 1)), F.lit(0.0)))
    said = F.transform(number(VOTERS), lambda i: F.call_function("getbit", F.col("votes"), i).cast("double"))
    return array_to_vector(F.concat(often, said, F.array(F.log1p("rate"), F.col("rate") / 10)))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score,
    predicted, posterior (of the label model, without the row's own label),
    tag (a hash of the text).

    Only labels (doc_id, toxic) of rows whose crc32(doc_id as text) mod 5 is
    not 0 are learnt from. A doc_id with two different labels, or a null one,
    counts as unlabelled. Every text gets a score, empty ones (no votes, no
    entries) too; a null text counts as empty, a null doc_id is not held out.
    Rows that repeat a doc_id are scored row by row, and a text that several
    labelled rows have is learnt from once, and so is a text that several
    unlabelled ones have. Very long texts count whole. Without labels of both
    kinds nothing can be learnt: every score is 0. Other columns are ignored;
    an empty table gives no rows.
    """
    plain = texts(docs).withColumn("tag", F.xxhash64("text"))
    learnt = stored(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
                    .where("doc_id is not null and toxic in (0, 1)").where(f"not {_HELD_OUT}").join(plain.select("doc_id"), "doc_id", "left_semi")
                    .groupBy(F.col("doc_id").alias("l_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other"))
    sizes = {r["toxic"]: r["count"] for r in learnt.groupBy("toxic").count().collect()}
    out = plain.select("doc_id", "tag", F.expr(_HELD_OUT).alias("held_out"))
    if len(sizes) < 2:
        return out.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("posterior"), "tag")
    # copies of a text speak once, whatever number of rows and ids they are under
    told = stored(plain.select("doc_id", "tag").join(learnt, F.col("doc_id") == F.col("l_id")).groupBy("tag")
                  .agg(F.min("l_id").alias("l_id"), F.min_by("toxic", "l_id").alias("toxic")), narrow=True)
    share = min(1.0, LABELLED_ROWS / max(told.count(), 1))
    # LABELLED_ROWS texts, about: small enough to broadcast
    sample = stored(told.where(F.pmod(F.xxhash64("tag", F.lit("drawn")), F.lit(1 << 30)) < int(share * (1 << 30))).withColumnRenamed("tag", "l_tag"), narrow=True)
    drawn = lambda rows, *columns: (rows.join(F.broadcast(sample), (F.col("doc_id") == F.col("l_id")) & (F.col("tag") == F.col("l_tag")))
                                    .groupBy("l_tag").agg(*[F.min(c).alias(c) for c in columns], F.min("toxic").alias("toxic")))
    counts = (drawn(plain, "text").select("text", "toxic")
              .mapInArrow(_count_entries, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    rows = sample.groupBy().pivot("toxic", [0, 1]).count().first()
    lift = F.log((F.col("toxic") + 0.5) / ((rows["1"] or 0) + 1)) - F.log((F.col("clean") + 0.5) / ((rows["0"] or 0) + 1))
    share_toxic = (rows["1"] or 0) / max((rows["0"] or 0) + (rows["1"] or 0), 1)
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((F.col("toxic") + F.col("clean")) * F.lit(max(p, 1e-9))))).otherwise(0.0)
    evidence = part(F.col("toxic"), share_toxic) + part(F.col("clean"), 1 - share_toxic)
    chosen = (counts.withColumn("lift", lift).where((F.col("lift") > math.log(4)) & (evidence >= EVIDENCE))
              .orderBy((F.col("lift") * F.sqrt("toxic")).desc(), "entry").limit(LEXICON))
    lexicon = [r["entry"] for r in chosen.collect()]

    voted = stored(plain.mapInArrow(_voter(lexicon), "doc_id long, tag long, votes int, hits array<int>, rates array<double>, rate double"))
    known = voted.join(learnt, F.col("doc_id") == F.col("l_id"), "left")
    seen = known.groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("label")).count().collect()  # 3 * 2**VOTERS rows at most
    votes, label, times = (np.array([r[c] for r in seen], np.int64) for c in ("votes", "label", "count"))
    model = label_model(votes, label, times, VOTERS)

    keys = np.unique(votes)
    blind = model.posterior(keys, np.full(len(keys), -1))
    heard = {y: model.posterior(keys, np.full(len(keys), y)) for y in (0, 1)}
    spark = docs.sparkSession
    posts = spark.createDataFrame([(int(k), float(b), float(heard[0][i]), float(heard[1][i])) for i, (k, b) in enumerate(zip(keys, blind))],
                                  "p_votes int, blind double, told0 double, told1 double")
    features = _features(len(lexicon))
    said = ["votes", "hits", "rates", "rate"]
    gold = (drawn(voted, *said).join(F.broadcast(posts), F.col("votes") == F.col("p_votes"))
            .select(*said, F.when(F.col("toxic") == 1, F.col("told1")).otherwise(F.col("told0")).alias("p"), F.lit(1.0).alias("counts")))
    # texts that no label speaks of, drawn by their hash: what the voters say of them is all that is known
    rest = voted.join(told.select(F.col("tag").alias("t_tag")), F.col("tag") == F.col("t_tag"), "left_anti").select("tag", *said)
    share = min(1.0, UNLABELLED_ROWS / max(int(times[label < 0].sum()), 1))
    weak = (rest.where(F.pmod(F.xxhash64("tag", F.lit("weak")), F.lit(1 << 30)) < int(share * (1 << 30)))
            .groupBy("tag").agg(*[F.min(c).alias(c) for c in said]).join(F.broadcast(posts), F.col("votes") == F.col("p_votes"))
            .select(*said, F.col("blind").alias("p"), F.lit(UNLABELLED_WEIGHT).alias("counts")))
    train = gold.unionByName(weak).select(features.alias("features"), "p", "counts")
    both = stored(train.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("p") * F.col("counts")).alias("weight")),
                                                             F.struct(F.lit(0.0).alias("label"), ((1 - F.col("p")) * F.col("counts")).alias("weight")))).alias("of"))
                  .select("features", "of.label", "of.weight").where("weight > 0"))
    line = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50, standardization=False).fit(both)
    scored = line.transform(voted.select("doc_id", "tag", "votes", features.alias("features")))
    score = F.get(vector_to_array("probability"), 1)
    return (scored.join(F.broadcast(posts), F.col("votes") == F.col("p_votes"), "left")
            .select("doc_id", F.expr(_HELD_OUT).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("blind").alias("posterior"), "tag"))
