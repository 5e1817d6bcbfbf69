"""Registered queries of this folder: each applies one operator, with its
production parameters, to the whole of its table. ``ORACLE`` has the same
result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm import merkle_manifest, secret_scan, url_rules, warc_fixity
from cataloom.llm.decontaminate import contained_items
from cataloom.llm.exact_dedup import exact_dedup
from cataloom.llm.fertility import quality
from cataloom.llm.line_windows import line_dedup
from cataloom.llm.near_dedup import near_dedup
from cataloom.llm.periodic_runs import periodic_runs
from cataloom.llm.sentencepiece_nbest import encode_nbest
from cataloom.llm.substring_dedup import substring_dedup
from cataloom.llm.tables import stored
from cataloom.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_nbest(_table(spark, sf_dir, "documents"), with_ids=0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("tag")


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the archives of ``pages`` against a replica with faults."""
    pages = _table(spark, sf_dir, "pages")
    manifest = stored(warc_fixity.placed(warc_fixity.leaves(warc_fixity.warc_records(pages))))
    found = warc_fixity.audit(manifest, warc_fixity.damaged_replica(pages, manifest))
    named = manifest.select("page_id", F.col("archive").alias("m_archive"), F.col("offset").alias("m_offset"), "length")
    return (found.join(named, (F.col("archive") == F.col("m_archive")) & (F.col("offset") == F.col("m_offset")), "left")
            .select("page_id", "archive", "offset", "length", "kind"))


def op5_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("tag")


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).drop("tag")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents")).drop("tag")


def _crc(doc_id):
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, folded from a text without newlines where the row's
    number says that it was tampered with."""
    bent = F.when(_crc("doc_id") % 2 == 0, merkle_manifest.leaf_digest(text=F.translate("text", "\n", "")))
    proof = merkle_manifest.proofs(merkle_manifest.manifest(_table(spark, sf_dir, "documents"), bent=bent))
    path = F.col("path")
    folded = merkle_manifest.fold(F.coalesce("row.bent", "leaf"), path)
    return (proof.select("row.doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(path).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with words from a place on repeated in rows whose number says so."""
    h = _crc("doc_id")
    own = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"),
                      F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("words"))
    n = F.size("words")
    own = own.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return own.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents")), with_text=False)
    more = lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best)
    said = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    best = F.col("best")
    return (found.withColumn("best", F.aggregate("runs", F.get("runs", F.lit(0)), more))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(F.transform(said, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
                    F.col("kept_sha256").alias("collapsed_sha256")))


def op13_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece_nbest, op2_substring_dedup, op3_toxicity, op4_warc_fixity, op5_benchmark_containment,
    op6_line_windows, op7_secret_scan, op8_exact_dedup, op9_url_rules, op10_near_dedup,
    op11_merkle_manifest, op12_periodic_runs, op13_fertility)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_sql() -> str:
    """Each kind's matches one after another: the text before a match has
    the lengths of the pieces and matches before it."""
    kinds = []
    for i, r in enumerate(secret_scan.RULES):
        regex = _quoted(r.regex)
        kinds.append(f"""
            SELECT doc_id, {i} AS rule, '{r.kind}' AS kind, {r.least} AS least, unnest(regexp_extract_all(text, {regex}, 0)) AS m,
                   unnest(regexp_extract_all(text, {regex}, {r.group})) AS g, unnest(string_split_regex(text, {regex})[:-2]) AS gap,
                   unnest(range(1, len(regexp_extract_all(text, {regex}, 0)) + 1)) AS k FROM t""")
    base = [i for i, r in enumerate(secret_scan.RULES) if r.base]
    count = ", ".join(f"CAST(count(*) FILTER (rule = {i}) AS BIGINT) AS n_{secret_scan.RULES[i].kind}" for i in base)
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        hits AS ({" UNION ALL ".join(kinds)}),
        placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, rule ORDER BY k) AS stop FROM hits),
        spans AS (SELECT doc_id, rule, stop - length(m) AS start, kind || ':' || CAST(stop - length(m) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS said
                  FROM placed WHERE length(g) >= least),
        per AS (SELECT doc_id, {count}, string_agg(said, ',' ORDER BY start, rule) AS spans,
                       string_agg(said, ',' ORDER BY start, rule) FILTER (rule <= {max(base)}) AS base FROM spans GROUP BY doc_id)
        SELECT t.doc_id, {", ".join(f"coalesce(n_{secret_scan.RULES[i].kind}, 0) AS n_{secret_scan.RULES[i].kind}" for i in base)},
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN per USING (doc_id)"""


def _url_sql() -> str:
    sites = sorted(url_rules.SITE_RULES, key=lambda r: -len(r.pattern))
    fit = lambda r: f"regexp_matches(host || path, {_quoted(url_rules.expression(r.pattern))})"
    site = " ".join(f"WHEN {fit(r)} THEN {_quoted(r.pattern[2:])}" for r in sites)
    first = " ".join(f"WHEN {fit(r)} THEN {_quoted(r.pattern)}" for r in url_rules.PATTERN_RULES)
    said = " ".join(f"WHEN {_quoted(r.pattern[2:])} THEN '{r.verdict}'" for r in sites)
    told = " ".join(f"WHEN {_quoted(r.pattern)} THEN '{r.verdict}'" for r in url_rules.PATTERN_RULES)
    parts = _quoted("(?s)^.*?://([^/?#]*)([^?#]*)")
    return f"""
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), {parts}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), {parts}, 2) AS path FROM pages),
        r AS (SELECT *, CASE {site} END AS rule, CASE {first} END AS first FROM p)
        SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE rule {said} END ELSE coalesce(CASE first {told} END, 'allow') END AS verdict,
               CASE WHEN rule IS NULL THEN first END AS pattern FROM r"""


def _crc_sql(text: str) -> str:
    """CRC-32 bit by bit, in the reflected polynomial."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda b: ascii(b)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


def _merkle_sql() -> str:
    """Both trees level by level, then each leaf up its path."""
    step = "sha256(array_to_string(ds[:{0}.pos % 3] || [cur] || ds[{0}.pos % 3 + 2:], '')), sib || array_to_string(ds[:{0}.pos % 3] || ds[{0}.pos % 3 + 2:], '')"
    return f"""
        WITH RECURSIVE l AS MATERIALIZED (
            SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
                   CASE WHEN {_crc_sql('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS bent FROM documents),
        p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
        lv AS (SELECT source, 0 AS lvl, pos, leaf AS d, n FROM p
               UNION ALL SELECT source, lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM lv WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
        sub AS MATERIALIZED (SELECT source, d AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
        tv AS (SELECT 0 AS lvl, pos, subroot AS d, n FROM sub
               UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM tv WHERE n > 1 GROUP BY lvl, pos // 3, n),
        runs AS MATERIALIZED (SELECT source, lvl, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM lv WHERE n > 1 GROUP BY ALL),
        truns AS MATERIALIZED (SELECT lvl, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM tv WHERE n > 1 GROUP BY ALL),
        f AS (SELECT source, pos AS at_, 0 AS lvl, pos, bent AS cur, '' AS sib FROM p
              UNION ALL SELECT f.source, at_, f.lvl + 1, f.pos // 3, {step.format('f')}
              FROM f JOIN runs r ON r.source IS NOT DISTINCT FROM f.source AND r.lvl = f.lvl AND r.run = f.pos // 3),
        f1 AS MATERIALIZED (SELECT source, at_, arg_max(cur, lvl) AS cur, arg_max(sib, lvl) AS sib FROM f GROUP BY ALL),
        g AS (SELECT f1.source, at_, 0 AS lvl, s.pos, cur, sib FROM f1 JOIN sub s ON s.source IS NOT DISTINCT FROM f1.source
              UNION ALL SELECT source, at_, g.lvl + 1, g.pos // 3, {step.format('g')} FROM g JOIN truns r ON r.lvl = g.lvl AND r.run = g.pos // 3),
        g1 AS (SELECT source, at_, arg_max(cur, lvl) AS cur, arg_max(sib, lvl) AS sib FROM g GROUP BY ALL),
        top AS (SELECT d AS root FROM tv WHERE n = 1)
        SELECT p.doc_id, p.leaf, subroot, root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = root AS verified
        FROM p JOIN sub ON sub.source IS NOT DISTINCT FROM p.source JOIN g1 ON g1.source IS NOT DISTINCT FROM p.source AND g1.at_ = p.pos CROSS JOIN top"""


#: Runs by comparing each word with the equal ones up to a quarter of the text further on.
_RUNS_SQL = f"""
        WITH t AS (SELECT doc_id, {_WORDS} AS w, {_crc_sql('doc_id::VARCHAR')} AS h FROM documents),
        u AS (SELECT doc_id, w, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a,
                     1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM t),
        d AS MATERIALIZED (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM u),
        pos AS MATERIALIZED (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
        eq AS (SELECT a.doc_id, b.i - a.i AS p, a.i FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
        isle AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM eq),
        per AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM isle GROUP BY doc_id, p, k HAVING count(*) + p >= greatest(6, 4 * p)),
        run AS MATERIALIZED (SELECT doc_id, start, length, min(p) AS period FROM per GROUP BY ALL),
        said AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM run GROUP BY doc_id),
        best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
        kept AS (SELECT pos.doc_id, string_agg(x, ' ' ORDER BY pos.i) AS kept FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY pos.doc_id)
        SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
               CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM d LEFT JOIN said USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLE = {
    "op11_merkle_manifest": _merkle_sql(),
    "op12_periodic_runs": _RUNS_SQL,
    "op4_warc_fixity": r"""
        WITH head AS (
            SELECT page_id, coalesce(html, '') AS html,
                   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
                   || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
                   || 'Content-Length: ' AS head FROM pages),
        rec AS (SELECT page_id, CAST(floor(page_id / 1000) AS BIGINT) AS archive,
                       CAST(octet_length(encode(head || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10))) AS BIGINT) AS length,
                       html FROM head),
        placed AS (SELECT *, CAST(sum(length) OVER (PARTITION BY archive ORDER BY page_id) - length AS BIGINT) AS "offset" FROM rec)
        SELECT page_id, archive, "offset", length, CASE WHEN page_id % 503 = 11 THEN 'missing' ELSE 'changed' END AS kind FROM placed
        WHERE page_id % 503 = 11 OR (page_id % 97 = 13 AND '#' || substr(html, 2) <> html) OR (page_id % 211 = 7 AND page_id % 97 <> 13 AND length(html) > 0)""",
    "op5_benchmark_containment": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
        ds AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (
            SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) AS s FROM d)),
        bs AS MATERIALIZED (SELECT DISTINCT item_id, s FROM (
            SELECT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) AS s FROM b)),
        n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
        f AS (SELECT doc_id, item_id, count(*) AS n_found FROM bs JOIN ds USING (s) GROUP BY ALL),
        short AS (SELECT DISTINCT item_id, w FROM b WHERE len(w) BETWEEN 1 AND 4),
        said AS (SELECT DISTINCT doc_id, unnest(flatten(list_transform(range(1, 5), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])))) AS w
                 FROM d WHERE EXISTS (FROM short))
        SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment FROM f JOIN n USING (item_id) WHERE 100 * n_found >= 80 * n_item
        UNION ALL SELECT doc_id, item_id, 1, 1, 1.0::DOUBLE FROM short JOIN said USING (w)""",
    "op6_line_windows": """
        WITH t AS MATERIALIZED (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
        win AS MATERIALIZED (
            SELECT doc_id, p, lines[p:p + 2] AS win FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM t)),
        later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS k FROM later),
        lined AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS k FROM t),
        kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.k) AS kept, count(*) AS n
                 FROM lined l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k WHERE g.k IS NULL GROUP BY l.doc_id)
        SELECT t.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM t LEFT JOIN kept USING (doc_id)""",
    "op7_secret_scan": _secret_sql(),
    "op9_url_rules": _url_sql(),
    "op2_substring_dedup": f"""
        WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
        win AS MATERIALIZED (
            SELECT doc_id, words[p:p + 12] AS win, p
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w)),
        least AS (SELECT win, min(doc_id) AS low FROM win GROUP BY win),
        gone AS (
            SELECT doc_id, list(DISTINCT k) AS ks
            FROM (SELECT win.doc_id, unnest(range(p, p + 13)) AS k FROM win JOIN least USING (win) WHERE low < win.doc_id)
            GROUP BY doc_id),
        spots AS (SELECT w.doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w),
        spot_gone AS (SELECT doc_id, unnest(ks) AS k FROM gone),
        kept AS (
            SELECT s.doc_id, string_agg(s.word, ' ' ORDER BY s.k) AS kept, count(*) AS n
            FROM spots s LEFT JOIN spot_gone g ON g.doc_id = s.doc_id AND g.k = s.k WHERE g.k IS NULL GROUP BY s.doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""",
    "op10_near_dedup": r"""
        WITH RECURSIVE t AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sh AS MATERIALIZED (
            SELECT DISTINCT doc_id, s FROM (
                SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
                    ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END) AS s FROM t)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS MATERIALIZED (
            SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        e AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT DISTINCT a AS start, a AS at_ FROM e UNION SELECT start, e.b FROM reach JOIN e ON e.a = reach.at_),
        comp AS (SELECT start AS doc_id, min(at_) AS c FROM reach GROUP BY start)
        SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, t.doc_id) AS component_id,
               t.doc_id = coalesce(c, t.doc_id) AS kept
        FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN comp ON comp.doc_id = t.doc_id""",
}
