"""Queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as T
from ..operators import geometry, scoring, sequences, sets, splits
from ..streaming import flows
from . import params
from .registry import ORACLES, QUERIES, query
from .registry import rounded as _round
from .registry import table as _t

__all__ = ["ORACLES", "QUERIES"]


def _turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as truth, the turn before it as guess."""
    return sequences.with_previous(_t(spark, d, "conversations"), ["conv_id"], ["turn"], "text", "guess").where(F.col("guess").isNotNull())


PAIRS = """
pairs AS (
  SELECT conv_id, turn, text, guess FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS guess FROM conversations) WHERE guess IS NOT NULL
)"""
NORMAL = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
# DuckDB's distance counts bytes, so each character of a pair, and each word that both of its texts hold, is one byte of its own: a pair
# of these tables has fewer than 127 of them.
CODED = """
n AS (SELECT conv_id, turn, role, {g} AS g, {t} AS t FROM pairs WHERE text IS NOT NULL),
k AS (SELECT *, list_distinct(string_split(g || t, '')) AS letters, list_filter(string_split(g, ' '), lambda w: w <> '') AS gw, list_filter(string_split(t, ' '), lambda w: w <> '') AS tw FROM n),
w AS (SELECT *, list_intersect(gw, tw) AS shared FROM k),
d AS (SELECT conv_id, turn, role, length(g) AS gl, length(t) AS tl, len(gw) AS gn, len(tw) AS tn,
 levenshtein(array_to_string(list_transform(string_split(g, ''), lambda c: chr(list_position(letters, c)::INTEGER)), ''), array_to_string(list_transform(string_split(t, ''), lambda c: chr(list_position(letters, c)::INTEGER)), '')) AS cd,
 levenshtein(array_to_string(list_transform(gw, lambda c: chr(coalesce(list_position(shared, c), -1)::INTEGER + 2)), ''), array_to_string(list_transform(tw, lambda c: chr(CASE WHEN list_contains(shared, c) THEN list_position(shared, c)::INTEGER + 2 ELSE 2 END)), '')) AS wd FROM w),
e AS (SELECT *, CASE WHEN tl = 0 THEN CASE WHEN gl = 0 THEN 0.0 ELSE 1.0 END ELSE cd::DOUBLE / tl END AS cer, CASE WHEN tn = 0 THEN CASE WHEN gn = 0 THEN 0.0 ELSE 1.0 END ELSE wd::DOUBLE / tn END AS wer,
 gl::DOUBLE / greatest(tl, 1) AS length_ratio, greatest(0.0, least(1.0, (tl - gl)::DOUBLE / greatest(tl, 1))) AS underproduction, gl = 0 AS is_empty, (gl < greatest(10, floor(0.15 * tl)) AND tl >= 20) AS is_very_short FROM d)
""".format(g=NORMAL.format("guess"), t=NORMAL.format("text"))
PAIRS = PAIRS.replace("SELECT conv_id, turn, text, guess", "SELECT conv_id, turn, role, text, guess")


@query(f"WITH {PAIRS}, {CODED} SELECT conv_id, turn, round(cer, 6) AS cer, gl::INTEGER AS guess_length, tl::INTEGER AS truth_length FROM e")
def char_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """F1, F3, F5 on whole turns, every character told apart."""
    rows = _turn_pairs(spark, d).where(F.col("text").isNotNull()).withColumns({"g": T.normalise(F.col("guess")), "t": T.normalise(F.col("text"))})
    return rows.select("conv_id", "turn", F.round(T.error_rate(F.levenshtein("g", "t"), F.length("t"), F.length("g")), 6).alias("cer"), F.length("g").alias("guess_length"), F.length("t").alias("truth_length"))


@query(f"""WITH {PAIRS}, {CODED} SELECT conv_id, turn, round(cer, 6) AS cer, round(wer, 6) AS wer, round(length_ratio, 6) AS length_ratio, round(underproduction, 6) AS underproduction, is_empty, is_very_short,
 gl::INTEGER AS guess_length, tl::INTEGER AS truth_length FROM e""")
def word_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """F2, F4, F6, F7 on whole turns."""
    return _round(scoring.scored_pairs(_turn_pairs(spark, d), "guess", "text"), "cer", "wer", "length_ratio", "underproduction").drop("text", "guess", "role")


@query(f"""WITH {PAIRS}, {CODED}, a AS (SELECT role, count(*) AS n, avg(0.6 * least(cer, 2.5) + 0.4 * least(wer, 2.5)) AS base, avg(underproduction) AS under, avg(greatest(0.0, least(2.0, length_ratio - 1))) AS "over",
 median(length_ratio) AS med, avg(is_empty::INT) AS em, avg(is_very_short::INT) AS sh FROM e GROUP BY role),
f AS (SELECT *, (em <= 0.25 AND med >= 0.45 AND sh <= 0.5 AND under <= 0.65) AS feasible FROM a),
s AS (SELECT *, round(base + 0.7 * under + 0.2 * "over" + 0.5 * greatest(0.0, least(1.2, (0.85 - med) / 0.85)) + 1.1 * em + 0.45 * sh + CASE WHEN feasible THEN 0 ELSE 0.8 END, 6) AS score FROM f)
SELECT role, n, round(base, 6) AS base, round(under, 6) AS under, round("over", 6) AS "over", round(med, 6) AS median_ratio, round(em, 6) AS empty_rate, round(sh, 6) AS short_rate, feasible, score,
 (row_number() OVER (ORDER BY score, role))::INTEGER AS rank FROM s""")
def eval_by_role(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: score all pairs and rank roles by their robust score."""
    scores = scoring.robust_score(scoring.scored_pairs(_turn_pairs(spark, d), "guess", "text"), ["role"])
    return sequences.ranked(_round(scores, "base", "under", "over", "median_ratio", "empty_rate", "short_rate", "score"), [], ["score", "role"])


LENGTHS = """
p AS (SELECT doc_id, source, length(text) AS t, lag(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS g FROM documents),
l AS (SELECT doc_id, source, g, t, round(g::DOUBLE / greatest(t, 1), 6) AS length_ratio, round(greatest(0.0, least(1.0, (t - g)::DOUBLE / greatest(t, 1))), 6) AS underproduction,
 g = 0 AS is_empty, (g < greatest(10, floor(0.15 * t)) AND t >= 20) AS is_very_short FROM p WHERE g IS NOT NULL)"""


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", "source", F.length("text").alias("t"))
    rows = sequences.with_previous_in_ranges(rows, ["source"], ["doc_id"], "t", "g").where(F.col("g").isNotNull())
    g, t = F.col("g"), F.col("t")
    return rows.select("doc_id", "source", F.round(T.length_ratio(g, t), 6).alias("length_ratio"), F.round(T.underproduction(g, t), 6).alias("underproduction"), (g == 0).alias("is_empty"), T.very_short(g, t).alias("is_very_short"))


@query(f"WITH {LENGTHS} SELECT doc_id, source, length_ratio, underproduction, is_empty, is_very_short FROM l")
def length_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """F7."""
    return _lengths(spark, d)


@query(f"""WITH {LENGTHS} SELECT source, count(*) AS n, round(avg(length_ratio), 6) AS mean_ratio, round(median(length_ratio), 6) AS median_ratio,
 round(avg(is_empty::INT), 6) AS empty_rate, round(avg(is_very_short::INT), 6) AS short_rate, round(avg(underproduction), 6) AS under FROM l GROUP BY source""")
def length_summary(spark: SparkSession, d: str) -> DataFrame:
    """A4, A9."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return _lengths(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("length_ratio"), 6).alias("mean_ratio"), F.round(F.median("length_ratio"), 6).alias("median_ratio"), share("is_empty").alias("empty_rate"), share("is_very_short").alias("short_rate"), F.round(F.avg("underproduction"), 6).alias("under"))


METRICS = """m AS (SELECT l_suppkey AS run, l_orderkey, l_linenumber, l_discount * 10 AS cer, l_tax * 20 AS wer, l_quantity / 25 AS length_ratio,
 greatest(0.0, least(1.0, 1 - l_quantity / 25)) AS underproduction, l_quantity < 2 AS is_empty, l_quantity < 5 AS is_very_short FROM lineitem)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Line items as scores of runs: one row for each document."""
    q = F.col("l_quantity")
    return _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), "l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("cer"), (F.col("l_tax") * 20).alias("wer"), (q / 25).alias("length_ratio"), M.clamp(1 - q / 25, 0.0, 1.0).alias("underproduction"), (q < 2).alias("is_empty"), (q < 5).alias("is_very_short"))


ROBUST = f"""WITH {METRICS}, a AS (SELECT run, count(*) AS n, avg(0.6 * least(cer, 2.5) + 0.4 * least(wer, 2.5)) AS base, avg(underproduction) AS under,
 avg(greatest(0.0, least(2.0, length_ratio - 1))) AS "over", median(length_ratio) AS med, avg(is_empty::INT) AS e, avg(is_very_short::INT) AS s FROM m GROUP BY run),
f AS (SELECT *, (e <= 0.25 AND med >= 0.45 AND s <= 0.5 AND under <= 0.65) AS feasible FROM a)
SELECT run, n, round(med, 6) AS median_ratio, feasible, round(base + 0.7 * under + 0.2 * "over" + 0.5 * greatest(0.0, least(1.2, (0.85 - med) / 0.85)) + 1.1 * e + 0.45 * s + CASE WHEN feasible THEN 0 ELSE 0.8 END, 6) AS score FROM f"""


@query(ROBUST)
def robust_score(spark: SparkSession, d: str) -> DataFrame:
    """A3."""
    return _round(scoring.robust_score(_metrics(spark, d), ["run"]).select("run", "n", "median_ratio", "feasible", "score"), "median_ratio", "score")


@query(f"""WITH {METRICS}, w AS (SELECT *, 0.7 * cer + 0.3 * wer AS mix, row_number() OVER (PARTITION BY run ORDER BY wer DESC, l_orderkey, l_linenumber) AS r FROM m),
a AS (SELECT run, count(*) AS n, sum(wer) AS sw, sum(cer) AS sc, sum(mix) AS sm, max(wer) AS mw, max(mix) AS mm, sum(CASE WHEN r = 1 THEN wer END) AS ww, sum(CASE WHEN r = 1 THEN cer END) AS wc FROM w GROUP BY run)
SELECT run, n, round(CASE WHEN n > 1 THEN (sw - mw) / (n - 1) ELSE sw END, 6) AS wer_drop_max, round(CASE WHEN n > 1 THEN (sw - ww) / (n - 1) ELSE sw END, 6) AS wer_drop1,
 round(CASE WHEN n > 1 THEN (sc - wc) / (n - 1) ELSE sc END, 6) AS cer_drop1, round(CASE WHEN n > 1 THEN (sm - mm) / (n - 1) ELSE sm END, 6) AS mixed_drop FROM a""")
def drop_worst_mean(spark: SparkSession, d: str) -> DataFrame:
    """A6, W14."""
    return _round(scoring.drop_worst(_metrics(spark, d), ["run"], ["l_orderkey", "l_linenumber"]), "wer_drop_max", "wer_drop1", "cer_drop1", "mixed_drop")


@query(f"""WITH {METRICS}, a AS (SELECT run, avg(wer) AS wer, avg(cer) AS cer FROM m GROUP BY run)
SELECT run, round(wer, 6) AS wer, round(cer, 6) AS cer, (row_number() OVER (ORDER BY round(wer, 6), run))::INTEGER AS rank FROM a""")
def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Runs by mean wer, ties by number, nulls last. Sums that decide a last digit go in stored order, as SQL's on one thread."""
    stored = {"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")}
    return sequences.ranked_in_ranges(scoring.rounded_means(_metrics(spark, d), ["run"], ["wer", "cer"], stored), [], ["wer", "run"], nulls_last=True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_results(spark: SparkSession, d: str) -> DataFrame:
    """O1, O2: the top-50 report."""
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("""SELECT event_id, user_id, value, min(value) OVER w AS best, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improves
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_best(spark: SparkSession, d: str) -> DataFrame:
    """W3."""
    return sequences.running_best(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "value", "best", "improves")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, ts, event_id) AS k FROM events) SELECT user_id, value, event_id FROM r WHERE k = 1""")
def best_result(spark: SparkSession, d: str) -> DataFrame:
    """The smallest value of each user, the earliest of equal ones."""
    rows = _t(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return scoring.best_row(rows.select("user_id", "value", "at", "event_id"), ["user_id"], "value", "at").select("user_id", "value", "event_id")


@query("""WITH n AS (SELECT event_id, user_id, value, row_number() OVER w AS k, coalesce(min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - value >= 0.003, true) AS up FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, k - max(CASE WHEN up THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM n)
SELECT event_id, user_id, since::INTEGER AS since, since >= 12 AS stop FROM s""")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """W12."""
    return sequences.early_stop(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "since", "stop")


@query("""WITH p AS (SELECT event_id, user_id, count(*) OVER w AS done, epoch_us(ts) / 1e6 - epoch_us(min(ts) OVER w) / 1e6 AS elapsed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, done, round(100.0 * done / 1000, 6)::DOUBLE AS percent, round(elapsed, 3) AS elapsed, round(elapsed / done * (1000 - done), 3) AS eta FROM p""")
def progress_eta(spark: SparkSession, d: str) -> DataFrame:
    """W10."""
    return _round(_round(sequences.progress(_t(spark, d, "events"), ["user_id"], "ts", 1000).select("event_id", "user_id", "done", "percent", "elapsed", "eta"), "percent"), "elapsed", "eta", digits=3)


@query("""SELECT event_id, event_type, round(value - first_value(value) OVER w, 6) AS vs_first, round(value - lag(value) OVER w, 6) AS vs_previous FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def phase_deltas(spark: SparkSession, d: str) -> DataFrame:
    """W11."""
    return _round(sequences.deltas(_t(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value").select("event_id", "event_type", "vs_first", "vs_previous"), "vs_first", "vs_previous")


@query("SELECT event_type, user_id, round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type, user_id")
def repeat_stability(spark: SparkSession, d: str) -> DataFrame:
    """W13."""
    return _round(sequences.stability(_t(spark, d, "events"), ["event_type", "user_id"], "value"), "mean", "spread")


@query("""WITH h AS (SELECT event_type, floor(value)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, bin, n, (sum(n) OVER w)::BIGINT AS running, round(sum(n) OVER w / sum(n) OVER (PARTITION BY event_type), 6)::DOUBLE AS share FROM h WINDOW w AS (PARTITION BY event_type ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def cumulative_histogram(spark: SparkSession, d: str) -> DataFrame:
    """W9, A21."""
    bins = _t(spark, d, "events").groupBy("event_type", F.floor("value").alias("bin")).agg(F.count("*").alias("n"))
    return _round(sequences.cumulative(bins, ["event_type"], ["bin"], "n"), "share")


@query("""WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value < 10 AS f FROM events),
i AS (SELECT user_id, k, k - sum(f::INT) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g, f FROM n)
SELECT user_id, min(k)::INTEGER AS first_row, count(*) AS length FROM i WHERE f GROUP BY user_id, g HAVING count(*) >= 2""")
def dark_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of small values."""
    return sequences.runs(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 10, least=2)


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def text_concat_ordered(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    return sequences.joined_text(_t(spark, d, "conversations"), ["conv_id"], "turn", "text", "\n")


@query("""SELECT conv_id, '| role | turn |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || role || ' | ' || turn::VARCHAR || ' |', chr(10) ORDER BY turn) AS markdown,
 'role' || chr(9) || 'turn' || chr(10) || string_agg(role || chr(9) || turn::VARCHAR, chr(10) ORDER BY turn) AS tsv FROM conversations GROUP BY conv_id""")
def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    """F16."""
    rows = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    grid = F.concat(F.array(F.array(F.lit("role"), F.lit("turn"))), F.transform("r", lambda s: F.array(s["role"], s["turn"].cast("string"))))
    return rows.select("conv_id", T.markdown(grid).alias("markdown"), T.tab_separated(grid).alias("tsv"))


SPLIT_SQL = "CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END"


@query(f"""WITH s AS (SELECT d.doc_id, length(d.text) % 97 / 50.0 AS wer, length(d.text) % 89 / 60.0 AS cer, CASE WHEN l.doc_id IS NULL THEN 'unassigned' ELSE {SPLIT_SQL.replace('doc_id', 'd.doc_id')} END AS split FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY wer DESC, doc_id) AS k FROM s)
SELECT split, count(*) AS n, round(avg(wer), 6) AS wer_mean, round(avg(cer), 6) AS cer_mean, round((sum(wer) - sum(CASE WHEN k = 1 THEN wer END)) / (count(*) - 1), 6) AS wer_drop1, round((sum(cer) - sum(CASE WHEN k = 1 THEN cer END)) / (count(*) - 1), 6) AS cer_drop1,
 max(CASE WHEN k = 1 THEN doc_id END) AS dropped, round(max(wer), 6) AS dropped_wer FROM r GROUP BY split""")
def split_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by split, with a default split for documents without an assignment."""
    n = F.length("text")
    scores = _t(spark, d, "documents").select("doc_id", (n % 97 / 50.0).alias("wer"), (n % 89 / 60.0).alias("cer"))
    bucket = F.col("doc_id") % 10
    chosen = _t(spark, d, "labels").select("doc_id", F.when(bucket < 6, "train").when(bucket < 8, "val").otherwise("test").alias("split"))
    out = scoring.split_metrics(splits.assigned(scores, chosen, "doc_id"), "doc_id", "doc_id")
    return _round(out, "wer_mean", "cer_mean", "wer_drop1", "cer_drop1", "dropped_wer")


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'rechnung|invoice|receipt|nettosumme|endbetrag|kundennummer') OR contains(lower(source), 'rechnung') THEN 'invoice_form'
 WHEN regexp_matches(lower(text), 'zeugnis|grundschule|school|gifted|klassenarbeit|elternversammlung') THEN 'school_document'
 WHEN regexp_matches(lower(text), 'beitragsservice|agentur für arbeit|techniker|darmkrebs|zahlungserinnerung|bundesagentur') THEN 'official_letter'
 WHEN regexp_matches(lower(text), 'lieferschein|packliste|bestell') THEN 'shipping_document'
 WHEN length(lower(text)) > 8000 THEN 'dense_page' WHEN length(lower(text)) < 900 OR regexp_matches(lower(source), 'chunk|bill_screenshot') THEN 'small_text' ELSE 'general_letter' END AS document_type,
 CASE WHEN contains(lower(source), 'handwriting') THEN 'handwriting' ELSE 'print' END AS script FROM documents""")
def classify_documents(spark: SparkSession, d: str) -> DataFrame:
    """P13."""
    return _t(spark, d, "documents").select("doc_id", splits.document_class(F.col("source"), F.col("text")).alias("document_type"), splits.script_class(F.col("source")).alias("script"))


@query("""WITH p AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42|' || doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY lang, source) AS n FROM documents),
q AS (SELECT *, floor(n * 0.6 + 1e-9) AS a, floor(n * 0.2 + 1e-9) AS b FROM p),
r AS (SELECT *, n - a - 2 * b AS rest, round(n * 0.6 - a, 9) AS ra, round(n * 0.2 - b, 9) AS rb FROM q),
t AS (SELECT *, a + CASE WHEN (ra >= rb AND rest >= 1) OR rest >= 3 THEN 1 ELSE 0 END AS train, b + CASE WHEN (ra >= rb AND rest >= 2) OR (ra < rb AND rest >= 1) THEN 1 ELSE 0 END AS val FROM r)
SELECT doc_id, lang, source, CASE WHEN k <= train THEN 'train' WHEN k <= train + val THEN 'val' ELSE 'test' END AS split FROM t""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Seeded, in proportion within language and source."""
    return splits.stratified(_t(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id").select("doc_id", "lang", "source", "split")


@query("""SELECT lang, quality, toxic, grouping(lang, quality, toxic)::BIGINT AS gid, count(*) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY GROUPING SETS ((lang), (quality), (toxic), ())""")
def count_by_sets(spark: SparkSession, d: str) -> DataFrame:
    """A11."""
    return splits.counts_by_sets(_t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", "quality", "toxic"), ["lang", "quality", "toxic"])


@query("""SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END)::BIGINT AS good, sum(CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END)::BIGINT AS unlabelled,
 min(n_chars) AS shortest, max(n_chars) AS longest, round(avg(n_chars), 6) AS mean FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def counters(spark: SparkSession, d: str) -> DataFrame:
    """A12-A14."""
    both = _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(_t(spark, d, "labels"), "doc_id", "left")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("SELECT doc_id, 'labelled' AS state FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'missing' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def semi_anti_required(spark: SparkSession, d: str) -> DataFrame:
    """J2, U3."""
    docs, labels = _t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels").select("doc_id")
    found, gone = sets.present_and_missing(docs, labels, "doc_id")
    return found.withColumn("state", F.lit("labelled")).unionByName(gone.withColumn("state", F.lit("missing")))


@query("""SELECT 'documents' AS dataset, text FROM documents UNION ALL SELECT 'benchmark' AS dataset, text FROM benchmark UNION ALL SELECT 'combined' AS dataset, text FROM documents UNION ALL SELECT 'combined' AS dataset, text FROM benchmark""")
def union_dataset_modes(spark: SparkSession, d: str) -> DataFrame:
    """Unions that keep duplicates."""
    return sets.dataset_modes({"documents": _t(spark, d, "documents").select("text"), "benchmark": _t(spark, d, "benchmark").select("text")})


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    """One row for each text, the first one."""
    return sets.first_of_each(_t(spark, d, "documents"), "text", "doc_id")


BOX_SQL = "b AS (SELECT l_orderkey AS image_id, l_linenumber AS box_id, (l_partkey % 100)::DOUBLE AS x, (l_suppkey % 80)::DOUBLE AS y, l_quantity AS width, l_quantity / 2 + 5 AS height, l_discount AS score FROM lineitem)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Line items as boxes on pages of orders."""
    q = F.col("l_quantity")
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("box_id"), (F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 80).cast("double").alias("y"), q.alias("width"), (q / 2 + 5).alias("height"), F.col("l_discount").alias("score"))


@query(f"""WITH {BOX_SQL}, p AS (SELECT a.image_id, a.box_id AS box_id_a, b2.box_id AS box_id_b, greatest(least(a.x + a.width, b2.x + b2.width) - greatest(a.x, b2.x), 0.0) * greatest(least(a.y + a.height, b2.y + b2.height) - greatest(a.y, b2.y), 0.0) AS o,
 a.width * a.height + b2.width * b2.height AS s FROM b a JOIN b b2 ON a.image_id = b2.image_id AND a.box_id < b2.box_id)
SELECT image_id, box_id_a, box_id_b, round(o / (s - o), 6) AS iou FROM p WHERE o / (s - o) > 0.3""")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J9, M4."""
    return _round(geometry.overlapping_pairs(_boxes(spark, d), "image_id", "box_id", 0.3), "iou")


NMS = f"""WITH RECURSIVE {BOX_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id, x, y, width, height) AS k FROM b),
r AS (SELECT DISTINCT image_id, 0::BIGINT AS k, []::STRUCT(b INTEGER, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS kept FROM b
 UNION ALL SELECT r.image_id, o.k, CASE WHEN len(list_filter(list_transform(r.kept, lambda q: struct_pack(mine := o.width * o.height, other := q.w * q.h, shared := greatest(least(o.x + o.width, q.x + q.w) - greatest(o.x, q.x), 0.0) * greatest(least(o.y + o.height, q.y + q.h) - greatest(o.y, q.y), 0.0))),
  lambda p: p.shared > 0.6 * (p.mine + p.other - p.shared) OR (p.mine > 0 AND p.shared >= 0.3 * p.mine) OR (p.other > 0 AND p.shared >= 0.3 * p.other))) = 0
  THEN list_append(r.kept, struct_pack(b := o.box_id::INTEGER, x := o.x, y := o.y, w := o.width, h := o.height)) ELSE r.kept END FROM r JOIN o ON o.image_id = r.image_id AND o.k = r.k + 1),
m AS (SELECT image_id, max_by(kept, k) AS kept FROM r GROUP BY image_id)
SELECT image_id, kept[i].b AS box_id, i::INTEGER AS place FROM (SELECT image_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM m)"""


@query(NMS)
def nms_keep(spark: SparkSession, d: str) -> DataFrame:
    """Greedy suppression at the reference's thresholds."""
    return geometry.non_maximum_suppression(_boxes(spark, d), "image_id", "box_id", *geometry.SUPPRESSION)


@query()
def xycut_order(spark: SparkSession, d: str) -> DataFrame:
    """I10, I11, J12; tests hold it against another form."""
    return geometry.ordered(_boxes(spark, d), "image_id", "box_id")


@query(f"WITH {BOX_SQL} SELECT image_id, box_id, (row_number() OVER (PARTITION BY image_id ORDER BY y, box_id))::INTEGER AS place FROM b")
def y_order(spark: SparkSession, d: str) -> DataFrame:
    """O4."""
    return sequences.ranked(_boxes(spark, d), ["image_id"], ["y", "box_id"], "place").select("image_id", "box_id", "place")


@query(f"""WITH {BOX_SQL}, r AS (SELECT image_id, y AS s, max(y + height) OVER (PARTITION BY image_id ORDER BY y, y + height ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM b),
g AS (SELECT image_id, s - r AS gap, (s + r) / 2 AS cut, row_number() OVER (PARTITION BY image_id ORDER BY s - r DESC, (s + r) / 2) AS k FROM r WHERE s > r)
SELECT image_id, gap, cut FROM g WHERE k = 1""")
def gap_cut(spark: SparkSession, d: str) -> DataFrame:
    """W4."""
    return sequences.largest_gap(_boxes(spark, d), ["image_id"], "y", "height")


@query(f"WITH {BOX_SQL} SELECT image_id, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM b GROUP BY image_id")
def box_hull(spark: SparkSession, d: str) -> DataFrame:
    """A18."""
    return geometry.hull(_boxes(spark, d), ["image_id"])


COVER = f"""WITH {BOX_SQL}, i AS (SELECT DISTINCT image_id FROM b), g AS (SELECT image_id, r.v AS "row", c.v AS col FROM i, (SELECT unnest(range(0, 8)) AS v) r, (SELECT unnest(range(0, 10)) AS v) c)
SELECT image_id, "row"::INTEGER AS "row", col::INTEGER AS col FROM g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.image_id = g.image_id AND g.col >= floor(b.x / 10) AND g.col < ceil((b.x + b.width) / 10) AND g."row" >= floor(b.y / 10) AND g."row" < ceil((b.y + b.height) / 10))"""


@query(COVER)
def uncovered_cells(spark: SparkSession, d: str) -> DataFrame:
    """Grid cells that no box touches."""
    return geometry.uncovered_cells(_boxes(spark, d), "image_id", 10, 10, 8)


@query()
def uncovered_areas(spark: SparkSession, d: str) -> DataFrame:
    """Free cells merged to rectangles."""
    return geometry.uncovered_areas(_boxes(spark, d), "image_id", 10, 100, 80, 0.02)


@query("""WITH m(ordinal, region, label, x0, y0, x1, y1) AS (VALUES (0, 'header', 'Header', 0.0, 0.0, 1.0, 0.15), (1, 'address', 'Address', 0.0, 0.12, 0.55, 0.38), (2, 'meta', 'Meta', 0.55, 0.12, 1.0, 0.38), (3, 'body', 'Body', 0.0, 0.32, 1.0, 0.88), (4, 'footer', 'Footer', 0.0, 0.85, 1.0, 1.0)),
p AS (SELECT page_id, (600 + length(url))::BIGINT AS width, (800 + length(html) % 100)::BIGINT AS height FROM pages)
SELECT page_id, width, height, ordinal::INTEGER AS ordinal, region, label, floor(x0::DOUBLE * width + 0.5)::BIGINT AS x, floor(y0::DOUBLE * height + 0.5)::BIGINT AS y, greatest(1, floor(x1::DOUBLE * width + 0.5) - floor(x0::DOUBLE * width + 0.5))::BIGINT AS box_width, greatest(1, floor(y1::DOUBLE * height + 0.5) - floor(y0::DOUBLE * height + 0.5))::BIGINT AS box_height,
 CASE label WHEN 'Body' THEN 0.4 WHEN 'Address' THEN 0.2 WHEN 'Meta' THEN 0.15 WHEN 'Header' THEN 0.15 ELSE 0.1 END::DOUBLE AS weight FROM p, m""")
def macro_regions(spark: SparkSession, d: str) -> DataFrame:
    """P24, P25."""
    pages = _t(spark, d, "pages").select("page_id", (600 + F.length("url")).cast("long").alias("width"), (800 + F.length("html") % 100).cast("long").alias("height"))
    return geometry.macro_regions(pages).withColumn("weight", geometry.region_weight(F.col("label")))


@query(f"""WITH {BOX_SQL}, w AS (SELECT image_id, CASE box_id WHEN 1 THEN 0.4 WHEN 2 THEN 0.2 WHEN 3 THEN 0.15 ELSE 0.1 END::DOUBLE AS weight, score * 10 AS cer, width / 50 AS wer FROM b)
SELECT image_id, round(sum(weight * cer) / sum(weight), 6) AS cer, round(sum(weight * wer) / sum(weight), 6) AS wer FROM w GROUP BY image_id""")
def weighted_regions(spark: SparkSession, d: str) -> DataFrame:
    """A8."""
    b = F.col("box_id")
    rows = _boxes(spark, d).withColumns({"weight": F.when(b == 1, 0.4).when(b == 2, 0.2).when(b == 3, 0.15).otherwise(0.1), "cer": F.col("score") * 10, "wer": F.col("width") / 50})
    return _round(scoring.weighted_rates(rows, ["image_id"]), "cer", "wer")


@query(f"""WITH {BOX_SQL} SELECT image_id, box_id, floor(greatest(2, least(90, x * 1.5)))::BIGINT AS x, floor(greatest(2, least(70, y * 1.5)))::BIGINT AS y, ceil(greatest(5, least(100 - floor(greatest(2, least(90, x * 1.5))) - 2, width * 1.5)))::BIGINT AS width,
 ceil(greatest(5, least(80 - floor(greatest(2, least(70, y * 1.5))) - 2, height * 1.5)))::BIGINT AS height FROM b WHERE score >= 0.02""")
def sanitised_boxes(spark: SparkSession, d: str) -> DataFrame:
    """P6, P7, P28."""
    s = F.lit(1.5)
    x, y, w, h = geometry.sanitised(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height"), s, s, F.lit(100), F.lit(80))
    return _boxes(spark, d).where("score >= 0.02").select("image_id", "box_id", x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


CLUSTERS = """WITH u AS (SELECT user_id, list_sort(list_distinct(list(value))) AS v, avg(value) AS mean FROM events GROUP BY user_id),
s AS (SELECT user_id, mean, list_reduce(v, lambda a, x: CASE WHEN len(a) = 0 OR x - a[-1] > 5 THEN list_append(a, x) ELSE a END, []::DOUBLE[]) AS starts,
 list_reduce(v, lambda a, x: CASE WHEN len(a) > 0 AND abs(x - a[-1].s / a[-1].n) <= 5 THEN list_append(a[:-2], struct_pack(s := a[-1].s + x, n := a[-1].n + 1)) ELSE list_append(a, struct_pack(s := x, n := 1::DOUBLE)) END, []::STRUCT(s DOUBLE, n DOUBLE)[]) AS c FROM u)
SELECT user_id, starts, list_transform(c, lambda p: round(p.s / p.n, 6)) AS centres, (list_position(list_transform(starts, lambda x: abs(x - mean)), list_min(list_transform(starts, lambda x: abs(x - mean)))) - 1)::INTEGER AS nearest FROM s"""


@query(CLUSTERS)
def cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cluster starts and running-mean centres of each user's values, and the cluster of their mean."""
    rows = _t(spark, d, "events").groupBy("user_id").agg(F.collect_set("value").alias("v"), F.avg("value").alias("mean"))
    return rows.select("user_id", sequences.anchored_clusters(F.col("v"), 5.0).alias("starts"), F.transform(sequences.mean_clusters(F.col("v"), 5.0), lambda x: F.round(x, 6)).alias("centres"), sequences.nearest(sequences.anchored_clusters(F.col("v"), 5.0), F.col("mean")).alias("nearest"))


DIMS = {"contrast": {"enabled": True, "min": 1.5, "max": 2.5, "steps": 3}, "psm": {"enabled": True, "selectedValues": ["3", "6"]}, "clahe": {"enabled": True}, "off": {"enabled": False}}


@query("""WITH c(i, v) AS (VALUES (0, '1.5'), (1, '2'), (2, '2.5')), p(i, v) AS (VALUES (0, '3'), (1, '6')), b(i, v) AS (VALUES (0, 'true'), (1, 'false'))
SELECT (c.i * 4 + p.i * 2 + b.i)::BIGINT AS permutation, 'clahe=' || b.v || '|contrast=' || c.v || '|psm=' || p.v AS key, 'clahe: ' || b.v || ', contrast: ' || c.v || ', psm: ' || p.v AS summary FROM c, p, b""")
def param_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid by index."""
    p = F.col("parameters")
    return params.grid(spark, params.dimensions(DIMS)).select("permutation", T.parameter_key(p).alias("key"), T.parameter_summary(p).alias("summary"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 1 THEN [p_size::DOUBLE] ELSE list_transform(range(0, p_size % 7), lambda i: floor((p_size + (p_retailprice - p_size) / greatest(p_size % 7 - 1, 1) * i) * 1000 + 0.5) / 1000) END AS points FROM part""")
def linspace_points(spark: SparkSession, d: str) -> DataFrame:
    """M1."""
    return _t(spark, d, "part").select("p_partkey", M.linspace(F.col("p_size"), F.col("p_retailprice"), F.col("p_size") % 7).alias("points"))


RBF = """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
k AS (SELECT vec_id, list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (v.embedding[i]::DOUBLE - q.e[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.e[i]::DOUBLE))) AS d2 FROM embeddings v, q)"""


@query(f"{RBF} SELECT vec_id, round(exp(-0.5 * d2 / 0.25), 6) AS kernel FROM k")
def rbf_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the first one, a single row of fixed size."""
    vectors = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    first = vectors.agg(F.min_by("e", "vec_id").alias("q"))
    return vectors.crossJoin(F.broadcast(first)).select("vec_id", F.round(M.rbf(F.col("e"), F.col("q")), 6).alias("kernel"))


EI_Z = "((10 - value) / s)"
ERF_SQL = "(1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-u * u))"


@query(f"""WITH a AS (SELECT event_id, value, 1 + user_id % 5 AS s FROM events), z AS (SELECT *, {EI_Z} AS z, abs({EI_Z}) / sqrt(2) AS u FROM a), t AS (SELECT *, 1 / (1 + 0.3275911 * u) AS t FROM z)
SELECT event_id, round((10 - value) * 0.5 * (1 + sign(z) * {ERF_SQL}) + s * exp(-0.5 * z * z) / sqrt(2 * pi()), 6) AS ei FROM t""")
def expected_improvement(spark: SparkSession, d: str) -> DataFrame:
    """M8, M9."""
    return _t(spark, d, "events").select("event_id", F.round(M.expected_improvement(F.col("value"), 1 + F.col("user_id") % 5, F.lit(10)), 6).alias("ei"))


@query("""WITH s AS (SELECT vec_id, k AS step, list_position(list_slice(embedding, k * 8 + 1, k * 8 + 8), list_max(list_slice(embedding, k * 8 + 1, k * 8 + 8))) - 1 AS idx FROM embeddings, (SELECT unnest(range(0, 8)) AS k) g),
p AS (SELECT *, lag(idx) OVER (PARTITION BY vec_id ORDER BY step) AS before FROM s)
SELECT vec_id, coalesce(string_agg(CASE WHEN idx <> 0 AND (before IS NULL OR idx <> before) AND idx <= 6 THEN substr('abcdef', idx::INTEGER, 1) END, '' ORDER BY step), '') AS text FROM p GROUP BY vec_id""")
def ctc_decode(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as eight steps of eight scores; class 7 is beyond the dictionary."""
    steps = _t(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, 8))).alias("step", "s"))
    return sequences.ctc_decode(steps.withColumn("idx", F.array_position("s", F.array_max("s")) - 1), ["vec_id"], "step", "idx", list("abcdef"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT event_id, 'a=' || user_id::VARCHAR || '|k=' || CASE WHEN user_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE 'base' END AS key FROM events""")
def config_merge(spark: SparkSession, d: str) -> DataFrame:
    """A base map and what overrides it."""
    rows = _t(spark, d, "events").withColumns({
        "base": F.create_map(F.lit("a"), F.col("user_id").cast("string"), F.lit("k"), F.lit("base")),
        "over": F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))).otherwise(F.create_map().cast("map<string,string>")),
    })
    return rows.select("event_id", T.parameter_key(params.merged_maps("base", "over")).alias("key"))


@query("""SELECT doc_id, (SELECT count(*) FROM range(0, 0)) AS none, lower(trim(source || '.TXT')) AS key, regexp_replace(lower(source || '.TXT'), '\\.[^.]+$', '') AS stem, printf('%.2f%%', (n_chars % 1000) / 10.0) AS percent, printf('iteration_%04d.json', (doc_id % 10000)::INTEGER) AS file,
 regexp_replace(source || '#1', '[^A-Za-z0-9_-]', '_', 'g') || '_s.json' AS safe, base64(encode(source)) AS b64 FROM documents""")
def name_functions(spark: SparkSession, d: str) -> DataFrame:
    """F8-F11, S14."""
    s = F.col("source")
    name = F.concat(s, F.lit(".TXT"))
    return _t(spark, d, "documents").select("doc_id", F.lit(0).cast("long").alias("none"), T.filename_key(name).alias("key"), T.stem(name).alias("stem"), T.percent(F.col("n_chars") % 1000 / 1000.0).alias("percent"), T.iteration_file((F.col("doc_id") % 10000).cast("int")).alias("file"), T.safe_name(F.concat(s, F.lit("#1")), F.lit("s"), ".json").alias("safe"), F.regexp_extract(T.data_url(F.lit("text/plain"), s.cast("binary")), "base64,(.*)$", 1).alias("b64"))


@query("""SELECT item_id, CASE WHEN strpos(trim(text), ' ') > 0 THEN split_part(trim(text), ' ', 1) END AS filename, CASE WHEN strpos(trim(text), ' ') > 0 THEN substr(trim(text), strpos(trim(text), ' ') + 1) END AS truth FROM benchmark""")
def first_space_split(spark: SparkSession, d: str) -> DataFrame:
    """F19, S5."""
    name, text = T.first_space_split(F.col("text"))
    return _t(spark, d, "benchmark").select("item_id", name.alias("filename"), text.alias("truth"))


@query("""SELECT doc_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(concat_ws('|', lang, source), ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS hash FROM documents""")
def fnv_hashes(spark: SparkSession, d: str) -> DataFrame:
    """F15."""
    return _t(spark, d, "documents").select("doc_id", T.fnv1a(F.concat_ws("|", "lang", "source")).alias("hash"))


@query("""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    """T10."""
    return _round(flows.tumbling(_t(spark, d, "events"), "5 minutes"), "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 60 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """T3."""
    return flows.sessions(_t(spark, d, "events"), "60 minutes")


@query("""WITH r AS (SELECT event_type, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, n, value AS best, event_id AS best_at FROM r WHERE k = 1""")
def best_so_far(spark: SparkSession, d: str) -> DataFrame:
    """T6."""
    return flows.best_so_far(_t(spark, d, "events"), "event_type", "value", "event_id")


@query("""SELECT o_custkey, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 6) AS layout, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 6) AS simple FROM orders GROUP BY o_custkey""")
def two_way_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two variants side by side."""
    return sets.side_by_side(_t(spark, d, "orders"), "o_custkey", "o_orderstatus", {"layout": "O", "simple": "F"}, "o_totalprice", 6)


@query("SELECT doc_id, CASE WHEN n_chars % 100 / 100.0 <= 0.05 THEN 'good' WHEN n_chars % 100 / 100.0 <= 0.15 THEN 'fair' ELSE 'poor' END AS cer_class, CASE WHEN n_chars % 100 / 100.0 <= 0.10 THEN 'good' WHEN n_chars % 100 / 100.0 <= 0.25 THEN 'fair' ELSE 'poor' END AS wer_class FROM documents")
def rate_classes(spark: SparkSession, d: str) -> DataFrame:
    """P15."""
    rate = F.col("n_chars") % 100 / 100.0
    return _t(spark, d, "documents").select("doc_id", sets.rate_class(rate, 0.05, 0.15).alias("cer_class"), sets.rate_class(rate, 0.10, 0.25).alias("wer_class"))


from . import queries_evaluation  # noqa: E402, F401  (registers its queries)
