"""Queries of the evaluation operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, sequences, splits
from . import params
from .registry import query, rounded, table

CANDIDATES = {"configs": [{"id": "A", "parameters": {"scale": 1.0}}, {"id": "B", "parameters": [{"path": "scale", "value": 0.5}, {"path": "shift", "value": 0.1}]}, {"label": "C", "parameters": {"shift": 0.25}}]}
SCORED = """s AS (SELECT d.doc_id, length(d.text) % 97 / 50.0 AS wer, length(d.text) % 89 / 60.0 AS cer, CASE WHEN l.doc_id IS NULL THEN 'unassigned' WHEN d.doc_id % 10 < 6 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
EVERY = f"""{SCORED}, c(position, candidate, scale, shift) AS (VALUES (0, 'A', 1.0::DOUBLE, 0.0::DOUBLE), (1, 'B', 0.5, 0.1), (2, 'C', 1.0, 0.25)),
e AS (SELECT position, candidate, doc_id, split, scale * wer + shift AS wer, scale * cer AS cer FROM s, c),
r AS (SELECT *, row_number() OVER (PARTITION BY position, split ORDER BY wer DESC, doc_id) AS k FROM e),
m AS (SELECT position, candidate, split, count(*) AS n, avg(wer) AS wer_mean, avg(cer) AS cer_mean, (sum(wer) - sum(CASE WHEN k = 1 THEN wer END)) / (count(*) - 1) AS wer_drop1, (sum(cer) - sum(CASE WHEN k = 1 THEN cer END)) / (count(*) - 1) AS cer_drop1,
 max(CASE WHEN k = 1 THEN doc_id END) AS dropped, max(wer) AS dropped_wer FROM r GROUP BY position, candidate, split)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Documents with made-up rates and their split."""
    n, bucket = F.length("text"), F.col("doc_id") % 10
    chosen = table(spark, d, "labels").select("doc_id", F.when(bucket < 6, "train").when(bucket < 8, "val").otherwise("test").alias("split"))
    return splits.assigned(table(spark, d, "documents").select("doc_id", (n % 97 / 50.0).alias("w"), (n % 89 / 60.0).alias("c")), chosen, "doc_id")


def _rates(p: Column) -> Column:
    """What a candidate's scale and shift make of a document's rates."""
    value = lambda path, default: F.coalesce(F.try_element_at(p, F.lit(path)).cast("double"), F.lit(default))
    return F.struct((value("scale", 1.0) * F.col("w") + value("shift", 0.0)).alias("wer"), (value("scale", 1.0) * F.col("c")).alias("cer"))


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluated(_scored(spark, d), evaluation.candidates(CANDIDATES), _rates)


@query(f"""WITH {EVERY} SELECT (row_number() OVER (ORDER BY round(wer_mean, 9), position))::INTEGER AS rank, candidate, split AS primary_split, round(wer_mean, 6) AS wer_mean FROM m WHERE split = 'test'""")
def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Candidates on all documents, ranked on the test split."""
    return rounded(evaluation.ranking(evaluation.by_split(_evaluated(spark, d), ["position", "candidate"], "doc_id", "doc_id"), "test"), "wer_mean")


@query(f"""WITH {EVERY}, b AS (SELECT position FROM m WHERE split = 'train' ORDER BY round(wer_drop1, 9), position LIMIT 1)
SELECT candidate, split, n, round(wer_mean, 6) AS wer_mean, round(cer_mean, 6) AS cer_mean, round(wer_drop1, 6) AS wer_drop1, round(cer_drop1, 6) AS cer_drop1, dropped, round(dropped_wer, 6) AS dropped_wer FROM m WHERE position IN (SELECT position FROM b)""")
def two_phase_run(spark: SparkSession, d: str) -> DataFrame:
    """The candidate that is best on the training split, on every split."""
    _, metrics = evaluation.two_phase(_evaluated(spark, d), "train", "doc_id", "doc_id")
    return rounded(metrics.drop("error"), "wer_mean", "cer_mean", "wer_drop1", "cer_drop1", "dropped_wer")


GRID = {"scale": {"enabled": True, "min": 0.5, "max": 1.5, "steps": 3}, "shift": {"enabled": True, "selectedValues": ["0.3", "0.1"]}}


@query(f"""WITH {SCORED}, p(permutation, scale, shift) AS (VALUES (0::BIGINT, 0.5::DOUBLE, 0.3::DOUBLE), (1, 0.5, 0.1), (2, 1.0, 0.3), (3, 1.0, 0.1), (4, 1.5, 0.3), (5, 1.5, 0.1)),
e AS (SELECT permutation, doc_id, scale * wer + shift AS wer, scale * cer AS cer FROM s, p), r AS (SELECT *, row_number() OVER (PARTITION BY permutation ORDER BY wer DESC, doc_id) AS k FROM e),
a AS (SELECT permutation, count(*) AS n, (sum(wer) - sum(CASE WHEN k = 1 THEN wer END)) / (count(*) - 1) AS w, (sum(cer) - sum(CASE WHEN k = 1 THEN cer END)) / (count(*) - 1) AS c FROM r GROUP BY permutation)
SELECT permutation, n, round(w, 6) AS wer_drop1, round(c, 6) AS cer_drop1, (row_number() OVER (ORDER BY round(w, 9), permutation))::INTEGER AS rank FROM a""")
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    """Every permutation on all documents."""
    best = evaluation.grid_search(_scored(spark, d), params.dimensions(GRID), _rates, ["doc_id"])
    return rounded(best.select("permutation", "n", "wer_drop1", "cer_drop1", "rank"), "wer_drop1", "cer_drop1")


@query("""WITH t AS (SELECT page_id, lower(url) AS url, unnest(['header', 'body']) AS region FROM pages WHERE page_id % 3 <> 2),
g AS (SELECT page_id, lower(substr(url, 1, (length(url) - page_id % 4)::BIGINT)) AS guess, unnest(['header', 'body', 'footer']) AS region FROM pages),
m(region, label) AS (VALUES ('header', 'Header'), ('address', 'Address'), ('meta', 'Meta'), ('body', 'Body'), ('footer', 'Footer')),
j AS (SELECT p.page_id, CASE WHEN t.region = 'header' AND p.page_id % 2 = 0 THEN 'Body' ELSE m.label END AS label, coalesce(t.url, '') AS t, coalesce(g.guess, '') AS g
 FROM (SELECT page_id FROM pages WHERE page_id % 3 <> 2) p CROSS JOIN m LEFT JOIN t ON t.page_id = p.page_id AND t.region = m.region LEFT JOIN g ON g.page_id = p.page_id AND g.region = m.region),
s AS (SELECT page_id, CASE label WHEN 'Body' THEN 0.4 WHEN 'Address' THEN 0.2 WHEN 'Meta' THEN 0.15 WHEN 'Header' THEN 0.15 ELSE 0.1 END::DOUBLE AS w,
 CASE WHEN t = '' THEN CASE WHEN g = '' THEN 0.0 ELSE 1.0 END ELSE levenshtein(g, t)::DOUBLE / length(t) END AS cer, CASE WHEN g = t THEN 0.0 ELSE 1.0 END AS wer FROM j)
SELECT page_id, round(sum(w * cer) / sum(w), 6) AS cer, round(sum(w * wer) / sum(w), 6) AS wer FROM s GROUP BY page_id""")
def region_metrics(spark: SparkSession, d: str) -> DataFrame:
    """pages' addresses as the texts of their macro regions."""
    pages = table(spark, d, "pages").select("page_id", "url", F.lit(1000).alias("width"), F.lit(1400).alias("height"))
    truths = pages.where("page_id % 3 <> 2").select("page_id", F.explode(F.array(F.lit("header"), F.lit("body"))).alias("region"), F.col("url").alias("truth"))
    truths = truths.withColumn("label", F.when((F.col("region") == "header") & (F.col("page_id") % 2 == 0), "Body"))
    cut = F.substr("url", F.lit(1), (F.length("url") - F.col("page_id") % 4).cast("int"))
    texts = pages.select("page_id", F.explode(F.array(F.lit("header"), F.lit("body"), F.lit("footer"))).alias("region"), cut.alias("guess"))
    return rounded(evaluation.region_metrics(pages.drop("url"), truths, texts, "page_id")[1], "cer", "wer")


@query("""WITH w AS (SELECT l_orderkey AS o, l_linenumber AS k, l_quantity::INTEGER::VARCHAR AS t, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 3) - 1 AS r, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 5) - 1 AS c FROM lineitem),
n AS (SELECT o, max(r) + 1 AS rows, max(c) + 1 AS columns FROM w GROUP BY o), x AS (SELECT o, r, c, string_agg(t, ' ' ORDER BY k, t) AS t FROM w GROUP BY o, r, c),
g AS (SELECT o, rows, columns, r, unnest(range(0, columns)) AS c FROM (SELECT o, rows, columns, unnest(range(0, rows)) AS r FROM n)),
l AS (SELECT g.o, g.rows, g.columns, g.r, string_agg(coalesce(x.t, ''), chr(9) ORDER BY g.c) AS line, '| ' || string_agg(coalesce(x.t, ''), ' | ' ORDER BY g.c) || ' |' || CASE WHEN g.r = 0 THEN chr(10) || '| ' || string_agg('---', ' | ') || ' |' ELSE '' END AS m
 FROM g LEFT JOIN x ON x.o = g.o AND x.r = g.r AND x.c = g.c GROUP BY g.o, g.rows, g.columns, g.r)
SELECT o AS image_id, max(rows)::INTEGER AS n_rows, max(columns)::INTEGER AS n_columns, string_agg(m, chr(10) ORDER BY r) AS markdown, string_agg(line, chr(10) ORDER BY r) AS tsv FROM l GROUP BY o""")
def table_grids(spark: SparkSession, d: str) -> DataFrame:
    """Line items as words of a table."""
    words = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), "l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("text"),
        (F.col("l_partkey") % 5 * 40).cast("double").alias("x"), (F.col("l_suppkey") % 3 * 30).cast("double").alias("y"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"),
    )
    return evaluation.table_grid(words, "image_id", "l_linenumber").drop("grid")


@query("""SELECT user_id, round(coalesce(avg(CASE WHEN event_type = 'error' THEN value END), 0), 6) AS confidence FROM events GROUP BY user_id""")
def mean_confidences(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    rows = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", F.col("value")).alias("confidence"))
    return rounded(evaluation.mean_confidence(rows, ["user_id"]), "confidence")


@query("SELECT conv_id, (coalesce(max(turn), -1) + 1)::BIGINT AS next FROM conversations GROUP BY conv_id")
def next_turns(spark: SparkSession, d: str) -> DataFrame:
    """A23."""
    return evaluation.next_index(table(spark, d, "conversations"), ["conv_id"], "turn").select("conv_id", F.col("next").cast("long").alias("next"))


@query("SELECT DISTINCT conv_id, role FROM conversations")
def distinct_nested_names(spark: SparkSession, d: str) -> DataFrame:
    """Roles in the nested turns of a conversation."""
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", "turn")).alias("turns"))
    return evaluation.distinct_names(nested, ["conv_id"], "turns", "role")


@query("""WITH n AS (SELECT c_nationkey, list(c_name ORDER BY c_name) AS v FROM customer GROUP BY c_nationkey) SELECT c_nationkey, array_to_string(v[1:3], ', ') || CASE WHEN len(v) > 3 THEN ' +' || (len(v) - 3)::VARCHAR ELSE '' END AS preview FROM n""")
def name_previews(spark: SparkSession, d: str) -> DataFrame:
    """O11."""
    names = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_name")).alias("v"))
    return names.select("c_nationkey", evaluation.preview(F.col("v")).alias("preview"))


@query("""WITH p AS (SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(0, 4)) AS i) n WHERE embedding IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x + y, i) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY y - x, i) AS d FROM p)
SELECT vec_id, max(CASE WHEN s = 1 THEN x END) AS top_left, max(CASE WHEN d = 1 THEN x END) AS top_right, max(CASE WHEN s = 4 THEN x END) AS bottom_right, max(CASE WHEN d = 4 THEN x END) AS bottom_left FROM r GROUP BY vec_id""")
def corner_order(spark: SparkSession, d: str) -> DataFrame:
    """The first four pairs of a vector as corners."""
    e = F.col("embedding").cast("array<double>")
    points = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get(e, 2 * i).alias("x"), F.get(e, 2 * i + 1).alias("y")))
    rows = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", evaluation.ordered_corners(points).alias("c"))
    return rows.select("vec_id", F.col("c.topLeft.x").alias("top_left"), F.col("c.topRight.x").alias("top_right"), F.col("c.bottomRight.x").alias("bottom_right"), F.col("c.bottomLeft.x").alias("bottom_left"))


@query("""WITH a AS (SELECT p_partkey, p_size * 100 AS w, floor(p_retailprice)::BIGINT AS h FROM part), b AS (SELECT *, least(960.0::DOUBLE / greatest(w, h), 1.0) AS s FROM a), c AS (SELECT *, floor(w * s + 0.5)::BIGINT AS rw, floor(h * s + 0.5)::BIGINT AS rh FROM b)
SELECT p_partkey, round(s, 6) AS scale, rw AS width, rh AS height, (ceil(rw / 32.0) * 32)::BIGINT AS padded_width, (ceil(rh / 32.0) * 32)::BIGINT AS padded_height FROM c""")
def detection_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as images."""
    size = evaluation.detection_size(F.col("p_size") * 100, F.floor("p_retailprice"), 960)
    return rounded(table(spark, d, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.*"), "scale")


@query("""SELECT * FROM (VALUES ('tesseract-balanced', 'tesseract', 80, 'preprocessing.contrastBoost', '1.5,2,2.5', 1152::BIGINT), ('tesseract-balanced', 'tesseract', 80, 'preprocessing.dpiScaling.minCapitalHeightPx', '18,22,26,30', 1152),
('tesseract-balanced', 'tesseract', 80, 'preprocessing.dpiScaling.maxScale', '3,4,5', 1152), ('tesseract-balanced', 'tesseract', 80, 'preprocessing.clahe.enabled', 'true,false', 1152), ('tesseract-balanced', 'tesseract', 80, 'preprocessing.threshold.enabled', 'true,false', 1152),
('tesseract-balanced', 'tesseract', 80, 'output.minTextLength', '1,2', 1152), ('tesseract-balanced', 'tesseract', 80, 'output.minLineConfidence', '0.2,0.283,0.367,0.45', 1152),
('paddle-focus', 'paddleocr', 120, 'paddleocr.language', 'german,latin', 576), ('paddle-focus', 'paddleocr', 120, 'paddleocr.detThreshold', '0.2,0.283,0.367,0.45', 576), ('paddle-focus', 'paddleocr', 120, 'paddleocr.boxThreshold', '0.45,0.533,0.617,0.7', 576),
('paddle-focus', 'paddleocr', 120, 'paddleocr.detInputSize', '960,1280,1600', 576), ('paddle-focus', 'paddleocr', 120, 'paddleocr.unclipRatio', '1.6,1.85,2.1', 576), ('paddle-focus', 'paddleocr', 120, 'preprocessing.clahe.enabled', 'true,false', 576),
('recall-rescue', 'tesseract', 120, 'layout.enabled', 'true,false', 960), ('recall-rescue', 'tesseract', 120, 'fallback.enabled', 'true,false', 960), ('recall-rescue', 'tesseract', 120, 'rotation.enabled', 'true,false', 960), ('recall-rescue', 'tesseract', 120, 'preprocessing.threshold.enabled', 'true,false', 960),
('recall-rescue', 'tesseract', 120, 'preprocessing.threshold.type', 'otsu,adaptive', 960), ('recall-rescue', 'tesseract', 120, 'preprocessing.contrastBoost', '1.25,1.5,1.75,2,2.25', 960), ('recall-rescue', 'tesseract', 120, 'output.minTextLength', '1,2', 960),
('recall-rescue', 'tesseract', 120, 'output.minLineConfidence', '0.15,0.25,0.35', 960)) AS t(preset, engine, iterations, path, "values", space)""")
def tuning_presets(spark: SparkSession, d: str) -> DataFrame:
    """The presets' parameters, their values and the sizes of their spaces."""
    return params.presets(spark).withColumn("values", F.array_join("values", ","))


@query("""SELECT p_name || p_partkey::VARCHAR AS path, CASE p_partkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'boolean' ELSE 'enum' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE ELSE 0.0 END END::DOUBLE AS min,
CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN p_size + 2 ELSE 1 END END::DOUBLE AS max, CASE WHEN p_partkey % 3 = 0 THEN 3 END::INTEGER AS steps, CASE WHEN p_partkey % 3 = 2 THEN p_brand || ',' || p_type END AS selected FROM part""")
def parameters_switched_on(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a registry of parameters."""
    k, even = F.col("p_partkey") % 3, F.col("p_size") % 2 == 0
    registry = table(spark, d, "part").select(
        F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), F.when(k == 0, "number").when(k == 1, "boolean").otherwise("enum").alias("kind"),
        F.when(even, F.col("p_size").cast("double")).alias("low"), F.when(even, (F.col("p_size") + 2).cast("double")).alias("high"), F.array("p_brand", "p_type").alias("options"),
    )
    return params.switched_on(registry).withColumn("selected", F.when(F.col("kind") == "enum", F.array_join("selected", ",")))


WISHES = {"view": "running", "click": "paused", "purchase": "completed", "signup": "idle", "error": "error"}


@query("""WITH RECURSIVE w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'idle' ELSE 'error' END AS wish FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 'idle' AS state, 0 AS refused FROM w UNION ALL
 SELECT r.user_id, w.k, CASE WHEN f THEN wish ELSE state END, refused + CASE WHEN f THEN 0 ELSE 1 END FROM r, LATERAL (SELECT w.k, w.wish, list_contains(CASE r.state WHEN 'idle' THEN ['running'] WHEN 'running' THEN ['paused', 'completed', 'error', 'idle'] WHEN 'paused' THEN ['running', 'idle'] ELSE ['idle', 'running'] END, w.wish) AS f FROM w WHERE w.user_id = r.user_id AND w.k = r.k + 1) w)
SELECT user_id, max_by(state, k) AS state, max_by(refused, k)::INTEGER AS refused FROM r GROUP BY user_id""")
def run_states(spark: SparkSession, d: str) -> DataFrame:
    """Events as wishes of a user's run."""
    wish = F.create_map(*[F.lit(x) for pair in WISHES.items() for x in pair])[F.col("event_type")]
    return evaluation.run_states(table(spark, d, "events").withColumn("wish", wish), ["user_id"], ["ts", "event_id"], "wish")


@query("""SELECT user_id, event_id, (row_number() OVER w)::INTEGER AS place, coalesce(event_id - lag(event_id) OVER w > 1, false) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def message_order(spark: SparkSession, d: str) -> DataFrame:
    """Events as a user's numbered messages."""
    return evaluation.in_sequence(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "place", "gap")


@query("""SELECT d.doc_id, s.cer, s.wer FROM documents d LEFT JOIN (SELECT doc_id, quality::DOUBLE AS cer, toxic::DOUBLE AS wer FROM labels WHERE quality = 1) s ON s.doc_id = d.doc_id""")
def selected_scores(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the scores of one selected result."""
    scores = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("cer"), F.col("toxic").cast("double").alias("wer"))
    return evaluation.scored_images(table(spark, d, "documents").select("doc_id"), scores, F.col("cer") == 1, "doc_id")


@query("""SELECT conv_id, '[' || string_agg('{"turn":' || turn::VARCHAR || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS documents FROM conversations GROUP BY conv_id""")
def per_document_lists(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's turns with few of their fields, in order."""
    listed = evaluation.per_document(table(spark, d, "conversations"), ["conv_id"], "turn", ("turn", "role", "text"))
    return evaluation.serialised(listed, "documents", ("turn", "role")).select("conv_id", F.to_json("documents").alias("documents"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey))::INTEGER AS rank FROM orders) SELECT * FROM r WHERE rank <= 5""")
def best_five(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as results of a run."""
    return evaluation.archived(sequences.ranked(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"]))


@query("""WITH x AS (SELECT event_id, (user_id % 11) / 10.0 AS a, (event_id % 7) / 6.0 AS b FROM events)
SELECT event_id, round(least(2.5, greatest(0.5, floor((a * 2.0) / 0.25 + 0.5) * 0.25 + 0.5)), 6)::DOUBLE AS contrast, floor(floor((b * 50.0) / 5 + 0.5) * 5 + 10 + 0.5)::DOUBLE AS size FROM x""")
def continuous_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of the unit square as parameters."""
    points = table(spark, d, "events").select("event_id", F.array(F.col("user_id") % 11 / 10.0, F.col("event_id") % 7 / 6.0).alias("x"))
    of = evaluation.denormalised(points, [("contrast", 0.5, 2.5, 0.25, False), ("size", 10.0, 60.0, 5.0, True)])
    return of.select("event_id", F.round(F.col("parameters")["contrast"], 6).alias("contrast"), F.col("parameters")["size"].alias("size"))
