"""Recorded results of earlier runs, reproduced."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import maths as M
from scriptorium.operators import scoring, splits

# The scores of a recorded run's documents (name, cer, wer, length ratio, empty, very short) and what was recorded of them.
SCORES = [
    ("000011.jpg", 0.6035451794206658, 0.6636085626911316, 0.4898400345871163, False, False),
    ("000013.jpg", 1.0, 1.0, 0.0, True, True),
    ("000014.jpg", 0.8359861591695502, 0.8784530386740331, 0.18685121107266436, False, False),
    ("000015.jpg", 0.9799107142857143, 1.0, 0.022321428571428572, False, True),
    ("000017.jpg", 0.4581031307550645, 0.5073529411764706, 0.6054327808471455, False, False),
    ("IMG_0173.jpg", 0.31713900134952766, 0.38095238095238093, 0.6882591093117408, False, False),
    ("letter-0uuhv5.jpg", 0.17583081570996978, 0.2209737827715356, 0.8803625377643505, False, False),
    ("letter-3jg7f5.jpg", 0.22443890274314215, 0.20577617328519857, 0.7761845386533666, False, False),
    ("rechnung-schreiben-beispiel-muster.jpg", 0.6735930735930736, 0.8809523809523809, 0.574025974025974, False, False),
    ("signal-2026-01-12-111456.jpg", 0.3102776424744277, 0.48134328358208955, 0.821724305893814, False, False),
]
CUSTOM_WER, CUSTOM_CER, MEAN_WER, MEAN_CER, ROBUST = 0.57993472712058, 0.5087582910556817, 0.6219412544085221, 0.5578824619501135, 1.2834562106963334
# A recorded split of 31 documents (name, text length, width, height, rotation, type, split), and its seed.
SEED = 20260301
LETTER = "got-a-letter-from-the-school-today-informing-me-my-daughter-v0-"
MANIFEST = [
    ("000001.jpg", 7046, 1536, 2048, 0, "general_letter", "train"), ("000002.jpg", 16176, 2048, 1536, 0, "dense_page", "train"), ("000003.jpg", 42371, 1536, 2048, 0, "dense_page", "test"),
    ("000006.jpg", 17229, 2048, 1536, 0, "dense_page", "val"), ("000009.jpg", 1210, 1536, 2048, 0, "school_document", "val"), ("000010.jpg", 21617, 1536, 2048, 0, "dense_page", "train"),
    ("000011.jpg", 2324, 1536, 2048, 0, "official_letter", "train"), ("000012.jpg", 1136, 2048, 1536, 0, "school_document", "train"), ("000013.jpg", 577, 1536, 2048, 0, "shipping_document", "train"),
    ("000014.jpg", 1449, 1536, 2048, 0, "shipping_document", "val"), ("000015.jpg", 448, 2048, 1536, 90, "small_text", "train"), ("000016.jpg", 2278, 1536, 2048, 0, "official_letter", "test"),
    ("000017.jpg", 2186, 1536, 2048, 0, "official_letter", "train"), ("000018.jpg", 1542, 1536, 2048, 0, "official_letter", "val"), ("000019.jpg", 2201, 1536, 2048, 0, "official_letter", "train"),
    ("bill_screenshot.png", 465, 959, 1456, 0, "invoice_form", "train"), ("chunk.jpeg", 967, 1179, 584, 0, "official_letter", "train"), ("chunkchunk.png", 965, 1339, 310, 0, "official_letter", "val"),
    (LETTER + "0uuhv5xs1egg1.jpg", 1665, 1080, 1392, 0, "school_document", "train"), (LETTER + "3jg7f5xs1egg1.jpg", 1609, 1080, 1439, 0, "school_document", "train"),
    ("IMG_0173_2.jpg", 745, 768, 1024, 0, "invoice_form", "val"), ("IMG_0173_3.jpg", 745, 768, 1024, 0, "invoice_form", "train"), ("IMG_0173.jpg", 745, 768, 1024, 0, "invoice_form", "train"),
    ("rechnung-schreiben-beispiel-muster.jpg", 1169, 594, 837, 0, "invoice_form", "test"), ("signal-2025-10-11-162347_002.jpg", 1354, 1536, 2048, 0, "school_document", "test"),
    ("signal-2026-01-07-165410_002.jpg", 1542, 1536, 2048, 0, "official_letter", "train"), ("signal-2026-01-12-111456.jpg", 2063, 1536, 2048, 0, "invoice_form", "train"),
    ("signal-2026-01-21-161952_002.jpg", 1992, 1536, 2048, 0, "general_letter", "train"), ("signal-2026-01-30-094240_002.jpg", 954, 1536, 2048, 0, "general_letter", "train"),
    ("signal-2026-01-30-094240_003.jpg", 1231, 1536, 2048, 180, "school_document", "test"), ("signal-2026-01-30-094240.jpg", 503, 1536, 2048, 0, "small_text", "test"),
]


@pytest.fixture(scope="module")
def scores(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(SCORES)], "pos int, filename string, cer double, wer double, length_ratio double, is_empty boolean, is_very_short boolean")
    return rows.withColumns({"underproduction": M.clamp(1 - F.col("length_ratio"), 0.0, 1.0), "split": F.lit("all"), "run": F.lit(1)})


def test_recorded_scores(scores):
    robust = scoring.robust_score(scores, ["run"]).first()
    assert robust.score == pytest.approx(ROBUST, abs=1e-12) and robust.feasible
    split = scoring.split_metrics(scores).first()
    assert (split.wer_mean, split.cer_mean, split.wer_drop1, split.cer_drop1) == pytest.approx((MEAN_WER, MEAN_CER, CUSTOM_WER, CUSTOM_CER), abs=1e-12)
    assert (split.dropped, split.dropped_wer, split.n) == ("000013.jpg", 1.0, 10)
    dropped = scoring.drop_worst(scores, ["run"], ["pos"]).first()
    assert (dropped.wer_drop_max, dropped.wer_drop1, dropped.cer_drop1) == pytest.approx((CUSTOM_WER, CUSTOM_WER, CUSTOM_CER), abs=1e-12)


def test_recorded_split(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(MANIFEST)], "pos int, filename string, length int, width int, height int, rotation int, document_type string, split string")
    name = F.col("filename")
    classed = df.select("pos", "filename", splits.source_class(name).alias("source"), "document_type", splits.condition_class(name, F.col("rotation"), F.col("width"), F.col("height"), F.repeat(F.lit("x"), F.col("length"))).alias("condition"), "split", splits.script_class(name).alias("script"))
    rows = pd.DataFrame([r.asDict() for r in classed.orderBy("pos").collect()])
    assert rows["source"].value_counts().to_dict() == {"batch_capture": 15, "signal_mobile": 7, "digital_capture": 3, "phone_camera": 3, "web_photo": 2, "template_sample": 1}
    assert rows["condition"].value_counts().to_dict() == {"standard": 14, "dense_text": 4, "low_resolution": 4, "mobile_variant": 4, "digital_clean": 3, "rotated": 1, "upside_down": 1}
    assert rows["script"].eq("print").all() and len(rows.groupby(["source", "document_type", "condition"])) == 17
    assert splits.globally_balanced(rows.drop(columns="split"), seed=SEED)["split"].tolist() == rows["split"].tolist()
