"""Classification and reproducible splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import RANGE, matched, ranked_in_ranges

SPLITS = ("train", "val", "test")
# Name and text patterns of the classes, the first match wins.
SOURCES = ((r"^signal-", "signal_mobile"), (r"^img_", "phone_camera"), (r"^\d{6}\.", "batch_capture"), (r"screenshot|^chunk", "digital_capture"), (r"got-a-letter", "web_photo"), (r"rechnung-schreiben", "template_sample"))
DOCUMENT_TYPES = (
    (r"rechnung|invoice|receipt|nettosumme|endbetrag|kundennummer", "rechnung", "invoice_form"),
    (r"zeugnis|grundschule|school|gifted|klassenarbeit|elternversammlung", None, "school_document"),
    (r"beitragsservice|agentur für arbeit|techniker|darmkrebs|zahlungserinnerung|bundesagentur", None, "official_letter"),
    (r"lieferschein|packliste|bestell", None, "shipping_document"),
)
DENSE, SMALL, LOW = 8000, 900, 850
# What a name holds, ends with or begins with, by condition.
DIGITAL_HOLDS, DIGITAL_ENDS, DIGITAL_BEGINS, VARIANTS = "screenshot", ".png", "chunk", ("_002", "_003")


def source_class(name: Column) -> Column:
    out = F.lit("other")
    for pattern, kind in reversed(SOURCES):
        out = F.when(F.lower(name).rlike(pattern), kind).otherwise(out)
    return out


def document_class(name: Column, text: Column) -> Column:
    """One case-insensitive search a class, over the text as it is."""
    f, t = F.lower(name), F.coalesce(text, F.lit(""))
    out = F.when(F.length(t) > DENSE, "dense_page").when((F.length(t) < SMALL) | f.rlike("chunk|bill_screenshot"), "small_text").otherwise("general_letter")
    for pattern, in_name, kind in reversed(DOCUMENT_TYPES):
        out = F.when(t.rlike(f"(?iu){pattern}") | (f.contains(in_name) if in_name else F.lit(False)), kind).otherwise(out)
    return out


def condition_class(name: Column, rotation: Column, width: Column, height: Column, text: Column) -> Column:
    f, least = F.lower(name), F.least(F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0)))
    return (
        F.when(rotation.isin(90, 270), "rotated").when(rotation == 180, "upside_down").when(f.contains(DIGITAL_HOLDS) | f.endswith(DIGITAL_ENDS) | f.startswith(DIGITAL_BEGINS), "digital_clean")
        .when(f.contains(VARIANTS[0]) | f.contains(VARIANTS[1]), "mobile_variant").when((least > 0) & (least < LOW), "low_resolution").when(F.length(F.coalesce(text, F.lit(""))) > DENSE, "dense_text").otherwise("standard")
    )


def script_class(name: Column) -> Column:
    return F.when(F.lower(name).contains("handwriting"), "handwriting").otherwise("print")


def quotas(counts: DataFrame, key: list[str], ratios: tuple[float, float, float]) -> DataFrame:
    """Largest-remainder quotas of ``n`` rows a group: columns train, val, test."""
    total = sum(ratios)
    exact = [F.col("n") * (r / total) for r in ratios]
    floors = [F.floor(e + 1e-9) for e in exact]
    rest = F.col("n") - sum(floors[1:], floors[0])
    order = F.array_sort(F.array(*[F.struct((-(F.round(e - f, 9))).alias("r"), F.lit(i).alias("i")) for i, (e, f) in enumerate(zip(exact, floors, strict=True))]))
    place = lambda i: F.array_position(F.transform(order, lambda s: s["i"]), F.lit(i))
    return counts.select(*key, "n", *[(f + F.when(place(i) <= rest, 1).otherwise(0)).cast("long").alias(s) for i, (f, s) in enumerate(zip(floors, SPLITS, strict=True))])


def stratified(rows: DataFrame, strata: list[str], name: str, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2), seed: int = 42) -> DataFrame:
    """A seeded split in proportion within each stratum, whatever the partitioning: rows are placed by a digest of seed and name.
    A stratum is sorted in 256 ranges of the digest's first byte, so that one may hold any share of the rows."""
    n = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(name).cast("string")).cast("binary"))
    ranged = rows.withColumn("_d", digest).withColumn(RANGE, F.conv(F.substring("_d", 1, 2), 16, 10).cast("int"))
    joined = matched(ranked_in_ranges(ranged, strata, ["_d", name], "_p"), quotas(n, strata, ratios), strata)
    split = F.when(F.col("_p") <= F.col("train"), "train").when(F.col("_p") <= F.col("train") + F.col("val"), "val").otherwise("test")
    return joined.withColumn("split", split).drop("_p", "_d", "n", *SPLITS)


def fnv(text: str) -> int:
    h = 2166136261
    for unit in text.encode("utf-16-le")[::2] if text.isascii() else [int.from_bytes(text.encode("utf-16-le")[i : i + 2], "little") for i in range(0, 2 * len(text), 2)]:
        h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
    return h


def mulberry32(seed: int):  # noqa: ANN201
    """A generator of floats in [0, 1)."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61))) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    return draw


def shuffled(items: list, seed: int) -> list:
    draw, out = mulberry32(seed), list(items)
    for i in range(len(out) - 1, 0, -1):
        j = int(draw() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def targets(n: int, ratios: tuple[float, float, float]) -> dict[str, int]:
    exact = [n * r / sum(ratios) for r in ratios]
    floors = [int(e + 1e-9) for e in exact]
    for i in sorted(range(3), key=lambda i: (-(exact[i] - floors[i]), i))[: n - sum(floors)]:
        floors[i] += 1
    return dict(zip(SPLITS, floors, strict=True))


def globally_balanced(rows: pd.DataFrame, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2), seed: int = 42) -> pd.DataFrame:
    """Strata from large to small fill their own quotas while a split has room as a whole; afterwards surplus
    rows move to splits that lack some. One manifest is one small group, so this runs on its rows alone.
    Needs columns filename, source, document_type and condition; adds split."""
    want = targets(len(rows), ratios)
    have = dict.fromkeys(SPLITS, 0)
    key = rows["source"] + "|" + rows["document_type"] + "|" + rows["condition"]
    strata = sorted(((k, g["filename"].tolist()) for k, g in rows.groupby(key)), key=lambda s: (-len(s[1]), s[0]))
    chosen: dict[str, str] = {}
    for k, names in strata:
        own = targets(len(names), ratios)
        queue = [s for s in SPLITS for _ in range(own[s])]
        for name, split in zip(shuffled(names, seed ^ fnv(k)), queue, strict=True):
            if have[split] >= want[split]:
                split = max(SPLITS, key=lambda s: want[s] - have[s])
            chosen[name] = split
            have[split] += 1
    order = sorted(zip(key, rows["filename"], strict=True), key=lambda r: fnv(f"{r[0]}|{r[1]}{seed}"))
    for name in (n for _, n in order):
        lacking = max(SPLITS, key=lambda s: want[s] - have[s])
        giver = chosen[name]
        if want[lacking] <= have[lacking]:
            break
        if have[giver] > want[giver]:
            chosen[name] = lacking
            have[giver] -= 1
            have[lacking] += 1
    return rows.assign(split=rows["filename"].map(chosen))


def assigned(rows: DataFrame, assignments: DataFrame, key: str, default: str = "unassigned") -> DataFrame:
    """Left join of split assignments by key."""
    return rows.join(assignments.select(key, "split"), key, "left").withColumn("split", F.coalesce("split", F.lit(default)))


def overridden(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Fields of ``overrides`` that are not null win."""
    extra = [c for c in overrides.columns if c != key]
    both = rows.join(overrides.select(key, *[F.col(c).alias(f"_o_{c}") for c in extra]), key, "left")
    return both.withColumns({c: F.coalesce(F.col(f"_o_{c}"), F.col(c)) if c in rows.columns else F.col(f"_o_{c}") for c in extra}).drop(*[f"_o_{c}" for c in extra])


def counts_by_sets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each key alone and of all rows, in one pass."""
    sets = [[F.col(k)] for k in keys] + [[]]
    return rows.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
