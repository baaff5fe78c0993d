"""Language identification by fusing evidence, after Bayes.

A text's likelihood under each language comes from hashed byte trigrams. One more class, OTHER, stands for whatever is none of
the languages: foreign languages and letter gibberish. A text is of that class where its trigrams are less likely under the
languages taken together than ``background``, a level set on held-out labelled texts. Trigrams of a text depend on one another, so
that their mean counts for ``weight`` trigrams at most; the weight is the one under which held-out texts' probabilities are best
calibrated.

To the logarithms are added log P(declared markup language | language) and log P(address suffix | language), and the log of a prior
of the host. All three come from grouped sums of the texts' own posteriors over all rows: of declarations and suffixes, smoothed by a
belief (DECLARED, SUFFIX) that weighs as much as STRENGTH rows, and of hosts, smoothed from the whole to the registered domain
and to the host. A row never is evidence for itself: its own share is taken from every sum first.

Cases: null and empty texts and texts without letters bring no text evidence, count in no sum and are decided by the rest;
a row with no evidence at all has language null; a null declaration, suffix or host adds
nothing; ties go to the language that comes first; equal rows get equal results; an empty table gives no
rows; further columns stay as they are, and where one begins with ``out``, the new columns' prefix is ``free_prefix(rows, out)``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, bounded_texts, by_texts, free_prefix, held, let, slices, softmax, written

LANGS = ("de", "en", "es", "fr")
#: The class of texts in none of the languages.
OTHER = "other"
BUCKETS = 1 << 14
#: Rows a language that the text model is fitted on, at most.
SAMPLE_ROWS = 1500
#: Bytes of their texts a language, at most.
SAMPLE_BYTES = 16 << 20
#: Trigrams a text needs to tell of the background.
LEAST_TRIGRAMS = 60
#: Trigrams a text may count for, of which one is chosen, and the share of labels taken for wrong when it is.
WEIGHTS = (2.0, 4.0, 8.0, 15.0, 30.0, 60.0, 120.0, 240.0)
WRONG_LABELS = 0.01
CHARS = 1 << 17
#: Groups of the smoothing weigh as much as so many rows.
STRENGTH = 5.0
#: Rows of a looked-up table that are broadcast, at most; above that a salted join takes over.
BROADCAST_HOSTS = 20_000
SALTS = 16
#: How often a declaration is believed to be right, and a country suffix to tell the language, before any row is seen.
DECLARED, SUFFIX = 0.9, 0.7
SUFFIX_LANG = {"de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "es": "es", "mx": "es", "ar": "es", "fr": "fr"}
#: Labels that stand for a registry under a country suffix, as in co.uk.
REGISTRIES = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "net", "org")

FOLD = np.full(256, 32, dtype=np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams that hold a letter, and the text of each."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    # Two blanks come before each text, so that no trigram reaches over from another.
    data = FOLD[np.frombuffer(b"".join([b"  " + t for t in raw]) + b"  ", dtype=np.uint8)].astype(np.uint32)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 2
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    blanks = (data == 32).astype(np.uint8)
    keep = (blanks[:-2] + blanks[1:-1] + blanks[2:]) < 2
    doc = np.repeat(np.arange(len(raw)), sizes)
    return ((code[keep] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), doc[keep]


def _sum_by_text(doc: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=texts)


def _together(log: np.ndarray) -> np.ndarray:
    """Log likelihood of each trigram under all languages of ``log`` in equal parts."""
    return np.log(np.exp(log).mean(axis=0))


@dataclass
class TextModel:
    langs: tuple[str, ...]
    log: np.ndarray
    #: Of all languages that have training texts.
    together: np.ndarray
    background: float
    weight: float

    @property
    def classes(self) -> tuple[str, ...]:
        return (*self.langs, OTHER)

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log likelihoods of a text's trigrams under the classes, a row for each text, and the numbers of trigrams."""
        rates, counts = [np.zeros((0, len(self.classes)))], [np.zeros(0, dtype=np.int64)]
        for a, b in slices((len(t or "") for t in texts), CHARS):
            code, doc = trigrams(texts[a:b])
            n = np.bincount(doc, minlength=b - a)
            sums = [_sum_by_text(doc, log[code], b - a) for log in (*self.log, self.together)]
            own = np.stack(sums, axis=1) / np.maximum(n, 1)[:, None]
            own[:, -1] = own[:, :-1].max(axis=1) + self.background - own[:, -1]
            rates.append(own)
            counts.append(n)
        return np.concatenate(rates), np.concatenate(counts)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Tempered log likelihoods of the classes, a row for each text; zeros without letters."""
        rates, n = self.rates(texts)
        return rates * np.minimum(n, self.weight)[:, None]


def _logs(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.1) / (counts.sum(axis=-1, keepdims=True) + 0.1 * BUCKETS))


def _background(parts: list[list[list[str]]], counts: np.ndarray) -> float:
    """The level under which a text is of no language: each half of the texts is scored by the other half's counts, once
    with its own language among them and once without; half-way between the two medians, which wrongly labelled texts
    don't move much. Uniform where that can't be told."""
    known, unknown = [], []
    for half in (0, 1):
        trained = np.flatnonzero(counts[1 - half].sum(axis=1))
        log = _logs(counts[1 - half])
        for j in trained if len(trained) > 1 else ():
            own = parts[half][j]
            for a, b in slices((len(t or "") for t in own), CHARS):
                code, doc = trigrams(own[a:b])
                n = np.bincount(doc, minlength=b - a)
                for found, among in ((known, trained), (unknown, trained[trained != j])):
                    found.append((_sum_by_text(doc, _together(log[among])[code], b - a) / np.maximum(n, 1))[n >= LEAST_TRIGRAMS])
    if not sum(map(len, known)):
        return float(-np.log(BUCKETS))
    return float((np.median(np.concatenate(known)) + np.median(np.concatenate(unknown))) / 2)


def _best_weight(parts: list[list[list[str]]], counts: np.ndarray, among: tuple[str, ...], background: float) -> float:
    """The weight under which each half's texts have the highest likelihood of their labels by the other half's counts."""
    loss = np.zeros(len(WEIGHTS))
    for half in (0, 1):
        log = _logs(counts[1 - half])
        trained = counts[1 - half].sum(axis=1) > 0
        if trained.sum() < 2:
            return WEIGHTS[len(WEIGHTS) // 2]
        model = TextModel(among, log, _together(log[trained]), background, 0.0)
        for j in np.flatnonzero(trained):
            rates, n = model.rates(parts[half][j])
            for k, weight in enumerate(WEIGHTS):
                z = rates[n > 0] * np.minimum(n[n > 0], weight)[:, None]
                p = np.exp(z[:, j] - np.logaddexp.reduce(z, axis=1))
                loss[k] -= np.log((1 - WRONG_LABELS) * p + WRONG_LABELS / len(among)).sum()
    return WEIGHTS[int(np.argmin(loss))]


def fit(texts: list[str | None], langs: list[str], among: tuple[str, ...] = LANGS) -> TextModel:
    owns = [[t for t, x in zip(texts, langs, strict=True) if x == lang] for lang in among]
    parts = [[own[half::2] for own in owns] for half in (0, 1)]
    counts = np.zeros((2, len(among), BUCKETS))
    for half in (0, 1):
        for j, own in enumerate(parts[half]):
            for a, b in slices((len(t or "") for t in own), CHARS):
                counts[half, j] += np.bincount(trigrams(own[a:b])[0], minlength=BUCKETS)
    log = _logs(counts.sum(axis=0))
    trained = counts.sum(axis=(0, 2)) > 0
    background = _background(parts, counts)
    return TextModel(among, log, _together(log[trained] if trained.any() else log), background, _best_weight(parts, counts, among, background))


def training_rows(docs: DataFrame, rows: int = SAMPLE_ROWS, among: tuple[str, ...] = LANGS, most: int = SAMPLE_BYTES) -> tuple[list[str], list[str]]:
    """At most ``rows`` documents a language, by hashed id, and of them as many as hold ``most`` bytes of text a language."""
    usable = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string")).where("doc_id is not null")
    picked = reduce(DataFrame.unionAll, [usable.where(F.col("lang") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for x in among]).collect()
    found = bounded_texts(docs, list(dict.fromkeys((r.doc_id, r.lang) for r in picked)), most, F.col("lang"))
    return [t for t, _ in found], [lang for _, lang in found]


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _floats(values) -> Column:  # noqa: ANN001
    return F.array(*[F.lit(float(v)) for v in values])


def _sums(rows: DataFrame, key: str, classes: int) -> DataFrame:
    """``key`` and the sums ``c`` of the posteriors of its rows."""
    return rows.where(F.col(key) != "").groupBy(key).agg(F.array(*[F.sum(f"c{j}") for j in range(classes)]).alias("c"))


def _looked_up(rows: DataFrame, key: str, found: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` with ``values`` of ``found`` (a row for each ``key``): broadcast below a checked count, else salted, as one key may
    hold most rows."""
    if found.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(found), key, "left")
    salt = free_prefix(rows, "_salt")
    salted = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [key, salt], "left").drop(salt)


def _hint(code: Column, counts: Column, own: Column, totals: np.ndarray, langs: tuple[str, ...], named: Column, trust: float) -> Column:
    """log P(hint | language) of each language: shares of the hint among the language's rows without the row itself, smoothed by
    the belief that it is the language ``named`` (null: none) with probability ``trust``. Zeros where there is no hint."""
    miss = (1 - trust) / max(1, len(langs) - 1)
    believed = F.array(*[F.when(named == x, trust).otherwise(miss) for x in langs])
    zeros = _floats([0.0] * len(langs))
    seen = F.coalesce(counts, zeros)
    rows = F.zip_with(_floats(totals), own, lambda n, o: F.greatest(n - o, F.lit(0.0)))
    share = F.zip_with(F.zip_with(seen, own, lambda c, o: F.greatest(c - o, F.lit(0.0))), believed, lambda c, b: c + STRENGTH * b)
    return F.when(code == "", zeros).otherwise(F.zip_with(share, rows, lambda c, n: F.log(c / (n + STRENGTH))))


def _smoothed(counts: Column, own: Column, below: Column) -> Column:
    """Shares of ``counts`` without the row's ``own``, smoothed by those ``below``."""
    left = F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
    return let(left, lambda c: let(_total(c), lambda total: F.zip_with(c, below, lambda x, p: (x + STRENGTH * p) / (total + STRENGTH))))


def identify(rows: DataFrame, model: TextModel, text: Column, declared: Column, host: Column, out: str = "lang_") -> DataFrame:
    """``rows`` with columns ``out`` + id (language, OTHER or null), confidence, posterior (by model.classes), text_id
    (by the text alone) and host (its host's prior)."""
    langs, out = model.classes, free_prefix(rows, out)
    bound_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        held(None)
        return by_texts(texts, lambda some: list(shared.value.evidence(some)), pa.list_(pa.float64()))

    evidence = evidence.asNondeterministic()  # so that a filter on it doesn't evaluate it twice
    k = {x: f"{out}{x}" for x in ("text", "own", "tag", "suffix", "domain", "key", "tags", "suffixes", "domains", "hosts", "hints")}
    name = F.coalesce(F.lower(F.trim(host.cast("string"))), F.lit(""))
    parts = F.split(name, r"\.")
    size = F.size(parts)
    registry = (size > 2) & (F.length(F.get(parts, size - 1)) == 2) & F.get(parts, size - 2).isin(*REGISTRIES)
    kept = F.least(size, F.when(registry, 3).otherwise(2))
    zeros = _floats([0.0] * len(langs))
    speaks = F.exists(k["text"], lambda x: x != 0)
    base = rows.withColumn(k["text"], evidence(text.cast("string"))).withColumns({
        k["own"]: F.when(speaks, softmax(F.col(k["text"]))).otherwise(zeros),
        k["tag"]: F.coalesce(F.regexp_extract(F.lower(F.trim(declared.cast("string"))), r"^([a-z]{2,8})(?:[-_]|$)", 1), F.lit("")),
        k["key"]: name,
        k["domain"]: F.when(name == "", "").otherwise(F.array_join(F.slice(parts, size - kept + 1, kept), ".")),
        k["suffix"]: F.when(size > 1, F.get(parts, size - 1)).otherwise(""),
    })
    keys = ["tag", "suffix", "domain", "key"]
    sums = base.select(*[F.col(k[x]).alias(x) for x in keys], *[F.col(k["own"])[j].alias(f"c{j}") for j in range(len(langs))])
    seen = written(sums.groupBy(*keys).agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(len(langs))]), "hosts")
    totals = {x: np.array([v or 0.0 for v in seen.where(F.lit(True) if x is None else F.col(x) != "").agg(*[F.sum(f"c{j}") for j in range(len(langs))]).first()]) for x in (None, "tag", "suffix")}
    hosts = _sums(seen.select("key", *[f"c{j}" for j in range(len(langs))]), "key", len(langs)).select(F.col("key").alias(k["key"]), F.col("c").alias(k["hosts"]))
    of = {x: _sums(seen, x, len(langs)).select(F.col(x).alias(k[x]), F.col("c").alias(k[x + "s"] if x != "suffix" else k["suffixes"])) for x in ("tag", "suffix", "domain")}
    fused = base
    for key, found, value in (("tag", of["tag"], "tags"), ("suffix", of["suffix"], "suffixes"), ("domain", of["domain"], "domains"), ("key", hosts, "hosts")):
        fused = _looked_up(fused, k[key], found, [k[value]])
    own = F.col(k["own"])
    country = F.create_map(*[F.lit(x) for pair in SUFFIX_LANG.items() for x in pair])
    named = F.when(F.col(k["tag"]).isin(*[x for x in langs if x != OTHER]), F.col(k["tag"]))
    hints = _plus(
        _hint(F.col(k["tag"]), F.col(k["tags"]), own, totals["tag"], langs, named, DECLARED),
        _hint(F.col(k["suffix"]), F.col(k["suffixes"]), own, totals["suffix"], langs, F.try_element_at(country, F.col(k["suffix"])), SUFFIX),
    )
    even = _floats([1.0 / len(langs)] * len(langs))
    whole = _smoothed(_floats(totals[None]), own, even)
    domain = let(whole, lambda below: _smoothed(F.coalesce(F.col(k["domains"]), zeros), own, below))
    prior = let(domain, lambda below: _smoothed(F.coalesce(F.col(k["hosts"]), zeros), own, below))
    fused = fused.withColumns({k["hints"]: hints, f"{out}host": F.when(F.col(k["key"]) != "", prior)})
    told = _plus(_plus(F.col(k["text"]), F.col(k["hints"])), F.coalesce(F.transform(f"{out}host", lambda v: F.log(v)), zeros))
    known = speaks | (F.col(k["tag"]) != "") | (F.col(k["suffix"]) != "") | (F.col(k["key"]) != "")
    best = lambda x: F.element_at(F.array(*map(F.lit, langs)), F.array_position(x, F.array_max(x)).cast("int"))
    fused = fused.withColumn(f"{out}posterior", softmax(told)).withColumns({
        f"{out}id": F.when(known, best(F.col(f"{out}posterior"))),
        f"{out}confidence": F.array_max(f"{out}posterior"),
        f"{out}text_id": F.when(speaks, best(F.col(k["text"]))),
    })
    return fused.select(*[F.col(f"`{c}`") for c in rows.columns], *[f"{out}{c}" for c in ("id", "confidence", "posterior", "text_id", "host")])


#: Comments, scripts and styles (to the page's end where they don't close), tags and character references; no part is read twice.
_DROP = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)|<[^<>]*>|&[a-z#0-9]{1,32};"


def page_columns(pages: DataFrame) -> DataFrame:
    """page_id with the visible text, the declared language (its primary subtag) and the host of each page."""
    return pages.select(
        F.col("page_id").cast("long"), F.regexp_replace(F.col("html").cast("string"), _DROP, " ").alias("text"),
        F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,8})(?![a-z])", 1)), F.lit("")).alias("declared"),
        F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")).alias("host"),
    )
