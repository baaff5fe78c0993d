"""The fusion of evidence against a plain-Python form, and the edges of the language operator."""

from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from scriptorium.llm import language


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(*language.training_rows(spark.read.parquet(f"{DATA}/documents.parquet")))


def softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


def registered(host):
    parts = host.split(".")
    if len(parts) > 2 and len(parts[-1]) == 2 and parts[-2] in language.REGISTRIES:
        return ".".join(parts[-3:])
    return ".".join(parts[-2:])


def fused(rows, model):
    """Posterior and host prior of each row (text, tag or None, host or None), one row at a time."""
    classes, s = model.classes, language.STRENGTH
    texts = [model.evidence([t])[0] for t, _, _ in rows]
    owns = [softmax(z) if z.any() else np.zeros(len(classes)) for z in texts]
    keys = [(tag, (host.split(".")[-1] if host and "." in host else None), registered(host) if host else None, host) for _, tag, host in rows]
    sums = [defaultdict(lambda: np.zeros(len(classes))) for _ in range(4)]
    for own, key in zip(owns, keys, strict=True):
        for table, x in zip(sums, key, strict=True):
            if x:
                table[x] = table[x] + own
    whole, out = sum(owns), []
    for z, own, key in zip(texts, owns, keys, strict=True):
        told = z.copy()
        for level, named, trust in ((0, key[0] if key[0] in language.LANGS else None, language.DECLARED), (1, language.SUFFIX_LANG.get(key[1]), language.SUFFIX)):
            if key[level]:
                believed = np.array([trust if c == named else (1 - trust) / (len(classes) - 1) for c in classes])
                told += np.log((sums[level][key[level]] - own + s * believed) / (sum(sums[level].values()) - own + s))
        prior = None
        if key[3]:
            prior = np.full(len(classes), 1 / len(classes))
            for left in (whole - own, sums[2][key[2]] - own, sums[3][key[3]] - own):
                prior = (left + s * prior) / (left.sum() + s)
            told = told + np.log(prior)
        out.append((softmax(told), prior))
    return out


@pytest.mark.parametrize("most", [language.BROADCAST_HOSTS, 0])
def test_fusion_equals_plain_python(spark, model, monkeypatch, most):
    monkeypatch.setattr(language, "BROADCAST_HOSTS", most)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rng = np.random.default_rng(2)
    hosts = [None, "", "a.de", "b.a.de", "x.co.uk", "y.co.uk", "news.example.fr", "localhost", "10.0.0.1"]
    rows = [(texts[i % 40][:: 1 if i % 3 else 9], [None, "de", "en", "est", "zh", "fr"][rng.integers(6)], hosts[rng.integers(len(hosts))]) for i in range(80)]
    rows += [("", "fr", None), (None, None, "a.de"), ("123 456", "es", "y.co.uk"), rows[0], rows[0], ("word " * 60_000, "en", "a.de")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, text string, declared string, host string")
    got = {r.k: r for r in language.identify(df, model, F.col("text"), F.col("declared"), F.col("host")).collect()}
    assert len(got) == len(rows)
    for i, (posterior, prior) in enumerate(fused(rows, model)):
        assert np.allclose(got[i].lang_posterior, posterior, atol=1e-9) and got[i].lang_confidence == pytest.approx(posterior.max())
        assert (got[i].lang_host is None) == (prior is None) and (prior is None or np.allclose(got[i].lang_host, prior, atol=1e-9))


def test_a_row_is_no_evidence_for_itself(spark, model):
    german = spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'de'").first().text
    rows = [(1, german, "only.example.org"), (2, "", "only.example.org"), (3, "", "never.example.com")]
    got = {r.k: r for r in language.identify(spark.createDataFrame(rows, "k long, text string, host string"), model, F.col("text"), F.lit(None), F.col("host")).collect()}
    assert np.allclose(got[1].lang_host, 0.2) and got[2].lang_id == "de" and got[2].lang_host[0] > got[3].lang_host[0] > 0.2


def test_tags_are_read_whole_and_names_may_clash(spark, model):
    rows = [(1, None, "est"), (2, None, "de-AT"), (3, None, "DE"), (4, None, "frr"), (5, None, "fr_CA"), (6, None, "d"), (7, None, "!"), (8, None, None)]
    df = spark.createDataFrame(rows, "k long, text string, declared string")
    got = {r.k: r.lang_id for r in language.identify(df, model, F.col("text"), F.col("declared"), F.lit(None)).collect()}
    assert {k: got[k] for k in (2, 3, 5, 6, 7, 8)} == {2: "de", 3: "de", 5: "fr", 6: None, 7: None, 8: None}
    assert got[1] != "es" and got[4] != "fr"
    clash = df.withColumns({c: F.lit("mine") for c in ("lang_text", "lang_id", "lang_posterior", "lang_key", "_salt")})
    found = language.identify(clash, model, F.col("text"), F.col("declared"), F.lit(None))
    assert found.columns[: len(clash.columns)] == clash.columns and "_lang_id" in found.columns
    assert {r.k: (r["lang_id"], r["_lang_id"]) for r in found.collect()} == {k: ("mine", v) for k, v in got.items()}


def test_pages_of_any_shape(spark):
    pages = [
        (1, "http://x.co.uk/a", "<html lang=est><!-- never closed <p>gone</p>"), (2, "ftp://[::1", "a <script>b</script> c <style>d"), (3, "//none", "<" * 60_000 + "end"),
        (4, "https://H.example.de:1/", "<!--" * 30_000), (5, None, "x &amp; <b class='y'>z</b>"), (5, None, "x &amp; <b class='y'>z</b>"),
    ]
    got = language.page_columns(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert [(r.page_id, r.declared, r.text.split()[-1:]) for r in got] == [(1, "est", []), (2, None, ["c"]), (3, None, ["<" * 60_000 + "end"]), (4, None, []), (5, None, ["z"]), (5, None, ["z"])]
    assert [r.host for r in got][:4] == ["x.co.uk", "[", None, "H.example.de"]


def test_training_rows_are_bounded(spark):
    rows = [(i, f"text {i}", "en") for i in range(20)] + [(100, "x" * 500, "de"), (101, None, "de"), (102, "short", "de"), (102, "sh", "de"), (102, "none", "xx"), (None, "z", "en")]
    texts, langs = language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=5, most=40)
    assert langs.count("en") <= 5 and [t for t, x in zip(texts, langs, strict=True) if x == "de"] == ["sh"]
    assert language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string").limit(0)) == ([], [])
