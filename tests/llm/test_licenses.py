"""The licence classifier on notices that it hasn't been trained on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import licenses

# Notices in words of their own; none is a training sentence.
UNSEEN = [
    ("MIT", "MyLib is open source software released under the MIT licence."), ("MIT", "See LICENSE (MIT) in the root folder."), ("MIT", "// Copyright Foo Inc. MIT License."),
    ("Apache-2.0", "Foo is made available by its authors under version 2.0 of the Apache License."), ("Apache-2.0", "@license: read the Apache-2.0 text"), ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD", "Published under a permissive 3-clause BSD licence"), ("BSD", "the simplified BSD licence applies"), ("BSD", "Redistributions of source code must retain the above notice"),
    ("GPL", "Foo is covered by the GPL, version 3 or later."), ("GPL", "you may redistribute it under the terms of the GNU General Public License"), ("GPL", "GPL-2.0-only"),
    ("LGPL", "The shared library itself is under the LGPL."), ("LGPL", "GNU Lesser General Public License for more details"), ("AGPL-3.0", "The server is AGPL licensed."), ("AGPL-3.0", "a copy of the GNU Affero General Public License"),
    ("MPL-2.0", "This file is under the Mozilla Public License."), ("ISC", "ISC licensed"), ("Unlicense", "see unlicense.org"), ("CC0", "All photographs are CC0."),
    ("CC-BY", "Photo by A. Smith, CC BY 2.0"), ("CC-BY-SA", "Map data CC BY-SA 2.0"), ("CC-BY-NC", "Slides are shared as CC BY-NC 2.5"), ("Proprietary", "(c) 1998 Foo Corp., all rights reserved"),
]
PLAIN = ["The cat sat on the mat.", "Il fait beau aujourd'hui.", "Wir fahren morgen nach Berlin.", "The form of the work was changed.", "A person came to the office with a letter.", "12 34 56", "El libro fue escrito en el año 1920.", "Use the other door."]


@pytest.fixture(scope="module")
def model():
    return licenses.train()


def named(model, text):
    p = model.probabilities(text)
    best = model.families[int(p.argmax())]
    return best if best == licenses.NONE or p.max() >= 0.5 else licenses.UNKNOWN


def test_notices_are_not_trained_on(model):
    trained = {tuple(w) for w, *_ in licenses.sentences()}
    assert not trained & {tuple(licenses.tokens(n)) for ns in licenses.NOTICES.values() for n in ns}
    assert not trained & {tuple(licenses.tokens(n)) for _, n in UNSEEN}


def test_precision_and_recall_on_unseen_notices(model):
    found = [(family, named(model, n)) for family, n in UNSEEN]
    known = [(a, b) for a, b in found if b not in (licenses.NONE, licenses.UNKNOWN)]
    assert sum(a == b for a, b in known) / len(known) >= 0.9
    assert sum(a == b for a, b in found) / len(found) >= 0.75
    assert all(named(model, t) == licenses.NONE for t in PLAIN)


def test_families_held_out_are_unknown(model):
    others = [f"Distributed under the {x}." for x in ("Frobnicator Public Licence", "Open Data Charter license", "Acme Community License 1.0")] + ["The licence of the inn was renewed."]
    assert all(named(model, t) in (licenses.UNKNOWN, licenses.NONE) for t in others)
    assert sum(named(model, t) == licenses.UNKNOWN for t in others) >= 2


def test_the_gate_drops_no_paragraph_with_a_feature(model):
    import re

    words = licenses.covering(list(model.features), set())
    gate = re.compile("(?i)(?<![a-z0-9])" + licenses._either(words) + "(?![a-z0-9])")
    assert all(gate.search(g) for g in model.features)
    assert all(gate.search(w) for w in words) and not gate.search("zzz qqq")
    assert model.probabilities("zzz qqq").argmax() == model.families.index(licenses.NONE)


def test_scan_equals_the_plain_form(spark, model):
    rng = np.random.default_rng(3)
    lines = [n for _, n in UNSEEN] + PLAIN + [n for ns in licenses.NOTICES.values() for n in ns] + ["", " ", "x" * 30_000 + " MIT license", "MIT " * 5000]
    texts = {i: "\n".join(lines[j] for j in rng.choice(len(lines), rng.integers(1, 5))) for i in range(80)}
    rows = [*texts.items(), (None, "MIT license"), (200, None), (201, ""), (202, "MIT license"), (202, "MIT license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("line", "words", "best", "family", "paragraph")})
    got = licenses.scan(df, model).collect()
    assert sum(r.doc_id == 202 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    seen = {(r.doc_id, r.paragraph): r for r in got if r.doc_id is not None and r.doc_id < 100}
    for i, text in texts.items():
        split = text.split("\n")
        starts = sorted(k for j, k in seen if j == i)
        for k, line in enumerate(split):
            if not any(s <= k for s in starts):
                assert named(model, line) == licenses.NONE
        for s in starts:
            for end in range(s + 1, len(split) + 1):  # a paragraph may go on over the next lines
                p = model.probabilities(" ".join(split[s:end]))
                if abs(p.max() - seen[i, s].probability) < 1e-5:
                    assert seen[i, s].family == (model.families[int(p.argmax())] if p.max() >= 0.5 else licenses.UNKNOWN)
                    break
            else:
                raise AssertionError((i, s))
    assert licenses.scan(df.limit(0), model).count() == 0
