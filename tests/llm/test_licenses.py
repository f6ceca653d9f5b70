import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textward.llm import licenses

from .cases import SCHEMA, documents


def contract(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def texts():
    r = random.Random(3)
    pieces = [*licenses.BASE, "Under THE mit-license", "under the mit", "license version 2", "cc-by-nc", "cc by", "apache", "é漢", "x", "\n", ".", "...", "2.0", "", "under under the mit license license"]
    return ["".join(r.choice(pieces) + r.choice([" ", "-", "\n", "", "/", "é"]) for _ in range(r.randrange(12))) for _ in range(300)]


def test_base_equals_brute_force(spark):
    rows = list(enumerate(texts())) + [(1000 + i, r[1]) for i, r in enumerate(documents())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.digest(licenses.scan(docs)).collect()}
    assert got == {i: contract(t) for i, t in rows}
    assert sum(v[1] for v in got.values()) > 50


def test_expressions():
    names = lambda text: licenses.evaluate(licenses.parse(text)[0], licenses.ACCEPTED)
    assert names("MIT") == (True, ["mit"])
    assert names("GPL-2.0-only OR MIT") == (True, ["gpl-2.0-only", "mit"])
    assert names("GPL-2.0-only AND MIT") == (False, ["gpl-2.0-only", "mit"])
    assert names("GPL-2.0-only OR MIT AND ISC") == (True, ["gpl-2.0-only", "isc", "mit"])
    assert names("(GPL-2.0-only OR MIT) and GPL-3.0-only") == (False, ["gpl-2.0-only", "gpl-3.0-only", "mit"])
    assert names("Apache-2.0 WITH LLVM-exception") == (True, ["apache-2.0"])
    assert licenses.parse("MIT */ int main()")[1] == "MIT"
    assert licenses.parse("MIT OR ")[1] == "MIT"
    assert licenses.parse("((MIT") == ([], "") and licenses.parse("OR MIT") == ([], "") and licenses.parse("") == ([], "")


EXPR = st.recursive(st.sampled_from(["MIT", "GPL-2.0-only", "ISC", "Foo-1"]), lambda e: st.tuples(st.sampled_from(["AND", "OR"]), e, e), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(EXPR)
def test_parser_agrees_with_the_tree(tree):
    def show(t):
        return t if isinstance(t, str) else f"({show(t[1])} {t[0]} {show(t[2])})"

    def value(t):
        if isinstance(t, str):
            return t.lower() in licenses.ACCEPTED
        a, b = value(t[1]), value(t[2])
        return a and b if t[0] == "AND" else a or b

    postfix, used = licenses.parse(show(tree))
    assert used == show(tree) and licenses.evaluate(postfix, licenses.ACCEPTED)[0] == value(tree)


def test_tags_add_labels(spark):
    rows = [(1, "// SPDX-License-Identifier: (GPL-2.0-only OR MIT) */\nunder the MIT license"), (2, "SPDX License Identifier no"), (3, "GNU General Public License")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in licenses.digest(found).collect()}
    assert (got[1].base_labels, got[1].labels) == ("mit", "gpl-2.0-only,mit")
    assert got[3].labels == "gpl" and got[3].base_labels == ""
    one = found.where("doc_id = 1").first().expressions[0]
    assert (one.text, one.accepted, one.licences) == ("(GPL-2.0-only OR MIT)", True, ["gpl-2.0-only", "mit"])


def test_edge_cases(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    got = licenses.digest(licenses.scan(docs)).collect()
    assert len(got) == len(documents())
    none = next(r for r in got if r.doc_id == 11)
    assert tuple(none) == (11, 0, 0, None, None, "", "", 0.0)
    assert licenses.digest(licenses.scan(spark.createDataFrame([], SCHEMA))).collect() == []


def test_long_text(spark):
    text = "lorem ipsum " * 50000 + "under the MIT license" + " dolor" * 1000
    r = licenses.digest(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r.n_words, r.first_word, r.last_word) == (101004, 100000, 100000)
    assert r.score == pytest.approx(0.5)


def test_every_tag_is_parsed_at_its_own_place(spark):
    rows = [
        (1, "/* SPDX-License-Identifier: MIT */ x=1; /* SPDX-License-Identifier: GPL-2.0-only */", ["mit"], ["gpl-2.0-only"]),
        (2, "# SPDX-License-Identifier:\n#   Apache-2.0 OR ISC\ncode", ["apache-2.0", "isc"]),
        (3, "spdx.license/identifier = (MIT\n   AND Zlib)", ["mit", "zlib"]),
        (4, "the SPDX license identifier is short; SPDX License Identifier MIT", ["mit"]),
        (5, "é漢 License-Expression: MIT AND\nnothing", ["mit"]),
        (6, "PackageLicenseDeclared: LGPL-2.1-only\nPackageLicenseConcluded: NOASSERTION", ["lgpl-2.1-only"], ["noassertion"]),
        (7, "SPDX-License-Identifier: MIT\n" * 300, *[["mit"]] * 300),
        (8, "SPDX-License-Identifier:"),
    ]
    docs = spark.createDataFrame([(r[0], r[1], 7) for r in rows], "doc_id long, text string, base int")
    got = {r.doc_id: [list(e.licences) for e in r.expressions] for r in licenses.scan(docs).collect()}
    assert got == {r[0]: list(r[2:]) for r in rows}
    assert not licenses.evaluate(licenses.parse(rows[0][1], 70)[0], licenses.ACCEPTED)[0]
    again = licenses.scan(docs.union(docs)).collect()
    assert len(again) == 2 * len(rows)
