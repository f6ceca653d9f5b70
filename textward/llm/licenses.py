"""Licences named in texts: Aho-Corasick over words, and a shunting-yard parser of licence expressions.

A text becomes its words (runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased) with single spaces; one automaton finds all notice phrases and identifier tags in
one pass. Behind each tag's own place the expression in the original text is parsed: WITH binds closer than
AND, AND closer than OR; it is evaluated against a set of accepted licences. A colon or an equals sign may stand
between; without one, the expression has to begin with a known identifier, so that prose about tags names none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm import words
from textward.llm.scratch import bounded

#: Fixed values of the contract: phrase and label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "all-rights-reserved",
    "permission to use copy modify and or distribute this software": "isc",
    "permission to use copy modify and distribute this software": "historical",
    "neither the name of the copyright holder": "bsd-3-clause",
    "licensed under the mit license": "mit",
    "licensed under the gnu": "gpl",
    "gnu free documentation license": "gfdl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "microsoft public license": "ms-pl",
    "artistic license": "artistic",
    "python software foundation license": "psf",
    "academic free license": "afl",
    "open software license": "osl",
    "open font license": "ofl",
    "open data commons": "odc",
    "zlib license": "zlib",
    "do what the fuck you want to public license": "wtfpl",
    "business source license": "busl",
    "server side public license": "sspl",
}
#: Words that an expression follows.
TAGS = ("spdx license identifier", "license expression", "packagelicensedeclared", "packagelicenseconcluded", "licenseconcluded", "licenseinfoinfile", "licensedeclared")
#: Identifiers of licences.
IDENTIFIERS = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause
BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 BlueOak-1.0.0 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1
CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-2.0
GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ISC LGPL-2.0-only LGPL-2.1 LGPL-2.1-only
LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL
MS-RL MulanPSL-2.0 NCSA NONE NOASSERTION ODbL-1.0 OFL-1.1 OSL-3.0 PDDL-1.0 PHP-3.01
PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 UPL-1.0 Unicode-DFS-2016 Unlicense Vim
W3C WTFPL X11 Zlib ZPL-2.1
""".lower().split()
#: Licences that an expression is evaluated against (ids in lower case).
ACCEPTED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "unlicense", "cc0-1.0", "cc-by-4.0", "zlib", "bsl-1.0"})
_KNOWN = frozenset(IDENTIFIERS)
_BETWEEN = re.compile(r"""[\s"'`*#/<>=:|;!-]*""")
_INLINE = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:\-]*)")
_ACROSS = re.compile(r"[ \t\r\n*#/]*([()]|[A-Za-z0-9][A-Za-z0-9.+:\-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse(text: str, start: int = 0) -> tuple[list[str], str]:
    """The expression that stands in text from start, in postfix order, and the part of text it fills.

    Reads as far as the grammar goes on ("MIT OR ISC */" ends before the comment mark), and to the end of
    the line, but inside parentheses on the next lines too. Returns ([], "") where no whole expression begins there.
    """
    output: list[str] = []
    waiting: list[str] = []
    at, operand, good, depth = start, True, ([], start), 0
    while m := (_ACROSS if depth else _INLINE).match(text, at):
        token = m[1]
        word = token.lower()
        if operand:
            if token == "(":
                waiting.append(token)
                depth += 1
            elif token == ")" or word in _RANK:
                break
            else:
                output.append(word.rstrip(".:"))
                operand = False
        elif word in _RANK:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[word]:
                output.append(waiting.pop())
            waiting.append(word)
            operand = True
        elif token == ")" and depth:
            while waiting[-1] != "(":
                output.append(waiting.pop())
            waiting.pop()
            depth -= 1
        else:
            break
        at = m.end()
        if not operand and not depth:
            good = ([*output, *reversed(waiting)], at)
    return good[0], text[start : good[1]].strip()


def evaluate(postfix: list[str], accepted: frozenset[str]) -> tuple[bool, list[str]]:
    """Whether accepted licences satisfy the expression, and the licences it names, sorted.

    "a with b" is satisfied where "a with b" or a is accepted: an exception only adds rights.
    """
    stack: list[tuple[str, bool]] = []
    names = set()
    for k in postfix:
        if k in _RANK:
            (b, y), (a, x) = stack.pop(), stack.pop()
            if k == "with":
                names.discard(b)
                stack.append((f"{a} with {b}", x or f"{a} with {b}" in accepted))
            else:
                stack.append(("", x or y if k == "or" else x and y))
        else:
            names.add(k)
            stack.append((k, k in accepted))
    return (stack[0][1] if stack else False), sorted(names)


@dataclass
class Found:
    n_words: int
    base: list[tuple[str, int, int]]
    notices: list[tuple[str, int, int]]
    expressions: list[tuple[str, bool, list[str]]]

    @property
    def score(self) -> float:
        """1 - 2 ** -k for k places: how sure it is that the text names a licence."""
        return 1.0 - 0.5 ** min(50, len(self.base) + len(self.notices) + 2 * len(self.expressions))


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str], accepted: frozenset[str]) -> None:
        self.accepted = accepted
        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", base), ("notice", notices), ("tag", dict.fromkeys(TAGS, "tag"))):
            for phrase, label in phrases.items():
                kinds.setdefault(phrase, []).append((kind, label))
        for phrase, labels in kinds.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, labels))
        self.automaton.make_automaton()

    def scan(self, clean: str, original: bytes, ends: np.ndarray) -> Found:
        """clean: the text's words (see `clean_words`); ends: where each ends in the original."""
        out = Found(len(ends), [], [], [])
        tags, seen, at = [], 0, 0
        for end, (length, n, labels) in self.automaton.iter(clean):
            start = end - length + 1
            if start >= at:
                seen, at = seen + clean.count(" ", at, start), start
                first = seen
            else:
                first = seen - clean.count(" ", start, at)
            for kind, label in labels:
                if kind == "tag":
                    tags.append(int(ends[first + n - 1]))
                else:
                    (out.base if kind == "base" else out.notices).append((label, first, n))
        text = original.decode("latin-1") if tags else ""  # one character a byte; expressions are ASCII
        for place in tags:
            gap = _BETWEEN.match(text, place)
            postfix, found = parse(text, gap.end())
            if postfix and (":" in gap[0] or "=" in gap[0] or postfix[0] in _KNOWN):
                out.expressions.append((found, *evaluate(postfix, self.accepted)))
        return out


def clean_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text as " word word " in lower case, end to end, and the offsets; where each word ends in raw, and each text's offset in those."""
    starts, ends = words.bounds(raw, offs, words.TABLES.alnum)
    size = ends - starts
    row = np.searchsorted(offs, starts, "right") - 1
    n = len(offs) - 1
    per = np.bincount(row, size + 1, n).astype(np.int64) + 1
    out_offs = np.concatenate(([0], np.cumsum(per)))
    out = np.full(int(out_offs[-1]), 32, np.uint8)
    inside = np.zeros(len(raw), np.int8)
    keep = words.TABLES.alnum[raw]
    inside[keep] = 1
    # a word's bytes move to: text's start + 1 + bytes and gaps of its words before
    before = np.cumsum(size + 1) - (size + 1)
    first = np.searchsorted(row, np.arange(n), "left")
    base = np.concatenate((before, [0]))[first]
    to = out_offs[row] + 1 + before - base[row]
    out[np.repeat(to - (np.cumsum(size) - size), size) + np.arange(size.sum())] = words.TABLES.lower[raw[keep]]
    return out, out_offs, ends, np.append(first, len(starts))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, accepted: frozenset[str] = ACCEPTED) -> DataFrame:
    """(id_col, n_words, base, notices, expressions, score) for every row of docs.

    base and notices: all places of their phrases, array of (label, first, n), words from 0;
    overlapping places each count.  expressions: array of (text, accepted, licences), one for
    each tag that an expression follows, on the same line or the next.  Null and empty texts have none, with
    score 0.0.  Repeated rows are each returned; columns of other names are neither read nor returned.
    """
    bounded(docs.sparkSession)
    place = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))
    expression = pa.list_(pa.struct([("text", pa.string()), ("accepted", pa.bool_()), ("licences", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, accepted)
        for batch in batches:
            for a, b in words.slices(batch.column("text")):
                raw, offs = words.utf8(batch.column("text").slice(a, b - a))
                clean, at, ends, of = clean_words(raw, offs)
                text, data = clean.tobytes(), raw.tobytes()
                found = [scanner.scan(text[at[i] : at[i + 1]].decode("utf-8", "replace"), data[offs[i] : offs[i + 1]], ends[of[i] : of[i + 1]] - offs[i]) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a),
                        pa.array([f.n_words for f in found], pa.int64()),
                        pa.array([[dict(label=x, first=y, n=z) for x, y, z in f.base] for f in found], place),
                        pa.array([[dict(label=x, first=y, n=z) for x, y, z in f.notices] for f in found], place),
                        pa.array([[dict(text=x, accepted=y, licences=z) for x, y, z in f.expressions] for f in found], expression),
                        pa.array([f.score for f in found], pa.float64()),
                    ],
                    names=["id", "n_words", "base", "notices", "expressions", "score"],
                )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    places = "array<struct<label:string,first:bigint,n:bigint>>"
    schema = f"id {source.schema['id'].dataType.simpleString()}, n_words long, base {places}, notices {places}, expressions array<struct<text:string,accepted:boolean,licences:array<string>>>, score double"
    return source.mapInArrow(words.thrifty(run), schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of a result of `scan`."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, notices = F.col("base.label"), F.col("notices.label")
    named = F.flatten(F.col("expressions.licences"))
    return found.select(
        id_col,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").alias("first_word"),
        F.array_max("base.first").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, notices, named)).alias("labels"),
        "score",
    )
