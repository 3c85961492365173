"""Licence scans.

A text's words are normalised to one line and one Aho-Corasick automaton finds notice phrases and the identifier
tag in it.  Behind a tag, a shunting-yard parser evaluates the expression: ``or`` takes the freest side, ``and`` the
most bound one, ``with`` (an exception) moves a licence half way to free; ``with`` binds before ``and`` before ``or``.

The score is the freedom of use from 0 to 1 that all declarations of the text leave together (the smallest of them),
and 0 where there is none.

Defined results: a null or empty text has no words, labels or places and score 0; a broken expression counts the
identifiers in it joined by ``and``; prose behind a tag names none; ties (equal labels or places) count once as labels
and each as places; repeated rows are scanned each; a very long text is one row; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake.llm.common import give_back, text_of

#: Fixed base phrases (as words) and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "bsd license": "bsd", "eclipse public license": "epl", "creative commons attribution": "cc-by", "creative commons zero": "cc0",
    "cc0": "cc0", "public domain": "public-domain", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "boost software license": "bsl", "isc license": "isc", "permission is hereby granted free of charge": "mit",
    "all rights reserved": "proprietary", "released into the public domain": "public-domain", "the unlicense": "unlicense",
}
#: The tag that an expression follows, as words and as written.
TAG, TAG_WRITTEN = "spdx license identifier", re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.I)
#: Freedom of use by label; an identifier's label is its longest prefix here, others count OTHER.
FREEDOM = {
    "unlicense": 1.0, "public-domain": 1.0, "cc0": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "bsl": 0.95, "apache": 0.9, "cc-by": 0.8,
    "mpl": 0.6, "epl": 0.55, "lgpl": 0.5, "cc-by-sa": 0.4, "cc-by-nd": 0.3, "gpl": 0.25, "cc-by-nc": 0.2, "agpl": 0.15, "proprietary": 0.0,
}
OTHER = 0.1
#: Identifiers of one plain word that have no label above.
PLAIN = {"zlib", "curl", "wtfpl", "postgresql", "ruby", "ncsa", "beerware", "vim", "python", "libpng", "libtiff", "openssl", "php", "x11", "fair", "latex2e"}
BINDS = {"or": 1, "and": 2, "with": 3}
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())])

#: Bytes to normalised bytes: digits, lower-case letters and all above ASCII stay, capitals are lowered, others part words.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")


def label_of(identifier: str) -> str:
    low = identifier.lower().rstrip("+")
    return max((k for k in FREEDOM if low == k or low.startswith(k + "-")), key=len, default=low)


def is_identifier(token: str) -> bool:
    """Whether a word behind the tag can be an identifier: a known one, one that a document defines, or one with a digit or a hyphen inside."""
    low = token.lower().rstrip("+")
    return label_of(token) in FREEDOM or low in PLAIN or bool(re.search(r"[0-9]|[a-z]-[a-z]", low))


def evaluate(expression: str) -> tuple[float, list[str]]:
    """The expression's freedom of use and its labels, by the shunting-yard method.

    Operators that wait are popped onto the values before one that binds no tighter.  What stands behind a complete
    expression without an operator (a comment's end, prose) ends it.
    """
    values: list[float] = []
    waiting: list[str] = []
    labels: list[str] = []

    def settle() -> None:
        op, b, a = waiting.pop(), values.pop(), values.pop()
        values.append(max(a, b) if op == "or" else min(a, b) if op == "and" else (a + 1) / 2)

    operand = True  # whether an operand is due
    try:
        for token in _TOKEN.findall(expression):
            low = token.lower()
            if operand and low == "(":
                waiting.append(low)
            elif operand and is_identifier(token):
                if not (waiting and waiting[-1] == "with"):
                    labels.append(label_of(token))
                values.append(FREEDOM.get(label_of(token), OTHER))
                operand = False
            elif not operand and low in BINDS:
                while waiting and BINDS.get(waiting[-1], 0) >= BINDS[low]:
                    settle()
                waiting.append(low)
                operand = True
            elif not operand and low == ")" and "(" in waiting:
                while waiting[-1] != "(":
                    settle()
                waiting.pop()
            elif operand:
                raise ValueError(expression)
            else:
                break
        while waiting:
            settle()
        (value,) = values
    except (ValueError, IndexError, KeyError):
        names = [t for t in _TOKEN.findall(expression) if is_identifier(t)]
        labels = [label_of(t) for t in names]
        value = min((FREEDOM.get(x, OTHER) for x in labels), default=0.0)
    return value, labels


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Keys stand between spaces, so that a key begins and ends at words; neighbouring matches share a space."""
    a = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        a.add_word(f" {phrase} ", (phrase, len(phrase.split())))
    a.make_automaton()
    return a


def scan(text: str) -> tuple:
    words = text.encode().translate(_NORMAL).split()
    line = f" {b' '.join(words).decode()} "
    places, base, found, tagged, at, spaces = [], set(), [], False, 0, -1
    for end, (phrase, n) in automaton().iter(line):
        spaces += line.count(" ", at, end + 1)  # ends ascend: each space is counted once
        at = end + 1
        if phrase in BASE:
            places.append(spaces - n)
            base.add(BASE[phrase])
            found.append(BASE[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            found.append(NOTICES[phrase])
    values = [FREEDOM[x] for x in found]
    if tagged:
        for expression in TAG_WRITTEN.findall(text):
            value, labels = evaluate(expression)
            if labels:
                values.append(value)
                found += labels
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(set(found))), min(values, default=0.0)


@F.pandas_udf(RESULT)
def licence_scan(texts: pd.Series) -> pd.DataFrame:
    got = pd.DataFrame([scan(t) for t in texts], columns=RESULT.names)
    give_back()
    return got.astype({"first_word": "Int64", "last_word": "Int64"})


def licence_report(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    return docs.select("doc_id", licence_scan(text_of(docs)).alias("_r")).select("doc_id", "_r.*")
