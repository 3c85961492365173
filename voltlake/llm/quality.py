"""Quality rules with host-level verdicts.

Each text is measured on its own; failures of the soft rules are then summed by host (the ``source`` column), each
host's rate is shrunk towards an empirical beta prior, and the host's verdict is joined back to its documents.

A failed soft rule is one point, a gross failure (GROSS times the limit) two.  A document of an ordinary host may
have one point, one of a bad host none.  A host is bad if a shrunk rate is over BAD_RATE and over twice the rate of
all documents.  Documents that fail the base rules are rejected whatever their host.

Defined results: a null or empty text has no words and fails the base rules; a null source is a host of its own;
a very long text is one row, measured in one pass; repeated rows are measured and counted each; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake.llm.common import give_back, lookup_join, text_of, written

#: Limits of the soft rules: symbols a word, share of repeated lines, share of capitals, mean word length.
SYMBOLS, DUP_LINES, CAPITALS, LONG_WORDS = 0.1, 0.3, 0.5, 12.0
GROSS, BAD_RATE = 3.0, 0.3
SOFT = ("symbols", "dup_lines", "capitals", "word_length")
METRICS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")])
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_SPACES = b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at two or more places."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 1_000_000:  # else the triple's number fits 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    triple = pair[:-1] * len(seen) + ids[2:]
    order = np.argsort(triple, kind="stable")
    same = np.diff(triple[order]) == 0
    dup = np.zeros(n - 2, bool)
    dup[order[1:][same]] = True
    dup[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= dup
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()  # bytes: exactly the six ASCII white-space characters
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, letters


@F.pandas_udf(METRICS)
def _text_metrics(texts: pd.Series) -> pd.DataFrame:
    rows = [measure(t) for t in texts]
    give_back()
    return pd.DataFrame(rows, columns=METRICS.names)


#: Marked so that a filter on its result is not pushed below it and measures every text a second time.
text_metrics = _text_metrics.asNondeterministic()


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def points(m: Column) -> list[Column]:
    """0, 1 or 2 for each soft rule."""
    words, lines, letters = (F.greatest(m[c], F.lit(1)) for c in ("n_words", "n_lines", "n_letters"))
    over = (m["n_symbols"] / (words * SYMBOLS), m["n_dup_lines"] / (lines * DUP_LINES), m["n_upper"] / (letters * CAPITALS), m["word_chars"] / (words * LONG_WORDS))
    return [F.when(x > GROSS, 2).when(x > 1, 1).otherwise(0) for x in over]


def host_verdicts(measured: DataFrame, host: str = "source", m: str = "_m") -> DataFrame:
    """measured (host, metrics struct) -> one row a host: _host, host_docs, host_bad, and its shrunk rates."""
    each = measured.select(F.col(host).alias("_host"), *[(p > 0).cast("long").alias(r) for r, p in zip(SOFT, points(F.col(m)), strict=True)])
    hosts = written(each.groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"), *[F.sum(r).alias(r) for r in SOFT]), "hosts")
    n = F.col("host_docs")
    sums = [F.sum(n).alias("n"), F.count(F.lit(1)).alias("k")]
    for r in SOFT:  # moments of the hosts' rates, weighted by documents
        rate = F.col(r) / n
        sums += [F.sum(r).alias(f"{r}_f"), F.sum(n * rate * rate).alias(f"{r}_q")]
    s = hosts.agg(*sums).first()
    rates, bad = {}, F.lit(False)
    for r in SOFT:
        mean = (s[f"{r}_f"] or 0) / max(s["n"] or 0, 1)
        spread = max((s[f"{r}_q"] or 0.0) / max(s["n"] or 0, 1) - mean * mean, 1e-9)
        strength = min(max(mean * (1 - mean) / spread - 1, 2.0), 1e6)
        rates[f"rate_{r}"] = (F.col(r) + mean * strength) / (n + strength)
        bad = bad | ((rates[f"rate_{r}"] > BAD_RATE) & (rates[f"rate_{r}"] > 2 * mean))
    return hosts.select("_host", "host_docs", *[c.alias(k) for k, c in rates.items()], bad.alias("host_bad"))


def _verdict(m: Column) -> Column:
    total = sum(points(m)[1:], points(m)[0])
    return ~base_failed(m) & (total <= F.when(F.col("host_bad"), 0).otherwise(1))


def quality_report(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, source, metrics, base_failed, host_bad, kept for each row.  Texts are read once and not shuffled."""
    rows = written(docs.select("doc_id", "source", text_metrics(text_of(docs)).alias("_m")), "metrics")
    got = lookup_join(rows, host_verdicts(rows).select("_host", "host_bad"), "source", "_host")
    m = F.col("_m")
    return got.select("doc_id", "source", "_m.*", base_failed(m).alias("base_failed"), "host_bad", _verdict(m).alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that are kept, same columns.  Texts are measured twice instead of being shuffled."""
    hosts = host_verdicts(docs.select("source", text_metrics(text_of(docs)).alias("_m")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), "source", text_metrics(text_of(docs)).alias("_m"))
    got = lookup_join(rows, hosts.select("_host", "host_bad"), "source", "_host")
    return got.where(_verdict(F.col("_m"))).select(*[F.col("_all")[c].alias(c) for c in docs.columns])
