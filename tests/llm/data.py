"""Small awkward tables: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns that carry the names the operators use inside.
CLASH = "size long, h long, _m string, _all string, fp long, key string, base string, spans string, weak string, copies int, _host string, host_bad string, `_k` string, taken long, whole long, ids string, part int, bucket int, component_id long, fingerprint string"


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


def texts(seed=3):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(900)] + "the of and to in that".split() + ["é", "Straße", "日本", "x,", "y.", "A-B"]
    long_ = words(rng, 6000, pool)
    base = words(rng, 300, pool)
    near = base.split()
    near[150] = "changed"
    out = [
        None, "", "   \n\t ", "one", "two words", "a b c", base, base, base, " ".join(near), long_, long_ + " tail", words(rng, 200, pool) + base + words(rng, 100, pool),
        "x" * 3000, "ab" * 900, "the same line\n" * 60, "A!! " * 80, "#$% " * 70, "\tTabbed\x0bvertical\x0cform\r\n" * 20, "é́ combining ́ NBSP\u00a0sep\u2028end " * 20, "\x01mark, x. y,z" * 20, "\U0001F600 emoji 𝔘 " * 30,
    ]
    return out + [words(rng, rng.randint(40, 400), pool) for _ in range(40)]


def rows(seed=3):
    """(doc_id, text, lang, source, n_chars): null ids and sources, a hot source, repeated rows and ids."""
    out = []
    for k, t in enumerate(texts(seed)):
        source = None if k % 9 == 8 else "hot" if k % 3 == 0 else f"s{k % 5}"
        out.append((k, t, None if k % 7 == 0 else "en", source, None if t is None else len(t)))
    out += [out[6], out[6], out[10], out[30], out[1]]  # repeated rows
    out += [(None, "no id, " * 30, "en", "s1", 210), (None, "no id, " * 30, "en", "s1", 210), (7, "another text under one id " * 9, None, "", 5)]
    return out


def table(spark, data=None, clash=False, parts=3):
    df = spark.createDataFrame(rows() if data is None else data, DOC).repartition(parts)
    if clash:
        from pyspark.sql import functions as F

        for c in CLASH.split(", "):
            name, kind = c.replace("`", "").split()
            df = df.withColumn(name, F.lit(7).cast(kind))
    return df
