"""Small document tables with the cases every operator must handle."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n_lines string, size string, fp string, h string"


def rows(texts, langs=None, sources=None, first=0):
    out = []
    for i, t in enumerate(texts):
        out.append((first + i, t, (langs or ["en"] * len(texts))[i], (sources or ["a"] * len(texts))[i], len(t or ""), "clash", "clash", "clash", "clash", "clash"))
    return out


def docs(spark, texts, **kw):
    return spark.createDataFrame(rows(texts, **kw), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def mixed(seed=1, n=60):
    """Invented texts: nulls, blanks, copies, near copies, repeated lines and one long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgñé", k=r.randint(1, 7))) for _ in range(80)]
    body = lambda k: " ".join(r.choices(vocab, k=k))
    out = [None, "", "   \n\t ", "one", "one two", "\n", "Licence A\nx", " licence a \ny"]
    for _ in range(n):
        out.append("\n".join(body(r.randint(1, 40)) for _ in range(r.randint(1, 5))))
    base = body(200)
    out += [base] * 5 + [base + " tail", "head " + base, base.replace(" ", "\n", 1), body(30) + " " + base[:300] + " " + body(30)]
    out += ["Licence A\n" + body(5) for _ in range(12)]
    out.append(body(6000))
    return out
