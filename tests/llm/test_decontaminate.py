import random
import re

import pytest

from maskwright.llm import decontaminate

from .helpers import docs, empty

ITEMS = "item_id long, text string, key string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=13):
    known = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            known.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    sizes = {len(k) for k in known}
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in known:
                    hit |= set(range(i, i + n))
                    ids |= known[g]
        out.append((len(w), len(hit), sorted(ids)))
    return out


def case(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeÉé1", k=r.randint(1, 4))) for _ in range(60)]
    body = lambda k: " ".join(r.choices(vocab, k=k))
    items = [(i, body(r.choice([1, 2, 4, 5, 12, 13, 14, 40]))) for i in range(12)] + [(50, None), (51, "  .,"), (3, body(20)), (60, "Éa b C d e f g h i j k l m n")]
    texts = [None, "", "...", body(3000)]
    for _ in range(40):
        item = r.choice(items)[1] or ""
        texts.append(body(r.randint(0, 60)) + ", " + item.upper().replace("É", "É") + ". " + body(r.randint(0, 60)))
    texts += [items[5][1]] * 4 + ["éa b c d e f g h i j k l m n", "Éa B c d e f g h i j k l m"]
    return texts, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("most", [200_000, 0])
def test_against_brute_force(spark, seed, most, monkeypatch):
    texts, items = case(seed)
    monkeypatch.setattr(decontaminate.occurrences, "__defaults__", (13, 5, most))
    table = spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.overlaps(docs(spark, texts), table).collect()}
    assert got == dict(enumerate(brute(texts, items)))


def test_clean_rows_and_empty_tables(spark):
    texts, items = case(3)
    table = spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
    source = docs(spark, texts)
    got = decontaminate.clean_rows(source, table)
    assert got.columns == source.columns
    assert {r.doc_id for r in got.collect()} == {i for i, (n, hit, _) in enumerate(brute(texts, items)) if not (hit and 20 * hit >= n)}
    assert decontaminate.overlaps(empty(spark), table).count() == 0
    assert decontaminate.clean_rows(source, table.limit(0)).count() == len(texts)
