import random

import numpy as np

from maskwright.llm import kneser_ney as kn
from maskwright.llm import language_id, toxicity

from .helpers import docs


def table_of(spark, rows, order):
    return kn.model_table(kn.ngram_counts(spark.createDataFrame(rows, "cls int, text string"), order), order)


def test_every_ngram_has_an_entry_and_unseen_ones_back_off(spark):
    draw = random.Random(3)
    rows = [(i % 2, " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(20))) for i in range(40)]
    table = table_of(spark, rows, 5).toArrow()
    seen = {}
    for cls, text in rows:
        code, _ = kn.codes(*kn.symbols(kn.pa.array([text])), 5)
        seen.setdefault(cls, set()).update(code.tolist())
    for cls in (0, 1):
        kept = {r["code"] for r in table.to_pylist() if (r["cls"], r["ord"], r["kind"]) == (cls, 5, "p")}
        assert kept == seen[cls]
    model = kn.Model(table, 5, 2)
    other = np.array(sorted(seen[1] - seen[0]), np.int64)
    assert len(other) and not model._find((0, 5, "p"), other, 0.0)[1].any()


def test_a_model_too_large_to_send_gives_the_same_scores(spark, monkeypatch):
    kind, rude = "a calm and friendly walk in the park", "you vile filthy scum get lost"
    texts = [kind, rude] * 40 + [None, "", rude + " now", kind + " now", "zebra quartz"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    table = docs(spark, texts, langs=["en", "de"] * 42 + ["en"])

    def both():
        tox = {r.doc_id: r.score for r in toxicity.score(table, labels).collect()}
        return tox, {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(table).collect()}

    sent = both()
    monkeypatch.setattr(kn, "MOST_SENT", 0)
    joined = both()
    assert sent[0].keys() == joined[0].keys() and all(abs(sent[0][k] - joined[0][k]) < 1e-4 for k in sent[0])
    assert all(sent[1][k][0] == joined[1][k][0] and abs(sent[1][k][1] - joined[1][k][1]) < 1e-4 for k in sent[1])


def test_letters_of_all_scripts_stay_apart():
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha() and c == c.lower()[0]]
    sym, offsets = kn.symbols(kn.pa.array(letters))
    rows = {tuple(sym[a:b].tolist()) for a, b in zip(offsets, offsets[1:])}
    assert len(rows) == len(letters) and sym.max() < kn.SYMBOLS
    assert kn.symbols(kn.pa.array(["a中b", None, "中"]))[1].tolist() == [0, 5, 6, 9]


def brute(codes, order):
    """{n: {n-gram: p}} and {n: {history: weight}} of one class, n-grams as tuples of symbols, the oldest first."""
    def gram(code):
        return tuple(code >> kn.BITS * k & kn.SYMBOLS - 1 for k in reversed(range(order)))

    counts = {order: {}}
    for c in codes:
        counts[order][gram(c)] = counts[order].get(gram(c), 0) + 1
    for n in range(order - 1, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    p, weights = {}, {}
    for n in range(1, order + 1):
        ones, twos = (sum(x == k for x in counts[n].values()) for k in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))
        total, types = {}, {}
        for g, x in counts[n].items():
            total[g[:-1]] = total.get(g[:-1], 0) + x
            types[g[:-1]] = types.get(g[:-1], 0) + 1
        weights[n] = {h: d * types[h] / total[h] for h in total}
        p[n] = {g: max(x - d, 0) / total[g[:-1]] + weights[n][g[:-1]] * (p[n - 1][g[1:]] if n > 1 else 1 / kn.SYMBOLS) for g, x in counts[n].items()}
    return p, weights


def test_probabilities_against_brute_force(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choices("ab ñ中文", k=draw.randint(1, 40))) for _ in range(25)]
    other = ["".join(draw.choices("abc 中", k=30)) for _ in range(10)]
    order = 3
    table = table_of(spark, [(0, t) for t in texts] + [(1, t) for t in other], order).toArrow()
    code, _ = kn.codes(*kn.symbols(kn.pa.array(texts)), order)
    p, weights = brute(code.tolist(), order)
    got = {(r["ord"], r["kind"], r["code"]): r["val"] for r in table.to_pylist() if r["cls"] == 0}
    pack = lambda g: sum(s << kn.BITS * k for k, s in enumerate(reversed(g)))
    want = {(n, "p", pack(g)): x for n in p for g, x in p[n].items()} | {(n, "b", pack(h)): x for n in weights for h, x in weights[n].items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    # Unseen n-grams back off, order by order.
    model = kn.Model(table, order, 2)
    probes = kn.codes(*kn.symbols(kn.pa.array(["".join(draw.choices("abcñ中文x ", k=60))])), order)[0]
    index, values = model.log_p(probes)

    def p_of(g):
        if not g:
            return None
        if g in p[len(g)]:
            return p[len(g)][g]
        return 1 / kn.SYMBOLS / 10 if len(g) == 1 else weights[len(g)].get(g[:-1], 1.0) * p_of(g[1:])

    for c, v in zip(probes.tolist(), values[index][:, 0].tolist()):
        g = tuple(c >> kn.BITS * k & kn.SYMBOLS - 1 for k in reversed(range(order)))
        assert abs(v - np.log(max(p_of(g), 1e-12))) < 1e-4
