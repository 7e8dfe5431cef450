"""Names by lattice and roles: brute force over all paths, held-out sentences, guesses in classify."""

import random

from maskwright.operators import classify, names, rules

SURNAMES, GIVEN = "王李张高周", "明芳伟丽强静"
WORDS = ["订单", "签收", "高兴", "周末", "王府井", "的", "在", "张贴", "由", "ab"]


def sentences(r, n):
    rows, texts = [], []
    for i in range(n):
        parts = [(r.choice(WORDS), "O") for _ in range(r.randint(0, 3))]
        truth = []
        if r.random() < 0.7:
            given = [(r.choice(GIVEN), "G") for _ in range(r.randint(1, 2))]
            start = sum(len(w) for w, _ in parts)
            parts += [(r.choice(SURNAMES), "S"), *given]
            truth = [(start, start + 1 + len(given))]
        parts += [(r.choice(WORDS), "O") for _ in range(r.randint(0, 3))]
        rows += [(i, k, w, role) for k, (w, role) in enumerate(parts)]
        texts.append(("".join(w for w, _ in parts), truth))
    return rows, texts


def model_of(spark, r, n=300):
    return names.fit(spark.createDataFrame(sentences(r, n)[0], "sentence int, pos int, token string, role string"), ("S", "G"))


def every_path(text, model):
    roles, edges = sorted(model.unknown), names.lattice(text, names.trie(model.words))

    def go(i, role):
        if i == len(text):
            yield model.steps[role, ""], []
            return
        for end, word in edges[i]:
            for new in roles:
                emits = names.emission(word, new, model)
                if emits is not None:
                    for score, path in go(end, new):
                        yield score + emits + model.steps[role, new], [(i, end, new), *path]

    return go(0, "")


def test_the_best_of_all_paths(spark):
    r = random.Random(3)
    model = model_of(spark, r)
    alphabet = [*SURNAMES, *GIVEN, *WORDS, "x", "1", "ab1", "。", "无"]
    for _ in range(120):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(1, 4)))[:7]
        best = max(score for score, _ in every_path(text, model))
        score, path = names.best_path(text, model)
        assert abs(score - best) < 1e-9
        assert any(p == path and abs(s - best) < 1e-9 for s, p in every_path(text, model))
        assert "".join(text[a:b] for a, b, _ in path) == text
    assert names.best_path("", model) == (0.0, [])


def test_held_out_sentences_and_long_lines(spark):
    r = random.Random(4)
    model = model_of(spark, r)
    _, texts = sentences(r, 200)
    rows = [(1, i, t) for i, (t, _) in enumerate(texts)] + [(2, 0, None), (2, 1, ""), (3, 0, "订单由王明签收。" * 2000)]
    got = {}
    for x in names.find(spark.createDataFrame(rows, "page_id long, line_no int, text string"), model).collect():
        got.setdefault((x.page_id, x.line_no), []).append((x.start, x.end))
    right = sum(sorted(got.get((1, i), [])) == truth for i, (_, truth) in enumerate(texts))
    assert right >= 0.97 * len(texts)
    assert len(got[3, 0]) == 2000 and {b - a for a, b in got[3, 0]} == {2}


def test_names_are_guesses_in_classify(spark):
    model = model_of(spark, random.Random(5))
    rows = [(1, 0, "由王明签收", 0.95, 0.0, 0.0, 100.0, 20.0), (2, 0, "由王明签收", 0.95, 0.0, 0.0, 100.0, 20.0), (2, 1, "tel +1 415 555 2671", 0.95, 0.0, 30.0, 380.0, 50.0)]
    df = spark.createDataFrame(rows, "page_id long, line_no int, text string, confidence double, l double, t double, r double, b double")
    only = {r.id: "OFF" for r in rules.CATALOGUE if r.id not in ("name", "phone")}
    got = classify.classify(df, only, guesses=names.find(df, model)).where("kind = 'PERSON_NAME'").collect()
    assert [(x.page_id, x.token, x.guess) for x in got] == [(2, "王明", True)]
