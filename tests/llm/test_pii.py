import random
import re

from maskwright.llm import pii

from .helpers import docs, empty, mixed


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


BRUTE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
}
ODD = [
    "a@b.c_d@e.f x..@y.z, q@w", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.0255.9 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 0000000000000000 0000000000000",
    "+1 (784) 555-8120. +49 30 1234567890123456 ++1 22 333 444 5 +1", "é😀 x@y.de 😀 10.0.0.1", "9" * 3000, "a." * 3000 + "@", "4111111111111111 4111111111111111",
    'token = "3f76bb46f51625a07193ae74d1cc485f188b9b5d" end', "password=49b0203a9cc466e6ee x", "IBAN: DE89370400440532013000 SSN 123-45-6789", "chapter 12345678 of 2020-10-11",
]


def test_base_spans_against_brute_force(spark):
    texts = mixed() + ODD
    got = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        for kind, (pattern, valid) in BRUTE.items():
            assert [(x.start, x.end) for x in got[i][kind]] == [m.span() for m in re.finditer(pattern, t or "") if valid(m[0])], (i, kind)


def test_secrets_are_added_and_prose_is_not(spark):
    base = ["some plain words here " * 5] * 20 + [f"order 1234567{i} was page 9876543{i} of it" for i in range(10)]
    secret = [f'the token = "{i:02x}f7a6bb46f51625a07193ae74d1cc48" here' for i in range(10)] + [f"password=49b0203a9cc466e6{i:02d} x" for i in range(10)]
    texts = base + secret
    got = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        found = [t[x.start : x.end] for x in got[i].secret]
        assert found == (re.findall("[0-9a-f]{16,}", t) if i >= len(base) else []), t


def test_digest_and_empty_table(spark):
    out = pii.find(docs(spark, ["a@b.cd 10.0.0.1"])).select(pii.digest(*pii.BASE).alias("d"))
    assert out.first().d == "email:0:6,ip:7:15"
    assert pii.find(empty(spark)).count() == 0


def planted(seed, n):
    """(texts, wanted spans per text) with one finding of every sort, and look-alikes without one."""
    draw = random.Random(seed)
    pick = lambda alphabet, k: "".join(draw.choices(alphabet, k=k))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    sorts = [
        lambda: ("the pass ", "AKIA" + pick(up + num, 16), " was sent"), lambda: ("password=", pick(low, 12), " and more"), lambda: ("PIN: ", pick(num, 5), ", keep it"),
        lambda: ('token = "', pick("0123456789abcdef", 40), '" here'), lambda: ("secret: ", pick(low + up + num + "+/", 30) + "==", " end"), lambda: ("dear Mrs ", pick(up, 1) + pick(low, 6), ", we write"),
        lambda: ("met ", "Maria Anna Peter Susan".split()[draw.randrange(1, 4)] + " " + pick(up, 1) + pick(low, 7), " today"), lambda: ("pay IBAN ", "DE89 3704 0044 " + pick(num, 4) + " " + pick(num, 4) + " 00", " soon"),
        lambda: ("SSN ", f"{pick(num, 3)}-{pick(num, 2)}-{pick(num, 4)}", " on file"), lambda: ("lives at ", f"{draw.randrange(1, 999)} {pick(up, 1) + pick(low, 5)} Street", " now"),
        lambda: ("wohnt in der ", f"{pick(up, 1) + pick(low, 6)}straße {draw.randrange(1, 99)}", " dort"),
    ]
    plain = [lambda: f"order {pick(num, 9)} of 2020-10-11", lambda: "password: required here", lambda: f"see chapter {pick(num, 8)} and {pick(low, 9)}", lambda: f"The {pick(low, 7)} is {pick(low, 5)}. Then it went", lambda: f"build {pick(num, 8)}-{pick(num, 3)} done"]
    texts, wanted = [], []
    for i in range(n):
        if i % 2:
            a, value, b = sorts[i // 2 % len(sorts)]()
            texts.append(f"é 😀 some words {a}{value}{b}")
            wanted.append([(len("é 😀 some words " + a), len("é 😀 some words " + a + value))])
        else:
            texts.append(f"some words, {plain[i // 2 % len(plain)]()} and so on")
            wanted.append([])
    return texts, wanted


def test_recall_and_precision_of_added_spans_on_planted_data(spark):
    texts, wanted = planted(5, 660)
    got = {r.doc_id: sorted((x.start, x.end) for k in pii.ADDED for x in r[k]) for r in pii.find(docs(spark, texts)).collect()}
    right = sum(len(set(got[i]) & set(w)) for i, w in enumerate(wanted))
    missed = {texts[i] for i, w in enumerate(wanted) if not set(w) <= set(got[i])}
    assert right >= 0.9 * sum(map(len, wanted)), sorted(missed)[:40]
    assert right >= 0.9 * sum(map(len, got.values())), [texts[i] for i, w in enumerate(wanted) if set(got[i]) - set(w)][:40]


def test_tokens_that_no_labeler_speaks_for_are_not_added(spark):
    texts = [f"build {i:08d}-123 of 2020-10-11 and page {i:09d}" for i in range(60)]
    assert not any(r[k] for r in pii.find(docs(spark, texts)).collect() for k in pii.ADDED)


def test_two_kinds_of_secrets_with_different_labelers_are_both_found(spark):
    r = random.Random(1)
    keys = ["AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) for _ in range(40)]
    texts = [f"some words {k} and more" for k in keys] + [f"the password=49b0203a9cc466e6{i:02d} x" for i in range(80)]
    got = {r.doc_id: len(r.secret) for r in pii.find(docs(spark, texts)).collect()}
    assert all(got[i] == 1 for i in range(len(texts)))


def test_places_hold_over_many_matches_and_added_spans_never_overlap(spark):
    text = " ".join(f"é a{i}@b.co password=x{i:07d}q Mr Smith{chr(97 + i % 26)}" for i in range(1200))
    row = pii.find(docs(spark, [text, text])).first()
    assert [(x.start, x.end) for x in row.email] == [m.span() for m in re.finditer(BRUTE["email"][0], text)]
    assert [(x.start, x.end) for x in row.secret] == [m.span(1) for m in re.finditer("password=(\\w+)", text)]
    spans = sorted((x.start, x.end) for k in (*pii.BASE, *pii.ADDED) for x in row[k])
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_repeated_rows_and_null_ids_keep_their_rows(spark):
    rows = [(1, "password=49b0203a9cc466e6ee x")] * 3 + [(None, "a@b.cd"), (2, None)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, len(r.email), len(r.secret)) for r in got) == [(0, 1, 0), (1, 0, 1), (1, 0, 1), (1, 0, 1), (2, 0, 0)]
