"""Pages: guesses need anchors, geometry decides which count, and lines that used to be taken wrongly."""

from datetime import date

from maskwright.operators import classify, grid, redact, rules
from maskwright.sources import ingest

BOXED = "page_id long, line_no int, text string, confidence double, l double, t double, r double, b double"


def found(spark, pages, **kw):
    """Findings by page; a page is a list of (text, l, t) or one text."""
    rows = []
    for p, lines in enumerate(pages):
        for i, (text, l, t) in enumerate([(lines, 40, 100)] if isinstance(lines, str) else lines):
            rows.append((p, i, text, 0.95, float(l), float(t), float(l) + 20 * len(text), float(t) + 20))
    out = [[] for _ in pages]
    for r in classify.classify(spark.createDataFrame(rows, BOXED), **kw).collect():
        out[r.page_id].append((r.kind, r.token))
    return [sorted(x) for x in out]


GUESS = ("PERSON_NAME", "Paul Young")
NEAR = [
    (None, False),
    (("tel +1 415 555 2671", 40, 140), True),  # a line below
    (("tel +1 415 555 2671", 40, 190), False),  # 70 px below: over a height and a half
    (("tel +1 415 555 2671", 400, 105), True),  # on the same row, whatever the distance
    (("tel +1 415 555 2671", 700, 140), False),  # below, but far aside
    (("jo@example.com", 40, 60), True),
    (("12 Main Street, Boston, MA 02110", 40, 140), True),
    (("138****1234", 40, 140), True),
    (("乘客", 40, 140), True),
    (("成人", 40, 140), True),
    (("成人用品", 40, 140), False),
    (("Passenger", 40, 140), True),
    (("先生", 40, 140), False),  # titles must touch
    (("ordinary words", 40, 140), False),
]


def test_a_guess_needs_an_anchor_near_by(spark):
    pages = [[("Paul Young", 40, 100), *([other] if other else [])] for other, _ in NEAR]
    pages += ["Paul Young 先生", "Paul Young +1 415 555 2671", "He Ran away fast"]
    got = found(spark, pages)
    assert [GUESS in x for x in got] == [near for _, near in NEAR] + [True, True, False]
    assert got[-1] == []
    # Anchors count even where their rule is off.
    off = found(spark, pages, states={"phone": "OFF", "email": "OFF", "address": "OFF"})
    assert [GUESS in x for x in off] == [GUESS in x for x in got] and off[1] == [GUESS]


def test_unanchored_guesses_on_demand(spark):
    assert found(spark, ["Paul Young"], states={r.id: "OFF" for r in rules.CATALOGUE if r.id != "name"}, mask_unanchored=True) == [[GUESS]]


def test_lines_that_are_no_findings_and_lines_that_are(spark):
    none = ["Exp. 12/24 hours open", "Expiry 05/99 of the offer", "Guest: Free Wifi Zone", "Name: Total Amount Due", "To: Whom It May", "He Ran away fast", "She sat on Paul Young albums", "Address: see below for details", "order no AB12 CDE", "Born on 12 May 1890"]
    some = {"收货人 张三": ("PERSON_NAME", "张三"), "010-62345678": ("PHONE", "010-62345678"), "tel 02 9374 4000": ("PHONE", "02 9374 4000"), "mail a.b@example.com.": ("EMAIL", "a.b@example.com"), "ssn 123-45-6789": ("SSN", "123-45-6789"), "00:1B:44:11:3A:B7": ("MAC_ADDR", "00:1B:44:11:3A:B7")}
    expiry = f"Valid thru 05/{(date.today().year + 2) % 100:02d}"
    cards = [expiry, [(expiry, 40, 100), ("4111 1111 1111 1111", 40, 400)]]
    got = found(spark, [*none, *some, *cards])
    assert dict(zip(none, got)) == {line: [] for line in none}
    assert dict(zip(some, got[len(none) :])) == {line: [hit] for line, hit in some.items()}
    assert got[-2] == [] and [k for k, _ in got[-1]] == ["PAYMENT_CARD"] * 2


def test_redacted_documents_ask_for_anchors(spark):
    docs = [(1, "Paul Young"), (2, "Paul Young\ntel +1 415 555 2671"), (3, "Paul Young\n\ntel +1 415 555 2671"), (4, None), (5, "Dear Paul Young 先生")]
    got = {r.doc_id: (r.redacted, r.n_masks) for r in redact.redact_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == ("Paul Young", 0)
    assert got[2] == ("[PERSON_NAME]\ntel [PHONE]", 2)
    assert got[3] == ("Paul Young\n\ntel [PHONE]", 1)
    assert got[4] == ("", 0)
    assert got[5][0] == "Dear [PERSON_NAME] 先生"


def test_forms_are_redacted_by_page(spark):
    lines = [("Surname", 40, 100), ("SMITH", 40, 125), ("Passport No.", 40, 200), ("E12345678", 340, 202), ("Paul Young", 40, 900)]
    rows = [(1, i, text, 0.95, float(l), float(t), float(l) + 20 * len(text), float(t) + 20) for i, (text, l, t) in enumerate(lines)]
    df = spark.createDataFrame(rows, BOXED)
    only = {r.id: "OFF" for r in rules.CATALOGUE if r.id not in ("name", "passport")}
    got = {r.line_no: (r.redacted, r.n_masks) for r in redact.redact_pages(df, only).collect()}
    assert got == {0: ("Surname", 0), 1: ("[PERSON_NAME]", 1), 2: ("Passport No.", 0), 3: ("[PASSPORT]", 1), 4: ("Paul Young", 0)}


def test_near_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    boxes = [(p, i, float(rng.randint(0, 900)), float(rng.randint(0, 900)), rng.choice([5, 20, 33, 150, 400])) for p in range(3) for i in range(40)]
    df = spark.createDataFrame([(p, i, x, y, x + 50.0, y + float(h)) for p, i, x, y, h in boxes], "page_id long, line_no int, l double, t double, r double, b double")
    pairs = grid.near_pairs(df, df, reach=1.5)
    got = sorted((r.page_id, r.line_no, r.line_no_2) for r in pairs.collect())
    assert len(got) == len(set(got))
    want = set()
    for p, i, _, y, h in boxes:
        for q, j, _, z, k in boxes:
            gap = max(y, z) - min(y + h, z + k)
            if p == q and gap <= 1.5 * max(h, k):
                want.add((p, i, j))
    assert want <= set(got)


def test_a_page_of_very_many_lines(spark):
    n = 5_000
    lines = spark.range(n).selectExpr("1L page_id", "cast(id as int) line_no", "case when id % 1000 = 0 then 'Paul Young' when id % 2000 = 1 then 'tel +1 415 555 2671' else 'x' end text", "0.95D confidence")
    boxed = ingest.with_boxes(lines)
    assert classify.classify(boxed, {r.id: "OFF" for r in rules.CATALOGUE if r.id not in ("name", "phone")}).where("kind = 'PERSON_NAME'").count() == 3
    assert rules.BY_ID["name"].finders[-1].guess
