from maskwright.operators import redact, rules

#: (line, kind): lines without an ASCII digit, @, <, *, colon or title that hold a finding.
LINES = [
    ("call １３８００１３８０００ now", "PHONE"),
    ("use sk-abcdefghijklmnopqrstuv here", "API_KEY"),
    ("北京市朝阳区建国路", "POSTAL_ADDRESS"),
    ("at AA-BB-CC-DD-EE-FF today", "MAC_ADDR"),
    ("VIN ABCDEFGHJKLMNPRST", "VIN"),
    ("see example.com/path there", "URL"),
]


def test_no_line_with_a_finding_is_skipped(spark):
    """All lines at once, as the plan of the whole catalogue takes long to compile."""
    states = {"url": "ON"}
    docs = spark.createDataFrame([(i, "plain\n" + line) for i, (line, _) in enumerate(LINES)], "doc_id long, text string")
    got = {r.doc_id: r for r in redact.redact_documents(docs, states).collect()}
    for i, (line, kind) in enumerate(LINES):
        assert got[i].n_masks == 1 and kind in got[i].redacted, line


def test_every_rule_says_what_it_needs():
    assert set(rules.NEEDS) == set(rules.BY_ID)


def test_gates_only_try_words_where_their_first_characters_stand():
    import re

    from maskwright.functions.spans import by_first

    assert by_first("Exp\\.?|Valid thru|有效期至?", True) == "(?:(?=[EVev][AXax])(?i:Exp\\.?|Valid thru)|(?=[一-鿿])(?:有效期至?))"
    assert by_first("e-?mail|tel") == "(?=[et])(?:e-?mail|tel)"
    for words in (rules._EXPIRY, rules._BIRTH, rules._PASSPORT, rules.NAME_LABELS, rules._PICKUP):
        own = re.compile(by_first(words, True))
        for word in words.replace("\\", "").replace("?", "").split("|"):
            assert own.search(f"x{word.upper()}")
