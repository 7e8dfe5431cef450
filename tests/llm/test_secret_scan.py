"""Secret scans: base spans and links by brute force, planted credentials, rare cases."""

import random
import re

import numpy as np

from maskwright.llm import secret_scan
from maskwright.llm.secret_scan import ENDPOINT, IDENTIFIER, LABELLED, NEEDS, TOKEN

SCHEMA = "doc_id long, text string, found string"


def found(spark, texts):
    rows = secret_scan.find(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)).collect()
    return [[(x.kind, x.token) for x in r.found] for r in sorted(rows, key=lambda r: r.doc_id)]


def brute_base(text):
    """Every rule by a walk from the left."""
    out, word = [], r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    rules = {"assign": (re.compile(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(1)) >= 8), "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 16), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 32)}
    for kind, (pattern, good) in rules.items():
        at = 0
        while at <= len(text):
            m = pattern.match(text, at)
            if m:
                if good(m):
                    out.append((m.start(), kind, m.end()))
                at = m.end()
            else:
                at += 1
    order = {"assign": 0, "access": 1, "hex": 2}
    return [f"{k}:{s}:{e}" for s, k, e in sorted(out, key=lambda x: (x[0], order[x[1]]))]


def test_base_spans_on_random_texts(spark):
    rng = random.Random(11)
    bits = ["password", "PassWd", "ſecret", "secret", "toKen", "api_key", "apikey", "AKIA", "AKIAAKIA", "=", ":", " ", '"', "'", "\n", "é", "𝔘", "deadbeef", "0123456789abcdef", "Z9", "x", "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = secret_scan.find(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA))
    for r in df.select("doc_id", secret_scan.digest(df.found, secret_scan.BASE).alias("d")).collect():
        assert r.d == ",".join(brute_base(texts[r.doc_id]))


def test_links_equal_all_pairs():
    rng = random.Random(7)
    for _ in range(200):
        n, m = rng.randint(1, 30), rng.randint(1, 12)
        start = np.sort(np.array([rng.randint(0, 200) for _ in range(n)]))
        role = np.array([rng.choice([IDENTIFIER, LABELLED, TOKEN, ENDPOINT]) for _ in range(n)])
        low = np.array([rng.randint(0, 200) for _ in range(m)])
        high = low + np.array([rng.randint(0, 60) for _ in range(m)])
        want = [any(a <= s < b and all(any(a <= t < b and q & need for t, q in zip(start, role)) for need in NEEDS[r]) for a, b in zip(low, high)) for s, r in zip(start, role)]
        assert secret_scan.linked(start, role, low, high).tolist() == want


def test_weak_parts_only_count_in_company(spark):
    secret = "pwd: hunter2"
    apart = "\n\n"
    far = "\n" + "filler words\n" * 60
    texts = [secret, "user=alice\n" + secret, "user=alice" + apart + secret, "user=alice" + far + secret, "host: db.example.com\n" + secret, "host: db.example.com\nuser=alice\n" + secret, "host: db.example.com\nuser=alice", "psql postgres://bob:s3same@db.local:5432/x", "client_id=77aa bb Xq7Lm2Pw9Rt4Zk8Vn3Bc", "Xq7Lm2Pw9Rt4Zk8Vn3Bc at https://example.com/a"]
    got = found(spark, texts)
    pwd = ("secret", "hunter2")
    assert got[:4] == [[], [("identifier", "alice"), pwd], [], []]
    assert got[4] == [pwd]
    assert got[5] == [("endpoint", "db.example.com"), ("identifier", "alice"), pwd]
    assert got[6] == []
    assert got[7] == [("identifier", "bob"), ("secret", "s3same"), ("endpoint", "db.local:5432")]
    assert got[8] == [("identifier", "77aa"), ("secret", "Xq7Lm2Pw9Rt4Zk8Vn3Bc")]
    assert got[9] == []


def test_strong_parts_confirm_weak_ones_and_stay(spark):
    key = "AKIA" + "Q" * 16
    got = found(spark, [f"{key} pwd=abcd1", f"login: eve\ntoken = {'0f' * 20}", f"user: null {key}"])
    assert got[0] == [("access", key), ("secret", "abcd1")]
    assert [k for k, _ in got[1]] == ["identifier", "assign", "hex"]
    assert ("access", key) in got[2]


def test_rare_cases(spark):
    long = "user=alan\npwd=abcd1\n\n" * 20_000
    got = found(spark, [None, "", "\n\n \n", long, "=" * 100_000 + "a" * 100_000 + "http://" * 10_000])
    assert got[:3] == [[], [], []] and len(got[3]) == 40_000 and got[3][:2] == [("identifier", "alan"), ("secret", "abcd1")]
    assert secret_scan.find(spark.createDataFrame([], SCHEMA)).collect() == []


def test_added_spans_never_overlap(spark):
    rng = random.Random(3)
    bits = ["user=", "pwd=", "key: ", "host=", "a.b", "Xq7Lm2Pw9Rt4Zk8Vn3Bc", "https://", "u:pw@h", " ", "\n", "token=abcdefgh", "AKIAQQQQQQQQQQQQQ", "1.2.3.4:80"]
    texts = ["".join(rng.choice(bits) for _ in range(40)) for _ in range(150)]
    for r in secret_scan.find(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)).collect():
        for i, x in enumerate(r.found):
            assert texts[r.doc_id][x.start : x.end] == x.token
            for y in r.found[i + 1 :]:
                assert x.kind in secret_scan.BASE and y.kind in secret_scan.BASE or x.end <= y.start or y.end <= x.start
