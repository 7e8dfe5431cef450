"""Damaged lines of documents against every single damage and against all lines within one edit."""

import random

from maskwright.operators import mrz_repair as M


def lower(r, format="TD3"):
    number = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=9)) if r.random() < 0.7 else "".join(r.choices("0123456789", k=7)) + "<<"
    birth, expiry = f"{r.randint(40, 99)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}", f"{r.randint(26, 36)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}"
    with_check = lambda v: v + str(M.check_digit(v))
    head = with_check(number) + "UTO" + with_check(birth) + r.choice("MFX<") + with_check(expiry)
    if format == "TD3":
        return head + "<" * 14 + "<" + str(M.check_digit(number + birth))
    return head + "<" * 7 + str(M.check_digit(number + birth))


def fields(line):
    return line[:10], line[13:20], line[21:28]


def test_each_single_damage_is_mended():
    r = random.Random(5)
    for _ in range(25):
        line = lower(r, r.choice(["TD3", "TD2"]))
        damaged = {line[:i] + line[i + 1 :] for i, c in enumerate(line) if c == "<"} | {line[:i] + "<" + line[i:] for i, c in enumerate(line) if c == "<"}
        back = {v: k for k, v in M.TO_DIGIT.items()}
        damaged |= {line[:i] + back[c] + line[i + 1 :] for i, c in enumerate(line) if c in back and 13 <= i < 28 and i != 20}
        for x in sorted(damaged):
            got = M.repaired(x)
            assert got is not None, (line, x)
            # A repair is as good as the truth: as many right checks, and no dearer.
            assert got[3] == 3 and got[2] <= 1, (line, x, got)
            if got[1] != line:
                assert M.right_checks(got[0], got[1]) == 3


def test_repairs_are_all_lines_within_the_cost():
    r = random.Random(8)
    M_FORMAT = "TEST"
    M.FORMATS[M_FORMAT] = "ADXC"
    try:
        for _ in range(300):
            line = "".join(r.choices("AK0O1<5S", k=r.randint(2, 6)))
            want = {}
            # Brute force: every way to lose fillers of the line, to add fillers, to read look-alikes.
            from itertools import combinations, product

            slots = M.FORMATS[M_FORMAT]
            for lost in range(3):
                for gone in combinations([i for i, c in enumerate(line) if c == "<"], lost):
                    rest = [c for i, c in enumerate(line) if i not in gone]
                    for places in combinations(range(len(slots)), max(len(slots) - len(rest), 0)):
                        if len(rest) + len(places) != len(slots) or any(slots[p] not in "AXC" for p in places):
                            continue
                        feed = iter(rest)
                        options = [[("<", 1)] if i in places else M.choices(slots[i], next(feed)) for i in range(len(slots))]
                        for way in product(*options):
                            cost = lost + sum(c for _, c in way)
                            text = "".join(c for c, _ in way)
                            if cost <= M.MOST:
                                want[text] = min(want.get(text, 9), cost)
            assert M.repairs(line, M_FORMAT) == want, line
    finally:
        del M.FORMATS[M_FORMAT]


def test_ordinary_lines_stay_out(spark):
    r = random.Random(2)
    line = lower(r)
    rows = [(1, 0, line), (1, 1, "ORDER NUMBER 1234567890 FROM 2024 OVER 99 EUROS"), (2, 0, None), (2, 1, ""), (3, 0, line.replace("<", "", 1)), (4, 0, "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<"), (5, 0, "PKUTOERIKSSONKKANNAKKKKKKKKKKKKKKKKKKKKKKKKK"[:44])]
    got = {r.page_id: r for r in M.repair(spark.createDataFrame(rows, "page_id long, line_no int, text string")).collect()}
    assert set(got) == {3, 4, 5}
    assert fields(got[3].line) == fields(line) and got[3].checks == 3
    assert got[4].line == "P<UTOERIKSSON<<ANNA<MARIA".ljust(44, "<") and len(got[5].line) == 44


def test_the_first_cost_with_all_checks_right_is_the_best_of_all():
    r = random.Random(21)
    for _ in range(60):
        line = lower(r, r.choice(["TD3", "TD2"]))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(line))
            line = r.choice([line[:i] + line[i + 1 :], line[:i] + "<" + line[i:], line[:i] + r.choice("OQDILZSBGK0<") + line[i + 1 :]])
        assert M.repaired(line) == M.best_within(line, M.MOST), line


def test_a_filler_lost_needs_no_dear_repairs(monkeypatch):
    tried, whole = [], M.repairs
    monkeypatch.setattr(M, "repairs", lambda line, format, most=M.MOST: tried.append(most) or whole(line, format, most))
    line = lower(random.Random(3))
    assert M.repaired(line[:40] + line[41:])[2] == 1
    assert max(tried) == 1
