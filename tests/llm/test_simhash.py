import random

from maskwright.llm import simhash

from .helpers import docs, empty, mixed


def brute_print(text):
    from xxhash import xxh64_intdigest

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    """By closure over all pairs."""
    label = dict(enumerate(ids))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(i):
                if bin(prints[i] ^ prints[j]).count("1") <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [label[i] for i in range(len(ids))]


def test_texts_against_brute_force(spark):
    texts = mixed(5)
    prints = [brute_print(t) for t in texts]
    expected = brute_components(range(len(texts)), prints)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (prints[i], expected[i]) for i in range(len(texts))}


def test_links_on_crowded_cells(spark):
    """Chains and a dense ball of fingerprints, so that cells hold many."""
    r = random.Random(2)
    prints = {0, (1 << 64) - 1}
    for _ in range(4):
        x = r.getrandbits(64)
        for _ in range(40):
            y = x
            for _ in range(r.randint(0, 3)):
                y ^= 1 << r.randrange(64)
            prints.add(y)
            if r.random() < 0.2:
                x = y
    prints = sorted(prints)
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    got = simhash.components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    expected = brute_components(range(len(prints)), prints)
    assert {r.fp % (1 << 64): r.component_id for r in got} == dict(zip(prints, expected))


def test_one_of_each(spark):
    texts = mixed(7)
    table = docs(spark, texts)
    expected = brute_components(range(len(texts)), [brute_print(t) for t in texts])
    got = simhash.one_of_each(table.union(table))
    assert got.columns == table.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(expected))


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_both_grids_find_the_same_links_as_the_exact_one(spark):
    """Ten thousand fingerprints with hot cells: balls around few centres, chains, and a ball with half of all rows."""
    r = random.Random(9)
    prints = set()
    for k in range(300):
        x = r.getrandbits(64)
        for _ in range(5000 if k == 0 else 17):
            y = x
            for _ in range(r.randint(0, 3)):
                y ^= 1 << r.randrange(64)
            prints.add(y)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    around = [0] + [1 << i for i in range(64)]
    met = {}
    for p in prints:
        for f in around:
            q = met.setdefault(p ^ f, p)
            parent[root(p)] = root(q)
    ids = {p: i for i, p in enumerate(sorted(prints))}
    least = {}
    for p in sorted(prints):
        least.setdefault(root(p), ids[p])
    signed = [(ids[p], p - (1 << 64) if p >> 63 else p) for p in prints]
    got = simhash.components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    assert {r.fp % (1 << 64): r.component_id for r in got} == {p: least[root(p)] for p in prints}


def test_null_ids_ties_and_repeated_rows(spark):
    text = "one two three four five"
    rows = [(None, text, "x"), (4, text, "x"), (4, text, "x"), (2, text, "x"), (None, "alone here now", "y"), (None, "alone here now", "y"), (7, None, "z"), (6, "", "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(table).collect()]
    assert len(got) == 8 and sorted(str(c) for _, c in got) == ["2", "2", "2", "2", "6", "6", "None", "None"]
    kept = sorted((str(r.doc_id), r.source) for r in simhash.one_of_each(table).collect())
    assert kept == [("2", "x"), ("6", "z"), ("None", "y")]
