import random
import re

from scatterlake.llm.jaccard import JaccardConfig, boundary, heavy_rows, jaccard_groups, light_sizes

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[i : i + 3]) for i in range(len(w) - 2)])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if 10 * len(a) < 9 * len(b):
                break
            if a and 100 * len(a & b) >= 90 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def compare(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(df).collect()}
    assert got == brute(rows)


def test_synthetic_families(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b c"), (7, "A  b\nc")]
    for _ in range(60):
        n = rng.choice([5, 8, 9, 10, 11, 12, 13, 19, 20, 21, 22, 28, 30, 40, 60, 100, 300])
        base = [rng.choice(vocabulary) for _ in range(n + 2)]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                where = rng.choice([0, len(copy) - 1, rng.randrange(len(copy))])
                if rng.random() < 0.5:
                    copy[where] = rng.choice(vocabulary)
                else:
                    del copy[where]
            rows.append((len(rows), " ".join(copy)))
    compare(spark, rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    compare(spark, [tuple(r) for r in docs.collect()])


def test_pigeonhole_and_boundary():
    c = JaccardConfig()
    for n in range(1, 400):
        for m in c.partners(n):
            if m >= n:
                k, blocks = heavy_rows(m, c)[0]
                assert dict(heavy_rows(n, c))[k] == blocks > c.difference(n + m)
                assert n + m - 2 * c.overlap(n, m) <= c.difference(n + m)
                if m != n or c.overlap(n, m) < n:
                    assert c.overlap(n, m) in light_sizes(n, c) and c.overlap(n, m) in light_sizes(m, c)
    assert 9 <= boundary({n: 10 for n in range(1, 72)}, c) < 30


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(5, "a b c d", 1, 2), (5, "a b c d", 1, 2), (None, "a b c d", 3, 4), (None, "q", 3, 4)],
                               "doc_id long, text string, n int, node int")
    got = sorted(((r["doc_id"], r["component_id"], r["n_shingles"]) for r in jaccard_groups(df).collect()), key=str)
    assert got == sorted([(5, 5, 2), (5, 5, 2), (None, 5, 2), (None, None, 1)], key=str)
    assert jaccard_groups(df.limit(0)).count() == 0


def test_large_families_are_compared_block_by_block(spark, monkeypatch):
    from scatterlake.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(120)] = f"x{rng.randint(0, 50)}"
        rows.append((i, " ".join(copy)))
    compare(spark, rows)
