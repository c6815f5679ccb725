import random
from difflib import SequenceMatcher

import pytest

from shelfwise.operators import segments, variants


def ratio(a, b):
    return max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())


def words(seed, size):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 14))) for _ in range(size // 4)]
    bases += ["category-" + b for b in bases[: size // 8]]
    out = set(bases)
    while len(out) < size:
        w = list(rng.choice(bases))
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(w) + 1)
            if rng.random() < 0.5 and w:
                w.pop(min(at, len(w) - 1))
            else:
                w.insert(at, rng.choice("abcdef"))
        if w:
            out.add("".join(w))
    return sorted(out)


def greedy(counts, threshold=0.85):
    order = sorted(counts, key=lambda v: (-counts[v], v))
    target = {}
    for v in order:
        if v in target:
            continue
        target[v] = v
        for other in order:
            a, b = v.lower(), other.lower()
            if other not in target and abs(len(a) - len(b)) <= 2 and ratio(a, b) >= threshold:
                target[other] = v
    return {v: c for v, c in target.items() if v != c}


@pytest.mark.parametrize("threshold", [0.82, 0.85])
def test_similar_keys_equals_all_pairs(spark, threshold):
    keys = words(3, 220)
    df = spark.createDataFrame([(0, k) for k in keys], "grp int, key string")
    got = {(r.a, r.b) for r in variants.similar_keys(df, threshold).collect()}
    expected = {
        (a, b)
        for i, a in enumerate(keys)
        for b in keys[i + 1 :]
        if abs(len(a) - len(b)) <= 2 and ratio(a, b) >= threshold
    }
    assert got == expected and expected


def numbered(spark, n, name):
    return spark.createDataFrame([(0, f"{name} {i:06d}") for i in range(n)], "grp int, key string")


def test_numbered_names_meet_few_others(spark):
    """Candidates per key, counted before any test, do not grow with the number of keys."""
    def candidates(n):
        return segments.candidates(numbered(spark, n, "item"), 0.85, 2).count() / n

    assert candidates(4000) < 1.5 * candidates(1000)


@pytest.mark.parametrize("measure, spare", [("blocks", 5), ("levenshtein", 5), ("blocks", 0)])
def test_similar_keys_of_any_length(spark, monkeypatch, measure, spare):
    """Words shared by all texts, frequent segments, lengths on both sides of each border."""
    monkeypatch.setattr(segments, "SPARE", spare)
    monkeypatch.setattr(segments, "LONG", 30)
    keys = sorted({w for n, w in enumerate(words(8, 120))} | {f"{p} {w}" for p in ("customer item", "large blue shirt of") for w in words(9, 70)})
    df = spark.createDataFrame([(0, k) for k in keys], "grp int, key string")
    got = {(r.a, r.b) for r in variants.similar_keys(df, 0.85, measure=measure).collect()}
    near = ratio if measure == "blocks" else (lambda a, b: 1 - distance(a, b) / max(len(a), len(b)))
    expected = {
        (a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if abs(len(a) - len(b)) <= 2 and near(a, b) >= 0.85
    }
    assert got == expected and len(expected) > 100


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            above, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, above + (x != y))
    return row[-1]


def test_variant_map_equals_greedy_walk(spark):
    keys = words(5, 160)
    rng = random.Random(1)
    counts = {k: rng.randint(1, 9) for k in keys}
    counts.update({"TV Set": 4, "Tv Set": 6})
    df = spark.createDataFrame(list(counts.items()), "value string, n long")
    mapping = variants.variant_map(df)
    assert {r.variant: r.canonical for r in mapping.collect()} == greedy(counts)


def test_harmonize_merges_typos_and_case(spark):
    values = ["Electronics", "Elecronics", "electronics", "Electronics", "Apparel", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, category string")
    once = variants.harmonize(df, "category")
    got = [r.category for r in once.orderBy("id").collect()]
    assert got == ["Electronics"] * 4 + ["Apparel", None]
    twice = variants.harmonize(once, "category")
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_harmonize_keeps_a_column_named_variant(spark):
    df = spark.createDataFrame([("Shoes", "a", 1), ("Shoees", "b", 2), ("Shoes", "c", 3)], "category string, variant string, canonical int")
    got = variants.harmonize(df, "category").orderBy("canonical").collect()
    assert [tuple(r) for r in got] == [("Shoes", "a", 1), ("Shoes", "b", 2), ("Shoes", "c", 3)]
