import random

import xxhash
from pyspark.sql import functions as F

from quire.llm import simhash


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest doc_id reachable over fingerprints at 3 or fewer differing bits."""
    label = list(range(len(prints)))
    for _ in prints:
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    first = {}
    for (doc, _), at in zip(prints, label, strict=True):
        if doc is not None:
            first[at] = min(first.get(at, doc), doc)
    return [first.get(at) for at in label]


def texts():
    rng = random.Random(5)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 400))]
        for _ in range(rng.randrange(1, 6)):
            own = list(words)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            rows.append((len(rows) + 100 * (g % 3), " ".join(own)))
    return rows + [(901, None), (902, ""), (903, " \n"), (904, "one"), (905, "One two"), (905, "One two"), (None, "one two"), (None, "lonely text here with words"), (990, "É é")]


def test_matches_brute_force(documents):
    rows = texts()
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(rows)).collect())
    prints = [(d, brute_print(t)) for d, t in rows]
    want = sorted((str(d), f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints), strict=True))
    assert got == want


def test_a_forgetful_forest_loses_no_component():
    rng = random.Random(9)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(200)]

    def parts(edges):
        up = list(range(60))
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in edges:
            up[find(a)] = find(b)
        return [frozenset(y for y in range(60) if find(y) == find(x)) for x in range(60)]

    for most in (2, 5, 1000):
        forest = simhash._Forest(most)
        passed = [p for p in pairs if p[0] != p[1] and forest.join(*p)]
        assert parts(passed) == parts(pairs)
        assert most < 1000 or len(passed) < 60


def test_every_link_meets(spark):
    """All distances up to 3, with the differing bits anywhere."""
    rng = random.Random(2)
    rows, want = [], set()
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(1, 5)):
            b ^= 1 << bit
        rows += [a, b]
        if (a ^ b).bit_count() <= 3:
            want.add(frozenset((simhash._signed(a), simhash._signed(b))))
    df = spark.createDataFrame([(simhash._signed(x),) for x in set(rows)], "fp long").repartition(3)
    got = {frozenset((r.u, r.v)) for r in simhash.links(df, "fp").collect()}
    assert got == want


def test_groups_are_met_in_one_order(spark, monkeypatch):
    """Rows reach a task sorted by variant and fingerprint, so an attempt that runs again emits the same links."""
    rng = random.Random(8)
    prints = list({sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(200)})
    rng.shuffle(prints)
    seen, mapped = [], simhash.mapped
    monkeypatch.setattr(simhash, "mapped", lambda df, *rest: seen.append(df) or mapped(df, *rest))
    simhash.links(spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long"), "fp")
    parts = seen[0].rdd.mapPartitions(lambda rows: [[(r.key, r.fp) for r in rows]]).collect()
    assert sum(map(len, parts)) == 131 * len(prints) and any(a[0] == b[0] for p in parts for a, b in zip(p, p[1:]))
    assert all(p == sorted(p) for p in parts)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(-5, -9), (7, 7)]
    out = {r.node: r.label for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[k] == 100 for k in range(100, 160)) and out[-5] == out[-9] == -9


def test_one_of_each_group_stays(documents):
    rows = texts()
    df = documents(rows)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = brute_components([(d, brute_print(t)) for d, t in rows])
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in want if c is not None})
    alone = {brute_print(t) for (d, t), c in zip(rows, want, strict=True) if c is None}
    assert ids.count(None) == len(alone)


def test_empty(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.drop_near_duplicates(documents([])).collect() == []
    one = simhash.near_duplicates(documents([(3, None)])).collect()
    assert [tuple(r) for r in one] == [(3, "0" * 16, 3)]
    assert documents([(3, None)]).select(F.count("*")).first()[0] == 1
