import hashlib
import random
import re

import numpy as np

from quire.llm import decontaminate
from quire.llm.fm_index import FMIndex, suffix_order

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - 7) if ws else 0):
            windows.setdefault(tuple(ws[i : i + 8]), set()).add(None if item is None else str(item))
    out = []
    for doc, text in docs:
        ws, hit, found, full = words(text), set(), set(), False
        for w, of in windows.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= of
                    full |= len(w) == 8
        names = ",".join(sorted(x for x in found if x is not None))
        row = (str(doc), len(ws), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(found) >= 2)
        out.append((row, full or len(found) >= 2, hit))
    return out


def brute_rows(docs, items):
    return sorted(row for row, _, _ in brute(docs, items))


def brute_kept(docs, items):
    """doc_ids as text of the documents that stay."""
    return sorted(row[0] for row, bad, _ in brute(docs, items) if not bad)


def case():
    rng = random.Random(8)
    vocab = ["the", "a", "Of", "in", "été", "x1", "日本"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.randrange(1, 30))) for k in range(12)] + [(50, None), (51, "..."), (None, "the a"), (9, "the, A of IN"), (60, "rare words only here")]
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    long = [t for _, t in items if t and len(words(t)) >= 8]
    docs += [(200 + i, f"foreign things {t} more, foreign") for i, t in enumerate(long)]
    docs += [(i + 100, "foreign " + (items[i][1] or "") + " stuff, " + (items[i + 1][1] or "")) for i in range(10)]
    return docs + [(300, None), (301, ""), (301, "the THE the"), (None, "Rare--words only HERE")], items


def test_matches_brute_force(documents, spark):
    docs, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as n_words")
    for options in ({}, {"shard_words": 50}, {"block_bytes": 100}):
        got = sorted((str(r[0]), *tuple(r)[1:]) for r in decontaminate.contamination(documents(docs), bench, **options).collect())
        assert got == brute_rows(docs, items), options


def test_drop_takes_one_full_window_or_two_items(documents, spark):
    docs, items = case()
    df, bench = documents(docs), spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_bytes": 100}):
        kept = decontaminate.drop_contaminated(df, bench, **options)
        assert kept.columns == df.columns
        ids = sorted(str(r.doc_id) for r in kept.collect())
        assert ids == brute_kept(docs, items)
    gone = {str(d) for d, _ in docs} - set(ids)
    single = {row[0] for row, _, _ in brute(docs, items) if row[3] == 1}
    assert single & gone and single - gone  # one long item is enough, one short item is not


def test_cut_removes_merged_spans(documents, spark):
    items = [(1, "a b c d e f g h i"), (2, "short one"), (3, "other thing")]
    docs = [
        (1, "Keep this. A, b C d e f g\nh I! and that"), (2, "x short one y"), (3, "short one, other thing; end"),
        (4, None), (5, ""), (6, "été a b c d e f g h 日本"), (7, "a b c d e f g h i"),
    ]
    df, bench = documents(docs), spark.createDataFrame(items, "item_id long, text string")
    cut = decontaminate.cut_contaminated(df, bench)
    assert cut.schema == df.schema
    want = {1: "Keep this. ! and that", 2: docs[1][1], 3: "; end", 4: None, 5: "", 6: "été  日本", 7: ""}
    assert {r.doc_id: r.text for r in cut.collect()} == want


def test_empty_sides(documents, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.contamination(documents([(1, "a b")]), none).collect()] == [(2, 0, 0)]
    assert decontaminate.contamination(documents([]), none).collect() == []


def test_index_counts_and_locates():
    rng = np.random.default_rng(3)
    for n, sigma in ((1, 2), (50, 3), (400, 4), (1000, 30)):
        symbols = np.r_[rng.integers(0, sigma, n), 0]
        order = suffix_order(symbols)
        assert sorted(order.tolist()) == list(range(n + 1))
        index = FMIndex(symbols, sigma, sample=7)
        for size in (1, 2, 5):
            phrases = rng.integers(1, sigma, (40, size)) if sigma > 1 else np.zeros((0, size), np.int64)
            which, where = index.find(phrases, np.full(len(phrases), size))
            got = sorted(zip(which.tolist(), where.tolist(), strict=True))
            want = sorted((p, i) for p in range(len(phrases)) for i in range(n + 2 - size) if (symbols[i : i + size] == phrases[p]).all())
            assert got == want


def test_repeats_settle_in_deep_suffixes():
    symbols = np.r_[np.tile([1, 2], 300), 0, np.tile([1, 2], 300), 0]
    index = FMIndex(symbols, 3)
    which, where = index.find(np.array([[1, 2, 1, 2]]), np.array([4]))
    assert sorted(where.tolist()) == [*range(0, 598, 2), *range(601, 1199, 2)] and set(which) == {0}
