import pytest

from quire.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight, stop at the cap, share the excess again until none is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = float(total)
    while open_ and left > 1e-9:
        rate = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if weight[n] * rate >= cap * sizes[n]}
        if not full:
            for n in open_:
                target[n] = weight[n] * rate
            break
        for n in full:
            target[n] = float(cap * sizes[n])
            left -= target[n]
        open_ -= full
    return target


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_mix_follows_targets_and_reruns_agree(documents):
    rows = [(i, "w " * (1 + i % 9), "en", ["b", "a", "é", None, "Z"][i % 5] if i % 3 else "a") for i in range(400)]
    df = documents(rows)
    got = mixing.mix_report(df).collect()
    sizes, source = {}, {}
    for i, text, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(text.split())
        source[i] = s
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 9
    assert rows_of(mixing.mix_report(df.repartition(5))) == rows_of(mixing.mix_report(df))


def test_caps_are_shared_again(documents):
    rows = [(1, "a b", "en", "a"), (2, "a " * 100, "en", "b"), (3, "a " * 100, "en", "c"), (4, None, "en", "d"), (5, "", "en", "d")]
    got = {r.doc_id: r for r in mixing.mix_report(documents(rows)).collect()}
    assert got[1].target == 6 and got[1].taken == 6
    assert got[4].target == 0 and got[4].taken == 0 and got[5].size == 0
    assert got[2].target == pytest.approx((202 - 6) * 2 / 3)


def brute_taken(docs, hashes, target, cap=3):
    """Copies of each document of one source: whole rounds, then by rising hash while it brings the sum nearer."""
    total = sum(size for _, size in docs)
    full = int(target // total) if total else 0
    left, taken = target - full * total, {i: full for i, _ in docs}
    groups = {}
    for i, size in docs:
        groups.setdefault(hashes[i], []).append((i, size))
    for h in sorted(groups):
        here = sum(size for _, size in groups[h])
        if not here:
            continue
        if full >= cap or left * 2 < here:
            break
        left -= here
        for i, size in groups[h]:
            taken[i] += size > 0
    return taken


def test_taken_matches_brute_force(documents):
    rows = [(i, "w " * ((i * 7) % 13), "en", "abcde"[(i * i) % 5] if i % 2 else "a") for i in range(500)] + [(900, None, "en", "b"), (901, "x " * 400, "en", "c")]
    df = documents(rows)
    hashes = {r.doc_id: r.h for r in mixing.mix_plan(df)[0].collect()}
    sizes, by = {}, {}
    for i, text, _, s in rows:
        n = len((text or "").split())
        sizes[s] = sizes.get(s, 0) + n
        by.setdefault(s, []).append((i, n))
    target = brute_targets(sizes)
    got = {r.doc_id: r.taken for r in mixing.mix_report(df).collect()}
    for s, docs in by.items():
        copies = brute_taken(docs, hashes, target[s])
        assert {i: got[i] for i, _ in docs} == {i: copies[i] * n for i, n in docs}, s


def test_no_document_is_there_more_than_the_cap(documents):
    rows = [(i, "a b", "en", "a") for i in range(20)] + [(i, "", "en", "a") for i in range(100, 300)]
    rows += [(i, "a " * 100, "en", s) for i, s in zip(range(400, 500), "bc" * 50, strict=True)]
    out = mixing.mix(documents(rows)).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in out) == 3 and {r["count"] for r in out if r.doc_id < 300} == {3}


def test_edges(documents, spark):
    assert mixing.mix_report(documents([])).collect() == []
    assert mixing.mix(documents([])).collect() == []
    same = [(7, "a b c", "en", "a")] * 4 + [(None, "a", "en", None), (None, None, None, None)]
    got = mixing.mix_report(documents(same)).collect()
    assert len(got) == 6 and len({r.taken for r in got if r.doc_id == 7}) == 1


def test_mix_repeats_rows_with_their_columns(documents):
    df = documents([(i, "w " * 10, "en", "a" if i < 5 else "b") for i in range(100)])
    out = mixing.mix(df)
    assert out.columns == df.columns
    report = {r.doc_id: r.taken // r.size for r in mixing.mix_report(df).collect()}
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in report.items() if v}
