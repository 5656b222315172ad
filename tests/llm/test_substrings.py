import hashlib
import random

import numpy as np

from quire.llm import recompress, substrings


def brute(docs, window):
    first = {}
    for doc, text in docs:
        ws = (text or "").encode().split()
        if doc is not None:
            for i in range(len(ws) - window + 1):
                k = tuple(ws[i : i + window])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in docs:
        ws, gone = (text or "").encode().split(), set()
        if doc is not None:
            for i in range(len(ws) - window + 1):
                if first[tuple(ws[i : i + window])] < doc:
                    gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((str(doc), len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def corpus(rng, n, passages, vocab):
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(4)):
            words += [f"w{rng.randrange(vocab)}" for _ in range(rng.randrange(40))]
            if rng.random() < 0.7:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                words += p[a : a + rng.randrange(1, len(p))]
        docs.append((rng.randrange(1000) if rng.random() < 0.1 else i, " ".join(words)))
    return docs


def run(documents, docs, window, **options):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in substrings.remove_repeats(documents(docs), window=window, **options).collect())


def test_matches_brute_force(documents):
    rng = random.Random(4)
    for window, vocab in ((50, 1000), (12, 3), (5, 2)):
        passages = [[f"p{rng.randrange(60)}" for _ in range(150)] for _ in range(4)] + [["same"] * 120, ["x", "y"] * 60, ["a", "b", "c"] * 40]
        docs = corpus(rng, 60, passages, vocab)
        docs += [docs[3], (2000, docs[5][1]), (2001, docs[5][1]), (None, docs[5][1]), (2002, None), (2003, ""), (2004, " \n\t "), (2005, "é x " * 60), (2006, "é x " * 60), (2006, "other " * 55)]
        assert run(documents, docs, window) == brute(docs, window), window


def test_names_that_collide(documents):
    rng = random.Random(6)
    passages = [[f"p{rng.randrange(90)}" for _ in range(80)] for _ in range(3)]
    docs = corpus(rng, 50, passages, 400)
    for bits in (1, 3, 64):
        assert run(documents, docs, 20, name_bits=bits) == brute(docs, 20), bits


def test_long_words_of_like_structure(documents):
    """Thue-Morse words, which polynomial hashes modulo a power of two cannot tell apart."""
    rest = [f"w{k}" for k in range(49)]
    for size in (1024, 4096):
        bits = [bin(k).count("1") & 1 for k in range(size)]
        words = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
        docs = [(k, " ".join([*rest[:20], w, *rest[20:]])) for k, w in enumerate(words)]
        assert [r[2] for r in run(documents, docs, 50)] == [0, 0]


def test_rows_of_one_id_keep_their_own_ranges(documents):
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(70)]
    docs = [(1, " ".join(passage))]
    for k in range(120):  # one doc_id, long and short texts, ranges at different places
        words = [f"w{rng.randrange(9999)}" for _ in range(rng.randrange(400) if k % 2 else 3)]
        docs.append((7, " ".join([*words, *passage[: rng.randrange(40, 70)]])))
    docs += [(7, None), (7, ""), docs[5]]
    assert run(documents, docs, 50) == brute(docs, 50)


def test_word_names():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcdefgh\xc3\xa9") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    words += [b"a" * k for k in range(1, 40)] + [b"\0" * k for k in range(1, 20)]
    raw = b" \n".join(words)
    names, places = recompress.word_names(raw)
    assert [raw[p : p + len(w)] for p, w in zip(places.tolist(), words, strict=True)] == words
    assert len(set(names.tolist())) == len(set(words)) == len(set(zip(words, names.tolist(), strict=True)))
    assert recompress.word_names(b"")[0].size == 0 and recompress.word_names(b"x" * (1 << 20))[0].size == 1


def test_empty_and_short(documents):
    assert run(documents, [], 50) == []
    assert run(documents, [(1, "a b"), (2, "a b")], 50) == brute([(1, "a b"), (2, "a b")], 50)


def test_anchor_depends_on_the_window_alone():
    rng = np.random.default_rng(1)
    for alphabet in (2, 5, 1000):
        names = recompress.mix(np.arange(1, alphabet + 1, dtype=np.uint64))
        stretch = names[rng.integers(0, alphabet, 30)]
        seen = set()
        for _ in range(20):
            a, b = (names[rng.integers(0, alphabet, rng.integers(0, 40))] for _ in range(2))
            words = np.r_[a, stretch, b]
            name, place = recompress.anchors(words, np.array([len(words)]), np.array([len(a)]), 30)
            seen.add((int(name[0]), int(place[0]) - len(a)))
        assert len(seen) == 1


def test_stretch_names_are_of_their_words_alone():
    rng = np.random.default_rng(4)
    words = recompress.mix(rng.integers(0, 3, 400).astype(np.uint64))
    for length in (1, 2, 3, 7, 25, 32, 127):
        got = recompress.stretch_names(words, length)
        assert len(got) == 400 - length + 1
        seen = {}
        for k, name in enumerate(got.tolist()):
            assert seen.setdefault(words[k : k + length].tobytes(), name) == name
        assert len(set(seen.values())) == len(seen)
        assert recompress.stretch_names(words[: length - 1], length).size == 0


def test_records_cover_all_windows():
    rng = np.random.default_rng(2)
    words = recompress.mix(rng.integers(0, 500, 5000).astype(np.uint64))
    ends = np.array([10, 70, 70, 1000, 5000])
    got = recompress.records(words, ends, 50)
    starts = np.concatenate([np.arange(f, f + c) for f, c in zip(got.first, got.count, strict=True)])
    assert sorted(starts.tolist()) == recompress.window_starts(ends, 50).tolist()
    assert got.count.max() <= 50 and len(got.first) < len(starts) / 4
