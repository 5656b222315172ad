import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import files, rans, token_counts, token_files
from quire.llm.common import fresh_dir
from quire.llm.pretokens import OTHER, PATTERN, load, pieces
from quire.llm.queries import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n=300):
    rng = random.Random(6)
    parts = ["a", "b", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "1", "é", "_", "-", "!", "word", "Ж", "日本", " ", " ", "²", "ª", "<|endoftext|>", "\x1c", "😀", "ß"]
    out = [None, "", " ", "\n", "<|endoftext|>", "don't  stop\n\n", "x" * 5000, " y" * 70_000]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_pattern_cuts_as_the_library_does(library):
    cut = library.pre_tokenizer.pre_tokenize_str
    for t in texts(2000):
        if t and not OTHER.search(t):
            want = [t[a:b] for _, (a, b) in cut(t)]
            assert PATTERN.findall(t) == want
            assert [x for p in pieces(t, 4) for x in PATTERN.findall(p)] == want
    for code in range(0x3000):
        c = chr(code)
        if not OTHER.search(c):
            t = f"a{c}1{c} {c}{c} .{c}b  {c}"
            assert PATTERN.findall(t) == [t[a:b] for _, (a, b) in cut(t)], hex(code)


def test_counts_match_the_library(documents, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(5, "again"), (5, "again"), (None, "no id")]
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows)
    for options in ({}, {"table": {}}, {"cache_size": 3}, {"table": {"a": 1, " b": 1}}):
        got = token_counts.token_counts(documents(rows), PATH, **options).collect()
        assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == want
    assert token_counts.token_counts(documents([]), PATH).collect() == []


def want_digests(rows, library):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(documents, library):
    rows = [(3 * i - 100, t) for i, t in enumerate(texts())] + [(None, "no id")]
    got = token_files.token_output(documents(rows), PATH, segment=500, block=128)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want_digests(rows, library)
    assert token_files.token_output(documents([]), PATH).collect() == []
    twice = token_files.token_output(documents([(1, "a b"), (1, "a b"), (0, None)]), PATH).collect()
    assert sorted(map(tuple, twice)) == sorted(want_digests([(1, "a b"), (1, "a b"), (0, None)], library))


def test_damage_is_found(documents, spark, tmp_path):
    manifest, model_uri = token_files.write_tokens(documents([(i, f"some words {i}") for i in range(50)]), PATH)
    model = rans.Model.from_bytes(files.get(model_uri))
    row = manifest.first()
    raw = bytearray(files.get(row.uri))
    at, size, docs, symbols, crc = token_files.segments(row.uri)[0]
    raw[at + size // 2] ^= 1
    uri = files.put(fresh_dir(spark, "bad"), "x", "qtok", bytes(raw))
    with pytest.raises(ValueError, match="checksum"):
        token_files.read_segment(files.Reader(uri), at, size, crc, model)
    with pytest.raises(ValueError):
        token_files.segments(files.put(fresh_dir(spark, "bad"), "x", "qtok", b"x" * 100))


def test_rans_round_trip():
    rng = np.random.default_rng(0)
    for sigma, n in ((1, 10), (2, 3000), (300, 5000), (50_257, 20_000)):
        symbols = np.minimum(rng.zipf(1.3, n), sigma) - 1
        model = rans.Model.from_bytes(rans.Model.from_counts(np.bincount(symbols, minlength=sigma)).to_bytes())
        for size in (0, 1, 1023, 1024, 1025, n):
            raw = rans.encode_block(symbols[:size], model)
            assert (rans.decode_block(raw, model) == symbols[:size]).all() and rans.block_size(raw, 0) == len(raw)
    few = rans.Model.from_counts(np.array([0, 10**15, 1]))
    assert few.freq.tolist() == [0, (1 << 18) - 1, 1]
    raw = bytearray(rans.encode_block(np.ones(99, int), few))
    raw[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.decode_block(bytes(raw), few)


def test_special_strings_of_the_file():
    assert load(PATH).get_added_tokens_decoder()[50256].content == "<|endoftext|>"
