import base64
import random
import re

import zstandard

from quire.llm import compression
from quire.llm.compression import Bands, base_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {w for w in windows if windows.count(w) > 1}
    hit = {i + k for i, w in enumerate(windows) if w in again for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def texts():
    rng = random.Random(1)
    out = [None, "", " ", "a", "a b", "a a a", "a a a a", "x\n\nx\n x\nx", "é # $\x0b|", "\ud800 lone"]
    for _ in range(60):
        out.append("".join(rng.choice(["a", "bé", " ", "\n", "#", "\t", "日"]) for _ in range(rng.randrange(120))))
    return out


def test_base_counts_match_brute_force():
    for t in texts():
        assert base_counts(t) == brute(t), repr(t)


def test_verdicts(documents):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocab[: rng.randrange(50, 3000)]) for _ in range(n))
    noise = base64.b85encode(rng.randbytes(60_000)).decode()
    rows = [(1, prose(60)), (2, prose(3000)), (3, prose(30_000)), (4, "spam ham " * 4000), (5, " ".join(noise[i : i + 9] for i in range(0, len(noise), 9)))]
    rows += [(6, prose(4000) + " " + " ".join(f"{chr(97 + i % 26)} " * 9000 for i in range(2))), (7, None), (8, ""), (9, prose(20))]
    got = {r.doc_id: r for r in compression.compression_bands(documents(rows)).collect()}
    assert [got[i].kept for i in range(1, 10)] == [True, True, True, False, False, False, False, False, False]
    assert got[5].base_failed is False and got[5].ratio > 0.78
    assert got[7].n_words == 0 and got[7].ratio is None and got[9].base_failed
    one = zstandard.ZstdCompressor(level=3, write_checksum=False)
    raw = rows[1][1].encode()
    assert got[2].ratio == len(one.compress(raw)) / len(raw)
    assert got[2].n_chunks == sum(2 * len(raw[i : i + 8192]) >= 8192 for i in range(0, len(raw), 8192))


def brute_verdict(text, bands):
    """The rule of the bands written out, without the operator's single pass."""
    n, _, _, _, again = brute(text)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if n < bands.min_words or 100 * again > bands.max_repeat_percent * n:
        return False, None if not raw else len(zstandard.ZstdCompressor(level=bands.level, write_checksum=False).compress(raw)) / len(raw)
    pack = lambda part: len(zstandard.ZstdCompressor(level=bands.level, write_checksum=False).compress(part)) / len(part)

    def inside(part):
        low, high = [(lo, hi) for most, lo, hi in bands.limits if len(part) <= most][0]
        return low <= pack(part) <= high + bands.script_room * sum(b > 127 for b in part) / len(part)

    size, ok = bands.chunk_bytes, inside(raw)
    if len(raw) > size:
        chunks = [raw[i : i + size] for i in range(0, len(raw), size)]
        if 2 * len(chunks[-1]) < size:
            tail = max(len(chunks.pop()), min(bands.min_tail, len(raw)))
            ok = ok and inside(raw[-tail:])
        bad = [not bands.chunk_limits[0] <= pack(c) <= bands.chunk_limits[1] for c in chunks]
        ok = ok and sum(bad) <= bands.max_bad_share * len(bad) and sum(bad) <= bands.max_bad_chunks
        ok = ok and not any(a and b for a, b in zip(bad, bad[1:], strict=False))
    return ok, pack(raw)


def test_verdicts_match_brute_force(documents):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("etaoinshrdlué日") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    piece = [
        lambda k: " ".join(rng.choice(vocab) for _ in range(k)),
        lambda k: " ".join(f"{rng.randrange(9)}" for _ in range(k)),
        lambda k: base64.encodebytes(rng.randbytes(4 * k)).decode(),
        lambda k: "same " * k,
    ]
    rows = [(i, " ".join(rng.choice(piece)(rng.randrange(1, 120)) for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " ")]
    small = Bands(chunk_bytes=256, chunk_limits=(0.2, 0.72), min_tail=64, max_repeat_percent=80, min_words=20)
    for bands in (small, Bands()):
        got = {r.doc_id: r for r in compression.compression_bands(documents(rows), bands).collect()}
        want = {i: brute_verdict(t, bands) for i, t in rows}
        assert {i: (r.kept, r.ratio) for i, r in got.items()} == want
    seen = [got[i].kept for i, _ in rows]
    assert any(seen) and not all(seen)


def test_chunks_reject_what_the_whole_hides(documents):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(2000)]
    good = " ".join(rng.choice(vocab) for _ in range(12_000))
    bad = good + " " + "".join(f"{i % 7} " for i in range(20_000))
    loose = Bands(limits=((float("inf"), 0.0, 2.0),), max_repeat_percent=100)
    got = {r.doc_id: r.kept for r in compression.compression_bands(documents([(1, good), (2, bad)]), loose).collect()}
    assert got == {1: True, 2: False}


CLEAN = (
    "The committee met on Tuesday to look at the accounts of the past year, which had been sent to all members in good time. Several of them asked why the costs of heating had risen so sharply, and the treasurer explained that the old boiler had failed in January. It was agreed to put a new one in before the autumn, if three offers could be had by the end of June.",
    "Der Ausschuss trat am Dienstag zusammen, um die Abrechnung des vergangenen Jahres zu prüfen, die allen Mitgliedern rechtzeitig zugegangen war. Mehrere fragten, weshalb die Heizkosten so stark gestiegen seien; die Kasse erklärte, dass der alte Kessel im Januar ausgefallen war. Man beschloss, noch vor dem Herbst einen neuen einzubauen, sofern bis Ende Juni drei Angebote vorlägen.",
    "Комитет собрался во вторник, чтобы рассмотреть отчёт за прошедший год, заранее разосланный всем участникам. Некоторые спросили, почему так выросли расходы на отопление, и казначей объяснил, что старый котёл вышел из строя в январе. Решили поставить новый до осени, если к концу июня удастся получить три предложения от разных мастерских города, а остаток средств отложить на ремонт крыши и окон.",
    "Ủy ban đã họp vào thứ ba để xem xét các khoản chi của năm vừa qua, vốn đã được gửi cho mọi thành viên đúng hạn. Nhiều người hỏi vì sao tiền sưởi lại tăng mạnh như vậy, và người thủ quỹ giải thích rằng lò hơi cũ đã hỏng hồi tháng giêng. Mọi người đồng ý lắp một lò mới trước mùa thu nếu có đủ ba bản chào giá vào cuối tháng sáu.",
    "위원회는 화요일에 모여 지난해의 회계를 살펴보았고 자료는 모든 위원에게 제때 전달되었다. 여러 위원이 난방비가 왜 그렇게 크게 올랐는지 물었으며 회계 담당자는 낡은 보일러가 일월에 고장 났다고 설명했다. 유월 말까지 견적을 세 군데에서 받을 수 있으면 가을이 오기 전에 새 보일러를 놓기로 뜻을 모았다. 남은 돈은 지붕과 창문을 고치는 데 쓰고 나머지는 내년 예산으로 넘기며 다음 모임은 칠월 첫째 주에 열기로 정했다.",
)


def noises(rng, size):
    """Encoded noise of ``size`` bytes with 50 words or more and hardly a repeated window."""
    cut = lambda t, w: " ".join(t[i : i + w] for i in range(0, len(t), w))[:size]
    printable = "".join(rng.choice([chr(i) for i in range(33, 127)]) for _ in range(size))
    width = 4 if size < 512 else 9
    out = [cut(base64.b64encode(rng.randbytes(size)).decode(), 4), cut(base64.b85encode(rng.randbytes(size)).decode(), width), cut(printable, width)]
    return out + ([base64.encodebytes(rng.randbytes(size)).decode()[:size], cut(printable, 70)] if size >= 4096 else [])


def test_encoded_noise_is_rejected_at_any_length(documents):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n // 5))[:n]
    sizes = [256, 384, 512, 768, 1024, 1536, 2048, 4096, 8192, 20_000, 70_000]
    alone = [t for n in sizes for t in noises(rng, n)]
    inside = [prose(16_384) + t + prose(8192) for t in noises(rng, 16_384)]
    clean = [*CLEAN, *(prose(n) for n in (400, 700, 1000, 1500, 2000, 4000, 8000, 30_000))]
    table = documents(list(enumerate(alone + inside + clean)))
    got = {r.doc_id: r for r in compression.compression_bands(table).collect()}
    noisy = len(alone) + len(inside)
    assert not any(got[i].base_failed for i in got)
    assert [i for i in range(noisy) if got[i].kept] == []
    assert all(got[i].n_bad_chunks >= 2 for i in range(len(alone), noisy))
    assert [i for i in range(noisy, len(got)) if not got[i].kept] == []


def test_tails_runs_and_counts_of_bad_chunks_reject(documents):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n // 4))[:n]
    same, k = "a" * 8192, 8192
    noise = lambda n: base64.encodebytes(rng.randbytes(n)).decode()[:n]
    tails = [prose(k) + same[:4000], prose(k) + noise(4000), prose(10 * k) + same[:2000], prose(k) + same[:1000]]
    runs = [prose(20 * k) + same * 2 + prose(20 * k), prose(20 * k) + noise(2 * k) + prose(20 * k)]
    mixed = lambda n, part: "".join(prose(12 * k) + part() for _ in range(n)) + prose(12 * k)
    counts = [mixed(3, lambda: same), mixed(3, lambda: noise(k))]
    good = [prose(k + 1), prose(k + 300), prose(k + 4000), prose(30 * k + 100), mixed(1, lambda: same), mixed(2, lambda: noise(k))]
    bad = tails + runs + counts
    got = {r.doc_id: r for r in compression.compression_bands(documents(list(enumerate(bad + good)))).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[i].kept for i in range(len(got))] == [False] * len(bad) + [True] * len(good)


def test_empty(documents):
    assert compression.compression_bands(documents([])).collect() == []
