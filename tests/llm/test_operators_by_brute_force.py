"""Each operator of millrace.llm against a plain version on small tables that hold nulls, empty, long, tied and repeated texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from millrace.llm import bpe, common, importance, langid, packing, quality_rules, records, simhash, suffix, telephony, tokens
from millrace.llm.components import components
from millrace.llm.queries import BYTES, WORDS

SPACE = re.compile(rb"[^\x20\x09-\x0d]+")


def make_texts() -> list[str | None]:
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [prose(r.randint(1, 160)) for _ in range(40)]
    passage, other = prose(60), prose(45)
    near = base[3].split(" ")
    near[len(near) // 2] = "changed"
    texts = [
        None, "", " \n\t ", "one", "two words", "x" * 99, "x" * 100, "x" * 101, "x" * 350, "ab" * 300, "naïve café ÉÜß 漢字 " * 20, "漢字かな" * 60,
        *base, *base[:6], " ".join(near), base[1] + " " + passage + " " + base[2], passage + base[4], other + "\n" + passage + "\n" + other, passage, prose(1200), prose(30) + passage + prose(30) + passage,
        "<|endoftext|> marks <|startoftext|>", "a\x1cb\x85c d", "It's they'll DON'T", "same line of five words\n" * 30 + prose(80), "퟿ \U0001f600 end", "ΑΣ ΣΑΣ İx",
    ]
    return texts


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    """The texts, with doc_ids out of order, and columns whose names operators use themselves."""
    order = list(range(len(TEXTS)))
    random.Random(1).shuffle(order)
    rows = [(i, TEXTS[i], ["en", "de", None][i % 3], f"h{i % 2}", None if TEXTS[i] is None else len(TEXTS[i]), i, "k", 1.5) for i in order]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label long, key string, place double").repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def spans(texts: list[str | None]) -> list[list[bool]]:
    """Of each text which of its bytes a string of 100 bytes covers that starts earlier."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(w)
        out.append(gone)
    return out


def check_removals(got: dict, texts: list[str | None]) -> None:
    for i, (t, gone) in enumerate(zip(texts, spans(texts), strict=True)):
        raw = (t or "").encode()
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        kept = hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(gone), runs, kept), i


def test_suffix_removals(docs, empty):
    check_removals(by_id(suffix.removals(docs)), TEXTS)
    assert suffix.removals(empty).count() == 0
    assert suffix.removals(empty).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_suffix_with_hot_anchors_and_parts(docs, spark, monkeypatch):
    """Every anchor hot; and texts read in small parts: the same result."""
    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(400)) for _ in range(4)]
    texts += [texts[0][100:300] + texts[1][50:250], texts[2]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_removals(by_id(suffix.removals(df)), texts)
    none = np.empty(0, np.uint64)
    hot = np.unique(suffix.pieces(texts, none)[0])
    monkeypatch.setattr(suffix, "_hot_anchors", lambda d: hot)
    check_removals(by_id(suffix.removals(df)), texts)
    monkeypatch.undo()
    whole = suffix.pieces(texts, none)
    monkeypatch.setattr(suffix, "PART", 130)
    parts = suffix.pieces(texts, none)
    assert whole[5].sum() == parts[5].sum() == sum(len(t) - 99 for t in texts)


def test_suffix_repeated_rows_null_ids_and_columns(spark):
    r = random.Random(5)
    text = "".join(r.choice("abcdef") for _ in range(500))
    df = spark.createDataFrame([(1, text, 500, "x"), (1, text, 500, "x"), (2, text[:250] + "é" + text[250:], 501, "y"), (None, text[100:300], 200, "z")], "doc_id long, text string, n_chars int, __row string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix.removals(df).collect()}
    # The row without id is first; rows that repeat id and text are one document.
    assert got[None, 200] == 0 and got[1, 500] == 200 and got[2, 502] == 500
    kept = suffix.removed_texts(df)
    assert kept.columns == df.columns and kept.count() == 4
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}[2] == ("é", 1)


def plain_variants(rows: list[tuple]) -> dict[tuple, int]:
    """Removed bytes of each document (doc_id, text): windows that start in a smaller doc_id, or earlier in the same text."""
    documents = sorted({r for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    windows = lambda t: [t[s : s + 100] for s in range(len(t) - 99)]
    least: dict[str, int | None] = {}
    for i, t in documents:
        for w in windows(t):
            least.setdefault(w, i)
    out = {}
    for i, t in documents:
        gone, own = [False] * len(t), set()
        for s, w in enumerate(windows(t)):
            if least[w] != i or w in own:
                gone[s : s + 100] = [True] * 100
            own.add(w)
        out[i, t] = sum(gone)
    return out


@pytest.mark.parametrize("large", [1, 50_000])
def test_suffix_rows_of_one_id_with_different_texts(spark, monkeypatch, large):
    r = random.Random(15)
    new = lambda n: "".join(r.choice("abcdef") for _ in range(n))
    t, u, p = new(300), new(300), new(150)
    rows = [(4, t), (5, t), (5, u), (5, u), (7, u[50:250] + new(60)), (8, p + new(90)), (8, new(40) + p), (8, p + p), (9, new(30) + p), (None, new(10) + p[:120]), (None, new(50) + p[:120])]
    monkeypatch.setattr(suffix, "LARGE", large)
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "doc_id long, text string, variant string, place int").repartition(4)
    got = {(x.doc_id, x.kept_sha256, x.n_bytes): x.n_removed for x in suffix.removals(df).collect()}
    want = plain_variants(rows)
    assert want[5, u] == 0 and want[5, t] == 300 and want[7, rows[4][1]] >= 200
    assert sorted((str(i), len(x), n) for (i, x), n in want.items()) == sorted((str(i), size, n) for (i, _, size), n in got.items())
    kept = {(x.doc_id, x.text) for x in suffix.removed_texts(df).collect()}
    assert (5, "") in kept and (5, u) in kept and (4, t) in kept


@pytest.mark.parametrize("seed", range(3))
def test_collection_bwt_is_the_sorted_suffixes(seed, monkeypatch, tmp_path):
    r = random.Random(seed)
    if seed == 2:
        monkeypatch.setattr(suffix, "FILE_MEMORY", 0)
    for _ in range(25):
        strings = [bytes(r.choice(b"ab\xff") for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 7))]
        order = sorted(((tuple(s[p:]), i, len(s) - p) for i, s in enumerate(strings) for p in range(len(s))), key=lambda t: (t[0], t[1]))
        common = [0][: len(order)] + [next((k for k, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0]))) for a, b in zip(order, order[1:])]  # noqa: B905
        owner, length, prefix = suffix.collection_bwt(strings, f"file://{tmp_path}")
        assert (owner.tolist(), length.tolist(), prefix.tolist()) == ([o[1] for o in order], [o[2] for o in order], common)
    assert not list(tmp_path.iterdir())  # each round's files go when the next are written


def plain_fingerprint(t: str | None) -> int:
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
    words = SPACE.findall(low)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(values: list[int], distance: int = 3) -> list[int]:
    parent = list(range(len(values)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def test_simhash(docs, empty):
    prints = [plain_fingerprint(t) for t in TEXTS]
    roots = plain_components(prints)
    got = by_id(simhash.near_duplicates(docs).withColumn("hex", simhash.hex_fingerprint()))
    assert {i: (r.hex, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", roots[i]) for i, p in enumerate(prints)}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))


@pytest.mark.parametrize("hot_group", [1, 20_000])
def test_links_connect_what_brute_force_connects(spark, hot_group):
    r = random.Random(11)
    centers = [r.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    values = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centers for _ in range(40)})
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(5)
    labels = {r["u"]: r["label"] for r in components(simhash.links(fps, hot_group)).collect()}
    roots = plain_components(values)
    groups, wanted = {}, {}
    for v, root in zip(signed, roots, strict=True):
        groups.setdefault(labels.get(v, v), set()).add(v)
        wanted.setdefault(root, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_gray_rank_orders_the_reflected_sequence():
    codes = np.array([i ^ (i >> 1) for i in range(1000)], dtype=np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(1000))


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components_of_chains_stars_and_loops(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_ROWS", few)
    monkeypatch.setattr(common, "HOT_LEAST", 5)
    edges = [(i, i + 1) for i in range(12)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["u"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 13)} | {i: 100 for i in range(101, 140)} | {301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_rules(t: str | None) -> tuple:
    text = t or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_counts(docs, empty):
    short = [t for t in TEXTS if len(t or "") < 3000]
    got = by_id(quality_rules.verdicts(docs))
    for i, t in enumerate(TEXTS):
        if t in short:
            r = got[i]
            n, chars, symbols, dups, repeats = plain_rules(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats), i
            assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
            assert not (r.base_failed and r.kept)
    assert quality_rules.verdicts(empty).count() == 0


def test_frequent_lines_go_from_all_but_the_first_document_of_a_host(spark):
    def filler(i: int) -> str:  # letters only: digits are alike when lines are compared
        r = random.Random(i)
        return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))

    line = "This Line  is\tevery-where 17"
    rows = [(i, f"{line}\n{filler(i)}\nshort", "a") for i in range(30)] + [(100, f"{line}\n{filler(100)}", "b"), (101, f"THIS line is every-where 9\n{filler(101)}", "a"), (102, "\n".join([line] * 40), "a"), (103, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(quality_rules.verdicts(df, line_docs=20))
    assert got[0].n_removed_lines == 0 and got[1].n_removed_lines == 1 and got[1].n_removed_words == 5
    assert got[100].n_removed_lines == 0 and got[101].n_removed_lines == 1 and got[101].kept
    assert got[102].n_removed_lines == 40 and not got[102].kept
    kept = by_id(quality_rules.apply_rules(df, line_docs=20))
    assert set(kept) == {i for i, r in got.items() if r.kept}
    assert kept[5].text == f"{filler(5)}\nshort" and kept[0].text.startswith(line)


def test_bpe_is_the_library_s(docs, empty):
    t = Tokenizer.from_file(WORDS)
    got, digests = by_id(bpe.encode_column(docs, WORDS)), by_id(bpe.encode_digests(docs, WORDS))
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert (got[i].ids, got[i].decoded) == (ids, text), i
        assert tuple(digests[i])[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode_digests(empty, WORDS).count() == 0


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_by_pieces_is_the_library_s(path):
    t, e, r = Tokenizer.from_file(path), tokens.TextEncoder(path), random.Random(9)
    alphabet = [*"ab zZ\n\t 'éΣς1²\x1c 漢한!?.,-_\r", "the ", "Word, ", ". ", "'s ", "<|endoftext|>", "İ. "]
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(400)]
    wanted = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for end in (None, 2):
        for k in range(0, len(texts), 50):
            ids, starts = e.column(pa.array(texts[k : k + 50], pa.string()), end)
            got = [ids[a:z].tolist() for a, z in zip(starts, starts[1:], strict=False)]
            assert got == [w if end is None else [*w, end] for w in wanted[k : k + 50]]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_over_chunks_and_generations(path, monkeypatch):
    """Texts that go on over many chunks, and a cache that is turned over all the time."""
    monkeypatch.setattr(tokens, "CACHE_BYTES", 2000)
    t, e = Tokenizer.from_file(path), tokens.TextEncoder(path)
    cut = tokens.chunks
    monkeypatch.setattr(tokens, "chunks", lambda column, whole, lower: cut(column, whole, lower, 70))
    for _ in range(2):
        ids, starts = e.column(pa.array(TEXTS, pa.string()))
        assert [ids[a:z].tolist() for a, z in zip(starts, starts[1:], strict=False)] == [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    monkeypatch.setattr(bpe, "chunks", lambda column, whole, lower: cut(column, whole, lower, 70))
    if path == WORDS:
        for got, x in zip(bpe.WordBpe(path).digests(pa.array(TEXTS, pa.string())), TEXTS, strict=True):
            ids = t.encode(x or "", add_special_tokens=False).ids
            assert got == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_records(docs, empty, spark):
    from millrace.llm.common import new_folder

    t, start = Tokenizer.from_file(WORDS), 0
    manifest = records.write_records(docs, WORDS, 2, new_folder(spark, "records"))
    got, wanted = by_id(records.read_digests(manifest)), {}
    for i, x in enumerate(TEXTS):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        wanted[i] = ids
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shuffled = records.shuffled_records(manifest, 3, 4).collect()
    assert {r.doc_id: list(r.ids) for r in shuffled} == wanted
    assert [r.doc_id for r in shuffled] != sorted(wanted)
    assert records.records(empty, WORDS, 2).count() == 0
    odd = spark.createDataFrame([(None, "a"), (7, None), (7, "b"), (7, "b")], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in sorted(records.records(odd, WORDS, 2).collect(), key=lambda r: r.start)] == [(None, 0), (7, 2), (7, 3), (7, 5)]


def test_damaged_records_are_noticed():
    import io

    good = records.frame(*records.payloads([5], np.arange(9, dtype=np.uint32), np.array([0, 9])))
    assert records.unpack_ids(records.read_frame(io.BytesIO(good)))[1].tolist() == list(range(9))
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError, match="checksum|cut off"):
            records.read_frame(io.BytesIO(bytes(bad)))


def plain_ima(block: bytes) -> list[int]:
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step, move = telephony.STEPS[index], telephony.STEPS[index] >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                move += part if code & bit else 0
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + telephony.MOVES[code & 7]))
            out.append(value)
    return out


def test_telephony_decoders():
    r = random.Random(4)
    blocks = [bytes(r.randrange(256) for _ in range(64)) for _ in range(50)]
    got = telephony.decode_ima(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 64))
    assert [x.tolist() for x in got] == [plain_ima(b) for b in blocks]
    # Values of the standards' tables, and their symmetry.
    u, a = telephony.mulaw_table().astype(int), telephony.alaw_table().astype(int)
    assert (u[0x00], u[0x80], u[0xFF], u[0x7F], u[0xF0]) == (-32124, 32124, 0, 0, 120)
    assert (a[0x2A], a[0xAA], a[0x55], a[0xD5]) == (-32256, 32256, -8, 8)
    assert (u[:128] == -u[128:]).all() and (a[:128] == -a[128:]).all()
    tone = np.round(8000 * np.sin(np.arange(400) * 0.3)).astype(np.int16)
    wide = telephony.resample_double(tone)
    assert (wide[::2] == tone).all() and np.abs(wide[41:700:2] - 8000 * np.sin((np.arange(20, 350) + 0.5) * 0.3)).max() < 60


def plain_double(samples: list[int]) -> list[int]:
    """Twice the rate by plain sums: eight Hann-windowed sinc taps around each new sample, edges repeated."""
    taps = [math.sin(math.pi * (k - 3.5)) / (math.pi * (k - 3.5)) * math.cos(math.pi * (k - 3.5) / 9) ** 2 for k in range(8)]
    taps = [t / sum(taps) for t in taps]
    at = lambda i: samples[min(max(i, 0), len(samples) - 1)]
    out = []
    for i, s in enumerate(samples):
        between = sum(t * at(i - 3 + k) for k, t in enumerate(taps))
        out += [s, max(-32768, min(32767, round(between)))]
    return out


def plain_mulaw(byte: int) -> int:
    byte = ~byte & 255
    size = ((2 * (byte & 15) + 33) << (byte >> 4 & 7)) - 33
    return -4 * size if byte & 128 else 4 * size


def plain_alaw(byte: int) -> int:
    byte ^= 0x55
    e, m = byte >> 4 & 7, byte & 15
    size = (2 * m + 1) * 8 if e == 0 else ((2 * m + 33) << e) * 4
    return size if byte & 128 else -size


def test_telephony(docs, empty):
    media = telephony.store(docs)
    got, files = by_id(telephony.digests(media)), by_id(telephony.to_pcm(media))
    assert {i: bytes(r.pcm) for i, r in by_id(telephony.described(media)).items()} == {i: bytes(r.pcm) for i, r in files.items()}
    assert [telephony.mulaw_table()[b] for b in range(256)] == [plain_mulaw(b) for b in range(256)]
    assert [telephony.alaw_table()[b] for b in range(256)] == [plain_alaw(b) for b in range(256)]
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r, stored, pcm = got[i], bytes(files[i].media), bytes(files[i].pcm)
        assert telephony.read_wav(stored) == (telephony.MULAW, 8000, padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256, r.pcm_bytes, r.pcm_crc32) == (len(stored), hashlib.sha256(stored).hexdigest(), len(pcm), zlib.crc32(pcm))
        kind, rate, data = telephony.read_wav(pcm)
        samples = np.frombuffer(data, "<i2").tolist()
        assert (kind, rate, len(samples)) == (telephony.PCM, 16000, 2 * len(padded))
        if len(padded) < 1500:
            law = [plain_mulaw(b) for b in padded]
            wide = plain_double(law)
            # Sums in single precision may round the other way.
            assert samples[::2] == law and max(abs(a - b) for a, b in zip(samples, wide, strict=True)) <= 1
            mean = lambda x: sum(map(abs, x)) // len(x)
            ima = [v for k in range(0, len(padded), 64) for v in plain_ima(padded[k : k + 64])]
            power, changes = sum(x * x for x in samples) // len(samples), sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))
            assert r.feature == f"mulaw={mean(law)} alaw={mean([plain_alaw(b) for b in padded])} ima={mean(ima)} power={power} changes={changes}"
    assert telephony.digests(telephony.store(empty)).count() == 0


@pytest.mark.parametrize("kind", [telephony.ALAW, telephony.IMA])
def test_other_kinds_are_stored_as_pcm(docs, kind):
    for r in telephony.to_pcm(telephony.store(docs, kind)).collect()[:20]:
        data = telephony.read_wav(bytes(r.media))[2]
        law = [plain_alaw(b) for b in data] if kind == telephony.ALAW else [v for k in range(0, len(data), 64) for v in plain_ima(data[k : k + 64])]
        assert np.frombuffer(telephony.read_wav(bytes(r.pcm))[2], "<i2")[::2].tolist() == law


def plain_squares(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """Sum-of-squares packing by trying every fill."""
    bins: list[int] = []
    out = []
    for n in lengths:
        best = None
        for fill in sorted({b for b in bins if b + n <= size} | {0}, reverse=True):
            after = [*bins, n] if fill == 0 else [*bins[: bins.index(fill)], fill + n, *bins[bins.index(fill) + 1 :]]
            squares = sum(after.count(h) ** 2 for h in set(after) if h < size)
            if best is None or squares < best[0]:
                best = (squares, fill)
        fill = best[1]
        if fill == 0:
            bins.append(n)
            out.append((len(bins) - 1, 0))
        else:
            k = max(i for i, b in enumerate(bins) if b == fill)
            out.append((k, fill))
            bins[k] += n
    return out


def test_squares_packer_minimises_the_sum():
    r = random.Random(6)
    for _ in range(6):
        size = r.choice([8, 16, 30])
        items = [r.randint(1, size) for _ in range(50)]
        packer = packing.SquaresPacker(size)
        got = [packer.place(n) for n in items]
        assert [g[1] for g in got] == [p[1] for p in plain_squares(items, size)]


def test_packing(docs, empty):
    t = Tokenizer.from_file(BYTES)
    rows = packing.pack_sequences(docs, BYTES, 1, 64).collect()
    assert {r.doc_id for r in rows} == set(range(len(TEXTS)))
    for i, x in enumerate(TEXTS):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [v for r in own for v in r.ids] == ids and all(r.doc_tokens == len(ids) for r in own)
        assert all(r.start == sum(x.length for x in own[:k]) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for k, r in enumerate(own))
    for s in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 64
    fills = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    n = rows and sum(r.length for r in rows)
    assert len(fills) * 64 - n < 3 * 64  # less than one window per partition
    assert packing.pack(empty, BYTES, 1).count() == 0


def test_only_the_emptiest_windows_are_taken_apart():
    """What the sum of squares has placed stays, but for the pieces of the windows that fill the others."""
    r = random.Random(12)
    lengths = [min(300, int(r.lognormvariate(4, 1)) + 1) for _ in range(700)]
    filler, packer = packing.WindowFiller(128), packing.SquaresPacker(128)
    docs = [(i, np.arange(1000 * i, 1000 * i + n, dtype="<u4").tobytes()) for i, n in enumerate(lengths)]
    full = [w for d in docs for w in filler.add(*d)]
    opened = {w: list(ps) for w, ps in filler.held.items()}
    rest = list(filler.rest())
    # The same places as by a packer that is asked for each rest of a document alone.
    placed = {}
    for i, n in enumerate(lengths):
        for _ in range(n // 128):
            packer.whole()
        if n % 128:
            placed[i] = packer.place(n % 128)
    found = {p[0]: (w, p[3]) for w, ps in [*full, *opened.items()] for p in ps if len(p[4]) // 4 == lengths[p[0]] % 128 and p[1] == lengths[p[0]] // 128 * 128}
    assert found == placed
    tokens_of = lambda ws: sorted(x for _, ps in ws for p in ps for x in np.frombuffer(p[4], "<u4").tolist())
    assert tokens_of([*full, *rest]) == sorted(x for _, raw in docs for x in np.frombuffer(raw, "<u4").tolist())
    assert len(rest) == -(-sum(len(p[4]) // 4 for ps in opened.values() for p in ps) // 128)
    for w, ps in rest:
        assert ps[: len(opened[w])] == opened[w]
        assert [p[3] for p in ps] == [sum(len(q[4]) // 4 for q in ps[:k]) for k in range(len(ps))]


def test_language_identification(docs, empty, spark):
    got = by_id(langid.identify(docs))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3
    assert langid.identify(empty).count() == 0
    assert langid.predict(docs, langid.Profiles({})).first().lang_pred == "und"


def test_held_out_accuracy_on_the_driver_s_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    held = [r for r in langid.identify(df).collect() if r.held_out and true[r.doc_id]]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) / len(held) > 0.98


def plain_counts(text: str) -> dict[int, int]:
    clean = "".join(x if (x := (c.lower() if len(c.lower()) == 1 else c)).isalpha() else " " for c in text)
    counts: dict[tuple, int] = {}
    for w in clean.split():
        marked = " " + w + " "
        for n in (1, 2, 3):
            for i in range(len(marked) - n + 1):
                g = tuple(map(ord, marked[i : i + n]))
                if g == (32,):
                    continue
                counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum(c << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return {code(g): n for g, n in counts.items()}


def plain_ranked(text: str, most: int) -> list[int]:
    """The n-grams of most occurrences, at ties those of the smaller number first."""
    counts = plain_counts(text)
    return sorted(counts, key=lambda g: (-counts[g], g))[:most]


def plain_identify(rows: list[tuple]) -> dict[int, tuple]:
    """lang_pred and score of each text by profiles and out-of-place sums over plain dicts; rows are doc_id, text, lang."""
    counts: dict[str, dict[int, int]] = {}
    for i, t, lang in rows:
        if lang is not None and t is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            own = counts.setdefault(lang, {})
            for g, n in plain_counts(t).items():
                own[g] = own.get(g, 0) + n
    profiles = {lang: {g: k for k, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[: langid.PROFILE])} for lang, c in counts.items()}
    out = {}
    for i, t, _ in rows:
        grams = plain_ranked(t or "", langid.RANKED)
        off = {lang: sum(abs(p[g] - k) if g in p else langid.PROFILE for k, g in enumerate(grams)) for lang, p in profiles.items()}
        best = min(sorted(off), key=off.get) if grams and off else "und"
        out[i] = (best, 1 - off[best] / (langid.PROFILE * len(grams)) if best != "und" else 0.0)
    return out


def test_ngrams_are_ranked_as_by_plain_counts():
    for text in ("Hello, hello World!", "a b a", "don't stop", "é1é", "", "1 2", *[t for t in TEXTS if t]):
        for most in (5, 300, 10_000):
            assert langid.ranked(text, most).tolist() == plain_ranked(text, most), text


def test_distances_and_scores_by_brute_force(docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    want = plain_identify(rows)
    got = by_id(langid.identify(docs))
    assert {i: r.lang_pred for i, r in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(r.score == pytest.approx(want[i][1], abs=1e-12) for i, r in got.items())


def plain_grams(text: str | None) -> list[int]:
    """Buckets of a text's words and neighbouring pairs, by plain integers."""
    odd, space = 0x9E3779B97F4A7C15, 1 << 64
    words = [xxhash.xxh64_intdigest(w) for w in (text or "").lower().encode().split()]
    return [((x % space) >> 20) % importance.BUCKETS for x in (*words, *((a * odd + b) % space * odd for a, b in zip(words, words[1:], strict=False)))]


def plain_keys(texts: dict[int, str | None], target: set[int], ids: dict[int, int | None] | None = None) -> dict[int, float]:
    """Sum of the log ratios of the two smoothed models, plus Gumbel noise; -1e300 where there is nothing to weigh.

    Texts are named by row; ids gives their doc_ids if these are others.
    """
    raw, good = [0.5] * importance.BUCKETS, [0.5] * importance.BUCKETS
    for i, t in texts.items():
        for b in plain_grams(t):
            raw[b] += 1
            good[b] += i in target
    ratio = [math.log(g) - math.log(r) for g, r in zip(good, raw, strict=True)]
    shift = math.log(sum(raw)) - math.log(sum(good))
    keys = {}
    for i, t in texts.items():
        grams = plain_grams(t)
        u = ((xxhash.xxh64_intdigest(str(ids[i] if ids else i), importance.SEED) >> 11) + 0.5) / 2**53
        keys[i] = sum(ratio[b] + shift for b in grams) - math.log(-math.log(u)) if grams else -1e300
    return keys


def test_importance(docs, empty, spark):
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(0, len(TEXTS))], "doc_id long, quality int, toxic int")
    got = by_id(importance.resample(docs, labels))
    keys = plain_keys(dict(enumerate(TEXTS)), {i for i in range(len(TEXTS)) if i % 5 and i % 7})
    n = round(sum(i % 5 != 0 for i in range(len(TEXTS))) / len(TEXTS) * len(TEXTS))
    least = sorted(keys.values(), reverse=True)[n - 1]
    assert all(got[i].gumbel_key == pytest.approx(k, rel=1e-9, abs=1e-6) for i, k in keys.items())
    assert all(got[i].selected == (k >= least - 1e-6) for i, k in keys.items() if abs(k - least) > 1e-6 or k == least)
    kept = importance.keep_selected(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.selected}
    assert importance.resample(empty, labels).count() == 0 and importance.keep_selected(empty, labels).count() == 0
    assert importance.resample(docs, labels.limit(0)).count() == len(TEXTS)


def test_noise_is_gumbel_s():
    """Over many documents of equal weight, the mean and the variance of the noise are those of the distribution."""
    draws = np.array([importance.key(3.0, 5, i) - 3.0 for i in range(20_000)])
    assert abs(draws.mean() - 0.5772) < 0.03 and abs(draws.var() - np.pi**2 / 6) < 0.06
    # Of two documents that differ by log 3 in weight, the first comes before the other three times in four.
    ahead = [importance.key(math.log(3), 1, i) > importance.key(0.0, 1, i + 50_000) for i in range(20_000)]
    assert abs(np.mean(ahead) - 0.75) < 0.01


def test_kth_largest(spark):
    r = random.Random(8)
    values = [r.getrandbits(64) - (1 << 63) for _ in range(300)] + [0, -1, 5, 5, 5]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 100, len(values)):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    x = np.array([-np.inf, -1e300, -2.5, -0.0, 0.0, 1e-9, 7.0])
    assert (np.diff(importance.sortable(x)) > 0).all()


def test_vocabularies_are_read_in_place():
    assert WORDS == public_tokenizers.path("word_bpe_49k.json")
