from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from millrace.llm import chat, common
from millrace.llm.queries import BYTES, table
from test_operators_by_brute_force import plain_keys, plain_rules
from test_shingles import plain_components
from tokenizers import Tokenizer


def plain_preferences(turns: list[tuple]) -> dict[tuple, tuple]:
    convs: dict[int, list] = {}
    for c, n, role, text in sorted({t for t in turns if t[0] is not None}, key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    show = lambda ts: "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in ts)
    said = lambda ts: sum(len(x) for r, x in ts if r == "assistant")

    def mask(ts):
        at, out = 0, []
        for r, x in ts:
            at += len(show([(r, x)]))
            if r == "assistant":
                out.append(f"{at - len(x) - 9}-{at}")
        return ",".join(out)

    out = {}
    for c, ts in convs.items():
        first = min(k for k, v in convs.items() if v[0] == ts[0])
        if first != c:
            a, b = (c, first) if said(ts) > said(convs[first]) else (first, c)
            good, bad = convs[a], convs[b]
        else:
            replies = [i for i, (r, _) in enumerate(ts) if r == "assistant"]
            if not replies:
                continue
            a = b = c
            good = ts[: replies[-1] + 1]
            bad = ts[: replies[-1]] + [("assistant", ts[replies[-2]][1] if len(replies) > 1 else "")]
        n = next((i for i, (x, y) in enumerate(zip(good, bad)) if x != y), min(len(good), len(bad)))  # noqa: B905
        out[a, b] = (n, show(good[:n]), show(good[n:]), show(bad[n:]), mask(good[n:]), mask(bad[n:]))
    return out


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_preferences(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_ROWS", few)
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    r = random.Random(2)
    turns = [(c, t, ["user", "assistant"][t % 2], r.choice(["hi", "yes", "no\nway", "é漢"])) for c in range(60) for t in range(r.randint(1, 6))]
    turns += [(70, 0, None, None), (71, None, "user", "x"), (71, 1, "assistant", ""), (None, 0, "user", "hi"), (72, 1, "user", "a"), (72, 1, "assistant", "b"), turns[0]]
    df = spark.createDataFrame([(*t, 9, "k") for t in turns], "conv_id long, turn long, role string, text string, k1 int, turns string")
    got = {(x.chosen_id, x.rejected_id): tuple(x)[2:] for x in chat.preferences(df).collect()}
    assert got == plain_preferences(turns)
    assert chat.preferences(df.limit(0)).count() == 0


def test_format_of_given_pairs(spark):
    df = spark.sql("SELECT array(struct('user' as role, 'q' as text), struct('assistant' as role, 'good' as text)) chosen, array(struct('user' as role, 'q' as text)) rejected UNION ALL SELECT null, null")
    rows = chat.format_pairs(df).collect()
    assert rows[0].prompt == "<|user|>\nq\n<|end|>\n" and rows[0].rejected_text == "" and rows[0].chosen_text[rows[0].chosen_mask[0].start : rows[0].chosen_mask[0].stop] == "good\n<|end|>\n"
    assert rows[1].prompt == "" and rows[1].n_prompt_turns == 0


def plain_rules_stage(rows: list[tuple]) -> list[tuple]:
    """Rows (doc_id, text, source) that pass the rules, without the lines of over 20 documents of a host."""
    def key(line: str) -> str:
        return re.sub("[0-9]+", "0", re.sub("[ \t\x0b\x0c\r]+", " ", line).lower()).strip(" ")

    found: dict[tuple, set] = {}
    for i, t, source in rows:
        for x in (t or "").split("\n"):
            if key(x) and i is not None:
                found.setdefault((source or "", key(x)), set()).add(i)
    common = {k: min(v) for k, v in found.items() if len(v) > 20}
    out = []
    for i, t, source in rows:
        n, _, _, _, repeats = plain_rules(t)
        if n < 50 or 100 * repeats > 50 * n:
            continue
        lines = t.split("\n")
        gone = [(source or "", key(x)) in common and common[source or "", key(x)] != i for x in lines]
        left = n - sum(len(key(x).split(" ")) for x, g in zip(lines, gone, strict=True) if g)
        if not any(gone):
            out.append((i, t, source))
        elif left >= 50 and left >= 0.5 * n:
            out.append((i, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), source))
    return out


def plain_suffix_stage(rows: list[tuple]) -> list[tuple]:
    """Rows without the bytes of strings of 100 that start earlier: in a smaller doc_id (null first) or in the same text."""
    texts = sorted({(i, t) for i, t, _ in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    first: dict[bytes, int | None] = {}
    for i, t in texts:
        for s in range(len(t.encode()) - 99):
            first.setdefault(t.encode()[s : s + 100], i)
    done = {}
    for i, t in texts:
        raw, own = t.encode(), set()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if first[w] != i or w in own:
                gone[s : s + 100] = b"\1" * 100
            own.add(w)
        done[i, t] = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    return [(i, done[i, t], source) for i, t, source in rows]


def plain_pipeline(rows: list[tuple], target: set[int], drawn: int) -> Counter:
    """How often each token stands at each place of a document, after all stages by plain means."""
    distinct = dict(enumerate(rows))
    keys = plain_keys({k: r[1] for k, r in distinct.items()}, {k for k, r in distinct.items() if r[0] in target}, {k: r[0] for k, r in distinct.items()})
    least = sorted(keys.values(), reverse=True)[drawn - 1]
    rows = [r for k, r in distinct.items() if keys[k] >= least]
    rows = plain_rules_stage(rows)
    linked = plain_components({i: t for i, t, _ in rows if i is not None})
    rows = [r for r in rows if r[0] is None or linked[r[0]] == r[0]]
    rows = plain_suffix_stage(rows)
    t = Tokenizer.from_file(BYTES)
    return Counter((i, k, x) for i, text, _ in rows for k, x in enumerate([*t.encode(text, add_special_tokens=False).ids, 1]))


def pipeline_rows() -> tuple[list[tuple], list[tuple]]:
    """Documents (doc_id, text, source) with copies, near copies, common lines and passages, junk, nulls and repeats; and labels."""
    r = random.Random(21)
    good = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(600)]
    bad = ["".join(r.choice("uvwxyz") for _ in range(r.randint(3, 8))) for _ in range(300)]
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    passage = say(good, 70)
    rows, labels = [], []
    for i in range(110):
        text = say(good, r.randint(60, 140))
        if i % 4 == 0:
            text = f"Read more here {i}\n{text}"
        if i % 10 == 1:
            text = f"{text}\n{passage}"
        rows.append((i, text, f"h{i % 2}"))
        labels.append((i, 1, 0))
    rows += [(200 + i, say(bad, 90), "h0") for i in range(20)]
    labels += [(200 + i, 0, 0) for i in range(20)]
    near = rows[5][1].split(" ")
    near[30] = "changed"
    rows += [(300, rows[7][1], "h1"), (301, " ".join(near), "h0"), (302, say(good, 20), "h0"), (303, "one two three " * 40, None), (304, None, "h0"), (305, "", "h0"), rows[9], rows[9], (None, say(good, 80), "h1"), (306, f"{say(good, 60)} naïve 漢字 {passage}", "h0")]
    r.shuffle(rows)
    return rows, labels


def test_pipeline_is_what_plain_stages_give(spark, tmp_path):
    rows, labels = pipeline_rows()
    full = [(i, t, "en", source, None if t is None else len(t), "x", 1, 2.5) for i, t, source in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key string, node int, place double").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((p.doc_id, p.start + k, x) for p in corpus_pipeline.run(spark, str(tmp_path)).collect() for k, x in enumerate(p.ids))
    drawn = round((1 - 20 / 130) * len(rows))
    want = plain_pipeline(rows, set(range(110)), drawn)
    assert got == want
    ids = {i for i, _, _ in want}
    # Copies and near copies are gone, most bad ones too; nearly all good ones are there.
    assert not ids & {300, 301, 302, 303, 304, 305} and len(ids & set(range(200, 220))) <= 2 and len(ids & set(range(110))) >= 105


def test_pipeline_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near dedup", "suffix dedup", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes and 0 < out.count() <= docs.count(), name
