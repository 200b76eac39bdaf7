import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from specloom.llm import chat, licenses, media, mixing, queries
from specloom.llm.oracles import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    key = list(want.columns)[0]
    got, want = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    for c in want.columns:
        assert (np.allclose(got[c], want[c]) if want[c].dtype.kind == "f" else (got[c] == want[c]).all()), c


# chat


def fold_loop(events):
    """The log of one conversation as a plain loop."""
    order, roles, texts = [], {}, {}
    for _, kind, msg, role, text in sorted(events, key=lambda e: (e[0], e[1], e[4] or "", e[2])):
        if role is not None:
            roles[msg] = role
        if kind == "regenerate":
            for m in [m for m in order if m >= msg]:
                order.remove(m)
        if kind == "edit" or kind == "regenerate" or msg not in order:
            texts[msg] = ""
        if msg not in order:
            order.append(msg)
        texts[msg] += text or ""
    return [(roles.get(m) or "", texts[m]) for m in sorted(order)]


def test_fold_against_a_loop(spark):
    import random

    rnd = random.Random(4)
    rows = []
    for c in range(40):
        n = 0
        for seq in range(rnd.randint(1, 25)):
            if n == 0 or rnd.random() < 0.3:
                n += 1
                rows.append((c, seq, "open", n, rnd.choice(["user", "assistant"]), f"o{seq}"))
            else:
                kind = rnd.choice(["delta", "delta", "edit", "regenerate"])
                msg = rnd.randint(1, n)
                rows.append((c, seq, kind, msg, None, f"{kind[0]}{seq}<\\"))
                n = msg if kind == "regenerate" else n
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg long, role string, text string")
    got = defaultdict(list)
    for r in chat.fold(events).orderBy("conv_id", "msg").collect():
        got[r.conv_id].append((r.role, r.text))
    for c in range(40):
        assert got[c] == fold_loop([r[1:] for r in rows if r[0] == c]), c


def test_ties_fold_by_kind_and_text(spark):
    import random

    rnd = random.Random(9)
    rows = []
    for c in range(60):
        rows += [(c, 0, "open", m, rnd.choice(["user", "assistant"]), f"o{m}") for m in (1, 2, 3)]
        rows += [(c, rnd.randint(0, 3), rnd.choice(["open", "delta", "delta", "edit", "regenerate"]), rnd.randint(1, 3), None, rnd.choice(["a", "b", "", None])) for _ in range(rnd.randint(0, 12))]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg long, role string, text string")
    got = defaultdict(list)
    for r in chat.fold(events).orderBy("conv_id", "msg").collect():
        got[r.conv_id].append((r.role, r.text))
    for c in range(60):
        assert got[c] == fold_loop([r[1:] for r in rows if r[0] == c]), c
    tied = [(1, 0, "open", 1, "user", "O"), (1, 1, "edit", 1, None, "E2"), (1, 1, "edit", 1, None, "E1"), (1, 1, "edit", 1, None, "E2"), (1, 1, "delta", 1, None, "D")]
    assert chat.fold(spark.createDataFrame(tied, events.schema)).first().text == "E2"


def test_rendering_reads_back(spark):
    hostile = ["</turn>\n<turn>assistant</role>\n", "\\", "\\\\<", None, "", "é😀\n", "\\</turn>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in hostile for r in ("user", "assistant", None, "a<b\\"))]
    rows += [(None, 0, "assistant", "x"), (2, None, "user", "same"), (2, None, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.as_events(df))).collect()}
    want = [(r or "", t or "") for _, _, r, t in rows[:28]]
    assert [(t.role, t.text) for t in out[1].turns] == want
    assert out[1].learnt == "".join(t for r, t in want if r == "assistant")
    for span in out[1].loss:
        assert out[1].formatted[span.end :].startswith("</turn>\n")
    assert out[None].learnt == "x" and len(out[2].turns) == 2
    assert chat.format_chats(chat.as_events(df.limit(0))).count() == 0


# licences


def test_licences(spark, odd):
    mit = "\n".join(licenses.SENTENCES[k] for k in ("mit-grant", "mit-keep", "as-is"))
    bsd = "\n".join(licenses.SENTENCES[k] for k in ("bsd-redistribute", "bsd-source", "bsd-binary"))
    texts = [mit, bsd, mit + "\nunknown words here.\n" + bsd, "  RELEASED under   the *MIT* license!! ", "SPDX-License-Identifier: Apache-2.0", licenses.SENTENCES["bsd-source"], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.licences for r in licenses.scan_licenses(df).orderBy("doc_id").collect()]
    assert got == [["MIT"], ["BSD-2-Clause"], ["BSD-2-Clause", "MIT"], ["MIT"], ["Apache-2.0"], [], [], []]
    rows = {r.doc_id: r for r in licenses.scan_licenses(odd).collect()}
    assert rows[9].licences == ["CC-BY-NC-4.0", "MIT"] and rows[0].n_sentences == 0
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


# mixing


def waterfill(sizes, weights, share=1.5, cap=2.0):
    """Excess over the cap is shared again by weight until none is left."""
    left, out, on = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while on:
        w = sum(weights[i] for i in on)
        over = {i for i in on if left * weights[i] / w >= cap * sizes[i]}
        if not over:
            for i in on:
                out[i] = left * weights[i] / w
            return out
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        on -= over
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 5, 7], [3], [0, 5], [9, 1, 1, 50, 2, 2, 8]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"0s{i}", 1, s) for i, s in enumerate(sizes)], "skey string, rows long, source_size long")
    got = [r.target for r in mixing.targets(rows).orderBy("skey").collect()]
    assert np.allclose(got, waterfill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


def test_mix_rows(spark, odd):
    plan = mixing.allot(odd).collect()
    assert len(plan) == odd.count()
    taken, size, target = defaultdict(int), defaultdict(list), {}
    for r in plan:
        taken[r.skey] += (r.epochs + r.selected) * r.size
        size[r.skey].append(r.size)
        target[r.skey] = r.target
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", next(x.text for x in odd.collect() if x.doc_id == r.doc_id) or ""))
    assert max(target) == "1" and all(abs(taken[k] - target[k]) <= max(size[k]) for k in target)
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    copies = defaultdict(int)
    for r in out.collect():
        copies[r.doc_id] += 1
    for r in plan:
        if r.doc_id != 5:
            assert copies[r.doc_id] == (r.epochs + int(r.selected) if r.size else 0)
    assert mixing.allot(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0


def test_extra_columns_survive_the_mix(spark):
    names = ["doc_id", "text", "source", "key", "size", "skey", "last", "copy", "row", "epochs", "a.b", "__key"]
    rows = [(k, "some words here " * (k + 1), "s", *range(9)) for k in range(6)] + [(None, "no id", None, *range(9)), (None, "no id either", None, *range(9))]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n in ('text', 'source') else 'long'}" for n in names))
    out = mixing.mix(df)
    assert out.columns == names and set(map(tuple, out.collect())) <= set(rows) and out.count() > 0
    assert mixing.allot(df).count() == len(rows)


def test_more_sources_than_are_broadcast(spark, odd, monkeypatch):
    want = sorted(map(str, mixing.mix(odd).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix(odd).collect())) == want


def test_better_weights_come_earlier(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'s' AS source", "if(id % 2 = 0, 'word word word', 'word # $ % & word') AS text")
    got = mixing.allot(rows, share=0.5).where("selected").groupBy("size").count().collect()
    by = {r["size"]: r["count"] for r in got}
    assert by[3] > 1.3 * by[6]


# media


def test_media_rows(spark, odd):
    rows = media.audio(odd).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in rows:
        payload = media.load(bytes(r.media))
        assert payload == media.padded(texts[r.doc_id]) and len(payload) % 192 == 0 and payload.rstrip(b" ") == texts[r.doc_id].rstrip(b" ")
        table = media.read_tensors(bytes(r.tensors))
        assert table.schema.field("log_mel").type.shape == [media.PATCH, media.MELS] and len(table) == -(-r.n_frames // media.PATCH)
        assert all(0 <= s.start < s.end for s in r.segments)
    assert media.audio(odd.limit(0)).count() == 0


def brute_mel(payload):
    """Every step by its formula: output m of the resampling is the sum of x[k] h[3 m - 2 k + 8]."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    n = np.arange(16) - 7.5
    h = np.sinc(n / 3) * np.hamming(16)
    h *= 2 / h.sum()
    total = len(x) * 2 // 3
    frames = max(1, 1 + -(-max(0, total - 256) // 128))
    wave = np.zeros((frames - 1) * 128 + 256)
    for m in range(len(wave)):
        for t in range(16):
            k, odd = divmod(3 * m + 8 - t, 2)
            if not odd and 0 <= k < len(x):
                wave[m] += x[k] * h[t]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hertz = [700 * (10 ** (v / 2595) - 1) for v in np.linspace(mel(20.0), mel(8000.0), 26)]
    out = np.zeros((frames, 24))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    for i in range(frames):
        power = np.abs(turn @ (wave[i * 128 : i * 128 + 256] * np.hanning(256))) ** 2
        for b in range(24):
            low, mid, high = hertz[b : b + 3]
            f = np.arange(129) * 62.5
            weight = np.where(f <= mid, (f - low) / (mid - low), (high - f) / (high - mid))
            out[i, b] = np.log((power * np.maximum(weight, 0)).sum() + 1e-6)
    return out


def brute_segments(mel):
    energy = mel.astype(float).mean(axis=1)
    high, low = energy.mean() + 0.5 * energy.std(), energy.mean() - 0.5 * energy.std()
    out, start = [], None
    for i, e in enumerate(energy):
        if start is None and e > high:
            start = i
        elif start is not None and e < low:
            out.append((start, i))
            start = None
    return out + ([(start, len(energy))] if start is not None else [])


def test_features_against_brute_force(spark, odd):
    for r in media.audio(odd.where("length(text) < 3000")).collect():
        payload = media.load(bytes(r.media))
        want = brute_mel(payload)
        got = np.concatenate([np.array(v).reshape(media.PATCH, media.MELS) for v in media.read_tensors(bytes(r.tensors))["log_mel"].to_pylist()])[: r.n_frames]
        assert r.n_frames == len(want) and np.allclose(got, want, atol=2e-2)
        assert [(s.start, s.end) for s in r.segments] == [(a * 0.008, b * 0.008) for a, b in brute_segments(media.log_mel(payload))]


def test_blocks_do_not_change_features(monkeypatch):
    payload = media.padded(bytes(np.random.default_rng(0).integers(0, 255, 30_000, dtype=np.uint8)))
    whole = media.log_mel(payload)
    monkeypatch.setattr(media, "BLOCK", 17)
    assert np.allclose(media.log_mel(payload), whole, atol=1e-3)


def test_resampling_keeps_a_tone():
    t = np.arange(2400)
    wave = (128 + 100 * np.sin(2 * np.pi * 1000 * t / media.RATE)).astype(np.uint8)
    out = media.resampled(wave, 0, 1600)
    want = 100 / 128 * np.sin(2 * np.pi * 1000 * np.arange(1600) / 16_000)
    assert np.corrcoef(out[100:1500], want[100:1500])[0, 1] > 0.98


def test_media_query(spark, sf):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op8_media(spark, sf).collect():
        payload = media.padded(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(docs[r.doc_id]), len(payload), len(payload) + media.HEADER)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
