import re
from collections import Counter

from specloom.llm import quality_rules, queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, odd):
    out = quality_rules.judge(odd)
    assert [c if c != "m" else "m_" for c in odd.columns] == out.columns[: len(odd.columns)]
    assert sorted(str(r.m_) for r in out.collect()) == sorted(str(r.m) for r in odd.collect())
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((str(r.doc_id), tuple(r.m[k] for k in names)) for r in out.collect())
    assert got == sorted((str(r.doc_id), brute(r.text)) for r in odd.collect())
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_wide_windows_count_alike(spark, odd, monkeypatch):
    monkeypatch.setattr(quality_rules, "INDEX_BITS", 3)
    rows = odd.where("length(text) < 5000")
    got = sorted((str(r.doc_id), r.m.n_repeat_words) for r in quality_rules.measure(rows).collect())
    assert got == sorted((str(r.doc_id), brute(r.text)[4]) for r in rows.collect())


def test_colliding_windows_count_alike(spark, odd, monkeypatch):
    monkeypatch.setattr(quality_rules, "window_hash", lambda words, i: f"cast(char_length({words}[{i}]) % 2 as bigint)")
    rows = odd.where("length(text) < 5000")
    got = sorted((str(r.doc_id), r.m["n_repeat_words"]) for r in quality_rules.measure(rows.drop("m")).collect())
    assert got == sorted((str(r.doc_id), brute(r.text)[4]) for r in rows.collect())


def test_clashing_names(spark):
    df = spark.createDataFrame([("one two three", 1, 2, 3, 4, 5)], "text string, kept int, Base_Failed int, w int, row int, packed int")
    out = quality_rules.judge(df)
    assert out.columns == ["text", "kept_", "Base_Failed_", "w", "row", "packed", "m", "base_failed", "kept"]
    assert out.first()[:6] == ("one two three", 1, 2, 3, 4, 5)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = total = 0
    for r in queries.op10_quality_rules(spark, sf).collect():
        n, c, s, d, w = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, c, s, d, w)
        assert r.base_failed == (n < 50 or 100 * w > 50 * n) and not (r.kept and r.base_failed)
        if not r.base_failed and r.doc_id in labels:
            total, right = total + 1, right + (r.kept == bool(labels[r.doc_id]))
    assert right > 0.85 * total
