import corpus_pipeline
from specloom.llm import secrets, simhash, toxicity

from .test_jaccard import brute_shingles, groups, near


def brute_firsts(rows):
    """The least id of each component over SimHash's links and those of five-word shingles, all pairs compared."""
    rows = sorted(rows, key=lambda r: r.doc_id)
    fps = [simhash.fingerprint((r.text or "").encode()) for r in rows]
    sets = [brute_shingles(r.text) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2 or near(sets[i], sets[j])]
    return {rows[min(g)].doc_id for g in groups(range(len(rows)), pairs)}


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixture", "tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    by = dict(corpus_pipeline.STAGES)
    clean = by["toxicity"](spark, docs, sf).cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and sum(labels.get(i, 1) == 0 for i in gone) <= 2
    kept = by["near_duplicates"](spark, clean, sf).cache()
    assert {r.doc_id for r in kept.collect()} == brute_firsts(clean.collect()) and kept.columns == columns
    cut = by["secrets"](spark, kept, sf).cache()
    assert cut.count() == kept.count() and cut.columns == columns
    assert not any(secrets.scanner().scan([r.text.encode() for r in cut.collect()]))
    mixed = by["mixture"](spark, cut, sf).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in cut.collect()}
    assert by["tokens"](spark, mixed, sf).count() == mixed.count()


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_stages_take_odd_rows(spark, odd, sf, monkeypatch):
    net = toxicity.train([b"fine words here", b"you idiot there"] * 8, [0, 1] * 8, epochs=2)
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: net)
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() > 0
