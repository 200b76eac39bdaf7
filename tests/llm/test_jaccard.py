import random

import corpus_pipeline
from specloom.llm import jaccard, simhash


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def groups(nodes, pairs):
    """The components as a set of frozen sets."""
    own = {x: {x} for x in nodes}
    for a, b in pairs:
        if own[a] is not own[b]:
            own[a] |= own[b]
            for x in own[b]:
                own[x] = own[a]
    return {frozenset(x) for x in own.values()}


def brute_groups(texts):
    """Components of fingerprints over the pairs of texts at the threshold."""
    sets = [(simhash.fingerprint((t or "").encode()), brute_shingles(t)) for t in texts]
    pairs = [(f, g) for i, (f, a) in enumerate(sets) for g, b in sets[:i] if f != g and near(a, b)]
    return groups([f for f, _ in sets], pairs)


def found_groups(docs):
    rows = [(r.a % 2**64, r.b % 2**64) for r in jaccard.links(docs, jaccard.marks(docs)).collect()]
    return groups([simhash.fingerprint((r.text or "").encode()) for r in docs.collect()], rows)


def test_links_join_what_brute_force_joins(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_groups([r.text for r in docs.collect()])
    assert found_groups(docs) == want and any(len(g) > 1 for g in want)


def test_chains_and_rims(spark):
    """Groups whose members are near each other but not the bucket's first, and chains of edits."""
    rnd = random.Random(3)
    texts = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(120)]
        for k in range(40):
            words = list(words)
            if k % 3:
                words[rnd.randrange(120)] = f"e{g}x{k}"
            texts.append(" ".join(words))
            texts.append(" ".join(words[: 120 - rnd.randrange(25)]))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found, want = found_groups(df), brute_groups(texts)
    assert all(any(g <= w for w in want) for g in found)  # no link but true ones
    pairs = lambda gs: sum(len(g) * (len(g) - 1) // 2 for g in gs)
    assert pairs(found) >= 0.9 * pairs(want)


def test_group_of_near_copies_needs_one_pair_each(spark):
    """One edit in each of many copies: pairs grow with the copies, not with their square."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in range(200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    members = jaccard.cells(jaccard.marks(df).selectExpr("k", "n", "bands")).cache()
    first = jaccard.first_pairs(members).cache()
    assert first.count() < 6 * len(texts)
    assert jaccard.second_pairs(members, first.selectExpr("a", "b", "0.1D AS d")).count() < len(texts)
    assert len([g for g in found_groups(df) if len(g) > 1]) == 1


def test_stage_drops_near_copies(spark, sf):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join(words[:-1] + ["zz", "yy"]), " ".join([*words[:40], "changed", *words[41:]]), " ".join(words[:60] + [f"v{i}" for i in range(40)]), "a b c"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, df, sf)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4]


def test_odd_rows(spark, odd):
    texts = [r.text for r in odd.collect()]
    assert found_groups(odd) == brute_groups(texts)
    empty = odd.limit(0)
    assert jaccard.links(empty, jaccard.marks(empty)).count() == 0


def rims(groups=6, copies=40, length=120):
    """Texts that are near each other but mostly not near the text with most buckets."""
    rnd = random.Random(3)
    texts = []
    for g in range(groups):
        words = [f"g{g}w{i}" for i in range(length)]
        for k in range(copies):
            words = list(words)
            if k % 3:
                words[rnd.randrange(length)] = f"e{g}x{k}"
            texts.append(" ".join(words))
            texts.append(" ".join(words[: length - rnd.randrange(length // 5)]))
    return texts


def test_no_link_of_a_bucket_is_lost(spark):
    """Chains and rims: the components are those of all pairs compared, whether a group is compared whole or by blocks."""
    texts = rims()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").cache()
    want = brute_groups(texts)
    assert found_groups(df) == want
    marked = jaccard.marks(df).where("n > 0").cache()
    one = marked.groupBy("k").agg({"n": "first"}).count()
    texts_of = marked.dropDuplicates(["k"]).selectExpr("k", "struct(doc_id, th) AS at", "n", "bands").cache()
    members = jaccard.buckets(texts_of)
    found = jaccard.sets(df, texts_of, members.select("k").distinct(), "doc_id", "text").cache()
    assert texts_of.count() == one
    joined = lambda most: groups([r.k for r in texts_of.collect()], [(r.a, r.b) for r in jaccard.connected(jaccard.grouped(members, most), found).collect()])
    assert jaccard.grouped(members, 2000).where("NOT whole AND i < j").count() > 0
    assert joined(jaccard.GROUP) == joined(2000)


def test_pairs_beside_the_pivot(spark):
    """Five pairs of near copies in one bucket, each far from the others: whichever text is the pivot, none may be lost."""
    words = lambda g: [f"g{g}w{i}" for i in range(100)]
    texts = [" ".join(t) for g in range(5) for t in (words(g), [*words(g)[:50], "edit", *words(g)[51:]])]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    marked = jaccard.marks(df).selectExpr("doc_id", "th", "fp", "k", "n", "array(1L) AS bands")
    rows = jaccard.links(df, marked).collect()
    got = groups([simhash.fingerprint(t.encode()) for t in texts], [(r.a % 2**64, r.b % 2**64) for r in rows])
    assert got == brute_groups(texts) and len(got) == 5
