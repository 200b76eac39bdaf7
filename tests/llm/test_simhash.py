import hashlib
import random
import re

import pytest
import xxhash

from specloom.llm import queries, simhash


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Least id reachable over links of at most two bits."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_fingerprints(spark, odd):
    got = simhash.fingerprints(odd).collect()
    want = sorted((str(r.doc_id), brute_fingerprint(r.text)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in got) == want


def test_query_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    parents = brute_components(fps)
    want = {rows[i].doc_id: (f"{fps[i]:016x}", rows[parents[i]].doc_id) for i in range(len(rows))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_balls(spark, seed):
    rnd = random.Random(seed)
    fps = [rnd.getrandbits(63) for _ in range(12)]
    for _ in range(60):
        fps.append(rnd.choice(fps) ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)))
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.stars(simhash.ball_links(nodes)).collect()}
    assert [roots.get(x, x) for x in fps] == [fps[k] for k in brute_components(fps)]


def brute_keep(rows):
    """The kept rows, by (id, text): per component the least id (None last), then the least text key."""
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())
    fps = [brute_fingerprint(r[1]) for r in rows]
    first = {}
    for row, root in zip(rows, brute_components(fps)):
        first[root] = min(first.get(root, row), row, key=order)
    return sorted((str(i), t or "") for i, t in first.values())


def test_keep_first(spark, odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    want = brute_keep([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keep_first_with_repeated_and_null_ids(spark, seed):
    rnd = random.Random(seed)
    texts = [" ".join(f"{p}{i}" for i in range(30)) for p in "abcdef"] + ["", None, "one", "A0 " + " ".join(f"a{i}" for i in range(1, 30))]
    rows = [(rnd.choice([None, 1, 2, 3, 4]), rnd.choice(texts)) for _ in range(40)]
    df = spark.createDataFrame([(*r, k, "n") for k, r in enumerate(rows)], "doc_id long, text string, kept_id long, __n string")
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == brute_keep(rows)


def test_keep_first_of_each_component(spark):
    a, b, c = ("".join(f"{p}{i} " for i in range(40)) for p in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (5, c), (5, c), (None, a), (None, c + "\n"), (None, "alone here now"), (None, "alone  here now")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text.split()[0]) for r in kept) == [("3", "a0"), ("5", "b0"), ("5", "c0"), ("None", "alone")]


def test_empty(spark, odd):
    assert simhash.components(odd.limit(0)).count() == 0
    assert simhash.keep_first(odd.limit(0)).count() == 0
