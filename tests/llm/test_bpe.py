import hashlib
import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

from specloom.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "<|endoftext|>", "'s", "'LL", "é", "日本語", "١٢", "12", "²", "½", "ª", "×", "ɏ", "ɐ", "’", "€", "abc", "Hello", " world", "!!", "$%", "😀", "é", "\0", "a" * 50, "-" * 70, "x9" * 90]


def test_codec_against_the_tokenizer():
    theirs, ours = Tokenizer.from_file(PATH), bpe.codec(PATH)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["", "ab" * 3000, "\n" * 2000, "the " * 900]
    for text, mine, right in zip(texts, ours.encode(texts), theirs.encode_batch(texts, add_special_tokens=False)):
        assert list(struct.unpack(f"<{len(mine) // 4}I", mine)) == right.ids
        assert ours.decode(mine) == theirs.decode(right.ids, skip_special_tokens=False)


def test_known_words_are_bounded():
    small = bpe.Codec(bpe.Vocabulary(PATH), known=5)
    texts = ["one two three four five six seven"] * 2
    assert [small.encode([t])[0] for t in texts] == bpe.codec(PATH).encode(texts)


def test_rows(spark, odd):
    theirs = Tokenizer.from_file(PATH)
    rows = bpe.encode(odd, PATH).collect()
    want = sorted((str(r.doc_id), bytes(struct.pack(f"<{len(i)}I", *i))) for r in odd.collect() for i in [theirs.encode(r.text or "", add_special_tokens=False).ids])
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in rows) == want
    assert bpe.encode(odd.limit(0), PATH).count() == 0


def test_query(spark, sf):
    theirs = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op5_bpe(spark, sf).collect():
        ids = theirs.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
