"""Token ids against the library on odd texts, and shards by size."""

import random
import struct

from tagweave.llm.queries import tokenizer_path

ODD = ["a", "b", "J̌", "T̈", "H̱", "Ϊ́", "é", "ß", "ſ", "K", "ﬁ", "ά", "ς", "σ", "1", "²", "٣", "'s", "'T", "́", "̈", "中", "ｶﾞ", "한", "!", "&&", "\t", " ", "　", "​", "\x85", "👍🏽", "ǅ", "Σ", "İ", "\x1c", "\x00", "<|", "_"]


def test_ids_equal_the_library_on_random_unicode():
    from tagweave.llm.token_frames import Encoder

    e, r = Encoder(tokenizer_path(), most=500), random.Random(5)
    point = lambda: chr(r.choice([r.randrange(32, 0x250), r.randrange(0x250, 0x3100), r.randrange(0xA000, 0xD7FF), r.randrange(0x10000, 0x1F000)]))
    texts = ["".join(r.choice(ODD) + " " * (r.random() < 0.2) for _ in range(r.randrange(25))) for _ in range(1500)]
    texts += ["".join(point() for _ in range(r.randrange(12))) for _ in range(1500)]
    for lo in range(0, len(texts), 100):
        some = texts[lo : lo + 100]
        for text, got in zip(some, e.encode(some)):
            ids = e.whole.encode(text, add_special_tokens=False).ids
            assert got == struct.pack(f"<{len(ids)}I", *ids), text


def test_shards_in_order(spark):
    from tagweave.llm import token_frames

    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(50, 0, -1)], "doc_id long, text string")
    path = token_frames.new_path(spark, "ids")
    rows = token_frames.write_shards(docs, tokenizer_path(), path, shards=4).orderBy("shard").collect()
    assert len(rows) == 4 and sum(r.documents for r in rows) == 50
    ids = [i for r in rows for i in token_frames.ShardReader(r.uri).index[:, 0].tolist()]
    assert ids == list(range(1, 51))
