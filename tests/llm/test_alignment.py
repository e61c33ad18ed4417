"""Alignment against a plain walk over both tokenizers' offsets."""

import hashlib
import random
from collections import Counter

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tagweave.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each text, ids from the libraries on whole texts."""
    t = alignment.tokenizers(A, B)
    links, groups, sizes = [], [], []
    for x in texts:
        a = t.a.encode(" " + x, add_special_tokens=False).ids if x else []
        b = t.b.encode(x) if x else []
        raw = (" " + (x or "")).encode()
        if not x or b"".join(t.a_bytes[i] for i in a) != raw or b"".join(t.b_bytes[i] for i in b) != raw:
            links.append([]), groups.append(""), sizes.append((0, 0))
            continue
        i = j = at_a = at_b = 0
        own, of, said = [], [[], []], []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(t.a_bytes[a[i]])
                of[0].append(a[i])
                i += 1
            else:
                at_b += len(t.b_bytes[b[j]])
                of[1].append(b[j])
                j += 1
            if at_a == at_b:
                said.append(",".join(map(str, of[0])) + "|" + ",".join(map(str, of[1])))
                of = [[], []]
        begin = 0
        spans = []
        for k in a:
            spans.append((begin, begin + len(t.a_bytes[k]), k))
            begin = spans[-1][1]
        begin = 0
        for k in b:
            end = begin + len(t.b_bytes[k])
            own += [(m, k) for lo, hi, m in spans if lo < end and begin < hi]
            begin = end
        links.append(own), groups.append(";".join(said)), sizes.append((len(a), len(b)))
    n = Counter(p for own in links for p in own)
    most = Counter()
    for (_, k), c in n.items():
        most[k] = max(most[k], c)
    return [
        (*s, len(g.split(";")) if g else 0, len(own), sum(n[p] == most[p[1]] for p in own), sum(n[p] for p in own), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for s, g, own in zip(sizes, groups, links)
    ]


def found(spark, texts, part=None):
    frame = spark.createDataFrame([(i, x, 7) for i, x in enumerate(texts)], "doc_id long, text string, n_a int")
    out = alignment.aligned(frame, A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return [tuple(r)[1:] for r in out.orderBy("doc_id").collect()]


TEXTS = [
    "Der schnelle Fuchs, naïve café", "", None, "a", " ", "  two  blanks \n\n lines\t", "<|endoftext|> <s> <unk> </s> <0x0A>", "日本語のテキスト", "👩‍👩‍👧 zwj", "x" * 400,
    "copy of a text", "copy of a text", "don't I'll we've", "▁ a▁b", "  ", "\x00\x01 control",
]


def test_against_offsets(spark):
    r = random.Random(3)
    more = [" ".join(r.choice(["the", "internationalisation", "Straße", "123456", "foo_bar", "–", "éàü", "Ω"]) for _ in range(r.randrange(60))) for _ in range(30)]
    assert found(spark, TEXTS + more) == plain(TEXTS + more)


def test_rare_pairs_are_joined(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FREQUENT", 3)
    assert found(spark, TEXTS) == plain(TEXTS)


def test_empty(spark):
    assert found(spark, []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="ab  \n'sé1漢▁"), st.text(alphabet="ab  ")), max_size=6))
def test_parts_have_the_ids_of_the_whole(texts):
    """Long texts are cut: here from the third character on."""
    t, before = alignment.tokenizers(A, B), alignment.PART
    alignment.PART = 3
    try:
        for x in texts:
            parts = list(t.parts(x))
            a, b = t.encode(parts)
            assert "".join(parts) == " " + x
            assert [i for p in a for i in p] == t.a.encode(" " + x, add_special_tokens=False).ids
            assert [i for p in b for i in p] == t.b.encode(x)
    finally:
        alignment.PART = before
