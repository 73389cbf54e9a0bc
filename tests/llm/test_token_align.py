"""Token alignment against both libraries over whole texts."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from fraudlake.llm import token_align as ta
from fraudlake.llm.queries import QUERIES

from conftest import SF_SMALL

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def alphabet():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(rest)}}


BYTES = alphabet()


def a_tokens(text):
    e = A.encode(" " + text, add_special_tokens=False)
    return [(i, bytes(BYTES[c] for c in t)) for i, t in zip(e.ids, e.tokens)]


def b_tokens(text):
    return [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode())
            for i, p in ((i, B.id_to_piece(i)) for i in B.encode(text))]


def links(text):
    """Per byte of the text: which tokens hold it; no cut, no chunk, no offset."""
    a, b = a_tokens(text or ""), b_tokens(text or "")
    if not text or b"".join(x for _, x in a) != (" " + text).encode() or \
            b"".join(x for _, x in b) != (" " + text).encode():
        return [], [], [], ""
    of_a = [k for k, (_, x) in enumerate(a) for _ in x]
    of_b = [k for k, (_, x) in enumerate(b) for _ in x]
    pairs = sorted(set(zip(of_a, of_b)))
    ends = [n for n in range(len(of_a)) if n + 1 == len(of_a) or (of_a[n] != of_a[n + 1] and of_b[n] != of_b[n + 1])]
    groups, at = [], 0
    for n in ends:
        ids = [",".join(str(t[k][0]) for k in sorted(set(of[at:n + 1]))) for t, of in ((a, of_a), (b, of_b))]
        groups.append("|".join(ids))
        at = n + 1
    return a, b, [(a[i][0], b[j][0]) for i, j in pairs], ";".join(groups)


def brute(rows):
    every = [(i, links(t)) for i, t in rows]
    count = collections.Counter(p for _, x in every for p in x[2])
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(((i, len(a), len(b), spelled.count(";") + bool(spelled), len(pairs),
                    sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs),
                    hashlib.sha256(spelled.encode()).hexdigest() if spelled else "")
                   for i, (a, b, pairs, spelled) in every), key=repr)


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "x\ny z", "x \ny", "x\n y", "\tq", "hello wörld  x", "▁", "a ▁b c",
       "日本語 テスト", "𠮷野 family 👩‍👩‍👧 é é ﬁ ½", "<|endoftext|> <s> </s> <unk> <0x41>", "a\x00b \x1f c",
       "I'll don't we've 12 345.67 $%& --", "nb sp 　w   ", "x\r\ny {\r z", "word " * 3_000,
       "z" * 3_000, "ab​ ć 🇩🇪 ⅷ", "   ", "\n \n", "١٢٣ क्षि ไทย"]


def columns(df):
    return sorted((tuple(r[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
                   for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_chars", [8_000_000, 40])
def test_odd_texts(spark, block_chars):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a  b"), (None, "hello wörld"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, block int, pairs int")
    got = columns(ta.aligned(df, block_chars=block_chars))
    assert got == brute(rows)
    assert sum(r[1] == 0 for r in got) == 5                    # null twice, empty, two with U+2581


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_token_alignment"](spark, SF_SMALL).withColumnRenamed("doc_id", "id")
    assert columns(got) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ta.aligned(df).collect() == [] == ta.groups(df).collect()
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert columns(ta.aligned(none)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_parts_and_forgetting(monkeypatch):
    """Texts in many parts and a memory of few chunks change nothing."""
    text = "the quick  brown fox\njumps over the lazy dog; " * 40
    whole = ta.spelled_out(text)
    monkeypatch.setattr(ta, "PART_CHARS", 50)
    monkeypatch.setattr(ta, "GROUP_CHARS", 60)
    monkeypatch.setattr(ta, "CACHE_CHUNKS", 3)
    assert ta.spelled_out(text) == whole
    assert ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for _, _, a, b in whole) == links(text)[3]


def test_groups(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in ta.groups(df).collect():
        t, at = " " + (ODD[r.id] or ""), 0
        if r.groups:
            assert r.groups[-1].end == len(t.encode())
        for g in r.groups:
            assert g.start == at < g.end
            at = g.end
        assert ";".join(f"{','.join(map(str, g.a))}|{','.join(map(str, g.b))}" for g in r.groups) == links(ODD[r.id])[3]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tab'sé▁日.1 \r"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    spelled = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for _, _, a, b in ta.spelled_out(text))
    assert spelled == links(text)[3]


def test_coarse_cuts_agree_with_decoded_bytes():
    """Offsets and spans lead to the same ends as adding up the bytes of all tokens."""
    t = ta.aligner(None)
    for text in ODD[2:]:
        if "▁" in text:
            continue
        enc = t.a.encode(" " + text, add_special_tokens=False)
        got = t.b.encode(text, return_type="offset_mapping", return_bytes=True)
        protos = [(p.id, p.begin, p.end) for p in t.b.encode(text, return_type="proto").pieces]
        assert protos == [(i, *o) for i, o in zip(got["ids"], got["offsets"])]
        ends, at = [], 0
        for _, x in a_tokens(text):
            at += len(x)
            ends.append(at)
        assert t.a_ends(" " + text, np.array(enc.ids), np.array(enc.offsets)).tolist() == ends
        ends, at = [], 0
        for _, x in b_tokens(text):
            at += len(x)
            ends.append(at)
        assert t.b_ends(np.array(got["ids"]), np.array(got["offsets"])).tolist() == ends
