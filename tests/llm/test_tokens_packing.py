"""BPE, unigram counts and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from fraudlake.llm import bpe, packing, token_counts
from fraudlake.llm.queries import QUERIES

from conftest import SF_SMALL

ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "thean' dsre", "aAbB1 2'_-.,;!?*#", "éèüßñ çœ a", "日本語テスト あ",
             "́̇eaİΣσς ", "\x85\xa0\x1c\x1f  a1²½Ⅷ", "​﻿　ab <|"]
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "<|endoftext|>x<|startoftext|> <|endoftext|"), (5, "a" * 5000),
       (5, "tie"), (None, "no id"), (6, "It's WE'LL i'd 'S"), (7, "x " * 9000), (8, "é Å ǅ")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.WordBPE(bpe.default_path())


def ids_of(encoder, text):
    return np.frombuffer(b"".join([e[0] for part in next(encoder.encode_texts([text])) for e in part]), dtype="<u4").tolist()


def test_bpe_on_random_texts(encoder, library):
    rng = random.Random(3)
    for _ in range(6000):
        a = rng.choice(ALPHABETS)
        t = "".join(rng.choice(a) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.1:
            t += "<|endoftext|>" + t
        assert ids_of(encoder, t) == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_bpe_on_every_plain_character(encoder, library):
    for cp in range(0x250):
        t = f"a{chr(cp)}b {chr(cp)}{chr(cp)} 1{chr(cp)}'s"
        assert ids_of(encoder, t) == library.encode(t, add_special_tokens=False).ids, hex(cp)


def test_bpe_blocks_and_memory_limits(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 8)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 60)
    monkeypatch.setattr(bpe, "CACHE_NODES", 20)
    monkeypatch.setattr(bpe, "CACHE_CHARS", 4)
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("etaoins.") for _ in range(rng.randint(1, 12))) for _ in range(400))
    for t in (text, text.replace(" ", ""), text.replace(" ", "\n"), "x" * 300):
        assert ids_of(bpe.WordBPE(bpe.default_path()), t) == library.encode(t, add_special_tokens=False).ids


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    raw = np.array(ids, dtype="<u4").tobytes()
    return (len(ids), hashlib.sha256(raw).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_query(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op10_bpe"](spark, SF_SMALL).collect()}
    assert got == {d.doc_id: expected(library, d.text) for d in docs}


def test_bpe_on_odd_rows(spark, library):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = bpe.encoded(df, ids=True).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=repr) == \
        sorted(((i, *expected(library, t)) for i, t in ODD), key=repr)
    for r in got:
        assert hashlib.sha256(np.array(r.ids, dtype="<u4").tobytes()).hexdigest() == r.ids_sha256
        assert hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256
    assert bpe.encoded(df.where("false")).count() == 0


# --- unigram counts ------------------------------------------------------------------
@pytest.fixture(scope="module")
def unigram():
    vocab, unknown = token_counts.vocabulary(token_counts.default_path())
    lib = Tokenizer(models.Unigram(vocab, unknown, True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace()
    return token_counts.Counter(vocab, unknown), lib


def test_counts_on_random_texts(unigram):
    counter, lib = unigram
    rng = random.Random(7)
    for _ in range(4000):
        a = rng.choice(["ab cdthe ", "aaaa ▁ bb", "<0x41><s></s><unk> ab", "กข\U0001F600￿ሴ q", *ALPHABETS])
        t = "".join(rng.choice(a) for _ in range(rng.randint(0, 25)))
        assert counter.count(t) == len(lib.encode(t).ids), repr(t)


@pytest.mark.parametrize("fallback", [False, True])
def test_counts_with_ties(fallback):
    rng = random.Random(11)
    for _ in range(150):
        pieces = {"".join(rng.choice("▁abc") for _ in range(rng.randint(1, 4))): rng.choice([-1., -1.5, -2., -3.])
                  for _ in range(rng.randint(3, 14))}
        vocab = [("<unk>", 0.0), *pieces.items()]
        if fallback:
            vocab += [(f"<0x{b:02X}>", -1.0) for b in range(256)]
        counter = token_counts.Counter(vocab, 0, fallback)
        lib = Tokenizer(models.Unigram(vocab, 0, fallback))
        lib.pre_tokenizer = pre_tokenizers.Metaspace()
        for _ in range(30):
            t = "".join(rng.choice("abcdé ▁") for _ in range(rng.randint(0, 12)))
            assert counter.count(t) == len(lib.encode(t).ids), (vocab, t)


def test_counts_query_and_odd_rows(spark, unigram):
    lib = unigram[1]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = {r.doc_id: (r.n_chars, r.n_tokens) for r in QUERIES["op4_token_counts"](spark, SF_SMALL).collect()}
    assert got == {d.doc_id: (len(d.text or ""), len(lib.encode(d.text or "").ids)) for d in docs}
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_tokens", F.lit(-1))
    rows = token_counts.counted(df).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=repr) == \
        sorted(((i, len(lib.encode(t or "").ids)) for i, t in ODD), key=repr)
    assert token_counts.counted(df.where("false")).count() == 0


# --- packing -------------------------------------------------------------------------
def check_packing(rows, texts, library, room=2048):
    """rows: (id, piece, start, length, crc, sequence, offset)"""
    want, total = [], 0
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), room)):
            part = ids[at:at + room]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(sequences), total


def test_packing_query(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    rows = [tuple(r) for r in QUERIES["op7_packing"](spark, SF_SMALL).collect()]
    n, total = check_packing(rows, [(d.doc_id, d.text) for d in docs], library)
    assert n <= -(-total // 2048) * 1.03 + 1


def test_packing_on_odd_rows_in_many_groups(spark, library):
    rng = random.Random(1)
    texts = ODD + [(100 + i, "word " * rng.randint(0, 300)) for i in range(150)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("piece", F.lit("x"))
    out = packing.packed(df, group_rows=20)
    assert out.count() > len(texts)
    rows = [(r.id, r.piece, r.start, r.length, r.crc, r.sequence_id, r.offset) for r in out.collect()]
    n, total = check_packing(rows, texts, library)
    assert n <= total / 2048 * 1.15 + 2
    assert packing.packed(df.where("false")).count() == 0


def test_rule_is_the_smallest_sum_of_squares():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 33, 300)
    bins, offsets = packing.pack_lengths(lengths, 32)
    order = np.argsort(-lengths, kind="stable")
    used = {}
    for i in order:
        gaps = [32 - u for u in used.values()]

        def cost(values):
            return sum(sum(v == g for v in values) ** 2 for g in set(values) if 0 < g < 32)

        s = int(lengths[i])
        options = {g: cost([x for k, x in enumerate(gaps) if k != gaps.index(g)] + [g - s])
                   for g in set(gaps) if g >= s}
        options[32] = min(options.get(32, 10 ** 9), cost(gaps + [32 - s]))
        here = 32 - used.get(int(bins[i]), 0)
        assert options[here] == min(options.values())
        assert offsets[i] == used.get(int(bins[i]), 0)
        used[int(bins[i])] = used.get(int(bins[i]), 0) + s
