import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from namesake.llm import packing, token_counts

ODD = [None, "", " ", "  a", "a  b ", "漢字 é\n\nfoo\tbar", "▁x", "ħœłđ", "Don't WE'LL 's 3.14 a1b2 naïve, Été. ΟΔΟΣ ﬁn éa", "x" * 3000, "foo <|endoftext|> bar<|endoftext|>", "a b c​d", "no.,;no hello!? (paren) Straße. İI"]


def texts():
    rng = random.Random(2)
    parts = ["the", "Tion", "ing,", "é", "ñ", " ", "\n", "###", "漢", "Ab", "12", "'s", "|"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(80)]


def test_counts_equal_the_unigram_tokenizer(spark):
    vocabulary = token_counts.unigram_vocabulary(token_counts.vocabulary_path())
    full = [("<unk>", 0.0)] + [(f"<0x{i:02X}>", -1e4) for i in range(256)] + vocabulary
    truth = Tokenizer(models.Unigram(full, unk_id=0, byte_fallback=True))
    truth.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    docs = list(enumerate(texts())) + [(None, "a b"), (3, "a b"), (3, "a b")]
    got = token_counts.count_tokens(spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_tokens int")).collect()
    want = sorted(((i, len(truth.encode(t or "").ids)) for i, t in docs), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_ties_go_to_the_piece_that_starts_first():
    vocabulary = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("aa", -2.0), ("aab", -3.0), ("ba", -2.0), ("▁a", -2.0), ("abab", -4.0)]
    truth = Tokenizer(models.Unigram([("<unk>", -9.0), *vocabulary], unk_id=0))
    truth.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.Counter(vocabulary)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        assert counter.count([text]) == [len(truth.encode(text).ids)], text


def pieces_by_hand(docs, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(spark, capacity):
    docs = list(enumerate(texts())) + [(None, "a b"), (3, "a b"), (3, "a b"), (500, "word " * 9000)]
    got = packing.pack(spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, length int"), capacity=capacity).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == pieces_by_hand(docs, capacity)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    need = -(-sum(r.length for r in got) // capacity)
    assert len(bins) <= need * 1.1 + 1


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_every_rank_and_fits(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(rng.uniform(2, 8), 1.3, rng.integers(1, 4000)), 1, 4096).astype(int)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
    moves, bins = packing.plan(histogram)
    load, ranks = np.zeros(bins, int), defaultdict(list)
    for n, low, high, at in moves:
        ranks[n].append((low, high))
        load[at : at + high - low] += n
    assert 0 < load.min() and load.max() <= 4096
    for n, count in histogram.items():
        end = 0
        for low, high in sorted(ranks[n]):
            assert low == end
            end = high
        assert end == count


def test_separators_are_tokens():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = [f"a{x}{c}{y}b, the{c}" for c in "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2003\u2028\u202f\u3000\x0b\x0c" for x in ("", " ", "\x1f") for y in ("", "\n", "\x1c.")]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    encoder = packing.Encoder(path, 300)
    got, lengths = encoder.encode(odd)
    assert [x.astype("<u4").tobytes() for x in np.split(got, np.cumsum(lengths)[:-1])] == want
    rng = random.Random(8)
    signs = [*"aBzÄßéΣσ漢١½_'\"-.,;:!?()#@0123", "don't", "it's", "...", "?!", "\u0301", "H\u0331", "\u00a0", "\u2028", "\x85", "word,", "Word", " ", " ", " ", "\n", "\t", "\x1c", "x" * 70]
    for _ in range(30):  # many texts at a time, so that chunks are learned, kept and forgotten
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(60)]
        got, lengths = encoder.encode(texts, 1)
        assert [x.tolist() for x in np.split(got, np.cumsum(lengths)[:-1])] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_long_chunks_and_an_empty_table(spark):
    counter = token_counts.Counter([("▁a", -1.0), ("a", -2.0), ("▁", -3.0), ("aa", -2.5)])
    long = "a" * 5001
    assert counter.count([long, None, "", long + " a"]) == [1 + 2500, 0, 0, 1 + 2500 + 1] and all(len(k) <= 64 for k in counter.cache)
    frame = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, n_tokens int")
    assert token_counts.count_tokens(frame).columns == ["doc_id", "n_tokens"] and token_counts.count_tokens(frame.limit(0)).count() == 0


def test_an_encoder_keeps_few_chunks():
    """Some 200 bytes a chunk: each worker's table stays small beside the other stages of the pipeline."""
    assert packing.CACHE * 200 <= 64_000_000
