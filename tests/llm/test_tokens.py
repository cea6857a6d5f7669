"""BPE and token counts against the libraries that read the same files."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from pulseloom.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"ab  \n\t'lrevsdtm019!?é\u3000漢字😀<|", "<|endoftext|>", "'ll", "'re", "  ", " \n", "İ", "\u0378", "\u088f", "\x1c", "\x85", "tion", "\U00010940"]


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(enc):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


@pytest.fixture(scope="module")
def reader():
    return Tokenizer.from_file(FILE)


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_ids_are_the_library_s(enc, library):
    for text in [*random_texts(1500, 1), "x" * 5000 + "ab" * 7000 + "é" * 900, " " * 3000, "\n \n" * 500]:
        assert enc.encode(text) == library.encode_ordinary(text), text[:40]
        assert enc.decode(enc.encode(text)) == text.encode()


def test_counts_of_texts_and_prefixes(reader):
    count = token_counts.counter(FILE)
    for text in random_texts(400, 2):
        want = [len(reader.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        prefixes = count.prefixes(text)
        assert count.count(text) == want[-1]
        assert [prefixes.at(i) for i in range(len(text) + 1)] == want, text
        for budget in range(8):
            over = next((i for i, n in enumerate(want) if n > budget), None)
            assert prefixes.fit(budget) == (len(text) if over is None else over - 1)


def test_sorted_pieces_share_counts(reader):
    rnd = random.Random(5)
    words = ["".join(rnd.choice(["th", "e", "in", "g", "é", "漢", "s"]) for _ in range(rnd.randint(1, 9))) for _ in range(600)]
    count = token_counts.Counter(FILE)
    pieces = sorted({w.encode() for w in words})
    assert list(count.pieces.totals(pieces)) == [count.pieces.of(p)[-1] for p in pieces]
    count.learn([words, words[:5], []])
    for w in words[:200]:
        assert count._totals[w] == len(reader.encode(w, add_special_tokens=False).ids)


def test_long_piece_count(reader):
    text = "ab" * 3000 + " " * 500 + "1" * 700
    assert token_counts.counter(FILE).count(text) == len(reader.encode(text, add_special_tokens=False).ids)


def test_rows(spark, library, reader):
    texts = [None, "", "a", "it's <|endoftext|> 1234", "it's <|endoftext|> 1234", "word " * 3000]
    rows = [(i if i != 2 else None, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")  # a column with a clashing name
    got = sorted(bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect(), key=repr)
    want = []
    for key, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    counted = {tuple(r) for r in token_counts.count_tokens(df, FILE, limit=1024).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    assert counted == {
        (k, len((t or "").encode()), n := len(reader.encode(t or "", add_special_tokens=False).ids), n > 1024) for k, t, _ in rows}
    ids = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    back = {(r.doc_id, bytes(r.content)) for r in bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {(k, (t or "").encode()) for k, t, _ in rows}
    assert token_counts.prefix_counts(df.where("doc_id = 3"), FILE).first().counts[-1] == len(reader.encode(texts[3], add_special_tokens=False).ids)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect() == []
    assert token_counts.count_tokens(df, FILE, limit=5).collect() == []
