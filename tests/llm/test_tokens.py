"""Encoding, counts and files against the libraries; Elias-Fano codes against plain arrays."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from choicerank.llm import bpe, token_counts, token_files
from choicerank.llm.common import Work, on_workers
from choicerank.llm.elias_fano import EliasFano

RANKS, COUNTS, FILES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json",
                                                            "word_bpe_49k.json"))
ODD = ["  a  b\n\n c\n d \t\t e", "aaaaaaaaaaa a", "\x1c\x1d x\x1fy", "　  x y  ", "it's  I'll   ", "", " ", "  \n",
       "don't<|endoftext|>x <|endoftext|> <|ENDOFTEXT|>y", "日本語テキスト😀😀", "a\n\n\nb   ", "x\x85y", "İı ſ ß" + "z" * 3000,
       "Hello, WORLD!! J̌ ΑΣ. café. x1.y2," * 40, None, "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    on_workers(spark)
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    return spark.createDataFrame([(i, t, "x", -1) for i, t in enumerate(ODD + some)],
                                 "doc_id long, text string, ids string, n_tokens int")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_ids_equal_the_library(docs, rows):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS),
                                special_tokens={})
    found = {r.doc_id: r for r in bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, text in rows:
        assert np.frombuffer(found[i].ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(found[i].bytes) == text.encode() and found[i].n_tokens == len(found[i].ids) // 4
    digest = bpe.digest(bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN)).filter("doc_id = 5").first()
    assert digest.ids_sha256 == digest.decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_replay_of_random_words():
    draw = random.Random(5)
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(draw.choice("aab thecé") for _ in range(draw.choice([1, 3, 20, 64, 70, 400]))) for _ in range(300)]
    found = bpe.MergeReplay(ranks).encode([w.encode() for w in words])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode_ordinary(w) for w in words]


def test_memory_bound_changes_nothing():
    small = bpe.Encoder(RANKS, public_tokenizers.PATTERN, keep=3)
    large = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    texts = [t or "" for t in ODD]
    assert [small([t])[0] for t in texts] == large(texts)


def test_counts_equal_the_library(docs, rows):
    library = Tokenizer.from_file(COUNTS)
    found = {r.doc_id: r for r in token_counts.count_tokens(docs, COUNTS, public_tokenizers.PATTERN).collect()}
    for i, text in rows:
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (n, len(text.encode()), n > 512)


def test_files_read_back(spark, docs, rows):
    library, folder = Tokenizer.from_file(FILES), f"{Work(spark).folder}/tokens"
    token_files.write_tokens(docs, folder, FILES, end=2, block_ids=900)
    found = {r.doc_id: r for r in token_files.documents(spark, folder).collect()}
    start = 0
    for i, text in rows:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read_blocks(spark, folder).count() > 3


def test_chunks_of_odd_letters_equal_the_library(monkeypatch):
    """Letters that come apart before marks, ASCII letters that compose in one case only, and a memory that is always full."""
    draw = random.Random(3)
    letters = list("abTHWtwhjyIK's’.,;:!?-_$(\" \t\n\x0b\x1c\x85\xa0éÉßÅİıΣς中12½ﬁ가😀") + [chr(c) for c in (
        0x300, 0x301, 0x307, 0x308, 0x30a, 0x30c, 0x331, 0x338, 0x345, 0x1100, 0x1161, 0x1c5, 0xfb1d)]
    texts = ["", " ", "İ) İ.", "Ṯ ṯ T\u0331 H\u0331 J\u030c", "'. x'. don't.", "a" * 300]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(draw.choice("abcdeAB'.,$ ") for _ in range(60)) for _ in range(1000)]
    expected = [e.ids + [2] for e in Tokenizer.from_file(FILES).encode_batch(texts, add_special_tokens=False)]
    for keep in (token_files.KEEP, 10):
        monkeypatch.setattr(token_files, "KEEP", keep)
        encoder = token_files.ChunkEncoder(FILES)
        found = [ids for k in range(0, len(texts), 700) for ids in encoder(pa.array(texts[k:k + 700]), 2)]
        assert [np.frombuffer(ids, f"<u{encoder.width}").tolist() for ids in found] == expected


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert bpe.encode_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(none, COUNTS, public_tokenizers.PATTERN).count() == 0
    folder = f"{Work(spark).folder}/tokens"
    token_files.write_tokens(none, folder, FILES, end=2)
    assert token_files.documents(spark, folder).count() == 0


@pytest.mark.parametrize("n, bound", [(0, 0), (0, 9), (1, 0), (5, 5), (64, 100), (65, 1 << 20), (1000, 3000), (300, 1 << 40)])
def test_elias_fano(n, bound):
    if (bound >> max(0, (max(bound, 1) // max(n, 1)).bit_length() - 1)) > 1 << 24:
        pytest.skip("too sparse for a small test")
    numbers = np.sort(np.random.default_rng(n).integers(0, bound + 1, n))
    code = EliasFano.of(numbers, bound)
    assert code.all().tolist() == numbers.tolist()
    assert [code.select(i) for i in range(n)] == numbers.tolist()
    with pytest.raises(IndexError):
        code.select(n)
    if n >= 300:
        bits = 8 * (len(code.low) + len(code.high) + len(code.samples))
        assert bits < n * (4 + np.log2(bound / n))


def test_elias_fano_refuses_disorder():
    with pytest.raises(ValueError):
        EliasFano.of(np.array([3, 1]), 5)
