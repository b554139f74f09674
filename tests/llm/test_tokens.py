import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strainshift.llm import huffman
from strainshift.llm.token_file import WordEncoder, digest_row, new_file, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


LIBRARY = Tokenizer.from_file(PATH)


def direct(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def direct_all(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("counts", [[], [0, 5], [1, 1], [0, 3, 0, 9, 1], [2 ** k for k in range(40)], [1] * 1000,
                                    [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765, 10946, 17711, 28657]])
def test_codes_are_prefix_free_and_short(counts):
    lengths = huffman.code_lengths(np.array(counts, np.int64))
    assert [x > 0 for x in lengths] == [c > 0 for c in counts]
    assert lengths.max(initial=0) <= huffman.MAX_BITS
    codes = huffman.canonical_codes(lengths)
    said = sorted(format(int(codes[i]), f"0{lengths[i]}b") for i in np.flatnonzero(lengths))
    assert not any(b.startswith(a) for a, b in zip(said, said[1:]))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50000).astype(np.int64)
    counts = np.bincount(ids, minlength=65536) + (np.arange(65536) < 100)
    lengths = huffman.code_lengths(counts)
    data, at = huffman.encode(ids, lengths, huffman.canonical_codes(lengths))
    assert (huffman.decode(data, n, at, huffman.decode_table(lengths)) == ids).all()
    assert len(data) == (int(lengths[ids].astype(int).sum()) + 7) // 8


def test_words_equal_whole_texts():
    rng = random.Random(1)
    parts = ["a", "Ab", "été", "it's", "12", " ", " ", " ", "\n", "\n", "\t", " ", "　", "!?", "x.", "'ll", "\x1c", "日本", "<|endoftext|>", "\r", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)] + ["", " ", "\n", "a b c\nd e"]
    for special in (False, True):
        tok = Tokenizer.from_file(PATH)  # as it comes, it knows the strings of its special tokens
        tok.encode_special_tokens = not special
        want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in WordEncoder(PATH, special).encode([t.encode() for t in texts])] == want
        want = [e.ids for e in tok.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        assert [x.tolist() for x in WordEncoder(PATH, special).encode([t.encode() for t in texts], spaced=True)] == want
    want = direct_all(texts)
    one = WordEncoder(PATH)
    assert one.encode([b"end <|endoftext|> start"])[0].tolist() == [437, 220, 50256, 923]
    assert [one.encode([t.encode()])[0].tolist() for t in texts[:500]] == want[:500]


def test_file_round_trip(spark):
    texts = {5: "b a.\nC", 1: None, 2: "", 9: "word " * 60000 + "end", 7: "b a.\nC", 8: "  two  spaces ", 10: "end <|endoftext|> start"}
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id bigint, text string, ids string")
    path = new_file(spark)
    write_tokens(df, path, PATH)
    got = sorted(map(tuple, read_tokens(spark, path, digest_row, SCHEMA).collect()))
    want, start = [], 0
    for i in sorted(texts):
        ids = direct(texts[i] or "") + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    path = new_file(spark)
    write_tokens(df.limit(0), path, PATH)
    assert read_tokens(spark, path, digest_row, SCHEMA).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "x y"), (3, "a"), (3, "a"), (3, "b c d")], "doc_id bigint, text string")
    path = new_file(spark)
    write_tokens(df, path, PATH)
    rows = sorted(read_tokens(spark, path, digest_row, SCHEMA).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 3, 3, 3]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(4)]


def test_query_equals_library(spark, sf):
    from strainshift.llm.q_tokens import op7_token_file
    got = {r.doc_id: r for r in op7_token_file(spark, sf).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = direct(r.text or "") + [0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (start, len(ids))
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
