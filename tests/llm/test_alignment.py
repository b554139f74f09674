import random
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strainshift.llm import token_alignment as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOK = Tokenizer.from_file(A)
TOK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=B)


@cache
def bytes_a(i):
    """By the published rule: printable bytes keep their character, the others get the next ones from 256."""
    keep = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 173 and (b < 127 or b > 160)]
    to, n = {}, 0
    for b in range(256):
        if b in keep:
            to[chr(b)] = b
        else:
            to[chr(256 + n)] = b
            n += 1
    return bytes(to[c] for c in TOK.id_to_token(i))


@cache
def bytes_b(i):
    p = SP.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" and p[5] == ">" else p.replace("▁", " ").encode()


def cut(tokens):
    """Ends over the bytes."""
    ends, at = [], 0
    for t in tokens:
        at += len(t)
        ends.append(at)
    return ends


def plain_groups(text):
    if not text:
        return []
    a, b = TOK.encode(" " + text, add_special_tokens=False).ids, SP.encode(text)
    ta, tb = [bytes_a(i) for i in a], [bytes_b(i) for i in b]
    whole = (" " + text).encode()
    if b"".join(ta) != whole or b"".join(tb) != whole:
        return []
    ea, eb = cut(ta), cut(tb)
    ends = sorted(set(ea) & set(eb))
    out = [([], []) for _ in ends]
    for side, (ids, at) in enumerate(((a, ea), (b, eb))):
        for i, e in zip(ids, at):
            out[bisect_left(ends, e)][side].append(i)
    return out


def plain(rows):
    per = [(doc, plain_groups(text)) for doc, text in rows]
    hold = Counter()
    links = []
    for _, gs in per:
        mine = [(x, y) for a, b in gs for x in a for y in b]
        links.append(mine)
        hold.update(set(mine))
    most = defaultdict(int)
    for (x, _), n in hold.items():
        most[x] = max(most[x], n)
    out = []
    for (doc, gs), mine in zip(per, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((doc, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(mine),
                    sum(hold[p] == most[p[0]] for p in mine), sum(hold[p] for p in mine), sha256(said.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str), {(x, y, n, n == most[x]) for (x, y), n in hold.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=40), st.lists(st.integers(1, 6), min_size=1, max_size=40))
def test_pointers_find_common_ends(a, b):
    gap = sum(a) - sum(b)
    (b if gap > 0 else a).append(abs(gap)) if gap else None
    ea, eb = np.cumsum(a), np.cumsum(b)
    ga, gb, n = T.groups(ea, eb)
    common = sorted(set(ea) & set(eb))
    assert n == len(common)
    assert ga.tolist() == np.searchsorted(common, ea).tolist() and gb.tolist() == np.searchsorted(common, eb).tolist()


def test_a_long_component_converges():
    ea, eb = np.arange(2, 200_002, 2), np.r_[np.arange(1, 200_000, 2), 200_000]
    ga, gb, n = T.groups(ea, eb)
    assert n == 1 and not ga.any() and not gb.any()


@pytest.mark.parametrize("limit", [1, 7, 1 << 21])
def test_links_of_wide_groups(monkeypatch, limit):
    monkeypatch.setattr(T, "LINKS", limit)
    rng = np.random.default_rng(limit)
    ga, gb = np.sort(rng.integers(0, 5, 60)), np.sort(rng.integers(0, 5, 50))
    a, b, doc = rng.integers(0, 6, 60), rng.integers(0, 6, 50), np.array([0, 0, 1, 2, 2])
    want = Counter((doc[g], x * 10 + y) for g, x in zip(ga, a) for h, y in zip(gb, b) if g == h)
    who, pair, times = T.links(ga, gb, 5, a, b, doc, 10)
    assert dict(zip(zip(who.tolist(), pair.tolist()), times.tolist())) == {(int(d), int(p)): n for (d, p), n in want.items()}


TEXTS = [None, "", " ", "  two  spaces ", "The cat sat on the mat.", "The cat sat on the mat.", "tab\tand\nline\r\n", "日本語のテキスト", "naïve café – “quoted” ½",
         "<|endoftext|> and <s> and </s> <unk> <0x41>", "é ﬁ Ａ", "😀👩‍👩‍👧 emoji", "▁ mark▁here", "a\x00b", "x" * 300, "ab" * 400 + "!" * 99, "word " * 30000]


def test_equals_plain_alignment(spark):
    rng = random.Random(3)
    parts = ["the", " ", "Ünter", "日", "\n", "  ", "ing", "123", "é", "😀", "'ll", "ﬁ", "-", "A", "\t"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(300)]
    rows = [(None if i % 90 == 5 else i // 2 if i % 50 == 0 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, lot string, n_a int")
    want, pairs = plain(rows)
    got, counts = T.align_documents(df.repartition(5), A, B)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {tuple(r) for r in counts.collect()} == pairs
    got, counts = T.align_documents(df.limit(0), A, B)
    assert got.count() == 0 and counts.count() == 0


def test_lots_do_not_matter(spark, monkeypatch):
    from strainshift.llm.q_alignment import op13_token_alignment
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want, _ = plain([tuple(r) for r in docs.collect()])
    assert sorted(map(tuple, op13_token_alignment(spark, sf).collect()), key=str) == want
    small, _ = T.align_documents(docs.repartition(40), A, B)
    assert sorted(map(tuple, small.collect()), key=str) == want
