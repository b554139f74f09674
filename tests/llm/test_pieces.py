import itertools
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from strainshift.llm.piece_sampling import LONGEST, Lattices, Sampler, Vocabulary, cut_units, decode_ids, sample_segmentations, uniform

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


def listed(v, unit):
    """All segmentations of a unit with their shares, by plain recursion."""
    pieces = {}
    for i, b in enumerate(v.bytes):
        if b and i not in set(v.byte_id.tolist()):
            pieces.setdefault(b, i)
    text = unit.decode()

    def paths(at):
        if at == len(text):
            yield (), 1.0
            return
        edges = [(end, (pieces[text[at:end].encode()],)) for end in range(at + 1, len(text) + 1) if text[at:end].encode() in pieces]
        if text[at].encode() not in pieces:
            edges.append((at + 1, tuple(int(v.byte_id[x]) for x in text[at].encode())))
        for end, ids in edges:
            for rest, w in paths(end):
                yield ids + rest, w * math.prod(v.weight[i] for i in ids)

    found = dict(paths(0))
    total = sum(found.values())
    return {p: w / total for p, w in found.items()}


@pytest.mark.parametrize("unit", [" the", " hello", "\nab", " 日本", " x⁂y", "é", " \t", "  a"])
def test_lattice_equals_listing(vocabulary, unit):
    lattices, want = Lattices(vocabulary), listed(vocabulary, unit.encode())
    first = lattices.by_text([unit.encode(), b" filler", unit.encode()])
    assert first[0] == first[2]
    n = 4000
    count, logp, ids = lattices.draw(np.full(n, first[0]), np.arange(n, dtype=np.uint64) * np.uint64(977))
    got, cuts = Counter(), np.cumsum(count)
    for a, b, lp in zip(cuts - count, cuts, logp):
        path = tuple(ids[a:b].tolist())
        assert math.isclose(math.exp(lp), want[path], rel_tol=1e-9)
        got[path] += 1
    for path, p in want.items():
        assert abs(got[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_samples_without_replacement():
    sampler = Sampler(PATH, 3, 5)
    text = b"the cat"
    shares = {}
    for (a, p), (b, q) in itertools.product(listed(sampler.v, b" the").items(), listed(sampler.v, b" cat").items()):
        shares[a + b] = p * q
    n, first, second = 6000, Counter(), Counter()
    for got in sampler.sample(np.arange(n), [text] * n):
        paths = [tuple(g[0].tolist()) for g in got]
        assert len(set(paths)) == 3 and all(p in shares for p in paths)
        assert [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        for ids, logp, value, inclusion in got:
            assert math.isclose(math.exp(logp), shares[tuple(ids.tolist())], rel_tol=1e-9) and 0 < inclusion <= 1
        first[paths[0]] += 1
        second[paths[1]] += 1
    pair = {b: sum(p * shares[b] / (1 - p) for a, p in shares.items() if a != b) for b in shares}
    for counts, want in ((first, shares), (second, pair)):
        for path, p in want.items():
            assert abs(counts[path] / n - p) < 5 * math.sqrt(p / n) + 2e-3


def test_inclusion_weights_give_unbiased_sums():
    """Horvitz-Thompson: the mean of sum logp-weight / inclusion over seeds is 1."""
    sampler, n = Sampler(PATH, 2, 9), 4000
    totals = [sum(math.exp(logp) / inclusion for _, logp, _, inclusion in got) for got in sampler.sample(np.arange(n), [b"of it"] * n)]
    assert abs(np.mean(totals) - 1) < 5 * np.std(totals) / math.sqrt(n) + 1e-3


def test_few_segmentations_are_all_found():
    sampler = Sampler(PATH, 6, 1)
    text = "a⁂"  # with its space: few paths
    want = listed(sampler.v, (" " + text).encode())
    got = sampler.sample(np.array([4]), [text.encode()])[0]
    assert len(got) == min(6, len(want)) and len({tuple(g[0].tolist()) for g in got}) == len(got)
    if len(got) == len(want):
        assert got[-1][3] == 1.0


def test_rare_mass_is_found_by_listing():
    sampler = Sampler(PATH, 2, 1)
    unit = b" the"
    state = sampler.lattices.by_text([unit])[0]
    want = listed(sampler.v, unit)
    had = set(sorted(want, key=want.get, reverse=True)[:-2])
    rest = {p: w for p, w in want.items() if p not in had}
    got = Counter(tuple(sampler._by_listing(state, had, np.array([k * 7919], np.uint64))[0].tolist()) for k in range(600))
    assert set(got) <= set(rest)
    for path, w in rest.items():
        p = w / sum(rest.values())
        assert abs(got[path] / 600 - p) < 5 * math.sqrt(p * (1 - p) / 600) + 0.01


def test_round_trip_and_library_decoding(vocabulary):
    rng, model = random.Random(3), sentencepiece.SentencePieceProcessor(model_file=PATH)
    parts = ["a", " ", " ", "\n", "\t", "the", "日本", "😀", "é", "x" * 70, "⁂", "word", " ", "\r\n"]
    texts = ["", " ", "\n", "the " * 30] + ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(200)]
    sampler = Sampler(PATH, 2, 1)
    data = [t.encode() for t in texts]
    got = sampler.sample(np.arange(len(texts)), data)
    for text, samples in zip(texts, got):
        assert samples
        for ids, *_ in samples:
            assert decode_ids(ids.astype("<u2").tobytes(), vocabulary) == text if text else len(ids) == 0
            assert model.decode(ids.tolist()) == text
        assert b"".join(cut_units(text.encode())) == (b" " + text.encode() if text else b"")
        assert all(len(u) <= LONGEST for u in cut_units(text.encode()))
    alone = Sampler(PATH, 2, 1)
    for k in (3, 50, 120):  # the same samples in any batch
        one = alone.sample(np.array([k]), [data[k]])[0]
        assert [(i.tolist(), lp, g, q) for i, lp, g, q in one] == [(i.tolist(), lp, g, q) for i, lp, g, q in got[k]]


def masses(v, unit):
    """Of a unit, exact sums over all segmentations from each byte on and up to it, and its edges (start, end, piece)."""
    pieces = {}
    for i, b in enumerate(v.bytes):
        if b and i not in set(v.byte_id.tolist()):
            pieces.setdefault(b, i)
    edges, at = [], 0
    for char in unit.decode():
        size = len(char.encode())
        edges += [(at, end, pieces[unit[at:end]]) for end in range(at + 1, min(at + v.longest, len(unit)) + 1) if unit[at:end] in pieces]
        if char.encode() not in pieces:
            edges += [(at + k, at + k + 1, int(v.byte_id[unit[at + k]])) for k in range(size)]
        at += size
    behind, before = [Fraction(0)] * len(unit) + [Fraction(1)], [Fraction(1)] + [Fraction(0)] * len(unit)
    for a, b, i in sorted(edges, reverse=True):
        behind[a] += Fraction(v.weight[i]) * behind[b]
    for a, b, i in sorted(edges, key=lambda e: e[1]):
        before[b] += Fraction(v.weight[i]) * before[a]
    return behind, before, edges


@pytest.mark.parametrize("unit", [" " + "中国人民大学的学生们在北京" * 8, " https://www.example.com/" + "international/information/" * 11, " " + "⁂𓀀" * 90,
                                  "\n" + "aGVsbG8gd29ybGQhIHRoaXMgaXMgYmFzZTY0" * 9])
def test_long_unit_has_its_whole_lattice(vocabulary, unit):
    data = unit.encode()
    assert len(data) >= 300
    behind, before, edges = masses(vocabulary, data)
    lattices, n = Lattices(vocabulary), 2000
    first = lattices.by_text([b" the", data, b" filler"])
    assert lattices.logp[:lattices.size].max() <= 1e-12
    count, logp, ids = lattices.draw(np.full(n, first[1]), np.arange(n, dtype=np.uint64) * np.uint64(977))
    log = lambda x: math.log(x.numerator) - math.log(x.denominator)
    over, cuts = Counter(), np.cumsum(count)
    for a, b, lp in zip(cuts - count, cuts, logp):
        path = ids[a:b].astype(np.int64)
        assert vocabulary.decode(path) == data
        assert abs(sum(math.log(vocabulary.weight[i]) for i in path) - log(behind[0]) - lp) < 1e-7
        ends = np.cumsum(vocabulary.size[path])
        over.update(zip((ends - vocabulary.size[path]).tolist(), ends.tolist()))
    spanning = 0.0
    for a, b, i in edges:  # each piece is drawn as often as the whole lattice says, also those across every 64th byte
        p = float(before[a] * Fraction(vocabulary.weight[i]) * behind[b] / behind[0])
        assert abs(over[a, b] / n - p) < 5.5 * math.sqrt(p * (1 - p) / n) + 2e-3
        spanning += p if a // LONGEST < (b - 1) // LONGEST else 0.0
    assert spanning > 0 or "⁂" in unit
    if unit[0] == " ":
        for ids, lp, value, inclusion in itertools.chain(*Sampler(PATH, 2, 1).sample(np.arange(40), [data[1:]] * 40)):
            assert abs(sum(math.log(vocabulary.weight[i]) for i in ids) - log(behind[0]) - lp) < 1e-7 and 0 < inclusion <= 1
    alone = Lattices(vocabulary)
    short = alone.by_text([b" the", b" filler"])
    for f, g in zip(first[[0, 2]], short):  # short units are the same beside a long one
        assert (lattices.upto[lattices.edge[f]:lattices.edge[f + 1]] == alone.upto[alone.edge[g]:alone.edge[g + 1]]).all()


def test_uniform_is_open():
    u = uniform(np.arange(100000, dtype=np.uint64))
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01


def test_table_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "some text here", 7), (3, "some text here", 7), (None, "x", 7), (4, "w" * 100000, 7),
                                (5, "the word " * 20000, 7)], "doc_id bigint, text string, sample int")
    rows = sample_segmentations(df, PATH).collect()
    assert all(r.exact for r in rows)
    assert all(r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) and r.n_pieces * 2 == len(r.ids) for r in rows)
    by = Counter(r.doc_id for r in rows)
    assert by == {1: 1, 2: 1, 3: 4, None: by[None], 4: 2, 5: 2} and by[None] >= 1
    assert len({(r["sample"], r.ids_crc32) for r in rows if r.doc_id == 3}) == 2
    assert sample_segmentations(df.limit(0), PATH).count() == 0
