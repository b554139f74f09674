import sys
import zlib
from hashlib import sha256
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
import check  # noqa: E402
from strainshift.llm import merkle  # noqa: E402
from strainshift.llm.catalog import ORACLES, QUERIES  # noqa: E402
from strainshift.llm.q_merkle import SCHEMA, digest_row  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    out = ""
    for x in (doc, source, lang, n, text):
        out += "-" if x is None else f"{len(str(x).encode())}:{x}"
    return h(out)


def tree(leaves):
    """Root, and the sibling digests of every leaf with their place, level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    proofs = []
    for i in range(len(leaves)):
        steps = []
        for level in levels[:-1]:
            head = i - i % 8
            steps.append((level[head:i], level[i + 1:head + 8]))
            i //= 8
        proofs.append(steps)
    return levels[-1][0], proofs


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r, leaf(*r)))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in order:
        by[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        built[lang] = tree([x[1] for x in by[lang]])
    if not order:
        return []
    root, upper = tree([built[x][0] for x in order])
    out = []
    for lang, above in zip(order, upper):
        subroot, proofs = built[lang]
        for (r, digest), steps in zip(by[lang], proofs):
            steps = [*steps, *above]
            now = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                now = leaf(*r[:4], r[4] if r[4] is None else r[4].translate(LOWER))
            for left, right in steps:
                now = h(*left, now, *right)
            out.append((r[0], digest, subroot, root, h(*[d for a, b in steps for d in a + b]), now, now == root))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, pos string")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = df.select("doc_id", "lang", merkle.leaf_digest(*rest, F.col("text")).alias("digest"),
                       F.when(hit, merkle.leaf_digest(*rest, low)).alias("tampered"))
    placed = merkle.place(leaves, "lang", "doc_id", "digest", ("tampered",))
    return sorted(map(tuple, merkle.prove(placed, digest_row, SCHEMA).collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {"en": 1, "de": 8}, {None: 9, "": 64, "zz": 65, "é": 513},
                                   {f"l{i}": 1 + i % 3 for i in range(20)}])
def test_equals_plain_trees(spark, sizes):
    rows, k = [], 0
    for lang, n in sizes.items():
        for i in range(n):
            k += 1
            rows.append((None if k % 50 == 7 else k // 2 if k % 20 == 0 else k, None if k % 3 else f"s{k}", lang, None if k % 5 == 0 else k,
                         None if k % 11 == 0 else "" if k % 13 == 0 else f"Text É {k}"))
    rows += rows[:2]  # repeated rows
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [4095, 4096, 4097, 9000])
def test_trees_of_several_blocks(spark, n):
    rows = [(i, "s", "en" if i % 300 else "de", i, f"Text {i}") for i in range(n)]
    assert run(spark, rows) == plain(rows)


def test_many_tables(spark):
    """Blocks of 8 nodes, so that the trees pass several tables up and down."""
    rows = [(i, None, None if i % 9 == 0 else "en", 1, "A" * (i % 4)) for i in range(700)]
    df = spark.createDataFrame([(r[0], r[2], bytes.fromhex(leaf(*r)), bytes.fromhex(leaf(*r[:4], r[4].lower())) if zlib.crc32(str(r[0]).encode()) % 3 == 0 else None)
                                for r in rows], "doc_id bigint, lang string, digest binary, tampered binary")
    placed = merkle.place(df, "lang", "doc_id", "digest", ("tampered",))
    assert len(merkle.sweep_up(placed, 1)) == 5
    assert sorted(map(tuple, merkle.prove(placed, digest_row, SCHEMA, 1).collect()), key=str) == plain(rows)


def test_a_long_text_and_every_change_shows(spark):
    rows = [(i, "a", "en", 3, "x") for i in range(20)] + [(20, "a", "en", 9, "Word " * 400_000)]
    assert run(spark, rows) == plain(rows)
    steps = [(2, b"\1" * 64), (0, b"")]
    assert merkle.fold(b"\0" * 32, steps) != merkle.fold(b"\2" * 32, steps)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = check.connect(sf)
    df = QUERIES["op12_merkle_manifest"](spark, sf)
    cur = con.execute(ORACLES["op12_merkle_manifest"])
    got, want = check.table_of(df.columns, [tuple(r) for r in df.collect()]), check.table_of([d[0] for d in cur.description], cur.fetchall())
    assert got == want and 0 < sum("False" in r for r in got[1]) < len(got[1])
