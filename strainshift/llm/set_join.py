"""Jaccard join on word shingles: light sets by subsets, heavy sets by inverted lists.

1.  Each text becomes its set of shingle hashes. Copies of a set met in one task are
    represented by the first. Hashes are dealt out by range, packed into arrays, and counted;
    only hashes that two sets share go back to their sets, with their counts. Hashes of
    one set alone cannot be in an intersection, so what is left gives exact
    intersections. A hash that is frequent inside one task is not dealt out by its value:
    a marker goes there, and its postings go straight back to their sets, so a passage in
    a third of all texts makes no hot task.
2.  Sets are ordered rare hash first (frequent ones last, by value). Two sets of Jaccard
    similarity at least T share an overlap of at least t = ceil(T n) of each, so they share
    one hash among the first n - t + 1, and two among the first n - t + 2. Light sets, up to
    a size boundary, enumerate the pairs of hashes in the latter; heavy sets scan the
    inverted lists of the former, which hold every set large enough to match one. The boundary
    is the size with the least total of subsets written and list entries written and scanned.
    Copies met in different tasks are found first, by their digest, and take no part again.
3.  Sets that meet are connected (each key's sets to their least); these candidate
    components are verified exactly.
    Intersections are counted for many sets at once: hashes that a sixteenth of the sets hold
    as a product of matrices, the others from inverted lists. Central sets gather their
    surroundings first, then only sets outside the largest component are compared.
    A component too large for one task is cut into chunks, and each two chunks are compared
    in a task of their own, starting from the components inside them.
4.  The links found give the components.

Hashes keep 48 bits and the range's bits, 54 or more. Two different shingles of a pair of
sets of 1,000 fall together with a probability below 1e-10.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainshift.llm.components import components
from strainshift.llm.wordhash import WordHasher, batches_of, mix
from strainshift.session import materialise, task_count

WIDTH, PERCENT = 5, 80
#: Hashes a task packs at a time, and how often one must be among them to be frequent.
PACK, FREQUENT = 1 << 20, 64
#: Shared hashes of one verification task, about; components with more are cut into chunks.
HOT_SHARES = 1000
CHUNK = 1 << 21
#: Cells of a task's matrix, cells and list entries of a batch of intersections, and the sets from which central ones go first.
DENSE, CELLS, HUB_LEAST = 1 << 24, 1 << 21, 64
OFTEN = np.int32(2 ** 31 - 1)
U = np.uint64
LOW = U((1 << 48) - 1)
POSTS, MARKS, ROWS = 0, 1, 2
PACKED = "key int, bucket int, kind int, a binary, b binary, c binary, d binary"
SET = "row bigint, doc bigint, n bigint, rep bigint, one array<bigint>, two array<bigint>, m bigint, hashes binary"


def shingle_sets(hasher: WordHasher, texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words is one shingle."""
    words, _, counts = hasher.words(texts)
    ends = np.cumsum(counts)
    long = words[:max(len(words) - width + 1, 0)].copy()
    for k in range(1, width):
        long = long * U(0x9E3779B97F4A7C15) + words[k:k + len(long)]
    long = mix(long)
    sets = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= width:
            s = np.sort(long[end - n:end - width + 1])
            sets.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif n:
            h = np.full(1, n, np.uint64)
            for w in words[end - n:end]:
                h = mix(h * U(0xD6E8FEB86659FD93) + w)
            sets.append(h)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _packer(bits: int, width: int):
    """The scan's side of step 1."""
    def run(batches):
        hasher, met, shift = WordHasher(), {}, U(64 - bits)
        buckets = 1 << bits
        tokens, owners, held, info = [], [], 0, []

        def rows_out(kind, key, bucket, *blobs):
            return (key, bucket, kind, *(b.tobytes() for b in blobs), *[None] * (4 - len(blobs)))

        def flush():
            out = []
            for b, x in _split(np.array([r[0] for r in info], np.int64), buckets, [
                    np.array([r[0] for r in info], np.int64), np.array([r[1] if r[1] is not None else 0 for r in info], np.int64),
                    np.array([r[2] if r[1] is not None else ~r[2] for r in info], np.int64), np.array([r[3] for r in info], np.int64)]):
                out.append(rows_out(ROWS, buckets + b, b, *x))
            if tokens:
                h = np.concatenate(tokens)
                h = ((h >> shift) << U(48)) | (h & LOW)
                row = np.repeat(np.array([o for o, _ in owners], np.int64), [n for _, n in owners])
                order = np.argsort(h, kind="stable")
                h, row = h[order], row[order]
                at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                times = np.diff(np.r_[at, len(h)])
                hot = np.repeat(times >= FREQUENT, times)
                for b, (r, t) in _split(row[hot], buckets, [row[hot], h[hot]]):
                    out.append(rows_out(POSTS, buckets + b, b, r, t, np.full(len(r), OFTEN)))
                marks = h[at[times >= FREQUENT]]
                for k, part in _ranges(marks, buckets):
                    out.append(rows_out(MARKS, k, -1, part))
                h, row = h[~hot], row[~hot]
                first = int(row.min()) if len(row) else 0
                for k, part, r in _ranges(h, buckets, row):
                    order = np.argsort(r, kind="stable")  # by row: its number and how many hashes
                    part, r = part[order], r[order]
                    head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    six = part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    out.append(rows_out(POSTS, k, -1, (r[head] - first).astype("<u4"), np.diff(np.r_[head, len(r)]).astype("<u4"),
                                        six, np.array([first], np.int64)))
            tokens.clear(), owners.clear(), info.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
                zip(*out), [pa.int32()] * 3 + [pa.binary()] * 4)], ["key", "bucket", "kind", "a", "b", "c", "d"])

        for batch in batches:
            rows, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            for a, b in batches_of([len(t) for t in texts]):
                for row, doc, s in zip(rows[a:b], docs[a:b], shingle_sets(hasher, texts[a:b], width)):
                    rep = row
                    if len(s):
                        rep = met.setdefault(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), row)
                    info.append((row, doc, len(s), rep))
                    if rep == row and len(s):
                        tokens.append(s)
                        owners.append((row, len(s)))
                        held += len(s)
                if held >= PACK:
                    yield flush()
                    held = 0
        if info:
            yield flush()

    return run


def _bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(rows.astype(np.uint64)) % U(buckets)).astype(np.int64)


def _split(rows: np.ndarray, buckets: int, arrays):
    """(bucket, arrays) for each bucket that has rows."""
    b = _bucket(rows, buckets)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(b[part[0]]), [x[part] for x in arrays]


def _ranges(h: np.ndarray, buckets: int, *more):
    """(range, hashes, ...) for each range of sorted hashes."""
    cuts = np.searchsorted(h, np.arange(1, buckets, dtype=np.uint64) << U(48)) if len(h) else []
    parts = [np.split(x, cuts) for x in (h, *more)] if len(h) else []
    for k, got in enumerate(zip(*parts)):
        if len(got[0]):
            yield k, *got


def _counter(bits: int):
    """One range of hashes: postings of the shared ones, packed by the bucket of their set."""
    buckets = 1 << bits

    def run(key, df):
        k = int(key[0])
        if k >= buckets:  # what goes straight to its bucket
            return df
        posts, marks = df[df.kind == POSTS], df[df.kind == MARKS]
        rows = [np.repeat(np.frombuffer(a, "<u4").astype(np.int64) + np.frombuffer(d, np.int64)[0], np.frombuffer(b, "<u4"))
                for a, b, d in zip(posts.a, posts.b, posts.d)]
        hashes = []
        for c in posts.c:
            full = np.zeros((len(c) // 6, 8), np.uint8)
            full[:, :6] = np.frombuffer(c, np.uint8).reshape(-1, 6)
            hashes.append(full.view("<u8")[:, 0] | (U(k) << U(48)))
        out = []
        if hashes:
            h, row = np.concatenate(hashes), np.concatenate(rows)
            often = np.unique(np.concatenate([np.frombuffer(a, np.uint64) for a in marks.a])) if len(marks) else np.zeros(0, np.uint64)
            order = np.argsort(h, kind="stable")
            h, row = h[order], row[order]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            times = np.diff(np.r_[at, len(h)])
            count = np.where(np.isin(h[at], often), OFTEN, times).astype(np.int32)
            shared = np.repeat(count >= 2, times)
            count = np.repeat(count, times)[shared]
            for b, (r, t, c) in _split(row[shared], buckets, [row[shared], h[shared], count]):
                out.append((k, b, POSTS, r.tobytes(), t.tobytes(), c.tobytes(), None))
        return pd.DataFrame(out, columns=list(df.columns))

    return run


def _setter(percent: int):
    """One bucket of sets: each with its shared hashes and the prefixes of step 2."""
    def run(df):
        info, posts = df[df.kind == ROWS], df[df.kind == POSTS]
        join = lambda column, kind: np.concatenate([np.frombuffer(x, kind) for x in column]) if len(column) else np.zeros(0, kind)
        row, doc, n, rep = (join(info[c], np.int64) for c in "abcd")
        owner, h, count = join(posts.a, np.int64), join(posts.b, np.uint64), join(posts.c, np.int32)
        order = np.lexsort((h, count, owner))
        owner, h, count = owner[order], h[order], count[order]
        first, last = np.searchsorted(owner, row), np.searchsorted(owner, row, "right")
        out = []
        for r, d, size, p, i, j in zip(row.tolist(), doc.tolist(), n.tolist(), rep.tolist(), first.tolist(), last.tolist()):
            named = size >= 0
            size = size if named else ~size
            if p != r or i == j:
                out.append((r, d if named else None, size, p, None, None, 0, None))
                continue
            least = -(-percent * size // 100)
            alone = size - (j - i)
            one = max(0, size - least + 1 - alone)
            two = max(0, size - least + min(2, least) - alone)
            out.append((r, d if named else None, size, p, h[i:i + one].view(np.int64), h[i:i + two].view(np.int64),
                        j - i, np.sort(h[i:j]).tobytes()))
        table = pd.DataFrame(out, columns=[x.split()[0] for x in SET.split(", ")])
        table["doc"] = table["doc"].astype("Int64")
        return table

    return run


def shared_sets(docs: DataFrame, doc: str, text: str, width: int, percent: int) -> DataFrame:
    """Step 1, written to the shared folder: one row per text, see SET."""
    spark = docs.sparkSession
    bits = max(6, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    packed = rows.mapInArrow(_packer(bits, width), PACKED)
    counted = packed.groupBy("key").applyInPandas(_counter(bits), PACKED)
    return materialise(counted.groupBy("bucket").applyInPandas(_setter(percent), SET))


def copies(sets: DataFrame) -> DataFrame:
    """(row, first): sets that equal an earlier one, found in another task, and the first of them.

    All hashes of such a set are shared, so its packed hashes are the set.
    """
    same = sets.where("m > 0 AND m = n").select("row", F.sha2("hashes", 256).alias("digest"))
    first = same.groupBy("digest").agg(F.min("row").alias("first"))
    return same.join(first, "digest").where("row <> first").select("row", "first")


def size_boundary(sets: DataFrame, percent: int) -> int:
    """The size up to which sets are light, by cost.

    A light set writes a row for each pair of its prefix hashes, a heavy one a row for each
    hash of its shorter prefix, which is scanned once more with its list; sets below the
    boundary that can match a heavy one are in the lists too.
    """
    m1, m2 = F.size("one").cast("double"), F.size("two").cast("double")
    band = F.floor(F.log2("n") * 4)  # quarter octaves: a few hundred rows at most
    rows = sets.where("m > 0").groupBy(band.alias("band")).agg(
        F.max("n").alias("top"), F.sum(m2 * (m2 - 1) / 2).alias("subsets"), F.sum(2 * m1).alias("entries")).orderBy("band").collect()
    best, at = None, 0
    for k in range(len(rows) + 1):
        edge = rows[k - 1]["top"] if k else 0
        light = sum(r["subsets"] for r in rows[:k])
        heavy = sum(r["entries"] for r in rows if r["top"] * 100 > percent * edge)
        if best is None or light + heavy < best:
            best, at = light + heavy, edge
    return at


def candidate_edges(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(u, v): every set that shares a key with others, and the least of them."""
    sets = sets.where("m > 0")
    two = F.col("two")
    pairs = F.flatten(F.transform(two, lambda x, i: F.transform(
        F.slice(two, i + 2, F.size(two)), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))))
    light = sets.where(F.col("n") <= boundary).select("row", F.explode(F.when(F.col("n") == 1, two).otherwise(pairs)).alias("key"))
    heavy = sets.where(F.col("n") * 100 > boundary * percent).select("row", F.explode("one").alias("key"))
    keys = light.select("row", "key", F.lit(0).alias("kind")).unionByName(heavy.select("row", "key", F.lit(1).alias("kind")))
    least = keys.groupBy("kind", "key").agg(F.min("row").alias("v"), F.count("*").alias("n")).where("n > 1")
    return keys.join(least, ["kind", "key"]).where("row <> v").select(F.col("row").alias("u"), "v").distinct()


class _Block:
    """Sets of one task, as inverted lists of the hashes that two of them share."""

    def __init__(self, sizes, hashes):
        self.n = np.asarray(sizes, np.int64)
        k, parts = len(self.n), [np.frombuffer(x, np.uint64) for x in hashes]
        owner = np.repeat(np.arange(k, dtype=np.int32), [len(p) for p in parts])
        _, ids, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = count > 1
        keep = shared[ids]
        self.ids, self.owner, self.count = (np.cumsum(shared, dtype=np.int32) - 1)[ids[keep]], owner[keep], count[shared]
        self.lists = self.owner[np.argsort(self.ids, kind="stable")]
        self.start = np.r_[0, np.cumsum(self.count)]
        self.first = np.searchsorted(self.owner, np.arange(k + 1))
        #: Whether all pairs of sets have cells, or only those that lists name.
        self.cells = 4 * (self.count ** 2).sum() > k * k
        most = np.argsort(-self.count, kind="stable")[:DENSE // k if self.cells else 0]
        most = most[self.count[most] * 16 >= k]
        column = np.full(len(self.count), -1, np.int32)
        column[most] = np.arange(len(most))
        place = column[self.ids]
        self.rare = place < 0
        self.matrix = np.zeros((k, len(most)), np.float32)  # 2 ** 24 columns at most, so sums are exact
        self.matrix[self.owner[~self.rare], place[~self.rare]] = 1

    def linked(self, rows: np.ndarray, percent: int) -> list[np.ndarray]:
        """For each of the sets `rows` the sets similar to it, itself included."""
        k = len(self.n)
        at, size = self.first[rows], self.first[rows + 1] - self.first[rows]
        mine = np.repeat(at - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        line = np.repeat(np.arange(len(rows)), size)
        mine, line = mine[self.rare[mine]], line[self.rare[mine]]
        upto, size = self.start[self.ids[mine]], self.count[self.ids[mine]]
        places = np.repeat(upto - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        codes = np.repeat(line * k, size) + self.lists[places]
        if self.cells:
            both = (self.matrix[rows] @ self.matrix.T).astype(np.float64)
            if len(codes):
                both += np.bincount(codes, minlength=both.size).reshape(both.shape)
            both *= 100 + percent
            same = both >= percent * (self.n[rows][:, None] + self.n)
            same[np.arange(len(rows)), rows] = True
            line, other = np.nonzero(same)
        else:
            codes, both = np.unique(np.r_[codes, np.arange(len(rows)) * k + rows], return_counts=True)
            line, other = codes // k, codes % k
            same = ((100 + percent) * both >= percent * (self.n[rows[line]] + self.n[other])) | (rows[line] == other)
            line, other = line[same], other[same]
        return np.split(other, np.searchsorted(line, np.arange(1, len(rows))))

    def batches(self, rows: np.ndarray):
        """Runs of `rows` whose intersections have about `CELLS` cells and list entries."""
        cost = np.bincount(self.owner, np.where(self.rare, self.count[self.ids], 1), len(self.n))[rows] + (len(self.n) if self.cells else 1)
        return np.split(rows, np.flatnonzero(np.diff((np.cumsum(cost) / CELLS).astype(np.int64))) + 1) if len(rows) else []


def _connect(block: _Block, root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what links connect; `root` holds known components and is kept up to date.

    Of two sets in different components one is outside the largest, so once central sets have
    gathered their surroundings, only those outside the largest are compared, with all. A
    set that shares less than `percent` of its hashes with all others has no link.
    """
    k, out = len(root), []

    def join(rows):
        for u, same in zip(rows.tolist(), block.linked(rows, percent)):
            found, where = np.unique(root[same], return_index=True)
            if len(found) > 1:
                out.extend((u, v) for v in same[where].tolist() if root[v] != root[u])
                root[np.isin(root, found)] = found[0]

    able = np.diff(block.first) * 100 >= percent * block.n
    free, central = able.copy(), np.bincount(block.owner, block.count[block.ids], k) / block.n
    gained = k
    while k >= HUB_LEAST and gained * 16 > k and free.any():
        hub, before = int(np.argmax(np.where(free, central, -1))), np.bincount(root).max()
        join(np.array([hub]))
        free &= root != root[hub]
        gained = np.bincount(root).max() - before
    for rows in block.batches(np.flatnonzero(able & (root != np.argmax(np.bincount(root))))):
        join(rows)
    return out


def _verifier(percent: int):
    """Whole components, or the chunks of a large one: links that connect what is connected.

    Out: kind 0, a link (u, v); kind 1, a member u of a chunk and its component v inside it.
    """
    def run(df):
        df = df.sort_values(["root", "chunk"], kind="stable")
        keys, row, n, hashes, cut = df[["root", "chunk"]].to_numpy(), df.row.to_numpy(), df.n.to_numpy(), df.hashes.to_numpy(), df.chunks.to_numpy() > 1
        at = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(df)].tolist()
        out = []
        for a, b in zip(at, at[1:]):
            rows, root = row[a:b], np.arange(b - a)
            out += [(0, rows[u], rows[v]) for u, v in _connect(_Block(n[a:b], hashes[a:b]), root, percent)]
            if cut[a]:
                out += zip([1] * len(rows), rows, rows[root])
        return pd.DataFrame(out, columns=["kind", "u", "v"])

    return run


def _across(percent: int):
    """Two chunks whose own components are known: links that connect these."""
    def run(df):
        rows, root = df.row.to_numpy(), np.unique(df.label, return_inverse=True)[1]
        return pd.DataFrame([(rows[u], rows[v]) for u, v in _connect(_Block(df.n, df.hashes), root, percent)], columns=["u", "v"])

    return run


def verified_links(sets: DataFrame, labels: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links of similar sets that connect all that similar sets connect."""
    weight = sets.select("row", "n", "m", "hashes").join(labels.withColumnRenamed("node", "row"), "row")
    blocks = weight.groupBy("root").agg(F.ceil(F.sum(F.col("m") + 32) / chunk).cast("int").alias("chunks"))
    placed = materialise(weight.join(blocks, "root").withColumn("chunk", F.expr("CAST(pmod(xxhash64(row), chunks) AS INT)")))
    # small components share a call: one each would cost more than their work
    shares = max(4 * task_count(sets.sparkSession), int(4 * (placed.agg(F.sum("m")).first()[0] or 0) / chunk))
    part = F.when(F.col("chunks") > 1, F.xxhash64("root", "chunk")).otherwise(F.expr(f"pmod(xxhash64(root), {shares})"))
    found = materialise(placed.withColumn("part", part).groupBy("part").applyInPandas(_verifier(percent), "kind int, u bigint, v bigint"))
    links = found.where("kind = 0").select("u", "v")
    cut = found.where("kind = 1").select(F.col("u").alias("row"), F.col("v").alias("label"))
    if cut.isEmpty():
        return links
    members = placed.join(cut, "row").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("chunk <> other")
    tiles = members.groupBy("root", F.least("chunk", "other").alias("tile_i"), F.greatest("chunk", "other").alias("tile_j"))
    return links.unionByName(tiles.applyInPandas(_across(percent), "u bigint, v bigint"))


def jaccard_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH,
                       percent: int = PERCENT, boundary: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Per row: doc, n_shingles, component (the least doc its links reach, itself included).

    Null and empty texts have no shingles and no links. Ids must be whole numbers; a null
    id is passed over when the least is taken. Rows that repeat are linked rows of their
    own. Other columns are not read. `boundary` replaces the size that costs would choose.
    """
    sets = shared_sets(docs, doc, text, width, percent)
    again = materialise(copies(sets))
    firsts = sets.where("m > 0").join(again, "row", "left_anti")
    boundary = size_boundary(firsts, percent) if boundary is None else boundary
    labels = components(candidate_edges(firsts, boundary, percent))
    links = verified_links(sets, labels, percent, chunk)
    roots = components(links.unionByName(again.select(F.col("row").alias("u"), F.col("first").alias("v"))))
    rows = materialise(sets.select("doc", "n", "rep").join(roots, F.col("rep") == F.col("node"), "left").select(
        "doc", "n", F.coalesce("root", "rep").alias("class")))
    least = rows.groupBy("class").agg(F.min("doc").alias("component"), F.count(F.lit(1)).alias("size"))
    # classes that hold a share of all rows: no more than HOT_SHARES of them, so they travel to their rows
    hot = least.where(F.col("size") * HOT_SHARES > rows.agg(F.count(F.lit(1))).scalar()).drop("size")
    cold = rows.join(F.broadcast(hot.select("class")), "class", "left_anti").join(least.drop("size"), "class")
    both = rows.join(F.broadcast(hot), "class").unionByName(cold)
    return both.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), "component")
