"""Alignment of two tokenizers' tokens by pointer jumping, with counts of linked ids.

Both tokenizations cover the same bytes. Every token points to the token of the other side
that overlaps it and reaches farthest right; a token of the first side whose end is an end of
both points to itself. Doubling all successors at once (a numpy gather) until none moves
leads each token to the last one of its component: that labels the groups. Two tokens are
linked when they share a group.

Documents are encoded in lots of some MB. A lot keeps its distinct linked id pairs with the
number of its documents that hold them; only those are shuffled to be counted over the
corpus, once per lot, so a pair that all documents hold is as many rows as there are lots.
The counts come back to each lot the same way. No pair of a document is ever a row.

Null and empty texts, and texts that either tokenizer does not give back byte for byte, have
no tokens: zeros and no groups. Rows with a null or repeated id are documents like any other.
An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainshift.llm.token_file import WordEncoder
from strainshift.llm.wordhash import batches_of
from strainshift.llm.worker import kept
from strainshift.session import materialise

#: Texts of about so many bytes make a lot; a longer text is one alone.
LOT_BYTES = 1 << 22
#: Texts of about so many bytes are aligned at a time, and links are made so many at a time.
BATCH_BYTES, LINKS = 1 << 20, 1 << 21
LOTS = ("lot string, docs array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
        "groups array<string>, pairs array<bigint>, n_docs array<bigint>, held binary")


def byte_level(token: str) -> bytes:
    """The bytes of a byte-level token: printable Latin-1 stands for itself, the other bytes follow from U+0100."""
    return bytes(_BYTE_OF[c] for c in token)


_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in set(_PLAIN)]
_BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(_REST)}


class Vocabulary:
    """Bytes of all tokens in one buffer."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens) or b"\0", np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        total = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[ids] - (total - sizes), sizes) + np.arange(total[-1] if len(ids) else 0)]


class Pair:
    """Both tokenizers. The first one encodes the space and the text, the second the text, to which it adds the space."""

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece

        self.a = WordEncoder(byte_bpe, special=False)
        names = self.a.tok.get_vocab()
        tokens = [b""] * (max(names.values()) + 1)
        added = {i: t.content for i, t in self.a.tok.get_added_tokens_decoder().items()}
        for name, i in names.items():
            tokens[i] = added[i].encode() if i in added else byte_level(name)
        self.va = Vocabulary(tokens)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.vb = Vocabulary([self._piece(i) for i in range(self.b.get_piece_size())])
        self.names = [str(i) for i in range(max(len(tokens), self.b.get_piece_size()))]
        # an id before a comma, before a bar, and before a semicolon
        self.written = [f"{i}{mark}".encode() for mark in ",|;" for i in self.names]

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none for texts that either does not give back."""
        want = [b" " + t for t in texts]
        a = self.a.encode(texts, spaced=True)
        b = [np.array(x, np.int64) for x in self.b.encode([t.decode() for t in texts], num_threads=1)]
        none = np.zeros(0, np.int64)
        for i, (text, whole) in enumerate(zip(texts, want)):
            if not text or self.va.joined(a[i]).tobytes() != whole or self.vb.joined(b[i]).tobytes() != whole:
                a[i] = b[i] = none
        return a, b


def successors(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For the tokens of both sides, by their ends: the farthest-right overlapping token, or itself at a common end."""
    n = len(end_a)
    over_b = np.searchsorted(end_b, end_a)  # the token of b that holds the last byte of a's
    over_a = np.searchsorted(end_a, end_b)
    closed = end_b[over_b] == end_a if n else np.zeros(0, bool)
    return np.r_[np.where(closed, np.arange(n), n + over_b), over_a]


def terminals(succ: np.ndarray) -> np.ndarray:
    """Where each token's way ends, by doubling."""
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ
        succ = further


def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group numbers of the tokens of both sides, and the number of groups, from the tokens' ends over the same bytes."""
    last = terminals(successors(end_a, end_b))
    number = np.cumsum(last[:len(end_a)] == np.arange(len(end_a))) - 1
    return number[last[:len(end_a)]], number[last[len(end_a):]], int(number[-1]) + 1 if len(end_a) else 0


def links(group_a, group_b, n_groups: int, a: np.ndarray, b: np.ndarray, doc_of_group: np.ndarray, width: int):
    """(document, pair, times), distinct: the linked id pairs of each document and how many links they make.

    Equal ids of a group are joined first, so a long group of few ids is few pairs; links are
    made in lots of about LINKS, or one token's.
    """
    def distinct(group, ids):
        key, times = np.unique(group * np.int64(1 << 32) + ids, return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, times

    ga, ia, ta = distinct(group_a, a)
    gb, ib, tb = distinct(group_b, b)
    first = np.searchsorted(gb, np.arange(n_groups + 1))
    each = np.diff(first)[ga]  # distinct partners of each distinct token of a
    upto = np.cumsum(each)
    found, at = [], 0
    while at < len(ga):
        done = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, done + LINKS, "right")))
        n = each[at:stop]
        left = np.repeat(np.arange(at, stop), n)
        right = np.repeat(first[ga[at:stop]] - (upto[at:stop] - n - done), n) + np.arange(len(left))
        found.append(_summed(doc_of_group[ga[left]], ia[left] * width + ib[right], ta[left] * tb[right]))
        if len(found) > 8:
            found = [_summed(*map(np.concatenate, zip(*found)))]
        at = stop
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return found[0] if len(found) == 1 else _summed(*map(np.concatenate, zip(*found)))


def _summed(doc, pair, times):
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[at], pair[at], np.add.reduceat(times, at) if len(at) else times


def write_groups(pair: Pair, a, b, group_a, group_b, n_groups: int) -> tuple[list[bytes], np.ndarray]:
    """All tokens as written, group by group, and where each group begins in that list."""
    count_a, count_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    size = count_a + count_b
    begin = np.cumsum(size) - size
    codes, n = np.empty(len(a) + len(b), np.int64), len(pair.names)
    codes[np.arange(len(a)) + (np.cumsum(count_b) - count_b)[group_a]] = a
    codes[np.arange(len(b)) + np.cumsum(count_a)[group_b]] = b
    codes[begin + count_a - 1] += n
    codes[begin + size - 1] += 2 * n
    return list(map(pair.written.__getitem__, codes.tolist())), begin


def align(pair: Pair, texts: list[bytes]):
    """Per text: n_a, n_b, n_groups, n_links, digest of the written groups; and (text, pair, times) of the distinct pairs."""
    a, b = pair.encode(texts)
    n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    flat_a = np.concatenate([np.zeros(0, np.int64), *a]).astype(np.int64)
    flat_b = np.concatenate([np.zeros(0, np.int64), *b]).astype(np.int64)
    # all texts are one run of bytes; a text's end is an end of both sides
    group_a, group_b, n_groups = groups(np.cumsum(pair.va.sizes[flat_a]), np.cumsum(pair.vb.sizes[flat_b]))
    doc_of_group = np.zeros(n_groups, np.int64)
    doc_of_group[group_a] = np.repeat(np.arange(len(texts)), n_a)
    per_doc = np.bincount(doc_of_group, minlength=len(texts))
    made = np.bincount(group_a, minlength=n_groups) * np.bincount(group_b, minlength=n_groups)
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, doc_of_group, made)
    words, _ = write_groups(pair, flat_a, flat_b, group_a, group_b, n_groups)
    digests, at = [], 0
    for n in (n_a + n_b).tolist():
        digests.append(sha256(b"".join(words[at:at + n])[:-1]).hexdigest() if n else "")
        at += n
    found = links(group_a, group_b, n_groups, flat_a, flat_b, doc_of_group, pair.b.get_piece_size())
    return [n_a, n_b, per_doc, n_links, digests], found


def aligned_lots(docs: DataFrame, byte_bpe: str, pieces: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The table of lots: documents with their counts, distinct pairs with their documents, and who holds which."""
    kinds = pa.schema([("lot", pa.string()), ("docs", pa.list_(pa.int64()))] + [(c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")]
                      + [("groups", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64())), ("held", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        pair = kept(f"pair of {byte_bpe} and {pieces}", lambda: Pair(byte_bpe, pieces))
        part, number, held = TaskContext.get().partitionId(), 0, 0
        names, columns, found = [], [[], [], [], [], []], []

        def close():
            who, codes, times = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.lexsort((codes, who))
            who, codes, times = who[order], codes[order], times[order]
            pairs, place, n_docs = np.unique(codes, return_inverse=True, return_counts=True)
            blob = np.concatenate([np.bincount(who, minlength=len(names)), place, times]).astype("<i8")
            values = [[f"{part}.{number}"], [names], *[[np.concatenate(c)] for c in columns[:4]], [columns[4]], [pairs], [n_docs], [pack(blob)]]
            return pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(values, kinds)], schema=kinds)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for i, j in batches_of([len(t) for t in texts], BATCH_BYTES):
                counts, (who, codes, times) = align(pair, texts[i:j])
                found.append((who + len(names), codes, times))
                names += keys[i:j]
                for column, c in zip(columns[:4], counts):
                    column.append(c)
                columns[4] += counts[4]
                held += sum(len(t) for t in texts[i:j])
                if held >= LOT_BYTES:
                    yield close()
                    names, columns, found, held, number = [], [[], [], [], [], []], [], 0, number + 1
        if names:
            yield close()

    return docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, LOTS)


def pack(numbers: np.ndarray) -> bytes:
    """Small numbers by the width they need."""
    kind = np.min_scalar_type(numbers.max()) if len(numbers) else np.dtype("u1")
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(numbers.astype(f"<u{kind.itemsize}").tobytes())


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), f"<u{blob[0]}").astype(np.int64)


def pair_counts(lots: DataFrame, width: int) -> DataFrame:
    """(pair, count, best): the documents that hold each linked pair, and whether no pair of its first id has more."""
    each = lots.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n_docs").alias("count"))
    each = materialise(each.withColumn("first_id", F.floor(F.col("pair") / width).cast("long")))
    most = each.groupBy("first_id").agg(F.max("count").alias("most"))  # a row per vocabulary entry at most
    return each.join(most, "first_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, byte_bpe: str, pieces: str, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the pairs (a_id, b_id, count, best)."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    lots = materialise(aligned_lots(docs, byte_bpe, pieces, doc, text))
    counts = materialise(pair_counts(lots, width))
    asked = lots.select("lot", F.posexplode("pairs").alias("at", "pair"))
    # a row per lot and distinct pair; a lot's pairs, bounded by its tokens, return to it
    told = asked.join(counts, "pair").groupBy("lot").agg(F.collect_list(F.struct("at", "count", "best")).alias("told"))
    schema = "doc bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

    def run(batches):
        for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            names = batch.column("docs")[0].values
            n = len(names)
            column = lambda c: batch.column(c)[0].values.to_numpy(zero_copy_only=False)
            blob = unpack(batch.column("held")[0].as_py())
            place, times = np.split(blob[n:], 2)
            who = np.repeat(np.arange(n), blob[:n])
            count, best = np.zeros(len(column("pairs")), np.int64), np.zeros(len(column("pairs")), bool)
            if batch.column("told")[0].is_valid:
                rows = batch.column("told")[0].values
                at = rows.field("at").to_numpy()
                count[at], best[at] = rows.field("count").to_numpy(), rows.field("best").to_numpy(zero_copy_only=False)
            sums, bests = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(sums, who, count[place] * times)
            np.add.at(bests, who, best[place] * times)
            yield pa.RecordBatch.from_arrays([
                names, *[pa.array(column(c)) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(bests), pa.array(sums),
                batch.column("groups")[0].values], ["doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = lots.drop("n_docs").join(told, "lot", "left").mapInArrow(run, schema)
    pairs = counts.select(F.floor(F.col("pair") / width).cast("long").alias("a_id"), (F.col("pair") % width).alias("b_id"), "count", "best")
    return rows, pairs
