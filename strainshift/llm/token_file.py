"""Token ids of a corpus as a file of independent Huffman blocks.

Documents are put in ascending id order by a range partitioning, so the files follow one
another; each task encodes its documents into blocks of whole documents. The staged ids
(16 bits each) are counted over the whole corpus, the counts make one code, and each block
is coded by itself. Nothing but the counts (one number per vocabulary entry) and the
blocks' sizes per file reach the driver.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strainshift.llm import huffman
from strainshift.llm.wordhash import WordHasher, batches_of, mix
from strainshift.llm.worker import kept
from strainshift.session import shared_folder

END_ID = 0
#: A block is closed by the document that brings it to so many ids.
BLOCK_IDS = 1 << 17
#: Texts of about so many bytes are encoded at a time.
BATCH_BYTES = 1 << 20
#: Words whose ids a worker remembers, at some 40 bytes each, and how many of them stay apart as the latest.
CACHE_WORDS, LATEST_WORDS = 2_000_000, 1 << 17
#: Bytes that are a plain gap, other white space, or may begin white space beyond ASCII.
KINDS = np.zeros(256, np.uint8)
GAP, ODD, ASK = 1, 2, 3
KINDS[[32, 10]], KINDS[[9, 11, 12, 13, 28, 29, 30, 31]], KINDS[[0xC2, 0xE1, 0xE2, 0xE3]] = GAP, ODD, ASK
DOCS, IDS = pa.list_(pa.int64()), pa.list_(pa.int64())


class WordEncoder:
    """Ids by the tokenizers library, remembered per word.

    A byte-level BPE with the usual splitting never joins across a space or newline that
    has no white space beside it. So a text whose white space is all of that kind is cut
    before each of it, and its words are looked up by a 64-bit hash; other texts are
    encoded whole, and so are texts that hold the string of an added token. With
    ``special`` off such strings of special tokens are ordinary text. New words are encoded many at a time, as texts; the ids that begin with
    the space or newline tell them apart.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        # an added token found in a text is cut out before words are
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values() if special or not t.special]
        self.head = np.zeros(1 << 16, bool)
        self.head[[i for token, i in self.tok.get_vocab().items() if token[0] in "\u0120\u010a"]] = True
        self.hasher = WordHasher(fold=False)
        self.forget()

    def forget(self):
        """Sorted keys of words, with the place and number of their ids; the latest words apart."""
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.levels, self.ids, self.used = [empty, empty], np.zeros(1 << 16, "<u2"), 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each key; -1 for words not met yet."""
        at, size = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for known, places, sizes in self.levels:
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[i] == keys
                at[hit], size[hit] = places[i[hit]], sizes[i[hit]]
        return at, size

    def _keep(self, level: int, new) -> None:
        merged = [np.r_[a, b] for a, b in zip(self.levels[level], new)]
        order = np.argsort(merged[0], kind="stable")
        self.levels[level] = tuple(x[order] for x in merged)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Words begin with their space or newline; those that begin a text have neither."""
        inside = [i for i, w in enumerate(words) if w[0] in " \n"]
        first = [i for i, w in enumerate(words) if w[0] not in " \n"]
        found = self.plain([words[i] for i in first])
        sizes, parts = np.zeros(len(words), np.int64), [None] * len(words)
        for i, ids in zip(first, found):
            sizes[i], parts[i] = len(ids), ids
        groups = [inside[i:i + 256] for i in range(0, len(inside), 256)]
        for group, ids in zip(groups, self.plain(["".join([words[i] for i in g]) for g in groups])):
            at = np.flatnonzero(self.head[ids])
            if len(at) != len(group):
                raise ValueError("the vocabulary joins words; it is not of the kind this encoder knows")
            sizes[group] = np.diff(np.r_[at, len(ids)])
            parts[group[0]] = ids
        order = np.array(first + inside, np.int64)  # as the ids are put down
        ends = np.cumsum(sizes[order]) + self.used
        at = np.empty(len(words), np.int64)
        at[order] = ends - sizes[order]
        ids = np.concatenate([parts[i] for i in order if parts[i] is not None])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, (self.used + len(ids)) * 3 // 2)
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self._keep(1, (keys, at, sizes))
        if len(self.levels[1][0]) > LATEST_WORDS:
            self._keep(0, self.levels[1])
            self.levels[1] = tuple(x[:0] for x in self.levels[1])

    def encode(self, texts: list[bytes], spaced: bool = False) -> list[np.ndarray]:
        """16-bit ids of each text, or of a space and the text."""
        hashes, lengths, counts, places, buffer = self.hasher.placed_words(texts)
        kind = KINDS[buffer]
        gap = kind == GAP
        odd = (kind == ODD) | (gap & np.r_[True, gap[:-1]])  # another kind, or two in a row
        ends = np.cumsum([len(t) + 1 for t in texts])
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(ends, np.flatnonzero(odd), "right")] = True
        if spaced:
            whole |= np.array([not t for t in texts], bool)
        for token in self.added:
            whole |= np.array([token in t for t in texts], bool)
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(kind == ASK), "right")):
            whole[i] |= " ".join((t := texts[i].decode()).split()) != t.replace("\n", " ")
        # What stands before a word: nothing, a space, or a newline.
        before = np.where(buffer[places - 1] == 10, np.uint64(2), np.uint64(1))
        heads = np.cumsum(counts) - counts
        before[heads[counts > 0]] = int(spaced)
        use = np.repeat(~whole, counts)
        keys, first, back = np.unique(mix(hashes[use] + before[use]), return_index=True, return_inverse=True)
        if len(self.levels[0][0]) > CACHE_WORDS:
            self.forget()
        at, size = self._find(keys)
        new = at < 0
        if new.any():
            first = first[new]
            start, stop = places[use][first], places[use][first] + lengths[use][first]
            raw, head = buffer.tobytes(), ("", " ", "\n")
            self._learn(keys[new], [head[k] + raw[a:b].decode() for k, a, b in zip(before[use][first].tolist(), start.tolist(), stop.tolist())])
            at[new], size[new] = self._find(keys[new])
        at, size = at[back], size[back]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(at - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        cuts = np.r_[0, total][np.cumsum(np.where(whole, 0, counts))]
        alone = iter(self.plain([" " * spaced + texts[i].decode() for i in np.flatnonzero(whole)]))
        return [next(alone) if w else part for w, part in zip(whole, np.split(ids, cuts[:-1]))]


def stage_ids(docs: DataFrame, tokenizer: str, doc: str, text: str) -> DataFrame:
    """Blocks of whole documents: part, block, docs, sizes, ids (compressed 16-bit)."""
    end = np.array([END_ID], "<u2")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, squeeze, block = kept(f"words of {tokenizer}", lambda: WordEncoder(tokenizer)), zstandard.ZstdCompressor(level=1), 0
        names, sizes, data, held = [], [], [], 0

        def close():
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([names], DOCS),
                pa.array([sizes], IDS), pa.array([squeeze.compress(np.concatenate(data).tobytes())], pa.binary())],
                ["part", "block", "docs", "sizes", "ids"])

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in batches_of([len(t) for t in texts], BATCH_BYTES):
                for key, ids in zip(keys[a:b], encoder.encode(texts[a:b])):
                    names.append(key)
                    sizes.append(len(ids) + 1)
                    data += [ids, end]
                    held += sizes[-1]
                    if held >= BLOCK_IDS:
                        yield close()
                        names, sizes, data, held, block = [], [], [], 0, block + 1
        if names:
            yield close()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(parts, "doc", "row").sortWithinPartitions("doc", "row")
    return rows.select("doc", "text").mapInArrow(run, "part int, block int, docs array<bigint>, sizes array<bigint>, ids binary")


def count_ids(staged: DataFrame) -> DataFrame:
    """(id, n) over the whole corpus; counted in each task first."""
    def run(batches):
        unpack, counts = zstandard.ZstdDecompressor(), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                counts += np.bincount(np.frombuffer(unpack.decompress(x.as_py()), "<u2"), minlength=1 << 16)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["id", "n"])

    return staged.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc: str = "doc_id", text: str = "text") -> None:
    """Encode every document, END_ID after it, into path/code and path/blocks.

    Ascending doc order; rows of one doc stand as they are read, a null doc
    comes first, null text is the empty text. code: (id, bits) of the canonical code.
    blocks: part, block, docs, sizes, n, checkpoints (bit offsets), data. An empty table
    writes an empty file.
    """
    spark = docs.sparkSession
    stage_ids(docs, tokenizer, doc, text).write.option("compression", "uncompressed").parquet(f"{path}/staged")
    staged = spark.read.parquet(f"{path}/staged")
    counts = np.zeros(1 << 16, np.int64)
    for row in count_ids(staged).collect():  # one row per vocabulary entry at most
        counts[row["id"]] = row["n"]
    lengths = huffman.code_lengths(counts)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, bits int").coalesce(
        1).write.parquet(f"{path}/code")

    def pack(batches):
        unpack, codes = zstandard.ZstdDecompressor(), huffman.canonical_codes(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(unpack.decompress(batch.column("ids")[i].as_py()), "<u2")
                data, at = huffman.encode(ids, lengths, codes)
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(one.column(c) for c in ("part", "block", "docs", "sizes")), pa.array([len(ids)], pa.int64()),
                     pa.array([at.tolist()], IDS), pa.array([data], pa.binary())],
                    ["part", "block", "docs", "sizes", "n", "checkpoints", "data"])

    staged.mapInArrow(pack, "part int, block int, docs array<bigint>, sizes array<bigint>, n bigint, "
                      "checkpoints array<bigint>, data binary").write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_code(spark: SparkSession, path: str) -> np.ndarray:
    lengths = np.zeros(1 << 16, np.uint8)
    for row in spark.read.parquet(f"{path}/code").collect():
        lengths[row["id"]] = row["bits"]
    return lengths


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, start): ids before each block, in file order."""
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "n")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    inside = "coalesce(sum(n) OVER (PARTITION BY part ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    parts = parts.select("part", F.expr(before).alias("part_start"))  # one row per file
    blocks = blocks.select("part", "block", F.expr(inside).alias("inside"))
    return blocks.join(parts, "part").select("part", "block", (F.col("inside") + F.col("part_start")).alias("start"))


def read_tokens(spark: SparkSession, path: str, per_document, schema: str) -> DataFrame:
    """Decode every block; per_document(ids, doc, start, size) makes a row from each document's ids."""
    lengths = read_code(spark, path)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        table = huffman.decode_table(lengths)
        for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            rows = []
            for r in batch.to_pylist():
                ids = huffman.decode(r["data"], r["n"], np.array(r["checkpoints"], np.int64), table)
                at = 0
                for doc, size in zip(r["docs"], r["sizes"]):
                    rows.append(per_document(ids[at:at + size], doc, r["start"] + at, size))
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

    blocks = spark.read.parquet(f"{path}/blocks")
    return blocks.join(block_starts(spark, path), ["part", "block"]).mapInArrow(run, schema)


def digest_row(ids, doc, start, size):
    return doc, start, size, zlib.crc32(ids.astype("<u4").tobytes())


def new_file(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/strainshift/tokens-{uuid.uuid4().hex}"
