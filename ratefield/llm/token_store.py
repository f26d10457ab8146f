"""Token ids in shard files, with a minimal perfect hash index from document keys to their places."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratefield.llm.common import Scratch, documents, mix64, range_bounds, range_bucket, shuffle_partitions, small_batches, task
from ratefield.llm.packing import _default_tokenizer
from ratefield.llm.tokens import encoder

#: Mean number of keys of an index file; a file is built and held whole by one task.
KEYS = 20_000
END = 0
_MAGIC = b"MPHINDEX"
_SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4")])


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors reach, and its path there."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" in folder:
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


class _Output:
    """A file that appears under its name only when complete, so that a task can be run again or twice."""

    def __init__(self, folder: str, name: str):
        self.fs, path = _file_system(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.part = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.part)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.path)


def _write(folder: str, tokenizer: str, width: int):
    """Rows come by shard and key: write each shard's ids, and give each row's place, and whether it is its key's first."""

    def run(batches):
        ids, shard, out, at, before = encoder(tokenizer).ids, None, None, 0, None
        for batch in batches:
            offsets, counts, firsts = [], [], []
            for p, key, text in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if p != shard:
                    if out:
                        out.close()
                    shard, at, out, before = p, 0, _Output(folder, f"shard-{p:06d}.ids"), None
                firsts.append(key is not None and key != before)
                before = key
                data = np.append(np.frombuffer(ids(text), "<u4"), np.uint32(END))
                out.stream.write(data.astype(f"<u{width}").tobytes())
                offsets.append(at)
                counts.append(len(data))
                at += len(data)
            yield pa.record_batch([batch.column("doc_id"), batch.column("shard"), pa.array(offsets, pa.int64()), pa.array(counts, pa.int64()), pa.array(firsts, pa.bool_())], ["doc_id", "shard", "at", "n", "first"])
        if out:
            out.close()

    return run


# The index: keys are hashed into buckets of a bounded mean size; each bucket's file holds a minimal perfect hash by
# cascaded bit arrays (a key settles in the first array where no other key shares its bit; Limasset et al., 2017),
# then a slot per key: fingerprint, shard, offset and number of ids.


def _key_hash(keys: np.ndarray, salt: int) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1)))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_key_hash(keys, 1_000_003) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Maps n keys onto 0 .. n-1; other keys get some number or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # a bool array each
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits) - bits)
            before += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys.astype(np.int64))
        while len(left):
            size = max(64, 2 * len(left))
            place = (_key_hash(left, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(place, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[place]]
        return cls(levels)

    def places(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for i, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            place = (_key_hash(keys, i) % np.uint64(len(bits))).astype(np.int64)
            here = (out < 0) & bits[place]
            out[here] = ranks[place[here]]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, int]:
        k = int(np.frombuffer(data, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<u4", k, 4).tolist(), 4 * (k + 1), []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels), at


def index_bytes(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, n: np.ndarray) -> bytes:
    """An index file's bytes. Of rows with equal keys the first in the payload is indexed."""
    order = np.lexsort((offset, shard, keys))
    keys, shard, offset, n = keys[order], shard[order], offset[order], n[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    keys, shard, offset, n = keys[first], shard[first], offset[first], n[first]
    hashed = PerfectHash.build(keys)
    slots = np.zeros(len(keys), _SLOT)
    place = hashed.places(keys)
    slots["fingerprint"][place], slots["shard"][place], slots["offset"][place], slots["n"][place] = fingerprints(keys), shard, offset, n
    return _MAGIC + hashed.dump() + slots.tobytes()


class IndexFile:
    """An index file, read whole; a look-up takes the same few steps for any number of keys."""

    def __init__(self, data: bytes):
        if data[: len(_MAGIC)] != _MAGIC:
            raise ValueError("not an index file")
        self.hash, at = PerfectHash.load(data[len(_MAGIC) :])
        self.slots = np.frombuffer(data, _SLOT, offset=len(_MAGIC) + at)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of keys, and whether each key is there (by its fingerprint; a foreign key passes once in 2**32 times)."""
        if not len(self.slots):
            return np.zeros(len(keys), _SLOT), np.zeros(len(keys), bool)
        place = self.hash.places(keys)
        slots = self.slots[np.maximum(place, 0)]
        return slots, (place >= 0) & (slots["fingerprint"] == fingerprints(keys))


def _runs(values: np.ndarray):
    """Begin and end of each run of equal values."""
    cut = np.flatnonzero(np.diff(values)) + 1
    return zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]]), strict=True) if len(values) else ()


def _build(folder: str):
    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            t = pa.Table.from_batches(held)
            bucket, n = t["bucket"][0].as_py(), t.num_rows
            out = _Output(folder, f"index-{bucket:06d}.mph")
            out.stream.write(index_bytes(*(t[c].to_numpy() for c in ("doc_id", "shard", "at", "n"))))
            out.close()
            held.clear()
            return pa.record_batch([pa.array([bucket], pa.int64()), pa.array([n], pa.int64())], ["bucket", "keys"])

        for batch in batches:
            for a, b in _runs(batch.column("bucket").to_numpy()):
                part = batch.slice(a, b - a)
                if held and held[0].column("bucket")[0] != part.column("bucket")[0]:
                    yield done()
                held.append(part)
        if held:
            yield done()

    return run


def _look_up(folder: str):
    def run(batches):
        fs, path = _file_system(folder)
        bucket, index = None, None
        for batch in batches:
            for a, b in _runs(batch.column("bucket").to_numpy()):
                part = batch.slice(a, b - a)
                if part.column("bucket")[0].as_py() != bucket:
                    bucket = part.column("bucket")[0].as_py()
                    name = f"{path}/index-{bucket:06d}.mph"
                    found = fs.get_file_info(name).type == pafs.FileType.File
                    index = IndexFile(fs.open_input_stream(name).read() if found else index_bytes(*[np.zeros(0, np.int64)] * 4))
                slots, there = index.find(part.column("doc_id").to_numpy())
                slots = slots[there]
                yield pa.record_batch([part.column("doc_id").filter(pa.array(there)), *(pa.array(slots[c].astype(np.int64)) for c in ("shard", "offset", "n"))], ["doc_id", "shard", "at", "n"])

    return run


def _read(folder: str, width: int):
    def run(batches):
        fs, path = _file_system(folder)
        shard, file = None, None
        for batch in batches:
            out = []
            for p, at, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "at", "n")), strict=True):
                if p != shard:
                    shard, file = p, fs.open_input_file(f"{path}/shard-{p:06d}.ids")
                file.seek(at * width)
                out.append(np.frombuffer(file.read(n * width), f"<u{width}").astype("<u4").tobytes())
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "shard", "at", "n", "ids"])

    return run


def _checked(read):
    def run(batches):
        for batch in read(batches):
            crcs = [zlib.crc32(x.as_buffer()) for x in batch.column("ids")]
            yield pa.record_batch([*batch.columns[:4], pa.array(crcs, pa.int64())], ["doc_id", "shard", "at", "n", "ids_crc32"])

    return run


class TokenStore:
    """Shard files of raw ids in ascending key order, and the index files over them, in a shared folder.

    `shards` tells each shard's number of ids and of those before it; `others` the places of rows that no key leads to.
    """

    def __init__(self, spark, folder: str, buckets: int, width: int, shards: DataFrame, others: DataFrame):
        self.spark, self.folder, self.buckets, self.width, self.shards, self.others = spark, folder, buckets, width, shards, others

    @staticmethod
    def bucket(key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("long")

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> TokenStore:
        """Encode docs (doc_id, text), append the end id 0 to each, and write all ids by doc_id.

        Shards are ranges of doc_id; ids take two bytes where the vocabulary allows it. Null and empty texts give the
        end id alone. Rows with equal doc_ids are all written, by their texts' hashes, and the first is indexed; null
        doc_ids come first and are written but not indexed: `others` has the places of these and of further rows of a
        key. Long texts are encoded whole; no rows give an empty store; other columns of docs don't matter.
        """
        spark, tokenizer = docs.sparkSession, tokenizer or _default_tokenizer()
        small_batches(spark)
        scratch = Scratch(spark, "tokens")
        folder = folder or f"{scratch.path}/store"
        width = 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else 4
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        parts = shuffle_partitions(spark)
        bounds = range_bounds(docs, "doc_id", parts)
        ranged = docs.select("doc_id", range_bucket(F.col("doc_id"), bounds).cast("long").alias("shard"), "text")
        ranged = ranged.repartition(parts, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        rows = scratch.table(ranged.mapInArrow(task(_write(folder, tokenizer, width), "encoder"), "doc_id long, shard long, at long, n long, first boolean"), "rows")
        shards = rows.groupBy("shard").agg(F.sum("n").alias("ids"))
        shards = scratch.table(shards.select("shard", "ids", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before")), "shards")
        keyed = rows.filter("first").drop("first")
        buckets = max(1, -(-keyed.count() // KEYS))
        keyed = keyed.withColumn("bucket", cls.bucket(F.col("doc_id"), buckets)).repartition(min(parts, buckets), "bucket").sortWithinPartitions("bucket")
        scratch.table(keyed.mapInArrow(task(_build(folder)), "bucket long, keys long"), "index")
        return cls(spark, folder, buckets, width, shards, rows.filter("not first").drop("first"))

    def find(self, keys: DataFrame) -> DataFrame:
        """Places of keys (a doc_id column) by the index: doc_id, shard, at and n (ids); keys that it lacks give no row."""
        keys = keys.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").withColumn("bucket", self.bucket(F.col("doc_id"), self.buckets))
        keys = keys.repartition(min(shuffle_partitions(self.spark), self.buckets), "bucket").sortWithinPartitions("bucket")
        return keys.mapInArrow(task(_look_up(self.folder)), "doc_id long, shard long, at long, n long")

    def _by_place(self, places: DataFrame) -> DataFrame:
        return places.repartition(shuffle_partitions(self.spark), "shard").sortWithinPartitions("shard", "at")

    def get(self, keys: DataFrame) -> DataFrame:
        """The ids of keys: doc_id, shard, at, n and ids (little-endian uint32)."""
        return self._by_place(self.find(keys)).mapInArrow(task(_read(self.folder, self.width)), "doc_id long, shard long, at long, n long, ids binary")

    def digests(self, places: DataFrame) -> DataFrame:
        """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of what lies at places (as find and others give them), read from the files."""
        read = self._by_place(places).mapInArrow(task(_checked(_read(self.folder, self.width))), "doc_id long, shard long, at long, n long, ids_crc32 long")
        out = read.join(self.shards.select("shard", "before"), "shard")
        return out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")


def digest_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """A row per document of a store of docs: by its key through the index, or by its place where no key leads to it."""
    store = TokenStore.write(docs, folder=folder)
    return store.digests(store.find(docs.select("doc_id").distinct()).unionByName(store.others))


def query(spark, sf_dir: str) -> DataFrame:
    return digest_documents(documents(spark, sf_dir))
