"""Operator 10: token ids as raw binary shards, with a minimal perfect hash index from document keys to their places."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import cut, mix, scratch_path
from auditlake.llm.pieces import MODEL, PieceCoder

GAMMA, BUCKET_KEYS, MAX_LEVELS = 2.0, 16_384, 64
INDEX_SCHEMA = "bucket int, buckets int, n long, levels array<binary>, seeds array<long>, shard array<string>, shard_of binary, offsets binary, lengths binary, prints binary"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def key_hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed], np.uint64)))


class PerfectHash:
    """A minimal perfect hash of int64 keys: in each level keys go to bits of an array; those alone at their bit stay, the others go on. A key's number is its bit's rank."""

    def __init__(self, levels: list[np.ndarray], seeds: list[int]):
        self.levels, self.seeds = levels, seeds
        counts = [int(v.sum()) for v in levels]
        self.base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.ranks = [np.cumsum(v, dtype=np.int64) for v in levels]

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = GAMMA) -> "PerfectHash":
        levels, seeds, left, seed = [], [], keys, 0
        while len(left):
            size = max(8, int(len(left) * gamma))
            at = (key_hash(left, seed) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            if seed > MAX_LEVELS * 16:
                raise ValueError("keys repeat")
            if bits.any():
                levels.append(bits)
                seeds.append(seed)
                left = left[~bits[at]]
            seed += 1
        return cls(levels, seeds)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1, or some other key's number, for keys it wasn't built of."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for i, (bits, seed) in enumerate(zip(self.levels, self.seeds)):
            at = (key_hash(keys[todo], seed) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.base[i] + self.ranks[i][at[hit]] - 1
            todo = todo[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (key_hash(keys, 0x5EED) >> np.uint64(32)).astype(np.uint32)


def write_shards(docs: DataFrame, folder: str, model: str = MODEL) -> DataFrame:
    """Writes each task's texts as ids into a raw little-endian file of the shared folder, and returns (doc_id, shard, offset, n_ids, content); offset in ids, content a hash of them.

    No text or id is shuffled. Ids are of 2 bytes where the vocabulary allows, else of 4. A task's file gets its final name
    only in the rows returned by that attempt, so a lost or repeated attempt leaves an unnamed file and no wrong place.
    """

    def run(batches):
        coder = PieceCoder(model)
        dtype = np.dtype("<u2" if coder.sp.get_piece_size() <= 65_536 else "<u4")
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, at, rows = f"{uuid.uuid4().hex}.u{dtype.itemsize * 8}", 0, []
        sink = None
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                ids = [coder.encode_whole(t or "") for t in part.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                sink = sink or fs.open_output_stream(f"{base}/{name}")
                sink.write(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(dtype).tobytes())
                content = np.array([xxhash.xxh3_64_intdigest(x.astype("<i4").tobytes()) for x in ids], np.uint64).view(np.int64)
                rows.append((part.column(0), n, at + np.cumsum(n) - n, content))
                at += int(n.sum())
        if sink:
            sink.close()
        import pyarrow as pa

        for keys, n, offset, content in rows:
            yield pa.RecordBatch.from_arrays([keys, pa.array([name] * len(n)), pa.array(offset), pa.array(n), pa.array(content)], ["doc_id", "shard", "offset", "n_ids", "content"])

    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(d.mapInArrow(run, "doc_id long, shard string, offset long, n_ids long, content long"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def build_index(places: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """A row for each bucket of keys: its perfect hash and, by the keys' numbers, shard, offset, length and fingerprint.

    The number of buckets follows that of the keys, so a bucket is of one size at any number of them; each row says how many there are. A
    repeated key keeps one place: that of the ids that are first by (hash, number), so the same ids in every run, wherever they lie.
    """
    one = places.groupBy("doc_id").agg(F.min(F.struct("content", "n_ids", "shard", "offset")).alias("p")).select("doc_id", "p.*")
    buckets = max(1, -(-places.count() // bucket_keys))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf.doc_id.to_numpy(np.int64)
        h = PerfectHash.build(keys)
        at = np.empty(len(keys), np.int64)
        at[h(keys)] = np.arange(len(keys))
        names, which = np.unique(pdf.shard.to_numpy(str), return_inverse=True)
        row = {
            "bucket": int(pdf.bucket.iloc[0]), "buckets": buckets, "n": len(keys), "levels": [np.concatenate([np.frombuffer(np.int64(len(v)).tobytes(), np.uint8), np.packbits(v)]).tobytes() for v in h.levels], "seeds": h.seeds,
            "shard": names.tolist(), "shard_of": which[at].astype("<i4").tobytes(), "offsets": pdf.offset.to_numpy(np.int64)[at].tobytes(), "lengths": pdf.n_ids.to_numpy(np.int64)[at].tobytes(), "prints": fingerprint(keys)[at].tobytes(),
        }
        return pd.DataFrame([row])

    return one.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(run, INDEX_SCHEMA)


def write_index(index: DataFrame, folder: str) -> DataFrame:
    """Writes the index beside its shards, in the order of its buckets, and returns it as read from there."""
    index.repartitionByRange(F.col("bucket")).sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{folder}/index")
    return open_index(index.sparkSession, folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


class Bucket:
    """An opened row of the index: constant-time access by key."""

    def __init__(self, row, folder: str):
        bits = [np.unpackbits(np.frombuffer(v, np.uint8)[8:])[: int(np.frombuffer(v[:8], np.int64)[0])].astype(bool) for v in row["levels"]]
        self.hash, self.n, self.shard, self.folder = PerfectHash(bits, list(row["seeds"])), int(row["n"]), list(row["shard"]), folder
        self.shard_of, self.prints = np.frombuffer(row["shard_of"], "<i4"), np.frombuffer(row["prints"], np.uint32)
        self.offsets, self.lengths = np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["lengths"], np.int64)
        self.fs, self.base = _filesystem(folder)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 where the fingerprint tells that a key isn't there."""
        s = self.hash(keys)
        return np.where((s >= 0) & (self.prints[np.maximum(s, 0)] == fingerprint(keys)), s, -1)

    def read(self, slot: int, files: dict | None = None) -> np.ndarray:
        name = self.shard[self.shard_of[slot]]
        dtype = np.dtype(f"<u{int(name.rpartition('.u')[2]) // 8}")
        files = {} if files is None else files
        f = files.get(name) or files.setdefault(name, self.fs.open_input_file(f"{self.base}/{name}"))
        f.seek(int(self.offsets[slot]) * dtype.itemsize)
        return np.frombuffer(f.read(int(self.lengths[slot]) * dtype.itemsize), dtype)


def lookup(spark: SparkSession, folder: str, keys: list[int]) -> dict[int, np.ndarray]:
    """Ids of a few keys, through the index beside the shards: one bucket row, which the scan finds by its number, and one seek for each. Absent keys are left out."""
    index = open_index(spark, folder)
    any_ = index.select("buckets").first()
    if any_ is None or not keys:
        return {}
    where = {r.doc_id: r.b for r in spark.createDataFrame([(int(k),) for k in keys], "doc_id long").select("doc_id", _bucket(any_[0]).alias("b")).collect()}
    out: dict[int, np.ndarray] = {}
    for row in index.where(F.col("bucket").isin(sorted(set(where.values())))).toLocalIterator():
        mine = np.array([k for k, b in where.items() if b == row.bucket], np.int64)
        bucket = Bucket(row.asDict(), folder)
        files: dict = {}
        out |= {int(k): bucket.read(s, files) for k, s in zip(mine, bucket.slots(mine)) if s >= 0}
    return out


def token_index(docs: DataFrame, model: str = MODEL, folder: str | None = None) -> DataFrame:
    """(doc_id, bucket, slot, shard, offset, n_ids, fingerprint, id_sum) for every distinct doc_id, read back through the index.

    Shards and index are written to `folder`, by default a new one in the shared scratch space; every key is then looked up in its
    bucket's perfect hash, its fingerprint compared, and its ids read from the shard and summed. Null and empty texts have 0 ids.
    A repeated doc_id keeps one place, of the same ids in every run; rows without doc_id have no key and are left out. Other columns are never read. An empty table
    gives an empty result.
    """
    folder = folder or scratch_path(docs.sparkSession, "shards")
    places = write_shards(docs, folder, model)
    index = write_index(build_index(places), folder)

    def run(batches):
        for b in batches:
            for row in b.to_dict("records"):
                bucket = Bucket(row, folder)
                keys = np.asarray(row["keys"], np.int64)
                slots = bucket.slots(keys)
                order = np.lexsort((bucket.offsets[slots], bucket.shard_of[slots]))
                files: dict = {}
                sums = np.zeros(len(keys), np.int64)
                for i in order:  # in the order of the shards
                    sums[i] = bucket.read(slots[i], files).sum(dtype=np.int64)
                names = np.array(bucket.shard, object)[bucket.shard_of[slots]]
                yield pd.DataFrame({"doc_id": keys, "bucket": row["bucket"], "slot": slots, "shard": names, "offset": bucket.offsets[slots], "n_ids": bucket.lengths[slots], "fingerprint": bucket.prints[slots].astype(np.int64), "id_sum": sums})

    buckets = max(1, -(-places.count() // BUCKET_KEYS))
    keys = places.select("doc_id").distinct().withColumn("bucket", _bucket(buckets)).groupBy("bucket").agg(F.sort_array(F.collect_list("doc_id")).alias("keys"))
    return index.join(keys, "bucket").mapInPandas(run, "doc_id long, bucket int, slot long, shard string, offset long, n_ids long, fingerprint long, id_sum long")
