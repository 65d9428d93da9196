"""Training-order materialisation: token ids in fixed-stride shards, ordered by a keyed Feistel permutation.

Every document is tokenised whole and cut into sequences of ``LENGTH`` tokens, the last one padded.  A document owns as
many indices as its bytes could fill sequences (a byte-level vocabulary never makes more tokens than bytes, plus the end
token); so the domain is known from text lengths alone and texts are tokenised once.  A Feistel network keyed by the seed
permutes the domain, cycle-walking back into it, and gives each sequence its global slot.  Slot ranges are the partitions;
each is sorted and written as a shard of fixed-stride records.  As not every index is used, slots have gaps: the manifest
of records per shard turns a position of the training order into a shard and a byte offset, which is all a reader needs
to go on where it stopped.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import shared_dir, written
from .textscan import mix64

LENGTH = 256
END_TOKEN = 50256
#: Text bytes per shard, about: each is read by one task in bounded memory.
SHARD_TEXT_BYTES = 20 << 20
#: Sequences that wait for a record batch, and records read at a time: 4 and 8 MB.
BATCH_SEQUENCES, READ_RECORDS = 8_192, 8_192
ROUNDS = 6

RECORD = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("seq_no", "<i4"), ("n_tokens", "<i4"),
                   ("tokens", "<u2", (LENGTH,))])
NO_ID = np.iinfo(np.int64).min

_ENCODER = {}


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The byte-level BPE of the vocabulary file; one per worker process."""
    if path not in _ENCODER:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODER[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                           special_tokens={})
    return _ENCODER[path]


def feistel(index: np.ndarray, domain: int, seed: int) -> np.ndarray:
    """A permutation of range(domain), applied to ``index``: balanced rounds, walked until inside the domain."""
    half = max(1, (max(domain - 1, 1).bit_length() + 1) // 2)
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    with np.errstate(over="ignore"):
        keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

        def once(x):
            left, right = x >> width, x & mask
            for key in keys:
                left, right = right, left ^ (mix64(right + key) & mask)
            return (left << width) | right

        out = once(index.astype(np.uint64))
        while (beyond := out >= domain).any():
            out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def capacity(octets: int) -> int:
    """Most sequences a text of so many bytes can give: one token a byte and the end token."""
    return octets // LENGTH + 1


def sequences(docs: DataFrame, path: str, seed: int) -> tuple[DataFrame, int, int]:
    """(shard, slot, doc_id, seq_no, tokens) of all sequences, the domain and the number of shards.

    Both passes read the same partitions of ``docs``, a table scan; that they do is checked.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    parts = rows.groupBy(F.spark_partition_id().alias("p")).agg(
        F.sum(F.floor(size / LENGTH) + 1).cast("long").alias("c"), F.sum(size).cast("long").alias("b")) \
        .orderBy("p").collect()  # a row per partition
    offsets, domain = {}, 0
    for r in parts:
        offsets[r["p"]] = (domain, r["c"])
        domain += r["c"]
    shards = max(1, sum(r["b"] for r in parts) // SHARD_TEXT_BYTES)
    shared = docs.sparkSession.sparkContext.broadcast(offsets)

    def run(batches):
        at, end = None, None
        for batch in batches:
            if at is None and batch.num_rows:
                at, count = shared.value[TaskContext.get().partitionId()]
                end = at + count
            encode = encoder(path).encode_to_numpy
            made, waiting = [], 0
            for doc, text in zip(batch.column(0).fill_null(NO_ID).to_numpy().tolist(), batch.column(1)):
                text = text.as_py() or ""
                tokens = encode(text, disallowed_special=())
                padded = np.zeros((len(tokens) // LENGTH + 1, LENGTH), "<u2")
                padded.reshape(-1)[:len(tokens)] = tokens
                padded.reshape(-1)[len(tokens)] = END_TOKEN
                made.append((doc, at, len(tokens) + 1, padded))
                at += capacity(len(text.encode()))
                waiting += len(padded)
                if waiting >= BATCH_SEQUENCES:
                    yield packed(made)
                    made, waiting = [], 0
            if made:
                yield packed(made)
        if at != end:
            raise RuntimeError("docs was read in other partitions than counted; write it as a table first")

    def packed(made):
        doc, at, size = (np.array(x, np.int64) for x in list(zip(*made))[:3])
        count = np.array([len(m[3]) for m in made])
        no = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        slot = feistel(np.repeat(at, count) + no, domain, seed)
        if domain * shards < 2**63:
            shard = slot * shards // domain
        else:
            shard = np.array([int(s) * shards // domain for s in slot])
        blob = np.concatenate([m[3] for m in made])
        blobs = pa.Array.from_buffers(pa.binary(), len(no), [
            None, pa.py_buffer(np.arange(len(no) + 1, dtype=np.int32) * (2 * LENGTH)), pa.py_buffer(blob)])
        return pa.record_batch([pa.array(shard.astype(np.int32)), pa.array(slot), pa.array(np.repeat(doc, count)),
                                pa.array(no.astype(np.int32)), pa.array(np.minimum(np.repeat(size, count) - no * LENGTH, LENGTH).astype(np.int32)),
                                blobs], names=["shard", "slot", "doc_id", "seq_no", "n_tokens", "tokens"])

    return rows.mapInArrow(run, "shard int, slot long, doc_id long, seq_no int, n_tokens int, tokens binary"), domain, shards


def write_shards(docs: DataFrame, folder: str, path: str | None = None, seed: int = 1) -> DataFrame:
    """Write the shards below ``folder`` (a URI); returns the manifest (shard, file, records, start).

    ``start`` is the position of a shard's first record in the training order.  Null texts are empty: one sequence
    with the end token.  A null id is written as the smallest long.  Rows that repeat give sequences each.  Files of
    attempts that failed are not in the manifest.
    """
    found, _, shards = sequences(docs, path or vocabulary_path(), seed)

    def run(batches):
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(folder)
        sink, shard, done = None, None, []
        for batch in batches:
            column = {n: batch.column(n).to_numpy() for n in ("shard", "slot", "doc_id", "seq_no", "n_tokens")}
            out = np.zeros(batch.num_rows, RECORD)
            for n in ("slot", "doc_id", "seq_no", "n_tokens"):
                out[n] = column[n]
            blob = batch.column("tokens")
            first = blob.offset * LENGTH  # all records are of one length
            out["tokens"] = np.frombuffer(blob.buffers()[2], "<u2")[first:first + batch.num_rows * LENGTH].reshape(-1, LENGTH)
            cuts = np.flatnonzero(np.diff(column["shard"], prepend=-1 if shard is None else shard))
            bounds = np.unique([0, *cuts, batch.num_rows]).tolist()
            for a, b in zip(bounds, bounds[1:]):
                if a in cuts:
                    if sink is not None:
                        sink.close()
                    shard = int(column["shard"][a])
                    name = f"shard-{shard:07d}-{TaskContext.get().taskAttemptId()}.bin"
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(f"{base}/{name}")
                    done.append([shard, name, 0])
                sink.write(out[a:b].tobytes())
                done[-1][2] += b - a
        if sink is not None:
            sink.close()
            yield pa.record_batch([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done]),
                                   pa.array([d[2] for d in done], pa.int64())], names=["shard", "file", "records"])

    made = found.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot", "doc_id", "seq_no") \
        .mapInArrow(run, "shard int, file string, records long")
    made = written(made, "token-manifest")
    before = F.sum("records").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return made.withColumn("start", F.coalesce(before, F.lit(0)))


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """position, slot, shard, doc_id, seq_no, n_tokens, checksum (crc32 of the ids) of every record.

    Tasks read ranges of records by seeking, ``READ_RECORDS`` at a time.
    """
    ranges = manifest.select("shard", "file", "start", "records",
                             F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(READ_RECORDS).cast("long"))).alias("skip"))

    def run(batches):
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                take = min(READ_RECORDS, row["records"] - row["skip"])
                with store.open_input_file(f"{base}/{row['file']}") as f:
                    f.seek(row["skip"] * RECORD.itemsize)
                    part = np.frombuffer(f.read(take * RECORD.itemsize), RECORD)
                n = part["n_tokens"]
                crc = [zlib.crc32(t[:k]) for t, k in zip(part["tokens"], n.tolist())]
                yield pa.record_batch([
                    pa.array(row["start"] + row["skip"] + np.arange(len(part))), pa.array(np.ascontiguousarray(part["slot"])),
                    pa.array(np.full(len(part), row["shard"], np.int32)),
                    pa.array(np.ascontiguousarray(part["doc_id"]), mask=part["doc_id"] == NO_ID),
                    pa.array(np.ascontiguousarray(part["seq_no"])), pa.array(np.ascontiguousarray(n)),
                    pa.array(crc, pa.int64())],
                    names=["position", "slot", "shard", "doc_id", "seq_no", "n_tokens", "checksum"])

    # a task per shard: the rows of the manifest are too small to be dealt out by their size
    return ranges.repartitionById(manifest.agg(F.max("shard")).first()[0] + 1, F.col("shard")).mapInArrow(
        run, "position long, slot long, shard int, doc_id long, seq_no int, n_tokens int, checksum long")


def read_from(folder: str, manifest: list, position: int, limit: int):
    """Token arrays of ``limit`` sequences from a position of the training order on, by seeking; manifest: its rows."""
    from pyarrow import fs
    store, base = fs.FileSystem.from_uri(folder)
    for row in sorted(manifest, key=lambda r: r["start"]):
        skip = max(0, position - row["start"])
        if skip >= row["records"] or limit <= 0:
            continue
        take = min(limit, row["records"] - skip)
        with store.open_input_file(f"{base}/{row['file']}") as f:
            f.seek(skip * RECORD.itemsize)
            for one in np.frombuffer(f.read(take * RECORD.itemsize), RECORD):
                yield one["tokens"][:one["n_tokens"]]
        limit -= take


def materialised(docs: DataFrame, path: str | None = None, seed: int = 1) -> DataFrame:
    """Write all documents in training order to the shared folder and read the shards back: one row per sequence."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    manifest = write_shards(docs, folder, path, seed)
    if manifest.isEmpty():
        return spark.createDataFrame(
            [], "position long, slot long, shard int, doc_id long, seq_no int, n_tokens int, checksum long")
    return read_shards(spark, folder, manifest)
