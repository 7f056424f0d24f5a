"""Training-order materialisation: token sequences at shuffled global slots in fixed-stride binary shards.

Texts become byte tokens (one unsigned byte each, ``END`` after every document; UTF-8 uses neither ``END`` nor
``PAD``), packed into sequences of ``length`` tokens in scan order; the last one of an input partition is padded.
A keyed Feistel permutation of the sequence numbers, with cycle walking down to the exact count, gives every
sequence its slot: a bijection that needs no sort and no shared state. Slots are dealt by range to shards of
``per_shard`` sequences; a shard is one file ``shard-NNNNNNNN.bin`` in which slot s lies at byte
``(s - first slot) * length``. So training reads sequentially from any slot and resumes by its number alone.

Shards are written under another name and then moved; a retried task writes the same bytes. A shard that is there
with the same bytes is not written again, one with other bytes is replaced. Any folder that pyarrow's file systems
open will do.

As for ``zipWithIndex``, sequences are numbered by input partition in two passes, so ``docs`` must be read from
files or a checkpoint; a partition that changed between the passes fails the job. Null and empty texts are
documents of no token (one ``END``). No rows: no sequence, no shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.llm.staging import shared_dir, table
from promolens.llm.words import U, mix, sliced, text_bytes

END, PAD = 0xFF, 0xFE
LENGTH, PER_SHARD, ROUNDS = 2048, 4096, 6


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of the numbers ``x`` below ``n``: a bijection of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(key % 2**64))

    def once(v):
        left, right = v >> U(half), v & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << U(half)) | right

    out = once(np.asarray(x).astype(np.uint64))
    while True:
        outside = out >= U(n)
        if not outside.any():
            return out.astype(np.int64)
        out[outside] = once(out[outside])


def file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def file_crc(files, path: str) -> int:
    crc = 0
    with files.open_input_stream(path) as f:
        while chunk := f.read(1 << 20):
            crc = zlib.crc32(chunk, crc)
    return crc


def shard_path(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:08d}.bin"


def read_slots(root: str, start: int, stop: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The sequences of slots ``start`` to ``stop - 1``, read in order."""
    files, root = file_system(root)
    while start < stop:
        shard, at = divmod(start, per_shard)
        count = min(stop - start, per_shard - at)
        with files.open_input_file(shard_path(root, shard)) as f:
            f.seek(at * length)
            for _ in range(count):
                yield np.frombuffer(f.read(length), np.uint8)
        start += count


def materialise(docs: DataFrame, root: str, key: int = 20240229, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards when computed; a row per sequence: sequence, slot, shard, byte_offset, first_doc_id (of its
    first token), n_tokens (without padding) and crc of its bytes."""
    docs = docs.select("doc_id", "text")
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    counts = docs.groupBy(F.spark_partition_id().alias("part")).agg(size.alias("tokens")).orderBy("part").collect()  # a row per input split
    per_part = {r[0]: -(-r[1] // length) for r in counts}
    first, total = {}, 0
    for part, n in per_part.items():
        first[part] = total
        total += n
    spark = docs.sparkSession
    start = spark.sparkContext.broadcast(first)

    def pack(batches):
        part = TaskContext.get().partitionId()
        number, tokens, owners = start.value.get(part, 0), np.zeros(0, np.uint8), []
        begun = number

        def rows(whole: bool):
            nonlocal tokens, owners, number
            n = -(-len(tokens) // length) if whole else len(tokens) // length
            if not n:
                return None
            ends = np.cumsum([k for _, k in owners])
            ids = [owners[i][0] for i in np.searchsorted(ends, np.arange(n) * length, "right")]
            used = np.full(n * length, PAD, np.uint8)
            used[: len(tokens)] = tokens[: n * length]
            real = np.minimum(length, len(tokens) - np.arange(n) * length)
            blobs = [used[i * length: (i + 1) * length].tobytes() for i in range(n)]
            seq = np.arange(number, number + n)
            slot = permuted(seq, total, key)
            out = pa.record_batch([
                pa.array(seq, pa.int64()), pa.array(slot, pa.int64()), pa.array(slot // per_shard, pa.int64()), pa.array(ids, pa.int64()),
                pa.array(real, pa.int64()), pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array([zlib.compress(b, 1) for b in blobs], pa.binary())],
                names=["sequence", "slot", "shard", "first_doc_id", "n_tokens", "crc", "body"])
            gone = int(np.searchsorted(ends, n * length, "right"))
            left = [(owners[gone][0], int(ends[gone]) - n * length), *owners[gone + 1:]] if gone < len(owners) else []
            tokens, owners, number = tokens[n * length:], left, number + n
            return out

        for batch in batches:
            for a, b in sliced(batch):
                part_rows = batch.slice(a, b - a)
                data, off = text_bytes(part_rows.column("text"))
                tokens = np.concatenate([tokens, np.insert(data, off[1:], END)])
                owners += list(zip(part_rows.column("doc_id").to_pylist(), (np.diff(off) + 1).tolist()))
                if (out := rows(False)) is not None:
                    yield out
        if (out := rows(True)) is not None:
            yield out
        if number - begun != per_part.get(part, 0):
            raise RuntimeError(f"input partition {part} is not what was counted: {number - begun} sequences, {per_part.get(part, 0)} expected")

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by("slot")
        shard = t.column("shard")[0].as_py()
        files, base = file_system(root)
        path = shard_path(base, shard)
        wanted = 0
        for body in t.column("body"):
            wanted = zlib.crc32(zlib.decompress(body.as_py()), wanted)
        if files.get_file_info(path).size != t.num_rows * length or file_crc(files, path) != wanted:
            files.create_dir(base, recursive=True)
            part = f"{path}.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as f:
                for body in t.column("body"):
                    f.write(zlib.decompress(body.as_py()))
            files.move(part, path)
        offset = pa.array((np.asarray(t.column("slot")) - shard * per_shard) * length, pa.int64())
        return t.drop_columns(["body"]).append_column("byte_offset", offset).select(["sequence", "slot", "shard", "byte_offset", "first_doc_id", "n_tokens", "crc"])

    packed = docs.mapInArrow(pack, "sequence long, slot long, shard long, first_doc_id long, n_tokens long, crc long, body binary")
    return packed.groupBy("shard").applyInArrow(write, "sequence long, slot long, shard long, byte_offset long, first_doc_id long, n_tokens long, crc long")


def op1_training_order(spark, base: str) -> DataFrame:
    root = f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}"
    return materialise(table(spark, base, "documents"), root)
