"""Files of token ids with Elias-Fano document boundaries.

A shard holds the ids of neighbouring documents, in ascending doc_id order, one after the
other, then two non-decreasing sequences in Elias-Fano form: where each document's ids end,
and the doc_ids. A sequence of n values below u takes about n * (2 + log2(u / n)) bits, plus
32 bits for every 1024th value, from which any value is selected without a table of offsets.

    magic | ids, 2 or 4 bytes each | ends: low, high, samples | doc_ids: low, high, samples
    | footer of fixed size
"""

from __future__ import annotations

import struct
import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.frames import running_start, shuffle_partitions, store, text_column
from postloom.llm.tokens import id_batches
from postloom.session import shared_folder

END_ID = 1
MAGIC = b"PLTOKEF1"
# id bytes, documents, NULL doc_ids, ids, smallest doc_id; low bits and high bytes of both
FOOTER = "<4Qq4Q8s"
FOOTER_BYTES = struct.calcsize(FOOTER)
SHARD_IDS = 4 * 1024 * 1024
SAMPLE = 1024
SHARDS_PER_PARTITION = 1 << 24


class EliasFano(NamedTuple):
    """A non-decreasing sequence of non-negative values."""

    count: int
    low_bits: int
    low: np.ndarray  # bytes, low_bits per value
    high: np.ndarray  # bytes, one set bit per value
    samples: np.ndarray  # place of the set bit of every SAMPLE-th value

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = np.arange(bits, dtype=np.uint64)
        low = np.packbits(
            ((values[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(),
            bitorder="little",
        )
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    @staticmethod
    def sizes(count: int, low_bits: int, high_bytes: int) -> tuple[int, int, int]:
        return -(-count * low_bits // 8), high_bytes, 4 * -(-count // SAMPLE)

    def select(self, first: int, last: int) -> np.ndarray:
        """Values number ``first`` to ``last`` - 1, starting at the sample before them."""
        if last <= first:
            return np.empty(0, np.int64)
        begin = int(self.samples[first // SAMPLE])
        skip = first % SAMPLE
        ahead = -(-last // SAMPLE)
        stop = int(self.samples[ahead]) + 1 if ahead < len(self.samples) else len(self.high) * 8
        part = np.unpackbits(self.high[begin // 8 : -(-stop // 8)], bitorder="little")
        part[: begin % 8] = 0
        ones = np.flatnonzero(part)[skip : skip + last - first] + begin // 8 * 8
        value = (ones - np.arange(first, last)) << self.low_bits
        if self.low_bits:
            a, b = first * self.low_bits, last * self.low_bits
            bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")
            bits = bits[a % 8 : a % 8 + b - a].reshape(-1, self.low_bits)
            value += bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return value


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        fs.LocalFileSystem(),
        folder,
    )


class Shard:
    """Reads one file: any run of its documents, by selecting their boundaries."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER_BYTES)
        found = struct.unpack(FOOTER, file.read(FOOTER_BYTES))
        self.width, self.docs, self.nulls, self.ids, self.least = found[:5]
        if found[9] != MAGIC:
            raise ValueError("not a whole token file")
        counts = (self.docs, self.docs - self.nulls)
        parts = [EliasFano.sizes(n, *found[5 + 2 * k : 7 + 2 * k]) for k, n in enumerate(counts)]
        file.seek(size - FOOTER_BYTES - sum(map(sum, parts)))
        self.ends, self.doc_ids = (
            EliasFano(
                n,
                found[5 + 2 * k],
                *(np.frombuffer(file.read(b), t) for b, t in zip(parts[k], ("u1", "u1", "<u4"))),
            )
            for k, n in enumerate(counts)
        )

    def documents(self, first: int, last: int):
        """(doc_ids with None, begins and ends in this shard, ids) of a run of documents."""
        ends = self.ends.select(first, last)
        begin = int(self.ends.select(first - 1, first)[0]) if first else 0
        begins = np.concatenate([[begin], ends[:-1]])
        nulls = max(0, min(last, self.nulls) - first)
        known = self.doc_ids.select(first + nulls - self.nulls, last - self.nulls)
        doc_ids = [None] * nulls + (known + self.least).tolist()
        self.file.seek(len(MAGIC) + begin * self.width)
        raw = self.file.read((int(ends[-1]) - begin) * self.width)
        return doc_ids, begins, ends, np.frombuffer(raw, f"<u{self.width}")


class ShardWriter:
    def __init__(self, folder: str, width: int):
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        # a name of its own for each attempt: only files named in the committed list count
        self.name = f"{uuid.uuid4().hex}.ids"
        self.out = system.open_output_stream(f"{path}/{self.name}")
        self.out.write(MAGIC)
        self.width, self.ids = width, 0
        self.doc_ids: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.nulls = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, begins: np.ndarray) -> None:
        self.nulls += doc_ids.null_count
        self.doc_ids.append(doc_ids.drop_null().to_numpy(zero_copy_only=False))
        self.ends.append(self.ids + begins[1:] - begins[0])
        part = ids[begins[0] : begins[-1]]
        self.out.write(np.ascontiguousarray(part, f"<u{self.width}").tobytes())
        self.ids += len(part)

    def close(self) -> tuple[str, int, int]:
        doc_ids = np.concatenate(self.doc_ids)
        least = int(doc_ids[0]) if len(doc_ids) else 0
        ends = EliasFano.of(np.concatenate(self.ends))
        names = EliasFano.of(doc_ids - least)
        for x in (ends, names):
            for part in (x.low, x.high, x.samples):
                self.out.write(part.tobytes())
        self.out.write(
            struct.pack(
                FOOTER, self.width, ends.count, self.nulls, self.ids, least,
                ends.low_bits, len(ends.high), names.low_bits, len(names.high), MAGIC,
            )
        )
        self.out.close()
        return self.name, ends.count, self.ids


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, vocabulary: int) -> DataFrame:
    """Writes shards in ascending doc_id order; returns the committed list of them.

    Texts are dealt by ranges of (doc_id, hash of the text), so one repeated doc_id spreads,
    and go through the tokenizer once. ``vocabulary`` is the number of ids, for their width.
    The list has shard (ascending), file, docs, ids, and start: the ids before the shard.
    """
    width = 2 if vocabulary <= 1 << 16 else 4
    order = ["doc_id", "_text_hash", "_row"]
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs))
        .withColumn("_text_hash", F.xxhash64("text"))
        .withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )

    def write(batches):
        first = TaskContext.get().partitionId() * SHARDS_PER_PARTITION
        done, writer = [], None
        for part, ids, begins in id_batches(tokenizer, END_ID)(batches):
            column = part.column("doc_id")
            at = 0
            while at < len(column):
                writer = writer or ShardWriter(folder, width)
                # as many documents as the shard has room for, one at least
                room = begins[at] + SHARD_IDS - writer.ids
                stop = max(at + 1, int(np.searchsorted(begins, room, "right")) - 1)
                writer.add(column.slice(at, stop - at), ids, begins[at : stop + 1])
                at = stop
                if writer.ids >= SHARD_IDS or at < len(column):
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            names, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(first, first + len(done)), pa.int64()),
                    pa.array(names),
                    pa.array(counts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                ],
                names=["shard", "file", "docs", "ids"],
            )

    listed = rows.mapInArrow(write, "shard long, file string, docs long, ids long")
    return running_start(store(listed, "shards"), "shard", "ids", "start")


def read_token_files(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def read(batches):
        system, path = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{path}/{row['file']}") as file:
                    shard = Shard(file)
                    for first in range(0, shard.docs, SAMPLE):
                        last = min(first + SAMPLE, shard.docs)
                        doc_ids, begins, ends, ids = shard.documents(first, last)
                        data = memoryview(ids.astype("<u4")).cast("B")
                        at = ((begins - begins[0]) * 4).tolist()
                        to = ((ends - begins[0]) * 4).tolist()
                        crc = [zlib.crc32(data[a:b]) for a, b in zip(at, to)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(doc_ids, pa.int64()),
                                pa.array(row["start"] + begins),
                                pa.array(ends - begins),
                                pa.array(crc, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    dealt = shards.repartition(shuffle_partitions(spark), "file")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, tokenizer: str, vocabulary: int) -> DataFrame:
    """Writes ``docs`` to token files in the shared folder and describes what is read back.

    ``docs`` needs doc_id and text; other columns are ignored. NULL text is empty and has the
    end id alone. NULL doc_ids come first; rows of one doc_id keep one place each, ordered by
    a hash of the text. An empty table makes no file and gives no rows. A text of any length
    stays in one file; memory is that of the longest text.
    """
    folder = shared_folder(docs.sparkSession, "tokens")
    shards = store(write_token_files(docs, tokenizer, folder, vocabulary), "shard-starts")
    return read_token_files(docs.sparkSession, folder, shards)
