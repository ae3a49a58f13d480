"""Token ids in binary shards: blocks of ids transposed to planes, each plane compressed.

Shard file: a header line, the blocks in order, a footer, and a tail of fixed size; every part
is followed by one line feed, since Spark's text writer puts the bytes on the shared store.
A block holds a fixed number of ids (the last one fewer).  Its ids are transposed into four
byte planes or 32 bit planes, each plane compressed by zstandard.  The footer is the chunk
index (offset, length and number of ids of each block) and the table of documents (id, number
of ids); a reader finds it from the tail.  Documents are in ascending id order across the
shards, whose numbers are in their file names.

Results: a null or empty text holds only the end id; null ids sort first; repeated rows are
kept, each with its own start; an empty table writes no shard and reads back as no row.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulseframe.llm.common import Memo, prepare, shared_path, text_or_empty

MAGIC = b"PLANES01"
TAIL = struct.Struct("<QQ8s")  # length of the footer, number of ids, magic
BLOCK = struct.Struct("<IBB")  # ids, planes, bytes an id
BLOCK_IDS = 1 << 16
BIT, BYTE = 32, 4


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """Byte planes, lowest first, or bit planes of little-endian 32-bit ids."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == BYTE:
        return [rows[:, i].tobytes() for i in range(BYTE)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(BIT)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == BYTE:
        rows = np.stack([np.frombuffer(p, np.uint8, n) for p in parts], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in parts], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").ravel()


def pack_block(ids: np.ndarray, planes: int = BYTE, level: int = 3) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=level)
    parts = [squeeze.compress(p) for p in to_planes(ids, planes)]
    return b"".join([BLOCK.pack(len(ids), planes, 4), struct.pack(f"<{planes}I", *map(len, parts)), *parts])


def unpack_block(data: bytes) -> np.ndarray:
    n, planes, _ = BLOCK.unpack_from(data)
    lengths = struct.unpack_from(f"<{planes}I", data, BLOCK.size)
    at, parts, expand = BLOCK.size + 4 * planes, [], zstandard.ZstdDecompressor()
    for length in lengths:
        parts.append(expand.decompress(data[at:at + length]))
        at += length
    return from_planes(parts, n)


def pack_footer(blocks: list[tuple[int, int, int]], docs: list[tuple[int, bool, int]]) -> bytes:
    table = np.array(blocks, "<i8").reshape(-1, 3).tobytes()
    keys = np.array([d[0] for d in docs], "<i8").tobytes()
    null = np.packbits(np.array([d[1] for d in docs], bool)).tobytes()
    sizes = np.array([d[2] for d in docs], "<i8").tobytes()
    return zstandard.compress(struct.pack("<QQ", len(blocks), len(docs)) + table + keys + null + sizes)


class Shard:
    """A whole shard file in memory, read through its chunk index."""

    def __init__(self, content: bytes):
        content = memoryview(content)
        end = len(content) - 1 - TAIL.size
        length, self.n_ids, magic = TAIL.unpack_from(content, end)
        if magic != MAGIC or bytes(content[:8]) != MAGIC:
            raise ValueError("not a shard of token planes")
        body = zstandard.decompress(content[end - 1 - length:end - 1])
        n, m = struct.unpack_from("<QQ", body)
        at = 16
        self.blocks = np.frombuffer(body, "<i8", 3 * n, at).reshape(-1, 3)
        at += 24 * n
        self.keys = np.frombuffer(body, "<i8", m, at)
        at += 8 * m
        self.null = np.unpackbits(np.frombuffer(body, np.uint8, (m + 7) // 8, at), count=m).astype(bool)
        self.sizes = np.frombuffer(body, "<i8", m, at + (m + 7) // 8)
        self.content = content

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, first position in the shard, ids of each document; one block is unpacked at a time."""
        waiting, have, start = [], 0, 0
        blocks = iter(self.blocks.tolist())
        for key, null, size in zip(self.keys.tolist(), self.null.tolist(), self.sizes.tolist()):
            while have < size:
                offset, length, n = next(blocks)
                waiting.append(unpack_block(self.content[offset:offset + length]))
                have += n
            joined = waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
            yield (None if null else key), start, joined[:size]
            waiting, have, start = [joined[size:]], have - size, start + size


class LibraryCoder:
    """Whole texts encoded by the tokenizers library, which sees each distinct word of a worker once.

    With byte-level pre-tokenization no token crosses a single space between two words, so a
    text's ids are those of its words, each with the space before it.  New words are encoded
    many at a time as one text; a token that holds the space begins a word.  Texts with other
    white space around a space go through the library whole.
    """

    SPACE = "Ġ"  # the vocabulary's letter for the space

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.begins = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.begins[i] = token.startswith(self.SPACE)
        self.words = Memo(self.code_words, limit=200_000)
        self.first = Memo(lambda words: [None if odd(w) else ids for w, ids in zip(words, self.code(words))], limit=50_000)

    def code(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def code_words(self, words: list[str]) -> list[bytes | None]:
        """Ids of each word after a space; None for words that white space begins or ends."""
        odd_at = [i for i, w in enumerate(words) if not w or w != w.strip()]
        plain = words
        if odd_at:
            skipped = set(odd_at)
            plain = [w for i, w in enumerate(words) if i not in skipped]
        runs = [plain[i:i + 256] for i in range(0, len(plain), 256)]
        out: list[bytes | None] = []
        for run, ids in zip(runs, self.code([" " + " ".join(run) for run in runs])):
            cuts = (4 * np.flatnonzero(self.begins[np.frombuffer(ids, "<u4")])).tolist()
            if len(cuts) != len(run):
                raise ValueError("the vocabulary does not begin words with a space")
            out += [ids[a:b] for a, b in zip(cuts, [*cuts[1:], len(ids)])]
        for i in odd_at:
            out.insert(i, None)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        words = iter(self.words.values([w for s in split for w in s[1:]]))
        firsts = self.first.values([s[0] for s in split])
        out = []
        for text, first, s in zip(texts, firsts, split):
            ids = [first, *islice(words, len(s) - 1)]
            if not text:
                out.append(b"")
            else:
                out.append(self.code([text])[0] if None in ids else b"".join(ids))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def odd(word: str) -> bool:
    return not word or word[0].isspace() or word[-1].isspace()


def some_texts(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` letters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


@lru_cache(maxsize=4)
def load(path: str) -> LibraryCoder:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return LibraryCoder(path)


def shard_rows(documents: Iterator[tuple[int | None, bytes]], planes: int, block_ids: int) -> Iterator[bytes]:
    """The parts of one shard, from documents' ids in order; at most one block and one document are held."""
    yield MAGIC
    offset, blocks, docs, buffer, total = len(MAGIC) + 1, [], [], bytearray(), 0
    for key, ids in documents:
        docs.append((key or 0, key is None, len(ids) // 4))
        buffer += ids
        done = 0
        while len(buffer) - done >= 4 * block_ids:
            part = pack_block(np.frombuffer(bytes(buffer[done:done + 4 * block_ids]), "<u4"), planes)
            blocks.append((offset, len(part), block_ids))
            offset, total, done = offset + len(part) + 1, total + block_ids, done + 4 * block_ids
            yield part
        if done:
            del buffer[:done]
    if buffer:
        part = pack_block(np.frombuffer(bytes(buffer), "<u4"), planes)
        blocks.append((offset, len(part), len(buffer) // 4))
        total += len(buffer) // 4
        yield part
    footer = pack_footer(blocks, docs)
    yield footer
    yield TAIL.pack(len(footer), total, MAGIC)


def write_ids(docs: DataFrame, path: str, model: str, *, end_id: int = 0, key: str = "doc_id", text: str = "text",
              planes: int = BYTE, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` in ascending ``key`` order and write one shard per partition to ``path``.

    ``key`` is an integer column.  The rows are split by ranges of ``key``; adaptive execution
    sizes the partitions, and so the shards, by their bytes.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = load(model), np.array([end_id], "<u4").tobytes()

        def coded():
            for batch in batches:
                keys = iter(batch.column(0).to_pylist())
                for run in some_texts(batch.column(1).to_pylist()):
                    for ids in coder.encode_all(run):
                        yield next(keys), ids + end

        documents = coded()
        one = next(documents, None)
        if one is None:
            return
        rows = shard_rows(chain_first(one, documents), planes, block_ids)
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["part"])

    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    parts = rows.repartitionByRange("k").sortWithinPartitions("k", "t").mapInArrow(run, "part binary")
    parts.select(F.col("part").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def chain_first(one, rest):
    yield one
    yield from rest


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")


def shard_number(path: str) -> int:
    return int(re.search(r"part-(\d+)", path.rsplit("/", 1)[-1])[1])


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """The chunk index of all shards as a table: ``shard, block, byte_offset, bytes, n_ids``."""
    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(content.as_buffer())
                n = len(shard.blocks)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard_number(p))), pa.array(np.arange(n)),
                                                  *(pa.array(shard.blocks[:, i]) for i in range(3))],
                                                 names=["shard", "block", "byte_offset", "bytes", "n_ids"])

    rows = shard_files(spark, path).select("path", "content").mapInArrow(run, "shard long, block long, byte_offset long, bytes long, n_ids long")
    rows.write.parquet(index)
    return spark.read.schema("shard long, block long, byte_offset long, bytes long, n_ids long").parquet(index)


def read_documents(spark: SparkSession, path: str, index: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids`` of every document in the shards; ids as little-endian 32-bit integers.

    Starts across shards come from the index: one row per shard, as many as there are files.
    """
    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                number, rows = shard_number(p), []
                for k, start, ids in Shard(content.as_buffer()).documents():
                    rows.append((number, k, start, len(ids), ids.tobytes()))
                    if len(rows) == 500:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    def made(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                          names=["shard", "k", "at", "n_tokens", "ids"])

    docs = shard_files(spark, path).select("path", "content").mapInArrow(run, "shard long, k long, at long, n_tokens long, ids binary")
    sizes = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return (docs.join(F.broadcast(base), "shard")
            .select(F.col("k").alias(key), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids"))


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to plane shards and read back: start, length and checksum of its ids."""
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_path(spark, "planes")
    write_ids(docs, f"{path}/shards", public_tokenizers.path("byte_bpe_50k.json"))
    index = write_index(spark, f"{path}/shards", f"{path}/index")
    return read_documents(spark, f"{path}/shards", index).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
