"""Byte-level BPE over a corpus: every distinct word is encoded once and joined back by position.

A pass over the texts splits them into pre-tokens and packs each chunk's distinct words by hash
shard. The shards meet in one global shuffle, where every distinct word of a shard is encoded once.
Its partitions are rebalanced by their size, and words stream through a table of known words that
holds at most ``KNOWN_WORDS``: neither grows with the corpus. A word is encoded again only where its
shard was cut for size or the table was full. A second pass packs each chunk's documents as word positions; the encoded words come back to their chunk,
and the documents are reassembled by position. So the shuffles carry distinct words of
chunks and compressed positions, never a row per pre-token. Chunks are bounded by their text.

Both passes list a chunk's words alike, so only ids come back, with a checksum of the words
that they encode. Should a re-run pass cut its chunks elsewhere, the checksums differ and the
words concerned are encoded on the spot: the result never depends on how the table is split.

Decoding joins ids with the token-byte table, which the vocabulary bounds (about 50,000 rows).

Defined results: a null or empty text has no ids; texts are taken whole; special tokens'
strings are ordinary text; repeated rows and null ids each give a row; an empty table gives
none; only the named columns are read. ``ids`` are packed as little-endian unsigned 32-bit.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .tokenizers import ENCODING_VOCABULARY, encoding, token_bytes, vocabulary_path

CHUNK_CHARS = 8 << 20
SLICE_CHARS = 1 << 20
SHARDS_PER_PARTITION = 4
#: Words whose ids a task keeps while it is at one shard (some 150 bytes each), and packed bytes that it opens at once.
KNOWN_WORDS = 1_000_000
BLOCK_BYTES = 8 << 20


def pack(*, level: int = 1, **columns: pa.Array) -> bytes:
    """Columns of equal length as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict(columns)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """(chunk, keys, texts) in bounded pieces of a partition."""
    number, keys, texts, held = TaskContext.get().partitionId() << 24, [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text or "")
            held += len(texts[-1])
            if held >= CHUNK_CHARS:
                yield number, keys, texts
                number, keys, texts, held = number + 1, [], [], 0
    if keys:
        yield number, keys, texts


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens, most frequent first, the word number at each position, and the
    number of pre-tokens of each text."""
    find = regex.compile(public_tokenizers.PATTERN).findall
    slices, counts, words, held = [], [], [], 0
    for text in texts:
        found = find(text)
        counts.append(len(found))
        words += found
        held += len(text)
        if held >= SLICE_CHARS:
            slices.append(pa.array(words, pa.string()).dictionary_encode())
            words, held = [], 0
    slices.append(pa.array(words, pa.string()).dictionary_encode())
    whole = pa.chunked_array(slices).unify_dictionaries()
    distinct = whole.chunk(0).dictionary
    at = np.concatenate([x.indices.to_numpy(zero_copy_only=False) for x in whole.chunks])
    order = np.argsort(-np.bincount(at, minlength=len(distinct)), kind="stable")
    rank = np.empty(len(distinct), np.uint32)
    rank[order] = np.arange(len(distinct), dtype=np.uint32)
    return distinct.take(pa.array(order)), rank[at], np.array(counts, np.int64)


def by_shard(words: pa.Array, shards: int) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(shard, positions, words) of each shard that has words, in their order."""
    shard = np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.uint32, len(words)) % shards
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        where = order[edges[s] : edges[s + 1]]
        yield int(s), where, words.take(pa.array(where))


def checksum(words: pa.Array) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(words.to_pylist()).encode(), digest_size=8).digest(), "little", signed=True)


def _word_lists(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts in chunks(batches):
            packed = [(s, pack(word=w)) for s, _, w in by_shard(split(texts)[0], shards)]
            if packed:
                shard, words = zip(*packed, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(shard), pa.int64()), pa.array(shard, pa.int32()), pa.array(words, pa.binary())], ["chunk", "shard", "words"])

    return run


def encode_words(words: pa.Array, path: str) -> pa.Array:
    encode = encoding(path).encode_ordinary
    return pa.array([encode(w) for w in words.to_pylist()], pa.list_(pa.uint32()))


def blocks(shards: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of one shard that hold about ``BLOCK_BYTES`` at most."""
    begin, held = 0, 0
    for i in range(len(shards)):
        if i > begin and (shards[i] != shards[begin] or held + sizes[i] > BLOCK_BYTES):
            yield begin, i
            begin, held = i, 0
        held += sizes[i]
    if begin < len(shards):
        yield begin, len(shards)


def _encoded_words(path: str):
    """Packed ids of packed words; rows come sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        at, known = None, {}  # the ids of the words of one shard, packed
        for rows in batches:
            shard, out, checks = rows["shard"].to_numpy(), [], []
            for begin, end in blocks(shard, pc.binary_length(rows["words"]).to_numpy()):
                lists = [unpack(b).column(0) for b in rows["words"].slice(begin, end - begin).to_pylist()]
                if shard[begin] != at or len(known) > KNOWN_WORDS:
                    at, known = shard[begin], {}
                # One look at the known words for each distinct word of the block.
                block = pa.concat_arrays(lists).dictionary_encode()
                words = block.dictionary.to_pylist()
                for w in words:
                    if w not in known:
                        known[w] = np.array(encode(w), "<u4").tobytes()
                packed = [known[w] for w in words]
                ends = np.cumsum([0, *map(len, packed)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4")))
                begins = np.cumsum([0, *map(len, lists)])
                out += [pack(ids=ids.take(block.indices.slice(a, b - a))) for a, b in itertools.pairwise(begins)]
                checks += [checksum(x) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [rows["chunk"], rows["shard"], pa.array(checks, pa.int64()), pa.array(out, pa.binary())], ["chunk", "shard", "words_checksum", "known"]
            )

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, keys, texts in chunks(batches):
        words, at, counts = split(texts)
        planes = np.ascontiguousarray(at.view(np.uint8).reshape(-1, 4).T)  # bytes of one weight together compress better
        body = [
            pack(doc_id=pa.array(keys, pa.int64()), words=pa.array(counts)),
            pack(word=words),
            pack(**{f"byte{i}": pa.array(p) for i, p in enumerate(planes)}),
        ]
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([b], pa.binary()) for b in body)], ["chunk", "docs", "words", "positions"])


def _joined(path: str, shards: int, decode: bool):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        have = {(r["shard"], r["words_checksum"]): r["known"] for r in known.to_pylist()}
        out_keys, out_ids, out_bytes = [], [], []
        for row in docs.to_pylist():
            wheres, lists = [np.empty(0, np.int64)], []
            words = unpack(row["words"]).column(0)
            for shard, where, own in by_shard(words, shards):
                blob = have.get((shard, checksum(own)))
                lists.append(unpack(blob).column(0) if blob is not None else encode_words(own, path))
                wheres.append(where)
            back = np.argsort(np.concatenate(wheres), kind="stable")
            mine = pa.chunked_array(lists, pa.list_(pa.uint32())).combine_chunks().take(pa.array(back))
            flat, starts = mine.flatten().to_numpy(zero_copy_only=False).astype("<u4"), mine.offsets.to_numpy() - mine.offsets[0].as_py()
            lengths = np.diff(starts)
            planes = unpack(row["positions"])
            at = np.ascontiguousarray(np.stack([c.to_numpy(zero_copy_only=False) for c in planes.columns], axis=1)).view(np.uint32).ravel()
            each = unpack(row["docs"])
            ends = np.cumsum(each.column(1).to_numpy())
            begin = 0
            for end in ends:  # one document at a time bounds what is laid out at once
                w = at[begin:end]
                n = lengths[w]
                stop = np.cumsum(n)
                index = np.arange(stop[-1] if len(n) else 0) + np.repeat(starts[:-1][w] - (stop - n), n)
                out_ids.append(flat[index].tobytes())
                if decode:
                    out_bytes.append(decode_ids(out_ids[-1], path))
                begin = end
            out_keys += each.column(0).to_pylist()
        found = {"doc_id": pa.array(out_keys, pa.int64()), "ids": pa.array(out_ids, pa.binary())}
        return pa.table(found | ({"decoded": pa.array(out_bytes, pa.binary())} if decode else {}))

    return run


def encoded(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, decode: bool = False) -> DataFrame:
    """doc_id and the packed ids of each document; with ``decode`` also the bytes that those ids stand for."""
    text_batches(df.sparkSession)
    path = vocabulary or vocabulary_path(ENCODING_VOCABULARY)
    shards = SHARDS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    words = texts.mapInArrow(_word_lists(shards), "chunk long, shard int, words binary")
    balanced = words.hint("rebalance", "shard").sortWithinPartitions("shard")
    known = balanced.mapInArrow(_encoded_words(path), "chunk long, shard int, words_checksum long, known binary")
    docs = texts.mapInArrow(_documents, "chunk long, docs binary, words binary, positions binary")
    schema = "doc_id long, ids binary" + (", decoded binary" if decode else "")
    return docs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_joined(path, shards, decode), schema)


@lru_cache(2)
def token_table(path: str) -> pa.Array:
    """The bytes of each id, null where an id is not used."""
    of = token_bytes(path)
    return pa.array([of.get(i) for i in range(max(of) + 1)], pa.binary())


def decode_ids(packed: bytes | None, path: str) -> bytes:
    """Join packed ids with the token-byte table. Ids that the vocabulary lacks raise."""
    tokens = token_table(path).take(pa.array(np.frombuffer(packed or b"", "<u4")))
    if tokens.null_count:
        raise ValueError("an id is not in the vocabulary")
    return b"".join(tokens.to_pylist()) if len(tokens) < 32 else _flat(tokens)


def decoded(df: DataFrame, ids: str = "ids", name: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Add the bytes of packed ids. Ids that the vocabulary lacks raise."""
    path = vocabulary or vocabulary_path(ENCODING_VOCABULARY)

    def run(packed: pa.Array) -> pa.Array:
        return pa.array([decode_ids(x, path) for x in packed.to_pylist()], pa.binary())

    return df.withColumn(name, F.arrow_udf(run, "binary")(df[ids]))


def _flat(tokens: pa.BinaryArray) -> bytes:
    """What a gathered binary array holds, end to end."""
    offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    return tokens.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes()


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    from .common import table

    whole = encoded(table(spark, sf_dir, "documents"), decode=True)  # one Python worker a task, not two
    return whole.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
