"""Sorted-string-table shards of token ids, keyed by document identifier.

One shard (format SVT1, integers little-endian):
  data blocks   entries of varint shared, varint unshared, varint value length, key suffix, value;
                a block is zstd-compressed and followed by the crc32 of the stored bytes
  index         per block: last key (varint length, bytes), u64 offset, u32 stored length
  Bloom filter  bits, then u32 number of bits, u8 number of hashes
  footer        u64 index offset, u32 blocks, u64 filter offset, u64 documents, u64 tokens, u8 bytes per id, "SVT1"
A key is 0 for a null identifier, else 1 and the identifier as big-endian with its sign bit
flipped, then a u32 counter of repeated identifiers; so keys sort as identifiers do, nulls first.
A value is the document's ids, 2 bytes each where the vocabulary allows, else 4.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import arrow_schema, batch_of, bounded_chunks, documents, materialise, n_shuffle, new_path, of_worker

MAGIC, BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = b"SVT1", 64 << 10, 16, 10, 7
FOOTER = struct.Struct("<QIQQQB4s")


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    return (b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))) + struct.pack(">I", repeat)


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key[:-4])
    a, b = h >> 64, (h & ((1 << 64) - 1)) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Streams sorted entries to a file; holds one block, the index and the keys' hashes."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes, self.at = out, id_bytes, 0
        self.block, self.in_block, self.last = bytearray(), 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[bytes] = []
        self.documents = self.tokens = 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.documents and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.id_bytes}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.last = key
        self.hashes.append(key)
        self.documents += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.in_block:
            stored = self.zstd.compress(bytes(self.block))
            self.index.append((self.last, self.at, len(stored)))
            self._put(stored + struct.pack("<I", zlib.crc32(stored)))
            self.block, self.in_block = bytearray(), 0

    def finish(self) -> int:
        self._flush()
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index))
        bits = max(64, BLOOM_BITS * self.documents)
        bloom = bytearray((bits + 7) // 8)
        for key in self.hashes:
            for p in _bloom_places(key, bits, BLOOM_HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.at
        self._put(bytes(bloom) + struct.pack("<IB", bits, BLOOM_HASHES))
        self._put(FOOTER.pack(index_at, len(self.index), bloom_at, self.documents, self.tokens, self.id_bytes, MAGIC))
        return self.at


class ShardReader:
    """Reads a shard: the footer, index and filter first, then blocks one at a time."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        if size < FOOTER.size:
            raise ValueError("not a shard: too short")
        index_at, blocks, bloom_at, self.documents, self.tokens, self.id_bytes, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: bad magic")
        tail = file.read_at(size - FOOTER.size - index_at, index_at)
        self.index, at = [], 0
        for _ in range(blocks):
            n, at = _read_varint(tail, at)
            self.index.append((tail[at : at + n], *struct.unpack_from("<QI", tail, at + n)))
            at += n + 12
        self.bits, self.hashes = struct.unpack("<IB", tail[-5:])
        self.bloom = tail[bloom_at - index_at : -5]

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, n = self.index[i]
        stored = self.file.read_at(n + 4, offset)
        if zlib.crc32(stored[:n]) != struct.unpack("<I", stored[n:])[0]:
            raise ValueError(f"block {i} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(stored[:n]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, f"<u{self.id_bytes}", length // self.id_bytes, at)
            at += length

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of that identifier: filter, binary search of the index, then the block."""
        key = key_of(doc_id)
        if not self.index or not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits, self.hashes)):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        found = []
        for i in range(lo, len(self.index)):
            for k, ids in self.block(i):
                if k[:-4] == key[:-4]:
                    found.append(ids)
                elif k > key and k[:-4] != key[:-4]:
                    return found
        return found


#: Bytes of text whose words are numbered together.
CHUNK_BYTES = 8_000_000
#: The largest tokenizer file that is sent to the executors; words that a worker keeps and their longest length.
MAX_TOKENIZER_BYTES, CACHE_ENTRIES, CACHE_LENGTH = 64 << 20, 800_000, 64


def stable_letters() -> str:
    """A class of the letters behind which a word may be cut before the tokenizer composes and lower-cases a text.

    Letters of the first plane in Unicode 3.2 and today, so that older and newer tables agree on them, whose composed and lower-cased form ends
    in a letter: some letters come apart (U+0959, U+0130), and their mark then belongs to the signs that follow.
    """

    def stays(c: str) -> bool:
        letter = all(db.category(c)[0] == "L" for db in (unicodedata, unicodedata.ucd_3_2_0))
        return letter and unicodedata.category(unicodedata.normalize("NFC", c).lower()[-1])[0] == "L"

    points = [c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and stays(chr(c))]
    starts = [c for c, before in zip(points, [0, *points]) if c != before + 1]
    ends = [c for c, after in zip(points, [*points[1:], 0]) if after != c + 1]
    return "[A-Za-z" + "".join(f"\\x{{{a:04x}}}-\\x{{{b:04x}}}" for a, b in zip(starts, ends, strict=True)) + "]"


#: A letter before an ASCII mark or digit: a word of the tokenizer ends there. Not before an apostrophe, which may begin one.
WORD_END = f"({stable_letters()})" + r"([!-&(-@\[-`{-~])"


#: Fixed value: the split pattern of the tokenizers whose words are encoded one by one. Texts of others are encoded whole.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """The tokenizers library over texts, word by word: each distinct word is encoded once and kept.

    Neither white space nor WORD_END ever lies within a word of the tokenizer. Texts are split and
    their words numbered in Arrow; ids come by number from one array, so no Python object stands for a word
    but once in a chunk. New words of letters alone are encoded GROUP at a time and parted at the ids that end a word.
    """

    GROUP = 64

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        splits = (json.loads(tokenizer_json).get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = any(x.get("pattern") == {"Regex": WORD_PATTERN} and x.get("behavior") == "Removed" and x.get("invert") for x in splits)
        # the strings of added tokens are cut out before words are; texts that hold one are encoded whole
        self.added = [x["content"] for x in json.loads(tokenizer_json).get("added_tokens") or []]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        # words used of late, and those used before: together no more than CACHE_ENTRIES
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _group(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):  # some are more than one word
            return self._encoded(words)
        raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        new, old = self.new, self.old
        out = [x if (x := new.get(w)) is not None else old.get(w) for w in words]
        missing = [w for w, x in zip(words, out) if x is None]
        letters, others = [w for w in missing if w.isalpha()], [w for w in missing if not w.isalpha()]
        found: dict[str, bytes] = {}
        for part, size, encode in ((letters, self.GROUP, self._group), (others, 4096, self._encoded)):
            for at in range(0, len(part), size):
                found.update(zip(part[at : at + size], encode(part[at : at + size])))
        if found:
            out = [found[w] if x is None else x for w, x in zip(words, out)]
        if len(new) + len(words) > CACHE_ENTRIES // 2:
            self.old, self.new = new, {}
        self.new.update((w, x) for w, x in zip(words[: CACHE_ENTRIES // 2], out) if len(w) <= CACHE_LENGTH)
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each text, null as empty, with end_id behind."""
        last = np.array([] if end_id is None else [end_id], "<u4")
        texts = pc.fill_null(texts, "")
        whole = pa.array([not self.by_word] * len(texts), pa.bool_())
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        by_word = self._by_word(texts.filter(pc.invert(whole)))
        for i, as_one in enumerate(whole.to_pylist()):
            ids = np.frombuffer(self._encoded([texts[i].as_py()])[0], "<u4") if as_one else next(by_word)
            yield np.concatenate([ids, last])

    def _by_word(self, texts: pa.Array) -> Iterator[np.ndarray]:
        spaced = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), WORD_END, r"\1 \2")
        split = pc.split_pattern(spaced, " ")
        words = split.flatten().dictionary_encode()
        each = self._ids(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        starts = np.cumsum(sizes) - sizes
        number = words.indices.to_numpy()
        n = sizes[number]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[number] - (ends - n), n) + np.arange(n.sum())]
        of_text = np.r_[0, ends][np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]]
        for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True):
            yield ids[a:b]


def _per_worker(tokenizer_json: str) -> WordEncoder:
    """One encoder for each Python worker, so that its tasks share the words known; one thread, as tasks fill the cores."""

    def build() -> WordEncoder:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return WordEncoder(tokenizer_json)

    return of_worker(("words", hashlib.sha256(tokenizer_json.encode()).digest()), build)


def _open(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs, path


def write_shards(docs: DataFrame, tokenizer_path: str, root: str, end_id: int | None = 2, shards: int | None = None) -> DataFrame:
    """Encode every text and write one shard for each range of doc_id; returns the manifest (shard, path, n_docs, n_tokens, n_bytes).

    root is a URI that all executors share. A null text has no ids but the end id; null identifiers
    come first; repeated identifiers are kept, in the order of their texts. A shard
    is written under a name of its own and then renamed, so a task that is run again does no harm.
    An empty table gives no shard and an empty manifest.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError("the tokenizer file is larger than what is broadcast")
    from tokenizers import Tokenizer

    id_bytes = 2 if max(Tokenizer.from_str(data).get_vocab_size(with_added_tokens=True) - 1, end_id or 0) < 1 << 16 else 4
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(data)
    fields = spark.createDataFrame([], "shard int, path string, n_docs long, n_tokens long, n_bytes long").schema
    out_schema = arrow_schema(fields)
    fs, path = _open(root)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _per_worker(shared.value), TaskContext.get().partitionId()
        fs, path = _open(root)
        writer = None
        name, temporary = f"{path}/shard-{shard:06d}.sst", f"{path}/.{uuid.uuid4().hex}"
        last, repeat = None, 0
        for batch in batches:
            for part in bounded_chunks(batch, "text", CHUNK_BYTES):
                if writer is None and part.num_rows:
                    out = fs.open_output_stream(temporary)
                    writer = ShardWriter(out, id_bytes)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text"), end_id), strict=True):
                    repeat = repeat + 1 if writer.documents and doc_id == last else 0
                    last = doc_id
                    writer.add(key_of(doc_id, repeat), ids)
        if writer is not None:
            size = writer.finish()
            out.close()
            fs.move(temporary, name)
            yield batch_of(out_schema, [[shard], [f"{root}/shard-{shard:06d}.sst"], [writer.documents], [writer.tokens], [size]])

    ordered = documents(docs, "doc_id", "text").repartitionByRange(shards or n_shuffle(spark), F.col("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return materialise(ordered.mapInArrow(run, fields), "sst-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, if kept)."""
    files, start = [], 0
    for row in manifest.orderBy("shard").toLocalIterator():  # a row for each file
        files.append((row["path"], start))
        start += row["n_tokens"]
    fields = spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids).schema
    out_schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, path = _open(uri)
                with fs.open_input_file(path) as f:
                    reader = ShardReader(f)
                    for i in range(len(reader.index)):
                        cols: list[list] = [[], [], [], [], []]
                        for key, ids in reader.block(i):
                            wide = ids.astype("<u4")
                            for c, v in zip(cols, (id_of(key), at, len(ids), zlib.crc32(wide.tobytes()), wide.astype("<i4")), strict=True):
                                c.append(v)
                            at += len(ids)
                        yield batch_of(out_schema, cols[: 4 + keep_ids])

    listed = spark.createDataFrame(files, "path string, base long").repartition(max(1, min(len(files), n_shuffle(spark))))
    return listed.mapInArrow(run, fields)


def lookup(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the asked documents, by filter and binary search in each shard."""
    spark = manifest.sparkSession
    fields = spark.createDataFrame([], "doc_id long, ids array<int>").schema
    out_schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = _open(uri)
                with fs.open_input_file(path) as f:
                    reader = ShardReader(f)
                    found = [(d, x.astype("<i4")) for d in doc_ids for x in reader.get(d)]
                yield batch_of(out_schema, [[d for d, _ in found], [x for _, x in found]])

    return manifest.select("path").mapInArrow(run, fields)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the shards to a new folder of the shared place and read them back."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, tokenizer_path, new_path(spark, "sst"), end_id))
