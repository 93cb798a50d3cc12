"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself
in the vocabulary is resolved by one probe. Tier two merges the rest with a heap of
adjacent pairs over a linked list of bytes, O(n log n) in the pre-token's length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from sievemark.llm.common import arrow_schema, batch_of, bounded_chunks, documents, of_worker, texts_of

#: White space as Unicode's White_Space property has it; the regex module's \s also takes U+001C to U+001F.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Encoded pre-tokens that a worker keeps, half of them used of late, and their longest length; beyond, they are computed again.
CACHE_ENTRIES, CACHE_LENGTH = 300_000, 64
#: Bytes of text whose words are numbered together.
CHUNK_BYTES = 2_000_000
#: Parts the words of a text for Arrow; texts that hold it go through the pattern as a whole.
PART = "\x1f"

#: Fixed value: the public pattern whose matches never run across a single space or line end into what follows it.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space that is not a single space or line end.
ODD_SPACE = re.compile(r"[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def portable_pattern(pattern: str) -> str:
    """The pattern with \\s and \\S spelt out, inside classes and outside."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE_SPACE if inside else f"[{WHITE_SPACE}]")
            i += 2
        elif two == r"\S" and not inside:
            out.append(f"[^{WHITE_SPACE}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            i += 1
    return "".join(out)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class MinimalPerfectHash:
    """Hash and displace: keys fall into buckets, and each bucket has a seed that sends its keys to free slots.

    n keys fill n slots exactly; the stored key tells members from strangers. Buckets of
    one key come last and store their slot itself, as -1 - slot.
    """

    def __init__(self, keys: list[bytes], values: list[int], load: int = 2):
        self.n = len(keys)
        self.buckets = max(1, self.n // load)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        self.seeds = [0] * self.buckets
        taken = bytearray(self.n)
        self.keys: list[bytes | None] = [None] * self.n
        self.values = [0] * self.n
        free = 0
        for b in sorted(groups, key=lambda b: -len(groups[b])):
            members, seed, tries = groups[b], 0, 0
            if len(members) == 1:
                free = taken.index(0, free)
                slots, seed = [free], -1 - free
            else:
                while True:
                    slots = [self._slot(hashes[i], seed) for i in members]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    tries += 1
                    seed = tries * 0x9E3779B97F4A7C15 % (1 << 62)
            self.seeds[b] = seed
            for i, s in zip(members, slots, strict=True):
                taken[s] = 1
                self.keys[s], self.values[s] = keys[i], values[i]

    def _slot(self, h: int, seed: int) -> int:
        return -1 - seed if seed < 0 else (h ^ seed) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.buckets]
        s = -1 - seed if seed < 0 else (h ^ seed) % self.n
        return self.values[s] if self.keys[s] == key else None


class ByteBpe:
    """Encoder and decoder for one rank file and split pattern.

    Ids travel as little-endian unsigned 32-bit integers. Where a text has no white space but
    single spaces and line ends, no match of a GPT-style pattern crosses the place before one, so its
    words are numbered in Arrow and each distinct one is encoded once; other texts go through the pattern as a whole.
    """

    def __init__(self, rank_data: bytes, pattern: str):
        self.ranks = read_ranks(rank_data)
        self.lookup = MinimalPerfectHash(list(self.ranks), list(self.ranks.values()))
        self.token_bytes = {v: k for k, v in self.ranks.items()}
        self.byte_ids = [self.ranks.get(bytes([b])) for b in range(256)]
        if None in self.byte_ids:
            raise ValueError("the vocabulary lacks a byte")
        of = self.ranks.get
        self.pairs = {(a << 32) | b: r for t, r in self.ranks.items() for k in range(1, len(t)) if (a := of(t[:k])) is not None and (b := of(t[k:])) is not None}
        self.split = regex.compile(portable_pattern(pattern))
        self.by_word = pattern == SPACED_PATTERN
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked adjacent pair, leftmost first, until none is in the vocabulary.

        ids[i] is the token of the part that starts at byte i, -1 once it is merged away;
        a heap entry is the rank of a pair and the place of its left part in one integer.
        """
        pairs, n = self.pairs.get, len(piece)
        ids = list(map(self.byte_ids.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r << 32) | i for i in range(n - 1) if (r := pairs((ids[i] << 32) | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            left, mid = ids[i], after[i]
            if left < 0 or mid >= n or pairs((left << 32) | ids[mid]) != rank:
                continue  # one of the two parts has changed since
            ids[i], ids[mid], end = rank, -1, after[mid]
            after[i] = end
            if end < n:
                before[end] = i
                if (r := pairs((rank << 32) | ids[end])) is not None:
                    heappush(heap, (r << 32) | i)
            if (p := before[i]) >= 0 and (r := pairs((ids[p] << 32) | rank)) is not None:
                heappush(heap, (r << 32) | p)
        return [t for t in ids if t >= 0]

    def encode_piece(self, piece: str) -> bytes:
        """One pre-token: by the perfect hash if it is in the vocabulary, else by merging."""
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            whole = self.lookup.get(raw)
            ids = struct.pack("<I", whole) if whole is not None else struct.pack(f"<{len(m := self.merge(raw))}I", *m)
        if len(piece) <= CACHE_LENGTH:
            if len(self.pieces) >= CACHE_ENTRIES // 2:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def encode_matches(self, text: str) -> bytes:
        found = self.split.findall(text)
        return b"".join([self.pieces.get(p) or self.encode_piece(p) for p in found])

    def encode_word(self, word: str) -> bytes:
        """A word, with the space before it; letters alone, or before one mark, need no search for matches."""
        bare = word[1:] if word[:1] == " " else word
        if bare.isalpha():
            return self.pieces.get(word) or self.encode_piece(word)
        if bare[:-1].isalpha() and bare[-1] in ".,":
            return (self.pieces.get(word[:-1]) or self.encode_piece(word[:-1])) + (self.pieces.get(word[-1]) or self.encode_piece(word[-1]))
        return self.encode_matches(word)

    def _plain(self, text: str) -> bool:
        return self.by_word and text[:1] not in " \n" and text[-1:] not in " \n" and not ODD_SPACE.search(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        plain = list(map(self._plain, texts))
        parted = pc.replace_substring(pa.array([t for t, p in zip(texts, plain) if p], pa.string()), " ", PART + " ")
        split = pc.split_pattern(pc.replace_substring(parted, "\n", f"{PART}\n{PART}"), PART)
        words = split.flatten().dictionary_encode()
        each = list(map(self.encode_word, words.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        number = words.indices.to_numpy()
        n = sizes[number]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[number] - (ends - n), n) + np.arange(n.sum())]
        at = np.r_[0, ends][np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]]
        done = iter([ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
        return [next(done) if p else self.encode_matches(t) for t, p in zip(texts, plain)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _per_worker(rank_data: bytes, pattern: str) -> ByteBpe:
    return of_worker(("bytes", hashlib.sha256(rank_data + pattern.encode()).digest()), lambda: ByteBpe(rank_data, pattern))


#: The largest rank file that is sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if kept).

    The ids are those of the rank file, without special tokens; the digests are those of
    the little-endian unsigned 32-bit ids and of the bytes that decoding them gives.
    A null text is empty: no tokens, digests of nothing. A null doc_id stays null; repeated
    rows give repeated rows; no row gives no row. No shuffle: one narrow pass.
    """
    with open(rank_path, "rb") as f:
        data = f.read()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the rank file is larger than what is broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(data)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    fields = docs.sparkSession.createDataFrame([], schema).schema
    out_schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _per_worker(shared.value, pattern)
        for batch in batches:
            for part in bounded_chunks(batch, "text", CHUNK_BYTES):
                cols: list[list] = [[], [], [], []]
                for ids in bpe.encode(texts_of(part.column("text"))):
                    cols[0].append(len(ids) // 4)
                    cols[1].append(hashlib.sha256(ids).hexdigest())
                    cols[2].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if keep_ids:
                        cols[3].append(np.frombuffer(ids, "<i4"))
                yield batch_of(out_schema, [part.column("doc_id").cast(pa.int64()), *cols[: 3 + keep_ids]])

    return documents(docs, "doc_id", "text").mapInArrow(run, fields)


def decode_documents(encoded: DataFrame, rank_path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; bytes that are not UTF-8 become U+FFFD, null ids a null text."""
    with open(rank_path, "rb") as f:
        data = f.read()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the rank file is larger than what is broadcast")
    shared = encoded.sparkSession.sparkContext.broadcast(data)
    fields = encoded.sparkSession.createDataFrame([], "doc_id long, text string").schema
    out_schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {v: k for k, v in read_ranks(shared.value).items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield batch_of(out_schema, [batch.column("doc_id").cast(pa.int64()), texts])

    return documents(encoded, "doc_id", "ids").mapInArrow(run, fields)
