"""Token-id files with shuffled planes.

A file holds the ids of consecutive documents, cut into blocks of a fixed number of ids. Each block is
transposed into planes, bits or bytes, each plane is one Zstandard frame, and planes above the
block's largest id are not stored. A chunk index (for each block its place, number of ids and plane sizes)
ends the file, so that a reader fetches only the blocks that it needs.

    magic | planes of block 0 | planes of block 1 | ... | index (JSON) | length of index (8 bytes) | magic

Files are written straight to the shared folder, each under a name of its own attempt; the table of
documents, which Spark commits, names only those of the attempts that counted.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, text_or_empty, written

MAGIC = b"BITPLAN1"
BLOCK = 65_536
PLANE_BITS = 8
#: Pre-tokens that the memo holds before it is emptied (some 150 MB).
MEMO = 700_000
#: Bytes of text that are encoded together.
SLICE = 8 << 20


def to_planes(ids: np.ndarray, plane_bits: int = PLANE_BITS, level: int = 3) -> list[bytes]:
    """Compressed planes of up to BLOCK unsigned 32-bit ids, lowest first."""
    ids = np.ascontiguousarray(ids, "<u4")
    bits = int(ids.max(initial=0)).bit_length()
    by_byte = ids.view(np.uint8).reshape(-1, 4)
    pack = zstandard.ZstdCompressor(level=level).compress
    if plane_bits == 8:
        return [pack(np.ascontiguousarray(by_byte[:, i]).tobytes()) for i in range(-(-bits // 8))]
    planes = np.packbits(np.ascontiguousarray(np.unpackbits(by_byte, axis=1, bitorder="little", count=bits or 1).T), axis=1, bitorder="little")
    return [pack(p.tobytes()) for p in planes[:bits]]


def from_planes(planes: list[bytes], n: int, plane_bits: int = PLANE_BITS) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    if plane_bits == 8:
        out = np.zeros((n, 4), np.uint8)
        for i, p in enumerate(planes):
            out[:, i] = np.frombuffer(unpack(p), np.uint8)
        return out.view("<u4").reshape(-1)
    rows = np.zeros((32, n), np.uint8)
    for i, p in enumerate(planes):
        rows[i] = np.unpackbits(np.frombuffer(unpack(p), np.uint8), bitorder="little", count=n)
    return np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Appends ids to a file; only one block is held."""

    def __init__(self, stream, block: int = BLOCK, plane_bits: int = PLANE_BITS):
        self.stream, self.block, self.plane_bits = stream, block, plane_bits
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0
        self.index: list[list] = []
        stream.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        while len(ids):
            part, ids = ids[: self.block - self.n_held], ids[self.block - self.n_held :]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == self.block:
                self._flush()

    def _flush(self) -> None:
        planes = to_planes(np.concatenate(self.held), self.plane_bits)
        self.index.append([self.at, self.n_held, [len(p) for p in planes]])
        for p in planes:
            self.stream.write(p)
            self.at += len(p)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._flush()
        index = json.dumps({"block": self.block, "plane_bits": self.plane_bits, "chunks": self.index}).encode()
        self.stream.write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.stream.close()


class Reader:
    """Ids by position; the block read last is kept."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a finished id file")
        length = struct.unpack("<Q", tail[:8])[0]
        meta = json.loads(file.read_at(length, size - 16 - length))
        self.block, self.plane_bits, self.chunks = meta["block"], meta["plane_bits"], meta["chunks"]
        self.last: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def chunk(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            at, n, sizes = self.chunks[k]
            raw, planes, pos = self.file.read_at(sum(sizes), at), [], 0
            for s in sizes:
                planes.append(raw[pos : pos + s])
                pos += s
            self.last = (k, from_planes(planes, n, self.plane_bits))
        return self.last[1]

    def parts(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from ``start`` on, in parts of a block at most."""
        while n > 0:
            k, off = divmod(start, self.block)
            part = self.chunk(k)[off : off + n]
            if not len(part):
                raise ValueError("the file ends before the ids asked for")
            yield part
            start, n = start + len(part), n - len(part)


#: Characters that the fast path may see: up to here, no combining mark and no change by NFC.
_LAST = 0x24F
_RANGE = [chr(i) for i in range(_LAST + 1)]
#: Python and the library disagree on, or lower-case to several characters.
_ODD = {"\x1c", "\x1d", "\x1e", "\x1f", "\u0130"}
_L, _N = ("".join(map(re.escape, (c for c in _RANGE if unicodedata.category(c)[0] == k))) for k in "LN")
_S = "".join(map(re.escape, (c for c in _RANGE if c.isspace() and c not in _ODD)))
#: Pre-tokens, and the line ends between parts.
_LINED = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_L}{_N}{_S}]+")
_UNSAFE = re.compile("[" + "".join(map(re.escape, sorted(_ODD))) + f"]|[^\x00-{chr(_LAST)}]")


#: What the tokenizer file has to say for the fast path to hold.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_SUFFIX = "</w>"


class Encoder:
    """The tokenizers library's ids for its word-end BPE vocabulary, with a memo of pre-tokens.

    White space separates pre-tokens always. So the texts of a batch are split at it and the parts numbered in Arrow, each distinct
    part is looked at once, and the ids of all texts are gathered from those of the parts. The normaliser lower-cases, and the
    splitter cuts a part into pre-tokens that are encoded on their own: for parts of Latin characters both are repeated here, and
    each distinct pre-token goes to the library once, many in one call (an id that ends a word ends a pre-token). Parts with other
    characters go to the library as they are. Texts that hold a special token's text go there whole. A file with another normaliser,
    splitter or model is refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        model = spec["model"]
        if spec["normalizer"] != _NORMALIZER or len(steps) != 2 or steps[0] != _SPLIT or steps[1]["type"] != "ByteLevel" or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            raise ValueError("only the normaliser and splitter of word-end BPE files are supported")
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _SUFFIX or model["dropout"] or model["unk_token"] or model["ignore_merges"]:
            raise ValueError("only word-end BPE models are supported")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(_SUFFIX)]] = True
        #: The same model for pre-tokens: they are normalised and split already.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Adds pre-tokens of Latin characters to the memo."""
        raw = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4").tobytes()
        cuts = np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1
        if len(cuts) == len(words) and len(raw) == 4 * cuts[-1]:
            at = 0
            for w, end in zip(words, (cuts * 4).tolist()):
                self.memo[w] = raw[at:end]
                at = end
        else:
            self.memo.update(zip(words, self.whole(words)))

    def coded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts between white space, one after the other, and how many each has."""
        if not parts:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        odd = [i for i, p in enumerate(parts) if _UNSAFE.search(p)] if _UNSAFE.search(" ".join(parts)) else []
        plain = parts.copy()
        for i in odd:
            plain[i] = ""
        # One list of pre-tokens with a line end between parts, so that no list a part is made.
        words = _LINED.findall("\n".join(plain).lower())
        memo["\n"] = b""
        found = list(map(memo.get, words))
        if None in found:
            new = list({w for w, ids in zip(words, found) if ids is None})
            for i in range(0, len(new), 20_000):
                self.learn(new[i : i + 20_000])
            found = list(map(memo.__getitem__, words))
        pool, lengths = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        breaks = np.flatnonzero(lengths == 0)
        ends = np.r_[0, np.cumsum(lengths)]
        bounds = np.r_[0, ends[breaks], ends[-1]]
        if odd:
            pieces = np.split(pool, bounds[1:-1])
            for i, ids in zip(odd, self.whole([parts[i] for i in odd])):
                pieces[i] = np.frombuffer(ids, "<u4")
            return np.concatenate(pieces), np.array([len(p) for p in pieces])
        return pool, np.diff(bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has. There are no nulls."""
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        split = pc.ascii_split_whitespace(plain)
        numbered = split.flatten().dictionary_encode()
        pool, sizes = self.coded(numbered.dictionary.to_pylist())
        which = numbered.indices.to_numpy()
        taken = sizes[which]
        ends = np.cumsum(taken)
        # Place in the pool of each id: its part's start there, and how far it is into the part.
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - taken), taken) + np.arange(taken.sum())]
        bounds = np.r_[0, ends][split.offsets.to_numpy() - split.offsets[0].as_py()]
        counts = np.diff(bounds)
        if special.any():
            rows = np.split(ids, bounds[1:-1])
            for i in np.flatnonzero(special):
                rows[i] = np.frombuffer(self.whole([texts[i].as_py()])[0], "<u4")
            ids, counts = np.concatenate(rows), np.array([len(r) for r in rows])
        return ids, counts


_LOADED: dict[str, Encoder] = {}


def loaded(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of some SLICE bytes, or of one longer text."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        end = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SLICE, "right")))
        yield texts.slice(i, end - i)
        i = end


def _split_fs(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)


def write_ids(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str, block: int = BLOCK, plane_bits: int = PLANE_BITS) -> DataFrame:
    """Writes every row's ids, with ``end_id`` after each, in ascending doc_id order; returns the table of documents.

    That table (doc_id, path, at, n_tokens) is stored: the file, the first id's place in it and the number of ids.
    Null texts count as empty: they have the end id only. Null ids come first; rows that repeat an id are
    ordered by text. An empty table writes no file. ``folder`` must be in storage that all executors reach through
    pyarrow (a mounted path, HDFS, S3, GCS).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, path = loaded(tokenizer_file), None, ""
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                path = f"{folder}/{uuid.uuid4().hex}.ids"
                fs, where = _split_fs(path)
                fs.create_dir(where.rpartition("/")[0], recursive=True)
                writer = Writer(fs.open_output_stream(where), block, plane_bits)
            at, n = [], []
            for texts in _slices(b.column(1)):
                ids, counts = encoder.encode(texts)
                ends = np.cumsum(counts)
                at += (writer.n + ends - counts + np.arange(len(counts))).tolist()
                n += (counts + 1).tolist()
                writer.add(np.insert(ids, ends, end_id).astype("<u4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([path] * len(at)), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "path", "at", "n_tokens"])
        if writer is not None:
            writer.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(run, f"doc_id {kind}, path string, at bigint, n_tokens bigint"), "id-documents")


def with_starts(documents: DataFrame) -> DataFrame:
    """Adds start: the number of ids of all documents before, over all files.

    Only one row per file (of some MB each) reaches the driver.
    """
    spark = documents.sparkSession
    files = documents.groupBy("path").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("n")).collect()
    total, starts = 0, []
    for f in sorted(files, key=lambda f: (f["first"] is not None, f["first"])):
        starts.append((f["path"], total))
        total += f["n"]
    offsets = spark.createDataFrame(starts, "path string, _before bigint")
    joined = documents.join(F.broadcast(offsets) if len(starts) <= 50_000 else offsets, "path")
    return joined.withColumn("start", F.col("_before") + F.col("at")).drop("_before")


def read_crcs(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers), read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader = None, None
        for b in batches:
            crcs = []
            for p, at, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                if p != path:
                    fs, where = _split_fs(p)
                    path, reader = p, Reader(fs.open_input_file(where))
                crc, got = 0, 0
                for part in reader.parts(at, n):
                    crc = zlib.crc32(np.ascontiguousarray(part), crc)
                    got += len(part)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), b.column(3), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "path", "at", "n_tokens", "start").repartition("path").sortWithinPartitions("path", "at")
    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(documents: DataFrame) -> DataFrame:
    """doc_id and its ids, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader = None, None
        for b in batches:
            rows = []
            for p, at, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                if p != path:
                    fs, where = _split_fs(p)
                    path, reader = p, Reader(fs.open_input_file(where))
                rows.append(np.concatenate(list(reader.parts(at, n))).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "path", "at", "n_tokens").repartition("path").sortWithinPartitions("path", "at")
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<bigint>")


def new_folder(spark) -> str:
    """A folder for id files, which ``remove_tables`` deletes like an intermediate table."""
    return new_path(spark, "ids", table=True)
