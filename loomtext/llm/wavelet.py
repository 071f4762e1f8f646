"""Token-id output as one wavelet matrix per shard file, and its reader.

Documents are put in ascending order of their id by a range partition; each task encodes its
whole texts and writes shards of about ``SHARD`` tokens, cut between documents. A shard file
holds a header, the table of documents and one bit-plane for each bit of the ids, high bits
first, each plane stably sorted by the planes above it. A sampled count of set bits for each
512 bits makes rank constant-time, so tokens are accessed, counted and located by occurrence
from the one compressed file. Files are written under a name of their attempt and listed in a
manifest only by tasks that succeed, so lost executors leave no duplicates in the result.

Encoding gives the tokenizers library's ids of the whole text (no special tokens added).
Texts are cut at blanks and line feeds, which the vocabulary's pre-tokenizer drops, and ids
of pieces are kept in a bounded cache; pieces of plain letters, digits and signs go to the
library's model, all others through its whole chain. Other tokenizers encode whole texts.

Defined results: a null text counts as empty and has only the end id. Rows with equal ids are
ordered by their text; null ids come first. Other columns are ignored. An empty table writes
no file.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import bytesvec as bv
from .scratch import filesystem, materialize, new_path

MAGIC, BLOCK_BITS, SHARD, CACHE = b"WVMX0001", 512, 1 << 20, 250_000
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)

_SAFE = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class Encoder:
    """Whole texts to ids of one tokenizer file, as little-endian bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.one = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.table = _byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [{}])[0]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        plain = all(re.fullmatch(r"<\|[a-z]+\|>", t) for t in self.special) and not any(t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
        self.by_piece = spec.get("normalizer") == _NORMAL and first.get("pattern") == {"Regex": _SPLIT} and first.get("behavior") == "Removed" and plain
        self.chunks: dict[str, bytes] = _Filled(self._chunk)
        self.pieces: dict[str, bytes] = _Filled(self._piece)

    def _ids(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
        return b"".join([self.one[t.id] for t in self.model.tokenize(letters)])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if chunk.isascii():
            # one cache serves words and chunks that are words
            if chunk.isalpha():
                low = chunk.lower()
                return self._piece(chunk) if low == chunk else self.chunks[low]
            if chunk[-1] in ",." and chunk[:-1].isalpha():
                return self.chunks[chunk[:-1].lower()] + self.pieces[chunk[-1]]
        if _SAFE.fullmatch(chunk) and "<|" not in chunk:
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(chunk.lower())))
        return self._ids(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by_piece:
            if text.isascii() and "<|" not in text:
                text = text.lower()
            return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
        return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def trim(self) -> None:
        """Bound the caches; called between texts."""
        for cache in (self.chunks, self.pieces):
            if len(cache) > CACHE:
                cache.clear()


class _Filled(dict):
    def __init__(self, fill):
        self.fill = fill

    def __missing__(self, key):
        value = self.fill(key)
        if len(key) < 64:
            self[key] = value
        return value


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a file; its cache lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class WaveletMatrix:
    """Bit-planes of a sequence of ids with rank and select."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n, bits = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
        zeros, planes, ranks = [], [], []
        a = ids
        for level in range(bits):
            bit = (a >> a.dtype.type(bits - 1 - level)) & a.dtype.type(1) != 0
            packed = np.packbits(bit, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % (BLOCK_BITS // 8)))
            sums = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(1, dtype=np.uint32)
            planes.append(packed)
            ranks.append(np.concatenate((np.zeros(1, np.uint32), np.cumsum(sums, dtype=np.uint32))))
            a = np.concatenate((np.compress(~bit, a), np.compress(bit, a)))
            zeros.append(n - int(sums.sum()))
        return cls(n, bits, zeros, planes, ranks)

    def _rank1(self, level: int, i: int) -> int:
        """Set bits among a plane's first i."""
        block, rest = divmod(i, BLOCK_BITS)
        total = int(self.ranks[level][block])
        if rest:
            at = block * (BLOCK_BITS // 8)
            whole, odd = divmod(rest, 8)
            piece = self.planes[level][at : at + whole + (odd > 0)]
            total += int(_ONES[piece[:whole]].sum())
            if odd:
                total += int(_ONES[piece[whole] & ((1 << odd) - 1)])
        return total

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of a plane's k-th (from 0) bit of this value."""
        lo, hi = 0, len(self.ranks[level]) - 1
        count = (lambda b: int(self.ranks[level][b])) if bit else (lambda b: b * BLOCK_BITS - int(self.ranks[level][b]))
        while lo < hi - 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if count(mid) <= k else (lo, mid)
        at = lo * (BLOCK_BITS // 8)
        bits = np.unpackbits(self.planes[level][at : at + BLOCK_BITS // 8], bitorder="little")
        return lo * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - count(lo)])

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level in range(self.bits):
            ones = self._rank1(level, i)
            bit = self._rank1(level, i + 1) - ones
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id among the places lo to hi."""
        lo, hi = self._interval(symbol, lo, max(lo, self.n if hi is None else hi))
        return hi - lo

    def _interval(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        if symbol < 0 or symbol >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if symbol >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def locate(self, symbol: int, k: int) -> int | None:
        """Place of an id's k-th occurrence, from 0; None if it has fewer."""
        lo, hi = self._interval(symbol, 0, self.n)
        if k < 0 or k >= hi - lo:
            return None
        i = lo + k
        for level in reversed(range(self.bits)):
            bit = symbol >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids; planes are undone from the lowest."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for level in reversed(range(self.bits)):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            b = np.empty(self.n, kind)
            b[np.flatnonzero(~bit)] = a[: self.zeros[level]]
            b[np.flatnonzero(bit)] = a[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            a = b
        return a


def dump(ids: np.ndarray, doc_ids: pa.Array, sizes: np.ndarray) -> bytes:
    """A shard file's bytes."""
    m = WaveletMatrix.build(ids)
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([doc_ids, pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(sink.getvalue().to_pybytes())]
    for p, r in zip(m.planes, m.ranks):
        parts += [pack(p.tobytes()), pack(r.astype("<u4").tobytes())]
    head = json.dumps({"n": m.n, "bits": m.bits, "zeros": m.zeros, "parts": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


def load(raw: bytes) -> tuple[WaveletMatrix, pa.RecordBatch]:
    """A shard file's wavelet matrix and its documents with their numbers of tokens."""
    if raw[:8] != MAGIC:
        raise ValueError("not a shard file")
    (size,) = struct.unpack_from("<I", raw, 8)
    head = json.loads(raw[12 : 12 + size])
    unpack, at, parts = zstandard.ZstdDecompressor().decompress, 12 + size, []
    for n in head["parts"]:
        parts.append(unpack(raw[at : at + n]))
        at += n
    docs = pa.ipc.open_stream(parts[0]).read_next_batch()
    planes = [np.frombuffer(p, np.uint8) for p in parts[1::2]]
    return WaveletMatrix(head["n"], head["bits"], head["zeros"], planes, [np.frombuffer(p, "<u4") for p in parts[2::2]]), docs


def write_shards(docs: DataFrame, tokenizer: str, directory: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 1, shard_tokens: int = SHARD) -> DataFrame:
    """Encode and write; the manifest has part, shard, path, docs, tokens. Order: part, shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, run_id, shard = encoder(tokenizer), TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        end = np.array([end_id], enc.dtype).tobytes()
        fs, folder = filesystem(directory)
        fs.create_dir(folder, recursive=True)
        held: list[bytes] = []
        ids: list[pa.Array] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, count
            sizes = np.array([len(x) // enc.dtype.itemsize for x in held], np.int64)
            raw = dump(np.frombuffer(b"".join(held), enc.dtype), pa.concat_arrays(ids), sizes)
            path = f"{folder}/part-{part:06d}-{shard:05d}-{run_id}.wvm"
            with fs.open_output_stream(path) as f:
                f.write(raw)
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": path, "docs": len(held), "tokens": int(sizes.sum())}], _MANIFEST)
            held.clear()
            ids.clear()
            shard, count = shard + 1, 0
            return row

        for batch in batches:
            first = 0
            for k in range(batch.num_rows):
                raw = enc.encode(batch.column(1)[k].as_py()) + end
                n = len(raw) // enc.dtype.itemsize
                if held and count + n > shard_tokens:
                    if k > first:
                        ids.append(batch.column(0).slice(first, k - first))
                    first = k
                    yield flush()
                held.append(raw)
                count += n
                if not k & 63:
                    enc.trim()
            if batch.num_rows > first:
                ids.append(batch.column(0).slice(first, batch.num_rows - first))
        if held:
            yield flush()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows.mapInArrow(bv.lean(run), "part int, shard int, path string, docs long, tokens long")


_MANIFEST = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])


def read_shards(manifest: DataFrame, id_type: str, directory: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    totals = manifest.groupBy("part").agg(F.sum("tokens").alias("t"))
    # one row for each writing task, not for each shard or document
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.join(totals, "part").select("path", (F.col("base") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(directory)
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_stream(path) as f:
                    matrix, docs = load(f.read())
                raw = matrix.decode().astype("<u4").view(np.uint8)
                sizes = docs.column(1).to_numpy()
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(base + ends - sizes), docs.column(1), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return files.repartition(spread, "path").mapInArrow(bv.lean(run), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 1) -> DataFrame:
    """Write all documents' shards to the shared folder and report them as read back."""
    spark: SparkSession = docs.sparkSession
    directory = new_path(spark, "shards")
    manifest = materialize(write_shards(docs, tokenizer, directory, text, doc_id, end_id), "manifest")
    return read_shards(manifest, docs.schema[doc_id].dataType.simpleString(), directory)
