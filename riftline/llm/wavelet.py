"""Token shards as wavelet matrices: one compressed file per shard.

A shard's ids are replaced by their rank among the shard's distinct ids, and the
ranks are stored as bit-planes, most significant first; each plane is the stable
partition of the one before by its bit. Every plane is cut into blocks that are
compressed on their own, with the number of ones before each block, so

* ``access(i)``       reads one block a plane,
* ``rank(id, i)``     counts occurrences before a position,
* ``count(id)``       counts occurrences, and
* ``select(id, k)``   finds the k-th occurrence

all from the file, without decoding it. ``decode()`` restores all ids by merging
the planes backwards.

Layout: magic, little-endian header length, JSON header (sizes and offsets of the
sections that follow), then: document ids, their null mask, document lengths,
alphabet, and the blocks of each plane.

Shards are contiguous ranges of documents in ascending id order (null ids
first). A shard ends after the document that brings it to ``shard_tokens``, so
its memory is bounded by that and one document. Files are written under a name
that holds a random part and listed only by the task attempt that succeeded;
what a lost attempt leaves behind is not read.

Defined results: null and empty texts hold the end id alone; repeated document
ids keep one entry for each row, in the order of their texts; an empty table
gives no files and no rows; other columns may have any names.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import default_path, encoder, texts_by_size
from .workspace import new_path, parallelism, stage

MAGIC = b"RWM1"
BLOCK = 1 << 14  # bytes of a plane in a block
SHARD_TOKENS = 2_000_000


def build(ids: np.ndarray, doc_ids: np.ndarray, null_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of a shard."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    seen = np.bincount(ids) > 0
    alphabet = np.flatnonzero(seen)
    x = (np.cumsum(seen) - 1).astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)[ids]
    planes, body = [], []
    for bit in range(max(1, int(len(alphabet) - 1).bit_length()) - 1, -1, -1):
        ones = x & x.dtype.type(1 << bit) != 0
        packed = np.packbits(ones, bitorder="little")
        per_block = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK * 8), dtype=np.int64) if len(ones) else np.zeros(0, np.int64)
        sizes = []
        for a in range(0, len(packed), BLOCK):
            raw = packed[a : a + BLOCK].tobytes()
            small = press.compress(raw)
            stored = b"\x01" + small if len(small) < len(raw) else b"\x00" + raw
            sizes.append(len(stored))
            body.append(stored)
        planes.append({"bit": bit, "zeros": int(len(ones) - per_block.sum()), "sizes": sizes, "ones": (np.cumsum(per_block) - per_block).tolist()})
        x = np.concatenate([x[~ones], x[ones]])
    parts = [np.asarray(doc_ids, "<i8").tobytes(), np.packbits(null_ids).tobytes(), np.asarray(lengths, "<i8").tobytes(), alphabet.astype("<u4").tobytes()]
    head = press.compress(json.dumps({"n": len(ids), "docs": len(doc_ids), "sections": list(map(len, parts)), "planes": planes}).encode())
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *parts, *body])


class Shard:
    """Queries on a shard's file; ``read(offset, size)`` gives bytes of it."""

    def __init__(self, read):
        import zstandard

        self._unpress = zstandard.ZstdDecompressor()
        self._read = read
        if read(0, 4) != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(read(4, 4), "little")
        head = json.loads(self._unpress.decompress(read(8, size)))
        self.n, self.planes = head["n"], head["planes"]
        at, sections = 8 + size, []
        for width in head["sections"]:
            sections.append(read(at, width))
            at += width
        self.doc_ids = np.frombuffer(sections[0], "<i8")
        self.null_ids = np.unpackbits(np.frombuffer(sections[1], np.uint8))[: head["docs"]].astype(bool)
        self.lengths = np.frombuffer(sections[2], "<i8")
        self.alphabet = np.frombuffer(sections[3], "<u4")
        for plane in self.planes:
            plane["at"] = (at + np.cumsum([0, *plane["sizes"]])).tolist()
            at = plane["at"][-1]
        self._last: dict[int, tuple[int, np.ndarray]] = {}

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda at, size: data[at : at + size])

    def _block(self, level: int, k: int) -> np.ndarray:
        """The bits of a block; the last one of each plane is remembered."""
        if self._last.get(level, (-1,))[0] != k:
            plane = self.planes[level]
            stored = self._read(plane["at"][k], plane["sizes"][k])
            raw = self._unpress.decompress(stored[1:]) if stored[:1] == b"\x01" else stored[1:]
            self._last[level] = k, np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        return self._last[level][1]

    def _ones(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        plane = self.planes[level]
        if i >= self.n:
            return self.n - plane["zeros"]
        k, r = divmod(i, BLOCK * 8)
        return plane["ones"][k] + int(np.count_nonzero(self._block(level, k)[:r]))

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        symbol = 0
        for level, plane in enumerate(self.planes):
            k, r = divmod(i, BLOCK * 8)
            bit, ones = int(self._block(level, k)[r]), self._ones(level, i)
            symbol = symbol << 1 | bit
            i = plane["zeros"] + ones if bit else i - ones
        return int(self.alphabet[symbol])

    def _symbol(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the symbol's occurrences before ``i`` end up under the last plane."""
        a, b = 0, i
        for level, plane in enumerate(self.planes):
            oa, ob = self._ones(level, a), self._ones(level, b)
            a, b = (plane["zeros"] + oa, plane["zeros"] + ob) if symbol >> plane["bit"] & 1 else (a - oa, b - ob)
        return a, b

    def rank(self, token: int, i: int) -> int:
        symbol = self._symbol(token)
        if symbol is None:
            return 0
        a, b = self._range(symbol, max(0, min(i, self.n)))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of occurrence ``k``, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        symbol = self._symbol(token)
        place = self._range(symbol, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            plane = self.planes[level]
            one = symbol >> plane["bit"] & 1
            place = self._find(level, one, place - plane["zeros"] if one else place)
        return place

    def _find(self, level: int, one: int, k: int) -> int:
        """The place in a plane of its ``k``-th one (or zero), by bisection over blocks."""
        plane = self.planes[level]
        before = lambda b: plane["ones"][b] if one else b * BLOCK * 8 - plane["ones"][b]
        low, high = 0, len(plane["sizes"]) - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if before(mid) <= k else (low, mid - 1)
        bits = self._block(level, low)[: min(BLOCK * 8, self.n - low * BLOCK * 8)]
        return low * BLOCK * 8 + int(np.flatnonzero(bits == one)[k - before(low)])

    def occurrences(self, token: int):
        for k in range(self.count(token)):
            yield self.select(token, k)

    def decode(self) -> np.ndarray:
        """All ids, by merging the planes from the last to the first."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            plane = self.planes[level]
            ones = np.concatenate([self._block(level, k) for k in range(len(plane["sizes"]))] or [np.zeros(0, np.uint8)])[: self.n].astype(bool)
            out = np.empty_like(x)
            out[~ones] = x[: plane["zeros"]]
            out[ones] = x[plane["zeros"] :] | kind(1 << plane["bit"])
            x = out
        return self.alphabet[x] if self.n else x


def write_shards(docs: DataFrame, tokenizer_path: str, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; a table of them: path, part, seq, docs, tokens and ``start``, the ids in all files before."""
    from pyarrow import fs

    spark = docs.sparkSession
    folder = new_path(spark, "token-shards")
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)

    def batches(it):
        from pyarrow import fs
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer_path).encode
        files, root = fs.FileSystem.from_uri(folder)
        held, held_docs, seq = [], [], 0

        def flush():
            ids, lengths = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            doc_ids = pa.concat_arrays(held_docs)
            data = build(ids, doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), lengths)
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wm"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"path": [name], "part": [part], "seq": [seq], "docs": [len(doc_ids)], "tokens": [len(ids)]}, MANIFEST)

        size = 0
        for batch in it:
            doc_ids = batch.column(0)
            for first, texts in texts_by_size(batch.column(1)):
                ids, lengths = encode(texts)
                held.append((ids, lengths))
                held_docs.append(doc_ids.slice(first, len(texts)))
                size += len(ids)
                if size >= shard_tokens:
                    yield flush()
                    held, held_docs, seq, size = [], [], seq + 1, 0
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(parallelism(spark), F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    done = stage(rows.mapInArrow(batches, "path string, part int, seq int, docs long, tokens long"), "token-manifest")
    # One row for each file of some millions of ids.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("path", F.concat(F.lit(folder + "/"), "path")).withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


MANIFEST = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())])


def open_shard(path: str) -> Shard:
    """A shard whose bytes are read as they are asked for."""
    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(path)
    handle = files.open_input_file(place)
    return Shard(lambda at, size: handle.read_at(size, at))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def batches(it):
        from pyarrow import fs

        for batch in it:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, place = fs.FileSystem.from_uri(path)
                with files.open_input_file(place) as f:
                    shard = Shard.of(f.read())
                ids, ends = shard.decode().astype("<u4"), np.cumsum(shard.lengths)
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - shard.lengths).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, mask=shard.null_ids), pa.array(start + ends - shard.lengths), pa.array(shard.lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = manifest.select("path", "start")
    # a file to a row: a few files to a task
    rows = rows.repartition(parallelism(manifest.sparkSession), "path")
    return rows.mapInArrow(batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


QUERY = "op2_wavelet_shards"
ORACLE = None


def query(spark, sf_dir):
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path()))
