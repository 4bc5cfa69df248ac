"""Token-ID output in training order.

Documents are encoded, each ended by one mark, and laid end to end; the line is
cut into sequences of ``seq_len`` tokens, the last one padded.  A keyed Feistel
network with cycle-walking permutes the sequence numbers, so sequence i goes to
slot permute(i) without a table or a sort of the corpus.  Slots are cut into
ranges, one shard each; a shard is a plain file of fixed-stride records, so slot
k is at a known place and a reader may stop and resume anywhere.

Tokens are shuffled once, by slot range; what adjoining documents have in one
sequence travels as one piece, compressed.  Shards are written through the file
system of the output folder under an attempt's own name and then renamed, so a
task that runs again, or twice, leaves the same file.

Results for odd input: null and empty texts give their end mark alone; special
strings in texts are ordinary text; repeated rows and null ids are encoded each;
an empty table gives no shards and an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.llm.common import row_slices, stored, table, whole_text
from tillcast.llm.registry import query
from tillcast.session import scratch_path

SEQ_LEN = 1024
SHARD_SLOTS = 2048
KEY = 0x5EED
ROUNDS = 6
END_ID = 50256
DTYPE = np.dtype("<u2")
# ids between encoding and shards: written once and read once
TOKEN_FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}
PIECE_LEVEL = 9

_encoders: dict = {}


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _keys(key: int) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(f"{key}:{i}".encode(), digest_size=8).digest(), "little") for i in range(ROUNDS)]


def permute(numbers: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """A keyed bijection of [0, n): a balanced Feistel network over the next even power of two, walked until it lands inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = _keys(key)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in (reversed(keys) if inverse else keys):
            if inverse:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        return left << np.uint64(half) | right

    out = np.asarray(numbers).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = once(out)
        while (far := out >= np.uint64(n)).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def _encoder(path: str):
    """tiktoken encoding of a rank file, made once per Python worker."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encode_documents(path: str, end_id: int):
    """(part, at, ids): token bytes of each document, and where it starts in this partition's line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = _encoder(path), TaskContext.get().partitionId(), 0
        for b in row_slices(batches, "text"):
            ids, starts, counts = [], [], []
            for text in b.column(0).to_pylist():
                x = np.array([*enc.encode_ordinary(text), end_id], DTYPE)
                ids.append(x.tobytes())
                starts.append(at)
                counts.append(len(x))
                at += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()),
                                              pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["part", "at", "n", "ids"])
    return run


def cut_sequences(n_seq: int, seq_len: int, key: int):
    """Pieces (slot, offset, ids) of documents at (start, ids); pieces that adjoin in one sequence are joined."""
    width = DTYPE.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ids = zstandard.ZstdCompressor(level=PIECE_LEVEL).compress
        seqs, offsets, ids = [], [], []
        held, seq, offset = bytearray(), -1, 0

        def put():
            seqs.append(seq)
            offsets.append(offset)
            ids.append(zip_ids(bytes(held)))

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(permute(np.array(seqs, np.int64), n_seq, key)), pa.array(offsets, pa.int32()),
                                                pa.array(ids, pa.binary())], names=["slot", "offset", "ids"])
            for x in (seqs, offsets, ids):
                x.clear()
            return batch

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for start, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    n, i = len(data) // width, 0
                    while i < n:
                        s, o = divmod(start + i, seq_len)
                        k = min(seq_len - o, n - i)
                        if s != seq or o != offset + len(held) // width:
                            if held:
                                put()
                            held, seq, offset = bytearray(), s, o
                        held += data[i * width:(i + k) * width]
                        i += k
                if len(ids) >= 1024:
                    yield out()
        if held:
            put()
        yield out()
    return run


MANIFEST_SCHEMA = "shard long, path string, first_slot long, n_slots long, n_bytes long, sha256 string"


def write_shards(folder: str, seq_len: int, shard_slots: int, pad_id: int):
    """One file per shard; input is sorted by slot and offset, and holds whole shards."""
    stride = seq_len * DTYPE.itemsize
    pad = np.full(seq_len, pad_id, DTYPE).tobytes()

    def rows(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                yield from zip(*(b.slice(lo, 1024).column(i).to_pylist() for i in (0, 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        done: list[tuple] = []
        shard, out, name, record, slot, first, digest, n = None, None, "", bytearray(), None, 0, None, 0

        def put():
            nonlocal n
            data = bytes(record) + pad[len(record):]
            out.write(data)
            digest.update(data)
            n += 1

        def close():
            out.close()
            final = f"{root}/shard-{shard:06d}.bin"
            store.move(name, final)
            done.append((shard, final, first, n, n * stride, digest.hexdigest()))

        unzip = zstandard.ZstdDecompressor().decompress
        for s, ids in rows(batches):
            if slot is not None and s != slot:
                put()
                record = bytearray()
            if s // shard_slots != shard:
                if shard is not None:
                    close()
                shard, first, n, digest = s // shard_slots, s, 0, hashlib.sha256()
                name = f"{root}/.shard-{shard:06d}-{uuid.uuid4().hex}"
                out = store.open_output_stream(name)
            slot = s
            record += unzip(ids)
        if shard is not None:
            put()
            close()
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        cols = list(zip(*done)) if done else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in MANIFEST_SCHEMA.split(", ")])
    return run


def write_training_order(docs: DataFrame, folder: str, ranks: str, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS,
                         key: int = KEY, end_id: int = END_ID) -> tuple[DataFrame, int, int]:
    """Writes the shards; returns their manifest, the number of sequences and the number of tokens."""
    encoded = stored(docs.select(whole_text().alias("text")).mapInArrow(encode_documents(ranks, end_id), "part int, at long, n long, ids binary"),
                     "shard-tokens", **TOKEN_FILES)
    parts = encoded.groupBy("part").agg(F.sum("n").alias("n"))  # one row per task
    first = parts.select(F.col("part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_seq = -(-total // seq_len)
    # broadcast: one row of two numbers per task that encoded
    pieces = (encoded.join(F.broadcast(first), "part").select((F.col("first") + F.col("at")).alias("start"), "ids")
              .mapInArrow(cut_sequences(n_seq, seq_len, key), "slot long, offset int, ids binary"))
    n_shards = max(1, -(-n_seq // shard_slots))
    ranged = pieces.repartitionById(n_shards, F.floor(F.col("slot") / shard_slots).cast("int"))
    manifest = (ranged.sortWithinPartitions("slot", "offset")
                .mapInArrow(write_shards(folder, seq_len, shard_slots, end_id), MANIFEST_SCHEMA))
    return stored(manifest, "shard-manifest"), n_seq, total


def read_slots(manifest: DataFrame, n_seq: int, total: int, seq_len: int = SEQ_LEN, key: int = KEY) -> DataFrame:
    """Every record, read back in order: slot, seq, shard, byte_offset, n_tokens (without padding), sha256 of those."""
    stride = seq_len * DTYPE.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        for b in batches:
            for r in b.to_pylist():
                store, path = fs.FileSystem.from_uri(r["path"]) if "://" in r["path"] else (fs.LocalFileSystem(), r["path"])
                slots = np.arange(r["first_slot"], r["first_slot"] + r["n_slots"])
                seqs = permute(slots, n_seq, key, inverse=True)
                valid = np.where(seqs == n_seq - 1, total - (n_seq - 1) * seq_len, seq_len)
                sums = []
                with store.open_input_stream(path) as f:
                    for n in valid.tolist():
                        sums.append(hashlib.sha256(f.read(stride)[:n * DTYPE.itemsize]).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots), pa.array(seqs), pa.array([r["shard"]] * len(slots), pa.int64()),
                     pa.array((slots - r["first_slot"]) * stride), pa.array(valid), pa.array(sums)],
                    names=["slot", "seq", "shard", "byte_offset", "n_tokens", "sha256"])

    return (manifest.repartition("shard").select("shard", "path", "first_slot", "n_slots")
            .mapInArrow(run, "slot long, seq long, shard long, byte_offset long, n_tokens long, sha256 string"))


def read_slot(path: str, index: int, seq_len: int = SEQ_LEN) -> np.ndarray:
    """One record of a local shard, by its place."""
    return np.fromfile(path, DTYPE, seq_len, offset=index * seq_len * DTYPE.itemsize)


@query("op2_token_shards")
def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    folder = scratch_path(spark, "token-shards")
    manifest, n_seq, total = write_training_order(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return read_slots(manifest, n_seq, total)
