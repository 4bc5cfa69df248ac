"""N-gram Jaccard self-join: token-combination prefixes, bitmap bounds, exact verification.

A document is its set of distinct word shingles, hashed to 64 bits; equal sets
are one node, named by a 128-bit digest.  Tokens have one global order: rare
ones first, frequent ones last and by rising count.  A pair at or above the
threshold shares a token within the first n - ceil(t * n) + 1 of each side
(prefix), and two within one more (extended prefix).  Rare and middling tokens
are indexed singly.  The most frequent class is indexed by 2-token combinations
of the extended prefix, for nodes up to ``COMBO_TOKENS`` tokens; longer nodes,
and those short enough to reach across that limit, list its tokens singly too.

Pairs inside a bucket must pass the length, position and bitmap bounds, which
hold for every true link.  They are not all emitted: first each member meets a
few hubs, and the verified links give components; then only pairs across
components are emitted and verified.  A bucket larger than ``CHUNK`` members is
cut into chunks, and pairs of chunks are separate units of work, so nothing is
capped and no task holds a whole bucket.

Results for odd input: null, empty and blank texts have no shingles and are
their own component; fewer words than a shingle give one shingle of all words;
rows that repeat a doc_id or a text each give their row; a null doc_id takes the
least id of its component, null if there is none; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import LOWER, packed, row_slices, stored, table, whole_text
from tillcast.llm.components import components
from tillcast.llm.registry import query

SHINGLE_WORDS = 5
THRESHOLD = (80, 100)

SLAB_TOKENS = 1 << 20    # tokens whose repeats are counted together while looking for frequent ones
SLAB_REPEATS = 4         # a token this often in one slab is reported
FREQUENT_TOKENS = 1 << 17  # bound of the frequent-token list, which every task gets
COMBO_SHARE = 16         # the class with combinations: in a 16th of the nodes or more
COMBO_TOKENS = 256
CHUNK = 1024
ALL_PAIRS = 4            # buckets up to this size are compared in full in the first round
HUBS = 2
BITMAP_WORDS = 8         # 512 bits
FILTER_BITS = 1 << 24    # of the filter for documents whose sets are needed

U = np.uint64


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a lower-cased text."""
    w = text.translate(LOWER).split()
    if not w:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), U, len(w))
    if len(h) < words:
        h = np.concatenate([h, np.zeros(words - len(h), U)])
    n = len(h) - words + 1
    s = np.zeros(n, U)
    for i in range(words):
        s = (s ^ h[i:i + n]) * U(0x9E3779B97F4A7C15)
        s ^= s >> U(29)
    s *= U(0xBF58476D1CE4E5B9)
    s ^= s >> U(32)
    return np.unique(s)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in each of 512 cells: cells that differ bound the symmetric difference from below."""
    cells = np.bincount((tokens >> U(55)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(cells.astype(np.uint8)).tobytes()


def _fixed(data: bytes, width: int, n: int) -> pa.Array:
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


DOC_SCHEMA = "doc_id long, n long, sig binary, bits binary, token long, cnt long"


def scan_documents(words: int):
    """A row per document, and rows (token, cnt) for tokens that repeat among the distinct sets of a slab."""
    def frequent(slab: list[np.ndarray]) -> pa.RecordBatch:
        t, c = np.unique(np.concatenate(slab), return_counts=True)
        t, c = t[c >= SLAB_REPEATS], c[c >= SLAB_REPEATS]
        none = lambda kind: pa.nulls(len(t), kind)
        return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.binary()), none(pa.binary()),
                                           pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))],
                                          names=["doc_id", "n", "sig", "bits", "token", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, seen, size = [], set(), 0
        for b in row_slices(batches, "text"):
            ns, sigs, bits = [], [], []
            for text in _texts(b):
                s = shingles(text, words)
                sig = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                ns.append(len(s))
                sigs.append(sig)
                bits.append(bitmap(s) if len(s) else None)
                if sig and sig not in seen:
                    seen.add(sig)
                    slab.append(s)
                    size += len(s)
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()),
                                              pa.array(bits, pa.binary()), none, none],
                                             names=["doc_id", "n", "sig", "bits", "token", "cnt"])
            if size >= SLAB_TOKENS:
                yield frequent(slab)
                slab, seen, size = [], set(), 0
        if slab:
            yield frequent(slab)
    return run


def index_documents(words: int, t: tuple[int, int], tokens: np.ndarray, rank: np.ndarray, combo_rank: int):
    """Prefix entries (key, id, n, pos) of each distinct set that a task meets; id is the first half of its digest.

    ``tokens`` are the frequent tokens, sorted, with their rank from 1; those of
    rank ``combo_rank`` and above form the class that is indexed by combinations.
    An entry at pos promises that at most n - pos tokens can be shared.
    """
    num, den = t
    single_from = -(-num * COMBO_TOKENS // den)

    def entries(s: np.ndarray):
        n = len(s)
        p = n - -(-num * n // den) + 1
        at = np.minimum(np.searchsorted(tokens, s), max(len(tokens) - 1, 0))
        r = np.where(tokens[at] == s, rank[at], 0) if len(tokens) else np.zeros(n, np.int64)
        o = np.lexsort((s, r))[:p + 1]
        prefix, cls = s[o], r[o] >= combo_rank
        pos = np.flatnonzero(~cls[:p] if n < single_from else np.ones(min(p, n), bool))
        keys, places = prefix[pos], pos
        if n <= COMBO_TOKENS and cls.any():
            c = np.flatnonzero(cls)
            i, j = np.triu_indices(len(c), 1)
            i, j = c[i], c[j]
            keys = np.concatenate([keys, (prefix[i] * U(0x9E3779B97F4A7C15)) ^ (prefix[j] * U(0xC2B2AE3D27D4EB4F) + U(1))])
            places = np.concatenate([places, j - 1])
        return n, keys, places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in row_slices(batches, "text"):
            keys, ids, ns, places = [], [], [], []
            for text in _texts(b):
                s = shingles(text, words)
                if not len(s) or (sig := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sig)
                n, k, p = entries(s)
                keys.append(k)
                places.append(p)
                ids.append(np.full(len(k), int.from_bytes(sig[:8], "big", signed=True), np.int64))
                ns.append(np.full(len(k), n, np.int32))
            if keys:
                k = np.concatenate(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(ns)),
                     pa.array(np.concatenate(places).astype(np.int32))], names=["key", "id", "n", "pos"])
    return run


BUCKET_SCHEMA = "key long, chunk int, cut boolean, size int, id long, n int, pos int"


def _bytes_of(col: pa.Array, width: int) -> np.ndarray:
    """A binary column of equally long values as a matrix of bytes."""
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(len(col), width)


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Sorted input regrouped so that no key is split, unless it has over ``most`` rows: (rows, goes on)."""
    held = None
    for b in batches:
        t = b if held is None else pa.concat_batches([held, b])
        if not t.num_rows:
            continue
        edge = _starts(t, keys)
        done = int(edge[-1])  # the last key may go on in the next batch
        if done:
            yield t.slice(0, done), False
        elif t.num_rows > most:
            done = t.num_rows
            yield t, True
        held = t.slice(done) if done < t.num_rows else None
    if held is not None and held.num_rows:
        yield held, False


def _starts(t: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """First row of each key."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in keys:
        v = t.column(t.schema.get_field_index(c)).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of keys that two sets or more have, in chunks; input is sorted by key, n, id, pos."""
    open_key, rank0, last = None, 0, None  # of a key that is passed on in pieces
    for t, goes_on in _whole_runs(batches, ["key"], 8 * CHUNK):
        key, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        if open_key is not None and key[0] == open_key and ids[0] == last:
            new[0] = False
        t, key, ids = t.filter(pa.array(new)), key[new], ids[new]
        if not len(key):
            continue
        first = _starts(t, ["key"])
        size = np.diff(np.r_[first, len(key)])
        rank = np.arange(len(key)) - np.repeat(first, size)
        cut = np.repeat(size > CHUNK, size)
        many = np.repeat(size > 1, size)
        if goes_on or key[0] == open_key:  # a piece: chunk numbers follow the piece before
            piece = key == key[0]
            rank[piece] += rank0 if key[0] == open_key else 0
            cut[piece] = many[piece] = True
            rank0 = int(rank[piece][-1]) + 1
        open_key, last = (int(key[-1]), int(ids[-1])) if goes_on else (None, None)
        rank0 = rank0 if goes_on else 0
        yield pa.RecordBatch.from_arrays(
            [t.column(0), pa.array((rank // CHUNK).astype(np.int32)), pa.array(cut),
             pa.array(np.repeat(size, size).astype(np.int32)), t.column(1), t.column(2), t.column(3)],
            names=["key", "chunk", "cut", "size", "id", "n", "pos"]).filter(pa.array(many))


PAIR_SCHEMA = "a binary, b binary"


class Members:
    """Rows of units of work as arrays."""

    def __init__(self, t: pa.RecordBatch):
        col = lambda c: t.column(t.schema.get_field_index(c))
        self.sig = np.ascontiguousarray(_bytes_of(col("sig"), 16)).view(">u8")
        self.label = np.ascontiguousarray(_bytes_of(col("label"), 16)).view(U)
        self.n = col("n").to_numpy().astype(np.int64)
        self.reach = self.n - col("pos").to_numpy()
        self.bits = np.ascontiguousarray(_bytes_of(col("bits"), 8 * BITMAP_WORDS)).view(U)
        self.side = col("side").to_numpy()

    def possible(self, i: np.ndarray, j: np.ndarray, t: tuple[int, int]) -> np.ndarray:
        """Which pairs (i, j) the length, position and bitmap bounds admit."""
        num, den = t
        total = self.n[i] + self.n[j]
        need = -(-num * total // (num + den))
        ok = (np.minimum(self.reach[i], self.reach[j]) >= need) & (self.sig[i] != self.sig[j]).any(axis=1)
        k = np.flatnonzero(ok)
        differ = np.bitwise_count(self.bits[i[k]] ^ self.bits[j[k]]).sum(axis=1, dtype=np.int64)
        ok[k] = differ <= total[k] - 2 * need[k]
        return ok


def compare_units(t: tuple[int, int], first_round: bool):
    """Pairs to verify.

    First round: all pairs of small units; in a larger one, each member with the
    hubs, or else with the first member that passes, so that every node that has
    a possible partner is in a pair.  Second round: pairs with different labels.
    """
    def large(m: Members, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        every = np.arange(lo, hi)
        across = m.side[lo:hi].any()  # a pair of chunks: left against right only
        hubs = np.isin(every, every[np.argsort(m.sig[lo:hi, 0], kind="stable")[:HUBS]])  # alike in all buckets of a group
        met = np.zeros(hi - lo, bool)
        partner = np.full(hi - lo, -1, np.int64)
        for at in range(lo, hi, 128):
            rows = every[at - lo:at - lo + 128]
            i, j = np.repeat(rows, hi - lo), np.tile(every, len(rows))
            k = i < j
            if across:
                k &= m.side[i] != m.side[j]
            if not first_round:
                k &= (m.label[i] != m.label[j]).any(axis=1)
            i, j = i[k], j[k]
            k = m.possible(i, j, t)
            i, j = i[k], j[k]
            if first_round:
                k = hubs[i - lo] | hubs[j - lo]
                met[i[k] - lo] = met[j[k] - lo] = True
                partner[j - lo] = np.where(partner[j - lo] < 0, i, partner[j - lo])
                partner[i - lo] = np.where(partner[i - lo] < 0, j, partner[i - lo])
                i, j = i[k], j[k]
            yield i, j
        if first_round:
            alone = np.flatnonzero(~met & (partner >= 0))
            yield alone + lo, partner[alone]

    def pairs(m: Members, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in range(2, ALL_PAIRS + 1) if first_round else ():
            g = first[size == s]
            x, y = np.triu_indices(s, 1)
            i, j = (g[:, None] + x).ravel(), (g[:, None] + y).ravel()
            k = m.possible(i, j, t)
            k[k] = (m.side[i[k]] != m.side[j[k]]) | (m.side[i[k]] == 0)  # right against right is another unit's work
            yield i[k], j[k]
        for lo, n in zip(first[size > ALL_PAIRS].tolist(), size[size > ALL_PAIRS].tolist()):
            if first_round or (m.label[lo:lo + n] != m.label[lo]).any():
                yield from large(m, lo, lo + n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def emit():
            p = np.concatenate(held)
            swap = (p[:, 0] > p[:, 2]) | ((p[:, 0] == p[:, 2]) & (p[:, 1] > p[:, 3]))
            p[swap] = p[swap][:, [2, 3, 0, 1]]
            p = np.unique(p, axis=0).astype(">u8")  # pairs of near copies turn up under many keys of a task
            a, b = np.ascontiguousarray(p[:, :2]), np.ascontiguousarray(p[:, 2:])
            return pa.RecordBatch.from_arrays([_fixed(a.tobytes(), 16, len(p)), _fixed(b.tobytes(), 16, len(p))], names=["a", "b"])

        for batch, _ in _whole_runs(batches, ["key", "c1", "c2"], 1 << 30):  # a unit has two chunks at most
            m = Members(batch)
            first = _starts(batch, ["key", "c1", "c2"])
            for i, j in pairs(m, first, np.diff(np.r_[first, batch.num_rows])):
                held.append(np.hstack([m.sig[i], m.sig[j]]).astype(U))
                rows += len(i)
            if rows > 200_000:
                yield emit()
                held, rows = [], 0
        if rows:
            yield emit()
    return run


def bucket_units(buckets: DataFrame, nodes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Members under the units (key, c1, c2) that compare them; nodes has sig, bits, label.

    Should two nodes share the half digest that the index holds, both take part.
    """
    num, den = t
    whole = buckets.where("not cut").select("key", F.lit(0).alias("c1"), F.lit(0).alias("c2"), F.lit(0).alias("side"), "id", "n", "pos")
    cut = buckets.where("cut")
    span = cut.groupBy("key", "chunk").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    left = span.select("key", F.col("chunk").alias("c1"), F.col("most").alias("most1"))
    right = span.select("key", F.col("chunk").alias("c2"), F.col("least").alias("least2"))
    units = left.join(right, "key").where((F.col("c1") <= F.col("c2")) & (F.col("least2") * num <= F.col("most1") * den)).select("key", "c1", "c2")
    parts = (units.select("key", "c1", "c2", F.col("c1").alias("chunk"), F.lit(0).alias("side"))
             .unionByName(units.where("c1 < c2").select("key", "c1", "c2", F.col("c2").alias("chunk"), F.lit(1).alias("side"))))
    spread = cut.join(parts, ["key", "chunk"]).select("key", "c1", "c2", "side", "id", "n", "pos")
    half = F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long")
    return (whole.unionByName(spread).join(nodes.withColumn("id", half), "id")
            .repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2", "side", "n", "sig")
            .select("key", "c1", "c2", "side", "sig", "n", "pos", "bits", "label"))


SET_SCHEMA = "sig binary, tokens array<long>, parity binary"


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each cell of ``FILTER_BITS`` that an id falls in; null ids use cell 0.

    Its size is fixed.  Where there are too many ids for it, more rows pass and
    more sets are written; what is verified stays the same.
    """
    cell = F.coalesce(F.pmod("_rep", F.lit(FILTER_BITS)), F.lit(0)).cast("long")
    words = (ids.select(cell.alias("c")).groupBy(F.floor(F.col("c") / 64).cast("int").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(c % 64 as int))")).alias("v")).toPandas())
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out.view(U)


def wide_parity(tokens: np.ndarray) -> bytes:
    """Parity of the tokens by their low bits, in 4 to 8 cells a token: a bound close to the symmetric difference."""
    cells = 1 << max(6, int(4 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def parity_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference; the longer parity is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def within_bound(t: tuple[int, int]):
    """Of pairs with sizes and parities, those that may reach the threshold."""
    num, den = t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            most = total - 2 * -(-num * total // (num + den))
            ok = [parity_difference(x.as_py(), y.as_py()) <= m for x, y, m in zip(b.column(4), b.column(5), most.tolist())]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))
    return run


def token_sets(words: int, wanted: np.ndarray):
    """Sets of the documents whose id passes the filter."""
    def passing(batches):
        for b in batches:
            cell = np.array([0 if x is None else x % FILTER_BITS for x in b.column(0).to_pylist()], np.int64)
            yield b.filter(pa.array((wanted[cell >> 6] >> (cell & 63).astype(U) & U(1)).astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(passing(batches), "text"):
            sets = [s for s in (shingles(x, words) for x in _texts(b)) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                 pa.array([wide_parity(s) for s in sets], pa.binary())], names=["sig", "tokens", "parity"])
    return run


def verified(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Edges (u, v) among ``pairs`` whose sets reach the threshold, exactly.

    Parities, a sixteenth of the sets' bytes, meet first; whole sets are moved
    only for pairs that they leave possible.
    """
    num, den = t
    left = sets.select(F.col("sig").alias("a"), F.size("tokens").alias("na"), F.col("parity").alias("pa"))
    right = sets.select(F.col("sig").alias("b"), F.size("tokens").alias("nb"), F.col("parity").alias("pb"))
    pairs = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb")
                   .mapInArrow(within_bound(t), PAIR_SCHEMA).distinct(), "shingle-possible")
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "shingle-ends")
    sets = sets.join(ends, "sig", "left_semi")
    a = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x"))
    b = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    total = (F.size("x") + F.size("y")).cast("long")
    return (pairs.join(a, "a").join(b, "b").where(shared * (num + den) >= total * num)
            .select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Links: Jaccard similarity of the shingle sets at or above threshold[0] /
    threshold[1], which must be 2/3 or more (two links share two tokens at least).
    """
    num, den = threshold
    if 3 * num < 2 * den:
        raise ValueError("the threshold must be 2/3 or more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    texts = rows.select("doc_id", "text")
    scan = stored(texts.mapInArrow(scan_documents(words), DOC_SCHEMA), "shingle-scan")
    found = scan.where("token is null").select("doc_id", "n", "sig", "bits")
    nodes = stored(found.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits")), "shingle-nodes")
    top = (scan.where("token is not null").groupBy("token").agg(F.sum("cnt").alias("cnt"))
           .orderBy(F.col("cnt").desc(), "token").limit(FREQUENT_TOKENS).toPandas())
    tokens = top["token"].to_numpy(np.int64).view(U)
    rank = np.arange(len(tokens), 0, -1, dtype=np.int64)  # rising with the count
    combo_rank = len(tokens) + 1 - int((top["cnt"].to_numpy() * COMBO_SHARE >= nodes.count()).sum())
    o = np.argsort(tokens)
    entries = texts.select("text").mapInArrow(index_documents(words, threshold, tokens[o], rank[o], max(combo_rank, 1)),
                                              "key long, id long, n int, pos int")
    buckets = stored(entries.repartition("key").sortWithinPartitions("key", "n", "id", "pos")
                     .mapInArrow(shared_buckets, BUCKET_SCHEMA), "shingle-buckets")

    units = bucket_units(buckets, nodes.select("sig", "bits", F.col("sig").alias("label")), threshold)
    first = stored(units.mapInArrow(compare_units(threshold, True), PAIR_SCHEMA).distinct(), "shingle-pairs")
    alive = first.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = id_filter(alive.join(nodes, "sig").select(F.col("doc_id").alias("_rep")))
    sets = stored(texts.mapInArrow(token_sets(words, wanted), SET_SCHEMA), "shingle-sets")

    links = stored(verified(first, sets, threshold), "shingle-links")
    roots = components(links)
    labels = nodes.select("sig", "bits").join(roots.withColumnRenamed("node", "sig"), "sig", "left").select(
        "sig", "bits", F.coalesce("root", "sig").alias("label"))
    second = (bucket_units(buckets.where(F.col("cut") | (F.col("size") > ALL_PAIRS)), labels, threshold).mapInArrow(compare_units(threshold, False), PAIR_SCHEMA).distinct())
    more = stored(verified(second, sets, threshold), "shingle-links")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))

    named = nodes.select("sig", "doc_id").join(roots.withColumnRenamed("node", "sig"), "sig", "left").select(
        "sig", F.coalesce("root", "sig").alias("root"), "doc_id")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ends = stored(named.join(least, "root").select("sig", "component_id"), "shingle-components")
    return found.join(ends, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The documents with one row of each component, that of the least id (null last).

    Rows are told apart by a hash of all their columns, or, where two rows share it, by
    a number that is written with them; so rows that repeat an id, or have none, are
    judged one by one.  Columns may have any names.
    """
    rows = docs.select(packed(docs).alias("row"))
    rows = rows.withColumn("key", F.xxhash64("row"))
    if not rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "shingle-rows", compression="zstd")
    near = near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), words, threshold)
    near = stored(near.select(F.col("doc_id").alias("key"), "component_id"), "shingle-near")
    shared = near.where(F.col("key") != F.col("component_id")).select("component_id").distinct()
    doc_id = F.col("row.doc_id").cast("long")
    members = (near.join(shared, "component_id", "left_semi")
                   .join(rows.select("key", doc_id.isNull().alias("nul"), doc_id.alias("id")), "key"))
    best = members.groupBy("component_id").agg(F.min(F.struct("nul", "id", "key")).alias("best"))
    gone = stored(members.join(best, "component_id").where(F.col("key") != F.col("best.key")).select("key"), "shingle-gone")
    return rows.join(gone, "key", "left_anti").select("row.*")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS at FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.at = b.x)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.at) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query("op9_shingle_join", SQL)
def op9_shingle_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, threshold=(85, 100))
