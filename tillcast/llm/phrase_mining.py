"""Phrase collocation mining by sampling, a negative border and exact passes (Toivonen).

A phrase is frequent only if every shorter phrase inside it is.  A sample of the
documents proposes words and pairs, by a threshold lowered below the sample's
share.  One pass over all documents then counts the proposals and their negative
border, the phrases whose parts are all proposed while they are not: every word,
every pair of proposed words, every triple of proposed pairs.  Where a border
phrase turns out frequent the sample has failed to propose it; it joins the
proposals, which widens the border, and a further pass counts what the border has
gained and nothing else.  Passes follow until no border phrase is frequent, so that
the sample decides how many passes there are and never what they find.

These passes count by hash: the phrases of a block of text leave a task as sorted
bins of 24-bit numbers, which takes three bytes for a phrase instead of a row.  Sums
by hash are never too small, so what they leave below the threshold is proven rare.
A last pass counts the rest by its words, which makes the result exact whatever
hashes collide.  Its tasks add up their blocks and send the phrases of a bin as one
compressed record batch, and not as a row each.

Proposals grow with the corpus, so tasks do not get them as a list but as bitmaps
of a fixed number of bits.  Phrases that share a bit with another one are counted
too; that costs work and changes no result.

Results for odd input: null and empty texts have no words; a null ``lang`` is
``und``; repeated rows and null ids count like any others, as ids are not read; a
language without candidates, and an empty table, gives no row; phrases that tie go
in byte order; texts of any length are cut at piece ends into blocks; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.common import LOWER, stored, table, whole_text
from tillcast.llm.registry import query

MIN_COUNT = 10
TOP = 2000
OVERLAP_PERCENT = 50    # a candidate goes if a longer one has this share of its count
SAMPLE = 0.25           # share of the documents that propose; any share gives the same result
LOWERED = (0.4, 0.8)    # of the sample's share of the threshold, for words and for pairs
BLOCK_BYTES = 3 << 20   # text whose phrases a task counts at a time
BITS = 1 << 25          # of each bitmap, one for each length of phrase: 4 MB
BINS = 1 << 9           # least number of bins of the hashed counts
BIN_BYTES = 16 << 20    # text of one bin
HELD_ROWS = 1 << 20     # phrases that a task of the last pass holds before it adds them up and sends them
SALTS = 64
NO_LANG = "und"

LOWERED_BYTES = np.frombuffer(LOWER, np.uint8)
# 0 in words, 1 blank between words, 2 end of a piece
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2

COUNTS = "lang string, size int, phrase string, n long"
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

# a random 64-bit number for each byte, the same in every task
LETTER = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair, from the hashes of its halves."""
    h = a * MIX[0] + b * MIX[1]
    h ^= h >> np.uint64(29)
    h *= MIX[1]
    return h ^ (h >> np.uint64(32))


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(x))
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """A polynomial in the bytes of each word, modulo 2**64."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[:at[-1]]
    total = np.r_[np.uint64(0), np.cumsum(LETTER[data] * _powers(int(MIX[0]), len(data)))]
    return (total[at[1:]] - total[at[:-1]]) * _powers(pow(int(MIX[0]), -1, 1 << 64), len(data) + 1)[at[:-1]]


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Block:
    """Words of a stretch of text, by number."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, langs: np.ndarray, names: list[str]):
        """``ends`` are the ends of the documents in ``data``, ``langs`` their languages by number."""
        kind = KIND[data]
        inside = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        edge[0] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts = np.flatnonzero(first)
        doc = np.searchsorted(ends, starts, "right")
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.joined = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(np.flatnonzero(last) - starts + 1, out=offsets[1:])
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWERED_BYTES[data[inside]])])
        found = words.dictionary_encode()
        vocab = found.dictionary
        size = max(len(vocab), 1)
        # a word of a language is one number
        at = langs[doc].astype(np.int64) * size + found.indices.to_numpy(zero_copy_only=False)
        if len(names) * size <= 4 * len(at) + 1024:
            n = np.bincount(at, minlength=len(names) * size)
            used = np.flatnonzero(n)
            number = np.cumsum(n > 0) - 1
            self.word, self.n = number[at], n[used]
        else:
            used, self.word, self.n = np.unique(at, return_inverse=True, return_counts=True)
        self.lang = pa.array(names, pa.string()).take(pa.array(used // size))
        self.text = vocab.take(pa.array(used % size))
        seeds = np.array([xxhash.xxh64_intdigest(x, 42) for x in names], np.uint64)
        self.hash = _mix(word_hashes(vocab)[used % size], seeds[used // size]) if len(used) else np.empty(0, np.uint64)

    def _pairs(self, good: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct pairs of ``good`` words: (left, right, hash, n), and the number of the pair at each word, or -1."""
        w, k = self.word, max(len(self.hash), 1)
        at = np.flatnonzero(self.joined & good[w[:-1]] & good[w[1:]])
        keys, pair, n = np.unique(w[:-1][at] * k + w[1:][at], return_inverse=True, return_counts=True)
        number = np.full(len(w), -1, np.int64)
        number[at] = pair
        return keys // k, keys % k, _mix(self.hash[keys // k], self.hash[keys % k]), n, number

    @staticmethod
    def _triples(number: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct triples of ``good`` pairs: (first pair, second pair, n)."""
        k = max(len(good), 1)
        x, y = number[:-1], number[1:]
        at = np.flatnonzero((x >= 0) & (y >= 0))
        at = at[good[x[at]] & good[y[at]]]
        keys, n = np.unique(x[at] * k + y[at], return_counts=True)
        return keys // k, keys % k, n

    def hashed(self, now: list | None, before: list | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, hashes, counts) of the phrases that ``now`` admits and ``before`` did not; without ``now``,
        of all words and pairs."""
        if not len(self.word):
            return
        if before is None:
            yield 1, self.hash, self.n
        every = np.ones(len(self.hash), bool)
        a, b, h, n, number = self._pairs(every if now is None else has(now[0], self.hash))
        old = np.zeros(len(h), bool)
        if before is not None:
            known = has(before[0], self.hash)
            old = known[a] & known[b]
        yield 2, h[~old], n[~old]
        if now is None:
            return
        x, y, n = self._triples(number, has(now[1], h))
        if before is not None:
            old &= has(before[1], h)
            new = ~(old[x] & old[y])
            x, y, n = x[new], y[new], n[new]
        yield 3, _mix(h[x], self.hash[b[y]]), n

    def phrases(self, bits: list) -> Iterator[pa.RecordBatch]:
        """Counts of the phrases with a bit in ``bits``, by their words, with the place of the bit."""
        def rows(size, first, text, n, h):
            return pa.RecordBatch.from_arrays([self.lang.take(pa.array(first)), pa.array(np.full(len(n), size, np.int32)), text,
                                               pa.array(n, pa.int64()), pa.array((h & np.uint64(BITS - 1)).astype(np.int64))],
                                              names=["lang", "size", "phrase", "n", "at"])

        if not len(self.word):
            return
        word = lambda i: self.text.take(pa.array(i))
        good = has(bits[0], self.hash)
        k = np.flatnonzero(good)
        yield rows(1, k, word(k), self.n[k], self.hash[k])
        a, b, h, n, number = self._pairs(good)
        good = has(bits[1], h)
        k = np.flatnonzero(good)
        yield rows(2, a[k], pc.binary_join_element_wise(word(a[k]), word(b[k]), " "), n[k], h[k])
        x, y, n = self._triples(number, good)
        h = _mix(h[x], self.hash[b[y]])
        k = np.flatnonzero(has(bits[2], h))
        x, y, n = x[k], y[k], n[k]
        yield rows(3, a[x], pc.binary_join_element_wise(word(a[x]), word(b[x]), word(b[y]), " "), n, h[k])


def _cuts(data: np.ndarray, ends: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``block`` bytes that end where a document or a piece ends."""
    start, n = 0, len(data)
    while start < n:
        stop = min(start + block, n)
        if stop < n:
            k = np.searchsorted(ends, stop, "right") - 1
            if k >= 0 and ends[k] > start:
                stop = int(ends[k])
            else:  # inside one long document
                end, width = int(ends[np.searchsorted(ends, start, "right")]), block
                while (stop := min(start + width, end)) < end:
                    brk = np.flatnonzero(KIND[data[start:stop]] == 2)
                    if len(brk):
                        stop = start + int(brk[-1]) + 1
                        break
                    width *= 2
        yield start, stop
        start = stop


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    """Texts of a task, ``size`` bytes at a time."""
    def cut(held: list[pa.RecordBatch]) -> Iterator[Block]:
        t = pa.Table.from_batches(held).combine_chunks()
        text, codes = t.column("text").chunk(0), t.column("lang").chunk(0).dictionary_encode()
        at = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
        if at[-1] == at[0]:
            return
        data = np.frombuffer(text.buffers()[2], np.uint8)[at[0]:at[-1]]
        ends, langs = at[1:] - at[0], codes.indices.to_numpy(zero_copy_only=False)
        names = codes.dictionary.to_pylist()
        for a, b in _cuts(data, ends, size):
            i, j = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1
            yield Block(data[a:b], np.minimum(ends[i:j], b) - a, langs[i:j], names)

    held, held_bytes = [], 0
    for b in batches:
        text = b.column("text")
        if not b.num_rows:
            continue
        if held and held_bytes + text.nbytes > size:
            yield from cut(held)
            held, held_bytes = [], 0
        held.append(b)
        held_bytes += text.nbytes
    if held:
        yield from cut(held)


# ------------------------------------------------------------------ counts by hash
def hash_counter(now: list | None, before: list | None, bins: int, block: int):
    """For each block, length and bin: hashes (24 bits beside those of the bin) found once, and others with counts."""
    width = np.uint64(BITS // bins)
    three = lambda r: r.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blk in blocks(batches, block):
            for size, h, n in blk.hashed(now, before):
                # the bitmap's bits choose the bin, the bin's own bits and the upper ones are kept
                at = ((h & np.uint64(BITS - 1)) // width).astype(np.int64)
                rest = ((h & (width - np.uint64(1))) | (h >> np.uint64(32)) // width * width).astype("<u4")
                by = np.argsort(at, kind="stable")
                at, rest, n = at[by], rest[by], np.minimum(n[by], 255).astype(np.uint8)
                found, first = np.unique(at, return_index=True)
                cut = [*first.tolist(), len(at)]
                parts = [(rest[i:j], n[i:j]) for i, j in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array((size * BITS + found).astype(np.int64)),
                    pa.array([three(r[k == 1]) for r, k in parts], pa.binary()),
                    pa.array([three(r[k > 1]) for r, k in parts], pa.binary()),
                    pa.array([k[k > 1].tobytes() for r, k in parts], pa.binary()),
                ], names=["bin", "once", "more", "counts"])
    return run


def frequent_bits(bins: int, least: tuple[int, ...]):
    """For each bin its piece of the bitmap of hashes that are found ``least`` times, by length."""
    width = BITS // bins

    def numbers(raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // 3, 4), np.uint8)
        out[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return out.view("<u4").ravel()

    def done(k: int, held: list[tuple]) -> pa.RecordBatch:
        once, more, counts = (b"".join(x) for x in zip(*held))
        h = np.concatenate([numbers(once), numbers(more)])
        n = np.concatenate([np.ones(len(once) // 3, np.int64), np.frombuffer(counts, np.uint8).astype(np.int64)])
        by = np.argsort(h, kind="stable")
        h, n = h[by], n[by]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        total = np.add.reduceat(n, first)
        piece = np.zeros(width, np.uint8)
        piece[h[first][total >= least[k // BITS - 1]] & (width - 1)] = 1
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(piece, bitorder="little").tobytes()], pa.binary())],
                                          names=["bin", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("bin", "once", "more", "counts"))):
                if r[0] != now and held:
                    yield done(now, held)
                    held = []
                now = r[0]
                held.append(r[1:])
        if held:
            yield done(now, held)
    return run


def hashed_bitmaps(texts: DataFrame, now: list | None, before: list | None, least: tuple[int, ...], bins: int, block: int) -> list[np.ndarray]:
    """Bitmaps of the words, pairs and triples whose hashes are found ``least`` times: ``3 * BITS`` bits in all."""
    found = (texts.mapInArrow(hash_counter(now, before, bins, block), "bin long, once binary, more binary, counts binary")
                  .repartition("bin").sortWithinPartitions("bin").mapInArrow(frequent_bits(bins, least), "bin long, bits binary"))
    out = [np.zeros(BITS // 8, np.uint8) for _ in range(3)]
    width = BITS // bins // 8
    for r in found.collect():
        size, k = divmod(r["bin"], BITS)
        out[size - 1][k * width:(k + 1) * width] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _added(tables: list[pa.Table]) -> pa.Table:
    """Rows of the same phrase as one."""
    keys = [c for c in tables[0].column_names if c != "n"]
    t = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum")])
    return t.rename_columns(["n" if c == "n_sum" else c for c in t.column_names])


def phrase_counter(bits: list, bins: int, block: int):
    """For each bin its phrases with their counts, as a compressed record batch."""
    width = BITS // bins

    def send(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t, packed = _added(held), pa.ipc.IpcWriteOptions(compression="zstd")
        at = t.column("at").to_numpy() // width
        by = np.argsort(at, kind="stable")
        t = t.select(["lang", "size", "phrase", "n"]).take(pa.array(by)).combine_chunks()
        found, first = np.unique(at[by], return_index=True)
        for i in range(0, len(found), 64):
            raw = []
            for k, stop in zip(first[i:i + 64].tolist(), [*first[i + 1:i + 65].tolist(), len(by)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=packed) as out:
                    out.write_table(t.slice(k, stop - k))
                raw.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(found[i:i + 64], pa.int64()), pa.array(raw, pa.binary())], names=["bin", "phrases"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for blk in blocks(batches, block):
            for rows in blk.phrases(bits):
                held.append(pa.Table.from_batches([rows]))
                n += rows.num_rows
            # all words of a language as one row
            if len(blk.word):
                t = pa.table({"lang": blk.lang, "n": blk.n}).group_by("lang").aggregate([("n", "sum")])
                held.append(pa.table({"lang": t.column("lang"), "size": pa.array([0] * len(t), pa.int32()), "phrase": [""] * len(t),
                                      "n": t.column("n_sum").cast(pa.int64()), "at": pa.array([0] * len(t), pa.int64())}))
            if n >= HELD_ROWS:
                yield from send(held)
                held, n = [], 0
        if held:
            yield from send(held)
    return run


def phrase_sums(min_count: int):
    """For each bin the phrases found ``min_count`` times, and the words of each language."""
    def done(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        t = _added([pa.ipc.open_stream(x).read_all() for x in held])
        t = t.filter(pc.or_(pc.greater_equal(t.column("n"), min_count), pc.equal(t.column("size"), 0)))
        yield from t.select(["lang", "size", "phrase", "n"]).to_batches(1 << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for k, raw in zip(b.column("bin").to_pylist(), b.column("phrases").to_pylist()):
                if k != now and held:
                    yield from done(held)
                    held = []
                now = k
                held.append(raw)
        if held:
            yield from done(held)
    return run


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, sample: float = SAMPLE,
                     block: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of every phrase of 1 to 3 words found ``min_count`` times, and (lang, n) of all words."""
    if min_count > 255:
        raise ValueError("counts by hash are kept up to 255")
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), whole_text().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins = BINS
    while bins < BITS // 8 and size > bins * BIN_BYTES:
        bins *= 2
    least = tuple(max(1, int(low * sample * min_count)) for low in LOWERED)
    now = hashed_bitmaps(texts.sample(sample, 7), None, None, least, bins, block)
    before, found = None, [np.zeros(BITS // 8, np.uint8) for _ in range(3)]
    while True:
        got = hashed_bitmaps(texts, now, before, (min_count,) * 3, bins, block)
        found = [a | b for a, b in zip(found, got)]
        wider = [a | b for a, b in zip(now, got)]
        if (wider[0] == now[0]).all() and (wider[1] == now[1]).all():
            break  # no border phrase is frequent
        before, now = now, wider
    n = (texts.mapInArrow(phrase_counter(found, bins, block), "bin long, phrases binary")
              .repartition("bin").sortWithinPartitions("bin").mapInArrow(phrase_sums(min_count), COUNTS))
    n = stored(n, "phrases")
    return n.where(F.col("size") > 0), n.where(F.col("size") == 0).select("lang", F.col("n").alias("n_words"))


def collocations(found: DataFrame, total: DataFrame, top: int = TOP, overlap_percent: int = OVERLAP_PERCENT) -> DataFrame:
    """The best ``top`` phrases of each language by the lowest score of their cuts."""
    cand = found.where(F.col("size") > 1).withColumn("w", F.split("phrase", " "))
    part = lambda i, j: F.concat_ws(" ", F.slice("w", i, j))
    cut = lambda k: F.struct(F.lit(k).alias("k"), part(1, k).alias("left"))
    cuts = cand.select("lang", "size", "phrase", F.col("n").alias("a"),
                       F.explode(F.when(F.col("size") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))).alias("c"))
    cuts = cuts.select("lang", "size", "phrase", "a", "c.*")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
        if side == "left":  # the rest of a phrase isn't sent with its first part
            cuts = cuts.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumns({"top": F.lit(1000000).cast("decimal(38,0)") * big("a") * big("a"), "under": big("l") * big("r")})
    cuts = cuts.withColumn("score", F.expr("top div under"))
    worst = cuts.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inside = F.explode(F.array(part(1, 2), part(2, 2)))
    longer = (cand.where(F.col("size") == 3).select("lang", inside.alias("phrase"), F.col("n").alias("m"))
                  .groupBy("lang", "phrase").agg(F.max("m").alias("m"), F.lit(2).alias("size")))
    left = (worst.join(longer, ["lang", "phrase", "size"], "left")
                 .where(F.col("m").isNull() | (100 * F.col("m") < overlap_percent * F.col("a"))))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    left = left.select("lang", "phrase", "a", "c.l", "c.r", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("s"))
    # the best of each shard, then the best of those: a task sorts a shard, or SALTS * top rows at most
    few = left.withColumn("i", F.row_number().over(Window.partitionBy("lang", "s").orderBy(*order))).where(F.col("i") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return (best.join(total, "lang")
                .select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score"))


SQL = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
  p AS (SELECT lang, row_number() OVER () AS d, regexp_extract_all(x, '[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+') AS w FROM t),
  q AS (SELECT lang, d, unnest(w) AS w, unnest(range(len(w))) AS i FROM p),
  o AS (SELECT lang, d, i, CASE WHEN w NOT IN ('.', ',', ';', ':', '!', '?', chr(10), chr(11), chr(12), chr(13)) THEN w END AS w FROM q),
  g AS (SELECT lang, w, lead(w) OVER (PARTITION BY d ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY d ORDER BY i) AS w3 FROM o),
  f AS (SELECT lang, 1 AS k, w AS phrase, count(*) AS n FROM g WHERE w IS NOT NULL GROUP BY lang, w
    UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) FROM g WHERE w || w2 IS NOT NULL GROUP BY lang, w || ' ' || w2
    UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w || w2 || w3 IS NOT NULL
      GROUP BY lang, w || ' ' || w2 || ' ' || w3),
  c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
  s AS (SELECT lang, k, phrase, a, 1 AS cut, w[1] AS x, array_to_string(w[2:3], ' ') AS y FROM c
    UNION ALL SELECT lang, k, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM c WHERE k = 3),
  e AS (SELECT lang, phrase, n FROM f WHERE n >= 10),
  u AS (SELECT s.lang, s.k, s.phrase, s.a, s.cut, l.n AS l, r.n AS r,
      CAST(1000000 * CAST(s.a AS HUGEINT) * s.a // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
    FROM s JOIN e l ON l.lang = s.lang AND l.phrase = s.x JOIN e r ON r.lang = s.lang AND r.phrase = s.y),
  m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  z AS (SELECT lang, phrase, max(a) AS top FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3
      UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY lang, phrase),
  d AS (SELECT m.* FROM m LEFT JOIN z ON z.lang = m.lang AND z.phrase = m.phrase WHERE z.top IS NULL OR 100 * z.top < 50 * m.a),
  n AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM d JOIN n ON n.lang = d.lang QUALIFY rank <= 2000"""


@query("op11_phrase_collocations", SQL)
def op11_phrase_collocations(spark, sf_dir):
    """The 2,000 best phrases of each language of ``documents``."""
    return collocations(*frequent_phrases(table(spark, sf_dir, "documents")))
