"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read as a protobuf message: pieces with scores and types, the
trainer's kind and flags, and the normaliser.  From these a tokenizer is built:
the normaliser (its compiled character map, extra-space rule and metaspace
marker), the model (unigram scores, or merges ordered by score for a BPE model),
byte fallback, and the decoder that undoes them.  Where no piece has a marker
after another character, texts are cut before each run of markers: no merge can
cross there, and words repeat, so the library's cache works.

Every text is verified against sentencepiece itself.  Where texts may be cut before
markers, and the normaliser only marks spaces, a text's ids are those of its words.
Words repeat, so each distinct word of a task is encoded once, by both, some dozens
in a line, and a text's ids are put together from those of its words; a text with a
word on which they differ is encoded by sentencepiece instead.  Other models are
encoded and verified text by text.

Results for odd input: null text is empty and has no tokens; strings of control
pieces in texts are ordinary text; repeated rows and null ids each give their
row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import row_slices, strings, table, whole_text
from tillcast.llm.registry import query
from tillcast.llm.token_counts import THREADS

MARK = "▁"
PART = re.compile(" *[^ ]+| +")
UNIGRAM, BPE = 1, 2                    # trainer_spec.model_type
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types
KNOWN_WORDS = 1 << 20  # verified words that a task remembers; beyond that they are encoded again
LINE_WORDS = 64        # words that are encoded at a time

_models: dict = {}
_bytes: dict = {}


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, the rest as bytes."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[i:i + size]
        i += size


class ModelFile:
    """What a .model file says."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normal = {}, {}
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                score = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
                self.pieces.append((p[1].decode(), score, p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normal.get(2, b"")
        self.dummy_prefix = bool(normal.get(3, 1))
        self.strip_extra = bool(normal.get(4, 1))
        self.marks = bool(normal.get(5, 1))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    @property
    def usable(self) -> dict[str, int]:
        """Pieces that text can become, besides bytes."""
        return {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}


def build_tokenizer(model: ModelFile):
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    usable = model.usable
    if model.kind == UNIGRAM:
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback))
    elif model.kind == BPE:
        merges = []
        for piece, i in usable.items():
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                if a in usable and b in usable:
                    merges.append((-model.pieces[i][1], i, usable[a], usable[b], a, b))
        merges.sort()
        tok = Tokenizer(models.BPE(vocab, [(m[4], m[5]) for m in merges], unk_token=model.pieces[model.unknown][0],
                                   fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError("only unigram and BPE models are read")
    space = MARK if model.marks else " "
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.strip_extra:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.marks:
        steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(space))
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    if not any(b == space and a != space for p in usable for a, b in zip(p, p[1:])):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{space}*[^{space}]+|{space}+"), "isolated")
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                    + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return tok


class Parity:
    """What the two encoders agree on, by word or by text."""

    def __init__(self, model: ModelFile, tok, own):
        self.tok, self.own = tok, own
        # the tokenizer cuts before each run of markers, and each cut part begins with one
        self.by_word = bool(model.marks and model.dummy_prefix and not model.charsmap and not model.strip_extra and tok.pre_tokenizer)
        self.first = np.array([p.startswith(MARK) for p, _, _ in model.pieces])
        self.good: dict[str, bytes] = {}  # ids of the words on which both agree, as int32
        self.bad: set[str] = set()

    def words(self, text: str) -> list[str] | None:
        """The parts of a text, each without the space that a lone part gets as its prefix; None where a last part is
        such a space only, which is no text of its own."""
        if "  " not in text and MARK not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        out = [x[1:] for x in PART.findall(" " + text.replace(MARK, " "))]
        return out if out[-1] else None

    def learn(self, words: set[str]) -> None:
        """Encodes the words that are not known yet."""
        if len(self.good) + len(self.bad) > KNOWN_WORDS:
            self.good, self.bad = {}, set()
        new = [w for w in words if w not in self.good and w not in self.bad]
        plain, single = [w for w in new if w[:1] not in ("", " ")], [w for w in new if w[:1] in ("", " ")]
        lines = [plain[i:i + LINE_WORDS] for i in range(0, len(plain), LINE_WORDS)]
        for line, ids in zip(lines, self._agreed([" ".join(x) for x in lines])):
            # no piece has a marker after another character, so a word has one piece that begins with one
            at = None if ids is None else np.flatnonzero(self.first[ids])
            if at is None or len(at) != len(line):
                single += line
                continue
            raw, cut = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            self.good.update((w, raw[i:j]) for w, i, j in zip(line, cut, cut[1:]))
        for w, ids in zip(single, self._agreed(single)):
            if ids is None:
                self.bad.add(w)
            else:
                self.good[w] = ids.tobytes()

    def _agreed(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts, None where the encoders differ."""
        if not texts:
            return []
        theirs = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(a, np.int32) if a == b.ids else None for a, b in zip(self.own.encode(texts, num_threads=1), theirs)]

    def ids(self, words: list[str]) -> list[int] | None:
        """Ids of a text from those of its words; None where the encoders differ on one."""
        try:
            return np.frombuffer(b"".join(map(self.good.__getitem__, words)), np.int32).tolist()
        except KeyError:
            return None


def load(path: str):
    """(model file, tokenizer, sentencepiece processor, parity), made once per Python worker."""
    if path not in _models:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read when the library starts its pool
        import sentencepiece
        m, own = ModelFile(path), sentencepiece.SentencePieceProcessor(model_file=path)
        tok = build_tokenizer(m)
        _models[path] = (m, tok, own, Parity(m, tok, own))
    return _models[path]


def encode_texts(texts: list[str], path: str) -> list[list[int]]:
    """Ids of whole texts, as sentencepiece gives them."""
    _, tok, own, parity = load(path)
    words = [parity.words(t) if parity.by_word else None for t in texts]
    parity.learn(set(chain.from_iterable(w for w in words if w is not None)))
    out = [None if w is None else parity.ids(w) for w in words]
    whole = [i for i, w in enumerate(words) if w is None]
    for i, e in zip(whole, tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
        out[i] = e.ids
    # what was encoded whole is verified whole, and a text with a word on which the encoders differ is encoded again
    check = sorted({*whole, *(i for i, x in enumerate(out) if x is None)})
    for i, x in zip(check, own.encode([texts[i] for i in check], num_threads=1)):
        if out[i] != x:
            out[i] = x
    return out


def piece_bytes(model: ModelFile) -> list[bytes]:
    """What each id stands for in a decoded text: the piece with its markers undone, one raw byte, or nothing."""
    out = []
    for piece, _, kind in model.pieces:
        if kind == BYTE:
            out.append(bytes([int(piece[1:-1], 16)]))
        elif kind in (NORMAL, USER, UNUSED):
            out.append((piece.replace(MARK, " ") if model.marks else piece).encode())
        else:
            out.append(b"")
    return out


def decode_ids(ids: list[list[int]], path: str) -> list[str]:
    """Decoded texts: the bytes of the ids joined; the library decodes what holds unknown ids or is not UTF-8."""
    model, tok, *_ = load(path)
    if path not in _bytes:
        _bytes[path] = piece_bytes(model)
    of, out = _bytes[path].__getitem__, []
    for x in ids:
        data = b"".join(map(of, x))
        if model.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        try:
            out.append(tok.decode(x) if model.unknown in x else data.decode())
        except UnicodeDecodeError:
            out.append(tok.decode(x))
    return out


def flat_lists(ids: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int32), *(np.array(x, np.int32) for x in ids)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


CODED_SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, lossless boolean"


def coder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, "text"):
            texts = strings(b, "text")
            ids = encode_texts(texts, path)
            back = decode_ids(ids, path)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), flat_lists(ids),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([x == y for x, y in zip(back, texts)], pa.bool_())],
                names=["doc_id", "n_tokens", "ids", "decoded_sha256", "lossless"])
    return run


def piece_codes(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: its ids, their number, the digest of the decoded text, and whether that is the text; no shuffle."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
            .mapInArrow(coder(model_path), CODED_SCHEMA))


@query("op4_piece_codec")
def op4_piece_codec(spark, sf_dir):
    import public_tokenizers
    return piece_codes(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
