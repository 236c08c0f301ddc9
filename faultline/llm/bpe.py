"""Byte-level BPE encoding and decoding; merges are found by a segment tree.

The leaves of the tree are the ranks of the adjacent pairs of a piece, in
order, each joined with the pair's merged id; an inner node is the smallest of
its children.  So the root is the lowest rank, and the first child equal to it,
level by level, leads to the leftmost pair of that rank.  A merge changes three
leaves and their paths, and merging ends when the root is no rank.  Nodes have
32 children, so a word's tree is a root above its leaves.
"""

from __future__ import annotations

import json
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import ship

#: Fixed value: white space as the vocabulary's pattern means it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the pattern that cuts text into pieces before merging.
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces that a task remembers, and the longest piece worth remembering.
REMEMBER, SHORT = 200_000, 64
#: Characters of text turned into one output batch.
BATCH_CHARS = 2 << 20

#: Children of an inner node of the tree.
FAN = 32
NONE, LOW = 1 << 62, (1 << 32) - 1


@lru_cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """What encoding and decoding need of a tokenizer file; small, so it is broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        vocab, chars = t["model"]["vocab"], byte_chars()
        of = {c: b for b, c in enumerate(chars)}
        self.byte_ids = [vocab[c] for c in chars]
        merges = [m if isinstance(m, list) else m.split(" ") for m in t["model"]["merges"]]
        #: (left id, right id) as one number -> rank << 32 | id of the merged pair
        self.merges = {vocab[a] << 32 | vocab[b]: r << 32 | vocab[a + b] for r, (a, b) in enumerate(merges)}
        self.added = {x["content"]: x["id"] for x in t["added_tokens"]}
        self.bytes = {i: bytes(of[c] for c in s) for s, i in vocab.items()}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}


def merge(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Merges pairs by rank, leftmost first, until no pair has one."""
    n = len(ids)
    get = merges.get
    leaves = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
    tree = [leaves]
    while len(tree[-1]) > FAN:
        below = tree[-1]
        tree.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    top, inner, lower = tree[-1], tree[1:], tree[-2::-1]
    ids, right, left = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))

    def climb(i: int) -> None:
        below = leaves
        for level in inner:
            i //= FAN
            level[i] = min(below[i * FAN : i * FAN + FAN])
            below = level

    while top and (best := min(top)) != NONE:
        i = top.index(best)
        for level in lower:
            i = level.index(best, i * FAN)
        j = right[i]
        k = right[j]
        new = ids[i] = best & LOW
        right[i] = k
        if k < n:
            left[k] = i
            leaves[j] = NONE  # the last symbol starts no pair and has no leaf
            leaves[i] = get(new << 32 | ids[k], NONE)
        else:
            leaves[i] = NONE
        h = left[i]
        if h >= 0:
            leaves[h] = get(ids[h] << 32 | new, NONE)
        if inner:
            for x in {i // FAN, j // FAN, max(h, 0) // FAN}:
                climb(x * FAN)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = right[i]
    return out


class Codec:
    """Encodes and decodes texts within a task."""

    def __init__(self, vocabulary: Vocabulary, remember: int = REMEMBER):
        self.v, self.most = vocabulary, max(remember // 2, 1)
        #: pieces met lately, and those met before them: the ones that are met again stay
        self.seen, self.before = {}, {}
        self.pieces = regex.compile(PIECE).findall
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, added)) + ")").split if added else None

    def piece(self, piece: str) -> bytes:
        v, out = self.v, self.before.get(piece)
        if out is None:
            ids = merge([v.byte_ids[b] for b in piece.encode("utf-8", "replace")], v.merges)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= SHORT:
            if len(self.seen) >= self.most:
                self.seen, self.before = {}, self.seen
            self.seen[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        out, piece = [], self.piece
        for part in self.split(text) if self.split else [text]:
            if part in self.v.added:
                out.append(np.array([self.v.added[part]], "<u4").tobytes())
            else:
                out += [self.seen.get(p) or piece(p) for p in self.pieces(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


#: The codec of this worker process, kept from task to task with the pieces it remembers.
_kept: dict[str, Codec] = {}


def _codec(name: str, shared, remember: int) -> Codec:
    if name not in _kept:
        _kept.clear()
        _kept[name] = Codec(shared.value, remember)
    return _kept[name]


def encode_decode(docs: DataFrame, path: str, text: str = "text", remember: int = REMEMBER) -> DataFrame:
    """``docs`` without ``text`` and with ``ids`` binary (little-endian unsigned 32-bit) and ``decoded`` string.

    ids are those of the tokenizer file at ``path`` with no special tokens
    added; the text of an added token in a document is that token.  decoded is
    made from the ids.  ``remember`` bounds the pieces whose ids a task keeps: fewer
    take less memory and more time.  A null text counts as empty: no ids, an empty decoded
    text.  Texts of any length are read whole; a piece without white space of
    any length takes n log n steps.  Repeated rows are treated alike; an empty
    table gives an empty result; other columns are kept, but for those named
    ids or decoded.
    """
    spark = docs.sparkSession
    ship(spark)
    shared, name = spark.sparkContext.broadcast(Vocabulary(path)), uuid.uuid4().hex
    kept = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    schema = docs.select(*kept).schema.add("ids", "binary").add("decoded", "string")

    def run(batches):
        codec = _codec(name, shared, remember)
        for batch in batches:
            column = batch.column(len(kept))
            start, n, ids, decoded = 0, 0, [], []
            for i in range(batch.num_rows):
                ids.append(codec.encode(column[i].as_py() or ""))
                decoded.append(codec.decode(ids[-1]))
                n += len(decoded[-1])
                if n >= BATCH_CHARS or i == batch.num_rows - 1:
                    part = batch.slice(start, i + 1 - start).columns[: len(kept)]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [*kept, "ids", "decoded"])
                    start, n, ids, decoded = i + 1, 0, [], []

    return docs.select(*kept, text).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and the other columns, from ids and decoded."""
    out = encoded.withColumns({
        "n_tokens": (F.octet_length("ids") / 4).cast("long"),
        "ids_sha256": F.sha2("ids", 256),
        "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
    })
    return out.drop("ids", "decoded")
