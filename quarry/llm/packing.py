"""Packing of tokenised documents into sequences of one length, by bounded-space online packing.

Each partition keeps a fixed number of open windows. A document's pieces of full length are sequences of their own; its
rest goes where it fits best; if it fits nowhere, the fullest window is topped up with its first part and emitted. At the
end the windows still open are merged: those of GROUP partitions are cut into full sequences, what each group has left
(less than one sequence) is merged with that of GROUP groups, and so on. Only the last group's rest, less than one
sequence for the whole table, is cut into sequences whose lengths are powers of two. So no sequence is padded.

A null or empty text has only the end id; repeated rows are packed one by one; an empty table gives no rows; other columns
are ignored. Token ids come from the tokenizer itself, for each distinct word once, from a bounded table of the worker.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import slices
from quarry.llm.common import written

#: Open windows of a partition, and partitions whose windows are merged together: 16 * 32 * 2048 ids at most in one task.
OPEN, GROUP = 32, 16
#: Words that a worker remembers.
REMEMBERED = 500_000

# How a tokenizer that the pattern below is equal to prepares its texts.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _DIGITS, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \xa0"


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _prepares_alike(tokenizer: dict) -> bool:
    """Whether a tokenizer's file says that it prepares texts as the pattern of Words does."""
    before, cut = tokenizer.get("normalizer") or {}, tokenizer.get("pre_tokenizer") or {}
    split = (cut.get("pretokenizers") or [{}])[0]
    rest = [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in (cut.get("pretokenizers") or [])[1:]]
    model = tokenizer.get("model") or {}
    return (
        before.get("normalizers") == _NORMALIZERS and split.get("pattern") == {"Regex": _SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
        and rest == [("ByteLevel", False, False)] and not tokenizer.get("truncation") and not tokenizer.get("post_processor") and not model.get("dropout")
        and all(x["content"].startswith("<|") for x in tokenizer.get("added_tokens") or [])
    )


class Words:
    """The ids of a word-level BPE tokenizer (lower case, a word at a time), as little-endian uint32.

    Texts of Latin-1 characters are cut by an equal pattern here, and their words looked up; all others, and all texts of a
    tokenizer that prepares its texts in another way, go through the tokenizer as they are.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACE}{_LETTERS}{_DIGITS}]+")
        self.known = _prepares_alike(json.loads(source))
        self.odd = re.compile(r"[\x1c-\x1f\x85]|<\|")
        self.table: dict[str, bytes] = {}

    def plain(self, text: str) -> bool:
        if not self.known:
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not self.odd.search(text)

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.plain(x) for x in texts]
        cut = [self.pattern.findall(x.lower()) for x, p in zip(texts, plain) if p]
        wanted = set().union(*cut)
        new = list(wanted.difference(self.table))
        if len(self.table) + len(new) > REMEMBERED:
            self.table.clear()
            new = list(wanted)
        self.table.update(zip(new, self._direct(new)))
        get = self.table.__getitem__
        fast, slow = iter(cut), iter(self._direct([x for x, p in zip(texts, plain) if not p]))
        return [b"".join(map(get, next(fast))) if p else next(slow) for p in plain]


_loaded: dict[str, Words] = {}


def loaded(source: str) -> Words:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Words(source)
    return _loaded[key]


class Packer:
    """Bounded-space best fit. Pieces are (key, start, ids, tokens of the document)."""

    def __init__(self, length: int, open_windows: int):
        self.length, self.most = length, open_windows
        self.open: list[list] = []  # [fill, pieces]
        self.closed: list[list] = []

    def _put(self, window: list, piece: tuple) -> None:
        window[1].append(piece)
        window[0] += len(piece[2]) // 4
        if window[0] == self.length:
            self.open.remove(window)
            self.closed.append(window[1])

    def add(self, key, ids: bytes) -> None:
        n, start = len(ids) // 4, 0
        while n - start >= self.length:
            self.closed.append([(key, start, ids[4 * start : 4 * (start + self.length)], n)])
            start += self.length
        while start < n:
            rest = n - start
            fits = [w for w in self.open if self.length - w[0] >= rest]
            if fits:
                self._put(max(fits, key=lambda w: w[0]), (key, start, ids[4 * start :], n))
                return
            if len(self.open) < self.most:
                self.open.append(window := [0, []])
                self._put(window, (key, start, ids[4 * start :], n))
                return
            fullest = max(self.open, key=lambda w: w[0])
            gap = self.length - fullest[0]
            self._put(fullest, (key, start, ids[4 * start : 4 * (start + gap)], n))
            start += gap

    def taken(self) -> list[list]:
        out, self.closed = self.closed, []
        return out


def merged(pieces: list[tuple], length: int, last: bool = True) -> list[list[tuple]]:
    """Pieces in order, cut into full sequences; what remains is cut into sequences of powers of two, or stays as it is."""
    left = sum(len(p[2]) // 4 for p in pieces)
    rest = left % length
    ends = [1 << b for b in range(length.bit_length(), -1, -1) if rest >> b & 1] if last else [rest] * (rest > 0)
    out, k = [], 0
    for size in [length] * (left // length) + ends:
        own, gap = [], size
        while gap:
            key, start, ids, n = pieces[k]
            take = min(gap, len(ids) // 4)
            own.append((key, start, ids[: 4 * take], n))
            if take == len(ids) // 4:
                k += 1
            else:
                pieces[k] = (key, start + take, ids[4 * take :], n)
            gap -= take
        out.append(own)
    return out


def packed(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 1, open_windows: int = OPEN, group: int = GROUP, digests: bool = False) -> DataFrame:
    """A row for each piece: key, start, length, doc_tokens, sequence_id, offset, and its ids (with digests: their crc32)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()
    tail = np.array([end_id], dtype="<u4").tobytes()
    schema = f"`{key}` {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_crc32 bigint, ids binary, _group bigint"

    def rows(windows: list[list[tuple]], first: int, open_group: int | None, types: pa.DataType) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(9)]
        for s, window in enumerate(windows):
            offset = 0
            for k, start, ids, n in window:
                size = len(ids) // 4
                keep = open_group is not None or not digests
                for c, v in zip(cols, (k, start, size, n, first + s, offset, zlib.crc32(ids), ids if keep else None, open_group)):
                    c.append(v)
                offset += size
        kinds = [types, *[pa.int64()] * 6, pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids", "_group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = loaded(source.value), Packer(length, open_windows)
        part = TaskContext.get().partitionId()
        next_id, types = part << 32, None
        for batch in batches:
            types = batch.column(0).type
            for start, texts in slices(batch.column(1)):
                for k, ids in zip(batch.column(0).slice(start, len(texts)).to_pylist(), coder.encode(texts.to_pylist())):
                    packer.add(k, ids + tail)
                full = packer.taken()
                yield rows(full, next_id, None, types)
                next_id += len(full)
        if types is not None:
            yield rows([w[1] for w in packer.open], next_id, part // group, types)

    def merging(last: bool, round_: int):
        return lambda table: merge(table, last, round_)

    def merge(table: pa.Table, last: bool, round_: int) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        pieces = list(zip(*(table[c].to_pylist() for c in (key, "start", "ids", "doc_tokens"))))
        own = table["_group"][0].as_py()
        first = (round_ << 56) + (own << 32)
        windows = merged(pieces, length, last)
        rest = [windows.pop()] if not last and sum(len(p[2]) // 4 for p in windows[-1]) < length else []
        types = table.schema.field(key).type
        done = rows(windows, first, None, types)
        return pa.Table.from_batches([done, rows(rest, first + len(windows), own // group, types)] if rest else [done])

    placed = written(docs.select(key, text).mapInArrow(run, schema), "packing")
    done, rest = placed.filter(F.col("_group").isNull()), placed.filter(F.col("_group").isNotNull())
    groups, round_ = (rest.agg(F.max("_group")).first()[0] or 0) + 1, 1
    while True:
        last = groups == 1
        merged_ = written(rest.groupBy("_group").applyInArrow(merging(last, round_), schema), "merged")
        done = done.unionByName(merged_.filter(F.col("_group").isNull()))
        if last:
            return done.drop("_group", "ids" if digests else "ids_crc32")
        rest, groups, round_ = merged_.filter(F.col("_group").isNotNull()), -(-groups // group), round_ + 1


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.common import documents

    out = packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests=True)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
