"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text is cut before a run of word marks, and a chunk again between any two characters that stand side by side in no piece,
as no merge can cross them; the distinct chunks of a batch are laid flat in one array of symbols, and each round finds the
minimum pair rank of every part, merges its leftmost occurrences in all parts at once and compacts, until no pair is left. In
long parts the minimum is taken as far as a piece reaches, so that rounds do not grow with their length.
Chunks met before come from a bounded table of the worker.

A null or empty text has no pieces (only the end id, if one is asked for); repeated rows are encoded alike; very long
texts and chunks are encoded whole, in the same way. The model file is read on the driver and sent to the workers, whose size is the
vocabulary's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.batches import slices

MARK = "▁"
NONE = np.int64(1 << 40)
#: Chunks that a worker remembers, and their characters; symbols that are merged at once (one longer part by itself).
REMEMBERED, CHARACTERS, AT_ONCE = 600_000, 20_000_000, 2_000_000


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    k = 1
    while 2 * k <= width:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (width - k)], x[width - k :])


class Pieces:
    """The tables of a BPE model with byte fallback, and what they do to texts."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        for c in sorted({c for p in ids for c in p}):  # characters that occur only inside longer pieces
            ids.setdefault(c, len(ids) + n)
        order = {s: r for r, s in enumerate(sorted({-sp.get_score(ids[p]) for p in ids if ids[p] < n}))}
        rank = {ids[p]: order[-sp.get_score(ids[p])] for p in ids if ids[p] < n}
        merges = [(ids[p[:k]], ids[p[k:]], rank[i], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        # A symbol is unsafe if a pair with it can rank as high as the pair that makes it: then only one merge at a time.
        made = {i for *_, i in merges}
        unsafe = {x for a, b, r, _ in merges for x in (a, b) if x in made and r <= rank[x]}
        merges.sort()
        self.keys = np.array([a << 20 | b for a, b, *_ in merges], dtype=np.int64)
        self.ranks = np.array([r << 1 | (i in unsafe) for *_, r, i in merges], dtype=np.int64)
        self.into = np.array([i for *_, i in merges], dtype=np.int64)
        self.known = np.full(0x110000, -1, dtype=np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.known[ord(p)] = i
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(x) for x in raw], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.is_control = np.array([sp.is_control(i) for i in range(n)])
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        inside = {c for p in ids for c in p}
        # Characters that stand side by side in some piece.
        self.meeting = np.array(sorted({ord(a) << 21 | ord(b) for p in ids for a, b in zip(p, p[1:])}), dtype=np.int64)
        # Cut before a run of marks; a run goes with what follows it, unless pieces may go on from a character to a mark.
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in ids)
        apart = "\n" if "\n" not in inside else ""
        self.chunk = re.compile(f"[^{apart}]+|\n" if crossing and apart else "(?s:.+)" if crossing else f"{MARK}*[^{MARK}{apart}]+|{MARK}+|\n")
        self.reach = max(map(len, ids))
        self.table: dict[str, str] = {}
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the table of each pair; NONE where they do not merge."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE), at

    def rounds(self, symbols: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges flat symbols; seg is the ascending chunk of each. Returns the symbols left and their chunks."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, at = self._ranked(symbols, seg)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            lengths = np.diff(np.r_[first, len(seg)])
            least = np.minimum.reduceat(rank, first)
            open_ = least < NONE
            if not open_.all():
                stays = np.repeat(open_, lengths)
                done.append((symbols[~stays], seg[~stays]))
                symbols, seg, rank, at = symbols[stays], seg[stays], rank[stays], at[stays]
                least, lengths = least[open_], lengths[open_]
                if not len(symbols):
                    break
            near = self._near(rank, lengths)
            hit = np.flatnonzero((rank == np.repeat(least, lengths)) | near)
            new = np.r_[True, seg[hit[1:]] != seg[hit[:-1]]]
            # In a row of overlapping occurrences every other one merges, from the left.
            breaks = new | np.r_[True, hit[1:] != hit[:-1] + 1]
            place = np.arange(len(hit))
            offset = place - np.maximum.accumulate(np.where(breaks, place, 0))
            hit = hit[np.where(rank[hit] & 1, new | near[hit], offset % 2 == 0)]
            symbols[hit] = self.into[at[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, seg, rank, at = symbols[keep], seg[keep], rank[keep], at[keep]
            touched = np.unique(np.r_[moved[hit], np.maximum(moved[hit] - 1, 0)])
            inner = touched[touched + 1 < len(symbols)]
            rank[touched] = NONE
            inner = inner[seg[inner] == seg[inner + 1]]
            rank[inner], at[inner] = self.pairs(symbols[inner], symbols[inner + 1])
        if not done:
            return symbols, seg
        symbols, seg = (np.concatenate(x) for x in zip(*done))
        by = np.argsort(seg, kind="stable")
        return symbols[by], seg[by]

    def _near(self, rank: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """In long parts: which pairs are least as far as two pieces reach on either side, as what merges beyond that cannot get at
        them before their turn. Of a row of equal pairs all wait for the first, of unsafe equal ones each for those on its left."""
        near, far = np.zeros(len(rank), dtype=bool), 2 * self.reach
        wide = lengths > 2 * far
        if wide.any():
            inside = np.flatnonzero(np.repeat(wide, lengths))
            r = rank[inside]
            left = _least(np.concatenate([np.full(far, NONE), r]), far)[: len(r)]
            right = _least(np.concatenate([r, np.full(far, NONE)]), far + 1)
            own = (r < NONE) & (r <= right) & np.where(r & 1, r < left, r <= left)
            first = np.r_[True, r[1:] != r[:-1]]
            own &= own[np.flatnonzero(first)][np.cumsum(first) - 1]
            near[inside[own]] = True
        return near

    def _ranked(self, symbols: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, at = np.full(len(symbols), NONE), np.zeros(len(symbols), dtype=np.int64)
        inner = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inner], at[inner] = self.pairs(symbols[inner], symbols[inner + 1])
        return rank, at

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk."""
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        base, chunk = self.known[code], np.repeat(np.arange(len(chunks)), lengths)
        # Unknown characters keep their code as a negative symbol: no pair has it.
        base = np.where(base >= 0, base, -10 - code)
        pair = code[:-1] << 21 | code[1:]
        meets = self.meeting[np.minimum(np.searchsorted(self.meeting, pair), len(self.meeting) - 1)] == pair
        part = np.r_[0, np.cumsum(~meets | (chunk[1:] != chunk[:-1]))] if len(code) else np.empty(0, np.int64)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        owner = chunk[first]
        # Groups of whole parts.
        start = np.flatnonzero(np.r_[True, first[1:] // AT_ONCE != first[:-1] // AT_ONCE])
        cut = [*first[start].tolist(), len(code)] if len(code) else [0, 0]
        merged = [self.rounds(base[a:b].copy(), part[a:b]) for a, b in zip(cut, cut[1:])]
        symbols, seg = np.concatenate([x for x, _ in merged]), owner[np.concatenate([x for _, x in merged])]
        counts = np.bincount(seg, minlength=len(chunks))
        flat, out, k = symbols.tolist(), [], 0
        bytes_too = (symbols < 0) | (symbols >= len(self.sizes))
        odd = set(np.unique(seg[bytes_too]).tolist()) if bytes_too.any() else set()
        for i, c in enumerate(counts.tolist()):
            own = flat[k : k + c]
            k += c
            out.append([y for x in own for y in self._spelt(x)] if i in odd else own)
        return out

    def _spelt(self, symbol: int) -> list[int]:
        if 0 <= symbol < len(self.sizes):
            return [symbol]
        char = chr(-10 - symbol) if symbol < 0 else chr(int(np.flatnonzero(self.known == symbol)[0]))
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")]

    def learn(self, wanted: set[str]) -> None:
        """Puts chunks that the table lacks into it, as ids in decimal."""
        new = list(wanted.difference(self.table))
        if len(self.table) + len(new) > REMEMBERED or self.held > CHARACTERS:
            self.table.clear()
            self.held, new = 0, list(wanted)
        self.held += sum(map(len, new))
        for c, ids in zip(new, self.encode_chunks(new)) if new else ():
            self.table[c] = " ".join(map(str, ids))

    def encode(self, texts: list[str | None], end: bool = False) -> list[str]:
        """The ids of each text in decimal, joined by a space."""
        cut = [self.chunks(x or "") for x in texts]
        self.learn(set().union(*cut))
        get, tail = self.table.__getitem__, [str(self.end)] if end else []
        return [" ".join([*map(get, c), *tail]) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library has it: one mark at the start goes, bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, dtype=np.int64)
        said = ids[~self.is_control[ids]] if len(ids) else ids
        if not len(said):
            return ""
        sizes = self.sizes[said]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[said], sizes)
        raw = self.raw[at].tobytes()
        inner = self.is_control[ids[: int(np.flatnonzero(~self.is_control[ids])[-1])]].any()
        if inner and self.is_byte[said].any():  # bytes on either side of a control piece make no character together
            return self._mended(ids)
        if self.marked[said[0]]:
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return self._mended(said)

    def _mended(self, ids: np.ndarray) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            k = 0
            while k < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[k : k + size]).decode("utf-8"))
                        k += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k += 1
            run.clear()

        first = int(np.flatnonzero(~self.is_control[ids])[0])
        for i, x in enumerate(ids.tolist()):
            own = self.raw[self.starts[x] : self.starts[x] + self.sizes[x]].tobytes()
            if self.is_byte[x]:
                run += own
            else:
                flush()
                out.append(own.decode("utf-8")[(i == first and bool(self.marked[x])) :])
        flush()
        return "".join(out)


_loaded: dict[str, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The tables of a model, built once in a worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def coded(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", digests: bool = True) -> DataFrame:
    """Encodes and decodes every text. With digests: key, n_tokens, ids_sha256, decoded_sha256; without: key, ids, decoded."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()
    columns = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value)
        for batch in batches:
            keys = batch.column(0)
            for start, texts in slices(batch.column(1)):
                spelt = pieces.encode(texts.to_pylist(), end=True)
                ids = [np.array(s.split(" "), dtype=np.int32) for s in spelt]
                back = [pieces.decode(x) for x in ids]
                if digests:
                    sha = [[hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in xs] for xs in (spelt, back)]
                    rest = [pa.array([len(x) for x in ids], pa.int64()), pa.array(sha[0], pa.string()), pa.array(sha[1], pa.string())]
                else:
                    rest = [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([keys.slice(start, len(texts)), *rest], names=[key, "a", "b", "c"][: 1 + len(rest)])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *[c.strip().split(" ")[0] for c in columns.split(",")]] if digests else [key, "ids", "decoded"]
        for b in run(batches):
            yield b.rename_columns(names)

    return docs.select(key, text).mapInArrow(named, f"`{key}` {kind}, {columns}")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.common import documents

    return coded(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
