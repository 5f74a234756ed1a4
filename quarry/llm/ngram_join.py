"""N-gram Jaccard join with multiple-global-order filtering.

Every text is a set of hashed word shingles. For a similarity t, two sets of a link share a token among their
n - ceil(t n) + 1 first tokens in any one order of all tokens. Several orders are used at once, all with rare tokens first
and each with its own permutation among tokens of equal rank, and a candidate must share prefix tokens in every one of
them: it is found by the first order's tokens and then has to overlap in the others'. Candidates also pass two exact bounds
(set sizes; a parity sketch, whose differing bits are no more than the sets' differing tokens) and are then verified on the
whole sets.

Equal sets are one class from the start. Links between classes are found in two steps, so that large groups of near copies
never emit all of their pairs: first each class against the representative of each of its buckets; then what is not connected
with the representative against the bucket's other components. Connected components of all links are exact.

Ranks come from counts over all shingles of all documents. Texts are read in chunks; a chunk's tokens go out as packed counts
by hash range, each range is summed up in one task, and what comes back to the chunk is one byte for each of its tokens. So
no table of tokens is ever in one process, and nothing of it passes the driver.

Rows are told apart by where they are, not by their id: one id may stand for several texts. Nulls and texts without words
have empty sets and no links; texts with fewer words than a shingle have one shingle; repeated rows are in one class; an
empty table gives no rows; other columns are ignored by `joined` and `links` and kept by `deduplicated`. Rows whose id is
null are joined by their text but cannot name a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import flat, slices
from quarry.llm.common import SPACES, hot_joined, salted_joined, settled, written
from quarry.llm.wordhash import LOWER, hashes, mix, words
from quarry.operators.joins import estimated_bytes

ORDERS = 3
#: Tokens of a chunk, which a task counts at once (a longer text is a chunk of its own).
BUFFER = 750_000
#: Chunks that one task works on, one at a time, where there are many.
CHUNKS = 4
#: Estimated bytes of text whose tokens are summed up in one task.
RANGE = 4 << 20
#: Longs of the parity sketch.
SKETCH = 8

_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, token), each token once in a text, sorted by both."""
    raw, at = flat(texts)
    raw = LOWER[raw]
    starts, lengths, text = words(raw, at)
    h = hashes(raw, starts, lengths)
    count = np.bincount(text, minlength=len(texts))
    first = np.cumsum(count) - count
    total = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
    for j in range(width):
        total += h[j : j + len(total)] * _SEEDS[j]
    inner = text[: len(total)] == text[width - 1 :][: len(total)] if len(total) else np.zeros(0, bool)
    token, owner = mix(total[inner]), text[: len(total)][inner]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):  # the whole sequence is one shingle
        own = np.isin(text, short)
        seq = h[own] * _SEEDS[20 + (np.arange(len(h)) - first[text])[own]]
        sums = np.zeros(len(texts), dtype=np.uint64)
        np.add.at(sums, text[own], seq)
        token = np.concatenate([token, mix(sums[short] + _SEEDS[40] * count[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    by = np.lexsort((token, owner))
    token, owner = token[by], owner[by]
    new = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])] if len(token) else np.zeros(0, bool)
    return owner[new], token[new]


def _sums(owner: np.ndarray, token: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit sums of each set: equal sets have equal sums."""
    s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    size = np.bincount(owner, minlength=n)
    if len(owner):
        has = np.flatnonzero(size)
        start = (np.cumsum(size) - size)[has]
        s1[has] = mix(np.add.reduceat(mix(token + _SEEDS[50]), start))
        s2[has] = mix(np.add.reduceat(mix(token ^ _SEEDS[51]), start))
    return size, s1.view(np.int64), s2.view(np.int64)


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 40-bit keys as differences and counts, bytes of equal weight together."""
    delta = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T[:5].tobytes()
    amount = np.minimum(counts, (1 << 32) - 1).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.compress(delta + amount, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=9 * n, codec="zstd"), dtype=np.uint8)
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :5] = raw[: 5 * n].reshape(5, n).T
    keys = np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64)
    return keys, np.ascontiguousarray(raw[5 * n :].reshape(4, n).T).reshape(-1).view("<u4").astype(np.int64)


def _ranked(amount: np.ndarray) -> np.ndarray:
    """Counts as ranks of one byte: 0 for tokens met once, and more in steps of an eighth of a doubling."""
    return np.where(amount > 1, np.minimum(1 + 8 * np.log2(np.maximum(amount, 1)), 255), 0).astype(np.uint8)


def _stored(texts: list[pa.Array]) -> bytes:
    """The texts, compressed."""
    out = pa.BufferOutputStream()
    table = pa.table({"t": pa.chunked_array(texts)})
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _counted(docs: DataFrame, key: str, text: str, width: int, buffer: int) -> DataFrame:
    """Three kinds of rows: of each document (row, key, h, n, s1, s2, chunk; row is its number, h its text's hash), of each
    chunk (chunk, texts; the documents' rows are chunk, chunk + 1, ...), and packed counts of a chunk's tokens by hash range
    (chunk, part, n, blob)."""
    kind = docs.schema[key].dataType.simpleString()
    ranges = 1 << min(16, max(4, (estimated_bytes(docs.select(text)) // RANGE).bit_length()))
    shift = np.uint64(40 - ranges.bit_length() + 1)
    fields = [("row", pa.int64()), (key, None), ("h", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("chunk", pa.int64()), ("texts", pa.binary()), ("part", pa.int32()), ("blob", pa.binary())]

    def batch_of(types: pa.DataType, size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get("k" if t is None else c, pa.nulls(size, t or types)) for c, t in fields], names=[c for c, _ in fields])

    def counts(types: pa.DataType, chunk: int, texts: list[pa.Array], tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield batch_of(types, 1, chunk=pa.array([chunk], pa.int64()), texts=pa.array([_stored(texts)], pa.binary()))
        keys, amount = np.unique(np.concatenate(tokens) >> np.uint64(24), return_counts=True)
        part = (keys >> shift).astype(np.int64)
        some = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(keys) else np.empty(0, np.int64)
        cut = [*some.tolist(), len(keys)]
        blobs = [_packed(keys[a:b], amount[a:b]) for a, b in zip(cut, cut[1:])]
        yield batch_of(types, len(some), chunk=pa.array([chunk] * len(some), pa.int64()), n=pa.array(np.diff(cut), pa.int64()), part=pa.array(part[some], pa.int32()), blob=pa.array(blobs, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = chunk = TaskContext.get().partitionId() << 33
        texts, tokens, size, types = [], [], 0, None
        for batch in batches:
            types = batch.column(0).type
            for start, own in slices(batch.column(1)):
                owner, token = shingles(own, width)
                n, s1, s2 = _sums(owner, token, len(own))
                yield batch_of(types, len(own), row=pa.array(np.arange(row, row + len(own))), chunk=pa.array([chunk] * len(own), pa.int64()), k=batch.column(0).slice(start, len(own)), h=batch.column(2).slice(start, len(own)), n=pa.array(n, pa.int64()), s1=pa.array(s1), s2=pa.array(s2))
                row += len(own)
                texts.append(own)
                tokens.append(token)
                size += len(token)
                if size > buffer:
                    yield from counts(types, chunk, texts, tokens)
                    texts, tokens, size, chunk = [], [], 0, row
        if texts:
            yield from counts(types, chunk, texts, tokens)

    schema = f"row bigint, `{key}` {kind}, h bigint, n bigint, s1 bigint, s2 bigint, chunk bigint, texts binary, part int, blob binary"
    return docs.select(key, text, _named(text).alias("h")).mapInArrow(run, schema)


def _named(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _ranks(counted: DataFrame) -> DataFrame:
    """chunk and parts: in the order of the ranges, the ranks of the chunk's distinct tokens in ascending order."""

    def summed(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        pairs = [_unpacked(b, n) for b, n in zip(table["blob"].to_pylist(), sizes)]
        keys, counts = np.concatenate([k for k, _ in pairs]), np.concatenate([c for _, c in pairs])
        by = np.argsort(keys, kind="stable")
        new = np.r_[True, keys[by[1:]] != keys[by[:-1]]]
        total = np.add.reduceat(counts[by], np.flatnonzero(new))
        ranks = np.empty(len(keys), np.uint8)
        ranks[by] = _ranked(total)[np.cumsum(new) - 1]
        ends = np.cumsum(sizes)
        blobs = [pa.compress(ranks[e - n : e].tobytes(), codec="zstd", asbytes=True) for e, n in zip(ends, sizes)]
        return pa.table([table["chunk"], table["part"], table["n"], pa.array(blobs, pa.binary())], names=["chunk", "part", "n", "ranks"])

    blobs = counted.filter(F.col("part").isNotNull()).select("chunk", "part", "n", "blob")
    back = blobs.groupBy("part").applyInArrow(summed, "chunk bigint, part int, n bigint, ranks binary")
    return back.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "n", "ranks"))).alias("parts"))  # a chunk has BUFFER tokens


def _first(n: np.ndarray, similarity: float) -> np.ndarray:
    """Tokens of a set's prefix."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def _prefixed(chunks: DataFrame, width: int, similarity: float, orders: int) -> DataFrame:
    """Of the rows of each chunk that stand for a class (ids) and may have a partner: id, size, sketch, whole set, and the
    prefix tokens in every order."""
    names = ["id", "n", "sketch", "tokens", "prefixes"]
    longs, lists = pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))

    def one(chunk: int, texts: pa.Array, parts: list[dict], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        ranks = np.frombuffer(b"".join(pa.decompress(p["ranks"], decompressed_size=p["n"], codec="zstd", asbytes=True) for p in parts), np.uint8)
        cut = [(start, *shingles(own, width), len(own)) for start, own in slices(texts)]
        keys = np.unique(np.concatenate([token for _, _, token, _ in cut]) >> np.uint64(24))
        for start, owner, token, size in cut:
            n = np.bincount(owner, minlength=size)
            rank = ranks[np.searchsorted(keys, token >> np.uint64(24))]
            first = _first(n, similarity)
            # With a prefix of tokens that no other document has, there is no partner.
            alone = np.bincount(owner, weights=rank == 0, minlength=size)
            ends, wanted = np.cumsum(n), np.isin(np.arange(chunk + start, chunk + start + size), ids)
            cols: list[list] = [[] for _ in names]
            for i in np.flatnonzero(wanted & (alone < first)).tolist():
                own, r = token[ends[i] - n[i] : ends[i]], rank[ends[i] - n[i] : ends[i]]
                sketch = np.bincount((own >> np.uint64(9)) & np.uint64(64 * SKETCH - 1), minlength=64 * SKETCH) & 1
                sketch = np.packbits(sketch.astype(np.uint8)).view(">i8").astype(np.int64)
                prefixes = []
                for k in range(orders):
                    by = np.lexsort((mix(own ^ _SEEDS[60 + k]), r))[: first[i]]
                    prefixes.append(own[by[r[by] > 0]].view(np.int64))
                for c, v in zip(cols, (chunk + start + i, n[i], sketch, own.view(np.int64), prefixes)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), longs, longs, lists))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts, parts, ids in zip(*(c.to_pylist() for c in batch.columns)):
                own = pa.ipc.open_stream(texts).read_all()["t"].combine_chunks()
                yield from one(chunk, own, parts, np.array(ids, dtype=np.int64))

    return chunks.select("chunk", "texts", "parts", "ids").mapInArrow(run, "id bigint, n bigint, sketch array<bigint>, tokens array<bigint>, prefixes array<array<bigint>>")


def components(edges: DataFrame) -> DataFrame:
    """(id, c): the least id that edges (a, b) reach from each id. Labels spread to neighbours and then jump to their label's label."""
    edges = written(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("a", "b"), "edges")
    labels = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).withColumnRenamed("a", "id")
    while True:
        labels = written(labels, "labels")
        seen = labels.select(F.col("id").alias("b"), F.col("c").alias("_n"))
        least = edges.join(seen, "b").groupBy("a").agg(F.min("_n").alias("_m")).withColumnRenamed("a", "id")
        near = labels.join(least, "id").select("id", "c", F.least("c", "_m").alias("_near"))
        jump = labels.select(F.col("id").alias("_near"), F.col("c").alias("_far"))
        moved = written(near.join(jump, "_near").select("id", "c", F.least("_near", "_far").alias("_c")), "moved")
        if moved.filter("c <> _c").isEmpty():
            return moved.select("id", "c")
        labels = moved.select("id", F.col("_c").alias("c"))


def _differing(x: Column, y: Column) -> Column:
    total = F.lit(0)
    for i in range(SKETCH):
        total = total + F.bit_count(x[i].bitwiseXOR(y[i]))
    return total


def _plausible(similarity: float) -> Column:
    """Conditions on the two sides x and y of a candidate that every link meets."""
    nx, ny = F.col("x_n"), F.col("y_n")
    return (F.least(nx, ny) >= similarity * F.greatest(nx, ny) - 1e-9) & (_differing(F.col("x_sketch"), F.col("y_sketch")) * (1 + similarity) <= (nx + ny) * (1 - similarity) + 1e-9)


def _verified(pairs: DataFrame, nodes: DataFrame, hundredths: int, orders: int) -> DataFrame:
    """The pairs (a, b) that share prefix tokens in every order and enough of the whole sets. b's set goes to a's, not the other
    way round: an a may stand in very many pairs, whose rows are then dealt out."""
    pairs = written(pairs, "pairs")
    whole = nodes.select("id", "tokens", "prefixes")
    held = pairs.join(whole.toDF("b", "_y", "_yp"), "b")
    both = salted_joined(held, whole.toDF("a", "_x", "_xp"), "a", "b", counted=pairs)
    for k in range(1, orders):
        both = both.filter(F.arrays_overlap(F.col("_xp")[k], F.col("_yp")[k]))
    shared = F.size(F.array_intersect("_x", "_y"))
    return both.filter(100 * shared >= hundredths * (F.size("_x") + F.size("_y") - shared)).select("a", "b")


def _side(letter: str, df: DataFrame) -> DataFrame:
    return df.select("head", *[F.col(c).alias(f"{letter}_{c}") for c in df.columns if c != "head"])


def _read(docs: DataFrame, key: str, text: str, width: int, similarity: float, orders: int, buffer: int) -> tuple[DataFrame, ...]:
    """sets: a row for each document. classes: a row for each set, named by its first row (id), with the least key (rep).
    nodes: the classes that may have a partner. spread: their buckets, named by the least id in them (head)."""
    counted = written(_counted(docs, key, text, width, buffer), "shingles")
    sets = counted.filter(F.col("row").isNotNull()).select("row", key, "h", "n", "s1", "s2", "chunk")
    # One row for each class; copies of a class end here.
    classes = sets.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min(key).alias("rep"), F.min("row").alias("id"), F.min("chunk").alias("chunk"), F.count("*").alias("_c"))
    classes = written(classes, "classes")  # the least row is in the least chunk
    ids = classes.groupBy("chunk").agg(F.collect_list("id").alias("ids"))
    chunks = counted.filter(F.col("texts").isNotNull()).select("chunk", "texts")
    n = chunks.select("chunk").count()
    tasks = max(1, min(n, 64), n // CHUNKS)
    held = _ranks(counted).join(ids, "chunk").repartition(tasks, "chunk")
    nodes = written(_prefixed(chunks.repartition(tasks, "chunk").join(held, "chunk"), width, similarity, orders), "nodes")
    posted = nodes.select("id", F.explode(F.col("prefixes")[0]).alias("t"))
    buckets = posted.groupBy("t").agg(F.min("id").alias("head"), F.max("id").alias("_last"), F.count("*").alias("_c")).filter("head < _last").select("t", "head", "_c")
    spread = hot_joined(posted, written(buckets, "buckets"), ["t"], "_c").select("id", "head").distinct()
    spread = written(spread.join(nodes.select("id", "n", "sketch"), "id"), "spread")
    return sets, classes, nodes, spread


def links(docs: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", orders: int = ORDERS, buffer: int = BUFFER) -> tuple[DataFrame, DataFrame]:
    """All links between classes (a, b), as many rows as there are, and the members of each class (id, key, h)."""
    hundredths = round(similarity * 100)
    sets, classes, nodes, spread = _read(docs, key, text, width, hundredths / 100, orders, buffer)
    every = salted_joined(_side("x", spread), _side("y", spread), "head", "x_id", counted=spread)
    pairs = every.filter((F.col("x_id") < F.col("y_id")) & _plausible(hundredths / 100)).select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()
    members = hot_joined(sets.filter("n > 0"), classes.select("s1", "s2", "n", "id", "_c"), ["s1", "s2", "n"], "_c").select("id", key, "h")
    return _verified(pairs, nodes, hundredths, orders), members


def joined(docs: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", orders: int = ORDERS, buffer: int = BUFFER) -> DataFrame:
    """key, n_shingles, class_id (least id with the same set) and component_id (least id that links reach).

    similarity is taken in whole hundredths: a link has 100 * shared >= (hundredths) * union.
    """
    return _joined(docs, width, similarity, key, text, orders, buffer).drop("h", "comp")


def _joined(docs: DataFrame, width: int, similarity: float, key: str, text: str, orders: int, buffer: int) -> DataFrame:
    """joined, with the text's hash and the component's number (null for empty sets)."""
    hundredths = round(similarity * 100)
    similarity = hundredths / 100
    sets, classes, nodes, spread = _read(docs, key, text, width, similarity, orders, buffer)
    sizes = written(spread.groupBy("head").agg(F.count("*").alias("_c")), "sizes")
    heads = written(_side("y", nodes.select(F.col("id").alias("head"), "n", "sketch").join(sizes, "head")), "heads")
    star = hot_joined(_side("x", spread).filter("x_id <> head"), heads, ["head"], "y__c").filter(_plausible(similarity))
    stars = written(_verified(star.select(F.col("head").alias("a"), F.col("x_id").alias("b")), nodes, hundredths, orders), "stars")
    part = components(stars).toDF("id", "comp")
    placed = spread.join(part, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    # What is not connected with the head of its bucket meets all that is in the bucket.
    own = written(placed.filter("id = head").select("head", F.col("comp").alias("own")).join(sizes, "head"), "own")
    placed = written(hot_joined(placed, own, ["head"], "_c").drop("_c").withColumn("loose", F.col("comp") != F.col("own")), "loose")
    open_ = written(placed.groupBy("head").agg(F.count("*").alias("_c"), F.max("loose").alias("_any")).filter("_any").select("head", "_c"), "open")
    every = written(hot_joined(placed, open_, ["head"], "_c"), "every")
    cross = salted_joined(_side("y", every), _side("x", every.filter("loose")), "head", "y_id", counted=every)
    cross = cross.filter((F.col("x_comp") != F.col("y_comp")) & (~F.col("y_loose") | (F.col("x_id") < F.col("y_id"))) & _plausible(similarity))
    crossed = written(_verified(cross.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct(), nodes, hundredths, orders), "crossed")
    whole = components(stars.unionByName(crossed)).toDF("id", "comp")
    grouped = written(classes.join(whole, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "grouped")
    least = written(grouped.groupBy("comp").agg(F.min("rep").alias("least"), F.count("*").alias("_m")), "least")
    named = written(hot_joined(grouped, least, ["comp"], "_m").select("s1", "s2", "n", "rep", "comp", "least", "_c"), "named")
    on = ["s1", "s2", "n"]
    full = hot_joined(sets.filter("n > 0"), named, on, "_c").select(key, "h", F.col("n").alias("n_shingles"), F.coalesce("rep", key).alias("class_id"), F.coalesce("least", "rep", key).alias("component_id"), "comp")
    empty = sets.filter("n = 0").select(key, "h", F.col("n").alias("n_shingles"), F.col(key).alias("class_id"), F.col(key).alias("component_id"), F.lit(None).cast("bigint").alias("comp"))
    return full.unionByName(empty)


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", orders: int = ORDERS, buffer: int = BUFFER) -> DataFrame:
    """One row of docs for each component, with all its columns: that of the least id (of those with one id, or none, that of the
    least hash of the text). Rows without words are in no component and all stay."""

    def firsts() -> DataFrame:
        found = _joined(docs, width, similarity, key, text, orders, buffer).filter(F.col("comp").isNotNull())
        one = F.min(F.struct(F.col(key).isNull().alias("__q_x"), F.col(key).alias("__q_k"), F.col("h").alias("__q_t")))
        return found.groupBy("comp").agg(one.alias("_one")).select("_one.*")

    first = settled(docs.sparkSession, firsts, "kept")
    rows = docs.withColumn("__q_h", _named(text))
    wordless = F.coalesce(F.length(F.translate(F.col(text), SPACES, "")) == 0, F.lit(True))
    kept = rows.filter(~wordless).join(first, F.col(key).eqNullSafe(F.col("__q_k")) & (F.col("__q_h") == F.col("__q_t")), "left_semi").dropDuplicates([key, "__q_h"])
    return kept.unionByName(rows.filter(wordless)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import documents

    out = joined(documents(spark, sf_dir), width=3, similarity=0.9)
    return out.select("doc_id", "n_shingles", "component_id", "class_id")


def oracle_sql(width: int = 3, hundredths: int = 90) -> str:
    """All pairs that share a shingle, counted; components by reachability."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    gram = " || chr(10) || ".join(["word", *[f"lead(word, {k}) OVER p" for k in range(1, width)]])
    return f"""
WITH RECURSIVE s AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM s WHERE len(ws) >= {width}),
g AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, {gram} AS gram FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)) WHERE gram IS NOT NULL
      UNION SELECT doc_id, array_to_string(ws, chr(10)) FROM s WHERE len(ws) BETWEEN 1 AND {width - 1}),
n AS (SELECT doc_id, COUNT(*) AS n, md5(string_agg(gram, chr(11) ORDER BY gram)) AS whole FROM g GROUP BY doc_id),
c AS (SELECT whole, MIN(doc_id) AS class_id FROM n GROUP BY whole),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {hundredths} * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT s.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, coalesce(c.class_id, s.doc_id) AS class_id
FROM s JOIN (SELECT doc_id, MIN(reached) AS component_id FROM r GROUP BY doc_id) AS m ON m.doc_id = s.doc_id
LEFT JOIN n ON n.doc_id = s.doc_id LEFT JOIN c ON c.whole = n.whole
"""
