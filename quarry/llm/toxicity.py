"""Toxicity by weak supervision.

Many voters look at a document: lexicon voters (a word, or words with a given beginning, occurs) and pattern voters. A
generative label model estimates from their votes alone how often each fires in either class and which of them agree more
than that explains; those share one vote where they fire together. Its posteriors are the labels of a sparse linear classifier over word
beginnings, which scores every text.

The annotators' labels are no voter and no target. They choose the lexicons' candidates (what stands out in toxic texts
more than chance among so many words allows; a short public list is always among them) and give the share of toxic rows and
how many times as often a word is met in them at least; the label model and the classifier then see votes and words only, of
labelled rows and of rows without a label alike. So a wrong label is outvoted. Fitted are SAMPLE rows of each label and UNLABELLED others at most, the first by a hash; their
words are counted in Spark, and the driver gets FEATURES counts and, of each row, which of those occur. All texts are scored.

Null and empty texts get the score of a text without any feature; repeated rows get equal scores; of an id with several
texts the one of the least hash is fitted; rows whose id is null are scored and not fitted; other columns are kept and never
used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm.batches import flat, slices
from quarry.llm.common import temporary, written
from quarry.llm.wordhash import LETTERS, LOWER, hashes, mix, prefixes, words

#: Rows of each label, and rows whose label is not asked for, that the models are fitted on, at most.
SAMPLE, UNLABELLED = 2500, 5000
#: Voters, features of the classifier, and sizes of the word beginnings.
VOTERS, FEATURES, SHORTEST, LONGEST = 160, 2000, 4, 8
#: Values by which near copies are told, and the words in a row that each is the least hash of.
SIGNS, ROW = 4, 3
_SEEDS = np.random.default_rng(10).integers(1, 1 << 63, SIGNS + ROW, dtype=np.uint64) | np.uint64(1)
# Insults of public word lists; each starts with this weight in the classifier.
LEXICON, LISTED = "idiot moron stupid trash scum clown loser worthless disgusting pathetic".split(), 3.0

def folded(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the accented letters of two bytes that start with C3."""
    low = LOWER[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1 if len(raw) else np.empty(0, np.int64)
    after = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]
    low[after] += 0x20
    return low


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, 64-bit feature) of every word and word beginning, group by group."""
    raw, at = flat(texts)
    raw = folded(raw)
    starts, lengths, text = words(raw, at, LETTERS)
    yield text, hashes(raw, starts, lengths)
    for _, own, h in prefixes(raw, starts, lengths, SHORTEST, LONGEST):
        yield text[own], h


def shapes(texts: pa.Array) -> np.ndarray:
    """Votes of the pattern voters by text: shouting, runs of marks, words masked with stars."""
    raw, at = flat(texts)
    n = len(at) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask)]
        return total[at[1:]] - total[at[:-1]]

    upper, letters = per_text((raw >= 65) & (raw <= 90)), per_text(LETTERS[raw])
    marks = per_text((raw == 33) & (np.r_[raw[1:], 0][: len(raw)] == 33))
    stars = per_text((raw == 42) & LETTERS[np.r_[0, raw[:-1]][: len(raw)]] & LETTERS[np.r_[raw[1:], 0][: len(raw)]])
    return np.stack([(upper > 0.6 * letters) & (letters > 20), marks > 3, stars > 1], axis=1) if n else np.zeros((0, 3), bool)


def signs(texts: pa.Array) -> np.ndarray:
    """SIGNS values of each text: least hashes of ROW words in a row, of which near copies share most (0 without such words)."""
    raw, at = flat(texts)
    starts, lengths, text = words(folded(raw), at, LETTERS)
    h = hashes(folded(raw), starts, lengths)
    n = max(len(h) - ROW + 1, 0)
    row = sum((h[j : j + n] * _SEEDS[SIGNS + j] for j in range(ROW)), np.zeros(n, np.uint64))
    own = np.flatnonzero(text[:n] == text[ROW - 1 :][:n])
    out = np.zeros((len(at) - 1, SIGNS), np.int64)
    if len(own):
        of = text[own]
        new = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for k in range(SIGNS):
            out[of[new], k] = np.minimum.reduceat(mix(row[own] ^ _SEEDS[k]), new).view(np.int64)
    return out


def weights(same: np.ndarray) -> np.ndarray:
    """A weight for each row: 1 by the rows that share one of its values (column by column; 0 is none), so that copies and near
    copies of one text weigh about as much as one text together."""
    size = np.ones(len(same))
    for column in same.T:
        _, group, count = np.unique(column, return_inverse=True, return_counts=True)
        size = np.maximum(size, np.where(column != 0, count[group], 1))
    return 1 / size


@dataclass
class Model:
    """Sorted features, their weights, and the weight of a text without any."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        seen = []
        for text, h in features(texts):
            if len(self.keys) and len(h):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == h)
                seen.append(text[hit] * len(self.keys) + at[hit])
        if seen:
            once = np.unique(np.concatenate(seen))  # a feature counts once in a text
            np.add.at(total, once // len(self.keys), self.weights[once % len(self.keys)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def label_model(votes: np.ndarray, lexicon: int, prior: float, lift: np.ndarray | None = None, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, how often each voter fires in either class, and the correlations that the classes do not explain.

    votes: rows x voters, fired or not; the first `lexicon` of them are words of which none holds another. To begin with, a row
    is as likely toxic as the most agreeing of its words finds another one of them by its side. Firing rates come from
    expectation maximisation, in the course of which the correlations are estimated; where correlated voters fire on one row,
    each has the share 1 / (1 + sum of its correlations with the others), so that a cluster has one vote together.

    lift: for each word, how many times as often as otherwise it fires on the toxic at least. Toxic rows come in kinds that share
    no word (languages); without that bound the rounds take the largest kind for the class and all others for its contrary.
    """
    v = votes.astype(float)
    n, m = v.shape
    own = v[:, :lexicon]
    agreeing = (own * (own.sum(1, keepdims=True) > 1)).sum(0) / np.maximum(own.sum(0), 1)
    q = np.clip((own * agreeing).max(1, initial=0), 0.01, 0.99)
    rates, corr = np.zeros((2, m)), np.zeros((m, m))
    times = np.r_[np.ones(lexicon) if lift is None else lift, np.zeros(m - lexicon)]
    for step in range(rounds):
        w = np.stack([1 - q, q])
        fires, size = w @ v + np.array([[0.02], [0.1]]), w.sum(1, keepdims=True) + 2.0
        rates = fires / size
        least = fires.sum(0) / (size[0] + times * size[1])  # the likeliest rates on the bound
        rates = np.clip(np.where(rates[1] < times * rates[0], np.stack([least, times * least]), rates), 1e-5, 1 - 1e-5)
        if step % 5 == 4:
            rest = v - (q[:, None] * rates[1] + (1 - q)[:, None] * rates[0])
            scale = np.sqrt((rest**2).mean(0)) + 1e-9
            corr = (rest.T @ rest) / n / np.outer(scale, scale)
            np.fill_diagonal(corr, 0)
            corr = np.where(corr > 0.2, corr, 0)
        # Silence is weak evidence: all voters' silence together counts as much as that of four voters.
        quiet, fire = np.log1p(-rates[1]) - np.log1p(-rates[0]), np.log(rates[1]) - np.log(rates[0])
        odds = np.log(prior / (1 - prior)) + (v / (1 + v @ corr)) @ fire + (1 - v) @ quiet / m * 4
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q, rates, corr


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, decay: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a regression on soft labels, drawn towards the starting weights (accelerated gradient steps)."""
    n, m = x.shape
    y, weight, start = (z.astype(np.float32) for z in (y, weight, start))
    w, b, vw, vb = start.copy(), 0.0, np.zeros(m, np.float32), 0.0
    step = np.float32(4.0 / (1 + x.sum(1).max()))  # x is 0 or 1
    total = np.float32(weight.sum())
    for k in range(steps):
        mom = np.float32(k / (k + 3))
        lw, lb = w + mom * vw, b + mom * vb
        err = (1 / (1 + np.exp(-np.clip(x @ lw + lb, -30, 30))) - y) * weight
        nw, nb = lw - step * (err @ x / total * 8 + np.float32(decay / n) * (lw - start)), lb - step * err.sum() / total * 8
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def _public() -> np.ndarray:
    """The features of the listed words, as whole words."""
    return np.unique(np.concatenate([next(features(pa.array([w], pa.large_string())))[1] for w in LEXICON]))


def _apart(votes: np.ndarray) -> np.ndarray:
    """Of voters in order of worth, those that do not fire on hardly any but the texts of one before, as beginnings of one word do."""
    own, chosen = votes.sum(0), []
    both = votes.astype(np.float32).T @ votes.astype(np.float32)
    for j in range(votes.shape[1]):
        if own[j] and all(both[j, k] <= 0.9 * min(own[j], own[k]) for k in chosen):
            chosen.append(j)
    return np.array(chosen, dtype=int)


def fitted(x: np.ndarray, keys: np.ndarray, strong: np.ndarray, lift: np.ndarray, shaped: np.ndarray, prior: float) -> tuple[Model, np.ndarray]:
    """The classifier and the posteriors of the rows, from votes and features alone.

    x: rows x keys, whether a feature occurs. strong: the features that may be voters, the worthiest first; lift: how many times
    as often each is met in toxic texts. shaped: votes of the patterns. prior: the share of the toxic.
    """
    public = _public()
    lexicon = x[:, strong] > 0
    apart = _apart(lexicon)[:VOTERS]
    posterior, _, _ = label_model(np.concatenate([lexicon[:, apart], shaped], axis=1), len(apart), prior, lift[apart])
    # Both classes weigh the same: a missed text costs as much as a wrong alarm among as many texts.
    weight = posterior / max(posterior.sum(), 1e-9) + (1 - posterior) / max((1 - posterior).sum(), 1e-9)
    w, b = logistic(x, posterior, weight / weight.mean(), np.where(np.isin(keys, public), LISTED, 0.0))
    # Where the classes leave a gap, the middle of the gap is the score 1/2.
    logit, is_toxic = x @ w + b, posterior >= 0.5
    if is_toxic.any() and not is_toxic.all():
        low, high = np.quantile(logit[~is_toxic], 0.999), np.quantile(logit[is_toxic], 0.01)
        if low < high:
            b -= (low + high) / 2
    keep = np.abs(w) > 1e-4
    unseen = np.setdiff1d(public, keys)
    all_keys, all_weights = np.concatenate([keys[keep], unseen]), np.concatenate([w[keep], np.full(len(unseen), LISTED)])
    by = np.argsort(all_keys)
    return Model(all_keys[by], all_weights[by], float(b)), posterior


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5


def _extracted(texts: DataFrame) -> DataFrame:
    """k, h (the text's hash), y, fs (the distinct features), shapes and signs of each text; repeated rows once."""
    kind, names = texts.schema["k"].dataType.simpleString(), ["k", "h", "y", "fs", "shapes", "signs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column(3)):
                pairs = list(features(part))
                text, h = np.concatenate([t for t, _ in pairs]), np.concatenate([f for _, f in pairs]).view(np.int64)
                by = np.lexsort((h, text))
                text, h = text[by], h[by]
                new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.zeros(0, bool)
                cut = np.r_[0, np.cumsum(np.bincount(text[new], minlength=len(part)))].astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(cut), pa.array(h[new], pa.int64()))
                votes = pa.array(shapes(part).tolist(), pa.list_(pa.bool_()))
                near = pa.array(signs(part).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(part)) for c in range(3)), found, votes, near], names=names)

    schema = f"k {kind}, h bigint, y int, fs array<bigint>, shapes array<boolean>, signs array<bigint>"
    return texts.select("k", "h", "y", "t").mapInArrow(run, schema).dropDuplicates(["k", "h"])


def _chosen(found: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sorted features that stand out in toxic texts, their worth, and how many times as often they are met there at least (as if one
    more clean text had them); and the least worth that chance does not give. Copies count as one text together: else each word
    of a toxic text with many copies would stand out."""
    known = found.filter("y IS NOT NULL")
    rows = known.select("k", "h", "y", "signs").collect()  # 2 per_label at most, and no text
    weight = weights(np.array([[r["h"], *r["signs"]] for r in rows], dtype=np.int64))
    n1 = sum(float(w) for w, r in zip(weight, rows) if r["y"])
    n0 = float(weight.sum()) - n1
    weighed = found.sparkSession.createDataFrame([(r["k"], float(w)) for r, w in zip(rows, weight)], StructType([found.schema["k"], StructField("w", DoubleType())]))
    counted = known.join(F.broadcast(weighed), "k").select("y", "w", F.explode("fs").alias("f")).groupBy("f").agg(F.sum(F.col("y") * F.col("w")).alias("t"), F.sum("w").alias("n"))
    counted = written(counted, "counted")

    def part(seen: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (F.col("n") * share))).otherwise(0.0)

    share = n1 / (n1 + n0)
    worth = 2 * (part(F.col("t"), share) + part(F.col("n") - F.col("t"), 1 - share))  # the likelihood ratio's statistic
    lift = (F.col("t") + 0.1) / (n1 + 1) / ((F.col("n") - F.col("t") + 0.1) / (n0 + 1))
    listed = F.col("f").isin(*_public().view(np.int64).tolist())
    some = counted.filter(listed | ((F.col("t") >= (3 if n1 >= 60 else 2)) & (lift > 4.5)))
    least_lift = F.greatest(F.lit(1.0), F.col("t") / (n1 + 1) / ((F.col("n") - F.col("t") + 1) / (n0 + 1)))
    top = some.select("f", F.when(listed, worth + 1e6).otherwise(worth).alias("g"), least_lift.alias("l")).orderBy(F.desc("g"), "f").limit(FEATURES).collect()
    least = 2 * np.log(max(counted.count(), 1) / 0.05)
    keys, gains, lift = np.array([r["f"] for r in top], dtype=np.int64).view(np.uint64), np.array([r["g"] for r in top]), np.array([r["l"] for r in top])
    by = np.argsort(keys)
    return keys[by], gains[by], lift[by], least


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = SAMPLE, unlabelled: int = UNLABELLED) -> Model:
    """Fits on rows outside of fold 0: the per_label first of each label, and `unlabelled` others, by a hash."""
    with temporary(docs.sparkSession):
        return _trained(docs, labels, key, text, label, per_label, unlabelled)[0]


def _trained(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int, unlabelled: int) -> tuple[Model, dict]:
    """The model, and the posterior of each fitted row by its key."""
    public = _public()
    listed = Model(public, np.full(len(public), LISTED), -LISTED / 2), {}
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(F.col(key)) != 0)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    firsts = [known.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(1), "k"), "k").limit(per_label) for y in (0, 1)]
    rows = docs.filter(F.col(key).isNotNull() & (fold(F.col(key)) != 0)).select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("t"))
    own = rows.join(F.broadcast(firsts[0].unionByName(firsts[1])), "k").groupBy("k", "y").agg(F.min("h").alias("h"))  # 2 per_label rows at most
    own = written(own, "labelled")
    others = rows.groupBy("k").agg(F.min("h").alias("h")).orderBy(F.xxhash64(F.lit(2), "k"), "k").limit(unlabelled)
    sample = own.select("k", "h", "y").unionByName(others.join(F.broadcast(own.select("k")), "k", "left_anti").select("k", "h", F.lit(None).cast("int").alias("y")))
    found = written(_extracted(rows.join(F.broadcast(written(sample, "sample")), ["k", "h"])), "extracted")
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):  # the public list alone
        return listed
    keys, worth, lift, least = _chosen(found)
    index = docs.sparkSession.createDataFrame([(int(f), i) for i, f in enumerate(keys.view(np.int64))], "f bigint, i int")
    hits = found.select("k", F.explode("fs").alias("f")).join(F.broadcast(index), "f").groupBy("k").agg(F.collect_list("i").alias("hits"))
    got = found.select("k", "shapes").join(hits, "k", "left").orderBy("k").collect()  # a row each, FEATURES numbers at most
    x = np.zeros((len(got), len(keys)), dtype=np.float32)
    for row, r in zip(x, got):
        row[r["hits"] or []] = 1
    order = np.argsort(-worth, kind="stable")
    strong = order[worth[order] >= least]
    if not len(strong):
        return listed
    model, posterior = fitted(x, keys, strong, lift[strong], np.array([r["shapes"] for r in got], dtype=bool), shares[1] / (shares[0] + shares[1]))
    return model, {r["k"]: float(p) for r, p in zip(got, posterior)}


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(sent.value.scores(texts), pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(place)):
                yield batch.slice(start, len(texts)).filter(pa.array(sent.value.scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import documents, table

    docs = documents(spark, sf_dir)
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
