"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A string that a trained vocabulary cuts into many tokens for its length was not written by people. Long runs of key
characters are tested that way, cut at '=' and '.' (names, domains, the parts of a JWT) and, where a part is not random as a
whole, at '/' and then at other marks. Known digests (hex of the usual lengths), UUIDs, numbers and plain identifiers (words
joined by marks) are set aside; a string of letters alone is judged by its tokens only. Of a run that holds a span of a fixed
pattern the rest is tested, and the string of letters and digits that the span is part of.

A null or empty text has no spans; spans are code points of the whole text, end exclusive; repeated rows are scanned one
by one; other columns are kept by `redacted`. The vocabulary is read on the driver and sent to the workers.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import slices

#: Kinds in the order of the results: three with a fixed pattern, and what the token test adds.
BASE, KINDS = ("assign", "access", "hex"), ("assign", "access", "hex", "random")
#: Characters of a run that is tested.
SHORTEST = 16
#: The most characters to a token, by the least length they are for: short strings vary more. Of random strings 97 % and more have
#: less (16 characters), of long ones 99 % and more.
MOST = ((20, 2.2), (SHORTEST, 2.0))
#: The same for letters in the shape of one word: long words of other languages have 2.07 and more, invented ones of 16 to 19 letters
#: under 1.8 about once in 500. Of random lower-case letters seven in ten of 16, and 98 % of 20 and more, are found.
MOST_IN_A_WORD = ((20, 2.0), (SHORTEST, 1.8))
MASK = "[SECRET]"


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile("(" + "|".join(re.sub(r"[a-z]", lambda m: _either(m[0]), n) for n in NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the same runs as [0-9a-f]+ of 16 and more
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")  # every span of the other kinds lies in one of these

_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
#: Words, capitalised words or numbers, joined by marks: paths, versions, file names, table rules.
_IDENTIFIER = re.compile(r"[-_./=+]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[A-Za-z]+[0-9]{1,4})(?:[-_./=+]+|$))*")
#: Parts of a run, with the padding of base64 where nothing follows it; and the cuts of a part that is not random as a whole.
_PART = re.compile(r"[A-Za-z0-9+/_-]+(?:={1,2}(?=\.|$))?")
_CUTS = (re.compile(r"[^/]+"), re.compile(r"[^/_+-]+"))
_SOLID = re.compile(r"[A-Za-z0-9]+")
#: Characters whose tokens are counted at once.
_AT_ONCE = 1000


def _mixed(run: str) -> bool:
    """Letters alone, or letters and digits that alternate: at least three changes between lower case, upper case and digits."""
    kinds = [1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 0 for c in run]
    kinds = [k for k in kinds if k]
    return (1 in kinds or 2 in kinds) and (3 not in kinds or sum(a != b for a, b in zip(kinds, kinds[1:])) >= 3)


def _dense(core: str, tokens, most: tuple = MOST) -> bool:
    ratio = next((r for least, r in most if len(core) >= least), 0.0)
    return len(core) <= ratio * sum(tokens(core[k : k + _AT_ONCE]) for k in range(0, len(core), _AT_ONCE))


def _random(core: str, tokens) -> bool:
    if len(core) < SHORTEST or not _mixed(core) or _DIGEST.fullmatch(core) or _UUID.search(core):
        return False
    plain = _IDENTIFIER.fullmatch(core)
    return (not plain or core.isalpha()) and _dense(core, tokens, MOST_IN_A_WORD if plain else MOST)


def _parts(s: str, at: int, tokens, cuts=(_PART, *_CUTS)) -> Iterator[tuple[str, int, int]]:
    """The random parts of s, which starts at `at`: the longest that are random as a whole, without the folders of a path around them."""
    for m in cuts[0].finditer(s):
        if len(m[0]) < SHORTEST:
            continue
        a, b = m.span()
        if cuts[0] is _PART and _random(m[0], tokens):
            own = [p.span() for p in _CUTS[0].finditer(s, a, b)]
            worded = [bool(_IDENTIFIER.fullmatch(s[i:j])) and not _dense(s[i:j], tokens) for i, j in own]
            if False in worded and True in (worded[0], worded[-1]):
                a, b = own[worded.index(False)][0], own[len(own) - 1 - worded[::-1].index(False)][1]
        if _random(s[a:b], tokens):
            yield "random", at + a, at + b
        elif len(cuts) > 1:
            yield from _parts(m[0], at + m.start(), tokens, cuts[1:])


def _around(s: str, start: int, own: list[tuple[str, int, int]], tokens) -> set[tuple[str, int, int]]:
    """The random strings of letters and digits that hold one of a run's own spans and more."""
    found = set()
    for _, a, b in own:
        held = next((m for m in _SOLID.finditer(s) if m.start() <= a - start < m.end()), None)
        if held and held.end() - held.start() > b - a and _random(held[0], tokens):
            found.add(("random", start + held.start(), start + held.end()))
    return found


def encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("quarry", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def spans(text: str, tokens) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind. tokens: counts the tokens of a string."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    for run in RUN.finditer(text):
        s, start = run[0], run.start()
        own = [("access", start + m.start(), start + m.end()) for m in ACCESS.finditer(s) if m.end() - m.start() >= 18]
        own += [("hex", start + m.start(), start + m.end()) for m in HEX.finditer(s)]
        found += own
        found += _around(s, start, own, tokens)
        done = 0
        for _, a, b in [*sorted(own, key=lambda x: x[1]), ("", start + len(s), start + len(s))]:
            found += _parts(s[done : max(done, a - start)], start + done, tokens)
            done = max(done, b - start)
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


_loaded: dict[str, object] = {}


def _tokens(ranks: bytes, pattern: str):
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _loaded:
        _loaded[key] = encoder(ranks, pattern)
    e = _loaded[key]
    return lambda s: len(e.encode_ordinary(s))


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def scanned(docs: DataFrame, vocabulary_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans: an array of (kind, start, end)."""
    ranks = _vocabulary(docs, vocabulary_path)
    kind = docs.schema[key].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks.value, pattern)
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                out = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(x, tokens)] for x in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(out, item)], names=[key, "spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind:string,start:int,end:int>>")


def masked(text: str, tokens, mask: str = MASK) -> str:
    """text with every span (overlapping ones as one) replaced by the mask."""
    out, done = [], 0
    for _, a, b in spans(text, tokens):
        if a >= done:
            out += [text[done:a], mask]
        done = max(done, b)
    return "".join(out) + text[done:] if out else text


def redacted(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with the secrets of the text masked; nulls stay null. length: a column with the number of characters, kept true."""
    ranks = _vocabulary(docs, vocabulary_path)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks.value, pattern)
        for batch in batches:
            column = batch.column(place)
            out = [x if x is None else masked(x, tokens) for x in (v.as_py() for v in column)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, column.type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length else out


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.common import documents

    out = scanned(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def joined(spans_):
        return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return out.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
