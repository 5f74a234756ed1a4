"""Queries against their SQL or a brute-force version, over a real table and over the edges."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from compare import same
from helpers import rows

from quarry.llm import fingerprints, licenses, line_dedup, queries, secrets

PAT = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def result(spark, name, where):
    return queries.QUERIES[name](spark, where).toPandas()


def docs(spark, where):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_table(spark, none, name):
    assert len(result(spark, name, none)) == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    assert same(result(spark, name, sf), duck.sql(queries.ORACLE_SQL[name]).df())


def test_ngram_join(spark, sf, edge):
    for where in (sf, edge):
        got = result(spark, "op2_ngram_join", where)
        sets = []
        for i, t in docs(spark, where):
            w = PAT.findall((t or "").translate(LOW))
            sets.append((i, frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()))
        parent = list(range(len(sets)))

        def find(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets[:a]):
                if x and y and 100 * len(x & y) >= 90 * len(x | y):
                    parent[find(a)] = find(b)
        least: dict = {}
        for k, (i, _) in enumerate(sets):
            if i is not None:
                least[find(k)] = min(i, least.get(find(k), i))
        want = sorted((str(i), len(x), least.get(find(k))) for k, (i, x) in enumerate(sets))
        assert sorted((str(None if math.isnan(r.doc_id) else int(r.doc_id)), r.n_shingles, int(r.component_id)) for r in got.itertuples()) == want


def level(t):
    return next(k for k, (most, _, _) in enumerate(fingerprints.LEVELS) if len(t) <= most)


def pieces(t, at):
    """The pieces of a text, found by hand."""
    _, least, most = fingerprints.LEVELS[at]
    out = set()
    for line in t.split("\n"):
        while line:
            cut = next((k + 2 for k in range(least, min(most, len(line)) + 1) if line[k : k + 1] in tuple(fingerprints.ENDS) and line[k + 1 : k + 2] == " "), min(most, len(line)))
            out.add(line[:cut])
            line = line[cut:]
    return out


def cells(own):
    """The smallest table of a set of pieces, cell by cell."""
    table: dict = {}

    def h64(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    for p in own:
        k = h64(p.encode())
        raw = k.to_bytes(8, "little")
        part = fingerprints.CELLS // 3
        for j in range(3):
            c = signed(h64(j.to_bytes(4, "little"), h64(raw))) % part + part * j
            n, x, y = table.get(c, (0, 0, 0))
            table[c] = (n + 1, x ^ k, y ^ (h64((99).to_bytes(4, "little"), h64(raw)) & 0xFFFFFFFF))
    return ",".join(f"{c:X}:{n}:{x:X}:{y:X}" for c, (n, x, y) in sorted(table.items()))


def test_fingerprints(spark, sf, edge):
    for where in (sf, edge):
        got = result(spark, "op3_fingerprints", where)
        own = docs(spark, where)
        assert len(got) == len(own)
        texts = {(-1 if i is None else i): t or "" for i, t in own}
        order = sorted({k for k in texts}, reverse=True)
        after = dict(zip(order, order[1:] + order[:1]))
        by_text: dict = {}
        for r in got.itertuples():
            i = -1 if math.isnan(r.doc_id) else int(r.doc_id)
            text, then = texts[i], texts[after[i]]
            k = len(text) // 3
            edited = text[: len(text) - k] + then[:k]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert by_text.setdefault(text, r.fingerprint) == r.fingerprint

            for near, other in ((r.near_edited, edited), (r.near_next, then)):
                at = max(level(text), level(other))
                a, b = pieces(text, at), pieces(other, at)
                assert near == pytest.approx(1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0)
            assert r.fingerprint == cells(pieces(text, level(text))) and r.edited_fingerprint == cells(pieces(edited, level(edited)))


def test_packing(spark, sf, edge):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for where in (sf, edge):
        got = result(spark, "op4_packing", where)
        own = docs(spark, where)
        ids: dict = {}
        for i, t in own:
            ids.setdefault(-1 if i is None else i, []).append(np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4"))
        assert got.length.sum() == sum(len(x) for xs in ids.values() for x in xs)
        for r in got.itertuples():
            x = ids[-1 if math.isnan(r.doc_id) else int(r.doc_id)][0]
            assert r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        for i, g in got.dropna().groupby("doc_id"):
            spans = sorted(zip(g.start, g.length))
            assert [a for a, _ in spans] == sorted(list(np.cumsum([0, *[n for _, n in sorted(set(spans))]])[:-1]) * len(ids[int(i)])) or len(ids[int(i)]) > 1
        for _, g in got.groupby("sequence_id"):
            g = g.sort_values("offset")
            total = int(g.length.sum())
            assert list(g.offset) == list(np.cumsum([0, *g.length])[:-1]) and (total == 2048 or total & (total - 1) == 0 and total < 2048)


def test_sharding(spark, sf, edge):
    for where in (sf, edge):
        got = result(spark, "op5_sharding", where)
        own = docs(spark, where)
        assert len(got) == len(own)
        want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in own)
        assert sorted((str(None if math.isnan(r.doc_id) else int(r.doc_id)), r.size, r.text_crc32) for r in got.itertuples()) == want
        counts = got.groupby("shard").size()
        sizes = [counts.get(k, 0) for k in range(24)]
        assert max(sizes) - min(sizes) <= 1 and set(got.law) == {"rows"} and got.grown_shard.isna().all()
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
    mixture = result(spark, "op5_sharding", sf)
    per = mixture.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (per.max(axis=1) - per.min(axis=1)).max() <= 2


def test_sentencepiece(spark, sf, edge):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for where in (sf, edge):
        got = result(spark, "op6_sentencepiece", where)
        want = []
        for i, t in docs(spark, where):
            ids = [*sp.encode(t or ""), 2]
            want.append((str(i), len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), sp.decode(ids)))))
        assert sorted((str(None if math.isnan(r.doc_id) else int(r.doc_id)), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.itertuples()) == sorted(want)


def test_secrets(spark, sf, edge):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for where in (sf, edge):
        got = result(spark, "op9_secrets", where)
        want = []
        for i, t in docs(spark, where):
            t = t or ""
            found = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 12]
            found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
            found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
            counts = [sum(k == kind for k, *_ in found) for kind in secrets.BASE]
            found.sort(key=lambda x: (x[1], secrets.BASE.index(x[0])))
            want.append((str(i), *counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()))
        assert sorted((str(None if math.isnan(r.doc_id) else int(r.doc_id)), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got.itertuples()) == sorted(want)
        for r in got.itertuples():  # base spans stay among all spans
            kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
            assert (kinds.count("assign"), kinds.count("access"), kinds.count("hex")) == (r.n_assign, r.n_access, r.n_hex)


def test_quality_edges(spark, edge):
    got = result(spark, "op8_quality_rules", edge)
    want = []
    for i, t in docs(spark, edge):
        t = t or ""
        w = PAT.findall(t)
        grams: dict = {}
        for k in range(len(w) - 2):
            grams.setdefault(tuple(w[k : k + 3]), []).append(k)
        again = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(3)}
        lines = [x for x in t.split("\n") if PAT.search(x)]
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    assert sorted((str(None if math.isnan(r.doc_id) else int(r.doc_id)), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.itertuples()) == sorted(want)
    assert not (got.base_failed & got.kept).any()


def test_toxicity_edges(spark, edge):
    got = result(spark, "op10_toxicity", edge)
    assert len(got) == len(rows()) and got.score.between(0, 1).all()
    known = got.dropna(subset=["doc_id"])
    assert list(known.held_out) == [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in known.doc_id]


def test_toxicity_on_held_out_labels(spark):
    where = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in queries.QUERIES["op10_toxicity"](spark, where).collect() if r.held_out and r.doc_id in truth]
    wrong = sum(p and not t for t, p in held)
    assert sum(p and t for t, p in held) >= 0.6 * sum(t for t, _ in held) and wrong <= 0.02 * len(held)


def test_line_dedup_edges(spark, edge):
    got = {(-1 if math.isnan(r.doc_id) else int(r.doc_id)): r for r in result(spark, "op7_line_dedup", edge).itertuples()}
    cut = {}
    for i, t in docs(spark, edge):
        if i is None or t is None:
            continue
        pattern = r"(?<=\n)|(?<=[.!?] )"
        us = [u for u in re.split(pattern, t)] if "\x01" in t else t.replace("\n", "\n\x01").replace(". ", ". \x01").replace("! ", "! \x01").replace("? ", "? \x01").split("\x01")
        cut[i] = us
    first, gone = {}, {i: set() for i in cut}
    for i in sorted(cut):
        solid = [u.strip(" \t\n\r") for u in cut[i]]
        size = [u.count(" ") + 1 for u in solid]
        whole, back = len(solid), len(solid)
        while back and sum(size[back:]) < line_dedup.MIN_WORDS:
            back -= 1
        found = {(back, whole - back)} if sum(size) >= line_dedup.MIN_WORDS else set()
        for p in range(whole):
            e = next((n for n in range(1, whole - p + 1) if sum(size[p : p + n]) >= line_dedup.MIN_WORDS), 0)
            found |= {(p, e)} if e else set()
        for p, e in sorted(found):
            body = tuple(solid[p : p + e])
            if body in first:
                d, q, n = first[body]
                gone[i] |= set(range(max(p, q + n) if d == i else p, p + e))
            else:
                first[body] = (i, p, e)
    for i, us in cut.items():
        text = "".join(u for k, u in enumerate(us) if k not in gone[i])
        assert (got[i].n_gone, got[i].text_md5) == (len(gone[i]), hashlib.md5(text.encode()).hexdigest()), i


def test_licenses(spark, edge, sf):
    for family, texts in licenses.TEMPLATES.items():
        assert all(any(a in t.lower() for a in licenses.ANCHORS) for t in texts), family
    lines = [(k, t) for k, (f, t) in enumerate((f, t) for f, ts in licenses.TEMPLATES.items() for t in ts)]
    families = [f for f, ts in licenses.TEMPLATES.items() for _ in ts]
    got = licenses.scanned(spark.createDataFrame(lines, "doc_id bigint, text string")).toPandas().set_index("doc_id")
    right = sum(got.family.get(k) == families[k] for k, _ in lines)
    assert right >= 0.9 * len(lines)
    others = spark.createDataFrame(list(enumerate(licenses.OTHERS)), "doc_id bigint, text string")
    assert not licenses.scanned(others).toPandas().confirmed.any()
    own = licenses.by_document(spark.read.parquet(f"{edge}/documents.parquet")).toPandas()
    assert len(own) == len(rows()) and "mit" in set(own.families)
    real = {r.doc_id: r.families for r in licenses.by_document(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    names = {"MIT License": "mit", "Apache License": "apache", "GNU General Public": "gpl", "CC BY-NC 4.0": "cc-by-nc", "All rights reserved.": "proprietary"}
    for i, t in docs(spark, sf):
        assert real[i] == (",".join(sorted(f for n, f in names.items() if n in t)) or "none"), t[-200:]


def test_wrapped_notices_and_ids_on_several_texts(spark):
    gpl = "Some prose before it.\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nint main() {}"
    mit = "A tool\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction.\n"
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [(1, gpl), (2, mit), (8, "x"), (8, apache), (8, "Released under the MIT License."), (None, apache), (None, "y"), (2**60 + 1, apache), (2**60 + 1, apache), (3, None), (4, "")]
    got = licenses.by_document(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(1, "gpl"), (2, "mit"), (8, "none"), (8, "apache"), (8, "mit"), (None, "apache"), (None, "none"), (2**60 + 1, "apache"), (2**60 + 1, "apache"), (3, "none"), (4, "none")]
    assert sorted(((r.doc_id, r.families) for r in got), key=str) == sorted(want, key=str)


def test_bare_rights_notice(spark, sf):
    lines = ["All rights reserved.", "Some prose of no weight.\nAll rights reserved.", "Copyright 2020 Someone. All rights reserved.", "All citizens have the same rights."]
    got = licenses.by_document(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.families for r in got] == ["proprietary"] * 3 + ["none"]
    real = {r.doc_id: r.families for r in licenses.by_document(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    names = {"MIT License": "mit", "Apache License": "apache", "GNU General Public": "gpl", "CC BY-NC 4.0": "cc-by-nc", "All rights reserved.": "proprietary"}
    for i, t in docs(spark, sf):
        assert real[i] == (",".join(sorted(f for n, f in names.items() if n in t)) or "none"), t[-200:]


def test_notices_without_an_anchor(spark):
    notices = {
        "CC BY-NC 4.0": "cc-by-nc", "CC BY-SA 4.0": "cc-by", "GNU GPL v2 or later": "gpl", "Apache, Version 2.0": "apache", "GNU General Public, version 3": "gpl",
        "nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd",
    }
    assert not any(a in n.lower() for n in notices for a in licenses.ANCHORS)
    prose = ["He went there mit the others.", "mit", "of the and to in", "The general sold the software to the public.", "Version 2.0 of the song", "All of them reserved a table."]
    df = spark.createDataFrame(list(enumerate(["Some prose.\n" + n for n in notices] + prose)), "doc_id bigint, text string")
    got = [r.families for r in licenses.by_document(df).orderBy("doc_id").collect()]
    assert got == [*notices.values(), *["none"] * len(prose)]
