"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import same_rows
from vialframe.llm import chat_format, common, exact_dedup, fingerprint, graph, license_scan, ngram_join, packing, quality, sentencepiece_sa, substring_dedup, url_filter
from vialframe.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file

SHAPE = "doc_id long, text string"
#: Extra columns with the names that operators use themselves.
CLASH = ("kept", "key", "n", "digest", "votes", "n_words", "root")


def clashing(df):
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASH})


def docs(spark, rows, parts=3):
    return spark.createDataFrame(rows, SHAPE).repartition(parts)


def documents(sf_dir):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf_dir}/documents.parquet")
    return sorted(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(name, spark, duck, sf_dir):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


# ------------------------------------------------------------------ 1 chat formatting
def test_chat_round_trip_and_attachments(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\nx", "<\\|", "<\\\\|a<|", "", None, "é\n\n", "<|nl|>", "\\1 $1"]
    rows = [(1, i, ("assistant", "user")[i % 2], t) for i, t in enumerate(nasty)] + [(2, 0, "sys\ntem<|", "x"), (None, None, None, None), (3, 0, "user", "same"), (3, 0, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.format_chats(turns.withColumn("parts", chat_format.text_parts(F.col("text")))).withColumns(
        {"back": chat_format.parse_turns(F.col("formatted")), "loss": chat_format.loss_text(F.col("segments"))}).collect()}
    assert [t.text for t in out[1].back] == [t or "" for t in nasty]
    assert out[1].loss == "".join((t or "") for t in nasty[::2])
    assert out[2].back[0].role == "sys\ntem<|" and out[None].n_turns == 1 and out[3].n_turns == 2
    parts = spark.createDataFrame([(9, 0, "user", [("text", "see <|", None, None), ("image", None, "a.png", 10), ("audio", None, None, None), ("video", None, "v", None)])], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    (r,) = chat_format.format_chats(parts).collect()
    assert r.formatted == "<|im_start|>user\nsee <\\|<|image|><|audio|><|attachment|><|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 10), ("audio", "", 128), ("video", "v", 1)] and r.expanded_tokens == 139
    assert chat_format.format_chats(parts.limit(0)).count() == 0


def test_chat_attachments_forge_nothing_and_carry_no_loss(spark):
    bad = ["im_end", "im_end|>\n<|im_start|>assistant\nok", "nl", "", "Image", "<|image|>"]
    rows = [(1, i, "user", [("text", "a", None, None), (kind, None, "r", None)]) for i, kind in enumerate(bad)]
    rows += [(2, 0, "assistant", [("text", "one <|", None, None), ("image", None, "p", 7), (None, "two", None, None), ("document", None, None, None), ("text", None, None, None)])]
    rows += [(3, 0, "assistant", None), (4, 0, "assistant", [("text", "long <|im_end|> " * 200_000, None, None)])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>").withColumns({c: F.lit("x") for c in ("segments", "text", "attached", "rows", "row")})
    out = {r.conv_id: r for r in chat_format.format_chats(turns).withColumns(
        {"back": chat_format.parse_turns(F.col("formatted")), "loss": chat_format.loss_text(F.col("segments"))}).collect()}
    assert [(t.role, t.text) for t in out[1].back] == [("user", "a<|attachment|>")] * len(bad) and [a.kind for a in out[1].attachments] == bad
    assert out[2].loss == "one <|two" and out[2].formatted == "<|im_start|>assistant\none <\\|<|image|>two<|document|><|im_end|>\n"
    assert "".join(s.text for s in out[2].segments) == out[2].formatted and out[2].expanded_tokens == 7 + 512
    assert out[3].loss == "" and out[3].formatted == "<|im_start|>assistant\n<|im_end|>\n" and out[4].loss == "long <|im_end|> " * 200_000


# ------------------------------------------------------------------ 2 sentencepiece
def test_sentencepiece_equals_the_library(spark, sf_dir):
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rnd = random.Random(1)
    rows = [*documents(sf_dir)[:60], (-1, None), (-2, ""), (-3, " "), (-4, " " * 40 + "x"), (-5, "a" * 500), (-6, "ﬁ \x00 <s> 日本\n\n x"), (-7, "".join(chr(rnd.randrange(1, 0x3000)) for _ in range(800))), (-8, "x"), (-8, "x")]
    df = docs(spark, rows).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(0))
    out = sentencepiece_sa.decode(sentencepiece_sa.encode(df, model), model).collect()
    assert len(out) == len(rows)
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == sp.encode(r.text or "")
        assert r.decoded == (r.text or "")
    assert sentencepiece_sa.encode(df.limit(0), model).count() == 0


# ------------------------------------------------------------------ 3 substring dedup
def brute_repeats(rows, w=35):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    count = Counter(tuple(x[i : i + w]) for _, x in split for i in range(len(x) - w + 1))
    out = []
    for d, x in split:
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if count[tuple(x[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        out.append((d, len(x), sum(gone), b" ".join(a for a, g in zip(x, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(spark, sf_dir):
    rnd = random.Random(3)
    rows = [(0, None), (1, ""), (2, "a " * 34), (3, "a " * 35), (4, "a " * 36), (5, "b c " * 40), (6, "x y z " * 30), (6, "x y z " * 30), (None, "q " * 10), (7, "éa\u00a0b " * 40), (8, "w" * 5000)]
    n = 10
    for v in (2, 3, 5, 60):
        words = [f"w{i}" for i in range(v)]
        shared = [[rnd.choice(words) for _ in range(rnd.randint(30, 60))] for _ in range(8)]
        for _ in range(60):
            text = []
            for _ in range(rnd.randint(0, 3)):
                p, a = rnd.choice(shared), rnd.randint(0, 5)
                text += [rnd.choice(words) for _ in range(rnd.randint(0, 20))] + p[a : len(p) - rnd.randint(0, 5)]
            rows.append((n, " ".join(text)))
            n += 1
    for data in (rows, documents(sf_dir)):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(clashing(docs(spark, data))).collect()), key=str)
        assert got == brute_repeats(data)
    assert substring_dedup.remove_repeats(docs(spark, rows).limit(0)).count() == 0
    for window in (20, 300):
        with pytest.raises(ValueError):
            substring_dedup.repeated_spans(docs(spark, rows), window=window)


def test_equal_substrings_parse_alike():
    rnd = random.Random(5)
    for _ in range(200):
        mid = [rnd.randrange(4) for _ in range(60)]
        parsed = []
        for _ in range(2):
            left, right = ([rnd.randrange(4) for _ in range(rnd.randrange(20))] for _ in range(2))
            words = np.array([0x9E3779B97F4A7C15 * (x + 1) % 2**64 for x in left + mid + right], np.uint64)
            names, starts = substring_dedup.parse(words, np.array([0, len(words)]))
            ends = np.append(starts[1:], len(words))
            at = len(left)
            parsed.append({(int(s) - at, int(e) - at, int(x)) for s, e, x in zip(starts, ends, names, strict=True) if s >= at + 7 and e <= at + 60 - 7})
        assert parsed[0] == parsed[1] and parsed[0]


# ------------------------------------------------------------------ 4 packing
def test_packing_covers_every_id_once(spark, sf_dir):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    control = ["hello <|endoftext|> x", "<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|ENDOFTEXT|> <|endoftext", "e<|endoftext|>\u0301 <|end<|endoftext|>oftext|>"]
    rows = [*documents(sf_dir), *[(-10 - i, t) for i, t in enumerate(control)], (-1, None), (-2, ""), (-3, "x y " * 9000), (-4, "don't | x|y İ Σς 日本 é́"), (-5, "a"), (-5, "a"), (None, "b")]
    out = packing.pack(clashing(docs(spark, rows)), path).collect()
    assert len({r.sequence_id for r in out}) == len(out) and {r.offset for r in out} == {0}
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and len(r.ids) == 4 * r.length for r in out)
    texts = dict(rows)
    got = Counter()
    by_doc = {}
    for r in sorted(out, key=lambda r: r.start):
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, pieces in by_doc.items():
        want = np.array(tok.encode(texts[d] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        got[d] = sum(p.length for p in pieces) // (len(want) // 4)
        whole = {(p.start, bytes(p.ids)) for p in pieces}
        assert b"".join(x for _, x in sorted(whole)) == want and all(p.doc_tokens == len(want) // 4 for p in pieces)
    assert got == Counter(d for d, _ in rows)
    assert packing.cut_lengths(4096 * 2 + 5) == [4096, 4096, 4, 1] and packing.pack(docs(spark, rows).limit(0), path).count() == 0
    assert zlib.crc32(b"") == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, rows), path, max_len=1000)


@pytest.mark.parametrize(("name", "control_ids"), [("byte_bpe_50k.json", True), ("byte_bpe_50k.json", False), ("word_bpe_49k.json", False)])
def test_packing_other_vocabulary_and_plain_control_strings(name, control_ids):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file(name))
    tok.encode_special_tokens = not control_ids
    words = packing.WordIds(tokenizer_file(name), control_ids=control_ids)
    texts = ["hello <|endoftext|> x", "  Two  spaces\n\nand more", "", "<|endoftext|>"]
    got = words.ids_of([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_caches_that_overflow():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    words = packing.WordIds(tokenizer_file("word_bpe_49k.json"), limit=8)
    batches = [["one two, three\x0b four \x1c five", " lead", "trail \n", "\u00a0 \u3000x"], ["two one!", "x" * 5000, ""], [f"w{i}or-d{i}" for i in range(40)], ["one two w3or-d3 " * 30], []]
    for texts in batches * 2:
        got = words.ids_of([t.encode() for t in texts])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(words.words.pieces) <= 8 and len(words.runs.pieces) <= 8
    broken = [b"a \xff\xfeb \xe3\x81 c", b"plain"]
    assert [np.frombuffer(g, "<u4").tolist() for g in words.ids_of(broken)] == [tok.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in broken]


# ------------------------------------------------------------------ 5 licences
#: Grants and non-grants that are in no template word for word.
HELD_GRANTS = {
    "Apache": ["Code here is licensed under the Apache License, Version 2.0 since 2019.", "Distributed under the Apache 2.0 license, see LICENSE."],
    "MIT": ["This library is released under the MIT License today.", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", "Everything in this folder is available under MIT."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3 or later.", "// SPDX-License-Identifier: GPL-2.0-or-later", "This tool is distributed under the GNU GPL."],
    "LGPL": ["available under the GNU Lesser General Public License v3", "This library is licensed under the GNU Lesser General Public License."],
    "AGPL": ["The server is licensed under the GNU Affero General Public License, version 3."],
    "BSD": ["Released under the BSD 3-Clause License.", "Source available under the New BSD License, thanks to all."],
    "MPL": ["This file is subject to the terms of the Mozilla Public License, v. 2.0."],
    "EPL": ["Licensed under the Eclipse Public License, Version 2.0"],
    "ISC": ["This project is licensed under the terms of the ISC license."],
    "Zlib": ["Released under the Zlib License."],
    "BSL": ["Distributed under the Boost Software License, Version 1.0."],
    "Unlicense": ["The demo is released under the Unlicense."],
    "CC0": ["Data released under CC0 1.0."],
    "CC": ["Text licensed under CC BY-SA 4.0.", "Pictures are licensed under a Creative Commons Attribution 4.0 International License"],
}
NO_GRANTS = [
    "The foundation granted a license to the public in the spring and published the terms.", "Released under the European Union Public Licence 1.2.", "Licensed under the Mulan PSL v2",
    "Licensed under the Open Software License 3.0", "Licensed under the Q Public License Version 1.0", "Licensed under the IBM Public License", "Released under the FooBar License.",
    "Permission is granted to park here, free of charge, to any person with a copy of the letter.", "He studied at MIT and was later licensed under the state's rules.",
    "Subject to the terms of the lease, the tenant may alter it and use it freely.", "General Public License", "In no event will the club be held liable for any damages.",
]


def test_license_scan_held_out(spark, sf_dir):
    cases = [(f, t) for f, ts in HELD_GRANTS.items() for t in ts] + [(None, t) for t in NO_GRANTS]
    rows = [(i, f"Some words before it and more of them.\n\n{t}\n\nand after") for i, (_, t) in enumerate(cases)]
    rows += [(90, None), (91, ""), (92, "word " * 20000), (93, "Released under the MIT License."), (93, "Released under the MIT License."), (94, "#\n//\n\n---")]
    weights = license_scan.fit(docs(spark, documents(sf_dir)))
    assert (weights == license_scan.fit(docs(spark, documents(sf_dir), 5))).all()  # the same model whatever the partitions
    got = {}
    for r in license_scan.scan(clashing(docs(spark, rows)), weights).collect():
        got.setdefault(r.doc_id, []).append((r.family, r.paragraph, r.n_paragraphs))
    found, true = [f for i in range(len(cases)) for f, *_ in got[i]], [f for f, _ in cases]
    right = sum(f == t and f is not None and len(got[i]) == 1 for i, ((f, *_), t) in enumerate(zip([got[i][0] for i in range(len(cases))], true, strict=True)))
    n_found, n_true = sum(f is not None for f in found), sum(t is not None for t in true)
    assert right / n_found >= 0.95 and right / n_true >= 0.9, [(cases[i], got[i]) for i in range(len(cases)) if got[i][0][0] != cases[i][0]]
    assert got[0] == [("Apache", 1, 3)] and got[90] == got[91] == got[94] == [(None, None, 0)] and got[92] == [(None, None, 1)] and got[93] == [("MIT", 0, 1)] * 2
    assert license_scan.scan(docs(spark, rows).limit(0)).count() == 0 and license_scan.fit(docs(spark, rows).limit(0)).shape == weights.shape


def test_license_probabilities_are_calibrated(spark, sf_dir):
    weights = license_scan.fit(docs(spark, documents(sf_dir)))
    units, classes = license_scan.examples([t.encode()[:200] for _, t in documents(sf_dir) if t][:150], seed=99)
    p = license_scan.probabilities(units, weights)
    sure, right = p.max(axis=1), p.argmax(axis=1) == classes
    bins = np.minimum((sure * 10).astype(int), 9)
    gap = sum(abs(right[bins == b].mean() - sure[bins == b].mean()) * (bins == b).mean() for b in range(10) if (bins == b).any())
    assert gap < 0.1 and right[sure >= license_scan.CUT].mean() > 0.9


def test_license_places_are_all_that_the_comparison_confirms(sf_dir):
    rnd = random.Random(4)
    texts = [t for _, t in license_scan.templates()]
    filler = " ".join(t or "" for _, t in documents(sf_dir)[:60]).split()
    for _ in range(300):
        words = rnd.choice(texts).decode().split()
        kept = [w for w in words if rnd.random() > 0.15]
        text = " ".join(rnd.choices(filler, k=30) + kept + rnd.choices(filler, k=30))
        words = license_scan.Bare([text.encode()])
        covered = any(license_scan.known().share(license_scan._pair_set(words, a, b)).max() >= license_scan.CONFIRM for a, b in license_scan.places(words))
        # brute force: every stretch of the words
        n = len(words.hash)
        brute = any(license_scan.known().share(license_scan._pair_set(words, a, min(n, a + len(kept) + 4))).max() >= license_scan.CONFIRM for a in range(0, n, 2))
        assert covered or not brute, text


def test_license_scan_on_the_documents(spark, sf_dir):
    marks = {"Apache": "Apache License", "GPL": "GNU General", "MIT": "the MIT Lic", "CC": "under CC BY"}
    got = {}
    for r in QUERIES["op5_license_scan"](spark, sf_dir).collect():
        got.setdefault(r.doc_id, set()).update({r.family} - {None})
    assert got == {d: {k for k, v in marks.items() if v in (t or "")} for d, t in documents(sf_dir)}


GPL_HEADER = (
    "# This program is free software: you can redistribute it and/or modify\n"
    "# it under the terms of the GNU General Public License as published by\n"
    "# the Free Software Foundation, either version 3 of the License, or\n"
    "# (at your option) any later version.\n"
)
BSD_HEADER = (
    " * Redistribution and use in source and binary forms, with or without\n"
    " * modification, are permitted provided that the following conditions\n"
    " * are met:\n"
)


def test_license_scan_wrapped_and_inside_long_lines(spark, sf_dir):
    rnd = random.Random(5)
    filler = [w for _, t in documents(sf_dir)[:40] for w in (t or "").split() if not w.startswith(("MIT", "CC", "BY-", "GNU", "Apache"))]
    long = lambda grant: " ".join(rnd.choices(filler, k=2500) + [grant] + rnd.choices(filler, k=2500))
    plain = "You may return a copy of the book to any person, and\nuse it under the terms of the library\nas published by the town."
    many = "\n\n".join(["Plain words here."] * 30 + ["Released under the\nMIT License."])  # far behind the first lines
    rows = [
        (0, "int x;\n\n" + GPL_HEADER + "\nint y;"),
        (1, "/*\n * Copyright (c) 2020\n *\n" + BSD_HEADER + " */"),
        (2, long("Released under the MIT License.")),
        (3, long("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:")),
        (4, GPL_HEADER.replace("# ", "") + "\n" + BSD_HEADER.replace(" * ", "//")),
        (5, plain),
        (6, "x\n\nLicensed under the\r\nApache License,\r\nVersion 2.0.\r\n"),
        (7, "Released under the\n\nMIT License."),
        (8, many),
    ]
    weights = license_scan.fit(docs(spark, documents(sf_dir) + rows[:2]))
    got = {}
    for r in license_scan.scan(docs(spark, rows), weights).collect():
        got.setdefault(r.doc_id, []).append((r.family, r.paragraph, r.line))
    families = {d: [f for f, *_ in x] for d, x in got.items()}
    assert families == {0: ["GPL"], 1: ["BSD"], 2: ["MIT"], 3: ["BSD"], 4: ["GPL", "BSD"], 5: [None], 6: ["Apache"], 7: [None], 8: ["MIT"]}
    assert got[0][0][1:] == (1, 2) and got[1][0][1] == 1 and got[4][1][1] == 1 and got[8][0][1:] == (30, 60)


# ------------------------------------------------------------------ 6 n-gram join
def brute_classes(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 80 * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                o = len(x & y)
                if 100 * o >= 80 * (len(x) + len(y) - o):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("few", [100_000, 300])
def test_ngram_join_equals_brute_force(spark, sf_dir, few, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", few)
    for module in (common, ngram_join):  # with and without salts
        monkeypatch.setattr(module, "PLAIN_ROWS", 0 if few < 1000 else common.PLAIN_ROWS)
    rnd = random.Random(few)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One TWO"), (4, "a b c d e"), (5, "z " * 3000)]
    base, n = [rnd.choice(words) for _ in range(140)], 6
    for _ in range(250):
        x = list(base)
        for _ in range(rnd.randint(0, 4)):
            x[rnd.randrange(len(x))] = rnd.choice(words)
        rows.append((n, " ".join(x)))
        n += 1
    for _ in range(40):
        y = [rnd.choice(words) for _ in range(rnd.randint(1, 60))]
        for _ in range(3):
            z = list(y)
            z[rnd.randrange(len(z))] = rnd.choice(words)
            rows.append((n, " ".join(z)))
            n += 1
    for data in (rows, documents(sf_dir)) if few > 1000 else (rows,):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_classes(clashing(docs(spark, data))).collect()}
        assert got == brute_classes(data)


def test_ngram_join_ends_when_stars_do_not_help(spark, monkeypatch):
    """Unlike texts of shared passages: rounds that contract nothing aren't repeated, and no link is lost."""
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 0)
    rnd, turns = random.Random(3), []
    passages = [" ".join(f"p{i}x{rnd.randrange(10**6)}" for _ in range(100)) for i in range(30)]
    rows = [(d, " ".join(rnd.sample(passages, 10))) for d in range(80)]
    rows += [(100 + d, t + " end") for d, t in rows[:15]]
    joined = ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda *a: (turns.append(1), joined(*a))[1])
    want = brute_classes(rows)
    for pairs in (ngram_join.PAIRS_A_ROW, (0, 0)):
        monkeypatch.setattr(ngram_join, "PAIRS_A_ROW", pairs)
        turns.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_classes(docs(spark, rows)).collect()}
        assert got == want and len(turns) <= 4


def test_ngram_join_edges(spark):
    same = " ".join(f"t{i}" for i in range(30))
    rows = [(5, same), (5, same), (None, same), (7, same + " end"), (None, None)]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.near_classes(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (7, 5), (None, None)], key=str)
    assert ngram_join.near_classes(docs(spark, rows).limit(0)).count() == 0
    kept = ngram_join.keep_representatives(clashing(docs(spark, rows[2:])))
    assert [(r.doc_id, r.text is None) for r in kept.orderBy("doc_id").collect()] == [(None, True), (7, False)] and set(CLASH) < set(kept.columns)
    near = [(1, same), (1, same + " more"), (1, same + " more"), (2, same + " other")]  # an id that repeats; ids that are null
    assert len({r.text for r in ngram_join.keep_representatives(docs(spark, near)).collect()}) == 1
    assert len({r.text for r in ngram_join.keep_representatives(docs(spark, [(None, t) for _, t in near])).collect()}) == 1


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}
    for a, b in edges:
        if a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and parent[a] != parent[b]:
                parent[a] = parent[b] = min(parent[a], parent[b])
                changed = True
    assert got == parent


# ------------------------------------------------------------------ 7 URL filter
def test_url_filter_edges(spark):
    rules = url_filter.rule_table(spark, [("block", "com", "/"), ("allow", "b.com", "/x"), ("block", "b.com", "/x"), ("allow", "a.b.com", "/x/y"), ("block", "", "")])
    urls = ["http://a.b.com/x/y?q", "http://A.B.COM/x/z", "nothing", None, "http://xcom/", "http://c.com", "http://.com/", "http://b.com/xé" + "z" * 5000, "x://b.com/x#/y", "http://b.com?/x"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumns({"rule": F.lit("r"), "host": F.lit("h")})
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()), key=str)
    want = [(0, "a.b.com/x/y", "allow"), (0, "a.b.com/x/y", "allow"), (1, "b.com/x", "block"), (2, "", "block"), (3, "", "block"), (4, None, "allow"), (5, None, "allow"), (6, "com/", "block"), (7, "b.com/x", "block"), (8, "b.com/x", "block"), (9, None, "allow")]
    assert got == sorted(want, key=str)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


# ------------------------------------------------------------------ 8 fingerprints
def canon(text):
    import unicodedata

    for _ in range(2):
        text = unicodedata.normalize("NFC", text).casefold()
    return " ".join(text.split())


def test_fingerprint_case_folding_is_full(spark):
    texts = [f"a{chr(c)}B" for c in range(1, 0x30000) if chr(c).casefold() != chr(c) or chr(c).lower() != chr(c) or chr(c).isspace()]
    texts += ["STRASSE", "straße", "ΣΑΣ σας", "\u03aa\u0301", "\u0390", "J\u030c", "\u01f0", "ﬃ", "İ i\u0307", "ᾳ \u03b1\u0345 ΑΙ", "\u1e9e", "Ꭰ ꭰ", "a\u0345\u0301 x", "\x1c\x1d y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    got = {r.i: r.n for r in rows.select("i", fingerprint.canonical(F.col("t")).alias("n")).collect()}
    assert [(i, t, got[i]) for i, t in enumerate(texts) if got[i] != canon(t)] == []


def test_fingerprints_equal_brute_force(spark, sf_dir):
    rows = documents(sf_dir)
    got = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, sf_dir).collect()}
    prints = {}
    for i, (d, t) in enumerate(rows):
        follow = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(t)
        fold = canon
        assert got[d].near_edited == float(fold(t) == fold(edited)) and got[d].near_next == float(fold(t) == fold(follow))
        assert prints.setdefault(fold(t), got[d].fingerprint) == got[d].fingerprint
    assert len(set(prints.values())) == len(prints)
    groups = {}
    for d, t in rows:
        groups.setdefault(canon(t), []).append(d)
    assert {d: (r.group_id, r.group_size) for d, r in got.items()} == {d: (min(g), len(g)) for g in groups.values() for d in g}


def test_fingerprint_edges(spark, monkeypatch):
    forms = ["É  x", "e\u0301 X ", "é x", " é\u00a0x\n"]
    rows = [(i, t) for i, t in enumerate(forms)] + [(10, None), (11, ""), (12, "  \n"), (13, "ạ\u0302 x"), (14, "q" * 50000), (14, "q" * 50000), (None, "n")]
    out = fingerprint.fingerprint_edits(clashing(docs(spark, rows))).collect()
    assert len(out) == len(rows)
    fp = {r.doc_id: r.fingerprint for r in out}
    assert len({fp[i] for i in range(4)}) == 1 and fp[10] == fp[11] == fp[12] != fp[0] and len(fp[14]) == 48
    groups = {r.doc_id: (r.group_id, r.group_size) for r in fingerprint.exact_groups(docs(spark, rows)).collect()}
    assert groups[3] == (0, 4) and groups[12] == (10, 3)
    (one,) = fingerprint.fingerprint_edits(docs(spark, [(1, "abcd")])).collect()
    assert (one.edited_sha256, one.near_next) == (hashlib.sha256(b"abab").hexdigest(), 1.0)
    monkeypatch.setattr(fingerprint, "wide_digest", lambda c: F.lit("0" * 48))  # every bucket collides
    groups = {r.doc_id: (r.group_id, r.group_size) for r in fingerprint.exact_groups(docs(spark, rows)).collect()}
    assert groups[3] == (0, 4) and groups[12] == (10, 3) and groups[13] == (13, 1)
    monkeypatch.undo()
    assert fingerprint.fingerprint_edits(docs(spark, rows).limit(0)).count() == 0
    rnd = random.Random(1)
    many = [(rnd.randrange(-50, 50) * 7, f"t{i}") for i in range(300)]
    order = sorted(many)
    nexts = sorted((d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order))
    assert sorted((r.doc_id, r.text, r.next_text) for r in fingerprint.with_next(docs(spark, many), buckets=9).collect()) == nexts


def test_fingerprints_normalise_every_script(spark):
    import unicodedata

    rules = [chr(c) for c in range(0x110000) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<")]
    rnd = random.Random(8)
    marks = [chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c)) and unicodedata.unidata_version >= "13"]
    texts = [f"x{unicodedata.normalize('NFD', c)}y" for c in rules] + [f"{c}," for c in rules]
    texts += [unicodedata.normalize("NFD", "".join(chr(rnd.randrange(0xAC00, 0xD7A4)) for _ in range(5))) for _ in range(20)] + ["\uac00\u11a8 \u1161\u1100 \u1100\u1161\u11a7"]
    texts += ["".join(rnd.choice([*"aeoqかは, ", rnd.choice(rules), rnd.choice(marks), rnd.choice(marks), "\u0323", "\u0302", "\u3099"]) for _ in range(12)) for _ in range(1500)]
    texts += ["a\u0302\u0323", "e" + "\u0301\u0323" * 300, "\u212b \u2126", "が", "か\u3099", "plain – text"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    got = {r.i: r.n for r in rows.select("i", fingerprint._composed(F.col("t")).alias("n")).collect()}
    assert [(i, t) for i, t in enumerate(texts) if got[i] != unicodedata.normalize("NFC", t)] == []


# ------------------------------------------------------------------ 9 quality
def test_quality_held_out(spark, sf_dir):
    import os

    d = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else sf_dir
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = QUERIES["op9_quality_classifier"](spark, d).join(labels, "doc_id").collect()
    good, bad = ([r.accepted for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_quality_edges(spark, sf_dir):
    weights = quality.fit(docs(spark, documents(sf_dir)))
    clean = documents(sf_dir)[1][1]
    rows = [(0, None), (1, ""), (2, " \n"), (3, clean), (3, clean), (4, "The word."), (5, "spam!! " * 3000), (6, clean * 50)]
    out = quality.score(clashing(docs(spark, rows)), weights).collect()
    got = Counter((r.doc_id, r.accepted) for r in out)
    assert got[3, True] == 2 and got[0, False] == got[1, False] == got[2, False] == 1 and got[4, True] == 1 and got[5, False] == 1
    assert quality.score(docs(spark, rows).limit(0)).count() == 0
    assert all(r.accepted for r in quality.score(docs(spark, [(1, "The cat sat on the mat and it was good.")])).collect())


def test_quality_rare_junk_is_in_the_sample(spark, sf_dir):
    clean = [t for _, t in documents(sf_dir) if t and (quality.describe([t.encode()])[0] == quality.GOOD).all()][:50]
    junk = ["WIN | CASH ## || NOW!!! $$$ " * 12, "BUY | GOLD ## || TODAY!!! %%% " * 12, "CHEAP | PILLS ## || HERE!!! &&& " * 12]
    rows = [(i, f"{clean[i % len(clean)]} {i}") for i in range(3000)] + [(10000 + i, t) for i, t in enumerate(junk)]
    for sample in (4096, 64):  # the whole table, and a draw that is likely to miss the junk
        weights = quality.fit(docs(spark, rows), sample)
        got = {r.doc_id: r.accepted for r in quality.score(docs(spark, rows), weights).collect()}
        assert not any(got[10000 + i] for i in range(len(junk)))
        assert np.mean([got[i] for i in range(3000)]) > 0.98


def test_quality_classes_weigh_the_same():
    w = quality.train_scorer(np.ones((20001, 1)), np.r_[np.full(20000, 0.99), 0.01])
    assert abs(w.sum()) < 0.1  # nothing tells the classes apart: even odds


def test_em_recovers_vote_rates():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.8
    votes = np.where(rng.random((20000, 7)) < 0.75, np.where(truth[:, None], quality.GOOD, np.where(rng.random((20000, 7)) < 0.6, quality.BAD, quality.GOOD)), quality.NONE)
    patterns, counts = np.unique(quality.pattern_of(votes), return_counts=True)
    post = quality.estimate(patterns, counts)[quality.pattern_of(votes)]
    assert ((post > 0.5) == truth).mean() > 0.95


# ------------------------------------------------------------------ 10 exact dedup
@pytest.mark.parametrize("fan_in", [2, 3, 16])
def test_exact_dedup_edges(spark, fan_in):
    rnd = random.Random(fan_in)
    rows = [(i, rnd.choice(["A b", "a B", "É", "é", "", None, "x" * 9000, f"u{i}"])) for i in range(300)] + [(3, "dup"), (3, "dup"), (None, "dup"), (None, "alone")]
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    best, size = {}, Counter()
    for d, t in rows:
        size[low(t)] += 1
        best[low(t)] = max((x for x in (d, best.get(low(t))) if x is not None), default=None)
    want = sorted(((d, best[low(t)], size[low(t)], d == best[low(t)], hashlib.sha256(low(t).encode()).hexdigest()) for d, t in rows), key=str)
    got = exact_dedup.mark_copies(clashing(docs(spark, rows, 7)), fan_in).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    kept = exact_dedup.keep_one(clashing(docs(spark, rows, 7)), fan_in)
    assert Counter(low(r.text) for r in kept.collect()) == Counter(best.keys()) and set(CLASH) < set(kept.columns)
    assert exact_dedup.mark_copies(docs(spark, rows).limit(0), fan_in).count() == 0


def test_exact_dedup_of_many_batches(spark):
    """a partition of more rows than one Arrow batch holds; batches have columns marked as without nulls, what is held back has not."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        rows = spark.range(300, numPartitions=2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 100).cast("string")).alias("text"))
        got = exact_dedup.mark_copies(rows).collect()
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, 200 + i % 100, 3, i >= 200) for i in range(300)}
        assert sorted(r.doc_id for r in exact_dedup.keep_one(rows).collect()) == list(range(200, 300))
    finally:
        spark.conf.set(name, before)


def test_exact_dedup_merges_over_batches():
    """an entry that ends one batch and begins the next is one entry, wherever the batches are cut; null ids lose."""
    import pyarrow as pa

    rnd = random.Random(8)
    texts = [f"t{rnd.randrange(400)}" for _ in range(1500)]
    rows = sorted((0, int.from_bytes(hashlib.sha256(t.encode()).digest()[:7], "big"), hashlib.sha256(t.encode()).hexdigest(), len(t)) for t in texts)
    rows = [(*r, rnd.choice([None, i]), 1) for i, r in enumerate(rows)]
    names = ["home", "digest", "sha", "n_bytes", "keep_id", "n"]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    shape = pa.schema([pa.field(n, k, n == "keep_id") for n, k in zip(names, kinds, strict=True)])
    want = {}
    for *key, i, n in rows:
        best, seen = want.get(tuple(key), (None, 0))
        want[tuple(key)] = (max((x for x in (best, i) if x is not None), default=None), seen + n)
    for size in (1, 7, 64, 2000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + size], strict=True), kinds, strict=True)], schema=shape) for at in range(0, len(rows), size)]
        out = list(exact_dedup._collapse(batches))
        assert len({b.schema for b in out}) == 1
        assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(*k, *v) for k, v in want.items()]
