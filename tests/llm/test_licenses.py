import re
from collections import Counter, defaultdict
from math import log, sqrt
from pathlib import Path

import pytest

from plinth.llm.licenses import LICENSE_FILE, PARAGRAPH, TEMPLATES, THRESHOLD, TOKEN, Weights, anchors, needed, scan


def listed(text):
    return re.findall(TOKEN, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def tokens(text):
    return Counter(listed(text))


def brute(rows):
    seen = Counter(t for *_, text in rows for t in set(tokens(text or "")))
    idf = lambda t: log((1 + len(rows)) / (1 + seen[t])) + 1
    unit = lambda c: {t: n * idf(t) / sqrt(sum((m * idf(s)) ** 2 for s, m in c.items())) for t, n in c.items()}
    sides = [(name, unit(tokens(body))) for name, body in TEMPLATES]
    own, known = {}, anchors(TEMPLATES)
    for i, path, text in rows:
        parts = [listed(x) for x in {*(text or "").split("\n"), *(p for p in re.split(PARAGRAPH, text or "") if "\n" in p)}]
        units = {tuple(x) for x in parts if x}
        words = listed(text or "")
        at = {}
        for k, w in enumerate(words):
            at.setdefault(w, []).append(k)
        units |= {tuple(words[max(k - place, 0) :][:size]) for t, place, size in known for k in at.get(t, ())}
        for part in units:
            u = unit(Counter(part))
            for name, side in sides:
                s = round(sum(w * side.get(t, 0) for t, w in u.items()), 6)
                if s >= THRESHOLD:
                    own[i, path] = min(own.get((i, path), (0, "")), (-s, name))
    holders = defaultdict(list)
    for (i, path), (minus, name) in own.items():
        if path is not None and re.search(LICENSE_FILE, path.rpartition("/")[2]):
            holders[path.rpartition("/")[0]].append((minus, path, name))
    out = []
    for i, path, _ in rows:
        got, near = own.get((i, path)), None
        if path is not None:
            up = path.rpartition("/")[0]
            while True:
                if up in holders:
                    near = min(holders[up])
                    break
                if not up:
                    break
                up = up.rpartition("/")[0]
        if got:
            out.append((i, path, got[1], -got[0], got[1], "own", None))
        elif near:
            out.append((i, path, None, None, near[2], "inherited", near[1]))
        else:
            out.append((i, path, None, None, None, None, None))
    return out


MIT, APACHE, GPL = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."


def cases():
    rows = [
        (1, "/a/LICENSE", f"{MIT}\nrest"), (2, "/a/b/c/x.txt", "no notice"), (3, "/a/b/COPYING.md", GPL), (4, "/a/b/c/y.txt", f"text\n# {APACHE.upper()}"),
        (5, "/q/x", None), (6, "/q/y", ""), (7, None, MIT), (8, None, "plain"), (None, "/a/z", "plain"), (9, "/a/b/licence", "the licence was lost"),
        (10, "top.txt", "plain"), (11, "LICENSE", APACHE), (12, "/LICENSE", MIT), (13, "/", "x"), (14, "/ab/x", "plain"), (15, "/a/LICENSE.txt", MIT),
        (16, "/w/x.py", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License\n\ncode"),
        (17, "/w/y.py", "word " * 100_000 + MIT), (18, "/w/v.py", "see licensed things, version 2.0 and MIT\nApache\n2.0"), (19, "/w/u", "Licensed under CC BY 4.0.5 now"), (21, "/w/o", "1.0licensed under CC BY 4.0x"), (22, "/w/p", "0.1mit licensed 2.0under"),
        (20, "/w/u2", "xlicensed under cc by-nc 4.0."),
    ]
    return rows + [(2, "/a/b/c/x.txt", "no notice"), (2, "/a/b/c/x.txt", APACHE)] + [(100 + i, f"/hot/{i % 3}/f{i}", MIT if i % 2 else "none") for i in range(200)]


def test_against_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    got = scan(df)
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows))
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_bound_is_exact():
    # What a unit shares with a template bounds its cosine, whatever else it holds.
    weights = Weights(TEMPLATES, 1000, {"the": 900, "license": 50})
    for vector in weights.vectors:
        assert abs(sum(w * w for w in vector.values()) - 1) < 1e-9


def test_notice_within_prose_and_licence_file(spark):
    prose = " ".join(f"rare{i} word{i * 7}" for i in range(200))
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n" + prose
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n" + prose
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + next(b for n, b in TEMPLATES if n == "MIT" and len(b) > 400).replace(" OF ", "\nOF ")
    rows = [(1, "/a/LICENSE", apache), (2, "/a/x", "plain"), (3, "/b/LICENSE", gpl), (4, "/c/LICENSE", mit), (5, "/d", f"{prose} Released under the MIT License. The quick brown fox {prose}")]
    rows += [(10 + i, f"/z/{i}", f"{i} {prose}") for i in range(20)]
    got = {r.doc_id: (r.license, r.origin) for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(1, 6)] == [("Apache-2.0", "own"), ("Apache-2.0", "inherited"), ("GPL-3.0", "own"), ("MIT", "own"), ("MIT", "own")]
    assert got[11] == (None, None)


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence texts on this machine")
def test_canonical_texts(spark):
    names = {"GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}
    rows = [(i, f"/{n}/LICENSE", Path(f"/usr/share/common-licenses/{n}").read_text()) for i, n in enumerate(names)]
    rows += [(100 + i, f"/x/{i}", f"plain text {i}") for i in range(30)]
    got = {r.doc_id: r.own_license for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {n: got[i] for i, n in enumerate(names)} == names


def test_each_template_finds_itself(spark):
    df = spark.createDataFrame([(i, f"/{i}", f"// {body}") for i, (_, body) in enumerate(TEMPLATES)], "doc_id long, path string, text string")
    assert {r.doc_id: r.own_license for r in scan(df).collect()} == dict(enumerate(n for n, _ in TEMPLATES))


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    assert [tuple(r) for r in scan(df).collect()] == [(None,) * 7] * len(rows)


def test_units_without_anchors_and_long_ones(spark):
    known = {t for t, *_ in anchors(TEMPLATES)}
    rows = [(100 + i, f"/n/{i}", " ".join(t for t in listed(body) if t not in known)) for i, (_, body) in enumerate(TEMPLATES)]
    rows += [(1, "/a", " ".join([TEMPLATES[4][1]] * 40)), (2, "/b", " ".join([TEMPLATES[4][1]] * 40 + [f"word{i}" for i in range(9000)])), (3, "/c", "\n".join([f"{TEMPLATES[17][1]} x{i}" for i in range(300)]))]
    rows += [(i, f"/w/{i}", f"plain words {i}") for i in range(200, 900)]
    got = sorted(map(tuple, scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()))
    assert got == sorted(brute(rows)) and sum(r[0] >= 100 and r[2] is not None and r[0] < 200 for r in got) > 5 and {r[0] for r in got if r[2] and r[0] < 4} == {1, 2, 3}


def test_needed_tokens_prove_the_rest():
    weights = Weights(TEMPLATES, 1000, {t: 3 for _, body in TEMPLATES for t in listed(body)})
    names = set(needed(weights.vectors, {t: 3 for v in weights.vectors for t in v}, THRESHOLD))
    for vector in weights.vectors:
        assert sqrt(sum(w * w for t, w in vector.items() if t not in names)) < THRESHOLD
    assert needed(weights.vectors, {}, THRESHOLD) == []


def test_one_long_text_of_notices(spark):
    import time

    text = "\n".join(f"{TEMPLATES[i % len(TEMPLATES)][1]} {i}" for i in range(5200))
    assert len(text) > 1_000_000
    begin = time.perf_counter()
    got = scan(spark.createDataFrame([(1, "/a", text)], "doc_id long, path string, text string")).collect()
    assert got[0].own_license and time.perf_counter() - begin < 60
