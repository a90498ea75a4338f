import math
from collections import Counter

from lodequarry.llm import licenses


def brute(texts, unit):
    vocabulary = {t for _, x in licenses.TEMPLATES for t in licenses.terms_of(x)}
    df = Counter(t for x in texts for t in set(licenses.terms_of(x or "")) & vocabulary)
    weigh = lambda t: math.log((1 + len(texts)) / (1 + df.get(t, 0))) + 1
    vec = lambda x: {t: c * weigh(t) for t, c in Counter(licenses.terms_of(x)).items()}
    a, best = vec(unit), (0.0, "")
    for name, x in licenses.TEMPLATES:
        b = vec(x)
        dot = sum(v * b.get(t, 0) for t, v in a.items())
        best = max(best, (dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), name))
    return best


def test_notices_files_and_inheritance(spark):
    rows = [
        ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        ("a/b/c/x.py", "plain text without any notice"), ("a/b/own.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("z/y.py", "nothing"), ("a/b/LICENSE.md", "some words about a licence of no kind at all"),
        ("top.py", None), (None, "All rights reserved."), (None, "none"), ("a/n.py", ""), ("q/COPYING", "GNU General Public License Version 3, 29 June 2007"), ("q/w/e.c", "x " * 50_000 + "\nlong"), ("q/w/e.c", "twice"),
    ]
    df = spark.createDataFrame([(p, t, "clash") for p, t in rows], "path string, text string, license string")
    got = {(r["path"], r["text"]): r for r in licenses.scan(df).collect()}
    assert len(got) == len(rows)
    say = lambda k: tuple(got[rows[k]][c] for c in ("license", "license_basis", "license_from"))
    assert say(0) == ("MIT", "file", None) and say(1) == ("MIT", "inherited", "a") and say(2) == ("Apache-2.0", "notice", None)
    assert say(3) == say(5) == say(7) == (None, None, None) and say(6) == ("proprietary", "notice", None) and say(8) == ("MIT", "inherited", "a")
    assert say(9) == ("GPL-3.0", "file", None) and say(10) == say(11) == ("GPL-3.0", "inherited", "q")
    score, name = brute([t for _, t in rows], "# Licensed under the Apache License, Version 2.0.")
    assert name == "Apache-2.0" and abs(got[rows[2]]["license_score"] - score) < 1e-9
    assert licenses.scan(df.limit(0)).count() == 0


def test_headers_over_lines_within_lines_and_by_identifier(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    rows = [
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("# SPDX-License-Identifier: Zlib", "Zlib"), ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0-only WITH Linux-syscall-note"),
        ("// Licensed under the Apache\n// License, Version 2.0 by the makers of this fine program", "Apache-2.0"), ("lorem ipsum " * 80 + "this is released under the MIT License and so on " + "dolor sit " * 80, "MIT"),
        ("Copyright (c) 2020 Some Body. All rights reserved.\n\n" + mit, "MIT"), ("Copyright (c) 2020 Some Body Ltd. All rights reserved.", "proprietary"),
        ("This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.", "GPL-3.0"),
        ("a driving licence is needed to drive a car on the road", None), ("the copyright of a song lasts long", None),
    ]
    df = spark.createDataFrame([(k, f"d/{k}.c", t) for k, (t, _) in enumerate(rows)], "id long, path string, text string")
    got = {r["id"]: r["license"] for r in licenses.scan(df).collect()}
    assert got == {k: name for k, (_, name) in enumerate(rows)}


def test_a_long_line_of_different_words_is_linear(spark):
    line = "Permission is hereby granted " + " ".join(f"w{k}" for k in range(100_000)) + " this is released under the MIT License"
    df = spark.createDataFrame([("a/x.js", line)] * 3, "path string, text string")
    assert [r["license"] for r in licenses.scan(df).collect()] == ["MIT"] * 3


def test_whole_licence_texts_are_known(spark):
    whole = [t for t in licenses.TEMPLATES if len(t[1]) > 600]
    df = spark.createDataFrame([(k, f"{k}/COPYING", "Copyright (c) 2021 Ann Other\n\n" + x.replace(". ", ".\n * ")) for k, (_, x) in enumerate(whole)] + [(100 + k, f"{k}/src/a.c", "int x;") for k in range(len(whole))], "id long, path string, text string")
    got = {r["id"]: r for r in licenses.scan(df).collect()}
    for k, (name, _) in enumerate(whole):
        assert (got[k]["license"], got[k]["license_basis"]) == (name, "file") and (got[100 + k]["license"], got[100 + k]["license_basis"], got[100 + k]["license_from"]) == (name, "inherited", str(k))
