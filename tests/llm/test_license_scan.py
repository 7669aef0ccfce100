"""op4: cosines against a dense computation, passages, inheritance against a walk up the path."""

import math
import random
from collections import Counter

import numpy as np

from quillon.llm import license_scan as ls


def test_cosine():
    files = ["Released under the MIT License.", "alpha beta", "the license", ""]
    frequency = Counter(t for f in files for t in set(ls.terms(f)) & set(ls.VOCABULARY))
    m = ls.Matcher(len(files), frequency)
    idf = lambda t: math.log(5 / (1 + frequency.get(t, 0))) + 1
    for passage in (*files, "released UNDER mit, gamma", "Licensed under CC BY-NC 4.0. extra words here"):
        found = 0.0
        for _, template in ls._VECTORS:
            a, b = Counter(ls.terms(passage)), template
            terms = sorted(set(a) | set(b))
            x, y = (np.array([c[t] * idf(t) for t in terms]) for c in (a, b))
            found = max(found, float(x @ y / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-300)))
        assert abs(m.best(passage)[0] - found) < 1e-9


def test_each_template_finds_itself():
    m = ls.Matcher(10, {})
    for name, group in ls.TEMPLATES.items():
        for t in group:
            assert m.file("Some words.\n" + t + "\nMore words.", False)[1] == name
            assert m.file("\n".join("# " + x for x in t.split("; ")), False)[1] == name
            assert m.file(t.replace(" ", "\n"), True)[1] == name
    assert m.file("A text about a driving licence.\nnothing else", False)[0] < ls.THRESHOLD


def walk(files):
    """(id, license, origin) by walking up the directories."""
    m = ls.Matcher(len(files), Counter(t for _, _, x in files for t in set(ls.terms(x or "")) & set(ls.VOCABULARY)))
    import re

    own, granted = [], {}
    for i, path, text in files:
        whole = path is not None and re.search(ls.LICENSE_FILE, path) is not None
        s, n = m.file(text or "", whole)
        own.append(n if s >= ls.THRESHOLD else None)
        if whole and s >= ls.THRESHOLD:
            where = path.rsplit("/", 1)[0] if "/" in path else ""
            granted[where] = min(granted.get(where, (1, "")), (-s, n))
    out = []
    for (i, path, _), license_ in zip(files, own):
        origin = "own" if license_ else "none"
        if license_ is None and path is not None:
            at = path.rsplit("/", 1)[0] if "/" in path else ""
            while True:
                if at in granted:
                    license_, origin = granted[at][1], "inherited"
                    break
                if not at:
                    break
                at = at.rsplit("/", 1)[0] if "/" in at else ""
        out.append((i, license_, origin))
    return sorted(out, key=str)


def test_inheritance(spark):
    r = random.Random(8)
    templates = [t for group in ls.TEMPLATES.values() for t in group]
    files = []
    for i in range(300):
        parts = [r.choice("abc") for _ in range(r.randint(0, 4))]
        name = r.choice(("LICENSE", "x.txt", "y.py", "COPYING.md", "z")) if i % 3 == 0 else f"f{i}.txt"
        text = r.choice(("plain words here", "", None, "head\n" + r.choice(templates))) if name[0] != "L" else r.choice(templates)
        files.append((i, "/".join([*parts, name]), text))
    files += [(900, None, "x"), (901, None, templates[0]), (902, "a/q", "word " * 20_000), files[0], (None, "b/q", "x")]
    frame = spark.createDataFrame(files, "doc_id long, path string, text string").selectExpr("*", "'x' as own", "1 as granted", "2 as dir")
    got = sorted(((r.id, r.license, r.origin) for r in ls.scan(spark, frame).collect()), key=str)
    assert got == walk(files) and len({g[2] for g in got}) == 3
    assert ls.scan(spark, frame.limit(0)).count() == 0


def test_common_words_around_a_notice(spark):
    """Frequencies are those of all words, so common ones around a notice weigh little."""
    notices = {"MIT": "Released under the MIT License.", "GPL-3.0": ls.TEMPLATES["GPL-3.0"][0], "CC-BY-NC-4.0": ls.TEMPLATES["CC-BY-NC-4.0"][0]}
    files = [(i, f"d/{i}.txt", f"en und plain words number{i}") for i in range(300)]
    files += [(1000 + i, f"d/{name}.txt", f"first\nen und {notice}\nlast") for i, (name, notice) in enumerate(notices.items())]
    files += [(2000, "d/rare.txt", "quaint zebra unlike others under license"), (2001, "d/x.txt", "released en license " + "und " * 50)]
    got = {r.id: r for r in ls.scan(spark, spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    frequency = Counter(t for _, _, x in files for t in set(ls.terms(x)))
    m = ls.Matcher(len(files), frequency)
    for i, path, text in files:
        s, name = m.file(text, False)
        assert got[i].license == (name if s >= ls.THRESHOLD else None)
        assert got[i].similarity is None if s < ls.THRESHOLD else abs(got[i].similarity - s) < 1e-9
    assert [got[1000 + i].license for i in range(3)] == list(notices) and got[1000].similarity > 0.9


def wrapped(text, width=68):
    lines, line = [], ""
    for w in text.split(" "):
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return [*lines, line]


def test_files_as_they_stand_in_projects():
    """Whole licence files, wrapped headers in every comment style, and notices inside long licences."""
    m = ls.Matcher(1000, {"the": 900, "of": 800, "and": 850, "to": 800, "in": 700, "copyright": 30, "software": 40})
    mit = ls._MIT + ls._MIT_REST
    file = "MIT License\n\nCopyright (c) 2021 Some Person\n\n" + "\n".join(wrapped(ls._MIT)) + "\n\n" + "\n".join(wrapped(ls._MIT_REST.strip())) + "\n"
    assert m.file(file, True)[1] == "MIT" and m.file(file, True)[0] >= 0.8 and m.file(file, False)[0] >= 0.8
    for name, text in (("BSD-2-Clause", ls._CONDITIONS + ls._WARRANTY), ("BSD-3-Clause", ls._CONDITIONS + ls._THIRD + ls._WARRANTY), ("ISC", ls._ISC + ls._ISC_REST), ("MIT", mit)):
        s, found = m.file("Copyright (c) 2020, The Authors\nAll rights reserved.\n\n" + "\n".join(wrapped(text)), True)
        assert found == name and s >= 0.8, (name, found, s)
    for name in ("GPL-3.0", "LGPL-3.0", "AGPL-3.0", "GPL-2.0", "Apache-2.0", "MPL-2.0"):
        notice = wrapped(ls.TEMPLATES[name][-1])
        for header in ("/*\n" + "\n".join(notice) + "\n*/\nint x;", "/*\n * " + "\n * ".join(notice) + "\n */\nint x;", "# " + "\n# ".join(notice) + "\nx = 1", "<!--\n" + "\n".join(notice) + "\n-->\n<p>", "word\n\n" + "\n".join(notice) + "\n\nother words"):
            s, found = m.file(header, False)
            assert found == name and s >= 0.8, (name, header, found, s)
        long = "\n\n".join(f"{i}. " + "\n".join(wrapped("Some long terms of a long licence that speak of a covered work and of its conveying " * 3)) for i in range(40))
        assert m.file(long + "\n\nHow to apply\n\n" + "\n".join(notice) + "\n\nend", True)[1] == name


def test_very_long_headers_take_linear_time():
    import time

    start = time.time()
    for text in ("/*" * 400_000, "# licence\n" * 60_000, "licence " * 100_000, "<!--" * 200_000, "\n\n".join(["the licence\nof it"] * 40_000)):
        list(ls.passages(text, True))
    assert time.time() - start < 20


def test_paths_with_nulls(spark):
    rows = [(None, None, None), (1, None, "s"), (60, "en", None), (0, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string")
    got = [r[0] for r in docs.select(ls.path_of_document()).collect()]
    assert got == ["-/-/-/-.txt", "s/-/1/1.txt", "-/LICENSE", "s/LICENSE"]
