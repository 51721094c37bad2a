"""Known licence texts in any layout, spelling and case, and rows with odd ids."""

import re
import textwrap

import pytest

from corvid.llm import licences

BRITISH = (("license", "licence"), ("acknowledgment", "acknowledgement"), ("authoriz", "authoris"), ("recogniz", "recognis"), ("organiz", "organis"), ("noncommercial", "non-commercial"), ("noninfringement", "non-infringement"))
WHOLE = licences.texts()


def _wrapped(text, width):
    """Each paragraph anew, but for those that hold a copyright statement, which is a line of its own."""
    parts = re.split(r"\n[ \t]*\n", text)
    return "\n\n".join(p if re.search(licences.STATEMENT, p.lower()) else textwrap.fill(" ".join(p.split()), width) for p in parts)


def _british(text):
    for a, b in BRITISH:
        text = re.sub(a, lambda m, b=b: b.upper() if m[0].isupper() else b, text, flags=re.I)
    return text


def test_every_text_in_every_layout(spark):
    rows = []
    for name, text in WHOLE:
        for width in (40, 66, 72, 79, 100):
            rows.append((name, _wrapped(text, width)))
        rows += [(name, text), (name, text.upper()), (name, _british(text)), (name, text.replace("\n", "\r\n"))]
        rows += [(name, f"Copyright (c) 2020 A. Person\nAll rights reserved.\n\n{text}"), (name, f"© 2019-2021 Some Company, Inc.\n{_british(_wrapped(text, 70))}")]
    for name, text in licences.notices():
        rows.append((name, text))
        rows.append((name, f"  * {_british(text)}."))
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, name string, text string")
    got = {r.doc_id: r.licence for r in licences.scanned(docs).collect()}
    assert [(i, name, got[i], text[:80]) for i, (name, text) in enumerate(rows) if got[i] != name] == []
    assert {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "Unlicense", "Zlib", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0"} == {n for n, _ in WHOLE}


def test_every_known_text_has_a_hint():
    assert all(any(h in t.lower() for h in licences.HINTS) for _, t in licences.KNOWN)


def test_rows_are_told_by_their_own_text(spark):
    note = "intro\nLicensed under CC BY 4.0.\nmore"
    rows = [(None, note), (None, "plain text"), (7, note), (7, "other text"), (7, note), (8, None), (9, ""), (10, "x " * 200_000 + "\nReleased under the MIT Licence"), (11, "MIT License and GNU GPL are not notices")]
    docs = spark.createDataFrame([(i, t, "n", "l", "d", "k") for i, t in rows], "doc_id long, text string, notices string, licence string, digest string, known string")
    got = sorted((str(r.doc_id), r.notices, r.licence) for r in licences.scanned(docs).collect())
    want = [(None, "CC-BY-4.0"), (None, ""), (7, "CC-BY-4.0"), (7, ""), (7, "CC-BY-4.0"), (8, ""), (9, ""), (10, "MIT"), (11, "")]
    assert got == sorted((str(i), n, None) for i, n in want)


@pytest.mark.parametrize("text", ["", "Copyright (c) 2020 A. Person", "all rights reserved"])
def test_what_is_no_licence(spark, text):
    assert licences.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licence is None


def test_native_plan(spark, sf):
    plan = licences.op10_licence_scan(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
