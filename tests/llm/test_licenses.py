import textwrap

from casetriage.llm.licenses import KNOWN, scan_licenses

from edge import documents


def scan(spark, texts, known=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as license", "1 as digest", "2 as line", "3 as i")
    return {r.doc_id: (r.license, r.n_lines, r.licenses) for r in scan_licenses(df, known).collect()}


def test_every_known_text_is_found_in_other_dress(spark):
    texts, want = [], []
    for name, known in KNOWN.items():
        for t in known:
            w = t.split(" ")
            texts.append("Copyright (c) 2020 Some Body\n(C) Other\n\n * " + "\r\n  ".join(" ".join(w[i:i + 9]) for i in range(0, len(w), 9)).upper() + "\n")
            want.append(name)
    got = scan(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == want
    assert all(want[i] in got[i][2].split(",") for i in range(len(texts)))


def test_every_known_text_is_found_at_any_width(spark):
    """Wrapped lines may begin with the word copyright, or end within a spelling of two words."""
    texts, want = [], []
    for name, known in KNOWN.items():
        for width in range(40, 121):
            texts.append("\n".join(textwrap.wrap(known[0], width, break_long_words=False, break_on_hyphens=False)))
            want.append(name)
    got = scan(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == want


def test_copyright_lines(spark):
    notice = "Released under the MIT License."
    drop = ["Copyright (c) 2020 Some Body", "copyright 1999, 2003 x", "© Some Body", "(C) Some Body", "(c) 2021 x", " * Copyright: 2020 x", "All rights reserved.", "COPYRIGHT © x"]
    stay = ["copyright notice and this permission notice", "COPYRIGHT HOLDERS BE LIABLE", "(c) You must retain", "all rights reserved by others", "Copyright License."]
    got = scan(spark, [f"{line}\n{notice}" for line in drop + stay])
    assert [got[i][0] for i in range(len(got))] == ["MIT"] * len(drop) + [None] * len(stay)


def test_spelling_across_a_line_end(spark):
    assert scan(spark, ["by the copyright\nowner", "by the copyright holder"], {"X": ["by the copyright holder"]}) == {0: ("X", 0, "X"), 1: ("X", 1, "X")}


def test_spelling_punctuation_and_lines(spark):
    got = scan(spark, ["Text before.\nReleased under the “MIT” Licence!\nText after.", "released under the MIT license and more", "Licensed under CC-BY-NC 4.0",
                       "Released under the MIT License.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0."])
    assert got == {0: (None, 1, "MIT"), 1: (None, 0, ""), 2: ("CC-BY-NC-4.0", 1, "CC-BY-NC-4.0"), 3: (None, 3, "Apache-2.0,MIT")}


def test_own_list(spark):
    assert scan(spark, ["My very own organisation", "x"], {"OWN": ["my very own organization."]}) == {0: ("OWN", 1, "OWN"), 1: (None, 0, "")}


def test_edge_rows_and_empty_table(spark):
    rows = scan_licenses(documents(spark)).collect()
    assert len(rows) == 13 and all((r.license, r.n_lines, r.licenses) == (None, 0, "") for r in rows)
    assert scan_licenses(documents(spark, [])).collect() == []
