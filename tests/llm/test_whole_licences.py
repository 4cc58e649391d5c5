"""Published licence texts, rewrapped, in comments and below any copyright line."""

import textwrap

from changemap.llm import licences


def test_whole_texts_and_copyright_lines(spark):
    assert len(licences.TEXTS) >= 18
    want, rows = {}, []

    def add(name, text):
        want[len(rows)] = name
        rows.append((len(rows), text))

    for name, text in licences.TEXTS.items():
        add(name, text)
        add(name, "".join(f" * {x}\n" for x in text.splitlines()))
        add(None, text + "\nand more")
    for line in ("# Copyright (c) 2020 Some Body", " * Copyright 2020", "Copyright Jo Roe", "// Copyright: Jo", "/* (c) 2020 Jo */", "Copyright Jo\nAll rights reserved.\n", "© Jo"):
        add("MIT", f"MIT License\n\n{line}\n\n{licences.MIT}")
        add("BSD-3-Clause", f"{line}\n{licences.TEXTS['BSD-3-Clause']}")
    # a wrapped line that begins with the word stays in the text
    for width in (40, 50, 61, 72):
        add("BSD-2-Clause", "\n".join(textwrap.fill(x, width) for x in licences.TEXTS["BSD-2-Clause"].split("\n\n")))
    add("Apache-2.0", licences.TEXTS["Apache-2.0"].split("APPENDIX")[0])
    got = {r["doc_id"]: r["text_licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.known(spark)).collect()}
    assert {rows[i][1][:60]: (x, got[i]) for i, x in want.items() if got[i] != x} == {}
