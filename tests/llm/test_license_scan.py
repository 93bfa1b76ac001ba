"""License scans of whole texts and notices."""

from pathlib import Path

from shelfgraph.llm import license_scan


def _scanned(spark, texts):
    return [(r.license, r.n_notices, r.notices) for r in sorted(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)]


def test_license_scan_knows_titles_full_texts_and_wordings(spark):
    short = {n: t for n, t in license_scan.KNOWN[::-1] if n in ("MIT", "ISC", "BSD-3-Clause") and t.count("\n") > 0 and t.startswith(("Perm", "Redis"))}
    titled = [f"{h}\n\nCopyright (c) 2020 Jane Doe\n\n{short[n]}\n" for n, h in (("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("BSD-3-Clause", "BSD 3-Clause License"))]
    assert [x[0] for x in _scanned(spark, titled)] == ["MIT", "MIT", "ISC", "BSD-3-Clause"]
    names = ("Apache-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0")
    full = [(Path(license_scan.__file__).parent / "licenses" / f"{n}.txt").read_text(encoding="utf-8") for n in names]
    assert [x[0] for x in _scanned(spark, full)] == list(names)
    assert [x[0] for x in _scanned(spark, [t + "\nBut not on Sundays." for t in full])] == [None] * 5
    lines = ["Licensed under the MIT License.", "Licensed under the Apache License 2.0", "SPDX-License-Identifier: GPL-3.0-or-later", "This project is licensed under the BSD 3-Clause License.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This text is licensed to thrill."]
    assert [x[2] for x in _scanned(spark, [f"Some text.\n{x}\nMore." for x in lines])] == ["MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "CC-BY-4.0", ""]


def test_license_scan_removes_only_the_copyright_statement(spark):
    mit = dict(license_scan.KNOWN[:1])["MIT"]
    one = " ".join(mit.split())
    wrapped = mit.replace("COPYRIGHT HOLDERS BE", "\nCOPYRIGHT HOLDERS BE").replace("The above copyright", "The above\ncopyright")
    heads = ["Copyright (c) Jane Doe", "Copyright Jane Doe 2020", "Copyright The Foo Authors", "Copyright (c) 2020 Foo, Inc. and contributors", "© 2019 Foo\nAll rights reserved."]
    texts = [*(f"{h}\n\n{mit}" for h in heads), f"Copyright (c) 2020 Jane Doe {one}", f"MIT License Copyright (c) 2020 Jane Doe. All rights reserved. {one}", wrapped]
    assert [x[0] for x in _scanned(spark, texts)] == ["MIT"] * len(texts)
    both = ["Copyright 2020 Foo. Licensed under the Apache License, Version 2.0.", "# Copyright (c) 2020 Foo, Inc. Released under the MIT License."]
    assert [x[2] for x in _scanned(spark, [f"Some text.\n{x}\nMore." for x in both])] == ["Apache-2.0", "MIT"]
    assert [x[0] for x in _scanned(spark, [f"Copyright 2020 Foo. You may copy it on Sundays.\n{mit}", f"(c) You must retain this.\n{mit}", f"Copyright law applies in 2020.\n{mit}"])] == [None] * 3
