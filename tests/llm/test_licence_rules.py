"""Identifiers that a rule passes over stay, sentences are looked up whole, further licences."""

import pytest

from koine.llm import license_scan

CASES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of it. Licensed under the Apache License, Version 2.0. The above copyright notice and this permission notice shall be included.", "MIT,Apache-2.0"),
    ("It is placed in the public\ndomain.", "Public-Domain"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any means.", "Unlicense"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "0BSD"),
    ("SPDX-License-Identifier: GPL-1.0-only\n# SPDX-License-Identifier: EPL-2.0 \n// SPDX-License-Identifier: MIT-0", "EPL-2.0,GPL-1.0,MIT-0"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.", "EPL-1.0"),
    ("The contents of this file are subject to the terms of the Common Development and Distribution License (the License).", "CDDL-1.0"),
    ("This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 3. This notice may not be removed or altered from any source distribution.", "Zlib"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("This library is released under the Artistic License 2.0.", "Artistic-2.0"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or any later", ""),
    ("Licensed under CC BY-ND 4.0. Also available under the 3-clause BSD license.", "CC-BY-ND,BSD-3-Clause"),
]


def test_cases(spark):
    got = {r["doc_id"]: r["licences"] for r in license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(CASES))] == [n for _, n in CASES]


@pytest.mark.parametrize("tables", [license_scan.WHOLE.values(), [i for i, _ in license_scan.phrases()]])
def test_every_identifier_has_a_rule(tables):
    used = {i for _, ids in license_scan.rules() for i in ids}
    assert set(tables) <= used


def test_every_standard_sentence_passes_the_filter(spark):
    rows = [(k, s) for k, s in enumerate(license_scan.WHOLE)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("n_sentences = 1").count()
    assert got == len(rows)
