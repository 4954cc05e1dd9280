"""The standard licence texts and notices, unmodified."""

import pytest

from koine.llm import license_scan

MIT = """MIT License

Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer{2}

{1} Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution{2}
"""
ENDORSE = """
* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.
"""
NOTICE = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {0} as published by
the Free Software Foundation, {1} of the License, or
(at your option) any later version."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
TEXTS = [
    (MIT, "MIT", "<mit_grant><mit_notice><warranty_as_is>"),
    (BSD.format("*", "*", "."), "BSD-2-Clause", "<bsd_grant><bsd_source><bsd_binary>"),
    (BSD.format("1.", "2.", "."), "BSD-2-Clause", "<bsd_grant><bsd_source><bsd_binary>"),
    (BSD.format("-", "-", ";") + ENDORSE, "BSD-3-Clause", "<bsd_grant><bsd_source><bsd_binary><bsd_endorse>"),
    (APACHE, "Apache-2.0", "<apache2_grant><apache2_comply><apache2_copy>"),
    (NOTICE.format("Lesser General Public License", "either version 2.1"), "LGPL-2.1", "<lgpl21_ref>"),
    (NOTICE.format("Lesser General Public License", "either version 3"), "LGPL-3.0", "<lgpl3_ref>"),
    (NOTICE.format("Affero General Public License", "either version 3"), "AGPL-3.0", "<agpl3_ref>"),
    (NOTICE.format("General Public License", "either version 2"), "GPL-2.0", "<gpl_redistribute><gpl2_ref>"),
    (NOTICE.format("General Public License", "version 3"), "GPL-3.0", "<gpl_redistribute><gpl3_ref>"),
    (MPL, "MPL-2.0", "<mpl2_ref>"),
    ("Released into the public\n  domain. Available under CC\nBY-SA 4.0.", "CC-BY-SA,Public-Domain", "<public_domain><cc_by_sa>"),
    ("Dual: licensed under the Apache License, Version 2.0; parts released under the MIT License", "Apache-2.0,MIT", "<apache2_grant><mit_ref>"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)], "doc_id long, text string")).collect()
    return {r["doc_id"]: (r["licences"], r["sentence_ids"], r["n_sentences"]) for r in rows}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_standard_texts(found, i):
    _, name, ids = TEXTS[i]
    assert found[i] == (name, ids, ids.count("<"))
