"""BPE and license scans against plain versions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from restitch.llm import bpe, licenses
from tests.llm.test_core import clashing, frame, odd_texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_perfect_hash_is_minimal(codec):
    assert None not in codec.hash.keys and len(codec.hash.keys) == len(codec.ranks)
    assert all(codec.hash.get(k) == v for k, v in codec.ranks.items())
    assert codec.hash.get(b"qqzzqqzz") is None and codec.hash.get(b"") is None
    assert bpe.PerfectHash({b"one": 7}).get(b"one") == 7


def test_encode_like_the_library(codec, library):
    rng = random.Random(0)
    texts = [t or "" for t in odd_texts()] + ["a<|endoftext|>b", "a" * 20_000, " " * 5000 + "x", "\x1c\x1d\x85\xa0  ᠎", "don't WE'LL 123abc"]
    pool = [chr(c) for c in [*range(1, 0x300), *range(0x400, 0x460), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F620), 0x0301, 0x200D, 0x2028, 0x3000]]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(400))) for _ in range(300)]
    texts += ["".join(rng.choice("abc  '\n1$é") for _ in range(rng.randrange(400))) for _ in range(300)]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_every_code_point_is_split_like_the_library(codec, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        for form in ("{?'d", " ?1", "a? ?"):
            text = "\n".join(form.replace("?", chr(c)) for c in points[at : at + 4096])
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice([chr(rng.choice(points)), " ", "'s", "ab", "\n", "\u0558", "12"]) for _ in range(rng.randrange(80)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_encode_with_a_small_cache(library, monkeypatch):
    own = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "CACHE", 10)
    for i in range(50):
        t = f"wort{i} wurt{i % 7}xy zzyx{i * i}"
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def test_encode_documents(spark, library):
    rows = list(enumerate(odd_texts()))
    df = frame(spark, rows)
    got = {r.doc_id: r for r in bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN, keep_ids=True)
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert bpe.encode_documents(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    digests = bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN)
    assert bpe.encode_documents(clashing(df), RANKS, public_tokenizers.PATTERN).exceptAll(digests).count() == 0


MIT = """
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in
# all copies or substantial portions of the Software.
"""


def test_licenses(spark):
    texts = [
        "Some words\nLicensed under CC BY-NC 4.0.\nmore", "x. Released under the MIT License. y", MIT, "This work is licensed under the GNU General Public License, version 3.",
        "// SPDX-License-Identifier: Apache-2.0", "licensed under nothing. Warranty!", None, "", "All rights reserved.\nReleased under the MIT License.",
        MIT.split("# The above")[1] + MIT.split("# The above")[0],
    ]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i].license for i in range(len(texts))] == ["CC-BY-NC-4.0", "MIT", "MIT", "GPL-3.0", "Apache-2.0", None, None, None, "MIT", None]
    assert got[2].sentence_ids == "mit_grant,mit_notice" and got[0].sentence_ids == "ref:CC-BY-NC-4.0" and got[8].licenses == "MIT,All-Rights-Reserved" and got[6].n_sentences == 0
    assert licenses.scan(frame(spark, [])).count() == 0


def test_every_rule_needs_a_stem():
    for name, own in licenses.RULES:
        stemmed = [i for i in own if all(any(s in sentence for s in licenses.STEMS) for sentence, j in licenses.known().items() if i == j)]
        assert stemmed, name


def test_references_and_tags(spark):
    said = {
        "This project is licensed under the MIT License - see the [LICENSE](LICENSE) file.": "MIT", "The code is licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later", "# SPDX-License-Identifier: GPL-2.0-only\nimport os": "GPL-2.0-only", "SPDX-License-Identifier: GPL-3.0+": "GPL-3.0-or-later",
        "// SPDX-License-Identifier: (MIT OR Apache-2.0)": "Apache-2.0,MIT", "License: MIT": "MIT", '"license": "BSD-3-Clause",': "BSD-3-Clause", "license: see below": None,
        "Released under the GNU General Public License v3 or later.": "GPL-3.0-or-later", "licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
        "Dual licensed under the MIT license and the Apache License 2.0": "Apache-2.0,MIT", "It is distributed\nunder the terms of the GNU AGPLv3.": "AGPL-3.0", "Released under the new BSD license!": "BSD-3-Clause",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0", "licensed under CC BY-SA 3.0": "CC-BY-SA-3.0",
        "Er fuhr mit Lizenz. Licensed drivers are under stress.": None, "Apache License\n   Version 2.0, January 2004\n": "Apache-2.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "LGPL-3.0",
        "The MIT License (MIT)\n\nCopyright": "MIT", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "GPL-2.0-only",
    }
    got = {r.doc_id: r.licenses or None for r in licenses.scan(frame(spark, list(enumerate(said)))).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())


def test_very_long_texts_and_other_columns(spark):
    long = "word. " * 200_000
    df = frame(spark, [(1, long + MIT + long), (1, long), (None, "License: ISC")]).selectExpr("*", "'x' as low", "1 as ids", "2 as `a.b`", "'y' as license")
    got = sorted(((r.doc_id, r.license) for r in licenses.scan(df).collect()), key=repr)
    assert got == [(1, "MIT"), (1, None), (None, "ISC")]


def test_license_plan_has_no_python(spark, sf_dir):
    plan = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "MIT": MIT.replace("# ", "").replace("#", ""),
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "Unlicense": """This is free and unencumbered software released into the public
domain.
""",
}
HEADERS["BSD-2-Clause"] = HEADERS["BSD-3-Clause"].split("3. Neither")[0]
HEADERS["LGPL-3.0-or-later"], HEADERS["LGPL-2.1-or-later"] = (
    HEADERS[g].replace("GNU General", "GNU Lesser General").replace("This program", "This library").replace("version 2 ", "version 2.1 ") for g in ("GPL-3.0-or-later", "GPL-2.0-or-later")
)
HEADERS["AGPL-3.0-or-later"] = HEADERS["GPL-3.0-or-later"].replace("GNU General", "GNU Affero General")
HEADERS["Zlib"] = """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required."""
MORE = [("BSD-3-Clause", HEADERS["BSD-3-Clause"].replace("the copyright holder", who)) for who in ("the University of Nowhere", "Some Company, Inc.", "ACME")]
MORE += [("Apache-2.0", HEADERS["Apache-2.0"].replace("Licensed under", 'Some Body licenses this file to you under'))]


def test_real_headers(spark):
    notices = {name for name, ids in licenses.RULES if len(ids) > 1 and "_title" not in ids[0] and not name.endswith("-only")}
    assert set(HEADERS) == notices | {"ISC", "MPL-2.0", "Unlicense"}
    rows, want = [], []
    for name, header in [*HEADERS.items(), *MORE]:
        wrapped = "Copyright (C) 2020 Some Body\n\n" + header
        unwrapped = "\n\n".join(" ".join(p.split()) for p in wrapped.split("\n\n"))
        single = " ".join(header.split())
        commented = "".join(f" * {line}".rstrip() + "\n" for line in wrapped.split("\n"))
        close = header.replace("\n\n", "\n")
        for t in (header, wrapped, unwrapped, single, commented, close, commented.replace("\n", "\r\n")):
            rows.append((len(rows), t))
            want.append(name)
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == want
