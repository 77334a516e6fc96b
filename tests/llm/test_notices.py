"""Licence notices as they are printed, and the SQL's view of them."""

from __future__ import annotations

import duckdb

from restitch.llm import licenses

GPL = "Foo is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nFoo is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details."
CASES = [
    (GPL,"GPL-3.0-or-later"),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.","GPL-2.0-or-later"),
    ("License: GPL v3","GPL-3.0"),
    ("License: Apache 2.0","Apache-2.0"),
    ("SPDX-License-Identifier: EUPL-1.2","EUPL-1.2"),
    ("is not licensed under the MIT License",None),
    ("This is not licensed under the MIT License but licensed under the Apache License 2.0.","Apache-2.0"),
    ("SPDX-License-Identifier: MIT AND (Apache-2.0 OR GPL-2.0-only WITH Classpath-exception-2.0)","MIT AND (Apache-2.0 OR GPL-2.0-only WITH Classpath-exception-2.0)"),
    ("This file is in the public domain.","Public-Domain"),
    ("This code is not in the public domain.",None),
    ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not\n   claim that you wrote the original software.","Zlib"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)","BSL-1.0"),
    ('Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the "Software") to use, reproduce, display, distribute,\nexecute, and transmit the Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to whom the Software is furnished to\ndo so, all subject to the following:',"BSL-1.0"),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to Foo.","CC0-1.0"),
    ("CC0 1.0 Universal\n\nStatement of Purpose","CC0-1.0"),
    ("            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n                    Version 2, December 2004\n\n  0. You just DO WHAT THE FUCK YOU WANT TO.","WTFPL"),
    ('The contents of this file are subject to the terms of the\nCommon Development and Distribution License (the "License").',"CDDL-1.0"),
    ("Licensed under CDDL 1.1","CDDL-1.1"),
    ("SPDX-License-Identifier: MIT","MIT"),
    ("license: mit or apache-2.0","MIT OR Apache-2.0"),
    ("SPDX-License-Identifier: MIT OR Foo-1.0","MIT"),
    (None, None),
]


def test_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r.asDict() for r in licenses.scan(df).collect()}
    assert {i: r["license"] for i, r in got.items()} == {i: want for i, (_, want) in enumerate(CASES)}
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    told = con.sql(licenses.oracle_sql())
    assert {r[0]: r for r in got.items()} == {d["doc_id"]: (d["doc_id"], d) for d in (dict(zip(told.columns, r, strict=True)) for r in told.fetchall())}
