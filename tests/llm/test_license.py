import re

from pvspark.llm import license, oracle
from pyspark.sql import functions as F

from tests.llm.common import SF, connect, documents, edge_rows, same

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""


def found(spark, *texts):
    rows = license.scan_licenses(documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    return [(r.n_sentences, r.n_known, r.sentence_ids, r.licenses) for r in rows]


def test_sequences_win_over_single_sentences(spark):
    bsd = ". ".join(license.SENTENCES[k] for k in ("bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse"))
    assert found(spark, MIT, bsd, "Hello there\nLicensed under the Apache License, Version 2.0.", "Licensed under the Apache Licence, version 2.0!") == [
        (2, 2, "mit-grant,mit-notice", "MIT"),
        (4, 4, "bsd-intro,bsd-source,bsd-binary,bsd-endorse", "BSD-3-Clause"),
        (1, 1, "apache-named", "Apache-2.0"),
        (1, 1, "apache-named", "Apache-2.0"),
    ]


BSD = """Copyright (c) 2019, Acme Inc. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY ACME INC. AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
ENDORSE = "to endorse or\npromote products derived from this software without specific prior written permission."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    {}://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
GNU = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by the Free Software Foundation{} {}"
LATER = "either version {} of the License, or (at your option) any later version."


def test_real_texts_with_named_holders(spark):
    cases = [
        (BSD.format("3. Neither the name of Acme Inc. nor the names of its contributors may be used " + ENDORSE), "BSD-3-Clause"),
        (BSD.format("3. Neither the name of the University of Oz nor the names of its contributors may be used " + ENDORSE), "BSD-3-Clause"),
        (BSD.format("3. The name of Jo Doe may not be used " + ENDORSE), "BSD-3-Clause"),
        (BSD.format(""), "BSD-2-Clause"),
        (APACHE.format("http"), "Apache-2.0"), (APACHE.format("https"), "Apache-2.0"),
        (GNU.format(":", "", ",", LATER.format(3)), "GPL-3.0-or-later"), (GNU.format(";", "", ";", LATER.format(2)), "GPL-2.0-or-later"),
        (GNU.format(";", "", ";", "version 2 of the License."), "GPL-2.0-only"), (GNU.format(";", "Lesser ", ";", LATER.format("2.1")), "LGPL-2.1-or-later"),
        (GNU.format(":", "Affero ", ",", LATER.format(3)), "AGPL-3.0-or-later"), (GNU.format(":", "Lesser ", ",", LATER.format(3)), "LGPL-3.0-or-later"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("Available under the terms of the Eclipse Public License v2.0.", "EPL-2.0"), ("Released into the\npublic\ndomain", ""),
        (BSD.format("3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n   This product includes software "
                    "developed by Acme Inc.\n4. Neither the name of Acme Inc. nor the names of its contributors may be used " + ENDORSE), "BSD-4-Clause"),
        (MIT + "\n\nThe Software shall be used for Good, not Evil.", "JSON"), (MIT, "MIT"), ("Copyright (c) 2020 Jo Doe. All rights reserved.\n\n" + MIT, "MIT"),
        ("Not licensed under the MIT License.", ""), ("This file is no longer licensed under the Apache License, Version 2.0.", ""), ("This isn't released under the MIT license.", ""),
        ("Copyright Acme. All rights reserved.", "Proprietary"), ("/* SPDX-License-Identifier: MIT */", "MIT"), ("# SPDX-License-Identifier: (Apache-2.0 OR MIT)\nimport x", "Apache-2.0,MIT"),
        ("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nSPDX-License-Identifier: MIT\nReleased under the MIT License.", "MIT,GPL-2.0-only,Classpath-exception-2.0"),
        ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
         "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
         "restrictions:", "Zlib"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0BSD"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
         "permission notice appear in all copies.", "ISC"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("You may use it under the terms of the Artistic License 2.0.", "Artistic-2.0"),
        ("The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0.", "CDDL-1.0"),
    ]
    got = found(spark, *[t for t, _ in cases])
    assert [x[3] for x in got] == [x for _, x in cases]
    assert [x[:2] for x in got][4:6] == [(6, 6)] * 2
    docs = documents(spark, [(k, t) for k, (t, _) in enumerate(cases)])
    con = connect()
    con.execute("CREATE OR REPLACE TABLE texts (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?, ?)", [(k, t) for k, (t, _) in enumerate(cases)])
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM texts")
    same(license.scan_licenses(docs), con, oracle.scan_licenses())


def test_order_and_what_stands_between_matter(spark):
    a, b = license.SENTENCES["mit-grant"], license.SENTENCES["mit-notice"]
    assert [x[3] for x in found(spark, f"{a}. {b}.", f"{b}. {a}.", f"{a}. I hold no warranty. {b}.", f"{a}. Nice weather. {b}.")] == ["MIT", "", "", "MIT"]


def test_licenses_are_named_once(spark):
    text = "Released under the MIT License. All rights reserved. Released under the MIT license."
    assert found(spark, text) == [(3, 3, "mit-named,reserved,mit-named", "MIT")]


def test_equals_sql(spark):
    same(license.scan_licenses(spark.read.parquet(f"{SF}/documents.parquet")), connect(), oracle.scan_licenses())


def test_sentences_are_normal_and_hold_a_keyword(spark):
    rows = spark.createDataFrame([(k, v) for k, v in license.SENTENCES.items()], "k string, v string").select("k", license.normalised(F.col("v")).alias("n"), "v").collect()
    assert all(r.n == r.v for r in rows)
    assert all(any(k in v for k in license.KEYWORDS) for v in license.SENTENCES.values())
    assert {x for _, names in license.RULES for x in names.split()} <= set(license.SENTENCES)
    assert all(re.fullmatch(r"[a-z0-9-]+", k) for k in license.SENTENCES)


def test_odd_texts(spark):
    docs = documents(spark, [*edge_rows(), (30, "licensed " * 20_000)])
    out = license.scan_licenses(docs)
    assert out.count() == docs.count() and out.filter("licenses <> ''").count() == 0
    assert license.scan_licenses(docs.filter("false")).count() == 0
