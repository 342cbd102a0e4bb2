"""License scan: sentences become identifiers, identifier sequences become licenses by ordered rules.

Native, inside one row: no shuffle, so hot sources and copies don't matter. Null and empty texts have no sentence and no
license. Repeated rows give repeated rows; only doc_id and text are read, whatever other columns there are. An empty table gives no rows; texts are
read whole, however long.

Tags of the form SPDX-License-Identifier name licenses by themselves. A sentence that says a work is not under a license has no identifier. A
reservation of all rights beside a license is part of a copyright notice; alone it makes a work proprietary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public license texts after `normalised`, and the words one of which each of them holds. Where a text
# names its holder, or a mark ends a sentence early, what follows is a sentence of its own here.
KEYWORDS = [
    "licens", "licenc", "warrant", "copyright", "rights reserved", "redistribut", "public domain", "free software", "endors", "advertising materials", "used for good",
    "permission",
]
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-named": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-intro": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-named": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-may": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-not": "may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty-named": "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-named": "licensed under the apache license version 2.0",
    "apache-header": "licensed under the apache license version 2.0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache-at": "you may obtain a copy of the license at",
    "apache-address": "www.apache.org licenses license 2.0",
    "apache-law": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-limits": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-named": "this work is licensed under the gnu general public license version 3",
    "gpl3-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3-later-cut": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-later-cut": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl-terms": "under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-terms": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl3-later": "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl2-later": "under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "agpl3-later": "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "version2": "version 2 of the license",
    "version2-later": "either version 2 of the license or at your option any later version",
    "version21-later": "either version 2.1 of the license or at your option any later version",
    "version3-later": "either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "mpl-header": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "epl1": "under the terms of the eclipse public license v1.0",
    "epl2": "under the terms of the eclipse public license v2.0",
    "epl2-plain": "under the terms of the eclipse public license 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0-named": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-named": "licensed under cc by 4.0",
    "cc-by-sa-named": "licensed under cc by sa 4.0",
    "cc-by-nc-named": "licensed under cc by nc 4.0",
    "cc-by-full": "creative commons attribution 4.0 international license",
    "cc-by-sa-full": "creative commons attribution sharealike 4.0 international license",
    "cc-by-nc-full": "creative commons attribution noncommercial 4.0 international license",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-advertising-old": "all advertising materials mentioning features or use of this software must display the following acknowledgment",
    "json-good": "the software shall be used for good not evil",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-named": "distributed under the boost software license version 1.0",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "artistic2-named": "under the terms of the artistic license 2.0",
    "cddl1-header": "the contents of this file are subject to the terms of the common development and distribution license version 1.0",
    "reserved": "all rights reserved",
}
#: Words before a known sentence that turn it into its opposite.
NEGATIONS = ["not", "never", "no longer", "isn t", "aren t"]
#: A tag, its license expression, and what stands between the names in one.
TAG = r"SPDX-License-Identifier:([ \t(]*[A-Za-z0-9.+-]+[)]*(?:[ \t]+(?:OR|AND|WITH)[ \t]+[(]*[A-Za-z0-9.+-]+[)]*)*)"
BETWEEN = r"[ \t()]+"
#: Licenses and the sequences that prove them, tried in this order. What one has matched is spent.
RULES = [
    ("JSON", "mit-grant mit-notice json-good"),
    *[
        ("BSD-4-Clause", f"bsd-intro bsd-source bsd-binary {advertising} {endorse}")
        for advertising in ("bsd-advertising", "bsd-advertising-old") for endorse in ("bsd-endorse", "bsd-endorse-named", "bsd-endorse-may", "bsd-endorse-not")
    ],
    ("MIT", "mit-grant mit-notice mit-warranty mit-liability"),
    ("MIT", "mit-grant mit-notice"),
    ("ISC", "isc-grant isc-warranty"),
    ("ISC", "isc-grant"),
    ("BSD-3-Clause", "bsd-intro bsd-source bsd-binary bsd-endorse bsd-warranty"),
    ("BSD-3-Clause", "bsd-intro bsd-source bsd-binary bsd-endorse"),
    *[("BSD-3-Clause", f"bsd-intro bsd-source bsd-binary {x}") for x in ("bsd-endorse-named", "bsd-endorse-may", "bsd-endorse-not")],
    ("BSD-2-Clause", "bsd-intro bsd-source bsd-binary bsd-warranty"),
    ("BSD-2-Clause", "bsd-intro bsd-source bsd-binary bsd-warranty-named"),
    ("BSD-2-Clause", "bsd-intro bsd-source bsd-binary"),
    ("Apache-2.0", "apache-header apache-comply apache-copy apache-law apache-limits"),
    ("Apache-2.0", "apache-header apache-comply apache-at apache-address apache-law apache-limits"),
    ("Apache-2.0", "apache-header apache-comply apache-copy"),
    ("Apache-2.0", "apache-header apache-comply apache-at apache-address"),
    ("Apache-2.0", "apache-header"),
    ("Apache-2.0", "apache-named"),
    ("GPL-3.0-or-later", "gpl3-later gpl-warranty gpl-details"),
    ("GPL-3.0-or-later", "gpl3-later"),
    ("GPL-2.0-or-later", "gpl2-later gpl-warranty gpl-details"),
    ("GPL-2.0-or-later", "gpl2-later"),
    ("GPL-3.0-or-later", "gpl3-later-cut"),
    ("GPL-3.0-or-later", "gpl-terms version3-later"),
    ("GPL-2.0-or-later", "gpl2-later-cut"),
    ("GPL-2.0-or-later", "gpl-terms version2-later"),
    ("GPL-2.0-only", "gpl2-only"),
    ("GPL-2.0-only", "gpl-terms version2"),
    ("LGPL-3.0-or-later", "lgpl3-later"),
    ("LGPL-3.0-or-later", "lgpl-terms version3-later"),
    ("LGPL-2.1-or-later", "lgpl2-later"),
    ("LGPL-2.1-or-later", "lgpl-terms version21-later"),
    ("AGPL-3.0-or-later", "agpl3-later"),
    ("EPL-1.0", "epl1"),
    ("EPL-2.0", "epl2"),
    ("EPL-2.0", "epl2-plain"),
    ("GPL-3.0-only", "gpl3-named"),
    ("MPL-2.0", "mpl-header"),
    ("Unlicense", "unlicense"),
    ("CC0-1.0", "cc0-named"),
    ("CC-BY-NC-4.0", "cc-by-nc-named"),
    ("CC-BY-SA-4.0", "cc-by-sa-named"),
    ("CC-BY-4.0", "cc-by-named"),
    ("CC-BY-NC-4.0", "cc-by-nc-full"),
    ("CC-BY-SA-4.0", "cc-by-sa-full"),
    ("CC-BY-4.0", "cc-by-full"),
    ("MIT", "mit-named"),
    ("MIT", "mit-licensed"),
    ("0BSD", "0bsd-grant"),
    ("Zlib", "zlib-warranty zlib-grant"),
    ("BSL-1.0", "bsl-grant"),
    ("BSL-1.0", "bsl-named"),
    ("Artistic-2.0", "artistic2-named"),
    ("CDDL-1.0", "cddl1-header"),
    ("Proprietary", "reserved"),
]
#: A sentence ends at one of these marks before white space or the end, or before an empty line.
ENDS = r"[.!?;:]+(?:\s+|$)|\n\s*\n"


def normalised(sentence: Column) -> Column:
    """Lower case, 'licence' as 'license', anything but letters, numbers and points inside words as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), "licence", "license"), "[^a-z0-9.]+", " "))


def _identifier(sentence: Column) -> Column:
    """The longest known sentence with which this one ends: what precedes it may be an unfinished line."""
    out = F.lit(None).cast("string")
    for name, known in sorted(SENTENCES.items(), key=lambda x: len(x[1])):
        against = reduce(lambda a, b: a | b, [F.concat(F.lit(" "), sentence).endswith(f" {no} {known}") for no in NEGATIONS])
        out = F.when(against, F.lit(None)).when((sentence == known) | sentence.endswith(" " + known), name).otherwise(out)
    return out


def _tags(text: Column) -> Column:
    """The licenses that tags name, each once."""
    found = F.regexp_extract_all(text, F.lit(TAG), F.lit(1))
    names = F.flatten(F.transform(found, lambda x: F.split(x, BETWEEN)))
    return F.array_distinct(F.filter(names, lambda x: ~x.isin("", "OR", "AND", "WITH")))


def _told(text: Column, first: bool = False) -> Column:
    """Whether a lower-case text holds one of the keywords, or the first word of one: lines may break inside it."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k.split()[0] if first else k)) for k in KEYWORDS])


def _sequence(*names: str) -> str:
    return "".join(f"<{x}>" for x in names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (that speak of licenses), n_known (with an identifier), sentence_ids, licenses.

    sentence_ids holds the identifiers in order, licenses the names in order of the rules, each once; both are joined by commas. Between
    two identifiers of a rule other text may stand, but no other identifier and no sentence that speaks of licenses. Licenses that tags name come last.
    """
    about = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text")).select("doc_id", "text", F.lower("text").alias("small"))
    sentences = F.filter(F.transform(F.split("text", ENDS), normalised), lambda x: _told(x))
    rows = about.select("doc_id", F.when(F.contains("small", F.lit("spdx-license-identifier")), _tags(F.col("text"))).alias("tags"), F.when(_told(F.col("small"), first=True), sentences).otherwise(F.array().cast("array<string>")).alias("told"))
    rows = rows.select("doc_id", "tags", F.size("told").cast("long").alias("n_sentences"), F.transform("told", lambda x: F.coalesce(_identifier(x), F.lit("?"))).alias("ids"))
    known = F.filter("ids", lambda x: x != "?")
    # A text's identifiers as one string: rule after rule takes its sequence out and leaves a bar behind.
    text = F.when(F.size("ids") > 0, F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))).otherwise("")
    rules = F.array(*[F.struct(F.lit(_sequence(*names.split())).alias("ids"), F.lit(f"{name},").alias("name")) for name, names in RULES])
    rows = rows.select("doc_id", "tags", "n_sentences", F.size(known).cast("long").alias("n_known"), F.array_join(known, ",").alias("sentence_ids"), text.alias("text"))
    found = F.aggregate(rules, F.struct(F.col("text").alias("rest"), F.lit("").alias("found")), _applied, lambda a: a["found"])
    names = F.filter(F.split(F.when(F.col("n_known") > 0, found).otherwise(""), ","), lambda x: x != "")
    names = F.array_union(names, F.coalesce("tags", F.array().cast("array<string>")))
    rows = rows.withColumn("names", names)
    # A license gives rights away.
    licenses = F.when(F.size("names") > 1, F.array_remove("names", "Proprietary")).otherwise(F.col("names"))
    return rows.select("doc_id", "n_sentences", "n_known", "sentence_ids", F.array_join(licenses, ",").alias("licenses"))


def _applied(done: Column, rule: Column) -> Column:
    """What is left of a text's identifiers, and the licenses found, after one more rule."""
    new = F.contains(done["rest"], rule["ids"]) & ~F.contains(F.concat(F.lit(","), done["found"]), F.concat(F.lit(","), rule["name"]))
    found = F.when(new, F.concat(done["found"], rule["name"])).otherwise(done["found"])
    return F.struct(F.replace(done["rest"], rule["ids"], F.lit("|")).alias("rest"), found.alias("found"))
