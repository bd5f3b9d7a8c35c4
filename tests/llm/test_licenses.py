from lodestone.llm import licenses

MIT = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n".join(
    [
        'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n',
        "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ]
)
BSD = [licenses.SENTENCES[f"bsd-{x}"][0] + "." for x in ("grant", "source", "binary", "names")]
CASES = [
    (None, "", ""),
    ("", "", ""),
    ("Words only, no grant. " * 2000, "", ""),
    ("Some prose***\nReleased under the MIT License.", "mit-reference", "MIT"),
    ("LICENSED under the Apache License,  Version 2.0.", "apache-reference", "Apache-2.0"),
    ("Licensed under the Apache License, Version 2.0. you may not use this file except in compliance with the License. x", "apache-reference,apache-compliance", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "gpl3-reference,cc-by-nc-reference", "CC-BY-NC-4.0,GPL-3.0-only"),
    (MIT, "mit-title,mit-grant,mit-notice,as-is", "MIT"),
    (MIT.replace("\n", "\r\n"), "mit-title,mit-grant,mit-notice,as-is", "MIT"),
    (" ".join(BSD[:3]), "bsd-grant,bsd-source,bsd-binary", "BSD-2-Clause"),
    (" ".join(BSD), "bsd-grant,bsd-source,bsd-binary,bsd-names", "BSD-3-Clause"),
    (" ".join([*BSD, *BSD[:3]]), "bsd-grant,bsd-source,bsd-binary,bsd-names,bsd-grant,bsd-source,bsd-binary", "BSD-2-Clause,BSD-3-Clause"),
    (" ".join(reversed(BSD)), "bsd-names,bsd-binary,bsd-source,bsd-grant", ""),
    ("Released under the MIT License.\n" * 3, "mit-reference,mit-reference,mit-reference", "MIT"),
    ("Not released under the MIT License, sadly.", "", ""),
    ("The code is released under the MIT license.", "mit-reference", "MIT"),
    ("We like the MIT License and the Apache License a lot.", "", ""),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-or-later\nint x;", "spdx:MIT,spdx:Apache-2.0,spdx:GPL-2.0-or-later", "Apache-2.0,GPL-2.0-or-later,MIT"),
    ("Some tool\n" + "\n".join(BSD[0].split(" ", 9)) + "\n\n" + " ".join(BSD[1:3]), "bsd-grant,bsd-source,bsd-binary", "BSD-2-Clause"),
    ("  GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", "lgpl-title,version-3", "LGPL-3.0-only"),
    ("Released under the MIT License\nSome prose\n\n" + " ".join(BSD[:3]).replace(" the ", "\nthe "), "mit-reference,bsd-grant,bsd-source,bsd-binary", "BSD-2-Clause,MIT"),
    (" * Distributed under the terms of the\n * Apache License, Version 2.0\n", "apache-reference", "Apache-2.0"),
    ("available under the GNU Affero General Public License, version 3. Also licensed under GPLv2+", "agpl3-reference,gpl2-later-reference", "AGPL-3.0-only,GPL-2.0-or-later"),
    (" ".join(BSD).replace("the copyright holder", "Google Inc."), "bsd-grant,bsd-source,bsd-binary,bsd-names", "BSD-3-Clause"),
    ("This isn't released under the MIT License. It won\u2019t be licensed under GPLv3. It is no longer available under the ISC License.", "", ""),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-reference", "CC-BY-4.0"),
    ("# Tool\n\nLicense: MIT\n\nMore", "mit-reference", "MIT"),
    ("## License\n\nMIT License\n", "mit-reference", "MIT"),
    ("This project uses the MIT license.", "mit-reference", "MIT"),
    ("# SPDX-License-Identifier: GPL-2.0\n# SPDX-License-Identifier: LGPL-2.1+", "spdx:GPL-2.0-only,spdx:LGPL-2.1-or-later", "GPL-2.0-only,LGPL-2.1-or-later"),
    ("Dual-licensed under MIT or Apache-2.0.", "mit-reference,apache-reference", "Apache-2.0,MIT"),
    ("Code licensed under the MIT and Apache 2.0 licenses", "mit-reference,apache-reference", "Apache-2.0,MIT"),
    ("Licensed under GPL v2 or later and the ISC License", "gpl2-later-reference,isc-reference", "GPL-2.0-or-later,ISC"),
    (BSD[0] + " Released under the ISC License. " + " ".join(BSD[1:3]), "bsd-grant,isc-reference,bsd-source,bsd-binary", "BSD-2-Clause,ISC"),
    ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "apache-title,apache-terms", "Apache-2.0"),
]


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, "mine") for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string, licenses string")
    for row in licenses.query(docs).collect():
        _, ids, found = CASES[row.doc_id]
        assert (row.sentence_ids, row.licenses, row.n_sentences) == (ids, found, len(ids.split(",")) if ids else 0), row.doc_id
    assert licenses.scan(docs).columns == ["doc_id", "text", "sentence_ids", "licenses"]
    assert licenses.query(docs.where("false")).count() == 0
    assert "Python" not in licenses.scan(docs)._jdf.queryExecution().toString()


def test_a_text_of_twenty_thousand_notices(spark):
    """Neither depth nor time grows with the notices but in proportion, in order or out of it."""
    texts = ["Permission " + licenses.SENTENCES["mit-grant"][0] + ". " + "Released under CC BY 4.0. " * 20_000, "Released under the MIT License. Words. " * 20_000, (" ".join(BSD[:2]) + " ") * 1_500 + BSD[2], "Licensed under the Apache License, Version 2.0. GNU GENERAL PUBLIC LICENSE\n" * 3_000]
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in licenses.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (20_001, "CC-BY-4.0"), 1: (20_000, "MIT"), 2: (3_001, "BSD-2-Clause"), 3: (6_000, "Apache-2.0")}


def test_sequences_come_before_their_parts():
    """All sequences may be matched before any single identifier: each that has both is in this order among the rules."""
    for at, (_, ids) in enumerate(licenses.RULES):
        if len(ids) == 1 and ids[0] in licenses.ORDERED:
            assert all(ids[0] not in later for _, later in licenses.RULES[at + 1 :])


def test_every_rule_matches_its_own_sentences(spark):
    def said(x):
        return f"SPDX-License-Identifier: {x[5:]}" if x.startswith("spdx:") else (licenses.SENTENCES[x][0] if x in licenses.SENTENCES else f"This work is licensed under the {licenses.NAMES[x][0]}") + "."

    texts = [(i, "\n".join(map(said, ids))) for i, (_, ids) in enumerate(licenses.RULES)]
    got = {r.doc_id: r.licenses for r in licenses.query(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: licence for i, (licence, _) in enumerate(licenses.RULES)}


def test_notice_lines_beside_wrapped_licences(spark):
    notice = "My tool 2\nLicensed under CC BY 4.0\nSee the manual\n\n"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
    gpl = licenses.SENTENCES["gpl3-later"][0].replace("Foundation, either", "Foundation,\neither").replace("your option", "your\noption")
    cases = [
        (notice + isc, "cc-by-reference,isc-grant", "CC-BY-4.0,ISC"),
        (isc + "\n" + notice, "isc-grant,cc-by-reference", "CC-BY-4.0,ISC"),
        ((notice + isc).replace("\n", "\r\n"), "cc-by-reference,isc-grant", "CC-BY-4.0,ISC"),
        (notice + MIT, "cc-by-reference,mit-title,mit-grant,mit-notice,as-is", "CC-BY-4.0,MIT"),
        (isc + notice, "isc-grant,cc-by-reference", "CC-BY-4.0,ISC"),
        (gpl + ".", "gpl3-later", "GPL-3.0-or-later"),
        ("This work is dedicated to the public\ndomain under CC0 1.0.", "cc0-reference", "CC0-1.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + notice, "gpl-title,version-3,cc-by-reference", "CC-BY-4.0,GPL-3.0-only"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.query(docs).collect()}
    assert got == {i: case[1:] for i, case in enumerate(cases)}


def test_the_table_equals_its_sql(spark):
    import duckdb

    from lodestone.llm import sql

    path = "/root/testdata/sf0.01/documents.parquet"
    want = duckdb.sql(sql.oracle_sql()["op10_license_scan"].replace("FROM documents", f"FROM '{path}'")).fetchall()
    got = [tuple(r) for r in licenses.query(spark.read.parquet(path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
