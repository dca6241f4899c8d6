import re

import duckdb
from progscan.llm import licenses as L
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, documents, stored

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
CASES = {
    1: (GPL, ["GPL-3.0-or-later"]), 2: (MIT, ["MIT"]), 3: (APACHE, ["Apache-2.0"]),
    4: ("Text before.\nThis work is licensed under the GNU General Public License, version 3.\nAnd after.", ["GPL-3.0-only"]),
    5: ("a | b |\nReleased under the MIT License.", ["MIT"]), 6: ("x.\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    7: ("Licensed under CC BY 4.0. Then released under the MIT license.", ["CC-BY-4.0", "MIT"]),
    8: ("// SPDX-License-Identifier: BSD-3-Clause\n", ["BSD-3-Clause"]),
    9: ("The license plate was stolen; permission to park was refused.", []),
    10: ("Licensed under Creative Commons Attribution-ShareAlike 3.0!", ["CC-BY-SA-3.0"]),
    11: (MIT + "\n\n" + APACHE + "\n\n" + GPL, ["MIT", "Apache-2.0", "GPL-3.0-or-later"]),
}


def test_notices(spark):
    got = {r.doc_id: r for r in L.scan_licenses(documents(spark, [(i, t) for i, (t, _) in CASES.items()])).collect()}
    assert {i: r.licenses for i, r in got.items()} == {i: want for i, (_, want) in CASES.items()}
    assert all(not r.unmatched for i, r in got.items() if i not in (3, 11))


def test_order_matters(spark):
    """A rule is a sequence: its sentences in another order are unmatched parts."""
    parts = MIT.split("\n\n")
    got = L.scan_licenses(documents(spark, [(1, parts[2] + "\n\n" + parts[0]), (2, parts[0] + "\n\n" + parts[1])])).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].licenses == [] and by[1].unmatched == ["AsIsKind", "MitGrant"]
    assert by[2].licenses == ["MIT"] and [x.id for x in by[2].sentences] == ["MitGrant", "MitNotice"]


def test_tables_are_consistent():
    names = [n for n, _ in L.SENTENCES]
    assert len(set(names)) == len(names)
    assert {x for _, rule in L.RULES for x in rule} <= {*names, *(f"Spdx-{x}" for x in L.SPDX)}
    for _, p in L.SENTENCES:
        assert re.search(L.HINT, p), p


def test_odd(spark):
    d = documents(spark, ODD).withColumn("licenses", F.lit("clash")).withColumn("k", F.lit(1))
    got = L.scan_licenses(d).collect()
    assert len(got) == len(ODD) and all(r.licenses == [] == r.sentences for r in got)
    assert L.scan_licenses(d.where("false")).count() == 0


def commented(text, mark):
    return "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))


HEADER = APACHE.replace("You may obtain", "\nYou may obtain").replace("Unless", "\nUnless")


def test_several_notices_in_a_sentence(spark):
    cases = {
        1: ("// SPDX-License-Identifier: Apache-2.0 OR MIT\nint x", ["Apache-2.0", "MIT"]),
        2: ("Released under the MIT License\nLicensed under CC BY-NC 4.0\n", ["MIT", "CC-BY-NC-4.0"]),
        3: (commented(HEADER, " *"), ["Apache-2.0"]), 4: (commented(HEADER, "#"), ["Apache-2.0"]),
        5: ("# SPDX-License-Identifier: (MIT AND ISC) OR GPL-2.0-only\n# Released under the BSD license",
            ["MIT", "ISC", "GPL-2.0-only", "BSD-3-Clause"]),
        6: ("/* SPDX-License-Identifier: MIT */\nor isc and so on", ["MIT"])}
    got = {r.doc_id: r for r in L.scan_licenses(documents(spark, [(i, t) for i, (t, _) in cases.items()])).collect()}
    assert {i: r.licenses for i, r in got.items()} == {i: want for i, (_, want) in cases.items()}
    assert all(not r.unmatched for r in got.values())
    assert [x.id for x in got[3].sentences] == ["Apache2", "ApacheUse", "ApacheCopy", "ApacheWarranty", "ApacheSee"]


BSD = """Copyright (c) 2020, A. Person. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation."""
EXPRESSIONS = {
    1: ("# SPDX-License-Identifier: Zlib", ["Zlib"], []),
    2: ("<!-- SPDX-License-Identifier: (mit OR gpl-2.0+)-->\nThe end.", ["MIT", "GPL-2.0-or-later"], []),
    3: ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 AND Own-1.0", ["GPL-2.0-only"], ["Spdx-Own-1.0"]),
    4: ("SPDX-License-Identifier: MIT this is no more of it", ["MIT"], []),
    5: ("SPDX-License-Identifier: " + " OR ".join(["ISC", "Apache-2.0"] * 2000), ["ISC", "Apache-2.0"] * 2000, []),
    6: ("spdx-license-identifier:\nMIT", [], []),
    7: (BSD, ["BSD-2-Clause"], []),
    8: ("(c) A. Person. All rights reserved.", ["Proprietary"], []),
    9: ("All rights reserved. Released under the MIT License. All rights reserved.", ["MIT"], []),
    10: ("\u0002MIT\u0001 licensed under the apache license version 2.0", ["Apache-2.0"], []),
    11: ("\n *\n *\n * Released under the MIT License\n *\n * Licensed under CC BY 4.0\n */", ["MIT", "CC-BY-4.0"], []),
}


def test_expressions_and_support(spark):
    rows = [(i, x[0]) for i, x in EXPRESSIONS.items()]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in L.scan_licenses(documents(spark, rows)).collect()}
    assert got == {i: (licences, unmatched) for i, (_, licences, unmatched) in EXPRESSIONS.items()}


def test_query_is_its_sql(spark, tmp_path):
    """Texts with several notices in a sentence, commented headers, expressions, odd texts."""
    texts = [t for t, _ in CASES.values()] + [x[0] for x in EXPRESSIONS.values()] + [t for _, t in ODD]
    texts += [commented(t, m) for t in (GPL, MIT, HEADER, BSD) for m in (" *", "#", "//", "--")]
    texts += ["Released under the MIT License\nLicensed under CC BY-NC 4.0\n", "// SPDX-License-Identifier: Apache-2.0 OR MIT\nint x",
              "permission\n\n\nreserved ;\n;#\n#\n#\nsee the license", "licence " * 3000]
    folder = stored(spark, tmp_path, list(enumerate(texts)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    sql = con.execute(L._oracle())
    names = [c[0] for c in sql.description]
    want = sorted(sql.fetchall())
    got = L.op2(spark, folder)
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == want and len(want) == len(texts)
