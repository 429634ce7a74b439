from __future__ import annotations

from hearthline.llm import licenses

MIT = next(t for a, t in licenses.LICENSES if a == "MIT" and len(t) > 200)


def test_scan(spark):
    rows = [
        (1, "Some prose.\nLicensed under CC BY-NC 4.0."),
        (2, "LICENSED under the apache licence -- version 2.0"),
        (3, "Copyright (c) 2020 A. Person\n" + MIT.replace(". ", ".\n").replace('"', "'")),
        (4, "Prose that is not licensed under CC BY-NC 4.0. Really."),
        (5, None),
        (6, ""),
        (None, "© 2001 X\nReleased under the MIT Licence"),
        (7, "!!!\n...\n"),
        (8, "x " * 100_000 + "\n  Released   under the MIT License.\nReleased under the MIT License."),
        (8, "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(i, t, 1, "d", "u") for i, t in rows], "doc_id long, text string, line int, digest string, unit string")
    found = sorted((str(r.doc_id), r.line, r.license_id) for r in licenses.scan(df).collect())
    assert found == sorted(
        [("1", 2, "CC-BY-NC-4.0"), ("2", 0, "Apache-2.0"), ("3", 0, "MIT"), ("None", 0, "MIT"), ("None", 2, "MIT"),
         ("8", 2, "MIT"), ("8", 3, "MIT"), ("8", 0, "MIT")]
    )


def test_table_of_the_caller_and_empty(spark):
    own = licenses.known(spark, (("own", "My very own terms"),))
    df = spark.createDataFrame([(1, "my VERY own-terms."), (2, "MIT License")], "doc_id long, text string")
    assert [(r.doc_id, r.license_id) for r in licenses.scan(df, own).collect()] == [(1, "own")]
    assert licenses.scan(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


BSD = """{title}Copyright (c) 2019, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def test_whole_licences(spark):
    mit = MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS OR\nCOPYRIGHT HOLDERS").replace("to deal", "\nto deal")
    rows = [
        (1, "MIT License\n\nCopyright (c) 2021 A. Person\n\n" + mit),
        (2, "Copyright 2021 A. Person\n\n" + mit),
        (3, BSD.format(title="BSD 3-Clause License\n\n")),
        (4, BSD.format(title="")),
        (5, BSD.format(title="").replace("THIS SOFTWARE", "This other software")),
    ]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.line, r.license_id) for r in found) == [(1, 0, "MIT"), (2, 0, "MIT"), (3, 0, "BSD-3-Clause"), (4, 0, "BSD-3-Clause")]
