"""License scans against the same cosine in plain Python."""

import math
import posixpath
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import licenses
from gleaner.llm.queries import op6_license_scan

MIT_FILE = """MIT License
Copyright (c) 2020 Somebody
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction
"""


def brute(rows):
    """{(doc_id, path): (own, cosine, is_file, license)} of rows (doc_id, path, text)."""
    templates = [(name, licenses.terms_of(text)) for name, text in licenses.TEMPLATES]
    vocabulary = {t for _, words in templates for t in words}
    df = Counter(t for _, _, text in rows for t in set(licenses.terms_of(text or "")) & vocabulary)
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) for t in vocabulary}
    other = math.log(1 + len(rows))

    def cosine(a, b):
        a, b = ({t: n * idf.get(t, other) for t, n in Counter(x).items()} for x in (a, b))
        length = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return sum(v * b.get(t, 0) for t, v in a.items()) / length if length else 0.0

    out, held = {}, {}
    for doc, path, text in rows:
        name = posixpath.basename(path or "")
        named = bool(re.match(r"(?i)(licen[cs]e|copying|unlicense|notice)([._-].*)?$", name))
        words = licenses.terms_of(text or "")
        passages = [(licenses.terms_of(part), False) for part in re.split(r"\n|(?<=[.!?;])[ \t\r]+", text or "")] + [(words, True)]
        close = [(-round(c, 9), name, whole) for own, whole in passages for name, template in templates if (c := cosine(own, template)) >= licenses.THRESHOLD]
        best = min(close, default=None)
        is_file = bool(close) and (named or any(whole for _, _, whole in close))
        out[doc, path] = (best and best[1], best and -best[0], is_file)
        if is_file and path is not None:
            d = posixpath.dirname(path)
            held[d] = min(held.get(d, (9, "")), best[:2])
    final = {}
    for (doc, path), (own, cos, is_file) in out.items():
        found, d = own, posixpath.dirname(path) if path is not None else None
        while found is None and d is not None:
            if d in held:
                found = held[d][1]
            d = posixpath.dirname(d) if d else None
        final[doc, path] = (own, cos, is_file, found)
    return final


def got(df):
    return {(r.doc_id, r.path): (r.own, r.cosine, r.is_file, r.license) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k, (own, cosine, is_file, found) in b.items():
        assert (a[k][0], a[k][2], a[k][3]) == (own, is_file, found), k
        assert (a[k][1] is None) == (cosine is None) and (cosine is None or a[k][1] == pytest.approx(cosine, abs=2e-9))


def test_query_on_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "text")
    mine = got(op6_license_scan(spark, sf))
    same(mine, brute([tuple(r) for r in docs.collect()]))
    assert any(r[0] for r in mine.values())


def test_inheritance(spark):
    rows = [
        (1, "a/LICENSE", MIT_FILE),
        (2, "a/b/c/code.py", "some code of no particular kind"),
        (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/header.c", "Some title\n# SPDX. This work is licensed under the GNU General Public License, version 2. More text here"),
        (5, "other/x", "nothing"),
        (6, "top.txt", None),
        (7, None, "Released under the MIT License."),
        (8, "a/bb/x", ""),
        (8, "a/bb/x", ""),
        (9, "a/b/COPYING", "hello"),
    ]
    df = spark.createDataFrame([(*r, 1, "t", 0.5) for r in rows], "doc_id bigint, path string, text string, passage int, term string, w double")
    out = licenses.scan(df)
    mine = got(out)
    same(mine, brute(rows))
    assert out.count() == len(rows)
    found = {d: r[3] for (d, _), r in mine.items()}
    assert found == {1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0", 4: "GPL-2.0", 5: None, 6: None, 7: "MIT", 8: "MIT", 9: "Apache-2.0"}


def test_no_python_in_the_plan(spark, sf):
    plan = op6_license_scan(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_ancestors(spark):
    row = spark.range(1).select(licenses.ancestors(F.lit("a/b")).alias("two"), licenses.ancestors(F.lit("")).alias("top"), licenses.directory(F.lit("x")).alias("d")).first()
    assert (row.two, row.top, row.d) == (["", "a", "a/b"], [""], "")
