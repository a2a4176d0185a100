"""Openings of license texts, and that no gate hides a signature."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from podium.llm import licenses

from .conftest import key

TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in the Software without restriction""",
    "bsd": """Copyright (c) 2020, Someone. Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "apache": """Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,""",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "gpl": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "mpl": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "zlib": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "cc-by-nc-sa": "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "json": "The Software shall be used for Good, not Evil.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def test_openings(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS.values())), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, label in enumerate(TEXTS):
        assert set(label.split(",")) <= set(got[i]["labels"].split(",")) and got[i]["score"] == 1.0, (label, got[i])


def examples():
    """A text that each signature matches, made from its regex: first alternatives, options left out or taken."""
    rng = random.Random(3)
    for label, _, body in licenses.SIGNATURES:
        text = body
        for _ in range(8):
            text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?|\+|\{\d,\d+\})?", lambda m: m[1] if m[2] != "?" or rng.random() < 0.5 else "", text)
        text = re.sub(r"\[([a-z0-9])[^]]*\]\+?", r"\1", text).replace(" ?", " ").replace("?", "")
        yield label, re.sub(" +", " ", text)


def test_no_gate_hides_a_signature(spark):
    cases = list(examples())
    docs = spark.createDataFrame([(i, f"Some words. {t.upper() if i % 2 else t}, and more.") for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(docs).collect()}
    assert [t for i, (label, t) in enumerate(cases) if label not in got[i]] == []
    assert len(licenses.SIGNATURES) > 100 and len(licenses.rules()) > 300


def test_sql_agrees_on_license_texts(spark):
    texts = [*TEXTS.values(), "GPLv3 or LGPLv2", "AGPLv3", " ".join(TEXTS.values()), *(t for _, t in examples())]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(licenses.sql())
    names = [c[0] for c in want.description]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(names)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("rule", licenses.SIGNATURES, ids=lambda r: r[0])
def test_keyword_is_part_of_the_signature(rule):
    assert re.search(rf"(?<![a-z0-9]){rule[1]}", rule[2])
