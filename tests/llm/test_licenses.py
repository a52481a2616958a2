"""The licence scan against a plain version, and every rule on texts made for it."""

import collections
import random
import re
from re import _parser

import brute
from pyspark.sql import functions as F

from tidewell.llm import license_scan
from tidewell.llm.license_rules import families

FAMILIES = families()


def sample(pattern, most):
    """A text that the pattern matches: with as few parts as can be, or as many."""

    def of(parts):
        out = ""
        for op, x in parts:
            name = str(op)
            if name == "LITERAL":
                out += chr(x)
            elif name == "ANY":
                out += "x"
            elif name == "SUBPATTERN":
                out += of(x[3])
            elif name == "BRANCH":
                out += of(x[1][-1 if most else 0])
            elif name == "IN":
                kind, value = x[-1 if most else 0]
                out += chr(value[1] if most else value[0]) if str(kind) == "RANGE" else chr(value)
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += of(x[2]) * (min(x[1], 4) if most else x[0])
            else:
                raise ValueError(name)
        return out

    return re.sub(" +", " ", of(_parser.parse(pattern))).strip()


def plain(text):
    """Resolved detections (s, e, label, confidence) of a text."""
    w = brute.PLAIN_WORD.findall(brute.low(text or ""))
    t, found = " " + " ".join(w) + " ", []
    for _, keywords, rules in FAMILIES:
        if set(keywords) & set(w):
            for m in re.finditer(license_scan.pattern_of(rules), t):
                _, priority, label, confidence = next(r for r in rules if re.fullmatch(r[0], m[0]))
                found.append((m.start(), -m.end(), priority, label, confidence))
    kept = []
    for s, e, priority, label, confidence in sorted(found):
        if kept and s < kept[-1][1]:
            if -e > kept[-1][1] and priority < kept[-1][2]:
                kept[-1] = (s, -e, priority, label, confidence)
        else:
            kept.append((s, -e, priority, label, confidence))
    return [(s, e, label, confidence) for s, e, _, label, confidence in kept]


def test_every_rule_fires_behind_its_keyword(spark):
    rows = []
    for name, keywords, rules in FAMILIES:
        for pattern, _, label, _ in rules:
            for most in (False, True):
                text = sample(pattern, most)
                assert re.fullmatch(pattern, text), pattern
                assert set(keywords) & set(text.split()), f"{name}: no keyword in {text!r}"
                first = next(r for r in rules if re.fullmatch(r[0], text))
                assert first[2] == label, pattern
                rows.append((len(rows), f"see {text} here", label))
    assert len(rows) > 600
    got = {r["doc_id"]: [(x["s"], x["e"], x["label"], x["confidence"]) for x in r["found"]] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string, label string")).collect()}
    for i, text, _ in rows:
        assert got[i] == plain(text) and got[i], text


def test_labels_of_known_texts(spark):
    texts = {
        "GNU Library General Public License version 2.0": {"lgpl-2.0"},
        "Expat License": {"mit"},
        "PSF License": {"python"},
        "Creative Commons Zero": {"cc0"},
        "Apache Software License (ASL)": {"apache"},
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal': {"mit"},
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": {"bsd"},
        "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": {"bsd-3-clause"},
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": {"isc"},
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': {"apache-2.0"},
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version": {"lgpl-2.1-or-later"},
        "SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2.0-or-later"},
        "https://creativecommons.org/licenses/by-sa/4.0/": {"cc-by-sa"},
        "the limit of a disc account is common": set(),
        "A general rule of the public library": set(),
    }
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: {x["label"] for x in r["found"]} for r in license_scan.scan(d).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_overlaps_are_resolved_like_the_plain_version(spark):
    r = random.Random(3)
    pieces = [sample(rule[0], m) for *_, rules in FAMILIES for rule in rules for m in (False, True)]
    words = " ".join(pieces).split()
    rows = []
    for i in range(300):
        parts = [r.choice(pieces) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 12))]
        rows.append((i, r.choice([" ", ", ", "\n"]).join(parts)))
    rows += [(300, None), (301, ""), (302, "gpl " * 3000)]
    d = spark.createDataFrame(rows, "doc_id int, text string")
    got = {x["doc_id"]: [(y["s"], y["e"], y["label"], y["confidence"]) for y in x["found"]] for x in license_scan.scan(d).collect()}
    for i, text in rows:
        assert got[i] == plain(text), text
    out = {x["doc_id"]: x for x in license_scan.report(d).collect()}
    for i, text in rows:
        base = set(filter(None, brute.licences(text)[-1].split(",")))
        assert out[i]["labels"] == ",".join(sorted(base | {x[2] for x in plain(text)}))
        assert out[i]["score"] == max([x[3] for x in plain(text)] + [0.5 if base else 0.0])
    assert collections.Counter(out[i]["n_words"] > 0 for i in range(300, 303)) == {False: 2, True: 1}
    assert d.select(F.count("*")).first()[0] == 303
