import random
import re

from comparing import assert_same

from tracewell.llm import licenses, queries
from tracewell.llm.oracles import ORACLES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    whole = text or ""
    text = whole.translate(LOWER)
    words = WORD.findall(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    best = {}
    for block in re.split(r"\n[ \t\r\v\f]*\n", re.sub(r"([.!?])[ \t\n\v\f\r]+([A-Z])", r"\1\n\n\2", whole)):
        have = set(WORD.findall(block.translate(LOWER)))
        for label, t in licenses.TEMPLATES.items():
            need, needed, foreign = (set(x.split()) for x in t)
            if needed <= have and not foreign & have and len(have & need) >= licenses.THRESHOLD * len(need) - 1e-9:
                best[label] = max(best.get(label, 0), len(have & need) / len(need))
    base = {label for _, label in places}
    return (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | set(best))), 1.0 if places else max(best.values(), default=0.0))


def held(rows, texts):
    for r in rows:
        assert tuple(r)[1:] == brute(texts[r["doc_id"]]), r["doc_id"]


def test_whole_table_against_sql_and_brute_force(spark, sf_dir):
    assert_same(queries.op6_license_scan(spark, sf_dir), ORACLES["op6_license_scan"], sf_dir)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held(queries.op6_license_scan(spark, sf_dir).collect(), docs)


def test_near_templates(spark, documents):
    draw, texts = random.Random(2), {}
    for i in range(400):
        words = draw.choice([t for t, _, _ in licenses.TEMPLATES.values()]).split()
        words = [w for w in words if draw.random() > 0.12] + draw.choices(["zeta", "Und", "of", "the.", "Lesser", "Affero", "3"], k=draw.randrange(6))
        if draw.random() < 0.3:
            draw.shuffle(words)
        words.insert(draw.randrange(len(words) + 1), draw.choice(["cc by", "CC-BY\n", "All rights\treserved.", "x"]))
        texts[i] = draw.choice([" ", ", ", "\r\n", "-"][: draw.choice([1, 2, 4])]).join(words)
    held(licenses.scan_licenses(documents([(i, t, "s") for i, t in texts.items()])).collect(), texts)


def test_odd_rows(spark, documents, odd_rows):
    extra = [(30, "CC BY cc\x00by CC.BY", "a"), (31, "all rights reserved all rights reserved", "a"), (32, "LİCENSED K under the mit license", "a"), (33, "ccby cc  by\ncc\nby é", "b"), (34, "RELEASED\nunder the MIT license", "b")]
    got = licenses.scan_licenses(documents([*odd_rows, *extra])).collect()
    assert len(got) == len(odd_rows) + len(extra)
    held([r for r in got if r["doc_id"] is not None], {i: t for i, t, _ in [*odd_rows, *extra]})
    assert licenses.scan_licenses(documents([])).count() == 0


LINES = {
    "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
    "Released under the Apache license": "", "Released under the GPL license": "", "Released under the MIT License.": "mit",
    "licensed under the Mozilla license version 2.0": "", "Licensed under the Apache License, Version 2.0 (the \"License\");": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "This work is licensed under the GNU General Public License, version 2 only.": "gpl,gpl-2.0",
    "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0,gpl", "This work is licensed under the GNU Lesser General Public License, version 3.": "gpl,lgpl-3.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that": "isc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not": "mpl-2.0",
    "The license was released under the pressure of the press.": "", "Die Lizenz kam mit der Lieferung, under the license of 2.0": "",
    "We use source and binary forms with or without the modification you are permitted": "", "A driver's license, version 2, under the seat": "", "All rights reserved. Licensed under nothing.": "reserved",
}


def test_labelled_lines(spark, documents):
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(documents([(i, f"Some words first. {t}\n\nAnd more.", "s") for i, t in enumerate(LINES)])).collect()}
    assert {t: got[i] for i, t in enumerate(LINES)} == LINES


def test_wrapped_notices(spark, documents):
    texts = {
        "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")",
        "bsd": "# Redistribution and use in source and binary forms, with or without\r\n# modification, are permitted provided that",
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy",
        "": "Permission is hereby granted, free of charge, to any person obtaining a copy\n \t\nof this software and associated documentation files",
    }
    rows = documents([(i, f"First words.\n\n{t}\n\nLast words.", "s") for i, t in enumerate(texts.values())])
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(rows).collect()}
    assert got == dict(enumerate(texts))
