"""License scan: TF-IDF cosine to templates, then inheritance from directories.

Passages around licence cues of a whole text become sparse TF-IDF vectors and
are compared with templates of notices; the inverse document frequencies of the
templates' words are counted over all documents. A licence file is told by the
title at its head, else as a whole by the full texts in ``licence_texts``, else
by its passages and as a whole by the notices, whichever is best. The first
SPDX line of a text goes before all of these. A document
without a licence of its own takes that of the licence file in its nearest
ancestor directory, found by joins on the distinct directories of the corpus.

Defined cases: null and empty texts have no licence of their own and inherit;
a null path has no directory; equal scores go to the template named first;
reserved rights count only where no licence is found; an SPDX line's score is 1
and its licence the expression, ids spelt as here (several ids joined by AND, OR
or WITH); an SPDX line with an unknown id is no SPDX line; of
several licence files in a directory the best score, then the shortest path
decides; texts of any length are read whole, cue by cue; repeated rows get the
same answer; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import stored, words_of

#: Licence id and short notices and headers as their stewards recommend them. Fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal, public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
)
RESERVED = "LicenseRef-All-Rights-Reserved"
#: Licence id and the whole title of its text: licences whose texts are much alike.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-1.0", "GNU General Public License Version 1, February 1989"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *((i, f"{lead}{kind} 4.0 International{end}")
      for i, kind in (("CC-BY-4.0", "Attribution"), ("CC-BY-SA-4.0", "Attribution-ShareAlike"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"), ("CC-BY-ND-4.0", "Attribution-NoDerivatives"), ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike"), ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives"))
      for lead in ("", "Creative Commons ") for end in ("", " Public License")),
)
#: A title is one to three of so many lines with words at a file's head.
HEAD = 6
THRESHOLD = 0.6
#: Reserved rights are a phrase of prose, too: their sentence must say little else.
RESERVED_THRESHOLD = 0.9
#: Whole files are held to more against full texts, as these share much of their language.
FULL_THRESHOLD = 0.9
#: Directories with a licence are broadcast up to so many bytes; beyond, files are dealt over so many parts of a directory.
BROADCAST_BYTES, SALT = 16 << 20, 32
#: A document whose licence passages hold this share of its words is a licence file.
FILE_SHARE = 0.9

#: Further SPDX ids that a header may name.
SPDX_IDS = (
    "0BSD AFL-3.0 AGPL-1.0 Apache-1.0 Apache-1.1 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-3-Clause-Clear BSD-4-Clause BSD-Source-Code "
    "bzip2-1.0.6 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-SA-3.0 CC-PDDC CDDL-1.0 CDDL-1.1 "
    "CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-2.1 CECILL-B CECILL-C CPL-1.0 curl ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL "
    "GFDL-1.1 HPND ICU IJG ImageMagick IPL-1.0 JSON Libpng libpng-2.0 libtiff MIT-0 MIT-CMU MPL-1.0 MS-PL MS-RL MulanPSL-2.0 NPL-1.1 OpenSSL OSL-3.0 ODbL-1.0 ODC-By-1.0 OGL-UK-3.0 OLDAP-2.8 "
    "PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 TCL Unicode-DFS-2016 UPL-1.0 Vim W3C WTFPL X11 Zend-2.0 Zlib ZPL-2.1 "
    "Autoconf-exception-3.0 Bison-exception-2.2 Classpath-exception-2.0 Font-exception-2.0 GCC-exception-3.1 Linux-syscall-note LLVM-exception OpenSSL-exception"
).split()

_CUE = re.compile(r"\b(?:licen[sc]|copyright\b|all rights reserved|public domain|spdx-|permission is hereby|permission is granted|permission to use|redistribution and use|free software|source code form)", re.I)
_SENTENCE = re.compile(r"(?<=[.!?]) +(?=[^\W\d_])")
_FILE = re.compile(r"(?i)(^|/)(licen[sc]es?|copying|unlicense|notice)([.-][a-z0-9.-]*)?$")


def bag(text: str) -> Counter:
    return Counter(words_of(text))


class Templates:
    """Template vectors for given document frequencies."""

    def __init__(self, df: dict[bytes, int], documents: int, templates=TEMPLATES, full=None):
        full = full_texts() if full is None else full
        self.full = Templates(df, documents, full, ()) if full else None
        self.names = [n for n, _ in templates]
        self.longest = max((len(t.split()) for _, t in templates), default=0)
        self.idf = {w: math.log((documents + 1) / (df.get(w, 0) + 1)) + 1 for _, t in templates for w in bag(t)}
        self.other = math.log(documents + 1) + 1
        self.postings: dict[bytes, list[tuple[int, float]]] = {}
        for i, (_, t) in enumerate(templates):
            weights = {w: n * self.idf[w] for w, n in bag(t).items()}
            norm = math.sqrt(sum(x * x for x in weights.values()))
            for w, x in weights.items():
                self.postings.setdefault(w, []).append((i, x / norm))

    def best(self, words: Counter) -> tuple[str | None, float]:
        """The nearest template's licence and cosine."""
        dots, norm = [0.0] * len(self.names), 0.0
        for w, n in words.items():
            x = n * self.idf.get(w, self.other)
            norm += x * x
            for i, y in self.postings.get(w, ()):
                dots[i] += x * y
        if not norm:
            return None, 0.0
        top = max(range(len(dots)), key=lambda i: (round(dots[i], 12), -i))
        return self.names[top], min(1.0, dots[top] / math.sqrt(norm))


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """Licence id and full text of each file in ``licence_texts``."""
    return tuple((f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))


def vocabulary(templates=None) -> frozenset[bytes]:
    return frozenset(w for _, t in (TEMPLATES + full_texts() if templates is None else templates) for w in bag(t))


_TITLES = {frozenset(bag(t).items()): i for i, t in TITLES}


_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.I)
_SPDX_PART = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.:-]*\+?")
_IDS = {i.lower(): i for i in (*SPDX_IDS, *(n for n, _ in TEMPLATES + TITLES + full_texts()))}


def spdx_id(part: str) -> str | None:
    """An id as it is spelt here; later versions and this one only are one licence here."""
    if re.fullmatch(r"(?:DocumentRef-[A-Za-z0-9.-]+:)?LicenseRef-[A-Za-z0-9.-]+", part):
        return part
    low = part.lower().removesuffix("+")
    return _IDS.get(low) or _IDS.get(low.removesuffix("-only").removesuffix("-or-later"))


def declared(text: str) -> tuple[str, str] | None:
    """Licence expression of the first SPDX line that has a valid one, and what it is in the text."""
    for m in _SPDX.finditer(text):
        out: list[str] = []
        depth, want, end, fits = 0, True, 0, 0
        for p in _SPDX_PART.finditer(m[1]):
            if m[1][end : p.start()].strip():
                break
            word = p[0]
            if word == "(" and want:
                depth += 1
            elif word == ")" and not want and depth:
                depth -= 1
            elif not want and word.upper() in ("AND", "OR", "WITH"):
                word, want = f" {word.upper()} ", True
            elif want and (known := spdx_id(word)):
                word, want = known, False
            else:
                break
            out.append(word)
            end = p.end()
            if not want and not depth:
                fits = len(out)
        # An operator without its second id, or an open bracket, makes no expression.
        if fits and fits == len(out):
            return "".join(out), m[0][: m.start(1) - m.start() + end]
    return None


def title(text: str) -> str | None:
    """The licence whose title stands at the head of a text."""
    lines = [w for line in text.split("\n") if (w := words_of(line))][:HEAD]
    for i in range(len(lines)):
        for k in range(1, 4):
            if found := _TITLES.get(frozenset(Counter(sum(lines[i : i + k], [])).items())):
                return found
    return None


def passages(text: str, most: int):
    """What is compared at each licence cue of a whole text: its sentence, its line,
    and the lines from it on, in windows that double up to ``most`` words, the
    longest template's: what a longer window adds is no part of a notice."""
    if not _CUE.search(text):
        return
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if not _CUE.search(line):
            continue
        for s in _SENTENCE.split(line):
            if _CUE.search(s):
                yield s
        yield line
        held, n, want = [line], len(line.split()), 8
        for after in lines[i + 1 :]:
            if n >= most:
                break
            held.append(after)
            n += len(after.split())
            if n >= want:
                yield "\n".join(held)
                while want <= n:
                    want *= 2
        if len(held) > 1:
            yield "\n".join(held)


def own_licence(text: str | None, is_file: bool, templates: Templates, threshold: float = THRESHOLD) -> tuple[str | None, float, bool]:
    """Licence of a text itself, its score, and whether the text is little else."""
    if not text:
        return None, 0.0, False
    if found := declared(text):
        return found[0], 1.0, is_file or len(found[1].split()) >= FILE_SHARE * len(text.split())
    if is_file:
        if name := title(text):
            return name, 1.0, True
        if templates.full:
            name, s = templates.full.best(bag(text))
            if s >= FULL_THRESHOLD:
                return name, s, True
    found, score, share = None, 0.0, 0
    for p in ([text, *passages(text, templates.longest)] if is_file else passages(text, templates.longest)):
        name, s = templates.best(bag(p))
        if name == RESERVED and s < RESERVED_THRESHOLD:
            continue
        # Any licence goes before reserved rights, which most notices mention as well.
        known, before = ((n is not None and n != RESERVED and x >= threshold) for n, x in ((name, s), (found, score)))
        if (known, s) > (before, score):
            found, score, share = name, s, len(p.split())
    if score < threshold:
        return None, score, False
    return found, score, is_file or share >= FILE_SHARE * len(text.split())


def frequencies(documents: DataFrame, text_col: str = "text", templates=None) -> tuple[dict[bytes, int], int]:
    """Documents that hold each template word, and all documents: sums before the shuffle, a row a word to the driver."""
    words = vocabulary(templates)

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            total[b""] += batch.num_rows
            for t in batch.column(0):
                total.update(words.intersection(words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    got = documents.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in got}
    return counts, counts.pop(b"", 0)


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, own_license, own_score, license, license_from (a directory, or
    null for its own) and how (own, inherited, none) of every row."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(Templates(*frequencies(documents, text_col)))

    def run(batches):
        t = shared.value
        for batch in batches:
            rows = []
            for text, path in zip(batch.column(1), batch.column(2), strict=True):
                text, path = text.as_py(), path.as_py()
                by_name = bool(path and _FILE.search(path))
                rows.append((*own_licence(text, by_name, t, threshold), by_name))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            is_file = [bool(n and (a or b)) for n, _, a, b in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(is_file, pa.bool_())], names=["doc_id", "path", "own_license", "own_score", "is_file"])

    kind = documents.schema[id_col].dataType.simpleString()
    own = documents.select(id_col, text_col, F.col(path_col).cast("string")).mapInArrow(run, f"doc_id {kind}, path string, own_license string, own_score double, is_file boolean")
    own = stored(own.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "licences")
    return inherited(own)


def inherited(own: DataFrame) -> DataFrame:
    """Rows (doc_id, path, dir, own_license, own_score, is_file) with what they
    inherit from the nearest ancestor directory that has a licence file."""
    # One licence a directory that has licence files.
    best = F.max_by("own_license", F.struct(F.col("own_score"), -F.length("path"), F.xxhash64("path"))).alias("found")
    by_dir = own.where("is_file").groupBy(F.col("dir").alias("of")).agg(best)
    # Ancestors of the distinct directories only, so a large directory costs one row.
    dirs = own.where("path IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, k), "/")))).alias("of")).distinct()
    nearest = above.join(by_dir, "of").groupBy("dir").agg(F.max_by(F.struct("of", "found"), F.length("of")).alias("n"))
    nearest = stored(nearest.select("dir", F.col("n.of").alias("of"), F.col("n.found").alias("found")), "directories")
    r = nearest.agg(F.count("*").alias("n"), F.sum(F.length("dir") + F.length("of") + F.length("found") + 96).alias("bytes")).first()
    if (r["bytes"] or 0) <= BROADCAST_BYTES:
        out = own.join(F.broadcast(nearest), "dir", "left")
    else:
        # A directory may hold very many files: they are dealt over SALT parts, of which each gets the directory's row.
        salt = F.pmod(F.xxhash64("path", "doc_id"), F.lit(SALT)).alias("salt")
        out = own.select("*", salt).join(nearest.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt")), ["dir", "salt"], "left")
    none = F.col("own_license").isNull()
    inherits = none & F.col("path").isNotNull() & F.col("found").isNotNull()
    return out.select(
        "doc_id", "path", "own_license", "own_score",
        F.coalesce("own_license", F.when(inherits, F.col("found"))).alias("license"),
        F.when(inherits, F.col("of")).alias("license_from"),
        F.when(~none, "own").when(inherits, "inherited").otherwise("none").alias("how"),
    )
