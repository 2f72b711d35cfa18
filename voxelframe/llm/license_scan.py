"""Licence scans by sentence rules, with DataFrame functions only.

A text is normalised (runs of characters other than ASCII letters, digits, `.!?;:` and line feeds become one blank;
lower case).  Known licence sentences are found in it between borders: line feeds, and `.!?;:` before a blank.  A
single line feed, with the mark of a comment or without, may also stand for a blank inside a sentence, so wrapped
licences and headers count; where several known sentences begin, the longest is taken.  The identifiers found, in
text order, are matched against ordered rules: a rule holds if its identifiers occur in its order, with others between
them or not.  The first rule that holds gives the primary licence.  One narrow pass over the text: no shuffle, no join.

Defined cases: null and empty texts have no known sentence and no licence; a sentence that occurs twice is listed
twice; repeated rows get equal results; other columns pass through, whatever their
names, except that an input column with the name of a new one is replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import kept, spare

#: Known sentences, as they are written in the licences and in usual notices.
SENTENCES = (
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("mit-notice", "This project is licensed under the MIT License."),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-title", "MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("as-is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("apache-condition", "you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-as-is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3-notice", "Licensed under the GNU General Public License, version 3."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"),
    ("gpl2-version", "either version 2 of the License, or (at your option) any later version."),
    ("gpl2-only", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("gpl3-version", "either version 3 of the License, or (at your option) any later version."),
    ("lgpl-terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"),
    ("lgpl21-version", "either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl3-free", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl3-free", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-notice", "Licensed under CC BY 4.0."),
    ("cc-by-sa-notice", "Licensed under CC BY-SA 4.0."),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("mpl2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("epl2-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("reserved", "All rights reserved."),
)
#: Licence and the identifiers that show it, in order; earlier rules come first.
RULES = (
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-header", "apache-condition", "apache-copy")),
    ("GPL-3.0", ("gpl-free", "gpl-hope")),
    ("GPL-3.0", ("gpl-terms", "gpl3-version")),
    ("GPL-2.0", ("gpl-terms", "gpl2-version")),
    ("GPL-2.0", ("gpl2-only",)),
    ("LGPL-2.1", ("lgpl-terms", "lgpl21-version")),
    ("LGPL-3.0", ("lgpl-terms", "gpl3-version")),
    ("LGPL-3.0", ("lgpl3-free",)),
    ("AGPL-3.0", ("agpl3-free",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("Unlicense", ("unlicense",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("MIT", ("mit-title", "mit-grant")),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("all rights reserved", ("reserved",)),
)
#: A later rule's licence is not listed if one of these holds: the longer licence implies the shorter.
IMPLIED = {"BSD-2-Clause": "BSD-3-Clause"}
FOREIGN = r"[^A-Za-z0-9.!?;:\n]+"
BORDER = r"\n|[.!?;:] "
EDGE = " .!?;:"
#: Marks of comments at the begin of a line that normalising leaves.
COMMENT = r"(^|\n) ?(?:[;!]+ ?|(?:dnl|rem)(?: |(?=\n|\z)))"
#: A blank inside a sentence: at most one line feed, for an empty line ends a sentence.
WRAP = r" ?\n ?"
NAMES = ("n_known_sentences", "sentence_ids", "licenses", "primary_license")


def normalised(sentence: str) -> list[str]:
    """The sentences of a string as the scan sees them; for the tables of this module."""
    return [p for s in re.split(BORDER, re.sub(FOREIGN, " ", sentence).lower()) if (p := s.strip(EDGE))]


def sentence_table(known: tuple = SENTENCES) -> dict[str, str]:
    """Identifier by normalised sentence; one that holds several sentences is known by its longest."""
    return {max(normalised(text), key=len): name for name, text in known}


def sentences_of(text: Column, known: list[str]) -> Column:
    """Those of the normalised `known` sentences that a text holds, in text order."""
    flat = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), FOREIGN, " "))
    # a bar, which no normalised text holds, for each sentence end and what follows it: the pattern below stays linear
    flat = F.regexp_replace(F.regexp_replace(flat, COMMENT, "$1"), r"[.!?;:] [ .!?;:]*+", "|")
    either = "|".join(f"(?: |{WRAP})".join(map(re.escape, s.split(" "))) for s in sorted(known, key=len, reverse=True)) or "(?!)"
    pattern = rf"(?:^|[|\n])[ .!?;:]*+({either})(?=[ .!?;:]*+(?:[|\n]|\z))"
    return F.transform(F.regexp_extract_all(flat, F.lit(pattern), F.lit(1)), lambda s: F.regexp_replace(s, WRAP, " "))


def scan(docs: DataFrame, text_col: str = "text", known: tuple = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """`docs` with n_known_sentences, sentence_ids and licenses (joined by blanks and by commas) and primary_license ('' if none)."""
    ids = sentence_table(known)
    mark, own = spare(docs, "license_found", *NAMES), kept(docs, NAMES)
    lookup = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    found = docs.select(*own, sentences_of(F.col(f"`{text_col}`"), list(ids)).alias(mark))
    named = found.select(*own, F.size(mark).cast("long").alias(NAMES[0]), F.array_join(F.transform(mark, lambda s: F.element_at(lookup, s)), " ").alias(NAMES[1]))
    line = F.concat(F.lit(" "), F.replace(F.col(NAMES[1]), F.lit(" "), F.lit("  ")), F.lit(" "))
    holds = lambda seq: line.like("%" + "%".join(f" {i} " for i in seq) + "%")
    by_name: dict[str, Column] = {}
    for name, seq in rules:
        by_name[name] = by_name[name] | holds(seq) if name in by_name else holds(seq)
    for short, longer in IMPLIED.items():
        if short in by_name and longer in by_name:
            by_name[short] = by_name[short] & ~by_name[longer]
    listed = F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in by_name.items()])
    first = F.coalesce(*[F.when(holds(seq), F.lit(name)) for name, seq in rules], F.lit(""))
    return named.select(*own, NAMES[0], NAMES[1], listed.alias(NAMES[2]), first.alias(NAMES[3]))


def sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The same scan for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ids = sentence_table()
    keys, values = ", ".join(map(quote, ids)), ", ".join(map(quote, ids.values()))
    holds = lambda seq: "line LIKE " + quote("%" + "%".join(f" {i} " for i in seq) + "%")
    by_name: dict[str, list[str]] = {}
    for name, seq in RULES:
        by_name.setdefault(name, []).append(holds(seq))
    cond = {n: "(" + " OR ".join(c) + ")" for n, c in by_name.items()}
    for short, longer in IMPLIED.items():
        cond[short] = f"({cond[short]} AND NOT {cond[longer]})"
    listed = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN {quote(n)} END" for n, c in cond.items()) + ")"
    first = "CASE " + " ".join(f"WHEN {holds(seq)} THEN {quote(n)}" for n, seq in RULES) + " ELSE '' END"
    # RE2 looks at nothing without taking it, so line feeds and bars are doubled: a sentence takes the inner halves
    steps = (
        ("[^A-Za-z0-9.!?;:\n]+", " "),
        ("\n", "\n\n"),
        ("(^|\n) ?(?:dnl|rem)(\n|$)", r"\1\2"),
        ("(^|\n) ?(?:[;!]+ ?|(?:dnl|rem) )", r"\1"),
        ("[.!?;:] [ .!?;:]*", "||"),
    )
    flat = f"coalesce({text_col}, '')"
    for i, (pattern, new) in enumerate(steps):
        flat = f"regexp_replace({flat}, {quote(pattern)}, {quote(new)}, 'g')"
        flat = flat if i else f"lower({flat})"
    either = "|".join("(?: | ?\n\n ?)".join(w.replace(".", "[.]").replace("?", "[?]") for w in x.split(" ")) for x in sorted(ids, key=len, reverse=True))
    found = f"regexp_extract_all('|' || {flat} || '|', {quote(f'[|' + chr(10) + '][ .!?;:]*(' + either + ')[ .!?;:]*[|' + chr(10) + ']')}, 1)"
    return f"""
WITH found AS (SELECT {id_col}, list_transform({found}, lambda s: regexp_replace(s, {quote(" ?" + chr(10) * 2 + " ?")}, ' ', 'g')) AS f FROM {table}),
named AS (SELECT {id_col}, len(f) AS n_known_sentences, coalesce(array_to_string(list_transform(f, lambda s: [{values}][list_position([{keys}], s)]), ' '), '') AS sentence_ids FROM found),
lined AS (SELECT *, ' ' || replace(sentence_ids, ' ', '  ') || ' ' AS line FROM named)
SELECT {id_col}, n_known_sentences::bigint AS n_known_sentences, sentence_ids, {listed} AS licenses, {first} AS primary_license FROM lined"""
