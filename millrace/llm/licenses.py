"""License scans by template-markup matching.

A template is wording with markup: <<beginOptional>> ... <<endOptional>> may be absent, and
<<var;name=...;max=N>> stands for 0 to N words.  It is compiled into an automaton over words; a
text matches where all mandatory words stand exactly, in order, with nothing else between.
Case, punctuation and white space don't count, as words are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._text import lean

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label, template
TEMPLATES = [
    ("mit", "<<beginOptional>>This <<var;name=what;max=3>> is<<endOptional>> <<var;name=verb;max=1>> under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=what;max=5>> and associated documentation files (the "<<var;name=noun;max=3>>"), to deal in the <<var;name=noun;max=3>> without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the <<var;name=noun;max=3>>, and to permit persons to whom the <<var;name=noun;max=3>> is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the <<var;name=noun;max=3>>.'),
    ("isc", "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;name=bullet;max=1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name=scheme;max=1>> www.apache.org/licenses/LICENSE-2.0<<endOptional>>"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("gpl-3.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License, version 3 <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>"),
    ("gpl-2.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License, version 2 <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>"),
    ("gpl", "<<var;name=what;max=4>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version <<var;name=version;max=1>> of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC 4.0 <<beginOptional>>International License<<endOptional>>"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-SA 4.0 <<beginOptional>>International License<<endOptional>>"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY 4.0 <<beginOptional>>International License<<endOptional>>"),
    ("cc0-1.0", "<<beginOptional>>CC0 1.0 Universal<<endOptional>> To the extent possible under law, <<var;name=who;max=8>> waived all copyright and related or neighboring rights to <<var;name=work;max=8>>."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

#: ASCII other than letters and digits parts words; A-Z are folded
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Automaton:
    """Word automaton of a template.  Edges: state -> word or any word (None) -> states."""

    def __init__(self, label: str, template: str):
        self.label, self.edges, self.skips, self.size = label, [{}], [set()], 1
        runs, run = [], []
        at, opened = 0, []
        for mark, body in re.findall(r"<<(.*?)>>|([^<]+|<)", template, re.S):
            if mark == "beginOptional":
                opened.append(at)
            elif mark == "endOptional":
                self.skips[opened.pop()].add(at)
            elif mark.startswith("var"):
                first = at
                for _ in range(int(re.search(r"max=(\d+)", mark)[1])):
                    at = self._add(at, None)
                    self.skips[first].add(at)
            else:
                for word in split_words(body):
                    at = self._add(at, word)
                    if not opened:
                        run.append(word)
            if mark:
                runs, run = [*runs, run], []
        if opened:
            raise ValueError(f"{label}: an optional region is not closed")
        self.final = at
        self.needed = b" " + b" ".join(max([*runs, run], key=len)) + b" "
        self.close = [self._closure(s) for s in range(self.size)]

    def _add(self, at: int, word: bytes | None) -> int:
        self.edges.append({})
        self.skips.append(set())
        self.edges[at].setdefault(word, set()).add(self.size)
        self.size += 1
        return self.size - 1

    def _closure(self, state: int) -> frozenset[int]:
        seen, left = {state}, [state]
        while left:
            for s in self.skips[left.pop()] - seen:
                seen.add(s)
                left.append(s)
        return frozenset(seen)

    def longest(self, words: list[bytes], start: int) -> int | None:
        """End of the longest match that begins at start."""
        states, end = set(self.close[0]), None
        for at in range(start, len(words)):
            word, after = words[at], set()
            for s in states:
                for key in (word, None):
                    for t in self.edges[s].get(key, ()):
                        after |= self.close[t]
            if not after:
                break
            states = after
            if self.final in states:
                end = at + 1
        return end

    def matches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Spans that don't overlap, leftmost and then longest first."""
        first = {w for s in self.close[0] for w in self.edges[s]}
        out, at = [], 0
        while at < len(words):
            end = self.longest(words, at) if None in first or words[at] in first else None
            if end:
                out.append((at, end))
            at = end or at + 1
        return out


def scan_text(text: str, phrases: list[tuple[bytes, list[bytes], str]], automata: list[Automaton]) -> tuple:
    """Number of words, places (label, start) of phrases, matches (label, start, end) of templates."""
    words = split_words(text)
    line = b" " + b" ".join(words) + b" "
    places, found = [], []
    for joined, parts, label in phrases:
        if joined in line:
            places += [(label, i) for i, w in enumerate(words) if w == parts[0] and words[i : i + len(parts)] == parts]
    for a in automata:
        if a.needed in line:  # the longest stretch of mandatory wording
            found += [(a.label, s, e) for s, e in a.matches(words)]
    return len(words), sorted(places, key=lambda x: (x[1], x[0])), sorted(found, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, places (label, start), matches (label, start, end), in words from 0.

    Null and empty texts have no words.  Ids may be null or repeat; each row stands by itself.
    """
    ship(docs.sparkSession)
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    match = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(b" " + b" ".join(split_words(p)) + b" ", split_words(p), label) for p, label in phrases.items()]
        automata = [Automaton(*t) for t in templates]
        for batch in batches:
            rows = [scan_text(t or "", wanted, automata) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"label": a, "start": b} for a, b in r[1]] for r in rows], place),
                    pa.array([[{"label": a, "start": b, "end": c} for a, b, c in r[2]] for r in rows], match),
                ],
                ["doc_id", "n_words", "places", "matches"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"doc_id {kind}, n_words long, places array<struct<label:string,start:long>>, matches array<struct<label:string,start:long,end:long>>")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: 1 if a template matches, 0.5 if there are base phrases only, else 0."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda x: F.expr(f"array_join(array_sort(array_distinct({x})), ',')")
    return found.select(
        "doc_id",
        "n_words",
        F.expr("CAST(size(places) AS bigint)").alias("n_base"),
        F.expr("array_min(places.start)").alias("first_word"),
        F.expr("array_max(places.start)").alias("last_word"),
        joined("places.label").alias("base_labels"),
        joined("concat(places.label, matches.label)").alias("labels"),
        F.expr("CASE WHEN size(matches) > 0 THEN 1D WHEN size(places) > 0 THEN 0.5D ELSE 0D END").alias("score"),
        F.expr("matches.start").alias("match_starts"),
        F.expr("matches.`end`").alias("match_ends"),
    )
