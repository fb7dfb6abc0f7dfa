"""License scans by a positional rare-token index, in built-in functions only.

Templates are short notices and whole licence texts.  The index maps the rarest words of every template
(highest inverse document frequency over the whole corpus) to postings (template, place).  A file's licence
words are looked up; a word at place ``i`` of the file and ``p`` of a template votes for a start at ``i - p``.
The votes of a file are sorted once, and starts with enough equal votes are verified: all mandatory key
phrases must stand at their places, and enough of the template's weight must be in place.  A base phrase
stands where its rarest word is and all others agree by relative position.

Postings, templates and weights are constants of the plan, of bounded size (``INDEX_WORDS``), and reach every
task with it.  Everything happens within a row: the scan shuffles nothing, so no file, word or licence can be
hot, and its work grows with the words and votes of a text (times the logarithm, for sorting), also in one
that repeats a notice very often.  Word statistics are summed per task before they meet.

Defined results
---------------
* null or empty text: no words, no places, empty labels, score 0;
* very long texts are read whole, all places count; a notice may begin before the text does;
* ties and repeated rows: every row is judged by itself; null ids are kept;
* an empty table gives an empty table; further columns are ignored, whatever their names;
* places of different phrases count each, overlapping or not; labels are distinct and sorted.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word pattern, the base phrases, and public licence wording, short and in full.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = [
    # label, wording, mandatory key phrases
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["free of charge", "obtaining a copy"]),
    ("mit-release", "released under the mit license", ["mit license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    ("gpl-terms", "you can redistribute it and or modify it under the terms of the gnu general public license", ["general public license"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("cc-by", "licensed under a creative commons attribution", ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]

LICENCES = [
    # label, text, mandatory key phrases
    (
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ["free of charge", "without restriction", "this permission notice shall be included"],
    ),
    (
        "isc-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
        ["with or without fee", "appear in all copies"],
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
        ["redistributions of source code", "redistributions in binary form"],
    ),
    (
        "bsd-3-clause",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
        ["endorse or promote products", "prior written permission"],
    ),
    (
        "bsd-disclaimer",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES""",
        ["copyright holders and contributors", "exemplary or consequential damages"],
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
        ["alter it and redistribute it freely", "must not be misrepresented"],
    ),
    (
        "apache-2.0-notice",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        ["apache license version 2 0", "except in compliance"],
    ),
    (
        "gpl-notice",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
        ["general public license as published", "free software foundation"],
    ),
    (
        "unlicense-text",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
        ["unencumbered software", "public domain"],
    ),
    (
        "boost-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so""",
        ["person or organization", "prepare derivative works"],
    ),
    (
        "wtfpl",
        """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is
        allowed as long as the name is changed.""",
        ["verbatim or modified copies", "as long as the name is changed"],
    ),
]

#: Rare words of a template that the index holds, the share of their postings that must agree on a start, the
#: share of a template's weight that must be in place, and words that all templates may have together.
RARE_WORDS, AGREEING, IN_PLACE, INDEX_WORDS = 8, 0.6, 0.7, 20_000
#: Votes are numbers: template << SHIFT, plus AHEAD, plus the start, which may be negative.
SHIFT, AHEAD = 40, 1 << 20
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split(text: str) -> list[str]:
    """Words of a template, which is ASCII."""
    return re.findall(r"[0-9a-z]+", text.lower())


@dataclass
class Template:
    label: str
    words: list[str]
    keys: list[tuple[int, int]]  # place and number of words of the mandatory phrases

    @classmethod
    def of(cls, label: str, text: str, phrases: list[str]) -> Template:
        words, keys = split(text), []
        for phrase in map(split, phrases):
            at = next((k for k in range(len(words)) if words[k : k + len(phrase)] == phrase), None)
            if at is None:
                raise ValueError(f"{label}: key phrase {' '.join(phrase)!r} is not in the text")
            keys.append((at, len(phrase)))
        return cls(label, words, keys)


@dataclass
class Index:
    weight: dict[str, float]  # inverse document frequency of the licence words
    phrases: dict[str, str]
    templates: list[Template]

    def rare(self, words: list[str]) -> list[str]:
        """Distinct words, rarest first."""
        return sorted(dict.fromkeys(words), key=lambda w: (-self.weight[w], w))

    def postings(self) -> dict[str, list[tuple[int, int]]]:
        """Template and place of every occurrence of a template's rarest words."""
        out: dict[str, list[tuple[int, int]]] = {}
        for t, template in enumerate(self.templates):
            rare = set(self.rare(template.words)[:RARE_WORDS])
            for place, w in enumerate(template.words):
                if w in rare:
                    out.setdefault(w, []).append((t, place))
        return out

    def needed(self) -> list[int]:
        """Votes that a start of each template needs."""
        n = [0] * len(self.templates)
        for places in self.postings().values():
            for t, _ in places:
                n[t] += 1
        return [math.ceil(AGREEING * k) for k in n]

    def keys(self) -> list[str]:
        """Words of which any file with a phrase or template holds one: the rarest of each phrase, and of the
        mandatory phrases of each template; fewest first, by greedy cover."""
        groups = [set(split(t)) for t in self.phrases] + [{t.words[k] for at, n in t.keys for k in range(at, at + n)} for t in self.templates]
        rarest = {min(g, key=lambda w: (-self.weight[w], -len(w), w)) for g in groups}
        chosen: list[str] = []
        while groups:
            best = max(sorted(rarest), key=lambda w: sum(w in g for g in groups))
            chosen.append(best)
            groups = [g for g in groups if best not in g]
        return chosen


def listed(pattern: str) -> str:
    """The same class with its ASCII ranges spelled out: Java finds single characters in a table, but asks range
    after range, for every character of a text."""
    return re.sub(r"\\x(..)-\\x(..)", lambda m: "".join(f"\\x{c:02X}" for c in range(int(m[1], 16), int(m[2], 16) + 1)), pattern)


def bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def lowered(text: Column) -> Column:
    """Lower case in which ASCII letters come from A-Z alone: the two other characters whose lower case has an
    ASCII letter, the Kelvin sign and the I with a dot, become other non-ASCII ones."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u212b")), F.lit("\u0130"), F.lit("\u0131")))


def words_of(text: Column) -> Column:
    """Words; those of ASCII alone are what A-Z to a-z makes of them."""
    return F.regexp_extract_all(lowered(F.coalesce(text.cast("string"), F.lit(""))), F.lit(listed(WORD)), F.lit(0))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def build_index(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] | None = None, notices: list | None = None) -> Index:
    """Counts, over all documents, how many hold each licence word; the vocabulary bounds the result."""
    phrases = PHRASES if phrases is None else phrases
    templates = [Template.of(*n) for n in (NOTICES + LICENCES if notices is None else notices)]
    if sum(len(t.words) for t in templates) > INDEX_WORDS:
        raise ValueError(f"templates of more than {INDEX_WORDS} words do not fit into a plan")
    vocabulary = sorted({w for p in phrases for w in split(p)} | {w for t in templates for w in t.words})
    found = docs.select(F.array_distinct(F.filter(words_of(F.col(f"`{text_col}`")), lambda w: w.isin(vocabulary))).alias("w"))
    counts = found.select(F.explode(F.array_append("w", "")).alias("w")).groupBy("w").count()
    n = {r["w"]: r["count"] for r in counts.collect()}  # one row per vocabulary word at most
    total = n.get("", 0)
    return Index({w: math.log((total + 1) / (n.get(w, 0) + 1)) + 1 for w in vocabulary}, phrases, templates)


def _phrase_starts(words: Column, hits: Column, index: Index, phrase: str) -> Column:
    """All places of a phrase: those of its rarest word where the other words agree by relative position."""
    parts = split(phrase)
    rarest = index.rare(parts)[0]
    at = parts.index(rarest)

    def agrees(h: Column) -> Column:
        out = h["w"] == rarest
        for k, w in enumerate(parts):
            if k != at:
                out = out & F.coalesce(F.get(words, h["i"] + (k - at)) == w, F.lit(False))
        return out

    return F.transform(F.filter(hits, agrees), lambda h: (h["i"] - at).cast("long"))


def _named(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda s: F.struct(F.lit(label).alias("label"), s.alias("start")))


def _voted(hits: Column, index: Index) -> Column:
    """Votes with enough equal ones, each once."""
    postings = index.postings()
    if not postings:
        return F.array().cast("array<bigint>")
    table = F.create_map(*[x for w, places in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.lit((t << SHIFT) + AHEAD - p).cast("long") for t, p in places]))])
    needed = F.array(*[F.lit(n) for n in index.needed()])
    votes = F.flatten(F.transform(F.filter(hits, lambda h: h["w"].isin(sorted(postings))), lambda h: F.transform(F.try_element_at(table, h["w"]), lambda x: x + h["i"])))

    def enough(v: Column) -> Column:
        return F.array_distinct(F.filter(v, lambda x, j: F.get(v, j - F.get(needed, F.shiftright(x, SHIFT).cast("int")) + 1) == x))

    return bind(F.array_sort(votes), enough)


def _verified(words: Column, voted: Column, index: Index) -> Column:
    """(template, share of the weight in place) of the votes whose start holds the template."""
    expected = F.array(*[_strings(t.words) for t in index.templates])
    weights = F.array(*[F.array(*[F.lit(index.weight[w] / sum(index.weight[x] for x in t.words)) for w in t.words]) for t in index.templates])
    key = "array<struct<at:int,n:int>>"
    keys = F.array(*[F.array(*[F.struct(F.lit(a).alias("at"), F.lit(n).alias("n")) for a, n in t.keys]) if t.keys else F.array().cast(key) for t in index.templates])

    def one(vote: Column) -> Column:
        t, start = F.shiftright(vote, SHIFT).cast("int"), (vote.bitwiseAND((1 << SHIFT) - 1) - AHEAD).cast("int")

        def check(x: Column) -> Column:
            def same(k: Column) -> Column:
                return F.coalesce(F.get(words, x["s"] + k) == F.get(x["e"], k), F.lit(False))

            whole = F.forall(x["k"], lambda p: F.forall(F.sequence(p["at"], p["at"] + p["n"] - 1), same))
            share = F.aggregate(F.sequence(F.lit(0), F.size(x["e"]) - 1), F.lit(0.0), lambda a, k: a + F.when(same(k), F.get(x["g"], k)).otherwise(0.0))
            return F.struct(x["t"].alias("t"), F.when(whole, share).otherwise(0.0).alias("share"))

        return bind(F.struct(t.alias("t"), start.alias("s"), F.get(expected, t).alias("e"), F.get(weights, t).alias("g"), F.get(keys, t).alias("k")), check)

    return F.filter(F.transform(voted, one), lambda x: x["share"] >= IN_PLACE)


def scan_licenses(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and places (label, start)."""
    vocabulary = sorted({w for p in index.phrases for w in split(p)} | set(index.postings()))
    labels = _strings([t.label for t in index.templates])

    def look(words: Column) -> Column:
        def found(hits: Column) -> Column:
            base = F.concat(*[_named(_phrase_starts(words, hits, index, p), label) for p, label in index.phrases.items()])
            return F.struct(base.alias("base"), _verified(words, _voted(hits, index), index).alias("notices"))

        known = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(vocabulary))
        # a cheap test that no file with a phrase or template fails; only what passes is looked up
        maybe = F.arrays_overlap(words, _strings(index.keys()))
        return F.struct(F.size(words).cast("long").alias("n"), F.when(maybe, bind(known, found)).alias("found"))

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), bind(words_of(F.col(f"`{text_col}`")), look).alias("seen"))
    rows = rows.select("doc_id", F.col("seen.n").alias("n_words"), F.col("seen.found.base").alias("base"), F.col("seen.found.notices").alias("notices"))
    empty = F.array().cast("array<string>")
    base_labels = F.coalesce(F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))), empty)
    more = F.coalesce(F.transform("notices", lambda x: F.get(labels, x["t"])), empty)
    starts = F.transform("base", lambda b: b["start"])
    score = F.greatest(F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("notices", lambda x: x["share"])), F.lit(0.0)))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, more))), ",").alias("labels"),
        F.least(score, F.lit(1.0)).alias("score"),
        F.coalesce("base", F.array().cast("array<struct<label:string,start:bigint>>")).alias("places"),
    )
