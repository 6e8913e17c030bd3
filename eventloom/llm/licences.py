"""Licence scans with a positional index of rare words.

Templates are texts and notices of licences; an index holds every word of theirs with its positions. How rare a word is
comes from its document frequency over the whole corpus. A file looks its licence words up, the highest IDF first, until
each template has had ``rare`` of them; their postings are intersected by relative position: a word at place a of the file
and i of the template speaks for a start at a - i. Starts within a template's tolerance (a word or more inserted, left
out or changed) count together, and a start that gathers enough of the template's rare weight is verified: each mandatory
key phrase must stand in the stretch that the template would cover. Base phrases are found everywhere beside that.

Defined cases: null texts are empty; an empty text has no words, no places and score 0; an empty table gives no rows;
repeated rows stay; columns besides key and text are passed over; ties go to the earlier start.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, arrow_map, bounded, table

#: Words of UTF-8 texts: A-Z are lower-cased, every other ASCII byte but a-z and 0-9 parts words.
FORM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Label, mandatory key phrases, template.
TEMPLATES = (
    ("mit", ("mit license",), "released under the mit license"),
    ("mit", ("permission is hereby granted free of charge", "without restriction"), """permission is hereby granted free of charge to any person obtaining a copy
    of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy
    modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
    following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"""),
    ("apache-2.0", ("apache license version 2",), "licensed under the apache license version 2 0"),
    ("apache-2.0", ("apache license version 2 0", "except in compliance with the license"), """licensed under the apache license version 2 0 the license you may not use
    this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law
    or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or
    implied see the license for the specific language governing permissions and limitations under the license"""),
    ("gpl-3.0", ("gnu general public license version 3",), "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", ("general public license version 3",), "gnu general public license version 3"),
    ("gpl-3.0", ("gnu general public license", "version 3 of the license"), """this program is free software you can redistribute it and or modify it under the terms of the gnu
    general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed
    in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"""),
    ("gpl-2.0", ("general public license version 2",), "gnu general public license version 2"),
    ("gpl-2.0", ("gnu general public license", "version 2 of the license"), """this program is free software you can redistribute it and or modify it under the terms of the gnu
    general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed
    in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"""),
    ("lgpl", ("lesser general public license",), "gnu lesser general public license"),
    ("lgpl", ("gnu lesser general public license", "free software foundation"), """this library is free software you can redistribute it and or modify it under the terms of the gnu
    lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"""),
    ("agpl", ("affero general public license",), "gnu affero general public license"),
    ("agpl", ("gnu affero general public license", "free software foundation"), """this program is free software you can redistribute it and or modify it under the terms of the
    gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"""),
    ("cc-by-nc-4.0", ("cc by nc 4",), "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", ("cc by sa 4",), "licensed under cc by sa 4 0"),
    ("cc-by-4.0", ("cc by 4",), "licensed under cc by 4 0"),
    ("cc-by-4.0", ("creative commons attribution 4 0",), "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", ("creative commons attribution sharealike 4 0",), "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", ("creative commons attribution noncommercial 4 0",), "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", ("public domain dedication",), "cc0 1 0 universal public domain dedication"),
    ("bsd", ("source and binary forms", "are permitted"), """redistribution and use in source and binary forms with or without modification are permitted"""),
    ("bsd-2-clause", ("source and binary forms", "retain the above copyright notice", "binary form must reproduce"), """redistribution and use in source and binary forms with or
    without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list
    of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
    disclaimer in the documentation and or other materials provided with the distribution"""),
    ("bsd-3-clause", ("neither the name", "endorse or promote products"), """neither the name of the copyright holder nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission"""),
    ("mpl-2.0", ("mozilla public license",), """this source code form is subject to the terms of the mozilla public license v 2 0"""),
    ("mpl-2.0", ("mozilla public license", "a copy of the mpl"), """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
    distributed with this file you can obtain one at https mozilla org mpl 2 0"""),
    ("isc", ("for any purpose with or without fee",), """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
    provided that the above copyright notice and this permission notice appear in all copies"""),
    ("unlicense", ("unencumbered software",), """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
    distribute this software"""),
    ("zlib", ("held liable for any damages arising from the use of this software", "alter it and redistribute it freely"), """this software is provided as is without any express
    or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this
    software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"""),
    ("bsl-1.0", ("any person or organization obtaining a copy",), """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and
    accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"""),
    ("proprietary", ("all rights reserved",), "all rights reserved"),
)
FORMS = tuple([w.encode() for w in text.split()] for _, _, text in TEMPLATES)
KEYS = tuple([tuple(w.encode() for w in key.split()) for key in keys] for _, keys, _ in TEMPLATES)
VOCABULARY = frozenset(w for form in FORMS for w in form)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FORM).split()


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Rows, and for each word of the fixed licence vocabulary the rows that hold it, over all of ``docs``."""

    def rows(batches):
        n, seen = 0, dict.fromkeys(VOCABULARY, 0)
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                for t in b.column(0).slice(at, SLICE_ROWS).to_pylist():
                    n += 1
                    for w in VOCABULARY.intersection(words_of(t)):
                        seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    got = {bytes(r.word): r.n for r in bounded(docs).select(text).mapInArrow(rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop(b"", 0), got


class Index:
    """Postings of all words of the templates, and what a file must gather of each template's ``rare`` rarest ones."""

    def __init__(self, n: int, df: dict[bytes, int], rare: int = 8, share: float = 0.6):
        self.idf = {w: max(0.01, math.log((n + 1) / (df.get(w, 0) + 0.5))) for w in VOCABULARY}
        self.rare, self.postings = rare, {}
        self.least, self.slack, self.weight = [], [], []
        for k, form in enumerate(FORMS):
            weights = sorted((self.idf[w] for w in set(form)), reverse=True)
            self.least.append(share * sum(weights[:rare]))
            self.weight.append(sum(weights))
            self.slack.append(len(form) // 12 + (len(form) > 5))
            for i, w in enumerate(form):
                self.postings.setdefault(w, {}).setdefault(k, []).append(i)

    def matches(self, words: list[bytes]) -> list[tuple[str, float, int]]:
        """(label, share of the template's weight found in place, start) of each verified start, in order."""
        known = VOCABULARY.intersection(words)
        if not known:
            return []
        looked: dict[int, list[bytes]] = {}
        gain: dict[int, float] = {}
        for w in sorted(known, key=lambda w: (-self.idf[w], w)):
            for k in self.postings[w]:
                if len(mine := looked.setdefault(k, [])) < self.rare:
                    mine.append(w)
                    gain[k] = gain.get(k, 0.0) + self.idf[w]
        live = [k for k in looked if gain[k] >= self.least[k]]
        if not live:
            return []
        wanted = {w for k in live for w in looked[k]}
        places: dict[bytes, list[int]] = {}
        for at, w in enumerate(words):
            if w in wanted:
                places.setdefault(w, []).append(at)
        out = []
        for k in live:
            votes = sorted((a - i, w) for w in looked[k] for a in places[w] for i in self.postings[w][k])
            out += self._verified(k, votes, words)
        return sorted(out, key=lambda m: (m[2], m[0]))

    def _verified(self, k: int, votes: list[tuple[int, bytes]], words: list[bytes]):
        """Starts whose votes within the template's slack weigh enough and whose stretch holds the key phrases."""
        form, slack, lo, total = FORMS[k], self.slack[k], 0, 0.0
        held: dict[bytes, int] = {}
        after = None
        for start, w in votes:
            held[w] = held.get(w, 0) + 1
            total += self.idf[w] if held[w] == 1 else 0.0
            while votes[lo][0] < start - slack:
                old = votes[lo][1]
                held[old] -= 1
                total -= self.idf[old] if held[old] == 0 else 0.0
                lo += 1
            if total < self.least[k] - 1e-9 or after is not None and start < after:
                continue
            begin = max(0, votes[lo][0])
            here = words[begin : begin + len(form) + slack]
            if all(_stands(key, here) for key in KEYS[k]):
                placed = sum(self.idf[x] for x in set(form).intersection(here))
                yield TEMPLATES[k][0], min(1.0, placed / self.weight[k]), begin
                after = begin + len(form)


def _stands(phrase: tuple[bytes, ...], words: list[bytes]) -> bool:
    return any(words[i] == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase for i in range(len(words) - len(phrase) + 1))


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place of a base phrase, in order."""
    out = []
    for phrase, label in BASE:
        form = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(form[-1], at + 1)
            except ValueError:
                break
            if at >= len(form) - 1 and words[at - len(form) + 1 : at + 1] == form:
                out.append((at - len(form) + 1, label))
    return sorted(out)


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, COLUMNS. ``score`` is the best template's share in place; a base place alone gives 0.5."""
    index = Index(*document_frequency(docs, text))

    def rows(columns):
        for i, t in zip(*columns, strict=True):
            words = words_of(t)
            base = base_places(words)
            found = index.matches(words)
            own = {label for _, label in base}
            score = max([0.5 * bool(base), *(s for _, s, _ in found)])
            yield i, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | {x for x, _, _ in found})), float(score)

    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
    return arrow_map(docs.select(F.col(key).cast("long"), text), rows, f"{key} long, {COLUMNS}", [key, *(c.split()[0] for c in COLUMNS.split(", "))], kinds)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
