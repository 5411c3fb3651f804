"""Licence scan by a positional rare-token index.

The templates are licence texts and notices. A first pass counts in how many documents of the corpus each of the templates' words
stands (a few hundred counts); that gives the inverse document frequencies. The index holds the postings (template, position)
of each template's highest-IDF words. A file's occurrences of these are looked up, and each implies an origin (position in the file
less position in the template). Origins at which the postings agree are intersected by relative position into candidates,
and a candidate counts if the template's mandatory key phrase stands at its place. Beside these, the base phrases are found where their
words stand consecutively.

`score` is the largest share of a counted template's words that stand in their places, or 1 where a base phrase stands,
else 0. Defined results: a null or empty text has no words, empty labels, null places and score 0; words of equal IDF are taken
longer ones first, then by the alphabet; repeated rows each get their row; an empty table gives an empty result. Documents are
scanned whole, one by one, in bounded memory.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table
from .textnum import Words, blocks, texts

#: Phrase, label.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Label, text of the licence or notice, mandatory key phrase in it. In lower case, without punctuation.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache license version 2"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses", "terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "procurement of substitute goods or services"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software", "alter it and redistribute it freely"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so", "person or organization obtaining a copy of the software and accompanying documentation"),
]
RARE = 4  # words of each template that are looked up
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Index:
    """df: in how many of n documents each word of the templates stands; without it, in how many templates."""

    def __init__(self, templates=TEMPLATES, base=BASE, df: dict[str, int] | None = None, n: int = 0):
        self.templates = [(label, text.split(), key.split()) for label, text, key in templates]
        self.base = [(phrase.split(), label) for phrase, label in base]
        if df is None:
            df, n = Counter(w for _, words, _ in self.templates for w in set(words)), len(self.templates)
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in vocabulary(templates, base)}
        rank = lambda w: (-self.idf[w], -len(w), w)
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.offset = []  # of the key phrase in its template
        for t, (_, words, key) in enumerate(self.templates):
            rare = sorted(set(words), key=rank)[:RARE]
            self.offset.append(next(i for i in range(len(words)) if words[i : i + len(key)] == key))
            for k, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((t, k))
        #: A text without any of these has no phrase and no candidate: each base phrase's and key phrase's rarest word.
        rarest = lambda words: min(words, key=rank)
        self.anchors = sorted({rarest(key) for _, _, key in self.templates} | {rarest(words) for words, _ in self.base})
        self.anchored = re.compile("|".join(map(re.escape, sorted(self.anchors, key=len, reverse=True))).encode())

    def scan(self, words: list[str]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Base places (word, label), and the best share of each label that the templates give."""
        at: dict[str, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            at[w].append(k)
        stands = lambda phrase, k: k >= 0 and words[k : k + len(phrase)] == phrase
        places = [(k, label) for phrase, label in self.base for k in at.get(phrase[0], ()) if stands(phrase, k)]
        origins = Counter((t, k - position) for w in self.postings.keys() & at.keys() for t, position in self.postings[w] for k in at[w])
        found: dict[str, float] = {}
        for (t, origin), votes in origins.items():
            label, text, key = self.templates[t]
            if votes * 2 < min(RARE, len(set(text))):
                continue
            if stands(key, origin + self.offset[t]):
                share = sum(1 for i, w in enumerate(text) if 0 <= origin + i < len(words) and words[origin + i] == w) / len(text)
                found[label] = max(found.get(label, 0.0), share)
        return places, found


def vocabulary(templates=TEMPLATES, base=BASE) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()} | {w for phrase, _ in base for w in phrase.split()})


def count_batches(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    """(word number, documents that hold it), and under -1 all documents, of a task's texts."""
    known = Words(*texts(pa.array(words)))
    order = np.argsort(known.hashes)
    hashes, counts, n = known.hashes[order], np.zeros(len(words), dtype=np.int64), 0
    for batch in batches:
        data, offsets = texts(batch.column(0))
        n += len(batch)
        for i, j in blocks(offsets):
            found = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            at = np.minimum(np.searchsorted(hashes, found.hashes), len(hashes) - 1)
            hit = hashes[at] == found.hashes
            pairs = np.unique(found.owners()[hit] * len(words) + order[at[hit]])
            counts += np.bincount(pairs % len(words), minlength=len(words))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(words))], pa.int32()), pa.array([n, *counts.tolist()], pa.int64())], names=["word", "n"])


def document_frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """(in how many documents each word stands, number of documents): a row a word reaches the driver."""
    counted = map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), lambda b: count_batches(b, words), "word int, n long")
    found = {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(k, 0) for k, w in enumerate(words)}, found.get(-1, 0)


def scan_batches(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch.column(1))
        rows = []
        for i, j in blocks(offsets):
            lo = offsets[i]
            part, inner = data[lo : offsets[j]], offsets[i : j + 1] - lo
            found = Words(part, inner, hashed=False)
            low = found.low.tobytes()
            n_words = np.diff(found.first)
            ends = inner.tolist()
            for k in range(j - i):
                places, labels = [], {}
                if index.anchored.search(low, ends[k], ends[k + 1]):  # in the text's own bytes: no match crosses into the next
                    a, b = found.first[k], found.first[k + 1]
                    words = [low[s : s + n].decode() for s, n in zip(found.starts[a:b].tolist(), found.lengths[a:b].tolist(), strict=True)]
                    places, labels = index.scan(words)
                own = {label for _, label in places}
                rows.append((int(n_words[k]), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted(own)), ",".join(sorted(own | labels.keys())), 1.0 if own else max(labels.values(), default=0.0)))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    index = Index(templates, base, *document_frequencies(docs, vocabulary(templates, base), text_col))
    return map_arrow(docs.select(id_col, text_col), lambda batches: scan_batches(batches, index), SCHEMA)


def op4_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))
