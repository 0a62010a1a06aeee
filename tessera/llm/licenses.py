"""Licence notices found by the Dice coefficient of word bigrams.

A text is lower-cased and reduced to words.  Every run of its words, wherever it starts
and ends, is compared with the templates whose size allows the threshold: with Dice at
least t, sizes a and b satisfy ``t / (2 - t) <= a / b <= (2 - t) / t``, and the run holds
at least ``t / (2 - t) * b`` of the template's bigrams.  Where that many lie close enough
together, the runs that start and end with a bigram of the template are measured; no other
run is better.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import texts_of

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_REST = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_FREE = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_FREE_REST = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
_HEAD = "GNU {0} Version {1} Copyright (C) {2} Free Software Foundation, Inc. {3}Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_FREE_NAMES = (("GPL-3.0", "program", "General Public License", "3"), ("GPL-2.0", "program", "General Public License", "2"), ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("AGPL-3.0", "program", "Affero General Public License", "3"))
#: Notices, file headers and texts of well-known licences; of the GNU and Apache licences, the head of the text.
TEMPLATES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", _ISC),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_REST}"),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_REST}"),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3}"),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_BSD_REST}"),
    ("ISC", f"{_ISC} {_ISC_REST}"),
    ("Apache-2.0", f"{_APACHE} {_APACHE_REST}"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((name, _FREE.format(*x)) for name, *x in _FREE_NAMES),
    *((name, f"{_FREE} {_FREE_REST}".format(*x)) for name, *x in _FREE_NAMES),
    ("GPL-3.0", _HEAD.format("GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007", "")),
    ("GPL-2.0", _HEAD.format("GENERAL PUBLIC LICENSE", "2, June 1991", "1989, 1991", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA ")),
    ("LGPL-3.0", _HEAD.format("LESSER GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007", "")),
    ("LGPL-2.1", _HEAD.format("LESSER GENERAL PUBLIC LICENSE", "2.1, February 1999", "1991, 1999", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA ")),
    ("AGPL-3.0", _HEAD.format("AFFERO GENERAL PUBLIC LICENSE", "3, 19 November 2007", "2007", "")),
)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def bigrams(text: str) -> set[tuple[str, str]]:
    """Of the normalised text, with marks for its start and end so that one word is not empty."""
    words = _WORD.findall(text.lower())
    return set(zip(["", *words], [*words, ""], strict=True)) if words else set()


class Matcher:
    def __init__(self, templates=TEMPLATES, threshold: float = 0.85) -> None:
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        self.sets = [bigrams(text) for _, text in templates]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, grams in enumerate(self.sets):
            for g in grams:
                self.holders.setdefault(g, []).append(i)
        self.words = {a for a, _ in self.holders if a}
        t = threshold
        #: of each template: bigrams that a run has at least, and words that it has at most
        self.least = [math.ceil(len(x) * t / (2 - t) - 1e-9) for x in self.sets]
        self.most = [math.floor(len(x) * (2 - t) / t + 1e-9) for x in self.sets]

    def runs(self, words: list[str], i: int, hits: list[int]) -> list[tuple[float, int, int, int]]:
        """(dice, bigrams shared, start, end) of runs that match template i, from ``hits``, where its bigrams start; none overlap."""
        grams, most, b = self.sets[i], self.most[i], len(self.sets[i])
        # starts from which enough different bigrams are in reach; two more are the marks
        seen: Counter = Counter()
        near, j = set(), 0
        for at in hits:
            while j < len(hits) and hits[j] < at + most - 1:
                seen[words[hits[j]], words[hits[j] + 1]] += 1
                j += 1
            if len(seen) >= self.least[i] - 2:
                near.add(at)
                # a run may start earlier with the template's first word
                near.update(x for x in range(max(0, at - most), at) if ("", words[x]) in grams)
            g = words[at], words[at + 1]
            seen[g] -= 1
            if not seen[g]:
                del seen[g]
        found = []
        for at in near:
            own: set = set()
            shared, best, first = 0, None, ("", words[at]) in grams
            for end in range(at, min(at + most, len(words))):
                if end > at and (g := (words[end - 1], words[end])) not in own:
                    own.add(g)
                    shared += g in grams
                n = shared + first + ((words[end], "") in grams)
                dice = 2 * n / (len(own) + 2 + b)
                if dice >= self.threshold and (best is None or dice > best[0]):
                    best = (dice, n, at, end + 1)
            if best:
                found.append(best)
        return apart(found, len(words), key=lambda x: (-x[0], x[2]))

    def scan(self, text: str | None) -> list[tuple[str, float]]:
        """The best score of each licence that a run of the text's words matches, best first.

        Of overlapping runs, the one that shares most bigrams with its template counts; ties
        go to the better score, then to the earlier template.
        """
        words = _WORD.findall((text or "").lower())
        known, holders = self.words, self.holders
        hits = defaultdict(list)
        for at in [i for i, w in enumerate(words) if w in known]:
            for i in holders.get((words[at], words[at + 1]) if at + 1 < len(words) else None, ()):
                hits[i].append(at)
        found = [(*run, i) for i, own in hits.items() if len(own) >= self.least[i] - 2 for run in self.runs(words, i, own)]
        best: dict[str, float] = {}
        for dice, _, _, _, i in apart(found, len(words), key=lambda x: (-x[1], -x[0], x[4])):
            best[self.names[i]] = max(best.get(self.names[i], 0.0), dice)
        return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def apart(runs: list[tuple], n_words: int, key) -> list[tuple]:
    """Runs (.., .., start, end, ..) in the order of ``key``, without those that overlap an earlier one."""
    taken, out = bytearray(n_words), []
    for run in sorted(runs, key=key):
        if taken.find(1, run[2], run[3]) < 0:
            taken[run[2] : run[3]] = b"\1" * (run[3] - run[2])
            out.append(run)
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates=TEMPLATES, threshold: float = 0.85) -> DataFrame:
    """Returns (id_col, license, dice, licenses, n_licenses), one row per input row.

    ``license`` is the best match (null: none), ``licenses`` all names joined by commas in the
    order of score.  A null or blank text matches nothing.  Other columns are not read.
    """
    matcher = Matcher(templates, threshold)

    def scan(batches):
        for batch in batches:
            found = [matcher.scan(t) for t in texts_of(batch, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0][0] if f else None for f in found], pa.string()), pa.array([f[0][1] if f else None for f in found], pa.float64()), pa.array([",".join(n for n, _ in f) for f in found], pa.string()), pa.array([len(f) for f in found], pa.int64())],
                ["id", "license", "dice", "licenses", "n_licenses"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(scan, "id long, license string, dice double, licenses string, n_licenses long").withColumnRenamed("id", id_col)
