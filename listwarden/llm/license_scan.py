"""License notices in texts, by the Dice coefficient of word bigrams.

Text and templates are lower case words of letters and digits. A template of B bigrams is compared
with every window of B bigrams of the text (with the whole text if that is shorter): twice the
shared bigrams by the sum of both sizes, with multiplicities. A shorter text can reach the
threshold t only if it has t / (2 - t) * B bigrams, so smaller ones are pruned; so is a window with
fewer than t * B bigrams that occur in the template at all. A best window begins with a bigram of
the template or ends with the text, so only those windows are scored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame

THRESHOLD = 0.8
#: Whole licence texts are the files of licenses/, by SPDX identifier. Notices at file heads:
HEADERS = {
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
for _name, _license in (("AGPL-3.0-header", "GNU Affero General Public License"), ("LGPL-3.0-header", "GNU Lesser General Public License")):
    HEADERS[_name] = HEADERS["GPL-3.0-header"].replace("GNU General Public License", _license)
for _name, _license, _version in (
    ("LGPL-2.0-header", "GNU Library General Public License", "version 2"), ("LGPL-2.1-header", "GNU Lesser General Public License", "version 2.1"),
):
    HEADERS[_name] = HEADERS["GPL-2.0-header"].replace("GNU General Public License", _license).replace("version 2", _version)
#: Passages of texts that stand for the whole, and notices in words of their own.
PASSAGES = {
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "AGPL-3.0-text": "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software.",
    "BSD-3-Clause-header": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
#: What licences are called in notices.
CALLED = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache-2.0 License"],
    "MIT": ["MIT License", "MIT"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "3-Clause BSD License"],
    "BSD": ["BSD License"],
    "ISC": ["ISC License", "ISC"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL 1.1"],
    "CC0-1.0": ["Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal", "CC0 1.0", "CC0"],
}
for _id, _license, _versions in (
    ("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
    ("AGPL", "GNU Affero General Public License", ("3",)), ("GFDL", "GNU Free Documentation License", ("1.2", "1.3")),
):
    for _v in _versions:
        CALLED[f"{_id}-{_v if '.' in _v else _v + '.0'}"] = [
            *(x for v in dict.fromkeys((_v, f"{_v}.0" if "." not in _v else _v)) for x in (
                f"{_license}, version {v}", f"{_license} v{v}", f"{_license} {v}", f"{_id} version {v}", f"{_id} v{v}", f"{_id}-{v}")),
            f"{_id}v{_v}", f"{_license}, version {_v} or later", f"{_license}, either version {_v} of the License, or any later version",
        ]
for _parts in ("Attribution", "Attribution-ShareAlike", "Attribution-NonCommercial", "Attribution-NoDerivatives",
               "Attribution-NonCommercial-ShareAlike", "Attribution-NonCommercial-NoDerivatives"):
    _short = "-".join({"Attribution": "BY", "ShareAlike": "SA", "NonCommercial": "NC", "NoDerivatives": "ND"}[x] for x in _parts.split("-"))
    for _v, _kind in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        CALLED[f"CC-{_short}-{_v}"] = [
            f"Creative Commons {_parts} {_v} {_kind} License", f"Creative Commons {_parts} {_v}", f"Creative Commons {_parts} {_v} License",
            f"CC {_short} {_v}", f"CC {_short} {_v} License"]
    PASSAGES[f"CC-{_short}-4.0-text"] = (
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this "
        f"Creative Commons {_parts} 4.0 International Public License")
WORDINGS = [
    "Licensed under {}", "Licensed under the {}", "Released under the {}", "Released under {}", "Distributed under the {}",
    "Available under the {}", "Published under the {}", "Licensed under the terms of the {}", "Distributed under the terms of the {}",
    "This work is licensed under a {}", "This work is licensed under the {}", "This work is licensed under {}",
    "This project is licensed under the {}", "This software is licensed under the {}", "This file is licensed under the {}",
    "This content is licensed under {}", "Text is available under the {}", "License: {}", "Licence: {}",
]


def packaged() -> dict[str, list[str]]:
    """Templates by name: whole texts as NAME-text, heads of files as NAME-header, short notices as NAME."""
    out: dict[str, list[str]] = defaultdict(list)
    for name, text in [*HEADERS.items(), *PASSAGES.items()]:
        out[name].append(text)
    for file in resources.files("listwarden.llm").joinpath("licenses").iterdir():
        if file.name.endswith(".txt"):
            out[f"{file.name.removesuffix('.txt')}-text"].append(file.read_text(encoding="utf-8"))
    for name, calls in CALLED.items():
        out[name] += [w.format(c) for c in calls for w in WORDINGS]
        out[name] += [f"SPDX-License-Identifier: {name}"]
        if name.startswith(("GPL", "LGPL", "AGPL", "GFDL")):
            out[name] += [f"SPDX-License-Identifier: {name}-{end}" for end in ("only", "or-later")]
    return dict(out)


_WORD = re.compile(r"[^\W_]+")
Bigram = tuple[str, str]


def bigrams(text: str) -> list[Bigram]:
    words = _WORD.findall(text.lower())
    return list(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: Mapping[str, str | Sequence[str]], threshold: float):
        self.threshold = threshold
        # by name and number, each bag of bigrams once
        self.bags: dict[tuple[str, int], Counter[Bigram]] = {}
        for name, texts in sorted(templates.items()):
            bags = {frozenset(bag.items()): bag for text in ([texts] if isinstance(texts, str) else texts) if (bag := Counter(bigrams(text)))}
            self.bags |= {(name, i): bag for i, bag in enumerate(bags.values())}
        self.sizes = {key: sum(bag.values()) for key, bag in self.bags.items()}
        self.where: dict[Bigram, list[tuple[str, int]]] = defaultdict(list)
        for key, bag in self.bags.items():
            for pair in bag:
                self.where[pair].append(key)

    def scan(self, text: str) -> list[tuple[str, float, int]]:
        """Templates found: name, best Dice coefficient, word at which that window begins; best first."""
        pairs = bigrams(text)
        hits: dict[tuple[str, int], list[int]] = defaultdict(list)
        where = self.where
        for i, pair in enumerate(pairs):
            if pair in where:
                for key in where[pair]:
                    hits[key].append(i)
        found: dict[str, tuple[float, int]] = {}
        for key, at in hits.items():
            size = self.sizes[key]
            window = min(size, len(pairs))
            least = self.threshold * (size + window) / 2  # shared bigrams that the threshold takes
            if window < least or len(at) < least:
                continue
            shared, start = self._best(pairs, at, self.bags[key], window)
            dice = 2 * shared / (size + window)
            if dice >= self.threshold:
                found[key[0]] = max(found.get(key[0], (0.0, 0)), (dice, -start))
        return sorted(((name, dice, -start) for name, (dice, start) in found.items()), key=lambda x: (-x[1], x[0]))

    @staticmethod
    def _best(pairs: list[Bigram], at: list[int], bag: Counter[Bigram], window: int) -> tuple[int, int]:
        """Most shared bigrams of a window and its first start; the window slides over the places `at`."""
        inside: dict[Bigram, int] = defaultdict(int)
        low = high = shared = 0
        best = (0, 0)
        for i in at:
            start = min(i, len(pairs) - window)
            while high < len(at) and at[high] < start + window:
                pair = pairs[at[high]]
                inside[pair] += 1
                shared += inside[pair] <= bag[pair]
                high += 1
            while at[low] < start:
                pair = pairs[at[low]]
                shared -= inside[pair] <= bag[pair]
                inside[pair] -= 1
                low += 1
            best = max(best, (shared, -start))
        return best[0], -best[1]


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, str | Sequence[str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """Rows (doc_id, licenses) of docs; licenses holds structs of license, dice and first_word.

    Best first, ties by name. Null and empty texts, and templates of fewer than two words, match
    nothing. Templates are one or several texts by name, the packaged ones by default; of several the
    best counts. Columns other than doc_id and text are ignored; repeated rows stay.
    """
    templates = packaged() if templates is None else templates

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int64())]))
        for batch in batches:
            found = [
                [{"license": n, "dice": d, "first_word": w} for n, d, w in scanner.scan(t or "")]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "licenses"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, licenses array<struct<license:string,dice:double,first_word:bigint>>")
