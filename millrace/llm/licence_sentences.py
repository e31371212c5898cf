"""Licence scans by sentence rules: sentences become identifiers, identifier sequences meet ordered rules.

Texts and known licence sentences are compared as words (lower case, letters and digits only), so line
wraps, indents, comment marks and punctuation do not matter. A known sentence is met where its words begin
and end at a border: the text's ends, a line end, or . ! ? : ; before a space. `<>` in a known sentence
stands for one to GAP words, such as a holder's name. A rule is an ordered sequence of
identifiers; it holds where its identifiers follow one another, with other sentences allowed between
them, before its first one comes again. Among rules that start at one place the longest is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import row_slices

_WORDS = re.compile(r"[a-z0-9]+")
#: Known sentences by identifier.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-title-long": "The MIT License (MIT)",
    "mit-title-the": "The MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-grant-short": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-condition-next": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-long": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-title": "Apache License",
    "apache-version": "Version 2.0, January 2004",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gnu-1991": "Version 2, June 1991",
    "gnu-1999": "Version 2.1, February 1999",
    "gnu-2007": "Version 3, 29 June 2007",
    "agpl-2007": "Version 3, 19 November 2007",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-title": "Eclipse Public License - v 2.0",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "cc0-title": "CC0 1.0 Universal",
    "ccbync-notice": "Licensed under CC BY-NC 4.0.",
    "ccby-notice": "Licensed under CC BY 4.0.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-endorse": "Neither the name of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-own": "Neither the name of <> nor the names of <> contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-old": "The name of <> may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "warranty-short": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.",
}
#: Notices of the GNU licences: identifier, licence, name in the notice, version.
_GNU = (
    ("gpl2", "GPL-2.0", "General", "2"), ("gpl3", "GPL-3.0", "General", "3"), ("lgpl21", "LGPL-2.1", "Lesser General", "2.1"),
    ("lgpl3", "LGPL-3.0", "Lesser General", "3"), ("agpl3", "AGPL-3.0", "Affero General", "3"),
)
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Unlicense", "Zlib", "CC0-1.0", *(f"{g[1]}-{x}" for g in _GNU for x in ("only", "or-later")), *(f"CC-{k.upper()}-4.0" for k in _CC))
#: Ordered rules: a licence and the identifiers that name it.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-condition")), ("MIT", ("mit-grant", "mit-condition")), ("MIT", ("mit-notice",)), ("MIT", ("mit-notice-2",)),
    ("Apache-2.0", ("apache-notice-long", "apache-copy")), ("Apache-2.0", ("apache-notice-long",)), ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-only", ("gpl3-notice",)), ("GPL-3.0-or-later", ("gpl-free",)), ("CC-BY-NC-4.0", ("ccbync-notice",)), ("CC-BY-4.0", ("ccby-notice",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-advert", "bsd-endorse")), ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-advert", "bsd-endorse-own")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-endorse")), ("BSD-3-Clause", ("bsd-grant", "bsd-endorse-own")), ("BSD-3-Clause", ("bsd-grant", "bsd-endorse-old")),
    ("BSD-2-Clause", ("bsd-grant",)), ("ISC", ("isc-grant",)), ("ISC", ("isc-grant-and",)), ("0BSD", ("0bsd-grant",)),
    ("MIT", ("mit-grant-short", "mit-condition")), ("MIT", ("mit-grant", "mit-condition-next")),
    ("Apache-2.0", ("apache-title", "apache-version")), ("GPL-2.0-only", ("gpl-title", "gnu-1991")), ("GPL-3.0-only", ("gpl-title", "gnu-2007")),
    ("LGPL-2.1-only", ("lgpl-title", "gnu-1999")), ("LGPL-3.0-only", ("lgpl-title", "gnu-2007")), ("AGPL-3.0-only", ("agpl-title", "agpl-2007")),
    ("MPL-2.0", ("mpl-title",)), ("MPL-2.0", ("mpl-notice",)), ("EPL-2.0", ("epl-title",)), ("EPL-2.0", ("epl-notice",)), ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-notice",)), ("Unlicense", ("unlicense",)), ("Zlib", ("zlib-grant",)), ("CC0-1.0", ("cc0-title",)),
)
for _id, _licence, _name, _version in _GNU:
    for _what in ("program", "library", "software", "file"):
        _head = f"This {_what} is free software: you can redistribute it and/or modify it under the terms of the GNU {_name} Public License"
        for _kind, _tail in (
            ("or-later", f"as published by the Free Software Foundation, either version {_version} of the License, or (at your option) any later version."),
            ("only", f"version {_version} as published by the Free Software Foundation."), ("only", f"as published by the Free Software Foundation, version {_version}."),
            ("only", f"as published by the Free Software Foundation; version {_version} of the License."),
        ):
            if f"{_head} {_tail}" not in SENTENCES.values():
                SENTENCES[f"{_id}-{_what}-{len(SENTENCES)}"] = f"{_head} {_tail}"
                RULES += ((f"{_licence}-{_kind}", (f"{_id}-{_what}-{len(SENTENCES) - 1}",)),)
for _key, _name in _CC.items():
    SENTENCES[f"cc-{_key}"] = f"This work is licensed under a Creative Commons {_name} 4.0 International License."
    SENTENCES[f"cc-{_key}-the"] = f"This work is licensed under the Creative Commons {_name} 4.0 International License."
    RULES += ((f"CC-{_key.upper()}-4.0", (f"cc-{_key}",)), (f"CC-{_key.upper()}-4.0", (f"cc-{_key}-the",)))
for _licence in _SPDX:
    SENTENCES[f"spdx-{_licence}"] = f"SPDX-License-Identifier: {_licence}"
    RULES += ((_licence, (f"spdx-{_licence}",)),)
#: Names of licences as notices give them.
_NAMES = {
    "MIT": ("MIT License", "MIT"), "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0 License"), "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"), "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "GPL-2.0-only": ("GNU General Public License v2.0", "GNU General Public License, version 2", "GNU GPL v2", "GPLv2"), "GPL-3.0-only": ("GNU General Public License v3.0", "GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-3.0-only": ("GNU Lesser General Public License v3.0", "LGPLv3"), "AGPL-3.0-only": ("GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "AGPLv3"),
    "Unlicense": ("Unlicense",), "BSL-1.0": ("Boost Software License 1.0",), "Zlib": ("zlib License",), "WTFPL": ("WTFPL",), "Artistic-2.0": ("Artistic License 2.0",),
    **{f"CC-{k.upper()}-4.0": (f"CC {k.upper()} 4.0", f"CC-{k.upper()}-4.0", f"Creative Commons {v} 4.0 International License") for k, v in _CC.items()},
}
_NOTICES = (
    "Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}", "This project is licensed under {}", "This software is licensed under {}", "This work is licensed under {}",
    "This program is licensed under {}", "This project is released under {}", "This software is released under {}", "This library is licensed under {}", "This code is licensed under {}",
)
for _licence, _all in _NAMES.items():
    for _name in _all:
        for _notice in _NOTICES:
            for _the in ("the ", ""):
                _sentence = _notice.format(_the + _name)
                if _WORDS.findall(_sentence.lower()) not in [_WORDS.findall(x.lower()) for x in SENTENCES.values() if x[:20] == _sentence[:20]]:
                    SENTENCES[f"notice-{len(SENTENCES)}"] = _sentence
                    RULES += ((_licence, (f"notice-{len(SENTENCES) - 1}",)),)
#: Most words that `<>` stands for.
GAP = 16
#: Every known sentence holds one of these; a text without any is not cut into words.
_TRIGGERS = ("licen", "permission", "software", "version", "redistribut", "cc0", "cc by", "under")
_BORDER = re.compile(r"\n|[.!?:;][\"')\]]*\s")


def normalise(sentence: str) -> list[str]:
    return _WORDS.findall(sentence.lower())


#: Known sentences, as parts between gaps, by their first two words; the longest first.
_KNOWN: dict[tuple[str, str], list[tuple[str, list[list[str]]]]] = {}
for _name, _sentence in sorted(SENTENCES.items(), key=lambda x: -len(x[1])):
    _parts = [normalise(x) for x in _sentence.split("<>")]
    _KNOWN.setdefault((_parts[0][0], _parts[0][1]), []).append((_name, _parts))


def _by_first(rules: tuple) -> dict[str, list[tuple[str, tuple[str, ...]]]]:
    """Rules by their first identifier, the longest first."""
    out: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
    for rule in sorted(rules, key=lambda x: -len(x[1])):
        out.setdefault(rule[1][0], []).append(rule)
    return out


_BY_FIRST = _by_first(RULES)


def _end(words: list[str], at: int, parts: list[list[str]]) -> int:
    """Where the parts end that begin at `at`, or -1."""
    if words[at : at + len(parts[0])] != parts[0]:
        return -1
    at += len(parts[0])
    if len(parts) == 1:
        return at
    for skip in range(1, GAP + 1):
        if (end := _end(words, at + skip, parts[1:])) >= 0:
            return end
    return -1


def sentence_ids(text: str) -> list[str]:
    """Identifiers of the known sentences in a text, in order; at one place the longest counts."""
    low = text.lower()
    if not any(t in low for t in _TRIGGERS):
        return []
    spans = [m.span() for m in _WORDS.finditer(low)]
    words = [low[a:b] for a, b in spans]
    found, at = [], 0
    while at < len(words) - 1:
        step = 1
        known = _KNOWN.get((words[at], words[at + 1]))
        if known and (at == 0 or _BORDER.search(low, spans[at - 1][1], spans[at][0])):
            for name, parts in known:
                end = _end(words, at, parts)
                if end >= 0 and (end == len(words) or _BORDER.search(low, spans[end - 1][1], spans[end][0])):
                    found.append(name)
                    step = end - at
                    break
        at += step
    return found


def match(found: list[str], rules: tuple = RULES) -> list[str]:
    """Licences whose identifiers follow one another in order, other sentences between them.

    Each place of a rule's first identifier counts for the longest rule that holds before that identifier
    comes again, so a text with several licences gives each of them.
    """
    by_first: dict[str, list[tuple[str, tuple[str, ...]]]] = _BY_FIRST if rules is RULES else _by_first(rules)
    held = set()
    for i, name in enumerate(found):
        if known := by_first.get(name):
            after = found[i + 1 :]
            if name in after:
                after = after[: after.index(name)]
            for licence, wanted in known:
                rest = iter(after)
                if all(w in rest for w in wanted[1:]):
                    held.add(licence)
                    break
    return sorted(held)


def licences(documents: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (in text order) and licences (sorted) of each document.

    A null or empty text has none; rows are independent, so repeated rows and null ids pass through; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text"):
                ids = [sentence_ids(t or "") for t in batch.column("text").to_pylist()]
                text = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, text), pa.array([match(x) for x in ids], text)], ["doc_id", "sentence_ids", "licences"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, sentence_ids array<string>, licences array<string>")
