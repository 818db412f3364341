"""License scan by ordered signature rules.

Signatures are written by hand: sentences, notices and links that stand in one license or its notice. Beside
them each license family has a few names, and templates (a grant, a version, a tag, a mere mention) turn
them into some hundreds more. In all of them a blank is any white space. A rule's regex runs only if one
of its keywords is in the text, which one keyword automaton finds for all rules. Detections are then taken in the order of their rules' priority,
and one that lies inside the interval of another already taken is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, byte_slices, in_small_batches

# Label, keywords (one of them is in every text that the names match), names as patterns, identifiers.
FAMILIES = (
    ("mit", "mit|expat", r"mit|expat", "MIT"),
    ("mit-0", "attribution", r"mit no attribution", "MIT-0"),
    ("apache", "apache", r"apache(?: software)?", "Apache-2.0|Apache-1.1|Apache-1.0"),
    ("agpl", "affero", r"(?:gnu )?affero general public", "AGPL-3.0|AGPL-3.0-only|AGPL-3.0-or-later|AGPL-1.0"),
    ("lgpl", "lesser|library general", r"(?:gnu )?(?:lesser|library) general public|lesser gpl", "LGPL-2.0|LGPL-2.1|LGPL-3.0|LGPL-2.1-or-later|LGPL-3.0-or-later"),
    ("gpl", "general public", r"(?:gnu )?general public", "GPL-2.0|GPL-3.0|GPL-2.0-only|GPL-3.0-only|GPL-2.0-or-later|GPL-3.0-or-later"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?:v[123])?", "GPL-1.0"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation", "GFDL-1.1|GFDL-1.2|GFDL-1.3"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2[- ]clause|two[- ]clause) bsd|bsd[- ]2[- ]clause", "BSD-2-Clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3[- ]clause|three[- ]clause) bsd|bsd[- ]3[- ]clause", "BSD-3-Clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4[- ]clause|four[- ]clause) bsd|bsd[- ]4[- ]clause", "BSD-4-Clause"),
    ("bsd", "bsd", r"bsd(?:[- ]style)?", "0BSD"),
    ("isc", "isc|internet systems", r"isc|internet systems consortium", "ISC"),
    ("mpl", "mozilla", r"mozilla public", "MPL-1.0|MPL-1.1|MPL-2.0"),
    ("epl", "eclipse", r"eclipse public", "EPL-1.0|EPL-2.0"),
    ("edl", "eclipse", r"eclipse distribution", "EDL-1.0"),
    ("cddl", "common development", r"common development and distribution", "CDDL-1.0|CDDL-1.1"),
    ("cpl", "common public", r"common public", "CPL-1.0"),
    ("eupl", "european union", r"european union public", "EUPL-1.1|EUPL-1.2"),
    ("artistic", "artistic", r"artistic", "Artistic-1.0|Artistic-2.0"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", "Zlib|zlib-acknowledgement"),
    ("boost", "boost", r"boost software", "BSL-1.0"),
    ("unlicense", "unlicense", r"the unlicense|unlicense", "Unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", "WTFPL"),
    ("python", "python|psf", r"python software foundation|psf", "PSF-2.0|Python-2.0"),
    ("php", "php", r"php", "PHP-3.0|PHP-3.01"),
    ("openssl", "openssl", r"openssl", "OpenSSL"),
    ("ruby", "ruby", r"ruby", "Ruby"),
    ("ms-pl", "microsoft", r"microsoft public", "MS-PL"),
    ("ms-rl", "microsoft", r"microsoft reciprocal", "MS-RL"),
    ("osl", "open software", r"open software", "OSL-1.0|OSL-2.0|OSL-2.1|OSL-3.0"),
    ("afl", "academic", r"academic free", "AFL-1.1|AFL-2.0|AFL-2.1|AFL-3.0"),
    ("ofl", "open font", r"(?:sil )?open font", "OFL-1.0|OFL-1.1"),
    ("odbl", "open database", r"open (?:data commons open )?database", "ODbL-1.0"),
    ("odc-by", "open data commons", r"open data commons attribution", "ODC-By-1.0"),
    ("pddl", "public domain dedication", r"public domain dedication and", "PDDL-1.0"),
    ("cc0", "cc0|commons zero", r"(?:creative commons )?cc0|creative commons zero", "CC0-1.0"),
    ("cc-by-nc-sa", "nc-sa", r"(?:creative commons |cc )?by-nc-sa", "CC-BY-NC-SA-2.0|CC-BY-NC-SA-3.0|CC-BY-NC-SA-4.0"),
    ("cc-by-nc-nd", "nc-nd", r"(?:creative commons |cc )?by-nc-nd", "CC-BY-NC-ND-2.0|CC-BY-NC-ND-3.0|CC-BY-NC-ND-4.0"),
    ("cc-by-nc", "by-nc", r"(?:creative commons |cc )?by-nc(?!-)", "CC-BY-NC-2.0|CC-BY-NC-3.0|CC-BY-NC-4.0"),
    ("cc-by-nd", "by-nd", r"(?:creative commons |cc )?by-nd", "CC-BY-ND-2.0|CC-BY-ND-3.0|CC-BY-ND-4.0"),
    ("cc-by-sa", "by-sa", r"(?:creative commons |cc )?by-sa", "CC-BY-SA-2.0|CC-BY-SA-3.0|CC-BY-SA-4.0"),
    ("cc-by", "cc by", r"cc by(?!-)", "CC-BY-2.0|CC-BY-3.0|CC-BY-4.0"),
    ("cc-by", "commons attribution", r"creative commons attribution(?!-)", "CC-BY-1.0"),
    ("cc", "creative commons", r"creative commons", "CC-BY-2.5"),
    ("openrail", "rail", r"(?:creativeml |bigscience )?(?:open)?rail(?:-m)?", "OpenRAIL"),
    ("upl", "universal permissive", r"universal permissive", "UPL-1.0"),
    ("vim", "vim", r"vim", "Vim"),
    ("x11", "x11|x consortium", r"x11|x consortium", "X11"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)?", "NCSA"),
    ("postgresql", "postgresql", r"postgresql", "PostgreSQL"),
    ("blue-oak", "blue oak", r"blue oak model", "BlueOak-1.0.0"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software)", "MulanPSL-1.0|MulanPSL-2.0"),
    ("sspl", "server side", r"server side public", "SSPL-1.0"),
    ("busl", "business source", r"business source", "BUSL-1.1"),
    ("elastic", "elastic", r"elastic", "Elastic-2.0"),
)
#: (priority, confidence, pattern around the names); lower priority numbers go first.
TEMPLATES = (
    (10, 0.98, r"\b(?:licen[sc]ed|released|distributed|available|published|made available) under (?:the )?(?:terms of )?(?:the )?(?:{n})(?: licen[sc]e)?,? v(?:ersion)? ?\d+(?:\.\d+)*"),
    (20, 0.95, r"\b(?:licen[sc]ed|released|distributed|available|published|made available) under (?:the )?(?:terms of )?(?:the |an? )?(?:{n})\b(?: licen[sc]e)?(?:,? \d+(?:\.\d+)*)?"),
    (40, 0.85, r"\b(?:{n}) licen[sc]e,? v(?:ersion)? ?\d+(?:\.\d+)*"),
    (60, 0.6, r"\b(?:{n}) licen[sc]e\b"),
    (70, 0.5, r"\blicen[sc]e ?[:=] ?['\"]?(?:{n})\b"),
)
TAG = (5, 0.99, r"spdx-license-identifier: ?(?:\w[\w.+-]*(?: or | and ))?{i}(?![\w.-])")
IDENTIFIER = (30, 0.8, r"(?<![\w.-]){i}(?![\w.-])")
GENERAL = (
    (90, 0.3, "all-rights-reserved", "all rights reserved", r"all rights reserved"),
    (95, 0.3, "copyright", "copyright", r"copyright (?:\(c\)|©)? ?\d{4}"),
    (96, 0.2, "public-domain", "public domain", r"(?:in|into) the public domain"),
    (99, 0.1, "other", "licen", r"\b(?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of )?[\w -]{2,40}?licen[sc]e"),
)
# Label, keyword (it is in every text that the pattern matches), pattern in lower case.
SIGNATURES = (
    ("mit", "any person obtaining a copy", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "without restriction, including", r"deal in the software without restriction, including without limitation the rights"),
    ("mit", "this permission notice shall be", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "opensource.org/licenses/mit", r"opensource\.org/licenses/mit\b"),
    ("x11", "used in advertising or otherwise", r"shall not be used in advertising or otherwise to promote the sale, use or other dealings"),
    ("ncsa", "deal with the software without restriction", r"deal with the software without restriction, including without limitation"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd", "copyright holders and contributors", r"provided by the copyright holders and contributors ['\"`]{0,2}as is"),
    ("bsd", "regents and contributors", r"provided by the regents and contributors ['\"`]{0,2}as is"),
    ("bsd-2-clause", "opensource.org/licenses/bsd-2", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "opensource.org/licenses/bsd-3", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-3-clause", "endorse or promote products", r"may be used to endorse or promote products derived from this software without"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-2-clause", "views and conclusions", r"the views and conclusions contained in the software and documentation are those of"),
    ("isc", "with or without fee", r"copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims all warranties", r"disclaims all warranties with regard to this software"),
    ("isc", "opensource.org/licenses/isc", r"opensource\.org/licenses/isc\b"),
    ("apache", "licensed under the apache", r"licensed under the apache license, version 2\.0 \(the ['\"]license['\"]\)"),
    ("apache", "except in compliance with the license", r"you may not use this (?:file|work|software|project) except in compliance with the license"),
    ("apache", "unless required by applicable law", r"unless required by applicable law or agreed to in writing, software distributed under the license"),
    ("apache", "specific language governing", r"see the license for the specific language governing permissions and limitations"),
    ("apache", "apache.org/licenses", r"apache\.org/licenses/license-[12]\.\d"),
    ("apache", "apache software foundation", r"licensed to the apache software foundation \(asf\) under one or more contributor"),
    ("apache", "apache software foundation", r"this product includes software developed (?:by|at) the apache software foundation"),
    ("gpl", "this program is free software", r"this program is free software[:;,] you can redistribute it"),
    ("gpl", "gnu general public license as published", r"gnu general public license as published by the free software foundation"),
    ("gpl", "a copy of the gnu general public", r"received a copy of the gnu general public license"),
    ("gpl", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("gpl", "any later version", r"version [23] of the license, or \(at your option\) any later version"),
    ("gpl", "in the hope that it will be useful", r"this program is distributed in the hope that it will be useful, but without any warranty"),
    ("gpl", "preamble the gnu general public", r"preamble the gnu general public license is a free, copyleft license"),
    ("gpl-exception", "as a special exception", r"as a special exception, the (?:copyright holders?|authors?|free software foundation)"),
    ("gpl-exception", "classpath", r"classpath['\"]? exception"),
    ("lgpl", "this library is free software", r"this library is free software[:;,] you can redistribute it"),
    ("lgpl", "general public license as published", r"gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("lgpl", "a copy of the gnu", r"received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", "gnu.org/licenses/lgpl", r"gnu\.org/licenses/lgpl"),
    ("agpl", "gnu affero general public license as", r"gnu affero general public license as published by the free software foundation"),
    ("agpl", "a copy of the gnu affero", r"received a copy of the gnu affero general public license"),
    ("agpl", "remote network interaction", r"remote network interaction; use with the gnu general public license"),
    ("agpl", "gnu.org/licenses/agpl", r"gnu\.org/licenses/agpl"),
    ("gfdl", "modify this document", r"copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant sections", r"with no invariant sections, (?:with )?no front-cover texts"),
    ("gfdl", "gnu.org/licenses/fdl", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ("mpl", "source code form is subject", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "copy of the mpl", r"if a copy of the mpl was not distributed with this file"),
    ("mpl", "mozilla.org/", r"mozilla\.org/(?:en-us/)?mpl"),
    ("mpl", "incompatible with secondary", r"incompatible with secondary licenses"),
    ("mpl", "subject to the mozilla", r"contents of this file are subject to the mozilla public license"),
    ("npl", "netscape public", r"subject to the netscape public license"),
    ("epl", "accompanying materials", r"accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "eclipse.org/legal/epl", r"eclipse\.org/legal/epl"),
    ("edl", "org/documents/edl", r"eclipse\.org/org/documents/edl"),
    ("cddl", "common development and distribution", r"subject to the terms of the common development and distribution license"),
    ("cddl", "licenses/cddl", r"opensource\.org/licenses/cddl"),
    ("cpl", "licenses/cpl", r"opensource\.org/licenses/cpl"),
    ("cpl", "common public license", r"terms of this common public license"),
    ("ipl", "ibm public", r"\bibm public license"),
    ("apsl", "apple public source", r"subject to the apple public source license"),
    ("qpl", "q public license", r"\bq public license"),
    ("eupl", "under the eupl", r"licen[sc]ed under the eupl"),
    ("eupl", "joinup", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("cecill", "cecill", r"governed by the cecill(?:-[abc])? license"),
    ("cecill", "cecill.info", r"cecill\.info/licen[sc]es"),
    ("artistic", "terms as perl itself", r"under the same terms as perl itself"),
    ("artistic", "artistic license", r"under the terms of (?:the|either) (?:perl )?artistic license"),
    ("artistic", "licenses/artistic", r"opensource\.org/licenses/artistic"),
    ("zlib", "without any express or implied", r"this software is provided ['\"`]{0,2}as-is['\"`]{0,2},? without any express or implied warranty"),
    ("zlib", "plainly marked as such", r"altered source versions must be plainly marked as such"),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("libpng", "libpng", r"this copy of the libpng notices is provided"),
    ("boost", "any person or organization obtaining", r"free of charge, to any person or organization obtaining a copy of the software"),
    ("boost", "boost.org/license", r"boost\.org/license_1_0"),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("wtfpl", "do what the fuck you want", r"do what the fuck you want to"),
    ("wtfpl", "wtfpl.net", r"wtfpl\.net"),
    ("python", "psf license agreement", r"psf license agreement for python"),
    ("python", "making python", r"psf is making python [\d.]* ?available to licensee"),
    ("python", "beopen", r"beopen(?:\.com)? (?:license agreement for )?python"),
    ("php", "includes php software", r"this product includes php software"),
    ("php", "php.net/license", r"php\.net/license"),
    ("openssl", "by the openssl project", r"software developed by the openssl project"),
    ("openssl", "cryptographic software written", r"cryptographic software written by eric young"),
    ("ruby", "2-clause bsdl", r"either the terms of the 2-clause bsdl"),
    ("ms-pl", "licenses/ms-pl", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "licenses/ms-rl", r"opensource\.org/licenses/ms-rl"),
    ("osl", "open software license", r"licensed under the open software license"),
    ("afl", "academic free license", r"licensed under the academic free license"),
    ("zpl", "zope public", r"zope public license"),
    ("w3c", "w3.org/consortium/legal", r"w3\.org/consortium/legal"),
    ("w3c", "w3c software", r"\bw3c software (?:and document )?(?:notice|licen[sc]e)"),
    ("unicode", "unicode, inc. license", r"unicode, inc\. license agreement"),
    ("unicode", "unicode.org/copyright", r"unicode\.org/copyright"),
    ("ijg", "independent jpeg group", r"based in part on the work of the independent jpeg group"),
    ("freetype", "freetype project", r"portions of this software are copyright .{1,40} the freetype project"),
    ("beerware", "beer-ware", r"the beer-ware license"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("json", "for good, not evil", r"the software shall be used for good, not evil"),
    ("sleepycat", "sleepycat", r"\bsleepycat (?:software|license)"),
    ("postgresql", "without a written agreement", r"for any purpose, without fee, and without a written agreement is hereby granted"),
    ("hpnd", "this software and its documentation", r"permission to use, copy, modify,? and distribute this software and its documentation"),
    ("upl", "associated documentation and/or data", r"obtaining a copy of this software, associated documentation and/or data"),
    ("vim", "unmodified copies of vim", r"you can distribute unmodified copies of vim without restriction"),
    ("cc0", "waived all copyright", r"to the extent possible under law, .{1,80} (?:has|have) waived all copyright"),
    ("cc0", "publicdomain/zero", r"creativecommons\.org/publicdomain/zero"),
    ("public-domain", "publicdomain/mark", r"creativecommons\.org/publicdomain/mark"),
    ("cc-by", "creativecommons.org/licenses/by/", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "creativecommons.org/licenses/by-sa", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nd", "creativecommons.org/licenses/by-nd", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc", "creativecommons.org/licenses/by-nc/", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-sa", "creativecommons.org/licenses/by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "creativecommons.org/licenses/by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-sa", "attribution-share", r"creative commons attribution-share ?alike"),
    ("cc-by-nc", "attribution-noncommercial", r"creative commons attribution-noncommercial(?!-)"),
    ("cc-by-nc-sa", "noncommercial-share", r"creative commons attribution-noncommercial-share ?alike"),
    ("cc-by-nd", "attribution-noderiv", r"creative commons attribution-noderiv(?:ative)?s"),
    ("cc-by-nc-nd", "noncommercial-noderiv", r"creative commons attribution-noncommercial-noderiv(?:ative)?s"),
    ("ofl", "this font software is licensed", r"this font software is licensed under the sil open font license"),
    ("ofl", "scripts.sil.org/ofl", r"scripts\.sil\.org/ofl"),
    ("odbl", "opendatacommons.org/licenses/odbl", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "opendatacommons.org/licenses/by", r"opendatacommons\.org/licenses/by"),
    ("pddl", "opendatacommons.org/licenses/pddl", r"opendatacommons\.org/licenses/pddl"),
    ("sspl", "server-side-public-license", r"mongodb\.com/licensing/server-side-public-license"),
    ("busl", "non-production use", r"redistribute, and make non-production use of the licensed work"),
    ("elastic", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("elastic", "elastic.co/licensing", r"elastic\.co/licensing/elastic-license"),
    ("commons-clause", "commons clause", r"commons clause['\"]? license condition"),
    ("openrail", "use-based restrictions", r"use-based restrictions as referenced in paragraph"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software|document|work), via any medium,? is strictly prohibited"),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "may not be reproduced", r"may not be reproduced .{0,80}without (?:the )?prior written (?:permission|consent)"),
    ("proprietary", "trade secret", r"(?:contains|constitutes?) (?:valuable )?(?:confidential |proprietary )?trade secrets?"),
    ("non-commercial", "non-commercial", r"for non-commercial (?:use|purposes?|research) only"),
    ("non-commercial", "personal use only", r"for personal use only"),
    ("non-commercial", "research purposes only", r"for (?:academic |scientific )?research purposes only"),
    ("public-domain", "to the public domain", r"(?:dedicated?|dedicates?|released?|released) (?:it |this work |this software )?to the public domain"),
    ("public-domain", "no copyright", r"no copyright is claimed"),
)
SIGNATURE = (15, 0.97)
WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = (((b"mit", b"license"), "mit"), ((b"apache", b"license"), "apache"), ((b"general", b"public", b"license"), "gpl"))


@dataclass(frozen=True)
class Rule:
    priority: int
    confidence: float
    label: str
    keyword: str
    pattern: str


def spaced(pattern: str) -> str:
    """The pattern with any white space for each blank; runs are taken whole, so that they cost no retries."""
    pattern = pattern.replace("[- ]", r"(?:-|\s++)").replace(r"[\w -]", r"[\w\s-]")
    return pattern.replace(" ?", r"\s*+").replace(" ", r"\s++")


def rules() -> list[Rule]:
    out = [Rule(p, c, label, key, spaced(pattern)) for p, c, label, key, pattern in GENERAL]
    out += [Rule(*SIGNATURE, label, key, spaced(pattern)) for label, key, pattern in SIGNATURES]
    for label, key, names, identifiers in FAMILIES:
        out += [Rule(p, c, label, key, spaced(t.replace("{n}", names))) for p, c, t in TEMPLATES]
        for i in identifiers.lower().split("|"):
            out.append(Rule(TAG[0], TAG[1], label, "spdx", TAG[2].replace("{i}", re.escape(i))))
            if "-" in i and any(c.isdigit() for c in i):
                out.append(Rule(IDENTIFIER[0], IDENTIFIER[1], label, i, IDENTIFIER[2].replace("{i}", re.escape(i))))
    return sorted(out, key=lambda r: (r.priority, -len(r.pattern), r.label))


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = rules()
        self.compiled: dict[int, re.Pattern] = {}
        by_key: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for k in r.keyword.split("|"):
                by_key.setdefault(k, []).append(i)
        self.keys = ahocorasick.Automaton()
        for k, v in by_key.items():
            self.keys.add_word(k, (k, v))
        self.keys.make_automaton()

    def detections(self, lower: str) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) of what stays, in the order of the text. ``lower``: ASCII letters in lower case."""
        hit: set[int] = set()
        for _, (_, own) in self.keys.iter(" ".join(lower.split())):
            hit.update(own)
        found = []
        for i in sorted(hit):
            if i not in self.compiled:
                self.compiled[i] = re.compile(self.rules[i].pattern)
            found += [(self.rules[i].priority, -(m.end() - m.start()), i, m.start(), m.end()) for m in self.compiled[i].finditer(lower) if m.end() > m.start()]
        taken: list[tuple[int, int, Rule]] = []
        starts, ends = [], []  # of those taken that lie in no other: both rise
        for _, _, i, a, z in sorted(found):
            at = bisect_right(starts, a)
            if at and ends[at - 1] >= z:
                continue
            taken.append((a, z, self.rules[i]))
            first, last = bisect_left(starts, a), bisect_right(ends, z)  # what lies in the new one
            starts[first:last], ends[first:last] = [a], [z]
        return sorted(taken, key=lambda x: x[:2])


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word index, label) of every place where a phrase's words stand one after another."""
    out = []
    for phrase, label in PHRASES:
        n = len(phrase)
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if tuple(words[at : at + n]) == phrase:
                out.append((at, label))
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of each row.

    ``detections``: array<struct(start, end, label, priority)> with character offsets. Null texts are
    empty; a text without detections has empty labels and score 0. One row for each row.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "detections array<struct<start:int,end:int,label:string,priority:int>>"
    )
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("priority", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for whole in batches:
            for b in byte_slices(whole, "text"):
                rows = []
                for raw in as_bytes(b.column(1)):
                    lower = raw.lower()
                    words = WORDS.findall(lower)
                    places = base_places(words) if b"license" in lower else []
                    own = {x for _, x in places}
                    found = scanner.detections(lower.decode())
                    miss = 1.0
                    for _, _, r in found:
                        miss *= 1 - r.confidence
                    at = [k for k, _ in places]
                    if at:
                        miss *= 0.4
                    labels = own | {r.label for _, _, r in found}
                    rows.append((
                        len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), 1 - miss,
                        [{"start": a, "end": z, "label": r.label, "priority": r.priority} for a, z, r in found],
                    ))
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.string()), pa.array(c[5], pa.string()), pa.array(c[6], pa.float64()), pa.array(c[7], spans)],
                    ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
                )

    out = in_small_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def op10_license_scan(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``; a null text is an empty one, without labels and with score 0."""
    return scan(docs).drop("detections")
