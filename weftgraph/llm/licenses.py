"""License scans: ordered signature rules behind a keyword prefilter.

A text is taken as its lower-cased words with single blanks between, so a rule's phrase meets any
punctuation and line breaks. Rules are built from hand-written tables of regular expressions: names
of licenses, each as a tag, where a text says that it is under that license, and alone; what the
licenses and their notices say themselves; their addresses. A rule runs only where its rarest keyword -
a piece of plain text that each of its matches must hold, all of them in one automaton - occurs.
What matches is then resolved in order of priority: a place that lies inside one already accepted,
of the same or a higher priority, is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a text whose A-Z are in lower case.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}

#: Fixed by contract: phrases and their labels, all places of which count.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licenses: label, names as regular expressions over words, tag in words. Versions are written as words.
LICENSES = (
    ("gpl-1.0", r"gnu general public license (?:version|v) ?1(?: 0)?|gpl ?v?1", "gpl 1 0"),
    ("gpl-2.0", r"gnu general public license (?:version|v) ?2(?: 0)?|gpl ?v?2", "gpl 2 0"),
    ("gpl-3.0", r"gnu general public license (?:version|v) ?3(?: 0)?|gpl ?v?3", "gpl 3 0"),
    ("lgpl-2.0", r"gnu library general public license(?: (?:version|v) ?2(?: 0)?)?", "lgpl 2 0"),
    ("lgpl-2.1", r"gnu lesser general public license (?:version|v) ?2 1|lgpl ?v?2 1", "lgpl 2 1"),
    ("lgpl-3.0", r"gnu lesser general public license (?:version|v) ?3(?: 0)?|lgpl ?v?3", "lgpl 3 0"),
    ("lgpl", r"gnu lesser general public license", "lgpl"),
    ("agpl-3.0", r"gnu affero general public license(?: (?:version|v) ?3(?: 0)?)?|agpl ?v?3", "agpl 3 0"),
    ("gfdl", r"gnu free documentation license", "gfdl 1 3"),
    ("apache-1.1", r"apache (?:software )?license (?:version )?1 1", "apache 1 1"),
    ("apache-2.0", r"apache (?:software )?license (?:version )?2(?: 0)?", "apache 2 0"),
    ("mit-0", r"mit no attribution(?: license)?", "mit 0"),
    ("x11", r"x11 license|mit x11", "x11"),
    ("isc", r"isc license|internet systems consortium license", "isc"),
    ("bsd-2-clause", r"bsd 2 clause(?: license)?|2 clause bsd(?: license)?|simplified bsd(?: license)?|freebsd(?: license)?", "bsd 2 clause"),
    ("bsd-3-clause", r"bsd 3 clause(?: license)?|3 clause bsd(?: license)?|new bsd(?: license)?|modified bsd(?: license)?|revised bsd(?: license)?", "bsd 3 clause"),
    ("bsd-4-clause", r"bsd 4 clause(?: license)?|4 clause bsd(?: license)?|original bsd(?: license)?", "bsd 4 clause"),
    ("0bsd", r"zero clause bsd(?: license)?", "0bsd"),
    ("bsd", r"bsd (?:style )?license", "bsd"),
    ("mpl-1.1", r"mozilla public license (?:version |v )?1 1", "mpl 1 1"),
    ("mpl-2.0", r"mozilla public license (?:version |v )?2(?: 0)?", "mpl 2 0"),
    ("mpl", r"mozilla public license", "mpl"),
    ("epl-1.0", r"eclipse public license (?:version |v )?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", r"eclipse public license (?:version |v )?2(?: 0)?", "epl 2 0"),
    ("epl", r"eclipse public license", "epl"),
    ("edl", r"eclipse distribution license", "edl 1 0"),
    ("cddl", r"common development and distribution license", "cddl 1 0"),
    ("cpl", r"common public license", "cpl 1 0"),
    ("ipl", r"ibm public license", "ipl 1 0"),
    ("apsl", r"apple public source license", "apsl 2 0"),
    ("eupl", r"european union public licen[cs]e", "eupl 1 2"),
    ("osl", r"open software license", "osl 3 0"),
    ("afl", r"academic free license", "afl 3 0"),
    ("artistic-2.0", r"artistic license (?:version )?2(?: 0)?", "artistic 2 0"),
    ("artistic", r"(?:clarified )?artistic license", "artistic 1 0"),
    ("boost", r"boost software license", "bsl 1 0"),
    ("zlib", r"zlib(?: libpng)? license", "zlib"),
    ("libpng", r"libpng license", "libpng"),
    ("openssl", r"openssl license", "openssl"),
    ("python", r"python software foundation license", "psf 2 0"),
    ("php", r"php license", "php 3 01"),
    ("ruby", r"ruby license", "ruby"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("unlicense", r"the unlicense|unlicense org", "unlicense"),
    ("wtfpl", r"do what the fuck you want to public license", "wtfpl"),
    ("beerware", r"beer ?ware license", "beerware"),
    ("ncsa", r"university of illinois ncsa open source license|ncsa open source license", "ncsa"),
    ("ms-pl", r"microsoft public license", "ms pl"),
    ("ms-rl", r"microsoft reciprocal license", "ms rl"),
    ("sil-ofl", r"sil open font license|open font license", "ofl 1 1"),
    ("odbl", r"open (?:data commons open )?database license", "odbl 1 0"),
    ("pddl", r"public domain dedication and license", "pddl 1 0"),
    ("odc-by", r"open data commons attribution license", "odc by 1 0"),
    ("bsl-1.1", r"business source license", "busl 1 1"),
    ("sspl", r"server side public license", "sspl 1 0"),
    ("elastic", r"elastic license", "elastic 2 0"),
    ("commons-clause", r"commons clause license", "commons clause"),
    ("upl", r"universal permissive license", "upl 1 0"),
    ("mulan", r"mulan permissive software license", "mulanpsl 2 0"),
    ("cecill", r"cecill(?: free software license)?", "cecill 2 1"),
    ("sleepycat", r"sleepycat license", "sleepycat"),
    ("vim", r"vim license", "vim"),
    ("w3c", r"w3c software (?:notice and )?license", "w3c"),
    ("icu", r"icu license", "icu"),
    ("unicode", r"unicode license", "unicode 3 0"),
    ("curl", r"curl license", "curl"),
    ("json", r"json license", "json"),
    ("hpnd", r"historical permission notice and disclaimer", "hpnd"),
    ("qpl", r"q public license", "qpl 1 0"),
    ("sissl", r"sun industry standards source license", "sissl"),
    ("watcom", r"sybase open watcom public license", "watcom 1 0"),
    ("nasa", r"nasa open source agreement", "nasa 1 3"),
    ("lppl", r"latex project public license", "lppl 1 3c"),
    ("fsl", r"functional source license", "fsl 1 1 mit"),
    ("openrail", r"open ?rail license|responsible ai license", "openrail"),
    ("llama", r"llama \d+ community license", "llama"),
    ("cc0", r"cc0(?: 1 0(?: universal)?)?|creative commons zero", "cc0 1 0"),
    ("cc-by-nc-nd", r"cc by nc nd(?: \d 0)?|creative commons attribution non ?commercial no ?deriv(?:ative)?s", "cc by nc nd 4 0"),
    ("cc-by-nc-sa", r"cc by nc sa(?: \d 0)?|creative commons attribution non ?commercial share ?alike", "cc by nc sa 4 0"),
    ("cc-by-nc", r"cc by nc(?: \d 0)?|creative commons attribution non ?commercial", "cc by nc 4 0"),
    ("cc-by-nd", r"cc by nd(?: \d 0)?|creative commons attribution no ?deriv(?:ative)?s", "cc by nd 4 0"),
    ("cc-by-sa", r"cc by sa(?: \d 0)?|creative commons attribution share ?alike", "cc by sa 4 0"),
    ("cc-by-4.0", r"cc by 4 0|creative commons attribution 4 0", "cc by 4 0"),
    ("cc-by-3.0", r"cc by 3 0|creative commons attribution 3 0", "cc by 3 0"),
    ("public-domain", r"(?:dedicated to|released into|in) the public domain", "public domain"),
    ("all-rights-reserved", r"all rights reserved", "all rights reserved"),
    ("proprietary", r"proprietary and confidential|confidential and proprietary", "proprietary"),
)

#: Names so short that they count only where a text says that it is under such a license, or as a tag.
SHORT = (
    ("gpl-2.0", r"gpl ?v?2(?: 0)?", "gpl 2 0 (?:only|or later)"),
    ("gpl-3.0", r"gpl ?v?3(?: 0)?", "gpl 3 0 (?:only|or later)"),
    ("lgpl-2.1", r"lgpl ?v?2 1", "lgpl 2 1 (?:only|or later)"),
    ("lgpl-3.0", r"lgpl ?v?3(?: 0)?", "lgpl 3 0 (?:only|or later)"),
    ("agpl-3.0", r"agpl ?v?3(?: 0)?", "agpl 3 0 (?:only|or later)"),
    ("gpl", r"(?:gnu )?gpl", "gpl"),
    ("lgpl", r"(?:gnu )?lgpl", "lgpl"),
    ("agpl", r"(?:gnu )?agpl", "agpl"),
    ("mit", r"mit|expat(?: license)?", "mit"),
    ("apache", r"apache", "apache"),
    ("bsd", r"bsd", "bsd"),
    ("isc", r"isc", "isc"),
    ("mpl", r"mpl", "mpl"),
    ("epl", r"epl", "epl"),
    ("cddl", r"cddl", "cddl"),
    ("eupl", r"eupl", "eupl"),
    ("cc-by", r"cc by|creative commons attribution", "cc by"),
    ("cc-by-sa", r"cc by sa", "cc by sa"),
    ("zlib", r"zlib", "zlib"),
    ("wtfpl", r"wtfpl", "wtfpl 2"),
    ("artistic", r"artistic", "artistic"),
    ("unlicense", r"unlicense", "unlicense"),
)

#: What the licenses and their notices themselves say, as regular expressions over words.
BODIES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("0bsd", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", r"this software is provided by the (?:\S+ ){1,10}as is and any express or implied warranties"),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", r"grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", r"is distributed in the hope that it will be useful but without any warranty without even the implied warranty"),
    ("gpl", r"you should have received a copy of the gnu general public license"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2.0", r"either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-2.0", r"you may copy and distribute verbatim copies of the program s source code as you receive it"),
    ("gpl-3.0", r"either version 3 of the license or (?:at your option )?any later version"),
    ("gpl-3.0", r"you may convey verbatim copies of the program s source code as you receive it"),
    ("lgpl", r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl-2.1", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2.1", r"either version 2 1 of the license or (?:at your option )?any later version"),
    ("lgpl-3.0", r"incorporates the terms and conditions of version 3 of the gnu general public license supplemented by"),
    ("lgpl-2.0", r"you should have received a copy of the gnu library general public license"),
    ("agpl-3.0", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("agpl-3.0", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", r"with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", r"the accompanying program is provided under the terms of this common public license"),
    ("apsl", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("osl", r"licensed under the open software license version 3 0"),
    ("afl", r"licensed under the academic free license version 3 0"),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", r"the png reference library is supplied as is"),
    ("boost", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", r"must be included in all copies of the software in whole or in part and all derivative works of the software"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", r"changing it is allowed as long as the name is changed"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("beerware", r"you can do whatever you want with this stuff if we meet some day"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied modified distributed"),
    ("ncsa", r"to deal with the software without restriction including without limitation the rights to use"),
    ("postgresql", r"this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("python", r"psf is making python available to licensee on an as is basis"),
    ("python", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", r"this product includes cryptographic software written by eric young"),
    ("php", r"this product includes php software freely available from"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("sil-ofl", r"the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("sil-ofl", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("cc0", r"has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide"),
    ("cc0", r"has waived all copyright and related or neighboring rights"),
    ("cc-by", r"this work is licensed under a creative commons attribution (?:\d 0 )?(?:international |unported |generic )?license"),
    ("cc-by-sa", r"this work is licensed under a creative commons attribution share ?alike"),
    ("cc-by-nc", r"this work is licensed under a creative commons attribution non ?commercial(?: \d 0)?(?: international)? license"),
    ("cc-by-nd", r"this work is licensed under a creative commons attribution no ?deriv(?:ative)?s"),
    ("odbl", r"any rights in individual contents of the database are licensed under the database contents license"),
    ("odbl", r"is made available under the open database license"),
    ("pddl", r"is made available under the public domain dedication and license"),
    ("odc-by", r"is made available under the open data commons attribution license"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("upl", r"to any person obtaining a copy of this software associated documentation and or data collectively the software"),
    ("eupl", r"this european union public licence the eupl applies to the work"),
    ("cecill", r"this agreement is a free software license agreement that is the result of discussions"),
    ("cecill", r"this software is governed by the cecill (?:b |c )?license under french law"),
    ("bsl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", r"the license does not grant to you the right to sell the software"),
    ("openrail", r"you agree not to use the model or derivatives of the model"),
    ("llama", r"by using or distributing any portion or element of the llama materials"),
    ("json", r"the software shall be used for good not evil"),
    ("vim", r"vim is charityware you can use and copy it as much as you like"),
    ("w3c", r"this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("unicode", r"to any person obtaining a copy of the unicode data files and any associated documentation"),
    ("lppl", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("mulan", r"is licensed under mulan psl v2 you can use this software according to the terms and conditions"),
    ("nasa", r"this open source agreement agreement defines the rights of use reproduction distribution modification and redistribution"),
    ("watcom", r"subject to the sybase open watcom public license"),
    ("fsl", r"a permitted purpose is any purpose other than a competing use"),
    ("public-domain", r"(?:the )?authors? (?:of this \S+ )?disclaims? copyright to this source code"),
    ("public-domain", r"this (?:file|work|code|software) has been placed in(?:to)? the public domain"),
    ("proprietary", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
    ("proprietary", r"is the confidential and proprietary information of"),
    ("proprietary", r"no part of this (?:publication|document|book|work) may be reproduced"),
    ("proprietary", r"may not be (?:copied|reproduced|distributed|disclosed) without (?:the )?(?:prior |express )*written (?:permission|consent)"),
)

#: Addresses of licenses, as their words.
ADDRESSES = (
    ("apache-2.0", r"apache org licenses license 2 0|opensource org licenses? apache 2 0"),
    ("apache-1.1", r"apache org licenses license 1 1"),
    ("mit", r"opensource org licenses? mit|spdx org licenses mit|choosealicense com licenses mit|mit license org"),
    ("mit-0", r"opensource org licenses? mit 0|github com aws mit 0"),
    ("isc", r"opensource org licenses? isc"),
    ("bsd-2-clause", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", r"opensource org licenses? bsd 3 clause"),
    ("bsd", r"opensource org licenses? bsd license"),
    ("gpl-2.0", r"gnu org (?:licenses )?old licenses gpl 2 0|opensource org licenses? gpl 2 0"),
    ("gpl-3.0", r"gnu org (?:licenses|copyleft) gpl 3 0|opensource org licenses? gpl 3 0"),
    ("gpl", r"gnu org (?:licenses|copyleft) gpl"),
    ("lgpl-2.1", r"gnu org (?:licenses )?old licenses lgpl 2 1|opensource org licenses? lgpl 2 1"),
    ("lgpl-3.0", r"gnu org (?:licenses|copyleft) lgpl 3 0|opensource org licenses? lgpl 3 0"),
    ("lgpl", r"gnu org (?:licenses|copyleft) lgpl"),
    ("agpl-3.0", r"gnu org licenses agpl|opensource org licenses? agpl 3 0"),
    ("gfdl", r"gnu org (?:licenses|copyleft) fdl"),
    ("mpl-2.0", r"mozilla org (?:en us )?mpl 2 0|opensource org licenses? mpl 2 0"),
    ("mpl-1.1", r"mozilla org mpl mpl 1 1|mozilla org (?:en us )?mpl 1 1"),
    ("epl-1.0", r"eclipse org legal epl v10|opensource org licenses? epl 1 0"),
    ("epl-2.0", r"eclipse org legal epl (?:v20|2 0)|opensource org licenses? epl 2 0"),
    ("edl", r"eclipse org org documents edl v10"),
    ("cddl", r"opensource org licenses? cddl|glassfish dev java net public cddl"),
    ("boost", r"boost org license 1 0"),
    ("zlib", r"zlib net zlib license|opensource org licenses? zlib"),
    ("artistic-2.0", r"perlfoundation org artistic license 2 0|opensource org licenses? artistic 2 0"),
    ("cc0", r"creativecommons org (?:publicdomain|licenses) zero 1 0"),
    ("public-domain", r"creativecommons org (?:publicdomain mark|licenses publicdomain)"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc", r"creativecommons org licenses by nc"),
    ("cc-by-nd", r"creativecommons org licenses by nd"),
    ("cc-by-sa", r"creativecommons org licenses by sa"),
    ("cc-by-4.0", r"creativecommons org licenses by 4 0"),
    ("cc-by-3.0", r"creativecommons org licenses by 3 0"),
    ("cc-by-2.0", r"creativecommons org licenses by 2 [05]"),
    ("unlicense", r"unlicense org"),
    ("wtfpl", r"wtfpl net"),
    ("sil-ofl", r"scripts sil org ofl|openfontlicense org"),
    ("odbl", r"opendatacommons org licenses odbl"),
    ("pddl", r"opendatacommons org licenses pddl"),
    ("odc-by", r"opendatacommons org licenses by"),
    ("eupl", r"joinup ec europa eu \S+ eupl|eupl eu 1 [12]"),
    ("python", r"python org psf license|docs python org \d license"),
    ("php", r"php net license"),
    ("postgresql", r"postgresql org about licen[cs]e"),
    ("upl", r"oss oracle com licenses upl"),
    ("elastic", r"elastic co licensing elastic license"),
    ("bsl-1.1", r"mariadb com bsl11"),
    ("sspl", r"mongodb com licensing server side public license"),
    ("ms-pl", r"opensource org licenses? ms pl"),
    ("cecill", r"cecill info licences"),
    ("lppl", r"latex project org lppl"),
    ("json", r"json org license"),
    ("llama", r"(?:llama|ai) meta com llama\S* license"),
)

GRANTS = ("licensed", "released", "distributed", "available", "provided", "published", "redistributed")
#: How a text says that a license holds; {} is the name. Priority falls from one to the next.
FRAMES = (
    ("tag", 4, r"spdx license identifier (?:lic)?{}"),
    ("grant", 3, rf"(?:{'|'.join(GRANTS)}) under (?:the |an? )?(?:terms of )?(?:the )?(?:{{}})"),
    ("terms", 2, r"(?:under the terms of|subject to the terms of|governed by|covered by) (?:the )?(?:{})"),
    ("name", 1, r"(?:{})"),
)
#: Priorities of bodies and addresses. Base phrases stand above all rules, and each weighs its priority in the score as rules do.
BODY_PRIORITY, ADDRESS_PRIORITY, BASE_PRIORITY = 3, 2, 5


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern


def _keywords(name: str) -> tuple[str, ...]:
    """For each alternative of a name the longest run of plain text that its matches must hold."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(name + "|"):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "|" and not depth:
            part = re.sub(r"\((?:[^()]|\([^()]*\))*\)(?:\{[^}]*\}|[?*])?|\[[^]]*\]\??|\\[dS][+*]?|.\?", "\n", name[start:i])
            out.append(max(part.split("\n"), key=len).strip())
            start = i + 1
    return tuple(out)


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All signature rules, by descending priority, then in the order of the tables."""
    out = []

    def add(label: str, priority: int, held: tuple[str, ...], pattern: str) -> None:
        out.append(Rule(label, priority, held, re.compile(rf"(?<= )(?:{pattern})(?= )")))

    for kind, priority, frame in FRAMES:
        for label, name, tag in LICENSES + (SHORT if priority > 2 else ()):
            if kind == "tag":
                add(label, priority, ("spdx license identifier",), frame.replace("{}", tag))
            else:
                held = _keywords(name)
                # short names are gated by what stands before them
                add(label, priority, held if min(map(len, held)) > 4 else tuple(f"{x} under" for x in GRANTS) if kind == "grant" else held, frame.replace("{}", name))
        if priority == BODY_PRIORITY:
            for label, pattern in BODIES:
                add(label, priority, _keywords(pattern), pattern)
        if priority == ADDRESS_PRIORITY:
            for label, pattern in ADDRESSES:
                add(label, priority, _keywords(pattern), pattern)
    return tuple(out)


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        for k in rule.keywords:
            found.setdefault(k, []).append(i)
    for phrase in BASE:
        found.setdefault(f" {phrase} ", []).append(-1)
    automaton = ahocorasick.Automaton()
    for k, gated in found.items():
        automaton.add_word(k, (k, tuple(gated)))
    automaton.make_automaton()
    return automaton


def scan(text: str | None) -> dict:
    """What one text holds: counts, places of base phrases, accepted detections (label, first word, end) and score."""
    tokens = WORDS.findall((text or "").translate(LOWER) if not (text or "").isascii() else (text or "").lower())
    joined = f" {' '.join(tokens)} "
    base, gated = [], set()
    for end, (key, which) in _automaton().iter(joined):
        for i in which:
            if i < 0:
                base.append((end - len(key) + 1, end, BASE[key[1:-1]]))
            else:
                gated.add(i)
    # places in code points; a place's words begin after a blank
    found = [(BASE_PRIORITY, start + 1, end, label) for start, end, label in base]
    for i in sorted(gated):
        rule = rules()[i]
        found += [(rule.priority, m.start(), m.end(), rule.label) for m in rule.pattern.finditer(joined)]
    accepted = _resolve([x for x in found if x[0] < BASE_PRIORITY])
    begins = list(accumulate((len(t) + 1 for t in tokens), initial=1))
    word = lambda at: bisect_left(begins, at)
    places = sorted(word(start + 1) for start, _, _ in base)
    detections = sorted((word(start), word(end + 1), label) for _, start, end, label in accepted)
    base_labels = sorted({label for _, _, label in base})
    miss = 1.0
    for priority in [BASE_PRIORITY] * len(base_labels) + [x[0] for x in accepted]:
        miss *= 1 - 0.18 * priority
    return {
        "n_words": len(tokens), "n_base": len(base), "first_word": places[0] if places else None, "last_word": places[-1] if places else None,
        "base_labels": base_labels, "labels": sorted({*base_labels, *(x[2] for x in detections)}), "score": 1 - miss, "detections": detections,
    }


def _resolve(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Without the places that lie inside a longer or prior one of the same or a higher priority; equal places: the first rule stays."""
    accepted: list[tuple[int, int, int, str]] = []
    starts: list[int] = []
    reach: list[int] = []  # greatest end among the accepted that start no later
    for x in sorted(found, key=lambda x: (-x[0], x[1] - x[2])):
        at = bisect_right(starts, x[1])
        if at and reach[at - 1] >= x[2]:
            continue
        accepted.append(x)
        starts.insert(at, x[1])
        reach.insert(at, x[2])
        top = reach[at - 1] if at else 0
        for j in range(at, len(reach)):
            top = max(top, reach[j])
            if reach[j] == top and j > at:
                break
            reach[j] = top
    return accepted


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Null texts count as empty: no words, no labels, score 0. Very long texts are scanned whole, in
    time that grows with their length. Of two rules that match the same place with the same priority
    the first in the tables stays. Repeated rows each get a row; an empty table gives none. Other
    columns are not read.
    """
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType())]))
    labels = T.ArrayType(T.StringType())
    kinds = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": labels, "labels": labels, "score": T.DoubleType(), "detections": span}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, k) for n, k in kinds.items())])
    arrow = {"base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "score": pa.float64(), "detections": pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x.as_py()) for x in batch.column(1)]
            for r in rows:
                r["detections"] = [dict(zip(("first", "end", "label"), d)) for d in r["detections"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], arrow.get(n, pa.int64())) for n in kinds)], names=[id_col, *kinds])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
