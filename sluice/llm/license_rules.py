"""Signature rules of the license scan.

A rule is written over normalised text: lower-case words joined by one space. Each line of a family is a pattern; its
keyword is the longest plain run of characters that each match must hold. Families stand in order of
priority: where two detections overlap, the longer one stays, and of two that cover as many words the earlier one.
``{n}`` stands for a version number such as ``2 0``. Confidence is given for each family of signature.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Full notices and grants: long wording that only the license itself holds.
NOTICES = {
    "mit": """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        in no event shall the authors or copyright holders be liable for any claim damages or other liability
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish
    """,
    "mit-0": """
        permission is hereby granted free of charge to any person obtaining a copy of this software (?:\\w+ ){0,40}without restriction (?:\\w+ ){0,40}permit persons to whom the software is furnished to do so the software is provided
        mit no attribution
    """,
    "apache-2.0": """
        licensed under the apache license version 2 0
        you may not use this file except in compliance with the license
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        see the license for the specific language governing permissions and limitations under the license
        apache org licenses license 2 0
        apache license version 2 0 january 2004
    """,
    "apache-1.1": """
        the apache software license version 1 1
        products derived from this software may not be called apache
        this product includes software developed by the apache software foundation
    """,
    "gpl": """
        this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
        this (?:\\w+ ){1,4}is free software you can redistribute it and or modify it under the terms of the gnu general public license
        you should have received a copy of the gnu general public license
        under the terms of the gnu general public license as published by the free software foundation
        either version [123] of the license or at your option any later version
        gnu org licenses gpl
        the gnu general public license is a free copyleft license
    """,
    "lgpl": """
        under the terms of the gnu (?:lesser|library) general public license
        you should have received a copy of the gnu (?:lesser|library) general public license
        gnu org licenses lgpl
        this library is free software you can redistribute it
    """,
    "agpl": """
        under the terms of the gnu affero general public license
        you should have received a copy of the gnu affero general public license
        gnu org licenses agpl
    """,
    "gfdl": """
        permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
        with no invariant sections no front cover texts and no back cover texts
        gnu org licenses fdl
    """,
    "bsd": """
        redistribution and use in source and binary forms with or without modification are permitted
        redistributions of source code must retain the above copyright notice
        redistributions in binary form must reproduce the above copyright notice
        this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is
    """,
    "bsd-3-clause": """
        neither the name of (?:\\w+ ){1,12}nor the names of its contributors may be used to endorse
        neither the name of the copyright holder nor the names of its contributors
    """,
    "bsd-4-clause": """
        all advertising materials mentioning features or use of this software must display
    """,
    "isc": """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        the software is provided as is and the author disclaims all warranties with regard to this software
    """,
    "mpl-2.0": """
        this source code form is subject to the terms of the mozilla public license v 2 0
        if a copy of the mpl was not distributed with this file you can obtain one at
        mozilla org mpl 2 0
    """,
    "mpl-1.1": """
        the contents of this file are subject to the mozilla public license version 1 1
        mozilla org mpl mpl 1 1
    """,
    "epl": """
        this program and the accompanying materials are made available under the terms of the eclipse public license
        eclipse org legal epl
        eclipse org org documents epl
    """,
    "cddl": """
        the contents of this file are subject to the terms of the common development and distribution license
        opensource org licenses cddl
    """,
    "unlicense": """
        this is free and unencumbered software released into the public domain
        anyone is free to copy modify publish use compile sell or distribute this software
        unlicense org
    """,
    "wtfpl": """
        do what the fuck you want to public license
        everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
    """,
    "zlib": """
        this software is provided as is without any express or implied warranty in no event will the authors be held liable
        the origin of this software must not be misrepresented
        altered source versions must be plainly marked as such
    """,
    "boost": """
        distributed under the boost software license version 1 0
        boost org license 1 0 txt
        permission is hereby granted free of charge to any person or organization obtaining a copy of the software
    """,
    "artistic": """
        the intent of this document is to state the conditions under which a package may be copied
        perl foundation org artistic license
    """,
    "cc0": """
        creativecommons org publicdomain zero 1 0
        to the extent possible under law (?:\\w+ ){1,10}has waived all copyright
        the person who associated a work with this deed has dedicated the work to the public domain
    """,
    "cc-by": """
        creativecommons org licenses by [1234] 0
        licensed under (?:a |the )?creative commons attribution (?:{n} )?(?:international |generic |unported )?(?:license|licence)
    """,
    "cc-by-sa": """
        creativecommons org licenses by sa [1234]
        creative commons attribution share ?alike
    """,
    "cc-by-nc": """
        creativecommons org licenses by nc [1234]
        creative commons attribution non ?commercial (?:{n}|license|licence|international)
    """,
    "cc-by-nd": """
        creativecommons org licenses by nd [1234]
        creative commons attribution no ?deriv
    """,
    "cc-by-nc-sa": """
        creativecommons org licenses by nc sa
        creative commons attribution non ?commercial share ?alike
    """,
    "cc-by-nc-nd": """
        creativecommons org licenses by nc nd
        creative commons attribution non ?commercial no ?deriv
    """,
    "proprietary": """
        all rights reserved (?:\\w+ ){0,6}(?:no part|unauthorized|unauthorised|may not|reproduction)
        no part of this (?:publication|book|work|document|website) may be reproduced
        unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:\\w+ ){0,8}(?:is )?strictly prohibited
        this (?:software|document|file) is (?:the )?(?:confidential and )?proprietary
        confidential and proprietary information of
    """,
    "openrail": """
        open rail m license
        creativeml open rail
        bigscience open rail
    """,
    "llama": """
        llama [23] community license agreement
        is licensed under the llama [23] community license
    """,
    "odc-by": """
        open data commons attribution license
        opendatacommons org licenses by
    """,
    "odbl": """
        open data commons open database license
        opendatacommons org licenses odbl
    """,
    "pddl": """
        open data commons public domain dedication and licen[cs]e
        opendatacommons org licenses pddl
    """,
    "ogl-uk": """
        contains public sector information licensed under the open government licen[cs]e
        nationalarchives gov uk doc open government licence
    """,
    "ofl": """
        this font software is licensed under the sil open font license
        scripts sil org ofl
    """,
    "python": """
        python software foundation license version 2
        psf is making python available to licensee on an as is basis
    """,
    "openssl": """
        this product includes software developed by the openssl project
    """,
    "public-domain": """
        (?:is|are|was|been|released|placed|dedicated) (?:hereby )?(?:in|into|to) the public domain
        public domain dedication
        no rights reserved
        no known copyright
    """,
}

#: Names in references such as "released under the ... license"; an alternative a line.
NAMES = {
    "mit": "mit license\nmit licence\nexpat license\nmit x11 license\nmit style license\nlicense mit",
    "apache-2.0": "apache 2 0 licen[cs]e\napache licen[cs]e v? ?2(?: 0)?\napache 2 licen[cs]e\napache licen[cs]e version 2\nasl 2 0\nal 2 0",
    "apache-1.1": "apache licen[cs]e (?:version )?1 1\napache software licen[cs]e 1 1",
    "apache": "apache licen[cs]e\napache software licen[cs]e",
    "agpl-3.0": "agpl ?v? ?3\ngnu affero general public licen[cs]e (?:version |v ?)?3\naffero general public licen[cs]e version 3",
    "agpl": "gnu agpl\naffero general public licen[cs]e\nagpl licen[cs]e",
    "lgpl-2.1": "lgpl ?v? ?2 1\n(?:lesser|library) general public licen[cs]e (?:version |v ?)?2 1",
    "lgpl-3.0": "lgpl ?v? ?3\nlesser general public licen[cs]e (?:version |v ?)?3",
    "lgpl": "gnu lgpl\n(?:lesser|library) general public licen[cs]e\nlgpl licen[cs]e\nlgpl",
    "gpl-2.0": "gpl ?v? ?2\ngeneral public licen[cs]e (?:version |v ?)?2\ngnu gpl (?:version )?2",
    "gpl-3.0": "gpl ?v? ?3\ngeneral public licen[cs]e (?:version |v ?)?3\ngnu gpl (?:version )?3",
    "gpl": "gnu gpl\ngeneral public licen[cs]e\ngpl licen[cs]e\ngpl compatible\nunder the gpl",
    "gfdl": "free documentation licen[cs]e\ngfdl",
    "bsd-2-clause": "(?:2|two) clause bsd\nbsd (?:2|two) clause\nsimplified bsd licen[cs]e\nfreebsd licen[cs]e",
    "bsd-3-clause": "(?:3|three) clause bsd\nbsd (?:3|three) clause\nnew bsd licen[cs]e\nmodified bsd licen[cs]e\nrevised bsd licen[cs]e",
    "bsd-4-clause": "(?:4|four) clause bsd\nbsd (?:4|four) clause\noriginal bsd licen[cs]e",
    "bsd": "bsd licen[cs]e\nbsd style licen[cs]e\nberkeley software distribution",
    "isc": "isc licen[cs]e\nisc style licen[cs]e",
    "mpl-2.0": "mozilla public licen[cs]e (?:version |v ?)?2\nmpl ?v? ?2(?: 0)?",
    "mpl": "mozilla public licen[cs]e\nmpl licen[cs]e",
    "epl-2.0": "eclipse public licen[cs]e (?:version |v ?)?2\nepl ?v? ?2",
    "epl": "eclipse public licen[cs]e\neclipse distribution licen[cs]e",
    "eupl": "european union public licen[cs]e\neupl",
    "cddl": "common development and distribution licen[cs]e\ncddl",
    "cpl": "common public licen[cs]e",
    "ms-pl": "microsoft public licen[cs]e\nms pl",
    "ms-rl": "microsoft reciprocal licen[cs]e\nms rl",
    "unlicense": "the unlicense\nunlicense license",
    "wtfpl": "wtfpl\ndo what the f\\w* you want to public licen[cs]e",
    "zlib": "zlib licen[cs]e\nzlib libpng licen[cs]e\nlibpng licen[cs]e",
    "boost": "boost software licen[cs]e\nboost licen[cs]e\nbsl 1 0",
    "artistic": "artistic licen[cs]e(?: {n})?\nperl artistic licen[cs]e",
    "cc0": "cc0(?: 1 0)?\ncc zero\ncreative commons zero\npublic domain mark",
    "cc-by-nc-nd": "cc by nc nd(?: {n})?\nattribution noncommercial noderiv\\w*",
    "cc-by-nc-sa": "cc by nc sa(?: {n})?\nattribution noncommercial sharealike",
    "cc-by-nc": "cc by nc(?: {n})?\nattribution noncommercial",
    "cc-by-nd": "cc by nd(?: {n})?\nattribution noderiv\\w*",
    "cc-by-sa": "cc by sa(?: {n})?\nattribution sharealike",
    "cc-by": "cc by(?: {n})?\ncreative commons attribution(?: {n})?",
    "cc": "creative commons licen[cs]e\nunder a creative commons\nsome rights reserved",
    "odbl": "open database licen[cs]e\nodbl",
    "odc-by": "odc by",
    "pddl": "pddl",
    "ogl-uk": "open government licen[cs]e",
    "etalab": "licence ouverte\netalab",
    "dl-de": "datenlizenz deutschland",
    "ofl": "sil open font licen[cs]e\nopen font licen[cs]e",
    "python": "python software foundation licen[cs]e\npsf licen[cs]e",
    "ruby": "ruby licen[cs]e\nruby s licen[cs]e",
    "php": "php licen[cs]e",
    "openssl": "openssl licen[cs]e",
    "ssleay": "ssleay licen[cs]e",
    "curl": "curl licen[cs]e",
    "ntp": "ntp licen[cs]e",
    "postgresql": "postgresql licen[cs]e",
    "vim": "vim licen[cs]e\ncharityware",
    "beerware": "beer ?ware licen[cs]e\nbeer ware",
    "json": "the software shall be used for good not evil\njson licen[cs]e",
    "w3c": "w3c software (?:notice and )?licen[cs]e\nw3c licen[cs]e",
    "unicode": "unicode licen[cs]e\nunicode inc licen[cs]e agreement",
    "afl": "academic free licen[cs]e",
    "osl": "open software licen[cs]e",
    "apsl": "apple public source licen[cs]e",
    "nasa": "nasa open source agreement",
    "qpl": "q public licen[cs]e",
    "sleepycat": "sleepycat licen[cs]e",
    "upl": "universal permissive licen[cs]e",
    "bluoak": "blue oak model licen[cs]e",
    "mulan": "mulan permissive software licen[cs]e\nmulan psl",
    "sspl": "server side public licen[cs]e\nsspl",
    "busl": "business source licen[cs]e",
    "elastic": "elastic licen[cs]e",
    "commons-clause": "commons clause",
    "polyform": "polyform (?:noncommercial|shield|strict|small business|internal use|perimeter) licen[cs]e",
    "openrail": "openrail\\+*m?\\+*\nopenrail licen[cs]e",
    "llama": "llama [23](?: [0-9])? licen[cs]e",
    "gemma": "gemma terms of use",
    "proprietary": "all rights reserved\ntous droits r\\S+serv\\S+s\nalle rechte vorbehalten\ntodos los derechos reservados\nproprietary licen[cs]e\nend user licen[cs]e agreement",
}

#: Identifiers of the tag "SPDX-License-Identifier: ...", as normalised words, and their labels where these differ.
SPDX = "0bsd afl-3.0 agpl-3.0 apache-1.1 apache-2.0 apsl-2.0 artistic-2.0 blueoak-1.0.0 bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cecill-2.1 cpl-1.0 ecl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 odc-by-1.0 ofl-1.1 openssl osl-3.0 pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sspl-1.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1".split()

#: The base phrases and labels of the scan's contract; their places are all counted, and suppression leaves them alone.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

CONFIDENCE = {"tag": 1.0, "notice": 0.9, "reference": 0.7, "base": 0.5}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int  # smaller wins
    keyword: bytes
    pattern: re.Pattern


def keyword_of(pattern: str) -> bytes:
    """The longest run of plain characters that each match must hold."""
    plain = re.sub(r"\(\?:[^()]*\)[?*]?(?:\{[^}]*\})?|\[[^\]]*\]|\\\S+|\S\?| \?", "\0", pattern)
    return max(plain.split("\0"), key=lambda run: (len(run), run)).strip().encode()


def gates(keywords: list[bytes]) -> dict[bytes, list[bytes]]:
    """A few words, and for each the keywords that hold it: a text without any of the words holds no keyword."""
    left, out = sorted(set(keywords)), {}
    while left:
        words = {w for k in left for w in k.split() if len(w) > 4} or set(left)
        best = max(sorted(words), key=lambda w: (sum(w in k for k in left), len(w)))
        out[best] = [k for k in left if best in k]
        left = [k for k in left if best not in k]
    return out


def compile_rules() -> tuple[Rule, ...]:
    """All rules by priority: tags, notices, references, base phrases."""
    out: list[Rule] = []

    def add(label: str, kind: str, pattern: str) -> None:
        pattern = pattern.strip().replace("{n}", r"[0-9](?: [0-9])?")
        out.append(Rule(label, kind, len(out), keyword_of(pattern), re.compile(rb"(?<= )" + pattern.encode() + rb"(?= )")))

    for name in sorted(SPDX, key=lambda x: (-len(x), x)):
        add(name, "tag", rf"spdx license identifier {re.sub('[^a-z0-9]+', ' ', name)}(?: only| or later)?")
    for kind, families in (("notice", NOTICES), ("reference", NAMES)):
        for label, lines in families.items():
            for line in lines.strip().split("\n"):
                add(label, kind, line)
    for phrase, label in BASE:
        add(label, "base", phrase)
    return tuple(out)
