"""Signature rules of licenses: sentences of their own, and forms in which their names are cited.

A rule is a regular expression on words of lower case joined by one space, with a keyword that every match contains. Rules
of a smaller priority go ahead of others; confidence is what a detection is worth.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    confidence: float
    keyword: str
    regex: str


#: Phrases whose every place counts, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label | keyword | regex of a sentence of the license's own text.
SENTENCES = """
mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy(?: of this software(?: and associated documentation files)?)?
mit | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | without restriction including without limitation the rights to use copy modify | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so(?! subject)
isc | permission to use copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | for any purpose with or without fee is hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
bsd-2-clause | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | may be used to endorse or promote products | neither the names? of(?: [^ ]+){1,12} may be used to endorse or promote products derived from this software
bsd-4-clause | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledg
bsd-3-clause-clear | no express or implied licenses to any party | no express or implied licenses to any party s patent rights are granted
apache-2.0 | you may not use this file except in compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0 | each contributor hereby grants to you a perpetual | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide
apache-1.1 | products derived from this software may not be called apache | products derived from this software may not be called apache nor may apache appear in their name
gpl-3.0-or-later | either version 3 of the license or | (?:gnu )?general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
gpl-2.0-or-later | either version 2 of the license or | (?:gnu )?general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
gpl-3.0 | the gnu general public license is a free copyleft license | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-2.0 | the licenses for most software are designed to take away | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | see the gnu general public license for more details | see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see
lgpl-2.1-or-later | either version 2 1 of the license or | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version
lgpl-3.0-or-later | gnu lesser general public license as published | gnu lesser general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
agpl-3.0-or-later | gnu affero general public license as published | gnu affero general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
agpl-3.0 | remote network interaction use with the gnu general public license | remote network interaction use with the gnu general public license
mpl-2.0 | this source code form is subject to the terms of the mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | the contents of this file are subject to the mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | accompanying materials are made available under the terms of the eclipse | accompanying materials are made available under the terms of the eclipse public license (?:v |version )?v?1 0
epl-2.0 | accompanying materials are made available under the terms of the eclipse | accompanying materials are made available under the terms of the eclipse public license (?:v |version )?v?2(?: 0)?
cddl-1.0 | common development and distribution license the license | the contents of this file are subject to the terms of the common development and distribution license the license
unlicense | free and unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
wtfpl | you just do what the fuck you want to | you just do what the fuck you want to
zlib | in no event will the authors be held liable | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1.0 | obtaining a copy of the software and accompanying documentation covered | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
cc0-1.0 | to the extent possible under law | to the extent possible under law(?: [^ ]+){1,12} (?:has|have) waived all copyright and related or neighboring rights
cc-by | you are free to share copy and redistribute the material | you are free to share copy and redistribute the material in any medium or format
cc-by-nc | you may not use the material for commercial purposes | you may not use the material for commercial purposes
cc-by-nd | you may not distribute the modified material | if you remix transform or build upon the material you may not distribute the modified material
cc-by-sa | you must distribute your contributions under the same license | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
ofl-1.1 | this font software is licensed under the sil open font license | this font software is licensed under the sil open font license version 1 1
postgresql | permission to use copy modify and distribute this software and its documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
python-2.0 | python software foundation license version 2 | python software foundation license version 2
php-3.01 | this product includes php software | this product includes php software freely available from
beerware | you can buy me a beer in return | if we meet some day and you think this stuff is worth it you can buy me a beer in return
artistic-2.0 | everyone is permitted to copy and distribute verbatim copies of this license document | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes the terms
proprietary | unauthorized copying of this file | unauthorized copying of this file via any medium is strictly prohibited
proprietary | proprietary and confidential | (?:this (?:file|software|document) is )?proprietary and confidential
all-rights-reserved | all rights reserved | (?:copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){0,6}?)?all rights reserved
public-domain | public domain | (?:is|are|been)(?: hereby)? (?:in|placed in|released into|dedicated to) the public domain
"""

#: label | keyword | regex of the name | versions, of which each makes rules of its own.
NAMES = """
gpl | general public license | (?:gnu )?general public license(?: gpl)? | 1.0 2.0 3.0
gpl | gpl | (?:gnu )?gpl | 1.0 2.0 3.0
lgpl | general public license | (?:gnu )?(?:lesser|library) general public license(?: lgpl)? | 2.0 2.1 3.0
lgpl | lgpl | (?:gnu )?lgpl | 2.0 2.1 3.0
agpl | general public license | (?:gnu )?affero general public license(?: agpl)? | 1.0 3.0
agpl | agpl | (?:gnu )?agpl | 1.0 3.0
gfdl | free documentation license | (?:gnu )?free documentation license | 1.1 1.2 1.3
apache | apache license | apache license | 1.0 1.1 2.0
apache | apache software license | apache software license | 1.0 1.1 2.0
apache-2.0 | apache 2 0 | apache 2 0 |
mit | mit license | mit license |
mit | expat license | expat license |
mit | mit x11 | mit x11(?: license)? |
x11 | x11 license | x11 license |
isc | isc license | isc license |
bsd | bsd license | (?:(?:new|modified|revised|simplified|original) )?bsd license |
bsd-2-clause | bsd 2 clause | bsd 2 clause(?: license)? |
bsd-2-clause | clause bsd | (?:2|two) clause bsd(?: license)? |
bsd-3-clause | bsd 3 clause | bsd 3 clause(?: license)? |
bsd-3-clause | clause bsd | (?:3|three) clause bsd(?: license)? |
bsd-4-clause | clause bsd | (?:4|four) clause bsd(?: license)? |
mpl | mozilla public license | mozilla public license(?: mpl)? | 1.0 1.1 2.0
mpl | mpl | mpl | 1.1 2.0
epl | eclipse public license | eclipse public license(?: epl)? | 1.0 2.0
cddl | common development and distribution license | common development and distribution license(?: cddl)? | 1.0 1.1
cpl | common public license | common public license | 0.5 1.0
ipl | ibm public license | ibm public license | 1.0
eupl | european union public licen | european union public licen[sc]e(?: eupl)? | 1.0 1.1 1.2
cecill | cecill | cecill(?: free software)?(?: license)?(?: agreement)? | 1.0 2.0 2.1
osl | open software license | open software license | 1.0 2.0 2.1 3.0
afl | academic free license | academic free license | 1.1 2.0 2.1 3.0
artistic | artistic license | (?:perl )?artistic license | 1.0 2.0
bsl | boost software license | boost software license | 1.0
busl | business source license | business source license | 1.1
sspl | server side public license | server side public license | 1.0
elastic | elastic license | elastic license | 1.0 2.0
zlib | zlib | zlib(?: libpng)? license |
ofl | open font license | (?:sil )?open font license(?: ofl)? | 1.0 1.1
ncsa | ncsa open source license | (?:university of illinois )?ncsa open source license |
psf | python software foundation license | python software foundation license | 2.0
php | php license | php license | 3.0 3.01
ruby | ruby license | ruby license |
postgresql | postgresql license | postgresql license |
openssl | openssl license | openssl license |
wtfpl | wtfpl | wtfpl |
wtfpl | do what the fuck you want to public license | do what the fuck you want to public license |
unlicense | the unlicense | the unlicense |
ms-pl | microsoft public license | microsoft public license(?: ms pl)? |
ms-rl | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)? |
odbl | open database license | (?:odc )?open database license(?: odbl)? | 1.0
odc-by | open data commons attribution license | open data commons attribution license | 1.0
pddl | public domain dedication and license | public domain dedication and license | 1.0
cc0 | cc0 | cc0 | 1.0
cc-by | cc by | cc by | 1.0 2.0 2.5 3.0 4.0
cc-by-sa | cc by sa | cc by sa | 1.0 2.0 2.5 3.0 4.0
cc-by-nc | cc by nc | cc by nc | 1.0 2.0 2.5 3.0 4.0
cc-by-nd | cc by nd | cc by nd | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-sa | cc by nc sa | cc by nc sa | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-nd | cc by nc nd | cc by nc nd | 1.0 2.0 2.5 3.0 4.0
cc-by | creative commons attribution | creative commons attribution | 1.0 2.0 2.5 3.0 4.0
cc-by-sa | creative commons attribution share | creative commons attribution share ?alike | 1.0 2.0 2.5 3.0 4.0
cc-by-nc | creative commons attribution non | creative commons attribution non ?commercial | 1.0 2.0 2.5 3.0 4.0
cc-by-nd | creative commons attribution no | creative commons attribution no ?deriv(?:ative)?s?(?: works)? | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-sa | creative commons attribution non | creative commons attribution non ?commercial share ?alike | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-nd | creative commons attribution non | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? | 1.0 2.0 2.5 3.0 4.0
openrail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)? |
"""

GRANT = "(?:licen[sc]ed|released|distributed|available|published|provided|offered|redistributed|covered|governed) (?:under|by|according to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
LATER = " (?:or|and)(?: at your option)?(?: any)? (?:later|newer|higher)(?: versions?)?"


def _rows(text: str) -> list[list[str]]:
    return [[cell.strip() for cell in f"{line} ".split(" | ")] for line in text.strip().splitlines()]


def _version(v: str) -> str:
    whole, _, part = v.partition(".")
    return rf"(?:license )?(?:version |ver |v )?v?{whole}" + (f"(?: {part})?" if part == "0" else f" {part}")


def rules() -> list[Rule]:
    """All rules, in order of priority and, within it, of the tables."""
    out = [Rule(f"sentence-{i}", label, 1, 1.0, keyword, regex) for i, (label, keyword, regex) in enumerate(_rows(SENTENCES))]
    tags = {}
    for i, (label, keyword, name, *versions) in enumerate(_rows(NAMES)):
        each = versions[0].split() if versions else []
        for v in each:
            full, cited = f"{label}-{v}", f"{name} {_version(v)}"
            out += [Rule(f"grant-later-{i}-{v}", f"{full}-or-later", 2, 0.95, keyword, GRANT + cited + LATER), Rule(f"grant-{i}-{v}", full, 2, 0.95, keyword, GRANT + cited)]
            out += [Rule(f"name-later-{i}-{v}", f"{full}-or-later", 3, 0.8, keyword, cited + LATER), Rule(f"name-{i}-{v}", full, 3, 0.8, keyword, cited)]
            tags[full] = None
        out += [Rule(f"grant-{i}", label, 4, 0.7, keyword, f"{GRANT}{name}"), Rule(f"name-{i}", label, 5, 0.5, keyword, name)]
        tags |= {label: None} if not each else {}
    for label in tags:
        words = label.replace("-", " ").replace(".", " ")
        out += [Rule(f"tag-later-{label}", f"{label}-or-later", 2, 0.99, "spdx license identifier", f"spdx license identifier {words} or later")]
        out += [Rule(f"tag-{label}", label, 2, 0.99, "spdx license identifier", f"spdx license identifier {words}(?: only)?")]
    return sorted(out, key=lambda r: r.priority)
