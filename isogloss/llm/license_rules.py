"""Signature rules of license_scan, written over a text's words: lower-cased runs of letters, digits and characters
beyond ASCII, one space between two of them. `[^ ]+` is any word.

A line of NAMES is a license: label, keywords (a form of its name has each of them, or one of those that `/` parts, and
`license` stands for either spelling), and an expression of its name. It gives three rules: a machine-readable tag, a grant (`licensed under the ...`) and the bare name. SENTENCES are passages of
license texts and notices, FAMILIES names that leave the version open, BASE the phrases that are always reported.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Levels from the most to the least telling, and how sure a detection of each is.
TAG, SENTENCE, NAME, FAMILY = range(4)
SURE = (1.0, 0.9, 0.7, 0.5)

#: Label and phrase of the places that are always reported.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

_GRANT = r"(?:licensed|released|distributed|published|available|provided|offered|covered|governed|shared|redistributed|modify it)(?: [^ ]+){0,4} (?:under|by)(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the| a| an)? "

NAMES = r"""
mit | mit | (?:the )?mit(?: x11| expat)? licen[cs]e
mit-0 | mit 0 | mit(?: no attribution)? 0(?: licen[cs]e)?
x11 | x11 license | x11 licen[cs]e
expat | expat license | expat licen[cs]e
apache-1.0 | apache 1 0 | apache(?: software)?(?: licen[cs]e)?(?: version| v)? 1 0
apache-1.1 | apache 1 | apache(?: software)?(?: licen[cs]e)?(?: version| v)? 1 1
apache-2.0 | apache | apache(?: software)?(?: licen[cs]e)?(?: version| v)? (?:2 0|2|v2 0|v2)
gpl-1.0 | gpl/general | (?:gnu general public licen[cs]e|gnu gpl|gpl)(?: version| v)? (?:1 0|1|v1)
gpl-2.0 | gpl/general | (?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? (?:2 0|2|v2 0|v2)
gpl-3.0 | gpl/general | (?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? (?:3 0|3|v3 0|v3)
lgpl-2.0 | lgpl/lesser/library | (?:gnu )?(?:library general public licen[cs]e|lgpl)(?: version| v)? (?:2 0|2|v2 0|v2)
lgpl-2.1 | lgpl/lesser/library | (?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? (?:2 1|v2 1)
lgpl-3.0 | lgpl/lesser/library | (?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? (?:3 0|3|v3 0|v3)
agpl-1.0 | agpl/affero | (?:gnu )?(?:affero general public licen[cs]e|agpl)(?: version| v)? (?:1 0|1|v1)
agpl-3.0 | agpl/affero | (?:gnu )?(?:affero general public licen[cs]e|agpl)(?: version| v)? (?:3 0|3|v3 0|v3)
gfdl-1.1 | gfdl/fdl/documentation 1 | (?:gnu )?(?:free documentation licen[cs]e|gfdl|fdl)(?: version| v)? 1 1
gfdl-1.2 | gfdl/fdl/documentation 1 2 | (?:gnu )?(?:free documentation licen[cs]e|gfdl|fdl)(?: version| v)? 1 2
gfdl-1.3 | gfdl/fdl/documentation 1 3 | (?:gnu )?(?:free documentation licen[cs]e|gfdl|fdl)(?: version| v)? 1 3
bsd-1-clause | bsd clause | (?:bsd (?:1|one) clause|(?:1|one) clause bsd)(?: licen[cs]e)?
bsd-2-clause | bsd | (?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd bsd)(?: licen[cs]e)?
bsd-3-clause | bsd | (?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-4-clause | bsd | (?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd|old bsd)(?: licen[cs]e)?
0bsd | 0bsd/zero | (?:0bsd|zero clause bsd|bsd zero clause)(?: licen[cs]e)?
isc | isc license | isc licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
libpng | libpng license | libpng licen[cs]e
bsl-1.0 | boost 1 0 | boost(?: software)?(?: licen[cs]e)?(?: version| v)? 1 0
busl-1.1 | business source 1 | business source licen[cs]e(?: version| v)? 1 1
sspl-1.0 | sspl/side | (?:server side public licen[cs]e|sspl)(?: version| v)?(?: 1 0| 1| v1)
elastic-2.0 | elastic | elastic licen[cs]e(?: version| v)? (?:2 0|2|v2)
mpl-1.0 | mpl/mozilla 1 0 | (?:mozilla public licen[cs]e|mpl)(?: version| v)? 1 0
mpl-1.1 | mpl/mozilla 1 | (?:mozilla public licen[cs]e|mpl)(?: version| v)? 1 1
mpl-2.0 | mpl/mozilla | (?:mozilla public licen[cs]e|mpl)(?: version| v)? (?:2 0|2|v2 0|v2)
epl-1.0 | epl/eclipse 1 0 | (?:eclipse public licen[cs]e|epl)(?: version| v)? 1 0
epl-2.0 | epl/eclipse 2 0 | (?:eclipse public licen[cs]e|epl)(?: version| v)? 2 0
edl-1.0 | eclipse distribution | eclipse distribution licen[cs]e(?: version| v)? 1 0
cddl-1.0 | cddl/distribution 1 0 | (?:common development and distribution licen[cs]e|cddl)(?: version| v)? 1 0
cddl-1.1 | cddl/distribution 1 | (?:common development and distribution licen[cs]e|cddl)(?: version| v)? 1 1
cpl-1.0 | common public 1 0 | common public licen[cs]e(?: version| v)? 1 0
ipl-1.0 | ibm public 1 0 | ibm public licen[cs]e(?: version| v)? 1 0
eupl-1.1 | eupl/union 1 | (?:european union public licen[cs]e|eupl)(?: version| v)? 1 1
eupl-1.2 | eupl/union 1 2 | (?:european union public licen[cs]e|eupl)(?: version| v)? 1 2
osl-3.0 | open software 3 0 | open software licen[cs]e(?: version| v)? 3 0
afl-3.0 | academic free 3 0 | academic free licen[cs]e(?: version| v)? 3 0
artistic-1.0 | artistic 1 0 | artistic licen[cs]e(?: version| v)? 1 0
artistic-2.0 | artistic 2 0 | artistic licen[cs]e(?: version| v)? 2 0
ms-pl | microsoft public | microsoft public licen[cs]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e
python-2.0 | python | python(?: software foundation)? licen[cs]e(?: version| v)? (?:2 0|2)
psf-2.0 | psf | psf licen[cs]e(?: agreement)?(?: version| v)? (?:2 0|2)
php-3.0 | php 3 0 | php licen[cs]e(?: version| v)? 3 0
php-3.01 | php 3 01 | php licen[cs]e(?: version| v)? 3 01
ruby | ruby license | ruby licen[cs]e
openssl | openssl license | openssl licen[cs]e
curl | curl license | curl licen[cs]e
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e
postgresql | postgresql license | postgresql licen[cs]e
vim | vim license | vim licen[cs]e
wtfpl | wtfpl/fuck | (?:wtfpl|do what the fuck you want to public licen[cs]e)
unlicense | unlicense | (?:the )?unlicense
cc0-1.0 | cc0/zero | (?:creative commons (?:cc0|zero)|cc0|cc zero)(?: universal)?(?: 1 0)?(?: universal)?
cc-by-2.0 | cc/creative 2 0 | (?:cc by|creative commons attribution) 2 0
cc-by-3.0 | cc/creative 3 0 | (?:cc by|creative commons attribution) 3 0
cc-by-4.0 | cc/creative 4 0 | (?:cc by|creative commons attribution)(?: international)? 4 0
cc-by-sa-2.0 | cc/creative 2 0 sa/share/sharealike | (?:cc by sa|creative commons attribution (?:share alike|sharealike)) 2 0
cc-by-sa-3.0 | cc/creative 3 0 sa/share/sharealike | (?:cc by sa|creative commons attribution (?:share alike|sharealike)) 3 0
cc-by-sa-4.0 | cc/creative 4 0 sa/share/sharealike | (?:cc by sa|creative commons attribution (?:share alike|sharealike))(?: international)? 4 0
cc-by-nc-3.0 | cc/creative 3 0 nc/non/noncommercial | (?:cc by nc|creative commons attribution (?:non commercial|noncommercial)) 3 0
cc-by-nc-4.0 | cc/creative 4 0 nc/non/noncommercial | (?:cc by nc|creative commons attribution (?:non commercial|noncommercial))(?: international)? 4 0
cc-by-nd-3.0 | cc/creative 3 0 nd/derivatives | (?:cc by nd|creative commons attribution no derivatives) 3 0
cc-by-nd-4.0 | cc/creative 4 0 nd/derivatives | (?:cc by nd|creative commons attribution no derivatives)(?: international)? 4 0
cc-by-nc-sa-3.0 | cc/creative 3 0 sa/share/sharealike nc/non/noncommercial | (?:cc by nc sa|creative commons attribution (?:non commercial|noncommercial) (?:share alike|sharealike)) 3 0
cc-by-nc-sa-4.0 | cc/creative 4 0 sa/share/sharealike nc/non/noncommercial | (?:cc by nc sa|creative commons attribution (?:non commercial|noncommercial) (?:share alike|sharealike))(?: international)? 4 0
cc-by-nc-nd-3.0 | cc/creative 3 0 nc/non/noncommercial nd/derivatives | (?:cc by nc nd|creative commons attribution (?:non commercial|noncommercial) no derivatives) 3 0
cc-by-nc-nd-4.0 | cc/creative 4 0 nc/non/noncommercial nd/derivatives | (?:cc by nc nd|creative commons attribution (?:non commercial|noncommercial) no derivatives)(?: international)? 4 0
odbl-1.0 | odbl/database | (?:open database licen[cs]e|odbl)(?: version| v)?(?: 1 0)?
odc-by-1.0 | odc by | odc by(?: 1 0)?
pddl-1.0 | pddl/dedication | (?:public domain dedication and licen[cs]e|pddl)(?: 1 0)?
ofl-1.1 | ofl/font | (?:sil open font licen[cs]e|ofl)(?: version| v)?(?: 1 1)?
ogl-3.0 | open government 3 0 | open government licen[cs]e(?: version| v)? 3 0
etalab-2.0 | etalab/ouverte | (?:etalab|licence ouverte)(?: version| v)? 2 0
cecill-2.1 | cecill 2 1 | cecill(?: version| v)? 2 1
openrail-m | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[cs]e)?
llama-2 | llama 2 | llama 2(?: community)? licen[cs]e(?: agreement)?
"""

SENTENCES = r"""
mit | granted free charge obtaining | permission is hereby granted free of charge to any person obtaining a copy
mit | noninfringement merchantability | warranties of merchantability fitness for a particular purpose and noninfringement
mit | substantial portions permission | copyright notice and this permission notice shall be included in all(?: copies or)? substantial portions
isc | permission modify fee | permission to use copy modify and or distribute this software for any purpose with or without fee
bsd | redistribution binary permitted | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions retain | redistributions of source code must retain the(?: above)? copyright notice
bsd | redistributions reproduce | redistributions in binary form must reproduce the(?: above)? copyright notice
bsd-3-clause | endorse contributors | neither the names? of(?: [^ ]+){1,8} contributors may be used to endorse
bsd-4-clause | advertising materials | advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2.0 | compliance obtain | you may not use this file except in compliance with the licen[cs]e you may obtain a copy
apache-2.0 | apache licenses 2 0 | apache org licenses licen[cs]e 2 0
apache-2.0 | agreed applicable | unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis
gpl | redistribute gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl | hope useful warranty | distributed in the hope that it will be useful but without any warranty
gpl | received gnu | you should have received a copy of the gnu general public licen[cs]e
gpl-2.0-or-later | version 2 later | version 2(?: of the licen[cs]e)? or at your option any later version
gpl-3.0-or-later | version 3 later | version 3(?: of the licen[cs]e)? or at your option any later version
gpl | gnu licenses gpl | gnu org licenses gpl
lgpl | received gnu lesser | you should have received a copy of the gnu lesser general public licen[cs]e
lgpl | gnu licenses lgpl | gnu org licenses lgpl
agpl | received gnu affero | you should have received a copy of the gnu affero general public licen[cs]e
agpl | gnu licenses agpl | gnu org licenses agpl
mpl-2.0 | source mozilla subject | this source code form is subject to the terms of the mozilla public licen[cs]e
mpl-2.0 | mozilla mpl 2 | mozilla org mpl 2 0
epl-2.0 | eclipse accompanying terms | accompanying materials are made available under the terms of the eclipse public licen[cs]e
unlicense | unencumbered domain | this is free and unencumbered software released into the public domain
public-domain | dedicated domain | (?:is|are)(?: hereby)? dedicated to the public domain
public-domain | released domain | released (?:in)?to the public domain
cc0-1.0 | creativecommons publicdomain zero | creativecommons org publicdomain zero 1 0
cc-by | creativecommons licenses | creativecommons org licenses by
cc-by-sa | creativecommons licenses sa | creativecommons org licenses by sa
cc-by-nc | creativecommons licenses nc | creativecommons org licenses by nc
cc-by-nd | creativecommons licenses nd | creativecommons org licenses by nd
zlib | altered misrepresented | altered source versions must be plainly marked as such and must not be misrepresented
bsl-1.0 | boost license 1 | boost org license 1 0 txt
bsl-1.0 | machine executable generated | machine executable object code generated by a source language processor
ofl-1.1 | font reserved name | licensed under the sil open font licen[cs]e(?: [^ ]+){0,12} reserved font name
wtfpl | fuck | you just do what the fuck you want to
proprietary | proprietary confidential | proprietary and confidential
all-rights-reserved | rights reserved | all rights reserved
no-redistribution | unauthorized copying | unauthorized copying of this (?:file|document|work|material)(?: [^ ]+){0,6} prohibited
non-commercial | commercial/noncommercial/personal only | for (?:non commercial|noncommercial|personal)(?: [^ ]+){0,3} use only
"""

FAMILIES = r"""
gpl | gpl | (?:gnu )?gpl(?: licen[cs]e)?
lgpl | lgpl/lesser/library | (?:gnu )?(?:lesser general public licen[cs]e|library general public licen[cs]e|lgpl)
agpl | agpl/affero | (?:gnu )?(?:affero general public licen[cs]e|agpl)
gfdl | gfdl/fdl/documentation | (?:gnu free documentation licen[cs]e|gfdl)
bsd | bsd | bsd(?: style)? licen[cs]e
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
creative-commons | creative commons | creative commons(?: licen[cs]e)?
cc-by | cc by | cc by
artistic | artistic | artistic licen[cs]e
open-font | open font | open font licen[cs]e
python | python | python(?: software foundation)? licen[cs]e
boost | boost | boost software licen[cs]e
"""


@dataclass(frozen=True)
class Rule:
    """level, label, keywords (of each group every match holds one), and an expression over words; base: always
    reported."""

    level: int
    label: str
    words: tuple[tuple[str, ...], ...]
    expression: str
    base: bool = False


def _groups(words: str) -> tuple[tuple[str, ...], ...]:
    return tuple(("license", "licence") if w == "license" else tuple(w.split("/")) for w in words.split())


def _lines(table: str) -> list[tuple[str, tuple[tuple[str, ...], ...], str]]:
    return [(label, _groups(words), body) for label, words, body in (line.split(" | ") for line in table.strip().splitlines())]


def rules() -> list[Rule]:
    """All rules in the order that decides between equals."""
    names = _lines(NAMES)
    tagged = [Rule(TAG, label, _groups("spdx identifier " + label.replace(".", " ").replace("-", " ")), rf"spdx licen[cs]e identifier {' '.join(label.replace('.', ' ').replace('-', ' ').split())}(?: only| or later)?") for label, _, _ in names]
    granted = [Rule(TAG, label, (*words, ("under", "by")), _GRANT + body) for label, words, body in names]
    written = [Rule(SENTENCE, *line) for line in _lines(SENTENCES)]
    named = [Rule(NAME, *line) for line in names]
    wide = [Rule(FAMILY, *line) for line in _lines(FAMILIES)]
    return [*tagged, *granted, *written, *named, *wide, *[Rule(FAMILY, label, _groups(phrase), phrase, True) for label, phrase in BASE]]
