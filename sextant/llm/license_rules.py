"""Signatures of licences: a line holds rank, label and a regex over normalised words.

Words are lower case, runs of ASCII letters, ASCII digits and other characters,
joined by one space, so `Apache-2.0` reads `apache 2 0`.  Repeats are bounded, and
a match has at most LONGEST words.  A rule's keyword is what every match begins
with: the words before the first thing that isn't a plain word, KEYWORD_WORDS at
most.  Texts that hold none of TRIGGERS hold no match of any rule.  Rank 1 is a machine-readable tag, 2 a sentence of a licence's text, 3 a
name with a version, 4 a name without one, 5 a hint.
"""

from __future__ import annotations

import re
from typing import NamedTuple

LONGEST, KEYWORD_WORDS = 24, 4
WEIGHTS = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.75, 5: 0.3}


class Rule(NamedTuple):
    order: int
    rank: int
    label: str
    keyword: str
    regex: str
    trigger: str


#: The prefilter: short strings, at least one of which is in all that a rule can match.
TRIGGERS = """licen|gpl|spdx|permission|redistribut|copyright|rights reserved|cc by|cc0|creative|apache|mozilla|eclipse|bsd|public domain|opensource|free software|warranty|unlicense|wtfpl|gfdl|mpl |epl |of this software
|cecill|asl 2|this software|the software|altered source|neither the name|what the fuck|retain this notice|may be copied|openssl|perl itself|proprietary|unauthorized copying|gnu """.replace("\n", "").split("|")


_LINES = r"""
1 apache-2.0 spdx license identifier apache 2 0
1 apache-1.1 spdx license identifier apache 1 1
1 mit spdx license identifier mit(?: license)?
1 mit-0 spdx license identifier mit 0
1 gpl-2.0-only spdx license identifier gpl 2 0(?: only)?
1 gpl-2.0-or-later spdx license identifier gpl 2 0 or later
1 gpl-3.0-only spdx license identifier gpl 3 0(?: only)?
1 gpl-3.0-or-later spdx license identifier gpl 3 0 or later
1 lgpl-2.1-only spdx license identifier lgpl 2 1(?: only)?
1 lgpl-2.1-or-later spdx license identifier lgpl 2 1 or later
1 lgpl-3.0-only spdx license identifier lgpl 3 0(?: only)?
1 lgpl-3.0-or-later spdx license identifier lgpl 3 0 or later
1 agpl-3.0-only spdx license identifier agpl 3 0(?: only)?
1 agpl-3.0-or-later spdx license identifier agpl 3 0 or later
1 bsd-2-clause spdx license identifier bsd 2 clause
1 bsd-3-clause spdx license identifier bsd 3 clause
1 bsd-4-clause spdx license identifier bsd 4 clause
1 0bsd spdx license identifier 0bsd
1 isc spdx license identifier isc
1 zlib spdx license identifier zlib
1 mpl-2.0 spdx license identifier mpl 2 0
1 mpl-1.1 spdx license identifier mpl 1 1
1 epl-1.0 spdx license identifier epl 1 0
1 epl-2.0 spdx license identifier epl 2 0
1 eupl-1.2 spdx license identifier eupl 1 2
1 cddl-1.0 spdx license identifier cddl 1 0
1 bsl-1.0 spdx license identifier bsl 1 0
1 unlicense spdx license identifier unlicense
1 wtfpl spdx license identifier wtfpl
1 cc0-1.0 spdx license identifier cc0 1 0
1 cc-by-4.0 spdx license identifier cc by 4 0
1 cc-by-sa-4.0 spdx license identifier cc by sa 4 0
1 artistic-2.0 spdx license identifier artistic 2 0
1 ofl-1.1 spdx license identifier ofl 1 1
1 postgresql spdx license identifier postgresql
1 unknown-spdx spdx license identifier [a-z0-9]+(?: [0-9]+){0,3}
2 mit permission is hereby granted free of charge to any person obtaining a copy of this software
2 mit permission is hereby granted free of charge to any person obtaining a copy
2 isc permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 isc permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
2 hpnd permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose
2 unlicense this is free and unencumbered software released into the public domain
2 unlicense anyone is free to copy modify publish use compile sell or distribute this software
2 bsd redistribution and use in source and binary forms with or without modification are permitted
2 bsd redistributions of source code must retain the above copyright notice
2 bsd redistributions in binary form must reproduce the above copyright notice
2 bsd-3-clause neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse or promote
2 bsd-4-clause all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
2 zlib this software is provided as is without any express or implied warranty in no event will the authors be held liable
2 zlib the origin of this software must not be misrepresented
2 zlib altered source versions must be plainly marked as such
2 apache-2.0 you may not use this file except in compliance with the license
2 apache-2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
2 apache-2.0 contributor license agreements see the notice file distributed with this work
2 apache-2.0 subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge
2 gpl this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
2 gpl this program is free software you may redistribute it and or modify it under the terms of the gnu general public license
2 gpl everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
2 gpl you should have received a copy of the gnu general public license
2 gpl when we speak of free software we are referring to freedom not price
2 lgpl you should have received a copy of the gnu (?:lesser|library) general public license
2 lgpl this library is free software you can redistribute it and or modify it
2 lgpl this version of the gnu lesser general public license incorporates the terms
2 agpl you should have received a copy of the gnu affero general public license
2 agpl remote network interaction use with the gnu general public license
2 mpl-2.0 this source code form is subject to the terms of the mozilla public license v 2 0
2 mpl-2.0 this source code form is subject to the terms of the mozilla public license
2 mpl-1.1 the contents of this file are subject to the mozilla public license version 1 1
2 mpl the contents of this file are subject to the mozilla public license
2 cddl the contents of this file are subject to the terms of the common development and distribution license
2 epl this program and the accompanying materials are made available under the terms of the eclipse public license
2 epl-2.0 this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version )2 0
2 bsl-1.0 boost software license version 1 0 august 17th 2003
2 bsl-1.0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software
2 wtfpl you just do what the fuck you want to
2 beerware as long as you retain this notice you can do whatever you want with this stuff
2 json the software shall be used for good not evil
2 ofl-1.1 this font software is licensed under the sil open font license
2 ncsa permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal
2 ms-pl if you use the software you accept this license
2 artistic the intent of this document is to state the conditions under which a package may be copied
2 cc0 the person who associated a work with this deed has dedicated the work to the public domain
2 cc to view a copy of this license visit
2 gfdl permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
2 php redistribution and use of this software in source and binary forms with or without modification are permitted
2 openssl this product includes software developed by the openssl project
2 no-warranty the software is provided as is without warranty of any kind express or implied
2 no-warranty this program is distributed in the hope that it will be useful but without any warranty
3 apache-2.0 apache license (?:version|v) ?2(?: 0)?
3 apache-1.1 apache (?:software )?license (?:version|v) ?1 1
3 apache-1.0 apache (?:software )?license (?:version|v) ?1 0
3 apache-2.0 apache software license (?:version|v) ?2(?: 0)?
3 apache-2.0 apache org licenses license 2 0
3 apache-2.0 apache 2 0(?: license)?
3 apache-2.0 asl 2(?: 0)?
3 gpl-1.0 gnu general public license (?:version|v) ?1(?: 0)?
3 gpl-2.0 gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?2(?: 0)?
3 gpl-3.0 gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3(?: 0)?
3 gpl-2.0-or-later gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
3 gpl-3.0-or-later gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
3 gpl-2.0 gnu gpl (?:version |v)?2(?: 0)?
3 gpl-3.0 gnu gpl (?:version |v)?3(?: 0)?
3 gpl-2.0 gpl (?:version |v ?)?2(?: 0)?
3 gpl-3.0 gpl (?:version |v ?)?3(?: 0)?
3 gpl-2.0 gplv2(?: 0)?
3 gpl-3.0 gplv3(?: 0)?
3 gpl-2.0-or-later gpl 2 0 or later
3 gpl-3.0-or-later gpl 3 0 or later
3 lgpl-2.0 gnu library general public license (?:version|v) ?2(?: 0)?
3 lgpl-2.1 gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?2 1
3 lgpl-3.0 gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3(?: 0)?
3 lgpl-2.1 lgpl (?:version |v ?)?2 1
3 lgpl-3.0 lgpl (?:version |v ?)?3(?: 0)?
3 lgpl-2.1 lgplv2 1
3 lgpl-3.0 lgplv3
3 agpl-3.0 gnu affero general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3(?: 0)?
3 agpl-3.0 agpl (?:version |v ?)?3(?: 0)?
3 agpl-3.0 agplv3
3 gfdl-1.2 gnu free documentation license version 1 2
3 gfdl-1.3 gnu free documentation license version 1 3
3 bsd-2-clause bsd (?:2|two) clause(?: license)?
3 bsd-3-clause bsd (?:3|three) clause(?: license)?
3 bsd-4-clause bsd (?:4|four) clause(?: license)?
3 bsd-2-clause simplified bsd license
3 bsd-2-clause freebsd license
3 bsd-3-clause (?:new|modified|revised) bsd license
3 bsd-4-clause original bsd license
3 0bsd zero clause bsd(?: license)?
3 mpl-1.0 mozilla public license (?:version|v) ?1 0
3 mpl-1.1 mozilla public license (?:version|v) ?1 1
3 mpl-2.0 mozilla public license (?:version |v ?)?2(?: 0)?
3 mpl-1.1 mpl 1 1
3 mpl-2.0 mpl (?:v ?)?2 0
3 epl-1.0 eclipse public license (?:version |v ?)?1 0
3 epl-2.0 eclipse public license (?:version |v ?)?2(?: 0)?
3 epl-1.0 epl (?:v ?)?1 0
3 epl-2.0 epl (?:v ?)?2 0
3 eupl-1.1 european union public licen[sc]e (?:version |v ?)?1 1
3 eupl-1.2 european union public licen[sc]e (?:version |v ?)?1 2
3 cddl-1.0 common development and distribution license (?:version |v ?)?1 0
3 cddl-1.1 common development and distribution license (?:version |v ?)?1 1
3 bsl-1.0 boost software license (?:version |v ?)?1 0
3 busl-1.1 business source license (?:version |v ?)?1 1
3 sspl-1.0 server side public license (?:version |v ?)?1
3 elastic-2.0 elastic license (?:version |v ?)?2(?: 0)?
3 artistic-1.0 artistic license (?:version |v ?)?1 0
3 artistic-2.0 artistic license (?:version |v ?)?2 0
3 ofl-1.1 sil open font license (?:version |v ?)?1 1
3 odbl-1.0 open database license (?:version |v ?)?1 0
3 ogl-3.0 open government licence (?:version |v ?)?3 0
3 ogl-2.0 open government licence (?:version |v ?)?2 0
3 cecill-2.1 cecill (?:version |v ?)?2 1
3 python-2.0 python (?:software foundation )?license version 2
3 php-3.01 php license version 3 01
3 zpl-2.1 zope public license (?:version |v ?)?2 1
3 upl-1.0 universal permissive license (?:version |v ?)?1 0
3 mulan-psl-2.0 mulan permissive software license (?:version |v ?)?2
3 afl-3.0 academic free license (?:version |v ?)?3 0
3 osl-3.0 open software license (?:version |v ?)?3 0
3 lppl-1.3 latex project public license (?:version |v ?)?1 3[a-c]?
3 cpl-1.0 common public license (?:version |v ?)?1 0
3 ibm-1.0 ibm public license (?:version |v ?)?1 0
3 qpl-1.0 q public license (?:version |v ?)?1 0
3 wtfpl-2.0 wtfpl version 2
3 cc0-1.0 cc0 1 0(?: universal)?
3 cc-by-2.0 cc by 2 0
3 cc-by-3.0 cc by 3 0
3 cc-by-4.0 cc by 4 0
3 cc-by-sa-3.0 cc by sa 3 0
3 cc-by-sa-4.0 cc by sa 4 0
3 cc-by-nc-3.0 cc by nc 3 0
3 cc-by-nc-4.0 cc by nc 4 0
3 cc-by-nd-3.0 cc by nd 3 0
3 cc-by-nd-4.0 cc by nd 4 0
3 cc-by-nc-sa-3.0 cc by nc sa 3 0
3 cc-by-nc-sa-4.0 cc by nc sa 4 0
3 cc-by-nc-nd-3.0 cc by nc nd 3 0
3 cc-by-nc-nd-4.0 cc by nc nd 4 0
3 cc-by-3.0 creative commons attribution 3 0
3 cc-by-4.0 creative commons attribution 4 0
3 cc-by-sa-3.0 creative commons attribution share ?alike 3 0
3 cc-by-sa-4.0 creative commons attribution share ?alike 4 0
3 cc-by-nc-4.0 creative commons attribution non ?commercial 4 0
3 cc-by-nd-4.0 creative commons attribution no ?deriv(?:ative|ivative)?s 4 0
3 cc-by-nc-sa-4.0 creative commons attribution non ?commercial share ?alike 4 0
3 cc-by-nc-nd-4.0 creative commons attribution non ?commercial no ?derivatives 4 0
3 cc0-1.0 creative commons zero (?:v ?)?1 0
3 cc-by-4.0 creativecommons org licenses by 4 0
3 cc-by-3.0 creativecommons org licenses by 3 0
3 cc-by-sa-4.0 creativecommons org licenses by sa 4 0
3 cc-by-sa-3.0 creativecommons org licenses by sa 3 0
3 cc-by-nc-4.0 creativecommons org licenses by nc 4 0
3 cc-by-nc-sa-4.0 creativecommons org licenses by nc sa 4 0
3 cc-by-nc-nd-4.0 creativecommons org licenses by nc nd 4 0
3 cc0-1.0 creativecommons org publicdomain zero 1 0
3 gpl-3.0 gnu org licenses gpl 3 0
3 gpl-2.0 gnu org licenses (?:old licenses )?gpl 2 0
3 mit opensource org licenses mit
3 bsd-3-clause opensource org licenses bsd 3 clause
3 isc opensource org licenses isc
4 apache apache (?:public )?license
4 apache apache software foundation license
4 mit mit license
4 mit mit licence
4 mit mit licensed
4 mit expat license
4 x11 x11 license
4 gpl gnu general public licen[sc]e
4 gpl gnu public license
4 gpl gnu gpl
4 gpl gpl licensed
4 gpl gpl license
4 lgpl gnu lesser general public licen[sc]e
4 lgpl gnu library general public licen[sc]e
4 lgpl gnu lgpl
4 lgpl lgpl(?: license)?
4 agpl gnu affero general public licen[sc]e
4 agpl affero general public license
4 agpl agpl(?: license)?
4 gfdl gnu free documentation license
4 gfdl gfdl
4 bsd bsd (?:style )?licen[sc]e
4 bsd bsd licensed
4 isc isc license
4 zlib zlib (?:libpng )?license
4 mpl mozilla public licen[sc]e
4 epl eclipse public license
4 eupl european union public licen[sc]e
4 cddl common development and distribution license
4 bsl boost software license
4 busl business source license
4 sspl server side public license
4 elastic elastic license
4 artistic artistic license
4 perl same terms as perl itself
4 ofl sil open font license
4 odbl open database license
4 ogl open government licence
4 python python software foundation license
4 psf psf license
4 php php license
4 ruby ruby license
4 postgresql postgresql licen[sc]e
4 openssl openssl license
4 ncsa university of illinois ncsa open source license
4 unlicense unlicense
4 wtfpl wtfpl
4 beerware beerware license
4 json json license
4 public-domain public domain dedication
4 public-domain released into the public domain
4 public-domain dedicated to the public domain
4 cc0 cc0
4 cc0 creative commons zero
4 cc creative commons licen[sc]e
4 cc-by creative commons attribution(?: licen[sc]e)?
4 cc-by-sa creative commons attribution share ?alike
4 cc-by-nc creative commons attribution non ?commercial
4 cc-by-nd creative commons attribution no ?derivatives
4 cc-by-nc-sa creative commons attribution non ?commercial share ?alike
4 cc-by-nc-nd creative commons attribution non ?commercial no ?derivatives
4 cc-by cc by
4 cc-by-sa cc by sa
4 cc-by-nc cc by nc
4 cc-by-nd cc by nd
4 cc-by-nc-sa cc by nc sa
4 cc-by-nc-nd cc by nc nd
5 all-rights-reserved all rights reserved
5 copyright copyright (?:c )?[12][0-9]{3}
5 proprietary proprietary and confidential
5 proprietary unauthorized copying of this file
5 eula end user license agreement
5 see-license see (?:the )?license(?: txt| md)? file
5 license-mention (?:licensed|licenced) under(?: the)? [^ ]+(?: [^ ]+){0,2} licen[sc]e
"""  # fmt: skip


#: A word of a regex is whole where this follows.
_WHOLE = r"(?= |$|\(\?: )"


def _certain(regex: str) -> str:
    """What every match of a regex holds, with `|` for what may differ."""
    before = ""
    while before != regex:
        before, regex = regex, re.sub(r"\(\?:[^()]*\)(\?|\{0,\d+\})?", "|", regex)
    return re.sub(r"\[[^\]]*\][+?]?(\{\d+(,\d+)?\})?|.\?", "|", regex)


def rules(lines: str, triggers: list[str] = TRIGGERS) -> list[Rule]:
    """A rule for each line, and for each keyword where a line begins with `(?:one|another)`.

    A line that holds no trigger for certain is its own, if it is plain words, else an error.
    """
    out = []
    for order, line in enumerate(lines.strip().splitlines()):
        rank, label, regex = line.split(" ", 2)
        either = re.match(r"\(\?:([a-z0-9|]+)\)(.*)", regex)
        for each in [first + either.group(2) for first in either.group(1).split("|")] if either else [regex]:
            lead = re.match(rf"[a-z0-9]+{_WHOLE}(?: [a-z0-9]+{_WHOLE})*", each)
            trigger = next((t for t in triggers if t in _certain(each)), each if lead and lead.group() == each else None)
            if not lead or not trigger:
                raise ValueError(f"the rule {line!r} has no keyword or no trigger")
            out.append(Rule(order, int(rank), label, " ".join(lead.group().split(" ")[:KEYWORD_WORDS]), each, trigger))
    return out


#: In order: of detections that cover the same words with the same rank, the first line's stays.
RULES = rules(_LINES)
