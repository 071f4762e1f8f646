"""Hand-written licence signatures over word strings.

A text is looked at as its lower-case words joined by single blanks, so the patterns
need no punctuation. A line is ``label | priority | confidence | hint | pattern``; the hint
names a rule's tell-tale words for the reader, what gates the rule is derived from its
pattern. Patterns match whole words.
``V`` stands for an optional "v" or "version" before a number.
"""

TABLE = """
apache-2.0 | 9 | 1.0 | apache license 2 | licensed under the apache license V2(?: 0)?(?: the license)?
apache-2.0 | 8 | .95 | apache license 2 | apache(?: software)? license V2(?: 0)?
apache-2.0 | 7 | .9 | apache 2 | apache V2(?: 0)?(?: licen[sc]ed?)?
apache-2.0 | 8 | .95 | apache licenses | apache org licenses license 2 0
apache-2.0 | 6 | .9 | alv2 | alv2
apache-1.1 | 9 | 1.0 | apache license 1 | apache(?: software)? license V1 1
apache-1.0 | 9 | 1.0 | apache license 1 | apache(?: software)? license V1 0
apache-1.1 | 7 | .9 | apache foundation acknowledgment | this product includes software developed by the apache software foundation
apache | 3 | .7 | apache license | apache(?: software)? license
apache | 4 | .8 | apache licensed | licensed to the apache software foundation
mit | 9 | 1.0 | permission granted software | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 8 | .95 | mit license | (?:released|licensed|distributed|available) under the(?: terms of the)? mit licen[sc]e
mit | 7 | .9 | mit license | (?:the )?mit(?: open source)? license
mit | 6 | .85 | mit licence | (?:the )?mit licence
mit | 6 | .85 | mit licensed | mit licensed
mit | 7 | .9 | opensource mit | opensource org licenses mit
mit | 5 | .8 | expat license | expat license
mit-0 | 8 | .95 | mit 0 | mit 0 license|mit no attribution
x11 | 7 | .9 | x11 license | x11 license
x11 | 6 | .85 | consortium | x consortium
isc | 9 | 1.0 | permission fee purpose | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | 7 | .9 | isc license | isc licen[sc]e
isc | 6 | .85 | internet consortium | internet (?:systems|software) consortium
0bsd | 8 | .95 | 0bsd | 0bsd|zero clause bsd
bsd-2-clause | 9 | 1.0 | bsd 2 | (?:simplified )?bsd 2 clause|2 clause bsd
bsd-2-clause | 8 | .95 | simplified bsd | simplified bsd(?: license)?
bsd-2-clause | 7 | .9 | freebsd license | freebsd license
bsd-3-clause | 9 | 1.0 | bsd 3 | bsd 3 clause|3 clause bsd
bsd-3-clause | 8 | .95 | bsd new | new bsd(?: license)?|bsd new
bsd-3-clause | 8 | .95 | bsd revised | (?:revised|modified) bsd(?: license)?
bsd-3-clause | 7 | .9 | endorse promote | neither the name of .{1,80}? may be used to endorse or promote products
bsd-4-clause | 9 | 1.0 | bsd 4 | bsd 4 clause|4 clause bsd
bsd-4-clause | 8 | .95 | original bsd | original bsd(?: license)?
bsd | 5 | .85 | redistribution binary forms | redistribution and use in source and binary forms with or without modification(?: are permitted)?
bsd | 4 | .8 | bsd license | (?:the )?bsd(?: style)? licen[sc]e
bsd | 4 | .8 | bsd licensed | bsd licensed
gpl-1.0 | 9 | 1.0 | gpl 1 | gpl V1(?: 0)?
gpl-2.0 | 9 | 1.0 | general public license 2 | (?:gnu )?general public license V2(?: 0)?
gpl-2.0 | 9 | 1.0 | general public license 2 | general public license as published by the free software foundation (?:either )?version 2
gpl-2.0 | 8 | .95 | gpl 2 | gpl V2(?: 0)?(?: only| or later)?
gpl-2.0 | 8 | .95 | gplv2 | gplv2
gpl-3.0 | 9 | 1.0 | general public license 3 | (?:gnu )?general public license V3(?: 0)?
gpl-3.0 | 9 | 1.0 | general public license 3 | general public license as published by the free software foundation (?:either )?version 3
gpl-3.0 | 8 | .95 | gpl 3 | gpl V3(?: 0)?(?: only| or later)?
gpl-3.0 | 8 | .95 | gplv3 | gplv3
gpl | 6 | .9 | gnu general public | (?:under )?(?:the )?(?:terms of )?(?:the )?gnu general public licen[sc]e
gpl | 4 | .8 | gnu gpl | gnu gpl
gpl | 3 | .7 | gpl licensed | gpl licensed|licensed under(?: the)? gpl
gpl | 4 | .8 | copying gnu | see the gnu general public license for more details
lgpl-2.0 | 9 | 1.0 | library general public | (?:gnu )?library general public license(?: V2(?: 0)?)?
lgpl-2.1 | 10 | 1.0 | lesser general public 2 | (?:gnu )?lesser general public license V2 1
lgpl-2.1 | 9 | .95 | lgpl 2 | lgpl V2 1
lgpl-3.0 | 10 | 1.0 | lesser general public 3 | (?:gnu )?lesser general public license V3(?: 0)?
lgpl-3.0 | 9 | .95 | lgpl 3 | lgpl V3(?: 0)?
lgpl | 8 | .9 | lesser general public | (?:gnu )?lesser general public licen[sc]e
lgpl | 5 | .8 | lgpl | lgpl
lgpl-2.1 | 9 | .95 | lgplv2 | lgplv2(?: 1)?
lgpl-3.0 | 9 | .95 | lgplv3 | lgplv3
agpl-3.0 | 10 | 1.0 | affero general public 3 | (?:gnu )?affero general public license V3(?: 0)?
agpl-1.0 | 10 | 1.0 | affero general public 1 | affero general public license V1(?: 0)?
agpl-3.0 | 9 | .95 | agpl 3 | agpl V3(?: 0)?
agpl-3.0 | 9 | .95 | agplv3 | agplv3
agpl | 8 | .9 | affero general public | (?:gnu )?affero general public licen[sc]e
agpl | 5 | .8 | agpl | agpl
gfdl-1.1 | 9 | 1.0 | free documentation 1 | (?:gnu )?free documentation license V1 1
gfdl-1.2 | 9 | 1.0 | free documentation 1 2 | (?:gnu )?free documentation license V1 2
gfdl-1.3 | 9 | 1.0 | free documentation 1 3 | (?:gnu )?free documentation license V1 3
gfdl | 7 | .9 | free documentation license | (?:gnu )?free documentation license
gfdl | 5 | .8 | gfdl | gfdl
cc0-1.0 | 9 | 1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 8 | .95 | commons zero | creative commons zero
cc-by-1.0 | 8 | .95 | cc by 1 | cc by V1 0
cc-by-2.0 | 8 | .95 | cc by 2 0 | cc by V2 0
cc-by-2.5 | 8 | .95 | cc by 2 5 | cc by V2 5
cc-by-3.0 | 8 | .95 | cc by 3 | cc by V3(?: 0)?
cc-by-4.0 | 8 | .95 | cc by 4 | cc by V4(?: 0)?
cc-by-sa-1.0 | 9 | .95 | cc by sa 1 | cc by sa V1 0
cc-by-sa-2.0 | 9 | .95 | cc by sa 2 0 | cc by sa V2 0
cc-by-sa-2.5 | 9 | .95 | cc by sa 2 5 | cc by sa V2 5
cc-by-sa-3.0 | 9 | .95 | cc by sa 3 | cc by sa V3(?: 0)?
cc-by-sa-4.0 | 9 | .95 | cc by sa 4 | cc by sa V4(?: 0)?
cc-by-nd-3.0 | 9 | .95 | cc by nd 3 | cc by nd V3(?: 0)?
cc-by-nd-4.0 | 9 | .95 | cc by nd 4 | cc by nd V4(?: 0)?
cc-by-nc-2.0 | 9 | .95 | cc by nc 2 0 | cc by nc V2 0
cc-by-nc-3.0 | 9 | .95 | cc by nc 3 | cc by nc V3(?: 0)?
cc-by-nc-4.0 | 9 | .95 | cc by nc 4 | cc by nc V4(?: 0)?
cc-by-nc-sa-2.0 | 10 | .95 | cc by nc sa 2 | cc by nc sa V2(?: 0)?
cc-by-nc-sa-3.0 | 10 | .95 | cc by nc sa 3 | cc by nc sa V3(?: 0)?
cc-by-nc-sa-4.0 | 10 | .95 | cc by nc sa 4 | cc by nc sa V4(?: 0)?
cc-by-nc-nd-3.0 | 10 | .95 | cc by nc nd 3 | cc by nc nd V3(?: 0)?
cc-by-nc-nd-4.0 | 10 | .95 | cc by nc nd 4 | cc by nc nd V4(?: 0)?
cc-by-nc-sa | 8 | .9 | cc by nc sa | cc by nc sa
cc-by-nc-nd | 8 | .9 | cc by nc nd | cc by nc nd
cc-by-nc | 7 | .9 | cc by nc | cc by nc
cc-by-sa | 7 | .9 | cc by sa | cc by sa
cc-by-nd | 7 | .9 | cc by nd | cc by nd
cc-by | 8 | .95 | commons attribution 4 | creative commons attribution(?: international)? V4(?: 0)?(?: international)?
cc-by | 7 | .9 | commons attribution | creative commons attribution(?: licen[sc]e)?
cc-by-sa | 8 | .95 | commons attribution sharealike | creative commons attribution share ?alike(?: V[1-4](?: [05])?)?(?: licen[sc]e)?
cc-by-sa | 8 | .95 | commons attribution share alike | creative commons attribution share alike(?: V[1-4](?: [05])?)?(?: licen[sc]e)?
cc-by-nc | 8 | .95 | commons attribution noncommercial | creative commons attribution noncommercial(?: V[1-4](?: [05])?)?
cc-by-nc | 8 | .95 | commons attribution non commercial | creative commons attribution non commercial(?: V[1-4](?: [05])?)?
cc-by-nc-sa | 9 | .95 | commons noncommercial sharealike | creative commons attribution noncommercial sharealike(?: V[1-4](?: [05])?)?
cc-by-nc-nd | 9 | .95 | commons noncommercial noderivs | creative commons attribution noncommercial noderiv(?:s|atives)(?: V[1-4](?: [05])?)?
cc-by-nd | 8 | .95 | commons attribution noderivs | creative commons attribution noderivs(?: V[1-4](?: [05])?)?
cc-by-nd | 8 | .95 | commons attribution noderivatives | creative commons attribution noderivatives(?: V[1-4](?: [05])?)?
cc-by | 7 | .9 | creativecommons licenses by | creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa | 8 | .9 | creativecommons licenses by sa | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nc | 8 | .9 | creativecommons licenses by nc | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd | 8 | .9 | creativecommons licenses by nd | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc-sa | 9 | .9 | creativecommons licenses by nc sa | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 9 | .9 | creativecommons licenses by nc nd | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-pdm | 8 | .9 | creativecommons publicdomain mark | creativecommons org publicdomain mark(?: 1 0)?
cc0-1.0 | 9 | .95 | creativecommons publicdomain zero | creativecommons org publicdomain zero(?: 1 0)?
cc-sampling | 8 | .9 | commons sampling | creative commons sampling(?: plus)?
cc | 3 | .7 | creative commons | creative commons(?: licen[sc]ed?)?
mpl-1.0 | 9 | 1.0 | mozilla public 1 0 | mozilla public license V1 0
mpl-1.1 | 9 | 1.0 | mozilla public 1 | mozilla public license V1 1
mpl-2.0 | 9 | 1.0 | mozilla public 2 | mozilla public license V2(?: 0)?
mpl-2.0 | 8 | .95 | mpl 2 | mpl V2(?: 0)?
mpl-1.1 | 8 | .95 | mpl 1 | mpl V1 1
mpl-2.0 | 8 | .95 | mozilla mpl 2 0 | mozilla org mpl 2 0
mpl | 6 | .9 | mozilla public license | mozilla public license
npl-1.1 | 7 | .9 | netscape public license | netscape public license(?: V1 1)?
epl-1.0 | 9 | 1.0 | eclipse public 1 | eclipse public license V1(?: 0)?
epl-2.0 | 9 | 1.0 | eclipse public 2 | eclipse public license V2(?: 0)?
epl-1.0 | 8 | .95 | epl 1 | epl V1 0
epl-2.0 | 8 | .95 | epl 2 | epl V2 0
epl | 6 | .9 | eclipse public license | eclipse public license
edl-1.0 | 8 | .95 | eclipse distribution license | eclipse distribution license(?: V1 0)?
cpl-1.0 | 8 | .95 | common public license | common public license(?: V1 0)?
cddl-1.0 | 9 | 1.0 | development distribution license 1 0 | common development and distribution license V1 0
cddl-1.1 | 9 | 1.0 | development distribution license 1 | common development and distribution license V1 1
cddl | 7 | .9 | development distribution license | common development and distribution license
cddl | 5 | .8 | cddl | cddl
eupl-1.1 | 9 | 1.0 | european union public 1 1 | european union public licen[sc]e V1 1
eupl-1.2 | 9 | 1.0 | european union public 1 2 | european union public licen[sc]e V1 2
eupl | 7 | .9 | european union public | european union public licen[sc]e
eupl | 5 | .8 | eupl | eupl(?: V1 [012])?
artistic-1.0 | 9 | 1.0 | artistic license 1 | artistic license V1(?: 0)?
artistic-2.0 | 9 | 1.0 | artistic license 2 | artistic license V2(?: 0)?
artistic | 6 | .9 | artistic license | artistic license
perl | 6 | .85 | perl same terms | (?:under )?the same terms as perl(?: itself)?
python-2.0 | 8 | .95 | python software foundation | python software foundation license(?: V2)?
python-2.0 | 7 | .9 | psf license | psf license
ruby | 7 | .9 | ruby license | ruby(?: s)? license
php-3.0 | 8 | .95 | php license 3 0 | php license V3 0
php-3.01 | 8 | .95 | php license 3 01 | php license V3 01
php | 6 | .85 | php license | php license
zlib | 8 | .95 | zlib license | zlib(?: libpng)? license
zlib | 7 | .9 | warranty altered misrepresented | altered source versions must be plainly marked
libpng | 7 | .9 | libpng license | libpng license
bsl-1.0 | 8 | .95 | boost software license | boost software license(?: V1 0)?
unlicense | 9 | 1.0 | unencumbered | free and unencumbered software released into the public domain
unlicense | 8 | .95 | unlicense | (?:the )?unlicense
wtfpl | 8 | .95 | wtfpl | wtfpl(?: V2)?
wtfpl | 9 | 1.0 | fuck | do what the fuck you want to public license
public-domain | 6 | .85 | public domain dedicated | dedicated to the public domain
public-domain | 6 | .85 | public domain released | released (?:in)?to the public domain
public-domain | 5 | .8 | public domain | (?:is|are) in the public domain
public-domain | 5 | .75 | public domain work | public domain work
ms-pl | 8 | .95 | microsoft public license | microsoft public license
ms-rl | 8 | .95 | microsoft reciprocal license | microsoft reciprocal license
ms-pl | 6 | .85 | ms pl | ms pl
ofl-1.1 | 9 | 1.0 | open font license 1 | (?:sil )?open font license V1 1
ofl-1.0 | 9 | 1.0 | open font license 1 0 | (?:sil )?open font license V1 0
ofl | 7 | .9 | open font license | (?:sil )?open font license
odbl-1.0 | 8 | .95 | open database license | open database license(?: V1 0)?
odbl-1.0 | 6 | .85 | odbl | odbl
odc-by-1.0 | 8 | .95 | open data attribution | open data commons attribution(?: license)?
pddl-1.0 | 8 | .95 | public domain dedication license | public domain dedication and license
pddl-1.0 | 6 | .85 | pddl | pddl
ogl-uk | 8 | .95 | open government licence | open government licence(?: V[123](?: 0)?)?
etalab-2.0 | 8 | .95 | licence ouverte | licence ouverte(?: V?2(?: 0)?)?
dl-de-by-2.0 | 8 | .95 | datenlizenz deutschland | datenlizenz deutschland(?: namensnennung)?
cecill-2.1 | 9 | 1.0 | cecill 2 | cecill V2(?: [01])?
cecill-b | 9 | 1.0 | cecill b | cecill b
cecill-c | 9 | 1.0 | cecill c | cecill c
cecill | 6 | .9 | cecill | cecill
postgresql | 8 | .95 | postgresql license | postgresql licen[sc]e
openssl | 8 | .95 | openssl license | openssl license
openssl | 7 | .9 | openssl toolkit | for use in the openssl toolkit
ssleay | 7 | .9 | ssleay license | ssleay license
curl | 7 | .9 | curl license | curl license
ncsa | 8 | .95 | ncsa license | (?:university of illinois )?ncsa open source license
afl-3.0 | 8 | .95 | academic free license 3 | academic free license V3(?: 0)?
afl | 7 | .9 | academic free license | academic free license
osl-3.0 | 8 | .95 | open software license 3 | open software license V3(?: 0)?
osl | 7 | .9 | open software license | open software license
apsl-2.0 | 8 | .95 | apple public source license | apple public source license(?: V2(?: 0)?)?
ipl-1.0 | 8 | .95 | ibm public license | ibm public license(?: V1 0)?
lpl-1.02 | 8 | .95 | lucent public license | lucent public license(?: V1 02)?
spl-1.0 | 8 | .95 | sun public license | sun public license(?: V1 0)?
sissl | 8 | .95 | sun industry standards license | sun industry standards source license
qpl-1.0 | 8 | .95 | q public license | q public license(?: V1 0)?
rpl-1.5 | 8 | .95 | reciprocal public license | reciprocal public license(?: V1 5)?
cpal-1.0 | 8 | .95 | common public attribution | common public attribution license(?: V1 0)?
nasa-1.3 | 8 | .95 | nasa open source | nasa open source agreement(?: V1 3)?
upl-1.0 | 8 | .95 | universal permissive license | universal permissive license(?: V1 0)?
ecl-2.0 | 8 | .95 | educational community license | educational community license(?: V2 0)?
vim | 7 | .9 | vim license | vim license
w3c | 7 | .9 | w3c software | w3c software (?:notice|license|and document license)
ijg | 7 | .9 | independent jpeg group | independent jpeg group(?: license)?
beerware | 7 | .9 | beer ware | beer ware license
beerware | 7 | .9 | beerware | beerware
json | 7 | .9 | good evil | the software shall be used for good not evil
ftl | 7 | .9 | freetype license | freetype(?: project)? license
imagemagick | 7 | .9 | imagemagick license | imagemagick license
tcl | 7 | .9 | tcl license | tcl(?: tk)? license
mulan-psl-2.0 | 8 | .95 | mulan psl | mulan psl(?: V2)?
sspl-1.0 | 9 | 1.0 | server side public license | server side public license(?: V1(?: 0)?)?
sspl-1.0 | 7 | .9 | sspl | sspl
busl-1.1 | 9 | 1.0 | business source license | business source license(?: V1 1)?
elastic-2.0 | 9 | 1.0 | elastic license | elastic license(?: V?2(?: 0)?)?
commons-clause | 8 | .95 | commons clause | commons clause(?: license condition)?(?: V1 0)?
polyform-nc-1.0 | 8 | .95 | polyform noncommercial | polyform noncommercial license
openrail | 8 | .95 | openrail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: license)?
rail | 7 | .9 | responsible ai license | responsible ai licen[sc]e
hippocratic | 8 | .95 | hippocratic license | hippocratic license
parity | 7 | .9 | parity public license | parity public license
reserved | 6 | .9 | all rights reserved | all rights reserved
reserved | 5 | .8 | rights reserved | (?:some|no) rights reserved
reserved | 5 | .85 | alle rechte vorbehalten | alle rechte vorbehalten
reserved | 5 | .85 | tous droits réservés | tous droits réservés
reserved | 5 | .85 | todos los derechos reservados | todos los derechos reservados
copyright | 4 | .7 | copyright c | copyright c (?:19|20)[0-9][0-9]
copyright | 4 | .7 | copyright | copyright (?:19|20)[0-9][0-9]
copyright | 4 | .7 | copyright by | copyright by
copyright | 3 | .6 | © | ©(?: (?:19|20)[0-9][0-9])?
copyright | 4 | .7 | urheberrechtlich geschützt | urheberrechtlich geschützt
proprietary | 7 | .9 | proprietary confidential | proprietary and confidential|confidential and proprietary
proprietary | 6 | .85 | proprietary license | (?:under a |under an )?(?:commercial|proprietary) license
proprietary | 6 | .85 | may not be reproduced | may not be reproduced(?: distributed)?
proprietary | 5 | .8 | unauthorized copying | unauthorized (?:copying|reproduction|distribution|use)(?: of this (?:file|document|work))?(?: is)?(?: strictly)? prohibited
no-redistribution | 6 | .85 | do not redistribute | do not (?:re)?distribute
permission-required | 5 | .8 | written permission | without(?: the)?(?: prior)?(?: express)? written permission
warranty-disclaimer | 5 | .8 | as is without warranty | as is(?: basis)? without warrant(?:y|ies)
warranty-disclaimer | 5 | .8 | merchantability fitness | merchantability(?: and| or)? fitness for a particular purpose
warranty-disclaimer | 4 | .7 | without warranties conditions | without warranties or conditions of any kind
spdx | 9 | 1.0 | spdx license identifier | spdx license identifier [a-z0-9]+(?: [0-9]+(?: [0-9]+)?)?(?: (?:only|or later|clause))?
free-licence | 3 | .6 | licencia | (?:bajo|con) licencia (?:libre|mit|apache|gpl)
free-licence | 3 | .6 | lizenz | unter(?: der)? (?:mit|apache|gpl|freien) lizenz
free-licence | 3 | .6 | licence sous | sous licence (?:libre|mit|apache|gpl)
shareware | 5 | .8 | shareware | shareware
freeware | 5 | .8 | freeware | freeware
fair-use | 4 | .7 | fair use copyright | fair use(?: under)?(?: section 107)?
dmca | 4 | .7 | dmca | dmca(?: takedown)?(?: notice)?
"""


def load() -> list[tuple[str, int, float, tuple[str, ...], str]]:
    """The rules in their order: label, priority, confidence, hint words, pattern."""
    rules = []
    for line in TABLE.strip().splitlines():
        label, priority, confidence, gate, pattern = (x.strip() for x in line.split(" | ", 4))
        pattern = pattern.replace("V?", "(?:v ?|version )?").replace("V[", "(?:v ?|version )?[")
        for d in "0123456789":
            pattern = pattern.replace(f"V{d}", f"(?:v ?|version )?{d}")
        rules.append((label, int(priority), float(confidence), tuple(gate.split()), pattern))
    return rules
