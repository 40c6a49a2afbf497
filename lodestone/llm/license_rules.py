"""Ordered signature rules for license texts.

A line per rule, the most telling first within a license: label | keyword | pattern. The keyword is
a cheap filter, looked for where runs of white space and comment marks are one blank: a text without
it cannot match the pattern. Patterns see text with A-Z lower-cased
and are Java regular expressions; a blank in them stands for any run of white space and comment
marks, of any length. What follows >> is a second pattern that a match must hold: such a rule takes the
rest of its sentence. Priority is by kind: tags (spdx), then named versions, then names and links, then notices.
"""

from __future__ import annotations

import re
from typing import NamedTuple

TAG, VERSION, NAME, NOTICE = 0, 1, 2, 3
CONFIDENCE = {TAG: 1.0, VERSION: 0.95, NAME: 0.85, NOTICE: 0.6}

#: Licenses by SPDX tag, the tag being the label: each gives a tag rule.
TAGGED = """
0bsd aal abstyles afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 aladdin antlr-pd apache-1.0 apache-1.1
apache-2.0 apl-1.0 apsl-1.0 apsl-2.0 artistic-1.0 artistic-2.0 beerware bittorrent-1.1 blueoak-1.0.0 bsd-1-clause
bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 bzip2-1.0.6 cal-1.0 catosl-1.1
cc0-1.0 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0
cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0 curl ecl-2.0
efl-2.0 entessa epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 fair frameworx-1.0 ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0
gpl-3.0 hpnd icu ijg imatix intel ipa ipl-1.0 isc jasper-2.0 json lgpl-2.0 lgpl-2.1 lgpl-3.0 liliq-p-1.1 lpl-1.02
lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 multics nasa-1.3 naumen ncsa ngpl nokia nposl-3.0
ntp oclc-2.0 odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 ogl-uk-3.0 oldap-2.8 openssl oset-pl-2.1 osl-1.0 osl-2.1 osl-3.0
pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 rpl-1.5 rpsl-1.0 rscpl ruby simpl-2.0 sissl sleepycat spl-1.0
ssh-short sspl-1.0 tcl unicode-dfs-2016 unlicense upl-1.0 vim vsl-1.0 w3c watcom-1.0 wtfpl x11 xnet zend-2.0 zlib
zpl-2.0 zpl-2.1
""".split()

#: Named versions.
VERSIONS = r"""
apache-2.0 | apache | apache license,? v(?:ersion)? ?\.? ?2(?:\.0)?
apache-2.0 | apache.org/licenses/license-2.0 | apache\.org/licenses/license-2\.0
apache-1.1 | apache | apache (?:software )?license,? v(?:ersion)? ?1\.1
apache-1.0 | apache | apache (?:software )?license,? v(?:ersion)? ?1\.0
gpl-3.0 | general public license | (?<!lesser )(?<!affero )(?<!library )general public license,? (?:as published by the free software foundation[;,]? (?:either )?)?(?:\(gpl\),? )?v(?:ersion)? ?3(?:\.0)?
gpl-2.0 | general public license | (?<!lesser )(?<!affero )(?<!library )general public license,? (?:as published by the free software foundation[;,]? (?:either )?)?(?:\(gpl\),? )?v(?:ersion)? ?2(?:\.0)?
gpl-1.0 | general public license | (?<!lesser )(?<!affero )(?<!library )general public license,? (?:as published by the free software foundation[;,]? (?:either )?)?v(?:ersion)? ?1(?:\.0)?
gpl-3.0 | gpl | \bgpl ?v(?:ersion)? ?3(?:\.0)?\b
gpl-2.0 | gpl | \bgpl ?v(?:ersion)? ?2(?:\.0)?\b
lgpl-3.0 | lesser general public license | lesser general public license,? (?:as published by the free software foundation[;,]? (?:either )?)?v(?:ersion)? ?3(?:\.0)?
lgpl-2.1 | lesser general public license | lesser general public license,? (?:as published by the free software foundation[;,]? (?:either )?)?v(?:ersion)? ?2\.1
lgpl-2.0 | library general public license | library general public license,? (?:as published by the free software foundation[;,]? (?:either )?)?v(?:ersion)? ?2(?:\.0)?
lgpl-3.0 | lgpl | \blgpl ?v(?:ersion)? ?3(?:\.0)?\b
lgpl-2.1 | lgpl | \blgpl ?v(?:ersion)? ?2\.1\b
agpl-3.0 | affero general public license | affero general public license,? (?:as published by the free software foundation[;,]? (?:either )?)?v(?:ersion)? ?3(?:\.0)?
agpl-3.0 | agpl | \bagpl ?v(?:ersion)? ?3(?:\.0)?\b
gfdl-1.3 | free documentation license | free documentation license,? v(?:ersion)? ?1\.3
gfdl-1.2 | free documentation license | free documentation license,? v(?:ersion)? ?1\.2
gfdl-1.1 | free documentation license | free documentation license,? v(?:ersion)? ?1\.1
mpl-2.0 | mozilla public license | mozilla public license,? v(?:ersion|\.)? ?2\.0
mpl-1.1 | mozilla public license | mozilla public license,? v(?:ersion|\.)? ?1\.1
mpl-1.0 | mozilla public license | mozilla public license,? v(?:ersion|\.)? ?1\.0
epl-2.0 | eclipse public license | eclipse public license,? (?:- )?v(?:ersion)? ?2\.0
epl-1.0 | eclipse public license | eclipse public license,? (?:- )?v(?:ersion)? ?1\.0
cddl-1.1 | common development and distribution license | common development and distribution license (?:\(cddl\) )?v(?:ersion)? ?1\.1
cddl-1.0 | common development and distribution license | common development and distribution license (?:\(cddl\) )?v(?:ersion)? ?1\.0
eupl-1.2 | european union public licen | european union public licen[cs]e,? v(?:ersion|\.)? ?1\.2
eupl-1.1 | european union public licen | european union public licen[cs]e,? v(?:ersion|\.)? ?1\.1
afl-3.0 | academic free license | academic free license,? v(?:ersion|\.)? ?3\.0
afl-2.1 | academic free license | academic free license,? v(?:ersion|\.)? ?2\.1
osl-3.0 | open software license | open software license,? v(?:ersion|\.)? ?3\.0
osl-2.1 | open software license | open software license,? v(?:ersion|\.)? ?2\.1
artistic-2.0 | artistic license | artistic license,? v?(?:ersion)? ?2\.0
artistic-1.0 | artistic license | artistic license,? v?(?:ersion)? ?1\.0
ofl-1.1 | open font license | sil open font license,? v(?:ersion|\.)? ?1\.1
bsl-1.0 | boost software license | boost software license,? (?:- )?v(?:ersion|\.)? ?1\.0
python-2.0 | python software foundation license | python software foundation license,? v(?:ersion|\.)? ?2
cc-by-4.0 | creative commons attribution | creative commons attribution (?:4\.0 international|international 4\.0)
cc-by-3.0 | creative commons attribution | creative commons attribution 3\.0
cc-by-2.5 | creative commons attribution | creative commons attribution 2\.5
cc-by-2.0 | creative commons attribution | creative commons attribution 2\.0
cc-by-sa-4.0 | creative commons attribution | creative commons attribution[- ]share ?alike 4\.0
cc-by-sa-3.0 | creative commons attribution | creative commons attribution[- ]share ?alike 3\.0
cc-by-nc-4.0 | creative commons attribution | creative commons attribution[- ]non ?commercial 4\.0
cc-by-nd-4.0 | creative commons attribution | creative commons attribution[- ]no ?deriv(?:ative)?s? 4\.0
cc-by-nc-sa-4.0 | creative commons attribution | creative commons attribution[- ]non ?commercial[- ]share ?alike 4\.0
cc-by-nc-nd-4.0 | creative commons attribution | creative commons attribution[- ]non ?commercial[- ]no ?deriv(?:ative)?s? 4\.0
cc-by-4.0 | creativecommons.org/licenses/by/4.0 | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | creativecommons.org/licenses/by/3.0 | creativecommons\.org/licenses/by/3\.0
cc-by-sa-4.0 | creativecommons.org/licenses/by-sa/4.0 | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 | creativecommons.org/licenses/by-sa/3.0 | creativecommons\.org/licenses/by-sa/3\.0
cc-by-nc-4.0 | creativecommons.org/licenses/by-nc/4.0 | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-sa-4.0 | creativecommons.org/licenses/by-nc-sa/4.0 | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-nd-4.0 | creativecommons.org/licenses/by-nc-nd/4.0 | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-4.0 | cc by 4.0 | \bcc by 4\.0
cc-by-sa-4.0 | cc by-sa 4.0 | \bcc by-sa 4\.0
cc-by-nc-4.0 | cc by-nc 4.0 | \bcc by-nc 4\.0
cc0-1.0 | creativecommons.org/publicdomain/zero | creativecommons\.org/publicdomain/zero/1\.0
cc0-1.0 | cc0 | \bcc0(?: 1\.0)?(?: universal)?\b
odbl-1.0 | open database license | open database license(?: \(odbl\))?(?: v(?:ersion)? ?1\.0)?
ogl-uk-3.0 | open government licence | open government licence v(?:ersion)? ?3\.0
zpl-2.1 | zope public license | zope public license (?:\(zpl\) )?v(?:ersion|\.)? ?2\.1
php-3.01 | php license | php license,? v(?:ersion|\.)? ?3\.01
lppl-1.3c | latex project public license | latex project public license,? (?:either )?v(?:ersion)? ?1\.3c?
mulanpsl-2.0 | mulan psl | mulan psl v2
sspl-1.0 | server side public license | server side public license,? v(?:ersion)? ?1
upl-1.0 | universal permissive license | universal permissive license,? v(?:ersion)? ?1\.0
ecl-2.0 | educational community license | educational community license,? v(?:ersion)? ?2\.0
bsd-2-clause | bsd | \b(?:2-clause|two-clause|simplified) bsd license\b
bsd-3-clause | bsd | \b(?:3-clause|three-clause|new|modified|revised) bsd license\b
bsd-4-clause | bsd | \b(?:4-clause|four-clause|original) bsd license\b
bsd-2-clause | bsd | \bbsd[- ]2[- ]clause\b
bsd-3-clause | bsd | \bbsd[- ]3[- ]clause\b
apache-2.0 | apache-2.0 | \bapache-2\.0\b
apache-2.0 | asl 2.0 | \basl 2\.0\b
apache-2.0 | apache 2.0 license | \bapache 2\.0 license\b
apache-1.1 | apache-1.1 | \bapache-1\.1\b
gpl-3.0 | gnu.org/licenses/gpl-3.0 | gnu\.org/licenses/gpl-3\.0
gpl-2.0 | gnu.org/licenses/old-licenses/gpl-2.0 | gnu\.org/licenses/old-licenses/gpl-2\.0
lgpl-3.0 | gnu.org/licenses/lgpl-3.0 | gnu\.org/licenses/lgpl-3\.0
lgpl-2.1 | gnu.org/licenses/old-licenses/lgpl-2.1 | gnu\.org/licenses/old-licenses/lgpl-2\.1
agpl-3.0 | gnu.org/licenses/agpl-3.0 | gnu\.org/licenses/agpl-3\.0
gfdl-1.3 | gnu.org/licenses/fdl-1.3 | gnu\.org/licenses/fdl-1\.3
mpl-2.0 | mozilla.org/mpl/2.0 | mozilla\.org/mpl/2\.0
mpl-1.1 | mozilla.org/mpl/mpl-1.1 | mozilla\.org/mpl/mpl-1\.1
epl-2.0 | eclipse.org/legal/epl-2.0 | eclipse\.org/legal/epl-2\.0
epl-1.0 | eclipse.org/legal/epl-v10 | eclipse\.org/legal/epl-v10
artistic-2.0 | perlfoundation.org/artistic_license_2_0 | perlfoundation\.org/artistic_license_2_0
bsl-1.0 | boost.org/license_1_0 | boost\.org/license_1_0\.txt
mit | opensource.org/license/mit | opensource\.org/license/mit\b
bsd-3-clause | opensource.org/licenses/bsd-3-clause | opensource\.org/licenses/bsd-3-clause
bsd-2-clause | opensource.org/licenses/bsd-2-clause | opensource\.org/licenses/bsd-2-clause
isc | opensource.org/licenses/isc | opensource\.org/licenses/isc
zlib | opensource.org/licenses/zlib | opensource\.org/licenses/zlib
cddl-1.0 | opensource.org/licenses/cddl | opensource\.org/licenses/cddl-?1(?:\.0)?
ms-pl | opensource.org/licenses/ms-pl | opensource\.org/licenses/ms-pl
eupl-1.2 | eupl | \beupl[- ]?v?1\.2\b
eupl-1.1 | eupl | \beupl[- ]?v?1\.1\b
cecill-2.1 | cecill | \bcecill(?: free software license agreement)?,? v(?:ersion)? ?2\.1
cecill-2.0 | cecill | \bcecill(?: free software license agreement)?,? v(?:ersion)? ?2\.0
cecill-1.1 | cecill | \bcecill(?: free software license agreement)?,? v(?:ersion)? ?1\.1
osl-2.0 | open software license | open software license,? v(?:ersion|\.)? ?2\.0
osl-1.1 | open software license | open software license,? v(?:ersion|\.)? ?1\.1
osl-1.0 | open software license | open software license,? v(?:ersion|\.)? ?1\.0
afl-2.0 | academic free license | academic free license,? v(?:ersion|\.)? ?2\.0
afl-1.2 | academic free license | academic free license,? v(?:ersion|\.)? ?1\.2
afl-1.1 | academic free license | academic free license,? v(?:ersion|\.)? ?1\.1
ofl-1.0 | open font license | sil open font license,? v(?:ersion|\.)? ?1\.0
cpl-1.0 | common public license | common public license,? (?:- )?v(?:ersion|\.)? ?1\.0
cpl-0.5 | common public license | common public license,? (?:- )?v(?:ersion|\.)? ?0\.5
ipl-1.0 | ibm public license | ibm public license,? v(?:ersion|\.)? ?1\.0
apsl-2.0 | apple public source license | apple public source license,? v(?:er(?:sion)?|er\.)?\.? ?2\.0
apsl-1.2 | apple public source license | apple public source license,? v(?:er(?:sion)?|er\.)?\.? ?1\.2
apsl-1.1 | apple public source license | apple public source license,? v(?:er(?:sion)?|er\.)?\.? ?1\.1
apsl-1.0 | apple public source license | apple public source license,? v(?:er(?:sion)?|er\.)?\.? ?1\.0
npl-1.1 | netscape public license | netscape public license,? v(?:ersion|\.)? ?1\.1
npl-1.0 | netscape public license | netscape public license,? v(?:ersion|\.)? ?1\.0
sissl-1.1 | sun industry standards source license | sun industry standards source license,? v(?:ersion|\.)? ?1\.1
spl-1.0 | sun public license | sun public license,? v(?:ersion|\.)? ?1\.0
zpl-2.0 | zope public license | zope public license (?:\(zpl\) )?v(?:ersion|\.)? ?2\.0
zpl-1.1 | zope public license | zope public license (?:\(zpl\) )?v(?:ersion|\.)? ?1\.1
php-3.0 | php license | php license,? v(?:ersion|\.)? ?3\.0\b
lppl-1.2 | latex project public license | latex project public license,? (?:either )?v(?:ersion)? ?1\.2
lppl-1.1 | latex project public license | latex project public license,? (?:either )?v(?:ersion)? ?1\.1
lppl-1.0 | latex project public license | latex project public license,? (?:either )?v(?:ersion)? ?1\.0
mulanpsl-1.0 | mulan psl | mulan psl v1
cc-by-1.0 | creative commons attribution | creative commons attribution 1\.0
cc-by-sa-2.5 | creative commons attribution | creative commons attribution[- ]share ?alike 2\.5
cc-by-sa-2.0 | creative commons attribution | creative commons attribution[- ]share ?alike 2\.0
cc-by-nc-3.0 | creative commons attribution | creative commons attribution[- ]non ?commercial 3\.0
cc-by-nd-3.0 | creative commons attribution | creative commons attribution[- ]no ?deriv(?:ative)?s? 3\.0
cc-by-nc-sa-3.0 | creative commons attribution | creative commons attribution[- ]non ?commercial[- ]share ?alike 3\.0
cc-by-nc-nd-3.0 | creative commons attribution | creative commons attribution[- ]non ?commercial[- ]no ?deriv(?:ative)?s? 3\.0
cc-by-2.5 | creativecommons.org/licenses/by/2.5 | creativecommons\.org/licenses/by/2\.5
cc-by-2.0 | creativecommons.org/licenses/by/2.0 | creativecommons\.org/licenses/by/2\.0
cc-by-1.0 | creativecommons.org/licenses/by/1.0 | creativecommons\.org/licenses/by/1\.0
cc-by-sa-2.0 | creativecommons.org/licenses/by-sa/2.0 | creativecommons\.org/licenses/by-sa/2\.0
cc-by-nd-4.0 | creativecommons.org/licenses/by-nd/4.0 | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nd-3.0 | creativecommons.org/licenses/by-nd/3.0 | creativecommons\.org/licenses/by-nd/3\.0
cc-by-nc-3.0 | creativecommons.org/licenses/by-nc/3.0 | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-sa-3.0 | creativecommons.org/licenses/by-nc-sa/3.0 | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-3.0 | cc by 3.0 | \bcc by 3\.0
cc-by-sa-3.0 | cc by-sa 3.0 | \bcc by-sa 3\.0
cc-by-nc-sa-4.0 | cc by-nc-sa 4.0 | \bcc by-nc-sa 4\.0
cc-by-nc-nd-4.0 | cc by-nc-nd 4.0 | \bcc by-nc-nd 4\.0
cc-by-nd-4.0 | cc by-nd 4.0 | \bcc by-nd 4\.0
odc-by-1.0 | opendatacommons.org/licenses/by/1-0 | opendatacommons\.org/licenses/by/1-0
odbl-1.0 | opendatacommons.org/licenses/odbl | opendatacommons\.org/licenses/odbl(?:/1[.-]0)?
pddl-1.0 | opendatacommons.org/licenses/pddl | opendatacommons\.org/licenses/pddl(?:/1[.-]0)?
ogl-uk-2.0 | open government licence | open government licence v(?:ersion)? ?2\.0
ogl-uk-1.0 | open government licence | open government licence v(?:ersion)? ?1\.0
etalab-2.0 | licence ouverte | \blicence ouverte(?: ?/ ?open licence)?,? v(?:ersion)? ?2\.0
cdla-permissive-2.0 | community data license agreement | community data license agreement ?[-–] ?permissive ?[-–,]? v(?:ersion)? ?2\.0
cdla-permissive-1.0 | community data license agreement | community data license agreement ?[-–] ?permissive ?[-–,]? v(?:ersion)? ?1\.0
cdla-sharing-1.0 | community data license agreement | community data license agreement ?[-–] ?sharing ?[-–,]? v(?:ersion)? ?1\.0
elastic-2.0 | elastic license | elastic license,? v?(?:ersion)? ?2\.0
business-source-1.1 | business source license | business source license,? v?(?:ersion)? ?1\.1
polyform-noncommercial-1.0.0 | polyform noncommercial license | polyform noncommercial license,? v?(?:ersion)? ?1\.0\.0
polyform-small-business-1.0.0 | polyform small business license | polyform small business license,? v?(?:ersion)? ?1\.0\.0
blueoak-1.0.0 | blue oak model license | blue oak model license,? v?(?:ersion)? ?1\.0\.0
ecl-1.0 | educational community license | educational community license,? v(?:ersion)? ?1\.0
ncsa | opensource.org/licenses/ncsa | opensource\.org/licenses/ncsa
"""

#: Names, sentences of the license texts and links.
NAMES = r"""
apache | apache | \bapache(?: software)? license\b
gpl | general public license | (?<!lesser )(?<!affero )(?<!library )\bgeneral public license\b
lgpl | lesser general public license | \b(?:gnu )?lesser general public license\b
lgpl | library general public license | \b(?:gnu )?library general public license\b
agpl | affero general public license | \b(?:gnu )?affero general public license\b
gfdl | free documentation license | \b(?:gnu )?free documentation license\b
gpl | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?gpl
lgpl | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?lgpl
agpl | gnu.org/licenses/agpl | gnu\.org/licenses/agpl
mit | mit license | \b(?:the )?mit license\b
mit | opensource.org/licenses/mit | opensource\.org/licenses/mit
mit | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy
mit-0 | mit no attribution | \bmit no attribution\b
x11 | x11 license | \bx11 license\b
isc | isc license | \bisc license\b
isc | permission to use, copy, modify, and/or distribute | permission to use, copy, modify, and/or distribute this software for any purpose
bsd | bsd | \bbsd(?:-style)? license\b
bsd | redistribution and use | redistribution and use in source and binary forms,? with or without modification
bsd-3-clause | endorse or promote | neither the names? of [^.;]*+ >> may be used to endorse or promote products
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software
mpl | mozilla public license | \bmozilla public license\b
mpl | mozilla.org/mpl | mozilla\.org/mpl
epl | eclipse public license | \beclipse public license\b
epl | eclipse.org/legal/epl | eclipse\.org/legal/epl
cpl | common public license | \bcommon public license\b
ipl | ibm public license | \bibm public license\b
cddl | common development and distribution license | \bcommon development and distribution license\b
eupl | european union public licen | \beuropean union public licen[cs]e\b
cecill | cecill | \bcecill(?:-[bc])? licen[cs]e\b
afl | academic free license | \bacademic free license\b
osl | open software license | \bopen software license\b
artistic | artistic license | \b(?:the )?artistic license\b
ofl | open font license | \bopen font license\b
ofl | scripts.sil.org/ofl | scripts\.sil\.org/ofl
bsl | boost software license | \bboost software license\b
bsl | boost.org/license | boost\.org/license_1_0
zlib | zlib | \bzlib(?:/libpng)? license\b
zlib | altered source versions | altered source versions must be plainly marked as such
unlicense | unlicense | \b(?:the )?unlicense(?: license)?\b
unlicense | unlicense.org | unlicense\.org
unlicense | released into the public domain | this is free and unencumbered software released into the public domain
wtfpl | wtfpl | \bwtfpl\b
python | python software foundation license | \bpython software foundation license\b
php | php license | \bphp license\b
ruby | ruby license | \bruby license\b
postgresql | postgresql licen | \bpostgresql licen[cs]e\b
openssl | openssl license | \bopenssl license\b
vim | vim license | \bvim license\b
w3c | w3c software | \bw3c software (?:notice and )?licen[cs]e\b
unicode | unicode license | \bunicode license\b
ncsa | university of illinois/ncsa | university of illinois/ncsa open source license
beerware | ware license | \bbeer-?ware license\b
ms-pl | microsoft public license | \bmicrosoft public license\b
ms-rl | microsoft reciprocal license | \bmicrosoft reciprocal license\b
lppl | latex project public license | \blatex project public license\b
qpl | q public license | \bq public license\b
zpl | zope public license | \bzope public license\b
json | json license | \bjson license\b
sspl | server side public license | \bserver side public license\b
upl | universal permissive license | \buniversal permissive license\b
mulanpsl | mulan permissive software license | \bmulan permissive software license\b
cc-by | creative commons attribution | \bcreative commons attribution\b(?![- ](?:share|non|no))
cc-by-sa | creative commons attribution | \bcreative commons attribution[- ]share ?alike\b
cc-by-nc | creative commons attribution | \bcreative commons attribution[- ]non ?commercial\b
cc-by-nd | creative commons attribution | \bcreative commons attribution[- ]no ?deriv(?:ative)?s?\b
creative-commons | creative commons licen | \bcreative commons licen[cs]e\b
creative-commons | creativecommons.org/licenses | creativecommons\.org/licenses/
public-domain | public domain | \b(?:dedicated to|placed in|released into|in) the public domain\b
ogl-uk | open government licence | \bopen government licence\b
odc-by | open data commons attribution | \bopen data commons attribution licen[cs]e\b
pddl | public domain dedication and licen | \bpublic domain dedication and licen[cs]e\b
commons-clause | commons clause license | \bcommons clause license condition\b
business-source | business source license | \bbusiness source license\b
elastic | elastic license | \belastic license\b
polyform | polyform license | \bpolyform license\b
apache | apache software foundation | licensed to the apache software foundation \(asf\) under one
apple | apple public source license | \bapple public source license\b
npl | netscape public license | \bnetscape public license\b
sissl | sun industry standards source license | \bsun industry standards source license\b
spl | sun public license | \bsun public license\b
etalab | licence ouverte | \blicence ouverte\b
cdla | community data license agreement | \bcommunity data license agreement\b
blueoak | blue oak model license | \bblue oak model license\b
polyform | polyform noncommercial license | \bpolyform noncommercial license\b
polyform | polyform small business license | \bpolyform small business license\b
aladdin | aladdin free public license | \baladdin free public license\b
sleepycat | sleepycat | \bsleepycat(?: public)? license\b
bittorrent | bittorrent open source license | \bbittorrent open source license\b
catosl | computer associates trusted open source license | \bcomputer associates trusted open source license\b
cpal | common public attribution license | \bcommon public attribution license\b
cua-opl | cua office public license | \bcua office public license\b
efl | eiffel forum license | \beiffel forum license\b
entessa | entessa public license | \bentessa public license\b
fair | fair license | \bfair license\b
frameworx | frameworx open license | \bframeworx open license\b
freetype | freetype | \b(?:the )?freetype(?: project)? license\b
icu | icu license | \bicu license\b
ijg | independent jpeg group | \bindependent jpeg group'?s? (?:software )?license\b
imagemagick | imagemagick license | \bimagemagick license\b
intel | intel open source license | \bintel open source license\b
jasper | jasper license | \bjasper license\b
libpng | libpng license | \b(?:the )?libpng license\b
lucent | lucent public license | \blucent public license\b
miros | miros licence | \b(?:the )?miros licence\b
motosoto | motosoto open source license | \bmotosoto open source license\b
multics | multics license | \bmultics license\b
nasa | nasa open source agreement | \bnasa open source agreement\b
naumen | naumen public license | \bnaumen public license\b
nethack | nethack general public license | \bnethack general public license\b
nokia | nokia open source license | \bnokia open source license\b
ntp | ntp license | \bntp license\b
oclc | oclc research public license | \boclc research public license\b
oldap | openldap public license | \b(?:the )?openldap public license\b
oset | oset foundation public license | \boset foundation public license\b
osset | open set license | \bopen set license\b
plexus | plexus classworlds license | \bplexus classworlds license\b
realnetworks | realnetworks public source license | \brealnetworks public source license\b
reciprocal | reciprocal public license | \breciprocal public license\b
ricoh | ricoh source code public license | \bricoh source code public license\b
simple | simple public license | \bsimple public license\b
sgi-b | sgi free software license b | \bsgi free software license b\b
sugarcrm | sugarcrm public license | \bsugarcrm public license\b
tcl | tcl/tk license | \btcl/tk license\b
vovida | vovida software license | \bvovida software license\b
watcom | sybase open watcom public license | \bsybase open watcom public license\b
wxwindows | wxwindows library licen | \bwxwindows library licen[cs]e\b
xnet | x.net license | \bx\.net license\b
yahoo | yahoo! public license | \byahoo! public license\b
zend | zend license | \bzend license\b
zed | zed license | \bzed license\b
curl | curl license | \bcurl license\b
openssh | openssh licen | \bopenssh licen[cs]e\b
glide | 3dfx glide source code general public license | \b3dfx glide source code general public license\b
clartistic | clarified artistic license | \bclarified artistic license\b
d-fsl | deutsche freie software lizenz | \bdeutsche freie software lizenz\b
fal | free art license | \bfree art license\b
fal | licence art libre | \blicence art libre\b
opl | open publication license | \bopen publication license\b
opencontent | content license | \bopen ?content license\b
gust | gust font license | \bgust font license\b
bitstream-vera | bitstream vera | \bbitstream vera fonts? (?:copyright|license)\b
ubuntu-font | ubuntu font licence | \bubuntu font licence\b
arphic | arphic public license | \barphic public license\b
hippocratic | hippocratic license | \bhippocratic license\b
anti-996 | anti 996 license | \banti 996 license\b
parity | parity public license | \bparity public license\b
prosperity | prosperity public license | \bprosperity public license\b
confluent | confluent community license | \bconfluent community license\b
redis-sal | redis source available license | \bredis source available license\b
timescale | timescale license | \btimescale license\b
openrail | openrail | \bopenrail(?:-m|\+\+-m|-s)?\b
llama | community license agreement | \bcommunity license agreement\b
mit | including without limitation | including without limitation the rights to use, copy, modify, merge, publish
bsd | reproduce the above copyright notice | redistributions in binary form must reproduce the above copyright notice
gpl | free software foundation; either | published by the free software foundation; either version
gpl | received a copy of the gnu general public license | received a copy of the gnu general public license
lgpl | received a copy of the gnu lesser general public license | received a copy of the gnu lesser general public license
apache | unless required by applicable law | unless required by applicable law or agreed to in writing
mpl | subject to the terms of the mozilla public license | subject to the terms of the mozilla public license
isc | provided that the above copyright notice and this permission notice appear in all copies | provided that the above copyright notice and this permission notice appear in all copies
bsl | to use, reproduce, display, distribute, execute | to use, reproduce, display, distribute, execute, and transmit the software
zlib | origin of this software must not be misrepresented | origin of this software must not be misrepresented
wtfpl | do what the fuck you want to public license | \bdo what the fuck you want to public license\b
cc0 | waived all copyright | waived all copyright and related or neighboring rights
postgresql | without a written agreement | for any purpose, without fee, and without a written agreement
hpnd | historical permission notice and disclaimer | \bhistorical permission notice and disclaimer\b
"""

#: Notices that name no license.
NOTICES = r"""
all-rights-reserved | all rights reserved | \ball rights reserved\b
copyright | copyright | \bcopyright (?:\(c\)|©)? ?[0-9]{4}
copyright | copyright | \bcopyright (?:\(c\)|©) 
proprietary | proprietary and confidential | \bproprietary and confidential\b
proprietary | unauthorized copying | unauthorized copying of this (?:file|document|work)
warranty-disclaimer | without warrant | \bwithout warrant(?:y|ies) (?:of any kind|or conditions)\b
see-license | license file | \bsee (?:the )?(?:accompanying )?license file\b
licensed-under | licensed under | \blicensed under (?:the terms of )?the\b
all-rights-reserved | tous droits réservés | \btous droits réservés
all-rights-reserved | alle rechte vorbehalten | \balle rechte vorbehalten\b
all-rights-reserved | todos los derechos reservados | \btodos los derechos reservados\b
proprietary | trade secret | \bcontains? (?:proprietary|confidential)? ?trade secrets?\b
proprietary | internal use only | \bfor internal use only\b
proprietary | commercial license | \b(?:under|requires|purchase) a commercial license\b
non-commercial | commercial use | \b(?:not for|non-?|no) ?commercial use\b
non-commercial | personal use only | \bfor personal use only\b
research-only | research purposes only | \bfor (?:academic |scientific )?research purposes only\b
warranty-disclaimer | provided "as is" | provided "as is",? without
liability-disclaimer | be liable | \bin no event shall [^.;]*+ >>  be liable\b
license-grant | to use, copy | \bnon-exclusive,? (?:worldwide,? )?(?:royalty-free )?(?:license|right) to use, copy\b
end-user-license | end user license agreement | \bend user license agreement\b
end-user-license | end-user license agreement | \bend-user license agreement\b
dual-license | dual licensed | \b(?:is )?dual licensed\b
dual-license | dual-licensed | \bdual-licensed\b
"""

#: What every keyword holds at least one of; a text without all of them is not looked at again.
STEMS = (
    "licen", "spdx", "gpl", "bsd", "apache", "cc0", "cc by", "creativecommons", "creative commons", "public domain", "copyright", "all rights reserved", "permission is hereby",
    "permission to use", "redistribution and use", "endorse or promote", "advertising materials", "wtfpl", "mozilla.org/mpl", "eclipse.org/legal", "scripts.sil.org", "w3c software", "proprietary and", "unauthorized copying",
    "altered source", "mulan psl", "illinois/ncsa", "without warrant", "cecill", "open government", "open data commons", "mit no attribution", "asl 2.0", "eupl", "mozilla.org",
    "opendatacommons.org", "perlfoundation.org", "boost.org", "community data", "open source agreement", "jpeg group", "bitstream vera", "openrail", "without limitation",
    "permission notice", "free software foundation", "applicable law", "to use, ", "of this software", "waived all", "written agreement", "the fuck you want", "droits r", "vorbehalten",
    "derechos reservados", "trade secret", "use only", "commercial use", "purposes only", "as is", "be liable", "freie software", "zlib", "sleepycat", "freetype",
)


BLANK = r"[\s*#/]"


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str
    also: str = ""
    """A second pattern that a match must hold, if there is one."""


def _blanks(pattern: str) -> str:
    """A blank takes its whole run, so that no match depends on how long a run is."""
    return pattern.replace("[- ]", "(?:-| )").replace(" ?", rf"{BLANK}*+").replace(" ", rf"{BLANK}++")


def _parsed(lines: str, priority: int) -> list[Rule]:
    """Rules from lines. A pattern that must not follow words of its own is matched with them, and dropped if they are there, as an assertion cannot look back over a run of any length."""
    out = []
    for line in lines.strip("\n").split("\n"):
        label, keyword, pattern = (x.lstrip() for x in line.split("|", 2))
        pattern, _, also = pattern.partition(" >> ")
        if before := NOT_BEFORE.findall(pattern):
            pattern, also = f"(?:(?:{'|'.join(before)}) )?" + NOT_BEFORE.sub("", pattern), f"^(?!(?:{'|'.join(before)}){BLANK})"
        out.append(Rule(label.strip(), priority, keyword.strip(), _blanks(pattern), also if before else _blanks(also)))
    return out


NOT_BEFORE = re.compile(r"\(\?<!(\w+) \)")


def rules() -> list[Rule]:
    """All rules in order."""
    tags = [Rule(t, TAG, "spdx-license-identifier", rf"spdx-license-identifier:[^\n]*?(?<![a-z0-9.-]){t.replace('.', '[.]')}(?:-only|-or-later|\+)?(?![a-z0-9.-])") for t in TAGGED]
    return tags + _parsed(VERSIONS, VERSION) + _parsed(NAMES, NAME) + _parsed(NOTICES, NOTICE)
