"""Hand-written licence signatures, one a line:  licence | priority | keywords | pattern.

A blank in a pattern stands for white space, also across comment marks.  A rule is tried only on
texts that hold one of its keywords (lower case), so whatever its pattern matches must hold one
of them, in every spelling and alternative.  Higher priorities win over contained ones:
90 identifier tags, 80 licence texts, 70 notices with a version, 60 addresses, 50 names with a
version, 40 names, 20 mentions of a family, 10 generic.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    number: int
    licence: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern[str]


_V = r"(?:,? ?(?:version|ver\.?|v\.?))?[ -]?"

_RULES = r"""
SPDX-tag | 90 | spdx-license | spdx-license-identifier:[ \t]*(?:\([^)\n]{1,120}\)|[a-z0-9.+-]+(?:[ \t]+(?:and|or|with)[ \t]+[a-z0-9.+-]+)*)
SPDX-tag | 90 | spdx-filecopyrighttext | spdx-filecopyrighttext:[^\n]{1,160}
SPDX-tag | 90 | packagelicensedeclared | packagelicensedeclared:[^\n]{1,120}
SPDX-tag | 90 | packagelicenseconcluded | packagelicenseconcluded:[^\n]{1,120}
Apache-2.0 | 80 | unless required by applicable law | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis
Apache-2.0 | 80 | grant of patent license | grant of patent license\. subject to the terms and conditions of this license
Apache-2.0 | 80 | you may not use this file except | you may not use this file except in compliance with the license
Apache-2.0 | 70 | apache license | licen[cs]ed under (?:the )?(?:terms of )?(?:the )?apache license,? version 2(?:\.0)?
Apache-2.0 | 70 | apache license | (?:released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache license,? (?:version )?2(?:\.0)?
Apache-2.0 | 60 | apache.org/licenses | https?://(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
Apache-2.0 | 50 | apache | apache(?: software)?(?: license)?,?(?: version)?[ -]v?2(?:\.0)?\b(?: license)?
Apache-2.0 | 50 | asl, al-2.0, al 2.0, al-v2.0, al v2.0 | \b(?:asl|al)[ -]v?2\.0\b
Apache-1.1 | 70 | apache software license | (?:licen[cs]ed|released|distributed) under (?:the )?apache software license,? version 1\.1
Apache-1.1 | 50 | apache | apache(?: software)? license,?(?: version)?[ -]v?1\.1\b
Apache-1.0 | 50 | apache | apache(?: software)? license,?(?: version)?[ -]v?1\.0\b
Apache | 20 | apache | apache(?: software)? licen[cs]e\b
MIT | 80 | permission is hereby granted, free of charge | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT | 80 | merchantability | the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
MIT | 70 | mit licen | (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
MIT | 70 | mit-licen | (?:this|the) (?:software|code|project|work|library) is mit-licen[cs]ed
MIT | 60 | opensource.org/licenses/mit | https?://(?:www\.)?opensource\.org/licenses/mit(?:-license)?(?:\.php|\.html)?
MIT | 50 | expat | \b(?:mit/expat|expat/mit|expat licen[cs]e)\b
MIT | 40 | mit licen | \bmit licen[cs]ed?\b
MIT-0 | 50 | mit-0, mit no attribution | \b(?:mit-0|mit no attribution)\b
X11 | 80 | x consortium | except as contained in this notice, the name of the x consortium shall not be used in advertising
X11 | 40 | x11 licen | \bx11 licen[cs]e\b
MIT-CMU | 40 | mit-cmu, cmu licen | \b(?:mit-cmu|cmu licen[cs]e)\b
ISC | 80 | with or without fee | permission to use, copy, modify,? and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted
ISC | 70 | isc licen | (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e
ISC | 40 | isc licen | \bisc licen[cs]e\b
0BSD | 50 | 0bsd, zero-clause bsd, zero clause bsd | \b(?:0bsd|zero[ -]clause bsd)(?: licen[cs]e)?\b
BSD-2-Clause | 70 | bsd | (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of )?(?:the |a )?(?:2[ -]clause|two[ -]clause|simplified) bsd licen[cs]e
BSD-2-Clause | 50 | bsd | \b(?:bsd[ -]2[ -]clause|2[ -]clause bsd|two[ -]clause bsd|simplified bsd|freebsd licen[cs]e)(?: licen[cs]e)?
BSD-3-Clause | 80 | neither the name of | neither the name of .{1,160}? nor the names of its contributors may be used to endorse or promote products
BSD-3-Clause | 70 | bsd | (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of )?(?:the |a )?(?:3[ -]clause|three[ -]clause|new|modified|revised) bsd licen[cs]e
BSD-3-Clause | 50 | bsd | \b(?:bsd[ -]3[ -]clause|3[ -]clause bsd|three[ -]clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
BSD-4-Clause | 80 | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD-4-Clause | 50 | bsd | \b(?:bsd[ -]4[ -]clause|4[ -]clause bsd|four[ -]clause bsd|original bsd)(?: licen[cs]e)?
BSD-1-Clause | 50 | bsd | \b(?:bsd[ -]1[ -]clause|1[ -]clause bsd)(?: licen[cs]e)?
BSD | 80 | redistribution and use in source and binary forms | redistribution and use in source and binary forms, with or without modification, are permitted
BSD | 70 | bsd | (?:licen[cs]ed|released|distributed|governed) (?:under|by) (?:the )?(?:terms of )?(?:the |a )?bsd(?:-style)? licen[cs]e
BSD | 60 | opensource.org/licenses/bsd | https?://(?:www\.)?opensource\.org/licenses/bsd(?:-license|-[234]-clause)?(?:\.php|\.html)?
BSD | 20 | bsd | \bbsd(?:-style|-like)? licen[cs]ed?\b
GPL-1.0 | 70 | general public licen | gnu general public licen[cs]e as published by the free software foundation; either version 1
GPL-2.0-or-later | 80 | general public licen | under the terms of the gnu general public licen[cs]e as published by the free software foundation; either version 2(?:\.0)? of the licen[cs]e,? or \(at your option\) any later version
GPL-3.0-or-later | 80 | general public licen | under the terms of the gnu general public licen[cs]e as published by the free software foundation,? either version 3(?:\.0)? of the licen[cs]e,? or \(at your option\) any later version
GPL-2.0-only | 80 | general public licen | under the terms of the gnu general public licen[cs]e,? version 2(?:\.0)?,? (?:only|as published by the free software foundation)
GPL-3.0-only | 80 | general public licen | under the terms of the gnu general public licen[cs]e,? version 3(?:\.0)?,? (?:only|as published by the free software foundation)
GPL-2.0 | 70 | general public licen | licen[cs]ed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[cs]e,? (?:version |v\.?)?2(?:\.0)?\b
GPL-3.0 | 70 | general public licen | licen[cs]ed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[cs]e,? (?:version |v\.?)?3(?:\.0)?\b
GPL-2.0-or-later | 70 | gpl | \bgpl[ -]?(?:version |v)?2(?:\.0)?(?:\+|[ -]or[ -](?:later|any later version|newer))
GPL-3.0-or-later | 70 | gpl | \bgpl[ -]?(?:version |v)?3(?:\.0)?(?:\+|[ -]or[ -](?:later|any later version|newer))
GPL-2.0-only | 70 | gpl | \bgpl[ -]?(?:version |v)?2(?:\.0)?[ -]only\b
GPL-3.0-only | 70 | gpl | \bgpl[ -]?(?:version |v)?3(?:\.0)?[ -]only\b
GPL-1.0 | 60 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0[a-z.-]*
GPL-2.0 | 60 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0[a-z.-]*
GPL-3.0 | 60 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0[a-z.-]*
GPL | 60 | gnu.org | https?://(?:www\.)?gnu\.org/(?:copyleft|licenses)/gpl\.(?:html|txt)
GPL-1.0 | 50 | gpl | \bgpl[ -]?(?:version |v)?1(?:\.0)?\b
GPL-2.0 | 50 | gpl | \bgpl[ -]?(?:version |v)?2(?:\.0)?\b
GPL-3.0 | 50 | gpl | \bgpl[ -]?(?:version |v)?3(?:\.0)?\b
GPL-2.0 | 50 | general public licen | (?:gnu )?general public licen[cs]e,? (?:version |v\.?)?2(?:\.0)?\b
GPL-3.0 | 50 | general public licen | (?:gnu )?general public licen[cs]e,? (?:version |v\.?)?3(?:\.0)?\b
GPL | 20 | general public licen | \bgnu general public licen[cs]e\b
GPL | 20 | gpl | \b(?:gnu )?gpl(?:'d|-licen[cs]ed)?\b
GPL-2.0-with-classpath-exception | 80 | classpath exception | (?:gpl|general public license).{0,40}with (?:the )?classpath exception
GPL-2.0-with-classpath-exception | 80 | linking this library statically | linking this library statically or dynamically with other modules is making a combined work based on this library
GPL-with-autoconf-exception | 50 | autoconf exception | (?:gpl|general public license).{0,40}with autoconf exception
GPL-with-GCC-exception | 50 | gcc runtime library exception | gcc runtime library exception(?:,? version 3\.1)?
GPL-with-bison-exception | 80 | bison parser skeleton | you may create a larger work that contains part or all of the bison parser skeleton
GPL-with-font-exception | 50 | font exception | (?:gpl|general public license).{0,40}with font exception
GPL-with-linux-syscall-note | 50 | linux-syscall-note, normal system calls | (?:linux-syscall-note|user programs that use kernel services by normal system calls)
LGPL-2.0-or-later | 80 | library general public licen | gnu library general public licen[cs]e as published by the free software foundation; either version 2
LGPL-2.1-or-later | 80 | lesser general public licen | gnu lesser general public licen[cs]e as published by the free software foundation; either version 2\.1
LGPL-3.0-or-later | 80 | lesser general public licen | gnu lesser general public licen[cs]e as published by the free software foundation[;,] either version 3
LGPL-2.1-or-later | 70 | lgpl | \blgpl[ -]?(?:version |v)?2\.1(?:\+|[ -]or[ -]later)
LGPL-3.0-or-later | 70 | lgpl | \blgpl[ -]?(?:version |v)?3(?:\.0)?(?:\+|[ -]or[ -]later)
LGPL-2.1 | 60 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1[a-z.-]*
LGPL-3.0 | 60 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0[a-z.-]*
LGPL | 60 | gnu.org | https?://(?:www\.)?gnu\.org/(?:copyleft|licenses)/lgpl\.(?:html|txt)
LGPL-2.0 | 50 | lgpl | \blgpl[ -]?(?:version |v)?2(?:\.0)?\b
LGPL-2.1 | 50 | lgpl | \blgpl[ -]?(?:version |v)?2\.1\b
LGPL-3.0 | 50 | lgpl | \blgpl[ -]?(?:version |v)?3(?:\.0)?\b
LGPL-2.1 | 50 | lesser general public licen | (?:gnu )?lesser general public licen[cs]e,? (?:version |v\.?)?2\.1\b
LGPL-3.0 | 50 | lesser general public licen | (?:gnu )?lesser general public licen[cs]e,? (?:version |v\.?)?3(?:\.0)?\b
LGPL | 30 | lesser general public licen, library general public licen | \bgnu (?:lesser|library) general public licen[cs]e\b
LGPL | 20 | lgpl | \b(?:gnu )?lgpl\b
AGPL-3.0-or-later | 80 | affero general public licen | gnu affero general public licen[cs]e as published by the free software foundation,? either version 3
AGPL-3.0 | 70 | affero, agpl | licen[cs]ed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:affero general public licen[cs]e|agpl),? (?:version |v)?3(?:\.0)?\b
AGPL-3.0 | 60 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/agpl(?:-3\.0)?[a-z.-]*
AGPL-3.0-or-later | 70 | agpl | \bagpl[ -]?(?:version |v)?3(?:\.0)?(?:\+|[ -]or[ -]later)
AGPL-3.0 | 50 | agpl | \bagpl[ -]?(?:version |v)?3(?:\.0)?\b
AGPL-1.0 | 50 | affero, agpl | \b(?:agpl[ -]?v?1(?:\.0)?|affero general public licen[cs]e,? version 1)\b
AGPL | 30 | affero general public licen | \b(?:gnu )?affero general public licen[cs]e\b
AGPL | 20 | agpl | \bagpl\b
GFDL-1.1 | 50 | free documentation licen, gfdl | (?:free documentation licen[cs]e,? (?:version )?|gfdl[ -]v?)1\.1\b
GFDL-1.2 | 50 | free documentation licen, gfdl | (?:free documentation licen[cs]e,? (?:version )?|gfdl[ -]v?)1\.2\b
GFDL-1.3 | 50 | free documentation licen, gfdl | (?:free documentation licen[cs]e,? (?:version )?|gfdl[ -]v?)1\.3\b
GFDL | 80 | free documentation licen | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e
GFDL | 60 | gnu.org | https?://(?:www\.)?gnu\.org/(?:copyleft|licenses)/fdl(?:-1\.[123])?[a-z.-]*
GFDL | 20 | free documentation licen, gfdl | \b(?:gnu free documentation licen[cs]e|gfdl)\b
MPL-2.0 | 80 | mozilla public licen | this source code form is subject to the terms of the mozilla public licen[cs]e,? v\. ?2\.0
MPL-1.1 | 80 | mozilla public licen | the contents of this file are subject to the mozilla public licen[cs]e version 1\.1
MPL-2.0 | 60 | mozilla.org/mpl, mozilla.org/en-us/mpl | https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0/?
MPL-1.1 | 60 | mozilla.org/mpl | https?://(?:www\.)?mozilla\.org/mpl/(?:mpl-)?1\.1[a-z./-]*
MPL-1.0 | 50 | mpl, mozilla public licen | (?:\bmpl|mozilla public licen[cs]e),?[ -](?:version |v\.? ?)?1\.0\b
MPL-1.1 | 50 | mpl, mozilla public licen | (?:\bmpl|mozilla public licen[cs]e),?[ -](?:version |v\.? ?)?1\.1\b
MPL-2.0 | 50 | mpl, mozilla public licen | (?:\bmpl|mozilla public licen[cs]e),?[ -](?:version |v\.? ?)?2(?:\.0)?\b
MPL | 20 | mozilla public licen | \bmozilla public licen[cs]e\b
NPL-1.1 | 50 | netscape public licen | netscape public licen[cs]e,? (?:version )?1\.[01]
EPL-1.0 | 80 | eclipse public licen | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v(?:ersion )?1\.0
EPL-2.0 | 80 | eclipse public licen | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v?(?:ersion )?2(?:\.0)?
EPL-1.0 | 60 | eclipse.org/legal | https?://(?:www\.)?eclipse\.org/legal/epl-v10[a-z.]*
EPL-2.0 | 60 | eclipse.org/legal | https?://(?:www\.)?eclipse\.org/(?:legal/epl-2\.0|legal/epl-v20)[a-z./]*
EPL-1.0 | 50 | epl, eclipse public licen | (?:\bepl|eclipse public licen[cs]e)[ ,-]+(?:version |v\.? ?)?1(?:\.0)?\b
EPL-2.0 | 50 | epl, eclipse public licen | (?:\bepl|eclipse public licen[cs]e)[ ,-]+(?:version |v\.? ?)?2(?:\.0)?\b
EPL | 20 | eclipse public licen | \beclipse public licen[cs]e\b
EDL-1.0 | 50 | eclipse distribution licen | eclipse distribution licen[cs]e(?:,? (?:version |v\.? ?)?1\.0)?
CPL-1.0 | 50 | common public licen | common public licen[cs]e(?:,? (?:version |v\.? ?)?1\.0)?
IPL-1.0 | 50 | ibm public licen | ibm public licen[cs]e(?:,? (?:version |v\.? ?)?1\.0)?
CDDL-1.0 | 80 | common development and distribution licen | the contents of this file are subject to the terms of (?:either )?(?:the )?common development and distribution licen[cs]e
CDDL-1.1 | 50 | cddl, common development and distribution | (?:\bcddl|common development and distribution licen[cs]e(?: \(cddl\))?),?[ -](?:version |v\.? ?)?1\.1\b
CDDL-1.0 | 50 | cddl, common development and distribution | (?:\bcddl|common development and distribution licen[cs]e(?: \(cddl\))?),?[ -](?:version |v\.? ?)?1\.0\b
CDDL | 20 | cddl, common development and distribution | \b(?:cddl|common development and distribution licen[cs]e)\b
EUPL-1.1 | 50 | eupl, european union public | (?:\beupl|european union public licen[cs]e),?[ -](?:version |v\.? ?)?1\.1\b
EUPL-1.2 | 50 | eupl, european union public | (?:\beupl|european union public licen[cs]e),?[ -](?:version |v\.? ?)?1\.2\b
EUPL | 20 | eupl, european union public | \b(?:eupl|european union public licen[cs]e)\b
CC0-1.0 | 80 | to the extent possible under law | to the extent possible under law, .{1,120}? waived all copyright and related or neighbou?ring rights
CC0-1.0 | 60 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0[a-z./]*
CC0-1.0 | 50 | cc0 | \bcc0(?:[ -]1\.0)?(?: universal)?\b
CC-PDM | 60 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0[a-z./]*
CC-BY | 60 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by/\d\.\d[a-z./]*
CC-BY-SA | 60 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-sa/\d\.\d[a-z./]*
CC-BY-NC | 60 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-nc/\d\.\d[a-z./]*
CC-BY-ND | 60 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-nd/\d\.\d[a-z./]*
CC-BY-NC-SA | 60 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/\d\.\d[a-z./]*
CC-BY-NC-ND | 60 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-nc-nd/\d\.\d[a-z./]*
CC-BY-4.0 | 70 | cc by, cc-by | licen[cs]ed under (?:a |the )?cc[ -]by(?: |-v?)4\.0\b
CC-BY-SA-4.0 | 70 | cc by, cc-by | licen[cs]ed under (?:a |the )?cc[ -]by[ -]sa(?: |-v?)4\.0\b
CC-BY-NC-4.0 | 70 | cc by, cc-by | licen[cs]ed under (?:a |the )?cc[ -]by[ -]nc(?: |-v?)4\.0\b
CC-BY-ND-4.0 | 70 | cc by, cc-by | licen[cs]ed under (?:a |the )?cc[ -]by[ -]nd(?: |-v?)4\.0\b
CC-BY-NC-SA-4.0 | 70 | cc by, cc-by | licen[cs]ed under (?:a |the )?cc[ -]by[ -]nc[ -]sa(?: |-v?)4\.0\b
CC-BY-NC-ND-4.0 | 70 | cc by, cc-by | licen[cs]ed under (?:a |the )?cc[ -]by[ -]nc[ -]nd(?: |-v?)4\.0\b
CC-BY-2.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]2\.0\b
CC-BY-2.5 | 50 | cc by, cc-by | \bcc[ -]by[ -]2\.5\b
CC-BY-3.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]3\.0\b
CC-BY-4.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]4\.0\b
CC-BY-SA-2.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]sa[ -]2\.0\b
CC-BY-SA-2.5 | 50 | cc by, cc-by | \bcc[ -]by[ -]sa[ -]2\.5\b
CC-BY-SA-3.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]sa[ -]3\.0\b
CC-BY-SA-4.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]sa[ -]4\.0\b
CC-BY-NC-3.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]nc[ -]3\.0\b
CC-BY-NC-4.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]nc[ -]4\.0\b
CC-BY-ND-3.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]nd[ -]3\.0\b
CC-BY-ND-4.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]nd[ -]4\.0\b
CC-BY-NC-SA-3.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]nc[ -]sa[ -]3\.0\b
CC-BY-NC-SA-4.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]nc[ -]sa[ -]4\.0\b
CC-BY-NC-ND-3.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]nc[ -]nd[ -]3\.0\b
CC-BY-NC-ND-4.0 | 50 | cc by, cc-by | \bcc[ -]by[ -]nc[ -]nd[ -]4\.0\b
CC-BY | 40 | cc by, cc-by | \bcc[ -]by\b(?![ -](?:sa|nc|nd)\b)
CC-BY-SA | 40 | cc by, cc-by | \bcc[ -]by[ -]sa\b
CC-BY-NC | 40 | cc by, cc-by | \bcc[ -]by[ -]nc\b(?![ -](?:sa|nd)\b)
CC-BY-ND | 40 | cc by, cc-by | \bcc[ -]by[ -]nd\b
CC-BY-NC-SA | 40 | cc by, cc-by | \bcc[ -]by[ -]nc[ -]sa\b
CC-BY-NC-ND | 40 | cc by, cc-by | \bcc[ -]by[ -]nc[ -]nd\b
CC-BY-NC-SA | 50 | creative commons | creative commons attribution[ -]non-?commercial[ -]share-?alike(?: \d\.\d)?(?: (?:international|unported|generic))?(?: licen[cs]e)?
CC-BY-NC-ND | 50 | creative commons | creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:s|atives|ative works)(?: \d\.\d)?(?: (?:international|unported|generic))?(?: licen[cs]e)?
CC-BY-NC | 45 | creative commons | creative commons attribution[ -]non-?commercial(?: \d\.\d)?(?: (?:international|unported|generic))?(?: licen[cs]e)?
CC-BY-SA | 45 | creative commons | creative commons attribution[ -]share-?alike(?: \d\.\d)?(?: (?:international|unported|generic))?(?: licen[cs]e)?
CC-BY-ND | 45 | creative commons | creative commons attribution[ -]no-?deriv(?:s|atives|ative works)(?: \d\.\d)?(?: (?:international|unported|generic))?(?: licen[cs]e)?
CC-BY | 40 | creative commons | creative commons attribution(?: \d\.\d)?(?: (?:international|unported|generic))?(?: licen[cs]e)?
CC | 20 | creative commons | \bcreative commons(?: licen[cs]e)?\b
Unlicense | 80 | free and unencumbered software | this is free and unencumbered software released into the public domain
Unlicense | 60 | unlicense.org | https?://(?:www\.)?unlicense\.org/?
Unlicense | 40 | unlicense | \bthe unlicense\b
WTFPL | 80 | do what the fuck you want to | do what the fuck you want to public licen[cs]e
WTFPL | 40 | wtfpl | \bwtfpl\b
Zlib | 80 | appreciated but is not required | an acknowledgment in the product documentation would be appreciated but is not required
Zlib | 40 | zlib | \bzlib(?:/libpng)? licen[cs]e\b
libpng | 40 | libpng licen | \blibpng licen[cs]e\b
BSL-1.0 | 80 | boost software licen | distributed under the boost software licen[cs]e,? version 1\.0
BSL-1.0 | 60 | boost.org/license | https?://(?:www\.)?boost\.org/license_1_0\.txt
BSL-1.0 | 40 | boost software licen | \bboost software licen[cs]e\b
BUSL-1.1 | 50 | business source licen, busl | \b(?:business source licen[cs]e(?:,? (?:version )?1\.1)?|busl[ -]1\.1)\b
SSPL-1.0 | 50 | server side public licen, sspl | \b(?:server side public licen[cs]e(?:,? (?:version |v)?1)?|sspl(?:[ -]v?1(?:\.0)?)?)\b
Elastic-2.0 | 50 | elastic licen | \belastic licen[cs]e(?:,? (?:version |v)?2(?:\.0)?)?\b
Commons-Clause | 50 | commons clause | \bcommons clause(?: licen[cs]e condition)?(?: v?1\.0)?\b
Polyform-Noncommercial | 50 | polyform | \bpolyform non-?commercial(?: licen[cs]e)?(?: 1\.0\.0)?\b
Polyform-Shield | 50 | polyform | \bpolyform shield(?: licen[cs]e)?(?: 1\.0\.0)?\b
Polyform-Small-Business | 50 | polyform | \bpolyform small business(?: licen[cs]e)?(?: 1\.0\.0)?\b
Artistic-2.0 | 50 | artistic licen | \bartistic licen[cs]e,?[ -](?:version |v)?2(?:\.0)?\b
Artistic-1.0 | 50 | artistic licen | \bartistic licen[cs]e,?[ -](?:version |v)?1(?:\.0)?\b
Artistic | 20 | artistic licen | \bartistic licen[cs]e\b
Perl | 70 | same terms as perl | (?:under|on) the same terms as perl(?: itself| 5)?
Python-2.0 | 50 | python software foundation, psf | \b(?:python software foundation licen[cs]e(?:,? version 2)?|psf licen[cs]e|psf-2\.0)\b
CNRI-Python | 50 | cnri | \bcnri (?:python|open source) licen[cs]e\b
Ruby | 40 | ruby licen, ruby's licen | \bruby(?:'s)? licen[cs]e\b
PHP-3.01 | 50 | php licen | \bphp licen[cs]e,?(?: (?:version |v)?3\.01?)?\b
ZPL-2.1 | 50 | zope public licen | \bzope public licen[cs]e,?(?: (?:version |v)?2\.[01])?\b
OpenSSL | 80 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
OpenSSL | 40 | openssl licen | \bopenssl licen[cs]e\b
SSLeay | 80 | eric young | this product includes cryptographic software written by eric young
OLDAP-2.8 | 50 | openldap public licen | \bopenldap public licen[cs]e,?(?: (?:version |v)?2\.8)?\b
PostgreSQL | 40 | postgresql licen | \bpostgresql licen[cs]e\b
curl | 40 | curl licen | \bcurl licen[cs]e\b
ICU | 40 | icu licen | \bicu licen[cs]e\b
Unicode | 50 | unicode | \bunicode(?:,? inc\.)? licen[cs]e(?: agreement)?(?: v3)?\b
NCSA | 50 | ncsa | \b(?:university of illinois/?ncsa|ncsa) open source licen[cs]e\b
W3C | 50 | w3c | \bw3c(?:\(r\))? software (?:notice and )?(?:and document )?licen[cs]e\b
OFL-1.1 | 80 | sil open font licen | this font software is licen[cs]ed under the sil open font licen[cs]e,? version 1\.1
OFL-1.1 | 60 | scripts.sil.org/ofl, openfontlicense.org | https?://(?:scripts\.sil\.org/ofl|openfontlicense\.org)[a-z/]*
OFL-1.1 | 40 | open font licen | \b(?:sil )?open font licen[cs]e(?:,? (?:version |v)?1\.1)?\b
LPPL-1.3c | 50 | latex project public licen, lppl | \b(?:latex project public licen[cs]e(?:,? (?:version |v)?1\.3[ac]?)?|lppl[ -]1\.3[ac]?)\b
APSL-2.0 | 50 | apple public source licen | \bapple public source licen[cs]e(?:,? (?:version |v)?[12]\.\d)?\b
MS-PL | 50 | microsoft public licen, ms-pl | \b(?:microsoft public licen[cs]e|ms-pl)\b
MS-RL | 50 | microsoft reciprocal licen, ms-rl | \b(?:microsoft reciprocal licen[cs]e|ms-rl)\b
OSL-3.0 | 50 | open software licen | \bopen software licen[cs]e,?(?: (?:version |v)?3\.0)?\b
AFL-3.0 | 50 | academic free licen | \bacademic free licen[cs]e,?(?: (?:version |v)?[23]\.\d)?\b
ECL-2.0 | 50 | educational community licen | \beducational community licen[cs]e,?(?: (?:version |v)?2\.0)?\b
CeCILL-2.1 | 50 | cecill | \bcecill(?:-[bc])?(?:,?[ -](?:version |v)?[12](?:\.[01])?)?\b
MulanPSL-2.0 | 50 | mulan | \bmulan (?:psl|permissive software licen[cs]e),?[ -]?(?:v(?:ersion)? ?)?[12]?\b
QPL-1.0 | 50 | q public licen | \bq public licen[cs]e(?:,? (?:version |v)?1\.0)?\b
Sleepycat | 40 | sleepycat | \bsleepycat licen[cs]e\b
SISSL | 50 | sun industry standards source | \bsun industry standards source licen[cs]e\b
SPL-1.0 | 50 | sun public licen | \bsun public licen[cs]e(?:,? (?:version |v)?1\.0)?\b
NASA-1.3 | 50 | nasa open source agreement | \bnasa open source agreement(?:,? (?:version |v)?1\.3)?\b
JSON | 80 | used for good, not evil | the software shall be used for good,? not evil
Beerware | 80 | beer-ware, beerware | "?the beer-?ware licen[cs]e"?
Vim | 40 | vim licen | \bvim licen[cs]e\b
UPL-1.0 | 50 | universal permissive licen | \buniversal permissive licen[cs]e,?(?: (?:version |v)?1\.0)?\b
BlueOak-1.0.0 | 50 | blue oak model licen | \bblue oak model licen[cs]e(?: 1\.0\.0)?\b
Hippocratic-2.1 | 50 | hippocratic licen | \bhippocratic licen[cs]e(?:,? (?:version )?[123]\.\d)?\b
Parity-7.0.0 | 50 | parity public licen | \bparity public licen[cs]e(?: 7\.0\.0)?\b
ODbL-1.0 | 50 | open database licen, odbl | \b(?:open database licen[cs]e(?: \(odbl\))?(?:,? (?:version |v)?1\.0)?|odbl(?:[ -]1\.0)?)\b
ODC-By-1.0 | 50 | open data commons | \bopen data commons attribution licen[cs]e(?:,? (?:version |v)?1\.0)?\b
PDDL-1.0 | 50 | public domain dedication and licen, pddl | \b(?:public domain dedication and licen[cs]e|pddl)(?:[ -]1\.0)?\b
CDLA-Permissive | 50 | community data licen | \bcommunity data licen[cs]e agreement[ ,–-]+permissive(?:[ ,–-]+(?:version )?[12]\.0)?
CDLA-Sharing | 50 | community data licen | \bcommunity data licen[cs]e agreement[ ,–-]+sharing(?:[ ,–-]+(?:version )?1\.0)?
OGL-UK-3.0 | 50 | open government licence, open government license | \bopen government licen[cs]e,?(?: (?:version |v)?[123]\.0)?\b
Etalab-2.0 | 50 | licence ouverte, etalab | \b(?:licence ouverte|etalab)(?:[ /,-]+(?:open licence|version|v)? ?[12]\.0)?\b
DL-DE-BY-2.0 | 50 | datenlizenz deutschland | \bdatenlizenz deutschland[ ,–-]+(?:namensnennung|zero)[ ,–-]+(?:version )?2\.0\b
RAIL | 50 | openrail, open rail, responsible ai licen | \b(?:(?:bigscience|creativeml|bigcode)? ?open ?rail(?:[+-]?[+ma-z]*)?|responsible ai licen[cs]e)\b
Llama | 50 | community licen | \bllama(?: ?[23](?:\.\d)?)? community licen[cs]e agreement\b
Open-Publication | 50 | open publication licen | \bopen publication licen[cs]e,?(?: v1\.0)?\b
Free-Art-1.3 | 50 | free art licen, licence art libre | \b(?:free art licen[cs]e|licence art libre)(?: 1\.3)?\b
Public-Domain | 70 | public domain | (?:is|are|has been|have been|hereby) (?:hereby )?(?:placed|released|dedicated|put) (?:in|into|to) the public domain
Public-Domain | 20 | public domain | \b(?:in the )?public domain\b
Dual | 70 | dual | dual[ -]licen[cs]ed under (?:the )?.{1,60}? and (?:the )?.{1,60}? licen[cs]es?
Dual | 30 | dual | \bdual[ -]licen[cs]ed\b
Proprietary | 80 | confidential | proprietary and confidential\.? (?:unauthorized|do not)
Proprietary | 70 | unauthorized copying | unauthorized copying of this (?:file|software|document|work),? via any medium,? is strictly prohibited
Proprietary | 70 | may not be reproduced, may not be copied, may not be distributed, no part of this | (?:may not be|no part of this .{1,40}? may be) (?:reproduced|copied|distributed)(?:,? (?:reproduced|copied|stored|distributed|transmitted))* .{0,60}?without (?:the )?(?:prior |express )*(?:written )?(?:permission|consent)
Proprietary | 70 | end user licen, end-user licen | \bend[ -]user licen[cs]e agreement\b
Proprietary | 50 | commercial licen | \b(?:requires|under|available under) a commercial licen[cs]e\b
Proprietary | 40 | all rights reserved | \ball rights reserved\b
Noncommercial | 50 | commercial use | (?:for )?non-?commercial use only|not for commercial use|commercial use (?:is )?(?:strictly )?prohibited
Research-only | 50 | use only, purposes only | (?:for )?(?:academic|research)(?: and educational)? (?:use|purposes) only
Copyright | 10 | copyright | \bcopyright (?:\(c\)|©)? ?(?:19|20)\d\d(?: ?[-–,] ?(?:19|20)\d\d)*,?(?: (?:by )?[^\n.]{1,80})?
Copyright | 10 | © | © ?(?:19|20)\d\d(?: ?[-–,] ?(?:19|20)\d\d)*,?(?: (?:by )?[^\n.]{1,80})?
Copyright | 10 | (c) | \(c\) (?:19|20)\d\d(?: ?[-–,] ?(?:19|20)\d\d)*,?(?: (?:by )?[^\n.]{1,80})?
Warranty-disclaimer | 30 | without warrant, without any warrant | without (?:any )?warrant(?:y|ies)(?: or conditions)? of any kind,? (?:either )?express(?:ed)? or implied
Warranty-disclaimer | 30 | without any warranty | in the hope that it will be useful,? but without any warranty
Generic | 10 | licensed under, licenced under | \blicen[cs]ed under (?:the )?(?:terms of )?[a-z0-9][^\n.]{1,60}
Generic | 10 | released under, distributed under | \b(?:released|distributed) under (?:the )?(?:terms of )?(?:the )?[^\n.]{1,40}? licen[cs]e\b
Generic | 10 | see licen, see the licen, see accompanying licen, see the accompanying licen | \bsee (?:the )?(?:accompanying )?licen[cs]e(?:\.txt|\.md| file)?(?: for (?:details|more information))?
Generic | 10 | open source licen, open-source licen | \bopen[ -]source licen[cs]e\b
"""

_GAP = r"[\s*#/]+"


def _compiled(pattern: str) -> re.Pattern[str]:
    out, bracket, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if c == "[":
            bracket = True
        elif c == "]":
            bracket = False
        out.append((r"\s" if bracket else _GAP) if c == " " else c)
        k += 1
    text = "".join(out).replace(_GAP + "?", r"[\s*#/]*")
    return re.compile(text, re.IGNORECASE)


def _parse() -> list[Rule]:
    rules = []
    for line in _RULES.strip().splitlines():
        licence, priority, keywords, pattern = line.split(" | ", 3)
        rules.append(Rule(len(rules), licence, int(priority), tuple(k.strip() for k in keywords.split(",") if k.strip()), _compiled(pattern)))
    return rules


RULES = _parse()
