"""License signatures, written by hand: one a line, as ``priority | label | keyword | pattern``.

Less priority is stronger. The keyword must occur in a text for the pattern to be
tried. Patterns match lower-cased text; a blank stands for white space of any
length, `` ?`` for such or none, ``[- ]`` for a hyphen or a blank.
"""

from __future__ import annotations

# License identifiers as the SPDX list spells them, behind their tag.
SPDX = """
1 | agpl-3.0 | spdx | spdx-license-identifier: ?agpl-3\\.0(?:-only|-or-later)?
1 | apache-1.1 | spdx | spdx-license-identifier: ?apache-1\\.1
1 | apache-2.0 | spdx | spdx-license-identifier: ?apache-2\\.0
1 | artistic-1.0 | spdx | spdx-license-identifier: ?artistic-1\\.0(?:-perl|-cl8)?
1 | artistic-2.0 | spdx | spdx-license-identifier: ?artistic-2\\.0
1 | blueoak-1.0.0 | spdx | spdx-license-identifier: ?blueoak-1\\.0\\.0
1 | boost-1.0 | spdx | spdx-license-identifier: ?bsl-1\\.0
1 | bsd-0-clause | spdx | spdx-license-identifier: ?0bsd
1 | bsd-2-clause | spdx | spdx-license-identifier: ?bsd-2-clause(?:-patent|-views)?
1 | bsd-3-clause | spdx | spdx-license-identifier: ?bsd-3-clause(?:-clear|-lbnl)?
1 | bsd-4-clause | spdx | spdx-license-identifier: ?bsd-4-clause(?:-uc)?
1 | busl-1.1 | spdx | spdx-license-identifier: ?busl-1\\.1
1 | cc0-1.0 | spdx | spdx-license-identifier: ?cc0-1\\.0
1 | cc-by | spdx | spdx-license-identifier: ?cc-by-[1-4]\\.[05]
1 | cc-by-nc | spdx | spdx-license-identifier: ?cc-by-nc-[1-4]\\.[05]
1 | cc-by-nc-nd | spdx | spdx-license-identifier: ?cc-by-nc-nd-[1-4]\\.[05]
1 | cc-by-nc-sa | spdx | spdx-license-identifier: ?cc-by-nc-sa-[1-4]\\.[05]
1 | cc-by-nd | spdx | spdx-license-identifier: ?cc-by-nd-[1-4]\\.[05]
1 | cc-by-sa | spdx | spdx-license-identifier: ?cc-by-sa-[1-4]\\.[05]
1 | cddl | spdx | spdx-license-identifier: ?cddl-1\\.[01]
1 | cecill-2.1 | spdx | spdx-license-identifier: ?cecill-(?:2\\.[01]|b|c)
1 | cpl-1.0 | spdx | spdx-license-identifier: ?cpl-1\\.0
1 | ecl-2.0 | spdx | spdx-license-identifier: ?ecl-2\\.0
1 | epl-1.0 | spdx | spdx-license-identifier: ?epl-1\\.0
1 | epl-2.0 | spdx | spdx-license-identifier: ?epl-2\\.0
1 | eupl | spdx | spdx-license-identifier: ?eupl-1\\.[0-2]
1 | gfdl | spdx | spdx-license-identifier: ?gfdl-1\\.[1-3](?:-only|-or-later)?
1 | gpl-1.0 | spdx | spdx-license-identifier: ?gpl-?v?1\\.0(?:-only|-or-later|\\+)?
1 | gpl-2.0 | spdx | spdx-license-identifier: ?gpl-?v?2(?:\\.0)?(?:-only|-or-later|\\+)?
1 | gpl-3.0 | spdx | spdx-license-identifier: ?gpl-?v?3(?:\\.0)?(?:-only|-or-later|\\+)?
1 | ijg | spdx | spdx-license-identifier: ?ijg
1 | isc | spdx | spdx-license-identifier: ?isc
1 | lgpl | spdx | spdx-license-identifier: ?lgpl-(?:2\\.[01]|3\\.0)(?:-only|-or-later|\\+)?
1 | libpng | spdx | spdx-license-identifier: ?libpng(?:-2\\.0)?
1 | lppl-1.3 | spdx | spdx-license-identifier: ?lppl-1\\.3[ac]
1 | mit | spdx | spdx-license-identifier: ?mit
1 | mit-0 | spdx | spdx-license-identifier: ?mit-0
1 | mpl-1.1 | spdx | spdx-license-identifier: ?mpl-1\\.1
1 | mpl-2.0 | spdx | spdx-license-identifier: ?mpl-2\\.0(?:-no-copyleft-exception)?
1 | ms-pl | spdx | spdx-license-identifier: ?ms-pl
1 | ms-rl | spdx | spdx-license-identifier: ?ms-rl
1 | mulan-2.0 | spdx | spdx-license-identifier: ?mulanpsl-2\\.0
1 | ncsa | spdx | spdx-license-identifier: ?ncsa
1 | odbl-1.0 | spdx | spdx-license-identifier: ?odbl-1\\.0
1 | ofl-1.1 | spdx | spdx-license-identifier: ?ofl-1\\.1
1 | openssl | spdx | spdx-license-identifier: ?openssl
1 | osl-3.0 | spdx | spdx-license-identifier: ?osl-3\\.0
1 | php-3.01 | spdx | spdx-license-identifier: ?php-3\\.01
1 | postgresql | spdx | spdx-license-identifier: ?postgresql
1 | python-2.0 | spdx | spdx-license-identifier: ?(?:python|psf)-2\\.0
1 | ruby | spdx | spdx-license-identifier: ?ruby
1 | sspl-1.0 | spdx | spdx-license-identifier: ?sspl-1\\.0
1 | unicode | spdx | spdx-license-identifier: ?unicode-dfs-201[56]
1 | unlicense | spdx | spdx-license-identifier: ?unlicense
1 | upl-1.0 | spdx | spdx-license-identifier: ?upl-1\\.0
1 | wtfpl | spdx | spdx-license-identifier: ?wtfpl
1 | x11 | spdx | spdx-license-identifier: ?x11
1 | zlib | spdx | spdx-license-identifier: ?zlib
1 | zpl-2.1 | spdx | spdx-license-identifier: ?zpl-2\\.1
"""

# Sentences of the licenses' own texts and of the notices that they ask for.
BODIES = """
2 | gpl | general public | you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e
1 | gpl-2.0 | general public | gnu general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 2
1 | gpl-3.0 | general public | gnu general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 3
2 | gpl | general public | you should have received a copy of the gnu general public licen[cs]e
1 | lgpl | general public | gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation
2 | lgpl | lesser | you should have received a copy of the gnu lesser general public licen[cs]e
1 | agpl-3.0 | affero | gnu affero general public licen[cs]e as published by the free software foundation
2 | agpl-3.0 | affero | you should have received a copy of the gnu affero general public licen[cs]e
2 | agpl-3.0 | interacting with it remotely | all users interacting with it remotely through a computer network
2 | gpl | general public | mere aggregation of another work not based on the program
2 | gpl-3.0 | copyleft | the gnu general public licen[cs]e is a free,? copyleft licen[cs]e for software
2 | gpl-2.0 | programs and source | activities other than copying, distribution and modification are not covered by this licen[cs]e
2 | gpl-exception | exception | as a special exception, the copyright holders? (?:of this library )?gives? (?:you )?permission to link
2 | gpl-classpath | exception | as a special exception, if other files instantiate templates
2 | gpl-linux | syscall | this copyright does not cover user programs that use kernel services by normal system calls
2 | gfdl | documentation | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e
2 | gfdl | invariant | with no invariant sections, no front-cover texts,? and no back-cover texts
2 | apache-2.0 | apache | licensed under the apache licen[cs]e, version 2\\.0
2 | apache-2.0 | apache | you may not use this file except in compliance with the licen[cs]e
2 | apache-2.0 | apache | unless required by applicable law or agreed to in writing, software distributed under the licen[cs]e is distributed on an
2 | apache-2.0 | contributor | each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable
2 | apache-2.0 | apache | licensed to the apache software foundation \\(asf\\) under one or more contributor licen[cs]e agreements
2 | apache-1.1 | apache | this product includes software developed by the apache software foundation
2 | apache-1.0 | apache | this product includes software developed by the apache group
2 | mit | permission | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
2 | mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
2 | mit | warranty | the software is provided [\"']?as is[\"']?, without warranty of any kind, express or implied
2 | mit-0 | permission | to permit persons to whom the software is furnished to do so\\. the software is provided
2 | mit-cmu | permission | permission to use, copy, modify and distribute this software and its documentation is hereby granted, provided that both the copyright notice
2 | x11 | except as contained | except as contained in this notice, the name of the x consortium shall not be used in advertising
2 | mit-advertising | advertising | except as contained in this notice, the names? of the above copyright holders? shall not be used in advertising
2 | isc | permission | permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
2 | bsd-0-clause | permission | permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted\\.
2 | isc | disclaims | the software is provided [\"']?as is[\"']? and the author disclaims all warranties
2 | bsd | redistribution | redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
2 | bsd | redistributions | redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
2 | bsd | redistributions | redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
2 | bsd-3-clause | endorse | neither the names? of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse or promote products
2 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
2 | bsd-3-clause | endorse | the names? of the (?:author|copyright holder)s? may not be used to endorse or promote products
2 | bsd-2-clause-patent | patent | each copyright holder and contributor hereby grants to those receiving rights under this licen[cs]e a perpetual
2 | bsd-clear | patent | no express or implied licen[cs]es to any party's patent rights are granted by this licen[cs]e
2 | mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public licen[cs]e version 1\\.1
2 | mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e, v\\. ?2\\.0
2 | mpl-2.0 | incompatible | this source code form is [\"']?incompatible with secondary licen[cs]es
2 | mpl-2.0 | mozilla | if a copy of the mpl was not distributed with this file
2 | mpl-1.0 | netscape | the contents of this file are subject to the netscape public licen[cs]e
2 | epl-1.0 | eclipse | made available under the terms of the eclipse public licen[cs]e v1\\.0
2 | epl-2.0 | eclipse | made available under the terms of the eclipse public licen[cs]e,? (?:v\\. ?|version )2\\.0
2 | epl | eclipse | this program and the accompanying materials are made available under the terms of the eclipse
2 | edl-1.0 | eclipse | eclipse distribution licen[cs]e,? (?:v\\. ?|version )1\\.0
2 | cpl-1.0 | common public | this program and the accompanying materials are made available under the terms of the common public licen[cs]e
2 | ipl-1.0 | ibm public | the accompanying program is provided under the terms of this ibm public licen[cs]e
2 | cddl | common development | subject to the terms of the common development and distribution licen[cs]e
2 | cddl | cddl | you can obtain a copy of the licen[cs]e at .{1,60}?cddl
2 | artistic-1.0 | artistic | the intent of this document is to state the conditions under which a package may be copied
2 | artistic-2.0 | artistic | this licen[cs]e establishes the terms under which a given free software package may be copied
2 | artistic-1.0 | perl | under the same terms as perl itself
2 | ruby | ruby | you may distribute it and/or modify it under the same terms as ruby
2 | boost-1.0 | boost | distributed under the boost software licen[cs]e, version 1\\.0
2 | boost-1.0 | permission | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
2 | zlib | altered | altered source versions must be plainly marked as such
2 | zlib | origin | the origin of this software must not be misrepresented
2 | zlib | implied | this software is provided [\"']?as-is[\"']?, without any express or implied warranty
2 | libpng | libpng | this copy of the libpng notices is provided for your convenience
2 | ijg | jpeg | this software is based in part on the work of the independent jpeg group
2 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
2 | wtfpl | fuck | you just do what the fuck you want to
2 | beerware | beer | if we meet some day, and you think this stuff is worth it, you can buy me a beer
2 | json | evil | the software shall be used for good, not evil
2 | cc0-1.0 | cc0 | to the extent possible under law, .{1,80}? has waived all copyright and related or neighbou?ring rights
2 | cc0-1.0 | waive | affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives
2 | cc-by | creative commons | this (?:work|article|file) is licensed under (?:a|the) creative commons attribution (?:[1-4]\\.[05] )?(?:international )?licen[cs]e
2 | cc-by-sa | creative commons | this (?:work|article|file) is licensed under (?:a|the) creative commons attribution[- ]share[- ]?alike
2 | cc-by-nc | creative commons | this (?:work|article|file) is licensed under (?:a|the) creative commons attribution[- ]non[- ]?commercial (?:[1-4]\\.[05] )?(?:international )?licen[cs]e
2 | cc-by-nc-nd | creative commons | this (?:work|article|file) is licensed under (?:a|the) creative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative)?s
2 | cc-by-nc-sa | creative commons | this (?:work|article|file) is licensed under (?:a|the) creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike
2 | cc-by-nd | creative commons | this (?:work|article|file) is licensed under (?:a|the) creative commons attribution[- ]no[- ]?deriv(?:ative)?s
2 | cc-by | open access | this is an open access article distributed under the terms of the creative commons attribution licen[cs]e
2 | ofl-1.1 | font | this font software is licensed under the sil open font licen[cs]e
2 | ofl-1.1 | reserved font | no modified version of the font software may use the reserved font names?
2 | bitstream-vera | font | the font software may be modified, altered, or added to
2 | ubuntu-font-1.0 | font | ubuntu font licen[cs]e(?: version)? 1\\.0
2 | python-2.0 | psf | psf hereby grants licensee a nonexclusive, royalty-free, world-wide licen[cs]e
2 | cnri-python | cnri | cnri hereby grants licensee a nonexclusive, royalty-free
2 | openssl | openssl | this product includes software developed by the openssl project
2 | ssleay | cryptographic | this product includes cryptographic software written by eric young
2 | postgresql | permission | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
2 | php-3.01 | php | this product includes php software, freely available from
2 | ncsa | ncsa | university of illinois/ncsa open source licen[cs]e
2 | ms-pl | microsoft | microsoft public licen[cs]e \\(ms-pl\\)
2 | ms-rl | microsoft | microsoft reciprocal licen[cs]e \\(ms-rl\\)
2 | curl | permission | permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that .{1,60}? appear in all copies
2 | lppl-1.3 | latex | this work may be distributed and/or modified under the conditions of the latex project public licen[cs]e
2 | eupl | european union | licensed under the eupl,? version 1\\.[0-2]
2 | cecill-2.1 | cecill | this software is governed by the cecill(?:-[bc])? licen[cs]e under french law
2 | sspl-1.0 | server side | server side public licen[cs]e,? version 1
2 | busl-1.1 | business source | business source licen[cs]e 1\\.1
2 | elastic-2.0 | elastic | elastic licen[cs]e 2\\.0
2 | commons-clause | commons clause | commons clause licen[cs]e condition
2 | polyform | polyform | polyform (?:noncommercial|small business|shield|strict) licen[cs]e 1\\.0\\.0
2 | odbl-1.0 | database | made available under the open database licen[cs]e
2 | odc-by | database | open data commons attribution licen[cs]e
2 | pddl-1.0 | public domain | open data commons public domain dedication and licen[cs]e
2 | ogl-uk | crown | contains public sector information licensed under the open government licen[cs]e
2 | crown-copyright | crown | \\(?c?\\)? ?crown copyright
2 | us-government-work | government | this is a work of the united states government
2 | hpnd | advertising | not be used in advertising or publicity pertaining to distribution of the software without specific, written prior permission
2 | sleepycat | sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code
2 | afl-3.0 | academic free | licensed under the academic free licen[cs]e version (?:2\\.[01]|3\\.0)
2 | osl-3.0 | open software | licensed under the open software licen[cs]e version (?:1|2|3)\\.[01]
2 | qpl-1.0 | q public | may be distributed under the terms of the q public licen[cs]e
2 | bsd-unmodified | redistributions | redistributions of source code must retain the above copyright notice immediately at the beginning of the file
2 | blueoak-1.0.0 | blue oak | blue oak model licen[cs]e
2 | upl-1.0 | universal permissive | the universal permissive licen[cs]e \\(upl\\),? version 1\\.0
2 | mulan-2.0 | mulan | mulan (?:psl|permissive software licen[cs]e) ?v?2
"""

# Places where licenses are published.
LINKS = """
2 | gpl | gnu.org | gnu\\.org/(?:licenses|copyleft)/gpl(?:\\.html|\\.txt)?
2 | gpl-2.0 | gnu.org | gnu\\.org/licenses/(?:old-licenses/)?gpl-2\\.0
2 | gpl-3.0 | gnu.org | gnu\\.org/licenses/gpl-3\\.0
2 | lgpl | gnu.org | gnu\\.org/licenses/(?:old-licenses/)?lgpl
2 | agpl-3.0 | gnu.org | gnu\\.org/licenses/agpl
2 | gfdl | gnu.org | gnu\\.org/(?:licenses|copyleft)/fdl
2 | apache-2.0 | apache | apache\\.org/licenses/license-2\\.0
2 | apache-1.1 | apache | apache\\.org/licenses/license-1\\.1
2 | mit | opensource | opensource\\.org/licenses?/mit
2 | bsd-2-clause | opensource | opensource\\.org/licenses?/bsd-2-clause
2 | bsd-3-clause | opensource | opensource\\.org/licenses?/bsd-3-clause
2 | isc | opensource | opensource\\.org/licenses?/isc
2 | artistic | opensource | opensource\\.org/licenses?/artistic
2 | cddl | opensource | opensource\\.org/licenses?/cddl
2 | osl-3.0 | opensource | opensource\\.org/licenses?/osl-3\\.0
2 | zlib | opensource | opensource\\.org/licenses?/zlib
2 | mpl-2.0 | mozilla | mozilla\\.org/mpl/2\\.0
2 | mpl-1.1 | mozilla | mozilla\\.org/mpl/mpl-1\\.1
2 | mpl | mozilla | mozilla\\.org/mpl/?
2 | epl-1.0 | eclipse | eclipse\\.org/legal/epl-v10
2 | epl-2.0 | eclipse | eclipse\\.org/(?:legal/epl-v20|legal/epl-2\\.0)
2 | edl-1.0 | eclipse | eclipse\\.org/org/documents/edl-v10
2 | cc-by | creativecommons | creativecommons\\.org/licenses/by/[1-4]\\.[05]
2 | cc-by-sa | creativecommons | creativecommons\\.org/licenses/by-sa/[1-4]\\.[05]
2 | cc-by-nc | creativecommons | creativecommons\\.org/licenses/by-nc/[1-4]\\.[05]
2 | cc-by-nd | creativecommons | creativecommons\\.org/licenses/by-nd/[1-4]\\.[05]
2 | cc-by-nc-sa | creativecommons | creativecommons\\.org/licenses/by-nc-sa/[1-4]\\.[05]
2 | cc-by-nc-nd | creativecommons | creativecommons\\.org/licenses/by-nc-nd/[1-4]\\.[05]
2 | cc0-1.0 | creativecommons | creativecommons\\.org/publicdomain/zero/1\\.0
2 | public-domain | creativecommons | creativecommons\\.org/publicdomain/mark/1\\.0
2 | boost-1.0 | boost | boost\\.org/license_1_0\\.txt
2 | unlicense | unlicense | unlicense\\.org
2 | wtfpl | wtfpl | wtfpl\\.net
2 | ofl-1.1 | scripts.sil | scripts\\.sil\\.org/ofl
2 | python-2.0 | python | (?:docs\\.)?python\\.org/(?:[0-9.]+/)?license
2 | php-3.01 | php | php\\.net/license
2 | openssl | openssl | openssl\\.org/source/license
2 | odbl-1.0 | opendatacommons | opendatacommons\\.org/licenses/odbl
2 | pddl-1.0 | opendatacommons | opendatacommons\\.org/licenses/pddl
2 | eupl | joinup | joinup\\.ec\\.europa\\.eu/.{0,40}?eupl
2 | lppl-1.3 | latex | latex-project\\.org/lppl
2 | cecill-2.1 | cecill | cecill\\.info/licen[cs]es?
"""

# How licenses are named in running text.
NAMES = """
5 | agpl-3.0 | affero | (?:gnu )?affero general public licen[cs]e
5 | agpl-3.0 | agpl | agpl(?:[- ]?v?3(?:\\.0)?)?
5 | lgpl | lesser | (?:gnu )?(?:lesser|library) general public licen[cs]e
5 | lgpl | library general | (?:gnu )?library general public licen[cs]e
5 | lgpl | lgpl | lgpl(?:[- ]?v?[23](?:\\.[01])?)?
4 | gpl-2.0 | general public | (?:gnu )?general public licen[cs]e,? v(?:ersion )?2(?:\\.0)?
4 | gpl-3.0 | general public | (?:gnu )?general public licen[cs]e,? v(?:ersion )?3(?:\\.0)?
5 | gpl-2.0 | gpl | gpl[- ]?v?2(?:\\.0)?
5 | gpl-3.0 | gpl | gpl[- ]?v?3(?:\\.0)?
5 | gpl | general public | (?:gnu )?general public licen[cs]e
4 | apache-2.0 | apache | apache licen[cs]e,? v(?:ersion )?2(?:\\.0)?
4 | apache-1.1 | apache | apache (?:software )?licen[cs]e,? v(?:ersion )?1\\.1
5 | apache-2.0 | apache | apache[- ]2\\.0
5 | apache | apache | apache (?:software )?licen[cs]e
5 | mit | mit | (?:the )?mit(?:/x11)? licen[cs]e
5 | mit | expat | expat licen[cs]e
5 | x11 | x11 | x11 licen[cs]e
5 | bsd-2-clause | bsd | (?:2|two)[- ]clause bsd(?: licen[cs]e)?
5 | bsd-2-clause | bsd | (?:simplified|freebsd) bsd licen[cs]e
5 | bsd-2-clause | bsd | bsd[- ]2[- ]clause
5 | bsd-3-clause | bsd | (?:3|three)[- ]clause bsd(?: licen[cs]e)?
5 | bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[cs]e
5 | bsd-3-clause | bsd | bsd[- ]3[- ]clause
5 | bsd-4-clause | bsd | (?:4|four)[- ]clause bsd(?: licen[cs]e)?
5 | bsd-4-clause | bsd | original bsd licen[cs]e
5 | bsd | bsd | bsd(?:[- ]style)? licen[cs]e
5 | isc | isc | isc licen[cs]e
4 | mpl-1.1 | mozilla | mozilla public licen[cs]e,? v(?:ersion )?1\\.1
4 | mpl-2.0 | mozilla | mozilla public licen[cs]e,? v(?:ersion )?2(?:\\.0)?
5 | mpl | mozilla | mozilla public licen[cs]e
4 | epl-1.0 | eclipse | eclipse public licen[cs]e,? v(?:ersion )?1(?:\\.0)?
4 | epl-2.0 | eclipse | eclipse public licen[cs]e,? v(?:ersion )?2(?:\\.0)?
5 | epl | eclipse | eclipse public licen[cs]e
5 | cddl | cddl | cddl(?:[- ]1\\.[01])?
5 | cddl | common development | common development and distribution licen[cs]e
5 | cpl-1.0 | common public | common public licen[cs]e
5 | eupl | european union public | european union public licen[cs]e
4 | artistic-2.0 | artistic | artistic licen[cs]e,? (?:v(?:ersion )?)?2(?:\\.0)?
5 | artistic | artistic | artistic licen[cs]e
5 | boost-1.0 | boost | boost software licen[cs]e
5 | zlib | zlib | zlib(?:/libpng)? licen[cs]e
5 | wtfpl | wtfpl | wtfpl
5 | unlicense | unlicense | (?:the )?unlicense
5 | python-2.0 | python | python software foundation licen[cs]e
5 | openssl | openssl | openssl licen[cs]e
5 | postgresql | postgresql | postgresql licen[cs]e
5 | php-3.01 | php | php licen[cs]e
5 | ruby | ruby | ruby licen[cs]e
5 | zpl-2.1 | zope | zope public licen[cs]e
5 | ofl-1.1 | open font | (?:sil )?open font licen[cs]e
5 | gfdl | free documentation | (?:gnu )?free documentation licen[cs]e
5 | odbl-1.0 | open database | open database licen[cs]e
5 | afl-3.0 | academic free | academic free licen[cs]e
5 | osl-3.0 | open software | open software licen[cs]e
5 | qpl-1.0 | q public | q public licen[cs]e
5 | lppl-1.3 | latex | latex project public licen[cs]e
5 | ms-pl | microsoft | microsoft public licen[cs]e
5 | sspl-1.0 | server side | server side public licen[cs]e
5 | beerware | beer | beer-?ware licen[cs]e
5 | cc0-1.0 | cc0 | cc0(?: 1\\.0)?
4 | cc-by-nc-nd | cc | cc[- ]by[- ]nc[- ]nd(?: [1-4]\\.[05])?
4 | cc-by-nc-sa | cc | cc[- ]by[- ]nc[- ]sa(?: [1-4]\\.[05])?
5 | cc-by-nc | cc | cc[- ]by[- ]nc(?: [1-4]\\.[05])?
5 | cc-by-nd | cc | cc[- ]by[- ]nd(?: [1-4]\\.[05])?
5 | cc-by-sa | cc | cc[- ]by[- ]sa(?: [1-4]\\.[05])?
5 | cc-by | cc | cc[- ]by(?: [1-4]\\.[05])?
4 | cc-by-nc | creative commons | creative commons attribution[- ]non[- ]?commercial(?: [1-4]\\.[05])?
4 | cc-by-sa | creative commons | creative commons attribution[- ]share[- ]?alike(?: [1-4]\\.[05])?
5 | cc-by | creative commons | creative commons attribution(?: [1-4]\\.[05])?
5 | cc0-1.0 | creative commons | creative commons zero
"""

# Notices that name no license.
NOTICES = """
6 | all-rights-reserved | rights reserved | all rights reserved
6 | public-domain | public domain | (?:dedicated to|placed in|released (?:in)?to) the public domain
6 | public-domain | public domain | this (?:file|code|software|work) is in the public domain
6 | proprietary | proprietary | proprietary and confidential
6 | proprietary | unauthorized | unauthori[sz]ed copying of this file,? via any medium,? is strictly prohibited
6 | proprietary | trade secret | contains (?:valuable )?trade secrets
6 | evaluation-only | evaluation | for evaluation purposes only
6 | non-commercial | commercial | for non-?commercial (?:use|purposes) only
6 | academic-only | academic | for academic (?:use|research) only
6 | copyright | copyright | copyright (?:\\(c\\)|\\xc2\\xa9)? ?(?:19|20)\\d\\d
6 | copyright | \\xc2\\xa9 | \\xc2\\xa9 ?(?:19|20)\\d\\d
6 | no-warranty | warranty | without warranty of any kind
6 | no-warranty | warranty | without even the implied warranty of merchantability
6 | no-warranty | warranties | without warranties or conditions of any kind
6 | no-liability | liable | in no event shall .{1,80}? be liable for any
6 | patent-grant | patent | grant of patent licen[cs]e
6 | licensed-as | licen | licen[cs]ed under the same terms as
6 | see-license | licen | see (?:the )?(?:accompanying )?licen[cs]e(?:\\.txt|\\.md)? (?:file )?for (?:more )?details
"""


def lines() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) of every signature, in order."""
    out = []
    for row in (SPDX + BODIES + LINKS + NAMES + NOTICES).strip().splitlines():
        if row:
            priority, label, keyword, pattern = row.split(" | ", 3)
            out.append((int(priority), label, keyword.encode().decode("unicode_escape"), pattern))
    return out
