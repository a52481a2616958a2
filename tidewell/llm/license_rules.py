"""The signatures of the licence scan, by family.

A family opens on one of its keywords.  Below it stand its rules, one a line:
kind, label, regular expression over lower-case words and single blanks.
``{under}``, ``{the}`` and ``{v}`` stand for a notice's lead, an article and a
version's lead.  A kind gives priority (small is better) and confidence.
"""

from __future__ import annotations

#: kind: (priority, confidence)
KINDS = {"text": (1, 1.0), "id": (2, 0.9), "notice": (3, 0.85), "url": (4, 0.85), "version": (5, 0.75), "name": (6, 0.7), "word": (7, 0.6)}
SHORT = {
    "{under}": "(?:licensed|released|distributed|available|provided|published|covered|offered|dual licensed) (?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?",
    "{the}": "(?:the |an? )?",
    "{v}": "(?:version |ver |v )?",
    "{spdx}": "spdx license identifier ",
}
TABLE = r"""
family permission: hereby sublicense noninfringement substantial furnished
text mit permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
text mit permission is hereby granted free of charge to any person obtaining a copy of this software
text mit without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
text mit the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
text mit and to permit persons to whom the software is furnished to do so subject to the following conditions
text isc permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
text isc permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
text historical permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
text historical permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
text ofl permission is hereby granted free of charge to any person obtaining a copy of the font software
text boost-1.0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
text icu permission is hereby granted free of charge to any person obtaining a copy of this software .{0,80}to deal in the software without restriction
text unicode permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
text curl permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
text warranty merchantability fitness for a particular purpose and noninfringement
text public-domain (?:i|we|the author) hereby (?:release|dedicate)s? (?:this|the) (?:work|code|software|file) (?:in)?to the public domain
text no-rights all rights are hereby waived
text bsd-2-clause-patent each copyright holder and contributor hereby grants .{1,80}? patent licen[sc]e

family permission-isc: fee
text isc copy modify and or distribute this software for any purpose with or without fee
text isc copy modify and distribute this software for any purpose with or without fee
text historical for any purpose and without fee
text commercial (?:a )?licen[sc]e fee (?:is|must be) (?:payable|paid|required)

family redistribution: redistribution redistributions endorse binary
text bsd redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
text bsd redistribution and use in source and binary forms with or without modification are permitted
text bsd redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
text bsd redistributions of source code must retain the above copyright notice
text bsd redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
text bsd redistributions in binary form must reproduce the above copyright notice
text bsd-3-clause neither the names? of .{1,120}? may be used to endorse or promote products derived from this software without specific prior written permission
text bsd-3-clause nor the names of its contributors may be used to endorse or promote products
text bsd-4-clause neither the name .{1,80}? be used to endorse .{1,80}? advertising materials
notice proprietary redistribution (?:of this (?:file|software|document) )?(?:is )?(?:strictly )?(?:prohibited|forbidden|not permitted)

family advertising: advertising
text bsd-4-clause all advertising materials mentioning features or use of this software

family warranty: warranty warranties merchantability liable liability tort basis damage damages
text warranty the software is provided as is without warranty of any kind express or implied
text warranty this software is provided as is without warranty of any kind
text warranty this software is provided by .{1,120}? as is and any express or implied warranties
text warranty this software is provided as is without any express or implied warrant(?:y|ies)
text warranty in no event shall the authors or copyright holders be liable for any claim damages or other liability
text warranty in no event shall .{1,160}? be liable for any (?:direct|special|claim|damages)
text warranty in no event will the authors? be held liable for any damages arising from the use of this software
text warranty including but not limited to the (?:implied )?warranties of merchantability
text warranty without even the implied warranty of merchantability or fitness for a particular purpose
text warranty the author disclaims all warranties with regard to this software
text warranty distributed on an as is basis without warranties or conditions of any kind either express or implied
text warranty there is no warranty for the program to the extent permitted by applicable law
text warranty whether in an action of contract tort or otherwise arising from out of or in connection with the software
text warranty covered software is provided under this license on an as is basis
text warranty even if advised of the possibility of such damages?
text warranty absolutely no warranty
notice warranty (?:comes )?(?:with|without) (?:any )?(?:express or implied )?warrant(?:y|ies)

family zlib: zlib libpng alter altered misrepresented
text zlib the origin of this software must not be misrepresented you must not claim that you wrote the original software
text zlib altered source versions must be plainly marked as such and must not be misrepresented as being the original software
text zlib permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
id zlib {spdx}zlib
id libpng {spdx}libpng(?: 2 0)?
notice zlib {under}zlib(?: libpng)?(?: license)?
name zlib zlib libpng licen[sc]e
name zlib zlib licen[sc]e
name libpng libpng licen[sc]e

family apache: apache asl
text apache-2.0 licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
text apache-2.0 licensed to the apache software foundation asf under one or more contributor license agreements
text apache-2.0 apache license version 2 0 january 2004
text apache-1.1 products derived from this software may not be called apache
text apache-2.0 to apply the apache license to your work attach the following boilerplate notice
id apache-2.0 {spdx}apache 2 0
id apache-1.1 {spdx}apache 1 1
id apache-1.0 {spdx}apache 1 0
notice apache-2.0 {under}apache(?: software)?(?: public)? licen[sc]e (?:version |v )?(?:2 0|2|v2 0|v2)
notice apache-1.1 {under}apache(?: software)? licen[sc]e (?:version |v )?1 1
notice apache-1.0 {under}apache(?: software)? licen[sc]e (?:version |v )?1 0
notice apache-2.0 {under}apache (?:2 0|2|v2)(?: licen[sc]e)?
notice apache {under}(?:apache(?: software)?(?: public)? licen[sc]e|asl)
url apache-2.0 www apache org licenses license 2 0(?: txt| html)?
url apache-1.1 www apache org licenses license 1 1
url apache www apache org licenses
version apache-2.0 apache(?: software)?(?: public)? licen[sc]e (?:version |v )?(?:2 0|v2 0|v2|2)
version apache-1.1 apache(?: software)? licen[sc]e (?:version |v )?(?:1 1|v1 1)
version apache-1.0 apache(?: software)? licen[sc]e (?:version |v )?(?:1 0|v1 0)
version apache-2.0 asl (?:2 0|v2)
version apache-2.0 apache 2 0
name apache apache(?: software)?(?: public)? licen[sc]e
word apache asl

family mit: mit expat x11
id mit-0 {spdx}mit 0
id mit {spdx}mit
id x11 {spdx}x11
notice mit-0 {under}mit no attribution
notice mit {under}mit(?: x11| expat| style)?(?: open source)?(?: licen[sc]e)?
notice mit {under}expat(?: mit)?(?: licen[sc]e)?
notice x11 {under}x11(?: licen[sc]e)?
url mit opensource org licen[sc]es mit(?: license)?(?: php| html)?
version mit-0 mit no attribution(?: licen[sc]e)?
version mit-0 mit 0 licen[sc]e
name mit licen[sc]e mit
name mit (?:the )?mit(?: x11| expat| style| open source)? licen[sc]e
name mit expat(?: mit)? licen[sc]e
name x11 x11 licen[sc]e

family bsd: bsd 0bsd freebsd
id bsd-0-clause {spdx}0bsd
id bsd-1-clause {spdx}bsd 1 clause
id bsd-2-clause-patent {spdx}bsd 2 clause patent
id bsd-2-clause {spdx}bsd 2 clause
id bsd-3-clause-clear {spdx}bsd 3 clause clear
id bsd-3-clause {spdx}bsd 3 clause
id bsd-4-clause {spdx}bsd 4 clause
notice bsd-2-clause {under}(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: style)?(?: licen[sc]e)?
notice bsd-3-clause {under}(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: style)?(?: licen[sc]e)?
notice bsd-4-clause {under}(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[sc]e)?
notice bsd {under}bsd(?: style)?(?: licen[sc]e)?
url bsd-2-clause opensource org licen[sc]es bsd 2 clause
url bsd-3-clause opensource org licen[sc]es bsd 3 clause
url bsd opensource org licen[sc]es bsd(?: license)?(?: php)?
version bsd-0-clause (?:0bsd|bsd zero clause|zero clause bsd|bsd 0 clause)(?: licen[sc]e)?
version bsd-1-clause (?:bsd 1 clause|1 clause bsd)(?: licen[sc]e)?
version bsd-2-clause (?:bsd 2 clause|2 clause bsd|simplified bsd|two clause bsd|freebsd)(?: style)? licen[sc]e
version bsd-2-clause bsd (?:2|two) clause
version bsd-3-clause (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: style)? licen[sc]e
version bsd-3-clause bsd (?:3|three) clause
version bsd-4-clause (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[sc]e)?
name bsd (?:the )?bsd(?: style| type)? licen[sc]e

family isc: isc
id isc {spdx}isc
notice isc {under}isc(?: licen[sc]e)?
url isc opensource org licen[sc]es isc(?: license)?(?: txt)?
name isc (?:the )?isc licen[sc]e

family gpl: gpl gplv1 gplv2 gplv3 gnu general
text gpl-3.0 gnu general public licen[sc]e version 3 29 june 2007
text gpl-2.0 gnu general public licen[sc]e version 2 june 1991
text gpl-1.0 gnu general public licen[sc]e version 1 february 1989
text gpl-3.0-or-later you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or (?:at your option )?any later version
text gpl-2.0-or-later you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or (?:at your option )?any later version
text gpl-2.0 you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e (?:version 2 as published by the free software foundation|as published by the free software foundation version 2 of the licen[sc]e)
text gpl you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
text gpl you should have received a copy of the gnu general public licen[sc]e along with this program
text gpl see the gnu general public licen[sc]e for more details
text gpl the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works
id gpl-3.0-or-later {spdx}gpl 3 0 (?:or later|plus)
id gpl-3.0 {spdx}gpl 3 0(?: only)?
id gpl-2.0-or-later {spdx}gpl 2 0 (?:or later|plus)
id gpl-2.0 {spdx}gpl 2 0(?: only)?
id gpl-1.0 {spdx}gpl 1 0(?: only| or later)?
id gpl {spdx}gpl
notice gpl-3.0-or-later {under}(?:gnu )?(?:general public licen[sc]e|gpl) {v}(?:3 0|3|v3) or (?:any )?(?:later|newer|greater)
notice gpl-2.0-or-later {under}(?:gnu )?(?:general public licen[sc]e|gpl) {v}(?:2 0|2|v2) or (?:any )?(?:later|newer|greater)
notice gpl-3.0 {under}(?:gnu )?(?:general public licen[sc]e(?: gpl)?|gpl) {v}(?:3 0|3|v3)
notice gpl-2.0 {under}(?:gnu )?(?:general public licen[sc]e(?: gpl)?|gpl) {v}(?:2 0|2|v2)
notice gpl-3.0 {under}(?:gnu )?gplv3
notice gpl-2.0 {under}(?:gnu )?gplv2
notice gpl {under}(?:gnu )?(?:general public licen[sc]e(?: gpl)?|gpl)
url gpl-3.0 www gnu org licen[sc]es gpl 3 0(?: en)?(?: html| txt)?
url gpl-2.0 www gnu org licen[sc]es (?:old licen[sc]es )?gpl 2 0(?: en)?(?: html| txt)?
url gpl www gnu org licen[sc]es gpl(?: html| txt)?
url gpl www gnu org copyleft gpl html
version gpl-3.0-or-later (?:gnu )?(?:general public licen[sc]e|gpl) {v}(?:3 0|3|v3) or (?:any )?(?:later|newer|greater)
version gpl-2.0-or-later (?:gnu )?(?:general public licen[sc]e|gpl) {v}(?:2 0|2|v2) or (?:any )?(?:later|newer|greater)
version gpl-3.0 (?:gnu )?(?:general public licen[sc]e(?: gpl)?|gpl) {v}(?:3 0|3|v3 0|v3)
version gpl-2.0 (?:gnu )?(?:general public licen[sc]e(?: gpl)?|gpl) {v}(?:2 0|2|v2 0|v2)
version gpl-1.0 (?:gnu )?(?:general public licen[sc]e(?: gpl)?|gpl) {v}(?:1 0|1|v1)
version gpl-3.0 (?:gnu )?gplv3
version gpl-2.0 (?:gnu )?gplv2
version gpl-1.0 (?:gnu )?gplv1
name gpl (?:gnu )?general public licen[sc]e
name gpl gnu gpl
name gpl gnu public licen[sc]e
word gpl gpl

family lgpl: lgpl lgplv2 lgplv3 lesser library
text lgpl-3.0 gnu lesser general public licen[sc]e version 3 29 june 2007
text lgpl-2.1 gnu lesser general public licen[sc]e version 2 1 february 1999
text lgpl-2.0 gnu library general public licen[sc]e version 2 june 1991
text lgpl-3.0-or-later under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or (?:at your option )?any later version
text lgpl-2.1-or-later under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or (?:at your option )?any later version
text lgpl-2.0-or-later under the terms of the gnu library general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or (?:at your option )?any later version
text lgpl you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this (?:library|program)
text lgpl see the gnu (?:lesser|library) general public licen[sc]e for more details
id lgpl-3.0-or-later {spdx}lgpl 3 0 or later
id lgpl-3.0 {spdx}lgpl 3 0(?: only)?
id lgpl-2.1-or-later {spdx}lgpl 2 1 or later
id lgpl-2.1 {spdx}lgpl 2 1(?: only)?
id lgpl-2.0 {spdx}lgpl 2 0(?: only| or later)?
id lgpl {spdx}lgpl
notice lgpl-3.0 {under}(?:gnu )?(?:lesser general public licen[sc]e(?: lgpl)?|lgpl) {v}(?:3 0|3|v3)
notice lgpl-2.1 {under}(?:gnu )?(?:lesser general public licen[sc]e(?: lgpl)?|lgpl) {v}(?:2 1|v2 1)
notice lgpl-2.0 {under}(?:gnu )?(?:library general public licen[sc]e(?: lgpl)?|lgpl) {v}(?:2 0|2|v2)
notice lgpl {under}(?:gnu )?(?:(?:lesser|library) general public licen[sc]e(?: lgpl)?|lgpl)
url lgpl-3.0 www gnu org licen[sc]es lgpl 3 0(?: en)?(?: html| txt)?
url lgpl-2.1 www gnu org licen[sc]es (?:old licen[sc]es )?lgpl 2 1(?: en)?(?: html| txt)?
url lgpl www gnu org licen[sc]es lgpl(?: html| txt)?
version lgpl-3.0 (?:gnu )?(?:lesser general public licen[sc]e(?: lgpl)?|lgpl) {v}(?:3 0|3|v3 0|v3)
version lgpl-2.1 (?:gnu )?(?:lesser general public licen[sc]e(?: lgpl)?|lgpl) {v}(?:2 1|v2 1)
version lgpl-2.0 (?:gnu )?(?:(?:lesser|library) general public licen[sc]e(?: lgpl)?|lgpl) {v}(?:2 0|2|v2)
version lgpl-3.0 (?:gnu )?lgplv3
version lgpl-2.0 (?:gnu )?lgplv2
name lgpl (?:gnu )?(?:lesser|library)(?: general)? public licen[sc]e
name lgpl gnu lgpl
word lgpl lgpl

family agpl: agpl agplv3 affero
text agpl-3.0 gnu affero general public licen[sc]e version 3 19 november 2007
text agpl-3.0-or-later under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or (?:at your option )?any later version
text agpl you should have received a copy of the gnu affero general public licen[sc]e along with this program
id agpl-3.0-or-later {spdx}agpl 3 0 or later
id agpl-3.0 {spdx}agpl 3 0(?: only)?
id agpl-1.0 {spdx}agpl 1 0(?: only| or later)?
id agpl {spdx}agpl
notice agpl-3.0 {under}(?:gnu )?(?:affero general public licen[sc]e(?: agpl)?|agpl) {v}(?:3 0|3|v3)
notice agpl {under}(?:gnu )?(?:affero general public licen[sc]e(?: agpl)?|agpl)
url agpl-3.0 www gnu org licen[sc]es agpl(?: 3 0)?(?: en)?(?: html| txt)?
version agpl-3.0 (?:gnu )?(?:affero general public licen[sc]e(?: agpl)?|agpl) {v}(?:3 0|3|v3 0|v3)
version agpl-1.0 (?:affero general public licen[sc]e|agpl) {v}(?:1 0|1|v1)
version agpl-3.0 (?:gnu )?agplv3
name agpl (?:gnu )?affero(?: general)? public licen[sc]e
word agpl agpl

family mozilla: mozilla mpl mplv2
text mpl-2.0 this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? ?2 0
text mpl-2.0 if a copy of the mpl was not distributed with this file you can obtain one at
text mpl-1.1 the contents of this file are subject to the mozilla public licen[sc]e version 1 1
text mpl-1.0 the contents of this file are subject to the mozilla public licen[sc]e version 1 0
id mpl-2.0 {spdx}mpl 2 0(?: no copyleft exception)?
id mpl-1.1 {spdx}mpl 1 1
id mpl-1.0 {spdx}mpl 1 0
id mpl {spdx}mpl
notice mpl-2.0 {under}(?:mozilla public licen[sc]e|mpl) {v}(?:2 0|2|v2)
notice mpl {under}(?:mozilla public licen[sc]e|mpl)
url mpl-2.0 mozilla org mpl 2 0
url mpl www mozilla org mpl
version mpl-2.0 (?:mozilla public licen[sc]e|mpl) {v}(?:2 0|2|v2 0|v2)
version mpl-1.1 (?:mozilla public licen[sc]e|mpl) {v}(?:1 1|v1 1)
version mpl-1.0 (?:mozilla public licen[sc]e|mpl) {v}(?:1 0|1|v1)
name mpl mozilla public licen[sc]e
word mpl mpl

family eclipse: eclipse epl
text epl-2.0 made available under the terms of the eclipse public licen[sc]e (?:v |version )?2 0
text epl-1.0 made available under the terms of the eclipse public licen[sc]e (?:v |version )?v?1 0
id epl-2.0 {spdx}epl 2 0
id epl-1.0 {spdx}epl 1 0
id epl {spdx}epl
notice epl {under}(?:eclipse public licen[sc]e|epl)
url epl www eclipse org (?:legal epl|org documents epl) ?(?:v10|v20|2 0|1 0)?(?: html)?
version epl-2.0 (?:eclipse public licen[sc]e|epl) {v}(?:2 0|2|v2 0|v2)
version epl-1.0 (?:eclipse public licen[sc]e|epl) {v}(?:1 0|1|v1 0|v1)
name edl eclipse distribution licen[sc]e
name epl eclipse public licen[sc]e
word epl epl

family cddl: cddl
id cddl-1.1 {spdx}cddl 1 1
id cddl-1.0 {spdx}cddl 1 0
id cddl {spdx}cddl
notice cddl {under}cddl
version cddl-1.1 cddl {v}(?:1 1|v1 1)
version cddl-1.0 cddl {v}(?:1 0|1|v1 0)
word cddl cddl

family common: common
text cddl the contents of this file are subject to the terms of the common development and distribution licen[sc]e
notice cddl {under}common development and distribution licen[sc]e
version cddl-1.1 common development and distribution licen[sc]e(?: cddl)? {v}1 1
version cddl-1.0 common development and distribution licen[sc]e(?: cddl)? {v}1 0
name cddl common development and distribution licen[sc]e
version cpl-1.0 common public licen[sc]e {v}1 0
name cpl common public licen[sc]e
name cpal common public attribution licen[sc]e

family cc: cc
id cc-by-nc-sa-4.0 {spdx}cc by nc sa 4 0
id cc-by-nc-nd-4.0 {spdx}cc by nc nd 4 0
id cc-by-nc-4.0 {spdx}cc by nc 4 0
id cc-by-sa-4.0 {spdx}cc by sa 4 0
id cc-by-sa-3.0 {spdx}cc by sa 3 0
id cc-by-nd-4.0 {spdx}cc by nd 4 0
id cc-by-4.0 {spdx}cc by 4 0
id cc-by-3.0 {spdx}cc by 3 0
version cc-by-nc-sa-4.0 cc by nc sa {v}4 0
version cc-by-nc-sa-3.0 cc by nc sa {v}3 0
version cc-by-nc-sa-2.5 cc by nc sa {v}2 5
version cc-by-nc-sa-2.0 cc by nc sa {v}2 0
version cc-by-nc-nd-4.0 cc by nc nd {v}4 0
version cc-by-nc-nd-3.0 cc by nc nd {v}3 0
version cc-by-nc-4.0 cc by nc {v}4 0
version cc-by-nc-3.0 cc by nc {v}3 0
version cc-by-sa-4.0 cc by sa {v}4 0
version cc-by-sa-3.0 cc by sa {v}3 0
version cc-by-sa-2.5 cc by sa {v}2 5
version cc-by-sa-2.0 cc by sa {v}2 0
version cc-by-nd-4.0 cc by nd {v}4 0
version cc-by-nd-3.0 cc by nd {v}3 0
version cc-by-4.0 cc by {v}4 0
version cc-by-3.0 cc by {v}3 0
version cc-by-2.5 cc by {v}2 5
version cc-by-2.0 cc by {v}2 0
version cc-by-1.0 cc by {v}1 0
name cc-by-nc-sa cc by nc sa
name cc-by-nc-nd cc by nc nd
name cc-by-nc cc by nc
name cc-by-sa cc by sa
name cc-by-nd cc by nd
name cc-by cc by
version cc0-1.0 cc zero 1 0
name cc0 cc zero

family creative: creative creativecommons
text cc-by-nc-sa-4.0 licensed under a creative commons attribution noncommercial sharealike 4 0 international licen[sc]e
text cc-by-nc-nd-4.0 licensed under a creative commons attribution noncommercial noderiv(?:ative)?s 4 0 international licen[sc]e
text cc-by-sa-4.0 licensed under a creative commons attribution sharealike 4 0 international licen[sc]e
text cc-by-4.0 licensed under a creative commons attribution 4 0 international licen[sc]e
url cc-by-nc-sa creativecommons org licen[sc]es by nc sa [1-4] [05]
url cc-by-nc-nd creativecommons org licen[sc]es by nc nd [1-4] [05]
url cc-by-nc creativecommons org licen[sc]es by nc [1-4] [05]
url cc-by-sa creativecommons org licen[sc]es by sa [1-4] [05]
url cc-by-nd creativecommons org licen[sc]es by nd [1-4] [05]
url cc-by creativecommons org licen[sc]es by [1-4] [05]
url cc0-1.0 creativecommons org publicdomain zero 1 0
url public-domain creativecommons org publicdomain mark 1 0
version cc-by-nc-sa-4.0 creative commons attribution non ?commercial share ?alike 4 0(?: international)?
version cc-by-nc-sa-3.0 creative commons attribution non ?commercial share ?alike 3 0(?: unported)?
version cc-by-nc-nd-4.0 creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
version cc-by-nc-4.0 creative commons attribution non ?commercial 4 0(?: international)?
version cc-by-nc-3.0 creative commons attribution non ?commercial 3 0(?: unported)?
version cc-by-sa-4.0 creative commons attribution share ?alike 4 0(?: international)?
version cc-by-sa-3.0 creative commons attribution share ?alike 3 0(?: unported)?
version cc-by-nd-4.0 creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
version cc-by-4.0 creative commons attribution 4 0(?: international)?
version cc-by-3.0 creative commons attribution 3 0(?: unported)?
version cc-by-2.0 creative commons attribution 2 0(?: generic)?
version cc0-1.0 creative commons (?:cc0|zero) 1 0(?: universal)?
name cc-by-nc-sa creative commons attribution non ?commercial share ?alike
name cc-by-nc-nd creative commons attribution non ?commercial no ?deriv(?:ative)?s
name cc-by-nc creative commons attribution non ?commercial
name cc-by-sa creative commons attribution share ?alike
name cc-by-nd creative commons attribution no ?deriv(?:ative)?s
name cc-by creative commons attribution
name cc0 creative commons (?:cc0|zero|public domain dedication)
name creative-commons creative commons licen[sc]e

family cc0: cc0
id cc0-1.0 {spdx}cc0(?: 1 0)?
notice cc0 {under}cc0
version cc0-1.0 cc0 {v}1 0(?: universal)?
word cc0 cc0

family boost: boost
text boost-1.0 distributed under the boost software licen[sc]e version 1 0
text boost-1.0 boost software licen[sc]e version 1 0 august 17th 2003
url boost-1.0 www boost org license 1 0 txt
version boost-1.0 boost software licen[sc]e {v}1 0
name boost boost software licen[sc]e

family bsl: bsl
id boost-1.0 {spdx}bsl 1 0
word bsl bsl 1 [01]

family artistic: artistic
id artistic-2.0 {spdx}artistic 2 0
id artistic-1.0 {spdx}artistic 1 0(?: perl)?
version artistic-2.0 (?:perl )?artistic licen[sc]e {v}2 0
version artistic-1.0 (?:perl )?artistic licen[sc]e {v}1 0
notice artistic {under}(?:perl )?artistic licen[sc]e
name artistic (?:perl )?artistic licen[sc]e

family python: python psf
id python-2.0 {spdx}(?:python|psf) 2 0
version python-2.0 (?:python software foundation|psf) licen[sc]e {v}2(?: 0)?
notice python {under}(?:python software foundation|psf|python) licen[sc]e
name python python software foundation licen[sc]e
name python (?:psf|python) licen[sc]e

family eupl: eupl
id eupl-1.2 {spdx}eupl 1 2
id eupl-1.1 {spdx}eupl 1 1
id eupl-1.0 {spdx}eupl 1 0
version eupl-1.2 eupl {v}1 2
version eupl-1.1 eupl {v}1 1
version eupl-1.0 eupl {v}1 0
word eupl eupl

family european: european
text eupl licensed under the eupl (?:.{1,40} )?european commission
version eupl-1.2 european union public licen[sc]e(?: eupl)? {v}1 2
version eupl-1.1 european union public licen[sc]e(?: eupl)? {v}1 1
name eupl european union public licen[sc]e

family unlicense: unlicense
id unlicense {spdx}unlicense
url unlicense unlicense org
name unlicense (?:the )?unlicense

family public: public unencumbered
text unlicense this is free and unencumbered software released into the public domain
text unlicense free and unencumbered software
text public-domain (?:has been |is )?(?:released|placed|put) in(?:to)? the public domain
text public-domain dedicated to the public domain
name public-domain (?:is |are )?in the public domain
name public-domain public domain dedication
name public-domain public domain work
name ms-pl microsoft public licen[sc]e
name qpl q public licen[sc]e
name npl netscape public licen[sc]e
name spl sun public licen[sc]e
name ipl ibm public licen[sc]e
name osl open software public licen[sc]e
name sspl server side public licen[sc]e(?: v?1)?

family wtfpl: wtfpl fuck
text wtfpl do what the fuck you want to public licen[sc]e
text wtfpl you just do what the fuck you want to
id wtfpl {spdx}wtfpl
version wtfpl-2 wtfpl {v}2
word wtfpl wtfpl

family data: odbl odc database opendatacommons commons
id odbl-1.0 {spdx}odbl 1 0
id odc-by-1.0 {spdx}odc by 1 0
text odbl made available under the open database licen[sc]e
url odbl opendatacommons org licen[sc]es odbl(?: 1 0)?
url odc-by opendatacommons org licen[sc]es by(?: 1 0)?
url pddl opendatacommons org licen[sc]es pddl(?: 1 0)?
version odbl-1.0 (?:open database licen[sc]e(?: odbl)?|odbl) {v}1 0
name odc-by (?:open data commons|odc) (?:attribution|by)(?: licen[sc]e)?
name odbl open database licen[sc]e
word odbl odbl

family font: ofl font
text ofl-1.1 this font software is licensed under the sil open font licen[sc]e version 1 1
id ofl-1.1 {spdx}ofl 1 1
id ofl-1.0 {spdx}ofl 1 0
url ofl scripts sil org ofl
version ofl-1.1 (?:sil )?(?:open font licen[sc]e(?: ofl)?|ofl) {v}1 1
version ofl-1.0 (?:sil )?(?:open font licen[sc]e(?: ofl)?|ofl) {v}1 0
name ofl (?:sil )?open font licen[sc]e
word ofl ofl

family microsoft: microsoft ms
id ms-pl {spdx}ms pl
id ms-rl {spdx}ms rl
notice ms-pl {under}microsoft public licen[sc]e
name ms-rl microsoft reciprocal licen[sc]e
name ms-pl ms pl
name ms-rl ms rl
name ms-eula microsoft software licen[sc]e terms

family documents: gfdl fdl documentation
text gfdl permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
id gfdl-1.3 {spdx}gfdl 1 3(?: only| or later)?
id gfdl-1.2 {spdx}gfdl 1 2(?: only| or later)?
version gfdl-1.3 (?:gnu )?(?:free documentation licen[sc]e|gfdl) {v}1 3
version gfdl-1.2 (?:gnu )?(?:free documentation licen[sc]e|gfdl) {v}1 2
name gfdl (?:gnu )?free documentation licen[sc]e
word gfdl gfdl

family academic: academic osl afl
id afl-3.0 {spdx}afl 3 0
id osl-3.0 {spdx}osl 3 0
version afl-3.0 academic free licen[sc]e {v}3 0
name afl academic free licen[sc]e
word osl osl 3 0

family open: open
version osl-3.0 open software licen[sc]e {v}3 0
name osl open software licen[sc]e
name ogl open government licen[sc]e(?: v3(?: 0)?)?
name openrail open rail m? ?licen[sc]e
name open-source open source licen[sc]e

family source: source
name busl business source licen[sc]e(?: 1 1)?
name elastic source available licen[sc]e

family models: llama openrail creativeml bigscience rail responsible elastic
name llama llama (?:2 |3 |3 1 )?community licen[sc]e(?: agreement)?
name openrail (?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[sc]e)?
name openrail responsible ai licen[sc]e
version elastic-2.0 elastic licen[sc]e {v}2 0
name elastic elastic licen[sc]e

family servers: openssl postgresql ncsa vim ruby php zpl zope w3c sendmail
text openssl this product includes software developed by the openssl project
text php products derived from this software may not be called php
id openssl {spdx}openssl
id postgresql {spdx}postgresql
id ncsa {spdx}ncsa
id php-3.01 {spdx}php 3 01
id zpl-2.1 {spdx}zpl 2 1
id w3c {spdx}w3c
name openssl openssl licen[sc]e
name postgresql postgresql licen[sc]e
name ncsa (?:university of illinois )?ncsa(?: open source)? licen[sc]e
name vim vim licen[sc]e
name ruby ruby licen[sc]e
name php php licen[sc]e(?: (?:version |v )?3 01)?
name zpl (?:zope public licen[sc]e|zpl)(?: (?:version |v )?2 1)?
name w3c w3c(?: software(?: notice)?)? licen[sc]e
name sendmail sendmail licen[sc]e

family rights: reserved copyright
text reserved copyright (?:c )?(?:[0-9]{4} )?.{1,60}? all rights reserved
name reserved all rights reserved
name some-reserved some rights reserved
name no-reserved no rights reserved

family proprietary: proprietary confidential unauthorized
text proprietary this (?:document|file|software|work) contains (?:confidential|proprietary)(?: and (?:confidential|proprietary))? information
text proprietary unauthorized (?:copying|use|reproduction|distribution)(?: or distribution)? of this (?:file|software|document|work)
name proprietary proprietary and confidential
name proprietary confidential and proprietary
name proprietary proprietary licen[sc]e
name proprietary proprietary software

family commercial: noncommercial evaluation academic commercial
name non-commercial (?:for )?non ?commercial use only
name non-commercial not for commercial use
name academic (?:for )?academic use only
name evaluation (?:for )?evaluation (?:purposes |use )?only
"""
Rule = tuple[str, int, str, float]


def families() -> list[tuple[str, list[str], list[Rule]]]:
    """(name, keywords, rules in order of priority: pattern, priority, label, confidence) of each family."""
    out: list[tuple[str, list[str], list[Rule]]] = []
    for line in TABLE.strip().splitlines():
        if line.startswith("family "):
            name, keywords = line[7:].split(": ")
            out.append((name, keywords.split(), []))
        elif line:
            kind, label, pattern = line.split(" ", 2)
            for short, long in SHORT.items():
                pattern = pattern.replace(short, long)
            priority, confidence = KINDS[kind]
            out[-1][2].append((pattern, priority, label, confidence))
    return [(name, keywords, sorted(own, key=lambda r: r[1])) for name, keywords, own in out]
