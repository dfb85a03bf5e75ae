"""License scan with ordered signature rules, a keyword gate and interval suppression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Characters that are not part of a word, before and after lower-casing A-Z.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: One of these stands in every keyword, and so in every text that any rule can match.
GATE = [
    "licen", "copyright", "copyleft", "copying", "public domain", "rights reserved", "warrant", "spdx", "gpl", "gnu ", "creative commons",
    "creativecommons", "cc by", "cc0", "permission", "redistribut", "free software", "apache", "mozilla org", "boost org", "bsd", "opensource org",
    "eclipse org", "gfdl", "cddl", "eupl", "sspl", "wtfpl", "mpl ", "epl ", "unencumbered", "no restrictions", "patent", "openssl", "advertising materials",
    "deal in the software", "combined work", "mit no attribution", "ncsa", "zlib", "exception", "linux syscall",
]

#: (phrase, label) of the base; fixed values of the contract.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Rules written by hand, as label: (keyword, pattern over normalised words); the keyword is a literal part of every match.
#: Sentences of licence texts and of the notices that grant one.
NOTICES = {
    "agpl-3.0": [
        ("affero general public licen", "terms of the gnu affero general public licen[cs]e as published by the free software foundation(?: either)? version 3"),
        ("gnu affero general public licen", "gnu affero general public licen[cs]e version 3 19 november 2007"),
        ("gnu general public licen", "remote network interaction use with the gnu general public licen[cs]e"),
    ],
    "agpl-3.0-or-later": [("affero general public licen", "gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version")],
    "apache-1.1": [("apache software foundation", "this product includes software developed by the apache software foundation")],
    "apache-2.0": [
        ("apache licen", "licen[cs]ed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e"),
        ("except in compliance with the licen", "you may not use this (?:file|work|software) except in compliance with the licen[cs]e"),
        ("governing permissions", "see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e"),
        ("apache licen", "apache licen[cs]e version 2 0 january 2004"),
        ("licensor", "unless required by applicable law or agreed to in writing licensor provides the work"),
        ("patent litigation", "if you institute patent litigation against any entity including a cross claim or counterclaim in a lawsuit"),
    ],
    "artistic-2.0": [("licen", "this artistic licen[cs]e establishes the terms under which a given free software package may be copied"), ("copyright holder", "the copyright holder intends that the package remain available as open source and free software")],
    "boost": [
        ("permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
        ("boost software licen", "distributed under the boost software licen[cs]e version 1 0"),
    ],
    "bsd": [
        ("redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
        ("redistributions of source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
        ("redistributions in binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ],
    "bsd-3-clause": [
        ("written permission", "may be used to endorse or promote products derived from this software without specific prior written permission"),
        ("bsd style licen", "governed by a bsd style licen[cs]e that can be found in the licen[cs]e file"),
    ],
    "bsd-4-clause": [("advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment")],
    "0bsd": [("permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is")],
    "cc-by": [("creative commons attribution", "(?:this work is )?licen[cs]ed under (?:a|the) creative commons attribution (?:[1-4] [0-9] )?(?:international|unported|generic) licen[cs]e")],
    "cc-by-sa": [("creative commons attribution", "(?:this work is )?licen[cs]ed under (?:a|the) creative commons attribution share ?alike (?:[1-4] [0-9] )?(?:international|unported|generic) licen[cs]e")],
    "cc-by-nc": [("creative commons attribution", "(?:this work is )?licen[cs]ed under (?:a|the) creative commons attribution non ?commercial (?:[1-4] [0-9] )?(?:international|unported|generic) licen[cs]e")],
    "cc-by-nc-sa": [("creative commons attribution", "(?:this work is )?licen[cs]ed under (?:a|the) creative commons attribution non ?commercial share ?alike (?:[1-4] [0-9] )?(?:international|unported|generic) licen[cs]e")],
    "cc-by-nc-nd": [("creative commons attribution", "(?:this work is )?licen[cs]ed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:[1-4] [0-9] )?(?:international|unported|generic) licen[cs]e")],
    "cc0": [
        ("copyright and related", "waived all copyright and related or neighboring rights"),
        ("copyright and related", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights"),
    ],
    "cddl": [("common development and distribution licen", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e")],
    "epl-1.0": [("eclipse public licen", "made available under the terms of the eclipse public licen[cs]e v ?1 0")],
    "epl-2.0": [("eclipse public licen", "made available under the terms of the eclipse public licen[cs]e (?:v ?)?2 0")],
    "eupl-1.2": [("eupl", "licen[cs]ed under the eupl version 1 2")],
    "gfdl": [
        ("permission is granted", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
        ("free documentation licen", "with no invariant sections no front cover texts and no back cover texts a copy of the licen[cs]e is included in the section entitled gnu free documentation licen[cs]e"),
    ],
    "gpl-1.0-or-later": [("gnu general public licen", "gnu general public licen[cs]e as published by the free software foundation either version 1 or at your option any later version")],
    "gpl-2.0": [
        ("gnu general public licen", "gnu general public licen[cs]e version 2 june 1991"),
        ("gnu general public licen", "gnu general public licen[cs]e version 2 as published by the free software foundation"),
        ("gnu general public licen", "gnu general public licen[cs]e as published by the free software foundation version 2"),
    ],
    "gpl-2.0-or-later": [("gnu general public licen", "gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version")],
    "gpl-3.0": [
        ("gnu general public licen", "gnu general public licen[cs]e version 3 29 june 2007"),
        ("gnu general public licen", "gnu general public licen[cs]e as published by the free software foundation version 3"),
    ],
    "gpl-3.0-or-later": [("gnu general public licen", "gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version")],
    "gpl-notice": [
        ("free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
        ("gnu general public licen", "you should have received a copy of the gnu general public licen[cs]e along with this (?:program|library|software|package)"),
        ("gnu general public licen", "see the gnu general public licen[cs]e for more details"),
        ("copyleft", "the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"),
    ],
    "hpnd": [("permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted")],
    "isc": [
        ("permission to use", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
        ("disclaims all warrant", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ],
    "lgpl-2.0-or-later": [("library general public licen", "gnu library general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version")],
    "lgpl-2.1": [("lesser general public licen", "gnu lesser general public licen[cs]e version 2 1 february 1999"), ("lesser general public licen", "gnu lesser general public licen[cs]e as published by the free software foundation version 2 1")],
    "lgpl-2.1-or-later": [("lesser general public licen", "gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version")],
    "lgpl-3.0": [("lesser general public licen", "gnu lesser general public licen[cs]e version 3 29 june 2007")],
    "lgpl-3.0-or-later": [("lesser general public licen", "gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version")],
    "mit-license": [
        ("permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
        ("permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        ("deal in the software without restriction", "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies"),
        ("mit licen", "licen[cs]ed under the mit licen[cs]e"),
    ],
    "mit-0": [("permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software to deal in the software without restriction")],
    "mpl-1.1": [("mozilla public licen", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1")],
    "mpl-2.0": [
        ("mozilla public licen", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
        ("mpl was not distributed", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ],
    "ms-pl": [("licen", "this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e")],
    "ofl-1.1": [("font licen", "this font software is licen[cs]ed under the sil open font licen[cs]e version 1 1"), ("permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of the font software")],
    "openssl": [("openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit")],
    "php-3.01": [("php licen", "subject to version 3 01 of the php licen[cs]e")],
    "psf-2.0": [("python software foundation licen", "python software foundation licen[cs]e version 2"), ("licensee", "psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e")],
    "unlicense": [
        ("unencumbered", "this is free and unencumbered software released into the public domain"),
        ("copyright", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ],
    "vim": [("no restrictions", "there are no restrictions on distributing unmodified copies of vim")],
    "wtfpl": [("public licen", "do what the fuck you want to public licen[cs]e"), ("permission", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document without permission")],
    "zlib": [
        ("warrant", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
        ("permission is granted", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ],
}
#: Names of licences in prose.
NAMES = {
    "0bsd": [("bsd", "(?:bsd zero clause|zero clause bsd|0bsd)(?: licen[cs]e)?")],
    "afl-3.0": [("academic free licen", "academic free licen[cs]e(?: v(?:ersion)?)?(?: ?[0-9](?: [0-9])?)?")],
    "agpl": [("affero general public licen", "(?:gnu )?affero general public licen[cs]e"), ("agpl", "(?:gnu )?agpl(?: licen[cs]e)?")],
    "agpl-3.0": [
        ("affero general public licen", "(?:gnu )?affero general public licen[cs]e v(?:ersion)? ?3(?: 0)?"),
        ("agpl", "(?:gnu )?agpl ?v?(?:ersion )?3(?: 0)?(?: licen[cs]e)?"),
    ],
    "agpl-3.0-or-later": [
        ("affero general public licen", "(?:gnu )?affero general public licen[cs]e v(?:ersion)? ?3(?: 0)? or (?:any )?later(?: version)?"),
        ("agpl", "(?:gnu )?agpl ?v?(?:ersion )?3(?: 0)? or (?:any )?later(?: version)?"),
    ],
    "apache-1.1": [("apache", "apache (?:software )?licen[cs]e v(?:ersion)? ?1 1")],
    "apache-2.0": [
        ("apache", "apache (?:software )?licen[cs]e v(?:ersion)? ?2(?: 0)?"), ("apache licen", "apache licen[cs]e 2(?: 0)?"),
        ("apache", "apache v?2(?: 0)? licen[cs]e"), ("apache", "apache ?v2(?: 0)?"),
    ],
    "artistic": [("artistic licen", "(?:perl )?artistic licen[cs]e")],
    "artistic-1.0": [("artistic licen", "artistic licen[cs]e v?(?:ersion )?1(?: 0)?")],
    "artistic-2.0": [("artistic licen", "artistic licen[cs]e v?(?:ersion )?2(?: 0)?")],
    "beerware": [("licen", "beer ?ware licen[cs]e")],
    "boost": [("boost software licen", "boost software licen[cs]e(?: v(?:ersion)? ?1(?: 0)?)?")],
    "bsd": [("bsd", "bsd (?:style )?licen[cs]e"), ("bsd", "bsd licen[cs]ed")],
    "bsd-2-clause": [("bsd", "(?:2|two) clause bsd(?: licen[cs]e)?"), ("bsd", "bsd (?:2|two) clause(?: licen[cs]e)?"), ("bsd licen", "(?:simplified|free) bsd licen[cs]e")],
    "bsd-3-clause": [("bsd", "(?:3|three) clause bsd(?: licen[cs]e)?"), ("bsd", "bsd (?:3|three) clause(?: licen[cs]e)?"), ("bsd licen", "(?:new|modified|revised) bsd licen[cs]e")],
    "bsd-4-clause": [("bsd", "(?:4|four) clause bsd(?: licen[cs]e)?"), ("bsd", "bsd (?:4|four) clause(?: licen[cs]e)?"), ("bsd licen", "original bsd licen[cs]e")],
    "bsl-1.1": [("business source licen", "business source licen[cs]e(?: v?(?:ersion )?1 1)?")],
    "cc-by": [
        ("cc by", "cc by(?: [1-4](?: [0-9])?)?"), ("creative commons by", "creative commons by(?: [1-4](?: [0-9])?)?"),
        ("creative commons attribution", "creative commons attribution(?: [1-4](?: [0-9])?)?(?: international| unported)?(?: licen[cs]e)?"),
    ],
    "cc-by-nc": [
        ("cc by nc", "cc by nc(?: [1-4](?: [0-9])?)?"), ("creative commons by nc", "creative commons by nc(?: [1-4](?: [0-9])?)?"),
        ("creative commons attribution non", "creative commons attribution non ?commercial(?: [1-4](?: [0-9])?)?(?: international| unported)?(?: licen[cs]e)?"),
    ],
    "cc-by-nc-nd": [
        ("cc by nc nd", "cc by nc nd(?: [1-4](?: [0-9])?)?"), ("creative commons by nc nd", "creative commons by nc nd(?: [1-4](?: [0-9])?)?"),
        ("creative commons attribution non", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4](?: [0-9])?)?(?: licen[cs]e)?"),
    ],
    "cc-by-nc-sa": [
        ("cc by nc sa", "cc by nc sa(?: [1-4](?: [0-9])?)?"), ("creative commons by nc sa", "creative commons by nc sa(?: [1-4](?: [0-9])?)?"),
        ("creative commons attribution non", "creative commons attribution non ?commercial share ?alike(?: [1-4](?: [0-9])?)?(?: licen[cs]e)?"),
    ],
    "cc-by-nd": [
        ("cc by nd", "cc by nd(?: [1-4](?: [0-9])?)?"), ("creative commons by nd", "creative commons by nd(?: [1-4](?: [0-9])?)?"),
        ("creative commons attribution no", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4](?: [0-9])?)?(?: licen[cs]e)?"),
    ],
    "cc-by-sa": [
        ("cc by sa", "cc by sa(?: [1-4](?: [0-9])?)?"), ("creative commons by sa", "creative commons by sa(?: [1-4](?: [0-9])?)?"),
        ("creative commons attribution share", "creative commons attribution share ?alike(?: [1-4](?: [0-9])?)?(?: international| unported)?(?: licen[cs]e)?"),
    ],
    "cc0": [("cc0", "cc0(?: 1 0)?(?: universal)?"), ("creative commons", "creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?")],
    "cddl": [("common development and distribution licen", "common development and distribution licen[cs]e"), ("cddl", "cddl(?: v?1(?: [01])?)?")],
    "cecill": [("licen", "cecill(?: (?:b|c))? licen[cs]e"), ("free software licen", "cecill free software licen[cs]e(?: agreement)?")],
    "commons-clause": [("licen", "commons clause licen[cs]e condition(?: v1 0)?")],
    "cpl-1.0": [("common public licen", "common public licen[cs]e(?: v?(?:ersion )?1 0)?")],
    "edl-1.0": [("licen", "eclipse distribution licen[cs]e(?: v ?1 0)?")],
    "elastic-2.0": [("elastic licen", "elastic licen[cs]e(?: v?(?:ersion )?2(?: 0)?)?")],
    "epl": [("eclipse public licen", "eclipse public licen[cs]e")],
    "epl-1.0": [("eclipse public licen", "eclipse public licen[cs]e v?(?:ersion )?1(?: 0)?"), ("epl 1", "epl 1 0")],
    "epl-2.0": [("eclipse public licen", "eclipse public licen[cs]e v?(?:ersion )?2(?: 0)?"), ("epl 2", "epl 2 0")],
    "eupl": [("european union public licen", "european union public licen[cs]e(?: v?(?:ersion )?1(?: [0-2])?)?"), ("eupl", "eupl(?: v?1 [0-2])?")],
    "freetype": [("licen", "freetype (?:project )?licen[cs]e")],
    "gfdl": [("free documentation licen", "(?:gnu )?free documentation licen[cs]e(?: v(?:ersion)? ?1(?: [1-3])?)?"), ("gfdl", "(?:gnu )?gfdl(?: 1 [1-3])?")],
    "gpl": [("gpl", "(?:gnu )?gpl licen[cs]ed?"), ("gnu gpl", "gnu gpl"), ("gnu public licen", "gnu public licen[cs]e"), ("gnu general public licen", "gnu general public licen[cs]e")],
    "gpl-1.0": [("general public licen", "(?:gnu )?general public licen[cs]e v(?:ersion)? ?1(?: 0)?"), ("gpl", "(?:gnu )?gpl ?v1(?: 0)?")],
    "gpl-2.0": [
        ("general public licen", "(?:gnu )?general public licen[cs]e v(?:ersion)? ?2(?: 0)?"),
        ("gpl", "(?:gnu )?gpl ?v ?2(?: 0)?(?: only)?"), ("gpl", "(?:gnu )?gpl (?:version )?2(?: 0)?"), ("gpl2", "gpl2"),
    ],
    "gpl-2.0-or-later": [
        ("general public licen", "(?:gnu )?general public licen[cs]e v(?:ersion)? ?2(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"),
        ("gpl", "(?:gnu )?gpl ?v?(?:ersion )?2(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"), ("gplv2 and later", "gplv2 and later"),
    ],
    "gpl-3.0": [
        ("general public licen", "(?:gnu )?general public licen[cs]e v(?:ersion)? ?3(?: 0)?"),
        ("gpl", "(?:gnu )?gpl ?v ?3(?: 0)?(?: only)?"), ("gpl", "(?:gnu )?gpl (?:version )?3(?: 0)?"), ("gpl3", "gpl3"),
    ],
    "gpl-3.0-or-later": [
        ("general public licen", "(?:gnu )?general public licen[cs]e v(?:ersion)? ?3(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"),
        ("gpl", "(?:gnu )?gpl ?v?(?:ersion )?3(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"), ("gplv3 and later", "gplv3 and later"),
    ],
    "hpnd": [("permission notice", "historical permission notice and disclaimer")],
    "ijg": [("licen", "independent jpeg group licen[cs]e")],
    "ipl-1.0": [("ibm public licen", "ibm public licen[cs]e(?: v?(?:ersion )?1 0)?")],
    "isc": [("isc licen", "isc licen[cs]ed?")],
    "json": [("json licen", "json licen[cs]e")],
    "lgpl": [("lesser general public licen", "(?:gnu )?lesser general public licen[cs]e"), ("library general public licen", "(?:gnu )?library general public licen[cs]e"), ("lgpl", "(?:gnu )?lgpl(?: licen[cs]ed?)?")],
    "lgpl-2.0": [("library general public licen", "(?:gnu )?library general public licen[cs]e v(?:ersion)? ?2(?: 0)?"), ("lgpl", "(?:gnu )?lgpl ?v?2(?: 0)?")],
    "lgpl-2.1": [("lesser general public licen", "(?:gnu )?lesser general public licen[cs]e v(?:ersion)? ?2 1"), ("lgpl", "(?:gnu )?lgpl ?v?(?:ersion )?2 1(?: only)?")],
    "lgpl-2.1-or-later": [
        ("lesser general public licen", "(?:gnu )?lesser general public licen[cs]e v(?:ersion)? ?2 1 or (?:at your option )?(?:any )?later(?: version)?"),
        ("lgpl", "(?:gnu )?lgpl ?v?(?:ersion )?2 1 or (?:at your option )?(?:any )?later(?: version)?"),
    ],
    "lgpl-3.0": [("lesser general public licen", "(?:gnu )?lesser general public licen[cs]e v(?:ersion)? ?3(?: 0)?"), ("lgpl", "(?:gnu )?lgpl ?v?(?:ersion )?3(?: 0)?(?: only)?")],
    "lgpl-3.0-or-later": [
        ("lesser general public licen", "(?:gnu )?lesser general public licen[cs]e v(?:ersion)? ?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
        ("lgpl", "(?:gnu )?lgpl ?v?(?:ersion )?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ],
    "libpng": [("licen", "(?:libpng|png reference library) licen[cs]e(?: version 2)?")],
    "lppl": [("project public licen", "latex project public licen[cs]e(?: v?(?:ersion )?1(?: [0-3]c?)?)?")],
    "mit-0": [("mit no attribution", "mit no attribution(?: licen[cs]e)?")],
    "mit-license": [("mit licen", "(?:expat |x11 )?mit licen[cs]ed?"), ("mit x11 licen", "mit x11 licen[cs]e"), ("expat licen", "expat licen[cs]e"), ("mit style licen", "mit style licen[cs]e"), ("x11 licen", "x11 licen[cs]e")],
    "mpl": [("mozilla public licen", "mozilla public licen[cs]e")],
    "mpl-1.1": [("mozilla public licen", "mozilla public licen[cs]e v?(?:ersion )?1 [01]"), ("mpl 1", "mpl 1 [01]")],
    "mpl-2.0": [("mozilla public licen", "mozilla public licen[cs]e v?(?:ersion )?2(?: 0)?"), ("mpl 2", "mpl 2 0")],
    "ms-pl": [("public licen", "microsoft public licen[cs]e")],
    "ms-rl": [("reciprocal licen", "microsoft reciprocal licen[cs]e")],
    "mulan-psl-2.0": [("licen", "mulan (?:psl|permissive software licen[cs]e) ?v?2(?: licen[cs]e)?")],
    "ncsa": [("open source licen", "university of illinois (?:ncsa )?open source licen[cs]e"), ("ncsa", "ncsa open source licen[cs]e")],
    "odbl-1.0": [("licen", "open (?:data commons open )?database licen[cs]e(?: v?1 0)?")],
    "odc-by-1.0": [("attribution licen", "open data commons attribution licen[cs]e(?: v?1 0)?")],
    "ofl-1.1": [("open font licen", "(?:sil )?open font licen[cs]e(?: v(?:ersion)? ?1(?: 1)?)?")],
    "openssl": [("openssl", "openssl licen[cs]e")],
    "osl-3.0": [("open software licen", "open software licen[cs]e(?: v?(?:ersion )?(?:3|2|1) [01])?")],
    "pddl-1.0": [("licen", "public domain dedication and licen[cs]e")],
    "php-3.01": [("php licen", "php licen[cs]e(?: v?(?:ersion )?3 0 ?1)?")],
    "postgresql": [("postgresql licen", "postgresql licen[cs]e")],
    "psf-2.0": [("python software foundation licen", "python software foundation licen[cs]e"), ("psf licen", "psf licen[cs]e")],
    "qpl-1.0": [("public licen", "q public licen[cs]e(?: v?(?:ersion )?1 0)?")],
    "ruby": [("ruby licen", "ruby licen[cs]e")],
    "sspl-1.0": [("server side public licen", "server side public licen[cs]e(?: v?(?:ersion )?1)?"), ("sspl", "sspl(?: v?1)?")],
    "unicode": [("unicode licen", "unicode licen[cs]e(?: v3)?")],
    "unlicense": [("unlicen", "(?:the )?unlicen[cs]e")],
    "upl-1.0": [("permissive licen", "universal permissive licen[cs]e(?: v?(?:ersion )?1 0)?")],
    "vim": [("vim licen", "vim licen[cs]e")],
    "w3c": [("licen", "w3c software (?:notice and )?licen[cs]e")],
    "wtfpl": [("wtfpl", "wtfpl(?: v?(?:ersion )?2)?")],
    "zlib": [("zlib", "zlib(?: libpng)? licen[cs]e")],
    "zpl-2.1": [("zope public licen", "zope public licen[cs]e(?: v?(?:ersion )?2 1)?")],
}
#: Short identifiers that are told apart without more words: label: words of the identifier.
SHORT_IDS = {
    "agpl-3.0": ["agpl 3 0 only", "agpl 3 0"], "agpl-3.0-or-later": ["agpl 3 0 or later"], "apache-1.1": ["apache 1 1"], "apache-2.0": ["apache 2 0"],
    "bsd-2-clause": ["bsd 2 clause"], "bsd-3-clause": ["bsd 3 clause"], "bsd-4-clause": ["bsd 4 clause"], "bsd-2-clause-patent": ["bsd 2 clause patent"], "bsd-3-clause-clear": ["bsd 3 clause clear"],
    "cc0": ["cc0 1 0"], "cddl": ["cddl 1 0", "cddl 1 1"], "epl-1.0": ["epl 1 0"], "epl-2.0": ["epl 2 0"], "eupl": ["eupl 1 1", "eupl 1 2"],
    "gfdl": ["gfdl 1 2 or later", "gfdl 1 3 only", "gfdl 1 3 or later"], "gpl-1.0": ["gpl 1 0 only"], "gpl-1.0-or-later": ["gpl 1 0 or later"],
    "gpl-2.0": ["gpl 2 0 only", "gpl 2 0"], "gpl-2.0-or-later": ["gpl 2 0 or later"], "gpl-3.0": ["gpl 3 0 only", "gpl 3 0"], "gpl-3.0-or-later": ["gpl 3 0 or later"],
    "lgpl-2.0": ["lgpl 2 0 only", "lgpl 2 0"], "lgpl-2.0-or-later": ["lgpl 2 0 or later"], "lgpl-2.1": ["lgpl 2 1 only", "lgpl 2 1"], "lgpl-2.1-or-later": ["lgpl 2 1 or later"],
    "lgpl-3.0": ["lgpl 3 0 only", "lgpl 3 0"], "lgpl-3.0-or-later": ["lgpl 3 0 or later"], "mpl-1.1": ["mpl 1 1"], "mpl-2.0": ["mpl 2 0"], "sspl-1.0": ["sspl 1 0"],
}
#: Identifiers that are plain words elsewhere: they count on an SPDX line, alone or after another identifier.
SPDX_ONLY = {
    "0bsd": "0bsd", "afl-3.0": "afl 3 0", "artistic-1.0": "artistic 1 0", "artistic-2.0": "artistic 2 0", "beerware": "beerware", "boost": "bsl 1 0", "bsl-1.1": "busl 1 1",
    "cpl-1.0": "cpl 1 0", "elastic-2.0": "elastic 2 0", "freetype": "ftl", "hpnd": "hpnd", "ijg": "ijg", "ipl-1.0": "ipl 1 0", "isc": "isc", "json": "json", "libpng": "libpng 2 0",
    "lppl": "lppl 1 3c", "mit-0": "mit 0", "mit-license": "mit", "ms-pl": "ms pl", "ms-rl": "ms rl", "mulan-psl-2.0": "mulanpsl 2 0", "ncsa": "ncsa", "odbl-1.0": "odbl 1 0",
    "odc-by-1.0": "odc by 1 0", "ofl-1.1": "ofl 1 1", "openssl": "openssl", "osl-3.0": "osl 3 0", "pddl-1.0": "pddl 1 0", "php-3.01": "php 3 01", "postgresql": "postgresql",
    "psf-2.0": "psf 2 0", "qpl-1.0": "qpl 1 0", "ruby": "ruby", "unicode": "unicode 3 0", "unlicense": "unlicense", "upl-1.0": "upl 1 0", "vim": "vim", "w3c": "w3c",
    "wtfpl": "wtfpl", "x11": "x11", "zlib": "zlib", "zpl-2.1": "zpl 2 1",
}
#: Addresses of licence texts, as the words of a URL.
URLS = {
    "agpl-3.0": ["gnu org licenses agpl(?: 3 0)?"], "apache-2.0": ["apache org licenses license 2 0", "opensource org licenses? apache 2 0"], "artistic-2.0": ["opensource org licenses? artistic 2 0"],
    "boost": ["boost org license 1 0"], "bsd-2-clause": ["opensource org licenses? bsd 2 clause"], "bsd-3-clause": ["opensource org licenses? bsd 3 clause"], "bsd": ["opensource org licenses? bsd license"],
    "cc-by": ["creativecommons org licenses by(?: [1-4] [0-9])?"], "cc-by-nc": ["creativecommons org licenses by nc(?: [1-4] [0-9])?"], "cc-by-nc-nd": ["creativecommons org licenses by nc nd(?: [1-4] [0-9])?"],
    "cc-by-nc-sa": ["creativecommons org licenses by nc sa(?: [1-4] [0-9])?"], "cc-by-nd": ["creativecommons org licenses by nd(?: [1-4] [0-9])?"], "cc-by-sa": ["creativecommons org licenses by sa(?: [1-4] [0-9])?"],
    "cc0": ["creativecommons org publicdomain zero(?: 1 0)?"], "public-domain": ["creativecommons org publicdomain mark(?: 1 0)?", "creativecommons org licenses publicdomain"],
    "cddl": ["opensource org licenses? cddl(?: 1 0)?"], "epl-1.0": ["eclipse org legal epl v10"], "epl-2.0": ["eclipse org legal epl (?:2 0|v20)"], "gfdl": ["gnu org licenses fdl(?: 1 [1-3])?", "gnu org copyleft fdl"],
    "gpl": ["gnu org licenses gpl", "gnu org copyleft gpl"], "gpl-2.0": ["gnu org licenses (?:old licenses )?gpl 2 0", "opensource org licenses? gpl 2 0"], "gpl-3.0": ["gnu org licenses gpl 3 0", "opensource org licenses? gpl 3 0"],
    "isc": ["opensource org licenses? isc(?: license)?"], "lgpl": ["gnu org licenses lgpl", "gnu org copyleft lesser"], "lgpl-2.1": ["gnu org licenses (?:old licenses )?lgpl 2 1", "opensource org licenses? lgpl 2 1"],
    "lgpl-3.0": ["gnu org licenses lgpl 3 0", "opensource org licenses? lgpl 3 0"], "mit-license": ["opensource org licenses? mit(?: license)?"], "mpl-1.1": ["mozilla org mpl mpl 1 1"], "mpl-2.0": ["mozilla org mpl 2 0", "opensource org licenses? mpl 2 0"],
    "unlicense": ["unlicense org"], "zlib": ["opensource org licenses? zlib"],
}
#: Exceptions that are granted beside a licence: label: (keyword, pattern).
EXCEPTIONS = {
    "autoconf-exception": [("gnu general public licen", "special exception to the gnu general public licen[cs]e if you distribute this file as part of a program that contains a configuration script"), ("autoconf exception", "with autoconf exception [23] 0")],
    "bison-exception": [("bison exception", "with bison exception 2 2")],
    "classpath-exception": [("classpath exception", "with (?:the )?classpath exception(?: 2 0)?"), ("combined work", "linking this library statically or dynamically with other modules is making a combined work based on this library")],
    "font-exception": [("font exception", "with font exception 2 0"), ("gnu general public licen", "this font does not by itself cause the resulting document to be covered by the gnu general public licen[cs]e")],
    "gcc-exception": [("gcc exception", "with gcc exception 3 1"), ("gcc runtime library exception", "gcc runtime library exception(?: version 3 1)?")],
    "linux-syscall-note": [("linux syscall note", "with linux syscall note")],
    "llvm-exception": [("llvm exception", "with llvm exceptions?")],
    "openssl-exception": [("permission to link", "permission to link the code of portions of this program with the openssl library")],
}
#: Rules outside those: (label, kind, keyword, priority, confidence, pattern).
SINGLE = [
    ("all-rights-reserved", "notice", "rights reserved", 2, 0.7, "all rights reserved"),
    ("copyright", "notice", "copyright", 2, 0.7, "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("no-warranty", "notice", "warranty", 2, 0.7, "without (?:any )?warranty of any kind"),
    ("no-warranty", "notice", "warranty", 2, 0.7, "(?:absolutely )?no warranty"),
    ("no-warranty", "notice", "warranty", 2, 0.7, "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("public-domain", "notice", "public domain", 2, 0.8, "(?:dedicated to|released (?:in)?to|placed in) the public domain"),
    ("public-domain", "mention", "public domain", 1, 0.5, "public domain"),
    ("proprietary", "notice", "copying", 2, 0.8, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "notice", "licen", 2, 0.7, "proprietary and confidential licen[cs]e"),
    ("dual-licensed", "notice", "licensed", 2, 0.7, "(?:dual|multi) licensed under"),
    ("unknown-license-reference", "mention", "licen", 1, 0.4, "see (?:the )?(?:accompanying )?licen[cs]e (?:file )?for (?:details|terms|more information)"),
    ("unknown-license-reference", "mention", "licen", 1, 0.4, "(?:released|distributed|available) under an open source licen[cs]e"),
]


#: A detection inside one of a higher priority is suppressed.
PRIORITIES = (1, 2, 3, 4)


@dataclass(frozen=True)
class Signature:
    label: str
    kind: str
    keyword: str
    priority: int
    confidence: float
    pattern: str  # over lower-cased words with one space before, between and after them


def _first_word_pair(pattern: str) -> str:
    """Literal start of an address: its first two words."""
    return " ".join(pattern.split(" ")[:2])


def signatures() -> list[Signature]:
    """All rules in their order: notices, identifiers, addresses, exceptions, names, single rules.

    Notices and exceptions outrank identifiers and addresses, which outrank bare names; a name
    with a version is the longer match and so settles the name without one.
    """
    made = [Signature(label, "notice", k, 4, 1.0, p) for label, rules in NOTICES.items() for k, p in rules]
    made += [Signature(label, "exception", k, 4, 1.0, p) for label, rules in EXCEPTIONS.items() for k, p in rules]
    made += [Signature(label, "id", " ".join(i.split(" ")[:2]), 3, 0.95, i) for label, ids in SHORT_IDS.items() for i in ids]
    made += [Signature(label, "spdx", "spdx", 3, 1.0, f"spdx licen[cs]e identifier {i}") for label, i in SPDX_ONLY.items()]
    made += [Signature(label, "spdx-part", "spdx", 2, 1.0, f"spdx licen[cs]e identifier (?:[^ ]+ ){{1,8}}(?:or|and) {i}") for label, i in SPDX_ONLY.items()]
    made += [Signature(label, "address", _first_word_pair(p), 3, 0.9, p) for label, ps in URLS.items() for p in ps]
    made += [Signature(label, "name", k, 1, 0.6, p) for label, rules in NAMES.items() for k, p in rules]
    return made + [Signature(*rule) for rule in SINGLE]


def _whole_words(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _literal(rules: list[Signature]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"),
            F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), F.lit(_whole_words(r.pattern)).alias("pattern"),
        )
        for i, r in enumerate(rules)
    ])


def _places(text: Column, pattern: Column) -> tuple[Column, Column]:
    """First word of every match, and the matches themselves."""
    marked = F.split(F.btrim(F.regexp_replace(text, pattern, F.lit("\u0001$0"))), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith("\u0001"), i)), lambda i: i.isNotNull())
    return starts, F.regexp_extract_all(text, pattern, F.lit(0))


def normalised(text: Column) -> Column:
    """Words joined by one space, with a space at both ends (letter case is left)."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), GAPS, " ")), F.lit(" "))


def scan(docs: DataFrame, rules: list[Signature] | None = None, text_col: str = "text") -> DataFrame:
    """Adds n_words, base (array of label, start) and detections (array of the surviving ones).

    A detection is (start, end, label, rule, priority, confidence) in words. A rule is tried only
    on texts that hold one of the gate words and the rule's own keyword. Of overlapping
    detections one is suppressed when its interval lies inside that of a detection with higher
    priority, or inside a longer or earlier-ordered one of the same priority. The scan is one
    pass over the detections by (start, longest first): whatever holds an interval stands before it.

    All work stays inside the row: no shuffle, no key that gathers rows. Null text is empty.
    """
    rules = signatures() if rules is None else rules
    text = F.col("_norm")
    matching = F.filter(_literal(rules), lambda r: F.contains(text, r["keyword"]) & F.rlike(text, r["pattern"]))

    def found(rule: Column) -> Column:
        starts, matches = _places(text, rule["pattern"])
        return F.transform(
            starts,
            lambda s, i: F.struct(
                s.alias("start"), (-(s + F.size(F.split(F.get(matches, i), " ")) - 1)).alias("down"), (-rule["priority"]).alias("rank"),
                rule["rule"].alias("rule"), rule["label"].alias("label"), rule["confidence"].alias("confidence"),
            ),
        )

    kind = "array<struct<start:int,end:int,label:string,rule:int,priority:int,confidence:double>>"
    state = F.struct(F.array().cast(kind).alias("kept"), *[F.lit(-1).alias(f"e{q}") for q in PRIORITIES])

    def step(s: Column, d: Column) -> Column:
        end, p = -d["down"], -d["rank"]
        held = F.greatest(*[F.when(p <= q, s[f"e{q}"]).otherwise(-1) for q in PRIORITIES]) >= end
        row = F.struct(d["start"].alias("start"), end.alias("end"), d["label"].alias("label"), d["rule"].alias("rule"), p.alias("priority"), d["confidence"].alias("confidence"))
        grown = lambda q: F.when(p == q, F.greatest(s[f"e{q}"], end)).otherwise(s[f"e{q}"]).alias(f"e{q}")
        return F.struct(
            F.when(held, s["kept"]).otherwise(F.concat(s["kept"], F.array(row).cast(kind))).alias("kept"), *[grown(q) for q in PRIORITIES]
        )

    def phrase_places(phrase: str, label: str) -> Column:
        starts, _ = _places(text, F.lit(_whole_words(phrase)))
        return F.transform(starts, lambda s: F.struct(F.lit(label).alias("label"), s.alias("start")))

    base = F.flatten(F.array(*[phrase_places(phrase, label) for phrase, label in BASE]))
    none_base = F.array().cast("array<struct<label:string,start:int>>")
    raw = F.col("_raw")
    plain = F.lower(raw)
    gated = F.lit(False)
    for word in GATE:
        gated = gated | F.contains(plain, F.lit(word))
    return (
        docs.withColumn("_raw", normalised(F.col(text_col)))
        .withColumn("n_words", F.when(raw == "  ", 0).otherwise(F.length(raw) - F.length(F.replace(raw, F.lit(" "))) - 1).cast("long"))
        .withColumn("_norm", F.when(gated, lower_ascii(raw)))
        .withColumn("base", F.when(text.isNotNull(), base).otherwise(none_base))
        .withColumn("_found", F.when(text.isNotNull(), F.array_sort(F.flatten(F.transform(matching, found)))))
        .withColumn("detections", F.when(F.size("_found") > 0, F.aggregate("_found", state, step)["kept"]).otherwise(F.array().cast(kind)))
        .drop("_raw", "_norm", "_found")
    )


def license_labels(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``labels`` are those of the base and of the surviving detections; ``score`` is the highest
    confidence of a surviving detection, 0 without any. Null and empty texts have no words and
    empty labels; repeated rows and null ids get a row each; extra columns are not read.
    """
    found = scan(docs.select(F.col(id_col).alias("_id"), F.col("text")))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), F.transform("detections", lambda d: d["label"]))))
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    return found.select(
        F.col("_id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.concat_ws(",", base_labels).alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
