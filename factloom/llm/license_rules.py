"""Signature rules of the license scan, in order: the higher of two that detect the same words comes first.

A rule is (label, keyword, weight, expression). Expressions are over lower-cased words joined by single spaces, so "v2.0" reads
"v2 0"; each begins and ends at a word. The keyword is a part of every text that the expression matches.
"""

L = "licen[cs]e"

RULES = [
    # sentences of license texts
    ("mit", "hereby", 0.95, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "sublicense", 0.9, "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", 0.8, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "hereby", 0.9, "permission is hereby granted free of charge to any person obtaining a copy of this software to deal in the software without restriction"),
    ("isc", "hereby", 0.95, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided"),
    ("0bsd", "hereby", 0.95, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "hereby", 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("bsd", "redistribution", 0.95, "redistribution and use in source and binary forms with or without modification are permitted provided"),
    ("bsd", "redistributions", 0.8, "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", 0.8, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", 0.9, "neither the name of .{1,60}? nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", 0.9, "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", "compliance", 0.9, f"you may not use this file except in compliance with the {L}"),
    ("apache-2.0", "limitations", 0.7, f"see the {L} for the specific language governing permissions and limitations under the {L}"),
    ("apache-2.0", "contributor", 0.8, f"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright {L}"),
    ("gpl", "redistribute", 0.9, "(?:this program|it) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "warranty", 0.6, "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e"),
    ("gpl", "received", 0.7, f"you should have received a copy of the gnu general public {L}"),
    ("lgpl", "received", 0.7, f"you should have received a copy of the gnu lesser general public {L}"),
    ("lgpl", "redistribute", 0.9, "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "received", 0.7, f"you should have received a copy of the gnu affero general public {L}"),
    ("agpl", "redistribute", 0.9, "you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl-linking", "exception", 0.8, "as a special exception .{1,120}? gives? (?:you )?permission to link"),
    ("gfdl", "invariant", 0.8, "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "granted", 0.8, f"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L}"),
    ("mpl-2.0", "subject", 0.95, f"this source code form is subject to the terms of the mozilla public {L}"),
    ("mpl-1.1", "subject", 0.9, f"the contents of this file are subject to the mozilla public {L}"),
    ("npl", "subject", 0.9, f"the contents of this file are subject to the netscape public {L}"),
    ("epl", "accompanying", 0.9, f"this program and the accompanying materials are made available under the terms of the eclipse public {L}"),
    ("cddl", "subject", 0.9, f"the contents of this file are subject to the terms of the common development and distribution {L}"),
    ("unlicense", "unencumbered", 0.95, "this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate", 0.8, "the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("zlib", "warranty", 0.9, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "misrepresented", 0.9, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", 0.8, "altered source versions must be plainly marked as such"),
    ("boost", "accompanying", 0.9, f"obtaining a copy of the software and accompanying documentation covered by this {L}"),
    ("wtfpl", "public", 0.9, f"do what the fuck you want to public {L}"),
    ("beerware", "beer", 0.9, "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("cc0", "waived", 0.8, "has waived all copyright and related or neighboring rights"),
    ("ofl-1.1", "font", 0.9, f"this font software is licensed under the sil open font {L}"),
    ("ofl-1.1", "reserved", 0.7, "with reserved font name"),
    ("artistic", "package", 0.7, "you may copy and distribute verbatim copies of the source form of the standard version of this package without restriction"),
    ("openssl", "openssl", 0.8, "this product includes software developed by the openssl project"),
    ("apache-1.1", "foundation", 0.8, "this product includes software developed by the apache software foundation"),
    ("bsd-regents", "regents", 0.8, "the regents of the university of california all rights reserved"),
    ("json", "evil", 0.8, "the software shall be used for good not evil"),
    ("public-domain", "copyright", 0.7, "the author disclaims copyright to this source code"),
    # who grants what under which name
    ("gpl-2.0-only", "version", 0.9, f"(?:licen[cs]ed|released|distributed|published) under (?:the )?(?:terms of )?(?:the )?gnu general public {L} version 2 only"),
    ("gpl-2.0-or-later", "later", 0.9, f"gnu general public {L} (?:as published by the free software foundation )?(?:either )?version 2(?: of the {L})? or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", "later", 0.9, f"gnu general public {L} (?:as published by the free software foundation )?(?:either )?version 3(?: of the {L})? or (?:at your option )?any later version"),
    ("lgpl-2.1-or-later", "later", 0.9, f"gnu lesser general public {L} (?:as published by the free software foundation )?(?:either )?version 2 1(?: of the {L})? or (?:at your option )?any later version"),
    ("lgpl-3.0-or-later", "later", 0.9, f"gnu lesser general public {L} (?:as published by the free software foundation )?(?:either )?version 3(?: of the {L})? or (?:at your option )?any later version"),
    ("agpl-3.0-or-later", "later", 0.9, f"gnu affero general public {L} (?:as published by the free software foundation )?(?:either )?version 3(?: of the {L})? or (?:at your option )?any later version"),
    ("gpl", "general", 0.8, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public {L}"),
    ("gpl", "gpl", 0.8, "(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl"),
    ("lgpl", "lesser", 0.8, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public {L}"),
    ("lgpl", "lgpl", 0.8, "(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl"),
    ("agpl", "affero", 0.8, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public {L}"),
    ("apache-2.0", "apache", 0.9, f"licensed under the apache {L} version 2 0(?: the {L})?"),
    ("apache-2.0", "apache", 0.85, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?apache (?:{L} )?(?:version |v )?2(?: 0)?(?: {L})?"),
    ("apache", "apache", 0.8, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the |an )?apache (?:software )?{L}"),
    ("mit", "mit", 0.9, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the |an )?mit {L}"),
    ("mit", "mit", 0.7, f"under (?:the )?(?:terms of )?(?:the |an )?mit (?:open source |x11 )?{L}"),
    ("mit", "mit", 0.7, "mit licen[cs]ed"),
    ("bsd", "bsd", 0.8, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the |a )?(?:new |modified |simplified |revised )?bsd(?: style)? {L}"),
    ("bsd", "bsd", 0.7, "bsd (?:style )?licen[cs]ed"),
    ("bsd", "found", 0.7, f"governed by a bsd style {L} that can be found in the {L} file"),
    ("bsd-2-clause", "clause", 0.85, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:bsd )?(?:2|two) clause(?: bsd)? {L}"),
    ("bsd-3-clause", "clause", 0.85, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:bsd )?(?:3|three) clause(?: bsd)? {L}"),
    ("isc", "isc", 0.85, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?isc {L}"),
    ("mpl", "mozilla", 0.85, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?mozilla public {L}"),
    ("epl", "eclipse", 0.85, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?eclipse public {L}"),
    ("zlib", "zlib", 0.85, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)? {L}"),
    ("boost", "boost", 0.9, f"distributed under the boost software {L} version 1 0"),
    ("artistic", "artistic", 0.85, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:perl )?artistic {L}"),
    ("perl", "perl", 0.8, "(?:redistribute it and or modify it )?under the same (?:terms|licen[cs]e) as perl itself"),
    ("python", "python", 0.8, f"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?python(?: software foundation)? {L}"),
    ("php", "php", 0.8, f"this source file is subject to version 3 0?1? ?of the php {L}"),
    ("ruby", "ruby", 0.8, f"under the same (?:terms|{L}) as ruby"),
    ("wtfpl", "wtfpl", 0.8, "(?:licen[cs]ed|released|distributed|published|available) under (?:the )?wtfpl"),
    ("unlicense", "unlicense", 0.85, "(?:licen[cs]ed|released|distributed|published|available) under (?:the )?unlicense"),
    ("cc-by", "creative", 0.85, f"(?:licen[cs]ed|released|distributed|published|available) under (?:a |the )?creative commons attribution (?:[1-4] [05] )?(?:international |unported )?{L}"),
    ("cc-by-sa", "creative", 0.85, f"(?:licen[cs]ed|released|distributed|published|available) under (?:a |the )?creative commons attribution share ?alike (?:[1-4] [05] )?(?:international |unported )?{L}"),
    ("cc", "creative", 0.7, f"(?:licen[cs]ed|released|distributed|published|available) under (?:a |the )?creative commons {L}"),
    ("cc-by-sa", "wikipedia", 0.6, "text from wikipedia .{0,60}?available under (?:the )?(?:creative commons|cc by sa)"),
    ("cc0", "cc0", 0.85, "(?:licen[cs]ed|released|distributed|published|available) under (?:the )?cc0"),
    ("public-domain", "domain", 0.7, "(?:released|placed|put|dedicated) (?:in|into|in to|to) the public domain"),
    ("public-domain", "domain", 0.6, "(?:this|the) (?:work|text|book|image|file|software|code|document) is in the public domain"),
    ("dual", "dual", 0.7, f"dual licensed under (?:the )?(?:terms of )?(?:the )?mit (?:{L} )?(?:and|or) (?:the )?(?:gpl|apache)"),
    ("proprietary", "proprietary", 0.7, "(?:this (?:software|file|document|program) (?:is|contains) )?(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "prohibited", 0.7, "unauthori[sz]ed (?:copying|use|reproduction|distribution|redistribution) .{0,60}?(?:is )?strictly prohibited"),
    ("proprietary", "written", 0.6, "may not be (?:reproduced|copied|used|distributed) .{0,60}?without (?:the )?(?:prior |express )?written (?:permission|consent)"),
    ("proprietary", "eula", 0.6, f"end user {L} agreement(?: eula)?"),
    ("no-commercial", "commercial", 0.6, "(?:for|only for) non ?commercial (?:use|purposes)(?: only)?"),
    ("no-commercial", "commercial", 0.6, "not (?:for|to be used for) commercial (?:use|purposes)"),
    ("no-derivatives", "derivative", 0.6, "no derivative works(?: are permitted| allowed)?"),
    ("evaluation", "evaluation", 0.6, f"evaluation {L}"),
    ("freeware", "freeware", 0.6, "(?:is|as|this) (?:a )?freeware"),
    ("shareware", "shareware", 0.6, "(?:is|as|this) (?:a )?shareware"),
    # tags of source files
    ("gpl-2.0-only", "spdx", 0.95, f"spdx {L} identifier gpl 2 0(?: only)?"),
    ("gpl-2.0-or-later", "spdx", 0.95, f"spdx {L} identifier gpl 2 0 or later"),
    ("gpl-3.0-only", "spdx", 0.95, f"spdx {L} identifier gpl 3 0(?: only)?"),
    ("gpl-3.0-or-later", "spdx", 0.95, f"spdx {L} identifier gpl 3 0 or later"),
    ("lgpl-2.1-only", "spdx", 0.95, f"spdx {L} identifier lgpl 2 1(?: only)?"),
    ("lgpl-2.1-or-later", "spdx", 0.95, f"spdx {L} identifier lgpl 2 1 or later"),
    ("lgpl-3.0", "spdx", 0.95, f"spdx {L} identifier lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "spdx", 0.95, f"spdx {L} identifier agpl 3 0(?: only| or later)?"),
    ("apache-2.0", "spdx", 0.95, f"spdx {L} identifier apache 2 0"),
    ("mit", "spdx", 0.95, f"spdx {L} identifier mit"),
    ("mit-0", "spdx", 0.95, f"spdx {L} identifier mit 0"),
    ("bsd-2-clause", "spdx", 0.95, f"spdx {L} identifier bsd 2 clause"),
    ("bsd-3-clause", "spdx", 0.95, f"spdx {L} identifier bsd 3 clause"),
    ("0bsd", "spdx", 0.95, f"spdx {L} identifier 0bsd"),
    ("isc", "spdx", 0.95, f"spdx {L} identifier isc"),
    ("mpl-2.0", "spdx", 0.95, f"spdx {L} identifier mpl 2 0"),
    ("epl-2.0", "spdx", 0.95, f"spdx {L} identifier epl 2 0"),
    ("cddl-1.0", "spdx", 0.95, f"spdx {L} identifier cddl 1 0"),
    ("zlib", "spdx", 0.95, f"spdx {L} identifier zlib"),
    ("boost", "spdx", 0.95, f"spdx {L} identifier bsl 1 0"),
    ("unlicense", "spdx", 0.95, f"spdx {L} identifier unlicense"),
    ("cc0", "spdx", 0.95, f"spdx {L} identifier cc0 1 0"),
    ("cc-by-4.0", "spdx", 0.95, f"spdx {L} identifier cc by 4 0"),
    ("cc-by-sa-4.0", "spdx", 0.95, f"spdx {L} identifier cc by sa 4 0"),
    ("wtfpl", "spdx", 0.95, f"spdx {L} identifier wtfpl"),
    ("spdx", "spdx", 0.7, f"spdx {L} identifier"),
    # names with versions
    ("gpl-1.0", "general", 0.7, f"gnu general public {L}(?: v ?| version | )1(?: 0)?"),
    ("gpl-2.0", "general", 0.75, f"gnu general public {L}(?: v ?| version | )2(?: 0)?"),
    ("gpl-3.0", "general", 0.75, f"gnu general public {L}(?: v ?| version | )3(?: 0)?"),
    ("gpl-2.0", "gpl", 0.7, "(?:gnu )?gpl (?:v ?|version )?2(?: 0)?(?: only)?"),
    ("gpl-2.0-or-later", "gpl", 0.7, "(?:gnu )?gpl (?:v ?|version )?2(?: 0)? or (?:any )?later"),
    ("gpl-3.0", "gpl", 0.7, "(?:gnu )?gpl (?:v ?|version )?3(?: 0)?(?: only)?"),
    ("gpl-3.0-or-later", "gpl", 0.7, "(?:gnu )?gpl (?:v ?|version )?3(?: 0)? or (?:any )?later"),
    ("gpl-2.0", "gplv2", 0.7, "gplv2(?: 0)?"),
    ("gpl-3.0", "gplv3", 0.7, "gplv3(?: 0)?"),
    ("lgpl-2.0", "library", 0.7, f"gnu library general public {L}(?: v ?| version | )2(?: 0)?"),
    ("lgpl-2.1", "lesser", 0.75, f"gnu lesser general public {L}(?: v ?| version | )2 1"),
    ("lgpl-3.0", "lesser", 0.75, f"gnu lesser general public {L}(?: v ?| version | )3(?: 0)?"),
    ("lgpl-2.1", "lgpl", 0.7, "(?:gnu )?lgpl (?:v ?|version )?2 1"),
    ("lgpl-3.0", "lgpl", 0.7, "(?:gnu )?lgpl (?:v ?|version )?3(?: 0)?"),
    ("lgpl-2.1", "lgplv2", 0.7, "lgplv2(?: 1)?"),
    ("lgpl-3.0", "lgplv3", 0.7, "lgplv3(?: 0)?"),
    ("agpl-3.0", "affero", 0.75, f"(?:gnu )?affero general public {L}(?: v ?| version | )3(?: 0)?"),
    ("agpl-3.0", "agpl", 0.7, "(?:gnu )?agpl (?:v ?|version )?3(?: 0)?"),
    ("agpl-3.0", "agplv3", 0.7, "agplv3(?: 0)?"),
    ("gfdl-1.2", "documentation", 0.75, f"gnu free documentation {L} version 1 2"),
    ("gfdl-1.3", "documentation", 0.75, f"gnu free documentation {L} version 1 3"),
    ("apache-1.0", "apache", 0.7, f"apache (?:software )?{L}(?: v ?| version | )1 0"),
    ("apache-1.1", "apache", 0.7, f"apache (?:software )?{L}(?: v ?| version | )1 1"),
    ("apache-2.0", "apache", 0.75, f"apache (?:software )?{L}(?: v ?| version | )2(?: 0)?"),
    ("apache-2.0", "apache", 0.7, "apache 2(?: 0)?"),
    ("mpl-1.0", "mozilla", 0.7, f"mozilla public {L}(?: v ?| version | )1 0"),
    ("mpl-1.1", "mozilla", 0.75, f"mozilla public {L}(?: v ?| version | )1 1"),
    ("mpl-2.0", "mozilla", 0.75, f"mozilla public {L}(?: v ?| version | )2(?: 0)?"),
    ("epl-1.0", "eclipse", 0.75, f"eclipse public {L}(?: v ?| version | )1(?: 0)?"),
    ("epl-2.0", "eclipse", 0.75, f"eclipse public {L}(?: v ?| version | )2(?: 0)?"),
    ("eupl-1.2", "european", 0.75, f"european union public {L}(?: v ?| version | )1 2"),
    ("artistic-1.0", "artistic", 0.7, f"artistic {L}(?: v ?| version | )1(?: 0)?"),
    ("artistic-2.0", "artistic", 0.75, f"artistic {L}(?: v ?| version | )2(?: 0)?"),
    ("boost", "boost", 0.75, f"boost software {L}(?: v ?| version | )1 0"),
    ("ofl-1.1", "font", 0.75, f"sil open font {L}(?: v ?| version | )1 1"),
    ("cddl-1.0", "development", 0.75, f"common development and distribution {L}(?: v ?| version | )1 0"),
    ("cpl-1.0", "common", 0.7, f"common public {L}(?: v ?| version | )1 0"),
    ("osl-3.0", "open", 0.7, f"open software {L}(?: v ?| version | )3 0"),
    ("afl-3.0", "academic", 0.7, f"academic free {L}(?: v ?| version | )3 0"),
    ("mulan-2", "mulan", 0.7, "mulan psl v ?2"),
    ("ogl-3", "government", 0.7, f"open government {L}(?: v ?| version | )3 0"),
    ("cc-by-1.0", "creative", 0.7, "creative commons attribution 1 0"),
    ("cc-by-2.0", "creative", 0.7, "creative commons attribution 2 [05]"),
    ("cc-by-3.0", "creative", 0.7, "creative commons attribution 3 0(?: unported)?"),
    ("cc-by-4.0", "creative", 0.75, "creative commons attribution 4 0(?: international)?"),
    ("cc-by-sa-3.0", "creative", 0.7, "creative commons attribution share ?alike 3 0(?: unported)?"),
    ("cc-by-sa-4.0", "creative", 0.75, "creative commons attribution share ?alike 4 0(?: international)?"),
    ("cc-by-nc-4.0", "creative", 0.75, "creative commons attribution non ?commercial 4 0(?: international)?"),
    ("cc-by-nd-4.0", "creative", 0.75, "creative commons attribution no ?derivatives 4 0(?: international)?"),
    ("cc-by-nc-sa-4.0", "creative", 0.75, "creative commons attribution non ?commercial share ?alike 4 0(?: international)?"),
    ("cc-by-nc-nd-4.0", "creative", 0.75, "creative commons attribution non ?commercial no ?derivatives 4 0(?: international)?"),
    ("cc-by-3.0", "by", 0.7, "cc by 3 0"),
    ("cc-by-4.0", "by", 0.75, "cc by 4 0"),
    ("cc-by-sa-3.0", "by", 0.7, "cc by sa 3 0"),
    ("cc-by-sa-4.0", "by", 0.75, "cc by sa 4 0"),
    ("cc-by-nc-4.0", "by", 0.75, "cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "by", 0.75, "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "by", 0.75, "cc by nc nd 4 0"),
    ("cc0-1.0", "cc0", 0.75, "cc0 1 0(?: universal)?"),
    # bare names
    ("gpl", "general", 0.6, f"gnu general public {L}"),
    ("gpl", "gpl", 0.6, "gnu gpl"),
    ("lgpl", "lesser", 0.6, f"gnu lesser general public {L}"),
    ("lgpl", "library", 0.6, f"gnu library general public {L}"),
    ("lgpl", "lgpl", 0.6, "gnu lgpl"),
    ("agpl", "affero", 0.6, f"(?:gnu )?affero general public {L}"),
    ("agpl", "agpl", 0.6, "gnu agpl"),
    ("gfdl", "documentation", 0.6, f"gnu free documentation {L}"),
    ("apache", "apache", 0.6, f"apache (?:software )?{L}"),
    ("mit", "mit", 0.6, f"mit {L}"),
    ("mit-x11", "x11", 0.6, f"x11 {L}"),
    ("expat", "expat", 0.6, f"expat {L}"),
    ("bsd-2-clause", "clause", 0.6, f"(?:bsd )?(?:2|two) clause(?: bsd)?(?: {L})"),
    ("bsd-3-clause", "clause", 0.6, f"(?:bsd )?(?:3|three) clause(?: bsd)?(?: {L})"),
    ("bsd-4-clause", "clause", 0.6, f"(?:bsd )?(?:4|four) clause(?: bsd)?(?: {L})"),
    ("bsd", "bsd", 0.6, f"(?:new |modified |simplified |revised )?bsd {L}"),
    ("isc", "isc", 0.6, f"isc {L}"),
    ("zlib", "zlib", 0.6, f"zlib(?: libpng)? {L}"),
    ("libpng", "libpng", 0.6, f"libpng {L}"),
    ("mpl", "mozilla", 0.6, f"mozilla public {L}"),
    ("epl", "eclipse", 0.6, f"eclipse public {L}"),
    ("cddl", "development", 0.6, f"common development and distribution {L}"),
    ("cpl", "common", 0.6, f"common public {L}"),
    ("eupl", "european", 0.6, f"european union public {L}"),
    ("artistic", "artistic", 0.6, f"artistic {L}"),
    ("boost", "boost", 0.6, f"boost software {L}"),
    ("unlicense", "unlicense", 0.6, "the unlicense"),
    ("wtfpl", "wtfpl", 0.6, "wtfpl"),
    ("ofl", "font", 0.6, f"(?:sil )?open font {L}"),
    ("psf", "python", 0.6, f"python software foundation {L}"),
    ("postgresql", "postgresql", 0.6, f"postgresql {L}"),
    ("openssl", "openssl", 0.6, f"openssl {L}"),
    ("php", "php", 0.6, f"php {L}"),
    ("ruby", "ruby", 0.6, f"ruby {L}"),
    ("qpl", "public", 0.6, f"q public {L}"),
    ("ncsa", "ncsa", 0.6, f"(?:university of illinois )?ncsa(?: open source)? {L}"),
    ("upl", "permissive", 0.6, f"universal permissive {L}"),
    ("afl", "academic", 0.6, f"academic free {L}"),
    ("osl", "open", 0.6, f"open software {L}"),
    ("mulan", "mulan", 0.6, "mulan psl"),
    ("ms-pl", "microsoft", 0.6, f"microsoft public {L}"),
    ("ms-rl", "microsoft", 0.6, f"microsoft reciprocal {L}"),
    ("odbl", "database", 0.6, f"open (?:data commons open )?database {L}"),
    ("odc-by", "attribution", 0.6, f"open data commons attribution {L}"),
    ("pddl", "dedication", 0.6, f"public domain dedication and {L}"),
    ("ogl", "government", 0.6, f"open government {L}"),
    ("cc0", "cc0", 0.6, "cc0"),
    ("cc-by-nc-sa", "by", 0.6, "cc by nc sa"),
    ("cc-by-nc-nd", "by", 0.6, "cc by nc nd"),
    ("cc-by-nc", "by", 0.6, "cc by nc"),
    ("cc-by-sa", "by", 0.6, "cc by sa"),
    ("cc-by-nd", "by", 0.6, "cc by nd"),
    ("cc-by", "by", 0.6, "cc by"),
    ("cc-by-nc-sa", "creative", 0.6, "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "creative", 0.6, "creative commons attribution non ?commercial no ?derivatives"),
    ("cc-by-nc", "creative", 0.6, "creative commons attribution non ?commercial"),
    ("cc-by-sa", "creative", 0.6, "creative commons attribution share ?alike"),
    ("cc-by-nd", "creative", 0.6, "creative commons attribution no ?derivatives"),
    ("cc-by", "creative", 0.6, "creative commons attribution"),
    ("cc", "creative", 0.5, f"creative commons {L}"),
    ("public-domain", "domain", 0.5, "(?:in|into|to) the public domain"),
    ("all-rights-reserved", "reserved", 0.5, "all rights reserved"),
    ("some-rights-reserved", "reserved", 0.5, "some rights reserved"),
]

#: Every base phrase and every rule needs one of these in the lower-cased text, or the expression below.
GATES = (
    "licen", "gpl", "wtfpl", "mulan", "creative", "reserved", "hereby", "redistribut", "unencumbered", "warranty", "copyright", "sublicense", "endorse", "advertising",
    "exception", "invariant", "misrepresented", "altered", "verbatim", "openssl", "apache", "evil", "perl", "ruby", "proprietary", "prohibited", "written",
    "commercial", "derivative", "freeware", "shareware", "cc0",
)
GATE_WORDS = ("cc", "by"), ("public", "domain"), ("stuff", "is")
