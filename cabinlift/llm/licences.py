"""License scan by ordered signature rules, in DataFrame expressions only.

A text becomes its words between single spaces, so that signatures need not care
about punctuation and line breaks. A cheap test picks texts that can hold a
license at all; for those, every rule of which a keyword and the words of its
form occur runs its expression. Rules are signatures written for one license (its
header, notice, a sentence of its text, its address) and names of licenses in the
usual ways to state one. The parts of an SPDX expression are stated one by one.
Overlaps are resolved by priority: a detection inside another one of higher
priority, or inside a longer one of the same, is dropped.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cabinlift.llm.columns import let, places, scanned

# The words and phrases of the data contract.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # as given, on texts whose A-Z are still upper case
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Families: label, keywords one of which is part of every name, names as expressions over
#: lower-case words, and the short identifier as words, which starts with a literal part.
FAMILIES = (
    ("mit", "mit", "mit(?: expat)?", "mit"),
    ("mit-0", "mit", "mit no attribution", "mit 0"),
    ("x11", "x11", "x11", "x11"),
    ("isc", "isc|internet systems consortium", "isc|internet systems consortium", "isc"),
    ("apache-1", "apache", "apache(?: software)? (?:license )?(?:version |v )?1(?: [01])?", "apache 1 [01]"),
    ("apache-2", "apache", "apache (?:software )?(?:license )?(?:version |v )?2(?: 0)?", "apache 2 0"),
    ("bsd-2", "bsd", "(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause", "bsd 2 clause"),
    ("bsd-3", "bsd", "(?:new|revised|modified|3 clause|three clause) bsd|bsd 3 clause", "bsd 3 clause"),
    ("bsd", "bsd", "bsd(?: style)?", "bsd"),
    ("bsd-4", "bsd", "(?:original|old|4 clause|four clause) bsd|bsd 4 clause", "bsd 4 clause"),
    ("0bsd", "bsd", "zero clause bsd|bsd zero clause|0bsd", "0bsd"),
    ("gpl-1", "general public", "(?:gnu )?general public license (?:version |v )?1(?: 0)?", "gpl 1 0"),
    ("gpl-2", "general public", "(?:gnu )?general public license (?:version |v )?2(?: 0)?", "gpl 2 0"),
    ("gpl-3", "general public", "(?:gnu )?general public license (?:version |v )?3(?: 0)?", "gpl 3 0"),
    ("gpl-2", "gpl", "(?:gnu )?gpl(?: version)? ?v? ?2(?: 0)?|gplv2", "gpl 2 0 (?:only|or later)"),
    ("gpl-3", "gpl", "(?:gnu )?gpl(?: version)? ?v? ?3(?: 0)?|gplv3", "gpl 3 0 (?:only|or later)"),
    ("lgpl-2", "lesser general", "(?:gnu )?lesser general public license (?:version |v )?2(?: [01])?", "lgpl 2 [01]"),
    ("lgpl-2", "lgpl", "(?:gnu )?lgpl ?v? ?2(?: [01])?|lgplv2", "lgpl 2 [01] (?:only|or later)"),
    ("lgpl-3", "lesser general", "(?:gnu )?lesser general public license (?:version |v )?3(?: 0)?", "lgpl 3 0"),
    ("lgpl-3", "lgpl", "(?:gnu )?lgpl ?v? ?3(?: 0)?|lgplv3", "lgpl 3 0 (?:only|or later)"),
    ("lgpl-2", "library general", "(?:gnu )?library general public license", "lgpl 2 0"),
    ("agpl-3", "affero", "(?:gnu )?affero general public license(?: (?:version |v )?3(?: 0)?)?", "agpl 3 0"),
    ("agpl-3", "agpl", "(?:gnu )?agpl ?v? ?3(?: 0)?|agplv3", "agpl 3 0 (?:only|or later)"),
    ("fdl", "free documentation", "(?:gnu )?free documentation license", "gfdl 1 [123]"),
    ("mpl-1", "mozilla", "mozilla public license (?:version |v )?1(?: [01])?", "mpl 1 [01]"),
    ("mpl-2", "mozilla", "mozilla public license(?: (?:version |v ?)?2(?: 0)?)?", "mpl 2 0"),
    ("epl-1", "eclipse", "eclipse public license (?:version |v )?1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse", "eclipse public license(?: (?:version |v )?2(?: 0)?)?", "epl 2 0"),
    ("edl-1", "eclipse", "eclipse distribution license", "edl 1 0"),
    ("cddl-1", "common development", "common development and distribution license", "cddl 1 [01]"),
    ("cpl-1", "common public", "common public license", "cpl 1 0"),
    ("cpal-1", "common public", "common public attribution license", "cpal 1 0"),
    ("eupl", "european union|eupl", "european union public licen[cs]e|eupl(?: v?1(?: [012])?)?", "eupl 1 [012]"),
    ("artistic-1", "artistic", "artistic license 1(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic", "artistic license(?: 2(?: 0)?)?", "artistic 2 0"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("libpng", "libpng", "libpng", "libpng"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("boost-1", "boost", "boost software license", "bsl 1 0"),
    ("python", "python", "python software foundation license|python license", "psf 2 0"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("php", "php", "php license", "php 3 0[01]?"),
    ("perl", "perl", "same terms as perl(?: itself)?", "perl"),
    ("postgresql", "postgresql", "postgresql license", "postgresql"),
    ("openssl", "openssl", "openssl license", "openssl"),
    ("ofl", "open font", "(?:sil )?open font license", "ofl 1 [01]"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("upl", "universal permissive", "universal permissive license", "upl 1 0"),
    ("afl", "academic free", "academic free license", "afl 3 0"),
    ("osl", "open software", "open software license", "osl 3 0"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("odbl", "open database", "open (?:data commons )?open database license|open database license", "odbl 1 0"),
    ("odc-by", "open data commons", "open data commons attribution license", "odc by 1 0"),
    ("pddl", "public domain dedication", "(?:open data commons )?public domain dedication and license", "pddl 1 0"),
    ("bsl", "business source", "business source license", "busl 1 1"),
    ("sspl", "server side", "server side public license", "sspl 1 0"),
    ("elastic", "elastic", "elastic license", "elastic 2 0"),
    ("cc0", "cc0|cc zero", "cc0(?: 1 0)?|cc zero", "cc0 1 0"),
    ("cc-by", "cc by", "cc by(?: [1-4] [0-9])?", "cc by [1-4] [0-9]"),
    ("cc-by-sa", "cc by", "cc by sa(?: [1-4] [0-9])?", "cc by sa [1-4] [0-9]"),
    ("cc-by-nd", "cc by", "cc by nd(?: [1-4] [0-9])?", "cc by nd [1-4] [0-9]"),
    ("cc-by-nc", "cc by", "cc by nc(?: [1-4] [0-9])?", "cc by nc [1-4] [0-9]"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: [1-4] [0-9])?", "cc by nc sa [1-4] [0-9]"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd(?: [1-4] [0-9])?", "cc by nc nd [1-4] [0-9]"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4] [0-9])?(?: international| unported| generic)?", "creative commons by"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4] [0-9])?(?: international| unported| generic)?", "creative commons by sa"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [0-9])?(?: international| unported| generic)?", "creative commons by nd"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4] [0-9])?(?: international| unported| generic)?", "creative commons by nc"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike(?: [1-4] [0-9])?(?: international| unported| generic)?", "creative commons by nc sa"),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [0-9])?(?: international| unported| generic)?", "creative commons by nc nd"),
)

#: Ways to state a license: priority (higher wins), weight, words that all of them have, and the
#: expression around a name or identifier.
FORMS = (
    (40, 1.0, "spdx license identifier", "(?:spdx license identifier|spdx\\+) (?:{id})"),
    (30, 0.95, "under", "(?:licen[cs]ed|released|distributed|available|provided|published|covered)(?: to you)? under"
               "(?: the| an?)?(?: terms(?: and conditions)? of)?(?: the| an?)? (?:{name})(?: licen[cs]e)?(?: version [0-9](?: [0-9])?)?"),
    (30, 0.9, "terms of", "subject to the terms of(?: the)? (?:{name})(?: licen[cs]e)?"),
    (20, 0.8, "licen", "(?:licen[cs]e|licen[cs]ing|licen[cs]es?)(?: is| are| as| the| type| name)? (?:{name}|{id})"),
    (15, 0.7, "licen", "(?:{name}) licen[cs]e(?:d)?(?: version [0-9](?: [0-9])?)?"),
)

#: Signatures written for one license or statement: label, keyword, priority, weight, expression.
# Wordings of public license texts, notices and addresses, as words between single spaces.
SIGNATURES = (
    ("all-rights-reserved", "all rights reserved", 10, 0.6, "all rights reserved"),
    ("all-rights-reserved", "tous droits", 10, 0.6, "tous droits réservés"),
    ("all-rights-reserved", "alle rechte", 10, 0.6, "alle rechte vorbehalten"),
    ("all-rights-reserved", "todos los derechos", 10, 0.6, "todos los derechos reservados"),
    ("all-rights-reserved", "may be reproduced", 10, 0.5, "no part of this (?:publication|book|document|work) may be reproduced"),
    ("copyright", "copyright", 5, 0.4, "copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("proprietary", "proprietary", 10, 0.6, "proprietary and confidential|proprietary licen[cs]e"),
    ("proprietary", "end user licen", 10, 0.6, "end user licen[cs]e agreement"),
    ("non-commercial", "commercial use only", 12, 0.5, "for (?:personal )?non ?commercial use only"),
    ("public-domain", "public domain", 25, 0.8, "(?:released into|dedicated to|placed in|in) the public domain"),
    ("public-domain", "publicdomain mark", 30, 0.9, "creativecommons org publicdomain mark"),
    ("mit", "permission is hereby granted", 35, 0.95, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "purpose and noninfringement", 34, 0.9, "the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "licenses mit", 32, 0.95, "(?:opensource org|choosealicense com|spdx org) licenses mit"),
    ("mit", "sous licence mit", 30, 0.9, "sous licence mit"),
    ("mit", "mit lizenz", 30, 0.9, "(?:unter der )?mit lizenz"),
    ("mit", "licencia mit", 30, 0.9, "(?:bajo la )?licencia mit"),
    ("mit", "approved mit", 32, 0.95, "license osi approved mit license"),
    ("x11", "consortium shall not", 35, 0.95, "the name of the x consortium shall not be used in advertising"),
    ("ncsa", "to deal with the software", 36, 0.95, "to deal with the software without restriction"),
    ("json", "good not evil", 36, 0.95, "the software shall be used for good not evil"),
    ("isc", "permission to use copy modify", 35, 0.9, "permission to use copy modify and or distribute this software"
            " for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "permission to use copy modify", 33, 0.85, "permission to use copy modify and or distribute this software"),
    ("bsd", "redistribution and use", 35, 0.9, "redistribution and use in source and binary forms"),
    ("bsd", "must retain the above copyright", 33, 0.85, "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", "must reproduce the above", 33, 0.85, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "to endorse or promote", 36, 0.9, "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4", "all advertising materials", 37, 0.95, "all advertising materials mentioning features or use of this software must display the following"),
    ("bsd", "bsd", 31, 0.9, "(?:distributed|released|licensed) under (?:the |a )?bsd(?: style)? licen[cs]e"),
    ("bsd", "approved bsd", 32, 0.95, "license osi approved bsd license"),
    ("bsd-2", "licenses bsd 2", 32, 0.95, "(?:opensource org|choosealicense com|spdx org) licenses bsd 2 clause"),
    ("bsd-3", "licenses bsd 3", 32, 0.95, "(?:opensource org|choosealicense com|spdx org) licenses bsd 3 clause"),
    ("apache-2", "except in compliance with the license", 36, 1.0, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "apache org licenses", 34, 0.95, "(?:www )?apache org licenses license 2 0"),
    ("apache-2", "license version 2 0 january", 36, 1.0, "apache license version 2 0 january 2004"),
    ("apache-2", "agreed to in writing", 33, 0.85, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "approved apache", 32, 0.9, "license osi approved apache software license"),
    ("apache-2", "licenses apache 2", 32, 0.95, "(?:opensource org|choosealicense com|spdx org) licenses apache 2 0"),
    ("apache-1", "apache software license", 35, 0.95, "the apache software license version 1 [01]"),
    ("apache-1", "by the apache", 30, 0.7, "this product includes software developed by the apache software foundation"),
    ("gpl", "general public", 12, 0.7, "(?:gnu )?general public license"),
    ("gpl", "gnu gpl", 12, 0.7, "gnu gpl"),
    ("gpl-2", "general public license", 36, 1.0, "(?:terms of|under) the gnu general public license(?: as published by the free software foundation)?(?: either)? version 2"),
    ("gpl-3", "general public license", 36, 1.0, "(?:terms of|under) the gnu general public license(?: as published by the free software foundation)?(?: either)? version 3"),
    ("gpl-1", "general public license", 36, 1.0, "(?:terms of|under) the gnu general public license(?: as published by the free software foundation)?(?: either)? version 1"),
    ("gpl", "with this program", 14, 0.8, "you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2", "freedom to share and change it", 36, 1.0, "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "free copyleft license", 36, 1.0, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2", "licenses gpl 2", 32, 0.95, "(?:gnu org|opensource org|spdx org) (?:old )?licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", "licenses gpl 3", 32, 0.95, "(?:gnu org|opensource org|spdx org) licenses gpl 3 0"),
    ("gpl-2", "gplv2", 32, 0.9, "gnu general public license v2(?: or later)? gplv2"),
    ("gpl-3", "gplv3", 32, 0.9, "gnu general public license v3(?: or later)? gplv3"),
    ("lgpl-2", "lesser general public license", 37, 1.0, "(?:terms of|under) the gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 2"),
    ("lgpl-3", "lesser general public license", 37, 1.0, "(?:terms of|under) the gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 3"),
    ("lgpl-2", "library general public license", 37, 1.0, "(?:terms of|under) the gnu library general public license(?: as published by the free software foundation)?(?: either)? version 2"),
    ("lgpl", "lesser general public license", 14, 0.8, "you should have received a copy of the gnu lesser general public license"),
    ("lgpl", "gnu org licenses lgpl", 30, 0.9, "gnu org licenses lgpl"),
    ("agpl-3", "affero general public license", 37, 1.0, "(?:terms of|under) the gnu affero general public license(?: as published by the free software foundation)?(?: either)? version 3"),
    ("agpl-3", "remote network interaction", 36, 0.95, "remote network interaction use with the gnu general public license"),
    ("agpl-3", "gnu org licenses agpl", 32, 0.95, "gnu org licenses agpl"),
    ("fdl", "free documentation license", 36, 1.0, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "mozilla public license", 36, 1.0, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "a copy of the mpl", 35, 0.95, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2", "mozilla org mpl 2", 32, 0.95, "mozilla org mpl 2 0"),
    ("mpl-1", "mozilla public license version 1", 36, 1.0, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("npl", "netscape public", 35, 0.95, "netscape public license"),
    ("epl-1", "eclipse public license", 36, 1.0, "made available under the terms of the eclipse public license (?:v|version) ?1 0"),
    ("epl-2", "eclipse public license", 36, 1.0, "made available under the terms of the eclipse public license (?:v ?|version )?2 0"),
    ("epl-1", "legal epl v10", 32, 0.95, "eclipse org legal epl v10"),
    ("epl-2", "legal epl", 31, 0.95, "eclipse org legal epl (?:2 0|v20)"),
    ("cddl-1", "common development", 36, 1.0, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1", "common public license", 36, 1.0, "the accompanying program is provided under the terms of this common public license"),
    ("eupl", "eupl", 34, 0.95, "licen[cs]ed under the eupl"),
    ("cecill", "cecill", 34, 0.95, "(?:governed by|under) the cecill(?: [abc])? licen[cs]e|cecill(?: free software)? licen[cs]e"),
    ("artistic-1", "preamble the intent", 36, 0.95, "the artistic license preamble the intent of this document"),
    ("zlib", "in no event will the authors", 36, 0.95, "without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "plainly marked as such", 35, 0.9, "altered source versions must be plainly marked as such"),
    ("unlicense", "free and unencumbered", 36, 1.0, "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", 32, 0.9, "unlicense org"),
    ("wtfpl", "want to public license", 36, 1.0, "do what the f[a-z]+ you want to public license"),
    ("wtfpl", "verbatim or modified copies", 35, 0.9, "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("beerware", "beer ware", 34, 0.95, "the beer ware license"),
    ("boost-1", "boost software license", 36, 1.0, "distributed under the boost software license version 1 0"),
    ("boost-1", "software and accompanying documentation covered", 36, 1.0, "obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost-1", "boost org license", 32, 0.95, "boost org license 1 0"),
    ("python", "psf is making python", 36, 1.0, "psf is making python available to licensee on an as is basis"),
    ("python", "python software foundation license", 34, 0.95, "python software foundation license version 2"),
    ("php", "of the php license", 36, 1.0, "this source file is subject to version 3 0?[01] of the php license"),
    ("postgresql", "without a written agreement", 37, 1.0, "for any purpose without fee and without a written agreement is hereby granted"),
    ("openssl", "openssl toolkit", 36, 0.95, "developed by the openssl project for use in the openssl toolkit"),
    ("ofl", "this font software", 36, 1.0, "this font software is licensed under the sil open font license"),
    ("ofl", "scripts sil org ofl", 32, 0.95, "scripts sil org ofl"),
    ("ubuntu-font", "ubuntu font", 34, 0.95, "ubuntu font licen[cs]e"),
    ("bitstream-vera", "bitstream vera", 30, 0.8, "bitstream vera (?:fonts )?(?:copyright|is a trademark)"),
    ("lppl", "latex project public", 35, 1.0, "latex project public license"),
    ("ms-pl", "this license governs use", 36, 1.0, "microsoft public license ms pl this license governs use of the accompanying software"),
    ("apsl", "apple public source", 34, 0.95, "apple public source license"),
    ("qpl", "q public license", 34, 0.95, "q public license"),
    ("spl", "sun public license", 34, 0.95, "sun public license"),
    ("rpl", "reciprocal public", 34, 0.95, "reciprocal public license"),
    ("sleepycat", "sleepycat", 34, 0.95, "sleepycat(?: software| public)? license"),
    ("vim", "vim is charityware", 36, 1.0, "vim is charityware"),
    ("w3c", "w3c software", 34, 0.95, "w3c software (?:and document )?(?:notice and )?license"),
    ("unicode", "unicode license", 34, 0.95, "unicode license(?: agreement)?|unicode license v3"),
    ("curl", "curl license", 30, 0.9, "curl license"),
    ("blue-oak", "blue oak", 35, 1.0, "blue oak model license"),
    ("mulan", "mulan", 35, 1.0, "mulan (?:permissive software license|psl)"),
    ("hippocratic", "hippocratic", 35, 1.0, "hippocratic license"),
    ("free-art", "licence art libre", 35, 0.95, "licence art libre"),
    ("free-art", "free art license", 35, 0.95, "free art license"),
    ("odbl", "open database license", 36, 1.0, "this (?:[^ ]+ )?database is made available under the open database license"),
    ("odbl", "database contents license", 34, 0.9, "licensed under the database contents license"),
    ("odc-by", "data commons attribution", 36, 1.0, "made available under the open data commons attribution license"),
    ("pddl", "opendatacommons org licenses pddl", 32, 0.95, "opendatacommons org licenses pddl"),
    ("odbl", "opendatacommons org licenses odbl", 32, 0.95, "opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons org licenses by", 32, 0.95, "opendatacommons org licenses by"),
    ("ogl-uk", "open government licen", 34, 0.95, "open government licen[cs]e"),
    ("etalab", "licence ouverte", 34, 0.95, "licence ouverte(?: open licence)?"),
    ("dl-de", "datenlizenz deutschland", 34, 0.95, "datenlizenz deutschland"),
    ("bsl", "business source license", 34, 1.0, "business source license 1 1"),
    ("bsl", "additional use grant", 34, 0.9, "additional use grant"),
    ("sspl", "as a service", 35, 0.95, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", "hosted or managed service", 36, 1.0, "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", 35, 1.0, "commons clause(?: license condition| restriction)?"),
    ("rail", "openrail", 35, 0.95, "openrail(?: m)?"),
    ("rail", "open rail", 35, 0.95, "(?:creativeml|bigscience|bigcode) open rail(?: m)?|open rail m"),
    ("rail", "responsible ai license", 35, 0.95, "responsible ai license"),
    ("llama", "community license", 35, 1.0, "llama [0-9](?: [0-9])? community license(?: agreement)?"),
    ("gemma", "gemma terms of use", 35, 1.0, "gemma terms of use"),
    ("cc0", "possible under law", 36, 1.0, "to the extent possible under law (?:[^ ]+ ){1,16}has waived all copyright and related or neighboring rights"),
    ("cc0", "associated a work with this deed", 36, 1.0, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "publicdomain zero", 34, 1.0, "creativecommons org publicdomain zero"),
    ("cc", "creative commons", 12, 0.6, "creative commons licen[cs]e"),
    ("cc-by", "creativecommons org licenses by", 34, 1.0, "creativecommons org licenses by(?: [1-4] [0-9])?"),
    ("cc-by-sa", "creativecommons org licenses by sa", 35, 1.0, "creativecommons org licenses by sa"),
    ("cc-by-nd", "creativecommons org licenses by nd", 35, 1.0, "creativecommons org licenses by nd"),
    ("cc-by-nc", "creativecommons org licenses by nc", 35, 1.0, "creativecommons org licenses by nc(?: [1-4] [0-9])?"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", 36, 1.0, "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", 36, 1.0, "creativecommons org licenses by nc nd"),
    ("cc-by", "cc by", 22, 0.85, "cc by [1-4] [0-9]"),
    ("cc-by-sa", "cc by sa", 22, 0.85, "cc by sa(?: [1-4] [0-9])?"),
    ("cc-by-nd", "cc by nd", 22, 0.85, "cc by nd(?: [1-4] [0-9])?"),
    ("cc-by-nc", "cc by nc", 22, 0.85, "cc by nc(?: [1-4] [0-9])?"),
    ("cc-by-nc-sa", "cc by nc sa", 22, 0.85, "cc by nc sa(?: [1-4] [0-9])?"),
    ("cc-by-nc-nd", "cc by nc nd", 22, 0.85, "cc by nc nd(?: [1-4] [0-9])?"),
)

#: An operator of an SPDX expression; it is read as the beginning of the next identifier.
SPDX = "spdx license identifier"
SPDX_AND = rf"(?i)(?<={SPDX} [a-z0-9 ]{{1,100}}) (?:or|and|with)(?= )"


def _literal(short: str) -> str:
    """The words that an identifier starts with, up to its first choice."""
    return re.match(r"[a-z0-9 ]+(?![?*])", short).group().strip()


def _keywords(form: str, names: str, short: str) -> list[str]:
    """Words one of which is in every match of ``form`` around names or the identifier."""
    every = (names.split("|") if "{name}" in form else []) + ([_literal(short)] if "{id}" in form else [])
    return [x for x in every if not any(y != x and y in x for y in every)]


def rules() -> list[dict]:
    """Every rule: keywords and form words, expression over words between single spaces, label, priority, weight."""
    made = [
        {"keywords": _keywords(form, names, short), "form": words, "label": label, "priority": priority, "weight": weight,
         "regex": f"(?i)(?<= )(?:{form.format(name=name, id=short)})(?= )"}
        for label, names, name, short in FAMILIES for priority, weight, words, form in FORMS
    ]
    return made + [
        {"keywords": [keyword], "form": "", "label": label, "priority": priority, "weight": weight,
         "regex": f"(?i)(?<= )(?:{regex})(?= )"}
        for label, keyword, priority, weight, regex in SIGNATURES
    ]


def _hint() -> str:
    """An expression that every text with a rule's or a fixed phrase's words matches: the words they need, from a word's start."""
    common = ["licen[sc]", "copyright", "spdx", "creative commons", "creativecommons", "public domain", "cc by", "general public",
              "(?:released|distributed|available|provided|published|covered) (?:to you )?under ",
              "subject to the terms of ", "(?:non)?commercial use only"]
    some = re.compile("(?<= )(?:" + "|".join(common) + ")")
    own = sorted({keyword for _, keyword, *_ in SIGNATURES if not some.search(f" {keyword}")})
    return "(?i)(?<= )(?:" + "|".join(common + own) + ")"


#: Words without which no rule and no fixed phrase can match.
HINT = _hint()

_RULE = "array<struct<keywords:array<string>,form:string,label:string,priority:int,weight:double,regex:string>>"
_HIT = "array<struct<s:int,e:int,label:string,priority:int,weight:double>>"


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _word_places(norm: Column, regex: Column) -> Column:
    """Matches as word numbers from 0, end exclusive: spaces before, less the leading one."""
    return F.transform(places(norm, regex, _spaces),
                       lambda x: F.struct((x["s"] - 1).alias("s"), x["e"].alias("e")))


def _phrase(norm: Column, phrase: str, label: str) -> Column:
    return F.transform(
        _word_places(norm, F.lit(f"(?i)(?<= ){phrase}(?= )")),
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(label).alias("label")))


def _detections(norm: Column, table: list[dict]) -> Column:
    """What the rules find: keywords and form words pick the rules that run at all."""
    every = F.from_json(F.lit(json.dumps(table)), _RULE)

    def run(lowered: Column) -> Column:
        chosen = F.filter(every, lambda r: F.contains(lowered, r["form"]) & F.exists(
            r["keywords"], lambda k: F.contains(lowered, k)))
        return F.flatten(F.transform(chosen, lambda r: F.transform(
            _word_places(norm, r["regex"]),
            lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), r["label"].alias("label"),
                               r["priority"].alias("priority"), r["weight"].alias("weight")))))

    return let(F.lower(norm), run)


def _resolve(hits: Column, priorities: list[int]) -> Column:
    """Without detections that lie in one of higher priority, or in a longer one of the same.

    In one sweep by place: whatever holds a detection starts before it or with
    it, so the furthest end so far, by priority, tells.
    """
    order = F.array_sort(F.transform(hits, lambda x: F.struct(
        x["s"].alias("s"), (-x["e"]).alias("back"), (-x["priority"]).alias("low"), x["label"].alias("label"), x["weight"].alias("weight"))))
    levels = F.array(*[F.lit(p) for p in priorities])
    far = F.struct(F.lit(-1).alias("e"), F.lit(0).alias("before"))
    step = lambda state, x: F.zip_with(state, levels, lambda m, p: F.when(
        p == -x["low"], F.greatest(m, F.struct((-x["back"]).alias("e"), (-x["s"]).alias("before")))).otherwise(m))

    def emit(state: Column, x: Column) -> Column:
        e, priority = -x["back"], -x["low"]
        held = F.exists(F.zip_with(state, levels, lambda m, p: (
            (p > priority) & (m["e"] >= e)) | ((p == priority) & ((m["e"] > e) | ((m["e"] == e) & (-m["before"] < x["s"]))))), lambda h: h)
        return F.struct(x["s"].alias("s"), e.alias("e"), x["label"].alias("label"), priority.alias("priority"), x["weight"].alias("weight"),
                        held.alias("held"))

    kept = F.filter(scanned(order, F.array(*[far for _ in priorities]), step, emit), lambda x: ~x["held"])
    return F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("s", "e", "label", "priority", "weight")]))


def find_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``base`` (places of the fixed phrases) and ``hits`` (resolved detections).

    Places are struct(s, e, label, ...) in words from 0, end exclusive. One row
    in, one row out; other columns pass through, and columns already called
    ``n_words``, ``base``, ``hits`` or ``words_`` are replaced. Null and empty texts have no
    words and no places.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), NO_WORD, " "))
    docs = docs.withColumn("words_", F.concat(F.lit(" "), plain, F.lit(" ")))
    norm = F.col("words_")
    docs = docs.withColumn("n_words", F.when(norm == "  ", 0).otherwise(_spaces(norm) - 1).cast("long"))
    base = F.concat(*[_phrase(norm, phrase, label) for phrase, label in BASE.items()])
    none = lambda kind: F.array().cast(kind)
    gate = norm.rlike(HINT)
    docs = docs.withColumn("base", F.when(gate, base).otherwise(none("array<struct<s:int,e:int,label:string>>")))
    table = rules()
    stated = F.when(F.contains(F.lower(norm), F.lit(SPDX)), F.regexp_replace(norm, SPDX_AND, " spdx+")).otherwise(norm)
    hits = _resolve(let(stated, lambda words: _detections(words, table)), sorted({rule["priority"] for rule in table}))
    docs = docs.withColumn("hits", F.when(gate, hits).otherwise(none(_HIT)))
    return docs.drop("words_")


def licence_report(docs: DataFrame) -> DataFrame:
    """Words, places of the fixed phrases and all labels, one row per document row."""
    found = find_licences(docs.select("doc_id", "text"))
    starts, fixed = F.transform("base", lambda x: x["s"]), F.transform("base", lambda x: x["label"])
    seen = F.transform("hits", lambda x: x["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(fixed).alias("base_labels"), joined(F.concat(fixed, seen)).alias("labels"),
        F.greatest(
            F.when(F.size("base") > 0, 1.0).otherwise(0.0),
            F.coalesce(F.array_max(F.transform("hits", lambda x: x["weight"])), F.lit(0.0)),
        ).alias("score"),
        F.size("hits").cast("long").alias("n_hits"),
    )
