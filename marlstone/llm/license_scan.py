"""License scans with DataFrame functions only.

A text is reduced to its words, each between two spaces (" mit  license "), so that a phrase
matches on word borders and neighbouring matches never share a character.  An ordered list of
signature rules (regexes over that form) runs behind a keyword prefilter: a rule's regex is
tried only where one of its keywords is a word of the text.  Detections are intervals of the spaced
form.  One that lies inside another is suppressed if the other has a higher priority, or the same
priority and is longer, or has the same priority and interval and stands earlier in the list.  No
row leaves its partition: the whole operator is one projection, and its work grows with the text
and with its detections, not with their square.

Rules are of two kinds: SIGNATURES, sentences and names that stand in license texts and notices,
written one by one; and those for the names in FAMILIES, made for each by the same few shapes.

Cases: null and empty texts have no word and score 0; a text without any keyword costs one
pass; detections at equal intervals leave one for each priority's first rule at most; extra columns
are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and the labels that the base rules give.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Families: label, keyword that must stand in the text, name as words (regex over them), versions.
FAMILIES = [
    ("apache", "apache", "apache( software)? licen[cs]e", ["1 0", "1 1", "2 0"]),
    ("mit", "mit", "mit licen[cs]e", []),
    ("isc", "isc", "isc licen[cs]e", []),
    ("gpl", "gnu", "gnu general public licen[cs]e", ["1", "2", "3"]),
    ("lgpl", "lesser", "gnu lesser general public licen[cs]e", ["2 1", "3"]),
    ("lgpl", "library", "gnu library general public licen[cs]e", ["2"]),
    ("agpl", "affero", "gnu affero general public licen[cs]e", ["1", "3"]),
    ("gfdl", "documentation", "gnu free documentation licen[cs]e", ["1 1", "1 2", "1 3"]),
    ("mpl", "mozilla", "mozilla public licen[cs]e", ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", "eclipse public licen[cs]e", ["1 0", "2 0"]),
    ("edl", "eclipse", "eclipse distribution licen[cs]e", ["1 0"]),
    ("cpl", "common", "common public licen[cs]e", ["1 0"]),
    ("cddl", "distribution", "common development and distribution licen[cs]e", ["1 0", "1 1"]),
    ("artistic", "artistic", "artistic licen[cs]e", ["1 0", "2 0"]),
    ("bsl", "boost", "boost software licen[cs]e", ["1 0"]),
    ("bsd", "bsd", "(new|simplified|modified|original)? ?bsd licen[cs]e", []),
    ("bsd-2", "bsd", "(bsd 2 clause|2 clause bsd|two clause bsd)( licen[cs]e)?", []),
    ("bsd-3", "bsd", "(bsd 3 clause|3 clause bsd|three clause bsd)( licen[cs]e)?", []),
    ("bsd-4", "bsd", "(bsd 4 clause|4 clause bsd|four clause bsd)( licen[cs]e)?", []),
    ("bsd-0", "0bsd", "0bsd( licen[cs]e)?", []),
    ("bsd-0", "bsd", "zero clause bsd( licen[cs]e)?", []),
    ("zlib", "zlib", "zlib( libpng)? licen[cs]e", []),
    ("unlicense", "unlicense", "unlicense", []),
    ("wtfpl", "wtfpl", "wtfpl", ["1", "2"]),
    ("eupl", "european", "european union public licen[cs]e", ["1 0", "1 1", "1 2"]),
    ("osl", "open", "open software licen[cs]e", ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", "academic", "academic free licen[cs]e", ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("ecl", "educational", "educational community licen[cs]e", ["1 0", "2 0"]),
    ("ncsa", "ncsa", "(university of illinois )?ncsa( open source)? licen[cs]e", []),
    ("psf", "python", "python( software foundation)? licen[cs]e", ["2", "3 0"]),
    ("php", "php", "php licen[cs]e", ["3 0", "3 01"]),
    ("ruby", "ruby", "ruby licen[cs]e", []),
    ("perl", "perl", "same terms as perl( itself)?", []),
    ("openssl", "openssl", "openssl licen[cs]e", []),
    ("postgresql", "postgresql", "postgresql licen[cs]e", []),
    ("ofl", "sil", "sil open font licen[cs]e", ["1 0", "1 1"]),
    ("odbl", "database", "open( data commons)?( open)? database licen[cs]e", ["1 0"]),
    ("odc-by", "attribution", "open data commons attribution licen[cs]e", ["1 0"]),
    ("ogl", "government", "open government licen[cs]e", ["1 0", "2 0", "3 0"]),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", []),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", []),
    ("apsl", "apple", "apple public source licen[cs]e", ["1 0", "1 1", "1 2", "2 0"]),
    ("ipl", "ibm", "ibm public licen[cs]e", ["1 0"]),
    ("npl", "netscape", "netscape public licen[cs]e", ["1 0", "1 1"]),
    ("qpl", "public", "q public licen[cs]e", ["1 0"]),
    ("sspl", "server", "server side public licen[cs]e", ["1"]),
    ("busl", "business", "business source licen[cs]e", ["1 0", "1 1"]),
    ("elastic", "elastic", "elastic licen[cs]e", ["1 0", "2 0"]),
    ("upl", "universal", "universal permissive licen[cs]e", ["1 0"]),
    ("vim", "vim", "vim licen[cs]e", []),
    ("w3c", "w3c", "w3c software( notice and)? licen[cs]e", []),
    ("x11", "x11", "x11 licen[cs]e", []),
    ("zpl", "zope", "zope public licen[cs]e", ["1 1", "2 0", "2 1"]),
    ("cecill", "cecill", "cecill( free software)?( licen[cs]e)?", ["1 0", "2 0", "2 1"]),
    ("mulan", "mulan", "mulan( permissive software licen[cs]e| psl)", ["1", "2"]),
    ("cc0", "cc0", "(creative commons )?cc0( universal)?", ["1 0"]),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(ative)?s", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(ative)?s", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", "creative", "creative commons attribution", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", "cc", "cc by sa", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", "cc", "cc by nc", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", "cc", "cc by nd", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", "cc", "cc by nc sa", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", "cc", "cc by nc nd", ["2 0", "2 5", "3 0", "4 0"]),
]

#: Rules that stand alone: label, keyword, words, priority.
SINGLE = [
    ("copyright", "copyright", "copyright( c)?( (19|20)[0-9][0-9])?", 2),
    ("reserved", "rights", "(all|no|some) rights reserved", 2),
    ("public-domain", "domain", "(in|into|to) the public domain", 2),
    ("proprietary", "proprietary", "proprietary and confidential", 2),
    ("proprietary", "redistribution", "redistribution( or use)? is prohibited", 2),
    ("warranty", "warranty", "without warranty of any kind", 1),
    ("warranty", "merchantability", "(warranties|warranty) of merchantability", 1),
    ("grant", "permission", "permission is hereby granted free of charge", 3),
    ("grant", "redistribution", "redistribution and use in source and binary forms", 3),
    ("license", "licensed", "licensed under( the)?", 1),
    ("license", "released", "released under( the)?", 1),
    ("license", "license", "license", 0),
    ("license", "licence", "licence", 0),
]

#: Sentences and names of license texts: label, keyword, words, priority.
SIGNATURES = [
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software", 5),
    ("mit", "substantial", "this permission notice shall be included in all copies or substantial portions of the software", 5),
    ("mit", "noninfringement", "merchantability fitness for a particular purpose and noninfringement", 3),
    ("mit", "deal", "to deal in the software without restriction", 4),
    ("mit-0", "mit", "mit no attribution", 5),
    ("isc", "isc", "internet systems consortium", 4),
    ("isc", "hereby", "permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted", 5),
    ("bsd", "endorse", "may be used to endorse or promote products derived from this software", 4),
    ("bsd-3", "endorse", "neither the name of( the)? [a-z0-9]+ nor the names of its contributors may be used to endorse", 5),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software", 5),
    ("bsd", "retain", "redistributions of source code must retain the above copyright notice", 4),
    ("bsd", "reproduce", "redistributions in binary form must reproduce the above copyright notice", 4),
    ("bsd", "regents", "(the )?regents of the university of california", 3),
    ("bsd-patent", "bsd", "bsd 2 clause plus patent", 5),
    ("apache", "apache", "apache org licenses", 4),
    ("apache-2.0", "apache", "www apache org licenses license 2 0", 6),
    ("apache", "apache", "the apache software foundation", 3),
    ("apache", "compliance", "you may not use this file except in compliance with the license", 4),
    ("apache", "basis", "distributed on an as is basis without warranties or conditions of any kind", 4),
    ("gpl", "gnu", "gnu gpl", 4),
    ("gpl", "gpl", "gpl( version| v)? v?[123]( 0)?( only| or later)?", 4),
    ("gpl-2.0", "gpl", "gplv2( only| or later)?", 5),
    ("gpl-3.0", "gpl", "gplv3( only| or later)?", 5),
    ("gpl-2.0", "gplv2", "gplv2", 5),
    ("gpl-3.0", "gplv3", "gplv3", 5),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 6),
    ("gpl", "copyleft", "copyleft", 2),
    ("gpl", "gnu", "www gnu org licenses", 4),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license", 5),
    ("lgpl", "gnu", "you should have received a copy of the gnu lesser general public license", 5),
    ("agpl", "gnu", "you should have received a copy of the gnu affero general public license", 5),
    ("lgpl", "lgpl", "lgpl( version| v)? ?v?[23]?( [01])?", 4),
    ("lgpl-2.1", "lgplv2", "lgplv2( 1)?", 5),
    ("lgpl-3.0", "lgplv3", "lgplv3", 5),
    ("agpl", "agpl", "agpl( version| v)? ?v?3?( 0)?", 4),
    ("agpl-3.0", "agplv3", "agplv3", 5),
    ("gpl-classpath", "classpath", "classpath exception", 5),
    ("gpl-linking", "linking", "(special|linking) exception", 3),
    ("gfdl", "invariant", "no invariant sections no front cover texts and no back cover texts", 5),
    ("gfdl", "gfdl", "gfdl", 4),
    ("mpl-2.0", "mozilla", "if a copy of the mpl was not distributed with this file", 5),
    ("mpl", "mozilla", "mozilla org mpl", 4),
    ("mpl", "mpl", "mpl( version| v)? ?v?[12]( [01])?", 4),
    ("mpl-exhibit-b", "incompatible", "incompatible with secondary licenses", 4),
    ("epl", "epl", "epl( version| v)? ?v?[12]( 0)?", 4),
    ("epl", "eclipse", "www eclipse org (legal|org documents) epl", 5),
    ("cddl", "cddl", "cddl( version| v)? ?v?1?( [01])?", 4),
    ("artistic", "artistic", "perl artistic", 4),
    ("bsl", "boost", "www boost org license", 5),
    ("bsl", "boost", "boost software", 3),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 5),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 5),
    ("libpng", "libpng", "libpng( license)?", 4),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 6),
    ("wtfpl", "fuck", "do what the fuck you want to", 5),
    ("cc0", "cc0", "cc0( 1 0)?( universal)?", 4),
    ("cc0", "publicdomain", "creativecommons org publicdomain zero", 5),
    ("public-domain", "pdm", "public domain mark", 3),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1-4] [05]", 5),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] [05]", 6),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] [05]", 6),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1-4] [05]", 6),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] [05]", 6),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] [05]", 6),
    ("cc", "creative", "creative commons", 2),
    ("cc", "creativecommons", "creativecommons org", 2),
    ("ofl", "ofl", "ofl( version| v)? ?v?1?( [01])?", 4),
    ("ofl", "sil", "scripts sil org ofl", 5),
    ("odbl", "odbl", "odbl", 4),
    ("pddl", "pddl", "pddl|public domain dedication and license", 4),
    ("odc-by", "opendatacommons", "opendatacommons org licenses (by|odbl|pddl)", 5),
    ("ogl", "crown", "crown copyright", 3),
    ("ms-pl", "ms", "ms pl", 4),
    ("ms-rl", "ms", "ms rl", 4),
    ("ms-eula", "microsoft", "microsoft software license terms", 4),
    ("apsl", "apsl", "apsl", 4),
    ("oracle-bcl", "oracle", "oracle binary code license( agreement)?", 4),
    ("oracle-otn", "oracle", "oracle technology network license( agreement)?", 4),
    ("nvidia", "nvidia", "nvidia( software| cuda)? license( agreement)?", 4),
    ("intel", "intel", "intel simplified software license", 4),
    ("json", "evil", "the software shall be used for good not evil", 6),
    ("beerware", "beer", "beer ware license|buy me a beer", 5),
    ("ftl", "freetype", "(the )?freetype (project )?license", 4),
    ("ijg", "jpeg", "independent jpeg group( s)?", 3),
    ("tcl", "tcl", "tcl tk license", 4),
    ("curl", "curl", "curl license", 4),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 5),
    ("ssleay", "cryptsoft", "eric young eay cryptsoft com", 4),
    ("icu", "icu", "icu license", 4),
    ("unicode", "unicode", "unicode (license|inc license agreement|terms of use)", 4),
    ("ncsa", "llvm", "llvm (release )?license", 4),
    ("llvm-exception", "llvm", "llvm exceptions?", 5),
    ("python", "psf", "psf license( agreement)?", 4),
    ("cnri", "cnri", "cnri( open source)? license( agreement)?", 4),
    ("hpnd", "supporting", "both that copyright notice and this permission notice appear in supporting documentation", 4),
    ("ntp", "ntp", "ntp license", 4),
    ("bzip2", "bzip2", "bzip2 license", 4),
    ("info-zip", "info", "info zip license", 4),
    ("lppl", "latex", "latex project public license", 5),
    ("lppl", "lppl", "lppl", 4),
    ("sleepycat", "sleepycat", "sleepycat( software)? license", 4),
    ("sunpro", "sunpro", "developed at sunpro", 4),
    ("eupl", "eupl", "eupl( version| v)? ?v?1?( [012])?", 4),
    ("cecill", "cea", "cea cnrs inria", 4),
    ("etalab", "etalab", "licence ouverte|etalab", 4),
    ("dl-de", "datenlizenz", "datenlizenz deutschland", 4),
    ("sspl", "sspl", "sspl", 4),
    ("elastic", "elastic", "elastic co licensing", 4),
    ("commons-clause", "commons", "commons clause", 5),
    ("polyform", "polyform", "polyform (noncommercial|shield|perimeter|strict|free trial|small business|internal use)( license)?", 5),
    ("prosperity", "prosperity", "prosperity public license", 5),
    ("parity", "parity", "parity public license", 5),
    ("hippocratic", "hippocratic", "hippocratic license", 5),
    ("openrail", "openrail", "(creativeml )?open ?rail( m)?", 5),
    ("openrail", "responsible", "responsible ai license", 4),
    ("bigscience", "bigscience", "bigscience( bloom)? rail", 5),
    ("llama", "llama", "llama( 2| 3)? community license( agreement)?", 5),
    ("gemma", "gemma", "gemma terms of use", 4),
    ("non-commercial", "commercial", "(for )?non commercial use only", 3),
    ("non-commercial", "noncommercial", "(for )?noncommercial use only", 3),
    ("research-only", "research", "for research (purposes|use) only", 3),
    ("evaluation", "evaluation", "for evaluation purposes only", 3),
    ("no-derivatives", "derivative", "no derivative works", 3),
    ("share-alike", "alike", "share ?alike", 2),
    ("attribution", "attribution", "attribution required", 2),
    ("proprietary", "unauthorized", "unauthorized (copying|use|reproduction|distribution)( or distribution)?( of this (file|work|material))?( via any medium)? is( strictly)? prohibited", 4),
    ("proprietary", "confidential", "(strictly|company) confidential", 3),
    ("proprietary", "permission", "without( the)?( prior)?( express)? written (permission|consent)", 2),
    ("proprietary", "trade", "trade secrets?", 2),
    ("eula", "end", "end user licen[cs]e agreement", 4),
    ("eula", "eula", "eula", 3),
    ("terms", "terms", "terms (of use|of service|and conditions)", 1),
    ("fair-use", "fair", "fair (use|dealing)", 1),
    ("dmca", "dmca", "dmca", 1),
    ("trademark", "trademark", "(registered )?trademarks?( of)?", 1),
    ("patent", "patent", "patent (license|grant|pending)", 1),
    ("source-available", "source", "source available", 2),
    ("open-source", "open", "open source", 0),
    ("dual", "dual", "dual licensed( under)?", 3),
    ("copyright", "reproduced", "no part of this (publication|work|book) may be reproduced", 3),
    ("copyright", "rightsholder", "rights ?holders?", 1),
    ("copyright", "permission", "(used|reprinted|reproduced) (with|by)( kind)? permission", 2),
    ("license", "licence", "licensed under( the)? licence", 1),
    ("license", "terms", "subject to the terms( and conditions)? of", 1),
    ("license", "see", "see( the)? (license|copying|notice)( file| txt| md)?( for details)?", 1),
    ("license", "licensing", "licensing( terms| information)?", 0),
    ("license", "relicensed", "relicen[cs]ed( under)?( the)?", 1),
    ("license", "sublicense", "sublicen[cs]e", 0),
    ("notice", "retained", "this notice (must|shall) be retained", 2),
    ("notice", "notice", "this (copyright )?notice may not be removed", 2),
    ("warranty", "disclaimer", "disclaimer of warrant(y|ies)", 1),
    ("warranty", "liable", "in no event shall( the)? [a-z0-9]+( [a-z0-9]+){0,6} be liable", 2),
    ("warranty", "provided", "(is )?provided (as is|as available|by the copyright holders?)", 1),
]

#: SPDX identifiers as words, without the version, where they differ from the name.
SPDX = {
    "mit": "mit", "isc": "isc", "zlib": "zlib", "ncsa": "ncsa", "openssl": "openssl", "postgresql": "postgresql", "ruby": "ruby", "ms-pl": "ms pl", "ms-rl": "ms rl",
    "x11": "x11", "vim": "vim", "w3c": "w3c", "qpl": "qpl 1 0", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "gfdl": "gfdl", "mpl": "mpl", "epl": "epl", "cpl": "cpl",
    "cddl": "cddl", "artistic": "artistic", "bsl": "bsl", "eupl": "eupl", "osl": "osl", "afl": "afl", "ecl": "ecl", "psf": "(psf|python)", "php": "php", "ofl": "ofl", "odbl": "odbl",
    "odc-by": "odc by", "ogl": "ogl( uk)?", "apsl": "apsl", "ipl": "ipl", "npl": "npl", "sspl": "sspl", "busl": "busl", "elastic": "elastic", "upl": "upl", "zpl": "zpl", "mulan": "mulanpsl",
    "cc-by": "cc by",
}

#: How far each kind of rule is trusted: priority 0 to 6.
CONFIDENCE = {0: 0.2, 1: 0.3, 2: 0.5, 3: 0.7, 4: 0.8, 5: 0.9, 6: 1.0}


def _spaced(words: str) -> str:
    """A regex over words parted by one space, as a regex over the spaced form."""
    text = words.replace(" ", "  ")
    # an optional space in a name ("share ?alike") stands for an optional word border
    return " " + text.replace("  ?", "(?:  )?").replace("(", "(?:").replace("(?:?:", "(?:") + " "


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, regex, priority), in order; made from FAMILIES by four shapes each, one
    more for each version, and from SIGNATURES and SINGLE."""
    out = [(label, keyword, _spaced(words), p) for label, keyword, words, p in SIGNATURES]
    for label, keyword, name, versions in FAMILIES:
        out.append((label, keyword, _spaced(name), 4))
        out.append((label, keyword, _spaced(f"(licensed|released|distributed|available|covered)( under)?( the)?( terms of)?( the)? {name}"), 5))
        identifier = SPDX.get(label)
        plain = f"({name}|{identifier})" if identifier and not versions else name
        out.append((label, "spdx", _spaced(f"spdx license identifier {plain}"), 6))
        if identifier:
            out += [(f"{label}-{v.replace(' ', '.')}", "spdx", _spaced(f"spdx license identifier {identifier} {v}( 0)?( only| or later)?"), 6) for v in versions]
        out += [(f"{label}-{v.replace(' ', '.')}", keyword, _spaced(f"{name}( international| unported| generic)?( version| v)? v?{v}"), 6) for v in versions]
    out += [(label, keyword, _spaced(words), p) for label, keyword, words, p in SINGLE]
    return out


def spaced_words(text: Column) -> Column:
    """Every word between two spaces; "" when there is no word."""
    whole = F.coalesce(text, F.lit(""))
    # only A-Z change; lower() is the quick way for texts without other letters
    lower = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))
    # after this, words are parted by two spaces; the ends have two or none
    inner = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


RUN = 256  #: steps after which a running list is set aside, so that it is never copied whole; even
MARK = "\x01"  #: stands in no spaced form
SPAN = "array<struct<a:int,b:int>>"


def _folded(items: Column, kind: str, start: Column, step, after) -> Column:
    """A fold over an array that gives a list: step(state, item) -> (state, list), over runs of
    RUN items; after(state, lists) shifts a run's list by the state before it."""
    def run(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(items, k, F.lit(RUN)), F.struct(acc["state"].alias("state"), F.array().cast(kind).alias("out")), step)
        return F.struct(part["state"].alias("state"), F.concat(acc["out"], F.array(part["out"])).alias("out"))

    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(starts, F.struct(start.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), run, after)


def _hits(s: Column, regex: Column) -> Column:
    """Intervals of characters [a, b) of a regex's matches in the spaced form s, in order."""
    # gap, match, gap, match ... gap
    pieces = F.split(F.regexp_replace(s, regex, F.lit(f"{MARK}$0{MARK}")), MARK)

    def step(acc: Column, piece: Column) -> Column:
        to = acc["state"]["at"] + F.length(piece)
        hit = acc["state"]["hit"]
        out = F.when(hit, F.concat(acc["out"], F.array(F.struct(acc["state"]["at"].alias("a"), to.alias("b"))))).otherwise(acc["out"])
        return F.struct(F.struct(to.alias("at"), (~hit).alias("hit")).alias("state"), out.alias("out"))

    found = _folded(pieces, SPAN, F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit")), step, lambda acc: F.flatten(acc["out"]))
    return F.when(F.regexp_like(s, regex), found).otherwise(F.array().cast(SPAN))


def _words_before(s: Column, offset: Column) -> Column:
    head = F.substring(s, F.lit(1), offset)
    return F.floor((F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))) / 2).cast("long")


def detections(s: Column) -> Column:
    """The detections of a spaced form that no other suppresses, in order of their start."""
    table = rules()
    groups: dict[str, list] = {}
    for i, (label, keyword, regex, priority) in enumerate(table):
        groups.setdefault(keyword, []).append(F.struct(F.lit(label).alias("label"), F.lit(regex).alias("regex"), F.lit(priority).alias("priority"), F.lit(i).alias("rule")))
    by_word = F.create_map(*[x for k, rs in groups.items() for x in (F.lit(k), F.array(*rs))])
    words = F.split(F.replace(F.trim(s), F.lit("  "), F.lit(" ")), " ")
    there = F.array_intersect(F.array(*map(F.lit, groups)), words)
    kind = "array<struct<label:string,priority:int,rule:int,a:int,b:int>>"
    tried = F.flatten(F.transform(there, lambda k: F.element_at(by_word, k)))
    found = F.flatten(F.transform(tried, lambda r: F.transform(_hits(s, r["regex"]), lambda h: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), r["rule"].alias("rule"), h["a"].alias("a"), h["b"].alias("b")))))
    # by start, the longer first, then by priority and place in the list: whatever contains a detection
    # and outranks it stands before it
    less = lambda x, y, f, down=False: F.when(x[f] != y[f], (y[f] - x[f]) if down else (x[f] - y[f]))
    ordered = F.array_sort(found, lambda x, y: F.coalesce(less(x, y, "a"), less(x, y, "b", True), less(x, y, "priority", True), x["rule"] - y["rule"]))
    tops = sorted(CONFIDENCE)
    # for each priority, how far detections of it or above it reach
    start = F.struct(*[F.lit(-1).alias(f"m{p}") for p in tops])

    def step(acc: Column, d: Column) -> Column:
        state = acc["state"]
        reach = F.element_at(F.array(*[state[f"m{p}"] for p in tops]), d["priority"] + 1)
        wider = F.struct(*[F.greatest(state[f"m{p}"], F.when(d["priority"] >= p, d["b"]).otherwise(F.lit(-1))).alias(f"m{p}") for p in tops])
        return F.struct(wider.alias("state"), F.when(reach < d["b"], F.concat(acc["out"], F.array(d))).otherwise(acc["out"]).alias("out"))

    kept = _folded(ordered, kind, start, step, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(there) == 0, F.array().cast(kind)).otherwise(kept)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections; and the
    detections themselves (label, priority, rule, characters of the spaced form) if spans are
    wanted."""
    tops = sorted(CONFIDENCE)
    s = F.col("_s")
    df = docs.select(F.col(id_col).alias("doc_id"), spaced_words(F.col(text_col)).alias("_s"))
    df = df.withColumn("n_words", F.floor((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("long"))
    df = df.withColumn("_kept", detections(s))
    base = [(label, _hits(s, F.lit(" " + "  ".join(words.split()) + " ")), s.contains(" " + "  ".join(words.split()) + " ")) for words, label in BASE.items()]
    for i, (_, hits, there) in enumerate(base):
        df = df.withColumn(f"_b{i}", F.when(there, F.transform(hits, lambda h: h["a"])).otherwise(F.array().cast("array<int>")))
    places = F.concat(*[F.col(f"_b{i}") for i in range(len(base))])
    df = df.withColumn("_places", places)
    names = F.array_compact(F.array(*[F.when(F.size(f"_b{i}") > 0, F.lit(label)) for i, (label, _, _) in enumerate(base)]))
    df = df.withColumn("_names", names)
    weight = F.array(*[F.lit(CONFIDENCE[p]) for p in tops])
    return df.select(
        "doc_id", "n_words", F.size("_places").cast("long").alias("n_base"),
        F.when(F.size("_places") > 0, _words_before(s, F.array_min("_places"))).alias("first_word"),
        F.when(F.size("_places") > 0, _words_before(s, F.array_max("_places"))).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_names")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_names", F.transform("_kept", lambda d: d["label"])))), ",").alias("labels"),
        F.coalesce(F.array_max(F.concat(F.transform("_kept", lambda d: F.element_at(weight, d["priority"] + 1)), F.transform("_names", lambda _: F.lit(0.5)))), F.lit(0.0)).alias("score"),
        F.size("_kept").cast("long").alias("n_detections"), *([F.col("_kept").alias("detections")] if spans else []),
    )


def oracle() -> str:
    """The same rows in DuckDB: detections as a table, suppression as a self anti-join."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {q(label)}, {q(f' {k} ')}, {q(rx)}, {p})" for i, (label, k, rx, p) in enumerate(rules()))
    base = ", ".join(f"({q(label)}, {q(' ' + '  '.join(words.split()) + ' ')})" for words, label in BASE.items())
    conf = " ".join(f"WHEN {p} THEN {c}" for p, c in CONFIDENCE.items())
    return f"""
WITH rules(i, label, keyword, regex, priority) AS (VALUES {values}),
base(label, phrase) AS (VALUES {base}),
w AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g'), ' ') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS s FROM w),
b0 AS (SELECT doc_id, label, phrase, unnest(string_split(s, phrase)) AS gap, generate_subscripts(string_split(s, phrase), 1) AS k, len(string_split(s, phrase)) AS n FROM s JOIN base ON contains(s, phrase)),
b1 AS (SELECT doc_id, label, k, n, sum(length(gap) - length(replace(gap, ' ', ''))) OVER (PARTITION BY doc_id, label ORDER BY k) AS before, length(phrase) - length(replace(phrase, ' ', '')) AS own FROM b0),
b AS (SELECT doc_id, label, ((before + (k - 1) * own) // 2)::BIGINT AS place FROM b1 WHERE k < n),
bb AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM b GROUP BY doc_id),
h0 AS (SELECT doc_id, i, label, priority, regexp_extract_all(s, regex) AS m, string_split_regex(s, regex) AS g FROM s JOIN rules ON contains(s, keyword)),
h1 AS (SELECT doc_id, i, label, priority, unnest(m) AS m, unnest(g[:len(m)]) AS g, generate_subscripts(m, 1) AS k FROM h0 WHERE len(m) > 0),
h2 AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, i ORDER BY k) AS b FROM h1),
h AS (SELECT doc_id, i, label, priority, b - length(m) AS a, b FROM h2),
kept AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND o.a <= h.a AND o.b >= h.b AND (o.priority > h.priority OR o.priority = h.priority AND (o.b - o.a > h.b - h.a OR o.b - o.a = h.b - h.a AND o.i < h.i)))),
names AS (SELECT doc_id, label, 0.5 AS c, 0 AS d, 1 AS isbase FROM b UNION ALL SELECT doc_id, label, CASE priority {conf} END, 1, 0 FROM kept),
agg AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (isbase = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c)::DOUBLE AS score, sum(d)::BIGINT AS n_detections FROM names GROUP BY doc_id)
SELECT s.doc_id, ((length(s) - length(replace(s, ' ', ''))) // 2)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_detections, 0)::BIGINT AS n_detections
FROM s LEFT JOIN bb USING (doc_id) LEFT JOIN agg USING (doc_id)"""
