"""Hand-written signatures of licenses, as patterns of words.

A pattern is a row of tokens, each a regular expression for one whole word; ``(token)`` may be missing, ``*3``
stands for up to three words of any kind. Words are lower-cased runs of letters and digits, so that "Apache-2.0" is ``apache 2 0``.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Fixed values of the base: label and words.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

LI = "licen[cs]e"
#: Priorities: an identifier, a notice or sentence of the license's text, a name, a clue.
IDENTIFIER, NOTICE, NAME, CLUE = 4, 3, 2, 1
#: What a detection of each priority says about the document.
WEIGHT = {IDENTIFIER: 1.0, NOTICE: 0.9, NAME: 0.75, CLUE: 0.5}

#: Licenses with one form: label, identifiers, names.
PLAIN: tuple[tuple[str, str, str], ...] = (
    ("mit", "mit", f"mit {LI}, mit x11 {LI}, expat {LI}"),
    ("mit-0", "mit 0", "mit no attribution"),
    ("isc", "isc", f"isc {LI}, internet systems consortium {LI}"),
    ("bsd", "bsd", f"bsd {LI}, bsd style {LI}, berkeley software distribution"),
    ("bsd-zero-clause", "0bsd", "zero clause bsd, 0 clause bsd"),
    ("bsd-2-clause", "bsd 2 clause, bsd 2 clause freebsd", f"two clause bsd, 2 clause bsd, simplified bsd {LI}, freebsd {LI}"),
    ("bsd-3-clause", "bsd 3 clause, bsd 3 clause clear", f"three clause bsd, 3 clause bsd, new bsd {LI}, modified bsd {LI}, revised bsd {LI}"),
    ("bsd-4-clause", "bsd 4 clause", f"four clause bsd, 4 clause bsd, original bsd {LI}, old bsd {LI}"),
    ("unlicense", "unlicense", "the unlicense"),
    ("wtfpl", "wtfpl", f"wtfpl, do what the fuck you want to public {LI}"),
    ("zlib", "zlib", f"zlib {LI}, zlib libpng {LI}"),
    ("libpng", "libpng, libpng 2 0", f"libpng {LI}, png reference library {LI}"),
    ("x11", "x11", f"x11 {LI}, x consortium {LI}"),
    ("ncsa", "ncsa", f"university of illinois ncsa open source {LI}, ncsa open source {LI}"),
    ("postgresql", "postgresql", f"postgresql {LI}"),
    ("sleepycat", "sleepycat", f"sleepycat {LI}, sleepycat public {LI}"),
    ("openssl", "openssl", f"openssl {LI}, ssleay {LI}"),
    ("beerware", "beerware", f"beer ware {LI}, beerware {LI}"),
    ("vim", "vim", f"vim {LI}"),
    ("curl", "curl", f"curl {LI}"),
    ("ijg", "ijg", f"independent jpeg group {LI}"),
    ("freetype", "ftl", f"freetype {LI}, freetype project {LI}"),
    ("tcl", "tcl", f"tcl tk {LI}, tcl {LI}"),
    ("icu", "icu", f"icu {LI}"),
    ("unicode", "unicode dfs 2015, unicode dfs 2016, unicode 3 0", f"unicode {LI}, unicode inc {LI} agreement"),
    ("w3c", "w3c, w3c 20150513", f"w3c software notice and {LI}, w3c software {LI}, w3c {LI}"),
    ("ruby", "ruby", f"ruby {LI}"),
    ("qpl", "qpl 1 0", f"q public {LI}"),
    ("ms-pl", "ms pl", f"microsoft public {LI}"),
    ("ms-rl", "ms rl", f"microsoft reciprocal {LI}"),
    ("json", "json", f"json {LI}"),
    ("hpnd", "hpnd", "historical permission notice and disclaimer"),
    ("fair", "fair", f"fair {LI}"),
    ("naumen", "naumen", f"naumen public {LI}"),
    ("nokia", "nokia", f"nokia open source {LI}"),
    ("intel", "intel", f"intel open source {LI}"),
    ("bitstream-vera", "bitstream vera", f"bitstream vera fonts copyright, bitstream vera {LI}"),
    ("pddl", "pddl 1 0", f"public domain dedication and {LI}, pddl"),
    ("odc-by", "odc by 1 0", f"open data commons attribution {LI}"),
    ("cc0-1.0", "cc0 1 0", f"cc0, creative commons zero, cc zero, cc0 universal"),
    ("commons-clause", "commons clause", f"commons clause {LI} condition, commons clause"),
    ("polyform-noncommercial", "polyform noncommercial 1 0 0", f"polyform noncommercial {LI}"),
    ("polyform-small-business", "polyform small business 1 0 0", f"polyform small business {LI}"),
    ("hippocratic", "hippocratic 2 1", f"hippocratic {LI}"),
    ("openrail", "openrail", f"open rail m {LI}, openrail {LI}, openrail m {LI}, responsible ai {LI}"),
    ("proprietary", "proprietary", f"proprietary {LI}, commercial {LI}, end user {LI} agreement"),
)

#: Licenses with versions: label, identifier, names, versions.
VERSIONED: tuple[tuple[str, str, str, str], ...] = (
    ("apache", "apache", f"apache (software) {LI}, asl", "1.0 1.1 2.0"),
    ("gpl", "gpl", f"gnu general public {LI}, gnu gpl, gplv?, general public {LI}", "1.0 2.0 3.0"),
    ("lgpl", "lgpl", f"gnu (lesser|library) general public {LI}, lesser general public {LI}, library general public {LI}, gnu lgpl, lgplv?", "2.0 2.1 3.0"),
    ("agpl", "agpl", f"gnu affero general public {LI}, affero general public {LI}, gnu agpl, agplv?", "1.0 3.0"),
    ("gfdl", "gfdl", f"gnu free documentation {LI}, free documentation {LI}, gnu fdl, gfdlv?", "1.1 1.2 1.3"),
    ("mpl", "mpl", f"mozilla public {LI}, mplv?", "1.0 1.1 2.0"),
    ("npl", "npl", f"netscape public {LI}", "1.0 1.1"),
    ("epl", "epl", f"eclipse public {LI}, eplv?", "1.0 2.0"),
    ("cddl", "cddl", f"common development and distribution {LI}, cddl", "1.0 1.1"),
    ("cpl", "cpl", f"common public {LI}", "1.0"),
    ("ipl", "ipl", f"ibm public {LI}", "1.0"),
    ("eupl", "eupl", f"european union public {LI}, eupl", "1.0 1.1 1.2"),
    ("apsl", "apsl", f"apple public source {LI}", "1.0 1.1 1.2 2.0"),
    ("artistic", "artistic", f"artistic {LI}, perl artistic {LI}", "1.0 2.0"),
    ("afl", "afl", f"academic free {LI}", "1.1 1.2 2.0 2.1 3.0"),
    ("osl", "osl", f"open software {LI}", "1.0 1.1 2.0 2.1 3.0"),
    ("cecill", "cecill", f"cecill {LI}, cecill free software {LI} agreement", "1.0 1.1 2.0 2.1"),
    ("lppl", "lppl", f"latex project public {LI}, lppl", "1.0 1.1 1.2 1.3"),
    ("ofl", "ofl", f"sil open font {LI}, open font {LI}", "1.0 1.1"),
    ("boost", "bsl", f"boost software {LI}", "1.0"),
    ("busl", "busl", f"business source {LI}", "1.1"),
    ("sspl", "sspl", f"server side public {LI}, sspl", "1.0"),
    ("elastic", "elastic", f"elastic {LI}", "1.0 2.0"),
    ("odbl", "odbl", f"open database {LI}, odc open database {LI}, odbl", "1.0"),
    ("python", "psf, python", f"python software foundation {LI}, psf {LI}, python {LI}", "2.0"),
    ("php", "php", f"php {LI}", "3.0 3.01"),
    ("zpl", "zpl", f"zope public {LI}", "1.1 2.0 2.1"),
    ("llama", "llama", f"llama community {LI} agreement, llama community {LI}", "2.0 3.0 3.1"),
    ("cc-by", "cc by", f"creative commons attribution {LI}, creative commons attribution, cc by", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "cc by sa", f"creative commons attribution share|sharealike (alike), cc by sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "cc by nd", f"creative commons attribution no derivatives, creative commons attribution noderivatives, cc by nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "cc by nc", f"creative commons attribution non commercial, creative commons attribution noncommercial, cc by nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "cc by nc sa", f"creative commons attribution noncommercial sharealike, creative commons attribution non commercial share alike, cc by nc sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "cc by nc nd", f"creative commons attribution noncommercial noderivatives, creative commons attribution non commercial no derivatives, cc by nc nd", "1.0 2.0 2.5 3.0 4.0"),
)

#: Sentences of license texts and notices without a name.
SENTENCES: tuple[tuple[str, int, str], ...] = (
    ("mit", NOTICE, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", NOTICE, "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", NOTICE, "permission to use copy modify and|or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", NOTICE, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", NOTICE, "redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", NOTICE, "neither the names? of *8 nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", NOTICE, "all advertising materials mentioning features or use of this software must display"),
    ("zlib", NOTICE, "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("apache-2.0", NOTICE, "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", NOTICE, "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("gpl", NOTICE, "this program is free software you can redistribute it and or modify it under the terms"),
    ("gpl", CLUE, "you should have received a copy of the gnu *2 general public licen[cs]e"),
    ("lgpl", NOTICE, "this library is free software you can redistribute it and or modify it under the terms"),
    ("mpl-2.0", NOTICE, "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("boost-1.0", NOTICE, "to use reproduce display distribute execute and transmit the software and to prepare derivative works"),
    ("unlicense", NOTICE, "this is free and unencumbered software released into the public domain"),
    ("wtfpl", NOTICE, "you just do what the fuck you want to"),
    ("json", NOTICE, "the software shall be used for good not evil"),
    ("beerware", NOTICE, "you can buy me a beer in return"),
    ("cc0-1.0", NOTICE, "waived all copyright and related or neighboring rights"),
    ("public-domain", NAME, "(is|are|in) (released) (placed) (into) (the) public domain"),
    ("public-domain", NOTICE, "dedicated|released|placed|published (to|in|into) the public domain"),
    ("all-permissive", NOTICE, "copying and distribution of this file with or without modification are permitted in any medium"),
    ("proprietary", NOTICE, "no part of this *3 may be reproduced"),
    ("proprietary", NOTICE, "may not be reproduced *6 without *3 written permission"),
    ("proprietary", NOTICE, "reproduction *4 without *2 permission is *2 prohibited"),
    ("proprietary", NOTICE, "unauthori[sz]ed copying *6 prohibited"),
    ("proprietary", NOTICE, "proprietary and confidential"),
    ("proprietary", NOTICE, "confidential and proprietary"),
    ("proprietary", CLUE, "trade secrets? of"),
    ("noncommercial", NOTICE, "noncommercial (use) (purposes) only"),
    ("noncommercial", CLUE, "licen[cs]ed *3 noncommercial use"),
    ("warranty-disclaimer", CLUE, "without warrant[a-z]+ of any kind"),
    ("warranty-disclaimer", CLUE, "provided as is without *2 warranty"),
    ("copyright", CLUE, "copyright (c) (?:19|20)[0-9]{2}"),
    ("copyright", CLUE, "copyright © (?:19|20)[0-9]{2}"),
    ("unknown-license", CLUE, "licen[cs]ed under (the) (terms) (of)"),
    ("unknown-license", CLUE, f"released under (the) (terms) (of) *3 {LI}"),
    ("unknown-license", CLUE, f"distributed under (the) (terms) (of) *3 {LI}"),
    ("unknown-license", CLUE, f"see (the) {LI} file"),
    ("unknown-license", CLUE, f"{LI} agreement"),
    ("permission", CLUE, "used (with) by permission of"),
)

#: Words of patterns that ordinary texts hold; a rule is looked for by another of its words where it has one.
COMMON = frozenset(
    "a an the of to in is are be by and or as it its if no not nor any all may must for with without from this that these you your we me can do just what such other under only used use see "
    "mit sa nd nc q open public general free software source code community common data ai m n inc style new old simple zero two three four 0 1 2 3 4 5 10 15 16 2015 2016 2020 2021 20150513 "
    "version terms term small business fair intel tk agreement project group file files copy copies program library work works product products kind return user reference received provided original subject".split()
)


class Rule(NamedTuple):
    label: str
    priority: int
    word: str
    keyword: str
    pattern: str


def _literal(token: str) -> tuple[str, bool]:
    """The plain letters a token begins with, and whether they are all of it."""
    found = re.match(r"[a-z0-9]+", token)
    if token[:1] in "(*" or not found or "|" in token:
        return "", False
    rest = token[found.end() :]
    return (found[0], True) if not rest else (found[0][:-1] if rest[0] in "?*{" else found[0], False)


def word(pattern: str) -> str:
    """The word, ``license`` for both spellings, by which texts that may match are found: the longest that is not common, ``license`` only if there is no other."""
    plain = [_literal(t)[0] for t in pattern.replace(LI, "license").split() if _literal(t)[1]]
    return max(plain, key=lambda w: (w not in COMMON, w != "license", len(w)))


def keyword(pattern: str) -> str:
    """The longest text without a choice that every match holds, words separated by blanks; it begins with a word."""
    runs, run = [], ""
    for token in [*pattern.split(), "(end)"]:
        text, whole = _literal(token)
        run += text + " " * whole
        if not whole:
            runs.append(" " + run)
            run = ""
    return max(runs, key=len)


def expression(pattern: str) -> str:
    """Regular expression over numbered words, each written as `` word#7;``; read alike by Java and RE2."""
    out = []
    for token in pattern.split():
        if re.fullmatch(r"\*\d+", token):
            out.append(f"(?: [^#]+#[0-9]+;){{0,{token[1:]}}}")
        elif re.fullmatch(r"\((?!\?:.*\)\?).*\)", token):
            out.append(f"(?: (?:{token[1:-1]})#[0-9]+;)?")
        else:
            out.append(f" (?:{token})#[0-9]+;")
    return "".join(out)


#: What may stand before a name and belongs to the same detection.
LEAD = "(?:re)?licen[cs]ed|released|distributed|available|published|provided"


def _forms(label: str, ids: list[str], names: list[str]) -> list[tuple[str, int, str]]:
    found = [(label, IDENTIFIER, f"spdx {LI} identifier {i}") for i in ids]
    return found + [(label, NAME, f"({LEAD}) (under) (the) (terms) (of) (the|a|an) {n}") for n in names]


def _rules() -> list[Rule]:
    found = [(label, CLUE, words) for label, words in BASE]
    for label, ids, names in PLAIN:
        found += _forms(label, ids.split(", "), names.split(", "))
    for label, ids, names, versions in VERSIONED:
        plain = [n for n in names.split(", ") if not n.endswith("v?")]
        found += _forms(label, ids.split(", "), plain)
        for version in versions.split():
            major, minor = version.split(".")
            tail = f"v?{major} ({minor})" if minor == "0" else f"v?{major} {minor}"
            named = [f"{n} (version) {tail}" for n in plain] + [f"{n[:-2]} v?{tail[2:]}" for n in names.split(", ") if n.endswith("v?")]
            named += [f"{n[:-1]}{tail[2:]}" for n in names.split(", ") if n.endswith("v?")]
            found += _forms(f"{label}-{version}", [f"{i} {major} {minor}" for i in ids.split(", ")], named)
    found += SENTENCES
    return [Rule(label, priority, word(p), keyword(p), expression(p)) for label, priority, p in dict.fromkeys(found)]


#: All signatures in order; the first ones are those of the base.
RULES = _rules()
