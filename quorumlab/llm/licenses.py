"""Licence scans by sentence rules, in DataFrame functions alone: sentences become identifiers,
sequences of identifiers become licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What a sentence holds that is worth a look at all.
CUE = "licen[cs]e|copyright|copyleft|warrant|permission|redistribut|all rights reserved|public domain|creative commons|cc by|cc0|liab|gnu .*general public|spdx|endorse|without fee"

#: Identifier and pattern of each known sentence, in order; the first that occurs in a normalised sentence names it.
SENTENCES = [
    ("NEGATED", "(not|never|no longer) (be |been )?(released|licensed|distributed|available) under"),
    ("APACHE2_NAMED", "licensed under the apache license,? version 2[.]0"),
    ("APACHE2_COPY", "you may obtain a copy of the license at"),
    ("APACHE2_COMPLY", "you may not use this file except in compliance with the license"),
    ("APACHE2_ASIS", "software distributed under the license is distributed on an \"?as is\"? basis"),
    ("APACHE2_SEE", "see the license for the specific language governing permissions"),
    ("AGPL3_LATER", "gnu affero general public license,? (as published by the free software foundation,? (either )?)?version 3.*or .*any later version"),
    ("LGPL3_LATER", "gnu lesser general public license,? (as published by the free software foundation,? (either )?)?version 3.*or .*any later version"),
    ("LGPL21_LATER", "gnu lesser general public license,? (as published by the free software foundation,? (either )?)?version 2[.]1.*or .*any later version"),
    ("AGPL3_NAMED", "gnu affero general public license,? (as published by the free software foundation,? (either )?)?version 3"),
    ("LGPL3_NAMED", "gnu lesser general public license,? (as published by the free software foundation,? (either )?)?version 3"),
    ("LGPL21_NAMED", "gnu lesser general public license,? (as published by the free software foundation,? (either )?)?version 2[.]1"),
    ("GPL3_LATER", "gnu general public license as published by the free software foundation, (either )?version 3.*or .*any later version"),
    ("GPL2_LATER", "gnu general public license as published by the free software foundation, (either )?version 2.*or .*any later version"),
    ("GPL3_NAMED", "gnu general public license,? (as published by the free software foundation,? )?version 3"),
    ("GPL2_NAMED", "gnu general public license,? (as published by the free software foundation,? )?version 2"),
    ("GPL_HOPE", "distributed in the hope that it will be useful,? but without any warranty"),
    ("GPL_SEE", "see the gnu (lesser |affero )?general public license for more details"),
    ("GPL_COPY", "you should have received a copy of the gnu (lesser |affero )?general public license"),
    ("MIT_NAMED", "(released|licensed|distributed|available) under the (terms of the )?mit license"),
    ("MIT_GRANT", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT_NOTICE", "the above copyright notice and this permission notice shall be included in all copies"),
    ("ISC_GRANT", "permission to use, copy, modify,? and(/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD_GRANT", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD_SOURCE", "redistributions of source code must retain the above copyright notice"),
    ("BSD_BINARY", "redistributions in binary form must reproduce the above copyright notice"),
    ("BSD_ADVERT", "all advertising materials mentioning features or use of this software must display"),
    ("BSD_ENDORSE", "may be used to endorse or promote products derived from this software"),
    ("BSD_NAMED", "(released|licensed|distributed|available) under the (terms of the )?(new |modified |simplified )?bsd license"),
    ("ASIS", "(software is provided|is provided by the .*) \"?as is\"?"),
    ("LIABILITY", "in no event shall .* be liable"),
    ("MPL2_NAMED", "subject to the terms of the mozilla public license,? v[.]? ?2[.]0"),
    ("MPL2_COPY", "if a copy of the mpl was not distributed with this file"),
    ("CC0", "cc0 1[.]0|creative commons zero|cc0 public domain"),
    ("CC=CC-BY-NC-SA", "(cc by-nc-sa|creative commons attribution-noncommercial-sharealike)"),
    ("CC=CC-BY-NC-ND", "(cc by-nc-nd|creative commons attribution-noncommercial-noderiv[a-z]*)"),
    ("CC=CC-BY-NC", "(cc by-nc|creative commons attribution-noncommercial)"),
    ("CC=CC-BY-SA", "(cc by-sa|creative commons attribution-sharealike)"),
    ("CC=CC-BY-ND", "(cc by-nd|creative commons attribution-noderiv[a-z]*)"),
    ("CC=CC-BY", "(cc by|creative commons attribution)"),
    ("UNLICENSE", "this is free and unencumbered software released into the public domain"),
    ("PUBLIC_DOMAIN", "(released|placed|dedicated) (in|into|to) the public domain"),
    ("RESERVED", "all rights reserved"),
    ("COPYRIGHT", "copyright (\\(c\\)|©|[0-9]{4})|© ?[0-9]{4}"),
]

#: Licence and the sequence of identifiers that makes it, in the order in which they are tried:
#: x? may be missing; sentences that no pattern knows may lie between and then belong to the notice.
#: What a rule has matched no later rule sees.
RULES = [
    ("Apache-2.0", "APACHE2_NAMED APACHE2_COMPLY? APACHE2_COPY? APACHE2_ASIS? APACHE2_SEE?"),
    ("AGPL-3.0-or-later", "AGPL3_LATER GPL_HOPE? GPL_SEE? GPL_COPY?"),
    ("LGPL-3.0-or-later", "LGPL3_LATER GPL_HOPE? GPL_SEE? GPL_COPY?"),
    ("LGPL-2.1-or-later", "LGPL21_LATER GPL_HOPE? GPL_SEE? GPL_COPY?"),
    ("AGPL-3.0", "AGPL3_NAMED GPL_HOPE? GPL_SEE? GPL_COPY?"),
    ("LGPL-3.0", "LGPL3_NAMED GPL_HOPE? GPL_SEE? GPL_COPY?"),
    ("LGPL-2.1", "LGPL21_NAMED GPL_HOPE? GPL_SEE? GPL_COPY?"),
    ("GPL-3.0-or-later", "GPL3_LATER GPL_HOPE? GPL_SEE? GPL_COPY?"),
    ("GPL-2.0-or-later", "GPL2_LATER GPL_HOPE? GPL_SEE? GPL_COPY?"),
    ("GPL-3.0", "GPL3_NAMED GPL_HOPE? GPL_SEE? GPL_COPY?"),
    ("GPL-2.0", "GPL2_NAMED GPL_HOPE? GPL_SEE? GPL_COPY?"),
    ("MIT", "MIT_NAMED? MIT_GRANT MIT_NOTICE ASIS? LIABILITY?"),
    ("MIT", "MIT_NAMED"),
    ("ISC", "ISC_GRANT ASIS? LIABILITY?"),
    ("BSD-4-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_ADVERT BSD_ENDORSE? ASIS? LIABILITY?"),
    ("BSD-3-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_ENDORSE ASIS? LIABILITY?"),
    ("BSD-2-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY ASIS? LIABILITY?"),
    ("BSD", "BSD_NAMED"),
    ("MPL-2.0", "MPL2_NAMED MPL2_COPY?"),
    ("CC0-1.0", "CC0"),
    ("Unlicense", "UNLICENSE ASIS? LIABILITY?"),
    ("Public-Domain", "PUBLIC_DOMAIN"),
    ("All-Rights-Reserved", "COPYRIGHT? RESERVED"),
]

#: An identifier for a sentence with a cue that no pattern knows.
UNKNOWN = "UNKNOWN"
#: The version of a Creative Commons licence behind its name.
CC_VERSION = "(?:cc by[a-z-]*|creative commons attribution[a-z-]*)(?: [a-z]+)? ?v?([1-4][.][05])"
#: Identifiers that a tag's expression may name; what else is there (AND, OR, WITH and its exception, parentheses) isn't one. Fixed values.
SPDX_TAG = "spdx-license-identifier:"
SPDX_IDS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 "
    "CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 "
    "GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC "
    "LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA OFL-1.1 OSL-3.0 "
    "PostgreSQL Python-2.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
#: Ends of sentences: marks before white space, empty lines, and the starts of bullets.
SENTENCE_END = "[.!?;:]+[ \t\r\n]+|\n[ \t\r]*\n|\n[ \t]*[-*#/]+[ \t]"
NOISE = "[ \t\r\n*#/|>]+"

#: What else the patterns can begin from: sentences with these alone are named by a pattern or left out, never UNKNOWN.
MORE_CUES = "as is|of the mpl|advertising materials|©"
#: Signs of a comment at the start of a line. A star is one only behind a space (as in a block of stars), else a bullet;
#: ## is a heading.
COMMENT_START = "(?m)^(?:[ \\t]*(?:/[*]+!?|[*]+/|//+!?|#(?!#)|--+(?=[ \\t])|;+(?=[ \\t])|%+(?=[ \\t])|<!--|(?:rem|dnl)(?=[ \\t]))|(?:    |\\t)* [*]+(?=[ \\t\\r\\n]|$))"
#: Replacements before sentences are cut, in order; \\x01 is the start of a comment line, \\x02 a space that ends no sentence.
PREPARED = [
    ("[\\x01\\x02]", " "),
    (COMMENT_START, "\x01"),
    ("\\x01[ \\t\\r]*(?=\\n|$)", ""),  # a comment line without text is an empty line
    ("spdx-license-identifier:[ \\t]*([^\\n]*)", "\n\nspdx-license-identifier:\x02$1\n\n"),
    ("(\\x01[^\\n\\x01]*)\\n(?=\\x01)", "$1 "),  # a wrapped comment is one text
    ("\\n\\x01", "\n\n"),
    (" ?\\x01", " "),
    (";(?=[ \\t\\r\\n]+(?:either[ \\t\\r\\n]+)?version[ \\t\\r\\n]+[0-9])", ","),  # Foundation; either version 2
    ("\\band/or\\b", "and"),  # NOISE takes the stroke
    ("\\bv[.][ \\t\\r\\n]+(?=[0-9])", "v."),
]


def rule_pattern(rule: str) -> str:
    """The regular expression of a rule over identifiers that each have a space on both sides."""
    between, parts, found = f"(?: {UNKNOWN} )*", [], False
    for x in rule.split():
        if found:
            parts.append(f"(?:{between} {x[:-1]} )?" if x.endswith("?") else f"{between} {x} ")
        else:  # unknown sentences before the first one aren't of the notice
            parts.append(f"(?: {x[:-1]} {between})?" if x.endswith("?") else f" {x} ")
            found = not x.endswith("?")
    return "".join(parts)


def tagged_licences(sentence: Column) -> Column:
    """SPDX=a,b of a tag's expression: its identifiers in order, each once; a + behind one means or later. UNKNOWN if it has none."""
    ids = {x.lower(): x for x in SPDX_IDS}
    ids |= {x.lower().removesuffix("-or-later") + "+": x for x in SPDX_IDS if x.endswith("-or-later")}
    known = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    words = F.transform(F.split(F.substring_index(sentence, SPDX_TAG, -1), "[^a-z0-9.+-]+"), lambda w: F.regexp_replace(w, "[.]+$", ""))
    found = F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, F.concat(F.lit("SPDX="), F.array_join(found, ","))).otherwise(F.lit(UNKNOWN))


def sentence_identifier(sentence: Column) -> Column:
    out = F.when(sentence.contains(SPDX_TAG), tagged_licences(sentence))
    version = F.regexp_extract(sentence, CC_VERSION, 1)
    for name, pattern in SENTENCES:
        named = F.concat(F.lit(name), F.when(version != "", F.concat(F.lit("-"), version)).otherwise(F.lit(""))) if name.startswith("CC=") else F.lit(name)
        out = out.when(sentence.rlike(pattern), named)
    return out.when(sentence.rlike(CUE), F.lit(UNKNOWN))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentences, licenses, unmatched) of each whole text.

    Lower-cased text loses its comment signs, wrapped comments are joined, and it is cut into
    sentences (an SPDX tag's line is one, and names the identifiers of its expression); these are normalised (runs of white space and signs
    become one space), and those with a licence cue are named. `sentences` holds the names in
    order; `licenses` those that the rules make of them, in order of the text, repeats included,
    joined by |; `unmatched` counts the names that no rule took; a sentence that denies a licence names none. Null and empty texts have none
    (empty strings, 0); very long texts are read whole. One pass without a shuffle; rows repeat as they come, other columns are ignored; an empty table gives no rows.
    """
    lower = F.lower(F.coalesce(F.col("text"), F.lit("")))
    text = lower
    for pattern, by in PREPARED:
        text = F.regexp_replace(text, pattern, by)
    normal = F.transform(F.split(text, SENTENCE_END), lambda s: F.regexp_replace(s, NOISE.replace("[", "[\x02"), " "))
    cued = F.filter(normal, lambda s: s.rlike(f"{CUE}|{MORE_CUES}"))
    names = F.filter(F.transform(cued, sentence_identifier), lambda x: x.isNotNull())
    # A text without a cue has no sentence to name; where a cue has a space, signs and line breaks may be between its words.
    names = F.when(lower.rlike("(?s)" + f"{CUE}|{MORE_CUES}".replace(" ", "[^a-z0-9]+")), names).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", names.alias("names"))
    sequence = F.concat(F.lit(" "), F.array_join("names", "  "), F.lit(" "))
    for licence, rule in RULES:
        sequence = F.regexp_replace(sequence, rule_pattern(rule), f" <{licence}> ")
    found = found.select("doc_id", "names", F.when(F.size("names") > 0, sequence).otherwise(F.lit("")).alias("sequence"))
    marks = F.filter(F.split("sequence", " +"), lambda x: x != "")
    found = found.select("doc_id", "names", marks.alias("marks"))
    is_licence = lambda x: x.rlike("^(<|SPDX=|CC=)")
    licences = F.flatten(F.transform(F.filter("marks", is_licence), lambda x: F.split(F.regexp_replace(x, "[<>]|^(SPDX|CC)=", ""), ",")))
    return found.select(
        "doc_id",
        F.size("names").alias("n_sentences"),
        F.array_join("names", " ").alias("sentences"),
        F.array_join(licences, "|").alias("licenses"),
        F.size(F.filter("marks", lambda x: ~is_licence(x))).alias("unmatched"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The scan of `documents` in DuckDB's SQL, without PREPARED and MORE_CUES: equal where no text has
    comments, SPDX tags, notices with a mark inside, or sentences with one of MORE_CUES alone."""
    version = f"CASE WHEN regexp_extract(s, {_quoted(CC_VERSION)}, 1) <> '' THEN '-' || regexp_extract(s, {_quoted(CC_VERSION)}, 1) ELSE '' END"
    cases = " ".join(f"WHEN regexp_matches(s, {_quoted(p)}) THEN {_quoted(n)}{' || ' + version if n.startswith('CC=') else ''}" for n, p in SENTENCES)
    sequence = "' ' || array_to_string(names, '  ') || ' '"
    for licence, rule in RULES:
        sequence = f"regexp_replace({sequence}, {_quoted(rule_pattern(rule))}, ' <{licence}> ', 'g')"
    return f"""
WITH cut AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), {_quoted(SENTENCE_END)}), lambda s: regexp_matches(s, {_quoted(CUE)})) AS cued
  FROM documents),
named AS (
  SELECT doc_id, list_transform(list_transform(cued, lambda s: regexp_replace(s, {_quoted(NOISE)}, ' ', 'g')), lambda s: CASE {cases} ELSE '{UNKNOWN}' END) AS names
  FROM cut),
marked AS (
  SELECT doc_id, names, CASE WHEN len(names) > 0 THEN list_filter(string_split({sequence}, ' '), lambda x: x <> '') ELSE [] END AS marks
  FROM named)
SELECT doc_id, len(names)::INT AS n_sentences, coalesce(array_to_string(names, ' '), '') AS sentences,
  coalesce(array_to_string(list_transform(list_filter(marks, lambda x: regexp_matches(x, '^(<|CC=)')), lambda x: regexp_replace(x, '[<>]|^CC=', '', 'g')), '|'), '') AS licenses,
  len(list_filter(marks, lambda x: NOT regexp_matches(x, '^(<|CC=)')))::INT AS unmatched
FROM marked"""
