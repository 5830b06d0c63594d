"""Licence recognition by sentences and ordered rules, in DataFrame functions only.

A text is cut into sentences.  Sentences with a licence word are normalised and mapped to the identifier of a
known licence sentence, or to ``unknown``.  The document is then a sequence of identifiers; ordered rules replace
matching runs of identifiers by a licence, the more specific rule first, so that a sentence is used once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What ends a sentence: a mark before white space, a line that ends in neither letter, digit, comma nor bracket, a
# blank line.  Other line ends are wraps.
SENTENCE_END = r"[.!?;:][ \t\r\n]+|[^A-Za-z0-9,() \t\r\n][ \t\r]*\n|\n[ \t\r]*\n"
#: A sentence without any of these words is prose and has no identifier.
LICENCE_WORDS = "licen[cs]|copyright|all rights reserved|redistribut|warrant|permission|public domain|provided as is|liab|derivative|unlicense|provided that the following|copies or substantial|without restriction|endorse"
#: Words of known sentences that have none of these.
LICENCE_WORDS += "|required by applicable law|in the hope that it will be useful|any later version|copy of the mpl|legal epl|provided by .* as is|advertising materials mentioning|attribution (noncommercial|sharealike|noderivatives)|creative commons attribution|^c [0-9]{4}"

#: Known sentences: (identifier, pattern of whole words in the normalised sentence), the first that fits counts.
SENTENCES = (
    ("apache-2.0-grant", "licensed under the apache license version 2 0"),
    ("apache-1.1-grant", "(licensed under the )?apache software license version 1 1"),
    ("apache-comply", "you may not use this (file|work) except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-as-is", "unless required by applicable law or agreed to in writing"),
    ("apache-see", "see the license for the specific language governing permissions"),
    ("agpl-3-or-later", "gnu affero general public license( as published by the free software foundation)?( either)? version 3 (of the license )?or (at your option )?any later version"),
    ("agpl-3-grant", "gnu affero general public license( as published by the free software foundation)?( either)? version 3"),
    ("lgpl-2.1-or-later", "gnu lesser general public license( as published by the free software foundation)?( either)? version 2 1 (of the license )?or (at your option )?any later version"),
    ("lgpl-2.1-grant", "gnu lesser general public license( as published by the free software foundation)?( either)? version 2 1"),
    ("lgpl-3-or-later", "gnu lesser general public license( as published by the free software foundation)?( either)? version 3 (of the license )?or (at your option )?any later version"),
    ("lgpl-3-grant", "gnu lesser general public license( as published by the free software foundation)?( either)? version 3"),
    ("gpl-3-or-later", "gnu general public license( as published by the free software foundation)?( either)? version 3 (of the license )?or (at your option )?any later version"),
    ("gpl-3-grant", "gnu general public license( as published by the free software foundation)?( either)? version 3"),
    ("gpl-2-or-later", "gnu general public license( as published by the free software foundation)?( either)? version 2 (of the license )?or (at your option )?any later version"),
    ("gpl-2-grant", "gnu general public license( as published by the free software foundation)?( either)? version 2"),
    ("gpl-useful", "distributed in the hope that it will be useful"),
    ("gpl-see", "see the gnu (lesser |library |affero )?general public license for more details"),
    ("gpl-received", "you should have received a copy of the gnu (lesser |library |affero )?general public license"),
    ("gpl-fitness", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    # A semicolon before the version ends the sentence of the grant.
    ("agpl-grant", "gnu affero general public license( as published by the free software foundation)?$"),
    ("lgpl-grant", "gnu lesser general public license( as published by the free software foundation)?$"),
    ("library-grant", "gnu library general public license( as published by the free software foundation)?$"),
    ("gpl-grant", "gnu general public license( as published by the free software foundation)?$"),
    ("version-2.1-or-later", "^(either )?version 2 1 (of the license )?or (at your option )?any later version"),
    ("version-2-or-later", "^(either )?version 2 (of the license )?or (at your option )?any later version"),
    ("version-3-or-later", "^(either )?version 3 (of the license )?or (at your option )?any later version"),
    ("version-2.1", "^(only )?version 2 1 of the license"),
    ("version-2", "^(only )?version 2 of the license"),
    ("version-3", "^(only )?version 3 of the license"),
    ("or-later", "(either version|or) (at your option )?any later version"),
    # The full stop of "v. 2.0" ends a sentence; "source code form" is said from version 2.0 on.
    ("mpl-2.0-grant", "this source code form is subject to the terms of the mozilla public license v|subject to the terms of the mozilla public license (v|version) ?2 0"),
    ("mpl-copy", "if a copy of the mpl was not distributed with this file"),
    ("epl-2.0-grant", "(under|terms of) the( terms of the)? eclipse public license ((v|version) ?)?2 0"),
    ("epl-grant", "(under|terms of) the( terms of the)? eclipse public license v$"),
    ("epl-2.0-link", "^2 0 which (is available|accompanies this distribution and is available) at https? (www )?eclipse org legal epl (2 0|v20)"),
    ("mit-title", "(released under|licensed under|under) the mit license|^(the )?mit license$"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("as-is", "(software|it) is provided (by .*)?as is"),
    ("no-liability", "in no event shall .* be liable"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", "may be used to endorse or promote products"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0|attribution noncommercial sharealike 4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0|attribution noncommercial noderivatives 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0|attribution noncommercial 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0|attribution sharealike 4 0"),
    ("cc-by-nd-4.0", "cc by nd 4 0|attribution noderivatives 4 0"),
    ("cc-by-4.0", "cc by 4 0|creative commons attribution 4 0"),
    ("cc0-1.0", "cc0 1 0|cc0"),
    ("unlicense-grant", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "(in|into) the public domain"),
    ("all-rights-reserved", "all rights reserved"),
    ("copyright-notice", "^(c )?copyright( c)? [0-9]{4}|^c [0-9]{4}"),
)

_TAILS = (("gpl-useful", "gpl-fitness", "gpl-see", "gpl-received"), ("gpl-useful", "gpl-fitness", "gpl-see"), ())
#: A grant whose version stands in the same sentence, or in one of its own.
_GNU = (
    ("AGPL-3.0-or-later", ("agpl-3-or-later",)), ("AGPL-3.0-or-later", ("agpl-grant", "version-3-or-later")), ("AGPL-3.0-only", ("agpl-grant", "version-3")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-or-later",)), ("LGPL-2.1-or-later", ("lgpl-grant", "version-2.1-or-later")), ("LGPL-2.1-only", ("lgpl-grant", "version-2.1")),
    ("LGPL-3.0-or-later", ("lgpl-3-or-later",)), ("LGPL-3.0-or-later", ("lgpl-grant", "version-3-or-later")), ("LGPL-3.0-only", ("lgpl-grant", "version-3")),
    ("LGPL-2.0-or-later", ("library-grant", "version-2-or-later")), ("LGPL-2.0-only", ("library-grant", "version-2")),
    ("GPL-3.0-or-later", ("gpl-3-or-later",)), ("GPL-3.0-or-later", ("gpl-grant", "version-3-or-later")), ("GPL-3.0-only", ("gpl-grant", "version-3")),
    ("GPL-2.0-or-later", ("gpl-2-or-later",)), ("GPL-2.0-or-later", ("gpl-grant", "version-2-or-later")), ("GPL-2.0-only", ("gpl-grant", "version-2")),
)

#: Ordered rules: (licence, consecutive identifiers).
RULES = (
    *((licence, (*head, *tail)) for licence, head in _GNU for tail in _TAILS if head[1:] or tail),
    ("Apache-2.0", ("apache-2.0-grant", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-2.0-grant", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-2.0-grant",)),
    ("Apache-1.1", ("apache-1.1-grant",)),
    ("AGPL-3.0-or-later", ("agpl-3-or-later", "gpl-useful", "gpl-see", "gpl-received")),
    ("AGPL-3.0-or-later", ("agpl-3-or-later",)),
    ("AGPL-3.0-or-later", ("agpl-3-grant", "or-later")),
    ("AGPL-3.0-only", ("agpl-3-grant",)),
    ("LGPL-2.1-or-later", ("lgpl-2.1-or-later", "gpl-useful", "gpl-see", "gpl-received")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-or-later",)),
    ("LGPL-2.1-or-later", ("lgpl-2.1-grant", "or-later")),
    ("LGPL-2.1-only", ("lgpl-2.1-grant",)),
    ("LGPL-3.0-or-later", ("lgpl-3-or-later",)),
    ("LGPL-3.0-or-later", ("lgpl-3-grant", "or-later")),
    ("LGPL-3.0-only", ("lgpl-3-grant",)),
    ("GPL-3.0-or-later", ("gpl-3-or-later", "gpl-useful", "gpl-see", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-3-or-later",)),
    ("GPL-3.0-or-later", ("gpl-3-grant", "or-later")),
    ("GPL-3.0-only", ("gpl-3-grant",)),
    ("GPL-2.0-or-later", ("gpl-2-or-later", "gpl-useful", "gpl-see", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-2-or-later",)),
    ("GPL-2.0-or-later", ("gpl-2-grant", "or-later")),
    ("GPL-2.0-only", ("gpl-2-grant",)),
    ("MPL-2.0", ("mpl-2.0-grant", "mpl-copy")),
    ("MPL-2.0", ("mpl-2.0-grant",)),
    ("EPL-2.0", ("epl-2.0-grant",)),
    ("EPL-2.0", ("epl-grant", "epl-2.0-link")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-title",)),
    ("ISC", ("isc-grant",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4.0",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4.0",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4.0",)),
    ("CC-BY-4.0", ("cc-by-4.0",)),
    ("CC0-1.0", ("cc0-1.0",)),
    ("Unlicense", ("unlicense-grant",)),
    ("public-domain", ("public-domain",)),
    ("proprietary", ("copyright-notice", "all-rights-reserved")),
    ("proprietary", ("all-rights-reserved",)),
)


def bounded(pattern: str) -> str:
    """The pattern as whole words of a sentence; each alternative by itself."""
    return "|".join(p if p.startswith("^") else f"(^| )({p})( |$)" for p in _alternatives(pattern))


def _alternatives(pattern: str) -> list[str]:
    """Split at the bars outside brackets."""
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def identifier(sentence: str, matches: str = "{0} rlike '{1}'", sentences=SENTENCES) -> str:
    """SQL of the identifier of a normalised sentence; ``matches`` is the engine's regular-expression test."""
    return "CASE " + " ".join(f"WHEN {matches.format(sentence, bounded(p))} THEN '{name}'" for name, p in sentences) + " ELSE 'unknown' END"


def sequence_of(text: Column, sentences=SENTENCES) -> Column:
    """The identifiers of a text's licence sentences, in order, each as ``<identifier>``."""
    cut = F.split(F.regexp_replace(text, SENTENCE_END, "\x01"), "\x01")
    plain = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " ")))
    named = F.transform(F.filter(plain, lambda s: s.rlike(LICENCE_WORDS + "|(^| )cc( by|0)")), lambda s: F.concat(F.lit("<"), _case(s, sentences), F.lit(">")))
    return F.concat_ws("", named)


def _case(sentence: Column, sentences) -> Column:
    name = F.lit("unknown")
    for key, pattern in reversed(sentences):
        name = F.when(sentence.rlike(bounded(pattern)), F.lit(key)).otherwise(name)
    return name


def recognise(sequence: Column, rules=RULES) -> Column:
    """Rules applied in order: every matching run becomes ``[licence]`` and is not matched again."""
    for licence, names in rules:
        sequence = F.replace(sequence, F.lit("".join(f"<{n}>" for n in names)), F.lit(f"[{licence}]"))
    return sequence


def scan_licences(docs: DataFrame, text: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """Adds to every row the licences its whole text grants.

    ``licence_sequence``: identifiers of its licence sentences, in order; ``licences``: the licences found, distinct
    and sorted, joined by commas (empty without one); ``n_licence_sentences`` and ``n_unmatched`` (sentences that no
    rule used).  Null and empty texts have none; repeated rows keep their results; columns of these names are
    replaced; no row is dropped.  Everything is a projection of the scan: no shuffle, no join.
    """
    added = ("licence_sequence", "licences", "n_licence_sentences", "n_unmatched")
    names = [c for c in docs.columns if c not in added]
    body = F.coalesce(F.col(text), F.lit(""))
    # A text without any licence word has no licence sentence; the test saves cutting it.
    suspect = body.rlike("(?i)" + LICENCE_WORDS.replace("^", "").replace(" .* ", "(?s:.*)").replace(" ", "[^a-z0-9]+") + "|cc[^a-z0-9]*(by|0)")
    # A generated column is evaluated once, a projected one again for every use.
    cut = docs.select(*names, F.explode(F.array(F.when(suspect, sequence_of(body, sentences)).otherwise(""))).alias("licence_sequence"))
    ruled = cut.select(*names, "licence_sequence", F.explode(F.array(recognise(F.col("licence_sequence"), rules))).alias("_ruled"))
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("_ruled", F.lit(r"\[([^\]]+)\]"), 1)))
    count = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("<"), F.lit("")))).cast("int")
    return ruled.select(
        *names, "licence_sequence", F.concat_ws(",", found).alias("licences"),
        count(F.col("licence_sequence")).alias("n_licence_sentences"), count(F.col("_ruled")).alias("n_unmatched"),
    )
