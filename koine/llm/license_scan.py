"""Licence recognition by sentence rules, in built-in functions only.

A text is cut into sentences, each normalised to lower-case words with single
spaces.  A sentence of a standard licence text is looked up as a whole; one with
names, years or other wordings in it is searched for the known phrases, of which
it may hold several.  Either way it becomes identifiers in text order, and the
document's identifier sequence is matched against ordered licence rules: the
first rule that fits takes its own identifiers out of the sequence, and no
others, before the next is tried, so a three-clause text is not reported as a
two-clause one as well, and a licence inside another's text is not lost.

Everything happens inside a row (no explode, no shuffle): a text of any length
costs one pass, and texts without any licence word stop at the first filter.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from koine.llm.tables import table

#: Every known sentence has one of these words.
WORDS = (
    r"(?i)licen[cs]e|copyright|permission|redistribut|warrant|spdx|public[^a-z0-9]+domain|copyleft|endorse|advertising|unencumbered|"
    r"anyone[^a-z0-9]+is[^a-z0-9]+free|source[^a-z0-9]+distribution|creative[^a-z0-9]+commons|\bcc[^a-z0-9]+by|\bcc0|\beupl\b"
)

#: Whole sentences of standard licence texts, normalised.
WHOLE = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
    "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
    "purpose and noninfringement": "warranty_as_is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
    "permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd0_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "warranty_as_is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
    "provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission": "bsd_endorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd_advert",
    "licensed under the apache license version 2 0 the license": "apache2_grant",
    "you may not use this file except in compliance with the license": "apache2_comply",
    "you may obtain a copy of the license at": "apache2_copy",
    "this is free and unencumbered software released into the public domain": "unlicense_grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non "
    "commercial and by any means": "unlicense_use",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following "
    "restrictions": "zlib_grant",
    "this notice may not be removed or altered from any source distribution": "zlib_notice",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl_copy",
    "this font software is licensed under the sil open font license version 1 1": "ofl11_grant",
}

_PUBLISHED = r"(as published by the free software foundation (either )?)?(v ?|ver ?|version )?"
_UNDER = r"(licensed|released|available|distributed|dual licensed) under (the |a )?(terms of the )?"
_CC = r"(licensed|released|available) under (the |a )?(cc|creative commons) by"
#: Known phrases of licence sentences, over a normalised sentence; of those that fit at one place the first counts.
PHRASES = [
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"the above copyright notice and this permission notice .*?shall be included"),
    ("bsl1_grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("warranty_as_is", r"(the|this) software is provided .*?as is.*? without (any express or implied )?warrant"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd_source", r"redistributions of source code must retain"),
    ("bsd_binary", r"redistributions in binary form must reproduce"),
    ("bsd_advert", r"all advertising materials mentioning features or use of this software"),
    ("bsd_endorse", r"neither the name .*?may be used to endorse or promote"),
    ("apache2_grant", r"licensed under the apache license version 2 0"),
    ("apache2_comply", r"you may not use this (file|work) except in compliance with the license"),
    ("apache2_copy", r"you may obtain a copy of the license at"),
    ("lgpl3_ref", rf"gnu lesser general public license {_PUBLISHED}3\b"),
    ("lgpl21_ref", rf"gnu lesser general public license {_PUBLISHED}2 1\b"),
    ("lgpl2_ref", rf"gnu library general public license {_PUBLISHED}2\b"),
    ("agpl3_ref", rf"gnu affero general public license {_PUBLISHED}3\b"),
    ("gpl3_ref", rf"gnu general public license {_PUBLISHED}3\b"),
    ("gpl2_ref", rf"gnu general public license {_PUBLISHED}2\b"),
    ("gpl1_ref", rf"gnu general public license {_PUBLISHED}1\b"),
    ("gpl_redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl2_ref", r"subject to the terms of the mozilla public license (v ?|ver ?|version )?2 0"),
    ("mpl11_ref", r"subject to the mozilla public license version 1 1"),
    ("epl2_ref", r"under the terms of the eclipse public license (v ?|version )?2 0"),
    ("epl1_ref", r"under the terms of the eclipse public license (v ?|version )?1 0"),
    ("cddl1_ref", r"subject to the terms of the common development and distribution license"),
    ("artistic2_ref", rf"{_UNDER}artistic license (v ?|version )?2 0"),
    ("eupl12_ref", r"licensed under the eupl (v ?|version )?1 2"),
    ("bsl1_ref", r"distributed under the boost software license version 1 0"),
    ("ofl11_grant", r"licensed under the sil open font license version 1 1"),
    ("unlicense_grant", r"free and unencumbered software released into the public domain"),
    ("cc_by_nc_sa", rf"{_CC} nc sa\b"),
    ("cc_by_nc_nd", rf"{_CC} nc nd\b"),
    ("cc_by_nc", rf"{_CC} nc\b"),
    ("cc_by_nd", rf"{_CC} nd\b"),
    ("cc_by_sa", rf"{_CC} sa\b"),
    ("cc_by", rf"{_CC}\b"),
    ("cc0", r"(cc0|creative commons zero).*?(licen[cs]e|public domain)|public domain.*?cc0"),
    ("mit_ref", rf"{_UNDER}mit licen[cs]e"),
    ("bsd3_ref", rf"{_UNDER}(bsd 3 clause|3 clause bsd|new bsd|modified bsd) licen[cs]e"),
    ("bsd2_ref", rf"{_UNDER}(bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[cs]e"),
    ("bsd_ref", rf"{_UNDER}bsd licen[cs]e"),
    ("isc_ref", rf"{_UNDER}isc licen[cs]e"),
    ("zlib_ref", rf"{_UNDER}zlib licen[cs]e"),
    ("public_domain", r"(placed|released|dedicated) (in|into|to) the public domain"),
]

#: Names that an SPDX-License-Identifier line may give.
SPDX = (
    "0BSD AGPL-3.0 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 "
    "GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 MIT MIT-0 MPL-1.1 MPL-2.0 OFL-1.1 Unlicense WTFPL Zlib"
).split()


def _words(name: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", name.lower()))


def _spdx_id(name: str) -> str:
    return "spdx_" + _words(name).replace(" ", "_")


def phrases() -> list[tuple[str, str]]:
    """All phrases, longer names first, since a place takes the first that fits."""
    own = [(_spdx_id(n), rf"spdx license identifier {_words(n)}\b") for n in sorted(SPDX, key=lambda n: (-len(n), n))]
    return own + PHRASES


#: Ordered licence rules: name and the identifiers that must follow one another (others between them are passed over).
RULES = [
    ("BSD-4-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_advert", "bsd_endorse"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_grant", "mit_notice", "warranty_as_is"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("MIT-0", ["mit_grant", "warranty_as_is"]),
    ("BSL-1.0", ["bsl1_grant"]),
    ("ISC", ["isc_grant", "warranty_as_is"]),
    ("ISC", ["isc_grant"]),
    ("0BSD", ["bsd0_grant", "warranty_as_is"]),
    ("0BSD", ["bsd0_grant"]),
    ("Zlib", ["warranty_as_is", "zlib_grant", "zlib_notice"]),
    ("Zlib", ["zlib_grant"]),
    ("Apache-2.0", ["apache2_grant", "apache2_comply", "apache2_copy"]),
    ("Apache-2.0", ["apache2_grant"]),
    ("AGPL-3.0", ["agpl3_ref"]),
    ("LGPL-3.0", ["lgpl3_ref"]),
    ("LGPL-2.1", ["lgpl21_ref"]),
    ("LGPL-2.0", ["lgpl2_ref"]),
    ("GPL-3.0", ["gpl_redistribute", "gpl3_ref"]),
    ("GPL-3.0", ["gpl3_ref"]),
    ("GPL-2.0", ["gpl_redistribute", "gpl2_ref"]),
    ("GPL-2.0", ["gpl2_ref"]),
    ("GPL-1.0", ["gpl_redistribute", "gpl1_ref"]),
    ("GPL-1.0", ["gpl1_ref"]),
    ("GPL", ["gpl_redistribute"]),
    ("MPL-2.0", ["mpl2_ref"]),
    ("MPL-1.1", ["mpl11_ref"]),
    ("EPL-2.0", ["epl2_ref"]),
    ("EPL-1.0", ["epl1_ref"]),
    ("CDDL-1.0", ["cddl1_ref"]),
    ("Artistic-2.0", ["artistic2_ref"]),
    ("EUPL-1.2", ["eupl12_ref"]),
    ("BSL-1.0", ["bsl1_ref"]),
    ("OFL-1.1", ["ofl11_grant"]),
    ("WTFPL", ["wtfpl_copy"]),
    ("Unlicense", ["unlicense_grant", "unlicense_use"]),
    ("Unlicense", ["unlicense_grant"]),
    ("CC-BY-NC-SA", ["cc_by_nc_sa"]),
    ("CC-BY-NC-ND", ["cc_by_nc_nd"]),
    ("CC-BY-NC", ["cc_by_nc"]),
    ("CC-BY-ND", ["cc_by_nd"]),
    ("CC-BY-SA", ["cc_by_sa"]),
    ("CC-BY", ["cc_by"]),
    ("CC0-1.0", ["cc0"]),
    ("MIT", ["mit_ref"]),
    ("BSD-3-Clause", ["bsd3_ref"]),
    ("BSD-2-Clause", ["bsd2_ref"]),
    ("BSD", ["bsd_ref"]),
    ("ISC", ["isc_ref"]),
    ("Zlib", ["zlib_ref"]),
    ("Public-Domain", ["public_domain"]),
]
_GAP = "((?:<[a-z0-9_]+>)*?)"


def rules() -> list[tuple[str, list[str]]]:
    return RULES + [(n, [_spdx_id(n)]) for n in SPDX]


def sentences(text: Column) -> Column:
    """Cut after ``. ``, ``! ``, ``? ``, ``; `` and ``: ``, but not inside
    ``v. 2.0`` or after ``Identifier:``."""
    one_line = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    cut = r"(?i)((?<!\b(?:v|ver))[.!?]|(?<=\b(?:v|ver))[.!?](?! [0-9])|;|(?<!\bidentifier):) "
    return F.split(F.regexp_replace(one_line, cut, "$1\n"), "\n")


def identify(sentence: Column) -> Column:
    """The identifiers of a sentence in text order: of the whole sentence, or of
    the known phrases in it."""
    norm = F.trim(F.lower(F.regexp_replace(sentence, "[^A-Za-z0-9]+", " ")))
    known = phrases()
    # looking ahead, so that a match may begin inside another
    found = F.regexp_extract_all(norm, F.lit("(?=(" + "|".join(f"(?:{p})" for _, p in known) + "))"), F.lit(1))
    each = F.transform(found, lambda m: reduce(lambda rest, s: F.when(m.rlike(f"^(?:{s[1]})$"), F.lit(s[0])).otherwise(rest), reversed(known), F.lit("")))
    whole = F.element_at(F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair]), norm)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(each)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_sentences, sentence_ids, licences``.

    ``sentence_ids`` is the sequence ``<id><id>...`` in text order,
    ``licences`` the names of the fitting rules in rule order joined by commas,
    each once; both are empty for null or empty text.  A rule takes out every
    place where it fits; of rules that want the same identifier the earlier one
    gets it.  A null id stays null, repeated rows are scanned alike, long texts
    whole, further columns are ignored; an empty table gives an empty result.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    ids = F.flatten(F.transform(F.filter(sentences(F.col("_t")), lambda s: s.rlike(WORDS)), identify))
    seq = F.when(F.col("_t").rlike(WORDS), F.concat_ws("", F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))))).otherwise("")
    out = docs.select(F.col(id_col).alias("doc_id"), t.alias("_t")).select("doc_id", seq.alias("sentence_ids"))
    left, names = F.col("sentence_ids"), []
    for name, rule in rules():
        pattern = _GAP.join(f"<{i}>" for i in rule)
        names.append(F.when(left.rlike(pattern), F.lit(name)))
        left = F.regexp_replace(left, pattern, "".join(f"${k}" for k in range(1, len(rule))))
    licences = F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(F.array_join(F.array_distinct(F.array_compact(F.array(*names))), ","))
    n = F.length(F.regexp_replace("sentence_ids", "[^<]", "")).cast("long")
    return out.select("doc_id", n.alias("n_sentences"), "sentence_ids", licences.alias("licences"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


#: Written for the four licence lines that the registered documents have, apart from the tables above.
ORACLE = r"""
WITH s AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
e AS (
  SELECT row_id, unnest(string_split(x, chr(10))) AS sentence, generate_subscripts(string_split(x, chr(10)), 1) AS k
  FROM (SELECT row_id, regexp_replace(t, '([.!?;:]) ', '\1' || chr(10), 'g') AS x FROM s)),
w AS (SELECT row_id, k, trim(lower(regexp_replace(sentence, '[^A-Za-z0-9]+', ' ', 'g'))) AS words FROM e),
f AS (
  SELECT row_id, k, unnest(found) AS line, generate_subscripts(found, 1) AS j
  FROM (SELECT row_id, k, regexp_extract_all(words,
    'gnu general public license version 3|licensed under cc by nc 4 0|released under the mit license|licensed under the apache license version 2 0') AS found FROM w)),
g AS (
  SELECT row_id, count(*) AS n,
         string_agg(CASE line[1:8] WHEN 'gnu gene' THEN '<gpl3_ref>' WHEN 'released' THEN '<mit_ref>' ELSE CASE WHEN line LIKE '%apache%' THEN '<apache2_grant>' ELSE '<cc_by_nc>' END END, '' ORDER BY k, j) AS ids
  FROM f GROUP BY row_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids,
       concat_ws(',', CASE WHEN ids LIKE '%apache2%' THEN 'Apache-2.0' END, CASE WHEN ids LIKE '%gpl3%' THEN 'GPL-3.0' END, CASE WHEN ids LIKE '%cc_by%' THEN 'CC-BY-NC' END, CASE WHEN ids LIKE '%mit_ref%' THEN 'MIT' END) AS licences
FROM s LEFT JOIN g USING (row_id)
"""
