r"""Licence scan by sentence rules, with DataFrame functions only (operator 7).

A text is unwrapped (a line break before a lower-case letter inside a sentence is a space), cut
into units at sentence ends and line breaks, and each unit is normalised: lower case, letters and
digits kept, everything else one space. Known sentences map to identifiers; the identifiers of a
document, in order and with unknown sentences left out, are matched against ordered rules.

All in one row-wise pass: no shuffle, no group, nothing broadcast but the rule base (fixed, small).
Null and empty texts have no sentences and no licence; repeated rows are judged alike; other
columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

@dataclass(frozen=True)
class LicenseRule:
    """The identifiers that stand in a row; of rules at one place the longest counts, then the first."""

    license: str
    sentences: tuple[str, ...]


#: Public licences and the names that notices give them.
NAMES = {
    "AFL-3.0": ("Academic Free License version 3.0",),
    "AGPL-3.0": ("GNU Affero General Public License version 3", "AGPL-3.0", "GNU AGPL version 3"),
    "Apache-2.0": ("Apache License 2.0", "Apache-2.0 license", "Apache License, Version 2.0"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "0BSD": ("Zero-Clause BSD License", "0BSD license"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License",),
    "BSL-1.0": ("Boost Software License version 1.0",),
    "BUSL-1.1": ("Business Source License 1.1",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal license"),
    "CC-BY-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License",),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0",),
    "CECILL-2.1": ("CeCILL license version 2.1",),
    "ECL-2.0": ("Educational Community License version 2.0",),
    "EPL-1.0": ("Eclipse Public License 1.0",),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2"),
    "FSL-1.1": ("Functional Source License version 1.1",),
    "GFDL-1.3": ("GNU Free Documentation License version 1.3",),
    "GPL-2.0": ("GNU General Public License version 2", "GPLv2 license", "GNU GPL version 2"),
    "GPL-3.0": ("GPLv3 license", "GNU GPL version 3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License version 2.1", "LGPL 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License version 3", "LGPLv3 license"),
    "MPL-1.1": ("Mozilla Public License 1.1",),
    "MPL-2.0": ("Mozilla Public License 2.0", "MPL 2.0"),
    "MS-PL": ("Microsoft Public License",),
    "MulanPSL-2.0": ("Mulan PSL v2",),
    "ODbL-1.0": ("Open Database License 1.0",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1",),
    "OSL-3.0": ("Open Software License version 3.0",),
    "PostgreSQL": ("PostgreSQL License",),
    "PSF-2.0": ("Python Software Foundation License version 2",),
    "Unlicense": ("Unlicense",),
    "UPL-1.0": ("Universal Permissive License version 1.0",),
    "WTFPL": ("WTFPL",),
    "Zlib": ("zlib License",),
}
#: What stands before a name in a notice.
NOTICES = ("Licensed under the", "Released under the", "Licensed under", "Released under", "This project is licensed under the", "This work is licensed under the", "This work is licensed under a")


def normalised(sentence: str) -> str:
    """A sentence as ``units`` yields it."""
    return re.sub(r"[\W_]+", " ", sentence.lower()).strip()


#: Public licence sentences, normalised, with their identifiers.
TEXT_SENTENCES = (
    ("mit_notice", "released under the mit license"),
    ("mit_notice", "licensed under the mit license"),
    ("mit_notice", "this project is licensed under the mit license"),
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit_keep", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache2_notice", "licensed under the apache license version 2 0"),
    ("apache2_header", "licensed under the apache license version 2 0 the license"),
    ("apache2_use", "you may not use this file except in compliance with the license"),
    ("gpl3_notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl3_notice", "licensed under the gnu general public license version 3"),
    ("gpl_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl_hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("ccbync4_notice", "licensed under cc by nc 4 0"),
    ("ccby4_notice", "licensed under cc by 4 0"),
    ("bsd_redist", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd_name", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("lgpl_free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("gpl2_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl_form", "this source code form is subject to the terms of the mozilla public license v"),
    ("mpl_form", "this source code form is subject to the terms of the mozilla public"),
    ("isc_grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zero_grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense_free", "this is free and unencumbered software released into the public domain"),
    ("bsl_grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("zlib_warranty", "this software is provided as is without any express or implied warranty"),
    ("zlib_grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
)
_TEXT_RULES = (
    LicenseRule("Apache-2.0", ("apache2_notice",)),
    LicenseRule("Apache-2.0", ("apache2_header", "apache2_use")),
    LicenseRule("BSD-2-Clause", ("bsd_redist", "bsd_source", "bsd_binary")),
    LicenseRule("BSD-3-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_name")),
    LicenseRule("CC-BY-4.0", ("ccby4_notice",)),
    LicenseRule("CC-BY-NC-4.0", ("ccbync4_notice",)),
    LicenseRule("GPL-3.0", ("gpl3_notice",)),
    LicenseRule("GPL-3.0-or-later", ("gpl_free", "gpl_hope")),
    LicenseRule("GPL-2.0-or-later", ("gpl2_free", "gpl_hope")),
    LicenseRule("AGPL-3.0-or-later", ("agpl_free", "gpl_hope")),
    LicenseRule("LGPL-2.1-or-later", ("lgpl_free",)),
    LicenseRule("MIT", ("mit_notice",)),
    LicenseRule("MIT", ("mit_grant", "mit_keep")),
    LicenseRule("MPL-2.0", ("mpl_form",)),
    LicenseRule("ISC", ("isc_grant",)),
    LicenseRule("0BSD", ("zero_grant",)),
    LicenseRule("Unlicense", ("unlicense_free",)),
    LicenseRule("BSL-1.0", ("bsl_grant",)),
    LicenseRule("Zlib", ("zlib_warranty", "zlib_grant")),
)


def notice_base(names: dict[str, tuple[str, ...]] = NAMES, notices: tuple[str, ...] = NOTICES) -> tuple[tuple[tuple[str, str], ...], tuple[LicenseRule, ...]]:
    """Sentences and rules of all notices of all names; identifiers are the licences' with ``_notice``."""
    ident = {x: normalised(x).replace(" ", "") + "_notice" for x in names}
    sentences = tuple((ident[x], normalised(f"{notice} {name}")) for x, given in names.items() for name in given for notice in notices)
    return sentences, tuple(LicenseRule(x, (ident[x],)) for x in names)


def _base() -> tuple[tuple[tuple[str, str], ...], tuple[LicenseRule, ...]]:
    sentences, rules = notice_base()
    known = {s for _, s in TEXT_SENTENCES}
    return TEXT_SENTENCES + tuple(x for x in sentences if x[1] not in known), _TEXT_RULES + rules


SENTENCES, RULES = _base()

_BREAK = "\x01"


def units(text: Column) -> Column:
    """The normalised, non-empty sentence units of a text, in order."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"([^.!?:;\n\r])[ \t]*\r?\n[ \t]*([a-z(])", "$1 $2")
    cut = F.regexp_replace(F.lower(flat), r"[.!?:;]+[ \t\n\f\r]+|[\n\r]+", _BREAK)
    kept = F.regexp_replace(cut, rf"[^\p{{L}}\p{{N}}{_BREAK}]+", " ")
    return F.filter(F.transform(F.split(kept, _BREAK), lambda u: F.trim(u)), lambda u: u != "")


def ordered(rules: tuple[LicenseRule, ...]) -> list[LicenseRule]:
    """The declared order: longer rules first, then as they are listed."""
    return sorted(rules, key=lambda r: -len(r.sentences))


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: tuple[tuple[str, str], ...] = SENTENCES, rules: tuple[LicenseRule, ...] = RULES
) -> DataFrame:
    """key, n_sentences, sentence_ids and licenses (comma-joined; ids in text order, licences sorted).

    ``sentences``: identifier and normalised sentence. A rule that is part of a longer matching rule
    at the same place does not count besides it.
    """
    known = [s for _, s in sentences]
    found = docs.select(key, units(F.col(text)).alias("units"))
    names, place = F.lit([n for n, _ in sentences]), F.lit(known)
    ids = F.transform(F.filter("units", lambda u: u.isin(*known)), lambda u: F.element_at(names, F.array_position(place, u).cast("int")))
    found = found.select(key, F.size("units").cast("long").alias("n_sentences"), F.array_join(ids, ",").alias("sentence_ids"))
    rest = F.concat(F.lit(","), F.replace("sentence_ids", F.lit(","), F.lit(",,")), F.lit(","))
    by_order = ordered(rules)
    wanted = F.arrays_zip(F.lit([r.license for r in by_order]).alias("license"), F.lit(["".join(f",{s}," for s in r.sentences) for r in by_order]).alias("ids"))
    start = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("hits"))

    def step(state: Column, rule: Column) -> Column:
        meets = F.contains(state.rest, rule["ids"])
        return F.struct(F.when(meets, F.replace(state.rest, rule["ids"], F.lit(";"))).otherwise(state.rest).alias("rest"), F.when(meets, F.array_append(state.hits, rule["license"])).otherwise(state.hits).alias("hits"))

    licenses = F.array_join(F.array_sort(F.array_distinct(F.aggregate(wanted, start, step, lambda a: a.hits))), ",")
    return found.select("*", F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(licenses).alias("licenses"))
