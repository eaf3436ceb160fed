"""Licence scans by sentence rules, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: licence sentences, normalised (lower case, runs of other characters than
# letters and digits as one space), with the licence identifier and place in its rule
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2.notice",
    "you may not use this file except in compliance with the license": "apache2.terms",
    "you may obtain a copy of the license at": "apache2.copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2.asis",
    "released under the mit license": "mit.notice",
    "licensed under the mit license": "mit.notice",
    "this project is licensed under the mit license": "mit.notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.notice_kept",
    "the software is provided as is without warranty of any kind express or implied": "mit.asis",
    "this work is licensed under the gnu general public license version 3": "gpl3.notice",
    "licensed under the gnu general public license version 3": "gpl3.notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl.grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl.nowarranty",
    "you should have received a copy of the gnu general public license along with this program": "gpl.copy",
    "either version 3 of the license or at your option any later version": "gpl3.later",
    "either version 2 of the license or at your option any later version": "gpl2.later",
    "licensed under cc by nc 4 0": "ccbync4.notice",
    "licensed under cc by 4 0": "ccby4.notice",
    "licensed under cc by sa 4 0": "ccbysa4.notice",
    "licensed under cc0 1 0": "cc0.notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd.grant",
    "redistributions of source code must retain the above copyright notice": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd.binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd3.names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc.grant",
    "this is free and unencumbered software released into the public domain": "unlicense.grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2.notice",
    "all rights reserved": "reserved.notice",
}
# fixed values: the sentences of the licences' own texts where they go on further, likewise normalised
CANONICAL = {
    "licensed under the apache license version 2 0 the license": "apache2.notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit.grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit.asis",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl.grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl.grant,gpl3.later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl.grant,gpl2.later",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd.binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd3.names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
}
# fixed values: a rule holds where its identifiers occur in this order, others between them
RULES = [
    ("Apache-2.0", ["apache2.notice"]),
    ("Apache-2.0", ["apache2.terms", "apache2.copy"]),
    ("MIT", ["mit.notice"]),
    ("MIT", ["mit.grant", "mit.asis"]),
    ("GPL-3.0", ["gpl3.notice"]),
    ("GPL-3.0-or-later", ["gpl.grant", "gpl3.later"]),
    ("GPL-2.0-or-later", ["gpl.grant", "gpl2.later"]),
    ("CC-BY-NC-4.0", ["ccbync4.notice"]),
    ("CC-BY-4.0", ["ccby4.notice"]),
    ("CC-BY-SA-4.0", ["ccbysa4.notice"]),
    ("CC0-1.0", ["cc0.notice"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd3.names"]),
    ("BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("ISC", ["isc.grant"]),
    ("Unlicense", ["unlicense.grant"]),
    ("MPL-2.0", ["mpl2.notice"]),
    ("LicenseRef-all-rights-reserved", ["reserved.notice"]),
]
# a piece ends at a line end, or at one of these marks before white space; a sentence is a piece
# or several in a row, as texts are wrapped and sentences hold marks ("v. 2.0", "software: you")
SPLIT = r"[.!?;:]+\s+|\n+"
OTHERS, LINE_ENDS = "[^a-z0-9\n]+", " *\n[ \n]*"
# in any text: words of which every known sentence has one; they hold no white space and no letter
# whose case folding differs, so raw and normalised text hold them alike
WORDS = "(?i)licen[sc]|copyright|warrant|redistribut|permission|free|rights|unencumbered|written|later|endorse"
# in normalised text: of these, every known sentence has one
HINT = "licen[sc]|copyright|warrant|redistribut|permission|free[ |]+software|all[ |]+rights|unencumbered|written|any[ |]+later|endorse"


def sentence_steps() -> list[tuple[str, str]]:
    """Patterns of the known sentences, longest first, each with what takes its place in a line
    of pieces between pairs of bars: its identifiers, each behind a # between bars."""
    steps = []
    for sentence, ids in sorted((SENTENCES | CANONICAL).items(), key=lambda x: (-len(x[0]), x[0])):
        steps.append((r"\|" + sentence.replace(" ", r"(?: |\|\|)") + r"\|", "".join(f"|#{i}|" for i in ids.split(","))))
    return steps


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order; null where WORDS or HINT finds
    none. Texts without the words are not normalised."""
    cut = F.regexp_replace(F.lower(F.regexp_replace(text, SPLIT, "|\n")), OTHERS, " ")
    line = F.concat(F.lit("|"), F.trim(F.regexp_replace(cut, LINE_ENDS, "||")), F.lit("|"))
    found = line
    for pattern, ids in sentence_steps():
        found = F.regexp_replace(found, pattern, ids)
    return F.when(text.rlike(WORDS), F.when(line.rlike(HINT), F.regexp_extract_all(found, F.lit(r"\|#([^|]+)"), F.lit(1))))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_sentences (known ones), sentence_ids and licenses,
    both comma-joined, the latter in the order of RULES without repeats; a longer BSD rule
    hides the shorter one.

    Sentences are found wrapped as well as on one line. WORDS, tested on the text,
    and HINT, tested on the normalised text, name what every known sentence has, so other texts
    are not searched. Null
    and empty texts hold nothing; very long ones are searched whole; a repeated row is reported
    each time; an empty table gives an empty result.
    """
    ids = F.coalesce(sentence_ids(F.coalesce(F.col("text"), F.lit(""))), F.expr("array()").cast("array<string>"))
    line = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    tests = [F.when(line.rlike("," + ",(?:[^,]*,)*".join(x.replace(".", r"\.") for x in seq) + ","), F.lit(name)) for name, seq in RULES]
    names = F.array_distinct(F.array_compact(F.array(*tests)))
    names = F.when(F.array_contains(names, "BSD-3-Clause"), F.array_remove(names, "BSD-2-Clause")).otherwise(names)
    return (
        docs.select("doc_id", ids.alias("ids"))
        .withColumn("names", F.when(F.size("ids") > 0, names).otherwise(F.expr("array()").cast("array<string>")))
        .select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join("names", ",").alias("licenses"))
    )
