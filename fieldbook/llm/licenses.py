"""License scans by ordered signature rules, in DataFrame functions only.

A rule is a regular expression over a text's words (lower-cased, joined by blanks), a keyword without
which it cannot match, a label and a priority.  A text is scanned only by the rules whose keyword is
among its words.  Detections that lie within one of better priority, or within a longer one of the
same, are suppressed; what remains gives the labels.

The rules are hand-written: signatures of licences' texts, headers and notices, and patterns of their names
in a few forms of mention.

Defined cases: null and empty texts have no words, places, labels, and score 0; first_word and
last_word are null without a base place; rows of one id and text share one row's labels and all stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldbook.llm.words import n_words, words

#: Fixed phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, keyword (a word that every match holds), pattern of the name in words.
NAMES = (
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("mit", "mit", r"mit"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version| v)? 2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)?"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl(?: (?:version|v) ?| )1(?: 0)?"),
    ("gpl-1.0", "gpl1", r"(?:gnu )?gpl1(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: (?:version|v) ?| )2(?: 0)?"),
    ("gpl-2.0", "gpl2", r"(?:gnu )?gpl2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: (?:version|v) ?| )3(?: 0)?"),
    ("gpl-3.0", "gpl3", r"(?:gnu )?gpl3(?: 0)?"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl-2.0", "general", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) 2(?: 0)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v) 3(?: 0)?"),
    ("gpl", "general", r"(?:gnu )?general public"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl(?: (?:version|v) ?| )2(?: 0)?"),
    ("lgpl-2.0", "lgpl2", r"(?:gnu )?lgpl2(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: (?:version|v) ?| )2 1"),
    ("lgpl-2.1", "lgpl2", r"(?:gnu )?lgpl2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl(?: (?:version|v) ?| )3(?: 0)?"),
    ("lgpl-3.0", "lgpl3", r"(?:gnu )?lgpl3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public"),
    ("lgpl", "library", r"(?:gnu )?library general public"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: (?:version|v) ?| )3(?: 0)?"),
    ("agpl-3.0", "agpl3", r"(?:gnu )?agpl3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl"),
    ("bsd-0-clause", "0bsd", r"0bsd"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("bsd-2-clause", "freebsd", r"freebsd"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", r"bsd"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: license)?(?: version| v)? 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public"),
    ("mpl", "mpl", r"mpl(?: version| v)?(?: [12](?: [01])?)?"),
    ("epl-1.0", "eclipse", r"eclipse public(?: license)?(?: version| v)? 1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public"),
    ("epl", "epl", r"epl"),
    ("eupl", "european", r"european union public"),
    ("eupl", "eupl", r"eupl(?: v)?(?: 1 [12])?"),
    ("cddl", "distribution", r"common development and distribution"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"),
    ("cpl-1.0", "cpl", r"cpl(?: 1 0)?"),
    ("cpl-1.0", "common", r"common public"),
    ("artistic-1.0", "artistic", r"artistic(?: license)? 1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic(?: license)? 2(?: 0)?"),
    ("artistic", "artistic", r"artistic"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("boost-1.0", "boost", r"boost software(?: license)?(?: version)?(?: 1(?: 0)?)?"),
    ("boost-1.0", "bsl", r"bsl 1 0"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "attribution", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-sa", "sharealike", r"creative commons attribution sharealike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution noncommercial(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nd", "noderivatives", r"creative commons attribution noderivatives(?: [1-4] [05])?(?: international| unported)?"),
    ("cc", "commons", r"creative commons"),
    ("odbl", "odbl", r"odbl(?: 1 0)?"),
    ("odbl", "database", r"open database"),
    ("odc-by", "odc", r"odc by(?: 1 0)?"),
    ("pddl", "pddl", r"pddl(?: 1 0)?"),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl 1 1"),
    ("ofl-1.1", "font", r"(?:sil )?open font license 1 1"),
    ("ofl", "font", r"(?:sil )?open font"),
    ("python-2.0", "python", r"python(?: software foundation)?(?: 2 0)?"),
    ("php", "php", r"php(?: 3 01)?"),
    ("ruby", "ruby", r"ruby"),
    ("postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl"),
    ("vim", "vim", r"vim"),
    ("curl", "curl", r"curl"),
    ("x11", "x11", r"x11"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "reciprocal", r"microsoft reciprocal"),
    ("afl-3.0", "academic", r"academic free"),
    ("osl-3.0", "osl", r"osl(?: 3 0)?"),
    ("osl-3.0", "open", r"open software"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("upl-1.0", "universal", r"universal permissive"),
    ("busl-1.1", "business", r"business source(?: 1 1)?"),
    ("sspl", "side", r"server side public"),
    ("elastic-2.0", "elastic", r"elastic(?: 2 0)?"),
    ("proprietary", "proprietary", r"proprietary"),
    ("commercial", "commercial", r"commercial"),
)
#: priority (the least is best), score, and the form around a name.
FORMS = (
    (0, 1.0, r"spdx license identifier {name}(?: or later| only)?"),
    (1, 0.9, r"(?:dual )?licensed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{name}(?: licen[sc]e| public licen[sc]e)?(?: version| v)?(?: [0-9]+(?: [0-9]+)?)?"),
    (1, 0.9, r"(?:released|distributed|available|published|provided|covered|shared) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{name}(?: licen[sc]e| public licen[sc]e)?(?: version| v)?(?: [0-9]+(?: [0-9]+)?)?"),
    (2, 0.7, r"(?:the )?{name} licen[sc]e(?: version| v)?(?: [0-9]+(?: [0-9]+)?)?"),
    (2, 0.7, r"licen[sc]e {name}"),
)
#: Signatures that are not a name in a form, written from the texts, headers and notices of licences: label, keyword, priority, score, pattern.
OTHERS = (
    # dedications and reservations
    ("public-domain", "domain", 1, 0.9, r"(?:dedicated to|placed in(?:to)?|released (?:in)?to|in) the public domain"),
    ("all-rights-reserved", "reserved", 2, 0.5, r"all rights reserved"),
    ("unlicense", "unencumbered", 0, 1.0, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "relinquishment", 0, 1.0, r"an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
    ("cc0-1.0", "waives", 0, 1.0, r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc0-1.0", "cc0", 1, 0.9, r"to the extent possible under law .{0,120}? has waived all copyright and related or neighboring rights(?: .{0,80}?)? cc0"),
    ("wtfpl", "fuck", 0, 1.0, r"do what the fuck you want to public license"),
    # permissive grants
    ("mit", "granted", 0, 1.0, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", 0, 1.0, r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "noninfringement", 1, 0.9, r"without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "granted", 0, 1.0, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", 0, 0.9, r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("hpnd", "granted", 0, 1.0, r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("x11", "consortium", 0, 1.0, r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("bsd", "redistribution", 0, 1.0, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", 0, 0.9, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", 0, 0.9, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "warranties", 1, 0.9, r"this software is provided by the (?:copyright holders? and contributors|regents and contributors|author(?: and contributors)?) as is and any express or implied warranties"),
    ("bsd-3-clause", "endorse", 0, 1.0, r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", 0, 1.0, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "misrepresented", 0, 1.0, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", 0, 0.9, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost-1.0", "accompanying", 0, 1.0, r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ncsa", "deal", 0, 0.9, r"to deal with the software without restriction including without limitation"),
    ("postgresql", "granted", 0, 0.9, r"without a written agreement is hereby granted provided that the above copyright notice"),
    ("python-2.0", "psf", 0, 1.0, r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", "openssl", 0, 1.0, r"this product includes software developed by the openssl project"),
    ("php", "php", 0, 1.0, r"this product includes php software freely available from"),
    ("upl-1.0", "larger", 0, 0.9, r"licensable by such licensor .{0,80}? the larger works"),
    # Apache
    ("apache-2.0", "compliance", 0, 1.0, r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "distributed", 1, 0.9, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "contributor", 0, 1.0, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "asf", 0, 1.0, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "apache", 0, 0.9, r"this product includes software developed by the apache software foundation"),
    # GNU
    ("gpl", "redistribute", 1, 0.9, r"this program is free software you can redistribute it and or modify it"),
    ("gpl-2.0", "redistribute", 0, 1.0, r"redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?(?: either)? version 2"),
    ("gpl-3.0", "redistribute", 0, 1.0, r"redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?(?: either)? version 3"),
    ("gpl", "useful", 1, 0.8, r"is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl", "received", 1, 0.9, r"you should have received a copy of the gnu general public license along with"),
    ("gpl", "freedom", 0, 1.0, r"the gnu general public license is intended to guarantee your freedom to share and change"),
    ("gpl-2.0", "freedom", 0, 1.0, r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft", 0, 1.0, r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "verbatim", 1, 0.7, r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl", "lesser", 0, 1.0, r"redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "lesser", 1, 0.9, r"you should have received a copy of the gnu lesser general public license along with"),
    ("lgpl-3.0", "supplemented", 0, 1.0, r"incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions"),
    ("agpl", "affero", 0, 1.0, r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3.0", "affero", 0, 1.0, r"the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community"),
    ("gfdl", "invariant", 0, 1.0, r"with no invariant sections no front cover texts and no back cover texts"),
    # weak copyleft
    ("mpl-2.0", "mozilla", 0, 1.0, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "incompatible", 0, 1.0, r"this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", "mozilla", 0, 1.0, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", "eclipse", 0, 1.0, r"made available under the terms of the eclipse public license v(?:ersion)? ?1 0"),
    ("epl-2.0", "eclipse", 0, 1.0, r"made available under the terms of the eclipse public license v?(?:ersion)? ?2 0"),
    ("epl", "recipient", 0, 0.9, r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl", "distribution", 0, 1.0, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "eupl", 0, 1.0, r"licensed under the eupl(?: version| v)? 1 [12]"),
    ("artistic-2.0", "artistic", 0, 0.9, r"everyone is permitted to copy and distribute verbatim copies of this license document .{0,60}? the artistic license"),
    # works other than software
    ("cc", "commons", 0, 1.0, r"(?:this work|this article|this text|this page|the content|content) is licensed under a creative commons"),
    ("cc-by", "attribution", 0, 1.0, r"is licensed under (?:a|the) creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? license"),
    ("cc-by-sa", "share", 0, 1.0, r"creative commons attribution share alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nc", "commercial", 0, 1.0, r"creative commons attribution non commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nd", "derivatives", 0, 1.0, r"creative commons attribution no derivatives(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"),
    ("cc", "adapted", 0, 0.9, r"adapted material means material subject to copyright and similar rights that is derived from or based upon the licensed material"),
    ("odbl", "database", 0, 1.0, r"made available under the open database license"),
    ("ofl", "reserved", 0, 1.0, r"with reserved font name"),
    ("ofl-1.1", "font", 0, 1.0, r"this font software is licensed under the sil open font license version 1 1"),
    # source available
    ("busl-1.1", "licensor", 0, 1.0, r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl", "service", 0, 0.9, r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted", 0, 0.9, r"you may not provide the software to third parties as a hosted or managed service"),
    ("commercial", "eula", 1, 0.7, r"end user licen[sc]e agreement eula"),
    ("proprietary", "prohibited", 1, 0.7, r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this (?:file|software|document|material))?(?: via any medium)? is (?:strictly )?prohibited"),
)
_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A text that this does not find cannot match a rule.
GATE = rf"(?i)licen[cs]|spdx|(?:released|distributed|available|published|provided|covered|shared){_SEP}under|public{_SEP}domain|rights{_SEP}reserved|hereby|redistribut|unencumbered|warrant|relinquish|neighboring{_SEP}rights|advertising{_SEP}material|endorse|misrepresented|includes{_SEP}(?:software|php)|freedom|larger{_SEP}works|source{_SEP}code{_SEP}form|contents{_SEP}of{_SEP}this{_SEP}file|invariant{_SEP}sections|acceptance{_SEP}of|creative{_SEP}commons|reserved{_SEP}font|third{_SEP}parties|unauthori[sz]ed|to{_SEP}deal{_SEP}with|in{_SEP}writing|x{_SEP}consortium"


def rules() -> list[tuple[int, str, str, int, float, str]]:
    """(number, label, keyword, priority, score, pattern) of every rule, in order."""
    made = [(label, keyword, p, s, form.replace("{name}", name)) for p, s, form in FORMS for label, keyword, name in NAMES]
    return [(k, *r) for k, r in enumerate([*OTHERS, *made])]


def normal(text: Column) -> Column:
    """The words between blanks, one before and one after all."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def _between(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, rule, label, priority, score, start, end) of unsuppressed detections; characters of the normal form."""
    spark = docs.sparkSession
    table = spark.createDataFrame(rules(), "rule int, label string, keyword string, priority int, score double, pattern string")
    keywords = sorted({r[2] for r in rules()})
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.where(text.rlike(GATE)).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), normal(F.col(text_col)).alias("norm"), F.monotonically_increasing_id().alias("row"))
    found = found.select("*", F.explode(F.array_intersect(F.split("norm", " "), F.array(*map(F.lit, keywords)))).alias("keyword"))
    found = found.join(F.broadcast(table), "keyword")  # the rules: a few hundred rows
    found = found.where(F.expr("norm rlike concat('(?<= )(?:', pattern, ')(?= )')"))
    # \G holds each search to where the last match ended: else the rest of a text is tried from every place
    whole = F.concat(F.lit(r"(?s)\G(.*?)(?<= )("), F.col("pattern"), F.lit(")(?= )"))
    pieces = F.arrays_zip(F.regexp_extract_all("norm", whole, F.lit(1)).alias("gap"), F.regexp_extract_all("norm", whole, F.lit(2)).alias("hit"))
    each = found.select("row", "id", "key", "rule", "label", "priority", "score", F.posexplode(pieces).alias("n", "p")).select("*", F.length("p.gap").alias("gap"), F.length("p.hit").alias("hit")).drop("p")
    of_rule = W.partitionBy("row", "rule").orderBy("n")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(of_rule)).withColumn("start", F.col("end") - F.col("hit"))
    # outer intervals come first; among equals the better priority, then the earlier rule
    before = W.partitionBy("row").orderBy("start", F.col("end").desc(), "priority", "rule").rowsBetween(W.unboundedPreceding, -1)
    levels = sorted({r[3] for r in rules()})
    reach = {p: F.max(F.when(F.col("priority") <= p, F.col("end"))).over(before) for p in levels}
    covered = F.coalesce(*[F.when(F.col("priority") == p, reach[p]) for p in levels])
    each = each.withColumn("covered", covered)
    return each.where("covered is null or covered < end").drop("covered", "gap", "hit", "n", "row").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    any_base = _between("|".join(p for p, _ in BASE))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), n_words(F.col(text_col)).alias("n_words"), F.when(text.rlike("(?i)license"), normal(F.col(text_col))).alias("norm"))
    count = [F.coalesce(F.regexp_count("norm", F.lit(_between(p))), F.lit(0)).cast("long").alias(f"c{k}") for k, (p, _) in enumerate(BASE)]

    def place(pattern: str) -> Column:
        head = F.regexp_extract("norm", pattern, 1)
        return F.when(F.col("n_base") > 0, F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit(""))) - 1).cast("long")

    rows = rows.select("id", "key", "n_words", "norm", *count).withColumn("n_base", sum(F.col(f"c{k}") for k in range(len(BASE))))
    base = F.array_compact(F.array(*[F.when(F.col(f"c{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    rows = rows.select("id", "key", "n_words", "n_base", place(f"(?s)^(.*?){any_base}").alias("first_word"), place(f"(?s)^(.*){any_base}").alias("last_word"), base.alias("base"))
    more = detections(docs, id_col, text_col).groupBy("id", "key").agg(F.collect_set("label").alias("more"), F.max("score").alias("best")).withColumnsRenamed({"id": "id2", "key": "key2"})
    both = rows.join(more, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.7)).otherwise(F.lit(0.0)))
    none = F.array().cast("array<string>")
    return both.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", listed(F.col("base")).alias("base_labels"), listed(F.concat("base", F.coalesce("more", none))).alias("labels"), score.alias("score"))
