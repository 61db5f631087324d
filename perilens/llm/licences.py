"""Operator 10: licences named in a text, by known licence sentences and rules over their sequence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licences that are read from a lone SPDX identifier; other tags and expressions give SPDX-tag.
SPDX = (
    "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later"
    " AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause MPL-2.0 ISC Zlib EPL-1.0 EPL-2.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0"
).split()

#: Known licence sentences in full, normalised, and their identifiers.
KNOWN = {
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "MITasis",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSDpre",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSDbinary",
    "licensed under the apache license, version 2.0 (the license)": "Apache2named",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopyAt",
    "this font software is licensed under the sil open font license, version 1.1": "OFLnamed",
    "this license is copied below, and is also available with a faq at": "OFLcopied",
    "the artistic license 2.0": "Artistic2text",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "all rights reserved": "AllRights",
}

#: Patterns for the licence sentences that name their licence in many ways. (identifier, pattern that a whole normalised
#: sentence must match). None has two open ends in a row that can trade characters, and none repeats a group of alternatives but possessively.
SENTENCES = [
    ("Denied", r"(.* )?(not|never|nor|neither|cannot be|cant be|isnt|arent|wasnt|no longer) (be |been |being |yet |longer )?(re)?(licensed|relicensed|released|distributed|available|covered|provided|published)( \w+){0,3} under .*"),
    ("DualApacheMIT", r"(.* )?under (either |both )?(of )?(the )?(terms of )?(either |both )?(of )?(the )?apache( licen[sc]e)?,? ?(\(?(version |v)?2(\.0)?\)?)?( licen[sc]e)?[^.;]{0,80} (or|and) (the )?mit( licen[sc]e)?([ ;,:(].*)?"),
    ("DualApacheMIT", r"(.* )?under (either |both )?(of )?(the )?(terms of )?(either |both )?(of )?(the )?mit( licen[sc]e)?[^.;]{0,80} (or|and) (the )?apache( licen[sc]e)?([ ;,:(].*)?"),
    ("DualMITGPL2", r"(.* )?under (either |both )?(of )?(the )?(terms of )?(either |both )?(of )?(the )?mit( licen[sc]e)?[^.;]{0,40} (or|and) (the )?(gnu general public licen[sc]e|gnu gpl|gpl),? ?(version |v)?2(\.0)?([ ;,:(].*)?"),
    ("OFLnamed", r"(.* )?under (the )?(terms of the )?(sil )?open font licen[sc]e(,? (version |v)?1\.1)?([ ;,:(].*)?"),
    ("OFLtext", r"(.* )?sil open font licen[sc]e,? version 1\.1( - 26 february 2007)?"),
    ("Artistic2named", r"(.* )?under (the )?(terms of )?(the )?artistic licen[sc]e,? (version |v)?2(\.0)?([ ;,:(].*)?"),
    ("Artistic2text", r"(the )?artistic licen[sc]e,? (version |v)?2\.0"),
    ("CDDLnamed", r"(.* )?(subject to|under) the terms of the common development and distribution licen[sc]e([ ;,:(].*)?"),
    ("CDDL11text", r"(.* )?common development and distribution licen[sc]e( \(cddl\))?,?( -)? version 1\.1"),
    ("CDDL10text", r"(.* )?common development and distribution licen[sc]e( \(cddl\))?,?( -)? version 1\.0"),
    ("LGPL2plus", r"(.* )?(gnu (lesser|library) general public licen[sc]e|gnu lgpl|lgpl),? ?(version |v)?2(\.0)?(\+|,? or (\(at your option\) )?(any )?later).*"),
    ("LGPLfree2plus", r"(.* )?is free software(;|:|,)? you can redistribute it and/or modify it under the terms of the gnu (lesser|library) general public licen[sc]e,? as published by the free software foundation[;,]? either version 2(\.0)? of the licen[sc]e, or.*"),
    ("MITnamed", r"(.* )?under (the )?(terms of the )?(mit|expat) licen[sc]e([ ;,:(].*)?"),
    ("BoostGrant", r"(.* )?permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation.*"),
    ("BoostNamed", r"(.* )?under (the )?(terms of the )?boost software licen[sc]e,?( -)?( version| v)? ?1\.0([ ;,:(].*)?"),
    ("MITgrant", r"(.* )?permission is hereby granted, free of charge, to any person obtaining a copy of this software.*"),
    ("MITnotice", r"(.* )?the above copyright notice and this permission notice shall be included in all copies.*"),
    ("MITasis", r"(.* )?the software is provided as is, without warranty of any kind.*"),
    ("Apache2text", r"(.* )?apache licen[sc]e version 2\.0, january 2004.*"),
    ("Apache2named", r"(.* )?under (the )?(terms of the )?apache licen[sc]e,? (version |v)?2(\.0)?([ ;,:(].*)?"),
    ("ApacheComply", r"(.* )?you may not use (this file|these files) except in compliance with the licen[sc]e"),
    ("ApacheCopyAt", r"(.* )?you may obtain a copy of the licen[sc]e at.*"),
    ("ApacheAsIs", r"(.* )?unless required by applicable law or agreed to in writing, software.*"),
    ("AGPL3text", r"(.* )?gnu affero general public licen[sc]e version 3, 19 november 2007.*"),
    ("LGPL21text", r"(.* )?gnu lesser general public licen[sc]e version 2\.1, february 1999.*"),
    ("LGPL3text", r"(.* )?gnu lesser general public licen[sc]e version 3, 29 june 2007.*"),
    ("GPL2text", r"(.* )?gnu general public licen[sc]e version 2, june 1991.*"),
    ("GPL3text", r"(.* )?gnu general public licen[sc]e version 3, 29 june 2007.*"),
    ("GPL3plus", r"(.* )?(gnu general public licen[sc]e|gnu gpl|(?<!l|a)gpl),? ?(version |v)?3(\.0)?(\+|,? or (\(at your option\) )?(any )?later).*"),
    ("GPL2plus", r"(.* )?(gnu general public licen[sc]e|gnu gpl|(?<!l|a)gpl),? ?(version |v)?2(\.0)?(\+|,? or (\(at your option\) )?(any )?later).*"),
    ("GPL3only", r"(.* )?under (the )?(terms of the )?(gnu general public licen[sc]e|gnu gpl|gpl),? ?(version |v)?3(\.0)?( only)?([ ;,:(].*)?"),
    ("GPL2only", r"(.* )?under (the )?(terms of the )?(gnu general public licen[sc]e|gnu gpl|gpl),? ?(version |v)?2(\.0)?( only)?([ ;,:(].*)?"),
    ("LGPL21plus", r"(.* )?(gnu (lesser|library) general public licen[sc]e|gnu lgpl|lgpl),? ?(version |v)?2\.1(\+|,? or (\(at your option\) )?(any )?later).*"),
    ("LGPL3plus", r"(.* )?(gnu (lesser|library) general public licen[sc]e|gnu lgpl|lgpl),? ?(version |v)?3(\.0)?(\+|,? or (\(at your option\) )?(any )?later).*"),
    ("LGPL21only", r"(.* )?under (the )?(terms of the )?(gnu (lesser|library) general public licen[sc]e|gnu lgpl|lgpl),? ?(version |v)?2\.1( only)?([ ;,:(].*)?"),
    ("LGPL3only", r"(.* )?under (the )?(terms of the )?(gnu (lesser|library) general public licen[sc]e|gnu lgpl|lgpl),? ?(version |v)?3(\.0)?( only)?([ ;,:(].*)?"),
    ("AGPL3plus", r"(.* )?(gnu affero general public licen[sc]e|gnu agpl|agpl),? ?(version |v)?3(\.0)?(\+|,? or (\(at your option\) )?(any )?later).*"),
    ("AGPL3only", r"(.* )?under (the )?(terms of the )?(gnu affero general public licen[sc]e|gnu agpl|agpl),? ?(version |v)?3(\.0)?( only)?([ ;,:(].*)?"),
    ("LGPLnamed", r"(.* )?licensed under (the )?(terms of the )?(gnu (lesser|library) general public licen[sc]e|lgpl).*"),
    ("AGPLnamed", r"(.* )?licensed under (the )?(terms of the )?(gnu affero general public licen[sc]e|agpl).*"),
    ("GPLfree2plus", r"(.* )?is free software(;|:|,)? you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e,? as published by the free software foundation[;,]? either version 2(\.0)? of the licen[sc]e, or.*"),
    ("GPLfree2only", r"(.* )?is free software(;|:|,)? you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e,? as published by the free software foundation[;,]? version 2(\.0)?( of the licen[sc]e)?( only)?"),
    ("GPLfree3plus", r"(.* )?is free software(;|:|,)? you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e,? as published by the free software foundation[;,]? either version 3(\.0)? of the licen[sc]e, or.*"),
    ("GPLfree3only", r"(.* )?is free software(;|:|,)? you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e,? as published by the free software foundation[;,]? version 3(\.0)?( of the licen[sc]e)?( only)?"),
    ("LGPLfree21plus", r"(.* )?is free software(;|:|,)? you can redistribute it and/or modify it under the terms of the gnu (lesser|library) general public licen[sc]e,? as published by the free software foundation[;,]? either version 2\.1 of the licen[sc]e, or.*"),
    ("LGPLfree3plus", r"(.* )?is free software(;|:|,)? you can redistribute it and/or modify it under the terms of the gnu (lesser|library) general public licen[sc]e,? as published by the free software foundation[;,]? either version 3(\.0)? of the licen[sc]e, or.*"),
    ("AGPLfree3plus", r"(.* )?is free software(;|:|,)? you can redistribute it and/or modify it under the terms of the gnu affero general public licen[sc]e,? as published by the free software foundation[;,]? either version 3(\.0)? of the licen[sc]e, or.*"),
    ("LGPLfree", r"(.* )?is free software(;|:|,)? you can redistribute it and/or modify it under the terms of the gnu (lesser|library) general public licen[sc]e.*"),
    ("AGPLfree", r"(.* )?is free software(;|:|,)? you can redistribute it and/or modify it under the terms of the gnu affero general public licen[sc]e.*"),
    ("GPLfree", r"(.* )?is free software(;|:)? you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation.*"),
    ("GPLver2plus", r"(.* )?either version 2 of the licen[sc]e, or \(at your option\) any later version"),
    ("GPLver3plus", r"(.* )?either version 3 of the licen[sc]e, or \(at your option\) any later version"),
    ("GPLnowarranty", r"(.* )?distributed in the hope that it will be useful, but without any warranty.*"),
    ("CCBYNCSA", r"(.* )?licensed under (a |the )?(creative commons |cc )(by-nc-sa|attribution-noncommercial-sharealike)( \d\.\d)?.*"),
    ("CCBYNCND", r"(.* )?licensed under (a |the )?(creative commons |cc )(by-nc-nd|attribution-noncommercial-noderiv\w*)( \d\.\d)?.*"),
    ("CCBYNC", r"(.* )?licensed under (a |the )?(creative commons |cc )(by-nc|attribution-noncommercial)( \d\.\d)?( .*)?"),
    ("CCBYSA", r"(.* )?licensed under (a |the )?(creative commons |cc )(by-sa|attribution-sharealike)( \d\.\d)?( .*)?"),
    ("CCBYND", r"(.* )?licensed under (a |the )?(creative commons |cc )(by-nd|attribution-noderiv\w*)( \d\.\d)?( .*)?"),
    ("CCBY", r"(.* )?licensed under (a |the )?(creative commons |cc )(by|attribution)( \d\.\d)?( .*)?"),
    ("CC0", r"(?>(?:.*? )?(?:licensed|released|dedicated|waived)).* (under |to )(the )?cc0.*"),
    ("BSDpre", r"(.* )?redistribution and use in source and binary forms, with or without modification, are permitted.*"),
    ("BSDsource", r"(.* )?redistributions of source code must retain the above copyright notice.*"),
    ("BSDbinary", r"(.* )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSDadvert", r"(.* )?all advertising materials mentioning features or use of this software must display the following acknowledge?ment.*"),
    ("BSDendorse", r"(?>(?:.*? )?neither the name of ).* ?may be used to endorse or promote products.*"),
    ("BSD3named", r"(.* )?under (the |a )?(terms of the )?((bsd )?3-clause|modified|new|revised)( bsd)?( bsd)? licen[sc]e([ ;,:(].*)?"),
    ("BSD2named", r"(.* )?under (the |a )?(terms of the )?((bsd )?2-clause|simplified)( bsd)? licen[sc]e([ ;,:(].*)?"),
    ("BSDnamed", r"(.* )?(released|licensed|distributed) under (the |a )?(terms of the )?bsd( style|-style)? licen[sc]e([ ;,:(].*)?"),
    ("MPL2text", r"(.* )?mozilla public licen[sc]e,?( version| v\.?) 2\.0"),
    ("MPL2named", r"(.* )?subject to the terms of the mozilla public licen[sc]e,? (version |v\. ?|v)?2(\.0)?"),
    ("0BSDgrant", r"(.* )?permission to use, copy, modify,? (and|and/or) distribute this software for any purpose with or without fee is hereby granted"),
    ("ISCgrant", r"(.* )?permission to use, copy, modify,? (and|and/or) distribute this software for any purpose with or without fee is hereby granted.*"),
    ("ISCnamed", r"(.* )?under (the )?(terms of the )?isc licen[sc]e([ ;,:(].*)?"),
    ("PostgreSQLgrant", r"(.* )?permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted.*"),
    ("ZlibAsIs", r"(.* )?this software is provided as-is, without any express or implied warranty.*"),
    ("ZlibNamed", r"(.* )?under (the )?(terms of the )?zlib(/libpng)? licen[sc]e([ ;,:(].*)?"),
    ("EPL2text", r"(.* )?eclipse public licen[sc]e,?( -)? (version |v\.? ?)2\.0"),
    ("EPL1text", r"(.* )?eclipse public licen[sc]e,?( -)? (version |v\.? ?)1\.0"),
    ("EPL2named", r"(.* )?under the terms of the eclipse public licen[sc]e,?( -)? (version |v\. ?|v)?2(\.0)?([ ;,:(].*)?"),
    ("EPL1named", r"(.* )?under the terms of the eclipse public licen[sc]e,?( -)? (version |v\. ?|v)?1(\.0)?([ ;,:(].*)?"),
    ("EPLagreement", r"(.* )?the accompanying program is provided under the terms of this eclipse public licen[sc]e.*"),
    ("Unlicense", r"(.* )?this is free and unencumbered software released into the public domain"),
    ("WTFPL", r"(.* )?everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document, and changing it is allowed as long as the name is changed"),
    *[(f"SPDX-{x}", rf"(.* )?spdx-licen[sc]e-identifier: ?{x.lower().replace('.', '[.]')}(?![a-z0-9.+-])(?! (or|and|with) ).*") for x in SPDX],
    ("SPDX", r"(.* )?spdx-licen[sc]e-identifier: ?[a-z0-9.+-]+.*"),
    ("AllRights", r"(.* )?all rights reserved"),
]

#: Rules in order of trial. (licence, pattern over the identifiers, each one followed by a comma).
RULES = [
    ("AGPL-3.0-only", r"AGPL3text,((A?GPL\w*|[?]),)*+"),
    ("LGPL-2.1-only", r"LGPL21text,((L?GPL\w*|[?]),)*+"),
    ("LGPL-3.0-only", r"LGPL3text,((L?GPL\w*|[?]),)*+"),
    ("GPL-3.0-only", r"GPL3text,((L?GPL\w*|[?]),)*+"),
    ("GPL-2.0-only", r"GPL2text,((L?GPL\w*|[?]),)*+"),
    ("Apache-2.0", r"Apache2text,((Apache\w*|[?]),)*+"),
    ("MPL-2.0", r"MPL2text,((MPL2\w*|[?]),)*+"),
    ("EPL-2.0", r"EPL2text,((EPL\w*|[?]),)*+"),
    ("EPL-1.0", r"EPL1text,((EPL\w*|[?]),)*+"),
    ("CDDL-1.1", r"CDDL11text,((CDDL\w*|[?]),)*+"),
    ("CDDL-1.0", r"CDDL10text,((CDDL\w*|[?]),)*+"),
    ("OFL-1.1", r"OFLtext,((OFL\w*|[?]),)*+"),
    ("Artistic-2.0", r"Artistic2text,((Artistic\w*|[?]),)*+"),
    ("Apache-2.0 OR MIT", r"DualApacheMIT,(ApacheComply,)?(ApacheCopyAt,)?(ApacheAsIs,)?"),
    ("MIT OR GPL-2.0", r"DualMITGPL2,"),
    ("BSD-4-Clause", r"BSDpre,BSDsource,BSDbinary,BSDadvert,(BSDendorse,)?"),
    ("BSD-3-Clause", r"BSDpre,BSDsource,BSDbinary,BSDendorse,"),
    ("BSD-2-Clause", r"BSDpre,BSDsource,BSDbinary,"),
    ("BSL-1.0", r"BoostGrant,|BoostNamed,"),
    ("MIT", r"MITgrant,(MITnotice,)?(MITasis,)?"),
    ("Apache-2.0", r"Apache2named,(ApacheComply,)?(ApacheCopyAt,)?(ApacheAsIs,)?"),
    ("GPL-2.0-or-later", r"(GPLfree2plus|GPLfree,GPLver2plus),(GPLnowarranty,)?"),
    ("GPL-3.0-or-later", r"(GPLfree3plus|GPLfree,GPLver3plus),(GPLnowarranty,)?"),
    ("LGPL-2.0-or-later", r"(LGPLfree2plus|LGPL2plus),(GPLnowarranty,)?"),
    ("LGPL-2.1-or-later", r"(LGPLfree21plus|LGPL21plus),(GPLnowarranty,)?"),
    ("LGPL-3.0-or-later", r"(LGPLfree3plus|LGPL3plus|LGPLfree,GPLver3plus),(GPLnowarranty,)?"),
    ("AGPL-3.0-or-later", r"(AGPLfree3plus|AGPL3plus|AGPLfree,GPLver3plus),(GPLnowarranty,)?"),
    ("MIT", r"MITnamed,"),
    ("GPL-3.0-or-later", r"GPL3plus,"),
    ("GPL-2.0-or-later", r"GPL2plus,"),
    ("GPL-3.0-only", r"(GPL3only|GPLfree3only),(GPLnowarranty,)?"),
    ("GPL-2.0-only", r"(GPL2only|GPLfree2only),(GPLnowarranty,)?"),
    ("LGPL-2.1-only", r"LGPL21only,"),
    ("LGPL-3.0-only", r"LGPL3only,"),
    ("AGPL-3.0-only", r"AGPL3only,"),
    ("LGPL", r"LGPLnamed,|LGPLfree,(GPLnowarranty,)?"),
    ("AGPL", r"AGPLnamed,|AGPLfree,(GPLnowarranty,)?"),
    ("CC-BY-NC-SA", r"CCBYNCSA,"),
    ("CC-BY-NC-ND", r"CCBYNCND,"),
    ("CC-BY-NC", r"CCBYNC,"),
    ("CC-BY-SA", r"CCBYSA,"),
    ("CC-BY-ND", r"CCBYND,"),
    ("CC-BY", r"CCBY,"),
    ("CC0-1.0", r"CC0,"),
    ("BSD-3-Clause", r"BSD3named,"),
    ("BSD-2-Clause", r"BSD2named,"),
    ("BSD", r"BSDnamed,"),
    ("MPL-2.0", r"MPL2named,"),
    ("OFL-1.1", r"OFLnamed,((OFLcopied|[?]),)?"),
    ("Artistic-2.0", r"Artistic2named,"),
    ("CDDL-1.0", r"CDDLnamed,"),
    ("0BSD", r"0BSDgrant,"),
    ("ISC", r"ISCgrant,|ISCnamed,"),
    ("PostgreSQL", r"PostgreSQLgrant,"),
    ("Zlib", r"ZlibAsIs,|ZlibNamed,"),
    ("EPL-2.0", r"EPL2named,"),
    ("EPL-1.0", r"EPL1named,"),
    ("Unlicense", r"Unlicense,(MITasis,)?"),
    ("WTFPL", r"WTFPL,"),
    *[(x, rf"SPDX-{x.replace('.', '[.]')},") for x in SPDX],
    ("SPDX-tag", r"SPDX,"),
    ("Proprietary", r"AllRights,"),
]

#: A sentence without any of these is no licence sentence; one with them that no pattern knows is reported.
HINT = r"(?i)licen[sc]e|permission is hereby|permission notice|warranty|redistribution|endorse or promote|free software|of the licen|creative commons|all rights reserved|unencumbered|hereby granted|advertising materials|\bcc0\b"


@dataclass(frozen=True)
class Rules:
    """The tables of the scan; both are small parameters, compiled into the plan as literals."""

    known: tuple = tuple(KNOWN.items())
    sentences: tuple = tuple(SENTENCES)
    rules: tuple = tuple(RULES)
    hint: str = HINT


def sentences_of(text: Column) -> Column:
    """Raw sentences: cut at line ends and after . ! ? before white space (not after the v. of a version); a line that goes on joins the next one.

    A line that ends in a letter, a digit, a comma or a hyphen and is followed by a line that starts with a lower-case
    letter, a digit, "Version" or "License" continues it, as wrapped licence headers do; comment leaders (#, *, //) at a
    line's start go.
    """
    text = F.regexp_replace(text, r"(?m)^[ \t]*(?:#+|/?\*+/?|//+|--)[ \t]*", "")
    text = F.regexp_replace(text, r"(?<=[\p{L}\p{Nd},-])[ \t]*\r?\n[ \t]*(?=\p{Ll}|\p{Nd}|Version|Licen[sc]e[ ,.])", " ")
    return F.split(text, r"[\r\n]+|(?<=[.!?])(?<![ ,][vV][.])[ \t]+")


def normalised(sentence: Column) -> Column:
    """Lower case, quotes dropped, white space single, end marks cut."""
    one = F.regexp_replace(F.lower(sentence), "[\"'`‘’“”]", "")
    one = F.regexp_replace(one, r"\s+", " ")
    return F.regexp_replace(one, r"^ +|[ .;:!?]+$", "")


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs``: its licence sentences' identifiers in order, and the licences they make.

    sentence_ids: identifier per licence sentence, looked up among the known sentences, else by the first pattern that fits it, ``?`` for a
    sentence that looks like one but that neither knows. A sentence that denies a licence has an identifier that makes none, and one that offers a choice
    makes the choice. licences: by the ordered rules, each rule taking the identifiers it matches out of the sequence, so
    that a later rule sees what is left; distinct, in rule order. ``status``: NONE (no licence sentence),
    UNKNOWN (sentences but no licence), ONE or MANY. Null and empty texts give NONE; long texts are scanned
    whole, however many licence sentences they hold and however long these are (time grows with their length, the stack doesn't); equal rows give equal rows; other columns are not carried. One pass, no shuffle, no Python.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    names = F.create_map(*[F.lit(x) for pair in known.known for x in pair])

    def identifier(one: Column) -> Column:
        return F.coalesce(F.element_at(names, one), *[F.when(one.rlike(f"^(?:{p})$"), F.lit(name)) for name, p in known.sentences], F.lit("?"))

    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in known.rules])
    start = F.struct(F.col("_seq").alias("seq"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        pattern = F.concat(F.lit("(?<=^|,)(?:"), rule["p"], F.lit(")"))
        hit = F.struct(
            F.regexp_replace(state["seq"], pattern, F.lit("")).alias("seq"),
            F.array_append(state["found"], rule["name"]).alias("found"),
        )
        return F.when(F.regexp_like(state["seq"], pattern), hit).otherwise(state)

    hinted = F.filter(sentences_of(text), lambda s: s.rlike(known.hint))
    ids = F.when(text.rlike(known.hint), F.transform(F.transform(hinted, normalised), identifier)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).alias("doc_id"), ids.alias("sentence_ids"))
    rows = rows.withColumn("_seq", F.concat(F.array_join("sentence_ids", ","), F.lit(",")))
    found = F.when(F.size("sentence_ids") > 0, F.array_distinct(F.aggregate(table, start, apply, lambda s: s["found"])))
    rows = rows.withColumn("licences", F.coalesce(found, F.array().cast("array<string>")))
    # A reservation of rights stands in the header of most licences; it counts where there is none.
    rows = rows.withColumn("licences", F.when(F.size("licences") > 1, F.array_remove("licences", "Proprietary")).otherwise(F.col("licences")))
    status = (
        F.when(F.size("sentence_ids") == 0, "NONE")
        .when(F.size("licences") == 0, "UNKNOWN")
        .when(F.size("licences") == 1, "ONE")
        .otherwise("MANY")
    )
    return rows.select("doc_id", "sentence_ids", "licences", status.alias("status"))
