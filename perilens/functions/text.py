"""Column functions for names, addresses, URLs, tags, classes and content hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str

#: Common character references, in order of replacement (the ampersand last).
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
#: Full-width forms of ASCII and their plain ones.
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
PLAIN = "".join(chr(c) for c in range(0x21, 0x7F))


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_of(text: Col, words: Sequence[str]) -> Column:
    """Whether a text holds any of the words; missing text holds none."""
    t = _c(text)
    return F.coalesce(reduce(lambda a, b: a | b, [t.contains(w) for w in words], F.lit(False)), F.lit(False))


def strip_tags(text: Col) -> Column:
    """Tags to spaces, common character references decoded, white space single and trimmed."""
    out = F.regexp_replace(F.coalesce(_c(text), F.lit("")), "<[^>]+>", " ")
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def compact(text: Col) -> Column:
    """For comparison: no white space, full-width ASCII plain, lower case, 臺 as 台 (``udfs.compact_exact`` has all of NFKC)."""
    t = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[\s　]+", "")
    return F.lower(F.translate(t, WIDE + "臺", PLAIN + "台"))


#: Rules of the three name normalisers, (pattern, replacement) in order.
NAME_RULES = {
    "listing": ((r"\((?:委託|委由|由).*?\)$", ""), (r"^(?:臺|台)灣省", ""), (r"^.{2,3}[縣市](?:私立|立|公立)?", ""), (r"^(?:私立|公立)", "")),
    "directory": ((r"^(?:財團法人|社團法人)", ""), (r"幼稚園", "幼兒園"), (r"國民小學", "國小"), (r"附設幼兒園", "附幼")),
    "matcher": ((r"\s+", ""), ("新北市立|新北市|市立|縣立|公立", ""), ("幼稚園", "幼兒園"), ("(?:附設幼兒園|附設幼稚園|幼兒園|幼稚園|附幼)$", "")),
}


def normal_name(name: Col, rules: Sequence[tuple[str, str]] = NAME_RULES["listing"]) -> Column:
    out = F.trim(F.translate(F.coalesce(_c(name), F.lit("")), WIDE, PLAIN))
    for pattern, new in rules:
        out = F.trim(F.regexp_replace(out, pattern, new))
    return out


def aliases(name: Col, suffix: str = "幼兒園", rules: Sequence[tuple[str, str]] = NAME_RULES["listing"], least: int = 4) -> Column:
    """Distinct comparison forms of a name, in order: official, short, stem with suffix, stem; short ones left out."""
    short = normal_name(name, rules)
    stem = F.regexp_replace(short, f"{suffix}$", "")
    forms = F.array(*[compact(x) for x in (_c(name), short, F.concat(stem, F.lit(suffix)), stem)])
    return F.array_distinct(F.filter(forms, lambda x: F.length(x) >= least))


def host(url: Col) -> Column:
    return F.lower(F.try_parse_url(_c(url), F.lit("HOST")))


def canonical_url(url: Col, drop: Sequence[str] = ("fbclid", "gclid"), credentials: bool = True) -> Column:
    """http(s) with a host: lower scheme and authority, tracking parameters and fragment dropped, path at least '/'.

    Missing for anything else; with ``credentials=False`` also for a URL that carries a user name. Parameters
    keep their spelling.
    """
    u = F.trim(_c(url))
    part = lambda x: F.try_parse_url(u, F.lit(x))
    tracked = lambda p: F.lower(p).startswith("utm_") | F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*drop)
    query = F.array_join(F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~tracked(p)), "&")
    path = F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/"))
    whole = F.concat(F.lower(part("PROTOCOL")), F.lit("://"), F.lower(part("AUTHORITY")), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    ok = F.lower(part("PROTOCOL")).isin("http", "https") & part("HOST").isNotNull()
    if not credentials:
        ok = ok & part("USERINFO").isNull()
    return F.when(ok, whole)


def host_in(url: Col, domains: Sequence[str]) -> Column:
    """The host is one of the domains or below one."""
    h = host(url)
    return F.coalesce(reduce(lambda a, b: a | b, [(h == d) | h.endswith("." + d) for d in domains], F.lit(False)), F.lit(False))


def official_host(url: Col, suffixes: Sequence[str] = (".gov.tw", ".edu.tw")) -> Column:
    h = host(url)
    return F.coalesce(reduce(lambda a, b: a | b, [h.endswith(s) for s in suffixes]), F.lit(False))


def verified(flag: Col, internal: Col, url: Col, suffixes: Sequence[str] = (".gov.tw", ".edu.tw")) -> Column:
    return F.coalesce(_c(flag), F.lit(False)) & (F.coalesce(_c(internal), F.lit(False)) | official_host(url, suffixes))


def rule_tags(text: Col, rules: Mapping[str, tuple[float, Sequence[str]]]) -> Column:
    """Tags whose any keyword occurs, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(any_of(text, words), F.lit(tag)) for tag, (_, words) in rules.items()]))


def tag_weights(rules: Mapping[str, tuple[float, Sequence[str]]]) -> Column:
    return F.create_map(*[F.lit(x) for tag, (weight, _) in rules.items() for x in (tag, float(weight))])


def content_hash(*fields: Col, separator: str = "|", zero_is_blank: Sequence[int] = ()) -> Column:
    """SHA-256 of the fields joined by a separator; missing ones count as empty, and so does 0 at ``zero_is_blank``."""
    parts = []
    for i, f in enumerate(fields):
        text = F.coalesce(_c(f).cast("string"), F.lit(""))
        parts.append(F.when(text == "0", "").otherwise(text) if i in zero_is_blank else text)
    return F.sha2(F.concat_ws(separator, *parts).cast("binary"), 256)


def key_hash(*fields: Col) -> Column:
    """SHA-1 of the fields joined by U+0001, missing as empty: the identity of a record without a number."""
    return F.sha1(F.concat_ws("\u0001", *[F.coalesce(_c(f).cast("string"), F.lit("")) for f in fields]).cast("binary"))


def source_id(name: Col, address: Col) -> Column:
    return F.left(content_hash(F.trim(_c(name)), F.trim(_c(address))), F.lit(16))


def normal_address(address: Col) -> Column:
    """White space and a leading postal code dropped."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(address), F.lit("")), r"\s+", ""), r"^\d{3,6}", "")


def normal_phone(phone: Col) -> Column:
    """Digits and a leading plus sign; blank gives missing."""
    return F.nullif(F.regexp_replace(F.coalesce(_c(phone), F.lit("")), r"(?<!^)\+|[^0-9+]", ""), F.lit(""))


def official_name(school: Col, kind: Col, suffix: str = "附設幼兒園") -> Column:
    """School name with the suffix, unless it has it already or names a kindergarten of its own."""
    s = F.trim(_c(school))
    return F.when(s.contains("幼兒園") | s.contains("幼稚園"), s).when(F.coalesce(_c(kind), F.lit("")).contains("附設"), F.concat(s, F.lit(suffix))).otherwise(s)


def district(value: Col, address: Col, districts: Sequence[str], alias: Mapping[str, str] | None = None, suffix: str = "區", unknown: str = "UNKNOWN") -> Column:
    """A listed district: the value (with the suffix if it lacks it), else the left-most one in the address, else an alias."""
    v = F.trim(F.coalesce(_c(value), F.lit("")))
    listed = F.when(v.isin(*districts), v).when(F.concat(v, F.lit(suffix)).isin(*districts), F.concat(v, F.lit(suffix)))
    found = F.nullif(F.regexp_extract(F.coalesce(_c(address), F.lit("")), "(" + "|".join(districts) + ")", 1), F.lit(""))
    named = F.create_map(*[F.lit(x) for kv in (alias or {"": unknown}).items() for x in kv])[v]
    return F.coalesce(listed, found, named, F.lit(unknown))


#: Official type values and the name words of the ownership classes.
TYPE_FIELD = {
    "公立": "PUBLIC", "私立": "PRIVATE", "非營利": "NONPROFIT", "準公共": "QUASI_PUBLIC", "非營利幼兒園": "NONPROFIT",
    "社區互助式": "NONPROFIT", "職場互助式": "NONPROFIT", "公立幼兒園": "PUBLIC", "私立幼兒園": "PRIVATE",
}
NAME_WORDS = {
    "NONPROFIT": ("非營利", "社區互助", "職場互助"),
    "QUASI_PUBLIC": ("準公共",),
    "PUBLIC": ("市立", "公立", "國民小學附設", "國小附設", "縣立"),
    "PRIVATE": ("私立", "財團法人", "社團法人", "教會", "基督教", "天主教", "佛教"),
}


def ownership(*fields: Col, names: Sequence[Col], field_map: Mapping[str, str] = TYPE_FIELD, words: Mapping[str, Sequence[str]] = NAME_WORDS) -> Column:
    """The class by the first official field that names one, else by words of the names; public and private words give PRIVATE."""
    table = F.create_map(*[F.lit(x) for kv in field_map.items() for x in kv])
    by_field = [table[F.trim(_c(f))] for f in fields]
    text = F.concat_ws(" ", *[_c(n) for n in names])
    private = any_of(text, words["PRIVATE"])
    by_name = (
        F.when(any_of(text, words["NONPROFIT"]), "NONPROFIT")
        .when(any_of(text, words["QUASI_PUBLIC"]), "QUASI_PUBLIC")
        .when(any_of(text, words["PUBLIC"]) & ~private, "PUBLIC")
        .when(private, "PRIVATE")
        .otherwise("UNKNOWN")
    )
    return F.coalesce(*by_field, by_name)


def first_class(text: Col, classes: Sequence[tuple[str, Sequence[str]]], default: str = "UNKNOWN") -> Column:
    """The earlier generation's rule: the first class, in order, of which a keyword occurs."""
    return F.coalesce(*[F.when(any_of(text, words), F.lit(name)) for name, words in classes], F.lit(default))


def name_parts(name: Col) -> Column:
    """struct<school, own>: the school before an attached kindergarten's suffix, and the name without a [01] number."""
    n = F.trim(F.regexp_replace(F.coalesce(_c(name), F.lit("")), r"^\[\d+\]", ""))
    school = F.nullif(F.regexp_extract(n, "^(.+?(?:國小|國民小學|國中|國民中學|高中))", 1), F.lit(""))
    return F.struct(school.alias("school"), n.alias("own"))


def charset_similarity(a: Col, b: Col) -> Column:
    """Common distinct characters over the larger set; 0 where either is empty."""
    x, y = (F.array_distinct(F.filter(F.split(F.coalesce(_c(t), F.lit("")), ""), lambda ch: ch != "")) for t in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.greatest(F.size(x), F.size(y))), F.lit(0.0))


def escape_markdown(text: Col) -> Column:
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"([\\`*_{}\[\]()#+\-.!|>])", r"\\$1")


def json_in(text: Col, schema: str) -> Column:
    """The object of a model's answer: from a fenced block, else between the outermost braces; no object is missing."""
    t = _c(text)
    fenced = F.nullif(F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    outer = F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.from_json(F.coalesce(fenced, outer), schema)
