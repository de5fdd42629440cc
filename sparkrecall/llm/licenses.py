"""License scan: ordered signature rules over normalised words, as one projection without a shuffle.

The rules are hand-written: about 175 names of licences, and each of them behind each of eight phrases that grant one,
the SPDX tags and `license x` of their labels, and a few whole sentences; 1,700 rules are that product.

A text is normalised to its words. A first filter looks for any of a few stems, parts of single words; texts without one have
no detection and are not normalised. In the others, every word that leads a rule opens a window as long as the longest
signature. One regex for all rules of that lead, anchored at the window's start, says whether any fits; only then are the rules
tried one by one, those whose keyword is in the window. At one place the rule of the highest priority wins, then the longest
match, then the order of the rules. Of two detections one of which contains the other, that of lower priority goes, and of
equal priority the inner one. Base phrases are counted before that, and their labels always stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.llm.common import documents, let, lower_ascii

#: What words don't hold, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a text as it is.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_LIC = "licen[cs]e"
_V = "(?:v|version |ver |v )?"
_OR = "(?: or (?:at your option )?(?:any )?later(?: version)?| only)?"
_CC = "(?:cc|creative commons)(?: licen[cs]e)?"


@dataclass(frozen=True)
class Name:
    """How a licence is named: label, lead (first word), keyword (must be in the window), regex from the lead on."""

    label: str
    lead: str
    keyword: str
    regex: str


def _names() -> list[Name]:
    n = Name
    out = [
        n("gpl", "gnu", "gnu", f"gnu (?:general public {_LIC}|gpl)"),
        n("gpl-1.0", "gnu", "1", f"gnu (?:general public {_LIC}|gpl)(?: as published by the free software foundation)?(?: either)? {_V}1(?: 0)?{_OR}"),
        n("gpl-2.0", "gnu", "2", f"gnu (?:general public {_LIC}|gpl)(?: as published by the free software foundation)?(?: either)? {_V}2(?: 0)?{_OR}"),
        n("gpl-3.0", "gnu", "3", f"gnu (?:general public {_LIC}|gpl)(?: as published by the free software foundation)?(?: either)? {_V}3(?: 0)?{_OR}"),
        n("gpl-2.0", "gpl", "2", f"gpl {_V}2(?: 0)?{_OR}"),
        n("gpl-3.0", "gpl", "3", f"gpl {_V}3(?: 0)?{_OR}"),
        n("gpl-2.0", "gplv2", "gplv2", "gplv2"),
        n("gpl-3.0", "gplv3", "gplv3", "gplv3"),
        n("lgpl", "gnu", "gnu", f"gnu (?:lesser|library) general public {_LIC}"),
        n("lgpl-2.0", "gnu", "2", f"gnu library general public {_LIC} {_V}2(?: 0)?{_OR}"),
        n("lgpl-2.1", "gnu", "2 1", f"gnu lesser general public {_LIC}(?: as published by the free software foundation)?(?: either)? {_V}2 1{_OR}"),
        n("lgpl-3.0", "gnu", "3", f"gnu lesser general public {_LIC}(?: as published by the free software foundation)?(?: either)? {_V}3(?: 0)?{_OR}"),
        n("lgpl-2.1", "lgpl", "2 1", f"lgpl {_V}2 1{_OR}"),
        n("lgpl-3.0", "lgpl", "3", f"lgpl {_V}3(?: 0)?{_OR}"),
        n("lgpl-2.1", "lgplv2", "lgplv2", "lgplv2(?: 1)?"),
        n("lgpl-3.0", "lgplv3", "lgplv3", "lgplv3"),
        n("agpl", "gnu", "affero", f"gnu affero general public {_LIC}"),
        n("agpl-3.0", "gnu", "affero", f"gnu affero general public {_LIC}(?: as published by the free software foundation)?(?: either)? {_V}3(?: 0)?{_OR}"),
        n("agpl-3.0", "agpl", "3", f"agpl {_V}3(?: 0)?{_OR}"),
        n("agpl-3.0", "agplv3", "agplv3", "agplv3"),
        n("gfdl", "gnu", "documentation", f"gnu free documentation {_LIC}"),
        n("gfdl-1.2", "gnu", "documentation", f"gnu free documentation {_LIC} {_V}1 2{_OR}"),
        n("gfdl-1.3", "gnu", "documentation", f"gnu free documentation {_LIC} {_V}1 3{_OR}"),
        n("apache", "apache", "apache", f"apache (?:software )?{_LIC}"),
        n("apache-1.0", "apache", "1 0", f"apache (?:software )?{_LIC} {_V}1 0"),
        n("apache-1.1", "apache", "1 1", f"apache (?:software )?{_LIC} {_V}1 1"),
        n("apache-2.0", "apache", "2", f"apache (?:software )?{_LIC} {_V}2(?: 0)?"),
        n("apache-2.0", "apache", "2 0", "apache 2 0(?: licen[cs]e)?"),
        n("mit", "mit", "mit", f"mit(?: style)? {_LIC}"),
        n("mit", "mit", "expat", f"mit expat {_LIC}"),
        n("mit", "expat", "expat", f"expat {_LIC}"),
        n("mit-0", "mit", "attribution", f"mit no attribution {_LIC}"),
        n("x11", "x11", "x11", f"x11 {_LIC}"),
        n("isc", "isc", "isc", f"isc {_LIC}"),
        n("bsd", "bsd", "bsd", f"bsd(?: style)? {_LIC}"),
        n("0bsd", "0bsd", "0bsd", "0bsd(?: licen[cs]e)?"),
        n("0bsd", "zero", "bsd", f"zero clause bsd {_LIC}"),
        n("bsd-2-clause", "bsd", "2", f"bsd 2 clause(?: {_LIC})?"),
        n("bsd-3-clause", "bsd", "3", f"bsd 3 clause(?: {_LIC})?"),
        n("bsd-4-clause", "bsd", "4", f"bsd 4 clause(?: {_LIC})?"),
        n("bsd-2-clause", "2", "bsd", f"2 clause bsd(?: {_LIC})?"),
        n("bsd-3-clause", "3", "bsd", f"3 clause bsd(?: {_LIC})?"),
        n("bsd-2-clause", "simplified", "bsd", f"simplified bsd {_LIC}"),
        n("bsd-3-clause", "modified", "bsd", f"modified bsd {_LIC}"),
        n("bsd-3-clause", "new", "bsd", f"new bsd {_LIC}"),
        n("mpl", "mozilla", "mozilla", f"mozilla public {_LIC}"),
        n("mpl-1.1", "mozilla", "1 1", f"mozilla public {_LIC} {_V}1 1"),
        n("mpl-2.0", "mozilla", "2", f"mozilla public {_LIC} {_V}2(?: 0)?"),
        n("mpl-2.0", "mpl", "2", f"mpl {_V}2(?: 0)?"),
        n("epl", "eclipse", "eclipse", f"eclipse public {_LIC}"),
        n("epl-1.0", "eclipse", "1", f"eclipse public {_LIC} {_V}1(?: 0)?"),
        n("epl-2.0", "eclipse", "2", f"eclipse public {_LIC} {_V}2(?: 0)?"),
        n("cpl-1.0", "common", "public", f"common public {_LIC}(?: {_V}1(?: 0)?)?"),
        n("cddl-1.0", "common", "development", f"common development and distribution {_LIC}(?: {_V}1(?: 0)?)?"),
        n("cddl-1.0", "cddl", "cddl", f"cddl(?: {_V}1(?: 0)?)?"),
        n("eupl-1.1", "european", "1 1", f"european union public {_LIC} {_V}1 1"),
        n("eupl-1.2", "european", "union", f"european union public {_LIC}(?: {_V}1 2)?"),
        n("eupl-1.2", "eupl", "eupl", f"eupl(?: {_V}1 2)?"),
        n("artistic-1.0", "artistic", "1", f"artistic {_LIC} {_V}1(?: 0)?"),
        n("artistic-2.0", "artistic", "artistic", f"artistic {_LIC}(?: {_V}2(?: 0)?)?"),
        n("unlicense", "unlicense", "unlicense", "unlicense"),
        n("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
        n("wtfpl", "do", "fuck", "do what the fuck you want to public licen[cs]e"),
        n("zlib", "zlib", "zlib", f"zlib(?: libpng)? {_LIC}"),
        n("bsl-1.0", "boost", "boost", f"boost software {_LIC}(?: {_V}1(?: 0)?)?"),
        n("busl-1.1", "business", "source", f"business source {_LIC}(?: {_V}1 1)?"),
        n("openssl", "openssl", "openssl", f"openssl {_LIC}"),
        n("psf-2.0", "python", "foundation", f"python software foundation {_LIC}(?: {_V}2)?"),
        n("postgresql", "postgresql", "postgresql", f"postgresql {_LIC}"),
        n("ofl-1.1", "sil", "font", f"sil open font {_LIC}(?: {_V}1 1)?"),
        n("ofl-1.1", "open", "font", f"open font {_LIC}(?: {_V}1 1)?"),
        n("odbl-1.0", "open", "database", f"open database {_LIC}(?: {_V}1(?: 0)?)?"),
        n("odbl-1.0", "odbl", "odbl", "odbl(?: 1 0)?"),
        n("odc-by-1.0", "open", "attribution", f"open data commons attribution {_LIC}(?: {_V}1(?: 0)?)?"),
        n("odc-by-1.0", "odc", "odc", "odc by(?: 1 0)?"),
        n("pddl-1.0", "public", "dedication", "public domain dedication and licen[cs]e"),
        n("public-domain", "public", "domain", "public domain(?: dedication)?"),
        n("cdla-permissive-1.0", "community", "permissive", f"community data {_LIC} agreement permissive(?: {_V}1(?: 0)?)?"),
        n("cdla-sharing-1.0", "community", "sharing", f"community data {_LIC} agreement sharing(?: {_V}1(?: 0)?)?"),
        n("openrail", "openrail", "openrail", "openrail(?: m)?"),
        n("openrail", "responsible", "ai", f"responsible ai {_LIC}s?"),
        n("ms-pl", "microsoft", "public", f"microsoft public {_LIC}"),
        n("ms-rl", "microsoft", "reciprocal", f"microsoft reciprocal {_LIC}"),
        n("vim", "vim", "vim", f"vim {_LIC}"),
        n("php-3.01", "php", "php", f"php {_LIC}(?: {_V}3 01)?"),
        n("ruby", "ruby", "ruby", f"ruby {_LIC}"),
        n("w3c", "w3c", "w3c", f"w3c (?:software )?(?:notice and )?{_LIC}"),
        n("ncsa", "university", "illinois", f"university of illinois(?: ncsa)? open source {_LIC}"),
        n("afl-3.0", "academic", "free", f"academic free {_LIC}(?: {_V}3(?: 0)?)?"),
        n("ecl-2.0", "educational", "community", f"educational community {_LIC}(?: {_V}2(?: 0)?)?"),
        n("osl-3.0", "open", "software", f"open software {_LIC}(?: {_V}3(?: 0)?)?"),
        n("ogl-3.0", "open", "government", f"open government {_LIC}(?: {_V}3(?: 0)?)?"),
        n("sspl-1.0", "server", "side", f"server side public {_LIC}(?: {_V}1)?"),
        n("elastic-2.0", "elastic", "elastic", f"elastic {_LIC}(?: {_V}2(?: 0)?)?"),
        n("upl-1.0", "universal", "permissive", f"universal permissive {_LIC}(?: {_V}1(?: 0)?)?"),
        n("cc0-1.0", "cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
        n("cc0-1.0", "creative", "zero", "creative commons zero(?: v?1 0)?(?: universal)?"),
        n("cc-pdm-1.0", "creative", "mark", "creative commons public domain mark(?: 1 0)?"),
        n("creative-commons", "creative", "commons", "creative commons"),
    ]
    long = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        short, words = kind.replace("-", " "), " ".join(long[x] for x in kind.split("-"))
        for version in ("", "1.0", "2.0", "2.5", "3.0", "4.0"):
            number = version.replace(".", " ")
            tail = f" (?:v|version )?{number}(?: international| unported| generic)?" if version else ""
            label = f"cc-{kind}" + (f"-{version}" if version else "")
            out.append(n(label, "cc", number or "cc", f"cc {short}{tail}"))
            out.append(n(label, "creative", number or "creative", f"creative commons (?:{short}|{words})(?: {_LIC})?{tail}"))
    return out


#: (lead, words before the licence's name, priority, weight) of the phrases that grant a licence.
GRANTS = (
    ("licensed", "licensed (?:to you )?under (?:the )?(?:terms of (?:the )?)?", 80, 0.95),
    ("released", "released under (?:the )?(?:terms of (?:the )?)?", 78, 0.9),
    ("distributed", "distributed under (?:the )?(?:terms of (?:the )?)?", 76, 0.9),
    ("available", "available under (?:the )?(?:terms of (?:the )?)?", 74, 0.9),
    ("published", "published under (?:the )?(?:terms of (?:the )?)?", 72, 0.85),
    ("covered", "covered by (?:the )?(?:terms of (?:the )?)?", 70, 0.85),
    ("governed", "governed by (?:the )?(?:terms of (?:the )?)?", 70, 0.85),
    ("subject", "subject to (?:the )?(?:terms (?:and conditions )?of (?:the )?)?", 68, 0.85),
)


@dataclass(frozen=True)
class Rule:
    """label, lead (first word), keyword (must be in the window), regex over words parted by one blank each, standing."""

    label: str
    lead: str
    keyword: str
    regex: str
    priority: int
    weight: float
    base: bool


def rules() -> list[Rule]:
    """All rules, in order; the first of equal standing wins."""
    out = [Rule(label, phrase.split()[0], phrase.split()[-1], phrase, 50, 0.6, True) for phrase, label in BASE.items()]
    names = _names()
    for lead, before, priority, weight in GRANTS:
        out += [Rule(n.label, lead, n.keyword if n.keyword.isalpha() else n.lead, before + n.regex, priority, weight, False) for n in names]
    out += [Rule(n.label, n.lead, n.keyword, n.regex, 50, 0.6, False) for n in names]
    for label in dict.fromkeys(n.label for n in names):
        words = label.replace("-", " ").replace(".", " ")
        out.append(Rule(label, "spdx", words.split()[0], f"spdx licen[cs]e identifier {words}(?: only| or later)?", 90, 0.99, False))
        out.append(Rule(label, "license", words.split()[0], f"license {words}", 60, 0.7, False))
    out += [
        Rule("proprietary", "all", "rights", "all rights reserved", 40, 0.5, False),
        Rule("mit", "permission", "granted", "permission is hereby granted free of charge to any person obtaining a copy of this software", 85, 0.95, False),
        Rule("isc", "permission", "purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 85, 0.95, False),
        Rule("bsd", "redistribution", "forms", "redistribution and use in source and binary forms with or without modification are permitted", 85, 0.95, False),
        Rule("unlicense", "this", "unencumbered", "this is free and unencumbered software released into the public domain", 85, 0.95, False),
    ]
    return out


def examples(regex: str) -> tuple[str, str]:
    """The texts with the fewest and the most words that one of the rules' regexes matches: these are made of letters,
    blanks, [..], (?:..|..) and ?."""

    def more(x: str, y: str) -> bool:
        return (x.count(" "), len(x)) > (y.count(" "), len(y))

    def choice(i: int) -> tuple[int, str, str]:
        least = most = None
        low = high = ""
        while True:
            if i == len(regex) or regex[i] in "|)":
                least = low if least is None or more(least, low) else least
                most = high if most is None or more(high, most) else most
                if i == len(regex) or regex[i] == ")":
                    return i, least, most
                low = high = ""
                i += 1
                continue
            if regex.startswith("(?:", i):
                i, x, y = choice(i + 3)
                i += 1
            elif regex[i] == "[":
                x = y = regex[i + 1]
                i = regex.index("]", i) + 1
            else:
                x = y = regex[i]
                i += 1
            if i < len(regex) and regex[i] == "?":
                x, i = "", i + 1
            low, high = low + x, high + y

    return choice(0)[1:]


#: Every rule needs one of these within a word; the second ones are whole words.
STEMS = "licen gnu gpl apache creative cc0 bsd wtfpl cddl eupl odbl odc domain openrail spdx rights permission redistribution".split()
SHORT = "cc mpl".split()


def _any_stem(raw: Column) -> Column:
    """Whether a text holds a stem, its letters of any case. Other letters may change too; the texts that are scanned don't."""
    short = rf"(?:^|{SEPARATORS})(?:{'|'.join(SHORT)})(?:{SEPARATORS}|$)"
    return let(F.lower(raw), lambda low: reduce(lambda x, y: x | y, [F.contains(low, F.lit(x)) for x in STEMS]) | (reduce(lambda x, y: x | y, [F.contains(low, F.lit(x)) for x in SHORT]) & low.rlike(short)))


def window_of(all_rules: list[Rule]) -> int:
    """Words of the longest text that any rule matches."""
    return max(len(examples(r.regex)[1].split()) for r in all_rules)


def _by_lead(all_rules: list[Rule]) -> dict[str, list[tuple[int, Rule]]]:
    out: dict[str, list[tuple[int, Rule]]] = {}
    for i, r in enumerate(all_rules):
        out.setdefault(r.lead, []).append((i, r))
    return out


def _rule_map(all_rules: list[Rule]) -> Column:
    """Lead to its rules, as one literal that the parser makes."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    one = lambda i, r: f"struct({i},{quoted(r.label)},{quoted(r.keyword)},{quoted(f'^(?:{r.regex})(?= |$)')},{r.priority},{r.weight}D,{str(r.base).lower()})"
    entries = [f"{quoted(lead)},array({','.join(one(i, r) for i, r in some)})" for lead, some in _by_lead(all_rules).items()]
    return F.expr(f"map({','.join(entries)})").cast("map<string,array<struct<i:int,label:string,keyword:string,regex:string,priority:int,weight:double,base:boolean>>>")


def _fits_any(text: Column, lead: Column, all_rules: list[Rule]) -> Column:
    """Whether any rule of that lead matches at the text's start. Regexes that begin alike are not taken apart."""
    out = F.lit(False)
    for word, some in sorted(_by_lead(all_rules).items(), reverse=True):
        out = F.when(lead == word, text.rlike(f"^(?:{'|'.join(dict.fromkeys(r.regex for _, r in some))})(?= |$)")).otherwise(out)
    return out


def _detections(words: Column, all_rules: list[Rule]) -> Column:
    """array of (at array, base, found) for each word that leads a rule: base holds the base phrases' labels there,
    found the winner."""
    leads = sorted({r.lead for r in all_rules})
    table, longest = _rule_map(all_rules), window_of(all_rules)
    places = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: s["w"].isin(leads))

    def at(place: Column) -> Column:
        window = F.concat_ws(" ", F.slice(words, place["i"] + 1, longest))

        def matched(text: Column) -> Column:
            tried = F.filter(F.element_at(table, place["w"]), lambda r: F.contains(text, r["keyword"]) & F.regexp_like(text, r["regex"]))
            return F.transform(
                tried,
                lambda r: F.struct(
                    place["i"].alias("start"),
                    (place["i"] + F.size(F.split(F.regexp_substr(text, r["regex"]), " "))).alias("end"),  # behind the last word
                    *(r[x].alias(x) for x in ("i", "label", "priority", "weight", "base")),
                ),
            )

        none = F.array().cast("array<struct<start:int,end:int,i:int,label:string,priority:int,weight:double,base:boolean>>")
        return let(window, lambda text: F.when(_fits_any(text, place["w"], all_rules), matched(text)).otherwise(none))

    def best(found: Column) -> Column:
        order = lambda x: F.struct(x["priority"], x["end"], -x["i"])
        return F.struct(
            F.filter(found, lambda x: x["base"]).alias("base"),
            F.aggregate(found, found[0], lambda best_, x: F.when(order(x) > order(best_), x).otherwise(best_)).alias("found"),
        )

    return F.transform(F.filter(F.transform(places, at), lambda found: F.size(found) > 0), best)


def _standing(found: Column, longest: int) -> Column:
    """The detections that no other suppresses. There is one at most at each place, none longer than `longest` words, so
    what contains or is contained is among as many before and behind."""

    def loses(d: Column, e: Column) -> Column:
        inside = (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & (e["start"] != d["start"])
        around = (d["start"] < e["start"]) & (d["end"] >= e["end"])
        return (inside & (e["priority"] >= d["priority"])) | (around & (e["priority"] > d["priority"]))

    return F.filter(found, lambda d, i: ~F.exists(F.slice(found, F.greatest(i - longest + 1, F.lit(1)), 2 * longest), lambda e: loses(d, e)))


def license_scan(docs: DataFrame, text: str = "text", all_rules: list[Rule] | None = None) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word bigint, base_labels, labels string, score double.

    n_words counts the words; n_base all places of base phrases, first_word and last_word their least and greatest first
    word (from 0; else null). labels are those of the base phrases and of the standing detections, distinct, sorted,
    comma-joined; score is the largest weight of these, 0 without any. Null, empty and wordless texts: 0 words, no
    labels, empty strings. Rows don't depend on one another; other columns stay, those named like the results are replaced.
    """
    all_rules = all_rules or rules()
    raw = F.coalesce(F.col(text), F.lit(""))
    words = F.split(F.trim(F.regexp_replace(lower_ascii(raw), SEPARATORS, " ")), " ")

    def result(places: Column) -> Column:
        def from_standing(found: Column) -> Column:
            base = F.flatten(F.transform(places, lambda p: p["base"]))

            def packed(base: Column) -> Column:
                own = F.array_sort(F.array_distinct(F.transform(base, lambda b: b["label"])))
                both = F.array_sort(F.array_union(own, F.transform(found, lambda d: d["label"])))
                weights = F.concat(F.transform(base, lambda b: b["weight"]), F.transform(found, lambda d: d["weight"]))
                return F.struct(
                    F.size(base).cast("long").alias("n_base"),
                    F.array_min(F.transform(base, lambda b: b["start"])).cast("long").alias("first_word"),
                    F.array_max(F.transform(base, lambda b: b["start"])).cast("long").alias("last_word"),
                    F.array_join(own, ",").alias("base_labels"),
                    F.array_join(both, ",").alias("labels"),
                    F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
                )

            return let(base, packed)

        return let(let(F.transform(places, lambda p: p["found"]), lambda f: _standing(f, window_of(all_rules))), from_standing)

    scanned = let(words, lambda w: let(_detections(w, all_rules), result))
    nothing = F.struct(F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    names = ("n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = docs.drop("n_words", *names, "__scan")
    out = kept.withColumn("n_words", F.regexp_count(raw, F.lit(RAW_WORD)).cast("long")).withColumn("__scan", F.when(_any_stem(raw), scanned).otherwise(nothing))
    return out.select(*kept.columns, "n_words", *(F.col(f"__scan.{x}").alias(x) for x in names))


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("text")
