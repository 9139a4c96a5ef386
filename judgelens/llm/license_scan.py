"""License scan by ordered signature rules.

A text becomes its words (lower case, ASCII punctuation as separators) joined by
single spaces; a rule is a hand-written regular expression over that line. Rules
are gated by keywords: a rule is run only if the text has all of its keywords,
and a text without any keyword is done after one set lookup. Rules are ordered
by priority. Of two overlapping detections, one that lies inside the other is
suppressed unless its rule has the higher priority; of equal places the rule
that comes first stays. Base rules (plain phrases) are reported always.

Defined results: a null or empty text has no words, no detections and score 0;
phrases may overlap each other and every place counts; repeated rows are scanned
each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelens.llm.common import as_bytes, field_type, map_batches, pick

# Lower-cases A-Z and turns every other ASCII character that is no digit or letter into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# label, SPDX words, name, address. Names and addresses are regular expressions over folded words.
LICENSES = [
    ("mit", "mit", r"mit(?: expat)?(?: license| licence)|expat license", r"opensource org licenses mit(?: license php)?"),
    ("mit-0", "mit 0", r"mit no attribution(?: license)?", r"opensource org licenses mit 0"),
    ("apache", "apache 2 0", r"apache(?: software)? licen[sc]e(?: version)?(?: 2(?: 0)?)?", r"apache org licenses(?: license 2 0)?(?: txt| html)?"),
    ("apache", "apache 1 1", r"apache(?: software)? licen[sc]e(?: version)? 1 [01]", r"apache org licenses license 1 [01]"),
    ("gpl", "gpl 2 0(?: only| or later)?", r"gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2(?: 0)?|gnu gpl v? ?2|gplv2", r"gnu org licenses(?: old licenses)? gpl 2 0(?: html| txt)?"),
    ("gpl", "gpl 3 0(?: only| or later)?", r"gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?|gnu gpl v? ?3|gplv3", r"gnu org licenses gpl(?: 3 0)?(?: html| txt)?"),
    ("gpl", "gpl", r"(?:gnu )?general public licen[sc]e|gnu gpl", r"gnu org (?:copyleft|licenses) gpl html"),
    ("lgpl", "lgpl [23] [01](?: only| or later)?", r"(?:gnu )?(?:lesser|library) general public licen[sc]e(?: version| v)?(?: [23](?: [01])?)?|gnu lgpl|lgplv[23]", r"gnu org licenses lgpl(?: [23] [01])?(?: html)?"),
    ("agpl", "agpl 3 0(?: only| or later)?", r"(?:gnu )?affero general public licen[sc]e(?: version| v)?(?: 3(?: 0)?)?|gnu agpl|agplv3", r"gnu org licenses agpl(?: 3 0)?(?: html)?"),
    ("fdl", "gfdl 1 [123](?: only| or later)?", r"gnu free documentation licen[sc]e(?: version)?(?: 1 [123])?", r"gnu org licenses fdl(?: 1 [123])?(?: html)?"),
    ("bsd", "bsd [234] clause", r"bsd [234] clause(?: licen[sc]e)?|(?:new|modified|simplified|revised|original) bsd licen[sc]e|bsd licen[sc]e", r"opensource org licenses bsd(?: license php| [23] clause)?"),
    ("0bsd", "0bsd", r"zero clause bsd(?: licen[sc]e)?|bsd zero clause(?: licen[sc]e)?", r"opensource org licenses 0bsd"),
    ("isc", "isc", r"isc licen[sc]e", r"opensource org licenses isc(?: license)?"),
    ("mpl", "mpl [12] [01]", r"mozilla public licen[sc]e(?: version| v)?(?: [12](?: [01])?)?", r"mozilla org mpl(?: [12] 0)?"),
    ("epl", "epl [12] 0", r"eclipse public licen[sc]e(?: version| v)?(?: [12](?: 0)?)?", r"eclipse org legal epl(?: v?[12]0?| [12] 0)?(?: html)?"),
    ("edl", "edl 1 0", r"eclipse distribution licen[sc]e(?: version| v)?(?: 1(?: 0)?)?", r"eclipse org org documents edl v10(?: php)?"),
    ("cddl", "cddl 1 [01]", r"common development and distribution licen[sc]e(?: version)?(?: 1 [01])?", r"opensource org licenses cddl1(?: php)?"),
    ("cpl", "cpl 1 0", r"common public licen[sc]e(?: version)?(?: 1 0)?", r"opensource org licenses cpl1 0(?: php)?"),
    ("artistic", "artistic [12] 0", r"artistic licen[sc]e(?: version)?(?: [12](?: 0)?)?", r"perlfoundation org artistic license [12] 0"),
    ("bsl", "bsl 1 0", r"boost software licen[sc]e(?: version)?(?: 1(?: 0)?)?", r"boost org license 1 0 txt"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", r"zlib net zlib license html"),
    ("unlicense", "unlicense", r"the unlicense|released into the public domain under the unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"do what the f[a-z]* you want to public licen[sc]e", r"wtfpl net"),
    ("cc0", "cc0 1 0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero(?: v?1 0)?(?: universal)?", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", "cc by [1234] [05]", r"(?:cc by|creative commons attribution)(?: licen[sc]e)?(?: [1234] [05])?(?: international| unported)?", r"creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", "cc by sa [1234] [05]", r"(?:cc by sa|creative commons attribution share ?alike)(?: licen[sc]e)?(?: [1234] [05])?(?: international| unported)?", r"creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nd", "cc by nd [1234] [05]", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1234] [05])?(?: international| unported)?", r"creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-nc", "cc by nc [1234] [05]", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1234] [05])?(?: international| unported)?", r"creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc-sa", "cc by nc sa [1234] [05]", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1234] [05])?(?: international| unported)?", r"creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "cc by nc nd [1234] [05]", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1234] [05])?(?: international| unported)?", r"creativecommons org licenses by nc nd [1234] [05]"),
    ("public-domain", "pddl 1 0", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain|public domain dedication", r"creativecommons org publicdomain mark 1 0"),
    ("odbl", "odbl 1 0", r"open (?:data commons open )?database licen[sc]e(?: v?1 0)?", r"opendatacommons org licenses odbl"),
    ("odc-by", "odc by 1 0", r"open data commons attribution licen[sc]e(?: v?1 0)?", r"opendatacommons org licenses by"),
    ("cdla", "cdla (?:permissive|sharing) [12] 0", r"community data licen[sc]e agreement(?: permissive| sharing)?(?: version)?(?: [12] 0)?", r"cdla (?:dev|io)"),
    ("ofl", "ofl 1 [01]", r"sil open font licen[sc]e(?: version)?(?: 1 [01])?", r"scripts sil org ofl"),
    ("eupl", "eupl 1 [012]", r"european union public licen[sc]e(?: v| version)? ?(?:1 [012])?", r"joinup ec europa eu collection eupl"),
    ("osl", "osl [123] [01]", r"open software licen[sc]e(?: v| version)? ?(?:[123] [01])?", r"opensource org licenses osl 3 0(?: php)?"),
    ("afl", "afl [123] [01]", r"academic free licen[sc]e(?: v| version)? ?(?:[123] [01])?", r"opensource org licenses afl 3 0(?: php)?"),
    ("ms-pl", "ms pl", r"microsoft public licen[sc]e", r"opensource org licenses ms pl"),
    ("ms-rl", "ms rl", r"microsoft reciprocal licen[sc]e", r"opensource org licenses ms rl"),
    ("upl", "upl 1 0", r"universal permissive licen[sc]e(?: v| version)? ?(?:1 0)?", r"oss oracle com licenses upl"),
    ("psf", "psf 2 0|python 2 0", r"python software foundation licen[sc]e(?: version 2)?", r"docs python org [23] license html"),
    ("php", "php 3 0[1]?", r"php licen[sc]e(?: version 3 01?)?", r"php net license 3 01? txt"),
    ("openssl", "openssl", r"openssl licen[sc]e", r"openssl org source license html"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", r"opensource org licenses postgresql"),
    ("vim", "vim", r"vim licen[sc]e", r"vimhelp org uganda txt html"),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[sc]e|ncsa licen[sc]e", r"opensource org licenses uoi ncsa(?: php)?"),
    ("busl", "busl 1 1", r"business source licen[sc]e(?: version)?(?: 1 1)?", r"mariadb com bsl11"),
    ("sspl", "sspl 1 0", r"server side public licen[sc]e(?: version| v)?(?: 1)?", r"mongodb com licensing server side public license"),
    ("elastic", "elastic 2 0", r"elastic licen[sc]e(?: version)?(?: 2 0)?", r"elastic co licensing elastic license"),
    ("openrail", "openrail|creativeml openrail m", r"(?:creativeml )?open ?rail(?: m)?(?: licen[sc]e)?|responsible ai licen[sc]e", r"huggingface co spaces bigscience license"),
]
# How a license is named. {spdx}, {name} and {url} stand for the columns above; the number is the priority.
FORMS = [
    ("spdx", 95, r"spdx license identifier (?:{spdx})", ("spdx",)),
    ("granted", 90, r"(?:licensed|released|distributed|available|published|provided|covered|redistribute it(?: and or modify it)?) under (?:the terms of )?(?:the )?(?:{name}|{spdx})(?: licen[sc]e)?", ("under",)),
    ("address", 80, r"(?:https? )?(?:www )?(?:{url})", ()),
    ("declared", 75, r"licen[sc]e(?: is| text)?(?: the)? (?:{spdx})", ()),
    ("name", 60, r"(?:the )?(?:{name})", ()),
]
# Openings and conditions of license texts: label, priority, keywords, expression. Words joined by | replace each other.
TEXTS = [
    ("mit", 85, ("hereby", "granted"), r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 85, ("permission", "hereby"), r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 85, ("redistribution", "binary"), r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache", 85, ("reproduction", "distribution"), r"terms and conditions for use reproduction and distribution"),
    ("gpl", 85, ("copyleft",), r"free copyleft license for software"),
    ("gpl", 85, ("redistribute", "gnu"), r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl", 85, ("source", "mozilla"), r"this source code form is subject to the terms of the mozilla public license"),
    ("zlib", 85, ("altered",), r"altered source versions must be plainly marked as such"),
    ("bsl", 85, ("boost",), r"boost software license version 1 0"),
    ("unlicense", 85, ("unencumbered",), r"this is free and unencumbered software released into the public domain"),
    ("proprietary", 40, ("rights", "reserved"), r"all rights reserved"),
    ("proprietary", 45, ("confidential",), r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 45, ("unauthorized", "copying"), r"unauthorized copying of this (?:file|document|software)"),
    ("copyright", 30, ("copyright",), r"copyright (?:c )?(?:[12][0-9]{3}(?: [12][0-9]{3})*)"),
    ("unknown", 20, ("licensed",), r"licensed under(?: the)?(?: terms of)?"),
    ("unknown", 20, ("license|licence",), r"see (?:the )?licen[sc]e(?: file)?(?: for details)?"),
]
BASE_PRIORITY = 50
SPAN = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.StringType()) for n in ("label", "rule")]
        + [T.StructField(n, T.IntegerType()) for n in ("priority", "first_word", "last_word", "start", "end")]
        + [T.StructField(n, T.BooleanType()) for n in ("base", "suppressed")]
    )
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    keywords: tuple[bytes, ...]  # the text must have all of these
    hints: tuple[bytes, ...]  # and one of these
    pattern: re.Pattern
    base: bool = False


# Words of which every license name has one, where no single word is sure.
HINTS = tuple("license licence licensed gpl bsd cc0 cc spdx creative unlicense openrail rail gplv2 gplv3 lgpl lgplv2 lgplv3 agpl agplv3 domain ncsa expat license1 licence1 license2 licence2 license3 licence3".split())


def _rule(name, label, priority, keywords, hints, text, base=False) -> Rule:
    bounded = re.compile(rb"(?<![^ ])(?:" + text.encode() + rb")(?![^ ])")
    return Rule(name, label, priority, tuple(k.encode() for k in keywords), tuple(h.encode() for h in hints), bounded, base)


def _fixed_words(expression: str) -> tuple[str, ...]:
    """Whole words that every match of the expression must hold, longest first; none if it has alternatives.

    Groups, classes and optional characters become a mark, and a word that touches one is not counted:
    it may be part of a longer word.
    """
    plain, before = expression, None
    while plain != before:
        before, plain = plain, re.sub(r"\(\?:[^()]*\)(?:[?*+]|\{[^}]*\})?", "\0", plain)
    plain = re.sub(r"(?:\[[^\]]*\]|.)(?:[?*+]|\{[^}]*\})|\[[^\]]*\]", "\0", plain)
    if "|" in plain:
        return ()
    return tuple(sorted((w for w in plain.split(" ") if re.fullmatch("[a-z0-9]{3,}", w)), key=len, reverse=True))


def build_rules() -> list[Rule]:
    """All rules, highest priority first; order in the tables breaks ties."""
    rules = [_rule(f"phrase:{phrase}", label, BASE_PRIORITY, phrase.split(), phrase.split()[-1:], phrase, True) for phrase, label in BASE_PHRASES.items()]
    for label, spdx, name, url in LICENSES:
        for form, priority, shape, keywords in FORMS:
            own = _fixed_words({"address": url, "name": name}.get(form, "|"))
            hints = own[:1] or (*HINTS, *re.findall(r"(?:^|\|)([a-z0-9]+)", spdx))
            rules.append(_rule(f"{form}:{label}", label, priority, (*keywords, *own), hints, shape.format(spdx=spdx, name=name, url=url)))
    rules += [_rule(f"text:{label}", label, priority, keywords[:-1], keywords[-1].split("|"), text) for label, priority, keywords, text in TEXTS]
    return sorted(rules, key=lambda r: -r.priority)


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        self.rules = rules or build_rules()
        self.by_word: dict[bytes, list[int]] = defaultdict(list)
        for number, rule in enumerate(self.rules):
            for word in rule.hints:
                self.by_word[word].append(number)
        self.words = frozenset(self.by_word)

    def find(self, words: list[bytes]) -> list[dict]:
        """Detections in a list of folded words, in rule order, suppressed ones marked."""
        if self.words.isdisjoint(words):
            return []
        present = set(words)
        due = sorted({n for w in self.words & present for n in self.by_word[w] if present.issuperset(self.rules[n].keywords)})
        line, found = b" ".join(words), []
        for n in due:
            rule = self.rules[n]
            for match in rule.pattern.finditer(line):
                start, end = match.span()
                while start < end and line[start] == 32:
                    start += 1
                while end > start and line[end - 1] == 32:
                    end -= 1
                first = line.count(b" ", 0, start)
                found.append({"label": rule.label, "rule": rule.name, "priority": rule.priority, "first_word": first, "last_word": first + line.count(b" ", start, end), "base": rule.base})
        return suppress(found)


def suppress(found: list[dict]) -> list[dict]:
    """Mark detections that lie inside another one of at least their priority.

    Sorted by start and then by falling end, an interval can only lie inside an
    earlier one; of each priority only the interval that reaches furthest matters.
    """
    reach: dict[int, int] = {}
    order = sorted(range(len(found)), key=lambda k: (found[k]["first_word"], -found[k]["last_word"], -found[k]["priority"], k))
    for k in order:
        x = found[k]
        x["suppressed"] = any(p >= x["priority"] and far >= x["last_word"] for p, far in reach.items())
        reach[x["priority"]] = max(reach.get(x["priority"], -1), x["last_word"])
    return found


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    """One scanner per worker process."""
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_words, detections``.

    A detection has label, rule, priority, its words (both ends included), its
    characters in the text (end excluded), and whether it is a base phrase or suppressed.
    """

    def scan(batch: pa.RecordBatch) -> pa.Table:
        counts, found = [], []
        for raw in as_bytes(batch.column("text")):
            words = raw.translate(FOLD).split()
            counts.append(len(words))
            spans = scanner().find(words)
            if spans:
                ends = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
                for x in spans:
                    x["start"] = len(raw[: ends[x["first_word"]][0]].decode())
                    x["end"] = x["start"] + len(raw[ends[x["first_word"]][0] : ends[x["last_word"]][1]].decode())
            found.append(spans)
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.table({"doc_id": batch.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "detections": pa.array(found, to_arrow_type(SPAN))})

    schema = T.StructType([T.StructField("doc_id", field_type(docs, id_col)), T.StructField("n_words", T.LongType()), T.StructField("detections", SPAN)])
    return map_batches(pick(docs, doc_id=id_col, text=text_col), scan, schema)


def license_report(detections: DataFrame) -> DataFrame:
    """Digest of ``scan_licenses``: base places, labels and the confidence of the best detection."""
    base = F.filter("detections", lambda x: x["base"])
    kept = F.filter("detections", lambda x: x["base"] | ~x["suppressed"])
    labels = lambda spans: F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    return detections.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first_word"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first_word"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(kept).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda x: x["priority"])) / 100.0, F.lit(0.0)).alias("score"),
        F.size(F.filter("detections", lambda x: x["suppressed"])).cast("long").alias("n_suppressed"),
    )
