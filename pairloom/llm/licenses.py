"""License scans: ordered signature rules over the words of whole texts.

A text becomes its lower-case words with one space around each. A keyword automaton
reads that once; only rules one of whose keywords occurs run their regex. Detections
are resolved by priority: one that lies within the interval of a detection of higher
priority (or of the same priority and longer) is suppressed. The base phrases are
found apart from this and always stay.

Defined results: a null or wordless text has no places, no labels and score 0;
repeated rows are each reported; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm.words import ALNUM_LOWER

#: Phrases whose places are counted, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int  # smaller is stronger
    weight: float  # how sure a detection makes the label
    keywords: tuple[str, ...]
    pattern: re.Pattern[str]


#: The names under which licenses are written, on lower-case words: label, name regex, identifier regex, keywords of which one must occur.
NAMES: list[tuple[str, str, str, tuple[str, ...]]] = [
    ("mit", r"(?:mit|expat|x11)", r"mit", ("mit", "expat", "x11")),
    ("mit-0", r"mit no attribution", r"mit 0", ("mit",)),
    ("apache-1.1", r"apache (?:software )?license (?:version |v ?)?1 1", r"apache 1 1", ("apache",)),
    ("apache-2", r"apache (?:software )?(?:license )?(?:version |v ?)?2(?: 0)?", r"apache 2 0", ("apache",)),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd", r"bsd 2 clause", ("bsd", "freebsd")),
    ("bsd-3-clause", r"(?:new|revised|modified|3 clause|three clause) bsd", r"bsd 3 clause", ("bsd",)),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd", r"bsd 4 clause", ("bsd",)),
    ("0bsd", r"(?:zero clause|0 clause) bsd", r"0bsd", ("bsd", "0bsd")),
    ("isc", r"isc", r"isc", ("isc",)),
    ("zlib", r"zlib(?: libpng)?", r"zlib", ("zlib",)),
    ("boost-1", r"boost software(?: license)?(?: version)?(?: 1 0)?", r"bsl 1 0", ("boost", "bsl")),
    ("gpl-1", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v ?)1(?: 0)?", r"gpl 1 0", ("gpl", "public", "gplv1")),
    ("gpl-2", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v ?)2(?: 0)?", r"gpl 2 0", ("gpl", "public", "gplv2")),
    ("gpl-3", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v ?)3(?: 0)?", r"gpl 3 0", ("gpl", "public", "gplv3")),
    ("lgpl-2", r"(?:gnu )?(?:library general public license|lgpl) ?(?:version |v ?)2(?: 0)?", r"lgpl 2 0", ("lgpl", "library", "lgplv2")),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v ?)2 1", r"lgpl 2 1", ("lgpl", "lesser", "lgplv2")),
    ("lgpl-3", r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v ?)3(?: 0)?", r"lgpl 3 0", ("lgpl", "lesser", "lgplv3")),
    ("agpl-3", r"(?:gnu )?(?:affero general public license|agpl) ?(?:version |v ?)3(?: 0)?", r"agpl 3 0", ("agpl", "affero", "agplv3")),
    ("gfdl", r"(?:gnu )?free documentation", r"gfdl 1 [123]", ("documentation", "gfdl")),
    ("mpl-1.1", r"mozilla public license (?:version |v ?)?1 1", r"mpl 1 1", ("mozilla", "mpl")),
    ("mpl-2", r"mozilla public license (?:version |v ?)?2(?: 0)?", r"mpl 2 0", ("mozilla", "mpl")),
    ("epl-1", r"eclipse public license (?:version |v ?)?1(?: 0)?", r"epl 1 0", ("eclipse", "epl")),
    ("epl-2", r"eclipse public license (?:version |v ?)?2(?: 0)?", r"epl 2 0", ("eclipse", "epl")),
    ("edl-1", r"eclipse distribution(?: license)?(?: version)? 1 0", r"bsd 3 clause edl", ("eclipse", "edl")),
    ("cddl-1", r"common development and distribution(?: license)?(?: version)?(?: 1 0)?", r"cddl 1 [01]", ("cddl", "distribution")),
    ("cpl-1", r"common public(?: license)?(?: version)? 1 0", r"cpl 1 0", ("cpl", "common")),
    ("eupl", r"european union public", r"eupl 1 [12]", ("eupl", "european")),
    ("osl-3", r"open software(?: license)?(?: version)? 3 0", r"osl 3 0", ("osl", "software")),
    ("afl-3", r"academic free(?: license)?(?: version)? 3 0", r"afl 3 0", ("afl", "academic")),
    ("artistic-1", r"artistic(?: license)? 1 0", r"artistic 1 0", ("artistic",)),
    ("artistic-2", r"artistic(?: license)? 2 0", r"artistic 2 0", ("artistic",)),
    ("unlicense", r"unlicense", r"unlicense", ("unlicense",)),
    ("wtfpl", r"(?:do what the fuck you want to public|wtfpl)", r"wtfpl", ("wtfpl", "fuck")),
    ("beerware", r"beer ?ware", r"beerware", ("beer", "beerware")),
    ("postgresql", r"postgresql", r"postgresql", ("postgresql",)),
    ("python-2", r"(?:python software foundation|psf)", r"(?:psf|python) 2 0", ("python", "psf")),
    ("ruby", r"ruby", r"ruby", ("ruby",)),
    ("php-3", r"php(?: license)?(?: version)? 3 0[01]?", r"php 3 01?", ("php",)),
    ("openssl", r"openssl", r"openssl", ("openssl",)),
    ("ofl-1.1", r"(?:sil )?open font(?: license)?(?: version)?(?: 1 1)?", r"ofl 1 1", ("font", "ofl")),
    ("ms-pl", r"microsoft public", r"ms pl", ("microsoft", "ms")),
    ("ms-rl", r"microsoft reciprocal", r"ms rl", ("microsoft", "ms")),
    ("busl-1.1", r"business source(?: license)?(?: 1 1)?", r"busl 1 1", ("business", "busl")),
    ("sspl-1", r"server side public", r"sspl 1 0", ("sspl", "server")),
    ("elastic-2", r"elastic(?: license)?(?: version)? 2 0", r"elastic 2 0", ("elastic",)),
    ("commons-clause", r"commons clause", r"commons clause", ("commons",)),
    ("cc0-1", r"(?:creative commons zero|cc0)(?: 1 0)?(?: universal)?", r"cc0 1 0", ("cc0", "creative")),
    ("cc-by", r"(?:creative commons attribution|cc by)", r"cc by [1234] [05]", ("cc", "creative")),
    ("cc-by-sa", r"(?:creative commons attribution share ?alike|cc by sa)", r"cc by sa [1234] [05]", ("cc", "creative")),
    ("cc-by-nd", r"(?:creative commons attribution no ?deriv(?:s|atives)|cc by nd)", r"cc by nd [1234] [05]", ("cc", "creative")),
    ("cc-by-nc", r"(?:creative commons attribution non ?commercial|cc by nc)", r"cc by nc [1234] [05]", ("cc", "creative")),
    ("cc-by-nc-sa", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)", r"cc by nc sa [1234] [05]", ("cc", "creative")),
    ("cc-by-nc-nd", r"(?:creative commons attribution non ?commercial no ?deriv(?:s|atives)|cc by nc nd)", r"cc by nc nd [1234] [05]", ("cc", "creative")),
    ("odbl-1", r"open (?:data commons open )?database", r"odbl 1 0", ("odbl", "database")),
    ("odc-by-1", r"open data commons attribution", r"odc by 1 0", ("odc", "commons")),
    ("cdla-permissive", r"community data license agreement permissive", r"cdla permissive [12] 0", ("cdla", "community")),
    ("llama-community", r"llama (?:2 |3 |3 [123] )?community", r"llama [23]", ("llama",)),
    ("openrail", r"(?:creativeml |bigscience )?open ?rail ?m?", r"(?:creativeml |bigscience )?openrail", ("openrail", "rail")),
]

_GRANT = r"(?:(?:is |are |be |been )?(?:licensed|released|distributed|available|provided|published|covered|redistributed|dual licensed|made available)|subject to|use of this \w+ is governed by|governed by)"

#: How a name is put: form regex with {0} the name and {1} the identifier, priority, weight.
FORMS: list[tuple[str, int, float]] = [
    (r"spdx license identifier {1}(?: only| or later)?", 0, 0.99),
    (_GRANT + r" (?:only )?(?:under|by|with|to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{0}(?: license| licence)?(?: \d \d)?", 1, 0.95),
    (r"under (?:the )?(?:terms of )?(?:the )?{0}(?: license| licence)?(?: \d \d)?", 2, 0.9),
    (r"(?:the )?{0} (?:license|licence)(?: \d \d)?", 3, 0.8),
    (r"(?:license|licence|license s|licensing) (?:is |type |name |id )?(?:{0}|{1})", 4, 0.7),
]

#: Signatures that belong to one license, or to none that can be named: label, priority, weight, keywords, regex.
TEXTS: list[tuple[str, int, float, tuple[str, ...], str]] = [
    ("mit", 1, 0.97, ("permission",), r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", 1, 0.97, ("permission",), r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-3-clause", 1, 0.9, ("neither",), r"neither the name of (?:the )?\w+(?: \w+){0,8} nor the names of its contributors"),
    ("bsd-2-clause", 4, 0.7, ("redistributions",), r"redistributions of source code must retain the above copyright notice"),
    ("bsd-4-clause", 1, 0.9, ("advertising",), r"all advertising materials mentioning features or use of this software"),
    ("apache-2", 1, 0.97, ("apache",), r"(?:https? )?www apache org licenses license 2 0"),
    ("gpl-family", 5, 0.6, ("gpl", "public"), r"(?:gnu )?general public license|gpl"),
    ("gpl-2-or-later", 1, 0.95, ("gpl", "public"), r"general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3-or-later", 1, 0.95, ("gpl", "public"), r"general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("lgpl-family", 4, 0.6, ("lgpl", "lesser"), r"(?:gnu )?lesser general public license|lgpl"),
    ("agpl-family", 4, 0.6, ("agpl", "affero"), r"(?:gnu )?affero general public license|agpl"),
    ("mpl-2", 1, 0.97, ("mozilla",), r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", 1, 0.97, ("encumbered",), r"this is free and unencumbered software released into the public domain"),
    ("public-domain", 4, 0.6, ("domain",), r"(?:released |placed |dedicated )?(?:in|into|to|is in) the public domain"),
    ("zlib", 1, 0.95, ("misrepresented",), r"the origin of this software must not be misrepresented"),
    ("boost-1", 1, 0.95, ("boost",), r"www boost org license 1 0 txt"),
    ("cc-family", 5, 0.5, ("creative",), r"creative commons(?: license| licence)?"),
    ("cc-url-by", 1, 0.95, ("creativecommons",), r"creativecommons org licenses by(?= \d)"),
    ("cc-by-sa", 1, 0.95, ("creativecommons",), r"creativecommons org licenses by sa"),
    ("cc-by-nc", 1, 0.95, ("creativecommons",), r"creativecommons org licenses by nc(?= \d)"),
    ("cc-by-nc-sa", 1, 0.95, ("creativecommons",), r"creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", 1, 0.95, ("creativecommons",), r"creativecommons org licenses by nc nd"),
    ("cc-by-nd", 1, 0.95, ("creativecommons",), r"creativecommons org licenses by nd"),
    ("cc0-1", 1, 0.95, ("creativecommons",), r"creativecommons org publicdomain zero 1 0"),
    ("all-rights-reserved", 4, 0.7, ("reserved",), r"all rights reserved"),
    ("proprietary", 4, 0.7, ("proprietary", "confidential"), r"(?:proprietary and confidential|confidential and proprietary)(?: information)?"),
    ("license-notice", 6, 0.3, ("licensed", "license", "licence"), r"(?:licensed under|see (?:the )?license|see licence|license file)"),
]


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All signatures in order of priority, then as they are written."""
    made = [Rule(label, p, w, keys, re.compile(f" (?:{rx})(?= )")) for label, p, w, keys, rx in TEXTS]
    for label, name, ident, keys in NAMES:
        for form, p, w in FORMS:
            made.append(Rule(label, p, w, keys, re.compile(f" (?:{form.format(name, ident)})(?= )")))
    return tuple(sorted(made, key=lambda r: r.priority))


@lru_cache(maxsize=1)
def _automaton() -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    by_key: dict[str, list[int]] = {}
    for k, r in enumerate(rules()):
        for key in r.keywords:
            by_key.setdefault(key, []).append(k)
    auto = ahocorasick.Automaton()
    for key in [*by_key, *BASE]:
        auto.add_word(key, key)
    auto.make_automaton()
    return auto, by_key


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rule: Rule


def detect(canonical: str, found: set[str]) -> list[Detection]:
    """Detections that stay, by place; ``found`` holds the keywords that occur in the text."""
    _, by_key = _automaton()
    candidates = []
    for k in sorted({k for key in found for k in by_key.get(key, ())}):
        r = rules()[k]
        candidates += [Detection(m.start() + 1, m.end(), r) for m in r.pattern.finditer(canonical)]
    stay = [candidates[k] for k in unsuppressed([(d.start, d.end, d.rule.priority) for d in candidates])]
    return sorted(stay, key=lambda d: (d.start, d.end, d.rule.label))


def unsuppressed(spans: list[tuple[int, int, int]]) -> list[int]:
    """Places of the (start, end, priority) that lie in no other of a smaller or, if they are not longer, equal priority.

    Of equal ones the first stays. One sort and one running maximum for each priority.
    """
    if not spans:
        return []
    start, end, priority = np.array(spans, np.int64).T
    stays = np.zeros(len(spans), bool)
    for p in np.unique(priority):
        k = np.flatnonzero(stays | (priority == p))  # what a suppressed one holds lies in what suppressed it
        k = k[np.lexsort((k, priority[k], -end[k], start[k]))]
        reach = np.concatenate(([-1], np.maximum.accumulate(end[k])[:-1]))
        stays[k[(priority[k] == p) & (reach < end[k])]] = True
    return np.flatnonzero(stays).tolist()


def _word_of(canonical: str, places: list[int]) -> list[int]:
    """How many spaces of the text lie before each place."""
    lengths = np.fromiter(map(len, canonical.split(" ")), np.int64)
    return np.searchsorted(np.cumsum(lengths + 1) - 1, places, "left").tolist()


def scan_text(text: str | None) -> tuple[int, list[tuple[int, str]], list[Detection], str]:
    """Number of words, places of base phrases as (word, label), detections, and the text that they index."""
    got = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    canonical = f" {b' '.join(got).decode('utf-8', 'replace')} "
    auto, _ = _automaton()
    found = {key for _, key in auto.iter(canonical)}
    if not found:
        return len(got), [], [], canonical
    base = []
    for phrase, label in BASE.items():
        at = canonical.find(f" {phrase} ") if phrase in found else -1
        while at >= 0:
            base.append((at, label))
            at = canonical.find(f" {phrase} ", at + 1)
    base = list(zip(_word_of(canonical, [at for at, _ in base]), (label for _, label in base))) if base else []
    return len(got), sorted(base), detect(canonical, found), canonical


_TABLE = ALNUM_LOWER.tobytes()
_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,weight:double>>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("weight", pa.float64())]))]


def _row(text: str | None) -> tuple:
    n, base, found, canonical = scan_text(text)
    first = _word_of(canonical, [d.start - 1 for d in found]) if found else []
    last = _word_of(canonical, [d.end for d in found]) if found else []
    spans = [{"label": d.rule.label, "first": a, "last": b - 1, "weight": d.rule.weight} for d, a, b in zip(found, first, last)]
    own = sorted({label for _, label in base})
    rest = 1.0
    for weight in [*(d.rule.weight for d in found), *(0.9 for _ in own)]:
        rest *= 1 - weight
    labels = sorted({*own, *(d.rule.label for d in found)})
    return n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(own), ",".join(labels), 1 - rest if labels else 0.0, spans


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``docs``: counts and places of the base phrases, all labels, a score and the spans; no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [_row(t.as_py()) for t in part.column(1)]
                more = [pa.array([f[k] for f in found], t) for k, t in enumerate(_TYPES)]
                yield pa.RecordBatch.from_arrays([part.column(0), *more], names=["id", *[x.split()[0] for x in _OUT.split(", ")[:7]], "spans"])

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return slim.mapInArrow(scan, f"id {slim.schema['id'].dataType.simpleString()}, {_OUT}").withColumnRenamed("id", id_col)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
