"""License scans: identifier tags and notice phrases found with an Aho-Corasick
automaton, licence expressions evaluated with a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_bytes, sliced

#: The contract's phrases and labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Notice phrases (as words) with their identifier and weight.
NOTICES = {
    "mit license": ("mit", 0.8),
    "apache license": ("apache", 0.7),
    "apache license version 2 0": ("apache-2.0", 0.9),
    "general public license": ("gpl", 0.7),
    "general public license version 2": ("gpl-2.0", 0.9),
    "general public license version 3": ("gpl-3.0", 0.9),
    "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "bsd license": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "cc by 4 0": ("cc-by-4.0", 0.9),
    "cc by sa 4 0": ("cc-by-sa-4.0", 0.9),
    "cc by nc 4 0": ("cc-by-nc-4.0", 0.9),
    "creative commons attribution": ("cc-by", 0.6),
    "all rights reserved": ("proprietary", 0.5),
}

TAG = "spdx license identifier"

#: Identifiers (their stems too) that training on is allowed for by default.
PERMISSIVE = frozenset({"mit", "apache", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "cc-by", "cc-by-4.0", "cc0-1.0", "unlicense", "zlib"})

#: Licence identifiers that a tag may name, beside the notices' and the permissive.
OTHERS = frozenset(
    """
    0bsd afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later artistic-1.0 artistic-2.0 bsd-2-clause-patent bsd-4-clause
    bsl-1.0 cc-by-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0
    epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0+ gpl-2.0-only gpl-2.0-or-later gpl-3.0+ gpl-3.0-only
    gpl-3.0-or-later hpnd lgpl-2.0 lgpl-2.1 lgpl-2.1+ lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later
    mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl ncsa ofl-1.1 openssl osl-3.0 php-3.01 postgresql python-2.0 ruby sspl-1.0 upl-1.0 vim
    w3c wtfpl x11 zpl-2.1
    """.split()
)
KNOWN = PERMISSIVE | OTHERS | {label for label, _ in NOTICES.values()} - {"proprietary"}

_TAG = b"spdx-license-identifier"
_TAG_VALUE = re.compile(rb"[ \t]*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+|\S")
_BINDS = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[str] | None:
    """Reverse Polish form of a licence expression, or None if it is malformed.

    with binds tighter than and, and tighter than or; all group to the left.
    Comment closers after the expression end it.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand is due
    for token in _TOKEN.findall(text.split("*/")[0].split("-->")[0]):
        word = token.lower()
        if word == "(":
            if not operand:
                return None
            stack.append(word)
        elif word == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif word in _BINDS:
            if operand:
                return None
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif not re.fullmatch(r"[a-z0-9.+:-]*[a-z0-9][a-z0-9.+:-]*", word) or not operand:
            return None
        else:
            out.append(word)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(rpn: list[str], allowed: frozenset[str]) -> bool | None:
    """Whether an expression can be met with allowed licences; an exception given
    by with doesn't take rights away. None where with stands beside a group."""
    stack: list[tuple[bool, bool]] = []  # met, and whether it is a plain identifier
    for token in rpn:
        if token not in _BINDS:
            stack.append((token in allowed, True))
            continue
        (b, b_plain), (a, a_plain) = stack.pop(), stack.pop()
        if token == "with":
            if not (a_plain and b_plain):
                return None
            stack.append((a, False))
        else:
            stack.append(((a and b) if token == "and" else (a or b), False))
    return stack[0][0]


def identifiers(rpn: list[str]) -> list[str]:
    """The licences of an expression, without exceptions after with."""
    out: list[tuple[str, ...]] = []
    for token in rpn:
        if token in _BINDS:
            b, a = out.pop(), out.pop()
            out.append(a if token == "with" else a + b)
        else:
            out.append((token,))
    return list(out[0])


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(data: bytes, allowed: frozenset[str] = PERMISSIVE) -> tuple[int, list[dict], list[dict]]:
    """Words, notices and tags' expressions of one text as UTF-8."""
    flat = alnum_bytes(data)
    words = flat.split()
    # Every word ends in one space, so neighbouring phrases can share it.
    joined = b" " + b" ".join(words) + b" "
    found = [(end - len(phrase) - 1, phrase) for end, phrase in _automaton().iter(joined.decode("latin-1"))] if words else []
    if not found:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begins = None  # where words begin in the text
    notices, expressions = [], []
    for at, phrase in found:
        first = int(np.searchsorted(spaces, at))
        if phrase != TAG:
            label, weight = NOTICES[phrase]
            notices.append({"label": label, "base_label": BASE_PHRASES.get(phrase), "first": first, "last": first + phrase.count(" "), "weight": weight})
            continue
        if begins is None:
            blank = np.frombuffer(flat, np.uint8) == 32
            begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        stop = int(begins[first]) + len(_TAG)
        value = _TAG_VALUE.match(data, stop) if data[begins[first] : stop].lower() == _TAG else None
        if value:
            text = value[1].decode("utf-8", "replace")
            rpn = parse_expression(text)
            met = evaluate(rpn, allowed) if rpn else None
            ids = identifiers(rpn) if met is not None else []
            expressions.append({"expression": text.strip(), "valid": met is not None, "permitted": met, "ids": [x for x in ids if x in KNOWN], "unknown": [x for x in ids if x not in KNOWN]})
    return len(words), notices, expressions


_NOTICE = pa.struct([("label", pa.string()), ("base_label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("weight", pa.float64())])
_EXPRESSION = pa.struct([("expression", pa.string()), ("valid", pa.bool_()), ("permitted", pa.bool_()), ("ids", pa.list_(pa.string())), ("unknown", pa.list_(pa.string()))])
_OUT = "doc_id {id}, n_words long, notices array<struct<label:string,base_label:string,first:long,last:long,weight:double>>, expressions array<struct<expression:string,valid:boolean,permitted:boolean,ids:array<string>,unknown:array<string>>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: frozenset[str] = PERMISSIVE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, notices (label, word places,
    weight) in text order and the expressions of identifier tags, whose identifiers are
    in KNOWN (ids) or not (unknown).

    Null and empty texts have no words; repeated rows give repeated rows; other
    columns of docs are not read. One pass without a shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [scan_text(t or b"", allowed) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(_NOTICE)), pa.array([r[2] for r in rows], pa.list_(_EXPRESSION))],
                ["doc_id", "n_words", "notices", "expressions"],
            )

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(scan, _OUT.format(id=id_type))


def license_report(scanned: DataFrame) -> DataFrame:
    """A row of labels and a score for each scanned document.

    score: 1 minus the product of (1 - weight) over the distinct labels; a valid
    tag of a known identifier weighs 1, an unknown one nothing: it is no label, and
    unknown_ids reports it. permitted: every expression can be met and every notice's label
    is allowed; null without any.
    """
    base = F.filter("notices", lambda n: n["base_label"].isNotNull())
    tagged = F.flatten(F.transform("expressions", lambda e: e["ids"]))
    best = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform("notices", lambda n: n["label"])),
            lambda label: F.struct(label, F.array_max(F.transform(F.filter("notices", lambda n: n["label"] == label), lambda n: n["weight"]))),
        )
    )
    missing = F.aggregate(F.map_values(best), F.lit(1.0), lambda acc, w: acc * (1 - w))
    score = F.when(F.size(tagged) > 0, F.lit(1.0)).otherwise(1.0 - missing)
    allowed = F.array(*[F.lit(x) for x in sorted(PERMISSIVE)])
    permitted = F.forall("expressions", lambda e: F.coalesce(e["permitted"], F.lit(False))) & F.forall("notices", lambda n: F.array_contains(allowed, n["label"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda n: n["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda n: n["first"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda n: n["base_label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.transform(base, lambda n: n["base_label"]), F.transform("notices", lambda n: n["label"]), tagged))), ",").alias("labels"),
        score.alias("score"),
        F.size("expressions").cast("long").alias("n_tags"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("expressions", lambda e: e["unknown"])))), ",").alias("unknown_ids"),
        F.when((F.size("notices") > 0) | (F.size("expressions") > 0), permitted).alias("permitted"),
    )
