"""License scan: tags and phrases by an Aho-Corasick automaton, licence expressions by a shunting-yard parser.

The automaton runs over the words of a whole text, lower-cased and one blank apart, and finds phrases of words wherever
they stand, overlapping ones too. Identifier tags are found by the same automaton; the expression after a tag is read
from the original text up to the end of its line and turned into reverse Polish order (``with`` joins a licence with its
exception, ``and`` binds tighter than ``or``), from which its labels and its canonical form follow.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm import tokens as T

#: Phrases whose places count, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Phrases that add a label.
MORE = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "mit license": "mit",
    "apache license": "apache",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "boost software license": "bsl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons zero": "cc0",
    "public domain dedication": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
_TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_PRIORITY = {"or": 1, "and": 2}


def parse_expression(text: str) -> tuple[list[str], str] | None:
    """Labels (lower-cased, sorted) and the canonical form of a licence expression, or None if it is not one.

    The longest well-formed head counts, however long, so a comment's closing mark or a sentence after the expression
    does no harm.
    """
    polish = _polish(m.group(0) for m in _TOKEN.finditer(text))
    return _evaluate(polish) if polish else None


def _polish(tokens: Iterable[str]) -> list[str | tuple[str, str]]:
    """Shunting yard, once over the tokens: the longest head in which operands and operators alternate and parentheses
    balance, in reverse Polish order; empty if there is none. An operand is a pair of a licence and its exception, ''
    without one: ``with`` takes the names on its two sides and nothing else, and where it can't, the head ends before it."""
    out, stack, operand, depth = [], [], True, 0
    size, last, rest = 0, None, []
    named, excepting = False, False  # the token before is a licence's name; it is ``with``
    for token in tokens:
        word = token.lower()
        plain = word not in _PRIORITY and word not in ("with", "(", ")")
        if excepting:
            if not plain:
                break
            out[-1] = (out[-1][0], token)
        elif word == "with":
            if not named:
                break
        elif token == "(":
            if not operand:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif word in _PRIORITY:
            if operand:
                break
            while stack and stack[-1] != "(" and _PRIORITY[stack[-1]] >= _PRIORITY[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            if not operand:
                break
            out.append((token, ""))
            operand = False
        named, excepting = plain and not excepting, word == "with" and not excepting
        if not operand and not depth and not excepting:
            # Without a parenthesis the stack holds two operators at most, their priorities rising.
            size, last, rest = len(out), out[-1], stack[::-1]
    return [*out[: size - 1], last, *rest] if size else []


def _evaluate(polish: list[str | tuple[str, str]]) -> tuple[list[str], str]:
    """Labels and canonical form: operands of a chain of one operator sorted and distinct, parentheses where needed."""
    stack: list[tuple[str, set[str]]] = []
    for token in polish:
        if isinstance(token, tuple):
            stack.append(("", {f"{token[0]} WITH {token[1]}" if token[1] else token[0]}))
            continue
        right, left = stack.pop(), stack.pop()
        # The smaller side goes into the larger one, so a chain costs about its length.
        less, more = sorted((side[1] if side[0] == token else {_shown(side, token)} for side in (left, right)), key=len)
        more |= less
        stack.append((token, more))
    return sorted({t[0].lower() for t in polish if isinstance(t, tuple)}), _shown(stack.pop(), "")


def _shown(part: tuple[str, set[str]], above: str) -> str:
    text = f" {part[0].upper()} ".join(sorted(part[1]))
    return f"({text})" if above == "and" and part[0] == "or" and len(part[1]) > 1 else text


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *MORE, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


_TO_BLANK = bytes(b if b else 0x20 for b in T.ALNUM.tolist())


def scan_text(text: str, automaton) -> dict:
    """What one text holds; see ``scan_licenses``."""
    words = b" ".join(text.encode().translate(_TO_BLANK).split()).decode()
    padded = f" {words} "
    n_words = words.count(" ") + 1 if words else 0
    places: dict[str, list[int]] = {}
    for end, phrase in automaton.iter(padded):
        places.setdefault(phrase, []).append(end - len(phrase) - 1)
    starts = [at for p in BASE for at in places.get(p, [])]
    # The word number of a place is the number of blanks before it.
    first = padded.count(" ", 0, min(starts)) if starts else None
    last = padded.count(" ", 0, max(starts)) if starts else None
    base = sorted({BASE[p] for p in places if p in BASE})
    labels = set(base) | {MORE[p] for p in places if p in MORE}
    expressions = []
    if TAG in places:
        for m in _TAG_LINE.finditer(text):
            parsed = parse_expression(m.group(1))
            if parsed:
                labels.update(parsed[0])
                expressions.append(parsed[1])
    hits = sum(map(len, places.values()))
    return {"n_words": n_words, "n_base": len(starts), "first_word": first, "last_word": last, "base_labels": base, "labels": sorted(labels), "expressions": sorted(set(expressions)), "score": hits / (hits + 1.0)}


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, expressions array<string>, score double"
_held: dict = {}


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc`` (struct of the columns of ``docs``) and what its whole text holds.

    ``n_words``; ``n_base``, ``first_word`` and ``last_word``: places of the base phrases, their smallest and largest
    start; ``base_labels`` and ``labels`` (distinct, sorted); ``expressions`` of identifier tags in canonical form;
    ``score`` h / (h + 1) for h hits. Null texts count as empty: no words, no labels, score 0. A tag without a
    well-formed expression adds no label. Repeated rows are reported each; an empty table gives no rows; columns keep their
    names inside ``doc``, whatever they are.
    """

    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "automaton" not in _held:
            _held["automaton"] = _automaton()
        for batch in batches:
            text = T.filled(batch.column(1))
            for a, b in T.slices(text):
                rows = [scan_text(t, _held["automaton"]) for t in text.slice(a, b - a).to_pylist()]
                kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 3 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array([r[k] for r in rows], t) for k, t in zip(_NAMES, kinds))], names=["doc", *_NAMES])

    packed = T.row_and_text(docs, text_col)
    return packed.mapInArrow(run, T.schema(packed, "doc", _SCHEMA))


_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.array_join("expressions", "; ").alias("expressions"),
    )
