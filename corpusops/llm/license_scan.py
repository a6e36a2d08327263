"""License scans by template-markup matching.

A template is wording with two kinds of marked regions, in the notation that license lists publish:
``<<beginOptional>> ... <<endOptional>>`` may be left out, and ``<<var;...>>`` may be replaced. A replaceable
region takes ``words=LOW-HIGH`` (any words, within these counts) or ``match=ALTERNATIVE|ALTERNATIVE``.
Everything else is mandatory wording. Each template is compiled once into an automaton over word tokens; a text
is accepted where the automaton runs from a word to an accepting state, so mandatory wording matches exactly and
only marked regions may differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpusops.llm import license_templates
from corpusops.llm.common import texts, with_ids

#: The phrases whose places are the base, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Templates by label; a document that one accepts gets the label beside those of PHRASES.
TEMPLATES = {
    "apache-2.0": """licensed under <<beginOptional>>the terms of<<endOptional>> the apache <<beginOptional>>software<<endOptional>>
        license <<beginOptional>>version<<endOptional>> 2 0""",
    "bsd-3-clause": """redistribution and use in source and binary forms with or without modification are permitted
        <<beginOptional>>provided that the following conditions are met<<endOptional>> <<var;name=conditions;words=0-90>>
        neither the name of <<var;name=owner;words=1-12>> nor the names of its contributors may be used to endorse or promote
        products derived from this software""",
    "cc-by-nc": """licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>creative commons<<endOptional>>
        cc by nc <<var;name=version;match=2 0|2 5|3 0|4 0>>""",
    "cc-by-sa": """licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>creative commons<<endOptional>>
        cc by sa <<var;name=version;match=2 0|2 5|3 0|4 0>>""",
    "gpl-header": """this program is free software you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation
        either version <<var;name=version;match=2|2 1|3>> <<var;name=choice;words=0-12>>""",
    "gpl-licensed": """licensed under <<beginOptional>>the terms of<<endOptional>> the gnu general public license
        <<beginOptional>>version<<endOptional>> <<var;name=version;match=1|2|3>>""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted""",
    "mit-grant": """permission is hereby granted free of charge to any person obtaining a copy of <<var;name=work;words=1-8>>
        to deal in the software without restriction""",
    "mit-released": """<<var;name=verb;match=released|licensed|distributed>> under <<beginOptional>>the terms of<<endOptional>>
        the mit license""",
    **license_templates.NOTICES,
    **license_templates.BODIES,
}

#: Words of a text in lower case: runs of characters that are neither ASCII controls, spaces nor punctuation.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(.*?)>>", re.S)


def words_of(text: str) -> list[bytes]:
    """The words of the whole text; bytes.lower() changes A-Z alone."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def parse_template(markup: str) -> list:
    """Nested parts: ("word", w), ("optional", parts), ("any", low, high) and ("choice", [words, ...])."""
    stack: list[list] = [[]]
    at = 0
    for m in [*_MARK.finditer(markup), None]:
        stack[-1] += [("word", w) for w in words_of(markup[at : m.start() if m else None])]
        if m is None:
            break
        at = m.end()
        kind, _, rest = m[1].partition(";")
        if kind == "beginOptional":
            stack.append([])
        elif kind == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif kind == "var":
            options = dict(x.split("=", 1) for x in rest.split(";"))
            if "match" in options:
                stack[-1].append(("choice", [words_of(x) for x in options["match"].split("|")]))
            else:
                low, high = map(int, options["words"].split("-"))
                stack[-1].append(("any", low, high))
        else:
            raise ValueError(f"unknown mark {kind!r}")
    if len(stack) != 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


class TokenAutomaton:
    """A template as an automaton over words. States that can be reached together are joined into one state, and
    their moves are kept, so a word costs one lookup."""

    def __init__(self, markup: str):
        self.moves: list[dict[bytes, list[int]]] = [{}]
        self.free: list[list[int]] = [[]]  # moves on any word
        self.empty: list[list[int]] = [[]]  # moves on no word
        self.accept = self._build(parse_template(markup), 0)
        self.states: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.steps: list[dict[bytes, int]] = []
        self.other: list[int] = []  # the step on a word that no mandatory wording names
        self.start = self._state(self._closure({0}))
        if self.sets[self.start] & {self.accept} or any(self.free[s] for s in self.sets[self.start]):
            raise ValueError("a template must begin with wording")
        self.first = {w for s in self.sets[self.start] for w in self.moves[s]}

    def _new(self) -> int:
        self.moves.append({})
        self.free.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def _build(self, parts: list, at: int) -> int:
        for part in parts:
            if part[0] == "word":
                nxt = self._new()
                self.moves[at].setdefault(part[1], []).append(nxt)
            elif part[0] == "optional":
                nxt = self._build(part[1], at)
                if nxt != at:
                    self.empty[at].append(nxt)
            elif part[0] == "choice":
                nxt = self._new()
                for option in part[1]:
                    self.empty[self._build([("word", w) for w in option], at)].append(nxt)
            else:
                for k in range(part[2]):
                    nxt = self._new()
                    self.free[at].append(nxt)
                    if k >= part[1]:
                        self.empty[at].append(nxt)
                    at = nxt
                nxt = at
            at = nxt
        return at

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _state(self, key: frozenset[int]) -> int:
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.other.append(-1)
        return self.states[key]

    def _step(self, state: int, word: bytes) -> int:
        """The next joined state; 0 to stop is never reached again, so the dead state is the empty set."""
        named = [s for s in self.sets[state] if word in self.moves[s]]
        if not named and self.other[state] >= 0:
            return self.other[state]
        nxt = {t for s in self.sets[state] for t in [*self.moves[s].get(word, ()), *self.free[s]]}
        to = self._state(self._closure(nxt))
        if named:
            self.steps[state][word] = to
        else:
            self.other[state] = to
        return to

    def match(self, words: list[bytes], at: int) -> int | None:
        """Index after the longest accepted run of words that begins at ``at``; None if none is accepted."""
        state, end = self.start, None
        for k in range(at, len(words)):
            nxt = self.steps[state].get(words[k])
            state = self._step(state, words[k]) if nxt is None else nxt
            if not self.sets[state]:
                break
            if self.accept in self.sets[state]:
                end = k + 1
        return end


class LicenseScanner:
    """Places of the phrases and spans of the templates in one text's words."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = {label: TokenAutomaton(x) for label, x in templates.items()}
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.by_first: dict[bytes, list[tuple[str, TokenAutomaton]]] = {}
        for label, a in self.automata.items():
            for w in a.first:
                self.by_first.setdefault(w, []).append((label, a))
        self.starts: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for p, label in self.phrases:
            self.starts.setdefault(p[0], []).append((p, label))
        self.wanted = self.by_first.keys() | self.starts.keys()

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int]]]:
        """Number of words, (start, label) of each phrase, (label, start, end) of each accepted span."""
        words = words_of(text)
        base, spans = [], []
        for i in [i for i, w in enumerate(words) if w in self.wanted]:
            base += [(i, label) for p, label in self.starts.get(words[i], ()) if words[i : i + len(p)] == p]
            spans += [(label, i, end) for label, a in self.by_first.get(words[i], ()) if (end := a.match(words, i))]
        return len(words), base, spans


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, spans array<struct<label: string, first_word: bigint, end_word: bigint>>"
)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per document with the phrases and template spans found in its whole text.

    Columns: n_words; n_base, first_word, last_word of the phrases' places (words from 0; null without a place);
    base_labels and labels (distinct, sorted, comma-joined; empty string for none); score 1 where a template accepts a
    span, 0.5 where a phrase alone stands, else 0; spans of the templates, by start then label.
    Null text counts as empty: no words, no labels, score 0. Repeated rows each give a row; other columns of docs
    are ignored; an empty table gives an empty table.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = LicenseScanner(templates, phrases)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                n, base, spans = scanner.scan(text)
                at = [i for i, _ in base]
                mentioned = {label for _, label in base}
                rows.append((
                    doc_id, n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(mentioned)),
                    ",".join(sorted(mentioned | {s[0] for s in spans})), 1.0 if spans else 0.5 if base else 0.0,
                    [dict(zip(("label", "first_word", "end_word"), s, strict=True)) for s in sorted(spans, key=lambda s: (s[1], s[0]))],
                ))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return with_ids(texts(docs).mapInPandas(scan, SCHEMA))


def template_regex(markup: str) -> str:
    """The template as a regular expression over words that each have one space before them (for the SQL oracle)."""

    def build(parts: list) -> str:
        out = ""
        for p in parts:
            if p[0] == "word":
                out += " " + p[1].decode()
            elif p[0] == "optional":
                out += f"(?:{build(p[1])})?"
            elif p[0] == "choice":
                out += "(?:" + "|".join("".join(" " + w.decode() for w in o) for o in p[1]) + ")"
            else:
                out += f"(?: [^ ]+){{{p[1]},{p[2]}}}"
        return out

    return build(parse_template(markup)) + "(?: |$)"


def oracle() -> str:
    """DuckDB SQL for the query's columns."""
    phrase_rows = ", ".join(f"({[w.decode() for w in words_of(p)]!r}, '{label}')" for p, label in PHRASES.items())
    template_rows = ", ".join(f"('{template_regex(m)}', '{label}')" for label, m in TEMPLATES.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    s AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') AS line FROM w),
    p(pw, label) AS (VALUES {phrase_rows}),
    t(re, label) AS (VALUES {template_rows}),
    base AS (
      SELECT doc_id, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + len(pw)] = pw)) AS pos
      FROM s, p WHERE contains(line, ' ' || array_to_string(pw, ' '))),
    b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM base GROUP BY doc_id),
    found AS (SELECT doc_id, label, 1 AS kind FROM base UNION SELECT doc_id, label, 2 FROM s, t WHERE regexp_matches(line, re)),
    l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE kind = 1) AS base_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(kind) AS kind FROM found GROUP BY doc_id)
    SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CASE kind WHEN 2 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
    FROM s LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
    """
