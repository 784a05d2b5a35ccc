"""License scans: exact phrases, and a fuzzy search for short notices.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, joined by one space.
A phrase is found wherever its words stand consecutively. A notice may differ by
up to k edits of characters, k = length // 12: it is cut into k + 1 seeds, and by
the pigeonhole principle every text within k edits holds one seed unchanged.
One Aho-Corasick pass finds all seeds; around each, where enough of the notice's pairs of
characters stand, the regex library's bounded-error matching looks for the whole notice and
gives span and errors. A match begins and ends with whole words.

Rows go through whole, in Arrow batches, one at a time; memory is bounded by a
batch and its longest text; a very long text is searched in stretches of a few lengths of a notice. Nulls: a null text is empty: no words, no spans, score
0. A null doc_id stays null. Rows that repeat are scanned one by one; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label -> notices, as words.
NOTICES = {
    "agpl": ["gnu affero general public license"],
    "all-rights-reserved": ["all rights reserved"],
    "apache": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by": ["licensed under cc by 4 0", "licensed under the creative commons attribution license"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0"],
    "gpl": ["licensed under the gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["gnu lesser general public license"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license"],
}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:int,last_word:int,errors:int,text:string>>"

#: Bytes that are no part of a word, as spaces.
_TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def to_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(_TO_WORDS).split()


def places(joined: str, phrase: str) -> list[int]:
    """Word positions at which a phrase's words stand in words joined by spaces."""
    padded, want = f" {joined} ", f" {phrase} "
    out, word, seen, at = [], 0, 0, padded.find(want)
    while at >= 0:
        word += padded.count(" ", seen, at)
        seen = at
        out.append(word)
        at = padded.find(want, at + 1)
    return out


def pairs_of(text: str) -> Counter:
    """The adjacent pairs of characters of a text, with their numbers."""
    return Counter(zip(text, text[1:]))


class NoticeSearch:
    """Seeds and patterns of notices, made once per task."""

    def __init__(self, notices: dict[str, list[str]], chars_per_error: int = 12):
        import ahocorasick
        import regex

        self.parts, self.pairs, seeds = [], [], {}
        for label, texts in notices.items():
            for notice in texts:
                k = len(notice) // chars_per_error
                self.parts.append((label, notice, k, regex.compile(f"(?b)(?<![^ ])(?! )(?:{regex.escape(notice, special_only=True)}){{e<={k}}}(?<! )(?![^ ])")))
                self.pairs.append(pairs_of(notice))
                step = len(notice) / (k + 1)
                for i in range(k + 1):
                    a, b = round(i * step), round((i + 1) * step)
                    seeds.setdefault(notice[a:b], []).append((len(self.parts) - 1, a))
        self.seeds = ahocorasick.Automaton()
        for seed, at in seeds.items():
            self.seeds.add_word(seed, (len(seed), at))
        self.seeds.make_automaton()

    def regions(self, joined: str) -> dict[int, list[list[int]]]:
        """Notice -> stretches of text to search. A seed's window holds every match that has the seed in its place.

        k edits change at most 2k adjacent pairs of characters, so windows that lack more than
        that of the notice's pairs hold no match. Windows that overlap are searched at once, up to four lengths.
        """
        out: dict[int, list[list[int]]] = {}
        last: dict[int, tuple[int, bool]] = {}
        for end, (size, at) in self.seeds.iter(joined):
            for part, offset in at:
                _, notice, k, _ = self.parts[part]
                start = end + 1 - size - offset - k
                a, b = max(0, start), min(start + len(notice) + 2 * k, len(joined))
                if part not in last or last[part][0] != start:
                    shared = (self.pairs[part] & pairs_of(joined[a:b])).total()
                    last[part] = start, shared >= len(notice) - 1 - 2 * k
                if not last[part][1]:
                    continue
                mine = out.setdefault(part, [])
                if mine and mine[-1][0] <= a <= mine[-1][1] and b - mine[-1][0] <= 4 * (len(notice) + 2 * k):
                    mine[-1][1] = max(mine[-1][1], b)
                else:
                    mine.append([a, b])
        return out

    def spans(self, joined: str) -> list[tuple[str, int, int, int, str]]:
        """(label, first word, last word, errors, text) of each notice found, one per place."""
        # a search starts at the space before a word, as the library inserts nothing where a search starts
        padded, found = " " + joined, set()
        for part, stretches in self.regions(joined).items():
            _, notice, k, pattern = self.parts[part]
            todo = [(a, b + 1) for a, b in stretches]
            while todo:
                a, b = todo.pop()
                if b - a <= len(notice) - k:
                    continue
                m = pattern.search(padded, a, _word_end(padded, a, b))
                if m:
                    # the best match of a stretch comes first; other notices may stand on either side of it
                    found.add((m.start() - 1, m.end() - 1, part, sum(m.fuzzy_counts)))
                    todo += [(a, m.start() - 1), (m.end(), b)]
        out, words, seen = [], 0, 0
        for start, end, part, errors in sorted(found):
            words, seen = words + joined.count(" ", seen, start), start
            out.append((self.parts[part][0], words, words + joined.count(" ", start, end), errors, joined[start:end]))
        return best(out)


def _word_end(joined: str, a: int, b: int) -> int:
    """The last place in [a, b] at which a word ends; no match that ends at a word's end is cut."""
    return b if b >= len(joined) or joined[b] == " " else max(a, joined.rfind(" ", a, b))


def best(spans: list[tuple]) -> list[tuple]:
    """The spans without those that overlap one with fewer errors, by place."""
    spans, out = sorted(spans, key=lambda x: (x[1], x[2], x[0])), []
    for i, s in enumerate(spans):
        worse = False
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(spans) and abs(spans[j][1] - s[1]) <= 64 and not worse:  # no notice is longer
                t = spans[j]
                worse = t[1] <= s[2] and s[1] <= t[2] and t[3] < s[3]
                j += step
        if not worse:
            out.append(s)
    return out


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """For each row of docs the columns of SCHEMA: base places and labels, all labels, score and spans of notices.

    score is 1 where a phrase stands, else the best notice's 1 - errors / length, else 0.
    """
    phrases, notices = phrases or PHRASES, notices or NOTICES

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = NoticeSearch(notices)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = to_words(text)
                joined = b" ".join(words).decode("utf-8", "replace")
                at = {p: places(joined, p) for p in phrases if p in joined}
                starts = [x for found in at.values() for x in found]
                base = {phrases[p] for p, found in at.items() if found}
                spans = search.spans(joined)
                score = 1.0 if starts else max([0.0, *(1 - e / max(len(t), 1) for *_, e, t in spans)])
                every = base | {x[0] for x in spans}
                rows.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(every)), max(0.0, score), spans))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({c: "Int64" for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(scan, SCHEMA)
