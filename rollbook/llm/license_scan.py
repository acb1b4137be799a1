"""Licence scans by a positional index of rare words, in DataFrame functions only.

Each template is a notice with mandatory key phrases at fixed places in it. From the
document frequencies of all licence words over the whole corpus each key phrase gets
the rarest of its words as its posting: (word, place in the template). A file is
looked up by the posted words it holds, its highest-IDF licence words. Postings of
a template are intersected by relative position: only starts that every key phrase's
rarest word agrees on go on. There all mandatory phrases are verified word by word.
As a verified place holds all its posted words, no place is lost.

No join and no shuffle but the counting of at most a few hundred licence words.

Results for odd rows: null and empty texts have no words, no places, empty labels, null
first and last words and score 0; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels: fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of public licences; the mandatory phrases stand in brackets: fixed values.
NOTICES = (
    ("agpl", "[gnu affero general public license]"),
    ("apache-2.0", "licensed under the [apache license version 2 0]"),
    ("boost-1.0", "[boost software license version 1 0]"),
    (
        "bsd",
        "[redistribution and use in source and binary forms] with or without modification are permitted "
        "[provided that the following conditions are met]",
    ),
    ("cc-by-nc", "licensed under [cc by nc]"),
    ("cc-by-nd", "licensed under [cc by nd]"),
    ("cc-by-sa", "licensed under [cc by sa]"),
    ("cc0-1.0", "[cc0 1 0 universal]"),
    ("creative-commons", "licensed under a [creative commons attribution]"),
    ("epl", "[eclipse public license]"),
    (
        "gpl-notice",
        "[this program is free software] you can redistribute it and or modify it under the terms of the gnu "
        "[general public license]",
    ),
    ("gpl-work", "[licensed under the gnu general public license]"),
    (
        "isc",
        "[permission to use copy modify] and or [distribute this software for any purpose] with or without fee is "
        "hereby granted",
    ),
    ("lgpl", "[gnu lesser general public license]"),
    ("mit", "released under the [mit license]"),
    (
        "mit-text",
        "[permission is hereby granted free of charge] to any person [obtaining a copy of this software] and "
        "associated documentation files",
    ),
    ("mpl", "subject to the terms of the [mozilla public license]"),
    ("public-domain", "this is free and unencumbered software [released into the public domain]"),
    ("warranty", "[the software is provided as is without warranty of any kind]"),
)


@dataclass(frozen=True)
class Template:
    """A label, the words of its notice, and its mandatory phrases as (place, words)."""

    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool = False


def template(label: str, notice: str, base: bool = False) -> Template:
    words, phrases, open_at = [], [], None
    for word in notice.split():
        if word.startswith("["):
            open_at = len(words)
        words.append(word.strip("[]"))
        if word.endswith("]"):
            phrases.append((open_at, tuple(words[open_at:])))
    return Template(label, tuple(words), tuple(phrases), base)


TEMPLATES = (*(template(v, f"[{k}]", True) for k, v in BASE.items()), *(template(k, v) for k, v in NOTICES))


def words_of_text(column: str = "text") -> Column:
    """Lower-cased words of a text."""
    return F.array_remove(F.split(F.translate(text_of(column), CAPITALS, SMALL), SEPARATORS), "")


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """In how many rows each word of a mandatory phrase occurs, over all rows."""
    wanted = sorted({w for t in templates for _, phrase in t.phrases for w in phrase})
    held = F.array_distinct(F.filter(F.col("words"), lambda w: w.isin(wanted)))
    rows = (
        docs.select(words_of_text().alias("words"))
        .select(F.explode(held).alias("word"))
        .groupBy("word")
        .count()
        .collect()  # at most len(wanted) rows
    )
    return dict.fromkeys(wanted, 0) | {r["word"]: r["count"] for r in rows}


def postings(templates: tuple[Template, ...], frequencies: dict[str, int]) -> dict[Template, list[tuple[str, int]]]:
    """For each template the rarest word of each mandatory phrase, with its place in the notice."""
    return {
        t: [
            min(((w, at + k) for k, w in enumerate(phrase)), key=lambda x: (frequencies[x[0]], x[1]))
            for at, phrase in t.phrases
        ]
        for t in templates
    }


def _starts(posted: list[tuple[str, int]]) -> Column:
    """Starts of a notice that every posted word agrees on."""

    def starts(word: str, place: int) -> Column:
        own = F.filter(F.col("hits"), lambda h: h["word"] == word)
        return F.transform(own, lambda h: h["at"] - F.lit(place))

    agreed = starts(*posted[0])
    for pair in posted[1:]:
        agreed = F.array_intersect(agreed, starts(*pair))
    return agreed


def _verified(t: Template) -> Column:
    """Starts among the agreed ones where all mandatory phrases stand."""

    def stands(start: Column) -> Column:
        checks = [
            F.get(F.col("words"), (start + F.lit(at + k)).cast("int")) == F.lit(w)
            for at, phrase in t.phrases
            for k, w in enumerate(phrase)
        ]
        out = checks[0]
        for c in checks[1:]:
            out = out & c
        return F.coalesce(out, F.lit(False))

    return F.filter(F.col(_name(t)), stands)


def _name(t: Template) -> str:
    return f"{'base' if t.base else 'own'} {t.label}".replace(".", "_")


def _share(t: Template) -> Column:
    """The greatest share of a notice's words that stand in their place at a verified start, 0 without one."""

    def here(start: Column) -> Column:
        return sum(
            (
                F.coalesce((F.get(F.col("words"), (start + F.lit(k)).cast("int")) == F.lit(w)).cast("int"), F.lit(0))
                for k, w in enumerate(t.words)
            ),
            F.lit(0),
        )

    return F.coalesce(F.array_max(F.transform(F.col(_name(t)), here)), F.lit(0)) / F.lit(float(len(t.words)))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    posted = postings(templates, document_frequencies(docs, templates))
    rare = sorted({w for pairs in posted.values() for w, _ in pairs})
    words = docs.select("doc_id", words_of_text().alias("words"))
    at = F.array_compact(F.transform(F.col("words"), lambda w, i: F.when(w.isin(rare), F.struct(i.alias("at"), w.alias("word")))))
    hit = words.select("doc_id", "words", at.alias("hits"))
    agreed = hit.select("doc_id", "words", *(_starts(posted[t]).alias(_name(t)) for t in templates))
    found = agreed.select("doc_id", "words", *(_verified(t).alias(_name(t)) for t in templates))
    base = [t for t in templates if t.base]
    some = {t: F.size(_name(t)) > 0 for t in templates}
    places = F.array_sort(F.flatten(F.array(*(F.col(_name(t)) for t in base))))

    def labels(of: list[Template]) -> Column:
        kept = [F.when(some[t], F.lit(t.label)) for t in of]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*kept)))), ",")

    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.get(places, F.lit(0)).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(list(templates)).alias("labels"),
        F.greatest(*(_share(t) for t in templates)).alias("score"),
    )


# ---- the same in the SQL of the comparison --------------------------------------------------------------------------


def scan_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The result by brute force: every place of every phrase, without an index."""

    def literal(words) -> str:
        return "[" + ",".join(f"'{w}'" for w in words) + "]"

    def places(t: Template) -> str:
        first = t.phrases[0][0]
        checks = " and ".join(
            f"words[i+{at - first + 1}:i+{at - first + len(p)}] = {literal(p)}" for at, p in t.phrases
        )
        return f"list_transform(list_filter(spots, lambda i: {checks}), lambda i: i - {first})"

    def share(k: int, t: Template) -> str:
        same = " + ".join(
            f"case when i+{j} >= 0 and words[i+{j + 1}] = '{w}' then 1 else 0 end" for j, w in enumerate(t.words)
        )
        return f"coalesce(list_max(list_transform(t{k}, lambda i: {same})), 0) / {float(len(t.words))!r}::double"

    def labels(base_only: bool) -> str:
        kept = ",".join(
            f"case when len(t{k}) > 0 then '{t.label}' end" for k, t in enumerate(templates) if t.base or not base_only
        )
        return f"array_to_string(list_sort(list_distinct([{kept}])), ',')"

    base = [f"t{k}" for k, t in enumerate(templates) if t.base]
    every = base[0]
    for b in base[1:]:
        every = f"list_concat({every}, {b})"
    first_words = ",".join(sorted({f"'{t.phrases[0][1][0]}'" for t in templates}))
    return f"""with w as (select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{SEPARATORS}'), lambda x: x <> '') as words from documents),
p as (select *, list_filter(range(0, len(words)), lambda i: words[i+1] in ({first_words})) as spots from w),
f as (select doc_id, words, {", ".join(f"{places(t)} as t{k}" for k, t in enumerate(templates))} from p),
g as (select *, {every} as places from f)
select doc_id, len(words)::bigint as n_words, len(places)::bigint as n_base, list_min(places)::bigint as first_word,
    list_max(places)::bigint as last_word, {labels(True)} as base_labels, {labels(False)} as labels,
    greatest({", ".join(share(k, t) for k, t in enumerate(templates))}) as score
from g"""
