"""Source divergence audit over run-length columns.

For each language the terms that at least ``LEAST_DOCS`` of its documents hold make the
vocabulary. A group, a source within a language, gives a term of ``count`` places the share
p = 1 + floor(10^9 * (count + 5) / (N + 5 V)); two groups differ by the sum of abs(p - q) over the vocabulary.

The vocabulary is cut into blocks of terms that are about equally frequent. In a block the
terms are reordered so that equal counts stand together (counts of the first group, then of the next,
and so on), and each group's column of counts becomes a few runs: most groups lack
most terms. A share is worked out once for each run. Two groups are compared by intersecting their
run boundaries: on each stretch both shares are constant, so abs(p - q) counts as often as the
stretch is long. Spark adds up the blocks.

Words are counted where the texts are read, summed by (lang, source, term) with partial sums
before the shuffle, so neither a hot source nor a common word meets in one task. A block holds
at most ``BLOCK_TERMS`` terms, give or take the hash, and sources meet in pairs of tiles of about ``TILE``, so a
task's memory is bounded whatever the vocabulary and the number of sources.
Arithmetic is exact: whole numbers throughout, shares by Python's.

Results for odd rows: null and empty texts have no terms, but their group counts; null lang and
source are ''; a very long text is read in stretches, and counts as one document;
repeated rows count as often as they occur; ties of a value go to the smaller item;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.common import in_batches, stored_once, text_of

#: Documents of a language that must hold a term; what is added to each count; shares are in 1 / SCALE.
LEAST_DOCS, PRIOR, SCALE = 30, 5, 10**9
#: Terms kept in the report of a group.
TOP = 50
#: Terms a block and sources a tile, about.
BLOCK_TERMS, TILE = 512, 64
#: Rows of a table about languages that is broadcast; a longer one is joined by a shuffle.
FEW = 1 << 16
#: Entries of the word counts that a task holds before it passes them on, and bytes of a text that are read at once.
HELD, STRETCH = 200_000, 4 << 20

_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)  # small letters; blanks between terms


def terms_in(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, stretch by stretch."""
    at = 0
    while at < len(text):
        part = text[at : at + STRETCH].translate(_TERM_BYTES)
        if at + STRETCH < len(text):  # end after a blank; a term longer than a stretch stays whole
            end = part.rfind(b" ") + 1
            while not end:
                part += text[at + len(part) : at + len(part) + STRETCH].translate(_TERM_BYTES)
                end = len(part) if at + len(part) == len(text) else part.rfind(b" ") + 1
            part = part[:end]
        at += len(part)
        yield part.split()


COUNT_SQL = "lang string, source string, term string, n long, docs long"
_COUNT_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and documents of each (lang, source, term), summed over many rows; the empty term stands for the group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (places, docs) in groups.items():
            terms = list(places)
            columns = [
                pa.array([lang] * len(terms), pa.string()),
                pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(list(places.values()), pa.int64()),
                pa.array([docs[t] for t in terms], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNT_SCHEMA)
        groups.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2)):
            places, docs = groups.setdefault((lang, source), (Counter({b"": 0}), Counter()))
            before = len(places)
            stretches = [Counter(found) for found in terms_in(text.as_buffer().to_pybytes())]
            own = sum(stretches[1:], stretches[0]) if stretches else {}
            places.update(own)
            docs.update(own.keys())
            held += len(places) - before
            if held > HELD:
                yield from passed_on()
                held = 0
    yield from passed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """n places and docs documents of each (lang, source, term); the empty term for each group that occurs."""
    own = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))
    partial = own.transform(in_batches, _partial_counts, COUNT_SQL)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---- blocks ---------------------------------------------------------------------------------------------------------


def shares(counts: np.ndarray, places: int, vocabulary: int) -> np.ndarray:
    """Share of each count, worked out once for each different one."""
    different, at = np.unique(counts, return_inverse=True)
    whole = places + PRIOR * vocabulary
    return np.array([1 + SCALE * (c + PRIOR) // whole for c in different.tolist()], np.int64)[at.reshape(-1)]


class Runs:
    """A column of counts as runs: where they start, their shares."""

    def __init__(self, counts: np.ndarray, places: int, vocabulary: int):
        self.starts = np.flatnonzero(np.concatenate([[True], counts[1:] != counts[:-1]]))
        self.shares = shares(counts[self.starts], places, vocabulary)

    def distance(self, other: Runs, size: int) -> int:
        """Sum of abs(p - q) over all terms, from the stretches between boundaries of either."""
        edges = np.union1d(self.starts, other.starts)
        lengths = np.diff(np.append(edges, size))
        p = self.shares[np.searchsorted(self.starts, edges, "right") - 1]
        q = other.shares[np.searchsorted(other.starts, edges, "right") - 1]
        return int((np.abs(p - q) * lengths).sum())


PART_SQL = "lang string, source string, part string, item string, value long"
_PART_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _compare_block(table: pa.Table) -> pa.Table:
    """A block's share of the distances between the sources of two tiles, and of the terms of a tile (where both are one).

    Rows without a term are heads, one for each source: its tile, its places, the language's places and vocabulary, and
    the number of the block's terms. Those that no source of the tiles has are columns of zeros.
    """
    rows = table.select(["source", "tile", "term", "n", "total", "vocabulary", "block_terms"]).to_pydict()
    lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
    heads = [k for k, t in enumerate(rows["term"]) if t is None]
    heads.sort(key=lambda k: rows["source"][k])
    at = {rows["source"][k]: i for i, k in enumerate(heads)}
    cells = [k for k, t in enumerate(rows["term"]) if t is not None]
    totals = {rows["term"][k]: rows["total"][k] for k in cells}
    column = {t: j for j, t in enumerate(totals)}
    size, vocabulary = rows["block_terms"][heads[0]], rows["vocabulary"][heads[0]]
    counts = np.zeros((len(heads), size), np.int64)
    for k in cells:
        counts[at[rows["source"][k]], column[rows["term"][k]]] = rows["n"][k]
    total, terms = np.zeros(size, np.int64), [*totals, *[""] * (size - len(totals))]
    total[: len(totals)] = list(totals.values())
    order = np.lexsort(counts[::-1])
    counts, total, terms = counts[:, order], total[order], [terms[j] for j in order]
    tiles = [rows["tile"][k] for k in heads]
    runs = [Runs(counts[i], rows["n"][k], vocabulary) if size else None for i, k in enumerate(heads)]
    out: list[tuple] = []
    sources = list(at)
    for i in range(len(sources)):
        for j in range(i + 1, len(sources)):
            if low == high or tiles[i] != tiles[j]:
                out.append((sources[i], "pair", sources[j], runs[i].distance(runs[j], size) if size else 0))
    if low == high and size:
        q = shares(total, rows["total"][heads[0]], vocabulary)
        for i, run in enumerate(runs):
            lengths = np.diff(np.append(run.starts, size))
            more = np.repeat(run.shares, lengths) - q
            above = np.flatnonzero((counts[i] > 0) & (more > 0))
            best = sorted((-int(more[j]), terms[j].encode(), j) for j in above)[:TOP]  # no more of a block can be among the first
            out += [(sources[i], "term", terms[j], -less) for less, _, j in best]
    source, part, item, value = zip(*out, strict=True) if out else ((), (), (), ())
    columns = [[lang] * len(out), source, part, item, value]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PART_SCHEMA, strict=True)], schema=_PART_SCHEMA)


def _few(rows: DataFrame, label: str) -> DataFrame:
    """A stored table with a row for each language or class, to be broadcast if it is short: a language may hold most rows."""
    rows = stored_once(rows.sparkSession, rows, label)
    return F.broadcast(rows) if rows.count() <= FEW else rows


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: other sources by distance, and terms by excess over the language."""
    spark = docs.sparkSession
    cells = stored_once(spark, term_counts(docs), "term-counts")
    terms = cells.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    # about equally frequent terms are of a class; a class is cut into blocks by a hash
    kept = terms.where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "total", F.floor(F.log2("total")).cast("long").alias("class"))
    kept = stored_once(spark, kept, "vocabulary")
    classes = kept.groupBy("lang", "class").agg(
        F.count(F.lit(1)).alias("size"), F.sum("total").alias("places"), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_TERMS)).alias("blocks")
    )
    classes = _few(classes, "classes")
    placed = kept.join(classes.select("lang", "class", "blocks"), ["lang", "class"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).drop("blocks")
    blocks = placed.groupBy("lang", "class", "block").agg(F.count(F.lit(1)).alias("block_terms"))
    counted = cells.where("term <> ''").drop("docs").join(placed, ["lang", "term"])
    counted = stored_once(spark, counted, "counted")
    # one row for each group that occurs, with its tile; a lang without kept terms has a block without terms
    places = counted.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = cells.where("term = ''").select("lang", "source").join(places, ["lang", "source"], "left")
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).alias("tiles"))
    langs = classes.groupBy("lang").agg(F.sum("size").alias("vocabulary"), F.sum("places").alias("total"))
    facts = _few(tiles.join(langs, "lang", "left").na.fill(0, ["vocabulary", "total"]), "languages")
    tile = F.pmod(F.xxhash64("source"), F.col("tiles"))
    none = F.lit(0).cast("long")
    blocks = blocks.unionByName(facts.select("lang", F.lit(-1).cast("long").alias("class"), none.alias("block"), none.alias("block_terms")))
    heads = groups.join(facts, "lang").select(
        "lang", "source", tile.alias("tile"), "tiles", F.lit(None).cast("string").alias("term"),
        F.coalesce("n", F.lit(0)).alias("n"), "total", "vocabulary",
    )
    heads = heads.join(blocks, "lang")
    found = counted.join(facts.select("lang", "tiles"), "lang").withColumn("tile", tile)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    dealt = heads.unionByName(found, allowMissingColumns=True).select("*", other)
    dealt = dealt.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other", "tiles")
    parts = dealt.groupBy("lang", "class", "block", "low", "high").applyInArrow(_compare_block, PART_SQL)
    parts = stored_once(spark, parts, "parts")
    once = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = once.select("lang", both.alias("of"), "value").select("lang", "of.*", "value", F.lit("pair").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    first = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return ranked.unionByName(first).select("lang", "source", "part", "item", "value", "rank")


# ---- the same in the SQL of the comparison --------------------------------------------------------------------------


def audit_sql() -> str:
    """The result term by term: every group's share of every kept term."""
    share = f"(1 + {SCALE}::hugeint * (n + {PRIOR}) // (places + {PRIOR} * v))::hugeint"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""with d as (select row_number() over () as row_, coalesce(lang, '') as lang, coalesce(source, '') as source,
    {words} as words from documents),
w as (select lang, source, row_, unnest(words) as term from d),
kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct row_) >= {LEAST_DOCS}),
v as (select lang, count(*) as v, sum(n) as places from kept group by lang),
q as (select lang, term, {share} as q from kept join v using (lang)),
grp as (select distinct lang, source from d),
held as (select w.lang, source, w.term, count(*) as n from w join kept using (lang, term) group by w.lang, source, w.term),
cells as (select grp.lang, grp.source, kept.term, coalesce(held.n, 0) as n from grp join kept on kept.lang = grp.lang
    left join held on held.lang = grp.lang and held.source = grp.source and held.term = kept.term),
p as (select c.lang, c.source, c.term, c.n as count_, {share.replace("(n +", "(c.n +").replace("places", "s.places")} as p
    from cells c join (select lang, source, sum(n) as places from cells group by lang, source) s using (lang, source) join v on v.lang = c.lang),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
    from grp a join grp b on a.lang = b.lang and a.source <> b.source
    left join p x on x.lang = a.lang and x.source = a.source
    left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
    group by a.lang, a.source, b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, (p.p - q.q)::bigint as value from p join q using (lang, term)
    where count_ > 0 and p.p > q.q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
    from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= {TOP}"""
