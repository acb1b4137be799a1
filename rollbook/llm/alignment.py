"""Alignment of two tokenizers' tokens, as an Arrow pipeline.

The A ids (byte-level BPE of a blank and the text) and B ids (piece BPE of the text, which sets a
blank before it) of many texts are list columns. They are flattened; each token's text is its
parent index, its length in bytes comes from a table, and cumulative sums over the
tokens, each text's segment after the one before, give every token's end: a number that stands for a
text and an offset in it. An Acero full outer hash join of A and B on these ends, in order of
the ends, cuts the texts into stretches: a row for each link, with the next A and the
next B token that end there or later. Where both sides have the end a group is complete.
``Table.group_by`` counts the links of each text and id pair; Spark merges the counts.

A text's own counts are stored, packed, with it. Corpus-wide counts come back in two ways
that add up: the ``FREQUENT`` most frequent pairs at most are broadcast as sorted arrays
(16 bytes a pair), and what a text holds of all others is joined by id pair and summed.
A class of counts is broadcast whole or not at all, so the choice follows from the counts.

A text longer than ``SEGMENT`` is cut where a single blank stands between two other characters:
there tokens of both kinds end, none looks behind, and results of the segments add up. (The B
vocabulary must have no entry with a blank after another character, else ValueError.)
Texts are worked on in slices of about ``SEGMENT``, so memory is bounded but for texts
without any such place.

Results for odd rows: a null or empty text, and one whose joined A or B bytes are not blank
and text, have no tokens and no groups; the B model is asked about the whole of each segment, so
this holds for very long texts too; of ties for the highest count every one is best; repeated rows and
repeated or null ids give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.bpe import ByteBpe
from rollbook.llm.common import in_batches, per_process, stored_once, text_of

#: Characters of text that are aligned at once.
SEGMENT = 1 << 19
#: Id pairs that are broadcast, at most.
FREQUENT = 1 << 20
#: Classes of counts for each doubling.
CLASSES = 8

_cut = re.compile(r"(?<=[!-~]) (?=[!-~])")


class Tokenizers:
    """Both encoders, and for each id its bytes and its digits with what may follow them in a digest."""

    def __init__(self, byte_bpe: bytes, pieces: bytes):
        self.a = ByteBpe(byte_bpe)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        entries = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search("[^▁]▁", e) for e in entries):
            raise ValueError("an entry goes on after a blank")
        b_bytes = [
            bytes([int(e[3:5], 16)]) if self.b.is_byte(i) else e.replace("▁", " ").encode() for i, e in enumerate(entries)
        ]
        a_bytes = [self.a.bytes_of.get(i, b"") for i in range(len(self.a.sizes))]
        self.bytes = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.lengths = [pc.binary_length(x).cast(pa.int64()) for x in self.bytes]
        # of each id, digits with "," "|" ";" or nothing after them
        self.digits = [pa.array([f"{i}{end}" for i in range(len(x)) for end in (",", "|", ";", "")]) for x in self.bytes]
        self.pairs = len(entries)  # an id pair is one number: a * pairs + b

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """A and B ids of texts, each of which begins with the blank."""
        a = [np.frombuffer(self.a.encode_plain(t), self.a.kind) for t in texts]
        b = [array("i", ids) for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]
        return tuple(
            pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()),
                pa.array(np.concatenate([np.asarray(x, np.int32) for x in lists]) if lists else [], pa.int32()),
            )
            for lists in (a, b)
        )


def segments(text: str) -> Iterator[str]:
    """The blank and the text, in pieces of about SEGMENT characters that begin with a blank."""
    text, at = " " + text, 0
    while len(text) - at > SEGMENT:
        found = _cut.search(text, at + SEGMENT // 2)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Aligned:
    """What alignment of some segments gives: sizes, digest texts, id pairs of the links."""

    def __init__(self, tools: Tokenizers, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        lists = tools.encode(texts)
        base = np.cumsum([0, *map(len, raw)])
        joined = pa.array([b"".join(raw)], pa.binary())[0].as_buffer()
        self.sound = np.ones(len(texts), bool)
        ids, parents = [], []
        for kind, column in enumerate(lists):
            ids.append(pc.list_flatten(column))
            parents.append(pc.list_parent_indices(column))
            self.sound &= self._same_bytes(tools.bytes[kind].take(ids[kind]), column, base, joined)
        if not self.sound.all():
            keep = pa.array(self.sound)
            for kind in (0, 1):
                kept = keep.take(parents[kind])
                ids[kind], parents[kind] = ids[kind].filter(kept), parents[kind].filter(kept)
        # ends: a cumulative sum within each text's segment, from where the text starts
        ends = []
        for kind in (0, 1):
            run = pc.cumulative_sum(tools.lengths[kind].take(ids[kind])).to_numpy()
            owner = parents[kind].to_numpy()
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            before = np.concatenate([[0], run])[first]
            shift = np.zeros(len(texts), np.int64)
            shift[owner[first]] = base[owner[first]] - before
            ends.append(run + shift[owner])
        tables = [
            pa.table({"end": ends[kind], "at_" + "ab"[kind]: np.arange(len(ends[kind])), "parent": parents[kind].cast(pa.int32())})
            for kind in (0, 1)
        ]
        links = tables[0].join(tables[1].drop_columns("parent"), "end", join_type="full outer", use_threads=False, coalesce_keys=True)
        links = links.take(pc.sort_indices(links.column("end")))
        both = pc.and_(links.column("at_a").is_valid(), links.column("at_b").is_valid()).combine_chunks()
        at = [pc.fill_null_backward(links.column(c)).combine_chunks() for c in ("at_a", "at_b")]
        pair = [ids[kind].take(at[kind]) for kind in (0, 1)]
        self.parent = parents[0].take(at[0]).to_numpy() if len(at[0]) else np.zeros(0, np.int64)
        self.code = pair[0].to_numpy().astype(np.int64) * tools.pairs + pair[1].to_numpy()
        n = len(texts)
        self.n_a, self.n_b = (np.bincount(p.to_numpy(), minlength=n) for p in parents)
        self.n_links = np.bincount(self.parent, minlength=n)
        complete = both.to_numpy(zero_copy_only=False)
        self.n_groups = np.bincount(self.parent[complete], minlength=n)
        self._digests(tools, ids, [x.to_numpy()[complete] for x in at], parents)

    @staticmethod
    def _same_bytes(tokens: pa.Array, column: pa.ListArray, base: np.ndarray, joined: pa.Buffer) -> np.ndarray:
        """For each text, whether its tokens' bytes are its own."""
        offsets, data = tokens.buffers()[1:]
        at = np.frombuffer(offsets, np.int32)[: len(tokens) + 1][column.offsets.to_numpy()].astype(np.int64)
        if at[-1] == base[-1] and (at == base).all() and (at[-1] == 0 or data.slice(0, at[-1]).equals(joined)):
            return np.ones(len(column), bool)
        raw, own = joined.to_pybytes(), data.slice(0, at[-1]).to_pybytes() if at[-1] else b""
        return np.array([own[at[k] : at[k + 1]] == raw[base[k] : base[k + 1]] for k in range(len(column))], bool)

    def _digests(self, tools: Tokenizers, ids: list, last: list[np.ndarray], parents: list) -> None:
        """Texts of the groups: where each token's digits stand, and what follows them. ``last``: the last tokens of each group."""
        counts = [len(x) for x in ids]
        place = []
        for kind in (0, 1):
            # the groups before this token's one, whose tokens of the other kind come first; for B also its own
            group = np.searchsorted(last[kind], np.arange(counts[kind]), "left") + (kind == 1)
            ends = np.concatenate([[-1], last[1 - kind]]) + 1
            place.append(np.arange(counts[kind]) + ends[group])
        total = sum(counts)
        what, bounds = np.zeros(total, np.int64), np.searchsorted(parents[0].to_numpy(), np.arange(len(self.sound) + 1))
        bounds = bounds + np.searchsorted(parents[1].to_numpy(), np.arange(len(self.sound) + 1))
        for kind, shift in ((0, 0), (1, 4 * len(tools.bytes[0]))):
            follows = np.zeros(counts[kind], np.int64)
            follows[last[kind]] = 1 + kind
            what[place[kind]] = ids[kind].to_numpy() * 4 + follows + shift
        finals = bounds[1:][np.diff(bounds) > 0] - 1
        what[finals] += 1  # nothing after the last one of a text
        text = pa.concat_arrays(tools.digits).take(pa.array(what))
        self.digest_at = np.frombuffer(text.buffers()[1], np.int32)[: total + 1][bounds] if total else np.zeros(len(bounds), int)
        self.digest = memoryview(text.buffers()[2]) if total else memoryview(b"")

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links of each text and id pair: text, pair, how many; in order of text and pair."""
        table = pa.table({"parent": self.parent, "code": self.code}).group_by(["parent", "code"], use_threads=False).aggregate([([], "count_all")])
        parent, code, n = (table.column(c).to_numpy() for c in ("parent", "code", "count_all"))
        order = np.lexsort((code, parent))
        return parent[order], code[order], n[order]


class _Document:
    """A document while its segments come in."""

    def __init__(self):
        self.sizes, self.sha, self.sound, self.pairs = np.zeros(4, np.int64), hashlib.sha256(), True, []

    def add(self, sound: bool, sizes: np.ndarray, digest: memoryview, code: np.ndarray, n: np.ndarray) -> None:
        self.sound &= sound
        if self.sound:
            if self.sizes[0]:
                self.sha.update(b";")
            self.sha.update(digest)
            self.sizes += sizes
            self.pairs.append((code, n))

    def row(self) -> tuple:
        if not self.sound or not self.sizes[0]:
            return 0, 0, 0, 0, "", b"", b""
        code, n = self.pairs[0]
        if len(self.pairs) > 1:
            code, at = np.unique(np.concatenate([c for c, _ in self.pairs]), return_inverse=True)
            n = np.zeros(len(code), np.int64)
            np.add.at(n, at, np.concatenate([x for _, x in self.pairs]))
        return *map(int, self.sizes), self.sha.hexdigest(), code.astype("<i4").tobytes(), n.astype("<u4").tobytes()


ROW_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"
_ROW_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links"))]
    + [("groups_sha256", pa.string()), ("codes", pa.binary()), ("times", pa.binary())]
)


def align_texts(tools: Tokenizers, texts: list[str]) -> list[tuple]:
    """Sizes, digest and packed id pairs of each text."""
    documents = [_Document() for _ in texts]
    slice_, owners, held = [], [], 0

    def flush() -> None:
        nonlocal held
        if slice_:
            got = Aligned(tools, slice_)
            parent, code, n = got.counts()
            edges = np.searchsorted(parent, np.arange(len(slice_) + 1))
            sizes = np.stack([got.n_a, got.n_b, got.n_groups, got.n_links], 1)
            for k, owner in enumerate(owners):
                a, b = edges[k], edges[k + 1]
                digest = got.digest[got.digest_at[k] : got.digest_at[k + 1]]
                documents[owner].add(bool(got.sound[k]), sizes[k], digest, code[a:b], n[a:b])
        slice_.clear()
        owners.clear()
        held = 0

    for k, text in enumerate(texts):
        if not text:
            continue
        for segment in segments(text):
            slice_.append(segment)
            owners.append(k)
            held += len(segment)
            if held >= SEGMENT:
                flush()
    flush()
    return [d.row() for d in documents]


def aligned_documents(docs: DataFrame, byte_bpe: bytes, pieces: bytes) -> DataFrame:
    """Of each document its sizes, the digest of its groups, and its id pairs (``codes``, ascending) with their links (``times``)."""
    shipped = docs.sparkSession.sparkContext.broadcast((byte_bpe, pieces))  # two fixed files of some MB
    key = f"align-{hashlib.sha256(byte_bpe + pieces).hexdigest()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = per_process(key, lambda: Tokenizers(*shipped.value))
        for batch in batches:
            rows = align_texts(tools, batch.column(1).to_pylist())
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(_ROW_SCHEMA)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema=_ROW_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).transform(in_batches, run, ROW_SQL)


def _flat(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id pairs and links of a batch's documents one after the other, and where each document's start."""
    codes, times = batch.column(first), batch.column(first + 1)
    bounds = np.cumsum([0, *(pc.binary_length(codes).to_numpy(zero_copy_only=False) // 4)])
    flat = [b"".join(c.to_pylist()) for c in (codes, times)]
    return np.frombuffer(flat[0], "<i4").astype(np.int64), np.frombuffer(flat[1], "<u4").astype(np.int64), bounds


def _partial_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code, n, _ = _flat(batch, 0)
        table = pa.table({"code": code, "n": n}).group_by("code", use_threads=False).aggregate([("n", "sum")])
        yield from table.select(["code", "n_sum"]).rename_columns(["code", "n"]).to_batches()


def pair_counts(spark: SparkSession, aligned: DataFrame, pairs: int) -> DataFrame:
    """Each id pair's links in all documents, and whether its B id has no pair with more."""
    partial = in_batches(aligned.select("codes", "times"), _partial_links, "code long, n long")
    counts = stored_once(spark, partial.groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    b = F.pmod("code", F.lit(pairs)).alias("b")
    highest = counts.groupBy(b).agg(F.max("n").alias("highest"))  # a row for each B id
    found = counts.withColumn("b", b).join(highest, "b")
    return found.select("code", "n", (F.col("n") == F.col("highest")).alias("best"), F.floor(F.log2("n") * CLASSES).alias("class"))


def _lowest_class(counts: DataFrame, most: int) -> tuple[int, bool]:
    """The lowest class such that it and all above hold at most ``most`` pairs, and whether these are all."""
    sizes = {r["class"]: r["count"] for r in counts.groupBy("class").count().collect()}  # at most 64 * CLASSES rows
    lowest, held = max(sizes, default=0) + 1, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            return lowest, False
        lowest = k
    return lowest, True


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def align(docs: DataFrame, byte_bpe: bytes, pieces: bytes) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    ``byte_bpe`` is the text of a tokenizer.json, ``pieces`` the content of a sentencepiece model.
    """
    spark = docs.sparkSession
    aligned = aligned_documents(docs, byte_bpe, pieces).withColumn("row", F.monotonically_increasing_id())
    aligned = stored_once(spark, aligned, "aligned")
    width = sentencepiece.SentencePieceProcessor(model_proto=pieces).vocab_size()
    counts = stored_once(spark, pair_counts(spark, aligned, width), "pair-counts")
    lowest, all_of_them = _lowest_class(counts, FREQUENT)
    frequent = counts.where(F.col("class") >= lowest).select("code", "n", "best").orderBy("code").toArrow()
    # at most FREQUENT rows
    known = spark.sparkContext.broadcast([frequent.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n", "best")])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best = known.value
        for batch in batches:
            own, times, bounds = _flat(batch, 1)
            at = np.searchsorted(code, own)
            hit = at < len(code)
            hit[hit] = code[at[hit]] == own[hit]
            worth = np.zeros((2, len(own)), np.int64)
            worth[:, hit] = times[hit] * np.stack([best[at[hit]], count[at[hit]]])
            other = np.flatnonzero(~hit)
            other_bounds = np.searchsorted(other, bounds).astype(np.int32)
            kept = pa.StructArray.from_arrays([pa.array(own[other]), pa.array(times[other])], ["code", "times"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(_sums(w, bounds)) for w in worth), pa.ListArray.from_arrays(pa.array(other_bounds), kept)],
                names=["row", "n_best", "count_sum", "others"],
            )

    found = in_batches(
        aligned.select("row", "codes", "times", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"),
        _with_rest(look_up),
        "row long, n_best long, count_sum long, others array<struct<code: long, times: long>>, doc_id long, n_a long, n_b long, "
        "n_groups long, n_links long, groups_sha256 string",
    )
    if not all_of_them:
        found = stored_once(spark, found, "found")
        rest = found.select("row", F.explode("others").alias("pair")).select("row", "pair.*").join(counts, "code")
        more = rest.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
        )
        found = found.join(more, "row", "left")
        for total, part in (("n_best", "more_best"), ("count_sum", "more_sum")):
            found = found.withColumn(total, F.col(total) + F.coalesce(part, F.lit(0)))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _with_rest(look_up):
    """Give the columns after the first three back behind what ``look_up`` makes of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in look_up(iter([batch])):
                columns = [*out.columns, *batch.columns[3:]]
                yield pa.RecordBatch.from_arrays(columns, names=[*out.schema.names, *batch.schema.names[3:]])

    return run
