"""Streaming registry: the ledger fold published batch by batch.

``RegistryStream`` keeps plain tables under one folder, each written per batch
under the batch's own path, so a batch that is run again after a lost executor
or driver overwrites exactly what it wrote before:

* ``ledger`` and ``controls``: the append-only input as it arrived;
* ``journal``: one entry for each canonical row that was folded: the states before and after it,
  the save before it, whether it picks a default, or why it was set aside;
* ``undone``: assets whose entries from an arrival on are void;
* ``delta``: new states of the assets a batch touched (nulls where one is gone);
* ``holders``: new rollups of the holders a batch touched, with their picked or best asset;
* ``metrics`` and ``extents``: figures of each batch, observed while its tables are written;
* ``compact``, ``kept``, ``picks``, ``rollups``: all deltas, the journal above a slot, the picks and all rollups up
  to some batch; ``archive``: the journal below that slot, a piece for each compaction.

A batch folds its rows from the states of the assets it touches. Two kinds of rows
cannot simply be added: control rows (rollbacks), as they cannot un-emit what was
published, and rows that arrive after a later row (a greater ``seq``) of their asset.
The journal undoes them: the assets they hit go back to the state before their first
such arrival, and what is canonical from there on is folded again. The ledger is read from
the batch on that holds that arrival, never from the start. So the result does not
depend on how the source cuts its input into batches, nor on the order of files, nor on when
tables are compacted: entries are only moved then, and trimmed to the undo window when they are read.

A rollback deeper than ``keep_slots`` reads the archive too; it costs more and gives the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rollbook.operators import fold, holders, position, rollback
from rollbook.operators.skew import CHUNK_ROWS, checked_filter, checked_lookup
from rollbook.session import drop_folder
from rollbook.sources import blocks, snapshots

LEDGER_SQL = (
    "seq long, name string, slot long, kind string, holder string, utxo string, "
    "lovelace long, is_default boolean, datum string, built string, script string"
)
CONTROL_SQL = "bseq long, bslot long"
ROLLBACK = "rollback"  # kind of a control row; its slot is the point to go back to
SNAPSHOT_SLOTS = 600  # ten minutes

Processor = Callable[[DataFrame, int], None]


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Source of JSON files, all that are there in one batch unless ``files_per_trigger`` cuts them
    into several; on a cluster the same shape comes from a Kafka topic."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def run_available(
    stream: DataFrame, processors: Sequence[Processor], checkpoint: str
) -> StreamingQuery:
    """Hand every batch to every processor, in order, until the input is used up.

    The batch is read from the source once: the processors get its stored rows. They stay
    until the next batch has come, as this one may be run again.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        folder = f"{checkpoint.rstrip('/')}-batches/batch_id="
        batch.write.mode("overwrite").parquet(f"{folder}{batch_id}", compression="zstd")
        rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}{batch_id}")
        for process in processors:
            process(rows, batch_id)
        drop_folder(batch.sparkSession, f"{folder}{batch_id - 1}")

    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


class RegistryStream:
    METRICS_SQL = (
        "batch long, events long, first_slot long, last_slot long, current_slot long, current_hash string, tip_hash string"
    )
    HOLDERS_SQL = (
        "holder string, total_handles long, manually_set boolean, default_handle string, type string, known_owner_name string"
    )
    #: Tables of which a compaction makes one; their batch folders go when it is done. Those of a batch's work go with the batch.
    COMPACTED = ("delta", "journal", "undone", "holders")
    WORK = ("known", "start", "valid", "folded", "changed_holders")

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        width: int = CHUNK_ROWS,
        compact_every: int = 50,
        seq: str = "long",
        keep_slots: int = 2 * rollback.TWELVE_HOURS,
        snapshots_to: str | None = None,
        snapshot_slots: int = SNAPSHOT_SLOTS,
    ):
        """``seq`` is the type of arrivals: numbers, or positions in the stream of blocks (``string``).

        With ``snapshots_to`` a snapshot is written there after each batch that ends ``snapshot_slots`` or more after the last one.
        """
        self.spark, self.base, self.width, self.compact_every, self.seq = spark, base, width, compact_every, seq
        self.keep_slots, self.snapshots_to, self.snapshot_slots = keep_slots, snapshots_to, snapshot_slots
        state = fold.state_sql("", seq=seq)
        side = state.replace(" ", ": ").replace(",: ", ", ")
        self.STATE_SQL = f"name string, {state}, last_saved_seq {seq}, last_seq {seq}"
        self.LOG_SQL = f"slot long, seq {seq}, name string, old struct<{side}>, new struct<{side}>, changed array<string>"
        ledger = LEDGER_SQL.replace("seq long", f"seq {seq}")
        self.JOURNAL_SQL = (
            f"{self.LOG_SQL}, row_slot long, saved_before {seq}, is_pick boolean, reason string, "
            f"aside struct<{ledger.replace(' ', ': ').replace(',: ', ', ')}>"
        )
        self.PICKS_SQL = f"holder string, name string, seq {seq}, slot long"
        for table, schema in self._schemas().items():  # so that a first read finds the folder
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/{table}/batch_id=-1")

    # -------------------------------------------------------------- tables

    def _write(self, table: str, rows: DataFrame, batch_id: int, **figures: Column) -> tuple[DataFrame, dict]:
        """Store rows under the batch's own path and read them back; ``figures`` are observed on the way."""
        path, seen = f"{self.base}/{table}/batch_id={batch_id}", Observation()
        observed = rows.observe(seen, *[c.alias(n) for n, c in figures.items()]) if figures else rows
        observed.write.mode("overwrite").parquet(path, compression="zstd")
        return self.spark.read.schema(rows.schema).parquet(path), seen.get if figures else {}

    def _schemas(self) -> dict[str, str]:
        return {
            "delta": self.STATE_SQL,
            "ledger": LEDGER_SQL.replace("seq long", f"seq {self.seq}"),
            "controls": CONTROL_SQL.replace("bseq long", f"bseq {self.seq}"),
            "compactions": f"upto long, archive_from long, archive_slot long, archive_seq {self.seq}, lost_slot long",
            "undone": f"name string, from_seq {self.seq}",
            "journal": self.JOURNAL_SQL,
            "holders": self.HOLDERS_SQL,
            "metrics": self.METRICS_SQL,
            "extents": f"ledger_seq {self.seq}, journal_seq {self.seq}, journal_slot long",
        }

    def _read(self, table: str, below: int | None = None) -> DataFrame:
        root, schema = f"{self.base}/{table}", self._schemas()[table]
        rows = self.spark.read.schema(f"{schema}, batch_id long").parquet(root)
        return rows if below is None else rows.where(F.col("batch_id") < below)

    def _done(self, below: int | None = None):
        """The last compaction, or ``None``."""
        return self._read("compactions", below).orderBy(F.desc("upto")).limit(1).first()

    def _with_compacted(self, table: str, folder: str, below: int | None, done) -> DataFrame:
        """Rows of batches, those up to the last compaction from its one table."""
        rows = self._read(table, below)
        if done is None:
            return rows
        schema = self._schemas()[table]
        full = self.spark.read.schema(schema).parquet(f"{self.base}/{folder}/upto={done['upto']}")
        recent = rows.where(F.col("batch_id") > done["upto"])
        return recent.unionByName(full.withColumn("batch_id", F.lit(done["upto"]).cast("long")))

    def state(self, below: int | None = None, names: DataFrame | None = None) -> DataFrame:
        """Latest state per asset, of all or of ``names`` only: newest delta wins. Older deltas are read
        from the last compaction, so the cost follows the live state and not the length of the stream."""
        delta = self._with_compacted("delta", "compact", below, self._done(below))
        if names is not None:
            delta = delta.join(names, "name", "left_semi")
        fields = [c for c in delta.columns if c not in ("name", "batch_id")]
        last = delta.groupBy("name").agg(F.max_by(F.struct(*fields), "batch_id").alias("s"))
        return last.select("name", "s.*")

    def registry(self) -> DataFrame:
        return self.state().where(F.col("life").isNotNull())

    def holder_table(self, below: int | None = None) -> DataFrame:
        """Holders with their totals and default assets, picked or best."""
        rows = self._with_compacted("holders", "rollups", below, self._done(below))
        fields = [c for c in rows.columns if c not in ("holder", "batch_id")]
        last = rows.groupBy("holder").agg(F.max_by(F.struct(*fields), "batch_id").alias("s"))
        return last.select("holder", "s.*").where(F.col("total_handles").isNotNull())

    def journal(self, below: int | None = None, from_seq=None, from_slot: int | None = None, done="last") -> DataFrame:
        """Valid entries. All that arrived at ``from_seq`` or later, or of rows of ``from_slot`` or later, are
        among them; pieces that hold none of these are not read."""
        done = self._done(below) if done == "last" else done
        log = self._with_compacted("journal", "kept", below, done)
        undone = self._read("undone", below)
        pieces = self._read("extents", below)
        for column, least in (("journal_seq", from_seq), ("journal_slot", from_slot)):
            if least is not None:
                pieces = pieces.where(F.col(column) >= least)
        if from_seq is not None or from_slot is not None:
            first = pieces.agg(F.min("batch_id")).first()[0]
            compacted = F.col("batch_id") == done["upto"] if done is not None else F.lit(False)
            log = log.where(compacted | (F.col("batch_id") >= first)) if first is not None else log.where(compacted)
        if done is not None:
            undone = undone.where(F.col("batch_id") > done["upto"])
            if self._archive_holds(done, from_seq, from_slot):
                log = log.unionByName(self._archive(done).withColumn("batch_id", F.lit(done["upto"]).cast("long")))
        return self._still_valid(log, undone)

    @staticmethod
    def _archive_holds(done, from_seq, from_slot) -> bool:
        return (
            done["archive_seq"] is not None
            and (from_seq is None or done["archive_seq"] >= from_seq)
            and (from_slot is None or done["archive_slot"] >= from_slot)
        )

    def _is_deep(self, below: int, done) -> bool:
        """Whether an entry of the archive was undone since the last compaction."""
        if done is None or done["archive_seq"] is None:
            return False
        lowest = self._read("undone", below).where(F.col("batch_id") > done["upto"]).agg(F.min("from_seq")).first()[0]
        return lowest is not None and self._archive_holds(done, lowest, None)

    def _archive(self, done) -> DataFrame:
        rows = self.spark.read.schema(f"{self.JOURNAL_SQL}, upto long").parquet(f"{self.base}/archive")
        return rows.where((F.col("upto") >= done["archive_from"]) & (F.col("upto") <= done["upto"])).drop("upto")

    @staticmethod
    def _still_valid(log: DataFrame, undone: DataFrame) -> DataFrame:
        """Entries that no later batch has undone. An asset has at most a mark for each batch since the last
        compaction. Few marks are broadcast by adaptive execution, and it splits an asset with very many entries."""
        marks = undone.groupBy("name").agg(F.collect_list(F.struct("batch_id", "from_seq")).alias("marks"))
        found = log.join(marks, "name", "left").select(*log.columns, "marks")
        batch, seq = F.col("batch_id"), F.col("seq")
        void = F.exists("marks", lambda m: (m["batch_id"] > batch) & (m["from_seq"] <= seq))
        return found.where(~F.coalesce(void, F.lit(False))).drop("marks")

    def history(self, below: int | None = None) -> DataFrame:
        """The change log within the undo window."""
        done = self._done(below)
        log = self.journal(below, from_slot=done["archive_slot"] + 1 if done and done["archive_slot"] is not None else None, done=done)
        log = log.where(F.size("changed") > 0)
        if done is not None and done["archive_seq"] is not None:
            newest = log.agg(F.max("slot")).first()[0]
            if newest is None or newest - rollback.TWELVE_HOURS <= done["archive_slot"]:
                log = self.journal(below, done=done).where(F.size("changed") > 0)
        return rollback.retained(log.select("slot", "seq", "name", "old", "new", "changed"))

    def quarantine(self) -> DataFrame:
        """Canonical rows the fold rejected, with the reason and the batch that last folded them."""
        return self.journal().where(F.col("reason").isNotNull()).select("aside.*", "reason", "batch_id")

    def _picks(self, below: int | None, done, deep: bool) -> DataFrame:
        """Valid picks: of recent entries, and of older ones the last of each holder (all of them if ``deep``)."""
        if deep or done is None:
            log = self.journal(below, done=done)
        else:
            log = self._with_compacted("journal", "kept", below, done).where(F.col("batch_id") > done["upto"])
            undone = self._read("undone", below).where(F.col("batch_id") > done["upto"])
            log = self._still_valid(log, undone)
        picked = log.where("is_pick").select(F.col("new.holder").alias("holder"), "name", "seq", F.col("row_slot").alias("slot"))
        if not deep and done is not None:
            older = self.spark.read.schema(self.PICKS_SQL).parquet(f"{self.base}/picks/upto={done['upto']}")
            older = older.withColumn("batch_id", F.lit(done["upto"]).cast("long"))
            picked = picked.unionByName(self._still_valid(older, undone).drop("batch_id"))
        return picked

    # -------------------------------------------------------------- compaction

    def compact(self, batch_id: int) -> None:
        """Make one table each of all deltas, rollups, picks and the journal up to a batch; the mark is written last.

        Entries below the undo depth are moved to the archive. They are written again only if one of them was undone.
        Then the batch folders up to the compaction before this one go: a batch that is run again still finds its own.
        """
        below, done = batch_id + 1, self._done(batch_id)
        deep = self._is_deep(below, done)
        everything = deep or done is None
        log = self.journal(below, done=done) if everything else self._fresh_journal(below, done)
        newest = log.agg(F.max("slot")).first()[0]
        floor = (newest or 0) - self.keep_slots
        old = F.greatest("slot", "row_slot") < floor
        log = log.drop("batch_id")

        def place(table: str) -> str:
            return f"{self.base}/{table}/upto={batch_id}"

        self.state(below).write.mode("overwrite").parquet(place("compact"))
        self.holder_table(below).write.mode("overwrite").parquet(place("rollups"))
        picks = self._picks(below, done, deep)
        last = picks.where(F.col("slot") < floor).groupBy("holder").agg(F.max_by(F.struct("name", "seq", "slot"), "seq").alias("p"))
        kept_picks = picks.where(F.col("slot") >= floor).unionByName(last.select("holder", "p.*"))
        kept_picks.write.mode("overwrite").parquet(place("picks"))
        log.where(~old).write.mode("overwrite").parquet(place("kept"))
        seen = Observation()
        figures = [F.max("seq").alias("seq"), F.max(F.greatest("slot", "row_slot")).alias("slot")]
        log.where(old).observe(seen, *figures).write.mode("overwrite").parquet(place("archive"))
        before = (None, None) if everything else (done["archive_seq"], done["archive_slot"])
        top = [max((v for v in pair if v is not None), default=None) for pair in zip(before, (seen.get["seq"], seen.get["slot"]), strict=True)]
        first = batch_id if everything else done["archive_from"]
        lost = done["lost_slot"] if done else None
        mark = self.spark.createDataFrame([(batch_id, first, top[1], top[0], lost)], self._schemas()["compactions"])
        self._write("compactions", mark, batch_id)
        if done is not None:
            for k in range(max(0, done["upto"] - self.compact_every + 1), done["upto"] + 1):
                for table in self.COMPACTED:
                    drop_folder(self.spark, f"{self.base}/{table}/batch_id={k}")
            earlier = self._done(done["upto"])
            if earlier is not None:
                for table in ("compact", "rollups", "picks", "kept"):
                    drop_folder(self.spark, f"{self.base}/{table}/upto={earlier['upto']}")

    def _fresh_journal(self, below: int, done) -> DataFrame:
        """Valid entries that are not in the archive."""
        log = self._with_compacted("journal", "kept", below, done)
        return self._still_valid(log, self._read("undone", below).where(F.col("batch_id") > done["upto"]))

    # -------------------------------------------------------------- snapshots

    def snapshot(self, base: str, slot: int, block_hash: str) -> str:
        """Snapshot of the registry and of what the undo window needs, from which a stream can go on."""
        newest = self.journal().where(F.size("changed") > 0).agg(F.max("slot")).first()[0] or 0
        floor = newest - rollback.TWELVE_HOURS
        recent = self.journal(from_slot=floor).where(F.greatest("slot", "row_slot") >= floor)
        first = recent.agg(F.min("seq")).first()[0]
        window = F.lit(False) if first is None else F.col("seq") >= first
        log = self.journal(from_seq=first).where(window).drop("batch_id")
        ledger = self._ledger_from(None, first).where(window) if first is not None else self.ledger(-1)
        controls = self._read("controls").drop("batch_id")
        last = self._read("extents").agg(F.max("ledger_seq")).first()[0]
        more = {
            "ledger": ledger,
            "controls": controls if first is None else controls.where(F.col("bseq") >= first),
            "picks": self._picks(None, self._done(), False),
            "holders": self.holder_table(),
        }
        return snapshots.write(self.registry(), log, base, slot, block_hash, more=more, position=None if last is None else str(last))

    def resume(self, base: str) -> tuple[int, str | None] | None:
        """Take over the best sound snapshot; its slot and the arrival up to which rows are in it, or ``None``.

        For a stream that has not begun. Its source goes on after that arrival; a rollback can go
        back as far as the snapshot's undo window.
        """
        folders = {
            "registry": "compact/upto=-1",
            "history": "kept/upto=-1",
            "picks": "picks/upto=-1",
            "holders": "rollups/upto=-1",
            "ledger": "ledger/batch_id=-1",
            "controls": "controls/batch_id=-1",
        }
        found = snapshots.load(self.spark, base, lambda table: f"{self.base}/{folders[table]}")
        if found is None:
            return None
        log = self.spark.read.schema(self.JOURNAL_SQL).parquet(f"{self.base}/kept/upto=-1")
        figures = log.agg(F.max("seq"), F.max(F.greatest("slot", "row_slot")), F.max(F.when(F.size("changed") > 0, F.col("slot")))).first()
        position_ = None if found[1] is None else (found[1] if self.seq == "string" else int(found[1]))
        extents = self.spark.createDataFrame([(position_, figures[0], figures[1])], self._schemas()["extents"])
        self._write("extents", extents, -1)
        lost = (figures[2] or 0) - rollback.TWELVE_HOURS
        mark = self.spark.createDataFrame([(-1, -1, None, None, lost)], self._schemas()["compactions"])
        self._write("compactions", mark, -1)
        return found[0], position_

    def ledger(self, upto: int) -> DataFrame:
        return self._read("ledger", upto + 1).drop("batch_id")

    def _ledger_from(self, upto: int | None, seq) -> DataFrame:
        """The ledger from the first batch on that holds an arrival of ``seq`` or later."""
        below = None if upto is None else upto + 1
        first = self._read("extents", below).where(F.col("ledger_seq") >= seq).agg(F.min("batch_id")).first()[0]
        rows = self._read("ledger", below)
        return rows.where(F.col("batch_id") >= (first if first is not None else 0)).drop("batch_id")

    def controls(self, upto: int) -> DataFrame:
        return self._read("controls", upto + 1).drop("batch_id")

    # -------------------------------------------------------------- one batch

    def process(self, batch: DataFrame, batch_id: int, marks: DataFrame | None = None) -> None:
        """Fold the rows of a batch. Control rows are among them, or come apart as ``marks``: then rows that
        have to be made first are not made once more to look for them."""
        is_mark = F.col("kind") == ROLLBACK
        marks = (batch.where(is_mark) if marks is None else marks).select(F.col("seq").alias("bseq"), F.col("slot").alias("bslot"))
        figures = progress_figures()
        columns = [F.col(c) if c in batch.columns else F.lit(None).cast(t).alias(c) for c, t in map(str.split, LEDGER_SQL.split(", "))]
        rows, seen = self._write("ledger", batch.where(~is_mark).select(*columns), batch_id, **figures, newest=F.max("seq"))
        new_marks, lowest = self._write("controls", marks, batch_id, lowest=F.min("bslot"))
        done = self._done(batch_id)
        # what new control rows cancel of what was folded: from which arrival on
        hits = self.spark.createDataFrame([], self._schemas()["undone"])
        if lowest["lowest"] is not None:
            if done is not None and done["lost_slot"] is not None and lowest["lowest"] < done["lost_slot"]:
                raise ValueError("a rollback below the undo window of the snapshot: start from an older one")
            above = self.journal(batch_id, from_slot=lowest["lowest"] + 1, done=done).where(F.col("row_slot") > lowest["lowest"])
            entries = above.select("seq", F.col("row_slot").alias("slot"), "name")
            hits = rollback.cancelled(entries, new_marks, self.width).groupBy("name").agg(F.min("seq").alias("from_seq"))
        # and assets of which this batch has rows from before what was folded already
        arrivals = rows.groupBy("name").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("newest_seq"))
        names = arrivals.select("name").union(hits.select("name")).distinct() if lowest["lowest"] is not None else arrivals.select("name")
        known, _ = self._write("known", self.state(batch_id, names), batch_id)
        late = arrivals.join(known, "name").where(F.col("first_seq") < F.col("last_seq"))
        hits = hits.unionByName(late.select("name", F.col("first_seq").alias("from_seq")))
        hits = hits.groupBy("name").agg(F.min("from_seq").alias("from_seq"))
        undone, first = self._write("undone", hits, batch_id, seq=F.min("from_seq"), n=F.count(F.lit(1)))
        start, valid = self._begin(rows, arrivals, known, undone, first, done, batch_id)
        # read more than once below: stored once instead of computed again
        start, _ = self._write("start", start, batch_id)
        valid, _ = self._write("valid", rollback.canonical(valid, self.controls(batch_id), self.width), batch_id)
        live = start.where(F.col("life").isNotNull()).drop("last_seq")
        folded, _ = self._write("folded", fold.annotate(valid, self.width, base=live, whole=True, ends=True), batch_id)
        log = self._entries(fold.with_saves_before(folded, start))
        _, extent = self._write("journal", log, batch_id, seq=F.max("seq"), slot=F.max(F.greatest("slot", "row_slot")))
        self._write("delta", self._after(start, folded), batch_id)
        line = (seen["newest"], extent["seq"], extent["slot"])
        self._write("extents", self.spark.createDataFrame([line], self._schemas()["extents"]), batch_id)
        if seen["events"]:
            line = (batch_id, *[seen[f] for f in figures])
            self._write("metrics", self.spark.createDataFrame([line], self.METRICS_SQL), batch_id)
        self._publish_holders(known, batch_id, done, self._is_deep(batch_id + 1, done))
        for table in self.WORK:  # no other batch reads them, and this one writes them anew if it is run again
            drop_folder(self.spark, f"{self.base}/{table}/batch_id={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)
        if self.snapshots_to and seen["events"] and snapshots.due(self.spark, self.snapshots_to, seen["last_slot"], self.snapshot_slots):
            self.snapshot(self.snapshots_to, seen["last_slot"], seen["current_hash"])
            snapshots.drop_old(self.spark, self.snapshots_to)

    def _begin(self, rows, arrivals, known, undone, first, done, batch_id) -> tuple[DataFrame, DataFrame]:
        """States the batch starts from, of all assets it touches, and the rows to fold from there."""
        fields = [n for n, _ in self._fields() if n != "last_seq"]
        both = known.join(arrivals, "name", "full_outer").join(undone, "name", "left")
        newest = F.greatest("last_seq", "newest_seq").alias("last_seq")
        least, marks = first["seq"], first["n"]
        if least is None:
            return both.select("name", *fields, newest), rows
        late = self.journal(batch_id, from_seq=least, done=done).where(F.col("seq") >= least)
        late = checked_lookup(late.select("name", "seq", "old", "saved_before"), undone, "name", F.col("seq"), marks)
        late = late.where(F.col("seq") >= F.col("from_seq"))
        undo = late.groupBy("name").agg(F.min_by(F.struct("old", "saved_before"), "seq").alias("undo"))
        back = {f: F.col(f"undo.old.{f}") for f in fields} | {"last_saved_seq": F.col("undo.saved_before")}
        start = both.join(undo, "name", "left").select(
            "name", *[F.when(F.col("undo").isNotNull(), back[f]).otherwise(F.col(f)).alias(f) for f in fields], newest
        )
        again = self._ledger_from(batch_id, least).where(F.col("seq") >= least)
        again = checked_lookup(again, undone, "name", F.col("seq"), marks).where(F.col("seq") >= F.col("from_seq"))
        others = checked_filter(rows, undone, "name", F.col("seq"), marks, keep=False)
        return start, others.unionByName(again.drop("from_seq"))

    def _entries(self, folded: DataFrame) -> DataFrame:
        """Journal entries of folded rows."""
        columns = [c.split()[0] for c in LEDGER_SQL.split(", ")]
        reason = F.when(~F.col("saved"), F.when(F.col("op") == fold.REJECT, "no_datum").otherwise("no_asset"))
        pick = (F.col("kind") == "reference") & F.col("accepted") & F.coalesce("is_default", F.lit(False)) & (F.col("new_holder") != "")
        sides = fold.sides(
            folded,
            "seq",
            "name",
            F.col("slot").alias("row_slot"),
            "saved_before",
            F.coalesce(pick, F.lit(False)).alias("is_pick"),
            reason.alias("reason"),
            F.when(~F.col("saved"), F.struct(*columns)).alias("aside"),
        )
        return sides.select(*[n.split()[0] for n in self.LOG_SQL.split(", ")[:3]], "old", "new", "changed", *sides.columns[3:-3])

    def _after(self, start: DataFrame, folded: DataFrame) -> DataFrame:
        """States after the batch: what the fold came to, or the start where no row is left."""
        fields = [n for n, _ in self._fields()]
        final = fold.final_state(folded)
        final = final.select("name", F.struct(*final.columns[1:]).alias("to"))
        both = start.join(final, "name", "left")
        after = [
            F.when(F.col("to").isNotNull(), F.col(f"to.{f}")).otherwise(F.col(f)).alias(f)
            for f in fields
            if f not in ("last_seq", "last_saved_seq")
        ]
        saved = F.greatest("last_saved_seq", F.col("to.last_saved_seq")).alias("last_saved_seq")
        return both.select("name", *after, saved, "last_seq")

    def _publish_holders(self, known: DataFrame, batch_id: int, done, deep: bool) -> None:
        """New rollups of the holders that had or have an asset the batch touched."""
        delta = self._read("delta").where(F.col("batch_id") == batch_id)
        touched = known.select("holder").union(delta.select("holder")).where(F.col("holder") != "").distinct()
        touched, seen = self._write("changed_holders", touched, batch_id, n=F.count(F.lit(1)))

        def theirs(rows: DataFrame, spread_by: str) -> DataFrame:
            return checked_filter(rows, touched, "holder", F.col(spread_by), seen["n"])

        below = batch_id + 1
        # assets that ever were of these holders, in the deltas since the compaction or in its table
        ever = theirs(self._with_compacted("delta", "compact", below, done), "name").select("name").distinct()
        now = theirs(self.state(below, ever).where(F.col("life").isNotNull()), "name")
        events = theirs(self._picks(below, done, deep), "seq").select("holder", "name", "seq")
        rolled = holders.manual_defaults(holders.held(now), events)
        gone = touched.join(rolled, "holder", "left_anti")
        self._write("holders", rolled.unionByName(gone, allowMissingColumns=True), batch_id)

    def process_envelopes(self, policies: Sequence[str]) -> Processor:
        """A processor of block envelopes: forward ones bring rows, backward ones roll back to their point.

        Rows arrive at their positions in the stream of blocks, a backward envelope after all of
        its block; so the registry is one whose arrivals are positions (``seq="string"``).
        """
        if self.seq != "string":
            raise ValueError("blocks arrive at positions: seq='string'")

        def process(envelopes: DataFrame, batch_id: int) -> None:
            forward = envelopes.where(F.col("direction") == "forward").select("block.*")
            rows = blocks.ledger_rows(forward, policies, gaps=True)
            marks = envelopes.where(F.col("direction") == "backward").select(
                position.end_of_block(F.col("seq")).alias("seq"), F.col("point.slot").alias("slot")
            )
            self.process(rows, batch_id, marks)

        return process

    def _fields(self) -> list[tuple[str, str]]:
        return [tuple(f.split()) for f in self.STATE_SQL.split(", ")[1:]]

    def start(
        self, stream: DataFrame, checkpoint: str, extra: Sequence[Processor] = (), main: Processor | None = None
    ) -> StreamingQuery:
        return run_available(stream, [main or self.process, *extra], checkpoint)

    def reset(self) -> None:
        """Back to genesis: every table starts again empty, history and compactions included."""
        for table in (*self._schemas(), *self.WORK, "compact", "kept", "picks", "rollups", "archive"):
            drop_folder(self.spark, f"{self.base}/{table}")
        self.__init__(
            self.spark, self.base, self.width, self.compact_every, self.seq, self.keep_slots, self.snapshots_to, self.snapshot_slots
        )


def progress_figures() -> dict[str, Column]:
    """Figures of a batch, as ``progress.metrics`` gives them, for an observation."""
    return {
        "events": F.count(F.lit(1)),
        "first_slot": F.min("slot"),
        "last_slot": F.max("slot"),
        "current_slot": F.max_by("slot", "seq"),
        "current_hash": F.max_by("utxo", "seq"),
        "tip_hash": F.max_by("utxo", F.struct("slot", "seq")),
    }
