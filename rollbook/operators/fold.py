"""Keyed fold of ledger events into registry state.

Rules per asset, in arrival order:

* an owner event (mint, transfer) creates the asset or, unless it is late,
  replaces its output; an accepted mint while another output exists adds one to
  ``amount``; a late mint only lowers ``created``;
* a reference or virtual event needs a datum and creates the asset if need be
  (a reference creates a row that is not live: empty utxo);
* a settings event needs a datum and an existing asset;
* a burn takes one from ``amount``; at zero the asset is gone and the next
  event starts a new life.

Late means: slot below ``updated``, the greatest slot applied in this life.

Whether an event is accepted depends on everything before it, so this is a
sequential rule per asset. It runs over sorted partitions with constant memory.
An asset with very many events is cut into chunks of arrival order: each chunk
is summarised on its own, the summaries are chained per asset, and then all
chunks are folded in parallel from their exact incoming state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import datum as D
from rollbook.operators.skew import CHUNK_ROWS, split_counted

# Operation codes
MINT, TRANSFER, REFERENCE, VIRTUAL, SETTINGS, BURN, REJECT = range(7)
OWNER = (MINT, TRANSFER, VIRTUAL)


class Event(NamedTuple):
    op: int
    slot: int
    seq: int
    utxo: str
    holder: str
    lovelace: int
    datum: str | None
    valid: int  # 1 if the datum is an asset datum
    built: str | None  # what a row is built from when the asset is created, as JSON
    script: str | None  # of the output, as JSON


class State(NamedTuple):
    amount: int
    updated: int
    created: int
    life: int  # seq of the event that created the asset
    utxo: str
    holder: str
    lovelace: int
    datum: str | None
    reference_seq: int | None
    reference_datum: str | None
    settings_seq: int | None
    settings_datum: str | None
    # only of interest to whole registry rows
    built: str | None
    script: str | None
    valid_datum: str | None  # the last reference datum that was an asset datum
    virtual_datum: str | None
    reference_place: str | None  # output of the last reference or virtual event: utxo, lovelace, address
    settings_place: str | None


#: Fields every user of the fold asks for; the others are those of whole registry rows.
DETAIL = State._fields[:12]
PLACE_MARK = "\u001f"


def place(e: Event) -> str:
    return PLACE_MARK.join((e.utxo or "", str(e.lovelace or 0), e.holder or ""))


def advance(state: State | None, e: Event):
    """One event: ``(new state, accepted, saved)``. Saved events include late ones without effect."""
    if e.op == REJECT:
        return state, False, state is not None and e.slot < state.updated
    if e.op == BURN:
        if state is None:
            return None, False, False
        return (state._replace(amount=state.amount - 1) if state.amount > 1 else None), True, True
    if state is None:
        if e.op == SETTINGS:
            return None, False, False
        state = State(1, e.slot, e.slot, e.seq, "", "", 0, *[None] * 5, e.built, *[None] * 5)
    elif e.slot < state.updated:
        if e.op == MINT and e.slot < state.created:
            state = state._replace(created=e.slot)
        return state, False, True
    if e.op == SETTINGS:
        changes = {"settings_seq": e.seq, "settings_datum": e.datum, "settings_place": place(e)}
        return state._replace(updated=e.slot, **changes), True, True
    if e.op in (REFERENCE, VIRTUAL):
        changes = {"reference_seq": e.seq, "reference_datum": e.datum, "reference_place": place(e)}
        if e.valid:
            changes["valid_datum"] = e.datum
        if e.op == VIRTUAL:
            changes |= {"utxo": e.utxo, "holder": e.holder, "virtual_datum": e.datum}
        return state._replace(updated=e.slot, **changes), True, True
    twice = e.op == MINT and state.utxo != "" and state.utxo != e.utxo
    head = (state.amount + twice, e.slot, state.created, state.life)
    return State(*head, e.utxo, e.holder, e.lovelace, e.datum, *state[8:13], e.script, *state[14:]), True, True


def op_code(kind: Column, datum: Column) -> Column:
    """Operation of a ledger row; reference, virtual and settings rows without a datum are rejected."""
    code = F.when(kind == "mint", MINT).when(kind == "transfer", TRANSFER).when(kind == "burn", BURN)
    for name, value in (("reference", REFERENCE), ("virtual", VIRTUAL), ("settings", SETTINGS)):
        code = code.when((kind == name) & datum.isNotNull(), value)
    return code.otherwise(REJECT)


# ------------------------------------------------------------------ sorted-partition folds


def sorted_by_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """All rows of a key in one partition, sorted by key and order.

    ``mapInArrow`` asks for no distribution of its own. A plain ``repartition(*keys)``
    above a join on the same keys is planned away, and adaptive execution may then
    turn that join's shuffle into a local read. A hash of the keys is never
    taken for the partitioning a join left behind, so this shuffle stays.
    """
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)

STRINGS = ("utxo", "holder", "datum", "reference_datum", "settings_datum", *State._fields[12:])
PLACES = ("life", "reference_seq", "settings_seq")  # of the type of seq: long, or string for positions
BRIEF = ("amount", "updated", "created", "life", "utxo")


def state_sql(prefix: str, fields=State._fields, seq: str = "long") -> str:
    types = {f: "string" for f in STRINGS} | {f: seq for f in PLACES}
    return ", ".join(f"{prefix}{f} {types.get(f, 'long')}" for f in fields)


def _arrow_state(rows: list[State | None], prefix: str, fields=State._fields, seq: str = "long") -> dict[str, pa.Array]:
    texts = (*STRINGS, *PLACES) if seq == "string" else STRINGS
    at = {f: (State._fields.index(f), pa.string() if f in texts else pa.int64()) for f in fields}
    return {
        f"{prefix}{f}": pa.array([None if s is None else s[i] for s in rows], kind) for f, (i, kind) in at.items()
    }


def _values(batch: pa.RecordBatch, name: str) -> list:
    """A column as Python values; numpy is the quick way where it cannot change an integer."""
    column = batch.column(name)
    if column.null_count and not pa.types.is_string(column.type):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _events(batch: pa.RecordBatch) -> Iterator[tuple[tuple, Event]]:
    keys = zip(_values(batch, "name"), _values(batch, "chunk"))
    return zip(keys, map(Event._make, zip(*[_values(batch, f) for f in Event._fields])))


def _incoming(batch: pa.RecordBatch) -> list | None:
    return batch.column("in_life").to_pylist() if "in_life" in batch.schema.names else None


def _start(batch: pa.RecordBatch, lives: list | None, i: int) -> tuple[State | None, object]:
    """State and last save that row ``i``, the first of its key, starts from."""
    if lives is None:
        return None, None
    state = None if lives[i] is None else State(*(batch.column(f"in_{f}")[i].as_py() for f in State._fields))
    return state, batch.column("in_last_saved_seq")[i].as_py()


def _finisher(fields: tuple[str, ...], seq: str = "long"):
    def finish_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fold rows sorted by (name, chunk, seq) to a row for each (name, chunk)."""
        key, state, last, done = None, None, None, []

        def rows() -> pa.RecordBatch:
            out = {"name": pa.array([k[0] for k, _, _ in done], pa.string()), "chunk": pa.array([k[1] for k, _, _ in done], pa.int64())}
            out |= _arrow_state([state for _, state, _ in done], "", fields, seq)
            out["last_saved_seq"] = pa.array([save for _, _, save in done], pa.string() if seq == "string" else pa.int64())
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            lives = _incoming(batch)
            for i, (here, event) in enumerate(_events(batch)):
                if here != key:
                    if key is not None:
                        done.append((key, state, last))
                    key, (state, last) = here, _start(batch, lives, i)
                state, _, kept = advance(state, event)
                if kept:
                    last = event.seq
            if done:
                yield rows()
                done.clear()
        if key is not None:
            done.append((key, state, last))
            yield rows()

    return finish_partition


def _annotator(fields: tuple[str, ...], seq: str = "long", ends: bool = False):
    def annotate_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fold rows sorted by (name, chunk, seq); state is carried over batch borders. With ``ends`` a batch
        waits for the next one, which tells whether its last row is the last of its key."""
        key, state, last, waiting, is_end = None, None, None, None, []

        def marked() -> pa.RecordBatch:
            return waiting.append_column("is_end", pa.array(is_end, pa.bool_()))

        for batch in batches:
            lives = _incoming(batch)
            before, after, accepted, saved, saved_before, at_ends = [], [], [], [], [], []
            for i, (here, event) in enumerate(_events(batch)):
                if here != key:
                    if at_ends:
                        at_ends[-1] = True
                    elif is_end:
                        is_end[-1] = True
                    key, (state, last) = here, _start(batch, lives, i)
                at_ends.append(False)
                before.append(state)
                saved_before.append(last)
                state, ok, kept = advance(state, event)
                after.append(state)
                accepted.append(ok)
                saved.append(kept)
                if kept:
                    last = event.seq
            out = {n: batch.column(n) for n in batch.schema.names if not n.startswith("in_")}
            out["accepted"] = pa.array(accepted, pa.bool_())
            out["saved"] = pa.array(saved, pa.bool_())
            out["saved_before"] = pa.array(saved_before, pa.string() if seq == "string" else pa.int64())
            out |= _arrow_state(before, "old_", fields, seq) | _arrow_state(after, "new_", fields, seq)
            if not ends:
                yield pa.RecordBatch.from_pydict(out)
            elif at_ends:
                if waiting is not None:
                    yield marked()
                waiting, is_end = pa.RecordBatch.from_pydict(out), at_ends
        if waiting is not None:
            is_end[-1] = True
            yield marked()

    return annotate_partition


# A chunk's effect on an unknown incoming state, as a short list of operations.
#
# An event whose slot is not below any earlier slot of its asset is accepted for
# certain. A stretch of such events and burns acts in one of two ways. An asset
# that survives it changes like a probe that cannot die (``p_*``: fields that
# were set, and the change of amount). One that dies in it ends like one that
# did not exist before (``z_*``): from its death on both see the same events,
# and the one that started from nothing was not alive at that moment either.
# Kept as they are: the first certain owner event (it may repeat the incoming output), and
# late events before it, unless the asset was certainly alive and up to date (``sure``),
# in which case a late event can do no more than lower ``created``.
#
# After the first certain owner event the asset is alive, its output and its last slot are
# known, and only its amount is open. All that follows, late events too, then is a short
# table: ranges of the amount at that point, with what becomes of an asset in each.
RUN, BASE, TABLE = 7, 8, 9
def ops_sql(seq: str = "long") -> str:
    return (
        f"name string, chunk long, op_no long, op long, slot long, seq {seq}, utxo string, holder string, "
        f"lovelace long, datum string, valid long, built string, script string, low long, high long, {state_sql('p_', seq=seq)}, {state_sql('z_', seq=seq)}"
    )


def ops_arrow(seq: str = "long") -> pa.Schema:
    return pa.schema(
        [(n, pa.string() if t == "string" else pa.int64()) for n, t in (f.split() for f in ops_sql(seq).split(", "))]
    )


KEEP_TEXT, KEEP_INT = "\u0001keep", -1
IMMORTAL = 1 << 60


def _probe(first: Event | None, seq: str = "long") -> State:
    texts = (*STRINGS, *PLACES) if seq == "string" else STRINGS
    values = {f: KEEP_TEXT if f in texts else KEEP_INT for f in State._fields}
    values |= {"amount": IMMORTAL, "updated": -IMMORTAL, "created": IMMORTAL}
    if first is not None:
        values |= {"updated": first.slot, "utxo": first.utxo}
    return State(**values)


class _Stretch:
    """Summary of consecutive certain events before the first certain owner event."""

    def __init__(self, seq: str = "long"):
        self.probe, self.low, self.used, self.ghost = _probe(None, seq), 0, False, None

    def add(self, event: Event) -> None:
        self.used = True
        self.probe, _, _ = advance(self.probe, event)
        self.ghost, _, _ = advance(self.ghost, event)
        self.low = min(self.low, self.probe.amount - IMMORTAL)

    def row(self) -> dict:
        out = {"op": RUN, "low": self.low}
        out |= {f"p_{f}": v for f, v in self.probe._replace(amount=self.probe.amount - IMMORTAL)._asdict().items()}
        if self.ghost is not None:
            out |= {f"z_{f}": v for f, v in self.ghost._asdict().items()}
        return out


class _Table:
    """What becomes of an asset after the certain owner event ``first``, by its amount right after it.

    Assets of different amounts see the same events and differ in the amount until one dies;
    from then on its fate is known in full. A smaller amount never outlives a greater one,
    so those that share a fate are a range: ``dead`` holds these ranges in ascending
    order, and ``probe`` what all greater amounts, from ``low`` on, come to.
    """

    def __init__(self, first: Event, seq: str = "long"):
        self.probe, self.low, self.used = _probe(first, seq), 1, False
        self.dead: list[tuple[int, int, State | None]] = []

    def add(self, event: Event) -> None:
        self.used = True
        change = self.probe.amount - IMMORTAL
        self.probe, _, _ = advance(self.probe, event)
        if self.dead:
            self.dead = [(a, b, advance(state, event)[0]) for a, b, state in self.dead]
        if event.op != BURN:
            return
        if self.low + change == 1:
            self.dead.append((self.low, self.low, None))
            self.low += 1
        ranges: list[tuple[int, int, State | None]] = []
        for a, b, state in self.dead:
            if ranges and ranges[-1][2] == state:
                a = ranges.pop()[0]
            ranges.append((a, b, state))
        self.dead = ranges

    def rows(self) -> list[dict]:
        out = []
        for a, b, state in self.dead:
            known = {} if state is None else {f"z_{f}": v for f, v in state._asdict().items()}
            out.append({"op": TABLE, "low": a, "high": b, **known})
        alive = self.probe._replace(amount=self.probe.amount - IMMORTAL)
        return [*out, {"op": TABLE, "low": self.low, "high": IMMORTAL, **{f"p_{f}": v for f, v in alive._asdict().items()}}]


def _ghost_of(row: dict) -> State | None:
    return None if row["z_life"] is None else State(*(row[f"z_{f}"] for f in State._fields))


def run_stretch(state: State | None, row: dict) -> State | None:
    if state is None or state.amount + row["low"] <= 0:
        return _ghost_of(row)
    return _survived(state, row)


def _survived(state: State, row: dict) -> State:
    set_here = {
        f: row[f"p_{f}"]
        for f in State._fields[4:]
        if row[f"p_{f}"] not in (KEEP_TEXT, KEEP_INT)
    }
    return state._replace(
        amount=state.amount + row["p_amount"],
        updated=max(state.updated, row["p_updated"]),
        created=min(state.created, row["p_created"]),
        **set_here,
    )


def _summarise(batches: Iterator[pa.RecordBatch], seq: str = "long") -> Iterator[pa.RecordBatch]:
    """Rows sorted by (name, chunk, seq) with ``before_top``: greatest slot before the chunk."""
    key, stretch, table, top, rows, count, sure = None, _Stretch(seq), None, None, [], 0, False
    schema, nowhere = ops_arrow(seq), "" if seq == "string" else 0

    def emit(row: dict) -> None:
        nonlocal count
        rows.append({"name": key[0], "chunk": key[1], "op_no": count, **row})
        count += 1

    def close() -> None:
        if stretch.used:
            emit(stretch.row())
        if table is not None and table.used:
            for row in table.rows():
                emit(row)

    for batch in batches:
        tops = batch.column("before_top").to_pylist()
        for i, (here, event) in enumerate(_events(batch)):
            if here != key:
                close()
                key, stretch, table, top, count, sure = here, _Stretch(seq), None, tops[i], 0, False
                emit({"op": REJECT, "slot": 0, "seq": nowhere})  # without effect: every chunk gets a row
            if event.op == REJECT:
                continue
            if table is not None:
                table.add(event)
                continue
            late = event.op != BURN and top is not None and event.slot < top
            if event.op != BURN:
                top = event.slot if top is None else max(top, event.slot)
            if late and sure:
                if event.op == MINT:
                    stretch.add(event)
                continue
            if event.op == BURN:
                sure = False
            elif event.op != SETTINGS:
                sure = not late
            if not late and event.op not in OWNER:
                stretch.add(event)
                continue
            if stretch.used:
                emit(stretch.row())
            emit(event._asdict())
            stretch = _Stretch(seq)
            if not late:
                table = _Table(event, seq)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows.clear()
    close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _chain(batches: Iterator[pa.RecordBatch], seq: str = "long") -> Iterator[pa.RecordBatch]:
    """Operations sorted by (name, chunk, op_no) to the incoming state of every chunk."""
    key, state, entry = None, None, None
    fields = ops_arrow(seq).names
    for batch in batches:
        names, chunks, states = [], [], []
        for values in zip(*[_values(batch, f) for f in fields]):
            row = dict(zip(fields, values))
            here = (row["name"], row["chunk"])
            if here != key:
                if key is None or here[0] != key[0]:
                    state = None
                key = here
                names.append(here[0])
                chunks.append(here[1])
                states.append(state)
            if row["op"] != TABLE:
                entry = None
            if row["op"] == BASE:
                state = _ghost_of(row)
            elif row["op"] == TABLE:
                entry = entry or state  # the asset as it was before the table: its rows don't add up
                if row["low"] <= entry.amount <= row["high"]:
                    state = _ghost_of(row) if row["p_amount"] is None else _survived(entry, row)
            elif row["op"] == RUN:
                state = run_stretch(state, row)
            else:
                state, _, _ = advance(state, Event(*(row[f] for f in Event._fields)))
        out = {"name": pa.array(names, pa.string()), "chunk": pa.array(chunks, pa.int64())}
        yield pa.RecordBatch.from_pydict(out | _arrow_state(states, "in_", seq=seq))


def _field_nulls(prefix: str, seq: str) -> dict[str, Column]:
    types = (f.split() for f in state_sql(prefix, seq=seq).split(", "))
    return {name: F.lit(None).cast(kind) for name, kind in types}


def incoming_states(hot: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Exact state before every chunk of the hot assets: ``name, chunk, in_*``.

    ``base`` holds the states the fold starts from (``name`` and the state fields).
    """
    seq = dict(hot.dtypes)["seq"].replace("bigint", "long")
    carries_slot = F.when(~F.col("op").isin(BURN, REJECT), F.col("slot"))
    earlier = Window.partitionBy("name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = (
        hot.groupBy("name", "chunk")
        .agg(F.max(carries_slot).alias("top"))
        .select("name", "chunk", F.max("top").over(earlier).alias("before_top"))
    )
    if base is not None:
        names = hot.select("name").distinct()
        start = base.join(names, "name", "left_semi")
        tops = tops.join(start.select("name", "updated"), "name", "left").select(
            "name", "chunk", F.greatest("before_top", "updated").alias("before_top")
        )
    ops = (
        hot.select("name", "chunk", *Event._fields)
        .join(tops, ["name", "chunk"])
    )
    ops = sorted_by_key(ops, ["name", "chunk"], "seq").mapInArrow(partial(_summarise, seq=seq), ops_sql(seq))
    if base is not None:
        fixed = {"chunk": 0, "op_no": 0, "op": BASE}
        ops = ops.unionByName(
            start.select(
                "name",
                *[F.lit(v).cast("long").alias(c) for c, v in fixed.items()],
                *[F.col(f).alias(f"z_{f}") for f in State._fields],
            ),
            allowMissingColumns=True,
        ).select(*ops_arrow(seq).names)
    chained = sorted_by_key(ops, ["name"], "chunk", "op_no")
    return chained.mapInArrow(partial(_chain, seq=seq), f"name string, chunk long, {state_sql('in_', seq=seq)}")


def _payload(ledger: DataFrame, whole: bool) -> dict[str, Column]:
    """Columns of an event that a ledger may lack."""
    asked = F.when(F.col("kind").isin("reference", "virtual"), D.is_asset_datum(D.parts(F.col("datum")))).cast("long")
    lacking = {"valid": F.coalesce(asked, F.lit(0).cast("long")) if whole else F.lit(0).cast("long")}
    lacking |= {c: F.lit(None).cast("string") for c in ("built", "script")}
    return {c: v for c, v in lacking.items() if c not in ledger.columns}


def coded(ledger: DataFrame, whole: bool = False) -> DataFrame:
    """Ledger rows with all that an ``Event`` has."""
    return ledger.withColumns({"op": op_code(F.col("kind"), F.col("datum")).cast("long")} | _payload(ledger, whole))


#: What of an event a field of the state comes from, beside the rule's own ``op, slot, seq, utxo``.
SOURCES = {"holder": ("holder",), "lovelace": ("lovelace",), "built": ("built",), "script": ("script",), "valid_datum": ("valid", "datum")}
SOURCES |= {f: ("datum",) for f in ("datum", "reference_datum", "settings_datum", "virtual_datum")}
SOURCES |= {f: ("holder", "lovelace") for f in ("reference_place", "settings_place")}


def lean(events: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Coded events with no more than the fold needs for these fields of the state; the rest is null.
    ``keep`` names columns to carry along."""
    used = {"op", "slot", "seq", "utxo"}.union(*[SOURCES.get(f, ()) for f in fields])
    types = {"lovelace": "long", "valid": "long"}
    unused = {c: F.lit(None).cast(types.get(c, "string")) for c in Event._fields if c not in used}
    return events.withColumns(unused).select("name", *Event._fields, *keep)


def _prepared(events: DataFrame, width: int, base: DataFrame | None) -> tuple[DataFrame, bool]:
    """Events with their chunk and, where a fold may start from one, the state before them; and whether
    some assets are in several chunks."""
    seq = dict(events.dtypes)["seq"].replace("bigint", "long")
    cold, hot = split_counted(events, "name", "seq", width)
    no_save = F.lit(None).cast(seq)
    if base is not None:
        base = base.withColumns({f: F.lit(None).cast("string") for f in State._fields[12:] if f not in base.columns})
        last = F.col("last_saved_seq") if "last_saved_seq" in base.columns else no_save
        start = base.select("name", *[F.col(f).alias(f"in_{f}") for f in State._fields], last.alias("in_last_saved_seq"))
        cold = cold.join(start, "name", "left")
    elif hot is not None:
        cold = cold.withColumns(_field_nulls("in_", seq) | {"in_last_saved_seq": no_save})
    if hot is None:
        return cold, False
    warm = hot.join(incoming_states(hot, base), ["name", "chunk"], "left").withColumn("in_last_saved_seq", no_save)
    return cold.unionByName(warm), True


def current(ledger: DataFrame, width: int = CHUNK_ROWS, detail: bool = False, whole: bool = False) -> DataFrame:
    """``current_state`` of the annotated ledger, without a row for each event: a partition gives the
    state after the last event of each asset (of each chunk of a hot one)."""
    fields = State._fields if whole else DETAIL if detail else BRIEF
    return folded(lean(coded(ledger, whole), fields), fields, width)


def folded(events: DataFrame, fields: Sequence[str], width: int = CHUNK_ROWS) -> DataFrame:
    """These fields of the states that coded events come to, of assets that exist. The events are read twice."""
    fields = ("life", *[f for f in fields if f != "life"])
    seq = dict(events.dtypes)["seq"].replace("bigint", "long")
    both, chunked = _prepared(events.select("name", *Event._fields), width, None)
    both = both.select("name", "chunk", *Event._fields, *[c for c in both.columns if c.startswith("in_")])
    schema = f"name string, chunk long, {state_sql('', fields, seq)}, last_saved_seq {seq}"
    last = sorted_by_key(both, ["name", "chunk"], "seq").mapInArrow(_finisher(fields, seq), schema)
    if chunked:
        ends = last.groupBy("name").agg(
            F.max_by(F.struct(*fields), "chunk").alias("state"), F.max("last_saved_seq").alias("last_saved_seq")
        )
        last = ends.select("name", "state.*", "last_saved_seq")
    return last.drop("chunk").where(F.col("life").isNotNull())


def annotate(
    ledger: DataFrame,
    width: int = CHUNK_ROWS,
    detail: bool = False,
    base: DataFrame | None = None,
    whole: bool = False,
    ends: bool = False,
) -> DataFrame:
    """Every ledger row with ``accepted``, ``saved`` and the state before and after it.

    ``detail`` adds the payload fields to the states, ``whole`` all that registry rows need; the brief
    form has the counters, the life and the output only. ``base`` gives states to start from, with the
    arrival of their last save. ``saved_before`` is the asset's save before a row; for a
    chunk of a hot asset it starts anew (``with_saves_before`` adds the earlier chunks). ``ends`` adds
    ``is_end``, which marks the last row of each asset (of each chunk of a hot one).
    """
    fields = State._fields if whole else DETAIL if detail else BRIEF
    seq = dict(ledger.dtypes)["seq"].replace("bigint", "long")
    both, _ = _prepared(coded(ledger, whole), width, base)
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if not f.name.startswith("in_")]
        + ["accepted boolean", "saved boolean", f"saved_before {seq}", state_sql("old_", fields, seq), state_sql("new_", fields, seq)]
        + ["is_end boolean"] * ends
    )
    ordered = sorted_by_key(both, ["name", "chunk"], "seq")
    return ordered.mapInArrow(_annotator(fields, seq, ends), schema)


# ------------------------------------------------------------------ from annotated rows to tables


def final_state(annotated: DataFrame) -> DataFrame:
    """One row per asset seen, with nulls for those that are gone. Mergeable aggregates
    only: a hot asset, spread over many chunks, shuffles one partial row per task. Where the
    last rows of assets and chunks are marked, only these are aggregated."""
    fields = [c[4:] for c in annotated.columns if c.startswith("new_")]
    save = F.when(F.col("saved"), F.col("seq"))
    if "is_end" in annotated.columns:
        annotated, save = annotated.where("is_end"), F.coalesce(save, F.col("saved_before"))
    last = annotated.groupBy("name").agg(
        F.max_by(F.struct(*[F.col(f"new_{f}").alias(f) for f in fields]), "seq").alias("state"),
        F.max(save).alias("last_saved_seq"),
    )
    return last.select("name", "state.*", "last_saved_seq")


def current_state(annotated: DataFrame) -> DataFrame:
    """One row per asset that exists."""
    return final_state(annotated).where(F.col("life").isNotNull())


LOG_FIELDS = tuple(f for f in DETAIL if not f.endswith("datum") and f != "life")


def change_log(annotated: DataFrame) -> DataFrame:
    """``slot, seq, name, old, new, changed``: one row per change of state.

    ``old`` is null for a creation and ``new`` for a removal. Keyed by arrival, so
    two changes of one asset in one slot stay two rows. A late mint is logged at
    the slot the asset was last updated, everything else at the event's slot.
    """

    return sides(annotated, "seq", "name").where(F.size("changed") > 0)


def sides(annotated: DataFrame, *columns: str | Column) -> DataFrame:
    """``slot``, the columns asked for, the states before and after each row, and the names of the fields that differ."""

    def side(name: str) -> Column:
        fields = [f for f in State._fields if f"{name}_{f}" in annotated.columns]
        body = F.struct(*[F.col(f"{name}_{f}").alias(f) for f in fields])
        return F.when(F.col(f"{name}_life").isNotNull(), body)

    at = F.when(F.col("accepted"), F.col("slot")).otherwise(F.col("new_updated"))
    both = annotated.select(at.alias("slot"), *columns, side("old").alias("old"), side("new").alias("new"))
    return both.withColumn("changed", changed_fields(F.col("old"), F.col("new"), LOG_FIELDS))


def with_saves_before(annotated: DataFrame, base: DataFrame) -> DataFrame:
    """Complete ``saved_before`` in the chunks of hot assets: one row a chunk carries the last save on."""
    hot = annotated.where(F.col("chunk") > 0)
    if hot.isEmpty():
        return annotated
    saves = hot.groupBy("name", "chunk").agg(F.max(F.when(F.col("saved"), F.col("seq"))).alias("save"))
    earlier = Window.partitionBy("name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = base.select("name", F.col("last_saved_seq").alias("first_save"))
    carry = saves.withColumn("save", F.max("save").over(earlier)).join(first, "name", "left")
    carry = carry.select("name", "chunk", F.greatest("save", "first_save").alias("carried"))
    found = annotated.join(F.broadcast(carry), ["name", "chunk"], "left")  # a row for each chunk of a hot asset
    return found.withColumn("saved_before", F.greatest("saved_before", "carried")).select(*annotated.columns)


def changed_fields(old: Column, new: Column, fields) -> Column:
    """Names of the fields that differ; a creation or a removal lists all that are set."""
    return F.array_compact(
        F.array(*[F.when(~old[f].eqNullSafe(new[f]), F.lit(f)) for f in fields])
    )
