"""Search over the registry: filters, orders, pages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import scalars as S

PAGE_SIZE = 100  # default page
MAX_PAGE = 1000  # largest page

# Messages for bad parameters.
MESSAGES = {
    "records_per_page": "'records_per_page' must be a number",
    "sort": "'sort' must be 'desc', 'asc', or 'random'",
    "characters": "characters must be " + ", ".join(S.CHARACTER_CLASSES),
    "length": "Length must be a number or a range of numbers (ex: 1-28) and can't exceed 28",
    "rarity": "rarity must be " + ", ".join(S.RARITIES),
    "numeric_modifiers": "numeric_modifiers must be " + ", ".join(S.NUMERIC_MODIFIERS),
    "handle_type": "handle_type must be " + ", ".join(S.ASSET_TYPES),
    "search": "search must be at least 3 characters",
    "page_slot": "'page' and 'slot_number' can't be used together",
    "list": "expected array and received object",
}


def _bounds(text: str) -> tuple[int, int] | None:
    parts = text.split("-")
    if not 1 <= len(parts) <= 2 or not all(p.isdigit() for p in parts):
        return None
    low, high = int(parts[0]), int(parts[-1])
    return (low, high) if high <= S.MAX_NAME_LENGTH and low <= S.MAX_NAME_LENGTH else None


def _check(ok: bool, param: str) -> None:
    if not ok:
        raise ValueError(MESSAGES[param])


@dataclass
class SearchSpec:
    """Filters, all ANDed. ``None`` means "no filter"; ``names`` may be a list or a DataFrame."""

    characters: str | None = None
    length: str | int | None = None
    rarity: str | None = None
    numeric_modifiers: str | None = None
    search: str | None = None
    holder: str | None = None
    og: bool = False
    asset_type: str | None = None
    personalized: bool = False
    names: list[str] | DataFrame | None = None

    def __post_init__(self):
        if self.characters:
            _check(set(self.characters.split(",")) <= set(S.CHARACTER_CLASSES), "characters")
        if self.length:
            _check(_bounds(str(self.length)) is not None, "length")
        if self.rarity:
            _check(self.rarity in S.RARITIES, "rarity")
        if self.numeric_modifiers:
            _check(set(self.numeric_modifiers.split(",")) <= set(S.NUMERIC_MODIFIERS), "numeric_modifiers")
        if self.asset_type:
            _check(self.asset_type in S.ASSET_TYPES, "handle_type")
        if self.search:
            _check(len(self.search) >= 3, "search")
        if self.names is not None:
            _check(isinstance(self.names, (list, DataFrame)), "list")

    @property
    def indexed(self) -> bool:
        """Whether a filter other than text, type and list is present."""
        return bool(
            self.characters
            or self.length
            or self.rarity
            or self.numeric_modifiers
            or self.holder
            or self.og
        )


@dataclass
class PageSpec:
    page: int | None = None
    sort: str = "asc"
    size: int | str = PAGE_SIZE
    slot: int | None = None
    show_all: bool = False
    after: str | None = None  # last name of the page before: the next page without an offset
    seed: int = field(default=42)

    def __post_init__(self):
        _check(str(self.size).isdigit(), "records_per_page")
        self.size = int(self.size)
        if not 1 <= self.size <= MAX_PAGE:
            raise ValueError(f"a page has 1 to {MAX_PAGE} rows")
        _check(self.sort in S.SORTS, "sort")
        _check(self.page is None or self.slot is None, "page_slot")
        _check(self.after is None or (self.page is None and self.slot is None), "page_slot")

    @property
    def offset(self) -> int:
        return ((self.page or 1) - 1) * self.size


def length_between(length: Column, text: str | int) -> Column:
    low, high = _bounds(str(text))
    return length.between(low, high)


def matches(registry: DataFrame, spec: SearchSpec) -> DataFrame:
    """Live rows that meet every filter; one conjunction, so it reaches the scan."""
    keep = S.live(F.col("utxo"))
    if spec.characters:
        keep &= F.col("characters") == spec.characters
    if spec.length:
        keep &= length_between(F.col("length"), spec.length)
    if spec.rarity:
        keep &= F.col("rarity") == spec.rarity
    if spec.numeric_modifiers:
        keep &= F.col("numeric_modifiers") == spec.numeric_modifiers
    if spec.og:
        keep &= F.col("og_number") != 0
    if spec.holder:
        keep &= F.col("holder") == spec.holder
    if spec.search:
        found = F.col("name").contains(spec.search)
        keep &= found if spec.indexed else found | F.col("hex").contains(spec.search)
    if spec.asset_type:
        keep &= F.col("asset_type") == spec.asset_type
    if spec.personalized:
        keep &= S.personalized(F.col("image_hash"), F.col("standard_image_hash"))
    rows = registry.where(keep)
    if spec.names is None:
        return rows
    names = spec.names
    if isinstance(names, list):
        names = registry.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return rows.join(names.select("name"), "name", "left_semi")


def shuffled(name: Column, seed: int) -> Column:
    """A name's place in the random order of a seed: a keyed digest, so pages of one seed fit
    together whatever the partitions, and a page can start after a name."""
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def order_columns(page: PageSpec) -> list[Column]:
    if page.slot is not None:
        slot = F.col("updated_slot")
        return [slot.desc() if page.sort == "desc" else slot.asc(), S.sort_name(F.col("name")).asc()]
    if page.sort == "random":
        return [shuffled(F.col("name"), page.seed), F.col("name")]
    name = S.sort_name(F.col("name"))
    return [name.desc() if page.sort == "desc" else name.asc()]


def from_slot(rows: DataFrame, page: PageSpec) -> DataFrame:
    """Keyset start of a slot cursor: no offset, so it is a pushed-down filter."""
    slot = F.col("updated_slot")
    return rows.where(slot <= page.slot if page.sort == "desc" else slot >= page.slot)


def skip_first(rows: DataFrame, page: PageSpec) -> DataFrame:
    """All rows after the first ``offset``, without moving everything to one task.

    A top-k finds the last skipped name; the rest is a filter against that one value.
    """
    if not page.offset:
        return rows
    last = rows.select("name").orderBy(*order_columns(page)).limit(page.offset)
    if page.sort == "random":
        place = F.struct(*order_columns(page))
        return rows.where(place > last.agg(F.max(place)).scalar())
    name = S.sort_name(F.col("name"))
    if page.sort == "desc":
        return rows.where(name < last.agg(F.min(name)).scalar())
    return rows.where(name > last.agg(F.max(name)).scalar())


def from_name(rows: DataFrame, page: PageSpec) -> DataFrame:
    """Rows that follow the name ``page.after`` in the page's order."""
    if page.sort == "random":
        last = F.struct(shuffled(F.lit(page.after), page.seed), F.lit(page.after))
        return rows.where(F.struct(*order_columns(page)) > last)
    name, last = S.sort_name(F.col("name")), S.sort_name(F.lit(page.after))
    return rows.where(name < last if page.sort == "desc" else name > last)


def paged(rows: DataFrame, page: PageSpec) -> DataFrame:
    """One page in order, or all rows from the page's start when ``show_all``.

    A page number reads ``offset + size`` rows into the last step; far into a large
    table use the keyset ``after``, which is a filter.
    """
    if page.after is not None:
        ordered = from_name(rows, page).orderBy(*order_columns(page))
        return ordered if page.show_all else ordered.limit(page.size)
    if page.slot is not None:
        rows = from_slot(rows, page)
        ordered = rows.orderBy(*order_columns(page))
        return ordered if page.show_all else ordered.limit(page.size)
    if page.show_all:
        return skip_first(rows, page).orderBy(*order_columns(page))
    return rows.orderBy(*order_columns(page)).offset(page.offset).limit(page.size)


# ------------------------------------------------------------------ substring index

GRAM = 3  # the shortest text that can be searched


def grams(text: Column) -> Column:
    """All different stretches of ``GRAM`` characters of a text."""
    count = F.greatest(F.length(text) - (GRAM - 1), F.lit(0))
    places = F.filter(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: i <= count)
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(GRAM))))


def _grams_of(texts: pa.Array) -> pa.Table:
    """``row, gram``: all stretches of ``GRAM`` characters of the texts, place by place."""
    rows, found, start = pa.array(range(len(texts)), pa.int32()), [], 0
    while len(texts):
        long = pc.greater_equal(pc.utf8_length(texts), start + GRAM)  # null for a null text: left out
        texts, rows = texts.filter(long), rows.filter(long)
        found.append(pa.table({"row": rows, "gram": pc.utf8_slice_codeunits(texts, start, start + GRAM)}))
        start += 1
    return pa.concat_tables(found) if found else pa.table({"row": rows, "gram": pa.array([], pa.string())})


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of rows, and for each stretch the numbers of the rows in it that hold it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, held = batch.column("block")[0].as_py(), batch.drop_columns(["block"])
        name, hexed = held.column("name"), held.column("hex")
        whole = pc.and_(name.is_valid(), hexed.is_valid())
        name, hexed = (pc.if_else(whole, c, pa.scalar(None, c.type)) for c in (name, hexed))
        every = pa.concat_tables([_grams_of(name), _grams_of(hexed)]).group_by(["gram", "row"]).aggregate([])
        lists = every.sort_by([("gram", "ascending"), ("row", "ascending")])
        lists = lists.group_by("gram", use_threads=False).aggregate([("row", "list")])
        grams = [None, *lists.column("gram").to_pylist()]
        rows = held.to_struct_array()
        ends = pa.array([0, *[len(rows)] * len(grams)], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(grams, pa.string()),
                pa.array([block] * len(grams), pa.int64()),
                pa.array([None, *lists.column("row_list").to_pylist()], pa.list_(pa.int32())),
                pa.ListArray.from_arrays(ends, rows),
            ],
            ["gram", "block", "rows", "held"],
        )


def postings(registry: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows in blocks, once each with what a search shows, and for each stretch of their names or hexes the numbers
    of the rows that hold it, a list per block, clustered by stretch: a search reads the part of the table that
    has its lists, and the rows of the blocks. A stretch of very many names is a short list in each of many blocks."""
    rows = registry.select("name", "hex", *columns)
    schema = f"gram string, block long, rows array<int>, held array<{rows.schema.simpleString()}>"
    posted = rows.withColumn("block", F.monotonically_increasing_id()).mapInArrow(_post, schema)
    return posted.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")


def search_postings(index: DataFrame, text: str) -> DataFrame:
    """Rows whose name or hex holds ``text``: those posted under its rarest stretch, each verified."""
    _check(len(text) >= GRAM, "search")
    asked = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    rarest = asked[0]
    if len(asked) > 1:
        held = index.where(F.col("gram").isin(asked)).groupBy("gram").agg(F.sum(F.size("rows")).alias("rows"))
        counts = {r["gram"]: r["rows"] for r in held.collect()}
        rarest = min(asked, key=lambda g: (counts.get(g, 0), g))
    found = F.col("name").contains(text) | F.col("hex").contains(text)
    lists = index.where(F.col("gram") == rarest).select("block", "rows")
    blocks = index.where(F.col("gram").isNull()).select("block", "held")
    posted = blocks.join(lists, "block").select(F.explode(F.transform("rows", lambda i: F.get("held", i))).alias("row"))
    return posted.select("row.*").where(found)


def search_total(rows: DataFrame) -> Column:
    """Number of matches as a scalar to put next to a page."""
    return rows.agg(F.count(F.lit(1))).scalar()


def param_error(param: Column, value: Column) -> Column:
    """Bulk form of the checks above: message of the broken rule, else null."""

    def subset(allowed) -> Column:
        items = F.array(*[F.lit(a) for a in allowed])
        return F.size(F.array_except(F.split(value, ","), items)) == 0

    low = F.split_part(value, F.lit("-"), F.lit(1)).try_cast("int")
    high = F.element_at(F.split(value, "-"), -1).try_cast("int")
    length_ok = value.rlike(r"^\d+(-\d+)?$") & (low <= S.MAX_NAME_LENGTH) & (high <= S.MAX_NAME_LENGTH)
    rules = {
        "records_per_page": value.rlike(r"^\d+$"),
        "sort": value.isin(*S.SORTS),
        "characters": subset(S.CHARACTER_CLASSES),
        "length": F.coalesce(length_ok, F.lit(False)),
        "rarity": value.isin(*S.RARITIES),
        "numeric_modifiers": subset(S.NUMERIC_MODIFIERS),
        "handle_type": value.isin(*S.ASSET_TYPES),
        "search": F.length(value) >= 3,
    }
    error = F.lit(None).cast("string")
    for name, ok in rules.items():
        error = F.when((param == name) & ~ok, MESSAGES[name]).otherwise(error)
    return error
