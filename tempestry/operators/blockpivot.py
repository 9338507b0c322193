"""Entity, attribute, value rows into wide typed tables, block of columns by block of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.session import small, written

#: Attributes become part of the plan; more than this raise.
MAX_ATTRIBUTES = 20_000
# Words and letters for yes and no.
YES = ("Y", "YES", "TRUE", "T", "ON")
NO = ("N", "NO", "FALSE", "F", "OFF")


def _bare(text: Column) -> Column:
    """text without blanks of any kind around it."""
    return F.regexp_replace(text, r"^[\s\xa0]+|[\s\xa0]+$", "")


def number(text: Column) -> Column:
    """Text as a double in any usual notation: decimal comma or point, sign, exponent, blanks around it; else null."""
    t = F.replace(_bare(text), F.lit("\u2212"), F.lit("-"))
    plain = t.rlike(r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$")
    return F.when(plain, F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


def yes_no(text: Column) -> Column:
    """1.0 or 0.0 for a word or letter for yes or no, else null."""
    t = F.upper(_bare(text))
    return F.when(t.isin(*YES), 1.0).when(t.isin(*NO), 0.0)


def column_names(attributes: list[str], entity: list[str]) -> dict[str, str]:
    """The column of each attribute: its name, with underscores added while it or its _state is taken (whatever the case) by an entity
    column or an attribute before it."""
    used, out = {c.lower() for c in entity}, {}
    for a in attributes:
        c = a
        while {c.lower(), f"{c}_state".lower()} & used:
            c += "_"
        used |= {c.lower(), f"{c}_state".lower()}
        out[a] = c
    return out


def reduced_cells(cells: DataFrame, entity: list[str], attribute: str, value: str) -> DataFrame:
    """One row per entity and attribute: the lowest and highest usable value (_lo, _hi; both null where none is usable).

    Rows with a null entity column or attribute are left out; NaN is not usable. Combined on the map side, so an entity, an attribute or a
    single cell may hold most of the rows."""
    cells = cells.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*entity, attribute]]))
    usable = F.when(~F.isnan(value), F.col(value))
    return cells.groupBy(*entity, attribute).agg(F.min(usable).alias("_lo"), F.max(usable).alias("_hi"))


def attributes_of(reduced: DataFrame, attribute: str) -> list[str]:
    """The attributes there are, sorted; more than MAX_ATTRIBUTES raise."""
    found = sorted(r[0] for r in reduced.select(attribute).distinct().limit(MAX_ATTRIBUTES + 1).collect())
    if len(found) > MAX_ATTRIBUTES:
        raise ValueError("more attributes than columns can be made of")
    return found


def wide_table(cells: DataFrame, entity: list[str], attribute: str, value: str, attributes: list[str] | None = None, block: int = 256) -> DataFrame:
    """One row per entity; per attribute A a double column A and a column A_state.

    cells: entity columns, attribute and a double value (null: not usable). A_state is null where the entity has no rows of
    A, `empty` if none of them is usable, `contested` if the usable ones differ (A is then null), else `ok`. NaN is not
    usable. Rows with a null entity column or attribute are left out; an empty table gives no rows. attributes: the
    columns to make, in this order (entities of other attributes only have a row of nulls), by default all there are, sorted;
    over MAX_ATTRIBUTES, listed or found, raise. Names that clash are told apart as column_names does.

    The cells are scanned once, reduced to one row a cell and, where the attributes must be found first, written in between. See
    pivot_blocks for the rest."""
    if attributes is not None and len(attributes) > MAX_ATTRIBUTES:
        raise ValueError("more attributes than columns can be made of")
    reduced = reduced_cells(cells, entity, attribute, value)
    if attributes is None:
        reduced = written(reduced)
        attributes = attributes_of(reduced, attribute)
    return pivot_blocks(reduced, entity, attribute, attributes, block)


def pivot_blocks(reduced: DataFrame, entity: list[str], attribute: str, attributes: list[str], block: int = 256) -> DataFrame:
    """reduced_cells as a wide table (see wide_table).

    Attributes are divided into blocks. Cells are hashed by their entity once; where they lie, each block of an entity is
    pivoted into a map of at most `block` cells, and the blocks are joined side by side by a second aggregate under the same hashing, so
    neither step shuffles again. A column then looks its cell up in its own block's map: work grows with cells times block,
    not with cells times attributes, and the source is read once for any number of blocks."""
    if not attributes:
        return reduced.select(*entity).distinct()
    spark = reduced.sparkSession
    called = column_names(attributes, entity)
    places = spark.createDataFrame([(a, i // block, i % block) for i, a in enumerate(attributes)], "_a string, _block int, _at int")
    x = reduced.join(F.broadcast(places), F.col(attribute) == F.col("_a"), "left")  # at most MAX_ATTRIBUTES rows
    x = x.select(*entity, "_block", "_at", "_lo", "_hi").repartition(*entity)
    cell = F.struct("_at", F.struct("_lo", "_hi").alias("_v"))
    x = x.groupBy(*entity, "_block").agg(F.map_from_entries(F.collect_list(F.when(F.col("_at").isNotNull(), cell))).alias("_cells"))  # at most `block` cells
    blocks = range(-(-len(attributes) // block))
    x = x.groupBy(*entity).agg(*[F.first(F.when(F.col("_block") == b, F.col("_cells")), ignorenulls=True).alias(f"_b{b}") for b in blocks])
    out = []
    for i, a in enumerate(attributes):
        v = F.try_element_at(f"_b{i // block}", F.lit(i % block))
        lo, hi = v["_lo"], v["_hi"]
        out += [F.when(lo == hi, lo).alias(called[a]), F.when(v.isNotNull(), F.when(lo.isNull(), "empty").when(lo != hi, "contested").otherwise("ok")).alias(f"{called[a]}_state")]
    return x.select(*entity, *out)


def weather_cells(obs: DataFrame, stations: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """weather_obs with its spelling set right: station as in stations.id, day, datatype in capitals, number; and the columns
    of carry as they are.

    Stations that aren't in the table keep their code in capitals with the GHCND: prefix. WT datatypes also take words
    for yes and no."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.upper(c), r"\s+", ""), "^GHCND:", "")
    datatype = F.upper(F.regexp_replace("datatype", r"\s+", ""))
    read = F.coalesce(number(F.col("value")), F.when(datatype.startswith("WT"), yes_no(F.col("value"))))
    known = stations.select(F.col("id").alias("_id"), bare(F.col("id")).alias("_code"))
    x = obs.select(bare(F.col("station")).alias("_c"), F.col("date").cast("date").alias("day"), datatype.alias("datatype"), read.alias("number"), *carry)
    x = x.join(small(known), F.col("_c") == F.col("_code"), "left")
    return x.select(F.coalesce("_id", F.concat(F.lit("GHCND:"), "_c")).alias("station"), "day", "datatype", "number", *carry)


def cell_states(wide: DataFrame, entity: list[str], attributes: list[str]) -> DataFrame:
    """The wide table's states in long form: entity, datatype, state; cells without rows are left out."""
    called = column_names(attributes, entity)
    empty = F.array().cast("array<struct<datatype:string,state:string>>")
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("datatype"), F.col(f"`{called[a]}_state`").alias("state")) for a in attributes]) if attributes else empty).alias("_x")
    return wide.select(*entity, pairs).select(*entity, "_x.datatype", "_x.state").where(F.col("state").isNotNull())
