"""Files whose fields drift: one typed table with a rescue column, and a report of every change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.columns import fips5, once
from tempestry.session import small

#: What a mapping of delivered to canonical names may hold; it becomes part of the plan.
MAX_NAMES = 10_000


def json_fields(payload: Column) -> Column:
    """map<key, variant> of a JSON object; null for null, for text that is no JSON object or repeats a key."""
    return F.from_json(payload, "map<string,variant>", {"mode": "PERMISSIVE"})


def json_type(v: Column) -> Column:
    """string, integer, decimal, boolean, object or array; null for a JSON null."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.isNull() | (s == "VOID"), F.lit(None).cast("string"))
        .when(s == "STRING", "string")
        .when((s == "BIGINT") | s.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("decimal")
    )


def _plain(v: Column) -> Column:
    """The value as text; one in an array of one, or under v, name or value of an object, is taken out."""
    text = F.try_variant_get(v, "$", "string")
    inner = F.coalesce(*[F.try_variant_get(v, p, "string") for p in ("$.v", "$.name", "$.value", "$[0]")])
    return F.when(text.rlike(r"^[\[{]"), F.when(json_type(v).isin("object", "array"), inner).otherwise(text)).otherwise(text)


def _moment(t: Column) -> Column:
    digits = t.rlike(r"^\d{9,10}$")
    return F.when(digits, F.timestamp_seconds(F.when(digits, t).try_cast("bigint"))).otherwise(F.concat(F.regexp_replace(F.trim(t), r"(Z|\+00:?00)$", ""), F.lit("+00:00")).try_cast("timestamp"))


#: How text becomes a value of each kind; null if it can't.
CASTS = {
    "string": lambda t: F.when(F.trim(t) != "", F.trim(t)),
    "fips": fips5,
    "bigint": lambda t: F.when(F.trim(t).rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(F.trim(t), r"\.0*$", "").try_cast("bigint")),
    "double": lambda t: F.trim(t).try_cast("double"),
    "boolean": lambda t: F.lower(F.trim(t)).try_cast("boolean"),
    "timestamp": _moment,
}
#: The target schema of the outage files.
OUTAGE_FIELDS = {"fips_code": "fips", "customers_out": "bigint", "run_start_time": "timestamp", "customers_total": "bigint", "state": "string", "any_out": "boolean", "utility": "string"}


def names_of(field_names: DataFrame) -> dict[str, list[str]]:
    """canonical -> delivered names, from a mapping table of at most MAX_NAMES rows (more raise)."""
    rows = field_names.where(F.col("field").isNotNull() & F.col("seen_name").isNotNull()).select("field", "seen_name").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError("the mapping of names is too large to become part of a plan")
    out: dict[str, list[str]] = {}
    for r in sorted(map(tuple, rows)):
        out.setdefault(r[0], []).append(r[1])
    return out


def _typed(m: Column, names: list[str], kind: str) -> Column:
    return F.coalesce(*[CASTS[kind](_plain(F.try_element_at(m, F.lit(n)))) for n in names])


def rescue_ingest(df: DataFrame, payload: str, names: dict[str, list[str]], target: dict[str, str] = OUTAGE_FIELDS, keep: list[str] | None = None) -> DataFrame:
    """Each record as one row: the columns `keep` (default: all but payload), the target's fields, typed, and _rescued.

    A field is read under its canonical and all its delivered names; the first that can be cast counts. _rescued is a
    JSON object, or null if empty, of what found no place: keys of no target field, and values that are not null
    and can't be cast. A payload that is no JSON object stands under "_payload" there; a null payload gives nulls.
    No shuffle. Columns kept whose names clash with target fields are replaced by the fields."""
    m = F.col("__map")
    keep = [c for c in (keep if keep is not None else df.columns) if c not in {payload, *target, "_rescued"}]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row") if keep else F.lit(None).alias("__row")  # as one column: no name of df's can clash
    known = {f: list(dict.fromkeys([f, *names.get(f, [])])) for f in target}
    every = [(f, n) for f in target for n in known[f]]
    x = once(df.select(row, F.col(payload).alias("__payload")), {"__map": json_fields(F.col("__payload"))})
    # Over arrays, not name by name: the code for each name would outgrow what the JVM compiles.
    texts = lambda ns: F.transform(F.array(*[F.lit(n) for n in ns]), lambda n: _plain(F.try_element_at(m, n)))
    x = once(x, {f"__t{k}": texts(known[f]) for k, f in enumerate(target)})
    x = once(x, {f"__c{k}": F.transform(f"__t{k}", CASTS[kind]) for k, kind in enumerate(target.values())})
    fields = [F.get(F.filter(f"__c{k}", lambda v: v.isNotNull()), F.lit(0)).alias(f) for k, f in enumerate(target)]
    lost = F.array_compact(F.array(*[F.when(F.get(f"__c{k}", F.lit(i)).isNull(), F.lit(n)) for k, f in enumerate(target) for i, n in enumerate(known[f])]))
    x = once(x.select("__row", "__payload", "__map", *fields, lost.alias("__lost")), {"__kept": F.col("__lost")})
    lost, allowed = F.col("__kept"), F.array(*[F.lit(n) for _, n in every])
    rest = F.map_filter(m, lambda k, v: (~F.array_contains(allowed, k) | F.array_contains(lost, k)) & json_type(v).isNotNull())
    broken = F.when(m.isNull() & F.col("__payload").isNotNull(), F.to_json(F.create_map(F.lit("_payload"), F.col("__payload"))))
    rescued = F.coalesce(F.when(F.size(rest) > 0, F.to_json(rest)), broken)
    x = x.select("__row", *target, rescued.alias("_rescued"))
    return x.select(*[F.col("__row")[c].alias(c) for c in keep], *target, "_rescued")


def replay(df: DataFrame, promote: dict[str, str], names: dict[str, list[str]] | None = None) -> DataFrame:
    """Rescued values moved into typed columns: for each field of promote (name -> kind), from _rescued, under its
    canonical and delivered names. A column that is there already keeps its values and gets only its nulls filled.
    What is moved leaves _rescued; what can't be cast stays."""
    names, m = names or {}, F.col("__replayed")
    x = df.withColumn("__replayed", json_fields(F.col("_rescued")))
    gone = []
    for f, kind in promote.items():
        all_names = list(dict.fromkeys([f, *names.get(f, [])]))
        got = _typed(m, all_names, kind)
        x = x.withColumn(f, F.coalesce(F.col(f), got) if f in df.columns else got)
        gone += [F.when(CASTS[kind](_plain(F.try_element_at(m, F.lit(n)))).isNotNull(), F.lit(n)) for n in all_names]
    rest = F.map_filter(m, lambda k, v: ~F.array_contains(F.array_compact(F.array(*gone)), k))
    return x.withColumn("_rescued", F.when(F.size(rest) > 0, F.to_json(rest)).when(m.isNull(), F.col("_rescued"))).drop("__replayed")


def field_changes(df: DataFrame, publisher: str, file_name: str, file_date: str, payload: str, field_names: DataFrame) -> DataFrame:
    """Every change of a publisher's fields from one file to the next (by file_date, then name).

    Columns: publisher, file_name, field, change (added, removed, renamed, retyped), before and after (names or types).
    field is canonical by field_names (matched to the letter), else as delivered. A file has a field if any record has
    the key, null or not. renamed: the set of delivered names differs. retyped: the set of JSON types of non-null values
    differs, where both files have such values. A payload that is no JSON object has no fields, but its file counts.
    Records repeated or late change nothing.

    Keys are made distinct per file on the map side before the shuffle; what meets in one task afterwards is one row a
    file (a map of its fields), so a publisher's group is bounded by its files."""
    seen = small(field_names.select(F.col("seen_name").alias("_seen"), F.col("field").alias("_field")).where(F.col("_seen").isNotNull()).dropDuplicates(["_seen"]))
    cells = df.select(F.col(publisher).alias("_p"), F.col(file_name).alias("_f"), F.col(file_date).alias("_t"), F.explode_outer(json_fields(F.col(payload))).alias("_k", "_v"))
    cells = cells.select("_p", "_f", "_t", "_k", json_type(F.col("_v")).alias("_y")).distinct()
    cells = cells.join(seen, F.col("_k") == F.col("_seen"), "left")
    fields = cells.groupBy("_p", "_f", "_t", F.coalesce("_field", "_k").alias("_c")).agg(F.sort_array(F.collect_set("_k")).alias("n"), F.sort_array(F.collect_set("_y")).alias("y"))
    files = fields.groupBy("_p", "_f", "_t").agg(F.map_from_entries(F.collect_list(F.when(F.col("_c").isNotNull(), F.struct("_c", F.struct("n", "y"))))).alias("_now"))
    w = Window.partitionBy("_p").orderBy("_t", "_f")
    pairs = files.withColumn("_was", F.lag("_now").over(w)).where(F.col("_was").isNotNull())
    each = pairs.select("_p", "_f", "_now", "_was", F.explode(F.array_union(F.map_keys("_now"), F.map_keys("_was"))).alias("_c"))
    each = each.select("_p", "_f", "_c", F.try_element_at("_now", F.col("_c")).alias("a"), F.try_element_at("_was", F.col("_c")).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    typed = (F.size("a.y") > 0) & (F.size("b.y") > 0) & (F.col("a.y") != F.col("b.y"))
    text = lambda c: F.array_join(c, ",")
    change = lambda cond, name, k: F.when(cond, F.struct(F.lit(name).alias("change"), text(F.col(f"b.{k}")).alias("before"), text(F.col(f"a.{k}")).alias("after")))
    found = F.array_compact(F.array(change(F.col("b").isNull(), "added", "n"), change(F.col("a").isNull(), "removed", "n"), change(both & (F.col("a.n") != F.col("b.n")), "renamed", "n"), change(both & typed, "retyped", "y")))
    return each.select(F.col("_p").alias("publisher"), F.col("_f").alias("file_name"), F.col("_c").alias("field"), F.explode(found).alias("_x")).select("publisher", "file_name", "field", "_x.change", "_x.before", "_x.after")
