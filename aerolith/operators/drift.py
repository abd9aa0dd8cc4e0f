"""Files whose schema drifts: rescue-column ingestion and a ledger of every change.

Records are JSON objects. The target schema is enforced: a field goes to the typed column its content belongs to,
whatever name the file gave it; unknown fields and values that can't be cast are kept as JSON in a rescue column, and
`replay` moves approved ones into typed columns later. Ingestion also says what every record held, under the names of
its file: name, JSON type and value. The ledger is one row per file and field name out of that, with a sketch of the
values, so a hot lane or file is aggregated before anything is ordered.

A field that goes while another comes is the same content under another name if the names agree without case and
punctuation; if the words of one name are among those of the other (or among the approved names of its column) and the
values look alike: a common pattern of digits and letters, and ranges that overlap; or if the values themselves agree
(all minima of their hashes, and at least three different ones). Approved names (`ALIASES`) are the same content
without further evidence. Each field is renamed to one other at most, the best evidence first.

Defined results: a payload that isn't one JSON object is no readable record; it is kept whole in the rescue column. A
null is no value and has no type; a field of nothing but nulls belongs to its file, without a type, and isn't retyped.
If one file has several names for one content, the most frequent one counts (ties: the first in order). If values of
one field have several JSON types, the most frequent one counts. Empty input, empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.instants import utc_date
from ..session import materialise

#: Column -> names under which feeds carry its content, compared without case and punctuation.
ALIASES = {
    "icao24": ["icao24", "icao", "hex"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "lng", "long"],
    "flight": ["flight", "flightId", "callsign"],
    "reg": ["reg", "registration"],
    "timestamp": ["timestamp", "ts", "seen_at"],
    "alt_baro": ["alt_baro", "altBaro", "alt"],
    "gs": ["gs", "ground_speed"],
    "track": ["track", "heading"],
    "src": ["src", "feed"],
}

TARGET = {"icao24": "string", "latitude": "double", "longitude": "double", "flight": "string", "reg": "string", "timestamp": "timestamp"}


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def words(name: Column) -> Column:
    """The words of a name, in lower case: parts between punctuation and where lower case turns to upper."""
    apart = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda w: w != "")


def canonical(name: Column, aliases: dict[str, list[str]] = ALIASES) -> Column:
    """The column whose content a field of this name carries; else the name itself."""
    return F.coalesce(approved_column(name, aliases), name)


def approved_column(name: Column, aliases: dict[str, list[str]] = ALIASES) -> Column:
    """The column for which a name is approved; else null."""
    pairs = {a: c for c, names in aliases.items() for n in names for a in ["".join(x for x in n.lower() if x.isalnum())]}
    known = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(known, _plain(name))


def opened(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with _fields: the record as map<string, variant>, null if it isn't readable."""
    return df.withColumn("_fields", F.expr(f"try_cast(try_parse_json(`{payload}`) AS map<string, variant>)"))


def json_type(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", None)
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number").otherwise("other")
    )


#: Numbers of hash functions of a value sketch.
MINIMA = 4


def ledger(ingested: DataFrame, file: str, lane: str, seq: str, aliases: dict = ALIASES) -> DataFrame:
    """(lane, file, idx, next_file, has_next, field, column, name, type, sketch) from `ingest`: the fields of every
    readable file, with its place among the readable files of the lane and the file after it. field: the approved
    column, else the name without case and punctuation. A readable file without any field has one row, field null."""
    rec = ingested.where(F.col("_seen").isNotNull()).select(
        F.col(lane).alias("lane"), F.col(seq).alias("seq"), F.col(file).alias("file"), F.explode_outer("_seen").alias("e")
    ).select("lane", "seq", "file", F.col("e.key").alias("name"), F.col("e.value").alias("value"))
    text = F.when(~F.is_variant_null("value"), F.to_json("value"))
    rec = rec.select("lane", "seq", "file", "name", json_type(F.col("value")).alias("type"), text.alias("text"))
    number = F.expr("try_cast(text AS double)")
    shape = F.regexp_replace(F.regexp_replace("text", "[0-9]", "9"), r"\p{L}", "a")
    h = F.xxhash64("text")
    bit = lambda x: F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(x, F.lit(63)).cast("int")))
    sketch = [
        F.min(number).alias("lo"), F.max(number).alias("hi"), bit(F.xxhash64(shape)).alias("shapes"), bit(h).alias("values"),
        *[F.min(F.xxhash64(h, F.lit(i))).alias(f"m{i}") for i in range(MINIMA)],
    ]
    names = rec.groupBy("lane", "seq", "file", "name", "type").agg(F.count(F.lit(1)).alias("n"), *sketch)
    merged = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("shapes").alias("shapes"), F.bit_or("values").alias("values"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(MINIMA)]]
    names = names.groupBy("lane", "seq", "file", "name").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("type").isNotNull(), F.struct("n", "type"))).alias("t"), F.struct(*merged).alias("sketch")
    )
    column = approved_column(F.col("name"), aliases)
    plain = F.coalesce(F.nullif(_plain(F.col("name")), F.lit("")), F.col("name"))
    fields = names.withColumn("field", F.coalesce(column, F.concat(F.lit("?"), plain))).groupBy("lane", "seq", "file", "field").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "name", F.col("t.type").alias("type"), "sketch")).alias("b")
    )
    files = fields.select("lane", "seq", "file").distinct()
    w = W.partitionBy("lane").orderBy("seq", "file")
    files = files.select(
        "lane", "seq", "file", (F.row_number().over(w) - 1).alias("idx"), F.lead("file").over(w).alias("next_file"),
        F.lead(F.lit(True)).over(w).alias("has_next"),
    )
    files = files.withColumnsRenamed({"lane": "_lane", "seq": "_seq", "file": "_file"})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("lane", "seq", "file")]
    return fields.join(files, same).select(
        "lane", "file", "idx", "next_file", F.coalesce("has_next", F.lit(False)).alias("has_next"), "field",
        F.when(~F.col("field").startswith("?"), F.col("field")).alias("column"), "b.name", "b.type", "b.sketch",
    )


def _alike(aliases: dict) -> Column:
    """How strong the evidence is that the fields `r` (gone) and `a` (come) are one content: 2, 1, or 0."""
    known = F.create_map(*[x for c, names in aliases.items() for x in (F.lit(c), F.array(*[F.lit("".join(ch for ch in n.lower() if ch.isalnum())) for n in names]))])
    own = lambda s: F.coalesce(F.try_element_at(known, F.col(f"{s}.column")), words(F.col(f"{s}.name")))
    r, a = own("r"), own("a")
    listed = F.col("r.column").isNotNull() | F.col("a.column").isNotNull()
    common = F.size(F.array_intersect(r, a)) > 0
    held = (F.size(F.array_except(r, a)) == 0) | (F.size(F.array_except(a, r)) == 0)
    named = F.when(listed, common).otherwise(common & held)
    x, y = "r.sketch", "a.sketch"
    shape = F.col(f"{x}.shapes").bitwiseAND(F.col(f"{y}.shapes")) != 0
    overlap = F.coalesce((F.col(f"{x}.lo") <= F.col(f"{y}.hi")) & (F.col(f"{y}.lo") <= F.col(f"{x}.hi")), F.col(f"{x}.lo").isNull() == F.col(f"{y}.lo").isNull())
    agree = F.bit_count(f"{x}.values") >= 3  # set bits: different values, at least
    for i in range(MINIMA):
        agree = agree & (F.col(f"{x}.m{i}") == F.col(f"{y}.m{i}"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    # two approved columns are two contents, whatever their values
    both = F.col("r.column").isNotNull() & F.col("a.column").isNotNull()
    return F.when(both, 0).when(yes(agree), 2).when(yes(named & shape & overlap), 1).otherwise(0)


def changes(led: DataFrame, aliases: dict = ALIASES) -> DataFrame:
    """(file, field, change): each file against the readable file before it in its lane. field: the approved column,
    else the name (of a removed field its last one)."""
    w = W.partitionBy("lane", "field").orderBy("idx")
    x = led.where(F.col("field").isNotNull()).select(
        "*", F.lag(F.struct("idx", "name", "type")).over(w).alias("p"), F.lead("idx").over(w).alias("n")
    )
    went_on = F.coalesce(F.col("p.idx") == F.col("idx") - 1, F.lit(False))
    what = F.struct("column", "name", "type", "sketch")
    here = lambda c: F.struct(F.col("file"), F.col("idx").alias("at"), F.lit(c).alias("change"), what.alias("f"))
    ends = F.col("has_next") & (F.coalesce(F.col("n"), F.lit(-1)) != F.col("idx") + 1)
    found = F.array(
        F.when((F.col("idx") > 0) & ~went_on, here("added")),
        F.when(went_on & (F.col("name") != F.col("p.name")), here("renamed")),
        F.when(went_on & (F.col("type") != F.col("p.type")), here("retyped")),
        F.when(ends, F.struct(F.col("next_file").alias("file"), (F.col("idx") + 1).alias("at"), F.lit("removed").alias("change"), what.alias("f"))),
    )
    x = materialise(x.select("lane", F.explode(F.filter(found, lambda c: c.isNotNull())).alias("c")).select("lane", "c.*"))
    label = F.coalesce("f.column", "f.name")
    # what goes and what comes in one file, by their evidence; changes are few beside the records
    side = lambda c, n: x.where(F.col("change") == c).select(F.col("lane").alias(f"{n}_lane"), F.col("at").alias(f"{n}_at"), F.col("file").alias(f"{n}_file"), F.col("f").alias(n))
    both = side("removed", "r").join(side("added", "a"), F.col("r_lane").eqNullSafe(F.col("a_lane")) & (F.col("r_at") == F.col("a_at")))
    both = both.withColumn("like", _alike(aliases)).where("like > 0")
    # one to one: a pair stays if neither side has a better one
    best = lambda s, o: F.row_number().over(W.partitionBy("a_lane", "a_at", f"{s}.name").orderBy(F.desc("like"), f"{o}.name"))
    both = both.withColumn("_i", best("r", "a")).withColumn("_j", best("a", "r")).where("_i = 1 AND _j = 1")
    pairs = both.select(F.col("a_lane").alias("lane"), F.col("a_at").alias("at"), F.col("a_file").alias("file"), "r", "a")
    gone = F.explode(F.array(F.struct(F.lit("removed").alias("change"), F.col("r.name").alias("name")), F.struct(F.lit("added").alias("change"), F.col("a.name").alias("name"))))
    out = pairs.select(F.col("lane").alias("_lane"), F.col("at").alias("_at"), gone.alias("_g"))
    rest = x.join(out, F.col("lane").eqNullSafe(F.col("_lane")) & (F.col("at") == F.col("_at")) & (F.col("change") == F.col("_g.change")) & (F.col("f.name") == F.col("_g.name")), "left_anti")
    field = F.coalesce("a.column", "r.column", "a.name")
    turned = F.array_compact(F.array(F.lit("renamed"), F.when(F.col("a.type") != F.col("r.type"), "retyped")))
    return rest.select("file", label.alias("field"), "change").unionByName(pairs.select("file", field.alias("field"), F.explode(turned).alias("change")))


def _value_for(column: str):
    return lambda e: (e["field"] == column) & ~F.is_variant_null(e["value"])


def _named(column: str, aliases: dict, is_it: bool):
    return lambda k, v: (canonical(k, aliases) == column) == F.lit(is_it)


def _instant(v: Column) -> Column:
    """Epoch seconds or milliseconds, as number or text, or a date and time as ISO-8601 text with or without fraction
    and offset; without offset it is UTC, whatever the session's zone."""
    num = F.expr("try_cast(_v AS double)")
    sec = F.when(F.abs(num) >= 1e11, num / 1000).otherwise(num)
    text = F.trim(F.expr("try_cast(_v AS string)"))
    text = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(text.rlike(r"(?i)(z|[+-]\d{1,2}:\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    text = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[Tt ]\d"), F.upper(zoned).try_cast("timestamp"))
    del v
    return F.coalesce(F.timestamp_micros(F.round(sec * 1000000).cast("bigint")), text)


def ingest(
    df: DataFrame, keep: list[str], payload: str = "payload", target: dict[str, str] = TARGET, aliases: dict = ALIASES
) -> DataFrame:
    """keep + the typed target columns + date + _rescued (JSON object text of unknown and uncastable fields, whose
    values are JSON texts; for an unreadable payload its text under the key _payload; null if nothing is left over) +
    _seen (names and values as the record held them; null if unreadable)."""
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]  # no name of theirs can clash
    rec = opened(df.select(*kept, F.col(payload).alias("_payload")), "_payload")
    entries = F.transform(
        F.map_entries("_fields"),
        lambda e: F.struct(canonical(e["key"], aliases).alias("field"), e["key"].alias("name"), e["value"].alias("value")),
    )
    rec = rec.withColumn("_e", entries)
    out, failed = [], []
    for c, kind in target.items():
        # the first non-null value under any of the names
        v = F.try_element_at(F.filter("_e", _value_for(c)), F.lit(1))["value"]
        rec = rec.withColumn("_v", v)
        cast = _instant(F.col("_v")) if kind == "timestamp" else F.expr(f"try_cast(_v AS {kind})")
        rec = rec.withColumn(f"_t_{c}", cast)
        out.append(F.col(f"_t_{c}").alias(c))
        failed.append(F.when(F.col("_v").isNotNull() & cast.isNull(), F.lit(c)))
        rec = rec.withColumn(f"_f_{c}", failed[-1])
    lost = F.array_compact(F.array(*[F.col(f"_f_{c}") for c in target]))
    left = F.filter("_e", lambda e: ~e["field"].isin(list(target)) | F.array_contains(lost, e["field"]))
    texts = F.map_from_entries(F.transform(left, lambda e: F.struct(e["name"], F.to_json(e["value"]))))
    whole = F.to_json(F.create_map(F.lit("_payload"), F.col("_payload")))
    rescued = F.when(F.col("_fields").isNull() & F.col("_payload").isNotNull(), whole).when(F.size(left) > 0, F.to_json(texts))
    day = [utc_date(F.unix_seconds("_t_timestamp")).alias("date")] if "timestamp" in target else []
    return rec.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *out, *day, rescued.alias("_rescued"), F.map_entries("_fields").alias("_seen"))


def replay(df: DataFrame, approved: dict[str, str], aliases: dict = ALIASES) -> DataFrame:
    """Approved fields (name -> type) out of the rescue column into typed columns; what was moved leaves it."""
    got = F.from_json("_rescued", "map<string,string>")
    df = df.withColumn("_m", got)
    for c, kind in approved.items():
        named = F.try_element_at(F.map_values(F.map_filter("_m", _named(c, aliases, True))), F.lit(1))
        df = df.withColumn("_x", named).withColumn(c, F.expr(f"try_cast(try_parse_json(_x) AS {kind})"))
        moved = F.col(c).isNotNull()
        df = df.withColumn("_m", F.when(moved, F.map_filter("_m", _named(c, aliases, False))).otherwise(F.col("_m")))
    rest = F.when(F.size("_m") > 0, F.to_json("_m"))
    return df.withColumn("_rescued", rest).drop("_m", "_x")
