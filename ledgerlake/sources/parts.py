"""Parts of archives: their groups as nested rows, written in restore order, read back, flattened and checked.

An archive is a folder: ``envelope.json`` names the format, the kind and the parts that were begun, in the order
in which they must be restored, and each part is a folder of JSON lines, one for each group. A part that was begun
and is empty has a folder without lines; one that wasn't begun is not named. The envelope is written last, so a
folder without one is no archive. A document that holds all parts is read into the same groups.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlake.functions.idtypes import is_known
from ledgerlake.sources.archive import FORMAT_VERSION

_REF = "struct<type:string,value:string,domain:string>"
_COVERAGE = "array<struct<from:string,before:string>>"
#: Each part's field in a document, the field of its groups, and a group's form, in order of restoring. 64-bit numbers are text.
SYSTEM_PARTS = {
    "INSTRUMENTS": ("instruments", "instruments", f"struct<asset_class:string,name:string,currency:string,exchange_mic:string,identifiers:array<struct<type:string,value:string,domain:string,canonical:boolean,valid_from:string,valid_before:string>>,underlying:{_REF},cik:string,sic_code:string,valid_from:string,valid_before:string,strike:string,expiry:string,put_call:string,contract_multiplier:string>"),
    "PRICES": ("prices", "groups", f"struct<instrument:{_REF},asset_class:string,currency:string,coverage:{_COVERAGE},rows:array<struct<price_date:string,share_count_basis:string,open:string,high:string,low:string,close:string,adjusted_close:string,volume:string>>>"),
    "CORPORATE_EVENTS": ("corporate_events", "groups", f"struct<instrument:{_REF},asset_class:string,coverage:{_COVERAGE},events:array<struct<split:struct<ex_date:string,split_from:string,split_to:string,first_known_at:string>,dividend:struct<ex_date:string,pay_date:string,record_date:string,declaration_date:string,amount:string,currency:string,frequency:string,type:string,first_known_at:string>>>>"),
    "INFLATION_INDICES": ("inflation_indices", "groups", "struct<currency:string,rows:array<struct<month:string,index_value:string,base_year:int>>>"),
    "FETCH_BLOCKS": ("fetch_blocks", "groups", f"struct<instrument:{_REF},blocks:array<struct<category:string,plugin_id:string,reason:string,first_blocked_at:string>>>"),
    "UNHANDLED_EVENTS": ("unhandled_events", "groups", f"struct<instrument:{_REF},events:array<struct<event_type:string,ex_date:string,detail:string,data_json:string,resolved:boolean,detected_at:string>>>"),
    "PLUGIN_CONFIG": ("plugin_config", "configs", "struct<plugin_id:string,category:string,enabled:boolean,precedence:int,config_json:string,max_history_days:int>"),
}
USER_PARTS = {
    "PREFERENCES": ("preferences", None, "struct<display_currency:string>"),
    "DECLARATIONS": ("declarations", "statements", f"struct<broker:string,account:string,as_of_date:string,declarations:array<struct<instrument:{_REF},declared_qty:string,share_count_basis:string>>>"),
}
PARTS = {"SYSTEM": SYSTEM_PARTS, "USER": USER_PARTS}
#: What of a group is one row of its part: the array's name, or nothing where the group is the row.
ROWS = {"PRICES": "rows", "CORPORATE_EVENTS": "events", "INFLATION_INDICES": "rows", "FETCH_BLOCKS": "blocks", "UNHANDLED_EVENTS": "events", "DECLARATIONS": "declarations"}


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _form(spark: SparkSession, kind: str, part: str) -> StructType:
    return spark.createDataFrame([], f"g {PARTS[kind][part][2]}").schema["g"].dataType


def write_archive(spark: SparkSession, path: str, kind: str, exported_at: str, parts: dict[str, DataFrame]) -> None:
    """Writes ``parts`` (groups: columns of the part's form) below ``path``, which must be new; a part that the kind doesn't have is refused."""
    order = PARTS[kind]
    if other := parts.keys() - order.keys():
        raise ValueError(f"{kind} archives have no part {', '.join(sorted(other))}")
    files, envelope = _file(spark, f"{path}/envelope.json")
    if files.exists(envelope):
        raise ValueError(f"{path} holds an archive")
    begun = [p for p in order if p in parts]
    for number, part in enumerate(begun):
        parts[part].select(*_form(spark, kind, part).names).write.option("compression", "gzip").json(f"{path}/{number:02d}-{part}")
    out = files.create(envelope, False)
    out.write(bytearray(json.dumps({"format_version": FORMAT_VERSION, "exported_at": exported_at, "kind": kind, "parts": begun}).encode()))
    out.close()


def read_archive(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    """The groups (column g) of each part that was begun, in order of restoring; raises for another kind or a newer version."""
    files, envelope = _file(spark, f"{path}/envelope.json")
    stream = files.open(envelope)
    head = json.loads(bytes(stream.readAllBytes()))
    stream.close()
    if head["kind"] != kind or not 1 <= head["format_version"] <= FORMAT_VERSION:
        raise ValueError(f"{path}: kind {head['kind']}, version {head['format_version']}")
    out = {}
    for number, part in enumerate(head["parts"]):
        rows = spark.read.schema(_form(spark, kind, part)).json(f"{path}/{number:02d}-{part}")
        out[part] = rows.select(F.struct(*rows.columns).alias("g"))
    return out


def document_parts(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    """The groups (file, index, g) of each part of the JSON documents below ``path``; a part that a document lacks gives it no groups, and one that it begins empty none either."""
    fields = [f"{name} {form if items is None else f'struct<{items}:array<{form}>>'}" for name, items, form in PARTS[kind].values()]
    rows = spark.read.schema("envelope struct<format_version:int,kind:string>, " + ", ".join(fields)).json(path, multiLine=True).withColumn("file", F.input_file_name())
    right = (F.coalesce("envelope.format_version", F.lit(0)).between(1, FORMAT_VERSION)) & F.col("envelope.kind").eqNullSafe(kind)
    rows = rows.where(F.assert_true(right, F.concat(F.lit(f"no {kind} document of a known version: "), F.col("file"))).isNull())
    out = {}
    for part, (name, items, _) in PARTS[kind].items():
        if items is None:
            out[part] = rows.where(F.col(name).isNotNull()).select("file", F.lit(0).alias("index"), F.col(name).alias("g"))
        else:
            out[part] = rows.select("file", F.posexplode(f"{name}.{items}").alias("index", "g"))
    return out


def part_rows(part: str, groups: DataFrame) -> DataFrame:
    """Rows of ``groups`` (g, and what else names them) one level down: their other columns, g, and r where a group holds several."""
    if part not in ROWS:
        return groups
    return groups.select("*", F.explode(f"g.{ROWS[part]}").alias("r"))


def _day(x: Column) -> Column:
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x))


def _number(x: Column, signed: bool = True) -> Column:
    return F.when(x.rlike(rf"^{'-?' if signed else ''}\d+(\.\d+)?$"), x.try_cast("decimal(38,12)"))


def _named(ref: str) -> tuple[str, Column, str]:
    return "instrument", ~is_known(F.col(f"{ref}.type")) | (F.coalesce(f"{ref}.value", F.lit("")) == ""), "no known identifier"


def _optional(name: str, read) -> tuple[str, Column, str]:
    return name, F.col(f"r.{name}").isNotNull() & read(F.col(f"r.{name}")).isNull(), "can't be read"


def _checks(part: str) -> list[tuple[str, Column, str]]:
    """(field, whether it is bad, what is said) for a part's rows."""
    r = lambda name: F.col(f"r.{name}")
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    if part == "PRICES":
        return [_named("g.instrument"), ("price_date", _day(r("price_date")).isNull(), "can't be read"), ("close", _number(r("close")).isNull(), "can't be read"), *(_optional(n, _number) for n in ("open", "high", "low", "adjusted_close")), _optional("share_count_basis", _day), _optional("volume", lambda x: x.try_cast("long"))]
    if part == "CORPORATE_EVENTS":
        split, paid = r("split").isNotNull(), r("dividend").isNotNull()
        ratio = (_number(r("split.split_from"), False) > 0) & (_number(r("split.split_to"), False) > 0)
        return [_named("g.instrument"), ("event", ~(split | paid), "neither split nor dividend"), ("ex_date", (split | paid) & _day(F.coalesce(r("split.ex_date"), r("dividend.ex_date"))).isNull(), "can't be read"), ("split", split & ~F.coalesce(ratio, F.lit(False)), "no ratio"), ("amount", paid & _number(r("dividend.amount"), False).isNull(), "can't be read")]
    if part == "INFLATION_INDICES":
        return [("currency", blank(F.col("g.currency")), "missing"), ("month", _day(r("month")).isNull() | ~r("month").endswith("-01"), "no first of a month"), ("index_value", ~F.coalesce(_number(r("index_value"), False) > 0, F.lit(False)), "not positive"), ("base_year", F.coalesce(r("base_year"), F.lit(0)) < 1900, "no year")]
    if part == "FETCH_BLOCKS":
        return [_named("g.instrument"), ("category", ~F.coalesce(r("category").isin("PRICE", "CORPORATE_EVENT"), F.lit(False)), "has no blocks"), ("plugin_id", blank(r("plugin_id")), "missing"), ("reason", blank(r("reason")), "missing")]
    if part == "UNHANDLED_EVENTS":
        return [_named("g.instrument"), ("event_type", blank(r("event_type")), "missing"), ("ex_date", ~blank(r("ex_date")) & _day(r("ex_date")).isNull(), "can't be read")]
    if part == "PLUGIN_CONFIG":
        return [("plugin_id", blank(F.col("g.plugin_id")), "missing"), ("category", blank(F.col("g.category")), "missing"), ("precedence", F.coalesce("g.precedence", F.lit(0)) < 1, "below one")]
    if part == "INSTRUMENTS":
        return [("identifiers", F.coalesce(F.size("g.identifiers"), F.lit(0)) < 1, "none"), ("identifiers", F.exists("g.identifiers", lambda i: ~is_known(i["type"]) | (F.coalesce(i["value"], F.lit("")) == "")), "unknown type or no value"), ("put_call", F.col("g.put_call").isNotNull() & ~F.col("g.put_call").isin("C", "P"), "neither C nor P")]
    if part == "DECLARATIONS":
        return [_named("r.instrument"), ("as_of_date", _day(F.col("g.as_of_date")).isNull(), "can't be read"), ("declared_qty", _number(r("declared_qty")).isNull(), "can't be read"), _optional("share_count_basis", _day)]
    return []


class Status(NamedTuple):
    part: str
    rows: int
    accepted: int
    errors: int


def checked(part: str, groups: DataFrame) -> DataFrame:
    """Rows of ``part_rows`` with faults: array of (field, fault), empty where the row may be taken."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(said).alias("fault"))) for field, bad, said in _checks(part)]
    none = F.array().cast("array<struct<field:string,fault:string>>")
    return part_rows(part, groups).withColumn("faults", F.array_compact(F.array(*found)) if found else none)


def import_part(part: str, groups: DataFrame, path: str, whole: bool = False) -> Status:
    """Checks a part and writes its rows below ``path`` in one pass, good ones and bad ones apart; the totals come from that pass.

    Rows are independent of one another, so good ones are taken whatever the others are. With ``whole`` the part
    is taken all or not at all: any fault leaves none accepted.
    """
    seen = Observation()
    bad = F.size("faults") > 0
    rows = checked(part, groups).withColumn("good", (~bad).cast("int")).observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(F.size("faults")), F.lit(0)).alias("errors"), F.count_if(~bad).alias("good"))
    rows.write.partitionBy("good").parquet(path)
    told = seen.get
    return Status(part, told["rows"], 0 if whole and told["errors"] else told["good"], told["errors"])


def imported(spark: SparkSession, part: str, path: str, status: Status) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, error rows with field and fault) of what ``import_part`` wrote."""
    rows = spark.read.parquet(path) if status.rows else None
    if rows is None:
        empty = spark.createDataFrame([], f"g {(SYSTEM_PARTS | USER_PARTS)[part][2]}")
        return empty, empty.select("*", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("fault"))
    keep = rows.where("good = 1") if status.accepted else rows.where("false")
    return keep.drop("faults", "good"), rows.where("good = 0").select(*(c for c in rows.columns if c not in ("faults", "good")), F.inline("faults"))


# ---------------------------------------------------------------- tables as groups, and back


def price_groups(bars: DataFrame, names: DataFrame, instruments: DataFrame) -> DataFrame:
    """Groups of bars (instrument_id, price_date, close, share_count_basis), one for each instrument and year, so that none grows with its history."""
    text = lambda c: F.col(c).cast("string").alias(c)
    entry = F.struct(text("price_date"), text("share_count_basis"), *(F.lit(None).cast("string").alias(c) for c in ("open", "high", "low")), text("close"), *(F.lit(None).cast("string").alias(c) for c in ("adjusted_close", "volume")))
    rows = bars.groupBy("instrument_id", F.year("price_date").alias("year")).agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    known = rows.join(_refs(names), "instrument_id").join(instruments.select("instrument_id", "asset_class", "currency"), "instrument_id")
    return known.select("instrument", "asset_class", "currency", F.array().cast(_COVERAGE).alias("coverage"), "rows")


def split_groups(splits: DataFrame, names: DataFrame, instruments: DataFrame) -> DataFrame:
    """Groups of splits (instrument_id, ex_date, split_from, split_to), one for each instrument."""
    text = lambda c: F.col(c).cast("string").alias(c)
    form = SYSTEM_PARTS["CORPORATE_EVENTS"][2].partition("events:")[2][:-1]
    nothing = "struct<ex_date:string,pay_date:string,record_date:string,declaration_date:string,amount:string,currency:string,frequency:string,type:string,first_known_at:string>"
    split = F.struct(text("ex_date"), text("split_from"), text("split_to"), F.lit(None).cast("string").alias("first_known_at"))
    events = F.array_sort(F.collect_list(F.struct(split.alias("split"), F.lit(None).cast(nothing).alias("dividend")))).cast(form)
    known = splits.groupBy("instrument_id").agg(events.alias("events")).join(_refs(names), "instrument_id").join(instruments.select("instrument_id", "asset_class"), "instrument_id")
    return known.select("instrument", "asset_class", F.array().cast(_COVERAGE).alias("coverage"), "events")


def inflation_groups(inflation: DataFrame, base_year: int) -> DataFrame:
    """Groups of inflation (currency, month, index_value), one for each currency."""
    entry = F.struct(F.col("month").cast("string").alias("month"), F.col("index_value").cast("string").alias("index_value"), F.lit(base_year).alias("base_year"))
    return inflation.groupBy("currency").agg(F.array_sort(F.collect_list(entry)).alias("rows"))


def _refs(names: DataFrame) -> DataFrame:
    return names.select("instrument_id", F.struct(F.col("identifier_type").alias("type"), "value", F.coalesce("domain", F.lit("")).alias("domain")).alias("instrument"))


def prices(rows: DataFrame) -> DataFrame:
    """Accepted rows of PRICES as (identifier_type, domain, value, asset_class, currency, price_date, close, share_count_basis)."""
    return rows.select(F.col("g.instrument.type").alias("identifier_type"), F.col("g.instrument.domain").alias("domain"), F.col("g.instrument.value").alias("value"), "g.asset_class", "g.currency", _day(F.col("r.price_date")).alias("price_date"), _number(F.col("r.close")).cast("decimal(18,6)").alias("close"), _day(F.col("r.share_count_basis")).alias("share_count_basis"))


def split_rows(rows: DataFrame) -> DataFrame:
    """Accepted splits of CORPORATE_EVENTS as (identifier_type, domain, value, ex_date, split_from, split_to)."""
    number = lambda c: _number(F.col(f"r.split.{c}"), False).cast("decimal(18,6)").alias(c)
    return rows.where("r.split is not null").select(F.col("g.instrument.type").alias("identifier_type"), F.col("g.instrument.domain").alias("domain"), F.col("g.instrument.value").alias("value"), _day(F.col("r.split.ex_date")).alias("ex_date"), number("split_from"), number("split_to"))


def dividend_rows(rows: DataFrame) -> DataFrame:
    """Accepted dividends of CORPORATE_EVENTS as (identifier_type, domain, value, ex_date, pay_date, amount, currency, type); one without a type is a regular cash dividend."""
    d = lambda c: F.col(f"r.dividend.{c}")
    return rows.where("r.dividend is not null").select(F.col("g.instrument.type").alias("identifier_type"), F.col("g.instrument.domain").alias("domain"), F.col("g.instrument.value").alias("value"), _day(d("ex_date")).alias("ex_date"), _day(d("pay_date")).alias("pay_date"), _number(d("amount"), False).cast("decimal(18,6)").alias("amount"), d("currency").alias("currency"), F.when(F.coalesce(d("type"), F.lit("")) == "SC", "SC").otherwise("CD").alias("type"))
