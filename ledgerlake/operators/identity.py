"""Which instrument an identifier names, how an instrument is shown, and merging of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.symbols import bare_ticker
from ledgerlake.operators.rounds import components

#: Orders of preference for export, display and price lookup.
EXPORT_ORDER = "MIC_TICKER OPENFIGI_TICKER OCC ISIN OPENFIGI_SHARE_CLASS OPENFIGI_COMPOSITE CUSIP SEDOL OPRA BROKER_DESCRIPTION".split()
DISPLAY_ORDER = "MIC_TICKER OPENFIGI_TICKER OCC BROKER_DESCRIPTION CURRENCY FX_PAIR".split()
PRICE_ORDER = "MIC_TICKER OPENFIGI_TICKER FX_PAIR ISIN".split()


def rank_of(kind: Column, order: list[str], other: int = 99) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(i + 1)) for i, k in enumerate(order)), F.lit(other))


def best_identifier(identifiers: DataFrame, order: list[str] | None = None, only_known: bool = False) -> DataFrame:
    """Each instrument's preferred identifier in force: (instrument_id, identifier_type, domain, value)."""
    rank = rank_of(F.col("identifier_type"), order or EXPORT_ORDER)
    rows = identifiers.where("valid_before is null").withColumn("_rank", rank)
    rows = rows.where("_rank < 99") if only_known else rows
    pick = F.min(F.struct("_rank", F.coalesce("domain", F.lit("")).alias("d"), "value", "identifier_type", "domain"))
    return rows.groupBy("instrument_id").agg(pick.alias("b")).select("instrument_id", "b.identifier_type", "b.domain", "b.value")


def display_names(instruments: DataFrame, identifiers: DataFrame, exchanges: DataFrame | None = None) -> DataFrame:
    """Rows (instrument_id, display_name, exchange): the preferred name in force, else the own name, else the id."""
    best = best_identifier(identifiers, DISPLAY_ORDER, only_known=True).select("instrument_id", "value")
    figi = identifiers.where("identifier_type = 'OPENFIGI_TICKER' and valid_before is null and domain <> ''").groupBy("instrument_id").agg(F.min("domain").alias("figi"))
    rows = instruments.join(best, "instrument_id", "left").join(figi, "instrument_id", "left")
    rows = rows.join(F.broadcast(exchanges.select(F.col("mic").alias("exchange_mic"), "acronym")), "exchange_mic", "left") if exchanges is not None else rows.withColumn("acronym", F.lit(None).cast("string"))
    name = F.coalesce("value", F.nullif("name", F.lit("")), F.col("instrument_id").cast("string"))
    return rows.select("instrument_id", name.alias("display_name"), F.coalesce("acronym", "figi", F.lit("")).alias("exchange"))


def find_by_identifier(identifiers: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (identifier_type, domain, value) with the instrument each names: one in force, else the last that was."""
    closed = F.when(F.col("valid_before").isNull(), F.lit("9999-12-31").cast("date")).otherwise(F.col("valid_before"))
    best = identifiers.groupBy("identifier_type", F.coalesce("domain", F.lit("")).alias("domain"), "value").agg(F.max_by("instrument_id", F.struct(closed, -F.col("instrument_id"))).alias("instrument_id"))
    return asked.withColumn("domain", F.coalesce("domain", F.lit(""))).join(best, ["identifier_type", "domain", "value"], "left")


def find_unambiguous(identifiers: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (identifier_type, value) with the one instrument that bears such a value in any domain; tickers match without separators."""
    plain = F.when(F.col("identifier_type").isin("MIC_TICKER", "OPENFIGI_TICKER"), bare_ticker(F.col("value"))).otherwise(F.col("value"))
    known = identifiers.groupBy("identifier_type", plain.alias("_plain")).agg(F.min("instrument_id").alias("instrument_id"), F.max("instrument_id").alias("_last")).where("instrument_id = _last").drop("_last")
    return asked.withColumn("_plain", plain).join(known, ["identifier_type", "_plain"], "left").drop("_plain")


def described_only(instruments: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Instruments without a canonical identifier."""
    return instruments.join(identifiers.where("canonical").select("instrument_id").distinct(), "instrument_id", "left_anti")


def survivors(identifiers: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Rows (instrument_id, survivor_id) for ``duplicates`` (cluster, instrument_id, and created_at if known).

    The one with most identifiers survives, of equals the oldest, then the smallest id.
    """
    counts = identifiers.groupBy("instrument_id").agg(F.count("*").alias("n"))
    age = ["created_at"] if "created_at" in duplicates.columns else []
    by = Window.partitionBy("cluster").orderBy(F.desc(F.coalesce("n", F.lit(0))), *(F.col(c).asc_nulls_last() for c in age), "instrument_id")
    rows = duplicates.join(counts, "instrument_id", "left")
    return rows.withColumn("survivor_id", F.first("instrument_id").over(by)).select("instrument_id", "survivor_id")


def repointed(rows: DataFrame, mapping: DataFrame, column: str = "instrument_id") -> DataFrame:
    """``rows`` with the instruments that ``column`` names replaced by their survivors in ``mapping`` (instrument_id, survivor_id)."""
    into = mapping.where("instrument_id <> survivor_id").select(F.col("instrument_id").alias("_gone"), F.col("survivor_id").alias("_into"))
    joined = rows.join(into, rows[column] == into["_gone"], "left")
    return joined.withColumn(column, F.coalesce("_into", column)).select(*rows.columns)


def merged_names(identifiers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Identifiers after the merge: a survivor keeps its own rows, and takes those of a merged instrument that hold at no time at which it bears that name already.

    Validity moves with the name, so a name that was given up stays history and one in force stays in force.
    Merged instruments give theirs in order of id; an unset domain is an empty one. Nobody bears one name twice
    over overlapping times: of such rows, equal ones too, the first stays.
    """
    into = mapping.select("instrument_id", F.col("survivor_id"))
    rows = identifiers.join(into, "instrument_id", "left").withColumn("_owner", F.coalesce("survivor_id", "instrument_id")).drop("survivor_id")
    start, end = F.coalesce("valid_from", F.lit("0001-01-01").cast("date")), F.coalesce("valid_before", F.lit("9999-12-31").cast("date"))
    rest = [c for c in identifiers.columns if c not in ("instrument_id", "identifier_type", "domain", "value")]
    entry = F.struct((F.col("instrument_id") != F.col("_owner")).alias("foreign"), F.col("instrument_id").alias("giver"), start.alias("start"), end.alias("end"), "domain", *rest)
    held = rows.groupBy("_owner", "identifier_type", F.coalesce("domain", F.lit("")).alias("_domain"), "value").agg(F.array_sort(F.collect_list(entry)).alias("held"))  # the times of one name of one instrument
    apart = lambda kept, x: ~F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
    kept = F.aggregate("held", F.slice("held", 1, 0), lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    flat = held.select(F.col("_owner").alias("instrument_id"), "identifier_type", "value", F.explode(kept).alias("k"))
    return flat.select("instrument_id", "identifier_type", "value", "k.domain", *(f"k.{c}" for c in rest)).select(*identifiers.columns)


def merge_instruments(postings: DataFrame, identifiers: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and identifiers after instruments of ``mapping`` (instrument_id, survivor_id) became their survivors.

    A posting that weighs in its own instrument (commodity ``inst:ID``, where it has one) names the survivor there too.
    """
    moved = repointed(postings.withColumn("_was", F.col("instrument_id")), mapping)
    if "commodity" in postings.columns:
        own = F.col("commodity") == F.concat(F.lit("inst:"), F.col("_was").cast("string"))
        moved = moved.withColumn("commodity", F.when(own, F.concat(F.lit("inst:"), F.col("instrument_id").cast("string"))).otherwise(F.col("commodity")))
    return moved.select(*postings.columns), merged_names(identifiers, mapping)


def merged_instruments(instruments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Instruments without those that were merged away; underlyings are the survivors."""
    gone = mapping.where("instrument_id <> survivor_id").select("instrument_id")
    return repointed(instruments.join(gone, "instrument_id", "left_anti").select(*instruments.columns), mapping, "underlying_id")


def merged_matches(matches: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transfer matches with their survivors' instruments, those among them that now share a group and instrument with another).

    The second must be empty for the merge to be written: dropping one of two links would leave a side open
    with nothing to say why.
    """
    moved = repointed(matches, mapping)
    shared = lambda side: moved.groupBy(side, "instrument_id").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    parts = [moved.join(shared(side), [side, "instrument_id"], "left_semi").select(*matches.columns) for side in ("from_group_id", "to_group_id")]
    return moved, parts[0].unionByName(parts[1]).distinct()


def shared_identifier_pairs(identifiers: DataFrame, kinds: list[str]) -> DataFrame:
    """Links (a, b) between instruments that share an identifier of ``kinds``: each to the smallest that bears it, so a value borne by many makes a star."""
    rows = identifiers.where(F.col("identifier_type").isin(kinds)).select("identifier_type", F.coalesce("domain", F.lit("")).alias("domain"), "value", "instrument_id").distinct()
    first = rows.groupBy("identifier_type", "domain", "value").agg(F.min("instrument_id").alias("a"))
    return rows.join(first, ["identifier_type", "domain", "value"]).where("instrument_id <> a").select("a", F.col("instrument_id").alias("b")).distinct()


def export_closure(instruments: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen instruments and their underlyings."""
    ids = chosen.select("instrument_id").distinct()
    below = instruments.join(ids, "instrument_id", "left_semi").where("underlying_id is not null").select(F.col("underlying_id").alias("instrument_id"))
    return instruments.join(ids.union(below).distinct(), "instrument_id", "left_semi")


def arbitrate(results: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each key from plugins' answers (key, plugin_id, precedence, matches_hint, and ``fields``).

    An answer that matches the stated hint wins over precedence; the winner's blanks are filled from the
    others in that order, as long as they agree with it on asset_class.
    """
    by = Window.partitionBy("key").orderBy(F.desc(F.coalesce("matches_hint", F.lit(False))), F.asc("precedence"), "plugin_id")
    ranked = results.withColumn("_rank", F.row_number().over(by)).withColumn("_class", F.first("asset_class", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    agreeing = ranked.where("asset_class is null or asset_class = _class")
    return agreeing.groupBy("key").agg(F.min_by("plugin_id", "_rank").alias("plugin_id"), *(F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("_rank"))).alias(f) for f in fields))


def reorder_plugins(plugins: DataFrame, named: list[str]) -> DataFrame:
    """Plugins (plugin_id, precedence) with new precedences from 1: the named ones first in the given order, the others after them as before."""
    place = F.array_position(F.array(*map(F.lit, named)) if named else F.array().cast("array<string>"), F.col("plugin_id"))
    order = Window.orderBy(F.when(place > 0, place).otherwise(F.lit(1 << 30)), "precedence", "plugin_id")  # a row for each plugin
    return plugins.withColumn("precedence", F.row_number().over(order))


def eligible(plugins: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs of ``asked`` rows and plugins that accept their asset class, exchange and currency; an empty list or value passes, currencies compare in upper case."""
    passes = F.lit(True)
    for held, value in (("asset_classes", F.col("asset_class")), ("exchanges", F.col("exchange_mic")), ("currencies", F.upper("currency"))):
        named = F.filter(held, lambda x: x != "")
        passes = passes & (F.coalesce(F.size(named), F.lit(0)) <= 0) | (F.coalesce(value, F.lit("")) == "") & passes | F.array_contains(F.col(held), value) & passes
    return asked.join(F.broadcast(plugins), F.coalesce(passes, F.lit(False)))  # one row for each configured plugin


def supported_identifiers(plugins: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Pairs of ``identifiers`` and plugins (plugin_id, supported: array of types) that can be asked with them."""
    kinds = plugins.select("plugin_id", F.explode("supported").alias("identifier_type"))
    return identifiers.join(F.broadcast(kinds), "identifier_type")  # a few for each configured plugin


def operating_mic(rows: DataFrame, exchanges: DataFrame, column: str = "exchange_mic") -> DataFrame:
    """``rows`` with ``column`` as the operating MIC (an unknown one stays) and country_code (empty for an unknown one).

    ``exchanges`` (mic, operating_mic, country_code) has a row for each venue of the ISO list.
    """
    known = exchanges.select(F.col("mic").alias(column), "operating_mic", "country_code")
    found = rows.join(F.broadcast(known), column, "left")
    return found.withColumn(column, F.coalesce("operating_mic", column)).withColumn("country_code", F.coalesce("country_code", F.lit(""))).drop("operating_mic")


def ensure_instruments(asked: DataFrame, identifiers: DataFrame, last_id: int) -> tuple[DataFrame, DataFrame]:
    """(request_id, instrument_id) for ``asked`` (request_id, identifier_type, domain, value), and the mapping (instrument_id, survivor_id) of merged ones.

    A request names its instrument by any identifier. Instruments that one request, or requests with an
    identifier in common, name together are one: the one with most identifiers survives, of equals the smallest
    id. Requests that name none share a new instrument if they share an identifier; its id is ``last_id`` plus
    the smallest of their request_ids.
    """
    keys = ["identifier_type", "domain", "value"]
    rows = asked.withColumn("domain", F.coalesce("domain", F.lit("")))
    found = find_by_identifier(identifiers, rows.select(*keys).distinct()).where("instrument_id is not null")
    node = lambda column: F.shiftleft(F.col(column), 1) + 1  # noqa: E731  requests are odd nodes, instruments even ones
    named = rows.join(found, keys).select(node("request_id").alias("a"), F.shiftleft("instrument_id", 1).alias("b"))
    shared = rows.join(rows.groupBy(*keys).agg(F.min("request_id").alias("first")), keys).select(node("request_id").alias("a"), node("first").alias("b"))
    alone = rows.select(node("request_id").alias("node")).distinct().withColumn("root", F.col("node"))
    roots = components(named.unionByName(shared)).unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))
    roots = roots.select("root", F.col("node").bitwiseAND(1).alias("asks"), F.shiftright("node", 1).alias("id"))
    clusters = roots.where("asks = 0").select(F.col("root").alias("cluster"), F.col("id").alias("instrument_id"))
    best = survivors(identifiers, clusters)
    owner = clusters.join(best, "instrument_id").groupBy(F.col("cluster").alias("root")).agg(F.min("survivor_id").alias("survivor_id"))
    first = roots.where("asks = 1").groupBy("root").agg(F.min("id").alias("first"))
    placed = roots.where("asks = 1").join(first, "root").join(owner, "root", "left")
    return placed.select(F.col("id").alias("request_id"), F.coalesce("survivor_id", F.col("first") + last_id).alias("instrument_id")), best.where("instrument_id <> survivor_id")
