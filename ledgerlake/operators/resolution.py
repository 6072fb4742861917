"""Which instrument plugins' answers make: three-valued comparison with what was asked, a winner, and a merge of what agrees with it.

``asked``: key, currency, security_type, stated and proposed (arrays of type, domain, value). ``answers``: key,
plugin_id, precedence, error (null where the plugin answered), asset_class, currency, mic, country, name, cik,
sic_code, ids and underlying_ids (arrays of type, domain, value). ``venues`` (mic, operating_mic, country_code)
has a row for each venue of the ISO list. A key has one answer of each configured plugin, so its answers are
worked on as one array; text compares without regard to case, and an empty or null field says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.idtypes import names_a_listing

AGREES, CONTRADICTS, SILENT = "AGREES", "CONTRADICTS", "SILENT"
IDS = "array<struct<type:string,domain:string,value:string>>"
FIELDS = ("mic", "country", "currency", "name", "cik", "sic_code")


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def _low(x: Column) -> Column:
    return F.lower(_text(x))


def _venue(mic: Column, what: str) -> Column:
    return F.try_element_at(F.col("_venues"), mic)[what]


def _operating(mic: Column) -> Column:
    """A MIC's operating MIC; an unknown one is its own."""
    return _low(F.coalesce(_venue(mic, "operating_mic"), mic))


def _comparable(ids: Column) -> Column:
    """Identifiers with the domain that they compare by: a ticker's venue by its operating MIC."""
    one = lambda x: F.struct(_text(x["type"]).alias("type"), F.when(x["type"] == "MIC_TICKER", _operating(x["domain"])).otherwise(_low(x["domain"])).alias("dom"), _text(x["value"]).alias("value"), _text(x["domain"]).alias("domain"))
    return F.transform(F.coalesce(ids.cast(IDS), F.array().cast(IDS)), one)


def _same_subject(a: Column, b: Column) -> Column:
    return (a["type"] == b["type"]) & (a["dom"] == b["dom"])


def _contradict(a: Column, b: Column) -> Column:
    """Whether two identifiers can't both be one instrument's: two values of one subject, or listings on two venues."""
    apart = names_a_listing(a["type"]) & (a["dom"] != "") & (b["dom"] != "") & (a["dom"] != b["dom"])
    return (a["type"] == b["type"]) & (apart | (_same_subject(a, b) & (a["value"] != b["value"])))


def _with_venues(rows: DataFrame, venues: DataFrame) -> DataFrame:
    entry = F.struct("mic", F.struct("operating_mic", "country_code"))
    return rows.crossJoin(F.broadcast(venues.agg(F.map_from_entries(F.collect_list(entry)).alias("_venues"))))  # one row, of the ISO list


def _verdict(field: str, hint: Column, found: Column, known: Column, agrees: Column) -> Column:
    said = F.when(~known, SILENT).when(agrees, AGREES).otherwise(CONTRADICTS)
    return F.struct(F.lit(field).alias("field"), _text(hint).alias("hint"), _text(found).alias("found"), said.alias("verdict"))


def _verdicts(currency: Column, security_type: Column, stated: Column, answer: Column, ids: Column) -> Column:
    """How an answer compares, field by field: currency, security type, exchange (any stated ticker's venue), and each stated identifier."""
    known = lambda x: (_text(x) != "") & (_text(x) != "UNKNOWN")
    plain = _verdict("Currency", currency, answer["currency"], (_text(currency) != "") & (_text(answer["currency"]) != ""), _low(currency) == _low(answer["currency"]))
    kind = _verdict("SecurityType", security_type, answer["asset_class"], known(security_type) & known(answer["asset_class"]), _low(security_type) == _low(answer["asset_class"]))
    tickers, at = F.filter(stated, lambda x: (x["type"] == "MIC_TICKER") & (x["dom"] != "")), _operating(answer["mic"])
    venue = _verdict("Exchange", F.get(tickers, F.lit(0))["domain"], answer["mic"], (at != "") & (F.size(tickers) > 0), F.exists(tickers, lambda x: x["dom"] == at))

    def each(hint: Column) -> Column:
        first = F.get(F.filter(ids, lambda x: (x["value"] != "") & _same_subject(hint, x)), F.lit(0))
        said = F.when(first.isNull(), SILENT).when(first["value"] == hint["value"], AGREES).otherwise(CONTRADICTS)
        return F.struct(hint["type"].alias("field"), hint["value"].alias("hint"), _text(first["value"]).alias("found"), said.alias("verdict"))

    return F.concat(F.array(plain, kind, venue), F.transform(F.filter(stated, lambda x: x["value"] != ""), each))


def _clear(verdicts: Column) -> Column:
    return ~F.exists(verdicts, lambda v: v["verdict"] == CONTRADICTS)


def _matches(verdicts: Column) -> Column:
    """Nothing contradicts and something agrees, so an answer that says little doesn't match."""
    return _clear(verdicts) & F.exists(verdicts, lambda v: v["verdict"] == AGREES)


def _compared(asked: DataFrame, answers: DataFrame, venues: DataFrame) -> DataFrame:
    """Answers that identified something, with verdicts on what was stated, and on what was proposed."""
    wanted = asked.select("key", F.col("currency").alias("_currency"), F.col("security_type").alias("_kind"), "stated", "proposed")
    rows = _with_venues(answers.where("error is null").join(wanted, "key"), venues)
    rows = rows.withColumns({"ids": _comparable(F.col("ids")), "stated": _comparable(F.col("stated")), "proposed": _comparable(F.col("proposed"))})
    answer = F.struct("currency", "asset_class", "mic")
    nothing = F.lit("")
    return rows.withColumns({
        "on_stated": _verdicts(F.col("_currency"), F.col("_kind"), F.col("stated"), answer, F.col("ids")),
        "on_proposed": _verdicts(nothing, nothing, F.col("proposed"), answer, F.col("ids")),
    })


def hint_verdicts(asked: DataFrame, answers: DataFrame, venues: DataFrame) -> DataFrame:
    """Rows (key, plugin_id, field, hint, found, verdict): each answer's every field AGREES with what was stated, CONTRADICTS it, or is SILENT."""
    return _compared(asked, answers, venues).select("key", "plugin_id", F.inline("on_stated"))


def _permits(mic: Column, country: Column, other: Column) -> Column:
    """Whether an answer that named a venue, or a market only, allows ``other``; silence allows everything."""
    there = _low(_venue(F.upper(other), "country_code"))
    return F.when((_text(other) == "") | ((mic == "") & (country == "")), True).when(mic != "", mic == other).otherwise((there == "") | (there == country))


def _agree(a: Column, b: Column) -> Column:
    """Whether two answers may be of one instrument: currency, venue, and identifiers that aren't each other's contradiction."""
    money = (a["_cur"] == "") | (b["_cur"] == "") | (a["_cur"] == b["_cur"])
    venue = _permits(a["_op"], a["_country"], b["_op"]) & _permits(b["_op"], b["_country"], a["_op"]) & ((a["_country"] == "") | (b["_country"] == "") | (a["_country"] == b["_country"]))
    named = lambda o: F.exists(a["ids"], lambda w: _same_subject(w, o) & (w["value"] == o["value"])) | ~F.exists(a["ids"], lambda w: _contradict(w, o))
    return money & venue & F.forall(b["ids"], named)


def _filled(into: Column, more: Column) -> Column:
    """The fields of ``into`` with its blanks filled from ``more``.

    A venue is taken only where ``into`` permits it, and a currency, which is a listing's, only from an answer
    of that listing or where ``into`` names none.
    """
    take = (into["mic"] == "") & (more["mic"] != "") & _permits(F.lit(""), _low(into["country"]), more["_op"])
    mic = F.when(take, more["mic"]).otherwise(into["mic"])
    listed = (mic == "") | (_operating(mic) == more["_op"])
    currency = F.when((into["currency"] == "") & listed, more["currency"]).otherwise(into["currency"])
    rest = [F.when(into[c] == "", more[c]).otherwise(into[c]).alias(c) for c in ("name", "cik", "sic_code")]
    country = F.when(into["country"] == "", more["country"]).otherwise(into["country"])
    return F.struct(mic.alias("mic"), country.alias("country"), currency.alias("currency"), *rest)


def resolve(asked: DataFrame, answers: DataFrame, venues: DataFrame) -> DataFrame:
    """One row for each key of ``asked``: (key, status, plugin_id, decided_by, asset_class, FIELDS, ids, underlying_ids, outcomes, confirmed).

    The winner is the first answer by precedence that matches what was stated, or else what was proposed without
    contradicting what was stated, or else the first. Answers that can't be of the winner's instrument are
    discarded; of the others each identifier type comes from the first by precedence, and the winner's blanks
    are filled in that order. status is IDENTIFIED; UNCONFIRMED where the key was only proposed and the merged
    answer confirms nothing stated; or, without an answer, NO_PLUGIN, TIMEOUT, ERROR or NOT_IDENTIFIED.
    """
    rows = _compared(asked, answers, venues)
    tier = F.when(_matches(F.col("on_stated")), 0).when(_clear(F.col("on_stated")) & _matches(F.col("on_proposed")), 1).otherwise(2)
    texts = [_text(F.col(c)).alias(c) for c in (*FIELDS, "asset_class")]
    entry = F.struct("precedence", "plugin_id", tier.alias("tier"), *texts, "ids", F.col("underlying_ids").cast(IDS).alias("underlying_ids"), _low(F.col("currency")).alias("_cur"), _operating(F.col("mic")).alias("_op"), _low(F.col("country")).alias("_country"))
    held = rows.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("found"), F.any_value("_venues").alias("_venues"), F.any_value("stated").alias("_stated"), F.any_value("proposed").alias("_proposed"))  # one for each plugin
    won = held.withColumn("w", F.array_min(F.transform("found", lambda x: F.struct(x["tier"].alias("tier"), x["precedence"].alias("precedence"), x["plugin_id"].alias("plugin_id"), x.alias("row"))))["row"])
    own = lambda x: x["plugin_id"] == F.col("w.plugin_id")
    kept = won.withColumn("kept", F.filter("found", lambda x: own(x) | _agree(F.col("w"), x)))
    named = F.flatten(F.transform("kept", lambda x: x["ids"]))
    first_of_type = F.aggregate(named, F.slice(named, 1, 0), lambda a, x: F.when(F.exists(a, lambda k: k["type"] == x["type"]), a).otherwise(F.concat(a, F.array(x))))
    merged = F.aggregate(F.filter("kept", lambda x: ~own(x)), F.struct(*(F.col("w")[c].alias(c) for c in FIELDS)), _filled)
    outcome = lambda x: F.struct(x["plugin_id"].alias("plugin_id"), F.when(own(x), "WON").when(F.exists("kept", lambda k: k["plugin_id"] == x["plugin_id"]), "SUPERSEDED").otherwise("DISCARDED").alias("outcome"))
    out = kept.withColumns({"merged": merged, "ids": first_of_type, "outcomes": F.transform("found", outcome)})
    out = out.join(asked.select("key", F.col("currency").alias("_currency"), F.col("security_type").alias("_kind")), "key")
    answer = F.struct(F.col("merged.currency").alias("currency"), F.col("w.asset_class").alias("asset_class"), F.col("merged.mic").alias("mic"))
    checked = F.filter(_verdicts(F.col("_currency"), F.col("_kind"), F.col("_stated"), answer, F.col("ids")), lambda v: v["verdict"] == AGREES)
    out = out.withColumn("confirmed", F.transform(checked, lambda v: v["field"]))
    guess = (F.size("_stated") == 0) & (F.size("_proposed") > 0) & (F.size("confirmed") == 0)
    decided = F.element_at(F.array(F.lit("stated"), F.lit("proposed"), F.lit("precedence")), F.col("w.tier") + 1)
    done = out.select("key", F.when(guess, "UNCONFIRMED").otherwise("IDENTIFIED").alias("_status"), F.col("w.plugin_id").alias("plugin_id"), decided.alias("decided_by"), F.col("w.asset_class").alias("asset_class"), *(F.col(f"merged.{c}").alias(c) for c in FIELDS), F.transform("ids", lambda x: F.struct(x["type"].alias("type"), x["domain"].alias("domain"), x["value"].alias("value"))).alias("ids"), F.col("w.underlying_ids").alias("underlying_ids"), "outcomes", "confirmed")
    failed = answers.groupBy("key").agg(F.max(F.col("error") == "TIMEOUT").alias("_late"), F.max(F.col("error") != "NOT_IDENTIFIED").alias("_odd"))
    status = F.coalesce("_status", F.when(F.col("_late").isNull() & F.col("_odd").isNull(), "NO_PLUGIN").when(F.col("_late"), "TIMEOUT").when(F.col("_odd"), "ERROR").otherwise("NOT_IDENTIFIED"))
    return asked.select("key").join(done, "key", "left").join(failed, "key", "left").select("key", status.alias("status"), *done.columns[2:])


def proposal_outcomes(proposals: DataFrame, resolved: DataFrame, venues: DataFrame) -> DataFrame:
    """``proposals`` (key, type, domain, value) with outcome: what the key's row of ``resolve`` established about each.

    A proposal is one claim, venue included: CONTRADICTED by another value of its type or by another venue,
    CONFIRMED by its value, UNTESTED where the answer holds neither, UNUSED where nothing was resolved. A
    currency goes by the instrument's. A listing's venue is compared whether or not its symbol was returned;
    repeated proposals each get their row.
    """
    found = resolved.select("key", F.col("plugin_id").isNotNull().alias("_found"), F.col("mic").alias("_mic"), F.col("currency").alias("_currency"), F.col("ids").alias("_ids"))
    rows = _with_venues(proposals.join(found, "key", "left"), venues)
    of_type = F.filter("_ids", lambda i: (i["type"] == F.col("type")) & (_text(i["value"]) != ""))
    carried = F.coalesce(F.size(of_type) > 0, F.lit(False))
    other = carried & (_low(F.get(of_type, F.lit(0))["value"]) != _low(F.col("value")))
    elsewhere = (_text(F.col("domain")) != "") & (_text(F.col("_mic")) != "") & (_operating(F.col("domain")) != _operating(F.col("_mic")))
    listing = F.when(other | elsewhere, "CONTRADICTED").when(carried, "CONFIRMED").otherwise("UNTESTED")
    money = F.when(_text(F.col("_currency")) == "", "UNTESTED").when(_low(F.col("_currency")) == _low(F.col("value")), "CONFIRMED").otherwise("CONTRADICTED")
    outcome = F.when(~F.coalesce("_found", F.lit(False)), "UNUSED").when(F.col("type") == "CURRENCY", money).otherwise(listing)
    return rows.withColumn("outcome", outcome).select(*proposals.columns, "outcome")


def with_underlyings(resolved: DataFrame, steps: int = 2) -> DataFrame:
    """``resolved`` with underlying_key: the key that bears the first underlying identifier that any bears, and root_key after ``steps`` of it at most.

    Several keys that bear it are one instrument by it: the smallest stands for them. A key isn't its own underlying.
    """
    text = lambda x: (F.col(f"{x}.type").alias("type"), _low(F.col(f"{x}.domain")).alias("domain"), F.col(f"{x}.value").alias("value"))
    bears = resolved.select("key", F.explode("ids").alias("i")).select(F.col("key").alias("underlying_key"), *text("i"))
    bears = bears.groupBy("type", "domain", "value").agg(F.min("underlying_key").alias("underlying_key"))
    names = resolved.select("key", F.posexplode("underlying_ids").alias("place", "u")).select("key", "place", *text("u"))
    under = names.join(bears, ["type", "domain", "value"]).where("key <> underlying_key").groupBy("key").agg(F.min_by("underlying_key", "place").alias("underlying_key"))
    rows = resolved.join(under, "key", "left").withColumn("root_key", F.coalesce("underlying_key", "key"))
    for _ in range(steps - 1):
        above = under.select(F.col("key").alias("root_key"), F.col("underlying_key").alias("_above"))
        rows = rows.join(above, "root_key", "left").withColumn("root_key", F.coalesce("_above", "root_key")).drop("_above")
    return rows
