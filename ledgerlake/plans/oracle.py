"""DuckDB SQL for the ledger queries, written apart from the Spark plans: intervals by single days, positions by summing all earlier postings.

Transfer matching is a walk over sorted candidates here, and rounds of joins there.
"""

from __future__ import annotations

from ledgerlake.plans.queries import AS_OF, BEFORE, CUTOFF, FLOW_BEFORE, FLOW_START, START
from ledgerlake.sources.fixture import TODAY, with_views


def shown(x: str, name: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,6)) AS DOUBLE) AS {name}"


def days(source: str, keys: str, start: str = "from_date", end: str = "before_date") -> str:
    """Each single day of the ranges of ``source``."""
    return f"SELECT DISTINCT {keys}, CAST(unnest(generate_series({start}, {end} - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM ({source}) WHERE {start} < {end}"


def islands(source: str, keys: str, start: str = "from_date", end: str = "before_date") -> str:
    """Runs of consecutive days of ``source`` (keys, day) as ranges."""
    numbered = f"SELECT {keys}, day, day - CAST(row_number() OVER (PARTITION BY {keys} ORDER BY day) AS INTEGER) AS run FROM ({source})"
    return f"SELECT {keys}, min(day) AS {start}, CAST(max(day) + INTERVAL 1 DAY AS DATE) AS {end} FROM ({numbered}) GROUP BY {keys}, run"


def less(needed: str, covered: str, keys: str) -> str:
    """What of the ranges ``needed`` isn't in ``covered``."""
    return islands(f"{days(needed, keys)} EXCEPT {days(covered, keys)}", keys)


def merged(source: str, keys: str) -> str:
    return islands(days(source, keys), keys)


IS_IMPORT = "kind LIKE '%_import' AS is_import"
OF_CYCLE = "r.kind AS run_kind, r.started_at AS run_started_at, r.outcome AS run_outcome, r.telemetry_incomplete AS run_telemetry_incomplete, r.kind LIKE '%_import' AS is_import"
OF_RUN = f"r.job_id AS run_job_id, r.user_id AS run_user_id, r.broker AS run_broker, r.source AS run_source, {OF_CYCLE}"
OF_ATTEMPT = "a.purpose AS attempt_purpose, a.depth AS attempt_depth, a.outcome AS attempt_outcome, a.asset_class AS attempt_asset_class"
REACHED = "a.outcome <> 'db_short_circuit' AND a.outcome <> 'no_eligible_plugins' AS reached_plugins"
CHAIN = "run_attempts a JOIN run_keys k ON k.id = a.resolution_key_id JOIN runs r ON r.id = k.run_id"
GAP_SETTLED = "coalesce(g.outcome, '') IN ('filled', 'settled_empty')"


def resolved(name: str) -> str:
    return f"coalesce(k.outcome, '') IN ('identified', 'db_identifier_hints', 'db_source_description') AS {name}"


OF_KEY = f"k.source AS key_source, k.description AS key_description, k.tx_count AS key_tx_count, k.outcome AS key_outcome, {resolved('key_resolved')}"


# ---------------------------------------------------------------- shared steps

EFFECTIVE = f"""effective AS (
  SELECT instrument_id, ex_date, split_from, split_to FROM splits WHERE ex_date <= DATE '{TODAY}'
  UNION ALL SELECT i.instrument_id, s.ex_date, s.split_from, s.split_to FROM instruments i JOIN splits s ON s.instrument_id = i.underlying_id WHERE s.ex_date <= DATE '{TODAY}')"""
ADJUSTED = f"""{EFFECTIVE}, factors AS (
  SELECT tx_id, product(split_to) AS num, product(split_from) AS den FROM postings JOIN effective USING (instrument_id) WHERE ex_date > share_count_basis GROUP BY tx_id
), adjusted AS (
  SELECT p.*, CAST(CAST(quantity AS DOUBLE) * coalesce(num, 1) / coalesce(den, 1) AS DECIMAL(38,12)) AS own,
         CAST(CAST(unit_price AS DOUBLE) * coalesce(den, 1) / coalesce(num, 1) AS DECIMAL(38,12)) AS own_price
  FROM postings p LEFT JOIN factors USING (tx_id))"""
BARS = f"""{EFFECTIVE}, bar_factors AS (
  SELECT instrument_id, price_date, product(split_to) AS num, product(split_from) AS den FROM bars JOIN effective USING (instrument_id) WHERE ex_date > share_count_basis GROUP BY ALL
), adjusted_bars AS (
  SELECT b.*, CAST(CAST(close AS DOUBLE) * coalesce(den, 1) / coalesce(num, 1) AS DECIMAL(38,12)) AS own_close
  FROM bars b LEFT JOIN bar_factors USING (instrument_id, price_date))"""
SIDES = """sides AS (
  SELECT from_group_id AS group_id, instrument_id, to_group_id AS other FROM matches UNION SELECT to_group_id, instrument_id, from_group_id FROM matches)"""
MEMBERS = """wanted AS (
  SELECT portfolio_id, user_id, list(filter_value) FILTER (filter_type = 'broker') AS bs, list(filter_value) FILTER (filter_type = 'account') AS acs, list(filter_value) FILTER (filter_type = 'instrument') AS ins
  FROM filters GROUP BY ALL
), members AS (
  SELECT p.*, portfolio_id FROM adjusted p JOIN wanted USING (user_id)
  WHERE (bs IS NULL OR list_contains(bs, broker)) AND (acs IS NULL OR list_contains(acs, account)) AND (ins IS NULL OR coalesce(list_contains(ins, CAST(instrument_id AS VARCHAR)), false)))"""
FLIGHT = """flight AS (
  SELECT DISTINCT a.portfolio_id, a.tx_id FROM members a JOIN sides s ON a.group_id = s.group_id AND a.instrument_id = s.instrument_id
  JOIN members b ON b.portfolio_id = a.portfolio_id AND b.group_id = s.other AND b.instrument_id = a.instrument_id
  WHERE a.account_type = 'TRANSFER_CLEARING' AND b.account_type = 'TRANSFER_CLEARING')"""
UNMATCHED = "NOT EXISTS (SELECT 1 FROM sides s WHERE s.group_id = p.group_id AND s.instrument_id = p.instrument_id)"
OPEN = "HAVING NOT (sum(own) IS NULL OR abs(sum(own)) <= count(*) FILTER (own <> quantity) * CAST('0.000000000001' AS DECIMAL(13,12)))"
BALANCES = f"""balances AS (
  SELECT user_id, broker, account, account_type, instrument_id, description, sum(own) AS balance, count(*) AS n_postings, min(order_date) AS oldest, max(order_date) AS newest
  FROM adjusted p WHERE account_type IN ('IMBALANCE', 'TRANSFER_CLEARING', 'SOURCE_ROUNDING') AND {UNMATCHED}
  GROUP BY ALL {OPEN})"""
WEIGHTED = """valued AS (
  SELECT p.*, i.asset_class, CASE WHEN i.asset_class = 'CASH' THEN i.currency END AS money, 2 AS price_scale FROM postings p LEFT JOIN instruments i USING (instrument_id)
), weighted AS (
  SELECT *, CASE WHEN converts THEN 'cur:' || settlement_currency WHEN money IS NOT NULL THEN 'cur:' || money WHEN instrument_id IS NOT NULL THEN 'inst:' || instrument_id ELSE 'desc:' || description END AS commodity,
         CASE WHEN converts THEN CAST(quantity AS DECIMAL(18,2)) * CASE WHEN asset_class = 'OPTION' THEN 100 ELSE 1 END * unit_price ELSE quantity END AS weight
  FROM (SELECT *, unit_price IS NOT NULL AND settlement_currency IS NOT NULL AND coalesce(money, '') <> settlement_currency AND (tx_type = 'TRADE_ASSET' OR money IS NOT NULL) AS converts FROM valued)
), edges AS (
  SELECT group_id, tx_id, CASE tx_type WHEN 'DIVIDEND' THEN 'INCOME' ELSE 'EXPENSE' END AS account_type, -weight AS amount, commodity
  FROM weighted WHERE account_type = 'USER' AND weight <> 0 AND tx_type IN ('DIVIDEND', 'TRANSACTION_COST')
), shaken AS (
  SELECT group_id, sum(CAST(CAST(abs(weight) AS DOUBLE) / abs(unit_price) * 0.5 * power(10, -greatest(price_scale, 2)) AS DECIMAL(28,10))) AS rounding FROM weighted WHERE account_type = 'USER' AND unit_price <> 0 AND weight <> quantity GROUP BY ALL
), residuals AS (
  SELECT s.*, coalesce(rounding, 0) AS rounding FROM (SELECT group_id, commodity, sum(amount) AS residual FROM (
    SELECT group_id, commodity, weight AS amount FROM weighted WHERE account_type = 'USER'
    UNION ALL SELECT group_id, commodity, amount FROM edges) GROUP BY ALL HAVING sum(amount) <> 0) s LEFT JOIN shaken USING (group_id)
), moves AS (SELECT group_id, bool_or(tx_type = 'TRANSFER_INTERNAL') AS transfers FROM postings GROUP BY ALL
), closing AS (
  SELECT group_id, commodity, -residual AS amount, CASE WHEN abs(residual) < CASE WHEN commodity LIKE 'cur:%' THEN 0.005 + rounding ELSE 0.000001 END THEN 'SOURCE_ROUNDING' WHEN transfers THEN 'TRANSFER_CLEARING' ELSE 'IMBALANCE' END AS account_type
  FROM residuals JOIN moves USING (group_id))"""


def held(extend: bool) -> str:
    """Ranges in which any user held an instrument."""
    last = f"CAST(DATE '{TODAY}' + INTERVAL 1 DAY AS DATE)" if extend else "CAST(day + INTERVAL 1 DAY AS DATE)"
    return f"""daily AS (SELECT user_id, instrument_id, order_date AS day, sum(quantity) AS net FROM postings WHERE account_type = 'USER' AND instrument_id IS NOT NULL GROUP BY ALL),
running AS (SELECT *, sum(net) OVER (PARTITION BY user_id, instrument_id ORDER BY day) <> 0 AS open FROM daily),
changes AS (SELECT * FROM (SELECT *, coalesce(lag(open) OVER (PARTITION BY user_id, instrument_id ORDER BY day), false) AS was FROM running) WHERE open <> was),
runs AS (SELECT instrument_id, day AS from_date, before_date FROM (SELECT *, coalesce(lead(day) OVER (PARTITION BY user_id, instrument_id ORDER BY day), {last}) AS before_date FROM changes) WHERE open),
held AS ({merged("SELECT instrument_id, from_date, before_date FROM runs", "instrument_id")})"""


COVERED = f"covered AS ({merged('SELECT instrument_id, covered_from AS from_date, covered_before AS before_date FROM coverage', 'instrument_id')})"
FIRST_HELD = """held_first AS (SELECT instrument_id, min(order_date) AS first_date FROM postings WHERE account_type = 'USER' AND instrument_id IS NOT NULL GROUP BY ALL),
first_held AS (SELECT instrument_id, min(first_date) AS first_date FROM (
  SELECT instrument_id, first_date FROM held_first JOIN instruments USING (instrument_id) WHERE asset_class IN ('STOCK', 'ETF')
  UNION ALL SELECT underlying_id, first_date FROM held_first JOIN instruments USING (instrument_id) WHERE asset_class IN ('OPTION', 'FUTURE') AND underlying_id IS NOT NULL) GROUP BY ALL)"""
WINDOW = f"window_days AS (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{BEFORE}' - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day)"
FILLED = f"""{BARS}, {COVERED}, {WINDOW}, grid AS (
  SELECT instrument_id, day, from_date AS span_from FROM covered JOIN window_days ON day >= from_date AND day < before_date
), filled AS (
  SELECT g.instrument_id, g.day, b.close, b.own_close FROM grid g ASOF JOIN adjusted_bars b ON g.instrument_id = b.instrument_id AND g.day >= b.price_date WHERE b.price_date >= g.span_from)"""
POSITIONS = f"""positions AS (
  SELECT scope_id, instrument_id, CASE WHEN instrument_id IS NULL THEN description END AS description, day, sum(own) AS quantity, count(*) FILTER (own <> quantity) AS inexact
  FROM source JOIN window_days ON order_date <= day GROUP BY ALL
  {OPEN})"""
USER_SOURCE = """source AS (SELECT p.*, user_id AS scope_id FROM adjusted p WHERE account_type = 'USER' OR account_type = 'TRANSFER_CLEARING' AND EXISTS (SELECT 1 FROM sides s WHERE s.group_id = p.group_id AND s.instrument_id = p.instrument_id))"""
PORTFOLIO_SOURCE = "source AS (SELECT *, portfolio_id AS scope_id FROM members m WHERE account_type = 'USER' OR EXISTS (SELECT 1 FROM flight f WHERE f.tx_id = m.tx_id AND f.portfolio_id = m.portfolio_id))"


def priced(display: str) -> str:
    """Each scope's total and its unpriced names by day."""
    pair = "SELECT instrument_id, substr(value, 1, 3) AS ccy FROM identifiers WHERE identifier_type = 'FX_PAIR' AND valid_before IS NULL AND value LIKE '%USD' AND length(value) = 6"
    rate = "coalesce(r.rate, 1.0) / d.rate" if display != "USD" else "r.rate"
    can = "d.rate IS NOT NULL AND (coalesce(currency, 'USD') = 'USD' OR r.rate IS NOT NULL)" if display != "USD" else "r.rate IS NOT NULL"
    return f"""rates AS (SELECT ccy, day, CAST(close AS DOUBLE) AS rate FROM filled JOIN ({pair}) USING (instrument_id)),
flagged AS (
  SELECT p.scope_id, p.day, coalesce(i.name, p.description) AS label, p.instrument_id IS NOT NULL AND (i.asset_class = 'CASH' OR f.own_close IS NOT NULL) AS priced,
         coalesce(currency, '{display}') = '{display}' AS own, {can} AS convertible, {rate} AS factor,
         CAST(p.quantity AS DOUBLE) * CASE WHEN i.asset_class = 'CASH' THEN 1.0 ELSE CAST(f.own_close AS DOUBLE) END AS amount
  FROM positions p LEFT JOIN instruments i USING (instrument_id) LEFT JOIN filled f ON f.instrument_id = p.instrument_id AND f.day = p.day
  LEFT JOIN rates r ON r.ccy = i.currency AND r.day = p.day LEFT JOIN rates d ON d.ccy = '{display}' AND d.day = p.day
), totals AS (
  SELECT scope_id, day AS val_date, CAST(coalesce(sum(CAST(CASE WHEN priced AND own THEN amount WHEN priced AND convertible THEN amount * factor END AS DECIMAL(38,4))), 0) AS DOUBLE) AS total_value,
         coalesce(string_agg(DISTINCT label, '|' ORDER BY label) FILTER (label <> '' AND NOT coalesce(priced AND (own OR convertible), false)), '') AS unpriced
  FROM flagged GROUP BY ALL)"""


#: Declarations with the factor of their own basis, and their holding in it.
CHECKED = f"""{EFFECTIVE}, kinds AS (
  SELECT *, CASE WHEN as_of_date = min(as_of_date) OVER (PARTITION BY user_id, broker, account, instrument_id) THEN 'PAD' ELSE 'ASSERT' END AS kind FROM declared
), declared_factor AS (
  SELECT k.*, (SELECT coalesce(product(split_to), 1) FROM effective e WHERE e.instrument_id = k.instrument_id AND e.ex_date > k.share_count_basis) AS num_d,
         (SELECT coalesce(product(split_from), 1) FROM effective e WHERE e.instrument_id = k.instrument_id AND e.ex_date > k.share_count_basis) AS den_d FROM kinds k
), posting_factor AS (
  SELECT p.*, (SELECT coalesce(product(split_to), 1) FROM effective e WHERE e.instrument_id = p.instrument_id AND e.ex_date > p.share_count_basis) AS num,
         (SELECT coalesce(product(split_from), 1) FROM effective e WHERE e.instrument_id = p.instrument_id AND e.ex_date > p.share_count_basis) AS den FROM postings p WHERE account_type = 'USER' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
), by_basis AS (
  SELECT d.user_id, d.broker, d.account, d.instrument_id, d.as_of_date, d.declared_qty, d.kind, num * den_d AS up, den * num_d AS down, sum(p.quantity) AS raw, count(p.tx_id) AS n
  FROM declared_factor d LEFT JOIN posting_factor p ON p.user_id = d.user_id AND p.broker = d.broker AND p.account = d.account AND p.instrument_id = d.instrument_id AND p.order_date <= d.as_of_date
  GROUP BY ALL
), checked AS (
  SELECT user_id, broker, account, instrument_id, as_of_date, declared_qty, kind, coalesce(sum(CAST(CAST(raw AS DOUBLE) * up / down AS DECIMAL(38,12))), 0) AS computed,
         CAST(sum(n) AS BIGINT) AS n_postings, count(*) FILTER (up <> down AND n > 0) AS inexact
  FROM by_basis GROUP BY ALL)"""

PLAIN = "CASE WHEN identifier_type IN ('MIC_TICKER', 'OPENFIGI_TICKER') THEN translate(upper(trim(value)), './- ', '') ELSE value END"


def _rank(order: str) -> str:
    return "CASE identifier_type " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(order.split())) + " ELSE 99 END"


BEST = f"""ranked AS (SELECT *, {_rank("MIC_TICKER OPENFIGI_TICKER OCC ISIN OPENFIGI_SHARE_CLASS OPENFIGI_COMPOSITE CUSIP SEDOL OPRA BROKER_DESCRIPTION")} AS r FROM identifiers WHERE valid_before IS NULL),
best AS (SELECT instrument_id, identifier_type, domain, value FROM ranked QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY r, coalesce(domain, ''), value, identifier_type) = 1)"""
SHOWN_NAMES = f"ranked AS (SELECT *, {_rank('MIC_TICKER OPENFIGI_TICKER OCC BROKER_DESCRIPTION CURRENCY FX_PAIR')} AS r FROM identifiers WHERE valid_before IS NULL)"
PRICE_NAMES = f"ranked AS (SELECT *, {_rank('MIC_TICKER OPENFIGI_TICKER FX_PAIR ISIN')} AS r FROM identifiers WHERE valid_before IS NULL)"
RESOLUTION = """SELECT s.key,
    CASE WHEN t.key IS NOT NULL THEN CASE WHEN NOT EXISTS (SELECT 1 FROM hid h WHERE h.key = s.key AND role = 'stated') AND EXISTS (SELECT 1 FROM hid h WHERE h.key = s.key AND role = 'proposed') AND NOT EXISTS (SELECT 1 FROM agreed a WHERE a.key = s.key) THEN 'UNCONFIRMED' ELSE 'IDENTIFIED' END
         WHEN f.key IS NULL THEN 'NO_PLUGIN' WHEN late THEN 'TIMEOUT' WHEN odd THEN 'ERROR' ELSE 'NOT_IDENTIFIED' END AS status,
    t.plugin_id, CASE tier WHEN 0 THEN 'stated' WHEN 1 THEN 'proposed' WHEN 2 THEN 'precedence' END AS decided_by, asset_class, t.mic, t.country, t.currency, t.name, t.cik, t.sic_code,
    CASE WHEN t.key IS NOT NULL THEN coalesce((SELECT string_agg(concat_ws(':', type, domain, value), '|' ORDER BY concat_ws(':', type, domain, value)) FROM merged_ids m WHERE m.key = s.key), '') END AS ids,
    CASE WHEN t.key IS NOT NULL THEN coalesce((SELECT string_agg(field, '|' ORDER BY field) FROM agreed a WHERE a.key = s.key), '') END AS confirmed,
    (SELECT min(b.key) FROM answer_ids u JOIN merged_ids b ON b.type = 'ISIN' AND b.value = u.value WHERE u.key = s.key AND u.plugin_id = t.plugin_id AND u.type = 'UNDERLYING' HAVING min(b.key) <> s.key) AS underlying_key
    FROM asked s LEFT JOIN twice t ON t.key = s.key LEFT JOIN failed f ON f.key = s.key"""
NEEDS = """needs AS (
  SELECT currency AS need, from_date, before_date FROM held JOIN instruments USING (instrument_id) WHERE asset_class <> 'FX' AND currency <> 'USD'
  UNION ALL SELECT u.d, from_date, before_date FROM held JOIN instruments USING (instrument_id) JOIN (SELECT DISTINCT display_currency AS d FROM users WHERE display_currency NOT IN ('', 'USD')) u ON u.d <> currency WHERE asset_class <> 'FX'
), pairs AS (SELECT n.from_date, n.before_date, i.instrument_id FROM needs n JOIN identifiers i ON i.identifier_type = 'FX_PAIR' AND i.value = n.need || 'USD' AND i.valid_before IS NULL)"""
REQUESTS = f"""gaps AS ({less('SELECT * FROM held', 'SELECT * FROM covered', 'instrument_id')} UNION ALL {less('SELECT instrument_id, from_date, before_date FROM pairs', 'SELECT * FROM covered', 'instrument_id')}),
best AS (SELECT * FROM ranked WHERE r < 99 QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY r, coalesce(domain, ''), value) = 1),
told AS (SELECT g.*, name, asset_class, identifier_type AS t, coalesce(domain, '') AS d, value, CASE WHEN identifier_type = 'MIC_TICKER' AND domain <> '' THEN domain ELSE coalesce(exchange_mic, '') END AS venue FROM gaps g JOIN instruments USING (instrument_id) JOIN best USING (instrument_id)),
coded AS (SELECT *, CASE venue WHEN 'XNAS' THEN 'NASDAQ' WHEN 'XNYS' THEN 'NYSE' WHEN 'XLON' THEN 'LON' END AS code FROM told),
chunks AS (SELECT *, CAST(unnest(generate_series(from_date, before_date - INTERVAL 1 DAY, INTERVAL 365 DAY)) AS DATE) AS c FROM coded WHERE t = 'FX_PAIR' OR (t IN ('MIC_TICKER', 'OPENFIGI_TICKER') AND code IS NOT NULL)),
asked AS (SELECT *, least(CAST(c + INTERVAL 364 DAY AS DATE), CAST(before_date - INTERVAL 1 DAY AS DATE)) AS e, CAST(floor(instrument_id / 50) AS BIGINT) AS sheet FROM chunks),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY sheet ORDER BY instrument_id, c) * 2 - 2 AS INTEGER) AS place FROM asked)"""
EXPOSURE = """totals AS (SELECT broker, instrument_id, sum(balance) AS total FROM balances GROUP BY ALL),
widest AS (SELECT broker, max(abs(total)) AS w FROM totals GROUP BY ALL),
exposure AS (
  SELECT t.*, CAST(row_number() OVER (PARTITION BY t.broker ORDER BY abs(total) DESC, instrument_id NULLS FIRST) AS INTEGER) AS row_rank, r.broker_rank
  FROM totals t JOIN (SELECT broker, CAST(row_number() OVER (ORDER BY w DESC, broker) AS INTEGER) AS broker_rank FROM widest) r USING (broker))"""
EVENT_ROWS = "rows AS (SELECT user_id AS key, CAST(ts AS DATE) AS day, event_id, value FROM events)"
WHOLE = "split_to % split_from = 0 AND split_to > split_from"
PENDING = f"""since AS (
  SELECT instrument_id, coalesce((SELECT d.valid_from FROM identifiers d WHERE d.instrument_id = o.instrument_id AND d.identifier_type = 'OCC' AND d.valid_before IS NULL ORDER BY d.valid_from DESC NULLS LAST LIMIT 1),
         (SELECT min(t.trade_date) FROM postings t WHERE t.instrument_id = o.instrument_id), DATE '0001-01-01') AS since
  FROM instruments o WHERE o.asset_class = 'OPTION'),
pending AS (
  SELECT o.instrument_id, s.ex_date, s.split_from, s.split_to FROM instruments o JOIN splits s ON s.instrument_id = o.underlying_id JOIN since n ON n.instrument_id = o.instrument_id
  WHERE s.ex_date <= DATE '{TODAY}' AND s.ex_date <= o.expiry AND s.ex_date > n.since)"""


def _symbol(strike: str) -> str:
    root = "'U' || CAST(underlying_id AS VARCHAR)"
    return f"CASE WHEN length({root}) <= 6 THEN {root} || strftime(expiry, '%y%m%d') || put_call || lpad(CAST(CAST(round({strike} * 1000) AS BIGINT) AS VARCHAR), 8, '0') END"


#: Options by the OCC name in force, read by a pattern; each pending split's strike from the product of all up to it.
RESTATED = f"""in_force AS (
  SELECT instrument_id, replace(upper(trim(value)), ' ', '') AS name FROM identifiers WHERE identifier_type = 'OCC' AND valid_before IS NULL
  QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY valid_from DESC NULLS LAST, value DESC) = 1),
waiting AS (
  SELECT p.*, i.underlying_id, n.name, NOT ({WHOLE}) AS odd, bool_or(NOT ({WHOLE})) OVER (PARTITION BY p.instrument_id) AS blocked,
         regexp_matches(n.name, '^.{{1,6}}[0-9]{{6}}[CP][0-9]{{8}}$') AS readable, lead(ex_date) OVER (PARTITION BY p.instrument_id ORDER BY ex_date) AS valid_before,
         CAST(CAST(i.strike AS DOUBLE) * (SELECT product(q.split_from) / product(q.split_to) FROM pending q WHERE q.instrument_id = p.instrument_id AND q.ex_date <= p.ex_date) AS DECIMAL(18,3)) AS moved_strike
  FROM pending p JOIN instruments i USING (instrument_id) JOIN in_force n USING (instrument_id) WHERE i.strike IS NOT NULL),
named AS (
  SELECT instrument_id, ex_date AS valid_from, valid_before, moved_strike, name[1:len(name) - 8] || lpad(CAST(CAST(round(moved_strike * 1000) AS BIGINT) AS VARCHAR), 8, '0') AS symbol
  FROM waiting WHERE NOT blocked AND readable)"""
#: Instruments by number modulo 700 are one; the one with most identifiers, then the oldest, survives.
MERGE = """counted AS (SELECT i.instrument_id, i.instrument_id % 700 AS cluster, i.instrument_id % 13 AS created_at, count(d.instrument_id) AS n FROM instruments i LEFT JOIN identifiers d USING (instrument_id) WHERE i.instrument_id > 0 GROUP BY ALL),
survivor AS (SELECT cluster, instrument_id AS survivor_id FROM counted QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, created_at, instrument_id) = 1),
mapping AS (SELECT instrument_id, survivor_id FROM counted JOIN survivor USING (cluster))"""
#: Stated postings in the groups that g15 gives them, of groups that changed only: those with postings on either side of the cut, or named otherwise than by their smallest posting.
MOVED = """derived AS (SELECT *, CASE WHEN tx_id % 1000 > 3 THEN group_id * 1000 + 4 ELSE group_id * 1000 + 1 END AS event_id, min(tx_id) OVER (PARTITION BY group_id) AS old_group FROM postings WHERE account_type = 'USER'),
changed AS (SELECT event_id AS id FROM derived WHERE event_id <> old_group UNION SELECT old_group FROM derived WHERE event_id <> old_group),
moved AS (SELECT * EXCLUDE (group_id, event_id, old_group), event_id AS group_id FROM derived WHERE event_id IN (SELECT id FROM changed))"""
#: A walk over the sorted candidates of each user and instrument, one at a time; ``rivals`` are later ones of equal evidence that share a side.
TRANSFERS = """side AS (
  SELECT user_id, instrument_id, group_id, broker, account, order_date AS day, split_adjusted_quantity AS amount,
         (SELECT list(e.ordinal) FROM journal_evidence e WHERE e.group_id = j.group_id AND list_contains(e.matches, 'ORDINAL')) AS ordinals,
         (SELECT list(lower(trim(e.token))) FROM journal_evidence e WHERE e.group_id = j.group_id AND list_contains(e.matches, 'ACCOUNT')) AS names
  FROM journals j
), pairs AS (
  SELECT a.user_id, a.instrument_id, a.group_id AS f, b.group_id AS t, abs(a.day - b.day) AS days, a.broker = b.broker AS same,
         coalesce(list_contains(a.names, lower(trim(b.account))), false) OR coalesce(list_contains(b.names, lower(trim(a.account))), false) AS named,
         (SELECT min(abs(x - y)) FROM (SELECT unnest(a.ordinals) AS x), (SELECT unnest(b.ordinals) AS y)) AS apart
  FROM side a JOIN side b ON a.user_id = b.user_id AND a.instrument_id = b.instrument_id AND a.amount > 0 AND a.amount = -b.amount
  WHERE abs(a.day - b.day) <= 7 AND NOT (a.broker = b.broker AND lower(a.account) = lower(b.account))
), cands AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, instrument_id ORDER BY pass, apart, days, f, t) AS k
  FROM (SELECT user_id, instrument_id, f, t, days, 1 AS pass, 0 AS apart FROM pairs WHERE same AND named UNION ALL SELECT user_id, instrument_id, f, t, days, 2, apart FROM pairs WHERE same AND apart <= 64)
), ready AS (
  SELECT c.*, (SELECT coalesce(list({'f': r.f, 't': r.t}), []) FROM cands r WHERE r.user_id = c.user_id AND r.instrument_id = c.instrument_id AND r.pass = c.pass AND r.apart = c.apart AND r.days = c.days AND r.k > c.k AND (r.f = c.f OR r.t = c.t)) AS rivals FROM cands c
), walk AS (
  SELECT DISTINCT user_id, instrument_id, CAST(0 AS BIGINT) AS k, 1 AS pass, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS gone, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS t, false AS won FROM cands
  UNION ALL
  SELECT user_id, instrument_id, k, pass, CASE WHEN free AND clear THEN list_concat(taken, [f, t]) ELSE taken END, CASE WHEN free AND NOT clear THEN list_concat(gone, [f, t]) ELSE gone END, f, t, free AND clear
  FROM (SELECT *, NOT list_contains(list_concat(taken, gone), f) AND NOT list_contains(list_concat(taken, gone), t) AS free,
               len(list_filter(rivals, lambda r: NOT list_contains(list_concat(taken, gone), r.f) AND NOT list_contains(list_concat(taken, gone), r.t))) = 0 AS clear
        FROM (SELECT w.user_id, w.instrument_id, c.k, c.pass, w.taken, CASE WHEN w.pass = c.pass THEN w.gone ELSE [] END AS gone, c.f, c.t, c.rivals
              FROM walk w JOIN ready c ON c.user_id = w.user_id AND c.instrument_id = w.instrument_id AND c.k = w.k + 1))
), proposed AS (SELECT user_id, instrument_id, f AS from_group_id, t AS to_group_id, CASE pass WHEN 1 THEN 'POINTER' ELSE 'REFERENCE' END AS method FROM walk WHERE won)"""
#: The upload of b9: everyone's postings after it, in their new groups, and the groups that it touches or shortens.
UPLOADED = """ledger AS (SELECT * EXCLUDE (order_date), CAST(order_date + CAST(tx_id % 1000 AS INTEGER) * INTERVAL 15 DAY AS DATE) AS order_date, account_type = 'EQUITY' AS opening FROM postings WHERE account_type IN ('USER', 'EQUITY')),
inside AS (SELECT l.tx_id, l.group_id FROM ledger l JOIN windows w ON l.user_id = w.user_id AND l.broker = w.broker WHERE NOT opening AND order_date >= period_from AND order_date < period_before),
everyone AS (
  SELECT *, false AS fresh FROM ledger WHERE tx_id NOT IN (SELECT tx_id FROM inside)
  UNION ALL SELECT * REPLACE (tx_id + CASE WHEN group_id % 3 = 0 THEN 500 ELSE 0 END AS tx_id, CAST(quantity * 2 AS DECIMAL(18,6)) AS quantity), true FROM ledger WHERE tx_id IN (SELECT tx_id FROM inside) AND tx_id % 1000 <> 4
), sets AS (
  SELECT user_id, broker, tx_id // 1000 AS token, min(tx_id) AS first FROM everyone WHERE NOT opening AND (tx_id // 1000) % 2 = 0 GROUP BY ALL HAVING count(*) > 1 AND bool_or(fresh)
), placed AS (
  SELECT e.*, CASE WHEN s.first IS NOT NULL AND NOT opening THEN -s.first WHEN fresh THEN -e.tx_id ELSE e.group_id END AS to_group
  FROM everyone e LEFT JOIN sets s ON s.user_id = e.user_id AND s.broker = e.broker AND s.token = e.tx_id // 1000
), lost AS (SELECT group_id FROM inside UNION SELECT group_id FROM placed WHERE NOT fresh AND to_group < 0),
touched AS (SELECT group_id FROM lost UNION SELECT to_group FROM placed WHERE to_group < 0),
settled_rows AS (SELECT * EXCLUDE (group_id, to_group, fresh, opening), to_group AS group_id FROM placed WHERE to_group IN (SELECT group_id FROM touched))"""


def _both(old: str, new: str) -> str:
    return f"SELECT 'removed' AS change, * FROM (({old}) EXCEPT ALL ({new})) UNION ALL SELECT 'added', * FROM (({new}) EXCEPT ALL ({old}))"


def _walk(name: str, candidates: str, order: str) -> str:
    """Steps that take candidates (k, a, c: set and sides) one after another, each side once; the last has the pairs taken."""
    return f"""{name}_ordered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order}) AS n FROM ({candidates})),
{name}_walk AS (
  SELECT DISTINCT k, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS c, false AS won FROM {name}_ordered
  UNION ALL
  SELECT k, n, CASE WHEN free THEN list_concat(used, [a, c]) ELSE used END, a, c, free
  FROM (SELECT w.k, o.n, w.used, o.a, o.c, NOT list_contains(w.used, o.a) AND NOT list_contains(w.used, o.c) AS free FROM {name}_walk w JOIN {name}_ordered o ON o.k = w.k AND o.n = w.n + 1)
), {name} AS (SELECT k, a, c FROM {name}_walk WHERE won)"""


#: Statements with what the rules ask of them; ``gap`` is the least distance of two rows' references of one label.
ASKED = """s AS (
  SELECT *, concat_ws('|', user_id, broker, account, order_date) AS k, NOT list_contains(tx_types, 'TRADE_ASSET') AS money, list_contains(tx_types, 'TRADE_CASH') AS may_cash, tx_types = ['TRADE_CASH'] AS must_cash,
         abs(quantity * unit_price) AS worth FROM statements WHERE quantity <> 0
), refs AS (SELECT tx_id, label, ordinal, ordinal_span, position FROM evidence WHERE list_contains(matches, 'ORDINAL') AND ordinal IS NOT NULL
), gap AS (
  SELECT p.tx_id AS a, q.tx_id AS c, min(abs(y.ordinal - x.ordinal)) AS distance FROM s p JOIN s q ON p.k = q.k AND p.tx_id <> q.tx_id JOIN refs x ON x.tx_id = p.tx_id JOIN refs y ON y.tx_id = q.tx_id AND y.label = x.label GROUP BY ALL)"""


def _traded(name: str, free: str, buys: bool) -> str:
    """A purchase's or sale's pairs among the rows ``free``."""
    fits = "abs(x.settlement_amount) - abs(y.quantity) > -0.005" if buys else "abs(abs(x.settlement_amount) - abs(y.quantity)) < 0.005"
    sides = "x.quantity > 0 AND y.quantity < 0" if buys else "x.quantity < 0 AND y.quantity > 0"
    candidates = f"""SELECT x.k, x.tx_id AS a, y.tx_id AS c, coalesce(distance, 9223372036854775807) AS distance FROM {free} x JOIN {free} y ON x.k = y.k LEFT JOIN gap g ON g.a = x.tx_id AND g.c = y.tx_id
  WHERE NOT x.money AND x.settlement_amount IS NOT NULL AND y.money AND y.may_cash AND {sides} AND {fits} AND (coalesce(x.worth, 0) = 0 OR abs(abs(y.quantity) - x.worth) * 10000 <= x.worth * 75)"""
    return _walk(name, candidates, "distance, a, c")


def _left(name: str, free: str, taken: str) -> str:
    return f"{name} AS (SELECT * FROM {free} WHERE tx_id NOT IN (SELECT a FROM {taken} UNION ALL SELECT c FROM {taken}))"


#: Sales, purchases and opposite cash, each of what the ones before leave.
TRADES = ",\n".join([
    ASKED, _traded("sold", "s", False), _left("after_sold", "s", "sold"), _traded("bought", "after_sold", True), _left("after_bought", "after_sold", "bought"),
    _walk("swapped", """SELECT x.k, x.tx_id AS a, y.tx_id AS c, coalesce(distance, 9223372036854775807) AS distance FROM after_bought x JOIN after_bought y ON x.k = y.k AND x.quantity = -y.quantity LEFT JOIN gap g ON g.a = x.tx_id AND g.c = y.tx_id
  WHERE x.quantity < 0 AND x.money AND y.money AND x.must_cash AND y.must_cash""", "distance, a, c"),
])


def _deposits(free: str) -> str:
    """Openers one after another; each takes the first free spending and the first free arrival of its amount within its span."""
    return f"""placed AS (
  SELECT r.*, concat_ws('|', user_id, broker, account) AS acc, o.ordinal, o.ordinal_span, o.label, len(list_filter(tx_types, lambda t: t IN ('TRANSFER', 'TRANSFER_EXTERNAL', 'TRANSFER_INTERNAL'))) AS transfers
  FROM {free} r LEFT JOIN refs o ON o.tx_id = r.tx_id WHERE money),
reach AS (
  SELECT a.acc, a.ordinal AS from_ordinal, a.tx_id AS opener, b.quantity < 0 AS spending, list(b.tx_id ORDER BY b.ordinal, b.tx_id) AS steps
  FROM placed a JOIN placed b ON a.acc = b.acc AND a.label = b.label AND b.ordinal > a.ordinal AND b.ordinal <= a.ordinal + a.ordinal_span AND abs(abs(b.quantity) - a.quantity) < 0.005
  WHERE a.quantity > 0 AND a.transfers = len(a.tx_types) AND NOT (b.quantity > 0 AND b.transfers = len(b.tx_types)) AND (b.may_cash OR b.transfers > 0) GROUP BY ALL),
openers AS (SELECT acc, opener, max(steps) FILTER (spending) AS spends, max(steps) FILTER (NOT spending) AS arrivals, row_number() OVER (PARTITION BY acc ORDER BY from_ordinal, opener) AS n FROM reach GROUP BY acc, opener, from_ordinal),
run_walk AS (
  SELECT DISTINCT acc, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS opener, CAST(NULL AS BIGINT) AS spend, CAST(NULL AS BIGINT) AS arrival FROM openers
  UNION ALL
  SELECT acc, n, list_concat(used, list_filter([spend, arrival], lambda x: x IS NOT NULL)), opener, spend, arrival
  FROM (SELECT w.acc, o.n, w.used, o.opener, list_filter(o.spends, lambda x: NOT list_contains(w.used, x))[1] AS spend, list_filter(o.arrivals, lambda x: NOT list_contains(w.used, x))[1] AS arrival
        FROM run_walk w JOIN openers o ON o.acc = w.acc AND o.n = w.n + 1)
), runs AS (SELECT opener, spend, arrival FROM run_walk WHERE spend IS NOT NULL OR arrival IS NOT NULL)"""


#: Postings that hold a token that others hold too, and those that point at one such set.
TOKENS = """said AS (SELECT e.*, t.user_id, t.broker FROM evidence e JOIN statements t ON t.tx_id = e.tx_id WHERE e.scope = 'BROKER'),
exact AS (SELECT tx_id, min(tx_id) OVER (PARTITION BY label, token, user_id, broker) AS anchor FROM said WHERE list_contains(matches, 'EXACT') QUALIFY count(*) OVER (PARTITION BY label, token, user_id, broker) > 1),
attached AS (
  SELECT p.tx_id, min(h.tx_id) AS anchor FROM said p JOIN said h ON h.label = p.label AND h.token = p.token AND h.user_id = p.user_id AND h.broker = p.broker AND h.tx_id <> p.tx_id AND list_contains(h.matches, 'EXACT')
  WHERE list_contains(p.matches, 'ATTACHES') GROUP BY ALL)"""
#: All seven rules in order. An account-day of the statements is one customer's, so no two purchases want one charge.
PARTITION = ",\n".join([
    TOKENS, TRADES.replace("FROM statements WHERE quantity <> 0", "FROM statements WHERE quantity <> 0 AND tx_id NOT IN (SELECT tx_id FROM exact)"), _left("after_trades", "after_bought", "swapped"), _deposits("after_trades"),
    """claimed AS (
  SELECT tx_id, anchor, 'exact' AS rule, NULL AS kind FROM exact
  UNION ALL SELECT unnest([a, c]), a, 'disposal', unnest(['TRADE_ASSET', 'TRADE_CASH']) FROM sold UNION ALL SELECT unnest([a, c]), a, 'acquisition', unnest(['TRADE_ASSET', 'TRADE_CASH']) FROM bought
  UNION ALL SELECT unnest([a, c]), a, 'cash_trade', 'TRADE_CASH' FROM swapped
  UNION ALL SELECT r.leg, opener, 'deposit_run', CASE WHEN p.transfers > 0 THEN 'TRANSFER' END FROM (SELECT opener, unnest([opener, spend, arrival]) AS leg FROM runs) r JOIN placed p ON p.tx_id = r.leg
), with_bearers AS (SELECT * FROM claimed UNION ALL SELECT a.tx_id, e.anchor, 'attaches', NULL FROM attached a JOIN exact e ON e.tx_id = a.anchor WHERE a.tx_id NOT IN (SELECT tx_id FROM claimed)
), charges AS (SELECT s.*, abs(quantity) AS amount FROM s WHERE len(list_filter(tx_types, lambda t: t NOT IN ('TRANSACTION_COST', 'HOLDING_COST'))) = 0 AND tx_id NOT IN (SELECT tx_id FROM with_bearers)
), owed AS (SELECT x.k, x.tx_id AS anchor, x.settlement_amount - coalesce(abs(y.quantity), 0) AS gap FROM s x LEFT JOIN bought b ON b.a = x.tx_id LEFT JOIN s y ON y.tx_id = b.c WHERE NOT x.money AND x.settlement_amount IS NOT NULL AND x.quantity > 0
), sums AS (
  SELECT anchor, 1 AS size, [a.tx_id] AS ids FROM owed g JOIN charges a USING (k) WHERE gap > 0 AND abs(gap - a.amount) < 0.005
  UNION ALL SELECT anchor, 2, [a.tx_id, b.tx_id] FROM owed g JOIN charges a USING (k) JOIN charges b USING (k) WHERE gap > 0 AND a.tx_id < b.tx_id AND abs(gap - a.amount - b.amount) < 0.005
  UNION ALL SELECT anchor, 3, [a.tx_id, b.tx_id, c.tx_id] FROM owed g JOIN charges a USING (k) JOIN charges b USING (k) JOIN charges c USING (k) WHERE gap > 0 AND a.tx_id < b.tx_id AND b.tx_id < c.tx_id AND abs(gap - a.amount - b.amount - c.amount) < 0.005
), best AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY size, ids) = 1
), all_claims AS (SELECT * FROM with_bearers UNION ALL SELECT unnest(ids), anchor, 'charge', NULL FROM best)""",
])
OWN_TYPE = "CASE WHEN len(tx_types) = 1 THEN tx_types[1] WHEN len(list_filter(tx_types, lambda t: t NOT IN ('INTEREST', 'DIVIDEND'))) = 0 THEN 'INCOME' ELSE 'AMBIGUOUS' END"


def _compared(name: str, role: str, hints: bool) -> str:
    """Verdicts of every answer, field by field, on the identifiers of ``role`` and, with ``hints``, on the stated currency and type."""
    plain = """SELECT key, plugin_id, 'Currency' AS field, want_currency AS hint, currency AS found, CASE WHEN want_currency = '' OR currency = '' THEN 'SILENT' WHEN lower(want_currency) = lower(currency) THEN 'AGREES' ELSE 'CONTRADICTS' END AS verdict FROM ans
  UNION ALL SELECT key, plugin_id, 'SecurityType', want_type, asset_class, CASE WHEN want_type IN ('', 'UNKNOWN') OR asset_class IN ('', 'UNKNOWN') THEN 'SILENT' WHEN lower(want_type) = lower(asset_class) THEN 'AGREES' ELSE 'CONTRADICTS' END FROM ans
  UNION ALL """
    return f"""{name} AS (
  {plain if hints else ""}SELECT a.key, plugin_id, 'Exchange' AS field, coalesce(first, '') AS hint, mic AS found, CASE WHEN op = '' OR doms IS NULL THEN 'SILENT' WHEN list_contains(doms, op) THEN 'AGREES' ELSE 'CONTRADICTS' END AS verdict
  FROM ans a LEFT JOIN (SELECT key, min_by(domain, place) AS first, list(dom) AS doms FROM hid WHERE role = '{role}' AND type = 'MIC_TICKER' AND dom <> '' GROUP BY key) t ON t.key = a.key
  UNION ALL SELECT key, plugin_id, type, value, coalesce(same, ''), CASE WHEN same IS NULL THEN 'SILENT' WHEN same = value THEN 'AGREES' ELSE 'CONTRADICTS' END
  FROM (SELECT a.key, a.plugin_id, h.type, h.value, (SELECT min_by(i.value, i.place) FROM aid i WHERE i.key = a.key AND i.plugin_id = a.plugin_id AND i.type = h.type AND i.dom = h.dom) AS same FROM ans a JOIN hid h ON h.key = a.key AND h.role = '{role}'))"""


def _filled_from(more: str) -> str:
    """Blanks of ``d`` filled from ``more``, if there is one."""
    mic = f"CASE WHEN d.mic = '' AND coalesce({more}.mic, '') <> '' AND (d.country = '' OR coalesce({more}.op_country, '') = '' OR lower(d.country) = {more}.op_country) THEN {more}.mic ELSE d.mic END"
    op = f"(SELECT lower(coalesce(max(operating_mic), '')) FROM venues q WHERE q.mic = {mic})"
    rest = ", ".join(f"CASE WHEN d.{c} = '' THEN coalesce({more}.{c}, '') ELSE d.{c} END AS {c}" for c in ("country", "name", "cik", "sic_code"))
    return f"{mic} AS mic, CASE WHEN d.currency = '' AND ({mic} = '' OR {op} = {more}.op) THEN coalesce({more}.currency, '') ELSE d.currency END AS currency, {rest}"


#: The answers of every key compared, a winner, those that can be of its instrument, and two steps of filling blanks.
ANSWERED = ",\n".join([
    """ans AS (
  SELECT a.* EXCLUDE (sic_code), coalesce(sic_code, '') AS sic_code, s.currency AS want_currency, s.security_type AS want_type, lower(coalesce(v.operating_mic, a.mic)) AS op, lower(a.country) AS cty, lower(v.country_code) AS op_country
  FROM answers a JOIN asked s ON s.key = a.key LEFT JOIN venues v ON v.mic = a.mic WHERE error IS NULL),
aid AS (SELECT i.* EXCLUDE (domain), coalesce(domain, '') AS domain, lower(CASE WHEN type = 'MIC_TICKER' THEN coalesce(operating_mic, domain, '') ELSE coalesce(domain, '') END) AS dom FROM answer_ids i LEFT JOIN venues v ON v.mic = i.domain WHERE type <> 'UNDERLYING'),
hid AS (SELECT i.* EXCLUDE (domain), coalesce(domain, '') AS domain, lower(CASE WHEN type = 'MIC_TICKER' THEN coalesce(operating_mic, domain, '') ELSE coalesce(domain, '') END) AS dom FROM asked_ids i LEFT JOIN venues v ON v.mic = i.domain)""",
    _compared("on_stated", "stated", True), _compared("on_proposed", "proposed", False),
    """tiers AS (
  SELECT a.key, a.plugin_id, precedence, CASE WHEN s.clear AND s.agrees THEN 0 WHEN s.clear AND p.clear AND p.agrees THEN 1 ELSE 2 END AS tier FROM ans a
  JOIN (SELECT key, plugin_id, bool_and(verdict <> 'CONTRADICTS') AS clear, bool_or(verdict = 'AGREES') AS agrees FROM on_stated GROUP BY ALL) s ON s.key = a.key AND s.plugin_id = a.plugin_id
  JOIN (SELECT key, plugin_id, bool_and(verdict <> 'CONTRADICTS') AS clear, bool_or(verdict = 'AGREES') AS agrees FROM on_proposed GROUP BY ALL) p ON p.key = a.key AND p.plugin_id = a.plugin_id
), winners AS (SELECT a.*, tier FROM tiers t JOIN ans a ON a.key = t.key AND a.plugin_id = t.plugin_id QUALIFY row_number() OVER (PARTITION BY t.key ORDER BY tier, t.precedence, t.plugin_id) = 1
), judged AS (
  SELECT o.*, o.plugin_id = w.plugin_id AS won, (w.cur2 = '' OR lower(o.currency) = '' OR w.cur2 = lower(o.currency))
    AND (o.op = '' OR (w.op = '' AND w.cty = '') OR CASE WHEN w.op <> '' THEN w.op = o.op ELSE coalesce(o.op_country, '') IN ('', w.cty) END)
    AND (w.op = '' OR (o.op = '' AND o.cty = '') OR CASE WHEN o.op <> '' THEN w.op = o.op ELSE coalesce(w.op_country, '') IN ('', o.cty) END)
    AND (w.cty = '' OR o.cty = '' OR w.cty = o.cty)
    AND NOT EXISTS (SELECT 1 FROM aid x JOIN aid y ON y.key = x.key AND y.type = x.type WHERE x.key = o.key AND x.plugin_id = o.plugin_id AND y.plugin_id = w.plugin_id
      AND ((x.type = 'MIC_TICKER' AND x.dom <> '' AND y.dom <> '' AND x.dom <> y.dom) OR (x.dom = y.dom AND x.value <> y.value))
      AND NOT EXISTS (SELECT 1 FROM aid z WHERE z.key = x.key AND z.plugin_id = w.plugin_id AND z.type = x.type AND z.dom = x.dom AND z.value = x.value)) AS fits
  FROM ans o JOIN (SELECT *, lower(currency) AS cur2 FROM winners) w ON w.key = o.key
), fills AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY precedence, plugin_id) AS n FROM judged WHERE fits AND NOT won
), once AS (SELECT d.key, d.plugin_id, d.tier, d.asset_class, """ + _filled_from("f") + """ FROM winners d LEFT JOIN fills f ON f.key = d.key AND f.n = 1
), twice AS (SELECT d.key, d.plugin_id, d.tier, d.asset_class, """ + _filled_from("f") + """ FROM once d LEFT JOIN fills f ON f.key = d.key AND f.n = 2
), merged_ids AS (SELECT i.key, i.type, i.domain, i.dom, i.value FROM aid i JOIN judged j ON j.key = i.key AND j.plugin_id = i.plugin_id WHERE fits OR won QUALIFY row_number() OVER (PARTITION BY i.key, i.type ORDER BY j.precedence, j.plugin_id, i.place) = 1
), agreed AS (
  SELECT t.key, 'Currency' AS field FROM twice t JOIN asked s ON s.key = t.key WHERE t.currency <> '' AND lower(s.currency) = lower(t.currency)
  UNION ALL SELECT t.key, 'SecurityType' FROM twice t JOIN asked s ON s.key = t.key WHERE s.security_type NOT IN ('', 'UNKNOWN') AND lower(s.security_type) = lower(t.asset_class)
  UNION ALL SELECT DISTINCT t.key, 'Exchange' FROM twice t JOIN hid h ON h.key = t.key AND role = 'stated' AND h.type = 'MIC_TICKER' AND h.dom <> '' LEFT JOIN venues v ON v.mic = t.mic WHERE h.dom = lower(coalesce(operating_mic, t.mic))
  UNION ALL SELECT h.key, h.type FROM hid h JOIN merged_ids m ON m.key = h.key AND m.type = h.type AND m.dom = h.dom AND m.value = h.value WHERE role = 'stated'
), failed AS (SELECT key, bool_or(error = 'TIMEOUT') AS late, bool_or(error <> 'NOT_IDENTIFIED') AS odd FROM answers GROUP BY ALL)""",
])


#: Bars with what the import of e5 finds wrong with them.
SPOILT = """spoilt AS (SELECT p.*, b.identifier_type, b.domain, b.value, i.asset_class, i.currency, day(price_date) = 13 AS bad_day, CAST(close AS VARCHAR) LIKE '%1.00' AS bad_close, CAST(close AS VARCHAR) LIKE '%2.00' AS bad_volume, i.currency = 'EUR' AS bad_name
  FROM bars p JOIN best b ON b.instrument_id = p.instrument_id JOIN instruments i ON i.instrument_id = p.instrument_id)"""
#: Pairs of cells under their headers; days by the layouts that the cells have.
SHEETS = """heads AS (SELECT sheet, place, string_split(cell, '|') AS h FROM sheet_cells WHERE row = 0 AND cell <> ''),
sheet_rows AS (
  SELECT d.sheet, d.row, d.place, h, TRY_CAST(c.cell AS DECIMAL(38,18)) AS close,
         CASE WHEN regexp_matches(trim(d.cell), '^[0-9]{4}-') THEN CAST(trim(d.cell)[1:10] AS DATE) WHEN d.cell LIKE '%/%/%' THEN CAST(strptime(d.cell, '%d/%m/%Y') AS DATE)
              WHEN TRY_CAST(d.cell AS DOUBLE) > 1 THEN CAST(DATE '1899-12-30' + CAST(floor(TRY_CAST(d.cell AS DOUBLE)) AS INTEGER) AS DATE) END AS day
  FROM sheet_cells d JOIN sheet_cells c ON c.sheet = d.sheet AND c.row = d.row AND c.place = d.place + 1 JOIN heads k ON k.sheet = d.sheet AND k.place = d.place
  WHERE d.row > 0 AND d.place % 2 = 0 AND len(h) = 4 AND d.cell NOT IN ('', 'Date') AND c.cell <> '' AND d.cell NOT LIKE '#%' AND c.cell NOT LIKE '#%')"""


#: By query: the views it needs, its steps and its last statement.
PARTS: dict[str, tuple[str, list[str], str]] = {
    "a1_holdings": ("instruments postings splits", [ADJUSTED], f"SELECT user_id, broker, account, instrument_id, coalesce(name, max(description)) AS name, {shown('sum(own)', 'quantity')} FROM adjusted LEFT JOIN (SELECT instrument_id, name FROM instruments) USING (instrument_id) WHERE account_type = 'USER' AND order_date <= DATE '{AS_OF}' GROUP BY user_id, broker, account, instrument_id, name {OPEN}"),
    "a2_portfolio_holdings": ("instruments postings splits filters", [ADJUSTED, MEMBERS], f"SELECT portfolio_id, broker, account, instrument_id, coalesce(name, max(description)) AS name, {shown('sum(own)', 'quantity')} FROM members LEFT JOIN (SELECT instrument_id, name FROM instruments) USING (instrument_id) WHERE account_type = 'USER' AND order_date <= DATE '{AS_OF}' GROUP BY portfolio_id, broker, account, instrument_id, name {OPEN}"),
    "a4_residual_balances": ("instruments postings splits matches", [ADJUSTED, SIDES, BALANCES], f"SELECT * EXCLUDE (balance), {shown('balance', 'balance')} FROM balances"),
    "a5_residual_counts": ("instruments postings splits matches", [ADJUSTED, SIDES, BALANCES], "SELECT user_id, count(*) AS n_balances, count(*) FILTER (newest < DATE '2000-01-01') AS n_stale, count(*) FILTER (account_type = 'IMBALANCE') AS n_imbalance FROM balances WHERE account_type <> 'SOURCE_ROUNDING' GROUP BY ALL"),
    "a10_unbalanced_groups": ("instruments postings", [WEIGHTED], f"SELECT group_id, commodity, {shown('sum(weight)', 'imbalance')} FROM weighted WHERE account_type = 'USER' GROUP BY ALL HAVING sum(weight) <> 0"),
    "a13_held_event_instruments": ("instruments postings", [FIRST_HELD], "SELECT * FROM first_held"),
    "a15_group_timestamps": ("postings", [], "SELECT group_id, min(order_date) AS timestamp FROM postings GROUP BY ALL"),
    "w1_daily_positions": ("instruments postings splits matches", [ADJUSTED, SIDES, USER_SOURCE, WINDOW, POSITIONS], f"SELECT * EXCLUDE (quantity), {shown('quantity', 'quantity')} FROM positions"),
    "r2_subtract_ranges": ("postings coverage", [held(False)], less("SELECT * FROM held", "SELECT instrument_id, covered_from AS from_date, covered_before AS before_date FROM coverage WHERE plugin_id = 'feed'", "instrument_id")),
    "r3_coverage_upsert": ("coverage", [], f"SELECT *, covered_from AS last_fetched_at FROM ({islands(days('SELECT * FROM coverage', 'instrument_id, plugin_id', 'covered_from', 'covered_before'), 'instrument_id, plugin_id', 'covered_from', 'covered_before')})"),
    "r4_held_ranges": ("postings", [held(True)], "SELECT * FROM held"),
    "r5_price_gaps": ("postings coverage", [held(True), COVERED], less("SELECT * FROM held", "SELECT * FROM covered", "instrument_id")),
    "r6_fx_gaps": ("postings coverage instruments users identifiers", [held(True), COVERED, NEEDS], less("SELECT instrument_id, from_date, before_date FROM pairs", "SELECT * FROM covered", "instrument_id")),
    "r7_merged_coverage": ("coverage", [COVERED], "SELECT * FROM covered"),
    "r8_supplied_spans": ("bars", [], islands("SELECT DISTINCT instrument_id, price_date AS day FROM bars", "instrument_id")),
    "r9_event_gaps": ("postings instruments coverage", [FIRST_HELD, COVERED], less(f"SELECT instrument_id, first_date AS from_date, DATE '{TODAY}' AS before_date FROM first_held", "SELECT * FROM covered", "instrument_id")),
    "r10_inflation_gap": ("inflation", [], f"SELECT currency, min(month) AS from_date, CAST(date_trunc('month', DATE '{TODAY}') AS DATE) AS before_date FROM (SELECT DISTINCT currency, CAST(unnest(generate_series(DATE '1995-01-01', DATE '{TODAY}' - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month FROM inflation EXCEPT SELECT currency, month FROM inflation) GROUP BY ALL"),
    "r11_gap_listing": ("postings coverage instruments identifiers", [held(True).replace(TODAY, "2002-06-30"), COVERED, PRICE_NAMES, f"gaps AS ({less('SELECT * FROM held', 'SELECT * FROM covered', 'instrument_id')})"], f"SELECT g.instrument_id, from_date, least(before_date, DATE '{TODAY}') AS before_date, asset_class, identifier_type, value FROM gaps g JOIN instruments i USING (instrument_id) JOIN (SELECT * FROM ranked WHERE r < 99 QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY r, coalesce(domain, ''), value) = 1) b USING (instrument_id) WHERE from_date < least(before_date, DATE '{TODAY}') AND asset_class IN ('STOCK', 'ETF')"),
    "r12_plugin_outstanding": ("postings coverage", [held(True), f"eod AS ({merged(chr(39).join(['SELECT instrument_id, covered_from AS from_date, covered_before AS before_date FROM coverage WHERE plugin_id = ', 'eod', '']), 'instrument_id')})", f"gaps AS ({less('SELECT * FROM held', 'SELECT * FROM eod', 'instrument_id')})", "gap_of AS (SELECT g.*, plugin_id FROM gaps g CROSS JOIN (SELECT DISTINCT plugin_id FROM coverage))", f"outstanding AS ({less('SELECT * FROM gap_of', 'SELECT instrument_id, plugin_id, covered_from AS from_date, covered_before AS before_date FROM coverage', 'instrument_id, plugin_id')})"], f"SELECT instrument_id, plugin_id, from_date, least(before_date, DATE '{CUTOFF}') AS before_date, false AS reachable FROM outstanding WHERE from_date < DATE '{CUTOFF}' UNION ALL SELECT instrument_id, plugin_id, greatest(from_date, DATE '{CUTOFF}'), before_date, true FROM outstanding WHERE before_date > DATE '{CUTOFF}'"),
    "r13_identifier_overlaps": ("identifiers", ["n AS (SELECT row_number() OVER () AS k, identifier_type, coalesce(domain, '') AS domain, value, coalesce(valid_from, DATE '0001-01-01') AS a, coalesce(valid_before, DATE '9999-12-31') AS b FROM identifiers)"], "SELECT DISTINCT x.identifier_type, x.domain, x.value FROM n x JOIN n y ON x.identifier_type = y.identifier_type AND x.domain = y.domain AND x.value = y.value AND x.k < y.k AND x.a < y.b AND y.a < x.b"),
    "r15_chunked_ranges": ("coverage", [COVERED], "SELECT instrument_id, CAST(c AS DATE) AS from_date, least(CAST(c + INTERVAL 365 DAY AS DATE), before_date) AS before_date FROM (SELECT *, unnest(generate_series(from_date, before_date - INTERVAL 1 DAY, INTERVAL 365 DAY)) AS c FROM covered)"),
    "c1_split_spans": ("instruments splits", [EFFECTIVE, "edges AS (SELECT DISTINCT instrument_id, ex_date FROM effective)"], "SELECT e.instrument_id, coalesce((SELECT max(x.ex_date) FROM edges x WHERE x.instrument_id = e.instrument_id AND x.ex_date < e.ex_date), DATE '0001-01-01') AS basis_from, e.ex_date AS basis_before, CAST(product(s.split_to * CASE WHEN s.split_to % 1 <> 0 OR s.split_from % 1 <> 0 THEN 10 ELSE 1 END) AS BIGINT) AS num, CAST(product(s.split_from * CASE WHEN s.split_to % 1 <> 0 OR s.split_from % 1 <> 0 THEN 10 ELSE 1 END) AS BIGINT) AS den FROM edges e JOIN effective s ON s.instrument_id = e.instrument_id AND s.ex_date >= e.ex_date GROUP BY e.instrument_id, e.ex_date"),
    "c2_adjusted_postings": ("instruments postings splits", [ADJUSTED], f"SELECT tx_id, instrument_id, {shown('own', 'split_adjusted_quantity')}, {shown('own_price', 'split_adjusted_unit_price')} FROM adjusted"),
    "c3_adjusted_bars": ("instruments bars splits", [BARS], f"SELECT instrument_id, price_date, {shown('close', 'close')}, {shown('own_close', 'split_adjusted_close')} FROM adjusted_bars"),
    "c6_pending_option_splits": ("instruments splits postings identifiers", [PENDING], f"SELECT instrument_id, ex_date, {shown('split_from', 'split_from')}, {shown('split_to', 'split_to')} FROM pending"),
    "c8_restated_options": ("instruments splits postings identifiers", [PENDING, RESTATED], f"SELECT instrument_id, valid_from, valid_before, {shown('moved_strike', 'strike')}, symbol FROM named"),
    "c9_option_symbols": ("instruments", [f"named AS (SELECT *, {_symbol('strike')} AS symbol FROM instruments WHERE asset_class = 'OPTION')"], f"SELECT instrument_id, symbol, rpad('U' || CAST(underlying_id AS VARCHAR), 6, ' ') || right(symbol, 15) AS padded, CASE WHEN symbol IS NOT NULL THEN 'U' || CAST(underlying_id AS VARCHAR) END AS root, CASE WHEN symbol IS NOT NULL THEN expiry END AS expiry, CASE WHEN symbol IS NOT NULL THEN put_call END AS put_call, {shown('CASE WHEN symbol IS NOT NULL THEN strike END', 'strike')} FROM named"),
    "c11_unhandled_splits": ("splits", [], f"SELECT instrument_id, ex_date, {shown('split_from', 'split_from')}, {shown('split_to', 'split_to')}, CASE WHEN split_to < split_from THEN 'REVERSE_SPLIT' ELSE 'NON_WHOLE_SPLIT' END AS event_type FROM splits WHERE NOT ({WHOLE})"),
    "c11_special_dividends": ("dividends", [], """SELECT instrument_id, ex_date, 'SPECIAL_CASH_DIVIDEND' AS event_type, 'special dividend of ' || amount || ' USD, told by eod' AS detail,
    '{"amount":"' || amount || '","currency":"USD",' || CASE WHEN pay_date IS NULL THEN '' ELSE '"pay_date":"' || pay_date || '",' END || '"dividend_type":"SC","data_provider":"eod"}' AS data FROM dividends WHERE dividend_type = 'SC'"""),
    "c11_stored_dividends": ("dividends", [], f"SELECT * EXCLUDE (amount), {shown('amount', 'amount')} FROM dividends WHERE dividend_type IS NULL OR dividend_type <> 'SC'"),
    "c12_instruments_with_splits": ("instruments splits", [EFFECTIVE], "SELECT DISTINCT instrument_id FROM effective"),
    "p1_portfolio_members": ("instruments postings splits filters", [ADJUSTED, MEMBERS], "SELECT portfolio_id, tx_id FROM members"),
    "p2_in_flight": ("instruments postings splits filters matches", [ADJUSTED, MEMBERS, SIDES, FLIGHT], "SELECT * FROM flight"),
    "p3_portfolio_external_flows": ("instruments postings splits filters matches", [ADJUSTED, MEMBERS, SIDES, FLIGHT, f"""touched AS (SELECT DISTINCT portfolio_id, group_id FROM members WHERE account_type = 'USER'),
legs AS (SELECT t.portfolio_id, p.* FROM adjusted p JOIN touched t USING (group_id) WHERE order_date >= DATE '{FLOW_START}' AND order_date < DATE '{FLOW_BEFORE}')"""], f"SELECT portfolio_id, order_date AS flow_date, instrument_id, {shown('-sum(own)', 'amount')} FROM legs l WHERE account_type = 'EQUITY' OR account_type = 'USER' AND NOT EXISTS (SELECT 1 FROM members m WHERE m.portfolio_id = l.portfolio_id AND m.tx_id = l.tx_id) OR account_type = 'TRANSFER_CLEARING' AND NOT EXISTS (SELECT 1 FROM flight f WHERE f.portfolio_id = l.portfolio_id AND f.tx_id = l.tx_id) GROUP BY ALL {OPEN}"),
    "p4_user_external_flows": ("instruments postings splits matches", [ADJUSTED, SIDES], f"SELECT user_id, order_date AS flow_date, instrument_id, {shown('-sum(own)', 'amount')} FROM adjusted p WHERE order_date >= DATE '{FLOW_START}' AND order_date < DATE '{FLOW_BEFORE}' AND (account_type = 'EQUITY' OR account_type = 'TRANSFER_CLEARING' AND {UNMATCHED}) GROUP BY ALL {OPEN}"),
    "p5_principal_legs": ("postings", ["""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY account_type <> 'USER', CASE tx_type WHEN 'TRADE_ASSET' THEN 1 WHEN 'DIVIDEND' THEN 3 WHEN 'TRANSFER_INTERNAL' THEN 4 WHEN 'TRANSACTION_COST' THEN 5 WHEN 'TRADE_CASH' THEN 6 ELSE 9 END, abs(quantity) DESC, tx_id) AS first,
         CASE tx_type WHEN 'TRADE_CASH' THEN 1 WHEN 'TRADE_ASSET' THEN 2 WHEN 'DIVIDEND' THEN 3 WHEN 'TRANSFER_INTERNAL' THEN 4 WHEN 'TRANSACTION_COST' THEN 5 ELSE 8 END AS leg FROM postings)"""], "SELECT group_id, tx_id, tx_type, account_type, CAST(CASE WHEN first = 1 THEN 1 ELSE 1 + row_number() OVER (PARTITION BY group_id, first = 1 ORDER BY account_type IN ('TRANSFER_CLEARING', 'IMBALANCE', 'SOURCE_ROUNDING'), leg, abs(quantity) DESC, tx_id) END AS INTEGER) AS leg_rank FROM ranked"),
    "p6_residual_ages": ("instruments postings splits matches", [ADJUSTED, SIDES, BALANCES], "SELECT broker, CASE WHEN DATE '2001-11-10' - oldest >= 30 THEN 'loud' WHEN DATE '2001-11-10' - oldest >= 7 THEN 'stale' ELSE 'fresh' END AS age, count(*) AS n FROM balances GROUP BY ALL"),
    "p7_residual_exposure": ("instruments postings splits matches", [ADJUSTED, SIDES, BALANCES, EXPOSURE], f"SELECT broker, instrument_id, {shown('total', 'total')}, row_rank, broker_rank FROM exposure"),
    "v1_valuation_usd": ("instruments postings splits matches bars coverage identifiers", [ADJUSTED, SIDES, USER_SOURCE, FILLED.replace(EFFECTIVE + ", ", ""), POSITIONS, priced("USD")], "SELECT * FROM totals"),
    "v2_valuation_gbp": ("instruments postings splits matches bars coverage identifiers", [ADJUSTED, SIDES, USER_SOURCE, FILLED.replace(EFFECTIVE + ", ", ""), POSITIONS, priced("GBP")], "SELECT * FROM totals"),
    "v3_valuation_portfolios": ("instruments postings splits matches bars coverage identifiers filters", [ADJUSTED, SIDES, MEMBERS, FLIGHT, PORTFOLIO_SOURCE, FILLED.replace(EFFECTIVE + ", ", ""), POSITIONS, priced("USD")], "SELECT * FROM totals"),
    "v11_filled_prices": ("instruments splits bars coverage", [FILLED], f"SELECT instrument_id, day, {shown('close', 'close')}, {shown('own_close', 'split_adjusted_close')} FROM filled WHERE instrument_id IN (SELECT instrument_id FROM instruments)"),
    "v18_percent_change": ("instruments postings splits matches bars coverage identifiers", [ADJUSTED, SIDES, USER_SOURCE, FILLED.replace(EFFECTIVE + ", ", ""), POSITIONS, priced("USD"), "ends AS (SELECT scope_id, arg_min(total_value, val_date) AS a, arg_max(total_value, val_date) AS b, count(*) AS n FROM totals GROUP BY ALL)"], "SELECT scope_id, CASE WHEN n >= 2 AND a <> 0 THEN round((b - a) / a * 100, 4) END AS percent_change FROM ends"),
    "v19_derived_pair": ("bars", [], f"SELECT CAST(-3 AS BIGINT) AS instrument_id, price_date, {shown('close * 0.01', 'close')} FROM bars WHERE instrument_id = -2"),
    "b1_weights": ("instruments postings", [WEIGHTED], f"SELECT tx_id, {shown('weight', 'weight')}, commodity FROM weighted"),
    "b4_boundary_legs": ("instruments postings", [WEIGHTED], f"SELECT group_id, tx_id, account_type, {shown('amount', 'amount')}, commodity FROM edges"),
    "b5_group_residuals": ("instruments postings stated_prices", [WEIGHTED.replace("2 AS price_scale FROM postings p", "len(split_part(p.price, '.', 2)) AS price_scale FROM (SELECT t.* EXCLUDE (unit_price), CAST(trim(s.price) AS DECIMAL(18,6)) AS unit_price, s.price FROM postings t LEFT JOIN stated_prices s USING (tx_id)) p")], f"SELECT group_id, commodity, {shown('residual', 'residual')}, {shown('rounding', 'rounding')}, transfers FROM residuals JOIN moves USING (group_id)"),
    "b6_residual_legs": ("instruments postings", [WEIGHTED], f"SELECT group_id, commodity, account_type, {shown('amount', 'amount')} FROM closing"),
    "b8_settled_balance": ("instruments postings", [WEIGHTED], f"SELECT group_id, commodity, {shown('sum(amount)', 'left_over')}, count(*) AS n_legs FROM (SELECT group_id, commodity, weight AS amount FROM weighted WHERE account_type = 'USER' UNION ALL SELECT group_id, commodity, amount FROM edges UNION ALL SELECT group_id, commodity, amount FROM closing) GROUP BY ALL"),
    "b9_replace_by_period": ("postings", ["mine AS (SELECT * FROM postings WHERE user_id = 7 AND broker = 'IBKR' AND order_date >= DATE '1996-01-01' AND order_date < DATE '1999-01-01' AND account_type = 'USER')"], f"SELECT tx_id, user_id, broker, account, order_date, account_type, group_id, {shown('quantity', 'quantity')} FROM postings WHERE tx_id NOT IN (SELECT tx_id FROM mine) AND NOT (group_id IN (SELECT group_id FROM mine) AND account_type IN ('TRANSFER_CLEARING', 'IMBALANCE', 'SOURCE_ROUNDING', 'INCOME', 'EXPENSE')) UNION ALL SELECT tx_id, user_id, broker, account, order_date, account_type, group_id, {shown('quantity * 2', 'quantity')} FROM mine"),
    "b9_changed_postings": ("instruments postings windows", [UPLOADED], f"""SELECT 'removed' AS change, tx_id, group_id, {shown('quantity', 'quantity')} FROM ledger l WHERE tx_id IN (SELECT tx_id FROM inside UNION SELECT tx_id FROM placed WHERE NOT fresh AND to_group < 0)
  UNION ALL SELECT 'added', tx_id, to_group, {shown('quantity', 'quantity')} FROM placed WHERE to_group < 0"""),
    "b9_changed_groups": ("postings windows", [UPLOADED], _both("SELECT group_id, user_id, min(order_date) AS timestamp FROM ledger WHERE group_id IN (SELECT group_id FROM touched) GROUP BY ALL", "SELECT group_id, user_id, min(order_date) AS timestamp FROM settled_rows GROUP BY ALL")),
    "b9_changed_matches": ("postings windows matches", [UPLOADED], "SELECT DISTINCT 'removed' AS change, user_id, from_group_id, to_group_id, instrument_id FROM matches WHERE from_group_id IN (SELECT group_id FROM touched) OR to_group_id IN (SELECT group_id FROM touched)"),
    "b9_changed_legs": ("instruments postings windows", [UPLOADED, WEIGHTED.replace("FROM postings", "FROM settled_rows").replace("THEN 'SOURCE_ROUNDING'", "AND group_id NOT IN (SELECT group_id FROM lost) THEN 'SOURCE_ROUNDING'"),
        WEIGHTED.split("), edges AS")[0].replace("valued AS", "stored_valued AS").replace("FROM valued", "FROM stored_valued").replace("weighted AS", "stored AS") + ")"],
        _both(f"SELECT group_id, CAST(NULL AS BIGINT) AS of_tx, account_type, commodity, {shown('weight', 'amount')} FROM stored WHERE account_type IN ('TRANSFER_CLEARING', 'IMBALANCE') AND group_id IN (SELECT group_id FROM touched)",
              f"SELECT group_id, tx_id, account_type, commodity, {shown('amount', 'amount')} FROM edges UNION ALL SELECT group_id, NULL, account_type, commodity, {shown('amount', 'amount')} FROM closing")),
    "b10_class_compatibility": ("instruments", ["classes AS (SELECT DISTINCT asset_class AS c FROM instruments UNION ALL SELECT 'UNKNOWN')"], "SELECT a.c AS implied, b.c AS found, CASE WHEN b.c = 'UNKNOWN' THEN true WHEN a.c = 'UNKNOWN' THEN b.c <> 'CASH' ELSE a.c = b.c OR (a.c = 'ETF' AND b.c IN ('STOCK', 'MUTUAL_FUND')) OR (b.c = 'ETF' AND a.c IN ('STOCK', 'MUTUAL_FUND')) END AS compatible FROM classes a CROSS JOIN classes b"),
    "b11_posting_errors": ("postings", [], "SELECT tx_id, 'description is missing' AS error FROM postings WHERE description = 'PART ' || CAST(user_id % 50 AS VARCHAR) UNION ALL SELECT tx_id, 'settlement_amount without a trade' FROM postings WHERE tx_id % 3 = 0 AND tx_type <> 'TRADE_ASSET' UNION ALL SELECT tx_id, 'settlement_amount is negative' FROM postings WHERE tx_id % 3 = 0 AND settlement_amount < 0"),
    "b12_type_predicates": ("postings", ["sets AS (SELECT group_id, list_sort(list(DISTINCT tx_type)) AS t FROM postings GROUP BY ALL)"], "SELECT group_id, array_to_string(t, ',') AS tx_types, CASE WHEN len(t) = 1 THEN t[1] WHEN t = ['TRADE_ASSET', 'TRADE_CASH'] THEN 'TRADE' ELSE 'AMBIGUOUS' END AS resolved, len(list_filter(t, lambda x: x NOT LIKE 'TRADE%')) = 0 AS must_be_trade, list_contains(t, 'TRADE_ASSET') AS may_be_trade_asset, true AS antichain FROM sets"),
    "d1_declaration_kinds": ("declarations", [], f"SELECT * EXCLUDE (declared_qty), {shown('declared_qty', 'declared_qty')}, CASE WHEN as_of_date = min(as_of_date) OVER (PARTITION BY user_id, broker, account, instrument_id) THEN 'PAD' ELSE 'ASSERT' END AS kind FROM declarations"),
    "d3_declaration_checks": ("declarations instruments splits", ["declared AS (SELECT * FROM declarations)", CHECKED], f"SELECT user_id, broker, account, instrument_id, as_of_date, {shown('declared_qty', 'declared_qty')}, kind, {shown('computed', 'computed')}, {shown('computed - declared_qty', 'delta')}, n_postings, kind = 'PAD' OR abs(computed - declared_qty) <= inexact * CAST('0.000000000001' AS DECIMAL(13,12)) AS matched FROM checked"),
    "d4_opening_pads": ("declarations instruments splits", ["declared AS (SELECT * FROM declarations WHERE as_of_date >= DATE '1995-01-01')", CHECKED, "pads AS (SELECT *, computed - declared_qty AS delta FROM checked WHERE kind = 'PAD')"], f"SELECT user_id, broker, account, instrument_id, DATE '1995-01-01' AS order_date, 'USER' AS account_type, {shown('-delta', 'quantity')} FROM pads UNION ALL SELECT user_id, broker, account, instrument_id, DATE '1995-01-01', 'EQUITY', {shown('delta', 'quantity')} FROM pads"),
    "i1_find_by_identifier": ("identifiers", [], "SELECT identifier_type, coalesce(domain, '') AS domain, value, instrument_id FROM identifiers QUALIFY row_number() OVER (PARTITION BY identifier_type, coalesce(domain, ''), value ORDER BY valid_before DESC NULLS FIRST, instrument_id) = 1"),
    "i2_find_unambiguous": ("identifiers", [f"plain AS (SELECT identifier_type, {PLAIN} AS value, instrument_id FROM identifiers)"], "SELECT identifier_type, value, CASE WHEN min(instrument_id) = max(instrument_id) THEN min(instrument_id) END AS instrument_id FROM plain WHERE identifier_type IN ('OPENFIGI_TICKER', 'MIC_TICKER') GROUP BY identifier_type, value"),
    "i3_described_only": ("instruments identifiers", [], "SELECT instrument_id, name FROM instruments WHERE instrument_id NOT IN (SELECT instrument_id FROM identifiers WHERE canonical)"),
    "i4_best_identifier": ("identifiers", [BEST], "SELECT * FROM best"),
    "i5_display_names": ("instruments identifiers", [SHOWN_NAMES], "SELECT i.instrument_id, coalesce(b.value, nullif(i.name, ''), CAST(i.instrument_id AS VARCHAR)) AS display_name, coalesce(f.domain, '') AS exchange FROM instruments i LEFT JOIN (SELECT instrument_id, value FROM ranked WHERE r < 99 QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY r, coalesce(domain, ''), value) = 1) b USING (instrument_id) LEFT JOIN (SELECT instrument_id, min(domain) AS domain FROM ranked WHERE identifier_type = 'OPENFIGI_TICKER' AND domain <> '' GROUP BY ALL) f USING (instrument_id)"),
    "i6_merge_instruments": ("instruments identifiers postings", [WEIGHTED, MERGE], f"SELECT coalesce(survivor_id, p.instrument_id) AS instrument_id, CASE WHEN commodity = 'inst:' || p.instrument_id THEN 'inst:' || coalesce(survivor_id, p.instrument_id) ELSE commodity END AS commodity, count(*) AS n, {shown('sum(quantity)', 'quantity')} FROM weighted p LEFT JOIN mapping m ON m.instrument_id = p.instrument_id WHERE p.instrument_id IS NOT NULL GROUP BY 1, 2"),
    "i6_merged_names": ("instruments identifiers", [MERGE, """placed AS (SELECT d.* EXCLUDE (instrument_id), coalesce(survivor_id, d.instrument_id) AS owner, d.instrument_id AS giver, coalesce(d.domain, '') AS dom, coalesce(valid_from, DATE '0001-01-01') AS a, coalesce(valid_before, DATE '9999-12-31') AS b FROM identifiers d LEFT JOIN mapping m ON m.instrument_id = d.instrument_id)"""],
        "SELECT owner AS instrument_id, identifier_type, domain, value, canonical, valid_from, valid_before FROM placed p WHERE NOT EXISTS (SELECT 1 FROM placed q WHERE q.owner = p.owner AND q.identifier_type = p.identifier_type AND q.dom = p.dom AND q.value = p.value AND q.a < p.b AND p.a < q.b AND (q.giver <> q.owner, q.giver, q.a, q.b) < (p.giver <> p.owner, p.giver, p.a, p.b))"),
    "i6_merged_matches": ("instruments identifiers postings matches", [MERGE, "moved AS (SELECT user_id, from_group_id, to_group_id, coalesce(survivor_id, t.instrument_id) AS instrument_id FROM matches t LEFT JOIN mapping m ON m.instrument_id = t.instrument_id)"],
        "SELECT *, false AS conflict FROM moved UNION ALL SELECT *, true FROM (SELECT DISTINCT * FROM moved a WHERE (SELECT count(*) FROM moved b WHERE b.from_group_id = a.from_group_id AND b.instrument_id = a.instrument_id) > 1 OR (SELECT count(*) FROM moved b WHERE b.to_group_id = a.to_group_id AND b.instrument_id = a.instrument_id) > 1)"),
    "i6_merged_instruments": ("instruments identifiers", [MERGE], "SELECT i.instrument_id, name, coalesce(u.survivor_id, underlying_id) AS underlying_id FROM instruments i LEFT JOIN mapping u ON u.instrument_id = i.underlying_id WHERE NOT EXISTS (SELECT 1 FROM mapping m WHERE m.instrument_id = i.instrument_id AND m.survivor_id <> m.instrument_id)"),
    "i9_outcomes": ("asked asked_ids answers answer_ids venues", [ANSWERED], "SELECT key, plugin_id, CASE WHEN won THEN 'WON' WHEN fits THEN 'SUPERSEDED' ELSE 'DISCARDED' END AS outcome FROM judged"),
    "i9_resolved": ("asked asked_ids answers answer_ids venues", [ANSWERED], RESOLUTION),
    "i10_proposals": ("asked asked_ids answers answer_ids venues", [ANSWERED, f"settled AS ({RESOLUTION})", "said AS (SELECT key, type, coalesce(domain, '') AS domain, value FROM asked_ids WHERE role = 'proposed' UNION ALL SELECT key, 'CURRENCY', '', currency FROM asked WHERE currency <> '' UNION ALL SELECT key, 'ISIN', '', 'i' || key FROM asked)",
        """known AS (SELECT p.*, s.plugin_id, lower(s.currency) AS cur, lower(coalesce((SELECT operating_mic FROM venues WHERE mic = p.domain), p.domain)) AS there, lower(coalesce((SELECT operating_mic FROM venues WHERE mic = s.mic), s.mic)) AS here,
          (SELECT lower(value) FROM merged_ids m WHERE m.key = p.key AND m.type = p.type AND m.value <> '') AS held FROM said p JOIN settled s ON s.key = p.key)"""], """SELECT key, type, domain, value, CASE WHEN plugin_id IS NULL THEN 'UNUSED' WHEN type = 'CURRENCY' AND cur = '' THEN 'UNTESTED' WHEN type = 'CURRENCY' AND cur = lower(value) THEN 'CONFIRMED' WHEN type = 'CURRENCY' THEN 'CONTRADICTED'
    WHEN held <> lower(value) OR (there <> '' AND here <> '' AND there <> here) THEN 'CONTRADICTED' WHEN held IS NULL THEN 'UNTESTED' ELSE 'CONFIRMED' END AS outcome FROM known"""),
    "i10_hint_verdicts": ("asked asked_ids answers answer_ids venues", [ANSWERED], "SELECT * FROM on_stated"),
    "i7_shared_identifiers": ("identifiers", ["shared AS (SELECT instrument_id AS b, min(instrument_id) OVER (PARTITION BY identifier_type, coalesce(domain, ''), value) AS a FROM identifiers WHERE identifier_type IN ('OPENFIGI_TICKER', 'ISIN'))"], "SELECT DISTINCT a, b FROM shared WHERE a <> b"),
    "i8_isin_check": ("identifiers", ["digits AS (SELECT instrument_id, value, reverse('3028' || substr(value, 3)) AS d FROM identifiers WHERE identifier_type = 'ISIN')", "sums AS (SELECT *, list_sum(list_transform(generate_series(1, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(d, CAST(i AS INTEGER), 1) AS INTEGER) * 2 - CASE WHEN CAST(substr(d, CAST(i AS INTEGER), 1) AS INTEGER) > 4 THEN 9 ELSE 0 END ELSE CAST(substr(d, CAST(i AS INTEGER), 1) AS INTEGER) END)) AS total FROM digits)"], "SELECT instrument_id, value, total % 10 = 0 AND length(value) = 12 AS valid FROM sums"),
    "i14_plugin_order": (None, [], "SELECT s_name AS plugin_id, CAST(row_number() OVER (ORDER BY CASE s_suppkey WHEN 7 THEN 1 WHEN 3 THEN 2 ELSE 3 END, s_nationkey, s_name) AS INTEGER) AS precedence FROM supplier"),
    "i13_eligible_plugins": ("plugins instruments", [], "SELECT plugin_id, instrument_id FROM plugins CROSS JOIN instruments WHERE (asset_classes = [''] OR coalesce(asset_class, '') = '' OR list_contains(asset_classes, asset_class)) AND (exchanges = [''] OR coalesce(exchange_mic, '') = '' OR list_contains(exchanges, exchange_mic)) AND (currencies = [''] OR coalesce(currency, '') = '' OR list_contains(currencies, upper(currency)))"),
    "i13_supported_identifiers": ("plugins identifiers", [], "SELECT plugin_id, instrument_id, identifier_type, value, valid_from FROM plugins CROSS JOIN identifiers WHERE CASE WHEN asset_classes = ['OPTION'] THEN identifier_type = 'OCC' ELSE identifier_type IN ('ISIN', 'MIC_TICKER') END"),
    "i15_export_closure": ("instruments postings", ["chosen AS (SELECT DISTINCT instrument_id FROM postings WHERE instrument_id IS NOT NULL)"], "SELECT instrument_id, name, asset_class, underlying_id FROM instruments WHERE instrument_id IN (SELECT instrument_id FROM chosen UNION SELECT underlying_id FROM instruments JOIN chosen USING (instrument_id) WHERE underlying_id IS NOT NULL)"),
    "f1_list_prices": ("bars instruments", [], f"SELECT instrument_id, name, price_date, {shown('close', 'close')} FROM bars JOIN instruments USING (instrument_id) WHERE name ILIKE '%1%' AND price_date >= DATE '1999-01-01' AND price_date < DATE '1999-02-01'"),
    "f1_price_page": ("bars instruments", ["found AS (SELECT instrument_id, name, price_date, close FROM bars JOIN instruments USING (instrument_id) WHERE close > 50000 AND price_date >= DATE '1998-01-01' AND price_date < DATE '1999-01-01')"], f"SELECT instrument_id, name, price_date, {shown('close', 'close')}, (SELECT count(*) FROM found) AS total, CASE WHEN (SELECT count(*) FROM found) > 80 THEN to_base64('80'::BLOB) ELSE '' END AS next_token FROM found ORDER BY price_date DESC, lower(name), instrument_id LIMIT 40 OFFSET 40"),
    "f2_list_instruments": ("instruments", [], "SELECT instrument_id, name, asset_class, currency FROM instruments WHERE name ILIKE '%7%' AND (asset_class IN ('STOCK', 'UNKNOWN') OR coalesce(asset_class, '') = '')"),
    "f3_list_inflation": ("inflation", [], f"SELECT currency, month, {shown('index_value', 'index_value')} FROM inflation WHERE currency = 'GBP' AND month >= DATE '1996-01-01' AND month < DATE '2000-01-01'"),
    "f4_list_postings": ("postings", ["page AS (SELECT group_id, min(order_date) AS timestamp FROM postings WHERE user_id = 7 GROUP BY ALL ORDER BY 2, 1 LIMIT 5 OFFSET 2)"], f"SELECT timestamp, group_id, order_date, tx_id, broker, {shown('quantity', 'quantity')} FROM postings JOIN page USING (group_id) WHERE user_id = 7"),
    "f4_portfolio_page": ("instruments postings splits filters", [ADJUSTED, MEMBERS, "chosen AS (SELECT DISTINCT group_id, order_date, tx_id, quantity FROM members WHERE broker = 'IBKR' AND account = 'ACC-1' AND order_date >= DATE '1997-01-01' AND order_date < DATE '1998-01-01')", "page AS (SELECT DISTINCT group_id, timestamp FROM chosen JOIN (SELECT group_id, min(order_date) AS timestamp FROM members GROUP BY ALL) USING (group_id) ORDER BY timestamp DESC, group_id DESC LIMIT 50 OFFSET 10)"], f"SELECT timestamp, group_id, order_date, tx_id, {shown('quantity', 'quantity')} FROM chosen JOIN page USING (group_id)"),
    "f7_display_currencies": ("users", [], "SELECT DISTINCT display_currency FROM users WHERE display_currency <> ''"),
    "f8_brokers_and_accounts": ("postings", [], "SELECT DISTINCT user_id, broker, account FROM postings WHERE account_type = 'USER'"),
    "f9_start_dates": ("postings", [], "SELECT user_id, min(order_date) AS start_date FROM postings WHERE account_type = 'USER' GROUP BY ALL"),
    "f15_fetch_windows": ("postings", [], f"SELECT user_id, broker, greatest(max(order_date) - 30, DATE '1999-06-01') AS from_date, DATE '{TODAY}' AS before_date FROM postings WHERE account_type = 'USER' GROUP BY user_id, broker HAVING greatest(max(order_date) - 30, DATE '1999-06-01') < DATE '{TODAY}'"),
    "e1_export_prices": ("bars identifiers coverage", [BEST], f"SELECT instrument_id, identifier_type, value, price_date, {shown('close', 'close')}, nullif(share_count_basis, price_date) AS share_count_basis FROM bars JOIN best USING (instrument_id) UNION ALL SELECT instrument_id, identifier_type, value, NULL, NULL, NULL FROM best WHERE instrument_id IN (SELECT instrument_id FROM coverage) AND instrument_id NOT IN (SELECT instrument_id FROM bars)"),
    "e3_export_windows": ("postings", [], "SELECT user_id, broker, min(order_date) AS period_from, max(order_date) + 1 AS period_before, count(*) AS n_postings FROM postings WHERE account_type = 'USER' GROUP BY ALL"),
    "s3_archive_prices": ("bars identifiers instruments", [BEST], f"SELECT b.identifier_type, coalesce(b.domain, '') AS domain, b.value, asset_class, currency, price_date, {shown('close', 'close')}, share_count_basis FROM bars JOIN best b USING (instrument_id) JOIN instruments i USING (instrument_id)"),
    "s3_archive_splits": ("splits identifiers instruments", [BEST], f"SELECT b.identifier_type, coalesce(b.domain, '') AS domain, b.value, ex_date, {shown('split_from', 'split_from')}, {shown('split_to', 'split_to')} FROM splits JOIN best b USING (instrument_id)"),
    "e5_import_status": ("bars splits inflation identifiers instruments", [BEST, SPOILT], """SELECT 'PRICES' AS part, count(*) AS rows, count(*) FILTER (n = 0) AS accepted, CAST(sum(n) AS BIGINT) AS errors FROM (SELECT *, bad_day::INT + bad_close::INT + bad_volume::INT + bad_name::INT AS n FROM spoilt)
  UNION ALL SELECT 'CORPORATE_EVENTS', count(*), count(*), 0 FROM splits JOIN best USING (instrument_id) UNION ALL SELECT 'INFLATION_INDICES', count(*), count(*) FILTER (month(month) <> 7), count(*) FILTER (month(month) = 7) FROM inflation"""),
    "e5_import_errors": ("bars identifiers instruments", [BEST, SPOILT], """SELECT CASE WHEN bad_name THEN 'NAME' ELSE identifier_type END AS identifier_type, value, CASE WHEN bad_day THEN strftime(price_date, '%Y-%m-32') ELSE strftime(price_date, '%Y-%m-%d') END AS price_date, field,
    CASE field WHEN 'instrument' THEN 'no known identifier' ELSE 'can''t be read' END AS fault
    FROM (SELECT *, unnest([CASE WHEN bad_name THEN 'instrument' END, CASE WHEN bad_day THEN 'price_date' END, CASE WHEN bad_close THEN 'close' END, CASE WHEN bad_volume THEN 'volume' END]) AS field FROM spoilt) WHERE field IS NOT NULL"""),
    "e5_imported_prices": ("bars identifiers instruments", [BEST, SPOILT], f"SELECT identifier_type, coalesce(domain, '') AS domain, value, asset_class, currency, price_date, {shown('close', 'close')}, share_count_basis FROM spoilt WHERE NOT (bad_day OR bad_close OR bad_volume OR bad_name)"),
    "s14_latest_by_key": ("", [EVENT_ROWS], "SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY key, day ORDER BY event_id % 2 DESC, event_id DESC) = 1"),
    "s15_latest_supplied": ("", [EVENT_ROWS], "SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY key, day ORDER BY event_id DESC) = 1"),
    "s16_earliest_by_key": ("", [EVENT_ROWS], "SELECT key, min(day) AS first_known FROM rows GROUP BY ALL"),
    "s17_insert_absent": ("", ["rows AS (SELECT DISTINCT CASE WHEN user_id % 5 <> 0 THEN user_id END AS key, event_type, CAST(ts AS DATE) AS day FROM events)", "old AS (SELECT * FROM rows WHERE event_type IN ('click', 'view'))"], "SELECT * FROM old UNION ALL SELECT * FROM rows r WHERE event_type NOT IN ('click', 'view') AND NOT EXISTS (SELECT 1 FROM old o WHERE o.key IS NOT DISTINCT FROM r.key AND o.day = r.day)"),
    "m1_unmatched_sides": ("instruments postings splits matches correlations", [ADJUSTED, SIDES, """evidence AS (
  SELECT group_id, string_agg(DISTINCT CAST(ordinal AS VARCHAR), ',' ORDER BY CAST(ordinal AS VARCHAR)) FILTER (list_contains(matches, 'ORDINAL')) AS ordinals, string_agg(DISTINCT token, ',' ORDER BY token) FILTER (list_contains(matches, 'ACCOUNT')) AS tokens FROM correlations GROUP BY ALL)"""], f"SELECT user_id, broker, account, p.group_id, instrument_id, min(order_date) AS day, {shown('sum(own)', 'amount')}, coalesce(any_value(ordinals), '') AS ordinals, coalesce(any_value(tokens), '') AS tokens FROM adjusted p LEFT JOIN evidence e ON e.group_id = p.group_id WHERE account_type = 'TRANSFER_CLEARING' AND instrument_id IS NOT NULL AND {UNMATCHED} GROUP BY user_id, broker, account, p.group_id, instrument_id HAVING sum(own) <> 0"),
    "m2_match_transfers": ("journals journal_evidence", [TRANSFERS], "SELECT user_id, instrument_id, from_group_id, to_group_id, method FROM proposed"),
    "m3_create_matches": ("journals journal_evidence", [TRANSFERS, """held AS (SELECT user_id, instrument_id, from_group_id, to_group_id + 2 AS to_group_id, 'POINTER' AS method FROM proposed WHERE user_id % 2 = 0 AND from_group_id % 3 = 0)"""], """SELECT * FROM held UNION ALL SELECT * FROM proposed p WHERE NOT EXISTS (
  SELECT 1 FROM held m WHERE m.instrument_id = p.instrument_id AND (m.from_group_id IN (p.from_group_id, p.to_group_id) OR m.to_group_id IN (p.from_group_id, p.to_group_id)))"""),
    "g2_exact_groups": ("postings", ["keyed AS (SELECT tx_id, user_id, broker, group_id % 500 AS token FROM postings WHERE account_type = 'TRANSFER_CLEARING')"], "SELECT tx_id, event_id FROM (SELECT tx_id, min(tx_id) OVER w AS event_id, count(*) OVER w AS n FROM keyed WINDOW w AS (PARTITION BY user_id, broker, token)) WHERE n > 1"),
    "g1_neighbourhood": ("statements evidence", ["""said AS (SELECT s.tx_id, user_id, broker, account, order_date, e.* EXCLUDE (tx_id) FROM statements s LEFT JOIN evidence e USING (tx_id)),
steps AS (
  SELECT DISTINCT a.tx_id, b.tx_id AS other FROM said a JOIN said b ON a.user_id = b.user_id AND a.broker = b.broker AND (
    a.account = b.account AND a.order_date = b.order_date
    OR a.label = b.label AND a.token = b.token AND (list_contains(a.matches, 'EXACT') OR list_contains(a.matches, 'ATTACHES')) AND list_contains(b.matches, 'EXACT') AND (a.scope <> 'ACCOUNT' OR a.account = b.account)
    OR a.label = b.label AND a.account = b.account AND b.ordinal BETWEEN a.ordinal - a.ordinal_span AND a.ordinal + a.ordinal_span)),
reach AS (SELECT tx_id FROM statements WHERE tx_id % 10000 = 108 UNION SELECT other FROM reach JOIN steps USING (tx_id))"""], "SELECT tx_id FROM reach"),
    "g0_partition": ("statements evidence", [PARTITION], f"SELECT t.tx_id, CASE WHEN anchor IS NULL AND t.tx_id NOT IN (SELECT anchor FROM all_claims) THEN t.tx_id ELSE min(t.tx_id) OVER (PARTITION BY coalesce(anchor, t.tx_id)) END AS event_id, rule, coalesce(kind, {OWN_TYPE}) AS resolved FROM statements t LEFT JOIN all_claims c ON c.tx_id = t.tx_id"),
    "g8_deposit_runs": ("statements evidence", [ASKED, _deposits("s")], "SELECT opener AS opener_tx_id, spend AS spend_tx_id, arrival AS arrival_tx_id FROM runs"),
    "g9_attached_bearers": ("statements evidence", [TOKENS], "SELECT tx_id, anchor FROM attached"),
    "g3_trade_pairs": ("statements evidence", [TRADES], "SELECT a AS asset_tx_id, c AS cash_tx_id, 'disposal' AS rule FROM sold UNION ALL SELECT a, c, 'acquisition' FROM bought UNION ALL SELECT a, c, 'cash_trade' FROM swapped"),
    "g10_explaining_charges": ("statements", ["""charges AS (SELECT user_id, broker, account, order_date, tx_id, abs(quantity) AS amount FROM statements WHERE list_contains(tx_types, 'TRANSACTION_COST')),
gaps AS (SELECT user_id, broker, account, order_date, tx_id AS anchor, settlement_amount - 50 + tx_id % 3 AS gap FROM statements WHERE settlement_amount IS NOT NULL AND quantity > 0),
sums AS (
  SELECT anchor, 1 AS size, [a.tx_id] AS ids FROM gaps g JOIN charges a USING (user_id, broker, account, order_date) WHERE abs(gap - a.amount) < 0.005
  UNION ALL SELECT anchor, 2, [a.tx_id, b.tx_id] FROM gaps g JOIN charges a USING (user_id, broker, account, order_date) JOIN charges b USING (user_id, broker, account, order_date) WHERE a.tx_id < b.tx_id AND abs(gap - a.amount - b.amount) < 0.005
  UNION ALL SELECT anchor, 3, [a.tx_id, b.tx_id, c.tx_id] FROM gaps g JOIN charges a USING (user_id, broker, account, order_date) JOIN charges b USING (user_id, broker, account, order_date) JOIN charges c USING (user_id, broker, account, order_date)
    WHERE a.tx_id < b.tx_id AND b.tx_id < c.tx_id AND abs(gap - a.amount - b.amount - c.amount) < 0.005
), best AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY size, ids) = 1)"""], "SELECT anchor, size, unnest(ids) AS tx_id FROM best"),
    "g12_divergence": ("postings", ["""derived AS (SELECT tx_id, group_id, CASE WHEN tx_id % 1000 > 3 THEN group_id * 1000 + 4 ELSE group_id * 1000 + 1 END AS event_id FROM postings WHERE account_type = 'USER')""", "by_event AS (SELECT event_id, count(DISTINCT group_id) AS n, count(*) AS size, min(group_id) AS group_id FROM derived GROUP BY ALL)", "by_group AS (SELECT group_id, count(DISTINCT event_id) AS n, count(*) AS size FROM derived GROUP BY ALL)"], "SELECT (SELECT count(*) FROM by_event) AS n_derived, (SELECT count(*) FROM by_group) AS n_stored, (SELECT count(*) FROM by_event e JOIN by_group g USING (group_id) WHERE e.n = 1 AND e.size = g.size) AS agreed, (SELECT count(*) FROM by_event WHERE n > 1) AS joined, (SELECT count(*) FROM by_group WHERE n > 1) AS split"),
    "g13_seeds": ("postings matches", [SIDES], "SELECT tx_id FROM postings u WHERE account_type = 'USER' AND EXISTS (SELECT 1 FROM postings p WHERE p.group_id = u.group_id AND p.account_type IN ('IMBALANCE', 'TRANSFER_CLEARING') AND " + UNMATCHED + ")"),
    "g14_readers": ("statements evidence", ["said AS (SELECT s.tx_id, user_id, broker, account, e.* EXCLUDE (tx_id) FROM statements s JOIN evidence e USING (tx_id))"], """SELECT DISTINCT 'token' AS reader, b.tx_id FROM said a JOIN said b ON a.user_id = b.user_id AND a.broker = b.broker AND a.label = b.label AND a.token = b.token WHERE a.broker = 'IBKR' AND a.ordinal IS NULL AND list_contains(b.matches, 'EXACT') AND (a.tx_id % 2 = 0 OR a.account = b.account)
UNION ALL SELECT DISTINCT 'ordinal', b.tx_id FROM said a JOIN said b ON a.user_id = b.user_id AND a.broker = b.broker AND a.account = b.account AND a.label = b.label WHERE a.broker = 'IBKR' AND b.ordinal BETWEEN a.ordinal - a.ordinal_span AND a.ordinal + a.ordinal_span
UNION ALL SELECT 'day', tx_id FROM statements s WHERE EXISTS (SELECT 1 FROM statements a WHERE a.account = 'ACC-0' AND a.user_id = s.user_id AND a.broker = s.broker AND a.account = s.account AND a.order_date = s.order_date)"""),
    "g15_apply_partition": ("instruments postings", [WEIGHTED.replace("FROM postings p LEFT JOIN", "FROM moved p LEFT JOIN").replace("FROM postings GROUP BY ALL", "FROM moved GROUP BY ALL")], f"SELECT group_id, commodity, account_type, {shown('amount', 'amount')} FROM closing"),
    "g11_membership_diff": ("postings", ["named AS (SELECT tx_id, min(tx_id) OVER (PARTITION BY group_id) AS old_event_id, min(tx_id) OVER (PARTITION BY CASE WHEN tx_id % 1000 > 4 THEN group_id + 1 ELSE group_id END) AS new_event_id FROM postings)"], "SELECT * FROM named WHERE old_event_id <> new_event_id"),
    "t5_broker_exposure": ("instruments postings splits matches", [ADJUSTED, SIDES, BALANCES, EXPOSURE], f"SELECT broker, broker_rank, {shown('sum(total)', 'total')} FROM exposure WHERE row_rank <= 3 GROUP BY ALL"),
    "st1_event_windows": ("", [], "SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL"),
    "e2_export_events": ("splits coverage identifiers dividends", [COVERED, BEST, "paid AS (SELECT instrument_id, string_agg(ex_date || ' ' || amount || ' ' || currency, '|' ORDER BY ex_date, amount) AS dividends FROM dividends WHERE dividend_type IS NULL OR dividend_type <> 'SC' GROUP BY ALL)", "events AS (SELECT instrument_id, string_agg(ex_date || ' ' || CAST(split_from AS DOUBLE) || ' ' || CAST(split_to AS DOUBLE), '|' ORDER BY ex_date, split_from, split_to) AS splits FROM splits GROUP BY ALL)", "held AS (SELECT instrument_id, string_agg(from_date || '/' || before_date, '|' ORDER BY from_date) AS spans FROM covered GROUP BY ALL)"], "SELECT instrument_id, identifier_type, value, coalesce(splits, '') AS splits, coalesce(dividends, '') AS dividends, coalesce(spans, '') AS spans FROM events FULL JOIN held USING (instrument_id) FULL JOIN paid USING (instrument_id) JOIN best USING (instrument_id)"),
    "f5_unhandled_events": ("splits instruments", [], f"SELECT s.instrument_id * 10 + dayofweek(ex_date) + 1 AS event_id, s.instrument_id, ex_date, CASE WHEN split_to < split_from THEN 'REVERSE_SPLIT' ELSE 'NON_WHOLE_SPLIT' END AS event_type, false AS resolved, name FROM splits s JOIN instruments USING (instrument_id) WHERE NOT ({WHOLE}) AND s.instrument_id % 4 <> 0"),
    "f6_jobs": (None, [], "SELECT o_orderkey AS job_id, o_orderstatus AS status, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.05 AND l_returnflag = 'R') AS n_row, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.05 AND l_returnflag <> 'R') AS n_file FROM orders"),
    "r14_overlap_probe": ("identifiers", ["n AS (SELECT identifier_type, coalesce(domain, '') AS domain, value, instrument_id, valid_from, valid_before FROM identifiers)"], "SELECT a.identifier_type, a.domain, a.value, a.instrument_id, a.valid_from, a.valid_before, min(b.instrument_id) AS other_holder FROM n a JOIN n b ON a.identifier_type = b.identifier_type AND a.domain = b.domain AND a.value = b.value AND a.instrument_id <> b.instrument_id AND coalesce(b.valid_from, DATE '0001-01-01') < coalesce(a.valid_before, DATE '9999-12-31') AND coalesce(b.valid_before, DATE '9999-12-31') > coalesce(a.valid_from, DATE '0001-01-01') GROUP BY ALL"),
    "st3_session_totals": (None, ["marked AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR, true) AS opens FROM events)", "numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM marked)"], "SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM numbered GROUP BY user_id, session"),
    "i11_identifier_types": ("identifiers", [], "SELECT identifier_type, count(*) AS n, true AS known, identifier_type LIKE '%TICKER' AS listing, identifier_type = 'ISIN' AS mediates FROM identifiers GROUP BY ALL UNION ALL SELECT 'CUSIP', 0, true, false, true UNION ALL SELECT 'NO_SUCH', 0, false, false, false"),
    "s6_ofx_datetimes": (None, ["t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '20011' ELSE strftime(o_orderdate, '%Y%m%d') || CASE WHEN o_orderkey % 3 > 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || '3015.000' ELSE '' END || ['', '[-5:EST]', '[+5.5:IST]', '[0:GMT]'][o_orderkey % 4 + 1] END AS stated FROM orders)"], "SELECT o_orderkey, stated, CASE WHEN length(stated) >= 8 THEN make_timestamp(CAST(stated[1:4] AS BIGINT), CAST(stated[5:6] AS BIGINT), CAST(stated[7:8] AS BIGINT), CASE WHEN stated LIKE '________3015%' OR stated LIKE '__________3015%' THEN CAST(stated[9:10] AS BIGINT) ELSE 0 END, CASE WHEN stated LIKE '__________3015%' THEN 30 ELSE 0 END, CASE WHEN stated LIKE '__________3015%' THEN 15 ELSE 0 END) - CASE WHEN stated LIKE '%EST%' THEN INTERVAL (-300) MINUTE WHEN stated LIKE '%IST%' THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END END AS at FROM t"),
    "s7_csv_fields": (None, [], "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS key, p_name || ', the \"' || p_brand || '\"' AS name, p_type AS type FROM part"),
    "s12_derived_legs": ("postings", [], f"SELECT tx_id, settlement_currency AS currency, 'fee' AS leg, 'TRANSACTION_COST' AS tx_type, 'USER' AS account_type, CAST(-7.5 AS DOUBLE) AS quantity FROM postings WHERE tx_id % 4 = 0 UNION ALL SELECT tx_id, settlement_currency, 'reinvested', 'DIVIDEND', 'INCOME', {shown('-quantity * coalesce(unit_price, 0)', 'quantity')} FROM postings WHERE tx_type = 'DIVIDEND' AND abs(quantity * coalesce(unit_price, 0)) >= 0.005"),
    "s18_sheet_requests": ("postings coverage instruments users identifiers", [held(True), COVERED, NEEDS, PRICE_NAMES, REQUESTS], """SELECT sheet, 0 AS row, place AS column, concat_ws('|', t, d, value, asset_class) AS cell FROM placed
UNION ALL SELECT sheet, 1, place, '=GOOGLEFINANCE("' || coalesce(CASE t WHEN 'FX_PAIR' THEN 'CURRENCY' END, code) || ':' || value || '","close",DATE(' || strftime(c, '%Y,%-m,%-d') || '),DATE(' || strftime(e, '%Y,%-m,%-d') || '),"DAILY")' FROM placed"""),
    "s18_sheet_skipped": ("postings coverage instruments users identifiers", [held(True), COVERED, NEEDS, PRICE_NAMES, REQUESTS], "SELECT DISTINCT instrument_id, name, CASE WHEN t = 'ISIN' THEN 'UNSUPPORTED_TYPE' WHEN venue = '' THEN 'NO_VENUE' ELSE 'UNKNOWN_VENUE' END AS reason, venue FROM coded WHERE t = 'ISIN' OR (t <> 'FX_PAIR' AND code IS NULL)"),
    "s19_sheet_prices": ("sheet_cells", [SHEETS], f"SELECT sheet, place AS column, h[1] AS identifier_type, h[2] AS domain, h[3] AS value, h[4] AS asset_class, day AS price_date, {shown('close', 'close')}, DATE '2001-11-30' AS share_count_basis FROM sheet_rows WHERE day IS NOT NULL AND close IS NOT NULL"),
    "s19_sheet_warnings": ("sheet_cells", [SHEETS], "SELECT sheet, 0 AS row, place AS column, 'header' AS warning FROM heads WHERE len(h) <> 4 UNION ALL SELECT sheet, row, CASE WHEN day IS NULL THEN place ELSE place + 1 END, CASE WHEN day IS NULL THEN 'day' ELSE 'close' END FROM sheet_rows WHERE day IS NULL OR close IS NULL"),
    "s22_upload_vintage": (None, [], "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '2001-05-05' WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 2 = 0 THEN date_trunc('day', o_orderdate) - INTERVAL 1 DAY END AS vintage FROM orders"),
    "b3_weight_divergence": ("instruments postings", [WEIGHTED.split("), edges AS")[0].replace("FROM valued)", "FROM candidates)").replace("valued AS (", "valued AS (", 1).replace("), weighted AS", "), candidates AS (SELECT * EXCLUDE (tx_type), unnest(CASE WHEN tx_id % 3 = 0 THEN [tx_type, 'TRADE_ASSET'] ELSE ['TRADE_ASSET', 'TRADE_CASH', 'TRANSFER_INTERNAL'] END) AS tx_type, unnest(CASE WHEN tx_id % 3 = 0 THEN [0, 1] ELSE [0, 1, 2] END) AS place FROM valued WHERE tx_id % 3 < 2), weighted AS") + ")"], "SELECT a.tx_id, a.tx_type AS first_type, arg_min(b.tx_type, b.place) AS other_type FROM weighted a JOIN weighted b ON a.tx_id = b.tx_id AND a.place = 0 AND (a.weight <> b.weight OR a.commodity <> b.commodity) GROUP BY ALL"),
    "b7_routed_legs": ("instruments postings", [WEIGHTED], f"SELECT group_id, user_id, broker, account, order_date, trade_date, tx_type, c.account_type, CASE WHEN commodity LIKE 'cur:%' THEN (SELECT min(i.instrument_id) FROM instruments i WHERE i.asset_class = 'CASH' AND i.currency = commodity[5:]) ELSE (SELECT arg_min(w.instrument_id, (w.order_date, w.tx_id)) FROM weighted w WHERE w.group_id = c.group_id AND w.commodity = c.commodity AND w.account_type = 'USER') END AS instrument_id, CASE WHEN commodity LIKE 'cur:%' THEN commodity[5:] ELSE (SELECT arg_min(w.description, (w.order_date, w.tx_id)) FROM weighted w WHERE w.group_id = c.group_id AND w.commodity = c.commodity AND w.account_type = 'USER') END AS description, {shown('amount', 'quantity')}, commodity FROM closing c JOIN (SELECT * EXCLUDE (account_type, quantity, description, instrument_id) FROM postings WHERE account_type = 'USER' QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY order_date, tx_id) = 1) p USING (group_id)"),
    "c5_defaults": ("postings", [], f"SELECT tx_id, {shown('quantity', 'quantity')}, {shown('unit_price', 'unit_price')}, CASE WHEN tx_id % 2 = 0 THEN CAST(share_count_basis + INTERVAL 3 DAY AS DATE) ELSE trade_date END AS share_count_basis, {shown('CASE WHEN tx_id % 3 = 0 THEN 2 ELSE 1 END * quantity', 'split_adjusted_quantity')}, {shown('unit_price', 'split_adjusted_unit_price')} FROM postings"),
    "c11_option_faults": ("instruments splits postings identifiers", [PENDING, RESTATED], """SELECT underlying_id AS instrument_id, ex_date, CASE WHEN split_to < split_from THEN 'REVERSE_SPLIT' ELSE 'NON_WHOLE_SPLIT' END AS event_type, string_agg(CAST(instrument_id AS VARCHAR), '|' ORDER BY instrument_id) AS options
  FROM waiting WHERE odd GROUP BY ALL
  UNION ALL SELECT instrument_id, max(ex_date), 'UNREADABLE_NAME', CAST(instrument_id AS VARCHAR) FROM waiting WHERE NOT blocked AND NOT readable GROUP BY instrument_id"""),
    "c10_applied_restatement": ("instruments splits postings identifiers", [PENDING, RESTATED, """mints AS (SELECT instrument_id, symbol, valid_from, valid_before, min(valid_from) OVER (PARTITION BY instrument_id) AS first FROM named)"""], """SELECT instrument_id, symbol AS value, valid_from, valid_before FROM mints UNION
SELECT d.instrument_id, d.value, d.valid_from, CASE WHEN d.valid_before IS NULL THEN m.first ELSE d.valid_before END FROM identifiers d LEFT JOIN (SELECT DISTINCT instrument_id, first FROM mints) m USING (instrument_id) WHERE d.identifier_type = 'OCC' AND NOT coalesce(d.valid_from >= m.first, false)"""),
    "d5_recalculated_pads": ("declarations instruments splits postings", ["starts AS (SELECT user_id, min(order_date) AS start FROM postings WHERE account_type = 'USER' AND (broker <> 'SCHB' OR order_date >= DATE '1999-01-01') GROUP BY ALL)", "declared AS (SELECT d.* FROM declarations d JOIN starts USING (user_id) WHERE as_of_date >= start QUALIFY row_number() OVER (PARTITION BY user_id, broker, account, instrument_id ORDER BY as_of_date, declared_qty) = 1)", CHECKED.replace("WHERE account_type = 'USER' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "WHERE account_type = 'USER' AND (broker <> 'SCHB' OR order_date >= DATE '1999-01-01')")], f"SELECT user_id, broker, account, instrument_id, start AS order_date, account_type, {shown('sign * (declared_qty - computed)', 'quantity')}, share_count_basis FROM checked c JOIN starts USING (user_id) JOIN declared d USING (user_id, broker, account, instrument_id, as_of_date, declared_qty) CROSS JOIN (VALUES ('USER', 1), ('EQUITY', -1)) AS s(account_type, sign)"),
    "i7_ensure_instruments": ("identifiers", ["""asked AS (SELECT p_partkey AS r, 'MIC_TICKER' AS t, 'XNAS' AS d, 'T' || p_partkey % 1000 AS v FROM part UNION ALL SELECT p_partkey, 'OPENFIGI_TICKER', 'US', 'F.' || p_partkey % 700 FROM part)""",
        """known AS (SELECT identifier_type AS t, domain AS d, value AS v, instrument_id AS i FROM identifiers WHERE domain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY identifier_type, domain, value ORDER BY valid_before DESC NULLS FIRST, instrument_id) = 1)""",
        """edges AS (SELECT 'r' || a.r AS x, 'i' || k.i AS y FROM asked a JOIN known k USING (t, d, v) UNION SELECT 'r' || a.r, 'r' || b.r FROM asked a JOIN asked b USING (t, d, v))""", "both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges)",
        "reach AS (SELECT DISTINCT x, x AS y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON e.x = r.y)",
        "sizes AS (SELECT 'i' || instrument_id AS y, count(*) AS n FROM identifiers GROUP BY ALL)"], "SELECT CAST(r.x[2:] AS BIGINT) AS request_id, coalesce(arg_min(CAST(r.y[2:] AS BIGINT), (-coalesce(n, 0), CAST(r.y[2:] AS BIGINT))) FILTER (r.y LIKE 'i%'), 1000000 + min(CAST(r.y[2:] AS BIGINT)) FILTER (r.y LIKE 'r%')) AS instrument_id FROM reach r LEFT JOIN sizes USING (y) WHERE r.x LIKE 'r%' GROUP BY r.x"),
    "i8_operating_mic": ("instruments", [], "SELECT instrument_id, CASE exchange_mic WHEN 'XLON' THEN 'XLOM' ELSE exchange_mic END AS exchange_mic, CASE WHEN exchange_mic IN ('XNAS', 'XNYS') THEN 'US' WHEN exchange_mic = 'XLON' THEN 'GB' ELSE '' END AS country_code FROM instruments"),
    "f14_page_tokens": (None, [], "SELECT c_custkey, to_base64(encode(CAST(c_custkey * 7 AS VARCHAR))) AS token, CASE WHEN c_custkey % 5 < 2 THEN 0 ELSE c_custkey * 7 END AS offset FROM customer"),
    "a12_dashboard_counts": ("instruments postings splits matches coverage", [ADJUSTED, SIDES, BALANCES, held(True), COVERED, f"gaps AS ({less('SELECT * FROM held', 'SELECT instrument_id, from_date, before_date FROM covered', 'instrument_id')})"], f"SELECT 'balances' AS key, count(*) AS n FROM balances WHERE account_type <> 'SOURCE_ROUNDING' UNION ALL SELECT 'imbalances', count(*) FROM balances WHERE account_type = 'IMBALANCE' UNION ALL SELECT 'gap_instruments', count(DISTINCT instrument_id) FROM gaps UNION ALL SELECT 'unhandled_events', count(*) FROM splits WHERE NOT ({WHOLE})"),
    "e8_gap_outcomes": (None, ["calls AS (SELECT l_orderkey AS gap_id, l_linenumber AS r, l_returnflag <> 'R' AS ok, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS bars FROM lineitem WHERE l_discount > 0.02)", "sums AS (SELECT o_orderkey AS gap_id, CAST(o_orderkey % 4 AS BIGINT) AS n_ranges, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END AS BIGINT) AS n_eligible, count(c.r) AS n_calls, CAST(coalesce(sum(bars) FILTER (ok), 0) AS BIGINT) AS n_bars, count(DISTINCT r) FILTER (ok) AS covered FROM orders LEFT JOIN calls c ON c.gap_id = o_orderkey GROUP BY o_orderkey)"], "SELECT gap_id, n_ranges, n_eligible, n_calls, n_bars, CASE WHEN n_ranges > 0 AND covered >= n_ranges THEN CASE WHEN n_bars > 0 THEN 'filled' ELSE 'settled_empty' END WHEN n_eligible = 0 THEN 'no_eligible_plugin' WHEN n_calls = 0 THEN 'settled_empty' ELSE 'all_plugins_failed' END AS outcome FROM sums"),
    "e6_runs": ("runs run_keys run_candidate_calls run_gaps", [], f"SELECT r.*, {IS_IMPORT}, CAST(round(CAST(epoch_us(ended_at) - epoch_us(started_at) AS DECIMAL(20,0)) / 1000) AS BIGINT) AS duration_ms, (SELECT count(*) FROM run_keys WHERE run_id = r.id) AS key_count, (SELECT CAST(coalesce(sum(tx_count), 0) AS BIGINT) FROM run_keys WHERE run_id = r.id) AS key_tx_count, (SELECT count(*) FROM run_candidate_calls WHERE run_id = r.id) AS candidate_call_count, (SELECT count(*) FROM run_gaps WHERE run_id = r.id) AS gap_count FROM runs r"),
    "e6_resolution_keys": ("runs run_keys run_attempts", [], f"SELECT k.*, {resolved('resolved')}, k.id IN (SELECT resolution_key_id FROM run_attempts) AS had_attempt, {OF_RUN} FROM run_keys k JOIN runs r ON r.id = k.run_id"),
    "e6_attempts": ("runs run_keys run_attempts", [], f"SELECT a.*, {REACHED}, {OF_KEY}, k.mismatch_detected AS key_mismatch_detected, r.id AS run_id, {OF_RUN} FROM {CHAIN}"),
    "e6_plugin_calls": ("runs run_keys run_attempts run_calls", [], f"SELECT c.*, c.outcome IN ('rate_limited', 'timeout', 'error') AS transport_failed, {OF_ATTEMPT}, a.security_type_hint AS attempt_security_type_hint, a.had_identifier_hints AS attempt_had_identifier_hints, {REACHED}, k.id AS resolution_key_id, {OF_KEY}, r.id AS run_id, {OF_RUN} FROM run_calls c JOIN {CHAIN.replace('run_attempts a', 'run_attempts a ON a.id = c.identification_attempt_id')}"),
    "e6_claims": ("runs run_keys run_attempts run_calls run_claims", [], f"SELECT cl.*, c.plugin_id, c.outcome AS call_outcome, c.identification_attempt_id, {OF_ATTEMPT}, {REACHED}, k.id AS resolution_key_id, {OF_KEY}, r.id AS run_id, {OF_RUN} FROM run_claims cl JOIN run_calls c ON c.id = cl.call_id JOIN {CHAIN.replace('run_attempts a', 'run_attempts a ON a.id = c.identification_attempt_id')}"),
    "e6_candidate_calls": ("runs run_candidate_calls", [], f"SELECT c.*, c.outcome NOT IN ('hints_returned', 'no_hints') AS call_failed, {OF_RUN} FROM run_candidate_calls c JOIN runs r ON r.id = c.run_id"),
    "e6_candidate_fields": ("runs run_keys run_candidate_calls run_fields", [], f"SELECT f.*, f.outcome NOT IN ('untested', 'unused') AS was_tested, c.plugin_id, c.precedence, c.total_tokens AS call_total_tokens, c.batch_size AS call_batch_size, k.source, k.description, k.tx_count, k.had_identifier_hints, k.security_type_hint, k.candidate_outcome, k.outcome AS key_outcome, k.instrument_id, r.id AS run_id, {OF_RUN} FROM run_fields f JOIN run_candidate_calls c ON c.id = f.call_id JOIN run_keys k ON k.id = f.resolution_key_id JOIN runs r ON r.id = k.run_id"),
    "e6_gaps": ("runs run_gaps run_gap_calls", [], f"SELECT g.*, {GAP_SETTLED} AS settled, g.id IN (SELECT price_gap_id FROM run_gap_calls) AS had_call, {OF_CYCLE} FROM run_gaps g JOIN runs r ON r.id = g.run_id"),
    "e6_gap_calls": ("runs run_gaps run_gap_calls", [], f"SELECT c.*, CAST(range_before - range_from AS INTEGER) AS days, c.outcome IN ('timeout', 'error') AS transport_failed, c.outcome = 'upsert_failed' AS write_failed, g.instrument_id AS gap_instrument_id, g.is_fx AS gap_is_fx, g.asset_class AS gap_asset_class, g.currency AS gap_currency, g.exchange AS gap_exchange, g.days_outstanding AS gap_days_outstanding, g.outcome AS gap_outcome, {GAP_SETTLED} AS gap_settled, r.id AS run_id, {OF_CYCLE} FROM run_gap_calls c JOIN run_gaps g ON g.id = c.price_gap_id JOIN runs r ON r.id = g.run_id"),
    "e7_labelled_keys": ("runs run_keys instruments", [], f"SELECT k.id, k.run_id, k.description, {resolved('resolved')}, k.instrument_id, i.name AS label, i.exchange_mic AS instrument_exchange, i.asset_class AS instrument_asset_class, i.currency AS instrument_currency FROM run_keys k LEFT JOIN instruments i USING (instrument_id)"),
    "e7_purged": ("runs run_keys run_attempts run_calls run_claims run_candidate_calls run_fields run_gaps run_gap_calls", [f"old AS (SELECT id FROM runs WHERE started_at < TIMESTAMP '{CUTOFF}')", "old_keys AS (SELECT id FROM run_keys WHERE run_id IN (SELECT id FROM old))", "old_attempts AS (SELECT id FROM run_attempts WHERE resolution_key_id IN (SELECT id FROM old_keys))", "old_calls AS (SELECT id FROM run_calls WHERE identification_attempt_id IN (SELECT id FROM old_attempts))", "old_gaps AS (SELECT id FROM run_gaps WHERE run_id IN (SELECT id FROM old))"], """SELECT 'runs' AS table_name, id FROM runs WHERE id NOT IN (SELECT id FROM old)
UNION ALL SELECT 'keys', id FROM run_keys WHERE id NOT IN (SELECT id FROM old_keys) UNION ALL SELECT 'attempts', id FROM run_attempts WHERE id NOT IN (SELECT id FROM old_attempts)
UNION ALL SELECT 'calls', id FROM run_calls WHERE id NOT IN (SELECT id FROM old_calls) UNION ALL SELECT 'claims', id FROM run_claims WHERE call_id NOT IN (SELECT id FROM old_calls)
UNION ALL SELECT 'candidate_calls', id FROM run_candidate_calls WHERE run_id NOT IN (SELECT id FROM old) UNION ALL SELECT 'candidate_fields', id FROM run_fields WHERE resolution_key_id NOT IN (SELECT id FROM old_keys)
UNION ALL SELECT 'gaps', id FROM run_gaps WHERE id NOT IN (SELECT id FROM old_gaps) UNION ALL SELECT 'gap_calls', id FROM run_gap_calls WHERE price_gap_id NOT IN (SELECT id FROM old_gaps)"""),
    "e7_kept_runs": (None, [], "SELECT event_id AS run_id, CASE WHEN event_id % 4 > 0 THEN 'DONE' ELSE 'INCOMPLETE' END AS status, CASE WHEN event_id % 4 > 0 THEN ts ELSE TIMESTAMP '2030-01-01' END AS ended_at FROM events WHERE ts >= TIMESTAMP '1970-01-01'"),
}


def oracle_sql() -> dict[str, str]:
    """Each query's SQL text."""
    out = {}
    for name, (views, steps, last) in PARTS.items():
        body = f"WITH {', '.join(steps)} {last}" if steps else last
        if name == "g15_apply_partition":
            body = body.replace("WITH valued", f"WITH {MOVED}, valued", 1)
        text = with_views(views.split(), body) if views else body
        out[name] = f"WITH RECURSIVE{text[4:]}" if "_walk AS" in text or TRANSFERS in steps or name in ("g1_neighbourhood", "i7_ensure_instruments") else text
    return out
