"""The repairs of problems 1 to 5 in SQL, to hold their queries to."""

from __future__ import annotations

SQL: dict[str, str] = {}

_BOOK = """q AS (SELECT session_id, symbol_id, entry_id, CAST(msg_seq AS BIGINT) AS seq, price, size, CASE lower(trim("update")) WHEN '0' THEN 'new' WHEN '1' THEN 'change' WHEN '2' THEN 'delete' ELSE lower(trim("update")) END AS u,
  CASE WHEN lower(trim(side)) IN ('bid', '0') THEN 'bid' WHEN lower(trim(side)) IN ('ask', 'offer', '1') THEN 'ask' END AS side FROM eurusd_quotes WHERE entry_id IS NOT NULL AND msg_seq IS NOT NULL),
f AS (SELECT session_id, symbol_id, max(seq) AS floor FROM q WHERE u = 'snapshot' GROUP BY ALL),
e AS (SELECT session_id, symbol_id, side, entry_id, coalesce(max(CASE WHEN u IN ('snapshot', 'new') THEN seq END), -1) AS put, coalesce(max(CASE WHEN u = 'change' THEN seq END), -1) AS changed,
  coalesce(max(CASE WHEN u = 'delete' THEN seq END), -1) AS gone FROM q GROUP BY ALL),
b AS (SELECT e.*, put > gone AND put >= coalesce(f.floor, -1) AS live, greatest(put, changed, gone) AS msg_seq FROM e LEFT JOIN f ON e.session_id = f.session_id AND e.symbol_id = f.symbol_id)"""
SQL["p1_found"] = f"WITH {_BOOK} SELECT session_id, symbol_id, side, entry_id, msg_seq FROM b WHERE live"
SQL["p1_tombstones"] = f"WITH {_BOOK} SELECT session_id, symbol_id, side, entry_id, msg_seq FROM b WHERE NOT live"
SQL["p1_state"] = f"""WITH {_BOOK} SELECT b.session_id, b.symbol_id, b.side, b.entry_id, any_value(b.msg_seq) AS msg_seq,
 max(CASE WHEN q.price IS NOT NULL THEN struct_pack(s := q.seq, v := q.price) END).v AS price, max(CASE WHEN q.size IS NOT NULL THEN struct_pack(s := q.seq, v := q.size) END).v AS size
 FROM b JOIN q ON b.session_id = q.session_id AND b.symbol_id = q.symbol_id AND b.side = q.side AND b.entry_id = q.entry_id AND q.seq >= b.put AND q.u <> 'delete' WHERE live GROUP BY ALL"""
SQL["p5_found"] = """WITH r AS (SELECT t.symbol, CAST(i.grid_s AS BIGINT) AS g, epoch_us(ts_recv_utc) // (1000000 * CAST(i.grid_s AS BIGINT)) * i.grid_s AS slot_s FROM ticks t JOIN instruments i ON t.symbol = i.symbol
  WHERE ts_recv_utc IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL),
s AS (SELECT DISTINCT symbol, g, slot_s FROM r), d AS (SELECT symbol, g, slot_s // 86400 AS day, min(slot_s) AS lo, max(slot_s) AS hi FROM s GROUP BY ALL),
a AS (SELECT symbol, unnest(range(lo, hi + g, g)) AS slot_s FROM d)
SELECT a.symbol, CAST(a.slot_s AS BIGINT) AS slot_s FROM a ANTI JOIN s ON a.symbol = s.symbol AND a.slot_s = s.slot_s"""
# What of the grid SQL can say: the status of every period (support needs three observed periods that day, and a gap of 32 at most or a symbol of one grid seen in it), and observed readings.
SQL["p5_periods"] = """WITH r AS (SELECT t.symbol, CAST(i.grid_s AS BIGINT) AS g, epoch_us(ts_recv_utc) AS us, bid, ask FROM ticks t JOIN instruments i ON t.symbol = i.symbol
  WHERE ts_recv_utc IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL),
s AS (SELECT symbol, g, us // (1000000 * g) * g AS slot_s, max(struct_pack(us := us, bid := bid, ask := ask)) AS m FROM r GROUP BY ALL),
o AS (SELECT *, lead(slot_s) OVER (PARTITION BY symbol, slot_s // 86400 ORDER BY slot_s) AS next_s, count(*) OVER (PARTITION BY symbol, slot_s // 86400) AS n FROM s),
a AS (SELECT symbol, g, n, m, slot_s AS own, (coalesce(next_s, slot_s + g) - slot_s) // g AS gap, unnest(range(slot_s, coalesce(next_s, slot_s + g), g)) AS slot_s FROM o),
c AS (SELECT DISTINCT g, slot_s FROM s)
SELECT symbol, CAST(a.slot_s AS BIGINT) AS slot_s, CASE WHEN a.slot_s = own THEN 'observed' WHEN n >= 3 AND (gap <= 32 OR c.slot_s IS NOT NULL) THEN 'filled' ELSE 'unsupported' END AS status,
 CASE WHEN a.slot_s = own THEN m.bid END AS bid, CASE WHEN a.slot_s = own THEN m.ask END AS ask FROM a LEFT JOIN c ON a.g = c.g AND a.slot_s = c.slot_s"""
SQL["p4_found"] = """WITH t0 AS (SELECT symbol, ts_recv_utc AS ts, min(bid) AS bid, min(spread) AS spread FROM ticks WHERE bid IS NOT NULL AND ts_recv_utc IS NOT NULL GROUP BY ALL),
t1 AS (SELECT *, lag(bid) OVER w AS p1, lag(bid, 2) OVER w AS p2, lag(bid, 3) OVER w AS p3, lead(bid) OVER w AS n1, lead(bid, 2) OVER w AS n2, lead(bid, 3) OVER w AS n3 FROM t0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
tu AS (SELECT symbol, 25 * median(round(abs(bid - p1), 9)) AS m, 15 * median(round(spread, 9)) AS s FROM t1 GROUP BY 1),
t2 AS (SELECT t1.*, m, s, sum(CASE WHEN bid = p1 THEN 0 ELSE 1 END) OVER (PARTITION BY t1.symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM t1 JOIN tu ON t1.symbol = tu.symbol),
t3 AS (SELECT *, count(*) OVER (PARTITION BY symbol, run) AS held FROM t2),
t4 AS (SELECT symbol, ts FROM t3 WHERE bid <= 0 OR spread < 0 OR spread >= s OR held >= 20
 OR (abs(p1 - n1) < m AND abs(bid - p1) > m AND abs(bid - n1) > m)
 OR (abs(p1 - n2) < m AND abs(bid - p1) > m AND abs(bid - n2) > m AND abs(n1 - p1) > m AND abs(n1 - n2) > m)
 OR (abs(p2 - n1) < m AND abs(bid - p2) > m AND abs(bid - n1) > m AND abs(p1 - p2) > m AND abs(p1 - n1) > m)
 OR (abs(p1 - n3) < m AND abs(bid - p1) > m AND abs(bid - n3) > m AND abs(n1 - p1) > m AND abs(n1 - n3) > m AND abs(n2 - p1) > m AND abs(n2 - n3) > m)
 OR (abs(p2 - n2) < m AND abs(bid - p2) > m AND abs(bid - n2) > m AND abs(p1 - p2) > m AND abs(p1 - n2) > m AND abs(n1 - p2) > m AND abs(n1 - n2) > m)
 OR (abs(p3 - n1) < m AND abs(bid - p3) > m AND abs(bid - n1) > m AND abs(p1 - p3) > m AND abs(p1 - n1) > m AND abs(p2 - p3) > m AND abs(p2 - n1) > m)),
b0 AS (SELECT dataset_id, bar_index, min("Open") AS o, min("High") AS h, min("Low") AS l, min("Close") AS c FROM bars GROUP BY ALL),
b1 AS (SELECT *, lag(h) OVER w AS ph, lag(l) OVER w AS pl, lead(h) OVER w AS nh, lead(l) OVER w AS nl FROM b0 WINDOW w AS (PARTITION BY dataset_id ORDER BY bar_index)),
bu AS (SELECT dataset_id, 15 * median(round(h - l, 9)) AS m FROM b1 GROUP BY 1),
b2 AS (SELECT b1.*, m, sum(CASE WHEN h = ph AND l = pl THEN 0 ELSE 1 END) OVER (PARTITION BY b1.dataset_id ORDER BY bar_index ROWS UNBOUNDED PRECEDING) AS run FROM b1 JOIN bu ON b1.dataset_id = bu.dataset_id),
b3 AS (SELECT *, count(*) OVER (PARTITION BY dataset_id, run) AS held FROM b2),
b4 AS (SELECT dataset_id, bar_index FROM b3 WHERE h < greatest(l, o, c) OR l > least(h, o, c) OR l <= 0 OR held >= 10
 OR ((ph IS NOT NULL OR nh IS NOT NULL) AND ((coalesce(h - ph > m, true) AND coalesce(h - nh > m, true)) OR (coalesce(pl - l > m, true) AND coalesce(nl - l > m, true)))))
SELECT 'ticks' AS source_table, row_id FROM ticks t JOIN t4 ON t.symbol = t4.symbol AND t.ts_recv_utc = t4.ts WHERE t.bid IS NOT NULL
UNION ALL SELECT 'bars', row_id FROM bars b JOIN b4 ON b.dataset_id = b4.dataset_id AND b.bar_index = b4.bar_index"""

# Lines as fields by place; the header is the first line that is neither blank nor a remark.
_LINES = r"""l AS (SELECT filename, line_no, rtrim(ltrim(line_text, ' ' || chr(65279)), chr(13) || chr(10)) AS t FROM capture_lines WHERE filename IS NOT NULL AND line_no IS NOT NULL AND line_text IS NOT NULL),
d AS (SELECT * FROM l WHERE trim(t) <> '' AND NOT starts_with(t, '#')),
h0 AS (SELECT filename, min(struct_pack(line_no := line_no, t := t)) AS h FROM d GROUP BY 1),
h1 AS (SELECT filename, h.line_no AS header_no, h.t AS t, list_transform([',', ';', '|', chr(9)], lambda c: length(h.t) - length(replace(h.t, c, ''))) AS n FROM h0),
h2 AS (SELECT filename, header_no, t, [',', ';', '|', chr(9)][list_position(n, list_max(n))] AS delimiter FROM h1),
h3 AS (SELECT *, list_transform(string_split(t, delimiter), lambda x: lower(trim(x))) AS names FROM h2),
heads AS (SELECT filename, header_no, delimiter, list_transform(names, lambda x, i: CASE WHEN x = '' THEN '#' || i WHEN list_position(names, x) < i THEN x || '#' || i ELSE x END) AS fields FROM h3),
c0 AS (SELECT d.filename, line_no, fields, string_split(t, delimiter) AS v FROM d JOIN heads h ON d.filename = h.filename WHERE line_no > header_no),
c1 AS (SELECT filename, line_no, unnest(range(1, len(v) + 1)) AS place, fields, v FROM c0),
c2 AS (SELECT filename, line_no, place, coalesce(fields[place], '#' || place) AS path, trim(v[place]) AS x FROM c1),
cells AS (SELECT *, CASE WHEN x = '' THEN NULL WHEN regexp_full_match(x, '[+-]?\d+') THEN 'integer' WHEN regexp_full_match(x, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN 'decimal'
 WHEN lower(x) IN ('true', 'false', 'yes', 'no') THEN 'boolean'
 WHEN regexp_full_match(x, '\d{4}[-./]\d{1,2}[-./]\d{1,2}([Tt ]\s*\d{1,2}:\d{2}.*)?|\d{1,2}[-/ ](\d{1,2}|[A-Za-z]{3})[-/ ]\d{4}( .*)?|\d{8}[Tt ]\d{6}\S*') THEN 'time' ELSE 'text' END AS kind FROM c2),
counted AS (SELECT filename, path, count(*) FILTER (kind = 'text') AS text, count(*) FILTER (kind = 'time') AS time, count(*) FILTER (kind = 'boolean') AS boolean, count(*) FILTER (kind = 'decimal') AS decimal,
 count(*) FILTER (kind = 'integer') AS integer, count(*) FILTER (kind IS NULL) AS empty FROM cells GROUP BY ALL),
types AS (SELECT *, [text, time, boolean, CASE WHEN decimal > 0 THEN decimal + integer ELSE 0 END, CASE WHEN decimal = 0 THEN integer ELSE 0 END] AS n FROM counted),
typed AS (SELECT * EXCLUDE (n), CASE WHEN list_max(n) > 0 THEN ['text', 'time', 'boolean', 'decimal', 'integer'][list_position(n, list_max(n))] END AS type FROM types)"""
SQL["p3_types"] = f"WITH {_LINES} SELECT filename, path, text, time, boolean, decimal, integer, empty, type FROM typed"

# Times in captures are ISO texts in UTC or plain numbers. Two rounds of mutual best choose among fields that agree.
def _instant(x: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({x}, '\\d{{12,13}}') THEN CAST({x} AS BIGINT) * 1000 WHEN regexp_full_match({x}, '\\d{{15,16}}') THEN CAST({x} AS BIGINT)"
        f" WHEN regexp_full_match({x}, '\\d{{9,10}}(\\.\\d+)?') THEN CAST(CAST({x} AS DECIMAL(30, 6)) * 1000000 AS BIGINT)"
        f" ELSE epoch_us(TRY_CAST({x}[1:10] || ' ' || {x}[12:19] AS TIMESTAMP)) + coalesce(TRY_CAST(rpad(regexp_extract({x}, '\\.(\\d{{1,6}})', 1), 6, '0') AS BIGINT), 0) END"
    )


def _number(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '^[^\\d.+-]{{0,3}}\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)\\s*[A-Za-z%]{{0,4}}$', 1), '') AS DOUBLE)"


_DRIFT = f"""versions AS (SELECT filename, min(dataset_id) AS dataset_id, min(list_transform(list_filter(string_split(regexp_replace(dataset_version, '[^0-9.]+', '', 'g'), '.'), lambda x: x <> ''), lambda x: TRY_CAST(x AS INTEGER))) AS version
 FROM registry WHERE filename IS NOT NULL AND dataset_id IS NOT NULL GROUP BY 1),
files AS (SELECT dataset_id, v.filename, fields, lag(v.filename) OVER w AS before, lag(fields) OVER w AS old_fields FROM heads h JOIN versions v ON h.filename = v.filename WINDOW w AS (PARTITION BY dataset_id ORDER BY version NULLS FIRST, v.filename)),
pairs AS (SELECT *, list_filter(old_fields, lambda x: NOT list_contains(fields, x)) AS gone, list_filter(fields, lambda x: NOT list_contains(old_fields, x)) AS new FROM files WHERE before IS NOT NULL),
clocks AS (SELECT filename, line_no, arg_min(x, place) AS x FROM cells WHERE kind = 'time' OR regexp_full_match(x, '\\d{{12,16}}|\\d{{9,10}}\\.\\d+|1\\d{{9}}') GROUP BY ALL),
bars AS (SELECT filename, line_no, {_instant('x')} AS bar FROM clocks),
sides AS (SELECT filename, filename AS pair, true AS later, unnest(new) AS path FROM pairs WHERE len(gone) > 0 AND len(new) > 0 UNION ALL SELECT before, filename, false, unnest(gone) FROM pairs WHERE len(gone) > 0 AND len(new) > 0),
said AS (SELECT DISTINCT pair, later, bar, s.path, CASE WHEN kind = 'time' OR regexp_full_match(x, '\\d{{12,16}}') THEN CAST(bar AS VARCHAR)
 ELSE coalesce(CASE WHEN kind <> 'boolean' THEN CAST({_number('x')} AS VARCHAR) END, lower(x)) END AS v
 FROM bars b JOIN sides s ON b.filename = s.filename JOIN cells c ON c.filename = b.filename AND c.line_no = b.line_no AND c.path = s.path WHERE bar IS NOT NULL AND x <> ''),
agree AS (SELECT a.pair, b.path AS old_name, a.path AS new_name, count(*) AS n FROM said a JOIN said b ON a.pair = b.pair AND a.bar = b.bar AND a.later AND NOT b.later GROUP BY ALL HAVING count(*) >= 2 AND bool_and(a.v = b.v)),
r1 AS (SELECT * FROM agree QUALIFY row_number() OVER (PARTITION BY pair, old_name ORDER BY n DESC, old_name, new_name) = 1 AND row_number() OVER (PARTITION BY pair, new_name ORDER BY n DESC, old_name, new_name) = 1),
left_ AS (SELECT a.* FROM agree a WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.pair = a.pair AND (r1.old_name = a.old_name OR r1.new_name = a.new_name))),
r2 AS (SELECT * FROM left_ QUALIFY row_number() OVER (PARTITION BY pair, old_name ORDER BY n DESC, old_name, new_name) = 1 AND row_number() OVER (PARTITION BY pair, new_name ORDER BY n DESC, old_name, new_name) = 1),
renamed AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2)"""
SQL["p3_found"] = f"""WITH {_LINES}, {_DRIFT},
ends AS (SELECT dataset_id, filename, unnest(new) AS name, true AS later FROM pairs UNION ALL SELECT dataset_id, filename, unnest(gone), false FROM pairs)
SELECT dataset_id, filename, CASE WHEN later THEN 'added' ELSE 'removed' END AS change, CASE WHEN later THEN '' ELSE name END AS old_name, CASE WHEN later THEN name ELSE '' END AS new_name FROM ends e
 WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.pair = e.filename AND CASE WHEN e.later THEN r.new_name ELSE r.old_name END = e.name)
UNION ALL SELECT v.dataset_id, r.pair, 'renamed', r.old_name, r.new_name FROM renamed r JOIN versions v ON v.filename = r.pair
UNION ALL SELECT p.dataset_id, p.filename, 'retyped', a.path, a.path FROM pairs p JOIN typed a ON a.filename = p.filename JOIN typed b ON b.filename = p.before AND b.path = a.path WHERE a.type <> b.type
UNION ALL SELECT DISTINCT g.dataset_id, g.filename, 'mislabelled', lower(trim(source_schema)), '' FROM registry g JOIN heads h ON g.filename = h.filename WHERE list_sort(h.fields) <> list_sort(CASE lower(trim(source_schema))
 WHEN 'recorder_v1' THEN ['opentimeutc', 'open', 'high', 'low', 'close', 'tickvolume'] WHEN 'recorder_v1_1' THEN ['opentimeutc', 'open', 'high', 'low', 'close', 'tickvolume', 'spread'] WHEN 'fixture_v1' THEN ['datetime', 'open', 'high', 'low', 'close', 'volume'] END)"""

# Fields under their first names, followed forward from the version that begins them.
_TEXTS = ", ".join(f"max(CASE WHEN called = '{n}' THEN x END) AS {n}" for n in ("open", "high", "low", "close", "spread", "tickvolume", "volume", "opentimeutc", "datetime"))
_NAMED = ["open", "high", "low", "close", "volume", "spread"]
SQL["p3_bar_values"] = f"""WITH RECURSIVE {_LINES}, {_DRIFT},
placed AS (SELECT v.dataset_id, h.filename, fields, row_number() OVER (PARTITION BY dataset_id ORDER BY version NULLS FIRST, h.filename) AS k FROM heads h JOIN versions v ON h.filename = v.filename),
nodes AS (SELECT dataset_id, filename, k, unnest(fields) AS path FROM placed),
back AS (SELECT n.*, coalesce(r.old_name, n.path) AS q FROM nodes n LEFT JOIN renamed r ON r.pair = n.filename AND r.new_name = n.path),
lineage(dataset_id, k, filename, path, name) AS (SELECT b.dataset_id, b.k, b.filename, b.path, b.path FROM back b WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.dataset_id = b.dataset_id AND p.k = b.k - 1 AND p.path = b.q)
 UNION ALL SELECT b.dataset_id, b.k, b.filename, b.path, l.name FROM lineage l JOIN back b ON b.dataset_id = l.dataset_id AND b.k = l.k + 1 AND b.q = l.path),
first_ AS (SELECT c.filename, c.line_no, c.place, x, coalesce(l.name, c.path) AS name FROM cells c LEFT JOIN lineage l ON l.filename = c.filename AND l.path = c.path),
called_ AS (SELECT *, CASE WHEN place = min(place) OVER (PARTITION BY filename, line_no, name) THEN name ELSE name || '#' || place END AS called FROM (SELECT DISTINCT * FROM first_)),
wide AS (SELECT filename, line_no, {_TEXTS}, count(DISTINCT called) FILTER (called NOT IN ('open', 'high', 'low', 'close', 'spread', 'tickvolume', 'volume', 'opentimeutc', 'datetime')) AS n_others FROM called_ GROUP BY ALL),
texts AS (SELECT filename, line_no, n_others, nullif(coalesce(opentimeutc, datetime), '') AS t, nullif(open, '') AS open, nullif(high, '') AS high, nullif(low, '') AS low, nullif(close, '') AS close, nullif(coalesce(tickvolume, volume), '') AS volume,
 nullif(spread, '') AS spread FROM wide)
SELECT v.dataset_id, t.filename, t.line_no, {_instant('t.t')} AS time_us, {', '.join(f"{_number('t.' + c)} AS {c}" for c in _NAMED)}, CAST(n_others AS INTEGER) AS n_others,
 array_to_string(list_filter([CASE WHEN t.t IS NOT NULL AND {_instant('t.t')} IS NULL THEN 'time' END, {', '.join(f"CASE WHEN t.{c} IS NOT NULL AND {_number('t.' + c)} IS NULL THEN '{c}' END" for c in _NAMED)}], lambda x: x IS NOT NULL), ',') AS failed
 FROM texts t LEFT JOIN versions v ON v.filename = t.filename"""

# The notations one by one; wall times by the zones of the embedded calendar library. Abbreviations are those of the recorders' zones.
_CLOCK = r"(?:[Tt ]\s*(?P<h>\d{1,2}):(?P<n>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<p>[AaPp][Mm]))?(?:\s*(?P<z>[+-]\d{2}:?\d{2}|[A-Za-z]{1,5}))?(?:\s*\[(?P<r>[A-Za-z_/+0-9-]+)\])?)?"
_FORMS = [
    (r"(?P<y>\d{4})[-./](?P<m>\d{1,2})[-./](?P<d>\d{1,2})" + _CLOCK, "ymd"),
    (r"(?P<i>\d{1,2})/(?P<j>\d{1,2})/(?P<y>\d{4})" + _CLOCK, "yij"),
    (r"(?:[A-Za-z]{3,9},?\s+)?(?P<d>\d{1,2})[- ](?P<o>[A-Za-z]{3,9})[- ](?P<y>\d{4})" + _CLOCK, "ydo"),
    (r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[Tt ](?P<h>\d{2})(?P<n>\d{2})(?P<s>\d{2})(?:[.,](?P<f>\d+))?(?:\s*(?P<z>[+-]\d{2}:?\d{2}|[A-Za-z]{1,5}))?(?:\s*\[(?P<r>[A-Za-z_/+0-9-]+)\])?", "ymd"),
]


def _form(pattern: str, own: str) -> str:
    import re

    groups = re.findall(r"\(\?P<(\w)>", pattern)
    part = lambda g: f"nullif(q.{g}, '')" if g in groups else "NULL"
    whole = lambda g: f"CAST({part(g)} AS INTEGER)"
    month = {"ymd": whole("m"), "yij": f"CASE date_order WHEN 'mdy' THEN {whole('i')} WHEN 'dmy' THEN {whole('j')} END", "ydo": f"(CAST(strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(left({part('o')}, 3))) AS INTEGER) + 2) // 3"}[own]
    day = f"CASE date_order WHEN 'mdy' THEN {whole('j')} WHEN 'dmy' THEN {whole('i')} END" if own == "yij" else whole("d")
    names = ", ".join(f"'{g}'" for g in groups)
    return f"""SELECT source_table, row_id, dataset_id, bar_index, plain, zone, {whole('y')} AS y, {month} AS m, {day} AS d, coalesce({whole('h')}, 0) AS h, coalesce({whole('n')}, 0) AS n, coalesce({whole('s')}, 0) AS s,
 CAST(coalesce(rpad(left({part('f')}, 6), 6, '0'), '0') AS INTEGER) AS f, lower({part('p')}) AS p, upper({part('z')}) AS z, {part('r')} AS r
 FROM (SELECT *, regexp_extract(x, '^{pattern}$', [{names}]) AS q FROM texts WHERE regexp_full_match(x, '{pattern}'))"""


SQL["p2_found"] = rf"""WITH rec AS (SELECT recorder_id, min(zone) AS zone, lower(trim(min(date_order))) AS date_order FROM recorders GROUP BY 1),
abbreviations(zone, name, offset_s) AS (VALUES ('Europe/London', 'GMT', 0), ('Europe/London', 'BST', 3600), ('America/New_York', 'EST', -18000), ('America/New_York', 'EDT', -14400), ('Europe/Berlin', 'CET', 3600), ('Europe/Berlin', 'CEST', 7200),
 ('Asia/Tokyo', 'JST', 32400), ('Asia/Kolkata', 'IST', 19800), ('Australia/Sydney', 'AEST', 36000), ('Australia/Sydney', 'AEDT', 39600), ('America/Chicago', 'CST', -21600), ('America/Chicago', 'CDT', -18000)),
rows_ AS (SELECT 'bars' AS source_table, row_id, OpenTimeUtc AS x0, recorder_id, dataset_id, bar_index, regexp_full_match(OpenTimeUtc, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}\.\d{{7}}Z') AS plain FROM bars
 UNION ALL SELECT 'registry', row_id, first_timestamp, recorder_id, NULL, NULL, regexp_full_match(first_timestamp, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}\.\d{{7}}Z') FROM registry
 UNION ALL SELECT 'eurusd_quotes', row_id, ts_utc, recorder_id, NULL, NULL, regexp_full_match(ts_utc, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}\+00:00') FROM eurusd_quotes),
texts AS (SELECT r.*, zone, date_order, regexp_replace(x0, '^[\s' || chr(65279) || chr(160) || ']+|[\s' || chr(160) || ']+$', '', 'g') AS x FROM rows_ r LEFT JOIN rec ON r.recorder_id = rec.recorder_id WHERE x0 IS NOT NULL),
parts AS ({" UNION ALL ".join(_form(*f) for f in _FORMS)}),
hours AS (SELECT *, CASE WHEN p IS NULL THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE p WHEN 'pm' THEN 12 ELSE 0 END END AS hh FROM parts),
walls AS (SELECT *, TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', y, m, d, hh, n, s) AS TIMESTAMP) AS w FROM hours WHERE m BETWEEN 1 AND 12 AND hh <= 23 AND n <= 59 AND s <= 59),
zoned AS (SELECT w.*, CASE WHEN z IS NULL THEN NULL WHEN z ~ '^[+-].*' THEN (CAST(z[2:3] AS INTEGER) * 60 + CAST(right(z, 2) AS INTEGER)) * CASE z[1] WHEN '-' THEN -60 ELSE 60 END ELSE coalesce(a.offset_s, CASE WHEN z IN ('Z', 'UTC', 'GMT') THEN 0 END) END AS offset_s,
 CASE WHEN z IS NULL THEN coalesce(r, w.zone) END AS wall_zone FROM walls w LEFT JOIN abbreviations a ON a.zone = w.zone AND a.name = w.z WHERE w IS NOT NULL),
shifted AS (SELECT *, unnest([-3600, 0, 3600]) AS by_s FROM zoned WHERE wall_zone IS NOT NULL AND wall_zone IN (SELECT name FROM pg_timezone_names())),
tried AS (SELECT source_table, row_id, dataset_id, bar_index, plain, f, w, wall_zone, timezone(wall_zone, w) + to_seconds(by_s) AS u FROM shifted),
ways AS (SELECT source_table, row_id, dataset_id, bar_index, plain, epoch_us(min(u)) + any_value(f) AS early, epoch_us(max(u)) + any_value(f) AS late FROM tried WHERE timezone(wall_zone, u) = w GROUP BY ALL),
fixed AS (SELECT source_table, row_id, dataset_id, bar_index, plain, epoch_us(w) + f - offset_s * 1000000::BIGINT AS early FROM zoned WHERE offset_s IS NOT NULL),
numbers AS (SELECT source_table, row_id, dataset_id, bar_index, plain, regexp_extract(x, '^(\d+)', 1) AS e, regexp_extract(x, '\.(\d+)$', 1) AS g FROM texts WHERE regexp_full_match(x, '(?:\d{{9,10}}|\d{{12,13}}|\d{{15,16}})(?:\.\d+)?')),
counted AS (SELECT source_table, row_id, dataset_id, bar_index, plain, CASE WHEN length(e) <= 10 THEN CAST(e AS BIGINT) * 1000000 + CAST(rpad(left(g, 6), 6, '0') AS BIGINT) WHEN length(e) <= 13 THEN CAST(e AS BIGINT) * 1000 + CAST(rpad(left(g, 3), 3, '0') AS BIGINT) ELSE CAST(e AS BIGINT) END AS early FROM numbers),
known AS (SELECT source_table, row_id, dataset_id, bar_index, plain, early, late FROM ways UNION ALL SELECT *, early FROM fixed UNION ALL SELECT *, early FROM counted),
at_ AS (SELECT dataset_id, bar_index, min(early) AS lo, max(CASE WHEN early <> late THEN early END) AS flag, max(CASE WHEN early <> late THEN late END) AS lo2 FROM known WHERE dataset_id IS NOT NULL AND bar_index IS NOT NULL GROUP BY ALL),
b1 AS (SELECT *, max(lo) OVER (PARTITION BY dataset_id ORDER BY bar_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM at_),
b2 AS (SELECT *, max(CASE WHEN before >= flag THEN lo2 ELSE lo END) OVER (PARTITION BY dataset_id ORDER BY bar_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before2 FROM b1)
SELECT source_table, row_id, CASE WHEN b2.before2 >= b2.flag THEN late ELSE early END AS utc_us FROM known k LEFT JOIN b2 ON k.dataset_id = b2.dataset_id AND k.bar_index = b2.bar_index WHERE NOT plain"""
