"""SQL (DuckDB) for instants and typed offer values, written apart from the operators to check them."""

from __future__ import annotations

FORMATS = "'%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y%m%dT%H%M%S', '%d.%m.%Y %H:%M', '%b %d %Y %I:%M%p', '%a, %d %b %Y %H:%M:%S'"
SLASHES = {"mdy": "%m/%d/%Y", "dmy": "%d/%m/%Y", "ymd": "%Y/%m/%d"}
DAYS = "'%Y-%m-%d', '%d.%m.%Y'"


def instants(rows: str) -> str:
    """A query of rows (keep columns, raw, feed_code) with us: microseconds of the single instant raw denotes, or null."""
    slash = lambda tail: "CASE day_order " + " ".join(f"WHEN '{k}' THEN try_strptime(body, '{v}{tail}')" for k, v in SLASHES.items()) + " END"
    offset = lambda m: f"(epoch(TIMESTAMP '2024-{m}-01 12:00') - epoch(timezone(tz_name, TIMESTAMP '2024-{m}-01 12:00')))"
    return f"""
    SELECT r.*, CASE
      WHEN moment IS NULL AND day IS NULL THEN NULL
      WHEN moment IS NULL THEN epoch_us(timezone(tz_name, day))
      WHEN zone_off = 'Z' THEN epoch_us(moment)
      WHEN zone_off <> '' THEN epoch_us(moment) - 60000000::BIGINT * (CASE WHEN zone_off[1] = '-' THEN -1 ELSE 1 END) * (60 * CAST(replace(zone_off, ':', '')[2:3] AS INT) + CAST(replace(zone_off, ':', '')[4:5] AS INT))
      WHEN zone_abbr IN ('UTC', 'GMT') THEN epoch_us(moment)
      WHEN zone_abbr <> '' THEN CASE WHEN zone_abbr = std_abbr THEN epoch_us(moment) - 1000000::BIGINT * least(o1, o7) WHEN zone_abbr = dst_abbr THEN epoch_us(moment) - 1000000::BIGINT * greatest(o1, o7) END
      WHEN timezone(clock, timezone(clock, moment)) <> moment THEN NULL
      WHEN timezone(clock, timezone(clock, moment) + INTERVAL 1 HOUR) = moment OR timezone(clock, timezone(clock, moment) - INTERVAL 1 HOUR) = moment THEN NULL
      ELSE epoch_us(timezone(clock, moment)) END AS us
    FROM (
      SELECT p.*, CASE WHEN zone_name <> '' THEN zone_name ELSE tz_name END AS clock, {offset("01")} AS o1, {offset("07")} AS o7,
        CASE WHEN regexp_full_match(raw, '[0-9]{{10}}') THEN make_timestamp(CAST(raw AS BIGINT) * 1000000) WHEN regexp_full_match(raw, '[0-9]{{13}}') THEN make_timestamp(CAST(raw AS BIGINT) * 1000)
          WHEN body LIKE '%/%' THEN coalesce({slash(" %H:%M")}, {slash(" %I:%M %p")}) ELSE try_strptime(body, [{FORMATS}]) END AS moment,
        CASE WHEN regexp_full_match(raw, '[0-9]{{8}}') THEN try_strptime(raw, '%Y%m%d') WHEN body LIKE '%/%' THEN {slash("")} ELSE try_strptime(body, [{DAYS}]) END AS day
      FROM (
        SELECT s.*, CASE WHEN regexp_full_match(raw, '[0-9]{{10}}|[0-9]{{13}}') THEN 'Z' ELSE regexp_extract(bare, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', 1) END AS zone_off, regexp_extract(bare, ' ([A-Z]{{3,5}})$', 1) AS zone_abbr,
          trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', ''), ' [A-Z]{{3,5}}$', ''), '([.][0-9]{{6}})[0-9]+', '\\1'), ' +', ' ', 'g')) AS body
        FROM (SELECT q.*, regexp_extract(raw, '\\[(.*)\\]$', 1) AS zone_name, regexp_replace(raw, '\\[.*\\]$', '') AS bare, f.tz_name, f.day_order, f.std_abbr, f.dst_abbr FROM ({rows}) q LEFT JOIN feed_zones f USING (feed_code)) s) p) r"""


def normalised(tables: tuple[tuple[str, str], ...]) -> str:
    """SQL of p7_found."""
    rows = " UNION ALL ".join(f"SELECT '{t}' AS table_name, _id AS row_id, '{c}' AS field_name, {c} AS raw, feed_code FROM {t} WHERE NOT regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[.][0-9]{{3}}Z')" for t, c in tables)
    return f"SELECT table_name, row_id, field_name, CAST(us AS BIGINT) AS utc_micros FROM ({instants(rows)}) WHERE us IS NOT NULL"


def typed(column: str) -> str:
    """One text for each typed value of a column beside value_type; null where it clears or can't be read."""
    v = f"trim({column})"
    bare = f"regexp_replace({v}, '[ $€£¥%]', '', 'g')"
    number = f"CASE WHEN regexp_full_match({bare}, '[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]*)?') OR regexp_full_match({bare}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(replace({bare}, ',', '') AS DECIMAL(38, 9)) END"
    day = f"try_strptime(regexp_replace({v}, '[T ]00:00(:00([.]0+)?)?Z?$', ''), ['%Y-%m-%d', '%Y/%m/%d', '%Y%m%d', '%d %b %Y', '%d.%m.%Y'])"
    return f"""CASE WHEN {column} IS NULL OR lower({v}) IN ('', 'null') THEN NULL WHEN value_type = 'text' THEN lower({v}) WHEN value_type = 'decimal' THEN CAST({number} AS VARCHAR)
      WHEN value_type = 'integer' THEN CASE WHEN ({number}) = floor({number}) THEN CAST({number} AS VARCHAR) END
      WHEN value_type = 'boolean' THEN CASE WHEN lower({v}) IN ('true', 'yes', 'y', '1') THEN 'true' WHEN lower({v}) IN ('false', 'no', 'n', '0') THEN 'false' END
      WHEN value_type = 'date' THEN strftime({day}, '%Y-%m-%d') END"""


ROWS = "SELECT h._id AS row_id, lower(trim(h.ParentId)) AS parent_id, f.field_name, f.value_type, h.OldValue AS ov, h.NewValue AS nv, h.CreatedDate AS raw, h.feed_code FROM flat_offer_history h JOIN offer_fields f ON lower(trim(h.Field)) = lower(f.field_name) WHERE h.ParentId IS NOT NULL"
EVENTS = f"SELECT parent_id, field_name, value_type, us, row_id, new_value, old_value, nv, ov FROM (SELECT *, {typed('nv')} AS new_value, {typed('ov')} AS old_value FROM ({instants(ROWS)}) WHERE us IS NOT NULL) WHERE new_value IS NOT NULL OR nv IS NULL OR lower(trim(nv)) IN ('', 'null')"
#: SQL of p2_found and p4_found.
CELLS = f"SELECT parent_id, field_name, row_id FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, field_name ORDER BY us DESC, row_id) AS n FROM ({EVENTS})) WHERE n = 1 AND new_value IS NOT NULL"
VALUES = f"""
SELECT parent_id, field_name, CASE WHEN value_type = 'text' THEN nv WHEN value_type NOT IN ('decimal', 'integer') THEN new_value END AS text_value, CASE WHEN value_type IN ('decimal', 'integer') THEN CAST(new_value AS DOUBLE) END AS number_value
FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, field_name ORDER BY us DESC, row_id) AS n FROM ({EVENTS})) WHERE n = 1 AND new_value IS NOT NULL"""
SHOWN = "CASE WHEN value IS NULL THEN NULL WHEN value_type = 'text' THEN written WHEN value_type = 'decimal' THEN CAST(CAST(value AS DECIMAL(38, 18)) AS VARCHAR) WHEN value_type = 'integer' THEN CAST(CAST(value AS DECIMAL(38, 9))::BIGINT AS VARCHAR) ELSE value END"
PERIODS = f"""
SELECT parent_id, field_name, value_type, written, us, lead(us) OVER (PARTITION BY parent_id, field_name ORDER BY us NULLS FIRST, from_row_id) AS to_us, from_row_id, coalesce(lead(from_row_id) OVER (PARTITION BY parent_id, field_name ORDER BY us NULLS FIRST, from_row_id), '') AS to_row_id, value FROM (
  SELECT parent_id, field_name, value_type, nv AS written, us, row_id AS from_row_id, new_value AS value FROM (SELECT *, lag(new_value) OVER w AS before, row_number() OVER w AS n FROM ({EVENTS}) WINDOW w AS (PARTITION BY parent_id, field_name ORDER BY us, row_id))
  WHERE new_value IS DISTINCT FROM (CASE WHEN n = 1 THEN old_value ELSE before END)
  UNION ALL SELECT parent_id, field_name, value_type, ov, NULL, '', old_value FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, field_name ORDER BY us, row_id) AS n FROM ({EVENTS})) WHERE n = 1 AND old_value IS NOT NULL)"""
SPANS = f"SELECT parent_id, field_name, {SHOWN} AS value, make_timestamp(us::BIGINT) AS valid_from, make_timestamp(to_us::BIGINT) AS valid_to FROM ({PERIODS}) WHERE value IS NOT NULL"
PERIODS = f"SELECT parent_id, field_name, from_row_id, to_row_id FROM ({PERIODS}) WHERE value IS NOT NULL"
