"""The oracles' SQL, written for DuckDB from the rules, without the Spark code."""

from __future__ import annotations

from .sched import SCHED

GROUP = r"\d+[A-Z](?:\d+)?"
ROOM = r"[^()]{1,50}"
FORMS = (
    rf"(?i)(.+?)\s*-\s*({GROUP})\*?\s*\(({ROOM})\)",
    rf"(?i)(.+?)\s*\(({ROOM})\)\s*-\s*({GROUP})",
    rf"(?i)^({GROUP})\s*\(({ROOM})\)\s+(.+?)\s*[-]?$",
    r"(?i)^(.+?)\s*\(([^)]+)\)$",
)
SCHED_SQL = SCHED.replace("{orders}", "orders").replace("{customer}", "customer")


def clean(x: str) -> str:
    return f"trim(regexp_replace(translate(coalesce({x}, ''), chr(160) || '–—', ' --'), '\\s+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"strip_accents(coalesce({x}, ''))"


def comparable(x: str) -> str:
    return f"upper(strip_accents(replace({clean(x)}, 'ß', 'SS')))"


def filled(x: str, value: str) -> str:
    return f"CASE WHEN coalesce({x}, '') <> '' THEN {value} END"


def hour(x: str) -> str:
    return filled(x, f"CASE WHEN regexp_full_match({clean(x)}, '\\d{{1,2}}:\\d{{2}}') THEN lpad({clean(x)}, 5, '0') ELSE {clean(x)} END")


def year(x: str) -> str:
    p = r"^(\d{4})/(\d{2,4})"
    a, b = (f"regexp_extract({clean(x)}, '{p}', {i})" for i in (1, 2))
    return filled(x, f"CASE WHEN regexp_matches({clean(x)}, '{p}') THEN {a} || '/' || CASE WHEN length({b}) = 2 THEN left({a}, 2) || {b} ELSE CAST(CAST({b} AS INT) AS VARCHAR) END ELSE {clean(x)} END")


def group(x: str) -> str:
    return filled(x, comparable(f"translate({clean(x)}, 'º', '')").replace("upper(", "replace(upper(", 1) + ", ' ', '')")


def room(x: str) -> str:
    return filled(x, f"upper(regexp_replace({clean(x)}, '\\b([A-Za-z]{{1,3}})\\s+(\\d+)\\b', '\\1\\2', 'g'))")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\-*]+|[ \\-*]+$', '', 'g')"


def subject(x: str) -> str:
    return filled(x, f"upper({strip(clean(x))})")


def subject_name(x: str) -> str:
    t = clean(x)
    for p in (rf"(?i)^{GROUP}\s*\([^)]+\)\s*", r"^\([^)]+\)\s*", r"(?i)^[A-ZÁÉÍÓÚÑ]{1,6}\.?\s*\d{3,8}\s*-\s*"):
        t = f"regexp_replace({t}, '{p}', '')"
    return f"nullif({strip(clean(t))}, '')"


def minutes(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '\\d+:\\d+') THEN CAST(split_part({x}, ':', 1) AS INT) * 60 + CAST(split_part({x}, ':', 2) AS INT) END"


PLAIN = rf"""sched AS ({SCHED_SQL}),
plain AS (SELECT *, {clean(r"regexp_replace(coalesce(cell_text, ''), '\b\d{1,2}:\d{2}\s*/\s*\d{1,2}:\d{2}\b', ' ', 'g')")} AS t FROM sched)"""
_KEEP = "ord, file, page, degree_name, academic_year_raw, semester, year, grp, day, start_time, end_time, cell_text"
_ALL = lambda f, i: f"regexp_extract_all(t, '{FORMS[f]}', {i})"
_ONE = lambda f, i: f"regexp_extract(t, '{FORMS[f]}', {i})"


def many(form: int, name: int, sub: int, rm: int, where: str) -> str:
    pick = lambda i: f"{_ALL(form, i)}[CAST(pos AS INT) + 1]"
    return f"SELECT {_KEEP}, CAST(pos AS INT) AS pos, {pick(name)} AS n, {pick(sub)} AS s, {pick(rm)} AS r, {pick(0)} AS raw FROM (SELECT *, unnest(range(len({_ALL(form, 0)}))) AS pos FROM formed WHERE {where})"


def one(form: int, name: int, sub: int | None, rm: int, where: str) -> str:
    s = _ONE(form, sub) if sub else "CAST(NULL AS VARCHAR)"
    return f"SELECT {_KEEP}, CAST(0 AS INT) AS pos, {_ONE(form, name)} AS n, {s} AS s, {_ONE(form, rm)} AS r, t AS raw FROM formed WHERE {where}"


_FORM = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {i}" for i, p in enumerate(FORMS)) + " ELSE 4 END"
PARSED = f"""{PLAIN},
formed AS (SELECT *, {_FORM} AS form FROM plain),
parsed AS ({many(0, 1, 2, 3, 'form = 0')} UNION ALL {many(1, 1, 3, 2, 'form = 1')} UNION ALL {one(2, 3, 1, 2, 'form = 2')} UNION ALL {one(3, 1, None, 2, 'form = 3')}
  UNION ALL SELECT {_KEEP}, CAST(0 AS INT) AS pos, NULL AS n, NULL AS s, NULL AS r, cell_text AS raw FROM formed WHERE form = 4),
subjects AS (SELECT {_KEEP}, pos, {subject_name('n')} AS s_name, {group('s')} AS s_sub, {room('r')} AS s_room, {clean('raw')} AS raw_text FROM parsed)"""
NORMAL = f"""{PARSED},
normal AS (SELECT ord, pos, file, page, CAST(NULL AS VARCHAR) AS degree_code, degree_name, {year('academic_year_raw')} AS academic_year, semester, year, {group('grp')} AS grp,
  {comparable('day')} AS day, {hour('start_time')} AS start_time, {hour('end_time')} AS end_time, {subject('s_name')} AS name, {group('s_sub')} AS subgroup, {room('s_room')} AS room, raw_text FROM subjects)"""
_NAME = comparable("name")
_ROOM = comparable("room")
RECORDS = rf"""{NORMAL},
flagged AS (SELECT *,
  CASE WHEN {comparable('day')} NOT IN ('LUNES','MARTES','MIERCOLES','JUEVES','VIERNES') THEN 'invalid_day' END AS i1,
  CASE WHEN NOT coalesce({minutes('end_time')} > {minutes('start_time')}, false) THEN 'invalid_time' END AS i2,
  CASE WHEN coalesce(name, '') = '' THEN 'missing_subject'
       WHEN length({_NAME}) < 3 OR NOT regexp_matches({_NAME}, '[A-Z]{{3,}}') OR regexp_full_match({_NAME}, '\d+[A-Z]\d*|\([A-Z0-9]+\)|-\s*\d+[A-Z]\d*|\d+') THEN 'invalid_subject_name'
       WHEN regexp_matches({_NAME}, '^(DE|DEL|LA|EL|LOS|LAS|EN|Y|A|AL|CON|PARA|POR)\b') AND len(string_split({_NAME}, ' ')) <= 3 THEN 'fragmented_subject' END AS i3,
  CASE WHEN coalesce(trim(room), '') = '' THEN 'missing_classroom'
       WHEN {_ROOM} IN ('*','-','--','N/A','NA') OR regexp_matches({_ROOM}, '^PEND\.?(IENTE)?\s*(DE\s*)?ASIG') THEN 'suspicious_classroom'
       WHEN regexp_matches(room, '\d{{1,2}}[:.]\d{{2}}') THEN 'invalid_classroom'
       WHEN NOT regexp_full_match({_ROOM}, '[A-Z]{{1,4}}\d{{1,3}}[A-Z]?(?:[/-][A-Z]{{1,4}}\d{{1,3}}[A-Z]?)*') THEN 'unknown_classroom' END AS i4,
  CASE WHEN coalesce(academic_year, '') = '' THEN 'missing_academic_year'
       WHEN NOT regexp_full_match(academic_year, '\d{{4}}/\d{{4}}') THEN 'invalid_academic_year'
       WHEN CAST(right(academic_year, 4) AS INT) <> CAST(left(academic_year, 4) AS INT) + 1 THEN 'invalid_academic_year' END AS i5,
  CASE WHEN coalesce(degree_name, '') = '' THEN 'missing_degree' END AS i6,
  CASE WHEN coalesce(grp, '') <> '' AND coalesce(subgroup, '') <> '' AND NOT starts_with(upper(subgroup), upper(grp)) THEN 'incompatible_subgroup' END AS i7
  FROM normal),
scored AS (SELECT *, concat_ws(',', i1, i2, i3, i4, i5, i6, i7) AS issues,
  round(greatest(0.0, least(1.0, 1.0::DOUBLE - (CASE WHEN i1 IS NULL THEN 0 ELSE 0.4 END + CASE WHEN i2 IS NULL THEN 0 ELSE 0.4 END + CASE i3 WHEN 'fragmented_subject' THEN 0.6 WHEN 'missing_subject' THEN 0.4 WHEN 'invalid_subject_name' THEN 0.4 ELSE 0 END
   + CASE WHEN i4 IS NULL THEN 0 WHEN i4 = 'invalid_classroom' THEN 0.4 ELSE 0.15 END + CASE i5 WHEN 'missing_academic_year' THEN 0.1 WHEN 'invalid_academic_year' THEN 0.4 ELSE 0 END + CASE WHEN i6 IS NULL THEN 0 ELSE 0.15 END + CASE WHEN i7 IS NULL THEN 0 ELSE 0.15 END)::DOUBLE)), 2) AS confidence
  FROM flagged),
records AS (SELECT * EXCLUDE (room), CASE WHEN i4 IS NULL OR i4 = 'unknown_classroom' THEN trim(room) END AS classroom,
  i1 IS NULL AND i2 IS NULL AND coalesce(i3, '') NOT IN ('missing_subject', 'invalid_subject_name') AND coalesce(i4, '') <> 'invalid_classroom' AND coalesce(i5, '') <> 'invalid_academic_year' AND confidence >= 0.55 AS accepted FROM scored)"""
ITEMS = rf"""{RECORDS},
seqs AS (SELECT *, CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END AS origin, row_number() OVER (PARTITION BY accepted, file, page ORDER BY ord, pos) AS seq,
  CASE WHEN NOT accepted THEN 'INVALID' WHEN issues <> '' THEN 'WARNING' ELSE 'VALID' END AS status, row_number() OVER (ORDER BY CASE WHEN accepted THEN 0 ELSE 1 END, ord, pos) AS item_ord FROM records),
items AS (SELECT *, left(origin, 1) || left(sha1(origin || '|' || coalesce(file, 'None') || '|' || coalesce(CAST(page AS VARCHAR), 'None') || '|' || CAST(seq AS VARCHAR)), 20) AS id FROM seqs)"""
