"""SQL of the queries, for a second engine to run on the same tables."""

from __future__ import annotations

from .inputs import FILES_SQL, TAGS_SQL

RAD = "('PT', 'PET', 'NM', 'SPECT', 'NM/CT', 'PET/CT', 'SPECT/CT')"


def _ts(date: str, time: str) -> str:
    return f"try_strptime(substr({date}, 1, 8) || substr({time}, 1, 6), '%Y%m%d%H%M%S')"


def _seconds(t: str) -> str:
    return f"(try_cast(substr({t}, 1, 2) AS int) * 3600 + try_cast(substr({t}, 3, 2) AS int) * 60 + try_cast(substr({t}, 5, 2) AS int) + CASE WHEN strpos({t}, '.') > 0 THEN try_cast('0.' || split_part({t}, '.', 2) AS double) ELSE 0 END)"


_DELAY = f"date_diff('second', {_ts('coalesce(injection_date, study_date)', 'injection_time')}, {_ts('coalesce(acquisition_date, study_date)', 'acquisition_time')}) / 60.0"

BASE = f"""
WITH files AS ({FILES_SQL}),
series AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY coalesce(series_instance_uid, file_path) ORDER BY file_path) = 1),
known AS (SELECT *, cast({_DELAY} AS double) AS delay_signed, max(patient_weight) OVER (PARTITION BY study_instance_uid) AS study_patient_weight,
  CASE WHEN injected_activity > 1e6 THEN injected_activity / 1e6 ELSE injected_activity END AS mbq,
  coalesce(upper(trim(modality)) IN {RAD}, false) AS radiopharm,
  coalesce(abs({_seconds('series_time')} - {_seconds('study_time')}) / 60.0 > 120, false) AS conflict FROM series),
derived AS (SELECT *, coalesce(CASE WHEN patient_weight > 0 THEN patient_weight END, CASE WHEN study_patient_weight > 0 THEN study_patient_weight END, CASE WHEN patient_size > 10 AND patient_size <= 500 THEN patient_size END) AS weight_best,
  CASE WHEN delay_signed > 0 THEN delay_signed END AS delay_positive,
  CASE WHEN injection_time IS NULL OR acquisition_time IS NULL OR coalesce(injection_date, study_date) IS NULL OR coalesce(acquisition_date, study_date) IS NULL THEN 'missing'
    WHEN delay_signed IS NULL THEN 'parse_fail' WHEN delay_signed < 0 THEN 'negative' WHEN delay_signed > 240 THEN 'too_long' ELSE 'ok' END AS status,
  mbq / nullif(CASE WHEN patient_weight > 0 THEN patient_weight WHEN study_patient_weight > 0 THEN study_patient_weight END, 0) AS dose_ingest,
  CASE WHEN study_patient_weight > 0 THEN injected_activity / study_patient_weight END AS quotient FROM known),
scored AS (SELECT *, mbq / weight_best AS dose_plausible, CASE WHEN mbq / weight_best > 0 AND mbq / weight_best < 100 THEN mbq / weight_best END AS dose_dashboard,
  CASE WHEN (CASE WHEN quotient > 1e6 THEN quotient / 1e6 ELSE quotient END) > 0 AND (CASE WHEN quotient > 1e6 THEN quotient / 1e6 ELSE quotient END) < 100 THEN (CASE WHEN quotient > 1e6 THEN quotient / 1e6 ELSE quotient END) END AS dose_listing FROM derived),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY series_instance_uid ORDER BY coalesce(number_of_slices, 0) DESC, series_time ASC NULLS LAST, series_number ASC NULLS LAST, file_path) = 1),
rep AS (SELECT *, delay_positive AS delay_minutes, dose_listing AS dose_per_kg,
  CASE WHEN dose_listing IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN delay_positive IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN radiopharm THEN 1 ELSE 0 END AS score FROM best
  QUALIFY row_number() OVER (PARTITION BY study_instance_uid ORDER BY score DESC, file_path) = 1),
by_modality AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY study_instance_uid, modality ORDER BY coalesce(number_of_slices, 0) DESC, series_time ASC NULLS LAST, series_number ASC NULLS LAST, file_path) = 1),
ingest AS (SELECT *, CASE WHEN dose_ingest IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN delay_signed IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN coalesce(modality IN {RAD}, false) THEN 1 ELSE 0 END AS score FROM scored WHERE series_instance_uid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY study_instance_uid ORDER BY score DESC, file_path) = 1),
existing AS (SELECT * FROM files WHERE cast(split_part(study_instance_uid, '.', 4) AS bigint) % 2 = 0),
majority AS (SELECT csa_series_header_hash AS hash FROM rep WHERE csa_series_header_hash <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
spread AS (SELECT avg(dose_plausible) AS dose_mean, stddev_samp(dose_plausible) AS dose_sd FROM rep WHERE radiopharm),
qa AS (SELECT rep.*, cast(patient_weight IS NOT NULL AS int) + cast(injected_activity IS NOT NULL AS int) + cast(status IN ('ok', 'too_long') AS int) + cast(status = 'ok' AND NOT conflict AS int) + cast(coalesce(csa_series_header_hash = (SELECT hash FROM majority), false) AS int) AS qa_score FROM rep),
studies AS (SELECT study_instance_uid, max(patient_birth_date) AS patient_birth_date, max(patient_sex) AS patient_sex, max(patient_age) AS patient_age, max(patient_weight) AS patient_weight, max(patient_size) AS patient_size, max(study_date) AS study_date, max(study_time) AS study_time,
  bool_or(radiopharm) AS tracer_study, coalesce(bool_or(modality = 'PT'), false) AS has_pt, coalesce(bool_or(modality = 'CT'), false) AS has_ct, count(*) AS series_count FROM scored GROUP BY 1),
tags AS ({TAGS_SQL}),
classed AS (SELECT *, CASE WHEN creator LIKE '%CTP%' THEN 'pipeline_provenance' WHEN upper(creator) LIKE '%VARIAN%' THEN 'rt_provenance'
  WHEN upper(creator) LIKE '%SIEMENS%' OR coalesce(upper(manufacturer) LIKE '%SIEMENS%', false) THEN CASE WHEN upper(creator) LIKE '%CSA%' THEN 'vendor_semantic' ELSE 'vendor_raw' END
  WHEN upper(creator) LIKE '%GE%' OR coalesce(upper(manufacturer) LIKE '%GE%', false) THEN 'vendor_raw' WHEN coalesce(upper(manufacturer) LIKE '%PHILIPS%', false) THEN 'vendor_raw'
  WHEN value_text IS NOT NULL THEN 'vendor_raw' ELSE 'unknown_binary' END AS classification FROM tags)
"""

LIST = """study_instance_uid, max(patient_id) AS patient_id, max(patient_name) AS patient_name, max(study_date) AS study_date, max(study_time) AS study_time, max(study_description) AS study_description,
  string_agg(DISTINCT modality, ',' ORDER BY modality) AS modality, string_agg(DISTINCT manufacturer, ',' ORDER BY manufacturer) AS manufacturer, string_agg(DISTINCT radiopharmaceutical, ',' ORDER BY radiopharmaceutical) AS radiopharmaceutical, count(*) AS series_count"""


def _stats(v: str, within: str = "") -> str:
    more = f", count(*) FILTER (WHERE {v} BETWEEN {within}) AS within" if within else ""
    return f"count({v}) AS n, round(avg({v}), 6) AS mean, round(median({v}), 6) AS median, round(stddev_samp({v}), 6) AS sd, round(min({v}), 6) AS min, round(max({v}), 6) AS max{more}"


def _group(key: str, name: str, where: str = "true") -> str:
    acquired = "(acquisition_time IS NOT NULL AND coalesce(acquisition_date, study_date) IS NOT NULL)"
    return f"""SELECT coalesce(nullif({key}, ''), 'Unknown') AS {name}, count(*) AS n, round(avg(delay_minutes), 6) AS uptake_mean, round(median(delay_minutes), 6) AS uptake_median, count(*) FILTER (WHERE delay_minutes BETWEEN 45 AND 75) AS uptake_within,
  round(avg(dose_dashboard), 6) AS dose_mean, round(median(dose_dashboard), 6) AS dose_median, count(*) FILTER (WHERE dose_dashboard BETWEEN 2.5 AND 3.5) AS dose_within, count(*) FILTER (WHERE weight_best IS NULL OR injected_activity IS NULL) AS missing_weight,
  count(*) FILTER (WHERE NOT ({acquired} AND injection_time IS NOT NULL AND coalesce(injection_date, study_date) IS NOT NULL)) AS missing_injection, count(*) FILTER (WHERE NOT {acquired}) AS missing_acquisition FROM rep WHERE {where} GROUP BY 1"""


def _rows(source: str, metrics: dict[str, str], value: str = "n", kind: str = "bigint", name: str = "metric") -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS {name}, cast({v} AS {kind}) AS {value} FROM {source}" for k, v in metrics.items())


def _count(where: str) -> str:
    return f"count(*) FILTER (WHERE {where})"


_AGE = "try_cast(regexp_replace(patient_age, '[^0-9]', '', 'g') AS int)"
_DEMOGRAPHICS = (
    _rows("studies", {"age 0-17": _count(f"{_AGE} <= 17"), "age 18-39": _count(f"{_AGE} BETWEEN 18 AND 39"), "age 40-59": _count(f"{_AGE} BETWEEN 40 AND 59"), "age 60-79": _count(f"{_AGE} BETWEEN 60 AND 79"), "age 80+": _count(f"{_AGE} >= 80"), "missing weight": _count("patient_weight IS NULL"), "missing height": _count("patient_size IS NULL"), "missing birth date": _count("patient_birth_date IS NULL")})
    + " UNION ALL SELECT 'sex ' || coalesce(patient_sex, 'Unknown') AS metric, count(*) AS n FROM studies GROUP BY 1"
)
_COMPLETE = {
    "weight": "s.patient_weight IS NOT NULL",
    "dose": "r.radiopharm AND r.injected_activity IS NOT NULL",
    "injection_time": "r.radiopharm AND r.injection_time IS NOT NULL",
    "acquisition_time": "r.acquisition_time IS NOT NULL",
    "radiopharmaceutical": "r.radiopharm AND r.radiopharmaceutical IS NOT NULL",
    "patient_sex": "s.patient_sex IS NOT NULL",
    "patient_age": "s.patient_age IS NOT NULL OR s.patient_birth_date IS NOT NULL",
}
_COMPLETENESS = " UNION ALL ".join(f"SELECT '{k}' AS field, {_count(v)} AS have, {_count('s.tracer_study') if k in ('dose', 'injection_time', 'radiopharmaceutical') else 'count(*)'} AS total FROM rep r JOIN studies s USING (study_instance_uid)" for k, v in _COMPLETE.items())


def _histogram(v: str, width: float, most: int) -> str:
    return f""", top AS (SELECT CASE WHEN max({v}) > 0 THEN max({v}) ELSE 1.0 END AS top FROM rep WHERE {v} IS NOT NULL),
shape AS (SELECT top, cast(greatest(1, least(ceil(top / {width}), {most})) AS int) AS bins, top / cast(greatest(1, least(ceil(top / {width}), {most})) AS int) AS step FROM top WHERE top IS NOT NULL),
counted AS (SELECT least(cast(floor({v} / step) AS int), bins - 1) AS bin, count(*) AS n FROM rep CROSS JOIN shape WHERE {v} BETWEEN 0 AND top GROUP BY 1)
SELECT cast(b.bin AS int) AS bin, round(b.bin * step, 6) AS lower_edge, coalesce(n, 0) AS n FROM shape CROSS JOIN unnest(range(bins)) b(bin) LEFT JOIN counted c ON c.bin = b.bin"""


def _display(v: str) -> str:
    date = lambda x: f"substr({x}, 7, 2) || '/' || substr({x}, 5, 2) || '/' || substr({x}, 1, 4)"
    clock = lambda x, at: f"substr({x}, {at}, 2) || ':' || substr({x}, {at + 2}, 2) || ':' || substr({x}, {at + 4}, 2)"
    return f"CASE WHEN regexp_full_match({v}, '\\d{{14}}\\.\\d+') THEN {date(v)} || ' ' || {clock(v, 9)} || '.' || substr({v}, 16, 1) ELSE coalesce({v}, value_hex) END"


def _provenance(kind: str) -> str:
    return f"SELECT series_instance_uid, creator, group_hex, element_hex, {_display('value_text')} AS display_value FROM classed SEMI JOIN rep USING (series_instance_uid) WHERE classification = '{kind}'"


UID = "SELECT study_instance_uid FROM"
_TERM = "economy"
_HIT = " OR ".join(f"contains(lower({c}), '{_TERM}')" for c in ("patient_name", "patient_id", "modality", "study_description", "manufacturer", "radiopharmaceutical", "study_id", "accession_number"))
_PLACE = "row_number() OVER (PARTITION BY study_instance_uid ORDER BY series_number ASC NULLS FIRST, series_time ASC NULLS FIRST, series_instance_uid ASC NULLS FIRST, file_path)"
_EXPORT = f"""SELECT b.study_instance_uid AS study, cast({_PLACE} AS int) AS place, patient_id, patient_sex, study_date, series_number, modality,
  CASE WHEN delay_nonneg > 0 THEN delay_nonneg END AS uptake_delay, dose_dashboard AS dose_per_kg, CASE WHEN coalesce(nullif(patient_size, 0), study_patient_size) > 0 THEN weight_best / (coalesce(nullif(patient_size, 0), study_patient_size) * coalesce(nullif(patient_size, 0), study_patient_size)) END AS bmi
  FROM (SELECT *, CASE WHEN delay_signed >= 0 THEN delay_signed END AS delay_nonneg FROM by_modality) b JOIN (SELECT study_instance_uid, max(patient_size) AS study_patient_size FROM series GROUP BY 1) i USING (study_instance_uid)"""
_START = "CASE WHEN injected_activity < 1e6 THEN injected_activity * 1e6 ELSE injected_activity END"
_LEFT = f"CASE WHEN injected_activity <> 0 AND half_life <> 0 AND d <> 0 THEN {_START} * exp(-ln(2.0::double) / half_life * d * 60) END"

_DATE = "CASE WHEN length({0}) >= 8 THEN substr({0}, 7, 2) || '/' || substr({0}, 5, 2) || '/' || substr({0}, 1, 4) ELSE coalesce({0}, '') END"
_TIME = "CASE WHEN length({0}) < 6 THEN {0} WHEN {0} IS NULL THEN '' ELSE substr({0}, 1, 2) || ':' || substr({0}, 3, 2) || ':' || substr({0}, 5, 2) || CASE WHEN strpos({0}, '.') > 0 THEN '.' || substr(split_part({0}, '.', 2), 1, 1) ELSE '' END END"
_NUMBER = "coalesce(printf('%.{1}f', {0}) || '{2}', '')"
_TEXTS = {c: f"coalesce(cast({c} AS varchar), '')" for c in ("patient_id", "series_number", "series_description", "modality", "radiopharmaceutical")}
_TEXTS |= {c: _DATE.format(c) for c in ("patient_birth_date", "study_date", "acquisition_date", "injection_date")}
_TEXTS |= {c: _TIME.format(c) for c in ("study_time", "acquisition_time", "injection_time")}
_TEXTS |= {
    "patient_name": "coalesce(array_to_string(list_filter(string_split(patient_name, '^'), lambda x: x <> ''), ' '), '')",
    "patient_weight": _NUMBER.format("patient_weight", 2, " kg"),
    "patient_size": _NUMBER.format("patient_size", 2, " m"),
    "injected_activity": _NUMBER.format("mbq", 2, " MBq"),
    "half_life": _NUMBER.format("half_life", 2, " s"),
    "dose_per_kg": _NUMBER.format("dose_per_kg", 2, " MBq/kg"),
    "bmi": _NUMBER.format("bmi", 1, ""),
    "uptake_delay": "CASE WHEN uptake_delay IS NULL THEN '' WHEN uptake_delay < 60 THEN printf('%.1f minutes', uptake_delay) WHEN uptake_delay < 1440 THEN printf('%.1f hours (%.0f min)', uptake_delay / 60, uptake_delay) ELSE printf('%.1f days (%.0f min)', uptake_delay / 1440, uptake_delay) END",
}
_EXPORT_ALL = _EXPORT.replace("patient_id, patient_sex, study_date, series_number, modality,", "b.* EXCLUDE (study_instance_uid, dose_per_kg),").replace("SELECT *, CASE WHEN delay_signed >= 0", "SELECT *, NULL AS dose_per_kg, CASE WHEN delay_signed >= 0")
_LABEL, _FLAG = "'COLL-' || cast(number_of_slices % 15 AS varchar)", "unhex(printf('%02x00', number_of_slices))"
_SHOWN = "CASE WHEN number_of_slices IN (9, 10, 13, 32) THEN '' WHEN number_of_slices BETWEEN 33 AND 126 THEN chr(number_of_slices) END"
_PRIVATE = f"""SELECT file_path, '0013' AS group_hex, e.element_hex, 'CTP' AS creator, CASE e.element_hex WHEN '1010' THEN {_LABEL} WHEN '1013' THEN patient_id ELSE {_SHOWN} END AS value_text,
  cast(CASE WHEN e.element_hex = '1015' AND number_of_slices BETWEEN 48 AND 57 THEN number_of_slices - 48 END AS double) AS value_num, CASE WHEN e.element_hex = '1015' AND ({_SHOWN}) IS NULL THEN printf('%02x00', number_of_slices) END AS value_hex,
  CASE e.element_hex WHEN '1010' THEN sha256({_LABEL}) WHEN '1013' THEN sha256(patient_id) ELSE sha256({_FLAG}) END AS value_hash, 'pipeline_provenance' AS classification FROM files CROSS JOIN (VALUES ('1010'), ('1013'), ('1015')) e(element_hex)"""
_MISSING = {
    "weight": "patient_weight IS NULL",
    "dose": "injected_activity IS NULL AND tracer_study",
    "injection_time": "injection_time IS NULL AND tracer_study",
    "acquisition_time": "acquisition_time IS NULL",
    "radiopharmaceutical": "NOT (radiopharm AND radiopharmaceutical IS NOT NULL) AND tracer_study",
    "patient_sex": "patient_sex IS NULL",
    "patient_age": "patient_age IS NULL AND patient_birth_date IS NULL",
}
_DOSES = {
    "missing_activity": "weight_best IS NOT NULL AND injected_activity IS NULL",
    "missing_weight": "weight_best IS NULL AND injected_activity IS NOT NULL",
    "unit_mismatch": "dose_plausible < 0.1 OR dose_plausible > 50",
    "outlier": "dose_sd > 0 AND abs(dose_plausible - dose_mean) > 3 * dose_sd",
}
_MADE_OF = {"missing_ct": "has_pt AND NOT has_ct", "missing_pt": "has_ct AND NOT has_pt", "high_series": "series_count > 20"}


def _issues(source: str, issues: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS issue, study_instance_uid FROM {source} WHERE ({v})" for k, v in issues.items())


TAILS = {
    "missing_issues": _issues("(SELECT rep.*, tracer_study FROM rep JOIN studies USING (study_instance_uid))", _MISSING),
    "timing_issues": _issues("rep", {k: f"status = '{k}'" for k in ("missing", "parse_fail", "negative", "too_long", "ok")} | {"study_time_conflict": "conflict"}),
    "dose_issues": _issues("(SELECT * FROM rep, spread WHERE radiopharm)", _DOSES),
    "composition_issues": _issues("studies", _MADE_OF),
    "export_text": f", e AS ({_EXPORT_ALL}) SELECT study, place, {', '.join(f'{v} AS {k}' for k, v in _TEXTS.items())} FROM e",
    "private_decode": _PRIVATE,
    "payload_fingerprint": f", p AS ({_PRIVATE}) SELECT file_path, sha256(string_agg(creator || '|' || group_hex || '|' || element_hex || '|' || value_hash, chr(10) ORDER BY element_hex)) AS fingerprint FROM p GROUP BY 1",
    "series_lookup": "SELECT file_path, series_instance_uid, modality FROM series WHERE series_instance_uid = (SELECT min(series_instance_uid) FROM series)",
    "creator_resolve": "SELECT file_path, e AS element_hex, CASE WHEN e = '1101' THEN 'Unknown' WHEN number_of_slices % 3 = 1 THEN 'NEST' ELSE 'ACME' END AS creator FROM files CROSS JOIN (VALUES ('1001'), ('1101')) t(e)",
    "csa_json": """SELECT file_path, '{"format":"' || CASE WHEN number_of_slices % 2 = 0 THEN 'CSA2' ELSE 'CSA1' END || '","element_count":2,"elements":{"CsaSeriesHash":{"vr":"LO","vm":1,"values":["' || csa_series_header_hash || '"]},"Slices":{"vr":"IS","vm":2,"values":["' || number_of_slices || '"' || CASE WHEN modality IS NULL THEN '' ELSE ',"' || modality || '"' END || ']}}}' AS elements, 64 AS hash_length FROM files WHERE csa_series_header_hash IS NOT NULL""",
    "study_export_info": "SELECT study_instance_uid, max(patient_weight) AS patient_weight, max(patient_size) AS patient_size, max(study_date) AS study_date, max(study_time) AS study_time, max(patient_name) AS patient_name FROM series GROUP BY 1",
    "json_dump": "SELECT file_path, series_instance_uid, modality, coalesce(n, 0) AS n_tags FROM series LEFT JOIN (SELECT file_path, count(*) AS n FROM tags GROUP BY 1) USING (file_path)",
    "ctp_demographics": _DEMOGRAPHICS + " UNION ALL SELECT 'ctp flagged', count(*) FROM studies",
    "newest_first": "SELECT study_instance_uid, row_number() OVER (ORDER BY max(study_date) DESC NULLS LAST, max(study_time) DESC NULLS LAST, study_instance_uid) AS place FROM by_modality GROUP BY 1",
    "dedup_series": "SELECT file_path, series_instance_uid, study_instance_uid, modality FROM series",
    "dedup_tags": "SELECT series_instance_uid, group_hex, element_hex, creator, classification FROM classed SEMI JOIN series USING (file_path)",
    "representative_ingest": "SELECT study_instance_uid, series_instance_uid, score, round(delay_signed, 6) AS delay_minutes, round(dose_ingest, 6) AS dose_per_kg FROM ingest",
    "representative_query": "SELECT study_instance_uid, series_instance_uid, score, round(delay_minutes, 6) AS delay_minutes, round(dose_per_kg, 6) AS dose_per_kg FROM rep",
    "prune_report": "SELECT count(*) AS stored, count(i.series_instance_uid) AS kept, count(*) - count(i.series_instance_uid) AS dropped FROM series s LEFT JOIN ingest i USING (series_instance_uid)",
    "prune_tags": "SELECT series_instance_uid, group_hex, element_hex FROM tags SEMI JOIN ingest USING (series_instance_uid)",
    "delete_study": "SELECT file_path, series_instance_uid FROM series WHERE study_instance_uid <> '1.2.840.1'",
    "new_studies": "SELECT DISTINCT study_instance_uid FROM files ANTI JOIN existing USING (study_instance_uid)",
    "skip_existing_paths": "SELECT file_path FROM files ANTI JOIN existing USING (file_path)",
    "ingest_report": """, k AS (SELECT split_part(f.file_path, '/', 1) AS scan_id, f.study_instance_uid, s.file_path IS NOT NULL AND e.u IS NULL AS fresh, o.study_instance_uid IS NOT NULL AS old FROM files f LEFT JOIN series s USING (file_path)
  LEFT JOIN (SELECT DISTINCT series_instance_uid AS u FROM existing) e ON e.u = f.series_instance_uid LEFT JOIN (SELECT DISTINCT study_instance_uid FROM existing) o ON o.study_instance_uid = f.study_instance_uid)
SELECT scan_id, count(*) FILTER (WHERE fresh) AS processed, count(*) FILTER (WHERE NOT fresh) AS duplicates, count(DISTINCT study_instance_uid) FILTER (WHERE NOT old) AS new_studies, count(DISTINCT study_instance_uid) FILTER (WHERE old) AS known_studies, 0::bigint AS invalid FROM k GROUP BY 1""",
    "study_list": f"SELECT {LIST} FROM by_modality GROUP BY 1",
    "facet_values": " UNION ".join(f"SELECT '{c}' AS facet, {c} AS value FROM series WHERE {c} <> ''" for c in ("modality", "manufacturer", "radiopharmaceutical")),
    "facet_filter": f"{UID} by_modality GROUP BY 1 HAVING bool_or(modality IN ('PT', 'CT')) AND bool_or(manufacturer = 'SIEMENS')",
    "text_search": f"SELECT {LIST} FROM by_modality WHERE {_HIT} GROUP BY 1",
    "match_score_exact": f"""SELECT study_instance_uid, cast(max(CASE WHEN v = 'economy' THEN 1 WHEN v LIKE '%economy%' THEN 0.95 ELSE 0.9 END) AS double) AS match_score
  FROM (SELECT study_instance_uid, unnest([lower(patient_name), lower(patient_id), lower(modality), lower(study_description), lower(manufacturer), lower(radiopharmaceutical)]) AS v FROM (SELECT {LIST} FROM by_modality WHERE {_HIT} GROUP BY 1)) WHERE v <> '' AND (v LIKE '%economy%' OR 'economy' LIKE '%' || v || '%') GROUP BY 1""",
    "range_filter": f"{UID} rep WHERE delay_minutes >= 30 AND round_even(delay_minutes, 1) <= 90.5 AND dose_per_kg >= 0.5 AND dose_per_kg <= 5",
    "missing_filter": f"{UID} rep WHERE injected_activity IS NULL AND study_instance_uid IN ({UID} studies WHERE tracer_study)",
    "timing_filter": f"{UID} rep WHERE status = 'negative'",
    "dose_issue_filter": f"{UID} rep, spread WHERE radiopharm AND dose_sd > 0 AND abs(dose_plausible - dose_mean) > 3 * dose_sd",
    "qa_score_filter": f"{UID} qa WHERE qa_score = 4",
    "composition_filter": f"{UID} studies WHERE has_pt AND NOT has_ct",
    "filter_combine": f"{UID} qa WHERE status = 'ok' AND qa_score = 4 AND delay_minutes >= 10 AND study_instance_uid IN ({UID} studies WHERE has_pt AND NOT has_ct)",
    "export_modality_filter": "SELECT file_path, modality FROM series WHERE modality IN ('PT', 'CT')",
    "uptake_stats": f"SELECT {_stats('delay_minutes', '45 AND 75')} FROM rep",
    "dose_stats": f"SELECT {_stats('dose_dashboard', '2.5 AND 3.5')} FROM rep",
    "scan_duration": f", m AS (SELECT ({_seconds('acquisition_time')} - {_seconds('series_time')}) / 60.0 AS v FROM rep) SELECT {_stats('v')} FROM m WHERE v BETWEEN 0 AND 480",
    "modality_summary": _group("modality", "modality"),
    "radiopharm_summary": _group("radiopharmaceutical", "radiopharmaceutical", "radiopharm"),
    "ct_dose_summary": "SELECT coalesce(modality, 'Unknown') AS modality, count(*) AS n, round(avg(ctdivol), 6) AS ctdivol_mean, round(median(ctdivol), 6) AS ctdivol_median, round(avg(dlp), 6) AS dlp_mean, round(median(dlp), 6) AS dlp_median FROM rep WHERE ctdivol IS NOT NULL OR dlp IS NOT NULL GROUP BY 1",
    "tracer_top10": "SELECT radiopharmaceutical, count(*) AS n FROM rep WHERE radiopharmaceutical <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "manufacturer_top10": "SELECT manufacturer, count(*) AS n FROM rep WHERE manufacturer <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "study_dates": "SELECT study_date, count(*) AS n FROM studies WHERE study_date <> '' GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
    "study_hours": "SELECT cast(substr(study_time, 1, 2) AS int) AS hour, count(*) AS n FROM studies WHERE study_time <> '' GROUP BY 1",
    "demographics": _DEMOGRAPHICS,
    "missingness": f", m AS ({_group('modality', 'modality')}), d AS ({_DEMOGRAPHICS}) " + _rows("m", {k: f"sum({k})" for k in ("missing_weight", "missing_injection", "missing_acquisition")}) + " UNION ALL SELECT metric, n FROM d WHERE metric LIKE 'missing %'",
    "repeat_rate": _rows("studies", {"studies": "count(*)", "repeats": _count("series_count > 1")}),
    "dashboard_totals": _rows("series", {"series": "count(*)", "studies": "count(DISTINCT study_instance_uid)"}),
    "series_per_study": "SELECT study_instance_uid, series_count FROM studies",
    "completeness": _COMPLETENESS,
    "timing_integrity": _rows("rep", {k: _count(f"status = '{k}'") for k in ("missing", "parse_fail", "negative", "too_long", "ok")} | {"study_time_conflict": _count("conflict")}),
    "dose_plausibility": _rows("rep, spread WHERE radiopharm", {"total": "count(*)", "mean": "round(max(dose_mean), 6)", "sd": "round(max(dose_sd), 6)", "outliers": _count("dose_sd > 0 AND abs(dose_plausible - dose_mean) > 3 * dose_sd"), "unit_mismatch": _count("dose_plausible < 0.1 OR dose_plausible > 50"), "weight_without_activity": _count("weight_best IS NOT NULL AND injected_activity IS NULL"), "activity_without_weight": _count("weight_best IS NULL AND injected_activity IS NOT NULL")}, "value", "double"),
    "qa_score_distribution": "SELECT cast(s AS int) AS score, count(qa_score) AS n FROM unnest(range(6)) r(s) LEFT JOIN qa ON qa_score = s GROUP BY 1",
    "study_composition": _rows("studies", {"missing_ct": _count("has_pt AND NOT has_ct"), "missing_pt": _count("has_ct AND NOT has_pt"), "high_series": _count("series_count > 20")}),
    "scanner_landscape": "SELECT coalesce(manufacturer, 'Unknown') AS manufacturer, coalesce(manufacturer_model_name, 'Unknown') AS model, coalesce(software_version, 'Unknown') AS software, count(*) AS n, count(DISTINCT csa_series_header_hash) AS unique_csa FROM rep GROUP BY 1, 2, 3",
    "protocol_radiopharm": ", c AS (SELECT radiopharmaceutical, csa_series_header_hash AS h, count(*) AS k FROM rep WHERE radiopharmaceutical <> '' GROUP BY 1, 2) SELECT radiopharmaceutical, cast(sum(k) AS bigint) AS n, count(h) AS unique_csa, first(h ORDER BY h IS NULL, k DESC, h) AS top_csa, coalesce(max(k) FILTER (WHERE h IS NOT NULL), 0) AS top_count FROM c GROUP BY 1",
    "derived_objects": _rows("rep", {"SEG": _count("modality = 'SEG'"), "RTSTRUCT": _count("modality = 'RTSTRUCT'"), "highdicom": _count("contains(lower(manufacturer), 'highdicom')"), "qiicr": _count("contains(lower(manufacturer), 'qiicr')")}),
    "duplicate_check": "SELECT 'sop_instance_uid' AS metric, count(*) AS n FROM (SELECT 1 FROM series WHERE sop_instance_uid <> '' GROUP BY sop_instance_uid HAVING count(*) > 1) UNION ALL SELECT 'signature', count(*) FROM (SELECT 1 FROM series GROUP BY study_instance_uid, modality, series_description, series_time, number_of_slices, manufacturer_model_name HAVING count(*) > 1)",
    "uptake_histogram": _histogram("delay_minutes", 5, 60),
    "dose_histogram": _histogram("dose_dashboard", 0.1, 80),
    "ctp_labels": "SELECT value_text AS label, count(*) AS n FROM tags SEMI JOIN rep USING (series_instance_uid) WHERE creator = 'CTP' AND group_hex = '0013' AND element_hex = '1010' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "private_creator_counts": "SELECT series_instance_uid, creator, count(*) AS n FROM tags SEMI JOIN rep USING (series_instance_uid) GROUP BY 1, 2",
    "pipeline_provenance": _provenance("pipeline_provenance"),
    "rt_provenance": _provenance("rt_provenance"),
    "pet_dose_reports": "SELECT series_instance_uid, 0 AS pos, 'Dose' AS name, regexp_extract(value_text, '<m_StatisticsValueVector1>(.*?)<', 1) AS value, cast(NULL AS varchar) AS alt_value FROM tags SEMI JOIN rep USING (series_instance_uid) WHERE creator LIKE 'SIEMENS%' AND value_text LIKE '%<PetDoseReportData%'",
    "study_summary": "SELECT study_instance_uid, patient_birth_date, patient_sex, patient_age, patient_weight, patient_size, study_date, study_time FROM studies",
    "study_detail": f""", x AS (SELECT *, CASE WHEN delay_signed >= 0 THEN delay_signed END AS d FROM by_modality), i AS (SELECT study_instance_uid, max(patient_size) AS sz, max(study_time) AS st FROM series GROUP BY 1)
SELECT x.study_instance_uid, series_instance_uid, file_path, modality, round(nullif(d, 0), 6) AS delay_minutes, round(quotient, 6) AS activity_per_kg, round({_LEFT}, 3) AS activity_at_scan, round((1 - ({_LEFT}) / ({_START})) * 100, 6) AS decay_percent,
  round(CASE WHEN study_patient_weight > 0 AND sz > 0 THEN study_patient_weight / (sz * sz) END, 6) AS bmi, round(sz * 100, 6) AS height_cm, coalesce(cast(substr(st, 1, 2) AS int) >= 22 AND try_cast(substr(acquisition_time, 1, 2) AS int) <= 6, false) AS next_day FROM x JOIN i USING (study_instance_uid)""",
    "export_numeric": f"SELECT study, place, patient_id, patient_sex, study_date, series_number, modality, round(uptake_delay, 6) AS uptake_delay, round(dose_per_kg, 6) AS dose_per_kg, round(bmi, 6) AS bmi FROM ({_EXPORT})",
    "export_grouped": f", e AS ({_EXPORT}) SELECT study, place, CASE WHEN place > 1 AND patient_id IS NOT DISTINCT FROM first(patient_id) OVER w THEN '' ELSE coalesce(patient_id, '') END AS patient_id, CASE WHEN place > 1 AND coalesce(patient_sex, '') = coalesce(first(patient_sex) OVER w, '') THEN '' ELSE coalesce(patient_sex, '') END AS patient_sex, coalesce(cast(series_number AS varchar), '') AS series_number, coalesce(modality, '') AS modality FROM e WINDOW w AS (PARTITION BY study ORDER BY place)",
    "export_sectioned": f", e AS ({_EXPORT}) SELECT study, place, '' AS patient_id, coalesce(cast(series_number AS varchar), '') AS series_number, coalesce(modality, '') AS modality FROM e UNION ALL SELECT study, 0, coalesce(patient_id, ''), '', '' FROM e WHERE place = 1",
    "parse_headers": "SELECT file_path, patient_id, patient_weight, study_instance_uid, study_date, series_instance_uid, series_number, modality, manufacturer, acquisition_time, injection_time, radiopharmaceutical, injected_activity, half_life, ctdivol, number_of_slices FROM files",
    "csa_elements": "SELECT file_path, 'CsaSeriesHash' AS name, 'LO' AS vr, 1::bigint AS vm, 0 AS pos, csa_series_header_hash AS value FROM files WHERE csa_series_header_hash IS NOT NULL UNION ALL SELECT file_path, 'Slices', 'IS', 2::bigint, p, CASE p WHEN 0 THEN cast(number_of_slices AS varchar) ELSE modality END FROM files CROSS JOIN (VALUES (0), (1)) v(p) WHERE csa_series_header_hash IS NOT NULL AND NOT (p = 1 AND modality IS NULL)",
    "expand_archive": "SELECT study_instance_uid || '.zip' AS archive, replace(file_path, '/', '_') AS member, series_number FROM files",
    "scan_headers": "SELECT file_path, CASE WHEN number_of_slices <> 11 THEN series_instance_uid END AS series_instance_uid, CASE WHEN number_of_slices <> 11 THEN modality END AS modality, CASE WHEN number_of_slices <> 11 THEN injected_activity END AS injected_activity, CASE WHEN number_of_slices <> 11 THEN number_of_slices END AS number_of_slices, CASE WHEN number_of_slices = 11 THEN 'cut off' END AS error FROM files",
    "scan_archives": "SELECT cast(cast(string_split(study_instance_uid, '.')[4] AS bigint) // 4096 AS varchar) || '.zip' AS archive, file_path AS member, CASE WHEN number_of_slices NOT IN (13, 17) THEN series_instance_uid END AS series_instance_uid, CASE WHEN number_of_slices NOT IN (13, 17) THEN series_number END AS series_number, CASE number_of_slices WHEN 13 THEN 'damaged' WHEN 17 THEN 'encrypted' END AS error FROM files",
    "databank_upkeep": "SELECT file_path, series_instance_uid, 1 AS representative_flag, 6::bigint AS n_tags FROM ingest WHERE study_instance_uid <> '1.2.840.1'",
    "stream_ingest": "SELECT file_path, series_instance_uid FROM series",
    "ctp_columns": "SELECT file_path, 'COLL-' || cast(number_of_slices % 15 AS varchar) AS ctp_collection, patient_id AS ctp_subject_id, number_of_slices AS ctp_private_flag_int FROM files",
}
# how many studies each value of a filter has
TAILS["filter_counts"] = " UNION ALL ".join(
    [f"SELECT '{name if name != 'dose' else 'dose_issue'}' AS filter, issue AS value, count(*) AS n FROM ({TAILS[f'{name}_issues']}) GROUP BY 2" for name in ("missing", "timing", "dose", "composition")]
    + ["SELECT 'qa_score', cast(qa_score AS varchar), count(*) FROM qa GROUP BY 2"]
)
ORACLE = {name: BASE + tail for name, tail in TAILS.items()}
