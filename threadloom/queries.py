"""The registered queries over the archive views, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import archive_queries
from threadloom.functions.names import DATED_SOURCE, file_date
from threadloom.operators import evidence, gate, guards, matching, names, scope, sequence
from threadloom.plans.views import DENSE, GATE, LOCAL, MESSAGE_SQL, ORDER, attachments, chat_exports, device_groups, media_files, message_attachments, messages, oracle, sent_attachments
from threadloom.sources import inventory, workspace
from threadloom.session import materialize
from threadloom.sources.chats import parse_messages, parse_problems

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Query, body: str | None = None, dates: int = DENSE) -> None:
    QUERIES[name] = run
    if body:
        ORACLE_SQL[name] = oracle(body, dates)


def _files(op, body: str | None = None) -> None:
    _add(op.__name__, lambda s, d: op(media_files(s, d)), body)


def _tokens(op, body: str | None = None) -> None:
    _add(op.__name__, lambda s, d: op(scope.token_rows(media_files(s, d), device_groups(s))), body)


def _matched(op, body: str | None = None) -> None:
    _add(op.__name__, lambda s, d: op(attachments(s, d), media_files(s, d), LOCAL), body)


def _band(x: str, bands: str) -> str:
    cases = {"candidates": "WHEN {0} <= 0 THEN '0' WHEN {0} <= 1 THEN '1' WHEN {0} <= 2 THEN '2' WHEN {0} <= 5 THEN '3-5' WHEN {0} <= 10 THEN '6-10' WHEN {0} <= 25 THEN '11-25' WHEN {0} <= 50 THEN '26-50' ELSE '>50'", "counts": "WHEN {0} <= 1 THEN '1' WHEN {0} <= 2 THEN '2' WHEN {0} <= 5 THEN '3-5' WHEN {0} <= 10 THEN '6-10' WHEN {0} <= 25 THEN '11-25' ELSE '>25'"}
    return f"CASE {cases[bands].format(x)} END"


# Evidence.
_EV = """, ev AS (SELECT asset_id, file_date, count(*) AS copies, string_agg(DISTINCT CAST(source_id AS VARCHAR), ',' ORDER BY CAST(source_id AS VARCHAR)) AS sources,
 coalesce(bool_or(is_sent), false) AS has_sent, coalesce(bool_or(NOT is_sent), false) AS has_not_sent, bool_or(is_sent IS NULL) AS has_unknown, min(media_type) AS media_type
 FROM files WHERE file_date IS NOT NULL AND size > 0 GROUP BY asset_id, file_date)"""
_add("evidence_by_asset_date", lambda s, d: evidence.evidence_by_asset_date(media_files(s, d)).withColumn("sources", F.array_join("sources", ",")), _EV + " SELECT * FROM ev")
_FACTS = ", facts AS (SELECT asset_id, count(*) AS copies, count(DISTINCT source_id) AS sources, bool_or(file_date IS NOT NULL) AS has_dated_copy, max(size) AS size FROM files GROUP BY asset_id)"
_files(evidence.asset_facts, _FACTS + " SELECT asset_id, copies, sources, has_dated_copy, CAST(size AS BIGINT) AS size FROM facts")
_files(evidence.source_facts, " SELECT source_id, count(*) AS files, count(file_date) AS dated_files, count(DISTINCT CASE WHEN file_date IS NOT NULL AND size > 0 THEN asset_id END) AS eligible_assets FROM files GROUP BY source_id")
_files(evidence.undated_pools, _FACTS + " SELECT count(*) FILTER (size = 0) AS zero_byte_assets, CAST(coalesce(sum(copies) FILTER (size = 0), 0) AS BIGINT) AS zero_byte_files, count(*) FILTER (size <> 0 AND NOT has_dated_copy) AS no_date_assets FROM facts")
_DENSITY = ", per AS (SELECT file_date, count(DISTINCT asset_id) AS n FROM files WHERE file_date IS NOT NULL AND size > 0 GROUP BY file_date)"
_files(evidence.date_density, _DENSITY + " SELECT count(*) AS dates, coalesce(min(n), 0) AS least, coalesce(quantile_disc(n, 0.5), 0) AS lower_median, coalesce(max(n), 0) AS most FROM per")

# Matching.
_REL = _EV + """, sides AS (SELECT *, CASE WHEN sender_id IS NULL THEN 'Unknown' WHEN sender_id = 1 THEN 'Outgoing' ELSE 'Incoming' END AS direction FROM attachments),
 r0 AS (SELECT s.*, e.*, CASE WHEN direction = 'Outgoing' THEN has_sent ELSE has_not_sent END AS agrees, CASE WHEN direction = 'Outgoing' THEN has_not_sent ELSE has_sent END AS differs FROM sides s JOIN ev e ON s.message_date = e.file_date),
 rel AS (SELECT *, CASE WHEN direction = 'Unknown' THEN 'Unknown' WHEN agrees AND differs THEN 'Mixed' WHEN agrees THEN 'Compatible' WHEN differs THEN 'ContradictoryOnly' ELSE 'Unknown' END AS compatibility FROM r0)"""
_EXACT = _REL + " SELECT attachment_id, sequence_number, message_date, direction, asset_id, media_type, copies, sources, compatibility FROM rel"
_add("exact_relations", lambda s, d: matching.exact_relations(attachments(s, d), media_files(s, d), LOCAL, F.array_join("sources", ",")), _EXACT)
_ADJACENT = _EV + """, near AS (SELECT a.*, e.asset_id, e.file_date, e.copies, e.sources, e.has_sent, e.has_not_sent FROM attachments a JOIN ev e ON e.file_date IN (a.message_date - 1, a.message_date + 1)
 WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.asset_id = e.asset_id AND x.file_date = a.message_date)),
 both_ AS (SELECT attachment_id, asset_id, bool_or(file_date < message_date) AS has_previous, bool_or(file_date > message_date) AS has_next, CAST(sum(copies) AS BIGINT) AS copies,
 len(list_distinct(flatten(list(string_split(sources, ','))))) AS sources, bool_or(has_sent) AS s, bool_or(has_not_sent) AS n, any_value(sender_id) AS sender_id FROM near GROUP BY attachment_id, asset_id),
 b AS (SELECT *, CASE WHEN sender_id = 1 THEN s ELSE n END AS agrees, CASE WHEN sender_id = 1 THEN n ELSE s END AS differs FROM both_)
 SELECT attachment_id, asset_id, has_previous, has_next, copies, sources, CASE WHEN sender_id IS NULL THEN 'Unknown' WHEN agrees AND differs THEN 'Mixed' WHEN agrees THEN 'Compatible' WHEN differs THEN 'ContradictoryOnly' ELSE 'Unknown' END AS compatibility FROM b"""
_matched(matching.adjacent_relations, _ADJACENT)
_COUNTS = _REL + """, counts AS (SELECT a.attachment_id, count(asset_id) AS exact, count(*) FILTER (compatibility = 'Compatible') AS "Compatible", count(*) FILTER (compatibility = 'Mixed') AS "Mixed",
 count(*) FILTER (compatibility = 'Unknown') AS "Unknown", count(*) FILTER (compatibility = 'ContradictoryOnly') AS "ContradictoryOnly", any_value(a.message_date) AS message_date, any_value(a.sender_id) AS sender_id
 FROM attachments a LEFT JOIN rel ON a.attachment_id = rel.attachment_id GROUP BY a.attachment_id)"""
_matched(matching.relation_counts, _COUNTS + " SELECT * FROM counts")
_add("candidate_details", lambda s, d: matching.candidate_details(matching.exact_relations(attachments(s, d, GATE), f := media_files(s, d, GATE), LOCAL), f), _REL + """, fa AS (SELECT asset_id, count(*) AS all_copies, count(DISTINCT source_id) AS all_sources, CAST(max(size) AS BIGINT) AS size FROM files GROUP BY asset_id)
 SELECT attachment_id, asset_id, media_type, copies AS supporting_copies, len(string_split(sources, ',')) AS supporting_sources, compatibility, all_copies, all_sources, size FROM rel JOIN fa USING (asset_id)""", GATE)
_add("state_counts", lambda s, d: matching.state_counts(matching.relation_counts(attachments(s, d), media_files(s, d), LOCAL)), _COUNTS + """, u AS (UNPIVOT counts ON "Compatible", "Mixed", "Unknown", "ContradictoryOnly" INTO NAME state VALUE n) SELECT state, CAST(sum(n) AS BIGINT) AS relations, count(*) FILTER (n > 0) AS attachments FROM u GROUP BY state""")
_BANDS = _COUNTS + f""", u AS (SELECT 'exact' AS measure, exact AS n FROM counts UNION ALL SELECT 'compatible', "Compatible" FROM counts),
 f AS (SELECT measure, {_band("n", "candidates")} AS band, count(*) AS c FROM u GROUP BY 1, 2),
 every AS (SELECT * FROM (VALUES ('exact'), ('compatible')) m(measure), (VALUES ('0'), ('1'), ('2'), ('3-5'), ('6-10'), ('11-25'), ('26-50'), ('>50')) b(band))
 SELECT measure, band, coalesce(c, 0) AS attachments FROM every LEFT JOIN f USING (measure, band)"""
_add("candidate_bands", lambda s, d: matching.candidate_bands(matching.relation_counts(attachments(s, d), media_files(s, d), LOCAL)), _BANDS)
_add("source_contributions", lambda s, d: matching.source_contributions(attachments(s, d), media_files(s, d)), """, fs AS (SELECT source_id, count(*) AS files, count(file_date) AS dated_files, count(DISTINCT CASE WHEN file_date IS NOT NULL AND size > 0 THEN asset_id END) AS eligible_assets FROM files GROUP BY source_id),
 c AS (SELECT source_id, count(*) AS n FROM (SELECT DISTINCT source_id, asset_id, file_date FROM files WHERE size > 0) f JOIN attachments a ON a.message_date = f.file_date GROUP BY source_id)
 SELECT fs.*, coalesce(n, 0) AS relations FROM fs LEFT JOIN c USING (source_id)""")
_add("relations_by_media_type", lambda s, d: matching.relations_by_media_type(attachments(s, d), media_files(s, d)), _REL + " SELECT media_type, count(*) AS relations FROM rel GROUP BY media_type")
_matched(matching.match_census, _COUNTS + """, near AS (SELECT DISTINCT m.message_date, e.file_date, e.asset_id FROM (SELECT DISTINCT message_date FROM attachments) m JOIN ev e ON e.file_date IN (m.message_date - 1, m.message_date, m.message_date + 1)),
 outside AS (SELECT DISTINCT message_date FROM near n WHERE file_date <> message_date AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.asset_id = n.asset_id AND x.file_date = n.message_date)),
 facts AS (SELECT asset_id, count(*) AS copies, bool_or(file_date IS NOT NULL) AS has_dated_copy, max(size) AS size FROM files GROUP BY asset_id), per AS (SELECT file_date, count(*) AS n FROM ev GROUP BY 1),
 a AS (SELECT count(*) AS attachments, count(*) FILTER (sender_id IS NULL) AS without_sender, count(DISTINCT message_date) AS dates, count(*) FILTER (exact = 0) AS without_exact, count(*) FILTER (exact = 1) AS unique_exact,
  count(*) FILTER ("Compatible" = 1) AS unique_compatible, count(*) FILTER (exact = 0 AND message_date IN (SELECT message_date FROM outside)) AS adjacent_only FROM counts),
 b AS (SELECT count(DISTINCT asset_id) AS candidate_assets FROM near), c AS (SELECT count(file_date) AS dated_files, count(*) - count(file_date) AS undated_files FROM files),
 d AS (SELECT count(*) FILTER (size = 0) AS zero_byte_assets, CAST(coalesce(sum(copies) FILTER (size = 0), 0) AS BIGINT) AS zero_byte_files, count(*) FILTER (size <> 0 AND NOT has_dated_copy) AS no_date_assets FROM facts),
 e AS (SELECT count(*) AS density_dates, coalesce(min(n), 0) AS density_least, coalesce(quantile_disc(n, 0.5), 0) AS density_lower_median, coalesce(max(n), 0) AS density_most FROM per)
 SELECT * FROM a, b, c, d, e""")

# Names.
_SUF = r""", s0 AS (SELECT *, regexp_extract(suffix, '^[0-9]*') AS digits FROM files WHERE suffix IS NOT NULL), s AS (SELECT *, CASE WHEN suffix = '' THEN 'Empty' WHEN digits = '' THEN 'NonNumeric' WHEN digits = suffix THEN 'PurelyNumeric' ELSE 'NumericPrefixWithTrailingDecoration' END AS suffix_class FROM s0)"""
_files(names.suffix_classes, _SUF + ", f AS (SELECT suffix_class, count(*) AS n, count(DISTINCT asset_id) AS a FROM s GROUP BY 1) SELECT c AS suffix_class, coalesce(n, 0) AS files, coalesce(a, 0) AS assets FROM (VALUES ('Empty'), ('NonNumeric'), ('PurelyNumeric'), ('NumericPrefixWithTrailingDecoration')) e(c) LEFT JOIN f ON c = suffix_class")
_WIDTHS = _SUF + ", w AS (SELECT length(digits) AS width, count(*) AS files, count(DISTINCT digits) AS strings, min(digits) AS least, max(digits) AS greatest FROM s WHERE suffix_class = 'PurelyNumeric' GROUP BY 1)"
_files(names.digit_widths, _WIDTHS + " SELECT * FROM w")
_files(names.dominant_width, _WIDTHS + " SELECT coalesce(first(width ORDER BY files DESC, width), 0) AS width, coalesce(max(files), 0) AS files FROM w")
_files(names.numeric_agreement, _SUF + ", p AS (SELECT asset_id, count(*) AS n, count(DISTINCT digits) AS d, count(DISTINCT CAST(digits AS BIGINT)) AS v FROM s WHERE suffix_class = 'PurelyNumeric' GROUP BY 1 HAVING count(*) > 1) SELECT CASE WHEN d = 1 THEN 'SameDigits' WHEN v = 1 THEN 'SameValue' ELSE 'Different' END AS agreement, count(*) AS assets FROM p GROUP BY 1")
_files(names.name_counts, " SELECT names, names_any_case, count(*) AS assets FROM (SELECT count(DISTINCT name) AS names, count(DISTINCT upper(name)) AS names_any_case FROM files GROUP BY asset_id) GROUP BY 1, 2")
_files(names.top_signatures, _SUF + r""", sh AS (SELECT 'suffix' AS part, suffix AS x, asset_id FROM s WHERE suffix_class IN ('NonNumeric', 'NumericPrefixWithTrailingDecoration') UNION ALL SELECT 'name', regexp_replace(name, '\.[^./\\]+$', ''), asset_id FROM files WHERE file_date IS NULL),
 g AS (SELECT part, asset_id, list_aggregate(list_transform(regexp_extract_all(x, '[A-Za-z]+|[0-9]+|[-_.()\[\] ]|[^A-Za-z0-9\-_.()\[\] ]+'), lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z]') THEN 'A' || length(r) WHEN regexp_matches(r, '^[0-9]') THEN 'D' || length(r) WHEN regexp_matches(r, '^[-_.()\[\] ]') THEN r ELSE 'X' || length(r) END), 'string_agg', '') AS signature FROM sh),
 n AS (SELECT part, signature, row_number() OVER (PARTITION BY part ORDER BY count(*) DESC, signature) AS place FROM g GROUP BY part, signature)
 SELECT g.part, CAST(least(place, 21) AS INTEGER) AS place, CASE WHEN place > 20 THEN 'Other' ELSE g.signature END AS signature, count(*) AS files, count(DISTINCT asset_id) AS assets FROM g JOIN n USING (part, signature) GROUP BY 1, 2, 3""")
_FEATURES = {"eight_digits": "regexp_matches(name, '[0-9]{8}')", "hyphen_eight_digits": "regexp_matches(name, '-[0-9]{8}')", "real_date": "len(list_filter(list_transform(range(1, greatest(length(name) - 6, 1)), lambda i: substr(name, i, 8)), lambda x: regexp_full_match(x, '[0-9]{8}') AND x >= '0001' AND try_strptime(x, '%Y%m%d') IS NOT NULL)) > 0",
             "wa_literal": "contains(name, '-WA')", "wa_digit": "regexp_matches(name, 'WA[0-9]')", "marker_shape": "regexp_matches(name, '-[0-9]{8}-WA')", "impossible_marker": "len(list_filter(regexp_extract_all(name, '-([0-9]{8})-WA', 1), lambda x: x < '0001' OR try_strptime(x, '%Y%m%d') IS NULL)) > 0"}
_files(names.undated_features, ", u AS (SELECT asset_id, " + ", ".join(f"{v} AS {k}" for k, v in _FEATURES.items()) + " FROM files WHERE file_date IS NULL), v AS (SELECT *, NOT greatest(" + ", ".join(_FEATURES) + ") AS none FROM u) " + " UNION ALL ".join(f"SELECT '{k}' AS feature, count(*) FILTER ({k}) AS files, count(DISTINCT asset_id) FILTER ({k}) AS assets FROM v" for k in [*_FEATURES, "none"]))
_files(names.extension_census, " SELECT ext, count(*) AS files, CASE ext WHEN '.jpg' THEN 'Image' WHEN '.mp4' THEN 'Video' WHEN '.opus' THEN 'Audio' ELSE 'Document' END AS media_type FROM files GROUP BY ext")
_files(names.discovery_summary, " SELECT count(*) AS files, " + ", ".join(f"count(*) FILTER (media_type = '{t}') AS {t.lower()}" for t in ("Image", "Video", "Audio", "Document", "Unknown")) + ", count(*) FILTER (is_sent) AS sent, count(*) FILTER (NOT is_sent) AS not_sent, count(*) FILTER (is_sent IS NULL) AS direction_unknown, count(file_date) AS dated, count(*) FILTER (size = 0) AS empty, CAST(sum(size) AS BIGINT) AS bytes FROM files")

# Scopes.
_T = ", t AS (SELECT tokens.*, group_id FROM tokens JOIN device_groups USING (source_id) WHERE token IS NOT NULL)"
_LEVELS = {"Token": ("NULL", "NULL", "NULL"), "DateToken": ("file_date", "NULL", "NULL"), "DeviceGroupDateToken": ("file_date", "group_id", "NULL"), "SourceDateToken": ("file_date", "NULL", "source_id")}
_GROUP_LEVELS = {"Date": ("file_date", "NULL", "NULL"), "DeviceGroupDate": ("file_date", "group_id", "NULL"), "SourceDate": ("file_date", "NULL", "source_id")}


def _levels(levels: dict[str, tuple[str, ...]]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS level, CAST({d} AS DATE) AS file_date, CAST({g} AS BIGINT) AS group_id, CAST({s} AS BIGINT) AS source_id, token, asset_id, size, name FROM t" for k, (d, g, s) in levels.items())


_KEYS = _T + f", lv AS ({_levels(_LEVELS)}), keys AS (SELECT level, file_date, group_id, source_id, token, count(*) AS files, count(DISTINCT asset_id) AS assets, count(DISTINCT asset_id) FILTER (size > 0) AS full_assets, count(*) FILTER (size > 0) AS full_files FROM lv GROUP BY ALL)"
_GROUPS = _T + f", lv AS ({_levels(_GROUP_LEVELS)}), g AS (SELECT level, file_date, group_id, source_id, count(*) AS files, count(DISTINCT asset_id) AS assets, count(DISTINCT token) AS tokens, count(DISTINCT name) AS names, min(token) AS least, max(token) AS greatest, max(token) - min(token) + 1 - count(DISTINCT token) AS missing_inside FROM lv GROUP BY level, file_date, group_id, source_id)"
_keyed = lambda df: df.withColumn("group_id", F.col("group_id").cast("long")).withColumn("source_id", F.col("source_id").cast("long"))
_add("key_records", lambda s, d: _keyed(scope.key_records(scope.token_rows(media_files(s, d), device_groups(s)))), _KEYS + " SELECT * FROM keys")
_tokens(scope.ambiguity, _KEYS + ", b AS (SELECT level, true AS with_empty, assets AS n, files AS f FROM keys UNION ALL SELECT level, false, full_assets, full_files FROM keys WHERE full_assets > 0) SELECT level, with_empty, count(*) AS keys, count(*) FILTER (n > 1) AS multi_asset_keys, CAST(coalesce(sum(f) FILTER (n > 1), 0) AS BIGINT) AS files_in_multi_asset_keys, max(n) AS most_assets, CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) AS asset_pairs, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess FROM b GROUP BY level, with_empty")
_SAME_KEY = "lv.level = k.level AND lv.token = k.token AND lv.file_date IS NOT DISTINCT FROM k.file_date AND lv.group_id IS NOT DISTINCT FROM k.group_id AND lv.source_id IS NOT DISTINCT FROM k.source_id"
_tokens(scope.assets_in_collisions, _KEYS + f", c AS (SELECT lv.level, true AS with_empty, lv.asset_id FROM lv JOIN keys k ON {_SAME_KEY} WHERE assets > 1 UNION ALL SELECT lv.level, false, lv.asset_id FROM lv JOIN keys k ON {_SAME_KEY} WHERE full_assets > 1 AND size > 0) SELECT level, with_empty, count(DISTINCT asset_id) AS assets FROM c GROUP BY level, with_empty")
_add("group_records", lambda s, d: _keyed(scope.group_records(scope.token_rows(media_files(s, d), device_groups(s)))), _GROUPS + " SELECT * FROM g")
_GAPS = (("0", "= 0"), ("1", "= 1"), ("2", "= 2"), ("3-5", "BETWEEN 3 AND 5"), ("6-10", "BETWEEN 6 AND 10"), (">10", "> 10"))
_tokens(scope.continuity, _GROUPS + f" SELECT level, {_band('tokens', 'counts')} AS band, count(*) AS groups, count(*) FILTER (least = 0) AS from_zero, count(*) FILTER (least = 1) AS from_one, count(*) FILTER (least > 1) AS from_higher, " + ", ".join(f'count(*) FILTER (missing_inside {t}) AS "gap {n}"' for n, t in _GAPS) + ", CAST(sum(tokens) AS BIGINT) AS distinct_tokens, CAST(sum(missing_inside) AS BIGINT) AS missing, max(missing_inside) AS most_missing, count(*) FILTER (greatest + 1 = tokens) AS perfect_prefix, count(*) FILTER (missing_inside = 0 AND least > 0) AS gapless_not_from_zero FROM g GROUP BY 1, 2")
_tokens(scope.joint_bands, _GROUPS + f" SELECT level, {_band('assets', 'counts')} AS assets_band, {_band('tokens', 'counts')} AS tokens_band, count(*) AS groups FROM g WHERE level <> 'Date' GROUP BY 1, 2, 3")
_tokens(scope.signed_difference, _GROUPS + " SELECT level, assets - tokens AS difference, count(*) AS groups FROM g GROUP BY 1, 2")
_tokens(scope.largest_token_group, _GROUPS + " SELECT source_id, file_date, greatest, files FROM g WHERE level = 'SourceDate' ORDER BY greatest DESC, files DESC, file_date, source_id LIMIT 1")
_CURVE = _T + ", c AS (SELECT token, count(*) AS files, count(DISTINCT asset_id) AS assets, count(DISTINCT file_date) AS dates, count(DISTINCT (group_id, file_date)) AS group_dates, count(DISTINCT (source_id, file_date)) AS source_dates FROM t GROUP BY token)"
_tokens(scope.token_curve, _CURVE + " SELECT * FROM c")
_tokens(scope.curve_ascents, _CURVE + ", r AS (SELECT dates - lag(dates) OVER (ORDER BY token) AS rise FROM c) SELECT count(*) FILTER (rise > 0) AS ascents, coalesce(max(rise) FILTER (rise > 0), 0) AS largest_rise FROM r")
_tokens(scope.token_reuse, _T + ", p AS (SELECT 'Pooled' AS level, CAST(NULL AS BIGINT) AS part, token, file_date FROM t UNION ALL SELECT 'DeviceGroup', group_id, token, file_date FROM t UNION ALL SELECT 'Source', source_id, token, file_date FROM t), n AS (SELECT level, part, token, count(DISTINCT file_date) AS n FROM p GROUP BY ALL) SELECT level, part, count(*) AS tokens, min(n) AS least, quantile_disc(n, 0.5) AS lower_median, max(n) AS most FROM n GROUP BY level, part")
_tokens(scope.token_agreement, _T + ", c AS (" + " UNION ALL ".join(f"SELECT asset_id, '{k}' AS level, min(token) = max(token) AS same FROM t GROUP BY asset_id{by} HAVING count(*) > 1" for k, by in (("WithinSourceDate", ", file_date, group_id, source_id"), ("WithinDeviceGroupDate", ", file_date, group_id"), ("WithinDate", ", file_date"), ("AcrossDates", ""))) + ") SELECT level, count(DISTINCT asset_id) AS assets, count(*) AS cells, count(*) FILTER (same) AS same_token_cells FROM c GROUP BY level")
_tokens(scope.source_pairs, _T + ", p AS (SELECT asset_id, file_date, source_id, min(token) AS lo, max(token) AS hi FROM t GROUP BY ALL) SELECT count(*) AS pairs, count(*) FILTER (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo) AS agreeing_pairs FROM p a JOIN p b ON a.asset_id = b.asset_id AND a.file_date = b.file_date AND a.source_id < b.source_id")
_tokens(scope.empty_assets, _T + " SELECT count(*) AS files, count(DISTINCT asset_id) AS assets, count(DISTINCT token) AS tokens, CASE WHEN count(*) >= 2 THEN count(DISTINCT token) = 1 END AS same_token FROM t WHERE size = 0")
_add("date_populations", lambda s, d: scope.date_populations(f := media_files(s, d), scope.token_rows(f, device_groups(s))), _T + ", d AS (SELECT file_date, max(m) AS m, max(k) AS k FROM (SELECT file_date, 1 AS m, 0 AS k FROM files WHERE file_date IS NOT NULL AND size > 0 UNION ALL SELECT file_date, 0, 1 FROM t) GROUP BY 1) SELECT CAST(sum(m) AS BIGINT) AS media_dates, CAST(sum(k) AS BIGINT) AS token_dates, CAST(sum(m * k) AS BIGINT) AS both, count(*) FILTER (k = 0) AS media_only, count(*) FILTER (m = 0) AS token_only FROM d")

# Order across and within directions, over dates with few files each.
_COHORT = _REL + """, one AS (SELECT attachment_id, any_value(sequence_number) AS sequence_number, any_value(message_date) AS message_date, any_value(direction) AS direction, any_value(asset_id) AS asset_id FROM rel WHERE compatibility = 'Compatible' GROUP BY 1 HAVING count(*) = 1),
 gr AS (SELECT message_date, direction, count(*) AS relations, min(sequence_number) AS first_sequence, min(asset_id) AS asset_id, max(asset_id) AS last_asset_id FROM one GROUP BY 1, 2),
 cohort AS (SELECT gr.*, coalesce(string_agg(DISTINCT lpad(CAST(token AS VARCHAR), 4, '0'), ',' ORDER BY lpad(CAST(token AS VARCHAR), 4, '0')), '') AS tokens, coalesce(string_agg(DISTINCT lpad(CAST(token AS VARCHAR), 4, '0'), ',' ORDER BY lpad(CAST(token AS VARCHAR), 4, '0')) FILTER ((direction = 'Outgoing') = is_sent), '') AS agreeing_tokens
 FROM gr LEFT JOIN tokens t ON t.asset_id = gr.asset_id AND t.file_date = gr.message_date AND token IS NOT NULL GROUP BY ALL)"""
_shown = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(x.cast("string"), 4, "0")), ",").alias(c)
_cohort = lambda s, d, dates=ORDER: sequence.cohort_groups(attachments(s, d, dates), media_files(s, d, dates), LOCAL)
_cohort_shown = lambda g: g.select("message_date", "direction", "relations", "first_sequence", "asset_id", "last_asset_id", _shown("tokens"), _shown("agreeing_tokens"))
_add("cohort_groups", lambda s, d: _cohort_shown(_cohort(s, d)), _COHORT + " SELECT * FROM cohort", ORDER)
_add("cohort_groups_dense", lambda s, d: _cohort_shown(_cohort(s, d, DENSE)), _COHORT + " SELECT * FROM cohort")
_STRICT = _COHORT + """, x AS (SELECT o.message_date, o.first_sequence < i.first_sequence AS out_first, string_split(o.tokens, ',') AS ot, string_split(i.tokens, ',') AS it, string_split(o.agreeing_tokens, ',') AS oa, string_split(i.agreeing_tokens, ',') AS ia
  FROM cohort o JOIN cohort i ON o.message_date = i.message_date AND o.direction = 'Outgoing' AND i.direction = 'Incoming' AND o.relations = 1 AND i.relations = 1),
 y AS (SELECT *, TRY_CAST(ot[1] AS INTEGER) AS t, TRY_CAST(it[1] AS INTEGER) AS u FROM x),
 z AS (SELECT *, CASE WHEN t IS NULL OR u IS NULL THEN 'NoToken' WHEN len(ot) > 1 OR len(it) > 1 THEN 'SeveralTokens' WHEN t = u THEN 'EqualTokens' WHEN (t < u) = out_first THEN 'Concordant' ELSE 'Discordant' END AS verdict FROM y),
 strict AS (SELECT message_date, verdict, CASE WHEN verdict IN ('Concordant', 'Discordant') THEN abs(t - u) END AS distance, CASE WHEN verdict IN ('Concordant', 'Discordant') THEN list_contains(oa, ot[1]) AND list_contains(ia, it[1]) END AS both_agreeing FROM z)"""
_add("strict_order", lambda s, d: sequence.strict_order(_cohort(s, d)), _STRICT + " SELECT * FROM strict", ORDER)
_add("order_summary", lambda s, d: sequence.order_summary(sequence.strict_order(_cohort(s, d))))  # exact counts have no SQL
_add("displacement_bands", lambda s, d: sequence.displacement_bands(sequence.strict_order(_cohort(s, d))), _STRICT + f" SELECT verdict, {_band('distance', 'candidates')} AS band, count(*) AS dates FROM strict WHERE distance IS NOT NULL GROUP BY 1, 2", ORDER)
_PROVENANCE = _COHORT + " SELECT direction, CASE WHEN tokens = '' THEN 'NoToken' WHEN agreeing_tokens = '' THEN 'UnknownOnly' WHEN agreeing_tokens = tokens THEN 'AgreeingOnly' ELSE 'Both' END AS provenance, count(*) AS groups, CAST(sum(relations) AS BIGINT) AS relations FROM cohort GROUP BY 1, 2"
_add("token_provenance", lambda s, d: sequence.token_provenance(_cohort(s, d)), _PROVENANCE, ORDER)
_files(sequence.namespaces, """, k AS (SELECT file_date, token, bool_or(is_sent) AS o, bool_or(NOT is_sent) AS i FROM tokens WHERE token IS NOT NULL AND is_sent IS NOT NULL AND size > 0 GROUP BY 1, 2),
 c AS (SELECT *, CASE WHEN o AND i THEN NULL WHEN o THEN 'O' ELSE 'I' END AS kind FROM k), l AS (SELECT *, lag(kind) OVER (PARTITION BY file_date ORDER BY token) AS was FROM c),
 d AS (SELECT file_date, count(*) FILTER (o) AS o_tokens, count(*) FILTER (i) AS i_tokens, count(*) FILTER (o AND i) AS shared, count(*) FILTER (kind <> was) AS transitions, min(token) FILTER (o) AS ol, max(token) FILTER (o) AS oh, min(token) FILTER (i) AS il, max(token) FILTER (i) AS ih FROM l GROUP BY 1)
 SELECT file_date, o_tokens, i_tokens, shared, transitions, CASE WHEN o_tokens = 1 OR i_tokens = 1 THEN 'SingletonInvolved' WHEN oh < il THEN 'OutgoingBelow' WHEN ih < ol THEN 'IncomingBelow' ELSE 'Overlapping' END AS ranges FROM d WHERE o_tokens > 0 AND i_tokens > 0""")


def _assign(agreeing: bool = False) -> str:
    """Groups (a) and their numbered positions (pos); with ``agreeing``, only copies that record the direction hold a position."""
    only = " AND (own.direction = 'Outgoing') = is_sent" if agreeing else ""
    return _REL.replace("FROM attachments", "FROM sent") + f""", m AS (SELECT message_date, direction, count(DISTINCT attachment_id) AS messages FROM rel WHERE direction <> 'Unknown' GROUP BY 1, 2),
 own AS (SELECT DISTINCT message_date, direction, asset_id FROM rel WHERE compatibility = 'Compatible' AND direction <> 'Unknown'), n AS (SELECT message_date, direction, count(*) AS assets FROM own GROUP BY 1, 2),
 held AS (SELECT DISTINCT own.*, token FROM own JOIN tokens t ON t.asset_id = own.asset_id AND t.file_date = own.message_date AND token IS NOT NULL{only}), p AS (SELECT message_date, direction, count(DISTINCT token) AS positions FROM held GROUP BY 1, 2),
 pos AS (SELECT *, dense_rank() OVER (PARTITION BY message_date, direction ORDER BY token) AS at, count(*) OVER (PARTITION BY message_date, direction, token) AS seated FROM held),
 a0 AS (SELECT message_date, direction, messages, coalesce(assets, 0) AS assets, coalesce(positions, 0) AS positions FROM m LEFT JOIN n USING (message_date, direction) LEFT JOIN p USING (message_date, direction)),
 a AS (SELECT *, CASE WHEN assets = 0 THEN 'NoCompatibleAsset' WHEN positions = 0 THEN 'NoSupportedTokenPosition' WHEN positions < messages THEN 'TooFewPositions' ELSE 'Feasible' END AS state, CASE WHEN assets > 0 AND positions > 0 AND positions >= messages THEN positions - messages END AS slack FROM a0),
 halves AS (SELECT direction AS side, * FROM a UNION ALL SELECT NULL, * FROM a),
 unions AS (SELECT a.message_date, a.direction, CAST(r.rank AS INTEGER) AS rank, any_value(a.assets) AS assets, count(DISTINCT pos.asset_id) AS possible_assets, bool_or(seated > 1) AS heavy FROM a, LATERAL (SELECT unnest(range(1, messages + 1)) AS rank) r
  JOIN pos ON pos.message_date = a.message_date AND pos.direction = a.direction AND pos.at BETWEEN r.rank AND r.rank + slack WHERE state = 'Feasible' GROUP BY 1, 2, 3),
 narrowed AS (SELECT *, CASE WHEN possible_assets = assets THEN 'NoReduction' WHEN possible_assets = 1 THEN 'Unique' ELSE 'Reduced' END AS narrowing FROM unions)"""


_assigned = lambda s, d, dates=GATE, agreeing=False: sequence.assignment_groups(sent_attachments(s, d, dates), media_files(s, d, dates), LOCAL, agreeing)
_GROUPED = " SELECT message_date, direction, messages, assets, positions, state, slack FROM a"
_add("assignment_groups", lambda s, d: _assigned(s, d, DENSE).drop("seats"), _assign() + _GROUPED)
_add("agreeing_assignment_groups", lambda s, d: _assigned(s, d, DENSE, True).drop("seats"), _assign(True) + _GROUPED)
_add("sliding_unions", lambda s, d: sequence.sliding_unions(_assigned(s, d)), _assign() + " SELECT * FROM narrowed", GATE)
_SEATS = lambda g: g.select("message_date", "direction", F.posexplode("seats").alias("at", "seat")).select("message_date", "direction", (F.col("at") + 1).alias("at"), F.array_join("seat", ",").alias("assets"))
_add("assignment_seats", lambda s, d: _SEATS(_assigned(s, d)), _assign() + " SELECT message_date, direction, CAST(pos.at AS INTEGER) AS \"at\", string_agg(CAST(asset_id AS VARCHAR), ',' ORDER BY asset_id) AS assets FROM pos JOIN a USING (message_date, direction) GROUP BY 1, 2, 3", GATE)
_add("assignment_counts", lambda s, d: sequence.assignment_counts(_assigned(s, d)))

# The gate.
_SIDES = ", msg AS (SELECT message_date, string_agg(CASE WHEN sender_id = 1 THEN 'O' ELSE 'I' END, '' ORDER BY sequence_number, attachment_id) AS pattern FROM sent GROUP BY 1)"
_add("message_patterns", lambda s, d: gate.message_patterns(sent_attachments(s, d, GATE), LOCAL), _SIDES + " SELECT * FROM msg", GATE)
_POS = _T + """, pos AS (SELECT scope, scope_key, file_date, token, count(*) FILTER (is_sent) AS sent, count(*) FILTER (NOT is_sent) AS not_sent, count(*) FILTER (is_sent IS NULL) AS unknown
 FROM (SELECT 'SourceDate' AS scope, CAST(source_id AS BIGINT) AS scope_key, * FROM t UNION ALL SELECT 'DeviceGroupDate', CAST(group_id AS BIGINT), * FROM t) GROUP BY 1, 2, 3, 4),
 labels AS (SELECT *, CASE WHEN sent > 0 AND not_sent > 0 THEN 'Conflict' WHEN sent > 0 THEN 'O' WHEN not_sent > 0 THEN 'I' ELSE 'Unlabelled' END AS label FROM pos)"""
_add("logical_positions", lambda s, d: gate.logical_positions(media_files(s, d), device_groups(s)), _POS + " SELECT * FROM labels")
_pairs = lambda s, d: gate.pairs(sent_attachments(s, d, GATE), media_files(s, d, GATE), device_groups(s), LOCAL)
_PAIRS = _POS + _SIDES + """, shapes AS (SELECT scope, scope_key, file_date, count(*) FILTER (label = 'Conflict') AS conflicts, count(*) FILTER (label = 'Unlabelled') AS unlabelled, CAST(sum(sent) AS BIGINT) AS sent_copies, CAST(sum(not_sent) AS BIGINT) AS not_sent_copies, string_agg(label, '' ORDER BY token) FILTER (label IN ('O', 'I')) AS token_pattern FROM labels GROUP BY 1, 2, 3),
 keyed AS (SELECT DISTINCT 'SourceDate' AS scope, CAST(source_id AS BIGINT) AS scope_key FROM files UNION SELECT 'DeviceGroupDate', CAST(group_id AS BIGINT) FROM files JOIN device_groups USING (source_id)),
 every AS (SELECT scope, scope_key, message_date AS file_date FROM keyed, msg UNION SELECT scope, scope_key, file_date FROM shapes),
 p0 AS (SELECT scope, scope_key, file_date, coalesce(conflicts, 0) AS conflicts, coalesce(unlabelled, 0) AS unlabelled, coalesce(sent_copies, 0) AS sent_copies, coalesce(not_sent_copies, 0) AS not_sent_copies, coalesce(token_pattern, '') AS token_pattern, coalesce(pattern, '') AS pattern FROM every LEFT JOIN shapes USING (scope, scope_key, file_date) LEFT JOIN msg ON msg.message_date = every.file_date),
 p1 AS (SELECT *, length(replace(pattern, 'I', '')) AS m_out, length(replace(pattern, 'O', '')) AS m_in, length(replace(token_pattern, 'I', '')) AS t_out, length(replace(token_pattern, 'O', '')) AS t_in, CAST(len(regexp_extract_all(token_pattern, 'O+|I+')) AS BIGINT) AS token_runs FROM p0),
 p2 AS (SELECT *, token_pattern = '' AS no_tokens, length(pattern) = 1 AS single_symbol, token_pattern <> '' AND t_out = 0 AS no_outgoing, token_pattern <> '' AND t_in = 0 AS no_incoming, token_pattern <> '' AND (t_out = 0 OR t_in = 0 OR (token_runs = t_out + t_in AND t_out <> t_in)) AS single_arrangement,
  sent_copies >= m_out AND not_sent_copies >= m_in AS supply_copies, t_out >= m_out AND t_in >= m_in AS supply_positions FROM p1),
 pairs AS (SELECT *, CASE WHEN pattern = '' THEN 'NoMessageSymbols' WHEN conflicts > 0 THEN 'ExcludedByDirectionConflict' WHEN no_tokens THEN 'NoTokenPositions' WHEN NOT supply_positions THEN 'SupplyInsufficient' WHEN single_symbol OR no_outgoing OR no_incoming OR single_arrangement THEN 'Degenerate' ELSE 'Classified' END AS state FROM p2),
 measured AS (SELECT *, length(pattern) AS symbols FROM pairs WHERE pattern <> '' AND conflicts = 0)"""
_gate = lambda name, op, body: _add(name, lambda s, d: op(_pairs(s, d)), _PAIRS + body, GATE)
_gate("gate_pairs", lambda p: p, " SELECT * FROM pairs")
_gate("pair_states", gate.pair_states, " SELECT scope, state, count(*) AS pairs, CAST(sum(length(pattern)) AS BIGINT) AS message_symbols FROM pairs GROUP BY 1, 2")
_gate("pair_supply", gate.supply, " SELECT scope, count(*) AS pairs, count(*) FILTER (supply_copies) AS enough_copies, count(*) FILTER (supply_positions) AS enough_positions FROM measured GROUP BY 1")
_gate("numbered_pairs", gate.numbered, " SELECT *, row_number() OVER (ORDER BY CASE scope WHEN 'SourceDate' THEN 0 ELSE 1 END, scope_key, file_date) AS pair_id FROM pairs WHERE pattern <> ''")
_add("reference_counts", lambda s, d: gate.reference_counts(_pairs(s, d)))
_add("source_overlap", lambda s, d: gate.source_overlap(media_files(s, d), device_groups(s)), _T + ", k AS (SELECT DISTINCT source_id, file_date, token FROM t), n AS (SELECT file_date, token, count(*) AS c FROM k GROUP BY 1, 2) SELECT source_id, count(DISTINCT file_date) AS dates, count(*) AS keys, count(*) FILTER (c > 1) AS shared_keys FROM k JOIN n USING (file_date, token) GROUP BY 1")

# The chat parser, over conversations written as exports.
_add("parsed_messages", lambda s, d: parse_messages(chat_exports(s, d)).select("doc", "sequence_number", "message_type", "sender", "content", "is_placeholder"))
ORACLE_SQL["parsed_messages"] = "SELECT conv_id AS doc, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS sequence_number, 'User' AS message_type, role AS sender, said AS content, said = '<Media omitted>' AS is_placeholder FROM (SELECT *, CASE WHEN (conv_id + turn) % 7 = 0 THEN '<Media omitted>' ELSE text END AS said FROM conversations) WHERE conv_id IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL"

# Reports over the gate's pairs.
_SIZES = (("1", "<= 1"), ("2", "= 2"), ("3-5", "BETWEEN 3 AND 5"), ("6-10", "BETWEEN 6 AND 10"), ("11-25", "BETWEEN 11 AND 25"), (">25", "> 25"))
_COUNTED = "count(n) AS population, coalesce(min(n), 0) AS least, coalesce(quantile_disc(n, 0.5), 0) AS lower_median, coalesce(max(n), 0) AS most, " + ", ".join(f'count(*) FILTER (n {t}) AS "band {b}"' for b, t in _SIZES)
_SIGNS = "count(*) FILTER ({0} < 0) AS negative, count(*) FILTER ({0} = 0) AS zero, count(*) FILTER ({0} > 0) AS positive, "
_STEPS = ((None, 1), (1, 2), (2, 5), (5, 10), (10, 25), (25, None))
_DIFFERENCES = "count(n) AS population, min(n) AS least, quantile_disc(n, 0.5) AS lower_median, max(n) AS most, " + _SIGNS.format("n") + ", ".join(f"count(*) FILTER ({f'abs(n) > {a}' if a else 'true'} AND {f'abs(n) <= {b}' if b else 'true'}) AS \"size {f'<={b}' if b else '>25'}\"" for a, b in _STEPS)
_gate("degenerate_kinds", gate.degenerate_kinds, " SELECT scope, " + ", ".join(f"count(*) FILTER ({k}) AS {k}" for k in gate.DEGENERATE) + f", count(*) FILTER ({' OR '.join(gate.DEGENERATE)}) AS degenerate, CAST(coalesce(sum(symbols) FILTER ({' OR '.join(gate.DEGENERATE)}), 0) AS BIGINT) AS message_symbols FROM measured GROUP BY 1")
_gate("dilution", gate.dilution, f", d AS (SELECT scope, 'message_symbols' AS measure, symbols AS n FROM measured WHERE NOT no_tokens UNION ALL SELECT scope, 'token_positions', t_out + t_in FROM measured WHERE NOT no_tokens) SELECT scope, measure, {_COUNTED} FROM d GROUP BY 1, 2")
_gate("conversation_share", gate.conversation_share, ", d AS (SELECT scope, symbols AS x, t_out + t_in AS y, CAST(symbols * 1000000000000 // (t_out + t_in) AS DOUBLE) / 1e12 AS n FROM measured WHERE NOT no_tokens), b AS (SELECT *, CASE WHEN x = 0 THEN '0' WHEN 20 * x <= y THEN '<=0.05' WHEN 4 * x <= y THEN '<=0.25' WHEN 2 * x <= y THEN '<=0.5' WHEN 20 * x <= 19 * y THEN '<=0.95' WHEN x < y THEN '<1' WHEN x = y THEN '1' ELSE '>1' END AS band FROM d)"
      + " SELECT scope, count(n) AS population, min(n) AS least, quantile_disc(n, 0.5) AS lower_median, max(n) AS most, " + _SIGNS.format("x") + ", ".join(f"count(*) FILTER (band = '{b}') AS \"size {b}\"" for b in ("<=0.05", "<=0.25", "<=0.5", "<=0.95", "<1", "1", ">1")) + " FROM b GROUP BY 1")
_gate("shortfalls", gate.shortfalls, " SELECT scope, count(*) AS pairs, " + ", ".join(f"CAST(sum(greatest(0, {w} - {h})) AS BIGINT) AS {n}" for n, h, w in (("outgoing_before", "sent_copies", "m_out"), ("incoming_before", "not_sent_copies", "m_in"), ("outgoing_after", "t_out", "m_out"), ("incoming_after", "t_in", "m_in")))
      + ", count(*) FILTER (supply_copies AND NOT supply_positions) AS become_insufficient, count(*) FILTER (NOT supply_copies AND supply_positions) AS become_sufficient, CAST(coalesce(sum(symbols) FILTER (supply_copies AND NOT supply_positions), 0) AS BIGINT) AS symbols_lost FROM measured GROUP BY 1")
_gate("shortfall_differences", gate.shortfall_differences, f", d AS (SELECT scope, t_out + t_in - symbols AS n FROM measured) SELECT scope, {_DIFFERENCES} FROM d GROUP BY 1")
_add("message_population", lambda s, d: gate.message_population(gate.message_patterns(sent_attachments(s, d, GATE), LOCAL)), _SIDES + ", r AS (SELECT pattern, CAST(len(regexp_extract_all(pattern, 'O+|I+')) AS BIGINT) AS runs FROM msg), v AS (SELECT 'length' AS measure, CAST(length(pattern) AS VARCHAR) AS value FROM r UNION ALL SELECT 'runs', CAST(runs AS VARCHAR) FROM r UNION ALL SELECT 'transitions', CAST(runs - 1 AS VARCHAR) FROM r"
     " UNION ALL SELECT 'directions', CASE WHEN NOT contains(pattern, 'I') THEN 'OutgoingOnly' WHEN NOT contains(pattern, 'O') THEN 'IncomingOnly' ELSE 'Both' END FROM r) SELECT measure, value, count(*) AS dates FROM v GROUP BY 1, 2", GATE)  # fmt: skip
_add("determinacy", lambda s, d: gate.determinacy(gate.reference_counts(_pairs(s, d))))
_gate("burstiness_summary", lambda p: gate.burstiness_summary(gate.reference_counts(p)), f", d AS (SELECT scope, token_runs - (1 + 2 * t_out * t_in / (t_out + t_in)) AS n FROM pairs WHERE state = 'Classified') SELECT scope, {_DIFFERENCES} FROM d GROUP BY 1")
_SOURCE_POPULATIONS = _POS + """, n AS (SELECT file_date, token, count(*) AS sources FROM labels WHERE scope = 'SourceDate' GROUP BY 1, 2),
 l AS (SELECT scope_key AS source_id, count(*) AS positions, count(*) FILTER (label IN ('O', 'I')) AS labelled, count(*) FILTER (label = 'Unlabelled') AS unlabelled, count(*) FILTER (label = 'Conflict') AS conflicting, count(*) FILTER (sources > 1) AS shared FROM labels JOIN n USING (file_date, token) WHERE scope = 'SourceDate' GROUP BY 1),
 h AS (SELECT source_id, count(*) AS with_token, count(is_sent) AS with_direction, count(DISTINCT file_date) AS dates, min(file_date) AS first_date, max(file_date) AS last_date FROM t GROUP BY 1),
 sp AS (SELECT f.source_id, files, dated, group_id, coalesce(with_token, 0) AS with_token, coalesce(with_direction, 0) AS with_direction, coalesce(dates, 0) AS dates, first_date, last_date, coalesce(positions, 0) AS positions, coalesce(labelled, 0) AS labelled, coalesce(unlabelled, 0) AS unlabelled, coalesce(conflicting, 0) AS conflicting, coalesce(shared, 0) AS shared
  FROM (SELECT source_id, count(*) AS files, count(file_date) AS dated FROM files GROUP BY 1) f LEFT JOIN device_groups USING (source_id) LEFT JOIN h USING (source_id) LEFT JOIN l USING (source_id))"""
_add("source_populations", lambda s, d: gate.source_populations(media_files(s, d), device_groups(s)), _SOURCE_POPULATIONS + " SELECT * FROM sp")
_add("group_populations", lambda s, d: gate.group_populations(media_files(s, d), device_groups(s)), _SOURCE_POPULATIONS + """, fa AS (SELECT group_id, count(*) AS sources, count(*) FILTER (with_direction = 0) AS blind_sources, CAST(sum(files) AS BIGINT) AS files, CAST(sum(with_token) AS BIGINT) AS with_token, CAST(sum(with_direction) AS BIGINT) AS with_direction, CAST(coalesce(sum(with_token) FILTER (with_direction = 0), 0) AS BIGINT) AS blind_files FROM sp GROUP BY 1),
 pg AS (SELECT t.group_id, t.file_date, token, coalesce(bool_or(is_sent), false) AS o, coalesce(bool_or(NOT is_sent), false) AS i, bool_and(sp.with_direction = 0) AS blind FROM t JOIN sp USING (source_id) GROUP BY 1, 2, 3),
 lg AS (SELECT group_id, count(DISTINCT file_date) AS dates, count(*) AS positions, count(*) FILTER (o <> i) AS labelled, count(*) FILTER (NOT o AND NOT i) AS unlabelled, count(*) FILTER (o AND i) AS conflicting, count(*) FILTER (blind) AS blind_only FROM pg GROUP BY 1)
 SELECT * FROM fa JOIN lg USING (group_id)""")
_add("cross_source_overlap", lambda s, d: gate.cross_source_overlap(media_files(s, d), device_groups(s)), _T + """, per AS (SELECT file_date, token, source_id, group_id, coalesce(bool_or(is_sent), false) AS o, coalesce(bool_or(NOT is_sent), false) AS i FROM t GROUP BY 1, 2, 3, 4),
 pa AS (SELECT count(*) AS n, count(*) FILTER (o OR i) AS known, count(*) FILTER (o AND i) AS inside, count(*) FILTER (o AND NOT i) AS outs, count(*) FILTER (i AND NOT o) AS ins, count(DISTINCT group_id) FILTER (o OR i) AS groups FROM per GROUP BY file_date, token),
 k AS (SELECT *, n > 1 AND (inside > 0 OR (outs > 0 AND ins > 0)) AS clash FROM pa)
 SELECT count(*) AS positions, count(*) FILTER (n > 1) AS shared, count(*) FILTER (n = 1) AS single_source, count(*) FILTER (n > 1 AND NOT clash AND known > 1) AS agreeing, count(*) FILTER (clash) AS conflicting, count(*) FILTER (n > 1 AND NOT clash AND known = 1) AS one_side_known,
  count(*) FILTER (n > 1 AND known = 0) AS none_known, count(*) FILTER (clash AND (inside > 0 OR groups = 1)) AS conflicts_within_group, count(*) FILTER (clash AND inside = 0 AND groups > 1) AS conflicts_across_groups FROM k""")

# Reports over assignment groups.
_over = lambda op, body, dates=GATE: _add(op.__name__, lambda s, d: op(_assigned(s, d, dates)), _assign() + body, dates)
_HALVES = ", nh AS (SELECT direction AS side, * EXCLUDE (direction) FROM narrowed UNION ALL SELECT NULL, * EXCLUDE (direction) FROM narrowed)"
_add("narrowing_summary", lambda s, d: sequence.narrowing_summary(sequence.sliding_unions(_assigned(s, d))), _assign() + _HALVES + """ SELECT side AS direction, count(*) FILTER (narrowing = 'NoReduction') AS "NoReduction", count(*) FILTER (narrowing = 'Unique') AS "Unique", count(*) FILTER (narrowing = 'Reduced') AS "Reduced", count(*) FILTER (narrowing = 'NoReduction' AND assets = 1) AS already_unique,
 CAST(sum(assets) AS BIGINT) AS baseline_relations, CAST(sum(possible_assets) AS BIGINT) AS sequence_relations, count(*) FILTER (heavy) AS range_holds_heavy FROM nh GROUP BY 1""", GATE)
_over(sequence.assignment_bands, f", v AS (SELECT side, 'assets' AS measure, assets AS n FROM halves UNION ALL SELECT side, 'positions', positions FROM halves UNION ALL SELECT side, 'occurrences', (SELECT count(*) FROM pos WHERE pos.message_date = halves.message_date AND pos.direction = halves.direction) FROM halves) SELECT side AS direction, measure, {_band('n', 'candidates')} AS band, count(*) AS groups FROM v GROUP BY 1, 2, 3")
_over(sequence.feasibility, " SELECT side AS direction, state, count(*) AS groups, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(messages * assets) AS BIGINT) AS relations FROM halves GROUP BY 1, 2")
_over(sequence.slack_bands, ", v AS (SELECT side, messages, positions - messages AS n FROM halves) SELECT side AS direction, CASE WHEN n < 0 THEN '<0' WHEN n <= 2 THEN CAST(n AS VARCHAR) WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 25 THEN '11-25' ELSE '>25' END AS band, count(*) AS groups, CAST(sum(messages) AS BIGINT) AS messages FROM v GROUP BY 1, 2")
# whole conversations on dates with few files, so that places are too few
_add("shortfall_bands", lambda s, d: sequence.shortfall_bands(sequence.assignment_groups(sent_attachments(s, d, GATE), media_files(s, d, ORDER), LOCAL)))
ORACLE_SQL["shortfall_bands"] = oracle(_assign() + ", v AS (SELECT side, messages - positions AS n FROM halves WHERE state = 'TooFewPositions') SELECT side AS direction, CASE WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 25 THEN '11-25' ELSE '>25' END AS band, count(*) AS groups FROM v GROUP BY 1, 2", ORDER, GATE)
_over(sequence.multiplicity, """, per AS (SELECT direction AS side, message_date, direction, asset_id, count(*) AS n FROM pos GROUP BY ALL UNION ALL SELECT NULL, message_date, direction, asset_id, count(*) FROM pos GROUP BY message_date, direction, asset_id),
 hv AS (SELECT direction AS side, message_date, direction, count(DISTINCT token) AS n FROM pos WHERE seated > 1 GROUP BY ALL UNION ALL SELECT NULL, message_date, direction, count(DISTINCT token) FROM pos WHERE seated > 1 GROUP BY message_date, direction),
 hs AS (SELECT side, CAST(sum(n) AS BIGINT) AS heavy_positions, count(*) AS groups_with_heavy FROM hv GROUP BY 1)
 SELECT p.side AS direction, count(*) FILTER (n = 1) AS assets_at_one, count(*) FILTER (n > 1) AS assets_at_several, max(n) AS most_positions, coalesce(any_value(heavy_positions), 0) AS heavy_positions, coalesce(any_value(groups_with_heavy), 0) AS groups_with_heavy FROM per p LEFT JOIN hs ON p.side IS NOT DISTINCT FROM hs.side GROUP BY 1""")
_add("forced_assignments", lambda s, d: sequence.forced_assignments(_assigned(s, d, ORDER)), _assign() + """, f AS (SELECT side, messages, (SELECT count(DISTINCT token) FROM pos WHERE pos.message_date = halves.message_date AND pos.direction = halves.direction AND seated > 1) AS several, positions FROM halves WHERE slack = 0)
 SELECT side AS direction, count(*) AS groups, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(positions - several) AS BIGINT) AS one_asset, CAST(sum(several) AS BIGINT) AS several_assets FROM f GROUP BY 1""", ORDER)
_add("agreeing_loss", lambda s, d: sequence.agreeing_loss(_assigned(s, d), _assigned(s, d, GATE, True)), _assign() + """, ag AS (SELECT pos.message_date, pos.direction, pos.asset_id, pos.token FROM pos JOIN tokens t ON t.asset_id = pos.asset_id AND t.file_date = pos.message_date AND t.token = pos.token AND (pos.direction = 'Outgoing') = is_sent GROUP BY ALL),
 x AS (SELECT *, (SELECT count(DISTINCT asset_id) FROM pos WHERE pos.message_date = a.message_date AND pos.direction = a.direction) AS seated, (SELECT count(DISTINCT asset_id) FROM ag WHERE ag.message_date = a.message_date AND ag.direction = a.direction) AS seated_left,
  (SELECT count(DISTINCT token) FROM ag WHERE ag.message_date = a.message_date AND ag.direction = a.direction) AS positions_left FROM a)
 SELECT direction, CAST(sum(positions - positions_left) AS BIGINT) AS positions_removed, CAST(sum(seated - seated_left) AS BIGINT) AS assets_losing_all, CAST(sum(messages * assets) AS BIGINT) AS frozen_relations, CAST(sum(messages * seated_left) AS BIGINT) AS agreeing_relations FROM x GROUP BY 1""", GATE)
_add("excluded_attachments", lambda s, d: sequence.excluded_attachments(attachments(s, d), media_files(s, d)), _EV + " SELECT count(*) AS attachments, count(DISTINCT message_date) AS dates FROM attachments WHERE message_date NOT IN (SELECT file_date FROM ev)")

# Further scope and name reports.
_tokens(scope.observed_minima, _GROUPS + f" SELECT level, {_band('tokens', 'counts')} AS band, least, count(*) AS groups FROM g GROUP BY 1, 2, 3")
_add("scope_populations", lambda s, d: scope.group_populations(scope.token_rows(media_files(s, d), device_groups(s))), _GROUPS + ", x AS (SELECT level, CAST(NULL AS BIGINT) AS part, * EXCLUDE (level) FROM g UNION ALL SELECT level, CASE level WHEN 'SourceDate' THEN source_id ELSE group_id END, * EXCLUDE (level) FROM g WHERE level <> 'Date'), v AS (" + " UNION ALL ".join(f"SELECT level, part, '{m}' AS measure, {m} AS n FROM x" for m in ("files", "assets", "tokens", "names")) + f") SELECT level, part, measure, {_COUNTED} FROM v GROUP BY 1, 2, 3")
_tokens(scope.joint_tables, _GROUPS + """, c AS (SELECT level, tokens, 'MaximumToken' AS "by", CASE WHEN greatest <= 0 THEN '0000' WHEN greatest <= 2 THEN '0001-0002' WHEN greatest <= 5 THEN '0003-0005' WHEN greatest <= 10 THEN '0006-0010' WHEN greatest <= 25 THEN '0011-0025' WHEN greatest <= 50 THEN '0026-0050' WHEN greatest <= 100 THEN '0051-0100' ELSE '0101+' END AS "column" FROM g
 UNION ALL SELECT level, tokens, 'InternalGapCount', CASE WHEN missing_inside <= 2 THEN CAST(missing_inside AS VARCHAR) WHEN missing_inside <= 5 THEN '3-5' WHEN missing_inside <= 10 THEN '6-10' ELSE '>10' END FROM g UNION ALL SELECT level, tokens, 'MaximumPlusOneEqualsDistinctCount', CASE WHEN greatest + 1 = tokens THEN 'MaximumPlusOneEqualsDistinctCount' ELSE 'Otherwise' END FROM g"""
        + f" UNION ALL SELECT level, tokens, 'DistinctMediaAssetCount', {_band('assets', 'counts')} FROM g UNION ALL SELECT level, tokens, 'PhysicalFileCount', {_band('files', 'counts')} FROM g) SELECT level, \"by\", {_band('tokens', 'counts')} AS \"row\", \"column\", count(*) AS groups FROM c WHERE level <> 'Date' GROUP BY ALL")
_tokens(scope.token_locality, _T + """, d AS (SELECT asset_id FROM t GROUP BY 1 HAVING count(DISTINCT token) > 1), s AS (SELECT DISTINCT asset_id FROM t GROUP BY asset_id, file_date, group_id, source_id HAVING count(DISTINCT token) > 1), g AS (SELECT DISTINCT asset_id FROM t GROUP BY asset_id, file_date, group_id HAVING count(DISTINCT token) > 1), e AS (SELECT DISTINCT asset_id FROM t GROUP BY asset_id, file_date HAVING count(DISTINCT token) > 1),
 p AS (SELECT CASE WHEN asset_id IN (FROM s) THEN 's' WHEN asset_id IN (FROM g) THEN 'g' WHEN asset_id IN (FROM e) THEN 'e' ELSE 'x' END AS p FROM d) SELECT count(*) AS assets, count(*) FILTER (p = 's') AS within_source_and_date, count(*) FILTER (p = 'g') AS within_group_and_date, count(*) FILTER (p = 'e') AS across_groups, count(*) FILTER (p = 'x') AS across_dates FROM p""")
_tokens(scope.token_curve_by_group, _T + " SELECT token, group_id, count(*) AS files, count(DISTINCT file_date) AS dates FROM t GROUP BY 1, 2")
# files under other endings, so that some are unknown
_renamed = lambda s, d: media_files(s, d).withColumn("ext", F.when(F.col("file_id") % 5 == 0, ".xyz").when(F.col("file_id") % 7 == 0, ".abc").when(F.col("file_id") % 11 != 0, F.col("ext")))
_RENAMED = ", x AS (SELECT CASE WHEN file_id % 5 = 0 THEN '.xyz' WHEN file_id % 7 = 0 THEN '.abc' WHEN file_id % 11 <> 0 THEN ext END AS e, * FROM files)"
_add("unknown_extensions", lambda s, d: names.unknown_extensions(_renamed(s, d)), _RENAMED + " SELECT coalesce(e, '<none>') AS ext, count(*) AS files FROM x WHERE e IS NULL OR e IN ('.xyz', '.abc') GROUP BY 1")
_add("name_problems", lambda s, d: names.name_problems(_renamed(s, d).withColumnRenamed("ext", "recorded_ext").join(media_files(s, d).select("file_id", "ext"), "file_id").withColumn("file_date", F.coalesce("file_date", F.when(F.col("file_id") % 3 == 0, F.lit("2024-01-01").cast("date")))), device_groups(s).where("source_id <> 3")),
     _RENAMED + " SELECT count(*) FILTER (e IS NULL) AS without_extension, count(*) FILTER (e IS DISTINCT FROM ext) AS extension_mismatch, count(*) FILTER (file_date IS NULL AND file_id % 3 = 0) AS dated_without_marker, count(*) FILTER (source_id = 3) AS unrecorded_source FROM x")


# The workspace: what an import makes of the exports, unresolved attachments, contents and directions of files.
def _oracle_with(views: str, body: str) -> str:
    return f"WITH {views}{body}"


_IMPORT = "parsed AS (SELECT conv_id AS doc, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS sequence_number, role AS sender, CASE WHEN (conv_id + turn) % 7 = 0 THEN '<Media omitted>' ELSE text END AS content FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL), people AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY min(sequence_number)) AS participant_id, sender AS name FROM parsed GROUP BY doc, sender)"
_parsed = lambda s, d: parse_messages(chat_exports(s, d))
QUERIES["imported_participants"] = lambda s, d: workspace.participants(_parsed(s, d))
ORACLE_SQL["imported_participants"] = _oracle_with(_IMPORT, " SELECT * FROM people")
QUERIES["imported_messages"] = lambda s, d: workspace.imported_messages(m := _parsed(s, d), workspace.participants(m))
ORACLE_SQL["imported_messages"] = _oracle_with(_IMPORT, " SELECT doc, sequence_number, 'User' AS message_type, participant_id, content FROM parsed JOIN people USING (doc) WHERE name = sender")
QUERIES["imported_attachments"] = lambda s, d: workspace.placeholder_attachments(_parsed(s, d))
ORACLE_SQL["imported_attachments"] = _oracle_with(_IMPORT, " SELECT doc, sequence_number, 1 AS ordinal, 'Unresolved' AS status FROM parsed WHERE content = '<Media omitted>'")
_add("unresolved_scope", lambda s, d: matching.unresolved_scope(message_attachments(s, d), messages(s, d), media_files(s, d), 1), f", {MESSAGE_SQL}, u AS (SELECT * FROM linked JOIN messages USING (message_id) WHERE status = 'Unresolved'), media AS (SELECT DISTINCT file_date FROM files WHERE file_date IS NOT NULL AND size > 0)"
     " SELECT count(*) FILTER (conversation_id = 1) AS in_conversation, count(*) AS in_workspace, count(*) FILTER (conversation_id <> 1) AS elsewhere, count(*) FILTER (conversation_id = 1 AND sender_id IS NULL) AS without_sender, count(DISTINCT message_date) FILTER (conversation_id = 1) AS attachment_dates, (SELECT count(DISTINCT message_date) FROM messages WHERE conversation_id = 1) AS conversation_dates, count(*) FILTER (conversation_id = 1 AND message_date NOT IN (SELECT file_date FROM media)) AS on_dates_without_media FROM u")  # fmt: skip
QUERIES["multi_attachments"] = lambda s, d: gate.multi_attachments(messages(s, d), message_attachments(s, d))
ORACLE_SQL["multi_attachments"] = _oracle_with(MESSAGE_SQL, ", c AS (SELECT messages.message_id, count(linked.message_id) AS n FROM messages LEFT JOIN linked USING (message_id) GROUP BY 1) SELECT count(*) AS messages, count(*) FILTER (n = 0) AS without, count(*) FILTER (n > 1) AS with_several, coalesce(max(n), 0) AS most FROM c")
_hashed = lambda s, d: media_files(s, d).select("file_id", "source_id", F.col("name").alias("path"), F.when(F.col("file_id") % 9 != 0, F.concat(F.when(F.col("file_id") % 2 == 0, "ab").otherwise("AB"), F.col("asset_id").cast("string"))).alias("sha256"), (F.col("size") + F.when(F.col("file_id") % 31 == 0, 1).otherwise(0)).alias("size"), "media_type")
_add("content_assets", lambda s, d: evidence.content_assets(_hashed(s, d)), """, h AS (SELECT file_id, source_id, name, 'AB' || asset_id AS sha256, size + CASE WHEN file_id % 31 = 0 THEN 1 ELSE 0 END AS size, media_type FROM files WHERE file_id % 9 <> 0),
 f AS (SELECT sha256, first(file_id ORDER BY source_id, name, file_id) AS asset_file_id, first(size ORDER BY source_id, name, file_id) AS asset_size, first(media_type ORDER BY source_id, name, file_id) AS asset_media_type FROM h GROUP BY 1)
 SELECT file_id, sha256, asset_file_id, CAST(asset_size AS BIGINT) AS asset_size, asset_media_type, CASE WHEN size <> asset_size THEN 'SizeMismatch' WHEN media_type <> asset_media_type THEN 'TypeConflict' ELSE 'Linked' END AS state FROM h JOIN f USING (sha256)""")
_placed = lambda s, d: media_files(s, d).select("file_id", "source_id", "name", "media_type", F.concat(F.lit("Media/"), F.when((F.col("source_id") != 4) & (F.col("file_id") % 3 == 0), "SENT/").when(F.col("file_id") % 3 == 1, "Sent items/").otherwise(""), "name").alias("path"))
_add("directed_files", lambda s, d: inventory.with_direction(_placed(s, d)).groupBy("source_id", "is_sent").agg(F.count("*").alias("files")), ", p AS (SELECT source_id, source_id <> 4 AND file_id % 3 = 0 AS s FROM files), k AS (SELECT source_id, bool_or(s) AS known FROM p GROUP BY 1) SELECT source_id, CASE WHEN known THEN s END AS is_sent, count(*) AS files FROM p JOIN k USING (source_id) GROUP BY 1, 2")
_add("dates_from_names", lambda s, d: media_files(s, d).groupBy(file_date(F.when(F.col("source_id") != 2, DATED_SOURCE).otherwise("Other"), F.col("name")).alias("file_date")).agg(F.count("*").alias("files")), " SELECT CASE WHEN source_id <> 2 THEN file_date END AS file_date, count(*) AS files FROM files GROUP BY 1")


# exports in which some first lines are spoilt
_spoilt = lambda s, d: chat_exports(s, d).withColumn("value", F.when(F.col("doc") % 3 == 0, F.concat(F.lit("2026/02/30, 10:00 - x: y\n"), "value")).when(F.col("doc") % 3 == 1, F.concat(F.lit("no message\n \n2026/02/03, 10:00 - : z\n"), "value")).otherwise(F.col("value")))
QUERIES["export_problems"] = lambda s, d: parse_problems(_spoilt(s, d))
ORACLE_SQL["export_problems"] = _oracle_with(_IMPORT, ", d AS (SELECT DISTINCT doc FROM parsed) SELECT doc, 1 AS line, 'ImpossibleTime' AS problem FROM d WHERE doc % 3 = 0 UNION ALL SELECT doc, 1, 'TextBeforeFirstMessage' FROM d WHERE doc % 3 = 1 UNION ALL SELECT doc, 3, 'EmptySender' FROM d WHERE doc % 3 = 1")
_add("media_evidence", lambda s, d: evidence.media_evidence(f := media_files(s, d).drop("asset_id", "media_type", "size").withColumn("recorded", F.col("name")).drop("name"), media_files(s, d).where("file_id % 10 <> 0").select("file_id", "asset_id"), _hashed(s, d).where("sha256 is not null").groupBy(F.upper(F.regexp_replace("sha256", "^..", "")).cast("long").alias("asset_id")).agg(F.max("size").alias("size"), F.min("media_type").alias("media_type"), F.max(F.upper("sha256")).alias("sha256"))).select("file_id", "source_id", "file_date", "is_sent", "ext", "asset_id", "asset_size", "asset_media_type", "asset_sha256"),
     """, h AS (SELECT asset_id, 'AB' || asset_id AS sha256, size + CASE WHEN file_id % 31 = 0 THEN 1 ELSE 0 END AS size, media_type FROM files WHERE file_id % 9 <> 0), a AS (SELECT asset_id, CAST(max(size) AS BIGINT) AS asset_size, min(media_type) AS asset_media_type, max(sha256) AS asset_sha256 FROM h GROUP BY 1)
 SELECT file_id, source_id, file_date, is_sent, ext, l.asset_id, asset_size, asset_media_type, asset_sha256 FROM files f LEFT JOIN (SELECT file_id AS fid, asset_id FROM files WHERE file_id % 10 <> 0) l ON fid = file_id LEFT JOIN a ON a.asset_id = l.asset_id""")  # fmt: skip


# The guards, over views as they are and over views with planted faults.
def _guards(s: SparkSession, d: str, faults: bool) -> DataFrame:
    def at(test: str):
        return F.expr(test) if faults else F.lit(False)

    # what many guards read is made once
    f = materialize(media_files(s, d), "files").withColumn("sha256", F.when(~at("file_id % 101 = 0"), F.concat(F.when(F.col("file_id") % 2 == 0, "ab").otherwise("AB"), F.col("asset_id").cast("string"), F.when(at("file_id % 103 = 0"), "x").otherwise(""))))
    links = f.where(~at("file_id % 127 = 0")).select("file_id", "asset_id")
    links = links.union(links.where(at("file_id % 131 = 0")).select("file_id", F.col("asset_id") + 1))
    assets = f.select("asset_id").distinct().where(~at("asset_id % 137 = 0")).select("asset_id", F.concat(F.lit("AB"), F.col("asset_id").cast("string")).alias("sha256"))
    name = F.when(at("file_id % 113 = 0"), "x.jpg").otherwise(F.col("name"))
    day = F.when(~at("file_id % 109 = 0"), F.when(at("file_id % 107 = 0"), F.date_add("file_date", 1)).otherwise(F.col("file_date")))
    dated = f.select("file_id", "source_id", name.alias("name"), day.alias("file_date"))
    written = f.select("file_id", F.when(at("file_id % 139 = 0"), "2024-1-05").when(at("file_id % 149 = 0"), "2024-02-30").otherwise(F.col("file_date").cast("string")).alias("day"))
    groups = device_groups(s)
    if faults:
        groups = groups.where("source_id <> 4").union(s.createDataFrame([(1, 502), (9, 509)], "source_id long, group_id long"))
    m = messages(s, d)
    asked = s.createDataFrame([(1, 1), (2, 2), *([(1, 7), (5, 1)] if faults else [])], "conversation_id long, local_id long")
    a, people = attachments(s, d) if faults else sent_attachments(s, d), m.where("sender_id is not null").select("conversation_id", F.col("sender_id").alias("participant_id")).distinct()
    order_attachments, order_files = attachments(s, d, ORDER), media_files(s, d, ORDER)
    cohort = materialize(sequence.cohort_groups(order_attachments, order_files, LOCAL).select("message_date", "direction", "asset_id", "last_asset_id"), "cohort")
    cohort = cohort.withColumn("last_asset_id", F.col("last_asset_id") + F.when(at("asset_id % 5 = 0"), 1).otherwise(0)).withColumn("direction", F.when(at("asset_id % 7 = 0"), F.when(F.col("direction") == "Outgoing", "Incoming").otherwise("Outgoing")).otherwise(F.col("direction")))
    linked = message_attachments(s, d)
    rows = materialize(scope.token_rows(f.drop("sha256"), device_groups(s)), "tokens")
    declared = f.groupBy("source_id").agg(F.count("*").alias("files")).join(rows.groupBy("source_id").agg(F.count("*").alias("tokens")), "source_id").withColumn("tokens", F.col("tokens") + F.when(at("source_id = 2"), 1).otherwise(0)).where(~at("source_id = 3"))
    parsed = materialize(_parsed(s, d).select("doc", "sequence_number", "message_type", "sender"), "parsed").select("doc", "sequence_number", F.when(at("doc % 11 = 0"), "System").otherwise(F.col("message_type")).alias("message_type"), "sender")
    requests = parsed.select("doc").distinct().select("doc", F.lit("Export").alias("source_type"), F.lit("me").alias("display_name"), F.when(at("doc % 7 = 0"), "a/chat.txt").otherwise("chat.txt").alias("file_name"), F.when(at("doc % 5 = 0"), " ").otherwise("Chat").alias("title"), F.lit("UTC").alias("time_zone"))
    roots = s.createDataFrame([(1, "/a/b"), (2, "/a" if faults else "/e"), (3, "/c/"), (4, "/c\\d" if faults else "/cd")] + ([(5, "/z")] if faults else []), "source_id long, root string")
    keyed = m.union(m.where(at("message_id % 17 = 0")))
    tables = {"message": keyed, "attachment": linked.withColumn("ordinal", F.when(at("message_id % 23 = 0"), 0).otherwise(F.col("ordinal"))), "kept": m.where(~at("message_id % 19 = 0"))}
    constraints = guards.constraint_guards(tables, {"message": [["message_id"]]}, [("attachment", "message_id", "kept", "message_id")], {"attachment": {"ordinal below 1": "ordinal >= 1"}})
    return guards.together(
        guards.media_guards(f, links, assets), guards.date_guards(dated, device_groups(s)), guards.ill_formed(written, "day", guards.DATE_FORMAT, "file_id", "file_date_ill_formed"), guards.ill_formed(m, "message_time", guards.TIME_FORMAT, "message_id", "message_time_ill_formed"),
        guards.conversation_guards(asked, m, people), guards.group_guards(f, groups), guards.reconciliation_guards(f, rows, scope.token_locality(rows)), guards.monotone_guards(rows),
        guards.cohort_guards(order_attachments.union(order_attachments.where(at("attachment_id % 13 = 0"))), cohort, order_files), guards.gate_guards(a, f, rows, declared), guards.import_guards(requests, parsed), guards.root_guards(roots, f), constraints,
    )


QUERIES["guard_counts"] = lambda s, d: guards.counts(_guards(s, d, True))
QUERIES["guard_counts_on_sound_views"] = lambda s, d: guards.counts(_guards(s, d, False))
ORACLE_SQL["guard_counts_on_sound_views"] = "SELECT 'none' AS guard, count(*) AS violations FROM events WHERE false GROUP BY 1"
_FAULTS = {
    "unhashed_file": "FROM files WHERE file_id % 101 = 0",
    "hashed_file_without_asset": "FROM (SELECT * FROM files LEFT JOIN lk USING (file_id)) WHERE file_id % 101 <> 0 AND (linked_to IS NULL OR linked_to NOT IN (SELECT asset_id FROM kept_assets))",
    "hash_differs_from_asset": "FROM files JOIN lk USING (file_id) JOIN kept_assets k ON k.asset_id = linked_to WHERE file_id % 101 <> 0 AND (file_id % 103 = 0 OR files.asset_id <> linked_to)",
    "several_assets_of_a_file": "FROM files WHERE file_id % 131 = 0 AND file_id % 127 <> 0",
    "dated_file_without_marker": "FROM files WHERE file_date IS NOT NULL AND file_id % 109 <> 0 AND file_id % 113 = 0",
    "marker_differs_from_date": "FROM files WHERE file_date IS NOT NULL AND file_id % 109 <> 0 AND file_id % 113 <> 0 AND file_id % 107 = 0",
    "undated_file_with_marker": "FROM files WHERE file_date IS NOT NULL AND file_id % 109 = 0 AND file_id % 113 <> 0",
    "file_date_ill_formed": "FROM files WHERE file_id % 139 = 0 OR file_id % 149 = 0",
    "no_such_conversation": "FROM (VALUES (5)) v(c) WHERE c NOT IN (SELECT conversation_id FROM messages)",
    "local_participant_of_another_conversation": "FROM (VALUES (1, 1), (2, 2), (1, 7), (5, 1)) v(c, p) WHERE NOT EXISTS (SELECT 1 FROM messages WHERE conversation_id = c AND sender_id = p)",
    "source_mapped_twice": "FROM (SELECT 1)",
    "source_not_mapped": "FROM (SELECT DISTINCT source_id FROM files WHERE source_id NOT IN (1, 2, 3))",
    "unknown_source_mapped": "FROM (VALUES (1), (2), (3), (9)) v(s) WHERE s NOT IN (SELECT source_id FROM files)",
    "attachment_without_sender": "FROM attachments WHERE sender_id IS NULL",
    "declared_counts_differ": "FROM (SELECT DISTINCT source_id FROM files WHERE source_id IN (2, 3))",
    "blank_field": "FROM (SELECT DISTINCT doc FROM parsed) WHERE doc % 5 = 0",
    "file_name_with_folder": "FROM (SELECT DISTINCT doc FROM parsed) WHERE doc % 7 = 0",
    "sender_against_type": "FROM parsed WHERE doc % 11 = 0",
    "roots_overlap": "FROM (SELECT unnest([1, 2, 3, 4]))",
    "source_without_files": "FROM (VALUES (1), (2), (3), (4), (5)) v(s) WHERE s NOT IN (SELECT source_id FROM files)",
    "message: message_id repeated": "FROM messages WHERE message_id % 17 = 0",
    "attachment: no such message_id": "FROM linked WHERE message_id % 19 = 0",
    "attachment: ordinal below 1": "FROM linked WHERE message_id % 23 = 0",
}
_ORDER_FAULTS = {
    "sequence_number_repeated": "FROM attachments WHERE attachment_id % 13 = 0",
    "several_assets_of_a_group": "FROM cohort WHERE asset_id % 5 = 0",
    "asset_of_both_directions": "FROM (SELECT message_date, asset_id FROM cohort GROUP BY 1, 2 HAVING count(*) > 1)",
    "copy_of_the_other_direction": "FROM cohort WHERE asset_id % 7 = 0",
}
_union = lambda faults: " UNION ALL ".join(f"SELECT '{k}' AS guard, count(*) AS violations {v}" for k, v in faults.items())
ORACLE_SQL["guard_counts"] = (
    "SELECT * FROM (" + oracle(f", {MESSAGE_SQL}, {_IMPORT}, lk AS (SELECT file_id, asset_id AS linked_to FROM files WHERE file_id % 127 <> 0 UNION ALL SELECT file_id, asset_id + 1 FROM files WHERE file_id % 127 <> 0 AND file_id % 131 = 0), kept_assets AS (SELECT DISTINCT asset_id FROM files WHERE asset_id % 137 <> 0) " + _union(_FAULTS)) + " UNION ALL (" + oracle(_COHORT + " " + _union(_ORDER_FAULTS), ORDER) + ")) WHERE violations > 0"
)

QUERIES |= archive_queries.QUERIES
ORACLE_SQL |= archive_queries.ORACLE_SQL
