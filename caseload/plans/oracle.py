"""DuckDB statements equivalent to each registered query (the correctness oracle).

Written independently of the Spark operators as plain SQL over the driver's
views. A shared prefix builds the survey stand-in tables (FIXTURES.md §2),
the per-family child aggregates, the case table and the scored table; each
statement appends its own final SELECT. Rule values come from
``caseload.schema`` so both sides use the same fixed tables.
"""

from __future__ import annotations

from caseload import schema as S


def q(v) -> str:
    """SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def _case_mod(expr: str, mapping, default) -> str:
    parts = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in mapping)
    return f"CASE {expr} {parts} ELSE {q(default)} END"


_DISP = S.DISPLACED_TYPES

BASE = f"""
WITH
main_t AS (
  SELECT CAST(c.c_custkey AS BIGINT) AS id, r.r_name AS gov, n.n_name AS dist,
         CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE n.n_name || '-' || CAST(c.c_custkey % 4 AS VARCHAR) END AS sub,
         CASE c.c_mktsegment WHEN 'BUILDING' THEN {q(_DISP[0])} WHEN 'MACHINERY' THEN {q(_DISP[1])}
              WHEN 'FURNITURE' THEN {q(_DISP[2])} ELSE {q(S.HOST_COMMUNITY)} END AS disp,
         {_case_mod("c.c_custkey % 5", [(0, S.HOUSING_OWN), (1, S.HOUSING_RENTING), (2, S.HOUSING_HOSTED), (3, S.HOUSING_HOMELESS)], S.HOUSING_OTHER)} AS hs,
         CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(c.c_custkey % 9 AS DOUBLE) END AS size,
         CAST(c.c_custkey % 6 AS DOUBLE) AS dep,
         CAST(c.c_custkey % 4 AS DOUBLE) AS bw,
         c.c_name AS submitted_by,
         'balance ' || CAST(c.c_acctbal AS VARCHAR) AS notes
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
),
members_t AS (
  SELECT CAST(o_custkey AS BIGINT) AS fid, CAST(o_orderkey AS BIGINT) AS k,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN {q(S.YES)} ELSE {q(S.NO)} END AS hoh,
         CASE WHEN o_orderkey % 3 = 0 THEN {q(S.FEMALE)} ELSE {q(S.MALE)} END AS g,
         CASE o_orderpriority WHEN '1-URGENT' THEN {q(S.WIDOW_MARITAL[0])} WHEN '2-HIGH' THEN {q(S.WIDOW_MARITAL[1])}
              WHEN '3-MEDIUM' THEN {q(S.MARRIED)} ELSE {q(S.SINGLE)} END AS ms,
         CASE WHEN o_orderkey % 13 = 0 THEN {q(S.ORPHAN_STATUS[0])} WHEN o_orderkey % 17 = 0 THEN {q(S.ORPHAN_STATUS[1])}
              ELSE {q(S.PRESENT)} END AS st,
         CASE WHEN o_orderkey % 101 = 0 THEN 1.0 ELSE 0.0 END AS vf,
         CASE WHEN o_orderkey % 97 = 0 THEN 1.0 ELSE 0.0 END AS vi,
         CASE WHEN o_orderkey % 53 = 0 THEN 1.0 ELSE 0.0 END AS vc,
         CASE WHEN o_orderkey % 83 = 0 THEN 1.0 ELSE 0.0 END AS vd,
         CASE WHEN o_orderkey % 2 = 1 THEN NULL WHEN o_orderkey % 62 = 0 THEN 1.0 ELSE 0.0 END AS vp,
         CASE WHEN o_orderkey % 29 = 0 THEN 1.0 ELSE 0.0 END AS vo,
         CASE o_orderkey % 12 WHEN 1 THEN '' WHEN 2 THEN 'لا يعمل' WHEN 3 THEN 'ربة منزل' WHEN 4 THEN 'طالب جامعي'
              WHEN 5 THEN 'مزارع' WHEN 6 THEN 'فلاح' WHEN 7 THEN 'موظف' WHEN 8 THEN 'عامل' WHEN 9 THEN 'متقاعد'
              WHEN 10 THEN 'طفل' WHEN 11 THEN 'Driver' ELSE NULL END AS occ_text,
         CASE o_orderkey % 6 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y')
              WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 4 THEN 'born ' || strftime(o_orderdate, '%Y')
              WHEN 5 THEN 'unknown' ELSE NULL END AS dob_text
  FROM orders
),
needs_t AS (
  SELECT CAST(o.o_custkey AS BIGINT) AS fid,
         CASE (o.o_custkey * 7 + l.l_partkey % 4) % 16 WHEN 0 THEN {q(S.PROGRAM_FINANCIAL)} WHEN 1 THEN {q(S.PROGRAM_MEDICAL)}
              WHEN 2 THEN {q(S.PROGRAM_LEGAL)} WHEN 3 THEN {q(S.PROGRAM_EDUCATION)} WHEN 15 THEN NULL
              ELSE {q(S.PROGRAM_FOOD)} END AS p,
         CASE WHEN o.o_custkey % 9 <> 0 THEN {q(S.NEED_BLANKETS)} WHEN l.l_suppkey % 3 = 0 THEN {q(S.BABY_NEEDS[0])}
              WHEN l.l_suppkey % 3 = 1 THEN {q(S.BABY_NEEDS[1])} ELSE {q(S.NEED_BLANKETS)} END AS c,
         CASE WHEN l.l_linestatus = 'F' AND o.o_custkey % 3 = 0 THEN {q(S.YES)} ELSE {q(S.NO)} END AS s
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE NOT COALESCE(l.l_returnflag IN ('A', 'R') AND o.o_custkey % 5 = 0 OR o.o_custkey % 13 = 0, FALSE)
),
damage_t AS (
  SELECT CAST(o.o_custkey AS BIGINT) AS fid,
         {_case_mod("(o.o_custkey + l.l_partkey % 2) % 3", [(0, S.DAMAGE_CATEGORIES[0]), (1, S.DAMAGE_CATEGORIES[1])], S.DAMAGE_CATEGORIES[2])} AS category
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_returnflag IN ('A', 'R') AND o.o_custkey % 5 = 0 OR o.o_custkey % 13 = 0
),
mem_agg AS (
  SELECT fid AS family_id,
    bool_or(COALESCE(hoh = {q(S.YES)} AND g = {q(S.FEMALE)} AND ms IN {_in(S.WIDOW_MARITAL)}, FALSE)
            OR COALESCE(vf = 1.0, FALSE)) AS m_widow,
    bool_or(COALESCE(hoh = {q(S.YES)} AND st IN {_in(S.ORPHAN_STATUS)}, FALSE)) AS m_orphan,
    bool_or(COALESCE(vi = 1.0, FALSE) OR COALESCE(vc = 1.0, FALSE)) AS m_medical,
    bool_or(greatest(COALESCE(vd, 0.0), COALESCE(vp, 0.0)) = 1.0) AS m_disability,
    NULLIF(CAST(count_if(COALESCE(vc = 1.0, FALSE)) AS BIGINT), 0) AS chronic_disease_members,
    NULLIF(CAST(count_if(greatest(COALESCE(vd, 0.0), COALESCE(vp, 0.0)) = 1.0) AS BIGINT), 0) AS disability_members,
    NULLIF(CAST(count_if(COALESCE(vo = 1.0, FALSE)) AS BIGINT), 0) AS school_dropout_children,
    CAST(count(*) AS BIGINT) AS member_count
  FROM members_t WHERE fid IS NOT NULL GROUP BY fid
),
prog AS (
  SELECT fid AS family_id, p AS program, count(*) AS n,
         bool_or(COALESCE(c IN {_in(S.BABY_NEEDS)}, FALSE)) AS baby,
         bool_or(COALESCE(s = {q(S.YES)}, FALSE)) AS served
  FROM needs_t WHERE fid IS NOT NULL GROUP BY fid, p
),
prog_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY program IS NULL, n DESC, program ASC) AS rk FROM prog
),
need_agg AS (
  SELECT family_id,
    bool_or(COALESCE(program = {q(S.PROGRAM_FINANCIAL)}, FALSE)) AS n_financial,
    bool_or(COALESCE(program = {q(S.PROGRAM_MEDICAL)}, FALSE)) AS n_medical,
    bool_or(baby) AS n_baby,
    bool_or(served) AS n_served,
    COALESCE(string_agg(CASE WHEN program IS NOT NULL AND rk <= 2 THEN program END, ', ' ORDER BY rk), '') AS need_type,
    COALESCE(list_sort(list(program) FILTER (WHERE program IS NOT NULL)), CAST([] AS VARCHAR[])) AS needs_programs
  FROM prog_ranked GROUP BY family_id
),
dmg_agg AS (
  SELECT fid AS family_id, TRUE AS d_any,
    COALESCE(list_sort(list(DISTINCT category) FILTER (WHERE category IS NOT NULL)), CAST([] AS VARCHAR[])) AS damage_categories
  FROM damage_t WHERE fid IS NOT NULL GROUP BY fid
),
cases AS (
  SELECT m.id AS family_id, m.size AS family_size, m.dep AS dependents, m.bw AS breadwinners,
    CAST(NULL AS DATE) AS survey_date,
    COALESCE(m.sub, m.dist, m.gov) AS city, m.gov AS governorate, m.disp AS displacement_type, m.hs AS housing_type,
    COALESCE(a.m_widow, FALSE) AS is_widow,
    COALESCE(a.m_orphan, FALSE) AS is_orphan_family,
    COALESCE(m.disp IN {_in(S.DISPLACED_TYPES)}, FALSE) AS is_displaced,
    COALESCE(m.hs = {q(S.HOUSING_HOMELESS)}, FALSE) AS is_homeless,
    COALESCE(m.hs = {q(S.HOUSING_RENTING)}, FALSE) AS is_renting,
    COALESCE(m.bw = 0, FALSE) OR COALESCE(b.n_financial, FALSE) AS is_unemployed,
    COALESCE(a.m_medical, FALSE) OR COALESCE(b.n_medical, FALSE) AS has_medical,
    COALESCE(a.m_disability, FALSE) AS has_disability,
    COALESCE(b.n_baby, FALSE) AS is_pregnant,
    COALESCE(d.d_any, FALSE) AS has_damage,
    COALESCE(b.n_served, FALSE) AS service_received,
    a.chronic_disease_members, a.disability_members, a.school_dropout_children, a.member_count,
    COALESCE(b.need_type, '') AS need_type, b.needs_programs, d.damage_categories,
    {q(S.SOURCE_FILE)} AS source_file, {q(S.SOURCE_SHEET)} AS source_sheet
  FROM main_t m
  LEFT JOIN mem_agg a ON a.family_id = m.id
  LEFT JOIN need_agg b ON b.family_id = m.id
  LEFT JOIN dmg_agg d ON d.family_id = m.id
),
scored0 AS (
  SELECT *, CAST(
      {" + ".join(f"(CASE WHEN {sig} THEN {w} ELSE 0 END)" for sig, w in S.WEIGHTS)}
      + (CASE WHEN family_size >= 7 THEN 15 WHEN family_size >= 5 THEN 10 WHEN family_size >= 3 THEN 5 ELSE 0 END)
    AS BIGINT) AS priority_score
  FROM cases
),
scored AS (
  SELECT *,
    CASE WHEN priority_score >= 80 THEN 'CRITICAL' WHEN priority_score >= 50 THEN 'HIGH'
         WHEN priority_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS priority_tier,
    CAST(row_number() OVER (ORDER BY family_id NULLS LAST) AS BIGINT) AS family_num
  FROM scored0
)
"""


def _check(col: str) -> str:
    return f"CASE WHEN {col} THEN '✓' ELSE '' END AS {col}"


DISPLAY = ", ".join(
    _check(c) if c in dict(S.SIGNAL_LABELS) else c for c in S.DISPLAY_COLS
)

SIGNALS = ", ".join(S.SIGNALS)


# --- rule tables as SQL ----------------------------------------------------------

def _need_items():
    items: dict[str, tuple] = {}
    for sig, item, cat, urg in S.NEED_RULES:
        items.setdefault(item, (cat, urg, []))[2].append(sig)
    return [(item, cat, urg, sigs) for item, (cat, urg, sigs) in items.items()]


def _need_pred(sigs) -> str:
    if any(s is None for s in sigs):
        return "TRUE"
    return "(" + " OR ".join(sigs) + ")"


_RANK = dict(S.URGENCY_RANK)


def needs_sql(source: str = "scored", where: str = "TRUE") -> str:
    """Aggregate needs rows (A8) over ``source`` filtered by ``where``; a FROM-able subquery."""
    counts = ", ".join(f"CAST(count_if({_need_pred(sigs)}) AS BIGINT) AS c{i}"
                       for i, (_, _, _, sigs) in enumerate(_need_items()))
    agg = f"(SELECT CAST(count(*) AS BIGINT) AS n, {counts} FROM {source} WHERE {where})"
    rows = " UNION ALL ".join(
        f"SELECT {q(item)} AS need_item, {q(cat)} AS category, {q(urg)} AS urgency, c{i} AS families_count, "
        f"round(CAST(c{i} AS DOUBLE) / CAST(greatest(n, 1) AS DOUBLE) * 100.0, 1) AS pct_of_total, "
        f"{_RANK[urg]} AS urgency_rank FROM agg"
        for i, (item, cat, urg, _) in enumerate(_need_items()))
    return f"(WITH agg AS {agg} SELECT * FROM ({rows}) WHERE families_count > 0)"


def _size_clip(col: str = "family_size") -> str:
    return f"greatest(COALESCE({col}, 4.0), 1.0)"


def _size_int(col: str = "family_size") -> str:
    return f"CAST(trunc({_size_clip(col)}) AS BIGINT)"


def medical_sql(source: str = "scored", where: str = "TRUE") -> str:
    sigs = list(dict.fromkeys(s for s, _, _, _ in S.MEDICAL_RULES))
    counts = ", ".join(f"CAST(count_if({s}) AS BIGINT) AS {s}" for s in sigs)
    rows = " UNION ALL ".join(
        f"SELECT {pos} AS item_pos, {q(item)} AS item, {q(unit)} AS unit, {sig} AS families, "
        f"CAST({sig} * {qty} AS BIGINT) AS total_qty FROM agg"
        for pos, (sig, item, qty, unit) in enumerate(S.MEDICAL_RULES))
    return f"(WITH agg AS (SELECT {counts} FROM {source} WHERE {where}) SELECT * FROM ({rows}) WHERE families > 0)"


def _cost_exprs() -> list[tuple[str, str, str]]:
    rate = dict(S.FINANCIAL_RATES)
    out = []
    for label, col_name, rate_name, sig in S.COST_LINES:
        if sig is None and "person" in rate_name:
            expr = f"{_size_int()} * {rate[rate_name]}"
        elif sig is None:
            expr = f"{rate[rate_name]}"
        else:
            expr = f"CASE WHEN {sig} THEN {rate[rate_name]} ELSE 0 END"
        out.append((label, col_name, f"CAST({expr} AS BIGINT)"))
    return out


def financial_sql(source: str = "scored", where: str = "TRUE") -> str:
    costs = _cost_exprs()
    sums = ", ".join(f"CAST(COALESCE(sum({expr}), 0) AS BIGINT) AS {name}" for _, name, expr in costs)
    lines = [(label, name) for label, name, _ in costs] + [(S.GRAND_TOTAL, " + ".join(n for _, n, _ in costs))]
    rows = " UNION ALL ".join(
        f"SELECT {pos} AS line_pos, {q(label)} AS category, CAST({expr} AS BIGINT) AS total_usd FROM agg"
        for pos, (label, expr) in enumerate(lines))
    return f"(WITH agg AS (SELECT {sums} FROM {source} WHERE {where}) {rows})"


def _summary_sql() -> str:
    items = ", ".join(f"CAST(count_if({_need_pred(sigs)}) AS BIGINT) AS need_{i}"
                      for i, (_, _, _, sigs) in enumerate(_need_items()))
    meds = ", ".join(f"CAST(count_if({s}) AS BIGINT) AS med_{s}"
                     for s in dict.fromkeys(s for s, _, _, _ in S.MEDICAL_RULES))
    costs = ", ".join(f"CAST(COALESCE(sum({expr}), 0) AS BIGINT) AS sum_{name}" for _, name, expr in _cost_exprs())
    return (f"SELECT CAST(count(*) AS BIGINT) AS families, {items}, {meds}, "
            f"COALESCE(sum({_size_clip()} / 4.0), 0.0) AS ration_scale, "
            f"CAST(COALESCE(sum(ceil({_size_int()} / 4)), 0) AS BIGINT) AS ration_packs, "
            f"CAST(COALESCE(sum({_size_int()}), 0) AS BIGINT) AS ration_people, {costs} FROM scored")


def _report_sql(source: str = "scored") -> str:
    """The long needs report: the four section statements mapped onto one column layout."""
    cast = "CAST(NULL AS VARCHAR)"
    basket = " UNION ALL ".join(
        f"SELECT 'rations' AS section, {pos} AS pos, {q(item)} AS item, {cast} AS category, {cast} AS urgency, "
        f"{q(unit)} AS unit, CAST(NULL AS BIGINT) AS families, round(CAST({float(qty)!r} AS DOUBLE) * scale, 1) AS amount, "
        f"CAST(NULL AS DOUBLE) AS share FROM agg"
        for pos, (item, qty, unit) in enumerate(S.RATION_BASKET))
    return (
        f", agg AS (SELECT COALESCE(sum({_size_clip()} / 4.0), 0.0) AS scale FROM {source}) "
        f"SELECT 'needs' AS section, urgency_rank AS pos, need_item AS item, category, urgency, {cast} AS unit, "
        f"families_count AS families, CAST(NULL AS DOUBLE) AS amount, pct_of_total AS share FROM {needs_sql(source)} "
        f"UNION ALL {basket} "
        f"UNION ALL SELECT 'medical', item_pos, item, {cast}, {cast}, unit, families, CAST(total_qty AS DOUBLE), "
        f"CAST(NULL AS DOUBLE) FROM {medical_sql(source)} "
        f"UNION ALL SELECT 'budget', line_pos, category, {cast}, {cast}, 'USD', CAST(NULL AS BIGINT), "
        f"CAST(total_usd AS DOUBLE), CAST(NULL AS DOUBLE) FROM {financial_sql(source)}")


def _rate_sql() -> str:
    rate = dict(S.FINANCIAL_RATES)
    rows = []
    for pos, (_, _, rate_name, sig) in enumerate(S.COST_LINES):
        per_person = "person" in rate_name
        units = (f"sum({_size_int()})" if per_person else "count(*)" if sig is None else f"count_if({sig})")
        applied = "per person" if per_person else "per qualifying family"
        rows.append(f"SELECT {pos} AS rate_pos, {q(rate_name)} AS category, CAST({rate[rate_name]} AS BIGINT) AS rate_usd, "
                    f"{q(applied)} AS applied_to, CAST(COALESCE({units}, 0) AS BIGINT) AS units, "
                    f"CAST(COALESCE({units}, 0) * {rate[rate_name]} AS BIGINT) AS total_usd FROM scored")
    return " UNION ALL ".join(rows)


def _ration_totals_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {pos} AS item_pos, {q(item)} AS item, {q(unit)} AS unit, CAST({float(qty)!r} AS DOUBLE) AS qty_per_basket, "
        f"round(CAST({float(qty)!r} AS DOUBLE) * scale, 1) AS total_needed FROM agg"
        for pos, (item, qty, unit) in enumerate(S.RATION_BASKET))
    return f", agg AS (SELECT COALESCE(sum({_size_clip()} / 4.0), 0.0) AS scale FROM scored) {rows}"


def _tier_spine(value_sql: str, name: str) -> str:
    spine = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(S.TIER_ORDER))
    return (f"SELECT sp.tier_pos, sp.priority_tier, {value_sql} AS {name} "
            f"FROM (VALUES {spine}) sp(tier_pos, priority_tier) LEFT JOIN scored s ON s.priority_tier = sp.priority_tier "
            f"GROUP BY sp.tier_pos, sp.priority_tier")


def _signal_totals_sql(source: str = "scored") -> str:
    return " UNION ALL ".join(
        f"SELECT {q(lbl)} AS signal, {q(c)} AS column, CAST(count_if({c}) AS BIGINT) AS families FROM {source}"
        for c, lbl in S.SIGNAL_LABELS)


def _urgency_sql() -> str:
    spine = ", ".join(f"({i}, {q(u)})" for i, u in enumerate(S.URGENCY_ORDER))
    return (f"SELECT sp.urgency_pos, sp.urgency, CAST(COALESCE(sum(nd.families_count), 0) AS BIGINT) AS families "
            f"FROM (VALUES {spine}) sp(urgency_pos, urgency) LEFT JOIN {needs_sql()} nd ON nd.urgency = sp.urgency "
            f"GROUP BY sp.urgency_pos, sp.urgency")


def _category_sql() -> str:
    icons = " ".join(f"WHEN {q(c)} THEN {q(i)}" for c, i in S.CATEGORY_ICON)
    return (f"SELECT category, CAST(sum(families_count) AS BIGINT) AS families_count, "
            f"CASE category {icons} ELSE {q(S.DEFAULT_ICON)} END AS icon, "
            f"upper(substr(category, 1, 1)) || lower(substr(category, 2)) AS label "
            f"FROM {needs_sql()} GROUP BY category")


def _stats_sql() -> str:
    return (
        ", top AS (SELECT city, count(*) AS n FROM scored WHERE city IS NOT NULL GROUP BY city "
        "ORDER BY n DESC, city LIMIT 5) "
        "SELECT CAST(count(*) AS BIGINT) AS total_families, "
        "CAST(trunc(COALESCE(sum(family_size), 0.0)) AS BIGINT) AS total_individuals, "
        "CAST(count_if(priority_tier = 'CRITICAL') AS BIGINT) AS critical, "
        "CAST(count_if(priority_tier = 'HIGH') AS BIGINT) AS high_priority, "
        "CAST(count_if(is_widow) AS BIGINT) AS widows, CAST(count_if(is_orphan_family) AS BIGINT) AS orphan_families, "
        "CAST(count_if(is_displaced) AS BIGINT) AS displaced, CAST(count_if(has_medical) AS BIGINT) AS with_medical_needs, "
        "CAST(count_if(is_homeless) AS BIGINT) AS homeless, CAST(count_if(is_unemployed) AS BIGINT) AS unemployed, "
        "(SELECT COALESCE(string_agg(city || ':' || CAST(n AS VARCHAR), '|' ORDER BY n DESC, city), '') FROM top) AS top_cities "
        "FROM scored")


def _stats_json_sql() -> str:
    fields = [("total_families", "count(*)"), ("total_individuals", "trunc(COALESCE(sum(family_size), 0.0))"),
              ("critical", "count_if(priority_tier = 'CRITICAL')"), ("high_priority", "count_if(priority_tier = 'HIGH')"),
              ("widows", "count_if(is_widow)"), ("orphan_families", "count_if(is_orphan_family)"),
              ("displaced", "count_if(is_displaced)"), ("with_medical_needs", "count_if(has_medical)"),
              ("homeless", "count_if(is_homeless)"), ("unemployed", "count_if(is_unemployed)")]
    body = " || ',' || ".join(f"'\"{k}\":' || CAST(CAST({v} AS BIGINT) AS VARCHAR)" for k, v in fields)
    cities = ("(SELECT COALESCE(string_agg('\"' || city || '\":' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, city), '') "
              "FROM top)")
    return (", top AS (SELECT city, count(*) AS n FROM scored WHERE city IS NOT NULL GROUP BY city "
            "ORDER BY n DESC, city LIMIT 5) "
            f"SELECT '{{' || {body} || ',\"top_cities\":{{' || {cities} || '}}}}' AS stats_json FROM scored")


# columns of the ``scored`` CTE above, in order
SCORED_COLUMNS = (
    "family_id", "family_size", "dependents", "breadwinners", "survey_date", "city", "governorate",
    "displacement_type", "housing_type", "is_widow", "is_orphan_family", "is_displaced", "is_homeless", "is_renting",
    "is_unemployed", "has_medical", "has_disability", "is_pregnant", "has_damage", "service_received",
    "chronic_disease_members", "disability_members", "school_dropout_children", "member_count", "need_type",
    "needs_programs", "damage_categories", "source_file", "source_sheet", "priority_score", "priority_tier",
    "family_num",
)
TEXT_COLUMNS = ("city", "governorate", "displacement_type", "housing_type", "need_type", "needs_programs", "damage_categories",
                "source_file", "source_sheet", "priority_tier")
# DuckDB type names → Spark's simple type strings
SPARK_TYPE = (("BIGINT", "bigint"), ("INTEGER", "int"), ("DOUBLE", "double"), ("VARCHAR", "string"),
              ("BOOLEAN", "boolean"), ("DATE", "date"), ("VARCHAR[]", "array<string>"))


def _column_profile_sql(columns=SCORED_COLUMNS) -> str:
    mapping = " ".join(f"WHEN {q(d)} THEN {q(sp)}" for d, sp in SPARK_TYPE)
    rows = " UNION ALL ".join(
        f"SELECT {i} AS column_pos, {q(c)} AS column, CASE max(typeof({c})) {mapping} END AS dtype, "
        f"CAST(min({c}) AS VARCHAR) AS example FROM scored"
        for i, c in enumerate(columns))
    return rows


def _profile_sql(pick: str = "ORDER BY priority_score DESC, family_num LIMIT 1") -> str:
    fields = ["family_size", "dependents", "breadwinners", "survey_date", "governorate", "displacement_type",
              "housing_type", "has_damage", "service_received", "chronic_disease_members", "disability_members",
              "school_dropout_children", "member_count", "need_type"]
    rows = " UNION ALL ".join(f"SELECT family_num, {q(f)} AS field, CAST({f} AS VARCHAR) AS value FROM pick"
                              for f in fields)
    return (f", pick AS (SELECT * FROM scored {pick}) "
            f"SELECT * FROM ({rows}) WHERE value IS NOT NULL AND trim(value) <> '' AND value <> 'nan'")


def _bucket_sql(col: str) -> str:
    parts = []
    for bucket, words in S.OCCUPATION_BUCKETS:
        cond = " OR ".join(f"contains(lower({col}), {q(w.lower())})" for w in words)
        parts.append(f"WHEN {cond} THEN {q(bucket)}")
    return (f"CASE WHEN {col} IS NULL OR trim({col}) = '' THEN {q(S.UNKNOWN_BUCKET)} "
            + " ".join(parts) + f" ELSE {q(S.OTHER_BUCKET)} END")


def _birth_year_sql(col: str) -> str:
    fmts = ["%Y-%m-%d", "%Y", "%m/%d/%Y", "%d/%m/%Y"]
    parsed = ", ".join(f"year(try_strptime(trim({col}), {q(f)}))" for f in fmts)
    rx = f"NULLIF(regexp_extract(trim({col}), {q(S.BIRTH_YEAR_PATTERN)}, 1), '')"
    return (f"CASE WHEN {col} IS NULL OR trim({col}) = '' THEN NULL "
            f"ELSE CAST(COALESCE({parsed}, CAST({rx} AS INTEGER)) AS INTEGER) END")


INTAKE_T = """intake_t AS (
  SELECT CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 1 THEN event_id - 1 ELSE event_id END AS intake_id,
         CASE event_id % 17
              WHEN 0 THEN 'note {broken'
              WHEN 1 THEN record || ']}'
              WHEN 2 THEN record || '] x [' || record
              WHEN 3 THEN record || ', ' || record
              WHEN 4 THEN chr(10) || chr(9) || record || chr(10)
              WHEN 5 THEN '{"family_size": 4, "city": "م", "extra": {"a": [1, {}]}}'
              ELSE 'note: ' || record || ' end'
         END AS response
  FROM (SELECT event_id, '{"family_size": "' || CAST(event_id % 10 AS VARCHAR) || '", "city": "C' ||
               CAST(user_id % 8 AS VARCHAR) || '", "breadwinners": "' || CAST(event_id % 3 AS VARCHAR) || '"}' AS record
        FROM events)
)"""


def _intake_parsed() -> str:
    def num(f):
        return f"CAST(trunc(TRY_CAST(json_extract_string(span, '$.{f}') AS DOUBLE)) AS BIGINT)"

    fields = []
    for f in S.INTAKE_FIELDS:
        expr = num(f) if f in S.INTAKE_NUMERIC else f"json_extract_string(span, '$.{f}')"
        fields.append(f"CASE WHEN ok THEN {expr} END AS {f}")
    return (f", {INTAKE_T},\n"
            "intake_span AS (SELECT intake_id, response, regexp_extract(response, '(?s)\\{.*\\}', 0) AS span FROM intake_t),\n"
            "intake_ok AS (SELECT *, CASE WHEN span <> '' AND json_valid(span) THEN json_type(span) = 'OBJECT' ELSE FALSE END AS ok "
            "FROM intake_span),\n"
            f"intake_read AS (SELECT intake_id, response, ok AS parse_ok, {', '.join(fields)} FROM intake_ok),\n"
            "intake_parsed AS (SELECT * EXCLUDE (response) FROM intake_read),\n"
            # of the good responses of an id the one with the smallest digest; all without id
            "intake_first AS (SELECT * FROM intake_read WHERE parse_ok QUALIFY intake_id IS NULL "
            "OR row_number() OVER (PARTITION BY intake_id ORDER BY sha256(response)) = 1)")


def _intake_scored(start: str) -> str:
    disp = "COALESCE(displacement_type, '')"
    housing = "COALESCE(housing_type, '')"
    payload = ", ".join(f"CAST({f} AS VARCHAR)" if f in S.INTAKE_NUMERIC else f for f in S.INTAKE_FIELDS)
    return (
        ",\nintake_rows AS (SELECT intake_id, "
        f"upper(md5(CASE WHEN intake_id IS NULL THEN concat_ws('␟', {payload}) ELSE 'id␟' || CAST(intake_id AS VARCHAR) END)) AS family_id, "
        f"{q(S.MANUAL_SOURCE_FILE)} AS source_file, "
        f"COALESCE(NULLIF(city, ''), {q(S.UNKNOWN_CITY)}) AS city, COALESCE(governorate, '') AS governorate, "
        f"{disp} AS displacement_type, {housing} AS housing_type, CAST(family_size AS DOUBLE) AS family_size, "
        "CAST(breadwinners AS DOUBLE) AS breadwinners, COALESCE(need_type, '') AS need_type, "
        f"{disp} IN {_in(S.DISPLACED_TYPES)} AS is_displaced, {housing} = {q(S.HOUSING_HOMELESS)} AS is_homeless, "
        f"{housing} = {q(S.HOUSING_RENTING)} AS is_renting, COALESCE(breadwinners = 0, FALSE) AS is_unemployed "
        "FROM intake_first),\n"
        "intake_scored AS (SELECT *, CAST((CASE WHEN is_homeless THEN 40 ELSE 0 END) + "
        "(CASE WHEN is_unemployed THEN 25 ELSE 0 END) + (CASE WHEN is_displaced THEN 20 ELSE 0 END) + "
        "(CASE WHEN is_renting THEN 10 ELSE 0 END) + (CASE WHEN family_size >= 7 THEN 15 WHEN family_size >= 5 "
        "THEN 10 WHEN family_size >= 3 THEN 5 ELSE 0 END) AS BIGINT) AS priority_score FROM intake_rows),\n"
        "intake_final AS (SELECT *, CASE WHEN priority_score >= 80 THEN 'CRITICAL' WHEN priority_score >= 50 "
        "THEN 'HIGH' WHEN priority_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS priority_tier, "
        f"CAST({start} + row_number() OVER (ORDER BY intake_id NULLS LAST, family_id) AS BIGINT) AS family_num FROM intake_scored)\n")


INTAKE_COLS = ("family_num, family_id, source_file, city, governorate, displacement_type, housing_type, family_size, "
               "breadwinners, need_type, is_displaced, is_homeless, is_renting, is_unemployed, priority_score, priority_tier")

NEED_ITEMS_T = """need_items_t AS (
  SELECT event_id AS response_id,
         CASE event_id % 13
              WHEN 0 THEN 'items: [broken'
              WHEN 1 THEN items || '] x [[' || items || ']'
              WHEN 2 THEN items || ', ' || items
              WHEN 3 THEN items || '}]'
              WHEN 4 THEN '[]'
              ELSE 'items: ' || items || ' done'
         END AS response
  FROM (SELECT event_id, '[{"item": "' || event_type || '", "category": "other", "urgency": "high"}, {"item": "v' ||
               CAST(user_id % 5 AS VARCHAR) || '", "category": "food", "urgency": "medium"}]' AS items
        FROM events)
)"""


def _after_intake() -> str:
    """Prefix with ``everyone``: the scored caseload and the intake records, with the columns that reports use."""
    false = {s for s in S.SIGNALS} - {"is_displaced", "is_homeless", "is_renting", "is_unemployed"}
    intake = ", ".join(f"FALSE AS {s}" if s in false else s for s in S.SIGNALS)
    rest = "family_size, city, priority_tier, priority_score"
    return (BASE + _intake_parsed() + _intake_scored("(SELECT max(family_num) FROM scored)")
            + f", everyone AS (SELECT {', '.join(S.SIGNALS)}, {rest} FROM scored UNION ALL SELECT {intake}, {rest} FROM intake_final)\n")


def _need_array_sql() -> str:
    return (
        f"WITH {NEED_ITEMS_T},\n"
        "spans AS (SELECT response_id, regexp_extract(response, '(?s)\\[.*\\]', 0) AS span FROM need_items_t),\n"
        "ok AS (SELECT * FROM spans WHERE CASE WHEN span <> '' AND json_valid(span) THEN json_type(span) = 'ARRAY' ELSE FALSE END)\n"
        "SELECT response_id, CAST(pos AS BIGINT) AS item_pos, "
        "json_extract_string(span, '$[' || CAST(pos AS VARCHAR) || '].item') AS item, "
        "json_extract_string(span, '$[' || CAST(pos AS VARCHAR) || '].category') AS category, "
        "json_extract_string(span, '$[' || CAST(pos AS VARCHAR) || '].urgency') AS urgency "
        "FROM ok, LATERAL (SELECT unnest(range(CAST(json_array_length(span) AS BIGINT))) AS pos)")


_ARABIC = "'٠١٢٣٤٥٦٧٨٩', '0123456789'"


def _date_forms_sql() -> str:
    """Date texts in many forms and their years, by one rule: the widths of the fields."""
    old = "(o_orderdate - INTERVAL 100 YEAR)"
    texts = ["strftime(o_orderdate, '%Y%m%d')", "strftime(o_orderdate, '%m/%d/%y')", f"strftime({old}, '%Y-%m-%d') || ' 00:00:00'",
             f"strftime({old}, '%-d/%-m/%Y')", "'  ' || strftime(o_orderdate, '%d.%m.%Y') || ' '",
             "translate(strftime(o_orderdate, '%Y/%-m/%-d'), '0123456789', '٠١٢٣٤٥٦٧٨٩')", "strftime(o_orderdate, '%Y-%d-%m')",
             "strftime(o_orderdate, '%Y-%m-%d') || 'T07:30:00Z'", "'about ' || strftime(o_orderdate, '%Y')", "'13/45/85'", "'19901399'",
             "strftime(o_orderdate, '%Y') || '-02-30'", "''", "'٢٠'", "strftime(o_orderdate, '%-d-%-m-%y')"]
    cases = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts))
    fields = r"'^(\d{1,4})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{1,4})([T ]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$'"

    def checked(year: str, a: str, b: str) -> str:
        dates = [f"TRY_CAST(lpad(CAST({year} AS VARCHAR), 4, '0') || '-' || {m} || '-' || {d} AS DATE)" for m, d in ((a, b), (b, a))]
        return f"CASE WHEN COALESCE({dates[0]}, {dates[1]}) IS NOT NULL THEN {year} END"

    return (f"WITH raw AS (SELECT CAST(o_orderkey AS BIGINT) AS member_key, CASE o_orderkey % {len(texts) + 1} {cases} END AS dob_text FROM orders), "
            f"t AS (SELECT *, translate(trim(dob_text), {_ARABIC}) AS x FROM raw), "
            f"f AS (SELECT *, regexp_extract(x, {fields}, 1) AS a, regexp_extract(x, {fields}, 2) AS b, regexp_extract(x, {fields}, 3) AS c FROM t), "
            "y AS (SELECT *, CASE WHEN TRY_CAST(c AS INTEGER) < 69 THEN 2000 ELSE 1900 END + TRY_CAST(c AS INTEGER) AS short FROM f) "
            "SELECT member_key, dob_text, CAST(CASE WHEN dob_text IS NULL OR x = '' THEN NULL ELSE COALESCE("
            f"CASE WHEN length(a) = 4 AND length(c) <= 2 THEN {checked('TRY_CAST(a AS INTEGER)', 'b', 'c')} "
            f"WHEN length(c) = 4 AND length(a) <= 2 THEN {checked('TRY_CAST(c AS INTEGER)', 'a', 'b')} "
            f"WHEN length(c) = 2 AND length(a) BETWEEN 1 AND 2 THEN {checked('short', 'a', 'b')} END, "
            "CASE WHEN length(x) = 8 AND regexp_full_match(x, '\\d{8}') THEN "
            f"{checked('TRY_CAST(x[1:4] AS INTEGER)', 'x[5:6]', 'x[7:8]')} END, "
            "CASE WHEN regexp_full_match(x, '\\d{4}') THEN TRY_CAST(x AS INTEGER) END, "
            f"TRY_CAST(NULLIF(regexp_extract(x, {q(S.BIRTH_YEAR_PATTERN)}, 1), '') AS INTEGER)) END AS INTEGER) AS birth_year FROM y")


def _occupation_sql() -> str:
    words = [w for _, keywords in S.OCCUPATION_BUCKETS for w in keywords]
    return (f"WITH w AS (SELECT *, ([{', '.join(q(x) for x in words)}])[o_orderkey % {len(words)} + 1] AS word FROM orders), "
            "t AS (SELECT CAST(o_orderkey AS BIGINT) AS member_key, CASE (o_orderkey // 32) % 8 WHEN 0 THEN word "
            "WHEN 1 THEN '  ' || word || chr(9) WHEN 2 THEN o_orderstatus || ' ' || upper(word) || ' منذ ٢٠١٥' "
            "WHEN 3 THEN 'كان ' || word || '، والآن ' || o_orderpriority WHEN 4 THEN ' ' || chr(9) || ' ' WHEN 5 THEN o_orderstatus "
            "WHEN 6 THEN '' END AS occupation_text FROM w), s AS (SELECT *, trim(occupation_text, ' ' || chr(9)) AS x FROM t) "
            f"SELECT member_key, occupation_text, {_bucket_sql('x')} AS occupation_bucket FROM s")


def _search_sql(pred: str) -> str:
    return BASE + f"SELECT {DISPLAY} FROM scored WHERE {pred}"


def statements() -> dict[str, str]:
    m = S.MainCols
    out = {
        "case_flags": BASE + f"SELECT family_id, city, governorate, displacement_type, housing_type, family_size, "
                             f"{SIGNALS} FROM cases",
        "member_counts": BASE + "SELECT family_id, chronic_disease_members, disability_members, "
                                "school_dropout_children, member_count FROM cases",
        "priority_scores": BASE + "SELECT family_id, priority_score, priority_tier FROM scored",
        "family_numbering": BASE + "SELECT family_id, family_num FROM scored",
        "priority_list": BASE + "SELECT family_num, family_id, priority_score, priority_tier, city, family_size "
                                "FROM scored",
        "top_critical": BASE + f"SELECT {DISPLAY} FROM scored WHERE priority_tier = 'CRITICAL' "
                               "ORDER BY priority_score DESC, family_num LIMIT 10",
        "tier_distribution": BASE + _tier_spine("CAST(count(s.family_id) AS BIGINT)", "families"),
        "need_type": BASE + "SELECT family_id, need_type FROM cases",
        "needs_programs": BASE + "SELECT family_id, array_to_string(needs_programs, '|') AS needs_programs FROM cases",
        "damage_categories": BASE + "SELECT family_id, array_to_string(damage_categories, '|') AS damage_categories "
                                    "FROM cases",
        "damage_semi": BASE + "SELECT id AS family_id, gov AS governorate FROM main_t "
                              "WHERE id IN (SELECT fid FROM damage_t WHERE fid IS NOT NULL)",
        "unserved_families": BASE + "SELECT id AS family_id, gov AS governorate FROM main_t m "
                                    "WHERE NOT EXISTS (SELECT 1 FROM needs_t n WHERE n.fid = m.id)",
        "city_fallback": BASE + "SELECT family_id, city FROM cases",
        "aggregate_needs": BASE + f"SELECT * FROM {needs_sql()}",
        "family_need_items": BASE + " UNION ALL ".join(
            f"SELECT family_num, family_id, {pos} AS item_pos, {q(item)} AS need_item, {q(cat)} AS category, "
            f"{q(urg)} AS urgency FROM scored WHERE {_need_pred(sigs)}"
            for pos, (item, cat, urg, sigs) in enumerate(_need_items())),
        "ration_packs": BASE + f"SELECT family_num, family_id, {_size_int()} AS family_size, "
                               f"CAST(ceil({_size_int()} / 4) AS BIGINT) AS ration_packs FROM scored",
        "ration_totals": BASE + _ration_totals_sql(),
        "ration_headline": BASE + f"SELECT CAST(COALESCE(sum(ceil({_size_int()} / 4)), 0) AS BIGINT) AS total_packs, "
                                  f"CAST(COALESCE(sum({_size_int()}), 0) AS BIGINT) AS total_people, "
                                  f"CAST({len(S.RATION_BASKET)} AS BIGINT) AS basket_items FROM scored",
        "medical_supplies": BASE + f"SELECT * FROM {medical_sql()}",
        "medical_headline": BASE + f"SELECT CAST(count(*) AS BIGINT) AS item_types, "
                                   f"CAST(COALESCE(max(families), 0) AS BIGINT) AS max_families FROM {medical_sql()}",
        "needs_headline": BASE + f"SELECT CAST(count(*) AS BIGINT) AS item_types, "
                                 f"CAST(count_if(urgency = 'critical') AS BIGINT) AS critical_types, "
                                 f"CAST(count_if(urgency = 'high') AS BIGINT) AS high_types, "
                                 f"CAST(COALESCE(sum(families_count), 0) AS BIGINT) AS total_instances FROM {needs_sql()}",
        "family_costs": BASE + "SELECT family_num, family_id, " + _size_int() + " AS size, "
                        + ", ".join(f"{expr} AS {name}" for _, name, expr in _cost_exprs())
                        + ", CAST(" + " + ".join(expr for _, _, expr in _cost_exprs()) + " AS BIGINT) AS monthly_total_usd"
                        + " FROM scored",
        "financial_totals": BASE + f"SELECT * FROM {financial_sql()}",
        "budget_breakdown": BASE + f"SELECT * FROM {financial_sql()} WHERE category <> {q(S.GRAND_TOTAL)} AND total_usd > 0",
        "needs_summary": BASE + _summary_sql(),
        "rate_table": BASE + _rate_sql(),
        "needs_report": BASE + _report_sql(),
        "overview_headline": BASE + "SELECT CAST(count(*) AS BIGINT) AS families, "
                                    "CAST(trunc(COALESCE(sum(family_size), 0.0)) AS BIGINT) AS individuals, "
                                    + ", ".join(f"CAST(count_if(priority_tier = {q(t)}) AS BIGINT) AS {t.lower()}"
                                                for t in S.TIER_ORDER) + " FROM scored",
        "top_cities": BASE + "SELECT city, CAST(count(*) AS BIGINT) AS families FROM scored WHERE city IS NOT NULL "
                             "GROUP BY city ORDER BY families DESC, city LIMIT 10",
        "signal_totals": BASE + _signal_totals_sql(),
        "avg_size_by_tier": BASE + _tier_spine("avg(s.family_size)", "avg_value"),
        "avg_score_by_city": BASE + "SELECT city, avg(CAST(priority_score AS DOUBLE)) AS avg_value FROM scored "
                                    "WHERE city IS NOT NULL GROUP BY city ORDER BY avg_value DESC, city LIMIT 10",
        "needs_by_category": BASE + _category_sql(),
        "needs_by_urgency": BASE + _urgency_sql(),
        "filter_options": BASE + "SELECT DISTINCT 'city' AS dimension, city AS value FROM scored WHERE city IS NOT NULL "
                                 "UNION SELECT DISTINCT 'displacement_type', displacement_type FROM scored "
                                 "WHERE displacement_type IS NOT NULL",
        "caseload_stats": BASE + _stats_sql(),
        "stats_json": BASE + _stats_json_sql(),
        "display_list": BASE + f"SELECT {DISPLAY} FROM scored",
        "case_labels": BASE + "SELECT family_num, priority_score, "
                              "printf('Family #%03d  ·  %s  ·  %s  (score %d)', family_num, COALESCE(city, '?'), "
                              "priority_tier, priority_score) AS label FROM scored",
        "signal_labels": BASE + "SELECT family_id, concat_ws(', ', "
                                + ", ".join(f"CASE WHEN {c} THEN {q(lbl)} END" for c, lbl in S.SIGNAL_LABELS)
                                + ") AS signal_labels FROM scored",
        "case_profile": BASE + _profile_sql(),
        "column_profile": BASE + _column_profile_sql(),
        "column_profile_analytics": BASE + _column_profile_sql(
            [c for c in SCORED_COLUMNS if c in S.PROFILE_TEXT or c not in TEXT_COLUMNS]),
        "case_profile_by_number": BASE + _profile_sql("WHERE family_num = 7"),
        "needs_json": BASE + "SELECT '{\"need_item\":\"' || need_item || '\",\"category\":\"' || category || '\",\"urgency\":\"' "
                             "|| urgency || '\",\"families_count\":' || CAST(families_count AS VARCHAR) || '}' AS record "
                             f"FROM {needs_sql()}",
        "caseload_filter_lists": BASE + "SELECT family_num, family_id, priority_tier, city, displacement_type FROM scored "
                                        "WHERE priority_tier IN ('HIGH', 'MEDIUM') AND city IN ('FRANCE-1', 'FRANCE-2', 'CHINA-3', 'INDIA-0') "
                                        f"AND displacement_type IN ({q(S.DISPLACED_TYPES[0])}, {q(S.HOST_COMMUNITY)})",
        "needs_display": BASE + "SELECT CASE category " + " ".join(f"WHEN {q(c)} THEN {q(i)}" for c, i in S.CATEGORY_ICON)
                         + f" ELSE {q(S.DEFAULT_ICON)} END AS icon, need_item AS need, category, urgency, "
                           f"families_count AS families, pct_of_total FROM {needs_sql()}",
        "headline_cards": BASE + ", fin AS " + financial_sql() + " SELECT format('{:,}', CAST(count(*) AS BIGINT)) AS families, "
                          "format('{:,}', CAST(trunc(COALESCE(sum(family_size), 0.0)) AS BIGINT)) AS individuals, "
                          + ", ".join(f"format('{{:,}}', CAST(count_if(priority_tier = {q(t)}) AS BIGINT)) AS {t.lower()}"
                                      for t in S.TIER_ORDER)
                          + f", '$' || format('{{:,}}', (SELECT total_usd FROM fin WHERE category = {q(S.GRAND_TOTAL)})) "
                            "AS monthly_budget FROM scored",
        "fallback_stats": BASE + ", top AS (SELECT city, count(*) AS n FROM scored WHERE city IS NOT NULL GROUP BY city "
                          "ORDER BY n DESC, city LIMIT 5) SELECT CAST(count(*) AS BIGINT) AS families, "
                          "CAST(trunc(COALESCE(sum(family_size), 0.0)) AS BIGINT) AS members, "
                          "CAST(count_if(is_displaced) AS BIGINT) AS displaced, "
                          "CAST(count_if(has_medical) AS BIGINT) AS with_medical_needs, "
                          "CAST(count_if(is_homeless) AS BIGINT) AS homeless, "
                          "(SELECT COALESCE(string_agg(city, ', ' ORDER BY n DESC, city), '') FROM top) AS top_cities "
                          "FROM scored",
        "queue_headline": BASE + "SELECT CAST(count(*) AS BIGINT) AS shown, "
                          "CAST(count_if(priority_tier = 'CRITICAL') AS BIGINT) AS critical, "
                          "CAST(count_if(priority_tier = 'HIGH') AS BIGINT) AS high, "
                          "COALESCE(sum(family_size), 0.0) AS individuals FROM scored "
                          "WHERE priority_tier IN ('CRITICAL', 'HIGH') AND city IS NOT NULL AND displacement_type IS NOT NULL",
        "caseload_filter": BASE + "SELECT family_num, family_id, priority_tier, city, displacement_type FROM scored "
                                  "WHERE priority_tier IN ('CRITICAL', 'HIGH') AND city IS NOT NULL "
                                  "AND displacement_type IS NOT NULL",
        "filtered_counts": BASE + "SELECT CAST(count_if(priority_tier IN ('CRITICAL', 'HIGH') AND city IS NOT NULL "
                                  "AND displacement_type IS NOT NULL) AS BIGINT) AS shown, "
                                  "CAST(count(*) AS BIGINT) AS total FROM scored",
        "search_homeless": _search_sql("is_homeless"),
        "search_medical": _search_sql("has_medical"),
        "search_widow_gt4": _search_sql("is_widow AND COALESCE(family_size > 4, FALSE)"),
        "search_displaced_noincome": _search_sql("is_displaced AND is_unemployed"),
        "search_ne_null": _search_sql("COALESCE(family_size <> 4, TRUE)"),
        "analyse_count": BASE + "SELECT CAST(count(*) AS BIGINT) AS families FROM scored WHERE is_homeless",
        "analyse_sum": BASE + "SELECT COALESCE(sum(family_size), 0.0) AS sum_family_size FROM scored WHERE priority_tier = 'HIGH'",
        "search_critical": _search_sql("priority_tier = 'CRITICAL'"),
        "analyse_rations_region": BASE + f"SELECT CAST(count(*) AS BIGINT) AS families, "
                                         f"CAST(COALESCE(sum(ceil({_size_int()} / 4)), 0) AS BIGINT) AS total_packs, "
                                         f"CAST(COALESCE(sum({_size_int()}), 0) AS BIGINT) AS total_people "
                                         "FROM scored WHERE COALESCE(contains(lower(governorate), 'asia'), FALSE)",
        "analyse_budget_homeless": BASE + f"SELECT * FROM {financial_sql(where='is_homeless')}",
        "analyse_blankets": BASE + f"SELECT * FROM {needs_sql(where='is_displaced')} "
                                   "WHERE need_item = 'Blankets & bedding'",
        "analyse_medical_region": BASE + "SELECT * FROM " + medical_sql(
            where="COALESCE(contains(lower(governorate), 'america'), FALSE)"),
        "anonymize_main": BASE + f'SELECT id AS "{m.ID}", gov AS "{m.GOVERNORATE}", dist AS "{m.DISTRICT}", '
                                 f'sub AS "{m.SUB_DISTRICT}", disp AS "{m.DISPLACEMENT_TYPE}", hs AS "{m.HOUSING_TYPE}", '
                                 f'size AS "{m.FAMILY_SIZE}", dep AS "{m.DEPENDENTS}", bw AS "{m.BREADWINNERS}" '
                                 "FROM main_t",
        "anonymize_members": BASE + f"SELECT fid AS family_id, k AS member_key, {_bucket_sql('occ_text')} AS "
                                    f"occupation_bucket, {_birth_year_sql('dob_text')} AS birth_year FROM members_t",
        "occupation_bucket": BASE + f"SELECT k AS member_key, occ_text AS occupation_text, "
                                    f"{_bucket_sql('occ_text')} AS occupation_bucket FROM members_t",
        "birth_year": BASE + f"SELECT k AS member_key, dob_text, {_birth_year_sql('dob_text')} AS birth_year "
                             "FROM members_t",
        "birth_year_forms": _date_forms_sql(),
        "occupation_sentences": _occupation_sql(),
        "anonymize_damage": "SELECT CAST(o_custkey AS BIGINT) AS family_id, CASE (o_custkey + l_partkey % 2) % 3 "
                            f"WHEN 0 THEN {q(S.DAMAGE_CATEGORIES[0])} WHEN 1 THEN {q(S.DAMAGE_CATEGORIES[1])} "
                            f"ELSE {q(S.DAMAGE_CATEGORIES[2])} END AS category, l_quantity AS quantity, CAST(3 AS BIGINT) AS n_columns "
                            "FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
                            "WHERE l_returnflag IN ('A', 'R') AND o_custkey % 5 = 0 OR o_custkey % 13 = 0",
        "anonymize_needs": BASE + ", with_quantity AS (SELECT CAST(o.o_custkey AS BIGINT) AS family_id, "
                           f"CASE (o.o_custkey * 7 + l.l_partkey % 4) % 16 WHEN 0 THEN {q(S.PROGRAM_FINANCIAL)} "
                           f"WHEN 1 THEN {q(S.PROGRAM_MEDICAL)} WHEN 2 THEN {q(S.PROGRAM_LEGAL)} WHEN 3 THEN {q(S.PROGRAM_EDUCATION)} "
                           f"WHEN 15 THEN NULL ELSE {q(S.PROGRAM_FOOD)} END AS program, "
                           f"CASE WHEN o.o_custkey % 9 <> 0 THEN {q(S.NEED_BLANKETS)} WHEN l.l_suppkey % 3 = 0 THEN {q(S.BABY_NEEDS[0])} "
                           f"WHEN l.l_suppkey % 3 = 1 THEN {q(S.BABY_NEEDS[1])} ELSE {q(S.NEED_BLANKETS)} END AS classification, "
                           f"l.l_quantity AS quantity, CASE WHEN l.l_linestatus = 'F' AND o.o_custkey % 3 = 0 THEN {q(S.YES)} "
                           f"ELSE {q(S.NO)} END AS served FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey "
                           "WHERE NOT COALESCE(l.l_returnflag IN ('A', 'R') AND o.o_custkey % 5 = 0 OR o.o_custkey % 13 = 0, FALSE)) "
                           "SELECT *, CAST(5 AS BIGINT) AS n_columns FROM with_quantity",
        "caseload_filter_all_lists": BASE + "SELECT family_num, family_id, priority_tier, city, displacement_type FROM scored "
                                     "WHERE priority_tier IN ('CRITICAL', 'HIGH', 'MEDIUM') AND city IN ("
                                     + ", ".join(q(f"{n}{p}") for n in ("FRANCE", "CHINA", "INDIA", "PERU", "KENYA")
                                                 for p in ("", "-0", "-1", "-2", "-3"))
                                     + f") AND displacement_type IN {_in([*S.DISPLACED_TYPES[:2], S.HOST_COMMUNITY])}",
        "intake_parse": BASE + _intake_parsed() + " SELECT * FROM intake_parsed",
        "need_array_parse": _need_array_sql(),
        "intake_append": BASE + _intake_parsed() + _intake_scored("(SELECT max(family_num) FROM scored)")
                         + f"SELECT {INTAKE_COLS.replace('family_id', 'CAST(family_id AS VARCHAR) AS family_id')} "
                           f"FROM scored UNION ALL SELECT {INTAKE_COLS} FROM intake_final",
        "intake_stream": BASE + _intake_parsed() + _intake_scored("(SELECT max(family_num) FROM scored)") + f"SELECT {INTAKE_COLS} FROM intake_final",
        "report_after_intake": _after_intake() + _report_sql("everyone"),
        "headline_after_intake": _after_intake() + "SELECT CAST(count(*) AS BIGINT) AS families, "
                                 "CAST(trunc(COALESCE(sum(family_size), 0.0)) AS BIGINT) AS individuals, "
                                 + ", ".join(f"CAST(count_if(priority_tier = {q(t)}) AS BIGINT) AS {t.lower()}"
                                             for t in S.TIER_ORDER) + " FROM everyone",
        "signals_after_intake": _after_intake() + _signal_totals_sql("everyone"),
        "top_cities_after_intake": _after_intake() + "SELECT city, CAST(count(*) AS BIGINT) AS families FROM everyone "
                                   "WHERE city IS NOT NULL GROUP BY city ORDER BY families DESC, city LIMIT 10",
        "mean_scores_after_intake": _after_intake() + "SELECT city, avg(CAST(priority_score AS DOUBLE)) AS avg_value FROM everyone "
                                    "WHERE city IS NOT NULL GROUP BY city ORDER BY avg_value DESC, city LIMIT 10",
    }
    return out
