"""DuckDB SQL twins of the registered queries (the correctness oracle).

The adapters are re-stated as CTEs; cleaning rules are rendered from the
same lists the Spark side uses.  DuckDB's regex engine is RE2, so patterns
use only features both engines share; edge-strip replacements need the
'g' flag there because DuckDB replaces the first match only by default.
"""

from __future__ import annotations

from ..constants import (DEMO_ABSTRACT_RULES, DEMO_TITLE_RULES, HC_RENAME, LABELS_LONG,
                         LABELS_SHORT, LABELS_TINY, LSTRIP_CHARS, OUT_OF_SCOPE_CODES,
                         PLACEHOLDER_HC, RANK_THRESHOLDS, SECOND_SOURCE_FUNDER, SUBGROUP_FUNDER,
                         WS_CLASS)
from ..sources.adapters import DEMO_HC_RAW

DEMO_FUNDER = "src3"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


def inlist(items) -> str:
    return "(" + ", ".join(lit(x) for x in items) + ")"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS_CLASS}]+|[{WS_CLASS}]+$', '', 'g')"


def norm(c: str) -> str:
    return f"lower({strip(c)})"


def collapse(c: str) -> str:
    return strip(f"regexp_replace({c}, '[{WS_CLASS}]+', ' ', 'g')")


def boiler(c: str, pats: list[str]) -> str:
    out = c
    for p in pats:
        out = f"regexp_replace({out}, {lit('^(?:' + p + ')')}, '', 'i')"
    return out


def lstrip_p(c: str) -> str:
    return f"ltrim({c}, {lit(LSTRIP_CHARS)})"


def not_in(c: str, phrases) -> str:
    if not phrases:
        return "TRUE"
    return f"NOT coalesce({norm(c)} IN {inlist(phrases)}, FALSE)"


def blank(c: str, phrases) -> str:
    f = f"coalesce({c}, '')"
    if not phrases:
        return f
    return f"CASE WHEN {norm(f)} IN {inlist(phrases)} THEN '' ELSE {f} END"


def no_prefix(c: str, prefixes) -> str:
    if not prefixes:
        return "TRUE"
    return "NOT (" + " OR ".join(f"starts_with(lower({c}), {lit(p)})" for p in prefixes) + ")"


def clean_stage(src: str, col: str, rules: dict) -> str:
    """Subquery applying the C5 chain to ``col`` of relation ``src``."""
    s1 = f"(SELECT * FROM {src} WHERE {not_in(col, rules['drop'])})"
    s2 = f"(SELECT * REPLACE ({blank(col, rules['nulls'])} AS {col}) FROM {s1})"
    s3 = f"(SELECT * FROM {s2} WHERE {no_prefix(col, rules['prefixes'])})"
    val = collapse(lstrip_p(boiler(col, rules["boiler_plate"])))
    return f"(SELECT * REPLACE ({val} AS {col}) FROM {s3})"


def processed(src: str = "records", min_len: int = 110) -> str:
    t = clean_stage(src, "AwardTitle", DEMO_TITLE_RULES)
    a = clean_stage(t, "AwardAbstract", DEMO_ABSTRACT_RULES)
    alltext = strip("coalesce(AwardTitle, '') || ' ' || coalesce(AwardAbstract, '')")
    return (f"(SELECT * FROM (SELECT *, {alltext} AS AllText FROM {a}) "
            f"WHERE length(AllText) >= {min_len})")


# ------------------------------------------------------------------ adapters

RECORDS = """records AS (
  SELECT doc_id, source AS FundingOrganisation, CAST(doc_id % 400 AS VARCHAR) AS OrganisationReference,
    CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, 1, instr(text, chr(10)) - 1) ELSE text END AS AwardTitle,
    CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, instr(text, chr(10)) + 1) END AS AwardAbstract,
    CAST(2014 + 4 * (doc_id % 3) AS INTEGER) AS year, lang
  FROM documents)"""

C8 = "CAST(1 + l_partkey % 8 AS VARCHAR) || '.' || CAST(1 + l_suppkey % 5 AS VARCHAR)"
C9 = "CAST(1 + l_partkey % 9 AS VARCHAR) || '.' || CAST(1 + l_suppkey % 5 AS VARCHAR)"
HCRAW = f"({lst(DEMO_HC_RAW)})[1 + l_partkey % {len(DEMO_HC_RAW)}]"

LINE_TAGS = f"""line_tags AS (
  SELECT l_orderkey AS row_id,
    list({C8} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS codes,
    list({C9} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS codes9,
    list({HCRAW} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS hcs,
    list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS qty
  FROM lineitem GROUP BY l_orderkey)"""

TAG_LONG = f"tag_long AS (SELECT l_orderkey AS row_id, {C8} AS label FROM lineitem)"
TRUTH = "truth AS (SELECT DISTINCT row_id, label FROM tag_long)"
PRED = f"""pred AS (
  SELECT DISTINCT row_id, label FROM (
    SELECT l_orderkey AS row_id, {C8} AS label FROM lineitem WHERE l_linenumber <= 3
    UNION ALL
    SELECT l_orderkey, CAST(1 + (l_partkey + 1) % 8 AS VARCHAR) || '.' || CAST(1 + l_suppkey % 5 AS VARCHAR)
    FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R'))"""
META = f"""meta AS (SELECT o_orderkey AS row_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN {lit(SUBGROUP_FUNDER)} ELSE o_orderpriority END AS FundingOrganisation
  FROM orders)"""

SCORES = """scores AS (
  SELECT vec_id AS row_id, list_transform(embedding[1:48], lambda x: 20.0 * CAST(x AS DOUBLE) - CAST(vec_id % 8 AS DOUBLE)) AS logits
  FROM embeddings)"""
SCORES_LONG = """scores_long AS (
  SELECT row_id, CAST(i - 1 AS INTEGER) AS label_idx, 1.0 / (1.0 + exp(-logits[i])) AS score
  FROM scores, range(1, 49) r(i))"""


# The Spark sheets are as wide as their fullest row; null columns beyond that change no list.
SHEET_COLUMNS = 24


def survey_sheet(year: int) -> str:
    n_ra = n_hc = SHEET_COLUMNS
    cols = ["r.FundingOrganisation"]
    if year == 2014:
        cols += ["r.OrganisationReference AS GrantCode_Public", "r.AwardTitle AS Title_Public",
                 "r.AwardAbstract AS Abstract_Public"]
    else:
        cols += ["r.OrganisationReference", "r.AwardTitle", "r.AwardAbstract",
                 "CASE WHEN r.lang = 'es' THEN 'Automatic' ELSE 'Manual' END AS CodingType"]
    for i in range(1, n_ra + 1):
        code = f"t.codes[{i}]"
        v = f"CAST({code} AS DOUBLE)" if year == 2014 else f"CASE WHEN t.qty[{i}] < 3 THEN ' ' ELSE {code} END"
        cols += [f"CASE WHEN len(t.codes) >= {i} THEN {v} END AS RA_{i}",
                 f"CASE WHEN len(t.codes) >= {i} THEN 100.0 / len(t.codes) END AS \"RA_{i}%\""]
    for i in range(1, n_hc + 1):
        cols += [f"CASE WHEN len(t.hcs) >= {i} THEN t.hcs[{i}] END AS HC_{i}",
                 f"CASE WHEN len(t.hcs) >= {i} THEN 100.0 / len(t.hcs) END AS \"HC_{i}%\""]
    cols.append("r.doc_id AS sheet_row")
    return (f"(SELECT {', '.join(cols)} FROM records r LEFT JOIN line_tags t ON r.doc_id = t.row_id "
            f"WHERE r.year = {year})")


def survey_year(year: int) -> str:
    n_ra = n_hc = SHEET_COLUMNS
    ra = [f"CAST(RA_{i} AS VARCHAR) AS RA_{i}" for i in range(1, n_ra + 1)]
    hc = [f"HC_{i}" for i in range(1, n_hc + 1)]
    if year == 2014:
        base = ("FundingOrganisation, GrantCode_Public AS OrganisationReference, "
                "Title_Public AS AwardTitle, Abstract_Public AS AwardAbstract")
        where = "TRUE"
    else:
        base = "FundingOrganisation, OrganisationReference, AwardTitle, AwardAbstract"
        where = "CodingType = 'Manual'"
    return (f"(SELECT {base}, {', '.join(ra + hc)}, sheet_row, CAST({year} AS INTEGER) AS year "
            f"FROM {survey_sheet(year)} WHERE {where})")


def _nonnull(cols: list[str]) -> str:
    return f"list_filter([{', '.join(cols)}], lambda x: x IS NOT NULL)"


def _ws_nonblank(x: str) -> str:
    return f"{strip(x)} <> ''"


SURVEY = f"""survey_u AS (
  SELECT * FROM {survey_year(2014)} UNION ALL BY NAME
  SELECT * FROM {survey_year(2018)} UNION ALL BY NAME
  SELECT * FROM {survey_year(2022)}),
survey_latest AS (
  SELECT * FROM survey_u
  QUALIFY row_number() OVER (PARTITION BY FundingOrganisation, OrganisationReference
                             ORDER BY year DESC, sheet_row DESC) = 1),
survey_lists AS (
  SELECT FundingOrganisation, OrganisationReference, AwardTitle, AwardAbstract,
    list_transform(list_filter({_nonnull([f'RA_{i}' for i in range(1, SHEET_COLUMNS + 1)])}, lambda x: {_ws_nonblank('x')}),
                   lambda x: substring(x, 1, 3)) AS RA,
    {_nonnull([f'HC_{i}' for i in range(1, SHEET_COLUMNS + 1)])} AS HC,
    year AS src_year, CAST(sheet_row AS BIGINT) AS src_row
  FROM survey_latest),
survey AS (
  SELECT FundingOrganisation, OrganisationReference, AwardTitle, AwardAbstract, RA,
    list_sort(list_distinct(list_transform(list_filter(RA, lambda x: {_ws_nonblank('x')}),
                                           lambda x: substring(x, 1, 1)))) AS RA_top,
    HC, 0 AS src_rank, src_year, src_row
  FROM survey_lists)"""

RAW2 = f"""raw2 AS (
  SELECT CAST(r.doc_id AS VARCHAR) AS project_id, r.AwardTitle AS project_title,
    r.AwardAbstract AS scientific_abstract,
    CASE WHEN len(t.hcs) <= 2 THEN {lst(PLACEHOLDER_HC)}[len(t.hcs)] ELSE array_to_string(t.hcs, ',') END AS ukcrc_value,
    CASE WHEN r.lang = 'de' THEN 'None/' || array_to_string(list_transform(t.codes9, lambda c: substring(c, 1, 1) || ' Group'), ' / ')
         ELSE array_to_string(list_transform(t.codes9, lambda c: substring(c, 1, 1) || ' Group'), ' / ') END AS hrcs_rac_category,
    CASE WHEN r.lang = 'es' THEN replace(array_to_string(list_transform(t.codes9, lambda c: c || ' Activity'), '/'), '/', ' / ')
         WHEN r.lang = 'fr' THEN array_to_string(list_transform(t.codes9, lambda c: c || ' Activity'), '/') || '/'
         ELSE array_to_string(list_transform(t.codes9, lambda c: c || ' Activity'), '/') END AS ukcrc_value_rac
  FROM records r LEFT JOIN line_tags t ON r.doc_id = t.row_id)"""

def first_tok(x: str) -> str:
    return f"regexp_extract({x}, '^[{WS_CLASS}]*([^{WS_CLASS}]+)', 1)"


def first_tokens_slash(c: str) -> str:
    return (f"list_filter(list_transform(string_split({c}, '/'), lambda x: {first_tok('x')}), "
            f"lambda x: x <> '')")


def top_chars(c: str) -> str:
    return (f"list_transform(list_filter(string_split({strip(c)}, '/'), lambda x: x <> 'None'), "
            f"lambda x: substring({strip('x')}, 1, 1))")


def in_scope(c: str) -> str:
    tok = f"nullif({first_tok(c)}, '')"
    return f"NOT coalesce({tok} IN {inlist(OUT_OF_SCOPE_CODES)}, FALSE)"


HC_MAP = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in HC_RENAME.items()) + "}"


def normalise(c: str) -> str:
    return f"list_transform({c}, lambda x: coalesce({HC_MAP}[{norm('x')}], {norm('x')}))"


SECOND = f"""second AS (
  SELECT {lit(SECOND_SOURCE_FUNDER)} AS FundingOrganisation, project_id AS OrganisationReference,
    project_title AS AwardTitle, scientific_abstract AS AwardAbstract,
    {first_tokens_slash('ukcrc_value_rac')} AS RA,
    {top_chars('hrcs_rac_category')} AS RA_top,
    string_split(ukcrc_value, ',') AS HC,
    1 AS src_rank, 0 AS src_year, TRY_CAST(project_id AS BIGINT) AS src_row
  FROM raw2
  WHERE hrcs_rac_category IS NOT NULL AND ukcrc_value_rac IS NOT NULL AND {in_scope('ukcrc_value_rac')})"""

COMBINED = f"""combined AS (
  SELECT * FROM survey
  UNION ALL
  SELECT * FROM second WHERE OrganisationReference IN
    (SELECT OrganisationReference FROM survey WHERE FundingOrganisation = {lit(DEMO_FUNDER)}))"""


INDEX = "row_number() OVER (ORDER BY src_rank, src_year, src_row) - 1"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def j(c: str) -> str:
    return f"array_to_string({c}, '|')"


# ------------------------------------------------------------------ per-label metrics

LABEL_DIM = ("label_dim AS (SELECT * FROM (VALUES "
             + ", ".join(f"({i}, {lit(n.split(':')[0])}, {lit(n)})" for i, n in enumerate(LABELS_LONG))
             + ") v(label_idx, code, name))")


def parent_of(c: str) -> str:
    return f"coalesce(TRY_CAST(split_part({c}, '.', 1) AS INTEGER), 0)"


def super_of(p: str) -> str:
    return f"CASE WHEN {p} BETWEEN 1 AND 3 THEN 1 WHEN {p} BETWEEN 4 AND 5 THEN 2 WHEN {p} BETWEEN 6 AND 8 THEN 3 END"


def rolled(levels=("detail", "parent", "super"), with_meta: bool = True) -> str:
    flagged = ("flagged AS (SELECT f.*, " +
               (f"coalesce(m.FundingOrganisation = {lit(SUBGROUP_FUNDER)}, FALSE) AS in_sub "
                "FROM (SELECT row_id, label, 1 AS t, 0 AS p FROM truth UNION ALL "
                "SELECT row_id, label, 0, 1 FROM pred) f LEFT JOIN meta m USING (row_id))"
                if with_meta else
                "FALSE AS in_sub FROM (SELECT row_id, label, 1 AS t, 0 AS p FROM truth UNION ALL "
                "SELECT row_id, label, 0, 1 FROM pred) f)"))
    parts = []
    if "detail" in levels:
        parts.append("SELECT row_id, 'detail' AS level, label AS key, t, p, in_sub FROM flagged")
    if "parent" in levels:
        parts.append(f"SELECT row_id, 'parent' AS level, CAST({parent_of('label')} AS VARCHAR) AS key, t, p, in_sub "
                     f"FROM flagged WHERE {parent_of('label')} > 0")
    if "super" in levels:
        sp = super_of(parent_of("label"))
        parts.append(f"SELECT row_id, 'super' AS level, CAST({sp} AS VARCHAR) AS key, t, p, in_sub FROM flagged "
                     f"WHERE {sp} IS NOT NULL")
    rolled_cte = ("rolled AS (SELECT row_id, level, key, max(t) AS t, max(p) AS p, bool_or(in_sub) AS in_sub "
                  "FROM (" + " UNION ALL ".join(parts) + ") GROUP BY row_id, level, key)")
    return flagged + ",\n" + rolled_cte


def per_label_sql(scopes=("all", "sub"), classes: str | None = None) -> str:
    scope_rows = []
    if "all" in scopes:
        scope_rows.append("SELECT 'all' AS scope, level, key, t, p FROM rolled")
    if "sub" in scopes:
        scope_rows.append("SELECT 'sub', level, key, t, p FROM rolled WHERE in_sub")
    cls = classes or ("SELECT DISTINCT label AS key FROM (SELECT label FROM truth UNION ALL SELECT label FROM pred)")
    universe = (f"universe AS (SELECT 'detail' AS level, key FROM ({cls}) UNION ALL "
                "SELECT 'parent', CAST(i AS VARCHAR) FROM range(1, 9) r(i) UNION ALL "
                "SELECT 'super', CAST(i AS VARCHAR) FROM range(1, 4) r(i))")
    scope_list = ", ".join(lit(s) for s in scopes)
    counts = ("counts AS (SELECT scope, level, key, sum(t * p) AS tp, sum(p * (1 - t)) AS fp, "
              "sum(t * (1 - p)) AS fn FROM (" + " UNION ALL ".join(scope_rows) + ") GROUP BY ALL)")
    per = (f"per AS (SELECT u.scope, u.level, u.key, coalesce(c.tp, 0) AS tp, coalesce(c.fp, 0) AS fp, "
           f"coalesce(c.fn, 0) AS fn FROM (SELECT s.scope, universe.* FROM universe, "
           f"(SELECT unnest([{scope_list}]) AS scope) s) u LEFT JOIN counts c USING (scope, level, key)),\n"
           "per2 AS (SELECT *, tp + fn AS support, "
           "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, "
           "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, "
           "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM per)")
    return universe + ",\n" + counts + ",\n" + per


PREFIX_SQL = ("CASE level || '|' || scope " + " ".join(
    f"WHEN {lit(k)} THEN {lit(v)}" for k, v in {
        "detail|all": "", "parent|all": "parent_", "super|all": "super_parent_",
        "detail|sub": "wellcome_", "parent|sub": "parent_wellcome_",
        "super|sub": "super_parent_wellcome_"}.items()) + " END")

SUMMARY = f"""SELECT {PREFIX_SQL} AS prefix,
  round(avg(precision), 9) AS precision_macro,
  round(CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) ELSE 0.0 END, 9) AS precision_micro,
  round(avg(recall), 9) AS recall_macro,
  round(CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn)) ELSE 0.0 END, 9) AS recall_micro,
  round(avg(f1), 9) AS f1_macro,
  round(CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0.0 END, 9) AS f1_micro,
  CAST(arg_min(support, key) AS BIGINT) AS label0_true, CAST(arg_min(tp + fp, key) AS BIGINT) AS label0_pred
FROM per2"""


def _rank_threshold(inclusive: bool = False) -> str:
    op = ">=" if inclusive else ">"
    th = "[" + ", ".join(str(float(t)) for t in RANK_THRESHOLDS) + "]"
    k = len(RANK_THRESHOLDS)
    return f"""ranked AS (
  SELECT row_id, label_idx, score,
    row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label_idx DESC) AS rank
  FROM scores_long),
tagged AS (
  SELECT r.row_id, coalesce(list(r.label_idx ORDER BY r.label_idx) FILTER (WHERE r.score {op}
     CASE WHEN r.rank <= {k} THEN ({th})[r.rank] ELSE 1.0 END), []) AS tags
  FROM ranked r GROUP BY r.row_id)"""


def _split_sql(seed: int = 10, p: int = 1, q: int = 5) -> str:
    return f"""rows_ AS (SELECT row_id, list_distinct(codes) AS labs FROM line_tags),
lab_long AS (SELECT row_id, unnest(labs) AS label FROM rows_),
lab_n AS (SELECT label, count(*) AS n FROM lab_long GROUP BY label),
rarest AS (SELECT l.row_id, arg_min(l.label, (c.n, l.label)) AS stratum
           FROM lab_long l JOIN lab_n c USING (label) GROUP BY l.row_id),
strata AS (SELECT r.row_id, coalesce(s.stratum, '') AS stratum,
           md5(CAST(r.row_id AS VARCHAR) || '|{seed}') AS h
           FROM rows_ r LEFT JOIN rarest s USING (row_id)),
ranked_s AS (SELECT row_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY h, row_id) AS rn FROM strata),
split AS (SELECT row_id, stratum,
          CASE WHEN (rn * {p}) // {q} > ((rn - 1) * {p}) // {q} THEN 'test' ELSE 'train' END AS split
          FROM ranked_s)"""


def _split_ctes(pfx: str, rows_sql: str, seed: int = 10, p: int = 1, q: int = 5) -> str:
    """Rarest-label split CTEs named ``{pfx}_*`` over ``rows_sql`` (row_id, labs)."""
    return f"""{pfx}_rows AS ({rows_sql}),
{pfx}_long AS (SELECT row_id, unnest(labs) AS label FROM {pfx}_rows),
{pfx}_n AS (SELECT label, count(*) AS n FROM {pfx}_long GROUP BY label),
{pfx}_rarest AS (SELECT l.row_id, arg_min(l.label, (c.n, l.label)) AS stratum
                 FROM {pfx}_long l JOIN {pfx}_n c USING (label) GROUP BY l.row_id),
{pfx}_ranked AS (SELECT r.row_id, row_number() OVER (PARTITION BY coalesce(s.stratum, '')
                   ORDER BY md5(CAST(r.row_id AS VARCHAR) || '|{seed}'), r.row_id) AS rn
                 FROM {pfx}_rows r LEFT JOIN {pfx}_rarest s USING (row_id)),
{pfx}_split AS (SELECT row_id, CASE WHEN (rn * {p}) // {q} > ((rn - 1) * {p}) // {q}
                THEN 'test' ELSE 'train' END AS split FROM {pfx}_ranked)"""


def _distinct_texts() -> str:
    return ("dtexts AS (SELECT doc_id, text FROM documents "
            "QUALIFY row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY doc_id DESC) = 1)")


def _exact_pairs(size: int = 9, threshold: float = 0.6, dtexts: str | None = None) -> str:
    """Exact all-pairs Jaccard over ``dtexts(doc_id, text, ...)``."""
    return f"""{dtexts or _distinct_texts()},
lt AS (SELECT doc_id, lower(text) AS t FROM dtexts),
sh AS (SELECT DISTINCT doc_id, s FROM (
   SELECT doc_id, substring(t, i, {size}) AS s FROM lt, range(1, greatest(length(t) - {size} + 2, 2)) r(i)
   WHERE length(t) >= {size} OR i = 1)),
shn AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
          GROUP BY ALL),
pairs AS (SELECT i.a, i.b, i.k / (na.n + nb.n - i.k) AS jaccard FROM inter i
          JOIN shn na ON na.doc_id = i.a JOIN shn nb ON nb.doc_id = i.b
          WHERE i.k / (na.n + nb.n - i.k) >= {threshold})"""


def walk_sql(prefix_ctes: list[str], dtexts: str | None, select: str) -> str:
    """Sequential survivor walk as a recursive CTE; ``select`` reads ``survivors``."""
    return ("WITH RECURSIVE " + "".join(c + ",\n" for c in prefix_ctes) + _exact_pairs(dtexts=dtexts) + """,
nodes AS (SELECT a AS id FROM pairs UNION SELECT b FROM pairs),
ordered AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM nodes),
nb AS (SELECT o.rn, list(CASE WHEN p.a = o.id THEN p.b ELSE p.a END) AS adj
       FROM ordered o JOIN pairs p ON p.a = o.id OR p.b = o.id GROUP BY o.rn),
walk(rn, kept) AS (
  SELECT 0, CAST([] AS BIGINT[])
  UNION ALL
  SELECT w.rn + 1,
         CASE WHEN len(list_intersect(w.kept, n.adj)) > 0 THEN w.kept
              ELSE list_append(w.kept, o.id) END
  FROM walk w JOIN ordered o ON o.rn = w.rn + 1 JOIN nb n ON n.rn = o.rn),
survivors AS (SELECT * FROM dtexts
  WHERE doc_id NOT IN (SELECT id FROM nodes)
     OR doc_id IN (SELECT unnest(kept) FROM walk WHERE rn = (SELECT count(*) FROM ordered)))
""" + select)


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    R = with_(RECORDS)
    tbp = DEMO_TITLE_RULES["boiler_plate"]
    q["clean_ws"] = f"SELECT doc_id, {collapse('text')} AS text_ws FROM documents"
    abp = DEMO_ABSTRACT_RULES["boiler_plate"]
    q["clean_boilerplate"] = R + (f"SELECT doc_id, {boiler('AwardTitle', tbp)} AS AwardTitle, "
                                  f"{boiler('AwardAbstract', abp)} AS AwardAbstract FROM records")
    q["clean_lstrip"] = R + (f"SELECT doc_id, {lstrip_p(boiler('AwardTitle', tbp))} AS AwardTitle, "
                             f"{lstrip_p(boiler('AwardAbstract', abp))} AS AwardAbstract FROM records")
    q["clean_drop_phrases"] = R + (f"SELECT doc_id, AwardTitle, AwardAbstract FROM records WHERE "
                                   f"{not_in('AwardTitle', DEMO_TITLE_RULES['drop'])} AND "
                                   f"{not_in('AwardAbstract', DEMO_ABSTRACT_RULES['drop'])}")
    q["clean_null_phrases"] = R + (f"SELECT doc_id, {blank('AwardTitle', DEMO_TITLE_RULES['nulls'])} AS AwardTitle, "
                                   f"{blank('AwardAbstract', DEMO_ABSTRACT_RULES['nulls'])} AS AwardAbstract FROM records")
    q["clean_prefix_filter"] = R + (f"SELECT doc_id FROM records WHERE "
                                    f"coalesce({no_prefix('AwardTitle', DEMO_TITLE_RULES['prefixes'])}, TRUE) AND "
                                    f"coalesce({no_prefix('AwardAbstract', ['the ', 'and '])}, TRUE)")
    q["clean_text_column"] = R + ("SELECT doc_id, AwardTitle, AwardAbstract FROM " + clean_stage(
        clean_stage("records", "AwardTitle", DEMO_TITLE_RULES), "AwardAbstract", DEMO_ABSTRACT_RULES))
    q["process_texts"] = R + f"SELECT doc_id, AllText FROM {processed()}"
    q["split_text_lower"] = R + f"SELECT doc_id, lower(AllText) AS text FROM {processed()}"
    dedup = (f"(SELECT * FROM {processed()} QUALIFY row_number() OVER "
             f"(PARTITION BY md5(lower(AllText)) ORDER BY doc_id DESC) = 1)")
    q["dedup_exact"] = R + f"SELECT doc_id, AllText FROM {dedup}"
    q["source_counts"] = R + (f"SELECT FundingOrganisation, count(*) AS n_docs, CAST(sum(length(AllText)) AS BIGINT) AS n_chars "
                              f"FROM {dedup} GROUP BY FundingOrganisation")

    RL = with_(RECORDS, LINE_TAGS)
    cells = {m: ", ".join(f"{m}_{i}" for i in range(1, SHEET_COLUMNS + 1)) for m in ("RA", "HC")}
    q["src_survey_year"] = RL + " UNION ALL ".join(
        f"SELECT FundingOrganisation, OrganisationReference, AwardTitle, AwardAbstract, concat_ws('|', {cells['RA']}) AS RA, "
        f"concat_ws('|', {cells['HC']}) AS HC, sheet_row, year FROM {survey_year(y)}" for y in (2014, 2018, 2022))
    RS = with_(RECORDS, LINE_TAGS, SURVEY)
    q["survey_combined"] = RS + (f"SELECT FundingOrganisation, OrganisationReference, AwardTitle, AwardAbstract, "
                                 f"{j('RA')} AS RA, {j('RA_top')} AS RA_top, {j('HC')} AS HC, src_year, src_row FROM survey")
    R2 = with_(RECORDS, LINE_TAGS, RAW2)
    RS2 = with_(RECORDS, LINE_TAGS, RAW2, SECOND)
    q["src_second"] = RS2 + (f"SELECT OrganisationReference, AwardTitle, AwardAbstract, {j('RA')} AS RA, "
                             f"{j('RA_top')} AS RA_top, {j('HC')} AS HC FROM second")
    q["drop_out_of_scope"] = R2 + f"SELECT project_id FROM raw2 WHERE {in_scope('ukcrc_value_rac')}"
    q["null_placeholder_tags"] = R2 + (f"SELECT project_id, CASE WHEN ukcrc_value IN {inlist(PLACEHOLDER_HC)} "
                                       f"THEN NULL ELSE ukcrc_value END AS HC FROM raw2")
    RC = with_(RECORDS, LINE_TAGS, SURVEY, RAW2, SECOND, COMBINED)
    q["semi_join_refs"] = RC + (f"SELECT OrganisationReference, AwardTitle FROM second WHERE OrganisationReference IN "
                                f"(SELECT OrganisationReference FROM survey WHERE FundingOrganisation = {lit(DEMO_FUNDER)})")
    q["combine_sources"] = RC + (f"SELECT FundingOrganisation, OrganisationReference, src_rank, src_year, src_row, "
                                 f"{j('RA')} AS RA FROM combined")
    q["pre_clean"] = RC + (f"SELECT {INDEX} AS index, FundingOrganisation, OrganisationReference FROM combined")

    q["tag_split_first_token"] = R2 + f"SELECT project_id, {j(first_tokens_slash('ukcrc_value_rac'))} AS ra FROM raw2"
    q["tag_split_first_char"] = R2 + f"SELECT project_id, {j(top_chars('hrcs_rac_category'))} AS ra_top FROM raw2"
    hc_split = normalise("string_split(ukcrc_value, ',')")
    q["tag_normalise"] = R2 + f"SELECT project_id, {j(hc_split)} AS hc FROM raw2"
    ras = _nonnull([f"CAST(RA_{i} AS VARCHAR)" for i in range(1, SHEET_COLUMNS + 1)])
    hcs = _nonnull([f"HC_{i}" for i in range(1, SHEET_COLUMNS + 1)])
    q["wide_to_list"] = RL + " UNION ALL ".join(
        f"SELECT sheet_row, {j(ras)} AS ra, {j(hcs)} AS hc FROM {survey_sheet(y)}" for y in (2014, 2018, 2022))
    cut = f"list_transform(list_filter({ras}, lambda x: {_ws_nonblank('x')}), lambda x: substring(x, 1, 3))"
    q["tag_truncate"] = RL + " UNION ALL ".join(
        f"SELECT sheet_row, {j(cut)} AS ra FROM {survey_sheet(y)}" for y in (2014, 2018, 2022))
    top = (f"list_sort(list_distinct(list_transform(list_filter(codes, lambda x: {_ws_nonblank('x')}), "
           f"lambda x: substring(x, 1, 1))))")
    L = with_(LINE_TAGS)
    q["tag_top_level"] = L + f"SELECT row_id, {j(top)} AS ra_top FROM line_tags"
    T = with_(TAG_LONG)
    q["label_parent"] = T + (f"SELECT label, {parent_of('label')} AS parent, {super_of(parent_of('label'))} AS super_parent "
                             f"FROM (SELECT DISTINCT label FROM tag_long)")
    short = lst(LABELS_SHORT)
    tiny = lst(LABELS_TINY)
    q["dim_labels"] = with_(TAG_LONG, LABEL_DIM) + (
        f"SELECT l.label, d.label_idx, d.name, "
        f"CASE WHEN d.code IS NOT NULL THEN {short}[{parent_of('d.code')}] END AS parent_name, "
        f"CASE WHEN d.code IS NOT NULL THEN {tiny}[{super_of(parent_of('d.code'))}] END AS super_parent_name "
        f"FROM (SELECT DISTINCT label FROM tag_long) l LEFT JOIN label_dim d ON l.label = d.code")

    q["tag_dist_code"] = T + "SELECT label, count(*) AS count FROM tag_long GROUP BY label"
    q["tag_dist_top"] = L + f"SELECT RA_top, count(*) AS count FROM (SELECT unnest({top}) AS RA_top FROM line_tags) GROUP BY RA_top"
    q["tag_dist_cat"] = L + f"SELECT HC, count(*) AS count FROM (SELECT unnest({normalise('hcs')}) AS HC FROM line_tags) GROUP BY HC"
    SPL = with_(LINE_TAGS, _split_sql())
    q["split_rarest"] = SPL + "SELECT row_id, stratum, split FROM split"
    q["label_counts"] = SPL + (
        "SELECT g.split, g.label, coalesce(c.n, 0) AS count FROM "
        "(SELECT label, unnest(['train', 'test']) AS split FROM (SELECT DISTINCT label FROM lab_long)) g "
        "LEFT JOIN (SELECT s.split, l.label, count(*) AS n FROM lab_long l JOIN split s USING (row_id) GROUP BY ALL) c "
        "USING (split, label)")
    q["split_balance"] = SPL + (
        "SELECT l.label, count(*) AS n, CAST(sum(CASE WHEN s.split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS n_test, "
        "round(sum(CASE WHEN s.split = 'test' THEN 1 ELSE 0 END) / count(*), 9) AS test_share "
        "FROM lab_long l JOIN split s USING (row_id) GROUP BY l.label")
    q["split_iterative_balance"] = SPL + "SELECT label, count(*) AS n, TRUE AS balanced FROM lab_long GROUP BY label"
    q["split_meta"] = with_(LINE_TAGS, META, _split_sql().replace(
        "rows_ AS (SELECT row_id, list_distinct(codes) AS labs FROM line_tags)",
        "rows_ AS (SELECT row_id, list_distinct(codes) AS labs FROM line_tags JOIN meta USING (row_id))")) + (
        "SELECT s.row_id, s.split, m.FundingOrganisation FROM split s JOIN meta m USING (row_id)")
    q["class_weights"] = T + ("SELECT label, count, round(sum(count) OVER () / count, 9) AS weight FROM "
                              "(SELECT label, count(*) AS count FROM tag_long GROUP BY label)")
    classes = sorted(f"{p}.{s}" for p in range(1, 9) for s in range(1, 6))
    onehot = ", ".join(f"CAST(list_contains(codes, {lit(c)}) AS INTEGER) AS \"{c}\"" for c in classes)
    q["binarise_labels"] = L + f"SELECT row_id, {onehot} FROM line_tags"
    places = "(SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT unnest(codes) AS label FROM line_tags))"
    q["sparse_indicators"] = L + (
        f"SELECT row_id, (SELECT count(*) FROM {places}) AS n_classes, string_agg(CAST(idx AS VARCHAR), '|' ORDER BY idx) AS indices "
        f"FROM (SELECT DISTINCT row_id, idx FROM (SELECT row_id, unnest(codes) AS label FROM line_tags) JOIN {places} USING (label)) "
        "GROUP BY row_id")
    q["downsample_tag"] = L + (
        "SELECT row_id FROM line_tags WHERE NOT coalesce(codes = ['4.2'], FALSE) UNION ALL "
        "SELECT row_id FROM (SELECT row_id FROM line_tags WHERE codes = ['4.2'] "
        "ORDER BY md5(CAST(row_id AS VARCHAR) || '|2'), row_id LIMIT 10)")

    S = with_(SCORES, SCORES_LONG)
    q["sigmoid_scores"] = S + "SELECT row_id, label_idx, round(score, 6) AS score FROM scores_long"
    q["rank_scores"] = with_(SCORES, SCORES_LONG.replace(
        "1.0 / (1.0 + exp(-logits[i]))", "round(1.0 / (1.0 + exp(-logits[i])), 1)")) + (
        "SELECT row_id, label_idx, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label_idx DESC) AS INTEGER) AS rank, "
        "round(score, 6) AS score FROM scores_long")
    RT = with_(SCORES, SCORES_LONG, _rank_threshold(False))
    q["rank_threshold_tags"] = RT + ("SELECT row_id, array_to_string(tags, '|') AS tags, "
                                     "CAST(len(tags) AS INTEGER) AS n_tags FROM tagged")
    q["tags_per_row_hist"] = RT + ("SELECT CAST(len(tags) AS INTEGER) AS n_tags, count(*) AS n_rows FROM tagged "
                                   "GROUP BY ALL")
    q["flat_threshold_tags"] = S + ("SELECT row_id, array_to_string(coalesce(list(label_idx ORDER BY label_idx) "
                                    "FILTER (WHERE score > 0.5), []), '|') AS tags FROM scores_long GROUP BY row_id")
    names = lst(LABELS_LONG)
    q["infer_tags"] = with_(SCORES, SCORES_LONG, _rank_threshold(True).replace(
        "list(r.label_idx ORDER BY r.label_idx)", "list(r.label_idx ORDER BY r.label_idx)")) + (
        f"SELECT t.row_id, array_to_string(list_transform(t.tags, lambda i: {names}[i + 1]), '|') AS labels, "
        f"round(coalesce((SELECT sum(score) FROM scores_long s WHERE s.row_id = t.row_id AND list_contains(t.tags, s.label_idx)), 0.0), 6) AS score_sum "
        f"FROM tagged t")

    ev_ctes = [TAG_LONG, TRUTH, PRED, META]
    q["rollup_parent"] = with_(*ev_ctes, rolled(("parent",), False)) + (
        "SELECT row_id, key AS parent, t, p FROM rolled")
    q["rollup_super"] = with_(*ev_ctes, rolled(("super",), False)) + (
        "SELECT row_id, key AS super_parent, t, p FROM rolled")
    full = with_(*ev_ctes, rolled(), per_label_sql(("all", "sub")))
    short_names = lst(LABELS_SHORT)
    tiny_names = lst(LABELS_TINY)
    q["metrics_per_label"] = with_(*ev_ctes, LABEL_DIM, rolled(), per_label_sql(("all", "sub"))) + (
        "SELECT p.scope, p.level, p.key, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, "
        "CAST(support AS BIGINT) AS support, round(precision, 9) AS precision, round(recall, 9) AS recall, "
        "round(f1, 9) AS f1, "
        f"CASE p.level WHEN 'detail' THEN d.name WHEN 'parent' THEN {short_names}[TRY_CAST(p.key AS INTEGER)] "
        f"ELSE {tiny_names}[TRY_CAST(p.key AS INTEGER)] END AS name "
        "FROM per2 p LEFT JOIN label_dim d ON p.level = 'detail' AND d.code = p.key")
    q["metrics_suite"] = full + SUMMARY + " GROUP BY scope, level"
    q["metrics_summary"] = with_(*ev_ctes, rolled(("detail", "parent", "super"), False),
                                 per_label_sql(("all",))) + SUMMARY + " WHERE level = 'detail' GROUP BY scope, level"
    q["metrics_subgroup"] = with_(*ev_ctes) + (
        "SELECT CASE WHEN n_unmatched > 0 THEN 'unmatched_rows' WHEN n_subgroup = 0 THEN 'no_subgroup_rows' "
        "ELSE 'computed' END AS status, n_rows, n_unmatched, n_subgroup FROM ("
        "SELECT count(*) AS n_rows, CAST(sum(CASE WHEN m.row_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unmatched, "
        f"CAST(sum(CASE WHEN m.FundingOrganisation = {lit(SUBGROUP_FUNDER)} THEN 1 ELSE 0 END) AS BIGINT) AS n_subgroup "
        "FROM (SELECT row_id FROM truth UNION SELECT row_id FROM pred) r LEFT JOIN meta m USING (row_id))")
    codes = lst([n.split(":")[0] for n in LABELS_LONG])
    eval_truth = (f"truth AS (SELECT vec_id AS row_id, {codes}[i + 1] AS label FROM ("
                  f"SELECT vec_id, label AS i FROM embeddings UNION ALL "
                  f"SELECT vec_id, label + 10 FROM embeddings WHERE embedding[49] > 0))")
    eval_pred = f"pred AS (SELECT row_id, {codes}[i + 1] AS label FROM (SELECT row_id, unnest(tags) AS i FROM tagged))"
    all_codes = f"SELECT unnest({codes}) AS key"
    q["evaluate"] = with_(SCORES, SCORES_LONG, META, _rank_threshold(False), eval_truth, eval_pred, rolled(),
                          per_label_sql(("all", "sub"), classes=all_codes)) + SUMMARY + " GROUP BY scope, level"
    flat = "tagged AS (SELECT row_id, list(label_idx) FILTER (WHERE score > 0.5) AS tags FROM scores_long GROUP BY row_id)"
    q["evaluate_flat"] = with_(SCORES, SCORES_LONG, flat, eval_truth, eval_pred, rolled(with_meta=False),
                               per_label_sql(("all",), classes=all_codes)) + SUMMARY + " GROUP BY scope, level"

    top_b = (f"list_sort(list_distinct(list_transform(list_filter(t.codes, lambda x: {_ws_nonblank('x')}), "
             f"lambda x: substring(x, 1, 1))))")
    base = (f"base AS (SELECT t.row_id, r.FundingOrganisation, r.AllText, t.codes AS RA, "
            f"{top_b} AS RA_top, {normalise('t.hcs')} AS HC FROM {processed()} r JOIN line_tags t ON r.doc_id = t.row_id)")
    cats = ["RA", "RA_top", "HC"]
    ctes = [RECORDS, LINE_TAGS, base] + [
        _split_ctes(c.lower(), f"SELECT row_id, list_distinct({c}) AS labs FROM base WHERE {c} IS NOT NULL")
        for c in cats]
    q["split_categories"] = with_(*ctes) + " UNION ALL ".join(
        f"SELECT {lit(c.lower())} AS category, s.split, b.row_id, b.FundingOrganisation, lower(b.AllText) AS text, "
        f"array_to_string(b.{c}, '|') AS labels FROM base b JOIN {c.lower()}_split s USING (row_id)"
        for c in cats)

    q["split_write"] = q["split_categories"]
    hot = ", ".join(f"CAST(list_contains(b.RA, {lit(c)}) AS INTEGER) AS \"{c}\"" for c in classes)
    q["split_export"] = with_(RECORDS, LINE_TAGS, base, ctes[3]) + (
        f"SELECT row_id, {hot}, lower(b.AllText) AS text, s.split, b.FundingOrganisation FROM base b JOIN ra_split s USING (row_id)")
    q["latest_per_key"] = RL + (
        "SELECT FundingOrganisation, OrganisationReference, year, sheet_row FROM ("
        f"SELECT * FROM {survey_year(2014)} UNION ALL BY NAME SELECT * FROM {survey_year(2018)} "
        f"UNION ALL BY NAME SELECT * FROM {survey_year(2022)}) "
        "QUALIFY row_number() OVER (PARTITION BY FundingOrganisation, OrganisationReference "
        "ORDER BY year DESC, sheet_row DESC) = 1")

    q["near_dup_pairs"] = with_(_exact_pairs()) + "SELECT a, b, round(jaccard, 9) AS jaccard FROM pairs"
    # The sequential walk itself: visit nodes with edges in id order, keep a
    # node unless an already kept node is its neighbour.
    walk = walk_sql([], None, "SELECT doc_id FROM survivors")
    q["near_dup_keep"] = walk
    q["dedup_full"] = walk
    pre = f"pc AS (SELECT *, {INDEX} AS idx FROM combined)"
    proc = f"proc AS (SELECT * FROM {processed('pc')})"
    dt = ("dtexts AS (SELECT idx AS doc_id, AllText AS text, FundingOrganisation, RA, HC FROM proc "
          "QUALIFY row_number() OVER (PARTITION BY md5(lower(AllText)) ORDER BY idx DESC) = 1)")
    q["build_clean"] = walk_sql(
        [RECORDS, LINE_TAGS, SURVEY, RAW2, SECOND, COMBINED, pre, proc], dt,
        f"SELECT doc_id AS \"index\", FundingOrganisation, text AS AllText, {j('RA')} AS RA, "
        f"{j(normalise('HC'))} AS HC FROM survivors")
    return q


ORACLE = build()
