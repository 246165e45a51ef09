"""DuckDB SQL of the feature queries, written as joins and groups rather than as array expressions."""

from ..params import DEGREE_SCORES
from .fixtures import SQL as FIXTURES

KEY = "trim(lower(translate({}, '.-''', '')))"


def key(c: str) -> str:
    return KEY.format(c)


TARGET = FIXTURES + rf""",
pairs AS (
  SELECT c.person_id, c.pmid, a.idx, {key('c.first_name')} AS pf, {key('c.last_name')} AS pl, {key('c.middle_name')} AS pm,
         lower(c.first_name[1]) AS fi, lower(c.middle_name[1]) AS mi, lower(c.last_name[1]) AS li,
         lower(c.primary_email) AS email, lower(split_part(c.primary_email, '@', 1)) AS usr,
         {key('a.first_name')} AS af, {key('a.last_name')} AS al, lower(a.affiliation) AS aff,
         CASE WHEN length(a.initials) > 1 THEN lower(a.initials[2]) ELSE '' END AS ami,
         lower(CASE WHEN a.first_name <> '' THEN a.first_name[1] ELSE a.initials[1] END) AS afi, lower(a.first_name[1]) AS agi, lower(a.last_name[1]) AS ali
  FROM cand c JOIN author a USING (pmid)),
pts AS (
  SELECT *, (CASE WHEN length(af) > 1 AND af = pf THEN 3 WHEN agi = fi THEN 1 ELSE 0 END)
          + (CASE WHEN pm = '' THEN 0 WHEN length(ami) > 1 AND ami = pm THEN 2 WHEN ami <> '' AND ami[1] = pm[1] THEN 1 ELSE 0 END) AS s,
         al = pl AND af = pf AS m3, al = pl AND afi = fi AND fi <> '' AS m6
  FROM pairs),
top AS (
  SELECT *, max(s) FILTER (WHERE m3) OVER w AS t3, max(s) FILTER (WHERE m6) OVER w AS t6 FROM pts WINDOW w AS (PARTITION BY person_id, pmid)),
rules AS (
  SELECT person_id, pmid, idx, unnest([
    (2, mi <> '' AND al = pl AND af = pf AND ami = mi),
    (4, length(pf) > 1 AND al = pl AND starts_with(pf, af) AND length(af) > 1),
    (5, length(pf) > 1 AND al = pl AND af <> '' AND starts_with(af, pf)),
    (8, fi <> '' AND mi <> '' AND al = pl AND afi = mi AND ami = fi),
    (9, fi <> '' AND length(pl) > 2 AND contains(al, pl) AND afi = fi),
    (10, al = pl),
    (11, length(pf) > 1 AND af = pf),
    (12, length(pl) > 3 AND length(al) > 1 AND contains(pl, al)),
    (13, length(pf) > 1 AND af = pf AND ali = li),
    (14, length(pm) > 1 AND al = pm AND afi = fi),
    (15, length(pf) > 1 AND length(pl) > 1 AND af = pl AND al = pf),
    (16, length(pl) > 1 AND length(af) > 1 AND af = pl AND ali = fi),
    (18, fi <> '' AND afi = fi AND ali = li),
    (19, length(pl) >= 4 AND length(al) >= 4 AND levenshtein(al, pl) BETWEEN 1 AND 2 AND (afi = fi OR (length(af) > 1 AND af = pf)))]) AS x
  FROM pairs),
hits AS (
  SELECT person_id, pmid, x[1] AS step, min(idx) AS idx FROM rules WHERE x[2] GROUP BY person_id, pmid, x[1] HAVING count(*) = 1
  UNION ALL SELECT person_id, pmid, 3, CASE WHEN count(*) = 1 THEN min(idx) ELSE min(idx) FILTER (WHERE s = t3) END FROM top WHERE m3
    GROUP BY person_id, pmid HAVING count(*) = 1 OR (max(t3) > 0 AND count(*) FILTER (WHERE s = t3) = 1)
  UNION ALL SELECT person_id, pmid, 6, CASE WHEN count(*) = 1 THEN min(idx) ELSE min(idx) FILTER (WHERE s = t6) END FROM top WHERE m6
    GROUP BY person_id, pmid HAVING count(*) = 1 OR (max(t6) > 0 AND count(*) FILTER (WHERE s = t6) = 1)
  UNION ALL SELECT person_id, pmid, 7, min(idx) FROM pairs WHERE email <> '' AND aff <> '' AND (contains(aff, email) OR (usr <> '' AND contains(aff, usr))) GROUP BY person_id, pmid),
found AS (SELECT person_id, pmid, arg_min(idx, step) AS idx FROM hits GROUP BY person_id, pmid),
tgt AS (SELECT c.*, coalesce(f.idx, -1)::INT AS target_author_index FROM cand c LEFT JOIN found f USING (person_id, pmid)),
ct AS (
  SELECT t.*, a.first_name AS t_first, a.last_name AS t_last, a.initials AS t_initials, a.affiliation AS t_aff, a.orcid AS t_orcid
  FROM tgt t LEFT JOIN author a ON a.pmid = t.pmid AND a.idx = t.target_author_index)
"""

SKEY = "trim(lower(translate({}, '-.''', ' ')))"


def skey(c: str) -> str:
    return SKEY.format(c)


NAMES = TARGET + rf""",
nk AS (
  SELECT *, {skey('first_name')} AS f, {skey('last_name')} AS l, {skey('middle_name')} AS m, {skey("coalesce(t_first, '')")} AS af,
         {skey("coalesce(t_last, '')")} AS al, lower(substr(coalesce(t_initials, ''), 2)) AS am, t_first IS NULL AS none FROM ct),
nt AS (
  SELECT *, CASE WHEN none THEN 'no_target' WHEN af = '' OR f = '' THEN 'missing' WHEN f = af THEN 'exact'
    WHEN length(af) = 1 OR length(f) = 1 THEN CASE WHEN f[1] = af[1] THEN 'initial' ELSE 'conflict' END
    WHEN length(f) >= 4 AND length(af) >= 4 AND levenshtein(f, af) = 1 THEN 'fuzzy'
    WHEN length(f) >= 3 AND length(af) >= 3 AND f[1:3] = af[1:3] THEN 'fuzzy' WHEN f[1] = af[1] THEN 'same_initial' ELSE 'conflict' END AS kind FROM nk),
names AS (
  SELECT *, CASE kind WHEN 'exact' THEN 1.852 WHEN 'initial' THEN 0.441 WHEN 'fuzzy' THEN -0.75 WHEN 'missing' THEN -1.941
      WHEN 'same_initial' THEN -2.646 WHEN 'conflict' THEN -3.087 ELSE -1.323 END::DOUBLE AS nameMatchFirstScore,
    CASE WHEN none OR al = '' OR l = '' THEN -0.996 WHEN l = al THEN 0.664 WHEN length(l) >= 4 AND length(al) >= 4 AND levenshtein(l, al) <= 1 THEN 0.332 ELSE -0.996 END::DOUBLE AS nameMatchLastScore,
    CASE WHEN none THEN -1.588 WHEN m = '' THEN 0.794 WHEN am = '' THEN -0.794 WHEN m = am THEN CASE WHEN length(m) = 1 THEN 1.191 ELSE 1.588 END
      WHEN (length(am) = 1 OR length(m) = 1) AND am[1] = m[1] THEN 0.794 WHEN length(m) >= 4 AND length(am) >= 4 AND levenshtein(m, am) <= 1 THEN 0 ELSE -1.588 END::DOUBLE AS nameMatchMiddleScore,
    CASE WHEN none THEN 0 ELSE
      (CASE WHEN replace(f || l, ' ', '') <> '' AND replace(f || l, ' ', '') = replace(af || al, ' ', '') THEN 0.451 ELSE 0 END)
      + (CASE WHEN length(f) > 1 AND length(l) > 1 AND af = l AND al = f THEN -0.804 ELSE 0 END)
      + (CASE WHEN length(f) > 1 AND length(af) > length(f) AND starts_with(af, f) THEN -1.608 ELSE 0 END)
      + (CASE WHEN length(l) > 1 AND length(al) > length(l) AND contains(al, l) THEN -1.608 ELSE 0 END)
      + (CASE WHEN length(al) > 1 AND length(l) > length(al) AND contains(l, al) THEN -0.804 ELSE 0 END)
      + (CASE WHEN m <> '' AND length(f) > 1 AND contains(af, {skey('first_name || middle_name')}) THEN 0.804 ELSE 0 END) END::DOUBLE AS nameMatchModifierScore
  FROM nt)
"""

DEGREE = " ".join(f"WHEN {d} THEN {s}" for d, s in enumerate(DEGREE_SCORES, -99))

EVIDENCE = NAMES + rf""",
ev AS (
  SELECT *,
    CASE WHEN primary_email = '' OR coalesce(t_aff, '') = '' THEN 0 WHEN contains(lower(t_aff), lower(primary_email)) OR contains(lower(t_aff), lower(split_part(primary_email, '@', 1))) THEN 8 ELSE -1 END::DOUBLE AS emailMatchScore,
    CASE WHEN coalesce(t_aff, '') = '' THEN 0
         WHEN list_aggregate([contains(lower(t_aff), w) FOR w IN string_split(lower(primary_institution), ' ') IF length(w) > 2 OR NOT contains(primary_institution, ' ')], 'bool_and') THEN 1.0 ELSE -0.8 END::DOUBLE AS affil,
    CASE WHEN lower(department) = 'medicine' OR coalesce(t_aff, '') = '' THEN 0 WHEN contains(lower(t_aff), lower(department)) THEN 0.6 ELSE 0 END::DOUBLE AS organizationalUnitMatchingScore,
    CASE WHEN doctoral_year > 0 THEN pub_year - doctoral_year WHEN bachelor_year > 0 THEN pub_year - bachelor_year + 7 END AS gap,
    count(*) OVER (PARTITION BY person_id) AS n_candidates
  FROM names),
base AS (
  SELECT *, affil AS pubmedTargetAuthorInstitutionalAffiliationMatchTypeScore, affil AS targetAuthorInstitutionalAffiliationMatchTypeScore,
    CASE WHEN gap IS NULL THEN 0 ELSE CASE greatest(-99, least(100, gap)) {DEGREE} END END::DOUBLE AS discrepancyDegreeYearScore,
    (800 / 583.9::DOUBLE) * (1 - n_candidates / 800::DOUBLE) AS articleCountScore,
    CASE WHEN n_authors > 0 THEN -0.2461 * ln(n_authors::DOUBLE) + 1.98 ELSE 0 END::DOUBLE AS authorCountScore
  FROM ev)
"""

FACTS = TARGET + r""",
oth AS (SELECT t.person_id, t.pmid, t.assertion, a.* EXCLUDE (pmid) FROM tgt t JOIN author a ON a.pmid = t.pmid AND a.idx <> t.target_author_index),
facts AS (
  SELECT person_id, pmid, assertion, 'TargetAuthorName' AS dim, lower(t_first || ' ' || t_last) AS value FROM ct WHERE t_first <> '' AND t_last <> ''
  UNION ALL SELECT person_id, pmid, assertion, 'CoAuthorName', lower(first_name || ' ' || last_name) FROM oth WHERE length(first_name) > 1 AND last_name <> ''
  UNION ALL SELECT person_id, pmid, assertion, 'Email', lower(regexp_extract(t_aff, '[\p{L}\p{N}_.+-]+@([\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+)', 1)) FROM ct
  UNION ALL SELECT person_id, pmid, assertion, 'Journal', lower(journal) FROM ct
  UNION ALL SELECT person_id, pmid, assertion, 'Keyword', k FROM (SELECT DISTINCT t.person_id, t.pmid, t.assertion, lower(a.keyword) AS k FROM tgt t JOIN author a USING (pmid))
  UNION ALL SELECT person_id, pmid, assertion, 'Institution', lower(t_aff) FROM ct
  UNION ALL SELECT person_id, pmid, assertion, 'Organization', lower(department) FROM ct WHERE contains(lower(t_aff), lower(department))
  UNION ALL SELECT person_id, pmid, assertion, 'Orcid', t_orcid FROM ct
  UNION ALL SELECT person_id, pmid, assertion, 'OrcidCoAuthor', orcid FROM oth
  UNION ALL SELECT person_id, pmid, assertion, 'Year', pub_year::VARCHAR FROM ct WHERE pub_year > 0),
f AS (SELECT person_id, pmid, assertion, dim, value, count(*) AS mult FROM facts WHERE value IS NOT NULL AND value <> '' GROUP BY ALL),
peers AS (
  SELECT x.person_id, x.pmid, x.assertion, x.dim, x.value, x.mult,
         count(*) FILTER (WHERE y.assertion = 'ACCEPTED') AS a, count(*) FILTER (WHERE y.assertion = 'REJECTED') AS r
  FROM f x LEFT JOIN f y ON y.person_id = x.person_id AND y.dim = x.dim AND y.value = x.value AND y.pmid <> x.pmid
  GROUP BY ALL),
loo AS (
  SELECT *, a > 0 OR r > 0 AS hit, a - (CASE WHEN assertion = 'ACCEPTED' AND a > 0 THEN 1 ELSE 0 END) AS a1, r - (CASE WHEN assertion = 'REJECTED' AND r > 0 THEN 1 ELSE 0 END) AS r1 FROM peers),
item AS (SELECT *, CASE WHEN hit AND a1 + r1 > 0 THEN mult * (1 / (1 + exp(-(a1 - r1) / (sqrt(a1 + r1) + 1))) - 0.5) ELSE 0 END AS s FROM loo),
total AS (SELECT person_id, count(*) FILTER (WHERE assertion = 'ACCEPTED') AS ta, count(*) FILTER (WHERE assertion = 'REJECTED') AS tr FROM cand GROUP BY person_id),
strength(dim, k) AS (VALUES ('TargetAuthorName', 1.0), ('CoAuthorName', 0.9), ('Email', 0.3), ('Journal', 0.7), ('Keyword', 0.9), ('Institution', 0.5), ('Organization', 0.5), ('Orcid', 0.3), ('OrcidCoAuthor', 0.0), ('Year', 0.0)),
per AS (
  SELECT person_id, pmid, dim, CASE WHEN NOT bool_or(hit) THEN CASE WHEN any_value(ta) > 0 THEN -any_value(k)::DOUBLE * (1 / (1 + exp(-any_value(ta) / 10.0::DOUBLE)) - 0.5) ELSE 0 END
    WHEN dim = 'CoAuthorName' THEN sum(s) / sum(mult) ELSE sum(s) END AS v
  FROM item JOIN total USING (person_id) JOIN strength USING (dim) WHERE ta + tr > 0 GROUP BY person_id, pmid, dim),
fb AS (
  SELECT c.person_id, c.pmid, t.ta, t.tr,""" + ",".join(
    f"\n    coalesce(max(v) FILTER (WHERE dim = '{d}'), 0)::DOUBLE AS feedbackScore{d}"
    for d in ("TargetAuthorName", "CoAuthorName", "Email", "Journal", "JournalSubField", "Keyword", "Institution", "Organization", "Orcid", "OrcidCoAuthor", "Cites", "Year")
) + """
  FROM cand c JOIN total t USING (person_id) LEFT JOIN per p ON p.person_id = c.person_id AND p.pmid = c.pmid GROUP BY ALL)
"""
