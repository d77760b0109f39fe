"""SQL statements the catalogue's queries are held against, written independently of the operators."""

from __future__ import annotations

EV = """ev AS (
  SELECT o_custkey AS entity, o_orderkey AS experience, l_linenumber AS seq, p_name AS skill, p_type AS category, o_orderdate::date AS start_date,
         CASE WHEN l_linestatus <> 'O' THEN o_orderdate::date + (l_quantity * 10)::int END AS end_date, 1 - l_discount AS confidence, l_returnflag AS source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def ledger_of(ev: str, name: str, as_of: str) -> str:
    """CTEs <name>_isl and <name> of a ledger over the evidence table ``ev``."""
    return f"""
{name}_r AS (SELECT entity, skill, start_date, coalesce(end_date, DATE '{as_of}') AS stop FROM {ev} WHERE start_date IS NOT NULL),
{name}_f AS (SELECT *, max(stop) OVER (PARTITION BY entity, skill ORDER BY start_date, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {name}_r),
{name}_g AS (SELECT *, sum(CASE WHEN p IS NULL OR start_date > p THEN 1 ELSE 0 END) OVER (PARTITION BY entity, skill ORDER BY start_date, stop ROWS UNBOUNDED PRECEDING) AS island FROM {name}_f),
{name}_isl AS (SELECT entity, skill, count(*) AS islands, sum(days) AS days FROM (SELECT entity, skill, island, date_diff('day', min(start_date), max(stop)) AS days FROM {name}_g GROUP BY ALL) GROUP BY ALL),
{name}_last AS (SELECT entity, skill, end_date AS last_seen FROM (SELECT *, row_number() OVER (PARTITION BY entity, skill ORDER BY start_date DESC, experience DESC, seq DESC, end_date DESC NULLS LAST) AS rn FROM {ev}) WHERE rn = 1),
{name}_agg AS (SELECT entity, skill, count(*) AS evidence_count, min(start_date) AS first_seen, bool_or(end_date IS NULL) AS is_current, count(DISTINCT coalesce(experience, -1)) AS role_count,
  max(confidence) AS max_confidence, min(category) AS category, bool_and(source = 'N') AND count(*) = 1 AS unsubstantiated FROM {ev} GROUP BY ALL),
{name} AS (SELECT a.*, l.last_seen, coalesce(i.days, 0) / 365.25 AS years,
  0.3 * least(coalesce(i.days, 0) / 365.25 / 10, 1.0) + 0.25 * least(a.role_count / 5.0, 1.0) + 0.25 * (CASE WHEN is_current THEN 1.0 WHEN last_seen IS NULL THEN 0.3 ELSE greatest(0.0, 1 - date_diff('day', last_seen, DATE '{as_of}') / 1825.0) END) + 0.2 * max_confidence AS strength
  FROM {name}_agg a LEFT JOIN {name}_isl i USING (entity, skill) LEFT JOIN {name}_last l USING (entity, skill))"""


LED = f"{EV}, {ledger_of('ev', 'led', '2002-01-01')}"
NOUN = "string_split(p_name, ' ')[-1]"
REQ = f"""req AS (SELECT l_suppkey AS spec, CASE l_suppkey % 4 WHEN 0 THEN upper({NOUN}) WHEN 1 THEN {NOUN} || ' assembly' WHEN 2 THEN 'Red ' || upper({NOUN}) || ' design' ELSE reverse({NOUN}) END AS term,
  min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS importance FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
ACH = """ach AS (SELECT o_custkey AS entity, o_orderkey * 10 + l_linenumber AS seq, p_name || CASE WHEN p_size > 40 THEN ' Assembly line' WHEN p_size % 7 = 0 THEN ' design' ELSE ' job' END AS text
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
# The rule itself: either string inside the other, or the same canonical name; the strongest entry; else two words of the term, or its only one, in a text.
MATCH = f"""{LED}, {REQ}, {ACH},
syn AS (SELECT DISTINCT reverse({NOUN}) AS alias, 'red ' || {NOUN} AS canonical FROM part),
sk AS (SELECT DISTINCT skill FROM led), tm AS (SELECT DISTINCT term FROM req),
voc AS (SELECT skill, term, min(tier) AS tier FROM (
  SELECT skill, term, 1 AS tier FROM sk, tm WHERE contains(lower(skill), lower(term)) OR contains(lower(term), lower(skill))
  UNION ALL SELECT skill, term, 2 FROM sk, tm LEFT JOIN syn x ON x.alias = lower(skill) LEFT JOIN syn y ON y.alias = lower(term) WHERE lower(coalesce(x.canonical, skill)) = lower(coalesce(y.canonical, term))) GROUP BY ALL),
found AS (SELECT entity, term, skill, strength, CASE tier WHEN 1 THEN 0.85 ELSE 0.82 END AS similarity FROM (
  SELECT entity, term, skill, strength, tier, row_number() OVER (PARTITION BY entity, term ORDER BY round(strength, 6) DESC, skill, tier) AS rn FROM led JOIN voc USING (skill)) WHERE rn = 1),
tw AS (SELECT term, list_filter(string_split(lower(term), ' '), lambda w: length(w) > 3 AND w NOT IN ('with', 'and', 'the', 'for', 'using', 'experience', 'knowledge', 'skills', 'ability', 'years')) AS ws FROM tm),
fb AS (SELECT term, text FROM tw, (SELECT DISTINCT text FROM ach) WHERE len(list_filter(ws, lambda w: contains(lower(text), w))) >= 2 OR (len(ws) = 1 AND contains(lower(text), ws[1]))),
best AS (SELECT * FROM found UNION ALL SELECT entity, term, '(evidence)', (SELECT max(strength) FROM led WHERE led.entity = e.entity), 0.65 FROM (
  SELECT DISTINCT entity, term FROM ach JOIN fb USING (text) WHERE (entity, term) NOT IN (SELECT (entity, term) FROM found)) e),
m AS (SELECT b.entity, r.spec, r.term, r.importance, b.skill, b.strength, b.similarity FROM req r JOIN best b ON b.term = r.term)"""
CLASSES = """sp AS (SELECT spec, min(spec) OVER (PARTITION BY terms) AS terms_id, min(spec) OVER (PARTITION BY needs) AS spec_class, count(*) OVER (PARTITION BY needs) AS n_specs FROM (
  SELECT spec, list(term ORDER BY term) AS terms, list(term || importance ORDER BY term) AS needs FROM req GROUP BY ALL)),
need AS (SELECT spec, count(*) FILTER (importance = 0) AS n_required, count(*) FILTER (importance = 1) AS n_preferred, count(*) AS n_terms FROM req GROUP BY ALL),
got AS (SELECT entity, spec, list(term ORDER BY term) AS have, count(*) FILTER (importance = 0) AS got_required, count(*) FILTER (importance = 1) AS got_preferred, count(*) AS matched, avg(strength) AS mean_strength FROM m GROUP BY ALL),
cov AS (SELECT *, 0.7 * required_coverage + 0.3 * preferred_coverage AS fit FROM (SELECT got.*, n_terms, CASE WHEN n_required = 0 THEN 1.0 ELSE got_required / n_required END AS required_coverage,
  CASE WHEN n_preferred = 0 THEN 0.0 ELSE got_preferred / n_preferred END AS preferred_coverage FROM got JOIN need USING (spec))),
pair AS (SELECT terms_id, spec_class, n_specs, have, min(entity) AS entity_class, count(*) AS n_entities, any_value(got_required) AS got_required, any_value(got_preferred) AS got_preferred, any_value(matched) AS matched, any_value(n_terms) AS n_terms,
  any_value(required_coverage) AS required_coverage, any_value(preferred_coverage) AS preferred_coverage, any_value(fit) AS fit, avg(mean_strength) AS mean_strength FROM cov JOIN sp USING (spec) WHERE spec = spec_class GROUP BY ALL)"""
COV = f"{MATCH}, {CLASSES}"
COVERED = f"""{REQ}, {ACH}, best AS (SELECT entity, term, seq, text, 1.0 AS strength FROM (SELECT entity, term, seq, text, row_number() OVER (PARTITION BY entity, term ORDER BY seq, text) AS rn
  FROM ach JOIN (SELECT DISTINCT term FROM req) ON contains(lower(text), lower(term))) WHERE rn = 1), m AS (SELECT b.entity, r.spec, r.term, r.importance, b.strength FROM req r JOIN best b ON b.term = r.term), {CLASSES}"""
GAPS = f"""{MATCH}, {CLASSES}, home AS (SELECT term, category FROM (SELECT DISTINCT term FROM req) JOIN (SELECT {NOUN} AS noun, min(p_type) AS category FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) ON contains(lower(term), noun)),
near AS (SELECT DISTINCT entity, term FROM ev JOIN home USING (category)),
p AS (SELECT DISTINCT entity, spec FROM m), a AS (SELECT p.entity, r.spec, r.term, r.importance, round(m.strength, 6) AS strength, near.term IS NOT NULL AS near FROM p JOIN req r ON r.spec = p.spec
  LEFT JOIN m ON m.entity = p.entity AND m.spec = r.spec AND m.term = r.term LEFT JOIN near ON near.entity = p.entity AND near.term = r.term),
g AS (SELECT *, CASE WHEN strength >= 0.4 THEN 'none' WHEN strength IS NOT NULL THEN 'weak' WHEN near THEN 'adjacent' ELSE 'true' END AS gap FROM a)"""
JOB = """job AS (SELECT o_orderkey AS job_id, c_mktsegment || ' ' || n_name AS company, n_name AS location, o_orderpriority AS title, o_totalprice AS salary,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS is_remote, o_orderdate::date AS created, o_custkey AS source_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
APP = """app_ev AS (SELECT user_id || '-' || ts::date AS application, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 WHEN 'error' THEN 6 END AS to_stage FROM events),
app AS (SELECT application, list_reduce(list(to_stage ORDER BY ts, seq), lambda s, x: CASE WHEN s IN (5, 6, 7, 8) OR x = 5 OR x <= s THEN s ELSE x END, 0) AS stage,
  min(ts) FILTER (to_stage >= 1) AS applied_at, max(ts) AS last_activity, count(*) AS n_events FROM app_ev GROUP BY ALL)"""
VOTE = """vote AS (SELECT user_id AS profile, list_reduce(list(CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE -1 END ORDER BY ts, event_id), lambda s, x: greatest(-5, least(5, s + x)), 0) AS score FROM events WHERE event_type <> 'view' GROUP BY ALL)"""
EDGE = """it AS (SELECT DISTINCT l_orderkey AS g, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
edge AS (SELECT a.item AS src, b.item AS dst, count(*) AS weight FROM it a JOIN it b ON a.g = b.g AND a.item < b.item GROUP BY ALL),
member AS (SELECT p_name AS node, min(p_type) AS community FROM part GROUP BY ALL),
both_ways AS (SELECT src, dst, weight FROM edge UNION ALL SELECT dst, src, weight FROM edge),
deg AS (SELECT src AS node, sum(weight)::bigint AS degree FROM both_ways GROUP BY ALL)"""
T = "coalesce(text, '')"
VEC = "vec AS (SELECT vec_id AS id, embedding::double[] AS v, label AS g FROM embeddings)"
QV = "[" + ", ".join(str((-1.0) ** i * (1 + i % 3) / 10) for i in range(64)) + "]::double[]"
BAND = "CASE WHEN salary < 40000 THEN '<40k' WHEN salary < 60000 THEN '40-60k' WHEN salary < 80000 THEN '60-80k' WHEN salary < 100000 THEN '80-100k' ELSE '100k+' END"
NTITLE = r"regexp_replace(trim(regexp_replace(lower({}), '\b(senior|junior|lead|principal|staff|mid|associate)\b', '', 'g')), '\s{{2,}}', ' ', 'g')"
CLASS = [("Legal", "license", "copyright"), ("Tabular", " | "), ("Noisy", "###", "$$$"), ("French", " les ", " des "), ("German", " und ", " der ")]


def _has(x: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in marks) + ")"


def sql() -> dict[str, str]:
    low = f"lower({T})"
    q: dict[str, str] = {}
    q["ledger_entries"] = f"WITH {LED} SELECT entity, skill, evidence_count, first_seen::varchar AS first_seen, last_seen::varchar AS last_seen, is_current, role_count, round(max_confidence, 6) AS max_confidence, round(years, 6) AS years, round(strength, 6) AS strength FROM led"
    q["interval_union_years"] = f"WITH {LED} SELECT entity, skill, islands, days::bigint AS days FROM led_isl"
    q["ledger_strong_weak"] = f"WITH {LED} SELECT category, CASE WHEN round(strength, 6) > 0.5 THEN 'strong' WHEN round(strength, 6) > 0.1 THEN 'weak' ELSE 'trace' END AS level, count(*) AS n FROM led GROUP BY ALL"
    q["ledger_unsubstantiated"] = f"WITH {LED} SELECT entity, skill, evidence_count FROM led WHERE unsubstantiated"
    q["ledger_stale_issues"] = f"WITH {LED} SELECT entity, skill, last_seen::varchar AS last_seen FROM led WHERE NOT is_current AND date_diff('day', last_seen, DATE '2002-01-01') > 1825"
    q["ledger_merge_compound"] = f"""WITH {EV}, u AS (SELECT * FROM ev WHERE experience % 2 = 0 UNION ALL SELECT * FROM ev WHERE experience % 2 = 1 OR experience % 4 = 0),
      x AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY entity, skill, experience, start_date ORDER BY seq, confidence, end_date NULLS FIRST, source, category) AS rn FROM u) WHERE rn = 1),
      {ledger_of('x', 'led', '2002-01-01')} SELECT entity, skill, evidence_count, role_count, round(years, 6) AS years, round(max_confidence, 6) AS max_confidence FROM led"""
    q["ledger_overrides"] = f"""WITH {EV}, x AS (SELECT CASE skill WHEN 'small widget' THEN 'red widget' ELSE skill END AS skill, confidence FROM ev WHERE skill NOT IN ('red gear', 'hot gear')
      UNION ALL SELECT 'manual skill', 1.0 FROM ev WHERE seq = 1) SELECT skill, count(*) AS n, round(sum(confidence), 4) AS confidence FROM x GROUP BY ALL"""
    q["ledger_drift"] = f"""WITH {EV}, o AS (SELECT * FROM ev WHERE start_date < DATE '1999-01-01'), n AS (SELECT * FROM ev WHERE start_date >= DATE '1997-01-01'), {ledger_of('o', 'a', '1999-01-01')}, {ledger_of('n', 'b', '2002-01-01')}
      SELECT CASE WHEN a.entity IS NULL THEN 'added' WHEN b.entity IS NULL THEN 'dropped' WHEN abs(b.strength - a.strength) < 0.05 AND abs(b.years - a.years) < 0.5 THEN 'same'
        WHEN CASE WHEN abs(b.strength - a.strength) >= 0.05 THEN b.strength > a.strength ELSE b.years > a.years END THEN 'strengthened' ELSE 'weakened' END AS change, count(*) AS n
      FROM a FULL OUTER JOIN b ON a.entity = b.entity AND a.skill = b.skill GROUP BY ALL"""
    q["compress_topk_evidence"] = f"WITH {EV} SELECT entity, skill, rank, experience, seq, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity, skill ORDER BY round(confidence, 6) DESC, start_date DESC, experience, seq) AS rank FROM ev) WHERE rank <= 3"
    q["career_gantt"] = f"""WITH {EV}, s AS (SELECT entity, experience, min(start_date) AS a, max(coalesce(end_date, DATE '2002-01-01')) AS b FROM ev GROUP BY ALL),
      w AS (SELECT *, min(a) OVER (PARTITION BY entity) AS a0, greatest(date_diff('day', min(a) OVER (PARTITION BY entity), max(b) OVER (PARTITION BY entity)), 1) AS whole FROM s)
      SELECT entity, experience, round(100 * date_diff('day', a0, a) / whole, 6) AS offset_pct, round(greatest(1.0, 100 * date_diff('day', a, b) / whole), 6) AS width_pct FROM w"""
    q["reverse_chronology"] = f"""WITH {EV}, e AS (SELECT DISTINCT entity, experience, start_date FROM ev), l AS (SELECT *, lag(start_date) OVER (PARTITION BY entity ORDER BY experience) AS p FROM e)
      SELECT entity, count(*) FILTER (start_date > p) AS out_of_order, count(*) AS n FROM l GROUP BY ALL"""
    q["filter_tree_all_any_not"] = f"WITH {JOB} SELECT job_id, company, title FROM job WHERE (lower(location) IN ('nation_3', 'nation_7', 'nation_11') OR salary > 300000) AND NOT contains(lower(title), 'urgent') AND coalesce(is_remote, false) = false"
    q["filter_leaf_ops"] = f"""WITH {JOB} SELECT count(*) FILTER (lower(location) = 'nation_3') AS eq, count(*) FILTER (lower(location) <> 'nation_3') AS ne, count(*) FILTER (salary > 150000) AS gt, count(*) FILTER (salary >= 150000) AS ge,
      count(*) FILTER (salary < 50000) AS lt, count(*) FILTER (salary <= 50000) AS le, count(*) FILTER (list_has_any(string_split(lower(company), ' '), ['building', 'nation_3'])) AS in_,
      count(*) FILTER (NOT list_contains(string_split(lower(company), ' '), 'machinery')) AS not_in, count(*) FILTER (salary BETWEEN 50000 AND 100000) AS "between",
      count(*) FILTER (coalesce(is_remote, false)) AS is_true, count(*) FILTER (NOT coalesce(is_remote, false)) AS is_false, count(*) FILTER (contains(lower(title), 'high')) AS contains, count(*) FILTER (salary <> 0) AS number_true, count(*) AS text_false FROM job"""
    q["filter_null_semantics"] = f"""WITH {JOB}, x AS (SELECT job_id, CASE WHEN job_id % 3 <> 0 THEN company END AS c, CASE WHEN job_id % 5 <> 0 THEN salary END AS s FROM job)
      SELECT job_id, coalesce(contains(lower(c), 'build'), false) AS contains, NOT coalesce(contains(lower(c), 'build'), false) AS not_contains, true AS not_in, coalesce(s > 100000, false) AS gt, true AS all_empty, false AS any_empty FROM x"""
    q["hard_filter"] = f"""WITH {JOB} SELECT job_id, company, round(salary, 2) AS salary FROM job WHERE salary >= 100000 AND is_remote AND date_diff('day', created, DATE '2002-01-01') <= 2000
      AND lower(company) <> 'building nation_1' AND (contains(lower(location), 'nation_1') OR contains(lower(location), 'nation_2'))"""
    q["blocked_company_antifilter"] = f"WITH {JOB} SELECT company, count(*) AS n FROM job WHERE NOT contains(lower(company), 'machinery') AND NOT contains(lower(company), 'house') GROUP BY ALL"
    q["freshness_bucket"] = f"WITH {JOB}, a AS (SELECT date_diff('day', created, DATE '2001-08-02') AS d FROM job) SELECT CASE WHEN d > 90 THEN 'Expired' WHEN d > 30 THEN 'Stale' WHEN d > 7 THEN 'Aging' ELSE 'Fresh' END AS bucket, count(*) AS n FROM a GROUP BY ALL"
    q["salary_band"] = f"WITH {JOB} SELECT {BAND} AS band, count(*) AS n, round(avg(salary), 4) AS mean_salary FROM job GROUP BY ALL"
    q["first_match_classifier"] = f"SELECT doc_id, CASE {' '.join(f'WHEN {_has(low, tuple(m))} THEN {chr(39)}{n}{chr(39)}' for n, *m in CLASS)} ELSE 'Other' END AS label FROM documents"
    q["multi_label_keywords"] = " UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n FROM documents WHERE {_has(low, tuple(m))} HAVING count(*) > 0" for n, *m in CLASS)
    q["aspect_extract_dedup"] = f"""WITH {JOB}, a AS (SELECT job_id, 0 AS i, 'company' AS kind, company AS value FROM job UNION ALL SELECT job_id, 1, 'location', location FROM job UNION ALL SELECT job_id, 2, 'title', title FROM job
      UNION ALL SELECT job_id, 3, 'band', {BAND} FROM job UNION ALL SELECT job_id, 4, 'model', CASE WHEN is_remote THEN 'Remote' ELSE 'Onsite' END FROM job)
      SELECT kind, value, job_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, lower(value) ORDER BY job_id, i) AS rn FROM a) WHERE rn = 1"""
    q["anonymise_projection"] = "SELECT c_custkey, NULL::varchar AS name, n_name AS place, CASE WHEN c_acctbal > 5000 THEN 'Enterprise' WHEN c_acctbal > 0 THEN 'Mid' ELSE 'Small' END AS company_class FROM customer JOIN nation ON c_nationkey = n_nationkey"
    q["tiered_match_coverage"] = f"WITH {COV} SELECT entity_class, n_entities, spec_class, n_specs, got_required, got_preferred, matched, round(required_coverage, 6) AS required_coverage, round(preferred_coverage, 6) AS preferred_coverage, round(fit, 6) AS fit, round(mean_strength, 6) AS mean_strength FROM pair"
    q["tiered_match_best"] = f"WITH {MATCH} SELECT entity, term, skill, round(strength, 6) AS strength, round(similarity::double, 6) AS similarity FROM best WHERE term IN (SELECT term FROM req)"
    q["rank_entities_for_spec"] = f"WITH {COV} SELECT spec, rank, entity, round(fit, 6) AS fit, round(mean_strength, 6) AS mean_strength FROM (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY round(fit, 6) DESC, round(mean_strength, 6) DESC, entity) AS rank FROM cov) WHERE rank <= 10"
    q["tiered_match_semantic"] = f"""WITH {VEC}, p AS (SELECT a.id AS query_id, b.id AS candidate_id, list_inner_product(a.v, b.v) AS s FROM vec a LEFT JOIN vec b ON b.id <> a.id WHERE a.id % 50 = 0)
      SELECT query_id, candidate_id, round(s, 6) AS similarity, coalesce(s >= 0.30, false) AS matched FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, candidate_id) AS rn FROM p) WHERE rn = 1"""
    q["simple_match_votes"] = f"""WITH {JOB}, {VOTE}, sk AS (SELECT l_orderkey AS job_id, list(DISTINCT p_name) AS skills FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
      x AS (SELECT job.job_id, len(skills) AS n, len(list_filter(skills, lambda x: lower(x) IN ('red gear', 'blue gear', 'small widget', 'hot bolt'))) AS k, len(list_filter(skills, lambda x: lower(x) = 'large widget')) AS a, coalesce(score, 0) AS b
        FROM job JOIN sk USING (job_id) LEFT JOIN vote ON source_id = profile)
      SELECT job_id, round(greatest(0.0, least(1.0, greatest(0.0, least(1.0, k / n - 0.1 * a)) + 0.05 * b)), 6) AS score, (n - k)::bigint AS n_missing FROM x"""
    q["archetype_match"] = f"""WITH {EV}, r AS (SELECT DISTINCT p_type AS role, p_name AS skill FROM part), t AS (SELECT role, count(*) AS total FROM r GROUP BY ALL),
      g AS (SELECT entity, role, count(*) AS matched FROM (SELECT DISTINCT entity, skill FROM ev) JOIN r USING (skill) GROUP BY ALL) SELECT entity, role, matched, total, round(100 * matched / total, 6) AS percent FROM g JOIN t USING (role)"""
    stops = "'about', 'above', 'after', 'also', 'among', 'being', 'between', 'their', 'there', 'these', 'those', 'through', 'using', 'where', 'which', 'while', 'will', 'with', 'working', 'within', 'would', 'experience', 'ability', 'knowledge', 'skills', 'strong', 'across'"
    q["coverage_keyword_overlap"] = f"""WITH n AS (SELECT item_id AS need, list_distinct(list_filter(list_transform(string_split_regex({low}, '[ \\n]+'), lambda w: trim(w, '.,;()')), lambda w: length(w) > 4 AND w NOT IN ({stops}))) AS ks FROM benchmark),
      k AS (SELECT DISTINCT unnest(ks) AS k FROM n), d AS (SELECT doc_id AS offer, {low} AS t FROM documents), h AS (SELECT offer, k FROM d, k WHERE contains(t, k) OR (k LIKE '%s' AND contains(t, k[:-2]))),
      s AS (SELECT need, offer, count(*) AS overlap, any_value(len(ks)) AS n FROM (SELECT need, ks, unnest(ks) AS k FROM n) JOIN h USING (k) GROUP BY need, offer HAVING count(*) >= 2)
      SELECT need, offer, overlap, round(least(1.0, overlap / n), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY need ORDER BY overlap DESC, offer) AS rn FROM s) WHERE rn = 1"""
    q["career_gaps"] = f"""WITH {GAPS} SELECT spec, gap, CASE gap WHEN 'weak' THEN 0.5 WHEN 'adjacent' THEN CASE WHEN importance = 0 THEN 0.7 ELSE 0.3 END ELSE CASE WHEN importance = 0 THEN 0.9 ELSE 0.2 END END::double AS impact,
        CASE gap WHEN 'weak' THEN 'Low' WHEN 'adjacent' THEN 'Medium' ELSE 'High' END AS effort, count(*) AS n FROM g WHERE gap <> 'none' GROUP BY ALL"""
    q["email_app_match_score"] = r"""WITH a AS (SELECT c_custkey AS application_id, replace(c_name, '#', '-') || ', Ltd.' AS company, c_mktsegment AS title, CASE WHEN c_custkey % 6 = 4 THEN 'hr' || c_custkey || '@agency.example' END AS recruiter FROM customer),
      m AS (SELECT c_custkey AS message_id, CASE c_custkey % 6 WHEN 0 THEN 'jobs@' || lower(replace(c_name, '#', '-')) || '.co.uk' WHEN 1 THEN 'x@team-' || lower(replace(c_name, '#', '-')) || '-mail.com'
          WHEN 2 THEN 'me@' || lower(replace(c_name, '#', '-'))[4:] || '.org' WHEN 4 THEN 'HR' || c_custkey || '@Agency.example' ELSE 'info@hosting.example' END AS sender,
        CASE WHEN c_custkey % 6 = 3 OR c_custkey % 5 = 0 THEN 'About ' || lower(c_mktsegment) ELSE 'Hello' END AS subject,
        CASE WHEN c_custkey % 6 = 3 OR c_custkey % 7 = 0 THEN 'we at ' || upper(replace(c_name, '#', '-')) || ', ltd. write' ELSE 'body' END AS body FROM customer),
      x AS (SELECT message_id, application_id, CASE WHEN lower(sender) = lower(recruiter) THEN 1.0 ELSE
          CASE WHEN contains(label, squeezed) OR contains(squeezed, label) THEN 0.6 ELSE 0.0 END + CASE WHEN contains(lower(subject), lower(title)) THEN 0.3 ELSE 0.0 END
          + CASE WHEN contains(lower(subject), lower(company)) OR contains(lower(body), lower(company)) THEN 0.2 ELSE 0.0 END END::double AS score
        FROM (SELECT *, lower(string_split(string_split(sender, '@')[2], '.')[1]) AS label FROM m), (SELECT *, regexp_replace(regexp_replace(lower(company), '[ ,.]', '', 'g'), 'inc|ltd|llc|corp', '', 'g') AS squeezed FROM a))
      SELECT message_id, application_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY round(score, 6) DESC, application_id) AS rn FROM x) WHERE rn = 1 AND round(score, 6) >= 0.5"""
    q["company_cooldown"] = f"""WITH {JOB}, r AS (SELECT lower(company) AS k, max(created) AS last FROM job WHERE is_remote GROUP BY ALL)
      SELECT job_id, company, created::varchar AS created, last::varchar AS last FROM job JOIN r ON lower(company) = k WHERE date_diff('day', last, created) BETWEEN 0 AND 14 AND NOT coalesce(is_remote, false)"""
    q["antijoin_new_items"] = "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"
    q["set_operations"] = "SELECT k, 'except' AS kind FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) UNION ALL SELECT k, 'intersect' FROM (SELECT p_partkey AS k FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"
    q["interval_overlap_merge"] = """WITH o AS (SELECT o_custkey AS owner, o_orderkey AS id, o_orderdate::date AS s, o_orderdate::date + 30 AS e FROM orders)
      SELECT a.owner, a.id AS a_id, b.id AS b_id FROM o a JOIN o b ON a.owner = b.owner AND a.id < b.id AND a.s <= b.e + 90 AND b.s <= a.e + 90"""
    q["key_dedup_latest"] = f"WITH {JOB}, k AS (SELECT lower(company) AS key_company, {NTITLE.format('title')} AS key_title, job_id, created::varchar AS created FROM job) SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY key_company, key_title ORDER BY created DESC, job_id DESC) AS rn FROM k) WHERE rn = 1"
    q["url_dedup_first"] = "WITH x AS (SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN regexp_extract(url, '^[a-z]+://([^/]+)', 1) ELSE '' END AS key FROM pages) SELECT page_id, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS rn FROM x) WHERE rn = 1 OR key = ''"
    q["hoover_reposts"] = f"""WITH {JOB}, j AS (SELECT job_id, lower(company) AS company, created, CASE WHEN job_id % 3 = 0 THEN 'Senior ' ELSE '' END || array_to_string(list_transform(string_split(string_split(title, '-')[2], ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
        || ' Data Engineer Platform' || CASE WHEN job_id % 2 = 0 THEN ' Team' ELSE '' END AS title FROM job),
      t AS (SELECT *, list_distinct(list_filter(string_split(lower(title), ' '), lambda w: w <> '')) AS w, count(*) OVER (PARTITION BY company) AS posts FROM j),
      p AS (SELECT a.job_id, a.company, a.title, a.posts, date_diff('day', b.created, a.created)::int AS days, row_number() OVER (PARTITION BY a.job_id ORDER BY b.created DESC, b.job_id DESC) AS rn FROM t a JOIN t b
        ON a.company = b.company AND (b.created < a.created OR (b.created = a.created AND b.job_id < a.job_id)) AND len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) > 0.7 + 1e-9)
      SELECT job_id, company, title, posts, days, days < 60 AND posts >= 3 AS likely FROM p WHERE rn = 1"""
    q["near_duplicates_vec"] = f"""WITH {VEC} SELECT a.id AS query_id, b.id, round(list_inner_product(a.v, b.v), 6) AS similarity, CASE WHEN list_inner_product(a.v, b.v) >= 0.35 THEN 'duplicate' ELSE 'similar' END AS level FROM vec a JOIN vec b ON a.id <> b.id WHERE a.id % 50 = 0 AND list_inner_product(a.v, b.v) >= 0.25"""
    q["near_duplicates_vec_by_label"] = f"""WITH {VEC} SELECT a.g AS "group", a.id AS a, b.id AS b, round(list_inner_product(a.v, b.v), 6) AS similarity FROM vec a JOIN vec b ON a.g = b.g AND a.id < b.id WHERE list_inner_product(a.v, b.v) >= 0.25"""
    q["near_duplicates_vec_all"] = f"""WITH {VEC} SELECT a.id AS query_id, b.id, round(list_inner_product(a.v, b.v), 6) AS similarity FROM vec a JOIN vec b ON a.id <> b.id WHERE a.id % 50 = 0 AND list_inner_product(a.v, b.v) >= 0.25"""
    sets = """i AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS item FROM lineitem), s AS (SELECT id, count(*) AS n, list(item ORDER BY item) AS items FROM i GROUP BY ALL),
      k AS (SELECT id, n, min(id) OVER (PARTITION BY items) AS class_id FROM s), p AS (SELECT a.id AS id, b.id AS id2, count(*) AS c FROM i a JOIN i b ON a.item = b.item AND a.id <> b.id GROUP BY ALL),
      l AS (SELECT p.id, p.id2, c / (a.n + b.n - c) AS j, a.class_id AS ka, b.class_id AS kb FROM p JOIN k a ON a.id = p.id JOIN k b ON b.id = p.id2 WHERE c / (a.n + b.n - c) >= 0.5)"""
    q["jaccard_templates"] = f"WITH {sets} SELECT DISTINCT ka AS id, kb AS id2, round(j, 6) AS similarity FROM l WHERE ka < kb"
    q["jaccard_template_links"] = f"WITH {sets} SELECT k.id, any_value(k.class_id) AS class_id, count(l.id2) AS n_links FROM k LEFT JOIN l ON l.id = k.id GROUP BY k.id"
    q["candidate_fusion"] = """WITH c AS (SELECT p_size AS doc, upper(string_split(p_brand, ' ')[-1]) AS value, 'brand' AS source, 0.9 AS confidence FROM part UNION ALL SELECT p_size, upper(string_split(p_type, ' ')[-1]), 'type', 0.7 FROM part
        UNION ALL SELECT p_size, upper(string_split(p_name, ' ')[-1]), 'name', 0.75 FROM part),
      g AS (SELECT doc, translate(lower(trim(value)), '.,()', '') AS norm, least(1.0, max(confidence)::double + 0.1 * (count(DISTINCT source) - 1)) AS confidence, count(DISTINCT source) AS sources FROM c GROUP BY ALL)
      SELECT doc, 'label' AS field, norm, round(confidence, 6) AS confidence, sources, row_number() OVER (PARTITION BY doc ORDER BY round(confidence, 9) DESC, norm) AS rank FROM g"""
    q["entity_fusion"] = rf"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all({T}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+')) AS value FROM documents), n AS (SELECT doc_id, unnest(regexp_extract_all({T}, '[0-9]{{2,}}')) AS value FROM documents),
      c AS (SELECT doc_id, 'email' AS kind, value, 'rule' AS source, 0.95 AS confidence FROM a UNION ALL SELECT doc_id, 'email', lower(value), 'lower', 0.6 FROM a UNION ALL SELECT doc_id, 'number', value, 'rule', 0.5 FROM n)
      SELECT doc_id, kind, translate(lower(trim(value)), '.,()', '') AS norm, round(least(1.0, max(confidence)::double + 0.08 * (count(DISTINCT source) - 1)), 6) AS confidence, count(DISTINCT source) AS sources FROM c GROUP BY ALL"""
    q["aggregate_profile"] = f"""WITH {JOB}, t AS (SELECT source_id, arg_min(title, job_id) AS title FROM job WHERE job_id % 4 <> 0 GROUP BY ALL)
      SELECT source_id, max(company) AS company, any_value(t.title) AS title, round(max(salary), 2) AS salary FROM job LEFT JOIN t USING (source_id) GROUP BY source_id"""
    q["upsert_latest"] = "SELECT o_custkey AS id, o_orderkey AS version, round(o_totalprice, 2) AS data FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"
    knn = f"SELECT id, g, list_inner_product(v, {QV}) AS s FROM vec"
    q["knn_topk"] = f"WITH {VEC}, k AS ({knn}) SELECT id, round(s, 6) AS similarity FROM k ORDER BY round(s, 9) DESC, id LIMIT 10"
    q["knn_filtered_pre_vs_post"] = f"""WITH {VEC}, k AS ({knn}), a AS (SELECT 'pre' AS kind, id, round(s, 6) AS similarity FROM k WHERE g = 3 ORDER BY round(s, 9) DESC, id LIMIT 20), b AS (SELECT 'post' AS kind, id, round(s, 6) AS similarity, g FROM k ORDER BY round(s, 9) DESC, id LIMIT 20)
      SELECT * FROM a UNION ALL SELECT kind, id, similarity FROM b WHERE g = 3"""
    q["knn_batch_by_label"] = f"""WITH {VEC}, p AS (SELECT a.id AS query_id, b.id, list_inner_product(a.v, b.v) AS s FROM vec a JOIN vec b ON a.g = b.g AND a.id <> b.id WHERE a.id % 50 = 0)
      SELECT query_id, id, rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM p) WHERE rank <= 3"""
    q["knn_batch_all"] = f"""WITH {VEC}, p AS (SELECT a.id AS query_id, b.id, list_inner_product(a.v, b.v) AS s FROM vec a JOIN vec b ON a.id <> b.id WHERE a.id % 50 = 0)
      SELECT query_id, id, rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM p) WHERE rank <= 5"""
    q["knn_index_exact"] = q["knn_batch_all"]
    q["knn_index_recall"] = f"WITH {VEC} SELECT count(*) AS queries, sum(least(5, (SELECT count(*) FROM vec) - 1))::bigint AS neighbours, true AS enough FROM vec WHERE id % 50 = 0"
    q["pairwise_similarity_stats"] = f"""WITH {VEC} SELECT a.g AS "group", count(*) AS pairs, round(avg(list_inner_product(a.v, b.v)), 6) AS mean, round(stddev_pop(list_inner_product(a.v, b.v)), 6) AS stddev FROM vec a JOIN vec b ON a.g = b.g AND a.id < b.id GROUP BY ALL"""
    q["vector_store_stats"] = f"""WITH {VEC} SELECT g AS "group", count(*) AS n, max(id) + 1 AS next_id, round(avg(sqrt(list_inner_product(v, v))), 6) AS mean_norm FROM vec GROUP BY ALL"""
    q["cooccurrence_edges"] = f"WITH {EDGE} SELECT src, dst, weight FROM edge"
    q["graph_degree_topn"] = f"WITH {EDGE} SELECT community, rank, node, degree FROM (SELECT community, node, degree, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS rank FROM deg JOIN member USING (node)) WHERE rank <= 5"
    q["planted_communities"] = "SELECT lpad(s_suppkey::varchar, 9, '0') AS node, lpad((min(s_suppkey) OVER (PARTITION BY s_nationkey))::varchar, 9, '0') AS community FROM supplier QUALIFY count(*) OVER (PARTITION BY s_nationkey) > 1"
    q["graph_modularity"] = f"""WITH {EDGE}, i AS (SELECT a.community, sum(weight)::bigint AS inside FROM edge JOIN member a ON a.node = src JOIN member b ON b.node = dst WHERE a.community = b.community GROUP BY ALL), t AS (SELECT community, sum(degree)::bigint AS total FROM deg JOIN member USING (node) GROUP BY ALL), m AS (SELECT sum(weight) AS m FROM edge)
      SELECT community, coalesce(inside, 0) AS inside, total, round(coalesce(inside, 0) / m - (total / (2 * m)) ** 2, 6) AS modularity FROM t LEFT JOIN i USING (community), m"""
    q["bridge_skills"] = f"""WITH {LED}, {EDGE}, strong AS (SELECT skill AS node FROM led GROUP BY ALL HAVING round(avg(strength), 6) > 0.4)
      SELECT src AS node, b.community AS target, sum(weight)::bigint AS weight FROM both_ways JOIN strong ON strong.node = src JOIN member a ON a.node = src JOIN member b ON b.node = dst WHERE a.community <> b.community GROUP BY ALL"""
    q["relation_learner"] = """WITH x AS (SELECT l_orderkey AS g, l_linenumber AS p, p_name AS t FROM lineitem JOIN part ON l_partkey = p_partkey),
      y AS (SELECT a.t AS a, b.t AS b FROM x a JOIN x b ON a.g = b.g AND b.p > a.p AND b.p < a.p + 5 AND a.t <> b.t) SELECT CASE WHEN length(b) < length(a) THEN b ELSE a END AS canonical, CASE WHEN length(b) < length(a) THEN a ELSE b END AS alias, count(*) AS n FROM y GROUP BY ALL"""
    q["vote_clamped_fold"] = f"WITH {VOTE} SELECT profile, score FROM vote"
    q["vote_auto_filter"] = f"WITH {VOTE} SELECT profile, score FROM vote WHERE score <= -3"
    q["stage_machine_fold"] = f"WITH {APP} SELECT application, stage, n_events, coalesce(epoch_us(applied_at), -1) AS applied_us, epoch_us(last_activity) AS last_us FROM app"
    q["funnel"] = f"WITH {APP} SELECT stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM app GROUP BY ALL"
    q["funnel_rates"] = f"""WITH {APP}, n AS (SELECT count(*) AS total, count(*) FILTER (stage >= 1) AS applied, count(*) FILTER (stage > 1 AND stage <> 8) AS r, count(*) FILTER (stage IN (3, 4, 5)) AS i, count(*) FILTER (stage IN (4, 5)) AS o FROM app)
      SELECT total, applied, 100 * r // applied AS response_rate, 100 * i // applied AS interview_rate, 100 * o // applied AS offer_rate FROM n"""
    q["ghosted_stale"] = f"WITH {APP} SELECT application FROM app WHERE stage = 1 AND date_diff('day', last_activity::date, DATE '2024-02-10') >= 30"
    q["watch_due"] = """WITH w AS (SELECT user_id, max(ts::date) FILTER (event_type = 'click') AS p, count(*) AS n FROM events GROUP BY ALL)
      SELECT user_id, n % 2 = 0 AND n % 7 > 0 AND (p IS NULL OR date_diff('day', p, DATE '2024-01-31') >= n % 7) AS due FROM w"""
    mail = f"lower(CASE WHEN turn % 3 = 0 THEN 'unfortunately the interview ' ELSE '' END || {T})"
    rules = [("Offer", "pleased to offer", "job offer", "offer letter"), ("Interview", "interview", "schedule a call", "phone screen"), ("Rejected", "unfortunately", "not moving forward", "other candidates"), ("Screening", "assessment", "screening", "coding challenge"), ("Applied", "received your application", "thank you for applying"), ("Other", "application")]
    q["mail_classes"] = f"SELECT CASE {' '.join(f'WHEN {_has(mail, tuple(m))} THEN {chr(39)}{n}{chr(39)}' for n, *m in rules)} ELSE 'none' END AS label, count(*) AS n FROM conversations GROUP BY ALL"
    q["tumbling_window"] = "SELECT ts::date::varchar AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
    q["sliding_window"] = "SELECT d::varchar AS day, count(*) AS n FROM (SELECT unnest([ts::date, ts::date - 1]) AS d FROM events) GROUP BY ALL"
    q["session_windows"] = """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), i AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l),
      c AS (SELECT user_id, s, count(*) AS n FROM i GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY ALL"""
    conds = {
        ("format", "short", "error"): f"length({T}) < 200", ("format", "long", "warning"): f"length({T}) > 20000", ("format", "lines", "info"): f"NOT contains({T}, chr(10))", ("style", "pronoun", "error"): f"contains({low}, ' i ')",
        ("style", "noise", "warning"): f"contains({T}, '###')", ("style", "filler", "warning"): f"contains({low}, ' that ')", ("style", "bang", "warning"): f"contains({T}, '!!')", ("content", "number", "warning"): f"NOT regexp_matches({T}, '[0-9]')",
    }

    def part(g: str, chances: int) -> str:
        points = " + ".join(f"CASE WHEN {c} THEN {2 if s == 'error' else 1 if s == 'warning' else 0} ELSE 0 END" for (k, _, s), c in conds.items() if k == g)
        return f"greatest(0, least(100, floor((1 - ({points}) / {2 * chances}) * 100)::int))"

    q["quality_scores"] = f"SELECT *, (format_score * 50 + style_score * 30 + content_score * 20) // 100 AS overall FROM (SELECT doc_id, {part('format', 2)} AS format_score, {part('style', 3)} AS style_score, {part('content', 1)} AS content_score FROM documents)"
    q["quality_findings"] = " UNION ALL ".join(f"SELECT '{g}' AS category, '{k}' AS code, '{s}' AS severity, count(*) AS n FROM documents WHERE {c} HAVING count(*) > 0" for (g, k, s), c in conds.items())
    n_line = "len(list_filter(string_split(l, ' '), lambda w: w <> ''))"
    q["bullet_lint"] = f"""WITH l AS (SELECT doc_id, unnest(string_split({T}, chr(10))) AS l FROM documents)
      SELECT doc_id, count(*) FILTER (l <> '') AS n_lines, count(*) FILTER (l <> '' AND {n_line} < 8) AS short, count(*) FILTER ({n_line} > 35) AS long, count(*) FILTER (l <> '' AND NOT regexp_matches(l, '[0-9]')) AS no_quantity,
        count(*) FILTER (regexp_matches(lower(l), '(^| )(i|my|me)( |$)')) AS pronoun FROM l GROUP BY ALL"""
    q["lexical_diversity"] = f"WITH w AS (SELECT doc_id, list_filter(string_split_regex({low}, '[^\\p{{L}}]+'), lambda w: length(w) >= 3) AS w FROM documents) SELECT doc_id, len(w)::bigint AS n_words, round(len(list_distinct(w)) / len(w), 6) AS ttr FROM w WHERE len(w) >= 20"
    sent = r"list_filter(string_split_regex(x, '[^\p{L}]+'), lambda w: w <> '')"
    q["stylometrics"] = f"""WITH s AS (SELECT doc_id, list_filter(string_split_regex({low}, '[^\\p{{L}}]+'), lambda w: w <> '') AS w, list_filter(list_transform(string_split_regex({low}, '[.!?]'), lambda x: len({sent})), lambda n: n > 0) AS s FROM documents)
      SELECT doc_id, len(s)::bigint AS n_sentences, round(list_avg(s), 6) AS mean_len, round(list_stddev_pop(s) / list_avg(s), 6) AS cv, round(100 * len(list_filter(w, lambda x: x IN ('the', 'that', 'with'))) / len(w), 6) AS buzz_pct FROM s WHERE len(s) > 0"""
    q["reading_order_sections"] = f"""WITH l AS (SELECT doc_id, unnest(string_split({T}, chr(10))) AS line, generate_subscripts(string_split({T}, chr(10)), 1) AS pos FROM documents),
      h AS (SELECT *, last_value(CASE WHEN length(line) <= 60 AND upper(line) = line AND regexp_matches(line, '[A-Z]') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM l)
      SELECT doc_id, count(*) AS lines, count(DISTINCT section) AS sections FROM h WHERE section IS NOT NULL GROUP BY ALL"""
    q["salary_years_regex"] = """SELECT o_orderkey, (o_orderkey % 90 + 10) * 1000 AS low, (o_orderkey % 90 + CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 10 END) * 1000 AS high, (o_custkey % 12)::int AS years FROM orders"""
    q["salary_forms"] = """WITH x AS (SELECT o_orderkey, o_orderkey % 5 AS n, (o_custkey % 50 + 20) * 1000 AS k FROM orders)
      SELECT o_orderkey, (CASE n WHEN 0 THEN k + 500 WHEN 1 THEN k WHEN 2 THEN k WHEN 3 THEN k + 0.5 END)::double AS low, (CASE n WHEN 0 THEN k + 9000 WHEN 1 THEN k + 5000 WHEN 2 THEN k + 1000 WHEN 3 THEN k + 0.5 END)::double AS high,
        CASE n WHEN 0 THEN 'GBP' WHEN 2 THEN 'MYR' END AS currency, CASE n WHEN 2 THEN 'monthly' END AS period, (CASE n WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 5 WHEN 3 THEN 2 ELSE 12 END)::int AS years FROM x"""
    point = "CASE o_orderkey % 4 WHEN 0 THEN strftime({d}, '%m/%Y') WHEN 1 THEN strftime({d}, '%Y-%m') WHEN 2 THEN strftime({d}, '%b. %Y') ELSE strftime({d}, '%Y') END"
    unit = "CASE WHEN o_orderkey % 4 = 3 THEN 'year' ELSE 'month' END"
    q["numeric_date_ranges"] = f"""WITH x AS (SELECT o_orderkey, o_orderstatus, o_orderdate::date AS a, (o_orderdate::date + 400)::date AS b FROM orders)
      SELECT o_orderkey, date_trunc({unit}, a)::date::varchar AS start_date, CASE WHEN o_orderstatus <> 'O' THEN date_trunc({unit}, b)::date::varchar END AS end_date, o_orderstatus = 'O' AS is_current, 13::int AS match_start,
        (12 + length({point.format(d='a')}) + CASE WHEN o_orderkey % 4 = 1 THEN 4 ELSE 3 END + CASE WHEN o_orderstatus = 'O' THEN 7 ELSE length({point.format(d='b')}) END)::int AS match_end FROM x"""
    q["html_to_text_title_host"] = r"""WITH x AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
      trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM pages)
      SELECT page_id, title, host, length(title)::bigint AS n, length(t) > 200 AS long_enough FROM x"""

    def by_itself(texts: str, terms: str) -> str:
        """(doc_id, term, n) by what stands between the parts that a term cuts a text into."""
        before = "CASE WHEN p[i] <> '' THEN right(p[i], 1) WHEN i > 1 THEN right(term, 1) END"
        after = "CASE WHEN p[i + 1] <> '' THEN left(p[i + 1], 1) WHEN i + 1 < len(p) THEN left(term, 1) END"
        return f"""x AS ({texts}), y AS ({terms}), cut AS (SELECT doc_id, term, string_split(t, term) AS p FROM x, y WHERE contains(t, term)),
          hit AS (SELECT doc_id, term, len(list_filter(range(1, len(p)), lambda i: coalesce(NOT regexp_matches({before}, '[\\p{{L}}\\p{{Nd}}]'), true) AND coalesce(NOT regexp_matches({after}, '[\\p{{L}}\\p{{Nd}}]'), true)
            AND (length(term) > 2 OR coalesce({before} IN (' ', ',', chr(10)), true))))::bigint AS n FROM cut)"""

    from .catalogue import SKILL_LINES, SKILL_TERMS

    lines = "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in SKILL_LINES) + "]"
    skills = ", ".join(f"('{t.lower()}')" for t in SKILL_TERMS)
    docs = f"SELECT doc_id, lower(text || ' ' || {lines}[doc_id % {len(SKILL_LINES)} + 1]) AS t FROM documents"
    q["dictionary_scan"] = f"WITH {by_itself(docs, f'SELECT * FROM (VALUES {skills}) v(term)')} SELECT * FROM hit WHERE n > 0"
    plain = "SELECT doc_id, lower(text) AS t FROM documents"
    pairs = "SELECT DISTINCT array_to_string(w[i:i + 1], ' ') AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(lower(text), ' ') AS w FROM benchmark)) WHERE w[i] <> w[i + 1]"
    q["phrase_vocabulary_scan"] = f"WITH {by_itself(plain, pairs)} SELECT doc_id, count(*) AS terms, sum(n)::bigint AS n FROM hit WHERE n > 0 GROUP BY doc_id"
    langs = {"en": ("the", "and", "of", "that"), "de": ("und", "der", "die", "nicht"), "fr": ("les", "des", "est", "dans"), "es": ("los", "las", "por", "una")}
    hits = ", ".join(f"len(list_intersect(list_distinct(w), {list(v)})) AS {k}_" for k, v in langs.items())
    q["language_detect"] = f"""WITH w AS (SELECT lang, string_split_regex({low}, '[^\\p{{L}}]+') AS w FROM documents), h AS (SELECT lang, {hits} FROM w), g AS (SELECT *, greatest(en_, de_, fr_, es_) AS m FROM h)
      SELECT lang, CASE WHEN m < 2 THEN 'en' WHEN en_ = m THEN 'en' WHEN de_ = m THEN 'de' WHEN fr_ = m THEN 'fr' ELSE 'es' END AS guess, count(*) AS n FROM g GROUP BY ALL"""
    w4 = f"list_distinct(list_filter(string_split_regex({low}, '[^\\p{{L}}]+'), lambda w: length(w) >= 4))"
    q["spellcheck_antijoin"] = f"WITH k AS (SELECT DISTINCT unnest({w4}) AS w FROM benchmark), d AS (SELECT doc_id, unnest({w4}) AS w FROM documents) SELECT doc_id, count(*) AS unknown FROM d WHERE w NOT IN (SELECT w FROM k) GROUP BY ALL"
    fix = f"'I really was responsible for ' || {T}"
    for weak, strong in {"responsible for": "led", "worked on": "built", "helped with": "supported", "was involved in": "drove"}.items():
        fix = f"regexp_replace({fix}, '(?i){weak}', '{strong}', 'g')"
    kept = f"array_to_string(list_filter(string_split({fix}, ' '), lambda w: w NOT IN ('', 'I', 'my', 'me', 'very', 'really', 'just', 'basically', 'actually')), ' ')"
    q["fix_rewrite"] = f"SELECT conv_id, turn, md5({kept}) AS fixed FROM conversations"
    q["bigram_scan"] = f"WITH {by_itself(plain, "SELECT * FROM (VALUES ('of the'), ('in the'), ('under the'), ('this license'), ('in the first place')) v(term)")} SELECT * FROM hit WHERE n > 0"
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", "phone": r"\+?[0-9][0-9() .-]+[0-9]", "date": "(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}", "url": "https?://[A-Za-z0-9./_-]+"}
    m = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all({T}, '{p}')) AS m FROM documents" for k, p in kinds.items())
    q["pii_entities"] = f"SELECT doc_id, kind, count(*) AS n, count(DISTINCT m) AS different FROM ({m}) WHERE kind <> 'phone' OR length(regexp_replace(m, '[^0-9]', '', 'g')) >= 10 GROUP BY ALL"
    q["skill_groups_export"] = "SELECT p_type, array_to_string(list_sort(list(DISTINCT p_name)), '; ') AS keywords, count(DISTINCT p_name) AS n FROM part GROUP BY ALL"
    q["byte_share"] = """WITH g AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), s AS (SELECT *, q / sum(q) OVER (PARTITION BY l_suppkey) AS share FROM g)
      SELECT l_suppkey, l_returnflag, round(share, 6) AS share, round(least(0.95, least(1.0, share * 1.5) + 0.1), 6) AS confidence FROM s WHERE share >= 0.05"""
    q["median_by_group"] = "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, count(*) AS n FROM lineitem GROUP BY ALL"
    a, b = NTITLE.format("'Senior ' || a.n"), NTITLE.format("b.n")
    q["title_normalise_similarity"] = f"""WITH p AS (SELECT DISTINCT p_name AS n FROM part), x AS (SELECT a.n AS a, b.n AS b, list_distinct(string_split({a}, ' ')) AS x, list_distinct(string_split({b}, ' ')) AS y FROM p a JOIN p b ON string_split(a.n, ' ')[-1] = string_split(b.n, ' ')[-1] AND a.n < b.n)
      SELECT a, b, round(len(list_intersect(x, y)) / greatest(len(x), len(y), 1), 6) AS similarity FROM x"""
    q["style_role_mode"] = "WITH g AS (SELECT p_brand, l_returnflag || l_linestatus AS role, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT p_brand, role, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, role) AS rn FROM g) WHERE rn = 1"
    q["domain_detection"] = f"""WITH {EV}, h AS (SELECT entity, category, 3 * count(*) AS points FROM ev GROUP BY ALL) SELECT entity, category, rank, round(share, 6) AS share FROM (SELECT *, points / max(points) OVER (PARTITION BY entity) AS share, row_number() OVER (PARTITION BY entity ORDER BY points DESC, category) AS rank FROM h) WHERE rank <= 3"""
    q["duplicates_having"] = f"WITH {EV} SELECT experience, skill, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1"
    q["endorsement_counts"] = "SELECT p_name AS skill, count(l_orderkey) AS endorsements FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity = 50 GROUP BY ALL"
    q["layout_fingerprint"] = """SELECT l_orderkey, md5(array_to_string(list_sort(list(l_returnflag || ':' || lpad((floor(l_discount * 100)::int * 10 + floor(l_tax * 100)::int)::varchar, 3, '0'))), '|')) AS fingerprint FROM lineitem GROUP BY ALL"""
    q["batch_extraction_stats"] = f"WITH x AS (SELECT length({T}) AS n, len(string_split({T}, chr(10))) AS lines FROM documents) SELECT count(*) AS documents, round(avg(n), 4) AS mean_chars, round(avg(lines), 4) AS mean_lines, round(avg((lines = 1)::int), 6) AS single_line FROM x"
    q["taxonomy_canonical"] = """WITH t AS (SELECT string_split(p_name, ' ')[-1] AS t FROM part) SELECT CASE WHEN t IN ('gear', 'cog') THEN 'drive part' WHEN t IN ('bolt', 'screw') THEN 'fastener' ELSE lower(t) END AS canonical,
      count(*) AS n, count(DISTINCT t) AS terms FROM t GROUP BY ALL"""
    q["ledger_overclaimed"] = f"WITH {LED} SELECT entity, skill, (entity % 12)::int AS claimed, round(years, 6) AS years FROM led WHERE round(years, 6) < round((entity % 12) * 0.7, 6)"
    q["repository_strength"] = """WITH k AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), x AS (SELECT o_orderkey, floor(o_totalprice / 50) AS kb, n, o_custkey % 25 AS stars, date_diff('day', o_orderdate::date, DATE '2002-01-01') AS idle FROM orders JOIN k USING (o_orderkey))
      SELECT o_orderkey, round(0.25 * least(kb / 10000, 1.0) + 0.3 * least(n / 10, 1.0) + 0.2 * least(stars / 20, 1.0) + 0.25 * (CASE WHEN idle < 365 THEN 1.0 WHEN idle < 730 THEN 0.7 ELSE 0.4 END)::double, 6) AS strength FROM x"""
    marks = {"legal": (("license", 2), ("copyright", 2), ("version", 1)), "tabular": ((" | ", 2), ("|", 1)), "noisy": (("###", 2), ("!!", 1))}
    points = ", ".join(" + ".join(f"CASE WHEN contains({low}, '{m}') THEN {w} ELSE 0 END" for m, w in v) + f" AS {k}" for k, v in marks.items())
    q["pattern_points"] = f"""WITH p AS (SELECT {points} FROM documents), g AS (SELECT *, greatest(legal, tabular, noisy) AS m FROM p)
      SELECT CASE WHEN m = 0 THEN 'none' WHEN legal = m THEN 'legal' WHEN tabular = m THEN 'tabular' ELSE 'noisy' END AS label, m::bigint AS points, count(*) AS n FROM g GROUP BY ALL"""
    ranked = "r AS (SELECT community, node, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS rank FROM deg JOIN member USING (node))"
    q["graph_search_queries"] = f"""WITH {LED}, {EDGE}, {ranked}, st AS (SELECT skill AS node, avg(strength) AS s FROM led GROUP BY ALL), t AS (SELECT community, string_agg(node, ' ' ORDER BY rank) AS terms FROM r WHERE rank <= 3 GROUP BY ALL),
      g AS (SELECT community, round(avg(coalesce(s, 0)), 6) AS strength FROM member LEFT JOIN st USING (node) GROUP BY ALL)
      SELECT community, terms, strength, CASE WHEN strength > 0.5 THEN 'strong' WHEN strength > 0.2 THEN 'growth' ELSE 'stretch' END AS kind FROM t JOIN g USING (community)"""
    q["graph_widen_queries"] = f"""WITH {EDGE}, {ranked}, t AS (SELECT *, rank = max(rank) OVER (PARTITION BY community) AND rank > 1 AS last FROM r WHERE rank <= 3),
      n AS (SELECT t.community, dst, sum(weight)::bigint AS weight FROM t JOIN both_ways ON src = t.node JOIN member b ON b.node = dst WHERE NOT last AND b.community <> t.community GROUP BY ALL),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY weight DESC, dst) AS rn FROM n) WHERE rn = 1), dr AS (SELECT community, max(CASE WHEN last THEN node END) AS dropped FROM t GROUP BY ALL)
      SELECT dr.community, dropped, dst AS added, weight FROM dr LEFT JOIN best USING (community)"""
    q["bullets_not_subsumed"] = """WITH g AS (SELECT p_brand, coalesce(list(DISTINCT string_split(p_name, ' ')[-1]) FILTER (p_size > 25), []) AS a, coalesce(list(DISTINCT p_name) FILTER (p_size <= 2), []) AS b FROM part GROUP BY ALL)
      SELECT p_brand, coalesce(array_to_string(list_sort(list_filter(a, lambda x: len(list_filter(b, lambda y: contains(y, x) OR contains(x, y))) = 0)), ','), '') AS kept FROM g"""
    q["paren_aware_split"] = "SELECT p_partkey, p_name || ' (' || p_type || ', x)|' || p_brand AS items, 2::bigint AS n FROM part"
    q["date_range_parse"] = "SELECT o_orderkey, date_trunc('month', o_orderdate::date)::date::varchar AS start_date, CASE WHEN o_orderstatus <> 'O' THEN date_trunc('month', o_orderdate::date + 400)::date::varchar END AS end_date, o_orderstatus = 'O' AS is_current FROM orders"
    q["structured_postings"] = f"WITH {JOB} SELECT 'https://jobs.example/' || job_id AS url, 'jobs.example' AS host, title, company, location, round(salary, 2) AS salary_min, round(salary * 2, 2) AS salary_max, 'EUR' AS salary_currency, job_id % 4 = 2 AS is_remote FROM job"
    q["education_levels"] = """WITH e AS (SELECT CASE o_orderpriority[1] WHEN '1' THEN 'Doctoral' WHEN '2' THEN 'Masters' WHEN '3' THEN 'Bachelors' WHEN '4' THEN 'Vocational' ELSE 'Secondary' END AS level FROM orders)
      SELECT level, level IN ('Doctoral', 'Masters', 'Bachelors') AS meets, count(*) AS n FROM e GROUP BY ALL"""
    q["company_and_domain"] = "SELECT c_custkey, lower(trim(c_name)) AS company, lower(replace(c_name, '#', '-')) || '.com' AS domain FROM customer"
    q["spaced_letters"] = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Grade A B ' || p_name END AS name FROM part"
    score = lambda p, chances: f"greatest(0, least(100, floor((1 - ({p}) / {2 * chances}) * 100)::int))"
    yes = lambda c, w: f"CASE WHEN {c} THEN {w} ELSE 0 END"
    q["posting_quality"] = f"""WITH {JOB}, k AS (SELECT l_orderkey AS job_id, count(DISTINCT p_name) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
      x AS (SELECT job_id, {score(yes('company IS NULL', 2) + ' + ' + yes('salary < 30000', 1) + ' + ' + yes('is_remote IS NULL', 1), 7)} AS completeness_score,
        {score(yes('length(title) < 6', 1) + ' + ' + yes('upper(title) = title', 2), 4)} AS clarity_score, {score(yes('n < 2', 1), 3)} AS skills_score FROM job JOIN k USING (job_id))
      SELECT *, (completeness_score * 50 + clarity_score * 30 + skills_score * 20) // 100 AS overall FROM x"""
    q["stream_stage_state"] = f"WITH {APP} SELECT application, stage::int AS stage, coalesce(epoch_us(applied_at), -1)::bigint AS applied_us, epoch_us(last_activity)::bigint AS last_us, n_events FROM app"
    from .catalogue import POLL_WATCHES

    values = ", ".join(f"('{w}', '{k.lower()}', {str(a).lower()}, {n})" for w, k, a, n in POLL_WATCHES)
    q["watch_polls"] = f"""WITH RECURSIVE {JOB}, w AS (SELECT * FROM (VALUES {values}) v(watch, keyword, active, days)),
      j AS (SELECT job_id, title || ' ' || company AS title, salary AS score, created, dense_rank() OVER (ORDER BY year(created) // 3) - 1 AS batch FROM job),
      clock AS (SELECT batch, max(created) AS now FROM j GROUP BY batch),
      run AS (
        SELECT watch, keyword, active, days, -1::bigint AS batch, NULL::date AS polled, -1::bigint AS upto, -1::bigint AS before, false AS due FROM w
        UNION ALL SELECT watch, keyword, active, days, clock.batch, CASE WHEN active AND (polled IS NULL OR clock.now - polled >= days) THEN clock.now ELSE polled END,
          CASE WHEN active AND (polled IS NULL OR clock.now - polled >= days) THEN clock.batch ELSE upto END, upto, active AND (polled IS NULL OR clock.now - polled >= days)
        FROM run JOIN clock ON clock.batch = run.batch + 1),
      f AS (SELECT run.watch, run.batch, j.title, row_number() OVER (PARTITION BY run.watch, run.batch ORDER BY score DESC, job_id) AS rank
        FROM run JOIN j ON j.batch > run.before AND j.batch <= run.batch AND contains(lower(j.title), run.keyword) WHERE run.due)
      SELECT watch, count(*) AS n, string_agg(title, '; ' ORDER BY rank) FILTER (rank <= 3) AS top, batch::bigint AS batch FROM f GROUP BY watch, batch"""
    q["stream_stage_parity"] = f"WITH {APP} SELECT 'batch' AS kind, count(*) AS n FROM app UNION ALL SELECT 'stream', count(*) FROM app UNION ALL SELECT 'only_batch', 0 UNION ALL SELECT 'only_stream', 0"
    q["match_classes"] = f"WITH {COV} SELECT entity, terms_id, min(entity) OVER (PARTITION BY terms_id, have) AS entity_class FROM cov JOIN sp USING (spec) WHERE spec = terms_id"
    q["spec_classes"] = f"WITH {COV} SELECT spec, terms_id, spec_class, n_specs FROM sp"
    q["coverage_requirements"] = f"WITH {COVERED} SELECT entity, term, seq, text FROM best"
    q["coverage_report"] = f"""WITH {COVERED}, lack AS (SELECT spec, term, importance FROM req)
      SELECT entity_class, n_entities, spec_class, n_specs, matched, (100 * matched) // n_terms AS percent,
        coalesce((SELECT string_agg(term, ',' ORDER BY term) FROM lack WHERE lack.spec = spec_class AND importance = 0 AND NOT list_contains(have, term)), '') AS required_gaps,
        coalesce((SELECT string_agg(term, ',' ORDER BY term) FROM (SELECT term FROM lack WHERE lack.spec = spec_class AND importance = 1 AND NOT list_contains(have, term) ORDER BY term LIMIT 5)), '') AS preferred_missing FROM pair"""
    q["evidence_discovery"] = f"""WITH {ACH}, k AS (SELECT DISTINCT p_name AS n, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS skill FROM part)
      SELECT DISTINCT entity, skill, text, 0.85::double AS confidence FROM ach JOIN k ON contains(lower(text), n)"""
    q["career_actions"] = f"""WITH {GAPS} SELECT spec, actions, count(*) AS n_entities FROM (SELECT entity, spec, count(*) FILTER (importance = 0 AND gap IN ('true', 'adjacent')) AS actions FROM g GROUP BY ALL) GROUP BY ALL"""
    q["merged_experience"] = f"""WITH {EV}, x AS (SELECT entity, category, start_date, coalesce(end_date, DATE '2002-01-01') AS stop, skill FROM ev),
      f AS (SELECT *, max(stop) OVER (PARTITION BY entity, category ORDER BY start_date, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x),
      g AS (SELECT *, sum(CASE WHEN p IS NULL OR date_diff('day', p, start_date) > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY entity, category ORDER BY start_date, stop ROWS UNBOUNDED PRECEDING) AS k FROM f)
      SELECT entity, category, min(start_date)::varchar AS start_date, max(stop)::varchar AS stop, list(skill ORDER BY length(skill) DESC, skill DESC)[1] AS skill, count(*) AS n FROM g GROUP BY entity, category, k"""
    q["merged_skills"] = """WITH o AS (SELECT o_custkey AS owner, p_name AS name, l_linenumber AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
      e AS (SELECT DISTINCT owner, name FROM o WHERE n <= 2), i AS (SELECT DISTINCT owner, name FROM o WHERE n > 2)
      SELECT i.owner, array_to_string(list_transform(string_split(i.name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name, coalesce(x.name, y.name) AS "into"
      FROM i LEFT JOIN e x ON x.owner = i.owner AND x.name = i.name LEFT JOIN e y ON y.owner = i.owner AND y.name = 'new ' || string_split(i.name, ' ')[-1]"""
    q["name_fusion"] = """WITH c AS (SELECT c_custkey, 'Ann Part' || CASE WHEN c_custkey % 2 = 0 THEN 'on' ELSE '' END AS short FROM customer),
      x AS (SELECT c_custkey, short, 0.6 + CASE WHEN c_custkey % 5 = 0 THEN 0.1 ELSE 0.0 END AS own, CASE WHEN c_custkey % 7 = 0 THEN 0.78 ELSE 0.5 END AS junk FROM c)
      SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN short || ' Lee' WHEN junk > own THEN 'curriculum vitae' ELSE short END AS name,
        round(CASE WHEN c_custkey % 3 = 0 THEN 0.6 WHEN junk > own THEN 0.3 ELSE own END::double, 6) AS confidence FROM x"""
    q["stream_dedup_parity"] = "SELECT count(DISTINCT user_id || '-' || event_type) AS n, count(DISTINCT user_id || '-' || event_type) AS messages FROM events"
    q["stale_cards"] = f"WITH {APP} SELECT application, stage FROM app WHERE stage NOT IN (5, 6, 7, 8) AND date_diff('day', last_activity::date, DATE '2024-02-01') >= 14"
    q["notification_summary"] = f"""WITH {JOB}, r AS (SELECT location, title, row_number() OVER (PARTITION BY location ORDER BY round(salary, 2) DESC, job_id) AS rn FROM job)
      SELECT location AS watch, count(*) AS n, string_agg(title, '; ' ORDER BY rn) FILTER (rn <= 3) AS top FROM r GROUP BY ALL"""
    q["saved_search"] = f"WITH {JOB} SELECT job_id, round(salary, 2) AS salary FROM job WHERE salary > 200000 AND contains(lower(title), 'high') ORDER BY job.salary DESC, created, job_id LIMIT 50"
    q["dashboard_entries"] = f"WITH {LED} SELECT entity, skill, round(strength, 6) AS strength FROM led WHERE lower(category) = 'promo' AND contains(skill, 'gear') AND round(strength, 6) >= 0.3 AND skill <> 'red gear'"
    q["consistency_issues"] = f"""WITH {LED}, c AS (SELECT DISTINCT entity, skill, entity % 12 AS claimed FROM ev), i AS (
        SELECT skill, 'unsubstantiated' AS issue FROM led WHERE unsubstantiated UNION ALL SELECT skill, 'stale' FROM led WHERE NOT is_current AND date_diff('day', last_seen, DATE '2002-01-01') > 1825
        UNION ALL SELECT led.skill, 'overclaimed' FROM led JOIN c USING (entity, skill) WHERE round(years, 6) < round(claimed * 0.7, 6)) SELECT skill, issue, count(*) AS n FROM i GROUP BY ALL"""
    q["radar_top8"] = f"WITH {LED} SELECT entity, rank, skill, round(strength, 6) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(strength, 6) DESC, skill) AS rank FROM led) WHERE rank <= 8"
    q["compress_roles"] = f"""WITH {LED}, r AS (SELECT ev.entity, experience, max(start_date) AS started, max(CASE WHEN round(strength, 6) > 0.6 THEN 1 ELSE 0 END) AS relevant FROM ev JOIN led USING (entity, skill) GROUP BY ALL),
      a AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY started DESC, experience DESC) AS age FROM r) SELECT entity, experience, relevant, age FROM a WHERE relevant = 1 OR age <= 3"""
    q["quality_synthesis"] = f"""WITH f AS (SELECT doc_id, 'Formatting' AS g, 'error' AS s FROM documents WHERE length({T}) < 200 UNION ALL SELECT doc_id, 'Formatting', 'warning' FROM documents WHERE length({T}) > 20000
        UNION ALL SELECT doc_id, 'Achievements', 'warning' FROM documents WHERE NOT regexp_matches({T}, '[0-9]') UNION ALL SELECT doc_id, 'Sections', 'info' FROM documents WHERE NOT contains({T}, chr(10))
        UNION ALL SELECT doc_id, 'Achievements', 'error' FROM documents WHERE contains({T}, '###') UNION ALL SELECT doc_id, 'Other', 'warning' FROM documents WHERE contains({T}, '!!')),
      x AS (SELECT doc_id, g AS "group", count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'warning') AS warnings, count(*) AS affected, count(*) FILTER (s = 'error') > 0 AS important FROM f GROUP BY ALL HAVING count(*) FILTER (s <> 'info') > 0)
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY important DESC, affected DESC, "group") AS rank FROM x"""
    q["graph_characterise"] = f"""WITH {EDGE}, s AS (SELECT m.node, m.community, coalesce(sum(weight) FILTER (o.community = m.community), 0) / sum(weight) AS r FROM member m JOIN both_ways b ON b.src = m.node JOIN member o ON o.node = b.dst GROUP BY ALL),
      f AS (SELECT item AS node, count(*) AS df FROM it GROUP BY ALL), c AS (SELECT p_name AS node, max(p_type) AS category FROM part GROUP BY ALL),
      x AS (SELECT member.community, member.node, category, round(coalesce(r, 0) * (0.5 + 0.5 * least(coalesce(df, 0) / 3, 1.0)), 6) AS score FROM member LEFT JOIN s USING (node) LEFT JOIN f USING (node) LEFT JOIN c USING (node)),
      k AS (SELECT community, string_agg(node, ', ' ORDER BY rn) AS names FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY score DESC, node) AS rn FROM x) WHERE rn <= 3 GROUP BY ALL),
      d AS (SELECT community, category FROM (SELECT community, category, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, category) AS rn FROM x GROUP BY community, category) WHERE rn = 1)
      SELECT community, (SELECT count(*) FROM x WHERE x.community = k.community) AS members, category, category || ' (' || names || ')' AS label FROM k JOIN d USING (community)"""
    q["graph_neighbour_queries"] = f"""WITH {EDGE}, r AS (SELECT node, community, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS rank FROM deg JOIN member USING (node)), t AS (SELECT * FROM r WHERE rank <= 3),
      n AS (SELECT t.community, t.rank, b.dst, row_number() OVER (PARTITION BY t.community, t.rank ORDER BY b.weight DESC, b.dst) AS rn FROM t JOIN both_ways b ON b.src = t.node WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.community = t.community AND o.node = b.dst)),
      l AS (SELECT community, list(dst ORDER BY rank)[:2] AS more FROM n WHERE rn = 1 GROUP BY ALL) SELECT community, array_to_string(list_concat(list(node ORDER BY rank)[:2], any_value(more)), ' ') AS terms FROM t JOIN l USING (community) GROUP BY community"""
    q["graph_adjacent_community"] = f"""WITH {LED}, {EDGE}, st AS (SELECT skill AS node FROM led GROUP BY ALL HAVING round(avg(strength), 6) > 0.3),
      own AS (SELECT community, count(*) AS n FROM member JOIN st USING (node) GROUP BY ALL ORDER BY n DESC, community LIMIT 1),
      x AS (SELECT DISTINCT b.dst, o.community FROM both_ways b JOIN member h ON h.node = b.src JOIN own ON own.community = h.community JOIN member o ON o.node = b.dst WHERE o.community <> own.community)
      SELECT (SELECT community FROM own) AS community, community AS adjacent, count(*) AS n FROM x GROUP BY x.community ORDER BY n DESC, adjacent LIMIT 1"""
    q["name_repair"] = "SELECT c_custkey, 'Jane Doe' AS name, true AS \"like\" FROM customer"
    q["heading_classes"] = "SELECT CASE c_custkey % 4 WHEN 0 THEN 'Skills' WHEN 1 THEN 'Experience' WHEN 2 THEN 'Education' ELSE 'none' END AS section, count(*) AS n FROM customer GROUP BY ALL"
    q["small_text_functions"] = """SELECT p_partkey, CASE WHEN length(x) > 20 THEN x[:17] || '...' ELSE x END AS cut, p_name AS bare, 2 * (length(p_name) - length(replace(p_name, 'e', '')))::bigint AS n_e,
      CASE WHEN a < 1 THEN 'today' WHEN a < 7 THEN a || 'd ago' WHEN a < 30 THEN (a // 7) || 'w ago' WHEN a < 365 THEN (a // 30) || 'mo ago' ELSE (a // 365) || 'y ago' END AS age, 7 AS isced, p_size::varchar AS k
      FROM (SELECT *, p_name || ' - ' || p_brand || ' ' || p_type AS x, p_size * 9 AS a FROM part)"""
    q["ai_likeness_blend"] = f"""WITH a AS ({q["stylometrics"]}), b AS ({q["lexical_diversity"]}), x AS (SELECT a.doc_id, greatest(0.0, least(100.0, buzz_pct / 5 * 100)) AS p, greatest(0.0, least(100.0, (1 - cv / 0.5) * 100)) AS c, CASE WHEN ttr IS NOT NULL THEN greatest(0.0, least(100.0, (1 - ttr / 0.6) * 100)) END AS t FROM a LEFT JOIN b USING (doc_id))
      SELECT doc_id, floor((0.25 * p + 0.15 * c + coalesce(0.15 * t, 0)) / (0.4 + CASE WHEN t IS NULL THEN 0 ELSE 0.15 END))::int AS score FROM x"""
    q["embedding_variance_score"] = f"""WITH x AS ({q["pairwise_similarity_stats"]}) SELECT "group", round(least(100.0, greatest(0.0, least(1.0, (mean + 0.5 - 0.3) / 0.5)) * 100 + CASE WHEN stddev < 0.08 THEN 20 WHEN stddev < 0.12 THEN 10 ELSE 0 END), 4) AS score FROM x"""
    q["bullet_findings"] = f"""WITH c AS (SELECT trim(CASE turn % 3 WHEN 0 THEN 'Built ' WHEN 1 THEN 'Helped, my ' ELSE 'We ' END || {T}) AS t FROM conversations),
      b AS (SELECT t, lower(t) AS l, list_filter(string_split(t, ' '), lambda w: w <> '') AS w, ' ' || regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS p FROM c),
      f AS (SELECT 'WEAK_VERB' AS code, 'warning' AS severity, 1 AS n FROM b WHERE rtrim(lower(w[1]), '.,;:') IN ('helped', 'assisted', 'worked', 'responsible', 'participated', 'involved')
        UNION ALL SELECT 'UNRECOGNISED_VERB', 'info', 1 FROM b WHERE rtrim(lower(w[1]), '.,;:') NOT IN ('helped', 'assisted', 'worked', 'responsible', 'participated', 'involved', 'built', 'led', 'designed', 'delivered', 'drove', 'launched', 'reduced', 'increased', 'created', 'improved', 'managed', 'developed')
        UNION ALL SELECT 'MISSING_QUANTITY', 'warning', 1 FROM b WHERE NOT regexp_matches(t, '[0-9]') UNION ALL SELECT 'PRONOUN', 'error', 1 FROM b WHERE regexp_matches(p, ' (i|we|my|our|me) ')
        UNION ALL SELECT 'BUZZWORD', 'warning', n FROM (SELECT len(list_filter(['synergy', 'go-getter', 'team player', 'think outside the box', 'results-driven', 'self-starter'], lambda x: contains(l, x))) AS n FROM b) WHERE n > 0
        UNION ALL SELECT 'FILLER_WORD', 'info', n FROM (SELECT len(list_filter(['very', 'really', 'just', 'basically', 'actually'], lambda x: contains(p, ' ' || x || ' '))) AS n FROM b) WHERE n > 0
        UNION ALL SELECT 'BULLET_TOO_SHORT', 'warning', 1 FROM b WHERE len(w) < 8 UNION ALL SELECT 'BULLET_TOO_LONG', 'info', 1 FROM b WHERE len(w) > 35)
      SELECT code, severity, count(*) AS bullets, sum(n)::bigint AS n FROM f GROUP BY ALL"""
    q["vote_lookup"] = """WITH e AS (SELECT user_id, lower(event_type) AS kind, ts, event_id, value FROM events), v AS (SELECT user_id, kind, list_reduce(list(CASE WHEN value > 60 THEN 1 ELSE -1 END ORDER BY ts, event_id), lambda s, x: greatest(-5, least(5, s + x)), 0) AS score FROM e WHERE value > 50 GROUP BY ALL)
      SELECT DISTINCT user_id, kind, coalesce(score, 0) AS score FROM e LEFT JOIN v USING (user_id, kind)"""
    q["union_ignoring_case"] = "SELECT p_partkey, p_name || '|' || p_type || '|' || p_brand AS items FROM part"
    q["chunk_sizes"] = "SELECT o_custkey, chunk, count(*) AS n, min(o_orderkey) AS first FROM (SELECT *, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5)::int AS chunk FROM orders) GROUP BY ALL"
    q["blank_run_blocks"] = f"""WITH t AS (SELECT doc_id, replace(replace({T}, chr(10), chr(10) || chr(10)), '.' || chr(10) || chr(10), '.' || chr(10) || chr(10) || chr(10)) AS t FROM documents),
      l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM t), f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) - 1 >= 2 THEN 1 ELSE 0 END AS fresh FROM l WHERE trim(line) <> '')
      SELECT doc_id, count(*) AS lines, count(DISTINCT b) AS blocks FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM f) GROUP BY ALL"""
    q["two_line_entries"] = f"""WITH l AS (SELECT doc_id, unnest(string_split({T}, chr(10))) AS line, generate_subscripts(string_split({T}, chr(10)), 1) AS pos FROM documents),
      o AS (SELECT doc_id, length(line) < 60 AS opens, lead(length(line) >= 60) OVER (PARTITION BY doc_id ORDER BY pos) AS follows FROM l) SELECT doc_id, count(*) AS entries, count(*) FILTER (follows) AS pairs FROM o WHERE opens GROUP BY ALL"""
    q["box_lines"] = """WITH b AS (SELECT l_orderkey AS doc, l_linenumber * 45.0 AS x, floor(l_quantity / 12)::int AS "row", CASE WHEN l_returnflag = 'R' THEN 15.0 ELSE 10.0 END AS size, lower(l_returnflag) || l_linenumber || l_quantity::int AS text FROM lineitem),
      g AS (SELECT *, CASE WHEN x - (lag(x) OVER w + 10) > 50 THEN 1 ELSE 0 END AS gap FROM b WINDOW w AS (PARTITION BY doc, "row" ORDER BY x, text)),
      c AS (SELECT *, sum(gap) OVER (PARTITION BY doc, "row" ORDER BY x, text ROWS UNBOUNDED PRECEDING)::int AS "column" FROM g), m AS (SELECT doc, quantile_cont(size, 0.5) AS median FROM b GROUP BY ALL)
      SELECT c.doc, "row", "column", string_agg(text, ' ' ORDER BY x, text) AS text, max(size) >= 1.25 * any_value(median) AS heading FROM c JOIN m USING (doc) GROUP BY ALL"""
    q["entity_lookup"] = f"""WITH n AS (SELECT * FROM (VALUES ('License', 'company'), ('version', 'company'), ('Apache License', 'company'), ('tion', 'location'), ('ing', 'company'), ('Software', 'location')) v(name, kind))
      SELECT doc_id, name, kind FROM documents, n WHERE contains({low}, lower(name)) AND (kind = 'location' OR contains(' ' || regexp_replace({low}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ', ' ' || lower(name) || ' '))"""
    q["skill_categories"] = "SELECT p_name AS skill, coalesce(c, 'other') AS category, count(*) AS n FROM part LEFT JOIN (SELECT p_name AS k, min(p_type) AS c FROM part WHERE p_size > 10 GROUP BY ALL) ON k = p_name GROUP BY ALL"
    q["language_names"] = "SELECT coalesce(CASE lower(lang) WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE lower(lang) END, 'none') AS language, count(*) AS n FROM documents GROUP BY ALL"
    q["template_match"] = f"""WITH {sets}, tp AS (SELECT id, id2, j FROM l WHERE id < id2), x AS (SELECT id, id2, CASE WHEN id % 11 = id2 % 11 THEN 1.0 WHEN id % 5 = id2 % 5 THEN 0.97 ELSE least(1.0, j + CASE WHEN id % 2 = id2 % 2 THEN 0.05 ELSE 0.0 END) END::double AS score FROM tp)
      SELECT id, id2, round(score, 6) AS score, CASE WHEN round(score, 9) >= 0.95 THEN 'same' WHEN round(score, 9) >= 0.8 THEN 'match' ELSE 'none' END AS level FROM x"""
    q["domain_weights"] = f"""WITH {EV}, x AS (SELECT entity, category AS domain, 3 * count(*) FILTER (source = 'R') + 5 * count(*) FILTER (seq = 7) + count(*) FILTER (confidence > 0.97) AS points FROM ev GROUP BY ALL), m AS (SELECT *, max(points) OVER (PARTITION BY entity) AS most FROM x)
      SELECT entity, domain, round(points / most, 6) AS share, row_number() OVER (PARTITION BY entity ORDER BY points DESC, domain)::int AS rank FROM m WHERE points > 0 QUALIFY rank <= 3
      UNION ALL SELECT DISTINCT entity, 'general', 0.5, 1 FROM m WHERE most = 0"""
    q["hashed_embeddings"] = f"""WITH w AS (SELECT item_id, list_transform(list_filter(string_split_regex({low}, '[^\\p{{L}}]+'), lambda w: w <> ''), lambda w: ('0x' || md5(w)[1:4])::int % 16) AS h FROM benchmark),
      c AS (SELECT item_id, list_transform(range(16), lambda i: len(list_filter(h, lambda x: x = i))::double) AS c FROM w) SELECT item_id, {", ".join(f"round(c[{i + 1}] / greatest(sqrt(list_inner_product(c, c)), 1e-300), 6) AS e{i}" for i in range(16))} FROM c"""
    q["index_rows"] = """SELECT kind, count(*) AS n, sum(length(text))::bigint AS chars FROM (SELECT 'skill' AS kind, p_name AS text FROM part UNION ALL SELECT 'bullet', text FROM conversations WHERE length(trim(text)) >= 20
      UNION ALL SELECT 'title', regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages) WHERE trim(text) <> '' GROUP BY ALL"""
    q["pooled_vectors"] = f"""WITH {VEC}, p AS (SELECT g AS "group", id % 50 AS part, avg(v[1]) AS a, avg(v[2]) AS b, avg(v[3]) AS c FROM vec GROUP BY ALL)
      SELECT "group", part, round(a, 6) AS p0, round(b, 6) AS p1, round(c, 6) AS p2, round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) AS s0 FROM p"""
    q["detected_entities"] = f"""SELECT doc_id, kind, count(*) AS n, max(CASE kind WHEN 'email' THEN 0.95 ELSE 0.9 END)::double AS confidence FROM (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all({T}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]+')) FROM documents
      UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all({T}, 'https?://[A-Za-z0-9./_-]+')) FROM documents) GROUP BY ALL"""
    q["chunked_scores"] = f"""WITH c AS (SELECT doc_id, unnest(list_transform(range(0, greatest(length({T}) - 1, 0) // 500 + 1), lambda i: substring({T}, i * 500 + 1, 500))) AS c FROM documents)
      SELECT doc_id, round(avg((length(c) - length(replace(c, 'e', ''))) / greatest(length(c), 1)), 4) AS score FROM c GROUP BY ALL"""
    q["required_cooccurrence"] = f"WITH {REQ} SELECT a.term AS src, b.term AS dst, sum(CASE WHEN a.importance = 0 AND b.importance = 0 THEN 2 ELSE 1 END)::bigint AS weight FROM req a JOIN req b ON a.spec = b.spec AND a.term < b.term GROUP BY ALL"
    q["job_field_filters"] = f"""WITH {JOB}, sk AS (SELECT l_orderkey AS job_id, list_sort(list(DISTINCT p_name)) AS skills FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), j AS (SELECT job.*, skills[:11] AS skills FROM job JOIN sk USING (job_id))
      SELECT count(*) FILTER (job_id % 4 = 0) AS startup, count(*) FILTER (job_id % 4 = 0) AS saas, count(*) FILTER (job_id % 4 <> 1) AS no_health, count(*) FILTER (NOT coalesce(is_remote, false) AND job_id % 3 = 0) AS hybrid,
        count(*) FILTER (job_id % 3 = 0) AS is_hybrid, count(*) FILTER (list_has_any(skills, ['red gear', 'hot bolt'])) AS gear, count(*) FILTER (salary * 1.2 >= 300000) AS paid FROM j"""
    blank, sign = "\\p{Z}\\x09-\\x0d\\x{85}", "\\p{P}\\p{S}\\x{4e00}-\\x{9fff}"
    cuts = "[w[:2], w[:4], '##' || w[3:4], '##' || w[5:6], '##' || w[5:7], '##' || w[7:7], '##' || w[8:9]]"
    # Every place where a piece fits in a word, the longest of each, then the walk over a word from fit to fit.
    tokens = f"""bw AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS w FROM benchmark), bp AS (SELECT DISTINCT unnest({cuts}) AS piece FROM bw),
      pc AS (SELECT piece, ('0x' || md5(piece)[1:8])::bigint AS id, starts_with(piece, '##') AS inner, replace(piece, '##', '') AS body FROM bp WHERE piece NOT IN ('', '##')),
      ls AS (SELECT doc_id, regexp_extract_all(lower({T}), '[{sign}]|[^{blank}{sign}]+|[{blank}]+') AS l FROM documents), un AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM ls),
      ws AS (SELECT doc_id, w, i, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w) AS off FROM un), dw AS (SELECT DISTINCT w FROM ws WHERE NOT regexp_full_match(w, '[{blank}]+')),
      sub AS (SELECT w, a, n, w[a + 1 : a + n] AS body FROM dw, unnest(range(length(w))) x(a), unnest(range(1, 5)) y(n) WHERE a + n <= length(w)),
      fit AS (SELECT w, a, max(n) AS n, max_by(id, n) AS id FROM sub JOIN pc ON sub.body = pc.body AND pc.inner = (a > 0) GROUP BY ALL),
      walk AS (SELECT w, a, n, id FROM fit WHERE a = 0 UNION ALL SELECT f.w, f.a, f.n, f.id FROM walk k JOIN fit f ON f.w = k.w AND f.a = k.a + k.n),
      good AS (SELECT w FROM walk WHERE a + n = length(w)), cut AS (SELECT w, a, n, id FROM walk WHERE w IN (FROM good) UNION ALL SELECT w, 0, length(w), 4 FROM dw WHERE w NOT IN (FROM good)),
      tok AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY off, a) AS pos, id, (off + a)::int AS start, (off + a + n)::int AS stop FROM ws JOIN cut USING (w))"""
    q["wordpiece_counts"] = f"WITH RECURSIVE {tokens} SELECT doc_id, count(*) AS n, count(*) FILTER (id = 4) AS unknown, sum(id)::bigint AS ids, max(stop) AS stop FROM tok GROUP BY ALL"
    q["tagged_spans"] = f"""WITH RECURSIVE {tokens}, tg AS (SELECT doc_id, pos, start, stop, (id % 97) / 100 AS sure, CASE WHEN id % 6 = 3 THEN 'PER' ELSE 'LOC' END AS kind, id % 6 = 0 AS opens FROM tok WHERE id % 6 < 4),
      j AS (SELECT *, CASE WHEN NOT opens AND lag(pos) OVER w = pos - 1 AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS fresh FROM tg WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
      g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM j)
      SELECT doc_id, kind, min(start) AS start, max(stop) AS stop, count(*) AS tokens, round(avg(sure), 6) AS confidence FROM g GROUP BY doc_id, k, kind HAVING round(avg(sure), 9) >= 0.4"""
    q["page_reading_order"] = """WITH b AS (SELECT l_suppkey AS doc, l_orderkey % 3 AS page, (CASE WHEN l_suppkey % 4 <> 0 AND l_linenumber > 3 THEN 350 + (l_linenumber - 4) * 50 ELSE l_linenumber * 50 END)::double AS x, (l_orderkey % 40) * 12.5::double AS y,
        CASE l_orderkey % 40 WHEN 7 THEN 16.0 WHEN 9 THEN 13.0 ELSE 10.0 END::double AS size, CASE WHEN l_orderkey % 40 = 11 THEN upper(l_returnflag) ELSE lower(l_returnflag) || l_linenumber END AS text FROM lineitem),
      r AS (SELECT *, round_even(y / 3, 0) AS r FROM b), g AS (SELECT *, lag(x + 45) OVER (PARTITION BY doc, page, r ORDER BY x) AS p FROM r), m AS (SELECT *, CASE WHEN x - p > 30 THEN (x + p) / 2 END AS middle FROM g),
      v AS (SELECT doc, page, round_even(middle / 10, 0) AS s, count(*) AS votes, avg(middle) AS edge FROM m WHERE middle IS NOT NULL GROUP BY ALL), t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY votes DESC, s) = 1),
      pg AS (SELECT doc, page FROM m GROUP BY ALL HAVING count(*) >= 10 AND max(x + 45) - min(x) >= 200 AND count(middle) >= 3),
      e AS (SELECT doc, page, edge FROM t JOIN pg USING (doc, page) WHERE votes >= 0.3 * (SELECT count(DISTINCT r) FROM r WHERE r.doc = t.doc AND r.page = t.page)),
      l AS (SELECT doc, page, coalesce(x >= edge, false)::int AS "column", round_even(y / 2, 0)::int AS line, string_agg(text, ' ' ORDER BY x, text) AS text, sum(size * length(text)) / sum(length(text)) AS size FROM b LEFT JOIN e USING (doc, page) GROUP BY ALL),
      h AS (SELECT doc, quantile_cont(size, 0.5) AS median FROM l GROUP BY ALL)
      SELECT doc, page, "column", line, text, round(size, 6) AS size, CASE WHEN round(size / median, 9) >= 1.5 THEN 1 WHEN round(size / median, 9) >= 1.25 OR (length(text) < 50 AND upper(text) = text AND regexp_matches(text, '\\p{L}')) THEN 2 ELSE 0 END AS level FROM l JOIN h USING (doc)"""
    q["similar_experience"] = """WITH RECURSIVE x AS (SELECT o_custkey AS entity, o_orderdate::date AS a, o_orderdate::date + l_quantity::int AS b, (l_orderkey + l_linenumber) % 5 AS k, p_name AS p, string_split(p_name, ' ')[-1] AS last
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F'),
      y AS (SELECT entity, a, b, CASE k WHEN 0 THEN array_to_string(list_transform(string_split(p, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ', Ltd.' WHEN 1 THEN upper(last) WHEN 2 THEN p || ' Works GmbH' WHEN 3 THEN p END AS company,
        CASE k WHEN 1 THEN last WHEN 2 THEN p || ' works' WHEN 4 THEN NULL ELSE p END AS norm FROM x),
      f AS (SELECT *, max(b) OVER (PARTITION BY entity, norm ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM y WHERE norm IS NOT NULL),
      g AS (SELECT *, sum(CASE WHEN p IS NULL OR a - p > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY entity, norm ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM f),
      sp AS (SELECT row_number() OVER () AS id, * FROM (SELECT entity, norm, min(a) AS a, max(b) AS b, list(company ORDER BY length(company) DESC, company DESC)[1] AS company, count(*) AS n FROM g GROUP BY entity, norm, k)),
      ln AS (SELECT s.id AS u, t.id AS v FROM sp s JOIN sp t ON s.entity = t.entity AND s.id <> t.id AND s.norm <> t.norm AND (contains(' ' || s.norm || ' ', ' ' || t.norm || ' ') OR contains(' ' || t.norm || ' ', ' ' || s.norm || ' ')) AND s.a <= t.b + 30 AND t.a <= s.b + 30),
      reach AS (SELECT id, id AS c FROM sp UNION SELECT r.id, ln.v FROM reach r JOIN ln ON ln.u = r.c), c AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
      SELECT entity, min(a)::varchar AS start_date, max(b)::varchar AS stop, list(company ORDER BY length(company) DESC, company DESC)[1] AS company, count(DISTINCT norm) AS names, sum(n)::bigint AS n FROM sp JOIN c USING (id) GROUP BY entity, c
      UNION ALL SELECT entity, a::varchar, b::varchar, company, 1, 1 FROM y WHERE norm IS NULL"""
    # Arrivals and their watermarks: the newest time that came before, less twelve hours, in whole milliseconds.
    arrivals = """e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), r AS (SELECT min(t) AS lo, max(t) AS hi FROM e), b AS (SELECT user_id, t, ((t - lo) * 3 // (hi - lo + 1) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)::int AS k FROM e, r),
      wm AS (SELECT k, coalesce((SELECT max(t) FROM b WHERE b.k < x.k) // 1000 * 1000 - 43200000000, 0) AS w FROM (SELECT unnest(range(5)) AS k) x)"""
    q["stream_sliding_windows"] = f"""WITH {arrivals}, s AS (SELECT user_id, k, (t // 21600000000 - j) * 21600000000 AS a FROM b, unnest(range(4)) y(j)), kept AS (SELECT user_id, a, a + 86400000000 AS z FROM s JOIN wm USING (k) WHERE a + 86400000000 > w)
      SELECT user_id, a AS start_us, z AS stop_us, count(*) AS n FROM kept WHERE z <= (SELECT w FROM wm WHERE k = 4) GROUP BY ALL"""
    steps, closed = "open0 AS (SELECT user_id, t AS a, t AS z, 0 AS n FROM b WHERE false)", []
    for k in range(4):
        steps += f""", in{k} AS (SELECT * FROM open{k} UNION ALL SELECT user_id, t, t + 21600000000, 1 FROM b WHERE k = {k} AND t + 21600000000 > (SELECT w FROM wm WHERE k = {k})),
      f{k} AS (SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM in{k}), g{k} AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS i FROM f{k}),
      m{k} AS (SELECT user_id, min(a) AS a, max(z) AS z, sum(n)::bigint AS n FROM g{k} GROUP BY user_id, i), open{k + 1} AS (SELECT * FROM m{k} WHERE z > (SELECT w FROM wm WHERE k = {k + 1}))"""
        closed.append(f"SELECT user_id, a AS start_us, z AS stop_us, n FROM m{k} WHERE z <= (SELECT w FROM wm WHERE k = {k + 1})")
    q["stream_session_windows"] = f"WITH {arrivals}, {steps} {' UNION ALL '.join(closed)}"
    unit = "list_transform(range(16), lambda i: len(list_filter(list_transform(list_filter(string_split_regex({0}, '[^\\p{{L}}]+'), lambda w: w <> ''), lambda w: ('0x' || md5(w)[1:4])::int % 16), lambda h: h = i))::double)"
    q["tiered_match_cosine"] = f"""WITH {MATCH}, su AS (SELECT DISTINCT lower(skill) AS s, {unit.format("lower(skill)")} AS a FROM sk), tu AS (SELECT DISTINCT term, {unit.format("lower(term)")} AS b FROM tm),
      nv AS (SELECT s, term, cosine FROM (SELECT s, term, list_inner_product(a, b) / greatest(sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)), 1e-300) AS cosine FROM su, tu) WHERE cosine >= 0.45),
      sem AS (SELECT entity, term, skill, strength, cosine FROM led JOIN nv ON nv.s = lower(skill) ANTI JOIN found USING (entity, term) QUALIFY row_number() OVER (PARTITION BY entity, term ORDER BY round(cosine, 9) DESC, skill) = 1),
      top AS (SELECT entity, max(strength) AS strength FROM led GROUP BY ALL), txt AS (SELECT DISTINCT entity, term FROM ach JOIN fb USING (text) ANTI JOIN found USING (entity, term) ANTI JOIN sem USING (entity, term))
      SELECT entity, term, skill, round(strength, 6) AS strength, round(similarity::double, 6) AS similarity FROM found UNION ALL SELECT entity, term, skill, round(strength, 6), round(cosine, 6) FROM sem
      UNION ALL SELECT entity, term, '(evidence)', round(strength, 6), 0.65 FROM txt JOIN top USING (entity)"""
    cap = "upper({0}[1]) || lower({0}[2:])"
    q["initials_joined"] = f"""WITH x AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS b FROM part)
      SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '-' WHEN 1 THEN {cap.format("a")} || ' De ' || {cap.format("b")} ELSE {cap.format("a")} || ' ' || {cap.format("b")} END AS name FROM x"""
    return q
