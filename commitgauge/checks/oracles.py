"""DuckDB SQL with the meaning of each registered query, written without the library.

The SQL takes other ways than the operators do (plain windows, line tables,
JSON functions), so that agreement means something.
"""

from __future__ import annotations

from commitgauge import fixed_values as V
from commitgauge.checks import adapters as A
from commitgauge.checks.queries import FREQUENT_WORDS, INSTRUCTION, PAIRS

ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def pick(values, number: str) -> str:
    return f"list_extract({listing(values)}, CAST(({number}) % {len(values)} AS BIGINT) + 1)"


WS = text(V.PY_WHITESPACE)
PRIORITIES = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in A.PRIORITY_CATEGORIES.items())

COMMITS = f"""commits AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS commit_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'c' ELSE 'rust' END AS language,
         replace(n_name, '_', '-') AS repo,
         CASE WHEN r_name <> 'MIDDLE EAST' THEN r_name END AS domain,
         CASE WHEN o_custkey % 97 <> 0 THEN c_name END AS author,
         CAST(o_orderdate AS DATE) AS day,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         CASE o_orderpriority {PRIORITIES} END AS category,
         CAST(CASE WHEN o_orderkey % 101 <> 0 THEN 1 + o_orderkey % 5 END AS INTEGER) AS complexity,
         o_orderkey AS n
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SIZED = f"""{COMMITS}, sizes AS (
  SELECT l_orderkey, count(*) AS entropy, CAST(sum(l_quantity) AS BIGINT) AS churn,
         CAST(sum(l_linenumber) AS BIGINT) AS lines_removed
  FROM lineitem GROUP BY l_orderkey),
sized AS (
  SELECT commits.*, entropy, churn, churn AS lines_added, lines_removed,
         churn - lines_removed AS net, churn + lines_removed AS size
  FROM commits LEFT JOIN sizes ON n = l_orderkey)"""

SCORED = f"""{SIZED}, scored AS (
  SELECT *, complexity + 0.5::DOUBLE * log10(greatest(1.0::DOUBLE, coalesce(entropy, 1)::DOUBLE))
              + 0.5::DOUBLE * log10(greatest(1.0::DOUBLE, coalesce(churn, 1)::DOUBLE)) AS ccs
  FROM sized)"""

AUTHOR_YEARS = f"""{COMMITS}, author_years AS (
  SELECT year, coalesce(author, '<unknown>') AS author, count(*) AS commits
  FROM commits GROUP BY ALL)"""

ACTIVITY = f"""{AUTHOR_YEARS}, activity AS (
  SELECT year, CAST(sum(commits) AS BIGINT) AS commits, count(DISTINCT author) AS maintainers,
         sum(commits)::DOUBLE / count(DISTINCT author) AS commits_per_maintainer
  FROM author_years GROUP BY year)"""

DISTINCT_AUTHORS = "count(DISTINCT author) + max(CASE WHEN author IS NULL THEN 1 ELSE 0 END)"

# ---- focus --------------------------------------------------------------------------

WORK = f"CASE WHEN category = {text(V.FEATURE)} THEN 'Feature' ELSE 'Maintenance' END"

ORACLES["avg_ccs_by_category"] = f"""WITH {SCORED}
SELECT {WORK} AS work_type, category, language, round(avg(ccs), 6) AS avg_ccs
FROM scored GROUP BY ALL"""
ORACLES["category_counts"] = f"WITH {COMMITS} SELECT language, category, count(*) AS n FROM commits GROUP BY ALL"
ORACLES["repo_category_counts"] = f"WITH {COMMITS} SELECT repo, category, count(*) AS n FROM commits GROUP BY ALL"
ORACLES["category_share_language"] = f"""WITH {COMMITS},
t AS (SELECT language, count(*) AS total FROM commits GROUP BY ALL)
SELECT language, category, count(*) AS n, round(count(*)::DOUBLE / any_value(total), 6) AS share
FROM commits JOIN t USING (language) GROUP BY language, category"""
ORACLES["category_share_library"] = f"""WITH {COMMITS},
t AS (SELECT language, repo, count(*) AS total FROM commits GROUP BY ALL)
SELECT language || ' / ' || repo AS library, category, count(*) AS n,
       round(count(*)::DOUBLE / any_value(total), 6) AS share
FROM commits JOIN t USING (language, repo) GROUP BY language, repo, category"""
ORACLES["domain_delta"] = f"""WITH {COMMITS},
t AS (SELECT language, repo, count(*) AS total FROM commits GROUP BY ALL),
s AS (SELECT language, repo, domain, category, count(*)::DOUBLE / any_value(total) AS share
      FROM commits JOIN t USING (language, repo) WHERE domain IS NOT NULL
      GROUP BY language, repo, domain, category),
w AS (SELECT domain, category, coalesce(avg(share) FILTER (language = 'c'), 0) AS c,
             coalesce(avg(share) FILTER (language = 'rust'), 0) AS rust
      FROM s GROUP BY domain, category)
SELECT domain, category, {WORK} AS work_type, round(c, 6) AS c, round(rust, 6) AS rust,
       round(c - rust, 6) AS delta FROM w"""
ORACLES["memory_ratio"] = f"""WITH {COMMITS},
w AS (SELECT avg(CASE WHEN category = {text(V.MEMORY)} THEN 1.0::DOUBLE ELSE 0 END) FILTER (language = 'c') AS c,
             avg(CASE WHEN category = {text(V.MEMORY)} THEN 1.0::DOUBLE ELSE 0 END) FILTER (language = 'rust') AS rust
      FROM commits)
SELECT {text(V.MEMORY)} AS category, round(c, 6) AS c, round(rust, 6) AS rust, round(c / rust, 6) AS ratio FROM w"""
ORACLES["top_categories"] = f"""WITH {COMMITS}
SELECT category, count(*) AS n FROM commits GROUP BY category ORDER BY n DESC, category LIMIT 3"""
ORACLES["category_by_year_top"] = f"""WITH {COMMITS},
top AS (SELECT category FROM commits GROUP BY category ORDER BY count(*) DESC, category LIMIT 3),
g AS (SELECT year, CASE WHEN category IN (SELECT category FROM top) THEN category ELSE 'Other' END AS category
      FROM commits),
t AS (SELECT year, count(*) AS total FROM g GROUP BY year)
SELECT year, category, count(*) AS n, round(count(*)::DOUBLE / any_value(total), 6) AS share
FROM g JOIN t USING (year) GROUP BY year, category"""

# ---- activity -----------------------------------------------------------------------

ORACLES["net_loc_summary"] = f"""WITH {SIZED}
SELECT language, repo, CAST(sum(lines_added) AS BIGINT) AS total_added,
       CAST(sum(lines_removed) AS BIGINT) AS total_removed, CAST(sum(net) AS BIGINT) AS net_lines
FROM sized GROUP BY ALL"""
ORACLES["cumulative_net_loc"] = f"""WITH {SIZED},
d AS (SELECT language, repo, day, sum(net) AS net FROM sized GROUP BY ALL)
SELECT language, repo, CAST(day AS VARCHAR) AS day, CAST(net AS BIGINT) AS net_lines,
       CAST(sum(net) OVER (PARTITION BY language, repo ORDER BY day) AS BIGINT) AS cum_net_lines FROM d"""
ORACLES["cumulative_net_loc_strict"] = f"""WITH {SIZED},
d AS (SELECT language, repo, day, CASE WHEN bool_or(net IS NULL) THEN NULL ELSE sum(net) END AS net
      FROM sized GROUP BY ALL)
SELECT language, repo, CAST(day AS VARCHAR) AS day, CAST(net AS BIGINT) AS net_lines,
       CASE WHEN bool_or(net IS NULL) OVER w THEN NULL ELSE CAST(sum(net) OVER w AS BIGINT) END AS cum_net_lines
FROM d WINDOW w AS (PARTITION BY language, repo ORDER BY day)"""
ORACLES["yearly_net_loc"] = f"""WITH {SIZED}
SELECT year, language, CAST(sum(net) AS BIGINT) AS net_loc FROM sized GROUP BY ALL"""
_PAIR_ROWS = ", ".join(
    f"({text(c + ' / ' + r)}, 'c', {text(c)}), ({text(c + ' / ' + r)}, 'rust', {text(r)})" for c, r in PAIRS
)
ORACLES["pair_net_loc"] = f"""WITH {SIZED}, pairs(pair, language, repo) AS (VALUES {_PAIR_ROWS})
SELECT pair, language, repo, year, CAST(sum(net) AS BIGINT) AS net_loc
FROM sized JOIN pairs USING (language, repo) GROUP BY ALL"""
for _name, _key in (("contributors_by_language", "language"), ("contributors_by_library", "repo")):
    ORACLES[_name] = f"""WITH {COMMITS}
SELECT {_key}, year, {DISTINCT_AUTHORS} AS contributors FROM commits GROUP BY {_key}, year"""
ORACLES["commits_by_library_year"] = f"""WITH {COMMITS}
SELECT language, repo, year, count(*) AS commits FROM commits GROUP BY ALL"""
ORACLES["traffic"] = f"""WITH {COMMITS},
t AS (SELECT language, year, {DISTINCT_AUTHORS} AS contributors, count(*) AS commits
      FROM commits GROUP BY language, year)
SELECT *, round(commits::DOUBLE / contributors, 6) AS commits_per_contributor,
       round(ln(commits::DOUBLE), 6) AS log_commits FROM t"""
ORACLES["commit_frequency"] = f"""WITH {COMMITS},
t AS (SELECT language, year, count(*) AS total_commits, {DISTINCT_AUTHORS} AS developers
      FROM commits GROUP BY language, year)
SELECT *, round(total_commits::DOUBLE / (365 * developers), 6) AS frequency,
       round(log10(total_commits::DOUBLE / (365 * developers)), 6) AS log10_frequency FROM t"""
for _name, _key in (("churn_by_year", "language"), ("churn_by_library_year", "repo")):
    ORACLES[_name] = f"""WITH {SIZED}
SELECT {_key}, year, CAST(sum(size) AS BIGINT) AS total_churn, round(avg(size), 6) AS avg_churn_per_commit,
       count(*) AS commits FROM sized GROUP BY {_key}, year"""
ORACLES["changes_daily"] = f"""WITH {SIZED}
SELECT language, repo, author, CAST(day AS VARCHAR) AS day, count(*) AS revisions,
       CAST(sum(size) AS BIGINT) AS total_loc, any_value(year) AS year
FROM sized GROUP BY language, repo, author, sized.day"""
ORACLES["revisions_per_change"] = f"""WITH {COMMITS},
c AS (SELECT language, year, count(*) AS revisions FROM commits GROUP BY language, repo, author, day, year)
SELECT language, year, round(avg(revisions), 6) AS avg_revisions, count(*) AS n_changes
FROM c GROUP BY language, year"""
ORACLES["revisions_per_file_change"] = f"""WITH {COMMITS},
c AS (SELECT language, year, count(*) AS revisions FROM commits JOIN lineitem ON n = l_orderkey
      GROUP BY language, repo, author, l_partkey, day, year)
SELECT language, year, round(avg(revisions), 6) AS avg_revisions, count(*) AS n_changes
FROM c GROUP BY language, year"""
ORACLES["commits_by_year"] = f"WITH {COMMITS} SELECT year, count(*) AS commits FROM commits GROUP BY year"
ORACLES["commits_by_author_year"] = f"WITH {AUTHOR_YEARS} SELECT year, author, commits FROM author_years"
ORACLES["api_commits_by_author_year"] = f"""WITH {COMMITS},
t AS (SELECT CASE WHEN n % 17 = 3 THEN NULL WHEN n % 4 <> 0 OR n % 17 = 5 THEN CAST(day AS TIMESTAMP) + INTERVAL 30 DAY
                  WHEN n % 13 <> 0 THEN CAST(day AS TIMESTAMP) END AS ts, author FROM commits)
SELECT CAST(year(ts) AS INTEGER) AS year, coalesce(author, '<unknown>') AS author_name,
       lower(replace(author, '#', '.')) AS author_email, count(*) AS commits
FROM t WHERE ts IS NOT NULL GROUP BY ALL"""
ORACLES["yearly_activity"] = f"""WITH {ACTIVITY}
SELECT year, commits, maintainers, round(commits_per_maintainer, 6) AS commits_per_maintainer FROM activity"""
ORACLES["activity_join"] = ORACLES["yearly_activity"]
ORACLES["library_order"] = f"WITH {COMMITS} SELECT DISTINCT language, repo FROM commits"
ORACLES["commits_in_window"] = f"""WITH {COMMITS}
SELECT language, repo, count(*) AS n FROM commits
WHERE day BETWEEN DATE '1996-03-01' AND DATE '1997-06-30' GROUP BY ALL"""

# ---- concentration ------------------------------------------------------------------

PER_AUTHOR = f"""{COMMITS}, per_author AS (
  SELECT language, repo, year, author, count(*) AS commits FROM commits GROUP BY ALL)"""
CONCENTRATION = f"""{PER_AUTHOR}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY language, repo, year ORDER BY commits DESC) AS r FROM per_author),
conc AS (
  SELECT language, repo, year, CAST(sum(commits) AS BIGINT) AS total_commits, count(*) AS n_contributors,
         round(sum(commits) FILTER (r <= 1)::DOUBLE / sum(commits) * 100, 6) AS top1_pct,
         round(sum(commits) FILTER (r <= 3)::DOUBLE / sum(commits) * 100, 6) AS top3_pct,
         round(sum(commits) FILTER (r <= 5)::DOUBLE / sum(commits) * 100, 6) AS top5_pct
  FROM ranked GROUP BY language, repo, year)"""
ORACLES["author_concentration"] = f"WITH {CONCENTRATION} SELECT * FROM conc"
ORACLES["concentration_long"] = f"""WITH {CONCENTRATION}
SELECT language, repo, year, 'top1_pct' AS rank_group, top1_pct AS percent FROM conc UNION ALL
SELECT language, repo, year, 'top3_pct', top3_pct FROM conc UNION ALL
SELECT language, repo, year, 'top5_pct', top5_pct FROM conc"""


def gini(keys: str) -> str:
    return f"""{COMMITS}, counts AS (
  SELECT {keys}, author, count(*) AS x FROM commits GROUP BY {keys}, author),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x) AS i, count(*) OVER (PARTITION BY {keys}) AS m
  FROM counts),
ginis AS (
  SELECT {keys}, sum((2 * i - m - 1) * x)::DOUBLE / (count(*) * sum(x)) AS gini,
         count(*) AS n_contributors, CAST(sum(x) AS BIGINT) AS total_commits
  FROM placed GROUP BY {keys})"""


for _name, _keys in (("gini_library_year", "language, repo, year"), ("gini_language_year", "language, year")):
    ORACLES[_name] = f"""WITH {gini(_keys)}
SELECT {_keys}, round(gini, 6) AS gini, n_contributors, total_commits FROM ginis"""
ORACLES["gini_distribution"] = f"""WITH {gini("language, repo, year")}
SELECT language, round(quantile_cont(gini, 0.25), 6) AS q25, round(quantile_cont(gini, 0.5), 6) AS q50,
       round(quantile_cont(gini, 0.75), 6) AS q75, count(*) AS n_years FROM ginis GROUP BY language"""
RANKED = f"""{COMMITS}, counts AS (
  SELECT language, year, author, count(*) AS commits FROM commits GROUP BY ALL),
ranks AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY language, year
            ORDER BY commits DESC, md5(coalesce(author, '')), author NULLS FIRST) AS INTEGER) AS rank
  FROM counts)"""
ORACLES["author_rank"] = f"WITH {RANKED} SELECT * FROM ranks"
ORACLES["author_rank_top"] = f"WITH {RANKED} SELECT * FROM ranks WHERE rank <= 5"
TOP20 = f"""{AUTHOR_YEARS}, totals AS (
  SELECT author, CAST(sum(commits) AS BIGINT) AS total, rank() OVER (ORDER BY sum(commits) DESC) AS r
  FROM author_years GROUP BY author)"""
ORACLES["top_authors_ties"] = f"WITH {TOP20} SELECT author, total FROM totals WHERE r <= 20"
ORACLES["top_authors_latest"] = f"""WITH {AUTHOR_YEARS}
SELECT year, author, commits FROM author_years WHERE year = (SELECT max(year) FROM author_years)
ORDER BY commits DESC, author LIMIT 10"""
ORACLES["contributor_heatmap"] = f"""WITH {TOP20}
SELECT year, author, commits FROM author_years WHERE author IN (SELECT author FROM totals WHERE r <= 20)"""
ORACLES["contributor_totals"] = f"""WITH {AUTHOR_YEARS}
SELECT author, CAST(sum(commits) AS BIGINT) AS total_commits FROM author_years WHERE year = 1999 GROUP BY author"""
ORACLES["max_commits_order"] = f"""WITH {AUTHOR_YEARS}
SELECT author, max(commits) AS max_commits FROM author_years GROUP BY author"""

# ---- trends and packages ------------------------------------------------------------

ORACLES["trend_tests"] = f"""WITH {ACTIVITY},
long AS (SELECT 'commits' AS measure, year::DOUBLE AS x, commits::DOUBLE AS y FROM activity UNION ALL
         SELECT 'maintainers', year, maintainers FROM activity UNION ALL
         SELECT 'commits_per_maintainer', year, commits_per_maintainer FROM activity),
fit AS (SELECT measure, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
               regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM long GROUP BY measure),
t AS (SELECT *, n - 2 AS v, atan(abs(slope / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)) / sqrt(n - 2.0)) AS a
      FROM fit),
s AS (SELECT *, list_sum(list_transform(range(1, CAST(v // 2 + 1 AS BIGINT)), lambda k:
          CASE WHEN v % 2 = 1
               THEN pow(cos(a), 2 * k - 1) * list_product(list_concat([1.0::DOUBLE],
                    list_transform(range(1, k), lambda j: 2.0::DOUBLE * j / (2 * j + 1))))
               ELSE pow(cos(a), 2 * k - 2) * list_product(list_concat([1.0::DOUBLE],
                    list_transform(range(1, k), lambda j: (2.0::DOUBLE * j - 1) / (2 * j)))) END)) AS series
      FROM t)
SELECT measure, n, round(slope, 6) AS slope, round(intercept, 4) AS intercept,
       round(CASE WHEN v % 2 = 1 THEN 1 - 2 / pi() * (a + sin(a) * coalesce(series, 0))
                  ELSE 1 - sin(a) * coalesce(series, 0) END, 6) AS p_value FROM s"""
ORACLES["smooth_lines"] = f"""WITH {ACTIVITY},
f AS (SELECT regr_slope(commits, year) AS b, regr_intercept(commits, year) AS a FROM activity)
SELECT year, commits, round(a + b * year, 4) AS fitted FROM activity, f"""
ORACLES["fix_ratio_trend"] = f"""WITH {COMMITS},
y AS (SELECT language, year, count(*) FILTER (category <> {text(V.FEATURE)}) AS bug_fixes,
             count(*) FILTER (category = {text(V.FEATURE)}) AS other_commits FROM commits GROUP BY language, year),
r AS (SELECT *, CASE WHEN other_commits > 0 THEN bug_fixes::DOUBLE / other_commits ELSE bug_fixes END AS ratio,
             CAST(row_number() OVER (PARTITION BY language ORDER BY year) AS INTEGER) AS idx FROM y),
f AS (SELECT language, regr_slope(ratio, idx) AS b, regr_intercept(ratio, idx) AS a FROM r GROUP BY language)
SELECT language, year, bug_fixes, other_commits, round(ratio, 6) AS bug_fix_ratio, idx,
       round(a + b * idx, 6) AS trend_line FROM r JOIN f USING (language)"""
ORACLES["first_last_change"] = f"""WITH {ACTIVITY},
e AS (SELECT first(commits ORDER BY year) AS c1, last(commits ORDER BY year) AS c2,
             first(maintainers ORDER BY year) AS m1, last(maintainers ORDER BY year) AS m2,
             first(commits_per_maintainer ORDER BY year) AS p1, last(commits_per_maintainer ORDER BY year) AS p2,
             min(year) AS y1, max(year) AS y2 FROM activity)
SELECT y1 || '–' || y2 AS years, round(100 * (c2 - c1)::DOUBLE / c1, 1) AS commits_change,
       round(100 * (m2 - m1)::DOUBLE / m1, 1) AS maintainers_change,
       round(100 * (p2 - p1) / p1, 1) AS commits_per_maintainer_change FROM e"""
ORACLES["grouped_regression"] = """WITH fit AS (
  SELECT p_type AS language, regr_slope(p_retailprice, p_size) AS slope, regr_intercept(p_retailprice, p_size) AS intercept,
         regr_r2(p_retailprice, p_size) AS r2, regr_count(p_retailprice, p_size) AS n, regr_sxx(p_retailprice, p_size) AS sxx,
         regr_syy(p_retailprice, p_size) AS syy, regr_sxy(p_retailprice, p_size) AS sxy
  FROM part GROUP BY p_type),
t AS (SELECT *, n - 2 AS v, CASE WHEN n >= 3 AND sxx > 0 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) END AS se,
             n >= 3 AND sxx > 0 AND syy - sxy * sxy / sxx > syy * 1e-14 AS usable FROM fit),
a AS (SELECT *, CASE WHEN usable THEN atan(abs(slope / se) / sqrt(n - 2.0)) END AS a FROM t),
s AS (SELECT *, CASE WHEN usable THEN list_sum(list_transform(range(1, CAST(v // 2 + 1 AS BIGINT)), lambda k:
          CASE WHEN v % 2 = 1
               THEN pow(cos(a), 2 * k - 1) * list_product(list_concat([1.0::DOUBLE],
                    list_transform(range(1, k), lambda j: 2.0::DOUBLE * j / (2 * j + 1))))
               ELSE pow(cos(a), 2 * k - 2) * list_product(list_concat([1.0::DOUBLE],
                    list_transform(range(1, k), lambda j: (2.0::DOUBLE * j - 1) / (2 * j)))) END)) END AS series
      FROM a)
SELECT language, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, n,
       round(se, 6) AS slope_error,
       round(CASE WHEN NOT usable THEN NULL WHEN v % 2 = 1 THEN 1 - 2 / pi() * (a + sin(a) * coalesce(series, 0))
                  ELSE 1 - sin(a) * coalesce(series, 0) END, 6) AS p_value FROM s"""
DEGREES = """edges AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem),
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
ins AS (SELECT dst AS node, count(*) AS n_in FROM edges GROUP BY dst),
outs AS (SELECT src AS node, count(*) AS n_out FROM edges GROUP BY src),
degrees AS (
  SELECT node, coalesce(n_in, 0) AS in_degree, coalesce(n_out, 0) AS out_degree,
         round(coalesce(n_in, 0)::DOUBLE / ((SELECT count(*) FROM nodes) - 1), 6) AS in_degree_centrality,
         round(coalesce(n_out, 0)::DOUBLE / ((SELECT count(*) FROM nodes) - 1), 6) AS out_degree_centrality
  FROM nodes LEFT JOIN ins USING (node) LEFT JOIN outs USING (node))"""
ORACLES["degree_centrality"] = f"WITH {DEGREES} SELECT * FROM degrees"
ORACLES["top_packages"] = f"""WITH {DEGREES}
SELECT node AS package, * EXCLUDE (node) FROM degrees ORDER BY out_degree DESC, node LIMIT 10"""
PACKAGE_DOCS = """docs AS (
  SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_size END, 0)::BIGINT AS stars,
         coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_size * 2 END, 0)::BIGINT AS forks,
         coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_brand END, 'N/A') AS language, 0::BIGINT AS contributors_count
  FROM part)"""
ORACLES["central_package_docs"] = f"""WITH {DEGREES}, {PACKAGE_DOCS}
SELECT node AS package, degrees.* EXCLUDE (node), docs.* EXCLUDE (p_partkey)
FROM degrees LEFT JOIN docs ON node = 'p' || p_partkey"""
ORACLES["package_join"] = f"""WITH {PACKAGE_DOCS}
SELECT 'p' || part.p_partkey AS package, p_size AS sourcerank, stars, forks, language, contributors_count
FROM part LEFT JOIN docs USING (p_partkey)"""

# ---- predictions --------------------------------------------------------------------


def needle_case(column: str) -> str:
    exact = " ".join(f"WHEN {column} = {text(c.lower())} THEN {text(c)}" for c in V.CATEGORIES)
    needles = " ".join(
        "WHEN " + " OR ".join(f"contains({column}, {text(w)})" for w in words) + f" THEN {text(category)}"
        for category, words in V.PREDICTION_NEEDLES
    )
    return f"CASE {exact} {needles} ELSE {text(V.LOGIC)} END"


RESPONSES = f"""{COMMITS}, answers AS (
  SELECT *, '{{' || {pick(A.ANSWER_CATEGORIES, "n")} || {pick(A.ANSWER_COMPLEXITIES, "n")}
         || '"feat":' || {pick(A.ANSWER_FEATURES, "n")}
         || CASE WHEN n % 5 <> 0 THEN ',"reas":"r' || n || '"' ELSE '' END
         || ',"sec":' || CASE WHEN n % 2 = 0 THEN '"1"' ELSE 'false' END || '}}' AS answer
  FROM commits),
texts AS (
  SELECT *, CASE n % 23 WHEN 3 THEN '{{"cat":' WHEN 4 THEN '[1]' WHEN 6 THEN answer || ' ok thanks'
            WHEN 7 THEN '```json' || chr(10) || answer || chr(10) || '```' ELSE answer END AS answer_text,
         '{{"key":"' || CASE WHEN n % 23 = 5 THEN 'nokey' ELSE language || '_' || repo || '_' || commit_id END
         || '"' AS head
  FROM answers),
lines AS (
  SELECT CASE n % 23 WHEN 0 THEN '  ' WHEN 1 THEN head || ',"response":'
         WHEN 2 THEN head || ',"response":{{"candidates":[]}}}}' WHEN 8 THEN head || '}}'
         ELSE head || ',"response":{{"candidates":[{{"content":{{"parts":[{{"text":"'
              || replace(replace(answer_text, '"', chr(92) || '"'), chr(10), chr(92) || 'n')
              || '"}}]}}}}]}}}}' END AS line
  FROM texts),
outers AS (SELECT CASE WHEN json_valid(line) THEN line::JSON END AS o, line FROM lines),
inners AS (
  SELECT o, line, trim(replace(replace(json_extract_string(o, '$.response.candidates[0].content.parts[0].text'),
              '```json', ''), '```', ''), {WS}) AS t FROM outers),
parsed AS (
  SELECT line, o, json_extract_string(o, '$.key') AS key, CASE WHEN json_valid(t) THEN t::JSON END AS a,
         json_array_length(o, '$.response.candidates') AS n_candidates FROM inners),
predictions AS (
  SELECT CASE WHEN contains(key, '_') THEN string_split(key, '_')[1] ELSE 'unknown' END AS language,
         CASE WHEN contains(key, '_') THEN string_split(key, '_')[2] ELSE 'unknown' END AS repo,
         CASE WHEN contains(key, '_') THEN string_split(key, '_')[3] ELSE key END AS commit_id,
         CASE WHEN json_type(a, '$.cat') = 'NULL' THEN 'none'
              ELSE trim(lower(coalesce(json_extract_string(a, '$.cat'), 'Logic & Correctness'))) END AS cat,
         coalesce(lower(json_extract_string(a, '$.feat')) IN ('true', '1'), false) AS is_feature,
         coalesce(lower(json_extract_string(a, '$.sec')) IN ('true', '1'), false) AS is_security,
         CAST(CASE WHEN json_type(a, '$.comp') IN ('UBIGINT', 'BIGINT')
                   OR (json_type(a, '$.comp') = 'VARCHAR' AND regexp_full_match(json_extract_string(a, '$.comp'), '[0-9]+'))
                   THEN least(5, greatest(1, CAST(json_extract_string(a, '$.comp') AS BIGINT)))
              WHEN json_type(a, '$.comp') = 'DOUBLE'
                   THEN least(5, greatest(1, trunc(CAST(json_extract_string(a, '$.comp') AS DOUBLE))))
              ELSE 1 END AS INTEGER) AS complexity,
         coalesce(json_extract_string(a, '$.reas'), '') AS reasoning
  FROM parsed WHERE json_type(a) = 'OBJECT'),
predicted AS (SELECT * EXCLUDE (cat), {needle_case("cat")} AS category FROM predictions)"""
ORACLES["parse_predictions"] = f"WITH {RESPONSES} SELECT * FROM predicted"
ORACLES["unusable_answers"] = f"""WITH {RESPONSES}
SELECT CASE WHEN o IS NOT NULL AND (n_candidates = 0 OR (a IS NOT NULL AND json_type(a) <> 'OBJECT'))
            THEN 'quarantined' ELSE 'dropped' END AS status, count(*) AS n
FROM parsed WHERE trim(line) <> '' AND (a IS NULL OR json_type(a) <> 'OBJECT') GROUP BY ALL"""
ORACLES["predicted_library_focus"] = f"""WITH {RESPONSES},
t AS (SELECT language, repo, count(*) AS total FROM predicted GROUP BY ALL)
SELECT language || ' / ' || repo AS library, category, count(*) AS n,
       round(count(*)::DOUBLE / any_value(total), 6) AS share
FROM predicted JOIN t USING (language, repo) GROUP BY language, repo, category"""
_SIZES = SIZED[len(COMMITS) + 2 :]
ORACLES["scored_predictions"] = f"""WITH {RESPONSES}, {_SIZES}
SELECT language, repo, commit_id, p.category, p.complexity, entropy, churn,
       round(p.complexity + 0.5::DOUBLE * log10(greatest(1, coalesce(entropy, 1))::DOUBLE)
             + 0.5::DOUBLE * log10(greatest(1, coalesce(churn, 1))::DOUBLE), 6) AS ccs_score, year
FROM predicted p JOIN sized USING (language, repo, commit_id)"""
ORACLES["maintenance_ccs_by_year"] = f"""WITH {SCORED}
SELECT language, year, round(avg(ccs), 6) AS avg_ccs_score, count(*) AS n_commits
FROM scored WHERE category <> {text(V.FEATURE)} GROUP BY language, year HAVING count(*) >= 3"""
ORACLES["maintenance_ccs_by_category_year"] = f"""WITH {SCORED}
SELECT language, category, year, round(avg(ccs), 6) AS avg_ccs_score, count(*) AS n_commits
FROM scored WHERE category <> {text(V.FEATURE)} AND ccs IS NOT NULL
GROUP BY language, category, year HAVING count(*) >= 3"""
ORACLES["maintenance_burden"] = f"""WITH {SCORED}
SELECT language, repo, round(sum(ccs), 4) AS burden, count(*) AS n_commits
FROM scored WHERE category <> {text(V.FEATURE)} GROUP BY language, repo"""
ORACLES["ccs_quartiles"] = f"""WITH {SCORED}
SELECT language, round(quantile_cont(ccs, 0.25), 6) AS q25, round(quantile_cont(ccs, 0.5), 6) AS q50,
       round(quantile_cont(ccs, 0.75), 6) AS q75 FROM scored GROUP BY language"""
ORACLES["library_summary"] = f"""WITH {COMMITS}
SELECT language, repo, count(*) AS total_commits, min(year) || '–' || max(year) AS year_range,
       round(count(*)::DOUBLE / (max(year) - min(year) + 1), 2) AS avg_commits_per_year
FROM commits GROUP BY language, repo ORDER BY total_commits DESC, language, repo LIMIT 10"""

# ---- labels -------------------------------------------------------------------------

LABELS = f"""raw_labels AS (
  SELECT doc_id AS k, CAST(doc_id AS VARCHAR) AS commit_id, d.text || chr(13) || chr(10) AS message,
         CASE WHEN doc_id % 10 <> 9 THEN {pick(A.RAW_LABELS, "doc_id")} END AS label_category,
         CASE WHEN toxic = 1 THEN 'TRUE' WHEN doc_id % 3 = 0 THEN 'False' ELSE '0' END AS label_is_security,
         CASE WHEN quality = 0 THEN 'FALSE ' WHEN doc_id % 2 = 0 THEN 'TRUE' ELSE ' yes' END AS label_is_feature,
         {pick(A.RAW_COMPLEXITIES, "doc_id")} AS label_complexity,
         CASE WHEN doc_id % 13 = 0 THEN '  ' WHEN doc_id % 11 <> 0 THEN d.text END AS label_reasoning,
         chr(10) || d.text AS diff_preview,
         CASE WHEN doc_id % 2 = 0 THEN 'C' ELSE 'Rust' END AS language_inferred, source AS file
  FROM documents d JOIN labels USING (doc_id))"""
_ALIASES = " ".join(
    f"WHEN lower(trim(label_category, {WS})) = {text(k.lower())} THEN {text(v)}" for k, v in V.LABEL_ALIASES.items()
)
_ONE_LINE = f"replace(trim(replace(coalesce(label_reasoning, ''), chr(13) || chr(10), chr(10)), {WS}), chr(10), ' ')"
_WORDS = f"string_split_regex({_ONE_LINE}, {text('[' + V.PY_WHITESPACE + ']+')})"
CLEANED = f"""{LABELS}, cleaned AS (
  SELECT commit_id, trim(replace(message, chr(13) || chr(10), chr(10)), {WS}) AS message,
         trim(replace(diff_preview, chr(13) || chr(10), chr(10)), {WS}) AS diff_preview, language_inferred,
         CASE {_ALIASES} WHEN trim(label_category, {WS}) IN {"(" + listing(V.CATEGORIES)[1:-1] + ")"}
              THEN trim(label_category, {WS}) ELSE {text(V.BUILD)} END AS cat,
         trim(upper(label_is_feature)) IN ('TRUE', '1', 'T', 'YES', 'Y') AS feat,
         trim(upper(label_is_security)) IN ('TRUE', '1', 'T', 'YES', 'Y') AS sec,
         coalesce(CAST(trunc(TRY_CAST(label_complexity AS DOUBLE)) AS BIGINT), 1) AS comp,
         CASE WHEN len({_WORDS}) > 15 THEN array_to_string({_WORDS}[1:15], ' ') || '...' ELSE {_ONE_LINE} END AS reas
  FROM raw_labels WHERE trim(coalesce(label_category, ''), {WS}) <> '')"""
ORACLES["clean_labels"] = f"WITH {CLEANED} SELECT * EXCLUDE (language_inferred) FROM cleaned"
ORACLES["tuning_rows"] = f"""WITH {CLEANED}
SELECT {text(INSTRUCTION)} AS instruction, 'user' AS first_role,
       'Lang: ' || language_inferred || ' Msg: ' || message || chr(10) || 'Diff:' || chr(10) || diff_preview AS user_text,
       cat, CAST(feat AS VARCHAR) AS feat, CAST(comp AS VARCHAR) AS comp, reas FROM cleaned"""
ORACLES["synthetic_ids"] = f"""WITH {LABELS},
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k DESC) AS r FROM raw_labels)
SELECT file, k AS ordinal, CASE WHEN r <= 3 THEN sha1('synth:' || file || ':' || commit_id) ELSE commit_id END AS commit_id,
       r <= 3 AS is_synthetic_commit_id FROM r"""
ORACLES["merge_labels"] = f"""WITH {LABELS}
SELECT commit_id, CASE WHEN k % 2 = 0 THEN 'C' ELSE 'Rust' END AS language_inferred, label_category,
       CASE WHEN k % 2 = 0 THEN label_reasoning END AS label_reasoning FROM raw_labels"""
ORACLES["label_counts"] = f"WITH {LABELS} SELECT label_category, count(*) AS n FROM raw_labels GROUP BY ALL"
REASONS = f"""{LABELS}, totals AS (
  SELECT label_category, count(*) AS total,
         count(*) FILTER (trim(coalesce(label_reasoning, ''), {WS}) = '') AS missing
  FROM raw_labels WHERE label_category IS NOT NULL GROUP BY label_category)"""
ORACLES["reason_summary"] = f"WITH {REASONS} SELECT * FROM totals"
ORACLES["reasons_by_label"] = f"""WITH {REASONS}
SELECT commit_id, label_category, label_reasoning, total, missing,
       trim(coalesce(label_reasoning, ''), {WS}) = '' AS is_missing FROM raw_labels JOIN totals USING (label_category)"""


def compared(trimmed: bool) -> str:
    t = (lambda c: f"trim({c})") if trimmed else (lambda c: c)
    return f"""both_sides AS (
  SELECT CAST(doc_id AS VARCHAR) AS commit_id,
         CASE WHEN doc_id % 3 = 0 THEN {pick(V.CATEGORIES, "doc_id")} ELSE {text(V.BUILD)} END AS label_category,
         CASE WHEN toxic = 1 THEN 'TRUE' ELSE 'False' END AS label_is_security,
         CASE WHEN quality = 1 THEN 'TRUE' WHEN doc_id % 2 = 0 THEN 'FALSE ' ELSE 'FALSE' END AS label_is_feature,
         CAST(1 + doc_id % 5 AS VARCHAR) AS label_complexity,
         CASE WHEN n_chars % 4 = 0 THEN {pick(V.CATEGORIES, "n_chars")} ELSE {text(V.BUILD)} END AS model_category,
         CASE WHEN toxic = 1 OR n_chars % 9 = 0 THEN 'True' ELSE 'False' END AS model_is_security,
         CASE WHEN quality = 1 AND n_chars % 3 <> 0 THEN 'True' ELSE 'False' END AS model_is_feature,
         (1 + n_chars % 5) || '.0' AS model_complexity
  FROM documents JOIN labels USING (doc_id)),
compared AS (
  SELECT *, label_category = model_category AS category_match,
         lower({t("label_is_security")}) = lower({t("model_is_security")}) AS is_security_match,
         lower({t("label_is_feature")}) = lower({t("model_is_feature")}) AS is_feature_match,
         label_complexity::DOUBLE = model_complexity::DOUBLE AS complexity_match,
         model_complexity::DOUBLE - label_complexity::DOUBLE AS error
  FROM both_sides)"""


ORACLES["gold_vs_model"] = f"WITH {compared(False)} SELECT * EXCLUDE (error) FROM compared"
ORACLES["gold_vs_model_trimmed"] = f"WITH {compared(True)} SELECT * EXCLUDE (error) FROM compared"
ORACLES["label_agreement"] = f"""WITH {compared(False)}
SELECT count(*) AS n, round(avg(category_match::INT), 6) AS category_agreement,
       round(avg(is_security_match::INT), 6) AS security_agreement,
       round(avg(is_feature_match::INT), 6) AS feature_agreement,
       round(avg(complexity_match::INT), 6) AS complexity_agreement,
       round(avg((abs(error) <= 1)::INT), 6) AS complexity_within_one,
       round(avg(abs(error)), 6) AS complexity_mae, round(avg(error), 6) AS complexity_bias FROM compared"""
ORACLES["confusion"] = f"""WITH {compared(False)}
SELECT label_category, model_category, count(*) AS n FROM compared GROUP BY ALL"""
TOTALS = f"""{compared(False)}, names AS (
  SELECT label_category AS category FROM compared UNION SELECT model_category FROM compared),
per_category AS (
  SELECT category, (SELECT count(*) FROM compared WHERE label_category = category) AS labelled,
         (SELECT count(*) FROM compared WHERE model_category = category) AS predicted,
         (SELECT count(*) FROM compared WHERE label_category = category AND category_match) AS correct FROM names)"""
ORACLES["category_totals"] = f"WITH {TOTALS} SELECT * FROM per_category"
ORACLES["category_kappa"] = f"""WITH {TOTALS},
k AS (SELECT sum(correct)::DOUBLE / sum(labelled) AS o,
             sum(labelled::DOUBLE * predicted) / (sum(labelled)::DOUBLE * sum(labelled)) AS e FROM per_category)
SELECT round(o, 6) AS observed, round(e, 6) AS chance, round((o - e) / (1 - e), 6) AS kappa FROM k"""
ORACLES["majority_vote"] = f"""WITH {COMMITS},
votes AS (SELECT commit_id, 1 AS p, category AS label FROM commits UNION ALL
          SELECT commit_id, 2, CASE WHEN n % 3 = 0 THEN {text(V.LOGIC)} ELSE category END FROM commits UNION ALL
          SELECT commit_id, 3, {pick(V.CATEGORIES, "n")} FROM commits),
c AS (SELECT commit_id, label, count(*) AS votes, min(p) AS p FROM votes GROUP BY commit_id, label),
r AS (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY votes DESC, p) AS r FROM c)
SELECT commit_id, label, votes FROM r WHERE r = 1"""

# ---- diffs --------------------------------------------------------------------------

NL = "chr(10)"
DIFFS = f"""doc_lines AS (
  SELECT doc_id AS k, source, lang, text,
         CASE WHEN doc_id % 5 = 4 THEN string_split(replace(text, {NL}, ' '), ' ') ELSE string_split(text, {NL}) END AS lines
  FROM documents),
bodies AS (
  SELECT *, list_transform(lines, lambda x, i: CASE WHEN k % 7 = 0 THEN '+use ' WHEN k % 2 = 0 AND i > 12 THEN ' '
              ELSE ['+', '-', ' '][CAST((i - 1) % 3 AS BIGINT) + 1] END || x) AS body,
         CASE WHEN k % 9 = 5 THEN 'docs/' ELSE 'src/' END || source || '/f' || k || {pick(A.PATH_SUFFIXES, "k")} AS path
  FROM doc_lines),
sized_bodies AS (
  SELECT *, CASE WHEN k % 11 = 2 THEN 'moved/' ELSE '' END || path AS target,
         len(list_filter(body, lambda x: x[1] = '+')) AS plus, len(list_filter(body, lambda x: x[1] = '-')) AS minus,
         len(list_filter(body, lambda x: x[1] = ' ')) AS same FROM bodies),
diffs AS (
  SELECT k, CAST(k AS VARCHAR) AS commit_id, CASE WHEN k % 2 = 0 THEN 'c' ELSE 'rust' END AS language,
         source AS repo, text AS message,
         CASE WHEN k % 37 = 5 THEN NULL WHEN k % 31 = 7 THEN ' ' || {NL} ELSE
           'diff --git a/' || path || ' b/' || target || {NL}
           || CASE k % 11 WHEN 0 THEN 'new file mode 100644' || {NL} WHEN 1 THEN 'deleted file mode 100644' || {NL} ELSE '' END
           || '--- ' || CASE WHEN k % 11 = 0 THEN '/dev/null' ELSE 'a/' || path END || {NL}
           || '+++ ' || CASE WHEN k % 11 = 1 THEN '/dev/null' ELSE 'b/' || target END || {NL}
           || '@@ -1,' || (same + minus + CASE WHEN k % 29 = 3 THEN 1 ELSE 0 END) || ' +1,' || (same + plus) || ' @@' || {NL}
           || array_to_string(body, {NL}) || {NL}
           || CASE WHEN k % 3 = 0 THEN
                'diff --git a/include/h' || k || '.h b/include/h' || k || '.h' || {NL}
                || '--- a/include/h' || k || '.h' || {NL} || '+++ b/include/h' || k || '.h' || {NL}
                || '@@ -0,0 +1,' || len(lines) || ' @@' || {NL}
                || array_to_string(list_transform(lines, lambda x: '+' || x), {NL}) || {NL} ELSE '' END
         END AS diff,
         CASE WHEN k % 37 = 5 OR k % 31 = 7 THEN NULL ELSE k % 29 = 3 END AS broken FROM sized_bodies)"""
LINES = f"""{DIFFS}, numbered AS (
  SELECT k, commit_id, pos, string_split(diff, {NL})[pos] AS line
  FROM (SELECT *, unnest(range(1, len(string_split(diff, {NL})) + 1)) AS pos FROM diffs WHERE diff IS NOT NULL)),
in_files AS (
  SELECT *, sum(starts_with(line, 'diff --git ')::INT) OVER (PARTITION BY k ORDER BY pos) AS file_no FROM numbered),
in_hunks AS (
  SELECT *, sum(regexp_matches(line, '^@@ -[0-9]')::INT) OVER (PARTITION BY k, file_no ORDER BY pos) AS hunk_no
  FROM in_files WHERE file_no > 0),
paths AS (
  SELECT k, file_no,
         coalesce(max(CASE WHEN hunk_no = 0 AND starts_with(line, '--- ') THEN substr(line, 5) END), '') AS old_path,
         coalesce(max(CASE WHEN hunk_no = 0 AND starts_with(line, '+++ ') THEN substr(line, 5) END), '') AS new_path,
         bool_or(line LIKE '@@ -0,0 %' AND hunk_no = 1) AS zero
  FROM in_hunks GROUP BY k, file_no),
files AS (
  SELECT k, file_no, CASE WHEN old_path = '/dev/null' OR (new_path <> '/dev/null' AND old_path[3:] <> new_path[3:])
              THEN new_path[3:] ELSE old_path[3:] END AS path,
         CASE WHEN new_path = '/dev/null' THEN '[DELETED]' WHEN old_path = '/dev/null' OR zero THEN '[NEW]'
              WHEN old_path[3:] <> new_path[3:] THEN '[RENAMED]' ELSE '' END AS tag
  FROM paths),
content AS (
  SELECT *, row_number() OVER (PARTITION BY k, file_no, hunk_no ORDER BY pos) AS line_no,
         count(*) OVER (PARTITION BY k, file_no, hunk_no) AS n_lines,
         CASE line[1] WHEN '+' THEN 'added' WHEN '-' THEN 'removed' ELSE 'context' END AS kind
  FROM in_hunks WHERE hunk_no > 0 AND NOT regexp_matches(line, '^@@ -[0-9]') AND line <> '')"""
_NOISE = " OR ".join(f"ends_with(lower(path), {text(s)})" for s in V.NOISE_SUFFIXES)
_ARTIFACT = " OR ".join(
    [f"contains(lower(path), {text(w)})" for w in V.ARTIFACT_WORDS]
    + [f"starts_with(lower(path), {text(w)})" for w in V.ARTIFACT_FOLDERS]
)
CLASSES = f"""{LINES}, classed AS (
  SELECT files.*, CASE WHEN {_NOISE} THEN 'noise' WHEN NOT ({_ARTIFACT}) THEN 'code'
              WHEN contains(lower(path), 'changelog') OR contains(lower(path), 'news') THEN 'log' ELSE 'artifact' END AS file_kind
  FROM files),
sums AS (
  SELECT k, file_no, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed
  FROM content GROUP BY k, file_no)"""
# The declared size of a broken hunk never matches, so its counts are zero.
_KNOWN = "CASE WHEN k % 29 = 3 AND file_no = 1 THEN 0 ELSE {} END"


def change_counts(column: str) -> str:
    added = f"""len(list_filter(string_split({column}, {NL}), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')
                 AND length(x) > 1 AND NOT regexp_matches(x[2:], '^\\s*@@')))"""
    removed = f"""len(list_filter(string_split({column}, {NL}), lambda x: starts_with(x, '-') AND NOT starts_with(x, '--')
                 AND length(x) > 1 AND NOT regexp_matches(x[2:], '^\\s*@@')))"""
    return f"{added} AS lines_added, {removed} AS lines_removed"


ORACLES["line_counts"] = f"WITH {DIFFS} SELECT commit_id, language, repo, {change_counts('diff')} FROM diffs"
ORACLES["file_changes"] = f"""WITH {DIFFS},
chunks AS (SELECT commit_id, language, repo, unnest(string_split(diff, 'diff --git')) AS chunk FROM diffs)
SELECT commit_id, language, repo, nullif(regexp_extract(chunk, '\\+\\+\\+ b/(\\S+)', 1), '') AS file, {change_counts('chunk')}
FROM chunks WHERE contains(chunk, '+++ b/')"""
ORACLES["diff_lines"] = f"""WITH {LINES}
SELECT commit_id, CAST(file_no AS INTEGER) AS file_no, CAST(hunk_no AS INTEGER) AS hunk_no, path, kind,
       count(*) AS n_lines, CAST(max(line_no) AS INTEGER) AS last_line, CAST(sum(length(line)) AS BIGINT) AS n_chars
FROM content JOIN files USING (k, file_no) WHERE NOT (k % 29 = 3 AND file_no = 1)
GROUP BY commit_id, file_no, hunk_no, path, kind"""
STATS = f"""SELECT commit_id, CAST(CASE WHEN diff IS NULL THEN NULL ELSE count(file_no) END AS INTEGER) AS entropy,
       CASE WHEN diff IS NULL THEN NULL
            ELSE CAST(coalesce(sum({_KNOWN.format("added + removed")}), 0) AS BIGINT) END AS churn
FROM diffs LEFT JOIN sums USING (k) GROUP BY commit_id, diff"""
ORACLES["commit_stats"] = f"WITH {CLASSES} {STATS}"
ORACLES["file_kinds"] = f"""WITH {CLASSES}
SELECT CAST(k AS VARCHAR) AS commit_id, CAST(file_no AS INTEGER) AS file_no, path, tag, file_kind,
       {_KNOWN.format("added")} AS lines_added, {_KNOWN.format("removed")} AS lines_removed
FROM classed JOIN sums USING (k, file_no)"""
CONDENSED = f"""{CLASSES}, tokens AS (
  SELECT k, file_no, hunk_no, regexp_extract(trim(line[2:], {WS}), {text('^[^' + V.PY_WHITESPACE + ']+')}) AS token
  FROM content WHERE kind = 'added'),
modes AS (
  SELECT k, file_no, hunk_no, max(n) AS n FROM (
    SELECT k, file_no, hunk_no, token, count(*) AS n FROM tokens WHERE token <> '' GROUP BY ALL) GROUP BY ALL),
hunks AS (
  SELECT k, file_no, hunk_no, any_value(n_lines) AS n_lines,
         count(*) FILTER (kind = 'added') >= 20
           AND coalesce(any_value(modes.n), 0)::DOUBLE / count(*) FILTER (kind = 'added') > 0.8::DOUBLE AS repetitive,
         count(*) FILTER (kind <> 'context' AND line_no > 10 AND line_no <= n_lines - 10) AS middle_changes
  FROM content LEFT JOIN modes USING (k, file_no, hunk_no) GROUP BY k, file_no, hunk_no),
rules AS (
  SELECT k, file_no, hunk_no, file_kind, path, tag,
         CASE WHEN file_kind = 'log' AND n_lines > 50 THEN 10
              WHEN file_kind = 'code' AND repetitive THEN 5
              WHEN file_kind = 'code' AND n_lines > 50 AND (middle_changes < 5 OR n_lines > 200) THEN 10 END AS keep,
         CASE WHEN file_kind = 'log' THEN ' LINES OF LOG' WHEN repetitive THEN ' REPETITIVE LINES'
              ELSE ' LINES OF CONTEXT/BODY' END AS note
  FROM hunks JOIN classed USING (k, file_no)),
shown AS (
  SELECT k, file_no, hunk_no, line_no AS ord,
         CASE WHEN keep IS NOT NULL AND line_no = keep + 1
              THEN '   ... [SNIPPED ' || (n_lines - 2 * keep) || note || '] ...'
              WHEN file_kind = 'artifact' AND line_no = 4 THEN '   ... [REMAINING ARTIFACT SKIPPED] ...'
              WHEN file_kind = 'artifact' THEN '   ' || rtrim(line, {WS}) ELSE rtrim(line, {WS}) END AS out
  FROM content JOIN rules USING (k, file_no, hunk_no)
  WHERE CASE file_kind WHEN 'noise' THEN false WHEN 'artifact' THEN hunk_no = 1 AND line_no <= 4
        ELSE keep IS NULL OR line_no <= keep + 1 OR line_no > n_lines - keep END
  UNION ALL
  SELECT k, file_no, hunk_no, 4, '   ... [REMAINING ARTIFACT SKIPPED] ...' FROM rules JOIN hunks USING (k, file_no, hunk_no)
  WHERE file_kind = 'artifact' AND hunk_no = 1 AND n_lines <= 3
  UNION ALL
  SELECT k, file_no, 0, 0, 'File: ' || path || CASE tag WHEN '' THEN '' ELSE ' ' || tag END
         || CASE file_kind WHEN 'noise' THEN ' (Binary/Asset - Content Skipped)'
            WHEN 'artifact' THEN ' (Build/Doc Artifact - ' || added || ' lines added, ' || removed || ' lines removed)'
            ELSE '' END FROM classed JOIN sums USING (k, file_no)),
joined AS (SELECT k, string_agg(out, {NL} ORDER BY file_no, hunk_no, ord) AS full_text FROM shown GROUP BY k),
condensed AS (
  SELECT commit_id, language, repo, message, diff AS raw,
         CASE WHEN diff IS NULL THEN NULL WHEN trim(diff, {WS}) = '' THEN {text(V.EMPTY_DIFF)}
              WHEN broken THEN left(diff, 1000) || {text(V.BROKEN_END)}
              WHEN length(full_text) > 40000 THEN left(full_text, 40000) || {text(V.TOO_LONG_END)}
              ELSE full_text END AS diff
  FROM diffs LEFT JOIN joined USING (k))"""
ORACLES["condensed_diff"] = f"WITH {CONDENSED} SELECT commit_id, diff FROM condensed"
ORACLES["condensed_history"] = f"""WITH {CONDENSED}, stats AS ({STATS})
SELECT commit_id, entropy, churn, trim(message, {WS}) AS message, coalesce(diff, '') AS diff
FROM condensed JOIN stats USING (commit_id)"""
ORACLES["truncation_ratio"] = f"""WITH {CONDENSED}
SELECT language, CAST(sum(length(raw)) AS BIGINT) AS raw_chars, CAST(sum(length(diff)) AS BIGINT) AS condensed_chars,
       round(1 - sum(length(diff))::DOUBLE / sum(length(raw)), 6) AS reduction FROM condensed GROUP BY language"""
ORACLES["request_rows"] = f"""WITH {CONDENSED}
SELECT language || '_' || repo || '_' || commit_id AS key, {text(INSTRUCTION)} AS instruction,
       'Lang: ' || language || ' Msg: ' || trim(message, {WS}) || {NL} || 'Diff:' || {NL} || coalesce(diff, '') AS text
FROM condensed"""

# ---- sampling and scalar functions --------------------------------------------------

_FREQUENT = " OR ".join(f"contains(lower(message), {text(w)})" for w in FREQUENT_WORDS)
ORACLES["gold_sample"] = f"""WITH {DIFFS},
h AS (SELECT *, md5('42:' || commit_id) AS h, coalesce({_FREQUENT}, false)
             OR coalesce(contains(lower(diff), 'unsafe'), false) AS hit FROM diffs),
r AS (SELECT *, row_number() OVER (PARTITION BY language, repo ORDER BY h)
             <= round_even(count(*) OVER (PARTITION BY language, repo) * 0.1::DOUBLE, 0) AS drawn FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY language, repo ORDER BY CASE WHEN drawn THEN 0 ELSE 1 END, h) AS rank
      FROM r WHERE drawn OR hit)
SELECT language, repo, commit_id, CAST(rank AS INTEGER) AS sample_rank, drawn AS is_random FROM f WHERE rank <= 12"""
def naive_bayes(examples: str) -> str:
    """Tables up to `best` (doc_id, predicted), trained on the labelled ids of a query."""
    return f"""ex AS ({examples}),
w AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word
      FROM documents) WHERE word <> ''),
c AS (SELECT label, word, count(*) AS n FROM w JOIN ex USING (doc_id) GROUP BY ALL),
top AS (SELECT word FROM c GROUP BY word ORDER BY sum(n) DESC, word LIMIT 4096),
l AS (SELECT label, count(*) AS docs FROM ex GROUP BY label),
t AS (SELECT label, sum(n) AS total FROM c JOIN top USING (word) GROUP BY label),
m AS (SELECT top.word, l.label,
             ln((coalesce(n, 0) + 1.0::DOUBLE) / (coalesce(total, 0) + (SELECT count(*) FROM top))) AS weight
      FROM top CROSS JOIN l LEFT JOIN t USING (label) LEFT JOIN c ON c.word = top.word AND c.label = l.label),
s AS (SELECT doc_id, label, sum(weight) AS weight FROM w JOIN m USING (word) GROUP BY ALL),
p AS (SELECT doc_id, l.label, ln(docs::DOUBLE / (SELECT count(*) FROM ex)) AS prior FROM documents CROSS JOIN l),
best AS (SELECT doc_id, label AS predicted FROM p LEFT JOIN s USING (doc_id, label)
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(prior + coalesce(weight, 0), 6) DESC, label DESC) = 1)"""


_KNOWN = "SELECT doc_id, CAST(quality AS VARCHAR) AS label FROM labels"
_PART = "CASE WHEN left(md5('42:' || doc_id), 4) < 'cccd' THEN 'train' ELSE 'holdout' END"
ORACLES["classify_documents"] = f"WITH {naive_bayes(_KNOWN)} SELECT doc_id, predicted FROM best"
ORACLES["classifier_holdout"] = f"""WITH {naive_bayes(_KNOWN + " WHERE " + _PART + " = 'train'")}
SELECT {_PART} AS split, count(*) AS n, count(*) FILTER (predicted = label) AS correct
FROM best JOIN ({_KNOWN}) USING (doc_id) GROUP BY 1"""
ORACLES["interesting_documents"] = "SELECT doc_id, coalesce(" + " OR ".join(
    f"regexp_matches(lower(text), {text(w.lower())})" for w in (*V.INTERESTING_WORDS, V.INTERESTING_DIFF_WORD)
) + ", false) AS interesting FROM documents"
ORACLES["later_known_commits"] = f"""WITH {COMMITS}
SELECT commit_id, author, CAST(day AS VARCHAR) AS day, CASE WHEN language = 'c' THEN complexity END AS complexity
FROM commits WHERE author IS NOT NULL AND year > 1995"""
ORACLES["plus_one_scores"] = f"""WITH {SIZED}
SELECT language, repo, commit_id, round(complexity + 0.5::DOUBLE * log10(coalesce(entropy, 0) + 1.0::DOUBLE)
       + 0.5::DOUBLE * log10(coalesce(churn, 0) + 1.0::DOUBLE), 6) AS ccs_score FROM sized"""
ORACLES["holdout_split"] = f"""WITH {COMMITS}
SELECT commit_id, CASE WHEN left(md5('42:' || commit_id), 4) < 'cccd' THEN 'train' ELSE 'holdout' END AS split FROM commits"""
_STRIPPED = f"trim(text, {WS})"
_LINE = f"replace({_STRIPPED}, {NL}, ' ')"
_SPLIT = f"string_split_regex({_LINE}, {text('[' + V.PY_WHITESPACE + ']+')})"
ORACLES["text_functions"] = f"""SELECT doc_id, text AS sanitized, {_STRIPPED} AS cleaned,
       CASE WHEN len({_SPLIT}) > 15 THEN array_to_string({_SPLIT}[1:15], ' ') || '...' ELSE {_LINE} END AS reasoning,
       trim(replace(text, '```', ''), {WS}) AS bare,
       {_FREQUENT.replace("message", "text")} OR contains(lower(text), 'unsafe') AS interesting,
       {needle_case(f"trim(lower(text), {WS})")} AS category,
       [true, false, NULL][CAST(doc_id % 3 AS BIGINT) + 1] AS logical,
       sha1('synth:' || source || ':' || doc_id) AS synthetic,
       CASE WHEN doc_id % 5 <> 0 THEN source ELSE '<unknown>' END AS author,
       ['XML Parsing', 'HTTP/Net', 'Database', NULL][CAST(doc_id % 4 AS BIGINT) + 1] AS domain,
       CASE text[1] WHEN '+' THEN 'added' WHEN '-' THEN 'removed' WHEN chr(92) THEN 'marker' ELSE 'context' END AS kind
FROM documents"""


# ---- densities ----------------------------------------------------------------------


def density(values: str, points: int, cut: float, rule: str) -> str:
    """The binned kernel density of ``values`` (a CTE with columns g, v) at even grid points of each group."""
    spread = "least(sd, (q75 - q25) / 1.34)" if rule == "nrd0" else "sd"
    factor = 0.9 if rule == "nrd0" else 1.0
    return f"""d_vals AS (SELECT g, v FROM ({values}) WHERE v IS NOT NULL AND NOT isnan(v)),
d_stats AS (
  SELECT g, count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi,
         quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75
  FROM d_vals GROUP BY g),
d_bw AS (
  SELECT *, {factor} * coalesce(nullif({spread}, 0), nullif(sd, 0), nullif(abs(lo), 0), 1.0)
            * pow(n::DOUBLE, -0.2) AS bandwidth
  FROM d_stats),
d_grid AS (SELECT *, lo - {cut} * bandwidth AS start, (hi - lo + 2 * {cut} * bandwidth) / {points - 1} AS step FROM d_bw),
d_placed AS (
  SELECT d_grid.g, c, (v - start) / step AS pos
  FROM (SELECT g, v, count(*) AS c FROM d_vals GROUP BY g, v) counted JOIN d_grid ON counted.g IS NOT DISTINCT FROM d_grid.g),
d_lowed AS (SELECT g, c, pos, least(floor(pos), {points - 2})::BIGINT AS k FROM d_placed),
d_bins AS (
  SELECT g, k, sum(w) AS w FROM (
    SELECT g, k, c * (1 - (pos - k)) AS w FROM d_lowed UNION ALL SELECT g, k + 1 AS k, c * (pos - k) AS w FROM d_lowed)
  GROUP BY g, k),
d_pts AS (SELECT *, unnest(range(0, {points})) AS point FROM d_grid),
curve AS (
  SELECT d_pts.g, point, start + point * step AS x,
         sum(w * exp(-0.5 * ((point - k) * step / bandwidth) * ((point - k) * step / bandwidth)) / sqrt(2 * pi()))
           / (n * bandwidth) AS density,
         bandwidth, n
  FROM d_pts JOIN d_bins ON d_pts.g IS NOT DISTINCT FROM d_bins.g
  GROUP BY d_pts.g, point, start, step, bandwidth, n)"""


ORACLES["ccs_density"] = f"""WITH {SCORED}, {density("SELECT language AS g, ccs AS v FROM scored", 100, 2.0, "scott")}
SELECT g AS language, CAST(point AS INTEGER) AS point, round(x, 6) AS x, round(density, 6) AS density,
       round(bandwidth, 6) AS bandwidth, CAST(n AS BIGINT) AS n FROM curve"""
ORACLES["gini_density"] = f"""WITH {gini("language, repo, year")},
{density("SELECT language AS g, gini AS v FROM ginis", 512, 3.0, "nrd0")}
SELECT g AS language, CAST(point AS INTEGER) AS point, round(x, 6) AS x, round(density, 6) AS density,
       round(bandwidth, 6) AS bandwidth, CAST(n AS BIGINT) AS n FROM curve"""

ORACLES["diff_lines_from_parts"] = ORACLES["diff_lines"]
ORACLES["classify_documents_in_shards"] = ORACLES["classify_documents"]
# Exact while a group holds fewer than about 4,096 authors (the sketch keeps their hashes); an estimate beyond.
ORACLES["contributors_from_sketches"] = f"""WITH {COMMITS}
SELECT language, year, {DISTINCT_AUTHORS} AS contributors FROM commits GROUP BY language, year"""
