"""Registered queries, grouped like the survey."""

from __future__ import annotations

from gradeflow.plans.registry import sql_view

# ---------------------------------------------------------------------------
# Shared DuckDB building blocks
# ---------------------------------------------------------------------------

_PRIOR = """
SELECT {key}, termnum,
       sum(s) OVER w / nullif(sum(n) OVER w, 0) AS {p}_mean,
       sum(c) OVER w AS {p}_seen
FROM (SELECT {key}, termnum, sum(grdpts) AS s, count(grdpts) AS n, count(*) AS c
      FROM v_ratings GROUP BY {key}, termnum) t
WINDOW w AS ({part} ORDER BY termnum RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

sql_view("v_prior_user", ["v_ratings"], _PRIOR.format(key="sid", p="user", part="PARTITION BY sid"))
sql_view("v_prior_item", ["v_ratings"], _PRIOR.format(key="cid", p="item", part="PARTITION BY cid"))
sql_view("v_prior_global", ["v_ratings"], """
SELECT termnum, sum(s) OVER w / nullif(sum(n) OVER w, 0) AS global_mean, sum(c) OVER w AS global_seen
FROM (SELECT termnum, sum(grdpts) AS s, count(grdpts) AS n, count(*) AS c FROM v_ratings GROUP BY termnum) t
WINDOW w AS (ORDER BY termnum RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

# mean-of-means next-term predictions for every term (cold starts included)
sql_view("v_results", ["v_ratings", "v_prior_user", "v_prior_item", "v_prior_global"], """
SELECT *, grdpts - least(greatest(pred, 0.0e0), 4.0e0) AS error FROM (
  SELECT r.sid, r.cid, r.termnum, r.grdpts, r.chrs, r.ord, u.user_mean, u.user_seen,
         i.item_mean, i.item_seen, g.global_mean, g.global_seen,
         (coalesce(g.global_mean, 0.0e0) + coalesce(u.user_mean, 0.0e0)
          + coalesce(i.item_mean, 0.0e0)) / 3.0e0 AS pred
  FROM v_ratings r LEFT JOIN v_prior_user u ON r.sid = u.sid AND r.termnum = u.termnum
  LEFT JOIN v_prior_item i ON r.cid = i.cid AND r.termnum = i.termnum
  LEFT JOIN v_prior_global g ON r.termnum = g.termnum
  WHERE g.global_seen IS NOT NULL) x""")

# first-appearance cold-start label
sql_view("v_cs", ["v_ratings"], """
SELECT r.*, CASE WHEN r.termnum = fu.f AND r.termnum = fi.f THEN 'csb'
                 WHEN r.termnum = fu.f THEN 'css' WHEN r.termnum = fi.f THEN 'csc'
                 ELSE 'ncs' END AS cs
FROM v_ratings r JOIN (SELECT sid, min(termnum) AS f FROM v_ratings GROUP BY sid) fu ON r.sid = fu.sid
JOIN (SELECT cid, min(termnum) AS f FROM v_ratings GROUP BY cid) fi ON r.cid = fi.cid""")

from gradeflow.plans import q_core  # noqa: E402,F401
from gradeflow.plans import q_basic  # noqa: E402,F401
from gradeflow.plans import q_stats  # noqa: E402,F401
from gradeflow.plans import q_split  # noqa: E402,F401
from gradeflow.plans import q_flow  # noqa: E402,F401
from gradeflow.plans import q_explore  # noqa: E402,F401
from gradeflow.plans import q_models  # noqa: E402,F401
from gradeflow.plans import q_io  # noqa: E402,F401
